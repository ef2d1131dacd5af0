"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

Words are held as one flat numpy array of symbols. A round finds, for each word, the smallest
rank among its adjacent pairs, merges the leftmost occurrences of that rank at once, and
compacts the array; words without a pair leave. Merging several places at once equals the
library's one-at-a-time order as long as no pair born in the round ranks as early as the
round's own; where one does, the word merges its leftmost place only.

Defined results: null text is encoded as empty text, empty text has no ids; a null list of ids
decodes to the empty string; an output column replaces an input column of the same name.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from riskloom.llm.common import Shared, WordStore, kept_fields, list_array, map_slices, per_process, segment_sums, split_on_space

SPACE = "▁"
NO_PAIR = np.iinfo(np.int32).max
WIDTH = 1 << 21  # more than any vocabulary here plus all code points
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        if tag & 7 == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(tag & 7)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


class PairTable:
    """Pairs of symbols with their rank and merged symbol, found by hashing with linear probing."""

    def __init__(self, keys: list[int], ranks: list[int], merged: list[int]):
        bits = max(4, (8 * len(keys) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.ranks = np.full(1 << bits, NO_PAIR, np.int32)
        self.merged = np.full(1 << bits, -1, np.int32)
        for key, slot, rank, to in zip(keys, self._slots(np.array(keys, np.int64)).tolist(), ranks, merged, strict=True):
            while self.keys[slot] >= 0:
                slot = (slot + 1) & self.mask
            self.keys[slot], self.ranks[slot], self.merged[slot] = key, rank, to

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NO_PAIR where there is none or where `joined` is false."""
        keys = left * WIDTH + right
        slots = self._slots(keys)
        held = self.keys[slots]
        open_ = np.flatnonzero((held != keys) & (held >= 0))
        while len(open_):
            slots[open_] = (slots[open_] + 1) & self.mask
            held = self.keys[slots[open_]]
            open_ = open_[(held != keys[open_]) & (held >= 0)]
        hit = joined & (self.keys[slots] == keys)
        return np.where(hit, self.ranks[slots], NO_PAIR), np.where(hit, self.merged[slots], -1)


@dataclass(frozen=True)
class PieceTable:
    """What encoding and decoding need of a model; some MB, fixed by the vocabulary."""

    pieces: list[str]
    kinds: np.ndarray
    pairs: PairTable
    chars: np.ndarray  # symbol of each code point; len(pieces) + code point for an unknown one
    byte_ids: np.ndarray  # id of each byte piece, -1 without
    unknown: int
    dummy_prefix: bool

    @property
    def size(self) -> int:
        return len(self.pieces)


def load_pieces(path: str) -> PieceTable:
    """Read a BPE model file with identity normalisation."""
    pieces, scores, kinds = [], [], []
    dummy, squeeze, name, bpe = True, True, b"", False
    with open(path, "rb") as f:
        raw = f.read()
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            pieces.append(piece.get(1, b"").decode())
            scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            kinds.append(piece.get(3, NORMAL))
        elif number == 2:
            bpe = dict(_fields(value)).get(3, 1) == 2
        elif number == 3:
            spec = dict(_fields(value))
            name, dummy, squeeze = spec.get(1, b""), bool(spec.get(3, 1)), bool(spec.get(4, 1))
    if not bpe or name != b"identity" or squeeze or USER_DEFINED in kinds or UNUSED in kinds:
        raise ValueError("only BPE models with identity normalisation, kept spaces and no user-defined pieces are supported")
    normal = [i for i, k in enumerate(kinds) if k == NORMAL]
    ids = {pieces[i]: i for i in normal}
    order = {s: r for r, s in enumerate(sorted({scores[i] for i in normal}, reverse=True))}
    chars = np.arange(0x110000, dtype=np.int32) + len(pieces)
    for text, i in ids.items():
        if len(text) == 1:
            chars[ord(text)] = i
    symbol = lambda t: ids.get(t, len(pieces) + ord(t) if len(t) == 1 else None)
    keys, ranks, merged = [], [], []
    for text, i in ids.items():
        for cut in range(1, len(text)):
            left, right = symbol(text[:cut]), symbol(text[cut:])
            if left is not None and right is not None:
                keys.append(left * WIDTH + right)
                ranks.append(order[scores[i]])
                merged.append(i)
    byte_ids = np.full(256, -1, np.int32)
    for i, k in enumerate(kinds):
        if k == BYTE:
            byte_ids[int(pieces[i][3:5], 16)] = i
    unknown = next((i for i, k in enumerate(kinds) if k == UNKNOWN), 0)
    return PieceTable(pieces, np.array(kinds, np.int8), PairTable(keys, ranks, merged), chars, byte_ids, unknown, dummy)


def merge_symbols(sym: np.ndarray, lengths: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words after merging, flat, and their number per word; sym: the words' symbols, lengths: per word."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    sym = sym.astype(np.int64)
    done_sym, done_word = [], []
    if len(sym):
        rank, merged = pairs.find(sym, np.append(sym[1:], 0), np.append(word[1:] == word[:-1], False))
    while len(sym):
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(starts, len(sym)))
        least = np.minimum.reduceat(rank, starts)
        ended = least == NO_PAIR
        if ended.any():
            out = np.repeat(ended, sizes)
            done_sym.append(sym[out])
            done_word.append(word[out])
            stay = ~out
            sym, word, rank, merged = sym[stay], word[stay], rank[stay], merged[stay]
            sizes, least = sizes[~ended], least[~ended]
            if not len(sym):
                break
        least = np.repeat(least, sizes)
        hit = np.flatnonzero(rank == least)
        # every second place of a run of overlapping ones, from the left
        first = np.flatnonzero(np.append(True, np.diff(hit) > 1))
        hit = hit[(np.arange(len(hit)) - np.repeat(first, np.diff(np.append(first, len(hit))))) % 2 == 0]
        # a pair born in this round, in turn from the left, that ranks as early as the round
        after = sym.copy()
        after[hit] = merged[hit]
        second = np.zeros(len(sym), bool)
        second[hit + 1] = True
        left = np.maximum(hit - 1, 0)
        prior = np.where(second[left], np.maximum(hit - 2, 0), left)
        one, _ = pairs.find(after[prior], after[hit], (hit > 0) & (word[left] == word[hit]))
        right = np.minimum(hit + 2, len(sym) - 1)
        two, _ = pairs.find(after[hit], sym[right], (hit + 2 < len(sym)) & (word[right] == word[hit]))
        early = np.minimum(one, two) <= least[hit]
        if early.any():
            bad = np.zeros(len(lengths), bool)
            bad[word[hit[early]]] = True
            hit = hit[~bad[word[hit]] | np.append(True, word[hit][1:] != word[hit][:-1])]
        sym[hit] = merged[hit]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        place = (np.cumsum(keep) - 1)[hit]
        sym, word, rank, merged = sym[keep], word[keep], rank[keep], merged[keep]
        touched = np.zeros(len(sym), bool)
        touched[place] = True
        touched[np.maximum(place - 1, 0)] = True
        touched = np.flatnonzero(touched)
        after = np.minimum(touched + 1, len(sym) - 1)
        rank[touched], merged[touched] = pairs.find(sym[touched], sym[after], (touched + 1 < len(sym)) & (word[after] == word[touched]))
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(len(lengths), np.int64)
    flat, owner = np.concatenate(done_sym), np.concatenate(done_word)
    return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(lengths))


class Encoder:
    """Encodes texts word by word; each distinct word is merged once while the store holds it.

    A word is a run of spaces and what follows up to the next space. In a text without leading, trailing or double
    spaces those are the parts between spaces, each with one space before it.
    """

    def __init__(self, table: PieceTable):
        self.table = table
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.store = WordStore(self._learn)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        flat, counts = merge_symbols(self.table.chars[points], np.fromiter(map(len, words), np.int64, len(words)), self.table.pairs)
        alien = flat >= self.table.size
        if not alien.any():
            return flat, counts
        ids = {s: self._bytes_of(s) for s in set(flat[alien].tolist())}
        width = np.ones(len(flat), np.int64)
        width[alien] = [len(ids[s]) for s in flat[alien].tolist()]
        out, at = np.repeat(flat, width), np.cumsum(width) - width
        for k in np.flatnonzero(alien).tolist():
            out[at[k] : at[k] + width[k]] = ids[int(flat[k])]
        return out, segment_sums(width, counts)

    def _bytes_of(self, symbol: int) -> list[int]:
        ids = [int(self.table.byte_ids[b]) for b in chr(symbol - self.table.size).encode("utf-8", "surrogatepass")]
        return [self.table.unknown] if -1 in ids else ids

    def encode(self, texts: pa.Array | list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their number per text."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts.fill_null("")
        plain = pc.replace_substring(texts, SPACE, " ")
        codes, counts, parts = split_on_space(plain)
        empty = np.fromiter((not p for p in parts), bool, len(parts))
        odd = segment_sums(empty[codes].astype(np.int64), counts) > 0
        names = [SPACE + p for p in parts]
        if not self.table.dummy_prefix:
            odd[:] = True
        if odd.any():  # their words are found one text at a time
            place = {w: k for k, w in enumerate(names)}
            each, numbers = np.split(codes, np.cumsum(counts)[:-1]), counts.copy()
            prefix = SPACE if self.table.dummy_prefix else ""
            for k in np.flatnonzero(odd).tolist():
                text = plain[k].as_py()
                found = [place.setdefault(w, len(place)) for w in self.words.findall((prefix + text).replace(" ", SPACE))] if text else []
                each[k], numbers[k] = np.array(found, np.int64), len(found)
            codes, counts, names = np.concatenate(each), numbers, list(place)
        used, inverse = np.unique(codes, return_inverse=True)
        places = self.store.places([names[k] for k in used.tolist()])
        flat, lengths = self.store.gather(places[inverse])
        return flat, segment_sums(lengths, counts)


class Decoder:
    def __init__(self, table: PieceTable):
        self.table = table
        raw = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(table.pieces, table.kinds.tolist(), strict=True)]
        self.raw = pa.array(raw, pa.binary())

    def _careful(self, ids: list[int]) -> str:
        """Text of ids whose byte pieces aren't valid UTF-8: each such byte becomes U+FFFD."""
        out, held = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(held):
                for size in (4, 3, 2, 1):
                    try:
                        text = bytes(held[at : at + size]).decode()
                    except UnicodeDecodeError:
                        continue
                    if len(text) == 1:
                        out.append(text)
                        at += size
                        break
                else:
                    out.append("�")
                    at += 1
            held.clear()

        for i in ids:
            if self.table.kinds[i] == BYTE:
                held += self.raw[i].as_py()
            else:
                flush()
                out.append(self.raw[i].as_py().decode())
        flush()
        return "".join(out)

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[str]:
        taken = self.raw.take(pa.array(flat, pa.int32()))
        offsets = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int32)
        data = memoryview(taken.buffers()[2]) if len(flat) else b""
        ends = np.append(0, np.cumsum(counts)).tolist()
        out = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            try:
                text = str(data[offsets[a] : offsets[b]], "utf-8")
            except UnicodeDecodeError:
                text = self._careful(flat[a:b].tolist())
            # the prefix that encoding puts before the text
            first = next((i for i in flat[a:b].tolist()[:8] if self.table.kinds[i] != CONTROL), None) if b > a else None
            if self.table.dummy_prefix and first is not None and self.table.kinds[first] == NORMAL and text[:1] == " ":
                text = text[1:]
            out.append(text)
        return out


def encode(df: DataFrame, table: PieceTable, text_col: str = "text", out_col: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Adds array<int> out_col with the ids of text_col; `keep` names the columns that pass through (all)."""
    passed = kept_fields(df, keep, [out_col])
    schema = T.StructType([*(df.schema[c] for c in passed), T.StructField(out_col, T.ArrayType(T.IntegerType(), False), False)])
    shared = Shared(df.sparkSession, table)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        encoder = per_process("sentencepiece encoder", shared.id, lambda: Encoder(shared.value))
        flat, counts = encoder.encode(batch.column(text_col))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), list_array(flat, counts, pa.int32())], [*passed, out_col])

    needed = [*passed, *([] if text_col in passed else [text_col])]
    return map_slices(df.select(*needed), run, schema)


def decode(df: DataFrame, table: PieceTable, ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """Adds string out_col, the text of ids_col; `keep` names the columns that pass through (all)."""
    passed = kept_fields(df, keep, [out_col])
    schema = T.StructType([*(df.schema[c] for c in passed), T.StructField(out_col, T.StringType(), False)])
    shared = Shared(df.sparkSession, table)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        decoder = per_process("sentencepiece decoder", shared.id, lambda: Decoder(shared.value))
        ids = batch.column(ids_col)
        counts = ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        texts = decoder.decode(ids.flatten().to_numpy(zero_copy_only=False), counts)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(texts, pa.string())], [*passed, out_col])

    needed = [*passed, *([] if ids_col in passed else [ids_col])]
    return map_slices(df.select(*needed), run, schema)
