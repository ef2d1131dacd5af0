"""Best-fit packing of token pieces into fixed-length sequences by a grouping genetic algorithm.

Pieces are spread evenly over shards of a bounded size. For each shard several islands evolve
populations of packings: crossover injects whole well-filled bins of one parent into the other, bins that now
hold a piece twice are dissolved, and the displaced pieces are placed by best fit, largest
first. After each epoch an island receives the elite of its neighbour. A shard whose packing
meets the lower bound on bins is optimal and stops; the others go on until PATIENCE epochs in a row save no bin.

Then the shards meet again: each gives up its emptiest bins, at most one piece in REPACKED, and the pieces of all
shards' emptiest bins are packed anew in the same way, level by level, until one shard holds what is left. So the
loss of a part of a bin a shard does not add up. A level that doesn't save a bin is undone and is the last.

Defined results: null text counts as empty (one piece, the end id alone); rows that repeat a
key are packed as rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import json
import random
import re
import zlib
from bisect import bisect_right, insort
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import Shared, WordStore, map_slices, per_process, row_spread, segment_sums, split_on_space
from riskloom.llm.sentencepiece_codec import WIDTH, PairTable, merge_symbols
from riskloom.session import materialize

#: Words joined into one text for the tokenizer.
JOINED = 2000
#: Texts tokenized at once; with fewer a worker needs less memory for new words.
TOKENIZED = 250
#: A sequence's number: its level's number, its shard's and the bin's place in the shard.
LEVEL_STRIDE, SHARD_STRIDE = 1 << 56, 1 << 20
#: Epochs without a saved bin after which a shard stops; the share of pieces, one in so many, that meet again.
PATIENCE, REPACKED = 2, 8
#: Sequences' worth of room that the bins of a shard that don't meet others again may leave.
LEFT = 0.05
#: Pieces of a bin up to which exchanges are tried; loose pieces, spread over their sizes, that are tried in pairs.
SWAPPED, TRIED = 8, 48


class WordTokenizer:
    """Ids of whole texts for a byte-level BPE tokenizer with word ends that drops white space.

    Such a tokenizer cuts texts into runs of letters, single digits, runs of other signs, and contractions. In
    texts of Latin-1 characters columnar expressions make the cuts, and vectorised rounds merge each distinct
    piece; pieces with an apostrophe, and chunks of all other texts, go through the library.
    """

    #: Texts with one of these are cut by the library: other characters, controls, signs next to an apostrophe.
    OTHER = r"[^\t\n\r\x20-\x7E\x{A1}-\x{FF}]|[^\s\p{L}\p{N}']'|'[^\s\p{L}\p{N}]"
    CUT = r"(\p{N}|[^ \p{L}\p{N}']+)"

    def __init__(self, spec: str, special_as_text: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.tokenizer.encode_special_tokens = special_as_text
        parsed = json.loads(spec)
        model = parsed["model"]
        # texts with the string of a special token are cut by the library, which may give it an id of its own
        self.other = "|".join([self.OTHER, *("(?i:" + re.sub(r"(\W)", r"\\\1", t["content"]) + ")" for t in parsed.get("added_tokens", ()))])
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.pairs = PairTable([vocab[a] * WIDTH + vocab[b] for a, b in merges], list(range(len(merges))), [vocab[a + b] for a, b in merges])
        # byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        char = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
        self.inner = np.array([vocab[char[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[char[b] + end] for b in range(256)], np.int64)
        self.store = WordStore(self._learn, size=64_000_000)
        self.chunks = WordStore(self._library)

    def _merge(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [t.encode() for t in tokens]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        sym = self.inner[data]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        sym[ends] = self.last[data[ends]]
        return merge_symbols(sym, lengths, self.pairs)

    def _library(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for at in range(0, len(chunks), JOINED):
            part = chunks[at : at + JOINED]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            starts = np.cumsum([0, *(len(c) + 1 for c in part)])
            where = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.offsets))
            ids.append(np.array(found.ids, np.int64))
            counts.append(np.diff(np.searchsorted(where, starts)))
        return np.concatenate(ids), np.concatenate(counts)

    def _learn(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        whole = [t for t in tokens if "'" not in t]
        if len(whole) == len(tokens):
            return self._merge(tokens)
        other = [t for t in tokens if "'" in t]
        place = np.fromiter(("'" in t for t in tokens), bool, len(tokens))
        owner = np.concatenate([np.flatnonzero(~place), np.flatnonzero(place)])
        (one, n_one), (two, n_two) = self._merge(whole), self._library(other)
        flat, owner = np.concatenate([one, two]), np.repeat(owner, np.concatenate([n_one, n_two]))
        return flat[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(tokens))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts and their number per text."""
        texts = texts.fill_null("")
        other = pc.match_substring_regex(texts, self.other)
        odd = other.to_numpy(zero_copy_only=False)
        for blank in "\n\t\r":
            texts = pc.replace_substring(texts, blank, " ")
        flat, counts = self._of(pc.replace_substring_regex(pc.utf8_lower(pc.if_else(other, "", texts)), self.CUT, r" \1 "), self.store)
        if odd.any():
            flat_odd, counts_odd = self._of(texts.filter(other), self.chunks)
            owner = np.concatenate([np.repeat(np.arange(len(odd)), counts), np.repeat(np.flatnonzero(odd), counts_odd)])
            flat = np.concatenate([flat, flat_odd])[np.argsort(owner, kind="stable")]
            counts[odd] = counts_odd
        return flat, counts

    @staticmethod
    def _of(texts: pa.Array, store: WordStore) -> tuple[np.ndarray, np.ndarray]:
        codes, counts, parts = split_on_space(texts)
        flat, lengths = store.gather(store.places(parts)[codes])
        return flat, segment_sums(lengths, counts)


def pieces(df: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, key: str = "doc_id", text_col: str = "text", special_as_text: bool = False) -> DataFrame:
    """(key, piece int, start long, length long, ids_crc32 long): each text's ids and an end id, cut at multiples of capacity.

    As in the library, the string of a special token in a text is that token, unless special_as_text."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = Shared(df.sparkSession, f.read())
    schema = T.StructType([df.schema[key], T.StructField("piece", T.IntegerType(), False), *(T.StructField(c, T.LongType(), False) for c in ("start", "length", "ids_crc32"))])
    end = np.array([end_id], "<u4").tobytes()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = per_process("word tokenizer", shared.id, lambda: WordTokenizer(shared.value, special_as_text))
        flat, counts = tokenizer.encode(batch.column(text_col))
        data, ends = flat.astype("<u4").tobytes(), np.append(0, 4 * np.cumsum(counts)).tolist()
        rows, out = [], []
        for row in range(batch.num_rows):
            ids = memoryview(data[ends[row] : ends[row + 1]] + end)
            for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                part = ids[at : at + 4 * capacity]
                rows.append(row)
                out.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
        columns = list(zip(*out, strict=True)) or [(), (), (), ()]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], schema.fieldNames())

    return map_slices(df.select(key, text_col), run, schema, rows=TOKENIZED)


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """Bins that any packing needs: by volume, and by pieces that can't share a bin (Martello and Toth's L2)."""
    count = np.bincount(sizes, minlength=capacity + 1).astype(np.int64)
    volume = np.cumsum(count * np.arange(capacity + 1))
    number = np.cumsum(count)
    best = -(-int(volume[-1]) // capacity)
    for small in range(capacity // 2 + 1):
        huge = int(number[-1] - number[capacity - small])  # over capacity - small: alone
        large = int(number[capacity - small] - number[capacity // 2])  # over half
        room = large * capacity - int(volume[capacity - small] - volume[capacity // 2])
        middle = int(volume[capacity // 2] - (volume[small - 1] if small else 0))
        best = max(best, huge + large + max(0, -(-(middle - room) // capacity)))
    return best


def best_fit(sizes: list[int], order: list[int], capacity: int, bins: list[list[int]]) -> list[list[int]]:
    """Places the pieces of `order` one by one into the fullest of `bins` that takes them, else into a new bin."""
    by_room: dict[int, list[int]] = {}
    mask = 0
    for k, items in enumerate(bins):
        room = capacity - sum(sizes[i] for i in items)
        by_room.setdefault(room, []).append(k)
        mask |= 1 << room
    for i in order:
        fits = mask >> sizes[i]
        if fits:
            room = (fits & -fits).bit_length() - 1 + sizes[i]
            held = by_room[room]
            k = held.pop()
            if not held:
                mask &= ~(1 << room)
            bins[k].append(i)
        else:
            room, k = capacity, len(bins)
            bins.append([i])
        room -= sizes[i]
        by_room.setdefault(room, []).append(k)
        mask |= 1 << room
    return bins


def fitness(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones; smaller is better."""
    return len(bins), -sum((sum(sizes[i] for i in b) / capacity) ** 2 for b in bins) / max(1, len(bins))


def exchange(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Fills bins better by giving one or two of their pieces for one or two of the loose ones; the smaller ones become loose.

    For each bin the exchange that leaves the least room is taken. Only bins of at most SWAPPED pieces are tried.
    """
    free = sorted((sizes[i], i) for i in loose)
    for bin_ in bins:
        room = capacity - sum(sizes[i] for i in bin_)
        if not room or not 1 <= len(bin_) <= SWAPPED or not free:
            continue
        best = None
        for out in [*combinations(bin_, 2), *((i,) for i in bin_)]:
            held = sum(sizes[i] for i in out)
            most = held + room
            one = bisect_right(free, (most, len(sizes))) - 1
            if one >= 0 and free[one][0] > held and (best is None or most - free[one][0] < best[0]):
                best = (most - free[one][0], out, (one,))
            for low in range(0, len(free), max(1, len(free) // TRIED)):
                # the largest partner that still fits
                high = bisect_right(free, (most - free[low][0], len(sizes))) - 1
                if high <= low:
                    break
                both = free[low][0] + free[high][0]
                if both > held and (best is None or most - both < best[0]):
                    best = (most - both, out, (low, high))
            if best and not best[0]:
                break
        if best:
            _, out, taken = best
            coming = [free[k][1] for k in taken]
            for k in sorted(taken, reverse=True):
                del free[k]
            bin_[:] = [i for i in bin_ if i not in out] + coming
            for i in out:
                insort(free, (sizes[i], i))
    return bins, [i for _, i in reversed(free)]


def refill(bins: list[list[int]], loose: list[int], sizes: list[int], capacity: int) -> list[list[int]]:
    """Places loose pieces: exchanges first, then best fit by decreasing size."""
    bins, loose = exchange(bins, loose, sizes, capacity)
    return best_fit(sizes, loose, capacity, bins)


def crossover(one: list[list[int]], other: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """`one` with whole well-filled bins of `other`; what they displace is placed by best fit."""
    filled = [b for b in other if sum(sizes[i] for i in b) >= 0.98 * capacity]
    injected = rng.sample(filled, min(len(filled), max(1, len(other) // 4)))
    taken = {i for b in injected for i in b}
    clean = [list(b) for b in one if taken.isdisjoint(b)]
    displaced = [i for b in one if not taken.isdisjoint(b) for i in b if i not in taken]
    return refill(clean + [list(b) for b in injected], displaced, sizes, capacity)


def mutate(bins: list[list[int]], sizes: list[int], capacity: int, rng: random.Random) -> list[list[int]]:
    """Dissolves the emptiest bins and a few others."""
    by = sorted(bins, key=lambda b: sum(sizes[i] for i in b))
    gone, stay = by[: max(2, len(by) // 20)], by[max(2, len(by) // 20) :]
    for _ in range(min(len(stay), max(1, len(by) // 50))):
        gone.append(stay.pop(rng.randrange(len(stay))))
    return refill([list(b) for b in stay], [i for b in gone for i in b], sizes, capacity)


def _bins(assignment: list[int] | None) -> list[list[int]]:
    out: list[list[int]] = []
    for i, k in enumerate(assignment or ()):
        while len(out) <= k:
            out.append([])
        out[k].append(i)
    return out


def _assignment(bins: list[list[int]], n: int) -> list[int]:
    at = [0] * n
    for k, members in enumerate(bins):
        for i in members:
            at[i] = k
    return at


def emptiest(sizes: list[int], own: list[int], capacity: int) -> set[int]:
    """The emptiest bins that aren't full, with at most one piece in REPACKED of all, but one bin at least."""
    fill: dict[int, int] = {}
    pieces: dict[int, int] = {}
    for size, k in zip(sizes, own, strict=True):
        fill[k] = fill.get(k, 0) + size
        pieces[k] = pieces.get(k, 0) + 1
    room, out = max(1, len(sizes) // REPACKED), set()
    for k in sorted((k for k in fill if fill[k] < capacity), key=lambda k: (fill[k], k)):
        if out and pieces[k] > room:
            break
        out.add(k)
        room -= pieces[k]
    return out


def settled(bins: list[list[int]], sizes: list[int], capacity: int, bound: int, again: bool) -> bool:
    """Whether a packing needs no more work: it meets the bound or, where the emptiest bins meet those of other
    shards again, the bins that stay leave hardly any room."""
    if len(bins) <= bound:
        return True
    if not again:
        return False
    given = emptiest(sizes, _assignment(bins, len(sizes)), capacity)
    return sum(capacity - sum(sizes[i] for i in b) for k, b in enumerate(bins) if k not in given) <= LEFT * capacity


def evolve(sizes: list[int], capacity: int, seed: int, pool: list[list[list[int]]], generations: int, population: int = 4, again: bool = False) -> list[list[list[int]]]:
    """The population after some generations, best first, from the packings in `pool` and best fit over noisy decreasing orders."""
    rng = random.Random(seed)
    bound = lower_bound(np.array(sizes, np.int64), capacity) if sizes else 0
    rank = lambda bins: (not settled(bins, sizes, capacity, bound, again), *fitness(bins, sizes, capacity))
    ranked = [(rank(p), p) for p in pool]
    while len(ranked) < population and not any(not r[0] for r, _ in ranked):
        noise = 0.05 * rng.random() if ranked else 0.0
        keys = [s * (1 - noise * rng.random()) for s in sizes]
        made = best_fit(sizes, sorted(range(len(sizes)), key=lambda i: -keys[i]), capacity, [])
        ranked.append((rank(made), made))
    for _ in range(generations):
        if any(not r[0] for r, _ in ranked):
            break
        (_, a), (_, b) = rng.sample(ranked, 2)
        child = crossover(a, b, sizes, capacity, rng)
        if rng.random() < 0.5:
            child = mutate(child, sizes, capacity, rng)
        new = rank(child)
        worst = max(range(len(ranked)), key=lambda k: ranked[k][0])
        if new <= ranked[worst][0] and all(child != p for _, p in ranked):
            ranked[worst] = (new, child)
    return [p for _, p in sorted(ranked, key=lambda x: x[0])[:population]]


def islands_evolve(lengths: DataFrame, shards: int, capacity: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(shard, lengths, own): the best packing of each shard; own: the bin of each piece. lengths: (shard, lengths)."""
    pools = "array<array<int>>"
    state = lengths.select("shard", "lengths", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), F.lit(None).cast(pools).alias("pool"), F.lit(None).cast("array<int>").alias("elite"))
    schema = T._parse_datatype_string(f"shard long, lengths array<int>, island int, pool {pools}, bins int, open boolean")
    finished: list[DataFrame] = []
    fewest, idle = None, 0
    for epoch in range(epochs):

        def run(batch: pa.RecordBatch, epoch: int = epoch) -> pa.RecordBatch:
            out = []
            for row in batch.to_pylist():
                sizes = row["lengths"]
                held = [_bins(x) for x in [*(row["pool"] or ()), *([row["elite"]] if row["elite"] else [])]]
                found = evolve(sizes, capacity, hash((row["shard"], row["island"], epoch)), held, generations, again=shards > 1)
                more = not settled(found[0], sizes, capacity, lower_bound(np.array(sizes, np.int64), capacity), shards > 1)
                out.append({"shard": row["shard"], "lengths": sizes, "island": row["island"], "pool": [_assignment(b, len(sizes)) for b in found], "bins": len(found[0]), "open": more})
            return pa.RecordBatch.from_pylist(out, arrow_schema)

        arrow_schema = pa.schema([("shard", pa.int64()), ("lengths", pa.list_(pa.int32())), ("island", pa.int32()), ("pool", pa.list_(pa.list_(pa.int32()))), ("bins", pa.int32()), ("open", pa.bool_())])
        # islands of a shard run in tasks of their own
        state = materialize(map_slices(state.repartition(shards * islands, "shard", "island"), run, schema, rows=4), "islands")
        least = state.groupBy("shard").agg(F.min("bins").alias("least"), F.min("open").alias("more"))
        left, total = least.where("more").agg(F.count(F.lit(1)), F.sum("least")).first()
        idle = idle + 1 if fewest is not None and (left, total) >= fewest else 0
        fewest = (left, total)
        if not left or epoch == epochs - 1 or idle >= PATIENCE:
            finished.append(state)
            break
        named = state.join(least, "shard")
        finished.append(named.where("NOT more").drop("least", "more"))
        ring = Window.partitionBy("shard").orderBy("island")
        best = F.col("pool")[0]
        last = F.last(best).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
        state = named.where("more").select("shard", "lengths", "island", "pool", F.coalesce(F.lag(best).over(ring), last).alias("elite"))
    every = reduce(DataFrame.unionByName, finished)
    return every.groupBy("shard").agg(F.min_by(F.struct("lengths", F.col("pool")[0].alias("own")), F.struct("open", "bins", "island")).alias("b")).select("shard", "b.lengths", "b.own")


def pack_level(pieces: DataFrame, count: int, level: int, capacity: int, length_col: str, shard_rows: int, islands: int, epochs: int, generations: int) -> DataFrame:
    """(item, sequence_id, offset, open): the packed rows of (item), open where the bin may meet others again."""
    shards = max(1, -(-count // shard_rows))
    table = pieces.select(F.pmod(row_spread(F.col("item")[length_col]), F.lit(shards)).alias("shard"), "item")
    table = materialize(table.groupBy("shard").agg(F.collect_list("item").alias("items")).repartition(shards, "shard"), "shards")
    best = islands_evolve(table.select("shard", F.transform("items", lambda x: x[length_col].cast("int")).alias("lengths")), shards, capacity, islands, epochs, generations)

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        offsets, opened = [], []
        for sizes, own in zip(batch.column("lengths").to_pylist(), batch.column("own").to_pylist(), strict=True):
            fill: dict[int, int] = {}
            at = []
            for size, k in zip(sizes, own, strict=True):
                at.append(fill.get(k, 0))
                fill[k] = at[-1] + size
            again = emptiest(sizes, own, capacity) if shards > 1 else set()
            offsets.append(at)
            opened.append([k in again for k in own])
        return pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("own"), pa.array(offsets, pa.list_(pa.int64())), pa.array(opened, pa.list_(pa.bool_()))], ["shard", "own", "offsets", "opened"])

    placed = map_slices(best, place, T._parse_datatype_string("shard long, own array<int>, offsets array<long>, opened array<boolean>"))
    rows = placed.join(table, "shard").select("shard", F.explode(F.arrays_zip("items", "own", "offsets", "opened")).alias("x"))
    number = F.lit(level * LEVEL_STRIDE) + F.col("shard") * SHARD_STRIDE + F.col("x.own")
    return materialize(rows.select(F.col("x.items").alias("item"), number.alias("sequence_id"), F.col("x.offsets").alias("offset"), F.col("x.opened").alias("open")), "packed")


def pack(df: DataFrame, capacity: int = 2048, length_col: str = "length", shard_rows: int = 8192, islands: int = 2, epochs: int = 12, generations: int = 12) -> DataFrame:
    """df with sequence_id long and offset long: rows of the same sequence stand gapless from 0 and fill at most capacity."""
    fixed = materialize(df.drop("sequence_id", "offset"), "pieces")
    left = fixed.select(F.struct(*(F.col(f"`{c}`") for c in fixed.columns)).alias("item"))
    done: list[DataFrame] = []
    before, count, level = None, fixed.count(), 0
    while True:
        now = pack_level(left, count, level, capacity, length_col, shard_rows, islands, epochs, generations)
        bins, = now.agg(F.count_if(F.col("offset") == 0)).first()
        if before is not None and bins >= before[1]:
            done.append(before[0])
            break
        done.append(now.where("NOT open"))
        again = now.where("open")
        count, bins = again.agg(F.count(F.lit(1)), F.count_if(F.col("offset") == 0)).first()
        if not count:
            break
        before, left, level = (again, bins), again.select("item"), level + 1
    rows = reduce(DataFrame.unionByName, done)
    return rows.select(*(F.col(f"item.`{c}`").alias(c) for c in fixed.columns), "sequence_id", "offset")
