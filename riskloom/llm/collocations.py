"""Collocations: phrases of 2 to 4 words that hold together, per language.

Two passes over the texts. The first hashes every phrase of 1 to 4 words into a cell of a count-min sketch of one row of
CELLS counters; a counter is never below the count of a phrase it holds, so a phrase whose counter is below `least` is
out. Of the summed counters only one bit each remains (16 MB for 2**27 cells, whatever the corpus), which goes to every task.
In the second pass a task takes shards of texts of one language, compiles the shard's phrases whose bits (and
those of all phrases inside them) are set into an Aho-Corasick automaton, scans the shard and counts all
matches, overlapping ones too. Words are guarded by blanks and pieces by a line feed, so no match starts inside a word or
crosses a piece. An automaton is bounded by its shard, not by the corpus. Whether a phrase is compiled depends on the
phrase and its language alone, so each phrase is counted in all shards or in none: sums over shards are exact,
and the sketch only spares work. Counts leave a task packed by buckets of phrases, which are summed one at a time. With more cells fewer phrases are counted in vain; the result is the same.

Defined results: null text counts as empty, null lang as `und`; an empty table gives no rows; rows that repeat an id are
texts of their own; other columns of the table are not read; ties are ranked by the phrase's UTF-8 bytes. Long texts are
cut between pieces into shards of about SHARD_BYTES; a piece is never cut, so a single piece may be a larger shard.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import Shared, release_memory, slices, small_batches
from riskloom.llm.ranking import top_per_group
from riskloom.llm.words import BREAK, Words, byte_table, mixed, split_words, word_hashes
from riskloom.session import materialize

LONGEST, LEAST, TOP = 4, 30, 2000
#: Cells of the sketch: a power of two, at least 2**16.
CELLS = 1 << 27
#: Cells of a block; counters are summed block by block.
BLOCK = 1 << 16
#: Bytes of a shard, of all open shards of a task, and phrases of a task that are held before they are sent.
SHARD_BYTES, OPEN_BYTES, HELD_CELLS, HELD_PHRASES = 4_000_000, 16_000_000, 1 << 23, 300_000
#: Parts of a language's phrases that are summed apart; a task holds the sums of one.
BUCKETS = 1024
_TABLE = byte_table(True, b"\x09", b".,;:!?\x0a\x0b\x0c\x0d")


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes]]]:
    """(language, texts) with about SHARD_BYTES of texts of one language each."""
    held: dict[str, list[bytes]] = defaultdict(list)
    size: dict[str, int] = defaultdict(int)
    for batch in batches:
        for part in slices(batch):
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                for piece in _cuts(text):
                    held[lang].append(piece)
                    size[lang] += len(piece)
                    if size[lang] >= SHARD_BYTES:
                        del size[lang]
                        yield lang, held.pop(lang)
            while sum(size.values()) >= OPEN_BYTES:
                most = max(size, key=size.__getitem__)
                del size[most]
                yield most, held.pop(most)
    yield from held.items()


def _cuts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end at a break."""
    if len(text) <= SHARD_BYTES:
        yield text
        return
    text, at = text.translate(_TABLE), 0
    while at < len(text):
        end = len(text) if len(text) - at <= SHARD_BYTES else text.find(BREAK, at + SHARD_BYTES)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def phrase_hashes(words: Words, lang: str) -> list[np.ndarray]:
    """Of each word the 64-bit hashes of the phrases of 1 to LONGEST words that start there."""
    one = mixed(word_hashes(words.dictionary) ^ word_hashes(pa.array([b"lang " + lang.encode()])))[words.codes]
    out = [one]
    for n in range(1, LONGEST):
        out.append(mixed(out[-1][: max(0, len(one) - n)] * np.uint64(0xE7037ED1A0B428DB) + one[n:]))
    return out


def joined(words: Words) -> list[np.ndarray]:
    """Of each place and length whether the phrase lies within a piece."""
    return [np.ones(len(words.codes), bool)] + [words.piece[n:] == words.piece[: max(0, len(words.piece) - n)] for n in range(1, LONGEST)]


def sketch(docs: DataFrame, cells: int = CELLS, least: int = LEAST) -> np.ndarray:
    """One bit per cell: whether the phrases of the cell occur at least `least` times together. docs: (lang, text)."""
    shift, blocks = np.uint64(64 - cells.bit_length() + 1), max(1, cells // BLOCK)

    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        cell, n = np.unique(np.concatenate(held), return_counts=True)
        n = np.minimum(n, 255).astype(np.uint8)
        edges = np.searchsorted(cell, np.arange(blocks + 1, dtype=np.int64) * BLOCK)
        some = np.flatnonzero(np.diff(edges))
        steps, counts = [], []
        for b in some:
            inside = cell[edges[b] : edges[b + 1]] % BLOCK
            steps.append(np.diff(inside, prepend=0).astype("<u2").tobytes())
            counts.append(n[edges[b] : edges[b + 1]].tobytes())
        return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(steps, pa.binary()), pa.array(counts, pa.binary())], ["block", "steps", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for lang, texts in shards(batches):
            words = split_words(texts, _TABLE)
            for h, ok in zip(phrase_hashes(words, lang), joined(words), strict=True):
                held.append((h[ok] >> shift).astype(np.uint32))
                size += len(held[-1])
            if size >= HELD_CELLS:
                yield send(held)
                held, size = [], 0
        if size:
            yield send(held)
        release_memory()

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, steps, counts in zip(*(batch.column(c).to_pylist() for c in ("block", "steps", "counts")), strict=True):
                at = np.cumsum(np.frombuffer(steps, "<u2"), dtype=np.int64)
                mine = sums.setdefault(block, np.zeros(BLOCK, np.uint8))
                mine[at] = np.minimum(mine[at].astype(np.uint16) + np.frombuffer(counts, np.uint8), least)
        full = [(b, np.packbits(x >= least).tobytes()) for b, x in sums.items() if (x >= least).any()]
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in full], pa.int32()), pa.array([x for _, x in full], pa.binary())], ["block", "bits"])

    if not 1 <= least <= 255:
        raise ValueError("least must lie between 1 and 255, where a counter stops")
    parts = docs.mapInArrow(count, "block int, steps binary, counts binary").repartition("block")
    out = np.zeros(blocks * BLOCK // 8, np.uint8)
    for r in parts.mapInArrow(total, "block int, bits binary").toLocalIterator():
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def compile_shard(words: Words, lang: str, bits: np.ndarray, cells: int) -> tuple[list[str], ahocorasick.Automaton]:
    """The shard's phrases whose bits are set, as are those of the phrases inside them, and their automaton."""
    shift = np.uint64(64 - cells.bit_length() + 1)
    strings = words.strings()
    phrases: list[str] = []
    alive, ident = None, words.codes
    for n, (h, ok) in enumerate(zip(phrase_hashes(words, lang), joined(words), strict=True)):
        cell = (h >> shift).astype(np.int64)
        now = ok & ((bits[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1).astype(bool)
        if alive is not None:
            now &= alive[:-1] & alive[1:]
            # a phrase is its first words' number and its last word, so equal numbers are equal phrases
            at = np.flatnonzero(now)
            _, first, same = np.unique(ident[at] * len(strings) + words.codes[at + n], return_index=True, return_inverse=True)
            ident = np.zeros(len(now), np.int64)
            ident[at] = same
            starts = at[first]
        else:
            at = np.flatnonzero(now)
            starts = at[np.unique(words.codes[at], return_index=True)[1]]
        spelt = np.stack([words.codes[starts + k] for k in range(n + 1)], 1)
        phrases += [" ".join(map(strings.__getitem__, row)) for row in spelt.tolist()]
        alive = now
        if not len(starts):
            break
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, phrase in enumerate(phrases):
        automaton.add_word(f" {phrase} ", k)
    automaton.make_automaton()
    return phrases, automaton


def guarded(words: Words) -> str:
    """The words between blanks, with a line feed between pieces."""
    strings = [*words.strings(), "\n"]
    codes = np.insert(words.codes, np.flatnonzero(np.diff(words.piece)) + 1, len(strings) - 1)
    return f" {' '.join(map(strings.__getitem__, codes.tolist()))} "


def packed(held: dict[tuple[str, str], int], buckets: int) -> pa.RecordBatch:
    """Counts in one row per language and bucket of phrases: the phrases a line each, and their counts."""
    dealt: dict[tuple[str, int], list[tuple[str, int]]] = defaultdict(list)
    for (lang, phrase), n in held.items():
        dealt[lang, zlib.crc32(phrase.encode()) % buckets].append((phrase, n))
    columns = [pa.array([k[0] for k in dealt], pa.string()), pa.array([k[1] for k in dealt], pa.int32()), pa.array(["\n".join(p for p, _ in x) for x in dealt.values()], pa.string())]
    return pa.RecordBatch.from_arrays([*columns, pa.array([np.array([n for _, n in x], "<i8").tobytes() for x in dealt.values()], pa.binary())], ["lang", "bucket", "phrases", "counts"])


def phrase_counts(docs: DataFrame, bits: np.ndarray, cells: int = CELLS, least: int = LEAST, buckets: int = BUCKETS) -> DataFrame:
    """(lang, phrase, f) of all phrases of 1 to LONGEST words with f >= least, and a row with the empty phrase and the number
    of words per language. docs: (lang, text)."""
    sent = Shared(docs.sparkSession, bits)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], int] = defaultdict(int)
        for lang, texts in shards(batches):
            words = split_words(texts, _TABLE)
            if not len(words.codes):
                continue
            held[lang, ""] += len(words.codes)
            phrases, automaton = compile_shard(words, lang, sent.value, cells)
            if phrases:
                found = np.fromiter(map(itemgetter(1), automaton.iter(guarded(words))), np.int64)
                for k, n in enumerate(np.bincount(found, minlength=len(phrases)).tolist()):
                    held[lang, phrases[k]] += n
            if len(held) >= HELD_PHRASES:
                yield packed(held, buckets)
                held.clear()
        if held:
            yield packed(held, buckets)
        release_memory()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of one bucket at a time; the rows come ordered by language and bucket."""
        key, sums = None, defaultdict(int)

        def send() -> pa.RecordBatch:
            kept = [(p, n) for p, n in sums.items() if n >= least or not p]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(kept), pa.string()), pa.array([p for p, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["lang", "phrase", "f"])

        for batch in batches:
            for lang, bucket, phrases, counts in zip(*(batch.column(c).to_pylist() for c in ("lang", "bucket", "phrases", "counts")), strict=True):
                if (lang, bucket) != key:
                    if sums:
                        yield send()
                    key = (lang, bucket)
                for p, n in zip(phrases.split("\n"), np.frombuffer(counts, "<i8").tolist(), strict=True):
                    sums[p] += n
        if sums:
            yield send()

    by = ["lang", "bucket"]
    parts = docs.mapInArrow(scan, "lang string, bucket int, phrases string, counts binary").repartition(*by).sortWithinPartitions(*by)
    return parts.mapInArrow(merge, "lang string, phrase string, f long")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score), the `top` best of each language."""
    small_batches(docs)
    read = docs.select(F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    counts = materialize(phrase_counts(read, sketch(read, cells, least), cells, least), "phrases")
    words = counts.where("phrase = ''").select("lang", F.col("f").alias("n"))
    size = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit(""))) + 1
    f = counts.where("phrase <> ''").select("lang", "phrase", "f", size.alias("size"))
    scored = materialize(cohesion(f), "scored")
    kept = drop_parts(scored, f).select("lang", "phrase", "a", "l", "r", "score")
    best = top_per_group(materialize(kept, "candidates"), ["lang"], ["score", "a"], "phrase", top)
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def cohesion(f: DataFrame) -> DataFrame:
    """Of each phrase of several words its weakest cut: (lang, phrase, a, k, l, r, score). f: (lang, phrase, f, size)."""
    cut = f.where("size > 1").select("lang", "phrase", F.col("f").alias("a"), "size", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cut = cut.withColumn("first", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring_index(phrase, ' ', k - size)"))
    part = lambda name, count: f.select("lang", F.col("phrase").alias(name), F.col("f").alias(count))
    cut = cut.join(part("first", "l"), ["lang", "first"]).join(part("rest", "r"), ["lang", "rest"])
    wide = F.col("a").cast("decimal(20,0)") * F.lit(2_000_000).cast("decimal(7,0)")
    score = F.call_function("div", wide, F.col("l").cast("decimal(20,0)") + F.col("r")).alias("score")
    return cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score, "k", "l", "r")).alias("_cut")).select("lang", "phrase", "a", "_cut.*")


def drop_parts(scored: DataFrame, f: DataFrame) -> DataFrame:
    """Without the phrases that lie in a longer one with at least 80 % of their count."""
    inside = f.where("size > 2").select("lang", "f", "size", F.split("phrase", " ").alias("w"), F.explode(F.sequence(F.lit(2), F.col("size") - 1)).alias("m"))
    inside = inside.select("lang", "f", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
    longer = inside.groupBy("lang", F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("phrase")).agg(F.max("f").alias("_most"))
    hundred = lambda c, k: F.col(c).cast("decimal(20,0)") * F.lit(k).cast("decimal(3,0)")
    whole = F.coalesce(hundred("_most", 100) >= hundred("a", 80), F.lit(False))
    return scored.join(longer, ["lang", "phrase"], "left").where(~whole).drop("_most")
