"""Near-duplicate documents by b-bit MinHash, confirmed on full shingle sets.

1. Each text becomes the set of its distinct word shingles (64-bit hashes), KS = BANDS * ROWS minima over random hash
   functions, one key per band, and a signature of the minima's lowest BITS bits.
2. Documents with the same words are one class; only its smallest document goes on.
3. Documents that share a band key are candidates. In a first round each takes the best of the smallest
   documents of its buckets, by the collision-corrected similarity that bit counts of the signatures give.
   Confirmed pairs are joined into components.
4. In a second round buckets that still hold several components are compared block by block. A semi-join keeps
   the documents with a partner in another component whose estimate reaches the threshold less MARGIN standard
   errors; tasks intersect the full sets of two blocks and return a spanning forest of the links between
   components. So every candidate pair is within a component, confirmed, or ruled out, and no list of pairs is ever made.

A pair at the threshold shares a band with probability 1 - (1 - 0.75 ** 5) ** 48 > 0.999997. Pairs are linked only if
their full sets pass.

Defined results: one row comes back for each row. Null and empty texts have no shingles and are linked with nothing; a
text with fewer words than a shingle is one shingle. Rows that repeat a document id are one document that has the
links of all its texts: they share the component, and n_shingles is that of the largest set. Rows without an id take no
part: no shingles, no component, kept. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import WordStore, kept_fields, map_slices, per_process, texts_of
from riskloom.llm.components import connected_components
from riskloom.session import materialize

ROWS, BANDS, BITS = 5, 48, 4
KS = ROWS * BANDS
LONGS = KS * BITS // 64
#: Standard errors by which an estimate may fall short before a candidate is ruled out.
MARGIN = 6.0
#: Documents of a bucket that meet in one task, and those of them that one matrix product compares.
BLOCK, PRODUCT = 1024, 256
#: Texts whose words are held at once.
TEXTS = 250
#: A-Z become lower case; blanks stay blanks.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20240229)
_MULTIPLY = (_RNG.integers(0, 1 << 32, KS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _RNG.integers(0, 1 << 32, KS, dtype=np.uint64).astype(np.uint32)
_STEPS = _RNG.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """64-bit hashes of words, each computed once while the store holds it."""

    def __init__(self) -> None:
        self.store = WordStore(self._learn, dtype=np.uint64)

    @staticmethod
    def _learn(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=8).digest() for w in words), "<u8"), np.ones(len(words), np.int64)

    def of(self, texts: list[str]) -> Iterator[tuple[list[bytes], np.ndarray]]:
        """Words of each text and their hashes."""
        split = [t.encode("utf-8", "surrogatepass").translate(LOWER).split() for t in texts]
        places = self.store.places([w for words in split for w in words])
        return zip(split, np.split(self.store.flat[places], np.cumsum([len(words) for words in split])[:-1]), strict=True)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` words; of the whole sequence if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    run = min(size, n)
    out = np.full(n - run + 1, run * int(_STEPS[63]) % (1 << 64), np.uint64)
    for k in range(run):
        out += hashes[k : n - run + 1 + k] * _STEPS[k]
    out ^= out >> np.uint64(29)
    out *= _STEPS[62]
    out ^= out >> np.uint64(32)
    return np.unique(out)


def minima(found: np.ndarray) -> np.ndarray:
    """KS minima over random hash functions of a non-empty set."""
    low = (found >> np.uint64(32)).astype(np.uint32) ^ found.astype(np.uint32)
    best = np.full(KS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(low), 256):
        part = low[at : at + 256]
        mixed = (part[:, None] ^ _XOR) * _MULTIPLY
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x2C1B3C6D)
        np.minimum(best, mixed.min(0), out=best)
    return best


def sketch(best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys and packed b-bit signature, as signed 64-bit integers."""
    rows = best.reshape(BANDS, ROWS).astype(np.uint64)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * _STEPS[61]
    for k in range(ROWS):
        keys = (keys ^ rows[:, k]) * _STEPS[40 + k]
        keys ^= keys >> np.uint64(31)
    low = (best & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(LONGS, 64 // BITS)
    packed = (low << (np.arange(64 // BITS, dtype=np.uint64) * np.uint64(BITS))).sum(1, dtype=np.uint64)
    return keys.view(np.int64), packed.view(np.int64)


def signatures(df: DataFrame, key: str, text_col: str, size: int) -> DataFrame:
    """(key, n_shingles, words: hash of the word sequence, bands, s0..): null words and no bands without shingles."""
    names = [f"s{k}" for k in range(LONGS)]
    schema = T.StructType([df.schema[key], T.StructField("n_shingles", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), *(T.StructField(n, T.LongType()) for n in names)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words: Words = per_process("shingle words", "", Words)
        counts, digests, bands, packed = [], [], [], []
        for parts, hashes in words.of(texts_of(batch, text_col)):
            found = shingles(hashes, size)
            counts.append(len(found))
            if len(found):
                keys, bits = sketch(minima(found))
                digests.append(hashlib.blake2b(b" ".join(parts), digest_size=16).digest())
                bands.append(keys)
                packed.append(bits)
            else:
                digests.append(None)
                bands.append([])
                packed.append(np.zeros(LONGS, np.int64))
        columns = np.array(packed, np.int64).reshape(-1, LONGS)
        return pa.RecordBatch.from_arrays([batch.column(key), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), *(pa.array(columns[:, k]) for k in range(LONGS))], schema.fieldNames())

    return map_slices(df.select(key, text_col), run, schema, rows=TEXTS)


def estimate(one: str, other: str) -> Column:
    """Collision-corrected similarity: the share of equal b-bit minima, less what equals by chance."""
    ones = int("1" * (64 // BITS), 16)
    differ = []
    for k in range(LONGS):
        x = F.col(f"{one}.s{k}").bitwiseXOR(F.col(f"{other}.s{k}"))
        x = reduce(lambda s, n, x=x: s.bitwiseOR(F.shiftrightunsigned(x, n)), range(1, BITS), x)
        differ.append(F.bit_count(x.bitwiseAND(F.lit(ones))))
    chance = 2.0**-BITS
    return ((F.lit(KS) - reduce(Column.__add__, differ)) / F.lit(float(KS)) - F.lit(chance)) / F.lit(1 - chance)


def full_sets(ids: DataFrame, docs: DataFrame, key: str, text_col: str, size: int) -> DataFrame:
    """(id, found): the full shingle sets of these documents."""
    texts = docs.select(F.col(key).alias("id"), F.col(text_col).alias("t")).join(ids.hint("merge"), "id", "left_semi")

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        words: Words = per_process("shingle words", "", Words)
        out = [shingles(hashes, size).astype("<u8").tobytes() for _, hashes in words.of(texts_of(batch, "t"))]
        return pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], ["id", "found"])

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("found", T.BinaryType())])
    return materialize(map_slices(texts, build, schema, rows=TEXTS).groupBy("id").agg(F.min("found").alias("found")), "sets")


def passes(shared: np.ndarray | int, one: np.ndarray | int, other: np.ndarray | int, percent: int):
    return (shared > 0) & (100 * shared >= percent * (one + other - shared))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full shingle sets pass."""
    wide = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")

    def test(batch: pa.RecordBatch) -> pa.RecordBatch:
        good = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
            good.append(bool(passes(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y), percent)))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return map_slices(wide.select("a", "b", "x", "y"), test, T._parse_datatype_string("a long, b long"), rows=256).distinct()


def intersections(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of each left set with each right set, by products of incidence matrices of bounded width."""
    out = np.zeros((len(left), len(right)), np.float32)
    common = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)), assume_unique=True)
    for at in range(0, len(common), width):
        part = common[at : at + width]

        def incidence(sets: list[np.ndarray], part: np.ndarray = part) -> np.ndarray:
            m = np.zeros((len(sets), len(part)), np.float32)
            for k, s in enumerate(sets):
                place = np.minimum(np.searchsorted(part, s), len(part) - 1)
                m[k, place[part[place] == s]] = 1
            return m

        out += incidence(left) @ incidence(right).T
    return out.astype(np.int64)


def links_across(ids: list[int], parts: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between documents of different components."""
    root = {c: c for c in parts}

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    out, sizes = [], np.array([len(s) for s in sets])
    for at in range(0, len(ids), PRODUCT):
        for to in range(at, len(ids), PRODUCT):
            shared = intersections(sets[at : at + PRODUCT], sets[to : to + PRODUCT])
            for i, j in zip(*np.nonzero(passes(shared, sizes[at : at + PRODUCT, None], sizes[None, to : to + PRODUCT], percent)), strict=True):
                i, j = int(i) + at, int(j) + to
                p, q = find(parts[i]), find(parts[j])
                if p != q:
                    root[max(p, q)] = min(p, q)
                    out.append((ids[i], ids[j]))
    return out


def second_round(members: DataFrame, bits: DataFrame, labels: DataFrame, docs: DataFrame, key: str, text_col: str, size: int, percent: int, floor: float) -> DataFrame:
    """(a, b): links that connect components which share a bucket."""
    named = members.join(labels, "id", "left").select("band", "n", "id", F.coalesce("component", "id").alias("c"))
    mixed = materialize(named.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("band"), "mixed")
    rows = named.join(mixed, "band").join(bits, "id").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
    rows = materialize(rows.withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "open")
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    left = rows.select("*", every.alias("j")).withColumnRenamed("own", "i")
    right = rows.select("*", every.alias("i")).withColumnRenamed("own", "j")
    met = (F.col("x.band") == F.col("y.band")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j")) & (F.col("x.c") != F.col("y.c")) & (estimate("x", "y") >= floor)
    active = left.alias("x").join(right.alias("y"), met, "left_semi")
    active = materialize(active.select("band", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "id", "c").distinct(), "active")
    sets = full_sets(active.select("id").distinct(), docs, key, text_col, size)
    tasks = active.join(sets, "id").repartition("band", "i", "j").sortWithinPartitions("band", "i", "j")

    def run(batches):
        at, ids, parts, found = None, [], [], []

        def out() -> pa.RecordBatch:
            edges = links_across(ids, parts, found, percent)
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in edges], pa.int64()), pa.array([b for _, b in edges], pa.int64())], ["a", "b"])

        for batch in batches:
            tasks_of = zip(*(batch.column(c).to_pylist() for c in ("band", "i", "j")), strict=True)
            for task, k, c, x in zip(tasks_of, batch.column("id").to_pylist(), batch.column("c").to_pylist(), batch.column("found"), strict=True):
                if task != at:
                    if len(ids) > 1:
                        yield out()
                    at, ids, parts, found = task, [], [], []
                ids.append(k)
                parts.append(c)
                found.append(np.frombuffer(x.as_buffer(), "<u8"))
        if len(ids) > 1:
            yield out()

    return materialize(tasks.select("band", "i", "j", "id", "c", "found").mapInArrow(run, "a long, b long").distinct(), "links")


def groups(docs: DataFrame, ties: DataFrame | None, key: str, text_col: str, size: int, percent: int) -> DataFrame:
    """(key, n_shingles, component): one row for each row of docs, whose keys are unique longs; ties (a, b): keys that belong together anyway."""
    signed = materialize(signatures(docs, key, text_col, size), "signatures")
    names = [f"s{k}" for k in range(LONGS)]
    held = F.struct("bands", *names)
    reps = materialize(signed.where("words IS NOT NULL").groupBy("words").agg(F.min(key).alias("id"), F.min_by(held, key).alias("x")).select("words", "id", "x.*"), "classes")
    buckets = reps.select("id", F.explode("bands").alias("band"))
    shared = materialize(buckets.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("lead")).where("n > 1"), "buckets")
    members = materialize(buckets.join(shared, "band"), "members")
    bits = reps.select("id", *names)
    floor = percent / 100 - MARGIN * float(np.sqrt(percent / 100 * (1 - percent / 100) / KS))

    stars = members.where("id <> lead").select(F.col("lead").alias("a"), F.col("id").alias("b")).distinct()
    near = stars.alias("p").join(bits.alias("x"), F.col("p.a") == F.col("x.id")).join(bits.alias("y"), F.col("p.b") == F.col("y.id"))
    near = near.select("a", "b", estimate("x", "y").alias("e")).where(F.col("e") >= floor)
    best = materialize(near.groupBy("b").agg(F.max_by("a", F.struct("e", -F.col("a"))).alias("a")).select("a", "b"), "pairs")
    sets = full_sets(best.select(F.explode(F.array("a", "b")).alias("id")).distinct(), docs, key, text_col, size)
    links = materialize(confirm(best, sets, percent), "links")
    if ties is not None:  # between the classes of the tied texts
        of = signed.where("words IS NOT NULL").select(F.col(key).alias("k"), "words").join(reps.select("words", F.col("id").alias("r")), "words")
        one, two = of.select(F.col("k").alias("a"), F.col("r").alias("ra")), of.select(F.col("k").alias("b"), F.col("r").alias("rb"))
        tied = ties.join(one, "a").join(two, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).where("a <> b")
        links = materialize(links.unionByName(tied).distinct(), "links")
    labels = materialize(connected_components(links), "labels")
    more = second_round(members, bits, labels, docs, key, text_col, size, percent, floor)
    if not more.isEmpty():
        labels = materialize(connected_components(links.unionByName(more)), "labels")
    named = materialize(reps.select("words", "id").join(labels, "id", "left").select("words", F.coalesce("component", "id").alias("component")), "named")
    return signed.select(key, "n_shingles", "words").join(named, "words", "left").select(key, "n_shingles", F.coalesce("component", key).alias("component"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 75, keep: list[str] | None = None) -> DataFrame:
    """df with n_shingles long, component_id long (smallest key reachable by links) and kept boolean (key = component_id)."""
    source = df.withColumn(key, F.col(key).cast("long"))
    docs = source.where(F.col(key).isNotNull()).select(key, text_col)
    repeated = materialize(docs.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key), "repeated")
    if repeated.isEmpty():
        one = groups(docs, None, key, text_col, size, percent).select(F.col(key).alias("_id"), "n_shingles", F.col("component").alias("component_id"))
    else:
        # rows that repeat an id get numbers of their own, below all ids
        low = docs.agg(F.min(key)).first()[0]
        again = materialize(docs.join(repeated, key).withColumn("_node", F.lit(low) - 1 - F.monotonically_increasing_id()), "again")
        nodes = docs.join(repeated, key, "left_anti").withColumn("_node", F.col(key)).unionByName(again)
        lead = materialize(again.groupBy(key).agg(F.min("_node").alias("a")), "leads")
        ties = again.join(lead, key).select("a", F.col("_node").alias("b")).where("a <> b")
        found = materialize(groups(nodes.select("_node", text_col), ties, "_node", text_col, size, percent), "nodes")
        found = found.join(again.select("_node", F.col(key).alias("_id")), "_node", "left").withColumn("_id", F.coalesce("_id", "_node"))
        # the texts of an id without words are tied to nothing: they have the component of its other texts
        smallest = materialize(found.groupBy("component").agg(F.min("_id").alias("component_id")), "smallest")
        one = found.join(smallest, "component").groupBy("_id").agg(F.max("n_shingles").alias("n_shingles"), F.min("component_id").alias("component_id"))
    passed = kept_fields(df, keep, ["n_shingles", "component_id", "kept"])
    # the join by id may meet a hot id, so both sides are tables that it can split
    rows = source.select(*dict.fromkeys([key, *passed]))
    out = rows.join(materialize(one, "documents").withColumnRenamed("_id", key), key, "left")
    out = out.withColumn("n_shingles", F.coalesce("n_shingles", F.lit(0).cast("long")))
    return out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True))).select(*passed, "n_shingles", "component_id", "kept")
