"""Divergence between the sources of a language, over the terms that the language keeps.

Terms are counted text by text in numpy and summed by (language, source, term). A language keeps the terms of at least
MIN_DOCS of its rows. Every group (language, source) gives each kept term a smoothed share in billionths,
p = 1 + floor(10^9 (count + 1) / (N + V)), and groups are compared by f(p, q) = floor((p - q)^2 / q), all in whole numbers.

Pairs of sources are summed sparsely: terms that neither source has share one baseline value, so the sum over all V terms is
V baselines, corrected once for each term of either source (by its count, over a histogram of the source's counts) and
once more for each term that both have. Only the last needs pairs of rows of a term, at most as many as the
language has pairs of sources; they meet in squares of SQUARE sources, so that a term of very many sources
is no single task's work.

Defined results: null text, language and source count as ''; an empty table gives no rows; rows that repeat an id are
documents of their own; a text of any length is one row's work; other columns of the table are not read; groups without
terms take part; without kept terms the pairs have value 0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.llm.common import slices, small_batches
from riskloom.llm.ranking import top_per_group
from riskloom.llm.words import byte_table, split_words
from riskloom.session import materialize

MIN_DOCS, TOP_TERMS, UNIT = 3, 200, 1_000_000_000
#: Sources of a language whose pairs meet under one key of a join.
SQUARE = 256
#: Bytes of texts counted at once.
SLICE_BYTES = 8_000_000
_TABLE = byte_table(True, bytes(b for b in range(0x80) if not chr(b).isalpha()))


def count_terms(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and rows of the group with the term."""
    small_batches(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.num_rows, SLICE_BYTES):
                groups, group = {}, np.zeros(part.num_rows, np.int64)
                for i, key in enumerate(zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), strict=True)):
                    group[i] = groups.setdefault(key, len(groups))
                words = split_words(part.column("text").cast(pa.binary()).to_pylist(), _TABLE)
                size = max(1, len(words.dictionary))
                of_text, n = np.unique(words.text * size + words.codes, return_counts=True)
                of_group, place = np.unique(group[of_text // size] * size + of_text % size, return_inverse=True)
                langs, sources = (pa.array([key[k] for key in groups], pa.string()) for k in (0, 1))
                at = pa.array(of_group // size)
                columns = [langs.take(at), sources.take(at), words.dictionary.take(pa.array(of_group % size)).cast(pa.string())]
                columns += [pa.array(np.bincount(place, n, len(of_group)).astype(np.int64)), pa.array(np.bincount(place, minlength=len(of_group)).astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    read = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for c, name in ((text_col, "text"), (lang_col, "lang"), (source_col, "source"))))
    found = read.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column) -> Column:
    """1 + floor(UNIT * (count + 1) / total), by long division in base 1000: no product passes 1000 * total."""
    rest, out = count + F.lit(1).cast("long"), F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + _div(rest, total)
        rest = rest % total
    # count + 1 may equal total, so the first digit may be 1000
    return out + 1


def _div(a: Column, b: Column) -> Column:
    """Whole-number division of longs of at least 0."""
    return F.call_function("div", a, b)


def gap(p: Column, q: Column) -> Column:
    return _div((p - q) * (p - q), q)


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS, square: int = SQUARE) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): part `pair` has all other sources of the language, part `term` the
    `top` terms that stand out against the whole language."""
    counted = materialize(count_terms(docs, text_col, lang_col, source_col), "counts")
    kept = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).where(F.col("docs") >= min_docs).select("lang", "term", "lang_n")
    rows = counted.join(kept, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n")
    rows = materialize(rows, "kept")
    of_lang = kept_totals(rows)
    all_groups = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    own = rows.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = all_groups.join(own, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "lang_total", "vocabulary")))
    groups = groups.withColumn("spread", F.col("total") + F.col("vocabulary"))
    groups = materialize(groups.withColumn("p0", F.when(F.col("spread") > 0, share(F.lit(0).cast("long"), F.greatest("spread", F.lit(1).cast("long")))).otherwise(F.lit(1).cast("long"))), "groups")
    shares = rows.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "p0", share(F.col("n"), F.col("spread")).alias("p"), share(F.col("lang_n"), F.col("lang_total") + F.col("vocabulary")).alias("q"))
    shares = materialize(shares, "shares")
    pairs = pair_sums(shares, groups, square)
    ranked = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))
    terms = materialize(shares.where("p > q").select("lang", "source", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value")), "terms")
    terms = top_per_group(terms, ["lang", "source"], ["value"], "item", top)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))


def kept_totals(rows: DataFrame) -> DataFrame:
    """(lang, lang_total, vocabulary): occurrences and number of kept terms."""
    by_term = rows.groupBy("lang", "term").agg(F.sum("n").alias("n"))
    return by_term.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("vocabulary"))


def pair_sums(shares: DataFrame, groups: DataFrame, square: int = SQUARE) -> DataFrame:
    """(lang, source, item, value) for all ordered pairs of sources of a language; shares: (lang, source, term, n, p, p0)."""
    here = groups.select("lang", "source", "p0", "vocabulary")
    there = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    both = materialize(here.join(there, "lang").where("source <> item"), "pairs")
    base = both.select("lang", "source", "item", (F.col("vocabulary") * gap(F.col("p0"), F.col("q0"))).alias("value"))
    # a source's terms by their count: one correction for all terms with the same count
    held = materialize(shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms")), "held")
    flat = gap(F.col("p0"), F.col("q0"))
    own = held.join(both, ["lang", "source"]).select("lang", "source", "item", (F.col("terms") * (gap(F.col("p"), F.col("q0")) - flat)).alias("value"))
    other = held.withColumnRenamed("source", "item").join(both, ["lang", "item"]).select("lang", "source", "item", (F.col("terms") * (gap(F.col("p0"), F.col("p")) - flat)).alias("value"))
    # terms that both have; squares of sources part the pairs of a term
    blocks = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / square).cast("int").alias("blocks"))
    dealt = shares.select("lang", "source", "term", "p", "p0").join(blocks, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a = dealt.select("lang", "term", "source", "p", "p0", F.col("own").alias("i"), every.alias("j"))
    b = dealt.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"), F.col("own").alias("j"), every.alias("i"))
    met = a.join(b, ["lang", "term", "i", "j"]).where("source < item")
    p, p0, q, q0 = (F.col(c) for c in ("p", "p0", "q", "q0"))
    forth = gap(p, q) - gap(p, q0) - gap(p0, q) + gap(p0, q0)
    back = gap(q, p) - gap(q, p0) - gap(q0, p) + gap(q0, p0)
    shared = materialize(met.groupBy("lang", "source", "item").agg(F.sum(forth).alias("forth"), F.sum(back).alias("back")), "shared")
    shared = shared.select("lang", "source", "item", F.col("forth").alias("value")).unionByName(shared.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("back").alias("value")))
    return base.unionByName(own).unionByName(other).unionByName(shared).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
