"""Quality rules whose cutoffs are certified against false rejection.

Every text gets counts (words, characters, symbols, repeated lines and words), and from them rules with levels
from 0 to LEVELS on a grid that is fixed beforehand. A rule with cutoff c rejects the texts at level c and above. The
labelled rows serve as holdouts: for each stratum (language) and rule, cutoffs are tested from the most lenient one
down, each with the exact binomial test of "more than ALPHA / number of rules of the good texts are rejected", and the
first that can't be refuted ends the sequence. Tests of one sequence need no correction among themselves (a
fixed sequence); over strata and rules the error DELTA is split evenly (Bonferroni). So with probability 1 - DELTA all
certified cutoffs of all strata hold at once, and a stratum loses at most ALPHA of its good texts to all its rules
together, whichever certified cutoffs are taken. Rule by rule the one is taken that rejects the most bad texts less COST
times the good ones among those that the rules before it keep, the more lenient of equals; none if that isn't above 0.
A stratum with too few labelled texts certifies nothing and rejects nothing.

Counts over labelled rows are aggregates of all of them; what is tested are at most LEVELS + 1 rows per stratum and rule.

Defined results: null texts count as empty: no words, all counts 0; null stratum is `und`; rows that repeat a key are
judged each, and each counts as a holdout if its key is labelled; of labels that repeat a key the best counts; rows
without key are judged by the rules like others; an empty table gives no rows; no labels: nothing is rejected by
rules; output columns replace columns of the same name. A text of any length is one row's work.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import kept_fields, map_slices
from riskloom.llm.words import byte_table, split_words
from riskloom.session import materialize, ship

ALPHA, DELTA, LEVELS, COST = 0.05, 0.05, 64, 10
SYMBOLS = b"#*$%&|<>"
#: Base rule: fewer words, or a larger share of words in repeated windows.
MIN_WORDS, MAX_REPEATED = 50, 0.5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct")
_WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
_TABLE = byte_table(False, _WHITE.encode())


def rules() -> dict[str, Column]:
    """Each rule's level of a text: a share of LEVELS, higher for worse."""

    def level(a: Column, b: Column) -> Column:
        return F.least(F.lit(LEVELS), F.when(b > 0, F.floor(a * LEVELS / b)).otherwise(0)).cast("int")

    n, chars = F.col("n_words"), F.col("word_chars")
    return {
        "symbols": level(F.col("n_symbols"), chars),
        "repeated_lines": level(F.col("n_dup_lines"), F.col("n_lines")),
        "repeated_words": level(F.col("n_repeat_words"), n),
        "few_words": level(n - F.col("n_distinct"), n),
        # words of 24 characters on average reach the last level
        "long_words": level(chars, n * 24),
    }


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > int(100 * MAX_REPEATED) * F.col("n_words"))


def repeated_words(text: np.ndarray, codes: np.ndarray, texts: int) -> np.ndarray:
    """Of each text how many words lie in a window of three words that occurs twice or more in the text."""
    if len(codes) < 3:
        return np.zeros(texts, np.int64)
    size = int(codes.max()) + 1
    _, pair = np.unique(codes[:-1] * size + codes[1:], return_inverse=True)
    _, window = np.unique(pair[:-1] * size + codes[2:], return_inverse=True)
    at = np.flatnonzero(text[2:] == text[:-2])
    _, same, n = np.unique(text[at] * (int(window.max()) + 1) + window[at], return_inverse=True, return_counts=True)
    hit = np.zeros(len(codes), bool)
    again = at[n[same] > 1]
    for k in range(3):
        hit[again + k] = True
    return np.bincount(text[hit], minlength=texts)


def counts_of(texts: list[str]) -> list[np.ndarray]:
    """The columns COUNTS of these texts."""
    raw = [t.encode() for t in texts]
    words = split_words(raw, _TABLE)
    per_text = lambda at, weights=None: np.bincount(at, weights, len(texts)).astype(np.int64)
    chars = np.fromiter(map(len, words.strings()), np.int64, len(words.dictionary))
    symbols = np.array([sum(map(t.count, SYMBOLS)) for t in raw], np.int64)
    lines = [[line for line in t.split("\n") if line.strip(_WHITE)] for t in texts]
    n_lines = np.array([len(x) for x in lines], np.int64)
    distinct = np.unique(words.text * max(1, len(words.dictionary)) + words.codes) // max(1, len(words.dictionary))
    return [
        per_text(words.text),
        per_text(words.text, chars[words.codes]),
        symbols,
        n_lines,
        n_lines - np.array([len(set(x)) for x in lines], np.int64),
        repeated_words(words.text, words.codes, len(texts)),
        per_text(distinct),
    ]


def measure(df: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """df with the columns COUNTS."""
    passed = kept_fields(df, keep, list(COUNTS))
    schema = T.StructType([*(df.schema[c] for c in passed), *(T.StructField(c, T.LongType(), False) for c in COUNTS)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [t or "" for t in batch.column(text_col).to_pylist()]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), *(pa.array(x, pa.int64()) for x in counts_of(texts))], [*passed, *COUNTS])

    return map_slices(df.select(*dict.fromkeys([*passed, text_col])), run, schema)


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) of n trials, by the continued fraction of the incomplete beta function: its time doesn't grow with n."""
    if k >= n:
        return 1.0
    if k < 0:
        return 0.0
    # P(X <= k) = I(1 - p; n - k, k + 1)
    a, b, x = n - k, k + 1, 1 - p
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta(b, a, p)
    return _beta(a, b, x)


def _beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function for x up to about its mean, by Lentz's evaluation of the fraction."""
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    out, m, step = d, 0, 0.0
    while abs(step - 1) > 1e-15 and m < 1_000_000:
        m += 1
        for by in (m * (b - m) * x / ((a - 1 + 2 * m) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 1 + 2 * m))):
            d, c = 1 / (1 + by * d), 1 + by / c
            step = c * d
            out *= step
    return front * out


def certify(levels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """(stratum, rule, good, certified): the strictest certified cutoff of each stratum and rule, null if none.
    levels: (stratum, rule, level, good, bad), numbers of labelled texts at each level, at most LEVELS + 1 rows a group."""
    ship(levels.sparkSession)
    sizes = levels.select("stratum", "rule").distinct().agg(F.count(F.lit(1)).alias("tests"), F.count_distinct("rule").alias("rules")).first()
    risk, error = alpha / max(1, sizes.rules), delta / max(1, sizes.tests)

    def strictest(group: pd.DataFrame) -> pd.DataFrame:
        good, lost, _ = _upwards(group)
        certified = None
        for cutoff in range(LEVELS, 0, -1):
            if binomial_cdf(int(lost[cutoff]), good, risk) > error:
                break
            certified = cutoff
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "rule": group["rule"].iloc[:1], "good": good, "certified": pd.array([certified], "Int32")})

    return levels.groupBy("stratum", "rule").applyInPandas(strictest, "stratum string, rule string, good long, certified int")


def _upwards(group: pd.DataFrame) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of good texts, and of the good and of the bad at each level or above."""
    by_level = group.groupby("level")[["good", "bad"]].sum().reindex(range(LEVELS + 1), fill_value=0)
    lost, caught = (by_level[c].to_numpy()[::-1].cumsum()[::-1] for c in ("good", "bad"))
    return int(by_level["good"].sum()), lost, caught


def choose(levels: DataFrame, certified: DataFrame, cost: float = COST) -> DataFrame:
    """(stratum, cutoff) of one rule, for strata in which one is worth its losses. levels: numbers of texts as for certify;
    certified: (stratum, certified) of the rule."""

    def best(group: pd.DataFrame) -> pd.DataFrame:
        _, lost, caught = _upwards(group)
        last = int(group["certified"].iloc[0])
        worth = [(float(caught[c]) - cost * float(lost[c]), c) for c in range(last, LEVELS + 1)]
        gain, cutoff = max(worth)
        return pd.DataFrame({"stratum": group["stratum"].iloc[:1], "cutoff": pd.array([cutoff if gain > 0 else None], "Int32")})

    met = levels.join(certified.where("certified IS NOT NULL"), "stratum")
    return met.groupBy("stratum").applyInPandas(best, "stratum string, cutoff int").where("cutoff IS NOT NULL")


def holdouts(measured: DataFrame, labels: DataFrame, key: str, stratum_col: str, label_col: str) -> DataFrame:
    """(stratum, good, levels) of the labelled texts that the base rule keeps; levels has one level per rule."""
    best = labels.where(F.col(key).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label_col).alias("_good"))
    labelled = measured.where(~base_failed()).join(best, F.col(key) == F.col("_key"))
    return labelled.select(F.coalesce(F.col(stratum_col), F.lit("und")).alias("stratum"), (F.col("_good") > 0).cast("long").alias("good"), F.array(*rules().values()).alias("levels"))


def level_counts(held: DataFrame) -> DataFrame:
    """(stratum, rule, level, good, bad) over all rules."""
    each = F.explode(F.array(*(F.struct(F.lit(name).alias("rule"), F.col("levels")[k].alias("level")) for k, name in enumerate(rules()))))
    return held.select("stratum", "good", each.alias("_l")).groupBy("stratum", "_l.rule", "_l.level").agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))


def cutoffs(held: DataFrame, alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """(stratum, rule, cutoff) in use. Rules take their turn in the order of rules(): what a rule catches or loses counts only among
    the texts that the rules before it keep, so a rule that adds nothing isn't used."""
    held = materialize(held, "holdouts")
    certified = materialize(certify(level_counts(held), alpha, delta), "certified")
    out, left = None, held
    for k, name in enumerate(rules()):
        by_level = left.groupBy("stratum", F.col("levels")[k].alias("level")).agg(F.sum("good").alias("good"), F.sum(1 - F.col("good")).alias("bad"))
        found = materialize(choose(by_level, certified.where(F.col("rule") == name).select("stratum", "certified"), cost), "cutoff")
        left = left.join(found, "stratum", "left").where(F.col("cutoff").isNull() | (F.col("levels")[k] < F.col("cutoff"))).drop("cutoff")
        found = found.select("stratum", F.lit(name).alias("rule"), "cutoff")
        out = found if out is None else out.unionByName(found)
    return out


def judge(df: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", label_col: str = "quality", keep: list[str] | None = None, alpha: float = ALPHA, delta: float = DELTA, cost: float = COST) -> DataFrame:
    """df with COUNTS, base_failed, failed_rules (names of the certified rules that reject the text) and kept."""
    passed = kept_fields(df, keep, [*COUNTS, "base_failed", "failed_rules", "kept"])
    measured = materialize(measure(df, text_col, list(dict.fromkeys([*passed, key, stratum_col]))), "measured")
    found = cutoffs(holdouts(measured, labels, key, stratum_col, label_col), alpha, delta, cost)
    by_stratum = materialize(found.groupBy(F.col("stratum").alias("_stratum")).agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("_cutoffs")), "cutoffs")
    met = measured.join(by_stratum, F.coalesce(F.col(stratum_col), F.lit("und")) == F.col("_stratum"), "left")
    failed = F.array_compact(F.array(*(F.when(level >= F.col("_cutoffs")[name], F.lit(name)) for name, level in rules().items())))
    out = met.withColumn("base_failed", base_failed()).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0)).select(*passed, *COUNTS, "base_failed", "failed_rules", "kept")
