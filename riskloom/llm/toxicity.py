"""Toxicity scores from a factorization machine over hashed terms.

Terms are a text's distinct words and their first 4 and 5 bytes, hashed into 2**BITS buckets. Screening
keeps buckets that are tied to the label in the training sample; the machine then learns a
weight and a factor vector per kept bucket, so pairs of terms can raise or lower a score
beyond what each adds by itself.

The training sample is the SAMPLE_ROWS labelled rows with the smallest hash of their key; a sample of
that size, its screened terms and the model are bounded whatever the corpus' size. Scoring
reads every whole text.

Defined results: null and empty texts get the score of a text without known terms; without
labelled rows, or with labels of one kind only, every score is the share of toxic labels (0 without rows).
Rows that repeat a key are scored each; of labels that repeat a key, toxic wins.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import Shared, WordStore, kept_fields, map_slices, per_process, texts_of
from riskloom.llm.licenses import words_of

BITS = 20
SAMPLE_ROWS = 12_000
#: A bucket is kept with at least so many rows and such a chi-square statistic; at most so many are.
MIN_ROWS, MIN_CHI2, MAX_TERMS = 4, 20.0, 4096
#: Texts whose words are held at once.
TEXTS = 250


def buckets(word: bytes) -> tuple[int, ...]:
    mask = (1 << BITS) - 1
    return (zlib.crc32(word) & mask, *(zlib.crc32(b"\x00%d%s" % (n, word[:n])) & mask for n in (4, 5) if len(word) >= n))


@dataclass(frozen=True)
class FactorizationMachine:
    bias: float
    place: dict[int, int] = field(default_factory=dict)  # bucket -> row of weights and factors
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    factors: np.ndarray = field(default_factory=lambda: np.zeros((0, 1)))

    def score(self, rows: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """Scores of n texts; rows: the machine's rows of all texts, each once per text; owner: the text of each."""
        v = self.factors[rows]
        pair = sum(0.5 * (np.bincount(owner, x, n) ** 2 - np.bincount(owner, x * x, n)) for x in v.T)
        return 1 / (1 + np.exp(-np.clip(self.bias + np.bincount(owner, self.weights[rows], n) + pair, -30, 30)))


def fit_machine(terms: list[np.ndarray], labels: np.ndarray, rank: int = 4, steps: int = 400, rate: float = 0.05, seed: int = 7) -> FactorizationMachine:
    """terms: each row's distinct buckets. Adam on the logistic loss with quadratic penalties."""
    n, positive = len(labels), int(labels.sum())
    if positive in (0, n):
        share = positive / n if n else 0.0
        return FactorizationMachine(float(np.log(max(share, 1e-12) / max(1 - share, 1e-12))))
    size = 1 << BITS
    all_rows = np.zeros(size)
    toxic_rows = np.zeros(size)
    for x, y in zip(terms, labels, strict=True):
        all_rows[x] += 1
        if y:
            toxic_rows[x] += 1
    a, b = toxic_rows, all_rows - toxic_rows
    c, d = positive - a, n - positive - b
    with np.errstate(divide="ignore", invalid="ignore"):
        chi2 = n * (a * d - b * c) ** 2 / ((a + b) * (c + d) * (a + c) * (b + d))
    chi2 = np.where((all_rows >= MIN_ROWS) & np.isfinite(chi2), chi2, 0)
    kept = np.flatnonzero(chi2 >= MIN_CHI2)
    kept = np.sort(kept[np.argsort(-chi2[kept], kind="stable")[:MAX_TERMS]])
    place = {int(k): i for i, k in enumerate(kept)}
    rows = [np.array(sorted({place[t] for t in x.tolist() if t in place}), np.int64) for x in terms]
    owner = np.repeat(np.arange(n), [len(r) for r in rows])
    flat = np.concatenate(rows) if len(owner) else np.zeros(0, np.int64)
    rng = np.random.default_rng(seed)
    params = [np.array([np.log(positive / (n - positive))]), np.zeros(len(kept)), rng.normal(0, 0.01, (len(kept), rank))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    penalties = (0.0, 1e-4, 1e-3)
    segment = lambda values: np.stack([np.bincount(owner, v, n) for v in values.T], 1)
    for step in range(1, steps + 1):
        bias, w, v = params
        total = segment(v[flat])
        square = segment(v[flat] ** 2)
        z = bias[0] + np.bincount(owner, w[flat], n) + 0.5 * (total**2 - square).sum(1)
        error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n
        by_term = error[owner]
        push = by_term[:, None] * (total[owner] - v[flat])
        grads = [np.array([error.sum()]), np.bincount(flat, by_term, len(kept)), np.stack([np.bincount(flat, g, len(kept)) for g in push.T], 1)]
        for p, g, (m, s), penalty in zip(params, grads, moments, penalties, strict=True):
            g = g + penalty * p / max(1, n) * 100
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return FactorizationMachine(float(params[0][0]), place, params[1], params[2])


def fit(df: DataFrame, labels: DataFrame, key: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = SAMPLE_ROWS) -> FactorizationMachine:
    """Fits on at most `rows` labelled rows of df; labels holds key and label_col (0/1)."""
    spark = df.sparkSession
    chosen = labels.where(F.col(key).isNotNull() & F.col(label_col).isNotNull()).groupBy(key).agg(F.max(label_col).alias("y")).orderBy(F.xxhash64(key), key).limit(rows).collect()
    if not chosen:
        return fit_machine([], np.zeros(0))
    wanted = spark.createDataFrame([(r[0], float(r[1] > 0)) for r in chosen], T.StructType([T.StructField("k", labels.schema[key].dataType), T.StructField("y", T.DoubleType())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in texts_of(batch, "t"):
            out.append(np.array(sorted({b for w in set(words_of(text)) for b in buckets(w)}), "<u4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("y"), pa.array(out, pa.binary())], ["y", "terms"])

    # the chosen rows are bounded by `rows`, so they go to every task and the texts stay where they are
    joined = df.select(F.col(key).alias("k"), F.col(text_col).alias("t")).join(F.broadcast(wanted), "k").select("k", "y", "t")
    table = map_slices(joined, run, T._parse_datatype_string("y double, terms binary"), rows=TEXTS).toArrow()
    order = sorted(zip(table.column("terms").to_pylist(), table.column("y").to_pylist(), strict=True))
    return fit_machine([np.frombuffer(t, "<u4").astype(np.int64) for t, _ in order], np.array([y for _, y in order]))


def score(df: DataFrame, model: FactorizationMachine, text_col: str = "text", out_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df with out_col, the probability that a text is toxic."""
    passed = kept_fields(df, keep, [out_col])
    shared = Shared(df.sparkSession, model)
    schema = T.StructType([*(df.schema[c] for c in passed), T.StructField(out_col, T.DoubleType(), False)])

    def store() -> WordStore:
        """Each word's rows of the machine."""
        machine: FactorizationMachine = shared.value

        def learn(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            found = [[machine.place[b] for b in buckets(w) if b in machine.place] for w in words]
            return np.array([r for rows in found for r in rows], np.int64), np.fromiter(map(len, found), np.int64, len(found))

        return WordStore(learn)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine, held = shared.value, per_process("toxicity terms", shared.id, store)
        split = [list(set(words_of(t))) for t in texts_of(batch, text_col)]
        text = np.repeat(np.arange(len(split)), [len(words) for words in split])
        rows, counts = held.gather(held.places([w for words in split for w in words]))
        size = max(1, len(machine.weights))
        pairs = np.unique(np.repeat(text, counts) * size + rows)
        out = machine.score(pairs % size, pairs // size, len(split))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(out, pa.float64())], [*passed, out_col])

    needed = [*passed, *([] if text_col in passed else [text_col])]
    return map_slices(df.select(*needed), run, schema, rows=TEXTS)
