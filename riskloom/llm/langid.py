"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the 1- to 3-grams of a text's lower-cased words (with a blank at both ends), hashed
into BUCKETS buckets; a feature's value is its share of the text's n-grams times its inverse
document frequency. Document frequencies cover all documents that may be learned from. The
regression is trained by follow-the-regularised-leader with elastic-net penalties on a
sample of at most ROWS_PER_LANGUAGE texts per language, drawn by a hash of the key; a fifth of the sample
is held back to calibrate a temperature. As the features are shares, a text's logits are sums over
its words, so each distinct word is looked up once.

Defined results: null texts and texts without a letter are `und` with score 0; with no learned
language every text is `und`; rows that repeat a key are predicted each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.llm.common import Shared, WordStore, kept_fields, map_slices, per_process, slices, small_batches, texts_of

BUCKETS = 1 << 15
ROWS_PER_LANGUAGE = 1000
#: Texts whose words are held at once.
TEXTS = 250
UNKNOWN = "und"
#: Features are shares times this, so that they are about 1 in size.
SCALE = 100.0
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Lower-cased words, none if the text has no letter."""
    words = _WORDS.findall(text.lower())
    return words if any(c.isalpha() for w in words for c in w) else []


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of these words, and the word each belongs to."""
    points = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    word = np.repeat(np.arange(len(words)), lengths)
    edge = np.ones(len(points), bool)
    ends = np.cumsum(lengths)
    edge[ends - 1] = False
    edge[ends - lengths] = False
    key, owner = [points[edge] + np.uint64(1 << 40)], [word[edge]]
    two = word[1:] == word[:-1]
    pair = points[:-1] * np.uint64(0x1000003) + points[1:]
    key.append(pair[two] + np.uint64(1 << 41))
    owner.append(word[:-1][two])
    three = word[2:] == word[:-2]
    key.append((pair[:-1] * np.uint64(0x1000003) + points[2:])[three] + np.uint64(1 << 42))
    owner.append(word[:-2][three])
    mixed = np.concatenate(key) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int32), np.concatenate(owner)


def gram_store() -> WordStore:
    """Each word's buckets."""

    def learn(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, owner = grams(words)
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    return WordStore(learn)


def flattened(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """The words of all texts one after the other, and their number per text."""
    split = [words_of(t) for t in texts]
    return [w for words in split for w in words], np.fromiter(map(len, split), np.int64, len(split))


@dataclass(frozen=True)
class Model:
    languages: list[str]
    weights: np.ndarray  # buckets x languages, inverse document frequency included
    bias: np.ndarray
    temperature: float


def document_frequencies(df: DataFrame, text_col: str = "text") -> tuple[int, np.ndarray]:
    """Number of documents with a letter, and in how many each bucket occurs."""

    small_batches(df)

    def run(batches):
        total = np.zeros(BUCKETS + 1, np.int64)
        store = gram_store()
        for batch in batches:
            for part in slices(batch, TEXTS):
                words, counts = flattened(texts_of(part, text_col))
                for places in np.split(store.places(words), np.cumsum(counts)[:-1]):
                    if len(places):
                        total[:BUCKETS] += np.bincount(store.gather(np.unique(places))[0], minlength=BUCKETS) > 0
                        total[BUCKETS] += 1
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    rows = df.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS + 1, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return int(out[BUCKETS]), out[:BUCKETS]


def ftrl(x: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 4, batch: int = 32, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Weights (buckets x classes) and bias of a multinomial regression; x: each row's buckets and values."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def solved(rows: np.ndarray) -> np.ndarray:
        zz, nn = z[rows], n[rows]
        return np.where(np.abs(zz) <= l1, 0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(nn)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            used = np.unique(np.concatenate([x[i][0] for i in part] + [np.array([BUCKETS])]))
            dense = np.zeros((len(part), len(used)))
            for r, i in enumerate(part):
                dense[r, np.searchsorted(used, x[i][0])] = x[i][1]
            dense[:, -1] = 1
            w = solved(used)
            logits = dense @ w
            p = np.exp(logits - logits.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(part)), y[part]] -= 1
            g = dense.T @ p / len(part)
            sigma = (np.sqrt(n[used] + g * g) - np.sqrt(n[used])) / alpha
            z[used] += g - sigma * w
            n[used] += g * g
    w = solved(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the smallest log-loss, by golden-section search over its logarithm. Targets are
    smoothed by one row, so that a sample without errors doesn't make every score 1."""
    if not len(y) or logits.shape[1] < 2:
        return 1.0
    target = np.full(logits.shape, 1 / (len(y) + 2) / (logits.shape[1] - 1))
    target[np.arange(len(y)), y] = 1 - 1 / (len(y) + 2)

    def loss(log_t: float) -> float:
        s = logits / np.exp(log_t)
        s = s - s.max(1, keepdims=True)
        return float(-(target * (s - np.log(np.exp(s).sum(1))[:, None])).sum(1).mean())

    a, b = np.log(0.05), np.log(20.0)
    for _ in range(40):
        c, d = b - (b - a) * 0.618, a + (b - a) * 0.618
        a, b = (a, d) if loss(c) <= loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def fit(df: DataFrame, key: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS_PER_LANGUAGE) -> Model:
    """Learns from df's rows with a language: document frequencies from all, weights from about `rows` per language."""
    df = df.select(F.col(key).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l")).where("l IS NOT NULL")
    sizes = {r["l"]: r["n"] for r in df.groupBy("l").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    languages = sorted(sizes)
    docs, seen = document_frequencies(df, "t")
    idf = np.log((1 + docs) / (1 + seen)) + 1
    bucket = F.pmod(F.xxhash64("k"), F.lit(1 << 30))
    share = F.element_at(F.create_map(*(x for name in languages for x in (F.lit(name), F.lit(min(1.0, rows / sizes[name]))))), F.col("l"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        store, ids, counts = gram_store(), [], []
        words, lengths = flattened(texts_of(batch, "t"))
        for places in np.split(store.places(words), np.cumsum(lengths)[:-1]):
            x, n = np.unique(store.gather(places)[0], return_counts=True)
            ids.append(x.astype("<i4").tobytes())
            counts.append(n.astype("<i4").tobytes())
        return pa.RecordBatch.from_arrays([batch.column("l"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["l", "ids", "counts"])

    sample = map_slices(df.where(bucket < share * (1 << 30)), run, T._parse_datatype_string("l string, ids binary, counts binary"), rows=TEXTS).toArrow().to_pylist()
    sample = sorted((r for r in sample if r["ids"]), key=lambda r: (r["ids"], r["counts"], r["l"]))
    if not sample:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    y = np.array([languages.index(r["l"]) for r in sample])
    x = []
    for r in sample:
        ids, counts = np.frombuffer(r["ids"], "<i4"), np.frombuffer(r["counts"], "<i4")
        x.append((ids, SCALE * counts / counts.sum() * idf[ids]))
    held = np.random.default_rng(11).random(len(x)) < 0.2
    train, check = np.flatnonzero(~held), np.flatnonzero(held)
    if not len(train):
        train, check = check, train
    weights, bias = ftrl([x[i] for i in train], y[train], len(languages))
    logits = np.array([x[i][1] @ weights[x[i][0]] + bias for i in check]).reshape(-1, len(languages))
    return Model(languages, weights * idf[:, None] * SCALE, bias, calibrate(logits, y[check]))


class Scorer:
    """Logits of texts. The store holds, of each word, the sums of its n-grams' weights and their number."""

    def __init__(self, model: Model):
        self.model, self.width = model, len(model.languages) + 1
        self.store = WordStore(self._learn, dtype=np.float64)

    def _learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, owner = grams(words)
        sums = [np.bincount(owner, self.model.weights[ids, k], len(words)) for k in range(self.width - 1)]
        return np.stack([*sums, np.bincount(owner, minlength=len(words))], 1).ravel(), np.full(len(words), self.width, np.int64)

    def logits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each text its logits, and whether it has a word."""
        words, counts = flattened(texts)
        out, some = np.zeros((len(texts), self.width - 1)), counts > 0
        if some.any():
            places = self.store.places(words)
            rows = self.store.flat.reshape(-1, self.width)[places]
            total = np.add.reduceat(rows, (np.cumsum(counts) - counts)[some])
            out[some] = total[:, :-1] / total[:, -1:] + self.model.bias
        return out, some


def predict(df: DataFrame, model: Model, text_col: str = "text", out_col: str = "lang_pred", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """df with out_col and score_col, the calibrated probability of the predicted language."""
    passed = kept_fields(df, keep, [out_col, score_col])
    shared = Shared(df.sparkSession, model)
    schema = T.StructType([*(df.schema[c] for c in passed), T.StructField(out_col, T.StringType(), False), T.StructField(score_col, T.DoubleType(), False)])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        scorer: Scorer = per_process("language scorer", shared.id, lambda: Scorer(shared.value))
        known = scorer.model.languages
        if known:
            s, some = scorer.logits(texts_of(batch, text_col))
            s = s / scorer.model.temperature
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            names = [known[k] if has else UNKNOWN for has, k in zip(some.tolist(), p.argmax(1).tolist(), strict=True)]
            scores = np.where(some, p.max(1), 0.0)
        else:
            names, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in passed), pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*passed, out_col, score_col])

    needed = [*passed, *([] if text_col in passed else [text_col])]
    return map_slices(df.select(*needed), run, schema, rows=TEXTS)
