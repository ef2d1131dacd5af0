"""The learned operators against plain Python."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import langid, toxicity
from riskloom.llm.common import Shared
from riskloom.llm.licenses import words_of


def plain_toxicity(model, text):
    terms = set()
    for w in set(words_of(text or "")):
        terms.add(zlib.crc32(w) % 2**toxicity.BITS)
        terms |= {zlib.crc32(b"\x00" + str(n).encode() + w[:n]) % 2**toxicity.BITS for n in (4, 5) if len(w) >= n}
    rows = [model.place[t] for t in terms if t in model.place]
    z = model.bias + sum(model.weights[r] for r in rows)
    z += sum(float(model.factors[a] @ model.factors[b]) for k, a in enumerate(rows) for b in rows[:k])
    return 1 / (1 + math.exp(-max(-30, min(30, z))))


def toxic_rows(seed, bad):
    rng = random.Random(seed)
    words = [f"plain{k}" for k in range(80)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(1, 60)) + ([rng.choice(bad)] if i % 5 == 0 else []))) for i in range(500)] + [(9001, None), (9002, ""), (9003, bad[0] + " é" * 5000), (3, "plain1")]


def test_toxicity_equals_a_plain_machine_also_with_two_models_in_a_session(spark):
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(500)], "doc_id long, toxic int")
    frames = [spark.createDataFrame(toxic_rows(k, bad), "doc_id long, text string").coalesce(2) for k, bad in enumerate((["vilest", "nastier"], ["grimmest", "vilely"]))]
    models = [toxicity.fit(df, labels) for df in frames]
    for turn in range(4):
        for df, model in zip(frames, models, strict=True):
            for other in frames:
                for r in toxicity.score(other, model).collect():
                    assert r.score == pytest.approx(plain_toxicity(model, r.text), rel=1e-9)


def test_shared_values_have_ids_of_their_own(spark):
    assert len({Shared(spark, k).id for k in range(40)}) == 40


def plain_grams(text):
    if not any(c.isalpha() for c in text):
        return []
    out = []
    for w in langid._WORDS.findall(text.lower()):
        padded = f" {w} "
        out += list(w) + [padded[k : k + 2] for k in range(len(padded) - 1)] + [padded[k : k + 3] for k in range(len(padded) - 2)]
    return out


def bucket(gram):
    key = 0
    for c in gram:
        key = (key * 0x1000003 + ord(c)) % 2**64 if key else ord(c)
    mixed = (key + (1 << (39 + len(gram)))) * 0x9E3779B97F4A7C15 % 2**64
    return mixed >> (64 - langid.BUCKETS.bit_length() + 1)


def language_rows(seed=2, n=400):
    rng = random.Random(seed)
    parts = {"aa": ["tha", "ing", "the"], "bb": ["eau", "oux", "ché"], "cc": ["sch", "ung", "ein"]}
    rows = [(i, " ".join("".join(rng.choices(parts[name], k=rng.randint(1, 4))) for _ in range(rng.randint(1, 30))), name) for i, name in enumerate(rng.choices(list(parts), k=n))]
    return rows + [(n, None, "aa"), (n + 1, "12 !?", "bb"), (n + 2, "", None), (7, "the thaing", None), (n + 3, "eauoux " * 9000, "bb")]


def test_language_frequencies_and_scores_equal_plain_python(spark, monkeypatch):
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    docs, seen = langid.document_frequencies(df)
    want = Counter(b for _, t, _ in rows for b in {bucket(g) for g in plain_grams(t or "")})
    assert docs == sum(bool(plain_grams(t or "")) for _, t, _ in rows)
    assert {int(b): int(seen[b]) for b in np.flatnonzero(seen)} == dict(want)
    model = langid.fit(df)
    other = langid.fit(df.where(F.col("lang") != "aa"))
    for m in (model, other, model):
        for r in langid.predict(df, m).collect():
            grams = plain_grams(r.text or "")
            if not grams:
                assert (r.lang_pred, r.score) == ("und", 0.0)
                continue
            counts = Counter(bucket(g) for g in grams)
            s = (sum(c * m.weights[b] for b, c in counts.items()) / len(grams) + m.bias) / m.temperature
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            assert r.lang_pred == m.languages[int(p.argmax())] and r.score == pytest.approx(p.max(), rel=1e-9)


def test_follow_the_regularised_leader_equals_plain_python():
    rng = np.random.default_rng(4)
    x = [(np.sort(rng.choice(50, 6, replace=False)), rng.random(6)) for _ in range(90)]
    y = rng.integers(0, 3, 90)
    alpha, beta, l1, l2, epochs, batch = 0.5, 1.0, 1e-3, 1e-3, 2, 8
    z, n = Counter(), Counter()

    def weight(k):
        if abs(z[k]) <= l1:
            return 0.0
        return -(z[k] - math.copysign(l1, z[k])) / ((beta + math.sqrt(n[k])) / alpha + l2)

    order_of = np.random.default_rng(5)
    for _ in range(epochs):
        order = order_of.permutation(len(x)).tolist()
        for at in range(0, len(order), batch):
            grads = Counter()
            part = order[at : at + batch]
            for i in part:
                terms = [*zip(x[i][0].tolist(), x[i][1].tolist(), strict=True), (langid.BUCKETS, 1.0)]
                logits = [sum(v * weight((b, c)) for b, v in terms) for c in range(3)]
                total = sum(math.exp(s) for s in logits)
                for c in range(3):
                    for b, v in terms:
                        grads[b, c] += (math.exp(logits[c]) / total - (y[i] == c)) * v / len(part)
            for k, g in grads.items():
                sigma = (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / alpha
                z[k] += g - sigma * weight(k)
                n[k] += g * g
    weights, bias = langid.ftrl(x, y, 3, alpha, beta, l1, l2, epochs, batch, seed=5)
    assert np.allclose(bias, [weight((langid.BUCKETS, c)) for c in range(3)])
    for b in range(50):
        assert np.allclose(weights[b], [weight((b, c)) for c in range(3)])
