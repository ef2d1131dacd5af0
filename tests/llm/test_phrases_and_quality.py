"""Collocations, divergence, ranking and quality rules against brute force."""

import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import comb

import ahocorasick
import numpy as np
import pytest
from pyspark.sql import functions as F

from riskloom.llm import collocations, divergence, quality_rules, ranking, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string"


def plain_collocations(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if a >= least and len(p) > 1}
        inside = Counter()
        for p, a in found.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    inside[p[i : i + k]] = max(inside[p[i : i + k]], a)
        ranked = []
        for p, a in found.items():
            if 100 * inside[p] >= 80 * a:
                continue
            score, _, l, r = min((2000000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            ranked.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(ranked)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def phrase_rows(seed):
    rng = random.Random(seed)
    some = ["new", "york", "City", "of", "the", "Éa", "x\x00y", "a b", "ß", "the"]
    rows = []
    for i in range(300):
        parts = [rng.choice([" ", "  ", "\t", ", ", ".", "\n", " \r\n "]).join(["", rng.choice(some)]) for _ in range(rng.randint(0, 40))]
        text = "".join(parts) + rng.choice(["", " new york city hall", " of the the of the the"])
        rows.append((i, text, rng.choice(["en", "de", None, ""]), "s"))
    return rows + [(3, "new york", "en", None), (None, None, None, None), (900, "", "fr", "s"), (901, "new york " * 3000, "en", "s"), (902, "new york." * 2000, "xx", "s"), (903, "new york", "und", "s")]


def test_collocations_equal_brute_force(spark):
    rows = phrase_rows(1)
    df = spark.createDataFrame(rows, DOCS).withColumn("phrase", F.lit("clash")).withColumn("N", F.lit(1)).repartition(3)
    got = sorted(map(tuple, collocations.collocations(df, least=5, top=40, cells=1 << 16).collect()))
    assert got == plain_collocations(rows, 5, 40) and len(got) > 60


def test_a_crowded_sketch_gives_the_same_counts(spark, monkeypatch):
    """All phrases share 8 cells' worth of bits, or shards are a few bytes long: more is counted in vain, nothing else changes."""
    rows = phrase_rows(2)
    df = spark.createDataFrame(rows, DOCS).select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    full = np.full((1 << 16) // 8, 255, np.uint8)
    count = lambda bits: {(r.lang, r.phrase): r.f for r in collocations.phrase_counts(df, bits, 1 << 16, 5).collect()}
    assert count(full) == count(collocations.sketch(df, 1 << 16, 5))


def test_shards_cut_long_texts_between_pieces():
    text = b"ab cd. " * 1_200_000
    cuts = list(collocations._cuts(text))
    assert len(cuts) == 2 + (len(text) > 2 * collocations.SHARD_BYTES) and b"".join(cuts) == text.translate(collocations._TABLE) and all(c.startswith(b"\n") for c in cuts[1:])
    assert list(collocations._cuts(b"x" * 5_000_000)) == [b"x" * 5_000_000]


def test_guards_keep_words_and_pieces_apart():
    w = words.split_words([b"red hat, hat red hats", b"hat"], collocations._TABLE)
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, p in enumerate(["red hat", "hat", "hat hat"]):
        automaton.add_word(f" {p} ", k)
    automaton.make_automaton()
    assert Counter(k for _, k in automaton.iter(collocations.guarded(w))) == {0: 1, 1: 3}


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    assert collocations.collocations(df, cells=1 << 16).collect() == [] and divergence.divergence(df).collect() == []
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality_rules.judge(df, labels).collect() == []


def plain_divergence(rows, min_docs, top):
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = []
    share = lambda c, n, v: 1 + 1000000000 * (c + 1) // (n + v)
    gap = lambda p, q: (p - q) * (p - q) // q
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        own = lambda s: {t: share(count[lang, s][t], sum(count[lang, s][x] for x in kept), len(kept)) for t in kept}
        p = own(source)
        pairs = []
        for other in {s for g, s in groups if g == lang and s != source}:
            q = own(other)
            pairs.append((-sum(gap(p[t], q[t]) for t in kept), other.encode()))
        whole = Counter()
        for g, s in groups:
            if g == lang:
                whole.update({t: count[g, s][t] for t in kept})
        total = sum(whole.values())
        terms = [(-gap(p[t], share(whole[t], total, len(kept))), t.encode()) for t in kept if count[lang, source][t] and p[t] > share(whole[t], total, len(kept))]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            out += [(lang, source, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(sorted(found)[:most], 1)]
    return sorted(out)


@pytest.mark.parametrize("square", [256, 2])
def test_divergence_equals_brute_force(spark, square):
    rng = random.Random(5)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(70)] + ["É", "éa", "ÀB", "ß"]
    rows = [(i, " ".join(rng.choice(vocabulary[: rng.choice([8, 74])]) + rng.choice(["", ".", "1", "'x"]) for _ in range(rng.randint(0, 50))), rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", "S1", "é", None])) for i in range(250)]
    rows += [(1, "wa " * 400, "en", "s1"), (None, None, "en", "empty"), (7, "12 !", "zz", "a"), (8, "", "zz", "b"), (9, "only once", "yy", None)]
    df = spark.createDataFrame(rows, DOCS).withColumn("term", F.lit("clash")).withColumn("N", F.lit(2)).repartition(3)
    got = sorted(map(tuple, divergence.divergence(df, top=9, square=square).collect()))
    assert got == plain_divergence(rows, 3, 9) and {r[2] for r in got} == {"pair", "term"}


def test_shares_are_exact_for_large_counts(spark):
    cases = [(0, 1), (0, 7), (6, 7), (10**14, 3 * 10**14 + 7), (123456789012, 999999999999), (5 * 10**15, 5 * 10**15 + 1)]
    df = spark.createDataFrame(cases, "c long, t long").select("c", "t", divergence.share(F.col("c"), F.col("t")).alias("p"))
    assert all(r.p == 1 + 10**9 * (r.c + 1) // r.t for r in df.collect())


@pytest.mark.parametrize("settled", [1, 3, 50])
def test_top_per_group_equals_sorting(spark, settled):
    rng = random.Random(settled)
    rows = [(rng.choice(["a", "b", None]), rng.choice([0, 1, 7, 2**40, 2**62, rng.randint(0, 10**6)]), rng.randint(0, 3), f"{'common stem ' * rng.randint(0, 2)}{i % 40}é{i}") for i in range(400)]
    rows += [("tie", 5, 5, "x" * k) for k in range(1, 60)] + [("few", 1, 1, "one")]
    df = spark.createDataFrame(rows, "g string, v long, w long, t string").cache()
    got = sorted(((r.g or ""), r["rank"], r.v, r.w, r.t) for r in ranking.top_per_group(df, ["g"], ["v", "w"], "t", 20, settled=settled).collect())
    want = []
    for g in {r[0] for r in rows}:
        best = sorted((-v, -w, t.encode()) for h, v, w, t in rows if h == g)[:20]
        want += [(g or "", k, -v, -w, t.decode()) for k, (v, w, t) in enumerate(best, 1)]
    assert got == sorted(want)


def plain_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit), len(set(w)))


def test_quality_counts_equal_brute_force(spark):
    rng = random.Random(8)
    alphabet = ["a", "b", "é", "#*", "a|b", "\x85", " ", "日本"]
    texts = ["".join(rng.choice(alphabet) + rng.choice([" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b"]) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts += [None, "", " \n ", "a a a", "a a a a", "x y z x y z", "same\nsame\nsame \n\n", "w " * 50_000, "#" * 1000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, "a"), (None, "b")], "doc_id long, text string").withColumn("N_WORDS", F.lit("clash")).repartition(3)
    got = Counter((r.doc_id, *(r[c] for c in quality_rules.COUNTS)) for r in quality_rules.measure(df, keep=["doc_id"]).collect())
    assert got == Counter((i, *plain_counts(t)) for i, t in [*enumerate(texts), (0, "a"), (None, "b")])


def test_binomial_bounds_are_exact():
    for n, p in ((1, 0.3), (17, 0.01), (60, 0.5), (400, 0.02)):
        q = Fraction(p)
        exact, total = [], Fraction(0)
        for k in range(n + 1):
            total += comb(n, k) * q**k * (1 - q) ** (n - k)
            exact.append(float(total))
        assert [quality_rules.binomial_cdf(k, n, p) for k in range(n + 1)] == pytest.approx(exact, rel=1e-9, abs=1e-13)
    assert 0.49 < quality_rules.binomial_cdf(10**8, 10**10, 0.01) < 0.51 and quality_rules.binomial_cdf(-1, 5, 0.1) == 0


def plain_cutoffs(held, names, alpha, delta, cost):
    """held: (stratum, good, levels)."""
    strata = {s for s, *_ in held}
    risk, error = Fraction(alpha) / len(names), Fraction(delta) / (len(names) * len(strata))
    out = {}
    for stratum in strata:
        left = [(good, levels) for s, good, levels in held if s == stratum]
        every = list(left)
        n = sum(good for good, _ in every)
        for k, name in enumerate(names):
            best, worth = None, 0
            for cutoff in range(quality_rules.LEVELS, 0, -1):
                lost = sum(good for good, levels in every if levels[k] >= cutoff)
                if sum(comb(n, j) * risk**j * (1 - risk) ** (n - j) for j in range(lost + 1)) > error:
                    break
                gain = sum(-cost if good else 1 for good, levels in left if levels[k] >= cutoff)
                if gain > worth:
                    best, worth = cutoff, gain
            if best is not None:
                out[stratum, name] = best
                left = [x for x in left if x[1][k] < best]
    return out


def test_cutoffs_equal_brute_force(spark):
    rng = random.Random(4)
    names = list(quality_rules.rules())
    held = []
    for s, n in (("en", 300), ("de", 160), ("xx", 12)):
        for _ in range(n):
            good = int(rng.random() < 0.8)
            held.append((s, good, [min(64, max(0, int(rng.gauss(6 if good else 6 + 5 * k, 5)))) for k in range(len(names))]))
    df = spark.createDataFrame(held, "stratum string, good long, levels array<int>")
    got = {(r.stratum, r.rule): r.cutoff for r in quality_rules.cutoffs(df, 0.3, 0.2, 2).collect()}
    assert got == plain_cutoffs(held, names, 0.3, 0.2, 2) and len(got) > 2 and not any(s == "xx" for s, _ in got)


def test_false_rejections_stay_below_the_risk(spark):
    """Over many draws of labels the share of strata that may lose more than alpha of their good texts is at most delta."""
    rng = np.random.default_rng(2)
    n, alpha, delta = 400, 0.1, 0.2
    levels = []
    for s in range(120):
        for level, k in zip(*np.unique(rng.integers(0, 65, n), return_counts=True), strict=True):
            levels.append((f"s{s}", "symbols", int(level), int(k), int(k) * 50))
    got = quality_rules.certify(spark.createDataFrame(levels, "stratum string, rule string, level int, good long, bad long"), alpha, delta).collect()
    # a text is at level c or above with chance (65 - c) / 65
    assert sum((65 - (r.certified or 65)) / 65 > alpha for r in got) <= delta and any(r.certified for r in got)


def test_verdicts_follow_the_certified_rules(spark):
    rng = random.Random(6)
    common = [f"word{k}" for k in range(400)]
    clean = lambda: " ".join(rng.sample(common, 80))
    noisy = lambda: " ".join(w + "###" for w in rng.sample(common, 80))
    rows = [(i, noisy() if i % 4 == 0 else clean(), ("en", None)[i % 2 == 1 and i > 3000]) for i in range(4000)] + [(9000, noisy(), "en"), (9001, noisy(), "rare"), (9002, None, "en"), (9003, "too short", "en"), (None, noisy(), "en"), (9004, "a b c " * 40, "en")]
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(4000)] + [(5, 0), (None, 1), (7, None)], "doc_id long, quality int")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("KEPT", F.lit("clash"))
    out = quality_rules.judge(df, labels, keep=["doc_id"])
    assert out.columns == ["doc_id", *quality_rules.COUNTS, "base_failed", "failed_rules", "kept"]
    got = {r.doc_id: r for r in out.collect()}
    assert not got[9000].kept and got[9000].failed_rules == ["symbols"] and got[9001].kept and not got[None].kept
    assert all(got[k].base_failed and not got[k].kept for k in (9002, 9003, 9004))
    assert all(r.kept for k, r in got.items() if k is not None and k < 4000 and k % 4)
