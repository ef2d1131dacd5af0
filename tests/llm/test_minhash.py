import random
import re

from riskloom.llm import minhash as m


def brute(rows, size=5, percent=75):
    """component of each id, from all pairs of sets."""
    sets = {}
    for i, t in rows:
        words = [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w]
        run = min(size, len(words))
        sets[i] = {tuple(words[k : k + run]) for k in range(len(words) - run + 1)} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            shared = len(sets[a] & sets[b])
            if a < b and shared and 100 * shared >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    rows, n = [], 0
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([1, 3, 5, 8, 40, 90]))]
        for _ in range(rng.randint(1, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(copy) // 30))):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            rows.append((n, " ".join(copy)))
            n += 1
    passage = " ".join(rng.choice(words) for _ in range(60))
    for _ in range(30):  # a passage that many share, below and around the threshold
        rows.append((n, passage + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 40)))))
        n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, "Word " * 20000), (n + 4, "word\u000bword word  WORD word word")]


def test_components_equal_brute_force(spark, monkeypatch):
    for seed, block in ((1, 256), (2, 4)):
        monkeypatch.setattr(m, "BLOCK", block)
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string")
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(df, keep=["doc_id"]).collect()}
        assert got == brute(rows)


def test_repeated_rows_other_columns_and_empty_tables(spark):
    rows = [(7, "a b c d e f g", "p"), (7, "a b c d e f g", "p"), (9, "A b c d e f g", None), (None, "a b c d e f g", "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, Kept string")
    got = sorted(((r.doc_id, r.text, r.component_id, r.kept) for r in m.near_duplicates(df).collect()), key=str)
    assert got == sorted([(7, rows[0][1], 7, True), (7, rows[0][1], 7, True), (9, rows[2][1], 7, False), (None, rows[3][1], None, True)], key=str)
    bare = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(df, keep=["doc_id"]).collect()), key=str)
    assert bare == sorted([(7, 3, 7, True), (7, 3, 7, True), (9, 3, 7, False), (None, 0, None, True)], key=str)
    assert m.near_duplicates(df.limit(0)).count() == 0 and m.near_duplicates(df.limit(0), keep=["doc_id"]).count() == 0


def test_an_id_with_two_texts_has_the_links_of_both(spark):
    one, two = "a b c d e f g h", "q r s t u v w x y"
    rows = [(5, one), (5, two), (3, one), (8, two), (9, two), (4, "lone words"), (2, None), (2, "")]
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), keep=["doc_id"]).collect()}
    assert got == {(5, 5, 3, False), (3, 4, 3, True), (8, 5, 3, False), (9, 5, 3, False), (4, 1, 4, True), (2, 0, 2, True)}
