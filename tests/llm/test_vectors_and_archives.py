import base64
import gzip
import hashlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from riskloom.llm import projections, topk, warc
from riskloom.llm.queries import op3_warc


def vectors(spark, n=400, d=16, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(0, 1, (n // 4, d))
    x = np.repeat(base, 4, 0) + rng.normal(0, 0.12, (n, d)) * (rng.random((n, 1)) < 0.7)
    rows = [(i, [float(v) for v in x[i]], int(i // 4 % 3), "q") for i in range(n)]
    rows += [(n, None, 1, "q"), (n + 1, [1.0, None] + [0.0] * (d - 2), 1, "q"), (n + 2, [float("nan")] * d, 1, "q"), (n + 3, [0.0] * d, 1, "q"), (n + 4, rows[0][1], None, "q"), (n + 5, [], 1, "q"), (n + 6, [1.0] * 3, 1, "q"), (3, rows[3][1], rows[3][2], "q"), (n + 7, rows[0][1], 0, None)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, Score string")


def brute_top(rows, k):
    ok = [(i, np.floor(64 * np.array(v)).astype(int)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for place, (q, w) in enumerate(ok):
        if q % 20 == 0:
            best = sorted((-int(w @ v), i) for other, (i, v) in enumerate(ok) if other != place and len(v) == len(w))[:k]
            want += [(q, n, i, -s) for n, (s, i) in enumerate(best, 1)]
    return sorted(want)


def test_top_k_equals_brute_force(spark, monkeypatch):
    rows, df = vectors(spark)
    rows += [(0, rows[0][1], 1, "q"), (20, rows[40][1], 1, "q"), (20, rows[20][1], 1, "q"), (None, rows[0][1], 1, "q"), (7, rows[0][1], 1, "q")]
    df = spark.createDataFrame(rows, df.schema).withColumn("RANK", F.lit("clash"))
    for block, run, group in ((1024, 8, 32), (50, 2, 1)):
        monkeypatch.setattr(topk, "BLOCK", block)
        monkeypatch.setattr(topk, "BATCH", 8)
        monkeypatch.setattr(topk, "RUN", run)
        monkeypatch.setattr(topk, "GROUP", group)
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") % 20 == 0, k=7).collect())
        assert got == brute_top(rows, 7)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_top_k_of_rows_that_repeat_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.9, 0.1]), (1, [0.8, 0.0]), (2, [0.7, 0.0]), (3, [0.6, 0.0])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, k=3).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute_top(rows, 3)


def test_projections_find_the_links(spark, monkeypatch):
    rows, df = vectors(spark)
    good = [(i, np.array(v), y) for i, v, y, _ in rows if v and y is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, *_ in rows}, {i: i for i, *_ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    total = 0
    for a in range(len(good)):
        for b in range(a + 1, len(good)):
            (i, x, y), (j, z, w) = good[a], good[b]
            if y == w and len(x) == len(z) and x @ z / np.sqrt((x @ x) * (z @ z)) >= 0.93:
                links[i] += 1
                links[j] += i != j
                total += 1
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
    for block in (2048, 40):
        monkeypatch.setattr(projections, "BLOCK", block)
        got = projections.near_duplicates(df, keep=["vec_id"]).collect()
        assert len(got) == len(rows)
        assert sum(r.n_links for r in got if r.vec_id != 3) >= 0.98 * sum(v for k, v in links.items() if k != 3)
        assert all(r.n_links <= links[r.vec_id] + (r.vec_id == 3) for r in got)
        assert np.mean([r.component_id == find(r.vec_id) and r.kept == (r.vec_id == r.component_id) for r in got]) > 0.98
    assert projections.near_duplicates(df.limit(0)).count() == 0
    exact = {r.vec_id: r.n_links for r in projections.near_duplicates(df, threshold=1.0, keep=["vec_id"]).collect()}
    assert exact[400 + 4] == 0 and exact[400 + 7] >= 1


def test_collisions_equal_counts_over_all_pairs():
    rng = np.random.default_rng(3)
    left, right = rng.normal(0, 1, (70, projections.M)).astype("f4"), rng.normal(0, 1, (90, projections.M)).astype("f4")
    right[:30] = left[:30] + rng.normal(0, 0.2, (30, projections.M)).astype("f4")
    distance, least = projections.least_count(0.93)
    counts = (np.abs(left[:, None, :].astype(float) - right[None].astype(float)) <= projections.WINDOW * distance).sum(2)
    got = {(i, int(j)) for i, js in projections.collisions(left, right, 0.93) for j in js}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(counts >= least)), strict=True)) and len(got) >= 25


def test_forest_spans_the_links():
    rng = np.random.default_rng(8)
    for _ in range(20):
        edges = np.unique(rng.integers(0, 30, (25, 2)), axis=0)

        def parts(pairs):
            root = list(range(30))
            for x, y in pairs:
                p, q = root[x], root[y]
                root = [p if r == q else r for r in root]
            return [root.index(r) for r in root], len(set(root))

        tree = projections.forest(edges[:, 0], edges[:, 1])
        assert parts(tree) == parts(edges.tolist()) and len(tree) == 30 - parts(tree)[1]
    assert projections.forest(np.zeros(0, int), np.zeros(0, int)) == []


def test_warc_pages(spark, tmp_path):
    pages = [(5, "http://a", "same"), (2, "http://b", "same"), (9, None, None), (4, "u\r\nv", ""), (7, "http://c", "WARC/1.1\r\n\r\nx\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\n"), (8, "http://d", "é" * 50000), (2, "http://b", "same"), (None, "http://e", "lone")]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("Digest", F.lit("x")).write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in op3_warc(spark, str(tmp_path)).collect()}
    first = {}
    for i, _, html in pages:
        first[html or ""] = min([x for x in (i, first.get(html or "")) if x is not None], default=None)
    want = set()
    for i, _, html in pages:
        data, lead = (html or "").encode(), first[html or ""]
        want.add((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if i == lead else "revisit", None if i == lead else lead))
    assert got == want


def test_foreign_archives(spark, tmp_path):
    rec = lambda kind, rid, extra, block: (f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {rid}\r\n{extra}Content-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n").encode() + block + b"\r\n\r\n"
    data = [rec("warcinfo", "<i>", "", b"x"), rec("request", "<q>", "", b"GET /\r\n\r\n"), rec("response", "<r>", "WARC-Concurrent-To: <q>\r\n", b"HTTP/1.1 200\r\n\r\n\x00\xff"), rec("response", "<s>", "", b"HTTP/1.1 200\r\n\r\n")]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(x) for x in data))
    got = {r.capture_id: r for r in warc.assemble(warc.read_records(spark, str(tmp_path))).collect()}
    assert set(got) == {"<r>", "<s>"} and got["<r>"].request.record_id == "<q>" and bytes(got["<r>"].payload) == b"\x00\xff"
    assert got["<s>"].request is None and got["<s>"].metadata is None


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = [(10**6 + k, t, "en", "x", 1) for k, t in enumerate(["12345 !!", None])]
    docs = docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(docs.limit(3))
    sizes = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, sf).toPandas(), docs.schema)
        sizes.append(docs.count())
    ids = [r.doc_id for r in docs.collect()]
    assert len(ids) == len(set(ids)) and not {10**6, 10**6 + 1} & set(ids)
    assert sizes[0] >= sizes[1] >= sizes[2] > sizes[3] > 0.6 * sizes[0]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).toPandas()
    assert set(packed.doc_id) == set(ids) and packed.groupby("sequence_id").length.sum().max() <= 2048
