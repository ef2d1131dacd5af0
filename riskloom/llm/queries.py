"""The queries that apply the operators of this subpackage to whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bin_packing, chat, collocations, divergence, langid, licenses, minhash, projections, quality_rules, sentencepiece_codec, topk, toxicity, warc
from riskloom.session import materialize, shared_path

#: Texts with at least this score count as toxic.
TOXIC_FROM = 0.3


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(key: str, n: int):
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = sentencepiece_codec.load_pieces(public_tokenizers.path("piece_bpe_32k.model"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = sentencepiece_codec.encode(docs, table, keep=["doc_id"])
    decoded = sentencepiece_codec.decode(encoded, table, keep=["doc_id", "ids"])
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    cut = bin_packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))
    return bin_packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    warc.write_pages(_table(spark, sf_dir, "pages"), path)
    captures = warc.assemble(warc.read_records(spark, path))
    page = F.regexp_extract(F.col("metadata.payload").cast("string"), r"page_id: (-?\d+)", 1)
    c = captures.select(
        F.when(page != "", page.cast("long")).alias("page_id"),
        F.when(F.col("record_type") == "response", F.octet_length("payload")).otherwise(F.regexp_extract("http_header", r"(?i)content-length: (\d+)", 1).cast("long")).cast("long").alias("payload_bytes"),
        F.when(F.col("record_type") == "response", warc.sha1_base32(F.col("payload"))).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        "capture_id",
        F.col("refers_to").alias("target"),
    )
    # as a table, so that the join can split a response that many pages revisit
    c = materialize(c, "captures")
    first = c.where("record_type = 'response'").select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to"))
    return c.join(first, "target", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = F.filter("matches", lambda m: m["ordered"])
    joined = lambda xs: F.array_join(F.array_sort(F.array_distinct(F.transform(xs, lambda m: m["label"]))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["containment"])), F.lit(0.0)).alias("score"),
    )


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(_remainder("doc_id", 4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = r"\### Assistant: </turn> ok"
    extra = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', :probe), (-7L, 1L, 'assistant', :probe) AS t(conv_id, turn, role, text)", args={"probe": probe})
    rows = rows.unionByName(extra).select("conv_id", "turn", "role", chat.text_part(F.col("text")).alias("content"))
    out = chat.format_conversations(rows).select("conv_id", "formatted", "loss_spans")
    back = out.select("conv_id", chat.parse(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])


def op9_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.near_duplicates(_table(spark, sf_dir, "embeddings"), keep=["vec_id"])


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(_remainder("doc_id", 5) != 0))
    found = langid.predict(docs.select("doc_id", "text"), model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(_remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(_table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    judged = quality_rules.judge(docs, _table(spark, sf_dir, "labels"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


QUERIES = {"op1_sentencepiece": op1_sentencepiece, "op2_packing": op2_packing, "op3_warc": op3_warc, "op4_topk": op4_topk, "op5_licenses": op5_licenses, "op6_toxicity": op6_toxicity, "op7_chat": op7_chat, "op8_minhash": op8_minhash, "op9_projections": op9_projections, "op10_language": op10_language, "op11_collocations": op11_collocations, "op12_divergence": op12_divergence, "op13_quality": op13_quality}

_BASE32 = "translate(lpad(to_base(('0x' || substr(h, {at}, 10))::BIGINT, 32), 8, '0'), '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')"
ORACLE_SQL = {
    "op3_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT page_id, strlen(payload)::BIGINT AS payload_bytes, {" || ".join(_BASE32.format(at=1 + 10 * k) for k in range(4))} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_page FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_page THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_page THEN first_page END AS refers_to FROM d""",
    "op4_topk": """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op8_minhash": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept FROM documents d JOIN c USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op9_projections": """
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*)::BIGINT AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(n.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)""",
    "op7_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)),
e AS (SELECT *, length(text) + length(text) - length(replace(replace(replace(text, '\', ''), '#', ''), '<', '')) + length(role) + length(role) - length(replace(replace(replace(replace(role, '\', ''), '#', ''), '<', ''), ':', '')) + 14 AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op11_collocations": r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
words AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, 5)) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, phrase, k, count(*)::BIGINT AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, string_split(phrase, ' ') AS w, k AS size FROM f WHERE k > 1),
cuts AS (SELECT lang, phrase, a, w, size, unnest(range(1, size)) AS k FROM c),
s AS (SELECT cuts.lang, cuts.phrase, a, cuts.k, x.f AS l, y.f AS r, (2000000::HUGEINT * a // (x.f + y.f))::BIGINT AS score FROM cuts
  JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:cuts.k], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[cuts.k + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
i AS (SELECT lang, a, w, size, m, unnest(range(1, size - m + 2)) AS pos FROM c, (SELECT unnest(range(2, 4)) AS m) WHERE m < size),
h AS (SELECT lang, array_to_string(w[pos:pos + m - 1], ' ') AS phrase, max(a) AS most FROM i GROUP BY ALL),
k AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE coalesce(100::HUGEINT * most < 80::HUGEINT * a, true)),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM k)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r.r AS r, n, score FROM r JOIN words USING (lang) WHERE rank <= 2000""",
    "op12_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 3),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT g.lang, g.source, coalesce(sum(n), 0)::HUGEINT AS total FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 1) // (t.total + v.v) AS p, 1 + 1000000000::HUGEINT * (k.n + 1) // (v.total + v.v) AS q
  FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
terms AS (SELECT lang, source, term AS item, (p - q) * (p - q) // q AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL SELECT lang, source, 'term', item, value FROM terms),
r AS (SELECT lang, source, part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200""",
}
