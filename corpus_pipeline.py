"""The corpus pipeline: toxicity, language, near duplicates, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of documents. A text is toxic from a score of 0.3; the language stage rejects texts
without a letter and those whose language can't be told (a score under MIN_LANGUAGE_SCORE); of near
duplicates the document with the smallest doc_id stays, and of rows that repeat a doc_id one.

Defined results of every stage: an empty table gives an empty table; texts are read whole, however long; columns beside
those of documents pass through, also where they are named like an operator's own (in any case); only the last stage
adds columns. Nulls: see each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import bin_packing, langid, minhash, toxicity
from riskloom.llm.queries import TOXIC_FROM
from riskloom.session import materialize

MIN_LANGUAGE_SCORE = 0.4
#: Names that no column of the documents has.
PREDICTED, SCORE = "_pipeline_predicted", "_pipeline_score"


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text isn't toxic. Learns from labels joined by doc_id; rows without doc_id and rows that repeat one are
    scored like others; null and empty texts get the score of a text without known terms, so they stay where clean
    texts are the rule."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(_remainder(4) != 2)
    scored = toxicity.score(docs, toxicity.fit(docs, labels), out_col=SCORE)
    return scored.where(F.col(SCORE) < TOXIC_FROM).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose language can be told. Null and empty texts and those without a letter go; rows with null lang are
    predicted, not learnt from; without any row to learn from all go."""
    model = langid.fit(docs.where(_remainder(5) != 0))
    found = langid.predict(docs, model, out_col=PREDICTED, score_col=SCORE)
    return found.where((F.col(PREDICTED) != langid.UNKNOWN) & (F.col(SCORE) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the rows with the smallest doc_id, and of those one: the first by text, then by
    the other columns in their order, nulls first. Rows without doc_id take no part and stay, all of them; null and
    empty texts are no duplicates of others."""
    gone = minhash.near_duplicates(docs.select("doc_id", "text"), keep=["doc_id"]).where("NOT kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows")).where("_rows > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    row = F.struct("text", *(F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")))
    first = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(row).alias("_first"))
    first = first.select("doc_id", "_first.*").select(*docs.columns)
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).unionByName(first)


def pack_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows with their place in a sequence. A null text counts as empty; rows without doc_id and rows that
    repeat one are packed as rows of their own."""
    return bin_packing.pack(bin_packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [("toxicity", drop_toxic), ("language", drop_unknown_language), ("minhash", drop_near_duplicates), ("packing", pack_documents)]

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
