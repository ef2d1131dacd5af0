"""Chat formatting with typed content parts, in DataFrame expressions only.

A turn's content is an array of parts: text, image, audio or document. A visitor flattens the
parts in order: text is escaped, any other part becomes a placeholder numbered through the
conversation, and its reference and expanded token count are recorded. The template is

    ### <role>: <content></turn>\\n

per turn. Texts and roles are escaped so that no control string can occur in them, and the
escape can be undone: a backslash becomes \\b, # becomes \\h, < becomes \\l and, in roles, : becomes \\c.

Defined results: null text and null roles are empty; a null or unknown part type is taken as
text when it has text and as a file otherwise; turns are ordered by turn (null first), then role and
content, so repeated rows stay as turns of their own; an empty table gives no conversations.
A conversation is one row of the result, so it has to fit into one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: Tokens that an attachment expands to: a fixed part and a part per unit (tile, second, page).
EXPANSION = {"image": (85, 170), "audio": (0, 25), "document": (0, 600)}
PART_TYPE = "array<struct<type:string,text:string,ref:string,units:long>>"


def escape(text: Column) -> Column:
    for raw, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(raw), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for raw, code in (("#", "\\h"), ("<", "\\l"), (":", "\\c"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(raw))
    return text


def text_part(text: Column) -> Column:
    """A content of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("units"))).cast(PART_TYPE)


def _kind(part: Column) -> Column:
    return F.when(part["type"].isin(*EXPANSION), part["type"]).when((part["type"] == "text") | part["text"].isNotNull(), "text").otherwise("file")


def _tokens(part: Column) -> Column:
    out = F.lit(0).cast("long")
    for kind, (fixed, unit) in EXPANSION.items():
        out = F.when(part["type"] == kind, F.lit(fixed) + F.lit(unit) * F.coalesce(part["units"], F.lit(1))).otherwise(out)
    return out.cast("long")


def format_conversations(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", content: str = "content", train_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: key, formatted string, loss_spans array<struct<start,stop>> (code points of
    formatted, from 0), attachments array<struct<index,type,ref,tokens>> and attachment_tokens long."""
    rows = df.select(F.col(key).alias("k"), F.col(turn).alias("t"), F.coalesce(F.col(role), F.lit("")).alias("r"), F.coalesce(F.col(content).cast(PART_TYPE), F.array().cast(PART_TYPE)).alias("parts"))
    attached = F.filter("parts", lambda p: _kind(p) != "text")
    order = Window.partitionBy("k").orderBy(F.col("t").asc_nulls_first(), "r", "parts")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("prior", F.coalesce(F.sum(F.size(attached)).over(before), F.lit(0)).cast("long"))
    rank = lambda i: F.size(F.filter(F.slice("parts", 1, i + 1), lambda q: _kind(q) != "text"))
    flat = F.transform("parts", lambda p, i: F.when(_kind(p) == "text", escape(F.coalesce(p["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), _kind(p), F.lit(":"), (F.col("prior") + rank(i)).cast("string"), F.lit(">"))))
    rows = (
        rows.withColumn("head", F.concat(F.lit(OPEN), F.replace(escape(F.col("r")), F.lit(":"), F.lit("\\c")), F.lit(COLON)))
        .withColumn("body", F.array_join(flat, ""))
        .withColumn("found", F.transform(attached, lambda p, i: F.struct((F.col("prior") + i + 1).alias("index"), _kind(p).alias("type"), p["ref"].alias("ref"), _tokens(p).alias("tokens"))))
        .withColumn("size", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
        .withColumn("at", F.coalesce(F.sum("size").over(before), F.lit(0)) + F.length("head"))
    )
    item = F.struct("n", F.concat("head", "body", F.lit(CLOSE)).alias("segment"), F.when(F.col("r").isin(*train_roles), F.struct(F.col("at").cast("long").alias("start"), (F.col("at") + F.length("body")).cast("long").alias("stop"))).alias("span"), "found")
    whole = rows.groupBy("k").agg(F.array_sort(F.collect_list(item)).alias("x"))
    found = F.flatten(F.col("x.found"))
    return whole.select(
        F.col("k").alias(key),
        F.array_join("x.segment", "").alias("formatted"),
        F.filter("x.span", lambda s: s.isNotNull()).alias("loss_spans"),
        found.alias("attachments"),
        F.aggregate(F.transform(found, lambda a: a["tokens"]), F.lit(0).cast("long"), lambda s, x: s + x).alias("attachment_tokens"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role,text>>: the turns of a formatted conversation."""
    cut = F.split(formatted, CLOSE, -1)
    piece = F.slice(cut, F.lit(1), F.size(cut) - 1)
    at = lambda p: F.locate(COLON, p)
    return F.transform(piece, lambda p: F.struct(unescape(F.substring(p, F.lit(len(OPEN) + 1), at(p) - len(OPEN) - 1)).alias("role"), unescape(F.substring(p, at(p) + len(COLON), F.length(p))).alias("text")))


def loss_text(formatted: Column, spans: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
