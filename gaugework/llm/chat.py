"""Operator 8: chat formatting. A visitor flattens typed content parts (text, image, audio, document) into one body of text and ordered placeholders, and
records attachments and expanded token counts; turns are marked by a template, and a loss mask covers what the assistant says. Column expressions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugework.llm import base

# ---- fixed values: the marks of a turn, the placeholders, and what stands for their characters inside texts ----
OPEN, CLOSE = "<s>", "</s>"
PART_TYPES = ("text", "image", "audio", "document")
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("\n", "&nl;"))
#: Ids that an attachment expands to where its part doesn't say.
DEFAULT_TOKENS = {"image": 576, "audio": 750, "document": 1024}

PARTS = "array<struct<type: string, text: string, ref: string, n_tokens: long>>"


def escape(c: Column, line_feeds: bool = False) -> Column:
    """No `<` is left, so no mark can appear; unescape() gives the text back."""
    for plain, coded in ESCAPES[:3 if line_feeds else 2]:
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in ESCAPES[::-1]:
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def text_part(text: Column) -> Column:
    """One text part, for tables whose turns are plain text."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("long").alias("n_tokens"))).cast(PARTS)


def visit(part: Column) -> Column:
    """What a part becomes in the body: its escaped text, or a placeholder. Null texts are empty; parts of an unknown type count as documents."""
    kind = attachment_type(part)
    return F.when(part["type"] == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<"), kind, F.lit(">")))


def attachment_type(part: Column) -> Column:
    return F.when(part["type"].isin(*PART_TYPES[1:]), part["type"]).otherwise(F.lit("document"))


def expanded(part: Column) -> Column:
    default = reduce(lambda c, t: c.when(attachment_type(part) == t[0], t[1]), list(DEFAULT_TOKENS.items())[1:], F.when(attachment_type(part) == "image", DEFAULT_TOKENS["image"]))
    return F.when(part["type"] == "text", F.lit(0)).otherwise(F.coalesce(part["n_tokens"], default)).cast("long")


def format_chat(turns: DataFrame) -> DataFrame:
    """One row per conv_id of (conv_id, turn, role, parts): formatted, n_turns, loss_spans (array of start and end in formatted, code points, end exclusive),
    attachments (array of type, ref, turn position, part position, n_tokens, in order) and attachment_tokens.

    Turns are in the order of turn, then role, then body (so ties and repeated rows have one order, and all stay). A null role is empty, null parts are none, a
    null conv_id is a conversation of its own. The mask covers each body of the role `assistant`. Extra columns are left out. One shuffle, by conv_id: offsets come
    from a window, and the aggregation keeps that partitioning. A conversation is one string by nature, so its turns meet in one row."""
    body = F.array_join(F.transform(F.coalesce(F.col("parts"), F.array().cast(PARTS)), visit), "")
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), body.alias("body"), "parts")
    head = F.concat(F.lit(OPEN), escape(F.col("role"), line_feeds=True), F.lit("\n"))
    rows = rows.select("conv_id", "turn", "role", "body", "parts", F.concat(head, F.col("body"), F.lit(CLOSE)).alias("piece"), F.length(head).alias("head"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "body")
    so_far = F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumns({"pos": F.row_number().over(order), "at": so_far - F.length("piece") + F.col("head")})
    span = F.when((F.col("role") == "assistant"), F.struct(F.col("at").alias("start"), (F.col("at") + F.length("body")).alias("end")))
    attached = F.filter(
        F.transform("parts", lambda p, i: F.when(p["type"].isNull() | (p["type"] != "text"), F.struct(F.col("pos").alias("turn"), i.alias("part"), attachment_type(p).alias("type"), p["ref"].alias("ref"), expanded(p).alias("n_tokens")))),
        lambda p: p.isNotNull(),
    )
    item = F.struct("pos", "piece", span.alias("span"), attached.alias("attached"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(item)).alias("items"))
    out = grouped.select(
        "conv_id",
        F.array_join(F.transform("items", lambda x: x["piece"]), "").alias("formatted"),
        F.size("items").cast("long").alias("n_turns"),
        F.filter(F.transform("items", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
        F.flatten(F.filter(F.transform("items", lambda x: x["attached"]), lambda a: a.isNotNull())).alias("attachments"),
    )
    return out.withColumn("attachment_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["n_tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (array of role and text) and loss_text, from formatted and loss_spans alone; placeholders are left out of texts."""
    pieces = F.split("formatted", CLOSE, -1)
    told = F.transform(F.slice(pieces, F.lit(1), F.size(pieces) - 1), lambda p: F.substring(p, F.lit(len(OPEN) + 1), F.length(p)))
    plain = lambda c: unescape(F.regexp_replace(c, "<(?:image|audio|document)>", ""))
    turn = lambda p: F.struct(unescape(F.substring_index(p, "\n", 1)).alias("role"), plain(F.substring(p, F.instr(p, "\n") + 1, F.length(p))).alias("text"))
    masked = F.transform("loss_spans", lambda s: plain(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return formatted.select("conv_id", "formatted", F.transform(told, turn).alias("turns"), F.array_join(masked, "").alias("loss_text"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    turns = base.own_columns(base.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text").unionByName(extra)
    back = read_back(format_chat(turns.select("conv_id", "turn", "role", text_part(F.coalesce(F.col("text"), F.lit(""))).alias("parts"))))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        base.hex_digest(told).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        base.hex_digest(F.col("loss_text")).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS body, replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), chr(10), '&nl;') AS mark FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, body)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, body), '')) AS loss_sha256,
  CAST(sum(length(mark) + length(body) + 8) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
