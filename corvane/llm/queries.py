"""Queries of the training-text operators over the test tables, whole, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import materialise, table
from . import bpe, leakage, leximin, lookalikes, mojibake, nearcopies, replies, segments, subjects


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return replies.defects(table(spark, d, "rag_results")).select("result_id", "defect")


def p1_mix(spark: SparkSession, d: str) -> DataFrame:
    """How many replies have each defect, and on what evidence."""
    return replies.defects(table(spark, d, "rag_results")).groupBy("defect", "evidence").agg(F.count("*").alias("n"))


def _percentiles(spark: SparkSession, d: str) -> DataFrame:
    return leximin.percentiles(leximin.with_gold_ranks(table(spark, d, "candidates"), table(spark, d, "pool_failures")), "root_id", "chunk_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return leximin.heads(_percentiles(spark, d), "root_id", "chunk_id")


def p2_order(spark: SparkSession, d: str) -> DataFrame:
    return leximin.order(materialise(_percentiles(spark, d), "percentiles"), "root_id", "chunk_id")


def _families(spark: SparkSession, d: str) -> DataFrame:
    blocks = table(spark, d, "blocks").select("block_id", "doc_id", "text", "source")
    # One value of source for each doc_id; those of other rows take no part.
    first = lookalikes.smallest_of(blocks, "doc_id", "block_id", "source")
    values = blocks.select("block_id", "text").unionByName(first, allowMissingColumns=True)
    return lookalikes.families(lookalikes.hashed(lookalikes.forms(values, "block_id", ("text", "source")), "block_id", {"text": 8}))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.alike(_families(spark, d)).select(F.col("a").alias("block_a"), F.col("b").alias("block_b"), "field")


def p3_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same without pairs: each value that looks like another stored string, with the class of its form."""
    return _families(spark, d).select(F.col("k").alias("block_id"), "field", F.concat_ws("-", F.hex("h"), F.hex("f")).alias("class"))


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    return lookalikes.forms(table(spark, d, "blocks"), "block_id", ("text", "source")).filter("original <> form").select("block_id", "field", "form")


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return segments.split_oversized(table(spark, d, "blocks"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return segments.oversized(p4_pieces(spark, d))


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """Of each oversized text: whether its pieces cover it in order, each of at most 800 characters, overlapping by at most 150 and never nested."""
    p = p4_pieces(spark, d)
    w = Window.partitionBy("block_id").orderBy("piece")
    before = F.lag("stop").over(w)
    p = p.withColumn("joined", F.when(F.col("piece") == 0, F.col("start") == 0).otherwise((F.col("start") <= before) & (before - F.col("start") <= 150) & (F.col("stop") > before)))
    sound = p.groupBy("block_id").agg(F.max("stop").alias("n_chars"), F.every(F.col("joined") & (F.col("stop") - F.col("start") <= 800) & (F.length("text") == F.col("stop") - F.col("start"))).alias("sound"))
    return sound


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = nearcopies.near_copies(table(spark, d, "blocks"))
    return nearcopies.all_pairs(members, links, "block_id").select(F.col("a").alias("block_a"), F.col("b").alias("block_b"))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    """The same without pairs: blocks with a near copy, their class of equal texts, their group and number of links."""
    members, links = nearcopies.near_copies(table(spark, d, "blocks"))
    return nearcopies.groups(members, materialise(links, "verified"), "block_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "blocks")).select("block_id", "field")


def p6_restored(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.repaired(table(spark, d, "blocks"))


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return bpe.encode_corpus(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "golden_items"))


def p8_near(spark: SparkSession, d: str) -> DataFrame:
    """Runs of held-out items with up to two edits, decided by Myers' scan; p8_found are those without."""
    return leakage.near_leaks(table(spark, d, "documents"), table(spark, d, "golden_items"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return subjects.assign(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels")).select("doc_id", "subject")


def p9_composition(spark: SparkSession, d: str) -> DataFrame:
    found = subjects.assign(table(spark, d, "documents"), table(spark, d, "subject_areas"), table(spark, d, "subject_labels"))
    return found.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs"))


QUERIES = {f.__name__: f for f in (p1_found, p1_mix, p2_found, p2_order, p3_found, p3_groups, p3_forms, p4_found, p4_pieces, p4_check, p5_found, p5_groups, p6_found, p6_restored, p7_ids, p8_found, p8_near, p9_found, p9_composition)}

#: p4_found's definition and what must hold of the pieces in SQL; the others are tested against brute force.
SQL = {
    "p4_check": "SELECT block_id, CAST(length(text) AS INT) AS n_chars, true AS sound FROM blocks WHERE length(text) > 800",
    "p4_found": r"""
        WITH long AS (SELECT block_id, text, coalesce(lower(trim(style)) = 'table', false) AS tab FROM blocks WHERE length(text) > 800),
        cut AS (SELECT block_id, CASE WHEN tab THEN regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}])', '\1' || chr(1), 'g')
                ELSE regexp_replace(text, '(\r\n|[\n\r\x0b\x0c\x{85}\x{2028}\x{2029}。！？；!?;])', '\1' || chr(1), 'g') END AS t, tab FROM long),
        dots AS (SELECT block_id, CASE WHEN tab THEN t ELSE regexp_replace(t, '\.([\s\x{3000}\x{A0}])', '.' || chr(1) || '\1', 'g') END AS t FROM cut),
        parts AS (SELECT block_id, unnest(string_split(t, chr(1))) AS part FROM dots)
        SELECT block_id, CASE WHEN max(length(part)) <= 800 THEN 'natural' ELSE 'hard' END AS cut_kind FROM parts GROUP BY block_id
    """,
}
