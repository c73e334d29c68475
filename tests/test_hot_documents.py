"""Documents and groups spread over ranges give what one task gives."""

import random

from pyspark.sql import functions as F

from corvane import tables
from corvane.operators import structure


def test_running_over_ranges(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 2 else f"d{i % 7}", i, rng.randint(0, 1), rng.choice(["x", "y", None])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, i int, n int, v string")
    args = dict(sums=("n",), lasts=("v",), prev=("v", "n"), following=("n",))
    whole, spread = (sorted(map(tuple, tables.running(df, ["g"], ["i"], most=m, **args).collect())) for m in (1000, 60))
    assert whole == spread and len(whole) == 400
    assert tables.running(df.limit(0), ["g"], ["i"], **args).count() == 0


def test_islands_over_ranges(spark):
    rng = random.Random(5)
    df = spark.createDataFrame([("hot", i, rng.random() < 0.6) for i in range(300)], "g string, i int, f boolean")
    a, b = ({(r.i, r.island) for r in structure.islands(df, ["g"], ["i"], F.col("f"), most=m).collect()} for m in (1000, 50))
    assert a == b


def section(rng):
    kind = rng.randrange(7)
    return [
        ["气候区划" * rng.randint(60, 90) + "。"], ["短标题"], ["| a | b |", "| 1 | 2 |"], ["积温指标包括以下" + "内容" * rng.randint(1, 30) + "："],
        ["降水" * rng.randint(30, 60)], ["完整的句子。" * rng.randint(2, 12)], ["3 4", "5 6", "7"],
    ][kind]


def test_filter_is_the_same_without_cuts(spark, monkeypatch):
    rng = random.Random(6)
    rows = [("d", i, [f"h{i}"], section(rng)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id string, sec_ord long, heading_path array<string>, blocks array<string>")
    for mode in ("carry", "drop_both"):
        cut = sorted((r.sec_ord, tuple(r.blocks)) for r in structure.filter_sections(df, mode=mode, most=50).collect())
        monkeypatch.setattr(structure, "FULL", 10**9)
        whole = sorted((r.sec_ord, tuple(r.blocks)) for r in structure.filter_sections(df, mode=mode).collect())
        monkeypatch.undo()
        assert cut == whole and 20 < len(cut) < 240


def test_a_tenth_of_the_rows_in_one_document(spark):
    rows = [("hot" if i < 300 else f"d{i % 30}", i, i, f"第{i}章 标题" if i % 5 == 0 else f"正文{i}的句子。", None, None, None) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id string, seq long, block_id long, text string, style string, font_size double, is_title boolean")
    marked = structure.marked_blocks(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # tiny ranges would meet in one task again
    split = tables.running(df.select("doc_id", "seq", "block_id", F.lit(1).alias("one")), ["doc_id"], ["seq", "block_id"], sums=("one",), most=100)
    sizes = [n for n in split.filter("doc_id = 'hot'").select("sum_one").rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n]
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert max(sizes) < 300 and marked.count() == 600
    assert structure.sections(df).filter("doc_id = 'hot'").count() == 60
