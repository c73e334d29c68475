"""Relational and event queries over the star schema and the event table, and their SQL. Extensions beside retrieval."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .queries import query, table
from .streaming import events as stream
from .tables import below_counts, materialise


def r4(c):
    return F.round(c, 4)


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def pricing_summary(spark, d):
    t = table(spark, d, "lineitem").filter(F.col("l_shipdate") <= F.to_timestamp(F.lit("1998-09-02")))
    return t.groupBy("l_returnflag", "l_linestatus").agg(r4(F.sum("l_quantity")).alias("sum_qty"), F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("sum_disc"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("n"))


@query("""SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1""")
def local_suppliers(spark, d):
    c, o, li, s, n, r = (table(spark, d, t) for t in ("customer", "orders", "lineitem", "supplier", "nation", "region"))
    near = s.join(n, s.s_nationkey == n.n_nationkey).join(r.filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    j = c.join(o, c.c_custkey == o.o_custkey).join(li, F.col("l_orderkey") == F.col("o_orderkey")).join(near, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return j.groupBy("n_name").agg(F.round(F.sum(F.expr("l_extendedprice * (1 - l_discount)")), 2).alias("revenue"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
def semi_join(spark, d):
    li = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, d, "orders").join(li, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT c_mktsegment, count(*) AS n FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000) GROUP BY 1")
def anti_join(spark, d):
    o = table(spark, d, "orders").filter("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("q"))


@query("SELECT l_returnflag, true AS close FROM lineitem GROUP BY l_returnflag HAVING count(DISTINCT l_orderkey) > 0")
def approximate_counts(spark, d):
    """Distinct orders and the median price by sketches, each checked against its exact value.

    Sketches and exact values have plans of their own: in one aggregate with a count of distinct keys Spark groups by these
    keys first, and each key has both sketches of its own. The exact median goes by distributed ranks; of an even number of
    prices, all from one middle price to the other are medians. Groups without orders are left out, as in SQL.
    """
    t = table(spark, d, "lineitem").select(F.struct("l_returnflag").alias("g"), "l_orderkey", "l_extendedprice")  # a struct around a null still joins
    sketches = materialise(t.groupBy("g").agg(F.approx_count_distinct("l_orderkey", 0.02).alias("a"), F.percentile_approx("l_extendedprice", 0.5, 10000).alias("p"), F.count("l_extendedprice").alias("prices")), "sketches")
    orders = t.groupBy("g").agg(F.countDistinct("l_orderkey").alias("n")).filter("n > 0")
    middle = below_counts(t, ["g"], "l_extendedprice").join(sketches.select("g", "prices"), "g").filter("below <= prices div 2 AND below + n > (prices - 1) div 2")
    medians = middle.groupBy("g").agg(F.min("l_extendedprice").alias("lo"), F.max("l_extendedprice").alias("hi")).withColumn("m", F.expr("(lo + hi) / 2"))
    median = F.expr("p BETWEEN lo AND hi OR abs(p - m) < 0.01 * abs(m)")
    return orders.join(sketches, "g").join(medians, "g", "left").select("g.l_returnflag", (F.expr("abs(a - n) < 0.08 * n") & F.coalesce(median, F.col("p").isNull())).alias("close"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag), ())")
def grouping_sets(spark, d):
    return table(spark, d, "lineitem").groupingSets([["l_returnflag", "l_linestatus"], ["l_returnflag"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, d):
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT * FROM (SELECT l_returnflag, l_linestatus, l_quantity FROM lineitem) PIVOT (count(*) FOR l_linestatus IN ('F' AS f, 'O' AS o) GROUP BY l_returnflag)")
def pivot(spark, d):
    return table(spark, d, "lineitem").groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).select("l_returnflag", F.coalesce("F", F.lit(0)).alias("f"), F.coalesce("O", F.lit(0)).alias("o"))


@query("SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer")
def set_intersection(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).intersect(table(spark, d, "customer").select("c_nationkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
def set_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).subtract(table(spark, d, "supplier").filter("s_acctbal > 5000").select("s_nationkey"))


@query("WITH r AS (SELECT c_custkey, c_nationkey, c_acctbal, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer) SELECT c_nationkey, c_custkey, k FROM r WHERE k <= 3")
def top_customers(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    return table(spark, d, "customer").withColumn("k", F.row_number().over(w)).filter("k <= 3").select("c_nationkey", "c_custkey", F.col("k").cast("long").alias("k"))


@query("SELECT event_type, json_extract_string(props, '$.k') AS k, count(*) AS n FROM events GROUP BY 1, 2")
def event_props(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.get_json_object("props", "$.k").alias("k")).agg(F.count("*").alias("n"))


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_windows(spark, d):
    return stream.tumbling(table(spark, d, "events")).withColumn("total", r4("total"))


@query("""WITH s AS (SELECT ts, unnest(range(0, 4)) AS i FROM events), w AS (SELECT CAST(floor(epoch_us(ts) / 900000000.0) AS BIGINT) * 900 - i * 900 AS start FROM s) SELECT start, count(*) AS n FROM w GROUP BY 1""")
def sliding_windows(spark, d):
    return stream.sliding(table(spark, d, "events"))


@query("""WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER u < INTERVAL '30 minutes' THEN 0 ELSE 1 END AS new FROM events WINDOW u AS (PARTITION BY user_id ORDER BY ts, event_id)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) // 1000000 AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def sessions(spark, d):
    return stream.sessions(table(spark, d, "events"))


@query("""SELECT e.event_id, p.event_id AS before FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'click' GROUP BY 1, 2) p ON e.user_id = p.user_id AND e.ts >= p.ts""")
def as_of_join(spark, d):
    e = table(spark, d, "events")
    return stream.as_of(e.filter("event_type = 'purchase'"), e.filter("event_type = 'click'"))


@query("SELECT epoch_us(time_bucket(INTERVAL '1 hour', ts)) // 1000000 AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_counts(spark, d):
    """The tumbling counts again, by a stream over the event files."""
    return stream.run_stream(spark, f"{d}/events.parquet").select("start", "event_type", "n")
