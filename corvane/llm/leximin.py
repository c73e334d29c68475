"""One ranking from several differently scaled scores, by leximin over percentiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import below_counts, materialise

#: score -> True where larger is better.
SCORES = {"prior_rank": False, "rrf_prior": True, "retrieval_prior": True, "cosine_sim": True, "ce_raw": True}
MISS = 999
#: Rows of a query that are ranked in one task; larger queries are ranked by counts over range partitions, with the same result.
ONE_TASK = 100_000


def with_gold_ranks(candidates: DataFrame, failures: DataFrame) -> DataFrame:
    """Candidates, and the failure report's gold chunks that were in the union as rows (_gold) that fill a missing prior_rank."""
    gold = (
        failures.select(F.col("qid").alias("root_id"), F.explode("gold_chunks").alias("g")).filter(F.col("g.global_union.in_union"))
        .select("root_id", F.col("g.chunk_id").alias("chunk_id"), F.nullif(F.col("g.global_union.prior_rank"), F.lit(MISS)).alias("_gold"))
    )
    return candidates.select("root_id", "chunk_id", *SCORES).unionByName(gold.withColumn("_fill", F.lit(True)), allowMissingColumns=True)


def percentiles(df: DataFrame, query: str, item: str, scores: dict[str, bool] = SCORES, one_task: int = ONE_TASK) -> DataFrame:
    """(query, item, vec): the item's percentiles within its query, one for each score, smallest first.

    A percentile is the share of the query's other items that are worse, ties counting half. A missing score (null,
    NaN or, for prior_rank, 999) gives 0 and counts as worse than any score, so it never speaks for an item. Repeated
    rows count once; where rows of an item differ, its best value holds. Rows with a null query or item are left out.
    Rows of with_gold_ranks() marked _fill only give an item of the table the prior_rank it lacks.

    Queries of up to `one_task` rows take one shuffle, by the query. Larger ones, which are counted first, may hold any
    share of the rows: each score's values are counted and range partitioned.
    """
    q, i, n = F.col(query).alias("_q"), F.col(item).alias("_i"), len(scores)
    fills = "_fill" in df.columns

    def oriented(name: str, up: bool):
        x = F.col(name).cast("double")
        if name == "prior_rank":
            x = F.nullif(x, F.lit(float(MISS)))
        x = F.when(~F.isnan(x), x)
        return x if up else -x

    kept = df.filter(F.col(query).isNotNull() & F.col(item).isNotNull())
    rows = kept.select(q, i, *[oriented(s, up).alias(f"_s{k}") for k, (s, up) in enumerate(scores.items())], *([F.col("_fill"), (-F.col("_gold").cast("double")).alias("_gold")] if fills else []))

    def single(d: DataFrame) -> DataFrame:
        d = d.groupBy("_q", "_i").agg(*[F.max(f"_s{k}").alias(f"_s{k}") for k in range(n)], *([F.max("_gold").alias("_gold"), F.bool_or(F.col("_fill").isNull()).alias("_own")] if fills else []))
        if fills:
            at = f"_s{list(scores).index('prior_rank')}"
            d = d.filter("_own").withColumn(at, F.coalesce(at, "_gold")).drop("_own", "_gold")
        return d

    large = materialise(kept.groupBy(q).agg(F.count("*").alias("n")).filter(F.col("n") > one_task).select("_q"), "large")  # a row for each such query
    any_large = not large.isEmpty()
    small = rows.join(large, "_q", "left_anti") if any_large else rows
    out = _in_tasks(single(small.repartition("_q")), n)
    if any_large:
        out = out.unionByName(_over_ranges(materialise(single(rows.join(large, "_q", "left_semi")), "items"), n))
    return out.select(F.col("_q").alias(query), F.col("_i").alias(item), "vec")


def _in_tasks(rows: DataFrame, n: int) -> DataFrame:
    """A query's items ranked by each score in turn; the rows stay where the shuffle by query put them."""
    size = F.count("*").over(Window.partitionBy("_q"))

    def share(k: int):
        w = Window.partitionBy("_q").orderBy(F.asc_nulls_first(f"_s{k}"))
        less = F.rank().over(w) - 1
        upto = F.round(F.cume_dist().over(w) * size)
        return F.when(F.col(f"_s{k}").isNull(), 0.0).otherwise((less + (upto - less - 1) / 2) / F.greatest(size - 1, F.lit(1)))

    return rows.select("_q", "_i", F.array_sort(F.array(*[share(k) for k in range(n)])).alias("vec"))


def _over_ranges(rows: DataFrame, n: int) -> DataFrame:
    long = rows.select("_q", "_i", F.posexplode(F.array(*[f"_s{k}" for k in range(n)])).alias("_k", "_v"))
    below = below_counts(long, ["_q", "_k"], "_v")
    sizes = long.groupBy("_q", "_k").agg(F.count("*").alias("_n"), F.count("_v").alias("_known"))
    share = (F.col("below") + F.col("_n") - F.col("_known") + (F.col("n") - 1) / 2) / F.greatest(F.col("_n") - 1, F.lit(1))
    shares = below.join(sizes, ["_q", "_k"]).select("_q", "_k", "_v", share.alias("_p"))
    # Missing scores need no percentile and would all meet in one task.
    scored = long.filter("_v is not null").join(shares, ["_q", "_k", "_v"]).select("_q", "_i", "_p").unionByName(long.filter("_v is null").select("_q", "_i", F.lit(0.0).alias("_p")))
    return scored.groupBy("_q", "_i").agg(F.array_sort(F.collect_list("_p")).alias("vec"))


def _key(item: str):
    return F.struct(F.transform("vec", lambda x: -x).alias("v"), F.col(item).alias("i"))


def heads(ranked: DataFrame, query: str, item: str) -> DataFrame:
    """The leximin head of each query: the largest ascending vector, ties to the smallest item. Combines map-side."""
    return ranked.groupBy(query).agg(F.min(_key(item)).alias("_m")).select(query, F.col("_m.i").alias(item))


def order(ranked: DataFrame, query: str, item: str, one_task: int = ONE_TASK) -> DataFrame:
    """(query, item, place): every item's place in its query's leximin order, from 1; ties by item.

    The place is a row number in queries of up to `one_task` items and a count over range partitions in larger ones.
    """
    keyed = ranked.select(query, _key(item).alias("_key"))
    large = materialise(keyed.groupBy(query).agg(F.count("*").alias("n")).filter(F.col("n") > one_task).select(query), "large")
    any_large = not large.isEmpty()
    small = keyed.join(large, query, "left_anti") if any_large else keyed
    out = small.select(query, F.col("_key.i").alias(item), F.row_number().over(Window.partitionBy(query).orderBy("_key")).cast("long").alias("place"))
    if any_large:
        placed = below_counts(keyed.join(large, query, "left_semi"), [query], "_key")
        out = out.unionByName(placed.select(query, F.col("_key.i").alias(item), (F.col("below") + 1).alias("place")))
    return out
