"""Ranking metrics, strata, comparisons of arms, failure classes and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def per_query(questions: DataFrame, ranked: DataFrame, gold: DataFrame, query: str, item: str, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(query, rr, recall_k..., hit_count, gold_count): every question, those without a hit as 0. ranked has query, item, rank; gold has query, item."""
    g = gold.select(query, item).distinct()
    hit = ranked.join(g, [query, item], "left_semi").groupBy(query).agg(F.min("rank").alias("_first"), *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"_h{k}") for k in ks], F.count("*").alias("hit_count"))
    n = g.groupBy(query).agg(F.count("*").alias("gold_count"))
    j = questions.select(query).distinct().join(n, query, "left").join(hit, query, "left")
    return j.select(query, F.coalesce(1 / F.col("_first"), F.lit(0.0)).alias("rr"), *[F.coalesce(F.col(f"_h{k}") > 0, F.lit(False)).alias(f"recall_{k}") for k in ks], *[(F.coalesce(f"_h{k}", F.lit(0)) / k).alias(f"precision_{k}") for k in ks], F.coalesce("hit_count", F.lit(0)).alias("hit_count"), F.coalesce("gold_count", F.lit(0)).alias("gold_count"))


def macro(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    out = rows.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg("rr").alias("mrr"), *[F.avg(F.col(c).cast("double")).alias(c) for c in rows.columns if c.startswith(("recall_", "precision_"))], F.sum("hit_count").alias("hits"), F.count_if(F.col("rr") == 0).alias("zero_recall"))
    return out


def strata(rows: DataFrame, dims: list[str], value: str) -> DataFrame:
    """(dim, stratum, n, mean): every dimension on its own in one pass."""
    sets = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias("stratum")) for d in dims]))
    return rows.select(sets.alias("s"), F.col(value).alias("v")).groupBy("s.dim", "s.stratum").agg(F.count("*").alias("n"), F.avg("v").alias("mean"))


def ndcg(ranked: DataFrame, query: str, rel: str, k: int, order: str = "retrieved") -> DataFrame:
    """(query, ndcg): gains 2^rel - 1 over log2(place + 1). `sorted` orders the retrieved relevances first, which gives 1 wherever any is above 0."""
    w = Window.partitionBy(query)
    place = F.row_number().over(w.orderBy(F.desc(rel), "rank")) if order == "sorted" else F.col("rank")
    ideal = F.row_number().over(w.orderBy(F.desc(rel), "rank"))
    gain = F.pow(F.lit(2.0), F.col(rel)) - 1
    d = ranked.withColumn("_p", place).withColumn("_i", ideal)
    s = d.groupBy(query).agg(F.sum(F.when(F.col("_p") <= k, gain / F.log2(F.col("_p") + 1)).otherwise(0.0)).alias("_d"), F.sum(F.when(F.col("_i") <= k, gain / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias("_n"))
    return s.select(query, F.when(F.col("_n") > 0, F.col("_d") / F.col("_n")).otherwise(0.0).alias("ndcg"))


def confusion(rows: DataFrame, truth: Column, said: Column) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and accuracy of a boolean answer; rows where either is null are left out."""
    d = rows.select(truth.alias("t"), said.alias("s")).filter("t is not null and s is not null")
    a = d.agg(*[F.count_if(F.expr(e)).alias(n) for n, e in (("tp", "t and s"), ("fp", "not t and s"), ("fn", "t and not s"), ("tn", "not t and not s"))])
    return a.select("*", (F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0))).alias("precision"), (F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))).alias("recall"), ((F.col("tp") + F.col("tn")) / F.nullif(F.expr("tp + fp + fn + tn"), F.lit(0))).alias("accuracy"))


def threshold_sweep(rows: DataFrame, score: str, positive: str, lo: int, hi: int, step: int) -> DataFrame:
    """(threshold, accepted, false_accepted, accuracy) at lo, lo+step, ... hi thousandths; each row is counted once and thresholds are cumulated."""
    t = F.least(F.greatest(F.floor(F.round(F.col(score) * 1000, 6)).cast("long"), F.lit(lo - 1)), F.lit(hi))
    binned = rows.filter(F.col(score).isNotNull() & F.col(positive).isNotNull()).groupBy(t.alias("b")).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("n"))
    grid = rows.sparkSession.range(lo, hi + 1, step).select(F.col("id").alias("t"))
    j = grid.join(binned, F.lit(True)).groupBy("t").agg(F.sum(F.when(F.col("b") >= F.col("t"), F.col("p")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("b") >= F.col("t"), F.col("n")).otherwise(0)).alias("fp"), F.sum("p").alias("P"), F.sum("n").alias("N"))
    return j.select((F.col("t") / 1000).alias("threshold"), (F.col("tp") + F.col("fp")).alias("accepted"), F.col("fp").alias("false_accepted"), ((F.col("tp") + F.col("N") - F.col("fp")) / (F.col("P") + F.col("N"))).alias("accuracy"))


def ab_diff(a: DataFrame, b: DataFrame, query: str) -> DataFrame:
    """(change, n) of reciprocal ranks from arm a to arm b: rescued, lost, improved, worsened, same."""
    j = a.select(query, F.col("rr").alias("x")).join(b.select(query, F.col("rr").alias("y")), query)
    c = F.when((F.col("x") == 0) & (F.col("y") > 0), "rescued").when((F.col("x") > 0) & (F.col("y") == 0), "lost").when(F.col("y") > F.col("x"), "improved").when(F.col("y") < F.col("x"), "worsened").otherwise("same")
    return j.groupBy(c.alias("change")).agg(F.count("*").alias("n"))


def upper_medians(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, median): the element at n // 2 of each group's sorted values, from counts of equal values: no group is gathered."""
    c = rows.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    placed = c.withColumn("_upto", F.sum("_n").over(w.orderBy(value))).withColumn("_all", F.sum("_n").over(w))
    return placed.filter(F.col("_upto") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(value).alias("median"))


def summary(rows: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    return rows.groupBy(*(by or [])).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.expr(f"percentile(`{value}`, 0.5)").alias("median"), F.min(value).alias("lowest"), F.max(value).alias("highest"), F.stddev_pop(value).alias("std"))


def same_order(a: DataFrame, b: DataFrame, query: str, item: str) -> DataFrame:
    """(query, equal): whether two rankings hold the same items in the same order."""
    def listed(d, n):
        return d.groupBy(query).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", item))), lambda x: x[item]).alias(n))
    return listed(a, "x").join(listed(b, "y"), query, "full").select(query, F.coalesce(F.col("x") == F.col("y"), F.lit(False)).alias("equal"))


def failure_class(in_union: Column, in_pool: Column, prior_rank: Column, final_rank: Column, pool: int = 50, top: int = 10) -> Column:
    """A: never retrieved; B1: out of the pool though within its size by prior; B2: out of it by prior; C: in the pool, not on top; else ok."""
    rank = F.nullif(prior_rank, F.lit(999))
    return F.when(~F.coalesce(in_union, F.lit(False)), "A").when(~F.coalesce(in_pool, F.lit(False)), F.when(rank <= pool, "B1").otherwise("B2")).when(F.coalesce(final_rank > top, F.lit(True)), "C").otherwise("ok")


def term_match(gold: DataFrame, said: DataFrame, query: str, term: str) -> DataFrame:
    """(query, precision, recall, f1) of term lists where one containing the other counts as a match."""
    pairs = gold.select(query, F.col(term).alias("g")).distinct().join(said.select(query, F.col(term).alias("p")).distinct(), query, "full")
    hit = F.coalesce(F.col("g").contains(F.col("p")) | F.col("p").contains(F.col("g")), F.lit(False))
    each = pairs.withColumn("hit", hit)
    r = each.filter("g is not null").groupBy(query, "g").agg(F.max("hit").alias("h")).groupBy(query).agg(F.avg(F.col("h").cast("double")).alias("recall"))
    p = each.filter("p is not null").groupBy(query, "p").agg(F.max("hit").alias("h")).groupBy(query).agg(F.avg(F.col("h").cast("double")).alias("precision"))
    j = r.join(p, query, "full").select(query, F.coalesce("precision", F.lit(0.0)).alias("precision"), F.coalesce("recall", F.lit(0.0)).alias("recall"))
    s = F.col("precision") + F.col("recall")
    return j.withColumn("f1", F.when(s > 0, 2 * F.col("precision") * F.col("recall") / s).otherwise(0.0))


def weighted_tiers(tiers: DataFrame, weights: dict[str, float], query: str = "qid") -> DataFrame:
    """(query, weighted): tier recalls times their weights; an empty tier adds nothing."""
    w = None
    for t, x in weights.items():
        w = F.when(F.col("tier") == t, F.lit(x)) if w is None else w.when(F.col("tier") == t, F.lit(x))
    return tiers.groupBy(query).agg(F.sum(F.coalesce(w, F.lit(0.0)) * F.col("recall")).alias("weighted"))


def stratified_sample(rows: DataFrame, by: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each stratum by hashed order: the same rows in every run and at every partitioning."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(order, key))).filter(F.col("_r") <= n).drop("_r")


def best_config(rows: DataFrame, config: str, *metrics: str) -> DataFrame:
    """The configuration with the best metrics, taken one after the other; ties to the smallest name."""
    return rows.orderBy(*[F.desc(m) for m in metrics], config).limit(1)


def promoted(rows: DataFrame, base_train: float, base_val: float, epsilon: float = 0.005) -> DataFrame:
    """The candidate to promote: best train score above the base with validation no worse than the base by epsilon; no row if none."""
    return rows.filter((F.col("train") > base_train) & (F.col("val") >= base_val - epsilon)).orderBy(F.desc("train"), "name").limit(1)


def score_shares(rows: DataFrame, score: str, by: list[str] | None = None, top: int = 3) -> DataFrame:
    """(n, mean, share_3, share_2, share_low) of judged scores 0 to 3; negative ones are failed judgements and left out."""
    s = F.col(score)
    share = lambda c: F.avg(c.cast("double"))
    return rows.filter(s >= 0).groupBy(*(by or [])).agg(F.count("*").alias("n"), F.avg(s).alias("mean"), share(s == top).alias("share_3"), share(s == top - 1).alias("share_2"), share(s <= top - 2).alias("share_low"))


def panels(a: DataFrame, b: DataFrame, of: DataFrame, query: str, panel: str) -> DataFrame:
    """(panel, n, mrr_a, mrr_b, rescued, lost): two arms compared on parts of the questions; a question may be in several."""
    j = of.select(query, panel).distinct().join(a.select(query, F.col("rr").alias("x")), query).join(b.select(query, F.col("rr").alias("y")), query)
    return j.groupBy(panel).agg(F.count("*").alias("n"), F.avg("x").alias("mrr_a"), F.avg("y").alias("mrr_b"), F.count_if((F.col("x") == 0) & (F.col("y") > 0)).alias("rescued"), F.count_if((F.col("x") > 0) & (F.col("y") == 0)).alias("lost"))


def rescue_rate(base: DataFrame, other: DataFrame, query: str) -> DataFrame:
    """(zeros, rescued, rate): questions the base misses, and those of them that the other arm finds."""
    j = base.filter("rr = 0").select(query).join(other.select(query, "rr"), query)
    return j.agg(F.count("*").alias("zeros"), F.count_if(F.col("rr") > 0).alias("rescued")).withColumn("rate", F.col("rescued") / F.nullif("zeros", F.lit(0)))


def layer_diff(base: DataFrame, other: DataFrame, query: str) -> DataFrame:
    """(rescued, new_fail, net) of questions found in one arm and not in the other."""
    j = base.select(query, (F.col("rr") > 0).alias("x")).join(other.select(query, (F.col("rr") > 0).alias("y")), query)
    d = j.agg(F.count_if(~F.col("x") & F.col("y")).alias("rescued"), F.count_if(F.col("x") & ~F.col("y")).alias("new_fail"))
    return d.withColumn("net", F.col("rescued") - F.col("new_fail"))


def arm_scores(candidates: DataFrame, cache: DataFrame, arm: str, keys: list[str], score: str, to: str) -> DataFrame:
    """Adds the score that an arm's cache has for a candidate, the base's own elsewhere: only what differs is scored anew."""
    mine = cache.filter(F.col("arm") == arm).groupBy(*keys).agg(F.max(score).alias("_mine"))
    return candidates.join(mine, keys, "left").withColumn(to, F.coalesce("_mine", score)).drop("_mine")


def root_quotas(rows: DataFrame, stratum: str, key: str, total: int, seed: int = 42) -> DataFrame:
    """At most `total` rows: each stratum gets one or its share of `total` by the root of its size, rounded down; what is
    left is filled from all rows in hashed order. The same rows in every run."""
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")))
    sizes = rows.groupBy(stratum).agg(F.count("*").alias("_n"))
    quotas = sizes.crossJoin(sizes.agg(F.sum(F.sqrt("_n")).alias("_all"))).select(F.col(stratum).alias("_s"), F.greatest(F.floor(F.lit(total) * F.sqrt("_n") / F.col("_all")), F.lit(1)).alias("_q"))
    placed = rows.withColumn("_o", order).withColumn("_k", F.row_number().over(Window.partitionBy(stratum).orderBy("_o", key)))
    j = placed.join(quotas, F.col(stratum).eqNullSafe(F.col("_s")))
    return j.orderBy((F.col("_k") > F.col("_q")).cast("int"), "_o", key).limit(total).drop("_o", "_k", "_q", "_s")
