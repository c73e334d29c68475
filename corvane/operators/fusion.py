"""Merging channel hits into candidates, candidate pools and re-rank fusion."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: RRF constant, channel weights, and the rank that stands for a miss at the edge.
K, MISS = 60, 999
PLAIN = {"dense": 0.7, "bm25": 0.3}
MULTI = {"Dense": 0.7, "BM25o": 0.15, "BM25kw": 0.3}


def weight_of(channel: str, weights: dict[str, float]) -> Column:
    out = None
    for name, w in weights.items():
        out = F.when(F.col(channel) == name, F.lit(w)) if out is None else out.when(F.col(channel) == name, F.lit(w))
    return out.otherwise(0.0)


def rrf(hits: DataFrame, by: list[str], weights: dict[str, float] = PLAIN, channel: str = "channel", rank: str = "rank0") -> DataFrame:
    """(by, rrf, channels): weighted reciprocal ranks from 0 over channels. A candidate of one channel only is divided by
    that channel's weight; one of several is not. Channels of weight 0 or less are left out."""
    w = weight_of(channel, weights)
    best = hits.filter(w > 0).groupBy(*by, channel).agg(F.min(rank).alias("_r"))
    s = best.groupBy(*by).agg(F.sum(w / (K + F.col("_r"))).alias("_s"), F.count("*").alias("channels"), F.sum(w).alias("_w"))
    return s.select(*by, F.when(F.col("channels") == 1, F.col("_s") / F.col("_w")).otherwise(F.col("_s")).alias("rrf"), "channels")


def multi_rrf(hits: DataFrame, root: str = "root_id", qid: str = "qid", item: str = "chunk_id", weights: dict[str, float] = MULTI, channel: str = "channel", rank: str = "rank0") -> DataFrame:
    """(root, item, rrf_prior, n_queries): within each sub-query always divided by the weights hit; then the best sub-query."""
    w = weight_of(channel, weights)
    best = hits.filter(w > 0).groupBy(root, qid, item, channel).agg(F.min(rank).alias("_r"))
    each = best.groupBy(root, qid, item).agg((F.sum(w / (K + F.col("_r"))) / F.sum(w)).alias("_s"))
    return each.groupBy(root, item).agg(F.max("_s").alias("rrf_prior"), F.count("*").alias("n_queries"))


def merged(hits: DataFrame, root: str = "root_id", item: str = "chunk_id") -> DataFrame:
    """One candidate for each item: best rank in each channel, best cosine, channels and sub-queries that hit it."""
    return hits.groupBy(root, item).agg(
        *[F.min(F.when(F.col("channel") == c, F.col("rank0"))).alias(n) for c, n in (("Dense", "dense_rank"), ("BM25o", "bm25_rank"), ("BM25kw", "bm25_kw_rank"))],
        F.max("score").alias("cosine_sim"), F.array_sort(F.collect_set("channel")).alias("sources"), F.array_sort(F.collect_set("qid")).alias("query_hits"))


def best_channel(dense: Column, bm25: Column, keyword: Column) -> tuple[Column, Column]:
    """Name and rank: keyword if strictly before both others, dense if before BM25, else BM25; no name if all missed."""
    d, b, k = (F.coalesce(c, F.lit(MISS)) for c in (dense, bm25, keyword))
    none = F.least(d, b, k) >= MISS
    name = F.when(none, F.lit(None)).when((k < d) & (k < b), "BM25kw").when(d < b, "Dense").otherwise("BM25o")
    rank = F.when((k < d) & (k < b), k).when(d < b, d).otherwise(b)
    return name, rank


def evidence(query_hits: Column) -> Column:
    n = F.size(F.array_distinct(query_hits))
    return F.when(n >= 3, 0.004).when(n == 2, 0.002).otherwise(0.0)


def minmax(value: str, by: list[str]) -> Column:
    """Into 0..1 within a group; a group without range gives 0. Null stays null."""
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return (F.col(value) - lo) / F.when(hi - lo == 0, F.lit(1e-8)).otherwise(hi - lo)


def prior(df: DataFrame, root: str = "root_id", rrf_col: str = "rrf_prior", evidence_col: str = "evidence_score") -> DataFrame:
    return df.withColumn("prior", 0.7 * minmax(rrf_col, [root]) + 0.3 * minmax(evidence_col, [root]))


def normalised(df: DataFrame, by: list[str], score: str, order: str, temperature: float = 1.0) -> DataFrame:
    """Adds n_minmax, n_rank, n_sigmoid and n_softmax of a score within each group. A group of one ranks 1."""
    g = Window.partitionBy(*by)
    n = F.count(score).over(g)
    place = F.row_number().over(g.orderBy(F.desc_nulls_last(score), order))
    sd = F.stddev_pop(score).over(g)
    z = (F.col(score) - F.avg(score).over(g)) / F.when(sd == 0, F.lit(1e-8)).otherwise(sd)
    e = F.exp((F.col(score) - F.max(score).over(g)) / temperature)
    d = df.withColumn("_e", e)
    return (
        d.withColumn("n_minmax", minmax(score, by))
        .withColumn("n_rank", F.when(F.col(score).isNotNull(), F.when(n > 1, 1 - (place - 1) / (n - 1)).otherwise(1.0)))
        .withColumn("n_sigmoid", 1 / (1 + F.exp(-z)))
        .withColumn("n_softmax", F.col("_e") / F.sum("_e").over(g)).drop("_e")
    )


def length_penalty(raw: Column, n_chars: Column, lam: float = 0.1) -> Column:
    return raw - lam * F.log(F.greatest(n_chars, F.lit(1)))


def fuse(df: DataFrame, by: list[str], prior_col: str, ce_col: str, order: str, alpha: float = 0.3, normalise_prior: bool = False) -> DataFrame:
    """Adds final_score = alpha * prior + (1 - alpha) * min-maxed cross-encoder score, and final_rank. alpha 0 takes the latter alone."""
    p = minmax(prior_col, by) if normalise_prior else F.col(prior_col)
    d = df.withColumn("final_score", alpha * F.coalesce(p, F.lit(0.0)) + (1 - alpha) * F.coalesce(minmax(ce_col, by), F.lit(0.0)))
    return d.withColumn("final_rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("final_score"), order)))


def without_reranker(cosine: Column, prior_col: Column) -> Column:
    return 0.7 * F.coalesce(cosine, F.lit(0.0)) + 0.3 * F.coalesce(prior_col, F.lit(0.0))


def pool_order(hits: list[list[int]], n_rw: int, n_sq: int, cap: int, scheme: str = "plan_c") -> list[int]:
    """Indexes of the pool, of candidates in the order of their prior, given the sub-queries that hit each.

    Up to `cap` candidates pass as they are. Otherwise the original query reserves 20, each sub-question 5, rewrites 10
    together; each candidate counts for the first of these that has room. What sub-questions leave of their budget (30,
    20 or none) goes to further candidates that one of them hit. In scheme `even` they share 20 and leave nothing.
    """
    if len(hits) <= cap:
        return list(range(len(hits)))
    subs = range(n_rw + 1, n_rw + n_sq + 1)
    budget = 30 if n_sq >= 2 else 20 if n_sq == 1 else 0
    room = dict.fromkeys(subs, 5)
    if scheme == "even" and n_sq:
        room = {q: 20 // n_sq + (k < 20 % n_sq) for k, q in enumerate(subs)}
    original = rewritten = used = 0
    kept, rest = [], []
    for i, h in enumerate(hits):
        mine = set(h)
        if 0 in mine and original < 20:
            original += 1
            kept.append(i)
            continue
        sub = next((q for q in subs if q in mine and room[q] > 0), None)
        if sub is not None:
            room[sub] -= 1
            used += 1
            kept.append(i)
        elif rewritten < 10 and any(1 <= q <= n_rw for q in mine):
            rewritten += 1
            kept.append(i)
        else:
            rest.append(i)
    more = [i for i in rest if any(q in subs for q in hits[i])][: max(0, budget - used)] if scheme == "plan_c" else []
    kept += more
    gone = set(more)
    return (kept + [i for i in rest if i not in gone])[:cap]


def quota_pool(candidates: DataFrame, root: str = "root_id", item: str = "chunk_id", prior_col: str = "retrieval_prior", cap: int = 50, n_rw: int | str = 2, n_sq: int | str = 2, scheme: str = "plan_c") -> DataFrame:
    """(root, item, pool_pos): the candidate pool of each question, in order from 1.

    n_rw and n_sq are numbers or columns that say how many rewrites and sub-questions a question has; with two
    sub-questions plan_c takes ten more. Each candidate's fate depends on those before it, so a question's candidates
    are walked together: they are bounded by its retrieval depths, and repeated rows are combined before.
    """
    kinds = dict(candidates.dtypes)
    count = lambda n: F.col(n) if isinstance(n, str) else F.lit(n)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_p", item], ascending=[False, True])
        rw, sq = int(pdf["_rw"].iloc[0]), int(pdf["_sq"].iloc[0])
        full = cap + (10 if sq >= 2 and scheme == "plan_c" else 0)
        order = pool_order([list(h) if h is not None else [] for h in pdf["query_hits"]], rw, sq, full, scheme)
        return pd.DataFrame({root: pdf[root].iloc[order].to_numpy(), item: pdf[item].iloc[order].to_numpy(), "pool_pos": range(1, len(order) + 1)})

    rows = candidates.groupBy(root, item).agg(F.max(F.coalesce(F.col(prior_col), F.lit(-1.0))).alias("_p"), F.max("query_hits").alias("query_hits"), F.max(count(n_rw)).alias("_rw"), F.max(count(n_sq)).alias("_sq"))
    return rows.groupBy(root).applyInPandas(run, f"{root} {kinds[root]}, {item} {kinds[item]}, pool_pos int")


def ce_pool(df: DataFrame, by: list[str], rrf_col: str, dense_col: str, order: str, top: int = 30, dense_top: int = 5) -> DataFrame:
    """Candidates to score: the first by RRF and the first by dense rank."""
    w = Window.partitionBy(*by)
    d = df.withColumn("_a", F.row_number().over(w.orderBy(F.desc_nulls_last(rrf_col), order))).withColumn("_b", F.row_number().over(w.orderBy(F.asc_nulls_last(dense_col), order)))
    return d.filter((F.col("_a") <= top) | ((F.col("_b") <= dense_top) & F.col(dense_col).isNotNull())).drop("_a", "_b")


def neighbours(hits: DataFrame, chunks: DataFrame, root: str, section: str = "section_id", index: str = "chunk_index", text: str = "content", reach: int = 1, glue: str = "\n\n---\n\n", heading: str | None = None) -> DataFrame:
    """(root, section, lo, hi, rank, context): each hit widened to its neighbours in the section, under the section's
    heading path where the column is named; equal windows keep the first hit."""
    last = chunks.groupBy(section).agg(F.max(index).alias("_last"))
    spans = hits.join(last, section).withColumn("lo", F.greatest(F.col(index) - reach, F.lit(0))).withColumn("hi", F.least(F.col(index) + reach, F.col("_last")))
    path = F.array_join(F.min_by(heading, "rank"), " > ") if heading else F.lit("")
    spans = spans.groupBy(root, section, "lo", "hi").agg(F.min("rank").alias("rank"), F.nullif(path, F.lit("")).alias("_path"))
    c = chunks.select(section, F.col(index).alias("_i"), F.col(text).alias("_t"))
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_t"))), lambda x: x["_t"]), glue)
    return spans.join(c, section).filter("_i between lo and hi").groupBy(root, section, "lo", "hi", "rank").agg(F.concat_ws(glue, F.min("_path"), parts).alias("context"))


def cosine_filled(candidates: DataFrame, cosine: str, asked: Column, vector: Column) -> DataFrame:
    """Candidates with the cosine of those that only lexical channels found computed from their vectors, at four places."""
    from .search import cosine as of

    return candidates.withColumn(cosine, F.coalesce(F.col(cosine), F.round(of(asked, vector), 4)))


def channel_ranks(hits: DataFrame, root: str = "root_id", item: str = "chunk_id") -> DataFrame:
    """(root, item, ch_ranks): each candidate's rank in every channel of every sub-query, for replays under other weights."""
    name = F.concat(F.col("qid").cast("string"), F.lit("-"), F.col("channel"))
    each = hits.groupBy(root, item, name.alias("c")).agg(F.min("rank0").alias("r"))
    return each.groupBy(root, item).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "r")))).alias("ch_ranks"))


def judge(top_sim: Column, verdict: Column, direct: float = 0.70) -> Column:
    """answer, reject or fallback by the top result, else by a verdict word; no result rejects."""
    word = F.upper(F.trim(verdict))
    return F.when(top_sim.isNull(), "reject").when(top_sim >= direct, "answer").when(word.startswith("ERROR"), "fallback").when(word.startswith("YES") | word.startswith("PARTIAL"), "answer").otherwise("reject")


def weight_grid(hits: DataFrame, configs: DataFrame, root: str = "root_id", item: str = "chunk_id") -> DataFrame:
    """(config, root, item, rrf_prior): multi-query fusion under each row (config, w_dense, w_bm25, w_kw) of a small table."""
    h = hits.crossJoin(configs)
    w = F.when(F.col("channel") == "Dense", F.col("w_dense")).when(F.col("channel") == "BM25o", F.col("w_bm25")).otherwise(F.col("w_kw"))
    best = h.withColumn("_w", w).filter("_w > 0").groupBy("config", root, "qid", item, "channel", "_w").agg(F.min("rank0").alias("_r"))
    each = best.groupBy("config", root, "qid", item).agg((F.sum(F.col("_w") / (K + F.col("_r"))) / F.sum("_w")).alias("_s"))
    return each.groupBy("config", root, item).agg(F.max("_s").alias("rrf_prior"))
