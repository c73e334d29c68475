"""Queries of fusion, pools, evaluation, rewriting and judging over the test tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .operators import chunks, diagnosis, evaluation, fusion, rewrite
from .plans import pipeline
from .queries import R6, SIMS, _ranked, _topk, query, table
from .tables import below_counts, bounded

#: Candidates once, without repeated rows, with a miss as null.
CAND = """c AS (SELECT DISTINCT root_id, chunk_id, text_len, section_id, sources, query_hits, dense_rank, bm25_rank, bm25_kw_rank, rrf_prior, cosine_sim, evidence_score, retrieval_prior, ce_raw, nullif(prior_rank, 999) AS prior_rank FROM candidates)"""


def cand(spark, d) -> DataFrame:
    c = table(spark, d, "candidates")
    return c.select("root_id", "chunk_id", "text_len", "section_id", "sources", "query_hits", "dense_rank", "bm25_rank", "bm25_kw_rank", "rrf_prior", "cosine_sim", "evidence_score", "retrieval_prior", "ce_raw", F.nullif("prior_rank", F.lit(999)).alias("prior_rank")).distinct()


def hits(spark, d) -> DataFrame:
    """A row for each channel that hit a candidate under each of its sub-queries: the first gave the stored rank, each later one stands one lower."""
    asked = F.when(F.size("query_hits") > 0, F.col("query_hits")).otherwise(F.array(F.lit(0)))
    channels = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(c).alias("rank0")) for n, c in (("Dense", "dense_rank"), ("BM25o", "bm25_rank"), ("BM25kw", "bm25_kw_rank"))])
    each = cand(spark, d).select("root_id", "chunk_id", F.posexplode(asked).alias("_at", "qid"), "cosine_sim", channels.alias("_c"))
    return each.select("root_id", "chunk_id", "qid", "cosine_sim", "_at", F.explode("_c").alias("h")).select("root_id", "chunk_id", "qid", F.col("cosine_sim").alias("score"), "h.channel", (F.col("h.rank0") + F.col("_at")).alias("rank0")).filter("rank0 is not null")


HITS = CAND + """, cq AS (SELECT *, unnest(range(1, len(qh) + 1)) AS i FROM (SELECT *, CASE WHEN len(query_hits) > 0 THEN query_hits ELSE [0] END AS qh FROM c)),
    h AS (SELECT root_id, chunk_id, qh[i] AS qid, cosine_sim AS score, channel, CAST(rank0 + i - 1 AS INT) AS rank0 FROM cq, LATERAL (VALUES ('Dense', dense_rank), ('BM25o', bm25_rank), ('BM25kw', bm25_kw_rank)) v(channel, rank0) WHERE rank0 IS NOT NULL)"""
WCASE = "CASE channel WHEN 'Dense' THEN 0.7::DOUBLE WHEN 'BM25o' THEN 0.15::DOUBLE ELSE 0.3::DOUBLE END"


@query("WITH " + HITS + """, b AS (SELECT root_id, chunk_id, channel, min(rank0) AS r FROM h WHERE channel <> 'BM25kw' GROUP BY 1, 2, 3), w AS (SELECT *, CASE channel WHEN 'Dense' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS w FROM b)
    SELECT root_id, chunk_id, count(*) AS channels, round(CASE WHEN count(*) = 1 THEN sum(w / (60 + r)) / sum(w) ELSE sum(w / (60 + r)) END, 6) AS rrf FROM w GROUP BY 1, 2""")
def rrf_plain(spark, d):
    h = hits(spark, d).filter("channel <> 'BM25kw'")
    return fusion.rrf(h, ["root_id", "chunk_id"], {"Dense": 0.7, "BM25o": 0.3}).select("root_id", "chunk_id", "channels", R6("rrf").alias("rrf"))


@query("WITH " + HITS + f""", b AS (SELECT root_id, qid, chunk_id, channel, min(rank0) AS r FROM h GROUP BY 1, 2, 3, 4), e AS (SELECT root_id, qid, chunk_id, sum({WCASE} / (60 + r)) / sum({WCASE}) AS s FROM b GROUP BY 1, 2, 3)
    SELECT root_id, chunk_id, round(max(s), 6) AS rrf_prior, count(*) AS n_queries FROM e GROUP BY 1, 2""")
def rrf_multi(spark, d):
    return fusion.multi_rrf(hits(spark, d)).select("root_id", "chunk_id", R6("rrf_prior").alias("rrf_prior"), "n_queries")


@query("WITH " + HITS + """ SELECT root_id, chunk_id, min(CASE WHEN channel = 'Dense' THEN rank0 END) AS dense_rank, min(CASE WHEN channel = 'BM25o' THEN rank0 END) AS bm25_rank, min(CASE WHEN channel = 'BM25kw' THEN rank0 END) AS bm25_kw_rank,
    round(max(score), 6) AS cosine_sim, array_to_string(list_sort(list(DISTINCT channel)), ',') AS sources, array_to_string(list_sort(list(DISTINCT qid)), ',') AS asked FROM h GROUP BY 1, 2""")
def merged_candidates(spark, d):
    return fusion.merged(hits(spark, d)).withColumn("asked", F.array_join("query_hits", ",")).select("asked", "root_id", "chunk_id", "dense_rank", "bm25_rank", "bm25_kw_rank", R6("cosine_sim").alias("cosine_sim"), F.array_join("sources", ",").alias("sources"))


@query("WITH " + CAND + """, r AS (SELECT root_id, chunk_id, coalesce(dense_rank, 999) AS d, coalesce(bm25_rank, 999) AS b, coalesce(bm25_kw_rank, 999) AS k FROM c)
    SELECT root_id, chunk_id, CASE WHEN least(d, b, k) >= 999 THEN NULL WHEN k < d AND k < b THEN 'BM25kw' WHEN d < b THEN 'Dense' ELSE 'BM25o' END AS channel, CASE WHEN k < d AND k < b THEN k WHEN d < b THEN d ELSE b END AS rank FROM r""")
def best_channels(spark, d):
    name, rank = fusion.best_channel(F.col("dense_rank"), F.col("bm25_rank"), F.col("bm25_kw_rank"))
    return cand(spark, d).select("root_id", "chunk_id", name.alias("channel"), rank.alias("rank"))


@query("WITH " + CAND + """ SELECT root_id, chunk_id, CASE WHEN len(list_distinct(query_hits)) >= 3 THEN 0.004::DOUBLE WHEN len(list_distinct(query_hits)) = 2 THEN 0.002::DOUBLE ELSE 0 END AS evidence FROM c""")
def evidence_votes(spark, d):
    return cand(spark, d).select("root_id", "chunk_id", fusion.evidence(F.col("query_hits")).alias("evidence"))


def mm(x: str) -> str:
    return f"(({x} - min({x}) OVER g) / CASE WHEN max({x}) OVER g - min({x}) OVER g = 0 THEN 1e-8::DOUBLE ELSE max({x}) OVER g - min({x}) OVER g END)"


@query("WITH " + CAND + f" SELECT root_id, chunk_id, round(0.7::DOUBLE * {mm('rrf_prior')} + 0.3::DOUBLE * {mm('evidence_score')}, 6) AS prior FROM c WINDOW g AS (PARTITION BY root_id)")
def retrieval_priors(spark, d):
    return fusion.prior(cand(spark, d)).select("root_id", "chunk_id", R6("prior").alias("prior"))


@query("WITH " + CAND + f""" SELECT root_id, chunk_id, round({mm('ce_raw')}, 6) AS n_minmax,
    round(CASE WHEN ce_raw IS NULL THEN NULL WHEN count(ce_raw) OVER g > 1 THEN 1 - (row_number() OVER (PARTITION BY root_id ORDER BY ce_raw DESC NULLS LAST, chunk_id) - 1) / (count(ce_raw) OVER g - 1)::DOUBLE ELSE 1.0 END, 6) AS n_rank,
    round(1 / (1 + exp(-(ce_raw - avg(ce_raw) OVER g) / CASE WHEN stddev_pop(ce_raw) OVER g = 0 THEN 1e-8::DOUBLE ELSE stddev_pop(ce_raw) OVER g END)), 6) AS n_sigmoid,
    round(exp(ce_raw - max(ce_raw) OVER g) / (SELECT sum(exp(x.ce_raw - (SELECT max(y.ce_raw) FROM c y WHERE y.root_id = c.root_id))) FROM c x WHERE x.root_id = c.root_id), 6) AS n_softmax
    FROM c WINDOW g AS (PARTITION BY root_id)""")
def score_normalisers(spark, d):
    n = fusion.normalised(cand(spark, d), ["root_id"], "ce_raw", "chunk_id")
    return n.select("root_id", "chunk_id", *[R6(c).alias(c) for c in ("n_minmax", "n_rank", "n_sigmoid", "n_softmax")])


FUSED = CAND + f""", p AS (SELECT *, ce_raw - 0.1::DOUBLE * ln(greatest(text_len, 1)) AS ce FROM c), f AS (SELECT root_id, chunk_id, 0.3::DOUBLE * coalesce(retrieval_prior, 0) + 0.7::DOUBLE * coalesce({mm('ce')}, 0) AS final_score FROM p WINDOW g AS (PARTITION BY root_id)),
    r AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY final_score DESC, chunk_id) AS final_rank FROM f)"""


def fused(spark, d, alpha: float = 0.3) -> DataFrame:
    return fusion.fuse(cand(spark, d).withColumn("ce", fusion.length_penalty(F.col("ce_raw"), F.col("text_len"))), ["root_id"], "retrieval_prior", "ce", "chunk_id", alpha)


@query("WITH " + FUSED + " SELECT root_id, chunk_id, round(final_score, 6) AS final_score, CAST(final_rank AS INT) AS final_rank FROM r WHERE final_rank <= 10")
def ce_fusion(spark, d):
    return fused(spark, d).filter("final_rank <= 10").select("root_id", "chunk_id", R6("final_score").alias("final_score"), "final_rank")


@query("WITH " + CAND + " SELECT root_id, chunk_id, round(0.7::DOUBLE * coalesce(cosine_sim, 0) + 0.3::DOUBLE * coalesce(retrieval_prior, 0), 6) AS score FROM c")
def no_reranker(spark, d):
    return cand(spark, d).select("root_id", "chunk_id", R6(fusion.without_reranker(F.col("cosine_sim"), F.col("retrieval_prior"))).alias("score"))


@query("WITH " + CAND + """, w AS (SELECT *, row_number() OVER (PARTITION BY root_id ORDER BY rrf_prior DESC NULLS LAST, chunk_id) AS a, row_number() OVER (PARTITION BY root_id ORDER BY dense_rank NULLS LAST, chunk_id) AS b FROM c)
    SELECT root_id, chunk_id FROM w WHERE a <= 30 OR (b <= 5 AND dense_rank IS NOT NULL)""")
def ce_pools(spark, d):
    return fusion.ce_pool(cand(spark, d), ["root_id"], "rrf_prior", "dense_rank", "chunk_id").select("root_id", "chunk_id")


def _pools(scheme: str, size: int | None = None) -> str:
    """The pool of two rewrites (1, 2) and two sub-questions (3, 4) as a fold over each question's candidates."""
    cap, (r3, r4) = (60, (5, 5)) if scheme == "plan_c" else (50, (10, 10))
    cap = size or cap
    left = "greatest(0, 30 - z.n3 - z.n4)" if scheme == "plan_c" else "0"
    keep = "{'id': x.id, 'q': x.q, 'o': a.o%s, 'n3': a.n3%s, 'n4': a.n4%s, 'w': a.w%s, 'kept': list_append(a.kept, x.id), 'rest': a.rest}"
    step = (
        f"CASE WHEN list_contains(x.q, 0) AND a.o < 20 THEN {keep % (' + 1', '', '', '')} WHEN list_contains(x.q, 3) AND a.n3 < {r3} THEN {keep % ('', ' + 1', '', '')} WHEN list_contains(x.q, 4) AND a.n4 < {r4} THEN {keep % ('', '', ' + 1', '')}"
        f" WHEN (list_contains(x.q, 1) OR list_contains(x.q, 2)) AND a.w < 10 THEN {keep % ('', '', '', ' + 1')}"
        " ELSE {'id': x.id, 'q': x.q, 'o': a.o, 'n3': a.n3, 'n4': a.n4, 'w': a.w, 'kept': a.kept, 'rest': list_append(a.rest, {'id': x.id, 's': list_contains(x.q, 3) OR list_contains(x.q, 4)})} END"
    )
    empty = "'o': 0, 'n3': 0, 'n4': 0, 'w': 0, 'kept': []::VARCHAR[], 'rest': []::STRUCT(id VARCHAR, s BOOLEAN)[]"
    more = f"list_transform(list_filter(z.rest, lambda y: y.s), lambda y: y.id)[1:{left}]"
    return "WITH " + CAND + f""", m AS (SELECT root_id, chunk_id AS id, max(coalesce(retrieval_prior, -1)) AS p, max(query_hits) AS q FROM c GROUP BY 1, 2),
        l AS (SELECT root_id, list_concat([{{'id': '', 'q': []::INT[], {empty}}}], list({{'id': id, 'q': coalesce(q, []::INT[]), {empty}}} ORDER BY p DESC, id)) AS l FROM m GROUP BY 1),
        f AS (SELECT root_id, l, list_reduce(l, lambda a, x: {step}) AS z FROM l),
        p AS (SELECT root_id, CASE WHEN len(l) - 1 <= {cap} THEN list_transform(l, lambda y: y.id)[2:] ELSE list_concat(list_concat(z.kept, mo), list_filter(list_transform(z.rest, lambda y: y.id), lambda y: NOT list_contains(mo, y)))[1:{cap}] END AS ids
          FROM (SELECT *, {more} AS mo FROM f))
        SELECT root_id, unnest(ids) AS chunk_id, unnest(range(1, len(ids) + 1))::INT AS pool_pos FROM p"""


@query(_pools("plan_c"))
def quota_pools(spark, d):
    return fusion.quota_pool(cand(spark, d))


@query(_pools("even"))
def quota_pools_even(spark, d):
    return fusion.quota_pool(cand(spark, d), scheme="even")


@query("WITH " + HITS + """, e AS (SELECT root_id, chunk_id, qid || '-' || channel AS c, min(rank0) AS r FROM h GROUP BY 1, 2, 3) SELECT root_id, chunk_id, string_agg(c || '=' || r, ',' ORDER BY c) AS ranks FROM e GROUP BY 1, 2""")
def channel_ranks(spark, d):
    r = fusion.channel_ranks(hits(spark, d))
    return r.select("root_id", "chunk_id", F.array_join(F.transform(F.array_sort(F.map_entries("ch_ranks")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("ranks"))


def _sections_of(spark, d) -> DataFrame:
    c = table(spark, d, "candidates").select("section_id", "chunk_id").distinct()
    return c.withColumn("chunk_index", F.row_number().over(Window.partitionBy("section_id").orderBy("chunk_id")) - 1).withColumn("content", F.col("chunk_id"))


@query("WITH " + FUSED + """, k AS (SELECT section_id, chunk_id, row_number() OVER (PARTITION BY section_id ORDER BY chunk_id) - 1 AS i FROM (SELECT DISTINCT section_id, chunk_id FROM candidates)),
    l AS (SELECT section_id, max(i) AS last FROM k GROUP BY 1), t AS (SELECT r.root_id, k.section_id, k.i, r.final_rank FROM r JOIN k USING (chunk_id) WHERE final_rank <= 3),
    s AS (SELECT root_id, section_id, greatest(i - 1, 0) AS lo, least(i + 1, last) AS hi, min(final_rank) AS rank FROM t JOIN l USING (section_id) GROUP BY 1, 2, 3, 4)
    SELECT root_id, section_id, CAST(lo AS INT) AS lo, CAST(hi AS INT) AS hi, CAST(rank AS INT) AS rank, string_agg(chunk_id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY k.i) AS context FROM s JOIN k USING (section_id) WHERE k.i BETWEEN lo AND hi GROUP BY 1, 2, 3, 4, 5""")
def neighbour_windows(spark, d):
    s = _sections_of(spark, d)
    top = fused(spark, d).filter("final_rank <= 3").select("root_id", "chunk_id", F.col("final_rank").alias("rank")).join(s.select("chunk_id", "section_id", "chunk_index"), "chunk_id")
    return fusion.neighbours(top, s, "root_id").select("root_id", "section_id", "lo", "hi", "rank", "context")


GRID = [("k0", 0.7, 0.15, 0.0), ("k1", 0.7, 0.15, 0.1), ("k3", 0.7, 0.15, 0.3), ("even", 0.5, 0.5, 0.5)]


def _grid(spark) -> DataFrame:
    return spark.createDataFrame(GRID, "config string, w_dense double, w_bm25 double, w_kw double")


@query("WITH " + HITS + ", g(config, wd, wb, wk) AS (VALUES " + ", ".join(f"('{a}', {b}::DOUBLE, {c}::DOUBLE, {e}::DOUBLE)" for a, b, c, e in GRID) + """),
    w AS (SELECT config, root_id, qid, chunk_id, rank0, CASE channel WHEN 'Dense' THEN wd WHEN 'BM25o' THEN wb ELSE wk END AS w FROM h, g),
    e AS (SELECT config, root_id, qid, chunk_id, sum(w / (60 + rank0)) / sum(w) AS s FROM w WHERE w > 0 GROUP BY 1, 2, 3, 4), m AS (SELECT config, root_id, chunk_id, max(s) AS p FROM e GROUP BY 1, 2, 3)
    SELECT config, count(*) AS n, round(avg(p), 6) AS mean_prior FROM m GROUP BY 1""")
def weight_grid(spark, d):
    return fusion.weight_grid(hits(spark, d), _grid(spark)).groupBy("config").agg(F.count("*").alias("n"), R6(F.avg("rrf_prior")).alias("mean_prior"))


GOLD = """gold AS (SELECT DISTINCT qid AS root_id, unnest(gold_chunks).chunk_id AS chunk_id FROM pool_failures)"""


def gold(spark, d) -> DataFrame:
    return table(spark, d, "pool_failures").select(F.col("qid").alias("root_id"), F.explode("gold_chunks.chunk_id").alias("chunk_id")).distinct()


METRICS = FUSED + ", " + GOLD + """, q AS (SELECT DISTINCT root_id FROM gold), n AS (SELECT root_id, count(*) AS gold_count FROM gold GROUP BY 1),
    t AS (SELECT root_id, min(final_rank) AS first, count(CASE WHEN final_rank <= 5 THEN 1 END) AS h5, count(CASE WHEN final_rank <= 10 THEN 1 END) AS h10, count(*) AS hits FROM r JOIN gold USING (root_id, chunk_id) WHERE final_rank <= 10 GROUP BY 1),
    e AS (SELECT q.root_id, coalesce(1.0::DOUBLE / first, 0) AS rr, coalesce(h5 > 0, false) AS recall_5, coalesce(h10 > 0, false) AS recall_10, coalesce(hits, 0) AS hit_count, coalesce(gold_count, 0) AS gold_count FROM q LEFT JOIN t USING (root_id) LEFT JOIN n USING (root_id))"""


def metrics(spark, d, alpha: float = 0.3) -> DataFrame:
    g = gold(spark, d)
    r = fused(spark, d, alpha).filter("final_rank <= 10").select("root_id", "chunk_id", F.col("final_rank").alias("rank"))
    return evaluation.per_query(g.select("root_id"), r, g, "root_id", "chunk_id")


@query("WITH " + METRICS + " SELECT root_id, round(rr, 6) AS rr, recall_5, recall_10, hit_count, gold_count FROM e")
def gold_metrics(spark, d):
    return metrics(spark, d).select("root_id", R6("rr").alias("rr"), "recall_5", "recall_10", "hit_count", "gold_count")


@query("WITH " + METRICS + " SELECT count(*) AS n, round(avg(rr), 6) AS mrr, round(avg(recall_10::INT), 6) AS recall_10, CAST(sum(hit_count) AS BIGINT) AS hits, count(CASE WHEN rr = 0 THEN 1 END) AS zero_recall FROM e")
def macro_metrics(spark, d):
    return evaluation.macro(metrics(spark, d)).select("n", R6("mrr").alias("mrr"), R6("recall_10").alias("recall_10"), "hits", "zero_recall")


@query("WITH " + METRICS + """, s AS (SELECT e.*, p.capability, p.cls FROM e JOIN pool_failures p ON p.qid = e.root_id)
    SELECT 'capability' AS dim, coalesce(capability, '(none)') AS stratum, count(*) AS n, round(avg(rr), 6) AS mean FROM s GROUP BY 2 UNION ALL SELECT 'cls', coalesce(cls, '(none)'), count(*), round(avg(rr), 6) FROM s GROUP BY 2""")
def stratified_metrics(spark, d):
    m = metrics(spark, d).join(table(spark, d, "pool_failures").select(F.col("qid").alias("root_id"), "capability", "cls"), "root_id")
    return evaluation.strata(m, ["capability", "cls"], "rr").withColumn("mean", R6("mean"))


@query("WITH " + METRICS.replace("final_score DESC", "final_score DESC") + """, a AS (SELECT root_id, chunk_id, row_number() OVER (PARTITION BY root_id ORDER BY retrieval_prior DESC NULLS LAST, chunk_id) AS rk FROM c),
    x AS (SELECT q.root_id, coalesce(1.0::DOUBLE / min(CASE WHEN rk <= 10 THEN rk END), 0) AS rr FROM q LEFT JOIN (SELECT a.* FROM a JOIN gold USING (root_id, chunk_id)) z USING (root_id) GROUP BY 1)
    SELECT CASE WHEN x.rr = 0 AND e.rr > 0 THEN 'rescued' WHEN x.rr > 0 AND e.rr = 0 THEN 'lost' WHEN e.rr > x.rr THEN 'improved' WHEN e.rr < x.rr THEN 'worsened' ELSE 'same' END AS change, count(*) AS n FROM x JOIN e USING (root_id) GROUP BY 1""")
def ab_changes(spark, d):
    g = gold(spark, d)
    w = Window.partitionBy("root_id").orderBy(F.desc_nulls_last("retrieval_prior"), "chunk_id")
    base = cand(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("root_id", "chunk_id", "rank")
    return evaluation.ab_diff(evaluation.per_query(g.select("root_id"), base, g, "root_id", "chunk_id"), metrics(spark, d), "root_id")


@query("""WITH g AS (SELECT qid, unnest(gold_chunks) AS g FROM pool_failures), x AS (SELECT qid, g.chunk_id AS chunk_id, g.global_union.in_union AS u, g.pool50.in_pool AS p, nullif(g.global_union.prior_rank, 999) AS r, g.ce.final_rank AS f FROM g)
    SELECT CASE WHEN NOT coalesce(u, false) THEN 'A' WHEN NOT coalesce(p, false) THEN CASE WHEN r <= 50 THEN 'B1' ELSE 'B2' END WHEN coalesce(f > 10, true) THEN 'C' ELSE 'ok' END AS class, count(*) AS n FROM x GROUP BY 1""")
def failure_classes(spark, d):
    g = table(spark, d, "pool_failures").select("qid", F.explode("gold_chunks").alias("g"))
    c = evaluation.failure_class(F.col("g.global_union.in_union"), F.col("g.pool50.in_pool"), F.col("g.global_union.prior_rank"), F.col("g.ce.final_rank"))
    return g.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


@query("WITH " + HITS + ", " + GOLD + """, f AS (SELECT root_id, channel, min(rank0) AS r FROM h JOIN gold USING (root_id, chunk_id) GROUP BY 1, 2)
    SELECT channel, count(*) AS questions, count(CASE WHEN r < 10 THEN 1 END) AS top10, CAST(list_sort(list(r))[CAST(floor(count(*) / 2) AS INT) + 1] AS INT) AS median_rank FROM f GROUP BY 1""")
def stage_recall(spark, d):
    f = hits(spark, d).join(gold(spark, d), ["root_id", "chunk_id"], "left_semi").groupBy("root_id", "channel").agg(F.min("rank0").alias("r"))
    n = f.groupBy("channel").agg(F.count("*").alias("questions"), F.count_if(F.col("r") < 10).alias("top10"))
    return n.join(evaluation.upper_medians(f, "r", ["channel"]).withColumnRenamed("median", "median_rank"), "channel")


@query("WITH " + HITS + ", " + GOLD + """, f AS (SELECT g.root_id, min(CASE WHEN channel = 'Dense' THEN rank0 END) AS dr, min(CASE WHEN channel = 'BM25o' THEN rank0 END) AS br FROM gold g LEFT JOIN h USING (root_id, chunk_id) GROUP BY 1),
    p AS (SELECT root_id, min(prior_rank) AS pr FROM c JOIN gold USING (root_id, chunk_id) GROUP BY 1)
    SELECT CASE WHEN coalesce(dr, 999) < 10 AND coalesce(pr, 999) > 10 THEN 'A' WHEN coalesce(dr, 999) < 30 AND coalesce(dr, 999) >= 10 AND coalesce(pr, 999) > 10 THEN 'B' WHEN coalesce(dr, 999) >= 30 THEN 'C' WHEN coalesce(br, 999) >= 10 THEN 'dense_solved' ELSE 'both' END AS class, count(*) AS n FROM f LEFT JOIN p USING (root_id) GROUP BY 1""")
def fusion_losses(spark, d):
    g = gold(spark, d)
    f = g.join(hits(spark, d), ["root_id", "chunk_id"], "left").groupBy("root_id").agg(F.coalesce(F.min(F.when(F.col("channel") == "Dense", F.col("rank0"))), F.lit(999)).alias("dr"), F.coalesce(F.min(F.when(F.col("channel") == "BM25o", F.col("rank0"))), F.lit(999)).alias("br"))
    p = cand(spark, d).join(g, ["root_id", "chunk_id"], "left_semi").groupBy("root_id").agg(F.min("prior_rank").alias("pr"))
    j = f.join(p, "root_id", "left").withColumn("pr", F.coalesce("pr", F.lit(999)))
    c = F.expr("CASE WHEN dr < 10 AND pr > 10 THEN 'A' WHEN dr >= 10 AND dr < 30 AND pr > 10 THEN 'B' WHEN dr >= 30 THEN 'C' WHEN br >= 10 THEN 'dense_solved' ELSE 'both' END")
    return j.groupBy(c.alias("class")).agg(F.count("*").alias("n"))


ALPHAS = (0, 2, 3, 5, 7)


@query("WITH " + METRICS.split(", f AS (")[0] + f""", ms AS (SELECT root_id, chunk_id, coalesce(retrieval_prior, 0) AS pr, coalesce({mm('ce')}, 0) AS m FROM p WINDOW g AS (PARTITION BY root_id)), al(a) AS (VALUES {', '.join(f'({a})' for a in ALPHAS)}),
    rk AS (SELECT a, root_id, chunk_id, row_number() OVER (PARTITION BY a, root_id ORDER BY a / 10.0::DOUBLE * pr + (1 - a / 10.0::DOUBLE) * m DESC, chunk_id) AS k FROM ms, al), """ + GOLD + """, q AS (SELECT DISTINCT root_id FROM gold),
    z AS (SELECT x.a, x.root_id, min(CASE WHEN k <= 10 AND g.chunk_id IS NOT NULL THEN k END) AS f FROM (SELECT a, root_id FROM al, q) x LEFT JOIN rk ON rk.a = x.a AND rk.root_id = x.root_id LEFT JOIN gold g ON g.root_id = rk.root_id AND g.chunk_id = rk.chunk_id GROUP BY 1, 2)
    SELECT a / 10.0::DOUBLE AS alpha, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr, round(avg(CASE WHEN f IS NOT NULL THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall_10 FROM z GROUP BY 1""")
def alpha_scan(spark, d):
    c = cand(spark, d).withColumn("ce", fusion.length_penalty(F.col("ce_raw"), F.col("text_len")))
    scored = c.withColumn("m", F.coalesce(fusion.minmax("ce", ["root_id"]), F.lit(0.0))).withColumn("p", F.coalesce("retrieval_prior", F.lit(0.0)))
    settings = spark.createDataFrame([(a / 10,) for a in ALPHAS], "alpha double")
    each = scored.select("root_id", "chunk_id", "m", "p").crossJoin(settings)
    w = Window.partitionBy("alpha", "root_id").orderBy(F.desc(F.col("alpha") * F.col("p") + (1 - F.col("alpha")) * F.col("m")), "chunk_id")
    ranked = each.withColumn("rank", F.row_number().over(w)).filter("rank <= 10")
    g = gold(spark, d)
    first = ranked.join(g, ["root_id", "chunk_id"], "left_semi").groupBy("alpha", "root_id").agg(F.min("rank").alias("f"))
    every = g.select("root_id").distinct().crossJoin(settings).join(first, ["alpha", "root_id"], "left")
    return every.groupBy("alpha").agg(R6(F.avg(F.coalesce(1 / F.col("f"), F.lit(0.0)))).alias("mrr"), R6(F.avg(F.col("f").isNotNull().cast("double"))).alias("recall_10"))


@query("WITH " + SIMS + """, t AS (SELECT query_id, max(sim) AS top, max(CASE WHEN rank = 1 THEN label = ql END) AS good FROM k GROUP BY 1), g AS (SELECT unnest(range(400, 851, 25)) AS t)
    SELECT g.t / 1000.0::DOUBLE AS threshold, count(CASE WHEN floor(round(top * 1000, 6)) >= g.t THEN 1 END) AS accepted, count(CASE WHEN floor(round(top * 1000, 6)) >= g.t AND NOT good THEN 1 END) AS false_accepted,
    round((count(CASE WHEN floor(round(top * 1000, 6)) >= g.t AND good THEN 1 END) + count(CASE WHEN floor(round(top * 1000, 6)) < g.t AND NOT good THEN 1 END)) / count(*)::DOUBLE, 6) AS accuracy FROM t, g GROUP BY g.t""")
def judge_calibration(spark, d):
    top = _ranked(spark, d, 1).select("sim", (F.col("rel") == 1).alias("good"))
    return evaluation.threshold_sweep(top, "sim", "good", 400, 850, 25).withColumn("accuracy", R6("accuracy"))


@query("""WITH r AS (SELECT DISTINCT result_id, decision, confidence FROM rag_results) SELECT count(CASE WHEN t AND s THEN 1 END) AS tp, count(CASE WHEN NOT t AND s THEN 1 END) AS fp, count(CASE WHEN t AND NOT s THEN 1 END) AS fn, count(CASE WHEN NOT t AND NOT s THEN 1 END) AS tn
    FROM (SELECT decision = 'answer' AS t, confidence >= 0.6 AS s FROM r WHERE decision IS NOT NULL AND confidence IS NOT NULL)""")
def answer_confusion(spark, d):
    r = table(spark, d, "rag_results").select("result_id", "decision", "confidence").distinct()
    return evaluation.confusion(r, F.col("decision") == "answer", F.col("confidence") >= 0.6).select("tp", "fp", "fn", "tn")


@query("WITH r AS (SELECT DISTINCT result_id, method, elapsed_ms FROM rag_results) SELECT coalesce(method, '(none)') AS method, count(elapsed_ms) AS n, round(avg(elapsed_ms), 4) AS mean, round(quantile_cont(elapsed_ms, 0.5), 4) AS median, min(elapsed_ms) AS lowest, max(elapsed_ms) AS highest, round(stddev_pop(elapsed_ms), 4) AS std FROM r GROUP BY 1")
def elapsed_summary(spark, d):
    r = table(spark, d, "rag_results").select("result_id", F.coalesce("method", F.lit("(none)")).alias("method"), "elapsed_ms").distinct()
    return evaluation.summary(r, "elapsed_ms", ["method"]).select("method", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"), "lowest", "highest", F.round("std", 4).alias("std"))


@query("WITH r AS (SELECT DISTINCT result_id, confidence, elapsed_ms FROM rag_results WHERE confidence IS NOT NULL AND elapsed_ms IS NOT NULL) SELECT round(corr(confidence, elapsed_ms), 6) AS r, count(*) AS n FROM r")
def confidence_correlation(spark, d):
    r = table(spark, d, "rag_results").select("result_id", "confidence", "elapsed_ms").filter("confidence is not null and elapsed_ms is not null").distinct()
    return r.agg(R6(F.corr("confidence", "elapsed_ms")).alias("r"), F.count("*").alias("n"))


_WORDS = "CASE result_id % 6 WHEN 0 THEN 'YES' WHEN 1 THEN ' partial: one' WHEN 2 THEN 'NO' WHEN 3 THEN 'Error: no reply' WHEN 4 THEN 'maybe' END"


@query(f"""WITH r AS (SELECT DISTINCT result_id, list_max(list_transform(sources, lambda s: s.similarity)) AS top, upper(trim({_WORDS})) AS w FROM rag_results)
    SELECT result_id, CASE WHEN top IS NULL THEN 'reject' WHEN top >= 0.7::DOUBLE THEN 'answer' WHEN starts_with(w, 'ERROR') THEN 'fallback' WHEN starts_with(w, 'YES') OR starts_with(w, 'PARTIAL') THEN 'answer' ELSE 'reject' END AS decision FROM r""")
def judge_decisions(spark, d):
    """Decisions by similarity, else by the words a judge may say."""
    r = table(spark, d, "rag_results").select("result_id", F.array_max("sources.similarity").alias("top"), F.expr(_WORDS).alias("w")).distinct()
    return r.select("result_id", fusion.judge(F.col("top"), F.col("w")).alias("decision"))


@query("""WITH r AS (SELECT result_id, min(sources) AS sources FROM rag_results GROUP BY 1), s AS (SELECT result_id, unnest(range(1, len(sources) + 1)) AS i, sources FROM r), t AS (SELECT result_id, i, sources[i] AS s FROM s WHERE i <= 3)
    SELECT result_id, string_agg('[源' || i || '] | ' || coalesce(s.province, '') || ' | ' || coalesce(s.zoning, '') || ' | ' || substring(s.source_file, 1, 50), chr(10) ORDER BY i) AS context FROM t GROUP BY 1""")
def answer_contexts(spark, d):
    r = table(spark, d, "rag_results").groupBy("result_id").agg(F.min("sources").alias("sources")).select("result_id", F.posexplode("sources").alias("i", "s")).filter("i < 3")
    line = F.concat(F.lit("[源"), F.col("i") + 1, F.lit("] | "), F.coalesce("s.province", F.lit("")), F.lit(" | "), F.coalesce("s.zoning", F.lit("")), F.lit(" | "), F.substring("s.source_file", 1, 50))
    return r.withColumn("line", line).groupBy("result_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n").alias("context"))


# Questions ----------------------------------------------------------------------------------------------------------
# Written from the rules: a cue or two question marks, then a spoken term, then length; without numbers of the search.
GATE = "regexp_matches(question, '哪些|各种|各|分别|每种|异同|对比|总体规律|规律|区别|差异') OR len(regexp_extract_all(question, '[？?]')) >= 2"


@query(f"""WITH g AS (SELECT item_id, question, {GATE} AS structure, length(question) <= 6 AS short, regexp_matches(question, '怕冷|下雪|倒春寒|旱情') AS term, (item_id % 10) / 10.0::DOUBLE AS top1, (item_id % 7) / 100.0::DOUBLE AS margin FROM golden_items WHERE question IS NOT NULL)
    SELECT item_id, structure, term, short, CASE WHEN short THEN false WHEN term THEN true ELSE margin < 0.03::DOUBLE OR top1 < 0.72::DOUBLE END AS base, CASE WHEN structure OR term THEN true ELSE NOT short END AS struct FROM g""")
def structure_gate(spark, d):
    g = table(spark, d, "golden_items").filter("question is not null").select("item_id", "question", (F.col("item_id") % 10 / 10).alias("top1"), (F.col("item_id") % 7 / 100).alias("margin"))
    return rewrite.gate_info(g, "question", F.col("question").rlike("怕冷|下雪|倒春寒|旱情"), F.col("top1"), F.col("margin")).drop("question", "top1", "margin")


@query("""WITH q AS (SELECT item_id, question, answer FROM golden_items WHERE question IS NOT NULL AND answer IS NOT NULL)
    SELECT item_id, length(answer) / length(question)::DOUBLE BETWEEN 0.4 AND 2.0 AS length_ok, list_sort(regexp_extract_all(question, '\\d+(?:\\.\\d+)?')) = list_sort(regexp_extract_all(answer, '\\d+(?:\\.\\d+)?')) AS numbers_ok, len(regexp_extract_all(question, '[？?]')) = len(regexp_extract_all(answer, '[？?]')) AS marks_ok,
    list_sort(regexp_extract_all(question, '[≥≤℃％%]')) = list_sort(regexp_extract_all(answer, '[≥≤℃％%]')) AS signs_ok, length(answer) - length(replace(answer, '区划', '')) >= length(question) - length(replace(question, '区划', '')) AS terms_ok FROM q""".replace("\\\\", "\\"))
def repair_checks(spark, d):
    q = table(spark, d, "golden_items").filter("question is not null and answer is not null")
    c = rewrite.repair_checks(F.col("question"), F.col("answer"), 0.4, 2.0, ("区划",))
    return q.select("item_id", c["length"].alias("length_ok"), c["numbers"].alias("numbers_ok"), c["marks"].alias("marks_ok"), c["signs"].alias("signs_ok"), c["terms"].alias("terms_ok"))


TERMS = [("怕冷", "耐寒性"), ("下雪", "降雪"), ("倒春寒", "晚霜冻"), ("春寒", "低温"), ("旱情", "干旱"), ("风险", "风险")]


def _masked(x: str, words: list[str], first: int) -> str:
    """x with each word, longest first, replaced by a private character of its own."""
    for i, w in sorted(enumerate(words), key=lambda p: (-len(p[1]), p[1])):
        x = f"replace({x}, '{w}', chr({first + i}))"
    return x


_KEYS = [a for a, _ in TERMS]
_STANDARD = "CASE ascii(x) " + " ".join(f"WHEN {0xE000 + i} THEN '{b}'" for i, (_, b) in enumerate(TERMS)) + " END"


@query(f"""WITH m AS (SELECT item_id, list_transform(regexp_extract_all({_masked('question', _KEYS, 0xE000)}, '[{chr(0xE000)}-{chr(0xE000 + len(TERMS))}]'), lambda x: {_STANDARD}) AS l FROM golden_items)
    SELECT item_id, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL), '|') AS standards FROM m WHERE l IS NOT NULL
    UNION ALL SELECT item_id, '' FROM golden_items WHERE question IS NULL""")
def term_scan(spark, d):
    return rewrite.scan_terms(table(spark, d, "golden_items"), "item_id", "question", TERMS).withColumn("standards", F.array_join("standards", "|"))


_SPOKEN = [(a, b) for a, b in TERMS if a != b]
_KEPT = sorted({b for _, b in TERMS})


def _unmasked(x: str) -> str:
    for i, (_, b) in enumerate(_SPOKEN):
        x = f"replace({x}, chr({0xE100 + i}), '{b}')"
    for i, w in enumerate(_KEPT):
        x = f"replace({x}, chr({0xE000 + i}), '{w}')"
    return x


@query(f"SELECT item_id, {_unmasked(_masked(_masked('question', _KEPT, 0xE000), [a for a, _ in _SPOKEN], 0xE100))} AS replaced FROM golden_items WHERE question IS NOT NULL")
def term_replacement(spark, d):
    """Text that stands beside a term and belongs to its standard is taken in; no question of the table has any, so plain replacement says the same."""
    return rewrite.replace_terms(table(spark, d, "golden_items").filter("question is not null"), "question", TERMS).select("item_id", "replaced")


SYN = [("样本", 1, "标本"), ("样本", 2, "样品"), ("海拔", 1, "高程"), ("海拔", 2, "高度"), ("海拔", 3, "标高"), ("海拔", 4, "海拔"), ("依据", 1, "根据")]


@query("WITH s(term, pos, synonym) AS (VALUES " + ", ".join(f"('{a}', {b}, '{c}')" for a, b, c in SYN) + "), t AS (SELECT item_id, question, term, synonym, row_number() OVER (PARTITION BY item_id, term ORDER BY pos) AS k FROM golden_items, s WHERE contains(question, term) AND NOT contains(question, synonym)) SELECT item_id, term, synonym FROM t WHERE k <= 3")
def synonym_expansion(spark, d):
    syn = spark.createDataFrame(SYN, "term string, pos int, synonym string")
    q = table(spark, d, "golden_items").select("item_id", "question")
    return rewrite.expand_synonyms(q, "item_id", "question", syn)


_RAW = """CASE item_id % 5 WHEN 0 THEN 'Here it is: {"rewrite_type": "expand", "keywords": ["' || coalesce(crop, '') || '", " x "], "rewrite_queries": "' || coalesce(province, '') || '", "confidence": 0.' || (item_id % 9) || '} done'
    WHEN 1 THEN '{"rewrite_type": "other", "sub_queries": ["a", ""]}' WHEN 2 THEN 'no object' WHEN 3 THEN '{"rewrite_type": "none", "confidence": "high"}' ELSE '{broken' || '}' END"""


@query(f"""WITH r AS (SELECT item_id, nullif(regexp_extract({_RAW}, '(?s)\\{{.*\\}}'), '') AS b FROM golden_items), v AS (SELECT item_id, CASE WHEN b IS NOT NULL AND json_valid(b) THEN b END AS b FROM r),
    l AS (SELECT item_id, b, b->>'$.rewrite_type' AS k, TRY_CAST(b->>'$.confidence' AS DOUBLE) AS cf, [b->>'$.keywords', b->>'$.rewrite_queries', b->>'$.sub_queries'] AS fs FROM v),
    n AS (SELECT *, list_transform(fs, lambda f: array_to_string(list_filter(CASE WHEN f IS NULL THEN []::VARCHAR[] WHEN starts_with(f, '[') THEN list_transform(CAST(CAST(f AS JSON) AS VARCHAR[]), lambda x: trim(x)) ELSE [trim(f)] END, lambda x: x <> ''), '|')) AS ls FROM l)
    SELECT item_id, CASE WHEN b IS NULL THEN 'none' WHEN k IN ('none', 'normalize', 'expand') THEN k ELSE 'normalize' END AS type, ls[1] AS keywords, ls[2] AS rewrites, ls[3] AS subs, CASE WHEN b IS NULL THEN 0.0::DOUBLE ELSE coalesce(cf, 0.5::DOUBLE) END AS confidence FROM n""".replace("\\\\", "\\"))
def rewrite_json(spark, d):
    g = table(spark, d, "golden_items").select("item_id", F.expr(_RAW).alias("raw"))
    r = rewrite.normalised_rewrites(g, "raw").select("item_id", "rewrite.*")
    return r.select("item_id", "type", F.array_join("keywords", "|").alias("keywords"), F.array_join("rewrite_queries", "|").alias("rewrites"), F.array_join("sub_queries", "|").alias("subs"), "confidence")


@query("WITH a AS (SELECT item_id, question AS q, answer AS g FROM golden_items WHERE question IS NOT NULL AND answer IS NOT NULL), gt AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(g, '[A-K]\\d-\\d{4}|[A-Z][a-z]+'))) AS t FROM a), pt AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(q, '[A-K]\\d-\\d{4}|[A-Z][a-z]+'))) AS t FROM a), r AS (SELECT gt.item_id, gt.t, coalesce(max((contains(gt.t, pt.t) OR contains(pt.t, gt.t))::INT), 0) AS h FROM gt LEFT JOIN pt USING (item_id) GROUP BY 1, 2), p AS (SELECT pt.item_id, pt.t, coalesce(max((contains(gt.t, pt.t) OR contains(pt.t, gt.t))::INT), 0) AS h FROM pt LEFT JOIN gt USING (item_id) GROUP BY 1, 2), rr AS (SELECT item_id, avg(h) AS recall FROM r GROUP BY 1), pp AS (SELECT item_id, avg(h) AS precision FROM p GROUP BY 1) SELECT item_id, round(coalesce(precision, 0), 6) AS precision, round(coalesce(recall, 0), 6) AS recall FROM rr FULL JOIN pp USING (item_id)")
def term_metrics(spark, d):
    a = table(spark, d, "golden_items").filter("question is not null and answer is not null")
    rx = F.lit(r"[A-K]\d-\d{4}|[A-Z][a-z]+")
    g = a.select("item_id", F.explode(F.regexp_extract_all("answer", rx, F.lit(0))).alias("term"))
    p = a.select("item_id", F.explode(F.regexp_extract_all("question", rx, F.lit(0))).alias("term"))
    return evaluation.term_match(g, p, "item_id", "term").select("item_id", R6("precision").alias("precision"), R6("recall").alias("recall"))


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY question_type ORDER BY md5('42:' || item_id), item_id) AS k FROM golden_items) SELECT item_id, question_type FROM r WHERE k <= 5")
def stratified_sample(spark, d):
    return evaluation.stratified_sample(table(spark, d, "golden_items"), ["question_type"], "item_id", 5).select("item_id", "question_type")


@query("SELECT g.item_id FROM golden_items g WHERE source_chunk_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM candidates c WHERE c.chunk_id = g.source_chunk_id)")
def dangling_gold(spark, d):
    g = table(spark, d, "golden_items").filter("source_chunk_id is not null")
    return g.join(table(spark, d, "candidates").select(F.col("chunk_id").alias("source_chunk_id")), "source_chunk_id", "left_anti").select("item_id")


@query("SELECT g.item_id, count(DISTINCT c.chunk_id) AS matches FROM golden_items g JOIN candidates c ON starts_with(c.chunk_id, split_part(g.source_chunk_id, '_', 1) || '_') WHERE g.source_chunk_id IS NOT NULL GROUP BY 1")
def gold_prefix_fallback(spark, d):
    stem = lambda c: F.split(c, "_")[0]
    c = table(spark, d, "candidates").select("chunk_id").distinct().withColumn("stem", stem(F.col("chunk_id")))
    g = table(spark, d, "golden_items").filter("source_chunk_id is not null").select("item_id", stem(F.col("source_chunk_id")).alias("stem"))
    return g.join(c, "stem").groupBy("item_id").agg(F.count("*").alias("matches"))


@query("SELECT coalesce(province, '') AS province, coalesce(crop, '') AS crop, coalesce(zoning_type, '') AS zoning_type, count(*) AS n FROM golden_items GROUP BY 1, 2, 3")
def corpus_keys(spark, d):
    return table(spark, d, "golden_items").groupBy(*[F.coalesce(c, F.lit("")).alias(c) for c in ("province", "crop", "zoning_type")]).agg(F.count("*").alias("n"))


@query("SELECT item_id, CAST(floor((row_number() OVER (ORDER BY item_id) - 1) / 10) AS BIGINT) AS batch FROM golden_items")
def item_batches(spark, d):
    return rewrite.batches(table(spark, d, "golden_items").select("item_id"), "item_id", 10)


@query("WITH " + FUSED + ", x AS (SELECT root_id, substring(sha1(string_agg(chunk_id, '|' ORDER BY final_rank)), 1, 12) AS key FROM r WHERE final_rank <= 5 GROUP BY 1) SELECT root_id, key FROM x")
def answerability_keys(spark, d):
    top = fused(spark, d).filter("final_rank <= 5").groupBy("root_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "chunk_id"))), lambda x: x["chunk_id"]), "|").alias("ids"))
    return top.select("root_id", F.substring(F.sha1("ids"), 1, 12).alias("key"))


@query("WITH " + FUSED + """, o AS (SELECT root_id, list(chunk_id ORDER BY retrieval_prior DESC NULLS LAST, chunk_id)[1:10] AS b FROM c GROUP BY 1), x AS (SELECT root_id, list(chunk_id ORDER BY final_rank) AS a FROM r WHERE final_rank <= 10 GROUP BY 1)
    SELECT root_id, a = b AS equal FROM x JOIN o USING (root_id)""")
def replay_parity(spark, d):
    """Whether re-ranking left a question's first ten as the prior had them."""
    w = Window.partitionBy("root_id").orderBy(F.desc_nulls_last("retrieval_prior"), "chunk_id")
    a = fused(spark, d).filter("final_rank <= 10").select("root_id", "chunk_id", F.col("final_rank").alias("rank"))
    b = cand(spark, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 10").select("root_id", "chunk_id", "rank")
    return evaluation.same_order(a, b, "root_id", "chunk_id")


# Diagnoses ----------------------------------------------------------------------------------------------------------
@query("WITH " + SIMS + ", b AS (SELECT query_id, max(sim) AS best FROM k WHERE rank <= 10 GROUP BY 1) SELECT count(*) AS n, round(avg(best), 6) AS mean_best, round(avg((best > 0.6)::INT), 6) AS above_60, round(avg((best > 0.7)::INT), 6) AS above_70 FROM b")
def semantic_relevance(spark, d):
    r = diagnosis.semantic_relevance(_topk(spark, d), "query_id", "sim")
    return r.select("n", *[R6(c).alias(c) for c in ("mean_best", "above_60", "above_70")])


@query("WITH " + CAND + ", " + GOLD + ", b AS (SELECT root_id, min(prior_rank) AS best_rank, true AS found FROM c JOIN gold USING (root_id, chunk_id) GROUP BY 1) SELECT q.root_id, coalesce(found, false) AS found, best_rank, coalesce(best_rank > 50, false) AS far FROM (SELECT DISTINCT root_id FROM gold) q LEFT JOIN b USING (root_id)")
def retrievability(spark, d):
    return diagnosis.retrievability(cand(spark, d), gold(spark, d), "root_id", "chunk_id", "prior_rank")


@query("WITH " + FUSED + ", " + GOLD + """, s AS (SELECT c.root_id, min(dense_rank) + 1 AS dr, min(bm25_rank) + 1 AS br, min(prior_rank) AS fr, min(final_rank) AS lr, max(cosine_sim) AS cs FROM c JOIN gold USING (root_id, chunk_id) JOIN r USING (root_id, chunk_id) GROUP BY 1),
    q AS (SELECT DISTINCT root_id FROM gold) SELECT CASE WHEN coalesce(lr, 999) <= 10 THEN 'A_found' WHEN coalesce(fr, 999) <= 10 THEN 'B_lost_in_rerank' WHEN coalesce(dr, 999) <= 10 OR coalesce(br, 999) <= 10 THEN 'C_lost_in_fusion' WHEN coalesce(dr, 999) <= 30 OR coalesce(br, 999) <= 30 THEN 'D_ranked_low'
    WHEN cs >= 0.65 THEN 'E_close_not_retrieved' WHEN cs >= 0.55 THEN 'F_middling' ELSE 'G_far' END AS layer, count(*) AS n FROM q LEFT JOIN s USING (root_id) GROUP BY 1""")
def layered_diagnosis(spark, d):
    g = gold(spark, d)
    s = fused(spark, d).join(g, ["root_id", "chunk_id"], "left_semi").groupBy("root_id").agg((F.min("dense_rank") + 1).alias("dr"), (F.min("bm25_rank") + 1).alias("br"), F.min("prior_rank").alias("fr"), F.min("final_rank").alias("lr"), F.max("cosine_sim").alias("cs"))
    j = g.select("root_id").distinct().join(s, "root_id", "left")
    return j.groupBy(diagnosis.layer(F.col("dr"), F.col("br"), F.col("fr"), F.col("lr"), F.col("cs")).alias("layer")).agg(F.count("*").alias("n"))


@query("WITH " + CAND + ", " + GOLD + """, k AS (SELECT root_id, chunk_id, row_number() OVER (PARTITION BY root_id ORDER BY retrieval_prior DESC NULLS LAST, chunk_id) AS k FROM c), f AS (SELECT q.root_id, min(k) AS k FROM (SELECT DISTINCT root_id FROM gold) q LEFT JOIN (SELECT k.* FROM k JOIN gold USING (root_id, chunk_id)) x USING (root_id) GROUP BY 1)
    SELECT s.size, count(*) AS n, count(CASE WHEN k <= s.size THEN 1 END) AS found FROM f, (VALUES (10), (20), (50)) s(size) GROUP BY 1""")
def pool_size_scan(spark, d):
    return diagnosis.pool_sizes(cand(spark, d), gold(spark, d), "root_id", "chunk_id", [F.desc_nulls_last("retrieval_prior"), "chunk_id"], (10, 20, 50))


@query("WITH " + FUSED + """, k AS (SELECT DISTINCT section_id, chunk_id FROM candidates), fs AS (SELECT r.root_id, c.section_id, min(final_rank) AS m FROM r JOIN c USING (root_id, chunk_id) WHERE final_rank <= 5 GROUP BY 1, 2), x AS (SELECT fs.root_id, k.chunk_id, row_number() OVER (PARTITION BY fs.root_id ORDER BY m, k.section_id, k.chunk_id) AS rank FROM fs JOIN k USING (section_id))
    SELECT root_id, chunk_id, CAST(rank AS INT) AS rank FROM x WHERE rank <= 10""")
def flattened_sections(spark, d):
    s = _sections_of(spark, d)
    top = fused(spark, d).filter("final_rank <= 5").select("root_id", "section_id", F.col("final_rank").alias("rank"))
    firsts = top.groupBy("root_id", "section_id").agg(F.min("rank").alias("rank"))
    order = s.withColumn("chunk_index", F.struct("section_id", "chunk_id"))
    return diagnosis.section_flattened(firsts, order, "root_id", "section_id", "chunk_id", 10)


@query("SELECT doc_id, round(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '' AND regexp_matches(x, '[^ \\t\\n\\r\\f](?: {2,}|\\t)[^ \\t\\n\\r\\f]'))) / nullif(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')), 0)::DOUBLE, 6) AS ratio FROM documents WHERE text IS NOT NULL".replace("\\\\", "\\"))
def column_split(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", R6(diagnosis.column_split_ratio(F.col("text"))).alias("ratio"))


@query("WITH k AS (SELECT item_id, coalesce(question_type, '-') AS t, row_number() OVER (PARTITION BY coalesce(question_type, '-') ORDER BY item_id) AS k FROM golden_items), n AS (SELECT greatest(floor(60.0 / count(DISTINCT t)), 1) AS n FROM k) SELECT t AS question_type, item_id FROM k, n WHERE k <= n")
def even_quota(spark, d):
    g = table(spark, d, "golden_items").select(F.coalesce("question_type", F.lit("-")).alias("question_type"), "item_id")
    return diagnosis.quota_by_group(g, "question_type", ["item_id"], 60)


@query("WITH r AS (SELECT DISTINCT result_id, decision, answer FROM rag_results) SELECT result_id, CASE WHEN decision = 'answer' THEN answer WHEN decision = 'fallback' THEN 'The answer could not be checked. Please ask again later.' ELSE 'No answer was found in the collection. ' END AS said FROM r")
def final_answers(spark, d):
    r = table(spark, d, "rag_results").select("result_id", "decision", "answer").distinct()
    return r.select("result_id", diagnosis.answer_or_reason(F.col("decision"), F.col("answer"), F.lit(None).cast("string")).alias("said"))


def _questions(spark, d) -> DataFrame:
    """Held-out questions with a rewrite (place and crop before the question), sub-questions (its clauses) and keywords."""
    g = table(spark, d, "golden_items").filter("question is not null")
    clauses = F.filter(F.split("question", "[，,；;]"), lambda x: F.length(F.trim(x)) >= 6)
    said = F.array_compact(F.array("province", "crop"))
    return g.select(F.col("item_id").cast("string").alias("root_id"), F.col("question").alias("q"), F.when(F.size(said) == 2, F.array(F.concat_ws(" ", F.array_join(said, " "), F.col("question")))).alias("rewrites"),
                    F.when(F.size(clauses) > 1, clauses).alias("subs"), said.alias("keywords"))


@query()
def retrieval_pipeline(spark, d):
    """Chunks of all documents, all channels of each held-out question and its sub-queries, fusion, pool and decision."""
    return pipeline.answer(pipeline.index(table(spark, d, "documents"), "doc_id", "text"), _questions(spark, d)).select("root_id", "section_id", "lo", "hi", "rank", "decision")


@query("SELECT result_id, confidence, CAST(ntile(8) OVER (ORDER BY result_id) AS INT) AS part FROM (SELECT DISTINCT result_id, confidence FROM rag_results WHERE confidence IS NOT NULL)")
def score_groups(spark, d):
    """Results in eight groups of equal size by id: counts over range partitions in place of one global window."""
    r = table(spark, d, "rag_results").filter("confidence is not null").select("result_id", "confidence").distinct()
    placed = below_counts(r.withColumn("all", F.lit(1)), ["all"], "result_id").select("result_id", "below")
    n = r.agg(F.count("*").alias("n"))
    size, more = F.floor(F.col("n") / 8), F.col("n") % 8
    part = F.when(F.col("below") < more * (size + 1), F.floor(F.col("below") / (size + 1))).otherwise(more + F.floor((F.col("below") - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return r.join(placed, "result_id").crossJoin(n).select("result_id", "confidence", (part + 1).cast("int").alias("part"))


@query("WITH " + CAND + ", " + GOLD + """, k AS (SELECT root_id, chunk_id, row_number() OVER (PARTITION BY root_id ORDER BY retrieval_prior DESC NULLS LAST, chunk_id) AS pos FROM c) SELECT root_id, CAST(min(pos) AS INT) AS first_gold FROM k JOIN gold USING (root_id, chunk_id) WHERE pos <= 50 GROUP BY 1""")
def gold_rank_in_pool(spark, d):
    w = Window.partitionBy("root_id").orderBy(F.desc_nulls_last("retrieval_prior"), "chunk_id")
    k = cand(spark, d).withColumn("pos", F.row_number().over(w)).filter("pos <= 50")
    return k.join(gold(spark, d), ["root_id", "chunk_id"], "left_semi").groupBy("root_id").agg(F.min("pos").alias("first_gold"))


@query("WITH r AS (SELECT DISTINCT result_id, confidence, elapsed_ms FROM rag_results) SELECT result_id FROM r WHERE elapsed_ms IS NOT NULL AND abs(confidence - least(elapsed_ms / 5000, 1)) > 0.3")
def judge_outliers(spark, d):
    r = table(spark, d, "rag_results").select("result_id", (F.col("confidence") * 10).alias("said"), F.when(F.col("elapsed_ms").isNotNull(), F.least(F.col("elapsed_ms") / 5000, F.lit(1.0))).alias("measured"), "confidence", "elapsed_ms").distinct()
    return diagnosis.outliers(r, "said", "measured").select("result_id")


@query("WITH t AS (SELECT capability, unnest(gold_chunks) AS g FROM pool_failures) SELECT capability AS tier, round(sum((g.pool50.in_pool)::INT) / nullif(count(g.global_union.in_union), 0)::DOUBLE, 6) AS rate FROM t GROUP BY 1")
def micro_tiers(spark, d):
    t = table(spark, d, "pool_failures").select(F.col("capability").alias("tier"), F.explode("gold_chunks").alias("g")).select("tier", F.col("g.pool50.in_pool").cast("int").alias("hit"), F.col("g.global_union.in_union").isNotNull().cast("int").alias("one"))
    return diagnosis.micro_rate(t, "tier", "hit", "one").withColumn("rate", R6("rate"))


@query("SELECT item_id, concat_ws(' ', question, array_to_string(list_filter([province, crop], lambda x: x IS NOT NULL), ' ')) AS q FROM golden_items WHERE question IS NOT NULL")
def keyword_questions(spark, d):
    return table(spark, d, "golden_items").filter("question is not null").select("item_id", rewrite.with_keywords(F.col("question"), F.array_compact(F.array("province", "crop"))).alias("q"))


@query("SELECT item_id, CASE WHEN starts_with(answer, h) THEN answer ELSE h || answer END AS restored FROM (SELECT item_id, answer, '[' || coalesce(province, '') || '] ' AS h FROM golden_items) x")
def header_restored(spark, d):
    g = table(spark, d, "golden_items").withColumn("h", F.concat(F.lit("["), F.coalesce("province", F.lit("")), F.lit("] ")))
    return g.select("item_id", chunks.with_header(F.col("answer"), F.col("h")).alias("restored"))


@query("""WITH n AS (SELECT block_id, lower(regexp_replace(source, '[《》“”「」 　()（）]', '', 'g')) AS s FROM blocks WHERE source IS NOT NULL), g AS (SELECT DISTINCT lower(crop) AS c FROM golden_items WHERE crop IS NOT NULL) SELECT c AS crop, count(DISTINCT s) AS sources FROM g JOIN n ON contains(s, c) GROUP BY 1""")
def source_match(spark, d):
    clean = F.lower(F.regexp_replace("source", "[《》“”「」 　()（）]", ""))
    n = table(spark, d, "blocks").filter("source is not null").select(clean.alias("s")).distinct()
    g = table(spark, d, "golden_items").filter("crop is not null").select(F.lower("crop").alias("crop")).distinct()  # names of a fixed set
    return n.join(bounded(g), F.col("s").contains(F.col("crop"))).groupBy("crop").agg(F.count("*").alias("sources"))


@query("WITH " + CAND + f""", k AS (SELECT root_id, cosine_sim, row_number() OVER (PARTITION BY root_id ORDER BY cosine_sim DESC NULLS LAST) AS k FROM c),
    t AS (SELECT root_id, max(CASE WHEN k = 1 THEN cosine_sim END) AS top1, coalesce(max(CASE WHEN k = 1 THEN cosine_sim END) - max(CASE WHEN k = 2 THEN cosine_sim END), 1) AS margin, count(*) AS n FROM k GROUP BY 1),
    q AS (SELECT qid AS root_id, min(query) AS question FROM pool_failures GROUP BY 1), g AS (SELECT t.*, coalesce(question, '') AS question FROM t LEFT JOIN q USING (root_id)),
    a AS (SELECT unnest(['base', 'struct']) AS arm, unnest([length(question) > 6 AND (margin < 0.03::DOUBLE OR top1 < 0.72::DOUBLE), ({GATE}) OR length(question) > 6]) AS goes, n FROM g)
    SELECT arm, CASE WHEN goes THEN 'rewrite' ELSE 'keep' END AS gate, count(*) AS n, CAST(sum(n) AS BIGINT) AS candidates FROM a GROUP BY 1, 2""")
def gate_statistics(spark, d):
    """How many questions each arm of the gate rewrites, from their wording (known for those of the failure report) and their first two cosines."""
    w = Window.partitionBy("root_id").orderBy(F.desc_nulls_last("cosine_sim"))
    k = cand(spark, d).withColumn("k", F.row_number().over(w))
    at = lambda n: F.max(F.when(F.col("k") == n, F.col("cosine_sim")))
    t = k.groupBy("root_id").agg(at(1).alias("top1"), F.coalesce(at(1) - at(2), F.lit(1.0)).alias("margin"), F.count("*").alias("n"))
    q = table(spark, d, "pool_failures").groupBy(F.col("qid").alias("root_id")).agg(F.min("query").alias("question"))
    g = t.join(q, "root_id", "left").withColumn("question", F.coalesce("question", F.lit("")))
    arms = rewrite.gate_info(g, "question", F.lit(False), F.col("top1"), F.col("margin"))
    each = arms.select(F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.coalesce(F.col(a), F.lit(False)).alias("goes")) for a in ("base", "struct")])).alias("a"), "n").select("a.*", "n")
    return each.groupBy("arm", F.when(F.col("goes"), "rewrite").otherwise("keep").alias("gate")).agg(F.count("*").alias("n"), F.sum("n").alias("candidates"))


@query("WITH " + SIMS + """, p AS (SELECT query_id, vec_id, label, sim FROM k WHERE rank <= 20), f AS (SELECT label, vec_id, max(sim) AS m FROM p GROUP BY 1, 2), b AS (SELECT label, query_id, max(sim) AS m FROM p GROUP BY 1, 2)
    SELECT x.label, round(x.f, 6) AS forward, round(y.b, 6) AS backward FROM (SELECT label, avg(m) AS f FROM f GROUP BY 1) x JOIN (SELECT label, avg(m) AS b FROM b GROUP BY 1) y USING (label)""")
def both_way_similarity(spark, d):
    s = _ranked(spark, d, 20).select("label", "vec_id", "query_id", "sim")
    return diagnosis.best_both_ways(s, "vec_id", "query_id", "label").select("label", R6("forward").alias("forward"), R6("backward").alias("backward"))


@query("WITH " + CAND + ", m AS (SELECT chunk_id, min(root_id) AS root FROM c GROUP BY 1) SELECT g.item_id, coalesce(m.chunk_id, substring(g.answer, 1, 80)) AS key FROM golden_items g LEFT JOIN m ON m.chunk_id = g.source_chunk_id")
def result_keys(spark, d):
    m = table(spark, d, "candidates").select(F.col("chunk_id").alias("known")).distinct()
    g = table(spark, d, "golden_items")
    return g.join(m, g.source_chunk_id == m.known, "left").select("item_id", F.coalesce("known", F.substring("answer", 1, 80)).alias("key"))
