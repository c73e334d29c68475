"""Queries of evaluation panels, arms, scans, samples, dictionaries and page texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import text as T
from .operators import diagnosis, evaluation, fusion, rewrite
from .plans import pipeline
from .queries import R6, query, table
from .queries_ranking import CAND, GOLD, METRICS, _pools, cand, gold, metrics

#: Metrics of re-ranking (e) and of the prior alone (x), for comparisons.
BOTH = METRICS + """, a AS (SELECT root_id, chunk_id, row_number() OVER (PARTITION BY root_id ORDER BY retrieval_prior DESC NULLS LAST, chunk_id) AS rk FROM c),
    x AS (SELECT q.root_id, coalesce(1.0::DOUBLE / min(CASE WHEN rk <= 10 THEN rk END), 0) AS rr FROM q LEFT JOIN (SELECT a.* FROM a JOIN gold USING (root_id, chunk_id)) z USING (root_id) GROUP BY 1)"""


def _by_prior(spark, d):
    w = Window.partitionBy("root_id").orderBy(F.desc_nulls_last("retrieval_prior"), "chunk_id")
    return cand(spark, d).withColumn("rank", F.row_number().over(w)).select("root_id", "chunk_id", "rank")


def _base(spark, d):
    g = gold(spark, d)
    return evaluation.per_query(g.select("root_id"), _by_prior(spark, d).filter("rank <= 10"), g, "root_id", "chunk_id")


@query("WITH " + BOTH + """, pn AS (SELECT DISTINCT qid AS root_id, unnest([coalesce(capability, '(none)'), CASE WHEN n_union > 30 THEN 'many' ELSE 'few' END]) AS panel FROM pool_failures)
    SELECT panel, count(*) AS n, round(avg(x.rr), 6) AS mrr_a, round(avg(e.rr), 6) AS mrr_b, count(CASE WHEN x.rr = 0 AND e.rr > 0 THEN 1 END) AS rescued, count(CASE WHEN x.rr > 0 AND e.rr = 0 THEN 1 END) AS lost FROM pn JOIN x USING (root_id) JOIN e USING (root_id) GROUP BY 1""")
def panel_comparison(spark, d):
    f = table(spark, d, "pool_failures")
    of = f.select(F.col("qid").alias("root_id"), F.explode(F.array(F.coalesce("capability", F.lit("(none)")), F.when(F.col("n_union") > 30, "many").otherwise("few"))).alias("panel"))
    return evaluation.panels(_base(spark, d), metrics(spark, d), of, "root_id", "panel").withColumns({c: R6(c) for c in ("mrr_a", "mrr_b")})


@query("WITH " + BOTH + ", z AS (SELECT e.rr FROM x JOIN e USING (root_id) WHERE x.rr = 0) SELECT count(*) AS zeros, count(CASE WHEN rr > 0 THEN 1 END) AS rescued, round(count(CASE WHEN rr > 0 THEN 1 END) / nullif(count(*), 0)::DOUBLE, 6) AS rate FROM z")
def rescue_rates(spark, d):
    return evaluation.rescue_rate(_base(spark, d), metrics(spark, d), "root_id").withColumn("rate", R6("rate"))


@query("WITH " + BOTH + ", z AS (SELECT x.rr > 0 AS a, e.rr > 0 AS b FROM x JOIN e USING (root_id)) SELECT count(CASE WHEN NOT a AND b THEN 1 END) AS rescued, count(CASE WHEN a AND NOT b THEN 1 END) AS new_fail, count(CASE WHEN NOT a AND b THEN 1 END) - count(CASE WHEN a AND NOT b THEN 1 END) AS net FROM z")
def layer_changes(spark, d):
    return evaluation.layer_diff(_base(spark, d), metrics(spark, d), "root_id")


def _best(of: str) -> str:
    return f"SELECT alpha, mrr, recall_10 FROM ({of}) ORDER BY recall_10 DESC, mrr DESC, alpha LIMIT 1"


def _alpha_sql() -> str:
    from .queries import SQL

    return _best(SQL["alpha_scan"])


@query(_alpha_sql())
def best_alpha(spark, d):
    from .queries import QUERIES

    return evaluation.best_config(QUERIES["alpha_scan"](spark, d), "alpha", "recall_10", "mrr")


@query("WITH r AS (SELECT DISTINCT result_id, coalesce(method, '(none)') AS method, CASE WHEN confidence IS NULL THEN -1 ELSE CAST(floor(confidence * 4) AS INT) END AS s FROM rag_results) SELECT method, count(*) AS n, round(avg(s), 6) AS mean, round(avg((s = 3)::INT), 6) AS share_3, round(avg((s = 2)::INT), 6) AS share_2, round(avg((s <= 1)::INT), 6) AS share_low FROM r WHERE s >= 0 GROUP BY 1")
def judged_scores(spark, d):
    r = table(spark, d, "rag_results").select("result_id", F.coalesce("method", F.lit("(none)")).alias("method"), F.when(F.col("confidence").isNull(), -1).otherwise(F.floor(F.col("confidence") * 4).cast("int")).alias("s")).distinct()
    return evaluation.score_shares(r, "s", ["method"]).withColumns({c: R6(c) for c in ("mean", "share_3", "share_2", "share_low")})


#: An arm that scored the first ten of each question's prior anew.
ARM = CAND + ", m AS (SELECT *, CASE WHEN prior_rank <= 10 AND ce_raw IS NOT NULL THEN ce_raw * 0.5::DOUBLE ELSE ce_raw END AS s FROM c)"


@query("WITH " + ARM + ", k AS (SELECT root_id, chunk_id, row_number() OVER (PARTITION BY root_id ORDER BY s DESC NULLS LAST, chunk_id) AS r FROM m), " + GOLD + """, f AS (SELECT q.root_id, min(CASE WHEN g.chunk_id IS NOT NULL THEN r END) AS r FROM (SELECT DISTINCT root_id FROM gold) q LEFT JOIN k USING (root_id) LEFT JOIN gold g ON g.root_id = k.root_id AND g.chunk_id = k.chunk_id GROUP BY 1)
    SELECT root_id, CAST(r AS INT) AS first_gold FROM f""")
def repair_arm(spark, d):
    c = cand(spark, d)
    cache = c.filter("prior_rank <= 10").select("root_id", "chunk_id", F.lit("M").alias("arm"), (F.col("ce_raw") * 0.5).alias("ce_raw"))
    s = evaluation.arm_scores(c, cache, "M", ["root_id", "chunk_id"], "ce_raw", "s")
    k = s.withColumn("r", F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc_nulls_last("s"), "chunk_id")))
    g = gold(spark, d)
    first = k.join(g, ["root_id", "chunk_id"], "left_semi").groupBy("root_id").agg(F.min("r").alias("first_gold"))
    return g.select("root_id").distinct().join(first, "root_id", "left")


def _pool_at(cap: int) -> str:
    return f"SELECT {cap} AS size, * FROM ({_pools('plan_c', cap)})"


@query("WITH po AS (" + " UNION ALL ".join(_pool_at(n) for n in (50, 60, 80)) + "), " + GOLD + """, q AS (SELECT DISTINCT root_id FROM gold), h AS (SELECT DISTINCT size, root_id FROM po JOIN gold USING (root_id, chunk_id)), s(size) AS (VALUES (50), (60), (80)),
    j AS (SELECT s.size, q.root_id, h.root_id IS NOT NULL AS f, b.root_id IS NOT NULL AS b FROM s CROSS JOIN q LEFT JOIN h ON h.size = s.size AND h.root_id = q.root_id LEFT JOIN (SELECT root_id FROM h WHERE size = 50) b ON b.root_id = q.root_id)
    SELECT size, count(*) AS n, count(CASE WHEN f THEN 1 END) AS found, count(CASE WHEN f <> b THEN 1 END) AS flips FROM j GROUP BY 1""")
def pool_replays(spark, d):
    """Questions with a gold chunk in the quota pool at three sizes, and how many differ from the smallest."""
    c, g = cand(spark, d), gold(spark, d)
    q = g.select("root_id").distinct()
    for n in (50, 60, 80):  # with two sub-questions the pool takes ten more than its cap
        found = fusion.quota_pool(c, cap=n - 10).join(g, ["root_id", "chunk_id"], "left_semi").select("root_id").distinct().withColumn(f"s{n}", F.lit(True))
        q = q.join(found, "root_id", "left")
    at = lambda n: F.coalesce(f"s{n}", F.lit(False))
    each = q.select(F.explode(F.array(*[F.struct(F.lit(n).alias("size"), at(n).alias("f"), at(50).alias("b")) for n in (50, 60, 80)])).alias("x")).select("x.*")
    return each.groupBy("size").agg(F.count("*").alias("n"), F.count_if(F.col("f")).alias("found"), F.count_if(F.col("f") != F.col("b")).alias("flips"))


@query("WITH " + CAND + ", " + GOLD + """, k AS (SELECT root_id, chunk_id, row_number() OVER (PARTITION BY root_id ORDER BY retrieval_prior DESC NULLS LAST, chunk_id) AS a, row_number() OVER (PARTITION BY root_id ORDER BY rrf_prior DESC NULLS LAST, chunk_id) AS b FROM c),
    m AS (SELECT root_id, min(a) AS before, min(b) AS after FROM k JOIN gold USING (root_id, chunk_id) GROUP BY 1), j AS (SELECT *, before - after AS d FROM m)
    SELECT root_id, CAST(before AS INT) AS before, CAST(after AS INT) AS after, CASE WHEN d >= 3 THEN 'up' WHEN d <= -3 THEN 'down' ELSE 'near' END AS move FROM j""")
def rank_moves(spark, d):
    w = Window.partitionBy("root_id")
    c = cand(spark, d).join(gold(spark, d), ["root_id", "chunk_id"], "left_semi").select("root_id", "chunk_id")
    ranked = lambda by: cand(spark, d).withColumn("r", F.row_number().over(w.orderBy(F.desc_nulls_last(by), "chunk_id"))).join(c, ["root_id", "chunk_id"], "left_semi").groupBy("root_id").agg(F.min("r").alias("r"))
    return diagnosis.rank_moves(ranked("retrieval_prior"), ranked("rrf_prior"), "root_id", "r")


@query("""WITH s AS (SELECT difficulty, count(*) AS n FROM golden_items GROUP BY 1), q AS (SELECT difficulty, greatest(floor(100 * sqrt(n) / (SELECT sum(sqrt(n)) FROM s)), 1) AS q FROM s),
    k AS (SELECT g.*, md5('42:' || item_id) AS o, row_number() OVER (PARTITION BY difficulty ORDER BY md5('42:' || item_id), item_id) AS k FROM golden_items g) SELECT item_id, k.difficulty FROM k JOIN q ON k.difficulty IS NOT DISTINCT FROM q.difficulty ORDER BY (k > q)::INT, o, item_id LIMIT 100""")
def root_weighted_sample(spark, d):
    return evaluation.root_quotas(table(spark, d, "golden_items").select("item_id", "difficulty"), "difficulty", "item_id", 100)


@query(r"""WITH p AS (SELECT item_id, (length(question) > 40)::INT + (len(regexp_extract_all(question, '\d+')) >= 3)::INT + (len(regexp_extract_all(question, '[，,；;]')) >= 2)::INT + (coalesce(length(answer), 0) > 150)::INT AS s, difficulty FROM golden_items WHERE question IS NOT NULL)
    SELECT CASE WHEN s >= 3 THEN 'hard' WHEN s >= 1 THEN 'medium' ELSE 'easy' END AS scored, coalesce(difficulty, 'medium') AS stored, count(*) AS n FROM p GROUP BY 1, 2""")
def difficulty_scores(spark, d):
    """Difficulty by features against the stored one, empty ones filled."""
    g = table(spark, d, "golden_items").filter("question is not null")
    return g.groupBy(diagnosis.difficulty(F.col("question"), F.col("answer")).alias("scored"), F.coalesce("difficulty", F.lit("medium")).alias("stored")).agg(F.count("*").alias("n"))


@query(f"""WITH q AS (SELECT item_id, question AS o, answer AS n, province, crop FROM golden_items WHERE question IS NOT NULL AND answer IS NOT NULL)
    SELECT item_id, list_sort(regexp_extract_all(o, '\\d+(?:\\.\\d+)?')) = list_sort(regexp_extract_all(n, '\\d+(?:\\.\\d+)?')) AS numbers, list_sort(regexp_extract_all(o, '[≥≤℃％%]')) = list_sort(regexp_extract_all(n, '[≥≤℃％%]')) AS signs,
    (length(n) / greatest(length(o), 1)::DOUBLE BETWEEN 0.6::DOUBLE AND 1.4::DOUBLE) OR length(n) <= length(o) + 8 AS length, NOT (regexp_matches(regexp_replace(n, '[？?。.！! ]+$', ''), '(?:{rewrite.TITLE_ENDS})$') AND NOT regexp_matches(n, '{rewrite.ASKING}')) AS sentence,
    coalesce(province, '') NOT IN ('', '无', '—', '-') AND coalesce(crop, '') NOT IN ('', '无', '—', '-') AS elements FROM q""")
def ranking_query_checks(spark, d):
    q = table(spark, d, "golden_items").filter("question is not null and answer is not null")
    c = rewrite.ranking_checks(F.col("question"), F.col("answer"), {"who": F.col("province"), "target": F.col("crop")})
    return q.select("item_id", *[c[n].alias(n) for n in ("numbers", "signs", "length", "sentence", "elements")])


MAP = [("作物", "怕冷", "耐寒性"), ("作物", "旱情", "干旱"), ("_note", "下雪", "降雪"), ("灾害", "_x", "y"), ("灾害", "冷", "低温"), ("灾害", "怕冷", "抗寒性")]


@query("SELECT spoken, min(standard) AS standard FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in MAP) + ") m(category, spoken, standard) WHERE category[1] <> '_' AND spoken[1] <> '_' AND length(spoken) > 1 GROUP BY 1")
def term_map(spark, d):
    return rewrite.term_map(spark.createDataFrame(MAP, "category string, spoken string, standard string"))


@query("""WITH k AS (SELECT item_id, list_filter([province, crop, province, ' ', zoning_type, question_type, difficulty, answer, crop], lambda x: x IS NOT NULL AND trim(x) <> '') AS l FROM golden_items)
    SELECT item_id, array_to_string(list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda x: x IS NOT NULL)[1:6], '|') AS pool FROM k""")
def keyword_pools(spark, d):
    g = table(spark, d, "golden_items")
    p = rewrite.pool(F.array_compact(F.array("province", "crop")), F.array_compact(F.array("province", F.lit(" "), "zoning_type", "question_type", "difficulty")), F.array_compact(F.array("answer", "crop")))
    return g.select("item_id", F.array_join(p, "|").alias("pool"))


@query("WITH " + BOTH + """, tp AS (SELECT root_id, max(cosine_sim) AS top1 FROM c GROUP BY 1), w AS (SELECT qid AS root_id, min(query) AS query FROM pool_failures GROUP BY 1), s(thr) AS (VALUES (0.5::DOUBLE), (0.7::DOUBLE), (0.9::DOUBLE))
    SELECT thr, count(CASE WHEN top1 < thr AND length(query) > 12 THEN 1 END) AS used, round(avg(CASE WHEN top1 < thr AND length(query) > 12 THEN e.rr ELSE x.rr END), 6) AS mrr FROM x JOIN e USING (root_id) JOIN tp USING (root_id) JOIN w USING (root_id), s GROUP BY 1""")
def gating_sweep(spark, d):
    top = cand(spark, d).groupBy("root_id").agg(F.max("cosine_sim").alias("top1"))
    w = table(spark, d, "pool_failures").groupBy(F.col("qid").alias("root_id")).agg(F.min("query").alias("query"))
    base = _base(spark, d).select("root_id", "rr").join(top, "root_id").join(w, "root_id")
    return diagnosis.gated_choice(base, metrics(spark, d), "root_id", "query", spark.createDataFrame([(0.5,), (0.7,), (0.9,)], "thr double")).withColumn("mrr", R6("mrr"))


ROUNDS = [("base", 0.50, 0.40), ("a", 0.55, 0.396), ("b", 0.62, 0.30), ("c", 0.56, 0.41), ("d", 0.40, 0.60)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', {t}::DOUBLE, {v}::DOUBLE)" for n, t, v in ROUNDS) + ") c(name, train, val) WHERE train > 0.5::DOUBLE AND val >= 0.395::DOUBLE ORDER BY train DESC, name LIMIT 1")
def promotion(spark, d):
    return evaluation.promoted(spark.createDataFrame(ROUNDS, "name string, train double, val double"), 0.5, 0.4)


@query("WITH t AS (SELECT DISTINCT qid, capability AS tier, g FROM (SELECT qid, capability, unnest(gold_chunks) AS g FROM pool_failures)), r AS (SELECT qid, tier, avg((coalesce(g.pool50.in_pool, false))::INT) AS recall FROM t GROUP BY 1, 2) SELECT qid, round(sum(CASE tier WHEN 'table_lookup' THEN 0.45::DOUBLE WHEN 'query_rewrite' THEN 0.30::DOUBLE ELSE 0 END * recall), 6) AS weighted FROM r GROUP BY 1")
def weighted_tiers(spark, d):
    t = table(spark, d, "pool_failures").select("qid", F.col("capability").alias("tier"), F.explode("gold_chunks").alias("g")).distinct()
    r = t.groupBy("qid", "tier").agg(F.avg(F.coalesce(F.col("g.pool50.in_pool"), F.lit(False)).cast("double")).alias("recall"))
    return evaluation.weighted_tiers(r, {"table_lookup": 0.45, "query_rewrite": 0.30}).withColumn("weighted", R6("weighted"))


@query("SELECT item_id FROM golden_items g WHERE NOT EXISTS (SELECT 1 FROM rag_results r WHERE r.result_id = g.item_id - 9000 AND r.decision = 'answer')")
def pending_items(spark, d):
    """Items still to do: those whose result isn't there or is there without an answer."""
    r = table(spark, d, "rag_results").select((F.col("result_id") + 9000).alias("item_id"), F.when(F.col("decision") != "answer", "failed").when(F.col("decision").isNull(), "failed").alias("error"))
    return rewrite.pending(table(spark, d, "golden_items").select("item_id"), r, "item_id", retry=True)


@query(f"""WITH p AS (SELECT doc_id, page, string_agg(text, chr(10) ORDER BY seq, block_id) AS t FROM blocks WHERE doc_id IS NOT NULL AND page IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT doc_id, page, t, string_split(t, chr(10)) AS l FROM p WHERE length(t) >= 50), f AS (SELECT * FROM k WHERE NOT (len(list_filter(l, lambda x: regexp_matches({S.strip('x')}, '^[IVX]+$'))) > 0 OR len(list_filter(l, lambda x: contains(x, '....') OR contains(x, '……'))) > len(l) * 0.4::DOUBLE)),
    w AS (SELECT doc_id, string_agg(t, chr(10) ORDER BY page) AS t FROM f GROUP BY 1) SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '\\n[IVX]+\\n', chr(10), 'g'), '\\n\\d{{1,3}}\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS h FROM w""")
def page_texts(spark, d):
    """Texts of paged documents from their pages, contents pages and short ones left out."""
    b = table(spark, d, "blocks").filter("doc_id is not null and page is not null and text is not null").withColumn("o", F.struct("seq", "block_id"))
    pages = b.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "text"))), lambda x: x["text"]), "\n").alias("t"))
    return diagnosis.page_fallback(pages, "doc_id", "page", "t").select("doc_id", F.md5("text").alias("h"))


@query("SELECT doc_id, source FROM documents WHERE text IS NOT NULL AND coalesce(source <> 'provincial_bulletin', true) AND length(regexp_replace(text, '^" + S.W + "+|" + S.W + "+$', '', 'g')) >= 50 AND NOT regexp_matches(regexp_replace(text, '^" + S.W + "+|" + S.W + r"+$', '', 'g'), '^[#\s]*(?:目\s*录|Contents|Table of Contents|参考文献|References|参考书目)')")
def loaded_documents(spark, d):
    """Documents that go into the index: neither of an excluded source nor of low quality."""
    from .operators import chunks

    t = chunks.quality(table(spark, d, "documents").filter("text is not null"), "text").withColumn("excluded", F.col("source") == "provincial_bulletin")
    return pipeline.load_filter(t, "excluded", "quality").select("doc_id", "source")


@query("SELECT item_id, contains(question, 'NDVI') AND contains(question, 'a') AS meets FROM golden_items WHERE question IS NOT NULL")
def contract_checks(spark, d):
    return table(spark, d, "golden_items").filter("question is not null").select("item_id", rewrite.meets_contract(F.col("question"), ("NDVI", "a")).alias("meets"))


@query("""WITH k AS (SELECT item_id, source_chunk_id, split_part(source_chunk_id, '_', 1) AS stem FROM golden_items WHERE source_chunk_id IS NOT NULL), c AS (SELECT DISTINCT chunk_id FROM candidates), d AS (SELECT item_id, chunk_id FROM k JOIN c ON chunk_id = source_chunk_id)
    SELECT item_id, chunk_id, 'chunk' AS how FROM d UNION ALL SELECT k.item_id, c.chunk_id, 'stem' FROM k JOIN c ON split_part(c.chunk_id, '_', 1) = k.stem WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.item_id = k.item_id)""")
def gold_matches(spark, d):
    """Each item's gold chunks: its own, or where that isn't known all of the same document."""
    stem = lambda c: F.split(c, "_")[0]
    g = table(spark, d, "golden_items").filter("source_chunk_id is not null").select("item_id", F.col("source_chunk_id").alias("chunk_id"))
    c = table(spark, d, "candidates").select("chunk_id").distinct()
    direct = g.join(c, "chunk_id").select("item_id", "chunk_id", F.lit("chunk").alias("how"))
    rest = g.join(direct.select("item_id"), "item_id", "left_anti").withColumn("stem", stem(F.col("chunk_id"))).drop("chunk_id")
    return direct.unionByName(rest.join(c.withColumn("stem", stem(F.col("chunk_id"))), "stem").select("item_id", "chunk_id", F.lit("stem").alias("how")))
