import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.operators import evaluation, fusion, rewrite, search
from corvane.plans import pipeline
from corvane.tables import below_counts


def test_tokens():
    assert search.tokens("ab") == ["a", "b", "ab"]
    assert search.tokens("FCV") == ["F", "C", "V", "FC", "CV", "FCV"]
    assert search.tokens(" \n") == [] and search.tokens(None) == []


def test_okapi_anchors(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "ac"), (3, "ad")], "id int, t string")
    q = spark.createDataFrame([(1, "b"), (2, "a")], "q int, t string")
    got = {(r.q, r.id): r.score for r in search.bm25(docs, "id", "t", q, "q", "t").collect()}
    assert math.isclose(got[(1, 1)], math.log(2.5 / 1.5)) and (1, 2) not in got
    raw = [math.log(0.5 / 3.5)] + [math.log(2.5 / 1.5)] * 6
    assert math.isclose(got[(2, 1)], 0.25 * sum(raw) / 7)


def test_cosine_blocks(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [-1.0, 0.0]), (5, None)], "id int, v array<float>")
    got = [(r.id, r.sim, r.rank) for r in search.cosine_topk(rows, "id", "v", rows.filter("id = 1"), 3, block=2).orderBy("rank").collect()]
    assert got == [(2, 1.0, 1), (3, 0.0, 2), (4, -1.0, 3)]


def test_rrf_anchors(spark):
    h = spark.createDataFrame([("r", 0, "a", "Dense", 0, .9), ("r", 0, "a", "BM25o", 5, None), ("r", 0, "b", "Dense", 0, .8)], "root_id string, qid int, chunk_id string, channel string, rank0 int, score double")
    m = {r.chunk_id: r.rrf_prior for r in fusion.multi_rrf(h).collect()}
    assert math.isclose(m["a"], (.7 / 60 + .15 / 65) / .85) and math.isclose(m["b"], 1 / 60)
    p = {r.chunk_id: r.rrf for r in fusion.rrf(h, ["root_id", "chunk_id"], {"Dense": .7, "BM25o": .3}).collect()}
    assert math.isclose(p["a"], .7 / 60 + .3 / 65) and math.isclose(p["b"], 1 / 60)


def test_pool_anchor():
    hits = [[0]] * 40 + [[2]] * 15
    got = fusion.pool_order(hits, 1, 1, 50)
    assert got == list(range(20)) + list(range(40, 45)) + list(range(45, 55)) + list(range(20, 35))
    assert fusion.pool_order([[1 + i % 2] for i in range(70)], 0, 2, 60)[:10] == list(range(10))
    assert fusion.pool_order([[0]] * 3, 0, 0, 50) == [0, 1, 2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), min_size=1, max_size=3), max_size=120), st.integers(0, 2), st.integers(0, 3))
def test_pool_properties(hits, rw, sq):
    got = fusion.pool_order(hits, rw, sq, 50)
    assert len(got) == len(set(got)) == min(len(hits), 50)
    if len(hits) > 50:
        assert set([i for i, h in enumerate(hits) if 0 in h][:20]) <= set(got)


def test_normalisers_and_fusion(spark):
    d = spark.createDataFrame([("q", "a", 1.0, 3.0), ("q", "b", 1.0, 2.0), ("q", "c", 1.0, 1.0), ("s", "d", 5.0, None)], "q string, c string, p double, x double")
    n = {r.c: r for r in fusion.normalised(d, ["q"], "x", "c").collect()}
    assert [n[c].n_rank for c in "abc"] == [1.0, .5, 0.0] and n["d"].n_rank is None
    assert [r.m for r in d.withColumn("m", fusion.minmax("p", ["q"])).collect()] == [0.0] * 4
    f = {r.c: r.final_rank for r in fusion.fuse(d, ["q"], "p", "x", "c").collect()}
    assert f == {"a": 1, "b": 2, "c": 3, "d": 1}
    assert math.isclose(spark.range(1).select(fusion.length_penalty(F.lit(.9), F.lit(1000))).first()[0], .9 - .1 * math.log(1000))


def test_neighbour_windows(spark):
    c = spark.createDataFrame([("s", i, f"t{i}") for i in range(4)], "section_id string, chunk_index int, content string")
    h = spark.createDataFrame([("q", "s", 1, 1), ("q", "s", 2, 2), ("q", "s", 1, 3)], "root_id string, section_id string, chunk_index int, rank int")
    got = sorted((r.lo, r.hi, r.rank, r.context) for r in fusion.neighbours(h, c, "root_id", glue="-").collect())
    assert got == [(0, 2, 1, "t0-t1-t2"), (1, 3, 2, "t1-t2-t3")]


def test_judge(spark):
    rows = [(None, None), (.6999, "YES sure"), (.70, None), (.1, "partial"), (.1, "no"), (.1, "??"), (.1, "error")]
    d = spark.createDataFrame(rows, "s double, v string")
    assert [r[0] for r in d.select(fusion.judge(F.col("s"), F.col("v"))).collect()] == ["reject", "answer", "answer", "answer", "reject", "reject", "fallback"]


def test_metrics_count_misses(spark):
    q = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")
    r = spark.createDataFrame([("a", f"d{i}", i) for i in range(1, 11)], "q string, d string, rank int")
    g = spark.createDataFrame([("a", "d3"), ("a", "d7"), ("b", "d1")], "q string, d string")
    m = {x.q: x for x in evaluation.per_query(q, r, g, "q", "d").collect()}
    assert math.isclose(m["a"].rr, 1 / 3) and m["a"].hit_count == 2 and m["b"].rr == 0 and m["c"].gold_count == 0
    a = evaluation.macro(evaluation.per_query(q, r, g, "q", "d")).first()
    assert a.zero_recall == 2 and math.isclose(a.mrr, 1 / 9)


def test_tiers_and_promotion(spark):
    t = spark.createDataFrame([("x", "must", 1.0), ("x", "core", .5)], "qid string, tier string, recall double")
    assert math.isclose(evaluation.weighted_tiers(t, {"must": .45, "core": .30}).first().weighted, .60)
    c = spark.createDataFrame([("a", .5, .4), ("b", .6, .2), ("c", .55, .396)], "name string, train double, val double")
    assert evaluation.promoted(c, .52, .4).first().name == "c" and evaluation.promoted(c, .9, .4).count() == 0


def test_terms():
    pairs = [("倒春寒", "晚霜冻"), ("春寒", "低温"), ("怕冷", "耐寒性"), ("旱", "干旱"), ("风险", "风险")]
    assert rewrite.replaced("倒春寒怕冷怕冷吗", pairs) == "晚霜冻耐寒性吗"
    assert rewrite.replaced("晚霜冻与春寒", pairs) == "晚霜冻与低温"
    assert rewrite.replaced("耐怕冷性", pairs) == "耐寒性"
    assert [k for *_, k in rewrite.spans("倒春寒春寒", [a for a, _ in pairs])] == ["倒春寒", "春寒"]


def test_generated_text(spark):
    d = spark.createDataFrame([('x {"a": 1} y',), ("none",), (None,)], "r string")
    assert [r.parsed and r.parsed.a for r in rewrite.json_object(d, "r", "a int").collect()] == [1, None, None]
    f = spark.createDataFrame([("```json\nx\n```",)], "r string")
    assert f.select(rewrite.without_fences(F.col("r"))).first()[0] == "x"
    seen = []

    def gen(t, issues):
        return t + ("!" if issues else "?")

    r = rewrite.with_retries(spark.createDataFrame([("a",), (None,)], "t string"), "t", gen, lambda a, b: [] if b.endswith("!") else ["mark"])
    assert [x.repaired for x in r.collect()] == ["a!", None] and not seen


def test_cache(spark):
    c = spark.createDataFrame([("q", "g1", "x"), ("q", "base", "y"), ("r", "base", "z")], "query string, arm string, entry string")
    q = spark.createDataFrame([("q",), ("r",), ("s",)], "query string")
    assert {r.query: r.entry for r in rewrite.cached(q, c, ["g1", "base"]).collect()} == {"q": "x", "r": "z", "s": None}
    assert rewrite.upsert(c, c.limit(1).withColumn("entry", F.lit("n")), ["query", "arm"]).count() == 3


def test_ranks_across_ranges(spark):
    d = spark.createDataFrame([("g", i % 50) for i in range(500)] + [("h", 1), ("h", None)], "g string, v int")
    got = {(r.g, r.v): (r.n, r.below) for r in below_counts(d, ["g"], "v", 7).collect()}
    assert got == {("g", v): (10, 10 * v) for v in range(50)} | {("h", 1): (1, 0)}


def test_bm25_against_brute_force(spark, monkeypatch):
    from collections import Counter
    import random

    rng = random.Random(12)
    docs = [(i, "".join(rng.choices("霜冻干旱 指标NDVI12", k=rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "  "), (62, "霜冻"), (63, "霜冻")]
    asked = [("a", "霜冻指标 NDVI"), ("b", "干旱干旱"), ("c", ""), ("d", None), ("e", "无关")]
    tf = {k: Counter(search.tokens(t)) for k, t in docs}
    n, total = len(docs), sum(sum(c.values()) for c in tf.values())
    df = Counter(t for c in tf.values() for t in c)
    raw = {t: math.log((n - v + .5) / (v + .5)) for t, v in df.items()}
    mean = sum(raw.values()) / len(raw)
    want = {}
    for q, text in asked:
        score = {}
        for k, c in tf.items():
            s = sum(w * (raw[t] if raw[t] >= 0 else .25 * mean) * c[t] * 2.5 / (c[t] + 1.5 * (.25 + .75 * sum(c.values()) / (total / n))) for t, w in Counter(search.tokens(text)).items() if t in c)
            if abs(s) > 1e-12:
                score[k] = s
        want[q] = sorted(score, key=lambda k: (-round(score[k], 9), k))[:5]
    d, q = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(asked, "q string, x string")
    for sent, held in ((10**6, 10**6), (20, 30)):  # several passes, few texts at a time
        monkeypatch.setattr(search, "WEIGHTS_SENT", sent)
        monkeypatch.setattr(search, "SCORES_HELD", held)
        got: dict = {}
        for r in search.bm25(d, "id", "t", q, "q", "x", 5).orderBy("q", "rank").collect():
            got.setdefault(r.q, []).append(r.id)
        assert got == {k: v for k, v in want.items() if v}
    assert search.bm25(d.limit(0), "id", "t", q, "q", "x").count() == 0 and search.bm25(d, "id", "t", q.limit(0), "q", "x").count() == 0


def test_cosine_ties_go_to_the_smaller_key(spark):
    rows = [(i, [1.0, float(i % 2)]) for i in range(40)] + [(40, [0.0, 0.0]), (41, None)]
    d = spark.createDataFrame(rows, "id long, v array<double>")
    got = search.cosine_topk(d, "id", "v", d.filter("id in (0, 40)"), 4, block=16).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, 2), (0, 4), (0, 6), (0, 8), (40, 0), (40, 1), (40, 2), (40, 3)]


def test_dictionaries_are_bounded(spark):
    import pytest
    from corvane import tables

    assert tables.bounded(spark.range(5), 5).count() == 5
    with pytest.raises(ValueError, match="more than"):
        tables.bounded(spark.range(6), 5)


def test_blank_texts_have_no_postings(spark):
    d = spark.createDataFrame([(1, " "), (2, None)], "id int, t string")
    assert search.postings(d, "id", "t").count() == 0


def test_note_goes_before_the_last_mark(spark):
    d = spark.createDataFrame([("a Q: b Q: c",), ("none",)], "p string")
    assert [r[0] for r in d.select(rewrite.with_structure_note(F.col("p"), "[n]", "Q:")).collect()] == ["a Q: b [n]Q: c", "none[n]"]


QUESTIONS = "root_id string, q string, rewrites array<string>, subs array<string>, keywords array<string>"


def small_index(spark):
    words = ["霜冻指标分级", "干旱风险等级", "冬小麦种植区划", "土壤水分测定", "降水日数统计", "积温带划分"]
    docs = spark.createDataFrame([(i, words[i % 6] + f"第{i}号" + words[(i * 7 + i // 6) % 6] + "。" + "甲乙丙丁"[i % 4] * (i % 9)) for i in range(90)], "doc_id long, text string")
    return pipeline.index(docs, "doc_id", "text")


def test_channels_of_all_sub_queries(spark):
    indexed = small_index(spark)
    rows = [("a", "霜冻指标怎么分级", ["冬小麦霜冻指标分级"], ["霜冻指标", " ", "冬小麦区划"], ["干旱"]), ("b", "土壤水分怎么测定", None, None, ["降水"]), ("c", "积温带", [], None, None), ("d", None, None, None, None)]
    q = spark.createDataFrame(rows, QUESTIONS)
    subs = {(r.root_id, r.qid): (r.kind, r.q) for r in pipeline.sub_queries(q.filter("q is not null")).collect()}
    assert subs == {("a", 0): ("Original", rows[0][1]), ("a", 1): ("Rewrite", "冬小麦霜冻指标分级"), ("a", 2): ("SubQ", "霜冻指标"), ("a", 3): ("SubQ", "冬小麦区划"), ("b", 0): ("Original", rows[1][1]), ("c", 0): ("Original", "积温带")}
    kw = spark.createDataFrame([("a", "干旱")], "root_id string, q string")
    hits = pipeline.channel_hits(indexed, pipeline.sub_queries(q.filter("q is not null")), kw)
    depth = {(r.root_id, r.qid, r.channel): (r.n, r.last) for r in hits.groupBy("root_id", "qid", "channel").agg(F.count("*").alias("n"), F.max("rank0").alias("last")).collect()}
    assert depth[("a", 0, "Dense")] == (30, 29) and depth[("a", 0, "BM25o")] == (20, 19) and depth[("a", 0, "BM25kw")] == (20, 19)
    assert depth[("a", 1, "Dense")] == depth[("a", 3, "Dense")] == (20, 19) and depth[("a", 2, "BM25o")] == (10, 9) and ("b", 0, "BM25kw") not in depth
    seen = []

    def scorer(pairs):
        assert all(len(t) <= pipeline.PAIR_CHARS for _, t in pairs)
        return [1.0 if "霜冻" in t and "霜冻" in p else 0.5 if p.startswith("冬小麦") else 0.0 for p, t in pairs]

    judged, merged = pipeline.search_many(indexed, q, scorer)
    j, m = ({k: [r for r in d.collect() if r.root_id == k] for k in "abcd"} for d in (judged, merged))
    assert [len(j[k]) for k in "abcd"] == [len(m[k]) for k in "abcd"] == [5, 5, 5, 0] and not seen
    # Only the question with sub-queries is re-ranked by its rewrite; it and the keywords of the others change the outcome.
    assert all("霜冻" in r.content for r in m["a"] if r.final_rank <= 3)
    assert {r.chunk_id for r in j["c"]} == {r.chunk_id for r in m["c"]}
    plain_kw = pipeline.search_many(indexed, spark.createDataFrame([("b", "土壤水分怎么测定 降水", None, None, None)], QUESTIONS))[0]
    assert {r.chunk_id for r in plain_kw.collect()} & {r.chunk_id for r in m["b"]}


def test_several_is_what_its_parts_say(spark):
    indexed = small_index(spark)
    q = spark.createDataFrame([("a", "霜冻指标怎么分级", ["冬小麦霜冻指标分级"], ["霜冻指标", "冬小麦区划"], None)], QUESTIONS)
    subs = pipeline.sub_queries(q)
    hits = pipeline.channel_hits(indexed, subs, None)
    rows = [r.asDict() for r in hits.collect()]
    weight = {"Dense": .7, "BM25o": .15}
    prior, asked = {}, {}
    for c in {r["chunk_id"] for r in rows}:
        best = {}
        for r in rows:
            if r["chunk_id"] == c:
                best.setdefault(r["qid"], []).append((weight[r["channel"]], r["rank0"]))
        prior[c] = max(sum(w / (60 + k) for w, k in v) / sum(w for w, _ in v) for v in best.values())
        asked[c] = set(best)
    evidence = {c: .004 if len(s) >= 3 else .002 if len(s) == 2 else 0 for c, s in asked.items()}
    mm = lambda d: {c: (v - min(d.values())) / ((max(d.values()) - min(d.values())) or 1e-8) for c, v in d.items()}
    p, e = mm(prior), mm(evidence)
    order = sorted(prior, key=lambda c: (-round(.7 * p[c] + .3 * e[c], 6), c))
    pool = [order[i] for i in fusion.pool_order([sorted(asked[c]) for c in order], 1, 2, 60)]
    vec = {r.chunk_id: r.vec for r in indexed.collect()}
    v = search.hashed_vector("霜冻指标怎么分级")
    cos = {c: max([r["score"] for r in rows if r["chunk_id"] == c and r["score"] is not None], default=None) for c in pool}
    score = {c: .7 * (cos[c] if cos[c] is not None else round(float(np.dot(v, vec[c])), 4)) + .3 * round(.7 * p[c] + .3 * e[c], 6) for c in pool}
    want = sorted(pool, key=lambda c: (-score[c], c))[:5]
    vectors = search.embed(q.select("root_id", "q"), "q", "vec").select("root_id", "vec")
    got = [r.chunk_id for r in pipeline.several(hits, indexed, q, vectors).orderBy("final_rank").collect()]
    assert got == want


def test_knowledge_matches(spark):
    e = spark.createDataFrame([("c1", {"问": ["霜冻指标怎么分级", "霜冻分几级", "多余"]}, ["霜冻"], "指标说明"), ("c2", {"问": ["完全无关的内容"]}, None, None), ("c3", {}, None, None)], "chunk_id string, expressions map<string, array<string>>, concepts array<string>, summary string")
    q = spark.createDataFrame([("q", "霜冻指标怎么分级")], "root_id string, q string")
    got = pipeline.knowledge_matches(e, q).collect()
    assert [r.chunk_id for r in got] == ["c1"] and got[0].context == "霜冻指标怎么分级 霜冻分几级 霜冻 指标说明"


def test_load_and_store(spark, tmp_path):
    d = spark.createDataFrame([(1, True, "high"), (2, None, "low"), (3, False, None)], "i int, excluded boolean, quality string")
    assert [r.i for r in pipeline.load_filter(d, "excluded", "quality").collect()] == [3]
    path = f"{tmp_path}/store"
    assert pipeline.build_store(d, path).count() == 3 and pipeline.build_store(d.limit(1), path).count() == 3 and pipeline.build_store(d.limit(1), path, True).count() == 1


def test_lexical_only_chunk_wins(spark):
    question = "霜冻指标"
    v = np.array(search.hashed_vector(question))
    side = np.eye(64)[int(np.argmin(v))]
    side = side - (side @ v) * v
    side /= np.linalg.norm(side)
    at = lambda c: (c * v + math.sqrt(1 - c * c) * side).tolist()
    # The dense channel ends before `z`, whose similarity is hardly lower; `y` is like the question only in a word.
    chunks = [(f"f{i:02}", "霜冻" + "乙丙丁" * 5 if i == 0 else "乙丙丁" * 5, at(0.5 - i * 1e-5)) for i in range(30)] + [("z", "霜冻指标", at(0.4996)), ("y", "霜" + "乙丙丁" * 9, at(-0.5))]
    indexed = spark.createDataFrame([(f"{s}_p0", s, 0, t, x) for s, t, x in chunks], "chunk_id string, section_id string, chunk_index int, content string, vec array<double>")
    asked = spark.createDataFrame([("q", question, None, None, None), ("none", None, None, None, None)], QUESTIONS)
    indexed = indexed.withColumn("heading_path", F.array(F.lit("书"), F.lit("章")))
    got = {r["rank"]: r for r in pipeline.answer(indexed, asked, force=True).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5] and got[1].section_id == "z" and got[1].root_id == "q" and got[1].decision == "reject"
    assert got[1].context == "书 > 章\n\n---\n\n霜冻指标"
    pairs = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 6) for r in pairs.select(search.cosine(F.col("a"), F.col("b"))).collect()] == [0.707107, 0.0]
