import random
from itertools import product

from corvane.llm import leximin, replies as R

ZQ, EQ = "砚涧旗是否适宜种植高粱？", "Can tea be grown above 1751 m in Wexbrook?"
CASES = [
    (ZQ, None, "empty"), (ZQ, " ​\n", "empty"), (ZQ, "答：", "empty"), (ZQ, "```\n```", "empty"), (ZQ, "N/A", "empty"), (ZQ, "<br>", "empty"), (ZQ, "[]", "empty"), (EQ, "A:", "empty"), (ZQ, "……", "empty"),
    (ZQ, "是。", None), (ZQ, "不适宜", None), (ZQ, "约1877天", None), (ZQ, "338毫米", None), (EQ, "Yes", None), (EQ, "About 330 mm", None),
    (ZQ, "> " + ZQ, "echo"), (ZQ, "您想了解的是：" + ZQ, "echo"), (ZQ, ZQ[:-1] + "，是这样吗？", "echo"), (EQ, EQ.upper(), "echo"), (EQ, "“" + EQ + "”", "echo"), (ZQ, " ".join(ZQ), "echo"), (ZQ, ZQ + "适宜，面积占13.4%。", None),
    (ZQ, "很抱歉，这个问题我帮不上忙，请补充资料后再试。", "refusal"), (EQ, "Regrettably, I cannot answer this from the given documents. Please ask the local weather office.", "refusal"), (ZQ, "关于“" + ZQ + "”，根据现有资料无法回答这个问题。[源1]", "refusal"),
    (ZQ, "资料未给出霁坪盟的数值，但按综合指数把渌坡区划为次适宜区，面积占64.5%。", None), (EQ, "Sorry for the delay. The zoning of potato used 78 indicators, as annex 43 explains. (see source 2)", None), (ZQ, "热量不足。因此砚丰3号无法在该处推广。", None),
    (ZQ, "Within zone 2, the lower boundary of the citrus belt shifted towards the north.", "wrong_language"), (EQ, "按综合指数把渌坡区划为次适宜区。", "wrong_language"), (EQ, "Die Niederschläge fallen vor allem im Sommer. Der Anbau lohnt sich nicht.", "wrong_language"), (ZQ, "この地域ではあまり栽培に向いていません。", "wrong_language"), (ZQ, "Участок малопригоден для этой культуры.", "wrong_language"),
    ("请用英文回答：柑橘的区划指标是什么？", "The zoning of citrus used the mean of 78 indicators.", None),
    (ZQ, "渠系水利用系数为0.6。太阳总辐射在碣涧市接近每平方米——", "truncated"), (ZQ, "干旱频率为17.0%，其原因包括：", "truncated"), (ZQ, "运费占33.5%。柑橘外销（其中骏坡旗", "truncated"), (ZQ, "早稻收购价上涨，", "truncated"), (ZQ, "依据如下：\n1. 积温不足。\n2.", "truncated"),
    (ZQ, "统计如下。\n| 站点 | 年份 |\n| 甲 | 20", "truncated"), (ZQ, "统计如下。\n| 站点 | 年份 |\n| 甲 | 2001 |", None), (EQ, "Late frost damaged 40.2% of the buds at Peldale in the", "truncated"), (EQ, "Late frost damaged the buds, with an error of 8. (see source 2)", None),
]


def test_each_defect(spark):
    rows = [(i, q, a, "answer") for i, (q, a, _) in enumerate(CASES)] + [(900, ZQ, "", "reject"), (None, ZQ, "", "answer"), (0, ZQ, None, "answer")]
    got = {r.result_id: r.defect for r in R.defects(spark.createDataFrame(rows, "result_id long, query string, answer string, decision string")).collect()}
    want = {i: d for i, (*_, d) in enumerate(CASES) if d}
    assert {k: (CASES[k][1], got.get(k), want.get(k)) for k in got.keys() | want.keys() if got.get(k) != want.get(k)} == {}


def test_null_query_and_empty_table(spark):
    schema = "result_id long, query string, answer string, decision string, defect string, a string"
    d = spark.createDataFrame([(1, None, "完整的句子。", "answer", "x", "y"), (2, None, None, "answer", "x", "y"), (3, None, "字" * 20000, "answer", None, None)], schema)
    assert {tuple(r) for r in R.defects(d).collect()} == {(2, "empty", "rule"), (3, "truncated", "end")}
    assert R.defects(d.limit(0)).count() == 0


def test_longer_twin_shows_the_cut(spark):
    a = ["the yield rose by 3.", "the yield rose by 3.75 tonnes in the valley.", "the yield rose by 4.", "完整。", "完整。下一句。"]
    d = spark.createDataFrame([(i, EQ if x.isascii() else ZQ, x, "answer") for i, x in enumerate(a)], "result_id long, query string, answer string, decision string")
    assert {tuple(r) for r in R.defects(d).collect()} == {(0, "truncated", "prefix")}


def test_shortened_over_ranges(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab", k=rng.randint(1, 9))) for _ in range(400)]
    got = {r.x for r in R.shortened(spark.createDataFrame([(t,) for t in texts], "x string"), "x").collect()}
    every = set(texts)
    assert got == {t for t in every if any(o != t and o.startswith(t) for o in every)}


def test_length_limit(spark):
    rows = [(i, EQ, ("word%02d " % i * 12)[:78] + "7.", "answer") for i in range(8)] + [(100 + i, EQ, "The site has %d zones in the north%s." % (i, "x" * (i % 30)), "answer") for i in range(60)]
    got = {(r.result_id, r.evidence) for r in R.defects(spark.createDataFrame(rows, "result_id long, query string, answer string, decision string")).collect()}
    assert got == {(i, "limit") for i in range(8)}


SCHEMA = "root_id string, chunk_id string, prior_rank int, rrf_prior double, retrieval_prior double, cosine_sim double, ce_raw double, vec int, _q string"


def brute(rows):
    out = {}
    for q in {r[0] for r in rows}:
        items = {}
        for r in rows:
            if r[0] == q:
                s = [None if r[2] in (None, 999) else -r[2], *r[3:7]]
                old = items.get(r[1], [None] * 5)
                items[r[1]] = [max([x for x in p if x is not None and x == x], default=None) for p in zip(old, s)]
        n = len(items)
        vec = {}
        for c, s in items.items():
            p = []
            for k, x in enumerate(s):
                col = [v[k] for v in items.values()]
                p.append(0.0 if x is None else (sum(y is None or y < x for y in col) + (sum(y == x for y in col if y is not None) - 1) / 2) / max(n - 1, 1))
            vec[c] = sorted(p)
        out[q] = sorted(items, key=lambda c: ([-x for x in vec[c]], c))
    return out


def test_leximin_against_brute_force(spark):
    rng = random.Random(5)
    rows = []
    for q, n in (("a", 25), ("b", 1), ("c", 12), ("d", 3)):
        for i in range(n):
            rows.append((q, f"c{i}", rng.choice([None, 999, 1, 2, 3, 4]), rng.choice([.1, .1, .3]), rng.gauss(0, 1), rng.choice([None, float("nan"), 1e9, rng.random()]), rng.choice([None, rng.gauss(0, 9e5)]), 1, "x"))
    rows += rows[:7]
    df = spark.createDataFrame(rows, SCHEMA)
    p = leximin.percentiles(df, "root_id", "chunk_id")
    want = brute(rows)
    assert {r.root_id: r.chunk_id for r in leximin.heads(p, "root_id", "chunk_id").collect()} == {q: v[0] for q, v in want.items()}
    got = {}
    for r in sorted(leximin.order(p, "root_id", "chunk_id").collect(), key=lambda r: r.place):
        got.setdefault(r.root_id, []).append((r.place, r.chunk_id))
    assert got == {q: list(enumerate(v, 1)) for q, v in want.items()}
    assert leximin.percentiles(df.limit(0), "root_id", "chunk_id").count() == 0


def test_range_does_not_dominate(spark):
    rows = [("q", "wide", 5, .1, .1, .1, 1e6, 0, ""), ("q", "even", 2, .4, .4, .4, 5.0, 0, ""), ("q", "weak", 4, .2, .2, .2, 4.0, 0, "")]
    assert leximin.heads(leximin.percentiles(spark.createDataFrame(rows, SCHEMA), "root_id", "chunk_id"), "root_id", "chunk_id").first().chunk_id == "even"


def test_gold_rank_fills_a_miss(spark):
    c = spark.createDataFrame([("q", "x", 999, .1, .1, .1, .1, 0, ""), ("q", "y", None, .1, .1, .1, .1, 0, ""), ("q", "z", 3, .1, .1, .1, .1, 0, "")], SCHEMA)
    f = spark.createDataFrame([("q", [("x", (True, 2)), ("y", (False, 1)), ("z", (True, 9))])], "qid string, gold_chunks array<struct<chunk_id string, global_union struct<in_union boolean, prior_rank int>>>")
    got = {r.chunk_id: list(r.vec) for r in leximin.percentiles(leximin.with_gold_ranks(c, f), "root_id", "chunk_id").collect()}
    assert got == {"x": [0.5] * 4 + [1.0], "y": [0.0] + [0.5] * 4, "z": [0.5] * 5}
