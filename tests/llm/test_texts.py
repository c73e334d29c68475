import random
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import bpe, leakage, lookalikes, mojibake, nearcopies, segments, subjects


# Look-alikes ---------------------------------------------------------------------------------------------------------
def test_tidy():
    assert lookalikes.tidy("Ｆｉｇ­１　é​ ") == "Fig1 é" and lookalikes.tidy("⼟⽔") == "土水"
    assert lookalikes.tidy("m²") == "m²" and lookalikes.tidy("Ångsbro") != lookalikes.tidy("Angsbro") and lookalikes.tidy("①½") == "①½"


def test_repair_token():
    assert lookalikes.repairs("Fіgurе") == ["Figure"] and lookalikes.repairs("ΝDVΙ") == ["NDVI"]
    assert lookalikes.repairs("слово") == [] and lookalikes.repairs("словоf") == []
    assert lookalikes.repairs("А", alone=True) == ["A"] and lookalikes.repairs("А") == []
    # Letters that fit both scripts: the one with more of them goes first.
    assert lookalikes.repairs("сoрае") == ["сорае", "copae"] and lookalikes.repairs("copаe") == ["copae", "сорае"]


def test_accent_on_a_look_alike():
    assert lookalikes.repairs("Bе\u0301randol") == ["Bérandol"]


def test_alike_pairs(spark):
    a = "Figure 3 Water balance"
    rows = [(1, a), (2, a), (3, "Fіgurе 3 Wаter balance"), (4, "Ｆｉｇｕｒｅ ３ Water balance"), (5, "figure 3 water balance"), (6, None), (7, ""), (8, "Figure 3 Wa​ter balance"), (9, "слово русское целое"), (10, "short"), (11, "ѕhort"), (8, "Figure 3 Wa​ter balance")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "block_id long, text string, form string")
    got = {(r.a, r.b) for r in lookalikes.alike(lookalikes.families(lookalikes.hashed(lookalikes.forms(df, "block_id", ("text",)), "block_id", {"text": 8}))).collect()}
    assert got == {(i, j) for i, j in combinations((1, 2, 3, 4, 8), 2)} - {(1, 2)}
    assert lookalikes.forms(df.limit(0), "block_id", ("text",)).count() == 0


def test_unknown_words_stay(spark):
    df = spark.createDataFrame([(1, "Хyzzу Table"), (2, "other Tаble")], "block_id long, text string")
    got = {r.block_id: r.form for r in lookalikes.forms(df, "block_id", ("text",)).collect()}
    assert got == {1: "Хyzzу Table", 2: "other Table"}


def test_dominant_script_other_than_latin(spark):
    assert lookalikes.repairs("тeмператур") == ["температур"] and lookalikes.repairs("тeпл") == ["тепл"] and lookalikes.repairs("σχoλή") == ["σχολή"]
    assert lookalikes.repairs("Fіgurе") == ["Figure"] and lookalikes.repairs("словоf") == [] and lookalikes.repairs("слово") == []
    rows = [(1, "средних температур"), (2, "средних тeмператур"), (3, "тёплый сaхар"), (4, "тёплый сахар"), (5, "тëплый сахар"), (6, "нeт слова"), (7, "cоcоa слова"), (8, "cocoa")]
    got = {r.block_id: r.form for r in lookalikes.forms(spark.createDataFrame(rows, "block_id long, text string"), "block_id", ("text",)).collect()}
    assert got == dict(rows) | {2: rows[0][1], 3: rows[3][1], 5: rows[3][1], 7: "cocoa слова"}


# Segments ------------------------------------------------------------------------------------------------------------
@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 1200), st.sampled_from(["。", "\n", ". ", "，", "", "; "])), min_size=1, max_size=12), st.sampled_from(["Table", None, "Normal"]))
def test_pieces_cover_and_fit(parts, style):
    text = "".join("字x"[k % 2] * n + m for k, (n, m) in enumerate(parts))
    got = segments.pieces(text, style)
    assert got[0][0] == 0 and got[-1][1] == len(text)
    for (a, b, _), (c, d, _) in zip(got, got[1:]):
        assert c <= b < d and b - c <= 150 and c > a
    assert all(0 < b - a <= 800 for a, b, _ in got)
    if segments.cut_kind(text, style) == "natural":
        assert all(n for *_, n in got)


def test_cut_kinds(spark):
    rows = [(1, "甲" * 800 + "。" + "乙" * 10, None), (2, "甲" * 799 + "。" + "乙" * 10, None), (3, "甲" * 799 + "。" + "乙" * 10, "Table"), (4, "甲" * 800, None), (5, None, None), (6, "a" * 799 + "\r\n" + "b" * 5, "Table"), (7, "a" * 600 + "1.5" + "b" * 300, None), (8, "x" * 300000, None), (None, "y" * 900, None)]
    got = {r.block_id: r.cut_kind for r in segments.oversized(segments.split_oversized(spark.createDataFrame(rows, "block_id long, text string, style string"))).collect()}
    assert got == {1: "hard", 2: "natural", 3: "hard", 6: "hard", 7: "hard", 8: "hard"}


def test_valley_is_chosen():
    one, two = "太阳辐射随海拔升高而增加。" * 35, "市场收购价格同比上涨明显。" * 40
    assert segments.pieces(one + two, None)[0][1] == len(one)


def test_valley_in_the_first_half():
    one, two = "太阳辐射随海拔升高而增加。" * 20, "市场收购价格同比上涨明显。" * 60
    assert segments.pieces(one + two, None)[0][1] == len(one)


# Near copies ---------------------------------------------------------------------------------------------------------
def texts_for_copies():
    rng = random.Random(1)
    base = ["".join(rng.choices("气候区划指标土壤水分降水温度日照abcdefgh ", k=200)) for _ in range(12)]
    out = list(base)
    for t in base:
        for n in (1, 3, 8, 14):
            x = list(t)
            for _ in range(n):
                x[rng.randrange(len(x))] = rng.choice("甲乙丙丁")
            out.append("".join(x))
        out.append(t[30:] + t[:30])
    return out + base[:3] + ["x" * 99, "x" * 120, "x" * 120]


def brute_pairs(rows, least=0.7):
    s = {k: {t[i : i + 5] for i in range(len(t) - 4)} for k, t in rows if t and len(t) >= 100}
    return {(a, b) for a, b in combinations(sorted(s), 2) if len(s[a] & s[b]) / len(s[a] | s[b]) >= least}


@pytest.mark.parametrize("bucket", [200, 2])
def test_near_copies_against_brute_force(spark, bucket):
    rows = list(enumerate(texts_for_copies())) + [(500, None), (501, "")]
    df = spark.createDataFrame([(*r, "n") for r in rows], "block_id long, text string, rep string")
    members, links = nearcopies.near_copies(df, bucket=bucket)
    got = {(r.a, r.b) for r in nearcopies.all_pairs(members, links, "block_id").collect()}
    want = brute_pairs(rows)
    assert not got - want and len(want - got) <= len(want) * 0.01, (want - got)


def test_no_copies_in_nothing(spark):
    m, links = nearcopies.near_copies(spark.createDataFrame([], "block_id long, text string"))
    assert nearcopies.all_pairs(m, links, "block_id").count() == 0


def test_sketch_estimates():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 62, 400).astype(np.uint64)
    for share in (0.2, 0.5, 0.8):
        n = int(400 * 2 * share / (1 + share))
        b = np.concatenate((a[:n], rng.integers(0, 1 << 62, 400 - n).astype(np.uint64)))
        s = nearcopies.sketches(np.concatenate((a, b)), np.repeat([0, 1], 400), 2, 1024)
        assert abs((s[0] == s[1]).mean() - share) < 0.06
    tiny = nearcopies.sketches(a[:2], np.zeros(2, np.int64), 1, 64)
    assert (tiny != nearcopies.MASK).all()


# Encodings -----------------------------------------------------------------------------------------------------------
def repair_of(extra=()):
    clean = ["土壤相对湿度降到五成，需要在下旬补墒；气候区划指标与权重。", "槐屿乡大豆技术细则资料集", "Žitnávar Station Summary São Verdão Hälvik"] * 50 + list(extra)
    counts: dict[int, int] = {}
    for t in clean:
        for c in t:
            counts[ord(c)] = counts.get(ord(c), 0) + 1
    return mojibake.Repair(counts)


@pytest.mark.parametrize("wrong", ["cp1251", "latin-1", "cp437", "mac_roman", "gb18030"])
def test_round_trips(wrong):
    text = "土壤相对湿度降到五成，需要在下旬补墒；"
    raw = text.encode()
    bad = raw.decode(wrong, "ignore") if wrong == "gb18030" else "".join(bytes([b]).decode(wrong, "ignore") or chr(b) for b in raw)
    garbled, now = repair_of([bad]).fix(bad)
    assert garbled and (now == text or wrong == "gb18030" and now[:12] == text[:12])


def test_nested_partial_and_exchanged():
    r = repair_of()
    twice = "土壤湿度指标".encode().decode("latin-1").encode().decode("latin-1")
    assert r.fix(twice) == (True, "土壤湿度指标")
    assert r.fix("土壤" + "湿度指标".encode().decode("latin-1") + "权重")[1] == "土壤湿度指标权重"
    assert r.fix("需要在下旬补墒".encode("gbk").decode("latin-1"))[1] == "需要在下旬补墒"
    swapped = "土壤相对湿度降到五成需要在下旬补墒".encode("gbk").decode("big5", "ignore")
    assert r.fix(swapped)[0]
    assert r.fix("Å½itnÃ¡var Station") == (True, "Žitnávar Station") and r.fix("S茫o Verd茫o") == (True, "São Verdão")


def test_short_and_scattered_exchanges_are_suspects():
    r, clean = repair_of(), "土壤相对湿度降到五成，需要在下旬补墒；气候区划指标与权重。"
    garbled = []
    for a in range(len(clean) - 4):
        bad = clean[a : a + 4].encode("gbk").decode("big5", "ignore")
        garbled += [t for t in (bad, " 1234 5".join(bad)) if r.fix(t)[0]]
    assert garbled
    for t in garbled:
        assert r.suspects([clean, t, clean]) == [1] and r.suspects([t, clean]) == [0], t


def test_sound_texts_stay():
    r = repair_of()
    for t in ("Hälvik São Verdão VERDÃO Çelikar", "土壤湿度℃ ≥10℃·d —— “引文”", "Σχήμα 28", "слово русское", "plain", "m² Ñandelo É"):
        assert r.fix(t) == (False, t)
    assert r.fix("湿度�度")[0] and r.fix("锟斤拷资料")[0]


def test_repaired_table(spark):
    bad = "土壤湿度指标与权重".encode().decode("latin-1")
    rows = [(i, "土壤湿度指标与权重", "槐屿乡资料.pdf", "o") for i in range(30)] + [(100, bad, None, "o"), (101, None, bad, "o"), (102, "", "a", "o"), (None, bad, None, "o")]
    got = {(r.block_id, r.field, r.restored, r.whole) for r in mojibake.repaired(spark.createDataFrame(rows, "block_id long, text string, source string, original string")).collect()}
    assert got == {(100, "text", "土壤湿度指标与权重", True), (101, "source", "土壤湿度指标与权重", True)}
    assert mojibake.repaired(spark.createDataFrame([], "block_id long, text string, source string")).count() == 0


# Token ids -----------------------------------------------------------------------------------------------------------
def reference():
    import base64

    tiktoken = pytest.importorskip("tiktoken")
    path = f"{bpe.TOKENIZERS}/byte_bpe_50k.tiktoken"
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    return path, tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab 'sretlvmdSTZ1²½Ⅷ \n\t　 .,!?中文。气候é́😀​"), max_size=40), max_size=6))
def test_ids_equal_the_library(texts):
    path, ref = reference()
    ids, sizes = bpe.encoder(path).batch(texts)
    assert ids.tolist() == [i for t in texts for i in ref.encode_ordinary(t)] and sizes.tolist() == [len(ref.encode_ordinary(t)) for t in texts]


def test_encode_corpus(spark):
    _, ref = reference()
    texts = ["", None, "<|endoftext|>", "中" * 3000, "a" * 5000, " " * 700, "x'LL don't", "混合 text 12.5"]
    df = spark.createDataFrame([(i, t, [0]) for i, t in enumerate(texts)] + [(2, "again", [1])], "doc_id long, text string, ids array<int>")
    rows = bpe.encode_corpus(df).collect()
    assert len(rows) == 9 and sorted((r.doc_id, r.ids) for r in rows) == sorted((r.doc_id, ref.encode_ordinary(r.text or "")) for r in df.collect())
    assert bpe.encode_corpus(df.limit(0)).count() == 0


# Leaks ---------------------------------------------------------------------------------------------------------------
def test_distance():
    def slow(p, t, k):
        row = list(range(len(p) + 1))
        best = row[-1]
        for c in t:
            new = [0]
            for i, x in enumerate(p):
                new.append(min(row[i] + (x != c), row[i + 1] + 1, new[i] + 1))
            row = new
            best = min(best, row[-1])
        return best <= k

    rng = random.Random(2)
    for _ in range(400):
        p, t = ("".join(rng.choices("abc", k=rng.randint(1, 12))) for _ in range(2))
        for k in (0, 1, 2):
            assert not t or (leakage.distance(p, t, k) is not None) == slow(p, t, k)


def test_garbled_and_restored():
    clean = ["送审稿编号G5-4897，征求意见截止1月23日，收到74条意见，河谷与西南部差异显著。", "管理条例自2002年5月7日起废止，过渡期97个月。验收时应提交数据清单14份，缺项不得通过。", "苇寨市晚稻收购价每千克1.76元，同比下跌6.6%，误差不超过7.31。10月11日复测。"]
    counts: dict = {}
    for c in "".join(clean * 50):
        counts[ord(c)] = counts.get(ord(c), 0) + 1
    repair = mojibake.Repair(counts)
    ways = [lambda t: t.encode().decode("latin-1"), lambda t: t.encode("gbk").decode("latin-1"), lambda t: t.encode().decode("latin-1").encode().decode("latin-1")]
    assert [repair.fix(way(t)) for way in ways for t in clean] == [(True, t) for _ in ways for t in clean]
    assert [repair.fix(t) for t in clean] == [(False, t) for t in clean]


@pytest.mark.parametrize("budget", [0, 1, 2])
def test_leaks_against_brute_force(spark, budget):
    rng = random.Random(4)
    zh = ["".join(rng.choices("气候区划指标土壤水分降水温度", k=60)) for _ in range(6)]
    en = [" ".join(rng.choices(["frost", "drought", "zone", "maize", "yield", "basin"], k=40)) for _ in range(4)]
    items = [(i, t, None if i % 2 else zh[0][:10]) for i, t in enumerate(zh + en)]
    docs = []
    for i in range(300):
        t = rng.choice(zh + en)
        n = rng.choice([15, 29, 30, 31, 45]) if t in zh else rng.choice([60, 110, 150])
        a = rng.randrange(max(1, len(t) - n))
        cut = t[a : a + n]
        docs.append((i, "".join(rng.choices("乱字", k=5)) + rng.choice([cut, cut.upper(), "，".join(cut), "<b>" + cut]) + "尾"))
    docs += [(900, None), (901, ""), (902, zh[0])]
    got = {(r.doc_id, r.item_id) for r in leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string"), budget=budget).collect()}
    want = set()
    for d, t in docs:
        x = leakage.fold(t)
        for k, *ps in items:
            for p in map(leakage.fold, ps):
                run = 30 if leakage.is_han(p) else 80
                if any(p[i : i + run] in x for i in range(len(p) - run + 1)):
                    want.add((d, k))
    assert got == want
    assert leakage.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([], "item_id long, question string, answer string")).count() == 0


def test_items_in_several_passes(spark):
    items = [(i, f"the {i:04d} frost came over the valley of {i * 7:05d} and stayed there for {i * 3:05d} nights and days in the year {i:04d}", None) for i in range(60)] + [(None, "x" * 200, None), (7, None, None)]
    docs = [(i, "He wrote: " + items[i % 60][1] + ".") for i in range(90)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, question string, answer string")
    want = {(i, i % 60) for i in range(90)}
    assert {tuple(r) for r in leakage.leaks(d, q, most=20).collect()} == want
    assert {tuple(r) for r in leakage.near_leaks(d, q, most=20).collect() if r.edits == 0} == {(i, j, 0) for i, j in want}


def test_near_leaks_against_brute_force(spark):
    rng = random.Random(7)
    zh = ["".join(rng.choices("气候区划指标土壤水分降水温度日照", k=50)) for _ in range(5)]
    docs = []
    for i in range(150):
        t = rng.choice(zh)
        a = rng.randrange(len(t) - 31)
        cut = list(t[a : a + rng.choice([28, 30, 31, 36])])
        for _ in range(rng.randint(0, 3)):
            k = rng.randrange(len(cut))
            cut[k : k + rng.randint(0, 1)] = rng.choice(["", "乱", "字"])
        docs.append((i, "前文" + "".join(cut) + "后文"))
    items = list(enumerate(zh))

    def fewest(p, t):
        row = [0] * (len(t) + 1)
        for i, c in enumerate(p, 1):
            new = [i]
            for j, d in enumerate(t, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
            row = new
        return min(row)

    want = {(d, k): e for d, t in docs for k, p in items if (e := min(fewest(p[i : i + 30], t) for i in range(len(p) - 29))) <= 2}
    schema = "item_id long, question string"
    got = {(r.doc_id, r.item_id): r.edits for r in leakage.near_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, schema), passages=("question",)).collect()}
    assert got == want and set(got.values()) == {0, 1, 2}


# Subjects ------------------------------------------------------------------------------------------------------------
def test_subjects(spark):
    rng = random.Random(6)
    kinds = {"soil": "{}月土壤相对湿度降到{}，需要在{}日前灌水补墒", "trade": "{}年苹果收购价格上涨{}元，出口销往{}个县", "code": "程序版本{}修复解析错误，影响{}行，接口返回{}条"}

    def doc(*parts):
        return "".join(kinds[p].format(*rng.choices(range(1, 99), k=3)) + "。" for p in parts)

    labelled = [(i, doc(*[k] * 6), k) for i, k in enumerate(list(kinds) * 25)]
    tests = [(1000, doc(*["soil"] * 4), {"soil"}), (1001, doc("soil", "soil", "trade", "trade"), {"soil", "trade"}), (1002, doc(*["code"] * 9, "soil"), {"code"}), (1003, "图书馆闭馆通知请各位读者互相转告。食堂午餐调整充值。", set()), (1004, None, set()), (1005, "", set())]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in labelled + tests], "doc_id long, text string, subject string")
    areas = spark.createDataFrame([(k, k) for k in kinds], "subject string, description string")
    labels = spark.createDataFrame([(i, k, None) for i, _, k in labelled] + [(0, "soil", "x"), (None, "soil", None), (1, None, None)], "doc_id long, subject string, labeller string")
    got: dict = {}
    for r in subjects.assign(docs, areas, labels).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert {i: got.get(i, set()) for i, *_ in tests} == {i: s for i, _, s in tests}
    assert subjects.assign(docs, areas, labels.limit(0)).count() == 0 and subjects.assign(docs.limit(0), areas, labels).count() == 0


def test_subjects_without_labels(spark):
    kinds = {"soil": "soil moisture fell to {} percent so irrigation of the fields began on day {}", "trade": "prices and export trade of apples rose by {} yuan in the markets of {} counties"}
    docs = [(i, ". ".join(kinds[k].format(i + j, j * 7) for j in range(5)) + ".") for i in range(40) for k in [sorted(kinds)[i % 2]]]
    areas = [("soil_water", "Soil moisture and irrigation"), ("farm_economy", "Prices, export trade and markets")]
    d, a = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(areas, "subject string, description string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    got = {(r.doc_id, r.subject) for r in subjects.assign(d, a, none).collect()}
    assert got == {(i, "soil_water" if i % 2 == 0 else "farm_economy") for i in range(40)}


def test_too_many_subjects(spark):
    areas = spark.range(subjects.MOST_SUBJECTS + 1).selectExpr("CAST(id AS STRING) AS subject", "'x' AS description")
    docs, labels = spark.createDataFrame([(1, "x")], "doc_id long, text string"), spark.createDataFrame([(1, "0")], "doc_id long, subject string")
    with pytest.raises(ValueError, match="more than"):
        subjects.assign(docs, areas, labels)


def test_bisecting_kmeans_separates():
    rng = np.random.default_rng(1)
    x = np.repeat(np.eye(6, 40), 20, 0) + rng.normal(0, 0.03, (120, 40))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    leaf = subjects.bisecting_kmeans(x.astype(np.float32), 6)
    assert len({(leaf[k * 20], tuple(set(leaf[k * 20 : k * 20 + 20]))) for k in range(6)}) == 6
