from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunks, linearise, structure


def flags(spark, f, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.select("i", f(F.col("t")).alias("x")).orderBy("i").select("x").collect()]


def test_headings(spark):
    texts = ["第6章 总则", "第一章　x", "一、概述", "（二）方法", "5.2.4 指标", "3、说明", "(1) a", "附录A", "B. x", "  1.2 x", "正文", "", None]
    assert flags(spark, T.is_heading, texts) == [True] * 10 + [False] * 3


def test_style_levels(spark):
    assert flags(spark, T.style_level, ["Heading 2", "标题 3", "heading", "标题", "Normal", None, "TOC 1"]) == [2, 3, 1, 1, 0, 0, 1]


def test_sentence_predicates(spark):
    assert flags(spark, T.ends_mid_sentence, ["abc", "完。", "如下：", "", " x ; "]) == [True, False, False, False, False]
    assert flags(spark, T.is_complete_sentence, ["完。", "完", "好！ "]) == [True, False, True]
    assert flags(spark, T.is_transition, ["主要包括三类", "如下：", "x" * 119 + "：", "x" * 118 + "：", ""]) == [True, True, False, True, False]
    assert flags(spark, T.is_short_fragment, ["一段", "x" * 80, "即某某", "1. 项", "完。"]) == [True, False, False, False, False]


def test_tables(spark):
    flat = "表1-2 指标\n1\n2\n3\n4\n5 mm\n6 kg\n名称\n等级\n说明\n其他"
    assert flags(spark, T.is_table, ["|a|b|\n|1|2|", "甲\n乙", "1 a\n2 b\n3 c", flat, "", None]) == [True, False, True, True, False, False]
    assert flags(spark, lambda c: T.table_marks(c)["longest"], ["1\n2\na\n3\n4\n5", "a", ""]) == [3, 0, 0]
    # Digits within letters, Han ones too, are no number.
    assert flags(spark, lambda c: T.table_marks(c)["n_numeric"], ["第3章\n约12毫米\n12 毫米\n12.5mm\n(7)", "a1\nb_2"]) == [3, 0]


def test_contents_and_quality(spark):
    assert flags(spark, T.is_toc_section, ["总则.......3", "正文一行\n正文二行\n总则.......3", "总则\t\t3\n范围\t\t4"]) == [True, False, True]
    assert flags(spark, T.is_toc_page, ["IV\nx", "a....1\nb....2\nc", "正文"]) == [True, True, False]
    assert flags(spark, T.quality_reasons, ["x" * 49, "x" * 50, "# 目 录" + "x" * 60, "参考文献"]) == ["short", "", "contents", "short; references"]
    assert flags(spark, T.clean_page_text, ["a\nIV\nb\n12\nc\n\n\n\nd"]) == ["a\nb\nc\n\nd"]
    assert flags(spark, T.clean_cell, [" —— ", "[0～0.27)", "１２"]) == ["", "0至0.27", "12"]


def test_sections_merge_and_filter(spark):
    body = "气候指标说明，" * 12
    secs = spark.createDataFrame([("d", 1, ["t"], ["短标题"]), ("d", 2, ["u"], [body + "完。"]), ("d", 3, ["v"], ["a|b|c|d|e"]), ("d", 4, ["w"], ["1|2|3|4|5"]), ("d", 5, ["x"], ["仅供参考"])], "doc_id string, sec_ord int, heading_path array<string>, blocks array<string>")
    kept = {r.sec_ord: r.blocks for r in structure.filter_sections(secs, "气候").collect()}
    assert kept == {2: ["短标题", body + "完。"], 3: ["a|b|c|d|e", "1|2|3|4|5"]}
    dropped = {r.sec_ord for r in structure.filter_sections(secs, "气候", "drop_both").collect()}
    assert dropped == {3}
    merged = {r.sec_ord: r.merged for r in structure.merge_tables(secs).collect()}
    assert merged == {1: 1, 2: 1, 3: 2, 5: 1}


def test_section_tiers(spark):
    schema = "doc_id string, seq long, block_id long, text string, style string, font_size double, is_title boolean"
    rows = [("s", 0, 1, "书", "Heading 1", None, None), ("s", 1, 2, "甲", "Heading 2", None, None), ("s", 2, 3, "正文", None, None, None), ("s", 3, 4, "乙", "Heading 2", None, None), ("s", 4, 5, "小", "Heading 3", None, None), ("s", 5, 6, "文", None, None, None), ("r", 0, 7, "一、甲", None, None, None), ("r", 1, 8, "x", None, None, None), ("r", 2, 9, "二、乙", None, None, None), ("r", 3, 10, "y", None, None, None), ("p", 0, 11, "只有正文。", None, None, None)]
    got = {(r.doc_id, r.tier, r.sec_ord): (r.heading_path, r.blocks) for r in structure.sections(spark.createDataFrame(rows, schema)).collect()}
    assert got[("s", 1, 1)] == (["书", "甲"], ["正文"]) and got[("s", 1, 2)] == (["书", "乙"], ["### 小", "文"])
    assert got[("r", 2, 1)] == (["一、甲"], ["x"]) and got[("p", 3, 0)] == ([""], ["只有正文。"])


def test_float_title_score(spark):
    rows = [("d", i, "x", float(s), False) for i, s in enumerate([8, 8, 8, 8, 8, 8, 8, 10, 10, 12])] + [("d", 10, "短", 10.0, True)]
    b = spark.createDataFrame(rows, "doc_id string, block_id int, text string, font_size double, bold boolean")
    got = {r.block_id: r.layout_title for r in structure.layout_titles(b).collect()}
    assert got[10] and got[9] and not got[0]


def test_headers_need_many_pages(spark):
    rows = [("d", p, p * 10 + i, t, float(i)) for p in range(5) for i, t in enumerate(["页眉", f"文{p}", f"中{p}", f"尾{p}"])]
    b = spark.createDataFrame(rows, "doc_id string, page int, block_id long, text string, y0 double")
    assert structure.header_footer_noise(b).count() == 1
    assert structure.without_headers_footers(b).count() == 15


def test_cross_format_ratio(spark):
    d = spark.createDataFrame([("g", "a.docx", 115), ("g", "a.pdf", 100), ("h", "b.docx", 116), ("h", "b.pdf", 100)], "g string, source string, size int")
    assert [r.source for r in structure.cross_format(d, ["g"], "source", "size").collect()] == ["b.pdf"]


def test_recursive_split():
    text = "。".join("句" * 90 for _ in range(30)) + "。"
    parts = chunks.split_recursively(text)
    assert max(map(len, parts)) <= 800 and len(parts) > 3
    assert all(b[:40] in a for a, b in zip(parts, parts[1:]) if b.lstrip("。")[:40] in a) and "".join(parts).count("句") >= 2700
    assert chunks.split_recursively("x" * 2000)[0] == "x" * 800
    assert chunks.split_recursively("短") == ["短"]


def test_packing_and_page_blocks(spark):
    assert flags(spark, lambda c: structure.pack_sentences(c, 6), ["甲乙。丙丁。戊己庚辛壬癸子。", ""]) == [["甲乙。丙丁。", "戊己庚辛壬癸子。"], [""]]
    df = spark.createDataFrame([(1, "一、标题\n" + "字" * 12 + "\n" + "字" * 12 + "\n\n短")], "k int, t string")
    assert [r.text for r in structure.page_blocks(df, "k", "t").orderBy("para", "part").collect()] == ["一、标题", "字" * 24]


def test_linearised():
    L = linearise.linearised
    assert L("| 作物 | 产量 |\n| --- | --- |\n| 大豆 | ３.5 |\n| 小麦 | 4～5 |") == "该表格列出大豆、小麦等2项指标的具体数值。大豆的产量为3.5；小麦的产量为4至5"
    assert L("| 作物 | 产量 |\n| 大豆 | 3.5 |") is None and L("没有表") is None and L(None) is None  # without a rule there is no data
    assert L("|" + "|".join("abcdefghijk") + "|\n|" + "|".join("-" * 11) + "|\n|" + "|".join("x" * 11) + "|") is None
    place = linearise.Place("新疆", "冬小麦", "种植区划", "表格3")
    assert L("| 区 | 指标 |\n|---|---|\n| 适宜区 | ≥10℃ |\n| 风险区 | 无 |", place) == "新疆冬小麦种植区划中，该表格为区划指标体系，列出适宜区、风险区等2项因子的指标分级阈值。区：适宜区的指标为≥10℃；风险区"
    # A second line of headings, three columns, a row without label.
    assert L("| 项 | a | b |\n|---|---|---|\n| 项 | 高 | 低 |\n| 甲 | 1.5 | — |\n|  | 2.5 | 3.5 |\n| 乙 | x | y |") == "该表格列出甲、乙等2项指标的具体数值。甲：高 1.5。乙：高 x，低 y"
    assert L("| 均温 | 降水 |  |\n|---|---|---|\n| 12.5 | 600.5 | x |") == "该表格为权重分配，列出均温、降水等2个维度的权重系数。均温 12.5，降水 600.5，x"
    assert linearise.Place("全国", "大豆", "", "标题").context == "大豆，标题" and linearise.Place(section_title="标题").context == "标题"


def test_cells_on_lines():
    L = linearise.linearised
    flat = "表1 指标\n指标名称\n甲因子\n1.5\n2.5\n乙因子\n3.5\n4.5"
    assert L(flat) == "表1 指标中，指标名称：该表格列出甲因子、乙因子等2项指标的具体数值。甲因子：1.5，2.5。乙因子：3.5，4.5"
    assert L("表1 指标\n甲\n1.5\n2.5\n乙\n3.5\n4.5") is None  # no heading line
    assert L("\n".join(["8~12", "30", "12~15", "20", "5", "<8", ">15", "0"])) == "8至12→30分；12至15→20分；<8→5分；>15→0分"
    assert L("\n".join(["积温指标", "≥3000", "2500~3000", "日", "降水指标", "500", "400", "300", "200", "100"])) == "积温指标：≥3000，2500至3000（日）。降水指标：500，400，300；200，100"
    assert L("\n".join(["一段普通的文字"] * 9)) is None
    v = linearise.is_value_line
    assert [v(x) for x in ("42.0", "6-8月空气", "6—8 月平均气温≥26.0℃", "<260", "或12.6~15.4", "S<200", "甲", "")] == [True, False, True, True, True, True, False, False]
    assert linearise.is_score("30") and not linearise.is_score("3000") and linearise.is_range("8至12") and not linearise.is_range("8")


def test_table_chunks(spark):
    long = "前。" + "内容内容。" * 400
    assert all(w.startswith("前。") and len(w) <= 800 for w in linearise.windows(long)) and len(linearise.windows(long)) == 3
    text = "| 项 | 值 |\n|---|---|\n" + "\n".join(f"| 名称{i}号 | {i}.5 |" for i in range(80))
    df = spark.createDataFrame([("a", text, "table", "新疆"), ("b", text, "text", None), ("c", None, "table", None)], "id string, t string, kind string, province string")
    got = {r.id: r for r in linearise.table_chunks(df, "id", "t", "kind").collect()}
    assert set(got) == {"a", "b", "c"} and got["a"].t.startswith("新疆中，") and got["b"].t == text and got["c"].t is None


def test_empty_frames(spark):
    b = spark.createDataFrame([], "doc_id string, seq long, block_id long, text string, style string, font_size double, bold boolean, is_title boolean, page int, y0 double")
    assert structure.sections(b).count() == 0 and structure.without_headers_footers(b).count() == 0 and structure.layout_titles(b).count() == 0
