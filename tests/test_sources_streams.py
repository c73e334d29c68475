import io
import zipfile

from corvane.sources import files
from corvane.streaming import events

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def packed(parts: dict[str, str]) -> bytes:
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        for k, v in parts.items():
            z.writestr(k, v)
    return b.getvalue()


def docx() -> bytes:
    p = '<w:p><w:pPr><w:pStyle w:val="h1"/></w:pPr><w:r><w:t>标题</w:t></w:r></w:p><w:p><w:r><w:t>正文</w:t></w:r></w:p>'
    cell = lambda t: f"<w:tc><w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    t = "<w:tbl>" + "".join(f"<w:tr>{cell(a)}{cell(b)}</w:tr>" for a, b in (("名称与单位", "数值大小"), ("产量", "12"))) + "</w:tbl>"
    return packed({"word/document.xml": f"<w:document {W}><w:body>{p}{t}</w:body></w:document>", "word/styles.xml": f'<w:styles {W}><w:style w:styleId="h1"><w:name w:val="heading 1"/></w:style></w:styles>'})


def xlsx() -> bytes:
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    sheet = f'<worksheet {ns}><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>y</t></is></c></row><row><c r="A2"><v>1</v></c><c r="C2"><v>3</v></c></row><row><c r="A3"><v>2</v></c><c r="C3" t="inlineStr"><is><t>n</t></is></c></row></sheetData></worksheet>'
    return packed({"xl/workbook.xml": f'<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="S" r:id="a"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/s.xml"/></Relationships>', "xl/worksheets/s.xml": sheet, "xl/sharedStrings.xml": f"<sst {ns}><si><t>x</t></si></sst>"})


def test_readers(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "skip").mkdir()
    (tmp_path / "a/one.docx").write_bytes(docx())
    (tmp_path / "a/bad.docx").write_bytes(b"no zip")
    (tmp_path / "skip/two.docx").write_bytes(docx())
    (tmp_path / "t.xlsx").write_bytes(xlsx())
    (tmp_path / "c.csv").write_bytes("站点,值\n甲,1\n乙,2.5\n,\n".encode("gbk"))
    found = files.scan(spark, str(tmp_path), ("skip",))
    assert found.count() == 4
    blocks = files.word_blocks(found).orderBy("seq").collect()
    assert [(b.text.split("\n")[0], b.style) for b in blocks] == [("标题", "heading 1"), ("正文", "Normal"), ("| 名称与单位 | 数值大小 |", "Table")]
    cells = files.table_cells(found)
    stats = {(r.header): (r.n, r.lowest, r.highest, r.mean) for r in files.column_stats(cells).collect()}
    assert stats == {"值": (2, 1.0, 2.5, 1.75), "x": (2, 1.0, 2.0, 1.5)}
    assert {r.text for r in files.first_rows(cells).collect()} == {"站点=甲; 值=1\n站点=乙; 值=2.5", "x=1; y=3\nx=2; y=n"}


def test_summaries_and_tables(spark, tmp_path):
    (tmp_path / "05x/05x").mkdir(parents=True)
    (tmp_path / "05x/05x/c.csv").write_bytes(b"a,b\n1,2\n")
    (tmp_path / "t.xlsx").write_bytes(xlsx())
    (tmp_path / "c.csv").write_bytes("站点,值\n甲,1\n乙,2.5\n丙,\n".encode("gbk"))
    (tmp_path / "empty.csv").write_bytes(b"a,b\n")
    got = {r.id: r.content for r in files.table_summaries(files.scan(spark, str(tmp_path), nested="05x/05x")).collect()}
    assert set(got) == {"t_S", "c"}
    assert got["t_S"] == "表格: S\n列名: x, y\n数据行数: 2\n\n数值列统计:\n  x: 最小值=1.0000, 最大值=2.0000, 平均值=1.5000\n\n前5行数据示例:\n  行2: 1 |  | 3\n  行3: 2 |  | n"
    assert got["c"] == "CSV 数据文件: c.csv\n总行数: 3\n\n字段列表:\n- 站点\n- 值\n\n数值字段统计:\n  值: 范围 [1.00, 2.50], 均值 1.75, 共 2 条\n\n前5行数据示例:\n  [1] 站点=甲, 值=1\n  [2] 站点=乙, 值=2.5\n  [3] 站点=丙, 值="
    files.write_table(spark.createDataFrame([(1, "a"), (2, "b")], "i int, g string"), f"{tmp_path}/out", ["g"])
    files.write_table(spark.createDataFrame([(3, "a")], "i int, g string"), f"{tmp_path}/out", ["g"])
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("i", "g").collect()] == [(3, "a")]


def test_late_rows_leave_the_stream(spark, tmp_path):
    e = event_rows(spark)
    late = spark.createDataFrame([(900, 1, "click", 1.0)], "event_id long, user_id long, event_type string, value double").selectExpr("event_id", "timestamp'2023-12-30 00:00:00' ts", "user_id", "event_type", "value")
    path = str(tmp_path / "in")
    e.coalesce(1).write.parquet(path)
    src = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = events.tumbling(events.watermarked(src, "1 hour"), "10 minutes").writeStream.format("memory").queryName("late").outputMode("update").start()
    q.processAllAvailable()
    late.coalesce(1).write.mode("append").parquet(path)
    q.processAllAvailable()
    q.stop()
    assert spark.table("late").agg({"n": "sum"}).first()[0] == 40


def test_reports(spark):
    from corvane.operators import diagnosis

    d = spark.createDataFrame([("a|b", 0.5, None), ("c", 1.0, 2)], "x string, y double, z int").orderBy("x")
    assert diagnosis.markdown(d, 1) == "| x | y | z |\n| --- | --- | --- |\n| a\\|b | 0.5000 |  |\n…"


def test_encodings():
    assert files.decoded("气候".encode("gbk")) == ("气候", "gbk") and files.decoded("气候".encode()) == ("气候", "utf-8")
    assert files.pipe_table([["a"], ["b"]]) == ""


def test_json_cache(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"_meta": {"s": "x"}, "k1": {"s": "y"}}')
    got = files.json_cache(spark, str(tmp_path / "c.json"), "struct<s: string>").collect()
    assert [(r.key, r.value.s) for r in got] == [("k1", "y")]


def event_rows(spark, n=40):
    return spark.createDataFrame([(i, f"2024-01-01 00:{i:02d}:00", i % 3, ("click", "buy")[i % 2], float(i)) for i in range(n)], "event_id long, t string, user_id long, event_type string, value double").selectExpr("event_id", "cast(t as timestamp) ts", "user_id", "event_type", "value")


def test_stream_equals_batch(spark, tmp_path):
    e = event_rows(spark)
    e.write.parquet(str(tmp_path / "e.parquet"))
    want = {tuple(r) for r in events.tumbling(e, "10 minutes").collect()}
    got = {tuple(r) for r in events.run_stream(spark, str(tmp_path / "e.parquet"), "10 minutes").select("start", "event_type", "n", "total").collect()}
    assert got == want


def test_state_and_redelivery(spark, tmp_path):
    e = event_rows(spark, 12)
    e.unionByName(e).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    q = events.once(s).writeStream.format("memory").queryName("once").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 12
    q = events.running_totals(s).writeStream.format("memory").queryName("totals").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert {(r.user_id, r.n) for r in spark.table("totals").collect()} == {(0, 8), (1, 8), (2, 8)}


def test_as_of_and_sessions(spark):
    e = event_rows(spark, 8)
    got = {r.event_id: r.before for r in events.as_of(e.filter("event_type = 'buy'"), e.filter("event_type = 'click'")).collect()}
    assert got == {1: None, 3: 0, 5: 2, 7: 4}
    assert events.sessions(e, "2 minutes").count() == 8
