"""Readers of office documents, tables and JSON caches, and their writers."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".docx", ".pdf", ".xlsx", ".csv", ".json")
ENCODINGS = ("utf-8", "gbk", "gb2312", "gb18030", "latin-1")
#: Bytes beyond which a PDF is left out.
PDF_LIMIT = 50 << 20
BLOCK = "doc_id string, source string, seq long, text string, style string"
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def scan(spark: SparkSession, folder: str, skip: tuple[str, ...] = (), nested: str | None = None) -> DataFrame:
    """(path, length, suffix, content) of files with a known suffix below a folder, outside the named directories and, where
    given, outside paths that match `nested` (folders copied into themselves); PDFs only up to a size. Files have no
    order; readers number what they read within each file, and path orders the files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    files = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"(\.\w+)$", 1))).filter(F.col("suffix").isin(*SUFFIXES))
    for name in skip:
        files = files.filter(~F.col("path").contains(f"/{name}/"))
    if nested:
        files = files.filter(~F.col("path").rlike(nested))
    return files.filter((F.col("suffix") != ".pdf") | (F.col("length") <= PDF_LIMIT)).select("path", "length", "suffix", "content")


def pipe_table(rows: list[list[str]]) -> str:
    """Rows as a pipe table with a rule under the first; empty below 30 characters."""
    clean = [" | ".join(c.replace("\n", " ").strip() for c in r) for r in rows]
    if not clean:
        return ""
    out = [f"| {clean[0]} |", "|" + " --- |" * len(rows[0]), *(f"| {r} |" for r in clean[1:])]
    text = "\n".join(out)
    return text if len(text) >= 30 else ""


def docx_blocks(data: bytes) -> list[tuple[str, str | None]]:
    """(text, style) of paragraphs and tables in their order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{WORD}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{WORD}style"):
                label = s.find(f"{WORD}name")
                names[s.get(f"{WORD}styleId")] = label.get(f"{WORD}val") if label is not None else None

    def words(node) -> str:
        return "".join(t.text or "" if t.tag == f"{WORD}t" else "\t" if t.tag == f"{WORD}tab" else "\n" for t in node.iter() if t.tag in (f"{WORD}t", f"{WORD}tab", f"{WORD}br"))

    out = []
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p":
            style = node.find(f"{WORD}pPr/{WORD}pStyle")
            key = style.get(f"{WORD}val") if style is not None else None
            if text := words(node).strip():
                out.append((text, names.get(key, key) if key else "Normal"))
        elif node.tag == f"{WORD}tbl":
            rows = [[words(c) for c in r.iter(f"{WORD}tc")] for r in node.iter(f"{WORD}tr")]
            if text := pipe_table(rows):
                out.append((text, "Table"))
    return out


def xlsx_sheets(data: bytes) -> list[tuple[str, list[list[str]]]]:
    """(sheet, rows of cell texts), rows without a filled cell left out."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{SHEET}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall(f"{SHEET}si")]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        out = []
        for sheet in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{SHEET}sheet"):
            target = links[sheet.get(RELATION)].lstrip("/")
            rows = []
            for r in ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}")).iter(f"{SHEET}row"):
                cells: dict[int, str] = {}
                for at, c in enumerate(r.findall(f"{SHEET}c")):
                    letters = re.match(r"[A-Z]*", c.get("r") or "").group()
                    col = at
                    if letters:
                        col = 0
                        for ch in letters:
                            col = col * 26 + ord(ch) - 64
                        col -= 1
                    v = c.find(f"{SHEET}v")
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t")) if c.get("t") == "inlineStr" else (v.text or "" if v is not None else "")
                    cells[col] = shared[int(text)] if c.get("t") == "s" and text else text
                row = [cells.get(k, "") for k in range(max(cells, default=-1) + 1)]
                if any(x.strip() for x in row):
                    rows.append(row)
            out.append((sheet.get("name"), rows))
        return out


def decoded(data: bytes, encodings: tuple[str, ...] = ENCODINGS) -> tuple[str, str]:
    """Text and the first encoding that reads all of it."""
    for e in encodings:
        try:
            return data.decode("utf-8-sig" if e == "utf-8" else e), e
        except UnicodeDecodeError:
            pass
    return data.decode("latin-1"), "latin-1"


def table_cells(files: DataFrame) -> DataFrame:
    """(path, sheet, row, col, header, value) of every filled cell of xlsx and csv files; the first row is the header."""
    import csv

    def run(batches):
        for b in batches:
            out = []
            for path, suffix, data in zip(b["path"], b["suffix"], b["content"]):
                try:
                    sheets = xlsx_sheets(bytes(data)) if suffix == ".xlsx" else [("", [r for r in csv.reader(io.StringIO(decoded(bytes(data))[0])) if any(x.strip() for x in r)])]
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue  # a broken file has no cells
                for name, rows in sheets:
                    head = rows[0] if rows else []
                    out += [(path, name, i, j, head[j].strip() if j < len(head) else "", v.strip()) for i, r in enumerate(rows[1:], 1) for j, v in enumerate(r) if v.strip()]
            yield pd.DataFrame(out, columns=["path", "sheet", "row", "col", "header", "value"])

    return files.filter(F.col("suffix").isin(".xlsx", ".csv")).select("path", "suffix", "content").mapInPandas(run, "path string, sheet string, row int, col int, header string, value string")


def numbers(values: list[str]) -> list[float] | None:
    """The values as numbers, None where one isn't or there are none."""
    try:
        return [float(v) for v in values] or None
    except ValueError:
        return None


def sheet_summary(name: str, rows: list[list[str]]) -> str:
    """A sheet in words (fixed form): its name, columns, number of rows, ranges and means of columns of numbers, first five rows."""
    head, data = rows[0], rows[1:]
    out = [f"表格: {name}", f"列名: {', '.join(h for h in head if h)}", f"数据行数: {len(data)}", ""]
    stats = []
    for j, h in enumerate(head):
        if vals := numbers([r[j] for r in data if j < len(r) and r[j].strip()]):
            stats.append(f"  {h}: 最小值={min(vals):.4f}, 最大值={max(vals):.4f}, 平均值={sum(vals) / len(vals):.4f}")
    return "\n".join(out + (["数值列统计:", *stats] if stats else []) + ["\n前5行数据示例:", *(f"  行{i}: {' | '.join(r)}" for i, r in enumerate(data[:5], 2))])


def csv_summary(name: str, rows: list[list[str]]) -> str:
    """The same of a CSV file: its fields, ranges and means of those all of whose values are numbers, first five rows."""
    head, data = rows[0], [r + [""] * (len(rows[0]) - len(r)) for r in rows[1:]]
    stats = []
    for j, h in enumerate(head):
        if vals := numbers([r[j] for r in data if r[j].strip()]):
            stats.append(f"  {h}: 范围 [{min(vals):.2f}, {max(vals):.2f}], 均值 {sum(vals) / len(vals):.2f}, 共 {len(vals)} 条")
    fields = "\n".join(f"- {h}" for h in head)
    out = [f"CSV 数据文件: {name}", f"总行数: {len(data)}", f"\n字段列表:\n{fields}"] + (["\n数值字段统计:", *stats] if stats else []) + ["\n前5行数据示例:"]
    return "\n".join(out + [f"  [{i}] {', '.join(f'{h}={v}' for h, v in zip(head, r))}" for i, r in enumerate(data[:5], 1)])


def table_summaries(files: DataFrame) -> DataFrame:
    """(id, doc_id, sheet, content): one chunk for each sheet of xlsx files and each csv file; without rows or broken, none."""
    import csv

    def run(batches):
        for b in batches:
            out = []
            for path, suffix, data in zip(b["path"], b["suffix"], b["content"]):
                name = path.rsplit("/", 1)[-1]
                stem = name.rsplit(".", 1)[0]
                try:
                    if suffix == ".xlsx":
                        out += [(f"{stem}_{n}", stem, n, sheet_summary(n, rows)) for n, rows in xlsx_sheets(bytes(data)) if len(rows) > 1]
                    elif len(rows := [r for r in csv.reader(io.StringIO(decoded(bytes(data))[0])) if r]) > 1:
                        out.append((stem, stem, name, csv_summary(name, rows)))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
            yield pd.DataFrame(out, columns=["id", "doc_id", "sheet", "content"])

    return files.filter(F.col("suffix").isin(".xlsx", ".csv")).select("path", "suffix", "content").mapInPandas(run, "id string, doc_id string, sheet string, content string")


def column_stats(cells: DataFrame) -> DataFrame:
    """(path, sheet, col, header, n, lowest, highest, mean) of columns all of whose filled cells are numbers."""
    number = F.expr("try_cast(value AS double)")
    return cells.groupBy("path", "sheet", "col", "header").agg(F.count("*").alias("n"), F.count(number).alias("k"), F.min(number).alias("lowest"), F.max(number).alias("highest"), F.avg(number).alias("mean")).filter("n = k").drop("k")


def first_rows(cells: DataFrame, n: int = 5) -> DataFrame:
    """(path, sheet, text): the first rows as `header=value` lines."""
    line = cells.filter(F.col("row") <= n).groupBy("path", "sheet", "row").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("col", F.concat("header", F.lit("="), "value").alias("t")))), lambda x: x["t"]), "; ").alias("t"))
    return line.groupBy("path", "sheet").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "t"))), lambda x: x["t"]), "\n").alias("text"))


def word_blocks(files: DataFrame) -> DataFrame:
    """Blocks of docx files; a broken file has none."""

    def run(batches):
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                try:
                    found = docx_blocks(bytes(data))
                except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
                    continue
                name = path.rsplit("/", 1)[-1]
                out += [(path, name, i, t, s) for i, (t, s) in enumerate(found)]
            yield pd.DataFrame(out, columns=["doc_id", "source", "seq", "text", "style"])

    return files.filter("suffix = '.docx'").select("path", "content").mapInPandas(run, BLOCK)


def pdf_blocks(files: DataFrame) -> DataFrame:
    """Layout blocks of PDFs: (doc_id, source, seq, text, page, font_size, bold, x0, y0). Needs PyMuPDF; without it an error says so."""
    schema = "doc_id string, source string, seq long, text string, page int, font_size double, bold boolean, x0 double, y0 double"

    def run(batches):
        try:
            import fitz
        except ModuleNotFoundError as e:
            raise RuntimeError("reading PDFs needs PyMuPDF; give a blocks table instead") from e
        for b in batches:
            out = []
            for path, data in zip(b["path"], b["content"]):
                with fitz.open(stream=bytes(data), filetype="pdf") as doc:
                    for page, p in enumerate(doc):
                        for block in p.get_text("dict")["blocks"]:
                            for ln in block.get("lines", []):
                                spans = ln["spans"]
                                text = "".join(s["text"] for s in spans).strip()
                                if text:
                                    out.append((path, path.rsplit("/", 1)[-1], len(out), text, page, max(s["size"] for s in spans), any(s["flags"] & 16 for s in spans), spans[0]["bbox"][0], spans[0]["bbox"][1]))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return files.filter("suffix = '.pdf'").select("path", "content").mapInPandas(run, schema)


def json_cache(spark: SparkSession, path: str, entry: str) -> DataFrame:
    """(key, value) of JSON files that hold one object of objects; keys that begin with _ are notes."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string, {entry}>").alias("m"))
    return raw.select(F.explode("m").alias("key", "value")).filter(~F.col("key").startswith("_"))


def write_table(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    """Parquet, committed as a whole."""
    w = df.write.mode("overwrite")
    (w.partitionBy(*partition) if partition else w).parquet(path)
