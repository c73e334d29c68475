"""Column predicates over lines and bodies of text: headings, contents pages, tables, sentence ends, quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Heading forms, tried in order.
HEADING_FORMS = (
    r"第[一二三四五六七八九十\d]+章[\s\x{3000}]",
    r"第[一二三四五六七八九十\d]+\s+章",
    r"第[一二三四五六七八九十\d]+节[\s\x{3000}]",
    r"[一二三四五六七八九十]+[、．.\s]",
    r"（[一二三四五六七八九十]+）",
    r"\d+\.\d+\.\d+",
    r"\d+\.\d+",
    r"\d+[.、]",
    r"（\d+）",
    r"[(（]\d+[)）][\s\x{3000}]",
    r"附录[一二三四五六七八九十A-Z]?",
    r"[A-Z]\.\s",
)
HEADING = "^(?:" + "|".join(HEADING_FORMS) + ")"
# Contents lines, sentence ends, list marks, captions, units, cue phrases.
TOC_LINE = r"[.…]{3,}\s*\d+\s*$|\t{2,}\d+\s*$|\s{4,}\d+\s*$|^###\s+\d[\d.]*\s+\S.*\d"
DEFINITION = "是指|即|公式|定义"
LIST_ITEM = r"^\s*(?:[（(]?\d+[）).、]|[一二三四五六七八九十]+[、．]|[-•·*])"
UNIT = "℃|°C|mm|毫米|cm|厘米|米|km|%|％|kg|g|t|hm²|亩|≥|≤|>|<"
TRANSITIONS = ("包括以下", "主要包括", "如下", "具体如下", "分别为", "分为", "以下几个方面", "以下方面", "主要措施", "对策建议")
TEMPLATE_NOTES = ("不用删除", "标红内容为示例", "仅供参考")
DOMAIN = "区划|风险|作物|指标|气候|农业|气象|品种|种植|产量|品质|灾害|温度|降水|干旱|冷害|渍涝|霜冻|病虫害|土壤|光照|积温|日照|海拔|高原|地形|地势|地貌|丘陵|平原|山地|盆地|谷地|高程|纬度|经度"
#: White space that text() trims, in Java's and RE2's syntax alike.
BLANK = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CAPTION = rf"^表{BLANK}*[0-9一二三四五六七八九十]+"
#: A number that stands alone, as a word: digits within letters, Han ones included, are none.
NUMBER_WORD = r"(?:^|[^\p{L}\p{N}_])\p{Nd}+(?:[^\p{L}\p{N}_]|$)"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, f"^{BLANK}+|{BLANK}+$", "")


def is_heading(c: Column) -> Column:
    return F.coalesce(strip(c).rlike(HEADING), F.lit(False))


def style_level(style: Column) -> Column:
    """Heading level named by a paragraph style: its number, 1 without one, else 0."""
    number = F.regexp_extract(style, r"(?i)(?:heading|标题|TOC)\s*(\d+)", 1)
    return F.coalesce(F.when(number != "", number.cast("int")).when(style.rlike("(?i)heading|标题"), F.lit(1)), F.lit(0))


def lines(c: Column) -> Column:
    """Stripped lines that aren't blank."""
    return F.filter(F.transform(F.split(c, "\n"), strip), lambda x: x != "")


def ends_mid_sentence(c: Column) -> Column:
    return (strip(c) != "") & ~strip(c).rlike("[。！？；：:;]$")


def is_complete_sentence(c: Column) -> Column:
    return strip(c).rlike("[。！？]$")


def starts_continuation(c: Column) -> Column:
    """An absent or empty next body, or one that begins with a small letter, digit or Han character, goes on from the one before."""
    return F.coalesce((strip(c) == "") | strip(c).rlike(r"^[\p{Ll}\p{Nd}\x{4e00}-\x{9fff}]"), F.lit(True))


def toc_ratio(c: Column) -> Column:
    """Share of contents lines among non-blank raw lines; 0 for blank text."""
    rows = F.filter(F.split(c, "\n"), lambda x: strip(x) != "")
    return F.coalesce(F.size(F.filter(rows, lambda x: F.regexp_replace(x, f"^{BLANK}+", "").rlike(TOC_LINE))) / F.nullif(F.size(rows), F.lit(0)), F.lit(0.0))


def is_toc_section(c: Column) -> Column:
    rows = F.size(lines(c))
    return (toc_ratio(c) > 0) & ((rows == 1) | (toc_ratio(c) > 0.4))


def is_toc_page(c: Column) -> Column:
    """A line of Roman numerals alone, or leaders in over 40 % of all lines."""
    every = F.split(c, "\n")
    leaders = F.size(F.filter(every, lambda x: x.contains("....") | x.contains("……")))
    return F.coalesce(F.exists(every, lambda x: strip(x).rlike("^[IVX]+$")) | (leaders > F.size(every) * 0.4), F.lit(False))


def table_marks(c: Column) -> Column:
    """Struct (n_lines, n_numeric, longest, is_table) of a text, from one pass over its lines.

    A line that isn't blank is numeric where a number stands alone in it; longest is the longest run of numeric lines.
    A table has over three pipes, else at least two lines of which over 60 % are numeric or four points: a caption among
    the first five lines 2, numeric lines 2 from .6 or 1 from .5, two units 1, five numeric lines in a row 1.
    """
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("num"), F.lit(0).alias("now"), F.lit(0).alias("best"), F.lit(False).alias("cap"))

    def step(acc, line):
        caption = (acc["cap"] | ((acc["n"] < 5) & line.rlike(f"^{BLANK}*{CAPTION[1:]}"))).alias("cap")
        numeric = F.struct((acc["n"] + 1).alias("n"), (acc["num"] + 1).alias("num"), (acc["now"] + 1).alias("now"), F.greatest(acc["best"], acc["now"] + 1).alias("best"), caption)
        other = F.struct((acc["n"] + 1).alias("n"), acc["num"].alias("num"), F.lit(0).alias("now"), acc["best"].alias("best"), caption)
        return F.when(~line.rlike(f"[^{BLANK[1:]}"), acc).when(line.rlike(NUMBER_WORD), numeric).otherwise(other)

    def done(acc):
        ratio = acc["num"] / F.nullif(acc["n"], F.lit(0))
        points = (
            acc["cap"].cast("int") * 2 + F.when(ratio >= 0.6, 2).when(ratio >= 0.5, 1).otherwise(0)
            + (F.regexp_count(c, F.lit(UNIT)) >= 2).cast("int") + (acc["best"] >= 5).cast("int")
        )
        table = (F.regexp_count(c, F.lit(r"\|")) > 3) | ((acc["n"] >= 2) & ((ratio > 0.6) | (points >= 4)))
        return F.struct(acc["n"].alias("n_lines"), acc["num"].alias("n_numeric"), acc["best"].alias("longest"), F.coalesce(table, F.lit(False)).alias("is_table"))

    return F.aggregate(F.split(c, "\n"), zero, step, done)


def is_table(c: Column) -> Column:
    return F.coalesce(table_marks(c)["is_table"], F.lit(False))


def is_transition(c: Column) -> Column:
    body = strip(c)
    return (body != "") & (F.length(body) < 120) & body.rlike("[:：]$|" + "|".join(TRANSITIONS))


def is_short_fragment(c: Column) -> Column:
    body = strip(c)
    return (body != "") & (F.length(body) < 80) & ends_mid_sentence(c) & ~body.rlike(DEFINITION) & ~body.rlike(LIST_ITEM)


def is_junk(c: Column, notes: tuple[str, ...] = TEMPLATE_NOTES) -> Column:
    return c.rlike("|".join(notes))


def is_fragment(c: Column, following: Column, terms: str) -> Column:
    """Over 50 and under 250 characters, ends mid-sentence, has a term of the domain, and the next body goes on from it."""
    n = F.length(strip(c))
    return (n > 50) & (n < 250) & ends_mid_sentence(c) & strip(c).rlike(terms) & starts_continuation(following)


def clean_page_text(c: Column) -> Column:
    """Without lines of Roman numerals or page numbers, at most one blank line in a row."""
    c = F.regexp_replace(c, r"\n[IVX]+\n", "\n")
    c = F.regexp_replace(c, r"\n\d{1,3}\n", "\n")
    return F.regexp_replace(c, r"\n{3,}", "\n\n")


def quality_reasons(c: Column) -> Column:
    """Why a content is of low quality: shorter than 50, a contents heading, a references heading; empty if none."""
    body = strip(c)
    reasons = F.array(
        F.when(F.length(body) < 50, "short"),
        F.when(body.rlike(r"^[#\s]*(?:目\s*录|Contents|Table of Contents)"), "contents"),
        F.when(body.rlike(r"^[#\s]*(?:参考文献|References|参考书目)"), "references"),
    )
    return F.array_join(F.array_compact(reasons), "; ")


def compact_header(*parts: Column) -> Column:
    """`[a b c] ` of the parts that aren't empty; empty if all are."""
    joined = F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.when(joined != "", F.concat(F.lit("["), joined, F.lit("] "))).otherwise("")


def clean_cell(c: Column) -> Column:
    """A table cell's value: placeholders empty, plain digits, no brackets, one range word."""
    c = strip(c)
    c = F.when(c.isin("——", "—", "---", "--", "…", "...", "/", "无"), "").otherwise(c)
    c = F.translate(c, "０１２３４５６７８９", "0123456789")
    c = F.regexp_replace(c, r"[\[（(]([^\]）)]+)[\]）)]", "$1")
    return F.regexp_replace(c, "[～~]", "至")


def ordered_match(c: Column, pairs: tuple[tuple[str, str], ...], default: str = "") -> Column:
    """Value of the first key that the text contains, in the order given."""
    out = None
    for key, value in pairs:
        out = F.when(c.contains(key), F.lit(value)) if out is None else out.when(c.contains(key), F.lit(value))
    return F.coalesce(out, F.lit(default)) if out is not None else F.lit(default)


# What a file name tells, in the order tried; a null value leaves the field empty.
PROVINCES = (("内蒙古", "内蒙古"), ("黑龙江", "黑龙江"), ("河南", "河南"), ("江西", "江西"), ("陕西", "陕西"), ("新疆", "新疆"), ("辽宁", "辽宁"), ("气科院", "全国"))
CROPS = (
    ("大豆", "大豆"), ("小麦", "冬小麦"), ("冬小麦", "冬小麦"), ("柑橘", "柑橘"), ("苹果", "苹果"), ("猕猴桃", "猕猴桃"), ("桃", "桃"), ("梨", "梨"),
    ("品质", ""), ("病害", ""), ("区划", ""),
)
ZONINGS = (
    ("产量", "产量区划"), ("品质", "品质区划"), ("种植", "种植区划"), ("干旱", "干旱风险区划"), ("冷害", "冷害风险区划"), ("渍涝", "渍涝风险区划"), ("霜冻", "霜冻风险区划"),
    ("病虫害", "病虫害风险区划"), ("食心虫", "病虫害风险区划"), ("气候区划", "气候区划"), ("气候风险", "气候风险区划"), ("算法", "算法说明"), ("技术规范", "技术规范"),
    ("普查", "资源普查"), ("指标", "区划指标"),
)
ZONING = "农业气候区划"


def file_meta(name: Column) -> Column:
    """Struct (province, crop, zoning_type) that a file name tells."""
    return F.struct(ordered_match(name, PROVINCES).alias("province"), ordered_match(name, CROPS).alias("crop"), ordered_match(name, ZONINGS, ZONING).alias("zoning_type"))
