"""Tables in text turned into sentences."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Words that tell a table's kind, empty cells, cells that are values, numbering or rules, and captions.
ZONE_WORDS = ("适宜", "次适宜", "最适宜", "不适宜", "等级", "区划等级", "分级", "风险等级")
WEIGHT_WORDS = ("权重", "系数")
GRADE_WORDS = ("区", "等级", "风险")
EMPTY = {"", "——", "—", "---", "--", "…", "...", "/", "无"}
VALUE = re.compile(r"^[\d.≤≥<>＜＞−-]")
NUMBERING = re.compile(r"^[（(]?\d+[）)]?$")
RULE = re.compile(r"^[-: |]+$")
CAPTION = re.compile(r"^表\s*[0-9一二三四五六七八九十]+([-.．][0-9]+)*")
DIGITS = str.maketrans("０１２３４５６７８９", "0123456789")
COMPARISONS, RANGES, JOINS, BOUNDS = "≤≥<>＜＞~～", "≤≥<>＜＞−-+", "或和及", "～~＜＞≤≥<>或且至-"
ZONE_CAPTION = "该表格为区划指标体系，列出{names}等{n}项因子的{zones}分级阈值"
GRADE_CAPTION = "该表格为区划指标体系，列出{names}等{n}项因子的分级标准"
WEIGHT_CAPTION = "该表格为权重分配，列出{names}等{n}个维度的权重系数"
PLAIN_CAPTION = "该表格列出{names}等{n}项指标的具体数值"
NATIONAL = "全国"


def clean(cell: str) -> str:
    """A cell's value: placeholders empty, plain digits, no brackets, one range word."""
    cell = cell.strip()
    if cell in EMPTY:
        return ""
    cell = re.sub(r"[\[（(]([^\]）)]+)[\]）)]", r"\1", cell.translate(DIGITS))
    return re.sub("[～~]", "至", cell)


@dataclass(frozen=True)
class Place:
    """Where a table stands."""

    province: str = ""
    crop: str = ""
    zoning_type: str = ""
    section_title: str = ""

    @property
    def context(self) -> str:
        """Place, crop and zoning in one word, and the section's title unless it is a number or already said."""
        said = ("" if self.province == NATIONAL else self.province) + self.crop + self.zoning_type
        title = self.section_title
        if not title or title in said or re.match(r"^表格\d+$", title):
            return said
        return f"{said}，{title}" if said else title


def within(context: str) -> str:
    return f"{context}中，" if context else ""


def share(flags: list[bool]) -> float:
    return sum(flags) / len(flags)


# Pipe tables --------------------------------------------------------------------------------------------------------
def grid(text: str) -> tuple[list[str], list[list[str]]] | None:
    """Header and rows of a pipe table with a rule, all of one width: the last row before the rule, or the first one after it where that only names columns."""
    rows = [[c.strip() for c in line[1:].rstrip("|").split("|")] for line in text.strip().split("\n") if line.startswith("|")]
    width = max(map(len, rows), default=0)
    if len(rows) < 2 or width < 2:
        return None
    rows = [r + [""] * (width - len(r)) for r in rows]
    rules = [i for i, r in enumerate(rows) if RULE.match("".join(r))]
    if not rules or not rules[0]:
        return None
    header, data = rows[rules[0] - 1], [r for i, r in enumerate(rows) if i > rules[0] and i not in rules and any(r)]
    if not data:
        return None
    if header[0] and header[0] == data[0][0] and max(map(len, data[0])) < 20:
        return data[0], data[1:]
    return header, data


def names_in(cells: list[str], most: int = 4) -> list[str]:
    """The first distinct names: no values, no numbering, no long texts."""
    cleaned = (clean(c) for c in cells)
    return list(dict.fromkeys(c for c in cleaned if c and len(c) <= 30 and not VALUE.match(c) and not NUMBERING.match(c)))[:most]


def caption(header: list[str], data: list[list[str]]) -> str:
    """What a table is about, in one clause; empty where neither rows nor columns have a name."""
    names = names_in([r[0] for r in data]) or names_in(header)
    if not names:
        return ""
    fill = {"names": "、".join(names), "n": len(names)}
    everything = "".join(header) + "".join("".join(r) for r in data)
    if any(w in everything for w in ZONE_WORDS):
        zones = [z for z in map(clean, header[1:]) if z and len(z) < 10 and not NUMBERING.match(z)][:4]
        return ZONE_CAPTION.format(zones="、".join(zones), **fill) if zones else GRADE_CAPTION.format(**fill)
    weights = any(w in everything for w in WEIGHT_WORDS) or any(r[0] and VALUE.match(clean(r[0])) for r in data)
    return (WEIGHT_CAPTION if weights else PLAIN_CAPTION).format(**fill)


def skipped(header: list[str], data: list[list[str]]) -> bool:
    """Too wide, without heading, numbering in 40 % as many cells as rows, long cells in half as many, or a blank form."""
    cells = [c for r in data for c in r if c]
    numbered, long = sum(bool(NUMBERING.match(c)) for c in cells), sum(len(c) > 60 for c in cells)
    blank = all(sum(map(bool, r)) < 2 for r in data)
    return len(header) > 10 or not any(header) or numbered >= max(1, 0.4 * len(data)) or long >= 0.5 * len(data) or blank


def two_columns(header: list[str], data: list[list[str]]) -> str:
    """label, label's heading is value; behind the first heading where rows are zones or grades."""
    of = f"的{header[1]}为" if header[1] else "为"
    pairs = [(clean(a), clean(b)) for a, b in data]
    said = "；".join(a + (of + b if b else "") for a, b in pairs if a)
    alone = len(pairs) == 1 and all(pairs[0])
    graded = any(w in a for a, _ in pairs for w in GRADE_WORDS)
    return f"{header[0]}：{said}" if said and graded and header[0] and not alone else said


def several_columns(header: list[str], data: list[list[str]]) -> str:
    """A sentence for each row, label first; a single row without label goes by its headings."""
    labelled = share([bool(r[0]) for r in data]) > 0.5
    if len(data) == 1 and (not labelled or VALUE.match(clean(data[0][0]))):
        return "，".join(f"{h} {v}" if h else v for h, v in zip(header, map(clean, data[0])) if v)
    out = []
    for r in data:
        label, *values = map(clean, r)
        said = "，".join(f"{h} {v}" if h else v for h, v in zip(map(clean, header[1:]), values) if v)
        if said and (label or not labelled):
            out.append(f"{label}：{said}" if label else said)
    return ("。" if len(out) <= 6 else "；").join(out)


def pipe_table(header: list[str], data: list[list[str]], place: Place) -> str | None:
    if skipped(header, data):
        return None
    said = (two_columns if len(header) == 2 else several_columns)(header, data)
    about = caption(header, data)
    return within(place.context) + (f"{about}。" if about else "") + said if said else None


# Tables whose cells stand one to a line -----------------------------------------------------------------------------
def is_value_line(line: str) -> bool:
    """A value rather than a label: begins with a digit (with a comparison, or under 30 % Han), a comparison or sign, a joining word before a number, or Latin letters before a comparison."""
    line = line.strip()
    if not line:
        return False
    if line[0].isdigit():
        return any(c in COMPARISONS for c in line) or sum("一" <= c <= "鿿" for c in line) < 0.3 * len(line)
    digit = any(c.isdecimal() for c in line)
    return line[0] in RANGES or digit and (line[0] in JOINS and len(line) >= 2 or bool(re.match(r"[A-Za-z].*[＜＞≤≥<>]", line)))


def is_range(value: str) -> bool:
    """A range or condition: a bound and a digit."""
    return any(c in BOUNDS for c in value) and any(c.isdecimal() for c in value)


def is_score(line: str) -> bool:
    """A mark of one to three digits."""
    line = line.strip()
    return len(line) <= 3 and line.isdigit()


def has_digit(line: str) -> bool:
    return any(c.isdecimal() for c in line)


def records_of(lines: list[str]) -> list[tuple[str, list[str]]]:
    """Labels with the values that follow them."""
    out: list[tuple[str, list[str]]] = []
    for line in lines:
        if not is_value_line(line):
            out.append((clean(line), []))
        elif out:
            out[-1][1].append(clean(line))
    return [(label, values) for label, values in out if label and values]


def captioned_table(rows: list[str], at: int, place: Place) -> str | None:
    """A table below its caption: mostly short lines, digits in 40 %, at least two labels with values."""
    body = rows[at + 1 :]
    if len(body) < 4 or share([len(x) < 30 for x in body]) < 0.7 or share([has_digit(x) for x in body]) < 0.4:
        return None
    first = next((i for i, x in enumerate(body) if is_value_line(x)), 0)
    if not first:
        return None
    # The line before the first value is that value's label; single characters are broken cells.
    header, cells = ([x for x in part if len(x) >= 2] for part in (body[: first - 1], body[first - 1 :]))
    label = clean(cells[0]) if cells else ""
    if not 1 <= len(header) <= 8 or label.isdigit() and len(label) <= 2 or sum(len(x) > 40 for x in cells) >= max(1, 0.2 * len(cells)):
        return None
    records = records_of(cells)
    if len(records) < 2 or sum(bool(NUMBERING.match(a)) for a, _ in records) >= 0.4 * len(records):
        return None
    context = "，".join(x for x in (place.context, rows[at]) if x)
    heads = "、".join(h for h in header if not NUMBERING.match(h))
    about = caption(["", *header], [[a, *v] for a, v in records])
    said = ("。" if len(records) <= 6 else "；").join(f"{a} {v[0]}" if len(v) == 1 else f"{a}：{'，'.join(v)}" for a, v in records)
    return within(context) + (f"{heads}：" if heads and len(heads) < 80 else "") + (f"{about}。" if about else "") + said


def bare_table(rows: list[str], place: Place) -> str | None:
    """Cells without a caption: pairs of range and mark where nearly all are values, labels with values where most are."""
    if len(rows) < 8 or share([len(x) < 30 for x in rows]) < 0.8 or share([has_digit(x) for x in rows]) < 0.3 or share([len(x) > 50 for x in rows]) >= 0.15:
        return None
    values = [is_value_line(x) for x in rows]
    if share(values) > 0.95:
        said = range_marks([x for x, v in zip(rows, values) if v])
    else:
        said = indicators(rows, values) if share(values) > 0.5 else ""
    return within(place.context) + said if said else None


def range_marks(lines: list[str]) -> str:
    """Ranges with their marks, two lines each, in groups of up to 80 characters; empty below four pairs."""
    cells = [clean(x) for x in lines]
    pairs, i = [], 0
    while i + 1 < len(cells):
        a, b = cells[i : i + 2]
        if not (a and b):
            i += 1
            continue
        x, y = is_range(a), is_range(b)
        pairs.append(f"{a} {b}" if x == y else f"{a}→{b}分" if x else f"{b}→{a}分")
        i += 2
    if len(pairs) < 4:
        return ""
    groups: list[str] = []
    for p in pairs:
        if groups and len(groups[-1]) + len(p) + 1 <= 80:
            groups[-1] += "；" + p
        else:
            groups.append(p)
    # A first pair that is too long leaves an empty group before it.
    return "。".join(["", *groups] if len(pairs[0]) > 80 else groups)


def indicators(lines: list[str], values: list[bool]) -> str:
    """Labels of at least four characters, each with the values up to the next one, three to a group beyond four, and short notes in brackets."""
    out: list[tuple[str, list[str], list[str]]] = []
    for line, value in zip(lines, values):
        cell = clean(line)
        if not value and len(cell) >= 4:
            out.append((cell, [], []))
        elif cell and out:
            out[-1][1 if value else 2].append(cell)
    said = []
    for label, found, notes in out:
        if found:
            groups = [found] if len(found) <= 4 else [found[k : k + 3] for k in range(0, len(found), 3)]
            said.append(f"{label}：" + "；".join("，".join(g) for g in groups) + (f"（{'、'.join(notes)}）" if notes else ""))
    return "。".join(said)


def linearised(text: str | None, place: Place = Place()) -> str | None:
    """The table as sentences, None to leave the text as it is: a pipe table first, else cells one to a line."""
    if not text:
        return None
    found = grid(text)
    if found is not None:
        return pipe_table(*found, place)
    rows = [x.strip() for x in text.split("\n") if x.strip()]
    if len(rows) < 6:
        return None
    at = next((i for i, x in enumerate(rows[:20]) if CAPTION.match(x)), None)
    return bare_table(rows, place) if at is None else captioned_table(rows, at, place)


FIELDS = ("province", "crop", "zoning_type", "section_title")


def linearise(df: DataFrame, text: str, to: str = "linear") -> DataFrame:
    """Adds the text with its table as sentences, the text itself where it holds none. Null stays null. Columns province,
    crop, zoning_type and section_title say where the table stands, where the frame has them."""
    has = [c for c in FIELDS if c in df.columns]

    @F.pandas_udf("string")
    def run(s: pd.Series, place: pd.DataFrame) -> pd.Series:
        found = [place[c].fillna("").tolist() for c in has]
        return pd.Series([linearised(t, Place(**dict(zip(has, p)))) for t, *p in zip(s.tolist(), *found)], dtype=object)

    return df.withColumn(to, F.coalesce(run(F.col(text), F.struct(*has, F.lit(0).alias("_none"))), F.col(text)))


def windows(text: str, size: int = 800) -> list[str]:
    """A long linearised table in pieces of sentences up to a size, each opened by the table's first sentence."""
    head, stop, rest = text.partition("。")
    if len(text) <= size or not stop:
        return [text]
    head += stop
    out, now = [], head
    for s in (x.strip() + "。" for x in rest.split("。") if x.strip()):
        if len(now) + len(s) > size and now != head:
            out.append(now)
            now = head
        now += s
    if now != head:
        out.append(now)
    return out if len(out) > 1 else [text]


def table_chunks(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """All columns with the text of tables (kind `table`) as sentences, cut into row windows: part, parts, and key_part from the second piece on."""
    done = linearise(df, text, "_linear")

    @F.pandas_udf("array<string>")
    def cut(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else windows(t))

    changed = (F.col(kind) == "table") & ~F.col("_linear").eqNullSafe(F.col(text))
    pieces = F.when(changed, cut(F.col("_linear"))).otherwise(F.array(text))
    d = done.select(*[c for c in df.columns if c != text], pieces.alias("_p")).select("*", F.size("_p").alias("parts"), F.posexplode("_p").alias("part", text)).drop("_p")
    return d.withColumn(key, F.when(F.col("part") > 0, F.concat(F.col(key).cast("string"), F.lit("_t"), "part")).otherwise(F.col(key).cast("string")))
