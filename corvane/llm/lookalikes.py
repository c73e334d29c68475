"""One consistent form for texts that look alike but are stored with different characters."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialise

# Letters of other alphabets that look like Latin ones, each line with the Latin letters in the same order.
LOOKS = (
    ("аеорсухіѕјһԁԛԝӏ", "aeopcyxisjhdqwl"),
    ("АВЕКМНОРСТУХЅІЈҺԌԚԜӀ", "ABEKMHOPCTYXSIJhGQWI"),
    ("ονιυα", "oviua"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹϳ", "ABEZHIKMNOPTYXCj"),
    ("օսոհզցԱՕ", "ounhqgUO"),
    ("ɑɡ", "ag"),
)
TO_LATIN = {a: b for xs, ys in LOOKS for a, b in zip(xs, ys)}
#: Compatibility kinds whose characters look the same as what they stand for; raised, circled and such ones do not.
SAME = {"<wide>", "<narrow>", "<noBreak>", "<compat>"}
#: Unified look-alike punctuation (fixed values): dashes and quotes keep their differences, spaces become one.
INVISIBLE = {0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180E, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
PLAIN = re.compile("[\x20-\x7e\n一-鿿。《》「」『』【】—–…·℃°≥≤、‘’“”]*")
#: A token: letters of alphabets with their accents; Han, kana and hangul stand between tokens.
BLANKS, BREAKS = re.compile(" {2,}"), re.compile(" ?\n[ \n]*")
LETTERS = re.compile("(?:(?![\u2e80-\u9fff\uac00-\ud7af\uf900-\ufaff])[^\\W\\d_]|[\u0300-\u036f])+")


class _Width(dict):
    """Code point -> its full-size, visible form."""

    def __missing__(self, point: int):
        ch = chr(point)
        kind = unicodedata.category(ch)
        out: str | None = ch
        if point in INVISIBLE or kind in ("Cf", "Cc") and ch not in "\t\n\r\x0b\x0c\x85":
            out = None
        elif kind in ("Zl", "Zp") or ch in "\r\x0b\x0c\x85":
            out = "\n"
        elif kind == "Zs" or ch == "\t":
            out = " "
        else:
            parts = unicodedata.decomposition(ch).split()
            if parts and parts[0] in SAME:
                whole = "".join(chr(int(x, 16)) for x in parts[1:])
                single = len(parts) == 2 or 0xFF00 <= point <= 0xFFEF
                if single and not whole.isspace() and not 0xFE30 <= point <= 0xFE4F and point not in (0x2024, 0x2025, 0x2026) or 0x2E80 <= point <= 0x2FDF or 0xF900 <= point <= 0xFAFF:
                    out = "".join(self[ord(c)] or "" for c in whole)
        self[point] = out
        return out


WIDTH = _Width()


@lru_cache(maxsize=100_000)
def script(ch: str) -> str:
    return unicodedata.name(ch, "?").split()[0]


#: Script -> Latin letter -> its look-alike there; of several the first.
FROM_LATIN: dict[str, dict[str, str]] = {}
for _a, _b in TO_LATIN.items():
    if script(_a) != "LATIN":
        FROM_LATIN.setdefault(script(_a), {}).setdefault(_b, _a)
LATIN_ALIKE = frozenset(b for found in FROM_LATIN.values() for b in found)


def tidy(text: str) -> str:
    """One width, composed accents, no invisible characters, single plain spaces and line breaks, none at the ends."""
    if not PLAIN.fullmatch(text):
        text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).translate(WIDTH))
        text = unicodedata.normalize("NFC", text)
    return BREAKS.sub("\n", BLANKS.sub(" ", text)).strip()


def scripts(token: str) -> dict[str, int]:
    """Letters of each script in a token, accents aside."""
    counts: dict[str, int] = {}
    for c in unicodedata.normalize("NFD", token):
        if not unicodedata.combining(c):
            counts[script(c)] = counts.get(script(c), 0) + 1
    return counts


def towards(token: str, target: str) -> str | None:
    """The token with every letter of another script replaced by its look-alike in the target; None where one has none."""
    to, out = FROM_LATIN.get(target, {}), []
    for c in unicodedata.normalize("NFD", token):
        new = TO_LATIN.get(c, c)
        if unicodedata.combining(c) or script(c) == target != "LATIN":
            new = c
        elif target != "LATIN":
            new = to.get(new)
        elif script(new) != "LATIN":
            new = None
        if new is None:
            return None
        out.append(new)
    return unicodedata.normalize("NFC", "".join(out))


def repairs(token: str, alone: bool = False) -> list[str]:
    """What a token may stand for, its dominant script first.

    The dominant script of a token of mixed script is the one most of its letters have; firm letters, which have no
    look-alike in another script, rule that one out, and of equal shares Latin goes first. The forms in the other
    scripts of the token, and in Latin, follow: the vocabulary decides which of them is a word. A token of one script is mended, towards
    Latin, only where alone is true.
    """
    counts = scripts(token)
    if len(counts) == 1:
        new = towards(token, "LATIN") if alone and "LATIN" not in counts else None
        return [new] if new else []
    order = sorted({**counts, "LATIN": counts.get("LATIN", 0)}, key=lambda x: (-counts.get(x, 0), x != "LATIN", x))
    return [new for target in order if (target == "LATIN" or target in FROM_LATIN) and (new := towards(token, target))]


def one_script(token: str) -> bool:
    """Whether a token is a whole word of another alphabet than Latin."""
    first = script(token[0])
    return first in FROM_LATIN and all(script(c) == first or unicodedata.combining(c) for c in token)


def foreign_tokens(tokens: set[str]) -> list[str]:
    """Those of a tidied text's tokens with letters that have a look-alike in another script of theirs."""
    return [t for t in tokens if not t.isascii() and (any(c in TO_LATIN for c in t) or any(c in LATIN_ALIKE for c in unicodedata.normalize("NFD", t)) and any(script(c) in FROM_LATIN for c in t))]


def visible(text: str) -> int:
    return len(text) - text.count(" ") - text.count("\n")


def forms(df: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, original, form): every non-blank value in its consistent form.

    Widths, accents, invisible characters and spaces are settled value by value. Letters of another script inside a
    token are replaced by look-alikes of its dominant script, Latin or not, only where the result is a token of the
    corpus vocabulary, which all values make up; where that isn't one, its other scripts are tried by their share. A token of
    one script all of whose letters have Latin look-alikes is treated the same way, towards Latin only, in values that
    have no firm letters of that script. Null and blank values give no row; repeated rows each give one.
    """
    kind = dict(df.dtypes)[key]
    schema = f"k {kind}, field string, original string, tidied string, tokens array<struct<old: string, at: int, new: string>>, word string"

    def run(batches):
        for b in batches:
            keys, rows, words = b[key].tolist(), [], set()
            for f in fields:
                for k, t in zip(keys, b[f].tolist()):
                    if not t:
                        continue
                    tidied = tidy(t)
                    if not tidied:
                        continue
                    tokens: list = []
                    every = set() if PLAIN.fullmatch(tidied) else set(LETTERS.findall(tidied))
                    # Scripts that the value surely has; a word of look-alikes alone counts for the vocabulary only there.
                    firm = {script(c) for x in every if not x.isascii() for c in x if c not in TO_LATIN} & FROM_LATIN.keys()
                    words.update(x for x in every if not x.isascii() and one_script(x) and script(x[0]) in firm)
                    if found := foreign_tokens(every):
                        for x in found:
                            for at, new in enumerate(repairs(x, alone=script(x[0]) not in firm)):
                                if new != x:
                                    tokens.append({"old": x, "at": at, "new": new})
                    rows.append((k, f, t, tidied if tidied != t else None, tokens or None, None))
                    words.update(w for w in WORDS.findall(tidied))
            yield pd.DataFrame(rows + [(None, None, None, None, None, w) for w in words], columns=["k", "field", "original", "tidied", "tokens", "word"]).astype({"k": "Int64"} if kind in ("bigint", "int") else {})

    staged = materialise(df.filter(F.col(key).isNotNull()).select(key, *fields).mapInPandas(run, schema), "forms")
    values = staged.filter("field is not null").withColumn("tidied", F.coalesce("tidied", "original"))
    wanted = values.filter("tokens is not null").select("k", "field", "original", "tidied", F.explode("tokens").alias("t"))
    known = staged.filter("word is not null").select(F.col("word").alias("new")).distinct()
    accepted = wanted.select("k", "field", "original", F.col("t.old").alias("old"), F.col("t.at").alias("at"), F.col("t.new").alias("new")).join(known, "new", "left_semi")
    swaps = accepted.groupBy("k", "field", "original").agg(F.array_sort(F.collect_set(F.struct("old", "at", "new"))).alias("s"))
    first = F.filter("s", lambda x, i: (i == 0) | (F.get("s", i - 1)["old"] != x["old"]))
    swaps = swaps.select("k", "field", "original", F.map_from_entries(F.transform(first, lambda x: F.struct(x["old"], x["new"]))).alias("swap"))
    mended = values.filter("tokens is not null").join(swaps, ["k", "field", "original"], "left").withColumn("form", _swap("tidied", "swap"))
    plain = values.filter("tokens is null").withColumn("form", F.col("tidied"))
    cols = [F.col("k").alias(key), "field", "original", "form"]
    return plain.select(cols).unionByName(mended.select(cols))


#: Latin words of the vocabulary: runs of Latin letters, accented ones included. Those of other alphabets are whole tokens.
WORDS = re.compile("[A-Za-zÀ-ɏḀ-ỿ]+")


def _swap(text: str, swap: str):
    @F.pandas_udf("string")
    def run(t: pd.Series, s: pd.Series) -> pd.Series:
        def one(x, m):
            m = dict(m) if m is not None and len(m) else None
            return LETTERS.sub(lambda g: m.get(g.group(), g.group()), x) if m else x

        return pd.Series([one(x, m) for x, m in zip(t, s)])

    return run(F.col(text), F.col(swap))


def hashed(formed: DataFrame, key: str, least: dict[str, int] | None = None) -> DataFrame:
    """(k, field, h, f, o) of every value, written once: two hashes of its form and one of its stored string. Values of a
    field with fewer visible characters than `least` says are left out."""
    enough = None
    for name, n in (least or {}).items():
        enough = F.when(F.col("field") == name, n) if enough is None else enough.when(F.col("field") == name, n)
    rows = formed.filter(F.length(F.translate("form", " \n", "")) >= F.coalesce(enough, F.lit(0))) if enough is not None else formed
    return materialise(rows.select(F.col(key).alias("k"), "field", F.xxhash64("field", "form").alias("h"), F.xxhash64(F.lit("form"), "form").alias("f"), F.xxhash64("original").alias("o")), "hashed")


def families(rows: DataFrame) -> DataFrame:
    """(k, field, h, f, o) of hashed values, without repeats, whose form has several stored strings; written, as it is a small part."""
    group = ["h", "f", "field"]
    several = rows.groupBy(*group).agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo <> hi").select(*group)
    return materialise(rows.join(several, group, "left_semi").distinct(), "families")


def alike(kept: DataFrame) -> DataFrame:
    """(a, b, field): pairs of rows of families(), a < b, with the same form but different stored strings.

    Strings of a form are paired first and rows joined to these pairs, so the work is that of the rows returned: equal
    strings, however many, are never compared.
    """
    group = ["h", "f", "field"]
    strings = materialise(kept.select(*group, "o").distinct(), "strings")
    pairs = strings.withColumnRenamed("o", "o1").join(strings.withColumnRenamed("o", "o2"), group).filter("o1 < o2")
    one, two = kept.select(*group, F.col("o").alias("o1"), F.col("k").alias("k1")), kept.select(*group, F.col("o").alias("o2"), F.col("k").alias("k2"))
    both = pairs.join(one, [*group, "o1"]).join(two, [*group, "o2"]).filter("k1 <> k2")
    return both.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b"), "field").distinct()


def smallest_of(df: DataFrame, group: str, key: str, value: str) -> DataFrame:
    """(key, value) of the row with the smallest key in each group; combined map-side."""
    return df.filter(F.col(group).isNotNull() & F.col(key).isNotNull()).groupBy(group).agg(F.min(F.struct(F.col(key), F.col(value))).alias("m")).select(f"m.{key}", f"m.{value}")
