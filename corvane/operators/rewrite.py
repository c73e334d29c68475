"""Question rewriting: term dictionaries, gates, checks and the reading of generated text."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import below_counts, bounded

# Cues of a question that asks for several things, endings of titles, words that make a sentence a question.
CUES = "哪些|各种|各|分别|每种|异同|对比|总体规律|规律|区别|差异"
TITLE_ENDS = "对比分析|对比|分析|清单|划分方法|方法|特征|差异|分布|依据|情况|现状|适宜性|等级|指标体系|指标"
ASKING = "[吗呢哪什么如何怎样是否多少几]"
#: Cues of English questions, for callers that want them too.
ENGLISH_CUES = CUES + r"|\b(?:compare|which|versus)\b"
NUMBER = r"\d+(?:\.\d+)?"


def is_structured(q: Column, cues: str = CUES) -> Column:
    return q.rlike(cues) | (F.regexp_count(q, F.lit("[？?]")) >= 2)


def gate(q: Column, has_term: Column, top1: Column, margin: Column, mode: str = "base") -> Column:
    """Whether to rewrite. struct: structure or a term yes, up to six characters no, else yes. base: short no, a term yes, else a weak or narrow lead."""
    short = F.length(q) <= 6
    if mode == "struct":
        return F.when(is_structured(q) | has_term, True).when(short, False).otherwise(True)
    return F.when(short, False).when(has_term, True).otherwise((margin < 0.03) | (top1 < 0.72))


def spans(text: str, keys: list[str]) -> list[tuple[int, int, str]]:
    """Occurrences of the keys, longest keys first, none over another, in the order of the text."""
    taken = [False] * len(text)
    out = []
    for k in sorted({k for k in keys if len(k) > 1}, key=lambda k: (-len(k), k)):
        at = text.find(k)
        while at >= 0:
            if not any(taken[at : at + len(k)]):
                taken[at : at + len(k)] = [True] * len(k)
                out.append((at, at + len(k), k))
            at = text.find(k, at + 1)
    return sorted(out)


def scan_terms(df: DataFrame, key: str, text: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """(key, standards): distinct standard terms of the spoken ones found, in the order of the text. The dictionary is a small parameter."""
    to = dict(pairs)

    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: list(dict.fromkeys(to[k] for _, _, k in spans(t, list(to)))) if t else [])

    return df.select(key, run(F.col(text)).alias("standards"))


def replaced(text: str, pairs: list[tuple[str, str]], protected: tuple[str, ...] = ()) -> str:
    """Spoken terms replaced by standard ones: never inside a protected term or a standard one already there; text of the
    standard that already stands beside the term is taken in; neighbours with one standard become one."""
    to = {a: b for a, b in pairs if a != b and len(a) > 1}
    guard = [(a, b) for a, b, _ in spans(text, [*protected, *to.values()])]
    found = [(a, b, to[k]) for a, b, k in spans(text, list(to)) if not any(x < b and a < y for x, y in guard)]
    merged: list[tuple[int, int, str]] = []
    for a, b, new in found:
        for n in range(len(new) - 1, 0, -1):
            if a >= n and text[a - n : a] == new[:n] and (not merged or merged[-1][1] <= a - n):
                a -= n
                break
        for n in range(len(new) - 1, 0, -1):
            if text[b : b + n] == new[-n:]:
                b += n
                break
        if merged and merged[-1][1] >= a and merged[-1][2] == new:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), new)
        elif not merged or merged[-1][1] <= a:
            merged.append((a, b, new))
    for a, b, new in reversed(merged):
        text = text[:a] + new + text[b:]
    return text


def replace_terms(df: DataFrame, text: str, pairs: list[tuple[str, str]], protected: tuple[str, ...] = ()) -> DataFrame:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else replaced(t, pairs, protected))

    return df.withColumn("replaced", run(F.col(text)))


def expand_synonyms(df: DataFrame, key: str, text: str, synonyms: DataFrame, most: int = 3) -> DataFrame:
    """(key, term, synonym): up to three synonyms of each term that the text has, without those it has already. The synonym table is a dictionary of checked size."""
    hit = df.join(bounded(synonyms), F.col(text).contains(F.col("term")) & ~F.col(text).contains(F.col("synonym")))
    w = Window.partitionBy(key, "term").orderBy("pos")
    return hit.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= most).select(key, "term", "synonym")


def counted(c: Column, term: str) -> Column:
    """Occurrences of a term, one after the other."""
    return (F.length(c) - F.length(F.replace(c, F.lit(term), F.lit("")))) / len(term)


def repair_checks(old: Column, new: Column, lo: float = 0.5, hi: float = 1.5, terms: tuple[str, ...] = (), mapped: Column | None = None) -> dict[str, Column]:
    """Whether a repaired question keeps its length, numbers, signs, question marks, and the standard terms it was given."""
    ratio = F.length(new) / F.nullif(F.length(old), F.lit(0))
    ref = old if mapped is None else mapped

    def same(rx: str) -> Column:
        return F.array_sort(F.regexp_extract_all(old, F.lit(rx), F.lit(0))) == F.array_sort(F.regexp_extract_all(new, F.lit(rx), F.lit(0)))

    kept = F.lit(True)
    for t in terms:
        kept = kept & (counted(new, t) >= counted(ref, t))
    return {"length": ratio.between(lo, hi), "numbers": same(NUMBER), "signs": same("[≥≤℃％%]"), "marks": F.regexp_count(old, F.lit("[？?]")) == F.regexp_count(new, F.lit("[？?]")), "terms": kept}


def is_title(c: Column) -> Column:
    """Ends as titles do and asks nothing."""
    t = F.regexp_replace(c, "[？?。.！! ]+$", "")
    return t.rlike(f"(?:{TITLE_ENDS})$") & ~c.rlike(ASKING)


def ranking_checks(old: Column, new: Column, elements: dict[str, Column], terms: tuple[str, ...] = (), mapped: Column | None = None) -> dict[str, Column]:
    """The checks of a question rewritten for re-ranking: .6 to 1.4 of the length or up to eight characters more, no title, all elements named."""
    base = repair_checks(old, new, 0.6, 1.4, terms, mapped)
    named = F.lit(True)
    for e in elements.values():
        named = named & ~F.coalesce(e, F.lit("")).isin("", "无", "—", "-")
    return {"numbers": base["numbers"], "signs": base["signs"], "length": (F.length(new) / F.greatest(F.length(old), F.lit(1))).between(0.6, 1.4) | (F.length(new) <= F.length(old) + 8), "terms": base["terms"], "sentence": ~is_title(new), "elements": named}


def issues(checks: dict[str, Column]) -> Column:
    """Names of the checks that fail."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items()]))


def json_object(df: DataFrame, raw: str, schema: str) -> DataFrame:
    """Adds parsed: the object between the first { and the last } of generated text, null where there is none."""
    return df.withColumn("parsed", F.from_json(F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")), schema))


def normalised_rewrites(df: DataFrame, raw: str) -> DataFrame:
    """Adds rewrite (type, keywords, rewrite_queries, sub_queries, confidence) of generated text: lists may be single
    strings, blanks go, an unknown type is `normalize`, a missing confidence 0.5; without an object the type is `none`."""
    d = df.withColumn("_body", F.nullif(F.regexp_extract(raw, r"(?s)\{.*\}", 0), F.lit("")))

    def listed(name: str) -> Column:
        got = F.trim(F.get_json_object("_body", f"$.{name}"))
        none = F.array().cast("array<string>")
        many = F.filter(F.transform(F.coalesce(F.from_json(got, "array<string>"), none), lambda x: F.trim(x)), lambda x: x != "")
        return F.when(got.startswith("["), many).when(got != "", F.array(got)).otherwise(none)

    valid = F.expr("try_parse_json(_body) IS NOT NULL")
    kind = F.get_json_object("_body", "$.rewrite_type")
    return d.withColumn("rewrite", F.struct(
        F.when(~valid, "none").when(kind.isin("none", "normalize", "expand"), kind).otherwise("normalize").alias("type"), listed("keywords").alias("keywords"), listed("rewrite_queries").alias("rewrite_queries"),
        listed("sub_queries").alias("sub_queries"), F.when(~valid, 0.0).otherwise(F.coalesce(F.expr("try_cast(get_json_object(_body, '$.confidence') AS double)"), F.lit(0.5))).alias("confidence"))).drop("_body")


def term_map(entries: DataFrame) -> DataFrame:
    """(spoken, standard) of a dictionary (category, spoken, standard) of strings: keys of notes (_) and of one character are left out."""
    return entries.filter(~F.col("category").startswith("_") & ~F.col("spoken").startswith("_") & (F.length("spoken") > 1)).groupBy("spoken").agg(F.min("standard").alias("standard"))


def gate_info(df: DataFrame, query: str, has_term: Column, top1: Column, margin: Column) -> DataFrame:
    """Adds, for each question, what each arm of the gate decides and why: structure, term, short."""
    q = F.col(query)
    return df.withColumns({"structure": is_structured(q), "term": has_term, "short": F.length(q) <= 6, "base": gate(q, has_term, top1, margin), "struct": gate(q, has_term, top1, margin, "struct")})


def meets_contract(prompt: Column, parts: tuple[str, ...] = ("{query}", "keywords")) -> Column:
    """Whether a generated prompt has all it must have."""
    out = F.lit(True)
    for p in parts:
        out = out & prompt.contains(p)
    return out


def without_fences(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```[^\n]*\n", ""), r"\n```\s*$", "")


def with_keywords(q: Column, keywords: Column) -> Column:
    """The question and its keywords, for lexical search."""
    return F.concat_ws(" ", q, F.array_join(keywords, " "))


def with_structure_note(prompt: Column, note: str, mark: str) -> Column:
    """The note put before the last mark of a prompt; at the end where it has none."""
    at = F.length(prompt) - F.locate(mark[::-1], F.reverse(prompt)) - len(mark) + 2
    return F.when(prompt.contains(mark), F.concat(prompt.substr(F.lit(1), at - 1), F.lit(note), prompt.substr(at, F.length(prompt)))).otherwise(F.concat(prompt, F.lit(note)))


def pool(terms: Column, synonyms: Column, generated: Column, most: int = 6) -> Column:
    """Keywords in the order dictionary, synonyms, generated: distinct, at most six."""
    empty = F.array().cast("array<string>")
    return F.slice(F.array_distinct(F.filter(F.concat(*[F.coalesce(c, empty) for c in (terms, synonyms, generated)]), lambda x: F.trim(x) != "")), 1, most)


def cached(queries: DataFrame, cache: DataFrame, arms: list[str], key: str = "query") -> DataFrame:
    """Adds entry: the query's cached rewrite by the first of the arms that has one."""
    place = None
    for i, a in enumerate(arms):
        place = F.when(F.col("arm") == a, i) if place is None else place.when(F.col("arm") == a, i)
    best = cache.filter(F.col("arm").isin(arms)).groupBy(key).agg(F.min_by("entry", place).alias("entry"))
    return queries.join(best, key, "left")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old ones whose keys they don't have."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def pending(items: DataFrame, cache: DataFrame, key: str, retry: bool = False) -> DataFrame:
    """Items still to do: not in the cache or, with retry, there with an error."""
    done = cache.filter("error is null") if retry else cache
    return items.join(done.select(key), key, "left_anti")


def with_retries(df: DataFrame, text: str, generate, check, tries: int = 2, to: str = "repaired") -> DataFrame:
    """Adds what generate(text, issues) returns once check(text, result) has none, else the text itself: validate, retry, fall back."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            found: list[str] = []
            for _ in range(tries):
                new = generate(t, found)
                found = check(t, new)
                if not found:
                    return new
            return t

        return s.map(one)

    return df.withColumn(to, run(F.col(text)))


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """(key, batch): numbers batches of `size` by key order, over range partitions."""
    placed = below_counts(df.withColumn("_all", F.lit(1)), ["_all"], key)
    return placed.select(key, F.floor(F.col("below") / size).alias("batch"))
