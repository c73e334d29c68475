"""SQL of the text predicates, for the queries' SQL: each function gives an expression over an expression."""

from __future__ import annotations

from .functions import text as T

W = T.BLANK


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{W}+|{W}+$', '', 'g')"


def lines(x: str) -> str:
    return f"list_filter(list_transform(string_split({x}, chr(10)), lambda x: {strip('x')}), lambda x: x <> '')"


def let(name: str, value: str, body: str) -> str:
    """body with name standing for value, which is computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def heading(x: str) -> str:
    return f"coalesce(regexp_matches({strip(x)}, '{T.HEADING}'), false)"


def style_level(x: str) -> str:
    number = rf"regexp_extract({x}, '(?i)(?:heading|标题|TOC)\s*(\d+)', 1)"
    return f"coalesce(CASE WHEN {number} <> '' THEN CAST({number} AS INT) WHEN regexp_matches({x}, '(?i)heading|标题') THEN 1 END, 0)"


def table_marks(x: str) -> str:
    flags = f"list_transform(ls, lambda y: regexp_matches(y, '{T.NUMBER_WORD}'))"
    run = "coalesce(list_max(list_transform(string_split(array_to_string(list_transform(fl, lambda y: CASE WHEN y THEN '1' ELSE '0' END), ''), '0'), lambda y: length(y))), 0)"
    ratio = "(num / nullif(len(ls), 0)::DOUBLE)"
    points = (
        f"CASE WHEN len(list_filter(ls[1:5], lambda y: regexp_matches(y, '{T.CAPTION}'))) > 0 THEN 2 ELSE 0 END + CASE WHEN {ratio} >= 0.6::DOUBLE THEN 2 WHEN {ratio} >= 0.5::DOUBLE THEN 1 ELSE 0 END"
        f" + CASE WHEN len(regexp_extract_all({x}, '{T.UNIT}')) >= 2 THEN 1 ELSE 0 END + CASE WHEN run >= 5 THEN 1 ELSE 0 END"
    )
    table = f"coalesce(length({x}) - length(replace({x}, '|', '')) > 3 OR (len(ls) >= 2 AND ({ratio} > 0.6::DOUBLE OR {points} >= 4)), false)"
    body = f"{{'n_lines': len(ls), 'n_numeric': num, 'longest': run, 'is_table': {table}}}"
    return let("ls", lines(x), let("fl", flags, let("num", "len(list_filter(fl, lambda y: y))", let("run", run, body))))


def is_table(x: str) -> str:
    return f"coalesce({table_marks(x)}.is_table, false)"


def is_toc(x: str) -> str:
    rows = f"list_filter(string_split({x}, chr(10)), lambda y: {strip('y')} <> '')"
    hits = f"len(list_filter(rw, lambda y: regexp_matches(regexp_replace(y, '^{W}+', ''), '{T.TOC_LINE}')))"
    return let("rw", rows, let("tc", hits, "tc > 0 AND (len(rw) = 1 OR tc / len(rw)::DOUBLE > 0.4::DOUBLE)"))


def mid(x: str) -> str:
    return f"({x} <> '' AND NOT regexp_matches({x}, '[。！？；：:;]$'))"


def goes_on(x: str) -> str:
    return rf"coalesce({x} = '' OR regexp_matches({x}, '^[\p{{Ll}}\p{{Nd}}\x{{4e00}}-\x{{9fff}}]'), true)"


def transition(x: str) -> str:
    return f"({x} <> '' AND length({x}) < 120 AND regexp_matches({x}, '[:：]$|{'|'.join(T.TRANSITIONS)}'))"


def short_fragment(x: str) -> str:
    return f"({x} <> '' AND length({x}) < 80 AND {mid(x)} AND NOT regexp_matches({x}, '{T.DEFINITION}') AND NOT regexp_matches({x}, '{T.LIST_ITEM}'))"


def fragment(x: str, after: str) -> str:
    return f"(length({x}) > 50 AND length({x}) < 250 AND {mid(x)} AND regexp_matches({x}, '{T.DOMAIN}') AND {goes_on(after)})"


def junk(x: str) -> str:
    return f"regexp_matches({x}, '{'|'.join(T.TEMPLATE_NOTES)}')"


def verdict(x: str, after: str, table: str) -> str:
    """drop, table, merge or keep of a stripped text with a next one."""
    return (
        f"CASE WHEN {junk(x)} OR {is_toc(x)} THEN 'drop' WHEN {table} THEN 'table' WHEN length({x}) < 50 OR {transition(x)} THEN 'merge'"
        f" WHEN regexp_matches({x}, '[。！？]$') AND length({x}) < 200 THEN 'keep' WHEN {fragment(x, after)} OR {short_fragment(x)} THEN 'merge' ELSE 'keep' END"
    )


def packed(x: str, size: int = 800) -> str:
    """Sentences packed into pieces, as a list."""
    parts = rf"list_filter(string_split(regexp_replace({x}, '([。！？\n]){W}*', '\1' || chr(1), 'g'), chr(1)), lambda y: {strip('y')} <> '')"
    fold = (
        f"list_reduce(list_transform(pt, lambda y: {{'done': []::VARCHAR[], 'now': y}}), lambda a, y: CASE WHEN length(a.now) + length(y.now) > {size}"
        f" THEN {{'done': list_append(a.done, {strip('a.now')}), 'now': y.now}} ELSE {{'done': a.done, 'now': a.now || y.now}} END)"
    )
    return let("pt", parts, f"CASE WHEN len(pt) = 0 THEN [{x}] ELSE {let('fd', fold, 'list_append(fd.done, ' + strip('fd.now') + ')')} END")


#: Sections of the latest parse of each document: s(doc_id, tier, sec_ord, heading_path, blocks).
SECTIONS = f"""lp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY parsed_at DESC NULLS LAST, block_id) AS k FROM blocks WHERE doc_id IS NOT NULL) WHERE k = 1),
    mb AS (SELECT doc_id, seq, block_id, text, {strip('text')} AS t, {style_level('style')} AS lv, CASE WHEN font_size IS NOT NULL THEN coalesce(is_title, false) ELSE {heading('text')} END AS opens FROM lp WHERE {strip('text')} <> ''),
    mk AS (SELECT *, sum(CASE WHEN lv = 2 THEN 1 ELSE 0 END) OVER w AS s2, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER w AS so, row_number() OVER w AS rn, last_value(CASE WHEN lv = 1 THEN text END IGNORE NULLS) OVER w AS h1
      FROM mb WINDOW w AS (PARTITION BY doc_id ORDER BY seq, block_id ROWS UNBOUNDED PRECEDING)),
    tr AS (SELECT doc_id, CASE WHEN count(DISTINCT CASE WHEN lv NOT IN (1, 2) THEN s2 END) >= 2 THEN 1 WHEN count(DISTINCT CASE WHEN NOT opens THEN so END) >= 2 THEN 2 ELSE 3 END AS tier FROM mk GROUP BY 1),
    rw AS (SELECT doc_id, tier, seq, block_id, CAST(CASE tier WHEN 1 THEN s2 WHEN 2 THEN so ELSE floor((rn - 1) / 10000) END AS BIGINT) AS sec,
      CASE tier WHEN 1 THEN CASE WHEN lv IN (1, 2) THEN NULL WHEN lv >= 3 THEN repeat('#', least(lv, 4)) || ' ' || text ELSE text END WHEN 2 THEN CASE WHEN NOT opens THEN t END ELSE text END AS line,
      CASE WHEN tier = 1 AND lv = 2 THEN list_filter([h1, text], lambda x: x IS NOT NULL) WHEN tier = 2 AND opens THEN [t] END AS path FROM mk JOIN tr USING (doc_id)),
    gs AS (SELECT doc_id, tier, sec, max(path) AS path, list(line ORDER BY seq, block_id) FILTER (WHERE line IS NOT NULL) AS ls FROM rw GROUP BY 1, 2, 3),
    pc AS (SELECT doc_id, tier, sec, path, CASE WHEN tier = 3 THEN list_transform({packed("array_to_string(ls, chr(10))")}, lambda q: [q]) ELSE [ls] END AS ps FROM gs WHERE len(ls) > 0),
    s AS (SELECT doc_id, tier, CASE WHEN tier = 3 THEN sec * 10000000 + i - 1 ELSE sec END AS sec_ord, coalesce(path, CASE WHEN tier = 3 THEN [''] ELSE []::VARCHAR[] END) AS heading_path, ps[i] AS blocks FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM pc))"""

_TABLE_OR_NOT = let(
    "v", "CASE WHEN a.tabs > 0 THEN 'table' ELSE " + let("ab", strip("a.body"), verdict("ab", "kb", is_table("ab"))) + " END",
    "CASE WHEN v <> 'table' OR k.tab OR a.tabs > 0 THEN v ELSE " + let("ab", strip("a.body"), verdict("ab", "kb", "false")) + " END")

#: f(doc_id, sec_ord, body): the sections that the filter in mode carry leaves, from t(doc_id, sec_ord, body, tab).
FILTERED = f"""t AS (SELECT doc_id, sec_ord, body, {is_table(strip('body'))} AS tab FROM (SELECT doc_id, sec_ord, array_to_string(blocks, chr(10)) AS body FROM s)),
    ev AS (SELECT doc_id, list({{'ord': sec_ord, 'body': body, 'tabs': 0, 'tab': tab, 'outs': []::STRUCT(ord BIGINT, body VARCHAR)[]}} ORDER BY sec_ord) AS l FROM t GROUP BY 1),
    fo AS (SELECT doc_id, list_reduce(l, lambda a, k: {let("kb", strip("k.body"), let("d", _TABLE_OR_NOT, '''CASE
        WHEN d = 'table' AND k.tab THEN {'ord': a.ord, 'body': a.body || chr(10) || k.body, 'tabs': a.tabs + 1, 'tab': true, 'outs': a.outs}
        WHEN d = 'drop' THEN {'ord': k.ord, 'body': k.body, 'tabs': 0, 'tab': k.tab, 'outs': a.outs}
        WHEN d = 'merge' THEN {'ord': k.ord, 'body': a.body || chr(10) || k.body, 'tabs': 0, 'tab': k.tab, 'outs': a.outs}
        ELSE {'ord': k.ord, 'body': k.body, 'tabs': 0, 'tab': k.tab, 'outs': list_append(a.outs, {'ord': a.ord, 'body': a.body})} END'''))}) AS z FROM ev),
    f AS (SELECT doc_id, unnest(outs).ord AS sec_ord, unnest(outs).body AS body FROM (SELECT doc_id, CASE WHEN z.tabs = 0 AND ({junk(strip('z.body'))} OR {is_toc(strip('z.body'))}) THEN z.outs ELSE list_append(z.outs, {{'ord': z.ord, 'body': z.body}}) END AS outs FROM fo))"""
