"""Queries over the test tables, and their SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import sqltext as S
from .functions import text as T
from .operators import chunks, evaluation, linearise, search, structure
from .sqltext import lines, strip
from .tables import materialise, running, table

QUERIES: dict = {}
SQL: dict = {}
W = S.W


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{W}", W)
        return f

    return add


HEADING = T.HEADING
R6 = lambda c: F.round(c, 6)


# Structure ----------------------------------------------------------------------------------------------------------
@query(f"SELECT block_id, coalesce(regexp_matches({strip('text')}, '{HEADING}'), false) AS heading FROM blocks")
def heading_lines(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "blocks").select("block_id", T.is_heading(F.col("text")).alias("heading"))


@query(r"""SELECT style, CASE WHEN regexp_extract(style, '(?i)(?:heading|标题|TOC)\s*(\d+)', 1) <> '' THEN CAST(regexp_extract(style, '(?i)(?:heading|标题|TOC)\s*(\d+)', 1) AS INT)
    WHEN regexp_matches(style, '(?i)heading|标题') THEN 1 ELSE 0 END AS level, count(*) AS n FROM blocks GROUP BY style""")
def style_levels(spark, d):
    return table(spark, d, "blocks").groupBy("style").agg(F.count("*").alias("n")).select("style", T.style_level(F.col("style")).alias("level"), "n")


@query(f"""WITH b AS (SELECT block_id, coalesce({strip('text')}, '') AS t FROM blocks)
    SELECT block_id, t <> '' AND NOT regexp_matches(t, '[。！？；：:;]$') AS mid, regexp_matches(t, '[。！？]$') AS complete,
    t <> '' AND length(t) < 120 AND regexp_matches(t, '[:：]$|{'|'.join(T.TRANSITIONS)}') AS transition,
    t <> '' AND length(t) < 80 AND NOT regexp_matches(t, '[。！？；：:;]$') AND NOT regexp_matches(t, '{T.DEFINITION}') AND NOT regexp_matches(t, '{T.LIST_ITEM}') AS fragment,
    regexp_matches(t, '{'|'.join(T.TEMPLATE_NOTES)}') AS junk, length(t) < 50 AS empty_title FROM b""")
def sentence_predicates(spark, d):
    t = F.coalesce(T.strip(F.col("text")), F.lit(""))
    return table(spark, d, "blocks").select("block_id", t.alias("t")).select("block_id", T.ends_mid_sentence(F.col("t")).alias("mid"), T.is_complete_sentence(F.col("t")).alias("complete"), T.is_transition(F.col("t")).alias("transition"), T.is_short_fragment(F.col("t")).alias("fragment"), T.is_junk(F.col("t")).alias("junk"), (F.length("t") < 50).alias("empty_title"))


@query(f"""WITH b AS (SELECT block_id, doc_id, seq, {strip('text')} AS t FROM blocks), n AS (SELECT block_id, t, lead(t) OVER (PARTITION BY doc_id ORDER BY seq, block_id) AS f FROM b)
    SELECT block_id, coalesce(f = '' OR regexp_matches(f, '^[\\p{{Ll}}\\p{{Nd}}\\x{{4e00}}-\\x{{9fff}}]'), true) AS goes_on FROM n""")
def continuation(spark, d):
    b = running(table(spark, d, "blocks").select("block_id", "doc_id", "seq", "text"), ["doc_id"], ["seq", "block_id"], following=("text",))
    return b.select("block_id", T.starts_continuation(F.col("next_text")).alias("goes_on"))


@query(f"WITH m AS (SELECT doc_id, {S.table_marks('text')} AS m FROM documents WHERE text IS NOT NULL) SELECT doc_id, m.n_lines::INT AS n_lines, m.n_numeric::INT AS n_numeric, m.longest::INT AS longest, m.is_table AS is_table FROM m")
def table_blocks(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.table_marks(F.col("text")).alias("m")).select("doc_id", "m.*")


@query(f"""WITH p AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
    SELECT doc_id, len(list_filter(ls, lambda x: regexp_matches({strip('x')}, '^[IVX]+$'))) > 0 OR len(list_filter(ls, lambda x: contains(x, '....') OR contains(x, '……'))) > len(ls) * 0.4::DOUBLE AS toc FROM p""")
def toc_pages(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", T.is_toc_page(F.col("text")).alias("toc"))


@query(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(text, '\n[IVX]+\n', chr(10), 'g'), '\n\d{1,3}\n', chr(10), 'g'), '\n{3,}', chr(10) || chr(10), 'g')) AS h FROM documents WHERE text IS NOT NULL""")
def clean_pages(spark, d):
    return table(spark, d, "documents").filter("text is not null").select("doc_id", F.md5(T.clean_page_text(F.col("text"))).alias("h"))


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^{W}+|{W}+$', '', 'g') AS t FROM documents WHERE text IS NOT NULL),
    q AS (SELECT concat_ws('; ', CASE WHEN length(t) < 50 THEN 'short' END, CASE WHEN regexp_matches(t, '^[#\s]*(?:目\s*录|Contents|Table of Contents)') THEN 'contents' END, CASE WHEN regexp_matches(t, '^[#\s]*(?:参考文献|References|参考书目)') THEN 'references' END) AS quality_reason FROM b)
    SELECT quality_reason, CASE WHEN quality_reason = '' THEN 'high' ELSE 'low' END AS quality, count(*) AS n FROM q GROUP BY 1, 2""")
def quality_tags(spark, d):
    return chunks.quality(table(spark, d, "documents").filter("text is not null"), "text").groupBy("quality_reason", "quality").agg(F.count("*").alias("n"))


@query("SELECT md5(substring(text, 1, 200)) AS h, min(doc_id) AS keep, count(*) AS copies FROM documents WHERE text IS NOT NULL GROUP BY 1")
def prefix_copies(spark, d):
    return structure.same_start(table(spark, d, "documents"), "doc_id", "text")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, seq ORDER BY parsed_at DESC, block_id) AS k FROM blocks) SELECT doc_id, seq, block_id FROM r WHERE k = 1""")
def latest_blocks(spark, d):
    return structure.latest_parse(table(spark, d, "blocks").select("doc_id", "seq", "block_id", "parsed_at")).select("doc_id", "seq", "block_id")


@query("""WITH s AS (SELECT doc_id AS g, source, sum(length(text)) AS total FROM blocks WHERE doc_id IS NOT NULL AND text IS NOT NULL GROUP BY 1, 2),
    k AS (SELECT split_part(g, '-', 1) || substr(g, -1) AS grp, source, sum(total) AS total FROM s GROUP BY 1, 2)
    SELECT DISTINCT a.grp, CASE WHEN a.total > b.total THEN b.source ELSE a.source END AS source FROM k a JOIN k b ON a.grp = b.grp AND a.source LIKE '%.docx' AND b.source LIKE '%.pdf'
    WHERE greatest(a.total, b.total)::DOUBLE / nullif(least(a.total, b.total), 0)::DOUBLE > 1.15::DOUBLE""")
def format_twins(spark, d):
    docs = table(spark, d, "blocks").filter("doc_id is not null and text is not null").withColumn("grp", F.concat(F.split("doc_id", "-")[0], F.expr("right(doc_id, 1)"))).withColumn("size", F.length("text"))
    return structure.cross_format(docs, ["grp"], "source", "size")


@query(f"""WITH b AS (SELECT doc_id, block_id, page, {strip('text')} AS t, y0 FROM blocks WHERE page IS NOT NULL AND y0 IS NOT NULL AND text IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, block_id) AS u, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, block_id DESC) AS v FROM b),
    e AS (SELECT doc_id, page, md5(substring(t, 1, 100)) AS h, length(t) AS n FROM r WHERE u <= 2 OR v <= 2),
    p AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM blocks WHERE page IS NOT NULL GROUP BY 1),
    c AS (SELECT doc_id, h, count(DISTINCT page) AS pages FROM e WHERE n < 100 GROUP BY 1, 2)
    SELECT c.doc_id, c.h FROM c JOIN p ON c.doc_id = p.doc_id WHERE n_pages >= 3 AND pages > greatest(3.0::DOUBLE, n_pages * 0.4::DOUBLE)""")
def page_header_footer(spark, d):
    return structure.header_footer_noise(table(spark, d, "blocks"))


@query(f"""WITH b AS (SELECT doc_id, block_id, page, {strip('text')} AS t, y0 FROM blocks WHERE page IS NOT NULL AND y0 IS NOT NULL AND text IS NOT NULL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, block_id) AS u, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0 DESC, block_id DESC) AS v FROM b),
    e AS (SELECT doc_id, page, block_id, md5(substring(t, 1, 100)) AS h, length(t) AS n FROM r WHERE u <= 2 OR v <= 2),
    p AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM blocks WHERE page IS NOT NULL GROUP BY 1),
    c AS (SELECT c.doc_id, h FROM (SELECT doc_id, h, count(DISTINCT page) AS pages FROM e WHERE n < 100 GROUP BY 1, 2) c JOIN p ON c.doc_id = p.doc_id WHERE n_pages >= 3 AND pages > greatest(3.0::DOUBLE, n_pages * 0.4::DOUBLE)),
    g AS (SELECT DISTINCT block_id FROM e JOIN c USING (doc_id, h))
    SELECT doc_id, count(*) AS n, CAST(sum(block_id) AS BIGINT) AS ids FROM blocks b WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.block_id = b.block_id) GROUP BY 1""")
def headers_removed(spark, d):
    return structure.without_headers_footers(table(spark, d, "blocks")).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("block_id").alias("ids"))


@query("""WITH f AS (SELECT doc_id, list_sort(list(font_size)) AS s FROM blocks WHERE font_size > 0 GROUP BY 1),
    m AS (SELECT doc_id, s[CAST(floor(len(s) * 0.7::DOUBLE) AS INT) + 1] AS p70, s[CAST(floor(len(s) * 0.9::DOUBLE) AS INT) + 1] AS p90 FROM f WHERE len(s) >= 5),
    c AS (SELECT block_id, CASE WHEN p70 IS NOT NULL THEN (CASE WHEN font_size >= p90 THEN 0.5::DOUBLE WHEN font_size >= p70 THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END) + (CASE WHEN bold THEN 0.1::DOUBLE ELSE 0.0::DOUBLE END)
      + (CASE WHEN length(regexp_replace(text, '^{W}+|{W}+$', '', 'g')) < 30 THEN 0.2::DOUBLE ELSE 0.0::DOUBLE END) END AS score FROM blocks LEFT JOIN m USING (doc_id))
    SELECT block_id, round(score, 6) AS title_score, coalesce(score > 0.6::DOUBLE, false) AS layout_title FROM c""")
def layout_titles(spark, d):
    return structure.layout_titles(table(spark, d, "blocks")).select("block_id", R6("title_score").alias("title_score"), "layout_title")


@query(f"""WITH b AS (SELECT doc_id, seq, block_id, {strip('text')} AS t FROM blocks WHERE {strip('text')} <> '' AND doc_id IS NOT NULL), f AS (SELECT doc_id, block_id, seq, regexp_matches(t, '\\|') AS tab FROM b),
    o AS (SELECT *, CASE WHEN tab AND lag(tab, 1, false) OVER (PARTITION BY doc_id ORDER BY seq, block_id) THEN 0 ELSE 1 END AS opens FROM f),
    i AS (SELECT doc_id, tab, sum(opens) OVER (PARTITION BY doc_id ORDER BY seq, block_id ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT doc_id, CAST(count(DISTINCT island) AS BIGINT) AS islands, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY 1""")
def table_islands(spark, d):
    b = table(spark, d, "blocks").filter("doc_id is not null").withColumn("t", T.strip(F.col("text"))).filter("t <> ''").select("doc_id", "seq", "block_id", F.col("t").contains("|").alias("tab"))
    return structure.islands(b, ["doc_id"], ["seq", "block_id"], F.col("tab")).groupBy("doc_id").agg(F.countDistinct("island").alias("islands"), F.count("*").alias("n"))


def _sections(spark, d) -> DataFrame:
    return structure.sections(structure.latest_parse(table(spark, d, "blocks").filter("doc_id is not null").select("doc_id", "seq", "block_id", "parsed_at", "text", "style", "font_size", "is_title")))


MD5 = "md5(array_to_string(heading_path, '/') || '#' || array_to_string(blocks, chr(10)))"


@query(f"WITH {S.SECTIONS} SELECT doc_id, tier, sec_ord, len(heading_path)::INT AS depth, {MD5} AS h FROM s")
def document_sections(spark, d):
    h = F.md5(F.concat(F.array_join("heading_path", "/"), F.lit("#"), F.array_join("blocks", "\n")))
    return _sections(spark, d).select("doc_id", "tier", "sec_ord", F.size("heading_path").alias("depth"), h.alias("h"))


@query(f"""WITH {S.SECTIONS}, x AS (SELECT doc_id, sec_ord, {strip("array_to_string(blocks, chr(10))")} AS b FROM s), y AS (SELECT *, lead(b) OVER (PARTITION BY doc_id ORDER BY sec_ord) AS f FROM x)
    SELECT doc_id, sec_ord, CASE WHEN {S.junk('b')} THEN 'drop_junk' WHEN {S.is_toc('b')} THEN 'drop_toc' WHEN {S.is_table('b')} THEN 'table' WHEN length(b) < 50 THEN 'merge_title' WHEN {S.transition('b')} THEN 'merge_transition'
      WHEN regexp_matches(b, '[。！？]$') AND length(b) < 200 THEN 'keep_sentence' WHEN f IS NOT NULL AND {S.fragment('b', 'f')} THEN 'merge_fragment' WHEN {S.short_fragment('b')} THEN 'merge_short' ELSE 'keep' END AS verdict FROM y""")
def section_verdicts(spark, d):
    return structure.judged_sections(_sections(spark, d)).select("doc_id", "sec_ord", "verdict")


@query(f"""WITH {S.SECTIONS}, t AS (SELECT *, {S.is_table("array_to_string(blocks, chr(10))")} AS tab FROM s), o AS (SELECT *, CASE WHEN tab AND lag(tab, 1, false) OVER (PARTITION BY doc_id ORDER BY sec_ord) THEN 0 ELSE 1 END AS opens FROM t),
    i AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY sec_ord ROWS UNBOUNDED PRECEDING) AS island FROM o)
    SELECT doc_id, min(sec_ord) AS sec_ord, count(*) AS merged, md5(string_agg(array_to_string(blocks, chr(10)), chr(10) ORDER BY sec_ord)) AS h FROM i GROUP BY doc_id, island""")
def merged_tables(spark, d):
    return structure.merge_tables(_sections(spark, d)).select("doc_id", "sec_ord", "merged", F.md5(F.array_join("blocks", "\n")).alias("h"))


@query(f"WITH {S.SECTIONS}, {S.FILTERED} SELECT doc_id, sec_ord, md5({strip('body')}) AS h FROM f")
def filtered_sections(spark, d):
    return structure.filter_sections(_sections(spark, d)).select("doc_id", "sec_ord", F.md5(T.strip(F.array_join("blocks", "\n"))).alias("h"))


@query(f"""WITH {S.SECTIONS}, c AS (SELECT doc_id, sec_ord, {strip("array_to_string(blocks, chr(10) || chr(10))")} AS content, {S.is_table("array_to_string(blocks, chr(10))")} AS tab FROM s)
    SELECT doc_id || '_s' || sec_ord AS id, length(content)::INT AS n, CASE WHEN tab THEN 'table' WHEN length(content) < 60 AND {S.heading('content')} THEN 'heading' ELSE 'text' END AS type FROM c WHERE length(content) >= 20""")
def section_chunks(spark, d):
    return structure.chunks_of(_sections(spark, d)).select("id", F.length("content").alias("n"), "type")


@query(f"""WITH pa AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS para, p FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM documents WHERE text IS NOT NULL)),
    l0 AS (SELECT doc_id, para, string_split(p[para], chr(10)) AS l FROM pa), l1 AS (SELECT doc_id, para, unnest(range(1, len(l) + 1)) AS i, l FROM l0),
    l2 AS (SELECT doc_id, para, i, {strip("l[i]")} AS line FROM l1), l3 AS (SELECT *, {S.heading('line')} AS head FROM l2 WHERE line <> ''),
    l4 AS (SELECT *, CASE WHEN head OR lag(head, 1, true) OVER (PARTITION BY doc_id, para ORDER BY i) THEN 1 ELSE 0 END AS o FROM l3), l5 AS (SELECT *, sum(o) OVER (PARTITION BY doc_id, para ORDER BY i ROWS UNBOUNDED PRECEDING) AS part FROM l4),
    bl AS (SELECT doc_id, para, part, bool_or(head) AS head, string_agg(line, '' ORDER BY i) AS t FROM l5 GROUP BY 1, 2, 3)
    SELECT doc_id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars, min(md5(t)) AS h FROM bl WHERE head OR length(t) >= 20 GROUP BY 1""")
def page_text_blocks(spark, d):
    b = structure.page_blocks(table(spark, d, "documents").filter("text is not null"), "doc_id", "text")
    return b.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"), F.min(F.md5("text")).alias("h"))


@query("""SELECT source, lang, count(*) AS n, round(avg(length(text)), 6) AS mean_chars FROM documents GROUP BY 1, 2""")
def corpus_counts(spark, d):
    return table(spark, d, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"), R6(F.avg(F.length("text"))).alias("mean_chars"))


def _first_of(x: str, pairs, default: str = "") -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{k}') THEN '{v}'" for k, v in pairs) + f" ELSE '{default}' END"


@query(f"SELECT block_id, {_first_of('source', T.PROVINCES)} AS province, {_first_of('source', T.CROPS)} AS crop, {_first_of('source', T.ZONINGS, T.ZONING)} AS zoning_type FROM blocks WHERE source IS NOT NULL")
def source_kinds(spark, d):
    return table(spark, d, "blocks").filter("source is not null").select("block_id", T.file_meta(F.col("source")).alias("m")).select("block_id", "m.*")


@query("SELECT chunk_id, min(ins_ord) AS ins_ord, min_by(root_id, struct_pack(o := ins_ord, r := root_id)) AS root_id FROM candidates GROUP BY 1")
def first_by_id(spark, d):
    c = table(spark, d, "candidates").select("chunk_id", "root_id", "ins_ord")
    return structure.first_of(c, ["chunk_id"], ["ins_ord", "root_id"])


# Chunks -------------------------------------------------------------------------------------------------------------
@query(f"WITH p AS (SELECT doc_id, {S.packed('text')} AS p FROM documents WHERE text IS NOT NULL) SELECT doc_id, len(p)::INT AS n, list_max(list_transform(p, lambda x: length(x)))::INT AS longest, md5(array_to_string(p, '|')) AS h FROM p")
def sentence_packs(spark, d):
    docs = table(spark, d, "documents").filter("text is not null").select("doc_id", structure.pack_sentences(F.col("text")).alias("p"))
    return docs.select("doc_id", F.size("p").alias("n"), F.array_max(F.transform("p", F.length)).alias("longest"), F.md5(F.array_join("p", "|")).alias("h"))


def _chunks(spark, d) -> DataFrame:
    return chunks.parts(table(spark, d, "documents").filter("text is not null").select("doc_id", F.col("text").alias("content")))


@query()
def recursive_chunks(spark, d):
    return _chunks(spark, d).select("doc_id", "part", F.length("part_text").alias("n"), F.md5("part_text").alias("h"))


@query("""SELECT doc_id, seq, block_id, row_number() OVER (PARTITION BY doc_id ORDER BY seq, block_id) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS chunk_count,
    CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1 THEN doc_id || '_p' || (row_number() OVER (PARTITION BY doc_id ORDER BY seq, block_id) - 1) ELSE doc_id END AS id FROM blocks WHERE doc_id IS NOT NULL""")
def chunk_numbers(spark, d):
    b = chunks.numbered(table(spark, d, "blocks").filter("doc_id is not null").select("doc_id", "seq", "block_id"), "doc_id", ["seq", "block_id"])
    return b.withColumn("id", chunks.unique_id(F.col("doc_id"), F.col("chunk_index"), F.col("chunk_count")))


#: What a document is tagged by: its place and crop as its heading, then its text.
_TAGGED = "concat_ws(' ', province, crop, text)"
_TOPICS = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(x, '{p}') THEN '{n}' END" for n, p in chunks.TOPICS) + "], lambda y: y IS NOT NULL)"
_TOPIC_CTE = f"d AS (SELECT doc_id, {_TAGGED} AS x FROM documents WHERE text IS NOT NULL), h AS (SELECT *, {_TOPICS} AS h FROM d), t AS (SELECT doc_id, x, CASE WHEN len(h) > 0 THEN h[1:3] ELSE ['{chunks.UNTOLD}'] END AS tp FROM h)"


def _tagged(spark, d):
    t = table(spark, d, "documents").filter("text is not null").select("doc_id", F.expr(_TAGGED).alias("x"))
    return t.withColumn("tp", chunks.topics(F.col("x")))


@query(f"WITH {_TOPIC_CTE} SELECT doc_id, array_to_string(tp, ',') AS topics FROM t")
def topic_tags(spark, d):
    return _tagged(spark, d).select("doc_id", F.array_join("tp", ",").alias("topics"))


@query(f"WITH {_TOPIC_CTE} SELECT topic, count(*) AS n FROM (SELECT unnest(tp) AS topic FROM t) GROUP BY 1")
def topic_counts(spark, d):
    return _tagged(spark, d).select(F.explode("tp").alias("topic")).groupBy("topic").agg(F.count("*").alias("n"))


_ENTITIES = "flatten([" + ", ".join(f"CASE WHEN list_contains(tp, '{n}') THEN regexp_extract_all(x, '{p}') ELSE []::VARCHAR[] END" for n, p in chunks.ENTITIES) + f", regexp_extract_all(x, '{chunks.UNIVERSAL}')])"


@query(f"""WITH {_TOPIC_CTE}, e AS (SELECT doc_id, {_ENTITIES} AS l FROM t), u AS (SELECT doc_id, list_filter(list_transform(range(1, len(l) + 1), lambda i: CASE WHEN list_position(l, l[i]) = i THEN l[i] END), lambda y: y IS NOT NULL) AS l FROM e)
    SELECT doc_id, array_to_string(l[1:5], '|') AS entities FROM u""")
def entity_tags(spark, d):
    return _tagged(spark, d).select("doc_id", F.array_join(chunks.entities(F.col("x"), F.col("tp")), "|").alias("entities"))


@query("""SELECT item_id, CASE WHEN coalesce(nullif(province, ''), nullif(crop, ''), nullif(zoning_type, '')) IS NULL THEN '' ELSE '[' || concat_ws(' ', nullif(province, ''), nullif(crop, ''), nullif(zoning_type, '')) || '] ' END AS header FROM golden_items""")
def compact_headers(spark, d):
    return table(spark, d, "golden_items").select("item_id", T.compact_header(F.col("province"), F.col("crop"), F.col("zoning_type")).alias("header"))


@query(r"""WITH o AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents WHERE length(text) > 1000), e AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, l FROM o),
    m AS (SELECT doc_id, i, l[i] AS line, regexp_matches(l[i], '^#{2,4}\s+\S') AS head FROM e), s AS (SELECT *, sum(head::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS sub FROM m)
    SELECT doc_id, CAST(sub AS INT) AS sub, min(CASE WHEN head THEN regexp_replace(line, '^#+\s+', '') END) AS title, md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT head), '')) AS h FROM s GROUP BY 1, 2
    UNION ALL SELECT doc_id, 0, NULL, md5(text) FROM documents WHERE length(text) <= 1000""")
def heading_splits(spark, d):
    """Documents of over 1,000 characters cut at their headings of any level: third-level ones are rare in these texts."""
    return chunks.heading_split(table(spark, d, "documents").filter("text is not null"), "doc_id", "text", 1000, "{2,4}").select("doc_id", "sub", "title", F.md5("body").alias("h"))


@query(r"""WITH t AS (SELECT block_id, list_transform(string_split(text, chr(10))[2:], lambda x: regexp_extract(x, '^\| ([^|]+) \| (\d{4}) \| ([^|]+) \|$', ['a', 'y', 'v'])) AS r FROM blocks WHERE regexp_full_match(text, '\| 站点 \| 年份 \| 指标 \|(?:\n\| [^|\n]+ \| \d{4} \| [^|\n]+ \|)+')),
    n AS (SELECT *, list_filter(list_transform(range(1, len(r) + 1), lambda i: CASE WHEN list_position(list_transform(r, lambda x: x.a), r[i].a) = i THEN r[i].a END), lambda x: x IS NOT NULL)[1:4] AS ns FROM t)
    SELECT block_id, '该表格列出' || array_to_string(ns, '、') || '等' || len(ns) || '项指标的具体数值。' || CASE WHEN len(r) <= 6 THEN array_to_string(w, '。') ELSE array_to_string(w, '；') END AS linear FROM (SELECT *, list_transform(r, lambda x: x.a || '：年份 ' || x.y || '年，指标 ' || x.v) AS w FROM n)""")
def linear_tables(spark, d):
    """Tables of the blocks, given the rule below their heading that they lack, and years that aren't taken for numbering."""
    b = table(spark, d, "blocks").filter(F.col("text").rlike(r"^\| 站点 \| 年份 \| 指标 \|(?:\n\| [^|\n]+ \| \d{4} \| [^|\n]+ \|)+$"))
    ruled = F.regexp_replace(F.regexp_replace("text", r"\| (\d{4}) \|", "| $1年 |"), r"^([^\n]+)\n", "$1\n| --- | --- | --- |\n")
    return linearise.linearise(b.select("block_id", ruled.alias("text")), "text").select("block_id", "linear")


SEGMENTS = """WITH g AS (SELECT n_name, c_mktsegment AS s, printf('%.2f', min(c_acctbal)) AS a, printf('%.2f', max(c_acctbal)) AS m FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
    l AS (SELECT *, row_number() OVER (PARTITION BY n_name ORDER BY s) AS k FROM g), c AS (SELECT n_name, count(*) AS n, string_agg(s, '、' ORDER BY s) FILTER (WHERE k <= 4) AS ns, string_agg('风险' || s, '、' ORDER BY s) FILTER (WHERE k <= 4) AS rs FROM l GROUP BY 1)"""


@query(SEGMENTS + """ SELECT n_name, 'wide' AS form, n_name || '中，该表格列出' || any_value(ns) || '等' || least(any_value(n), 4) || '项指标的具体数值。' || string_agg(s || '：最低 ' || a || '，最高 ' || m, '。' ORDER BY s) AS said FROM l JOIN c USING (n_name) GROUP BY n_name
    UNION ALL SELECT n_name, 'pair', n_name || '中，该表格为区划指标体系，列出' || any_value(rs) || '等' || least(any_value(n), 4) || '项因子的余额分级阈值。' || '等级：' || string_agg('风险' || s || '的余额为' || a, '；' ORDER BY s) FROM l JOIN c USING (n_name) GROUP BY n_name""")
def table_sentences(spark, d):
    """Balances by market segment of each nation written as pipe tables of three and two columns, and read as sentences."""
    c = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = c.groupBy("n_name", F.col("c_mktsegment").alias("s")).agg(F.format_string("%.2f", F.min("c_acctbal")).alias("a"), F.format_string("%.2f", F.max("c_acctbal")).alias("m"))
    line = lambda *cells: F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
    forms = {"wide": ("| 类别 | 最低 | 最高 |\n| --- | --- | --- |", line("s", "a", "m")), "pair": ("| 等级 | 余额 |\n| --- | --- |", line(F.concat(F.lit("风险"), "s"), "a"))}
    tables = None
    for form, (head, row) in forms.items():
        t = g.withColumn("row", row).groupBy("n_name").agg(F.concat_ws("\n", F.lit(head), structure.gathered("row", "s")).alias("text")).withColumn("form", F.lit(form))
        tables = t if tables is None else tables.unionByName(t)
    return linearise.linearise(tables.withColumn("province", F.col("n_name")), "text", "said").select("n_name", "form", "said")


@query(f"""SELECT DISTINCT cell, regexp_replace(regexp_replace(translate(CASE WHEN cell IN ('——', '—', '---', '--', '…', '...', '/', '无') THEN '' ELSE cell END, '０１２３４５６７８９', '0123456789'), '[\\[（(]([^\\]）)]+)[\\]）)]', '\\1', 'g'), '[～~]', '至', 'g') AS clean
    FROM (SELECT {strip('x')} AS cell FROM (SELECT unnest(string_split(text, '|')) AS x FROM blocks WHERE contains(text, '|')))""")
def clean_cells(spark, d):
    cells = table(spark, d, "blocks").filter(F.col("text").contains("|")).select(F.explode(F.split("text", r"\|")).alias("x")).select(T.strip(F.col("x")).alias("cell")).distinct()
    return cells.select("cell", T.clean_cell(F.col("cell")).alias("clean"))


# Search -------------------------------------------------------------------------------------------------------------
TECHNICAL = search.TECHNICAL.pattern.replace(r"\d", r"\p{Nd}")


def _tokens(key: str, text: str, source: str, to: str) -> str:
    """to(key, term): characters, neighbouring pairs and technical tokens of each text, with repeats."""
    return f"""{to}c AS (SELECT {key}, t, regexp_extract_all(t, '(?s).') AS cs FROM (SELECT {key}, {S.strip(f"replace({text}, chr(10), ' ')")} AS t FROM {source} WHERE {text} IS NOT NULL)),
    {to}b AS (SELECT *, list_transform(range(1, len(cs)), lambda i: CASE WHEN regexp_matches(cs[i], '{W}') OR regexp_matches(cs[i + 1], '{W}') THEN ' ' ELSE cs[i] || cs[i + 1] END) AS bs FROM {to}c),
    {to} AS (SELECT {key}, unnest(list_concat(cs, bs, list_filter(list_distinct(regexp_extract_all(t, '{TECHNICAL}')), lambda x: length(x) > 1 AND NOT list_contains(cs, x) AND NOT list_contains(bs, x)))) AS term FROM {to}b)"""


TERMS = _tokens("doc_id", "text", "documents", "tk") + f""",
    post AS (SELECT doc_id, term, count(*) AS tf FROM tk WHERE NOT regexp_matches(term, '^{W}$') GROUP BY 1, 2), dl AS (SELECT doc_id, sum(tf) AS dl FROM post GROUP BY 1)"""


@query("WITH " + TERMS + " SELECT doc_id, CAST(count(*) AS BIGINT) AS n_terms, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY 1")
def postings_stats(spark, d):
    p = search.postings(table(spark, d, "documents"), "doc_id", "text")
    return p.groupBy("doc_id").agg(F.count("*").alias("n_terms"), F.sum("tf").alias("dl"))


@query("WITH " + TERMS + """, n AS (SELECT (SELECT count(*) FROM documents) AS n), f AS (SELECT term, count(*) AS df FROM post GROUP BY 1), r AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM f, n)
    SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END, 6) AS idf FROM r""")
def term_weights(spark, d):
    docs = table(spark, d, "documents")
    p = materialise(search.postings(docs, "doc_id", "text"), "postings")
    return search.okapi_weights(p, "doc_id", docs.agg(F.count("*").alias("n"))).withColumn("idf", R6("idf"))


@query("WITH " + TERMS + r""", n AS (SELECT count(*) AS n, (SELECT sum(dl) FROM dl)::DOUBLE / count(*) AS avgdl FROM documents), f AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
    r AS (SELECT term, df, ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) AS raw FROM f, n), w AS (SELECT term, CASE WHEN raw < 0 THEN 0.25::DOUBLE * (SELECT avg(raw) FROM r) ELSE raw END AS idf FROM r),
    """ + _tokens("item_id", "question", "golden_items", "qt") + r""",
    q AS (SELECT item_id, term, count(*) AS qtf FROM qt WHERE NOT regexp_matches(term, '^{W}$') GROUP BY 1, 2),
    s AS (SELECT q.item_id, p.doc_id, sum(qtf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl.dl / avgdl))) AS score FROM q JOIN post p USING (term) JOIN w USING (term) JOIN dl ON dl.doc_id = p.doc_id, n GROUP BY 1, 2),
    k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s WHERE abs(score) > 1e-12)
    SELECT item_id, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 10""")
def bm25_topk(spark, d):
    return search.bm25(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "golden_items"), "item_id", "question").withColumn("score", R6("score")).withColumn("rank", F.col("rank").cast("long"))


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0")


SIMS = """e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, q.label AS ql, x.vec_id, x.label, list_dot_product(q.v, x.v) / sqrt(list_dot_product(q.v, q.v)) / sqrt(list_dot_product(x.v, x.v)) AS sim FROM e q JOIN e x ON q.vec_id % 100 = 0 AND q.vec_id <> x.vec_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(sim, 12) DESC, vec_id) AS rank FROM s)"""


def _topk(spark, d, k=10) -> DataFrame:
    e = table(spark, d, "embeddings")
    return search.cosine_topk(e.select("vec_id", "embedding"), "vec_id", "embedding", _asked(spark, d), k)


@query("WITH " + SIMS + " SELECT query_id, vec_id, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM k WHERE rank <= 10")
def cosine_topk(spark, d):
    return _topk(spark, d).withColumn("sim", R6("sim"))


def _ranked(spark, d, k=10) -> DataFrame:
    e = table(spark, d, "embeddings").select("vec_id", "label")
    t = _topk(spark, d, k)
    return t.join(e, "vec_id").join(e.withColumnsRenamed({"vec_id": "query_id", "label": "ql"}), "query_id").withColumn("rel", (F.col("label") == F.col("ql")).cast("int"))


@query("WITH " + SIMS + """, h AS (SELECT query_id, min(CASE WHEN label = ql THEN rank END) AS f, count(CASE WHEN label = ql THEN 1 END) AS h, count(CASE WHEN label = ql AND rank <= 5 THEN 1 END) AS h5 FROM k WHERE rank <= 10 GROUP BY 1)
    SELECT query_id, round(coalesce(1.0::DOUBLE / f, 0), 6) AS rr, h5 > 0 AS recall_5, round(h5 / 5.0::DOUBLE, 6) AS precision_5, h AS hit_count FROM h""")
def ranking_metrics(spark, d):
    r = _ranked(spark, d)
    gold = r.filter("rel = 1").select("query_id", "vec_id")
    return evaluation.per_query(r.select("query_id"), r.select("query_id", "vec_id", "rank"), gold, "query_id", "vec_id").select("query_id", R6("rr").alias("rr"), "recall_5", R6("precision_5").alias("precision_5"), "hit_count")


@query("WITH " + SIMS + """, h AS (SELECT query_id, ql, min(CASE WHEN label = ql THEN rank END) AS f FROM k WHERE rank <= 10 GROUP BY 1, 2)
    SELECT ql AS label, count(*) AS n, round(avg(coalesce(1.0::DOUBLE / f, 0)), 6) AS mrr FROM h GROUP BY 1""")
def mrr_by_label(spark, d):
    r = _ranked(spark, d)
    m = evaluation.per_query(r.select("query_id"), r.select("query_id", "vec_id", "rank"), r.filter("rel = 1"), "query_id", "vec_id").join(r.select("query_id", "ql").distinct(), "query_id")
    return m.groupBy(F.col("ql").alias("label")).agg(F.count("*").alias("n"), R6(F.avg("rr")).alias("mrr"))


@query("WITH " + SIMS + """, g AS (SELECT query_id, rank, CASE WHEN label = ql THEN 1 ELSE 0 END AS rel, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN label = ql THEN 1 ELSE 0 END DESC, rank) AS i FROM k WHERE rank <= 10),
    n AS (SELECT query_id, sum(rel / log2(rank + 1)) AS dcg, sum(rel / log2(i + 1)) AS idcg FROM g GROUP BY 1) SELECT query_id, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 6) AS ndcg FROM n""")
def ndcg_at_10(spark, d):
    return evaluation.ndcg(_ranked(spark, d), "query_id", "rel", 10).withColumn("ndcg", R6("ndcg"))


@query("WITH " + SIMS + """, b AS (SELECT query_id, max(CASE WHEN label = ql THEN sim END) AS gs, max(CASE WHEN label <> ql THEN sim END) AS ts, count(*) AS n FROM s GROUP BY 1)
    SELECT b.query_id, 1 + (SELECT count(*) FROM s WHERE s.query_id = b.query_id AND label <> ql AND sim > gs) AS gold_rank, n, round(gs, 6) AS gold_sim, round(ts, 6) AS top_sim, round(gs - ts, 6) AS margin FROM b WHERE gs IS NOT NULL""")
def oracle_ranks(spark, d):
    o = search.label_ranks(table(spark, d, "embeddings"), "vec_id", "embedding", "label", _asked(spark, d))
    return o.select("query_id", "gold_rank", "n", *[R6(c).alias(c) for c in ("gold_sim", "top_sim", "margin")])


@query("WITH " + SIMS + """, g AS (SELECT query_id, max(sim) AS top FROM s GROUP BY 1) SELECT CASE WHEN top >= 0.65 THEN 'high' WHEN top >= 0.55 THEN 'middle' ELSE 'low' END AS band, count(*) AS n FROM g GROUP BY 1""")
def cosine_bands(spark, d):
    top = _topk(spark, d, 1)
    return top.groupBy(F.when(F.col("sim") >= 0.65, "high").when(F.col("sim") >= 0.55, "middle").otherwise("low").alias("band")).agg(F.count("*").alias("n"))


from . import queries_ranking, queries_relational, queries_more  # noqa: E402,F401  they register their queries
