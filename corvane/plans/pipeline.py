"""The whole path of a batch of questions: index, channels of all sub-queries, fusion, pool, re-ranking, widening, decision."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators import chunks, fusion, rewrite, search
from ..tables import materialise, spread

#: Depths of the channels: original question dense, lexical and by keywords, other sub-queries dense and lexical, and the plain path.
DENSE, LEXICAL, KEYWORDS, SUB_DENSE, SUB_LEXICAL, PLAIN_POOL = 30, 20, 20, 20, 10, 20
#: Characters of a chunk that the re-ranker reads.
PAIR_CHARS = 500
NO_TEXTS = "array<string>"


def index(documents: DataFrame, key: str, text: str, model: Callable | None = None, heading: str | None = None) -> DataFrame:
    """(chunk_id, section_id, chunk_index, heading_path, content, vec) of every document, written once: parts of at most 800
    characters with their vectors. Runs a job."""
    path = F.col(heading) if heading else F.array().cast(NO_TEXTS)
    rows = spread(documents.filter(F.col(text).isNotNull()).select(F.col(key).cast("string").alias("section_id"), path.alias("heading_path"), F.col(text).alias("content")))
    cut = chunks.parts(rows).select("section_id", F.col("part").alias("chunk_index"), "heading_path", F.col("part_text").alias("content")).filter(F.length(F.trim("content")) > 0)
    return materialise(search.embed(cut.withColumn("chunk_id", F.concat("section_id", F.lit("_p"), "chunk_index")), "content", "vec", model), "index")


def load_filter(documents: DataFrame, excluded: str | None = None, quality: str | None = None) -> DataFrame:
    """Documents to index: neither excluded nor of low quality, as far as the columns are named."""
    if excluded:
        documents = documents.filter(~F.coalesce(F.col(excluded), F.lit(False)))
    return documents.filter(F.coalesce(F.col(quality), F.lit("")) != "low") if quality else documents


def build_store(indexed: DataFrame, path: str, rebuild: bool = False) -> DataFrame:
    """The vector store at a path: written anew where it is to be rebuilt or isn't there, else as it stands."""
    spark = indexed.sparkSession
    if not rebuild:
        try:
            return spark.read.parquet(path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
    indexed.write.mode("overwrite").parquet(path)
    return spark.read.schema(indexed.schema).parquet(path)


def sub_queries(questions: DataFrame) -> DataFrame:
    """(root_id, qid, kind, q): the question (0), its rewrites (from 1), then its sub-questions; blank ones are left out."""
    def of(kind: str, texts: Column) -> Column:
        return F.transform(F.filter(F.coalesce(texts, F.array().cast(NO_TEXTS)), lambda x: F.trim(x) != ""), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("q")))

    listed = F.concat(of("Original", F.array("q")), of("Rewrite", F.col("rewrites")), of("SubQ", F.col("subs")))
    return questions.select("root_id", F.posexplode(listed).alias("qid", "s")).select("root_id", "qid", "s.kind", "s.q")


def channel_hits(indexed: DataFrame, asked: DataFrame, keywords: DataFrame | None, model: Callable | None = None, force_keywords: int = KEYWORDS) -> DataFrame:
    """(root_id, qid, kind, channel, chunk_id, rank0, score): every sub-query against both channels, in one pass each;
    keywords (root_id, q) are one more lexical channel of the original question."""
    name = F.concat_ws("|", "root_id", "qid")
    asked = materialise(search.embed(asked.withColumn("id", name), "q", "vec", model), "asked")
    dense = search.cosine_topk(indexed.select("chunk_id", "vec"), "chunk_id", "vec", asked.select(F.col("id").alias("chunk_id"), "vec"), DENSE, include_self=True, query="id")
    texts = asked.select("id", "q")
    if keywords is not None:
        texts = texts.unionByName(keywords.select(F.concat("root_id", F.lit("|0|kw")).alias("id"), "q"))
    words = search.bm25(indexed, "chunk_id", "content", texts, "id", "q", max(LEXICAL, force_keywords))
    of = asked.select("id", "root_id", "qid", "kind")
    d = dense.join(of, "id").select("root_id", "qid", "kind", F.lit("Dense").alias("channel"), "chunk_id", (F.col("rank") - 1).alias("rank0"), F.round("sim", 4).alias("score"))
    w = words.withColumn("kw", F.col("id").endswith("|0|kw")).withColumn("id", F.regexp_replace("id", r"\|kw$", "")).join(of, "id")
    w = w.select("root_id", "qid", "kind", F.when(F.col("kw"), "BM25kw").otherwise("BM25o").alias("channel"), "chunk_id", (F.col("rank") - 1).alias("rank0"), F.lit(None).cast("double").alias("score"))
    depth = F.when(F.col("channel") == "BM25kw", force_keywords).when(F.col("channel") == "Dense", F.when(F.col("qid") == 0, DENSE).otherwise(SUB_DENSE)).otherwise(F.when(F.col("qid") == 0, LEXICAL).otherwise(SUB_LEXICAL))
    return materialise(d.unionByName(w).filter(F.col("rank0") < depth), "hits")


def with_texts(found: DataFrame, indexed: DataFrame, asked: DataFrame) -> DataFrame:
    """Candidates with their chunk and the cosine of those that only lexical channels found; written, at most a few hundred a question."""
    j = found.join(indexed, "chunk_id").join(asked.select("root_id", F.col("vec").alias("asked")), "root_id")
    return materialise(fusion.cosine_filled(j, "cosine_sim", F.col("asked"), F.col("vec")).drop("vec", "asked"), "candidates")


def reranked(pool: DataFrame, prior: str, ce_query: str, scorer: Callable | None, alpha: float = 0.3, lam: float = 0.1, normalise_prior: bool = False) -> DataFrame:
    """Adds final_score and final_rank. scorer gives a number for each (question, first PAIR_CHARS characters of the
    chunk); without one, cosine and prior decide."""
    if scorer is None:
        d = pool.withColumn("final_score", fusion.without_reranker(F.col("cosine_sim"), F.col(prior)))
        return d.withColumn("final_rank", F.row_number().over(Window.partitionBy("root_id").orderBy(F.desc("final_score"), "chunk_id")))

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([float(x) for x in scorer(list(zip(q.tolist(), t.tolist())))], dtype=float)

    scored = pool.withColumn("ce_raw", score(F.col(ce_query), F.substring("content", 1, PAIR_CHARS)))
    return fusion.fuse(scored.withColumn("ce", fusion.length_penalty(F.col("ce_raw"), F.length("content"), lam)), ["root_id"], prior, "ce", "chunk_id", alpha, normalise_prior)


def plain(hits: DataFrame, indexed: DataFrame, questions: DataFrame, asked: DataFrame, scorer: Callable | None = None, k: int = 5, alpha: float = 0.3, lam: float = 0.1, protect: DataFrame | None = None) -> DataFrame:
    """The path of a question on its own: both channels to a depth of max(4 k, 20), weighted reciprocal ranks, the
    re-ranker's pool (with candidates of protect (root_id, chunk_id) that were found), order. Without a scorer the fused order stands."""
    h = hits.filter((F.col("qid") == 0) & (F.col("channel") != "BM25kw") & (F.col("rank0") < max(4 * k, PLAIN_POOL)))
    channel = F.when(F.col("channel") == "Dense", "dense").otherwise("bm25")
    r = fusion.rrf(h.withColumn("channel", channel), ["root_id", "chunk_id"])
    found = fusion.merged(h).join(r.select("root_id", "chunk_id", "rrf"), ["root_id", "chunk_id"])
    full = with_texts(found, indexed, asked)
    pool = fusion.ce_pool(full, ["root_id"], "rrf", "dense_rank", "chunk_id")
    if protect is not None:
        pool = pool.unionByName(full.join(protect.select("root_id", "chunk_id").distinct(), ["root_id", "chunk_id"], "left_semi")).distinct()
    if scorer is None:
        w = Window.partitionBy("root_id").orderBy(F.desc("rrf"), "chunk_id")
        return pool.withColumn("final_score", F.col("cosine_sim")).withColumn("final_rank", F.row_number().over(w)).filter(F.col("final_rank") <= k)
    j = pool.join(questions.select("root_id", "q"), "root_id")
    return reranked(j, "rrf", "q", scorer, alpha, lam, True).filter(F.col("final_rank") <= k)


def several(hits: DataFrame, indexed: DataFrame, questions: DataFrame, asked: DataFrame, scorer: Callable | None = None, k: int = 5, alpha: float = 0.3, lam: float = 0.1, cap: int = 50) -> DataFrame:
    """The path of a question with rewrites or sub-questions: candidates of all, evidence, prior, pool by quotas, and
    re-ranking by the first rewrite where there is one."""
    found = fusion.merged(hits).join(fusion.multi_rrf(hits), ["root_id", "chunk_id"]).withColumn("evidence_score", fusion.evidence(F.col("query_hits")))
    full = fusion.prior(with_texts(found, indexed, asked)).withColumn("prior", F.round("prior", 6))
    size = lambda c: F.coalesce(F.size(F.filter(F.coalesce(c, F.array().cast(NO_TEXTS)), lambda x: F.trim(x) != "")), F.lit(0))
    n = questions.select("root_id", size("rewrites").alias("n_rw"), size("subs").alias("n_sq"), F.coalesce(F.get("rewrites", F.lit(0)), "q").alias("ce_query"))
    full = materialise(full.join(n, "root_id"), "full")
    pool = fusion.quota_pool(full, prior_col="prior", cap=cap, n_rw="n_rw", n_sq="n_sq")
    return reranked(full.join(pool, ["root_id", "chunk_id"]), "prior", "ce_query", scorer, alpha, lam).filter(F.col("final_rank") <= k)


def search_many(indexed: DataFrame, questions: DataFrame, scorer: Callable | None = None, model: Callable | None = None, k: int = 5, alpha: float = 0.3, lam: float = 0.1, cap: int = 50, force: bool = False, kw_depth: int = KEYWORDS) -> tuple[DataFrame, DataFrame]:
    """(judged, merged): each question's own results, for the decision, and those of all its sub-queries.

    questions has root_id, q, rewrites, subs and keywords (lists, null for none). Questions without rewrites and
    sub-questions go the plain way, with their keywords added to the lexical query, unless force is set. All lexical and
    dense searches of all questions are one pass each over an index written before.
    """
    questions = materialise(questions.filter(F.col("q").isNotNull()), "questions")
    subs = sub_queries(questions)
    many = subs.filter("qid > 0").select("root_id").distinct() if not force else questions.select("root_id")
    words = questions.filter(F.size("keywords") > 0)
    multi = questions.join(many, "root_id", "left_semi")
    alone = questions.join(many, "root_id", "left_anti")
    # The keyword channel of those with sub-queries; for the others the keywords join the question's own lexical query.
    kw = words.join(many, "root_id", "left_semi").select("root_id", F.array_join("keywords", " ").alias("q")).unionByName(
        words.join(many, "root_id", "left_anti").select("root_id", rewrite.with_keywords(F.col("q"), F.col("keywords")).alias("q")))
    hits = channel_hits(indexed, subs, kw, model, kw_depth)
    asked = materialise(search.embed(questions.select("root_id", "q"), "q", "vec", model).select("root_id", "vec"), "vectors")
    judged = plain(hits, indexed, questions, asked, scorer, k, alpha, lam)
    cols = ["root_id", "chunk_id", "section_id", "chunk_index", "heading_path", "content", "cosine_sim", "final_score", "final_rank"]
    judged = materialise(judged.select(cols), "judged")
    merged = several(hits.join(multi, "root_id", "left_semi"), indexed, multi, asked, scorer, k, alpha, lam, cap).select(cols)
    own = alone.select("root_id", F.coalesce(F.size("keywords") > 0, F.lit(False)).alias("kw"))
    lone = hits.filter("qid = 0").join(own, "root_id").filter(F.when(F.col("kw"), F.col("channel") != "BM25o").otherwise(F.col("channel") != "BM25kw"))
    lone = lone.withColumn("channel", F.when(F.col("channel") == "BM25kw", "BM25o").otherwise(F.col("channel"))).drop("kw")
    return judged, merged.unionByName(plain(lone, indexed, alone, asked, scorer, k, alpha, lam).select(cols))


def answer(indexed: DataFrame, questions: DataFrame, scorer: Callable | None = None, model: Callable | None = None, k: int = 5, **settings) -> DataFrame:
    """(root_id, section_id, lo, hi, rank, context, decision): the best windows of each question under their heading path,
    and the decision by the question's own best result."""
    judged, merged = search_many(indexed, questions, scorer, model, k, **settings)
    decision = judged.groupBy("root_id").agg(fusion.judge(F.max_by("cosine_sim", -F.col("final_rank")), F.lit(None).cast("string")).alias("decision"))
    windows = fusion.neighbours(merged.withColumn("rank", F.col("final_rank")), indexed, "root_id", heading="heading_path")
    return windows.join(decision, "root_id")


def knowledge_matches(entries: DataFrame, questions: DataFrame, key: str = "chunk_id", k: int = 3, least: float = 0.40, model: Callable | None = None) -> DataFrame:
    """(root_id, key, sim, rank, context): the entries nearest a question by cosine of their match texts, from a least
    similarity on, with a context of at most 400 characters. entries has key, expressions (map), concepts and summary."""
    from ..operators import diagnosis

    texts = entries.select(F.col(key).alias("k"), diagnosis.knowledge_text(F.col("expressions"), F.col("concepts"), F.col("summary")).alias("t")).filter("t <> ''")
    rows = materialise(search.embed(texts, "t", "vec", model), "knowledge")
    asked = search.embed(questions.select(F.col("root_id").alias("k"), "q"), "q", "vec", model).select("k", "vec")
    near = search.cosine_topk(rows.select("k", "vec"), "k", "vec", asked, k, include_self=True, query="root_id").filter(F.col("sim") >= least)
    return near.join(rows.select("k", F.col("t").alias("context")), "k").select("root_id", F.col("k").alias(key), "sim", "rank", "context")
