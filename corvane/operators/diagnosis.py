"""Diagnoses over ranked results: relevance, retrievability, layers, gates, repairs and generated knowledge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def semantic_relevance(ranked: DataFrame, query: str, sim: str, bars: tuple[float, ...] = (0.6, 0.7)) -> DataFrame:
    """mean over queries of the best similarity, and the share of queries above each bar."""
    best = ranked.groupBy(query).agg(F.max(sim).alias("best"))
    return best.agg(F.count("*").alias("n"), F.avg("best").alias("mean_best"), *[F.avg((F.col("best") > b).cast("double")).alias(f"above_{int(b * 100)}") for b in bars])


def retrievability(candidates: DataFrame, gold: DataFrame, query: str, item: str, rank: str, far: int = 50) -> DataFrame:
    """(query, found, best_rank, far): whether any gold item was retrieved at all, and where the best stands before re-ranking."""
    g = gold.select(query, item).distinct()
    best = candidates.join(g, [query, item], "left_semi").groupBy(query).agg(F.min(rank).alias("best_rank"), F.lit(True).alias("found"))
    return g.select(query).distinct().join(best, query, "left").select(query, F.coalesce("found", F.lit(False)).alias("found"), "best_rank", F.coalesce(F.col("best_rank") > far, F.lit(False)).alias("far"))


def layer(dense: Column, bm25: Column, fused: Column, final: Column, cosine: Column, top: int = 10) -> Column:
    """Where a question is lost, from the rank of its best gold item after each stage and its cosine."""
    d, b, r, f = (F.coalesce(c, F.lit(999)) for c in (dense, bm25, fused, final))
    return (
        F.when(f <= top, "A_found").when(r <= top, "B_lost_in_rerank").when((d <= top) | (b <= top), "C_lost_in_fusion")
        .when((d <= 30) | (b <= 30), "D_ranked_low").when(cosine >= 0.65, "E_close_not_retrieved").when(cosine >= 0.55, "F_middling").otherwise("G_far")
    )


def gated_choice(base: DataFrame, merged: DataFrame, query: str, text: str, settings: DataFrame) -> DataFrame:
    """(thr, used, mrr): the rewritten ranking is taken where the base's top similarity is below the threshold and the question is long."""
    j = base.join(merged.select(query, F.col("rr").alias("rr_merged")), query).crossJoin(settings)
    use = (F.col("top1") < F.col("thr")) & (F.length(text) > 12)
    return j.groupBy("thr").agg(F.count_if(use).alias("used"), F.avg(F.when(use, F.col("rr_merged")).otherwise(F.col("rr"))).alias("mrr"))


def pool_sizes(candidates: DataFrame, gold: DataFrame, query: str, item: str, order: list, sizes: tuple[int, ...] = (50, 60, 80)) -> DataFrame:
    """(size, n, found): questions with a gold item among the first `size` candidates, all sizes from one ranking."""
    ranked = candidates.withColumn("_k", F.row_number().over(Window.partitionBy(query).orderBy(*order)))
    g = gold.select(query, item).distinct()
    first = ranked.join(g, [query, item], "left_semi").groupBy(query).agg(F.min("_k").alias("k"))
    every = g.select(query).distinct().join(first, query, "left")
    return every.agg(F.count("*").alias("n"), *[F.count_if(F.col("k") <= s).alias(f"s{s}") for s in sizes]).select(F.explode(F.array(*[F.struct(F.lit(s).alias("size"), F.col("n").alias("n"), F.col(f"s{s}").alias("found")) for s in sizes])).alias("x")).select("x.*")


def section_flattened(ranked: DataFrame, chunks: DataFrame, query: str, section: str, item: str, k: int) -> DataFrame:
    """(query, item, rank): every chunk of each retrieved section in order, cut at k."""
    firsts = ranked.groupBy(query, section).agg(F.min("rank").alias("_r"))
    flat = firsts.join(chunks.select(section, item, "chunk_index"), section)
    return flat.withColumn("rank", F.row_number().over(Window.partitionBy(query).orderBy("_r", "chunk_index", item))).filter(F.col("rank") <= k).select(query, item, "rank")


def best_both_ways(sims: DataFrame, left: str, right: str, by: str) -> DataFrame:
    """(by, forward, backward): mean over left items of the best similarity to a right one, and the other way round."""
    f = sims.groupBy(by, left).agg(F.max("sim").alias("m")).groupBy(by).agg(F.avg("m").alias("forward"))
    b = sims.groupBy(by, right).agg(F.max("sim").alias("m")).groupBy(by).agg(F.avg("m").alias("backward"))
    return f.join(b, by)


def micro_rate(rows: DataFrame, tier: str, hits: str, total: str) -> DataFrame:
    """(tier, rate): hits over terms of all questions together; null where there are no terms."""
    return rows.groupBy(tier).agg((F.sum(hits) / F.nullif(F.sum(total), F.lit(0))).alias("rate"))


def outliers(rows: DataFrame, said: str, measured: str, most: float = 0.3) -> DataFrame:
    """Rows whose tenth of the said score and the measure differ by more than `most`."""
    return rows.filter(F.abs(F.col(said) / 10 - F.col(measured)) > most)


def column_split_ratio(text: Column) -> Column:
    """Share of lines with a gap of several blanks or a tab: text set in columns."""
    rows = F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")
    return F.size(F.filter(rows, lambda x: x.rlike(r"\S(?: {2,}|\t)\S"))) / F.nullif(F.size(rows), F.lit(0))


def quota_by_group(rows: DataFrame, group: str, order: list, total: int) -> DataFrame:
    """An even share of `total` rows from each group, the first of each."""
    n = rows.select(group).distinct().agg(F.greatest(F.floor(F.lit(total) / F.count("*")), F.lit(1)).alias("_n"))
    ranked = rows.withColumn("_k", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return ranked.crossJoin(n).filter(F.col("_k") <= F.col("_n")).drop("_k", "_n")


def knowledge_text(expressions: Column, concepts: Column, summary: Column, each: int = 2, most: int = 10, size: int = 400) -> Column:
    """Match text of a knowledge entry: two expressions of each kind, ten in all, then concepts and summary, cut to a size."""
    said = F.slice(F.flatten(F.transform(F.array_sort(F.map_keys(expressions)), lambda k: F.slice(F.element_at(expressions, k), 1, each))), 1, most)
    empty = F.array().cast("array<string>")
    return F.substring(F.concat_ws(" ", F.coalesce(said, empty), F.coalesce(concepts, empty), summary), 1, size)


def page_fallback(pages: DataFrame, key: str, page: str, text: str, least: int = 50) -> DataFrame:
    """(key, text): a document's pages of at least 50 characters that are no contents pages, joined in order and cleaned."""
    from ..functions import text as T

    kept = pages.filter((F.length(text) >= least) & ~T.is_toc_page(F.col(text)))
    whole = kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))), lambda x: x["t"]), "\n").alias("t"))
    return whole.select(key, T.clean_page_text(F.col("t")).alias("text"))


def answer_or_reason(decision: Column, answer: Column, reason: Column) -> Column:
    return F.when(decision == "answer", answer).when(decision == "fallback", "The answer could not be checked. Please ask again later.").otherwise(F.concat(F.lit("No answer was found in the collection. "), F.coalesce(reason, F.lit(""))))


def rank_moves(a: DataFrame, b: DataFrame, query: str, rank: str, by: int = 3) -> DataFrame:
    """(query, before, after, move) of best ranks in two arms: up or down by at least `by` places, gained, gone, or near."""
    j = a.select(query, F.col(rank).alias("before")).join(b.select(query, F.col(rank).alias("after")), query, "full")
    d = F.col("before") - F.col("after")
    return j.withColumn("move", F.when(F.col("before").isNull() & F.col("after").isNull(), "none").when(F.col("before").isNull(), "gained").when(F.col("after").isNull(), "gone").when(d >= by, "up").when(d <= -by, "down").otherwise("near"))


def difficulty(question: Column, answer: Column) -> Column:
    """easy, medium or hard by features of a question: length, numbers, several marks, length of its answer."""
    points = (F.length(question) > 40).cast("int") + (F.regexp_count(question, F.lit(r"\d+")) >= 3).cast("int") + (F.regexp_count(question, F.lit("[，,；;]")) >= 2).cast("int") + (F.coalesce(F.length(answer), F.lit(0)) > 150).cast("int")
    return F.when(points >= 3, "hard").when(points >= 1, "medium").otherwise("easy")


def markdown(df: DataFrame, most: int = 50) -> str:
    """A small result as a Markdown table, for reports at the edge; more rows than `most` are told, not shown."""
    rows = df.limit(most + 1).collect()
    cell = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows[:most])]
    return "\n".join(lines + ["…"] * (len(rows) > most))
