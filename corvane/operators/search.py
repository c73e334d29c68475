"""Lexical and dense search of query sets over whole tables."""

from __future__ import annotations

import re
from collections import Counter
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
# Technical tokens kept whole.
TECHNICAL = re.compile(r"[A-Z]{2,}\d*|[A-Z][a-z]+\d*|[Δ∇∂αβγ][A-Z]?\d*(?:[-–]\d*)?|[≥≤<>＜＞]-?\d+(?:\.\d+)?[℃°C%天月年hd]?|\d+(?:\.\d+)?[~～-]\d+(?:\.\d+)?[℃°C%天月年hd]?|\d+(?:\.\d+)?[℃°C%hm²kd]{1,3}")


def tokens(text: str | None, technical: bool = True) -> list[str]:
    """Characters, then pairs of neighbours without white space, then technical tokens that aren't there yet."""
    if not text:
        return []
    text = text.replace("\n", " ").strip()
    runs = text.split()
    out = list("".join(runs))
    for run in runs:
        out.extend(map(add, run, run[1:]))
    if technical:
        seen = set(out)
        for t in TECHNICAL.findall(text):
            if len(t) > 1 and t not in seen:
                seen.add(t)
                out.append(t)
    return out


def postings(df: DataFrame, key: str, text: str, technical: bool = True) -> DataFrame:
    """(key, term, tf, dl): counted within each row before anything is shuffled. A null or blank text has none."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            for at in range(0, len(b), 200):
                part = b.iloc[at : at + 200]
                counts = [Counter(tokens(t, technical)) for t in part[text].tolist()]
                n = [len(c) for c in counts]
                yield pd.DataFrame({key: np.repeat(part[key].to_numpy(), n), "term": pd.Series([t for c in counts for t in c], dtype=object), "tf": np.array([v for c in counts for v in c.values()], np.int32), "dl": np.repeat(np.array([sum(c.values()) for c in counts], np.int32), n)})

    return spread(df.select(key, text)).mapInPandas(run, f"`{key}` {kind}, term string, tf int, dl int")


def okapi_weights(post: DataFrame, key: str, n_docs: DataFrame) -> DataFrame:
    """(term, df, idf): negative ones become EPSILON times the mean over all terms. n_docs has one row: n, avgdl."""
    df_ = post.groupBy("term").agg(F.count("*").alias("df"))
    raw = df_.crossJoin(n_docs).withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(mean).select("term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf"))


#: Terms counted in one Python worker before they are handed on, (question, term) weights sent to every task in one pass, and scores held at once.
TERMS_HELD, WEIGHTS_SENT, SCORES_HELD = 500_000, 5_000_000, 8_000_000


def term_counts(docs: DataFrame, text: str, technical: bool = True) -> DataFrame:
    """(term, df, dl): texts that hold each term, counted in each task before the shuffle; the row without a term has the number of rows and of all terms."""

    def run(batches):
        df: Counter = Counter()
        rows = total = 0
        for b in batches:
            for t in b[text].tolist():
                found = tokens(t, technical)
                rows, total = rows + 1, total + len(found)
                df.update(set(found))
            if len(df) > TERMS_HELD:
                yield pd.DataFrame({"term": list(df), "df": np.fromiter(df.values(), np.int64, len(df)), "dl": 0})
                df = Counter()
        yield pd.DataFrame({"term": [*df, None], "df": [*df.values(), rows], "dl": [0] * len(df) + [total]}).astype({"df": "int64", "dl": "int64"})

    return spread(docs.select(text)).mapInPandas(run, "term string, df long, dl long").groupBy("term").agg(F.sum("df").alias("df"), F.sum("dl").alias("dl"))


def bm25(docs: DataFrame, key: str, text: str, queries: DataFrame, query: str, query_text: str, k: int = 10, technical: bool = True) -> DataFrame:
    """(query, key, score, rank): Okapi top k of each query, ties (at nine places) to the smaller key; zero scores are left out.

    A term occurring twice in a query counts twice; negative weights become EPSILON times the mean over all terms. One
    pass counts terms; the queries' weighted terms then go to every task, which scores each text as it is read, whole,
    and keeps the best k of each query: only those are shuffled. More weights than WEIGHTS_SENT are taken in several passes.
    """
    kind, qkind = dict(docs.dtypes)[key], dict(queries.dtypes)[query]
    counts = materialise(term_counts(docs, text, technical), "terms")
    n, total = next(iter(counts.filter("term is null").select("df", "dl").collect()), (0, 0))
    known = counts.filter("term is not null")
    raw = F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    mean = known.agg(F.avg(raw).alias("m")).first()["m"] or 0.0
    asked = postings(queries.filter(F.col(query).isNotNull()), query, query_text, technical).groupBy(F.col(query).alias("q"), "term").agg(F.sum("tf").alias("qtf"))
    weighted = materialise(asked.join(known, "term").select("q", "term", (F.col("qtf") * F.when(raw < 0, EPSILON * mean).otherwise(raw) * (K1 + 1)).alias("w")), "weights")
    rows = weighted.count()
    parts = max(1, -(-rows // WEIGHTS_SENT))
    mean_length = total / n if n else 0.0
    out = None
    for part in range(parts):
        sent = weighted.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).toPandas()  # a bounded share
        names, index = pd.factorize(sent["q"])[::-1]
        code, terms = pd.factorize(sent["term"])
        order = np.argsort(code, kind="stable")
        starts = np.concatenate(([0], np.cumsum(np.bincount(code, minlength=len(terms)))))
        shared = docs.sparkSession.sparkContext.broadcast((names.tolist(), {t: i for i, t in enumerate(terms)}, starts, index[order], sent["w"].to_numpy()[order]))

        def run(batches, shared=shared):
            names, terms, starts, asking, weights = shared.value
            n = len(names)
            floor = np.full(n, -np.inf)  # what a score must reach to be among a query's best of this task
            best: pd.DataFrame | None = None
            step = max(1, min(256, SCORES_HELD // max(1, n)))
            for b in batches if n else ():
                found = [] if best is None else [best]
                for at in range(0, len(b), step):
                    keys = b[key].iloc[at : at + step].to_numpy()
                    counts = [tokens(t, technical) for t in b[text].iloc[at : at + step].tolist()]
                    norms = np.array([K1 * (1 - B + B * len(x) / mean_length) for x in counts]) if mean_length else np.zeros(len(counts))
                    tfs = [Counter(filter(terms.__contains__, x)) for x in counts]
                    held = np.fromiter(map(len, tfs), np.int64, len(tfs))
                    row = np.repeat(np.arange(len(tfs)), held)
                    term = np.fromiter((terms[t] for tf in tfs for t in tf), np.int64, len(row))
                    f = np.fromiter((v for tf in tfs for v in tf.values()), np.float64, len(row))
                    # Every (text, term) meets the queries that have the term.
                    each = starts[term + 1] - starts[term]
                    where = np.repeat(starts[term] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                    cell = np.repeat(row, each) * n + asking[where]
                    scores = np.bincount(cell, np.repeat(f / (f + norms[row]), each) * weights[where], len(tfs) * n).reshape(len(tfs), n)
                    rounded = np.round(scores, 9)
                    if len(keys) > k:
                        floor = np.maximum(floor, np.partition(rounded, -k, axis=0)[-k])
                    i, j = np.nonzero((rounded >= floor) & (np.abs(scores) > 1e-12))
                    found.append(pd.DataFrame({"q": j, "key": keys[i], "score": scores[i, j], "r": -rounded[i, j]}))
                best = pd.concat(found).sort_values(["q", "r", "key"], kind="stable").groupby("q", sort=False).head(k)
                last = best.groupby("q")["r"].agg(["max", "size"])
                full = last.index[last["size"] == k]
                floor[full] = np.maximum(floor[full], -last["max"][full])
            if best is not None and len(best):
                yield pd.DataFrame({query: [names[q] for q in best["q"]], key: best["key"].to_numpy(), "score": best["score"].to_numpy()})

        found = spread(docs.filter(F.col(key).isNotNull()).select(key, text)).mapInPandas(run, f"`{query}` {qkind}, `{key}` {kind}, score double")
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy(query).orderBy(F.desc(F.round("score", 9)), key)
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def blocks_of(df: DataFrame, key: str, vector: str, size: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows packed into blocks of vectors: (ids array, data array, an array for each extra number); each partition packs its own."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        for b in batches:
            for at in range(0, len(b), size):
                part = b.iloc[at : at + size]
                m = np.vstack([np.asarray(v, np.float64) for v in part[vector]])
                yield pd.DataFrame({"ids": [part[key].tolist()], "data": [m.ravel()], "dim": [m.shape[1]]} | {f"x_{c}": [part[c].to_numpy(np.float64)] for c in extra})

    return df.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).select(key, vector, *extra).mapInPandas(run, f"ids array<{kind}>, data array<double>, dim int" + "".join(f", x_{c} array<double>" for c in extra))


def unit(data, dim: int) -> np.ndarray:
    """Rows of unit length; zero rows stay zero."""
    m = np.asarray(data, np.float64).reshape(-1, dim)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def cosine_topk(rows: DataFrame, key: str, vector: str, asked: DataFrame, k: int = 10, include_self: bool = False, query: str = "query_id", block: int = 2048) -> DataFrame:
    """(query, key, sim, rank): exact cosine top k of a stated query set against all rows.

    Queries and rows are packed into blocks; each pair of blocks is one matrix product that keeps its k best for each
    query, and only those are shuffled. A zero vector has similarity 0 with all. Ties go to the smaller key.
    """
    kind = dict(rows.dtypes)[key]
    pairs = blocks_of(rows, key, vector, block).crossJoin(blocks_of(asked, key, vector, block).withColumnsRenamed({"ids": "qids", "data": "qdata", "dim": "qdim"}))

    def run(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                x, q = unit(r.data, r.dim), unit(r.qdata, r.qdim)
                ids, qids = np.asarray(r.ids), np.asarray(r.qids)
                sim = q @ x.T
                if not include_self:
                    sim[qids[:, None] == ids[None, :]] = -np.inf
                rounded = np.round(sim, 12)
                bar = np.partition(rounded, -k, axis=1)[:, -k] if sim.shape[1] > k else np.full(len(qids), -np.inf)
                i, j = np.nonzero((rounded >= bar[:, None]) & (sim >= -2))
                found = pd.DataFrame({"i": i, key: ids[j], "sim": sim[i, j], "r": -rounded[i, j]})
                if len(found) > k * len(qids):  # ties at the last place
                    found = found.sort_values(["i", "r", key], kind="stable").groupby("i", sort=False).head(k)
                yield pd.DataFrame({query: qids[found["i"].to_numpy()], key: found[key].to_numpy(), "sim": found["sim"].to_numpy()})

    near = pairs.mapInPandas(run, f"{query} {kind}, `{key}` {kind}, sim double").filter("sim >= -2")
    w = Window.partitionBy(query).orderBy(F.desc(F.round("sim", 12)), key)
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    """Of two vectors of one length; 0 where either is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u * v), F.lit(0.0), lambda s, u: s + u)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)) + 1e-8)


def hashed_vector(text: str | None, dims: int = 64) -> list[float] | None:
    """Stand-in embedding: hashed neighbouring pairs, of unit length; for use where no model is given."""
    if not text:
        return None
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = ((p[:-1] * np.uint64(2654435761) + p[1:] * np.uint64(40503)) >> np.uint64(7)) % np.uint64(dims) if len(p) > 1 else p % np.uint64(dims)
    v = np.bincount(h.astype(np.int64), minlength=dims).astype(np.float64)
    n = np.linalg.norm(v)
    return (v / n).tolist() if n else v.tolist()


def embed(df: DataFrame, text: str, to: str = "embedding", model=None) -> DataFrame:
    """Adds a vector for each text by the model, a function from a list of texts to vectors."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(model(s.tolist()) if model else [hashed_vector(t) for t in s])

    return df.withColumn(to, run(F.col(text)))


def label_ranks(rows: DataFrame, key: str, vector: str, label: str, asked: DataFrame, query: str = "query_id", block: int = 2048) -> DataFrame:
    """(query, gold_rank, n, gold_sim, top_sim, margin): where the nearest row of a query's own label stands among all other rows.

    Two passes over pairs of blocks: the first keeps each query's best similarity with its label and without, the second
    counts the rows before the former. Only one row for each query and block is shuffled, never the similarities.
    """
    kind = dict(rows.dtypes)[key]
    data = blocks_of(rows, key, vector, block, (label,))

    def pairs(q: DataFrame, extra: tuple[str, ...]) -> DataFrame:
        b = blocks_of(q, key, vector, block, extra)
        return data.crossJoin(b.select(*(F.col(c).alias(f"q_{c}") for c in b.columns)))

    def parts(r):
        ids, qids = np.asarray(r.ids), np.asarray(r.q_ids)
        sim = unit(r.q_data, r.q_dim) @ unit(r.data, r.dim).T
        other = qids[:, None] != ids[None, :]
        own = np.asarray(getattr(r, f"q_x_{label}"))[:, None] == np.asarray(getattr(r, f"x_{label}"))[None, :]
        return qids, sim, other, own

    def best(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                qids, sim, other, own = parts(r)
                yield pd.DataFrame({query: qids, "g": np.where(other & own, sim, -2.0).max(1), "t": np.where(other & ~own, sim, -2.0).max(1), "n": other.sum(1)})

    def ahead(batches):
        for b in batches:
            for r in b.itertuples(index=False):
                qids, sim, other, own = parts(r)
                yield pd.DataFrame({query: qids, "ahead": (other & ~own & (sim > np.asarray(r.q_x_g)[:, None] + 1e-12)).sum(1)})

    tops = pairs(asked, (label,)).mapInPandas(best, f"{query} {kind}, g double, t double, n long").groupBy(query).agg(F.max("g").alias("g"), F.max("t").alias("t"), F.sum("n").alias("n")).filter("g > -2")
    tops = materialise(tops, "tops")
    again = asked.join(tops.select(F.col(query).alias(key), "g"), key)
    counts = pairs(again, (label, "g")).mapInPandas(ahead, f"{query} {kind}, ahead long").groupBy(query).agg(F.sum("ahead").alias("ahead"))
    top = F.when(F.col("t") > -2, F.col("t"))
    return tops.join(counts, query).select(query, (F.col("ahead") + 1).alias("gold_rank"), "n", F.col("g").alias("gold_sim"), top.alias("top_sim"), (F.col("g") - top).alias("margin"))
