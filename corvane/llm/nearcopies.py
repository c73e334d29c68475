"""Near-duplicate texts: fast similarity sketches, banding and exact verification."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise
from .batches import slices

SHINGLE, SIMILARITY, LEAST_CHARS = 5, 0.7, 100
#: Bands of coordinates: a pair at similarity 0.7 shares no band with probability (1 - 0.7 ** 4) ** 24 < 0.0014.
ROWS, BANDS = 4, 24
#: Of 64 one-bit coordinates, a pair at 0.7 agrees in 54 on average (deviation 2.9); of all 96 four-bit ones in 69 (4.4).
SAME_BITS, SAME_NIBBLES = 43, 50
#: Texts in a bucket that are paired directly, in the memory of one task; larger buckets go the exact way of rare
#: shingles, which writes some 15 KB a text.
BUCKET = 100_000
#: Pairs that are verified at a time.
VERIFIED = 1_000_000
#: Bands whose rows, with all coordinates, are shuffled at a time.
PASS = 6
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of all runs of `size` characters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(points) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + points[k : k + n] + np.uint64(1)
    return np.unique(mix(h))


@lru_cache(maxsize=4)
def seeds(t: int) -> np.ndarray:
    return mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles_of(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, with repeats, and the index of each one's text."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    n = max(len(points) - size + 1, 0)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x100000001B3) + points[k : k + n] + np.uint64(1)
    owner = np.repeat(np.arange(len(texts)), lengths)[:n]
    inside = np.arange(n) + size <= np.cumsum(lengths)[owner]
    return mix(h[inside]), owner[inside]


def sketches(hashes: np.ndarray, owner: np.ndarray, texts: int, t: int = ROWS * BANDS) -> np.ndarray:
    """Fast similarity sketches of several sets, with t coordinates each.

    Round i below t throws every element into one of t bins and keeps the smallest value of (i, hash) in each; rounds
    from t on throw all elements into bin i - t, so every coordinate of a set that isn't empty fills. A set leaves when
    all its coordinates are filled, which for sets larger than t log t is mostly after the first round. Coordinates of
    two sets agree with the probability of their Jaccard similarity, and the number that agree is concentrated about it
    as for independent ones.
    """
    out = np.full((texts, t), MASK, np.uint64)
    low = np.uint64((1 << 56) - 1)
    for i in range(2 * t):
        if not len(hashes):
            break
        h = mix(hashes ^ seeds(t)[i])
        if i < t:
            bins = owner * t + ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
            values = np.full(texts * t, MASK, np.uint64)
            np.minimum.at(values, bins, h * np.uint64(0x9E3779B97F4A7C15) & low)
            values = values.reshape(texts, t)
            fresh = (out == MASK) & (values != MASK)
            out[fresh] = values[fresh] + (np.uint64(i) << np.uint64(56))
        else:
            values = np.full(texts, MASK, np.uint64)
            np.minimum.at(values, owner, h & low)
            fresh = (out[:, i - t] == MASK) & (values != MASK)
            out[fresh, i - t] = values[fresh] + (np.uint64(t) << np.uint64(56))
        unfilled = (out == MASK).any(1)[owner]
        hashes, owner = hashes[unfilled], owner[unfilled]
    return out


def band_keys(coordinates: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(texts, bands) keys of (texts, coordinates)."""
    bands = coordinates.reshape(len(coordinates), -1, rows)
    h = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2])
    for k in range(rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
    return h.view(np.int64)


def packed(coordinates: np.ndarray, bits: int, count: int) -> np.ndarray:
    """`bits` bits of the first `count` mixed coordinates, packed into int64 columns; count * bits is a multiple of 64."""
    x = (mix(coordinates[:, :count]) & np.uint64((1 << bits) - 1)).reshape(len(coordinates), -1, 64 // bits)
    shift = np.arange(64 // bits, dtype=np.uint64) * np.uint64(bits)
    return np.bitwise_or.reduce(x << shift, axis=2).view(np.int64)


def sketched(rows: DataFrame, count: int, per_band: int) -> DataFrame:
    """(k, h1, h2, nib, bands) of (k, t, h1, h2): the text is read here once and not kept."""
    kind = dict(rows.dtypes)["k"]
    t = count * per_band

    def run(batches):
        for b in batches:
            for at, stop in slices(b["t"].tolist()):
                part = b.iloc[at:stop]
                texts = part["t"].tolist()
                c = sketches(*shingles_of(texts), len(texts), t)
                yield pd.DataFrame({"k": part["k"].to_numpy(), "h1": part["h1"].to_numpy(), "h2": part["h2"].to_numpy(), "nib": list(packed(c, 4, t - t % 16)), "bands": list(band_keys(c, per_band))})

    return rows.select("k", "t", "h1", "h2").mapInPandas(run, f"k {kind}, h1 long, h2 long, nib array<long>, bands array<long>")


def equal_nibbles(x: str, y: str, count: int):
    ones = F.lit(0x1111111111111111)
    d = F.zip_with(x, y, lambda a, b: a.bitwiseXOR(b))
    differing = F.aggregate(d, F.lit(0), lambda acc, v: acc + F.bit_count((v.bitwiseOR(F.shiftrightunsigned(v, 1)).bitwiseOR(F.shiftrightunsigned(v, 2)).bitwiseOR(F.shiftrightunsigned(v, 3))).bitwiseAND(ones)))
    return F.lit(count) - differing


def rare_shingle_pairs(texts: DataFrame, similarity: float) -> DataFrame:
    """(a, b): exact candidates by prefixes. Texts whose sets reach the similarity share one of each other's rarest shingles.

    With shingles ordered by how few texts hold them, two such sets of n elements each share an element among the first
    n - ceil(similarity * n) + 1. What all texts of a bucket have in common comes last and is never a key.
    """
    kind = dict(texts.dtypes)["rep"]

    def run(batches):
        for b in batches:
            sets = [shingles(t) for t in b["t"].tolist()]
            n = [len(s) for s in sets]
            yield pd.DataFrame({"rep": np.repeat(b["rep"].to_numpy(), n), "s": np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64), "n": np.repeat(n, n).astype(np.int32)})

    each = texts.mapInPandas(run, f"rep {kind}, s long, n int")
    weight = each.groupBy("s").agg(F.count("*").alias("w"))
    first = Window.partitionBy("rep").orderBy("w", "s")
    prefix = each.join(weight.filter("w > 1"), "s").withColumn("i", F.row_number().over(first)).filter(F.col("i") <= F.col("n") - F.ceil(F.lit(similarity) * F.col("n") - 1e-9) + 1)
    prefix = prefix.select("rep", "s", "n")
    a, b = prefix.select("s", F.col("rep").alias("a"), F.col("n").alias("na")), prefix.select("s", F.col("rep").alias("b"), F.col("n").alias("nb"))
    fits = (F.col("a") < F.col("b")) & (F.least("na", "nb") >= similarity * F.greatest("na", "nb") - 1e-9)
    return a.join(b, "s").filter(fits).select("a", "b")


def bucket_pairs(bits: int, nibbles: int, width: int, bucket: int):
    """A map over rows (band, h1, rep, nib) sorted by the first three: (a, b) of each two texts of a band that agree in
    enough coordinates, and (a, null) for each text of a band that has more than `bucket` texts. No pair that is not near
    leaves the task. Of equal texts, which have equal h1, the first stands for all."""
    ones = np.uint64(0x1111111111111111)

    def low_bits(x: np.ndarray) -> np.ndarray:
        """The lowest bit of each of the first 64 nibbles."""
        y = x[:, :4] & ones
        for shift, mask in ((3, 0x0303030303030303), (6, 0x000F000F000F000F), (12, 0x000000FF000000FF), (24, 0xFFFF)):
            y = (y | (y >> np.uint64(shift))) & np.uint64(mask)
        return np.bitwise_or.reduce(y << (np.arange(y.shape[1], dtype=np.uint64) * np.uint64(16)), axis=1)

    def near(band, rep, nib):
        bit = low_bits(nib)
        at, d = np.flatnonzero(band[1:] == band[:-1]), 1
        while len(at):
            i = at[(np.bitwise_count(bit[at] ^ bit[at + d]) <= 64 - bits) & (rep[at] != rep[at + d])]
            x = nib[i] ^ nib[i + d]
            x = (x | (x >> np.uint64(1)) | (x >> np.uint64(2)) | (x >> np.uint64(3))) & ones
            i = i[16 * width - np.bitwise_count(x).sum(1, dtype=np.int64) >= nibbles]
            if len(i):
                yield rep[i], rep[i + d]
            d += 1
            at = at[at + d < len(band)]
            at = at[band[at + d] == band[at]]

    def run(batches):
        kind, held, hot = None, None, None
        out, n = [], 0

        def table():
            a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind, from_pandas=True)], ["a", "b"])

        def split(rows):
            """What whole bands give."""
            band, _, rep, nib = rows
            start = np.flatnonzero(np.r_[True, band[1:] != band[:-1]])
            large = np.repeat(np.diff(np.r_[start, len(band)]) > bucket, np.diff(np.r_[start, len(band)]))
            if large.any():
                yield rep[large], np.full(int(large.sum()), None, object)
            yield from near(band[~large], rep[~large], nib[~large])

        def found(batches):
            nonlocal kind, held, hot
            for b in batches:
                if not b.num_rows:
                    continue
                kind = b.column("rep").type
                rows = [b.column("band").to_numpy(), b.column("h1").to_numpy(), b.column("rep").to_numpy(zero_copy_only=False), b.column("nib").flatten().to_numpy().view(np.uint64).reshape(-1, width)]
                if held is not None:
                    rows = [np.concatenate(x) for x in zip(held, rows)]
                band, h1 = rows[0], rows[1]
                first = np.r_[True, (band[1:] != band[:-1]) | (h1[1:] != h1[:-1])]
                rows = [x[first] for x in rows]
                if hot is not None:  # its rows that were held are out already, but for the last
                    more = int(np.searchsorted(rows[0], hot, "right"))
                    if more > 1:
                        yield rows[2][1:more], np.full(more - 1, None, object)
                    if more == len(rows[0]):
                        held = [x[-1:] for x in rows]
                        continue
                    rows, hot = [x[more:] for x in rows], None
                last = int(np.searchsorted(rows[0], rows[0][-1]))
                if last:
                    yield from split([x[:last] for x in rows])
                held = [x[last:] for x in rows]
                if len(held[0]) > bucket:
                    yield held[2], np.full(len(held[2]), None, object)
                    hot, held = held[0][0], [x[-1:] for x in held]
            if held is not None and hot is None:
                yield from split(held)

        for pair in found(batches):
            out.append(pair)
            n += len(pair[0])
            if n > 100_000:
                yield table()
                out, n = [], 0
        if out:
            yield table()

    return run


def candidates(classes: DataFrame, texts: DataFrame, similarity: float, rows: int, count: int, bucket: int, cuts: bool = True) -> DataFrame:
    """(a, b): distinct pairs that share a band and agree in enough coordinates; members of oversized buckets are paired
    by rare shingles instead. Without `cuts` every pair that shares a band goes on to be verified.

    Pairs that share a band by chance grow as the square of the texts. They are told apart in the task that holds the
    band, where the coordinates are at hand, so that only near ones are ever written. Bands come in passes, as rows with
    coordinates of all bands would take several times the input on disk.
    """
    t = rows * count
    scale = min(1.0, max(0.0, (similarity - 0.2) / 0.5))
    if not cuts:
        scale = 0.0
    bits, nibbles = int(cuts * SAME_BITS * (1 + similarity) / 1.7), int(SAME_NIBBLES * scale * t / 96)
    kind = dict(classes.dtypes)["rep"]
    found = None
    for at in range(0, count, PASS):
        banded = classes.select(F.explode(F.slice("bands", at + 1, PASS)).alias("band"), "h1", "rep", "nib").repartition("band").sortWithinPartitions("band", "h1", "rep")
        some = materialise(banded.mapInArrow(bucket_pairs(bits, nibbles, t // 16, bucket), f"a {kind}, b {kind}"), "near", sweep=True)
        found = some if found is None else found.unionByName(some)
    near = found.filter("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    large = found.filter("b IS NULL").select(F.col("a").alias("rep")).distinct()
    if large.isEmpty():
        return near
    nib = classes.select("rep", "nib")
    rare = rare_shingle_pairs(texts.join(large, "rep", "left_semi"), similarity).distinct()
    close = rare.join(nib.select(F.col("rep").alias("a"), F.col("nib").alias("x")), "a").join(nib.select(F.col("rep").alias("b"), F.col("nib").alias("y")), "b")
    return near.unionByName(close.filter(equal_nibbles("x", "y", t - t % 16) >= nibbles).select("a", "b")).distinct()


def verified(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY, most: int = VERIFIED) -> DataFrame:
    """(a, b, similarity): pairs whose shingle sets reach the similarity exactly. About `most` of them meet their texts at
    a time, whose copies leave the disk with each pass."""
    passes = -(-pairs.count() // most) or 1
    out = None
    for at in range(passes):
        some = pairs.filter(F.pmod(F.xxhash64("a", "b"), F.lit(passes)) == at)
        some = materialise(verified_pass(some, texts, similarity), "verified", sweep=True)
        out = some if out is None else out.unionByName(some)
    return out


def verified_pass(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    kind = dict(texts.dtypes)["rep"]
    # Texts meet the pairs' ends once; then only the texts of pairs travel on.
    ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("rep"))
    both = ends.join(texts, "rep").groupBy("a", "b").agg(F.array_sort(F.collect_set(F.struct("rep", "t"))).alias("ts"))
    both = both.select("a", "b", F.explode(F.filter("ts", lambda x: x["rep"] == F.col("a"))["t"]).alias("ta"), "ts").select("a", "b", "ta", F.explode(F.filter("ts", lambda x: x["rep"] == F.col("b"))["t"]).alias("tb"))

    def run(batches):
        kept: dict[str, np.ndarray] = {}

        def of(t: str) -> np.ndarray:
            s = kept.get(t)
            if s is None:
                if len(kept) > 4000:
                    kept.clear()
                s = kept[t] = shingles(t)
            return s

        for b in batches:
            out = []
            for i, j, x, y in zip(b["a"].tolist(), b["b"].tolist(), b["ta"].tolist(), b["tb"].tolist()):
                p, q = of(x), of(y)
                if min(len(p), len(q)) < similarity * max(len(p), len(q)) - 1e-9:
                    continue
                m = len(np.intersect1d(p, q, assume_unique=True))
                s = m / (len(p) + len(q) - m)
                if s >= similarity - 1e-12:
                    out.append((i, j, s))
            yield pd.DataFrame(out, columns=["a", "b", "similarity"])

    return both.mapInPandas(run, f"a {kind}, b {kind}, similarity double").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def near_copies(df: DataFrame, key: str = "block_id", text: str = "text", similarity: float = SIMILARITY, least: int = LEAST_CHARS, rows: int = ROWS, count: int = BANDS, bucket: int = BUCKET, cuts: bool = True) -> tuple[DataFrame, DataFrame]:
    """Members (key, rep) of classes of equal texts, and pairs (a, b, similarity) of class representatives.

    Texts are taken as stored; those shorter than `least` characters, and null ones, take no part. Similarity is the
    share of distinct five-character runs in common. Repeated rows of a key with one text count once; a key with
    several texts is near another if one of its texts is.
    """
    source = df.filter((F.length(text) >= least) & F.col(key).isNotNull()).select(F.col(key).alias("rep"), F.col(text).alias("t"))
    hashed = source.select(F.col("rep").alias("k"), "t", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(7), "t").alias("h2"))
    table = materialise(sketched(hashed, count, rows), "sketches")
    named = table.groupBy("h1", "h2").agg(F.min("k").alias("rep"))
    members = table.select("k", "h1", "h2").distinct().join(named, ["h1", "h2"]).select(F.col("k").alias(key), "rep")
    pairs = materialise(candidates(table.withColumnRenamed("k", "rep"), source, similarity, rows, count, bucket, cuts), "pairs", sweep=True)
    return members, verified(pairs, source, similarity)


def all_pairs(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(a, b): every pair of rows, a < b, within a class or across linked classes."""
    x, y = members.select(F.col(key).alias("k1"), F.col("rep").alias("a")), members.select(F.col(key).alias("k2"), F.col("rep").alias("b"))
    across = links.select("a", "b").join(x, "a").join(y, "b")
    several = members.groupBy("rep").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("rep").alias("a"), F.col("rep").alias("b"))
    within = several.join(x, "a").join(y, "b").filter("k1 < k2")
    return across.select(F.least("k1", "k2").alias("a"), F.greatest("k1", "k2").alias("b")).unionByName(within.select(F.col("k1").alias("a"), F.col("k2").alias("b"))).filter("a < b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): connected components of links (a, b), each named by its smallest node.

    Alternating large and small stars: every node's larger neighbours, then its smaller ones, are hung on the smallest
    node it knows, until the links no longer change. A round is a grouping that combines map-side, a join and a
    distinct, and no node's neighbours are ever gathered; the number of rounds grows with the logarithm of the size.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialise(both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = materialise(small.filter("u <> v").distinct(), "links")
        new = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if new == state:
            break
        state = new
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def groups(members: DataFrame, links: DataFrame, key: str) -> DataFrame:
    """(key, class, group, links): rows with a near copy, their class of equal texts, the group that links connect, and
    the number of other rows each is near. Copies are counted, never paired."""
    sizes = materialise(members.groupBy("rep").agg(F.count("*").alias("n")), "sizes")
    both = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("rep"), F.col("a").alias("other")))
    near = both.join(sizes.select(F.col("rep").alias("other"), "n"), "other").groupBy("rep").agg(F.sum("n").alias("across"))
    roots = components(links).select(F.col("node").alias("rep"), "root")
    classes = sizes.join(near, "rep", "left").join(roots, "rep", "left").withColumn("links", F.col("n") - 1 + F.coalesce("across", F.lit(0))).filter("links > 0")
    return members.join(classes.select("rep", F.coalesce("root", "rep").alias("group"), "links"), "rep").select(key, F.col("rep").alias("class"), "group", "links")
