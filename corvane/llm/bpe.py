"""Byte-level BPE ids of a whole corpus.

Pieces are cut by character class over one array of code points per batch. The merges of all pieces not seen before by
this worker run together: each piece is a row of a segment tree over its byte positions whose nodes hold the leftmost
smallest pair rank, so the root names the next merge and a merge updates the paths of two live neighbours.
"""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import slices

#: Folder of the vocabulary files on the driver, which sends the one needed to the executors.
TOKENIZERS = os.environ.get("CORVANE_TOKENIZERS", "/opt/tokenizers")
#: Pieces that a worker keeps; older ones are dropped together when the number is passed.
KEPT_PIECES = 400_000
NONE = np.int64(1) << 60
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


@lru_cache(maxsize=1)
def classes() -> np.ndarray:
    import regex

    points = "".join(map(chr, range(0xD800))) + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(points[m.start()]), ord(points[m.end() - 1])
            out[a : b + 1] = kind
    return out


def cut(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in order, and the number of pieces of each text. Texts must hold no lone surrogates."""
    whole = "".join(texts)
    n = len(whole)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    if not n:
        return [], np.zeros(len(texts), np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    ends = np.cumsum(lengths)
    first[np.concatenate(([0], ends[:-1]))[lengths > 0]] = True
    start = first[:n].copy()
    start[1:] |= kind[1:] != kind[:-1]
    # Runs of white space: before a non-space of the same text the last one stands alone, and joins it if it is a blank.
    space = kind == SPACE
    before_word = np.zeros(n, bool)
    before_word[:-1] = space[:-1] & ~space[1:] & ~first[1:n]
    start |= before_word
    joins = np.zeros(n, bool)
    joins[1:] = before_word[:-1] & (points[:-1] == 32)
    start &= ~joins
    # Contractions are tried wherever a piece begins: at an apostrophe that starts one.
    for p in np.flatnonzero(start & (points == 39)).tolist():
        for c in CONTRACTIONS:
            if whole.startswith(c, p):
                end = p + len(c)
                if not first[p + 1 : end].any():
                    start[p + 1 : end] = False
                    if end < n:
                        start[end] = True
                break
    at = np.flatnonzero(start)
    stops = np.append(at[1:], n)
    pieces = [whole[a:b] for a, b in zip(at.tolist(), stops.tolist())]
    counts = np.searchsorted(at, ends) - np.searchsorted(at, ends - lengths)
    return pieces, counts


class Vocabulary:
    def __init__(self, path: str):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb") if line.strip())}
        self.size = max(self.ranks.values()) + 1
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        parts = {}
        for token, rank in self.ranks.items():
            for k in range(1, len(token)):
                a, b = self.ranks.get(token[:k]), self.ranks.get(token[k:])
                if a is not None and b is not None:
                    parts[a * self.size + b] = rank
        keys = np.fromiter(parts.keys(), np.int64, len(parts))
        by = np.argsort(keys)
        self.pairs, self.merged = keys[by], np.fromiter(parts.values(), np.int64, len(parts))[by]
        self.mask = (1 << 22) - 1
        self.maybe = np.zeros(1 << 22, bool)  # answers most misses without a search
        self.maybe[self.slot(self.pairs)] = True

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys ^ (keys >> 17)) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, NONE where it has none or an id is -1."""
        keys = left * self.size + right
        out = np.full(len(keys), NONE, np.int64)
        look = np.flatnonzero((left >= 0) & (right >= 0) & self.maybe[self.slot(keys)])
        if len(look):
            k = keys[look]
            at = np.minimum(np.searchsorted(self.pairs, k), len(self.pairs) - 1)
            hit = self.pairs[at] == k
            out[look[hit]] = self.merged[at[hit]]
        return out

    def encode(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece. Pieces of like length share one array of trees."""
        out: list = [None] * len(pieces)
        rest: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            else:
                rest.setdefault(max(1, (len(p) - 1).bit_length()), []).append(i)
        for level, members in rest.items():
            step = max(1, (1 << 20) >> level)
            for k in range(0, len(members), step):
                part = members[k : k + step]
                for i, ids in zip(part, self._merge([pieces[i] for i in part], level)):
                    out[i] = ids
        return out

    def _merge(self, pieces: list[bytes], level: int) -> list[np.ndarray]:
        width, rows = 1 << level, len(pieces)
        flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(rows, width)
        length = np.fromiter(map(len, pieces), np.int64, rows)
        place = np.arange(width)
        ids = np.where(place < length[:, None], self.byte_ids[flat], -1)
        following = np.where(place + 1 < length[:, None], place + 1, -1).astype(np.int32)
        previous = np.broadcast_to(place - 1, (rows, width)).astype(np.int32).copy()
        right = np.full((rows, width), -1, np.int64)
        right[:, :-1] = ids[:, 1:]
        # A node holds rank * width + position, so the smaller of two is the lower rank, or the leftmost of equal ones.
        tree = np.full((rows, 2 * width), NONE, np.int64)
        ranks = self.rank(ids.ravel(), right.ravel()).reshape(rows, width)
        tree[:, width:] = np.where(ranks == NONE, NONE, ranks * width + place)
        for k in range(level - 1, -1, -1):
            a = 1 << k
            tree[:, a : 2 * a] = np.minimum(tree[:, 2 * a : 4 * a : 2], tree[:, 2 * a + 1 : 4 * a : 2])
        live = np.flatnonzero(tree[:, 1] != NONE)
        while len(live):
            top = tree[live, 1]
            at = (top & (width - 1)).astype(np.int64)
            gone = following[live, at].astype(np.int64)
            after = following[live, gone].astype(np.int64)
            ids[live, at] = top >> level
            ids[live, gone] = -1
            following[live, at] = after
            has = after >= 0
            previous[live[has], after[has]] = at[has]
            before = previous[live, at].astype(np.int64)
            next_id = np.where(has, ids[live, np.maximum(after, 0)], -1)
            prev_id = np.where(before >= 0, ids[live, np.maximum(before, 0)], -1)
            own = top >> level
            r = self.rank(np.concatenate((own, prev_id)), np.concatenate((next_id, own)))
            m = len(live)
            new_at = np.where(r[:m] == NONE, NONE, r[:m] * width + at)
            new_before = np.where(r[m:] == NONE, NONE, r[m:] * width + before)
            tree[live, width + at] = new_at
            tree[live, width + gone] = NONE
            front = np.maximum(before, 0)
            tree[live[before >= 0], (width + before)[before >= 0]] = new_before[before >= 0]
            nodes = [(width + at) >> 1, (width + gone) >> 1, (width + front) >> 1]
            for _ in range(level):
                for q in nodes:
                    tree[live, q] = np.minimum(tree[live, 2 * q], tree[live, 2 * q + 1])
                nodes = [q >> 1 for q in nodes]
            live = live[tree[live, 1] != NONE]
        keep = ids >= 0
        flat_ids, stops = ids[keep].astype(np.int32), np.cumsum(keep.sum(1))
        return np.split(flat_ids, stops[:-1])


class Encoder:
    """Encodes texts, keeping the ids of pieces in one growing array."""

    def __init__(self, path: str):
        self.vocabulary = Vocabulary(path)
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.parts: list[np.ndarray] = []
        self.starts, self.sizes, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def learn(self, new: list[str]) -> None:
        got = self.vocabulary.encode([p.encode() for p in new])
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        at = len(self.starts)
        self.known.update(zip(new, range(at, at + len(new))))
        self.starts = np.concatenate((self.starts, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes = np.concatenate((self.sizes, sizes))
        self.flat = np.concatenate((self.flat, *got))

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the number of ids of each."""
        texts = [t if t.isascii() else t.encode("utf-8", "replace").decode() for t in texts]
        pieces, counts = cut(texts)
        if not pieces:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.known) > KEPT_PIECES:
            self.clear()
        new = list(set(pieces) - self.known.keys())
        if new:
            self.learn(new)
        which = np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[which]
        ends = np.cumsum(sizes)
        index = np.repeat(self.starts[which] - (ends - sizes), sizes) + np.arange(ends[-1])
        stops = np.concatenate(([0], ends))[np.cumsum(counts)]
        return self.flat[index], np.diff(np.concatenate(([0], stops)))


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode_corpus(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(key, ids): the ids of each row's text, without special tokens; an empty or null text has no ids: [].

    Every row gives one row, repeated keys too. Strings of special tokens are ordinary text.
    """
    name = f"{vocabulary}.tiktoken"
    df.sparkSession.sparkContext.addFile(os.path.join(folder, name))
    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches):
        coder = encoder(SparkFiles.get(name))
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for at, stop in slices(texts, 512):
                part = batch.slice(at, stop - at)
                ids, sizes = coder.batch(texts[at:stop])
                offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists], [key, "ids"])

    return df.select(key, text).mapInArrow(run, schema)
