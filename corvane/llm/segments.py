"""Cutting oversized texts at valleys of lexical cohesion."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, OVERLAP = 800, 150
#: Stretches on either side of a boundary whose words are compared.
WINDOW = 3
BUCKETS = 512
LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
SENTENCE = re.compile(r"\r\n|[\n\r\x0b\x0c\x85  ]|[。！？；!?;]|\.(?=\s)")
SOFT = re.compile(r"[\s|，,、]")


def boundaries(text: str, style: str | None) -> list[int]:
    """Places after which a natural stretch ends: 0, after each line break, in texts other than tables also after each sentence mark, and the end."""
    pattern = LINE if (style or "").strip().lower() == "table" else SENTENCE
    return sorted({0, len(text), *(m.end() for m in pattern.finditer(text))})


def depths(text: str, bounds: list[int]) -> np.ndarray:
    """Depth of the similarity valley at each inner boundary."""
    n = len(bounds) - 1
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    grams = (points[:-1] * 31 + points[1:]) % BUCKETS
    vectors = np.zeros((n, BUCKETS), np.float32)
    which = np.searchsorted(bounds, np.arange(len(grams)), side="right") - 1
    np.add.at(vectors, (which, grams), 1)
    sums = np.vstack((np.zeros(BUCKETS, np.float32), np.cumsum(np.sqrt(vectors), 0)))
    inner = np.arange(1, n)
    left = sums[inner] - sums[np.maximum(inner - WINDOW, 0)]
    right = sums[np.minimum(inner + WINDOW, n)] - sums[inner]
    norm = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
    sim = np.where(norm > 0, (left * right).sum(1) / np.maximum(norm, 1e-9), 0)
    out = np.zeros(n - 1)
    for i in range(n - 1):
        a = b = i
        while a and sim[a - 1] >= sim[a]:
            a -= 1
        while b < n - 2 and sim[b + 1] >= sim[b]:
            b += 1
        out[i] = sim[a] + sim[b] - 2 * sim[i]
    return out


def cut_kind(text: str, style: str | None, size: int = SIZE) -> str:
    b = boundaries(text, style)
    return "natural" if max(y - x for x, y in zip(b, b[1:])) <= size else "hard"


def pieces(text: str, style: str | None, size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int, bool]]:
    """(start, end, natural end) of each piece: at most `size` long, sharing at most `overlap` with the one before.

    Of the boundaries that fit, the one in the deepest valley is taken, of equal ones the last; where none fits, the text is cut at the last white space or comma, else anywhere.
    """
    if len(text) <= size:
        return [(0, len(text), True)] if text else []
    bounds = boundaries(text, style)
    depth = dict(zip(bounds[1:-1], depths(text, bounds))) if len(bounds) > 2 else {}
    marks = np.array(bounds)
    out: list[tuple[int, int, bool]] = []
    start = covered = 0
    while covered < len(text):
        if len(text) - start <= size:
            out.append((start, len(text), True))
            break
        fit = marks[np.searchsorted(marks, covered, "right") : np.searchsorted(marks, start + size, "right")]
        if not len(fit) and start < covered:
            start = covered  # the next stretch fits only without overlap
            continue
        if len(fit):
            end = int(max(fit, key=lambda x: (depth.get(int(x), 0.0), x)))
        else:
            end = start + size
            soft = [m.end() for m in SOFT.finditer(text, start + size // 2, end)]
            end = soft[-1] if soft else end
        out.append((start, end, bool(len(fit))))
        covered = end
        back = marks[(marks >= end - overlap) & (marks < end) & (marks > start)]
        start = int(back[0]) if len(back) else (end if len(fit) else max(start + 1, end - overlap))
    return out


def _run(df: DataFrame, schema: str, each, key: str, text: str, style: str, size: int) -> DataFrame:
    rows = df.filter((F.length(text) > size) & F.col(key).isNotNull()).select(key, text, F.col(style).cast("string").alias(style) if style in df.columns else F.lit(None).cast("string").alias(style))

    def run(batches):
        for batch in batches:
            yield pd.DataFrame([x for k, t, s in zip(batch[key].tolist(), batch[text].tolist(), batch[style].tolist()) for x in each(k, t, s if isinstance(s, str) else None)], columns=[c.split()[0].strip("`") for c in schema.split(", ")])

    return rows.mapInPandas(run, schema)


def split_oversized(df: DataFrame, key: str = "block_id", text: str = "text", style: str = "style", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(key, piece, start, stop, natural, text, cut_kind): the pieces of every text longer than `size`, in order.

    start and stop are code points of the stored text; the pieces cover it whole. cut_kind is `hard` where some stretch
    between natural boundaries is itself too long, else `natural`. Shorter, empty and null texts and rows without a key give no row; repeated
    rows are cut again. Tables are cut after line breaks only.
    """
    kind = df.schema[key].dataType.simpleString()

    def each(k, t, s):
        whole = cut_kind(t, s, size)
        return [(k, i, a, b, n, t[a:b], whole) for i, (a, b, n) in enumerate(pieces(t, s, size, overlap))]

    return _run(df, f"`{key}` {kind}, piece int, start int, stop int, natural boolean, text string, cut_kind string", each, key, text, style, size)


def oversized(pieces_of: DataFrame, key: str = "block_id") -> DataFrame:
    """(key, cut_kind): one row for each text that was cut."""
    return pieces_of.filter(F.col("piece") == 0).select(key, "cut_kind")
