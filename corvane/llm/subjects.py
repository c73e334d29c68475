"""Subject areas of documents from the leaves of a bisecting k-means over their passages, labelled by discriminative terms."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialise
from .batches import slices

#: Hashed term dimensions, leaves, and the share of a document's sentences that makes a subject one of its own.
DIMS, LEAVES, SHARE = 1024, 192, 0.25
#: Bounds of the sample that the clusters are fitted on: labelled documents, and sentences of them.
FIT_DOCUMENTS, FIT_SENTENCES = 3000, 14_000
#: A sentence farther from every leaf than this multiple of the fitted sentences' second percentile has no subject.
STRANGE = 1.15
#: Most subject areas.
MOST_SUBJECTS = 1000
#: Terms that label a leaf, and the power that sharpens its mixture.
TERMS, SHARPEN = 20, 3
END = re.compile(r"[。！？!?；;]+|(?<!\bcf)(?<!\bvs)(?<!\bNo)\.(?=\s|$)|[\r\n]+")
MARKUP = re.compile(r"<[^<>]{0,200}>|&[a-z]{2,6};|[*_#`>]+")
WIDE = re.compile("[\uff21-\uff5a]")
NO_LETTER, HAN = re.compile(r"[\W\d_]+"), re.compile("[一-鿿]")
WORD = re.compile("[a-z]{3,}")
BLANKED = re.compile(r"\([^()]{0,40}\)|\d[\d.,:%—–-]*")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text: closed by a sentence mark, or long enough to be one. Headings, page numbers and table rows are none."""
    out = []
    if not text:
        return out
    text = MARKUP.sub(" ", text)
    if WIDE.search(text):
        text = unicodedata.normalize("NFKC", text)
    at = 0
    for m in END.finditer(text + "\n"):
        part, closed = text[at : m.start()].strip(), m.group()[0] not in "\r\n"
        at = m.end()
        if part.startswith("|") or part.count("|") > 2:
            continue
        letters = len(NO_LETTER.sub("", part))
        han = HAN.search(part)
        if letters >= ((6 if closed else 14) if han else (16 if closed else 40)):
            out.append(part)
    return out


def term_hashes(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of all sentences and the index of each one's sentence: pairs of Han characters, and words with their pairs."""
    whole = "\n".join(BLANKED.sub(" ", p.lower()) for p in parts) + "\n"
    points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.cumsum(points == 10) - (points == 10)
    han = (points >= 0x3400) & (points <= 0x9FFF)
    pair = han[:-1] & han[1:]
    h1 = (points[:-1] * 0x9E3779B1 + points[1:] * 0x85EBCA6B)[pair]
    o1 = owner[:-1][pair]
    letter = ((points >= 97) & (points <= 122)) | ((points >= 0xE0) & (points < 0x250))
    begin = letter & ~np.concatenate(([False], letter[:-1]))
    starts = np.flatnonzero(begin)
    if len(starts):
        mixed = np.where(letter, points * 0x27D4EB2F, 0)
        ends = np.flatnonzero(letter & ~np.concatenate((letter[1:], [False]))) + 1
        # A word's hash is a polynomial of its letters by place.
        place = np.arange(len(points))
        place -= np.concatenate((np.zeros(starts[0], np.int64), np.repeat(starts, np.diff(np.append(starts, len(points))))))
        weight = (place * 0x165667B1 + 0x3C6EF372) & 0xFFFFFFFF
        sums = np.concatenate(([0], np.cumsum((mixed * weight) & 0xFFFFFFFF)))
        words = sums[ends] - sums[starts]
        o2 = owner[starts]
        same = o2[:-1] == o2[1:]
        h2 = np.concatenate((words, (words[:-1] * 31 + words[1:])[same]))
        o2 = np.concatenate((o2, o2[:-1][same]))
    else:
        h2 = o2 = np.zeros(0, np.int64)
    h = np.concatenate((h1, h2)).astype(np.uint64)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h >> np.uint64(40)).astype(np.int64) % DIMS, np.concatenate((o1, o2))


def vectors(parts: list[str], weight: np.ndarray | None = None) -> np.ndarray:
    """Normalised rows, one for each sentence."""
    if not parts:
        return np.zeros((0, DIMS), np.float32)
    h, o = term_hashes(parts)
    x = np.bincount(o * DIMS + h, minlength=len(parts) * DIMS).reshape(len(parts), DIMS).astype(np.float32)
    np.sqrt(x, out=x)
    if weight is not None:
        x *= weight
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return np.divide(x, norm, out=x, where=norm > 0)


def split(x: np.ndarray, seed: int) -> np.ndarray:
    """Spherical 2-means of the rows: True for the second half."""
    mean = x.mean(0)
    a = x[np.argmin(x @ mean)]
    b = x[np.argmin(x @ a)]
    centres = np.stack((a, b))
    now = None
    for _ in range(12):
        new = (x @ centres.T).argmax(1) == 1
        if now is not None and (new == now).all() or new.all() or not new.any():
            now = new
            break
        now = new
        centres = np.stack((x[~now].mean(0), x[now].mean(0)))
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-9)
    return now


def bisecting_kmeans(x: np.ndarray, leaves: int, least: int = 4) -> np.ndarray:
    """Leaf of each row: the leaf with the largest spread is split until there are enough."""
    leaf = np.zeros(len(x), np.int32)
    spread = {0: float(len(x) - np.linalg.norm(x.sum(0)))}
    while len(spread) < leaves:
        k = max(spread, key=spread.get)
        if spread[k] <= 1e-6:
            break
        rows = np.flatnonzero(leaf == k)
        second = split(x[rows], k) if len(rows) >= 2 * least else None
        if second is None or min(second.sum(), (~second).sum()) < 1:
            spread[k] = 0.0
            continue
        new = len(spread)
        leaf[rows[second]] = new
        for j, part in ((k, rows[~second]), (new, rows[second])):
            spread[j] = float(len(part) - np.linalg.norm(x[part].sum(0)))
    return leaf


@dataclass
class Model:
    subjects: list[str]
    weight: np.ndarray
    centres: np.ndarray
    mixture: np.ndarray
    floor: float
    terms: list[list[str]] = field(default_factory=list)

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """(texts, subjects): the share of each text's sentences that deal with each subject."""
        parts, owner = [], []
        for i, t in enumerate(texts):
            s = sentences(t)
            parts += s
            owner += [i] * len(s)
        out = np.zeros((len(texts), len(self.subjects)))
        total = np.bincount(np.array(owner, np.int64), minlength=len(texts))
        for at in range(0, len(parts), 4096):
            x = vectors(parts[at : at + 4096], self.weight)
            sim = x @ self.centres.T
            best = sim.argmax(1)
            mix = np.where((sim[np.arange(len(x)), best] >= self.floor)[:, None], self.mixture[best], 0)
            np.add.at(out, np.array(owner[at : at + 4096]), mix)
        return out / np.maximum(total, 1)[:, None]


def terms_of(part: str) -> set[str]:
    """Terms of a sentence: pairs of neighbouring Han characters, and words of three Latin letters or more."""
    part = BLANKED.sub(" ", part.lower())
    return {a + b for a, b in zip(part, part[1:]) if "一" <= a <= "鿿" and "一" <= b <= "鿿"} | set(WORD.findall(part))


def label_leaves(parts: list[str], leaf: np.ndarray, leaves: int, votes: np.ndarray, said: list[set[str]]) -> tuple[np.ndarray, list[list[str]]]:
    """Mixture of subjects of each leaf, from its discriminative terms, and those terms.

    A leaf's terms are those most above their share in all sentences. A term stands for the subjects in whose texts it
    is more frequent than elsewhere, by the votes of labelled texts, and for those whose description has it; so leaves
    get subjects without labels too, where descriptions share their words. A leaf whose terms stand for nothing has none.
    """
    found = [terms_of(p) for p in parts]
    usual = votes.mean(0) if votes.any() else np.full(votes.shape[1], 1 / votes.shape[1])
    usual = np.maximum(usual, 1e-6)
    every: dict[str, int] = {}
    stands: dict[str, np.ndarray] = {}
    counts: list[dict] = [{} for _ in range(leaves)]
    for ts, vote, k in zip(found, votes, leaf.tolist()):
        mine = counts[k]
        for t in ts:
            every[t] = every.get(t, 0) + 1
            mine[t] = mine.get(t, 0) + 1
            if t in stands:
                stands[t] += vote
            else:
                stands[t] = vote.copy()
    for i, words in enumerate(said):
        for t in words & stands.keys():
            stands[t][i] += usual[i]
    mixture, top = np.zeros((leaves, votes.shape[1])), []
    for k, c in enumerate(counts):
        best = sorted(c, key=lambda t: (-c[t] * c[t] / every[t], t))[:TERMS]
        top.append(best)
        for t in best:
            rate = (stands[t] / every[t] / usual) ** 2
            if rate.any():
                mixture[k] += c[t] * c[t] / every[t] * rate / rate.sum()
    mixture /= np.maximum(mixture.sum(1, keepdims=True), 1e-9)
    mixture **= SHARPEN  # a leaf of one subject counts for it alone, one of several keeps them
    return mixture / np.maximum(mixture.sum(1, keepdims=True), 1e-9), top


def fit(parts: list[str], labels: list[set[str]], descriptions: dict[str, str], leaves: int = LEAVES) -> Model:
    """Clusters sentences of texts, given with the texts' labels, and labels each leaf by its discriminative terms.

    A sentence's vote is shared among the labels of its text; sentences of texts without labels have none.
    """
    subjects = sorted(descriptions)
    index = {s: i for i, s in enumerate(subjects)}
    if not parts or not subjects:
        return Model(subjects, np.ones(DIMS, np.float32), np.zeros((1, DIMS), np.float32), np.zeros((1, len(subjects))), 2.0)
    raw = vectors(parts)
    weight = np.log((1 + len(raw)) / (1 + (raw > 0).sum(0))).astype(np.float32)
    x = vectors(parts, weight)
    leaf = bisecting_kmeans(x, min(leaves, max(1, len(parts) // 4)))
    n = int(leaf.max()) + 1
    votes = np.zeros((len(parts), len(subjects)))
    for r, names in enumerate(labels):
        known = [index[s] for s in names if s in index]
        votes[r, known] = 1 / max(1, len(known))
    mixture, terms = label_leaves(parts, leaf, n, votes, [set(WORD.findall((s.replace("_", " ") + " " + descriptions[s]).lower())) for s in subjects])
    sums = np.zeros((n, DIMS), np.float32)
    np.add.at(sums, leaf, x)
    centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    rest = sums[leaf] - x  # each sentence against the others of its leaf
    near = ((x * rest).sum(1) / np.maximum(np.linalg.norm(rest, axis=1), 1e-9))[np.bincount(leaf)[leaf] > 2]
    return Model(subjects, weight, centres, mixture, min(float(np.quantile(near, 0.02)), 0.5) * STRANGE if len(near) else 0.1, terms)


def labelled_sample(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", limit: int = FIT_DOCUMENTS, most: int = FIT_SENTENCES) -> list:
    """At most `most` sentences of at most `limit` labelled documents, those first by hash, with all labels of their documents.

    Without any labels, of as many documents of the whole table."""
    sets = labels.filter("doc_id is not null and subject is not null").groupBy(F.col("doc_id").alias("k")).agg(F.array_sort(F.collect_set("subject")).alias("names"))
    chosen = materialise(sets.orderBy(F.xxhash64("k"), "k").limit(limit), "labels")
    if chosen.isEmpty():
        keys = documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
        chosen = materialise(keys.orderBy(F.xxhash64("k"), "k").limit(limit).withColumn("names", F.array().cast("array<string>")), "labels")
    rows = documents.select(F.col(key).alias("k"), F.col(text).alias("t")).join(F.broadcast(chosen), "k").filter("t is not null")

    def run(batches):
        for b in batches:
            found = [(n, s) for n, t in zip(b["names"].tolist(), b["t"].tolist()) for s in sentences(t)]
            yield pd.DataFrame({"names": pd.Series([list(n) for n, _ in found], dtype=object), "s": pd.Series([s for _, s in found], dtype=object)})

    every = rows.select("names", "t").mapInPandas(run, "names array<string>, s string")
    # Written first: the limit is then taken over a shuffle, not over rows of all tasks on the driver.
    return materialise(every.orderBy(F.xxhash64("s"), "s", "names").limit(most), "sample").collect()


def assign(documents: DataFrame, areas: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", share: float = SHARE) -> DataFrame:
    """(key, subject, share): the subjects that at least `share` of a document's sentences deal with.

    The clusters are fitted on a bounded sample of labelled documents; every document is then read whole. Null, empty
    and blank texts, and texts all of whose sentences lie far from every leaf, have no row. Repeated rows give theirs
    again. Without labels the leaves are those of a sample of all documents, labelled by the words of descriptions alone. At most MOST_SUBJECTS rows of areas are taken; more are an error.
    """
    named = areas.filter("subject is not null").limit(MOST_SUBJECTS + 1).collect()
    if len(named) > MOST_SUBJECTS:
        raise ValueError(f"more than {MOST_SUBJECTS} subjects: split them")
    descriptions = {r["subject"]: r["description"] or "" for r in named}
    sample = labelled_sample(documents, labels, key, text)
    model = fit([r["s"] for r in sample], [set(r["names"]) for r in sample], descriptions)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # of fixed size: leaves x dimensions
    kind = dict(documents.dtypes)[key]

    def run(batches):
        m = shared.value
        for b in batches:
            for at, stop in slices(b[text].tolist(), 512):
                part = b.iloc[at:stop]
                s = m.shares(part[text].tolist())
                i, j = np.nonzero(s >= share * 0.98)  # a leaf's mixture is never quite one
                yield pd.DataFrame({key: part[key].to_numpy()[i], "subject": pd.Series([m.subjects[k] for k in j], dtype=object), "share": s[i, j]})

    return documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text).mapInPandas(run, f"`{key}` {kind}, subject string, share double")
