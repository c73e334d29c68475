"""Evaluation passages inside training text, by pigeonhole pieces and bit-parallel verification."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Shortest shared run, in counted characters, by the item's language.
RUN_HAN, RUN_LATIN = 30, 80
#: Edits that the search step tolerates in a run; the final step asks for the exact run.
BUDGET = 1
#: Items sent to every task at once; more are taken in several passes over the documents.
MOST_ITEMS = 50_000
#: Edits that near_leaks tolerates in a run.
NEAR_BUDGET = 2


def _counted(ch: str) -> str:
    if ch.isalnum():
        return ch
    return ""


class _Fold(dict):
    """Code point -> its folded letters and digits; filled as characters appear."""

    def __missing__(self, point: int):
        folded = unicodedata.normalize("NFKC", chr(point)).casefold()
        folded = unicodedata.normalize("NFKC", folded)
        self[point] = out = "".join(map(_counted, folded)) or None
        return out


FOLD = _Fold()


def fold(text: str | None) -> str:
    """Letters, digits and Han characters only, without case and width."""
    if not text:
        return ""
    if not text.isascii() and not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    return text.translate(FOLD)


def is_han(text: str) -> bool:
    return any("㐀" <= c <= "鿿" for c in text)


def pieces(text: str, run: int, budget: int = BUDGET) -> list[tuple[str, int]]:
    """Adjoining pieces of an item such that every run of `run` characters holds budget + 1 of them whole, with their places.

    A run with at most `budget` edits then keeps one of them unchanged.
    """
    size = max(1, (run + 1) // (budget + 2))
    while size > 1 and run < (budget + 2) * size - 1:
        size -= 1
    return [(text[k : k + size], k) for k in range(0, len(text) - size + 1, size)] if len(text) >= run else []


def distance(pattern: str, text: str, most: int) -> int | None:
    """Fewest edits between pattern and some substring of text, None if more than `most`: Myers' bit-parallel scan."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = most + 1
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((x & plus) + plus) ^ plus) | x
        ph = minus | ~(d | plus) & full
        mh = plus & d
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = (ph << 1) & full, (mh << 1) & full
        plus, minus = mh | ~(d | ph) & full, ph & d
        if score < best:
            best = score
            if not best:
                break
    return best if best <= most else None


def stretch(item: str, at: int, text: str, pos: int, size: int) -> tuple[int, int]:
    """Bounds in the item of the common stretch through item[at:at+size] == text[pos:pos+size]."""
    a, b = at, pos
    while a and b and item[a - 1] == text[b - 1]:
        a, b = a - 1, b - 1
    c, d, m, n = at + size, pos + size, len(item), len(text)
    while c < m and d < n and item[c] == text[d]:
        c, d = c + 1, d + 1
    return a, c


def past_edit(item: str, text: str, left: int, right: int, shift: int) -> int:
    """Most item characters that one edit beyond either end of a common stretch adds to it, the edited one included."""
    best = 0
    for i, j in ((1, 1), (1, 0), (0, 1)):
        a, b = left - i, left + shift - j
        n = i
        while a > 0 and b > 0 and item[a - 1] == text[b - 1]:
            a, b, n = a - 1, b - 1, n + 1
        c, d = right + i, right + shift + j
        m = i
        while c < len(item) and d < len(text) and item[c] == text[d]:
            c, d, m = c + 1, d + 1, m + 1
        best = max(best, n, m)
    return best


@lru_cache(maxsize=None)
def least_stretch(run: int, size: int, budget: int) -> int:
    """Shortest unedited stretch around some whole piece of a run with at most `budget` edits, wherever pieces and edits lie."""
    if budget > 1:
        return size
    worst = run
    for offset in range(size):
        starts = range(offset, run - size + 1, size)
        for edit in range(run) if budget else ():
            worst = min(worst, max((run - edit - 1 if p > edit else edit) for p in starts if not p <= edit < p + size))
    return worst


class Index:
    """Automaton of all items' pieces."""

    def __init__(self, items: list[tuple[int, str]], budget: int):
        import ahocorasick

        self.budget, self.texts, where = budget, [], {}
        for key, raw in items:
            text = fold(raw)
            run = RUN_HAN if is_han(text) else RUN_LATIN
            for piece, at in pieces(text, run, budget):
                where.setdefault(piece, []).append((len(self.texts), at))
            size = len(next(iter(pieces(text, run, budget)), ('',))[0])
            self.texts.append((key, text, run, least_stretch(run, size, budget) if size else run))
        self.automaton = ahocorasick.Automaton()
        for piece, places in where.items():
            self.automaton.add_word(piece, (len(piece), places))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def leaked(self, raw: str | None) -> set:
        text = fold(raw)
        found: set = set()
        if self.empty or not text:
            return found
        done: set = set()
        for end, (size, places) in self.automaton.iter(text):
            pos = end - size + 1
            for k, at in places:
                key, item, run, least = self.texts[k]
                if key in found:
                    continue
                left, right = stretch(item, at, text, pos, size)
                if right - left < least or (k, left, pos - at) in done:
                    continue
                if self.budget <= 1 and right - left < run and right - left + (self.budget and past_edit(item, text, left, right, pos - at)) < run:
                    continue
                done.add((k, left, pos - at))  # other pieces of this stretch lead to the same windows
                if self._near(item, at, text, pos, size, run) and right - left >= run:
                    found.add(key)
        return found

    def _near(self, item: str, at: int, text: str, pos: int, size: int, run: int) -> bool:
        """Whether a run of the item that holds the piece occurs in the text around the hit within the budget."""
        for a in range(max(0, at + size - run), min(at, len(item) - run) + 1):
            b = max(0, pos - (at - a) - self.budget)
            if distance(item[a : a + run], text[b : pos - (at - a) + run + self.budget], self.budget) is not None:
                return True
        return False

    def near(self, raw: str | None) -> dict:
        """Item -> fewest edits between a run of it and the text, at most the budget."""
        text = fold(raw)
        found: dict = {}
        if self.empty or not text:
            return found
        done: set = set()
        for end, (size, places) in self.automaton.iter(text):
            pos = end - size + 1
            for k, at in places:
                key, item, run, _ = self.texts[k]
                if found.get(key) == 0 or (k, at, pos) in done:
                    continue
                left, right = stretch(item, at, text, pos, size)
                # Pieces within one common stretch have the same windows but for their place in them.
                done.update((k, p, pos - at + p) for p in range(at, right - size + 1, size))
                edits = 0 if right - left >= run else self._edits(item, left, right, text, left + pos - at, run, found.get(key, self.budget + 1) - 1)
                if edits is not None:
                    found[key] = edits
        return found

    def _edits(self, item: str, left: int, right: int, text: str, start: int, run: int, most: int) -> int | None:
        """Fewest edits, at most `most`, of a run of the item that holds item[left:right], found at text[start:]."""
        best, q = None, 3
        near = text[max(0, start - run - most) : start + run + right - left + most]
        grams = {near[i : i + q] for i in range(len(near) - q + 1)}
        shared = [0]
        first, last = max(0, right - run), min(left, len(item) - run)
        for i in range(first, max(first, last + run - q + 1)):
            shared.append(shared[-1] + (item[i : i + q] in grams))
        for a in range(first, last + 1):
            if most < 0:
                break
            # An edit spoils at most q grams of the window.
            if shared[a - first + run - q + 1] - shared[a - first] < run - q + 1 - q * most:
                continue
            at = start - (left - a)
            edits = distance(item[a : a + run], text[max(0, at - most) : at + run + most], most)
            if edits is not None:
                best, most = edits, edits - 1
        return best


_INDEX: dict = {}


def _passes(documents: DataFrame, items: DataFrame, key: str, text: str, item_key: str, passages: tuple[str, ...], budget: int, most: int, schema: str, find) -> DataFrame:
    """Documents mapped against all items, at most about `most` of them sent to every task in one pass."""
    distinct = items.filter(F.col(item_key).isNotNull()).select(item_key, *passages).distinct()
    n = distinct.count()
    parts = 1 if n <= most else -(-2 * n // most)
    source = documents.filter(F.col(text).isNotNull() & F.col(key).isNotNull()).select(key, text)
    out = None
    for part in range(parts):
        held_out = distinct.filter(F.pmod(F.xxhash64(item_key, *passages), F.lit(parts)) == part).collect()  # bounded: a hashed share
        rows = [(r[0], p) for r in held_out for p in r[1:] if p]
        token = hash((tuple(rows), budget))
        shared = documents.sparkSession.sparkContext.broadcast(rows)

        def run(batches, shared=shared, token=token):
            index = _INDEX.get(token)
            if index is None:
                _INDEX.clear()
                index = _INDEX[token] = Index(shared.value, budget)
            for batch in batches:
                yield find(index, batch[key].tolist(), batch[text].tolist())

        found = source.mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passages: tuple[str, ...] = ("question", "answer"), budget: int = BUDGET, most: int = MOST_ITEMS) -> DataFrame:
    """(key, item_key): each document that shares a run with a passage of an item, once for each such item.

    A run has 30 counted characters for items with Han characters and 80 for others; letters, digits and Han characters
    count, case and width do not. Null and shorter passages match nothing; items without a key are left out. Up to
    `most` items go to every task and documents are read once, whole, and never shuffled; more items are taken in hashed
    shares, with a pass over the documents for each. Repeated documents of one key give a row once per text.
    """
    kinds = dict(documents.dtypes) | dict(items.dtypes)

    def find(index, keys, texts):
        rows = [(k, item) for k, t in zip(keys, texts) for item in sorted(index.leaked(t))]
        return pd.DataFrame(rows, columns=[key, item_key])

    found = _passes(documents, items, key, text, item_key, passages, budget, most, f"`{key}` {kinds[key]}, `{item_key}` {kinds[item_key]}", find)
    return found


def near_leaks(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", passages: tuple[str, ...] = ("question", "answer"), budget: int = NEAR_BUDGET, most: int = MOST_ITEMS) -> DataFrame:
    """(key, item_key, edits): as leaks(), but a run may differ by up to `budget` edits; edits is the fewest of any run.

    Every run with that few edits keeps one of its budget + 1 pieces, which the search finds; Myers' scan decides.
    """
    kinds = dict(documents.dtypes) | dict(items.dtypes)

    def find(index, keys, texts):
        rows = [(k, item, e) for k, t in zip(keys, texts) for item, e in sorted(index.near(t).items())]
        return pd.DataFrame(rows, columns=[key, item_key, "edits"]).astype({"edits": "int32"})

    return _passes(documents, items, key, text, item_key, passages, budget, most, f"`{key}` {kinds[key]}, `{item_key}` {kinds[item_key]}, edits int", find)
