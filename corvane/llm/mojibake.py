"""Texts decoded with a wrong encoding: found and, where nothing is lost, restored by round trips."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import slices
from .lookalikes import TO_LATIN

#: Encodings a text may wrongly have been decoded with; each byte has a character in the single-byte ones.
SINGLE = ("cp1252", "latin-1", "cp1251", "cp437", "mac_roman", "cp850", "cp866", "koi8_r", "cp1250", "iso8859_15")
#: (wrong, right) pairs of two-byte encodings whose characters exchange one by one.
DOUBLE = (("big5", "gbk"), ("gbk", "big5"), ("shift_jis", "gbk"), ("euc_kr", "gbk"))
#: Traces of lost bytes (fixed values): the replacement character, and what it becomes when written as UTF-8 and read as GBK.
LOST = re.compile("\ufffd|锟斤拷|锟斤|斤拷锟|ï¿½|烫烫烫|屯屯屯")
MARKS = re.compile("锟斤|斤拷|烫烫烫|屯屯屯")
LAYERS = 4
#: Bits by which the garbling cost of a text must drop for a repair to be taken, and bits a repaired character.
LEAST_GAIN, GAIN_EACH = 6.0, 2.0
#: Share of the characters of a two-byte reading that the corpus must hold elsewhere.
SEEN = 0.6
COMMON = 1 << 16


def _byte_chars(codec: str) -> list[str]:
    out = []
    for b in range(256):
        try:
            out.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            out.append(chr(b))
    return out


class Single:
    """Runs of characters of a single-byte encoding whose bytes are valid in the intended one."""

    def __init__(self, codec: str):
        self.chars = _byte_chars(codec)
        self.byte = {c: b for b, c in enumerate(self.chars)}
        self.high = frozenset(self.chars[128:])
        self.letters = codec in ("cp1251", "cp866", "koi8_r")  # sound words of another alphabet look like its outcome
        cls = lambda a, b: "[" + "".join(re.escape(self.chars[x]) for x in range(a, b + 1)) + "]"
        tail = cls(0x80, 0xBF)
        self.utf8 = re.compile(f"(?:{cls(0xC2, 0xDF)}{tail}|{cls(0xE0, 0xEF)}{tail}{{2}}|{cls(0xF0, 0xF4)}{tail}{{3}})+")
        high, ascii_tail = "".join(re.escape(self.chars[x]) for x in range(0x81, 0xFF)), "".join(re.escape(chr(x)) for x in range(0x40, 0x7F))
        self.gbk = re.compile(f"(?:[{high}][{high}{re.escape(self.chars[0x80])}{ascii_tail}]){{2,}}")
        self.pair = re.compile(f"[{high}][{high}{re.escape(self.chars[0x80])}{ascii_tail}]")

    def back(self, part: str, codec: str) -> str | None:
        try:
            return bytes(self.byte[c] for c in part).decode(codec)
        except (UnicodeDecodeError, KeyError):
            return None


@lru_cache(maxsize=1)
def singles() -> dict[str, Single]:
    return {c: Single(c) for c in SINGLE}


@lru_cache(maxsize=None)
def exchange(wrong: str, right: str) -> np.ndarray:
    """Code point decoded by `wrong` -> code point its bytes have in `right`; 0 where there is none."""
    out = np.zeros(COMMON, np.uint32)
    for a in range(0x81, 0xFF):
        for b in (*range(0x40, 0x7F), *range(0x80, 0xFF)):
            raw = bytes((a, b))
            try:
                x, y = raw.decode(wrong), raw.decode(right)
            except UnicodeDecodeError:
                continue
            if len(x) == len(y) == 1 and 0x2000 <= ord(x) < COMMON and x != y:
                out[ord(x)] = ord(y)
    return out


UTF8_IN_GBK = re.compile(rb"(?:[\xe2-\xef][\x80-\xbf]{2}){2}(?:[\xe2-\xef][\x80-\xbf]{2}|[\xc2-\xdf][\x80-\xbf]|[\x20-\x7e](?=[\x20-\x7e]*[\xe2-\xef][\x80-\xbf]{2}))*")
PRIVATE = re.compile("[\ue000-\uf8ff\x80-\x84\x86-\x9f\ufffd]")
#: Two neighbours that are neither ASCII nor Han, kana, hangul, full-width forms or Chinese marks: what single-byte decoding leaves.
HINT = re.compile("[\x80-˿Ͱ-׿Ḁ-⿟-ﬀ-ﭏ]{2}")


#: What two- and three-byte sequences may stand for: Latin letters, usual marks and East Asian characters, or Cyrillic or Greek words.
PLAUSIBLE = re.compile("[\x00-ɏ̀-ͯ‐-›€℀-↏∀-⋿①-⓿■-◿⺀-鿿가-힯豈-﫿＀-￯\U00020000-\U0003ffff]+|[\x00-\x7fЀ-џ -⁯]{3,}|[\x00-\x7fͰ-Ͽ -⁯]{3,}")
#: The Han character that GBK shows for the two UTF-8 bytes of an accented Latin letter -> the letter.
ACCENTS = {h: chr(p) for p in range(0xC0, 0x180) if chr(p).isalpha() and len(h := chr(p).encode().decode("gbk", "ignore")) == 1}
ACCENT_IN_GBK = re.compile(f"(?<=[A-Za-z])[{''.join(ACCENTS)}](?=[A-Za-z])|(?<![^\\x00-\\x7f])[{''.join(ACCENTS)}](?=[a-z])")


class Repair:
    """Costs are bits: -log2 of a character's share of the corpus."""

    def __init__(self, counts: dict[int, int]):
        table = np.zeros(COMMON, np.float64)
        for point, n in counts.items():
            if point < COMMON:
                table[point] = n
        total = max(table.sum(), 1.0)
        self.bits = -np.log2((table + 0.5) / (total + 0.5 * COMMON))
        self.unseen = float(self.bits.max()) - 0.5
        odd = [p for p in range(0x80, 0xA0)] + list(range(0xE000, 0xF900)) + [0xFFFD]
        self.bits[odd] = self.bits.max() + 4
        self.each = self.bits.tolist()
        self.gains = {}
        for wrong, right in DOUBLE:
            to = exchange(wrong, right)
            gain = np.full(COMMON, -40.0)
            gain[to > 0] = self.bits[to > 0] - self.bits[to[to > 0]]
            gain[:128] = 0.0
            self.gains[wrong, right] = gain.astype(np.float32), to
        self.memo: dict[str, tuple[bool, str]] = {}

    def cost(self, text: str) -> float:
        try:
            return sum(map(self.each.__getitem__, map(ord, text)))
        except IndexError:
            return sum(self.each[min(p, 0xFFFD)] for p in map(ord, text))

    def seen(self, text: str) -> bool:
        high = [c for c in text if c > "\x7f"]
        return sum(self.each[min(ord(c), 0xFFFD)] < self.unseen for c in high) >= SEEN * len(high)

    def better(self, old: str, new: str | None) -> float:
        """Gain of a replacement, 0 where it isn't taken."""
        if not new or PRIVATE.search(new):
            return 0.0
        gain = self.cost(old) - self.cost(new)
        return gain if gain >= max(LEAST_GAIN, GAIN_EACH * sum(c > "\x7f" for c in new)) else 0.0

    def _single(self, text: str):
        odd = {c for c in text if c > "\x7f" and ord(c) < COMMON and hints()[ord(c)]}
        for codec in singles().values():
            if len(odd & codec.high) < 0.35 * len(odd):
                continue
            for pattern, right in ((codec.utf8, "utf-8"), (codec.gbk, "gbk")):
                gained, sure, taken, weak = 0.0, 0, [], []
                for m in pattern.finditer(text):
                    if all(c in TO_LATIN for c in m.group() if c > "\x7f"):
                        continue  # letters chosen for their looks
                    new = codec.back(m.group(), right)
                    for _ in range(LAYERS):  # control characters inside are a deeper layer of the same kind
                        if not new or right != "utf-8" or not PRIVATE.search(new):
                            break
                        deeper = codec.utf8.sub(lambda x: codec.back(x.group(), "utf-8") or x.group(), new)
                        if deeper == new:
                            break
                        new = deeper
                    fits = bool(new) and not PRIVATE.search(new) and (right != "utf-8" or bool(PLAUSIBLE.fullmatch(new)))
                    gain = self.better(m.group(), new) if fits else 0.0
                    if not gain and fits and self.cost(m.group()) > self.cost(new):
                        weak.append(m)
                    if (right == "gbk" or codec.letters) and gain and not self.seen(new):
                        gain = 0.0
                    if right == "gbk" and gain and not all("\u3000" <= c <= "\u9fff" or c <= "~" or "\uff00" <= c <= "\uffef" or c in "℃°—–·≥≤“”‘’…ⅠⅡⅢ×" for c in new):
                        gain = 0.0
                        weak = [w for w in weak if w is not m]
                    if gain:
                        gained += gain
                        sure += m.end() - m.start()
                        taken.append((m, new))
                if not gained:
                    continue
                # Where most of a text was surely read so, its stretches too short to tell alone were too.
                unsure = sum(m.end() - m.start() for m in weak)
                if sure >= 2 * unsure:
                    taken += [(m, new) for m in weak if (new := codec.back(m.group(), right))]
                parts, at = [], 0
                for m, new in sorted(taken, key=lambda x: x[0].start()):
                    parts += [text[at : m.start()], new]
                    at = m.end()
                now = "".join(parts) + text[at:]
                if right == "gbk":
                    now = codec.pair.sub(lambda m: self._pair(codec, m.group(), sure), now)
                yield gained, now

    def _pair(self, codec, pair: str, sure: int) -> str:
        """A pair that stands alone, restored where enough of the text around was and the corpus knows the outcome."""
        new = codec.back(pair, "gbk") if sure >= 8 and all(c > "\x7f" for c in pair) else None
        return new if new and len(new) == 1 and self.seen(new) and self.cost(new) < self.cost(pair) else pair

    def _utf8_as_gbk(self, text: str):
        raw = text.encode("gb18030", "replace")
        if not UTF8_IN_GBK.search(raw):
            return
        ends, at = {0: 0}, 0
        for i, c in enumerate(text):
            at += len(c.encode("gb18030", "replace"))
            ends[at] = i + 1
        gained, parts, done = 0.0, [], 0
        for m in UTF8_IN_GBK.finditer(raw):
            a, b = m.start(), m.end()
            while a < b and (a not in ends or raw[a] < 0x80):
                a += 1
            while b > a and b not in ends:
                b -= 1
            best = (0.0, "", 0, 0)
            for x in range(a, min(a + 6, b)):
                if x not in ends:
                    continue
                for y in range(b, max(b - 6, x), -1):
                    if y not in ends:
                        continue
                    try:
                        new = raw[x:y].decode("utf-8")
                    except UnicodeDecodeError:
                        continue
                    old = text[ends[x] : ends[y]]
                    gain = self.better(old, new) if sum(c > "\x7f" for c in new) >= 2 else 0.0
                    best = max(best, (gain, new, ends[x], ends[y]))
                    break
            if best[0]:
                gained += best[0]
                parts += [text[done : best[2]], best[1]]
                done = best[3]
        if gained:
            yield gained, "".join(parts) + text[done:]

    def _latin_as_gbk(self, text: str):
        """Accented Latin letters inside words that were read as one Han character each."""
        new = ACCENT_IN_GBK.sub(lambda m: ACCENTS[m.group()], text)
        if new != text and (gain := self.cost(text) - self.cost(new)) > 0:
            yield gain, new

    def _double(self, text: str, points: np.ndarray):
        low = np.minimum(points, COMMON - 1)
        for (wrong, right), (gain, to) in self.gains.items():
            g = gain[low]
            if g.max(initial=0) < GAIN_EACH or np.maximum(g, 0).sum() < 4 * LEAST_GAIN:
                continue
            total = np.concatenate(([0.0], np.cumsum(g, dtype=np.float64)))
            floor = np.minimum.accumulate(total)
            end = int(np.argmax(total - floor))
            start = int(np.argmin(total[: end + 1]))
            part = points[start:end]
            swapped = part >= 128
            n = int(swapped.sum())
            if n >= 3 and total[end] - total[start] >= max(4 * LEAST_GAIN, 2.5 * n):
                new = np.where(swapped, to[np.minimum(part, COMMON - 1)], part)
                yield float(total[end] - total[start]), text[:start] + "".join(map(chr, new)) + text[end:]

    def fix(self, text: str) -> tuple[bool, str]:
        """(garbled, text as far as it can be restored)."""
        if text.isascii():
            return False, text
        garbled, now = bool(LOST.search(text)), text
        for _ in range(LAYERS):
            options = list(self._single(now)) if HINT.search(now) else []
            if not options:
                options += self._latin_as_gbk(now)
                options += self._utf8_as_gbk(now)
                options += self._double(now, np.frombuffer(now.encode("utf-32-le", "surrogatepass"), np.uint32))
            if not options:
                break
            garbled, now = True, max(options)[1]
        return garbled, now

    def suspects(self, texts: list[str]) -> list[int]:
        """Indexes of the texts that fix() can change or flag; all others are settled here, a batch at once."""
        texts = [t if not t.isascii() else "" for t in texts]
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        filled = np.flatnonzero(lengths)
        if not len(filled):
            return []
        whole = "".join(texts)
        points = np.minimum(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32), COMMON - 1)
        ends = np.cumsum(lengths)
        starts = (ends - lengths)[filled]
        hit = np.zeros(len(texts), bool)
        odd = hints()[points]
        for at in (np.flatnonzero(odd[1:] & odd[:-1]) + 1, np.flatnonzero(points == 0xFFFD)):
            hit[np.searchsorted(ends, at, "right")] = True
        spaced, marks = np.insert(points, starts, 0), starts + np.arange(len(starts))
        for gain, _ in self.gains.values():
            # _double's own best stretch of each text; the mark before a text costs more than all texts gain
            g = gain[spaced].astype(np.float64)
            g[marks] = -1.0 - np.maximum(g, 0).sum()
            total = np.cumsum(g)
            pays = np.flatnonzero(total - np.minimum.accumulate(total) >= 4 * LEAST_GAIN - 0.01)
            hit[filled[np.searchsorted(marks, pays, "right") - 1]] = True
        for pattern in (MARKS, ACCENT_IN_GBK):
            for m in pattern.finditer(whole):
                hit[np.searchsorted(ends, m.start(), "right")] = True
        raws = [t.encode("gb18030", "replace") for t in texts]
        stops = np.cumsum(np.fromiter(map(len, raws), np.int64, len(raws)) + 1)
        for m in UTF8_IN_GBK.finditer(b"\n".join(raws)):
            hit[np.searchsorted(stops, m.start(), "right")] = True
        return np.flatnonzero(hit).tolist()

    def cached(self, text: str) -> tuple[bool, str]:
        if len(text) > 300:
            return self.fix(text)
        got = self.memo.get(text)
        if got is None:
            if len(self.memo) > 50_000:
                self.memo.clear()
            got = self.memo[text] = self.fix(text)
        return got


@lru_cache(maxsize=1)
def hints() -> np.ndarray:
    """1 for code points that HINT's class holds."""
    return np.array([0 if 0xD800 <= p < 0xE000 else int(bool(HINT.match(chr(p) * 2))) for p in range(COMMON)], np.int8)


def character_counts(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(point, n) over all rows; at most a row for each code point."""

    def run(batches):
        for b in batches:
            n = np.zeros(0x110000, np.int64)
            for f in fields:
                texts = b[f].tolist()
                for at, stop in slices(texts):
                    whole = "".join(t for t in texts[at:stop] if t)
                    seen = np.bincount(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
                    n[: len(seen)] += seen
            points = np.flatnonzero(n)
            yield pd.DataFrame({"point": points.astype(np.int32), "n": n[points]})

    return df.select(*fields).mapInPandas(run, "point int, n long").groupBy("point").agg(F.sum("n").alias("n"))


_REPAIR: dict = {}


def repaired(df: DataFrame, key: str = "block_id", fields: tuple[str, ...] = ("text", "source")) -> DataFrame:
    """(key, field, original, restored, whole): each field that was, in whole or in part, decoded wrongly.

    restored is the text after up to four layers of wrong decoding are undone; whole is false where bytes were lost, so
    that part stays garbled. A repair is taken when strict decoding works and the garbling cost, measured with the
    characters of the whole corpus, drops. Null and empty fields and rows without a key give no row; repeated rows are each looked at. Names
    with accents are left alone.
    """
    counts = {r["point"]: r["n"] for r in character_counts(df, fields).collect()}  # bounded by Unicode
    shared = df.sparkSession.sparkContext.broadcast(counts)
    token = hash(tuple(sorted(counts.items())))
    kind = dict(df.dtypes)[key]

    def run(batches):
        repair = _REPAIR.get(token)
        if repair is None:
            _REPAIR.clear()
            repair = _REPAIR[token] = Repair(shared.value)
        for b in batches:
            out = []
            keys = b[key].tolist()
            for f in fields:
                texts = [t or "" for t in b[f].tolist()]
                for at, stop in slices(texts):
                    for i in repair.suspects(texts[at:stop]):
                        garbled, now = repair.cached(texts[at + i])
                        if garbled:
                            out.append((keys[at + i], f, texts[at + i], now, not LOST.search(now)))
            yield pd.DataFrame(out, columns=[key, "field", "original", "restored", "whole"])

    return df.filter(F.col(key).isNotNull()).select(key, *fields).mapInPandas(run, f"`{key}` {kind}, field string, original string, restored string, whole boolean")
