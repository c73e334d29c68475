"""Defective replies in query and answer pairs."""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..tables import materialise

# What counts as an empty answer, a refusal, a courtesy or a wrapper of an echoed question.
NULL_WORDS = {"null", "none", "na", "nan", "nil", "undefined", "空", "空值", "无", "暂无", "nodata", "todo", "tbd"}
LABELS = r"(?:答案|回答|回复|答复|答|answer|reply|response|output|assistant|a)"
WRAPPERS = {"", "问", "问题", "提问", "您的问题是", "你的问题是", "您想了解的是", "你想了解的是", "您问的是", "你问的是", "您是问", "您是想问", "关于", "q", "question", "query", "youasked", "yourquestionis", "yourquestionwas", "youaskedabout", "youwanttoknow", "youwouldliketoknow", "regarding"}
TAILS = {"", "对吗", "是吗", "对吧", "是这样吗", "是这个问题吗", "right", "isthatso", "isthatright", "correct", "isthatyourquestion", "吗", "呢"}
REFUSAL_HAN = re.compile(
    r"无法(?:回答|作答|提供|给出|确定|判断|答复|处理|帮)|不能(?:作答|回答|提供|答复|给出)|难以(?:给出|回答|作答|提供)|恕难|恕不|不便(?:对此|回答|作答|给出|发表|答复|提供)|帮不上|不作回答|不予(?:回答|作答)|超出了?.{0,12}(?:范围|覆盖|内容)|与问题无关|没有(?:涉及|相关|找到|检索|足够)|未(?:检索|找到|涉及|包含|收录|覆盖)|不掌握|暂不(?:能|便)|拒绝|不清楚|不知道|不了解|没有?办法(?:提供|回答|给出|作答)|查不到|找不到|答不上|回答不了|给不出|提供不了|不在.{0,10}范围|爱莫能助|作为.{0,8}(?:助手|模型|人工智能)"
)
REFUSAL_LATIN = re.compile(
    r"\b(?:can ?not|can't|cannot|unable to|not able to|won't|will not|decline to|refuse to|must decline|am not in a position)\b.{0,40}\b(?:answer|help|respond|comment|assist|provide|say|give|reply|address|tell|determine|speak|do that)"
    r"|(?:don't|do not) have (?:enough|sufficient|any|the)|outside (?:the|my|our)|beyond (?:the|my|our)|not (?:covered|related|relevant|in the|contain|enough)|no (?:relevant|related|information|data|material)|unrelated to|have no (?:information|data|material|answer)|nothing (?:about|on|relevant)|no way (?:of|to)\b|not possible (?:for me )?to (?:answer|say|tell|help|respond)|insufficient (?:information|data)|not qualified|as an? (?:ai|assistant|language model)",
    re.I,
)
#: Each form of the above has one of these.
REFUSAL_STEMS = ("not", "n't", "no ", "unable", "declin", "refuse", "outside", "beyond", "unrelated", "nothing", "insufficient", "as a")
COURTESY = re.compile(
    r"^(?:(?:关于)?[“\"「].*[”\"」]|很|非常|十分|真|您好|你好|抱歉|对不起|不好意思|遗憾|请见谅|谅解|建议您?|咨询|请|补充|资料|后再试|换一种|问法|如有|其他|问题|欢迎|继续|提问|当地|气象|部门|联系|专家|查阅|我们?|再|[\s，,。.！!；;：:、])+$"
    r"|^(?:(?:i'?m|i am|we are|very|so|terribly)?\s*(?:sorry|apolog\w*|regret\w*|unfortunately|afraid)|my apologies|hello|hi|dear user|please\b.*|thank\w*.*|feel free.*|you (?:may|might|could|can)\b.*|try (?:re|another|asking)\w*.*|let me know.*|if you have .*|is there anything.*)[\s,.:;!?–-]*(?:about (?:this|that)|for (?:the|any) (?:delay|inconvenience|wait))?[\s,.:;!?]*$",
    re.I,
)
QUOTED = re.compile(r"(?:关于|对于|针对|regarding|about|as to)\s*[“\"「『][^”\"」』]{2,200}[”\"」』][，,]?", re.I)
ENGLISH = {"the", "of", "and", "to", "in", "is", "was", "for", "at", "by", "on", "with", "as", "are", "were", "from", "that", "this", "it", "be", "has", "have", "not", "after", "before", "than", "near", "its", "an", "or", "per", "yes", "no"}
OTHER_LATIN = {
    "fr": {"le", "la", "les", "des", "du", "et", "en", "est", "dans", "une", "un", "pour", "sur", "avec", "cette", "ce", "se", "pas", "mal", "plus", "au", "aux", "il", "qui"},
    "de": {"der", "die", "das", "und", "ist", "nicht", "ein", "eine", "im", "in", "den", "dem", "des", "mit", "sich", "nur", "für", "auf", "von", "zu", "vor", "bis", "wird", "werden", "fallen"},
    "es": {"el", "la", "los", "las", "de", "del", "y", "en", "es", "para", "con", "una", "un", "que", "se", "por", "este", "esta", "poco", "al", "más", "muy"},
    "it": {"il", "lo", "la", "gli", "le", "di", "del", "della", "e", "è", "in", "per", "con", "una", "un", "che", "si", "non", "questa", "questo"},
    "pt": {"o", "a", "os", "as", "de", "do", "da", "e", "em", "é", "para", "com", "uma", "um", "que", "se", "não", "esta", "este", "na", "no"},
}
WORD_LANGUAGES = {w: tuple(k for k, v in {"en": ENGLISH, **OTHER_LATIN}.items() if w in v) for w in ENGLISH.union(*OTHER_LATIN.values())}
ASKS = {
    "en": re.compile(r"英文|英语|\bin english\b|into english", re.I),
    "zh": re.compile(r"中文|汉语|\b(?:in|into) (?:chinese|mandarin)\b", re.I),
    "ja": re.compile(r"日文|日语|\b(?:in|into) japanese\b", re.I),
    "ko": re.compile(r"韩文|韩语|朝鲜语|\b(?:in|into) korean\b", re.I),
    "fr": re.compile(r"法文|法语|\b(?:in|into) french\b", re.I),
    "de": re.compile(r"德文|德语|\b(?:in|into) german\b", re.I),
    "es": re.compile(r"西班牙[文语]|\b(?:in|into) spanish\b", re.I),
    "ru": re.compile(r"俄文|俄语|\b(?:in|into) russian\b", re.I),
}
CITED = re.compile(r"(?:\[[^\[\]\n]{1,20}\]|【[^【】\n]{1,20}】|（(?:来源|见|参见|出处|据|源)[^（）\n]{0,30}）|\((?:see|source|cf\.?|from|ref)[^()\n]{0,40}\)|\[\^?\d+\])\s*$", re.I)
CLOSERS = "”’\"'」』》）)]】}*_~` \t\r\n"
VALUE = re.compile(r"^(?:约|大约|大概|接近|近|超过|不足|about|around|roughly|approximately|nearly|over|some)?\s*[-+−]?\d[\d,.]*(?:\s*[-–—~～至到]\s*\d[\d,.]*)?\s*(?:[%％℃°‰]\w?|[^\W\d_]{0,6}(?:[²³/·]\w{0,4})?)$", re.I)
PAIRS = {"（": "）", "(": ")", "[": "]", "【": "】", "《": "》", "“": "”", "「": "」", "『": "』", "{": "}"}

#: Longest answer without end mark that may be a bare value or word.
WORD_CHARS = 8
#: A length is a limit where that many answers end there unfinished, and so many times the usual number of answers.
SPIKE_ROWS, SPIKE_TIMES = 5, 4.0


NO_WORD = re.compile(r"[\W_]+")
#: Enough letters that what a label, a null word or markup leaves is no empty answer; texts with markup are looked at in full.
FULL = re.compile(r"(?:[0-9A-Za-z一-鿿][^0-9A-Za-z一-鿿]*){24}")
MARKUP = re.compile(r"[<&]|```|---")
LATIN, HAN = re.compile("[A-Za-zÀ-ɏ]"), re.compile("[㐀-鿿]+")
#: Everything but letters of other scripts than Han and Latin.
USUAL = re.compile("[\x00-ɏ㐀-鿿\u2000-\u2bff\u3000-\u303f\uff00-\uff65\uffe0-\uffef]+")
FORMAT = re.compile("[" + "".join(chr(c) for c in (*range(0x12000), *range(0xE0000, 0xE0080)) if unicodedata.category(chr(c)) == "Cf") + "]")


def bare(text: str) -> str:
    """Letters and digits without width and case."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return NO_WORD.sub("", text.casefold())


def declines(text: str) -> bool:
    if not text.isascii() and REFUSAL_HAN.search(text):
        return True
    low = text.lower()
    return any(x in low for x in REFUSAL_STEMS) and bool(REFUSAL_LATIN.search(text))


def is_empty(answer: str | None) -> bool:
    if answer is None:
        return True
    if FULL.search(answer) and not MARKUP.search(answer):
        return False
    text = unicodedata.normalize("NFKC", answer)
    text = re.sub(r"<!--.*?-->|<[^<>]*>|&nbsp;|&#?\w{1,8};", "", text, flags=re.S)
    text = "".join(c for c in text if unicodedata.category(c) not in ("Cf", "Cc", "Cn", "Co") or c in "\n\t").strip()
    text = re.sub(rf"^[\W_]*{LABELS}\s*[:：]+", "", text, flags=re.I)
    text = re.sub(r"^```\w*|^---\w*", "", text)
    core = bare(text)
    return not core or core in NULL_WORDS


def is_echo(query: str, answer: str) -> bool:
    q, a = bare(query), bare(re.sub(r"<[^<>]*>", "", answer) if "<" in answer else answer)
    if not q or len(a) > 3 * len(q) + 40 or q not in a:
        return False
    lead, _, tail = a.partition(q)
    while tail.startswith(q):
        tail = tail[len(q) :]
    return lead in WRAPPERS and tail in TAILS


def sentences(text: str) -> list[str]:
    return [s for s in (x.strip() for x in re.split(r"(?<=[。！？!?\n])\s*|(?<=\.)\s+", text)) if bare(s)]


def is_refusal(query: str, answer: str) -> bool:
    """Declines somewhere, and no sentence beyond courtesies and the question answers."""
    q = query.strip()
    text = QUOTED.sub("", answer.replace(q, "") if q else answer)
    if not declines(text):
        return False
    while (m := CITED.search(text.rstrip())) and m.start():
        text = text[: m.start()]
    declined = False
    for s in sentences(text):
        if declines(s):
            m = re.search(r"但是?|不过|however|\bbut\b(?! i (?:do|can|am|don|cannot|could))", s, re.I)
            after = s[m.end() :] if m else ""
            if after and not declines(after) and not COURTESY.match(after) and len(bare(after)) > 6 or re.search(r"\d", re.sub(r"[\[【(（].*?[\]】)）]", "", s)):
                return False
            declined = True
        elif not COURTESY.match(s) and bare(s) not in bare(q):
            return False
    return declined


def language(text: str) -> str | None:
    """Language by script, for Latin letters by function words; None where it can't be told."""
    text = re.sub(r"[\[【][^\[\]【】]{0,20}[\]】]", "", text)
    han = kana = hangul = cyrillic = other = 0
    if not text.isascii():
        han = len(text) - len(HAN.sub("", text))
        if rest := USUAL.sub("", text):
            kana, hangul, cyrillic = (len(re.findall(p, rest)) for p in (r"[぀-ヿ]", r"[가-힯]", r"[Ѐ-ӿ]"))
            other = len(re.findall(r"[֐-ۿऀ-๿Ͱ-Ͽ]", rest))
    words = re.findall(r"[^\W\d_]+", re.sub(r"[㐀-鿿぀-ヿ가-힯]+", " ", text.lower())) if LATIN.search(text) else []
    latin = sum(map(len, words if text.isascii() else (w for w in words if w[0] < "ɐ")))
    if kana and kana * 4 >= han:
        return "ja"
    best = max((hangul * 3, "ko"), (cyrillic, "ru"), (han * 3, "zh"), (latin, "latin"), (other, "other"))
    if not best[0]:
        return None
    if best[1] != "latin":
        return best[1]
    if len(words) < 4:
        return None
    hits = dict.fromkeys(("en", *OTHER_LATIN), 0)
    for w in words:
        for k in WORD_LANGUAGES.get(w, ()):
            hits[k] += 1
    accents = 0 if text.isascii() else sum(not w.isascii() for w in words)
    top = max(hits, key=lambda k: (hits[k] + (k != "en") * min(accents, 3) * 0.5, k == "en"))
    return top if hits[top] else "en"


def is_wrong_language(query: str, answer: str) -> bool:
    a = language(answer)
    if a is None:
        return False
    asked = {k for k, p in ASKS.items() if p.search(query)}
    if asked:
        return a not in asked
    q = language(query) or ("zh" if re.search(r"[㐀-鿿]", query) else "en" if re.search(r"[A-Za-z]{2}", query) else None)
    return q is not None and a != q


def open_bracket(text: str) -> bool:
    stack: list[str] = []
    for c in text:
        if c in PAIRS:
            stack.append(PAIRS[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return bool(stack)


def unfinished(answer: str) -> str:
    """`no`, `yes`, or `maybe` where the end is a mark that a cut could leave too."""
    text = (answer if answer.isascii() else FORMAT.sub("", answer)).strip()
    lines = [x.strip() for x in text.split("\n") if x.strip()]
    last = lines[-1] if lines else ""
    if last.startswith("|"):
        rows = [x for x in lines if x.startswith("|")]
        return "no" if last.endswith("|") and len(last) > 1 and last.count("|") >= max(x.count("|") for x in rows) else "yes"
    if text.count("```") % 2:
        return "yes"
    if CITED.search(text):
        return "no"
    if open_bracket(last):
        return "yes"
    core = text.rstrip(CLOSERS) or text
    end = core[-1:]
    if end in "…—–-，,、：:" or core.endswith("..."):
        return "yes"
    if re.search(r"(?:^|\n)\s*(?:\d{1,3}[.、．)）]|[-*•])\s*$", text):
        return "yes"
    if end in "。！？!?；;":
        return "no"
    if end == ".":
        if re.search(r"[㐀-鿿]", last) and re.search(r"\d\.$", core):
            return "yes"
        return "maybe" if re.search(r"\d\.$|\b(?:no|fig|cf|approx|vs|e\.g|i\.e|st|dr|mr)\.$", core, re.I) else "no"
    if re.search(r"[。！？!?；;]|\.\s|[，,：:、]", core):
        return "yes"
    if VALUE.match(core) or len(core) <= WORD_CHARS or re.fullmatch(r"[A-Za-z]+(?: [A-Za-z]+){0,2}", core) and len(core) <= 24:
        return "no"
    return "yes"


def shortened(answers: DataFrame, text: str) -> DataFrame:
    """(text, rest): distinct texts that are a proper prefix of another, with the start of what it goes on with.

    In sorted order a text's first extension follows it at once, so neighbours suffice. Texts are range partitioned,
    each range is read in order, and the first text of each later range is joined to the last one before it.
    """
    distinct = answers.select(F.col(text).alias("t")).filter(F.length("t") > 0).distinct()
    ranged = materialise(distinct.repartitionByRange(F.col("t")).sortWithinPartitions("t").withColumn("p", F.spark_partition_id()), "sorted")
    follow = F.lead("t").over(Window.partitionBy("p").orderBy("t"))
    inside = ranged.withColumn("next", follow)
    firsts = ranged.groupBy("p").agg(F.min("t").alias("head"))  # a row for each range
    heads = firsts.withColumn("before", F.lag("p").over(Window.orderBy("p")))
    joined = inside.join(heads.select(F.col("before").alias("p"), "head"), "p", "left").withColumn("next", F.coalesce("next", "head"))
    return joined.filter(F.col("next").startswith(F.col("t"))).select(F.col("t").alias(text), F.expr("substring(next, length(t) + 1, 8)").alias("rest"))


def spikes(endings: DataFrame) -> DataFrame:
    """Lengths at which unfinished answers pile up: (n_chars) with far more of them than of neighbouring lengths."""
    counts = endings.groupBy("n_chars").agg(F.count("*").alias("n"), F.count_if(F.col("state") != "no").alias("open"))
    near = Window.orderBy("n_chars").rangeBetween(-10, 10)  # a row for each length that occurs
    return counts.withColumn("usual", F.sum("n").over(near) / 21).filter((F.col("open") >= SPIKE_ROWS) & (F.col("open") >= SPIKE_TIMES * F.col("usual")) & (F.col("open") >= 0.5 * F.col("n"))).select("n_chars")


def defects(results: DataFrame, key: str = "result_id", query: str = "query", answer: str = "answer", decision: str | None = "decision") -> DataFrame:
    """(key, defect, evidence): one row for each defective reply, the first of empty, echo, refusal, wrong_language, truncated.

    Evidence of a truncated reply is `prefix` where it is a shortened version of another reply, `limit` where it ends
    at a length at which replies pile up, else `end` (how it breaks off); of all others `rule`. Only rows whose decision
    is `answer` are looked at (all where decision is None). Repeated rows of a key count once; where they differ, the
    smallest (query, answer) holds. A null or blank answer is empty; a null query makes neither echo nor wrong language.
    Rows without a key are left out.
    """
    rows = results.filter(F.col(key).isNotNull())
    if decision:
        rows = rows.filter(F.lower(F.trim(F.col(decision))) == "answer")
    rows = rows.groupBy(F.col(key).alias("k")).agg(F.min(F.struct(F.col(query).alias("q"), F.col(answer).alias("a"))).alias("r")).select("k", "r.q", "r.a")

    def look(batches):
        for b in batches:
            kind, state, size = [], [], []
            for q, a in zip(b["q"].tolist(), b["a"].tolist()):
                q = q or ""
                found = "empty" if is_empty(a) else "echo" if is_echo(q, a) else "refusal" if is_refusal(q, a) else "wrong_language" if is_wrong_language(q, a) else None
                kind.append(found)
                state.append("no" if found else unfinished(a))
                size.append(len(a) if a else 0)
            kind = pd.Series(kind, dtype=object)
            yield pd.DataFrame({"k": b["k"].to_numpy(), "kind": kind, "state": pd.Series(state, dtype=object), "n_chars": np.array(size, np.int32), "a": b["a"].where(kind.isna().to_numpy(), None)})

    kinds = dict(results.dtypes)
    # The text of sound replies only; it is sorted once, and what comes back is joined by its hashes.
    looked = materialise(rows.mapInPandas(look, f"k {kinds[key]}, kind string, state string, n_chars int, a string"), "replies")
    sound = looked.filter(F.col("kind").isNull())
    h = (F.xxhash64("a").alias("h1"), F.xxhash64(F.lit(7), "a").alias("h2"))
    cut = materialise(shortened(sound, "a").select(*h, "rest", F.col("a").rlike("[A-Za-z]$").alias("letter"), F.col("a").rlike(r"[\d.]$").alias("number")), "cut")
    limits = materialise(spikes(sound).withColumn("limit", F.lit(True)), "limits")
    judged = sound.select("k", "state", "n_chars", *h).join(cut, ["h1", "h2"], "left").join(limits, "n_chars", "left")
    # A longer twin that goes on within a number or word shows a cut that the end mark hides.
    goes_on = F.coalesce(F.col("rest").rlike(r"^\d") | (F.col("rest").rlike(r"^[A-Za-z]") & F.col("letter")), F.lit(False))
    shown = goes_on & ((F.col("state") != "no") | F.col("number"))
    at_limit = F.coalesce(F.col("limit"), F.lit(False)) & (F.col("state") != "no")
    evidence = F.when(shown | (F.col("rest").isNotNull() & (F.col("state") == "yes")), "prefix").when(at_limit, "limit").when(F.col("state") == "yes", "end")
    return (
        looked.filter(F.col("kind").isNotNull()).select(F.col("k").alias(key), F.col("kind").alias("defect"), F.lit("rule").alias("evidence"))
        .unionByName(judged.withColumn("evidence", evidence).filter("evidence is not null").select(F.col("k").alias(key), F.lit("truncated").alias("defect"), "evidence"))
    )
