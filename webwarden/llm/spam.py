"""Keyword-stuffed and link-list documents.

One pass measures each text: its lines are cut into segments, and each segment's words and function words are
counted; per document come the share of the most frequent word, of repeated three-word sequences and of repeated
lines, the share of words in links, and the density of separators. Over all documents the usual share of function
words of each language is then computed, and a segment counts as running text only if it reaches a set part of
what is usual in its language. A document is found if most of its words stand outside running text and at least
one of the measures is beyond its threshold, a high quantile of the language's documents of running text.

The function words of four languages are fixed values; those of any other language that enough documents declare are
learnt from their document frequency. Missing function words alone never make a document spam: in a language of
which nothing is known all words stand outside running text, and the other measures decide.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webwarden.session import materialize

# Frequent function words of the languages of the corpus.
FUNCTION_WORDS = {
    "en": "the of and to in is was were that it for on with as at by from this not are be has have had which you your our we if but does before after until under every because although its their who may can".split(),
    "de": "der die das und ist den dem ein eine einen einer auf im mit sich nicht von zu bei für wurde hat wird des nach unter an ob noch weil bis zwischen über aus als oder um ihnen wer dass zum zur".split(),
    "fr": "la les le des du de un une et à en est qui que pour dans sur au aux par ne pas se ce il nous avons votre sous entre si son avec été jusqu plus ou après d l".split(),
    "es": "el los la las y en una un del que con por para su se al lo no más ya de es a o sus hasta entre desde si todavía pero como donde sin".split(),
}
LANGUAGES = sorted(FUNCTION_WORDS)
_WORD = re.compile(r"[^\W\d_]+")
_LINK = re.compile(r"(?i)\b(?:https?|ftp)://\S+|\bwww\.\S+|(?<![\w.-])[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}/\S*|\[url[^\]]*\]|<a\s[^>]*>")
_CLOSING = re.compile(r"(?i)\[/url\]|</a>")
_END = re.compile(r"(?<=[.!?])\s+")
_LOG = re.compile(r'^\s*\S+ \S+ \S+ \[[^\]]*\] "|^\s*\d{4}-\d\d-\d\d[T ]\d\d:\d\d')
_FENCE = re.compile(r"^\s*```")
_DEFANGED = re.compile(r"(?i)hxxps?://|\[\.\]|\[dot\]")
_SEPARATOR = re.compile(r"[|,;•·»/#–—]|\s-\s|\s{2,}|\(\d+\)")
_BLOB = re.compile(r"^(?:0x[0-9a-fA-F]+|[0-9a-fA-F]{16,}|[A-Za-z0-9+/]{40,}={0,2})$")

_DIGITS = re.compile(r"\d+")
_SHAPE = re.compile(r"[^\W\d_]+")
_HOST = re.compile(r"(?i)(?<![\w.-])(?:hxxps?://)?[a-z0-9-]+(?:\.[a-z0-9-]+)*\.[a-z]{2,}(?![a-z0-9])")
_TOKEN = re.compile(r"[^\W_]\S*")
MEASURES = ["top_word", "repeated_trigrams", "repeated_lines", "link_share", "separators"]

#: A segment is running text if it has at least this many words and this part of its language's usual share of
#: function words; a document is found if at least MIN_STUFFED words and MAJORITY of all stand outside running text.
MIN_WORDS, USUAL_PART, MIN_STUFFED, MAJORITY = 4, 0.35, 12, 0.5
#: Quantile of the measures of documents of running text that a found document must exceed in one measure at least,
#: and the least value of each threshold.
QUANTILE = 0.95
FLOORS = {"top_word": 0.12, "repeated_trigrams": 0.10, "repeated_lines": 0.30, "link_share": 0.25, "separators": 0.25}
#: A language without fixed function words is learnt from this many documents that declare it: the words that stand in
#: this share of them are its function words, at most LEARN_MOST, the most frequent first. A statistic over all
#: documents; the bound is on words of a language, since no language needs more.
LEARN_DOCS, LEARN_SHARE, LEARN_MOST = 50, 0.15, 60


def _code(lang: Column) -> Column:
    """The language that a document declares, as its first two letters in lower case; null for none."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2})(?:[^a-z]|$)", 1), F.lit(""))


def learnt_words(df: DataFrame, text_col: str, lang_col: str) -> dict[str, list[str]]:
    """The function words of the languages that are declared but not among the fixed ones, by document frequency over
    all documents that declare them. At most LEARN_MOST words for each two-letter code come to the driver."""
    code = _code(F.col(f"`{lang_col}`").cast("string"))
    other = df.select(code.alias("code"), F.col(f"`{text_col}`").alias("text")).filter(F.col("code").isNotNull() & ~F.col("code").isin("un", *LANGUAGES) & F.col("text").rlike(r"\S"))
    words = other.select("code", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))))).alias("word"))
    counted = words.groupBy("code", "word").agg(F.count(F.lit(1)).alias("n"))
    docs = counted.filter("word = ''").select("code", F.col("n").alias("docs")).filter(F.col("docs") >= LEARN_DOCS)
    # Two-letter codes are fewer than 700, so their sizes may be sent out.
    frequent = counted.filter("word <> ''").join(F.broadcast(docs), "code").filter(F.col("n") >= LEARN_SHARE * F.col("docs"))
    ranked = frequent.withColumn("r", F.row_number().over(Window.partitionBy("code").orderBy(F.col("n").desc(), "word"))).filter(F.col("r") <= LEARN_MOST)
    return {r["code"]: sorted(r["words"]) for r in ranked.groupBy("code").agg(F.collect_list("word").alias("words")).collect()}


def segments(text: str) -> Iterator[tuple[str, bool]]:
    """(segment, neutral): the sentences and lines of a text. Log lines, fenced code and defanged indicators are
    neutral: they count as words of the text, but neither as running text nor as stuffing."""
    fenced = False
    for line in text.splitlines():
        if _FENCE.match(line):
            fenced = not fenced
            continue
        if not line.strip():
            continue
        if fenced or _LOG.match(line) or _DEFANGED.search(line):
            yield line, True
            continue
        for part in _END.split(line):
            if part.strip():
                yield part, False


class Lexicon:
    """The function words by language, the fixed ones and those learnt."""

    def __init__(self, learnt: dict[str, list[str]] | None = None) -> None:
        sets = {**{k: frozenset(v) for k, v in (learnt or {}).items()}, **{k: frozenset(FUNCTION_WORDS[k]) for k in LANGUAGES}}
        self.languages = sorted(sets)
        self.sets = [sets[k] for k in self.languages]
        self.all = frozenset().union(*self.sets)


FIXED = Lexicon()


def measured(text: str, declared: str | None, lexicon: Lexicon = FIXED) -> tuple:
    """(lang, seg_words, seg_function, neutral words, five measures) of one text.

    lang is the language with most function words, else the declared one, else "und". seg_words and seg_function
    have the words and function words of each segment; links and hosts count as one word each. The top word is the
    share of its further uses, so that a word used twice in a short note weighs little.
    """
    counts: list[int] = []
    spoken: list[list[str]] = []
    words: list[str] = []
    neutral = links = separators = tokens = 0
    for part, aside in segments(text):
        if aside:
            neutral += len(_TOKEN.findall(part))
            continue
        body, found, hosts = part, 0, 0
        if "." in part[:-1] or "[" in part or "<" in part or "/" in part:
            body, found = _LINK.subn(" ", _CLOSING.sub(" ", part))
            body, hosts = _HOST.subn(" ", body)
        own = _TOKEN.findall(body)
        if len(own) == 1 and not found and _BLOB.match(own[0]):
            neutral += 1
            continue
        w = _WORD.findall(body.lower())
        n = max(len(w), len(own)) + found + hosts
        if not n:
            continue
        counts.append(n)
        spoken.append(w)
        tokens += n
        links += found + hosts * (len(w) < MIN_WORDS)
        separators += len(_SEPARATOR.findall(part.strip())) - (1 if part.lstrip()[:1] == "#" else 0)
        words += w
    seen = Counter(words)
    total = [sum(map(seen.__getitem__, s)) for s in lexicon.sets]
    if any(total):
        k = max(range(len(total)), key=total.__getitem__)
        has = lexicon.sets[k].__contains__
        lang, function = lexicon.languages[k], [sum(map(has, w)) for w in spoken]
    else:
        code = (declared or "").strip().lower()[:2]
        lang, function = code if code in lexicon.languages else "und", [0] * len(counts)
    top = max((n - 1 for w, n in seen.items() if w not in lexicon.all), default=0) / max(1, len(words))
    repeats = 1 - len(set(zip(words, words[1:], words[2:]))) / (len(words) - 2) if len(words) > 2 else 0.0
    rows = [line for line in text.splitlines() if line.strip()]
    lines = 1 - len({_DIGITS.sub("0", _SHAPE.sub("w", line.strip())) for line in rows}) / max(1, len(rows))
    return lang, counts, function, neutral, top, repeats, lines, links / max(1, tokens), max(0, separators) / max(1, tokens)


_SCHEMA = pa.schema(
    [("doc_id", pa.int64()), ("lang", pa.string()), ("seg_words", pa.list_(pa.int32())), ("seg_function", pa.list_(pa.int32())), ("neutral", pa.int32()), *[(m, pa.float64()) for m in MEASURES]]
)
_DDL = "doc_id bigint, lang string, seg_words array<int>, seg_function array<int>, neutral int, " + ", ".join(f"{m} double" for m in MEASURES)


def text_measures(df: DataFrame, id_col: str, text_col: str, lang_col: str | None) -> DataFrame:
    """The measures of each text that is not null or blank; whole texts, in Arrow batches."""
    lexicon = Lexicon(learnt_words(df, text_col, lang_col)) if lang_col else FIXED

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, langs = (batch.column(i).to_pylist() for i in range(3))
            rows = [(i, *measured(t, g, lexicon)) for i, t, g in zip(ids, texts, langs)]
            cols = list(zip(*rows)) if rows else [()] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _SCHEMA)], schema=_SCHEMA)

    lang = F.col(f"`{lang_col}`").cast("string") if lang_col else F.lit(None).cast("string")
    source = df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), lang.alias("lang"))
    return source.filter(F.col("text").rlike(r"\S")).mapInArrow(run, _DDL)


def judged(measures: DataFrame) -> DataFrame:
    """Add total, stuffed (words outside running text), and the language's thresholds, and `is_spam`.

    `measures` is read for the usual share of function words of each language (the median over all its documents), for
    the thresholds (a high quantile over its documents of running text; where these are fewer than LEARN_DOCS, over
    those of all languages), and for the verdict. The statistics have one row per language, or one row in all, and are
    sent by broadcast.
    """
    words = F.aggregate("seg_words", F.lit(0), lambda a, x: a + x)
    share = F.aggregate("seg_function", F.lit(0), lambda a, x: a + x) / words
    has = measures.filter(F.size("seg_words") > 0)
    # A row per language; "und", the texts without any function word, is held to the mean of the languages.
    named = F.when(F.col("lang") != "und", F.col("median"))
    medians = has.groupBy("lang").agg(F.percentile_approx(share, 0.5).alias("median"))
    usual = medians.select("lang", F.coalesce(named, F.avg(named).over(Window.partitionBy(F.lit(0))), F.lit(0.0)).alias("usual"))
    rated = has.join(F.broadcast(usual), "lang").withColumn("need", USUAL_PART * F.col("usual"))
    pairs = F.arrays_zip("seg_words", "seg_function")
    running = F.aggregate(pairs, F.lit(0), lambda a, p: a + F.when((p["seg_words"] >= MIN_WORDS) & (p["seg_function"] >= F.col("need") * p["seg_words"]), p["seg_words"]).otherwise(0))
    rated = rated.withColumn("total", words + F.col("neutral")).withColumn("stuffed", words - running)
    clean = F.col("stuffed") < 0.2 * F.col("total")
    # A row for each language and one, without language, for all; that one's values stand in for languages of few documents.
    rolled = rated.rollup("lang").agg(F.count_if(clean).alias("n"), *[F.percentile_approx(F.when(clean, F.col(m)), QUANTILE).alias(m) for m in MEASURES])
    of_all = [F.max(F.when(F.col("lang").isNull(), F.col(m))).over(Window.partitionBy(F.lit(0))) for m in MEASURES]
    limits = rolled.select("lang", *[F.coalesce(F.when(F.col("n") >= LEARN_DOCS, F.col(m)), o, F.lit(0.0)).alias(f"{m}_q") for m, o in zip(MEASURES, of_all)])
    limited = rated.join(F.broadcast(limits), "lang")
    beyond = F.lit(False)
    for m in MEASURES:
        beyond = beyond | (F.col(m) > F.greatest(F.col(f"{m}_q"), F.lit(FLOORS[m])))
    spam = (F.col("stuffed") >= MIN_STUFFED) & (F.col("stuffed") > MAJORITY * F.col("total")) & beyond
    return limited.select("doc_id", "lang", "total", "stuffed", *MEASURES, spam.alias("is_spam"))


def spam_verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang") -> DataFrame:
    """One row per text with words: its measures and `is_spam`. Null and blank texts and texts without any word give
    no row; repeated rows are judged each; an empty table gives an empty result."""
    return judged(materialize(text_measures(df, id_col, text_col, lang_col), "measures"))
