"""Quality rules: base measures of repetition and symbols, then the distance of character classes and common words to the language."""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import release, slices, written

CLASSES = 5  # lower case, upper case, other letters and marks, punctuation, symbols
COMMON = 64  # common words of a language
COMMON_SHARE = 0.02  # of a language's documents hold such a word, at least
LEAST_SHARE = 0.001  # of all documents, at least, are of a language with references: so there are 1000 languages at most
LEAST_DOCS = 30  # and so many documents, at least
LEAST_WORDS = 50  # a shorter document fails
LEAST_LETTERS = 200  # characters of a document whose classes are compared
WORDS_COMPARED = 100  # words of a document whose common words are compared
CLASS_DISTANCE = 0.12
WORD_DIVERGENCE = 0.05  # beyond what chance makes of a text of that length
CHANCE = 1.7  # times the expected divergence of a sample
STEPS = 4096  # in which shares are counted for their median
LONGEST = 40  # code points of a common word
SLICE = 4_000_000  # bytes of text that a worker measures at a time
MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<long>, common array<long>"

_SYMBOLS, _SPACE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
_LETTERS = re.compile(r"[^\W\d_]+")
LETTER_RUNS = r"[^\p{L}\p{Nl}\p{No}]+"  # what parts such runs


@cache
def class_table() -> np.ndarray:
    """Of each code point: 0 to CLASSES - 1, then digits and ASCII white space."""
    out = np.empty(sys.maxunicode + 1, dtype=np.uint8)
    of = {"Ll": 0, "Lu": 1, "Lt": 1, "Lm": 2, "Lo": 2, "Mn": 2, "Mc": 2, "Me": 2, "Nd": CLASSES, "Nl": CLASSES, "No": CLASSES}
    for i in range(len(out)):
        kind = unicodedata.category(chr(i))
        out[i] = of.get(kind, 3 if kind[0] in "PZ" else 4)
    out[list(_SYMBOLS + b"@/\\")] = 4
    out[list(_SPACE)] = CLASSES + 1
    return out


def class_counts(text: str) -> list[int]:
    """Characters of each class in the words that hold no digit: numbers, addresses and keys say nothing of the prose."""
    kinds = class_table()[np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)]
    word = np.cumsum(kinds == CLASSES + 1)
    digit = np.zeros(int(word[-1]) + 1 if len(word) else 1, dtype=bool)
    digit[word[kinds == CLASSES]] = True
    return np.bincount(kinds[(kinds < CLASSES) & ~digit[word]], minlength=CLASSES).tolist()


def repeated_words(words: list) -> int:
    """Words in windows of three that the text has twice or more."""
    if len(words) < 4:
        return 0
    ids: dict = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=len(words))
    pairs = np.unique(x[:-1] * len(ids) + x[1:], return_inverse=True)[1]
    _, place, count = np.unique(pairs[:-1] * np.int64(len(ids)) + x[2:], return_inverse=True, return_counts=True)
    at = np.flatnonzero(count[place] > 1)
    held = np.zeros(len(words), dtype=bool)
    for k in range(3):
        held[at + k] = True
    return int(held.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def measures(docs: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """MEASURES of each row, from one pass over the texts; words: the common words of each language with references."""
    places = {lang: {w: i for i, w in enumerate(own)} for lang, own in words.items()}

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(2), SLICE):
                b, rows = batch.slice(at, n), []
                for lang, text in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    raw, own = text.encode(), places.get(lang)
                    parts, counts = raw.split(), []  # bytes part at ASCII white space alone
                    if own is not None:
                        counts = [0] * (len(own) + 1)
                        for w in _LETTERS.findall(text.lower()):
                            counts[own.get(w, -1)] += 1
                    rows.append((len(parts), len(text) - (len(raw) - len(raw.translate(None, _SPACE))), len(raw) - len(raw.translate(None, _SYMBOLS)), repeated_lines(raw), repeated_words(parts), class_counts(text), counts))
                columns = [list(x) for x in zip(*rows, strict=True)] if rows else [[] for _ in range(7)]
                kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in MEASURES.split(", ")])
        release()

    return docs.mapInArrow(measured, MEASURES)


def common_words(docs: DataFrame) -> dict[str, list[str]]:
    """The COMMON words that most documents of each language hold, for languages with references: those of LEAST_DOCS documents
    and LEAST_SHARE of all. Counted over all documents; no more than COMMON short words for each of 1000 languages come back."""
    sizes = docs.groupBy("lang").agg(F.count(F.lit(1)).alias("docs"))
    total = sizes.agg(F.sum("docs")).first()[0] or 0
    sizes = {r["lang"]: r["docs"] for r in sizes.where(F.col("docs") >= max(LEAST_DOCS, LEAST_SHARE * total)).collect()}
    if not sizes:
        return {}
    least = F.create_map(*(F.lit(x) for lang, n in sizes.items() for x in (lang, float(COMMON_SHARE * n))))
    held = docs.where(F.col("lang").isin(*sizes)).select("lang", F.explode(F.array_distinct(F.split(F.lower("body"), LETTER_RUNS))).alias("word"))
    held = held.where((F.col("word") != "") & (F.length("word") <= LONGEST)).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("docs"))
    ranked = held.where(F.col("docs") >= least[F.col("lang")]).groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("docs")).alias("n"), "word"))), 1, COMMON).alias("top"))
    return {lang: [] for lang in sizes} | {r["lang"]: [x["word"] for x in r["top"]] for r in ranked.collect()}


def distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon divergence of two histograms of one length, in bits; its root is a distance from 0 to 1."""
    term = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    both = F.zip_with(p, q, lambda x, y: (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2)
    return F.when(both.isNotNull(), F.greatest(F.lit(0.0), F.aggregate(both, F.lit(0.0), lambda s, x: s + x)))


def shares(counts: Column) -> Column:
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.transform(counts, lambda x: x / F.greatest(total, F.lit(1)))


def references(m: DataFrame) -> DataFrame:
    """lang, class_ref, word_ref: of the classes the median of the shares in its documents, of the common words the mean. Documents
    that fail the base rules or are too short to compare have no part, nor have languages that are too rare. The median keeps out what is odd in a tenth of them."""
    base = m.where(f"size(common) > 0 and not base_failed and letters >= {LEAST_LETTERS}")
    bins = lambda c: F.posexplode(shares(F.col(c))).alias("place", "share")
    classes = base.select("lang", bins("classes")).groupBy("lang", "place").agg(F.percentile(F.round(F.col("share") * STEPS), 0.5).alias("share"))
    words = base.select("lang", bins("common")).groupBy("lang", "place").agg(F.sum(F.round(F.col("share") * STEPS * STEPS).cast("long")).alias("share"))
    ordered = lambda df, name: df.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("place", "share"))).alias("x")).select("lang", shares(F.transform("x", lambda x: F.round(x["share"]).cast("long"))).alias(name))  # noqa: E731  a bin each
    return ordered(classes, "class_ref").join(ordered(words, "word_ref"), "lang", "left")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    class_distance, word_distance (null where too little is there to compare).

    A document fails the base rules below LEAST_WORDS words, or if more than half of its words are in repeated windows. Of
    the others, kept says that it is near its language: the Jensen-Shannon distance of its character classes to the
    language's median is at most CLASS_DISTANCE, and the divergence of its common words from the language's mean is at most
    WORD_DIVERGENCE beyond CHANCE times what a sample of so many words shows by chance, (bins - 1) / (8 ln 2 n). Guards:
    classes are compared from LEAST_LETTERS characters, words from WORDS_COMPARED words, and a language needs LEAST_DOCS
    documents and LEAST_SHARE of all; below these nothing is held against a document.

    All documents are read twice: to count the words of each language over all of them, and to measure; the rest works on
    the measures alone. Null text is empty and fails; null lang is a language of its own; repeated rows each give a row;
    an empty table gives an empty result; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    sum_of = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda s, x: s + x)
    m = written(measures(rows, common_words(rows)).select("*", failed.alias("base_failed"), sum_of("classes").alias("letters"), sum_of("common").alias("runs")), "quality-measures")
    m = m.join(F.broadcast(references(m)), "lang", "left")  # a row for each of 1000 languages at most
    by_class = F.when(F.col("letters") >= LEAST_LETTERS, distance(shares(F.col("classes")), F.col("class_ref")))
    by_word = F.when((F.col("n_words") >= WORDS_COMPARED) & (F.col("runs") > 0) & (F.size("common") > 1), distance(shares(F.col("common")), F.col("word_ref")))
    m = m.select("*", by_class.alias("class_jsd"), by_word.alias("word_jsd"))
    chance = CHANCE * (F.size("common") - 1) / (8 * np.log(2).item() * F.col("runs"))
    far = (F.col("class_jsd") > CLASS_DISTANCE**2) | (F.col("word_jsd") > WORD_DIVERGENCE + chance)
    return m.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~F.coalesce(far, F.lit(False))).alias("kept"), F.sqrt("class_jsd").alias("class_distance"), F.sqrt("word_jsd").alias("word_distance"))
