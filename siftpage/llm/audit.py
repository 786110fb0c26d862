"""Filter interaction audit: what each filter removes in every order, counted from the masks of failing filters."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, release, slices, written

LETTERS = "ABCDE"
FIRST_BLOCK = 1024  # bytes of the first block of a text; each block after it is four times as long
SLICE = 16_000_000  # bytes of text that a worker measures at a time
MEASURES = "doc_id long, part string, words long, distinct_words long, upper long, chars long, marked boolean, blocks array<long>, same binary"

_UPPER = bytes(range(65, 91))
_MARKS = b"#$%&*|"


def block_hashes(text: bytes, first: int = FIRST_BLOCK) -> list[int]:
    """64-bit hashes of the text's blocks, the first of `first` bytes, each next one four times as long."""
    out, at, size = [], 0, first
    while at < len(text):
        out.append(xxhash.xxh3_64_intdigest(text[at : at + size]) - (1 << 63))
        at, size = at + size, 4 * size
    return out


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What the filters look at, and the block hashes, from one pass over the texts."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, n in slices(batch.column(2), SLICE):
                b = batch.slice(at, n)
                rows = []
                for text in pc.cast(b.column(2), pa.binary()).to_pylist():
                    words = text.split()  # bytes part at ASCII white space alone
                    rows.append((len(words), len(set(words)), len(text) - len(text.translate(None, _UPPER)), len(text.translate(None, _MARKS)) < len(text), block_hashes(text), hashlib.md5(text).digest()))
                words, distinct, upper, marked, blocks, same = (list(x) for x in zip(*rows, strict=True)) if rows else ([] for _ in range(6))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(words, pa.int64()), pa.array(distinct, pa.int64()), pa.array(upper, pa.int64()), pc.cast(pc.utf8_length(b.column(2)), pa.int64()), pa.array(marked, pa.bool_()), pa.array(blocks, pa.list_(pa.int64())), pa.array(same, pa.binary())], names=["doc_id", "part", "words", "distinct_words", "upper", "chars", "marked", "blocks", "same"])
        release()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), F.coalesce(F.col(text_col), F.lit("")).alias("body"))
    return rows.mapInArrow(measured, MEASURES)


def refined(rows: DataFrame) -> DataFrame:
    """doc_id, same, class of the rows (doc_id, same, chars, blocks) that no refinement tells apart from another row; class is the
    smallest doc_id of rows alike so far, and same tells rows of one doc_id apart. The first partition is by length in code
    points, each next one by one block hash more; what is alone in its class is dropped, and rows without another block are
    through. Every round writes its classes and what is left, so that the join back is one of two tables and a hot class
    is split."""

    def split(df: DataFrame, *keys: str) -> DataFrame:
        alike = df.groupBy(*keys).agg(F.min("doc_id").alias("next"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        return written(df.join(written(alike, "audit-classes"), list(keys)).select("doc_id", "same", F.col("next").alias("class"), "blocks"), "audit-alike")

    left, k, through = split(rows.where("doc_id is not null"), "chars"), 0, []
    while True:  # as many rounds as blocks of the longest text that has an equal so far: the logarithm of its length
        through.append(left.where(F.size("blocks") <= k).select("doc_id", "same", "class"))
        left = left.where(F.size("blocks") > k)
        if left.isEmpty():
            break
        left, k = split(left.withColumn("block", F.get("blocks", F.lit(k))), "class", "block"), k + 1
    out = through[0]
    for df in through[1:]:
        out = out.union(df)
    return out.distinct()


def later_copies(docs: DataFrame, found: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `found` (doc_id, same, class) whose text a row with a smaller doc_id has. Texts that refinement leaves together
    are compared whole: grouped by class and text, a hot group shrunk to a row in each task before the shuffle. The first of
    each text is taken out by its id, so no join has a hot key, and texts that all hashes fail to tell apart stay apart."""
    texts = id_and_text(docs, id_col, text_col).withColumn("same", F.unhex(F.md5("body"))).join(found.hint("merge"), ["doc_id", "same"])  # one plan at every size: what is found grows with the documents
    firsts = texts.groupBy("class", "same", "body").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "same", "class")
    return found.join(firsts, ["doc_id", "same", "class"], "left_anti")


def failing(m: DataFrame) -> list[Column]:
    """Filters A to D over the columns of measures()."""
    words, distinct, upper, chars = (F.col(c) for c in ("words", "distinct_words", "upper", "chars"))
    return [words < 100, 100 * distinct < 80 * words, 100 * upper > 10 * chars, F.col("marked")]


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (bit i: filter i of LETTERS fails), n, good, toxic: documents, and those labelled so, per part and mask."""
    m = written(measures(docs), "audit-measures")
    copies = later_copies(docs, written(refined(m.select("doc_id", "same", "chars", "blocks")), "audit-through")).select("doc_id", "same", F.lit(1 << LETTERS.index("E")).alias("copy"))
    marked = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    bits = sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(failing(m))), F.lit(0))
    rows = m.select("doc_id", "same", "part", bits.alias("bits")).join(copies, ["doc_id", "same"], "left").join(marked, "doc_id", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return rows.groupBy("part", (F.col("bits") + zero("copy")).alias("mask")).agg(F.count(F.lit(1)).alias("n"), F.sum(zero("good")).alias("good"), F.sum(zero("toxic")).alias("toxic"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: part, filter_order, step, kept, removed, redundant, unique_fails,
    good_lost, toxic_lost, shapley.

    Texts are read twice: once for the measures and block hashes, once to compare whole texts that are still alike. All 600
    steps of a part come from its 32 counts by mask; shapley, the sum over the 120 orders, needs no orders: a document that k
    filters fail is removed by each of them in 120 / k orders.

    Null text is empty, a null lang the part ''. A row with null doc_id is a copy of none and none's original; rows of one
    doc_id each count and share labels (any 1 counts). An empty table gives no rows.
    """
    cube = masks(docs, labels).groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    steps = [(("".join(order), k + 1, 1 << LETTERS.index(f), sum(1 << LETTERS.index(x) for x in order[:k]))) for order in permutations(LETTERS) for k, f in enumerate(order)]
    array = F.array(*(F.struct(F.lit(o).alias("filter_order"), F.lit(k).alias("step"), F.lit(bit).alias("bit"), F.lit(before).alias("before")) for o, k, bit, before in steps))
    rows = cube.select("part", "cells", F.inline(array))

    def total(value, test) -> Column:
        return F.aggregate(F.filter("cells", test), F.lit(0).cast("long"), lambda s, c: s + value(c))

    mask = lambda c: c["mask"]
    bit, before = F.col("bit"), F.col("before")
    fails, earlier = lambda c: mask(c).bitwiseAND(bit) > 0, lambda c: mask(c).bitwiseAND(before) > 0
    here = lambda c: fails(c) & ~earlier(c)
    share = lambda c: (c["n"] * F.lit(120) / F.bit_count(mask(c))).cast("long")  # noqa: E731  120 divides by 1 to 5
    n = lambda c: c["n"]
    return rows.select(
        "part", "filter_order", "step",
        total(n, lambda c: ~fails(c) & ~earlier(c)).alias("kept"), total(n, here).alias("removed"), total(n, lambda c: fails(c) & earlier(c)).alias("redundant"), total(n, lambda c: mask(c) == bit).alias("unique_fails"),
        total(lambda c: c["good"], here).alias("good_lost"), total(lambda c: c["toxic"], here).alias("toxic_lost"), total(share, fails).alias("shapley"),
    )
