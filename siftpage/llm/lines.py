"""Line dedup: documents that share rare lines are aligned with patience diff, and common blocks leave the later one."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text, written

MIN_CHARS = 20  # of a line that can bring two documents together or be removed


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned pairs of places of equal items, by patience diff."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a: dict = {}
        in_b: dict = {}
        for i in range(a0, a1):
            in_a[a[i]] = -1 if a[i] in in_a else i
        for j in range(b0, b1):
            in_b[b[j]] = -1 if b[j] in in_b else j
        both = [(i, in_b[x]) for x, i in in_a.items() if i >= 0 and in_b.get(x, -1) >= 0]
        tops: list[int] = []  # longest increasing run of places in b
        piles: list[tuple[int, int, int]] = []
        ends: list[int] = []
        for i, j in both:
            k = bisect_left(tops, j)
            piles.append((i, j, ends[k - 1] if k else -1))
            if k == len(tops):
                tops.append(j)
                ends.append(len(piles) - 1)
            else:
                tops[k], ends[k] = j, len(piles) - 1
        at, chain = ends[-1] if ends else -1, []
        while at >= 0:
            chain.append(piles[at][:2])
            at = piles[at][2]
        if not chain:
            continue
        marks = [*reversed(chain), (a1, b1)]
        pi, pj = a0, b0
        for i, j in marks:
            todo.append((pi, i, pj, j))
            if i < a1:
                out.append((i, j))
            pi, pj = i + 1, j + 1
    return sorted(out)


def line_matches(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, removed (places of lines to delete, ascending), partners (earlier doc_ids).

    Lines are what line feeds part, compared by 128-bit hash after trimming spaces; lines under min_chars characters bring
    nobody together. Every line links a document to the earliest document that holds the line, so there are no more pairs
    than lines, whatever the size of a group, and no line is too frequent: a line of 40 documents leaves 39 of them. Two lines of min_chars that follow one another (shorter lines apart) are a block, which also links a
    document to the earliest holder of the block, so a block is found though each of its lines was first held elsewhere.
    Removed are the aligned lines of the later document that are min_chars long or stand between such lines. Copies of a
    text are aligned with the first.
    Null and empty text is one empty line; rows of one doc_id are documents of their own, told apart and ordered by a hash
    of the text, and rows equal in both count as one holder; rows without doc_id are left out; an empty table gives an
    empty result.
    """
    return _matches(docs, min_chars).drop("same")


def _matches(docs: DataFrame, min_chars: int) -> DataFrame:
    def hashed(line: Column) -> Column:
        line = F.trim(line)
        return F.struct(F.unhex(F.md5(line)).alias("h"), (F.length(line) >= min_chars).alias("long"))

    row = F.struct("doc_id", F.unhex(F.md5("body")).alias("same"))
    lists = written(id_and_text(docs).where("doc_id is not null").select(row.alias("r"), F.transform(F.split("body", "\n", -1), hashed).alias("ls")), "line-lists")
    ls = lists.select("r", F.explode("ls").alias("l")).where("l.long").select("r", F.col("l.h").alias("h")).distinct()
    holders = ls.groupBy("h").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "first")
    pairs = ls.join(holders, "h").where("r <> first").select("r", "first").distinct()
    long = F.transform(F.filter("ls", lambda l: l["long"]), lambda l: l["h"])
    two = F.zip_with(F.slice("hs", 1, F.size("hs") - 1), F.slice("hs", 2, F.size("hs") - 1), lambda x, y: F.unhex(F.md5(F.concat(x, y))))
    blocks = lists.select("r", long.alias("hs")).where("size(hs) > 1").select("r", F.explode(F.array_distinct(two)).alias("b"))
    holding = blocks.groupBy("b").agg(F.min("r").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("b", "first")
    pairs = pairs.union(blocks.join(holding, "b").where("r <> first").select("r", "first")).distinct()
    mine = lists.select("r", F.transform("ls", lambda l: F.struct(l["h"].alias("h"), l["long"].alias("long"))).alias("later"))
    theirs = lists.select(F.col("r").alias("first"), F.transform("ls", lambda l: l["h"]).alias("earlier"))

    @F.pandas_udf("array<int>")
    def align(later: pd.Series, earlier: pd.Series) -> pd.Series:
        out = []
        for mine_, theirs_ in zip(later, earlier, strict=True):
            long = [x["long"] for x in mine_]
            found = [i for i, _ in patience([x["h"] for x in mine_], list(theirs_))]
            keep, run = [], []
            for i in [*found, None]:  # runs of neighbouring places; short lines go only with a long one
                if run and (i is None or i != run[-1] + 1):
                    keep += run if any(long[k] for k in run) else []
                    run = []
                if i is not None:
                    run.append(i)
            out.append(keep)
        return pd.Series(out)

    aligned = pairs.join(mine, "r").join(theirs, "first").select("r", "first", align("later", "earlier").alias("gone")).where("size(gone) > 0")
    gone = aligned.groupBy("r").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("gone")))).alias("removed"), F.array_sort(F.collect_set("first.doc_id")).alias("partners"))
    empty = F.array().cast("array<int>"), F.array().cast("array<long>")
    return lists.select("r", F.size("ls").alias("n_lines")).join(gone, "r", "left").select("r.doc_id", "r.same", "n_lines", F.coalesce("removed", empty[0]).alias("removed"), F.coalesce("partners", empty[1]).alias("partners"))


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The documents without the removed lines. A document of which nothing is left stays with an empty text."""
    names = fresh(docs, "id", "same", "removed")
    gone = _matches(docs, min_chars).where("size(removed) > 0").select("doc_id", "same", "removed").distinct().toDF(*names)
    joined, removed = docs.join(gone, (docs["doc_id"] == gone[names[0]]) & (F.unhex(F.md5(F.coalesce(docs["text"], F.lit("")))) == gone[names[1]]), "left"), F.col(names[2])
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda l, i: F.struct(l.alias("l"), i.alias("i"))), lambda x: ~F.array_contains(removed, x["i"])), lambda x: x["l"]), "\n")
    return joined.withColumn("text", F.when(removed.isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
