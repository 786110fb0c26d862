"""Benchmark decontamination by templates: typed placeholders, hashed windows, consistent slots. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, id_and_text, written

WINDOW = 8  # canonical tokens, at most; fewer in short items
LEAST_WINDOW = 4  # tokens of a window in items that have more than one
STRETCH = 4  # a window may be put together from windows that are shorter by so many tokens at most
DRIFT = 4  # an alignment may shift by a quarter (1 / DRIFT) of the item's tokens, and by so many at least
COVERAGE = 0.5  # share of an item's windows that a document must hold
BROADCAST_ROWS = 200_000  # windows of the benchmark; more are joined by shuffle

# Units that follow a number.
UNITS = "km kg g mg m cm mm l ml s ms min h hours days weeks months years dollars euros miles feet percent mph watts volts degrees".split()

_NAME = r"(?<=[\p{L}\p{N},;] )\p{Lu}\p{L}*"  # a capital inside a sentence
_NUMBER = r"[0-9]+(?:[.,][0-9]+)*+%?"  # possessive: Java repeats other groups by recursion, which long runs overflow

_UNIT = rf"(?i)([0-9]%? ?)((?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))"
NAME, UNIT = "\ue000", "\ue001"  # marks before names and units
_TOKEN = rf"{NAME}\p{{Lu}}\p{{L}}*(?: {NAME}\p{{Lu}}\p{{L}}*)*+|{UNIT}\p{{L}}+|{_NUMBER}|[\p{{L}}\p{{N}}&&[^0-9]]+"


def _marked(text: Column) -> Column:
    """The tokens of a text as written, with NAME before a name and UNIT before the unit of a number."""
    t = F.regexp_replace(F.translate(text, NAME + UNIT, "  "), _UNIT, f"$1{UNIT}$2")
    return F.regexp_extract_all(F.regexp_replace(t, _NAME, f"{NAME}$0"), F.lit(_TOKEN), F.lit(0))


def _canonical(w: Column) -> Column:
    first = F.substring(w, 1, 1)
    return F.when(first == NAME, "0name").when(first == UNIT, "0unit").when(first.between("0", "9"), "0num").otherwise(F.lower(w))


def tokens(text: Column) -> Column:
    """Lower-case words with 0name (one for names in a row), 0num and 0unit for names, numbers and the units after numbers."""
    return F.transform(_marked(text), _canonical)


def slots(text: Column) -> Column:
    """(pos, value) of every name and number, in order of place, from the same tokens as tokens()."""
    each = F.transform(_marked(text), lambda w, i: F.struct(i.alias("pos"), F.translate(w, NAME, "").alias("value"), _canonical(w).isin("0name", "0num").alias("slot")))
    return F.filter(each, lambda s: s["slot"])


def windows(toks: Column, n: int) -> Column:
    """Hashes of all windows of n tokens; none where there are fewer."""
    starts = F.sequence(F.lit(1), F.size(toks) - (n - 1))
    return F.when(F.size(toks) >= n, F.transform(starts, lambda i: F.xxhash64(F.slice(toks, i, F.lit(n))))).otherwise(F.array().cast("array<bigint>"))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per document and item that it leaks: doc_id, item_id, matched, windows, slots, changed.

    Both sides are canonicalised and cut into windows of `window` tokens. A token put into an item breaks one window less
    than a window has tokens, so items of under about 21 tokens take windows of a third of their length (LEAST_WINDOW at
    least), of which half outlive it; items of fewer than 8 tokens are one window of their own length. Equal window hashes
    meet in a hash join; longer windows are put together from hits of shorter ones in a row, so each text is hashed once. A document leaks an item if, in one alignment, it holds `coverage` of the item's windows and every
    slot value of the item stands for one value of the document throughout. An alignment takes hits at shifts that differ
    by a quarter of the item's tokens at most (DRIFT at least), so a slot may have more or fewer tokens than in the item; a
    slot is looked up by the shift of the most windows around it, or by the only shift there is, and not compared where
    that leads to no slot or parts of different shift leave it out. slots counts the slots compared and changed those whose value differs, so re-parameterised questions show as
    changed > 0. A capital at the start of a sentence cannot be told from a word and stays one. Null and empty texts and
    items have no windows; rows without an id are left out; rows of one doc_id are texts of their own, of which the one that
    holds most of an item counts; of rows of one item_id the smallest text is the item; empty tables give an empty result.
    """
    found = _leaks(docs, benchmark, window, coverage)
    return found.groupBy("doc_id", "item_id").agg(F.max("b").alias("b")).select("doc_id", "item_id", "b.matched", "b.windows", "b.slots", "b.changed")


def _leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """(doc_id, same, item_id, b) of each text; same is a hash that tells texts of one doc_id apart."""
    base = id_and_text(docs).where("doc_id is not null").select(F.struct("doc_id", F.unhex(F.md5("body")).alias("same")).alias("doc_id"), "body")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text"), F.lit("")).alias("body")).where("item_id is not null").groupBy("item_id").agg(F.min("body").alias("body"))
    n = F.size("toks")
    third = F.greatest(F.lit(min(LEAST_WINDOW, window)), F.floor((n + 3) / 3).cast("int"))
    items = items.select("item_id", "body", tokens(F.col("body")).alias("toks")).where("size(toks) > 0").withColumn("len", F.when(n < min(window, WINDOW), n).otherwise(F.least(F.lit(window), third)))
    items = written(items, "bench-items")
    lengths = [r["len"] for r in items.select("len").distinct().orderBy("len").collect()]  # at most `window` values
    if not lengths:
        lengths = [window]
    bases: dict[int, int] = {}  # the length of the windows that are hashed, for each length of window
    for k in lengths:
        bases[k] = next((b for b in bases.values() if b >= LEAST_WINDOW and k - b <= STRETCH), k)
    items = items.withColumn("base", F.element_at(F.create_map(*(F.lit(x) for kb in bases.items() for x in kb)), F.col("len")))
    own = F.array().cast("array<bigint>")
    for k in set(bases.values()):
        own = F.when(F.col("base") == k, windows(F.col("toks"), k)).otherwise(own)
    marks = written(items.select("item_id", F.posexplode(own).alias("ipos", "h")), "bench-windows")
    sizes = items.select("item_id", "len", (F.size("toks") - F.col("len") + 1).cast("long").alias("windows"), F.greatest(F.lit(DRIFT), F.size("toks") / DRIFT).alias("drift"), (F.col("len") - F.col("base")).alias("more"))
    toks = base.select("doc_id", tokens(F.col("body")).alias("toks"))
    hashed = sorted(set(bases.values()))
    every = F.concat(*(windows(F.col("toks"), k) for k in hashed))
    starts = F.concat(*(F.when(n >= k, F.sequence(F.lit(0), n - k)).otherwise(F.array().cast("array<int>")) for k in hashed))
    seen = toks.select("doc_id", F.explode(F.arrays_zip(starts.alias("pos"), every.alias("h"))).alias("w")).select("doc_id", F.col("w.pos").alias("pos"), F.col("w.h").alias("h"))
    few = marks.count() <= BROADCAST_ROWS
    marks = marks.select("item_id", "ipos", "h")
    hits = seen.join(F.broadcast(marks) if few else marks, "h")
    parts = hits.groupBy("doc_id", "item_id", (F.col("pos") - F.col("ipos")).alias("shift")).agg(F.array_sort(F.collect_set("ipos")).alias("places"))
    # a window stands at a place where all the shorter ones stand that make it up
    stands = lambda p: F.forall(F.sequence(F.lit(0), F.col("more")), lambda k: F.array_contains("places", p + k))
    parts = parts.join(sizes, "item_id").withColumn("places", F.filter("places", stands)).where("size(places) > 0").drop("more")
    near = Window.partitionBy("doc_id", "item_id").orderBy(F.col("shift") / F.col("drift")).rangeBetween(0, 1)
    runs = parts.withColumn("chain", F.collect_list(F.struct("shift", "places")).over(near))
    runs = runs.withColumn("matched", F.size(F.array_distinct(F.flatten("chain.places"))).cast("long"))
    runs = written(runs.where(F.col("matched") >= F.lit(coverage) * F.col("windows")).select("doc_id", "item_id", "shift", "matched", "windows", "len", "chain"), "bench-runs")
    # slots, of the documents and items that meet alone; always by shuffle, so that disk grows with the input and ids are not broadcast
    met = base.join(runs.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi").select("doc_id", "body").dropDuplicates(["doc_id"])
    theirs = met.select("doc_id", F.explode(slots(F.col("body"))).alias("s")).select("doc_id", F.col("s.pos").alias("pos"), F.col("s.value").alias("value"))
    asked = items.select("item_id", F.explode(slots(F.col("body"))).alias("s")).select("item_id", F.col("s.pos").alias("ipos"), F.col("s.value").alias("asked"))
    around = lambda c: F.size(F.filter(c["places"], lambda q: (q <= F.col("ipos")) & (F.col("ipos") < q + F.col("len"))))
    best_part = F.array_max(F.transform("chain", lambda c: F.struct(around(c).alias("n"), F.size(c["places"]).alias("all"), (-c["shift"]).alias("back"))))
    pairs = runs.join(asked, "item_id").withColumn("part", best_part).where((F.col("part.n") > 0) | (F.size("chain") == 1))
    pairs = pairs.withColumn("pos", F.col("ipos") - F.col("part.back")).select("doc_id", "item_id", "shift", "asked", "pos").join(theirs, ["doc_id", "pos"])
    by_value = pairs.groupBy("doc_id", "item_id", "shift", "asked").agg(F.countDistinct("value").alias("values"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") != F.col("asked")).alias("changed"))
    checked = by_value.groupBy("doc_id", "item_id", "shift").agg(F.max("values").alias("values"), F.sum("n").alias("slots"), F.sum("changed").alias("changed"))
    good = runs.drop("chain", "len").join(checked, ["doc_id", "item_id", "shift"], "left").where("coalesce(values, 1) <= 1")
    zero = F.lit(0).cast("long")
    best = good.groupBy("doc_id", "item_id").agg(F.max(F.struct("matched", -F.col("shift"), "windows", F.coalesce("slots", zero).alias("slots"), F.coalesce("changed", zero).alias("changed"))).alias("b"))
    return best.select("doc_id.doc_id", "doc_id.same", "item_id", "b")


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns; of rows of one doc_id those go whose own text leaks."""
    gone = _leaks(docs, benchmark).select("doc_id", "same").distinct()
    gone = gone.toDF(*fresh(docs, "id", "same")).hint("merge")
    own = F.unhex(F.md5(F.coalesce(docs["text"], F.lit(""))))
    return docs.join(gone, (docs["doc_id"] == gone[gone.columns[0]]) & (own == gone[gone.columns[1]]), "left_anti")
