"""Near-duplicate groups of whole documents by word-shingle similarity, on SimHash fingerprints of sketches."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, release, without, written
from .components import components
from .simhash import links

CLASSES = 16  # parts of a text's shingles, by hash
SMALLEST = 4  # hashes of a part that make its fingerprint
FP_BITS, FP_BLOCKS = 1, 4  # fingerprints that differ in so many bits meet, by way of so many blocks
BITS = 1024  # of a bitmap that bounds a similarity from above
BLOCK = 512  # about as many members of a candidate set meet as many others in one task


def _shingles(text: str, words: int) -> np.ndarray:
    w = text.encode().lower().split()
    if not w:
        return np.zeros(0, dtype="<u8")
    grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[j:] for j in range(words))))
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(g, 42) for g in grams), dtype="<u8"))


def _fingerprints(s: np.ndarray) -> list[int]:
    """For each part that has any of the ascending hashes, the SimHash of its smallest."""
    part = s % CLASSES
    order = np.argsort(part, kind="stable")
    s, part = s[order], part[order]
    own, first, sizes = np.unique(part, return_index=True, return_counts=True)
    few = np.minimum(sizes, SMALLEST)
    rank = np.arange(len(s)) - np.repeat(first, sizes)
    bits = np.unpackbits(s[rank < SMALLEST].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.add.reduceat(bits, np.cumsum(few) - few, axis=0, dtype=np.int64) if len(own) else np.zeros((0, 64))
    return np.packbits(2 * ones > few[:, None], axis=1, bitorder="little").view("<i8")[:, 0].tolist() if len(own) else []


def _bitmap(s: np.ndarray) -> bytes:
    """Parities of the counts of hashes by their last bits: two of them differ in no more bits than the sets in members."""
    return np.packbits(np.bincount(s % BITS, minlength=BITS).astype(np.uint8) & 1).tobytes()


def _jaccard(x: np.ndarray, y: np.ndarray) -> float:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / (len(x) + len(y) - both) if len(x) + len(y) else 1.0


def _open_pairs(pdf: pd.DataFrame, similarity: float):
    """For each row but the last, its place and those of the later rows of another component that may be similar enough."""
    sides, comps, sizes = pdf["side"].to_numpy(), pdf["comp"].to_numpy(), pdf["size"].to_numpy()
    bits = np.frombuffer(b"".join(pdf["bits"]), dtype="<u8").reshape(len(pdf), -1)
    both = pdf["i"].iloc[0] == pdf["j"].iloc[0]
    for x in range(len(pdf) - 1):
        may = np.abs(sizes[x + 1 :] - sizes[x]) <= (sizes[x + 1 :] + sizes[x]) * (1 - similarity) / (1 + similarity) + 1e-6
        may &= (comps[x + 1 :] != comps[x]) & (both | (sides[x + 1 :] != sides[x]))
        ys = np.flatnonzero(may) + x + 1
        if len(ys):
            apart = np.bitwise_count(bits[ys] ^ bits[x]).sum(axis=1, dtype=np.int64)
            yield x, ys[apart <= (sizes[ys] + sizes[x]) * (1 - similarity) / (1 + similarity) + 1e-6]


def _blocks(rows: DataFrame) -> DataFrame:
    """(label, rest, doc_id, ...) with the keys (label, i, j) under which the members of a candidate set meet, and side.

    Blocks 0, 1, .. hold the rest, -1, -2, .. the others; each block of the rest meets every block once and itself."""
    n = rows.groupBy("label").agg(F.count_if("rest").alias("n_rest"), F.count_if(~F.col("rest")).alias("n_other")).where("n_rest > 0")
    k = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    rows = rows.join(n.select("label", k("n_rest").alias("k_rest"), k("n_other").alias("k_other")), "label")
    at = F.xxhash64("doc_id", F.lit(1))
    rows = rows.withColumn("side", F.when(F.col("rest"), F.pmod(at, "k_rest")).otherwise(-1 - F.pmod(at, "k_other")).cast("int"))
    with_rest = F.transform(F.sequence(F.lit(0), F.col("k_rest") - 1), lambda o: F.struct(F.greatest("side", o).alias("i"), F.least("side", o).alias("j")))
    with_other = F.transform(F.sequence(F.lit(-1), -F.col("k_other")), lambda o: F.struct(F.col("side").alias("i"), o.alias("j")))
    meets = F.explode(F.when(F.col("rest"), F.concat(with_rest, with_other)).otherwise(with_rest)).alias("m")
    return rows.select("*", meets).select("label", "m.i", "m.j", "side", *[c for c in rows.columns if c not in ("label", "side", "rest", "k_rest", "k_other")])


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, group_id) of every document with a near-duplicate: group_id is the smallest doc_id of its group.

    Two texts are linked if the Jaccard similarity of their sets of `words`-word shingles is `similarity` or more. A whole
    fingerprint moves by many bits at that similarity, so the shingles of each text are parted into CLASSES by hash and the
    SMALLEST hashes of each part give a fingerprint of its own. Texts of which one of these fingerprints differs by FP_BITS
    at most (by way of the pivot tables) are candidates: at similarity 0.8 a part has equal smallest hashes with a chance of
    0.4, so all but one pair in some thousands share one, and parts with another hash differ by many bits. Texts with
    equal shingles are one text. Each set of candidates is first compared with its member of smallest id; then every pair
    of its members that this leaves in different groups is compared, block by block, where the sizes of both and a bitmap
    of their hashes (an upper bound of the similarity, so nothing is lost by it) allow it. A task gives only the links that
    join its groups, so pairs within a large group are not put out. Texts without words are one group. Rows without a
    doc_id take no part; of repeated rows of a doc_id one counts; an empty table gives an empty result.
    """
    base = id_and_text(docs).where("doc_id is not null")

    @F.pandas_udf("fps array<long>, size long, bits binary, equal binary")
    def sketch(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            every = _shingles(t, words)
            out.append((_fingerprints(every), len(every), _bitmap(every), xxhash.xxh3_128_digest(every.tobytes())))
        release()
        return pd.DataFrame(out, columns=["fps", "size", "bits", "equal"])

    seen = written(base.select("doc_id", sketch("body").alias("k")).select("doc_id", "k.*"), "near-sketches")
    one = seen.groupBy("doc_id").agg(F.min("equal").alias("equal")).groupBy("equal").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    one = written(one, "near-equal")
    copies = seen.join(one.where("n > 1"), "equal").where("doc_id <> first").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()
    distinct = seen.join(one.select(F.col("first").alias("doc_id"), "equal"), ["doc_id", "equal"]).dropDuplicates(["doc_id"])
    distinct = written(distinct, "near-distinct")
    each = distinct.select("doc_id", F.explode("fps").alias("fp")).distinct()
    fps = each.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    joined = components(links(fps.select("fp"), FP_BITS, FP_BLOCKS)).withColumnRenamed("id", "fp")
    members = each.join(joined, "fp", "left").select("doc_id", F.coalesce("label", "fp").alias("label")).distinct()
    # sets of the same members count once
    sets_of = members.groupBy("label").agg(F.min("doc_id").alias("head"), F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("doc_id").cast("decimal(38,0)")).alias("sum")).where("n > 1")
    sets_of = sets_of.groupBy("head", "n", "sum").agg(F.min("label").alias("label")).select("label", "head", "n")
    members = written(members.join(sets_of, "label").select("label", "doc_id", "head", "n"), "near-members")
    pairs = members.where("doc_id <> head").select("doc_id", "head").distinct()

    @F.pandas_udf("s array<long>, equal binary")
    def shingles(texts: pd.Series) -> pd.DataFrame:
        every = [_shingles(t, words) for t in texts]
        release()
        return pd.DataFrame({"s": [s.view("<i8") for s in every], "equal": [xxhash.xxh3_128_digest(s.tobytes()) for s in every]})

    shingles = shingles.asNondeterministic()  # evaluated once, though a filter and a column read it
    # of rows that share a doc_id those with the shingles of the chosen one
    asked = members.select("doc_id").distinct().join(distinct.select("doc_id", "equal"), "doc_id")
    several = seen.groupBy("doc_id").agg((F.count(F.lit(1)) > 1).alias("several"))
    bodies = base.join(asked.join(several, "doc_id"), "doc_id").select("doc_id", "equal", "several", shingles("body").alias("k"))
    sets = bodies.where(~F.col("several") | (F.col("k.equal") == F.col("equal"))).select("doc_id", "several", F.col("k.s").alias("s"))
    sets = written(sets, "near-sets")
    sets = sets.where(~F.col("several")).select("doc_id", "s").union(sets.where("several").select("doc_id", "s").dropDuplicates(["doc_id"]))

    @F.pandas_udf("double")
    def jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([_jaccard(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    heads = sets.select(F.col("doc_id").alias("head"), F.col("s").alias("t"))
    near = pairs.join(sets, "doc_id").join(heads, "head").where(jaccard("s", "t") >= similarity).select(F.col("doc_id").alias("a"), F.col("head").alias("b"))
    near = written(near, "near-links")
    groups = components(near).select(F.col("id").alias("doc_id"), F.col("label").alias("comp"))
    # what the heads leave: members outside the head's group against each other and against its other members
    grouped = written(members.where("n > 2").join(groups, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "near-grouped")
    main = grouped.where("doc_id = head").select("label", F.col("comp").alias("main"))
    rest = grouped.where("doc_id <> head").join(main, "label").withColumn("rest", F.col("comp") != F.col("main"))
    rest = rest.join(distinct.select("doc_id", "size", "bits"), "doc_id").select("label", "doc_id", "rest", "comp", "size", "bits")
    rest = written(rest, "near-rest")

    def live(pdf: pd.DataFrame) -> pd.DataFrame:
        hit = np.zeros(len(pdf), dtype=bool)
        for x, ys in _open_pairs(pdf, similarity):
            if len(ys):
                hit[x] = True
                hit[ys] = True
        return pdf.loc[hit, ["label", "doc_id"]]

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        root = {c: c for c in pdf["comp"]}

        def find(c):
            while root[c] != c:
                root[c] = c = root[root[c]]
            return c

        ids, comps, hashes, out = pdf["doc_id"].tolist(), pdf["comp"].tolist(), pdf["s"].tolist(), []
        for x, ys in _open_pairs(pdf, similarity):
            for y in ys.tolist():
                a, b = find(comps[x]), find(comps[y])
                if a != b and _jaccard(hashes[x], hashes[y]) >= similarity:
                    root[a] = b
                    out.append((ids[x], ids[y]))
        return pd.DataFrame(out, columns=["a", "b"])

    open_ = _blocks(rest).groupBy("label", "i", "j").applyInPandas(live, "label long, doc_id long").distinct()
    left = written(rest.join(written(open_, "near-open"), ["label", "doc_id"], "left_semi"), "near-left")
    found = _blocks(left).join(sets, "doc_id").groupBy("label", "i", "j").applyInPandas(link, "a long, b long")
    within = groups.select(F.col("doc_id").alias("a"), F.col("comp").alias("b"))
    return components(within.union(found).union(copies)).select(F.col("id").alias("doc_id"), F.col("label").alias("group_id"))


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id, with all its columns."""
    return without(docs, near_duplicates(docs, words, similarity).where("doc_id <> group_id").select("doc_id"))
