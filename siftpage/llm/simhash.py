"""SimHash near-duplicates, found through tables of distances to reference fingerprints."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, written
from .components import components

REFERENCES = 8  # reference fingerprints; each also with one block of bits turned over
BLOCKS = 8


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _references() -> list[int]:
    return [xxhash.xxh64_intdigest(b"reference %d" % j, 42) for j in range(REFERENCES)]


def fingerprint(words: int):
    """A pandas UDF: text -> 64-bit SimHash of its word shingles, as a signed long."""

    @F.pandas_udf("long")
    def simhash(texts: pd.Series) -> pd.Series:
        from itertools import repeat

        import numpy as np

        out = np.zeros(len(texts), dtype="<u8")
        for i, text in enumerate(texts):
            w = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
            if not w:
                continue
            grams = [b" ".join(w)] if len(w) < words else map(b" ".join, zip(*(w[j:] for j in range(words))))
            h = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), dtype="<u8")
            ones = np.zeros(64, dtype=np.int64)
            for at in range(0, len(h), 65536):
                ones += np.unpackbits(h[at : at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0]
        return pd.Series(out.view("<i8"))

    return simhash


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) for every row; a text without words has fingerprint zero."""
    return id_and_text(docs).select("doc_id", fingerprint(words)("body").alias("fp"))


def _distance(fp: Column, reference: int) -> Column:
    return F.bit_count(fp.bitwiseXOR(F.lit(_signed(reference))))


def links(fps: DataFrame, bits: int = 2, blocks: int = BLOCKS) -> DataFrame:
    """Pairs (a, b), a < b, of different fingerprints at `bits` or fewer differing bits. fps: distinct column fp.

    Each fingerprint gets its distances to the reference fingerprints and to their copies with one of `blocks` blocks turned
    over. Two of these coordinates give the distance within one block, so fingerprints that agree in a block have equal
    coordinates there. At most `bits` blocks differ, so a pair meets under the coordinates of the others for some choice of
    `bits` blocks left out: no pair is lost. Pairs whose coordinates differ by more than `bits` anywhere are discarded and
    the rest verified. A bucket holds different fingerprints that differ in `bits` blocks alone, so its size has a bound
    that the input does not move.
    """
    width = 64 // blocks
    masks = [((1 << width) - 1) << (width * b) for b in range(blocks)]
    fp = F.col("fp")
    refs = _references()
    far = [_distance(fp, r).alias(f"d{j}") for j, r in enumerate(refs)]
    turned = [_distance(fp, r ^ m).alias(f"t{j}_{b}") for j, r in enumerate(refs) for b, m in enumerate(masks)]
    coords = fps.select("fp", *far, *turned)
    within = [sum((F.shiftleft(F.shiftright(F.lit(width) + F.col(f"d{j}") - F.col(f"t{j}_{b}"), 1).cast("long"), width.bit_length() * j) for j in range(REFERENCES)), F.lit(0).cast("long")).alias(f"b{b}") for b in range(blocks)]
    packed = sum((F.shiftleft(F.col(f"d{j}").cast("long"), 7 * j) for j in range(REFERENCES)), F.lit(0).cast("long")).alias("pivots")
    coords = coords.select("fp", packed, *within)
    keys = [F.xxhash64(F.lit(i), *(F.col(f"b{b}") for b in range(blocks) if b not in out)) for i, out in enumerate(combinations(range(blocks), bits))]
    keyed = coords.select("fp", "pivots", F.explode(F.array(*keys)).alias("key"))
    x, y = keyed.alias("x"), keyed.alias("y")
    # Spark takes keyed for as small as fps and would broadcast it, though it has a row for each of the keys
    pairs = x.join(y.hint("merge"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")))
    apart = [F.abs(F.shiftright("x.pivots", 7 * j).bitwiseAND(127) - F.shiftright("y.pivots", 7 * j).bitwiseAND(127)) for j in range(REFERENCES)]
    pairs = pairs.where(F.greatest(*apart) <= bits).where(F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= bits)
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()


def near_groups(docs: DataFrame, words: int = 3, bits: int = 2) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable).

    Copies share a fingerprint and are one node of the graph, so no pairs of copies are made. Null and empty texts have
    fingerprint zero and link like any other. Rows with a null doc_id take part but never name a component unless it has no
    other id. Repeated rows each get their row. An empty table gives an empty result; other columns are ignored.
    """
    fps = written(fingerprints(docs, words), "simhash-fps")
    nodes = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = components(links(nodes.select("fp"), bits)).withColumnRenamed("id", "fp")
    nodes = nodes.join(labels.hint("merge"), "fp", "left").select("fp", "first_id", F.coalesce("label", "fp").alias("label"))
    roots = nodes.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = nodes.join(roots.hint("merge"), "label").select("fp", "component_id")
    return fps.join(named.hint("merge"), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
