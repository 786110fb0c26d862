"""Exact dedup: 128-bit content hash, bytes compared inside each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, id_and_text


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    keep is "min" or "max": which id of a group of equal texts stays. Texts are grouped by MD5 and by the text itself, so
    the grouping compares bytes and a collision of hashes makes two groups; partial aggregation reduces a hot group to one
    row per task before the shuffle. The rows then meet their group by hashes alone, so texts cross the network once at
    most. Two different texts that share MD5 and SHA-256 would raise an error instead of being merged.

    Null text counts as empty. A null id never becomes keep_id unless a group has no other; repeated rows count each time
    and share `kept`. An empty table gives an empty result; other columns are ignored.
    """
    base = id_and_text(docs, id_col, text_col)
    pick = {"min": F.min, "max": F.max}[keep]
    hashes = [F.unhex(F.md5("body")).alias("h"), F.sha2("body", 256).alias("text_sha256")]
    groups = base.groupBy(F.unhex(F.md5("body")).alias("h"), "body").agg(pick("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.select("h", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    groups = groups.groupBy("h", "text_sha256").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts"))
    clash = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share MD5 and SHA-256")).cast("long"))
    groups = groups.withColumn("group_size", F.coalesce(clash, "group_size")).drop("texts")
    return base.select("doc_id", *hashes).join(groups, ["h", "text_sha256"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame, keep: str = "min") -> DataFrame:
    """The documents that stay, with all their columns."""
    kept = exact_groups(docs, keep).where("kept").select("doc_id").distinct().toDF(*fresh(docs, "kept"))
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept[kept.columns[0]]), "left_semi")
