"""Trees given by parents, in any order: depth and depth-first order by pointer doubling, in rounds that grow with the logarithm of the depth."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shared_dir(df: DataFrame) -> str:
    """The folder that driver and executors share. Only a local session may do without one, as in tests."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        base = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not base and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return context.getCheckpointDir().rstrip("/")


def stored(df: DataFrame) -> DataFrame:
    """df cut off from its lineage by a checkpoint in the shared folder."""
    shared_dir(df)
    return df.checkpoint()


def rooted(nodes: DataFrame) -> DataFrame:
    """nodes (tree, id, parent, ..) with parent null where it is not a node of the tree or the node itself."""
    ids = nodes.select("tree", F.col("id").alias("parent"), F.lit(True).alias("known")).distinct()
    return nodes.join(ids, ["tree", "parent"], "left").withColumn("parent", F.when(F.col("known") & (F.col("parent") != F.col("id")), F.col("parent"))).drop("known")


def saved(df: DataFrame) -> DataFrame:
    """df as stored() keeps it, for columns of plain types: in compressed columns, a small part of a checkpoint's bytes."""
    return _read([_write(df)], df)


def _write(df: DataFrame) -> str:
    path = f"{shared_dir(df)}/trees-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return path


def _read(paths: list[str], like: DataFrame) -> DataFrame:
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def _code(n: Column) -> Column:
    """Bytes that sort as the numbers do, none the beginning of another: one below 224, else one with their count in front."""
    digits = F.hex(n)
    return F.when(n < 224, F.unhex(digits)).otherwise(F.concat(F.unhex(F.hex(F.floor((F.length(digits) + 1) / 2) + 224)), F.unhex(digits)))


def ordered(nodes: DataFrame, deepest: int | None = None, adopt: bool = False) -> DataFrame:
    """nodes (tree, id, parent, pos, level) -> (tree, id, depth, path) of all that hang on a root.

    level is what a node adds to the depth of what is below it, 1 as a rule and 0 for a node that is passed over; depth is 1
    plus the levels of the ancestors. Nodes sort depth first by path: place and id of the root, then a byte for each node on
    the way down, its number among its siblings (more bytes from the 225th on). Each round doubles how far every node has seen
    and joins only those that have not seen a root; those alone are written, so the plan does not grow with the depth. Nodes
    on a ring of parents hang on no root and are left out, and so are those deeper than `deepest` as soon as they are known to
    be, with all below them. With `adopt` nodes whose parent is not there or is the node itself are roots, as after rooted().
    """
    near = lambda df: df if deepest is None else df.where(F.col("levels") < deepest)
    base = nodes.select("tree", "id", "parent", "pos", F.coalesce("level", F.lit(1)).cast("long").alias("level"))
    up = base.select("tree", F.col("id").alias("parent"), F.col("level").alias("above"))
    number = F.row_number().over(Window.partitionBy("tree", "parent").orderBy("pos", "id")) - 1
    start = base.withColumn("number", number).join(up, ["tree", "parent"], "left")
    parent = F.when(F.col("above").isNotNull() & (F.col("parent") != F.col("id")), F.col("parent")) if adopt else F.col("parent")
    start = start.withColumn("up", parent)
    below = F.col("up").isNotNull()
    start = start.select("tree", "id", "up", F.when(below, F.coalesce("above", F.lit(0))).otherwise(0).cast("long").alias("levels"), F.col("pos").alias("top_pos"), F.col("id").alias("top"), F.when(below, _code(F.col("number"))).otherwise(F.unhex(F.lit(""))).alias("way"), F.lit(1).cast("long").alias("seen"))
    paths = [_write(start)]
    first = _read(paths, start)
    most = first.groupBy("tree").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    seen, todo = 1, first.where("up is not null")
    while seen < most and not todo.isEmpty():  # as many rounds as the logarithm of the depth; a ring ends at the size of its tree
        now = _read(paths, start).where(F.col("up").isNull() | (F.col("seen") == seen))  # what a node saw in earlier rounds is out of date
        far = now.select("tree", F.col("id").alias("up"), F.col("up").alias("next"), F.col("levels").alias("more"), "top_pos", "top", F.col("way").alias("before"))
        moved = todo.select("tree", "id", "up", "levels", "way").join(far, ["tree", "up"])
        seen *= 2
        paths.append(_write(near(moved.select("tree", "id", F.col("next").alias("up"), (F.col("levels") + F.col("more")).alias("levels"), "top_pos", "top", F.concat("before", "way").alias("way"), F.lit(seen).cast("long").alias("seen")))))
        todo = _read(paths[-1:], start).where("up is not null")
    path = F.struct(F.col("top_pos").alias("pos"), F.col("top").alias("id"), "way")
    return near(_read(paths, start).where("up is null")).select("tree", "id", (F.col("levels") + 1).cast("int").alias("depth"), path.alias("path"))


def shown(found: DataFrame, most: int, deepest: int) -> DataFrame:
    """(tree, id, depth, place, top): the first `most` nodes of ordered() in depth-first order that are no deeper than `deepest`;
    top is the root above."""
    place = F.row_number().over(Window.partitionBy("tree").orderBy("path"))
    return found.where(F.col("depth") <= deepest).withColumn("place", place).where(F.col("place") <= most).select("tree", "id", "depth", "place", F.col("path.id").alias("top"))
