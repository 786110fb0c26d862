"""Connected components of an undirected edge list, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(a, b) long pairs -> (id, label): label is the smallest id reachable from id.

    Each round takes the least label among the neighbours and then that label's own label (pointer jumping), so rounds
    grow with the logarithm of a component's diameter. Every round is written to the shared folder. Its joins always shuffle:
    Spark sizes a table by its files, and ids pack so well that it would broadcast millions of rows. Nulls and self loops link
    nothing; an empty edge list gives an empty table.
    """
    pairs = edges.where("a is not null and b is not null and a <> b").select("a", "b")
    both = written(pairs.union(pairs.select(F.col("b"), F.col("a"))).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("label")), "cc-labels")
    while True:
        near = both.join(labels.hint("merge"), both["b"] == labels["id"]).groupBy(both["a"].alias("id")).agg(F.min("label").alias("near"))
        step = labels.join(near.hint("merge"), "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.select(F.col("id").alias("up_id"), F.col("label").alias("up"))
        step = step.join(up.hint("merge"), step["label"] == up["up_id"]).select("id", "old", F.least("label", "up").alias("label"))
        step = written(step, "cc-labels")
        labels = step.select("id", "label")
        if not step.where("old <> label").limit(1).count():
            return labels
