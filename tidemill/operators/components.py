"""Connected components of tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.storage import removed, written


def connected(pairs: DataFrame) -> DataFrame:
    """(article_id, part) for every id in pairs (later, earlier): part is the smallest id reachable.

    Labels fall to the least of the neighbours' labels, then jump to their label's label, so that a chain costs rounds by the
    logarithm of its length. A round is a written table, and the one before goes.
    """
    both = pairs.select(F.col("later").alias("a"), F.col("earlier").alias("b"))
    both = written(both.union(both.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("article_id")).agg(F.least(F.col("article_id"), F.min("b")).alias("part")), "parts")
    while True:
        near = both.join(labels.withColumnRenamed("article_id", "b"), "b").groupBy(F.col("a").alias("article_id")).agg(F.min("part").alias("near"))
        fallen = written(labels.join(near, "article_id").select("article_id", F.least("part", "near").alias("part"), F.col("part").alias("was")), "parts")
        roots = fallen.select("part").distinct().join(fallen.select(F.col("article_id").alias("part"), F.col("part").alias("up")), "part")
        jumped = written(fallen.join(roots, "part").select("article_id", F.col("up").alias("part"), (F.col("up") != F.col("was")).alias("moved")), "parts")
        removed(labels)
        removed(fallen)
        labels = jumped.select("article_id", "part")
        if jumped.where("moved").isEmpty():
            removed(both)
            return labels
