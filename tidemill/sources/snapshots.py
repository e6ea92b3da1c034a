"""Snapshot tables: a new version is written beside the old one, then named by a small pointer; nothing is overwritten while read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, folder: str) -> str:
    """Writes a version and a pointer to it; returns the version's name."""
    version = uuid.uuid4().hex
    df.write.parquet(f"{folder}/versions/{version}")
    pointer = df.sparkSession.range(1).select(F.lit(version).alias("version"), F.current_timestamp().alias("written"))
    pointer.coalesce(1).write.mode("append").parquet(f"{folder}/pointers")
    return version


def load(spark: SparkSession, folder: str) -> DataFrame:
    """The version that was named last."""
    last = spark.read.parquet(f"{folder}/pointers").orderBy(F.desc("written")).first()
    return spark.read.parquet(f"{folder}/versions/{last.version}")


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def upserted_parts(new: DataFrame, folder: str, by: str, key: list[str]) -> None:
    """Puts rows into a table that is laid out by a column (a day, a kind): those of the same key are replaced, parts that no row falls in aren't touched.

    Only the parts that new rows fall in are read and written again; a part's old files go when its new ones are all there. key is unique in
    new; by may be one of it. The first call makes the table.
    """
    spark = new.sparkSession
    if exists(spark, folder):
        old = spark.read.schema(new.schema).parquet(folder)
        old = old.join(F.broadcast(new.select(by).distinct()), by, "left_semi")  # as many rows as there are parts to be written
        new = new.unionByName(old.join(new.select(*dict.fromkeys([by, *key])), [*dict.fromkeys([by, *key])], "left_anti"))
    new.write.partitionBy(by).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)


def served(kinds: DataFrame, live: DataFrame, saved: DataFrame) -> DataFrame:
    """(kind, origin, ok, ...): for each of kinds (kind) the live rows, else those saved last, else one row that is not ok.

    live and saved have kind and the same other columns. A kind counts as live if it has any live row.
    """
    here = kinds.select("kind").distinct()
    fetched = live.select("kind").distinct()
    now = live.join(here, "kind", "left_semi").withColumn("origin", F.lit("live"))
    kept = saved.join(here, "kind", "left_semi").join(fetched, "kind", "left_anti").withColumn("origin", F.lit("snapshot"))
    none = here.join(fetched, "kind", "left_anti").join(saved.select("kind").distinct(), "kind", "left_anti").withColumn("origin", F.lit("none"))
    out = now.unionByName(kept).unionByName(none, allowMissingColumns=True)
    return out.select("kind", "origin", (F.col("origin") != "none").alias("ok"), *[c for c in live.columns if c != "kind"])
