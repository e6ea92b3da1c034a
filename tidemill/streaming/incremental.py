"""An extension: the batch operators over streams, with availableNow for scheduled runs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidemill.functions import times
from tidemill.operators import articles
from tidemill.sources import snapshots


def first_seen(spark: SparkSession, folder: str, schema, key: str, at: str, late: str = "1 day") -> DataFrame:
    """A stream of a folder's rows, the first of each key within the watermark."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def counted(stream: DataFrame, at: str, by: str, every: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Counts by window and key, with late rows up to the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, every), by).agg(F.count("*").alias("n"))


def drained(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Writes all that has come so far, exactly once, and ends."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def deduplicated(items: DataFrame, folder: str, checkpoint: str) -> None:
    """Takes all items (title, url, content, ...) that have come into a table of articles that are new: normalised, best of their batch, in no earlier batch.

    The table is laid out by batch; a batch that runs again after a failure reads what earlier ones left and replaces its own part, so that no
    item is taken twice or lost.
    """
    def taken(batch: DataFrame, number: int) -> None:
        won = articles.batch_winners(articles.normalized(batch).where("drop_reason IS NULL"))
        if snapshots.exists(batch.sparkSession, folder):
            before = batch.sparkSession.read.parquet(folder).where(F.col("batch") < number)
            won = articles.fresh(won, before.select("dedup_url", "content_hash"))
        won.withColumn("batch", F.lit(number)).write.partitionBy("batch").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(folder)

    items.writeStream.foreachBatch(taken).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


STREAK = "fetches long, successes long, failures long, gone boolean"


def streaks(attempts: DataFrame) -> DataFrame:
    """(source_name, fetches, successes, consecutive_failures, gone) of each source that attempts of a trigger touch, by a state of four values per source.

    attempts: source_name, at, attempt_id, ok, gone; a trigger's attempts come after those of earlier ones and are taken in order of at and attempt_id.
    """
    def counted(key, frames, state):
        fetches, successes, failures, gone = state.get if state.exists else (0, 0, 0, False)
        rows = pd.concat(list(frames)).sort_values(["at", "attempt_id"])
        ok = rows["ok"].to_numpy(bool)
        fetches, successes = fetches + len(ok), successes + int(ok.sum())
        failures = int(len(ok) - 1 - ok.nonzero()[0][-1]) if ok.any() else failures + len(ok)
        state.update((fetches, successes, failures, bool(rows["gone"].iloc[-1])))
        yield pd.DataFrame([(key[0], fetches, successes, failures, bool(rows["gone"].iloc[-1]))], columns=["source_name", "fetches", "successes", "consecutive_failures", "gone"]).astype({"source_name": object})

    return attempts.groupBy("source_name").applyInPandasWithState(counted, "source_name string, fetches long, successes long, consecutive_failures long, gone boolean", STREAK, "update", GroupStateTimeout.NoTimeout)


def health(attempts: DataFrame, folder: str, checkpoint: str) -> None:
    """Keeps a table of sources' health, one row each, up to date with all attempts that have come; parts of sources that none touches stay."""
    def kept(batch: DataFrame, number: int) -> None:
        rate = F.when(F.col("fetches") > 0, times.rounded(F.col("successes") / F.col("fetches") * 10000) / 100).otherwise(0.0)
        told = batch.withColumn("success_rate", rate).withColumn("cooldown_seconds", times.cooldown_seconds(F.col("consecutive_failures"), F.col("gone"))).drop("gone")
        snapshots.upserted_parts(told.withColumn("part", F.pmod(F.xxhash64("source_name"), F.lit(16))), folder, "part", ["source_name"])

    streaks(attempts).writeStream.outputMode("update").foreachBatch(kept).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
