"""Helpers that the training-data operators share: shared storage and connected components."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.sources.folders import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def stored(df: DataFrame, name: str = "table", compression: str = "zstd") -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and every executor can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spent(table: DataFrame) -> None:
    """Removes the files of a stored() table that nothing reads any more."""
    context = table.sparkSession.sparkContext
    for file in table.inputFiles()[:1]:
        path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("tidemill-"):
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


#: Rows and bytes up to which a table goes to every executor. Beyond either the same join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 64 << 20
#: Tasks that write a table of so few rows, at most.
FEW_TASKS = 16


def fits(df: DataFrame) -> bool:
    """Whether df's rows, counted, and their bytes, summed, are few enough to go to every executor."""
    wide = [c for c, kind in df.dtypes if kind in ("string", "binary") or kind.startswith(("array", "map", "struct"))]
    bytes_of = [F.octet_length(c) if kind in ("string", "binary") else 8 * F.size(c) if kind == "array<bigint>" else F.octet_length(F.to_json(F.struct(c))) for c, kind in df.dtypes if c in wide]
    row = sum((F.coalesce(b, F.lit(0)) for b in bytes_of), F.lit(16 * len(df.columns)))
    held = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row), F.lit(0)).alias("bytes")).first()
    return held.n <= BROADCAST_ROWS and held.bytes <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df, marked for broadcast if it fits()."""
    return F.broadcast(df) if fits(df) else df


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in edges (a, b); component is the smallest id reachable.

    Labels fall to the smallest neighbour's label, then jump to their label's label, so that rounds grow with the
    logarithm of a chain's length. A link that is named several times, either way round, counts once before its ends are written. Each round is a
    written table; the one before is removed. Labels that fit() come to the edges,
    and a round shuffles only partial minima; of more labels both joins are between plain exchanges, which Spark splits
    where a component or a hub holds much of the rows; what follows is partial sums. Null ends and loops are ignored; ids
    in no edge get no row.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(edges.select(F.explode(ends).alias("e")).select("e.*"), "edges")  # edges, computed again, may name their ends the other way round
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("component")).withColumn("component", F.least("id", "component")), "labels")
    while True:
        near = labels.withColumnRenamed("id", "b")
        met = both.join(F.broadcast(near) if (few := fits(near)) else near, "b").select(F.col("a").alias("id"), "component", F.lit(None).cast(near.schema["component"].dataType).alias("was"))
        met = met.union(labels.select("id", "component", F.col("component").alias("was"))).groupBy("id").agg(F.min("component").alias("component"), F.max("was").alias("was"))
        fallen = stored(met.coalesce(FEW_TASKS) if few else met, "labels")
        up = fallen.select(F.col("id").alias("component"), F.col("component").alias("up"))
        up = F.broadcast(up) if fits(up) else small(stored(fallen.select("component").distinct().join(up, "component"), "roots"))
        jumped = stored(fallen.join(up, "component").select("id", F.col("up").alias("component"), (F.col("up") != F.col("was")).alias("moved")), "labels")
        spent(labels)
        spent(fallen)
        labels = jumped.select("id", "component")
        if jumped.where("moved").isEmpty():
            spent(both)
            return labels


#: Members of a block, and rows that one call of a pair comparison gets on average.
BLOCK, BIN_ROWS = 512, 4096


def paired_blocks(members: DataFrame, keys: list[str], item: str, block: int | None = None, rows: int | None = None) -> DataFrame:
    """members with bin, group and side: what has to be compared with what, for buckets of any size.

    members has distinct (*keys, item). A bucket of one has no rows. A large bucket is cut into blocks by the items' hash;
    each pair of blocks (and each block alone) is a group, so that no group grows with its bucket. side is 0 or 1 for the
    two blocks of a pair, 2 for a block alone. bin deals the groups out evenly, rows (BIN_ROWS) each.
    """
    sizes = members.groupBy(keys).agg(F.count("*").alias("~size")).where(F.col("~size") > 1).withColumn("~blocks", F.ceil(F.col("~size") / (block or BLOCK)).cast("int"))
    own = members.join(sizes, keys).withColumn("~own", F.pmod(F.xxhash64(item), F.col("~blocks")).cast("int"))
    spread = own.withColumn("~against", F.explode(F.sequence(F.lit(0), F.col("~blocks") - 1)))
    low, high = F.least("~own", "~against"), F.greatest("~own", "~against")
    side = F.when(low == high, F.lit(2)).when(F.col("~own") == low, F.lit(0)).otherwise(1)
    spread = stored(spread.select(*members.columns, F.xxhash64(*keys, low, high).alias("group"), side.alias("side")), "blocks")
    bins = max(1, spread.count() // (rows or BIN_ROWS))
    return spread.withColumn("bin", F.pmod("group", F.lit(bins)))


def least_linked(near: np.ndarray, one: np.ndarray, two: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each id the smallest id that it hangs together with; near[i, j] links ids[one[i]] with ids[two[j]]."""
    least, before, top = ids.copy(), None, np.iinfo(np.int64).max
    while before is None or not np.array_equal(before, least):
        before = least.copy()
        least[one] = np.minimum(least[one], np.where(near, least[two][None], top).min(axis=1))
        least[two] = np.minimum(least[two], np.where(near, least[one][:, None], top).min(axis=0))
    return least
