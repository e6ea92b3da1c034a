"""Written tables in the shared folder, and broadcasts of a checked size."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.folders import shared_folder

#: Rows up to which a table of ids and numbers goes to every executor. Beyond it the same join shuffles.
FEW_ROWS = 400_000


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: lineage ends there, and every executor can read it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tidemill-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(table: DataFrame) -> None:
    """Removes the files of a written() table that nothing reads any more."""
    context = table.sparkSession.sparkContext
    for file in table.inputFiles()[:1]:
        path = context._jvm.org.apache.hadoop.fs.Path(file).getParent()
        if path.getName().startswith("tidemill-"):
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def few(table: DataFrame) -> DataFrame:
    """A table of ids and numbers, marked for broadcast if its rows, counted, are few enough."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table
