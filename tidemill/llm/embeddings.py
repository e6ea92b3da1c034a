"""Embedding near-duplicates by random-hyperplane sign hashing (operator 9).

Equal vectors of a label are one class first. Each table hashes a class's direction by the signs of its products with
random hyperplanes; classes of one bucket are compared exactly, in blocks, and a pair counts in the first table that holds
it. A large bucket is cut into blocks and each pair of blocks is a task of its own: nothing is capped and no pair of
vectors is ever a row; a block's task gives for each vector its number of links and a few links that connect as much.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, least_linked, paired_blocks, small, stored

#: 28 tables of 18 bits: a pair at cosine 0.98 differs in a bit with probability 0.0638, shares a table with 1 - (1 - 0.305)^28 > 0.9999.
TABLES, BITS, SEED, LEAST = 28, 18, 7, 0.98
BLOCK = 512  # classes in a block of a large bucket


def planes(dims: int, tables: int, bits: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, tables * bits))


def signatures(vectors: np.ndarray, tables: int, bits: int) -> np.ndarray:
    """Signs of (n, dims) vectors as (n, tables) numbers."""
    signs = (vectors @ planes(vectors.shape[1], tables, bits) > 0).reshape(len(vectors), tables, bits)
    return (signs * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)


def usable(vector):
    """Whether a vector can be compared: not null, no null or non-finite components, not zero."""
    wide = F.transform(vector, lambda x: x.cast("double"))
    return F.coalesce(vector.isNotNull() & ~F.exists(wide, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(wide, lambda x: x != 0), F.lit(False))


def classes(embeddings: DataFrame) -> DataFrame:
    """(key, class_id, label, vector array<double>, n): distinct comparable vectors of a label; class_id is the smallest vec_id.

    key is unique, as class_id need not be: rows of one vec_id can have several labels or vectors. It holds once it is stored.
    """
    rows = embeddings.where(usable(F.col("embedding")) & F.col("label").isNotNull()).select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("vector"))
    return rows.groupBy("label", "vector").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("n")).withColumn("key", F.monotonically_increasing_id())


def signed(found: DataFrame, tables: int, bits: int) -> DataFrame:
    """classes() with dims and signs array<long>: each class's bucket in every table, computed once."""

    def hashed(frames):
        for frame in frames:
            if len(frame):
                dims = frame["vector"].map(len).to_numpy()
                for d in np.unique(dims):
                    part = frame[dims == d]
                    yield part.assign(dims=d, signs=list(signatures(np.stack(part["vector"].to_numpy()), tables, bits)))

    kinds = dict(found.dtypes)
    columns = ["key", "class_id", "label", "vector", "n"]
    return found.select(columns).mapInPandas(hashed, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", dims int, signs array<long>")


def compared(table: int, block: pd.DataFrame, least: float) -> pd.DataFrame:
    """Links of one pair of blocks in one bucket: for each class its number of linked vectors, and the least linked key.

    A pair counts only in the first table whose bucket it shares. The other column names the smallest class that a class
    hangs together with in this pair of blocks.
    """
    side = block["side"].to_numpy()
    vectors = np.stack(block["vector"].to_numpy())
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    vectors = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    signs, ids, n = np.stack(block["signs"].to_numpy()), block["key"].to_numpy(), block["n"].to_numpy()
    one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    near = vectors[one] @ vectors[two].T >= least
    near &= ids[one][:, None] != ids[two][None]
    for t in range(table):
        near &= signs[one, t][:, None] != signs[two, t][None]
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, one, near @ n[two])
    if not np.array_equal(one, two):
        np.add.at(links, two, near.T @ n[one])
    least_id = least_linked(near, one, two, ids)
    told = np.flatnonzero(links)
    return pd.DataFrame({"key": ids[told], "other": least_id[told], "links": links[told]})


def near_duplicates(embeddings: DataFrame, least: float = LEAST, tables: int = TABLES, bits: int = BITS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. Only vec_id, embedding and label are read.

    Vectors are compared where labels are equal and not null, with vectors of as many components. Vectors that are null,
    zero or hold null or non-finite components link with nothing, nor do vectors without a label: n_links 0, their own
    component. Repeated rows are vectors of their own and link with each other; their vec_id is one. A null vec_id stays a
    row, names a component only where there is no other id, and is never kept.
    """
    rows = embeddings.select("vec_id", "embedding", "label")
    found = stored(signed(classes(rows), tables, bits), "classes")
    where = ["label", "dims", "table_id", "bucket"]
    many = found.select("key", "label", "dims", F.posexplode("signs").alias("table_id", "bucket"))
    spread = paired_blocks(many, where, "key", BLOCK).join(found.select("key", "vector", "signs", "n"), "key")

    def links(frame: pd.DataFrame) -> pd.DataFrame:
        parts = [compared(int(block["table_id"].iloc[0]), block, least) for _, block in frame.groupby("group", sort=False)]
        return pd.concat(parts, ignore_index=True)

    told = spread.groupBy("bin").applyInPandas(links, "key long, other long, links long")
    told = stored(told, "links")
    counts = told.groupBy("key").agg(F.sum("links").alias("links"))
    named = connected_components(told.select(F.col("key").alias("a"), F.col("other").alias("b"))).withColumnRenamed("id", "key")
    known = found.drop("signs").join(counts, "key", "left").join(named, "key", "left").withColumn("component", F.coalesce("component", "key"))
    first = small(stored(known.groupBy("component").agg(F.min("class_id").alias("component_id")), "components"))
    known = stored(known.join(first, "component").select("label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "known")
    vector = F.when(usable(F.col("embedding")) & F.col("label").isNotNull(), F.transform("embedding", lambda x: x.cast("double") + 0.0))
    keyed = rows.select("vec_id", "label", vector.alias("vector"))
    single = keyed.where(F.col("vector").isNull()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    shared = keyed.where(F.col("vector").isNotNull()).join(known, ["label", "vector"]).select("vec_id", "n_links", "component_id")
    every = single.unionByName(shared)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
