"""SimHash near-duplicates by meet-in-the-middle ball hashing (operator 7).

Every fingerprint emits all variants within half the radius. Two fingerprints within the radius share a variant, and all
fingerprints in one variant's bucket lie within the radius of each other, so a bucket has at most as many members as a
ball has points (65 at radius 2), whatever the data. Equal fingerprints are one member: copies are grouped first.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, stored

SEED = 42
CHUNK = 1 << 16  # shingles hashed and counted at a time, so that a very long text needs bounded memory


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The text's fingerprint as a signed 64-bit number; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    total, counts, digest = max(1, len(words) - shingle + 1), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    for at in range(0, total, CHUNK):
        parts = [words[at + k : min(at + k + CHUNK, total + k)] for k in range(shingle)]
        hashes = np.array([digest(b" ".join(x), SEED) for x in zip(*parts, strict=True)], np.uint64)
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(counts * 2 > total, bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp long) of every row. Null and empty texts have fingerprint 0."""

    def of(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint(x.as_py(), shingle) for x in batch.column(1)], pa.int64())], ["doc_id", "fp"])

    return documents.select("doc_id", "text").mapInArrow(of, f"doc_id {dict(documents.dtypes)['doc_id']}, fp long")


def ball(radius: int) -> list[int]:
    """Masks of at most radius bits, as signed 64-bit numbers."""
    masks = [sum(1 << b for b in bits) for n in range(radius + 1) for bits in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links that connect what all pairs of distinct fingerprints within the radius connect.

    prints has one row for each fingerprint (fp). Within a bucket each member is linked with the smallest one. An even
    radius is needed for the half radius to be exact; an odd one is halved upwards and the links are verified.
    """
    half = (radius + 1) // 2
    variants = prints.repartition("fp").select("fp", F.explode(F.array(*[F.col("fp").bitwiseXOR(F.lit(m)) for m in ball(half)])).alias("variant"))
    buckets = variants.groupBy("variant").agg(F.collect_set("fp").alias("members")).where(F.size("members") > 1)
    if radius == 2 * half:
        pairs = buckets.select(F.array_min("members").alias("a"), F.explode("members").alias("b"))
    else:
        pairs = buckets.select(F.explode("members").alias("a"), "members").select("a", F.explode("members").alias("b"))
    return pairs.where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)).distinct()


def near_duplicates(documents: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links of at most radius bits.

    documents needs doc_id and text; other columns are ignored. Every row gives a row, repeated rows too. Null and empty
    texts have fingerprint zero and are linked like any other. A null doc_id is never a component's name unless a
    component has no other (then component_id is null).
    """
    prints = stored(fingerprints(documents, shingle), "fingerprints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    linked = connected_components(links(classes, radius)).withColumnRenamed("id", "fp")
    grouped = linked.join(classes, "fp")
    named = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    linked = linked.join(named, "component").select("fp", "component_id")
    of = stored(classes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id")), "classes")
    return prints.join(of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
