"""Near-duplicate documents over five-word shingles by op7's ball hashing and by MinHash bands, verified by exact Jaccard (the pipeline's stage).

SimHash fingerprints of five-word shingles meet in the middle of balls, as in op7; what they connect is compared. A radius of fingerprints
cannot stand for a similarity alone: edited copies at Jaccard 0.8 differ in 3 to 11 bits or more. Those are met by bands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import connected_components, small, stored
from .passages import Chunk, WordHashes, candidates, chunks, clustered, links

#: Shingles are of SHINGLE words (Chunk's); a pair at Jaccard 0.8 shares one of 12 bands of 3 MinHashes with 1 - 0.488^12 > 0.9998.
SHINGLE, JACCARD, ROWS, BANDS = 5, 0.8, 3, 12
#: Bits in which op7's ball hashing lets fingerprints differ.
RADIUS = 2
#: Whole texts are long: smaller blocks and calls than for paragraphs.
BLOCK, CALL_ROWS = 128, 1024
_r = np.random.default_rng(17)
MULTIPLY = _r.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
ADD = _r.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)


def named(text: str | None) -> int:
    """The word sequence's name; texts without words have one."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split())) - (1 << 63)


def fingerprint(shingles: np.ndarray) -> int:
    """The SimHash of a text's shingles, repeats included: a bit is set if it is in over half of them."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), simhash.CHUNK):
        counts += np.unpackbits(shingles[at : at + simhash.CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(shingles), bitorder="little").view(np.int64)[0])


def balls(table: DataFrame) -> DataFrame:
    """(unit, band) of table (unit, fp): what op7's ball hashing connects by fingerprints of at most RADIUS different bits is a band."""
    each = stored(table.where("fp IS NOT NULL").select("unit", "fp").distinct(), "fingerprints")
    linked = connected_components(simhash.links(each.select("fp").distinct(), RADIUS)).withColumnRenamed("id", "fp")
    return each.join(linked, "fp", "left").select("unit", F.xxhash64(F.lit("fp"), F.coalesce("component", "fp")).alias("band"))


def prints(documents: DataFrame) -> DataFrame:
    """(doc_id, ~text, unit, fp, bands) of every row. A text of fewer than SHINGLE words is like equal ones only and has neither bands nor a fingerprint."""

    def of(batches):
        hashes = WordHashes()
        for batch in batches:
            for at, texts in chunks(batch.column(2)):
                chunk = Chunk(texts, hashes)
                first, last = chunk.bounds[:-1], chunk.bounds[1:]
                long = last - first >= SHINGLE
                found = chunk.bands(first[long], last[long], MULTIPLY, ADD, ROWS)
                fps = [fingerprint(chunk.shingles[a : b - SHINGLE + 1]) if b - a >= SHINGLE else None for a, b in zip(first, last, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(long * BANDS)]).astype(np.int32)), pa.array(found.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(map(named, texts), pa.int64()), pa.array(fps, pa.int64()), lists], ["doc_id", "~text", "unit", "fp", "bands"])

    return documents.select("doc_id", F.xxhash64("text").alias("~text"), "text").mapInArrow(of, f"doc_id {dict(documents.dtypes)['doc_id']}, `~text` long, unit long, fp long, bands array<long>")


def shingles(texts: DataFrame) -> DataFrame:
    """(unit, cluster, shingles array<long>) of texts (unit, cluster, text)."""

    def of(batches):
        hashes = WordHashes()
        for batch in batches:
            for at, held in chunks(batch.column(2)):
                chunk = Chunk(held, hashes)
                sets = [np.unique(chunk.shingles[a : max(a, b - SHINGLE + 1)]).view(np.int64) for a, b in zip(chunk.bounds, chunk.bounds[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), batch.column(1).slice(at, len(held)), pa.array(sets, pa.list_(pa.int64()))], ["unit", "cluster", "shingles"])

    return texts.select("unit", "cluster", "text").mapInArrow(of, "unit long, cluster long, shingles array<long>")


def without_copies(documents: DataFrame, least: float = JACCARD) -> DataFrame:
    """Rows of documents (doc_id, text and others): of each group the one of the smallest doc_id.

    A group is what pairs of texts connect whose shingles have a Jaccard similarity of least or more; texts are compared as
    their words, lower-cased (A-Z). Texts that share a doc_id are documents of their own, of one doc_id the text of the
    smallest hash is kept. Of rows that agree in both, the smallest stays. Rows without a doc_id stay.
    """
    columns = documents.columns
    keyed = documents.where("doc_id IS NOT NULL").withColumn("~text", F.xxhash64("text"))
    table = stored(prints(documents.where("doc_id IS NOT NULL")), "prints")
    rows = table.groupBy("unit", "doc_id", "~text").agg(F.count("*").alias("n"))
    classes = stored(rows.groupBy("unit").agg(F.min(F.struct("doc_id", "~text", "n")).alias("first")), "classes")
    members = candidates(table.select("unit", F.explode("bands").alias("band")).unionByName(balls(table)))
    wanted = stored(classes.join(small(clustered(members)), "unit").select("unit", "cluster", "first.doc_id", "first.~text"), "wanted")
    sets = stored(shingles(keyed.join(small(wanted), ["doc_id", "~text"])), "shingles")
    if sets.count() > wanted.count():
        sets = sets.dropDuplicates(["unit"])  # rows that repeat a document repeat its text
    linked = connected_components(links(members, sets, least, BLOCK, CALL_ROWS)).withColumnRenamed("id", "unit")
    grouped = classes.join(linked, "unit", "left").groupBy(F.coalesce("component", "unit").alias("component")).agg(F.min("first").alias("first"))
    kept = stored(grouped.select("first.*"), "kept")
    one = keyed.join(small(kept.where("n = 1")), ["doc_id", "~text"], "left_semi").select(columns)
    again = keyed.join(small(kept.where("n > 1")), ["doc_id", "~text"], "left_semi")
    again = again.groupBy("doc_id", "~text").agg(F.min(F.struct(*columns)).alias("row")).select("row.*")
    return one.unionByName(again).unionByName(documents.where("doc_id IS NULL"))
