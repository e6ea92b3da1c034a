"""Ranked lexical search over hashed max-sketches (operator 12).

index() keeps of each document its terms' 64-bit hashes with their counts, and a sketch: a term's hash names a coordinate, and
a coordinate holds the greatest of its terms' impacts. A document's impact grows with a term's count and nothing else of the
term, so that the sketch holds counts, and new documents leave old sketches right when averages move. search() looks up
all queries of a block in a batch's sketches at once: sums of weighted impacts are upper bounds. Each task takes documents
in descending order of bounds, scores them exactly, and stops where no bound reaches its k-th best score. The tasks' best meet at the end.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored
from .passages import WordHashes

TOP = 10
#: A sketch has at least WIDE coordinates for each different term, and LEAST_WIDE at least. A count of FULL stands for itself and all above.
WIDE, LEAST_WIDE, FULL = 4, 64, 255
#: Queries and their terms that a pass over the index answers at once, on average; bytes of texts, and documents, that a task handles at once.
QUERIES, TERMS, BYTES, ROWS = 256, 16_384, 1 << 20, 512
#: Documents of a batch that are scored for a query before its threshold is looked at again.
STEP = 16
#: A-Z in lower case, every other sign that is neither digit, letter nor beyond ASCII a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
SCALE = 1_000_000_000


def counted(texts: list[bytes], hashes: WordHashes) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(terms, different terms' hashes in order, their counts) of each text."""
    split = [t.translate(FOLDED).split() for t in texts]
    every = np.fromiter((hashes[w] for words in split for w in words), np.uint64, sum(map(len, split))).view(np.int64)
    ends = np.cumsum([len(words) for words in split])
    return [(e - s, *np.unique(every[s:e], return_counts=True)) for s, e in zip([0, *ends[:-1]], ends, strict=True)]


def sketch(terms: np.ndarray, counts: np.ndarray) -> bytes:
    """The greatest count, FULL at most, of the terms of each coordinate; a power of two of coordinates."""
    wide = max(LEAST_WIDE, 1 << int(WIDE * len(terms) - 1).bit_length()) if len(terms) else LEAST_WIDE
    out = np.zeros(wide, np.uint8)
    np.maximum.at(out, terms & (wide - 1), np.minimum(counts, FULL).astype(np.uint8))
    return out.tobytes()


def portions(texts):
    """(first place, texts as bytes) of a column of texts, BYTES in all or one text."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        held.append(text.as_py() or b"")
        size += len(held[-1])
        if size >= BYTES:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


@dataclass
class Index:
    """documents (doc_id, n, terms, counts, sketch) and, over those with terms, how many they are and how many terms they have."""

    documents: DataFrame
    n_documents: int
    n_terms: int


def index(documents: DataFrame) -> Index:
    """The index of whole texts; doc_id and text are read. Null and wordless texts have no terms and can't be found."""

    def of(batches):
        hashes = WordHashes()
        for batch in batches:
            for at, texts in portions(batch.column(1)):
                found = counted(texts, hashes)
                lists = [pa.ListArray.from_arrays(np.cumsum([0, *(len(f[1]) for f in found)]).astype(np.int32), pa.array(np.concatenate([f[k] for f in found]).astype(kind))) for k, kind in ((1, np.int64), (2, np.int32))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), pa.array([int(f[0]) for f in found], pa.int64()), *lists, pa.array([sketch(*f[1:]) for f in found], pa.binary())], ["doc_id", "n", "terms", "counts", "sketch"])

    read = documents.select("doc_id", F.col("text").cast("binary").alias("text")).where("length(text) > 0")
    table = stored(read.mapInArrow(of, f"doc_id {dict(documents.dtypes)['doc_id']}, n long, terms array<long>, counts array<int>, sketch binary").where("n > 0"), "index")
    sums = table.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    return Index(table, sums["n"], sums["terms"])


def asked(queries: DataFrame, found: Index) -> DataFrame:
    """(query, item_id, term, weight) of queries (item_id, text): their different terms that documents hold, once each.

    Every row of queries is a query of its own. A term's weight falls with the number of documents that hold it.
    """

    def of(batches):
        hashes = WordHashes()
        for batch in batches:
            for at, texts in portions(batch.column(2)):
                terms = [f[1] for f in counted(texts, hashes)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)), pa.array(terms, pa.list_(pa.int64()))], ["query", "item_id", "terms"])

    read = stored(queries.select(F.monotonically_increasing_id().alias("query"), "item_id", F.col("text").cast("binary").alias("text")), "queries")
    terms = stored(read.mapInArrow(of, f"query long, item_id {dict(queries.dtypes)['item_id']}, terms array<long>").select("query", "item_id", F.explode("terms").alias("term")), "asked")
    held = found.documents.select(F.explode("terms").alias("term")).join(small(terms.select("term").distinct()), "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(found.n_documents) + 2) / (2 * F.col("df") + 1))).cast("long")
    return stored(terms.join(small(held), "term").select("query", "item_id", "term", weight.alias("weight")).where("weight > 0"), "weights")


class Block:
    """A block of queries as arrays: terms in order, weights (terms, queries), and each query's terms and weights, padded."""

    def __init__(self, rows: list[tuple[int, int, int]]):
        self.queries = sorted({q for q, _, _ in rows})
        self.terms = np.unique(np.array([t for _, t, _ in rows], np.int64))
        place = {q: k for k, q in enumerate(self.queries)}
        each: list[list[tuple[int, int]]] = [[] for _ in self.queries]
        for (q, _, w), at in zip(rows, np.searchsorted(self.terms, [t for _, t, _ in rows]), strict=True):
            each[place[q]].append((int(at), w))
        self.weights = np.zeros((len(self.terms), len(each)))
        self.at = np.zeros((len(each), max(map(len, each))), np.int64)
        self.of = np.zeros(self.at.shape, np.int64)
        for k, pairs in enumerate(each):
            for j, (at, w) in enumerate(pairs):
                self.weights[at, k], self.at[k, j], self.of[k, j] = w, at, w


class Best:
    """The k best (score, document) of each query so far, and the score that a further one has to reach."""

    def __init__(self, queries: int, k: int):
        self.k, self.held, self.reach = k, [[] for _ in range(queries)], np.ones(queries)

    def add(self, query: int, score: int, document) -> None:
        held = self.held[query]
        held.append((-score, document is None, document if document is not None else 0))
        if len(held) > self.k:
            held.sort()
            held.pop()
        if len(held) == self.k:
            self.reach[query] = max(1, -max(held)[0])


def bounds(block: Block, sketches: list[bytes], long: np.ndarray) -> np.ndarray:
    """(documents, queries): at least what documents of these sketches score; long is 8 times each one's share of length."""
    out, wide = np.empty((len(sketches), len(block.queries))), np.array([len(s) for s in sketches])
    for w in np.unique(wide):
        rows = np.flatnonzero(wide == w)
        counts = np.frombuffer(b"".join(sketches[r] for r in rows), np.uint8).reshape(len(rows), w)[:, block.terms & (w - 1)].astype(float)
        impact = np.where(counts == FULL, SCALE / 1000, SCALE * counts / (1000 * counts + long[rows, None]))
        out[rows] = impact @ block.weights
    return out + (out > 0)  # more than rounding can take away


def impacts(block: Block, starts: np.ndarray, terms: np.ndarray, counts: np.ndarray, long: np.ndarray) -> np.ndarray:
    """(documents, terms): exact impacts of the block's terms."""
    at = np.minimum(np.searchsorted(block.terms, terms), len(block.terms) - 1)
    hit = block.terms[at] == terms
    document = np.repeat(np.arange(len(long)), np.diff(starts))[hit]
    out = np.zeros((len(long), len(block.terms)), np.int64)
    out[document, at[hit]] = SCALE * counts[hit].astype(np.int64) // (1000 * counts[hit].astype(np.int64) + long[document])
    return out


def rescored(block: Block, best: Best, upper: np.ndarray, exact: np.ndarray, ids: list) -> None:
    """Scores a batch's documents in descending order of their bounds, for all queries side by side, until no bound reaches a query's k-th best."""
    order = np.argsort(-upper, axis=0)
    for at in range(0, len(upper), STEP):
        rows = order[at : at + STEP]
        k, query = np.nonzero(np.take_along_axis(upper, rows, 0) >= best.reach)
        if not len(k):
            return
        document = rows[k, query]
        score = (exact[document[:, None], block.at[query]] * block.of[query]).sum(axis=1)
        for j in np.flatnonzero(score >= best.reach[query]):
            if score[j] >= best.reach[query[j]]:
                best.add(query[j], int(score[j]), ids[document[j]])


def found_by(table: DataFrame, block: Block, n_documents: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc_id, score): of each task's documents the k best of each query of the block."""
    kind = dict(table.dtypes)["doc_id"]

    def of(batches):
        best = Best(len(block.queries), k)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                long = 8 * (10 + 90 * part.column(1).to_numpy() * n_documents // n_terms)
                upper = bounds(block, part.column(4).to_pylist(), long)
                near = np.flatnonzero((upper >= best.reach).any(axis=1))  # the others' terms aren't looked at
                if len(near):
                    terms, counts = part.column(2).take(pa.array(near)), part.column(3).take(pa.array(near))
                    exact = impacts(block, terms.offsets.to_numpy() - terms.offsets[0].as_py(), terms.flatten().to_numpy(), counts.flatten().to_numpy(), long[near])
                    rescored(block, best, upper[near], exact, part.column(0).take(pa.array(near)).to_pylist())
        rows = [(block.queries[q], None if none else document, -score) for q, held in enumerate(best.held) for score, none, document in held]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], part.column(0).type), pa.array([r[2] for r in rows], pa.int64())], ["query", "doc_id", "score"])

    return table.select("doc_id", "n", "terms", "counts", "sketch").mapInArrow(of, f"query long, doc_id {kind}, score long")


def search(found: Index, queries: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): each query's k best documents with a score above 0, equal scores by doc_id, null last.

    queries: item_id, text; each row is a query, repeated ones too, and a null or wordless text has no rows. Documents that
    share a doc_id are documents of their own. An empty index or table of queries gives no rows. The result is exact: a term stands for its
    64-bit hash, and nothing is left out whose bound reaches the k-th best score. Queries go in blocks of a bounded number of
    terms, each a pass over the index, so that what a task holds doesn't grow with the queries.
    """
    terms = asked(queries, found)
    sizes = terms.agg(F.count("*").alias("n"), F.count_distinct("query").alias("queries")).first()
    blocks = max(1, -(-sizes["n"] // TERMS), -(-sizes["queries"] // QUERIES))
    out = None
    for b in range(blocks):
        rows = [tuple(r) for r in terms.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).select("query", "term", "weight").collect()]  # TERMS on average
        if rows:
            got = found_by(found.documents, Block(rows), found.n_documents, found.n_terms, k)
            out = got if out is None else out.unionByName(got)
    if out is None:
        out = found.documents.limit(0).select(F.lit(0).cast("long").alias("query"), "doc_id", F.lit(0).cast("long").alias("score"))
    order = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    named = terms.select("query", "item_id").distinct()
    return stored(out, "found").withColumn("rank", order).where(F.col("rank") <= k).join(small(named), "query").select("item_id", "rank", "doc_id", "score")


def ranked(documents: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """search() in an index made of documents (doc_id, text)."""
    return search(index(documents), queries, k)
