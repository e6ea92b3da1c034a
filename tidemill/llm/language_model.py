"""A Katz backoff n-gram model with Good-Turing discounts, counted and evaluated as DataFrame jobs (operator 10).

Texts are tokenised once into blocks of some million tokens, bucketed by block so that they never move again. A block sends
each of its distinct n-grams once to the bucket of the n-gram's context (busy contexts are salted by the word); the bucket
counts, numbers the n-grams, sums what the backoff weights need, stores its part of the model, and answers each block with
counts and sums in the order in which it asked. The next order does the same with the numbers as contexts and the lower
order's probabilities as what is left to back off to. Last, each block evaluates its tokens recursively.

Words go by their 64-bit hash. Probabilities of a context's words and of the rest sum to one exactly; what the training
documents lack is one word, the unknown.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.sources.folders import shared_folder

from .common import stored

K = 5  # counts up to K are discounted
ORDER = 2
BEGIN = -1  # the context at a text's beginning
STOP = 1  # the name of a text's end
BLOCK, BUCKET = 1 << 20, 1 << 20  # tokens of a block, and for which there is a bucket; there are MOST buckets until these have four times as many, so that messages stay large
MOST, FEW = 2000, 24
SCORES = ["n_tokens", "n_known", "base_score", "score"]


def packed(numbers: np.ndarray) -> bytes:
    """Numbers by place of their bytes, compressed: small ones cost little. A few are sent as they are."""
    flat = np.ascontiguousarray(numbers)
    if len(flat) < FEW:
        return b"=" + flat.tobytes()
    return b"z" + zstandard.ZstdCompressor(level=1).compress(flat.view(np.uint8).reshape(len(flat), flat.itemsize).T.tobytes())


def unpacked(raw: bytes, kind: type = np.int64) -> np.ndarray:
    if raw[:1] == b"=":
        return np.frombuffer(raw, kind, offset=1)
    raw, size = raw[1:], np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(size, -1).T).view(kind).ravel()


def coded(values: np.ndarray) -> tuple[bytes, bytes]:
    """Floating-point numbers of which many are equal: the distinct ones, and which each is."""
    own, code = np.unique(values, return_inverse=True)
    return packed(own), packed(code.astype(np.int32))


def decoded(own: bytes, code: bytes) -> np.ndarray:
    return unpacked(own, np.float64)[unpacked(code, np.int32)]


def mixed(x: np.ndarray) -> np.ndarray:
    h = x.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def discounts(of: dict[int, int], k: int = K) -> list[float]:
    """d[r] for counts r of 1 to k, from the numbers of things counted r times; 0.5 / r less where these don't allow Good-Turing's."""
    n = [of.get(r, 0) for r in range(k + 2)]
    shared = (k + 1) * n[k + 1] / n[1] if n[1] else 1.0
    out = [1.0]
    for r in range(1, k + 1):
        d = ((r + 1) * n[r + 1] / (r * n[r]) - shared) / (1 - shared) if n[r] and shared < 1 else -1.0
        out.append(d if 0 < d < 1 else 1 - 0.5 / r)
    return out


@dataclass
class Level:
    """What the driver knows of an order: its discounts, its busy contexts' salts and sums (at most two for each bucket)."""

    buckets: int
    salts: dict[int, int]
    d: list[float] = field(default_factory=list)
    busy: dict[int, tuple] = field(default_factory=dict)  # context: total, n1 to nK, below
    n: int = 0
    v: int = 0

    def dealt(self, context: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The bucket of each n-gram."""
        salt = np.ones(len(context), np.uint64)
        if self.salts:
            known = np.array(sorted(self.salts))
            at = np.minimum(np.searchsorted(known, context), len(known) - 1)
            salt = np.where(known[at] == context, np.array([self.salts[int(c)] for c in known], np.uint64)[at], salt)
        return ((mixed(context) + mixed(word) % salt) % np.uint64(self.buckets)).astype(np.int64)

    def alpha(self, scale: np.ndarray, ones: list[np.ndarray], below: np.ndarray) -> np.ndarray:
        """What a context leaves to what it was not seen with, over what the order below gives that."""
        lost = sum(r * (1 - self.d[r]) * n for r, n in enumerate(ones, 1))
        lost = np.where(lost > 0, lost, 1.0)  # scale is one more than the total where nothing is discounted
        return lost / np.maximum(scale, 1) / np.maximum(1 - below, 1e-12)

    def word(self, c: np.ndarray) -> np.ndarray:
        """Of order 1: probabilities of words by their counts; 0 is the unknown word."""
        total, *ones, below = self.busy.get(0, (0,) * (K + 2))
        scale = np.array([float(total + (not any(ones)))]) if total else np.zeros(1)
        unknown = self.alpha(scale, [np.array([n]) for n in ones], np.zeros(1)) if total else np.ones(1)
        return np.where(c > 0, self.star(c) / np.maximum(scale, 1), unknown)

    def star(self, c: np.ndarray) -> np.ndarray:
        return c * np.array([*self.d, 1.0])[np.minimum(c, K + 1)]


class Numbered(dict):
    def __missing__(self, word: bytes) -> int:
        got = self[word] = len(self)
        return got


def blocks(documents: DataFrame, trained: Column, size: int = BLOCK) -> DataFrame:
    """One row for each block of whole texts, as a table bucketed by block: its rows' other columns and its tokens.

    words numbers the block's distinct words in the order of their first use, STOP being 0; names has their hashes.
    """
    spark = documents.sparkSession
    others = [c for c in documents.columns if c not in ("text", *SCORES)]
    rows = documents.select(F.struct(*others, F.coalesce(trained, F.lit(False)).alias("~trained")).alias("others"), F.coalesce("text", F.lit("")).alias("text"))

    def cut(batches):
        part, number = TaskContext.get().partitionId() << 32, 0
        index, stream, sizes, held = Numbered(), [], [], []

        def block():
            names = np.array([STOP, *(xxhash.xxh64_intdigest(w) for w in list(index)[1:])], np.uint64)
            own = pa.chunked_array(held).combine_chunks()
            listed = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            values = [pa.array([part + number], pa.int64()), listed, *(pa.array([packed(x)], pa.binary()) for x in (np.array(sizes, np.int32), np.array(stream, np.int32), names)), pa.array([len(stream)], pa.int64())]
            return pa.RecordBatch.from_arrays(values, ["block", "others", "sizes", "words", "names", "n"])

        index[b""]
        for batch in batches:
            start = 0
            for i, text in enumerate(batch.column(1)):
                before = len(stream)
                stream.extend(map(index.__getitem__, text.as_py().encode("utf-8", "surrogatepass").lower().split()))
                stream.append(0)
                sizes.append(len(stream) - before)
                if len(stream) >= size:
                    held.append(batch.column(0).slice(start, i + 1 - start))
                    yield block()
                    index.clear()
                    index[b""]
                    stream, sizes, held, start, number = [], [], [], i + 1, number + 1
            if start < batch.num_rows:
                held.append(batch.column(0).slice(start))
        if held:
            yield block()

    kinds = T.StructType().add("block", "long").add("others", T.ArrayType(rows.schema["others"].dataType)).add("sizes", "binary").add("words", "binary").add("names", "binary").add("n", "long")
    name = f"tidemill_blocks_{uuid.uuid4().hex}"
    buckets = min(100_000, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows.mapInArrow(cut, kinds).write.bucketBy(buckets, "block").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    return spark.table(name)


class Grams:
    """A block's distinct n-grams, order by order, with what buckets answered."""

    def __init__(self, sizes: bytes, words: bytes, names: bytes, trained: np.ndarray):
        self.sizes, self.stream, self.names = unpacked(sizes, np.int32), unpacked(words, np.int32).astype(np.int64), unpacked(names)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.trained = np.repeat(trained, self.sizes)
        self.at, self.word, self.rank = self.stream, np.arange(len(self.names)), 1  # each token's n-gram, each n-gram's last word
        self.context, self.lower = np.zeros(len(self.names), np.int64), np.zeros(len(self.names))
        self.ids = np.zeros(len(self.names), np.int64)
        self.p = np.ones(len(self.names))

    def step(self) -> None:
        """From order rank to the next: contexts are the n-grams of the token before."""
        before = np.concatenate([[0], self.at[:-1] + 1])
        before[self.starts] = 0  # BEGIN
        key, first, at = np.unique(before * len(self.names) + self.stream, return_index=True, return_inverse=True)
        contexts = np.concatenate([[BEGIN], self.ids])
        self.context, self.word = contexts[key // len(self.names)], key % len(self.names)
        self.lower, self.at, self.rank = self.p[self.at[first]], at, self.rank + 1

    def asked(self, level: Level, names: np.ndarray) -> tuple[np.ndarray, ...]:
        """(order, bucket, context, word) of the n-grams as they are sent: by bucket, context, word."""
        word = names[self.word]
        bucket = level.dealt(self.context, word)
        order = np.lexsort((word, self.context, bucket))
        return order, bucket[order], self.context[order], word[order]

    def answered(self, level: Level, names: np.ndarray, answers: dict[int, list[bytes]]) -> np.ndarray:
        """Takes the buckets' answers: ids, p (probabilities at this order). Returns counts."""
        order, bucket, context, _ = self.asked(level, names)
        new = np.concatenate([[True], (np.diff(context) != 0) | (np.diff(bucket) != 0)])
        asked = np.unique(bucket)
        counts, ids, scale, *ones = (np.concatenate([unpacked(answers[b][k]) for b in asked]) for k in range(3 + K))
        below = np.concatenate([decoded(*answers[b][3 + K :]) for b in asked])
        of = np.cumsum(new) - 1
        own, open_ = context[new], np.zeros(len(scale), bool)
        open_[of[counts == 0]] = True
        alpha = np.ones(len(scale))  # of what training lacks
        alpha[open_] = level.alpha(scale[open_], ones, below)
        scale = scale.astype(float)
        for x in np.flatnonzero(np.isin(own, list(level.busy))):
            total, *some, under = level.busy[int(own[x])]
            scale[x] = total + (not any(some)) if total else 0
            alpha[x] = level.alpha(scale[x : x + 1], [np.array([n]) for n in some], np.array([under]))[0]
        alpha[scale == 0] = 1.0
        c, at = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
        c[order], at[order] = counts, of
        if len(ids):
            ids[order] = ids.copy()
        unseen = alpha[at] if self.rank == 1 else alpha[at] * self.lower  # at order 1 that is the unknown word's probability
        scale = np.maximum(scale, 1)[at]
        self.ids, self.p = ids, np.where(c > 0, level.star(c) / scale, unseen)
        return c


def ready(row: dict, levels: list[Level], k: int) -> tuple[Grams, np.ndarray, np.ndarray]:
    """A block at order k, all lower orders answered; its words' ids and counts."""
    grams = Grams(row["sizes"], row["words"], row["names"], np.array([x["~trained"] for x in row["others"]], bool))
    answers: dict[int, dict[int, list[bytes]]] = {}
    for a in row.get("answers") or ():
        answers.setdefault(a["rank"], {})[a["bucket"]] = a["payload"]
    names, counts = grams.names, np.zeros(0, np.int64)
    for rank in range(1, k + 1):
        if rank > 1:
            grams.step()
        if rank in answers:
            c = grams.answered(levels[rank - 1], names, answers[rank])
            if rank == 1:
                names, counts = grams.ids, c
    return grams, names, counts


def asked(blocks_: DataFrame, levels: list[Level], k: int, more: bool) -> DataFrame:
    """(bucket, block, ...): each block's distinct n-grams of order k, once for each bucket. more: another order follows."""

    def of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                grams, names, counts = ready(row, levels, k)
                order, bucket, context, word = grams.asked(levels[k - 1], names)
                n = np.bincount(grams.at[grams.trained], minlength=len(order))[order]
                every = np.bincount(grams.at, minlength=len(order))[order] if more else n[:0]
                lower = lambda a, b: coded(held[a:b]) if k > 2 else (packed(held[:0]), packed(held[a:b]))
                if k == 2:  # a word's probability is told by its count
                    held = np.where(n > 0, counts[grams.word][order] if len(counts) else 0, 0).astype(np.int32)
                else:
                    held = np.where(n > 0, grams.lower[order], 0.0)
                cuts = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0, [True]]))
                out: list[list] = [[] for _ in MESSAGE]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    own, size = np.unique(context[a:b], return_counts=True)
                    values = [int(bucket[a]), row["block"], *map(packed, (own, size, word[a:b], n[a:b], every[a:b])), *lower(a, b)]
                    for column, value in zip(out, values, strict=True):
                        column.append(value)
                kinds = [pa.int32(), pa.int64()] + [pa.binary()] * (len(MESSAGE) - 2)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], MESSAGE)

    wanted = ["block", F.transform("others", lambda x: F.struct(x["~trained"].alias("~trained"))).alias("others"), "sizes", "words", "names", *(c for c in blocks_.columns if c == "answers")]
    return blocks_.select(*wanted).mapInArrow(of, ", ".join(f"{m} {dict(bucket='int', block='long').get(m, 'binary')}" for m in MESSAGE))


MESSAGE = ["bucket", "block", "context", "size", "word", "n", "every", "lower", "code"]
TABLE = "kind string, block long, bucket int, context long, word long, id long, c long, ones array<long>, below double, payload array<binary>"
ARROW = pa.schema([("kind", pa.string()), ("block", pa.int64()), ("bucket", pa.int32()), ("context", pa.int64()), ("word", pa.int64()), ("id", pa.int64()), ("c", pa.int64()), ("ones", pa.list_(pa.int64())), ("below", pa.float64()), ("payload", pa.list_(pa.binary()))])


def counted(messages: DataFrame, levels: list[Level], large: int, last: bool) -> DataFrame:
    """One bucket at a time: answers to blocks, the model's n-grams and contexts, sums of busy contexts, n-grams used over large times.

    An answer holds counts, ids (none at the last order), contexts' scales, and what alpha needs for contexts that the
    block has an unseen n-gram of.
    """

    def rows(kind: str, n: int, **columns) -> pa.Table:
        return pa.table([pa.array([kind] * n) if f.name == "kind" else pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in ARROW], schema=ARROW)

    level, k = levels[-1], len(levels)

    def of(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        parts = [{name: table.column(name)[i].as_py() for name in table.schema.names} for i in range(table.num_rows)]
        sizes = [unpacked(p["size"]) for p in parts]
        context = np.concatenate([np.repeat(unpacked(p["context"]), s) for p, s in zip(parts, sizes, strict=True)])
        word, n, every = (np.concatenate([unpacked(p[k]) for p in parts]) for k in ("word", "n", "every"))
        lower = np.concatenate([levels[0].word(unpacked(p["code"], np.int32)) if k == 2 else decoded(p["lower"], p["code"]) if k > 2 else np.zeros(len(unpacked(p["word"]))) for p in parts])
        order = np.lexsort((word, context))
        new = np.concatenate([[True], (np.diff(context[order]) != 0) | (np.diff(word[order]) != 0)])
        first = np.flatnonzero(new)
        gram = np.empty(len(order), np.int64)
        gram[order] = np.cumsum(new) - 1
        c, used = np.add.reduceat(n[order], first), first if last else np.add.reduceat(every[order], first)
        own, words = context[order][first], word[order][first]
        ids = np.arange(len(first)) * level.buckets + bucket
        head = np.flatnonzero(np.concatenate([[True], np.diff(own) != 0]))
        total = np.add.reduceat(c, head)
        ones = [np.add.reduceat((c == r).astype(np.int64), head) for r in range(1, K + 1)]
        below = np.add.reduceat(np.where(c > 0, np.maximum.reduceat(lower[order], first), 0.0), head)  # blocks without training text send 0
        heads, scale = own[head], np.where(total > 0, total + (sum(ones) == 0), 0)

        out, at = [], 0
        for p, s in zip(parts, sizes, strict=True):
            here = gram[at : at + int(s.sum())]
            told = np.searchsorted(heads, unpacked(p["context"]))
            unseen = told[np.add.reduceat(c[here] == 0, np.cumsum(s) - s) > 0]
            payload = [*map(packed, (c[here], ids[here[: 0 if last else None]], scale[told], *(o[unseen] for o in ones))), *coded(below[unseen])]
            out.append(rows("answer", 1, block=[p["block"]], bucket=[bucket], payload=[payload]))
            at += len(here)
        out.append(rows("total", 1, c=[int(c.sum())], id=[int((c > 0).sum())], ones=[[int((c == r).sum()) for r in range(1, K + 2)]]))
        busy = np.isin(heads, list(level.salts))
        for kind, which in (("busy", np.flatnonzero(busy)), ("context", np.flatnonzero(~busy & (total > 0)))):
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, K * len(which) + 1, K, dtype=np.int32)), pa.array(np.stack([o[which] for o in ones], axis=1).ravel()))
            out.append(rows(kind, len(which), context=heads[which], c=total[which], ones=lists, below=below[which]))
        often = np.flatnonzero(used > large) if not last else first[:0]
        out.append(rows("large", len(often), id=ids[often], c=used[often]))
        have = np.flatnonzero(c > 0)
        out.append(rows("gram", len(have), context=own[have], word=words[have], c=c[have], **({} if last else {"id": ids[have]})))
        return pa.concat_tables(out)

    return messages.groupBy("bucket").applyInArrow(of, TABLE)


@dataclass
class Model:
    """The stored tables by order, and what the driver knows of each. unknown: the unknown word's probability."""

    tables: list[DataFrame]
    levels: list[Level]

    @property
    def unknown(self) -> float:
        return float(self.contexts(1).first().alpha) if self.levels[0].n else 1.0

    def contexts(self, k: int) -> DataFrame:
        """(context, scale, alpha) of order k; a context is the id of an n-gram of the order below, BEGIN, or 0 at order 1."""
        level = self.levels[k - 1]
        spark = self.tables[0].sparkSession
        busy = spark.createDataFrame([(c, n, list(ones), below) for c, (n, *ones, below) in level.busy.items()], "context long, c long, ones array<long>, below double")
        every = self.tables[k - 1].where("kind = 'context'").select("context", "c", "ones", "below").unionByName(busy).where("c > 0")
        lost = reduce(lambda a, b: a + b, [F.get("ones", r - 1) * (r * (1 - level.d[r])) for r in range(1, K + 1)])
        scale = F.when(lost > 0, F.col("c")).otherwise(F.col("c") + 1)
        return every.select("context", scale.alias("scale"), (F.when(lost > 0, lost).otherwise(1.0) / scale / F.greatest(1 - F.col("below"), F.lit(1e-12))).alias("alpha"))

    def grams(self, k: int) -> DataFrame:
        """(context, word, id, c, p) of order k; word is the word's id (at order 1 its hash)."""
        level = self.levels[k - 1]
        star = F.col("c").cast("double")
        for r in range(1, K + 1):
            star = F.when(F.col("c") == r, F.lit(r * level.d[r])).otherwise(star)
        found = self.tables[k - 1].where("kind = 'gram'").select("context", "word", "id", "c")
        return found.join(self.contexts(k).select("context", "scale"), "context").withColumn("p", star / F.col("scale")).drop("scale")


def answers(table: DataFrame, k: int) -> DataFrame:
    return table.where("kind = 'answer'").select("block", F.struct(F.lit(k).alias("rank"), "bucket", "payload").alias("answer"))


def with_answers(blocks_: DataFrame, tables: list[DataFrame]) -> DataFrame:
    every = reduce(DataFrame.unionByName, [answers(t, k) for k, t in enumerate(tables, 1)])
    return blocks_.join(every.groupBy("block").agg(F.collect_list("answer").alias("answers")), "block")


def fitted(documents: DataFrame, trained: Column, order: int = ORDER, block: int = BLOCK, bucket: int = BUCKET) -> tuple[Model, DataFrame]:
    """The model of documents' texts where trained holds, and every row's scores: see scored()."""
    held = blocks(documents, trained, block)
    total = held.agg(F.sum("n").alias("n"), F.sum(F.size("others")).alias("rows")).first()
    n = total.n or 0
    buckets = max(1, n // min(max(bucket, n // MOST), 4 * bucket))
    tables: list[DataFrame] = []
    levels = [Level(buckets, {0: buckets})]
    share = -(-(total.n or 0) // buckets)  # what is used oftener than a bucket has tokens is salted
    for k in range(1, order + 1):
        level = levels[-1]
        seen = with_answers(held, tables) if tables else held
        table = stored(counted(asked(seen, levels, k, k < order), levels, share, k == order), f"grams-{k}")
        totals = table.where("kind = 'total'").agg(F.sum("c").alias("n"), F.sum("id").alias("v"), *(F.sum(F.get("ones", r)).alias(f"n{r + 1}") for r in range(K + 1))).first()
        level.n, level.v = int(totals.n or 0), int(totals.v or 0)
        level.d = discounts({r: int(totals[f"n{r}"] or 0) for r in range(1, K + 2)})
        sums = table.where("kind = 'busy'").groupBy("context").agg(F.sum("c").alias("c"), *(F.sum(F.get("ones", r)).alias(f"n{r}") for r in range(K)), F.sum("below").alias("below"))
        level.busy = {r.context: (int(r.c), *(int(r[f"n{i}"]) for i in range(K)), float(r.below)) for r in sums.collect()}  # at most two a bucket
        tables.append(table)
        if k < order:
            large = {r.id: r.c for r in table.where("kind = 'large'").select("id", "c").collect()}  # at most one a bucket
            if (total.rows or 0) > share:
                large[BEGIN] = total.rows
            levels.append(Level(buckets, {i: min(buckets, -(-c * 2 // share)) for i, c in large.items()}))
    return Model(tables, levels), evaluated(with_answers(held, tables), levels)


def evaluated(blocks_: DataFrame, levels: list[Level]) -> DataFrame:
    """Every row's other columns, n_tokens, n_known, base_score and score."""
    known = blocks_.schema["others"].dataType.elementType
    order = len(levels)

    def of(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names if name != "others"}
                others = batch.column("others")[i].values
                row["others"] = [{"~trained": x} for x in others.field("~trained").to_pylist()]
                grams, _, counts = ready(row, levels, order)
                c = counts[grams.stream]
                base = np.log10((c + 1) / (levels[0].n + levels[0].v + 1))
                sums = [grams.sizes.astype(np.int64), *(np.add.reduceat(x, grams.starts) for x in ((c > 0).astype(np.int64), base, np.log10(grams.p)[grams.at]))]
                names = [f.name for f in known.fields if f.name != "~trained"]
                yield pa.RecordBatch.from_arrays([*(others.field(n) for n in names), *map(pa.array, sums)], [*names, *SCORES])

    kinds = T.StructType([f for f in known.fields if f.name != "~trained"]).add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")
    return blocks_.select("others", "sizes", "words", "names", "answers").mapInArrow(of, kinds)


def scored(documents: DataFrame, trained: Column, order: int = ORDER) -> DataFrame:
    """Every row of documents without its text, with n_tokens, n_known, base_score and score.

    The model learns from rows where trained holds (null: not). A token's probability is its n-gram's if training has that, else its
    context's backoff weight (1 if training lacks the context) times the probability that the order below gives it, down to
    the word's own, an unknown word's included. Columns that have the scores' names are replaced.
    """
    return fitted(documents, trained, order)[1]


def scores(documents: DataFrame, folds: int = 7, fold: int = 2, order: int = ORDER) -> DataFrame:
    """One row per document row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Trained on all documents outside the held-out fold. base_score takes (c + 1) / (N + 1 * (V + 1)) for each token. Null
    and empty texts have one token, their end. A null doc_id counts as an empty one, outside or inside the fold by its
    hash. Without training documents all words are unknown and a token's probability is 1 (base_score: 1 / 1).
    """
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == fold
    model, found = fitted(documents.select("doc_id", held.alias("held_out"), "text"), ~F.col("held_out"), order)
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.levels[0].n).cast("long").alias("train_tokens"), "base_score", "score")


def perplexity(score: float, n_tokens: int) -> float:
    return 10 ** (-score / n_tokens) if n_tokens else math.nan
