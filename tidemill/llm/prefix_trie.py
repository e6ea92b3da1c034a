"""Conversation prefix trie by double arrays (operator 13).

Distinct turn sequences are dealt out by prefix: a prefix with more than LIMIT turns behind it is shared and cut one turn
further, until each part is bounded. A shard packs its parts in one trie, BASE and CHECK over turn ids dense in the shard,
walks its sequences through it and sums from the leaves up. Nodes below a shared prefix belong to one shard and are done;
the shared upper nodes' aggregates are merged over all shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .mixing import n_words

#: Turns behind a prefix that is not cut further, turns that a shard has on average, depths looked at first, ids named in one part of a list.
LIMIT, SHARD, DEPTHS, LISTED = 8192, 16_384, 8, 4096
ROOT = b"\0" * 16
FAMILY, HEADS = 20, 4
NODE = "prefix binary, parent binary, path array<binary>, shared boolean, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved long, words long, ends string"


class DoubleArray:
    """A trie of distinct sequences of ids from 0: the child of slot s by id is t = base[s] + id if check[t] is s. The root is slot 0."""

    def __init__(self, sequences: list[list[int]]):
        self.base, self.check, self._free = [0], [0], 1
        ordered = sorted(sequences)
        work = [(0, 0, len(ordered), 0)]
        while work:
            slot, low, high, depth = work.pop()
            if low < high and len(ordered[low]) == depth:
                low += 1  # the sequence that ends here comes first
            starts = [i for i in range(low, high) if i == low or ordered[i][depth] != ordered[i - 1][depth]]
            ids = [ordered[i][depth] for i in starts]
            if ids:
                self.base[slot] = self._place(ids)
                for i, first, after in zip(ids, starts, [*starts[1:], high], strict=True):
                    self.check[self.base[slot] + i] = slot
                    work.append((self.base[slot] + i, first, after, depth + 1))

    def _place(self, ids: list[int]) -> int:
        """A base at which the slots of all ids, in order, are free; grows the arrays."""
        while self._free < len(self.check) and self.check[self._free] >= 0:
            self._free += 1
        at = self._free
        while True:
            base = at - ids[0]
            grown = base + ids[-1] + 1 - len(self.check)
            if grown > 0:
                self.check += [-1] * grown
                self.base += [0] * grown
            if all(self.check[base + i] < 0 for i in ids):
                return base
            at += 1

    def walk(self, ids: list[int]):
        """The slots after each id of a sequence; ends where there is no child."""
        slot = 0
        for i in ids:
            after = self.base[slot] + i
            if not (0 < after < len(self.check) and self.check[after] == slot):
                return
            slot = after
            yield slot


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<digest, words>>): the first turns of a family's first conversation, then the own ones behind as many.

    digest names role and text; null ones are empty. Turns are in order of turn, null first, then of role and digest. A
    conversation's turns meet in one task as digests. Rows without a conv_id belong to none.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = F.struct("turn", role.alias("role"), F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"), n_words(text).alias("words"))
    own = conversations.where("conv_id IS NOT NULL").select("conv_id", turn.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    own = stored(own.select("conv_id", F.transform("t", lambda t: F.struct(t["digest"].alias("digest"), t["words"].alias("words"))).alias("turns")), "turns")
    heads = own.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("family"), F.slice("turns", 1, HEADS - 1).alias("head"))
    n = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int")
    both = own.withColumn("family", F.col("conv_id") - F.col("conv_id") % FAMILY).withColumn("n", n).join(heads, "family", "left")
    head = F.slice(F.coalesce("head", F.slice("turns", 1, 0)), F.lit(1), F.col("n"))
    return both.select("conv_id", F.concat(head, F.slice("turns", F.col("n") + 1, F.size("turns"))).alias("turns"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, name, prefixes, digests, words): rebuilt turns, with a name for each prefix; the last one is the sequence's."""

    def of(batches):
        for batch in batches:
            digests, names, prefixes = [[t["digest"] for t in turns] for turns in batch.column(1).to_pylist()], [], []
            for turns in digests:
                at, named = ROOT, []
                for t in turns:
                    at = hashlib.md5(at + t).digest()
                    named.append(at)
                names.append(at)
                prefixes.append(named)
            words = [[t["words"] for t in turns] for turns in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.binary()), pa.array(prefixes, pa.list_(pa.binary())), pa.array(digests, pa.list_(pa.binary())), pa.array(words, pa.list_(pa.int64()))], ["conv_id", "name", "prefixes", "digests", "words"])

    return rebuilt(conversations).mapInArrow(of, "conv_id long, name binary, prefixes array<binary>, digests array<binary>, words array<long>")


def ends(named: DataFrame) -> DataFrame:
    """(name, n, conv_id, ends) of named (name, conv_id): how many conversations have this sequence, the smallest, and their ids' digest.

    Ids are listed in parts of at most LISTED; a sequence's parts then pass through one digest in order, one at a time.
    """
    part = F.expr(f"conv_id div {LISTED}").alias("part")
    parts = named.groupBy("name", part).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select("name", F.col("ids")[0].alias("conv_id"), F.size("ids").alias("n"), F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("listed"))

    def digested(batches):
        name = None
        for batch in batches:
            done = []
            for new, first, n, listed in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                if new != name:
                    if name is not None:
                        done.append((name, total, least, digest.hexdigest()))
                    name, total, least, digest = new, 0, first, hashlib.sha256()
                digest.update(("," if total else "").encode() + listed.encode())
                total += n
            yield pa.RecordBatch.from_pylist([dict(zip(("name", "n", "conv_id", "ends"), d, strict=True)) for d in done], schema)
        if name is not None:
            yield pa.RecordBatch.from_pylist([{"name": name, "n": total, "conv_id": least, "ends": digest.hexdigest()}], schema)

    schema = pa.schema([("name", pa.binary()), ("n", pa.int64()), ("conv_id", pa.int64()), ("ends", pa.string())])
    return parts.repartition("name").sortWithinPartitions("name", "conv_id").mapInArrow(digested, "name binary, n long, conv_id long, ends string")


def shared_prefixes(sequences: DataFrame, limit: int) -> DataFrame:
    """(prefix, depth): prefixes of two or more sequences with more than limit turns behind them; all their prefixes are among them.

    Depths are looked at in growing strides, each only behind prefixes that were still shared at the end of the one before.
    """
    rows, low, width, found = sequences.select("prefixes"), 1, DEPTHS, None
    while True:
        each = rows.select(F.size("prefixes").alias("size"), F.posexplode(F.slice("prefixes", low, width)).alias("at", "prefix"))
        heavy = each.groupBy("prefix").agg((F.max("at") + low).cast("int").alias("depth"), F.count("*").alias("n"), F.sum(F.col("size") - F.col("at") - low).alias("behind"))
        heavy = stored(heavy.where((F.col("n") > 1) & (F.col("behind") > limit)).select("prefix", "depth"), "shared")
        found = heavy if found is None else found.unionByName(heavy)
        last = heavy.where(F.col("depth") == low + width - 1)
        if last.isEmpty():
            return found
        rows = rows.withColumn("prefix", F.get("prefixes", F.lit(low + width - 2))).join(small(last), "prefix", "left_semi").select("prefixes")
        low, width = low + width, 2 * width


def sharded(sequences: DataFrame, limit: int, size: int) -> DataFrame:
    """sequences with n_shared, the number of their prefixes that are shared, and shard, the place of the prefix one turn longer."""
    shared = shared_prefixes(sequences, limit)
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    counted = sequences.select("name", F.explode(F.slice("prefixes", 1, deepest)).alias("prefix")).join(small(shared.select("prefix")), "prefix").groupBy("name").agg(F.count("*").cast("int").alias("n_shared"))
    told = sequences.join(counted, "name", "left").withColumn("n_shared", F.coalesce("n_shared", F.lit(0)))
    turns = sequences.agg(F.sum(F.size("prefixes"))).first()[0] or 0
    key = F.coalesce(F.get("prefixes", F.col("n_shared")), F.col("name"))  # a sequence that ends at a shared prefix is dealt out by its own name
    return told.withColumn("shard", F.pmod(F.xxhash64(key), F.lit(max(1, turns // size))))


def shard_nodes(table: pa.Table) -> pa.Table:
    """A shard's nodes by a double-array trie of its sequences; shared ones hold this shard's part."""
    rows = table.to_pylist()
    dense: dict[bytes, int] = {}
    ids = [[dense.setdefault(d, len(dense)) for d in r["digests"]] for r in rows]
    trie = DoubleArray(ids)
    n = len(trie.check)
    depth, convs, words, first = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.full(n, np.iinfo(np.int64).max)
    shared, prefix, end, path = np.zeros(n, bool), [ROOT] * n, [None] * n, [None] * n
    depth[0], shared[0], path[0] = 0, True, []
    for r, sequence in zip(rows, ids, strict=True):
        convs[0] += r["n"]
        first[0] = min(first[0], r["conv_id"])
        slot = 0
        for d, slot in enumerate(trie.walk(sequence), 1):
            if depth[slot] < 0:
                depth[slot], words[slot], prefix[slot], shared[slot] = d, r["words"][d - 1], r["prefixes"][d - 1], d <= r["n_shared"]
                path[slot] = r["prefixes"][:d] if shared[slot] else None
            convs[slot] += r["n"]
            first[slot] = min(first[slot], r["conv_id"])
        end[slot] = r["ends"]
    parent, children, leaves = np.array(trie.check), np.zeros(n, np.int64), np.zeros(n, np.int64)
    saved = np.where(shared, convs, convs - 1) * words
    by_depth = np.argsort(-depth, kind="stable")
    by_depth = by_depth[depth[by_depth] >= 0]
    for d in range(depth.max(), -1, -1):
        level = by_depth[np.searchsorted(-depth[by_depth], -d) : np.searchsorted(-depth[by_depth], -d, "right")]
        leaves[level] += (children[level] == 0) & ~shared[level]
        if d:
            np.add.at(leaves, parent[level], leaves[level])
            np.add.at(saved, parent[level], saved[level])
            np.add.at(children, parent[level][~shared[level]], 1)
    at = by_depth
    own = ~shared[parent[at]]
    columns = [[prefix[i] for i in at], [prefix[parent[i]] if i else None for i in at], [path[i] for i in at], shared[at], depth[at], first[at], [int(first[parent[i]]) if o else None for i, o in zip(at, own, strict=True)], convs[at], children[at], leaves[at], saved[at], words[at], [end[i] for i in at]]
    kinds = [pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.bool_(), *[pa.int64()] * 8, pa.string()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in NODE.split(", ")])


def nodes(conversations: DataFrame, limit: int = LIMIT, size: int = SHARD) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: prefix, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved, ends.

    conversations: conv_id, turn, role, text; other columns aren't read. Null roles and texts are empty, rows without a conv_id are
    left out, turns that are equal in all are turns of their own, and equal numbers of turns go by role, then digest. A conversation
    without turns left ends at the root; an empty table has no nodes, not even the root. Texts may have any length: only
    digests move.
    """
    every = stored(paths(conversations), "paths")
    told = stored(ends(every.select("name", "conv_id")), "ends")
    sequences = stored(every.join(told, ["name", "conv_id"]), "sequences")
    done = stored(sharded(sequences, limit, size).groupBy("shard").applyInArrow(lambda t: shard_nodes(t), NODE), "nodes")
    upper = done.where("shared").groupBy("prefix").agg(
        *(F.max(c).alias(c) for c in ("parent", "depth", "words", "ends", "path")), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved"))
    )
    upper = stored(upper, "upper")
    below = upper.groupBy(F.col("parent").alias("prefix")).agg(F.count("*").alias("n_shared_children"))
    once = upper.select(F.explode(F.concat(F.array(F.lit(ROOT)), "path")).alias("prefix"), "words").groupBy("prefix").agg(F.sum("words").alias("once"))
    upper = upper.join(below.where("prefix IS NOT NULL"), "prefix", "left").join(once, "prefix", "left")
    children = F.col("n_children") + F.coalesce("n_shared_children", F.lit(0))
    upper = stored(upper.select("prefix", "parent", "depth", "conv_id", "n_convs", children.alias("n_children"), F.when(children == 0, 1).otherwise(F.col("n_leaves")).cast("long").alias("n_leaves"), (F.col("saved") - F.coalesce("once", F.lit(0))).alias("saved"), "ends"), "upper")
    parents = upper.select(F.col("prefix").alias("parent"), F.col("conv_id").alias("parent_of"))
    columns = ["prefix", "parent", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends"]
    both = done.where("NOT shared").select(columns).unionByName(upper.withColumn("parent_conv_id", F.lit(None).cast("long")).select(columns))
    both = both.join(small(parents), "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "parent_of"))
    return both.select(*(c for c in columns if c != "ends"), F.coalesce("ends", F.lit(hashlib.sha256().hexdigest())).alias("ends"))
