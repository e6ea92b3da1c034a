"""Substring dedup by paragraph MinHash banding (operator 6).

Lines, paragraphs between blank lines and whole texts of at least LEAST words are units, and so are runs of WORDS words that begin at places chosen
by content (the least shingle of each SPAN in a row): a passage of WORDS + SPAN - 1 words or more holds such a run whole
wherever it stands, inside other paragraphs too. Paragraphs that share a MinHash band are joined and pairs of different ones
verified by exact Jaccard of their shingles; runs are compared for equality, as two runs of 20 words reach 0.8 only if they
share 19 words in a row. All but the first unit of each component are removals.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BIN_ROWS, BLOCK, connected_components, least_linked, small, stored

SHINGLE, LEAST, WORDS, SPAN, JACCARD = 5, 20, 20, 32, 0.8
#: A paragraph has 10 bands of 3 MinHashes: a pair at Jaccard 0.8 shares one with 1 - 0.488^10 > 0.999.
ROWS, BANDS = 3, 10
CACHED, CHUNK = 300_000, 1 << 19  # words that a task keeps; characters of texts that are cut at a time
_r = np.random.default_rng(11)
MULTIPLY = _r.integers(1, 1 << 63, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
ADD = _r.integers(0, 1 << 63, ROWS * BANDS, dtype=np.uint64)
BASE = [np.uint64(int(x)) for x in _r.integers(1, 1 << 63, SHINGLE, dtype=np.uint64) | np.uint64(1)]


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class Chunk:
    """Texts one after another: their words (lower-cased A-Z), the words' places in characters of their text, shingles.

    Arrays go over all words; shingles[i] begins at word i and is only of use where no text ends within it.
    """

    def __init__(self, texts: list[str], hashes: WordHashes):
        raws = [t.encode() for t in texts]
        raw = b"\n".join(raws) + b"\n"
        data = np.frombuffer(raw, np.uint8)
        inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.diff(np.concatenate([[False], inside]).astype(np.int8))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        offset = np.cumsum([0, *(len(r) + 1 for r in raws)])[:-1]
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        self.text = np.searchsorted(offset, starts, "right") - 1
        self.starts, self.ends = (letters[at] - letters[offset][self.text] for at in (starts, ends))
        self.words = np.fromiter(map(hashes.__getitem__, raw.lower().split()), np.uint64, len(starts))
        n = max(0, len(starts) - SHINGLE + 1)
        parts = (self.words[k : n + k] * BASE[k] for k in range(SHINGLE))
        self.shingles = np.concatenate([mixed(sum(parts, np.zeros(n, np.uint64))), np.zeros(len(starts) - n + 1, np.uint64)])
        self.line = np.searchsorted(np.flatnonzero(data == 10), starts)
        self.bounds = np.searchsorted(self.text, np.arange(len(texts) + 1))  # each text's first word
        base = int(BASE[0])
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.words * powers(base, len(starts))[: len(starts)], dtype=np.uint64)])
        self.back = powers(pow(base, -1, 1 << 64), len(starts) + 1)

    def units(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Names of the words from starts to ends: polynomial hashes, the same wherever the words stand."""
        first = np.concatenate([np.ones(1, np.uint64), self.back])[starts]
        return mixed((self.sums[ends] - self.sums[starts]) * first).view(np.int64)

    def bands(self, starts: np.ndarray, ends: np.ndarray, multiply: np.ndarray, add: np.ndarray, rows: int) -> np.ndarray:
        """(n, bands): MinHashes, rows of them each, of the shingles within words from starts to ends, SHINGLE words at least."""
        if not len(starts):
            return np.zeros((0, len(multiply) // rows), np.int64)
        at = np.stack([starts, ends - SHINGLE + 1], axis=1).ravel()
        return signatures([np.minimum.reduceat((self.shingles * m + a) >> np.uint64(32), at)[::2] for m, a in zip(multiply, add, strict=True)], rows)


POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base, base^2, ... modulo 2^64, at least n of them."""
    if base not in POWERS or n > len(POWERS[base]):
        POWERS[base] = np.cumprod(np.full(max(1024, 2 * n), base, np.uint64), dtype=np.uint64)
    return POWERS[base]


def signatures(mins: list[np.ndarray], rows: int) -> np.ndarray:
    """Bands of (n,) MinHashes, rows of them each: (n, bands)."""
    out = []
    for band in range(len(mins) // rows):
        key = np.full(len(mins[0]), 1000 * rows + band, np.uint64)
        for m in mins[band * rows : (band + 1) * rows]:
            key = mixed(key * np.uint64(0xD6E8FEB86659FD93) + m)
        out.append(key.view(np.int64))
    return np.stack(out, axis=1)


def places(chunk: Chunk) -> np.ndarray:
    """Words at which runs begin: of each SPAN shingles in a row that begin whole runs the least, the last of equals; of fewer, the least."""
    fits = chunk.bounds[1:] - chunk.bounds[:-1] - WORDS + 1  # places in each text
    low, at, step = chunk.shingles, np.arange(len(chunk.shingles)), 1
    while step < SPAN:
        if len(low) <= step:
            low, at = low[:0], at[:0]
            break
        right = low[step:] <= low[:-step]
        low, at, step = np.where(right, low[step:], low[:-step]), np.where(right, at[step:], at[:-step]), step * 2
    own = chunk.text[: len(at)]
    whole = np.arange(len(own)) - chunk.bounds[own] + SPAN <= fits[own]
    few = [chunk.bounds[t] + f - 1 - int(chunk.shingles[chunk.bounds[t] : chunk.bounds[t] + f][::-1].argmin()) for t, f in enumerate(fits) if 0 < f < SPAN]
    return np.unique(np.concatenate([at[: len(own)][whole], np.array(few, np.int64)]))


def units_of(chunk: Chunk) -> list[tuple[np.ndarray, ...]]:
    """Arrays (first word, word after the last, unit, (n, bands)) of a chunk's paragraphs and of its runs, which have no bands."""
    n = len(chunk.words)
    new = np.diff(chunk.line)
    marks = (np.flatnonzero(new) + 1, np.flatnonzero(new > 1) + 1, chunk.bounds[:0])
    keys = []
    for mark in marks:
        cut = np.unique(np.concatenate([mark, chunk.bounds]))
        long = np.diff(cut) >= LEAST
        keys.append(cut[:-1][long] * (n + 1) + cut[1:][long])
    first, last = np.divmod(np.unique(np.concatenate(keys)), n + 1)
    at = places(chunk)
    return [(first, last, chunk.units(first, last), chunk.bands(first, last, MULTIPLY, ADD, ROWS)), (at, at + WORDS, chunk.units(at, at + WORDS), np.zeros((len(at), 0), np.int64))]


def chunks(texts, size: int = CHUNK):
    """(place of the first, texts) of texts in a row (a list, or a column of a batch), of some size in all."""
    at, held, total = 0, [], 0
    for i, text in enumerate(texts):
        held.append((text if text is None or isinstance(text, str) else text.as_py()) or "")
        total += len(held[-1])
        if total >= size:
            yield at, held
            at, held, total = i + 1, [], 0
    if held:
        yield at, held


def units(documents: DataFrame) -> DataFrame:
    """(doc_id, start, until, unit, bands array<long>) of all units of whole texts; places in characters."""

    def cut(batches):
        hashes = WordHashes()
        for batch in batches:
            for at, texts in chunks(batch.column(1)):
                chunk = Chunk(texts, hashes)
                for first, last, names, bands in units_of(chunk) if len(chunk.words) else ():
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(names) + 1, dtype=np.int32) * bands.shape[1]), pa.array(bands.ravel()))
                    values = [pa.array(x.astype(np.int32)) for x in (chunk.starts[first], chunk.ends[last - 1])]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at + chunk.text[first])), *values, pa.array(names), lists], ["doc_id", "start", "until", "unit", "bands"])

    return documents.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL").mapInArrow(cut, f"doc_id {dict(documents.dtypes)['doc_id']}, start int, until int, unit long, bands array<long>")


def shingles(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """(unit, cluster, shingles array<long>) of the wanted units (unit, cluster, doc_id, start, until)."""
    listed = wanted.groupBy("doc_id").agg(F.collect_list(F.struct("unit", "cluster", "start", "until")).alias("wanted"))
    texts = documents.select("doc_id", "text").join(small(stored(listed, "wanted")), "doc_id")

    def of(batches):
        hashes = WordHashes()
        for batch in batches:
            found = [((w["unit"], w["cluster"]), x[w["start"] : w["until"]]) for x, ws in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True) for w in ws if x]
            for at, texts in chunks([t for _, t in found]):
                chunk = Chunk(texts, hashes)
                names = chunk.units(chunk.bounds[:-1], chunk.bounds[1:])
                own = [(*u, np.unique(chunk.shingles[a : b - SHINGLE + 1]).view(np.int64)) for (u, _), name, a, b in zip(found[at : at + len(texts)], names, chunk.bounds, chunk.bounds[1:], strict=False) if name == u[0]]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in own], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.list_(pa.int64())))], ["unit", "cluster", "shingles"])

    found = stored(texts.mapInArrow(of, "unit long, cluster long, shingles array<long>"), "shingles")
    return found if found.count() == wanted.count() else found.dropDuplicates(["unit"])  # rows that repeat a doc_id repeat its units


def similar(sets: list[np.ndarray], one: np.ndarray, two: np.ndarray, least: float) -> np.ndarray:
    """near[i, j]: whether sets one[i] and two[j] have a Jaccard similarity of least or more. Columns are taken in parts."""
    size = np.array([len(s) for s in sets], np.float64)
    owner = np.repeat(np.arange(len(sets)), size.astype(int))
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    shared = np.zeros((len(one), len(two)))
    for at in range(0, int(column.max()) + 1, 4096):
        here = (column >= at) & (column < at + 4096)
        table = np.zeros((len(sets), 4096), np.float32)
        table[owner[here], column[here] - at] = 1
        shared += table[one] @ table[two].T
    return shared >= least * (size[one][:, None] + size[two][None] - shared) - 1e-9


#: Tables of bands and units grow with the texts. Those of ids and numbers that fit() come to what they are joined with; larger ones are joined by
#: shuffles. The joins that move most bytes, of all bands, all units and all sets, shuffle at every size, so that disk grows in proportion.


def candidates(bands: DataFrame) -> DataFrame:
    """(unit, band, low, size) of bands (unit, band) that different units share, with a band's lowest unit and their number; bands of the same units are one."""
    mixed_bands = bands.groupBy("band").agg(F.min("unit").alias("low"), F.max("unit").alias("high")).where("low < high").select("band")
    members = stored(bands.join(stored(mixed_bands, "bands"), "band").distinct(), "members")
    alike = members.groupBy("band").agg(F.count("*").alias("size"), F.min("unit").alias("low"), F.max("unit").alias("high"), F.sum(F.xxhash64("unit").cast("decimal(38,0)")).alias("sum"))
    once = alike.groupBy("size", "low", "high", "sum").agg(F.min("band").alias("band")).select("band", "low", "size")  # bands of the same units are compared once
    return stored(members.join(small(stored(once, "bands")), "band"), "members")


def verified(members: DataFrame, sets: DataFrame, least: float, block: int | None = None, rows: int | None = None) -> DataFrame:
    """(a, b): links that connect what those pairs of units in a band (unit, band, far) connect of which one is far at least and whose sets (unit, cluster, shingles) are similar by least.

    A unit that is not far goes by its cluster's name, with which it hangs together. Where a band has several blocks of far units, each such block is
    compared in itself first, and what that connects goes by one name: two blocks then tell how names hang together and not, block by block, how every
    unit does, so that links grow with a group's size and not with its square.
    """

    def verify(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("group", kind="stable")
        group, names, side, own = (frame[c].to_numpy() for c in ("group", "name", "side", "shingles"))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        found = [np.zeros((0, 2), np.int64)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if j - i == 2:
                x, y = own[i], own[i + 1]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                if shared >= least * (len(x) + len(y) - shared) - 1e-9:
                    found.append(names[i:j][None])
                continue
            one, two = np.flatnonzero(side[i:j] != 1), np.flatnonzero(side[i:j] != 0)
            if len(one) and len(two) and (names[i:j] != names[i]).any():
                low = least_linked(similar(list(own[i:j]), one, two, least), one, two, names[i:j])
                found.append(np.unique(np.stack([names[i:j], low], axis=1)[low < names[i:j]], axis=0))
        return pd.DataFrame(np.concatenate(found), columns=["a", "b"])

    def linked(blocks: DataFrame, name: Column) -> DataFrame:
        return blocks.join(sets, "unit").select("bin", "group", "side", name.alias("name"), "shingles").groupBy("bin").applyInPandas(verify, "a long, b long")

    blocks = far_blocks(members, block, rows)
    name = F.when(F.col("far"), F.col("unit")).otherwise(F.col("cluster"))
    if blocks.where("far AND side = 1").isEmpty():
        return linked(blocks, name)
    within = stored(linked(blocks.where("side = 2"), name).distinct(), "within")
    known = connected_components(within).withColumnRenamed("id", "unit")
    return within.unionByName(linked(blocks.where("side <> 2").join(small(known), "unit", "left"), F.coalesce("component", name)))


def far_blocks(members: DataFrame, block: int | None = None, rows: int | None = None) -> DataFrame:
    """members (unit, band, far) with bin, group and side, as paired_blocks() gives them, for the pairs of a band of which one is far at least.

    Far members are in blocks of their own, which come first; each of them meets every block, so that a band costs its members
    times the blocks of its far ones and not of all.
    """
    size = block or BLOCK
    sizes = members.groupBy("band").agg(F.ceil(F.count_if("far") / size).cast("int").alias("~far"), F.ceil(F.count_if(~F.col("far")) / size).cast("int").alias("~near"))
    own = members.join(small(stored(sizes, "sizes")), "band").withColumn("~own", F.when(F.col("far"), F.pmod(F.xxhash64("unit"), F.greatest("~far", F.lit(1)))).otherwise(F.col("~far") + F.pmod(F.xxhash64("unit"), F.greatest("~near", F.lit(1)))).cast("int"))
    last = F.when(F.col("far"), F.col("~far") + F.col("~near")).otherwise(F.col("~far")) - 1
    spread = own.where("`~far` > 0").withColumn("~against", F.explode(F.sequence(F.lit(0), last)))
    low, high = F.least("~own", "~against"), F.greatest("~own", "~against")
    side = F.when(low == high, F.lit(2)).when(F.col("~own") == low, F.lit(0)).otherwise(1)
    spread = stored(spread.select("unit", "band", "far", F.xxhash64("band", low, high).alias("group"), side.alias("side")), "blocks")
    return spread.withColumn("bin", F.pmod("group", F.lit(max(1, spread.count() // (rows or BIN_ROWS)))))


def clustered(members: DataFrame) -> DataFrame:
    """(unit, cluster) of candidates (unit, band; low and size are counted where they are not given): what bands connect. A cluster's name is the unit that has most in its bands: the text of which the others are edited copies, if there is one."""
    met = members
    if not {"low", "size"} <= {*members.columns}:
        met = stored(members.join(members.groupBy("band").agg(F.min("unit").alias("low"), F.count("*").alias("size")), "band"), "met")
    # A unit is linked with the least of its bands' lowest units, and these with each other: a group that shares all bands has a link for each unit and not one for each band of it.
    least = stored(met.groupBy("unit").agg(F.min("low").alias("least"), F.sum("size").alias("weight")), "least")
    tied = met.join(small(least), "unit").where("low <> least").select(F.col("low").alias("a"), F.col("least").alias("b"))
    named = connected_components(least.select(F.col("unit").alias("a"), F.col("least").alias("b")).unionByName(tied)).select(F.col("id").alias("unit"), "component")
    weighed = stored(least.join(small(named), "unit"), "weighed")
    middle = weighed.groupBy("component").agg(F.max_by("unit", F.struct("weight", "unit")).alias("cluster"))
    return stored(weighed.join(small(stored(middle, "middle")), "component").select("unit", "cluster"), "clusters")


def links(members: DataFrame, sets: DataFrame, least: float, block: int | None = None, rows: int | None = None) -> DataFrame:
    """(a, b): links that connect what all pairs of units in a band (unit, band) connect whose sets (unit, cluster, shingles; one for each unit) are similar by least.

    Each unit meets the one that names its cluster. What is similar to that hangs together; only the units that are not (of clusters of
    more than two) are compared with all members of their bands.
    """
    pivots = sets.where("unit = cluster").select("cluster", F.col("shingles").alias("pivot"))
    shared = F.size(F.array_intersect("shingles", "pivot"))
    near = shared >= least * (F.size("shingles") + F.size("pivot") - shared) - 1e-9
    told = stored(sets.where("unit <> cluster").join(pivots, "cluster").select("unit", "cluster", near.alias("near")), "told")
    open_ = told.groupBy("cluster").agg(F.count("*").alias("n"), F.count_if(~F.col("near")).alias("far")).where("far > 0 AND n > 1").select("cluster")
    far = stored(told.where("NOT near").join(small(stored(open_, "open")), "cluster", "left_semi").select("unit"), "far")
    asked = members.join(small(far), "unit", "left_semi").select("band").distinct()
    asked = members.join(small(stored(asked, "asked")), "band", "left_semi").join(small(far).withColumn("far", F.lit(True)), "unit", "left")
    asked = stored(asked.withColumn("far", F.coalesce("far", F.lit(False))), "asked")
    rest = verified(asked, sets.join(small(asked.select("unit")), "unit", "left_semi"), least, block, rows)
    return told.where("near").select(F.col("unit").alias("a"), F.col("cluster").alias("b")).unionByName(rest)


def repeats(documents: DataFrame, least: float = JACCARD) -> DataFrame:
    """(doc_id, start, until, component, first, across, first_doc): every unit that occurs at more than one place.

    component names units of which each is similar to another by at least least. Overlapping units of a component in one
    document are one place, and what reaches over several stands with the first if it overlaps that; first marks those at the first place of the smallest doc_id (first_doc), across says whether
    more than one doc_id has one.
    """
    table = stored(units(documents), "units")
    bands = table.select("unit", F.explode("bands").alias("band"))
    members = candidates(bands)
    clusters = clustered(members)
    again = table.groupBy("unit").agg(F.count("*").alias("n")).where("n > 1").select("unit")
    repeated = stored(again.union(clusters.select("unit")).distinct(), "repeated")  # a table of its own, so that a join with a unit that a third of the texts hold can be split
    every = stored(table.select("doc_id", "start", "until", "unit").join(repeated, "unit"), "every")
    first = every.groupBy("unit").agg(F.min(F.struct("doc_id", "start", "until")).alias("at"))  # before the join, so that each task sends one place of a unit
    wanted = first.join(small(clusters), "unit").select("unit", "cluster", "at.*")
    sets = shingles(documents, stored(wanted, "wanted"))

    named = connected_components(links(members, sets, least))
    known = every.join(small(named).withColumnRenamed("id", "unit"), "unit", "left").withColumn("component", F.coalesce("component", "unit"))
    within = Window.partitionBy("component", "doc_id")
    place = within.orderBy("until", "start")  # a text that repeats a line comes after its lines and joins none of them
    before = F.max("until").over(place.rowsBetween(Window.unboundedPreceding, -1))
    known = known.select("doc_id", "start", "until", "component", F.coalesce((F.col("start") >= before).cast("int"), F.lit(0)).alias("apart"))
    known = known.withColumn("island", F.sum("apart").over(place.rowsBetween(Window.unboundedPreceding, 0))).drop("apart")
    islands = F.max("island").over(within)
    known = known.withColumn("most", islands).withColumn("kept", F.max(F.when(F.col("island") == 0, F.col("until"))).over(within))
    known = stored(known.withColumn("island", F.when(F.col("start") < F.col("kept"), F.lit(0)).otherwise(F.col("island"))).drop("kept"), "known")
    firsts = known.groupBy("component").agg(F.min("doc_id").alias("first_doc"), (F.min("doc_id") < F.max("doc_id")).alias("across"), F.max("most").alias("islands"))
    found = known.join(small(stored(firsts.where("across OR islands > 0").drop("islands"), "firsts")), "component")
    return found.select("doc_id", "start", "until", "component", ((F.col("doc_id") == F.col("first_doc")) & (F.col("island") == 0)).alias("first"), "across", "first_doc")


def removals(documents: DataFrame, least: float = JACCARD) -> DataFrame:
    """One row per document row: doc_id, n_repeated, n_removed, removed_chars, spans array<struct<start, until>>, class_id.

    n_repeated counts units that other documents share, n_removed those that are not the first of their component; spans
    are the removed places in characters, merged; class_id is the smallest doc_id that has one of the document's shared
    units first, or doc_id. Null and empty texts, texts of fewer than LEAST words and rows without a doc_id have none.
    Rows of one doc_id are one document, of which each row gives a row.
    """
    found = repeats(documents, least)
    per = found.groupBy("doc_id").agg(
        F.count_if("across").alias("n_repeated"), F.count_if(~F.col("first")).alias("n_removed"), F.min(F.when(F.col("across"), F.col("first_doc"))).alias("class_id"),
        F.array_sort(F.collect_set(F.when(~F.col("first"), F.struct("start", "until")))).alias("cut"),
    )
    merged = F.aggregate(
        "cut",
        F.array().cast("array<struct<start:int,until:int>>"),
        lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["until"] >= s["start"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["until"], s["until"]).alias("until"))))).otherwise(F.concat(done, F.array(F.struct(s["start"].alias("start"), s["until"].alias("until"))))),
    )
    per = stored(per.withColumn("spans", merged).drop("cut"), "removals")
    none = F.array().cast("array<struct<start:int,until:int>>")
    rows = documents.select("doc_id").join(per, "doc_id", "left").withColumn("spans", F.coalesce("spans", none))
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["until"] - s["start"])
    zero = F.lit(0).cast("long")
    return rows.select("doc_id", F.coalesce("n_repeated", zero).alias("n_repeated"), F.coalesce("n_removed", zero).alias("n_removed"), size.alias("removed_chars"), "spans", F.coalesce("class_id", "doc_id").alias("class_id"))
