"""Mixing sources to target weights by Pareto order sampling (operator 11).

A source's target fixes how many copies of each of its documents are expected: c times the document's weight, MOST at most,
so that the expected words are the target. Whole copies are certain. The fractions left are inclusion probabilities p; each
document draws u, and those of the least odds u / (1 - u) over p / (1 - p) get one copy more until the target's words are
reached. The order is found by counting: ranks fall in buckets, and only the bucket in which a source's words run out is cut
further, so that no task sees a source.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import small, stored

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix"
WORD = r"[^\x20\x09-\x0D]+"
#: Ranks are whole numbers below SPAN. A range of them is cut in DIGITS buckets until it has at most ROWS different ranks of each source.
SPAN, DIGITS, ROWS = 1 << 53, 4096, 16_384
#: Of a source's ranks from the first that doesn't fit, so many are tried in order, each taken if it still fits.
TRIED = 512


@dataclass
class Limits:
    """sources (~key, source_size, target, ~c, ~below): what a source's documents need to know; extra (~key, ~rank): taken beside ranks below ~below."""

    sources: DataFrame
    extra: DataFrame


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def measured(documents: DataFrame, carried: list[str], weight: Column | None = None) -> DataFrame:
    """documents' carried columns with ~key (the source, null told apart), ~size in words, ~weight (a whole number) and ~draw (52 bits)."""
    rows = documents.select(*carried, F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("")).alias("~key"), n_words(F.col("text")).alias("~size"), *([] if weight is None else [weight.cast("long").alias("~weight")]), F.col("doc_id").alias("~id"), F.md5(F.coalesce("text", F.lit(""))).alias("~text"))
    if weight is None:
        rows = rows.withColumn("~weight", F.floor(F.sqrt(F.sqrt(F.col("~size").cast("double"))) * 1000))
    drawn = F.md5(F.concat_ws("\n", F.lit(SEED), F.coalesce(F.col("~id").cast("string"), F.lit("")), "~text"))
    return rows.withColumn("~draw", F.conv(F.substring(drawn, 1, 13), 16, 10).cast("long")).drop("~id", "~text")


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(~key, source_size, weight, target) of measured rows: sources in order of code points, null last, weigh weights in turn.

    Together they get as many words as there are; a target stops at most times its source's size, and the excess is shared
    again by weight until none is above. One row per source; what the driver sees of a round are three sums.
    """
    sized = rows.groupBy("~key").agg(F.sum("~size").alias("source_size"))
    place = F.row_number().over(Window.orderBy((F.col("~key") == "").asc(), "~key")) - 1  # one row for each source
    state = stored(sized.withColumn("weight", F.get(F.array(*map(F.lit, weights)), place % len(weights))).withColumn("full", F.lit(False)), "sources")
    while True:
        most_words, free = most * F.col("source_size"), ~F.col("full")
        sums = state.agg(F.sum("source_size").alias("all"), F.sum(F.when(free, F.lit(0)).otherwise(most_words)).alias("held"), F.sum(F.when(free, F.col("weight")).otherwise(0)).alias("of")).first()
        target = F.when(F.col("full") | F.lit(not sums["of"]), most_words.cast("double")).otherwise(F.lit((sums["all"] or 0) - (sums["held"] or 0)).cast("long") * F.col("weight") / F.lit(sums["of"] or 1))
        told = stored(state.withColumn("target", target).withColumn("now", F.col("full") | (F.col("target") >= most_words)), "targets")
        if told.where("now AND NOT full").isEmpty():
            return told.select("~key", "source_size", "weight", "target")
        state = told.select("~key", "source_size", "weight", F.col("now").alias("full"))


def scaled(rows: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources with ~c, which makes the least of most and ~c times a weight a document's expected copies; null where all are most.

    The heaviest documents are at most first: in order of weight the first one that is below tells c. A source has as many
    rows here as it has different weights.
    """
    bars = rows.groupBy("~key", "~weight").agg(F.sum("~size").alias("words")).where("words > 0")
    order = Window.partitionBy("~key").orderBy(F.desc("~weight"))
    heavier = F.coalesce(F.sum("words").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lighter = F.sum(F.col("words") * F.col("~weight")).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    told = bars.join(small(sources.select("~key", "target")), "~key").withColumn("c", F.try_divide(F.col("target") - most * heavier, lighter.cast("double")))
    fits = told.where(F.col("c") * F.col("~weight") < most).groupBy("~key").agg(F.max_by("c", "~weight").alias("~c"))
    return sources.join(small(fits), "~key", "left")


def ranked(rows: DataFrame, sources: DataFrame, most: int = MOST) -> DataFrame:
    """rows with their source's columns, ~base (certain copies) and ~rank; rank is null where nothing is left to draw."""
    joined = rows.join(small(sources), "~key")
    copies = F.coalesce(F.least(F.lit(float(most)), F.col("~c") * F.col("~weight")), F.when(F.col("~size") > 0, F.lit(float(most))).otherwise(0.0))
    joined = joined.withColumn("~copies", copies).withColumn("~base", F.floor("~copies"))
    p, u = F.col("~copies") - F.col("~base"), (F.col("~draw") + 0.5) / (1 << 52)
    odds = u * (1 - p) / (u * (1 - p) + (1 - u) * p)  # q / (1 + q) of the quotient q of odds, so that ranks lie between 0 and 1
    return joined.withColumn("~rank", F.when((p > 0) & (F.col("~size") > 0), F.floor(odds * SPAN)))


def filled(frame: pd.DataFrame) -> pd.DataFrame:
    """Of at most TRIED ranks of a source those that still fit, in order; then the smallest of the others if the target is nearer with it."""
    gap, taken, left = float(frame["gap"].iloc[0]), [], []
    for rank, words in sorted(zip(frame["~rank"], frame["words"], strict=True)):
        if words <= gap:
            gap -= words
            taken.append(rank)
        else:
            left.append((words, rank))
    if left and min(left)[0] < 2 * gap:
        taken.append(min(left)[1])
    return pd.DataFrame({"~key": pd.Series([frame["~key"].iloc[0]] * len(taken), dtype="object"), "~rank": pd.Series(taken, dtype="int64")})


def limits(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> Limits:
    """Where each source's copies end; rows: a measured() table that is stored."""
    sources = stored(scaled(rows, targets(rows, weights, most), most), "scales")
    drawn = ranked(rows, sources, most)
    certain = drawn.groupBy("~key").agg(F.sum(F.col("~base") * F.col("~size")).alias("certain"))
    classes = stored(drawn.where("`~rank` IS NOT NULL").groupBy("~key", "~rank").agg(F.sum("~size").alias("words")), "ranks")
    state = sources.join(small(certain), "~key").select("~key", F.lit(0).cast("long").alias("lo"), F.lit(SPAN).alias("hi"), (F.col("target") - F.col("certain")).alias("gap"))
    state = stored(state, "ranges")

    def inside() -> DataFrame:
        return classes.join(small(state), "~key").where("`~rank` >= lo AND `~rank` < hi")

    while (inside().groupBy("~key").count().agg(F.max("count")).first()[0] or 0) > ROWS:
        width = F.greatest(F.lit(1), F.ceil((F.col("hi") - F.col("lo")) / DIGITS)).cast("long")
        bucket = F.expr("(`~rank` - lo) div width")
        counted = inside().withColumn("width", width).groupBy("~key", "lo", "hi", "gap", "width", bucket.alias("bucket")).agg(F.sum("words").alias("words"), F.count("*").alias("n"))
        order, whole = Window.partitionBy("~key").orderBy("bucket"), Window.partitionBy("~key")  # at most DIGITS rows
        run = counted.withColumn("end", F.sum("words").over(order)).withColumn("first", F.min(F.when(F.col("end") > F.col("gap"), F.col("bucket"))).over(whole))
        run = run.withColumn("after", F.sum(F.when(F.col("bucket") > F.col("first"), F.col("n")).otherwise(0)).over(order))
        last = F.coalesce(F.min(F.when(F.col("after") >= TRIED, F.col("bucket"))), F.max("bucket"))
        cut = run.groupBy("~key", "lo", "hi", "gap", "width", "first").agg(last.alias("last"), F.coalesce(F.sum(F.when(F.col("bucket") < F.col("first"), F.col("words"))), F.lit(0)).alias("before"))
        known = F.col("first").isNotNull()
        cut = cut.select(
            "~key", F.when(known, F.col("lo") + F.col("first") * F.col("width")).otherwise(F.col("hi")).alias("lo"),
            F.when(known, F.least("hi", F.col("lo") + (F.col("last") + 1) * F.col("width"))).otherwise(F.col("hi")).alias("hi"), (F.col("gap") - F.col("before")).alias("gap"),
        )
        state = stored(cut, "ranges")
    order = Window.partitionBy("~key").orderBy("~rank")  # at most ROWS rows
    near = inside().withColumn("end", F.sum("words").over(order))
    near = stored(near.withColumn("over", F.sum(F.when(F.col("end") > F.col("gap"), 1).otherwise(0)).over(order)), "near")  # over counts from the first that doesn't fit
    below = near.groupBy("~key").agg(F.min(F.when(F.col("over") == 1, F.col("~rank"))).alias("~below"))
    before = near.where("over = 0").groupBy("~key").agg(F.max("end").alias("before"))
    tried = near.where(F.col("over").between(1, TRIED)).join(small(before), "~key", "left").withColumn("gap", F.col("gap") - F.coalesce("before", F.lit(0)))
    extra = tried.select("~key", "~rank", "words", "gap").groupBy("~key").applyInPandas(filled, "`~key` string, `~rank` long")
    return Limits(stored(sources.join(small(below), "~key", "left").withColumn("~below", F.coalesce("~below", F.lit(SPAN))), "limits"), stored(extra, "extra"))


def copied(rows: DataFrame, found: Limits, most: int = MOST) -> DataFrame:
    """measured() rows with ~copies, the whole copies that the mix takes, and their source's source_size and target."""
    drawn = ranked(rows, found.sources, most)
    joined = drawn.join(small(found.extra.withColumn("~more", F.lit(1))), ["~key", "~rank"], "left")
    more = F.when(F.col("~rank") < F.col("~below"), 1).otherwise(F.coalesce("~more", F.lit(0)))
    return joined.withColumn("~copies", (F.col("~base") + more).cast("long")).drop("~base", "~more")


def allotted(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, weight: Column | None = None) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies.

    weight: a whole number above 0 that a document's expected copies are proportional to within its source; by default the
    fourth root of its words, so that long documents come somewhat oftener. A source's words end up at most half a document's
    size, of the smallest that was tried, from its target, where it has documents left. Null and wordless texts have size 0 and no
    copies; null sources are one source. Rows that agree in doc_id, text and source share a draw and are taken alike. Draws
    depend on doc_id and text alone, so that runs agree however the rows lie. An empty table gives no rows. Only doc_id,
    text and source are read, and what weight names.
    """
    rows = stored(measured(documents, ["doc_id"], weight), "measured")
    return copied(rows, limits(rows, weights, most), most).select("doc_id", F.col("~size").alias("size"), "source_size", "target", F.col("~copies").alias("copies"))


def mixed(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, weight: Column | None = None) -> DataFrame:
    """The mix itself: rows of documents, each as often as allotted() says. Texts are never shuffled."""
    found = limits(stored(measured(documents, [], weight), "measured"), weights, most)
    taken = copied(measured(documents.select(F.struct(*documents.columns).alias("~row"), *documents.columns), ["~row"], weight), found, most)
    return taken.where("`~copies` > 0").select("~row", F.explode(F.sequence(F.lit(1), F.col("~copies").cast("int")))).select("~row.*")
