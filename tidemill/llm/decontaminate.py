"""Benchmark decontamination over a distributed positional inverted index (operator 2): DataFrame functions only.

The index holds a posting (term, row, position) for each document word that a test item uses; no other word can take part
in a match. Matching starts from each window's rarest term, intersects the offset-adjusted list of its next rarest one,
and looks up the others only in rows that are left. Frequent terms are thus never shuffled by term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lower_ascii, small, stored

NOT_A_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10

def words(text: Column) -> Column:
    """Lower-cased (A-Z only) runs of digits, letters and non-ASCII characters; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_A_WORD), "")


@dataclass
class Windows:
    """Test windows: terms (term, term_id), at (window_id, off, term_id), items (window_id, item_id), sizes (window_id, n)."""

    terms: DataFrame
    at: DataFrame
    items: DataFrame
    sizes: DataFrame


@dataclass
class Index:
    """postings (term_id, row_id, pos) and rows (row_id, doc_id, n_words); each document row has a row_id of its own."""

    postings: DataFrame
    rows: DataFrame


def windows(benchmark: DataFrame, size: int = WINDOW) -> Windows:
    """Runs of size consecutive words of each item; an item of fewer words, but not none, is one window."""
    item = benchmark.select("item_id", words(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    cut = item.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("words", s, size))).alias("window"))
    distinct = stored(cut.groupBy("window").agg(F.collect_set("item_id").alias("items")).withColumn("window_id", F.monotonically_increasing_id()), "windows")
    at = distinct.select("window_id", F.posexplode("window").alias("off", "term"))
    terms = stored(at.select("term").distinct().withColumn("term_id", F.monotonically_increasing_id()), "terms")
    at = stored(at.join(terms, "term").select("window_id", "off", "term_id"), "offsets")
    return Windows(terms, at, distinct.select("window_id", F.explode("items").alias("item_id")), distinct.select("window_id", F.size("window").alias("n")))


def index(documents: DataFrame, terms: DataFrame) -> Index:
    """Stores the postings of the given terms in whole texts. A term of its own (a space and the row_id, which is no word) ends each row."""
    each = documents.select("doc_id", words(F.col("text")).alias("words")).withColumn("row_id", F.monotonically_increasing_id())
    each = each.withColumn("words", F.array_append("words", F.concat(F.lit(" "), F.col("row_id"))))
    each = each.select("row_id", "doc_id", F.posexplode("words").alias("pos", "term"))
    end = F.col("term").startswith(" ")
    postings = each.join(small(terms.select("term", "term_id")), "term", "left").where(F.col("term_id").isNotNull() | end)
    postings = stored(postings.select("term_id", "row_id", "pos", F.when(end, F.col("doc_id")).alias("doc_id")), "postings")
    return Index(postings.where("term_id IS NOT NULL").select("term_id", "row_id", "pos"), postings.where("term_id IS NULL").select("row_id", "doc_id", F.col("pos").cast("long").alias("n_words")))


def matches(found: Index, wanted: Windows, slack: int = 0) -> DataFrame:
    """(window_id, row_id, start, n): windows of n words that occur at start.

    With slack 0 every term stands exactly at its offset: the phrase. Otherwise (proximity) the rarest term fixes the start
    and each other term stands at most slack words from its place.
    """
    counts = small(stored(found.postings.groupBy("term_id").agg(F.count("*").alias("n_postings")), "counts"))  # a table, so that the join with a term of many windows can be split
    rank = F.row_number().over(Window.partitionBy("window_id").orderBy("n_postings", "off"))
    ranked = wanted.at.join(counts, "term_id", "left").join(wanted.sizes, "window_id")
    ranked = ranked.withColumn("absent", F.max(F.col("n_postings").isNull()).over(Window.partitionBy("window_id")))
    ranked = stored(ranked.where(~F.col("absent")).withColumn("rank", rank).select("window_id", "off", "term_id", "rank", "n"), "ranked")

    def places(of: int) -> DataFrame:
        """The start that each posting of the windows' term of this rank speaks for."""
        lists = found.postings.join(small(ranked.where(F.col("rank") == of)), "term_id")
        near = F.explode(F.sequence(F.lit(-slack), F.lit(slack))) if slack and of > 1 else F.lit(0)
        starts = lists.select("window_id", "row_id", "n", "pos", "off", near.alias("shift"))
        starts = starts.select("window_id", "row_id", (F.col("pos") - F.col("off") + F.col("shift")).alias("start"), "n")
        return starts.distinct() if slack else starts.where("start >= 0")

    first, second = places(1), places(2).drop("n")
    left = first.where("n > 1").join(second, ["window_id", "row_id", "start"]).unionByName(first.where("n = 1"))
    left = stored(left.select("window_id", "row_id", "start", "n"), "candidates")
    rest = small(ranked.where("rank > 2").drop("n"))
    due = left.where("n > 2").join(rest, "window_id").withColumn("due", F.col("start") + F.col("off"))
    if slack:
        due = due.withColumn("due", F.explode(F.sequence(F.col("due") - slack, F.col("due") + slack)))
    lists = found.postings.join(small(left.select("row_id").distinct()), "row_id", "left_semi").withColumnRenamed("pos", "due")
    met = due.join(lists, ["row_id", "due", "term_id"]).select("window_id", "row_id", "start", "n", "off")
    met = met.distinct() if slack else met
    whole = met.groupBy("window_id", "row_id", "start", "n").agg(F.count("*").alias("met")).where("met = n - 2").drop("met")
    return whole.unionByName(left.where("n <= 2"))


def contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """One row per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window is hit. Null, empty and wordless texts have no words and no hits, wordless
    items no windows. Repeated rows give repeated rows, repeated items count once by item_id, a null item_id is not
    counted. Only doc_id, item_id and text are read.
    """
    wanted = windows(benchmark, size)
    found = index(documents, wanted.terms)
    hits = stored(matches(found, wanted), "matches")
    spans = hits.groupBy("row_id", "start").agg(F.max("n").alias("n")).groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("start", "n"))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("hit")),
        lambda a, s: F.struct(F.greatest(a["end"], s["start"] + s["n"]).alias("end"), (a["hit"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(a["end"], s["start"]))).alias("hit")),
    )["hit"]
    spans = spans.select("row_id", covered.cast("long").alias("n_hit"))
    items = hits.select("row_id", "window_id").distinct().join(wanted.items, "window_id").groupBy("row_id").agg(F.array_sort(F.collect_set(F.col("item_id").cast("string"))).alias("items"))
    rows = found.rows.join(spans, "row_id", "left").join(items, "row_id", "left")
    listed = F.coalesce("items", F.array().cast("array<string>"))
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(listed).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )
