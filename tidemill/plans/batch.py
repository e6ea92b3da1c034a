"""The batch: items to published articles, each stage a function from DataFrames to DataFrames."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import times
from tidemill.operators import articles as A
from tidemill.operators import scoring
from tidemill.plans import vocabulary as V
from tidemill.plans.config import Settings
from tidemill.sources.ports import Ports


@dataclass
class Outcome:
    """What each stage left: tables by stage's name."""

    dropped: DataFrame
    kept: DataFrame
    filtered: DataFrame
    classes: DataFrame
    scores: DataFrame
    articles: DataFrame

    def release(self) -> None:
        """Gives back what run() persisted: filtered and scores, each used by several tables."""
        self.filtered.unpersist()
        self.scores.unpersist()


def run(items: DataFrame, history: DataFrame, lexicon: DataFrame, as_of: Column, ports: Ports, signals: str, spam: str, negations: list[str], settings: Settings = Settings(), organisations: tuple[str, ...] = ()) -> Outcome:
    """items: item_id, title, url, content, source_name, tier, origin_policy, published_at; history: dedup_url, content_hash, collected_at.

    Normalise, deduplicate in the batch and against history, filter, find evidence once for classes and scores alike, then
    decide: rejected items are blocked, doubtful ones wait for a review, scored ones above the threshold are published
    where the port's scores confirm them, the rest stay drafts.
    """
    every = A.normalized(items)
    recent = history.where(F.col("collected_at") >= as_of - F.make_dt_interval(F.lit(settings.history_days)))
    kept = A.fresh(A.batch_winners(every.where("drop_reason IS NULL")), history, recent)
    decision = scoring.filter_decision(F.col("title"), F.col("content"), F.col("published_at"), as_of, signals, spam, settings.stale_days)
    filtered = kept.withColumn("filter", decision).persist()
    texts = filtered.where("filter.decision <> 'reject'").select(F.col("item_id").alias("doc_id"), F.concat_ws("\n", "title", "content").alias("text"))
    dimensions = V.dimensions(items.sparkSession)
    scores = scoring.direction_scores(scoring.evidence(texts, lexicon, negations), dimensions).persist()
    classes = scoring.classified(scores, dimensions.select("direction", "direction_no").distinct())
    order = dimensions.select("direction", "direction_no").distinct()
    rated = scoring.rule_scores(filtered.select(F.col("item_id").alias("doc_id"), "title", F.col("content").alias("text"), "tier"), scores, order, organisations)
    best = rated.select("doc_id", F.col("publish_score").alias("score"))
    joined = ports.score(filtered.join(best, F.col("item_id") == F.col("doc_id"), "left").drop("doc_id").join(classes.withColumnRenamed("doc_id", "item_id").select("item_id", F.col("status").alias("class"), "direction"), "item_id", "left"))
    status = (
        F.when(F.col("filter.decision") == "reject", "blocked").when(F.col("filter.decision") == "review", "pending_review")
        .when((F.col("class") == "classified") & F.col("ai_scores").isNotNull() & (F.col("score") >= settings.publish_least), "published").otherwise("draft")
    )
    done = joined.withColumn("status", status).withColumn("exclude_reason", F.when(F.col("filter.decision") != "candidate", F.col("filter.reason_code")))
    return Outcome(every.where("drop_reason IS NOT NULL"), kept, filtered, classes, scores, done.select("item_id", "title", "dedup_url", "content_hash", "source_name", "status", "direction", "score", "exclude_reason", "published_at"))


def published(articles: DataFrame, clusters: DataFrame, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    """What follows publication: the front page (article_id, rank, reason) and each Shanghai day's digest, as digests() gives it.

    articles: as run() gives them; clusters: article_id, cluster_id, as clusters.planned() gives them.
    """
    shown = articles.where("status = 'published'").withColumnRenamed("item_id", "article_id").join(clusters.select("article_id", "cluster_id"), "article_id", "left")
    return A.front_page(shown, limit), digests(shown if "collected_at" in shown.columns else shown.withColumn("collected_at", F.lit(None).cast("timestamp")))


#: What stands before and behind the number of articles, and behind a score.
HEAD, POINTS = ("今日共 ", " 条 AI 热点："), "分"
#: Ids that are numbered and joined together at first.
LISTED = 8192


def digest_lines(shown: DataFrame) -> DataFrame:
    """(day, n, article_id, line): each Shanghai day's articles, numbered by article_id. shown: article_id (a number), title, score, direction, published_at, collected_at.

    Those without a direction or score are left out. A day's articles are numbered in parts of ids and the parts' counts added, so that no
    day is one task's.
    """
    at = F.coalesce("published_at", "collected_at")
    dated = shown.where("direction IS NOT NULL AND score IS NOT NULL").select("article_id", "title", "score", times.shanghai_day(at).cast("string").alias("day"), F.expr(f"article_id div {LISTED}").alias("part"))
    counts = dated.groupBy("day", "part").agg(F.count("*").alias("n"))
    before = counts.select("day", "part", F.coalesce(F.sum("n").over(Window.partitionBy("day").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = dated.withColumn("own", F.row_number().over(Window.partitionBy("day", "part").orderBy("article_id"))).join(before, ["day", "part"]).withColumn("n", F.col("own") + F.col("before"))
    return own.select("day", "part", "n", "article_id", F.concat(F.col("n").cast("string"), F.lit(". "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("score").cast("string"), F.lit(f"{POINTS})")).alias("line"))


def digests(shown: DataFrame) -> DataFrame:
    """(day, article_count, summary, article_ids): each day's digest, a head and all its lines. A digest is one text, put together of its parts."""
    row = F.struct("n", "line", F.col("article_id").cast("string").alias("id"))
    parts = digest_lines(shown).groupBy("day", "part").agg(F.count("*").alias("count"), F.array_sort(F.collect_list(row)).alias("rows"))
    parts = parts.select("day", "part", "count", *(F.array_join(F.transform("rows", lambda r: r[c]), sign).alias(c) for c, sign in (("line", "；"), ("id", ","))))  # noqa: B023
    whole = parts.groupBy("day").agg(F.sum("count").alias("article_count"), F.array_sort(F.collect_list(F.struct("part", "line", "id"))).alias("parts"))
    text = F.concat(F.lit(HEAD[0]), F.col("article_count").cast("string"), F.lit(HEAD[1]), F.array_join(F.transform("parts", lambda p: p["line"]), "；"))
    return whole.select("day", "article_count", text.alias("summary"), F.array_join(F.transform("parts", lambda p: p["id"]), ",").alias("article_ids"))
