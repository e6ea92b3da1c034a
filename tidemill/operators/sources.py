"""Feed sources: canonical feed URLs and validation as a reason column; display of hot articles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import texts, times, urls
from tidemill.operators.articles import ORIGINS, TIERS

FEED_TYPES = ["rss", "atom", "api", "web"]


def feed_url(url: Column) -> Column:
    """A feed's identity: canonical, without port checks passed, and without a closing slash; '' if it can't be used."""
    plain = F.regexp_extract(F.coalesce(urls.part(url, "AUTHORITY"), F.lit("")), r":([0-9]+)$", 1) == ""
    return F.when(plain & urls.unsafe_reason(url).isNull(), F.regexp_replace(urls.canonical_url(url), r"/+(?=$|\?)", "")).otherwise("")


def problem(source: dict[str, Column]) -> Column:
    """The first rule that a source breaks: name, type, tier, url, policy, policy_tier; null if none."""
    return (
        F.when(F.coalesce(F.trim(source["name"]), F.lit("")) == "", "name").when(~F.coalesce(F.lower(F.trim(source["feed_type"])).isin(FEED_TYPES), F.lit(False)), "feed_type")
        .when(~F.coalesce(source["tier"].isin(*TIERS), F.lit(False)), "tier").when(feed_url(source["url"]) == "", "url")
        .when(source["origin_policy"].isNotNull() & ~source["origin_policy"].isin(*ORIGINS), "policy").when((source["origin_policy"] == "aggregator") & (source["tier"] == "authoritative"), "policy_tier")
    )


def display_title(title: Column, most: int = 46) -> Column:
    """Single spaces, cut at most characters with an ellipsis."""
    clean = texts.collapsed(title)
    return F.when(F.length(clean) > most, F.concat(F.rtrim(F.substring(clean, 1, most - 1)), F.lit("…"))).otherwise(clean)


def to_rescore(articles: DataFrame, as_of: Column, least: int = 12) -> DataFrame:
    """(article_id, ready): drafts of as_of's Shanghai day that no model has scored; ready if title and text have least characters."""
    today = times.shanghai_day(F.col("collected_at")) == times.shanghai_day(as_of)
    ready = F.length(F.concat(F.coalesce(texts.collapsed(F.col("title")), F.lit("")), F.coalesce(texts.collapsed(F.col("text")), F.lit("")))) >= least
    return articles.where((F.col("status") == "draft") & ~F.coalesce("ai_processed", F.lit(False)) & today).select("article_id", ready.alias("ready"))


def changed(sources: DataFrame, changes: DataFrame, key: str, fields: list[str]) -> tuple[DataFrame, DataFrame]:
    """The sources after a feed of changes, and what became of the changes (outcome, op, n).

    sources: key, fields, enabled, next_fetch_at; changes: key, seq (unique within a key), op, fields, enabled. In order of seq, create makes a source that isn't
    there, enabled unless it says otherwise; patch sets the fields that it names (the others are null); toggle sets enabled, and clears
    next_fetch_at when it enables; delete takes the source away. A create of what is there is a conflict, all else on what is not
    there is not_found, an op of another name is unknown_op; these change nothing. All by aggregates that tasks combine: after a source's last delete only its first create and what
    follows counts, and of each field the last value.
    """
    known = ["create", "patch", "toggle", "delete"]
    fine = changes.where(F.col(key).isNotNull() & F.col("op").isin(known))
    base = sources.select(key, F.lit(True).alias("~base"))
    gone = fine.where("op = 'delete'").groupBy(key).agg(F.max("seq").alias("~gone"))
    since = fine.join(gone, key, "left").join(base, key, "left")
    fresh = (F.col("op") == "create") & F.when(F.col("~gone").isNull(), F.col("~base").isNull()).otherwise(F.col("seq") > F.col("~gone"))
    made = since.groupBy(key).agg(F.min(F.when(fresh, F.col("seq"))).alias("~made"), F.max("~gone").alias("~gone"), F.max("~base").alias("~base"))
    living = made.where("`~made` IS NOT NULL OR (`~gone` IS NULL AND `~base`)")
    counted = fine.join(living, key).where((F.col("op") != "create") | (F.col("seq") == F.col("~made"))).where(F.col("~made").isNull() | (F.col("seq") >= F.col("~made"))).where("op <> 'delete'")
    last = lambda value, test: F.max(F.when(test & value.isNotNull(), F.struct("seq", value.alias("v"))))
    sets = F.col("op").isin("create", "patch")
    folded = counted.groupBy(key).agg(
        *(last(F.col(c), sets)["v"].alias(f"~{c}") for c in fields), last(F.col("enabled"), F.col("op").isin("create", "toggle"))["v"].alias("~enabled"),
        F.max(F.coalesce((F.col("op") == "toggle") & F.col("enabled"), F.lit(False))).alias("~cleared"), F.max(F.col("op") == "create").alias("~new"),
    )
    dead = made.join(living, key, "left_anti").select(key)
    both = sources.join(dead, key, "left_anti").join(folded, key, "full")
    old = lambda c: F.when(~F.coalesce("~new", F.lit(False)), F.col(c))
    after = both.select(
        key, *(F.coalesce(f"~{c}", old(c)).alias(c) for c in fields), F.coalesce("~enabled", old("enabled"), F.lit(True)).alias("enabled"),
        F.when(~F.coalesce("~cleared", F.lit(False)), old("next_fetch_at")).alias("next_fetch_at"),
    )
    # Whether a source is there at a change is told by the last create or delete before it: what it was doesn't matter.
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    life = F.last(F.when(F.col("op").isin("create", "delete"), F.col("op")), ignorenulls=True).over(before)
    there = fine.join(base, key, "left").withColumn("~there", F.when(life.isNull(), F.coalesce("~base", F.lit(False))).otherwise(life == "create"))
    outcome = F.when(F.col("op") == "create", F.when(F.col("~there"), "conflict").otherwise("applied")).when(F.col("~there"), "applied").otherwise("not_found")
    odd = changes.where(F.col(key).isNull() | ~F.coalesce(F.col("op").isin(known), F.lit(False))).select(F.when(F.col(key).isNull(), "not_found").otherwise("unknown_op").alias("outcome"), "op")
    return after, there.select(outcome.alias("outcome"), "op").unionByName(odd).groupBy("outcome", "op").agg(F.count("*").alias("n"))
