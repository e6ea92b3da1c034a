"""The engine's tables on the given ones: articles on documents, sources and attempts on documents and events, items on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import texts, urls
from tidemill.plans.vocabulary import NAMES

DAY0 = 1704067200  # 2024-01-01 00:00:00 UTC


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chosen(values: list, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), n.cast("int"))


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, its state derived from its id and its label."""
    i = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return docs.select(
        i.alias("article_id"), F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"), "text", F.col("source").alias("source_name"), F.substring("source", 4, 9).cast("int").alias("source_no"),
        F.timestamp_seconds(DAY0 + i * 977 % 2592000).alias("published_at"), F.timestamp_seconds(DAY0 + i * 1511 % 2592000).alias("collected_at"),
        F.when(i % 10 < 6, "published").when(i % 10 < 8, "draft").when(i % 10 == 8, "pending_review").otherwise("blocked").alias("status"),
        F.when(i % 11 != 0, chosen(NAMES, i % 9)).alias("direction"), (i * 37 % 101).cast("int").alias("score"), F.when(i % 3 != 0, F.concat(F.lit("c"), F.expr("doc_id div 6").cast("string"))).alias("cluster_id"),
        (i % 5 != 0).alias("ai_processed"), "quality",
    )


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("source_no")
    names = table(spark, sf_dir, "documents").select(F.col("source").alias("source_name")).distinct().withColumn("source_no", F.substring("source_name", 4, 9).cast("int"))
    return names.select(
        "source_name", "source_no", chosen(["authoritative", "validation", "signal"], n % 3).alias("tier"), chosen(["first_party", "editorial", "aggregator"], n % 4).alias("origin_policy"),
        (n % 7 != 0).alias("enabled"), F.when(n % 3 != 0, F.timestamp_seconds(DAY0 + n * 86400)).alias("next_fetch_at"), chosen(["media_analysis", "lab", "community"], n % 3).alias("category"),
    )


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch attempts: events of type error are failures, of a value above 200 for good."""
    e = table(spark, sf_dir, "events")
    failed = F.col("event_type") == "error"
    return e.select(F.concat(F.lit("src"), F.col("user_id") % 20).alias("source_name"), F.col("ts").alias("at"), F.col("event_id").alias("attempt_id"), (~failed).alias("ok"), (failed & (F.col("value") > 200)).alias("gone"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collected items: pages whose URLs fall together in parts, with their sources' standing."""
    i = F.col("page_id")
    url = F.concat(F.lit("HTTPS://"), urls.host(F.col("url")), F.lit(":443/a/"), i % 97, F.lit("?utm_source=x&b="), i % 3, F.lit("&a=1#top"))
    told = F.struct(F.when(i % 41 != 0, texts.page_title(F.col("html"))).alias("title"), F.when(i % 61 != 0, texts.html_to_text(F.col("html"))).alias("content"))
    p = table(spark, sf_dir, "pages").select("page_id", "url", F.explode(F.array(told)).alias("told"))  # a page is read once, however often title and content are named
    return p.select(
        i.alias("item_id"), F.col("told.title").alias("title"), F.when(i % 53 == 0, "").when(i % 59 == 0, "ftp://x/y").otherwise(url).alias("url"),
        F.col("told.content").alias("content"), F.concat(F.lit("src"), i % 20).alias("source_name"),
        chosen(["authoritative", "validation", "signal"], i % 20 % 3).alias("tier"), chosen(["first_party", "editorial", "aggregator"], i % 20 % 4).alias("origin_policy"),
    )


def lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An editors' lexicon for this corpus: ASCII words of the benchmark, dealt out to the 71 dimensions by their hash."""
    from pyspark.sql import Window

    from tidemill.plans.vocabulary import dimensions

    words = table(spark, sf_dir, "benchmark").select(F.explode(texts.latin_tokens(F.col("text"))).alias("term")).where("length(term) >= 4").distinct()
    # Numbered in order of hash without one task for all: within each of 256 parts of the hash, after the words of the parts before.
    parted = words.withColumn("hash", F.md5("term")).withColumn("part", F.substring("hash", 1, 2))
    before = parted.groupBy("part").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # 256 rows
    dealt = parted.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy("hash", "term"))).join(before.select("part", "before"), "part").withColumn("no", F.col("before") + F.col("place") - 1)
    named = dimensions(spark).withColumn("slot", F.row_number().over(Window.orderBy("direction_no", "dimension_no")) - 1)
    kind = F.when(F.floor(F.col("no") / 71) % 3 == 0, "strong").otherwise("weak")
    return dealt.join(F.broadcast(named), F.col("no") % 71 == F.col("slot")).select("direction", "dimension", kind.alias("kind"), "term")


def phrase_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of two words each, some thousands: what stands side by side in benchmark texts, dealt out to the 71 dimensions by its hash; every third is strong."""
    from pyspark.sql import Window

    from tidemill.plans.vocabulary import dimensions

    words = F.filter(F.split(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")
    cut = table(spark, sf_dir, "benchmark").select(F.explode(F.array(words)).alias("w")).where("size(w) > 1")
    pairs = cut.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.get("w", i - 1), F.get("w", i)))).alias("at", "phrase"))
    told = pairs.groupBy("phrase").agg(F.min("at").alias("at")).withColumn("slot", F.conv(F.substring(F.md5("phrase"), 1, 6), 16, 10).cast("int") % 71)
    named = dimensions(spark).withColumn("slot", F.row_number().over(Window.orderBy("direction_no", "dimension_no")) - 1)  # 71 rows
    strong = F.col("at") % 3 == 0
    return told.join(F.broadcast(named), "slot").select("direction", "dimension", F.when(strong, "strong").otherwise("weak").alias("kind"), F.when(strong, F.concat("phrase", F.lit("[ ,.]"))).otherwise(F.col("phrase")).alias("pattern"), F.array("phrase").alias("literals"))
