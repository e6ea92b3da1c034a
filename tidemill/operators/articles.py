"""Normalize, deduplicate, insert, gate and publish: operators on tables of items, articles and sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import texts, times, urls
from tidemill.plans.vocabulary import FULL, NAMES
from tidemill.sources.folders import shared_folder

ORIGINS = {"first_party": 0, "editorial": 1, "aggregator": 2}
TIERS = {"authoritative": 0, "validation": 1, "signal": 2}


def rank_of(column: Column, ranks: dict[str, int], other: int) -> Column:
    return reduce(lambda at, x: at.when(column == x[0], x[1]), list(ranks.items())[1:], F.when(column == next(iter(ranks)), next(iter(ranks.values())))).otherwise(other)


def drop_reason(title: Column, url: Column, content: Column, canonical: Column | None = None) -> Column:
    """The first test that an item fails, or null. canonical: the URL's canonical form, if it is there already."""
    return (
        F.when(F.coalesce(texts.collapsed(title), F.lit("")) == "", "title")
        .when(F.coalesce(F.trim(url), F.lit("")) == "", "url_missing")
        .when((urls.canonical_url(url) if canonical is None else canonical) == "", "url_invalid")
        .when(F.coalesce(texts.collapsed(content), F.lit("")) == "", "content")
    )


def normalized(items: DataFrame) -> DataFrame:
    """items (title, url, content, ...) with drop_reason, title cleaned, dedup_url and content_hash.

    content is plain text; where it is empty, raw_content (HTML) stands in unless content_status is missing. canonical_url
    goes before url as identity. The last three columns may be absent.
    """
    content = F.col("content")
    if "raw_content" in items.columns:
        raw = F.nullif(texts.html_to_text(F.col("raw_content")), F.lit(""))
        missing = F.col("content_status") == "missing" if "content_status" in items.columns else F.lit(False)
        content = F.coalesce(F.nullif(texts.collapsed(content), F.lit("")), F.when(~F.coalesce(missing, F.lit(False)), raw), F.lit(""))
    spoken = F.nullif(urls.canonical_url(F.col("canonical_url")), F.lit("")) if "canonical_url" in items.columns else F.lit(None).cast("string")
    # Each step is a column of its own, so that what later ones name is computed once for an item.
    own = F.struct(texts.normalized_title(F.col("title")).alias("title"), content.alias("content"), urls.canonical_url(F.col("url")).alias("own_url"), spoken.alias("spoken"))
    out = items.withColumn("~own", F.explode(F.array(own))).withColumn("title", F.col("~own.title")).withColumn("content", F.col("~own.content"))
    told = F.struct(drop_reason(F.col("title"), F.col("url"), F.col("content"), F.col("~own.own_url")).alias("drop_reason"), F.coalesce("~own.spoken", "~own.own_url").alias("dedup_url"))
    out = out.withColumn("~told", F.explode(F.array(told))).withColumn("drop_reason", F.col("~told.drop_reason")).withColumn("dedup_url", F.col("~told.dedup_url"))
    return out.drop("~own", "~told").withColumn("content_hash", texts.content_hash(F.col("title"), F.col("dedup_url")))


def batch_winners(items: DataFrame) -> DataFrame:
    """One item per dedup_url: by origin policy, tier, longer content, source, title, hash and URL.

    For items whose hashes normalized() made: they are a function of title and URL, so that equal hashes have equal URLs
    and the URL alone decides. A hot URL is reduced in tasks first: the best row is an aggregate, not a window.
    """
    row = F.struct(*items.columns)
    return items.where(F.col("dedup_url") != "").groupBy("dedup_url").agg(F.min_by(row, preference()).alias("row")).select("row.*")


def preference() -> Column:
    """The order in which items of one identity are preferred, as a struct of the columns of normalized items."""
    return F.struct(
        rank_of(F.col("origin_policy"), ORIGINS, 3).alias("o"), rank_of(F.col("tier"), TIERS, 3).alias("t"), (-F.length("content")).alias("c"),
        F.col("source_name").alias("s"), F.col("title").alias("x"), F.col("content_hash").alias("h"), F.col("url").alias("u"),
    )


def distinct_items(items: DataFrame, key: str) -> DataFrame:
    """Items that stay if all are taken in order of preference and one whose dedup_url or content_hash was taken goes.

    Hashes may be given ones that tell nothing of the URL. In each round the items that are first by both identities stay
    and what shares either with them goes; the rest, each behind a better item of undecided fate, meets again. Rounds are
    checkpoints in the shared folder; items whose hashes are their own are done after one. key: a column that is unique.
    """
    shared_folder(items.sparkSession)
    left = items.where(F.col("dedup_url") != "").select("dedup_url", "content_hash", F.struct(preference().alias("p"), F.col(key).alias("k")).alias("at")).checkpoint()
    stays = None
    while True:
        by = {c: left.groupBy(c).agg(F.min("at").alias(f"first_{c}")) for c in ("dedup_url", "content_hash")}
        ranked = left.join(by["dedup_url"], "dedup_url").join(by["content_hash"], "content_hash")
        new = ranked.where((F.col("at") == F.col("first_dedup_url")) & (F.col("at") == F.col("first_content_hash"))).select("dedup_url", "content_hash", "at").checkpoint()
        stays = new if stays is None else stays.unionByName(new)
        left = left.join(new.select("dedup_url"), "dedup_url", "left_anti").join(new.select("content_hash"), "content_hash", "left_anti").checkpoint()
        if left.isEmpty():
            return items.join(stays.select(F.col("at.k").alias(key)), key, "left_semi")


def fresh(items: DataFrame, history: DataFrame, recent: DataFrame | None = None) -> DataFrame:
    """items of which neither dedup_url nor content_hash stands in history: two anti joins. recent: what hashes are compared with, if less than URLs."""
    by_url = items.join(history.select("dedup_url").distinct(), "dedup_url", "left_anti")
    return by_url.join((history if recent is None else recent).select("content_hash").distinct(), "content_hash", "left_anti")


def upserted(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """A new snapshot: rows of new replace those of old with the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new)


def duplicate_gates(batch: DataFrame, history: DataFrame) -> DataFrame:
    """(article_id, reason): same_url or same_title of an older article, then same_batch_url or same_batch_title.

    The owner of a URL or title is the earliest article by (collected_at, article_id); batch and history have article_id,
    dedup_url, title and collected_at.
    """
    def keyed(df: DataFrame) -> DataFrame:
        return df.select("article_id", "collected_at", F.col("dedup_url").alias("same_url"), texts.title_key(F.col("title")).alias("same_title"))

    out, at = keyed(batch), F.struct("collected_at", "article_id")
    both = out.withColumn("old", F.lit(False)).unionByName(keyed(history).withColumn("old", F.lit(True)))
    for kind in ("same_url", "same_title"):
        owners = both.where(F.col(kind) != "").groupBy(kind).agg(F.min(F.when(F.col("old"), at))["article_id"].alias(f"old_{kind}"), F.min(F.when(~F.col("old"), at))["article_id"].alias(f"new_{kind}"))
        out = out.join(owners, kind, "left")
    reason = F.coalesce(
        *(F.when(F.col(f"old_{k}") != F.col("article_id"), k) for k in ("same_url", "same_title")),
        *(F.when(F.col(f"new_{k}") != F.col("article_id"), k.replace("same", "same_batch")) for k in ("same_url", "same_title")),
    )
    return out.withColumn("reason", reason).where(F.col("reason").isNotNull()).select("article_id", "reason")


#: What tells in a source's name or URL that it hands on what others publish, and domains that do.
BRIDGE, BRIDGES = r"(?i)公众号桥接|桥接|rsshub|anyfeeder|聚合|转载", ["mp.weixin.qq.com"]
EDITORIAL = "36kr.com jiqizhixin.com qbitai.com infoq.cn leiphone.com geekpark.net zhidx.com jazzyear.com deeptechchina.com huxiu.com latepost.com".split()


def origin_policy(explicit: Column, url: Column, category: Column, authoritative: list[str], editorial: list[str] = EDITORIAL, source_url: Column | None = None, source_name: Column | None = None, bridges: list[str] = BRIDGES) -> Column:
    """Whether a source speaks for itself, edits or collects; an explicit policy goes first.

    url is where an article was found, source_url and source_name are its source's. Without a host of url, or where the source hands on what
    others publish, it collects; else either domain may be authoritative or editorial (the lists are domains, matched with their subdomains), and what nothing tells of collects too.
    """
    source_url, source_name = (F.coalesce(c, F.lit("")) if c is not None else F.lit("") for c in (source_url, source_name))
    hosts = [F.coalesce(urls.host(u), F.lit("")) for u in (url, source_url)]

    def of(two: Column) -> Column:
        up = F.array_union(urls.suffixes(two["found"]), urls.suffixes(two["source"]))
        has = lambda domains: F.arrays_overlap(up, F.array(*map(F.lit, domains)))
        bridge = F.concat_ws(" ", source_name, source_url).rlike(BRIDGE) | two["source"].isin(bridges)
        return (
            F.when(explicit.isin(*ORIGINS), explicit).when((two["found"] == "") | bridge, "aggregator").when(has(authoritative), "first_party")
            .when(F.coalesce(category == "media_analysis", F.lit(False)) | has(editorial), "editorial").otherwise("aggregator")
        )

    return texts.bound(F.struct(hosts[0].alias("found"), hosts[1].alias("source")), of)


def admitted(candidates: DataFrame, used: DataFrame, per_source: int, per_day: int) -> DataFrame:
    """Candidates whose turn falls in the quotas, by tier and the source's use so far: two row numbers.

    candidates: article_id, source_name, tier; used: source_name, n. The second number runs over at most per_source rows
    of a source, cut to per_day rows by a top-k before it is numbered.
    """
    total = used.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    so_far = candidates.join(used, "source_name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    order = [rank_of(F.col("tier"), TIERS, 3), F.col("article_id")]
    part = Window.partitionBy("source_name", F.pmod(F.xxhash64("article_id"), F.lit(64))).orderBy(*order)
    so_far = so_far.withColumn("part", F.row_number().over(part)).where(F.col("part") <= per_source).drop("part")  # a hot source is cut in parts first
    turn = F.row_number().over(Window.partitionBy("source_name").orderBy(*order))
    own = so_far.withColumn("turn", turn).where(F.col("turn") + F.col("n") <= per_source)
    first = own.orderBy(rank_of(F.col("tier"), TIERS, 3), "n", "article_id").limit(per_day)
    at = F.row_number().over(Window.orderBy(rank_of(F.col("tier"), TIERS, 3), "n", "article_id"))
    return first.withColumn("seat", at).crossJoin(F.broadcast(total)).where(F.col("seat") + F.col("total") <= per_day).select("article_id", "source_name", "turn", "seat")


def quality_reason(article: dict[str, Column], as_of: Column, most_failures: int) -> Column:
    """stale, source_unreliable or a probe's reason; null passes."""
    old = times.age_days(article["published_at"], as_of) > 7
    return (
        F.when(article["revalidated"] & old, "stale").when((article["fetches"] >= 3) & (article["consecutive_failures"] >= most_failures), "source_unreliable")
        .when(article["probe_status"].isin(404, 410), "link_dead").when(article["probe_status"] >= 400, "link_probe_review")
    )


def publishable(article: dict[str, Column], threshold: Column) -> Column:
    """All publication conditions; ai_processed only denies where it is false."""
    scores, quotes = article["dimension_scores"], article["quotes"]
    full = F.map_keys(F.map_filter(scores, lambda _, v: v >= FULL))
    return (
        article["direction"].isin(NAMES) & ~article["status"].isin("pending_review", "blocked") & (article["provenance"].isin("traced", "first_party", "trusted_editorial") | article["override"])
        & ~F.coalesce(~article["ai_processed"], F.lit(False)) & (article["score"] >= threshold) & article["complete"] & F.forall(full, lambda d: F.coalesce(F.try_element_at(quotes, d), F.lit("")) != "")
    )


def representatives(articles: DataFrame) -> DataFrame:
    """The best row of each cluster (its own if it has none): score, then time, then id."""
    key = F.coalesce("cluster_id", F.concat(F.lit("article:"), F.col("article_id").cast("string")))
    order = F.struct(F.col("score").alias("a"), F.unix_micros("published_at").alias("b"), (-F.col("article_id")).alias("c"))
    return articles.withColumn("cluster_key", key).groupBy("cluster_key").agg(F.max_by(F.struct(*articles.columns), order).alias("row")).select("cluster_key", "row.*")


def front_page(articles: DataFrame, limit: int = 20) -> DataFrame:
    """(article_id, rank, reason) of each cluster's best article and of those without a valid direction: round robin over
    directions with caps by source and direction. reason: selected (then with a rank), source_cap, direction_cap,
    limit_reached, invalid_direction.

    Only the rows that can be taken reach the one sequential group: of each direction and source the best cap rows, at
    most 9 directions x sources x cap. What is left gets its reason from the caps reached.
    """
    import pandas as pd

    source_cap, direction_cap = max(2, -(-limit // 5)), max(2, -(-limit // 2))
    best = representatives(articles.where(F.col("direction").isin(NAMES)))  # a cluster is spoken for by its best valid row
    place = Window.partitionBy("direction", "source_name").orderBy(F.desc("score"), F.desc("published_at"), "article_id")
    near = best.withColumn("n", F.row_number().over(place)).where(F.col("n") <= source_cap)
    queue = Window.partitionBy("direction").orderBy(F.desc("score"), F.desc("published_at"), "article_id")
    near = near.withColumn("at", F.row_number().over(queue)).where(F.col("at") <= limit * source_cap)

    def pick(frame: pd.DataFrame) -> pd.DataFrame:
        queues = {d: g.sort_values("at")[["article_id", "source_name"]].values.tolist() for d, g in frame.groupby("direction")}
        by_source, by_direction, taken = {}, {}, []
        moved = True
        while moved and len(taken) < limit:
            moved = False
            for direction in NAMES:
                while queues.get(direction) and len(taken) < limit and by_direction.get(direction, 0) < direction_cap:
                    article, source = queues[direction].pop(0)
                    if by_source.get(source, 0) < source_cap:
                        by_source[source] = by_source.get(source, 0) + 1
                        by_direction[direction] = by_direction.get(direction, 0) + 1
                        taken.append(article)
                        moved = True
                        break
        return pd.DataFrame({"article_id": pd.Series(taken, dtype="int64"), "rank": pd.Series(range(100, 100 + len(taken)), dtype="int32")})

    few = near.select("article_id", "source_name", "direction", "at").withColumn("one", F.lit(1))
    taken = few.groupBy("one").applyInPandas(lambda f: pick(f), "article_id long, rank int")
    told = best.select("article_id", "source_name", "direction").join(taken, "article_id", "left")
    chosen = told.where("rank IS NOT NULL")
    by_source = chosen.groupBy("source_name").agg(F.count("*").alias("of_source"))
    by_direction = chosen.groupBy("direction").agg(F.count("*").alias("of_direction"))
    told = told.join(by_source, "source_name", "left").join(by_direction, "direction", "left")
    reason = (
        F.when(F.col("rank").isNotNull(), "selected").when(F.coalesce("of_source", F.lit(0)) >= source_cap, "source_cap")
        .when(F.coalesce("of_direction", F.lit(0)) >= direction_cap, "direction_cap").otherwise("limit_reached")
    )
    invalid = articles.where(~F.coalesce(F.col("direction").isin(NAMES), F.lit(False))).select("article_id", F.lit(None).cast("int").alias("rank"), F.lit("invalid_direction").alias("reason"))
    return told.select("article_id", "rank", reason.alias("reason")).unionByName(invalid)


def health(attempts: DataFrame) -> DataFrame:
    """Per source: fetches, successes, rate, consecutive failures since the last success, cooldown in seconds.

    attempts: source_name, at, attempt_id, ok, gone. All by aggregates that tasks combine: no source's log meets in one.
    """
    order = F.struct("at", "attempt_id")
    last_ok = attempts.where("ok").groupBy("source_name").agg(F.max(order).alias("last_ok"))
    failed = attempts.join(last_ok, "source_name", "left").withColumn("since", ~F.col("ok") & (F.col("last_ok").isNull() | (order > F.col("last_ok"))))
    out = failed.groupBy("source_name").agg(F.count("*").alias("fetches"), F.count_if("ok").alias("successes"), F.count_if("since").alias("consecutive_failures"), F.max_by("gone", order).alias("gone"))
    rate = F.when(F.col("fetches") > 0, times.rounded(F.col("successes") / F.col("fetches") * 10000) / 100).otherwise(0.0)
    return out.withColumn("success_rate", rate).withColumn("cooldown_seconds", times.cooldown_seconds(F.col("consecutive_failures"), F.col("gone"))).drop("gone")
