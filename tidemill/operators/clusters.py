"""Event clusters: features of titles, candidate keys, pair scores, complete-link groups that known clusters seed."""

from __future__ import annotations

from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import texts, urls
from tidemill.operators.components import connected
from tidemill.sources.storage import few, removed, written

PER_KEY, PER_RECORD = 50, 80
#: Shares of terms and anchors in a pair's score, and the least score with and without a shared model or entity.
TERMS, ANCHORS, NEAR, FAR = 0.72, 0.28, 0.30, 0.42
#: Words that tell nothing of an event, names of organisations with what they are counted as, families of models.
GENERIC = ["发布", "正式", "宣布", "推出", "上线", "更新", "模型", "人工智能", "大模型", "新闻", "报告", "研究", "测试", "公司", "产品", "版本", "latest", "release", "launch", "announces", "announced", "update", "model", "models", "new", "the"]
ALIASES = {
    "openai": "openai", "anthropic": "anthropic", "google": "google", "谷歌": "google", "deepmind": "google", "microsoft": "microsoft", "微软": "microsoft", "meta": "meta", "amazon": "amazon", "亚马逊": "amazon", "nvidia": "nvidia",
    "英伟达": "nvidia", "alibaba": "alibaba", "阿里": "alibaba", "baidu": "baidu", "百度": "baidu", "tencent": "tencent", "腾讯": "tencent", "bytedance": "bytedance", "字节": "bytedance", "xai": "xai", "mistral": "mistral",
}
FAMILIES = ["gpt", "claude", "gemini", "llama", "qwen", "deepseek", "kimi", "longcat", "mistral", "grok", "phi", "copilot", "codex"]
#: Repeated groups are bounded or never given back: Java's matcher would recurse with their number otherwise.
EDGE, END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
MODEL = rf"({EDGE}(?:{'|'.join(FAMILIES)})[\s_\-]*v?[0-9]+(?:\.[0-9]+){{0,20}}{END})"
DATE = rf"({EDGE}20[0-9]{{2}}[\-/.][0-9]{{1,2}}(?:[\-/.][0-9]{{1,2}})?{END}|20[0-9]{{2}}年[0-9]{{1,2}}月(?:[0-9]{{1,2}}日)?)"
NUMBER = rf"({EDGE}[0-9]+(?:\.[0-9]+)?(?:%(?=[A-Za-z0-9_])|[kmbt]{END})|[0-9]+(?:\.[0-9]+)?[万亿兆])"
TOKEN = r"([a-z][a-z0-9]*+(?:[._\-][a-z0-9]++)*+)"
#: Pairs that a part has at most for one task to group it; larger parts go by rounds of tables.
PART = 200_000
#: Records that a round decides one after another.
STEP = 10_000
KINDS = ["models", "entities", "dates", "numbers"]


def history(articles: DataFrame, as_of: Column, hours: int = 72, most: int = 1200) -> DataFrame:
    """Earlier articles that a new one may join: of the last hours, the newest first, most at most."""
    recent = articles.where((F.col("collected_at") >= as_of - F.make_dt_interval(F.lit(0), F.lit(hours))) & (F.col("collected_at") < as_of))
    return recent.orderBy(F.desc("collected_at"), "article_id").limit(most)


def all_of(text: Column, pattern: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))


def url_key(url: Column) -> Column:
    """Host and path of a URL, without slashes at the end; null if it is none."""
    return F.concat(F.lit("url:"), F.lower(urls.part(url, "HOST")), F.regexp_replace(F.coalesce(urls.part(url, "PATH"), F.lit("")), r"/+\z", ""))


def features(articles: DataFrame) -> DataFrame:
    """article_id, ord, cluster_id, title_key, terms, models, entities, dates, numbers, anchors, keys of articles (article_id, title, url, cluster_id, is_new).

    Titles are NFKC in lower case with single spaces. Terms are runs of two and three signs of CJK scripts, Latin tokens, models and
    entities, without words that tell nothing; anchors are the longer terms, models and entities. keys are in order of strength. Known
    articles come before new ones in order (ord), each by article_id; a new article's cluster_id isn't looked at.
    """
    title = F.lower(texts.collapsed(texts.composed(F.coalesce("title", F.lit("")))))
    told = F.when(~F.col("is_new"), F.col("cluster_id"))
    cut = articles.select("article_id", F.struct(F.coalesce("is_new", F.lit(True)).alias("new"), "article_id").alias("ord"), told.alias("cluster_id"), url_key(F.col("url")).alias("url_key"), F.explode(F.array(title)).alias("title_key"))
    models = F.array_distinct(F.transform(all_of(F.col("title_key"), MODEL), lambda m: F.regexp_replace(m, r"[\s_\-]+", "-")))
    entities = F.array_distinct(F.array_compact(F.array(*(F.when(F.col("title_key").contains(a), F.lit(e)) for a, e in ALIASES.items()))))
    told = F.struct(models.alias("models"), entities.alias("entities"), all_of(F.col("title_key"), DATE).alias("dates"), all_of(F.col("title_key"), NUMBER).alias("numbers"))
    cut = cut.select("*", F.explode(F.array(told)).alias("told")).select(*cut.columns, "told.*")  # each step is computed once, however often the next ones name it
    tokens = F.filter(all_of(F.col("title_key"), TOKEN), lambda t: F.length(t) >= 2)
    plain = F.filter(F.concat(texts.grams(F.col("title_key"), 2), texts.grams(F.col("title_key"), 3), tokens), lambda t: ~t.isin(GENERIC))
    cut = cut.select("*", F.explode(F.array(F.array_distinct(F.concat(plain, "models", "entities")))).alias("terms"))
    tagged = lambda kind, values: F.transform(values, lambda v: F.concat(F.lit(f"{kind}:"), v))
    cut = cut.select("*", F.explode(F.array(F.filter("terms", lambda t: F.length(t) >= F.when(t.rlike(texts.CJK), 3).otherwise(4)))).alias("long"))
    long, named = F.col("long"), F.concat(tagged("model", F.array_sort("models")), tagged("entity", F.array_sort("entities")))
    keys = F.concat(F.array_compact(F.array(F.col("url_key"), F.when(F.length("title_key") >= 6, F.concat(F.lit("title:"), "title_key")))), named, tagged("number", F.array_sort("numbers")), F.array_sort(long))
    return cut.select("article_id", "ord", "cluster_id", "title_key", "terms", *KINDS, F.array_distinct(F.concat(long, named)).alias("anchors"), F.array_distinct(keys).alias("keys"))


def first_of(listed: DataFrame, per_key: int) -> DataFrame:
    """The first per_key records of each key. A key's rows are cut in 64 parts before they meet, so that a hot key is no task of its own."""
    part = Window.partitionBy("key", F.pmod(F.xxhash64("article_id"), F.lit(64))).orderBy("ord")
    some = listed.withColumn("n", F.row_number().over(part)).where(F.col("n") <= per_key)
    return some.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("ord"))).where(F.col("n") <= per_key)


def candidates(found: DataFrame, per_key: int | None = PER_KEY, per_record: int | None = PER_RECORD) -> DataFrame:
    """(later, earlier): a record meets the first per_key records of each of its keys, at most per_record of them.

    A key's first records are one list, so that a record and a key are one row and not per_key of them; a record's lists then
    meet in order of its keys. None lifts a limit: then every pair that shares a key is a candidate, which grows with the square of the largest key.
    """
    listed = found.select("article_id", "ord", F.posexplode("keys").alias("place", "key"))
    if per_key is None or per_record is None:
        bucket = listed if per_key is None else first_of(listed, per_key)
        met = listed.alias("l").join(bucket.alias("b"), (F.col("l.key") == F.col("b.key")) & (F.col("b.ord") < F.col("l.ord")))
        first = met.groupBy(F.col("l.article_id").alias("later"), F.col("b.article_id").alias("earlier")).agg(F.min(F.struct("l.place", "b.ord")).alias("at"))
        if per_record is None:
            return first.select("later", "earlier")
        return first.withColumn("n", F.row_number().over(Window.partitionBy("later").orderBy("at"))).where(F.col("n") <= per_record).select("later", "earlier")
    bucket = first_of(listed, per_key).groupBy("key").agg(F.array_sort(F.collect_list("ord")).alias("firsts")).where(F.size("firsts") > 1)
    before = F.transform(F.filter("firsts", lambda o: o < F.col("ord")), lambda o: o["article_id"])
    met = listed.join(bucket, "key").select(F.col("article_id").alias("later"), F.struct("place", before.alias("ids")).alias("at"))
    ids = F.flatten(F.transform(F.array_sort(F.collect_list("at")), lambda x: x["ids"]))
    return met.groupBy("later").agg(ids.alias("ids")).select("later", F.explode(F.slice(F.array_distinct("ids"), 1, per_record)).alias("earlier"))


def compact(found: DataFrame, side: str) -> DataFrame:
    """(id, long, short, kinds, held, n_anchors) of features(), each with side before its name: hashes of terms that are anchors and that are not, of models to numbers
    with their kind in the last two bits, and which kinds there are, as bits. Whether a term is an anchor is the term's own; other anchors are models and entities."""
    hashed = lambda values: F.transform(values, lambda v: F.xxhash64(v))
    marked = lambda values, n: F.transform(values, lambda v: F.xxhash64(v).bitwiseAND(F.lit(-4)) + n)
    kinds = F.concat(*(marked(c, n) for n, c in enumerate(KINDS)))
    held = sum((F.when(F.size(c) > 0, 1 << n).otherwise(0) for n, c in enumerate(KINDS)), F.lit(0))
    out = {"id": F.col("article_id"), "long": hashed(F.array_intersect("terms", "anchors")), "short": hashed(F.array_except("terms", "anchors")), "kinds": kinds, "held": held, "n_anchors": F.size("anchors")}
    return found.select(*(c.alias(f"{side}_{n}") for n, c in out.items()))


def pair_scores(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """(later, earlier, score) of pairs that don't contradict and reach the least score.

    Pairs move once: with the later record's compact() features to the earlier one's, which are kept as a table of hashes in each task, so that
    pairs are not sorted.
    """
    both = pairs.join(compact(found, "a").hint("shuffle_hash"), F.col("later") == F.col("a_id")).join(compact(found, "b").hint("shuffle_hash"), F.col("earlier") == F.col("b_id"))
    shared = F.array_intersect("a_kinds", "b_kinds")
    told = lambda kinds, n: F.exists(kinds, lambda x: x.bitwiseAND(F.lit(3)) == n)
    meet = F.struct(F.size(F.array_intersect("a_long", "b_long")).alias("long"), F.size(F.array_intersect("a_short", "b_short")).alias("short"), F.when((F.size("a_kinds") > 0) & (F.size("b_kinds") > 0), shared).otherwise(F.array().cast("array<bigint>")).alias("kinds"))
    out = both.select("later", "earlier", "a_held", "b_held", "a_n_anchors", "b_n_anchors", *(((F.size(f"{s}_long") + F.size(f"{s}_short")).alias(f"{s}_n_terms")) for s in "ab"), F.explode(F.array(meet)).alias("x"))
    clash = F.lit(False)
    for n in range(len(KINDS)):
        clash = clash | ((F.col("a_held").bitwiseAND(F.col("b_held")).bitwiseAND(F.lit(1 << n)) > 0) & ~told("x.kinds", n))
    named = F.size(F.filter("x.kinds", lambda x: x.bitwiseAND(F.lit(3)) < 2))  # models and entities
    anchors = F.col("x.long") + named
    jaccard = lambda n, a, b: F.when(n > 0, n / (a + b - n)).otherwise(0.0)
    score = TERMS * jaccard(F.col("x.long") + F.col("x.short"), F.col("a_n_terms"), F.col("b_n_terms")) + ANCHORS * jaccard(anchors, F.col("a_n_anchors"), F.col("b_n_anchors"))
    out = out.select("later", "earlier", clash.alias("clash"), (named > 0).alias("core"), anchors.alias("shared"), score.alias("score"))
    return out.where(~F.col("clash") & (F.col("core") | (F.col("shared") >= 2)) & (F.col("score") >= F.when(F.col("core"), NEAR).otherwise(FAR))).select("later", "earlier", "score")


def complete_link(order: list, near: dict, seeds: dict) -> dict:
    """Each record's group: of the groups in which it is scored with every member the one of the highest mean, the first of equals.

    order: records in order; near: each one's scored records with scores, both ways; seeds: the known cluster of those that have
    one, which stand before all others. A group is named by its first record.
    """
    place, members, first, rank = {}, {}, {}, {r: n for n, r in enumerate(order)}
    for record in [*(r for r in order if r in seeds), *(r for r in order if r not in seeds)]:
        if record in seeds:
            at = first.setdefault(seeds[record], record)
        else:
            met: dict = {}
            for other, score in near.get(record, {}).items():
                if other in place:
                    met.setdefault(place[other], []).append(score)
            whole = {g: round(sum(got) / len(got), 9) for g, got in met.items() if len(got) == len(members[g])}
            at = min(whole, key=lambda g: (-whole[g], g not in seeds, rank[g]), default=record)
        members.setdefault(at, []).append(record)
        place[record] = at
    return place


def grouped_at_once(near: DataFrame, records: DataFrame) -> DataFrame:
    """(article_id, first) of small parts, each by complete_link() in one task. near: part, article_id, other, score; records: part, article_id, ord, cluster_id."""

    def work(key, lists: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        order = lists.sort_values("no")["article_id"].tolist()
        seeds = {a: c for a, c in zip(lists["article_id"], lists["cluster_id"], strict=True) if c is not None and c == c}
        scored: dict = {}
        for a, b, score in zip(links["article_id"], links["other"], links["score"], strict=True):
            scored.setdefault(a, {})[b] = score
        place = complete_link(order, scored, seeds)
        return pd.DataFrame({"article_id": pd.Series(list(place), dtype="int64"), "first": pd.Series(list(place.values()), dtype="int64")})

    numbered = records.withColumn("no", F.row_number().over(Window.partitionBy("part").orderBy("ord"))).select("part", "article_id", "cluster_id", "no")
    return numbered.groupBy("part").cogroup(near.select("part", "article_id", "other", "score").groupBy("part")).applyInPandas(work, "article_id long, first long")


def decided_in_order(rows: DataFrame) -> DataFrame:
    """(article_id, first) of the earliest open records, one after another in one task; rows: article_id, spot, links (other, score) to open ones before it, groups (first, met, total, n, head) that it fits as they are."""

    def work(batches):
        place, first_spot, size = {}, {}, {}
        for batch in batches:
            ids, out = [], []
            for row in batch.to_pylist():
                met = {}
                for g in row["groups"] or []:
                    met[g["first"]] = [g["met"], g["total"]]
                    size.setdefault(g["first"], g["n"])
                    first_spot.setdefault(g["first"], flat(g["head"]))
                for x in row["links"] or []:
                    got = met.setdefault(place[x["other"]], [0, 0.0])
                    got[0] += 1
                    got[1] += x["score"]
                whole = {g: round(total / n, 9) for g, (n, total) in met.items() if n == size[g]}
                at = min(whole, key=lambda g: (-whole[g], first_spot[g]), default=row["article_id"])
                if at == row["article_id"]:
                    first_spot[at] = flat(row["spot"])
                place[row["article_id"]] = at
                size[at] = size.get(at, 0) + 1
                ids.append(row["article_id"])
                out.append(at)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.int64())], ["article_id", "first"])

    return rows.coalesce(1).sortWithinPartitions("spot").mapInArrow(work, "article_id long, first long")


def flat(value) -> tuple:
    """A struct as a tuple, which compares in the order of its fields."""
    return tuple(map(flat, value.values())) if isinstance(value, dict) else value


def grouped_by_rounds(near: DataFrame, records: DataFrame, step: int = STEP) -> DataFrame:
    """(article_id, first) as complete_link() gives them, for parts of any size, by rounds.

    A round decides the first step open records, one after another, as nothing open stands before them. All at once it decides what has no
    open record before it that it is scored with, if it fits no group, or if no open record before it fits the group that it likes best:
    groups only cease to fit, so that nothing that is still open can change its choice. What a record has met is kept as a
    row for each group that it still fits; links to decided records and rows of decided ones go.
    """
    spot = F.struct(F.col("cluster_id").isNull().alias("free"), "ord")  # seeds stand before all others
    every = written(records.select("article_id", spot.alias("spot"), "cluster_id"), "records")
    spots = every.select("article_id", "spot")
    links = near.select("article_id", "other", "score").join(spots, "article_id").join(spots.select(F.col("article_id").alias("other"), F.col("spot").alias("other_spot")), "other")
    links = written(links.where("spot.free AND other_spot < spot").select("article_id", "spot", "other", "score"), "links")
    seeded = every.where("cluster_id IS NOT NULL")
    heads = seeded.groupBy("cluster_id").agg(F.min_by("article_id", "spot").alias("first"))
    new = written(seeded.join(heads, "cluster_id").select("article_id", "first", "spot"), "decided")
    left = written(every.where("cluster_id IS NULL").select("article_id", "spot"), "open")
    sizes, met, decided = None, None, [new]
    while not left.isEmpty():
        added = new.groupBy("first").agg(F.count("*").alias("n"), F.min("spot").alias("head"))
        tables = [links] + ([sizes, met] if sizes is not None else [])
        sizes_ = written(added if sizes is None else sizes.unionByName(added).groupBy("first").agg(F.sum("n").alias("n"), F.min("head").alias("head")), "sizes")
        told = links.join(new.select(F.col("article_id").alias("other"), "first"), "other").groupBy("article_id", "spot", "first").agg(F.count("*").alias("met"), F.sum("score").alias("total"))
        if met is not None:
            told = met.unionByName(told).groupBy("article_id", "spot", "first").agg(F.sum("met").alias("met"), F.sum("total").alias("total"))
        whole = told.join(sizes_, "first").where("met = n")
        links_ = links.join(new.select(F.col("article_id").alias("other")), "other", "left_anti")
        if met is not None:
            whole, links_ = (x.join(left.select("article_id"), "article_id", "left_semi") for x in (whole, links_))
        whole, links = written(whole.select("article_id", "spot", "first", "met", "total", "n", "head"), "whole"), written(links_.select("article_id", "spot", "other", "score"), "links")
        met, sizes = whole.select("article_id", "spot", "first", "met", "total"), sizes_

        block = written(left.orderBy("spot").limit(step), "block")
        own = block.select("article_id")
        known = whole.join(own, "article_id", "left_semi").groupBy("article_id").agg(F.collect_list(F.struct("first", "met", "total", "n", "head")).alias("groups"))
        before = links.join(own, "article_id", "left_semi").groupBy("article_id").agg(F.collect_list(F.struct("other", "score")).alias("links"))
        first = decided_in_order(block.join(known, "article_id", "left").join(before, "article_id", "left").select("article_id", "spot", "links", "groups"))

        earliest = whole.groupBy("first").agg(F.min("spot").alias("earliest"))
        best = whole.groupBy("article_id").agg(F.min_by(F.struct("first"), F.struct((-F.round(F.col("total") / F.col("met"), 9)).alias("m"), "head")).alias("x")).select("article_id", F.col("x.first").alias("first"))
        free = left.join(links.select("article_id").distinct(), "article_id", "left_anti").join(own, "article_id", "left_anti")
        chosen = free.join(best, "article_id", "left").join(earliest, "first", "left").where("first IS NULL OR earliest = spot")
        new = first.join(block, "article_id").select("article_id", "first", "spot").unionByName(chosen.select("article_id", F.coalesce("first", "article_id").alias("first"), "spot"))
        new = written(new, "decided")
        decided.append(new)
        after = written(left.join(new.select("article_id"), "article_id", "left_anti"), "open")
        for table in (*tables, left, block):
            removed(table)
        left = after
    return reduce(DataFrame.unionByName, decided).select("article_id", "first")


def assigned(found: DataFrame, pairs: DataFrame, part: int = PART, step: int = STEP) -> DataFrame:
    """(article_id, first, cluster_id) of features() and their scored pairs: complete-link groups and known clusters; others have no row.

    first is the group's first article. Parts of at most part pairs, which are bounded, are grouped in one task each; larger ones by
    rounds, of which each decides step records one after another besides. cluster_id is the known cluster's, or made by named(); it is null where it has to be made.
    """
    told = found.select("article_id", "ord", "cluster_id")
    pairs = written(pairs, "pairs")
    # What hangs together by pairs or by a known cluster is a part.
    seeds = told.where("cluster_id IS NOT NULL")
    heads = seeds.groupBy("cluster_id").agg(F.min("article_id").alias("earlier"))
    ties = seeds.join(heads, "cluster_id").where("article_id <> earlier").select(F.col("article_id").alias("later"), "earlier")
    parts = connected(pairs.select("later", "earlier").unionByName(ties))
    near = pairs.select(F.col("later").alias("article_id"), F.col("earlier").alias("other"), "score")
    near = written(near.unionByName(near.select(F.col("other").alias("article_id"), F.col("article_id").alias("other"), "score")).join(parts, "article_id"), "near")
    records = written(told.join(parts, "article_id"), "members")
    sizes = near.groupBy("part").agg(F.count("*").alias("n")).unionByName(records.groupBy("part").agg(F.count("*").alias("n"))).groupBy("part").agg(F.max("n").alias("n"))
    large = few(written(sizes.where(F.col("n") > 2 * part).select("part"), "large"))
    small_ = [t.join(large, "part", "left_anti") for t in (near, records)]
    done = grouped_at_once(*small_)
    big = records.join(large, "part", "left_semi")
    if not big.isEmpty():
        done = done.unionByName(grouped_by_rounds(near.join(large, "part", "left_semi"), big, step))
    alone = seeds.join(parts, "article_id", "left_anti").select("article_id", F.col("article_id").alias("first"))
    done = written(done.unionByName(alone), "groups")
    known = done.join(seeds.select("article_id", "cluster_id"), "article_id").groupBy("first").agg(F.min("cluster_id").alias("cluster_id"))
    sizes = done.groupBy("first").agg(F.count("*").alias("size")).join(known, "first", "left").where("size > 1 OR cluster_id IS NOT NULL")
    return done.join(sizes.select("first", "cluster_id"), "first").select("article_id", "first", "cluster_id")


def named(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(article_id, cluster_id, is_known): groups of assigned() with names; a new one is named by what all its members share.

    That is their models, or their anchors if they share no model, without entities, the first six in order; or the least title. What
    members share is counted: a value that as many of them have as there are, so that no group's values meet in one row.
    """
    new = groups.where("cluster_id IS NULL").select("article_id", "first")
    held = new.join(found.select("article_id", "models", "anchors", "title_key"), "article_id")
    sizes = held.groupBy("first").agg(F.count("*").alias("size"), F.min("title_key").alias("title"))
    values = held.select("first", F.explode("models").alias("value"), F.lit(0).alias("kind")).unionByName(held.select("first", F.explode("anchors").alias("value"), F.lit(1).alias("kind")))
    shared = values.groupBy("first", "kind", "value").agg(F.count("*").alias("n")).join(sizes, "first").where("n = size")
    best = shared.groupBy("first").agg(F.min("kind").alias("kind"))
    shared = shared.join(best, ["first", "kind"]).where(~F.col("value").startswith("entity:"))
    shared = shared.withColumn("place", F.row_number().over(Window.partitionBy("first").orderBy("value"))).where("place <= 6")
    signed = shared.groupBy("first").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("signature"))
    made = sizes.join(signed, "first", "left").select("first", F.concat(F.lit("evt_"), F.substring(F.sha2(F.concat(F.lit("cluster-v2:"), F.coalesce("signature", "title")), 256), 1, 24)).alias("made"))
    return groups.join(made, "first", "left").select("article_id", F.coalesce("cluster_id", "made").alias("cluster_id"), F.col("cluster_id").isNotNull().alias("is_known"))


def planned(articles: DataFrame, per_key: int | None = PER_KEY, per_record: int | None = PER_RECORD, part: int = PART) -> DataFrame:
    """(article_id, cluster_id, is_known) of articles (article_id, title, url, cluster_id, is_new) that are in a cluster; the others have no row."""
    found = written(features(articles), "features")
    return named(found, assigned(found, pair_scores(found, candidates(found, per_key, per_record)), part))
