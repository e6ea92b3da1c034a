"""Evidence, direction scores and classification over a lexicon table; the content filter; origin tracing."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.functions import texts, times, urls
from tidemill.plans.vocabulary import CAPPED, FULL, HALF, NAMES, complete, normalized_direction
from tidemill.sources.storage import few, written


def evidence_scores(documents: DataFrame, lexicon: DataFrame, negations: list[str]) -> DataFrame:
    """(doc_id, direction, dimension, score, no): 5 for a strong term in a sentence that denies nothing, then with the first such sentence's
    number, 2.5 for two different weak ones, no row for less. Rows hold no text: what asks for scores alone moves none.

    lexicon: direction, dimension, kind (strong, weak), term (one ASCII token in lower case); a table of a few thousand
    rows whose size is the editors', not the data's. Sentences are cut and their tokens found once, in a column of its own each, and meet all terms in one
    equality join, so that work grows with the text and not with text times terms. The lexicon, written and counted, comes to the tokens if it
    has few rows, and what is found is written once. A dimension goes by a number until then, so that what a task gathers for a document holds numbers only.
    """
    lexicon = written(lexicon, "lexicon")
    slots = lexicon.select("direction", "dimension").distinct().withColumn("slot", F.row_number().over(Window.orderBy("direction", "dimension")))
    slots = few(written(slots, "slots"))
    named = [F.col(f"lexicon.{c}").eqNullSafe(F.col(f"slots.{c}")) for c in ("direction", "dimension")]
    lexicon = few(lexicon.alias("lexicon").join(slots.alias("slots"), named).select("slot", "kind", "term"))
    denied = F.array(*map(F.lit, negations))
    cut = documents.select("doc_id", F.explode(F.array(texts.sentences(F.col("text")))).alias("sentences"))
    tokens = F.transform("sentences", lambda s, no: F.struct(no.alias("no"), texts.latin_tokens(s).alias("tokens")))
    cut = cut.select("doc_id", F.explode(F.array(tokens)).alias("cut")).select("doc_id", F.explode(F.filter("cut", lambda x: ~F.arrays_overlap(x["tokens"], denied))).alias("s"))
    hits = cut.select("doc_id", F.col("s.no").alias("no"), F.explode("s.tokens").alias("term")).join(lexicon, "term")  # ids only: a token's row holds no text
    strong = F.col("kind") == "strong"
    weak = F.when(~strong, F.xxhash64("term"))  # two different ones are a least and a greatest that differ: numbers, that tasks combine
    found = hits.groupBy("doc_id", "slot").agg(F.min(weak).alias("low"), F.max(weak).alias("high"), F.min(F.when(strong, F.col("no"))).alias("no"))
    score = F.when(F.col("no").isNotNull(), FULL).when(F.col("low") < F.col("high"), HALF)
    found = found.withColumn("score", score).where(F.col("score").isNotNull()).join(slots, "slot").select("doc_id", "direction", "dimension", "score", "no")
    return written(found, "found")


def evidence(documents: DataFrame, lexicon: DataFrame, negations: list[str]) -> DataFrame:
    """(doc_id, direction, dimension, score, quote): evidence_scores() with the sentences of their numbers. A quote is cut again only of texts that have one."""
    found = evidence_scores(documents, lexicon, negations)
    told = found.where("no IS NOT NULL").groupBy("doc_id").agg(F.collect_set("no").alias("nos"))
    quoted = documents.select("doc_id", "text").join(told, "doc_id").select("doc_id", "nos", F.explode(F.array(texts.sentences(F.col("text")))).alias("sentences"))
    quoted = quoted.select("doc_id", F.explode(F.transform("nos", lambda n: F.struct(n.alias("no"), F.get("sentences", n).alias("quote")))).alias("q")).select("doc_id", "q.no", "q.quote")
    return found.join(quoted, ["doc_id", "no"], "left").select("doc_id", "direction", "dimension", "score", "quote")


#: What denies, plans or doubts; a sentence with any of it is no evidence.
UNCERTAIN = (
    r"(?i)(?<![A-Za-z0-9_])(?:not|no|without|never|failed|unavailable|rumored|rumour|pending|intent(?:s|ion)?|intend(?:s|ed)?|plans?\s+to|will|shall|may|might|could|preview|demo|not\s+deployed|to\s+be\s+deployed)(?![A-Za-z0-9_])"
    r"|未|没有|尚未|待|等待|计划|拟|预计|(?<!已)将|意图|打算|传闻|据称|可能|预览|演示|尚未部署"
)


#: Rules that an evidence search takes at most: their literals go to every task as one automaton, some hundred bytes each.
RULES_MOST = 400_000


def marked(literals: dict[str, list[int]], rules: list[tuple[int, bool, str]], always: list[int]) -> Callable[[Column, Column], Column]:
    """A column function from sentences in lower case, and for each whether a rule of always may hold, to what each dimension may have: the number of different weak
    phrases, and strong patterns to try with their sentence's number. One automaton over all literals reads each sentence once. rules: dimension, strong, pattern."""

    def found(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for literal, numbers in literals.items():
            automaton.add_word(literal, numbers)
        automaton.make_automaton()

        def told(sentences, maybe) -> list[dict]:
            weak, strong = {}, {}
            for no, sentence in enumerate(sentences):
                hit = {n for _, numbers in automaton.iter(sentence) for n in numbers} if literals else set()
                for n in hit.union(always) if maybe is not None and maybe[no] else hit:
                    dim, full, pattern = rules[n]
                    if full:
                        strong.setdefault(dim, []).append({"no": no, "pattern": pattern})
                    else:
                        weak.setdefault(dim, set()).add(pattern.lower())
            return [{"dim": d, "weak": len(weak.get(d, ())), "strong": strong.get(d, [])} for d in sorted({*weak, *strong}) if d in strong or len(weak[d]) > 1]

        for sentences, maybe in batches:
            yield pd.Series([told(*x) for x in zip(sentences, maybe, strict=True)], dtype=object)

    return lambda sentences, maybe: F.pandas_udf(found, "array<struct<dim: int, weak: int, strong: array<struct<no: int, pattern: string>>>>")(sentences, maybe)


def phrase_evidence(documents: DataFrame, rules: DataFrame, uncertain: str = UNCERTAIN) -> DataFrame:
    """(doc_id, direction, dimension, score, quote) by a table of rules: direction, dimension, kind (strong, weak), pattern, literals array<string>.

    5 where a strong pattern holds in a sentence that denies and doubts nothing (then with the first such sentence), 2.5
    where such sentences hold two different weak phrases, case aside; no row for less. A strong rule's literals are what
    its pattern can't hold without, one of them at least; its pattern is only tried where one stands. Without literals
    it is tried in every sentence. A weak rule's pattern is its phrase. An automaton over all literals reads each sentence once, so that work grows
    with the text and what is found in it and not with the number of rules. Sentences are cut once; a document is decided where it stands, nothing moves. Rows that repeat a doc_id
    are documents of their own; null texts and empty phrases find nothing.
    """
    spark, listed = documents.sparkSession, rules.select("direction", "dimension", "kind", "pattern", "literals").distinct().limit(RULES_MOST + 1).collect()
    if len(listed) > RULES_MOST:
        raise ValueError(f"more than {RULES_MOST} rules")
    literals: dict[str, list[int]] = {}
    always = []
    for n, rule in enumerate(listed):
        told = [rule.pattern] if rule.kind == "weak" else [x for x in rule.literals or [] if x]
        if rule.kind != "weak" and not told:
            always.append(n)
        for literal in {x.lower() for x in told if x}:
            literals.setdefault(literal, []).append(n)
    dims = sorted({(r.direction, r.dimension) for r in listed}, key=repr)
    at = {d: n for n, d in enumerate(dims)}
    told = [(at[r.direction, r.dimension], r.kind == "strong", r.pattern) for r in listed]
    names = F.array(*(F.struct(F.lit(a).cast("string").alias("direction"), F.lit(b).cast("string").alias("dimension")) for a, b in dims)) if dims else F.array().cast("array<struct<direction:string,dimension:string>>")
    sure = documents.select("doc_id", F.explode(F.array(F.filter(texts.sentences(F.col("text")), lambda s: ~s.rlike(uncertain)))).alias("sure")).where(F.size("sure") > 0)
    some = "|".join(f"(?:{listed[n].pattern})" for n in always)
    maybe = F.transform("sure", lambda s: s.rlike(some)) if always else F.lit(None).cast("array<boolean>")
    each = sure.select("doc_id", "sure", F.explode(F.array(marked(literals, told, always)(F.transform("sure", F.lower), maybe))).alias("found"))
    first = lambda x: F.array_min(F.transform(F.filter(x["strong"], lambda s: F.rlike(F.get("sure", s["no"]), s["pattern"])), lambda s: s["no"]))
    scored = each.select("doc_id", "sure", F.explode(F.array(F.transform("found", lambda x: F.struct(x["dim"].alias("dim"), x["weak"].alias("weak"), first(x).alias("no"))))).alias("found"))
    score = lambda x: F.when(x["no"].isNotNull(), FULL).when(x["weak"] >= 2, HALF)
    rows = F.transform(F.filter("found", lambda x: score(x).isNotNull()), lambda x: F.struct(F.get(names, x["dim"]).alias("d"), score(x).alias("score"), F.get("sure", x["no"]).alias("quote")))
    return scored.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.d.direction", "x.d.dimension", "x.score", "x.quote")


def pattern_evidence(documents: DataFrame, rules: list[tuple[str, str, list, list[str]]], uncertain: str = UNCERTAIN) -> DataFrame:
    """phrase_evidence() by rules (direction, dimension, strong, weak phrases) in a list; a strong pattern may stand with its literals: (pattern, literals)."""
    rows = []
    for direction, dimension, strong, weak in rules:
        rows += [(direction, dimension, "strong", *((x, []) if isinstance(x, str) else x)) for x in strong] + [(direction, dimension, "weak", w, []) for w in weak]
    table = documents.sparkSession.createDataFrame(rows, "direction string, dimension string, kind string, pattern string, literals array<string>")
    return phrase_evidence(documents, table, uncertain)


def scoring_input(title: Column, content: Column) -> Column:
    """What a model is given of an article: two labelled lines, spacing within kept."""
    return F.concat(F.lit("标题："), texts.trimmed(F.coalesce(title, F.lit(""))), F.lit("\n正文："), texts.trimmed(F.coalesce(content, F.lit(""))))


def direction_scores(found: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(doc_id, direction, total_score, eligible, dimension_scores): weighted and capped, for directions with evidence."""
    weights = dimensions.groupBy("direction").agg(F.sum(F.col("weight") * FULL).alias("all"))
    summed = found.join(dimensions, ["direction", "dimension"]).groupBy("doc_id", "direction").agg(F.sum(F.col("score") * F.col("weight")).alias("sum"), F.map_from_entries(F.collect_list(F.struct("dimension", "score"))).alias("dimension_scores"))
    summed = summed.join(weights, "direction")
    eligible = complete(F.col("direction"), F.col("dimension_scores"))
    raw = times.rounded(F.col("sum") / F.col("all") * 40).cast("int")
    most = F.create_map(*(F.lit(x) for pair in CAPPED.items() for x in pair))[F.col("direction")]
    total = F.when(eligible & (F.size("dimension_scores") >= 2), raw).otherwise(F.least(raw, most))
    return summed.select("doc_id", "direction", total.alias("total_score"), eligible.alias("eligible"), "dimension_scores")


def classified(scores: DataFrame, order: DataFrame, margin: int = 3) -> DataFrame:
    """(doc_id, status, direction, best, margin): the best eligible direction, ambiguous if another is within margin."""
    able = scores.where(F.col("eligible") & (F.col("total_score") > 0)).join(order, "direction")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("total_score"), "direction_no"))
    two = able.withColumn("rank", rank).where("rank <= 2").groupBy("doc_id").agg(F.max(F.when(F.col("rank") == 1, F.col("direction"))).alias("first"), F.max(F.when(F.col("rank") == 1, F.col("total_score"))).alias("best"), F.max(F.when(F.col("rank") == 2, F.col("total_score"))).alias("next"))
    gap = F.col("best") - F.coalesce("next", F.lit(0))
    unsure = F.col("next").isNotNull() & (gap <= margin)
    every = scores.select("doc_id").distinct().join(two, "doc_id", "left")
    status = F.when(F.col("best").isNull(), "no_match").when(unsure, "ambiguous").otherwise("classified")
    return every.select("doc_id", status.alias("status"), F.when(~unsure, F.col("first")).alias("direction"), "best", F.when(F.col("best").isNotNull(), gap).alias("margin"))


#: What a source's tier is worth, organisations and terms that tell, and numbers that do.
TIER_POINTS = {"authoritative": 20, "top": 20, "validation": 15, "high": 15, "signal": 10, "medium": 10, "low": 3}
IMPACT = ["impact", "significant", "breakthrough", "revolutionary", "game-changer", "first", "record", "重大", "突破", "首次", "里程碑", "milestone", "industry-first"]
NUMBER = r"[0-9][0-9,.]*%|\$[0-9,.]+[BMKbmk]?|[0-9]{2,}"


def quality(text: Column, tier: Column, organisations: list[str]) -> Column:
    """struct(credibility to 10, verifiability to 6, completeness to 4, impact to 4, total) of a title and text."""
    points = F.coalesce(F.create_map(*(F.lit(x) for pair in TIER_POINTS.items() for x in pair))[tier], F.lit(8))
    low, yes = F.lower(text), lambda found, n: F.when(found, n).otherwise(0)
    holds = lambda terms: [low.contains(t) for t in terms]
    named = reduce(or_, holds(organisations), F.lit(False))
    credibility = F.least(F.lit(10), F.floor(points / 2 + 0.5).cast("int"))
    verifiability = F.least(F.lit(6), yes(text.rlike(NUMBER), 4) + yes(named, 3) + yes(text.rlike(r"https?://[^\s)]+"), 3))
    completeness = F.least(F.lit(4), F.floor(F.length(text) / 1200).cast("int"))
    impact = F.least(F.lit(4), sum((yes(x, 2) for x in holds(IMPACT)), F.lit(0)))
    parts = {"credibility": credibility, "verifiability": verifiability, "completeness": completeness, "impact": impact, "total": credibility + verifiability + completeness + impact}
    return F.struct(*(c.alias(n) for n, c in parts.items()))


def primary(scores: DataFrame, order: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, primary_direction, primary_score): the best eligible direction, the first in order of equals, if it has at least least."""
    able = scores.where("eligible").join(order, "direction")
    best = able.groupBy("doc_id").agg(F.max(F.struct("total_score", (-F.col("direction_no")).alias("n"), "direction")).alias("x"))
    return best.where(F.col("x.total_score") >= least).select("doc_id", F.col("x.direction").alias("primary_direction"), F.col("x.total_score").alias("primary_score"))


def rule_scores(articles: DataFrame, scores: DataFrame, order: DataFrame, organisations: list[str]) -> DataFrame:
    """articles (doc_id, title, text, tier) with primary_direction, primary_score, quality and publish_score: twice the primary score and quality, 100 at most."""
    text = F.concat_ws("\n", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    rated = articles.withColumn("quality", quality(text, F.col("tier"), organisations)).join(primary(scores, order), "doc_id", "left")
    score = F.coalesce("primary_score", F.lit(0))
    return rated.withColumn("primary_score", score).withColumn("publish_score", F.least(F.lit(100), score * 2 + F.col("quality.total")))


def filter_rules(title: Column, content: Column, published_at: Column, as_of: Column, signals: str, spam: str, stale_days: int, least: int) -> list[tuple]:
    """The content filter's rules in order: test (None: always), decision, reason_code, quote."""
    both = F.concat(title, F.lit("\n"), content)
    bare = F.trim(F.regexp_replace(content, r"(?i)<[^>]*>|&nbsp;", ""))
    sentence = lambda pattern: F.substring(F.get(F.filter(texts.sentences(both), lambda s: s.rlike(pattern)), 0), 1, 280)
    return [
        (F.coalesce(title, F.lit("")) == "", "reject", "missing_title", F.substring(F.trim(content), 1, 280)),
        (F.coalesce(bare, F.lit("")) == "", "reject", "empty_body", F.substring(F.trim(title), 1, 280)),
        (both.rlike(spam), "reject", "spam", sentence(spam)),
        (~both.rlike(signals), "reject", "non_topic", F.substring(F.get(texts.sentences(content), 0), 1, 280)),
        (times.age_days(published_at, as_of) > stale_days, "review", "stale_content", sentence(signals)),
        (F.length(content) < least, "review", "too_short", F.substring(F.trim(content), 1, 280)),
        (None, "candidate", "eligible_content", sentence(signals)),
    ]


def first_of_rules(rules: list[tuple], told: Callable[..., Column]) -> Column:
    """told(decision, reason_code, quote) of the first rule that holds."""
    *before, (_, *last) = rules
    return F.coalesce(*(F.when(test, told(*said)) for test, *said in before), told(*last))


def filter_decision(title: Column, content: Column, published_at: Column, as_of: Column, signals: str, spam: str, stale_days: int = 365, least: int = 40) -> Column:
    """struct(decision, reason_code, quote): the first rule that holds. signals and spam are patterns of a lexicon."""
    rules = filter_rules(title, content, published_at, as_of, signals, spam, stale_days, least)
    return first_of_rules(rules, lambda decision, code, quote: F.struct(F.lit(decision).alias("decision"), F.lit(code).alias("reason_code"), quote.alias("quote")))


def filter_outcome(title: Column, content: Column, published_at: Column, as_of: Column, signals: str, spam: str, stale_days: int = 365, least: int = 40) -> Column:
    """filter_decision() without its quote, for which no sentence is cut."""
    rules = filter_rules(title, content, published_at, as_of, signals, spam, stale_days, least)
    return first_of_rules(rules, lambda decision, code, _: F.struct(F.lit(decision).alias("decision"), F.lit(code).alias("reason_code")))


def link_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, url, kind, weight, at): canonical, og:url, JSON-LD and body links; a page's first kind of a URL counts."""
    kinds = [
        ("canonical", 100, r'(?i)<link[^>]+rel="canonical"[^>]+href="([^"]+)"'), ("og_url", 90, r'(?i)<meta[^>]+property="og:url"[^>]+content="([^"]+)"'),
        ("json_ld", 80, r'(?is)<script[^>]+ld\+json[^>]*>[^<]*?"url"\s*:\s*"([^"]+)"'), ("body_link", 10, r'(?i)<a[^>]+href="(https?://[^"]+)"'),
    ]
    def of(kind: str, weight: int, pattern: str) -> Column:
        named = lambda u: F.struct(urls.traced_url(u).alias("url"), F.lit(kind).alias("kind"), F.lit(weight).alias("weight"))
        return F.transform(F.regexp_extract_all("html", F.lit(pattern), F.lit(1)), named)

    found = [of(*k) for k in kinds]
    each = pages.select("page_id", F.col("url").alias("own"), F.posexplode(F.concat(*found)).alias("at", "link"))
    first = each.select("page_id", "own", "at", "link.*").groupBy("page_id", "own", "url").agg(F.min(F.struct("at", "kind", "weight")).alias("x"))
    return first.select("page_id", "own", "url", "x.kind", "x.weight", "x.at")


def origins(pages: DataFrame, static: str = r"(?i)\.(?:css|js|png|jpe?g|gif|svg|ico|woff2?|pdf|zip|xml|rss|atom|json)$") -> DataFrame:
    """(page_id, origin, kind, needs_review): the heaviest safe link to another site; a body link needs a review."""
    links = link_candidates(pages)
    other = (urls.host(F.col("url")) != urls.host(F.col("own"))) & ~F.coalesce(urls.part(F.col("url"), "PATH"), F.lit("")).rlike(static) & urls.unsafe_reason(F.col("url")).isNull()
    best = links.where(other).groupBy("page_id").agg(F.min_by(F.struct("url", "kind"), F.struct((-F.col("weight")).alias("w"), "at")).alias("x"))
    return best.select("page_id", F.col("x.url").alias("origin"), F.col("x.kind").alias("kind"), (F.col("x.kind") == "body_link").alias("needs_review"))


#: Endings of files that are no articles, what domains are worth by kind, and parts of a URL that tell of an original.
FILES = "jpg jpeg png gif svg webp ico bmp css js mjs cjs ts map woff woff2 ttf eot otf mp3 mp4 webm ogg wav avi pdf zip tar gz rar 7z xml rss atom json exe dmg apk deb rpm".split()
DOMAINS = {
    "authoritative": "github.com arxiv.org huggingface.co openai.com anthropic.com deepmind.com blog.google blogs.microsoft.com ai.meta.com research.google aws.amazon.com azure.microsoft.com nvidia.com distill.pub openreview.net paperswithcode.com".split(),
    "research_media": "mit.edu stanford.edu nature.com science.org arstechnica.com wired.com ieee.org acm.org".split(),
    "second_hand": "mp.weixin.qq.com news.google.com feedburner.com rsshub.app hnrss.org 36kr.com leiphone.com marktechpost.com venturebeat.com the-decoder.com techcrunch.com theverge.com latent.space lastweekin.ai producthunt.com".split(),
}
BOOSTS = ["/releases/", "/pull/", "/issues/", "arxiv.org/abs/", "/blog/", "/news/", "/changelog/"]
WORTH = {"authoritative": 20, "research_media": 10, "other": 5, "second_hand": -30, "boost": 6}


def untyped_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, own, at, url): every URL that a page (page_id, url, html) names, once, in order: canonical links, og:url, then all in its text.

    Attributes may stand in either order. What isn't fetched safely, leads to a file, to the page itself or to its own site goes;
    redirects are looked through for that.
    """
    quoted = r"[\"']([^\"']+)[\"']"
    patterns = [
        rf"(?i)<link[^>]*rel=[\"']canonical[\"'][^>]*href={quoted}", rf"(?i)<link[^>]*href={quoted}[^>]*rel=[\"']canonical[\"']",
        rf"(?i)<meta[^>]*(?:property|name)=[\"']og:url[\"'][^>]*content={quoted}", rf"(?i)<meta[^>]*content={quoted}[^>]*(?:property|name)=[\"']og:url[\"']", r"(?i)(https?://[^\s<>\"'`]+)",
    ]
    found = F.array_distinct(F.concat(*(F.regexp_extract_all("html", F.lit(p), F.lit(1)) for p in patterns)))
    each = pages.select("page_id", F.col("url").alias("own"), F.posexplode(found).alias("at", "url"))
    each = each.select("*", F.explode(F.array(urls.resolved(F.col("own"), urls.unwrapped(F.col("url"))))).alias("whole"))
    each = each.select("*", F.explode(F.array(urls.traced_url(F.col("whole")))).alias("clean"))
    each = each.select("*", urls.host(F.col("clean")).alias("host"), urls.host(F.col("own")).alias("own_host"), urls.traced_url(urls.unwrapped(F.col("own"))).alias("own_clean"))
    below = lambda a, b: F.endswith(F.col(a), F.concat(F.lit("."), F.col(b)))
    own_site = F.coalesce((F.col("host") == F.col("own_host")) | below("host", "own_host") | below("own_host", "host"), F.lit(False))
    file = F.lower(F.substring_index("clean", "?", 1)).rlike(rf"\.(?:{'|'.join(FILES)})\z")
    fine = urls.unsafe_reason(F.col("whole")).isNull() & ~file & ~own_site & (F.coalesce("host", F.lit("")) != "") & F.coalesce(F.col("clean") != F.col("own_clean"), F.lit(True))
    return each.where(fine).select("page_id", "own", "at", "url")


def domain_table(spark) -> DataFrame:
    """(domain, kind) of DOMAINS; other tables of the same columns do as well."""
    return spark.createDataFrame([(d, kind) for kind, ds in DOMAINS.items() for d in ds], "domain string, kind string")


def likeliest_origins(candidates: DataFrame, domains: DataFrame) -> DataFrame:
    """(page_id, origin, points): of untyped_candidates() each page's best, the first of equals, if it is worth more than nothing.

    domains: domain, kind (authoritative, research_media, second_hand); a host counts as any of its parent domains, which meet the table in an equality join.
    """
    host = urls.host(F.col("url"))
    up = candidates.select("page_id", "at", F.explode(F.array_distinct(F.concat(urls.suffixes(host), F.array(host)))).alias("domain")).join(few(domains), "domain")
    kinds = up.groupBy("page_id", "at").agg(F.collect_set("kind").alias("kinds"))
    rated = candidates.join(kinds, ["page_id", "at"], "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    of = lambda kind: F.array_contains("kinds", kind)
    points = F.when(of("authoritative"), WORTH["authoritative"]).when(of("research_media"), WORTH["research_media"]).otherwise(WORTH["other"]) + F.when(of("second_hand"), WORTH["second_hand"]).otherwise(0)
    points = points + F.when(reduce(or_, (F.col("url").contains(b) for b in BOOSTS)), WORTH["boost"]).otherwise(0)
    best = rated.withColumn("points", points).groupBy("page_id").agg(F.min(F.struct((-F.col("points")).alias("p"), "at", "url")).alias("x"))
    return best.where("x.p < 0").select("page_id", F.col("x.url").alias("origin"), (-F.col("x.p")).cast("int").alias("points"))


def merged_scores(rows: DataFrame) -> DataFrame:
    """(article_id, direction, total_score, dimension_scores): the greatest total and the greatest of each dimension; older names of a direction are merged into it."""
    rows = rows.withColumn("direction", F.coalesce(normalized_direction(F.col("direction")), F.col("direction")))
    totals = rows.groupBy("article_id", "direction").agg(F.max("total_score").alias("total_score"))
    each = rows.select("article_id", "direction", F.explode("dimension_scores").alias("dimension", "score")).groupBy("article_id", "direction", "dimension").agg(F.max("score").alias("score"))
    maps = each.groupBy("article_id", "direction").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("dimension", "score")))).alias("dimension_scores"))
    return totals.join(maps, ["article_id", "direction"], "left")


def nine_rows(merged: DataFrame) -> DataFrame:
    """merged_scores() with a row for each direction of every article that has any: zero where there is none."""
    every = merged.select("article_id").distinct().select("article_id", F.explode(F.array(*map(F.lit, NAMES))).alias("direction"))
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
    return every.join(merged, ["article_id", "direction"], "left").select("article_id", "direction", F.coalesce("total_score", F.lit(0)).alias("total_score"), F.coalesce("dimension_scores", none).alias("dimension_scores"))
