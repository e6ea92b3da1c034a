"""The engine's queries over the given tables: (spark, sf_dir) -> DataFrame, with columns named as in plans.oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import texts, times, urls
from tidemill.operators import articles as A
from tidemill.operators import clusters, given, probes, roles, scoring, sources, store
from tidemill.plans import batch
from tidemill.plans import tables as T
from tidemill.plans import vocabulary as V
from tidemill.sources import folders, parse, ports, snapshots, storage

NOW_SECONDS = T.DAY0 + 20 * 86400
NEGATIONS = ["not", "no", "nicht", "pas", "never"]
SIGNALS, SPAM = r"(?<![A-Za-z0-9_])(?:tion|thing|inter|moron|idiot)", r"(?<![A-Za-z0-9_])(?:password|token)(?![A-Za-z0-9_])"
QUERIES = {}


def now():
    """The queries' point in time: a parameter, never the clock."""
    return F.timestamp_seconds(F.lit(NOW_SECONDS))


def query(f):
    QUERIES[f.__name__] = f
    return f


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


@query
def page_winners(spark: SparkSession, sf: str) -> DataFrame:
    """The flagship: pages cleaned, canonical, deduplicated; per host how many stay and the longest title."""
    won = A.batch_winners(A.normalized(T.items(spark, sf)).where("drop_reason IS NULL"))
    return won.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count("*").alias("n"), F.max(F.length("title")).alias("longest"))


@query
def canonical_url(spark, sf):
    p, i = T.table(spark, sf, "pages"), F.col("url")
    return p.select("page_id", urls.canonical_url(i).alias("dedup_url"), urls.cleaned_url(i).alias("cleaned"), urls.host(i).alias("host"))


@query
def url_safety(spark, sf):
    p = T.table(spark, sf, "pages")
    hosts = ["localhost", "10.1.2.3", "172.20.0.1", "metadata.google.internal", "user@example.com", "example.com:6379", "8.8.8.8"]
    url = F.when(F.col("page_id") % 8 < 7, F.concat(F.lit("http://"), T.chosen(hosts, F.col("page_id") % 8), F.lit("/p"))).otherwise(F.col("url"))
    return p.select("page_id", urls.unsafe_reason(url).alias("reason"))


@query
def address_forms(spark, sf):
    """Addresses made of pages' hashes in every form that a URL may write them in, and whether they may be fetched."""
    hex_ = F.md5("url")
    number = F.conv(F.substring(hex_, 1, 8), 16, 10).cast("long")
    octet = lambda k: F.conv(F.substring(hex_, 2 * k - 1, 2), 16, 10)
    group = lambda k: F.substring(hex_, 4 * k - 3, 4)
    six = F.concat_ws(":", *(group(k) for k in range(1, 9)))
    forms = [number.cast("string"), F.concat(F.lit("0x"), F.substring(hex_, 1, 8)), F.concat_ws(".", *(F.concat(F.lit("0"), F.conv(octet(k), 10, 8)) for k in range(1, 5))), F.concat_ws(".", octet(1), (number % (1 << 24)).cast("string")), F.concat(F.lit("["), six, F.lit("]")), F.concat(F.lit("[::ffff:"), group(1), F.lit(":"), group(2), F.lit("]")), F.concat(F.lit("[::ffff:"), F.concat_ws(".", *(octet(k) for k in range(1, 5))), F.lit("]")), F.concat(F.lit("[f"), F.substring(hex_, 1, 3), F.lit("::"), group(3), F.lit("]")), F.concat_ws(".", octet(1), octet(2), octet(3), F.conv(F.substring(hex_, 7, 3), 16, 10))]
    p = T.table(spark, sf, "pages").select("page_id", F.posexplode(F.array(*forms)).alias("form", "host"))
    return p.select("page_id", "form", urls.unsafe_reason(F.concat(F.lit("https://"), "host", F.lit("/a?b=c"))).alias("reason"))


def responses(spark, sf):
    """What servers say of pages' links: most lead on to another page, some in circles or to a private address, others end."""
    p, i = T.table(spark, sf, "pages"), F.col("page_id")
    link = lambda n: F.concat(F.lit("https://site.example/p/"), n)
    kind = i % 10
    status = F.when(kind <= 3, 302).when(kind == 4, 404).when(kind == 5, 503).when(kind == 6, F.when(F.col("method") == "HEAD", 405).otherwise(200)).when(kind == 7, 301).when(kind == 9, 200)
    target = F.when(kind <= 3, F.when(i % 3 == 0, F.concat(F.lit("../p/"), i + 1)).otherwise(link(F.expr("page_id + 1 + page_id % 4")))).when(kind == 7, F.when(i % 20 == 7, link(i)).otherwise(F.lit("http://127.1/x")))
    return p.select(link(i).alias("url"), F.explode(F.array(F.lit("HEAD"), F.lit("GET"))).alias("method"), i.alias("page_id")).select("url", "method", status.cast("int").alias("status"), target.alias("location"), F.lit(None).cast("string").alias("error"))


@query
def link_probe(spark, sf):
    """Where pages' links lead: chains, circles, unsafe targets, dead ends."""
    said = responses(spark, sf).where("status IS NOT NULL")
    return probes.probed(said.select("url").unionByName(T.table(spark, sf, "pages").select("url")), lambda asked: asked.join(said, ["url", "method"], "left"))


@query
def redirect_target(spark, sf):
    p = T.table(spark, sf, "pages")
    wrapped = F.concat(F.lit("https://go.example/r?x=1&target="), F.url_encode(F.concat(F.lit("https://hop.example/?url="), F.url_encode("url"))))
    return p.select("page_id", urls.unwrapped(wrapped).alias("target"))


@query
def content_hash(spark, sf):
    a = T.articles(spark, sf)
    return a.select("article_id", texts.content_hash(F.col("title"), F.col("source_name")).alias("content_hash"), texts.title_key(F.col("title")).alias("title_key"))


@query
def html_to_text(spark, sf):
    return T.table(spark, sf, "pages").select("page_id", texts.page_title(F.col("html")).alias("title"), F.md5(texts.html_to_text(F.col("html"))).alias("text_md5"), F.length(texts.html_to_text(F.col("html"))).alias("n_chars"))


@query
def page_items(spark, sf):
    return parse.page_items(T.table(spark, sf, "pages")).select("page_id", "title", F.md5(F.coalesce("content", F.lit(""))).alias("content_md5"), "content_kind", "blocked")


@query
def sentence_stats(spark, sf):
    s = T.table(spark, sf, "documents").select("doc_id", F.explode(texts.sentences(F.col("text"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.max(F.length("s")).alias("longest"), F.min("s").alias("least"))


@query
def rule_summary(spark, sf):
    return T.articles(spark, sf).select("article_id", texts.rule_summary(F.col("title"), F.col("text")).alias("summary"))


@query
def language_tag(spark, sf):
    d = T.table(spark, sf, "documents").withColumn("t", F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("模型训练"), F.col("text"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("㐂模型"), F.regexp_replace("text", "[A-Za-z]", ""))).otherwise(F.col("text")))
    return d.groupBy(texts.language_tag(F.col("t")).alias("tag"), "lang").agg(F.count("*").alias("n"))


@query
def shanghai_day(spark, sf):
    return T.table(spark, sf, "events").groupBy(times.shanghai_day(F.col("ts")).cast("string").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query
def age_days(spark, sf):
    return T.articles(spark, sf).select("article_id", times.age_days(F.col("published_at"), now()).alias("age_days"))


@query
def source_health(spark, sf):
    return A.health(T.attempts(spark, sf))


@query
def direction_normalize(spark, sf):
    raw = T.chosen([*V.ALIASES, *V.NAMES, "other"], F.col("user_id") % 15)
    return T.table(spark, sf, "events").groupBy(V.normalized_direction(raw).alias("direction")).agg(F.count("*").alias("n"))


@query
def drop_reasons(spark, sf):
    return A.normalized(T.items(spark, sf)).groupBy("drop_reason").agg(F.count("*").alias("n"))


@query
def dedup_batch(spark, sf):
    return A.batch_winners(A.normalized(T.items(spark, sf)).where("drop_reason IS NULL")).select("item_id", "dedup_url", "content_hash")


@query
def dedup_vs_history(spark, sf):
    every = A.normalized(T.items(spark, sf)).where("drop_reason IS NULL")
    return A.fresh(every.where("item_id % 6 <> 1"), every.where("item_id % 6 = 1")).select("item_id", "dedup_url")


@query
def snapshot_upsert(spark, sf):
    a = T.articles(spark, sf).select("article_id", "score", "status")
    new = a.where("article_id % 3 = 0").withColumn("score", F.col("score") + 1000)
    return A.upserted(a, new, ["article_id"])


@query
def duplicate_gate(spark, sf):
    every = A.normalized(T.items(spark, sf)).where("drop_reason IS NULL").select(F.col("item_id").alias("article_id"), "dedup_url", "title", F.timestamp_seconds(T.DAY0 + F.col("item_id") * 613 % 86400).alias("collected_at"))
    return A.duplicate_gates(every.where("article_id % 5 <> 1"), every.where("article_id % 5 = 1"))


@query
def eligible_sources(spark, sf):
    s = T.sources(spark, sf)
    return s.where(F.col("enabled") & (F.col("next_fetch_at").isNull() | (F.col("next_fetch_at") <= F.timestamp_seconds(F.lit(T.DAY0 + 9 * 86400))))).select("source_name", "tier", stamp(F.col("next_fetch_at")).alias("next_fetch_at"))


@query
def origin_policy(spark, sf):
    p = T.table(spark, sf, "pages")
    explicit = F.when(F.col("page_id") % 7 == 0, "editorial")
    n = F.length("html")
    source_url = T.chosen(["https://feeds.example.com/a", "https://rsshub.app/x", "https://mp.weixin.qq.com/s", "https://plain.info/", "https://sub.huxiu.com/f", None], n % 6)
    policy = A.origin_policy(explicit, F.when(n % 17 != 0, F.col("url")), F.when(F.col("page_id") % 5 == 0, "media_analysis"), ["example.com"], [*A.EDITORIAL, "example.org"], source_url, T.chosen(["Daily", "AI 聚合", None], n % 3))
    return p.select("page_id", policy.alias("policy"))


@query
def hot_articles_page(spark, sf):
    """The second page of published articles above the threshold, with their clusters' sizes and their sources' standing."""
    a = T.articles(spark, sf)
    page = a.where((F.col("status") == "published") & (F.col("score") >= 75) & F.col("direction").isNotNull()).orderBy(F.desc("score"), F.desc("published_at"), "article_id").offset(20).limit(20)
    sizes = a.join(F.broadcast(page.select("cluster_id").where("cluster_id IS NOT NULL").distinct()), "cluster_id", "left_semi").groupBy("cluster_id").agg(F.count("*").alias("cluster_size"))
    out = page.join(F.broadcast(sizes), "cluster_id", "left").join(T.sources(spark, sf).select("source_name", "tier"), "source_name", "left")
    return out.select("article_id", "title", "score", "direction", "tier", F.coalesce("cluster_size", F.lit(1)).cast("long").alias("cluster_size"))


@query
def workbench_overview(spark, sf):
    a = T.articles(spark, sf)
    return a.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("published", "draft", "pending_review", "blocked")), F.count_if("ai_processed").alias("ai_processed"))


@query
def workbench_articles(spark, sf):
    a = T.articles(spark, sf).where((F.col("status") == "draft") & (F.col("direction") == "coding"))
    return a.orderBy(F.desc("published_at"), "article_id").limit(50).select("article_id", "title", "score", stamp(F.col("published_at")).alias("published_at"))


def score_rows(spark, sf):
    """direction_score rows: two runs of scores for each article's own and next direction."""
    a = T.articles(spark, sf).where("direction IS NOT NULL")
    run = F.explode(F.array(F.lit(0), F.lit(1))).alias("run")
    rows = a.select("article_id", "direction", run, "score")
    levels = F.create_map(F.lit("first"), F.col("score") % 3 * 2.5, F.lit("second"), (F.col("score") + F.col("run")) % 3 * 2.5, F.concat(F.lit("own"), F.col("run").cast("string")), F.lit(5.0))
    return rows.select("article_id", "direction", (F.col("score") + F.col("run") * (F.col("article_id") % 7)).cast("int").alias("total_score"), levels.alias("dimension_scores"))


@query
def score_merge(spark, sf):
    merged = scoring.merged_scores(score_rows(spark, sf))
    return merged.select("article_id", "direction", "total_score", F.array_join(F.transform(F.map_entries("dimension_scores"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("decimal(3,1)").cast("string"))), ",").alias("dimensions"))


@query
def quality_ladder(spark, sf):
    a, h = T.articles(spark, sf), A.health(T.attempts(spark, sf))
    joined = a.where("status = 'published'").join(h, "source_name", "left")
    cols = {"published_at": F.col("published_at"), "revalidated": F.col("article_id") % 4 == 0, "fetches": F.col("fetches"), "consecutive_failures": F.col("consecutive_failures"), "probe_status": F.when(F.col("article_id") % 13 == 0, 404).when(F.col("article_id") % 17 == 0, 503).otherwise(200)}
    return joined.select("article_id", A.quality_reason(cols, now(), 2).alias("reason"))


@query
def quality_gate_list(spark, sf):
    gates = quality_ladder(spark, sf).where("reason IS NOT NULL")
    return gates.join(T.articles(spark, sf), "article_id").groupBy("reason", "direction").agg(F.count("*").alias("n"), F.min("title").alias("first_title"))


@query
def review_list(spark, sf):
    """Review items (labelled documents of low quality) with their articles; what is missing is empty."""
    labels = T.table(spark, sf, "labels").where("quality = 0").select((F.col("doc_id") + F.when(F.col("doc_id") % 19 == 0, 10**9).otherwise(0)).alias("article_id"))
    return labels.join(T.articles(spark, sf).select("article_id", "title", "status"), "article_id", "left").select("article_id", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("status", F.lit("")).alias("status"))


@query
def auto_approve(spark, sf):
    """Drafts and reviews above 60, collected over a day ago, without a pending review item."""
    pending = T.table(spark, sf, "labels").where("quality = 0 AND doc_id % 2 = 0").select(F.col("doc_id").alias("article_id"))
    old = F.col("collected_at") < now() - F.expr("INTERVAL 24 HOURS")
    return T.articles(spark, sf).where((F.col("status") == "pending_review") & (F.col("score") >= 60) & old).join(pending, "article_id", "left_anti").select("article_id", "score")


@query
def revalidation(spark, sf):
    return T.articles(spark, sf).where("status = 'published'").orderBy("collected_at", "article_id").limit(200).select("article_id", stamp(F.col("collected_at")).alias("collected_at"))


@query
def digest_day(spark, sf):
    """Published and directed articles of each Shanghai day, as numbered lines behind a head."""
    return batch.digests(T.articles(spark, sf).where("status = 'published'"))


@query
def ai_admission(spark, sf):
    a = T.articles(spark, sf).join(T.sources(spark, sf).select("source_name", "tier"), "source_name")
    used = a.where("ai_processed AND status = 'blocked'").groupBy("source_name").agg(F.count("*").alias("n"))
    return A.admitted(a.where("NOT ai_processed").select("article_id", "source_name", "tier"), used, 30, 500).select("article_id", "turn", "seat")


@query
def publish_gate(spark, sf):
    a = T.articles(spark, sf)
    scores = F.create_map(F.lit("entity"), F.col("article_id") % 3 * 2.5, F.lit("capability"), F.lit(5.0))
    quotes = F.create_map(F.lit("entity"), F.when(F.col("article_id") % 2 == 0, "q").otherwise(""), F.lit("capability"), F.lit("c"))
    cols = {"direction": F.col("direction"), "status": F.col("status"), "provenance": T.chosen(["traced", "first_party", "untraceable"], F.col("article_id") % 3), "override": F.col("article_id") % 10 == 2, "ai_processed": F.when(F.col("article_id") % 4 != 0, F.col("ai_processed")), "score": F.col("score"), "complete": F.lit(True), "dimension_scores": scores, "quotes": quotes}
    return a.select("article_id", F.coalesce(A.publishable(cols, F.lit(50)), F.lit(False)).alias("publish"))


@query
def front_page(spark, sf):
    a = T.articles(spark, sf).where("status = 'published' AND score >= 75")
    return A.front_page(a)


@query
def cluster_representatives(spark, sf):
    return A.representatives(T.articles(spark, sf).where("status = 'published'")).select("cluster_key", "article_id", "score")


@query
def content_filter(spark, sf):
    a = T.articles(spark, sf)
    title = F.when(F.col("article_id") % 29 != 0, F.col("title")).otherwise("")
    content = F.when(F.col("article_id") % 31 != 0, F.col("text")).otherwise("<p>&nbsp;</p>")
    d = scoring.filter_decision(title, content, F.col("published_at"), now(), SIGNALS, SPAM, stale_days=12)
    return a.select("article_id", d.alias("d")).select("article_id", "d.decision", "d.reason_code", F.md5(F.coalesce("d.quote", F.lit(""))).alias("quote_md5"))


def evidence_of(spark, sf, found=scoring.evidence):
    return found(T.table(spark, sf, "documents").select("doc_id", "text"), T.lexicon(spark, sf), NEGATIONS)


def scores_of(spark, sf):
    """evidence_of() without quotes, for which texts would be cut and moved once more."""
    return evidence_of(spark, sf, scoring.evidence_scores)


@query
def evidence_by_dimension(spark, sf):
    return evidence_of(spark, sf).groupBy("direction", "dimension", "score").agg(F.count("*").alias("n"), F.count("quote").alias("n_quotes"), F.sum(F.length("quote")).alias("quote_chars"))


@query
def direction_scores(spark, sf):
    return scoring.direction_scores(scores_of(spark, sf), V.dimensions(spark)).select("doc_id", "direction", "total_score", "eligible")


@query
def classify(spark, sf):
    order = V.dimensions(spark).select("direction", "direction_no").distinct()
    return scoring.classified(scoring.direction_scores(scores_of(spark, sf), V.dimensions(spark)), order)


def linked_pages(spark, sf):
    """Pages with links to other sites, as an origin may be named: canonical, og:url, in the body."""
    i = F.col("page_id")
    front = F.when(i % 3 == 0, F.concat(F.lit('<link rel="canonical" href="https://first'), i % 7, F.lit('.example.org/a?utm_source=x&b=1">'))).when(i % 3 == 1, '<meta property="og:url" content="http://10.0.0.1/x">').otherwise("")
    back = F.concat(F.lit('<a href="https://other'), i % 5, F.lit(".example.net/p/"), i, F.lit('?fbclid=1#s).">x</a><a href="https://cdn.example.net/x.css">y</a>'))
    return T.table(spark, sf, "pages").withColumn("html", F.concat(front, "html", back))


@query
def link_candidates(spark, sf):
    return scoring.link_candidates(linked_pages(spark, sf)).groupBy("page_id", "kind").agg(F.count("*").alias("n"), F.min("url").alias("first_url"))


@query
def origin_trace(spark, sf):
    return scoring.origins(linked_pages(spark, sf))


NAMED = ["https://github.com/o/r/releases/tag/", "https://sub.nature.com/a/", "https://techcrunch.com/news/", "https://plain.example.info/p/", "https://blog.google/x.pdf?q=", "http://10.0.0.1/blog/", "https://r.example.info/?url=https%3A%2F%2Farxiv.org%2Fabs%2F"]


@query
def origin_heuristic(spark, sf):
    """The likeliest origin of each page by the domains and paths of the URLs that it names; which ones it names goes by its length."""
    n = F.length("html")
    link = lambda k: F.concat(F.lit(" <a href='"), T.chosen(NAMED, (n + k) % 7), F.col("page_id"), F.lit("'>x</a>"))
    html = F.concat("html", F.when(n % 3 > 0, link(0)).otherwise(""), F.when(n % 3 > 1, link(3)).otherwise(""), F.lit("<link href='https://www."), urls.host(F.col("url")), F.lit("/own' rel='canonical'>"))
    pages = T.table(spark, sf, "pages").select("page_id", "url", html.alias("html"))
    return scoring.likeliest_origins(scoring.untyped_candidates(pages), scoring.domain_table(spark))


EVENTS = ["OpenAI GPT-5.2", "谷歌 Gemini 3 正式发布 大语言模型", "Anthropic claude-4 2025-03-01", "", "英伟达 2025年3月 12.5亿 订单", "Kimi K2 40%up 300m", "meta llama_3.1 カタカナ"]


def event_articles(spark, sf):
    """Articles whose titles name an event (by their length, so that copies name the same), a third of them known, some of these in clusters."""
    a, i = T.articles(spark, sf), F.col("article_id")
    title = F.concat_ws(" ", T.chosen(EVENTS, F.length("title") % 7), "title")
    url = F.concat(F.lit("https://"), "source_name", F.lit(".example/e/"), F.length("text") % 50, F.lit("/"))
    known = F.when(i % 6 == 0, F.concat(F.lit("k"), F.expr("article_id div 24").cast("string"))).when(i % 30 == 3, F.concat(F.lit("s"), i))
    return a.select("article_id", title.alias("title"), url.alias("url"), known.alias("cluster_id"), (i % 3 != 0).alias("is_new"))


@query
def cluster_features(spark, sf):
    found = clusters.features(event_articles(spark, sf))
    lists = [F.array_join(F.array_sort(c), ",").alias(c) for c in clusters.KINDS]
    return found.select("article_id", "cluster_id", *lists, F.size("terms").alias("n_terms"), F.size("anchors").alias("n_anchors"), F.md5(F.array_join("keys", "|")).alias("keys_md5"))


@query
def cluster_pair_scores(spark, sf):
    found = storage.written(clusters.features(event_articles(spark, sf)), "features")
    return clusters.pair_scores(found, clusters.candidates(found)).select("later", "earlier", F.round("score", 6).alias("score"))


@query
def cluster_assign(spark, sf):
    """Event clusters of all articles: known ones that new articles join, and new ones."""
    return clusters.planned(event_articles(spark, sf))


@query
def api_items(spark, sf):
    """Payloads made of events: the parser finds the list and its fields."""
    e = T.table(spark, sf, "events").withColumn("page", F.floor(F.col("event_id") / 10))
    one = F.to_json(F.struct(F.col("event_type").alias("title"), F.concat(F.lit("https://x.example/"), F.col("event_id")).alias("url"), F.col("props").alias("summary"), F.unix_timestamp("ts").cast("string").alias("published_at")))
    payload = e.groupBy("page").agg(F.array_join(F.array_sort(F.collect_list(one)), ",").alias("x"))
    found = parse.api_items(payload.select(F.col("page").alias("source_id"), F.concat(F.lit('{"meta":1,"items":['), F.col("x"), F.lit("]}")).alias("json")))
    return found.select("source_id", "title", "url", "content", stamp(F.col("published_at")).alias("published_at"))


@query
def api_nested(spark, sf):
    """Payloads made of pages, each with its list at another depth, behind a wrapper, other names, edges, or nowhere: items, skips and errors."""
    p, i = T.table(spark, sf, "pages"), F.col("page_id")
    title = F.to_json(F.struct(texts.page_title(F.col("html")).alias("headline"), F.concat(F.lit("/p/"), i).alias("link"), F.md5("html").alias("excerpt")))
    item = F.concat(F.lit("["), title, F.lit(',{"name":{"rendered":"<b>R &amp; S</b>"},"guid":"https://g.example/'), i, F.lit('","text":"t"},{"title":7,"url":"https://n.example"},3]'))
    shapes = ["@", '{"meta":{"n":1},"response":{"posts":@},"zeta":[1]}', '{"b":{"c":{"d":{"list":@}}},"a":[{"title":"late","url":"https://late.example"}]}', '{"data":{"q":{"edges":@}},"x":{"items":[]}}', '{"k":"{}","o":{"p":1},"v":null}', "not json", '{"items":[1,2]}']
    json = F.coalesce(*(F.when(i % 7 == n, F.replace(F.lit(shape), F.lit("@"), item)) for n, shape in enumerate(shapes)))
    found = parse.api_parsed(p.select(i.alias("source_id"), json.alias("json"), F.concat(F.lit("https://"), urls.host(F.col("url")), F.lit("/feed")).alias("base")))
    return found.select("source_id", "no", "title", "url", "content", "content_kind", "skipped", "error")


@query
def page_metadata(spark, sf):
    """What pages tell of themselves in titles, links, metas and JSON-LD, of which every page gets some."""
    i = F.col("page_id")
    ld = F.concat(F.lit('<script type="application/ld+json">[{"@graph":[{"name":1},{"dateCreated":"2024-01-0'), i % 9 + 1, F.lit('","headline":"H'), i, F.lit('"}]},{"datePublished":"late","description":"D'), i, F.lit('","dateModified":"2024-02-01"}]</script>'))
    metas = F.concat(F.lit("<meta content='https://og.example/"), i, F.lit("' property='og:url'><META name=\"description\" content=\"told "), i % 5, F.lit('"><link href="/c/'), i, F.lit('" rel="shortcut canonical">'))
    html = F.concat(F.when(i % 4 == 0, "").otherwise(metas), F.when(i % 3 == 0, F.regexp_replace("html", "(?i)</?title", "<x")).otherwise(F.col("html")), F.when(i % 5 == 0, "<script type='application/ld+json'>{bad</script>").otherwise(ld))
    return parse.page_metadata(T.table(spark, sf, "pages").select("page_id", html.alias("html")))


@query
def feed_items(spark, sf):
    """Feeds made of all documents: half RSS, half Atom, with the texts as bodies."""
    d = T.articles(spark, sf)
    bare = F.regexp_replace(F.regexp_replace("title", "[^A-Za-z ]", ""), " +", " ")
    link = F.concat(F.lit("https://f.example/"), F.col("article_id"))
    rss = F.concat(F.lit("<rss><channel><title>f</title><item><title>"), bare, F.lit("x</title><link>"), link, F.lit("</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate><description>"), F.substring(F.regexp_replace("text", r"[^\p{L}\p{N} .,]", " "), 1, 2000000000), F.lit("</description></item><item><title>y</title><guid>g</guid></item></channel></rss>"))
    atom = F.concat(F.lit("<feed><title>f</title><entry><title>"), bare, F.lit('x</title><link href="'), link, F.lit('"/><updated>2024-01-02T10:00:00Z</updated><summary>s</summary></entry></feed>'))
    feeds = d.select(F.col("article_id").alias("source_id"), F.when(F.col("article_id") % 2 == 0, rss).otherwise(atom).alias("xml"))
    return parse.feed_items(feeds).select("source_id", F.trim("title").alias("title"), "url", "content", "content_kind", stamp(F.col("published_at")).alias("published_at"))


@query
def hotlist_rank(spark, sf):
    e = T.table(spark, sf, "events").select(F.col("event_type").alias("kind"), F.col("event_id").alias("position"), F.when(F.col("event_id") % 9 == 0, "").otherwise(F.concat(F.lit("a b "), F.col("user_id"))).alias("title"), (F.col("event_id") % 7 == 0).alias("is_ad"))
    return parse.ranked_hotlist(e).where("rank <= 50")


@query
def hotlist_ladder(spark, sf):
    """Hot lists of events' types: fetched just now, saved before, or neither."""
    e = T.table(spark, sf, "events")
    every = parse.ranked_hotlist(e.select(F.col("event_type").alias("kind"), F.col("event_id").alias("position"), F.concat(F.lit("t "), "user_id").alias("title"), F.lit(False).alias("is_ad")))
    kinds = e.select(F.col("event_type").alias("kind")).unionByName(e.select(F.concat("event_type", F.lit("_new")).alias("kind")))
    live = every.where(F.length("kind") % 2 == 0)
    return snapshots.served(kinds, live, every.where("kind <> 'click'"))


@query
def source_categories(spark, sf):
    return T.sources(spark, sf).groupBy(F.coalesce("category", F.lit("none")).alias("category"), "tier").agg(F.count("*").alias("n"), F.count_if("enabled").alias("enabled"))


@query
def role_envelopes(spark, sf):
    """Three roles over articles: a filter, an event rule behind it, a summary that keeps what it has."""
    first = lambda: texts.first_sentence(F.col("text"))
    graph = [
        roles.Role("summary", lambda: F.struct(F.length(first()).alias("value"), first().alias("quote")), "preserve", after=("event",)),
        roles.Role("event", lambda: F.struct(roles.event_kind(F.col("title"), F.col("text")).alias("value"), F.lit(None).cast("string").alias("quote")), "review", needs_evidence=False, after=("filter",)),
        roles.Role("filter", lambda: F.struct(F.when(F.col("article_id") % 7 != 0, F.length("text")).alias("value"), F.when(F.col("article_id") % 5 != 0, first()).otherwise("absent from it").alias("quote"))),
    ]
    out = roles.run_roles(T.articles(spark, sf).select("article_id", "title", "text"), graph)
    return out.select("article_id", F.col("filter.outcome").alias("filter"), F.col("event.outcome").alias("event"), F.col("event.value").alias("kind"), F.col("summary.outcome").alias("summary"), F.col("filter.key").alias("key"))


CLAIMS = ["", "The lab launched a new api with 12% lower latency in its report.", "传闻称该模型即将发布。", "It will be the most powerful product!\nNo results yet", "用户可用，论文结果公开。", "An unconfirmed release without users?", "GPT users deployed 3 billion tokens."]


@query
def content_evaluation(spark, sf):
    """Evaluation of all articles behind the content filter; what they claim goes by their length, so that copies claim the same."""
    a = T.articles(spark, sf)
    content = F.concat(T.chosen(CLAIMS, F.length("text") % 7), F.lit(" "), "text")
    a = a.select("article_id", "title", content.alias("content"), F.concat(F.when(F.col("source_no") % 2 == 0, "https://").otherwise("http://"), "source_name", F.lit(".example/")).alias("url"), "source_name", T.chosen(["authoritative", "tier 3", "community"], F.col("source_no") % 3).alias("source_tier"), T.chosen(["research_papers", "lab"], F.col("source_no") % 5).alias("source_category"), F.when(F.col("quality").isNotNull(), F.col("published_at")).alias("published_at"))
    d = scoring.filter_outcome(F.col("title"), F.col("content"), F.coalesce("published_at", now()), now(), SIGNALS, SPAM, stale_days=12)
    a = a.select("*", F.explode(F.array(d)).alias("d")).select("*", F.when(F.col("article_id") % 41 != 0, F.col("d.decision")).alias("decision"), F.col("d.reason_code").alias("reason_code"), (F.regexp_count("content", F.lit("tion")) % 4).alias("n_signals"), (F.length("title") % 13 != 0).alias("filter_matches"))
    return roles.evaluated(a).select("article_id", *roles.PARTS, "overall", "decision", "publish_eligible", F.array_join("reasons", ",").alias("reasons"), F.md5(F.concat_ws("|", *(F.coalesce(F.col("quotes")[n], F.lit("")) for n in roles.PARTS))).alias("quotes_md5"))


@query
def evidence_validate(spark, sf):
    """Evidence items that quote their document's first line, with fields that stand there or not."""
    a = T.articles(spark, sf).where("title <> ''").withColumn("word", F.substring_index("title", " ", 1))
    i = F.col("article_id")
    items = a.select("article_id", F.when(i % 2 == 0, "model").otherwise("agent").alias("direction"), F.when(i % 2 == 0, "entity").otherwise("tool_call").alias("dimension"), F.when(i % 3 == 0, 2.5).otherwise(5.0).alias("score"), F.when(i % 5 == 0, "absent from it").otherwise(F.col("title")).alias("quote"), F.create_map(F.lit("model_name"), F.col("word"), F.lit("provider"), F.when(i % 4 == 0, F.col("word")).otherwise("zzz"), F.lit("tool"), F.col("word")).alias("fields"))
    rules = spark.createDataFrame([("model", "entity", ["model_name", "provider"], []), ("agent", "tool_call", ["tool"], ["operation"])], "direction string, dimension string, required array<string>, one_of array<string>")
    return roles.valid_evidence(items, a, rules).groupBy("direction", "score").agg(F.count("*").alias("n"), F.count("quote").alias("quoted"))


def given_responses(spark, sf):
    """Responses about articles that quote their first line, each wrong in another way by the text's length, with a second item that is none."""
    a = T.articles(spark, sf).where("trim(title) <> ''").withColumn("word", F.substring_index(F.trim("title"), " ", 1)).withColumn("k", F.length("text") % 8)
    k = F.col("k")
    item = F.struct(
        F.when(k == 4, "odd").otherwise("model").alias("direction"), F.when(k == 5, "nope").otherwise("entity").alias("dimension"), F.when(k == 3, 4.0).otherwise(5.0).alias("score"), F.when(k == 2, "absent from it").otherwise(F.col("title")).alias("quote"),
        F.when(F.col("article_id") % 11 != 0, F.col("word")).alias("subject"), F.col("word").alias("predicate"), F.col("word").alias("object"), F.when(k == 1, "rumor").otherwise("fact").alias("certainty"),
        F.when(k == 6, F.create_map(F.lit(""), F.lit(""))).otherwise(F.create_map(F.lit("model_name"), F.when(k == 7, "zzz#").otherwise(F.col("word")), F.lit("provider"), F.col("word"))).alias("fields"),
    )
    response = F.concat(F.lit('{"scores":{"model":{"entity":'), F.when(k == 1, "2.5").when(k == 2, "0").otherwise("5"), F.lit('},"odd":{"x":5}},"evidence":['), F.to_json(item), F.lit(',"x"]}'))
    return a.select("article_id", "text", response.alias("response"))


def given_evidence_of(spark, sf):
    a = given_responses(spark, sf)
    rules = spark.createDataFrame([("model", "entity", ["model_name", "provider"], [])], "direction string, dimension string, required array<string>, one_of array<string>")
    return a, given.checked_evidence(a, a, V.dimensions(spark), rules)


@query
def given_evidence(spark, sf):
    """Evidence items from outside: scores that are borne out, lowered or refused, and why."""
    return given_evidence_of(spark, sf)[1].select("article_id", "at", "direction", "dimension", "score", F.md5(F.coalesce("quote", F.lit(""))).alias("quote_md5"), "certainty", "reason")


@query
def given_chains(spark, sf):
    return given.complete_chains(*given_evidence_of(spark, sf))


@query
def review_actions(spark, sf):
    a = T.articles(spark, sf).select("article_id", "status", (F.col("article_id") % 10 == 2).alias("override"))
    actions = T.table(spark, sf, "labels").select(F.col("doc_id").alias("article_id"), F.when(F.col("quality") == 1, "approve").otherwise("reject").alias("action"), F.col("doc_id").alias("at"))
    return roles.reviewed(a, actions)


@query
def event_kinds(spark, sf):
    return T.articles(spark, sf).groupBy(roles.event_kind(F.col("title"), F.col("text")).alias("kind"), "status").agg(F.count("*").alias("n"))


@query
def event_recognition(spark, sf):
    """Each article's event: kind, names, keys, and whether it waits for a review."""
    a = T.articles(spark, sf).withColumn("event", roles.recognized(F.col("title"), F.col("text"))).withColumn("cluster", roles.anchored(F.col("title"), F.col("event")))
    a = a.withColumn("review", roles.event_review(F.col("event"), F.col("cluster")))
    return a.select("article_id", "event.kind", F.array_join("event.entities", ",").alias("entities"), "event.event_key", "cluster.cluster_key", "review.decision", "review.reason")


@query
def publish_score(spark, sf):
    """Rule scores: the primary direction of all nine, general quality, and the score that publication asks for."""
    a = T.articles(spark, sf).select(F.col("article_id").alias("doc_id"), "title", "text", T.chosen(["authoritative", "validation", "signal"], F.col("source_no") % 3).alias("tier"))
    order = V.dimensions(spark).select("direction", "direction_no").distinct()
    rated = scoring.rule_scores(a, scoring.direction_scores(scores_of(spark, sf), V.dimensions(spark)), order, ["apache", "creative commons", "mozilla"])
    return rated.select("doc_id", "primary_direction", "primary_score", F.col("quality.total").alias("quality"), "publish_score")


RULES = [
    ("model", "entity", [(r"(?i)apache|mozilla", ["apache", "mozilla"]), (r"(?i)public licen[sc]e", ["public licen"])], ["version", "license"]), ("agent", "tool_call", [r"\btoken\b"], ["password", "Secret", "key"]),
    ("coding", "code_gen", [(r"[a-z]+tion [a-z]+ing\b", ["tion "])], ["thing", "inter", "ouea"]), ("multimodal", "quality", [], ["des", "les", "der"]), ("data_eval", "coverage", [(r"模型.{0,9}上线", ["模型"])], ["训练"]),
]


@query
def evidence_patterns(spark, sf):
    """Evidence by patterns and phrases; every fifth text has a Chinese sentence, sure or planned."""
    said = F.when(F.col("doc_id") % 5 == 0, "模型训练后上线。").when(F.col("doc_id") % 5 == 1, "模型计划上线。").otherwise("")
    found = scoring.pattern_evidence(T.table(spark, sf, "documents").select("doc_id", F.concat(said, "text").alias("text")), RULES)
    return found.select("doc_id", "direction", "dimension", "score", F.md5(F.coalesce("quote", F.lit(""))).alias("quote_md5"))


@query
def evidence_phrases(spark, sf):
    """Evidence by some thousands of phrases in whole documents."""
    found = scoring.phrase_evidence(T.table(spark, sf, "documents").select("doc_id", "text"), T.phrase_rules(spark, sf))
    return found.select("doc_id", "direction", "dimension", "score", F.md5(F.coalesce("quote", F.lit(""))).alias("quote_md5"))


@query
def score_combine(spark, sf):
    """Given scores, of which every third document has none, with rule scores in their place, halved."""
    rules = scores_of(spark, sf).select(F.col("doc_id").alias("article_id"), "direction", "dimension", "score")
    out = roles.combined(rules.withColumn("score", F.when(F.col("article_id") % 3 != 0, F.col("score")).otherwise(0.0)), rules)
    return out.groupBy("direction", "dimension", "score").agg(F.count("*").alias("n"))


@query
def parse_dispatch(spark, sf):
    """Raw bodies of all types made of pages; one in five of a type that no parser knows."""
    p, i = T.table(spark, sf, "pages"), F.col("page_id")
    payload = F.concat(F.lit("{\"items\":["), F.to_json(F.struct(F.concat(F.lit("t"), i).alias("title"), F.col("url").alias("link"))), F.lit("]}"))
    feed = F.concat(F.lit("<rss><channel><item><title>t"), i, F.lit("</title><guid>g"), i, F.lit("</guid></item></channel></rss>"))
    raw = p.select(i.alias("source_id"), T.chosen([" Web ", "API", "rss", "ftp", "api"], i % 5).alias("feed_type"), F.when(i % 5 == 0, F.col("html")).when(i % 5 == 1, payload).when(i % 5 == 2, feed).otherwise("{}").alias("raw"), "url")
    return parse.dispatched(raw).select("source_id", "feed_type", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("url", F.lit("")).alias("url"), "error")


@query
def fetch_checks(spark, sf):
    """What a fetch is checked for: a body that contradicts its declared type, and how long a server asks to wait."""
    p, i = T.table(spark, sf, "pages"), F.col("page_id")
    problem = parse.format_problem(T.chosen(["rss", " Web", "API", "odd"], i % 4), T.chosen([None, "text/html", "application/json"], i % 3), F.col("html"))
    wait = F.when(i % 3 == 0, (i * 7).cast("string")).when(i % 3 == 1, "soon").otherwise("Tue, 23 Jan 2024 00:00:00 GMT")
    return p.select("page_id", problem.alias("problem"), parse.retry_after_ms(wait, now()).cast("long").alias("wait_ms"))


@query
def nine_scores(spark, sf):
    rows = scoring.nine_rows(scoring.merged_scores(score_rows(spark, sf)))
    return rows.groupBy("direction").agg(F.count("*").alias("n"), F.sum("total_score").alias("total"), F.sum(F.size("dimension_scores")).alias("dimensions"))


@query
def cluster_history(spark, sf):
    return clusters.history(T.articles(spark, sf), now()).select("article_id", stamp(F.col("collected_at")).alias("collected_at"))


@query
def trending_rows(spark, sf):
    """Lists of repositories made of pages: three rows each, one of them without a name, described by the page's title."""
    i = F.col("page_id")
    row = lambda k, name: F.concat(F.lit('<article class="Box-row">'), name, F.lit('<p class="col-9 text">'), F.regexp_replace(texts.page_title(F.col("html")), "[<>&]", ""), F.lit(" &amp; <b>more</b></p>"), F.lit('<span itemprop="programmingLanguage">Lang'), i % 4, F.lit(f'</span><a href="/o/r/stargazers"><svg></svg> {k},'), F.lpad((i % 1000).cast("string"), 3, "0"), F.lit("</a> "), i % 50, F.lit(" stars today</article>"))
    link = F.concat(F.lit('<h2 class="h3"><a href="/own'), i, F.lit(' / repo">x</a></h2>'))
    return parse.trending(T.table(spark, sf, "pages").withColumn("html", F.concat(F.lit("<main>"), row(1, link), row(2, F.lit("none")), row(3, link), F.lit("</main>"))))


@query
def insert_if_absent(spark, sf):
    every = A.normalized(T.items(spark, sf)).where("drop_reason IS NULL")
    return store.inserted(every.where("item_id % 6 = 1"), A.batch_winners(every.where("item_id % 6 <> 1")), ["dedup_url", "content_hash"])[1]


@query
def dedup_given_hashes(spark, sf):
    """Items with hashes that came with them: one goes if a better one that stays has its URL or its hash."""
    given = A.normalized(T.items(spark, sf)).where("drop_reason IS NULL").withColumn("content_hash", F.concat(F.lit("h"), F.col("item_id") % 120))
    return A.distinct_items(given, "item_id").select("item_id")


@query
def stage_counters(spark, sf):
    every = A.normalized(T.items(spark, sf))
    won = A.batch_winners(every.where("drop_reason IS NULL")).select("item_id", F.lit(True).alias("won"))
    deduped = every.where("drop_reason IS NULL").join(won, "item_id", "left")
    return store.counters(every, "normalize", F.col("drop_reason")).unionByName(store.counters(deduped, "dedup", F.when(F.col("won").isNull(), "duplicate")))


@query
def article_search(spark, sf):
    return store.filtered(T.articles(spark, sf), search="The", directions=["model", "coding", "agent"], least_score=20).select("article_id", "title")


@query
def published_ids(spark, sf):
    """Ids that a publication looks at: new, rescored, approved by themselves, checked again."""
    a, ids = T.articles(spark, sf), lambda test: T.articles(spark, sf).where(test).select("article_id")
    new = a.where(F.col("collected_at") >= now() - F.expr("INTERVAL 24 HOURS")).select("article_id")
    return store.united(new, ids("status = 'draft' AND article_id % 4 <> 0"), ids("status = 'pending_review' AND score >= 60"), ids("status = 'published'"))


@query
def direction_rewrite(spark, sf):
    """Nine scores of an article are replaced together; those of articles that are gone go; the primary one is joined by both keys."""
    a = T.articles(spark, sf)
    nine = lambda df, run: df.select("article_id", F.explode(F.array(*map(F.lit, V.NAMES))).alias("direction"), F.lit(run).alias("run"))
    rows = store.rewritten(nine(a, 0), nine(a.where("article_id % 5 = 0"), 1), "article_id")
    rows = store.surviving(rows, a.where("status <> 'blocked'"), "article_id")
    return rows.join(a.select("article_id", "direction"), ["article_id", "direction"]).groupBy("direction", "run").agg(F.count("*").alias("n"))


@query
def article_trace(spark, sf):
    """Each article with the origin that its page names."""
    found = scoring.origins(linked_pages(spark, sf)).select(F.col("page_id").alias("article_id"), "origin")
    a = T.articles(spark, sf).select("article_id", "status").join(found, "article_id", "left")
    return a.select("article_id", "status", F.coalesce("origin", F.lit("")).alias("origin"), F.when(F.col("origin").isNull(), "untraced").otherwise("traced").alias("trace_status"))


@query
def source_validation(spark, sf):
    """Sources proposed from pages, some with what a rule forbids."""
    p, i = T.table(spark, sf, "pages"), F.col("page_id")
    cols = {"name": F.when(i % 17 != 0, "n"), "feed_type": T.chosen([" RSS ", "atom", "api", "ftp"], i % 4), "tier": T.chosen(["authoritative", "validation", "signal", "other", "signal"], i % 5), "url": F.when(i % 6 == 0, "http://10.0.0.1/x").otherwise(F.col("url")), "origin_policy": T.chosen(["aggregator", "first_party", "other"], i % 7)}
    return p.select("page_id", sources.problem(cols).alias("problem"), sources.feed_url(F.col("url")).alias("feed_url"))


def source_change_feed(spark, sf):
    """Sources and changes to them that events make, some to sources that aren't there."""
    e, i = T.table(spark, sf, "events"), F.col("event_id")
    op = F.when(F.col("event_type") == "error", "patch").when(i % 97 == 0, "delete").when(i % 53 == 0, "create").when(i % 7 == 0, "toggle").when(i % 1009 == 1, "drop").otherwise("patch")
    names = F.when(i % 3 == 0, F.concat(F.lit("n"), i))
    changes = e.select(F.concat(F.lit("src"), F.col("user_id") % 24).alias("source_name"), i.alias("seq"), op.alias("op"), names.alias("name"), F.when(i % 5 == 0, F.col("event_type")).alias("category"), F.when(op == "toggle", i % 2 == 0).alias("enabled"))
    old = T.sources(spark, sf).select("source_name", F.concat(F.lit("old"), "source_no").alias("name"), "category", "enabled", "next_fetch_at")
    return sources.changed(old, changes, "source_name", ["name", "category"])


@query
def source_changes(spark, sf):
    return source_change_feed(spark, sf)[0].withColumn("next_fetch_at", stamp(F.col("next_fetch_at")))


@query
def source_change_outcomes(spark, sf):
    return source_change_feed(spark, sf)[1]


@query
def display_title(spark, sf):
    return T.articles(spark, sf).select("article_id", sources.display_title(F.col("title")).alias("shown"))


@query
def rescore_pending(spark, sf):
    return sources.to_rescore(T.articles(spark, sf).withColumn("ai_processed", F.col("article_id") % 4 == 0), F.timestamp_seconds(F.lit(T.DAY0 + 10 * 86400)))


@query
def batch_run(spark, sf):
    """The batch over pages against a history of pages: articles by status and reason."""
    folders.shared_folder(spark)
    items = T.items(spark, sf).withColumn("published_at", F.timestamp_seconds(T.DAY0 + F.col("item_id") % 20 * 86400))
    history = A.normalized(items.where("item_id % 6 = 1")).where("drop_reason IS NULL").select("dedup_url", "content_hash", F.timestamp_seconds(F.lit(T.DAY0)).alias("collected_at"))
    ids = T.table(spark, sf, "pages").where("page_id % 2 = 0").select(F.col("page_id").alias("item_id"), F.lit("s").alias("ai_scores"))
    port = ports.lookup(ids, "item_id", ["ai_scores"])
    out = batch.run(items.where("item_id % 6 <> 1"), history, T.lexicon(spark, sf), now(), ports.Ports(port, port, port, port), SIGNALS, SPAM, NEGATIONS)
    counts = out.articles.groupBy("status", F.coalesce("exclude_reason", F.lit("")).alias("reason")).agg(F.count("*").alias("n")).checkpoint()  # the lineage ends here, so that what the run holds can go
    out.release()
    return counts
