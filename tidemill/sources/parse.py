"""Parsers as columns: feeds (RSS, Atom), JSON interfaces, pages; format checks; fetch bookkeeping. No parser raises."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import texts, times, urls
from tidemill.sources import storage

RSS = "channel struct<title:string,item:array<struct<title:string,link:string,guid:string,pubDate:string,description:string,`content:encoded`:string>>>"
ATOM = "title string, entry array<struct<title:string,link:struct<_href:string>,id:string,updated:string,published:string,summary:string,content:string>>"
#: Names under which an interface's list of items, what wraps one, and an item's fields are looked for, in order.
LISTS, WRAPPERS = ["items", "results", "entries", "posts", "articles"], ["data", "payload", "response"]
TITLES, LINKS, BODIES, SUMMARIES = ["title", "name", "headline"], ["url", "link", "href", "permalink", "guid"], ["content", "body", "text", "articleBody"], ["description", "summary", "excerpt"]
TIMES_ = ["isoDate", "publishedAt", "published_at", "published", "updated", "updatedAt", "updated_at", "date", "pubDate", "created_at", "createdAt", "datePublished", "timestamp", "dc:date"]


def feed_items(feeds: DataFrame) -> DataFrame:
    """(source_id, title, url, content, content_kind, published_at) of feeds (source_id, xml); malformed text has no items."""
    rss = F.from_xml("xml", RSS)["channel"]["item"]
    atom = F.from_xml("xml", ATOM)["entry"]
    text = lambda c: F.nullif(F.trim(c), F.lit(""))
    item = F.transform(rss, lambda i: F.struct(F.trim(i["title"]).alias("title"), F.coalesce(text(i["link"]), text(i["guid"])).alias("url"), text(i["content:encoded"]).alias("full"), text(i["description"]).alias("short"), i["pubDate"].alias("at")))
    entry = F.transform(atom, lambda i: F.struct(F.trim(i["title"]).alias("title"), F.coalesce(text(i["link"]["_href"]), text(i["id"])).alias("url"), text(i["content"]).alias("full"), text(i["summary"]).alias("short"), F.coalesce(i["published"], i["updated"]).alias("at")))
    each = feeds.select("source_id", F.explode(F.coalesce(rss_or(item), entry)).alias("i"))
    kind = F.when(F.col("i.full").isNotNull(), "full").when(F.col("i.short").isNotNull(), "summary").otherwise("missing")
    return each.select("source_id", "i.title", "i.url", F.coalesce("i.full", "i.short").alias("content"), kind.alias("content_kind"), times.parsed_date(F.col("i.at")).alias("published_at"))


def rss_or(items: Column) -> Column:
    return F.when(F.size(items) > 0, items)


def entries(json: Column) -> Column:
    """An object's entries in the order of its text: array<struct<key, raw, kind>>; raw is JSON, kind OBJECT, ARRAY, STRING or another type. Null for what is no object."""
    kinds = F.map_entries(F.from_json(json, "map<string,variant>"))
    kind = lambda k: F.regexp_extract(F.schema_of_variant(k["value"]), "^[A-Z]+", 0)
    return F.zip_with(F.map_entries(F.from_json(json, "map<string,string>")), kinds, lambda e, k: F.struct(e["key"].alias("key"), e["value"].alias("raw"), kind(k).alias("kind")))


def found_lists(payloads: DataFrame) -> DataFrame:
    """(row, source_id, base, valid, list, edges) of payloads (source_id, json, base): the list of items that each one holds, at any depth, as JSON.

    An object's list is that under one of LISTS, else under edges (edges is true: items stand in nodes); else it is looked for behind
    the WRAPPERS, then behind the other names in order, each as deep as it goes before the next one. Objects are opened level by level
    for all payloads at once; a place is told by the turns that lead to it, and the first place in their order counts, which is the one
    that a search in depth meets first. list is null where none is found, valid is false where the text is no JSON.
    """
    at = F.array().cast("array<int>")
    level = storage.written(payloads.select(F.monotonically_increasing_id().alias("row"), "source_id", "base", at.alias("at"), F.col("json")), "payloads")
    roots, found = level, None
    while True:
        opened = level.select("row", "at", "json", F.explode(F.array(entries(F.col("json")))).alias("e"))
        own = F.get(F.filter("e", lambda e: (e["kind"] == "ARRAY") & e["key"].isin(*LISTS)), 0)  # several: the first name
        for name in reversed(LISTS):
            own = F.coalesce(F.get(F.filter("e", lambda e: (e["kind"] == "ARRAY") & (e["key"] == name)), 0), own)  # noqa: B023
        edges = F.get(F.filter("e", lambda e: (e["kind"] == "ARRAY") & (e["key"] == "edges")), 0)
        whole = F.try_parse_json("json")
        told = F.when(F.schema_of_variant(whole).startswith("ARRAY"), F.col("json")).otherwise(F.coalesce(own["raw"], edges["raw"]))
        turn = lambda e, i: F.coalesce(*(F.when(e["key"] == w, n) for n, w in enumerate(WRAPPERS)), i + len(WRAPPERS)).cast("int")
        inner = F.transform(F.coalesce("e", F.array().cast("array<struct<key:string,raw:string,kind:string>>")), lambda e, i: F.struct(turn(e, i).alias("turn"), e["raw"].alias("raw"), e["kind"].alias("kind")))
        step = opened.select("row", "at", told.alias("list"), (own.isNull() & edges.isNotNull()).alias("edges"), F.filter(inner, lambda x: x["kind"].isin("OBJECT", "ARRAY")).alias("inner"))
        step = storage.written(step, "opened")
        deeper = step.where("list IS NULL").select("row", "at", F.explode("inner").alias("x")).select("row", F.array_append("at", F.col("x.turn")).alias("at"), F.col("x.raw").alias("json"))
        here = step.where("list IS NOT NULL").select("row", "at", "list", "edges")
        found = here if found is None else found.unionByName(here)
        level = storage.written(deeper, "level")
        if level.isEmpty():
            break
    first = found.groupBy("row").agg(F.min_by(F.struct("list", "edges"), "at").alias("x"))
    valid = F.try_parse_json("json").isNotNull()
    return roots.select("row", "source_id", "base", valid.alias("valid")).join(first, "row", "left").select("row", "source_id", "base", "valid", F.col("x.list").alias("list"), F.coalesce("x.edges", F.lit(False)).alias("edges"))


def said(item: Column, names: list[str], kinds: tuple[str, ...] = ("STRING",)) -> Column:
    """The first of an item's fields that is a text (or of another of the kinds), trimmed and not empty, or an object whose rendered is one; '' if none is."""
    texts_ = [F.trim(F.when(F.schema_of_variant(v).isin(*kinds), F.try_variant_get(v, "$", "string"))) for n in names for f in [F.try_variant_get(item, f"$['{n}']", "variant")] for v in (f, F.try_variant_get(f, "$.rendered", "variant"))]
    return F.coalesce(*(F.nullif(t, F.lit("")) for t in texts_), F.lit(""))


def api_parsed(payloads: DataFrame) -> DataFrame:
    """(source_id, no, title, url, content, content_kind, published_at, skipped, error) of payloads (source_id, json, and base, if links may be relative).

    A row for each listed item in order (no from 1): skipped tells why it is none (not_an_object, no_title_or_link). A payload without a
    usable item has one row more, without no, with error: invalid_json, unrecognized (no list at any depth), no_items (some
    listed, all skipped). An empty list gives no row.
    """
    given = payloads if "base" in payloads.columns else payloads.withColumn("base", F.lit(None).cast("string"))
    lists = storage.written(found_lists(given), "lists")
    item = lists.select("row", "source_id", "base", "edges", F.posexplode(F.from_json("list", "array<variant>")).alias("no", "i"))
    node = F.try_variant_get("i", "$.node", "variant")
    item = item.withColumn("i", F.when(F.col("edges") & node.isNotNull(), node).otherwise(F.col("i"))).withColumn("is_object", F.coalesce(F.schema_of_variant("i").startswith("OBJECT"), F.lit(False)))
    cut = item.select("row", "source_id", "base", (F.col("no") + 1).alias("no"), "is_object", *(said(F.col("i"), names).alias(c) for c, names in (("t", TITLES), ("l", LINKS), ("full", BODIES), ("short", SUMMARIES))), said(F.col("i"), TIMES_, ("STRING", "BIGINT")).alias("at"))
    clean = lambda c: F.when(c.rlike("[<&]"), texts.html_to_text(c)).otherwise(texts.collapsed(c))
    link = urls.resolved(F.col("base"), F.col("l")) if "base" in payloads.columns else F.col("l")
    cut = cut.withColumn("title", clean(F.col("t"))).withColumn("link", link)
    fine = (F.col("title") != "") & F.coalesce(F.col("link").rlike("(?i)^https?://"), F.lit(False))
    reason = F.when(~F.col("is_object"), "not_an_object").when(~fine, "no_title_or_link")
    kind = F.when(F.col("full") != "", "full").when(F.col("short") != "", "summary").otherwise("missing")
    body = F.nullif(clean(F.coalesce(F.nullif("full", F.lit("")), F.col("short"))), F.lit(""))
    parsed = cut.select("row", "source_id", "no", F.when(reason.isNull(), F.col("title")).alias("title"), F.when(reason.isNull(), F.col("link")).alias("url"), F.when(reason.isNull(), body).alias("content"), F.when(reason.isNull(), kind).alias("content_kind"), F.when(reason.isNull(), times.parsed_date(F.col("at"))).alias("published_at"), reason.alias("skipped"))
    parsed = storage.written(parsed, "parsed")
    counts = parsed.groupBy("row").agg(F.count("*").alias("n"), F.count_if(F.col("skipped").isNull()).alias("kept"))
    error = F.when(~F.col("valid"), "invalid_json").when(F.col("list").isNull(), "unrecognized").when((F.col("n") > 0) & (F.col("kept") == 0), "no_items")
    failed = lists.join(counts, "row", "left").select("source_id", error.alias("error")).where("error IS NOT NULL")
    return parsed.drop("row").withColumn("error", F.lit(None).cast("string")).unionByName(failed, allowMissingColumns=True)


def api_items(payloads: DataFrame) -> DataFrame:
    """(source_id, title, url, content, content_kind, published_at) of payloads' usable items; see api_parsed()."""
    return api_parsed(payloads).where("no IS NOT NULL AND skipped IS NULL").drop("no", "skipped", "error")


def linked_values(pages: DataFrame) -> DataFrame:
    """(page_id, at, v variant) of pages (page_id, html): the objects in a page's JSON-LD scripts, behind lists and @graph, in the order in which they are met."""
    scripts = F.regexp_extract_all("html", F.lit(r"(?is)<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"), F.lit(1))
    level = pages.select("page_id", F.posexplode(scripts).alias("no", "json")).select("page_id", F.array("no").alias("at"), F.try_parse_json("json").alias("v")).where("v IS NOT NULL")
    level, found = storage.written(level, "ld"), None
    while True:
        kind = F.schema_of_variant("v")
        objects = level.where(kind.startswith("OBJECT"))
        found = objects if found is None else found.unionByName(objects)
        inner = F.when(kind.startswith("ARRAY"), F.variant_get("v", "$", "array<variant>"))
        graph = objects.select("page_id", F.array_append("at", F.lit(0)).alias("at"), F.try_variant_get("v", "$['@graph']", "variant").alias("v")).where("v IS NOT NULL")
        listed = level.where(kind.startswith("ARRAY")).select("page_id", "at", F.posexplode(inner).alias("no", "v")).select("page_id", F.array_append("at", F.col("no")).alias("at"), "v")
        level = storage.written(listed.unionByName(graph).where("v IS NOT NULL"), "ld")
        if level.isEmpty():
            return found


def page_metadata(pages: DataFrame) -> DataFrame:
    """(page_id, title, canonical, og_url, description, published, updated) of pages (page_id, html), as texts; '' where a page doesn't tell.

    A title element goes before og:title, and that before a headline in JSON-LD; of canonical links and og:url the last counts,
    of descriptions and dates the first, metas before JSON-LD. page_id is unique.
    """
    attribute = lambda attrs, name: F.trim(F.regexp_extract(attrs, rf"(?i){name}\s*=\s*[\"']([^\"']*)[\"']", 1))
    metas = F.transform(F.regexp_extract_all("html", F.lit(r"(?i)<meta\s+([^>]+)>"), F.lit(1)), lambda m: F.struct(F.lower(F.coalesce(F.nullif(attribute(m, "property"), F.lit("")), attribute(m, "name"))).alias("name"), attribute(m, "content").alias("content")))
    links = F.transform(F.filter(F.regexp_extract_all("html", F.lit(r"(?i)<link\s+([^>]+)>"), F.lit(1)), lambda m: m.rlike(r"(?i)\brel\s*=\s*[\"'][^\"']*canonical[^\"']*[\"']")), lambda m: attribute(m, "href"))
    cut = pages.select("page_id", texts.page_title(F.col("html")).alias("own"), F.explode(F.array(F.filter(metas, lambda m: (m["name"] != "") & (m["content"] != "")))).alias("m"), links.alias("links"))
    first = lambda *names: F.get(F.filter("m", lambda m: m["name"].isin(*names)), 0)["content"]
    last = lambda values: F.get(values, F.size(values) - 1)
    told = linked_values(pages)
    text = lambda name: F.nullif(F.trim(F.when(F.schema_of_variant(F.try_variant_get("v", f"$.{name}", "variant")) == "STRING", F.try_variant_get("v", f"$.{name}", "string"))), F.lit(""))
    fields = told.select("page_id", "at", text("headline").alias("headline"), text("description").alias("ld_description"), F.coalesce(text("datePublished"), text("dateCreated")).alias("ld_published"), text("dateModified").alias("ld_updated"))
    names = ["headline", "ld_description", "ld_published", "ld_updated"]
    fields = fields.groupBy("page_id").agg(*(F.min(F.when(F.col(c).isNotNull(), F.struct("at", c)))[c].alias(c) for c in names))
    pick = lambda *of: F.coalesce(*(F.nullif(c, F.lit("")) for c in of), F.lit(""))
    return cut.join(fields, "page_id", "left").select(
        "page_id", pick(F.col("own"), first("og:title"), F.col("headline")).alias("title"), pick(last(F.col("links"))).alias("canonical"), pick(last(F.filter("m", lambda m: m["name"] == "og:url"))["content"]).alias("og_url"),
        pick(first("description", "og:description"), F.col("ld_description")).alias("description"), pick(first("article:published_time", "datepublished", "date"), F.col("ld_published")).alias("published"),
        pick(first("article:modified_time", "datemodified"), F.col("ld_updated")).alias("updated"),
    )


def page_items(pages: DataFrame) -> DataFrame:
    """(page_id, url, title, content, content_kind, blocked): article or main text of 40 characters or more, else the description."""
    html = F.col("html")
    body = F.coalesce(*(F.nullif(F.regexp_extract(html, rf"(?is)<{t}\b[^>]*>(.*?)</{t}>", 1), F.lit("")) for t in ("article", "main", "body")), F.lit(""))
    text = texts.html_to_text(F.regexp_replace(body, r"(?is)<(nav|header|footer|aside|form)\b.*?</\1>", " "))
    told = F.nullif(F.regexp_extract(html, r'(?i)<meta[^>]+name="description"[^>]+content="([^"]*)"', 1), F.lit(""))
    long = F.length(text) >= 40
    kind = F.when(long, "full").when(told.isNotNull(), "summary").otherwise("missing")
    return pages.select("page_id", "url", texts.page_title(html).alias("title"), F.when(long, F.substring(text, 1, 10000)).otherwise(told).alias("content"), kind.alias("content_kind"), blocked(html).alias("blocked"))


def dispatched(raw: DataFrame) -> DataFrame:
    """(source_id, feed_type, title, url, content, error) of raw (source_id, feed_type, raw, url): each row by its type's parser.

    Types are compared without case and outer spaces. An unknown type, or a body of which the parser makes nothing, gives a
    row with an error and no item; nothing raises.
    """
    kind = F.lower(F.trim("feed_type"))
    rows = raw.select("source_id", F.coalesce(kind, F.lit("")).alias("feed_type"), F.col("raw"), "url")
    feeds = feed_items(rows.where(F.col("feed_type").isin("rss", "atom")).select("source_id", F.col("raw").alias("xml")))
    payloads = api_items(rows.where("feed_type = 'api'").select("source_id", F.col("raw").alias("json")))
    pages = page_items(rows.where("feed_type = 'web'").select(F.col("source_id").alias("page_id"), "url", F.col("raw").alias("html"))).withColumnRenamed("page_id", "source_id")
    found = feeds.select("source_id", "title", "url", "content").unionByName(payloads.select("source_id", "title", "url", "content")).unionByName(pages.select("source_id", "title", "url", "content"))
    error = F.when(~F.col("feed_type").isin("rss", "atom", "api", "web"), "unknown_type").when(F.col("found").isNull(), "no_items")
    told = rows.select("source_id", "feed_type").join(found.select("*", F.lit(True).alias("found")), "source_id", "left")
    return told.select("source_id", "feed_type", "title", "url", "content", error.alias("error"))


def blocked(html: Column) -> Column:
    """Whether the first 20,000 characters look like a captcha, a login or a missing page."""
    head = F.lower(F.substring(html, 1, 20000))
    return head.rlike("captcha|verify you are human") | (head.rlike("log ?in|sign ?in") & head.contains('type="password"')) | head.rlike("<title>[^<]*(?:404|not found)")


def format_problem(declared: Column, content_type: Column, body: Column) -> Column:
    """Whether the body contradicts the declared type: its content type first, then its first sign."""
    start = F.ltrim(F.substring(body, 1, 512))
    seen = F.when(content_type.rlike("(?i)json"), "api").when(content_type.rlike("(?i)xml|rss|atom"), "rss").when(content_type.rlike("(?i)html"), "web")
    seen = F.coalesce(seen, F.when(start.rlike(r"^[\[{]"), "api").when(start.rlike("(?i)^<!doctype html|^<html"), "web").when(start.startswith("<"), "rss"))
    kind = F.lower(F.trim(declared))
    return F.when(~kind.isin("rss", "atom", "api", "web"), "unknown_type").when(seen.isNotNull() & (seen != F.when(kind == "atom", "rss").otherwise(kind)), "format_mismatch")


def retry_after_ms(value: Column, now: Column) -> Column:
    """Milliseconds that a Retry-After header asks for: seconds or a date, 0 at least; null if neither."""
    seconds = F.try_to_number(F.when(value.rlike("^[0-9]{1,9}$"), value), F.lit("999999999")).cast("long") * 1000
    until = times.parsed_date(F.when(~value.rlike("^[0-9]+$"), value))
    return F.coalesce(seconds, F.when(until.isNotNull(), F.greatest(F.lit(0), (F.unix_timestamp(until) - F.unix_timestamp(now)) * 1000)))


def ranked_hotlist(entries: DataFrame) -> DataFrame:
    """(kind, rank, title, url) of entries (kind, position, title, is_ad): ads and empty titles go, then ranks are given."""
    from pyspark.sql import Window

    kept = entries.where(~F.coalesce("is_ad", F.lit(False)) & (F.trim(F.coalesce("title", F.lit(""))) != ""))
    encoded = F.url_encode("title")
    for a, b in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return kept.select("kind", F.row_number().over(Window.partitionBy("kind").orderBy("position")).alias("rank"), "title", F.concat(F.lit("https://search.example/?q="), encoded).alias("url"))


def trending(pages: DataFrame) -> DataFrame:
    """(page_id, rank, name, description, language, stars, stars_new) of pages (page_id, html) that list repositories.

    A row's rank is its place among the page's row marks, so that a row without a name leaves a gap. Numbers may hold
    commas; what is missing is empty or 0.
    """
    rows = pages.select("page_id", F.posexplode(F.split("html", r'<article\s+class="Box-row"', -1)).alias("rank", "row")).where("rank > 0")
    found = lambda pattern: F.trim(F.regexp_extract("row", pattern, 1))
    bare = lambda c: texts.trimmed(F.regexp_replace(c, r"<[^>]*>", ""))
    number = lambda c: F.coalesce(F.expr(f"try_cast(regexp_extract(replace({c}, ',', ''), '^[0-9]+', 0) AS BIGINT)"), F.lit(0))
    cut = rows.select(
        "page_id", "rank", F.regexp_replace(found(r'(?s)<h2[^>]*>.*?<a[^>]*href="/([^"]+)".*?</a>'), r"\s+", "").alias("name"), texts.decoded(bare(found(r'(?s)<p\s+class="col-9[^"]*"[^>]*>(.*?)</p>'))).alias("description"),
        found(r'itemprop="programmingLanguage"[^>]*>([^<]+)<').alias("language"), bare(found(r'(?s)href="/[^"]*/stargazers"[^>]*>(.*?)</a>')).alias("all"), found(r"(?i)([0-9,]+)\s+stars?\s+(?:today|this week|this month)").alias("new"),
    )
    return cut.where("name <> ''").select("page_id", "rank", "name", "description", "language", number("all").alias("stars"), number("new").alias("stars_new"))
