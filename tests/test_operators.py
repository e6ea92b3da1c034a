"""Operators that SQL can't express, and cases of single functions."""

import random

import pandas as pd
from pyspark.sql import functions as F

from tidemill.functions import texts, times, urls
from tidemill.operators import articles as A
from tidemill.operators import clusters, roles
from tidemill.plans import tables, vocabulary
from tidemill.plans.queries import QUERIES
from tidemill.sources import parse, ports, snapshots
from tidemill.streaming import incremental

SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    kinds = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], kinds).select(column.alias("x")).first().x


def test_urls(spark):
    for given, want in {
        "HTTPS://Ex.com:443/a?b=2&UTM_source=x&a=1#f": "https://ex.com/a?a=1&b=2", "http://x.com": "http://x.com/", "ftp://x/y": "", "nonsense": "",
    }.items():
        assert one(spark, urls.canonical_url(F.col("u")), u=given) == want
    assert one(spark, urls.traced_url(F.col("u")), u="https://x.com/a?utm_id=1&z=2#k).") == "https://x.com/a?z=2#k"
    bad = {"http://127.0.0.1/": "private_address", "http://a:b@x.com/": "userinfo", "gopher://x/": "scheme", "http://x.com:22/": "port", "http://[::1]/": "private_address", "https://ok.com/": None}
    for given, want in bad.items():
        assert one(spark, urls.unsafe_reason(F.col("u")), u=given) == want, given


def test_texts_and_times(spark):
    assert one(spark, texts.composed(F.col("t")), t="ＡＩ​①") == "AI1"
    cases = {"&amp;lt; &#65; &#x41; &#128512;": "< A A \U0001F600", "&#38;#x41; &nbsp;&apos;&#x2F;": "A  '/", "&#1114112; &#xD800; &#;": "&#1114112; &#xD800; &#;", "plain": "plain", "&amp;amp;": "&amp;"}
    for given, want in cases.items():
        assert one(spark, texts.decoded(F.col("t")), t=given) == want, given
    page = "<p>visible\n word</p><script>no</script><style>no</style><template>no</template><!-- no --><br/>and &lt;b&gt;&#12288;more"
    assert one(spark, texts.html_to_text(F.col("t")), t=page) == "visible word and <b> more"
    assert one(spark, texts.normalized_title(F.col("t")), t=" A\u200bI &amp;  ＡＩ\u3000x ") == "AI & AI x"
    assert one(spark, F.to_json(texts.sentences(F.col("t"))), t="用AI做。 a.b！\n\n c") == '["用AI做","a.b","c"]'
    assert one(spark, F.to_json(texts.grams(F.col("t"), 2)), t="大模型a模型") == '["大模","模型"]'
    assert one(spark, F.to_json(texts.paragraphs(F.col("t"))), t="a b.\n\nc! d") == '["a b.","c!","d"]'
    assert one(spark, texts.grounded(F.lit(" x y "), F.col("t")), t="a x y b") is True
    for given, want in {"1704067200": "2024-01-01 00:00:00", "1704067200000": "2024-01-01 00:00:00", "Tue, 02 Jan 2024 10:00:00 GMT": "2024-01-02 10:00:00", "x": None}.items():
        assert one(spark, times.parsed_date(F.col("t")).cast("string"), t=given) == want
    assert one(spark, times.rounded(F.col("t").cast("double")), t="-0.5") == 0
    steps = [one(spark, times.cooldown_seconds(F.col("n").cast("int"), F.col("g") == "y"), n=n, g=g) for n, g in (("2", "n"), ("3", "n"), ("5", "n"), ("40", "n"), ("3", "y"))]
    assert steps == [None, 7200, 28800, 604800, 604800]


def test_parsers(spark):
    feeds = [("a", "<rss><channel><item><title> T </title><link/><guid>g</guid><content:encoded>c</content:encoded></item></channel></rss>"), ("b", "<broken"), ("c", None)]
    got = parse.feed_items(spark.createDataFrame(feeds, "source_id string, xml string")).collect()
    assert [(r.source_id, r.title.strip(), r.url, r.content_kind) for r in got] == [("a", "T", "g", "full")]
    payloads = [("a", '{"data":{"items":[{"name":"N","link":"https://x.org/l","content":{"rendered":"r"},"date":1704067200}]}}'), ("b", "[{\"title\":\"t\"}]"), ("c", "{")]
    got = {r.source_id: (r.title, r.url, r.content, str(r.published_at)) for r in parse.api_items(spark.createDataFrame(payloads, "source_id string, json string")).collect()}
    assert got == {"a": ("N", "https://x.org/l", "r", "2024-01-01 00:00:00")}  # an item without a link is skipped
    assert one(spark, parse.format_problem(F.col("d"), F.col("c"), F.col("b")), d=" RSS ", c="", b=' {"a":1}') == "format_mismatch"
    assert one(spark, parse.retry_after_ms(F.col("v"), F.timestamp_seconds(F.lit(0))), v="12") == 12000
    assert one(spark, parse.blocked(F.col("h")), h="<p>Please solve the CAPTCHA</p>") is True


def test_batch_winner_order(spark):
    rows = [(1, "u", "t", "xx", "aggregator", "authoritative", "a", "h", "u"), (2, "u", "t", "x", "editorial", "signal", "a", "h", "u"), (3, "u", "t", "xxx", "editorial", "validation", "a", "h", "u"), (4, "v", "t", "x", None, None, "a", "h", "v")]
    df = spark.createDataFrame(rows, "id int, dedup_url string, title string, content string, origin_policy string, tier string, source_name string, content_hash string, url string")
    assert {r.id for r in A.batch_winners(df).collect()} == {3, 4}


def brute_front_page(rows, limit):
    key = lambda r: (-r.score, -r.published_at.timestamp(), r.article_id)
    best = {}
    for r in rows:
        k = r.cluster_id or f"article:{r.article_id}"
        if k not in best or key(r) < key(best[k]):
            best[k] = r
    queues = {d: sorted((r for r in best.values() if r.direction == d), key=key) for d in vocabulary.NAMES}
    by_source, by_direction, out, moved = {}, {}, [], True
    while moved and len(out) < limit:
        moved = False
        for d in vocabulary.NAMES:
            while queues[d] and len(out) < limit and by_direction.get(d, 0) < max(2, -(-limit // 2)):
                r = queues[d].pop(0)
                if by_source.get(r.source_name, 0) < max(2, -(-limit // 5)):
                    by_source[r.source_name] = by_source.get(r.source_name, 0) + 1
                    by_direction[d] = by_direction.get(d, 0) + 1
                    out.append(r.article_id)
                    moved = True
                    break
    return {a: 100 + i for i, a in enumerate(out)}


def test_front_page_equals_the_sequential_rule(spark):
    a = tables.articles(spark, "/root/testdata/sf0.01").drop("text")
    for least, limit in ((75, 20), (0, 7), (95, 20)):
        some = a.where((F.col("status") == "published") & (F.col("score") >= least))
        assert {r.article_id: r["rank"] for r in A.front_page(some, limit).collect() if r.reason == "selected"} == brute_front_page(some.collect(), limit)


def test_direction_stories(spark):
    full = lambda *names: F.create_map(*(x for n in names for x in (F.lit(n), F.lit(5.0))))
    cases = [("model", ("entity", "capability", "cost"), True), ("model", ("entity", "capability"), False), ("agent", ("task_boundary", "orchestration", "protocol"), True), ("business_ecosystem", ("talent", "strategy", "signal"), True), ("coding", ("code_gen", "ide_integration", "delivery"), True), ("coding", ("code_gen", "security", "cost_speed"), False)]
    for direction, names, want in cases:
        assert spark.range(1).select(vocabulary.complete(F.lit(direction), full(*names)).alias("x")).first().x is want
    assert len(vocabulary.dimension_rows()) == 71


def test_snapshots_ports_and_streams(spark, tmp_path):
    folder = str(tmp_path / "snap")
    snapshots.save(spark.range(3).toDF("id"), folder)
    snapshots.save(spark.range(5).toDF("id"), folder)
    assert snapshots.load(spark, folder).count() == 5
    probe = ports.lookup(spark.createDataFrame([(1, 404)], "id long, probe_status int"), "id", ["probe_status"])
    assert {r.id: r.probe_status for r in probe(spark.range(2).toDF("id")).collect()} == {0: None, 1: 404}
    frame = pd.DataFrame({"k": ["a", "a", "b"], "at": pd.to_datetime(["2024-01-01 00:00", "2024-01-01 01:00", "2024-01-01 00:00"])})
    spark.createDataFrame(frame).write.parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    out, mark = str(tmp_path / "out"), str(tmp_path / "mark")
    for _ in range(2):
        incremental.drained(incremental.first_seen(spark, str(tmp_path / "in"), schema, "k", "at"), out, mark)
    assert sorted(r.k for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_settings_pages_and_sources(spark):
    import pytest

    from tidemill.operators import sources
    from tidemill.plans import config

    assert [config.bounded(x, 5, 1, 10) for x in ("7", 7.9, "x", 11, None)] == [7, 7, 5, 5, 5]
    assert config.page("3", "50") == (100, 50) and config.page(None, None) == (0, 20)
    for wrong in (("0", "1"), ("1", "101"), ("1.5", "2"), ("10001", "1")):
        with pytest.raises(ValueError):
            config.page(*wrong)
    assert config.Settings.read({"publish_least": "80", "front_page": 0}).publish_least == 80
    assert one(spark, sources.feed_url(F.col("u")), u="https://X.com/feed/?b=1&a=2") == "https://x.com/feed?a=2&b=1"
    assert one(spark, sources.feed_url(F.col("u")), u="https://x.com:8080/feed") == ""


def test_batch_statuses(spark):
    got = {(r.status, r.reason): r.n for r in QUERIES["batch_run"](spark, SF).collect()}
    assert sum(got.values()) > 0 and {s for s, _ in got} <= {"blocked", "pending_review", "published", "draft"}


def test_normalize_takes_canonical_urls_and_raw_content(spark):
    rows = [
        (1, "T\u200bitle", "https://a.com/x", "body", None, None, "https://b.com/y?utm_source=z&b=2&a-b=3&a=1"), (2, "t", "javascript:alert(1)", "body", None, None, None), (3, "t", "https://a.com/z", " ", "<p>raw</p>", None, None),
        (4, "t", "https://a.com/w", "", "<p>raw</p>", "missing", None), (5, "t", " ", "b", None, None, None), (6, "\u200b", "https://a.com/v", "b", None, None, None),
    ]
    items = spark.createDataFrame(rows, "id int, title string, url string, content string, raw_content string, content_status string, canonical_url string")
    got = {r.id: r for r in A.normalized(items).collect()}
    assert [got[i].drop_reason for i in range(1, 7)] == [None, "url_invalid", None, "content", "url_missing", "title"]
    assert got[1].title == "Title" and got[1].dedup_url == "https://b.com/y?a=1&a-b=3&b=2" and got[3].content == "raw"


def test_given_hashes_drop_across_urls(spark):
    rows = [("u1", "h1", 5, 1), ("u1", "h2", 4, 2), ("u2", "h2", 3, 3), ("u3", "h3", 2, 4), ("u4", "h3", 9, 5), ("u4", "h9", 1, 6)]
    items = spark.createDataFrame([(u, h, "x" * n, i, "t", "s", u, "editorial", "signal") for u, h, n, i in rows], "dedup_url string, content_hash string, content string, id int, title string, source_name string, url string, origin_policy string, tier string")
    assert {r.id for r in A.distinct_items(items, "id").collect()} == {1, 3, 5}  # 2 goes behind 1, so 3 stays


def test_events(spark):
    event = roles.recognized(F.col("t"), F.col("c"))
    got = spark.createDataFrame([("OpenAI launch with Google", "融资 Meta Google"), ("series B", "x"), ("MMLU", "score"), ("AI policy", ""), ("ab", "cd")], "t string, c string").select(event.alias("e")).collect()
    assert [r.e.kind for r in got] == ["release", "funding", "benchmark", "policy", "other"] and got[0].e.entities == ["Google", "Meta", "OpenAI"] and [r.e.confidence for r in got][-1] == 0.25


def test_links_are_resolved(spark):
    cases = {"b": "https://h.com/a/b", "/x?q=1": "https://h.com/x?q=1", "//k.org/y": "https://k.org/y", "../z": "https://h.com/z", "http://o.net/": "http://o.net/"}
    for link, want in cases.items():
        assert one(spark, urls.resolved(F.lit("https://h.com/a/p"), F.col("u")), u=link) == want


def test_chinese_evidence_counts_only_what_is_sure(spark):
    rules = [("coding", "code_gen", ["生成代码"], []), ("coding", "engineering", ["(?:修复|重构).{0,8}(?:缺陷|工程)"], ["缺陷", "重构"]), ("applications", "launch_status", ["已?上线"], ["导诊", "产品"])]
    texts_ = {1: "该编程助手已正式上线，在大型代码库中生成代码并理解跨文件仓库，自动修复代码缺陷并完成工程重构。", 2: "该医院计划在医疗行业上线产品，据称可能自动化导诊流程，但尚未部署。", 3: "发现缺陷。完成重构"}
    from tidemill.operators import scoring

    got = scoring.pattern_evidence(spark.createDataFrame(list(texts_.items()), "doc_id int, text string"), rules).collect()
    assert {(r.doc_id, r.dimension, r.score) for r in got} == {(1, "code_gen", 5.0), (1, "engineering", 5.0), (1, "launch_status", 5.0), (3, "engineering", 2.5)}


def test_addresses_in_other_forms_and_behind_redirects(spark):
    cases = {
        "http://2130706433/": "private_address", "http://0x7f000001/": "private_address", "http://[::ffff:127.0.0.1]/": "private_address", "http://0177.0.0.1/": "private_address", "http://127.1/": "private_address", "http://0x8.0x8.2056/": None,
        "http://[::ffff:7f00:1]/": "private_address", "http://[::]/": "private_address", "http://[::1]:80/": "private_address", "http://[fe80::1]/": "private_address", "http://[fd12:3456::]/": "private_address", "http://[ff02::1]/": "private_address",
        "http://[2001:db8::8.8.8.8]/": None, "http://[2606:4700::1111]/": None, "http://[1::2::3]/": "invalid", "http://[1:2:3:4:5:6:7:8:9]/": "invalid", "http://[12345::]/": "invalid", "http://256.1.1.1/": "invalid", "http://1.2.3.4.5/": "invalid",
        "http://08.1.1.1/": "invalid", "http://4294967296/": "invalid", "http://99999999999999999999/": "invalid", "http://100.64.0.1/": "private_address", "http://172.32.0.1/": None, "http://198.19.255.255/": "private_address", "http://240.0.0.1/": "private_address",
        "https://go.com/?url=http%3A%2F%2F10.0.0.1%2F": "private_address", "https://add.com/x": None, "https://8.8.8.8/": None, "http://1e100.net/": None, "http://instance-data/": "local_host", "nonsense": "invalid", "ftp://8.8.8.8/": "scheme",
    }
    frame = spark.createDataFrame([(u,) for u in cases], "u string")
    got = {r.u: r.reason for r in frame.select("u", urls.unsafe_target(F.col("u")).alias("reason")).collect()}
    assert got == cases
    answers = [(["8.8.8.8"], None), ([], "dns_private_or_empty"), (None, "dns_private_or_empty"), (["8.8.8.8", "10.0.0.1"], "dns_private_or_empty"), (["2606:4700::1111"], None), (["::ffff:10.0.0.1"], "dns_private_or_empty"), (["odd"], "dns_private_or_empty")]
    frame = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(answers)], "i int, a array<string>")
    assert [r.reason for r in frame.select("i", urls.unsafe_answers(F.col("a")).alias("reason")).orderBy("i").collect()] == [w for _, w in answers]


def test_edges_hold_items_in_nodes(spark):
    got = parse.api_items(spark.createDataFrame([(1, '{"data":{"edges":[{"node":{"title":{"rendered":"T"},"link":"https://x.com"}}]}}')], "source_id int, json string")).collect()
    assert [(r.title, r.url) for r in got] == [("T", "https://x.com")]


def test_items_are_read_and_normalised_once(spark):
    """Title and content were computed again for each place that names them."""
    from tidemill.operators import articles
    from tidemill.plans import tables

    pages = articles.batch_winners(articles.normalized(tables.items(spark, "/root/testdata/sf0.001")).where("drop_reason IS NULL"))
    plan = pages._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<template") == 1 and plan.count("<title[^>]") == 1
