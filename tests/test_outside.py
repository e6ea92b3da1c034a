"""What comes from outside: link probes, likeliest origins, given evidence."""

import json

from pyspark.sql import functions as F

from tidemill.operators import given, probes, scoring


def test_probes_end_or_need_a_review(spark):
    said = [("https://a.org/", 301, "/b", None), ("https://a.org/b", 200, None, None), ("https://l.org/", 302, "https://l.org/", None), ("https://d.org/", 410, None, None), ("https://e.org/", None, None, "timeout"), ("https://p.org/", 302, "http://[::1]/", None), ("https://n.org/", 304, None, None)]
    table = spark.createDataFrame(said, "url string, status int, location string, error string")
    names = spark.createDataFrame([("in.org", ["10.0.0.1"]), *((h, ["8.8.8.8"]) for h in ("a.org", "l.org", "d.org", "e.org", "p.org", "n.org"))], "name string, addresses array<string>")
    links = spark.createDataFrame([(u,) for u in ("https://a.org/", "https://a.org/", "https://l.org/", "https://d.org/", "https://e.org/", "https://p.org/", "https://n.org/", "https://in.org/", "http://127.1/", None)], "url string")
    got = {r.url: (r.state, r.detail, r.hops) for r in probes.probed(links, lambda asked: asked.join(table, "url", "left"), lambda asked: asked.join(names, "name", "left")).collect()}
    assert got == {
        "https://a.org/": ("alive", "", 2), "https://l.org/": ("needs_review", "redirect_limit", 4), "https://d.org/": ("dead", "HTTP 410 for https://d.org/", 1), "https://e.org/": ("needs_review", "probe_error:timeout", 1),
        "https://p.org/": ("needs_review", "unsafe_redirect:private_address", 1), "https://n.org/": ("alive", "", 1), "https://in.org/": ("needs_review", "unsafe_probe:dns_private_or_empty", 1), "http://127.1/": ("needs_review", "unsafe_probe:private_address", 1),
    }


def test_origins_by_domain_and_path(spark):
    page = "<link href='https://sub.own.org/c' rel='canonical'> https://techcrunch.com/news/1 https://x.mit.edu/a <meta content='https://plain.net/' name='og:url'> https://own.org.evil.net/blog/ https://github.com/a.zip https://plain.net/"
    pages = spark.createDataFrame([(1, "https://own.org/p", page), (2, "https://own.org/p", "https://techcrunch.com/x"), (3, None, None)], "page_id int, url string, html string")
    assert [r.url for r in scoring.untyped_candidates(pages).where("page_id = 1").orderBy("at").collect()] == ["https://plain.net/", "https://techcrunch.com/news/1", "https://x.mit.edu/a", "https://own.org.evil.net/blog/"]
    got = [tuple(r) for r in scoring.likeliest_origins(scoring.untyped_candidates(pages), scoring.domain_table(spark)).collect()]
    assert got == [(1, "https://own.org.evil.net/blog/", 11)]


def test_given_evidence_is_refused_or_lowered(spark):
    text = "Acme deployed 模型 A-1 with 40% lower cost in 2024, as all of its many customers say. It may also ship B."
    good = {"direction": "infra", "dimension": "cost", "score": 5, "quote": "Acme deployed 模型 A-1 with 40% lower cost", "subject": "Acme", "predicate": "deployed", "object": "模型 A1", "certainty": "fact", "fields": {"amount": 40, "unit": "%", "status": "deployed", "bad": {"x": 1}}}
    items = [good, {**good, "score": 2.5, "certainty": "rumor"}, {**good, "object": "zzz"}, {**good, "fields": {"amount": 41, "unit": "%"}}, {**good, "quote": "It may also ship B.", "subject": "It", "predicate": "ship", "object": "B"}, {**good, "fields": []}, {**good, "certainty": "sure"}, {**good, "score": "5"}, {**good, "quote": "q" * 281}, 7, {}, {**good, "dimension": "odd"}, {**good, "fields": {"amount": [40, "cost"], "unit": "%"}}]
    rows = [(1, text, json.dumps({"scores": {"infra": {"cost": 5, "ops": 0}, "odd": {"x": 5}}, "evidence": items})), (2, text, "{bad"), (3, text, json.dumps({"scores": {"infra": {"ops": 5}}})), (4, None, json.dumps({"evidence": [good]}))]
    a = spark.createDataFrame(rows, "article_id int, text string, response string")
    dims = spark.createDataFrame([("infrastructure", "cost"), ("infrastructure", "ops")], "direction string, dimension string")
    rules = spark.createDataFrame([("infrastructure", "cost", ["amount", "unit"], [])], "direction string, dimension string, required array<string>, one_of array<string>")
    found = given.checked_evidence(a, a, dims, rules)
    got = {(r.article_id, r["at"]): (r.score, r.reason) for r in found.collect()}
    assert [got[1, n] for n in range(13)] == [(5.0, None), (2.5, None), (2.5, "tuple"), (2.5, "required"), (2.5, "required"), (None, "fields"), (None, "certainty"), (None, "score"), (None, "quote"), (None, "not_object"), (None, "direction"), (None, "dimension"), (5.0, None)]
    assert got[4, 0] == (None, "not_in_text") and len(got) == 14
    chains = {r.article_id: (r.n_claims, r.complete) for r in given.complete_chains(a, found).collect()}
    assert chains[1] == (1, True) and chains[3] == (1, False)
    assert found.where(F.col("article_id") == 2).count() == 0
