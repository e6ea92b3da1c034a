"""Lists of items and JSON-LD at any depth, against a recursive search."""

import json
import random

from tidemill.sources import parse

LISTS, WRAPPERS = ["items", "results", "entries", "posts", "articles"], ["data", "payload", "response"]


def collection(value):
    """(items, recognized) as a search in depth finds them."""
    if isinstance(value, list):
        return value, True
    if not isinstance(value, dict):
        return [], False
    for key in LISTS:
        if isinstance(value.get(key), list):
            return value[key], True
    if isinstance(value.get("edges"), list):
        return [e["node"] if isinstance(e, dict) and "node" in e else e for e in value["edges"]], True
    for inner in [*(value.get(w) for w in WRAPPERS), *value.values()]:
        found = collection(inner)
        if found[1]:
            return found
    return [], False


def made(r, depth):
    if depth == 0 or r.random() < 0.2:
        return r.choice([1, None, "text", '{"items":[]}', True, [], [{"title": f"t{r.randrange(99)}", "url": "https://x.org"}], [{"node": {"title": "n", "url": "https://n.org"}}, 4]])
    names = r.sample(["zz", "b", "a", "data", "response", "payload", "edges", "items", "posts", "k'q", "d.t"], r.randint(0, 4))
    return {n: made(r, depth - 1) for n in names}


def test_lists_at_any_depth(spark):
    r = random.Random(4)
    values = [made(r, r.randint(1, 6)) for _ in range(150)]
    got = {}
    for row in parse.api_parsed(spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "source_id int, json string")).collect():
        got.setdefault(row.source_id, []).append((row.no, row.title, row.skipped, row.error))
    for i, v in enumerate(values):
        items, recognized = collection(v)
        want = [(n, x["title"], None, None) if isinstance(x, dict) and "title" in x else (n, None, "no_title_or_link" if isinstance(x, dict) else "not_an_object", None) for n, x in enumerate(items, 1)]
        if not recognized:
            want = [(None, None, None, "unrecognized")]
        elif items and not any(w[1] for w in want):
            want.append((None, None, None, "no_items"))
        assert sorted(got.get(i, []), key=repr) == sorted(want, key=repr), (v, got.get(i))


def test_bodies_links_and_broken_payloads(spark):
    rows = [(1, '{"x":{"y":[{"name":" <i>A</i> &amp; B ","href":"../z","summary":"s"}]}}', "https://h.org/a/b/"), (2, "{bad", None), (3, None, None), (4, "[]", None), (5, '[{"title":"t","url":"javascript:x"}]', "https://h.org")]
    got = sorted((tuple(r) for r in parse.api_parsed(spark.createDataFrame(rows, "source_id int, json string, base string")).collect()), key=repr)
    assert (1, 1, "A & B", "https://h.org/a/z", "s", "summary", None, None, None) in got
    assert {(r[0], r[8]) for r in got if r[8]} == {(2, "invalid_json"), (3, "invalid_json"), (5, "no_items")} and not [r for r in got if r[0] == 4]


def test_metadata_of_pages(spark):
    html = """<title> </title><meta name='og:title' content="O"><link rel=canonical href="no"><link href='https://c/1' rel="canonical"><link rel="canonical" href='https://c/2'>
    <script type="application/ld+json">{"@graph":{"@graph":[{"datePublished":5},{"dateCreated":"c1"}]},"dateModified":"m"}</script><script type='application/ld+json'>nope</script><script type='application/ld+json'>[[{"datePublished":"p2","headline":"h"}]]</script>"""
    got = {r.page_id: r for r in parse.page_metadata(spark.createDataFrame([(1, html), (2, None), (3, "<p>")], "page_id int, html string")).collect()}
    assert tuple(got[1])[1:] == ("O", "https://c/2", "", "", "c1", "m")
    assert set(tuple(got[2])[1:]) == set(tuple(got[3])[1:]) == {""}
