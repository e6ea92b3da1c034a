"""Event clusters against a sequential version, with known clusters, by one task and by rounds."""

import hashlib
import random

import pytest

from tidemill.operators import clusters

SCHEMA = "article_id long, title string, url string, cluster_id string, is_new boolean"
FOUND = "article_id long, ord struct<new: boolean, article_id: long>, cluster_id string"


def sequential(records, pairs):
    """records (id, known cluster or None) in order; pairs {(a, b): score}. Groups are lists of ids in order of joining."""
    score = lambda a, b: pairs.get((a, b), pairs.get((b, a)))
    groups = []
    for r, c in records:
        if c is not None:
            for g in groups:
                if g["c"] == c:
                    g["m"].append(r)
                    break
            else:
                groups.append({"c": c, "m": [r]})
    for r, c in records:
        if c is None:
            best, top = None, -1
            for g in groups:
                got = [score(r, m) for m in g["m"]]
                if None not in got and round(sum(got) / len(got), 9) > top:
                    best, top = g, round(sum(got) / len(got), 9)
            if best is None:
                groups.append({"c": None, "m": [r]})
            else:
                best["m"].append(r)
    return sorted((tuple(sorted(g["m"])), g["c"]) for g in groups if g["c"] is not None or len(g["m"]) > 1)


@pytest.mark.parametrize(("seed", "part"), [(1, clusters.PART), (2, 0), (3, 10)])
def test_groups_equal_the_sequential_rule(spark, seed, part):
    r = random.Random(seed)
    n = 45
    records = sorted(((i, f"k{r.randrange(6)}" if i % 4 == 0 else None, i % 4 == 3) for i in range(n)), key=lambda x: (x[2], x[0]))
    pairs = {}
    for _ in range(220):
        a, b = sorted(r.sample(range(n), 2))
        pairs[b, a] = r.choice([0.3, 0.5, 0.7, 0.9])
    found = spark.createDataFrame([(i, (new, i), c) for i, c, new in records], FOUND)
    scored = spark.createDataFrame([(*k, s) for k, s in pairs.items()], "later long, earlier long, score double")
    groups = {}
    for row in clusters.assigned(found, scored, part=part).collect():
        groups.setdefault((row.first, row.cluster_id), []).append(row.article_id)
    assert sorted((tuple(sorted(m)), c) for (_, c), m in groups.items()) == sequential([(i, c) for i, c, _ in records], pairs)


def test_equal_titles_need_few_rounds(spark):
    """Of a hot title the first fifty meet all; the fifty-first joins them, and the rest are alone at once."""
    found = spark.createDataFrame([(i, (True, i), None) for i in range(120)], FOUND)
    scored = spark.createDataFrame([(i, j, 0.9) for i in range(120) for j in range(min(i, 5))], "later long, earlier long, score double")
    got = sorted(r.article_id for r in clusters.assigned(found, scored, part=0).collect())
    assert got == [0, 1, 2, 3, 4, 5]


def test_features_of_titles(spark):
    rows = [(1, "OpenAI  GPT 5.2.1 Launch ＡＢＣ 2025-03-01: 12.5% x 300m users", "https://A.example/p//?q=1", "c", False), (2, "谷歌发布新产品カナ 3亿 2025年3月", "nothing", None, True), (3, None, None, "c", None), (4, "ab1" + ".1" * 400_000, None, None, True)]
    got = {r.article_id: r for r in clusters.features(spark.createDataFrame(rows, SCHEMA)).collect()}
    one, two, three = got[1], got[2], got[3]
    assert one.title_key == "openai gpt 5.2.1 launch abc 2025-03-01: 12.5% x 300m users" and one.cluster_id == "c"
    assert (one.models, one.entities, one.dates, one.numbers) == (["gpt-5.2.1"], ["openai"], ["2025-03-01"], ["300m"])
    assert set(one.terms) == {"openai", "gpt", "abc", "users", "gpt-5.2.1"}
    assert one["keys"] == ["url:a.example/p", f"title:{one.title_key}", "model:gpt-5.2.1", "entity:openai", "number:300m", "gpt-5.2.1", "openai", "users"]
    assert (two.entities, two.dates, two.numbers) == (["google"], ["2025年3月"], ["3亿"]) and "カナ" in two.terms and "发布" not in two.terms and "布新产" in two.anchors
    assert three.title_key == "" and three.terms == [] and three["keys"] == [] and three.cluster_id is None


def test_clusters_are_named_by_what_all_share(spark):
    rows = [(1, "Mistral Large two beats benchmark numbers", None, None, True), (2, "Mistral Large two beats benchmark scores", None, None, True), (3, "gpt-5 arrives with longer context windows", None, None, False), (4, "gpt-5 arrives with longer context memory", None, "old", False), (5, "nothing alike", None, None, True), (6, "gone cluster", None, "lone", False)]
    got = {r.article_id: (r.cluster_id, r.is_known) for r in clusters.planned(spark.createDataFrame(rows, SCHEMA)).collect()}
    name = "evt_" + hashlib.sha256("cluster-v2:beats|benchmark|large|mistral".encode()).hexdigest()[:24]
    assert got == {1: (name, False), 2: (name, False), 3: ("old", True), 4: ("old", True), 6: ("lone", True)}
    assert clusters.planned(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("seed", "step"), [(4, 1), (5, 7), (6, 1000)])
def test_rounds_of_any_step_equal_the_sequential_rule(spark, seed, step):
    r = random.Random(seed)
    n = 30
    records = sorted(((i, f"k{r.randrange(4)}" if i % 6 == 0 else None, i % 6 != 0) for i in range(n)), key=lambda x: (x[2], x[0]))
    rank = {i: k for k, (i, _, _) in enumerate(records)}
    pairs = {tuple(sorted(r.sample(range(n), 2), key=lambda x: -rank[x])): r.choice([0.3, 0.5, 0.7]) for _ in range(150)}
    found = spark.createDataFrame([(i, (new, i), c) for i, c, new in records], FOUND)
    scored = spark.createDataFrame([(*k, s) for k, s in pairs.items()], "later long, earlier long, score double")
    groups = {}
    for row in clusters.assigned(found, scored, part=0, step=step).collect():
        groups.setdefault((row.first, row.cluster_id), []).append(row.article_id)
    assert sorted((tuple(sorted(m)), c) for (_, c), m in groups.items()) == sequential([(i, c) for i, c, _ in records], pairs)


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """Records of which each is scored with the one before: a round for each of them before, one for all now."""
    n, rounds = 400, []
    plain = clusters.written
    monkeypatch.setattr(clusters, "written", lambda df, name: (rounds.append(name), plain(df, name))[1])
    found = spark.createDataFrame([(i, (True, i), None) for i in range(n)], FOUND)
    scored = spark.createDataFrame([(i, i - 1, 0.9) for i in range(1, n)], "later long, earlier long, score double")
    got = {r.article_id: r.first for r in clusters.assigned(found, scored, part=0).collect()}
    assert got == {i: i - i % 2 for i in range(n)} and rounds.count("open") <= 3


def test_candidates_are_lists_and_pairs_are_not_sorted(spark):
    """A record and a key made a row for each pair, and pairs carried both records' words through sorts; the first of equal keys and the limits are as before."""
    r = random.Random(9)
    keys = {i: r.sample("abcdefg", r.randrange(1, 5)) for i in range(60)}
    order = sorted((i % 3 > 0, i) for i in keys)
    want = set()
    for place, (new, i) in enumerate(order):
        met = {}
        for at, key in enumerate(keys[i]):
            for n, j in [(n, j) for n, (_, j) in enumerate(order) if key in keys[j]][:6]:
                if n < place:
                    met[j] = min(met.get(j, (at, n)), (at, n))
        want |= {(i, j) for j in sorted(met, key=met.get)[:8]}
    found = spark.createDataFrame([(i, (i % 3 > 0, i), k) for i, k in keys.items()], "article_id long, ord struct<new: boolean, article_id: long>, keys array<string>")
    got = clusters.candidates(found, 6, 8)
    assert {tuple(x) for x in got.collect()} == want and got.count() == len(want)
    rows = [(1, "openai gpt-5 alpha bravo 2025-01", None, None, True), (2, "OpenAI gpt-5 alpha delta", None, None, True), (3, "meta gpt-5 alpha bravo", None, None, True), (4, "alpha bravo charlie delta", None, None, True), (5, "alpha bravo charlie delta 2025-01", None, None, True), (6, "alpha zulu", None, None, True), (7, "gpt-5 alpha 2025-02", None, None, True)]
    found = clusters.features(spark.createDataFrame(rows, SCHEMA))
    out = clusters.pair_scores(found, clusters.candidates(found))
    scores = {(x.later, x.earlier): round(x.score, 6) for x in out.collect()}
    assert scores == {(2, 1): 0.632, (5, 4): 1.0, (7, 2): 0.5, (7, 3): 0.5}  # 3 of 5 terms and 5 of 7 anchors; all; half of both
    plan = out._jdf.queryExecution().executedPlan().toString()
    pairs = clusters.pair_scores(found, spark.createDataFrame([], "later long, earlier long"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in pairs and "SortMergeJoin" not in pairs and "b.ord" not in plan
