"""Operator 12 against scores of all documents, sketches and bounds included."""

import math
import random
import re

import numpy as np

from tidemill.llm import ranked

WORD = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(documents, queries, k=10):
    cut = [(i, t) for i, text in documents if (t := terms(text))]
    n, total = len(cut), sum(len(t) for _, t in cut)
    df = {}
    for _, t in cut:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in queries:
        scores = []
        for i, t in cut:
            m = 10 + 90 * len(t) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * t.count(w) // (1000 * t.count(w) + 8 * m)) for w in set(terms(text)) if w in t)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def made(seed, n):
    r = random.Random(seed)
    vocabulary = [f"w{int(r.paretovariate(0.6))}" for _ in range(400)] + ["Ünïcode", "漢字", "x" * 400]
    return [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([1, 5, 30, 300])))) for i in range(n)]


def run(spark, documents, queries, **more):
    d = spark.createDataFrame([(i, t, 1, "s") for i, t in documents], "doc_id long, text string, score int, item_id string")
    q = spark.createDataFrame([(i, t, 2) for i, t in queries], "item_id long, text string, rank int")
    got = ranked.ranked(d, q, **more)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=repr)


def test_equals_scores_of_all_documents(spark):
    documents = [*made(1, 400), (900, "A b. c, A-b_c"), (901, "a B c a b c")]
    queries = [(i, t) for i, t in made(2, 30)] + [(77, "a b c"), (78, "nowhere at all")]
    assert run(spark, documents, queries) == brute(documents, queries)


def test_blocks_of_queries_and_small_batches_change_nothing(spark, monkeypatch):
    documents, queries = made(3, 300), made(4, 20)
    monkeypatch.setattr(ranked, "QUERIES", 3)
    monkeypatch.setattr(ranked, "ROWS", 7)
    monkeypatch.setattr(ranked, "STEP", 2)
    monkeypatch.setattr(ranked, "BYTES", 100)
    assert run(spark, documents, queries, k=3) == brute(documents, queries, 3)


def test_ties_nulls_repeated_rows_and_empty_tables(spark):
    documents = [(i, "same words here") for i in range(40, 0, -1)] + [(None, "same words here"), (5, None), (6, ""), (7, "!?"), (3, "same words here"), (50, "other " * 1000), (51, "more")]
    queries = [(1, "same"), (1, "same"), (2, None), (3, "..."), (None, "other same")]
    got = run(spark, documents, queries)
    assert got == brute(documents, queries)
    assert [r[2] for r in got if r[0] == 1][:2] == [1, 1]  # two queries of one id, equal scores by doc_id
    assert run(spark, documents, []) == [] and run(spark, [], queries) == [] and run(spark, [(1, None)], queries) == []


def test_counts_beyond_a_sketch(spark):
    documents = [(i, "deep " * (200 + 40 * i) + "filler " * i) for i in range(12)] + [(99, "filler")]
    assert run(spark, documents, [(1, "deep"), (2, "filler deep")], k=4) == brute(documents, [(1, "deep"), (2, "filler deep")], 4)


def test_bounds_hold():
    r = np.random.default_rng(5)
    block = ranked.Block([(q, int(t), int(r.integers(1, 9000))) for q in range(8) for t in r.choice(500, 20, replace=False) * 7919])
    for _ in range(50):
        held = np.unique(r.choice(500, r.integers(1, 120)) * 7919)
        counts, long = r.integers(1, 400, len(held)), np.array([8 * int(r.integers(10, 5000))])
        upper = ranked.bounds(block, [ranked.sketch(held, counts)], long)
        exact = ranked.impacts(block, np.array([0, len(held)]), held, counts, long) @ block.weights
        assert (upper >= exact).all()
