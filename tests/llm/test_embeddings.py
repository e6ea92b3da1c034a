"""Operator 9 against brute force, and its edge cases."""

import math
import os

import numpy as np

from tidemill.llm import embeddings
from tidemill.llm.queries import op9_embeddings


def brute(rows):
    """rows: (vec_id, vector, label) -> {vec_id: (n_links, component_id)}"""
    good = [(i, np.array(v, float), g) for i, v, g in rows if v is not None and g is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    up, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, (i, v, g) in enumerate(good):
        for j, w, h in good[:k]:
            if g == h and len(v) == len(w) and v @ w / math.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root(i), root(j)))
                up[b] = a
    return {i: (links[i], root(i)) for i, _, _ in rows}


def test_whole_table_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert {r.vec_id: (r.n_links, r.component_id) for r in op9_embeddings(spark, "/root/testdata/sf0.01").collect()} == brute(rows)
    if not os.path.isdir("/root/testdata/check_s"):
        return
    some = spark.read.parquet("/root/testdata/check_s/embeddings.parquet").where("label = 1")
    want = brute([(r.vec_id, r.embedding, r.label) for r in some.collect()])
    assert any(n for n, _ in want.values())
    assert {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(some).collect()} == want


def test_blocks_copies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK", 8)
    r = np.random.default_rng(3)
    base = r.standard_normal(16)
    rows = [(i, [float(x) for x in base + 0.05 * r.standard_normal(16)], 1) for i in range(60)]
    rows += [(100 + i, [1.0] * 16, 1) for i in range(20)] + [(200, [2.0] * 16, 1), (201, [1.0] * 16, 2), (202, [1.0] * 4, 1)]
    rows += [(300, None, 1), (301, [0.0] * 16, 1), (302, [1.0, None], 1), (303, [float("nan")] * 16, 1), (304, [float("inf")] * 16, 1), (305, [1.0] * 16, None), (306, [], 1)]
    rows += [(310, [1e300] * 16, 2), (311, [1e-300] * 16, 2)]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "vec_id long, embedding array<double>, label int, vector string, n int")
    got = {x.vec_id: (x.n_links, x.component_id, x.kept) for x in embeddings.near_duplicates(df).collect()}
    scaled = [(i, [x / 1e300 for x in v] if i == 310 else [x / 1e-300 for x in v] if i == 311 else v, g) for i, v, g in rows]
    assert got == {i: (n, c, i == c) for i, (n, c) in brute(scaled).items()}
    twice = embeddings.near_duplicates(df.where("vec_id = 0").union(df.where("vec_id = 0"))).collect()
    assert [tuple(x) for x in twice] == [(0, 1, 0, True)] * 2
    assert embeddings.near_duplicates(df.limit(0)).count() == 0


def test_ids_that_repeat_keep_their_labels_apart(spark):
    near = [1.0, 0.01, 0.0]
    rows = [(5, [1.0, 0.0, 0.0], 1), (5, [1.0, 0.0, 0.0], 2), (6, near, 1), (7, near, 2), (None, [0.0, 1.0, 0.0], 3), (None, [0.01, 1.0, 0.0], 3)]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in got), key=repr) == sorted([(5, 1, 5), (5, 1, 5), (6, 1, 5), (7, 1, 5), (None, 1, None), (None, 1, None)], key=repr)
