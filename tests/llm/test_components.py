"""Connected components of edges whose ends come in any order, with labels that fit and that don't; how much of op6 is shuffled."""

import random

import pytest
from pyspark.sql import functions as F

from tidemill.llm import common, passages


@pytest.mark.parametrize("rows", [400_000, 0])
def test_edges_that_turn_round_when_computed_again_lose_nothing(spark, monkeypatch, rows):
    def turned(frames):
        r = random.Random()
        for f in frames:
            turn = [r.random() < 0.5 for _ in range(len(f))]
            yield f.assign(a=f.a.where(turn, f.b), b=f.b.where(turn, f.a))

    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    pairs = spark.range(300).select((F.col("id") * 2).alias("a"), (F.col("id") * 2 + 1).alias("b"))
    got = {r.id: r.component for r in common.connected_components(pairs.mapInPandas(turned, "a long, b long")).collect()}
    assert got == {n: n - n % 2 for n in range(600)}


@pytest.mark.parametrize("rows", [400_000, 0])
def test_components_equal_those_of_a_union_find(spark, monkeypatch, rows):
    monkeypatch.setattr(common, "BROADCAST_ROWS", rows)
    r = random.Random(3)
    edges = [(r.randrange(400), r.randrange(400)) for _ in range(230)] + [(n, n + 1) for n in range(500, 560)] + [(7, 7)]
    part = {n: n for e in edges if e[0] != e[1] for n in e}

    def top(n):
        while part[n] != n:
            n = part[n]
        return n

    for a, b in edges:
        if a != b:
            low, high = sorted((top(a), top(b)))
            part[high] = low
    got = {x.id: x.component for x in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: top(n) for n in part}


def test_small_tables_of_passages_are_not_shuffled(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    words = [f"w{i}" for i in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words[: 30 + i], f"x{i}"])) for i in range(12)], "doc_id long, text string")
    context = spark.sparkContext
    try:
        for k, v in zip(held, ("13", "false", "-1"), strict=True):
            spark.conf.set(k, v)
        context.setJobGroup("shuffled", "")
        assert passages.removals(docs).count() == 12
        tracker = context.statusTracker()
        ran = {s: tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("shuffled") for s in tracker.getJobInfo(j).stageIds}
        assert (n := sum(s is not None and s.numTasks == 13 and s.numCompletedTasks == 13 for s in ran.values())) <= 35, n
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in held.items():
            spark.conf.set(k, v)
