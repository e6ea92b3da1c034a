"""Operator 11: targets, nearness, inclusion, and its greedy end against a sequential version."""

import pytest
from pyspark.sql import functions as F

from tidemill.llm import mixing

SCHEMA = "doc_id long, text string, source string, size int, copies string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, 7, "x") for i, t, s in rows], SCHEMA)


def words(n):
    return " ".join(["w"] * n)


def test_targets_stop_at_three_times_and_are_shared_again(spark):
    d = docs(spark, [(1, words(100), "b"), (2, words(10), "a"), (3, words(50), "c"), (4, words(40), None)])
    got = {r.size: r.target for r in mixing.allotted(d).collect()}
    # a, b, c, null weigh 5, 2, 1, 5; 200 words: a would get 76.9 and null 76.9, a stops at 30, the rest share 170 by 2, 1, 5
    assert got[10] == 30.0
    assert got[100] == pytest.approx(42.5) and got[50] == pytest.approx(21.25) and got[40] == pytest.approx(106.25)


def test_taken_words_come_near_and_reruns_agree(spark):
    d = docs(spark, [(i, words(1 + i * 7 % 90), f"s{i % 5}") for i in range(2000)])
    runs = [sorted(map(tuple, mixing.allotted(x).collect())) for x in (d, d.repartition(7))]
    assert runs[0] == runs[1]
    by = {}
    for _, size, source_size, target, copies in runs[0]:
        assert 0 <= copies <= 3
        by.setdefault((source_size, target), []).append(size * copies)
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 45


def test_cutting_ranges_changes_nothing(spark, monkeypatch):
    d = docs(spark, [(i, words(1 + i * 7 % 90), f"s{i % 2}") for i in range(900)])
    monkeypatch.setattr(mixing, "TRIED", 8)
    whole = sorted(map(tuple, mixing.allotted(d).collect()))
    monkeypatch.setattr(mixing, "ROWS", 40)
    monkeypatch.setattr(mixing, "DIGITS", 16)
    assert sorted(map(tuple, mixing.allotted(d).collect())) == whole


def test_weights_decide_inclusion(spark):
    """Over many documents each weight's share of copies is what its expected copies say."""
    d = docs(spark, [(i, words(10), "a" if i < 6000 else "b") for i in range(12_000)])
    got = mixing.allotted(d, weights=(1, 3), weight=F.when(F.col("doc_id") % 3 == 0, 1).otherwise(2)).withColumn("heavy", F.col("doc_id") % 3 != 0)
    # a: 30,000 of 60,000 words: c * (1/3 + 4/3) = 0.5, so 0.3 and 0.6 copies; b: 1.5 copies on average: 0.9 and 1.8
    mean = {(r.target, r.heavy): r.m for r in got.groupBy("target", "heavy").agg(F.avg("copies").alias("m")).collect()}
    assert mean == pytest.approx({(30_000.0, False): 0.3, (30_000.0, True): 0.6, (90_000.0, False): 0.9, (90_000.0, True): 1.8}, abs=0.03)


def test_nulls_empty_texts_and_repeated_rows(spark):
    rows = [(None, None, None), (None, "a b", None), (1, "", "s"), (1, " \t", "s"), (2, "a b c", "s"), (2, "a b c", "s"), (3, "x", "t")]
    got = mixing.allotted(docs(spark, rows))
    assert got.columns == ["doc_id", "size", "source_size", "target", "copies"]
    kept = [tuple(r) for r in got.collect()]
    assert len(kept) == 7 and all(c == 0 for _, n, _, _, c in kept if n == 0)
    twice = [c for i, n, _, _, c in kept if i == 2]
    assert len(twice) == 2 and twice[0] == twice[1]
    assert mixing.allotted(docs(spark, rows).limit(0)).count() == 0
    assert mixing.allotted(docs(spark, [(1, None, "s")])).collect()[0].target == 0.0


def test_mix_repeats_whole_rows(spark):
    d = docs(spark, [(i, words(5 + i % 9), f"s{i % 3}") for i in range(200)])
    want = {r.doc_id: r.copies for r in mixing.allotted(d).collect() if r.copies}
    mix = mixing.mixed(d)
    assert mix.columns == d.columns
    assert {r.doc_id: r["count"] for r in mix.groupBy("doc_id").count().collect()} == want
