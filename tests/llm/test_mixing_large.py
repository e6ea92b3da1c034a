"""Operator 11 on sums of words beyond 32 bits, which a few made-up rows of many words reach."""

import pytest

from tidemill.llm import mixing


def rows_of(spark, source_size, documents=1):
    """Measured rows of three sources, source_size words in each, in documents of one size."""
    each = source_size // documents
    rows = [(s * 1000 + i, f"={name}", each, 1000, (s * documents + i) * 7_654_321_987 % (1 << 52)) for s, name in enumerate("abc") for i in range(documents)]
    return spark.createDataFrame(rows, "doc_id long, `~key` string, `~size` long, `~weight` long, `~draw` long")


# 5 times all words passes 2 ** 31 from 429,496,730 words on; from 2 ** 31 on all words do
@pytest.mark.parametrize("source_size", [143_165_576, 143_165_577, 600_000_000, 715_827_882, 715_827_883, 5_000_000_000])
def test_targets_of_any_number_of_words(spark, source_size):
    got = {r["~key"]: r.target for r in mixing.targets(rows_of(spark, source_size)).collect()}
    assert got == {"=a": 3 * source_size * 5 / 8, "=b": 3 * source_size * 2 / 8, "=c": 3 * source_size / 8}


def test_taken_words_come_near_targets_of_many_words(spark):
    rows = rows_of(spark, 600_000_000, 100)
    got = mixing.copied(rows, mixing.limits(rows)).collect()
    assert len(got) == 300
    for key, target in (("=a", 1_125_000_000), ("=b", 450_000_000), ("=c", 225_000_000)):
        of = [r for r in got if r["~key"] == key]
        assert all(0 <= r["~copies"] <= 3 and r.target == target for r in of)
        assert abs(sum(r["~size"] * r["~copies"] for r in of) - target) <= 3_000_000
