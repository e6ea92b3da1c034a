"""Links of a large group of near copies: their number follows the group's size, and no link is written several times."""

import random

from pyspark.sql import functions as F

from tidemill.llm import common, passages


def group(spark, n):
    """A centre, half of n units that are like it and half that are not, but are like all others: of one cluster, with four bands each."""
    r = random.Random(5)
    ids = r.sample(range(10**6), n)
    centre = list(range(100, 140))
    sets = [(ids[0], ids[0], centre)]
    for k, unit in enumerate(ids[1:]):
        own = [1, 2, 3, *centre[3:]] if k % 2 else [1, 2, 3, 4, 5, *centre[5:]]
        own[39 - r.randrange(20)] = 10**6 + k
        sets.append((unit, ids[0], sorted(own)))
    members = spark.createDataFrame([(u, b) for u in ids for b in range(4)], "unit long, band long")
    return min(ids), members, spark.createDataFrame(sets, "unit long, cluster long, shingles array<long>")


def test_links_of_a_group_grow_with_its_size(spark):
    found = []
    for n in (120, 240):
        low, members, sets = group(spark, n)
        links = passages.links(members, sets, 0.8, 8, 64).localCheckpoint()
        components = common.connected_components(links)
        assert components.count() == n and [r.component for r in components.select("component").distinct().collect()] == [low]
        found.append(links.select(F.least("a", "b"), F.greatest("a", "b")).distinct().count())
    assert found[1] < 2.6 * found[0] and found[1] < 2 * 240, found


def test_repeated_links_are_opened_once(spark, monkeypatch):
    """Every repetition of a link was exploded into four rows before equal ones were dropped."""
    plans, plain = {}, common.stored
    monkeypatch.setattr(common, "stored", lambda df, name="table", *a: (plans.update({name: df._jdf.queryExecution().optimizedPlan().toString()}), plain(df, name, *a))[1])
    edges = spark.range(4000).select((F.col("id") % 20).alias("a"), F.when(F.col("id") % 3 == 0, 20).otherwise(21).alias("b"))
    got = {r.id: r.component for r in common.connected_components(edges.union(edges.select("b", "a"))).collect()}
    assert got == dict.fromkeys(range(22), 0)
    assert plans["edges"].index("Generate") < plans["edges"].index("Aggregate")  # plans are printed from the last step down
