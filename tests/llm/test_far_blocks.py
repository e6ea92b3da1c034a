"""Links within bands: units that are not like their cluster's centre meet all of their bands, in small blocks too."""

import random

import pytest

from tidemill.llm import passages
from tidemill.llm.common import connected_components


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_those_of_all_pairs(spark, seed):
    r = random.Random(seed)
    centres = [set(r.sample(range(10**6), 40)) for _ in range(3)]
    sets = {}
    for n in range(60):
        kept = set(r.sample(sorted(r.choice(centres)), r.choice([40, 39, 36, 34, 25])))
        sets[n] = sorted(kept | set(r.sample(range(10**6, 2 * 10**6), 40 - len(kept))))
    bands = {(n, b) for n in sets for b in range(4) if r.random() < 0.6}
    like = lambda a, b: len(set(sets[a]) & set(sets[b])) >= 0.8 * len(set(sets[a]) | set(sets[b])) - 1e-9
    pairs = {(a, b) for a, x in bands for b, y in bands if x == y and a < b and like(a, b)}
    members = spark.createDataFrame(sorted(bands), "unit long, band long")
    cluster = {x.unit: x.cluster for x in passages.clustered(members).collect()}
    pairs |= {(min(n, c), max(n, c)) for n, c in cluster.items() if n != c and like(n, c)}
    given = spark.createDataFrame([(n, c, sets[n]) for n, c in cluster.items()], "unit long, cluster long, shingles array<long>")
    got = {x.id: x.component for x in connected_components(passages.links(members, given, 0.8, 3, 4)).collect()}
    part = {n: n for pair in pairs for n in pair}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            least = min(part[a], part[b])
            moved |= part[a] != least or part[b] != least
            part[a] = part[b] = least
    assert got == part and len(part) > 10
