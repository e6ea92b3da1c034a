"""Operator 13 against a trie of dictionaries."""

import hashlib
import random
import zlib

import pytest

from tidemill.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, depth int, prefix string"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(x, key=lambda x: (x[0], x[1], x[2]))] for c, x in own.items()}
    built = {c: tuple(turns.get(c - c % 20, [])[: (h := zlib.crc32(str(c).encode()) % 4)] + x[h:]) for c, x in turns.items()}
    members = {}
    for c, x in built.items():
        for d in range(len(x) + 1):
            members.setdefault(x[:d], []).append(c)
    out = []
    for p, cs in members.items():
        inside = [q for q in members if q[: len(p)] == p]
        leaf = lambda q: not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in members)
        ends = ",".join(str(c) for c in sorted(cs) if built[c] == p)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].split(" ") if q[-1][1] else []) for q in inside if q)
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), sum(len(q) == len(p) + 1 for q in inside), sum(map(leaf, inside)), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def run(spark, rows, **more):
    got = prefix_trie.nodes(spark.createDataFrame([(*r, 5, "x") for r in rows], SCHEMA), **more)
    return sorted((tuple(r) for r in got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved", "ends").collect()), key=repr)


def made(seed, n):
    r = random.Random(seed)
    return [(c, t, ["user", "assistant"][t % 2], " ".join(r.choice("ab") for _ in range(r.randint(0, 2)))) for c in range(n) for t in range(r.choice([1, 1, 2, 3, 5, 30]))]


@pytest.mark.parametrize(("limit", "size"), [(8192, 16_384), (3, 5), (0, 1), (40, 20)])
def test_equals_dictionaries(spark, limit, size):
    rows = made(limit, 120)
    assert run(spark, rows, limit=limit, size=size) == brute(rows)


def test_long_shared_chain(spark):
    rows = [(c, t, "user", f"t{t}") for c in range(0, 60, 20) for t in range(60 + c)] + [(40, 200, "user", "own")]
    assert run(spark, rows, limit=4, size=16) == brute(rows)


def test_nulls_repeated_rows_turnless_and_empty(spark):
    rows = [(None, 1, "user", "a"), (0, None, None, None), (0, None, None, None), (0, 2, "user", "b c"), (1, 0, "user", "x"), (2, 0, "u", "ser"), (2, 1, "us", "er"), (41, 5, None, "only"), (43, 1, "user", None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    assert run(spark, [(None, 1, "user", "a")]) == []
    lone = next(c for c in range(101, 120) if zlib.crc32(str(c).encode()) % 4)
    assert run(spark, [(lone, 0, "user", "gone")]) == brute([(lone, 0, "user", "gone")])  # nothing is left of it but the root


def test_ids_in_several_parts(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "LISTED", 3)
    rows = [(c, 9, "user", "same") for c in range(200)] + [(c, t, "user", "same") for c in (0, 20, 40) for t in range(4)]
    assert run(spark, rows) == brute(rows)


def test_double_array_holds_every_sequence_and_no_other():
    r = random.Random(3)
    every = {tuple(r.randrange(40) for _ in range(r.randint(0, 6))) for _ in range(500)}
    trie = prefix_trie.DoubleArray([list(s) for s in every])
    slots = {}
    for s in every:
        walked = list(trie.walk(list(s)))
        assert len(walked) == len(s)
        for d, slot in enumerate(walked, 1):
            assert slots.setdefault(slot, s[:d]) == s[:d]
    assert len(slots) == len({s[:d] for s in every for d in range(1, len(s) + 1)}) == sum(c >= 0 for c in trie.check) - 1
    assert all(len(list(trie.walk(list(s)))) < 7 for s in ([41], [0] * 7))
