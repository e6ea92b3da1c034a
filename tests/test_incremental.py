"""Tables kept up to date: only touched parts are written, streams equal batches after restarts, source changes against a sequential version."""

import glob
import random

from pyspark.sql import functions as F

from tidemill.operators import articles as A
from tidemill.operators import sources
from tidemill.plans import tables as T
from tidemill.sources import snapshots
from tidemill.streaming import incremental

SF = "/root/testdata/sf0.001"


def test_only_touched_parts_are_written(spark, tmp_path):
    folder = str(tmp_path / "days")
    rows = lambda *r: spark.createDataFrame(list(r), "day string, id int, text string")
    snapshots.upserted_parts(rows(("d1", 1, "a"), ("d1", 2, "b"), ("d2", 3, "c")), folder, "day", ["id"])
    before = {f for f in glob.glob(f"{folder}/day=*/*.parquet")}
    snapshots.upserted_parts(rows(("d1", 2, "B"), ("d3", 4, "d")), folder, "day", ["id"])
    after = {f for f in glob.glob(f"{folder}/day=*/*.parquet")}
    assert {f for f in before if "day=d2" in f} == {f for f in after if "day=d2" in f}
    assert not {f for f in before if "day=d1" in f} & after
    assert sorted(tuple(r) for r in spark.read.parquet(folder).select("day", "id", "text").collect()) == [("d1", 1, "a"), ("d1", 2, "B"), ("d2", 3, "c"), ("d3", 4, "d")]


def test_items_of_streams_equal_batches(spark, tmp_path):
    items = T.items(spark, SF).withColumn("part", F.col("item_id") % 3)
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    seen = None
    for n in range(3):
        items.where(F.col("part") == n).coalesce(1).write.mode("append").parquet(landing)
        incremental.deduplicated(spark.readStream.schema(items.schema).parquet(landing), out, str(tmp_path / "check"))  # a new query each time: a restart
        won = A.batch_winners(A.normalized(items.where(F.col("part") == n)).where("drop_reason IS NULL"))
        seen = won if seen is None else seen.unionByName(A.fresh(won, seen))
    key = lambda df: sorted(r.item_id for r in df.select("item_id").collect())
    assert key(spark.read.parquet(out)) == key(seen)
    assert spark.read.parquet(out).select("batch").distinct().count() == 3


def test_health_of_streams_equals_the_batch(spark, tmp_path):
    attempts = T.attempts(spark, SF)
    landing, out = str(tmp_path / "in"), str(tmp_path / "out")
    cuts = [0, *(int(x) for x in attempts.select(F.percentile_approx("attempt_id", [0.3, 0.7])).first()[0]), 10**12]
    ordered = attempts.withColumn("at", F.timestamp_seconds(F.col("attempt_id")))
    for low, high in zip(cuts, cuts[1:], strict=False):
        ordered.where((F.col("attempt_id") > low) & (F.col("attempt_id") <= high) | (F.lit(low == 0) & (F.col("attempt_id") == 0))).coalesce(1).write.mode("append").parquet(landing)
        incremental.health(spark.readStream.schema(ordered.schema).parquet(landing), out, str(tmp_path / "check"))
    columns = ["source_name", "fetches", "successes", "consecutive_failures", "success_rate", "cooldown_seconds"]
    rows = lambda df: sorted((tuple(r) for r in df.select(columns).collect()), key=repr)
    assert rows(spark.read.parquet(out)) == rows(A.health(ordered))


def test_source_changes_equal_a_sequential_fold(spark):
    r = random.Random(7)
    base = {f"s{k}": {"name": f"old{k}", "tier": "t", "enabled": k % 2 == 0, "next_fetch_at": "later"} for k in range(6)}
    feed = [(r.choice([*base, "s6", "s7", None]), n, r.choice(["create", "patch", "patch", "toggle", "delete", "odd"]), r.choice([None, f"n{n}"]), r.choice([None, f"t{n}"]), r.choice([True, False, None])) for n in range(120)]
    state, told = {k: dict(v) for k, v in base.items()}, {}
    for key, _, op, name, tier, enabled in feed:
        there = key in state
        outcome = "not_found" if key is None else "unknown_op" if op == "odd" else "conflict" if op == "create" and there else "applied" if there or op == "create" else "not_found"
        told[outcome, op] = told.get((outcome, op), 0) + 1
        if outcome != "applied":
            continue
        if op == "create":
            state[key] = {"name": name, "tier": tier, "enabled": True if enabled is None else enabled, "next_fetch_at": None}
        elif op == "delete":
            del state[key]
        elif op == "toggle":
            if enabled is not None:
                state[key] |= {"enabled": enabled} | ({"next_fetch_at": None} if enabled else {})
        else:
            state[key] |= {k: v for k, v in (("name", name), ("tier", tier)) if v is not None}
    old = spark.createDataFrame([(k, *v.values()) for k, v in base.items()], "id string, name string, tier string, enabled boolean, next_fetch_at string")
    changes = spark.createDataFrame(feed, "id string, seq int, op string, name string, tier string, enabled boolean")
    after, outcomes = sources.changed(old, changes, "id", ["name", "tier"])
    assert {x["id"]: {c: x[c] for c in ("name", "tier", "enabled", "next_fetch_at")} for x in after.collect()} == state
    assert {(x.outcome, x.op): x.n for x in outcomes.collect()} == told
