"""What writes do to tables: inserts, replacements, deletions that follow parents, counters, optional filters. All give new snapshots."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What an article is given where an insert doesn't say it.
SEED = {"trusted": 100, "review": 80}


def inserted(old: DataFrame, new: DataFrame, keys: list[str], as_of: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Rows of new that stand in old by none of the keys, and one row (given, inserted, conflicts).

    Rows of new are distinct by each key beforehand (articles.distinct_items). published_at, if there is one, defaults to as_of.
    """
    fresh = new
    for key in keys:
        fresh = fresh.join(old.select(key).where(F.col(key).isNotNull()).distinct(), key, "left_anti")
    if as_of is not None:
        fresh = fresh.withColumn("published_at", F.coalesce("published_at", as_of))
    given, kept = new.agg(F.count("*").alias("given")), fresh.agg(F.count("*").alias("inserted"))
    return fresh.select(*new.columns), given.crossJoin(kept).withColumn("conflicts", F.col("given") - F.col("inserted"))  # one row each


def rewritten(old: DataFrame, new: DataFrame, owner: str) -> DataFrame:
    """All rows of new's owners are new's; owners that new lacks keep theirs (delete, then insert)."""
    return old.join(new.select(owner).distinct(), owner, "left_anti").unionByName(new)


def surviving(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Children whose parent is still there."""
    return children.join(parents.select(key).distinct(), key, "left_semi")


def united(*ids: DataFrame) -> DataFrame:
    """Distinct ids of several tables of one column."""
    return reduce(DataFrame.union, ids).distinct()


def counters(rows: DataFrame, stage: str, reason: Column) -> DataFrame:
    """(stage, reason, n): how many rows a stage passed (reason ok) and dropped, by reason."""
    return rows.groupBy(F.coalesce(reason, F.lit("ok")).alias("reason")).agg(F.count("*").alias("n")).select(F.lit(stage).alias("stage"), "reason", "n")


def filtered(rows: DataFrame, *, search: str | None = None, directions: list[str] | None = None, status: str | None = None, least_score: int | None = None, since: Column | None = None, until: Column | None = None) -> DataFrame:
    """Rows that meet every predicate that is given; none given keeps all."""
    tests = [
        None if search is None else F.lower("title").contains(search.lower()), None if directions is None else F.col("direction").isin(directions), None if status is None else F.col("status") == status,
        None if least_score is None else F.col("score") >= least_score, None if since is None else F.col("published_at") >= since, None if until is None else F.col("published_at") < until,
    ]
    return rows.where(reduce(and_, [t for t in tests if t is not None], F.lit(True)))
