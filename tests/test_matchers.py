"""Texts read once for each pattern by Arrow's matcher: the same answers as Spark's patterns, on odd texts too."""

from pyspark.sql import functions as F

from tidemill.functions import texts
from tidemill.operators import roles

ODD = ["", None, "New", "renew", "uſers", "users", "12 apples", "12abc", "3.5abc", "7\x0bms", "7 MSx", "can't", "生成式\x0bai", "Ünew", "may", "maybe", "将于x", "open source", "x_api", "api-", "GPT4", "gpt 4", "plans  to", "Plans to", "kimi", "Kimi", "a\nnew\nb"]


def test_matcher_holds_what_patterns_hold(spark):
    plain = {n: rf"(?i)(?<![A-Za-z0-9_])(?:{latin})(?![A-Za-z0-9_])|{others}" for n, (latin, others) in roles.WORDS.items()}
    rows = spark.createDataFrame([(t,) for t in ODD], "t string").select("t", texts.holding(F.col("t"), roles.TOLD).alias("h"), F.struct(*(F.col("t").rlike(p).alias(n) for n, p in plain.items())).alias("want")).collect()
    assert len(rows) == len(ODD) and all(r.h == r.want for r in rows)


def test_first_part_that_holds(spark):
    rows = spark.createDataFrame([(1, ["x", "a new", "new"]), (2, []), (3, ["old"]), (4, ["will", "NEW"])], "i int, p array<string>").coalesce(1)
    got = {r.i: (r.f.novelty, r.f.future) for r in rows.select("i", texts.first_holding(F.col("p"), {n: roles.TOLD[n] for n in ("novelty", "future")}).alias("f")).collect()}
    assert got == {1: (1, None), 2: (None, None), 3: (None, None), 4: (1, 0)}


def test_evaluation_tries_no_pattern_per_excerpt(spark):
    """Eight patterns went over each text and seven more over each excerpt."""
    a = spark.createDataFrame([(1, "t", "A new api!", "u", "s", "low", "lab", None, "candidate", None, 1, True)], "article_id long, title string, content string, url string, source_name string, source_tier string, source_category string, published_at timestamp, decision string, reason_code string, n_signals int, filter_matches boolean")
    plan = roles.evaluated(a)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "revolutionary" not in plan and "methodology" not in plan


def test_first_sentence_is_that_of_all(spark):
    odd = ["", None, "a", " \n!? 　b c。d", "！！", "﻿ x\ny", "no end", "\n\n  "]
    rows = spark.createDataFrame([(t,) for t in odd], "t string").select(texts.first_sentence(F.col("t")).alias("a"), F.get(texts.sentences(F.col("t")), 0).alias("b")).collect()
    assert all(r.a == r.b for r in rows)


def test_roles_compute_what_they_put_out_once(spark):
    """Each later role copied the expressions of those before it, and each sentence of a text was cut for the first one."""
    first = lambda: F.get(F.split("text", "#"), 0)
    graph = [roles.Role("a", lambda: F.struct(F.length("text").alias("value"), first().alias("quote"))), roles.Role("b", lambda: F.struct(F.col("a.value").alias("value"), first().alias("quote")), after=("a",)), roles.Role("c", lambda: F.struct(F.col("b.value").alias("value"), first().alias("quote")), after=("b",))]
    out = roles.run_roles(spark.createDataFrame([(1, "t", "x y#z")], "article_id long, title string, text string"), graph).select("a.outcome", "a.key", "b.outcome", "b.key", "c.outcome", "c.key")
    assert [r[4] for r in out.collect()] == ["accepted"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") <= 3
