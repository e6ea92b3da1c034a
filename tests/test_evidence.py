"""Evidence by tables of rules: literals, patterns without any, nulls, repeated rows, word edges."""

import pytest
from pyspark.sql import functions as F

from tidemill.operators import scoring

RULES = "direction string, dimension string, kind string, pattern string, literals array<string>"
DOCS = "doc_id long, text string, score int"


def found(spark, texts_, rules):
    docs = spark.createDataFrame([(i, t, 1) for i, t in texts_], DOCS)
    return sorted((r.doc_id, r.dimension, r.score, r.quote) for r in scoring.phrase_evidence(docs, spark.createDataFrame(rules, RULES)).collect())


def test_literals_and_patterns_give_the_same_rows(spark):
    texts_ = [(1, "First line! The NEW Model ships"), (2, "the new\nmodel"), (3, "a newer mOdel; plain 模型上线"), (4, None), (5, "")]
    rule = ("d", "x", "strong", r"(?i)new\w* model")
    want = [(1, "x", 5.0, "The NEW Model ships"), (3, "x", 5.0, "a newer mOdel; plain 模型上线")]
    for literals in (["new"], ["MODEL", "other"], [], None):
        assert found(spark, texts_, [(*rule, literals)]) == want


def test_two_weak_phrases_in_sure_sentences(spark):
    rules = [("d", "x", "weak", w, None) for w in ("alpha", "Beta", "模型", "")]
    texts_ = [(1, "ALPHA beta"), (2, "alpha alpha"), (3, "alpha\nbeta will come"), (4, "alphabeta"), (5, "模型 alpha"), (6, "alpha\n\nbeta"), (6, "alpha"), (None, "alpha beta")]
    got = found(spark, [t for t in texts_ if t[0]], rules)
    assert [g[0] for g in got] == [1, 4, 5, 6] and all(g[2] == 2.5 and g[3] is None for g in got)
    assert found(spark, [(1, "a not beta alpha"), (2, "noñ alpha beta")], rules) == []  # edges of words are ASCII ones
    assert found(spark, [], rules) == []


def test_too_many_rules_are_refused(spark, monkeypatch):
    monkeypatch.setattr(scoring, "RULES_MOST", 2)
    docs = spark.createDataFrame([(1, "x", 1)], DOCS)
    with pytest.raises(ValueError, match="more than 2"):
        scoring.phrase_evidence(docs, spark.range(3).select(F.lit("d").alias("direction"), F.lit("x").alias("dimension"), F.lit("weak").alias("kind"), F.col("id").cast("string").alias("pattern"), F.lit(None).cast("array<string>").alias("literals")))


def test_tokens_meet_the_lexicon_without_a_shuffle_and_once(spark, monkeypatch):
    """Tokens were dealt out by term, twice; now only what a document has for a dimension moves, and a term that is found twice is one weak term."""
    plans, plain = {}, scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), plain(df, name))[1])
    lexicon = spark.createDataFrame([("model", "cost", "strong", "cheap"), ("model", "entity", "weak", "gpt"), ("model", "entity", "weak", "llm")], "direction string, dimension string, kind string, term string")
    docs = spark.createDataFrame([(1, "not cheap! a gpt\nso cheap. yes\ncheap again"), (2, "a gpt! the gpt"), (3, "a gpt! an llm"), (4, None)], "doc_id long, text string")
    got = sorted(tuple(r) for r in scoring.evidence(docs, lexicon, ["not"]).collect())
    assert got == [(1, "model", "cost", 5.0, "so cheap. yes"), (3, "model", "entity", 2.5, None)]
    assert "BroadcastHashJoin" in plans["found"] and "hashpartitioning(term" not in plans["found"]


def test_phrases_move_no_sentence(spark):
    """Sentences were shuffled and sorted by document and dimension; a document is now decided where it stands."""
    docs = spark.createDataFrame([(1, "one alpha\nnew model\nnew model x", 1), (2, "alpha beta", 1)], DOCS)
    rules = spark.createDataFrame([("d", "x", "strong", "new model", ["new"]), ("d", "x", "weak", "alpha", None), ("d", "x", "weak", "beta", None)], RULES)
    out = scoring.phrase_evidence(docs, rules)
    assert sorted(tuple(r) for r in out.collect()) == [(1, "d", "x", 5.0, "new model"), (2, "d", "x", 2.5, None)]
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_scores_alone_read_no_text_again(spark):
    """What asks for scores alone cut and moved every text with evidence once more for quotes that nothing read, and repeated a document's scores for each row that repeats its doc_id."""
    from tidemill.plans.queries import QUERIES

    lexicon = spark.createDataFrame([("model", "cost", "strong", "cheap")], "direction string, dimension string, kind string, term string")
    docs = spark.createDataFrame([(1, "not cheap! so cheap"), (1, "so cheap. yes")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in scoring.evidence_scores(docs, lexicon, ["not"]).collect()] == [(1, "model", "cost", 5.0)]
    for name in ("score_combine", "direction_scores", "classify"):
        assert not [f for f in QUERIES[name](spark, "/root/testdata/sf0.001").inputFiles() if "documents.parquet" in f]


def test_a_task_gathers_numbers_only(spark, monkeypatch):
    """What a task gathers for each document and dimension held both names of the dimension: its memory went with them. Names that are null are names."""
    plans, plain = {}, scoring.written
    monkeypatch.setattr(scoring, "written", lambda df, name: (plans.update({name: df._jdf.queryExecution().executedPlan().toString()}), plain(df, name))[1])
    lexicon = spark.createDataFrame([("model", "cost", "strong", "cheap"), ("model", None, "weak", "gpt"), ("model", None, "weak", "llm"), (None, "cost", "strong", "gpt")], "direction string, dimension string, kind string, term string")
    docs = spark.createDataFrame([(1, "a gpt\nso cheap and llm"), (2, "not gpt"), (None, "cheap! not cheap")], "doc_id long, text string")
    got = {tuple(r) for r in scoring.evidence_scores(docs, lexicon, ["not"]).collect()}
    assert got == {(1, None, "cost", 5.0, 0), (1, "model", "cost", 5.0, 1), (1, "model", None, 2.5, None), (None, "model", "cost", 5.0, 0)}
    gathered = [line for line in plans["found"].splitlines() if "HashAggregate(keys=" in line]
    assert gathered and not [line for line in gathered if "direction" in line or "dimension" in line]
