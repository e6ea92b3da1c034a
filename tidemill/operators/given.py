"""Scores and evidence given from outside, as JSON: read field by field, held against the text, each refusal with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemill.functions import texts
from tidemill.operators.scoring import UNCERTAIN
from tidemill.plans.vocabulary import FULL, HALF, normalized_direction
from tidemill.sources.storage import few

#: Evidence items of a response that count, lengths of an item's texts, degrees of certainty and those that are no fact yet,
#: what a status may be called in a text, and the characters around a quote that may deny it.
ITEMS, LENGTHS = 80, {"quote": 280, "subject": 160, "predicate": 160, "object": 240}
CERTAIN, UNSURE = ["fact", "announced", "planned", "claimed", "rumor"], ["planned", "claimed", "rumor"]
STATUS = {"deployed": "deploy|部署|上线|量产|投产|生产", "production": "production|生产|量产", "ga": r"(?<![A-Za-z0-9_])ga(?![A-Za-z0-9_])|正式发布|全面上线", "pilot": "pilot|试点", "completed": "complete|完成", "signed": "sign|签署"}
AROUND = 24


def kind(value: Column) -> Column:
    """STRING, NUMBER, BOOLEAN, ARRAY, OBJECT or another type of a variant; null for none."""
    name = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    return F.when(name.isin("BIGINT", "DECIMAL", "DOUBLE", "FLOAT"), "NUMBER").otherwise(name)


def at(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def score(value: Column) -> Column:
    """2.5 or 5 if that is what a variant holds, else null."""
    number = F.when(kind(value) == "NUMBER", F.try_variant_get(value, "$", "double"))
    return F.when(number.isin(HALF, FULL), number)


def spoken(value: Column, most: int) -> Column:
    """A text of one to most characters without outer spaces, else null."""
    text = texts.trimmed(F.when(kind(value) == "STRING", F.try_variant_get(value, "$", "string")))
    return F.when(F.length(text).between(1, most), text)


def stands(key: Column, value: Column, quote: Column) -> Column:
    """Whether a field's text stands in a quote: signs alone literally, else without case, spaces and punctuation; a status also by what it is called."""
    raw = texts.trimmed(value)
    status = F.lit(False)
    for name, pattern in STATUS.items():
        status = status | ((key == "status") & (F.lower(raw) == name) & quote.rlike(pattern))
    return (raw != "") & (status | F.when(raw.rlike(r"^[^\p{L}\p{N}]+\z"), quote.contains(raw)).otherwise(texts.plain(quote).contains(texts.plain(raw))))


def checked_evidence(responses: DataFrame, articles: DataFrame, dimensions: DataFrame, requirements: DataFrame) -> DataFrame:
    """(article_id, at, direction, dimension, score, quote, certainty, reason): every evidence item of responses (article_id, response), read and tested.

    articles: article_id, text; dimensions: direction, dimension; requirements: direction, dimension, required array<string>, one_of
    array<string>. An item is refused (score is null) for the first of not_object, direction, dimension, score, quote, not_in_text, subject,
    predicate, object, certainty, fields. One of 5 becomes 2.5 for tuple (subject, predicate or object isn't in the quote),
    required (a required field isn't, or none of the alternatives, or of two modalities one is missing), uncertain (by its certainty or by what stands around the quote). A response that is no JSON or lists nothing has no rows.
    """
    listed = F.slice(F.try_variant_get(F.try_parse_json("response"), "$.evidence", "array<variant>"), 1, ITEMS)
    item = responses.select("article_id", F.posexplode(listed).alias("at", "i"))
    plain_field = F.map_filter(F.try_variant_get(at(F.col("i"), "fields"), "$", "map<string,variant>"), lambda k, v: F.length(k).between(1, 64) & kind(v).isin("STRING", "NUMBER", "BOOLEAN", "ARRAY"))
    item = item.select(
        "article_id", "at", (kind(F.col("i")) == "OBJECT").alias("is_object"), normalized_direction(spoken(at(F.col("i"), "direction"), 1000)).alias("direction"), spoken(at(F.col("i"), "dimension"), 1000).alias("dimension"),
        score(at(F.col("i"), "score")).alias("given"), *(spoken(at(F.col("i"), n), most).alias(n) for n, most in LENGTHS.items()), spoken(at(F.col("i"), "certainty"), 20).alias("certainty"), F.when(kind(at(F.col("i"), "fields")) == "OBJECT", plain_field).alias("fields"),
    )
    known = F.broadcast(dimensions.select("direction", "dimension").distinct().withColumn("known", F.lit(True)))  # the editors' 71
    rules = few(requirements.select("direction", "dimension", "required", "one_of"))
    item = item.join(known, ["direction", "dimension"], "left").join(rules, ["direction", "dimension"], "left").join(articles.select("article_id", "text"), "article_id", "left")
    place = F.expr("locate(quote, text)")
    refused = (
        F.when(~F.coalesce("is_object", F.lit(False)), "not_object").when(F.col("direction").isNull(), "direction").when(F.col("known").isNull(), "dimension").when(F.col("given").isNull(), "score").when(F.col("quote").isNull(), "quote")
        .when(F.coalesce(place, F.lit(0)) == 0, "not_in_text").when(F.col("subject").isNull(), "subject").when(F.col("predicate").isNull(), "predicate").when(F.col("object").isNull(), "object")
        .when(~F.coalesce(F.col("certainty").isin(CERTAIN), F.lit(False)), "certainty").when(F.coalesce(F.size("fields"), F.lit(0)) < 1, "fields")
    )
    told = item.select("*", refused.alias("refused"), F.explode(F.array(F.when(refused.isNull(), place))).alias("place"))
    around = F.substring(F.col("text"), F.greatest(F.col("place") - AROUND, F.lit(1)), F.least(F.col("place") - 1, F.lit(AROUND)) + F.length("quote") + AROUND)
    tuple_ = F.lit(True)
    for name in ("subject", "predicate", "object"):
        tuple_ = tuple_ & (texts.plain(F.col(name)) != "") & texts.plain(F.col("quote")).contains(texts.plain(F.col(name)))
    values = lambda v: F.when(kind(v) == "ARRAY", F.try_variant_get(v, "$", "array<variant>")).otherwise(F.array(v))
    one = lambda k, v: kind(v).isin("STRING", "NUMBER") & stands(k, F.try_variant_get(v, "$", "string"), F.col("quote"))
    holds = F.transform_values("fields", lambda k, v: F.coalesce((F.size(values(v)) > 0) & F.forall(values(v), lambda x: F.coalesce(one(k, x), F.lit(False))), F.lit(False)))
    told = told.select("*", F.explode(F.array(F.when(F.col("refused").isNull(), holds))).alias("holds"))
    has = lambda name: F.coalesce(F.try_element_at("holds", name), F.lit(False))
    modes = F.try_variant_get(F.try_element_at("fields", F.lit("modalities")), "$", "array<string>")
    required = F.col("required").isNotNull() & F.forall("required", has) & ((F.coalesce(F.size("one_of"), F.lit(0)) < 1) | F.exists("one_of", has)) & ((F.col("dimension") != "modality_coverage") | (F.size(F.array_distinct(modes)) >= 2))
    unsure = F.col("certainty").isin(UNSURE) | around.rlike(UNCERTAIN)
    capped = F.when(F.col("given") == FULL, F.when(~tuple_, "tuple").when(~F.coalesce(required, F.lit(False)), "required").when(unsure, "uncertain"))
    final = F.when(F.col("refused").isNull(), F.when(capped.isNotNull(), HALF).otherwise(F.col("given")))
    return told.select("article_id", "at", "direction", "dimension", final.alias("score"), F.when(F.col("refused").isNull(), F.col("quote")).alias("quote"), "certainty", F.coalesce("refused", capped).alias("reason"))


def complete_chains(responses: DataFrame, evidence: DataFrame) -> DataFrame:
    """(article_id, n_claims, complete): whether each score above zero that a response (article_id, response) proposes is borne out by evidence of as much.

    Scores are direction -> dimension -> 2.5 or 5; older names of directions count, unknown ones and other values don't. evidence: checked_evidence().
    """
    proposed = responses.select("article_id", F.explode_outer(F.try_variant_get(F.try_parse_json("response"), "$.scores", "map<string,variant>")).alias("name", "of"))
    proposed = proposed.select("article_id", normalized_direction(F.col("name")).alias("direction"), F.explode_outer(F.try_variant_get("of", "$", "map<string,variant>")).alias("dimension", "v"))
    proposed = proposed.select("article_id", "direction", "dimension", F.when(F.col("direction").isNotNull(), score(F.col("v"))).alias("score"))
    best = evidence.where("score IS NOT NULL").groupBy("article_id", "direction", "dimension").agg(F.max("score").alias("held"))
    both = proposed.join(best, ["article_id", "direction", "dimension"], "left")
    claim = F.col("score").isNotNull()
    return both.groupBy("article_id").agg(F.count_if(claim).alias("n_claims"), (F.count_if(claim & (F.coalesce("held", F.lit(0.0)) < F.col("score"))) == 0).alias("complete"))
