"""Closed vocabularies: directions, their dimensions, weights and rules. Lexicons are tables, given as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed values: (direction, dimension, weight), both in order.
DIMENSIONS = [
    ("model", "entity", 1.5), ("model", "capability", 2.0), ("model", "availability", 1.0), ("model", "performance", 1.5), ("model", "cost", 1.0), ("model", "ecosystem", 1.0), ("model", "adoption", 1.0),
    ("agent", "task_boundary", 1.5), ("agent", "tool_call", 1.5), ("agent", "protocol", 1.0), ("agent", "orchestration", 1.5), ("agent", "observability", 0.75), ("agent", "production", 1.5), ("agent", "benchmark", 0.75), ("agent", "workflow", 1.5),
    ("multimodal", "modality_coverage", 1.5), ("multimodal", "io_capability", 1.5), ("multimodal", "quality", 1.0), ("multimodal", "realtime", 1.0), ("multimodal", "editing", 0.75), ("multimodal", "3d_world", 1.0), ("multimodal", "safety_copyright", 0.75), ("multimodal", "product", 1.0),
    ("coding", "code_gen", 1.5), ("coding", "repo_understanding", 1.25), ("coding", "engineering", 1.5), ("coding", "ide_integration", 1.0), ("coding", "delivery", 1.0), ("coding", "benchmark", 0.75), ("coding", "cost_speed", 0.75), ("coding", "security", 0.75),
    ("infrastructure", "hardware", 1.5), ("infrastructure", "training", 1.0), ("infrastructure", "performance", 1.5), ("infrastructure", "cost", 1.0), ("infrastructure", "software_stack", 1.25), ("infrastructure", "cloud", 1.25), ("infrastructure", "edge", 0.75), ("infrastructure", "ops", 0.75),
    ("data_eval", "data_asset", 1.5), ("data_eval", "coverage", 1.0), ("data_eval", "methodology", 1.5), ("data_eval", "reproducibility", 1.25), ("data_eval", "performance", 1.25), ("data_eval", "quality", 1.0), ("data_eval", "governance", 1.0), ("data_eval", "decision_value", 0.75),
    ("safety_governance", "risk_type", 1.25), ("safety_governance", "controls", 1.5), ("safety_governance", "verification", 1.5), ("safety_governance", "privacy", 1.0), ("safety_governance", "copyright", 1.0), ("safety_governance", "regulation", 1.25), ("safety_governance", "framework", 1.25), ("safety_governance", "deployment_impact", 1.0),
    ("applications", "industry", 1.25), ("applications", "business_problem", 1.5), ("applications", "launch_status", 1.5), ("applications", "scale", 1.0), ("applications", "roi", 1.25), ("applications", "workflow_change", 1.25), ("applications", "replicability", 0.75), ("applications", "risk_responsibility", 1.0),
    ("business_ecosystem", "business_fact", 1.5), ("business_ecosystem", "entity_market", 1.25), ("business_ecosystem", "strategy", 1.25), ("business_ecosystem", "business_model", 1.5), ("business_ecosystem", "market_landscape", 1.25), ("business_ecosystem", "open_source", 0.75), ("business_ecosystem", "talent", 0.75), ("business_ecosystem", "signal", 1.0),
]
NAMES = list(dict.fromkeys(direction for direction, _, _ in DIMENSIONS))
#: The most that a direction gets without core evidence.
CAPPED = {"model": 12, "agent": 12, "multimodal": 12, "coding": 12, "infrastructure": 12, "data_eval": 10, "safety_governance": 10, "applications": 10, "business_ecosystem": 10}
ALIASES = {"multi": "multimodal", "infra": "infrastructure", "eval": "data_eval", "data": "data_eval", "security": "safety_governance"}
FULL, HALF = 5.0, 2.5


def dimension_rows() -> list[tuple[str, int, str, int, float]]:
    """(direction, its place, dimension, its place, weight), 71 rows."""
    inside = {d: [x for of, x, _ in DIMENSIONS if of == d] for d in NAMES}
    return [(d, NAMES.index(d) + 1, x, inside[d].index(x) + 1, w) for d, x, w in DIMENSIONS]


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(dimension_rows(), "direction string, direction_no int, dimension string, dimension_no int, weight double")


def normalized_direction(raw: Column) -> Column:
    """The direction that a name or an older alias stands for, else null."""
    named = F.coalesce(F.create_map(*(F.lit(x) for pair in ALIASES.items() for x in pair))[raw], raw)
    return F.when(named.isin(NAMES), named)


def complete(direction: Column, scores: Column) -> Column:
    """Whether a map dimension -> score completes a direction's story: the direction's rule, and three full dimensions."""
    def at_least(name: str, least: float) -> Column:
        return F.coalesce(F.try_element_at(scores, F.lit(name)), F.lit(0.0)) >= least

    def full(name: str) -> Column:
        return at_least(name, FULL)

    def half(name: str) -> Column:
        return at_least(name, HALF)

    three = F.size(F.filter(F.map_values(scores), lambda v: v >= FULL)) >= 3
    #: Each direction's rule.
    rules = {
        "model": full("entity") & full("capability"),
        "agent": full("task_boundary") & (full("tool_call") | full("orchestration")),
        "multimodal": full("modality_coverage") & full("io_capability"),
        "coding": (full("code_gen") & (full("repo_understanding") | full("engineering")))
        | (full("code_gen") & full("ide_integration") & (half("engineering") | half("delivery") | half("benchmark")))
        | (full("engineering") & (full("delivery") | full("security"))),
        "infrastructure": (full("hardware") | full("training") | full("cloud") | full("edge")) & (full("performance") | full("cost") | full("software_stack") | full("ops")),
        "data_eval": (full("data_asset") & (full("coverage") | full("quality") | full("governance"))) | (full("methodology") & (full("performance") | full("reproducibility") | full("quality"))),
        "safety_governance": full("risk_type") & (full("controls") | full("verification") | full("regulation")),
        "applications": full("industry") & full("business_problem") & full("launch_status"),
        "business_ecosystem": (full("business_fact") & (full("entity_market") | full("strategy") | full("business_model"))) | (full("entity_market") & full("open_source")) | (full("talent") & full("strategy")),
    }
    rule = F.lit(False)
    for name, holds in rules.items():
        rule = rule | ((direction == name) & holds)
    return three & rule
