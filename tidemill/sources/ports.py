"""Ports to the outside. Each is a function of a DataFrame, so that tables stand in where there is no network."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Port = Callable[[DataFrame], DataFrame]


def lookup(table: DataFrame, key: str, columns: list[str]) -> Port:
    """A port that answers from a table; keys that it lacks get nulls."""
    return lambda asked: asked.join(table.select(key, *columns), key, "left")


@dataclass(frozen=True)
class Ports:
    """fetch adds body, status; resolve adds addresses; probe adds probe_status; score adds ai_scores."""

    fetch: Port
    resolve: Port
    probe: Port
    score: Port


def offline(df: DataFrame) -> Ports:
    """Ports that answer nothing: every article falls back to its rules."""
    none = lambda *names: lambda asked: asked.withColumns({n: F.lit(None).cast("string") for n in names})
    return Ports(none("body", "status"), none("addresses"), none("probe_status"), none("ai_scores"))
