"""Collectors and exporters by name: callables in a dictionary. See protocols for those that run as data sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

MOST_DRAFTS = 100_000


class Registry:
    """name -> callable; a name is registered once."""

    def __init__(self) -> None:
        self._made: dict[str, Callable] = {}

    def register(self, name: str, make: Callable) -> None:
        if name in self._made:
            raise ValueError("OL_REGISTRY_DUPLICATE")
        self._made[name] = make

    def resolve(self, name: str) -> Callable:
        if name not in self._made:
            raise KeyError("OL_REGISTRY_UNKNOWN")
        return self._made[name]

    def names(self) -> list[str]:
        return sorted(self._made)


def collect(registry: Registry, name: str, spark: SparkSession, config: dict) -> DataFrame:
    """A collector's drafts; more than the bound in one run fails with a code, at run time."""
    drafts = registry.resolve(name)(spark, config)
    n = drafts.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    if n > config.get("most_drafts", MOST_DRAFTS):
        raise ValueError("OL_COLLECTOR_DRAFTS")
    return drafts
