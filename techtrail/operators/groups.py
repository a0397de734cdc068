"""Hooks for users' own functions: over groups, and strategies over shared tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


def apply_group(df: DataFrame, key: list[str], function: Callable, schema: str) -> DataFrame:
    """A pandas function over each group's rows: the way out when no built-in function will do. A group must fit in a task's memory."""
    return df.groupBy(*key).applyInPandas(function, schema)


@dataclass(frozen=True)
class Strategy:
    """A named table made from shared ones."""

    name: str
    make: Callable[[dict[str, DataFrame]], DataFrame]


def run_strategies(shared: dict[str, DataFrame], strategies: list[Strategy]) -> dict[str, DataFrame]:
    """Tables of several strategies over the same inputs; pass written inputs, so that each is made once."""
    return {s.name: s.make(shared) for s in strategies}
