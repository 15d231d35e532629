"""Streaming form of the one stateless operator: assignment to fixed centres."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.assign import assign


def assign_stream(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """`points` may be a streaming DataFrame with column x."""
    return assign(points, centres)
