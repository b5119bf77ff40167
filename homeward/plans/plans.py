"""Whole answers: from requests to areas of both versions, compared."""

from __future__ import annotations

from pyspark.sql import DataFrame

from homeward.operators import areas


def both(requests: DataFrame, features: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Each request with the areas of both versions, from one set of strengths, one pass of
    selection and one join with the requests."""
    cells = areas.with_strengths(areas.grid(areas.mapped(requests, failed)), features)
    return areas.answered(requests, areas.select_both(cells), (1, 2), failed)


def compare(requests: DataFrame, features: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Rank by rank what the second version changes."""
    return areas.compare(both(requests, features, failed))


def compare_summary(requests: DataFrame, features: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    return areas.compare_summary(both(requests, features, failed))
