"""Boxes as structs of x0, y0, x1, y1 (origin top left)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def union(a: Column, b: Column) -> Column:
    return F.struct(F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1"))


def area(a: Column) -> Column:
    return F.greatest(a["x1"] - a["x0"], F.lit(0.0)) * F.greatest(a["y1"] - a["y0"], F.lit(0.0))


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0), F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    return overlap(a["x0"], a["x1"], b["x0"], b["x1"]) * overlap(a["y0"], a["y1"], b["y0"], b["y1"])


def narrow_share(a: Column, b: Column) -> Column:
    """Horizontal overlap as a share of the narrower box."""
    return overlap(a["x0"], a["x1"], b["x0"], b["x1"]) / F.nullif(F.least(a["x1"] - a["x0"], b["x1"] - b["x0"]), F.lit(0.0))
