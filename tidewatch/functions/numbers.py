"""Arithmetic shared by the detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent_drop(drop: Column, start: Column) -> Column:
    """``drop`` as a percentage of ``start``: never negative, two decimals, half to even."""
    raw = F.greatest(drop, F.lit(0)) * F.lit(100.0) / F.when(start > 0, start)
    return F.coalesce(F.rint(raw * 100) / 100, F.lit(0.0))


def share(part: Column, whole: Column) -> Column:
    """``part / whole`` held within 0..1, zero when there is no whole."""
    ratio = part / F.when(whole > 0, whole)
    return F.coalesce(F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
