"""Paging over a total order.

``page`` and ``records_page`` count rows from the start, so a late page has to order all rows
before it.  ``page_after`` goes on from the key of the last row seen: a filter and a top-k of the
page's own size, however late the page.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_PAGE_SIZE = 500


@dataclass(frozen=True)
class SortKey:
    """A column of a total order and where its nulls stand."""

    name: str
    descending: bool = False
    nulls_last: bool = False

    def order(self) -> Column:
        column = F.col(self.name)
        if self.descending:
            return column.desc_nulls_last() if self.nulls_last else column.desc_nulls_first()
        return column.asc_nulls_last() if self.nulls_last else column.asc_nulls_first()

    def equals(self, value: object) -> Column:
        return F.col(self.name).isNull() if value is None else F.col(self.name) == F.lit(value)

    def follows(self, value: object) -> Column:
        """Whether the column's value comes after ``value`` in this key's order; never null."""
        column = F.col(self.name)
        if value is None:
            return F.lit(False) if self.nulls_last else column.isNotNull()
        beyond = column < F.lit(value) if self.descending else column > F.lit(value)
        return F.coalesce(beyond, F.lit(self.nulls_last))


def _checked(name: str, value: int, least: int) -> int:
    if value < least:
        raise ValueError(f"{name} must be at least {least}, not {value}")
    return value


def page(df: DataFrame, order: list[Column], page: int = 1, page_size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """A one-based page of ``df`` in ``order``; ordering costs as much as all pages up to it."""
    size = _checked("page_size", page_size, 1)
    return df.orderBy(*order).offset((_checked("page", page, 1) - 1) * size).limit(size)


def page_after(
    df: DataFrame, keys: Sequence[SortKey], after: Sequence | None = None, page_size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """The ``page_size`` rows that follow the key ``after``, the first ones where it is None.

    ``keys`` must order ``df`` totally: of rows with equal keys, those beyond a page's end are
    not on the next one.
    """
    size = _checked("page_size", page_size, 1)
    if after is not None:
        if len(after) != len(keys):
            raise ValueError(f"after needs {len(keys)} values, one per key")
        later = F.lit(False)
        for key, value in reversed(list(zip(keys, after))):
            later = key.follows(value) | (key.equals(value) & later)
        df = df.where(later)
    return df.orderBy(*[key.order() for key in keys]).limit(size)


def _with_has_more(fetched: DataFrame, order: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` of at most ``limit`` + 1 rows, and whether there was one more."""
    everything = Window.partitionBy(F.lit(1))
    return (
        fetched.withColumn("_position", F.row_number().over(everything.orderBy(*order)))
        .withColumn("has_more", F.count(F.lit(1)).over(everything) > limit)
        .where(F.col("_position") <= limit)
        .drop("_position")
    )


def records_page(df: DataFrame, order: list[Column], offset: int = 0, limit: int = 20) -> DataFrame:
    """``limit`` rows from ``offset`` plus ``has_more``, told by one row fetched beyond the page."""
    _checked("offset", offset, 0)
    _checked("limit", limit, 1)
    return _with_has_more(df.orderBy(*order).offset(offset).limit(limit + 1), order, limit)


def records_after(
    df: DataFrame, keys: Sequence[SortKey], after: Sequence | None = None, limit: int = 20
) -> DataFrame:
    """``limit`` rows that follow the key ``after`` plus ``has_more``."""
    _checked("limit", limit, 1)
    return _with_has_more(page_after(df, keys, after, limit + 1), [key.order() for key in keys], limit)
