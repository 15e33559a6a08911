"""Optional filters of the public queries, built as one Column predicate each."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.jsontext import json_scalars


def clean_values(values: Iterable[str] | None) -> list[str]:
    """Strip, drop blanks and repeats, keep the given order."""
    stripped = (value.strip() for value in values or () if value)
    return list(dict.fromkeys(value for value in stripped if value))


def all_of(conditions: Iterable[Column | None]) -> Column:
    """AND of the conditions that are present; true when there is none."""
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: Iterable[Column | None]) -> Column | None:
    present = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a | b, present) if present else None


def value_in(column: str, values: Iterable[str] | None) -> Column | None:
    wanted = clean_values(values)
    return F.col(column).isin(wanted) if wanted else None


def json_array_has(column: str, values: Iterable[str] | None) -> Column | None:
    wanted = clean_values(values)
    if not wanted:
        return None
    return F.exists(json_scalars(F.col(column)), lambda text: text.isin(wanted))


def nhs_trust_in(values: Iterable[str] | None) -> Column | None:
    """``all`` in any case means every row with a trust, whatever else is listed."""
    wanted = clean_values(values)
    if any(value.lower() == "all" for value in wanted):
        return F.col("nhstrust_code").isNotNull()
    return F.col("nhstrust_code").isin(wanted) if wanted else None


@dataclass(frozen=True)
class PublicFilter:
    """Values a caller may narrow the public queries by; empty means no narrowing.

    Values of one field are alternatives, the fields are ANDed, except the three
    location fields, which are alternatives to each other.
    """

    publisher: tuple[str, ...] = ()
    district: tuple[str, ...] = ()
    region: tuple[str, ...] = ()
    country: tuple[str, ...] = ()
    activity: tuple[str, ...] = ()
    organization: tuple[str, ...] = ()
    nhs_trust: tuple[str, ...] = ()

    def _location(self) -> Column | None:
        return any_of(
            [
                value_in("district_code", self.district),
                value_in("region_code", self.region),
                value_in("country_code", self.country),
            ]
        )

    def on_summary(self) -> Column:
        """Predicate over ``active_opportunities_summary``."""
        return all_of(
            [
                self._location(),
                value_in("publisher", self.publisher),
                json_array_has("activity_or_facility", self.activity),
                json_array_has("organization_names", self.organization),
                nhs_trust_in(self.nhs_trust),
            ]
        )

    def on_opportunities(self) -> Column:
        """Predicate over ``opportunities``."""
        return all_of(
            [
                self._location(),
                value_in("publisher_name", self.publisher),
                any_of(
                    [
                        json_array_has("activity", self.activity),
                        json_array_has("facility", self.activity),
                    ]
                ),
                value_in("organization_name", self.organization),
                nhs_trust_in(self.nhs_trust),
            ]
        )

    def binds_values(self) -> bool:
        """Whether any field carries values to compare with.

        ``nhs_trust=all`` compares with none, so on its own it does not count.
        """
        plain = (
            self.publisher, self.district, self.region, self.country,
            self.activity, self.organization,
        )
        if any(clean_values(values) for values in plain):
            return True
        trusts = clean_values(self.nhs_trust)
        return bool(trusts) and not any(value.lower() == "all" for value in trusts)


def live_opportunity(today: dt.date) -> Column:
    """Starts today or later and names a district and a publisher."""
    return (
        (F.col("startDate") >= F.lit(today))
        & (F.col("district_name") != "")
        & (F.col("publisher_name") != "")
    )


def within_days(timestamp: str, first: dt.date, last: dt.date) -> Column:
    """Whole-day window as a range over the raw timestamp, so the scan can skip row groups."""
    column = F.col(timestamp)
    return (column >= F.lit(first)) & (column < F.lit(last + dt.timedelta(days=1)))
