"""The order of every ordered result over a small table, whose many ties the later keys must settle."""

import pytest

from checks.catalog import QUERIES

SMALL, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def last_nulls(value):
    return (value is None, value)


def falling_then_nulls(value):
    return (value is None, 0 if value is None else -value)


def folded(name):
    """Ignoring case first; nulls come first."""
    return (name is not None, (name or "").upper()), (name is not None, name or "")


ORDERS = {
    "single_feed_stalls": lambda r: (-r.consecutive_days, r.feed_id),
    "feed_ingestion_errors": lambda r: (-r.consecutive_days, r.feed_id),
    "dataset_stalls": lambda r: (-r.consecutive_days, r.dataset_url),
    "dataset_stall_feeds": lambda r: (r.dataset_url, last_nulls(r.consecutive_days), r.feed_id),
    "dataset_future_decline": lambda r: (-r["drop"], -r.drop_percent, r.dataset_url),
    "dataset_future_decline_feeds": lambda r: (r.dataset_url, -r["drop"], -r.drop_percent, r.feed_id),
    "orphaned_children": lambda r: (-r.orphan_count, -r.orphan_share, r.dataset_url),
    "orphaned_children_by_kind": lambda r: (r.dataset_url, -r.orphan_count, r.kind),
    "orphaned_missing_parents": lambda r: (r.dataset_url, r.position),
    "feed_quality_rows": lambda r: (falling_then_nulls(r.score), r.dataset_url, r.feed_id),
    "feed_quality_breakdowns": lambda r: (r.breakdown, -r.feed_count, r.value.upper()),
    "custom_property_rows": lambda r: (falling_then_nulls(r.num_custom_properties), r.dataset_url, r.feed_id),
    "custom_property_entity_types": lambda r: (-r.feed_count, r.entity_type),
    "custom_property_properties": lambda r: (-r.feed_count, r.property),
    "notification_list": lambda r: (falling_then_nulls(r.oldest_days_open), r.publisher_name, r.id),
    "ecosystem_growth": lambda r: r.period_start,
    "ecosystem_growth_datasets": lambda r: (r.period_start, r.figure, r.dataset_name.upper(), r.dataset_url),
    "publishers": lambda r: (r.publisher.upper(), r.publisher),
    "activities": lambda r: (r.activity.upper(), r.activity),
    "organizations": lambda r: (r.organization.upper(), r.organization),
    "opportunity_records": lambda r: (r.startDate, r.feed_id, r.id),
    "single_feed_stall_trend": lambda r: r.day,
    "custom_property_namespaces": lambda r: (-r.feed_count, last_nulls(r.namespace)),
    "areas": lambda r: (*folded(r.country_name), *folded(r.region_name), *folded(r.district_name), r.code),
    "nhs_trusts": lambda r: (r.nhstrust_name.upper(), r.nhstrust_name, r.nhstrust_code),
    "socio": lambda r: (r.area_name, r.area_code),
    "feed_quality_completeness": lambda r: r.position,
}


@pytest.mark.parametrize("name", ORDERS)
def test_rows_come_in_order(spark, name):
    rows = QUERIES[name](spark, SMALL).collect()
    if len(rows) < 2:
        rows = QUERIES[name](spark, LARGER).collect()
    assert len(rows) >= 2 and rows == sorted(rows, key=ORDERS[name])
