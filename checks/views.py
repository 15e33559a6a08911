"""The domain tables as views over the driver's tables.

One SQL text per table, kept to the dialect both engines share, so the Spark query and its
oracle read the same rows.  ``{name}`` is a driver table.

Every view reads its tables whole and keeps all their rows.  Conditions on remainders only hand out
attribute values, a null among them where a membership is wanted (a feed nobody describes, a run without
a dataset), so that each rule meets rows on both sides of it.  The one exception is a derived row: a
parent that is not published.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schemas import COMPLETENESS_COLUMNS, SOCIO_MEASURES


def _text(expression: str) -> str:
    return f"CAST({expression} AS STRING)"


INGESTION = f"""
SELECT 'feed-' || {_text('user_id')} AS feed_id,
       CASE WHEN user_id % 10 = 0 AND ts < DATE '2024-01-16' THEN 'https://old' ELSE 'https://d' END
         || {_text('CAST(floor(user_id / 2) AS BIGINT)')} || '.example/data/' AS dataset_id,
       ts AS ingestion_date,
       CASE user_id % 4 WHEN 0 THEN 'Slot' WHEN 1 THEN 'ScheduledSession'
                        WHEN 2 THEN 'SessionSeries' ELSE 'FacilityUse' END AS kind,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' ELSE 'COMPLETE' END AS status,
       CASE WHEN event_type = 'error' THEN
         CASE event_id % 5 WHEN 0 THEN '403' WHEN 1 THEN '500' WHEN 2 THEN 'CONNECTION_ERROR' ELSE '404' END
       END AS error_code,
       CASE WHEN event_type IN ('error', 'click') THEN props END AS warning_message,
       CASE WHEN event_type = 'purchase' THEN CAST(floor(value) AS BIGINT)
            WHEN event_type = 'signup' THEN NULL ELSE CAST(0 AS BIGINT) END AS updated,
       CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS deleted,
       CASE WHEN event_type = 'view' THEN CAST(floor(value) AS BIGINT) ELSE CAST(0 AS BIGINT) END AS actual_deletes,
       CASE WHEN event_type <> 'error' THEN CAST(floor(value * 10) AS BIGINT) END AS total_future_opportunities
FROM {{events}}
"""

# Children are the line items, parents the part numbers a supplier really carries.
REFERENCES = f"""
SELECT 'https://s' || {_text('l_suppkey')} || '.example/data/' AS dataset_url,
       CASE l_returnflag WHEN 'A' THEN 'Slot' WHEN 'R' THEN 'ScheduledSession' ELSE 'Event' END AS kind,
       {_text('l_orderkey')} || '-' || {_text('l_linenumber')} AS data_id,
       CASE WHEN l_linenumber % 7 = 0 THEN '{{{{"id":"P' || {_text('l_partkey')} || '"}}}}'
            WHEN l_linenumber % 5 = 0 THEN NULL
            ELSE '"P' || {_text('l_partkey')} || '"' END AS has_superEvent,
       CASE l_linenumber % 3 WHEN 0 THEN '{{{{"latitude":51.5}}}}' WHEN 1 THEN NULL ELSE '{{{{ }}}}' END AS location
FROM {{lineitem}}
UNION ALL
SELECT DISTINCT 'https://s' || {_text('l_suppkey')} || '.example/data/', 'SessionSeries',
       'P' || {_text('l_partkey')}, CAST(NULL AS STRING), CAST(NULL AS STRING)
FROM {{lineitem}} WHERE l_partkey % 4 <> 0
"""

_PLACE = f"""
       r_name AS country_name, 'C' || {_text('r_regionkey')} AS country_code,
       CASE WHEN n_nationkey % 5 <> 0 THEN n_name END AS region_name,
       CASE WHEN n_nationkey % 5 <> 0 THEN 'R' || {_text('n_nationkey')} END AS region_code,
       'District ' || {_text('n_nationkey')} || '-' || {_text('c_custkey % 4')} AS district_name,
       'D' || {_text('n_nationkey')} || '-' || {_text('c_custkey % 4')} AS district_code
"""

_LINE_JOINS = """
FROM {lineitem}
JOIN {orders} ON o_orderkey = l_orderkey
JOIN {customer} ON c_custkey = o_custkey
JOIN {nation} ON n_nationkey = c_nationkey
JOIN {region} ON r_regionkey = n_regionkey
JOIN {part} ON p_partkey = l_partkey
JOIN {supplier} ON s_suppkey = l_suppkey
"""

OPPORTUNITIES = f"""
SELECT s_name AS publisher_name, 'feed-' || {_text('l_suppkey')} AS feed_id,
       {_text('l_orderkey')} || '-' || {_text('l_linenumber')} || '-' || {_text('l_partkey')} AS id,
       CASE l_returnflag WHEN 'A' THEN 'Slot' WHEN 'R' THEN 'ScheduledSession' ELSE 'Event' END AS kind,
       l_shipdate AS startDate, l_shipdate AS endDate, CAST(o_orderdate AS DATE) AS last_updated,
       CASE l_linenumber % 3 WHEN 0 THEN '{{{{"latitude":51.5}}}}' END AS location,
       {_PLACE},
       '["' || p_type || '"]' AS activity,
       CASE WHEN p_size % 2 = 0 THEN '["' || p_brand || '",{{{{"id":1}}}}]' END AS facility,
       '{{{{"line":' || {_text('l_linenumber')} || '}}}}' AS json_data,
       CASE WHEN l_linenumber % 2 = 0 THEN '16+' END AS ageRange,
       CAST(NULL AS STRING) AS level, '[]' AS accessibilitySupport,
       CASE WHEN l_linenumber % 4 = 0 THEN 'None' END AS genderRestriction,
       CASE o_orderkey % 11 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE c_mktsegment || ' ' || {_text('n_nationkey')} END AS organization_name,
       CASE WHEN n_nationkey % 3 = 0 THEN 'T' || {_text('n_nationkey')} END AS nhstrust_code
{_LINE_JOINS}
"""

SUMMARY = f"""
SELECT publisher, country_name, country_code, region_name, region_code, district_name, district_code,
       is_activity, activity_or_facility, organization_names, nhstrust_name, nhstrust_code,
       count(*) AS opportunity_count,
       count(*) FILTER (WHERE l_linenumber <= 3) AS opportunity_count_narrow
FROM (
  SELECT s_name AS publisher, {_PLACE}, p_size % 2 = 0 AS is_activity,
         '["' || p_type || '","' || p_brand || '",null,{{{{"x":1}}}}]' AS activity_or_facility,
         '["' || c_mktsegment || '"]' AS organization_names,
         CASE WHEN n_nationkey % 3 = 0 THEN 'Trust ' || {_text('n_nationkey')} END AS nhstrust_name,
         CASE WHEN n_nationkey % 3 = 0 THEN 'T' || {_text('n_nationkey')} END AS nhstrust_code,
         l_linenumber
  {_LINE_JOINS}
) AS lines
GROUP BY publisher, country_name, country_code, region_name, region_code, district_name, district_code,
         is_activity, activity_or_facility, organization_names, nhstrust_name, nhstrust_code
"""

INSIGHT_RUNS = """
SELECT o_orderdate AS run_date, count(*) AS total_num_future_opportunity_items_narrow
FROM {orders} GROUP BY o_orderdate
"""

_GROWTH_DATASET = f"'https://d' || {_text('o_custkey')} || '.example/data/'"

GROWTH_CRAWLS = f"""
SELECT o_orderdate AS ingestion_date,
       '["' || string_agg(DISTINCT CASE WHEN o_orderkey % 13 <> 0 THEN {_GROWTH_DATASET} END, '","') || '"]' AS datasets,
       count(DISTINCT o_custkey) AS number_of_datasets,
       count(*) AS number_of_feeds
FROM {{orders}}
GROUP BY o_orderdate
"""

GROWTH_INGESTION = f"""
SELECT 'feed-' || {_text('o_custkey')} AS feed_id,
       CASE WHEN o_custkey % 11 <> 0 THEN {_GROWTH_DATASET} END AS dataset_id,
       o_orderdate AS ingestion_date,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'ERROR' ELSE 'COMPLETE' END AS status,
       CASE WHEN o_orderstatus = 'O' THEN CAST(0 AS BIGINT) ELSE o_orderkey % 5 END AS updated,
       CAST(0 AS BIGINT) AS deleted,
       CASE WHEN o_custkey % 7 = 0 THEN CAST(0 AS BIGINT) ELSE o_orderkey % 50 END AS total_future_opportunities
FROM {{orders}}
"""

_CUSTOMER_DATASET = f"'https://D' || {_text('CAST(floor(c_custkey / 2) AS BIGINT)')} || '.Example/data/'"
_LOWER_DATASET = f"'https://d' || {_text('CAST(floor(c_custkey / 2) AS BIGINT)')} || '.example/data/'"
_FEED_URL = (
    "CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 1 THEN 'feeds/session-series' "
    f"ELSE {_LOWER_DATASET} || 'feeds/' || lower(c_mktsegment) || '/' END"
)
_DATASET_NAME = "CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 'Dataset ' || c_name END"

FEEDS = f"""
SELECT CASE WHEN c_custkey % 17 <> 0 THEN 'feed-' || {_text('c_custkey')} END AS id, {_FEED_URL} AS url,
       CASE c_nationkey % 4 WHEN 0 THEN 'ScheduledSession' WHEN 1 THEN 'Slot' WHEN 2 THEN 'SessionSeries' END AS type,
       CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS publisher_name,
       {_LOWER_DATASET} AS dataset_url
FROM {{customer}}
"""

# Feeds of the publishers in the summary, for the publisher bridge.
SUPPLIER_FEEDS = f"""
SELECT 'feed-' || {_text('s_suppkey')} AS id, CAST(NULL AS STRING) AS url, CAST(NULL AS STRING) AS type,
       s_name AS publisher_name,
       'https://d' || {_text('s_suppkey % 40')} || '.example/data/' AS dataset_url
FROM {{supplier}}
"""

_COMPLETENESS = ", ".join(
    f"CASE WHEN c_custkey % {k} <> 0 THEN CAST((c_custkey * {k}) % 101 AS DOUBLE) END AS {name}"
    for k, name in enumerate(COMPLETENESS_COLUMNS, start=2)
)

QUALITY = f"""
SELECT 'feed-' || {_text('c_custkey')} AS feed_id, {_LOWER_DATASET} AS dataset_url,
       {_DATASET_NAME} AS dataset_name,
       CASE c_nationkey % 4 WHEN 0 THEN 'ScheduledSession' WHEN 1 THEN 'scheduledsession '
                            WHEN 2 THEN 'Slot' END AS feed_type,
       {_FEED_URL} AS feed_url,
       CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_regular,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'OK' WHEN 'BUILDING' THEN ' ok' WHEN 'MACHINERY' THEN 'WARNING'
                         WHEN 'HOUSEHOLD' THEN 'ERROR' END AS status,
       CASE c_nationkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'b' WHEN 2 THEN 'B' WHEN 3 THEN ' ' END AS grade,
       CASE c_nationkey % 3 WHEN 0 THEN '2.0' WHEN 1 THEN '1.0' END AS feed_version,
       CASE WHEN c_custkey % 9 <> 0 THEN (c_acctbal + 1000) / 110 END AS score,
       {_COMPLETENESS},
       CASE WHEN c_custkey % 7 <> 0 THEN c_custkey % 50 END AS num_future_opportunity_items,
       '[]' AS warnings, CASE WHEN c_custkey % 4 = 0 THEN '["e"]' END AS errors,
       CAST(NULL AS STRING) AS missing_required_fields,
       CAST('2024-01-' || lpad({_text('c_custkey % 28 + 1')}, 2, '0') || ' 06:00:00' AS TIMESTAMP) AS last_assessed
FROM {{customer}}
"""

USAGES = f"""
SELECT DISTINCT o_custkey AS custkey,
       CASE WHEN o_custkey % 4 <> 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'beta:' ELSE '' END || o_orderpriority END AS property,
       CASE WHEN o_orderkey % 3 = 0 THEN 'beta' END AS namespace,
       CASE WHEN o_orderkey % 17 <> 0 THEN o_orderstatus END AS entity_type,
       CAST(o_orderkey % 101 AS DOUBLE) AS presence_pct
FROM {{orders}}
"""

PROPERTY_FEEDS = f"""
SELECT 'feed-' || {_text('c_custkey')} AS feed_id,
       CASE WHEN c_custkey % 2 = 0 THEN {_LOWER_DATASET} ELSE {_CUSTOMER_DATASET} END AS dataset_url,
       {_DATASET_NAME} AS dataset_name, CASE WHEN c_custkey % 13 <> 0 THEN c_name END AS publisher_name,
       {_FEED_URL} AS feed_url, 'Slot' AS feed_type,
       CASE c_custkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS is_regular,
       c_custkey % 100 AS sampled_items, num_custom_properties, num_custom_property_usages, c_custkey
FROM {{customer}}
LEFT JOIN (
  SELECT custkey, count(DISTINCT property) AS num_custom_properties, count(property) AS num_custom_property_usages
  FROM ({USAGES}) AS usages GROUP BY custkey
) AS per_feed ON custkey = c_custkey
"""

NOTIFICATIONS = f"""
SELECT {_text('o_orderkey')} AS id, 'pub_' || {_text('o_custkey')} AS publisher_id,
       'Publisher ' || {_text('o_custkey')} AS publisher_name,
       'https://d' || {_text('o_custkey')} || '.example/data/' AS dataset_url,
       o_orderkey % 4 AS problem_count,
       CASE WHEN o_orderkey % 6 <> 0 THEN o_orderkey % 40 END AS oldest_days_open,
       CASE o_orderstatus WHEN 'F' THEN 'open' WHEN 'P' THEN 'in_progress' ELSE 'closed' END AS status,
       CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_orderdate AS DATE) END AS date_contacted,
       CASE WHEN o_orderkey % 10 <> 0 THEN
         '[{{{{"monitor_id":"' || CASE o_orderkey % 3 WHEN 0 THEN 'dataset_stall' WHEN 1 THEN 'single_feed_stall'
                                ELSE 'feed_ingestion_error' END
         || '","feed_type":"' || CASE o_orderkey % 4 WHEN 0 THEN 'Slot' WHEN 1 THEN 'ScheduledSession'
                                ELSE 'SessionSeries' END
         || '","days_open":"' || {_text('o_orderkey % 15')} || '"'
         || CASE o_orderkey % 5 WHEN 0 THEN ',"resolved_on":"2001-07-30"' WHEN 1 THEN ',"resolved_on":"1999-01-01"'
                                WHEN 2 THEN ',"resolved_on":null' ELSE '' END
         || '}}}}]' END AS problems,
       o_orderdate AS created_at, o_orderdate AS updated_at
FROM {{orders}}
"""

_AREA_LEVELS = (
    (f"'D' || {_text('n_nationkey')} || '-' || {_text('c_custkey % 4')}",
     f"'District ' || {_text('n_nationkey')} || '-' || {_text('c_custkey % 4')}"),
    (f"'R' || {_text('n_nationkey')}", "n_name"),
    (f"'C' || {_text('r_regionkey')}", "r_name"),
)
_AREA_MEASURES = ", ".join(
    f"CAST(sum(c_custkey % {k}) AS DOUBLE) AS {name}" for k, name in enumerate(SOCIO_MEASURES, start=3)
)
SOCIO = "\nUNION ALL\n".join(
    f"""SELECT {code} AS area_code, {name} AS area_name, count(*) AS total_population, {_AREA_MEASURES}
FROM {{customer}} JOIN {{nation}} ON n_nationkey = c_nationkey JOIN {{region}} ON r_regionkey = n_regionkey
GROUP BY {code}, {name}"""
    for code, name in _AREA_LEVELS
)

SITE_CELLS = f"""
SELECT DISTINCT {_text('l_suppkey')} AS site_id,
       CASE WHEN l_suppkey % 6 = 0 THEN ' ' ELSE s_name END AS site_name,
       'E' || {_text('s_nationkey')} AS local_authority_code,
       {_text('p_size')} || '.5' AS site_lat,
       CASE WHEN p_size % 7 = 0 THEN 'n/a' ELSE {_text('p_size')} END AS ap_facility_count,
       p_brand || ' | |' || p_type || '|' AS oa_publisher_names,
       CASE WHEN p_size % 5 = 0 THEN ''
            ELSE '{{{{"p":"a|b' || {_text('l_partkey')} || '"}}}}|{{{{"q":' || {_text('p_size')} || '}}}}' END AS oa_location_json,
       CASE WHEN p_size % 4 <> 0 THEN {_text('l_partkey')} END AS distance_metres,
       CASE p_size % 3 WHEN 0 THEN 'spatial' WHEN 1 THEN 'Postcode' END AS match_method,
       CASE p_size % 3 WHEN 0 THEN 'True' WHEN 1 THEN 'maybe' END AS spatial_match
FROM {{lineitem}} JOIN {{supplier}} ON s_suppkey = l_suppkey JOIN {{part}} ON p_partkey = l_partkey
"""

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
)


class Tables:
    """The driver's tables at one scale, each opened once, and views over them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._opened: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._opened:
            self._opened[name] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self._opened[name]

    def view(self, sql: str) -> DataFrame:
        used = {name: self.table(name) for name in DRIVER_TABLES if "{" + name + "}" in sql}
        return self.spark.sql(sql, **used)


def custom_properties(tables: Tables) -> DataFrame:
    """The usages of each feed as its repeated record."""
    usages = tables.view(USAGES).groupBy("custkey").agg(
        F.collect_list(F.struct("property", "namespace", "entity_type", "presence_pct")).alias(
            "custom_properties"
        )
    )
    feeds = tables.view(PROPERTY_FEEDS)
    return feeds.join(usages, F.col("custkey") == F.col("c_custkey"), "left").drop("c_custkey", "custkey")


def notifications(tables: Tables) -> DataFrame:
    text = F.lit(None).cast("string")
    return tables.view(NOTIFICATIONS).withColumns(
        {
            "monitors": F.array(F.lit("dataset_stall")),
            "stakeholder": text,
            "contact": text,
            "notes": text,
        }
    )


def duck_view(sql: str) -> str:
    return sql.format(**{name: name for name in DRIVER_TABLES})
