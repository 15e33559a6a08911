"""The same results in plain SQL, written row by row rather than the way the plans do it.

Trends are evaluated per day against the whole history, declines from each day's own list of
observations, growth from month lists with EXCEPT-style tests.
"""

from __future__ import annotations

from checks import views
from checks.catalog import NARROW, ONE_PROVIDER, ONE_TRUST, PLACE
from tidewatch.schemas import COMPLETENESS_COLUMNS, SOCIO_MEASURES

AS_OF = "DATE '2024-01-30'"


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(parts)


def _view(name: str, sql: str) -> str:
    return f"{name} AS ({views.duck_view(sql)})"


INGESTION = _view("ingestion", views.INGESTION)
REFERENCES = _view("refs", views.REFERENCES)
OPPORTUNITIES = _view("opportunities", views.OPPORTUNITIES)
SUMMARY = _view("summary", views.SUMMARY)
INSIGHT = _view("insight_runs", views.INSIGHT_RUNS)
CRAWLS = _view("crawls", views.GROWTH_CRAWLS)
RUNS = _view("runs", views.GROWTH_INGESTION)
FEEDS = _view("feeds", views.FEEDS)
SUPPLIER_FEEDS = _view("supplier_feeds", views.SUPPLIER_FEEDS)
QUALITY = _view("quality", views.QUALITY)
USAGES = _view("usages", views.USAGES)
PROPERTY_FEEDS = _view("property_feeds", views.PROPERTY_FEEDS)
NOTIFICATIONS = _view("notifications", views.NOTIFICATIONS)
SOCIO = _view("socio", views.SOCIO)
SITE_CELLS = _view("cells", views.SITE_CELLS)


def pub_id(name: str) -> str:
    return (
        f"'pub_' || coalesce(nullif(trim(regexp_replace(lower(coalesce({name}, '')), "
        f"'[^\\p{{L}}\\p{{Nd}}]+', '-', 'g'), '-'), ''), 'unknown')"
    )


def dataset_name(url: str, name: str) -> str:
    return (
        f"coalesce(CASE WHEN regexp_matches({name}, '\\S') THEN {name} END, "
        f"lower(nullif(regexp_extract({url}, '^[A-Za-z]+://([^/]+)', 1), '')), {url})"
    )


def feed_name(feed_id: str, url: str) -> str:
    return (
        f"coalesce(nullif(regexp_extract(regexp_replace({url}, '/+$', ''), '([^/]+)$', 1), ''), {feed_id})"
    )


def percent(drop: str, start: str) -> str:
    return (
        f"CASE WHEN {start} <= 0 THEN 0.0 ELSE "
        f"round_even(greatest({drop}, 0)::DOUBLE * 100 / {start} * 100, 0) / 100 END"
    )


DATASET_NAMES = """names AS (
  SELECT u.dataset_id,
         (SELECT min(publisher_name) FROM feeds WHERE dataset_url = u.dataset_id) AS publisher_name,
         (SELECT min(dataset_name) FROM quality WHERE dataset_url = u.dataset_id) AS dataset_name
  FROM (SELECT dataset_url AS dataset_id FROM feeds UNION SELECT dataset_url FROM quality) AS u
)"""
FEED_NAMES = """feed_names AS (
  SELECT f.id AS feed_id, f.url AS feed_url, f.type AS feed_type, f.publisher_name, q.score AS quality_score
  FROM feeds AS f LEFT JOIN quality AS q ON q.feed_id = f.id
)"""
NAMES = (FEEDS, QUALITY, DATASET_NAMES, FEED_NAMES)

SPINE_30 = f"spine AS (SELECT unnest(generate_series({AS_OF} - 29, {AS_OF}, INTERVAL 1 DAY))::DATE AS d)"
RECENT_10 = f"recent AS (SELECT unnest(generate_series({AS_OF} - 9, {AS_OF}, INTERVAL 1 DAY))::DATE AS d)"

_OPEN = "CAST(NULL AS VARCHAR) AS last_contacted, 'open' AS status"


def _identity(monitor: str) -> str:
    return (
        f"'{monitor}' AS monitor_id, {_OPEN}, {pub_id('n.publisher_name')} AS publisher_id, "
        f"coalesce(n.publisher_name, '') AS publisher_name, {dataset_name('i.dataset_id', 'n.dataset_name')} AS dataset_name, "
        "i.dataset_id AS dataset_url"
    )


def _feed_identity(monitor: str) -> str:
    return (
        f"'{monitor}' AS monitor_id, {_OPEN}, {pub_id('f.publisher_name')} AS publisher_id, "
        f"coalesce(f.publisher_name, '') AS publisher_name, {dataset_name('i.dataset_id', 'n.dataset_name')} AS dataset_name, "
        f"i.dataset_id AS dataset_url, i.feed_id, {feed_name('i.feed_id', 'f.feed_url')} AS feed_name, "
        "f.feed_type, f.feed_url, round(f.quality_score, 6) AS quality_score"
    )


# ---------------------------------------------------------------- orphans

ORPHAN_BASE = (
    REFERENCES,
    """children AS (
  SELECT dataset_url, kind,
         CASE WHEN json_type(has_superEvent) = 'VARCHAR' THEN trim(json_extract_string(has_superEvent, '$'), '"') END AS parent_id,
         location IS NULL OR json_type(location) = 'NULL' OR replace(location, ' ', '') = '{}' AS unplaced
  FROM refs WHERE kind IN ('Slot', 'ScheduledSession') AND dataset_url IS NOT NULL
)""",
    """judged AS (
  SELECT c.*, c.parent_id IS NOT NULL AND c.unplaced AS checked,
         c.parent_id IS NOT NULL AND c.unplaced AND NOT EXISTS (
           SELECT 1 FROM refs AS p WHERE p.dataset_url = c.dataset_url AND p.data_id = c.parent_id) AS orphan
  FROM children AS c
)""",
    """kinds AS (
  SELECT dataset_url, kind, count(*) AS child_count, count(*) FILTER (WHERE checked) AS checked_count,
         count(*) FILTER (WHERE orphan) AS orphan_count,
         count(DISTINCT parent_id) FILTER (WHERE orphan) AS missing_parent_count
  FROM judged GROUP BY dataset_url, kind
)""",
    """found AS (
  SELECT dataset_url AS dataset_id, sum(child_count)::BIGINT AS child_count, sum(checked_count)::BIGINT AS checked_count,
         sum(orphan_count)::BIGINT AS orphan_count, sum(missing_parent_count)::BIGINT AS missing_parent_count
  FROM kinds GROUP BY dataset_url
  HAVING sum(orphan_count) >= 10 AND sum(orphan_count)::DOUBLE / sum(child_count) >= 0.05
)""",
)

ORPHANED_CHILDREN = f"""{_with(*ORPHAN_BASE, *NAMES)}
SELECT {_identity('dataset_orphaned_children')}, i.child_count, i.checked_count, i.orphan_count,
       i.missing_parent_count, round(i.orphan_count::DOUBLE / i.child_count, 6) AS orphan_share,
       i.orphan_count >= 30 AS past_threshold
FROM found AS i LEFT JOIN names AS n USING (dataset_id)"""

ORPHANS_BY_KIND = f"""{_with(*ORPHAN_BASE)}
SELECT k.* FROM kinds AS k WHERE dataset_url IN (SELECT dataset_id FROM found)"""

MISSING_PARENTS = f"""{_with(*ORPHAN_BASE)},
per_parent AS (
  SELECT dataset_url, kind, parent_id, count(*) AS child_count FROM judged WHERE orphan GROUP BY ALL
),
sampled AS (
  SELECT * FROM per_parent
  QUALIFY row_number() OVER (PARTITION BY dataset_url, kind ORDER BY child_count DESC, parent_id) <= 5
)
SELECT dataset_url, parent_id AS missing_id, child_count,
       row_number() OVER (PARTITION BY dataset_url ORDER BY child_count DESC, parent_id, kind) AS position
FROM sampled
WHERE parent_id <> '' AND dataset_url IN (SELECT dataset_id FROM found)
QUALIFY position <= 5"""

MISSING_PARENTS_ALL = f"""{_with(*ORPHAN_BASE)}
SELECT dataset_url, kind, parent_id AS missing_id, count(*) AS child_count FROM judged
WHERE orphan AND parent_id <> '' AND dataset_url IN (SELECT dataset_id FROM found) GROUP BY ALL"""

# ---------------------------------------------------------------- stalls

DAYS = f"""days AS (
  SELECT feed_id, ingestion_date::DATE AS d, sum(updated)::BIGINT AS updated,
         first(dataset_id ORDER BY ingestion_date DESC, dataset_id) AS dataset_id
  FROM ingestion
  WHERE ingestion_date::DATE <= {AS_OF} AND feed_id IS NOT NULL AND dataset_id IS NOT NULL
    AND ingestion_date::DATE > (SELECT min(ingestion_date::DATE) FROM ingestion)
  GROUP BY ALL
)"""
SILENT = f"""silent AS (
  SELECT feed_id, first(dataset_id ORDER BY d DESC) AS dataset_id, max(d) FILTER (WHERE updated > 0) AS last_published
  FROM days GROUP BY feed_id
)"""
FEED_TREND = """feed_trend AS (
  SELECT f.feed_id, r.d, CASE WHEN x.feed_id IS NOT NULL THEN coalesce(x.updated, 0) END AS v
  FROM silent AS f CROSS JOIN recent AS r LEFT JOIN days AS x ON x.feed_id = f.feed_id AND x.d = r.d
)"""
STALL_BASE = (INGESTION, DAYS, SILENT, RECENT_10, FEED_TREND)

SINGLE_FEED_STALLS = f"""{_with(*STALL_BASE, *NAMES)}
SELECT {_feed_identity('single_feed_stall')},
       i.last_published::VARCHAR AS last_published, i.last_published::VARCHAR AS first_detected,
       {AS_OF} - i.last_published AS consecutive_days, {AS_OF} - i.last_published AS days_open,
       {AS_OF} - i.last_published >= 7 AS past_threshold,
       (SELECT string_agg(coalesce(v::VARCHAR, '~'), ',' ORDER BY d) FROM feed_trend AS t WHERE t.feed_id = i.feed_id) AS trend
FROM silent AS i LEFT JOIN feed_names AS f USING (feed_id) LEFT JOIN names AS n ON n.dataset_id = i.dataset_id
WHERE {AS_OF} - i.last_published BETWEEN 3 AND 120
  AND EXISTS (SELECT 1 FROM silent AS o WHERE o.dataset_id = i.dataset_id AND {AS_OF} - o.last_published < 3)"""

STALLED_DATASETS = f"""stalled AS (
  SELECT dataset_id, max(last_published) AS last_published, count(*) AS feed_count FROM silent
  GROUP BY dataset_id HAVING {AS_OF} - max(last_published) BETWEEN 3 AND 120
)"""

DATASET_STALLS = f"""{_with(*STALL_BASE, STALLED_DATASETS, *NAMES)},
sums AS (
  SELECT dataset_id, d, sum(v)::BIGINT AS v FROM feed_trend JOIN silent USING (feed_id) GROUP BY ALL
)
SELECT {_identity('dataset_stall')}, i.feed_count,
       i.last_published::VARCHAR AS last_published, i.last_published::VARCHAR AS first_detected,
       {AS_OF} - i.last_published AS consecutive_days, {AS_OF} - i.last_published AS days_open,
       {AS_OF} - i.last_published >= 7 AS past_threshold,
       (SELECT string_agg(coalesce(v::VARCHAR, '~'), ',' ORDER BY d) FROM sums AS t WHERE t.dataset_id = i.dataset_id) AS trend
FROM stalled AS i LEFT JOIN names AS n USING (dataset_id)"""

DATASET_STALL_FEEDS = f"""{_with(*STALL_BASE, STALLED_DATASETS, *NAMES)}
SELECT s.dataset_id AS dataset_url, s.feed_id, s.last_published::VARCHAR AS last_published,
       {AS_OF} - s.last_published AS consecutive_days,
       {feed_name('s.feed_id', 'f.feed_url')} AS feed_name, f.feed_type
FROM silent AS s LEFT JOIN feed_names AS f USING (feed_id)
WHERE s.dataset_id IN (SELECT dataset_id FROM stalled)"""

STATES = """states AS (
  SELECT s.d, f.feed_id, f.dataset_id,
         s.d - (SELECT max(p.d) FROM days AS p WHERE p.feed_id = f.feed_id AND p.updated > 0 AND p.d <= s.d) AS silent_days
  FROM spine AS s CROSS JOIN silent AS f
)"""
STALL_TRENDS = f"""feed_points AS (
  SELECT s.d, count(*) FILTER (WHERE is_open) AS open_count, count(*) FILTER (WHERE is_open AND silent_days >= 7) AS past_threshold_count
  FROM (
    SELECT a.*, a.silent_days BETWEEN 3 AND 120 AND EXISTS (
      SELECT 1 FROM states AS b WHERE b.d = a.d AND b.dataset_id = a.dataset_id AND b.silent_days < 3) AS is_open
    FROM states AS a
  ) AS s GROUP BY s.d
),
dataset_points AS (
  SELECT d, count(*) FILTER (WHERE m BETWEEN 3 AND 120) AS open_count,
         count(*) FILTER (WHERE m BETWEEN 7 AND 120) AS past_threshold_count
  FROM (SELECT d, dataset_id, min(silent_days) AS m FROM states GROUP BY ALL) AS t GROUP BY d
)"""
TREND_BASE = (INGESTION, DAYS, SILENT, SPINE_30, STATES, STALL_TRENDS)
_POINTS = "d::VARCHAR AS day, open_count, past_threshold_count"
SINGLE_FEED_TREND = f"{_with(*TREND_BASE)} SELECT {_POINTS} FROM feed_points"
DATASET_TREND = f"{_with(*TREND_BASE)} SELECT {_POINTS} FROM dataset_points"

# ---------------------------------------------------------------- errors

ERROR_DAYS = f"""error_days AS (
  SELECT feed_id, ingestion_date::DATE AS d,
         CASE WHEN bool_or(status = 'COMPLETE') THEN 'complete' WHEN bool_or(status = 'ERROR') THEN 'error'
              ELSE min(lower(status)) END AS day_status,
         first(struct_pack(failed := status = 'ERROR', code := error_code, message := warning_message)
               ORDER BY ingestion_date DESC) AS latest
  FROM ingestion WHERE ingestion_date::DATE BETWEEN {AS_OF} - %d AND {AS_OF} GROUP BY ALL
),
failures AS (
  SELECT e.feed_id, e.d, CASE WHEN latest.failed THEN latest.code END AS error_code,
         CASE WHEN latest.failed THEN latest.message END AS error_message,
         (SELECT max(c.d) FROM error_days AS c WHERE c.feed_id = e.feed_id AND c.day_status = 'complete' AND c.d <= e.d) AS last_completed
  FROM error_days AS e WHERE day_status = 'error'
),
error_incidents AS (
  SELECT *, d - last_completed AS failing FROM failures
  WHERE coalesce(error_code NOT IN ('401', '403'), true) AND d - last_completed BETWEEN 1 AND 15
)"""

FEED_ERRORS = f"""{_with(INGESTION, ERROR_DAYS % 15, RECENT_10, *NAMES)},
found AS (
  SELECT e.*, (SELECT min(dataset_id) FROM ingestion AS x WHERE x.feed_id = e.feed_id
               AND x.ingestion_date::DATE BETWEEN {AS_OF} - 15 AND {AS_OF}) AS dataset_id
  FROM error_incidents AS e WHERE d = {AS_OF}
)
SELECT {_feed_identity('feed_ingestion_error')}, i.last_completed::VARCHAR AS last_completed,
       (i.last_completed + 1)::VARCHAR AS first_detected, i.failing AS consecutive_days, i.failing AS days_open,
       i.failing >= 3 AS past_threshold, i.error_code, i.error_message,
       (SELECT string_agg(CASE WHEN EXISTS (SELECT 1 FROM error_days AS x WHERE x.feed_id = i.feed_id AND x.d = r.d
                                            AND x.day_status = 'error') THEN '1' ELSE '0' END, ',' ORDER BY r.d)
        FROM recent AS r) AS trend
FROM found AS i LEFT JOIN feed_names AS f USING (feed_id) LEFT JOIN names AS n ON n.dataset_id = i.dataset_id"""

ERROR_TREND = f"""{_with(INGESTION, ERROR_DAYS % 44, SPINE_30)}
SELECT s.d::VARCHAR AS day, count(e.feed_id) AS open_count,
       count(e.feed_id) FILTER (WHERE e.failing >= 3) AS past_threshold_count
FROM spine AS s LEFT JOIN error_incidents AS e ON e.d = s.d GROUP BY s.d"""

# ---------------------------------------------------------------- decline


def _decline(days_back: int, spine: str) -> tuple[str, ...]:
    return (
        INGESTION,
        spine,
        f"""levels AS (
  SELECT feed_id, ingestion_date::DATE AS d,
         first(dataset_id ORDER BY ingestion_date DESC, dataset_id) AS dataset_id,
         first(total_future_opportunities ORDER BY ingestion_date DESC, total_future_opportunities DESC) AS future,
         coalesce(sum(updated), 0)::BIGINT AS updated, coalesce(sum(actual_deletes), 0)::BIGINT AS deletes
  FROM ingestion
  WHERE ingestion_date::DATE BETWEEN {AS_OF} - {days_back} AND {AS_OF} AND status = 'COMPLETE'
    AND total_future_opportunities IS NOT NULL AND (kind IS NULL OR kind <> 'Slot')
  GROUP BY ALL
)""",
        "owners AS (SELECT feed_id, first(dataset_id ORDER BY d DESC) AS dataset_id FROM levels GROUP BY feed_id)",
        f"""points AS (
  SELECT *, previous IS NOT NULL AND future < previous AS fell,
         CASE WHEN future < previous THEN {percent('previous - future', 'previous')} ELSE 0 END AS step
  FROM (
    SELECT s.d AS as_of, l.*, lag(l.future) OVER w AS previous, lag(l.d) OVER w AS previous_day
    FROM spine AS s JOIN levels AS l ON l.d BETWEEN s.d - 4 AND s.d
    WINDOW w AS (PARTITION BY s.d, l.feed_id ORDER BY l.d)
  ) AS p
)""",
        """observed AS (
  SELECT p.as_of, p.feed_id, count(*) AS n, arg_min(future, d) AS start_future, arg_max(future, d) AS current_future,
         max(d) AS last_day, bool_and(previous IS NULL OR fell) AS monotonic, max(step) AS largest,
         first(previous_day ORDER BY step DESC, d) AS steepest_day, max(d) FILTER (WHERE NOT fell) AS run_start,
         sum(updated)::BIGINT AS updated_in_window, sum(deletes)::BIGINT AS deletes_in_window,
         (SELECT arg_min(q.future, q.d) FROM levels AS q WHERE q.feed_id = p.feed_id
            AND q.d BETWEEN p.as_of - 9 AND p.as_of) AS qualify_start_future
  FROM points AS p GROUP BY p.as_of, p.feed_id
)""",
        f"""declines AS (
  SELECT o.*, owners.dataset_id, start_future - current_future AS fall,
         {percent('start_future - current_future', 'start_future')} AS drop_percent,
         {percent('qualify_start_future - current_future', 'qualify_start_future')} AS qualify_drop_percent,
         updated_in_window - deletes_in_window AS delta_in_window,
         CASE WHEN monotonic AND largest >= 10 THEN 'both' WHEN monotonic THEN 'monotonic_decline' ELSE 'sharp_drop' END AS reason,
         CASE WHEN run_start < last_day THEN run_start WHEN largest > 0 THEN steepest_day ELSE last_day END AS decline_start
  FROM observed AS o JOIN owners USING (feed_id)
  WHERE n >= 3 AND start_future >= 50 AND (monotonic OR largest >= 10)
    AND ({percent('qualify_start_future - current_future', 'qualify_start_future')} >= 10
         OR updated_in_window - deletes_in_window < 0)
)""",
    )


ONE_DAY = f"spine AS (SELECT {AS_OF} AS d)"

DECLINE = f"""{_with(*_decline(10, ONE_DAY), RECENT_10, *NAMES)},
folded AS (
  SELECT dataset_id, count(*) AS feed_count, min(decline_start) AS first_detected,
         CASE WHEN count(DISTINCT reason) = 1 THEN min(reason) ELSE 'both' END AS reason,
         sum(start_future)::BIGINT AS start_total, sum(current_future)::BIGINT AS current_total,
         sum(qualify_start_future)::BIGINT AS qualify_start_total
  FROM declines GROUP BY dataset_id
),
sums AS (
  SELECT x.dataset_id, r.d, sum(l.future)::BIGINT AS v
  FROM declines AS x CROSS JOIN recent AS r LEFT JOIN levels AS l ON l.feed_id = x.feed_id AND l.d = r.d GROUP BY ALL
)
SELECT {_identity('dataset_future_decline')}, i.feed_count, i.first_detected::VARCHAR AS first_detected, i.reason,
       i.start_total, i.current_total, i.qualify_start_total, 5 AS window_days, 10 AS qualify_window_days,
       {AS_OF} - i.first_detected AS consecutive_days, {AS_OF} - i.first_detected AS days_open,
       i.start_total - i.current_total AS drop, {percent('i.start_total - i.current_total', 'i.start_total')} AS drop_percent,
       {percent('i.qualify_start_total - i.current_total', 'i.qualify_start_total')} AS qualify_drop_percent,
       {percent('i.start_total - i.current_total', 'i.start_total')} >= 25 AS past_threshold,
       (SELECT string_agg(coalesce(v::VARCHAR, '~'), ',' ORDER BY d) FROM sums AS t WHERE t.dataset_id = i.dataset_id) AS trend
FROM folded AS i LEFT JOIN names AS n USING (dataset_id)"""

DECLINE_FEEDS = f"""{_with(*_decline(10, ONE_DAY), *NAMES)}
SELECT x.feed_id, x.dataset_id AS dataset_url, x.reason, x.start_future, x.current_future, x.qualify_start_future,
       x.fall AS drop, x.drop_percent, x.qualify_drop_percent, x.largest AS largest_daily_drop_percent,
       x.updated_in_window, x.deletes_in_window, x.delta_in_window,
       {AS_OF} - x.decline_start AS consecutive_declining_days,
       {feed_name('x.feed_id', 'f.feed_url')} AS feed_name, f.feed_type
FROM declines AS x LEFT JOIN feed_names AS f USING (feed_id)"""

DECLINE_TREND_PARTS = _decline(39, SPINE_30) + (
    f"""decline_points AS (
  SELECT s.d, count(t.dataset_id) AS open_count, count(t.dataset_id) FILTER (WHERE t.p >= 25) AS past_threshold_count
  FROM spine AS s LEFT JOIN (
    SELECT as_of, dataset_id, {percent('sum(start_future) - sum(current_future)', 'sum(start_future)')} AS p
    FROM declines GROUP BY as_of, dataset_id) AS t ON t.as_of = s.d
  GROUP BY s.d
)""",
)
DECLINE_TREND = f"{_with(*DECLINE_TREND_PARTS)} SELECT {_POINTS} FROM decline_points"

# ---------------------------------------------------------------- estate
# The tiles use each monitor's defaults (stall after five days) over the last seven days.

SPINE_7 = f"spine AS (SELECT unnest(generate_series({AS_OF} - 6, {AS_OF}, INTERVAL 1 DAY))::DATE AS d)"
TILES = _with(
    *_decline(16, SPINE_7), DAYS, SILENT, STATES, ERROR_DAYS % 21,
    STALL_TRENDS.replace("BETWEEN 3 AND", "BETWEEN 5 AND").replace("silent_days < 3", "silent_days < 5"),
    DECLINE_TREND_PARTS[-1],
    *ORPHAN_BASE,
    """error_points AS (
  SELECT s.d, count(e.feed_id) AS open_count, count(e.feed_id) FILTER (WHERE e.failing >= 3) AS past_threshold_count
  FROM spine AS s LEFT JOIN error_incidents AS e ON e.d = s.d GROUP BY s.d
)""",
    """all_points AS (
  SELECT 1 AS position, 'single_feed_stall' AS monitor_id, * FROM feed_points
  UNION ALL SELECT 2, 'dataset_stall', * FROM dataset_points
  UNION ALL SELECT 3, 'feed_ingestion_error', * FROM error_points
  UNION ALL SELECT 4, 'dataset_future_decline', * FROM decline_points
)""",
    f"""tiles AS (
  SELECT monitor_id, position, sum(open_count) FILTER (WHERE d = {AS_OF})::BIGINT AS count,
         sum(past_threshold_count) FILTER (WHERE d = {AS_OF})::BIGINT AS past_threshold_count,
         string_agg(open_count::VARCHAR, ',' ORDER BY d) AS sparkline,
         (sum(open_count) FILTER (WHERE d = {AS_OF}) - sum(open_count) FILTER (WHERE d = {AS_OF} - 1))::BIGINT AS count_delta,
         (sum(past_threshold_count) FILTER (WHERE d = {AS_OF})
            - sum(past_threshold_count) FILTER (WHERE d = {AS_OF} - 1))::BIGINT AS past_threshold_delta
  FROM all_points GROUP BY monitor_id, position
  UNION ALL
  SELECT 'dataset_orphaned_children', 5, coalesce(sum(orphan_count), 0)::BIGINT, 0, '', NULL, NULL FROM found
)""",
)
MONITOR_TILES = f"{TILES} SELECT * FROM tiles"
ERRORS_TODAY = f"""SELECT count(DISTINCT dataset_id) AS publishers_with_issues FROM ingestion
WHERE status = 'ERROR' AND ingestion_date::DATE >= {AS_OF}"""
HEADLINE = f"""{TILES}, {CRAWLS}
SELECT number_of_datasets AS publishers_monitored, number_of_datasets AS datasets, number_of_feeds AS feeds,
       ({ERRORS_TODAY}) AS publishers_with_issues,
       CAST(NULL AS BIGINT) AS open_incidents, CAST(NULL AS BIGINT) AS past_threshold,
       CAST(NULL AS BIGINT) AS open_incidents_delta,
       (SELECT sum(count_delta)::BIGINT FROM tiles) AS publishers_with_issues_delta,
       (SELECT sum(past_threshold_delta)::BIGINT FROM tiles) AS past_threshold_delta,
       strftime(ingestion_date, '%Y-%m-%d %H:%M:%S') AS generated_at
FROM crawls ORDER BY ingestion_date DESC LIMIT 1"""

# ---------------------------------------------------------------- public


def quoted(values) -> str:
    return ", ".join(f"'{value}'" for value in values)


def labels(column: str) -> str:
    """Scalar elements of a JSON array column."""
    return (
        f"list_filter(list_transform(json_extract({column}, '$[*]'), "
        "lambda x: CASE WHEN json_type(x) NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(x, '$') END), "
        "lambda x: x IS NOT NULL)"
    )


def has(column: str, values) -> str:
    return f"coalesce(list_has_any({labels(column)}, [{quoted(values)}]), false)"


_HOUR = "'%Y-%m-%d %H:%M:%S'"
_NARROW = (
    f"(district_code IN ({quoted(NARROW.district)}) OR region_code IN ({quoted(NARROW.region)}) "
    f"OR country_code IN ({quoted(NARROW.country)})) AND {has('activity_or_facility', NARROW.activity)} "
    f"AND {has('organization_names', NARROW.organization)}"
)
_PLACE = (
    f"region_code IN ({quoted(PLACE.region)}) AND nhstrust_code IN ({quoted(PLACE.nhs_trust)}) AND "
)
_SUMMARY_ROWS = "SELECT * EXCLUDE (opportunity_count, opportunity_count_narrow), opportunity_count_narrow AS opportunity_count FROM summary"
_LIVE = (
    "startDate >= DATE '2001-01-01' AND coalesce(district_name, '') <> '' AND coalesce(publisher_name, '') <> ''"
)
_RECORDS = f"""SELECT * EXCLUDE (nhstrust_code) REPLACE (strftime(startDate, {_HOUR}) AS startDate,
       strftime(endDate, {_HOUR}) AS endDate, last_updated::VARCHAR AS last_updated)
FROM opportunities WHERE {_LIVE} AND kind <> 'Slot'"""

PUBLIC_SUMMARY = f"""{_with(SUMMARY, INSIGHT)}
SELECT (SELECT sum(opportunity_count_narrow)::BIGINT FROM summary) AS number_of_opportunities,
       (SELECT count(DISTINCT publisher) FROM summary) AS number_of_publishers,
       (SELECT count(DISTINCT x) FROM (SELECT unnest({labels('activity_or_facility')}) AS x FROM summary WHERE is_activity)) AS number_of_activities,
       (SELECT count(DISTINCT x) FROM (SELECT unnest({labels('activity_or_facility')}) AS x FROM summary WHERE NOT is_activity)) AS number_of_facility_types,
       (SELECT sum(opportunity_count_narrow)::BIGINT FROM summary WHERE NOT is_activity) AS number_of_facilities,
       74 AS percentage_of_local_authorities,
       (SELECT count(DISTINCT x) FROM (SELECT unnest({labels('organization_names')}) AS x FROM summary)) AS number_of_activity_providers,
       (SELECT strftime(max(run_date), {_HOUR}) FROM insight_runs) AS date"""

RECORD_PAGE = f"""{_with(OPPORTUNITIES)}, hits AS (
  SELECT * FROM opportunities WHERE {_LIVE} AND kind <> 'Slot' AND {_PLACE}
    ({has('activity', PLACE.activity)} OR {has('facility', PLACE.activity)})
  ORDER BY startDate, feed_id, id LIMIT 20 OFFSET 5
)
SELECT * EXCLUDE (nhstrust_code) REPLACE (strftime(startDate, {_HOUR}) AS startDate,
       strftime(endDate, {_HOUR}) AS endDate, last_updated::VARCHAR AS last_updated),
       (SELECT count(*) FROM opportunities WHERE {_LIVE} AND kind <> 'Slot' AND {_PLACE}
        ({has('activity', PLACE.activity)} OR {has('facility', PLACE.activity)})) > 25 AS has_more
FROM hits"""


_PLACE_HITS = f"""{_LIVE} AND kind <> 'Slot' AND {_PLACE}
    ({has('activity', PLACE.activity)} OR {has('facility', PLACE.activity)})"""
RECORDS_AFTER = f"""{_with(OPPORTUNITIES)}, later AS (
  SELECT * FROM opportunities WHERE {_PLACE_HITS} AND (startDate, feed_id, id) > (TIMESTAMP '2001-03-01', 'feed-3', '5')
)
SELECT * EXCLUDE (nhstrust_code) REPLACE (strftime(startDate, {_HOUR}) AS startDate,
       strftime(endDate, {_HOUR}) AS endDate, last_updated::VARCHAR AS last_updated),
       (SELECT count(*) FROM later) > 20 AS has_more
FROM later ORDER BY later.startDate, feed_id, id LIMIT 20"""


def _areas(where: str) -> str:
    return f"""{_with(SUMMARY, SOCIO)}, tuples AS (
  SELECT DISTINCT country_name, country_code, region_name, region_code, district_name, district_code FROM summary
  WHERE country_name IS NOT NULL AND district_name IS NOT NULL AND {where}
),
plain AS (SELECT DISTINCT country_name FROM tuples WHERE coalesce(trim(region_name), '') = ''),
nodes AS (
  SELECT 'country' AS level, country_name, NULL::VARCHAR AS region_name, NULL::VARCHAR AS district_name, min(country_code) AS code
  FROM tuples GROUP BY country_name
  UNION ALL
  SELECT 'region', country_name, region_name, NULL, min(region_code) FROM tuples
  WHERE region_name IS NOT NULL AND country_name NOT IN (SELECT country_name FROM plain) GROUP BY country_name, region_name
  UNION ALL
  SELECT DISTINCT 'district', country_name, region_name, district_name, district_code FROM tuples
  WHERE region_name IS NULL OR country_name NOT IN (SELECT country_name FROM plain)
)"""


_SOCIO_COLUMNS = ", ".join(["area_name", "total_population", *SOCIO_MEASURES])
AREAS = f"""{_areas('true')}
SELECT nodes.*, {_SOCIO_COLUMNS} FROM nodes LEFT JOIN socio ON area_code = code"""
_DISTRICT_TEXT = "string_agg(':' || district_name || ':' || code || ':' || total_population, ',' ORDER BY upper(district_name))"
AREA_TREE = f"""{_areas('true')}, full_nodes AS (SELECT nodes.*, total_population FROM nodes LEFT JOIN socio ON area_code = code)
SELECT country_name, code AS country_code, total_population AS population,
  (SELECT string_agg(r.region_name || ':' || r.code || ':' || r.total_population || ':' ||
     (SELECT {_DISTRICT_TEXT} FROM full_nodes AS d
      WHERE d.level = 'district' AND d.country_name = r.country_name AND d.region_name = r.region_name),
     ';' ORDER BY upper(r.region_name)) FROM full_nodes AS r WHERE r.level = 'region' AND r.country_name = c.country_name) AS regions,
  (SELECT {_DISTRICT_TEXT} FROM full_nodes AS d
   WHERE d.level = 'district' AND d.country_name = c.country_name AND d.region_name IS NULL) AS districts
FROM full_nodes AS c WHERE level = 'country'"""
AREAS_FILTERED = f"""{_areas(has('activity_or_facility', ['Brand#7']) + " AND nhstrust_code IN ('T3', 'T6')")}
SELECT * FROM nodes"""

QUALITY_PUBLIC = (
    "SELECT dataset_name, {url} AS dataset_url, feed_type, feed_url, status, warnings, errors, "
    + ", ".join(COMPLETENESS_COLUMNS)
    + f", num_future_opportunity_items, feed_version, strftime(last_assessed, {_HOUR}) AS last_assessed FROM quality"
)
_SHORT_URL = "regexp_replace(dataset_url, 'd\\d*(\\d)\\.example', 'd\\1.example')"

# ---------------------------------------------------------------- quality and drift

ASSESSED = """assessed AS (
  SELECT q.*, (SELECT min(publisher_name) FROM feeds AS f WHERE f.dataset_url = q.dataset_url) AS publisher_name FROM quality AS q
)"""
_QUALITY_ROW = f"""SELECT * EXCLUDE (publisher_name) REPLACE ({dataset_name('dataset_url', 'dataset_name')} AS dataset_name,
       round(score, 6) AS score, strftime(last_assessed, {_HOUR}) AS last_assessed),
       {pub_id('publisher_name')} AS publisher_id, coalesce(publisher_name, '') AS publisher_name FROM assessed"""
_STATUS = "upper(trim(status))"
QUALITY_SUMMARY = f"""{_with(FEEDS, QUALITY, ASSESSED)}
SELECT count(*) AS total_feeds, count(DISTINCT lower(dataset_url)) AS total_datasets,
       count(DISTINCT lower(publisher_name)) AS total_publishers,
       count(*) FILTER (WHERE is_regular) AS regular_feeds, count(*) FILTER (WHERE NOT is_regular) AS irregular_feeds,
       count(*) FILTER (WHERE is_regular IS NULL) AS regularity_unknown,
       count(*) FILTER (WHERE {_STATUS} = 'OK') AS feeds_ok, count(*) FILTER (WHERE {_STATUS} = 'WARNING') AS feeds_with_warnings,
       count(*) FILTER (WHERE {_STATUS} = 'ERROR') AS feeds_with_errors,
       count(*) FILTER (WHERE status IS NULL OR {_STATUS} NOT IN ('OK', 'WARNING', 'ERROR')) AS feeds_status_unknown,
       count(DISTINCT lower(dataset_url)) FILTER (WHERE {_STATUS} = 'ERROR') AS datasets_with_errors,
       count(*) FILTER (WHERE num_future_opportunity_items > 0) AS feeds_with_future_data,
       count(DISTINCT lower(dataset_url)) FILTER (WHERE num_future_opportunity_items > 0) AS datasets_with_future_data,
       sum(num_future_opportunity_items)::BIGINT AS total_future_opportunity_items,
       count(score) AS feeds_scored, round(avg(score), 6) AS average_score, round(median(score), 6) AS median_score,
       round(min(score), 6) AS min_score, round(max(score), 6) AS max_score,
       strftime(min(last_assessed), {_HOUR}) AS oldest_assessment, strftime(max(last_assessed), {_HOUR}) AS newest_assessment
FROM assessed"""
COMPLETENESS = f"{_with(QUALITY)} " + " UNION ALL ".join(
    f"SELECT {i} AS position, '{name.removesuffix('_completeness')}' AS field, round(avg({name}), 6) AS average, "
    f"count({name}) AS feeds_reporting FROM quality"
    for i, name in enumerate(COMPLETENESS_COLUMNS)
)
HISTOGRAM = f"""{_with(QUALITY)}
SELECT b * 20 AS lower, b * 20 + 20 AS upper,
       (SELECT count(*) FROM quality WHERE score IS NOT NULL AND least(greatest(trunc(score / 20), 0), 4) = b) AS feed_count
FROM range(5) AS t(b)"""
BREAKDOWNS = f"""{_with(QUALITY)}, labelled AS (
  SELECT 'status' AS breakdown, status AS raw, * FROM quality UNION ALL SELECT 'grade', grade, * FROM quality
  UNION ALL SELECT 'feed_type', feed_type, * FROM quality UNION ALL SELECT 'feed_version', feed_version, * FROM quality
),
shown AS (SELECT *, coalesce(nullif(trim(raw), ''), 'unknown') AS label FROM labelled)
SELECT breakdown, first(label ORDER BY score DESC NULLS LAST, dataset_url, feed_id) AS value, count(*) AS feed_count,
       count(DISTINCT lower(dataset_url)) AS dataset_count,
       round(count(*)::DOUBLE / (SELECT count(*) FROM quality), 6) AS share
FROM shown GROUP BY breakdown, lower(label)"""

_PROPERTY_TEXT = "struct_pack(property, namespace, entity_type, presence_pct)"
PROPERTY_ROWS = f"""{_with(PROPERTY_FEEDS, USAGES)}
SELECT feed_id, feed_url, feed_type, is_regular, dataset_url, {dataset_name('dataset_url', 'dataset_name')} AS dataset_name,
       {pub_id('publisher_name')} AS publisher_id, coalesce(publisher_name, '') AS publisher_name, sampled_items,
       num_custom_properties, num_custom_property_usages,
       (SELECT string_agg('{{' || property || ', ' || coalesce(namespace, 'null') || ', ' || coalesce(entity_type, 'null')
                          || ', ' || presence_pct::VARCHAR || '}}', ',' ORDER BY presence_pct DESC, property,
                          entity_type NULLS FIRST, namespace NULLS FIRST)
        FROM usages WHERE custkey = c_custkey) AS custom_properties
FROM property_feeds WHERE num_custom_properties > 0"""
_USED = f"{_with(PROPERTY_FEEDS, USAGES)}, used AS (SELECT u.*, f.dataset_url, f.feed_id, f.publisher_name FROM property_feeds AS f JOIN usages AS u ON u.custkey = f.c_custkey WHERE f.num_custom_properties > 0)"
PROPERTY_SUMMARY = f"""{_USED}
SELECT count(*) AS feeds_assessed, count(DISTINCT lower(dataset_url)) AS datasets_assessed,
       count(*) FILTER (WHERE num_custom_properties > 0) AS feeds_with_custom_properties,
       count(DISTINCT lower(dataset_url)) FILTER (WHERE num_custom_properties > 0) AS datasets_with_custom_properties,
       count(DISTINCT lower(publisher_name)) FILTER (WHERE num_custom_properties > 0) AS publishers_with_custom_properties,
       sum(num_custom_property_usages)::BIGINT AS total_custom_property_usages,
       round(count(*) FILTER (WHERE num_custom_properties > 0)::DOUBLE / count(*), 6) AS feed_share,
       (SELECT count(DISTINCT property) FROM used) AS distinct_custom_properties
FROM property_feeds"""
_USED_COUNTS = "count(DISTINCT dataset_url || ' ' || feed_id) AS feed_count, count(DISTINCT lower(dataset_url)) AS dataset_count"
NAMESPACES = f"{_USED} SELECT namespace, count(DISTINCT property) AS property_count, {_USED_COUNTS} FROM used GROUP BY namespace"
ENTITY_TYPES = f"{_USED} SELECT coalesce(entity_type, 'unknown') AS entity_type, count(DISTINCT property) AS property_count, {_USED_COUNTS} FROM used GROUP BY ALL"
PROPERTIES = f"""{_USED} SELECT property, min(namespace) AS namespace, {_USED_COUNTS},
       string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS entity_types FROM used GROUP BY property"""

# ---------------------------------------------------------------- growth

_FIGURES = ("added", "removed", "with_future", "without_future", "stopped", "stopped_all_runs_failed", "not_ingested")


def _growth(first: str, as_of: str) -> tuple[str, ...]:
    """Candidate months from ``first`` on, the history from one month before it."""
    window = f"ingestion_date >= DATE '{first}' - INTERVAL 1 MONTH AND ingestion_date < DATE '{as_of}' + 1"
    return (
        CRAWLS,
        RUNS,
        f"""listings AS (
  SELECT DISTINCT date_trunc('month', ingestion_date)::DATE AS m, json_extract_string(x, '$') AS dataset_id
  FROM (SELECT ingestion_date, unnest(json_extract(datasets, '$[*]')) AS x FROM crawls WHERE {window})
)""",
        f"""activity AS (
  SELECT date_trunc('month', ingestion_date)::DATE AS m, dataset_id, sum(coalesce(updated, 0) + coalesce(deleted, 0)) AS changes,
         max(coalesce(total_future_opportunities, 0)) AS future, bool_and(status = 'ERROR') AS all_failed
  FROM runs WHERE {window} AND dataset_id IS NOT NULL GROUP BY ALL
)""",
        "crawled AS (SELECT m, dataset_id FROM listings UNION SELECT m, dataset_id FROM activity)",
        f"""candidates AS (
  SELECT m, last_day(m) > DATE '{as_of}' AS in_progress,
         (SELECT count(DISTINCT ingestion_date::DATE) FROM crawls WHERE date_trunc('month', ingestion_date) = m AND {window}) AS crawl_days,
         (SELECT count(DISTINCT ingestion_date::DATE) FROM runs WHERE date_trunc('month', ingestion_date) = m AND {window}) AS feed_days,
         (SELECT count(*) FROM crawled AS c WHERE c.m = t.m) AS datasets_crawled,
         (SELECT count(*) FROM crawled AS c WHERE c.m = t.m - INTERVAL 1 MONTH) AS crawled_before
  FROM (SELECT unnest(generate_series(DATE '{first}', DATE '{as_of}', INTERVAL 1 MONTH))::DATE AS m) AS t
)""",
        """months AS (
  SELECT * FROM candidates WHERE (NOT in_progress OR crawl_days >= 5)
    AND m >= (SELECT min(m) FROM candidates WHERE crawl_days + feed_days + datasets_crawled > 0
              AND (NOT in_progress OR crawl_days >= 5))
  ORDER BY m DESC LIMIT 12
)""",
        """figures AS (
  SELECT m, 'added' AS figure, dataset_id FROM crawled AS c
  WHERE NOT EXISTS (SELECT 1 FROM crawled AS p WHERE p.dataset_id = c.dataset_id AND p.m = c.m - INTERVAL 1 MONTH)
  UNION ALL
  SELECT (p.m + INTERVAL 1 MONTH)::DATE, 'removed', dataset_id FROM crawled AS p
  WHERE NOT EXISTS (SELECT 1 FROM crawled AS c WHERE p.dataset_id = c.dataset_id AND c.m = p.m + INTERVAL 1 MONTH)
  UNION ALL SELECT m, 'with_future', dataset_id FROM activity WHERE future > 0
  UNION ALL SELECT m, 'without_future', dataset_id FROM activity WHERE future <= 0
  UNION ALL SELECT m, 'stopped', dataset_id FROM activity WHERE changes = 0
  UNION ALL SELECT m, 'stopped_all_runs_failed', dataset_id FROM activity WHERE changes = 0 AND all_failed
  UNION ALL SELECT m, 'not_ingested', dataset_id FROM crawled AS c
  WHERE NOT EXISTS (SELECT 1 FROM activity AS a WHERE a.m = c.m AND a.dataset_id = c.dataset_id)
)""",
    )


def _figure(name: str) -> str:
    known = "crawled_before > 0" if name in ("added", "removed") else "feed_days > 0"
    return (
        f"CASE WHEN {known} THEN (SELECT count(*) FROM figures AS f WHERE f.m = months.m AND figure = '{name}') END "
        f"AS datasets_{name}"
    )


def _growth_rows(first: str, as_of: str) -> str:
    return f"""{_with(*_growth(first, as_of))}
SELECT m::VARCHAR AS period_start, last_day(m)::VARCHAR AS period_end, in_progress,
       crawl_days AS days_with_data, feed_days AS days_with_feed_data, datasets_crawled,
       {", ".join(_figure(name) for name in _FIGURES)}
FROM months"""


GROWTH = _growth_rows("2000-08-01", "2001-08-01")
GROWTH_IN_PROGRESS = _growth_rows("1994-05-01", "1995-05-20")
GROWTH_DATASETS = f"""{_with(*_growth("2000-08-01", "2001-08-01"), *NAMES)}
SELECT i.m::VARCHAR AS period_start, i.figure, i.dataset_id AS dataset_url, {pub_id('n.publisher_name')} AS publisher_id,
       coalesce(n.publisher_name, '') AS publisher_name, {dataset_name('i.dataset_id', 'n.dataset_name')} AS dataset_name
FROM figures AS i LEFT JOIN names AS n USING (dataset_id)
WHERE i.m IN (SELECT m FROM months) AND i.figure <> 'with_future'"""

# ---------------------------------------------------------------- sites and notifications

_PARTS = "list_filter(list_transform(string_split(oa_publisher_names, '|'), lambda x: trim(x)), lambda x: x <> '')"
_SITE_ROW = f"""SELECT site_id, CASE WHEN trim(site_name) <> '' THEN site_name END AS site_name, local_authority_code,
       site_lat::DOUBLE AS site_lat, try_cast(ap_facility_count AS BIGINT) AS ap_facility_count,
       array_to_string({_PARTS}, ',') AS oa_publisher_names,
       CASE WHEN oa_location_json = '' THEN '' ELSE regexp_replace(oa_location_json, '\\}}\\|\\{{', '}},{{') END AS oa_location_json,
       try_cast(distance_metres AS DOUBLE) AS distance_metres, match_method,
       coalesce(lower(spatial_match) = 'true', false) AS spatial_match, false AS is_mutual_best, '' AS oa_kinds
FROM cells"""
SITES = f"{_with(SITE_CELLS)} {_SITE_ROW}"
SITES_FILTERED = f"""{_with(SITE_CELLS)} {_SITE_ROW}
WHERE local_authority_code IN ('E3', 'E4', 'E15', 'E20') AND lower(match_method) = 'postcode'
  AND list_has_any({_PARTS}, ['Brand#7', 'ECONOMY'])"""

NOTIFICATION_LIST = f"""{_with(NOTIFICATIONS)}
SELECT * REPLACE (date_contacted::VARCHAR AS date_contacted, strftime(created_at, {_HOUR}) AS created_at,
       strftime(updated_at, {_HOUR}) AS updated_at), 'dataset_stall' AS monitors,
       NULL::VARCHAR AS stakeholder, NULL::VARCHAR AS contact, NULL::VARCHAR AS notes
FROM notifications"""
NOTIFICATION_SUMMARY = f"""{_with(NOTIFICATIONS)}, problems AS (
  SELECT id, json_extract_string(p, '$.monitor_id') AS monitor, json_extract_string(p, '$.feed_type') AS feed_type,
         try_cast(json_extract_string(p, '$.days_open') AS BIGINT) AS days_open,
         try_cast(json_extract_string(p, '$.resolved_on') AS DATE) AS resolved_on
  FROM (SELECT id, unnest(json_extract(problems, '$[*]')) AS p FROM notifications WHERE problems IS NOT NULL)
)
SELECT count(*) AS publishers, count(*) FILTER (WHERE status = 'open') AS open,
       count(*) FILTER (WHERE status = 'in_progress') AS in_progress, count(*) FILTER (WHERE status = 'closed') AS closed,
       count(*) FILTER (WHERE date_contacted IS NULL AND status <> 'closed') AS never_contacted,
       count(*) FILTER (WHERE status <> 'closed' AND (date_contacted IS NULL OR date_contacted < DATE '2001-07-27' OR EXISTS (
         SELECT 1 FROM problems AS p WHERE p.id = n.id AND (
           resolved_on > n.date_contacted
           OR resolved_on IS NULL AND (
             monitor = 'dataset_stall' AND days_open >= 5 OR monitor = 'feed_ingestion_error' AND days_open >= 10
             OR monitor = 'single_feed_stall' AND feed_type IN ('Slot', 'ScheduledSession') AND days_open >= 10))))) AS alerts
FROM notifications AS n"""

_MERGE = f"""{_with(NOTIFICATIONS)}, stored AS (SELECT *, id::BIGINT AS k FROM notifications),
changes AS (
  SELECT id, k * 10 AS seq, CASE WHEN k % 21 = 0 THEN 'delete' WHEN k % 14 = 0 THEN 'insert' ELSE 'update' END AS op, status, problem_count, 'edited' AS notes, k
  FROM stored WHERE k % 7 = 0
  UNION ALL SELECT id, k * 10 + 1, 'insert', status, problem_count, 'again', k FROM stored WHERE k % 42 = 0
  UNION ALL SELECT 'n' || id, k * 10, CASE WHEN k % 70 = 0 THEN 'insert' ELSE 'update' END, status, problem_count, 'new', NULL
  FROM stored WHERE k % 35 = 0
),
outcomes AS (
  SELECT seq, id, op, notes, status, problem_count, CASE
    WHEN k IS NULL THEN CASE op WHEN 'insert' THEN 'applied' ELSE 'not_found' END
    WHEN op = 'insert' AND notes = 'edited' THEN 'conflict' ELSE 'applied' END AS outcome
  FROM changes
)"""
MERGE_OUTCOMES = f"{_MERGE} SELECT seq, id, op, outcome FROM outcomes"
MERGE_SNAPSHOT = f"""{_MERGE}
SELECT s.id, s.status, NULL::VARCHAR AS notes, s.problem_count, strftime(s.created_at, {_HOUR}) AS created_at, strftime(s.updated_at, {_HOUR}) AS updated_at
FROM stored AS s WHERE NOT EXISTS (SELECT 1 FROM outcomes AS o WHERE o.id = s.id AND outcome = 'applied')
UNION ALL
SELECT o.id, o.status, o.notes, o.problem_count,
       CASE WHEN o.op = 'insert' THEN '2002-01-01 00:00:00' ELSE (SELECT strftime(created_at, {_HOUR}) FROM stored AS s WHERE s.id = o.id) END,
       '2002-01-01 00:00:00'
FROM outcomes AS o
WHERE outcome = 'applied' AND op <> 'delete'"""

ORACLE: dict[str, str] = {
    "orphaned_children": ORPHANED_CHILDREN,
    "orphaned_children_by_kind": ORPHANS_BY_KIND,
    "orphaned_missing_parents": MISSING_PARENTS,
    "orphaned_missing_parents_all": MISSING_PARENTS_ALL,
    "single_feed_stalls": SINGLE_FEED_STALLS,
    "single_feed_stall_trend": SINGLE_FEED_TREND,
    "dataset_stalls": DATASET_STALLS,
    "dataset_stall_feeds": DATASET_STALL_FEEDS,
    "dataset_stall_trend": DATASET_TREND,
    "feed_ingestion_errors": FEED_ERRORS,
    "feed_ingestion_error_trend": ERROR_TREND,
    "dataset_future_decline": DECLINE,
    "dataset_future_decline_feeds": DECLINE_FEEDS,
    "dataset_future_decline_trend": DECLINE_TREND,
    "monitor_tiles": MONITOR_TILES,
    "estate_headline": HEADLINE,
    "datasets_with_errors_today": f"{_with(INGESTION)} {ERRORS_TODAY}",
    "snapshot_date": f"{_with(INGESTION)} SELECT max(ingestion_date::DATE)::VARCHAR AS snapshot_date FROM ingestion",
    "assessment_date": f"{_with(QUALITY)} SELECT max(last_assessed::DATE)::VARCHAR AS snapshot_date FROM quality",
    "latest_crawl": f"""{_with(CRAWLS)} SELECT number_of_datasets AS datasets, number_of_feeds AS feeds,
strftime(ingestion_date, {_HOUR}) AS generated_at FROM crawls ORDER BY ingestion_date DESC LIMIT 1""",
    "latest_insight_run": f"""{_with(INSIGHT)} SELECT strftime(run_date, {_HOUR}) AS run_date,
total_num_future_opportunity_items_narrow FROM insight_runs ORDER BY insight_runs.run_date DESC LIMIT 1""",
    "public_summary": PUBLIC_SUMMARY,
    "opportunities": f"{_with(SUMMARY)} {_SUMMARY_ROWS}",
    "opportunities_filtered": f"{_with(SUMMARY)} {_SUMMARY_ROWS} WHERE {_NARROW}",
    "opportunities_any_trust": f"{_with(SUMMARY)} {_SUMMARY_ROWS} WHERE nhstrust_code IS NOT NULL",
    "live_records": f"{_with(OPPORTUNITIES)} {_RECORDS}",
    "live_records_by_organization": f"{_with(OPPORTUNITIES)} {_RECORDS} AND organization_name IN ({quoted(ONE_PROVIDER.organization)})",
    "opportunity_records": RECORD_PAGE,
    "opportunity_records_after": RECORDS_AFTER,
    "areas": AREAS,
    "area_tree": AREA_TREE,
    "areas_filtered": AREAS_FILTERED,
    "socio": f"{_with(SOCIO)} SELECT * FROM socio",
    "socio_filtered": f"{_with(SOCIO)} SELECT * FROM socio WHERE area_code IN ('D3-1', 'R7', 'C1')",
    "publishers": f"{_with(SUMMARY)} SELECT DISTINCT publisher FROM summary WHERE publisher IS NOT NULL",
    "publishers_filtered": f"""{_with(SUMMARY)} SELECT DISTINCT publisher FROM summary
WHERE district_code IN ('D3-1', 'D4-2') AND {has('activity_or_facility', ['Brand#7'])}""",
    "activities": f"{_with(SUMMARY)} SELECT DISTINCT unnest({labels('activity_or_facility')}) AS activity FROM summary",
    "activities_filtered": f"""{_with(SUMMARY)} SELECT DISTINCT unnest({labels('activity_or_facility')}) AS activity FROM summary
WHERE district_code IN ('D3-1', 'D4-2') AND {has('activity_or_facility', ['Brand#7', 'Brand#12'])}""",
    "nhs_trusts": f"{_with(SUMMARY)} SELECT DISTINCT nhstrust_name, nhstrust_code FROM summary WHERE nhstrust_name IS NOT NULL",
    "organizations": f"""{_with(OPPORTUNITIES)} SELECT DISTINCT organization_name AS organization FROM opportunities
WHERE coalesce(organization_name, '') <> '' AND {_LIVE}""",
    "organizations_filtered": f"""{_with(OPPORTUNITIES)} SELECT DISTINCT organization_name AS organization FROM opportunities
WHERE coalesce(organization_name, '') <> '' AND {_LIVE} AND country_code IN ('C1', 'C2') AND nhstrust_code IS NOT NULL
  AND ({has('activity', ['ECONOMY'])} OR {has('facility', ['ECONOMY'])})""",
    "public_feed_quality": f"""{_with(QUALITY, SUMMARY, SUPPLIER_FEEDS)} {QUALITY_PUBLIC.format(url=_SHORT_URL)}
WHERE {_SHORT_URL} IN (SELECT dataset_url FROM supplier_feeds WHERE publisher_name IN (
  SELECT publisher FROM summary WHERE publisher IN ({quoted(ONE_TRUST.publisher)}) AND nhstrust_code = 'T3'))""",
    "public_feed_quality_filtered": f"""{_with(QUALITY, SUMMARY, SUPPLIER_FEEDS)} {QUALITY_PUBLIC.format(url=_SHORT_URL)}
WHERE {_SHORT_URL} IN (SELECT dataset_url FROM supplier_feeds WHERE publisher_name IN (
  SELECT publisher FROM summary WHERE publisher <= 'Supplier#000000005' AND district_code = 'D3-1'
    AND {has('activity_or_facility', ['Brand#7'])}))""",
    "feed_quality_rows": f"{_with(FEEDS, QUALITY, ASSESSED)} {_QUALITY_ROW}",
    "feed_quality_page": f"""{_with(QUALITY)} SELECT feed_id, round(q.score, 6) AS score FROM quality AS q
ORDER BY q.score DESC NULLS LAST, dataset_url, feed_id LIMIT 40 OFFSET 80""",
    "feed_quality_page_after": f"""{_with(QUALITY)} SELECT feed_id, round(q.score, 6) AS score FROM quality AS q
WHERE q.score IS NULL OR q.score < 55 OR q.score = 55 AND (dataset_url, feed_id) > ('https://d3.example/data/', 'feed-6')
ORDER BY q.score DESC NULLS LAST, dataset_url, feed_id LIMIT 40""",
    "feed_quality_filtered": f"""{_with(FEEDS, QUALITY, ASSESSED)} {_QUALITY_ROW} AS a
WHERE dataset_url IN (SELECT 'https://d' || n || '.example/data/' FROM range(60) AS t(n))
  AND a.publisher_name IN (SELECT 'Customer#' || lpad(n::VARCHAR, 9, '0') FROM range(0, 80, 2) AS t(n))""",
    "feed_quality_summary": QUALITY_SUMMARY,
    "feed_quality_completeness": COMPLETENESS,
    "feed_quality_histogram": HISTOGRAM,
    "feed_quality_breakdowns": BREAKDOWNS,
    "custom_property_rows": PROPERTY_ROWS,
    "custom_property_rows_filtered": f"""{PROPERTY_ROWS}
  AND dataset_url IN (SELECT 'https://d' || n || '.example/data/' FROM range(60) AS t(n))
  AND property_feeds.publisher_name IN (SELECT 'Customer#' || lpad(n::VARCHAR, 9, '0') FROM range(0, 80, 2) AS t(n))""",
    "custom_property_summary": PROPERTY_SUMMARY,
    "custom_property_namespaces": NAMESPACES,
    "custom_property_entity_types": ENTITY_TYPES,
    "custom_property_properties": PROPERTIES,
    "ecosystem_growth": GROWTH,
    "ecosystem_growth_datasets": GROWTH_DATASETS,
    "ecosystem_growth_in_progress": GROWTH_IN_PROGRESS,
    "site_mappings": SITES,
    "site_mappings_filtered": SITES_FILTERED,
    "site_mappings_by_id": f"{SITES} WHERE site_id IN ('1', '3', 'none')",
    "notification_list": NOTIFICATION_LIST,
    "notification_summary": NOTIFICATION_SUMMARY,
    "notification_merge": MERGE_SNAPSHOT,
    "notification_merge_outcomes": MERGE_OUTCOMES,
}

# The stored feed-day state: the same monitors, and the state itself.
ORACLE["feed_day_state"] = f"""{_with(INGESTION)}
SELECT feed_id, dataset_id, kind, (ingestion_date::DATE)::VARCHAR AS day, count(*) AS runs, epoch_us(max(ingestion_date)) AS latest,
       sum(updated)::BIGINT AS updated, count(*) FILTER (WHERE status = 'COMPLETE') AS completes,
       count(*) FILTER (WHERE status = 'ERROR') AS failures,
       epoch_us(max(ingestion_date) FILTER (WHERE status = 'COMPLETE' AND total_future_opportunities IS NOT NULL)) AS supplied,
       sum(updated) FILTER (WHERE status = 'COMPLETE' AND total_future_opportunities IS NOT NULL)::BIGINT AS supply_updated,
       sum(actual_deletes) FILTER (WHERE status = 'COMPLETE' AND total_future_opportunities IS NOT NULL)::BIGINT AS supply_deletes,
       (max({{'t': ingestion_date, 'v': total_future_opportunities}})
         FILTER (WHERE status = 'COMPLETE' AND total_future_opportunities IS NOT NULL)).v AS future
FROM ingestion WHERE feed_id IS NOT NULL AND dataset_id IS NOT NULL
GROUP BY feed_id, dataset_id, kind, ingestion_date::DATE"""
ORACLE["feed_day_index"] = f"""{_with(INGESTION)}
SELECT (ingestion_date::DATE)::VARCHAR AS day, count(*) AS rows FROM ingestion WHERE ingestion_date IS NOT NULL GROUP BY ALL"""
for _name in ("single_feed_stalls", "dataset_stall_trend", "feed_ingestion_errors", "dataset_future_decline"):
    ORACLE[f"{_name}_from_state"] = ORACLE[_name]
ORACLE["history_trends"] = " UNION ALL ".join(
    f"SELECT '{monitor}' AS monitor_id, day, open_count, past_threshold_count FROM ({ORACLE[query]})"
    for monitor, query in (
        ("single_feed_stall", "single_feed_stall_trend"), ("dataset_stall", "dataset_stall_trend"),
        ("feed_ingestion_error", "feed_ingestion_error_trend"), ("dataset_future_decline", "dataset_future_decline_trend"),
    )
)
ORACLE["orphaned_children_from_changes"] = ORACLE["orphaned_children"]
