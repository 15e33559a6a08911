"""Column types of the warehouse tables, as Spark DDL: fixed values.  JSON columns are JSON text."""

OPPORTUNITY_INGESTION = (
    "feed_id STRING, dataset_id STRING, ingestion_date TIMESTAMP, kind STRING, status STRING, "
    "error_code STRING, warning_message STRING, updated BIGINT, deleted BIGINT, "
    "actual_deletes BIGINT, total_future_opportunities BIGINT"
)

FEED_INGESTION = (
    "ingestion_date TIMESTAMP, datasets STRING, number_of_datasets BIGINT, number_of_feeds BIGINT"
)

OPPORTUNITIES = (
    "publisher_name STRING, feed_id STRING, id STRING, data_id STRING, dataset_url STRING, "
    "kind STRING, startDate TIMESTAMP, endDate TIMESTAMP, last_updated DATE, location STRING, "
    "has_superEvent STRING, activity STRING, facility STRING, json_data STRING, "
    "accessibilitySupport STRING, ageRange STRING, level STRING, genderRestriction STRING, "
    "organization_name STRING, nhstrust_code STRING, district_name STRING, district_code STRING, "
    "region_name STRING, region_code STRING, country_name STRING, country_code STRING"
)

ACTIVE_OPPORTUNITIES_SUMMARY = (
    "publisher STRING, country_name STRING, country_code STRING, region_name STRING, "
    "region_code STRING, district_name STRING, district_code STRING, is_activity BOOLEAN, "
    "activity_or_facility STRING, organization_names STRING, nhstrust_name STRING, "
    "nhstrust_code STRING, opportunity_count BIGINT, opportunity_count_narrow BIGINT"
)

INSIGHT_RUN_SUMMARY = "run_date TIMESTAMP, total_num_future_opportunity_items_narrow BIGINT"

FEEDS = "id STRING, url STRING, type STRING, publisher_name STRING, dataset_url STRING"

COMPLETENESS_COLUMNS = (
    "location_completeness",
    "start_date_completeness",
    "end_date_completeness",
    "activities_completeness",
    "facilities_completeness",
    "age_range_completeness",
    "level_completeness",
    "accessibility_support_completeness",
    "gender_restriction_completeness",
)

FEED_QUALITY = (
    "feed_id STRING, dataset_url STRING, dataset_name STRING, feed_type STRING, feed_url STRING, "
    "is_regular BOOLEAN, status STRING, grade STRING, feed_version STRING, score DOUBLE, "
    + ", ".join(f"{name} DOUBLE" for name in COMPLETENESS_COLUMNS)
    + ", num_future_opportunity_items BIGINT, warnings STRING, errors STRING, "
    "missing_required_fields STRING, last_assessed TIMESTAMP"
)

CUSTOM_PROPERTIES = (
    "feed_id STRING, dataset_url STRING, dataset_name STRING, publisher_name STRING, "
    "feed_url STRING, feed_type STRING, is_regular BOOLEAN, sampled_items BIGINT, "
    "num_custom_properties BIGINT, num_custom_property_usages BIGINT, "
    "custom_properties ARRAY<STRUCT<property STRING, namespace STRING, entity_type STRING, "
    "presence_pct DOUBLE>>, last_assessed TIMESTAMP"
)

SOCIO_MEASURES = (
    "imd25_average_score",
    "imd25_rank_of_average_score",
    "imd25_pct_lsoas_in_most_deprived_10pct",
    "imd25_extent",
    "imd25_local_concentration",
    "als_respondents",
    "als_active_pop",
    "als_fairly_active_pop",
    "als_inactive_pop",
    "als_survey_adult_population",
    "als_active_rate",
    "als_fairly_active_rate",
    "als_inactive_rate",
    "als_active_rate_change_12m",
    "als_inactive_rate_change_12m",
)

SOCIO_DATA = (
    "area_code STRING, area_name STRING, total_population BIGINT, "
    + ", ".join(f"{name} DOUBLE" for name in SOCIO_MEASURES)
)

PUBLISHER_NOTIFICATIONS = (
    "id STRING, publisher_id STRING, publisher_name STRING, dataset_url STRING, "
    "problem_count BIGINT, monitors ARRAY<STRING>, oldest_days_open BIGINT, status STRING, "
    "stakeholder STRING, contact STRING, date_contacted DATE, notes STRING, problems STRING, "
    "created_at TIMESTAMP, updated_at TIMESTAMP"
)

TABLES = {
    "opportunity_ingestion": OPPORTUNITY_INGESTION,
    "feed_ingestion": FEED_INGESTION,
    "opportunities": OPPORTUNITIES,
    "active_opportunities_summary": ACTIVE_OPPORTUNITIES_SUMMARY,
    "insight_run_summary": INSIGHT_RUN_SUMMARY,
    "feeds": FEEDS,
    "feed_quality": FEED_QUALITY,
    "custom_properties": CUSTOM_PROPERTIES,
    "socio_data": SOCIO_DATA,
    "publisher_notifications": PUBLISHER_NOTIFICATIONS,
}
