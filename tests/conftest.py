import datetime as dt

import pytest

from tidewatch import schemas
from tidewatch.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "tidewatch-tests", "local[4]", shuffle_partitions=4,
        spark__ui__enabled="false", spark__driver__memory="4g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


AS_OF = dt.date(2026, 9, 1)


def day(back: int, as_of: dt.date = AS_OF) -> dt.date:
    return as_of - dt.timedelta(days=back)


def at(moment: dt.date, hour: int = 6) -> dt.datetime:
    return dt.datetime(moment.year, moment.month, moment.day, hour)


def table(spark, name, rows):
    """A warehouse table from dictionaries; what a row leaves out is null."""
    empty = spark.createDataFrame([], schemas.TABLES[name])
    fields = empty.schema.names
    for row in rows:
        unknown = set(row) - set(fields)
        assert not unknown, unknown
    return spark.createDataFrame([tuple(row.get(f) for f in fields) for row in rows], empty.schema)


@pytest.fixture(scope="session")
def no_names(spark):
    """Feed and dataset names when nothing is known about either."""
    from tidewatch.operators import hydrate

    feeds, quality = table(spark, "feeds", []), table(spark, "feed_quality", [])
    return hydrate.feed_names(feeds, quality), hydrate.dataset_names(feeds, quality)
