"""Session defaults the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

# All day arithmetic is on UTC dates; the AQE options split skewed joins and size
# shuffle partitions from what was really written.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Recording the Python line of every column costs more than building these plans does.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(
    app_name: str = "tidewatch",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    **conf: str,
) -> SparkSession:
    """A session with the library defaults; ``conf`` keys may use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    options = dict(DEFAULTS)
    if shuffle_partitions:
        options["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    options.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in options.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
