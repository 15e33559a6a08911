"""Feed-health monitors and activity-data analytics as lazy Spark DataFrame plans.

Every public function takes DataFrames (plus plain Python options) and returns a
DataFrame.  Nothing here starts a job on its own except ``sources.snapshots.latest_day``
and the one-row header read in ``sources.site_csv``.
"""

__version__ = "0.1.0"
