"""Routing-outcome analytics on Spark.

Every operator takes and returns DataFrames.  A problem was attempted by four
strategies of rising cost; the package turns the logs of those attempts into
matched outcome tables, labels, replays, calibration figures, splits, routers
and resampled intervals.
"""

__version__ = "0.1.0"
