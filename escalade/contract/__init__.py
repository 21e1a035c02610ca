"""Every operator as a query over the driver tables, beside its SQL twin."""

from . import calibration, features, joins, metrics, outcomes, resampling, routers, runlog, sources, streams, transcripts  # noqa: F401
from .base import ORACLE, QUERIES  # noqa: F401
