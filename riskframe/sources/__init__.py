"""Sources and sinks: table access, CSV/JSON I/O and the activity adapter."""

from riskframe.sources.activity import activity_frame, load_activity
from riskframe.sources.io import read_metrics, read_table, write_metrics, write_table
from riskframe.sources.tables import load_table

__all__ = [
    "activity_frame",
    "load_activity",
    "load_table",
    "read_metrics",
    "read_table",
    "write_metrics",
    "write_table",
]
