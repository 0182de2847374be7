"""tidegrid: panel time-series operators written on the Spark DataFrame API.

Every operator takes DataFrames and returns DataFrames; series are long tables
keyed by id columns and a timestamp, and ordering is always explicit.
"""

from tidegrid.panel import Panel
from tidegrid.session import build_session, tune

__all__ = ["Panel", "build_session", "tune"]
