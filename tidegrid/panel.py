"""Names of the columns that make a long table a panel of time series."""

from __future__ import annotations

from dataclasses import dataclass, replace

# Chunk width of a panel whose series have not been measured yet.
MEASURE = 0


@dataclass(frozen=True)
class Panel:
    """Which columns identify a series and its time.

    ``ids``       series key; extra keys such as (year, month, week) cut a
                  series into independent groups.
    ``dt``        a TimestampType column, unique within a series.
    ``chunk_us``  how series are cut so that no task holds a long one whole.
                  ``MEASURE``: operators that order rows measure the longest
                  series first and cut when they must (see
                  :mod:`tidegrid.operators.chunks`).  A width in microseconds:
                  cut into time chunks of that width.  ``None``: every series is
                  known to fit one task, as on a regular grid, where its span
                  bounds its rows.
    """

    ids: tuple[str, ...] = ("id",)
    dt: str = "dt"
    chunk_us: int | None = MEASURE

    def within(self, *extra: str) -> "Panel":
        """The same panel restarted inside every value of the extra keys."""
        return replace(self, ids=self.ids + tuple(extra))

    def bounded(self) -> "Panel":
        """The same panel, its series known to be short enough for one task."""
        return replace(self, chunk_us=None)

    def chunked(self, width_us: int | None) -> "Panel":
        return replace(self, chunk_us=width_us)
