"""Frequency aliases such as ``5min``, ``H`` or ``30T`` as seconds and intervals."""

from __future__ import annotations

import re
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Seconds per fixed-length frequency alias.
SECONDS_PER_ALIAS = {
    "s": 1,
    "sec": 1,
    "t": 60,
    "min": 60,
    "h": 3600,
    "d": 86400,
    "w": 604800,
}

_ALIAS = re.compile(r"\s*(\d*)\s*([A-Za-z]+)\s*")


def freq_seconds(freq: str | int | timedelta) -> int:
    """Length of a fixed frequency in whole seconds."""
    if isinstance(freq, timedelta):
        seconds = freq.total_seconds()
    elif isinstance(freq, str):
        match = _ALIAS.fullmatch(freq)
        unit = match and SECONDS_PER_ALIAS.get(match[2].lower())
        if not unit:
            raise ValueError(f"not a fixed frequency: {freq!r}")
        seconds = int(match[1] or 1) * unit
    else:
        seconds = freq
    if seconds <= 0 or seconds != int(seconds):
        raise ValueError(f"frequency must be a positive whole number of seconds: {freq!r}")
    return int(seconds)


def freq_to_interval(freq: str | int | timedelta | Column) -> Column:
    """A day-time interval column; a Column argument is read as seconds."""
    seconds = freq if isinstance(freq, Column) else F.lit(freq_seconds(freq))
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds.cast("decimal(18,6)"))
