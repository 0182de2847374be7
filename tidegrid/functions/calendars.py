"""Frequencies whose steps are uneven: months, quarters, years, anchored weeks, business days.

A calendar numbers its periods; a time's period and a period's date are arithmetic on months
or days, so that grids need no table of dates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of weekdays (from Monday) and months as frequency anchors.
WEEKDAYS = ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
# Months in a period.
MONTHS_PER = {"M": 1, "Q": 3, "Y": 12}

_NAME = re.compile(r"\s*(\d*)(?:(?P<unit>[MQY])(?P<side>[SE])|(?P<week>W)|(?P<work>B))(?:-(?P<anchor>[A-Z]{3}))?\s*")


@dataclass(frozen=True)
class Calendar:
    """A calendar frequency; make one with :func:`calendar_of`.

    ``unit``    months in a period, or 0 for weeks and -1 for business days
    ``ends``    whether a period is named by its last day (``ME``, ``QE``, ``YE``, ``W``) or its first
    ``anchor``  month (0-11) or weekday (Monday = 0) of the naming day
    ``times``   periods in a step
    """

    unit: int
    ends: bool
    anchor: int
    times: int = 1

    def period(self, t: Column) -> Column:
        """Number of the period that holds a time; the naming day belongs to it."""
        day = F.unix_date(F.to_date(t)).cast("bigint")
        if self.unit > 0:
            month = (F.year(t) * 12 + F.month(t) - 1 - self.anchor).cast("bigint")
            return F.ceil(month / self.unit) if self.ends else F.floor(month / self.unit)
        if self.unit == 0:
            return F.ceil((day - (self.anchor - 3)) / 7)  # day 0 was a Thursday
        # Saturdays and Sundays belong to the Friday before them.
        return F.floor((day + 3) / 7) * 5 + F.least(F.weekday(t), F.lit(4))

    def date(self, period: Column) -> Column:
        """The day that names a period."""
        if self.unit > 0:
            month = period * self.unit + self.anchor
            first = F.make_date(F.floor(month / 12).cast("int"), (F.pmod(month, F.lit(12)) + 1).cast("int"), F.lit(1))
            return F.last_day(first) if self.ends else first
        if self.unit == 0:
            return F.date_from_unix_date((period * 7 + (self.anchor - 3)).cast("int"))
        return F.date_from_unix_date((F.floor(period / 5) * 7 - 3 + F.pmod(period, F.lit(5))).cast("int"))

    def names(self, t: Column) -> Column:
        """Whether a time lies on a naming day."""
        return self.date(self.period(t)) == F.to_date(t)


def calendar_of(freq: str | int | timedelta) -> Calendar | None:
    """The calendar that a frequency names, or None for steps of fixed length.

    ``MS``, ``ME``, ``QS-JAN``, ``QE-DEC``, ``YS-APR``, ``YE``, ``W-MON`` (weeks that end on a Monday),
    ``B``, each with a number of periods before it (``2MS``).  Without an anchor years and
    quarters go from January to December and weeks end on a Sunday.
    """
    match = _NAME.fullmatch(freq) if isinstance(freq, str) else None
    if match is None:
        return None
    times, anchor = int(match[1] or 1), match["anchor"]
    known = WEEKDAYS if match["week"] else MONTHS if match["unit"] in ("Q", "Y") else ()
    if times == 0 or (anchor and anchor not in known):
        raise ValueError(f"not a frequency: {freq!r}")
    if match["work"]:
        return Calendar(-1, False, 0, times)
    if match["week"]:
        return Calendar(0, True, known.index(anchor or "SUN"), times)
    ends, unit = match["side"] == "E", MONTHS_PER[match["unit"]]
    month = MONTHS.index(anchor) if anchor else 11 if ends else 0
    return Calendar(unit, ends, month % unit, times)
