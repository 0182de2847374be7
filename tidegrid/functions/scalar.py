"""Column expressions shared by the operators.  All of them stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidegrid.functions.freq import freq_seconds


def floor_time(dt: Column, freq: str | int) -> Column:
    """Start of the grid cell that holds ``dt`` (cells are anchored at the epoch,
    which equals midnight for every frequency that divides a day)."""
    seconds = F.unix_seconds(dt)
    return F.timestamp_seconds(seconds - F.pmod(seconds, F.lit(freq_seconds(freq))))


def on_grid(dt: Column, freq: str | int) -> Column:
    """True when ``dt`` falls exactly on the grid, to the microsecond."""
    return F.pmod(F.unix_micros(dt), F.lit(freq_seconds(freq) * 1_000_000)) == 0


def as_naive(dt: Column) -> Column:
    """Wall-clock timestamp without zone, the form written for other engines."""
    return dt.cast("timestamp_ntz")


def weekday(dt: Column) -> Column:
    """Day of week with Monday = 0."""
    return F.weekday(dt)


def next_weekday(dt: Column, day: int = 0, forward: bool = True) -> Column:
    """Nearest date on the given weekday, the same day included, time of day kept."""
    here = F.weekday(dt)
    if forward:
        return dt + F.make_dt_interval(F.pmod(F.lit(day) - here, F.lit(7)))
    return dt - F.make_dt_interval(F.pmod(here - F.lit(day), F.lit(7)))


def zero_to_one(x: Column) -> Column:
    """Replace an exact zero by one, so it can divide."""
    return F.when(x == 0, F.lit(1.0)).otherwise(x)


def ratio(a: Column, b: Column) -> Column:
    """``a / b`` with the limits of real division: a nonzero value over zero is
    infinite, zero over zero is missing."""
    infinite = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf))
    return F.when(b == 0, infinite).otherwise(F.try_divide(a, b))


def missing_to_null(x: Column) -> Column:
    """NaN becomes NULL: aggregates skip NULL only."""
    return F.when(F.isnan(x), F.lit(None)).otherwise(x)


def recode(x: Column, codes: Mapping[str, str]) -> Column:
    """Map listed values, keep the rest."""
    pairs = F.create_map(*[F.lit(v) for v in chain.from_iterable(codes.items())])
    return F.coalesce(F.element_at(pairs, x), x)


def array_onehot(label: Column, n: int) -> Column:
    """One-hot vector of length ``n`` for a class index."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == label).cast("int"))


def array_argmax(values: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def flatten_windows(nested: Column) -> Column:
    """Rows of steps to one flat vector."""
    return F.flatten(nested)


def hypothesis_decision(p: Column, claim: str = "", alpha: float = 0.05) -> Column:
    """Struct (rejected, text): the null hypothesis is kept when ``p > alpha``."""
    # The two sentences.
    kept = F.lit(f"not enough evidence for: {claim} (fail to reject H0)")
    dropped = F.lit(f"significant evidence for: {claim} (reject H0)")
    return F.struct(
        (~(p > alpha)).alias("rejected"),
        F.when(p > alpha, kept).otherwise(dropped).alias("decision"),
    )


# Unit names of the two byte formats.
SHORT_UNITS = ["bytes", "KB", "MB", "GB", "TB", "PB"]
BINARY_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB", "EiB", "ZiB", "YiB"]


def format_bytes(n: Column, style: str = "short", qualifier: str = "+") -> Column:
    """Bytes as text: ``22.5+ KB`` (short) or ``22.5KiB`` (binary), base 1024."""
    units = {"short": SHORT_UNITS, "binary": BINARY_UNITS}.get(style)
    if units is None:
        raise ValueError(f"unknown style: {style}")
    pattern = f"%.1f{qualifier} %s" if style == "short" else "%.1f%s"
    size = n.cast("double")
    text = None
    for power, unit in enumerate(units):
        shown = F.format_string(pattern, F.bround(size / math.pow(1024, power), 1), F.lit(unit))
        if power == len(units) - 1:
            return text.otherwise(shown)
        fits = (F.abs(size) if style == "binary" else size) < math.pow(1024, power + 1)
        text = F.when(fits, shown) if text is None else text.when(fits, shown)
    raise AssertionError("unreachable")
