"""Calendar functions. Instants are TIMESTAMP_NTZ in UTC; local times are TIMESTAMP_NTZ of a time zone.

An ambiguous local time is the earlier instant, a local time that does not exist moves forward by the gap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.spec import DAY, StoreSpec


def to_local(ts: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), ts)


def to_utc(local: Column, tz: str) -> Column:
    return F.convert_timezone(F.lit(tz), F.lit("UTC"), local)


def convert(ts: Column, source: str, target: str) -> Column:
    return F.convert_timezone(F.lit(source), F.lit(target), ts)


def localise_date(day: Column, tz: str, time: str = "00:00:00") -> Column:
    """The instant of a local date and time."""
    return to_utc((F.concat_ws(" ", F.date_format(day, "yyyy-MM-dd"), F.lit(time))).cast("timestamp_ntz"), tz)


def localise_interval(first: Column, last: Column, tz: str) -> tuple[Column, Column]:
    """From the start of the local day ``first`` to the last microsecond of the local day ``last``."""
    return localise_date(first, tz), localise_date(last, tz, "23:59:59.999999")


def now_utc() -> Column:
    return F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))


def truncated(unit: str, ts: Column) -> Column:
    return F.date_trunc(unit, ts).cast("timestamp_ntz")


def step(us: int) -> Column:
    """An interval of so many microseconds."""
    days, rest = divmod(us, DAY)
    return F.make_dt_interval(F.lit(days), F.lit(0), F.lit(0), F.lit(rest).cast("decimal(18,0)") / F.lit(1_000_000).cast("decimal(18,0)"))


def between_us(start: Column, end: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", start, end)


def chunk_index(ts: Column, spec: StoreSpec) -> Column:
    """The calendar period of an instant: the local year, or year x 12 + month - 1."""
    local = to_local(ts, spec.tz)
    if spec.chunk_axis == ("year",):
        return F.year(local).cast("int")
    return (F.year(local) * 12 + F.month(local) - 1).cast("int")


def chunk_bounds(index: Column, spec: StoreSpec) -> tuple[Column, Column]:
    """First instant of a chunk, and of the one after it."""
    if spec.chunk_axis == ("year",):
        first, after = F.make_timestamp_ntz(index, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp_ntz(index + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    else:
        def of(i: Column) -> Column:
            return F.make_timestamp_ntz(F.floor(i / 12).cast("int"), (F.pmod(i, F.lit(12)) + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0))

        first, after = of(index), of(index + 1)
    return to_utc(first, spec.tz), to_utc(after, spec.tz)


def grid(start: Column, end: Column, spec: StoreSpec) -> Column:
    """The instants from ``start`` to before ``end``: every step, or every local midnight for a step of a day."""
    last = end - step(1)
    if spec.step_us < DAY:
        return F.sequence(start, last, step(spec.step_us))
    days = F.sequence(to_local(start, spec.tz), to_local(last, spec.tz), step(DAY))
    return F.transform(days, lambda d: to_utc(d, spec.tz))
