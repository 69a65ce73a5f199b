"""Calendar truncation and buckets of time and numbers, without the session's time zone.

Instants without zone are truncated as stored; on a zone's calendar each instant takes the
offset of its own interval, so a repeated autumn hour stays two hours.  A comparison with
a constant is rewritten to the range of the underlying column.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import SchemaError, UnsupportedError
from .predicates import FLOATS, INTS, Predicate, Sym

UNITS = ("minute", "hour", "day", "week", "month", "quarter", "year")
MICROS = {"minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}
EPOCH = dt.datetime(1970, 1, 1)


def _micros(c: Column, kind: T.DataType) -> Column:
    """Microseconds since 1970, of the wall clock for an instant without zone."""
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    # a wall clock read in UTC, whatever the session's zone is
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), c)


def _instant(micros: Column, kind: T.DataType) -> Column:
    if isinstance(kind, T.TimestampType):
        return F.timestamp_micros(micros)
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _floor(c: Column, kind: T.DataType, unit: str) -> Column:
    """Start of the unit that holds a wall clock."""
    if unit in MICROS:
        m = _micros(c, kind)
        return _instant(m - F.pmod(m, F.lit(MICROS[unit])), kind)
    return F.trunc(c.cast("date"), unit).cast("timestamp_ntz")


def _start(value: dt.datetime, unit: str) -> dt.datetime:
    if unit in MICROS:
        return EPOCH + dt.timedelta(microseconds=(value - EPOCH) // dt.timedelta(microseconds=1) // MICROS[unit] * MICROS[unit])
    day = dt.datetime(value.year, value.month, value.day)
    if unit == "week":
        return day - dt.timedelta(days=day.weekday())
    return day.replace(day=1, month=1 if unit == "year" else (value.month - 1) // 3 * 3 + 1 if unit == "quarter" else value.month)


def _next(start: dt.datetime, unit: str) -> dt.datetime:
    if unit in MICROS:
        return start + dt.timedelta(microseconds=MICROS[unit])
    if unit == "week":
        return start + dt.timedelta(days=7)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    month = start.month - 1 + months
    return start.replace(year=start.year + month // 12, month=month % 12 + 1)


def ranged(sym: Sym, start, after):
    """op, value -> the range of sym whose function compares so, given value's own bucket [start, after)."""

    def rewrite(op: str, value) -> Predicate | None:
        try:
            low, high = start(value), after(value)
        except (TypeError, ValueError, OverflowError, AttributeError):
            return None
        exact = low == value
        if op == "=":
            return (sym >= low) & (sym < high) if exact else sym.is_in([])
        if op == "!=":
            return (sym < low) | (sym >= high) if exact else ~sym.is_in([])
        if op == "<":
            return sym < (low if exact else high)
        if op == ">=":
            return sym >= (low if exact else high)
        return sym < high if op == "<=" else sym >= high

    return rewrite


def truncated(sym: Sym, unit: str, zone: str | None = None) -> Sym:
    """The start of the minute, hour, day, week (Monday), month, quarter or year; null stays null."""
    unit = unit.lower()
    if unit not in UNITS:
        raise SchemaError(f"no calendar unit {unit!r}")
    name = f"truncate({sym.name}, {unit}{', ' + zone if zone else ''})"
    kind = sym.kind
    if isinstance(kind, T.DateType):
        if unit in ("minute", "hour"):
            raise SchemaError(f"{sym.name}: a date has no {unit}")
        if zone:
            raise SchemaError(f"{sym.name}: a date has no zone")

        def day(value: dt.date) -> dt.datetime:
            if isinstance(value, dt.datetime) or not isinstance(value, dt.date):
                raise TypeError
            return dt.datetime(value.year, value.month, value.day)

        column = sym.column if unit == "day" else F.trunc(sym.column, unit)
        return Sym(name, kind, column, columns=sym.columns, ranges=ranged(sym, lambda v: _start(day(v), unit).date(), lambda v: _next(_start(day(v), unit), unit).date()))
    if not isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
        raise SchemaError(f"{sym.name} is {kind.simpleString()}, not an instant")
    own = zone or sym.zone
    if not own or own.upper() == "UTC":
        if isinstance(kind, T.TimestampType):
            if unit in MICROS:
                column = _floor(sym.column, kind, unit)
            else:
                wall = F.convert_timezone(F.lit("UTC"), F.lit("UTC"), _instant(F.unix_micros(sym.column), T.TimestampNTZType()))
                column = F.timestamp_micros(_micros(_floor(wall, T.TimestampNTZType(), unit), T.TimestampNTZType()))
            return Sym(name, kind, column, sym.zone, columns=sym.columns)

        def wall_clock(value: dt.datetime) -> dt.datetime:
            if not isinstance(value, dt.datetime) or value.tzinfo:
                raise TypeError
            return value

        return Sym(name, kind, _floor(sym.column, kind, unit), columns=sym.columns, ranges=ranged(sym, lambda v: _start(wall_clock(v), unit), lambda v: _next(_start(wall_clock(v), unit), unit)))
    # On a zone's calendar: the wall clock of the instant, and its offset at that instant.
    ntz = T.TimestampNTZType()
    utc = _instant(_micros(sym.column, kind), ntz)
    wall = F.convert_timezone(F.lit("UTC"), F.lit(own), utc)
    floor = _floor(wall, ntz, unit)
    if unit in ("minute", "hour"):  # the offset of this instant: both repeated hours stay
        back = _micros(utc, ntz) - (_micros(wall, ntz) - _micros(floor, ntz))
    else:
        back = _micros(F.convert_timezone(F.lit(own), F.lit("UTC"), floor), ntz)
    return Sym(name, kind, _instant(back, kind), sym.zone, columns=sym.columns)


def bucketed(sym: Sym, width) -> Sym:
    """Instants: the bucket of a timedelta, counted from 1970-01-01.  Numbers: floor(v / w) * w in the column's type."""
    name = f"bucket({sym.name}, {width})"
    kind = sym.kind
    if isinstance(width, dt.timedelta):
        micros = width // dt.timedelta(microseconds=1)
        if micros <= 0:
            raise SchemaError("a bucket is wider than nothing")
        if isinstance(kind, T.DateType):
            days = micros // MICROS["day"]
            if days * MICROS["day"] != micros:
                raise SchemaError(f"{sym.name}: the width is no number of days")
            number = F.unix_date(sym.column)
            return Sym(name, kind, F.date_from_unix_date((number - F.pmod(number, F.lit(days))).cast("int")), columns=sym.columns)
        if not isinstance(kind, (T.TimestampNTZType, T.TimestampType)):
            raise SchemaError(f"{sym.name} is {kind.simpleString()}, not an instant")
        m = _micros(sym.column, kind)
        column = _instant(m - F.pmod(m, F.lit(micros)), kind)
        ranges = None
        if isinstance(kind, T.TimestampNTZType):

            def start(v: dt.datetime) -> dt.datetime:
                return EPOCH + dt.timedelta(microseconds=(v - EPOCH) // dt.timedelta(microseconds=1) // micros * micros)

            ranges = ranged(sym, start, lambda v: start(v) + width)
        return Sym(name, kind, column, sym.zone, columns=sym.columns, ranges=ranges)
    if isinstance(kind, T.DecimalType):
        raise UnsupportedError(f"{sym.name}: decimals have no buckets")
    if width <= 0 or isinstance(width, bool):
        raise SchemaError("a bucket is wider than nothing")
    if isinstance(kind, INTS):
        if not isinstance(width, int):
            raise SchemaError(f"{sym.name}: an integer's bucket has an integer width")
        column = (sym.column - F.pmod(sym.column, F.lit(width))).cast(kind)
        return Sym(name, kind, column, columns=sym.columns, ranges=ranged(sym, lambda v: v // width * width, lambda v: v // width * width + width))
    if isinstance(kind, FLOATS):
        exact = sym.column.cast("double") / F.lit(float(width))
        # Spark's floor gives a long: values beyond it, and NaN, are their own bucket
        inside = F.abs(exact) < F.lit(2.0**62)
        return Sym(name, kind, F.when(inside, F.floor(exact) * F.lit(float(width))).when(sym.column.isNotNull(), sym.column.cast("double")).cast(kind), columns=sym.columns)
    raise SchemaError(f"{sym.name} is {kind.simpleString()}, which has no buckets")
