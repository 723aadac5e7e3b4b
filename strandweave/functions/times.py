"""Lenient time of an action, its month, and time arithmetic, as column expressions without a zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _stamp(y: Column, mo: Column, d: Column, h: Column, mi: Column, s: Column) -> Column:
    """A zone-free timestamp of text parts, null if they are no date or clock."""
    text = F.concat(y, F.lit("-"), mo, F.lit("-"), d, F.lit(" "), h, F.lit(":"), mi, F.lit(":"), s)
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")


def action_time(date: Column, timestamp: Column) -> Column:
    """Time of an action: ``date`` (8 digits, clock from 12 characters on) first, then ``timestamp``.

    ``timestamp`` is read as ``YYYY-MM-DD HH:MM:SS``, ``... HH:MM``, or else only its first ten
    characters as a day; slashes count as dashes. A ``date`` of 8 digits with a clock that is no
    number gives null (no fall-back); other unusable dates fall back to ``timestamp``.
    """
    digits = F.coalesce(date, F.lit("")).rlike(r"^\d{8}")
    part = lambda a, n: F.substring(date, a, n)
    has_clock = F.length(date) >= 12
    bad_clock = digits & has_clock & ~part(9, 4).rlike(r"^\d{4}$")
    clock = lambda a: F.when(has_clock, part(a, 2)).otherwise(F.lit("00"))
    from_date = F.when(digits & ~bad_clock, _stamp(part(1, 4), part(5, 2), part(7, 2), clock(9), clock(11), F.lit("00")))
    t = F.regexp_replace(F.trim(F.coalesce(timestamp, F.lit(""))), "/", "-")
    p = lambda a, n: F.substring(t, a, n)
    full = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), _stamp(p(1, 4), p(6, 2), p(9, 2), p(12, 2), p(15, 2), p(18, 2)))
    short = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$"), _stamp(p(1, 4), p(6, 2), p(9, 2), p(12, 2), p(15, 2), F.lit("00")))
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}"), _stamp(p(1, 4), p(6, 2), p(9, 2), F.lit("00"), F.lit("00"), F.lit("00")))
    return F.when(bad_clock, F.lit(None).cast("timestamp_ntz")).otherwise(F.coalesce(from_date, full, short, day))


def month_index(date: Column, timestamp: Column) -> Column:
    """``year * 12 + month`` (month from 1): from six leading digits of ``date``, else from the action's time; months outside 1 to 12 are null."""
    six = F.coalesce(date, F.lit("")).rlike(r"^\d{6}")
    y, m = F.substring(date, 1, 4).try_cast("int"), F.substring(date, 5, 2).try_cast("int")
    t = action_time(F.lit(None).cast("string"), timestamp)
    return F.when(six, F.when((m >= 1) & (m <= 12), y * 12 + m)).otherwise((F.year(t) * 12 + F.month(t)).cast("int"))


def month_text(index: Column) -> Column:
    """``YYYY-MM`` of a month index."""
    return F.format_string("%04d-%02d", F.floor((index - 1) / 12).cast("int"), (F.pmod(index - 1, F.lit(12)) + 1).cast("int"))


def micros(ts: Column) -> Column:
    """Microseconds of a zone-free timestamp on its own wall."""
    return F.unix_micros(ts.cast("timestamp"))


def even_targets(lo: Column, hi: Column, n: int) -> Column:
    """``n`` evenly spaced points from ``lo`` to ``hi``, as an array of doubles."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: lo.cast("double") + i.cast("double") * (hi - lo).cast("double") / F.lit(float(max(n - 1, 1))))


def date_text(date: Column) -> Column:
    """``YYYY-MM-DD HH:MM`` cut from a compact date, by position."""
    part = lambda a, n: F.substring(date, a, n)
    return F.concat(part(1, 4), F.lit("-"), part(5, 2), F.lit("-"), part(7, 2), F.lit(" "), part(9, 2), F.lit(":"), part(11, 2))
