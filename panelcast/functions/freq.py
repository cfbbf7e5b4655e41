"""Frequencies: parsing, season lengths, and calendar steps as column expressions.

Anchored frequencies first roll the last time stamp forward to an anchor and step from there, as
pandas' ``date_range`` does; an unaligned last time stamp therefore skips one period.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The season of a frequency's letters, multiples ignored.
SEASONS = {"D": 7, "B": 5, "H": 24, "h": 24, "T": 60, "min": 60, "M": 12, "ME": 12, "MS": 12, "Q": 4, "QS": 4, "W": 52}
_CLOCK = {"h": 3600, "H": 3600, "min": 60, "T": 60, "s": 1, "S": 1, "ms": 1e-3, "L": 1e-3, "us": 1e-6, "U": 1e-6}
_MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")
# pandas' letters of periods of months: (months, anchored at the end, on a business day).
_PERIODS = {
    "MS": (1, False, False), "BMS": (1, False, True), "ME": (1, True, False), "M": (1, True, False), "BME": (1, True, True), "BM": (1, True, True),
    "QS": (3, False, False), "BQS": (3, False, True), "QE": (3, True, False), "Q": (3, True, False), "BQE": (3, True, True), "BQ": (3, True, True),
    "YS": (12, False, False), "AS": (12, False, False), "BYS": (12, False, True), "BAS": (12, False, True),
    "YE": (12, True, False), "Y": (12, True, False), "A": (12, True, False), "BYE": (12, True, True), "BY": (12, True, True), "BA": (12, True, True),
}
# Letters that pandas gave up, and today's.
_TODAY = {"H": "h", "T": "min", "S": "s", "L": "ms", "U": "us", "M": "ME", "BM": "BME", "Q": "QE", "BQ": "BQE", "AS": "YS", "BAS": "BYS", "Y": "YE", "A": "YE", "BY": "BYE", "BA": "BYE", "SM": "SME"}
_DAYS = ("SUN", "MON", "TUE", "WED", "THU", "FRI", "SAT")


def parse(freq: str) -> tuple[int, str]:
    """(multiple, letters) of a frequency such as ``2MS``."""
    m = re.fullmatch(r"(\d*)([A-Za-z]+(?:-[A-Z]{3})?)", freq)
    if not m or m[1] and int(m[1]) < 1:
        raise ValueError(f"Invalid frequency: {freq}")
    return int(m[1] or 1), m[2]


def normalize_alias(freq: str) -> str:
    """The old hour and month letters in today's spelling."""
    m = re.fullmatch(r"(\d*)([HM])", freq)
    return f"{m[1]}{'h' if m[2] == 'H' else 'ME'}" if m else freq


def pandas_alias(freq: str) -> str:
    """The frequency as today's pandas spells it."""
    n, letters = parse(freq)
    base, dash, anchor = letters.partition("-")
    return f"{n if n > 1 else ''}{_TODAY.get(base, base)}{dash}{anchor}"


def period_alias(freq: str) -> str:
    """The pandas period that a frequency steps through, multiple included."""
    n, letters = parse(freq)
    base, _, anchor = letters.partition("-")
    if base in _PERIODS:
        months, end, _ = _PERIODS[base]
        last = _MONTHS.index(anchor) if anchor else (11 if end else 0)
        last = last if end else (last - 1) % 12  # a period that starts in one month ends in the one before
        base, anchor = {1: "M", 3: "Q", 12: "Y"}[months], "" if months == 1 else _MONTHS[last]
    elif base in ("SMS", "SM", "SME"):
        raise ValueError(f"No period has the frequency {freq}")
    else:
        base = {"C": "B"}.get(base, _TODAY.get(base, base))
    return f"{n if n > 1 else ''}{base}{'-' if anchor else ''}{anchor}"


def season_length(freq: str) -> int | None:
    return SEASONS.get(freq.lstrip("0123456789"))


def _weekday(d: Column, back: bool) -> Column:
    """The first weekday from date ``d`` on, or the last one up to it."""
    saturday, sunday = (-1, -2) if back else (2, 1)
    return F.date_add(d, F.when(F.weekday(d) == 5, saturday).when(F.weekday(d) == 6, sunday).otherwise(0))


def _period(d: Column, m: Column, months: int, anchor: int, end: bool, business: bool) -> Column:
    """The anchor ``m`` periods after the first one from date ``d`` on; a period starts or ends in month ``anchor``."""

    def point(month: Column) -> Column:
        day = F.last_day(month) if end else month
        return _weekday(day, end) if business else day

    near = F.trunc(d, "MM")
    if months > 1:
        off = F.pmod(F.lit(anchor) - F.month(d), F.lit(months)) if end else -F.pmod(F.month(d) - F.lit(anchor), F.lit(months))
        near = F.add_months(near, off.cast("int"))
    # an end that is no business day never lies before d; else the anchor near d may have passed
    passed = F.lit(0) if end and not business else F.when(d <= point(near), 0).otherwise(1)
    return point(F.add_months(near, (m + passed) * months))


def _anchored(letters: str, d: Column, m: Column) -> Column | None:
    """The date ``m`` steps after date ``d``; None for a clock frequency."""
    base, dash, anchor = letters.partition("-")
    month = F.trunc(d, "MM")
    if letters == "D":
        return F.date_add(d, m)
    if base == "W" and (not dash or anchor in _DAYS):
        day = anchor or "SUN"
        first = F.when(F.dayofweek(d) == _DAYS.index(day) + 1, d).otherwise(F.next_day(d, day))
        return F.date_add(first, 7 * m)
    if letters in ("B", "C"):
        first = _weekday(d, False)
        return F.date_add(first, (m + 2 * F.floor((F.weekday(first) + m) / 5)).cast("int"))
    if base in _PERIODS and (not dash or anchor in _MONTHS and _PERIODS[base][0] > 1):
        months, end, business = _PERIODS[base]
        return _period(d, m, months, _MONTHS.index(anchor) + 1 if dash else 12 if end else 1, end, business)
    if letters in ("SMS", "SM", "SME"):  # twice a month: the 1st and the 15th, or the 15th and the last day
        start = letters == "SMS"
        half = F.when(F.dayofmonth(d) == 1, 0).when(F.dayofmonth(d) <= 15, 1).otherwise(2) if start else F.when(F.dayofmonth(d) <= 15, 0).otherwise(1)
        steps = half + m
        at = F.add_months(month, F.floor(steps / 2).cast("int"))
        middle = F.date_add(at, 14)
        return F.when(steps % 2 == (1 if start else 0), middle).otherwise(at if start else F.last_day(at))
    if letters in _CLOCK:
        return None
    raise ValueError(f"Invalid frequency: {letters}")


def check(freq: str) -> None:
    """Raise ValueError, at plan time, for a frequency that has no calendar."""
    _, letters = parse(freq)
    if letters not in _CLOCK:
        _anchored(letters, F.lit("2024-01-01").cast("date"), F.lit(1))


def future(last: Column, step: Column, freq: str) -> Column:
    """The time stamp ``step`` (from 1) periods after ``last``, a TIMESTAMP_NTZ."""
    n, letters = parse(freq)
    m = (step * n).cast("int")
    if letters in _CLOCK:
        micros = int(_CLOCK[letters] * 1_000_000)
        return last + F.make_dt_interval(secs=(m.cast("decimal(18,0)") * micros / 1_000_000).cast("decimal(18,6)"))
    day = last.cast("date")
    return _anchored(letters, day, m).cast("timestamp_ntz") + (last - day.cast("timestamp_ntz"))
