"""Date and time functions over native dates and timestamps. Weeks start on Sunday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..values import col
from . import function

INTERVALS = ("DAY", "WEEK", "MONTH", "QTR", "YEAR")


def _date(x) -> Column:
    return col(x).cast("date")


def _week(d: Column) -> Column:
    """The Sunday that begins the week."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def _begin(interval: str, d: Column) -> Column:
    return {"DAY": lambda: d, "WEEK": lambda: _week(d), "MONTH": lambda: F.trunc(d, "month"), "QTR": lambda: F.trunc(d, "quarter"), "YEAR": lambda: F.trunc(d, "year")}[interval]()


def _add(interval: str, d: Column, n: Column) -> Column:
    if interval in ("DAY", "WEEK"):
        return F.date_add(d, (n * (7 if interval == "WEEK" else 1)).cast("int"))
    return F.add_months(d, (n * {"MONTH": 1, "QTR": 3, "YEAR": 12}[interval]).cast("int"))


def _named(interval: str) -> str:
    name = {"QUARTER": "QTR"}.get(interval.upper(), interval.upper())
    if name not in INTERVALS:
        raise ValueError(f"the interval {interval} is unknown")
    return name


@function("MDY")
def mdy(m, d, y) -> Column:
    """Missing for a date that doesn't exist."""
    parts = F.format_string("%04d-%02d-%02d", col(y).cast("int"), col(m).cast("int"), col(d).cast("int"))
    return F.when(col(m).isNotNull() & col(d).isNotNull() & col(y).isNotNull(), F.to_date(F.try_to_timestamp(parts, F.lit("yyyy-MM-dd"))))


function("TODAY", "DATE")(lambda: F.current_date())
function("YEAR")(lambda d: F.year(_date(d)))
function("MONTH")(lambda d: F.month(_date(d)))
function("DAY")(lambda d: F.dayofmonth(_date(d)))
function("QTR")(lambda d: F.quarter(_date(d)))
function("WEEKDAY")(lambda d: F.dayofweek(_date(d)))
function("DATEPART")(lambda t: _date(t))
function("HOUR")(lambda t: F.hour(col(t)))
function("MINUTE")(lambda t: F.minute(col(t)))
function("SECOND")(lambda t: F.floor(F.second(col(t))).cast("int"))
function("TIMEPART")(lambda t: F.hour(col(t)) * 3600 + F.minute(col(t)) * 60 + F.second(col(t)))
function("JULDATE")(lambda d: F.dayofyear(_date(d)))
function("NLDATE")(lambda d: F.upper(F.date_format(_date(d), "ddMMMyyyy")))


@function("HMS")
def hms(h, m, s) -> Column:
    """Seconds; minutes and seconds outside 0 to 59 are missing."""
    h, m, s = col(h), col(m), col(s)
    return F.when(m.between(0, 59) & (s >= 0) & (s < 60), h * 3600 + m * 60 + s)


@function("DHMS")
def dhms(d, h, m, s) -> Column:
    base = _date(d).cast("timestamp_ntz")
    seconds = hms(h, m, s)
    return F.timestamp_add("SECOND", seconds.cast("int"), base)


@function("DATETIME")
def datetime_(d, t=0) -> Column:
    """A date and seconds of the day as one timestamp."""
    return F.timestamp_add("SECOND", col(t).cast("int"), _date(d).cast("timestamp_ntz"))


@function("DATEJUL")
def datejul(n, cutoff: int = 1926) -> Column:
    """yyddd or yyyyddd; two-digit years fall in the hundred years from cutoff."""
    n = col(n).cast("int")
    yy, ddd = F.floor(n / 1000).cast("int"), (n % 1000).cast("int")
    base = cutoff - cutoff % 100
    year = F.when(yy >= 1000, yy).when(yy >= 100, yy + 1900).when(yy >= cutoff % 100, yy + base).otherwise(yy + base + 100)
    start = F.make_date(year, F.lit(1), F.lit(1))
    leap = F.dayofyear(F.make_date(year, F.lit(12), F.lit(31)))
    return F.when(ddd.between(1, leap), F.date_add(start, ddd - 1))


@function("INTCK")
def intck(interval: str, frm, to) -> Column:
    """Interval boundaries between two dates."""
    name, a, b = _named(interval), _date(frm), _date(to)
    if name == "DAY":
        return F.datediff(b, a)
    if name == "WEEK":
        return (F.datediff(_week(b), _week(a)) / 7).cast("int")
    if name == "YEAR":
        return F.year(b) - F.year(a)
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    return months if name == "MONTH" else (F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)


@function("INTNX")
def intnx(interval: str, start, n, align: str = "B") -> Column:
    """The date n intervals on: Beginning, Middle, End, or Same place."""
    name, d, n, how = _named(interval), _date(start), col(n), align.upper()[:1]
    if how == "S":
        return _add(name, d, n)
    begin = _add(name, _begin(name, d), n)
    if how == "B" or name == "DAY":
        return begin
    if how == "E":
        return F.date_sub(_add(name, begin, F.lit(1)), 1)
    if how == "M":
        middle = {"WEEK": lambda: F.date_add(begin, 3), "MONTH": lambda: F.date_add(begin, 14), "QTR": lambda: F.date_add(F.add_months(begin, 1), 14), "YEAR": lambda: F.add_months(begin, 6)}
        return middle[name]()
    raise ValueError(f"the alignment {align} is unknown")


def _days30(a: Column, b: Column, eur: bool) -> Column:
    d1 = F.least(F.dayofmonth(a), F.lit(30))
    d2 = F.dayofmonth(b)
    d2 = F.least(d2, F.lit(30)) if eur else F.when((d2 == 31) & (d1 >= 30), 30).otherwise(d2)
    return (F.year(b) - F.year(a)) * 360 + (F.month(b) - F.month(a)) * 30 + d2 - d1


def _basis(basis: str) -> str:
    b = basis.upper().replace(" ", "")
    return {"ACTUAL": "ACT/ACT", "ACT": "ACT/ACT", "ACT/365": "ACT/ACT", "30/360US": "30/360", "30/360EUR": "30E/360", "30E/360": "30E/360"}.get(b, b)


@function("DATDIF")
def datdif(frm, to, basis: str = "ACT/ACT") -> Column:
    b = _basis(basis)
    return _days30(_date(frm), _date(to), b == "30E/360") if b.startswith("30") else F.datediff(_date(to), _date(frm))


@function("YRDIF")
def yrdif(frm, to, basis: str = "ACT/ACT") -> Column:
    b = _basis(basis)
    if b.startswith("30"):
        return _days30(_date(frm), _date(to), b == "30E/360") / 360
    return F.datediff(_date(to), _date(frm)) / (360 if b == "ACT/360" else 365)
