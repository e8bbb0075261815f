"""Numbers of statistical files as dates, datetimes and times, as Catalyst expressions.

Times are microseconds of the day as BIGINT, since TIME needs a session flag.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Days and seconds from the formats' epochs to 1970-01-01.
SAS_DAYS = STATA_DAYS = 3653
SPSS_SECONDS = 12_219_379_200
DAY = 86_400
SAS_LEAST, SAS_MOST = -135_080, 156_935
SAS_MICROS = 9e18
# SAS display formats by kind; a format belongs to the first kind with a name it begins with.
SAS_DATETIME = ("DATETIME", "DTWKDATX", "B8601DN", "B8601DT", "B8601DX", "B8601DZ", "B8601LX", "E8601DN", "E8601DT", "E8601DX", "E8601DZ", "E8601LX", "DATEAMPM", "DTDATE", "DTMONYY", "DTYEAR", "TOD", "MDYAMPM")
SAS_DATE = (
    "DATE", "DAY", "DDMMYY", "JULDAY", "JULIAN", "MMDDYY", "MMYY", "MONNAME", "MONTH", "MONYY", "QTR", "NENGO", "WEEKDATE", "WEEKDATX", "WEEKDAY",
    "WEEKV", "WORDDATE", "WORDDATX", "YEAR", "YYMM", "YYMON", "YYQ",
)
SAS_TIME = ("TIME", "HHMM")


def sas_kind(fmt: str | None) -> str | None:
    """date, datetime or time by the beginning of the format's name."""
    name = (fmt or "").upper()
    for kind, names in (("datetime", SAS_DATETIME), ("date", SAS_DATE), ("time", SAS_TIME)):
        if name.startswith(names):
            return kind
    return None


def whole(c: Column, bound: float = 9e15) -> Column:
    """Toward zero, null where it is not finite or not within the bound."""
    return F.when(~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < bound), F.when(c >= 0, F.floor(c)).otherwise(F.ceil(c))).cast("long")


def of_days(days: Column) -> Column:
    return F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int"))


def of_micros(micros: Column) -> Column:
    """TIMESTAMP_NTZ at so many microseconds since 1970, whatever the session's time zone."""
    return F.timestamp_add("MICROSECOND", micros, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def sas_date(c: Column, fractions: bool = False) -> Column:
    """Days since 1960; where that is outside the bounds, counted from 1970, the value has seconds.

    Whole days are held against the bounds, as a scan does; with `fractions` the value as it is, so that one
    past the last day by a part of a day has seconds too.
    """
    days, seconds = whole(c) - SAS_DAYS, whole(c / DAY) - SAS_DAYS
    held = c - SAS_DAYS if fractions else days
    return of_days(F.when(held.between(SAS_LEAST, SAS_MOST), days).otherwise(seconds))


def sas_datetime(c: Column) -> Column:
    return of_micros(whole((c - SAS_DAYS * DAY) * 1_000_000, SAS_MICROS))


def sas_time(c: Column) -> Column:
    return whole(c * 1_000_000, SAS_MICROS)


def stata_date(c: Column, unit: str = "d") -> Column:
    """Units d, w, m, q, h, y since 1960: the first day of the period."""
    n = whole(c)
    start = F.lit("1960-01-01").cast("date")
    if unit == "d":
        return of_days(n - STATA_DAYS)
    if unit == "w":  # 52 weeks a year, each year's first begins on 1 January
        return F.date_add(F.add_months(start, (12 * F.floor(n / 52)).cast("int")), (7 * F.pmod(n, F.lit(52))).cast("int"))
    months = {"m": n, "q": 3 * n, "h": 6 * n, "y": 12 * (n - 1960)}[unit]
    return F.add_months(start, months.cast("int"))


def stata_datetime(c: Column) -> Column:
    return of_micros((whole(c) - STATA_DAYS * DAY * 1000) * 1000)


def stata_time(c: Column) -> Column:
    return F.pmod(whole(c), F.lit(DAY * 1000)) * 1000


def spss_date(c: Column) -> Column:
    return of_days(whole((whole(c) - SPSS_SECONDS) / DAY))


def spss_datetime(c: Column) -> Column:
    return of_micros((whole(c) - SPSS_SECONDS) * 1_000_000)


def spss_time(c: Column) -> Column:
    return whole(c) * 1_000_000
