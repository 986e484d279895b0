"""Fiscal periods, calendars and business days as dimension tables, joined by range."""

from __future__ import annotations

import re
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class PeriodError(ValueError):
    """A period key or calendar that can't be used."""


def _month_end(y: int, m: int) -> date:
    y, m = y + (m - 1) // 12, (m - 1) % 12 + 1
    return date(y + m // 12, m % 12 + 1, 1) - timedelta(days=1)


def _months_before(end: date, n: int) -> date:
    """First day of the n-th month up to and with that of ``end``."""
    at = end.year * 12 + end.month - n
    return date(at // 12, at % 12 + 1, 1)


def parse(key: str, year_end: int = 12) -> tuple[str, date, date]:
    """(kind, start, end) of a key: fy2025, fy2025h1, 2026q1, fy2025p03, 2025-12, ltm_2025-06, ytd_2025-06, w2025-01-01_2025-01-31."""

    def year(y: int) -> tuple[date, date]:
        end = _month_end(y, year_end)
        return _months_before(end, 12), end

    if m := re.fullmatch(r"fy(\d{4})", key):
        return ("year", *year(int(m[1])))
    if m := re.fullmatch(r"fy(\d{4})h([12])", key):
        first = year(int(m[1]))[0]
        part = int(m[2])
        return "half", _months_before(_month_end(first.year, first.month + 6 * (part - 1)), 1), _month_end(first.year, first.month + 6 * part - 1)
    if m := re.fullmatch(r"(?:fy)?(\d{4})q([1-4])", key):
        first = year(int(m[1]))[0]
        part = int(m[2])
        return "quarter", _months_before(_month_end(first.year, first.month + 3 * (part - 1)), 1), _month_end(first.year, first.month + 3 * part - 1)
    if m := re.fullmatch(r"fy(\d{4})p(0[1-9]|1[0-2])", key):
        first = year(int(m[1]))[0]
        end = _month_end(first.year, first.month + int(m[2]) - 1)
        return "period", _months_before(end, 1), end
    if m := re.fullmatch(r"(\d{4})-(0[1-9]|1[0-2])", key):
        end = _month_end(int(m[1]), int(m[2]))
        return "month", _months_before(end, 1), end
    if m := re.fullmatch(r"ltm_(\d{4})-(0[1-9]|1[0-2])", key):
        end = _month_end(int(m[1]), int(m[2]))
        return "ltm", _months_before(end, 12), end
    if m := re.fullmatch(r"ytd_(\d{4})-(0[1-9]|1[0-2])", key):
        end = _month_end(int(m[1]), int(m[2]))
        first = year(end.year + (end.month > year_end))[0]
        return "ytd", first, end
    if m := re.fullmatch(r"w(\d{4}-\d{2}-\d{2})_(\d{4}-\d{2}-\d{2})", key):
        start, end = date.fromisoformat(m[1]), date.fromisoformat(m[2])
        if start > end:
            raise PeriodError(f"{key}: a window runs forward")
        return "window", start, end
    raise PeriodError(f"{key}: no period key")


def dimension(spark: SparkSession, keys: list[str], year_end: int = 12) -> DataFrame:
    """(key, kind, start, end, ord) of the keys."""
    rows = [(k, *parse(k, year_end), i) for i, k in enumerate(keys)]
    return spark.createDataFrame(rows, "key string, kind string, start date, end date, ord int")


def by_period(df: DataFrame, day: str, periods: DataFrame) -> DataFrame:
    """Rows with each period they fall in; a row may fall in several. The dimension is as small as its list of keys."""
    return df.join(F.broadcast(periods), F.col(day).between(F.col("start"), F.col("end")))


def by_declared(df: DataFrame, day: str, years: DataFrame) -> DataFrame:
    """Rows with the declared year (year, start, end) that they fall in; a day that no declared year covers is refused."""
    both = df.join(F.broadcast(years.select("year", "start", "end")), F.col(day).between(F.col("start"), F.col("end")), "left")
    if n := both.filter(F.col(day).isNotNull() & F.col("year").isNull()).count():
        raise PeriodError(f"{n} rows have a {day} that no declared year covers")
    return both


def thirteen_periods(years: DataFrame) -> DataFrame:
    """(year, period, start, end) of declared years: thirteen periods of four weeks, the last one to the year's end; short years have fewer."""
    each = years.withColumn("period", F.explode(F.sequence(F.lit(1), F.lit(13))))
    first = F.date_add("start", 28 * (F.col("period") - 1))
    last = F.when(F.col("period") == 13, F.col("end")).otherwise(F.least(F.date_add("start", 28 * F.col("period") - 1), F.col("end")))
    return each.select("year", "period", first.alias("start"), last.alias("end")).filter(F.col("start") <= F.col("end"))


def overlaps(ranges: DataFrame) -> DataFrame:
    """(key, start, end, former_end) of ranges (key, start, end) that begin before one of their key that began earlier has ended."""
    w = Window.partitionBy("key").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.select("key", "start", "end", F.max("end").over(w).alias("former_end")).filter(F.col("start") <= F.col("former_end"))


def cutoff(day: Column, period_end: Column, before: int, after: int) -> Column:
    """Where a day stands to a period's end: in the days before it, in those after it, or null outside the window."""
    gap = F.date_diff(day, period_end)
    return F.when(gap.between(-before, 0), "before").when(gap.between(1, after), "after")


def flow_label(kind: str, start: Column, end: Column) -> Column:
    """A heading by kind: a flow covers its period, a snapshot is as of its end."""
    if kind not in ("flow", "snapshot"):
        raise PeriodError(f"{kind}: flow or snapshot")
    date_of = lambda d: F.date_format(d, "MMM d, yyyy")
    return F.concat(F.lit("As of "), date_of(end)) if kind == "snapshot" else F.concat(date_of(start), F.lit(" to "), date_of(end))


def fiscal_year(day: Column, year_end: int) -> Column:
    return F.year(day) + (F.month(day) > year_end).cast("int")


def weeks_52_53(spark: SparkSession, first: date, years: dict[int, int]) -> DataFrame:
    """(year, start, end) of declared years of 52 or 53 weeks, one after the other."""
    rows, start = [], first
    for y, weeks in years.items():
        if weeks not in (52, 53):
            raise PeriodError(f"{y}: a year has 52 or 53 weeks")
        end = start + timedelta(days=7 * weeks - 1)
        rows.append((y, start, end))
        start = end + timedelta(days=1)
    return spark.createDataFrame(rows, "year int, start date, end date")


def business_days(spark: SparkSession, start: date, end: date, weekend: tuple[int, ...] = (1, 7), holidays: tuple[date, ...] = ()) -> DataFrame:
    """(date, is_business, n): every day, and how many business days there are up to it."""
    days = spark.range((end - start).days + 1).select(F.date_add(F.lit(start), F.col("id").cast("int")).alias("date"))
    ok = ~F.dayofweek("date").isin(*weekend)
    if holidays:
        ok = ok & ~F.col("date").isin(*holidays)
    return days.withColumn("is_business", ok).withColumn("n", F.expr("cast(sum(cast(is_business as int)) over (order by date) as int)"))


def local_day(at: Column, zone: str) -> Column:
    """The local date of an instant that is kept as UTC without a zone."""
    return F.to_date(F.from_utc_timestamp(at.cast("timestamp"), zone))


def in_gap(local: Column, zone: str) -> Column:
    """Whether a local time doesn't exist (clocks go forward): it doesn't come back from UTC."""
    at = local.cast("timestamp")
    return F.from_utc_timestamp(F.to_utc_timestamp(at, zone), zone) != at
