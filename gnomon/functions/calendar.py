"""Business days, holidays, funding windows and cron."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def neighbours(asked: DataFrame, days: DataFrame, *, day: str) -> DataFrame:
    """The next and the previous of ``days`` for each day asked; one row each.

    Calendars are small (one row per day), so one ordered window serves all.
    """
    marks = asked.select(day, F.lit(True).alias("__q")).unionByName(days.select(day, F.lit(False).alias("__q")))
    w = Window.orderBy(F.unix_date(day))
    open_day = F.when(~F.col("__q"), F.col(day))
    out = marks.withColumn("next_day", F.min(open_day).over(w.rangeBetween(1, Window.unboundedFollowing))).withColumn("prev_day", F.max(open_day).over(w.rangeBetween(Window.unboundedPreceding, -1)))
    return out.where("__q").drop("__q")


def parts(day: Column) -> list[Column]:
    """Calendar columns of a date; Monday is 0."""
    return [F.year(day).alias("year"), F.quarter(day).alias("quarter"), F.month(day).alias("month"), F.weekday(day).alias("day_of_week"), F.date_format(day, "EEEE").alias("day_name"), (F.weekday(day) < 5).alias("is_weekday")]


def easter(year: Column) -> Column:
    """Easter Sunday in the Gregorian calendar."""
    a, b, c = year % 19, F.floor(year / 100), year % 100
    d, e = F.floor(b / 4), b % 4
    g = F.floor((8 * b + 13) / 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = F.floor(c / 4), c % 4
    r = (32 + 2 * e + 2 * i - h - k) % 7
    m = F.floor((a + 11 * h + 19 * r) / 433)
    month = F.floor((h + r - 7 * m + 90) / 25)
    return F.make_date(year, month.cast("int"), ((h + r - 7 * m + 33 * month + 19) % 32).cast("int"))


def _nth(year: Column, month: int, weekday: int, n: int) -> Column:
    """The n-th weekday (Monday 0) of a month; counted from its end if n is negative."""
    if n > 0:
        first = F.make_date(year, F.lit(month), F.lit(1))
        return F.date_add(first, F.pmod(F.lit(weekday) - F.weekday(first), F.lit(7)) + 7 * (n - 1))
    last = F.last_day(F.make_date(year, F.lit(month), F.lit(1)))
    return F.date_sub(last, F.pmod(F.weekday(last) - F.lit(weekday), F.lit(7)) + 7 * (-n - 1))


def _observed(day: Column) -> Column:
    return F.when(F.weekday(day) == 5, F.date_sub(day, 1)).when(F.weekday(day) == 6, F.date_add(day, 1)).otherwise(day)


def us_holidays(years: DataFrame, year: str = "year", legacy: bool = False) -> DataFrame:
    """``(day, name)`` of the ten market holidays of each year.

    With ``legacy``, Martin Luther King day is a week late in years that begin on
    a Monday, as some older calendars have it.
    """
    y = F.col(year)
    fixed = lambda m, d: _observed(F.make_date(y, F.lit(m), F.lit(d)))
    king = _nth(y, 1, 0, 3)
    if legacy:
        king = F.when(F.weekday(F.make_date(y, F.lit(1), F.lit(1))) == 0, F.date_add(king, 7)).otherwise(king)
    days = [
        ("New Year's Day", fixed(1, 1)), ("Martin Luther King Jr. Day", king), ("Presidents' Day", _nth(y, 2, 0, 3)),
        ("Good Friday", F.date_sub(easter(y), 2)), ("Memorial Day", _nth(y, 5, 0, -1)), ("Juneteenth", fixed(6, 19)),
        ("Independence Day", fixed(7, 4)), ("Labor Day", _nth(y, 9, 0, 1)), ("Thanksgiving Day", _nth(y, 11, 3, 4)), ("Christmas Day", fixed(12, 25)),
    ]
    return years.select(F.inline(F.array(*(F.struct(d.alias("day"), F.lit(n).alias("name")) for n, d in days))))


def calendar(spark: SparkSession, first_year: int, last_year: int, exchange: str = "NYSE") -> DataFrame:
    """A row for each day of the years, with its parts and holidays."""
    years = spark.range(first_year, last_year + 2).select(F.col("id").cast("int").alias("year"))
    days = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))).alias("day"))
    j = days.join(F.broadcast(us_holidays(years)), "day", "left")
    return j.select(F.col("day").alias("calendar_date"), F.lit(exchange).alias("exchange_code"), *parts(F.col("day")), ((F.weekday("day") < 5) & F.col("name").isNull()).alias("is_business_day"), F.col("name").isNotNull().alias("is_holiday"), F.col("name").alias("holiday_name"))


def funding_floor(ts: Column, hours: int = 8) -> Column:
    """The funding window that a time lies in."""
    step = hours * 3600
    return F.timestamp_seconds(F.floor(F.unix_seconds(ts) / step) * step)


def funding_next(ts: Column, hours: int = 8) -> Column:
    """The window after the one that a time lies in."""
    step = hours * 3600
    return F.timestamp_seconds((F.floor(F.unix_seconds(ts) / step) + 1) * step)


def cron_field(text: str, low: int, high: int) -> set[int]:
    """The values that one cron field allows: ``*``, lists, ranges and steps."""
    out: set[int] = set()
    for item in text.split(","):
        span, _, step = item.partition("/")
        if span == "*":
            a, b = low, high
        elif "-" in span:
            a, b = map(int, span.split("-"))
        else:
            a = int(span)
            b = high if step else a
        out |= set(range(a, b + 1, int(step or 1)))
    return {x for x in out if low <= x <= high}


def cron_match(expression: str, ts: Column) -> Column:
    """Whether a time matches a five-field cron expression; Sunday is 0 or 7."""
    minute, hour, day, month, week = expression.split()
    weekdays = {x % 7 for x in cron_field(week, 0, 7)}
    tests = [(F.minute(ts), cron_field(minute, 0, 59)), (F.hour(ts), cron_field(hour, 0, 23)), (F.dayofmonth(ts), cron_field(day, 1, 31)), (F.month(ts), cron_field(month, 1, 12)), (F.dayofweek(ts) - 1, weekdays)]
    out = F.lit(True)
    for value, allowed in tests:
        out = out & value.isin(sorted(allowed))
    return out


def cron_matches(expression: str, at: datetime) -> bool:
    """The same for one time on the driver."""
    minute, hour, day, month, week = expression.split()
    return (
        at.minute in cron_field(minute, 0, 59)
        and at.hour in cron_field(hour, 0, 23)
        and at.day in cron_field(day, 1, 31)
        and at.month in cron_field(month, 1, 12)
        and at.isoweekday() % 7 in {x % 7 for x in cron_field(week, 0, 7)}
    )
