"""Settlement calendar: epoch seconds in a fixed +05:30 offset, whatever the session's time zone."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from .money import div

OFFSET, DAY = 19_800, 86_400
#: Hour of the resolver's and of the simulators' cut-off.
RESOLVER_HOUR, SIMULATOR_HOUR = 11, 17


def local_day(ts: Column) -> Column:
    """Days since the epoch of the local date."""
    return div(ts + OFFSET, DAY)


def weekday(day: Column) -> Column:
    """0 for Sunday to 6 for Saturday; the epoch was a Thursday."""
    return (day + 4) % 7


def two_working_days(day: Column) -> Column:
    """The second working day after ``day``: two days on, and past a weekend between."""
    w = weekday(day)
    return day + F.when(w.isin(4, 5), 4).when(w == 6, 3).otherwise(2)


def add_working_days(day: Column, n: int) -> Column:
    """The n-th working day after ``day``, any n: whole weeks first, then the rest over at most one weekend."""
    w = weekday(day)
    start = F.when(w == 6, day - 1).when(w == 0, day - 2).otherwise(day)  # a weekend counts from its Friday
    at = F.when(w.isin(6, 0), F.lit(5)).otherwise(w)
    rest = n % 5
    return start + 7 * (n // 5) + rest + F.when(at + rest > 5, 2).otherwise(0) if n else day


def eligible_at(ts: Column, hour: int = RESOLVER_HOUR) -> Column:
    """When a payment can settle: two working days on, at the cut-off."""
    return two_working_days(local_day(ts)) * DAY + hour * 3600 - OFFSET


def end_of_day(day: Column) -> Column:
    """The local midnight that ends a date."""
    return (day + 1) * DAY - OFFSET


def day_of(date: Column) -> Column:
    """Days since the epoch of a date or timestamp."""
    return F.datediff(F.to_date(date), F.lit("1970-01-01").cast("date")).cast("long")


def month_of(day: Column) -> Column:
    """YYYY-MM of days since the epoch."""
    return F.date_format(F.date_add(F.lit("1970-01-01").cast("date"), day.cast("int")), "yyyy-MM")


def age_bucket(days: Column) -> Column:
    return F.when(days <= 30, "0-30").when(days <= 60, "31-60").when(days <= 90, "61-90").otherwise("90+")


def roll_forward(day: Column, holidays: list[int]) -> Column:
    """The first day from ``day`` on that is neither at a weekend nor a holiday (days since the epoch)."""
    days = F.sequence(day, day + 7 * (len(set(holidays)) // 5 + 2))  # each week that is closed throughout takes five holidays
    return F.array_min(F.filter(days, lambda d: ~weekday(d).isin(0, 6) & ~d.isin(holidays)))
