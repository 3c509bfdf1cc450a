"""Date and time functions, from columns to columns.

Times are timestamps (without a zone, or in a session in UTC); durations are nanoseconds in a
long. Spark keeps microseconds, so finer durations are cut off when added to a time.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NANOS = {"days": 86_400 * 10**9, "hours": 3_600 * 10**9, "minutes": 60 * 10**9, "seconds": 10**9, "milliseconds": 10**6, "microseconds": 1_000, "nanoseconds": 1}
#: Multiples of a duration are counted from the first day of year 1, this many days before 1970.
ORIGIN_DAYS = 719_162


def nanos(**parts: float) -> int:
    """A duration: ``nanos(hours=1, minutes=30)``."""
    return int(sum(NANOS[k] * v for k, v in parts.items()))


def micros(ts: Column) -> Column:
    """Microseconds since 1970, for times with and without a zone."""
    return F.unix_micros(ts.cast("timestamp"))


def from_micros(us: Column, like: str = "timestamp_ntz") -> Column:
    return F.timestamp_micros(us).cast(like)


def year(ts: Column) -> Column:
    return F.year(ts).cast("long")


def month(ts: Column) -> Column:
    return F.month(ts).cast("long")


def day(ts: Column) -> Column:
    return F.dayofmonth(ts).cast("long")


def hour(ts: Column) -> Column:
    return F.hour(ts).cast("long")


def minute(ts: Column) -> Column:
    return F.minute(ts).cast("long")


def second(ts: Column) -> Column:
    return F.second(ts).cast("long")


def day_of_week(ts: Column) -> Column:
    """0 for Sunday to 6."""
    return (F.dayofweek(ts) - 1).cast("long")


def day_of_year(ts: Column) -> Column:
    return F.dayofyear(ts).cast("long")


def quarter(ts: Column) -> Column:
    return F.quarter(ts).cast("long")


def week(ts: Column) -> Column:
    """The ISO week."""
    return F.weekofyear(ts).cast("long")


def unix(ts: Column) -> Column:
    return F.unix_seconds(ts.cast("timestamp"))


def date_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def time_text(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def _multiple(us: Column, period: int) -> Column:
    origin = F.lit(ORIGIN_DAYS * 86_400 * 10**6)
    return us - F.pmod(us + origin, F.lit(period))


def floor(ts: Column, duration: int) -> Column:
    """The last multiple of the duration (nanoseconds) up to ``ts``."""
    return from_micros(_multiple(micros(ts), _us(duration)))


def ceil(ts: Column, duration: int) -> Column:
    us = micros(ts)
    low = _multiple(us, _us(duration))
    return from_micros(F.when(low == us, us).otherwise(low + _us(duration)))


def round_to(ts: Column, duration: int) -> Column:
    """The nearest multiple, the later one of two."""
    return from_micros(_multiple(micros(ts) + F.lit(_us(duration) // 2 + _us(duration) % 2), _us(duration)))


def _us(duration: int) -> int:
    if duration < 1_000:
        raise ValueError("a duration of a microsecond at least is wanted")
    return duration // 1_000


def shift(ts: Column, duration: Column | int) -> Column:
    """``ts`` and a duration in nanoseconds."""
    ns = F.lit(duration) if isinstance(duration, int) else duration
    return from_micros(micros(ts) + (ns / F.lit(1_000)).cast("bigint"))


def difference(a: Column, b: Column) -> Column:
    """a - b in nanoseconds."""
    return (micros(a) - micros(b)) * F.lit(1_000).cast("bigint")


def scaled(duration: Column, factor: float) -> Column:
    return (duration * F.lit(float(factor))).cast("bigint")


def divided(duration: Column, divisor: float) -> Column:
    """Nanoseconds; NaN (as a double) for a divisor of 0."""
    if divisor == 0:
        return F.lit(float("nan"))
    return (duration * F.lit(1.0 / divisor)).cast("bigint")


def ratio(a: Column, b: Column) -> Column:
    """a / b; null for a b of 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def to_unit(duration: Column, unit: str) -> Column:
    return duration / F.lit(float(NANOS[unit]))


def from_unit(amount: Column, unit: str) -> Column:
    return (amount * F.lit(float(NANOS[unit]))).cast("bigint")


def format_duration(duration: Column) -> Column:
    """Days, hours, minutes and seconds, as in 1d2h3m4s."""
    s = F.floor(F.abs(duration) / F.lit(NANOS["seconds"])).cast("bigint")
    sign = F.when(duration < 0, F.lit("-")).otherwise(F.lit(""))
    part = lambda per, of: F.floor(s % of / per).cast("bigint").cast("string")
    days = F.floor(s / 86_400).cast("bigint").cast("string")
    return F.concat(sign, days, F.lit("d"), part(3_600, 86_400), F.lit("h"), part(60, 3_600), F.lit("m"), (s % 60).cast("string"), F.lit("s"))


def localize(ts: Column, zone: str) -> Column:
    """The instant that a wall-clock time has in ``zone``, as a time in UTC."""
    return F.to_utc_timestamp(ts, zone).cast("timestamp_ntz")


def convert(ts: Column, zone: str) -> Column:
    """The wall-clock time in ``zone`` of a time in UTC."""
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")


def between(ts: Column, start, end) -> Column:
    """Whether an instant lies in [start, end]."""
    return ts.between(F.lit(start), F.lit(end))


def at_time(ts: Column, hours: int, minutes: int) -> Column:
    return (F.hour(ts) == hours) & (F.minute(ts) == minutes)


def plus(a: Column, b: Column) -> Column:
    """The sum of two durations, or of a time's and a duration's nanoseconds."""
    return a.cast("bigint") + b.cast("bigint")


def minus(a: Column, b: Column) -> Column:
    return a.cast("bigint") - b.cast("bigint")


def before(a: Column, b: Column) -> Column:
    return a < b


def after(a: Column, b: Column) -> Column:
    return a > b
