"""Positions, times of day and wrapping counters as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, of a timestamp with or without zone (session zone UTC)."""
    return F.unix_micros(ts.cast("timestamp"))


def position(us: Column, rate: int = 100) -> Column:
    """Sample number since the epoch at an integer rate: an exact clock to join on."""
    return F.expr("bigint(0)") + F.floor(us * F.lit(rate) / F.lit(1_000_000)).cast("long")


def hms(us: Column) -> Column:
    """HH:mm:ss.SS, rounded to milliseconds and then cut to hundredths."""
    ms = F.floor((us + F.lit(500)) / F.lit(1000)).cast("long")
    day = F.pmod(ms, F.lit(86_400_000))
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(day / 3_600_000, 2), F.lit(":"), part(F.pmod(day, F.lit(3_600_000)) / 60_000, 2), F.lit(":"), part(F.pmod(day, F.lit(60_000)) / 1000, 2), F.lit("."), part(F.pmod(day, F.lit(1000)) / 10, 2))


def parse_utc(text: Column, order: str = "ymdHMS") -> Column:
    """Microseconds from the first six integers of a text, in any order, and a fraction after the seconds."""
    n = F.regexp_extract_all(text, F.lit(r"(\d+)"), 1)
    at = {k: order.index(k) for k in "ymdHMS"}
    get = lambda k: F.get(n, F.lit(at[k])).cast("int")
    fraction = F.regexp_extract(text, r"\d\.(\d+)", 1)
    seconds = get("S") + F.when(fraction != "", F.concat(F.lit("0."), fraction).cast("double")).otherwise(F.lit(0.0))
    return F.unix_micros(F.try_make_timestamp(get("y"), get("m"), get("d"), get("H"), get("M"), seconds.cast("decimal(16,6)")))


def seconds_after(seconds: Column, origin: Column) -> Column:
    """Difference of two times of day in [-12 h, 12 h)."""
    return F.pmod(seconds - origin + F.lit(43_200.0), F.lit(86_400.0)) - F.lit(43_200.0)


def unshift(seconds: Column, shift: Column) -> Column:
    """A time of day less a shift, around midnight."""
    return F.pmod(seconds - shift, F.lit(86_400))


def sequence_after(sequence: Column, last: Column, bits: int = 24) -> Column:
    """Whether a wrapping sequence number is after another: within half the number space ahead."""
    return F.pmod(sequence - last, F.lit(1 << bits)).between(1, (1 << (bits - 1)) - 1)


def sequence_next(sequence: Column, bits: int = 24) -> Column:
    return F.pmod(sequence + 1, F.lit(1 << bits))


def day_of_year_ns(year: Column, day: Column, hour: Column, minute: Column, second: Column, ten_thousandths: Column, micro: Column) -> Column:
    """Nanoseconds since the epoch of a day of the year and parts of the day; second 60 carries. Null where a part is
    out of range or the time is beyond 64 bits."""
    days = F.datediff(F.make_date(year.cast("int"), F.lit(1), F.lit(1)), F.lit("1970-01-01").cast("date")).cast("long") + day - 1
    seconds = days * 86_400 + hour * 3600 + minute * 60 + second
    ok = year.between(1900, 2500) & day.between(1, 366) & hour.between(0, 23) & minute.between(0, 59) & second.between(0, 60) & ten_thousandths.between(0, 9999) & (F.abs(seconds) <= 9_223_372_035)
    return F.when(ok, F.when(ok, seconds) * 1_000_000_000 + ten_thousandths * 100_000 + micro * 1000)


def rate_of(factor: Column, multiplier: Column) -> Column:
    """Samples a second: positive numbers multiply, negative ones divide; 0 where either is 0."""
    part = lambda x: F.when(x > 0, x.cast("double")).when(x < 0, F.lit(-1.0) / x).otherwise(F.lit(0.0))
    return part(factor) * part(multiplier)


def sign_extend(value: Column, bits: int) -> Column:
    """Two's complement of the low ``bits`` of a non-negative number."""
    return value.bitwiseXOR(F.lit(1 << (bits - 1))) - F.lit(1 << (bits - 1))
