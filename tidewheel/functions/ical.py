"""iCalendar values as columns: reading and writing date-times, durations and lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds of a duration's parts.
PARTS = {"W": 604_800, "D": 86_400, "H": 3_600, "M": 60, "S": 1}


def local_seconds(value: Column) -> Column:
    """Seconds of the wall clock of YYYYMMDD or YYYYMMDDTHHMMSS[Z], as if it were UTC; null where it isn't one."""
    digits = F.regexp_extract(value, r"^(\d{8})(T(\d{6})Z?)?$", 1)
    clock = F.regexp_extract(value, r"^(\d{8})T(\d{6})Z?$", 2)
    whole = F.concat(digits, F.when(clock == "", F.lit("000000")).otherwise(clock))
    return F.unix_seconds(F.try_to_timestamp(F.when(digits != "", whole), F.lit("yyyyMMddHHmmss")))


def to_utc(local: Column, tzid: Column) -> Column:
    """UTC seconds of a wall clock in a zone."""
    return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(local), tzid))


def to_local(ts: Column, tzid: Column) -> Column:
    return F.unix_seconds(F.from_utc_timestamp(F.timestamp_seconds(ts), tzid))


def is_single(local: Column, tzid: Column, ts: Column) -> Column:
    """Whether a wall clock names one instant (ts): false where the clock skips it or shows it twice."""
    twice = F.lit(False)
    for shift in (1800, 3600, 7200):
        twice = twice | (to_local(ts + shift, tzid) == local) | (to_local(ts - shift, tzid) == local)
    return (to_local(ts, tzid) == local) & ~twice


def show_time(ts: Column, tzid: str | Column = "UTC") -> Column:
    """YYYYMMDDTHHMMSS, with Z in UTC."""
    zone = F.lit(tzid) if isinstance(tzid, str) else tzid
    shown = F.date_format(F.from_utc_timestamp(F.timestamp_seconds(ts), zone), "yyyyMMdd'T'HHmmss")
    return F.concat(shown, F.when(zone == "UTC", F.lit("Z")).otherwise(F.lit("")))


def duration_seconds(value: Column) -> Column:
    """Seconds of [+-]P[nW][nD][T[nH][nM][nS]]; null where it isn't one."""
    form = r"^([+-]?)P(?=.)(?:(\d+)W)?(?:(\d+)D)?(?:T(?=.)(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?)?$"
    total = F.lit(0).cast("long")
    for k, unit in enumerate(PARTS.values()):
        n = F.regexp_extract(value, form, k + 2)
        total = total + F.when(n == "", F.lit(0)).otherwise(n.try_cast("long")) * unit
    return F.when(value.rlike(form), F.when(F.regexp_extract(value, form, 1) == "-", -total).otherwise(total))


def show_duration(seconds: Column) -> Column:
    """The shortest form by weeks, days, hours, minutes and seconds; PT0S for no time, null for null."""
    left, date, clock = F.abs(seconds), [], []
    for part, unit in PARTS.items():
        n = F.floor(left / unit)
        left = left % unit
        (date if part in "WD" else clock).append(F.when(n > 0, F.concat(n.cast("string"), F.lit(part))).otherwise(""))
    time = F.concat(*clock)
    shown = F.concat(F.when(seconds < 0, "-").otherwise(""), F.lit("P"), *date, F.when(time != "", F.concat(F.lit("T"), time)).otherwise(""))
    return F.when(seconds == 0, F.lit("PT0S")).when(seconds.isNotNull(), shown)


def show_list(values: Column) -> Column:
    return F.array_join(F.array_sort(values), ",")


def members(value: Column) -> Column:
    """The members of a comma-separated list, trimmed, blank ones dropped."""
    return F.filter(F.transform(F.split(value, ","), F.trim), lambda x: x != "")
