"""Recurrence: events to occurrences, with Spark's own expressions.

A rule steps through periods (seconds to years). Each step's candidates are generated by explode(sequence(...)) in
the wall clock of DTSTART's zone, filtered by the BY parts, numbered where COUNT or BYSETPOS asks for it, and only
then turned into UTC, so that 10:00 stays 10:00 across a change of clocks.

Generation needs an end: UNTIL, the query's upper bound, COUNT, or a cap of occurrences for each event. By COUNT or a
cap, a rule that chooses among its steps is followed in rounds, each over a longer span, until the event has its number
or, by the rule's cycle, can't have more.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ical import to_local, to_utc
from ..functions.stages import once
from ..model import DAY, EVENT_KEY, UNIT, WEEKDAYS
from .lineage import cut

#: Steps an occurrence that a rule which rarely has one is followed for in the first round, and days an occurrence by a
#: daily or weekly rule's part. They decide the time only.
STEPS_EACH = 8
DAYS_EACH = {"byday": 7, "bymonthday": 31, "byweekno": 366, "byyearday": 366, "bymonth": 366}
#: How many times longer each round's span is than that of the round before.
GROWTH = 8
#: The end of 9999: iCalendar writes years with four digits.
LAST = 253_402_300_799
#: Seconds after which the calendar repeats: 400 years, which are whole weeks.
CALENDAR_CYCLE = 146_097 * DAY
#: Occurrences an event, on average, up to which expanding all events is less work than finding those that can matter.
LIGHT = 8
_ROW = "_row"
NO_CAP = 1 << 40


def _has(values: Column, x: Column) -> Column:
    return values.isNull() | (F.size(values) == 0) | F.array_contains(values, x)


def _signed(values: Column, x: Column, of: Column) -> Column:
    """x, counted from 1, or from the end of `of` by negative values."""
    return values.isNull() | (F.size(values) == 0) | F.array_contains(values, x) | F.array_contains(values, x - of - 1)


def _day_name(day: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, WEEKDAYS)), F.weekday(day) + 1)


def _week_start(day: Column, wkst: Column) -> Column:
    at = F.coalesce(F.array_position(F.array(*map(F.lit, WEEKDAYS)), wkst), F.lit(1)).cast("int") - 1
    return F.date_sub(day, F.pmod(F.weekday(day) - at, F.lit(7)))


def _period(day: Column, freq: Column, wkst: Column) -> Column:
    """The number of a day's period: days, weeks, months or years."""
    return (
        F.when(freq == "DAILY", F.unix_date(day)).when(freq == "WEEKLY", F.floor((F.unix_date(_week_start(day, wkst)) + 14) / 7))
        .when(freq == "MONTHLY", F.year(day) * 12 + F.month(day)).otherwise(F.year(day))
    ).cast("long")


def _day_facts(day: Column, r: Column) -> Column:
    """What the BY parts ask of a day."""
    leap = (F.pmod(F.year(day), F.lit(4)) == 0) & ((F.pmod(F.year(day), F.lit(100)) != 0) | (F.pmod(F.year(day), F.lit(400)) == 0))
    thursday = F.date_add(day, 3 - F.weekday(day))
    # The week of 28 December is its year's last.
    weeks = F.weekofyear(F.make_date(F.year(thursday), F.lit(12), F.lit(28)))
    facts = {
        "month": F.month(day), "dom": F.dayofmonth(day), "doy": F.dayofyear(day), "last": F.dayofmonth(F.last_day(day)), "year": F.when(leap, 366).otherwise(365),
        "week": F.weekofyear(day), "weeks": weeks, "name": _day_name(day), "period": _period(day, r["freq"], r["wkst"]),
    }
    return F.struct(*(c.alias(n) for n, c in facts.items()))


def _day_matches(d: Column, s: Column, r: Column) -> Column:
    """Whether the BY parts, or in their absence DTSTART (s), allow a day (d) of an allowed period."""
    freq = r["freq"]
    none = lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    # An ordinal weekday counts in the month, or in the year for a yearly rule without BYMONTH.
    by_year = (freq == "YEARLY") & none(r["bymonth"])
    n, size = F.when(by_year, d["doy"]).otherwise(d["dom"]), F.when(by_year, d["year"]).otherwise(d["last"])
    nth, nth_last = (F.floor((n - 1) / 7) + 1).cast("string"), (-(F.floor((size - n) / 7) + 1)).cast("string")
    names = F.array(d["name"], F.concat(nth, d["name"]), F.concat(F.lit("+"), nth, d["name"]), F.concat(nth_last, d["name"]))
    weekday = none(r["byday"]) | F.arrays_overlap(r["byday"], names)
    parts = _has(r["bymonth"], d["month"]) & _signed(r["bymonthday"], d["dom"], d["last"]) & _signed(r["byyearday"], d["doy"], d["year"]) & _signed(r["byweekno"], d["week"], d["weeks"]) & weekday
    no_day = none(r["byday"]) & none(r["bymonthday"]) & none(r["byyearday"])
    by_weekday = (freq == "WEEKLY") | ((freq == "YEARLY") & ~none(r["byweekno"]))
    by_date = (freq == "MONTHLY") | ((freq == "YEARLY") & none(r["byweekno"]))
    by_month = (freq == "YEARLY") & none(r["byweekno"]) & none(r["bymonth"])
    like_start = (~by_weekday | (d["name"] == s["name"])) & (~by_date | (d["dom"] == s["dom"])) & (~by_month | (d["month"] == s["month"]))
    return parts & (~no_day | like_start)


def _clock(r: Column, start: Column) -> Column:
    """Seconds of the day at which a matching day has occurrences."""
    either = lambda part, own: F.when(part.isNull() | (F.size(part) == 0), F.array(own.cast("int"))).otherwise(part)
    second = F.pmod(start, F.lit(DAY))
    hours, minutes, seconds = (either(r[p], o) for p, o in (("byhour", F.floor(second / 3600)), ("byminute", F.floor(second / 60) % 60), ("bysecond", second % 60)))
    return F.flatten(F.transform(hours, lambda h: F.flatten(F.transform(minutes, lambda m: F.transform(seconds, lambda s: (h * 3600 + m * 60 + s).cast("long"))))))


def _within_step(r: Column, local: Column) -> Column:
    """An hour's or a minute's occurrences: BYMINUTE and BYSECOND that are finer than FREQ give several."""
    either = lambda part, own: F.when(_some(part), part).otherwise(F.array(own.cast("int")))
    minutes = F.when(r["freq"] == "HOURLY", either(r["byminute"], F.floor(local / 60) % 60)).otherwise(F.array((F.floor(local / 60) % 60).cast("int")))
    seconds = F.when(r["freq"].isin("HOURLY", "MINUTELY"), either(r["bysecond"], local % 60)).otherwise(F.array((local % 60).cast("int")))
    hour = F.floor(local / 3600) * 3600
    return F.array_distinct(F.flatten(F.transform(minutes, lambda m: F.transform(seconds, lambda x: (hour + m * 60 + x).cast("long")))))


#: Parts of a rule that choose among its steps.
_CHOOSING = ("byday", "bymonthday", "bymonth", "byyearday", "byweekno", "bysetpos", "byhour", "byminute", "bysecond")


def _chooses(rule: Column) -> Column:
    out = F.lit(False)
    for p in _CHOOSING:
        out = out | (F.coalesce(F.size(rule[p]), F.lit(0)) > 0)
    return out


def _is_fixed(rule: Column) -> Column:
    """Sub-daily rules, and daily and weekly ones that choose nothing: the k-th candidate is arithmetic."""
    return rule["freq"].isin("SECONDLY", "MINUTELY", "HOURLY") | (rule["freq"].isin("DAILY", "WEEKLY") & ~_chooses(rule))


def _per_step(rule: Column) -> Column:
    unit = F.lit(366 * DAY)
    for name, seconds in (UNIT | {"MONTHLY": 31 * DAY}).items():
        unit = F.when(rule["freq"] == name, F.lit(seconds)).otherwise(unit)
    return unit.cast("long") * rule["interval"]


def _some(values: Column) -> Column:
    return F.coalesce(F.size(values) > 0, F.lit(False))


def _is_sure(rule: Column) -> Column:
    """Daily and weekly rules that have an occurrence in each of their steps."""
    names = F.coalesce(F.forall(rule["byday"], lambda x: x.isin(*WEEKDAYS)), F.lit(True))
    out = F.coalesce((rule["freq"] == "WEEKLY") & names | (rule["freq"] == "DAILY") & ~_some(rule["byday"]), F.lit(False))
    for p in ("bymonthday", "bymonth", "byyearday", "byweekno", "bysetpos"):
        out = out & ~_some(rule[p])
    return out


def _cycle(rule: Column) -> Column:
    """Seconds after which an endless rule's occurrences repeat, as a double: none in one cycle means none ever."""
    dated = rule["freq"].isin("MONTHLY", "YEARLY") | F.coalesce(F.exists(rule["byday"], lambda x: ~x.isin(*WEEKDAYS)), F.lit(False))
    for p in ("bymonthday", "bymonth", "byyearday", "byweekno", "bysetpos"):
        dated = dated | _some(rule[p])
    step = _per_step(rule).cast("double")
    # Multiples of the step that are whole days.
    days = F.when(rule["freq"].isin("MONTHLY", "YEARLY"), rule["interval"] * F.lit(float(DAY))).when(step % DAY == 0, step).when(F.lit(float(DAY)) % step == 0, F.lit(float(DAY))).otherwise(step * DAY)
    return F.when(dated, days * (CALENDAR_CYCLE // DAY)).when(_some(rule["byday"]), days * 7).when(_chooses(rule), days).otherwise(step)


def _joint_cycle(rule: Column, exrule: Column) -> Column:
    """A cycle of what a rule gives beside an EXRULE; both multiples of a day have their product in days."""
    a, b = _cycle(rule), _cycle(exrule)
    product = F.when((a % DAY == 0) & (b % DAY == 0), a * b / DAY).otherwise(a * b)
    return F.when(exrule.isNull(), a).when(F.greatest(a, b) % F.least(a, b) == 0, F.greatest(a, b)).otherwise(product)


def _plain_steps(rows: DataFrame, rule: Column) -> DataFrame:
    """Fixed steps without BY parts: each is an occurrence, so COUNT, the cap and the lower bound are arithmetic."""
    step = _per_step(rule)
    first = F.greatest(F.lit(0), F.ceil((F.col("_low") - F.col("_start")) / step)).cast("long")
    rows = rows.withColumns({"_step": step, "_first": first, "_steps": F.floor((F.col("_end") - F.col("_start")) / step)})
    # least() skips nulls, and a rule that is null must stay without steps.
    last = F.when(F.col("_step").isNotNull(), F.least("_steps", F.coalesce(rule["count"], F.lit(NO_CAP)) - 1, F.col("_first") + F.col("_cap") - 1)).cast("long")
    out = rows.withColumn("_steps", last).filter("_steps >= _first").withColumn("_k", F.explode(F.sequence("_first", "_steps")))
    return out.withColumn("_local", F.col("_start") + F.col("_k") * F.col("_step"))


def _date(seconds: Column) -> Column:
    return F.date_from_unix_date(F.floor(seconds / DAY).cast("int"))


def _weekday_numbers(rule: Column) -> Column:
    """The weekdays that BYDAY names, 0 for Monday."""
    return F.array_distinct(F.transform(rule["byday"], lambda x: F.array_position(F.array(*map(F.lit, WEEKDAYS)), x).cast("int") - 1))


def _slots(rule: Column, start: Column) -> Column:
    return F.array_sort(F.array_distinct(_clock(rule, start)))


def _regular_steps(rows: DataFrame, rule: Column) -> DataFrame:
    """Daily and weekly rules with the same places in each period: the k-th place is arithmetic, and so are COUNT and the cap."""
    weekly = rule["freq"] == "WEEKLY"
    day = _date(F.col("_start"))
    at = F.coalesce(F.array_position(F.array(*map(F.lit, WEEKDAYS)), rule["wkst"]), F.lit(1)).cast("int") - 1
    numbers = F.when(_some(rule["byday"]), _weekday_numbers(rule)).otherwise(F.array(F.weekday(day)))
    days = F.when(weekly, F.transform(numbers, lambda n: F.pmod(n - at, F.lit(7)))).otherwise(F.array(F.lit(0)))
    rows = once(rows, _anchor=F.unix_date(F.when(weekly, _week_start(day, rule["wkst"])).otherwise(day)).cast("long") * DAY, _step=_per_step(rule), _days=days, _clock=_slots(rule, F.col("_start")))
    rows = once(rows, _places=F.array_sort(F.flatten(F.transform("_days", lambda d: F.transform("_clock", lambda c: d * DAY + c)))))
    n = F.size("_places").cast("long")
    period = lambda c: F.floor((F.col(c) - F.col("_anchor")) / F.col("_step"))
    own = F.size(F.filter("_places", lambda x: x < F.col("_start") - F.col("_anchor")))
    rows = once(rows, _own=own.cast("long"), _first=F.greatest(own, n * period("_low")).cast("long"))
    # The cap begins at the lower bound's period, of which some places may come before the bound.
    last = F.least(n * (period("_end") + 1) - 1, F.col("_own") + rule["count"] - 1, F.when(F.col("_cap") < NO_CAP, F.col("_first") + F.col("_cap") + n - 1)).cast("long")
    out = once(rows, _last=last).filter("_last >= _first").withColumn("_k", F.explode(F.sequence("_first", "_last")))
    local = F.col("_anchor") + F.floor(F.col("_k") / n) * F.col("_step") + F.get("_places", (F.col("_k") % n).cast("int"))
    return out.withColumn("_local", local.cast("long")).filter("_end is null or _local <= _end")


def _months(rows: DataFrame, rule: Column) -> DataFrame:
    """A row for each of a monthly or yearly rule's steps, with the first day of its month and the month's length."""
    number = lambda c: (F.year(_date(F.col(c))) * 12 + F.month(_date(F.col(c))) - 1).cast("long")
    rows = once(rows, _m=number("_start"), _unit=F.when(rule["freq"] == "YEARLY", F.lit(12)).otherwise(F.lit(1)) * rule["interval"].cast("long"), _clock=_slots(rule, F.col("_start")))
    # Only COUNT needs what comes before the lower bound.
    first = F.when(rule["count"].isNull(), F.greatest(F.lit(0), F.floor((number("_low") - F.col("_m")) / F.col("_unit")) - 1)).otherwise(F.lit(0))
    rows = once(rows, _first=first.cast("long"), _last=F.floor((number("_end") - F.col("_m")) / F.col("_unit")).cast("long"))
    rows = rows.filter("_last >= _first").withColumn("_k", F.explode(F.sequence("_first", "_last")))
    m = F.col("_m") + F.col("_k") * F.col("_unit")
    rows = once(rows, _month=F.make_date(F.floor(m / 12).cast("int"), (m % 12 + 1).cast("int"), F.lit(1)))
    return once(rows, _length=F.dayofmonth(F.last_day("_month")))


def _dated_steps(rows: DataFrame, rule: Column, keep: tuple[str, ...], counted: bool) -> DataFrame:
    """Monthly and yearly rules on DTSTART's day: a candidate a step."""
    months = _months(once(rows, _dom=F.dayofmonth(_date(F.col("_start")))), rule).filter("_dom <= _length")
    out = months.withColumn("_at", F.explode("_clock")).withColumn("_local", (F.unix_date("_month").cast("long") + F.col("_dom") - 1) * DAY + F.col("_at"))
    return _counted(out.filter("_local >= _start and _local <= _end"), rule, keep, counted)


def _weekday_steps(rows: DataFrame, rule: Column, keep: tuple[str, ...], counted: bool) -> DataFrame:
    """Monthly rules on weekdays: a month's days are strides of a week, of which BYSETPOS picks by place."""
    rows = _months(once(rows, _names=_weekday_numbers(rule)), rule)
    rows = once(rows, _days=F.array_sort(F.transform("_names", lambda n: F.pmod(n - F.weekday("_month"), F.lit(7)))))
    m, c = F.size("_days"), F.size("_clock")
    # The month's weeks have all of these days, what is left of it those that come early enough.
    rows = once(rows, _of=((m * F.floor(F.col("_length") / 7) + F.size(F.filter("_days", lambda d: d < F.col("_length") % 7))) * c).cast("int"))
    chosen = F.array_distinct(F.filter(F.transform(rule["bysetpos"], lambda x: F.when(x > 0, x - 1).otherwise(F.col("_of") + x)), lambda k: (k >= 0) & (k < F.col("_of"))))
    rows = rows.withColumn("_at", F.explode(F.when(_some(rule["bysetpos"]), chosen).otherwise(F.sequence(F.lit(0), F.col("_of") - 1))))
    k = F.floor(F.col("_at") / c)
    day = F.unix_date("_month").cast("long") + F.get("_days", (k % m).cast("int")) + 7 * F.floor(k / m)
    out = rows.withColumn("_local", day.cast("long") * DAY + F.get("_clock", F.col("_at") % c))
    return _counted(out.filter("_local >= _start and _local <= _end"), rule, keep, counted)


def _chosen_steps(rows: DataFrame, rule: Column, keep: tuple[str, ...], counted: bool) -> DataFrame:
    """Sub-daily steps with BY parts: days are chosen first, then their steps are filtered and counted."""
    # Only COUNT needs what comes before the lower bound.
    begin = F.when(rule["count"].isNull(), F.greatest("_start", F.col("_low") - DAY)).otherwise(F.col("_start"))
    rows = rows.withColumns({"_step": _per_step(rule), "_b": _date(begin), "_e": _date(F.col("_end"))}).filter("_e >= _b")
    day = F.col("_day")
    days = rows.withColumn("_day", F.explode(F.sequence("_b", "_e"))).filter(_has(rule["bymonth"], F.month(day)) & _signed(rule["bymonthday"], F.dayofmonth(day), F.dayofmonth(F.last_day(day))) & _has(rule["byday"], _day_name(day)))
    midnight = F.unix_date("_day").cast("long") * DAY
    # Whole hours: a step's occurrences lie in its hour.
    hours = F.transform(F.array_distinct(rule["byhour"]), lambda h: F.struct((midnight + h * 3600).alias("b"), (midnight + h * 3600 + 3599).alias("e")))
    days = days.withColumn("_span", F.explode(F.when(_some(rule["byhour"]), hours).otherwise(F.array(F.struct(midnight.alias("b"), (midnight + DAY - 1).alias("e"))))))
    # A step that begins after the end may still expand to what comes before it, in its hour or minute.
    first = F.greatest(F.lit(0), F.ceil((F.col("_span.b") - F.col("_start")) / F.col("_step"))).cast("long")
    last = F.floor((F.least(F.col("_span.e"), F.col("_end") + 3599) - F.col("_start")) / F.col("_step")).cast("long")
    out = days.withColumns({"_first": first, "_steps": last}).filter("_steps >= _first").withColumn("_k", F.explode(F.sequence("_first", "_steps")))
    out = out.withColumn("_local", F.col("_start") + F.col("_k") * F.col("_step"))
    out = out.withColumn("_local", F.explode(_within_step(rule, F.col("_local")))).filter("_local >= _start and _local <= _end")
    s = F.pmod(F.col("_local"), F.lit(DAY))
    kept = out.filter(_has(rule["byminute"], (F.floor(s / 60) % 60).cast("int")) & _has(rule["bysecond"], (s % 60).cast("int")))
    return _counted(kept, rule, keep, counted)


def _counted(rows: DataFrame, rule: Column, keep: tuple[str, ...], counted: bool) -> DataFrame:
    """COUNT among the rows of an event in order; rows of other rules are neither dealt out nor sorted."""
    shown = lambda df: df.select(*keep, "tzid", "_local")
    if not counted:
        return shown(rows)
    order = Window.partitionBy(_ROW).orderBy("_local")
    numbered = rows.filter(rule["count"].isNotNull()).withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= rule["count"])
    return shown(rows.filter(rule["count"].isNull())).unionByName(shown(numbered))


def _day_steps(rows: DataFrame, rule: Column, placed_too: bool, keep: tuple[str, ...], counted: bool) -> DataFrame:
    """Rules that choose days in other ways: candidates are the days of the span."""
    start = F.date_from_unix_date(F.floor(F.col("_start") / DAY).cast("int"))
    end = F.date_from_unix_date(F.floor(F.col("_end") / DAY).cast("int"))
    # A period is filled from its first day, which BYSETPOS counts from. Only COUNT needs what comes before the lower bound.
    low = F.date_from_unix_date((F.floor(F.col("_low") / DAY) - 1).cast("int"))
    at = F.when(rule["count"].isNull(), F.greatest(start, low)).otherwise(start)
    begin = F.when(rule["freq"] == "WEEKLY", _week_start(at, rule["wkst"])).when(rule["freq"] == "MONTHLY", F.trunc(at, "MM")).when(rule["freq"] == "YEARLY", F.trunc(at, "YEAR")).otherwise(at)
    # BYSETPOS also counts a last period to its end, of which what comes after the span goes later.
    full = F.when(rule["freq"] == "WEEKLY", F.date_add(_week_start(end, rule["wkst"]), 6)).when(rule["freq"] == "MONTHLY", F.last_day(end)).when(rule["freq"] == "YEARLY", F.make_date(F.year(end), F.lit(12), F.lit(31))).otherwise(end)
    end = F.when(_some(rule["bysetpos"]), full).otherwise(end)
    facts = lambda df, day, name: df.select("*", F.explode(F.array(_day_facts(F.col(day), rule))).alias(name))
    rows = facts(rows.withColumns({"_s": start, "_b": begin, "_e": end}).filter("_e >= _b"), "_s", "_start_facts")
    # Facts through one-element arrays: they are made once a day, apart from the conditions that read them.
    days = facts(rows.withColumn("_day", F.explode(F.sequence("_b", "_e"))), "_day", "_facts")
    days = days.withColumn("_period", F.col("_facts.period") - F.col("_start_facts.period")).filter(F.col("_period") % rule["interval"] == 0).filter(_day_matches(F.col("_facts"), F.col("_start_facts"), rule))
    out = days.withColumn("_clock", F.explode(_clock(rule, F.col("_start")))).withColumn("_local", F.unix_date("_day").cast("long") * DAY + F.col("_clock"))
    if placed_too:
        # BYSETPOS picks from each period's set, in order.
        inside = Window.partitionBy(_ROW, "_period")
        placed = F.coalesce(F.size(rule["bysetpos"]), F.lit(0)) > 0
        chosen = out.filter(placed).withColumn("_at", F.row_number().over(inside.orderBy("_local"))).withColumn("_of", F.count("*").over(inside)).filter(F.array_contains(rule["bysetpos"], F.col("_at")) | F.array_contains(rule["bysetpos"], (F.col("_at") - F.col("_of") - 1).cast("int"))).drop("_at", "_of")
        out = out.filter(~placed).unionByName(chosen)
    return _counted(out.filter("_local >= _start and _local <= _end"), rule, keep, counted)


#: Kinds of rules by name; a rule has one.
_KINDS = ("plain", "chosen", "regular", "dated", "weekdays", "days")


def _kind(rule: Column) -> Column:
    """Which kind a rule is, or null without one."""
    none = lambda *parts: ~reduce(lambda a, b: a | b, (_some(rule[p]) for p in parts))
    # Second 60 may belong to the next period.
    regular = _is_sure(rule) & ~F.coalesce(F.array_contains(rule["bysecond"], 60), F.lit(False))
    dated = rule["freq"].isin("MONTHLY", "YEARLY") & none("byday", "bymonthday", "bymonth", "byyearday", "byweekno", "bysetpos")
    names = F.coalesce(F.forall(rule["byday"], lambda x: x.isin(*WEEKDAYS)), F.lit(False))
    weekdays = (rule["freq"] == "MONTHLY") & names & _some(rule["byday"]) & none("bymonthday", "bymonth", "byyearday", "byweekno", "bysecond")
    return F.when(rule.isNull(), F.lit(None)).when(_is_fixed(rule), F.when(_chooses(rule), "chosen").otherwise("plain")).when(regular, "regular").when(dated, "dated").when(weekdays, "weekdays").otherwise("days")


@dataclass(frozen=True)
class _Kinds:
    """Which kinds of events a table has; the plan has a branch for these and no others."""

    plain: bool
    chosen: bool
    regular: bool
    dated: bool
    weekdays: bool
    days: bool
    placed: bool
    #: Whether a rule whose COUNT isn't arithmetic has one.
    counted: bool
    dates: bool
    odd: bool
    endless: bool
    followed: bool
    #: Whether all rules are counted ones whose steps are arithmetic, with few occurrences an event.
    light: bool


def survey(events: DataFrame, until: int | None, cap: int | None) -> _Kinds:
    """What events need, in one pass over them."""
    r = F.col("rule")
    rules = {"r": r, "x": F.col("exrule")}
    # Made once a row: flags that repeat what they ask of a rule are slow to plan.
    made = {f"_{n}_{k}": c for n, v in rules.items() for k, c in (("kind", _kind(v)), ("placed", _some(v["bysetpos"])), ("counted", v["count"].isNotNull()))}
    rows = once(events.select("dtstart_ts", "rule", "exrule", "rdates", "exdates"), _odd=_is_odd(), _certain=_is_certain(), **made)
    both = lambda f: reduce(lambda a, b: a | b, (F.coalesce(f(n), F.lit(False)) for n in rules))
    kind = lambda n: F.col(f"_{n}_kind")
    ended = F.lit(until is not None) | r["until_ts"].isNotNull() | (F.col("_certain") & F.col("_r_counted"))
    flags = {
        **{k: both(lambda n, k=k: kind(n) == k) for k in _KINDS}, "placed": both(lambda n: (kind(n) == "days") & F.col(f"_{n}_placed")),
        "counted": both(lambda n: ~kind(n).isin("plain", "regular") & F.col(f"_{n}_counted")), "dates": r.isNull() | (F.size("rdates") > 0), "odd": F.col("_odd"),
        "endless": r.isNotNull() & r["until_ts"].isNull() & r["count"].isNull(), "followed": r.isNotNull() & ~F.coalesce(F.col("_certain") & ~F.col("_odd"), F.lit(False)) & (F.lit(cap is not None) | ~F.coalesce(ended, F.lit(False))),
    }
    # COUNT, or the one at DTSTART, and RDATEs.
    most = F.coalesce(r["count"], F.lit(1)).cast("long") + F.greatest(F.coalesce(F.size("rdates"), F.lit(0)), F.lit(0))
    open_ended = F.bool_or(r.isNotNull() & r["count"].isNull())
    row = rows.agg(*(F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()), open_ended.alias("_open"), (F.sum(most) <= LIGHT * F.count("*")).alias("_few")).first()
    slow = any(row[n] for n in ("chosen", "dated", "weekdays", "days", "odd", "followed", "_open"))
    return _Kinds(**{n: bool(row[n]) for n in flags}, light=row["_few"] is not False and not slow)


def _is_odd() -> Column:
    """Events that need a set operation: dates taken out, or dates beside a rule that may be the same."""
    return F.coalesce((F.size("exdates") > 0) | F.col("exrule").isNotNull() | (F.size("rdates") > 0), F.lit(False))


def _is_certain() -> Column:
    """Rules whose k-th occurrence has a proven latest time."""
    r = F.col("rule")
    return (_is_fixed(r) & ~_chooses(r)) | _is_sure(r)


def _known_end(until: int | None) -> Column:
    """When an event's rule ends at the latest, or null: UNTIL, the query's bound, or COUNT of a certain rule."""
    r = F.col("rule")
    counted = F.when(_is_certain() & r["count"].isNotNull(), _after(F.col("dtstart_ts"), r["count"]))
    return F.least(r["until_ts"], F.lit(until).cast("long"), counted)


def _after(start: Column, n: Column) -> Column:
    """No earlier than n steps after start, with room for a begun step and a change of clocks."""
    return F.least(F.lit(float(LAST)), start + _per_step(F.col("rule")).cast("double") * (n + 2) + 2 * DAY).cast("long")


def _is_followed(until: int | None, cap: int | None) -> Column:
    """Events whose end only rounds can tell."""
    r = F.col("rule")
    return r.isNotNull() & F.coalesce(~(_is_certain() & ~_is_odd()), F.lit(True)) & (F.lit(cap is not None) | _known_end(until).isNull())


def _rule_starts(events: DataFrame, rule: str, kinds: _Kinds, cap: int | None = None, keep: tuple[str, ...] = (_ROW,)) -> DataFrame:
    """keep and the start of each occurrence that a rule gives up to the event's _until; those before _low needn't be
    among them, and of a plain rule no more than cap are."""
    r = F.col(rule)
    tz = F.coalesce("tzid", F.lit("UTC"))
    start = F.struct(to_local(F.col("dtstart_ts"), tz).alias("s"), to_local(F.least("_until", r["until_ts"]), tz).alias("e"), F.coalesce(to_local(F.col("_low"), tz), F.col("dtstart_ts") - 2 * DAY).alias("l"))
    # Through a one-element array: conversions between zones are then written once, not at each use.
    rows = events.filter(r.isNotNull()).select(*keep, tz.alias("tzid"), r.alias(rule), F.explode(F.array(start)).alias("_t"), F.lit(cap or NO_CAP).alias("_cap")).select(*keep, "tzid", rule, "_cap", F.col("_t.s").alias("_start"), F.col("_t.e").alias("_end"), F.col("_t.l").alias("_low")).filter("_end is null or _end >= _start")
    of = {
        "plain": _plain_steps, "regular": _regular_steps, "chosen": lambda df, r: _chosen_steps(df, r, keep, kinds.counted), "dated": lambda df, r: _dated_steps(df, r, keep, kinds.counted),
        "weekdays": lambda df, r: _weekday_steps(df, r, keep, kinds.counted), "days": lambda df, r: _day_steps(df, r, kinds.placed, keep, kinds.counted),
    }
    there = [k for k in _KINDS if getattr(kinds, k)]
    if not there:
        return events.limit(0).select(*keep, F.col("dtstart_ts").alias("occurrence_ts"))
    out = [of[k](rows.filter(_kind(r) == k) if len(there) > 1 else rows, r).select(*keep, "tzid", "_local") for k in there]
    return reduce(DataFrame.unionByName, out).select(*keep, to_utc(F.col("_local"), F.col("tzid")).alias("occurrence_ts"))


def _given(events: DataFrame, keep: tuple[str, ...] = (_ROW,)) -> DataFrame:
    """RDATEs, or DTSTART of an event with neither rule nor RDATEs."""
    dates = F.when(F.col("rule").isNull() & (F.coalesce(F.size("rdates"), F.lit(0)) <= 0), F.array("dtstart_ts")).otherwise(F.col("rdates"))
    return events.select(*keep, F.explode(dates).alias("occurrence_ts"))


def _removed(events: DataFrame, kinds: _Kinds, until: int | None) -> DataFrame:
    """What EXRULEs give, as far as the rule or the last RDATE."""
    last = F.least(F.greatest("_until", F.array_max("rdates")), F.lit(until).cast("long"))
    return _rule_starts(events.filter("exrule is not null").withColumn("_until", last), "exrule", kinds)


def _odd_starts(events: DataFrame, kinds: _Kinds, until: int | None) -> DataFrame:
    """Occurrences of events that need a set operation."""
    full = _rule_starts(events, "rule", kinds).unionByName(_given(events)).distinct()
    out_dates = events.select(_ROW, F.explode("exdates").alias("occurrence_ts")).unionByName(_removed(events, kinds, until)).distinct()
    return full.join(out_dates, [_ROW, "occurrence_ts"], "left_anti")


def _followed(events: DataFrame, kinds: _Kinds, until: int | None, cap: int | None) -> DataFrame:
    """events with _until, which each event's occurrences are made up to (null: a plain rule's COUNT or cap says it).

    Where it must be found, rounds lengthen an event's span until it has its COUNT, or cap occurrences that neither
    EXDATE nor EXRULE removes at or after _low, or has reached its end, or shows nothing in a whole cycle."""
    r, x = F.col("rule"), F.col("exrule")
    by_dates = F.coalesce(F.lit(until).cast("long"), F.array_max("rdates"), F.col("dtstart_ts"))
    if {k for k in _KINDS if getattr(kinds, k)} <= {"plain"} and not kinds.odd:
        return events.withColumn("_until", F.when(r.isNull(), by_dates).otherwise(F.least(r["until_ts"], F.lit(until).cast("long"))))
    rounds = kinds.followed or kinds.odd
    if rounds:
        # Written, so that plans begin here: what reads the rules would otherwise be copied into each of their uses.
        events = cut(events)
    end, base = _known_end(until), F.greatest("dtstart_ts", "_low")
    page = F.lit(None).cast("long") if cap is None else _after(base, F.lit(cap))
    fixed = F.when(r.isNull(), by_dates).when(_is_fixed(r) & ~_chooses(r) & ~_is_odd(), F.least(r["until_ts"], F.lit(until).cast("long"))).when(_is_sure(r) & ~_is_odd(), F.least(end, page)).otherwise(end)
    if not rounds:
        return events.withColumn("_until", fixed)
    counted = F.least(r["count"], F.lit(cap).cast("int")) + F.greatest(F.coalesce(F.size("exdates"), F.lit(0)), F.lit(0)) + 1
    rare = F.when(r["freq"].isin("MONTHLY", "YEARLY") | _some(r["bymonth"]), STEPS_EACH).otherwise(2)
    # Steps of less than a day may be chosen on some hours only.
    step = F.when(_chooses(r), F.greatest(_per_step(r), F.lit(DAY))).otherwise(_per_step(r)).cast("double")
    for part, days in DAYS_EACH.items():
        step = F.when(r["freq"].isin("DAILY", "WEEKLY") & _some(r[part]), F.greatest(step, F.lit(float(days * DAY)))).otherwise(step)
    # An EXRULE that ends may yet let occurrences through.
    lasting = x.isNull() | (x["count"].isNull() & x["until_ts"].isNull())
    facts = {"_last": F.coalesce(end, F.lit(LAST)), "_from": base.cast("double"), "_span": step * counted * rare, "_never": F.when(lasting, base + _joint_cycle(r, x) + 2 * DAY), "_count": r["count"]}
    own = events.columns
    events = cut(events.withColumns({"_need": _is_followed(until, cap), "_until": fixed, **facts}))
    out, rows = events.filter("not _need").select(*own, "_until"), events.filter("_need").drop("_until")
    for k in count():
        if rows.isEmpty():
            return out
        tried = rows.withColumn("_until", F.least(F.col("_last").cast("double"), F.col("_from") + F.col("_span") * float(GROWTH**k)).cast("long"))
        raw = _rule_starts(tried, "rule", kinds)
        parts = {"raw": raw}
        if kinds.odd:
            parts |= {"kept": raw.join(_removed(tried, kinds, until).distinct(), [_ROW, "occurrence_ts"], "left_anti"), "net": _odd_starts(tried, kinds, until)}
        # Without odd events the rule's starts are all there is.
        of = {p: p if p in parts else "raw" for p in ("raw", "kept", "net")}
        made = reduce(DataFrame.unionByName, (df.withColumn("_part", F.lit(n)) for n, df in parts.items())).join(tried.select(_ROW, "_until", "_low"), _ROW)
        inside = F.coalesce(F.col("occurrence_ts") >= F.col("_low"), F.lit(True)) & (F.col("occurrence_ts") <= F.col("_until"))
        seen = made.groupBy(_ROW).agg(*(F.count_if((F.col("_part") == of[p]) & (inside if p == "net" else F.lit(True))).alias(f"_{p}") for p in of))
        n = {p: F.coalesce(f"_{p}", F.lit(0)) for p in of}
        ended = (F.col("_until") >= F.col("_last")) | F.coalesce(n["raw"] >= F.col("_count"), F.lit(False)) | F.coalesce((n["kept"] == 0) & (F.col("_until") >= F.col("_never")), F.lit(False))
        if cap is not None:
            ended = ended | (n["net"] >= cap)
        # Written, so that a round neither runs nor plans the rounds before it again.
        state = cut(tried.join(seen, _ROW, "left").withColumn("_ended", ended).drop(*(f"_{p}" for p in of)))
        out = out.unionByName(state.filter("_ended").select(*own, "_until"))
        rows = state.filter("not _ended").drop("_ended", "_until")


def occurrences(events: DataFrame, until: int | None = None, low: int | Column | None = None, cap: int | None = None) -> DataFrame:
    """calendar_uid, event_uid, occurrence_ts: each event's RRULE and RDATEs without its EXRULE and EXDATEs.

    An event with neither rule nor RDATEs occurs at DTSTART. RDATEs are taken as they are; DTSTART itself isn't added
    to a rule that doesn't give it. Dates given twice occur once. until: no occurrence starts later. low, a time or a
    column of events: those before it needn't be made. cap: of those at or after low (or of all), at least the first
    cap are made. Without until, a rule that has neither UNTIL nor COUNT needs a cap; such events raise. Rules with
    BY parts end with the year 9999."""
    out, narrow = _occurrences(events, until, low, cap, False)
    return out.select(*EVENT_KEY, "occurrence_ts") if narrow else out.select(f"{_ROW}.*", "occurrence_ts")


def carried(events: DataFrame, until: int | None = None, low: int | Column | None = None, cap: int | None = None, kinds: _Kinds | None = None) -> tuple[DataFrame, bool]:
    """events, a row for each occurrence, with occurrence_ts, and True; or, where occurrences are found by joins or
    windows, which shouldn't copy an event's properties, what `occurrences` gives and False. kinds: what `survey` says of
    them with the same until and cap, if it was asked."""
    out, narrow = _occurrences(events, until, low, cap, True, kinds)
    return (out, True) if narrow else (out.select(f"{_ROW}.*", "occurrence_ts"), False)


def _occurrences(events: DataFrame, until: int | None, low: int | Column | None, cap: int | None, whole: bool, kinds: _Kinds | None = None) -> tuple[DataFrame, bool]:
    """Occurrences with their event's columns (whole) or key, and True; or with _row alone, and False."""
    cap = None if cap is None else max(cap, 1)
    kinds = kinds or survey(events, until, cap)
    if until is None and cap is None and kinds.endless:
        raise ValueError("a rule without UNTIL or COUNT needs an upper bound or a cap")
    low = (low if isinstance(low, Column) else F.lit(low)).cast("long").alias("_low")
    rules = ("dtstart_ts", "tzid", "rule", "exrule", "rdates", "exdates")
    narrow = not (kinds.odd or kinds.followed or kinds.counted or kinds.placed)
    if narrow:
        # An event's row goes through as it is, with its columns apart from those that steps have by the same names.
        own = list(events.columns if whole else EVENT_KEY)
        keep = tuple(c if c in EVENT_KEY else f"_own_{c}" for c in own)
        events = events.select(*(F.col(c).alias(k) for c, k in zip(own, keep, strict=True)), *rules, low)
    else:
        keep = (_ROW,)
        events = events.select(F.struct(*EVENT_KEY).alias(_ROW), *rules, low)
    events = _followed(events, kinds, until, cap)
    usual = events.filter(~_is_odd()) if kinds.odd else events
    out = _rule_starts(usual, "rule", kinds, cap, keep)
    if kinds.dates:
        out = out.unionByName(_given(usual, keep))
    if kinds.odd:
        out = out.unionByName(_odd_starts(events.filter(_is_odd()), kinds, until))
    if until is not None:
        out = out.filter(F.col("occurrence_ts") <= until)
    if narrow:
        out = out.select(*(F.col(k).alias(c) for c, k in zip(own, keep, strict=True)), "occurrence_ts")
    return out, narrow
