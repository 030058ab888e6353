"""iCalendar content lines to event and override rows, and back.

A body is property lines in any order, by white space apart. A value runs until the next property that is known, so
it is cut by one regular expression over the known names; what a property means is plain columns after that. Bodies
with anything wrong come back with the reason instead of a row.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ical
from ..functions.stages import once
from ..model import GEO, PASSIVE, RELATED, RULE, WEEKDAYS

#: The properties that mean something, and those that are carried along.
KNOWN = ("UID", "LAST-MODIFIED", "DTSTART", "DTEND", "DURATION", "RRULE", "EXRULE", "RDATE", "EXDATE", "CATEGORIES", "LOCATION-TYPE", "CLASS", "GEO", "RELATED-TO")
CARRIED = (
    "ACTION", "ATTACH", "ATTENDEE", "CALSCALE", "COMMENT", "COMPLETED", "CONTACT", "CREATED", "DESCRIPTION", "DTSTAMP", "DUE", "FREEBUSY", "LOCATION", "METHOD", "ORGANIZER",
    "PERCENT-COMPLETE", "PRIORITY", "PRODID", "RECURRENCE-ID", "REPEAT", "REQUEST-STATUS", "RESOURCES", "SEQUENCE", "STATUS", "SUMMARY", "TRANSP", "TRIGGER", "TZID", "TZNAME",
    "TZOFFSETFROM", "TZOFFSETTO", "TZURL", "URL", "VERSION", "NAME", "REFRESH-INTERVAL", "SOURCE", "COLOR", "IMAGE", "CONFERENCE", "PARTICIPANT-TYPE", "STRUCTURED-DATA", "STYLED-DESCRIPTION",
    "ACKNOWLEDGED", "BUSYTYPE", "CALENDAR-ADDRESS", "CONCEPT", "LINK", "PROXIMITY", "REFID", "RESOURCE-TYPE", "TZID-ALIAS-OF", "TZUNTIL", "XML",
)
_NAME = "|".join(sorted((*KNOWN, *CARRIED), key=len, reverse=True)) + "|X-[A-Za-z0-9-]+"
#: A name, its parameters (values may be quoted), and the text up to the next property or the end.
_LINE = rf"(?s)(?:^|(?<=\s))({_NAME})((?:;[A-Za-z0-9-]+=(?:\"[^\"]*\"|[^;:\"\s]*))*):(.*?)(?=\s+(?:{_NAME})(?:;[^:\s]*)?:|\s*$)"
#: A line that was found, in parts.
_SPLIT = r"(?s)^([A-Za-z0-9-]+)((?:;[A-Za-z0-9-]+=(?:\"[^\"]*\"|[^;:\"\s]*))*):(.*)$"
_RULE_LISTS = {"bymonthday": "BYMONTHDAY", "bymonth": "BYMONTH", "byyearday": "BYYEARDAY", "byweekno": "BYWEEKNO", "bysetpos": "BYSETPOS", "byhour": "BYHOUR", "byminute": "BYMINUTE", "bysecond": "BYSECOND"}


_SIGNED = lambda most: rf"[+-]?(?:{most})"
#: What a rule's parts may say.
_PARTS = {
    "FREQ": "SECONDLY|MINUTELY|HOURLY|DAILY|WEEKLY|MONTHLY|YEARLY", "INTERVAL": r"0*[1-9]\d{0,8}", "COUNT": r"0*[1-9]\d{0,8}", "UNTIL": r"\d{8}(?:T\d{6}Z?)?", "WKST": "|".join(WEEKDAYS),
    "BYDAY": rf"(?:[+-]?[1-9]\d?)?(?:{'|'.join(WEEKDAYS)})", "BYMONTHDAY": _SIGNED("0?[1-9]|[12]\\d|3[01]"), "BYYEARDAY": _SIGNED("0{0,2}[1-9]|0?[1-9]\\d|[12]\\d\\d|3[0-5]\\d|36[0-6]"),
    "BYWEEKNO": _SIGNED("0?[1-9]|[1-4]\\d|5[0-3]"), "BYSETPOS": _SIGNED("0{0,2}[1-9]|0?[1-9]\\d|[12]\\d\\d|3[0-5]\\d|36[0-6]"), "BYMONTH": "0?[1-9]|1[0-2]", "BYHOUR": "[01]?\\d|2[0-3]", "BYMINUTE": "[0-5]?\\d", "BYSECOND": "[0-5]?\\d|60",
}
_PART = "|".join(f"{n}=(?:{v})(?:,(?:{v}))*" if n.startswith("BY") else f"{n}=(?:{v})" for n, v in _PARTS.items())
_RULE_FORM = f"^(?:{_PART})(?:;(?:{_PART}))*;?$"


#: Names that zone files carry for other ends begin in lower case.
_ZONES = sorted(z for z in available_timezones() if z[0].isupper() and z != "Factory")


def _zone(params: Column) -> Column:
    """The TZID of a line, UTC without one, and null for one that isn't known."""
    own = _param(params, "TZID")
    return F.when(own.isNull(), F.lit("UTC")).when(F.array_contains(F.split(F.lit(",".join(_ZONES)), ","), own), own)


def content_lines(body: Column) -> Column:
    """array<struct<name, params, value>> of a body."""
    found = F.regexp_extract_all(body, F.lit(_LINE), F.lit(0))
    return F.transform(found, lambda x: F.struct(*(F.regexp_extract(x, _SPLIT, k).alias(n) for k, n in ((1, "name"), (2, "params"), (3, "value")))))


def _param(params: Column, name: str) -> Column:
    v = F.regexp_replace(F.regexp_extract(params, rf";{name}=(\"[^\"]*\"|[^;]*)", 1), '"', "")
    return F.when(v != "", v)


def _of(lines: Column, name: str) -> Column:
    return F.filter(lines, lambda x: x["name"] == name)


def _last(lines: Column, name: str) -> Column:
    """The last line of a name: of those that can stand once, the later replaces the earlier."""
    return F.try_element_at(_of(lines, name), F.lit(-1))


def _instant(line: Column, value: Column | None = None) -> Column:
    """UTC seconds of a date-time in its TZID, or in UTC."""
    value = line["value"] if value is None else value
    return ical.to_utc(ical.local_seconds(value), F.when(value.endswith("Z"), F.lit("UTC")).otherwise(_zone(line["params"])))


def _rule_parts(value: Column) -> Column:
    """A rule's parts as text, null where it has none of a name; whole is all of it."""
    value = F.upper(value)
    return F.struct(value.alias("whole"), *(F.nullif(F.regexp_extract(value, rf"(?:^|;){n}=([^;]*)", 1), F.lit("")).alias(n) for n in _PARTS))


def _rule(parts: Column, zone: Column) -> Column:
    """A rule's parts as a struct. UNTIL without Z is a local time in DTSTART's zone."""
    ints = lambda n: F.transform(F.split(parts[n], ","), lambda x: x.try_cast("int"))
    fields = [parts["FREQ"].alias("freq"), parts["INTERVAL"].try_cast("int").alias("interval"), parts["COUNT"].try_cast("int").alias("count"), ical.to_utc(ical.local_seconds(parts["UNTIL"]), F.when(parts["UNTIL"].endswith("Z"), F.lit("UTC")).otherwise(zone)).alias("until_ts"), F.split(parts["BYDAY"], ",").alias("byday")]
    fields += [ints(n).alias(c) for c, n in _RULE_LISTS.items()] + [F.coalesce(parts["WKST"], F.lit(WEEKDAYS[0])).alias("wkst")]
    order = [f.split(":")[0] for f in RULE[len("struct<") : -1].replace("array<string>", "a").replace("array<int>", "a").split(",")]
    return F.when(parts["whole"].isNotNull(), F.struct(*fields)).cast("struct<" + ",".join(f"{n}:{t}" for n, t in zip(order, ["string", "int", "int", "bigint", "array<string>", *["array<int>"] * 8, "string"], strict=True)) + ">")


def _rule_fault(parts: Column, rule: Column, name: str) -> Column:
    sound = rule["freq"].isNotNull() & rule["interval"].isNotNull()
    ends = rule["until_ts"].isNotNull() | ~parts["whole"].contains("UNTIL=")
    return (
        F.when(parts["whole"].isNull(), F.lit(None)).when(~F.coalesce(sound, F.lit(False)), F.lit(f"{name} needs FREQ and INTERVAL"))
        .when(~parts["whole"].rlike(_RULE_FORM), F.lit(f"{name} has a part that says nothing")).when(~ends, F.lit(f"{name} has no such UNTIL"))
    )


def _time_fault(name: str) -> Column:
    c = _column(name)
    return (
        F.when(F.col(c).isNull(), F.lit(None)).when(F.col(f"{c}_zone").isNull(), F.lit(f"{name} has an unknown TZID")).when(F.col(f"{c}_local").isNull(), F.lit(f"{name} is no date-time"))
        .when(~ical.is_single(F.col(f"{c}_local"), F.col(f"{c}_tz"), F.col(f"{c}_ts")), F.lit(f"{name} names no single instant"))
    )


#: Properties of which the last line holds, and those of them that are times.
_SINGLE = ("UID", "LAST-MODIFIED", "DTSTART", "DTEND", "DURATION", "RRULE", "EXRULE", "LOCATION-TYPE", "CLASS", "GEO")
_TIMES = ("LAST-MODIFIED", "DTSTART", "DTEND")


def _column(name: str) -> str:
    return "_" + name.lower().replace("-", "_")


def _staged(bodies: DataFrame) -> DataFrame:
    """bodies with their lines (_l), the last line of each single property, the times' zones and instants, and what
    several columns read. Each stage is made once a row: in one expression, every use would read the body again."""
    # Reading a body is far more work than moving it: small files would give it to a few tasks.
    rows = once(bodies.repartition(F.xxhash64("event_uid", "body")), _l=content_lines(F.coalesce("body", F.lit(""))))
    l = F.col("_l")  # noqa: E741
    rows = once(rows, **{_column(n): _last(l, n) for n in _SINGLE}, _carried=F.filter(l, lambda x: ~x["name"].isin(*KNOWN)))
    line = lambda n: F.col(_column(n))
    lat, long = (F.try_element_at(F.split(line("GEO")["value"], ";"), F.lit(k)).try_cast("double") for k in (1, 2))
    zones = {f"{_column(n)}_{k}": c for n in _TIMES for k, c in (("zone", _zone(line(n)["params"])), ("local", ical.local_seconds(line(n)["value"])))}
    rows = once(rows, **zones, _seconds=ical.duration_seconds(line("DURATION")["value"]), _lat=lat, _long=long)
    rows = once(rows, **{f"{_column(n)}_tz": F.when(line(n)["value"].endswith("Z"), F.lit("UTC")).otherwise(F.col(f"{_column(n)}_zone")) for n in _TIMES})
    return once(rows, **{f"{_column(n)}_ts": ical.to_utc(F.col(f"{_column(n)}_local"), F.col(f"{_column(n)}_tz")) for n in _TIMES})


def _dates_fault(lines: Column, name: str) -> Column:
    """Whether any member of the lines of a name can't be read."""
    bad = F.exists(_of(lines, name), lambda x: _zone(x["params"]).isNull() | F.exists(ical.members(x["value"]), lambda v: ical.local_seconds(v).isNull()))
    return F.when(bad, F.lit(f"{name} has a member that is no date-time"))


def _geo_fault(line: Column, lat: Column, long: Column) -> Column:
    """A blank place is none; any other is a latitude and a longitude."""
    there = F.coalesce(lat.between(-90, 90) & long.between(-180, 180), F.lit(False))
    return F.when(line.isNotNull() & (F.regexp_replace(line["value"], r"[\s;]", "") != "") & ~there, F.lit("GEO is no place"))


def _properties() -> dict[str, Column]:
    """What events and overrides have in common, of staged rows."""
    lines, carried, lat, long, seconds = (F.col(c) for c in ("_l", "_carried", "_lat", "_long", "_seconds"))
    names = F.array_sort(F.array_distinct(F.transform(carried, lambda x: x["name"])))
    grouped = F.transform(names, lambda n: F.struct(n.alias("k"), F.transform(F.filter(carried, lambda x: x["name"] == n), lambda x: F.concat(x["name"], x["params"], F.lit(":"), x["value"])).alias("v")))
    listed = lambda name: F.when(F.size(_of(lines, name)) > 0, F.array_sort(F.array_distinct(F.flatten(F.transform(_of(lines, name), lambda x: ical.members(x["value"]))))))
    return {
        "last_modified_ts": F.coalesce("_last_modified_ts", F.unix_seconds(F.current_timestamp())), "last_modified_ms": F.coalesce(_param(F.col("_last_modified.params"), "X-MILLIS").try_cast("int"), F.lit(0)),
        "duration_s": seconds, "categories": listed("CATEGORIES"), "location_type": F.when(F.col("_location_type").isNotNull(), F.array_sort(F.array_distinct(ical.members(F.col("_location_type.value"))))),
        "faults": F.coalesce(F.when(F.col("_duration").isNotNull() & seconds.isNull(), F.lit("DURATION is none")), _geo_fault(F.col("_geo"), lat, long), _time_fault("LAST-MODIFIED")),
        "class": F.nullif(F.trim("_class.value"), F.lit("")),
        "related_to": F.when(F.size(_of(lines, "RELATED-TO")) > 0, F.array_distinct(F.transform(_of(lines, "RELATED-TO"), lambda x: F.struct(F.coalesce(_param(x["params"], "RELTYPE"), F.lit("PARENT")).alias("reltype"), x["value"].alias("uid"))))).cast(RELATED),
        "geo": F.when(lat.isNotNull() & long.isNotNull(), F.struct(lat.alias("lat"), long.alias("long"))).cast(GEO), "passive": F.map_from_entries(grouped).cast(PASSIVE),
    }


def parse_events(bodies: DataFrame) -> DataFrame:
    """bodies (calendar_uid, event_uid, body) to event rows with error (null: sound). A null or empty body is an error."""
    l = F.col("_l")  # noqa: E741
    dates = lambda name: F.array_sort(F.array_distinct(F.flatten(F.transform(_of(l, name), lambda x: F.transform(ical.members(x["value"]), lambda v: _instant(x, v))))))
    rules = ("RRULE", "EXRULE")
    rows = once(_staged(bodies), **{f"{_column(n)}_parts": _rule_parts(F.col(f"{_column(n)}.value")) for n in rules})
    rows = once(rows, **{f"{_column(n)}_rule": _rule(F.col(f"{_column(n)}_parts"), F.col("_dtstart_zone")) for n in rules})
    p = _properties()
    error = F.coalesce(
        F.when(F.size(l) == 0, F.lit("no property")), F.when(F.col("_uid.value") != F.col("event_uid"), F.lit("UID differs from the key")), F.when(F.col("_dtstart").isNull(), F.lit("no DTSTART")), _time_fault("DTSTART"), _time_fault("DTEND"),
        *(_rule_fault(F.col(f"{_column(n)}_parts"), F.col(f"{_column(n)}_rule"), n) for n in rules), _dates_fault(l, "RDATE"), _dates_fault(l, "EXDATE"), p["faults"],
    )
    return once(rows, error=error).select(
        "calendar_uid", "event_uid", p["last_modified_ts"].alias("last_modified_ts"), p["last_modified_ms"].alias("last_modified_ms"), F.col("_dtstart_ts").alias("dtstart_ts"), F.coalesce("_dtstart_zone", F.lit("UTC")).alias("tzid"),
        F.col("_dtend_ts").alias("dtend_ts"), p["duration_s"].alias("duration_s"), F.col("_rrule_rule").alias("rule"), F.col("_exrule_rule").alias("exrule"), dates("RDATE").alias("rdates"), dates("EXDATE").alias("exdates"),
        *(p[c].alias(c) for c in ("categories", "location_type", "class", "related_to", "geo", "passive")), "error",
    )


def parse_overrides(bodies: DataFrame) -> DataFrame:
    """bodies (calendar_uid, event_uid, occurrence, body) to override rows with error. A blank GEO clears the event's."""
    rows = once(_staged(bodies), _occurrence=ical.local_seconds(F.col("occurrence")))
    l = F.col("_l")  # noqa: E741
    p = _properties()
    at = F.col("_occurrence")
    scheduled = F.exists(l, lambda x: x["name"].isin("RRULE", "EXRULE", "RDATE", "EXDATE"))
    own = F.coalesce(p["duration_s"], F.col("_dtend_ts") - F.coalesce("_dtstart_ts", at))
    error = F.coalesce(F.when(at.isNull(), F.lit("the occurrence is no date-time")), F.when(scheduled, F.lit("an override has no rule or dates")), F.when(F.col("_uid.value") != F.col("event_uid"), F.lit("UID differs from the key")), _time_fault("DTSTART"), _time_fault("DTEND"), p["faults"])
    return once(rows, error=error).select(
        "calendar_uid", "event_uid", at.alias("occurrence_ts"), p["last_modified_ts"].alias("last_modified_ts"), p["last_modified_ms"].alias("last_modified_ms"), own.alias("duration_s"),
        *(p[c].alias(c) for c in ("categories", "location_type", "class", "related_to")), (F.size(_of(l, "GEO")) > 0).alias("geo_overridden"), p["geo"].alias("geo"), p["passive"].alias("passive"), "error",
    )


def _described(blank: bool = False) -> list[Column]:
    """Arrays of the lines that events, overrides and instances have in common; with blank, an empty list is a line too."""
    shown = lambda c: F.col(c).isNotNull() if blank else F.size(c) > 0
    lists = [F.when(shown(c), F.concat(F.lit(f"{name}:"), ical.show_list(F.col(c)))) for name, c in (("CATEGORIES", "categories"), ("LOCATION-TYPE", "location_type"))]
    related = F.transform(F.coalesce("related_to", F.array().cast(RELATED)), lambda r: F.concat(F.lit("RELATED-TO;RELTYPE="), r["reltype"], F.lit(":"), r["uid"]))
    carried = F.flatten(F.coalesce(F.map_values("passive"), F.array().cast("array<array<string>>")))
    return [F.array(*lists, F.concat(F.lit("CLASS:"), F.col("class"))), related, carried]


def _place() -> Column:
    return F.concat(F.lit("GEO:"), F.col("geo.lat").cast("string"), F.lit(";"), F.col("geo.long").cast("string"))


def _timed(name: str, tzid: Column, time: Column) -> Column:
    return F.concat(_stem(name, tzid), ical.show_time(time, tzid))


def _stem(name: str, tzid: Column) -> Column:
    """A line up to its value, which is a time in a zone."""
    return F.concat(F.lit(name), F.when(tzid == "UTC", F.lit(":")).otherwise(F.concat(F.lit(";TZID="), tzid, F.lit(":"))))


def _modified() -> Column:
    millis = F.when(F.col("last_modified_ms") > 0, F.concat(F.lit(";X-MILLIS="), F.col("last_modified_ms").cast("string"))).otherwise(F.lit(""))
    return F.concat(F.lit("LAST-MODIFIED"), millis, F.lit(":"), ical.show_time(F.col("last_modified_ts")))


def _sorted_lines(single: list[Column], *more: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.concat(F.array(*single), *more), lambda x: x.isNotNull())))


def _shown_rule(name: str, rule: str) -> Column:
    """A rule's line with its parts by name; UNTIL in UTC, WKST where it isn't Monday."""
    of = lambda f: F.col(f"{rule}.{f}")
    parts = {n: F.when(F.size(of(f)) > 0, F.array_join(F.transform(of(f), lambda x: x.cast("string")), ",")) for f, n in (_RULE_LISTS | {"byday": "BYDAY"}).items()}
    parts |= {n: of(n.lower()).cast("string") for n in ("FREQ", "INTERVAL", "COUNT")}
    parts |= {"UNTIL": ical.show_time(of("until_ts")), "WKST": F.when(of("wkst") != WEEKDAYS[0], of("wkst"))}
    return F.when(F.col(rule).isNotNull(), F.concat(F.lit(f"{name}:"), F.concat_ws(";", *(F.concat(F.lit(f"{n}="), v) for n, v in sorted(parts.items())))))


def render_calendar() -> Column:
    return F.array(F.concat(F.lit("UID:"), F.col("calendar_uid")))


def render_event(tzid: str | None = None) -> Column:
    """An event's content lines, sorted, in a zone or else in its own."""
    zone = F.lit(tzid) if tzid else F.coalesce("tzid", F.lit("UTC"))
    dates = lambda name, c: F.when(F.size(c) > 0, F.concat(_stem(name, zone), F.array_join(F.transform(c, lambda t: ical.show_time(t, zone)), ",")))
    single = [
        F.concat(F.lit("UID:"), F.col("event_uid")), _modified(), _timed("DTSTART", zone, F.col("dtstart_ts")), _timed("DTEND", zone, F.col("dtend_ts")), F.concat(F.lit("DURATION:"), ical.show_duration(F.col("duration_s"))),
        _shown_rule("RRULE", "rule"), _shown_rule("EXRULE", "exrule"), dates("RDATE", "rdates"), dates("EXDATE", "exdates"), _place(),
    ]
    return _sorted_lines(single, *_described())


def render_override(tzid: str = "UTC") -> Column:
    """An override's content lines, sorted. What it clears is a blank line; what it inherits is none."""
    place = F.when(F.coalesce("geo_overridden", F.lit(False)), F.coalesce(_place(), F.lit("GEO:;")))
    single = [_modified(), _timed("DTSTART", F.lit(tzid), F.col("occurrence_ts")), F.concat(F.lit("DURATION:"), ical.show_duration(F.col("duration_s"))), place]
    return _sorted_lines(single, *_described(blank=True))


def render_instance(tzid: str = "UTC") -> Column:
    """An instance's content lines, sorted."""
    zone = F.lit(tzid)
    single = [
        _timed("DTSTART", zone, F.col("dtstart_ts")), _timed("DTEND", zone, F.col("dtend_ts")), F.concat(F.lit("DURATION:"), ical.show_duration(F.col("duration_s"))),
        _timed("RECURRENCE-ID;VALUE=DATE-TIME", zone, F.col("recurrence_id_ts")), F.concat(F.lit("UID:"), F.col("event_uid")), _place(),
    ]
    return _sorted_lines(single, *_described())
