"""Schemas of the calendar tables.

calendars hold events, events have overrides of single occurrences, and instances are what events and overrides make
together; instances are never stored.
"""

from __future__ import annotations

#: RELATED-TO pairs.
RELATED = "array<struct<reltype:string,uid:string>>"
GEO = "struct<lat:double,long:double>"
#: Properties that are only carried along, by name.
PASSIVE = "map<string,array<string>>"
RULE = (
    "struct<freq:string,interval:int,count:int,until_ts:bigint,byday:array<string>,bymonthday:array<int>,bymonth:array<int>,"
    "byyearday:array<int>,byweekno:array<int>,bysetpos:array<int>,byhour:array<int>,byminute:array<int>,bysecond:array<int>,wkst:string>"
)

CALENDARS = "calendar_uid string, indexes_active boolean"
EVENTS = (
    "calendar_uid string, event_uid string, last_modified_ts bigint, last_modified_ms int, dtstart_ts bigint, tzid string, "
    f"dtend_ts bigint, duration_s bigint, rule {RULE}, exrule {RULE}, rdates array<bigint>, exdates array<bigint>, "
    f"categories array<string>, location_type array<string>, class string, related_to {RELATED}, geo {GEO}, passive {PASSIVE}"
)
#: Null inherits; an empty array clears; geo_overridden with null geo clears geo.
OVERRIDES = (
    "calendar_uid string, event_uid string, occurrence_ts bigint, last_modified_ts bigint, last_modified_ms int, duration_s bigint, "
    f"categories array<string>, location_type array<string>, class string, related_to {RELATED}, geo_overridden boolean, geo {GEO}, passive {PASSIVE}"
)
CHANGES = "calendar_uid string, op string, event_uid string, occurrence_ts bigint, last_modified_ts bigint, message string"

#: Weekdays as rules name them, Monday first as in weekday().
WEEKDAYS = ("MO", "TU", "WE", "TH", "FR", "SA", "SU")
DAY = 86_400
UNIT = {"SECONDLY": 1, "MINUTELY": 60, "HOURLY": 3600, "DAILY": DAY, "WEEKLY": 7 * DAY}
EVENT_KEY = ("calendar_uid", "event_uid")
OCCURRENCE_KEY = (*EVENT_KEY, "occurrence_ts")
#: A page where none is asked for.
PAGE = 50
