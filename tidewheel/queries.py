"""The library's queries over the order calendars, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo, ical
from .model import CALENDARS, DAY, EVENT_KEY, OCCURRENCE_KEY, RULE
from .operators import maintenance as m
from .operators import predicates as p
from .operators.instances import base_duration, instances
from .operators.recurrence import occurrences
from .plans import commands
from .plans.queries import BY_DISTANCE_THEN_START, BY_START_THEN_DISTANCE, Bound, Query, get, group, list_events, list_instances, list_overrides, query_events, query_instances, rendered
from .sources import orders
from .sources.lines import render_event, render_override

Run = Callable[[SparkSession, str], DataFrame]

#: Fixed points of time in the order tables, and a place.
T1, T2 = 820_454_400, 852_076_800  # 1996-01-01 and 1997-01-01
LAT, LONG = 10.0, 20.0
#: Fewer numbers than a whole rule: what the SQL of every query starts from.
BASE_SQL = """
WITH ev AS (SELECT 'ORD-' || o_orderkey AS event_uid, CAST(epoch(o_orderdate) AS BIGINT) AS dtstart_ts, 1800 * (1 + o_orderkey % 4) AS dur, 1 + o_orderkey % 7 AS step, 1 + o_orderkey % 5 AS n,
  o_orderkey % 2 = 0 AS has_end, [o_orderpriority, c_mktsegment] AS categories, CASE WHEN o_custkey % 2 = 0 THEN ['ONLINE', c_mktsegment] ELSE [c_mktsegment] END AS location_type,
  CASE o_orderstatus WHEN 'F' THEN 'PUBLIC' WHEN 'O' THEN 'PRIVATE' ELSE 'CONFIDENTIAL' END AS class, 'CUST-' || o_custkey AS parent,
  CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey * 7 % 1200 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(60 AS DOUBLE) END AS lat,
  CASE WHEN o_custkey % 10 <> 0 THEN CAST(o_custkey * 13 % 3400 AS DOUBLE) / CAST(10 AS DOUBLE) - CAST(170 AS DOUBLE) END AS long
  FROM orders JOIN customer ON o_custkey = c_custkey),
ov AS (SELECT 'ORD-' || o_orderkey AS event_uid, CAST(epoch(o_orderdate) AS BIGINT) + (l_linenumber - 1) * (1 + o_orderkey % 7) * 86400 AS occurrence_ts, CAST(q AS BIGINT) * 60 AS duration_s,
  CASE WHEN flag = 'R' THEN ['RF_' || flag] END AS categories, status = 'O' AS geo_overridden
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, min(l_returnflag) AS flag, max(l_linestatus) AS status FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey),
occ AS (SELECT ev.*, dtstart_ts + k * step * 86400 AS occurs FROM (SELECT *, unnest(range(n)) AS k FROM ev) ev),
inst AS (SELECT occ.event_uid, occ.occurs AS dtstart_ts, coalesce(ov.duration_s, occ.dur) AS duration_s, occ.occurs + coalesce(ov.duration_s, occ.dur) AS dtend_ts, ov.event_uid IS NOT NULL AS has_override,
  coalesce(ov.categories, occ.categories) AS categories, occ.location_type, occ.class, occ.parent,
  CASE WHEN coalesce(ov.geo_overridden, FALSE) THEN NULL ELSE lat END AS lat, CASE WHEN coalesce(ov.geo_overridden, FALSE) THEN NULL ELSE long END AS long
  FROM occ LEFT JOIN ov ON ov.event_uid = occ.event_uid AND ov.occurrence_ts = occ.occurs)
"""
_KM = (
    "CASE WHEN lat IS NOT NULL AND long IS NOT NULL THEN CAST(12742.0176 AS DOUBLE) * asin(least(CAST(1 AS DOUBLE), sqrt(sin(radians(lat - CAST({lat} AS DOUBLE)) / 2) * sin(radians(lat - CAST({lat} AS DOUBLE)) / 2)"
    " + cos(radians(lat)) * cos(radians(CAST({lat} AS DOUBLE))) * sin(radians(long - CAST({long} AS DOUBLE)) / 2) * sin(radians(long - CAST({long} AS DOUBLE)) / 2)))) END"
).format(lat=LAT, long=LONG)
_MICRO = f"CAST(floor(({_KM}) * 1000000) AS BIGINT)"
_EVI_SQL = "event_uid, dtstart_ts, dtend_ts, has_override, array_to_string(list_sort(categories), ',') AS categories, class, lat, long"
_EVT_SQL = "event_uid, dtstart_ts, array_to_string(list_sort(categories), ',') AS categories, class, lat, long"


def _evi(df: DataFrame, *more: str) -> DataFrame:
    """What queries show of an instance; a distance from nowhere as -1."""
    return df.fillna(-1, ["dist_micro"] if more else []).select("event_uid", "dtstart_ts", "dtend_ts", "has_override", ical.show_list(F.col("categories")).alias("categories"), "class", F.col("geo.lat").alias("lat"), F.col("geo.long").alias("long"), *more)


def _evt(df: DataFrame, *more: str) -> DataFrame:
    return df.fillna(-1, ["dist_micro"] if more else []).select("event_uid", "dtstart_ts", ical.show_list(F.col("categories")).alias("categories"), "class", F.col("geo.lat").alias("lat"), F.col("geo.long").alias("long"), *more)


#: Conditions by name: as columns and as SQL. None has a limit.
CONDITIONS: dict[str, tuple[Callable[[], Column], str]] = {
    "categories_and": (lambda: p.has_categories("1-URGENT", "BUILDING"), "list_contains(categories, '1-URGENT') AND list_contains(categories, 'BUILDING')"),
    "categories_or": (lambda: p.has_categories("1-URGENT", "RF_R", any_of=True), "(list_contains(categories, '1-URGENT') OR list_contains(categories, 'RF_R'))"),
    "categories_not": (lambda: ~p.has_categories("BUILDING", any_of=True), "NOT list_contains(categories, 'BUILDING')"),
    "location_type": (lambda: p.has_location_types("ONLINE", "MACHINERY"), "list_contains(location_type, 'ONLINE') AND list_contains(location_type, 'MACHINERY')"),
    "location_type_not": (lambda: ~p.has_location_types("ONLINE"), "NOT list_contains(location_type, 'ONLINE')"),
    "class": (lambda: p.is_class("PUBLIC", "CONFIDENTIAL", any_of=True), "class IN ('PUBLIC', 'CONFIDENTIAL')"),
    "class_not": (lambda: ~p.is_class("PUBLIC"), "coalesce(class <> 'PUBLIC', TRUE)"),
    "related_to": (lambda: p.related_to("CUST-7", "CUST-11", any_of=True), "parent IN ('CUST-7', 'CUST-11')"),
    "related_to_not": (lambda: ~p.related_to("CUST-7"), "parent <> 'CUST-7'"),
    "uid": (lambda: p.uid_in("ORD-1", "ORD-5", "ORD-33"), "event_uid IN ('ORD-1', 'ORD-5', 'ORD-33')"),
    "uid_not": (lambda: ~p.uid_in("ORD-1"), "event_uid <> 'ORD-1'"),
    "geo_km": (lambda: p.within(LAT, LONG, 1500), f"coalesce(({_KM}) <= 1500, FALSE)"),
    "geo_mi": (lambda: p.within(LAT, LONG, 900, "MI"), f"coalesce(({_KM}) <= CAST(1448.4096 AS DOUBLE), FALSE)"),
    "geo_not": (lambda: ~p.within(LAT, LONG, 5000), f"NOT coalesce(({_KM}) <= 5000, FALSE)"),
    "group_nested": (
        lambda: group([p.has_categories("BUILDING"), "OR", [p.is_class("PUBLIC"), "AND", ~p.has_location_types("ONLINE")], "AND", [p.within(LAT, LONG, 6000), "OR", p.has_categories("RF_R")]]),
        f"(list_contains(categories, 'BUILDING') OR (class = 'PUBLIC' AND NOT list_contains(location_type, 'ONLINE'))) AND (coalesce(({_KM}) <= 6000, FALSE) OR list_contains(categories, 'RF_R'))",
    ),
}

QUERIES: dict[str, Run] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, run: Run, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = BASE_SQL + sql


def _instances(q: Query, *more: str) -> Run:
    return lambda s, d: _evi(query_instances(orders.events(s, d), orders.overrides(s, d), q), *more)


def _events(q: Query, *more: str) -> Run:
    return lambda s, d: _evt(query_events(orders.events(s, d), q), *more)


for _name, (_where, _sql) in CONDITIONS.items():
    # Columns need a session, so they are made when the query runs.
    _add(f"evi_{_name}", lambda s, d, w=_where: _instances(Query(where=w(), limit=None))(s, d), f"SELECT {_EVI_SQL} FROM inst WHERE {_sql}")
    _add(f"evt_{_name}", lambda s, d, w=_where: _events(Query(where=w(), limit=None))(s, d), f"SELECT {_EVT_SQL} FROM ev WHERE {_sql}")

_PAGE_SQL = "ORDER BY dtstart_ts, dtend_ts, event_uid LIMIT {} OFFSET {}"
_add("evi_default", _instances(Query()), f"SELECT {_EVI_SQL} FROM inst {_PAGE_SQL.format(50, 0)}")
_add("evi_page", _instances(Query(offset=120, limit=30)), f"SELECT {_EVI_SQL} FROM inst {_PAGE_SQL.format(30, 120)}")
_add("evi_override_merge", _instances(Query(limit=None)), f"SELECT {_EVI_SQL} FROM inst")
_add("evi_from_gt", _instances(Query(after=Bound(T1, "GT"), limit=None)), f"SELECT {_EVI_SQL} FROM inst WHERE dtstart_ts > {T1}")
_add("evi_from_gte_dtend", _instances(Query(after=Bound(T1, "GTE", "DTEND"), limit=None)), f"SELECT {_EVI_SQL} FROM inst WHERE dtend_ts >= {T1}")
_add("evi_until_lt", _instances(Query(before=Bound(T2, "LT"), limit=None)), f"SELECT {_EVI_SQL} FROM inst WHERE dtstart_ts < {T2}")
_add("evi_until_lte_dtend", _instances(Query(before=Bound(T2, "LTE", "DTEND"), limit=None)), f"SELECT {_EVI_SQL} FROM inst WHERE dtend_ts <= {T2}")
_add(
    "evi_range_page", lambda s, d: _instances(Query(where=p.has_categories("BUILDING"), after=Bound(T1, "GTE"), before=Bound(T2, "LT"), limit=40))(s, d),
    f"SELECT {_EVI_SQL} FROM inst WHERE list_contains(categories, 'BUILDING') AND dtstart_ts >= {T1} AND dtstart_ts < {T2} {_PAGE_SQL.format(40, 0)}",
)
_add("evi_order_dtstart_geo", _instances(Query(order=BY_START_THEN_DISTANCE, place=(LAT, LONG)), "dist_micro"), f"SELECT {_EVI_SQL}, coalesce({_MICRO}, -1) AS dist_micro FROM inst ORDER BY inst.dtstart_ts, dist_micro, event_uid LIMIT 50")
_add("evi_order_geo_dtstart", _instances(Query(order=BY_DISTANCE_THEN_START, place=(LAT, LONG)), "dist_micro"), f"SELECT {_EVI_SQL}, {_MICRO} AS dist_micro FROM inst WHERE lat IS NOT NULL ORDER BY dist_micro, inst.dtstart_ts, event_uid LIMIT 50")
_add("evi_distinct_uid", _instances(Query(distinct=True, limit=None)), f"SELECT {_EVI_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY event_uid ORDER BY dtstart_ts) AS rn FROM inst) WHERE rn = 1")
_add("evi_distinct_page", _instances(Query(distinct=True, offset=10, limit=25)), f"SELECT {_EVI_SQL} FROM (SELECT *, row_number() OVER (PARTITION BY event_uid ORDER BY dtstart_ts) AS rn FROM inst) WHERE rn = 1 {_PAGE_SQL.format(25, 10)}")


def _detached(s: SparkSession, d: str) -> DataFrame:
    o = orders.overrides(s, d)
    shown = instances(orders.events(s, d), o).filter("has_override").select(*EVENT_KEY, F.col("dtstart_ts").alias("occurrence_ts"))
    return o.join(shown, [*EVENT_KEY, "occurrence_ts"], "left_anti").select("event_uid", "occurrence_ts")


_add("evi_detached_override", _detached, "SELECT event_uid, occurrence_ts FROM ov WHERE NOT EXISTS (SELECT 1 FROM inst WHERE inst.event_uid = ov.event_uid AND inst.dtstart_ts = ov.occurrence_ts)")
_add(
    "evi_tzid_render", lambda s, d: rendered(instances(orders.events(s, d), orders.overrides(s, d)), "Europe/London").select("event_uid", "dtstart_ts", "dtstart", "dtend"),
    "SELECT event_uid, dtstart_ts, strftime(timezone('Europe/London', to_timestamp(dtstart_ts)), '%Y%m%dT%H%M%S') AS dtstart, strftime(timezone('Europe/London', to_timestamp(dtend_ts)), '%Y%m%dT%H%M%S') AS dtend FROM inst",
)
_add("evt_default", _events(Query()), f"SELECT {_EVT_SQL} FROM ev ORDER BY dtstart_ts, event_uid LIMIT 50")
_add("evt_page", _events(Query(offset=75, limit=25)), f"SELECT {_EVT_SQL} FROM ev ORDER BY dtstart_ts, event_uid LIMIT 25 OFFSET 75")
_add("evt_order_dtstart_geo", _events(Query(order=BY_START_THEN_DISTANCE, place=(LAT, LONG)), "dist_micro"), f"SELECT {_EVT_SQL}, coalesce({_MICRO}, -1) AS dist_micro FROM ev ORDER BY ev.dtstart_ts, dist_micro, event_uid LIMIT 50")
_add("evt_order_geo_dtstart", _events(Query(order=BY_DISTANCE_THEN_START, place=(LAT, LONG)), "dist_micro"), f"SELECT {_EVT_SQL}, {_MICRO} AS dist_micro FROM ev WHERE lat IS NOT NULL ORDER BY dist_micro, ev.dtstart_ts, event_uid LIMIT 50")
_add("evt_range", _events(Query(after=Bound(T1, "GTE"), before=Bound(T2, "LT"), limit=None)), f"SELECT {_EVT_SQL} FROM ev WHERE dtstart_ts >= {T1} AND dtstart_ts < {T2}")
_add("evt_range_dtend", _events(Query(after=Bound(T1, "GTE", "DTEND"), before=Bound(T2, "LTE", "DTEND"), limit=None)), f"SELECT {_EVT_SQL} FROM ev WHERE has_end AND dtstart_ts + dur >= {T1} AND dtstart_ts + dur <= {T2}")
_add("evt_range_dtend_or_duration", _events(Query(after=Bound(T1, "GTE", "DTEND"), limit=None, end_from_duration=True)), f"SELECT {_EVT_SQL} FROM ev WHERE dtstart_ts + dur >= {T1}")
_add("evt_list", lambda s, d: list_events(orders.events(s, d), orders.CALENDAR).select("event_uid", "dtstart_ts"), "SELECT event_uid, dtstart_ts FROM ev ORDER BY event_uid LIMIT 50")
_add("evi_list", lambda s, d: list_instances(orders.events(s, d), orders.overrides(s, d), orders.CALENDAR, "ORD-4").select("event_uid", "dtstart_ts", "dtend_ts"), "SELECT event_uid, dtstart_ts, dtend_ts FROM inst WHERE event_uid = 'ORD-4' ORDER BY dtstart_ts LIMIT 50")
_add("evo_list", lambda s, d: list_overrides(orders.overrides(s, d), orders.CALENDAR, "ORD-4").select("event_uid", "occurrence_ts", "duration_s"), "SELECT event_uid, occurrence_ts, duration_s FROM ov WHERE event_uid = 'ORD-4' ORDER BY occurrence_ts LIMIT 50")
_add(
    "evt_prune", lambda s, d: m.prune_events(orders.events(s, d), T1, T2).select("event_uid"),
    f"SELECT event_uid FROM ev WHERE NOT (dtstart_ts + (n - 1) * step * 86400 + dur BETWEEN {T1} AND {T2})",
)
_add("evo_prune", lambda s, d: m.prune_overrides(orders.overrides(s, d), T1, T2).select("event_uid", "occurrence_ts"), f"SELECT event_uid, occurrence_ts FROM ov WHERE NOT (occurrence_ts BETWEEN {T1} AND {T2})")
_add("evt_delete", lambda s, d: m.delete(orders.overrides(s, d), orders.events(s, d).filter(p.is_class("PRIVATE"))).select("event_uid", "occurrence_ts"), "SELECT ov.event_uid, occurrence_ts FROM ov JOIN ev USING (event_uid) WHERE class <> 'PRIVATE'")


def _versions(s: SparkSession, d: str, late: bool) -> DataFrame:
    """The event stream as versions of a user's last event of a kind."""
    e = s.read.parquet(f"{d}/events.parquet")
    keep = (F.col("event_id") % 3 == 0) if late else (F.col("event_id") % 3 != 0)
    return e.filter(keep).select(F.lit("USERS").alias("calendar_uid"), F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("event_uid"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("last_modified_ts"), F.col("event_id").alias("last_modified_ms"), "value")


_add(
    "lww_upsert", lambda s, d: m.upsert(_versions(s, d, False), _versions(s, d, True)).select("event_uid", "last_modified_ts", "last_modified_ms", "value"),
    """, v AS (SELECT user_id || '-' || event_type AS event_uid, CAST(floor(epoch(ts)) AS BIGINT) AS last_modified_ts, event_id AS last_modified_ms, value FROM events)
SELECT event_uid, last_modified_ts, last_modified_ms, value FROM (SELECT *, row_number() OVER (PARTITION BY event_uid ORDER BY last_modified_ts DESC, last_modified_ms DESC) AS rn FROM v) WHERE rn = 1""",
)


def _event_diff(s: SparkSession, d: str) -> DataFrame:
    old = orders.events(s, d).filter("event_uid <> 'ORD-3'")
    new = orders.events(s, d).filter(~p.is_class("CONFIDENTIAL")).withColumn("categories", F.when(p.has_categories("BUILDING"), F.array_union("categories", F.array(F.lit("NEW")))).otherwise(F.col("categories")))
    out = m.diff(old, new, ["categories", "class"])
    return out.select("event_uid", "status", ical.show_list(F.col("categories_added")).alias("categories_added"))


_add(
    "event_diff", _event_diff,
    """, o AS (SELECT * FROM ev WHERE event_uid <> 'ORD-3'), w AS (SELECT event_uid, CASE WHEN list_contains(categories, 'BUILDING') THEN list_append(categories, 'NEW') ELSE categories END AS categories FROM ev WHERE class <> 'CONFIDENTIAL')
SELECT coalesce(o.event_uid, w.event_uid) AS event_uid, CASE WHEN o.event_uid IS NULL THEN 'added' WHEN w.event_uid IS NULL THEN 'removed' WHEN list_contains(w.categories, 'NEW') THEN 'updated' ELSE 'maintained' END AS status,
  array_to_string(list_sort(list_filter(coalesce(w.categories, []), lambda x: NOT list_contains(coalesce(o.categories, []), x))), ',') AS categories_added FROM o FULL JOIN w ON o.event_uid = w.event_uid""",
)


def _terms(s: SparkSession, d: str) -> DataFrame:
    return m.term_index(orders.events(s, d), orders.overrides(s, d), "categories")


_TERMS_SQL = """, base AS (SELECT DISTINCT event_uid, unnest(categories) AS term FROM ev), ch AS (SELECT event_uid, occurrence_ts, categories FROM ov WHERE categories IS NOT NULL),
gone AS (SELECT base.event_uid, term, TRUE AS included, occurrence_ts FROM base JOIN ch USING (event_uid) WHERE NOT list_contains(ch.categories, term)),
more AS (SELECT DISTINCT x.event_uid, x.term, FALSE AS included, x.occurrence_ts FROM (SELECT event_uid, occurrence_ts, unnest(categories) AS term FROM ch) x LEFT JOIN base b ON b.event_uid = x.event_uid AND b.term = x.term WHERE b.term IS NULL),
rows AS (SELECT event_uid, term, TRUE AS included, NULL AS occurrence_ts FROM base UNION ALL SELECT * FROM gone UNION ALL SELECT * FROM more),
terms AS (SELECT event_uid, term, included, coalesce(array_to_string(list_sort(list(DISTINCT occurrence_ts) FILTER (occurrence_ts IS NOT NULL)), ','), '') AS exceptions FROM rows GROUP BY 1, 2, 3)
"""
_shown = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
_add("terms_index", lambda s, d: _terms(s, d).select("event_uid", "term", "included", _shown(F.col("exceptions")).alias("exceptions")), _TERMS_SQL + "SELECT event_uid, term, included, exceptions FROM terms")
_add("not_terms", lambda s, d: _terms(s, d).filter("term = 'RF_R'").select("event_uid", (~F.col("included")).alias("included"), _shown(F.col("exceptions")).alias("exceptions")), _TERMS_SQL + "SELECT event_uid, NOT included AS included, exceptions FROM terms WHERE term = 'RF_R'")


_add(
    "duration_roundtrip", lambda s, d: orders.overrides(s, d).select("event_uid", "occurrence_ts", ical.duration_seconds(ical.show_duration(F.col("duration_s"))).alias("seconds"), ical.show_duration(F.col("duration_s")).alias("shown")),
    "SELECT event_uid, occurrence_ts, duration_s AS seconds, CASE WHEN duration_s = 0 THEN 'PT0S' ELSE 'PT' || CASE WHEN duration_s >= 3600 THEN (duration_s // 3600) || 'H' ELSE '' END || CASE WHEN duration_s % 3600 > 0 THEN (duration_s % 3600 // 60) || 'M' ELSE '' END END AS shown FROM ov",
)


def _bodies(s: SparkSession, d: str) -> DataFrame:
    e = orders.events(s, d)
    body = F.concat(F.lit("DTSTART:"), ical.show_time(F.col("dtstart_ts")), F.lit(" DURATION:"), ical.show_duration(base_duration()), F.lit(" RRULE:FREQ=DAILY;INTERVAL="), F.col("rule.interval"), F.lit(";COUNT="), F.col("rule.count"), F.lit(" CATEGORIES:"), F.array_join("categories", ","), F.lit(" CLASS:"), F.col("class"), F.lit(" SUMMARY:Order "), F.col("event_uid"), F.lit(" RELATED-TO:"), F.col("related_to")[0]["uid"])
    return e.select("calendar_uid", "event_uid", body.alias("body"))


def _ical_roundtrip(s: SparkSession, d: str) -> DataFrame:
    from .sources.lines import parse_events

    e = parse_events(_bodies(s, d)).filter("error is null")
    return e.select("event_uid", "dtstart_ts", "duration_s", F.col("rule.count").cast("long").alias("n"), ical.show_list(F.col("categories")).alias("categories"), "class", F.col("related_to")[0]["uid"].alias("parent"), F.col("passive")["SUMMARY"][0].alias("summary"))


_add("ical_roundtrip", _ical_roundtrip, "SELECT event_uid, dtstart_ts, CAST(dur AS BIGINT) AS duration_s, CAST(n AS BIGINT) AS n, array_to_string(list_sort(categories), ',') AS categories, class, parent, 'SUMMARY:Order ' || event_uid AS summary FROM ev")


def _with_rule(s: SparkSession, d: str, tzid: str = "UTC", rdates: Column | None = None, exdates: Column | None = None, **rule) -> DataFrame:
    """The order calendar with one rule for all; its own count where none is given."""
    e = orders.events(s, d)
    changed = {"count": F.col("rule.count")} | {k: v if isinstance(v, Column) else F.lit(v) for k, v in rule.items()}
    # Cast field by field: the optimizer sees through a struct, but not through a cast of one.
    fields = [x.split(":") for x in RULE[7:-1].split(",")]
    e = e.withColumn("rule", F.struct(*(changed.get(f, F.col(f"rule.{f}")).cast(t).alias(f) for f, t in fields))).withColumn("tzid", F.lit(tzid))
    return e.withColumns({k: v for k, v in (("rdates", rdates), ("exdates", exdates)) if v is not None})


def _at(df: DataFrame) -> DataFrame:
    return df.select("event_uid", "occurrence_ts")


_add(
    "rdate_exdate", lambda s, d: _at(occurrences(_with_rule(s, d, rdates=F.array(F.col("dtstart_ts") + 1000, F.col("dtstart_ts")), exdates=F.array(F.col("dtstart_ts") + F.col("rule.interval") * DAY)))),
    "SELECT event_uid, occurs AS occurrence_ts FROM occ WHERE occurs <> dtstart_ts + step * 86400 UNION SELECT event_uid, dtstart_ts + 1000 FROM ev",
)
_add(
    "rrule_weekly_byday", lambda s, d: _at(occurrences(_with_rule(s, d, freq="WEEKLY", interval=F.lit(2), byday=F.array(F.lit("MO"), F.lit("WE"))))),
    """, days AS (SELECT event_uid, n, dtstart_ts, dtstart_ts + k * 86400 AS occurs, CAST(epoch(date_trunc('week', make_timestamp((dtstart_ts + k * 86400) * 1000000))) - epoch(date_trunc('week', make_timestamp(dtstart_ts * 1000000))) AS BIGINT) // 604800 AS w,
  isodow(make_timestamp((dtstart_ts + k * 86400) * 1000000)) AS dow FROM (SELECT *, unnest(range(60)) AS k FROM ev))
SELECT event_uid, occurs AS occurrence_ts FROM (SELECT *, row_number() OVER (PARTITION BY event_uid ORDER BY occurs) AS rn FROM days WHERE w % 2 = 0 AND dow IN (1, 3)) WHERE rn <= n""",
)
_add(
    "rrule_monthly", lambda s, d: _at(occurrences(_with_rule(s, d, freq="MONTHLY", interval=F.lit(1), count=F.lit(None), until_ts=F.col("dtstart_ts") + 200 * DAY))),
    """, months AS (SELECT event_uid, dtstart_ts, make_timestamp(dtstart_ts * 1000000) AS s, date_trunc('month', make_timestamp(dtstart_ts * 1000000)) + to_months(CAST(k AS INTEGER)) AS mo FROM (SELECT *, unnest(range(8)) AS k FROM ev))
SELECT event_uid, CAST(epoch(mo) AS BIGINT) + (day(s) - 1) * 86400 + dtstart_ts % 86400 AS occurrence_ts FROM months
WHERE day(s) <= day(last_day(mo)) AND CAST(epoch(mo) AS BIGINT) + (day(s) - 1) * 86400 + dtstart_ts % 86400 <= dtstart_ts + 200 * 86400""",
)
_add(
    "rrule_monthly_last_friday", lambda s, d: _at(occurrences(_with_rule(s, d, freq="MONTHLY", interval=F.lit(1), count=F.lit(None), until_ts=F.col("dtstart_ts") + 100 * DAY, byday=F.array(F.lit("-1FR"))))),
    """SELECT event_uid, occurs AS occurrence_ts FROM (SELECT event_uid, dtstart_ts + k * 86400 AS occurs FROM (SELECT *, unnest(range(101)) AS k FROM ev))
WHERE isodow(make_timestamp(occurs * 1000000)) = 5 AND month(make_timestamp(occurs * 1000000)) <> month(make_timestamp((occurs + 7 * 86400) * 1000000))""",
)
_add("rrule_secondly_bounded", lambda s, d: _at(occurrences(_with_rule(s, d, freq="SECONDLY", interval=F.lit(7000), count=F.lit(None)).filter(F.col("dtstart_ts").between(T1, T1 + 7 * DAY)), until=T1 + 8 * DAY, low=T1 + 6 * DAY)), f"SELECT event_uid, dtstart_ts + 7000 * k AS occurrence_ts FROM (SELECT event_uid, dtstart_ts, unnest(range(100)) AS k FROM ev WHERE dtstart_ts BETWEEN {T1} AND {T1 + 7 * DAY}) WHERE dtstart_ts + 7000 * k BETWEEN {T1 + 6 * DAY} AND {T1 + 8 * DAY}")
_add(
    "rrule_new_york", lambda s, d: rendered(occurrences(_with_rule(s, d, tzid="America/New_York", freq="DAILY", interval=F.lit(100), count=F.lit(4))).withColumnRenamed("occurrence_ts", "dtstart_ts").withColumn("dtend_ts", F.col("dtstart_ts")), "America/New_York").select("event_uid", "dtstart_ts", "dtstart"),
    """SELECT event_uid, CAST(epoch(timezone('America/New_York', l)) AS BIGINT) AS dtstart_ts, strftime(l, '%Y%m%dT%H%M%S') AS dtstart FROM (SELECT event_uid, timezone('America/New_York', to_timestamp(dtstart_ts)) + to_days(CAST(100 * k AS INTEGER)) AS l FROM (SELECT *, unnest(range(4)) AS k FROM ev))""",
)
_add("evi_unbounded_page", lambda s, d: _evi(query_instances(_with_rule(s, d, count=F.lit(None)), orders.overrides(s, d), Query(after=Bound(T1, "GTE"), limit=60))), f", o2 AS (SELECT ev.*, dtstart_ts + k * step * 86400 AS occurs FROM (SELECT *, unnest(range(greatest(0, (820454400 - dtstart_ts) // (step * 86400)), greatest(0, (820454400 - dtstart_ts) // (step * 86400)) + 5)) AS k FROM ev) ev WHERE dtstart_ts + k * step * 86400 BETWEEN {T1} AND {T1 + 3 * DAY}), i2 AS (SELECT o2.event_uid, o2.occurs AS dtstart_ts, o2.occurs + coalesce(ov.duration_s, o2.dur) AS dtend_ts, ov.event_uid IS NOT NULL AS has_override, coalesce(ov.categories, o2.categories) AS categories, class, CASE WHEN coalesce(ov.geo_overridden, FALSE) THEN NULL ELSE lat END AS lat, CASE WHEN coalesce(ov.geo_overridden, FALSE) THEN NULL ELSE long END AS long FROM o2 LEFT JOIN ov ON ov.event_uid = o2.event_uid AND ov.occurrence_ts = o2.occurs) SELECT {_EVI_SQL} FROM i2 {_PAGE_SQL.format(60, 0)}")
_add("haversine_micro", lambda s, d: orders.events(s, d).select("event_uid", geo.micro_km(geo.haversine_km(F.col("geo.lat"), F.col("geo.long"), LAT, LONG)).alias("dist_micro")).fillna(-1, ["dist_micro"]), f"SELECT event_uid, coalesce({_MICRO}, -1) AS dist_micro FROM ev")


def _calendars(s: SparkSession, d: str) -> DataFrame:
    held = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_mktsegment").alias("calendar_uid"), F.lit(False).alias("indexes_active")).distinct()
    new = s.read.parquet(f"{d}/orders.parquet").select(F.explode(F.array("o_orderpriority", F.lit("BUILDING"))).alias("calendar_uid"))
    return commands.set_calendars(s.createDataFrame([], CALENDARS).unionByName(held), new).rows


def _number(c: str = "event_uid") -> Column:
    return F.substring(c, 5, 20).cast("long")


def _written(s: SparkSession, d: str) -> DataFrame:
    """Bodies of the order calendar with a stamp before, at or after the held one, one in five with a fault."""
    k, at = _number(), F.to_timestamp(F.regexp_extract("body", r"DTSTART:(\d{8}T\d{6})Z", 1), "yyyyMMdd'T'HHmmss")
    stamp = F.date_format(F.timestamp_seconds(F.unix_seconds(at) + (k % 3 - 1) * 10), "yyyyMMdd'T'HHmmss")
    faults = F.element_at(F.array(*map(F.lit, (" EXDATE:rubbish", " GEO:91;0", " DTEND;TZID=Nowhere/Land:20200101T000000", " RRULE:FREQ=DAILY;INTERVAL=1;COUNT=abc", " DURATION:soon"))), (k / 5 % 5 + 1).cast("int"))
    return _bodies(s, d).withColumn("body", F.concat("body", F.lit(" LAST-MODIFIED:"), stamp, F.lit("Z"), F.when(k % 5 == 0, faults).otherwise("")))


_NUMBER_SQL = "CAST(substr(event_uid, 5) AS BIGINT)"
_FAULT_SQL = "['EXDATE has a member that is no date-time', 'GEO is no place', 'DTEND has an unknown TZID', 'RRULE has a part that says nothing', 'DURATION is none']"
_add("cal_set", _calendars, "SELECT DISTINCT c_mktsegment AS calendar_uid, FALSE AS indexes_active FROM customer UNION SELECT o_orderpriority, TRUE FROM orders")
_add("evt_set_changes", lambda s, d: commands.set_events(orders.events(s, d), _written(s, d)).changes.select("event_uid", "op", "last_modified_ts"), f"SELECT event_uid, 'evt_set' AS op, dtstart_ts + ({_NUMBER_SQL} % 3 - 1) * 10 AS last_modified_ts FROM ev WHERE {_NUMBER_SQL} % 3 > 0 AND {_NUMBER_SQL} % 5 > 0")
_add("evt_set_errors", lambda s, d: commands.set_events(orders.events(s, d), _written(s, d)).errors.select("event_uid", "error"), f"SELECT event_uid, {_FAULT_SQL}[{_NUMBER_SQL} // 5 % 5 + 1] AS error FROM ev WHERE {_NUMBER_SQL} % 5 = 0")
_add("evt_get", lambda s, d: get(orders.events(s, d), event_uid="ORD-5").select("event_uid", "dtstart_ts", "class"), "SELECT event_uid, dtstart_ts, class FROM ev WHERE event_uid = 'ORD-5'")
_add("evo_get", lambda s, d: get(orders.overrides(s, d), calendar_uid=orders.CALENDAR, event_uid="ORD-7").select("event_uid", "occurrence_ts", "duration_s"), "SELECT event_uid, occurrence_ts, duration_s FROM ov WHERE event_uid = 'ORD-7'")


def _newer(s: SparkSession, d: str) -> DataFrame:
    o = orders.overrides(s, d)
    return m.upsert(o, o.filter("duration_s > 1500").withColumn("duration_s", F.col("duration_s") + 60), OCCURRENCE_KEY)


_add("evo_set", lambda s, d: _newer(s, d).select("event_uid", "occurrence_ts", "duration_s"), "SELECT event_uid, occurrence_ts, CASE WHEN duration_s > 1500 THEN duration_s + 60 ELSE duration_s END AS duration_s FROM ov")
_add("evo_delete", lambda s, d: commands.delete_overrides(orders.overrides(s, d), orders.overrides(s, d).filter("geo_overridden")).changes.select("event_uid", "occurrence_ts", "op"), "SELECT event_uid, occurrence_ts, 'evo_del' AS op FROM ov WHERE geo_overridden")
_add("evo_prune_count", lambda s, d: m.counted(orders.overrides(s, d), m.prune_overrides(orders.overrides(s, d), T1, T2), OCCURRENCE_KEY), f"SELECT '{orders.CALENDAR}' AS calendar_uid, count(*) AS removed FROM ov WHERE occurrence_ts BETWEEN {T1} AND {T2}")
_add("evt_prune_changes", lambda s, d: commands.prune_events(orders.events(s, d), T1, T2).changes.select("event_uid", "op"), f"SELECT event_uid, 'evt_prune' AS op FROM ev WHERE dtstart_ts + (n - 1) * step * 86400 + dur BETWEEN {T1} AND {T2}")
_until = lambda days: {"count": F.lit(None), "until_ts": F.col("dtstart_ts") + days * DAY}
_DAYS_SQL = "(SELECT event_uid, dtstart_ts, dtstart_ts + k * 86400 AS occurs, make_timestamp((dtstart_ts + k * 86400) * 1000000) AS t FROM (SELECT *, unnest(range({})) AS k FROM ev))"
_add("rrule_yearly", lambda s, d: _at(occurrences(_with_rule(s, d, freq="YEARLY", interval=F.lit(1), **_until(1500)))), f"SELECT event_uid, occurs AS occurrence_ts FROM {_DAYS_SQL.format(1501)} WHERE month(t) = month(make_timestamp(dtstart_ts * 1000000)) AND day(t) = day(make_timestamp(dtstart_ts * 1000000))")
_add("rrule_hourly_byminute", lambda s, d: _at(occurrences(_with_rule(s, d, freq="HOURLY", interval=F.lit(6), byminute=F.array(F.lit(0), F.lit(30)), **_until(1)))), "SELECT event_uid, dtstart_ts + 21600 * h + 1800 * i AS occurrence_ts FROM ev, (SELECT unnest(range(5)) AS h), (SELECT unnest(range(2)) AS i) WHERE 21600 * h + 1800 * i <= 86400")
_add("rrule_hourly_byhour", lambda s, d: _at(occurrences(_with_rule(s, d, freq="HOURLY", interval=F.lit(1), byhour=F.array(F.lit(9), F.lit(17)), **_until(3)))), "SELECT event_uid, dtstart_ts + 86400 * g + 3600 * h AS occurrence_ts FROM ev, (SELECT unnest(range(3)) AS g), (SELECT unnest([9, 17]) AS h)")
_add("rrule_bysetpos", lambda s, d: _at(occurrences(_with_rule(s, d, freq="MONTHLY", interval=F.lit(1), byday=F.array(*map(F.lit, ("MO", "TU", "WE", "TH", "FR"))), bysetpos=F.array(F.lit(-1)), **_until(100)))), f"SELECT event_uid, occurs AS occurrence_ts FROM {_DAYS_SQL.format(101)} WHERE CAST(t AS DATE) = last_day(t) - CAST(greatest(isodow(last_day(t)) - 5, 0) AS INTEGER)")


def _with_exrule(s: SparkSession, d: str) -> DataFrame:
    e = orders.events(s, d)
    fields = [x.split(":") for x in RULE[7:-1].split(",")]
    other = {"interval": 2 * F.col("rule.interval"), "count": F.lit(None)}
    return e.withColumn("exrule", F.struct(*(other.get(f, F.col(f"rule.{f}")).cast(t).alias(f) for f, t in fields)))


_add("exrule", lambda s, d: _at(occurrences(_with_exrule(s, d))), "SELECT event_uid, occurs AS occurrence_ts FROM occ WHERE k % 2 = 1")


def _lines(df: DataFrame, lines: Column, *key: str) -> DataFrame:
    """Rendered rows; places only by whether they are cleared, since engines write doubles in different ways."""
    return df.select(*key, F.array_join(F.filter(lines, lambda x: (x == "GEO:;") | ~x.startswith("GEO:")), "|").alias("body"))


_TIME_SQL = "strftime(make_timestamp({} * 1000000), '%Y%m%dT%H%M%SZ')"
_PT_SQL = "'DURATION:PT' || CASE WHEN {0} >= 3600 THEN ({0} // 3600) || 'H' ELSE '' END || CASE WHEN {0} % 3600 > 0 THEN ({0} % 3600 // 60) || 'M' ELSE '' END"
_add(
    "evt_render", lambda s, d: _lines(orders.events(s, d), render_event(), "event_uid"),
    f"""SELECT event_uid, array_to_string(list_sort(['UID:' || event_uid, 'LAST-MODIFIED:' || {_TIME_SQL.format('dtstart_ts')}, 'DTSTART:' || {_TIME_SQL.format('dtstart_ts')},
  CASE WHEN has_end THEN 'DTEND:' || {_TIME_SQL.format('(dtstart_ts + dur)')} ELSE {_PT_SQL.format('dur')} END, 'RRULE:COUNT=' || n || ';FREQ=DAILY;INTERVAL=' || step, 'CLASS:' || class, 'RELATED-TO;RELTYPE=PARENT:' || parent,
  'CATEGORIES:' || array_to_string(list_sort(categories), ','), 'LOCATION-TYPE:' || array_to_string(list_sort(location_type), ',')]), '|') AS body FROM ev""",
)
_add(
    "evo_render", lambda s, d: _lines(orders.overrides(s, d), render_override(), "event_uid", "occurrence_ts"),
    f"""SELECT ov.event_uid, occurrence_ts, array_to_string(list_sort(list_filter(['LAST-MODIFIED:' || {_TIME_SQL.format('ev.dtstart_ts')}, 'DTSTART:' || {_TIME_SQL.format('occurrence_ts')}, {_PT_SQL.format('duration_s')},
  'CATEGORIES:' || array_to_string(list_sort(ov.categories), ','), CASE WHEN geo_overridden THEN 'GEO:;' END], lambda x: x IS NOT NULL)), '|') AS body FROM ov JOIN ev ON ev.event_uid = ov.event_uid""",
)
