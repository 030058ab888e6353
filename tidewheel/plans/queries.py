"""Queries over instances and over events: filter, order, de-duplicate, page, render.

A query is plain data; conditions are the columns of operators.predicates. Bounds are handed to the generator of
occurrences, where a filter above it could not stop it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as g
from ..functions.ical import show_time
from ..model import EVENT_KEY, OCCURRENCE_KEY, PAGE
from ..operators.instances import base_duration, instances
from ..operators.predicates import _compared
from ..operators.recurrence import occurrences, survey

BY_START, BY_START_THEN_DISTANCE, BY_DISTANCE_THEN_START = "DTSTART", "DTSTART-GEO-DIST", "GEO-DIST-DTSTART"
#: Groups in groups, at most.
DEPTH = 32


@dataclass(frozen=True)
class Bound:
    """op is GT or GTE for a lower bound, LT or LTE for an upper one; on is DTSTART or DTEND."""

    ts: int
    op: str
    on: str = "DTSTART"

    def __post_init__(self) -> None:
        if self.op not in ("GT", "GTE", "LT", "LTE") or self.on not in ("DTSTART", "DTEND"):
            raise ValueError(f"no such bound: {self}")


@dataclass(frozen=True)
class Query:
    where: Column | None = None
    after: Bound | None = None
    before: Bound | None = None
    order: str = BY_START
    #: (lat, long) that distances are taken from.
    place: tuple[float, float] | None = None
    distinct: bool = False
    offset: int = 0
    #: None: every row.
    limit: int | None = PAGE
    tzid: str = "UTC"
    #: Whether DTEND of an event that only has a DURATION is taken from it (events only).
    end_from_duration: bool = False
    bounds: tuple[Bound, ...] = field(init=False)

    def __post_init__(self) -> None:
        if self.order not in (BY_START, BY_START_THEN_DISTANCE, BY_DISTANCE_THEN_START):
            raise ValueError(f"no such order: {self.order}")
        if self.order != BY_START and self.place is None:
            raise ValueError("an order by distance needs a place")
        if self.offset < 0 or (self.limit is not None and self.limit < 0):
            raise ValueError("offset and limit can't be negative")
        object.__setattr__(self, "bounds", tuple(b for b in (self.after, self.before) if b))


def group(items: list) -> Column | None:
    """[a, "AND", b, "OR", c]: from left to right, both operators alike; a missing one is AND, one before the first
    item is ignored, a list inside is a group, and an empty group says nothing."""
    return _group(items, 1)


def _group(items: list, depth: int) -> Column | None:
    if depth > DEPTH:
        raise ValueError(f"groups are nested more than {DEPTH} deep")
    out, op = None, "AND"
    for x in items:
        if isinstance(x, str):
            if x not in ("AND", "OR"):
                raise ValueError(f"no such operator: {x}")
            op = x
            continue
        c = _group(x, depth + 1) if isinstance(x, list) else x
        if c is not None:
            out = c if out is None else (out & c if op == "AND" else out | c)
        op = "AND"
    return out


def require_active(calendars: DataFrame, calendar_uid: str) -> None:
    row = calendars.filter(F.col("calendar_uid") == calendar_uid).select("indexes_active").first()
    if row is None:
        raise LookupError(f"no calendar {calendar_uid}")
    if not row[0]:
        raise RuntimeError(f"queries of calendar {calendar_uid} are disabled")


def _page_end(q: Query) -> int | None:
    return None if q.limit is None else q.offset + q.limit


def _distance(q: Query) -> Column:
    return g.micro_km(g.haversine_km(F.col("geo.lat"), F.col("geo.long"), *q.place)) if q.place else F.lit(None).cast("long")


def _keys(q: Query) -> list[Column]:
    """Without a place an instance comes first by start and distance, and not at all by distance and start."""
    near = F.col("dist_micro").asc_nulls_first()
    return {BY_START: [F.col("dtstart_ts").asc()], BY_START_THEN_DISTANCE: [F.col("dtstart_ts").asc(), near], BY_DISTANCE_THEN_START: [near, F.col("dtstart_ts").asc()]}[q.order]


def _paged(rows: DataFrame, q: Query, cut_order: list[Column], order: list[Column]) -> DataFrame:
    if q.limit is None and not q.offset:
        return rows
    rows = rows.orderBy(*cut_order).offset(q.offset)
    return (rows.limit(q.limit) if q.limit is not None else rows).orderBy(*order)


def query_instances(events: DataFrame, overrides: DataFrame, q: Query, horizon: int | None = None) -> DataFrame:
    """Instances that match, with dist_micro, in the query's order where it pages.

    Events are dropped before they are expanded where neither they nor an override of theirs can match, unless expanding
    all is less work than finding these. horizon: the upper end for rules that nothing else ends."""
    until = min((t for t in (q.before.ts if q.before else None, horizon) if t is not None), default=None)
    low = q.after.ts if q.after and q.after.on == "DTSTART" else None
    kinds = survey(events, until, None) if q.where is not None else None
    if kinds and not kinds.light:
        # Conditions only read the properties that events and overrides have in common, by the same names.
        fits = events.withColumn("_fits", F.lit(True)).filter(q.where).select(*EVENT_KEY)
        changed = overrides.select(*EVENT_KEY).distinct()
        events, kinds = events.join(fits.unionByName(changed).distinct(), list(EVENT_KEY), "left_semi"), None
    end = _page_end(q)
    if until is not None or end is None or kinds or _is_short(events):
        rows = _matching(instances(events, overrides, until, low, kinds=kinds), q)
    else:
        if low is None and q.after is not None:
            # By end: an occurrence may start earlier by its duration.
            longest = [df.agg(F.max(c)).first()[0] or 0 for df, c in ((events, base_duration()), (overrides, F.col("duration_s")))]
            low = q.after.ts - max(longest)
        last = _page_last(events, overrides, q, low, end)
        rows = _matching(_capped(events, overrides, low, end) if last is None else instances(events, overrides, last, low), q)
    rows = rows.withColumn("dist_micro", _distance(q))
    if q.order == BY_DISTANCE_THEN_START:
        rows = rows.filter("geo is not null")
    keys = _keys(q)
    if q.distinct:
        first = Window.partitionBy(*EVENT_KEY).orderBy(*keys)
        rows = rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")
    cut = [keys[0], F.col("dtend_ts").asc(), F.col("event_uid").asc()] if q.order == BY_START else [*keys, F.col("event_uid").asc()]
    return _paged(rows, q, cut, [*keys, F.col("event_uid").asc(), F.col("dtstart_ts").asc()])


#: Occurrences of a rule up to which a page expands the whole of it.
SHORT = 1000


def _is_short(events: DataFrame) -> bool:
    """Whether every rule is counted and soon over, so that expanding all is less work than finding each event's share of a page."""
    r = F.col("rule")
    return events.filter(r.isNotNull() & F.coalesce(r["count"] > SHORT, F.lit(True))).isEmpty()


def _matching(rows: DataFrame, q: Query) -> DataFrame:
    for b in q.bounds:
        rows = rows.filter(_compared("dtstart_ts" if b.on == "DTSTART" else "dtend_ts", b.op, b.ts))
    return rows if q.where is None else rows.filter(q.where)


#: Occurrences an event that a page's last start is looked for among, one try after the other.
TRIES = (1, 8)


def _page_last(events: DataFrame, overrides: DataFrame, q: Query, low: int | None, page_end: int) -> int | None:
    """A time that no row of the page starts after, or null: some rows that match fill the page up to it. Where the
    order begins with the start, nothing after it matters, and events needn't be followed for a page's length each."""
    if q.order == BY_DISTANCE_THEN_START or not page_end:
        return None
    plain = q.where is None and not any(b.on == "DTEND" for b in q.bounds)
    for cap in TRIES:
        # Overrides move no start, so that they count only where a condition reads what they change.
        some = occurrences(events, low=low, cap=cap).withColumnRenamed("occurrence_ts", "dtstart_ts") if plain else instances(events, overrides, low=low, cap=cap)
        starts = _matching(some, q).select(*EVENT_KEY, "dtstart_ts")
        if q.distinct:
            starts = starts.groupBy(*EVENT_KEY).agg(F.min("dtstart_ts").alias("dtstart_ts"))
        n, last = starts.select("dtstart_ts").orderBy("dtstart_ts").limit(page_end).agg(F.count("*"), F.max("dtstart_ts")).first()
        if n == page_end:
            return last
    return None


def _capped(events: DataFrame, overrides: DataFrame, low: int | None, page_end: int) -> DataFrame:
    """The instances that can matter to a page when nothing bounds the rules. An event fills the page alone with the
    occurrences at or after the lower bound that no override changes; and any overridden occurrence may match."""
    per = overrides.groupBy(*EVENT_KEY).agg(F.count("*").alias("n"), F.max("occurrence_ts").alias("last"))
    most = per.agg(F.max("n"), F.max("last")).first()
    rows = instances(events, overrides, low=low, cap=page_end + (most[0] or 0))
    if most[1] is None:
        return rows
    changed = events.join(per.select(*EVENT_KEY), list(EVENT_KEY), "left_semi")
    late = instances(changed, overrides, until=most[1]).filter("has_override")
    key = [*EVENT_KEY, "dtstart_ts"]
    return rows.unionByName(late.join(rows.select(*key), key, "left_anti"))


def query_events(events: DataFrame, q: Query) -> DataFrame:
    """Base events that match, overrides aside, with dist_micro. A bound on DTEND looks at DTEND alone unless the
    query says otherwise."""
    end = F.coalesce("dtend_ts", F.col("dtstart_ts") + F.col("duration_s")) if q.end_from_duration else F.col("dtend_ts")
    rows = events.withColumn("_end", end)
    for b in q.bounds:
        rows = rows.filter(_compared("dtstart_ts" if b.on == "DTSTART" else "_end", b.op, b.ts))
    rows = rows.drop("_end")
    if q.where is not None:
        rows = rows.filter(q.where)
    rows = rows.withColumn("dist_micro", _distance(q))
    if q.order == BY_DISTANCE_THEN_START:
        rows = rows.filter("geo is not null")
    keys = [*_keys(q), F.col("event_uid").asc()]
    return _paged(rows, q, keys, keys)


def list_events(events: DataFrame, calendar_uid: str, offset: int = 0, count: int = PAGE) -> DataFrame:
    return events.filter(F.col("calendar_uid") == calendar_uid).orderBy("event_uid").offset(offset).limit(count)


def list_instances(events: DataFrame, overrides: DataFrame, calendar_uid: str, event_uid: str, offset: int = 0, count: int = PAGE) -> DataFrame:
    one = (F.col("calendar_uid") == calendar_uid) & (F.col("event_uid") == event_uid)
    return instances(events.filter(one), overrides.filter(one), cap=offset + count).orderBy("dtstart_ts").offset(offset).limit(count)


def list_overrides(overrides: DataFrame, calendar_uid: str, event_uid: str, offset: int = 0, count: int = PAGE) -> DataFrame:
    return overrides.filter((F.col("calendar_uid") == calendar_uid) & (F.col("event_uid") == event_uid)).orderBy("occurrence_ts").offset(offset).limit(count)


def get(rows: DataFrame, **key: str | int) -> DataFrame:
    """The row of a key, or none."""
    for c, v in key.items():
        if c not in OCCURRENCE_KEY:
            raise ValueError(f"{c} is no part of a key")
        rows = rows.filter(F.col(c) == v)
    return rows


def rendered(rows: DataFrame, tzid: str = "UTC") -> DataFrame:
    """DTSTART and DTEND as text in a zone."""
    return rows.withColumns({"dtstart": show_time(F.col("dtstart_ts"), tzid), "dtend": show_time(F.col("dtend_ts"), tzid)})

