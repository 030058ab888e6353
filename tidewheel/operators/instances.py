"""Instances: occurrences with their overrides applied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EVENT_KEY
from .recurrence import _Kinds, carried

#: An override's value replaces the event's unless it is null.
REPLACED = ("categories", "location_type", "class", "related_to")


def base_duration() -> Column:
    """DURATION, else DTEND - DTSTART, else none."""
    return F.coalesce("duration_s", F.col("dtend_ts") - F.col("dtstart_ts"), F.lit(0)).cast("long")


def merged_passive(own: Column, over: Column) -> Column:
    """By property name: an override's lines replace the event's of that name."""
    empty = F.from_json(F.lit("{}"), "map<string,array<string>>")
    over = F.coalesce(over, empty)
    return F.map_concat(F.map_filter(F.coalesce(own, empty), lambda k, _: ~F.map_contains_key(over, k)), over)


def instances(events: DataFrame, overrides: DataFrame, until: int | None = None, low: int | None = None, cap: int | None = None, kinds: _Kinds | None = None) -> DataFrame:
    """Per occurrence: its key, dtstart_ts, dtend_ts, duration_s, recurrence_id_ts, has_override and the properties
    that hold for it. An override changes the occurrence that it names and never moves it; one that names no
    occurrence changes nothing. Those that start before low are left out. kinds: as for `carried`."""
    kept = [*EVENT_KEY, base_duration().alias("_duration"), *REPLACED, "geo", "passive"]
    rules = ("dtstart_ts", "tzid", "rule", "exrule", "rdates", "exdates")
    over = overrides.select(*EVENT_KEY, "occurrence_ts", F.col("duration_s").alias("_o_duration"), *(F.col(c).alias(f"_o_{c}") for c in (*REPLACED, "geo", "passive")), "geo_overridden", F.lit(True).alias("has_override"))
    if until is None and low is None:
        # Every occurrence meets the overrides: events are dealt out by their key once, before they are many rows.
        at, whole = carried(events.select(*kept, *rules).repartition(*EVENT_KEY), until, low, cap, kinds)
        over = over.repartition(*EVENT_KEY) if whole else over
    else:
        at, whole = carried(events.select(*kept, *rules), until, low, cap, kinds)
    if not whole:
        # Found by joins or windows, occurrences carry only their key; the event's properties join after.
        at = at.join(events.select(*kept), list(EVENT_KEY))
    if low is not None:
        at, over = (x.filter(F.col("occurrence_ts") >= low) for x in (at, over))
    if until is not None:
        over = over.filter(F.col("occurrence_ts") <= until)
    out = at.join(over, [*EVENT_KEY, "occurrence_ts"], "left")
    duration = F.coalesce("_o_duration", "_duration")
    return out.select(
        *EVENT_KEY, F.col("occurrence_ts").alias("dtstart_ts"), (F.col("occurrence_ts") + duration).alias("dtend_ts"), duration.alias("duration_s"),
        F.col("occurrence_ts").alias("recurrence_id_ts"), F.coalesce("has_override", F.lit(False)).alias("has_override"),
        *(F.coalesce(f"_o_{c}", c).alias(c) for c in REPLACED), F.when(F.coalesce("geo_overridden", F.lit(False)), F.col("_o_geo")).otherwise(F.col("geo")).alias("geo"),
        merged_passive(F.col("passive"), F.col("_o_passive")).alias("passive"),
    )
