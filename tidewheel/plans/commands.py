"""What changes a calendar, as one step each: validate, keep the last writer's rows, and tell what changed.

Tables go in and come out as DataFrames; where they are stored is the caller's matter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import EVENT_KEY, OCCURRENCE_KEY
from ..operators import maintenance as m
from ..sources.lines import parse_events, parse_overrides
from ..streaming.changes import changes


@dataclass(frozen=True)
class Outcome:
    """The table afterwards, its rows of the change feed, and what was wrong with what came in."""

    rows: DataFrame
    changes: DataFrame
    errors: DataFrame | None = None


def _won(held: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Of new rows those that stay: the last of each key, unless a held one was modified later."""
    stamp = F.struct("last_modified_ts", "last_modified_ms")
    last = m.upsert(held.limit(0), new, key)
    return last.join(held.select(*key, stamp.alias("_held")), list(key), "left").filter(F.col("_held").isNull() | (stamp >= F.col("_held"))).drop("_held")


def _set(held: DataFrame, parsed: DataFrame, key: tuple[str, ...], op: str) -> Outcome:
    new = parsed.filter("error is null").select(*held.columns)
    return Outcome(m.upsert(held, new, key), changes(_won(held, new, key), op), parsed.filter("error is not null").select(*key, "error"))


def set_events(held: DataFrame, bodies: DataFrame) -> Outcome:
    """Events from bodies (calendar_uid, event_uid, body); their overrides, a table of their own, stay."""
    return _set(held, parse_events(bodies), EVENT_KEY, "evt_set")


def set_overrides(held: DataFrame, bodies: DataFrame) -> Outcome:
    """Overrides from bodies (calendar_uid, event_uid, occurrence, body)."""
    return _set(held, parse_overrides(bodies), OCCURRENCE_KEY, "evo_set")


def set_calendars(held: DataFrame, new: DataFrame) -> Outcome:
    rows = m.create_calendars(held, new)
    return Outcome(rows, changes(rows.join(held, "calendar_uid", "left_anti"), "cal_set"))


def delete_calendars(held: DataFrame, keys: DataFrame) -> Outcome:
    return _without(held, keys, ("calendar_uid",), "cal_del")


def set_indexes(held: DataFrame, calendar_uid: str, active: bool) -> Outcome:
    """A change is told where there is one."""
    changed = held.filter((F.col("calendar_uid") == calendar_uid) & (F.col("indexes_active") != active))
    return Outcome(m.set_indexes(held, calendar_uid, active), changes(changed, "cal_idx_rebuild" if active else "cal_idx_disable"))


def delete_events(held: DataFrame, keys: DataFrame) -> Outcome:
    return _without(held, keys, EVENT_KEY, "evt_del")


def delete_overrides(held: DataFrame, keys: DataFrame) -> Outcome:
    return _without(held, keys, OCCURRENCE_KEY, "evo_del")


def prune_events(held: DataFrame, low: int, high: int) -> Outcome:
    return _without(held, m.last_occurrence_between(held, low, high), EVENT_KEY, "evt_prune", _range(low, high))


def prune_overrides(held: DataFrame, low: int, high: int, event_uid: str | None = None) -> Outcome:
    rows = m.prune_overrides(held, low, high, event_uid)
    return Outcome(rows, changes(held.join(rows.select(*OCCURRENCE_KEY), list(OCCURRENCE_KEY), "left_anti"), "evo_prune", _range(low, high)))


def _range(low: int, high: int) -> Column:
    return F.lit(f"{low}-{high}")


def _without(held: DataFrame, keys: DataFrame, key: tuple[str, ...], op: str, suffix: Column | None = None) -> Outcome:
    gone = held.join(keys.select(*key).distinct(), list(key), "left_semi")
    return Outcome(m.delete(held, keys, key), changes(gone, op, suffix))
