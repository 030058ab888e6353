"""Keeping the tables: last writer wins, deletion, pruning, what changed, and which terms an event answers to."""

from __future__ import annotations

from functools import reduce
from itertools import dropwhile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import EVENT_KEY, OCCURRENCE_KEY
from .instances import base_duration
from .recurrence import occurrences


def upsert(held: DataFrame, new: DataFrame, key: tuple[str, ...] = EVENT_KEY, stamp: tuple[str, ...] = ("last_modified_ts", "last_modified_ms")) -> DataFrame:
    """held with new rows put in: of rows with one key the one modified last stays, a new one where they tie, and of
    new ones the one that sorts last. One aggregate, so a key with many versions is reduced before the shuffle."""
    rows = held.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    order = [F.col(s) for s in stamp] + [F.col("_new")]
    # Maps can't be compared; what they hold decides ties as text. Rows that tie have their first columns in common, as far
    # as these are keys and stamps, so that the text is in the same order without them.
    told = list(dropwhile(lambda c: c in (*key, *stamp), held.columns)) or held.columns
    value = F.struct(*(c for c in held.columns if c not in key))
    best = rows.groupBy(*key).agg(F.max_by(value, F.struct(*order, F.to_json(F.struct(*told)))).alias("_row"))
    return best.select(*(F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in held.columns))


def create_calendars(held: DataFrame, new: DataFrame) -> DataFrame:
    """Calendars that aren't there yet are added with active indexes; the others stay as they are."""
    return held.unionByName(new.select("calendar_uid", F.lit(True).alias("indexes_active")).distinct().join(held, "calendar_uid", "left_anti"))


def set_indexes(calendars: DataFrame, calendar_uid: str, active: bool) -> DataFrame:
    return calendars.withColumn("indexes_active", F.when(F.col("calendar_uid") == calendar_uid, F.lit(active)).otherwise(F.col("indexes_active")))


def delete(rows: DataFrame, keys: DataFrame, key: tuple[str, ...] = EVENT_KEY) -> DataFrame:
    """rows without those that keys name; overrides go with their event by the event's key."""
    return rows.join(keys.select(*key).distinct(), list(key), "left_anti")


def last_occurrence_between(events: DataFrame, low: int, high: int) -> DataFrame:
    """Keys of events whose last occurrence ends within [low, high]: one ends there and none later, however much later
    that might be."""
    if low > high:
        raise ValueError("the range ends before it begins")
    ends = lambda at: at.join(events.select(*EVENT_KEY, base_duration().alias("_d")), list(EVENT_KEY)).withColumn("_end", F.col("occurrence_ts") + F.col("_d"))
    inside = ends(occurrences(events, until=max(high, high - _shortest(events)), low=F.lit(low) - base_duration())).filter(F.col("_end").between(low, high)).select(*EVENT_KEY).distinct()
    # The first occurrence that would end after the range is enough.
    past = ends(occurrences(events.join(inside, list(EVENT_KEY), "left_semi"), low=F.lit(high + 1) - base_duration(), cap=1)).filter(F.col("_end") > high)
    return inside.join(past.select(*EVENT_KEY).distinct(), list(EVENT_KEY), "left_anti")


def _shortest(events: DataFrame) -> int:
    """The least duration if any is negative, else 0: such events may start after they end."""
    return min(0, events.agg(F.min(base_duration())).first()[0] or 0)


def counted(before: DataFrame, after: DataFrame, key: tuple[str, ...] = EVENT_KEY) -> DataFrame:
    """calendar_uid, removed: how many of a calendar's rows a deletion or pruning took."""
    return before.join(after.select(*key), list(key), "left_anti").groupBy("calendar_uid").agg(F.count("*").alias("removed"))


def save(rows: DataFrame, path: str) -> None:
    """A table of events or overrides as Parquet, in a folder for each calendar, which reading one calendar opens alone."""
    rows.write.mode("overwrite").partitionBy("calendar_uid").parquet(path)


def prune_events(events: DataFrame, low: int, high: int) -> DataFrame:
    return delete(events, last_occurrence_between(events, low, high))


def prune_overrides(overrides: DataFrame, low: int, high: int, event_uid: str | None = None) -> DataFrame:
    """overrides without those of occurrences in [low, high], of one event or of all."""
    gone = F.col("occurrence_ts").between(low, high)
    return overrides.filter(~(gone & (F.col("event_uid") == event_uid)) if event_uid else ~gone)


def diff(old: DataFrame, new: DataFrame, columns: list[str], key: tuple[str, ...] = EVENT_KEY) -> DataFrame:
    """key, status (added, removed, updated or maintained) and, of the array columns, what came and went."""
    side = lambda df, s: df.select(*key, F.lit(True).alias(f"_{s}"), *(F.col(c).alias(f"{s}_{c}") for c in columns))
    both = side(old, "old").join(side(new, "new"), list(key), "full_outer")
    same = reduce(lambda a, b: a & b, (F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in columns))
    status = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(same, "maintained").otherwise("updated")
    arrays = [c for c, t in old.select(*columns).dtypes if t.startswith("array")]
    some = lambda s, c: F.coalesce(f"{s}_{c}", F.array().cast(dict(old.dtypes)[c]))
    return both.select(*key, status.alias("status"), *(x for c in arrays for x in (F.array_except(some("new", c), some("old", c)).alias(f"{c}_added"), F.array_except(some("old", c), some("new", c)).alias(f"{c}_removed"))))


def term_index(events: DataFrame, overrides: DataFrame, column: str) -> DataFrame:
    """event key, term, included, exceptions: the event has the term except at these occurrences (included), or
    lacks it except at these. column is an array of strings."""
    base = events.select(*EVENT_KEY, F.explode(F.array_distinct(column)).alias("term"))
    changed = overrides.filter(F.col(column).isNotNull()).select(*OCCURRENCE_KEY, F.col(column).alias("_over"))
    left = base.join(changed, list(EVENT_KEY)).filter(~F.array_contains("_over", F.col("term"))).select(*OCCURRENCE_KEY, "term")
    gained = changed.select(*OCCURRENCE_KEY, F.explode(F.array_distinct("_over")).alias("term")).join(base, [*EVENT_KEY, "term"], "left_anti")
    rows = base.select(*EVENT_KEY, "term", F.lit(True).alias("included"), F.lit(None).cast("long").alias("occurrence_ts")).unionByName(left.withColumn("included", F.lit(True))).unionByName(gained.withColumn("included", F.lit(False)))
    return rows.groupBy(*EVENT_KEY, "term", "included").agg(F.array_sort(F.collect_set("occurrence_ts")).alias("exceptions"))


def latest_change(changes: DataFrame) -> DataFrame:
    """The last change of each occurrence or event in a change log."""
    order = Window.partitionBy("calendar_uid", "event_uid", "occurrence_ts").orderBy(F.desc("last_modified_ts"), F.desc("op"), F.desc("message"))
    return changes.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")
