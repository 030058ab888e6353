"""The change feed: a log of changes, and a stream that applies it with the last writer winning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ical import show_time
from ..model import CHANGES, EVENT_KEY
from ..operators.maintenance import upsert

#: What can happen to a calendar.
OPS = ("cal_set", "cal_del", "cal_idx_disable", "cal_idx_rebuild", "evt_set", "evt_del", "evt_prune", "evo_set", "evo_del", "evo_prune")


def changes(rows: DataFrame, op: str, suffix: Column | None = None) -> DataFrame:
    """A log row for each of rows (calendar_uid, and as far as they have them event_uid, occurrence_ts, ...)."""
    if op not in OPS:
        raise ValueError(f"no such change: {op}")
    of = lambda c, t: F.col(c).cast(t) if c in rows.columns else F.lit(None).cast(t)
    parts = F.concat_ws(":", F.lit(op), of("event_uid", "string"), show_time(of("occurrence_ts", "long")), suffix if suffix is not None else F.lit(None).cast("string"))
    stamp = F.concat(F.lit(" LAST-MODIFIED:"), show_time(of("last_modified_ts", "long"))) if op.endswith("_set") and op != "cal_set" else F.lit("")
    return rows.select("calendar_uid", F.lit(op).alias("op"), of("event_uid", "string").alias("event_uid"), of("occurrence_ts", "long").alias("occurrence_ts"), of("last_modified_ts", "long").alias("last_modified_ts"), F.concat(parts, F.coalesce(stamp, F.lit(""))).alias("message"))


def watch(spark: SparkSession, path: str) -> DataFrame:
    """The log under path as a stream."""
    return spark.readStream.schema(CHANGES).parquet(path)


def apply_stream(rows: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame], None], checkpoint: str, key: tuple[str, ...] = EVENT_KEY) -> StreamingQuery:
    """Upserts each micro-batch of a stream of event or override rows into a table. A batch that runs again, after a
    failure, leaves the same table: the last writer wins whichever comes twice."""

    def batch(new: DataFrame, _: int) -> None:
        write(upsert(read(), new, key))

    return rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
