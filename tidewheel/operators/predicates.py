"""What a query can ask of an event or an instance, as null-safe columns.

Each function gives true or false and never null, so that its negation holds for rows without a value. They are
combined with &, | and ~; `either` and `each` take several.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import geo as g


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def each(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def either(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions) if conditions else F.lit(False)


def uid_in(*uids: str) -> Column:
    return _sure(F.col("event_uid").isin(*uids))


def has_categories(*names: str, any_of: bool = False) -> Column:
    return _holds("categories", names, any_of)


def has_location_types(*names: str, any_of: bool = False) -> Column:
    return _holds("location_type", names, any_of)


def _holds(column: str, names: tuple[str, ...], any_of: bool) -> Column:
    return (either if any_of else each)(*(_sure(F.array_contains(column, n)) for n in names))


def is_class(*names: str, any_of: bool = False) -> Column:
    """Of two different classes at once there is none."""
    return (either if any_of else each)(*(_sure(F.col("class") == n) for n in names))


def related_to(*uids: str, reltype: str = "PARENT", any_of: bool = False) -> Column:
    return (either if any_of else each)(*(_sure(F.array_contains("related_to", F.struct(F.lit(reltype).alias("reltype"), F.lit(u).alias("uid")))) for u in uids))


def within(lat: float, long: float, distance: float = 10, unit: str = "KM") -> Column:
    """At most so far from a point. The bounds in front are simple enough for the file scan."""
    km = g.km_of(distance, unit)
    here = (F.col("geo.lat"), F.col("geo.long"))
    return _sure(g.box(*here, lat, long, km) & (g.haversine_km(*here, lat, long) <= km))


def starts(op: str, ts: int) -> Column:
    return _compared("dtstart_ts", op, ts)


def ends(op: str, ts: int) -> Column:
    return _compared("dtend_ts", op, ts)


def _compared(column: str, op: str, ts: int) -> Column:
    c = F.col(column)
    return _sure({"GT": c > ts, "GTE": c >= ts, "LT": c < ts, "LTE": c <= ts}[op])
