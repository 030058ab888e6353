"""Pages of endless rules: work by what the page shows."""

import pytest
from pyspark.sql import functions as F

from tidewheel.model import EVENTS, OVERRIDES
from tidewheel.plans import queries as pages
from tidewheel.plans.queries import Bound, Query, query_instances

AT = 1_611_997_800


def test_a_page_of_endless_rules_follows_each_to_its_last_start_only(spark, monkeypatch):
    rows = [{"calendar_uid": "C", "event_uid": f"E{k:03}", "dtstart_ts": AT + k * 3600, "tzid": "UTC", "rule": {"freq": "DAILY", "interval": 1 + k % 3, "wkst": "MO"}, "class": "PUBLIC" if k % 2 else "PRIVATE", "duration_s": 60} for k in range(70)]
    e = spark.createDataFrame(rows, EVENTS)
    low = AT + 10 * 86_400
    o = spark.createDataFrame([{"calendar_uid": "C", "event_uid": "E001", "occurrence_ts": AT + 3600 + 10 * 86_400, "class": "PRIVATE", "duration_s": 120, "geo_overridden": False}], OVERRIDES)
    shown = lambda df: [(r["event_uid"], r["dtstart_ts"], r["dtend_ts"], r["has_override"]) for r in df.collect()]
    queries = [Query(after=Bound(low, "GTE"), limit=20, offset=5), Query(after=Bound(low, "GTE"), where=F.col("class") == "PUBLIC", limit=25), Query(after=Bound(low, "GTE"), distinct=True, limit=15, offset=3)]
    want = [shown(query_instances(e, o, q, horizon=low + 60 * 86_400)) for q in queries]
    # The way that takes a whole page of each event isn't needed.
    monkeypatch.setattr(pages, "_capped", lambda *a: pytest.fail("every event was followed for a page's length"))
    assert [shown(query_instances(e, o, q)) for q in queries] == want and all(len(x) == q.limit for x, q in zip(want, queries, strict=True))
