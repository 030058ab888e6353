"""Conditions on events with few occurrences need no search for those that can match."""

import pytest

from tidewheel.model import EVENTS, OVERRIDES
from tidewheel.operators import predicates as p
from tidewheel.operators import recurrence
from tidewheel.plans.queries import Query, query_instances

AT = 1_611_997_800
DAY = 86_400


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _event(uid, cls, **rule):
    return {"calendar_uid": "C", "event_uid": uid, "dtstart_ts": AT, "tzid": "UTC", "class": cls, "duration_s": 60} | ({"rule": {"freq": "DAILY", "interval": 1, "wkst": "MO"} | rule} if rule else {})


def _shown(df):
    return sorted((r["event_uid"], r["dtstart_ts"], r["class"], r["has_override"]) for r in df.collect())


def test_conditions_on_events_with_few_occurrences_need_no_search_for_them(spark, monkeypatch):
    e = spark.createDataFrame([_event("A", "PUBLIC", count=3), _event("B", "PRIVATE", count=4), _event("C", "PRIVATE", count=2), _event("D", "PUBLIC")], EVENTS)
    o = spark.createDataFrame([{"calendar_uid": "C", "event_uid": k, "occurrence_ts": AT + d * DAY, "class": c, "duration_s": 5, "geo_overridden": False} for k, d, c in (("A", 1, "PRIVATE"), ("B", 2, "PUBLIC"), ("D", 7, "PRIVATE"))], OVERRIDES)
    q = Query(where=p.is_class("PUBLIC"), limit=None)
    rows = query_instances(e, o, q)
    assert "LeftSemi" not in _plan(rows)
    want = [("A", AT, "PUBLIC", False), ("A", AT + 2 * DAY, "PUBLIC", False), ("B", AT + 2 * DAY, "PUBLIC", True), ("D", AT, "PUBLIC", False)]
    assert _shown(rows) == want
    assert _shown(query_instances(e, o, Query(where=p.is_class("PUBLIC")))) == want
    monkeypatch.setattr(recurrence, "LIGHT", 0)
    searched = query_instances(e, o, q)
    assert "LeftSemi" in _plan(searched) and _shown(searched) == want


def test_other_events_are_searched_first(spark):
    none = spark.createDataFrame([], OVERRIDES)
    public = Query(where=p.is_class("PUBLIC"), limit=None)
    # An endless rule that can't match needs no end; one that is counted may be long.
    for other in (_event("B", "PRIVATE", interval=2), _event("B", "PRIVATE", count=1_000_000), _event("B", "PRIVATE", count=2, byday=["MO"])):
        rows = query_instances(spark.createDataFrame([_event("A", "PUBLIC", count=2), other], EVENTS), none, public)
        assert "LeftSemi" in _plan(rows) and [r[:2] for r in _shown(rows)] == [("A", AT), ("A", AT + DAY)]
    with pytest.raises(ValueError):
        query_instances(spark.createDataFrame([_event("A", "PUBLIC", interval=2)], EVENTS), none, public)
