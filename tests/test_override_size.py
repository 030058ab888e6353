"""Overrides of many lines: what a task holds doesn't grow with the table."""

import datetime as dt
import json

from pyspark.sql import functions as F

from tidewheel.model import OCCURRENCE_KEY, OVERRIDES
from tidewheel.operators import maintenance as m
from tidewheel.sources import orders

AT = 1_611_997_800


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overrides_of_lines_are_hashed_in_tasks_by_their_number(spark, tmp_path, monkeypatch):
    lines = [(k, 1 + k % 3, float(q), f, s) for k in range(1, 41) for q, f, s in ((5, "S", "F"), (9, ("A", "R", "N", None)[k % 4], ("O", "P", None)[k % 3]))] + [(41, 1, 3.0, None, None), (42, 1, 3.0, "R", "O")]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, dt.datetime(1995, 1, 1)) for k in range(1, 43)], "o_orderkey long, o_orderdate timestamp_ntz").write.parquet(f"{tmp_path}/orders.parquet")
    monkeypatch.setattr(orders, "LINES_EACH", 6)
    o = orders.overrides(spark, str(tmp_path))
    plan = _plan(o)
    assert "SortAggregate" not in plan and "hashpartitioning(l_orderkey" in plan and ", 14), REPARTITION_BY_NUM" in plan and "BroadcastHashJoin" not in plan
    got = {r["event_uid"]: (r["duration_s"], r["categories"], r["geo_overridden"]) for r in o.collect()}
    want = {}
    for k in range(1, 43):
        own = [x for x in lines if x[0] == k]
        flags, states = [x[3] for x in own if x[3]], [x[4] for x in own if x[4]]
        want[f"ORD-{k}"] = (int(max(x[2] for x in own)) * 60, ["RF_R"] if flags and min(flags) == "R" else None, max(states) == "O" if states else None)
    assert got == want


def test_ties_of_versions_are_told_apart_without_their_keys(spark):
    rows = [{"calendar_uid": "C", "event_uid": f"E{k % 5}", "occurrence_ts": AT, "last_modified_ts": 1, "last_modified_ms": 0, "geo_overridden": False} | x for k, x in enumerate(({"duration_s": 90}, {"duration_s": 100}, {"class": "X"}, {}, {"categories": ["B"]}) * 2 + ({"class": "A"}, {"categories": ["A"]}, {"duration_s": 7, "class": "Z"}, {}, {}))]
    o = spark.createDataFrame(rows, OVERRIDES)
    out = m.upsert(o.limit(0), o, OCCURRENCE_KEY)
    assert "to_json(struct(calendar_uid" not in _plan(out).replace("to_json(named_struct(calendar_uid", "to_json(struct(calendar_uid")
    assert out.columns == o.columns
    text = {}
    for r in o.withColumn("t", F.to_json(F.struct(*o.columns))).collect():
        text[r["event_uid"]] = max(text.get(r["event_uid"], ""), r["t"])
    assert {r["event_uid"]: json.loads(r["t"]) for r in out.withColumn("t", F.to_json(F.struct(*out.columns))).collect()} == {k: json.loads(t) for k, t in text.items()}
