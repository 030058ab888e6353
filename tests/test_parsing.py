"""Bodies are read in many tasks, however few files they come from."""

from tidewheel.sources.lines import parse_events


def test_bodies_are_dealt_out_before_they_are_read(spark):
    bodies = [("C", "A", "DTSTART;TZID=Europe/London:20210701T090000 DURATION:PT1H CATEGORIES:B,A"), ("C", "B", "DTSTART:20210101T000000Z GEO:91;0")]
    rows = parse_events(spark.createDataFrame(bodies, "calendar_uid string, event_uid string, body string").coalesce(1))
    assert "Exchange hashpartitioning" in rows._jdf.queryExecution().executedPlan().toString()
    got = {r["event_uid"]: (r["error"], r["dtstart_ts"], r["categories"]) for r in rows.collect()}
    assert got == {"A": (None, 1_625_126_400, ["A", "B"]), "B": ("GEO is no place", 1_609_459_200, None)}
