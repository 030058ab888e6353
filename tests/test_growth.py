"""Work that must not grow faster than its input: no copies, sorts or shuffles of expanded rows where none are needed."""

import calendar
import datetime as dt

from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

from tidewheel.model import EVENTS
from tidewheel.operators.recurrence import occurrences

START = dt.datetime(2021, 1, 30, 9, 10)
AT = calendar.timegm(START.timetuple())
UNTIL = AT + 900 * 86_400
WEEKDAYS = ["MO", "TU", "WE", "TH", "FR"]
#: By name: a rule's parts and its text.
RULES = {
    "yearly": ({"freq": "YEARLY"}, "FREQ=YEARLY"),
    "monthly": ({"freq": "MONTHLY"}, "FREQ=MONTHLY"),
    "clock": ({"freq": "MONTHLY", "interval": 3, "byhour": [8, 17]}, "FREQ=MONTHLY;INTERVAL=3;BYHOUR=8,17"),
    "last": ({"freq": "MONTHLY", "byday": WEEKDAYS, "bysetpos": [-1]}, "FREQ=MONTHLY;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1"),
    "places": ({"freq": "MONTHLY", "interval": 2, "byday": ["SU", "WE"], "byhour": [7, 21], "bysetpos": [1, -2, 30]}, "FREQ=MONTHLY;INTERVAL=2;BYDAY=SU,WE;BYHOUR=7,21;BYSETPOS=1,-2,30"),
    "all": ({"freq": "MONTHLY", "byday": ["TU"]}, "FREQ=MONTHLY;BYDAY=TU"),
    "weekly": ({"freq": "WEEKLY", "interval": 2, "byday": ["MO", "SA"], "byhour": [9, 12], "wkst": "SU"}, "FREQ=WEEKLY;INTERVAL=2;BYDAY=MO,SA;BYHOUR=9,12;WKST=SU"),
    "daily": ({"freq": "DAILY", "interval": 5, "byhour": [3, 20]}, "FREQ=DAILY;INTERVAL=5;BYHOUR=3,20"),
    "hourly": ({"freq": "HOURLY", "interval": 7, "byhour": [9, 17], "byminute": [5, 40]}, "FREQ=HOURLY;INTERVAL=7;BYHOUR=9,17;BYMINUTE=5,40"),
}


def _events(spark, **ends):
    rows = [{"calendar_uid": "C", "event_uid": k, "dtstart_ts": AT, "tzid": "UTC", "rule": {"interval": 1, "wkst": "MO"} | r | ends} for k, (r, _) in RULES.items()]
    return spark.createDataFrame(rows, EVENTS)


def _want(name, tail):
    return [calendar.timegm(x.timetuple()) for x in rrulestr(RULES[name][1] + tail, dtstart=START)]


def _got(rows, column="occurrence_ts"):
    got = {}
    for r in rows.select("event_uid", column).collect():
        got.setdefault(r[0], []).append(r[1])
    return {k: sorted(v) for k, v in got.items()}


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rules_that_end_by_time_are_neither_dealt_out_nor_sorted(spark):
    rows = occurrences(_events(spark, until_ts=UNTIL))
    assert "Window" not in _plan(rows) and "Exchange" not in _plan(rows)
    tail = f";UNTIL={dt.datetime.fromtimestamp(UNTIL, dt.UTC):%Y%m%dT%H%M%S}"
    assert _got(rows) == {k: _want(k, tail) for k in RULES}
    low = AT + 400 * 86_400
    late = _got(occurrences(_events(spark, until_ts=UNTIL), low=low).filter(F.col("occurrence_ts") >= low))
    assert late == {k: [t for t in _want(k, tail) if t >= low] for k in RULES}


def test_counted_weekly_rules_are_arithmetic(spark):
    rows = occurrences(_events(spark, count=7).filter("event_uid in ('weekly', 'daily')"))
    assert "Window" not in _plan(rows) and "Exchange" not in _plan(rows)
    assert _got(rows) == {k: _want(k, ";COUNT=7") for k in ("weekly", "daily")}


def test_other_counted_rules_have_their_count(spark):
    assert _got(occurrences(_events(spark, count=7))) == {k: _want(k, ";COUNT=7") for k in RULES}
    # So many of those at or after a time.
    low = AT + 100 * 86_400
    made = _got(occurrences(_events(spark).filter("event_uid in ('weekly', 'daily')"), low=low, cap=5))
    for k, v in made.items():
        assert [t for t in v if t >= low][:5] == [t for t in _want(k, ";COUNT=200") if t >= low][:5]
