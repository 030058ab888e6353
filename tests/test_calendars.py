"""The order of a calendar's life: lines in, occurrences, queries, pruning, changes."""

import calendar
import datetime as dt
import random

import pytest
from dateutil.rrule import rrulestr
from pyspark.sql import functions as F

from tidewheel.functions import geo, ical
from tidewheel.model import CALENDARS, CHANGES, EVENTS, OVERRIDES
from tidewheel.operators import maintenance as m
from tidewheel.operators import predicates as p
from tidewheel.operators.instances import instances
from tidewheel.operators.lineage import cut
from tidewheel.operators.recurrence import occurrences
from tidewheel.plans.queries import BY_DISTANCE_THEN_START, BY_START_THEN_DISTANCE, Bound, Query, group, list_instances, query_events, query_instances, rendered, require_active
from tidewheel.sources.lines import parse_events, parse_overrides, render_calendar, render_event, render_instance, render_override
from tidewheel.streaming.changes import apply_stream, changes, watch

OXFORD, CHELTENHAM, BRISTOL, READING, LONDON = (
    (51.751365550307604, -1.2601196837753945), (51.89936851432488, -2.078357552295971), (51.454481838260214, -2.588329192623361), (51.45442303961853, -0.9792277140273513), (51.50740017561507, -0.12698231869919185),
)
#: uid, start, end, rule, categories, place
EVENTS_IN = [
    ("ONLINE_EVENT_MON_WED", "20201231T160000Z", "20201231T170000Z", "BYDAY=MO,WE;FREQ=WEEKLY;INTERVAL=1;UNTIL=20211231T170000Z", "CATEGORY_ONE,CATEGORY TWO", None),
    ("EVENT_IN_OXFORD_MON_WED", "20201231T170000Z", "20201231T173000Z", "BYDAY=MO,WE;COUNT=3;FREQ=WEEKLY;INTERVAL=1", "CATEGORY_ONE,CATEGORY TWO", OXFORD),
    ("EVENT_IN_CHELTENHAM_TUE_THU", "20201231T183000Z", "20201231T190000Z", "BYDAY=TH,TU;COUNT=3;FREQ=WEEKLY;INTERVAL=1", "CATEGORY_FOUR,CATEGORY_ONE", CHELTENHAM),
    ("OVERRIDDEN_EVENT_IN_BRISTOL_TUE_THU", "20201231T183000Z", "20201231T190000Z", "BYDAY=TH,TU;COUNT=3;FREQ=WEEKLY;INTERVAL=1", "CATEGORY_FOUR,CATEGORY_ONE", BRISTOL),
    ("EVENT_IN_READING_TUE_THU", "20201231T180000Z", "20201231T183000Z", "BYDAY=TH,TU;COUNT=3;FREQ=WEEKLY;INTERVAL=1", "CATEGORY_ONE,CATEGORY_THREE", READING),
    ("EVENT_IN_LONDON_TUE_THU", "20201231T183000Z", "20201231T190000Z", "BYDAY=TH,TU;COUNT=3;FREQ=WEEKLY;INTERVAL=1", "CATEGORY_FOUR,CATEGORY_ONE", LONDON),
]
OVERRIDES_IN = [
    ("20210105T183000Z", "SUMMARY:Changed RELATED-TO;RELTYPE=PARENT:PARENT_UID_OVERRIDE CATEGORIES:CATEGORY_OVERRIDE GEO:;"),
    ("20210107T183000Z", f"SUMMARY:Moved GEO:{CHELTENHAM[0]};{CHELTENHAM[1]}"),
    ("20210108T183000Z", "SUMMARY:Detached"),
]


def ts(text):
    return calendar.timegm(dt.datetime.strptime(text, "%Y%m%dT%H%M%SZ").timetuple())


def body(uid, start, end, rule, categories, place):
    where = f" GEO:{place[0]};{place[1]}" if place else ""
    return f"UID:{uid} DTSTART:{start} DTEND:{end} RRULE:{rule} CATEGORIES:{categories} RELATED-TO;RELTYPE=PARENT:PARENT_UID LAST-MODIFIED:20210501T090000Z SUMMARY:In {uid.title()} CLASS:PUBLIC{where}"


@pytest.fixture(scope="module")
def tables(spark):
    e = parse_events(spark.createDataFrame([("C", x[0], body(*x)) for x in EVENTS_IN], "calendar_uid string, event_uid string, body string"))
    o = parse_overrides(spark.createDataFrame([("C", "OVERRIDDEN_EVENT_IN_BRISTOL_TUE_THU", at, b) for at, b in OVERRIDES_IN], "calendar_uid string, event_uid string, occurrence string, body string"))
    assert [r[0] for r in e.select("error").distinct().collect()] == [None] and [r[0] for r in o.select("error").distinct().collect()] == [None]
    return cut(e.drop("error")), cut(o.drop("error"))


def keys(df):
    return [(r["event_uid"], r["dtstart_ts"]) for r in df.select("event_uid", "dtstart_ts").collect()]


def test_empty_query_gives_the_golden_rows(tables):
    e, o = tables
    two = e.filter(F.col("event_uid").isin("EVENT_IN_CHELTENHAM_TUE_THU", "OVERRIDDEN_EVENT_IN_BRISTOL_TUE_THU"))
    rows = query_instances(two, o, Query()).collect()
    starts = [ts("20201231T183000Z"), ts("20210105T183000Z"), ts("20210107T183000Z")]
    assert [(r["event_uid"], r["dtstart_ts"]) for r in rows] == [(u, s) for s in starts for u in ("EVENT_IN_CHELTENHAM_TUE_THU", "OVERRIDDEN_EVENT_IN_BRISTOL_TUE_THU")]
    changed = [r for r in rows if r["has_override"]]
    assert changed[0]["geo"] is None and changed[0]["categories"] == ["CATEGORY_OVERRIDE"] and changed[0]["related_to"][0]["uid"] == "PARENT_UID_OVERRIDE"
    assert tuple(changed[1]["geo"]) == CHELTENHAM and changed[1]["categories"] == ["CATEGORY_FOUR", "CATEGORY_ONE"]
    assert changed[1]["passive"]["SUMMARY"] == ["SUMMARY:Moved"]


def test_start_that_the_rule_skips_is_no_occurrence(tables):
    e, o = tables
    assert keys(list_instances(e, o, "C", "EVENT_IN_OXFORD_MON_WED"))[0][1] == ts("20210104T170000Z")


def test_filters_agree_with_a_plain_reading(tables):
    e, o = tables
    every = query_instances(e, o, Query(limit=None)).collect()
    cases = [
        (p.has_categories("CATEGORY_ONE", "CATEGORY_FOUR"), lambda r: {"CATEGORY_ONE", "CATEGORY_FOUR"} <= set(r["categories"])),
        (~p.has_categories("CATEGORY_ONE"), lambda r: "CATEGORY_ONE" not in r["categories"]),
        (~p.within(*BRISTOL, 1), lambda r: r["geo"] is None or tuple(r["geo"]) != BRISTOL),
        (p.related_to("PARENT_UID_OVERRIDE"), lambda r: r["related_to"][0]["uid"] == "PARENT_UID_OVERRIDE"),
        (p.uid_in("A") & p.uid_in("B"), lambda r: False),
        (p.is_class("PUBLIC", "PRIVATE"), lambda r: False),
        (group([p.uid_in("EVENT_IN_LONDON_TUE_THU"), "OR", [p.has_categories("CATEGORY_THREE"), ~p.has_location_types("ONLINE")]]), lambda r: r["event_uid"] in ("EVENT_IN_LONDON_TUE_THU", "EVENT_IN_READING_TUE_THU")),
    ]
    for where, want in cases:
        assert sorted(keys(query_instances(e, o, Query(where=where, limit=None)))) == sorted((r["event_uid"], r["dtstart_ts"]) for r in every if want(r))


def test_orders_pages_and_distinct(tables):
    e, o = tables
    near = query_instances(e, o, Query(order=BY_DISTANCE_THEN_START, place=OXFORD, distinct=True, limit=3)).collect()
    assert [r["event_uid"] for r in near] == ["EVENT_IN_OXFORD_MON_WED", "EVENT_IN_READING_TUE_THU", "EVENT_IN_CHELTENHAM_TUE_THU"] and near[0]["dist_micro"] == 0
    first = query_instances(e, o, Query(order=BY_START_THEN_DISTANCE, place=OXFORD)).collect()
    same = [r for r in first if r["dtstart_ts"] == ts("20210105T183000Z")]
    assert same[0]["geo"] is None and same[0]["event_uid"].startswith("OVERRIDDEN")
    whole = keys(query_instances(e, o, Query(limit=40)))
    assert keys(query_instances(e, o, Query(limit=7, offset=5))) == whole[5:12]
    assert keys(query_instances(e, o, Query(after=Bound(ts("20210105T183000Z"), "GTE"), before=Bound(ts("20210107T183000Z"), "LT"), limit=None))) != []


def test_a_page_of_rules_without_end(spark, tables):
    e, o = tables
    endless = e.withColumn("rule", F.col("rule").withField("count", F.lit(None).cast("int")).withField("until_ts", F.lit(None).cast("long")))
    with pytest.raises(ValueError):
        occurrences(endless)
    got = keys(query_instances(endless, o, Query(limit=30, offset=4)))
    assert got == keys(query_instances(endless, o, Query(limit=30, offset=4), horizon=ts("20220601T000000Z")))


def test_base_events_know_no_overrides(tables):
    e, _ = tables
    assert query_events(e, Query(where=p.has_categories("CATEGORY_OVERRIDE"))).count() == 0
    assert query_events(e, Query(where=p.within(*BRISTOL, 5, "MI"))).count() == 1
    late = Query(after=Bound(ts("20201231T184500Z"), "GT", "DTEND"))
    assert sorted(r["event_uid"] for r in query_events(e, late).collect())[0] == "EVENT_IN_CHELTENHAM_TUE_THU"


def test_clock_time_stays_across_a_change_of_clocks(spark):
    b = "DTSTART;TZID=Europe/London:20241001T100000 DTEND;TZID=Europe/London:20241001T110000 RRULE:COUNT=3;FREQ=MONTHLY;INTERVAL=4"
    e = parse_events(spark.createDataFrame([("C", "E", b)], "calendar_uid string, event_uid string, body string"))
    at = occurrences(cut(e)).orderBy("occurrence_ts")
    assert [r["occurrence_ts"] for r in at.collect()] == [ts("20241001T090000Z"), ts("20250201T100000Z"), ts("20250601T090000Z")]
    shown = rendered(at.withColumnRenamed("occurrence_ts", "dtstart_ts").withColumn("dtend_ts", F.col("dtstart_ts")), "Europe/London")
    assert [r["dtstart"][-6:] for r in shown.collect()] == ["100000"] * 3


def test_rules_agree_with_dateutil(spark):
    rnd = random.Random(5)
    days = ["MO", "TU", "WE", "TH", "FR", "SA", "SU"]
    rules = ["FREQ=DAILY;INTERVAL=3;COUNT=9", "FREQ=WEEKLY;INTERVAL=2;COUNT=7;WKST=SU;BYDAY=SU,TU", "FREQ=MONTHLY;INTERVAL=1;COUNT=6;BYMONTHDAY=31", "FREQ=MONTHLY;INTERVAL=2;COUNT=5;BYDAY=-1FR", "FREQ=MONTHLY;INTERVAL=1;COUNT=5;BYDAY=MO,TU,WE,TH,FR;BYSETPOS=-1",
             "FREQ=YEARLY;INTERVAL=1;COUNT=4;BYMONTH=2;BYMONTHDAY=-1", "FREQ=YEARLY;INTERVAL=1;COUNT=4;BYDAY=20MO", "FREQ=YEARLY;INTERVAL=1;COUNT=5;BYYEARDAY=1,-1", "FREQ=HOURLY;INTERVAL=5;COUNT=8", "FREQ=MINUTELY;INTERVAL=45;COUNT=20;BYHOUR=9,10", "FREQ=DAILY;INTERVAL=1;COUNT=6;BYHOUR=6,18;BYMINUTE=0,30", "FREQ=YEARLY;INTERVAL=2;COUNT=3", "FREQ=YEARLY;INTERVAL=1;COUNT=4;BYWEEKNO=20;BYDAY=MO"]
    for _ in range(25):
        rules.append(f"FREQ={rnd.choice(['WEEKLY', 'MONTHLY'])};INTERVAL={rnd.randint(1, 3)};COUNT={rnd.randint(1, 8)};BYDAY={','.join(sorted(rnd.sample(days, rnd.randint(1, 3))))}")
    starts = [dt.datetime(2020, 1, 1, 8, 30) + dt.timedelta(days=rnd.randint(0, 900), minutes=rnd.randint(0, 900)) for _ in rules]
    rows = [("C", f"E{k:03}", f"DTSTART:{s:%Y%m%dT%H%M%S}Z RRULE:{r}") for k, (s, r) in enumerate(zip(starts, rules, strict=True))]
    e = parse_events(spark.createDataFrame(rows, "calendar_uid string, event_uid string, body string"))
    e = cut(e)
    assert e.filter("error is not null").count() == 0
    got = {}
    for r in occurrences(e).collect():
        got.setdefault(r["event_uid"], []).append(r["occurrence_ts"])
    for k, (s, r) in enumerate(zip(starts, rules, strict=True)):
        want = [calendar.timegm(x.timetuple()) for x in rrulestr(r, dtstart=s)]
        assert sorted(got.get(f"E{k:03}", [])) == want, (s, r)


def parsed(spark, bodies):
    return parse_events(spark.createDataFrame([("C", k, b) for k, b in bodies.items()], "calendar_uid string, event_uid string, body string")).transform(cut)


def by_event(rows, column="occurrence_ts"):
    got = {}
    for r in rows.collect():
        got.setdefault(r["event_uid"], []).append(r[column])
    return {k: sorted(v) for k, v in got.items()}


def test_rare_rules_have_their_whole_count_and_page(spark):
    start = dt.datetime(2021, 2, 1, 9)
    rules = ["FREQ=DAILY;INTERVAL=1;BYDAY=MO;COUNT=10", "FREQ=DAILY;INTERVAL=1;BYMONTHDAY=1;COUNT=12", "FREQ=DAILY;INTERVAL=1;BYMONTH=1;COUNT=3", "FREQ=MONTHLY;INTERVAL=1;BYMONTH=1;COUNT=12", "FREQ=HOURLY;INTERVAL=1;BYMONTH=1;COUNT=3",
             "FREQ=YEARLY;INTERVAL=1;BYMONTH=2;BYMONTHDAY=29;COUNT=3", "FREQ=MONTHLY;INTERVAL=1;BYDAY=FR;BYMONTHDAY=13;COUNT=9", "FREQ=DAILY;INTERVAL=1;BYMONTHDAY=1;UNTIL=20230101T090000Z", "FREQ=MONTHLY;INTERVAL=1;BYMONTH=2;BYMONTHDAY=30;COUNT=2"]
    got = by_event(occurrences(parsed(spark, {f"E{k}": f"DTSTART:20210201T090000Z RRULE:{r}" for k, r in enumerate(rules)})))
    for k, r in enumerate(rules[:-1]):
        assert got[f"E{k}"] == [calendar.timegm(x.timetuple()) for x in rrulestr(r.removesuffix("Z"), dtstart=start)], r
    assert "E8" not in got
    page = parsed(spark, {"A": "DTSTART:20210201T090000Z RRULE:FREQ=DAILY;INTERVAL=1;BYDAY=MO", "B": "DTSTART:20210201T090000Z RRULE:FREQ=DAILY;INTERVAL=1;BYDAY=MO;COUNT=45"})
    none = spark.createDataFrame([], OVERRIDES)
    weeks = [ts("20210201T090000Z") + 7 * 86_400 * k for k in range(50)]
    assert keys(query_instances(page.filter("event_uid = 'A'"), none, Query())) == [("A", t) for t in weeks]
    assert keys(query_instances(page.filter("event_uid = 'B'"), none, Query())) == [("B", t) for t in weeks[:45]]


def test_dates_in_and_out(spark):
    b = "DTSTART:20210101T000000Z RRULE:FREQ=DAILY;INTERVAL=1;COUNT=5 EXRULE:FREQ=DAILY;INTERVAL=2;COUNT=2 RDATE:20210201T000000Z,20210102T000000Z EXDATE:20210104T000000Z"
    rows = [("C", "A", b), ("C", "B", "DTSTART:20210101T000000Z"), ("C", "D", "DTSTART:20210101T000000Z RDATE:20210301T000000Z")]
    e = parse_events(spark.createDataFrame(rows, "calendar_uid string, event_uid string, body string"))
    got = sorted((r["event_uid"], r["occurrence_ts"]) for r in occurrences(cut(e)).collect())
    assert got == [("A", ts("20210102T000000Z")), ("A", ts("20210105T000000Z")), ("A", ts("20210201T000000Z")), ("B", ts("20210101T000000Z")), ("D", ts("20210301T000000Z"))]


def test_bad_bodies_are_told_apart(spark):
    bad = {
        "A": "UID:B DTSTART:20210101T000000Z", "B": None, "C": "DTSTART:20210641T180000Z", "D": "DTSTART;TZID=Europe/London:20210328T013000", "E": "DTSTART;TZID=Europe/London:20211031T013000",
        "F": "DTSTART:20210101T000000Z RRULE:FREQ=DAILY", "G": "DTSTART:20210101T000000Z DURATION:soon", "H": "DTSTART;TZID=Nowhere/Land:20210101T000000", "I": "DTSTART:20210101T000000Z RRULE:FREQ=DAILY;INTERVAL=1;UNTIL=soon",
        "J": "DTSTART:20210101T000000Z RRULE:FREQ=WEEKLY;INTERVAL=1;BYDAY=XX", "K": "DTSTART:20210101T000000Z EXDATE:rubbish", "L": "DTSTART:20210101T000000Z GEO:abc", "M": "DTSTART:20210101T000000Z RRULE:FREQ=DAILY;INTERVAL=1;UNTIL=20210641T000000Z",
    }
    e = parse_events(spark.createDataFrame([("C", k, b) for k, b in bad.items()], "calendar_uid string, event_uid string, body string"))
    assert e.filter("error is null").count() == 0
    o = parse_overrides(spark.createDataFrame([("C", "A", "20210101T000000Z", "RRULE:FREQ=DAILY;INTERVAL=1")], "calendar_uid string, event_uid string, occurrence string, body string"))
    assert o.first()["error"]
    local = "DTSTART;TZID=America/New_York:20210101T200000 RRULE:FREQ=DAILY;INTERVAL=1;UNTIL=20210103T200000 ACKNOWLEDGED:yes XML:<a/>"
    r = parse_events(spark.createDataFrame([("C", "A", local)], "calendar_uid string, event_uid string, body string")).first()
    assert r["error"] is None and r["rule"]["until_ts"] == ts("20210104T010000Z") and set(r["passive"]) == {"ACKNOWLEDGED", "XML"}


def test_parts_finer_than_the_frequency_expand(spark):
    start = dt.datetime(2021, 2, 1, 9, 10)
    rules = ["FREQ=HOURLY;INTERVAL=1;BYMINUTE=0,30;UNTIL=20210201T130000Z", "FREQ=MINUTELY;INTERVAL=10;BYSECOND=0,30;UNTIL=20210201T100000Z", "FREQ=HOURLY;INTERVAL=5;BYMINUTE=5;BYSECOND=1,2;UNTIL=20210202T130000Z"]
    got = by_event(occurrences(parsed(spark, {f"E{k}": f"DTSTART:20210201T091000Z RRULE:{r}" for k, r in enumerate(rules)})))
    for k, r in enumerate(rules):
        assert got[f"E{k}"] == [calendar.timegm(x.timetuple()) for x in rrulestr(r.replace("Z", ""), dtstart=start)], r


def test_far_occurrences_keep_an_event(spark):
    at, rule = ts("20200301T000000Z"), {"freq": "WEEKLY", "interval": 200, "count": 2, "wkst": "MO"}
    rows = [{"calendar_uid": "C", "event_uid": u, "dtstart_ts": at, "tzid": "UTC", "rule": r} for u, r in (("A", rule), ("B", None), ("D", rule | {"freq": "DAILY", "interval": 900, "count": None}))]
    far = spark.createDataFrame(rows, EVENTS)
    assert {r[1] for r in m.last_occurrence_between(far, ts("20200101T000000Z"), ts("20201231T000000Z")).collect()} == {"B"}


def test_values_end_where_the_next_property_begins(spark):
    b = 'DTSTART:20210101T000000Z SUMMARY;X-A="a:b":Tea at 5: bring cups CLASS:PRIVATE X-NOTE:kept \\, as is'
    r = parse_events(spark.createDataFrame([("C", "A", b)], "calendar_uid string, event_uid string, body string")).first()
    assert r["class"] == "PRIVATE" and r["passive"]["SUMMARY"] == ['SUMMARY;X-A="a:b":Tea at 5: bring cups'] and r["passive"]["X-NOTE"] == ["X-NOTE:kept \\, as is"]


def test_durations_and_distances(spark):
    df = spark.createDataFrame([(x,) for x in ("PT30M", "P1W2DT3H4M5S", "-PT1H", "P", "PT", "PT0S")], "d string")
    assert [r[0] for r in df.select(ical.duration_seconds(F.col("d"))).collect()] == [1800, 604800 + 2 * 86400 + 3 * 3600 + 245, -3600, None, None, 0]
    n = spark.createDataFrame([(x,) for x in (0, 1800, -3600, 788645)], "n long")
    assert [r[0] for r in n.select(ical.show_duration(F.col("n"))).collect()] == ["PT0S", "PT30M", "-PT1H", "P1W2DT3H4M5S"]
    one = spark.range(1).select(geo.micro_km(geo.haversine_km(F.lit(OXFORD[0]), F.lit(OXFORD[1]), *READING)).alias("d"))
    assert abs(one.first()[0] / 1e6 - 38.3) < 0.5
    assert one.select(geo.show(F.lit(41927336))).first()[0] == "41.927336KM"


def test_upsert_prune_diff_and_terms(spark, tables):
    e, o = tables
    newer = e.limit(1).withColumns({"last_modified_ts": F.col("last_modified_ts") + 1, "class": F.lit("PRIVATE")})
    older = e.filter("event_uid = 'EVENT_IN_READING_TUE_THU'").withColumns({"last_modified_ts": F.col("last_modified_ts") - 1, "class": F.lit("PRIVATE")})
    out = m.upsert(e, newer.unionByName(older))
    assert out.count() == e.count() and out.filter("class = 'PRIVATE'").count() == 1
    gone = m.last_occurrence_between(e, ts("20210101T000000Z"), ts("20210106T180000Z"))
    assert [r["event_uid"] for r in gone.collect()] == []
    gone = m.last_occurrence_between(e, ts("20210101T000000Z"), ts("20210201T000000Z"))
    assert gone.count() == 5
    with pytest.raises(ValueError):
        m.last_occurrence_between(e, 2, 1)
    assert m.prune_overrides(o, ts("20210105T000000Z"), ts("20210107T235959Z")).count() == 1
    d = m.diff(e, out, ["class", "categories"])
    assert {r["status"]: r["count"] for r in d.groupBy("status").count().collect()} == {"updated": 1, "maintained": 5}
    t = m.term_index(e, o, "categories").filter("event_uid like 'OVERRIDDEN%'").collect()
    at = ts("20210105T183000Z")
    assert {(r["term"], r["included"], tuple(r["exceptions"])) for r in t} == {("CATEGORY_ONE", True, (at,)), ("CATEGORY_FOUR", True, (at,)), ("CATEGORY_OVERRIDE", False, (at,))}


def test_rendering(tables):
    e, o = tables
    r = instances(e, o).filter("event_uid like 'OVERRIDDEN%' and has_override").select("dtstart_ts", render_instance().alias("l")).orderBy("dtstart_ts").first()
    assert r["l"] == sorted(r["l"]) and "CATEGORIES:CATEGORY_OVERRIDE" in r["l"] and "DTSTART:20210105T183000Z" in r["l"] and not any(x.startswith("GEO") for x in r["l"])


def _rendered(spark, tables):
    full = (
        "UID:Z LAST-MODIFIED;X-MILLIS=7:20210501T090000Z DTSTART;TZID=America/New_York:20210301T090000 DURATION:PT1H30M RRULE:FREQ=MONTHLY;INTERVAL=1;UNTIL=20211231T000000Z;BYDAY=-1FR,2MO;BYMONTH=3,4;WKST=SU"
        " EXRULE:FREQ=MONTHLY;INTERVAL=2;COUNT=2 RDATE;TZID=America/New_York:20210315T100000,20210302T080000 EXDATE:20210331T130000Z CLASS:PRIVATE LOCATION-TYPE:B,A GEO:1.5;-2.25 RELATED-TO:P RELATED-TO;RELTYPE=CHILD:Q SUMMARY:One two X-OWN;A=b:c"
    )
    e = tables[0].unionByName(parse_events(spark.createDataFrame([("C", "Z", full), ("C", "Y", "DTSTART:20210301T090000Z LAST-MODIFIED:20210501T090000Z")], "calendar_uid string, event_uid string, body string")).drop("error"))
    texts = e.select("calendar_uid", "event_uid", F.array_join(render_event(), "\n").alias("body"))
    return e, texts


def test_rendered_events(spark, tables):
    _, texts = _rendered(spark, tables)
    lines = {r["event_uid"]: r["body"].split("\n") for r in texts.collect()}
    assert all(x == sorted(x) for x in lines.values()) and lines["Y"] == ["DTSTART:20210301T090000Z", "LAST-MODIFIED:20210501T090000Z", "UID:Y"]
    assert {"DTSTART;TZID=America/New_York:20210301T090000", "LAST-MODIFIED;X-MILLIS=7:20210501T090000Z", "RRULE:BYDAY=-1FR,2MO;BYMONTH=3,4;FREQ=MONTHLY;INTERVAL=1;UNTIL=20211231T000000Z;WKST=SU", "LOCATION-TYPE:A,B", "X-OWN;A=b:c"} < set(lines["Z"])


@pytest.mark.xfail(reason="one event that is read back has an error; whether it had it before rendering isn't known yet", strict=False)
def test_rendered_events_and_overrides_are_read_back(spark, tables):
    e, texts = _rendered(spark, tables)
    by_uid = lambda df: {r["event_uid"]: r.asDict(True) for r in df.collect()}
    back = parse_events(texts)
    assert back.filter("error is not null").count() == 0 and by_uid(back.drop("error")) == by_uid(e)
    o = tables[1].unionByName(parse_overrides(spark.createDataFrame([("C", "V", "20210105T183000Z", "CATEGORIES: LAST-MODIFIED:20210501T090000Z DURATION:PT5M")], "calendar_uid string, event_uid string, occurrence string, body string")).drop("error"))
    o = o.withColumn("last_modified_ts", F.lit(ts("20210501T090000Z")))
    texts = o.select("calendar_uid", "event_uid", F.date_format(F.timestamp_seconds("occurrence_ts"), "yyyyMMdd'T'HHmmss'Z'").alias("occurrence"), F.array_join(render_override(), " ").alias("body"))
    by_time = lambda df: {(r["event_uid"], r["occurrence_ts"]): r.asDict(True) for r in df.collect()}
    back = parse_overrides(texts)
    assert back.filter("error is not null").count() == 0 and by_time(back.drop("error")) == by_time(o)
    assert spark.createDataFrame([("C",)], "calendar_uid string").select(render_calendar()).first()[0] == ["UID:C"]


def test_calendars_and_guards(spark):
    held = spark.createDataFrame([("A", False)], CALENDARS)
    both = m.create_calendars(held, spark.createDataFrame([("A",), ("B",), ("B",)], "calendar_uid string"))
    assert sorted(map(tuple, both.collect())) == [("A", False), ("B", True)]
    require_active(both, "B")
    with pytest.raises(RuntimeError):
        require_active(both, "A")
    require_active(m.set_indexes(both, "A", True), "A")
    with pytest.raises(LookupError):
        require_active(both, "Z")
    with pytest.raises(ValueError):
        Query(order=BY_DISTANCE_THEN_START)
    deep = F.lit(True)
    nested = [deep]
    for _ in range(40):
        nested = [nested]
    with pytest.raises(ValueError):
        group(nested)


def test_empty_tables(spark):
    e, o = spark.createDataFrame([], EVENTS), spark.createDataFrame([], OVERRIDES)
    assert query_instances(e, o, Query(where=p.has_categories("X"))).count() == 0 and query_events(e, Query()).count() == 0
    assert m.upsert(e, e).count() == 0 and m.term_index(e, o, "categories").count() == 0


def test_a_stream_of_changes_lands_once(spark, tables, tmp_path):
    e, _ = tables
    log = changes(e, "evt_set")
    assert log.first()["message"].startswith("evt_set:")
    log.write.mode("append").parquet(str(tmp_path / "log"))
    assert watch(spark, str(tmp_path / "log")).isStreaming and [f.name for f in spark.createDataFrame([], CHANGES).schema] == log.columns
    e.write.parquet(str(tmp_path / "in"))
    state = {"table": spark.createDataFrame([], e.schema)}

    def write(df):
        state["table"] = spark.createDataFrame(df.collect(), e.schema)

    for _ in range(2):
        apply_stream(spark.readStream.schema(e.schema).parquet(str(tmp_path / "in")), lambda: state["table"], write, str(tmp_path / "cp")).awaitTermination()
    assert state["table"].count() == e.count()
