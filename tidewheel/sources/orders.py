"""Calendars made of order tables, by integer formulas: a stand-in with known answers for tests and benchmarks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import DAY, GEO, PASSIVE, RELATED, RULE

CALENDAR = "ORDERS"
#: Lines that a task brings together, about.
LINES_EACH = 500_000


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _start(c: str = "o_orderdate"):
    return F.unix_seconds(F.col(c).cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An event an order, every 1 to 7 days, 1 to 5 times."""
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    c = _table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    rule = F.struct(
        F.lit("DAILY").alias("freq"), (1 + k % 7).cast("int").alias("interval"), (1 + k % 5).cast("int").alias("count"), F.lit(None).cast("long").alias("until_ts"),
        *(F.lit(None).cast("array<string>" if n == "byday" else "array<int>").alias(n) for n in ("byday", "bymonthday", "bymonth", "byyearday", "byweekno", "bysetpos", "byhour", "byminute", "bysecond")), F.lit("MO").alias("wkst"),
    )
    point = F.when(cust % 10 != 0, F.struct(((cust * 7 % 1200) / 10.0 - 60).alias("lat"), ((cust * 13 % 3400) / 10.0 - 170).alias("long")))
    return o.join(c, cust == F.col("c_custkey")).select(
        F.lit(CALENDAR).alias("calendar_uid"), F.concat(F.lit("ORD-"), k.cast("string")).alias("event_uid"), _start().alias("last_modified_ts"), F.lit(0).alias("last_modified_ms"),
        _start().alias("dtstart_ts"), F.lit("UTC").alias("tzid"), F.when(k % 2 == 0, _start() + 1800 * (1 + k % 4)).alias("dtend_ts"), F.when(k % 2 == 1, 1800 * (1 + k % 4)).alias("duration_s"),
        rule.alias("rule"), F.lit(None).cast(RULE).alias("exrule"), F.lit(None).cast("array<bigint>").alias("rdates"), F.lit(None).cast("array<bigint>").alias("exdates"),
        F.array("o_orderpriority", "c_mktsegment").alias("categories"), F.when(cust % 2 == 0, F.array(F.lit("ONLINE"), F.col("c_mktsegment"))).otherwise(F.array("c_mktsegment")).alias("location_type"),
        F.when(F.col("o_orderstatus") == "F", "PUBLIC").when(F.col("o_orderstatus") == "O", "PRIVATE").otherwise("CONFIDENTIAL").alias("class"),
        F.array(F.struct(F.lit("PARENT").alias("reltype"), F.concat(F.lit("CUST-"), cust.cast("string")).alias("uid"))).cast(RELATED).alias("related_to"),
        point.cast(GEO).alias("geo"), F.lit(None).cast(PASSIVE).alias("passive"),
    )


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An override a line number of an order; some name no occurrence."""
    lines = _table(spark, sf_dir, "lineitem")
    # By their number, since what a task holds would else grow with the table.
    tasks = max(spark.sparkContext.defaultParallelism, lines.count() // LINES_EACH + 1)
    # The least flag and the last status only matter by whether they are these: as numbers of a fixed width they are hashed, where strings would be sorted.
    side = lambda c, x: F.when(F.col(c) < x, 0).when(F.col(c) == x, 1).when(F.col(c) > x, 2)
    lines = lines.select("l_orderkey", "l_linenumber", "l_quantity", side("l_returnflag", "R").alias("flag"), side("l_linestatus", "O").alias("status")).repartition(tasks, "l_orderkey")
    lines = lines.groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("q"), F.min("flag").alias("flag"), F.max("status").alias("status"))
    o = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    k = F.col("o_orderkey")
    at = _start() + (F.col("l_linenumber") - 1) * (1 + k % 7) * DAY
    # Both grow: a broadcast of orders would be held beside what each task sorts.
    return lines.join(o.hint("merge"), F.col("l_orderkey") == k).select(
        F.lit(CALENDAR).alias("calendar_uid"), F.concat(F.lit("ORD-"), k.cast("string")).alias("event_uid"), at.cast("long").alias("occurrence_ts"), _start().alias("last_modified_ts"), F.lit(0).alias("last_modified_ms"),
        (F.col("q").cast("long") * 60).alias("duration_s"), F.when(F.col("flag") == 1, F.array(F.lit("RF_R"))).alias("categories"),
        F.lit(None).cast("array<string>").alias("location_type"), F.lit(None).cast("string").alias("class"), F.lit(None).cast(RELATED).alias("related_to"),
        (F.col("status") == 1).alias("geo_overridden"), F.lit(None).cast(GEO).alias("geo"), F.lit(None).cast(PASSIVE).alias("passive"),
    )
