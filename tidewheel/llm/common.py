"""What the operators of this subpackage share: reading, scratch tables on shared storage, small column helpers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Ids that are broadcast, at most; more are joined.
BROADCAST_IDS = 1_000_000
#: Bytes of a batch that goes to Python, about.
BATCH_BYTES = 8 << 20
#: Keys that have more than one in HOT_SHARE of the rows are hot: there are fewer than HOT_SHARE of them.
HOT_SHARE = 1000
#: Rows that a task takes at least, where a step has few.
TASK_ROWS = 20_000
#: As TASK_ROWS, of rows with whole texts.
TASK_TEXTS = 2_000
#: White space between words, the same set in Spark, Python (bytes.split) and DuckDB.
SPACES = " \t\n\x0b\x0c\r"


def short_batches(spark: SparkSession) -> None:
    """Texts can be long: Arrow batches of BATCH_BYTES at most, of which a task holds a few at once."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(str(spark.conf.get(setting, "67108864")).rstrip("b")) > BATCH_BYTES:
        spark.conf.set(setting, BATCH_BYTES)


#: What a worker remembers from task to task, and entries of each that may stay while none runs.
REMEMBERING: list[dict] = []
STAY = 50_000


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which the worker gives back what it has freed: workers are kept for later tasks, and
    would hold their largest task's memory beside the JVM's meanwhile."""

    def lent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return lent


def give_back() -> None:
    """Forgets what is large, frees what nothing refers to, and returns free memory to the system where the C library can."""
    for kept in REMEMBERING:
        if len(kept) > STAY:
            kept.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    short_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where none is set and all run on one machine
    (tests), a temporary one; on a cluster that is an error, since executors would write where no other one reads."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        d = "file://" + tempfile.mkdtemp(prefix="tidewheel-")
        spark.conf.set("spark.checkpoint.dir", d)
    return d


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a table in the shared folder and returns what reads it back, so that lineage ends here
    and a lost executor costs only the tasks that were reading. Removed when the session's Python ends."""
    spark = df.sparkSession
    path = _new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def saved_by(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """As saved(), in buckets of a column, so that joining and grouping by it needn't shuffle the table."""
    spark = df.sparkSession
    path, table_name = _new_path(spark, name), f"tidewheel_{uuid.uuid4().hex}"
    df.write.bucketBy(max(1, min(buckets, 50_000)), column).option("compression", "zstd").option("path", path).saveAsTable(table_name)
    atexit.register(_remove, spark, path)
    return spark.read.table(table_name)


def in_few(df: DataFrame, rows: int, each: int = TASK_ROWS) -> DataFrame:
    """df, worked out from about so many rows, in no more tasks than these fill or the cores can run at once. Where Spark
    doesn't bring small partitions together, each step of an iteration would start a task for every partition, and the
    driver keeps something of each. Of many rows nothing changes."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each)))


def _new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/tidewheel-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # noqa: BLE001  the session has ended; the folder's owner clears it
        pass


def having(rows: DataFrame, ids: DataFrame, column: str, kept: bool = True) -> DataFrame:
    """rows whose column is among ids (a column of that name, distinct); without kept, those whose column isn't. Few ids
    are broadcast, so that the other rows aren't shuffled."""
    ids = ids.select(column)
    return rows.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, column, "left_semi" if kept else "left_anti")


def joined(many: DataFrame, one: DataFrame, key: str, total: int) -> DataFrame:
    """many join one by key, which is unique in one; `rows` of one is how many rows of many have it, of total. Hot keys
    are few and so broadcast: no task gets all rows of one."""
    hot = one.filter(F.col("rows") * HOT_SHARE > total)
    cold = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(one.filter(F.col("rows") * HOT_SHARE <= total), key)
    return many.join(F.broadcast(hot), key).unionByName(in_few(cold, total))


def keyed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """docs with _row, a number of their own in the order of doc_id, and _doc, the least _row of their doc_id (null where
    that is null); and whether these are just doc_id, since no id is null or repeated."""
    if in_few(docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 or doc_id is null"), docs.count()).isEmpty():
        return docs.withColumns({"_row": F.col("doc_id").cast("long"), "_doc": F.col("doc_id").cast("long")}), True
    order = [F.col("doc_id").asc_nulls_last(), F.col("text").asc(), F.col("_tie").asc()]
    dealt = saved(docs.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "keyed-rows")
    before, seen = [], 0
    for r in dealt.groupBy("_range").agg(F.count("*").alias("n")).orderBy("_range").collect():  # a row per range
        before.append((r["_range"], seen))
        seen += r["n"]
    starts = docs.sparkSession.createDataFrame(before, "_range int, _before long")
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    rows = dealt.join(F.broadcast(starts), "_range").withColumn("_row", F.col("_before") + inside - 1).drop("_tie", "_range", "_before")
    rows = saved(rows, "keyed-rows")
    least = rows.filter("doc_id is not null").groupBy(F.col("doc_id").alias("_id")).agg(F.min("_row").alias("_doc"))
    return rows.join(least, F.col("doc_id") == F.col("_id"), "left").drop("_id"), False


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once; projections that only name it would compute it at each use."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The runs of [^\\x20\\x09-\\x0D]+ of a text, in order."""
    return F.array_remove(F.split(F.translate(text, SPACES[1:], " " * (len(SPACES) - 1)), " "), "")
