"""Resharding by minimum-cost flow.

Given the byte sizes of the old shards and the capacities of the new ones, a transport problem says how many bytes
go from where to where so that the fewest bytes move: bytes that stay cost nothing, moved ones cost one each. The
flow is then met with blocks: each old shard's documents lie in blocks in a fixed order, and its outgoing flows cut
that order into consecutive stretches. Only blocks in a stretch that leaves its shard are rewritten.

Documents with equal texts are a group: they lie in one block and a stretch is cut between groups, so what lies together
stays together. Only a group larger than one part in GROUP_PARTS of a new shard is split, since the shards couldn't be
near equal otherwise.

What reaches the driver is one row per block, at most MAX_ROWS whatever the input.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import saved, text_of

BLOCK_BYTES = 64 << 20
#: Blocks of one size class in one old shard, at least where there is room, and all blocks, at most.
MIN_BLOCKS, MAX_ROWS = 64, 1 << 18
#: Groups of equal texts up to this part of a new shard's bytes stay whole.
GROUP_PARTS = 64
#: Classes are powers of two of a document's bytes; a row of the largest class is 2 GB, as much as a cell can hold.
CLASSES = 32


def min_cost_flow(supply: list[int], capacity: list[int], cost: list[list[int]]) -> list[list[int]]:
    """flow[i][j] of the transport problem: each supply leaves whole, no capacity is exceeded, and the sum of
    cost * flow is the least possible. Successive shortest paths; the sizes are numbers of shards, so it is small."""
    if sum(supply) > sum(capacity):
        raise ValueError("the new shards hold less than the old ones have")
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    residual: dict[int, dict[int, list[int]]] = defaultdict(dict)  # node -> node -> [free, cost]

    def arc(a: int, b: int, free: int, price: int) -> None:
        residual[a][b] = [free, price]
        residual[b][a] = [0, -price]

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
        for j in range(m):
            arc(i, n + j, s, cost[i][j])
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    while True:
        far, came, queue, waiting = {source: 0}, {}, deque([source]), {source}
        while queue:
            a = queue.popleft()
            waiting.discard(a)
            for b, (free, price) in residual[a].items():
                if free and far[a] + price < far.get(b, 1 << 62):
                    far[b], came[b] = far[a] + price, a
                    if b not in waiting:
                        waiting.add(b)
                        queue.append(b)
        if sink not in far:
            break
        path = [sink]
        while path[-1] != source:
            path.append(came[path[-1]])
        steps = list(zip(path[1:], path[:-1], strict=True))
        push = min(residual[a][b][0] for a, b in steps)
        for a, b in steps:
            residual[a][b][0] -= push
            residual[b][a][0] += push
    return [[residual[n + j][i][0] for j in range(m)] for i in range(n)]


def move_costs(old: int, new: int) -> list[list[int]]:
    """A byte that stays costs 0, one that moves 1; shard numbers carry over, so new shards past the old are empty."""
    return [[int(i != j) for j in range(new)] for i in range(old)]


@dataclass(frozen=True)
class Stretch:
    """Documents of a block whose middle byte lies in [low, high) go to shard."""

    block: int
    low: float
    high: float
    shard: int


def stretches(blocks: list[tuple[int, int, int]], flow: list[list[int]]) -> list[Stretch]:
    """blocks: (block, old shard, bytes) in the order in which they lie. What stays comes first, so that the cuts
    fall among the last blocks, which hold the smallest documents."""
    out: list[Stretch] = []
    of: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for block, old, size in blocks:
        of[old].append((block, size))
    for old, own in of.items():
        targets = sorted(((j, f) for j, f in enumerate(flow[old]) if f), key=lambda x: (x[0] != old, x[0]))
        k, left = 0, targets[0][1] if targets else 0
        for block, size in own:
            low = 0
            while targets and (size - low > left) and k + 1 < len(targets):
                if left:
                    out.append(Stretch(block, low, low + left, targets[k][0]))
                low += left
                k += 1
                left = targets[k][1]
            out.append(Stretch(block, low, float("inf"), targets[k][0] if targets else old))
            left -= size - low
    return out


def block_of(size: Column, key: Column, per_class: int) -> Column:
    """Large documents in the first blocks of a shard, small ones in the last."""
    rank = CLASSES - 1 - F.least(F.lit(CLASSES - 1), F.floor(F.log2(F.greatest(size, F.lit(1)).cast("double"))).cast("int"))
    return (rank * per_class + F.pmod(key, F.lit(per_class))).cast("long")


def reshard(docs: DataFrame, old_shard: Column, old: int, new: int) -> DataFrame:
    """Per row: doc_id, size, text_crc32, old_shard, block, shard, slot, with shard sizes in bytes near equal. Equal texts
    of one old shard go to one new shard, unless they are too many for near equal sizes.

    A null text counts as no bytes. A row with null doc_id is placed like any other. Repeated rows each get a
    place of their own. old_shard is an integer expression over docs' columns in 0..old-1."""
    size = (F.octet_length(text_of()) + 1).cast("long")
    if CLASSES * old > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS // CLASSES} old shards")
    rows = docs.select("doc_id", size.alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), F.xxhash64(text_of()).alias("text_key"), old_shard.cast("int").alias("old_shard"))
    total = rows.agg(F.sum("size")).first()[0] or 0
    per_class = min(max(MIN_BLOCKS, total // BLOCK_BYTES), MAX_ROWS // (CLASSES * old))
    # There are fewer than new * GROUP_PARTS of them.
    large = rows.groupBy("text_key").agg(F.sum("size").alias("bytes")).filter(F.col("bytes") * (new * GROUP_PARTS) > total).select(F.col("text_key").alias("_key"))
    whole = F.when(F.col("_key").isNull(), F.col("text_key")).otherwise(F.xxhash64("doc_id", "text_key"))
    rows = rows.join(F.broadcast(large), F.col("text_key") == F.col("_key"), "left").withColumn("unit", F.shiftrightunsigned(whole, 1)).drop("_key", "text_key")
    # The block's number names the old shard as well, so that each block lies in one.
    rows = rows.withColumn("block", block_of(F.col("size"), F.col("unit"), per_class) * old + F.col("old_shard"))
    rows = saved(rows, "reshard-rows")
    blocks = rows.groupBy("block", "old_shard").agg(F.sum("size").alias("bytes")).orderBy("block").collect()
    held = [0] * old
    for b in blocks:
        held[b["old_shard"]] += b["bytes"]
    capacity = [total // new + (j < total % new) for j in range(new)]
    flow = min_cost_flow(held, capacity, move_costs(old, new))
    cuts = stretches([(b["block"], b["old_shard"], b["bytes"]) for b in blocks], flow)
    return _numbered(_placed(rows, cuts), new)


def _placed(rows: DataFrame, cuts: list[Stretch]) -> DataFrame:
    spark = rows.sparkSession
    plan = spark.createDataFrame([(c.block, float(c.low), float(c.high), c.shard, k) for k, c in enumerate(cuts)], "block long, low double, high double, shard int, stretch int")
    # The middle byte of a row's unit, which all its rows share.
    ordered = Window.partitionBy("block").orderBy("unit")
    before, through = (F.coalesce(F.sum("size").over(ordered.rangeBetween(Window.unboundedPreceding, to)), F.lit(0)) for to in (-1, 0))
    at = rows.withColumn("middle", (before + through) / 2)
    return at.join(F.broadcast(plan), (at["block"] == plan["block"]) & (F.col("middle") >= F.col("low")) & (F.col("middle") < F.col("high"))).drop(plan["block"], "low", "high", "middle", "unit")


def _numbered(placed: DataFrame, new: int) -> DataFrame:
    """Slots from 0 without gaps in each shard: a stretch is numbered by itself and starts where the last one ended."""
    spark = placed.sparkSession
    start, seen = [], [0] * new
    for r in placed.groupBy("shard", "stretch").count().orderBy("shard", "stretch").collect():
        start.append((r["stretch"], seen[r["shard"]]))
        seen[r["shard"]] += r["count"]
    starts = spark.createDataFrame(start, "stretch int, start long")
    inside = Window.partitionBy("block", "stretch").orderBy("doc_id", "size", "text_crc32")
    return placed.withColumn("n", F.row_number().over(inside)).join(F.broadcast(starts), "stretch").withColumn("slot", F.col("start") + F.col("n") - 1).drop("n", "start", "stretch")


def rewrite(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Rewrites under path (one folder shard=N each) the shards that gain or lose a row, and no others.

    docs may be read from path itself: the new shards are written beside it, as path.new, before any old one is replaced,
    and stay there if that breaks off. Folders of shards that lose all their rows are removed. Rows that share a doc_id
    and a text take the places of such rows one to one. Returns the shards that it wrote or removed."""
    spark: SparkSession = docs.sparkSession
    touched = sorted(r[0] for r in placed.filter("shard <> old_shard").select(F.explode(F.array("shard", "old_shard")).alias("s")).distinct().collect())
    if not touched:
        return []
    held = {r[0] for r in placed.select("shard").distinct().collect()}
    nth = lambda *order: F.row_number().over(Window.partitionBy("_id", "_crc").orderBy(*order))
    place = placed.select(F.col("doc_id").alias("_id"), F.col("text_crc32").alias("_crc"), F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), F.col("block").alias("_block"))
    place = place.withColumn("_nth", nth("_shard", "_slot")).filter(F.col("_shard").isin(touched))
    own = docs.drop("shard", "slot").withColumns({"_id": F.col("doc_id"), "_crc": F.crc32(text_of().cast("binary"))}).withColumn("_nth", nth("text"))
    both = own.alias("d").join(place.alias("p"), F.col("d._id").eqNullSafe(F.col("p._id")) & (F.col("d._crc") == F.col("p._crc")) & (F.col("d._nth") == F.col("p._nth")))
    out = both.select(*(F.col(f"d.{c}") for c in docs.columns if c not in ("shard", "slot")), F.col("p._shard").alias("shard"), F.col("p._slot").alias("slot"), F.col("p._block").alias("_block"))
    beside = path.rstrip("/") + ".new"
    out.repartition("shard", "_block").drop("_block").write.mode("overwrite").partitionBy("shard").parquet(beside)
    before = spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        spark.read.schema(out.drop("_block").schema).parquet(beside).write.mode("overwrite").partitionBy("shard").parquet(path)
    finally:
        spark.conf.set("spark.sql.sources.partitionOverwriteMode", before)
    for gone in [f"{path}/shard={s}" for s in touched if s not in held] + [beside]:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(gone)
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
    return touched


#: The query's layouts: from 12 shards by hash of the text to 16.
OLD_SHARDS, NEW_SHARDS = 12, 16


def shard_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot, grown_shard, old_shard.

    Null text has no bytes. Rows with null doc_id and repeated rows get places of their own; an empty table gives none."""
    out = reshard(docs, F.pmod(F.xxhash64(text_of()), F.lit(OLD_SHARDS)), OLD_SHARDS, NEW_SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
