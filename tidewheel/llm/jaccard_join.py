"""N-gram Jaccard join: a size-aware heavy-light join, and the components of its links.

Sets with the same shingles are one node. Two nodes link when 100 * intersection >= percent * union, so the smaller
has at least percent / 100 of the larger's size and they share `need(a, b)` shingles.

* Light sets (up to a boundary size) enumerate their subsets of exactly that many shingles; two that link share one.
* Heavy sets scan inverted lists: of each set only the prefix is listed, its first n - ceil(percent * n / 100) + 1
  shingles in one global order, in which shingles of crowded cells of a corpus-wide count come last.
* The boundary is the size at which enumerating costs more than scanning, from the sizes and lists at hand.

Both give groups: (key, nodes that may link). A group isn't expanded into pairs. In each round it picks a few pivots
that are compared with its other members; members that are in one component by then need no comparison among
themselves, and a pivot has met everyone and leaves. Rounds end when each group's rest is in one component, so every
link between different texts is either found or inside a component that other links have made.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, TASK_TEXTS, in_few, lean, saved, text_of
from .substring_dedup import Hashes, run_hashes, signed

SHINGLE, PERCENT = 4, 85
#: Cells of the corpus-wide count of shingles, a fixed number; in so many chunks.
CELL_BITS, CHUNKS = 20, 16
#: A cell this far above the mean, in standard deviations and then in shingles, is crowded.
DEVIATIONS, ABOVE = 6, 32
#: Sizes that may be light.
MAX_LIGHT = 24
#: Comparisons of a group in the first round after the heads: all its pairs up to this many, and PIVOTS for each
#: member beyond; each later round allows so many times more, since what didn't merge by then seldom does.
FREE_PAIRS, PIVOTS, GROWTH = 4096, 8, 4
#: 64-bit words of the brief sketch, which groups carry.
BRIEF = 4
#: Edges whose components one task finds; of more, joins do.
TASK_EDGES = 100_000
#: Pairs of texts that a task compares, at least.
TASK_PAIRS = 2_000


def need(a: int, b: int, percent: int = PERCENT) -> int:
    """Shingles that sets of these sizes must share: o / (a + b - o) >= percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int = PERCENT) -> int:
    return n - -(-percent * n // 100) + 1


def partners(n: int, most: int, percent: int = PERCENT) -> range:
    return range(max(1, -(-percent * n // 100)), min(most, 100 * n // percent) + 1)


def subset_sizes(n: int, most: int, percent: int = PERCENT) -> list[int]:
    return sorted({need(n, m, percent) for m in partners(n, most, percent)})


def shingle_set(text: bytes, hashes: Hashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles: of all its words, if it has fewer than one takes; none without."""
    words = hashes.of(text.lower().split())  # bytes: A-Z and white space are ASCII's
    if len(words) >= shingle:
        return np.unique(run_hashes(words, shingle))
    return run_hashes(words, len(words)) + np.uint64(len(words)) if len(words) else words


def node_of(s: np.ndarray) -> int:
    """The id of a set, 63 bits of a digest."""
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little") >> 1


def sketch(s: np.ndarray) -> np.ndarray:
    """Parities of a set: each member flips the bit that its hash names, of 2 to 4 bits a member, a power of two."""
    bits = max(64 * BRIEF, 1 << (2 * len(s)).bit_length())
    flips = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((flips & 1).astype(bool), bitorder="little").view(np.uint64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """A sketch as one of fewer words has it."""
    return np.bitwise_xor.reduce(x.reshape(-1, words), axis=0)


def may_overlap(a: bytes, n_a: int, b: bytes, n_b: int, percent: int = PERCENT) -> bool:
    """False if the sketches prove that the sets share too little: a bit in which they differ takes a member that only
    one has, so there are at least as many of these."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    words = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, words) ^ folded(y, words)).sum()) <= n_a + n_b - 2 * need(n_a, n_b, percent)


def crowded_cells(docs: DataFrame) -> np.ndarray:
    """Which cells hold unusually many of all documents' shingles; cells are a fixed number, however large the corpus."""
    size = 1 << CELL_BITS
    part = size // CHUNKS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, total, task = Hashes.of_worker(), np.zeros(size, np.uint32), 0
        for batch in batches:
            task = batch.column(0)[0].as_py() if batch.num_rows else task
            texts = batch.column(1).to_pylist()
            for at in range(0, len(texts), 1000):
                sets = [shingle_set(t, hashes) for t in texts[at : at + 1000]]
                total += np.bincount((np.concatenate(sets) >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=size).astype(np.uint32)
        rows = [zlib.compress(total[k * part : (k + 1) * part].tobytes(), 1) for k in range(CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array([task % 997] * CHUNKS, pa.int32()), pa.array(rows, pa.binary())], ["chunk", "task", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(part, np.uint64)
        for raw in table.column("counts").to_pylist():
            x = np.frombuffer(zlib.decompress(raw), np.uint32 if len(zlib.decompress(raw)) == 4 * part else np.uint64)
            total += x.astype(np.uint64)
        return pa.table({"chunk": pa.array([table.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    # Two steps, so that a group holds about the root of the number of tasks.
    counted = docs.select(F.spark_partition_id(), text_of().cast("binary")).mapInArrow(lean(count), "chunk int, task int, counts binary")
    some = in_few(counted.groupBy("chunk", "task").applyInArrow(add, "chunk int, counts binary"), CHUNKS)
    whole = in_few(some.groupBy("chunk").applyInArrow(add, "chunk int, counts binary"), CHUNKS).collect()
    total = np.zeros(size, np.uint64)
    for r in whole:
        total[r["chunk"] * part : (r["chunk"] + 1) * part] = np.frombuffer(zlib.decompress(r["counts"]), np.uint64)
    mean = total.mean()
    return total > mean + DEVIATIONS * math.sqrt(mean) + ABOVE


def set_rows(docs: DataFrame, crowded: np.ndarray, percent: int) -> DataFrame:
    """Per row: doc_id, n (the set's size), node, prefix, for small sets all of their shingles, the sketch, and the
    sketch in BRIEF words."""
    bits = docs.sparkSession.sparkContext.broadcast(np.packbits(crowded))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late, hashes = np.unpackbits(bits.value).astype(bool), Hashes.of_worker()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, nodes, prefixes, smalls, sketches, briefs = [], [], [], [], [], []
                for text in batch.column(1).to_pylist():
                    s = shingle_set(text, hashes)
                    last = late[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)]
                    n.append(len(s))
                    nodes.append(node_of(s))
                    prefixes.append(np.concatenate([s[~last], s[last]])[: prefix_length(len(s), percent) if len(s) else 0].view(np.int64))
                    smalls.append(s.view(np.int64) if len(s) <= MAX_LIGHT else None)
                    x = sketch(s)
                    sketches.append(x.tobytes())
                    briefs.append(folded(x, BRIEF).view(np.int64))
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), pa.array(prefixes, longs), pa.array(smalls, longs), pa.array(sketches, pa.binary()), pa.array(briefs, longs)], ["doc_id", "n", "node", "prefix", "small", "sketch", "brief"])

    return docs.select(F.col("doc_id").cast("long"), text_of().cast("binary")).mapInArrow(lean(run), "doc_id long, n long, node long, prefix array<long>, small array<long>, sketch binary, brief array<long>")


def light_boundary(nodes: DataFrame, percent: int) -> int:
    """The largest size that enumerates subsets, at the least cost for all sets up to MAX_LIGHT. A subset costs a row;
    a prefix shingle costs one and as many comparisons as its list has other members, on average."""
    small = nodes.filter(f"n <= {MAX_LIGHT} and n > 0")
    sizes = {r["n"]: r["count"] for r in small.groupBy("n").count().collect()}
    lists = small.select(F.explode("prefix").alias("key")).groupBy("key").count().agg(F.sum(F.col("count") * F.col("count")), F.sum("count")).first()
    length = (lists[0] or 1) / (lists[1] or 1)

    def cost(boundary: int) -> float:
        light = sum(c * sum(math.comb(n, t) for t in subset_sizes(n, boundary, percent)) for n, c in sizes.items() if n <= boundary)
        return light + sum(c * prefix_length(n, percent) * length for n, c in sizes.items() if n > boundary)

    return min(range(MAX_LIGHT + 1), key=cost)


def groups(nodes: DataFrame, boundary: int, percent: int) -> DataFrame:
    """key, node, n, pos (place in the prefix): those with a common key may link."""

    def subsets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, keys = [], []
            for node, n, small in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for t in subset_sizes(n, boundary, percent):
                    new = [hashlib.blake2b(np.array(c, np.int64).tobytes(), digest_size=8, salt=b"%d" % t).digest() for c in itertools.combinations(small, t)]
                    keys += new
                    out += [(node, n)] * len(new)
            columns = zip(*out, strict=True) if out else [[], []]
            node, n = (pa.array(list(c), pa.int64()) for c in columns)
            yield pa.RecordBatch.from_arrays([signed(np.frombuffer(b"".join(keys), np.uint64)), node, n], ["key", "node", "n"])

    lists = nodes.filter(F.col("n") * 100 >= percent * (boundary + 1)).select(F.posexplode("prefix").alias("pos", "key"), "node", "n").select("key", "node", "n", "pos")
    light = nodes.filter((F.col("n") > 0) & (F.col("n") <= boundary)).select("node", "n", "small").mapInArrow(lean(subsets), "key long, node long, n long").withColumn("pos", F.lit(0))
    return lists.unionByName(light)


def may_link(other: str, percent: int) -> Column:
    """Of a member and another whose columns begin with `other`: by size; by place, as a pair that links shares a
    shingle among the first n - need + 1 of both; and by the brief sketches, which differ in no more bits than the
    sets may in members."""
    n, o_n = F.col("n"), F.col(f"{other}_n")
    t = F.ceil(F.lit(percent) * (n + o_n) / (100 + percent))
    differ = sum(F.bit_count(F.get("brief", F.lit(k)).bitwiseXOR(F.get(f"{other}_brief", F.lit(k)))) for k in range(BRIEF))
    return (F.least(n, o_n) * 100 >= F.greatest(n, o_n) * percent) & (F.col("pos") <= n - t) & (F.col(f"{other}_pos") <= o_n - t) & (differ <= n + o_n - 2 * t)


def possible(pairs: DataFrame, sketches: DataFrame, percent: int, count: int) -> DataFrame:
    """The pairs (a, b), so many of them, that their sketches (node, n, sketch) don't rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [may_overlap(x, n, y, m, percent) for n, x, m, y in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4, 5)), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    side = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"{c}_n"), F.col("sketch").alias(f"{c}_sketch"))
    both = in_few(in_few(pairs.join(side("b"), "b"), count).join(side("a"), "a"), count)
    return both.select("a", "b", "a_n", "a_sketch", "b_n", "b_sketch").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame, percent: int, count: int) -> DataFrame:
    """The pairs (a, b), so many of them, that link, by their whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = Hashes.of_worker(), (None, None)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keep = []
                for a, text, other in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
                    if known[0] != a:
                        known = (a, shingle_set(text.as_py(), hashes))
                    x, y = known[1], shingle_set(other.as_py(), hashes)
                    o = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * o >= percent * (len(x) + len(y) - o))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    # Both joins read the texts dealt out by node, which Spark writes once.
    one = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("b_text")), "b")
    both = in_few(in_few(one, count, TASK_PAIRS).join(texts.select(F.col("node").alias("a"), F.col("text").alias("a_text")), "a"), count, TASK_PAIRS)
    return both.select("a", "b", "a_text", "b_text").mapInArrow(lean(run), "a long, b long")


def stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """node, label of all edges (a, b) of a task, label being the least node of the component."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while x in up:
            up[x] = y = up.get(up[x], up[x])
            x = y
        return x

    for batch in batches:
        for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    label = {x: root(x) for x in list(up)}
    label |= {x: x for x in set(label.values())}
    yield pa.RecordBatch.from_arrays([pa.array(list(label), pa.int64()), pa.array(list(label.values()), pa.int64())], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """node, label for each node of edges (a, b): label is the least node of its component. One task goes through up to
    TASK_EDGES edges. Of more, stars are hooked to smaller ones, larger neighbours first and then smaller, until nothing
    changes; a node of many edges is no more than an aggregate's key."""
    if edges.count() <= TASK_EDGES:
        return edges.select("a", "b").coalesce(1).mapInArrow(lean(stars), "node long, label long")
    edges = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "join-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        new = saved(small, "join-edges")
        # Done when every node hangs on one that hangs on none.
        hung = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi")
        twice = new.groupBy("a").count().filter("count > 1")
        edges = new
        if hung.isEmpty() and twice.isEmpty():
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots.withColumn("label", F.col("node")))


def linked_components(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id: the least doc_id reachable over links, its own included.

    Rows without words or text link with nothing: their component is their own doc_id. Repeated rows and copies share
    a node; of a component whose rows have no doc_id at all the id is null. An empty table gives no rows."""
    total = docs.count()
    docs = in_few(docs, total, TASK_TEXTS)
    rows = saved(set_rows(docs, crowded_cells(docs), percent), "join-sets")
    lows = rows.filter("n > 0").groupBy("node").agg(F.min("doc_id").alias("low"), F.count("*").alias("rows"))
    lows = saved(in_few(lows, total), "join-nodes")
    again = lows.filter("rows > 1").select(F.col("node").alias("_node"), "low")
    if again.count() <= BROADCAST_IDS:
        again = F.broadcast(again)
    listed = rows.filter("n > 0").join(again, F.col("node") == F.col("_node"), "left").filter(F.col("low").isNull() | (F.col("doc_id") == F.col("low")))
    members = groups(listed.select("node", "n", "prefix", "small"), light_boundary(listed, percent), percent)
    common = members.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1").select("key")
    common = saved(members.join(common, "key"), "join-common")
    grouped = saved(_one_per_membership(common, common.count()), "join-groups")
    count = grouped.count()
    sketches = listed.select("node", "n", "sketch", "brief").join(in_few(grouped.select("node").distinct(), count), "node", "left_semi").dropDuplicates(["node"])
    sketches = saved(in_few(sketches, count), "join-sketches")
    active = saved(in_few(grouped.join(sketches.select("node", "brief"), "node"), count), "join-active")
    # The first round's pivot is each group's least node.
    first = active.filter("node = head").select("key", F.col("n").alias("head_n"), F.col("pos").alias("head_pos"), F.col("brief").alias("head_brief"))
    pairs = active.join(first, "key").filter("node <> head").filter(may_link("head", percent)).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    pairs = saved(in_few(pairs, count), "join-pairs")
    unique = in_few(docs.groupBy("doc_id").count().filter("count > 1"), total).isEmpty()

    def linked(pairs: DataFrame) -> DataFrame:
        """The pairs that link: by sketch first, then by text."""
        left = saved(possible(pairs, sketches, percent, pairs.count()), "join-possible")
        few = left.count()
        wanted = in_few(left.select(F.explode(F.array("a", "b")).alias("node")).distinct(), few)
        wanted = saved(in_few(lows.select("node", "low").join(F.broadcast(wanted) if 2 * few <= BROADCAST_IDS else wanted, "node"), 2 * few), "join-wanted")
        return saved(verified(left, saved(_texts(docs, wanted, unique), "join-texts"), percent, few), "join-links")

    links = linked(pairs)
    tried, labels = pairs, _labels(links)
    active = active.filter("node <> head").drop("head")
    for k in itertools.count():
        active, pairs = _next_round(active, labels, tried, percent, GROWTH**k)
        if active is None:
            break
        if pairs.isEmpty():
            continue
        new = linked(pairs)
        tried = tried.unionByName(pairs)
        if not new.isEmpty():
            links = links.unionByName(new)
            labels = _labels(links)
    labels = labels.select(F.col("node").alias("_node"), "label")
    named = lows.join(labels, F.col("node") == F.col("_node"), "left").select("node", "low", F.coalesce("label", "node").alias("label"))
    lowest = in_few(named.groupBy("label").agg(F.min("low").alias("component")), total)
    ids = in_few(named.join(lowest, "label").select(F.col("node").alias("_node"), "component"), total)
    out = rows.select("doc_id", "n", "node").join(ids, (F.col("node") == F.col("_node")) & (F.col("n") > 0), "left")
    return in_few(out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")), total)


def _labels(links: DataFrame) -> DataFrame:
    """components(), broadcast where they are few."""
    labels = saved(components(links), "join-labels")
    return F.broadcast(labels) if labels.count() <= BROADCAST_IDS else labels


def _one_per_membership(groups: DataFrame, rows: int) -> DataFrame:
    """key, node, n, pos, head: of groups, that have so many rows, with the same nodes one stays, with each node's least place in any of them.
    A passage that a family of texts shares makes many such groups."""
    per = in_few(groups.groupBy("key").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("node")).alias("x"), F.min("node").alias("lo"), F.max("node").alias("hi")), rows)
    stays = per.filter("lo < hi").groupBy("c", "x", "lo", "hi").agg(F.min("key").alias("one"))
    named = in_few(per.join(stays, ["c", "x", "lo", "hi"]).select("key", "one", F.col("lo").alias("head")), rows)
    return in_few(in_few(groups.join(named, "key"), rows).groupBy(F.col("one").alias("key"), "node", "head").agg(F.max("n").alias("n"), F.min("pos").alias("pos")), rows)


def _texts(docs: DataFrame, wanted: DataFrame, unique: bool) -> DataFrame:
    """node, text of the wanted nodes (node, low); unique: no doc_id is repeated."""
    wanted = wanted.select("node", "low")
    few = wanted.count() <= BROADCAST_IDS

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that share a doc_id but not a text drop out here."""
        hashes = Hashes.of_worker()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                keep = [node_of(shingle_set(t.as_py(), hashes)) == n for n, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True)]
                yield batch.filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("low"), text_of().cast("binary").alias("text"))
    out = rows.join(F.broadcast(wanted) if few else wanted, "low").select("node", "text").mapInArrow(lean(own), "node long, text binary")
    return out if unique else out.dropDuplicates(["node"])


def _next_round(active: DataFrame, labels: DataFrame, tried: DataFrame, percent: int, times: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The groups that still have members of different components, and the pairs that their pivots ask for."""
    rows = active.count()
    named = active.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = in_few(named.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y")).filter("x < y").select("key"), rows)
    named = saved(in_few(named.join(mixed, "key"), rows), "join-active")
    rows = named.count()
    if not rows:
        return None, None
    per = in_few(named.groupBy("key", "label").agg(F.count("*").alias("c")), rows)
    most = in_few(per.groupBy("key").agg(F.max(F.struct("c", "label"))["label"].alias("main"), F.sum("c").alias("m")), rows)
    strays = named.join(most, "key").filter("label <> main")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("node"))
    pivots = strays.withColumn("rank", rank).filter(F.col("rank") <= F.greatest(F.lit(PIVOTS * times), F.floor(F.lit(FREE_PAIRS * times) / F.col("m"))))
    pivots = saved(in_few(pivots.select("key", F.col("node").alias("p"), F.col("n").alias("p_n"), F.col("pos").alias("p_pos"), F.col("brief").alias("p_brief"), F.col("label").alias("p_label")), rows), "join-pivots")
    met = named.join(pivots, "key").filter("label <> p_label and node <> p").filter(may_link("p", percent))
    pairs = in_few(met.select(F.least("p", "node").alias("a"), F.greatest("p", "node").alias("b")).distinct(), PIVOTS * rows)
    pairs = in_few(pairs.join(tried, ["a", "b"], "left_anti"), PIVOTS * rows)
    rest = named.drop("label").join(pivots.select("key", F.col("p").alias("node")), ["key", "node"], "left_anti")
    return saved(in_few(rest, rows), "join-active"), saved(pairs, "join-pairs")


#: Shingles as words, all pairs that share one, and reachability.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS sh FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.o >= 85 * (x.n + y.n - o.o)),
r AS (SELECT a AS doc_id, b AS other FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.other = l.a)
SELECT w.doc_id, CAST(coalesce(max(n.n), 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(min(r.other), w.doc_id)) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id GROUP BY w.doc_id
"""
