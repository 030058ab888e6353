"""Substring deduplication on a compacted de Bruijn graph of token k-mers.

A window of `length` words that a document with a smaller id also starts is removed from the later one. Windows are
the graph's edges, from the node of their first length - 1 words to that of their last; those of one document alone
never become edges:

1. Anchors. Of each run of `length` words the k-mer with the least hash is an anchor (a minimiser), so a repeated
   window has the same anchor in the same place in each of its documents. A few per cent of the k-mers are anchors, and
   only windows whose anchor two documents share can repeat.
2. Edges. Windows with a shared anchor are counted; those of two documents or more are edges, each with its source: the
   first document and place that has it.
3. Paths. Nodes with one edge in and one out don't branch. Edges that follow each other through such nodes in their
   source are one stretch, and stretches are chained by joins of pointers that double each round, over rings too.
4. Spans. A join brings each document's windows to their edges; those that run along one path and its source are a span.
5. Source coordinates. A span and its source are compared by digests of their words. Where any differ, hashes have
   collided, and the windows of such edges are grouped by their words instead.

Documents whose whole text is another's are settled before by the text's digest: they would repeat all of its edges.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import REMEMBERING, TASK_TEXTS, having, in_few, joined, keyed, lean, saved, text_of

LENGTH = 50
ANCHOR = 16
#: Distinct words whose hashes a worker remembers, at most.
REMEMBERED = 300_000
_P = np.uint64(0x9E3779B97F4A7C15)


class Hashes(dict):
    """Word -> 64-bit hash, remembered for a worker process's tasks until there are REMEMBERED; many are forgotten as a task ends."""

    _made: ClassVar[list[Hashes]] = []

    @classmethod
    def of_worker(cls) -> Hashes:
        if not cls._made:
            cls._made.append(cls())
            REMEMBERING.append(cls._made[0])
        return cls._made[0]

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the whole; one to one."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of n words, by doubling: runs of 2, 4, 8, ... and what n leaves."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    out, done, run, size = None, 0, words, 1
    while True:
        if n & size:
            # `out` covers `done` words from a place; this run follows them.
            out = run if out is None else _mixed(out[: len(run) - done] * _P + run[done:][: len(out)])
            done += size
        if done == n:
            return out[: len(words) - n + 1]
        run = _mixed(run[:-size] * _P + run[size:])
        size *= 2


def window_anchors(words: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of `length` words the place of its anchor; and the hashes of all k-mers."""
    grams = run_hashes(words, k)
    span = length - k + 1
    if len(words) < length:
        return np.empty(0, np.int64), grams
    # The least of each run of `span` hashes, by doubling; of equal ones the first.
    at = np.arange(len(grams))
    size = 1
    while size * 2 <= span:
        a, b = at[:-size], at[size:]
        at = np.where(grams[b] < grams[a], b, a)
        size *= 2
    rest = span - size
    if rest:
        a, b = at[: len(at) - rest], at[rest:]
        at = np.where(grams[b] < grams[a], b, a)
    return at, grams


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def anchors(docs: DataFrame, length: int, k: int) -> DataFrame:
    """Per row: _row, _doc, n_words, digest of its words, and the hashes of its anchors (each once)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = Hashes.of_worker()
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                counts, digests, found = [], [], []
                for text in batch.column(2).to_pylist():
                    words = text.split()
                    counts.append(len(words))
                    digests.append(hashlib.blake2b(b" ".join(words), digest_size=16).digest())
                    places, grams = window_anchors(hashes.of(words), length, k)
                    found.append(np.unique(grams[np.unique(places)]).view(np.int64) if len(places) else [])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(found, pa.list_(pa.int64()))], ["_row", "_doc", "n_words", "digest", "anchors"])

    return docs.select("_row", "_doc", text_of().cast("binary")).mapInArrow(lean(run), "_row long, _doc long, n_words long, digest binary, anchors array<long>")


def _by_text(docs: DataFrame, wanted: DataFrame, columns: list[str], make, schema: str, together: int = 100) -> DataFrame:
    """make(row, words, *columns) -> rows of schema (as columns), for each row of wanted (_row, unique, and columns)."""
    rows = having(docs, wanted, "_row").select("_row", text_of().cast("binary").alias("_text")).join(wanted.select("_row", *columns), "_row")
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, together):
                batch = whole.slice(at, together)
                parts = [make(row, text.split(), *more) for row, text, *more in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                made = [[x for p in parts for x in p[k]] if isinstance(parts[0][k], list) else np.concatenate([p[k] for p in parts]) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(made, kinds, strict=True)], names)

    return rows.select("_row", "_text", *columns).mapInArrow(lean(run), schema)


def windows_of(docs: DataFrame, by_row: DataFrame, length: int, k: int, bits: int) -> DataFrame:
    """_row, start, edge: the windows whose anchors are among those of by_row (_row, anchors)."""

    def make(row: int, words: list[bytes], wanted: list[int]):
        hashes = Hashes.of_worker().of(words)
        places, grams = window_anchors(hashes, length, k)
        here = np.flatnonzero(np.isin(grams[places], np.array(wanted, np.int64).view(np.uint64)))
        edge = run_hashes(hashes, length)[here] & np.uint64((1 << bits) - 1)
        return np.full(len(here), row, np.int64), here.astype(np.int32), edge.view(np.int64)

    return _by_text(docs, by_row, ["anchors"], make, "_row long, start int, edge long")


def compacted(docs: DataFrame, edges: DataFrame, length: int) -> DataFrame:
    """edges (edge, source, at, rows) with path: edges have the same path if only nodes with one edge in and one out lie
    between them. A path is named by its first edge, a ring by its least."""

    def ends(row: int, words: list[bytes], places: list[dict]):
        nodes = run_hashes(Hashes.of_worker().of(words), length - 1).view(np.int64)
        at = np.array([p["at"] for p in places], np.int64)
        return np.array([p["edge"] for p in places], np.int64), np.full(len(at), row, np.int64), at.astype(np.int32), np.array([p["rows"] for p in places], np.int64), nodes[at], nodes[at + 1]

    n = edges.count()
    by_source = edges.groupBy(F.col("source").alias("_row")).agg(F.collect_list(F.struct("at", "edge", "rows")).alias("places"))
    by_source = saved(in_few(by_source, n), "dedup-sources")
    graph = saved(_by_text(docs, by_source, ["places"], ends, "edge long, source long, at int, rows long, left long, right long"), "dedup-graph")
    side = lambda c, o, i: F.struct(F.col(c).alias("node"), F.lit(o).alias("o"), F.lit(i).alias("i"))
    degrees = graph.select(F.explode(F.array(side("left", 1, 0), side("right", 0, 1))).alias("s")).groupBy("s.node").agg(F.sum("s.o").alias("o"), F.sum("s.i").alias("i"))
    plain = in_few(degrees, 2 * n).filter("o = 1 and i = 1").select(F.col("node").alias("left"), F.lit(True).alias("plain"))
    own = Window.partitionBy("source").orderBy("at")
    yes = lambda c: F.coalesce(c, F.lit(False))
    marked = in_few(graph.join(plain, "left", "left"), n).withColumn("plain", yes(F.col("plain"))).withColumns({
        "begins": ~(F.col("plain") & yes(F.lag("at").over(own) == F.col("at") - 1)),
        "ends": ~yes(F.lead("plain").over(own) & (F.lead("at").over(own) == F.col("at") + 1)),
    })
    stretch = F.last(F.when(F.col("begins"), F.col("edge")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    marked = saved(in_few(marked.withColumn("stretch", stretch), n), "dedup-stretches")
    heads = marked.filter("begins").select("stretch", F.when(F.col("plain"), F.col("left")).alias("node"))
    tails = marked.filter("ends").select(F.col("right").alias("node"), F.col("stretch").alias("before"))
    paths = chained(in_few(heads.join(tails, "node", "left").select("stretch", "before"), n))
    return in_few(marked.select("edge", "source", "at", "rows", "stretch").join(paths, "stretch").drop("stretch"), n)


def chained(links: DataFrame) -> DataFrame:
    """stretch, path for each of links (stretch, the stretch before it or null): path is the stretch that the chain of
    those before leads to, and in a ring the least of all. Pointers double each round, so that n links take log n."""
    far = F.coalesce("before", "stretch")
    t = saved(links.select("stretch", far.alias("root"), F.col("before").isNull().alias("done"), F.least("stretch", far).alias("low")), "dedup-chains")
    left = t.filter("not done").count()
    for _ in range(math.ceil(math.log2(left + 1)) + 1 if left else 0):
        ahead = t.select(F.col("stretch").alias("root"), F.col("root").alias("_root"), F.col("done").alias("_done"), F.col("low").alias("_low"))
        moved = t.filter("not done").join(ahead, "root").select("stretch", F.col("_root").alias("root"), F.col("_done").alias("done"), F.least("low", "_low").alias("low"))
        t = saved(t.filter("done").unionByName(in_few(moved, left)), "dedup-chains")
        if t.filter("not done").isEmpty():
            break
    return t.select("stretch", F.when(F.col("done"), F.col("root")).otherwise(F.col("low")).alias("path"))


def _runs(hits: DataFrame, length: int) -> DataFrame:
    """_row, start, end, source, at, path: hits (_row, start, source, at, path) as spans of words, along one path and source."""
    order = Window.partitionBy("_row").orderBy("start")
    same = lambda c, step: F.col(c) == F.lag(c).over(order) + step
    opens = ~F.coalesce(same("start", 1) & same("at", 1) & same("source", 0) & same("path", 0), F.lit(False))
    runs = hits.withColumn("opens", opens.cast("long")).withColumn("run", F.sum("opens").over(order)).groupBy("_row", "run")
    spans = runs.agg(F.min("start").alias("start"), (F.max("start") + length).alias("end"), F.min("source").alias("source"), F.min("at").alias("at"), F.min("path").alias("path"))
    return spans.drop("run")


def differing(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """The spans whose words aren't those at their source's coordinates."""

    def digests(row: int, words: list[bytes], asked: list[dict]):
        of = [hashlib.blake2b(b" ".join(words[a["start"] : a["end"]]), digest_size=16).digest() for a in asked]
        return [row] * len(asked), [a["start"] for a in asked], [a["end"] for a in asked], of, [a["source"] for a in asked], [a["at"] for a in asked]

    to = F.col("at") + F.col("end") - F.col("start")
    n = spans.count()
    theirs = spans.select(F.col("source").alias("_row"), F.col("at").alias("start"), to.alias("end"), F.lit(None).cast("long").alias("source"), F.lit(None).cast("int").alias("at")).distinct()
    asked = spans.select("_row", "start", "end", "source", "at").unionByName(in_few(theirs, n)).groupBy("_row").agg(F.collect_list(F.struct("start", "end", "source", "at")).alias("asked"))
    made = saved(_by_text(docs, saved(in_few(asked, 2 * n), "dedup-asked"), ["asked"], digests, "_row long, start int, end int, digest binary, source long, at int"), "dedup-digests")
    mine = made.filter("source is not null").withColumn("to", to)
    # Spans of one source and digest are one question, however many documents have them.
    held = made.filter("source is null").select(F.col("_row").alias("source"), F.col("start").alias("at"), F.col("end").alias("to"), F.col("digest").alias("held"))
    wrong = in_few(in_few(mine.select("source", "at", "to", "digest").distinct(), n).join(held, ["source", "at", "to"]), n).filter("digest <> held").drop("held")
    if wrong.isEmpty():
        return spans.limit(0)
    return mine.join(wrong, ["source", "at", "to", "digest"], "left_semi").drop("to", "digest")


def repeated_spans(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, bits: int = 64, unique: bool = True) -> DataFrame:
    """_row, whole and spans: for each row that has any repeated window of a row with smaller _doc, the spans of words
    to remove, as (start, end, source, at, path), in order; whole says that all of them go.

    docs has _row (unique), _doc, text; rows with null _doc repeat nothing. unique: _doc is _row everywhere. bits: of
    the edges' hashes; with few of them edges collide, which costs time and changes no result."""
    docs = docs.filter("_doc is not null")
    seen = saved(anchors(docs, length, k), "dedup-anchors")
    # The first document of each text stands for it; the others go whole, if they have a window at all.
    total = seen.count()
    first = in_few(seen.groupBy("digest").agg(F.min("_row").alias("first"), F.count("*").alias("rows")).filter("rows > 1"), total)
    copies = saved(joined(seen.filter(F.col("n_words") >= length).select("_row", "_doc", "digest"), first, "digest", total).filter("_doc > first").select("_row"), "dedup-copies")
    own = having(seen, copies, "_row", kept=False).select("_row", F.explode("anchors").alias("anchor"))
    n_own = seen.agg(F.sum(F.size("anchors"))).first()[0] or 0
    shared = own.groupBy("anchor").agg(F.min("_row").alias("low"), F.max("_row").alias("high"), F.count("*").alias("rows")).filter("low < high").select("anchor", "rows")
    shared = in_few(shared, n_own)
    by_row = saved(in_few(joined(own, shared, "anchor", n_own).groupBy("_row").agg(F.collect_list("anchor").alias("anchors")), n_own), "dedup-shared")
    windows = saved(windows_of(docs, by_row, length, k, bits), "dedup-windows")
    n_windows = windows.count()
    firsts = windows.groupBy("edge").agg(F.min(F.struct("_row", "start")).alias("s"), F.max("_row").alias("high"), F.count("*").alias("rows")).filter("s._row < high")
    edges = saved(in_few(firsts.select("edge", F.col("s._row").alias("source"), F.col("s.start").alias("at"), "rows"), n_windows), "dedup-edges")
    paths = saved(compacted(docs, edges, length), "dedup-paths")
    later = joined(windows, paths, "edge", n_windows).filter("source < _row").drop("rows")
    if not unique:
        later = later.join(docs.filter("_row <> _doc").select("_row", "_doc"), "_row", "left").filter("source < coalesce(_doc, _row)").drop("_doc")
    hits = saved(later, "dedup-hits")
    spans = saved(in_few(_runs(hits.drop("edge"), length), hits.count()), "dedup-spans")
    wrong = differing(docs, spans)
    if not wrong.isEmpty():
        bad = hits.join(wrong.select("_row", F.col("start").alias("a"), (F.col("end") - length).alias("z")), "_row").filter("start between a and z").select("edge").distinct()
        bad = saved(bad, "dedup-collided")
        sure = hits.join(bad, "edge", "left_anti").drop("edge")
        spans = saved(_runs(sure.unionByName(_by_words(docs, windows.join(bad, "edge"), length)), length), "dedup-spans")
    listed = in_few(spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "source", "at", "path"))).alias("spans")), spans.count())
    return listed.select("_row", F.lit(False).alias("whole"), "spans").unionByName(copies.select("_row", F.lit(True).alias("whole"), F.lit(None).cast(dict(listed.dtypes)["spans"]).alias("spans")))


def _by_words(docs: DataFrame, windows: DataFrame, length: int) -> DataFrame:
    """The hits among windows (_row, start, edge) by their words themselves. A path of such a hit is its edge alone."""

    def texts(row: int, words: list[bytes], starts: list[int]):
        return [row] * len(starts), starts, [b" ".join(words[a : a + length]) for a in starts]

    wanted = saved(windows.groupBy("_row").agg(F.collect_list("start").alias("starts")), "dedup-unsure")
    rows = saved(_by_text(docs, wanted, ["starts"], texts, "_row long, start int, words binary"), "dedup-words")
    low = rows.groupBy("words").agg(F.min(F.struct("_row", "start")).alias("s"), F.count("*").alias("rows"))
    hits = joined(rows, low, "words", rows.count()).join(docs.select("_row", "_doc"), "_row").filter("s._row < _doc")
    return hits.select("_row", "start", F.col("s._row").alias("source"), F.col("s.start").alias("at"), F.xxhash64("words").alias("path"))


def without_spans(docs: DataFrame, spans: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep`, with n_words, n_removed and kept (text: the words that stay, joined by a space).

    docs has _row and text; null text has no words. Only the texts of rows with spans are shuffled."""
    spans = saved(spans, "dedup-cuts")
    none = F.lit(None).cast(dict(spans.dtypes)["spans"])
    text = text_of().cast("binary").alias("_text")
    rest = having(docs, spans, "_row", kept=False).select(*keep, text, F.lit(False).alias("whole"), none.alias("spans"))
    cuts = in_few(having(docs, spans, "_row").select("_row", *keep, text).join(spans, "_row"), spans.count(), TASK_TEXTS)
    rows = rest.unionByName(cuts.drop("_row"))
    schema = docs.select(*keep).schema.add("n_words", "long").add("n_removed", "long").add("kept", "string")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                n, removed, kept = [], [], []
                for text, all_of, gone in zip(*(c.to_pylist() for c in batch.columns[-3:]), strict=True):
                    words = text.split()
                    stay, last = [], 0
                    if not all_of:
                        for s in gone or ():
                            stay += words[last : s["start"]]
                            last = max(last, s["end"])
                        stay += words[last:]
                    n.append(len(words))
                    removed.append(len(words) - len(stay))
                    kept.append(b" ".join(stay))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*keep, "n_words", "n_removed", "kept"])

    return rows.select(*keep, "_text", "whole", "spans").mapInArrow(lean(cut), schema)


def deduplicated(docs: DataFrame, length: int = LENGTH, k: int = ANCHOR, bits: int = 64) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept.

    Of rows that share a doc_id each is cut by what smaller ids have, and none by another. Rows with null doc_id cut
    nothing and come back uncut, but for white space. Null text has no words. An empty table gives no rows."""
    rows, unique = keyed(docs.select(F.col("doc_id").cast("long"), text_of().alias("text")))
    return without_spans(rows, repeated_spans(rows, length, k, bits, unique))


def dedup_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256; nulls, repeated rows and empty tables as in deduplicated()."""
    out = deduplicated(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Windows as they are, without anchors or hashes.
ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 49), ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w WHERE len(ws) >= 50)),
low AS (SELECT run, min(doc_id) AS low FROM win GROUP BY run HAVING min(doc_id) < max(doc_id)),
gone AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT win.doc_id, win.i FROM win JOIN low USING (run) WHERE low.low < win.doc_id), (SELECT unnest(range(0, 50)) AS o)),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT tok.doc_id, string_agg(word, ' ' ORDER BY tok.i) AS t FROM tok LEFT JOIN gone ON tok.doc_id = gone.doc_id AND tok.i = gone.i WHERE gone.i IS NULL GROUP BY tok.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
