"""Byte-level BPE: ranked merges folded by Spark's higher-order functions over the corpus's distinct words.

A word (a match of the split pattern) starts as its bytes; a fold merges, again and again, the neighbours whose joined
bytes rank lowest in a literal rank map, until no neighbours are in the map. Each distinct word of the corpus is folded
once:

1. Chunks. A pass over the documents writes each text as codes into the dictionary of its chunk, which is a bounded
   stretch of one partition. The table is bucketed by chunk.
2. Words. The dictionaries' words are dealt out by hash, so that a word of many chunks is folded in one place and once,
   and what it folds to goes back to its chunks.
3. Texts. Each chunk's codes and ids meet, where the table's buckets spare the texts a shuffle.

Decoding joins the bytes of the ids' pieces, as a column. Words over FOLDED bytes, whose fold would take quadratic
time, are merged in n log n by a heap, by the same rule.
"""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import let, saved_by, text_of

#: A chunk ends at so many distinct words or bytes of text, whichever comes first. They bound a task's memory.
CHUNK_WORDS, CHUNK_BYTES = 400_000, 32 << 20
#: Bytes of the longest words that are folded.
FOLDED = 256
#: Rows whose ids are packed together on their way back to the chunks.
PACKED = 400_000
#: Buckets of the rank map, a power of two.
BUCKETS = 1 << 16
#: A slot of the fold: the rank of a pair of neighbours, where its right part, its left part and its end begin.
PLACE = 15
RANK = 3 * PLACE
NO_RANK = (1 << 17) - 1
#: The slot of two parts that are one by now.
GONE = (1 << 63) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal(value: object, schema: str) -> Column:
    """A constant from JSON, which the optimizer folds; building it element by element would take a call each."""
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), schema)


class Coder:
    """Columns that encode and decode by one rank file."""

    def __init__(self, spark: SparkSession, ranks: dict[bytes, int], pattern: str):
        self.spark = spark
        self.ranks, self.split = ranks, pattern
        by_id = sorted((n, b) for b, n in ranks.items())
        if [n for n, _ in by_id] != list(range(len(by_id))) or len(by_id) >= NO_RANK:
            raise ValueError("ranks are 0, 1, 2, ... without gaps, and fewer than 131,071")
        if missing := [k for k in range(256) if bytes([k]) not in ranks]:
            raise ValueError(f"bytes without a rank: {missing}")
        buckets: list[dict[str, int] | None] = [None] * BUCKETS
        for n, b in by_id:
            s = zlib.crc32(b) % BUCKETS  # as rank() finds it
            buckets[s] = (buckets[s] or {}) | {b.hex().upper(): n}
        self.buckets = _literal(buckets, "array<map<string,int>>")
        self.pieces = _literal([b.hex().upper() for _, b in by_id], "array<string>")

    @staticmethod
    def _rank(buckets: Column, code: Column) -> Column:
        return F.try_element_at(F.get(buckets, F.crc32(code).bitwiseAND(F.lit(BUCKETS - 1)).cast("int")), F.hex(code))

    def _fold(self, buckets: Column, word: Column) -> Column:
        """Ids of a word given by its bytes, two at least.

        The accumulator has a slot for each boundary between bytes, which tells of the parts left and right of it. The
        least slot is the pair to merge, the leftmost of equal ones; it goes, and the slots at the pair's two ends, whose
        parts grew, get new ranks."""
        part = lambda a, z: F.substring(word, a + 1, z - a)
        slot = lambda a, m, z: F.shiftleft(F.coalesce(self._rank(buckets, part(a, z)), F.lit(NO_RANK)).cast("long"), RANK) + F.shiftleft(m.cast("long"), 2 * PLACE) + F.shiftleft(a.cast("long"), PLACE) + z
        of = lambda x, k: F.shiftright(x, k * PLACE).bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")
        left, middle, end = (lambda x: of(x, 1)), (lambda x: of(x, 2)), (lambda x: of(x, 0))

        def merge(acc: Column, _: Column) -> Column:
            def joined(p: Column) -> Column:
                # The boundary at byte k is slot k - 1.
                return F.transform(acc, lambda x, k: (
                    F.when((k < p["before"]) | (k > p["after"]), x).when(k == p["at"], F.lit(GONE))
                    .when(k == p["before"], slot(left(x), p["a"], p["z"])).when(k == p["after"], slot(p["a"], p["z"], end(x))).otherwise(x)))

            place = lambda x: F.struct(left(x).alias("a"), end(x).alias("z"), (left(x) - 1).alias("before"), (middle(x) - 1).alias("at"), (end(x) - 1).alias("after"))
            return let(F.array_min(acc), lambda low: F.when(low >= F.lit(NO_RANK << RANK), acc).otherwise(let(place(low), joined)))

        size = F.length(word)
        start = F.transform(F.sequence(F.lit(1), size - 1), lambda k: slot(k - 1, k, k + 1))
        # The last of size - 1 merges would make the whole word, which isn't in the map.
        done = F.aggregate(F.sequence(F.lit(2), F.greatest(size - 1, F.lit(2))), start, merge)

        def ids(left_over: Column) -> Column:
            last = let(F.element_at(left_over, -1), lambda x: self._rank(buckets, part(middle(x), end(x))))
            return F.concat(F.transform(left_over, lambda x: self._rank(buckets, part(left(x), middle(x)))), F.array(last))

        return let(F.filter(done, lambda x: x != GONE), ids)

    def ids(self, word: Column) -> Column:
        """Ids of one word that isn't empty. The map is bound once; each mention of it would be a copy in the plan."""

        def of(b: Column) -> Column:
            whole = lambda w: let(self._rank(b, w), lambda r: F.when(r.isNotNull(), F.array(r)).otherwise(self._fold(b, w)))
            return let(F.encode(word, "UTF-8"), whole)

        return let(self.buckets, of)

    def decoded(self, ids: Column) -> Column:
        """The bytes of an array of ids: their pieces, joined."""
        return F.unhex(let(self.pieces, lambda p: F.array_join(F.transform(ids, lambda x: F.get(p, x)), "")))

    def encode(self, docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
        """docs' columns `keep`, ids (array<int>) and ids_le (the same as little-endian 32-bit numbers).

        Null text counts as empty, which has no ids. Repeated rows are encoded once each; an empty table gives none."""
        partitions = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        coded = saved_by(chunks(docs, keep, self.split, 4 * partitions), "bpe-chunks", "chunk", docs.rdd.getNumPartitions())
        words = coded.filter("packs is not null").select("chunk", F.explode("packs").alias("p")).select("chunk", "p.*").repartition(partitions, "share")
        words = words.select("chunk", "share", "at", F.posexplode("words").alias("k", "word")).select("chunk", "share", (F.col("at") + F.col("k")).alias("k"), "word")
        # Within one share, which is what rows are dealt out by.
        same = Window.partitionBy("share", "word").orderBy("chunk")
        once = words.withColumn("n", F.row_number().over(same)).withColumn("folded", F.when(F.col("n") == 1, self.ids(F.col("word"))))
        back = once.select("chunk", "k", F.first("folded", ignorenulls=True).over(same.rowsBetween(Window.unboundedPreceding, 0)).alias("ids"))
        blocks = back.mapInArrow(_packed, "chunk long, block binary")
        ranks = self.spark.sparkContext.broadcast(self.ranks)  # as large as the vocabulary
        schema = StructType([*docs.select(*keep).schema, *StructType.fromDDL("ids array<int>, ids_le binary")])

        def run(own: pa.Table, dictionary: pa.Table) -> pa.Table:
            long = next((x for x in own.column("long").to_pylist() if x), [])
            lengths, flat = _dictionary([np.frombuffer(zlib.decompress(b), np.int32) for b in dictionary.column("block").to_pylist()], [merged(w.encode(), ranks.value) for w in long])
            starts = np.cumsum(lengths) - lengths
            out = [_texts(b, lengths, starts, flat, keep) for b in own.to_batches(max_chunksize=500)]
            return pa.Table.from_batches(out) if out else pa.Table.from_batches([], pa.schema([*(own.schema.field(c) for c in keep), ("ids", pa.list_(pa.int32())), ("ids_le", pa.binary())]))

        return coded.select("chunk", *keep, "codes", "long").groupBy("chunk").cogroup(blocks.groupBy("chunk")).applyInArrow(run, schema)


class _Codes(dict):
    """Word -> its number in a chunk, as they come; words over FOLDED bytes count down from -1."""

    def __init__(self) -> None:
        super().__init__()
        self.long: list[str] = []

    def __missing__(self, word: str) -> int:
        if len(word) > FOLDED // 4 and len(word.encode()) > FOLDED:
            self.long.append(word)
            k = -len(self.long)
        else:
            k = len(self) - len(self.long)
        self[word] = k
        return k


def chunks(docs: DataFrame, keep: tuple[str, ...], split: str, shares: int) -> DataFrame:
    """Per row of docs: chunk, the columns `keep`, codes (its words' numbers in the chunk's dictionary); in one row of
    each chunk packs, the dictionary's words by share (a hash) with the number of the first, and long, the words that
    aren't folded: the code of the k-th is -k."""
    added = StructType.fromDDL("codes array<int>, long array<string>, packs array<struct<share:int,at:int,words:array<string>>>")
    schema = StructType([*docs.select(F.lit(0).cast("long").alias("chunk"), *keep).schema, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        find = regex.compile(split).findall
        seen, number = _Codes(), 0
        held: list[tuple[pa.RecordBatch, np.ndarray, list[np.ndarray]]] = []

        def closed() -> Iterator[pa.RecordBatch]:
            words = [w for w, k in seen.items() if k >= 0]
            share = np.fromiter((zlib.crc32(w.encode()) % shares for w in words), np.int64, len(words))
            order = np.argsort(share, kind="stable")
            new = np.empty(len(words) + len(seen.long), np.int32)
            new[order], new[len(words) :] = np.arange(len(words)), np.arange(-len(seen.long), 0)
            firsts = np.flatnonzero(np.diff(share[order], prepend=-1))
            own = [{"share": int(share[order[a]]), "at": int(a), "words": [words[k] for k in order[a:z]]} for a, z in zip(firsts, [*firsts[1:], len(words)][: len(firsts)], strict=True)]
            for at, (batch, sizes, codes) in enumerate(held):
                n = batch.num_rows
                flat = new[np.concatenate(codes)] if codes else np.empty(0, np.int32)
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat))
                once = lambda x: [None if at or k else x for k in range(n)]  # noqa: B023, E731
                chunk = pa.array(np.full(n, (batch.column(0)[0].as_py() << 24) + number, np.int64))
                kinds = [pa.list_(pa.string()), pa.list_(pa.struct([("share", pa.int32()), ("at", pa.int32()), ("words", pa.list_(pa.string()))]))]
                columns = [chunk, *batch.columns[1:-1], listed, pa.array(once(seen.long), kinds[0]), pa.array(once(own), kinds[1])]
                yield pa.RecordBatch.from_arrays(columns, ["chunk", *keep, "codes", "long", "packs"])

        size = 0
        for batch in batches:
            begin, sizes, codes = 0, [], []
            for k, text in enumerate(batch.column(batch.num_columns - 1)):
                text = text.as_py()
                found = find(text)
                codes.append(np.fromiter(map(seen.__getitem__, found), np.int32, len(found)))
                sizes.append(len(found))
                size += len(text)
                if len(seen) >= CHUNK_WORDS or size >= CHUNK_BYTES:
                    held.append((batch.slice(begin, k + 1 - begin), np.array(sizes), codes))
                    yield from closed()
                    begin, sizes, codes = k + 1, [], []
                    held, seen, number, size = [], _Codes(), number + 1, 0
            if codes:
                held.append((batch.slice(begin), np.array(sizes), codes))
        if held:
            yield from closed()

    return docs.select(F.spark_partition_id().cast("long").alias("_part"), *keep, text_of().alias("_text")).mapInArrow(run, schema)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, k, ids) as one block for each chunk among PACKED rows: how many, the steps from k to k, how many ids
    each has, and the ids."""
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def told() -> pa.RecordBatch:
        chunk, k, n, ids = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((k, chunk))
        starts = (np.cumsum(n) - n)[order]
        chunk, k, n = chunk[order], k[order], n[order]
        ids = ids[_places(starts, n)]
        cuts = np.flatnonzero(np.diff(chunk, prepend=-1))
        ends, past = [*cuts[1:], len(chunk)], np.concatenate([[0], np.cumsum(n)])
        blocks = [zlib.compress(np.concatenate([[z - a], np.diff(k[a:z], prepend=0), n[a:z], ids[past[a] : past[z]]]).astype(np.int32).tobytes(), 1) for a, z in zip(cuts, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(chunk[cuts]), pa.array(blocks, pa.binary())], ["chunk", "block"])

    rows = 0
    for batch in batches:
        ids = batch.column(2)
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.diff(ids.offsets.to_numpy()), ids.flatten().to_numpy()))
        rows += batch.num_rows
        if rows >= PACKED:
            yield told()
            held, rows = [], 0
    if rows:
        yield told()


def _places(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each of many runs."""
    return np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))


def _dictionary(blocks: list[np.ndarray], long: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word of a chunk has, and all ids in a row; of words that aren't folded the k-th is k-th from the end."""
    words = sum(int(b[0]) for b in blocks)
    lengths = np.zeros(words + len(long), np.int64)
    for j, ids in enumerate(long):
        lengths[-1 - j] = len(ids)
    parts = []
    for b in blocks:
        m = int(b[0])
        k, n = np.cumsum(b[1 : 1 + m]), b[1 + m : 1 + 2 * m].astype(np.int64)
        lengths[k] = n
        parts.append((k, n, b[1 + 2 * m :]))
    starts = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), np.int32)
    for k, n, ids in parts:
        flat[_places(starts[k], n)] = ids
    for j, ids in enumerate(long):
        at = starts[-1 - j]
        flat[at : at + len(ids)] = ids
    return lengths, flat


def _texts(batch: pa.RecordBatch, lengths: np.ndarray, starts: np.ndarray, flat: np.ndarray, keep: tuple[str, ...]) -> pa.RecordBatch:
    """A batch's texts as ids, from their codes."""
    codes = batch.column(batch.schema.get_field_index("codes"))
    of = codes.flatten().to_numpy()
    n = lengths[of]
    ids = flat[_places(starts[of], n)]
    offsets = np.concatenate([[0], np.cumsum(n)])[codes.offsets.to_numpy() - codes.offsets[0].as_py()]
    raw = ids.astype("<u4").tobytes()
    columns = [batch.column(batch.schema.get_field_index(c)) for c in keep]
    listed = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
    return pa.RecordBatch.from_arrays([*columns, listed, pa.array([raw[4 * a : 4 * z] for a, z in zip(offsets, offsets[1:], strict=False)], pa.binary())], [*keep, "ids", "ids_le"])


def merged(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one word by the rule of the fold, in n log n: pairs wait in a heap by rank and place, and parts are chained."""
    if word in ranks:
        return [ranks[word]]
    size = len(word)
    end, before = list(range(1, size + 1)), list(range(-1, size))  # by where a part begins; -1: none before
    pairs: list[tuple[int, int, int, int]] = []

    def offer(a: int) -> None:
        if a >= 0 and end[a] < size:
            m = end[a]
            rank = ranks.get(word[a : end[m]])
            if rank is not None:
                heapq.heappush(pairs, (rank, a, m, end[m]))

    for k in range(size - 1):
        offer(k)
    gone = bytearray(size)
    while pairs:
        _, a, m, z = heapq.heappop(pairs)
        if gone[a] or end[a] != m or gone[m] or end[m] != z:
            continue  # a part has grown since
        gone[m], end[a] = 1, z
        if z < size:
            before[z] = a
        offer(before[a])
        offer(a)
    out, k = [], 0
    while k < size:
        out.append(ranks[word[k : end[k]]])
        k = end[k]
    return out


def bpe_report(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null text counts as empty: no tokens, and the hashes of nothing. Repeated rows, and those with null doc_id, are
    encoded like any other; an empty table gives no rows. No text or word is too long."""
    import public_tokenizers

    coder = Coder(docs.sparkSession, read_ranks(path or public_tokenizers.path("byte_bpe_50k.tiktoken")), pattern or public_tokenizers.PATTERN)
    out = coder.encode(docs)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2("ids_le", 256).alias("ids_sha256"), F.sha2(coder.decoded(F.col("ids")), 256).alias("decoded_sha256"))
