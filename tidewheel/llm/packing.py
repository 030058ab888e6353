"""Best-fit packing after Martello-Toth dominance reduction.

Documents become token ids with an end id; longer ones than a sequence are cut. Whether pieces pack well depends on
their lengths alone, and there are at most `capacity` lengths, so the plan is made from a histogram: first the
reduction fixes small sets that dominate every other set with their largest member (no packing gets worse by it),
then best-fit decreasing packs what is left. Equal lengths are handled together, so the plan's size doesn't depend
on the number of documents. The pieces themselves never leave the executors: each is numbered among its length and
finds its sequence by that number.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, saved, text_of

CAPACITY = 1024
END_ID = 2
#: Runs of so much white space are left to the tokenizers library.
BLANK = 5_000
#: Pieces numbered together, about.
NUMBERED_TOGETHER = 100_000


@dataclass(frozen=True)
class Pattern:
    """A sequence's lengths in order, and how many sequences look like this."""

    lengths: tuple[int, ...]
    copies: int


def _sums(sizes: list[int], capacity: int) -> int:
    """Bit s is set if s is a sum of two or more of the sizes, each used any number of times."""
    full = (1 << (capacity + 1)) - 1
    any_sum = 1
    for s in sizes:
        step = s
        while step <= capacity:
            any_sum |= (any_sum << step) & full
            step *= 2
    some, out = any_sum & ~1, 0
    for s in sizes:
        out |= some << s
    return out & full


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Pattern], dict[int, int]]:
    """The sets that the reduction fixes, and the counts that remain.

    With j the largest item of a set and r the room beside it, a set is fixed if every other set with j could swap
    its other items for it: {j} if nothing fits beside j; {j, k} if k fills r, or if k is the largest that fits and
    no sum of two or more items lies in (k, r]; {j, a, b} if three others never fit, a is the largest that fits, b
    the largest beside it, and no item lies in (b, r / 2]."""
    left = {s: n for s, n in counts.items() if n}
    fixed: list[Pattern] = []
    changed, stale, sums = True, True, 0
    while changed:
        changed = False
        for j in sorted(left, reverse=True):
            while left.get(j):
                if stale:
                    sizes, stale = sorted(left), False
                    sums = _sums(sizes, capacity)
                r = capacity - j
                fit = [s for s in sizes if s <= r and left[s] - (s == j) > 0]
                if not fit:
                    take = (j,)
                elif (k := fit[-1]) == r or not (sums & ((1 << (r + 1)) - 1)) >> (k + 1):
                    take = (j, k)
                else:
                    beside = [s for s in fit if s <= r - k and left[s] - (s == j) - (s == k) > 0]
                    if not beside or 3 * fit[0] <= r or any(beside[-1] < s <= r // 2 for s in sizes):
                        break
                    take = (j, k, beside[-1])
                n = min(left[s] // take.count(s) for s in take)
                fixed.append(Pattern(take, n))
                for s in take:
                    left[s] -= n
                for s in set(take):
                    if not left[s]:
                        del left[s]
                        stale = True
                changed = True
    return fixed, left


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing: each piece into the fullest open sequence that has room; equal ones at once."""
    opened: dict[int, dict[tuple[int, ...], int]] = defaultdict(dict)  # room -> lengths -> sequences
    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            room = min((r for r in opened if r >= s), default=None)
            if room is None:
                # Sequences for all that are left: one piece each, or as many as fit when s is small.
                per = capacity // s
                whole, rest = divmod(n, per)
                for lengths, copies in (((s,) * per, whole), ((s,) * rest, 1 if rest else 0)):
                    if copies:
                        at = opened[capacity - sum(lengths)]
                        at[lengths] = at.get(lengths, 0) + copies
                break
            lengths, copies = opened[room].popitem()
            if not opened[room]:
                del opened[room]
            used = min(n, copies)
            if used < copies:
                opened[room][lengths] = copies - used
            at = opened[room - s]
            at[(*lengths, s)] = at.get((*lengths, s), 0) + used
            n -= used
    return [Pattern(lengths, copies) for at in opened.values() for lengths, copies in at.items()]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


#: An encoder per vocabulary in each worker process, which serves many tasks.
_MADE: dict[str, Callable[[str], list[int]]] = {}


def _as_ranks(vocabulary: dict) -> dict[bytes, int] | None:
    """The vocabulary of a tokenizer file as ranks of byte strings, if merging the least rank first is what it does: byte-level
    BPE on the usual split pattern, with ids in the order of its merges."""
    model, before = vocabulary["model"], vocabulary.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if model["type"] != "BPE" or vocabulary.get("normalizer") or not plain or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")):
        return None
    # Byte-level vocabularies write printable Latin-1 bytes as themselves and the others from U+0100 on.
    shown = [k for k in range(256) if 33 <= k <= 126 or 161 <= k <= 172 or 174 <= k]
    byte = {chr(k): k for k in shown} | {chr(256 + n): k for n, k in enumerate(k for k in range(256) if k not in shown)}
    special = {t["content"] for t in vocabulary.get("added_tokens", [])}
    words = {w: k for w, k in model["vocab"].items() if w not in special}
    first = len(words) - len(model["merges"])
    for k, m in enumerate(model["merges"]):
        if words.get("".join(m if isinstance(m, list) else m.split(" "))) != first + k:
            return None
    return {bytes(byte[c] for c in w): k for w, k in words.items()}


def read_vocabulary(path: str) -> dict[bytes, int] | None:
    """A tokenizer file as plain ranks, or None."""
    with open(path, encoding="utf-8") as f:
        return _as_ranks(json.load(f))


def encoder(path: str, ranks: dict[bytes, int] | None) -> Callable[[str], list[int]]:
    """Ids of a text by a tokenizer file (and as read_vocabulary() has it), without special tokens; their strings in a
    text are ordinary text.

    Vocabularies that are plain ranks go through tiktoken, which gives the same ids in less time; others through tokenizers."""
    if path not in _MADE:
        if ranks is not None:
            import public_tokenizers
            import tiktoken

            fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
            # tiktoken's split runs out of stack on very long white space.
            blank = re.compile(rf"\s{{{BLANK}}}").search
            _MADE[path] = lambda text: fast(text) if len(text) < BLANK or not blank(text) else _by_library(path)(text)
        else:
            _MADE[path] = _by_library(path)
    return _MADE[path]


@functools.cache
def _by_library(path: str) -> Callable[[str], list[int]]:
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def cut_points(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, end) of a document's pieces: all of full capacity but the first, which may be shorter."""
    first = length % capacity or min(length, capacity)
    ends = range(first, length + 1, capacity)
    return [(max(0, e - capacity) if k else 0, e) for k, e in enumerate(ends)]


PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32. A null text is empty and so one piece of the end id."""

    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))  # as large as the vocabulary

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks.value)
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py()), end_id], "<u4").tobytes()
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(cut_points(len(ids) // 4, capacity))]
            columns = zip(*rows, strict=True) if rows else [[]] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), text_of().alias("text")).mapInArrow(lean(cut), PIECES)


def numbered(rows: DataFrame, together: int = NUMBERED_TOGETHER) -> DataFrame:
    """rows with n: their number from 0 among those of the same length. Each length is numbered in parts, so that
    one that many pieces share (that of full ones) is no single task."""
    parts = max(16, (rows.count() // together) + 1)
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("length", "part").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    inside = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    return rows.withColumn("k", F.row_number().over(inside)).join(starts, ["length", "part"]).withColumn("n", F.col("before") + F.col("k") - 1).drop("k", "before", "part")


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Repeated rows are packed once each; a null doc_id stays null; an empty table gives no sequences."""
    rows = saved(pieces(docs, path, capacity, end_id), "packing-pieces")
    counts = {r["length"]: r["count"] for r in rows.groupBy("length").count().collect()}
    # length -> (first number, first sequence, place in it, pieces a sequence) of each stretch of equal sequences
    stretches: dict[int, list[tuple[int, int, int, int]]] = defaultdict(list)
    used: dict[int, int] = defaultdict(int)
    sequence = 0
    for p in plan(counts, capacity):
        at = 0
        for s in dict.fromkeys(p.lengths):
            per = p.lengths.count(s)
            stretches[s].append((used[s], sequence, at, per))
            used[s] += per * p.copies
            at += per * s
        sequence += p.copies
    tables = {s: tuple(np.array(x, np.int64) for x in zip(*v, strict=True)) for s, v in stretches.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, n = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "n"))
            sequence_id, offset = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
            for s in np.unique(length):
                of = length == s
                first, seq, at, per = tables[int(s)]
                k = np.searchsorted(first, n[of], side="right") - 1
                copy, place_in = np.divmod(n[of] - first[k], per[k])
                sequence_id[of], offset[of] = seq[k] + copy, at[k] + place_in * s
            kept = [batch.column(batch.schema.get_field_index(c)) for c in ("doc_id", "piece", "start")]
            out = [*kept, pa.array(length.astype(np.int64)), batch.column(batch.schema.get_field_index("ids_crc32")), pa.array(sequence_id), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return numbered(rows).mapInArrow(lean(place), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packing_report(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, by the public byte-level vocabulary.

    Null text counts as empty and is one piece of the end id. Repeated rows, and those with null doc_id, are packed like
    any other; an empty table gives no rows. A text that holds the string of a special token is ordinary text."""
    import public_tokenizers

    return pack(docs, path or public_tokenizers.path("byte_bpe_50k.json"))
