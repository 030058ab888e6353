"""One-permutation MinHash fingerprints.

One pass over a text's shingles (five words) gives each of BINS bins the least hash that falls into it. A bin that
stays empty copies a full one, found by its own fixed sequence of random bins (optimal densification), so that two
texts agree in a bin about as often as their shingle sets overlap. Only the low BITS bits of each bin are kept and
packed; the agreements that chance alone would give are taken out when two fingerprints are compared.

DataFrame functions throughout; no Python runs on the executors.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, saved, words_of

SHINGLE = 5
BIN_BITS = 7
BINS = 1 << BIN_BITS
#: Bits kept of each bin: one byte, two hexadecimal digits.
BITS = 8
#: Tries of an empty bin's own sequence before its full ranking is asked.
TRIES = 10

_BELOW = (1 << (64 - BIN_BITS)) - 1


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _longs(values: list[int]) -> Column:
    """A constant array; as text that the optimizer folds, since a call per element is slow."""
    return F.from_json(F.lit(str(values)), "array<bigint>")


#: The largest hash of each bin, in the order in which signed hashes sort: a bin whose least hash is this is empty.
_LAST = [_signed((b << (64 - BIN_BITS)) | _BELOW) for b in sorted(range(BINS), key=lambda b: _signed(b << (64 - BIN_BITS)))]


def probe(b: int, t: int) -> int:
    """The bin that empty bin b asks at its try t."""
    return hashlib.blake2b(b"%d %d" % (b, t), digest_size=4).digest()[0] % BINS


def shingle_hashes(words: Column) -> Column:
    """Hashes of the runs of SHINGLE words; of the whole, if there are fewer; none without words."""

    def runs(h: Column) -> Column:
        return F.when(F.size(h) >= SHINGLE, F.transform(F.sequence(F.lit(0), F.size(h) - SHINGLE), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(SHINGLE))))).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return let(F.transform(words, lambda w: F.xxhash64(w)), runs)


def bins(hashes: Column) -> Column:
    """Per bin the low bits of its least hash; null where it has none."""

    def least(s: Column) -> Column:
        first = F.filter(s, lambda h, k: (k == 0) | (F.shiftrightunsigned(h, 64 - BIN_BITS) != F.shiftrightunsigned(F.get(s, k - 1), 64 - BIN_BITS)))
        return F.transform(first, lambda h: F.when(h.bitwiseAND(F.lit(_BELOW)) != _BELOW, h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")))

    return let(F.sort_array(F.concat(hashes, _longs(_LAST))), least)


def densified(raw: Column) -> Column:
    """bins() without nulls: an empty bin takes the first full one of its own sequence. All zero if every bin is empty."""
    tries = [_longs([probe(b, t) for b in range(BINS)]) for t in range(TRIES)]

    def filled(r: Column) -> Column:
        def ranked(b: Column) -> Column:
            # What no try found: the full bin that ranks first for b.
            full = F.filter(F.transform(r, lambda y, c: F.struct(F.xxhash64(b, c).alias("rank"), y.alias("y"))), lambda x: x["y"].isNotNull())
            return F.array_min(full)["y"]

        return F.transform(r, lambda x, b: F.coalesce(x, *(F.get(r, F.get(t, b).cast("int")) for t in tries), ranked(b), F.lit(0)))

    return let(raw, filled)


def fingerprint(text: Column) -> Column:
    """BINS * BITS bits as binary."""
    digits = F.from_json(F.lit(str(["%02X" % k for k in range(1 << BITS)]).replace("'", '"')), "array<string>")
    packed = lambda v: F.unhex(F.array_join(F.transform(v, lambda x: F.get(digits, x)), ""))
    return let(let(text, words_of), lambda w: packed(densified(bins(shingle_hashes(w)))))


def as_text(packed: Column) -> Column:
    return F.lower(F.hex(packed))


def likeness(a: Column, b: Column) -> Column:
    """The estimate of the shingle sets' Jaccard similarity, from two packed fingerprints; null if one is null."""
    chance = 1.0 / (1 << BITS)
    same = let(F.struct(a.alias("a"), b.alias("b")), lambda x: F.size(F.filter(F.sequence(F.lit(1), F.lit(BINS)), lambda i: F.substring(x["a"], i, F.lit(1)) == F.substring(x["b"], i, F.lit(1)))))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), (same / BINS - chance) / (1 - chance)))


def next_ids(docs: DataFrame) -> tuple[DataFrame, bool]:
    """doc_id, next_id and third: the next id in descending order (after the last, the first), and a third of the
    longest text with that doc_id. Null ids have none. With it, whether no id occurs twice.

    The ids are dealt out by ranges and each range is ordered by itself; where one ends, the first id of the next one
    that has any follows. Only a row per range reaches the driver."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.floor(F.length("text") / 3)).alias("third"), F.count("*").alias("rows"))
    dealt = saved(ids.repartitionByRange(F.col("doc_id").desc()).withColumn("range", F.spark_partition_id()), "fingerprint-ids")
    ranges = dealt.groupBy("range").agg(F.max("doc_id").alias("first"), F.max("rows").alias("rows")).collect()
    firsts = sorted((r["range"], r["first"]) for r in ranges)
    after = [(k, firsts[(at + 1) % len(firsts)][1]) for at, (k, _) in enumerate(firsts)]
    follows = docs.sparkSession.createDataFrame(after, "range int, follows long")
    inside = F.lead("doc_id").over(Window.partitionBy("range").orderBy(F.col("doc_id").desc()))
    out = dealt.withColumn("inside", inside).join(F.broadcast(follows), "range").select("doc_id", F.coalesce("inside", "follows").alias("next_id"), "third")
    return out, all(r["rows"] == 1 for r in ranges)


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    Null text counts as empty. Of repeated rows with one doc_id, the one that sorts first is the next document of
    another. A row without doc_id has no next document: its edited text is cut short, and near_next is null."""
    known = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null").withColumn("packed", fingerprint(F.col("text")))
    order, single = next_ids(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    order = order.withColumnRenamed("doc_id", "for_id")
    # Both joins read the documents dealt out by doc_id, which Spark writes once and uses twice.
    given = known.join(order, known["doc_id"] == order["next_id"]).select("for_id", F.struct(F.substring("text", F.lit(1), F.col("third").cast("int")).alias("head"), F.col("packed").alias("next_packed")).alias("given"))
    if not single:
        given = given.groupBy("for_id").agg(F.min("given").alias("given"))
    rows = known.join(given, known["doc_id"] == given["for_id"], "left").select("doc_id", "text", "packed", "given.head", "given.next_packed")
    lone = docs.filter("doc_id is null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.unionByName(lone.withColumns({"packed": fingerprint(F.col("text")), "head": F.lit(""), "next_packed": F.lit(None).cast("binary")}))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("head", F.lit(1), third))
    # Through a one-element array, so that the edited text and its fingerprint are made once for all that use them.
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), "packed", "next_packed", F.explode(F.array(edited)).alias("edited"))
    rows = rows.select("doc_id", "n_chars", "packed", "next_packed", F.explode(F.array(F.struct(F.sha2("edited", 256).alias("sha"), fingerprint(F.col("edited")).alias("packed")))).alias("e"))
    return rows.select(
        "doc_id", "n_chars", F.col("e.sha").alias("edited_sha256"), as_text(F.col("packed")).alias("fingerprint"), as_text(F.col("e.packed")).alias("edited_fingerprint"),
        likeness(F.col("packed"), F.col("e.packed")).alias("near_edited"), likeness(F.col("packed"), F.col("next_packed")).alias("near_next"),
    )
