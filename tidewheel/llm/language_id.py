"""Language identification by unigrams with the segmentation summed out.

A fixed public vocabulary of pieces gives each language a distribution over pieces. A word's probability is the sum
over all ways to cut it into pieces, found by the forward algorithm; a text's is the product over its words. The
language whose product is largest is the answer and its posterior under equal priors the score.

Fitting counts pieces on at most TRAIN_ROWS labelled documents; scoring reads every whole text. A worker scores each
distinct word once while it remembers it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, text_of

#: Labelled documents that the piece counts are taken from, about at most.
TRAIN_ROWS = 4000
#: Added to each piece's count.
SMOOTHING = 0.05
#: Probability of a character that is no piece, alike in all languages.
UNKNOWN = 1e-7
#: Words a worker remembers, at most.
REMEMBERED = 300_000
START = "▁"
#: Odd, so that codes are spread over 64 bits.
BASE = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _hash(piece: str) -> int:
    h = 0
    for c in piece:
        h = (h * int(BASE) + ord(c) + 1) % (1 << 64)
    return h


def _words(text: str, find=[]) -> list[str]:  # noqa: B006  compiled once a worker
    if not find:
        import regex

        find.append(regex.compile(r"\p{L}[\p{L}\p{M}]*").findall)  # a mark belongs to its letter
    return find[0](text.lower())


class Model:
    """Piece probabilities by language, and the forward algorithm over them."""

    def __init__(self, langs: list[str], pieces: list[str], counts: np.ndarray):
        """counts: one row a piece, one column a language."""
        self.langs = langs
        known = {p: k for k, p in enumerate(pieces)}
        p = (counts + SMOOTHING) / (counts + SMOOTHING).sum(axis=0, keepdims=True) if len(langs) else np.zeros((len(pieces), 0))
        codes = np.array([_hash(x) for x in known], np.uint64)
        order = np.argsort(codes)
        self.codes = codes[order]
        self.p = np.vstack([p[order], np.zeros((1, len(langs)))])  # the last row: no such piece
        self.longest = max(map(len, pieces), default=1)

    def log_p(self, words: list[str]) -> np.ndarray:
        """log p(word) for each word and language. Words of equal length go through the recursion together."""
        out = np.empty((len(words), len(self.langs)))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            by_length.setdefault(len(w) + 1, []).append(k)
        for length, ks in by_length.items():
            for at in range(0, len(ks), 20_000):
                part = ks[at : at + 20_000]
                chars = np.frombuffer("".join(START + words[k] for k in part).encode("utf-32-le"), np.uint32).reshape(len(part), length)
                out[part] = self._forward(chars.astype(np.uint64) + np.uint64(1))
        return out

    def _forward(self, chars: np.ndarray) -> np.ndarray:
        n, length = chars.shape
        k = len(self.langs)
        scale = np.zeros((n, 1))
        # ahead[i]: the sum over the ways to cut the first i characters; only the last `longest` are still needed.
        ahead: dict[int, np.ndarray] = {0: np.ones((n, k))}
        for i in range(length):
            if i:
                here = ahead[i]
                top = here.max(axis=1, keepdims=True)
                if (top < 1e-100).any():
                    for later in ahead.values():
                        later /= top
                    scale += np.log(top)
                    here = ahead[i]
            else:
                here = ahead[0]
            code = np.zeros(n, np.uint64)
            for j in range(i, min(length, i + self.longest)):
                code = code * BASE + chars[:, j]
                at = np.searchsorted(self.codes, code)
                at[at == len(self.codes)] = 0
                missing = self.codes[at] != code
                at[missing] = len(self.codes)
                p = self.p[at]
                if j == i:
                    p = np.where(missing[:, None], UNKNOWN, p)
                elif missing.all():
                    continue
                if j + 1 in ahead:
                    ahead[j + 1] += here * p
                else:
                    ahead[j + 1] = here * p
            del ahead[i]
        return np.log(ahead[length]) + scale


def fit(docs: DataFrame, vocabulary: str, rows: int = TRAIN_ROWS) -> Model:
    """Piece counts by lang from about `rows` documents at most, chosen by a hash of doc_id.

    Rows without text or lang teach nothing; without any, the model knows no language."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
    pieces = [sp.id_to_piece(k) for k in range(sp.get_piece_size())]
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    share = rows / max(1, labelled.count())
    # The ids' hash thins the rows evenly; the limit holds where ids repeat.
    sample = labelled.filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < int(share * (1 << 20)) + 1).select("lang", "text").limit(2 * rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = sentencepiece.SentencePieceProcessor(model_file=vocabulary)
        for batch in batches:
            found: dict[tuple[str, int], int] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for ids in sp.encode(_words(text), num_threads=1):
                    for k in ids:
                        found[lang, k] = found.get((lang, k), 0) + 1
            keys = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in keys], pa.string()), pa.array([k for _, k in keys], pa.int32()), pa.array(found.values(), pa.int64())], ["lang", "piece", "n"])

    counted = sample.repartition(8).mapInArrow(lean(count), "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counted})
    counts = np.zeros((len(pieces), len(langs)))
    for r in counted:
        counts[r["piece"], langs.index(r["lang"])] = r["n"]
    return Model(langs, pieces, counts)


class _Remembered:
    """Rows of log p by word, computed a batch of new words at a time."""

    def __init__(self, model: Model):
        self.model, self.index, self.rows = model, {}, np.empty((1 << 12, len(model.langs)))

    def of(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.index) > REMEMBERED:
            self.index = {}
        new = list({w for t in texts for w in t if w not in self.index})
        if new:
            have = len(self.index)
            self.index.update(zip(new, range(have, have + len(new)), strict=True))
            if len(self.index) > len(self.rows):
                self.rows = np.concatenate([self.rows[:have], np.empty((2 * len(self.index) - have, self.rows.shape[1]))])
            self.rows[have : len(self.index)] = self.model.log_p(new)
        return [self.rows[[self.index[w] for w in t]].sum(axis=0) if t else np.zeros(len(self.model.langs)) for t in texts]


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns `keep`, lang_pred and score. Null text, or one without a letter, is `und` with score 0; so is
    every text if the model knows no language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded: vocabulary times languages
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        known = _Remembered(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                words = [_words(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
                names, scores = [], []
                for w, x in zip(words, known.of(words) if model.langs else words, strict=True):
                    if not w or not model.langs:
                        names.append("und")
                        scores.append(0.0)
                        continue
                    best = int(x.argmax())
                    names.append(model.langs[best])
                    scores.append(float(1 / np.exp(x - x[best]).sum()))
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*keep, text_of().alias("_text")).mapInArrow(lean(score), schema)


def language_report(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score; learned from the rows that aren't held out.

    Null text, or one without a letter, is `und` with score 0. Of languages that are as likely the one that sorts first
    is named. Repeated rows are answered alike; rows with null doc_id are answered and not held out. An empty table gives
    no rows."""
    import public_tokenizers

    model = fit(docs.filter(~held_out(F.col("doc_id"))), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    return identify(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
