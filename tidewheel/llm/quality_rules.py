"""Quality rules as a short-circuit cascade.

Each rule is a cost (measured) and a selectivity (measured) on a sample; the cascade asks the rule that rejects
most per unit of cost first, and asks no further rule of a document that one has rejected: what a rule needs of the
text is computed where the rule is asked, unless the caller has it already. The order changes the time, never the
verdict: a document is kept when no rule rejects it.

Everything is DataFrame functions, so the whole cascade runs inside the JVM.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, let, text_of, words_of

SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = "0123456789"
#: ASCII but for letters, digits and white space.
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Documents a cascade is tuned on, at most. They set the order of the rules and nothing else.
SAMPLE_ROWS = 2000


def n_words(words: Column) -> Column:
    return F.size(words).cast("long")


def word_chars(text: Column) -> Column:
    return F.length(F.translate(text, SPACES, "")).cast("long")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    with_word = F.filter(F.split(text, "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    return let(with_word, lambda v: (F.size(v) - F.size(F.array_distinct(v))).cast("long"))


def n_repeat_words(words: Column) -> Column:
    """Words inside a three-word window that the text has twice or more, the first time included.

    The windows' hashes are sorted, so that equal ones are neighbours: n log n for any text, however repetitive."""

    def covered(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))

        def repeated(s: Column) -> Column:
            twice = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
            at = F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
            return F.size(F.array_distinct(at)).cast("long")

        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(F.sort_array(hashes), repeated))

    return let(words, covered)


def lines_of(text: Column) -> Column:
    """Lines with a word, without white space at their ends."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def n_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def share_of_lines(text: Column, holds: Callable[[Column], Column], above: float) -> Column:
    """Whether more than so many hundredths of the lines with a word are as asked; false without lines."""
    return let(lines_of(text), lambda v: 100 * F.size(F.filter(v, holds)) > int(above) * F.size(v))


def has_pair_above(words: Column, fifth: int) -> Column:
    """Whether one pair of neighbouring words takes more than a fifth-th of the number of words.

    In sorted order, a run of m equal hashes covers a multiple of m, so only these places are looked at."""

    def found(w: Column) -> Column:
        m = (F.floor(F.size(w) / fifth) + 1).cast("int")
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 2), lambda k: F.xxhash64(F.get(w, k), F.get(w, k + 1)))
        run = lambda s: F.exists(F.sequence(F.lit(0), F.size(s) - 1, m), lambda at: F.coalesce(F.get(s, (F.array_position(s, F.get(s, at)) - 2 + m).cast("int")) == F.get(s, at), F.lit(False)))
        return F.when(F.size(w) < 2, F.lit(False)).otherwise(let(F.sort_array(hashes), run))

    return let(words, found)


#: What rules may ask of a text, by name; rules that share one read the same.
FEATURES: dict[str, Callable[[Column, Column], Column]] = {
    "n_words": lambda t, w: n_words(w), "word_chars": lambda t, w: word_chars(t), "n_symbols": lambda t, w: n_symbols(t), "n_dup_lines": lambda t, w: n_dup_lines(t), "n_repeat_words": lambda t, w: n_repeat_words(w),
    "n_lines": lambda t, w: F.size(F.split(t, "\n")), "n_upper": lambda t, w: n_of(t, UPPER), "n_digits": lambda t, w: n_of(t, DIGITS), "n_marks": lambda t, w: n_of(t, MARKS), "n_braces": lambda t, w: n_of(t, "{}"),
}
#: Those that the report returns, and so has for every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


class Facts:
    """A document as rules see it: text, words, and FEATURES, of which some may be ready."""

    def __init__(self, text: Column, words: Column, ready: dict[str, Column] | None = None):
        self.text, self.words, self.ready = text, words, ready or {}

    def __getitem__(self, feature: str) -> Column:
        return self.ready[feature] if feature in self.ready else FEATURES[feature](self.text, self.words)


@dataclass(frozen=True)
class Rule:
    """name, and a function of a document's facts that is true where it is rejected."""

    name: str
    rejects: Callable[[Facts], Column]


#: The base rules, then the method's own.
FEW_WORDS = Rule("few_words", lambda f: f["n_words"] < 50)
REPETITIVE = Rule("repetitive", lambda f: 100 * f["n_repeat_words"] > 50 * f["n_words"])
BASE = (FEW_WORDS, REPETITIVE)
OWN = (
    Rule("symbolic", lambda f: 10 * f["n_symbols"] > f["n_words"]),
    Rule("shouting", lambda f: 2 * f["n_upper"] > f["word_chars"]),
    Rule("dup_lines", lambda f: 2 * f["n_dup_lines"] > f["n_lines"]),
    Rule("odd_words", lambda f: (f["word_chars"] < 2 * f["n_words"]) | (f["word_chars"] > 20 * f["n_words"])),
    Rule("numeric", lambda f: 10 * f["n_digits"] > 3 * f["word_chars"]),
    Rule("punctuated", lambda f: 10 * f["n_marks"] > 4 * f["word_chars"]),
    Rule("code", lambda f: 20 * f["n_braces"] > f["n_words"]),
    Rule("cut_off", lambda f: share_of_lines(f.text, lambda x: x.endswith("...") | x.endswith("…"), 30)),
    Rule("bulleted", lambda f: share_of_lines(f.text, lambda x: F.substring(x, 1, 1).isin("-", "*", "•"), 90)),
    Rule("one_pair", lambda f: has_pair_above(f.words, 5)),
)
RULES = (*BASE, *OWN)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    cost_s: float
    rejects: float

    @property
    def rank(self) -> float:
        return self.rejects / max(self.cost_s, 1e-9)


def measure(docs: DataFrame, rules: tuple[Rule, ...] = RULES, rows: int = SAMPLE_ROWS, ready: tuple[str, ...] = ()) -> list[Measured]:
    """Each rule's seconds and share of rejections on at most `rows` documents, best rejection per cost first.

    ready names the features that cost a rule nothing, since the caller has them anyway. An empty table gives every
    rule no rejections; the order is then that of `rules`."""
    # Thinned where the rows are, so that the limit gathers about `rows` of them and not as many from each partition.
    share = min(1.0, 1.2 * rows / max(1, docs.count()))
    t, w = F.col("text"), F.col("words")
    sample = docs.select(text_of().alias("text")).sample(share, seed=7).limit(rows).select("text", words_of(t).alias("words"))
    sample = sample.select("*", *(FEATURES[n](t, w).alias(n) for n in ready)).persist()
    try:
        n = sample.count()
        facts = Facts(t, w, {n: F.col(n) for n in ready})
        timed = lambda c: (began := time.perf_counter(), sample.agg(F.sum(c.cast("long"))).first()[0] or 0, time.perf_counter() - began)[1:]
        timed(F.lit(1))
        _, base = timed(F.size("words"))
        out = []
        for r in rules:
            hits, s = timed(r.rejects(facts))
            out.append(Measured(r, max(s - base, 1e-4), hits / max(n, 1)))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda m: -m.rank)


def failed_rule(order: list[Rule], facts: Facts) -> Column:
    """The first rule of the order that rejects, or null; later rules aren't computed for that document."""
    out = F.lit(None).cast("string")
    for r in reversed(order):
        out = F.when(r.rejects(facts), F.lit(r.name)).otherwise(out)
    return out


def cascade(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with failed_rule (null: kept), the rules asked in the measured order.

    Null text counts as empty, so FEW_WORDS rejects it; repeated rows and any other columns pass through unchanged."""
    order = [m.rule for m in measure(docs, rules, sample_rows)]
    return docs.withColumn("failed_rule", let(text_of(), lambda t: let(words_of(t), lambda w: failed_rule(order, Facts(t, w)))))


def quality_report(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Per row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    The report returns five counts of every document, so these are taken once and cost its rules nothing; the cascade
    asks all rules, the base ones too, in the order measured so, and takes nothing else of a document that one has
    rejected.  Null text counts as empty and fails; repeated rows and null ids are
    reported like any other; an empty table gives no rows. Windows of words are compared by 64-bit hashes."""
    order = [m.rule for m in measure(docs, RULES, sample_rows, REPORTED)]

    def judged(t: Column, w: Column, c: Column) -> Column:
        facts = Facts(t, w, {n: c[n] for n in REPORTED})
        base = BASE[0].rejects(facts) | BASE[1].rejects(facts)
        return F.struct(*(c[n].alias(n) for n in REPORTED), base.alias("base_failed"), failed_rule(order, facts).alias("failed_rule"))

    counts = lambda t, w: F.struct(*(FEATURES[n](t, w).alias(n) for n in REPORTED))
    row = let(text_of(), lambda t: let(words_of(t), lambda w: let(counts(t, w), lambda c: judged(t, w, c))))
    # A row of a one-element array: a projection would be merged with the next one and its parts computed many times.
    out = docs.select("doc_id", F.explode(F.array(row)).alias("r")).select("doc_id", "r.*")
    return out.select("doc_id", *REPORTED, "base_failed", F.col("failed_rule").isNull().alias("kept"))


ORACLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split(t, chr(10)) AS ls FROM d),
tok AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
tri AS (SELECT doc_id, i, word, lead(word, 1) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM tok WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
tri2 AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, word, w2, w3) AS n FROM tri WHERE w3 IS NOT NULL),
cov AS (SELECT doc_id, count(DISTINCT i + o.o) AS n_repeat_words FROM tri2, (SELECT unnest([0, 1, 2]) AS o) o WHERE n > 1 GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
pair AS (SELECT doc_id, max(n) AS top FROM (SELECT doc_id, word, w2, count(*) AS n FROM tri WHERE w2 IS NOT NULL GROUP BY doc_id, word, w2) GROUP BY doc_id),
ln2 AS (SELECT doc_id, trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM ln),
own AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE line LIKE '%...' OR line LIKE '%…') AS n_cut, count(*) FILTER (WHERE line[1:1] IN ('-', '*', '•')) AS n_bullets FROM ln2 WHERE line <> '' GROUP BY doc_id),
r AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper, len(ls) AS n_lines,
  CAST(length(t) - length(regexp_replace(t, '[0-9]', '', 'g')) AS BIGINT) AS n_digits, CAST(length(t) - length(regexp_replace(t, '[!-/:-@\[-`{-~]', '', 'g')) AS BIGINT) AS n_marks,
  CAST(length(t) - length(regexp_replace(t, '[{}]', '', 'g')) AS BIGINT) AS n_braces, coalesce(100 * own.n_cut > 30 * own.n, FALSE) AS cut_off, coalesce(100 * own.n_bullets > 90 * own.n, FALSE) AS bulleted, coalesce(pair.top, 0) AS top,
  CAST(coalesce(dup.n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN cov USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN pair USING (doc_id)),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_upper > word_chars OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 10 * n_digits > 3 * word_chars OR 10 * n_marks > 4 * word_chars OR 20 * n_braces > n_words OR cut_off OR bulleted OR top >= n_words // 5 + 1) AS kept FROM b
"""
