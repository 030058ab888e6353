"""Each operator against a brute-force version, on texts that are null, empty, long, repeated or alike."""

import hashlib
import itertools
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import byte_bpe, common, fingerprints, jaccard_join, language_id, license_scan, packing, quality_classifier, quality_rules, resharding, substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
rnd = random.Random(11)
WORDS = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(1, 7))) for _ in range(400)]


def prose(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def _texts():
    base, passage = prose(200), prose(70)
    near = base.split()
    near[150] = "other"
    return [
        base, base, " ".join(near), prose(120) + " " + passage + " " + prose(30), passage + "\n" + prose(60), prose(90) + "  " + passage, None, "", " \t\n", "one", "one two three", "One TWO three",
        "Under the MIT License. " + prose(40) + " CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0", "# % " * 80, "same line here\n" * 40, "x" * 5000, prose(3000), "Ünïcödé 日本語 🎉 ½ it's we'll  end ", passage, passage,
        "SHOUT LOUD " * 50, "a b c d e f a b c d e f",
    ]


TEXTS = _texts()


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(7 * k + 3, t, "de" if k % 3 else "en", "s", len(t or "")) for k, t in enumerate(TEXTS)]
    # Columns whose names the operators use themselves.
    clash = ["n", "node", "key", "packed", "block", "words", "_text", "slot", "row", "size", "length", "doc", "label", "r", "edited"]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in clash}).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, one id with two texts, and null ids."""
    rows = [(1, TEXTS[0]), (1, TEXTS[0]), (2, TEXTS[3]), (2, TEXTS[4]), (None, TEXTS[0]), (None, None), (5, TEXTS[4])]
    return spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA)


def pairs():
    return [(7 * k + 3, t or "") for k, t in enumerate(TEXTS)]


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def split(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def test_license_scan(docs, empty, odd):
    got = by_id(license_scan.scan(docs))
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in pairs():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(low))
        at, labels = [], set()
        for phrase, label in license_scan.PHRASES.items():
            q = phrase.split()
            found = [k for k in range(len(w) - len(q) + 1) if w[k : k + len(q)] == q]
            at += found
            labels |= {label} if found else set()
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(at), min(at, default=None), max(at, default=None))
        assert r["base_labels"] == ",".join(sorted(labels)) and labels <= set(r["labels"].split(",")) | (set() if labels else {""})
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(odd).count() == 7


def test_license_join_finds_what_all_blocks_against_all_templates_do(spark):
    rng = random.Random(3)
    templates = [(f"t{k}", " ".join(rng.sample(WORDS[:60], 12))) for k in range(6)]
    texts = [" ".join(rng.sample(WORDS[:60], 40)) for _ in range(40)] + [" ".join(rng.sample(t.split(), 11) + [prose(20)]) for _, t in templates]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    got = by_id(license_scan.scan(df, templates, 0.7))
    for k, t in enumerate(texts):
        w, want = [x.decode() for x in license_scan.words_of(t.encode())], set()
        for label, x in templates:
            size = license_scan.block_size(len(x.split()))
            for a in license_scan.block_starts(len(w), size):
                if len(set(w[a : a + size]) & set(x.split())) >= license_scan.needed(len(set(x.split())), 0.7):
                    want.add(label)
        assert set(filter(None, got[k]["labels"].split(","))) == want


def test_a_whole_notice_is_found_wherever_it_stands(spark):
    rng, rows, want = random.Random(5), [], []
    for label, notice in license_scan.NOTICES:
        w = notice.split()
        for before in (0, 1, 20, 50, 333):
            if len(w) > 40 and before % 2:
                w = [x for k, x in enumerate(w) if k % 30 != 7]  # nearly whole
            rows.append((len(rows), f"{prose(before)} {' '.join(w)} {prose(rng.randint(0, 90))}"))
            want.append(label)
    got = by_id(license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(label in got[k]["labels"].split(",") and got[k]["score"] >= license_scan.THRESHOLD for k, label in enumerate(want))


def test_quality_rules(docs, empty, odd):
    got = by_id(quality_rules.quality_report(docs))
    for i, t in pairs():
        w, lines = split(t), [x for x in t.split("\n") if split(x)]
        threes = list(zip(w, w[1:], w[2:], strict=False))
        times = Counter(threes)
        covered = {k + j for k, x in enumerate(threes) if times[x] > 1 for j in range(3)}
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == (len(w), sum(map(len, w)), sum(t.count(c) for c in quality_rules.SYMBOLS), len(lines) - len(set(lines)))
        assert r["n_repeat_words"] == len(covered) and r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert r["kept"] == (not _rejected(t))
    assert quality_rules.quality_report(empty).count() == 0
    want = Counter((r["doc_id"], len(split(r["text"] or "")), not _rejected(r["text"] or "")) for r in odd.collect())
    assert Counter((r["doc_id"], r["n_words"], r["kept"]) for r in quality_rules.quality_report(odd).collect()) == want
    failed = {r["doc_id"]: r["failed_rule"] for r in quality_rules.cascade(docs).collect()}
    assert all((failed[i] is None) == got[i]["kept"] for i, _ in pairs())
    ranks = [x.rank for x in quality_rules.measure(docs)]
    assert ranks == sorted(ranks, reverse=True)


def _rejected(t):
    """The names of the rules that reject a text, in plain Python."""
    w, chars = split(t), len("".join(split(t)))
    lines = [x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n") if split(x)]
    raw = [x for x in t.split("\n") if split(x)]
    threes, n = list(zip(w, w[1:], w[2:], strict=False)), len(w)
    times = Counter(threes)
    again = len({k + j for k, x in enumerate(threes) if times[x] > 1 for j in range(3)})
    of = lambda cs: sum(t.count(c) for c in cs)
    rules = {
        "few_words": n < 50, "repetitive": 100 * again > 50 * n, "symbolic": 10 * of("#*$%&|<>") > n, "shouting": 2 * of(string.ascii_uppercase) > chars, "dup_lines": 2 * (len(raw) - len(set(raw))) > len(t.split("\n")),
        "odd_words": chars < 2 * n or chars > 20 * n, "numeric": 10 * of(string.digits) > 3 * chars, "punctuated": 10 * of(string.punctuation) > 4 * chars, "code": 20 * of("{}") > n,
        "cut_off": 100 * sum(x.endswith(("...", "…")) for x in lines) > 30 * len(lines), "bulleted": 100 * sum(x[0] in "-*•" for x in lines) > 90 * len(lines),
        "one_pair": 5 * max(Counter(itertools.pairwise(w)).values(), default=0) > n,
    }
    return {name for name, holds in rules.items() if holds}


def test_each_rule_rejects_what_it_should(spark):
    base = prose(80)
    texts = [
        base, base + " # $ % & | < > * # $", base.upper(), "\n".join([prose(30), "a b c d e"] * 3 + ["a b c d e"] * 9), " ".join("a" for _ in range(30)) + " " + " ".join(rnd.choice("bcdefghijklmnop") for _ in range(60)),
        base + " " + " ".join("123456789012" for _ in range(60)) + prose(20), base + " ;;;;!!!!????,,,," * 30 + prose(40), base + " {} {} {}", "\n".join(f"{prose(6)} ...  " for _ in range(12)), "\n".join(f"  - {prose(6)}" for _ in range(12)),
        " ".join(f"in the {prose(1)}" for _ in range(60)), " ".join("x" * 30 + prose(1) for _ in range(60)), "a b " * 2 + prose(60),
    ]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rule in quality_rules.RULES:
        got = {r["doc_id"] for r in quality_rules.cascade(rows, (rule,)).filter("failed_rule is not null").collect()}
        assert got == {k for k, t in enumerate(texts) if rule.name in _rejected(t)}, rule.name


def test_the_cascade_asks_nothing_more_of_a_rejected_document(spark):
    rows = spark.createDataFrame([(1, "few words"), (2, prose(60)), (3, None)], "doc_id long, text string")
    # Of a short text this rule must not be asked.
    bomb = quality_rules.Rule("bomb", lambda f: F.when(f["n_words"] < 50, F.raise_error(F.lit("asked")).cast("boolean")).otherwise(F.lit(False)))
    judge = lambda *order: [r[0] for r in rows.orderBy("doc_id").select(common.let(common.text_of(), lambda t: common.let(common.words_of(t), lambda w: quality_rules.failed_rule(list(order), quality_rules.Facts(t, w))))).collect()]
    assert judge(quality_rules.FEW_WORDS, bomb) == ["few_words", None, "few_words"]
    with pytest.raises(Exception, match="asked"):
        judge(bomb, quality_rules.FEW_WORDS)


def test_classifier_and_language(spark, empty, docs, odd):
    rows = [(k, prose(80) if k % 2 else "### %%% " * 40, "xx" if k % 2 else "yy", "s", 1) for k in range(80)]
    d = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(80)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = quality_classifier.quality_scores(d, labels).collect()
    assert all(r["predicted"] == r["doc_id"] % 2 and 0 <= r["score"] <= 1 for r in got) and len(got) == 80
    none = quality_classifier.quality_scores(docs, labels.limit(0)).collect()
    assert len(none) == len(TEXTS) and {r["score"] for r in none} == {0.5}
    assert quality_classifier.quality_scores(empty, labels).count() == 0 and quality_classifier.quality_scores(odd, labels).count() == 7
    rows = [(k, ("the house and the garden are here " if k % 2 else "das Haus und der Garten sind hier ") * 5, "en" if k % 2 else "de", "s", 1) for k in range(60)]
    got = by_id(language_id.language_report(spark.createDataFrame([*rows, (100, None, "en", "s", 0), (101, "12 34 !?", None, "s", 0), (102, "x" * 4000, None, "s", 0)], SCHEMA)))
    assert all(got[k]["lang_pred"] == ("en" if k % 2 else "de") for k in range(60)) and got[100]["lang_pred"] == got[101]["lang_pred"] == "und" and 0 <= got[102]["score"] <= 1
    assert language_id.language_report(empty).count() == 0 and language_id.language_report(odd).count() == 7
    assert language_id._words("cafe\u0301 12 \u0301x") == ["cafe\u0301", "x"]
    bare = language_id.language_report(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in bare} == {"und"} and len(bare) == len(TEXTS)


def test_votes_are_those_of_all_cosines(docs):
    rng = np.random.default_rng(4)
    counts = np.stack([quality_classifier.term_counts(t or "") for t in TEXTS] * 3)
    labels = rng.integers(0, 2, len(counts)).astype(float)
    m = quality_classifier.Model(np.ones(quality_classifier.TERMS, np.float32), quality_classifier.latent_basis(np.log1p(counts), 8), np.zeros((0, 8), np.float32), labels)
    m.vectors = m.embed(counts)
    cosines = np.round(m.embed(counts) @ m.vectors.T, 6)
    exact = np.array([[sum(x * y for x, y in zip(v, w, strict=True)) for w in m.vectors.astype(float)] for v in m.embed(counts).astype(float)])
    assert np.abs(cosines - exact).max() < 1e-5
    # Each text is there three times, so that there are ties; of equal ones the first vote.
    for row, got in zip(cosines, m.votes(counts, 5), strict=True):
        near = sorted(range(len(row)), key=lambda k: (-row[k], k))[:5]
        weights = [max(float(row[k]), 1e-6) ** quality_classifier.SHARPNESS for k in near]
        assert abs(got - sum(w * labels[k] for w, k in zip(weights, near, strict=True)) / sum(weights)) < 1e-5


def test_forward_sums_every_segmentation():
    pieces = [language_id.START, "a", "b", "ab", language_id.START + "a", "ba", "aba"]
    m = language_id.Model(["x", "y"], pieces, np.array([[3, 1], [5, 2], [1, 9], [4, 4], [2, 2], [0, 7], [1, 1]], float))
    p = {x: (np.array([[3, 1], [5, 2], [1, 9], [4, 4], [2, 2], [0, 7], [1, 1]], float)[k] + language_id.SMOOTHING) for k, x in enumerate(pieces)}
    total = sum(p.values())

    def brute(t):
        if not t:
            return np.ones(2)
        return sum(((p[t[:n]] / total) if t[:n] in p else np.full(2, language_id.UNKNOWN)) * brute(t[n:]) for n in range(1, len(t) + 1) if t[:n] in p or n == 1)

    for w in ("abab", "b", "aaba", "abz", "a" * 300):
        want = np.log(brute(language_id.START + w)) if len(w) < 9 else None
        got = m.log_p([w])[0]
        assert np.isfinite(got).all() and (want is None or np.allclose(got, want))


def _cut(rows, n=50):
    """What stays of each of rows (doc_id, text), by plain reading; sorted."""
    rows = [(i, split(t or "")) for i, t in rows]
    first = {}
    for i, w in rows:
        for k in range(len(w) - n + 1):
            if i is not None:
                first[tuple(w[k : k + n])] = min(i, first.get(tuple(w[k : k + n]), i))
    out = []
    for i, w in rows:
        gone = {j for k in range(len(w) - n + 1) if i is not None and first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        out.append((-1 if i is None else i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return sorted(out)


def _kept(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in df.collect())


def test_substring_dedup(docs, empty, odd):
    assert _kept(substring_dedup.deduplicated(docs)) == _cut(pairs())
    assert substring_dedup.deduplicated(empty).count() == 0
    assert _kept(substring_dedup.deduplicated(odd)) == _cut([(r["doc_id"], r["text"]) for r in odd.collect()])


def _family(rng):
    """Texts with shared passages that begin, end and branch in different places."""
    vocabulary, a, b, c = WORDS[:40], prose(40), prose(30), prose(25)
    texts = [f"{a} {b} {prose(9)}", f"{prose(5)} {a} {b}", f"{a} {prose(12)} {b}", f"{b} {a}", a, f"{prose(3)} {a[20:]} {b[:80]}", "la " * 70, "la " * 50, "la le li " * 50, "le li la " * 20, f"{a} {c} {prose(4)}", f"{prose(2)} {a} {c}", f"{c} {b}", f"{c} {b[:90]}", prose(20)]
    return [(3 * k + 1, t) for k, t in enumerate(texts)] + [(90 + k, " ".join(rng.choice(vocabulary) for _ in range(60))) for k in range(4)]


def test_hashes_that_collide_cut_nothing_else(spark):
    rows = _family(random.Random(12)) + [(40, None), (7, prose(30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for bits in (3, 9, 64):
        assert _kept(substring_dedup.deduplicated(df, 12, 5, bits)) == _cut(rows, 12), bits


def test_edges_share_a_path_where_no_node_branches(spark):
    n, rows = 12, _family(random.Random(13))
    rows = [(i, t) for i, t in rows if t]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    docs, _ = common.keyed(df)
    windows = {}
    for i, t in sorted(rows):
        w = split(t)
        for k in range(len(w) - n + 1):
            windows.setdefault(tuple(w[k : k + n]), []).append((i, k))
    edges = {e: at for e, at in windows.items() if len({i for i, _ in at}) > 1}
    into, out = Counter(e[1:] for e in edges), Counter(e[:-1] for e in edges)
    plain = {v for v in into if into[v] == 1 and out[v] == 1}
    after = {e: next(f for f in edges if f[:-1] == e[1:]) for e in edges if e[1:] in plain}
    before = {f: e for e, f in after.items()}

    def root(e):
        seen = [e]
        while seen[-1] in before and before[seen[-1]] not in seen:
            seen.append(before[seen[-1]])
        return min(seen) if seen[-1] in before else seen[-1]  # a ring, else where the path begins

    want = {}
    for e, at in edges.items():
        want.setdefault(root(e), set()).add(min(at))
    listed = spark.createDataFrame([(k, *min(at), len(at)) for k, (e, at) in enumerate(edges.items())], "edge long, source long, at int, rows long")
    got = {}
    for r in substring_dedup.compacted(docs, listed, n).collect():
        got.setdefault(r["path"], set()).add((r["source"], r["at"]))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())) and len(want) > 3


def test_chains_and_rings(spark):
    links = [(1, None), *((k, k - 1) for k in range(2, 40)), (50, 53), (51, 50), (52, 51), (53, 52), (60, None), (70, 70)]
    got = {r["stretch"]: r["path"] for r in substring_dedup.chained(spark.createDataFrame(links, "stretch long, before long")).collect()}
    assert got == {**dict.fromkeys(range(1, 40), 1), **dict.fromkeys(range(50, 54), 50), 60: 60, 70: 70}


def test_hot_keys_join_like_others(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 2000, 7).otherwise(F.col("id") % 900).cast("long").alias("k"), "id")
    one = many.groupBy("k").agg(F.count("*").alias("rows")).filter("k % 2 = 1").withColumn("x", F.col("k") * 2)
    got = sorted(map(tuple, common.joined(many, one, "k", 5000).select("id", "k", "x").collect()))
    assert got == sorted((r["id"], r["k"], 2 * r["k"]) for r in many.collect() if r["k"] % 2)


def test_byte_bpe_is_what_the_library_gives(docs, empty, odd):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = by_id(byte_bpe.bpe_report(docs))
    for i, t in pairs():
        ids = enc.encode_ordinary(t)
        assert got[i]["n_tokens"] == len(ids) and got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest()
    assert byte_bpe.bpe_report(empty).count() == 0 and byte_bpe.bpe_report(odd).count() == 7
    words = sorted({w for _, t in pairs() if len(t) < 3000 for w in re.findall(r" ?[a-z]+", t)})[:200]
    coder = byte_bpe.Coder(docs.sparkSession, ranks, public_tokenizers.PATTERN)
    rows = docs.sparkSession.createDataFrame([(w,) for w in words], "w string").select("w", coder.ids(F.col("w")).alias("ids"))
    assert all(r["ids"] == enc.encode_ordinary(r["w"]) == byte_bpe.merged(r["w"].encode(), ranks) and bytes(r["b"]) == r["w"].encode() for r in rows.withColumn("b", coder.decoded(F.col("ids"))).collect())


def test_byte_bpe_of_many_chunks_and_of_words_without_end(spark, monkeypatch):
    ranks = byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    monkeypatch.setattr(byte_bpe, "CHUNK_WORDS", 50)
    monkeypatch.setattr(byte_bpe, "PACKED", 60)
    rng = random.Random(6)
    texts = [prose(rng.randint(0, 60)) + rng.choice(["", "!" * 300, " " + "ab" * 400]) for _ in range(40)] + ["z" * 1_000_000, "".join(rng.choice("abc") for _ in range(300_000)), None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = by_id(byte_bpe.Coder(spark, ranks, public_tokenizers.PATTERN).encode(df))
    assert len(got) == len(texts)
    for k, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[k]["ids"] == ids and bytes(got[k]["ids_le"]) == np.array(ids, "<u4").tobytes()


def test_fold_takes_the_lowest_rank_first_and_the_leftmost_of_equal_ones(spark):
    ranks = {bytes([k]): k for k in range(256)} | {b"bc": 256, b"ab": 257, b"aa": 258, b"aaa": 259, b"bcd": 260}
    coder = byte_bpe.Coder(spark, ranks, public_tokenizers.PATTERN)
    rng = random.Random(7)
    words = ["abc", "aaaa", "aaaaa", "abcd", "ab"] + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(80)]

    def brute(w):
        parts = [bytes([x]) for x in w.encode()]
        while pairs := [(ranks[a + b], k) for k, (a, b) in enumerate(itertools.pairwise(parts)) if a + b in ranks]:
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [ranks[x] for x in parts]

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", coder.ids(F.col("w")).alias("ids")).collect()
    # A word that is a token as a whole is that token, as the library has it.
    assert all(r["ids"] == ([ranks[r["w"].encode()]] if r["w"].encode() in ranks else brute(r["w"])) for r in rows)
    assert all(byte_bpe.merged(w.encode(), ranks) == ([ranks[w.encode()]] if w.encode() in ranks else brute(w)) for w in words)


def _components(rows, shingle=4, percent=85):
    sets = {}
    for i, t in rows:
        w = split(t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        sets[i] = {tuple(w[k : k + shingle]) for k in range(max(1, len(w) - shingle + 1))} if w else set()
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in itertools.combinations(up, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((root(a), root(b)))
            up[hi] = lo
    return {i: (len(sets[i]), root(i)) for i in up}


def test_jaccard_join(spark, docs, empty, odd):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_components(docs).collect()}
    assert got == _components(pairs())
    rng = random.Random(8)
    rows = []
    for size in (8, 12, 14, 18, 30, 60):
        base = [rng.choice(WORDS) for _ in range(size + 3)]
        for _ in range(25):
            t = list(base)
            for _ in range(rng.choice((0, 1, 1, 2, 3))):
                t[rng.randrange(len(t))] = rng.choice(WORDS)
            rows.append((len(rows) * 3 % 151 + 200 * len(rows), " ".join(t[: len(t) - rng.choice((0, 0, 1, 2))])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.linked_components(df).collect()}
    assert got == _components(rows)
    assert jaccard_join.linked_components(empty).count() == 0 and jaccard_join.linked_components(odd).count() == 7


def test_jaccard_filters_lose_no_pair():
    rng = np.random.default_rng(1)
    for _ in range(400):
        n, m = sorted(rng.integers(1, 80, 2))
        x = rng.choice(1 << 60, n, replace=False).astype(np.uint64)
        y = np.unique(np.concatenate([x[: rng.integers(0, n + 1)], rng.choice(1 << 60, m, replace=False).astype(np.uint64)]))[: max(1, m)]
        o = len(np.intersect1d(x, y))
        if 100 * o >= 85 * (len(x) + len(y) - o):
            a, b = jaccard_join.sketch(x), jaccard_join.sketch(y)
            assert o >= jaccard_join.need(len(x), len(y)) and jaccard_join.may_overlap(a.tobytes(), len(x), b.tobytes(), len(y))
            brief = [jaccard_join.folded(s, jaccard_join.BRIEF).tobytes() for s in (a, b)]
            assert jaccard_join.may_overlap(brief[0], len(x), brief[1], len(y))
            px, py = np.sort(x)[: jaccard_join.prefix_length(len(x))], np.sort(y)[: jaccard_join.prefix_length(len(y))]
            assert len(np.intersect1d(px, py))


def test_resharding(spark, docs, empty, odd, tmp_path):
    rows = resharding.shard_report(docs).collect()
    assert len(rows) == len(TEXTS) and {r["law"] for r in rows} == {"bytes"}
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    want = {i: (len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in pairs()}
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == want
    assert resharding.shard_report(empty).count() == 0 and resharding.shard_report(odd).count() == 7
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    sizes = {r["shard"]: r["b"] for r in resharding.shard_report(many).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(sizes) == 16 and max(sizes.values()) - min(sizes.values()) < 200


def test_equal_texts_stay_together_unless_they_are_too_many(spark):
    rows = [(k, f"text {k % 150} " * 9) for k in range(3000)] + [(10_000 + k, "the same over and over " * 20) for k in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = resharding.shard_report(df).collect()
    shards, sizes = {}, Counter()
    for r in got:
        shards.setdefault(r["text_crc32"], set()).add(r["shard"])
        sizes[r["shard"]] += r["size"]
    assert len(shards) == 151 and sum(len(x) > 1 for x in shards.values()) == 1
    assert len(sizes) == 16 and max(sizes.values()) < 1.05 * min(sizes.values())


def test_layouts_that_grow_and_shrink_keep_every_row(spark, tmp_path):
    path = str(tmp_path / "shards")
    rows = [(k, "x" * (k % 97), k) for k in range(400)] + [(7, "twice", 1000), (7, "twice", 1001), (None, "no id", 1002), (None, None, 1003)]
    many = spark.createDataFrame(rows, "doc_id long, text string, extra long")
    first = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)).cast("int")
    many.withColumn("shard", first).withColumn("slot", F.lit(0).cast("long")).write.partitionBy("shard").parquet(path)
    old = 4
    for new in (5, 3, 6):
        docs = spark.read.schema("doc_id long, text string, extra long, slot long, shard int").parquet(path)
        placed = common.saved(resharding.reshard(docs, F.col("shard"), old, new), "placed")
        touched = resharding.rewrite(docs, placed, path)
        spark.catalog.refreshByPath(path)
        back = spark.read.parquet(path).collect()
        assert touched and sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", r["extra"]) for r in back) == sorted((-1 if i is None else i, t or "", x) for i, t, x in rows)
        assert {r["shard"] for r in back} == set(range(new)) and not (tmp_path / "shards.new").exists()
        moved = {(r["doc_id"], r["text_crc32"], r["shard"], r["slot"]) for r in placed.collect() if r["shard"] in touched}
        assert {(r["doc_id"], zlib.crc32((r["text"] or "").encode()), r["shard"], r["slot"]) for r in back if r["shard"] in touched} == moved
        old = new


def test_flow_moves_the_fewest_bytes():
    rng = random.Random(2)
    for _ in range(30):
        old, new = rng.randint(1, 4), rng.randint(1, 5)
        supply = [rng.randint(0, 9) for _ in range(old)]
        capacity = [rng.randint(0, 9) for _ in range(new)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        flow = resharding.min_cost_flow(supply, capacity, resharding.move_costs(old, new))
        assert [sum(r) for r in flow] == supply and all(sum(c) <= k for c, k in zip(zip(*flow, strict=True), capacity, strict=True))
        # What can stay at most stays, unless it would crowd out nothing: bytes that stay are bounded by both ends.
        assert sum(flow[i][i] for i in range(min(old, new))) == sum(min(supply[i], capacity[i]) for i in range(min(old, new)))
    with pytest.raises(ValueError):
        resharding.min_cost_flow([5], [4], [[0]])


def test_fingerprints(docs, empty, odd):
    got = by_id(fingerprints.fingerprint_report(docs))
    order = sorted(pairs(), reverse=True)
    jac = lambda a, b: (lambda x, y: len(x & y) / max(1, len(x | y)))(*({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for w in (a.split(), b.split())))
    for k, (i, t) in enumerate(order):
        after, third = order[(k + 1) % len(order)][1], len(t) // 3
        edited = t[: len(t) - third] + after[:third]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        if len(t.split()) > 60:
            assert abs(r["near_edited"] - jac(t, edited)) < 0.2 and abs(r["near_next"] - jac(t, after)) < 0.2
    assert got[3]["fingerprint"] == got[10]["fingerprint"] and got[3]["fingerprint"] != got[24]["fingerprint"]
    assert fingerprints.fingerprint_report(empty).count() == 0 and fingerprints.fingerprint_report(odd).count() == 7


def test_packing(docs, empty, odd):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = packing.packing_report(docs).collect()
    for i, t in pairs():
        ids = [*tok.encode(t, add_special_tokens=False).ids, packing.END_ID]
        own = sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        for r in own:
            assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert all(r["length"] == 1024 for r in own[1:])
    for s in {r["sequence_id"] for r in rows}:
        at = 0
        for r in sorted((r for r in rows if r["sequence_id"] == s), key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024
    assert packing.packing_report(empty).count() == 0 and packing.packing_report(odd).count() == 7
    path = public_tokenizers.path("byte_bpe_50k.json")
    encode = packing.encoder(path, packing.read_vocabulary(path))
    assert packing.read_vocabulary(path) and packing.read_vocabulary(public_tokenizers.path("word_bpe_49k.json")) is None
    for t in (" " * 20_000 + "x", "a<|endoftext|>b", "y" * 50_000, "\n \n" * 3000):
        assert encode(t) == tok.encode(t, add_special_tokens=False).ids


def test_reduction_keeps_an_optimal_packing():
    def fewest(items, c):
        items, best = sorted(items, reverse=True), [len(items)]

        def go(k, rooms):
            if len(rooms) >= best[0]:
                return
            if k == len(items):
                best[0] = len(rooms)
                return
            for j in {r: j for j, r in enumerate(rooms) if r >= items[k]}.values():
                go(k + 1, [*rooms[:j], rooms[j] - items[k], *rooms[j + 1 :]])
            go(k + 1, [*rooms, c - items[k]])

        go(0, [])
        return best[0]

    rng = random.Random(4)
    for _ in range(120):
        c, items = 12, [rng.randint(1, 12) for _ in range(rng.randint(1, 9))]
        counts = {s: items.count(s) for s in set(items)}
        fixed, left = packing.reduce_dominated(counts, c)
        rest = [s for s, n in left.items() for _ in range(n)]
        assert sum(p.copies for p in fixed) + (fewest(rest, c) if rest else 0) == fewest(items, c)
        assert sum(p.copies * len(p.lengths) for p in packing.plan(counts, c)) == len(items)
