"""Token counts, whitening and resampling against the library and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from missive.llm import common, op11_token_counts, op12_whitening, op13_resampling

RNG = random.Random(11)
WORDS = ["".join(RNG.choice("abcdefghioprstuéßΣñ") for _ in range(RNG.randint(1, 9))) for _ in range(300)]
CLASH = ["tag", "pretoken", "n", "pieces", "rest", "tokens", "bucket", "score", "rank", "w", "v", "weight", "_mx_part", "_mx_place"]


def prose(n: int) -> str:
    return " ".join(RNG.choice(WORDS).capitalize() if RNG.random() < 0.1 else RNG.choice(WORDS) + RNG.choice(["", "", "", ",", ".\n"]) for _ in range(n))


TEXTS = [
    None, "", " \t\n", "Hello world", "hello  WORLD", "don't we'll I'VE 'tis", "a\n\nb  c\td", "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|> <|end",
    "é ́e é İstanbul ΑΣ Σ. ﬁ Ａ", "日本語 テキスト。 123 4,567 ½ ²", "\x00\x1c!\x1f?  \u0085end﻿", "🙂🙂 👩‍👩‍👧", "a" * 3000, "1" * 500 + "!" * 500,
    prose(8000), prose(40), prose(40),
]
ROWS = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "Hello world"), (3, "other text"), (None, "no id")]
ROWS += [(100 + i, prose(RNG.randint(0, 60))) for i in range(60)] + [(500 + i, prose(0) + " ".join(WORDS[:30])) for i in range(40)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3).withColumns({c: F.lit(f"clash {c}") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string")


# Token counts


def counts_of(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = []
    for doc, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((doc, len((text or "").encode()), n, n > 100))
    return Counter(out)


@pytest.mark.parametrize("most", [200_000, 40, 3])
def test_token_counts_are_the_librarys(spark, docs, monkeypatch, most):
    monkeypatch.setattr(op11_token_counts, "SMALL_GROUPS", most)  # few: rare pre-tokens are joined by a shuffle
    found = op11_token_counts.token_counts(docs, limit=100)
    assert found.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert Counter(map(tuple, found.collect())) == counts_of(ROWS)


def test_tables_of_units_and_pretokens_are_bounded(spark, docs, monkeypatch):
    """Small tables start anew and lose nothing (held in this process, where the reader is used directly)."""
    monkeypatch.setattr(op11_token_counts, "UNITS", 5)
    reader = op11_token_counts.PreTokens(str(public_tokenizers.path("word_bpe_49k.json")))
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for _, text in ROWS:
        found = reader.frequencies(text)
        assert sum(n * reader.pieces(p) for p, n in found.items()) == len(t.encode(text or "", add_special_tokens=False).ids)
        assert len(reader.known) <= 5


def test_pieces_are_counted_once_for_a_pretoken(spark, docs):
    rows = op11_token_counts.distinct_pretokens(docs, "word_bpe_49k.json").collect()
    assert len(rows) == len({r["pretoken"] for r in rows})
    held = {r["pretoken"]: r["n"] for r in rows}
    reader = op11_token_counts.PreTokens(str(public_tokenizers.path("word_bpe_49k.json")))
    assert held == dict(Counter(p for _, text in ROWS for p in reader.frequencies(text)))


def test_token_counts_of_nothing(empty):
    assert op11_token_counts.token_counts(empty).collect() == []


def test_fuzzed_texts_count_as_the_library_counts():
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    reader = op11_token_counts.PreTokens(str(public_tokenizers.path("word_bpe_49k.json")))
    letters = "aAbZé́İΣσ ß \n\t\r  '’s'll-.,;0٣½漢ｶ🙂‍<|endoftext|>_\x1c\x00"
    for _ in range(4000):
        text = "".join(RNG.choice(letters) for _ in range(RNG.randint(0, 30)))
        if RNG.random() < 0.3:
            text = text[:9] + "<|endoftext|>" + text[9:]
        assert sum(n * reader.pieces(p) for p, n in reader.frequencies(text).items()) == len(t.encode(text, add_special_tokens=False).ids), repr(text)


# Whitening


def vectors(n: int, d: int, seed: int = 3) -> list:
    rng = np.random.default_rng(seed)
    return (rng.normal(0, 1, (n, d)) @ rng.normal(0, 0.2, (d, d)) + rng.normal(0, 1, d)).astype(np.float32).tolist()


def test_whitening_equals_brute_force(spark):
    d = 11
    good = vectors(300, d)
    good += [good[0]] * 100  # copies
    bad = [None, [None] + good[0][1:], [float("nan")] + good[0][1:], [float("inf")] + good[0][1:], [], good[0][:5], [1e30] + good[0][1:]]
    rows = [(i, v) for i, v in enumerate(good)] + [(1000 + i, v) for i, v in enumerate(bad)] + [(None, good[5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4).withColumns({c: F.lit(1) for c in CLASH})
    found = op12_whitening.whiten(df).collect()
    kept = [(i, v) for i, v in rows if v in good]
    x = np.array([[math.floor(1024 * float(c)) + 100_000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    centred = np.array([[float(Fraction(int(a) * n - int(s), n)) for a, s in zip(row, sums, strict=True)] for row in x])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    want = centred @ axes[:, :8] / np.sqrt(values[:8])
    assert len(found) == 8 * n
    by_row = {}
    for r in found:
        by_row.setdefault((r["vec_id"], int(r["deviation"])), {}).setdefault(r["component"], []).append(r["whitened"])
        assert r["n"] == n and abs(r["explained"] - values[r["component"] - 1] / values.sum()) < 1e-9 and r["identity_error"] < 1e-9
    signs = None
    for k, (i, _) in enumerate(kept):
        deviation = sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[k], sums, strict=True))
        got = np.array([by_row[(i, deviation)][c + 1][0] for c in range(8)])
        signs = np.sign(got * want[k]) if signs is None else signs
        assert np.allclose(got, want[k] * signs, atol=1e-9)


def test_jacobi_finds_small_eigenvalues():
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 16, 33):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        wanted = np.sort(10.0 ** -rng.uniform(0, 6, d))[::-1]
        a = (q * wanted) @ q.T
        values, axes = op12_whitening.jacobi((a + a.T) / 2)
        assert np.allclose(values, wanted, rtol=1e-8)
        assert np.abs(axes.T @ axes - np.eye(d)).max() < 1e-13
        assert np.abs((axes * values) @ axes.T - a).max() < 1e-13
    # Graded on its diagonal: relative accuracy, where a method that works by norm has none.
    scale = np.diag(10.0 ** -np.arange(0, 12, 2))
    core = np.full((6, 6), 0.1) + 0.9 * np.eye(6)
    values, _ = op12_whitening.jacobi(scale @ core @ scale)
    assert np.isclose(np.prod(values), np.linalg.det(core) * np.prod(np.diag(scale)) ** 2, rtol=1e-10, atol=0)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert op12_whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert op12_whitening.whiten(spark.createDataFrame([(1, None), (2, [None])], schema)).collect() == []
    assert op12_whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], schema)).collect() == []
    flat = spark.createDataFrame([(i, [float(i), 7.0, 2.0 * i]) for i in range(9)], schema)  # rank one
    assert {r["component"] for r in op12_whitening.whiten(flat).collect()} == {1}


def test_deviations_beyond_a_long_are_exact(spark):
    rows = [(i, [float(i * (1 << 30)), float(-i)]) for i in range(7)]
    found = op12_whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = {r["vec_id"]: int(r["deviation"]) for r in found.collect()}
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    assert got == {i: sum((7 * a - s) ** 2 for a, s in zip(x[i], sums, strict=True)) for i in range(7)}


# Resampling


def brute(rows, target, longest, buckets, percent, least):
    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        return w, [" ".join(w[i : i + k]) for k in range(1, longest + 1) for i in range(len(w) - k + 1)]

    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in rows for f in features(x)[1]), Counter(bucket(f) for x in target for f in features(x)[1])
    total = sum(s.values()) + buckets, sum(t.values()) + buckets
    out = []
    for doc, text in rows:
        w, f = features(text)
        gains = [math.floor(1000 * math.log((t[b] + 1) * total[0] / ((s[b] + 1) * total[1]))) for b in map(bucket, f)]
        weight = sum(gains) // len(gains) if gains else 0
        h = int(hashlib.sha256(f"2024:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize(("longest", "percent", "buckets"), [(1, 10, 10_000), (1, 50, 97), (3, 33, 500), (2, 100, 10_000), (1, 0, 100)])
def test_resampling_equals_brute_force(spark, docs, longest, percent, buckets):
    rows = [r for r in ROWS if r[0] != 3]  # ids that repeat have ranks in any order
    target = [prose(30), None, "", " ".join(WORDS[:12])]
    table = spark.createDataFrame([(i, x) for i, x in enumerate(target)], "item_id long, text string")
    found = op13_resampling.resample(docs.where("doc_id IS DISTINCT FROM 3"), table, percent, longest, buckets)
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(map(tuple, found.collect())) == brute(rows, target, longest, buckets, percent, 20)


def test_repeated_ids_and_empty_tables(spark, docs, empty):
    same = spark.createDataFrame([(7, "w " * 30)] * 50, "doc_id long, text string")
    found = op13_resampling.resample(same, empty, percent=30).collect()
    assert sorted(r["rank"] for r in found if r["rank"]) == list(range(1, 16)) and len({r["score"] for r in found}) == 1
    assert op13_resampling.resample(empty, docs).collect() == []


def test_full_tries_start_anew(spark, docs, monkeypatch):
    monkeypatch.setattr(op13_resampling, "NODES", 7)
    trie, totals = op13_resampling.Trie(2), np.zeros(50, np.int64)
    want = Counter()
    for _, text in ROWS:
        w = op13_resampling.words_of((text or "").encode())
        trie.count(w)
        want.update(zlib.crc32(b" ".join(w[i : i + k])) % 50 for k in (1, 2) for i in range(len(w) - k + 1))
        if len(trie.crc) > 7:
            trie.add_to(totals)
            trie.clear()
    trie.add_to(totals)
    assert {i: int(n) for i, n in enumerate(totals) if n} == dict(want)
    assert common.shared_folder(spark)
