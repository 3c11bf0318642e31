"""The near-copy join against all pairs."""

from __future__ import annotations

import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from missive.llm import op01_shingles, op01_simhash

SF = "/root/testdata/sf0.1/documents.parquet"


def groups(rows: list[tuple[int, str]], similarity: float = 0.8) -> dict[int, int]:
    """Id to the smallest id of its group, by comparing every pair."""
    sets = {d: set(op01_simhash.shingle_hashes(t.encode(), 5).tolist()) for d, t in rows}
    root = {d: d for d in sets}

    def find(x: int) -> int:
        return x if root[x] == x else find(root[x])

    ids, held = sorted(sets), {}
    for i, d in enumerate(ids):
        for x in sets[d]:
            held.setdefault(x, []).append(i)
    held = {x: np.array(v) for x, v in held.items() if len(v) > 1}
    for i, d in enumerate(ids):  # the shared shingles with every other text, counted
        with_i = [held[x] for x in sets[d] if x in held]
        shared = np.bincount(np.concatenate(with_i)) if with_i else np.empty(0, int)
        for j in np.flatnonzero(shared):
            if j > i and shared[j] >= similarity * (len(sets[d]) + len(sets[ids[j]]) - shared[j]):
                x, y = sorted((find(d), find(ids[j])))
                root[y] = x
    return {d: find(d) for d in sets}


def test_every_pair_at_the_threshold_is_found(spark):
    if not Path(SF).exists():
        pytest.skip("no test tables")
    table = spark.read.parquet(SF).where("length(text) > 0").groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id", "text")
    rows = [(r.doc_id, r.text) for r in table.collect()]
    kept = {r.doc_id for r in op01_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = groups(rows)
    assert kept == set(want.values()) and not {205, 9728} & kept


def test_long_texts_are_decided_on_whole_sets(spark):
    # n shingles, of which a change of the last k words leaves n - k: Jaccard (n - k) / (n + k), just around 0.8
    rows = []
    for i in range(40):
        n, k = 900, 100 + (i % 2)
        words = [f"w{i}x{j}" for j in range(n + 4)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(words[:-k] + [f"y{i}x{j}" for j in range(k)]))]
    kept = {r.doc_id for r in op01_simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {2 * i for i in range(40)} | {2 * i + 1 for i in range(1, 40, 2)}


def test_order_and_repeats_count(spark):
    rng = random.Random(3)
    table = [f"cell{i}" for i in range(120)]
    rows = [(1, "a b"), (2, "b a"), (3, "no no no"), (4, "no"), (5, " ".join(table)), (6, " ".join(rng.sample(table, 120)))]
    source = [f"s{i}" for i in range(200)]
    for i in range(30):  # copies of one source, most of them not similar to each other
        words = list(source)
        for at in rng.sample(range(200), 1 + i % 6):
            words[at] = f"e{i}x{at}"
        rows.append((10 + i, " ".join(words)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    want = groups(rows)
    assert all(want[i] == i for i in range(1, 7)) and len(set(want.values())) > 7
    got = {r.doc_id: r.component_id for r in op01_shingles.near_copies(frame, cell_rows=2).collect()}
    assert got == want
    assert {r.doc_id for r in op01_simhash.keep_one(frame.where("doc_id < 7")).collect()} == set(range(1, 7))


def test_fingerprints_find_candidates_first(spark, monkeypatch):
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(words), " ".join([*words[:-1], "other"]), " ".join(f"z{i}" for i in range(300))]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    asked = []
    inner = op01_shingles.close_prints

    def seen(docs, nodes):
        out = inner(docs, nodes)
        reps = {r.node: r.rep for r in nodes.collect()}
        asked.extend(sorted((reps[r.a], reps[r.b])) for r in out.collect())
        return out

    monkeypatch.setattr(op01_shingles, "close_prints", seen)
    got = {r.doc_id: r.component_id for r in op01_shingles.near_copies(frame).collect()}
    bits = [op01_simhash.majority(op01_simhash.shingle_hashes(t.encode(), 3)) for t in texts]
    assert (bits[0] ^ bits[1]).bit_count() <= 2
    assert asked == [[0, 1]] and got == {0: 0, 1: 0, 2: 2}


def test_a_quoted_passage_makes_no_candidates(spark, monkeypatch):
    # Long texts, for which 512 bits tell nothing apart, one in each partition, so that no run of texts shows what is frequent.
    passage = [f"p{i}" for i in range(260)]
    texts = [" ".join([*(f"a{d}x{i}" for i in range(520)), *passage, *(f"b{d}x{i}" for i in range(520))]) for d in range(40)]
    texts.append(texts[0].replace("a0x100 ", "other "))
    frame = spark.createDataFrame(spark.sparkContext.parallelize(list(enumerate(texts)), len(texts)), "doc_id long, text string")
    asked = []
    inner = op01_shingles.cross_pairs

    def seen(*args):
        out = inner(*args)
        asked.append(out.count())
        return out

    monkeypatch.setattr(op01_shingles, "cross_pairs", seen)
    got = {r.doc_id: r.component_id for r in op01_shingles.near_copies(frame).collect()}
    assert got == groups(list(enumerate(texts))) and got[40] == 0 and len(set(got.values())) == 40
    assert asked == [0]


def test_places_of_first_shingles_at_the_threshold(spark):
    # Sets that are as unlike as may be: all that differs stands first, in either or in the larger one only.
    rows, rng = [], random.Random(4)
    for i in range(60):
        shared = [f"c{i % 6}x{j}" for j in range(84)]
        most = rng.choice([5, 10, 20])  # 80 shingles in common, 20 others in both together
        rows.append((i, " ".join([*(f"e{i}x{j}" for j in range(most)), *shared])))
    got = {r.doc_id: r.component_id for r in op01_shingles.near_copies(spark.createDataFrame(rows, "doc_id long, text string"), cell_rows=4).collect()}
    want = groups(rows)
    assert got == want and 6 < len(set(want.values())) < 60
