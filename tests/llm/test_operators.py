"""Every operator on a small table with awkward rows, against brute force."""

from __future__ import annotations

import gzip
import hashlib
import random
import re
import textwrap
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from missive.llm import op01_simhash, op02_license, op03_tokens, op04_language, op05_exact, op06_packing, op07_sharding, op08_decontaminate, op09_pii, op10_warc
from missive.llm.common import shared_folder

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdehinorstuéß") for _ in range(RNG.randint(1, 9))) for _ in range(400)]


def prose(n: int) -> str:
    out = []
    for i in range(n):
        out.append(RNG.choice(WORDS).capitalize() if i % 9 == 0 else RNG.choice(WORDS))
        if i % 9 == 8:
            out[-1] += "." if i % 18 == 8 else ".\n"
    return " ".join(out).replace("\n ", "\n")


BASE = prose(220)
LONG = prose(9000)
#: Rows with nulls, blanks, copies, near copies, repeated rows and ids, and a long text.
ROWS = [
    (1, "Hello world", "en"), (2, "HELLO WORLD", "en"), (3, "hello  world", None), (4, None, "de"), (5, "", "de"), (6, " \t\n", None),
    (7, BASE, "fr"), (8, BASE.replace(WORDS[3], WORDS[4], 1), "fr"), (9, BASE + " end", "fr"), (10, BASE, None), (11, LONG, "en"),
    (12, "one", "en"), (13, "one two", "en"), (14, "1 2 3", "en"), (14, "another text of that id", "en"), (15, "same row", "en"), (15, "same row", "en"),
    (16, "a\n\nb  c\td <|endoftext|> é́ 日本語 'tis I've", "en"), (None, "no id here", "en"),
]
ROWS += [(100 + i, prose(RNG.randint(3, 60)), RNG.choice(["en", "fr"])) for i in range(60)]
SCHEMA = "doc_id long, text string, lang string"
#: Extra columns whose names the operators use themselves.
CLASH = ["fp", "digest", "tag", "node", "size", "part", "row", "keep_id", "kept", "spans", "start", "length", "ids", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    return rows.withColumns({c: F.lit(f"clash {c}") for c in CLASH})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA).withColumn("source", F.lit(None).cast("string"))


def bag(rows) -> list:
    return sorted(rows, key=repr)


# 1


def test_simhash_equals_brute_force(docs):
    rows = [(d, t) for d, t, _ in ROWS if d not in (14, 15, None)]
    want = op01_simhash.brute(rows)
    got = op01_simhash.near_duplicates(docs.where("doc_id NOT IN (14, 15)")).select("doc_id", op01_simhash.hex_of(F.col("fp")).alias("f"), "component_id")
    assert {r.doc_id: (r.f, r.component_id) for r in got.collect()} == want
    assert want[4][0] == want[5][0] == want[6][0] == "0" * 16 and want[6][1] == 4


def test_simhash_returns_every_row_and_takes_an_empty_table(docs, empty):
    assert op01_simhash.near_duplicates(docs).count() == len(ROWS)
    assert op01_simhash.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("max_bits,blocks,cell_rows", [(2, 4, 4096), (2, 5, 3), (5, 7, 4096), (0, 2, 2)])
def test_links_equal_all_pairs(spark, max_bits, blocks, cell_rows):
    rng = random.Random(max_bits)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for p in list(prints):
        q = p
        for _ in range(rng.randint(0, 7)):
            q ^= 1 << rng.randrange(64)
        prints.add(q)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    nodes = spark.createDataFrame([(p,) for p in signed], "fp long")
    got = {(r.a, r.b) for r in op01_simhash.links(nodes, max_bits, blocks, cell_rows).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= max_bits}
    assert got == want and (want or not max_bits)


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7)]
    got = {r.node: r.root for r in op01_simhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30))


def test_near_copies_leave_one_and_others_stay(docs):
    got = op01_simhash.keep_one(docs)
    ids = {r.doc_id for r in got.collect()}
    assert got.columns == docs.columns
    assert 7 in ids and not {8, 9, 10} & ids
    assert {1, 11, 12, None, *range(100, 160)} <= ids


# 2


def wrapped(text: str, width: int, gap: str = "\n") -> str:
    return gap.join(textwrap.wrap(text, width))


def test_licenses_equal_brute_force(spark, docs, empty):
    full = op02_license.TEMPLATES
    rows = [(1, "Some text.\nReleased under the MIT License.\nMore"), (2, "licensed under CC  by-nc 4.0!"), (3, None), (4, ""), (5, "license"), (6, "\n\n"),
            (7, full["MIT"].replace(", ", ",\n", 3)), (8, full["GPL-3.0"].replace("free", "open")), (9, LONG + "\nReleased under the MIT License."),
            (10, "Released under\nthe MIT\n\nLicense."), (12, "Licensed under CC BY-SA"), (13, "Copyright 2021 Jane Doe. Released under the MIT License. All of it, " + BASE),
            (14, "of the " * 600 + full["ISC"] + " the software" * 300), (15, "license " * 700), (16, (full["ISC"] + " x y z ") * 30), (16, "Released under the MIT License."), (None, full["MPL-2.0"])]
    rows += [(100 + i, wrapped(full[k], width, gap)) for i, (k, width, gap) in enumerate((k, w, g) for k in ("MIT", "Apache-2.0", "BSD-2-Clause", "GPL-3.0") for w in (30, 40, 72, 120) for g in ("\n", "\n\n", "\n# "))]
    rng = random.Random(6)
    for i in range(36):  # edited templates inside prose, around the threshold
        words = full[rng.choice(sorted(full))].split()
        for _ in range(rng.randint(0, 1 + len(words) // 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        rows.append((200 + i, " ".join([prose(rng.choice((0, 40, 480))), *words, prose(rng.randint(0, 40))])))
    got: dict = {}
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "words": F.lit(2)})
    for r in op02_license.scan(frame).collect():
        got.setdefault(r.doc_id, []).append((r.license, (r.dice, r.first_word, r.n_words)))
    want: dict = {}
    for d, t in rows:
        want.setdefault(d, []).extend(op02_license.brute(t).items())
    assert {d: bag(x) for d, x in got.items()} == {d: bag(x) for d, x in want.items() if x}
    has = lambda d: {k for k, _ in got[d]}
    assert "CC-BY-SA-4.0" in has(12) and {"MIT-notice"} == has(9) == has(10) == has(13) and "MIT" in has(7) and "ISC" in has(14) and "MPL-2.0" in has(None)
    assert all(k in has(100 + 12 * i + j) for i, k in enumerate(("MIT", "Apache-2.0", "BSD-2-Clause", "GPL-3.0")) for j in range(12))
    assert op02_license.scan(docs).count() == 0 and op02_license.scan(empty).count() == 0


def test_cue_words_lose_no_window():
    for least in (0.5, 0.8, 0.95):
        cues = set(op02_license.cue_words(op02_license.TEMPLATES, least))
        for t in op02_license.TEMPLATES.values():
            pairs = op02_license.bigrams_of(t)
            assert sum(not cues & set(p.split()) for p in pairs) < op02_license.needed(len(pairs), least)


# 3


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))


def test_token_files_hold_what_the_library_gives(spark, docs, word_bpe):
    path = f"{shared_folder(spark)}/tokens-test"
    op03_tokens.write_tokens(docs, path, page_rows=20)
    got = op03_tokens.read_tokens(spark, path).collect()
    got.sort(key=lambda r: r.start)
    ids = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert ids == sorted(ids) and len(ids) == len(ROWS)
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids)) and r.ids[-1] == 2
        at += r.n_tokens
    want = bag((d, [*word_bpe.encode(t or "", add_special_tokens=False).ids, 2]) for d, t, _ in ROWS)
    assert bag((r.doc_id, r.ids) for r in got) == want
    sums = {(r.start, r.ids_crc32) for r in op03_tokens.digests(op03_tokens.read_tokens(spark, path)).collect()}
    assert sums == {(r.start, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}
    part = op03_tokens.read_tokens(spark, path, 100, 104, tokens=False)
    assert sorted(r.doc_id for r in part.collect()) == [100, 101, 102, 103, 104] and part.columns == ["doc_id", "start", "n_tokens"]


def test_token_files_have_the_encodings_and_indexes(spark, docs):
    path = f"{shared_folder(spark)}/tokens-format"
    op03_tokens.write_tokens(docs.coalesce(1), path)
    from pathlib import Path

    found = [pq.ParquetFile(p) for p in Path(path.removeprefix("file://")).glob("*.parquet")]
    group = max((f.metadata.row_group(0) for f in found if f.metadata.num_rows), key=lambda g: g.num_rows)
    columns = {group.column(i).path_in_schema: group.column(i) for i in range(group.num_columns)}
    assert "DELTA_BINARY_PACKED" in columns["doc_id"].encodings and "RLE_DICTIONARY" in columns["ids.list.element"].encodings
    assert all(c.has_offset_index and c.has_column_index for c in columns.values())


def test_tokens_of_an_empty_table(spark, empty):
    assert op03_tokens.token_digests(spark, empty).count() == 0


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    from missive.llm import tokens

    rng = random.Random(9)
    bits = ["a", "b c", " ", "  ", "\n", "\n\n", "\t", "é", "ß", "日本", "1", "23", "'s", "'re", ".", "!?", "\xa0", "<|endoftext|>", "\r\n", "́", "Σ", "İ", "_", "\x1c", "\x85", "Word", "ÀÉ"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)] + [BASE, LONG, ""]
    library, own = Tokenizer.from_file(str(public_tokenizers.path(name))), tokens.encoder(name)
    for t in texts:
        assert np.frombuffer(own.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


# 4


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = op04_language.Network.fresh(["a", "b", "c"], rng)
    for k in ("table", "loop", "top", "bias"):
        setattr(net, k, getattr(net, k).astype(np.float64))
    windows, lengths, target = rng.integers(1, 256, (4, 9)).astype(np.uint8), np.array([9, 5, 7, 1]), np.array([0, 1, 2, 1])
    windows[np.arange(9) >= lengths[:, None]] = 0

    def loss() -> float:
        p = op04_language.positions(net, op04_language.forward(net, op04_language.both_ways(windows)), lengths)
        real = np.arange(9)[:, None] < lengths
        return -np.log(p[:, target, np.arange(4)][real]).sum() / real.sum()

    for w, g in zip(net.weights, op04_language.gradients(net, windows, lengths, target), strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        kept, step = w[at], 1e-2
        w[at] = kept + step
        up = loss()
        w[at] = kept - step
        down = loss()
        w[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=1e-2)


def test_network_equals_plain_loops():
    net = op04_language.Network.fresh(["a", "b", "c"], np.random.default_rng(4))
    text, n = "zwei Wörter, und mehr".encode(), op04_language.HIDDEN
    logistic = lambda x: 1 / (1 + np.exp(-x))

    def states(way: int, raw: bytes) -> list:
        h, out = [0.0] * n, []
        for byte in raw:
            again = [sum(float(net.loop[way][i][j]) * h[j] for j in range(n)) for i in range(3 * n)]
            given = [float(net.table[way][i][byte]) for i in range(3 * n)]
            reset = [logistic(given[i] + again[i]) for i in range(n)]
            update = [logistic(given[n + i] + again[n + i]) for i in range(n)]
            new = [np.tanh(given[2 * n + i] + reset[i] * again[2 * n + i]) for i in range(n)]
            h = [update[i] * h[i] + (1 - update[i]) * new[i] for i in range(n)]
            out.append(h)
        return out

    there, back = states(0, text), states(1, text[::-1])[::-1]
    total = np.zeros(3)
    for a, b in zip(there, back, strict=True):
        logits = np.array([float(net.top[0][k] @ np.array(a)) + float(net.top[1][k] @ np.array(b)) + float(net.bias[k]) for k in range(3)])
        total += np.exp(logits) / np.exp(logits).sum()
    assert op04_language.pooled(net, [text])[0] == pytest.approx(total / len(text), abs=1e-5)


@pytest.fixture(scope="module")
def languages(spark):
    sounds = {"aa": "kamotaneru ", "bb": "zwischtreng "}
    rng = random.Random(2)
    text = lambda s: "".join(rng.choice(s) for _ in range(rng.randint(40, 700)))
    rows = [(i, text(sounds[k]), k) for i in range(300) for k in [("aa", "bb")[i % 2]]]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 34 !", "aa"), (1003, "kamota", None), (None, "zwisch treng", "bb"), (1004, "kamota " * 30_000, None)]
    return spark.createDataFrame(rows, SCHEMA)


def test_language_of_held_out_rows(languages):
    net = op04_language.fit(languages, docs_per_lang=60)
    got = op04_language.identify(languages, net).collect()
    assert len(got) == languages.count()
    by_id = {r.doc_id: r for r in got}
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by_id[1000].score == 0
    assert by_id[1004].lang_pred == "aa" and by_id[None].lang_pred == "bb" and not by_id[None].held_out
    tested = [(r.lang_pred, ("aa", "bb")[r.doc_id % 2]) for r in got if r.held_out and r.doc_id < 300]
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert np.mean([a == b for a, b in tested]) >= 0.97 and len(tested) > 30
    kept = op04_language.keep_known(languages.withColumn("lang_pred", F.lit(1)), net)
    assert kept.columns == [*languages.columns, "lang_pred"] and kept.where("doc_id < 300").count() >= 295
    assert kept.where("doc_id IN (1000, 1001, 1002)").count() == 0


def test_language_without_labels_or_rows(spark, empty):
    rows = spark.createDataFrame([(1, "text", None)], SCHEMA)
    assert op04_language.fit(rows) is None and op04_language.fit(empty) is None
    assert [tuple(r)[2:] for r in op04_language.identify(rows, None).collect()] == [("und", 0.0)]
    assert op04_language.identify(empty, None).count() == 0


def test_pooling_covers_whole_texts():
    net = op04_language.train([(b"aaab" * 20, "x"), (b"cdcc" * 20, "y")], steps=30)
    one, two = op04_language.pooled(net, [b"aaab" * 500, b"aaab" * 250 + b"cdcc" * 1000])
    assert one.argmax() == 0 and two.argmax() == 1 and one.sum() == pytest.approx(1, abs=1e-4)


# 5


def fold(t: str | None) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_groups(docs, empty):
    got = op05_exact.exact_duplicates(docs).collect()
    by_text: dict = {}
    for d, t, _ in ROWS:
        by_text.setdefault(fold(t), []).append(d)
    want = bag((d, max(by_text[fold(t)], key=lambda x: -1 if x is None else x), len(by_text[fold(t)]), hashlib.sha256(fold(t).encode()).hexdigest()) for d, t, _ in ROWS)
    assert bag((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(by_text) and all(r.doc_id == r.keep_id for r in got if r.kept)
    assert op05_exact.exact_duplicates(empty).count() == 0


def test_exact_keep_one(docs):
    kept = op05_exact.keep_one(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len({fold(t) for _, t, _ in ROWS}) == len({fold(t) for _, t in got})
    assert got.count((15, "same row")) == 1 and (2, "HELLO WORLD") in got and (10, BASE) in got


# 6


def test_packing_places_every_piece(docs, empty):
    byte_bpe = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got = op06_packing.packed(docs).collect()
    want = []
    for d, t, _ in ROWS:
        ids = np.array([*byte_bpe.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for k, (a, n) in enumerate(op06_packing.cuts(len(ids), 2048)):
            want.append((d, k, a, n, zlib.crc32(ids[a : a + n].tobytes())))
    assert bag((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == bag(want)
    bins: dict = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-sum(w[3] for w in want) // 2048) + 1
    assert op06_packing.packed(empty).count() == 0


def test_cuts_and_bins():
    assert op06_packing.cuts(1, 8) == [(0, 1)] and op06_packing.cuts(16, 8) == [(0, 8), (8, 8)]
    assert op06_packing.cuts(20, 8) == [(0, 4), (4, 8), (12, 8)]
    bins = op06_packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 8, 9, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (3, 9)]
    bins = op06_packing.OpenBins(10, 1)
    assert [bins.place(n)[0] for n in (6, 7, 3)] == [0, 1, 1]  # the fuller one was open last, the fullest closed first


def test_equal_rows_are_packed_in_all_tasks(spark):
    rows = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    found = op06_packing.materialize(op06_packing.pieces(rows), "equal-pieces")
    got = op06_packing.pack(found, task_pieces=1000).groupBy(F.shiftright("sequence_id", 40).alias("task")).count().collect()
    assert len(got) == 3 and min(r["count"] for r in got) > 500


def test_lookahead_needs_no_more_sequences_than_online(spark):
    rng = random.Random(2)
    rows = [(i, 0, 0, min(2048, int(rng.paretovariate(0.9) * 60)), i) for i in range(4000)]
    found = op06_packing.materialize(spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long"), "lengths-pieces")
    used = {}
    for window in (1, 4096):
        got = op06_packing.pack(found, window=window).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
        assert sum(r.n for r in got) == sum(r[3] for r in rows) and max(r.n for r in got) <= 2048
        used[window] = len(got)
    assert used[4096] <= used[1] <= 1.02 * sum(r[3] for r in rows) / 2048 + 1, used


def plain_best_fit(lengths: list[int], capacity: int, most: int) -> list[int]:
    """The bin of each piece, by looking at all open bins."""
    bins, made, out = [], 0, []
    for n in lengths:
        fits = [b for b in bins if b[0] >= n]
        if fits:
            best = min(fits, key=lambda b: (b[0], -b[2]))
            bins.remove(best)
        else:
            best, made = (capacity, made, 0), made + 1
        if best[0] > n:
            if len(bins) >= most:
                bins.remove(min(bins, key=lambda b: (b[0], -b[2])))
            bins.append((best[0] - n, best[1], len(out) + 1))
        out.append(best[1])
    return out


def test_bins_equal_a_plain_best_fit():
    rng = random.Random(7)
    for most in (1, 3, 50):
        lengths = [rng.randint(1, 40) for _ in range(500)]
        bins = op06_packing.OpenBins(40, most)
        assert [bins.place(n)[0] for n in lengths] == plain_best_fit(lengths, 40, most)


def test_sequences_are_the_token_ids(docs):
    some = docs.where("doc_id IN (1, 2, 5, 11, 15)")
    got = op06_packing.sequences(some).collect()
    assert all(0 < len(r.ids) <= 2048 for r in got)
    placed = op06_packing.packed(some)
    assert sum(len(r.ids) for r in got) == placed.agg(F.sum("length")).first()[0]
    crc = {zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got}
    full = placed.where("length = 2048").collect()
    assert full and all(r.ids_crc32 in crc for r in full)


# 7


def test_shards(docs, empty, spark):
    got = op07_sharding.shard(docs, 5, ("source", "lang", "size"), slot_rows=4).collect()
    assert bag((r.doc_id, r["size"], r.text_crc32) for r in got) == bag((d, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for d, t, _ in ROWS)
    slots: dict = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(slots) <= set(range(5)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert op07_sharding.shard(empty, 4, ("source",)).count() == 0


def tree(points: list, shards: int, dims: int, first: int = 0) -> dict:
    """Point to shard by a recursive split at the boundary nearest to the quantile.  A point is its
    weight, tie, coordinates and name."""
    if shards == 1 or not points:
        return {p[-1]: first for p in points}
    span = [max(p[2 + i] for p in points) - min(p[2 + i] for p in points) for i in range(dims)]
    dim = 2 + span.index(max(span))
    key = lambda p: (p[dim], p[1])
    goal = sum(p[0] for p in points) * (shards // 2) / shards
    edges = {k: sum(p[0] for p in points if key(p) < k) for k in {key(p) for p in points}} | {(1 << 60, 0): sum(p[0] for p in points)}
    low = max((k for k in edges if edges[k] < goal), default=min(edges), key=edges.__getitem__)
    high = min((k for k in edges if edges[k] >= goal), key=edges.__getitem__)
    cut = high if edges[high] - goal < goal - edges[low] else low
    sides = [p for p in points if key(p) < cut], [p for p in points if key(p) >= cut]
    return tree(sides[0], shards // 2, dims, first) | tree(sides[1], shards - shards // 2, dims, first + shards // 2)


@pytest.mark.parametrize("shards", [2, 5, 13])
def test_shards_equal_a_recursive_split(spark, shards):
    rng = random.Random(shards)
    texts = [prose(rng.randint(0, 60)) for _ in range(70)]
    rows = [(i, texts[rng.randrange(70)] if rng.random() < 0.7 else "copy " * 20, rng.choice(["a", "b", "hot", "hot", None]), rng.choice(["en", "fr"])) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").repartition(3)
    dims = ("source", "lang", "size")
    meta = op07_sharding.metadata(docs, dims)
    found = op07_sharding.points(meta, shards, 3).collect()
    want = tree([(p["size"], p.tie, p.c0, p.c1, p.c2, p.row if p.grp is None else bytes(p.grp)) for p in found], shards, 3)
    groups = {r.row: bytes(r.grp) for r in meta.collect()}
    by_id = {r.doc_id: r.row for r in meta.collect()}
    got = op07_sharding.shard(docs, shards, dims, tolerance=0).collect()
    assert {r.doc_id: r.shard for r in got} == {d: want.get(groups[x], want.get(x)) for d, x in by_id.items()}
    # Equal texts share a shard unless they outweigh one.
    total, of = sum(r["size"] for r in got), {}
    for r in got:
        of.setdefault(groups[by_id[r.doc_id]], []).append(r)
    cut = [g for g in of.values() if len({r.shard for r in g}) > 1]
    assert all(sum(r["size"] for r in g) * shards > total for g in cut) and (cut or shards == 2)


def test_shards_have_near_equal_bytes_with_a_hot_source(spark):
    rows = spark.range(6000).select(
        F.col("id").alias("doc_id"), F.expr("repeat('x', cast(pmod(hash(id), 500) as int))").alias("text"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 20).cast("string"))).alias("source"),
    )
    sums = [r.n for r in op07_sharding.shard(rows, 7, ("source", "size")).groupBy("shard").agg(F.sum("size").alias("n")).collect()]
    assert len(sums) == 7 and max(sums) - min(sums) <= 12 * 516  # a group of equal texts


# 8


def test_matches_equal_brute_force(spark, empty):
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdehinorst") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 40)))) for i in range(12)] + [(20 + m, "".join(rng.choice("abcdehin ") for _ in range(m)).strip() or "x") for m in (8, 9, 10, 12, 15, 20, 22, 23, 30, 31)] + [(50, None), (51, ""), (52, "?!"), (53, "Qx"), (54, "日本語 テキスト です ね 長い 文章")]
    texts = [(1, None), (2, ""), (3, "the qx."), (4, "日本語 テキスト です ね 長い 文章!"), (5, "of of of " * 300)]
    for d in range(10, 50):
        doc = [rng.choice(words) for _ in range(rng.randint(0, 90))]
        p = list(rng.choice(items[:22])[1])
        for _ in range(rng.randint(0, max(1, len(p) // 7))):
            at = rng.randrange(len(p))
            p[at : at + 1] = rng.choice([["x"], [], [p[at], "y"]])
        doc[len(doc) // 2 : len(doc) // 2] = ["".join(p).upper() + ","]
        texts.append((d, "  ".join(doc)))
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string").withColumn("edits", F.lit(1)), spark.createDataFrame(items, "item_id long, text string")
    want = {(d, i): e for d, t in texts for i, x in items if (e := op08_decontaminate.brute(t, x)) is not None}
    for block in (4 << 20, 200):
        got = op08_decontaminate.matches(docs, bench, block_bytes=block).collect()
        assert {(r.doc_id, r.item_id): r.edits for r in got} == want and len(got) == len(want)
    assert (3, 53) in want and (4, 54) in want
    clean = op08_decontaminate.clean(docs, bench)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in texts} - {d for d, _ in want}
    assert op08_decontaminate.matches(empty, bench).count() == 0 and op08_decontaminate.matches(docs, bench.limit(0)).count() == 0


# 9

BASE_PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d: str) -> bool:
    return sum(v if i % 2 == 0 else (2 * v - 9 if v > 4 else 2 * v) for i, v in enumerate(int(c) for c in reversed(d))) % 10 == 0


def holds(kind: str, m: str) -> bool:
    d = re.sub("[^0-9]", "", m)
    if kind == "ip":
        return all(int(x) <= 255 for x in m.split("."))
    return {"email": True, "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def test_base_spans_equal_plain_patterns(spark, docs, empty):
    rng = random.Random(3)
    bits = ["a", "@", ".", "b.c", "1", "22", "255", "256", "4111 1111 1111 1111", "5500-0000-0000-0004", "+1 (555) 123-4567", " ", "-", "é", "日", "\x01", "+", "(", "%", "_", "9" * 14, "0.0.0.0", "\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 18))) for _ in range(300)]
    texts += ["a@b.c_d@e.f", "1.2.3.4.5.6.7.8", "9" * 20_000, "a" * 30_000 + "@b.c", None, ""]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("base", F.lit(1))
    got = {r.doc_id: r for r in op09_pii.digest(rows).collect()}
    for i, t in enumerate(texts):
        want = [(k, m.start(), m.end()) for k, p in BASE_PATTERNS.items() for m in re.finditer(p, t or "") if holds(k, m[0])]
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(listed.encode()).hexdigest(), (i, t)
        assert [got[i][f"n_{k}"] for k in BASE_PATTERNS] == [sum(w[0] == k for w in want) for k in BASE_PATTERNS]
        assert set(filter(None, listed.split(","))) <= set(got[i].spans.split(","))
    assert op09_pii.digest(docs).count() == len(ROWS) and op09_pii.digest(empty).count() == 0


def test_added_spans_and_redaction(spark):
    rows = [(1, "call me at 555-123-4567 or mail joe (at) foo.com"), (2, "order 555-123-4567 of 2019-2021, pages 120 345 678"), (3, "plain prose of the day at home dot"),
            (4, 'a token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"; token = "too short", tokens of the ' + "x" * 9000 + " a@b.c é"), (5, None)]
    rows = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in op09_pii.redact(rows).collect()}
    assert got[1] == "call me at <phone> or mail <email>" and got[2] == rows.where("doc_id = 2").first().text and "<" not in got[3]
    assert got[4] == 'a token = "<secret>"; token = "too short", tokens of the ' + "x" * 9000 + " <email> é" and got[5] == ""
    listed = {r.doc_id: (r.secrets, r.n_found) for r in op09_pii.digest(rows).collect()}
    assert listed[4] == ("secret:11:51", 2) and listed[1] == ("", 2) and listed[5] == ("", 0)


def test_generators_equal_plain_patterns(spark):
    rng = random.Random(8)
    fill = lambda p: "".join(rng.choice("123456789") if c in "N#" else rng.choice("abcdef0123") if c == "x" else "kamo" if c == "~" else c for c in p)
    shapes = [p for _, p in op09_pii.GOOD + op09_pii.HELD_GOOD] + op09_pii.BAD + op09_pii.HELD_BAD
    texts = ["".join(rng.choice([fill(rng.choice(shapes)), " ", "x", ". ", "é ", "\n"]) for _ in range(rng.randint(0, 14))) for _ in range(250)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    found = F.array(*(F.transform(op09_pii.spans(F.col("text"), p, h), lambda x: F.struct(x["start"], x["end"], x["left"], x["right"])) for _, p, h in op09_pii.MORE))
    some = 0
    for r in rows.select("i", found.alias("found")).collect():
        t = texts[r.i]
        for got, (_, pattern, _) in zip(r.found, op09_pii.MORE, strict=True):
            want = [m.span() for m in re.finditer(pattern, t)]
            assert [(x[0], x[1]) for x in got] == want, (pattern, t)
            assert all(x[2] == t[max(0, x[0] - 32) : x[0]] and t[x[1] :].startswith(x[3]) for x in got)
            some += len(want)
    assert some > 150


def test_trees_in_columns_equal_the_fitted_ones(spark):
    trees, curve, least = op09_pii.fitted(spark)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 9, (200, len(op09_pii.FEATURES))).astype(float)
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "i int, f array<double>")
    for r in rows.select("i", op09_pii.scored(trees, curve, F.col("f")).alias("p")).collect():
        total = op09_pii.RATE * sum(op09_pii.value_of(t, x[r.i]) for t in trees)
        assert r.p == pytest.approx(1 / (1 + np.exp(-(curve[0] * total + curve[1]))), abs=1e-9)
    assert all(0.5 <= v <= 1.1 for v in least)


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(12)

    def some(n: int, most: int) -> list:
        starts = [rng.randrange(300) for _ in range(n)]
        return [(a, a + rng.randint(1, most)) for a in starts]

    rows = [(i, some(rng.randint(0, 30), 12), [(a, b, rng.randrange(4), rng.randrange(5) / 4) for a, b in set(some(rng.randint(0, 40), 15))]) for i in range(60)]
    rows.append((60, some(700, 3), [(a, b, 1, 0.5) for a, b in set(some(900, 4))]))
    frame = spark.createDataFrame(rows, f"i int, base array<struct<start:int,end:int>>, proposed array<{op09_pii.PROPOSED}>")
    free = op09_pii.free_of(F.col("base"), F.col("proposed"))
    got = frame.withColumn("free", free).withColumn("best", op09_pii.best_of(F.col("free"))).collect()
    for r, (_, base, proposed) in zip(sorted(got, key=lambda r: r.i), rows, strict=True):
        want = [c for c in proposed if not any(a < c[1] and c[0] < b for a, b in base)]
        assert sorted(map(tuple, r.free)) == sorted(want)
        runs: list = []
        for c in sorted(want):
            if not runs or c[0] >= max(x[1] for x in runs[-1]):
                runs.append([])
            runs[-1].append(c)
        assert sorted(map(tuple, r.best)) == sorted(max(x, key=lambda c: (c[3], c[1] - c[0], -c[0], -c[2])) for x in runs)


def test_patterns_that_were_not_fitted(spark):
    made = op09_pii.examples(800, 5, op09_pii.HELD_GOOD, op09_pii.HELD_BAD)
    rows = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(made)], "doc_id long, text string")
    hit = {r.doc_id for r in op09_pii.digest(rows).where("spans <> ''").collect()}
    wanted = {i for i, m in enumerate(made) if m[3]}
    assert len(hit & wanted) / len(hit) >= 0.9 and len(hit & wanted) / len(wanted) >= 0.6, (len(hit & wanted) / len(hit), len(hit & wanted) / len(wanted))


def test_many_matches_take_time_in_proportion(spark):
    text = ", ".join(f"call 0{i % 90 + 10} {i % 900 + 100} {i % 9000 + 1000} or a{i}@b.com" for i in range(12_000))
    began = time.monotonic()
    got = op09_pii.digest(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_email == 12_000 and got.n_found > 20_000 and time.monotonic() - began < 150


# 10


def test_archives_round_trip(spark):
    page = "<p>" + "ö\r\n\r\nWARC/1.0\r\n" * 80 + "</p>"
    rows = [(1, "https://a.example.com/x?q=1#f", page), (2, "http://A.example.com", page), (3, None, page), (4, "mailto:x", "small"), (5, "http://b.org/\r\nx", "small"), (6, "http://a.example.com/x?q=1", None),
            (7, "http://c.org", ""), (8, "http://c.org", LONG * 3), (None, "http://c.org", "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit(1), "holder": F.lit(2)}).repartition(3)
    got = {r.page_id: r for r in op10_warc.archive(spark, pages).collect()}
    assert len(got) == len(rows)
    for i, url, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 3) if i in (1, 2) else ("response", None))
        assert got[i].url_key == op10_warc.url_key(url and url.replace("\r", "%0D").replace("\n", "%0A"))
    order = sorted(rows, key=lambda r: (got[r[0]].url_key.encode(), got[r[0]].stamp, -1 if r[0] is None else r[0]))
    assert [r[0] for r in order] == [p for p, _ in sorted(((p, r.history_rank) for p, r in got.items()), key=lambda x: x[1])]
    assert op10_warc.archive(spark, pages.limit(0)).count() == 0


def test_archives_of_repeated_ids_and_many_files(spark):
    big = "<p>" + "word é " * 400 + "</p>"
    rows = [(5, "http://a.org", big), (5, "http://a.org", big), (3, "http://b.org", big), (None, "http://c.org", big), (7, "http://d.org", big + "x"), (7, "http://e.org", "small"), (None, "http://f.org", big + "y"), (None, "http://f.org", big + "y")]
    rows += [(100 + i, f"http://h{i % 7}.org/{i}", f"{i} " * 900) for i in range(60)] + [(300 + i, "http://hot.org", "hot " * 300) for i in range(50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    path = f"{shared_folder(spark)}/many-archives"
    op10_warc.write_archives(pages, path, archive_bytes=9000)
    found = op10_warc.read_captures(spark, path)
    got = op10_warc.merged(found, task_rows=40).collect()
    assert len(got) == len(rows) and sorted(r.history_rank for r in got) == list(range(len(rows)))
    assert sorted((r.record_type, r.refers_to) for r in got if r.page_id == 5) == [("response", None), ("revisit", 5)]
    assert [(r.record_type, r.refers_to) for r in got if r.page_id == 3] == [("revisit", 5)]
    assert sorted((r.url_key, r.record_type, r.refers_to) for r in got if r.page_id is None) == [("org,c)/", "revisit", 5), ("org,f)/", "response", None), ("org,f)/", "response", None)]
    assert [r.record_type for r in got if r.page_id and r.page_id >= 300] == ["revisit"] * 49 + ["response"]
    size = {t: len((t or "").encode()) for _, _, t in rows}
    assert bag((r.page_id, r.payload_bytes, r.payload_digest) for r in got) == bag((p, size[t], hashlib.sha1(t.encode()).hexdigest()) for p, _, t in rows)
    # A record can be read from its place alone, and archives are as large as asked.
    from pathlib import Path

    files = {f"file:{p}": p.read_bytes() for p in Path(path.removeprefix("file://")).rglob("part-*")}
    assert len(files) > 5 and all(len(x) <= 9000 + 200 for x in files.values())
    for r in got:
        content = files[r.archive.replace("file:///", "file:/")]
        assert next(op10_warc.parse(content, r.place))[1].get("x-page-id") == (None if r.page_id is None else str(r.page_id))
        assert gzip.decompress(content).count(b"WARC/1.0\r\n") == sum(o.archive == r.archive for o in got)


def test_loser_tree_merges_any_number_of_runs():
    rng = random.Random(1)
    for k in range(9):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(7))) for _ in range(k)]
        merged = [x for x, _ in op10_warc.LoserTree([iter([(x, i) for x in r]) for i, r in enumerate(runs)])]
        assert merged == sorted(x for r in runs for x in r)


# Mends: bounded samples, bounded memory, names that clash, zones.


def test_language_sample_is_bounded_whatever_the_ids(spark):
    same = spark.range(200_000).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.when(F.col("id") % 3 == 0, "de").otherwise("en").alias("lang"), F.lit("some text").alias("text"))
    found = op04_language.sample(same, docs_per_lang=150, windows=1, span=64, most=30_000)
    assert 150 < len(found) < 500 and {x for _, x in found} == {"de", "en"}
    many = spark.range(5000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id").cast("string")).alias("lang"), F.lit("some text").alias("text"))
    assert 500 < len(op04_language.sample(many, docs_per_lang=150, windows=1, span=64, most=1000)) < 1500


def test_decontamination_of_a_very_long_repeated_text_takes_bounded_memory():
    import tracemalloc

    items = [f"{prose(20)} of the {prose(20)} of the of the" for _ in range(300)]
    (index,) = op08_decontaminate.indexes(list(range(300)), [op08_decontaminate.normalise(x) for x in items], 0.1)
    text = op08_decontaminate.normalise("of the " * 200_000 + items[7] + " of the" * 1000)
    tracemalloc.start()
    found = list(index.matches(text))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [f[0] for f in found] == [7] and found[0][3] == 0 and most < 400e6


def test_decontamination_in_pieces_finds_what_the_whole_finds(monkeypatch):
    base = [prose(RNG.randint(5, 40)) for _ in range(12)] + ["abcd", "abc", "the of the of the of the of"]
    texts = []
    for _ in range(12):
        words = prose(300).split(" ")
        for item in RNG.sample(base, 3):
            broken = list(item)
            for _ in range(RNG.randint(0, max(0, len(item) // 14))):
                broken[RNG.randrange(len(broken))] = RNG.choice("abx ")
            words.insert(RNG.randrange(len(words)), "".join(broken))
        texts.append(op08_decontaminate.normalise(" ".join(words) + " the of" * 60))
    plain = [op08_decontaminate.normalise(x) for x in base]
    whole = [sorted((i, e) for index in op08_decontaminate.indexes(list(range(len(plain))), plain, 0.1) for i, _, _, e in ((index.ids[i], a, b, e) for i, a, b, e in index.matches(t))) for t in texts]
    monkeypatch.setattr(op08_decontaminate, "STEP", 40)
    monkeypatch.setattr(op08_decontaminate, "PIECE", 64)
    cut = [sorted((i, e) for index in op08_decontaminate.indexes(list(range(len(plain))), plain, 0.1) for i, _, _, e in ((index.ids[i], a, b, e) for i, a, b, e in index.matches(t))) for t in texts]
    assert cut == whole
    for t, found in zip(texts, whole, strict=True):
        assert found == [(i, e) for i, p in enumerate(plain) if (e := op08_decontaminate.brute(t, p)) is not None]


def test_stages_keep_columns_whatever_they_are_called(spark):
    names = ["_mx_id", "_mx_digest", "_mx_hit", "_mx_doc", "_mx_row", "_mx_guess", "_MX_WORD", "_mx_bits", "_mx_at"]
    rows = [(1, BASE), (2, BASE), (3, "other words of another text"), (4, LONG)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.concat(F.lit(f"{c} "), F.col("doc_id").cast("string")) for c in names})
    items = spark.createDataFrame([(9, "other words of another text")], "item_id long, text string")
    net = op04_language.train([(x.encode()[:60], lang) for _, x, lang in ROWS if x and lang], steps=2)
    for kept in (op05_exact.keep_one(docs), op01_simhash.keep_one(docs), op08_decontaminate.clean(docs, items), op04_language.keep_known(docs, net, 0.0)):
        assert kept.columns == docs.columns and kept.count() >= 3
        assert all(r[c] == f"{c} {r['doc_id']}" for r in kept.collect() for c in names)


def test_archives_in_another_zone(spark):
    pages = spark.createDataFrame([(i, "http://a.org/x", "x") for i in (0, 26_682_598, 26_682_600)], "page_id long, url string, html string")
    plain = [tuple(r) for r in op10_warc.archive(spark, pages).select("page_id", "stamp", "history_rank").orderBy("page_id").collect()]
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        other = [tuple(r) for r in op10_warc.archive(spark, pages).select("page_id", "stamp", "history_rank").orderBy("page_id").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert other == plain and plain[0][1] == "2024-01-01T00:00:00Z" and [r[2] for r in plain] == [0, 1, 2]


def test_packing_is_online_and_close_to_full():
    rng = random.Random(5)
    lengths = [min(2048, int(rng.paretovariate(1.1) * 60)) for _ in range(20_000)]
    bins = op06_packing.OpenBins(2048, 4096)
    for n in lengths:
        bins.place(n)
    assert bins.made <= 1.02 * sum(lengths) / 2048 + 1
