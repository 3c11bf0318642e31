"""Near copies by an exact set-similarity join on word shingles.

A text is the set of its shingles (64-bit hashes); texts with equal sets are one node.  Nodes
link when the Jaccard similarity of their sets is at least ``similarity``.

The join is complete.  With all shingles in one order, two sets that are similar enough share
one of the first ``n - ceil(similarity * n) + 1`` shingles of each (prefix bound).  The order is
rare first, then by the hash; it decides on cost only, any order is exact.  Frequent are shingles
that are so in some run of texts, and, as a passage that many texts quote is spread over the runs, those that
more than ``FEW`` texts have of the texts that meet in so large a group of a prefix shingle: all shingles of such texts are
counted and the prefixes are taken again.  A shingle that is not frequent then has at most ``2 * FEW`` nodes, however
large the table is; a frequent one is in a prefix only where a text has too few others.  Two more bounds lose nothing: the sizes' ratio,
and the distance of two parity signatures (every shingle flips one of 512 bits), which is at
most the size of the sets' symmetric difference.  In the exact join a third one is added: of two sets the first shingle in common
cannot stand so late in either that too few follow it.  Pairs that pass are held against signatures
with about a bit for each shingle, and what is left is decided on the whole sets.

Sets are not stored: they are hashed from the text in each of two or three passes, and again for the
texts of pairs that are compared, so ``docs`` should be a written table.

Only components are needed, so a group of near copies does not make all of its pairs: first
nodes whose SimHash fingerprints differ in at most two bits are compared, found by ``op01_simhash.links``, and
every node with one node of each prefix shingle that it has, that with the most shared ones; then, as fingerprints and leaders miss some,
of shingles whose nodes are in more than one component so far, the nodes of different components.
A shingle of more than ``cell_rows`` of these is dealt into slices.

Edge cases: null, empty and blank texts have the empty set, which is one node; a null id takes
part but never names a component; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bitmap, bounded_batches, discard, join_groups, materialize, slices, with_marks
from missive.llm.op01_simhash import SMALL, components, fingerprints, links

#: Longs of a parity signature.
LANES = 8
#: Shingles that are counted together, the count from which one is told, and how many are kept.
COUNTED, OFTEN, HOT = 1 << 20, 4, 50_000
#: Nodes that may have a prefix shingle in common before it is frequent, and the bits of the map of frequent ones.
FEW, TOLD_BITS = 16, 25
#: An odd number that spreads bits.
MIX = np.uint64(0x9E3779B97F4A7C15)
#: What rounding may take from a bound.
SLACK = 1e-9


def signature(found: np.ndarray, bits: int = 64 * LANES) -> np.ndarray:
    """The parity of how many shingles fall on each of ``bits`` places, as longs.  Halves laid on
    each other are the signature of half the bits."""
    odd = np.bincount((found & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def set_of(text: bytes | None, shingle: int) -> tuple[np.ndarray, bytes]:
    """The distinct shingles in order, as hashes of their words' hashes, and the set's bytes."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and the six ASCII blanks only
    each = np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    width = min(shingle, len(words))
    h = each[: len(words) - width + 1] if width else each
    for i in range(1, width):
        h = (h ^ (h >> np.uint64(29))) * MIX + each[i : len(words) - width + 1 + i]
    h = (h ^ (h >> np.uint64(32))) * MIX
    found = np.unique(h ^ (h >> np.uint64(29)))
    return found, found.astype("<u8").tobytes()


def name_of(raw: bytes, salt: int) -> int:
    """A set's name, signed."""
    n = xxhash.xxh64_intdigest(raw, salt)
    return n - (1 << 64) if n >> 63 else n


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))


def shingle_sets(docs: DataFrame, shingle: int, salt: int) -> DataFrame:
    """``doc_id, node, whole, n, s0...`` (``node``: the set's name, ``whole``: a longer one), and rows with ``tok, times`` alone for shingles that are
    frequent in a run of texts."""
    lanes = [f"s{i}" for i in range(LANES)]
    names = ["doc_id", "node", "whole", "n", *lanes, "tok", "times"]

    def often(sets: list) -> pa.RecordBatch:
        tok, times = np.unique(np.concatenate(sets), return_counts=True)
        tok, times = tok[times >= OFTEN], times[times >= OFTEN]
        none = [pa.nulls(len(tok), t) for t in (pa.int64(), pa.int64(), pa.binary(), *[pa.int64()] * (1 + LANES))]
        return pa.RecordBatch.from_arrays([*none, pa.array(tok.view(np.int64)), pa.array(times, pa.int64())], names=names)

    def run(batches):
        held, size = [], 0
        for batch in slices(batches):
            sets = [set_of(x.as_py(), shingle) for x in batch.column(1)]
            signs = np.array([signature(x) for x, _ in sets], dtype=np.int64).reshape(-1, LANES)
            names_of = [name_of(raw, salt) for _, raw in sets], [xxhash.xxh128_digest(raw) for _, raw in sets]
            out = [batch.column(0), pa.array(names_of[0], pa.int64()), pa.array(names_of[1], pa.binary()), pa.array([len(x) for x, _ in sets], pa.int64())]
            out += [pa.array(np.ascontiguousarray(signs[:, i])) for i in range(LANES)]
            out += [pa.nulls(len(sets), pa.int64()), pa.nulls(len(sets), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=names)
            for x, _ in sets:
                held.append(x)
                size += len(x)
                if size > COUNTED:
                    yield often(held)
                    held, size = [], 0
        if held:
            yield often(held)

    schema = f"doc_id long, node long, whole binary, n long, {', '.join(f'{x} long' for x in lanes)}, tok long, times long"
    return _texts(docs).mapInArrow(run, schema)


def prefix_size(n: int, similarity: float) -> int:
    return n - math.ceil(similarity * n - SLACK) + 1


def told(often: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``prefixes`` knows of frequent shingles: one bit for each place that one of ``often(tok, times)`` falls on, and the
    ``HOT`` most frequent with their counts.  However many there are, its size is bounded."""
    at = often.select(F.shiftrightunsigned("tok", 64 - TOLD_BITS).alias("at"))
    bit = F.expr("shiftleft(1L, cast(at % 64 as int))")
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits")).toArrow()
    places = np.zeros(1 << TOLD_BITS - 6, dtype=np.int64)
    places[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    hot = often.orderBy(F.desc("times"), "tok").limit(HOT).select("tok", "times").toArrow().sort_by("tok")
    return places.view(np.uint64), hot.column("tok").to_numpy(), hot.column("times").to_numpy()


def prefixes(docs: DataFrame, shingle: int, salt: int, similarity: float, often: DataFrame) -> DataFrame:
    """``tok, node, place``: the first shingles of each set, the rare ones before those of ``often(tok, times)``, numbered from 0."""
    places, tokens, times = told(often)

    def run(batches):
        for batch in slices(batches):
            found, owners, at_place = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for text in batch.column(1):
                x, raw = set_of(text.as_py(), shingle)
                at = x >> np.uint64(64 - TOLD_BITS)
                known = places[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)
                x = x.view(np.int64)
                if not len(x):
                    continue
                many = np.zeros(len(x), dtype=np.int64)
                if len(tokens):
                    at = np.minimum(np.searchsorted(tokens, x), len(tokens) - 1)
                    many = np.where(tokens[at] == x, times[at], 0)
                first = x[np.lexsort((x, many, known))[: prefix_size(len(x), similarity)]]
                found.append(first)
                owners.append(np.full(len(first), name_of(raw, salt)))
                at_place.append(np.arange(len(first)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (found, owners, at_place)], names=["tok", "node", "place"])

    return _texts(docs).mapInArrow(run, "tok long, node long, place long")


def shared_prefixes(docs: DataFrame, shingle: int, salt: int, similarity: float, often: DataFrame) -> DataFrame:
    """``tok, node, place``: the shingles of ``prefixes`` that more than one text has there."""
    # Most shingles have one text: only those with more are kept, of the others most by a bitmap.
    first = materialize(prefixes(docs, shingle, salt, similarity, often), "firsts")
    shared = materialize(first.groupBy("tok").count().where("count > 1").select("tok"), "shared")
    points = with_marks(first, bitmap(shared, F.col("tok"), "shared_map"), F.col("tok"), "seen").where("seen").drop("seen")
    if shared.count() <= SMALL:
        shared = F.broadcast(shared)
    points = materialize(points.join(shared, "tok", "left_semi").distinct(), "prefixes")
    discard(first)
    return points


def crowded_shingles(docs: DataFrame, nodes: DataFrame, points: DataFrame, shingle: int) -> DataFrame | None:
    """``tok, times``: the shingles, in prefixes or not, that more than ``FEW`` texts have of those that share one of ``points(tok, node)``
    with as many; None if there are none."""
    crowds = materialize(points.groupBy("tok").agg(F.count("*").alias("n")).where(F.col("n") > FEW), "crowds")
    if crowds.isEmpty():
        return None
    within = join_groups(points, crowds, "tok", how="inner").select("node").distinct()
    marks = bitmap(within.join(nodes.select("node", "rep"), "node"), F.col("rep"), "crowd_map")

    def run(batches):
        for batch in slices(batches, 64):
            sets = [set_of(x.as_py(), shingle)[0] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets).view(np.int64))], names=["tok"])

    texts = with_marks(_texts(docs), marks, F.col("doc_id"), "_on").where("_on").select("doc_id", "text")
    return materialize(texts.mapInArrow(run, "tok long").groupBy("tok").agg(F.count("*").alias("times")).where(F.col("times") > FEW), "crowded")


def may_link(a: str, b: str, similarity: float) -> Column:
    """The bounds on sizes and signatures, for two sides whose columns begin with ``a`` and ``b``."""
    na, nb = F.col(a + "n"), F.col(b + "n")
    apart = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{a}s{i}").bitwiseXOR(F.col(f"{b}s{i}"))) for i in range(LANES)])
    most = (na + nb) * F.lit((1 - similarity) / (1 + similarity)) + SLACK
    return (F.least(na, nb) >= F.greatest(na, nb) * F.lit(similarity) - SLACK) & (apart <= most)


def least_apart(x: bytes, y: bytes) -> int:
    """A lower bound of the size of two sets' symmetric difference, from signatures of any lengths."""
    x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")  # of signed numbers bitwise_count takes the absolute value
    size = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def of_nodes(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, shingle: int, salt: int, whole: bool, tag: str) -> DataFrame:
    """``node, x``: the signature of about a bit for each shingle, or the ``whole`` set, of the
    nodes in ``pairs``, from the texts of their smallest ids."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    ends = materialize(ends.join(nodes.select("node", "rep"), "node"), tag + "_ends")
    reps = ends.select(F.col("rep").alias("_mx_rep")).distinct()
    names = ends.select(F.col("node"))
    if ends.count() <= SMALL:
        reps, names = F.broadcast(reps), F.broadcast(names)

    def run(batches):
        for batch in slices(batches, 64):
            sets = [set_of(x.as_py(), shingle) for x in batch.column(1)]
            out = [raw if whole else signature(x, max(64 * LANES, 1 << len(x).bit_length())).tobytes() for x, raw in sets]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(raw, salt) for _, raw in sets], pa.int64()), pa.array(out, pa.binary())], names=["node", "x"])

    texts = _texts(docs)
    rows = texts.join(reps, texts["doc_id"].eqNullSafe(reps["_mx_rep"]), "left_semi").mapInArrow(run, "node long, x binary")
    return materialize(rows.join(names, "node", "left_semi").groupBy("node").agg(F.first("x").alias("x")), tag)


def similar(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, shingle: int, salt: int, tag: str) -> DataFrame:
    """The pairs ``a, b`` of nodes whose whole sets are as similar as asked.  Longer signatures leave
    few pairs of which the sets are compared."""

    def near(x: bytes, y: bytes, na: int, nb: int) -> bool:
        return least_apart(x, y) <= (na + nb) * (1 - similarity) / (1 + similarity) + SLACK

    def alike(x: bytes, y: bytes, na: int, nb: int) -> bool:
        shared = len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True))
        return shared >= similarity * (na + nb - shared) - SLACK

    def kept(test):
        def run(batches):
            for batch in slices(batches, 64):
                found = [test(*(v.as_py() for v in row)) for row in zip(*(batch.column(i) for i in range(2, 6)), strict=True)]
                yield batch.select([0, 1]).filter(pa.array(found, pa.bool_()))

        return run

    sizes = nodes.select("node", "n")
    for name, test, whole in (("_signed", near, False), ("_links", alike, True)):
        held = of_nodes(docs, nodes, pairs, shingle, salt, whole, tag + name + "_sets")
        one = held.join(sizes, "node")
        both = pairs.join(one.select(F.col("node").alias("a"), F.col("x"), F.col("n").alias("na")), "a")
        both = both.join(one.select(F.col("node").alias("b"), F.col("x").alias("y"), F.col("n").alias("nb")), "b")
        pairs = materialize(both.select("a", "b", "x", "y", "na", "nb").mapInArrow(kept(test), "a long, b long"), tag + name)
        discard(held)
    return pairs


def cross_pairs(points: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """``a, b``: nodes of ``points(tok, node, place, comp, n, s0...)`` with a shingle in common, not in one
    component, within the bounds.  What stands before the first shingle in common is in one set only, so in the smaller
    set it is among the first ``n * (1 - similarity) / (1 + similarity)``."""
    hot = materialize(points.groupBy("tok").count().where(F.col("count") > cell_rows), "hot_shingles")
    left, right = points.withColumn("part", F.lit(0)), points.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        dealt = points.join(hot, "tok", "left").withColumn("parts", F.coalesce(F.ceil(F.col("count") / cell_rows).cast("int"), F.lit(1))).drop("count")
        left = dealt.withColumn("part", F.pmod(F.hash("node"), F.col("parts"))).drop("parts")
        right = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    left = left.where(F.col("place") <= F.col("n") * F.lit((1 - similarity) / (1 + similarity)) + SLACK)
    a, b = (x.select(*(F.col(c).alias(k + c) for c in x.columns)) for k, x in (("l_", left), ("r_", right)))
    where = (F.col("l_tok") == F.col("r_tok")) & (F.col("l_part") == F.col("r_part")) & (F.col("l_comp") != F.col("r_comp"))
    smaller = (F.col("l_n") < F.col("r_n")) | ((F.col("l_n") == F.col("r_n")) & (F.col("l_node") < F.col("r_node")))
    needed = (F.col("l_n") + F.col("r_n")) * F.lit(similarity / (1 + similarity)) - SLACK
    left_over = F.least(F.col("l_n") - F.col("l_place"), F.col("r_n") - F.col("r_place"))
    pairs = a.join(b, where & smaller & (left_over >= needed) & may_link("l_", "r_", similarity))
    return pairs.select(F.least("l_node", "r_node").alias("a"), F.greatest("l_node", "r_node").alias("b")).distinct()


def close_prints(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b``: nodes whose fingerprints differ in at most two bits, one node standing for each fingerprint, and the others of
    equal ones with it.  Candidates only: a node has the fingerprint of its smallest id."""
    prints = fingerprints(docs, 3).select(F.col("doc_id").alias("rep"), "fp")
    of_reps = materialize(nodes.select("node", "rep").join(prints, "rep").select("node", "fp").distinct(), "prints")
    lead = materialize(of_reps.groupBy("fp").agg(F.min("node").alias("lead"), F.count("*").alias("n")), "leads")
    same = join_groups(of_reps, lead, "fp").where(F.col("node") != F.col("lead")).select(F.col("lead").alias("a"), F.col("node").alias("b"))
    close = materialize(links(lead.select("fp")).select("a", "b"), "close_prints")
    of = lambda k: lead.select(F.col("fp").alias(k), F.col("lead").alias(k + "_lead"))
    return close.join(of("a"), "a").join(of("b"), "b").select(F.col("a_lead").alias("a"), F.col("b_lead").alias("b")).union(same)


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, cell_rows: int = 4096) -> DataFrame:
    """``doc_id, component_id``: a row for each row of ``docs``; the smallest id of its group."""
    lanes = [f"s{i}" for i in range(LANES)]
    bounded_batches(docs.sparkSession)
    salt, clash = 0, True
    while clash:  # a name is 64 bits: no two sets may share one
        salt += 1
        rows = materialize(shingle_sets(docs, shingle, salt), "shingle_sets")
        sets = rows.where("node IS NOT NULL")
        ends = F.min("whole").alias("low"), F.max("whole").alias("high")
        nodes = materialize(sets.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"), *ends, *(F.first(c).alias(c) for c in ("n", *lanes))), "nodes")
        clash = not nodes.where("low < high").isEmpty()
    often = materialize(rows.where("node IS NULL").groupBy("tok").agg(F.sum("times").alias("times")), "often")
    points = shared_prefixes(docs, shingle, salt, similarity, often)
    crowded = crowded_shingles(docs, nodes, points, shingle)
    if crowded is not None:
        discard(points)
        often = materialize(often.union(crowded).groupBy("tok").agg(F.sum("times").alias("times")), "often")
        points = shared_prefixes(docs, shingle, salt, similarity, often)

    side = {k: nodes.select(*(F.col(c).alias(f"{k}_{c}") for c in ("node", "n", *lanes))) for k in "lr"}
    # A source has more shingles in common with others than its edited copies, so it leads.
    shares = points.groupBy("node").agg(F.count("*").alias("m"))
    least = points.join(shares, "node").groupBy("tok").agg(F.max(F.struct("m", "node")).alias("a")).select("tok", "a.node")
    pairs = points.join(least.withColumnRenamed("node", "a"), "tok").where(F.col("a") != F.col("node")).select("a", F.col("node").alias("b"))
    pairs = pairs.union(close_prints(docs, nodes)).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = pairs.join(side["l"], F.col("a") == F.col("l_node")).join(side["r"], F.col("b") == F.col("r_node")).where(may_link("l_", "r_", similarity))
    near = similar(docs, nodes, materialize(pairs.select("a", "b"), "first_pairs"), similarity, shingle, salt, "first")

    roots = materialize(components(near), "first_roots")
    placed = points.join(roots, "node", "left").select("tok", "node", "place", F.coalesce("root", "node").alias("comp"))
    placed = materialize(placed, "placed")
    mixed = placed.groupBy("tok").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("tok")
    rest = placed.join(mixed, "tok", "left_semi").join(nodes.select("node", "n", *lanes), "node")
    more = materialize(cross_pairs(materialize(rest, "mixed"), similarity, cell_rows), "more_pairs")
    near = near.union(similar(docs, nodes, more, similarity, shingle, salt, "more"))
    discard(points, placed)

    named = nodes.select("node", "rep", "docs").join(components(near), "node", "left").select("node", "rep", "docs", F.coalesce("root", "node").alias("root"))
    named = materialize(named, "named")
    whole = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = materialize(named.join(whole, "root").select("node", "component_id", "docs"), "components")
    return join_groups(sets.select("doc_id", "node"), named, "node", "docs").select("doc_id", "component_id")
