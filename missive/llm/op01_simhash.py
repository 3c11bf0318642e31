"""SimHash near-duplicates by segment popcounts.

A document's fingerprint has a bit set where over half of its word shingles' hashes have it
set.  Two fingerprints link when they differ in at most ``max_bits`` bits.

The search embeds a fingerprint as the bit counts of its 32 two-bit segments.  The Manhattan
distance of two such vectors is a lower bound of the Hamming distance, as a flipped bit moves
one count by one.  The vector is kept as a long in unary (count 0, 1, 2 as ``00 01 11``), so
the Manhattan distance is one ``bit_count`` of an XOR.  The grid: the vector's coordinates
are cut into ``blocks`` runs; vectors within distance ``max_bits`` must agree exactly in all
but ``max_bits`` of them, so every point is put into one unit cell for each choice of
``blocks - max_bits`` runs and cells are equi-joined: in the chosen coordinates a cell is a
range of width 0, in the others it is the whole axis.  Pairs in a cell pass the Manhattan
bound, then the exact Hamming distance.  A link is reported by the first cell that both
share, so once.

Only distinct fingerprints enter the search, so groups of exact copies cost nothing.  A cell
of more than ``cell_rows`` fingerprints is dealt into slices, each slice against the whole
cell in a task of its own: no cap and no unbounded group.

Edge cases: null, empty and blank texts have fingerprint zero, which links like any other;
fewer words than a shingle make one shingle; repeated rows and equal ids give a row each;
an empty table gives an empty result; a null id takes part but never names a component.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import discard, free_names, join_groups, materialize, slices

SEED = 42
#: Bits in the low place of each two-bit segment.
LOW = 0x5555555555555555
#: Tables of up to this many rows of 16 bytes are sent to all executors.
SMALL = 500_000
#: Shingles whose bits are unpacked at a time.
CHUNK = 1 << 15


def shingle_hashes(text: bytes | None, width: int) -> np.ndarray:
    """XXH64 of the word shingles, repeats included."""
    words = (text or b"").lower().split()  # bytes: ASCII letters and the six ASCII blanks only
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) <= width:
        found = [b" ".join(words)]
    else:
        found = list(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False)))
    return np.fromiter((xxhash.xxh64_intdigest(x, SEED) for x in found), dtype=np.uint64, count=len(found))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint as an unsigned integer."""
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a long)."""

    def run(batches):
        for batch in slices(batches):
            hashes = (shingle_hashes(x.as_py(), shingle) for x in batch.column(1))
            prints = [majority(h) for h in hashes]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(prints, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def embed(fp: Column) -> Column:
    """Per-segment bit counts in unary, packed into a long."""
    one = fp.bitwiseOR(F.shiftright(fp, 1)).bitwiseAND(F.lit(LOW))
    two = fp.bitwiseAND(F.shiftright(fp, 1)).bitwiseAND(F.lit(LOW))
    return one.bitwiseOR(F.shiftleft(two, 1))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grid_masks(blocks: int, agree: int) -> list[int]:
    """The bits that a grid compares, for each choice of ``agree`` runs of segments."""
    edges = [round(32 * i / blocks) for i in range(blocks + 1)]
    runs = [((1 << 2 * (b - a)) - 1) << 2 * a for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(x)) for x in combinations(runs, agree)]


def pick_blocks(n: int, max_bits: int) -> int:
    """The number of runs with the least work for ``n`` fingerprints; any number is exact.

    A two-bit segment's count is equal by chance in 3 of 8 cases."""

    def work(blocks: int) -> float:
        agree = blocks - max_bits
        grids = comb(blocks, agree)
        return n * grids * 40 + n * n / 2 * grids * 0.375 ** (32 * agree / blocks)

    return min(range(max_bits + 2, max_bits + 9), key=work)


def links(nodes: DataFrame, max_bits: int = 2, blocks: int | None = None, cell_rows: int = 4096) -> DataFrame:
    """``a, b, bits``: the pairs of distinct ``fp`` that differ in at most ``max_bits`` bits."""
    points = nodes.select("fp", embed(F.col("fp")).alias("at"))
    blocks = blocks or pick_blocks(nodes.count(), max_bits)
    masks = grid_masks(blocks, blocks - max_bits)
    grid = points.select("fp", "at", F.posexplode(F.array(*map(F.lit, masks))).alias("g", "mask"))
    grid = grid.select("fp", "g", F.col("at").bitwiseAND(F.col("mask")).alias("cell"))
    hot = materialize(grid.groupBy("g", "cell").count().where(F.col("count") > cell_rows), "hot_cells")
    left, right = grid.withColumn("part", F.lit(0)), grid.withColumn("part", F.lit(0))
    if not hot.isEmpty():
        parts = F.ceil(F.col("count") / cell_rows).cast("int")
        dealt = grid.join(hot, ["g", "cell"], "left").withColumn("parts", F.coalesce(parts, F.lit(1)))
        left = dealt.withColumn("part", F.pmod(F.hash("fp"), F.col("parts"))).select("fp", "g", "cell", "part")
        right = dealt.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("fp", "g", "cell", "part")
    a = left.select(F.col("fp").alias("a"), "g", "cell", "part")
    b = right.select(F.col("fp").alias("b"), F.col("g").alias("g2"), F.col("cell").alias("cell2"), F.col("part").alias("part2"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    apart = embed(F.col("a")).bitwiseXOR(embed(F.col("b")))
    first = F.array_position(F.array(*(apart.bitwiseAND(F.lit(m)) == 0 for m in masks)), True) - 1
    where = (F.col("g") == F.col("g2")) & (F.col("cell") == F.col("cell2")) & (F.col("part") == F.col("part2")) & (F.col("a") < F.col("b"))
    close = (F.bit_count(apart) <= max_bits) & (F.bit_count(differ) <= max_bits)
    return a.join(b, where & close & (first == F.col("g")), "inner").select("a", "b", F.bit_count(differ).alias("bits"))


def components(edges: DataFrame) -> DataFrame:
    """``node, root``: the smallest node that each node of ``edges(a, b)`` can reach.

    Alternating stars: every node hands its larger neighbours to its smallest one, then its
    smaller ones, until nothing changes.  Each round is written to the shared folder, and only
    counts and a checksum of the edges reach the driver."""

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def star(e: DataFrame, tag: str) -> DataFrame:
        # A component becomes a star: its root then has as many rows as the component has nodes.
        least = materialize(e.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"), F.count("*").alias("n")), "least")
        joined = join_groups(e, least, "u")
        if tag == "large":
            out = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        out = materialize(out.where(F.col("u") != F.col("v")).distinct(), tag)
        discard(least)
        return out

    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where(F.col("u") != F.col("v")).distinct()
    now = materialize(now, "edges")
    before = mark(now)
    while before[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, "large")
        small = star(large, "small")
        discard(now, large)
        now = small
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_duplicates(
    docs: DataFrame,
    shingle: int = 3,
    max_bits: int = 2,
    blocks: int | None = None,
    cell_rows: int = 4096,
) -> DataFrame:
    """``doc_id, fp, component_id, group_size``: a row for each row of ``docs``."""
    prints = materialize(fingerprints(docs, shingle), "fingerprints")
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"))
    nodes = materialize(nodes, "nodes")
    pairs = links(nodes, max_bits, blocks, cell_rows)
    roots = components(pairs.select("a", "b"))
    # A node's root is its component's smallest fingerprint; the id is the smallest document's.
    named = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", "n", F.coalesce("root", "fp").alias("root"))
    whole = named.groupBy("root").agg(F.min("rep").alias("component_id"), F.sum("n").alias("group_size"))
    named = materialize(named.join(whole, "root").select("fp", "component_id", "group_size", "n"), "named")
    return join_groups(prints.select("doc_id", "fp"), named, "fp").select("doc_id", "fp", "component_id", "group_size")


def keep_one(docs: DataFrame, similarity: float = 0.8, compared: int = 5) -> DataFrame:
    """``docs`` with one document, that with the smallest id, of each group of near duplicates:
    texts whose sets of shingles of ``compared`` words have at least the Jaccard ``similarity``, all
    of them found and decided exactly.  Rows with a null id stay; rows that repeat an id stay or
    go together."""
    from missive.llm.op01_shingles import near_copies

    columns = docs.columns
    (gone_id,) = free_names(docs, "_mx_id")
    found = near_copies(docs, similarity, compared)
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias(gone_id)).distinct()
    gone = materialize(gone, "near_copies")
    if gone.count() <= SMALL:
        gone = F.broadcast(gone)
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(gone_id), "left_anti").select(*(f"`{c}`" for c in columns))


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def brute(rows: list[tuple[int, str | None]], shingle: int = 3, max_bits: int = 2) -> dict[int, tuple[str, int]]:
    """Every pair compared, for tests: id to fingerprint and component."""
    prints = {d: majority(shingle_hashes(t.encode() if t else b"", shingle)) for d, t in rows}
    root = {d: d for d in prints}

    def find(x: int) -> int:
        return x if root[x] == x else find(root[x])

    for x, y in combinations(sorted(prints), 2):
        if (prints[x] ^ prints[y]).bit_count() <= max_bits:
            i, j = sorted((find(x), find(y)))
            root[j] = i
    return {d: (f"{p:016x}", find(d)) for d, p in prints.items()}
