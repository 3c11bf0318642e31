"""Benchmark decontamination by q-gram counts in diagonal bands.

Text and benchmark items are normalised: lower case, and runs of other characters than letters
and digits are one space.  An item of ``m`` characters occurs in a document if some region is
within ``k = floor(rate * m)`` edits of it.  By the q-gram lemma such a region shares at
least ``t = m - q + 1 - k q`` of the item's q-grams with it, and since each edit moves the
rest by at most one place, their diagonals (place in the document minus place in the item)
span at most ``k``.  So hits are counted in bands of ``2 (k + 1)`` diagonals that overlap by
half, each diagonal range of ``k`` lying whole in one; bands with fewer than ``t`` hits are
dropped, and the others are verified by an alignment confined to the band.  Items too short
for ``t`` to be 1 with ``q`` of 8 have a ``q`` of 4, with which it always is.

Documents stay in their partitions: nothing of them is shuffled.  The benchmark is the stated
query set; it goes to the executors in blocks of at most ``block_bytes``, one pass over the
documents for each block, so its size has no limit and a broadcast has one.

Edge cases: null and empty texts match nothing; items without letters and digits match
nothing; items of fewer than 8 characters match where they occur as whole words; repeated rows are
rows of their own; an empty table on either side gives an empty result.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from missive.llm.common import bounded_batches, free_names, materialize, slices

#: Widths of q-grams.  Shorter items have none and no budget: they are looked for as they are.
WIDE, NARROW = 8, 4
#: Postings that are expanded at once, and characters of a text whose bands are counted together when it has more.
STEP, PIECE = 1 << 20, 1 << 16
_OTHER = re.compile(r"[\W_]+")
_BASE = 0x9E3779B97F4A7C15
#: Bits of the hash that index the first filter.
FILTER_BITS = 20
SCHEMA = "doc_id long, item_id long, start long, end long, edits int"


#: What ``normalise`` makes of each Latin-1 character.
_LATIN = bytes(ord(chr(b).lower()) if not _OTHER.match(chr(b)) and ord(chr(b).lower()) < 256 else 32 for b in range(256))


def normalise(text: str | None) -> str:
    try:
        # Only blanks are left of what bytes.split cuts at: the table maps the others to them.
        return b" ".join((text or "").encode("latin-1").translate(_LATIN).split()).decode("latin-1")
    except UnicodeEncodeError:
        return _OTHER.sub(" ", text.lower()).strip()


def codes_of(text: str) -> np.ndarray:
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")


def grams(text: str, q: int) -> np.ndarray:
    """A hash of the q-gram at each place, by doubling its width; ``q`` is a power of two."""
    h = codes_of(text).astype(np.uint64)
    if len(h) < q:
        return h[:0]
    width, base = 1, _BASE
    while width < q:
        h = h[:-width] * np.uint64(base) + h[width:]
        base = base * base % (1 << 64)
        base ^= base >> 31
        width *= 2
    return h


def width_of(m: int, rate: float) -> int:
    """The width with which a match of an item of ``m`` characters shares at least one q-gram."""
    return WIDE if m - WIDE + 1 - int(rate * m) * WIDE >= 1 else NARROW


def align(item: np.ndarray, text: np.ndarray, low: int, high: int, most: int) -> tuple[int, int] | None:
    """The least edits that turn ``item`` into a region of ``text`` on diagonals ``low`` to
    ``high``, and where the region ends; None if over ``most``."""
    width = high - low + 1
    far = len(item) + len(text) + 1
    place = np.arange(low, high + 1)
    steps = np.arange(width)
    cost = np.where((place >= 0) & (place <= len(text)), 0, far)  # before the item's first letter
    for j, letter in enumerate(item):
        at = place + j  # text letter that a diagonal pairs with this one
        inside = (at >= 0) & (at < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[at[inside]] == letter
        pair = np.where(inside, cost + ~same, far)
        drop = np.append(cost[1:], far) + 1  # the item's letter has no partner
        cost = np.minimum(pair, drop)
        cost = np.where((at + 1 >= 0) & (at + 1 <= len(text)), cost, far)
        cost = np.minimum.accumulate(cost - steps) + steps  # text letters without a partner
        if cost.min() > most:
            return None
    best = int(cost.argmin())
    return int(cost[best]), int(place[best] + len(item))


@dataclass
class Index:
    """The q-grams of items of a block, for a worker."""

    ids: list[int]
    texts: list[str]
    rate: float
    q: int

    def __post_init__(self):
        self.codes = list(map(codes_of, self.texts))
        self.k = np.array([int(self.rate * len(t)) for t in self.texts], dtype=np.int64)
        self.need = np.array([len(t) - self.q + 1 for t in self.texts], dtype=np.int64) - self.k * self.q
        self.short = [i for i, t in enumerate(self.texts) if 0 < len(t) < self.q]
        each = [grams(t, self.q) for t in self.texts]
        hashes = np.concatenate(each) if each else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(each)), [len(e) for e in each])
        place = np.concatenate([np.arange(len(e)) for e in each]) if each else item
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.keys, self.first, self.count = np.unique(hashes[order], return_index=True, return_counts=True)
        # A slot holds the first of its keys; the few keys after the first are looked up by search.
        slots = (self.keys >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        self.slot = np.full(1 << FILTER_BITS, -1, dtype=np.int32)
        self.slot[slots[::-1]] = np.arange(len(slots) - 1, -1, -1)
        self.shared = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.shared[slots[1:][slots[1:] == slots[:-1]]] = True
        self.longest = max(map(len, self.texts), default=0)
        self.least = max(1, int(self.need.min())) if len(self.need) else 1

    def hits(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text whose q-gram is an item's, and the q-gram's number."""
        h = grams(text, self.q)
        slot = (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
        key = self.slot[slot]
        at = np.flatnonzero(key >= 0)
        h, slot, key = h[at], slot[at], key[at].astype(np.int64)
        more = np.flatnonzero((self.keys[key] != h) & self.shared[slot])
        if len(more):
            key[more] = np.minimum(np.searchsorted(self.keys, h[more]), len(self.keys) - 1)
        right = self.keys[key] == h
        return at[right], key[right]

    def candidates(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Item, and the lowest and highest diagonal of a band with enough hits."""
        if not len(self.keys):
            return
        at, key = self.hits(text)
        if len(at) < self.least:
            return
        if int(self.count[key].sum()) <= STEP:
            yield from self.bands(at, key, len(text))
            return
        # All hits of a band lie within an item's length and its two budgets, so pieces that overlap by that
        # hold every band whole; a band that two of them hold is given twice.
        size, more = max(1024, min(PIECE, STEP // len(self.texts))), self.longest + 2 * (int(self.k.max()) + 1)
        for start in range(-self.longest, len(text), size):
            low, high = np.searchsorted(at, [start, start + size + more])
            if high - low >= self.least:
                yield from self.bands(at[low:high], key[low:high], len(text))

    def bands(self, at: np.ndarray, key: np.ndarray, length: int) -> Iterator[tuple[int, int, int]]:
        """``candidates`` by the hits at some places of a text of that length."""
        n = self.count[key]
        shift, span, wide = self.longest + 2, length + 2 * self.longest + 4, self.longest + 1
        ends = np.cumsum(n)
        total, each = int(ends[-1]), np.empty(0, np.int64)
        first = 0
        while first < len(at):
            last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + STEP, side="right")))
            m, a, k = n[first:last], at[first:last], key[first:last]
            posting = np.repeat(self.first[k] - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
            item, place = self.item[posting], self.place[posting]
            code = item * span + (np.repeat(a, m) - place) // (self.k[item] + 1) + shift
            code, place = np.concatenate([code, code - 1]), np.concatenate([place, place])
            if total <= STEP:
                # Most bands have few hits: those in a bucket with too few for their item go first.
                size = max(1024, 1 << (4 * len(code)).bit_length())
                bucket = code & (size - 1)
                code, place = (x[np.bincount(bucket, minlength=size)[bucket] >= self.need[code // span]] for x in (code, place))
            # What counts is how many of the item's q-grams are there, however often each is.
            new = np.unique(code * wide + place)
            each = np.union1d(each, new) if len(each) else new
            first = last
        codes, counts = np.unique(each // wide, return_counts=True)
        enough = counts >= self.need[codes // span]
        for c in codes[enough]:
            i, b = int(c // span), int(c % span) - shift
            reach = int(self.k[i]) + 1
            yield i, b * reach, (b + 2) * reach - 1

    def matches(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """``item, start, end, edits`` in the normalised text, the best for each item."""
        best: dict[int, tuple[int, int, int]] = {}
        codes = None
        for i, low, high in self.candidates(text):
            if i in best and best[i][0] == 0:
                continue
            m, k = len(self.texts[i]), int(self.k[i])
            exact = text.find(self.texts[i], max(0, low), high + m + 1)
            if exact >= 0:
                best[i] = (0, exact, exact + m)
                continue
            if codes is None:
                codes = codes_of(text)
            found = align(self.codes[i], codes, low - k, high + k, k)
            if found and (i not in best or found[0] < best[i][0]):
                end = found[1]
                back = align(self.codes[i][::-1], codes[:end][::-1], -k, k, k)
                best[i] = (found[0], end - back[1] if back else max(0, end - m), end)
        for i in self.short:
            at = text.find(self.texts[i])
            if at >= 0:
                best[i] = (0, at, at + len(self.texts[i]))
        for i, (edits, start, end) in sorted(best.items()):
            yield i, start, end, edits


def blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[tuple[list[int], list[str]]]:
    """The items in blocks; the driver holds one at a time."""
    ids, texts, size = [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        text = normalise(r[1])
        if not text:
            continue
        if ids and size + 4 * len(text) > block_bytes:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(text)
        size += 4 * len(text)
    if ids:
        yield ids, texts


#: The worker's indexes, by the name of its block.
_INDEXES: dict[str, list[Index]] = {}


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_bytes: int = 4 << 20) -> DataFrame:
    """A row of ``SCHEMA`` for each document and item that occurs in it; ``start`` and ``end`` are
    places in the normalised text.  ``rate`` is at most 0.125."""
    return _found(docs, benchmark, rate, block_bytes)[0].drop("row")


def _found(docs: DataFrame, benchmark: DataFrame, rate: float, block_bytes: int) -> tuple[DataFrame, list]:
    """The matches with a hash of the text as ``row``, and what was broadcast for them."""
    if not 0 <= rate <= 1 / WIDE:
        raise ValueError(f"rate is from 0 to {1 / WIDE}")
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), F.col("text").cast("string").alias("text"))
    found, sent = spark.createDataFrame([], SCHEMA + ", row long"), []
    for ids, texts in blocks(benchmark, block_bytes):
        sent.append(spark.sparkContext.broadcast((ids, texts, rate)))
        found = found.unionByName(rows.mapInArrow(_searcher(uuid.uuid4().hex, sent[-1]), SCHEMA + ", row long"))
    return found, sent


def indexes(ids: list[int], texts: list[str], rate: float) -> list[Index]:
    """An index for the items of each width."""
    width = [width_of(len(t), rate) for t in texts]
    split = {q: [i for i, w in enumerate(width) if w == q] for q in (WIDE, NARROW)}
    return [Index([ids[i] for i in at], [texts[i] for i in at], rate, q) for q, at in split.items() if at]


def _searcher(name, sent):
    def run(batches):
        if name not in _INDEXES:
            _INDEXES.clear()
            _INDEXES[name] = indexes(*sent.value)
        found_by = _INDEXES[name]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        for batch in slices(batches):
            out = []
            for doc, row, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if text.is_valid:
                    plain = normalise(text.as_py())
                    out += [(doc, index.ids[i], a, b, e, row) for index in found_by for i, a, b, e in index.matches(plain)]
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "item_id", "start", "end", "edits", "row"])

    return run


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = 0.1, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` without those in which an item occurs.  A row goes if its id and a hash of its text match."""
    columns = docs.columns
    doc, row = free_names(docs, "_mx_doc", "_mx_row")
    found, sent = _found(docs, benchmark, rate, block_bytes)
    hits = materialize(found.select(F.col("doc_id").alias("hit_id"), F.col("row").alias("hit_row")).distinct(), "contaminated")
    for x in sent:
        x.destroy()
    if hits.count() <= 500_000:  # 16 bytes each
        hits = F.broadcast(hits)
    rows = docs.withColumns({doc: F.col("doc_id").cast("long"), row: F.xxhash64("text")})
    same = rows[doc].eqNullSafe(hits["hit_id"]) & (rows[row] == hits["hit_row"])
    return rows.join(hits, same, "left_anti").select(*(f"`{c}`" for c in columns))


def brute(text: str | None, item: str | None, rate: float = 0.1) -> int | None:
    """The least edits of any region of ``text`` from ``item``, by the full table; None if over
    the budget.  For tests."""
    t, p = normalise(text), normalise(item)
    if not t or not p:
        return None
    row = [0] * (len(t) + 1)
    for j, letter in enumerate(p):
        new = [j + 1]
        for i, other in enumerate(t):
            new.append(min(row[i] + (letter != other), row[i + 1] + 1, new[i] + 1))
        row = new
    best = min(row)
    return best if best <= int(rate * len(p)) else None
