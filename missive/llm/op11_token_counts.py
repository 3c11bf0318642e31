"""Token counts of whole texts, by distinct pre-tokens.

1. A pass over the texts gives the distinct pre-tokens of each partition with the number of documents
   that hold them; summed, that is every pre-token of the corpus once.
2. The library's model counts the pieces of each of these once.
3. A second pass gives the frequencies of pre-tokens in each document.  They are joined to the piece
   counts, and a document's tokens are the sum of frequency times pieces.  No ids are made.

The commonest pre-tokens, ``SMALL_GROUPS`` at most, are sent to all executors.  Frequencies of these are summed to a row a document before anything is
shuffled, and only those of rare pre-tokens are shuffled by pre-token, so no key of the join is hot.

A pre-token is what the library's normaliser and pre-tokeniser make of a text cut at blanks and
line feeds, neither of which any pre-token of a ``word_bpe`` vocabulary holds.  The vocabulary's special
strings in a text are one token each, as the library takes them by default.

Edge cases: null counts as empty, with no bytes and no tokens; rows that repeat an id, or all
columns, are documents of their own; null ids stay null; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from missive.llm.common import SMALL_GROUPS, bounded_batches, materialize, slices
from missive.llm.tokens import byte_letters

LIMIT = 2048
#: Distinct pre-tokens, and their characters, that a task holds before it hands them on.
HELD, HELD_CHARS = 500_000, 32 << 20
#: Units between blanks that a worker remembers, and the longest one.
UNITS, LONGEST = 300_000, 64
#: Frequencies in an Arrow batch.
ROWS = 50_000
#: Numbers of documents up to which pre-tokens are told apart when the commonest are chosen.
APART = 1_000_000
#: What marks a special string: no pre-token holds a blank.
SPECIAL = " "
#: The pre-tokens of a vocabulary of this kind for texts in Latin-1; control characters that Python's split takes for blanks.
LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
ODD = re.compile("[\x1c-\x1f]")


def is_latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True



class PreTokens:
    """A text's pre-tokens and their pieces, by the library's own normaliser, pre-tokeniser and model.

    Texts in Latin-1, which have one normal form, are parted by the vocabulary's pattern as it reads for such."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.letters = byte_letters()
        self.bytes = {c: b for b, c in self.letters.items()}
        self.known: dict[str, tuple[str, ...]] = {}

    def of_unit(self, unit: str, latin: bool) -> tuple[str, ...]:
        found = self.known.get(unit)
        if found is None:
            found = tuple(LATIN.findall(unit.lower())) if latin else tuple(self._split(unit))
            if len(unit) <= LONGEST:
                if len(self.known) >= UNITS:
                    self.known.clear()
                self.known[unit] = found
        return found

    def _split(self, unit: str):
        for part in self.cut.split(unit) if self.cut else [unit]:
            if part in self.special:
                yield SPECIAL + part
            elif part:
                plain = self.tokenizer.normalizer.normalize_str(part)
                for piece, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain):
                    yield bytes(map(self.bytes.__getitem__, piece)).decode()

    def frequencies(self, text: str | None) -> dict[str, int]:
        text = text or ""
        latin = "<|" not in text and not ODD.search(text) and is_latin(text)
        out = Counter(text.lower().split() if latin else text.replace("\n", " ").split(" "))
        for unit in [u for u in out if not u.isalpha()] if latin else list(out):
            n = out.pop(unit)
            for p in self.of_unit(unit, latin):
                out[p] = out.get(p, 0) + n
        return out

    def pieces(self, pretoken: str) -> int:
        if pretoken.startswith(SPECIAL):
            return 1
        return len(self.tokenizer.model.tokenize("".join(map(self.letters.__getitem__, pretoken.encode()))))


_LOADED: dict[str, PreTokens] = {}


def pretokens(vocabulary: str, folder: str | None = None) -> PreTokens:
    """The worker's reader of a vocabulary file; ``folder`` replaces the installed one."""
    path = f"{folder}/{vocabulary}" if folder else str(public_tokenizers.path(vocabulary))
    if path not in _LOADED:
        _LOADED[path] = PreTokens(path)
    return _LOADED[path]


def distinct_pretokens(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """``pretoken, n, pieces``: every pre-token once, the documents that hold it, and its tokens."""

    def local(batches):
        reader, held, chars = pretokens(vocabulary, folder), Counter(), 0

        def flush():
            for at in range(0, len(keys := list(held)), ROWS):
                part = keys[at : at + ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array([held[k] for k in part], pa.int64())], names=["pretoken", "n"])

        for batch in slices(batches):
            for text in batch.column(0):
                before = len(held)
                found = reader.frequencies(text.as_py())
                held.update(found.keys())
                if len(held) > before:
                    chars += sum(map(len, found))
                if len(held) > HELD or chars > HELD_CHARS:
                    yield from flush()
                    held, chars = Counter(), 0
        yield from flush()

    @F.arrow_udf("long")
    def pieces(found: pa.Array) -> pa.Array:
        reader = pretokens(vocabulary, folder)
        return pa.array([reader.pieces(x.as_py()) for x in found], pa.int64())

    texts = docs.select(F.col("text").cast("string").alias("text"))
    found = texts.mapInArrow(local, "pretoken string, n long").groupBy("pretoken").agg(F.sum("n").alias("n"))
    return found.withColumn("pieces", pieces("pretoken"))


def frequencies(docs: DataFrame, vocabulary: str, folder: str | None = None) -> DataFrame:
    """``tag, doc_id, n_bytes, pretoken, freq``: a row for each document and pre-token; one without pre-tokens
    has a row of the empty one."""

    def run(batches):
        reader = pretokens(vocabulary, folder)
        for batch in slices(batches):
            start, ends, names, counts = 0, [0], [], []
            for at, text in enumerate(batch.column(3)):
                found = reader.frequencies(text.as_py()) or {"": 0}
                names.extend(found.keys())
                counts.extend(found.values())
                ends.append(len(names))
                if len(names) > ROWS or at + 1 == batch.num_rows:
                    lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, k)) for x, k in ((names, pa.string()), (counts, pa.int64()))]
                    yield pa.RecordBatch.from_arrays([*(c.slice(start, len(ends) - 1) for c in batch.columns[:3]), *lists], names=["tag", "doc_id", "n_bytes", "pretokens", "freqs"])
                    start, ends, names, counts = at + 1, [0], [], []

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("tag"), F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))
    rows = rows.mapInArrow(run, "tag long, doc_id long, n_bytes long, pretokens array<string>, freqs array<long>")
    return rows.select("tag", "doc_id", "n_bytes", F.inline(F.arrays_zip(F.col("pretokens").alias("pretoken"), F.col("freqs").alias("freq")))).toDF("tag", "doc_id", "n_bytes", "pretoken", "freq")


def least_common(known: DataFrame, most: int) -> int:
    """The number of documents that at most ``most`` pre-tokens exceed; 0 if there are no more than that."""
    sizes = known.groupBy(F.least("n", F.lit(APART)).alias("n")).agg(F.count("*").alias("k"), F.sum("n").alias("rows")).collect()
    held = 0
    for r in sorted(sizes, key=lambda r: -r["n"]):
        held += r["k"]
        if held > most:
            # Of those that are not told apart, fewer than ``most`` stand in more than one row in so many.
            return r["n"] if r["n"] < APART else max(APART, sum(x["rows"] for x in sizes) // most)
    return 0


def token_counts(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", limit: int = LIMIT, folder: str | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit``: a row for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    known = materialize(distinct_pretokens(docs, vocabulary, folder), "pretokens")
    least = least_common(known, SMALL_GROUPS)
    common, rare = known.where(F.col("n") > least), known.where(F.col("n") <= least)
    rows = frequencies(docs, vocabulary, folder)
    rows = rows.join(F.broadcast(common.select("pretoken", "pieces")), "pretoken", "left")
    # A row a document for all its common pre-tokens, and one for each rare one; the empty pre-token counts nothing.
    is_rare = F.col("pieces").isNull() & (F.col("pretoken") != "")
    rows = rows.withColumn("rest", F.when(is_rare, F.col("pretoken")) if least else F.lit(None).cast("string"))
    sums = [F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.coalesce(F.sum(F.col("freq") * F.col("pieces")), F.lit(0)).alias("tokens")]
    if least:
        parts = materialize(rows.groupBy("tag", "rest").agg(*sums, F.sum("freq").alias("freq")), "parts")
        found = parts.where("rest is not null").join(rare.select(F.col("pretoken").alias("rest"), "pieces"), "rest")
        found = found.withColumn("tokens", F.col("freq") * F.col("pieces")).select("tag", "doc_id", "n_bytes", "tokens")
        rows = parts.where("rest is null").select("tag", "doc_id", "n_bytes", "tokens").unionByName(found)
        sums[2] = F.sum("tokens").alias("tokens")
    counted = rows.groupBy("tag").agg(*sums)
    return counted.select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"), (F.col("tokens") > limit).alias("over_limit"))
