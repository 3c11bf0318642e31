"""Language ID with a bidirectional gated recurrent network over bytes.

The network reads a window of bytes forwards and backwards, labels every position with a
distribution over languages, and a document's probabilities are the mean over all positions
of all its windows, which cover its whole text.  It is trained in numpy by backpropagation
through time, on windows of a bounded sample: about ``docs_per_lang`` labelled documents of
each language, fewer if that makes over ``most`` in all, with ``windows`` windows of ``span`` bytes each.  Everything
else reads all rows.

Documents whose ``crc32(doc_id as text) mod 5`` is 0 are held out of training.  Prediction uses
the text alone.

Edge cases: null texts and texts without letters are ``und`` with score 0; null languages
are not learned; without labelled rows everything is ``und``; null ids are not held out;
repeated rows are rows of their own; an empty table gives an empty result; other columns are
ignored here and kept by ``keep_known``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from missive.llm.common import SMALL_GROUPS, bounded_batches, free_names, materialize

HIDDEN = 8
#: Bytes of a window in prediction, and windows that run side by side.
SPAN, LANES = 256, 1024
#: The update gate of padding.
HOLD = 30.0
UNKNOWN = "und"


@dataclass
class Network:
    """Weights for both directions (first axis).  ``table``: what a byte (last axis) adds to the
    gates (reset, update, candidate), an embedding times the input weights; ``loop``: what the
    state adds; ``top``: the state's part of the labels' logits.

    Byte 0 pads windows: it holds the update gate open, so the state passes it unchanged."""

    labels: list[str]
    table: np.ndarray
    loop: np.ndarray
    top: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], rng: np.random.Generator) -> Network:
        draw = lambda *s: rng.normal(0, 0.3, s).astype(np.float32)
        net = cls(labels, draw(2, 3 * HIDDEN, 256), draw(2, 3 * HIDDEN, HIDDEN), draw(2, len(labels), HIDDEN), np.zeros(len(labels), np.float32))
        net.hold()
        return net

    def hold(self) -> None:
        self.table[:, HIDDEN : 2 * HIDDEN, 0] = HOLD

    @property
    def weights(self) -> list[np.ndarray]:
        return [self.table, self.loop, self.top, self.bias]


def both_ways(windows: np.ndarray) -> np.ndarray:
    """Step by step, the bytes that each direction reads: (steps, 2, lanes)."""
    return np.ascontiguousarray(np.stack([windows.T, windows[:, ::-1].T], axis=1))


def forward(net: Network, bytes_in: np.ndarray, keep: bool = False):
    """Logits of the two directions at each step, (steps, 2, labels, lanes); with ``keep`` also
    what training needs.  Lanes are the last axis, so every operation runs over long rows."""
    steps, _, lanes = bytes_in.shape
    kind, two = net.table.dtype, 2 * HIDDEN
    h = np.zeros((2, HIDDEN, lanes), kind)
    given, again = np.empty((2, 3 * HIDDEN, lanes), kind), np.empty((2, 3 * HIDDEN, lanes), kind)
    gates, new = np.empty((2, two, lanes), kind), np.empty((2, HIDDEN, lanes), kind)
    reset, update = gates[:, :HIDDEN], gates[:, HIDDEN:]
    out = np.empty((steps, 2, len(net.labels), lanes), kind)
    kept = []
    for t in range(steps):
        for way in (0, 1):
            np.take(net.table[way], bytes_in[t, way], axis=1, out=given[way], mode="clip")
        np.matmul(net.loop, h, out=again)
        np.add(given[:, :two], again[:, :two], out=gates)
        gates *= 0.5  # the logistic function by way of tanh
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        np.multiply(again[:, two:], reset, out=new)
        new += given[:, two:]
        np.tanh(new, out=new)
        if keep:
            kept.append((h.copy(), reset.copy(), update.copy(), new.copy(), again[:, two:].copy()))
        h -= new
        h *= update
        h += new
        np.matmul(net.top, h, out=out[t])
        if keep:
            kept[-1] += (h.copy(),)
    return (out, kept) if keep else out


def positions(net: Network, out: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The distribution at each position of each window, (steps, labels, lanes); 0 past its end."""
    logits = out[:, 0] + out[::-1, 1]
    logits += net.bias[:, None]
    np.clip(logits, -60, 60, out=logits)
    np.exp(logits, out=logits)
    real = np.arange(out.shape[0])[:, None] < lengths
    logits *= (real / logits.sum(axis=1))[:, None].astype(logits.dtype)
    return logits


def gradients(net: Network, windows: np.ndarray, lengths: np.ndarray, target: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross entropy over all positions, through time."""
    bytes_in = both_ways(windows)
    steps, _, lanes = bytes_in.shape
    out, kept = forward(net, bytes_in, keep=True)
    wrong = positions(net, out, lengths)
    real = np.arange(steps)[:, None] < lengths
    wrong[:, target, np.arange(lanes)] -= real
    wrong /= real.sum()
    by_way = np.stack([wrong, wrong[::-1]], axis=1)  # steps, 2, labels, lanes
    d_table, d_loop, d_top = (np.zeros_like(w) for w in (net.table, net.loop, net.top))
    d_bias = wrong.sum(axis=(0, 2))
    flip = lambda x: x.transpose(0, 2, 1)
    dh = np.zeros((2, HIDDEN, lanes), net.table.dtype)
    for t in reversed(range(steps)):
        before, reset, update, new, again, h = kept[t]
        d_top += by_way[t] @ flip(h)
        dh = dh + flip(net.top) @ by_way[t]
        d_new = dh * (1 - update) * (1 - new * new)
        d_update = dh * (before - new) * update * (1 - update)
        d_reset = d_new * again * reset * (1 - reset)
        gates = np.concatenate([d_reset, d_update, d_new], axis=1)
        for way in (0, 1):
            np.add.at(d_table[way].T, bytes_in[t, way], gates[way].T)
        gates[:, 2 * HIDDEN :] *= reset
        d_loop += gates @ flip(before)
        dh = dh * update + flip(net.loop) @ gates
    return [d_table, d_loop, d_top, d_bias]


def train(samples: list[tuple[bytes, str]], steps: int = 160, batch: int = 96, rate: float = 0.02, seed: int = 7) -> Network | None:
    """A network from windows and their labels, by Adam, each label equally often."""
    labels = sorted({x for _, x in samples})
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    net = Network.fresh(labels, rng)
    span = max(len(w) for w, _ in samples)
    windows = np.zeros((len(samples), span), np.uint8)
    for i, (w, _) in enumerate(samples):
        windows[i, : len(w)] = np.frombuffer(w, np.uint8)
    lengths = np.array([len(w) for w, _ in samples])
    target = np.array([labels.index(x) for _, x in samples])
    of_label = [np.flatnonzero(target == i) for i in range(len(labels))]
    first, second = [np.zeros_like(w) for w in net.weights], [np.zeros_like(w) for w in net.weights]
    for step in range(1, steps + 1):
        pick = np.array([rng.choice(of_label[i % len(labels)]) for i in range(max(batch, len(labels)))])
        slow = rate * (1 - 0.8 * step / steps)
        for w, g, m, v in zip(net.weights, gradients(net, windows[pick], lengths[pick], target[pick]), first, second, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= slow * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        net.hold()
    return net


def pooled(net: Network, texts: list[bytes]) -> np.ndarray:
    """Each text's probabilities: the mean over its positions."""
    counts = [-(-len(t) // SPAN) for t in texts]
    owner = np.repeat(np.arange(len(texts)), counts)
    windows = np.zeros((len(owner), SPAN), np.uint8)
    flat, at = windows.reshape(-1), 0
    for t, n in zip(texts, counts, strict=True):
        flat[at : at + len(t)] = np.frombuffer(t, np.uint8)
        at += n * SPAN
    sizes = np.array([len(t) for t in texts])
    ends = np.cumsum(counts)
    lengths = np.full(len(owner), SPAN)
    full = sizes > 0
    lengths[ends[full] - 1] = (sizes[full] - 1) % SPAN + 1
    total = np.zeros((len(texts), len(net.labels)))
    order = np.argsort(-lengths, kind="stable")  # short windows run together, in fewer steps
    for a in range(0, len(owner), LANES):
        part = order[a : a + LANES]
        steps = int(lengths[part].max())
        out = forward(net, both_ways(windows[part, :steps]))
        np.add.at(total, owner[part], positions(net, out, lengths[part]).sum(axis=0).T)
    return total / np.maximum(sizes, 1)[:, None]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample(docs: DataFrame, docs_per_lang: int, windows: int, span: int, most: int) -> list[tuple[bytes, str]]:
    """Windows of about ``docs_per_lang`` training documents of each language, and of about ``most`` in all, chosen by a
    hash of id and place in the table, so that rows that repeat an id are chosen one by one."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    counts = materialize(rows.groupBy("lang").count(), "languages")
    known = counts.count()
    each = min(float(docs_per_lang), most / max(1, known))
    share = counts.select("lang", (F.least(F.lit(1.0), F.lit(each) / F.col("count")) * (1 << 30)).cast("long").alias("share"))
    rows = rows.withColumn("tag", F.monotonically_increasing_id()).join(F.broadcast(share) if known <= SMALL_GROUPS else share, "lang")
    mix = F.pmod(F.xxhash64("doc_id", "tag"), F.lit(1 << 30))
    raw = F.col("text").cast("binary")
    size = F.octet_length("text")
    cut = [F.substr(raw, 1 + F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(size - span, F.lit(1))).cast("int"), F.lit(span)) for i in range(windows)]
    found = rows.where(F.col("text").isNotNull() & (mix < F.col("share"))).select("doc_id", "lang", F.array(*cut).alias("cut")).collect()
    found.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"], r["cut"]))
    return [(bytes(w), r["lang"]) for r in found for w in r["cut"] if w]


def fit(docs: DataFrame, docs_per_lang: int = 150, windows: int = 4, span: int = 128, most: int = 30_000) -> Network | None:
    return train(sample(docs, docs_per_lang, windows, span, most))


def predictor(net: Network | None):
    """A function of a text column: ``struct<lang, score>``."""

    @F.arrow_udf("lang string, score double")
    def predict(text: pa.Array) -> pa.Array:
        langs, scores = [], []
        for a in range(0, len(text), 256):
            texts = text.slice(a, 256).to_pylist()
            known = [net is not None and t is not None and any(map(str.isalpha, t)) for t in texts]
            probs = pooled(net, [t.encode() for t, k in zip(texts, known, strict=True) if k]) if any(known) else []
            best = iter(probs)
            for k in known:
                p = next(best) if k else None
                langs.append(UNKNOWN if p is None else net.labels[int(p.argmax())])
                scores.append(0.0 if p is None else float(min(1.0, p.max())))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    return predict


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """``doc_id, held_out, lang_pred, score``: a row for each row of ``docs``."""
    bounded_batches(docs.sparkSession)
    guess = predictor(net)(F.col("text").cast("string"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), guess.alias("guess"))
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("guess.lang").alias("lang_pred"), "guess.score")


def keep_known(docs: DataFrame, net: Network | None, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that have a language with at least the score ``least``."""
    bounded_batches(docs.sparkSession)
    columns = docs.columns
    (guess,) = free_names(docs, "_mx_guess")
    rows = docs.withColumn(guess, predictor(net)(F.col("text").cast("string")))
    known = (F.col(guess)["lang"] != UNKNOWN) & (F.col(guess)["score"] >= least)
    return rows.where(known).select(*(f"`{c}`" for c in columns))
