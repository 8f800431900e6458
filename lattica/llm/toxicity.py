"""Toxicity: a bidirectional GRU with attention pooling over character and word inputs.

A word enters as the sum of two learned vectors' sides: one of its own hash,
one the mean over its hashed byte n-grams, so that unseen forms of known stems
count. Windows of words overlap by half; every window of a text is scored and
the text's score is the calibrated maximum. The network is trained here, in
numpy, on a bounded sample of labelled texts: word and n-gram log odds pick the
windows of toxic texts that show why, and the network learns from those.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import chunks, span_hashes, utf8
from lattica.llm.langid import KINDS, byte_grams
from lattica.llm.letters import words as words_in

WINDOW, STRIDE = 32, 16
ORDERS, WORD_BITS, GRAM_BITS = (3, 4, 5), 14, 15
DIM, HIDDEN, ATTEND = 8, 8, 8

Weights = dict[str, np.ndarray]


class Model(NamedTuple):
    weights: Weights
    slope: float
    shift: float
    empty: float  # score of a text without words


class Words(NamedTuple):
    """Words of a batch: for each its distinct word, and of those the buckets."""

    which: np.ndarray
    bucket: np.ndarray
    grams: np.ndarray
    owner: np.ndarray
    off: np.ndarray  # of the rows, into which


def words_of(data: np.ndarray, off: np.ndarray) -> Words:
    part, starts, ends, word_off = words_in(data, off, KINDS)
    parts = [(off[i], off[j], *np.searchsorted(starts, (off[i], off[j]))) for i, j in chunks(off)]
    hashes = [span_hashes(part[a:b], starts[x:y] - a, ends[x:y] - a) for a, b, x, y in parts]
    hashes, one, which = np.unique(np.concatenate([np.zeros(0, np.uint64), *hashes]), return_index=True, return_inverse=True)
    grams, owner = byte_grams(part, starts[one], ends[one], ORDERS, GRAM_BITS) if len(one) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    return Words(which, (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64), grams, owner, word_off)


def windows(off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and row of every window; a row without words has none."""
    counts = np.diff(off)
    n = np.where(counts > WINDOW, -(-(counts - WINDOW) // STRIDE) + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(counts)), n)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return off[row] + nth * STRIDE, np.minimum(WINDOW, counts[row] - nth * STRIDE), row


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (np.tanh(np.float32(0.5) * x) + np.float32(1))


def _inputs(w: Weights, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Input vectors of the distinct words; number of n-grams of each."""
    n = len(words.bucket)
    sizes = np.bincount(words.owner, minlength=n).astype(np.float32)
    mean = np.stack([np.bincount(words.owner, w["gram"][words.grams, d], n) for d in range(DIM)], 1) / np.maximum(1, sizes)[:, None]
    return np.concatenate((w["word"][words.bucket], mean.astype(np.float32)), 1), sizes


def _gru(w: Weights, side: str, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states (steps, windows, hidden) of one direction; ``index``: distinct word by step and window."""
    h = HIDDEN
    proj = x @ w[f"W{side}"] + w[f"b{side}"]
    u = w[f"U{side}"]
    steps = index.shape[0]
    state = np.zeros((index.shape[1], h), np.float32)
    out = np.empty((steps, *state.shape), np.float32)
    for t in range(steps) if side == "f" else range(steps - 1, -1, -1):
        a = proj[index[t]]
        b = state @ u
        zr = _sigmoid(a[:, : 2 * h] + b[:, : 2 * h])
        z, r = zr[:, :h], zr[:, h:]
        new = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
        nxt = new + z * (state - new)
        m = mask[t][:, None]
        nxt = state + m * (nxt - state)
        if keep is not None:
            keep.append((t, state, z, r, new, b[:, 2 * h :]))
        state = nxt
        out[t] = state
    return out


def logits(w: Weights, words: Words, first: np.ndarray, size: np.ndarray, block: int = 1 << 12) -> np.ndarray:
    """One logit for each window, so many windows at a time."""
    x, _ = _inputs(w, words)
    out = [_score(w, x, *_layout(words, first[k : k + block], size[k : k + block]))[0] for k in range(0, len(first), block)]
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def _layout(words: Words, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    t = np.arange(WINDOW)[:, None]
    mask = (t < size).astype(np.float32)
    return words.which[np.minimum(first + t, max(0, len(words.which) - 1))], mask


def _score(w: Weights, x: np.ndarray, index: np.ndarray, mask: np.ndarray, keep: dict | None = None):
    kept = {s: [] if keep is not None else None for s in "fb"}
    h = np.concatenate([_gru(w, s, x, index, mask, kept[s]) for s in "fb"], 2)
    hidden = np.tanh(h @ w["A"])
    e = hidden @ w["v"]
    e = np.where(mask > 0, e, np.float32(-1e4))
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = np.einsum("tn,tnh->nh", alpha, h)
    if keep is not None:
        keep.update(kept=kept, h=h, hidden=hidden, alpha=alpha, pooled=pooled)
    return pooled @ w["u"] + w["c"][0], pooled


def _gradients(w: Weights, words: Words, index: np.ndarray, mask: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, Weights]:
    """Weighted cross-entropy of a batch and its gradients."""
    x, sizes = _inputs(w, words)
    k: dict = {}
    logit, _ = _score(w, x, index, mask, k)
    p = _sigmoid(logit)
    loss = -float(np.mean(weight * np.log(np.where(target > 0, p, 1 - p) + 1e-7)))
    g: Weights = {}
    dl = (weight * (p - target) / len(target)).astype(np.float32)
    g["u"], g["c"] = k["pooled"].T @ dl, np.array([dl.sum()], np.float32)
    dp = dl[:, None] * w["u"]
    dh = k["alpha"][:, :, None] * dp[None]
    da = np.einsum("tnh,nh->tn", k["h"], dp)
    de = k["alpha"] * (da - (k["alpha"] * da).sum(0))
    g["v"] = np.einsum("tn,tna->a", de, k["hidden"])
    dt = de[:, :, None] * w["v"] * (1 - k["hidden"] ** 2)
    g["A"] = np.einsum("tnh,tna->ha", k["h"], dt)
    dh = dh + dt @ w["A"].T
    dx = np.zeros_like(x)
    n = HIDDEN
    for s, part in (("f", slice(0, n)), ("b", slice(n, 2 * n))):
        W, U = w[f"W{s}"], w[f"U{s}"]
        gW, gU, gb = np.zeros_like(W), np.zeros_like(U), np.zeros_like(w[f"b{s}"])
        carry = np.zeros((index.shape[1], n), np.float32)
        for t, prev, z, r, new, hu in reversed(k["kept"][s]):
            m = mask[t][:, None]
            d = carry + dh[t][:, part]
            live = d * m
            dn = live * (1 - z) * (1 - new**2)
            dz = live * (prev - new) * z * (1 - z)
            dr = dn * hu * r * (1 - r)
            own = np.concatenate((dz, dr, dn), 1)
            back = np.concatenate((dz, dr, dn * r), 1)
            carry = live * z + back @ U.T + d * (1 - m)
            xs = x[index[t]]
            gW += xs.T @ own
            gU += prev.T @ back
            gb += own.sum(0)
            np.add.at(dx, index[t], own @ W.T)
        g[f"W{s}"], g[f"U{s}"], g[f"b{s}"] = gW, gU, gb
    g["word"] = np.zeros_like(w["word"])
    np.add.at(g["word"], words.bucket, dx[:, :DIM])
    share = dx[:, DIM:] / np.maximum(1, sizes)[:, None]
    g["gram"] = np.stack([np.bincount(words.grams, share[words.owner, d], len(w["gram"])) for d in range(DIM)], 1).astype(np.float32)
    return loss, g


def _start(rng: np.random.Generator) -> Weights:
    def normal(scale, *shape):
        return rng.normal(0, scale, shape).astype(np.float32)

    w = {"word": normal(0.1, 1 << WORD_BITS, DIM), "gram": normal(0.1, 1 << GRAM_BITS, DIM)}
    for s in "fb":
        w |= {f"W{s}": normal(0.3, 2 * DIM, 3 * HIDDEN), f"U{s}": normal(0.3, HIDDEN, 3 * HIDDEN), f"b{s}": np.zeros(3 * HIDDEN, np.float32)}
    return w | {"A": normal(0.3, 2 * HIDDEN, ATTEND), "v": normal(0.3, ATTEND), "u": normal(0.3, 2 * HIDDEN), "c": np.zeros(1, np.float32)}


def _log_odds(pos: np.ndarray, neg: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Log odds of features that so many toxic and other texts hold."""
    return np.log((pos + 0.5) / (max(1, (y > 0).sum()) + 1)) - np.log((neg + 0.5) / (max(1, (y == 0).sum()) + 1))


def fit(texts: list[str], labels: list[int], epochs: int = 5, per_epoch: int = 8000, batch: int = 256, rate: float = 0.01, seed: int = 3) -> Model:
    """Train on whole labelled texts (the caller bounds their number).

    ``per_epoch`` bounds the toxic windows of an epoch. With labels of one kind only, or no text, every score is that kind's share.
    """
    y = np.array(labels, np.int64)
    rng = np.random.default_rng(seed)
    w = _start(rng)
    if not len(y) or y.min() == y.max():
        prior = float(y.mean()) if len(y) else 0.0
        w["u"][:] = 0
        return Model(w, 0.0, float(np.log((prior + 1e-3) / (1 - prior + 1e-3))), prior)
    data, off = utf8(pa.array(texts, pa.string()))
    words = words_of(data, off)
    first, size, row = windows(words.off)
    rows = np.repeat(np.arange(len(y)), np.diff(words.off))
    # evidence of a word: the log odds of its hash or of its best n-gram, by the texts that hold the word
    n_words = len(words.bucket)
    held = np.unique(rows * n_words + words.which)
    toxic = y[held // n_words] > 0
    pos, neg = np.bincount(held[toxic] % n_words, minlength=n_words), np.bincount(held[~toxic] % n_words, minlength=n_words)
    word_odds = _log_odds(*(np.bincount(words.bucket, n, 1 << WORD_BITS) for n in (pos, neg)), y)
    gram_odds = _log_odds(*(np.bincount(words.grams, n[words.owner], 1 << GRAM_BITS) for n in (pos, neg)), y)
    best = np.full(len(words.bucket), -9.0)
    np.maximum.at(best, words.owner, gram_odds[words.grams])
    evidence = np.maximum(word_odds[words.bucket], best)
    index, mask = _layout(words, first, size)
    index, mask = index.astype(np.int32), mask.astype(np.int8)
    top = np.where(mask > 0, evidence[index], -9).max(0)
    doc_top = np.full(len(y), -9.0)
    np.maximum.at(doc_top, row, top)
    clean_top = np.percentile(top[y[row] == 0], 99.9) if (y[row] == 0).any() else 0.0
    positive = np.flatnonzero((y[row] > 0) & ((top > clean_top) & (top > 0.6 * doc_top[row]) | (top >= doc_top[row])))
    negative = np.flatnonzero(y[row] == 0)
    hard = negative[np.argsort(-top[negative])[: len(negative) // 4]]
    w["word"][:, 0] = np.clip(word_odds, -3, 6) / 3
    w["gram"][:, 0] = np.clip(gram_odds, -3, 6) / 3
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
    order = np.argsort(words.owner, kind="stable")
    by_word = words.grams[order].astype(np.int32)
    stops = np.cumsum(np.bincount(words.owner, minlength=n_words))
    starts = stops - np.bincount(words.owner, minlength=n_words)
    del order, best, held
    step = 0
    epochs = max(epochs, min(80, 30_000 // (2 * max(1, min(per_epoch, len(positive))))))  # few windows are shown more often
    for epoch in range(epochs):
        if epoch == epochs - 2 and epoch:  # the clean windows that the network itself takes for toxic
            hard = negative[np.argsort(-logits(w, words, first[negative], size[negative]))[:1000]]
        some = lambda of, most: rng.choice(of, min(len(of), most), replace=False)
        shown = some(positive, per_epoch)
        chosen = np.concatenate((shown, some(negative, len(shown) + len(shown) // 2), some(hard, len(shown) // 2)))
        rng.shuffle(chosen)
        for k in range(0, len(chosen), batch):
            part = chosen[k : k + batch]
            used, at = np.unique(index[:, part], return_inverse=True)
            n_grams = stops[used] - starts[used]
            local = np.repeat(np.arange(len(used)), n_grams)
            pick = np.repeat(starts[used] - (np.cumsum(n_grams) - n_grams), n_grams) + np.arange(n_grams.sum())
            own = Words(words.which, words.bucket[used], by_word[pick], local, words.off)
            _, g = _gradients(w, own, at.reshape(WINDOW, -1), mask[:, part].astype(np.float32), (y[row[part]] > 0).astype(np.float32), np.ones(len(part), np.float32))
            step += 1
            for name, grad in g.items():
                m, v = state[name]
                m += 0.1 * (grad - m)
                v += 0.001 * (grad * grad - v)
                w[name] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
    every = logits(w, words, first, size)
    best_logit = np.full(len(y), -20.0)
    np.maximum.at(best_logit, row, every)
    slope, shift = _calibrate(best_logit, y)
    return Model(w, slope, shift, min(0.01, float(y.mean())))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift by which the texts' best logits become scores; 0.7 lies where the two kinds part best."""
    cuts = np.unique(x)
    middle = np.concatenate((cuts[:1] - 1, (cuts[1:] + cuts[:-1]) / 2, cuts[-1:] + 1))
    pos, neg = np.sort(x[y > 0]), np.sort(x[y == 0])
    wrong = np.searchsorted(pos, middle) / len(pos) + (len(neg) - np.searchsorted(neg, middle)) / len(neg)
    least = np.flatnonzero(wrong <= wrong.min() + 1e-9)
    # of equally good cuts the middle of the gap
    below, above = cuts[cuts < middle[least[0]]], cuts[cuts > middle[least[-1]]]
    low = below[-1] if len(below) else middle[least[0]]
    high = above[0] if len(above) else middle[least[-1]]
    cut = float((low + high) / 2)
    slope = 1.0
    return slope, float(np.log(0.7 / 0.3)) - slope * cut


def scores(column: pa.Array, model: Model) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges of a text column, the texts' scores and their numbers of windows."""
    data, off = utf8(column)
    for i, j in chunks(off, 1 << 19):
        words = words_of(data[off[i] : off[j]], off[i : j + 1] - off[i])
        first, size, row = windows(words.off)
        best = np.full(j - i, -np.inf)
        if len(first):
            np.maximum.at(best, row, logits(model.weights, words, first, size))
        none = np.isneginf(best)
        x = np.clip(model.slope * np.where(none, 0, best) + model.shift, -30, 30)
        yield i, j, np.where(none, model.empty, 1 / (1 + np.exp(-x))), np.bincount(row, minlength=j - i)


SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("score", T.DoubleType()), T.StructField("n_windows", T.LongType())])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Toxicity of each whole text: (doc_id, score, n_windows).

    All overlapping windows of a text are scored and the largest counts. A text
    that is null or has no word has no window and the model's ``empty`` score.
    Nulls of doc_id stay, repeated rows repeat, other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, found, n_windows in scores(batch.column(1), sent.value):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(found), pa.array(n_windows)], names=SCHEMA.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def keep(docs: DataFrame, model: Model, below: float = 0.7) -> DataFrame:
    """The rows of ``docs`` whose score is less than ``below``, with all their columns (see :func:`score`)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [s for _, _, s, _ in scores(batch.column(place), sent.value)]
            kept = np.concatenate(found) < below if found else np.ones(batch.num_rows, bool)
            if kept.any():
                yield batch.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)


def sample(docs: DataFrame, labels: DataFrame, rows_each: int = 800, others: int = 3, longest: int = 1 << 16) -> DataFrame:
    """A bounded sample of labelled texts, (doc_id, toxic, text): about ``rows_each`` toxic ones and ``others`` times as many others, by a hash of doc_id.

    ``labels`` holds (doc_id, toxic); rows with a null in either are left out,
    a doc_id with several labels counts as toxic if one of them says so. Of rows
    that share a doc_id the least text counts. Texts of more than ``longest``
    bytes are scored like all others but not learned from, so that the sample
    has a bound in bytes too. Without labels the sample is empty.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"] > 0: r["n"] for r in marks.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    share = F.when(F.col("toxic") > 0, F.lit(min(1.0, rows_each / max(1, counts.get(True, 0))))).otherwise(F.lit(min(1.0, others * rows_each / max(1, counts.get(False, 0)))))
    chosen = marks.filter(F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 24)) < share * (1 << 24))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def learned(rows: DataFrame) -> Model:
    """:func:`fit` on the texts of :func:`sample`, in one task: the driver gets the weights alone, neither texts nor what training needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(((d, x or "", t) for b in batches for d, t, x in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[:2])
        model = fit([r[1] for r in found], [int(r[2] > 0) for r in found])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = rows.select("doc_id", "toxic", "text").repartition(1).mapInArrow(run, "model binary").first()
    return pickle.loads(made["model"]) if made else fit([], [])  # no row, no task
