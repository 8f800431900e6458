"""Importance resampling towards a target distribution, by an external sort-count over packed bucket streams.

Each text is read once: the buckets of its word runs (CRC-32 modulo the number
of buckets) go as packed uint16 into a written table of blocks, with the offset
of each document in its block's stream. Two passes read the streams again. The
first sorts each block and run-length encodes it; the runs of a task are merged
and summed over all tasks by Spark. The second gathers the gains of the buckets
and adds them up between the offsets with ``np.add.reduceat``.

A run's CRC-32 is made of those of its words: to append k bytes to a text is a
linear map of its checksum, held as four lookup tables for each k.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import BYTE_LOWER, chunks, removed, utf8, written
from lattica.operators.ordinals import numbered

BUCKETS, RUN, SEED, LEAST_WORDS, DRAWN = 10_000, 3, 42, 20, 5
#: Bytes of a text that go into one segment of a stream, up to the end of a word; only longer texts have several.
SEGMENT_BYTES = 1 << 20

STREAMS = T.StructType(
    [
        T.StructField("row_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("n_words", T.ArrayType(T.LongType())),
        T.StructField("offsets", T.ArrayType(T.LongType())),
        T.StructField("stream", T.BinaryType()),
    ]
)
RUNS = T.StructType([T.StructField("bucket", T.IntegerType()), T.StructField("n", T.LongType())])
WEIGHTS = T.StructType([T.StructField(c, T.LongType()) for c in ("row_id", "doc_id", "n_words", "n_features", "weight")])

# ------------------------------------------------------------------ checksums

_bits = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _bits = np.where(_bits & 1, (_bits >> 1) ^ np.uint32(0xEDB88320), _bits >> 1)
CRC_BYTE = _bits  # the checksum's step for each byte
#: Longest word whose bytes are stepped through for a whole batch, and longest appended part with tables of its own.
SHORT = 48


def _zero_byte(x: np.ndarray) -> np.ndarray:
    """The linear part of appending one byte to a checksum."""
    return CRC_BYTE[x & np.uint32(0xFF)] ^ (x >> np.uint32(8))


def _tables(most: int) -> np.ndarray:
    """Tables [k, j, byte]: the share of byte j of a checksum after k more bytes."""
    out = np.empty((most + 1, 4, 256), np.uint32)
    for j in range(4):
        out[0, j] = np.arange(256, dtype=np.uint32) << np.uint32(8 * j)
    for k in range(most):
        out[k + 1] = _zero_byte(out[k])
    return out


_SHIFT = _tables(SHORT + 1)


def _doubled(table: np.ndarray) -> np.ndarray:
    """The table of twice as many bytes."""
    return np.stack([_through(table[None], np.zeros(256, np.int64), table[j]) for j in range(4)])


def _through(tables: np.ndarray, k: np.ndarray, crc: np.ndarray) -> np.ndarray:
    b = crc.astype(np.uint32)
    low = np.uint32(0xFF)
    return tables[k, 0, b & low] ^ tables[k, 1, (b >> np.uint32(8)) & low] ^ tables[k, 2, (b >> np.uint32(16)) & low] ^ tables[k, 3, b >> np.uint32(24)]


def appended(crc: np.ndarray, size: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """CRC-32 of texts followed by tails, from the checksums of both and the tails' sizes in bytes."""
    out = _through(_SHIFT, np.minimum(size, SHORT + 1), crc)
    if len(far := np.flatnonzero(size > SHORT + 1)):
        x, left, table = crc[far].astype(np.uint32), size[far].copy(), _SHIFT[1]
        while left.any():
            odd = (left & 1).astype(bool)
            x[odd] = _through(table[None], np.zeros(odd.sum(), np.int64), x[odd])
            left >>= 1
            table = _doubled(table)
        out[far] = x
    return out ^ tail


def word_checksums(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each byte span ``data[start:end]``."""
    size = ends - starts
    order = np.argsort(-np.minimum(size, SHORT + 1), kind="stable")
    order = order[int((size > SHORT).sum()) :]  # longest first, without those beyond SHORT
    at, crc = starts[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
    alive = np.searchsorted(-size[order], -np.arange(SHORT), "left")  # words longer than 0, 1, 2, ... bytes
    for j in range(SHORT):
        n = int(alive[j])
        if not n:
            break
        head = crc[:n]
        crc[:n] = CRC_BYTE[(head ^ data[at[:n] + j]) & np.uint32(0xFF)] ^ (head >> np.uint32(8))
    out = np.empty(len(size), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > SHORT):
        out[i] = zlib.crc32(data[starts[i] : ends[i]])
    return out


# -------------------------------------------------------------------- streams

#: Bytes of words: digits, lower-case letters and all beyond ASCII (A-Z are lower-cased first).
WORD = np.zeros(256, bool)
WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = BYTE_LOWER.astype(np.uint8)


def _words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of lower-cased rows, and the n + 1 row offsets into them."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(off), np.int64)
    solid = WORD[data]
    inner = off[(off > 0) & (off < len(data))]
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    begins[inner] = solid[inner]
    ends[inner - 1] = solid[inner - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, off)


def run_checksums(crc: np.ndarray, size: np.ndarray, woff: np.ndarray, run: int, lead: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of every run of 1 to ``run`` words joined by spaces, row by row, and their n + 1 row offsets.

    The first ``lead`` words of each row only begin runs: those that end there are left out.
    """
    counts = np.diff(woff)
    ending = [np.maximum(counts - max(k, lead), 0) for k in range(run)]
    off = np.concatenate(([0], np.cumsum(sum(ending))))
    out = np.empty(off[-1], np.uint32)
    if not len(crc):
        return out, off
    spaced = appended(np.full(len(size), zlib.crc32(b" "), np.uint32), size, crc)
    nth, left = np.arange(len(size)) - np.repeat(woff[:-1], counts), np.repeat(counts, counts)
    base, runs = off[:-1], crc
    for k in range(run):
        if k:
            runs = appended(runs[:-1], size[k:] + 1, spaced[k:])
        end = nth[: len(runs)] + k
        here = np.flatnonzero((end >= max(k, lead)) & (end < left[: len(runs)]))
        out[np.repeat(base, ending[k]) + end[here] - max(k, lead)] = runs[here]
        base = base + ending[k]
    return out, off


def _segments(text: np.ndarray, run: int) -> Iterator[tuple[np.ndarray, int]]:
    """Checksums of the runs of one long text, and its number of words, a segment at a time."""
    at, crc, size = 0, np.zeros(0, np.uint32), np.zeros(0, np.int64)
    while at < len(text):
        end = min(at + SEGMENT_BYTES, len(text))
        while end < len(text) and WORD[LOWER[text[end]]] and WORD[LOWER[text[end - 1]]]:  # not within a word
            part = ~WORD[LOWER[text[end : end + SEGMENT_BYTES]]]
            end = end + int(part.argmax()) if part.any() else min(end + SEGMENT_BYTES, len(text))
        data = LOWER[text[at:end]]
        starts, ends, _ = _words(data, np.array([0, len(data)]))
        lead = len(crc)
        crc, size = np.concatenate((crc, word_checksums(data, starts, ends))), np.concatenate((size, ends - starts))
        yield run_checksums(crc, size, np.array([0, len(crc)]), run, lead)[0], len(starts)
        crc, size = crc[len(crc) - min(len(crc), run - 1) :], size[len(size) - min(len(size), run - 1) :]
        at = end


def streams(docs: DataFrame, n_buckets: int = BUCKETS, run: int = RUN, key: str = "doc_id") -> DataFrame:
    """The packed streams of ``docs`` (``key``, text), written: blocks of ``STREAMS``.

    Every row of ``docs`` gets a row id, and has one segment, or several if its
    text is longer than ``SEGMENT_BYTES``. A null text has no words.
    """

    def block(rows, ids, words, sizes, parts):
        stream = np.concatenate([(x % np.uint32(n_buckets)).astype("<u2") for x in parts]) if parts else np.zeros(0, "<u2")
        offsets = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64))))
        lists = [pa.array([list(rows)], pa.list_(pa.int64())), pa.array([ids], pa.list_(pa.int64())), pa.array([list(words)], pa.list_(pa.int64())), pa.array([offsets], pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays([*lists, pa.array([stream.tobytes()], pa.binary())], names=STREAMS.names)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            data, off = utf8(batch.column(2))
            for i, j in chunks(off):
                part = data[off[i] : off[j]]
                if j == i + 1 and len(part) > SEGMENT_BYTES:
                    for crc, n in _segments(part, run):
                        yield block(rows[i:j], ids[i:j], [n], [len(crc)], [crc])
                    continue
                part = LOWER[part]
                starts, ends, woff = _words(part, off[i : j + 1] - off[i])
                crc, at = run_checksums(word_checksums(part, starts, ends), ends - starts, woff, run)
                yield block(rows[i:j], ids[i:j], np.diff(woff), np.diff(at), [crc])

    if not 0 < n_buckets <= 1 << 16:
        raise ValueError("a bucket is a uint16")
    texts = docs.select(F.monotonically_increasing_id().alias("row_id"), F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(texts.mapInArrow(make, STREAMS), "streams")


# ------------------------------------------------------------ counts and gains


def counted(blocks: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Occurrences of every bucket in the streams: blocks are sorted and run-length encoded, runs merged a task and summed by Spark."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merged = np.zeros(n_buckets, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                values = np.sort(np.frombuffer(raw.as_buffer(), "<u2"))
                if len(values):
                    first = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
                    merged[values[first]] += np.diff(np.concatenate((first, [len(values)])))
        held = np.flatnonzero(merged)
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int32)), pa.array(merged[held])], names=RUNS.names)

    sums = blocks.select("stream").mapInArrow(make, RUNS).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(n_buckets, np.int64)
    for r in sums.collect():  # at most one row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the target's share over the corpus's share) of every bucket, each count plus one."""
    n = len(raw)
    s_all, t_all = float(raw.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(raw.tolist(), target.tolist())], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(row_id, doc_id, n_words, n_features, weight) of every row: its gains gathered and summed between its offsets."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, words, offsets, raw = (batch.column(k) for k in range(5))
            for k in range(batch.num_rows):
                off = offsets[k].values.to_numpy()
                size, total = np.diff(off), np.zeros(len(off) - 1, np.int64)
                full = np.flatnonzero(size)
                if len(full):
                    total[full] = np.add.reduceat(gain[np.frombuffer(raw[k].as_buffer(), "<u2")], off[full])
                yield pa.RecordBatch.from_arrays([rows[k].values, ids[k].values, words[k].values, pa.array(size), pa.array(total)], names=WEIGHTS.names)

    some = blocks.mapInArrow(make, WEIGHTS)
    return some.groupBy("row_id").agg(F.max("doc_id").alias("doc_id"), *[F.sum(c).alias(c) for c in ("n_words", "n_features", "weight")])


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """The Gumbel noise of a document in thousandths, from 32 bits of the SHA-256 of seed and doc_id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, run: int = RUN, seed: int = SEED, least_words: int = LEAST_WORDS, drawn: int = DRAWN, target_key: str = "item_id") -> DataFrame:
    """Every row of ``docs`` (doc_id, text) with its weight towards ``target`` (``target_key``, text), and the rank of those drawn.

    Returns (doc_id, n_words, n_features, weight, score, rank). Words are runs
    of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII. Of the
    N documents of at least ``least_words`` words, floor(drawn * N / 100) are
    drawn by highest score (weight plus noise): without replacement, by the
    Gumbel top-k rule. Ties go to the smaller doc_id, a null one last.

    A null or word-less text has no features and weight 0; a null doc_id is
    empty in the noise; repeated doc_ids share their noise and are rows of their
    own. An empty target leaves gains that only flatten the corpus. Other
    columns are ignored. Counts cover all rows of both tables; only one count a
    bucket and one a range reach the driver.
    """
    spark = docs.sparkSession
    of_target, blocks = streams(target, n_buckets, run, target_key), streams(docs, n_buckets, run)
    gain = gains(counted(blocks, n_buckets), counted(of_target, n_buckets))
    removed(spark, of_target)
    every = written(weights(blocks, gain), "weights")
    removed(spark, blocks)
    scored = every.select("row_id", "doc_id", "n_words", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("may"))
    most = drawn * scored.filter("may").count() // 100
    order = [F.col("may").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row_id")]
    placed = numbered(scored, order, "place")
    removed(spark, every)
    rank = F.when(F.col("may") & (F.col("place") < most), F.col("place") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
