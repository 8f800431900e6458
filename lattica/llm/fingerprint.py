"""Document fingerprints: MinHash over five-word shingles.

Each of ``perms`` universal hash functions ``h -> (a * h + b) mod 2**64`` (``a``
odd) keeps its least value over a text's shingles, for a whole batch of texts
at once in numpy. The fingerprint is the upper 16 bits of those minima as hex;
the share of equal places estimates the Jaccard likeness of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import BYTE_VALUES_LOWER, chunks, distinct, shingles, span_hashes, utf8, word_spans, written

PERMS, WORDS = 128, 5


def coefficients(perms: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    a = rng.integers(0, 2**63, perms, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 2**63, perms, dtype=np.uint64)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row of a text buffer, ASCII letters lower-cased."""
    starts, ends, word_off = word_spans(data, off)
    return shingles(span_hashes(data, starts, ends, BYTE_VALUES_LOWER), word_off, k)


def signatures(hashes: np.ndarray, off: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima (rows by permutations) over each row's hashes, upper 16 bits; an empty row has all ones."""
    n = len(off) - 1
    out = np.full((n, len(a)), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(off))
    if not len(full):
        return out
    at = off[full]
    block = np.empty(len(hashes), np.uint64)
    for p in range(len(a)):
        np.multiply(hashes, a[p], out=block)
        block += b[p]
        out[full, p] = np.minimum.reduceat(block, at) >> np.uint64(48)
    return out


def to_hex(signature: np.ndarray) -> list[str]:
    raw = signature.astype(">u2").tobytes()
    width = 2 * signature.shape[1]
    return [raw[k : k + width].hex() for k in range(0, len(raw), width)]


def likeness(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Share of equal places, row by row."""
    return (x == y).mean(axis=1)


FINGERPRINTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("fingerprint", T.StringType())])


def fingerprints(docs: DataFrame, perms: int = PERMS, k: int = WORDS, seed: int = 1) -> DataFrame:
    """(doc_id, n_shingles, fingerprint) of each whole text; n_shingles counts distinct shingles.

    A null or word-less text has no shingle and a fingerprint of all ``f``.
    Nulls of doc_id stay, repeated rows repeat, other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(perms, seed)
        for batch in batches:
            data, off = utf8(batch.column(1))
            for i, j in chunks(off):
                found = distinct(*shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(found[1])), pa.array(to_hex(signatures(*found, a, b)))], names=FINGERPRINTS.names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, FINGERPRINTS)


def near_pairs(docs: DataFrame, threshold: float = 0.8, perms: int = PERMS, bands: int = 32, k: int = WORDS) -> DataFrame:
    """Near-duplicate pairs (left_id, right_id, jaccard): bands of the signature joined, Jaccard verified.

    Rows of equal text are linked to the smallest doc_id among them, which
    stands for the text. Any two different texts that agree on a whole band of
    perms/bands minima are a candidate, so all links between texts that share a
    bucket are found; a bucket of n texts gives n(n-1)/2 candidates. At 32 bands
    of 4 a pair of likeness 0.8 is missed in one bucket run of 10**7. Texts
    without words pair with nothing; a null doc_id is left out.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).filter("doc_id is not null")
    ids = ids.withColumn("text_id", F.xxhash64("text"))
    texts = written(ids.groupBy("text_id").agg(F.min("doc_id").alias("head"), F.first("text").alias("text")), "texts")
    named = texts.select(F.col("text_id").alias("doc_id"), "text")
    marks = written(fingerprints(named, perms, k).filter("n_shingles > 0").withColumnRenamed("doc_id", "text_id"), "fingerprints")
    heads = texts.select("text_id", "head").join(marks, "text_id", "left_semi")
    # copies: each row with the head of its text, over salts since one text may own a third of the rows
    salts = F.explode(F.array(*[F.lit(s) for s in range(8)]))
    copies = (
        ids.select("doc_id", "text_id", F.pmod(F.hash("doc_id"), F.lit(8)).alias("s"))
        .join(heads.withColumn("s", salts), ["text_id", "s"])
        .select(F.col("head").alias("left_id"), F.col("doc_id").alias("right_id"), F.lit(1.0).alias("jaccard"))
    )
    width = 4 * perms // bands
    band = F.explode(F.array(*[F.concat(F.lit(f"{b}:"), F.substring("fingerprint", b * width + 1, width)) for b in range(bands)]))
    rows = marks.select(F.col("text_id").alias("left_id"), band.alias("band"))
    pairs = rows.join(rows.select(F.col("left_id").alias("right_id"), "band"), "band").filter("left_id < right_id").select("left_id", "right_id").distinct()
    near = verified(pairs, named, k).filter(F.col("jaccard") >= threshold)
    # from texts to their doc_ids
    near = near.join(heads.toDF("left_id", "a"), "left_id").join(heads.toDF("right_id", "b"), "right_id")
    near = near.select(F.least("a", "b").alias("left_id"), F.greatest("a", "b").alias("right_id"), "jaccard")
    every = near.unionByName(copies).filter("left_id <> right_id").filter(F.col("jaccard") >= threshold)
    return every.groupBy("left_id", "right_id").agg(F.max("jaccard").alias("jaccard"))


def verified(pairs: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """Exact Jaccard of the shingle sets of each pair (left_id, right_id)."""
    schema = T.StructType([T.StructField("left_id", T.LongType()), T.StructField("right_id", T.LongType()), T.StructField("jaccard", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = []
            for c in (2, 3):
                data, off = utf8(batch.column(c))
                sets.append(distinct(*shingle_sets(data, off, k)))
            (x, x_off), (y, y_off) = sets
            out = []
            for r in range(batch.num_rows):
                left, right = x[x_off[r] : x_off[r + 1]], y[y_off[r] : y_off[r + 1]]
                common = len(np.intersect1d(left, right, assume_unique=True))
                both = len(left) + len(right) - common
                out.append(common / both if both else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=schema.names)

    texts = docs.dropDuplicates(["doc_id"])
    left = texts.select(F.col("doc_id").alias("left_id"), F.col("text").alias("left_text"))
    right = texts.select(F.col("doc_id").alias("right_id"), F.col("text").alias("right_text"))
    return pairs.join(left, "left_id").join(right, "right_id").select("left_id", "right_id", "left_text", "right_text").mapInArrow(run, schema)


EDITED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)
#: Order key of a null doc_id: after all others in descending order.
NULL_KEY = -(2**63)


def _rank(cuts: list[int]) -> Column:
    """How many of the ascending cuts lie below ``key``: in two steps, of the square root of their number each."""
    if not cuts:
        return F.lit(0)
    width = int(len(cuts) ** 0.5) + 1
    parts = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    below = lambda some: F.size(F.filter(some, lambda c: c < F.col("key")))
    coarse = below(F.array(*[F.lit(p[-1]) for p in parts]))
    fine = F.array(*[F.array(*[F.lit(c) for c in p]) for p in (*parts, parts[-1])])
    return (coarse * F.lit(width) + F.when(coarse < len(parts), below(F.element_at(fine, coarse + 1))).otherwise(F.lit(len(cuts) - len(parts) * width))).cast("int")


def edited_fingerprints(docs: DataFrame, perms: int = PERMS, k: int = WORDS, seed: int = 1, rows_each: int = 5000, most_ranges: int = 1 << 14) -> DataFrame:
    """Fingerprint of each text and of its edited text (see ``EDITED`` for the columns).

    The edited text is the text with its last floor(n/2) code points replaced
    by the first as many (or all) of the next document's, by descending doc_id;
    after the last comes the first. Rows of equal doc_id follow one another by
    text; a null doc_id comes last; a single row follows itself. A null text is
    empty. Likenesses lie in 0..1, and two texts without words are alike.

    The table is cut into ranges of doc_id of about ``rows_each`` rows (at most
    ``most_ranges``, of more rows then) by quantiles, and each text is shuffled once, to its range. The row that
    follows a range's last is sent to that range too, so no task needs another.
    Rows of one doc_id stay in one range.
    """
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY)).alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keys = keyed.select("key")
    n = keys.count()
    if not n:
        return docs.sparkSession.createDataFrame([], EDITED)
    ranges = max(1, min(most_ranges, n // rows_each))
    cuts = sorted({int(c) for c in keys.select(F.percentile_approx("key", [q / ranges for q in range(1, ranges)], 20 * ranges).alias("c")).first().c}) if ranges > 1 else []
    # range r holds the keys above cuts[r-1] up to cuts[r]; it needs the largest key below it, that is the head of range r-1
    rank = _rank(cuts)
    placed = keyed.withColumn("range", rank)
    # the first row of each range by descending order: of rows of the largest key, the one with the smallest text
    heads = keys.withColumn("range", rank).groupBy("range").agg(F.max("key").alias("key")).collect()
    order = sorted((h["range"], h["key"]) for h in heads)
    wanted = {order[i][1]: order[(i + 1) % len(order)][0] for i in range(len(order))}
    # one row of 16 bytes for each of at most most_ranges ranges: small enough to send to all
    needs = docs.sparkSession.createDataFrame(list(wanted.items()), "key long, needed_by int")
    spread = placed.join(F.broadcast(needs), "key", "left").withColumn(
        "to",
        F.explode(F.array_compact(F.array(F.struct(F.col("range").alias("range"), F.lit(0).alias("ghost")), F.when(F.col("needed_by").isNotNull(), F.struct(F.col("needed_by").alias("range"), F.lit(1).alias("ghost")))))),
    )
    dealt = spread.select("to.range", "to.ghost", "key", "doc_id", "text").repartition(F.col("range")).sortWithinPartitions(F.col("range"), F.col("ghost"), F.col("key").desc(), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(perms, seed)

        def result(rows: list[tuple[int | None, str, str]]) -> pa.RecordBatch:
            """Rows of (doc_id, text, next text)."""
            edited = []
            for _, text, after in rows:
                half = len(text) // 2
                edited.append(text[: len(text) - half] + after[:half])
            texts = [r[1] for r in rows]
            followers = [r[2] for r in rows]
            index: dict[str, int] = {}
            for t in (*texts, *edited, *followers):
                index.setdefault(t, len(index))
            data, off = utf8(pa.array(list(index), pa.string()))
            marks = np.concatenate([signatures(*shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k), a, b) for i, j in chunks(off)])
            own, new, following = (marks[[index[t] for t in some]] for some in (texts, edited, followers))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([r[0] for r in rows], pa.int64()),
                    pa.array(list(map(len, texts)), pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                    pa.array(to_hex(own)),
                    pa.array(to_hex(new)),
                    pa.array(likeness(own, new)),
                    pa.array(likeness(own, following)),
                ],
                names=EDITED.names,
            )

        waiting, last, ready, size = None, None, [], 0
        for batch in batches:
            for place, ghost, doc_id, text in zip(*(batch.column(c).to_pylist() for c in range(4))):
                if place != last:
                    waiting, last, closed = None, place, False
                if closed:
                    continue  # further ghosts: rows that share the head's key
                if waiting is not None:
                    ready.append((*waiting, text))
                    size += len(text)
                waiting, closed = (doc_id, text), bool(ghost)
                if size > 1 << 19:
                    yield result(ready)
                    ready, size = [], 0
        if ready:
            yield result(ready)

    return dealt.select("range", "ghost", "doc_id", "text").mapInArrow(run, EDITED)
