"""Shared pieces: shared-folder tables, Arrow text buffers, vectorised hashing, components.

Text is handled as the flat UTF-8 buffer of an Arrow column. Words are runs of
bytes other than ``0x20`` and ``0x09-0x0D``; a word's hash is a prefix-sum
polynomial modulo 2**64 over random byte values, so hashing a whole batch takes
a handful of numpy passes and no per-word Python.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes of an Arrow batch; a batch ends at whichever comes first, or after one longer row.
BATCH_ROWS, BATCH_BYTES = 4096, 4 << 20
#: Bytes of text that one numpy pass works on.
CHUNK_BYTES = 1 << 19


def tune(spark: SparkSession) -> None:
    """Bound the Arrow batches of text columns, whatever the session's default."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share.

    ``spark.checkpoint.dir`` of the session is used where it is set. Only a
    local session without it gets a folder of its own.
    """
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if given:
        return given.rstrip("/")
    if not (sc.master or "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    import tempfile

    made = tempfile.mkdtemp(prefix="lattica-checkpoint-")
    sc.setCheckpointDir(f"file://{made}")
    return sc.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage of ``df``: write it to the shared folder and read it again."""
    path = new_path(df.sparkSession, name)
    df.write.option("parquet.enable.dictionary", "false").parquet(path)  # most columns are hashes
    release(df.sparkSession)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let go of finished shuffles: Spark deletes their files once the driver has collected its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table of :func:`written` that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(parent)
        path.getFileSystem(conf).delete(path, True)


# ---------------------------------------------------------------- text buffers


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all rows and the n + 1 row offsets; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[off[0] : off[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def chunks(off: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``limit`` bytes each, or of one row if that is longer."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_LOWER = np.arange(256)
BYTE_LOWER[65:91] += 32
BYTE_VALUES_LOWER = BYTE_VALUES[BYTE_LOWER]
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers 0..n-1 of the base, and those of its inverse."""
    if len(_powers[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values (a multiply-xorshift finaliser)."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
    """64-bit hash of each byte span ``data[start:end]``, whatever its place."""
    n = len(data)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values[data] * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts])


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for n rows the n + 1 offsets into them."""
    n = len(data)
    solid = ~SPACE[data]
    first = np.empty(n, bool)
    if n:
        first[0] = True
        first[1:] = ~solid[:-1]
        cut = off[(off > 0) & (off < n)]
        first[cut] = True
        last = np.empty(n, bool)
        last[-1] = True
        last[:-1] = ~solid[1:]
        last[cut - 1] = True
        starts, ends = np.flatnonzero(solid & first), np.flatnonzero(solid & last) + 1
    else:
        starts = ends = np.zeros(0, np.int64)
    return starts, ends, np.searchsorted(starts, off)


def shingles(words: np.ndarray, word_off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles row by row, and their n + 1 row offsets.

    A row of 1 to k-1 words has its whole sequence as its one shingle, a row
    without words has none. Values repeat where shingles repeat.
    """
    counts = np.diff(word_off)
    m = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    off = np.concatenate(([0], np.cumsum(m)))
    out = np.empty(off[-1], np.uint64)
    if not len(out):
        return out, off
    place = np.arange(off[-1]) - np.repeat(off[:-1], m) + np.repeat(word_off[:-1], m)
    size = np.repeat(np.minimum(counts, k), m)
    full = size == k
    total = np.zeros(len(out), np.uint64)
    top = len(words) - 1
    for j in range(k):
        part = words[np.minimum(place + j, top)]
        total = total * np.uint64(0xC2B2AE3D27D4EB4F)
        total += part if full.all() else np.where(j < size, part, np.uint64(j + 1))
    out[:] = mix(total)
    return out, off


def distinct(hashes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values row by row, ascending within each row, and their offsets."""
    n = len(off) - 1
    row = np.repeat(np.arange(n, dtype=np.int64), np.diff(off))
    order = np.lexsort((hashes, row))
    row, hashes = row[order], hashes[order]
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])
    row, hashes = row[keep], hashes[keep]
    return hashes, np.searchsorted(row, np.arange(n + 1))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def row_ids(n: int, off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(n), np.diff(off))


def by_batch(make: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of ``mapInArrow`` from one of single batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := make(batch)) is not None and out.num_rows:
                yield out

    return run


# ------------------------------------------------------------------ components


def components(edges: DataFrame, salts: int = 8, rounds: int = 60) -> DataFrame:
    """Connected components of the links (a, b): rows (node, component), the smallest node of each.

    Labels spread along the links and then jump to their label's label; each
    round is written to the shared folder, and only a count of changes reaches
    the driver. The lookups of neighbours' labels are salted, since the centre
    of a large star owns most links. Links with a null end are ignored.
    """
    spark = edges.sparkSession
    kind = edges.schema[0].dataType.simpleString()
    ends = edges.toDF("a", "b").dropna()
    both = written(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().withColumn("salt", F.pmod(F.hash("a"), F.lit(salts)).cast("int")), "links")
    labels = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    for _ in range(rounds):
        salted = labels.withColumn("salt", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
        near = both.join(salted, (both.b == salted.node) & (both.salt == salted.salt)).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, labels.node == near.a, "left").select("node", "label", F.least("label", "near").alias("next"))
        # the label's own label, found among the labels before this round
        heads = labels.select(F.col("node").alias("h"), F.col("label").alias("over")).withColumn("s", F.explode(F.array(*[F.lit(s) for s in range(salts)])))
        met = met.withColumn("s", F.pmod(F.hash("node"), F.lit(salts)).cast("int"))
        step = met.join(heads, (met.next == heads.h) & (met.s == heads.s), "left").select("node", F.col("label").alias("was"), F.least("next", "over").cast(kind).alias("label"))
        step = written(step, "labels")
        changed = step.filter("label <> was").limit(1).count()
        removed(spark, labels)
        labels = step.drop("was")
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return labels.withColumnRenamed("label", "component")


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after further links (a, b), by the components of the components."""
    of = lambda end: labels.select(F.col("node").alias(f"{end}_node"), F.col("component").alias(f"{end}_label"))
    known = links.join(of("a"), F.col("a") == F.col("a_node"), "left").join(of("b"), F.col("b") == F.col("b_node"), "left")
    ends = written(known.select("a", "b", F.coalesce("a_label", "a").alias("x"), F.coalesce("b_label", "b").alias("y")), "links")
    over = components(ends.filter("x <> y").select("x", "y").distinct()).select(F.col("node").alias("was"), F.col("component").alias("now"))
    new = ends.select(F.col("a").alias("node"), F.col("x").alias("component")).unionByName(ends.select(F.col("b").alias("node"), F.col("y").alias("component")))
    every = labels.select("node", "component").unionByName(new).distinct()
    return written(every.join(over, F.col("component") == F.col("was"), "left").select("node", F.coalesce("now", "component").alias("component")), "labels")
