"""Global ordinals without one task: rows are dealt by ranges of the order, counted by range, and numbered from their range's offset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.sources.shared import materialized

#: Bits of ``monotonically_increasing_id`` that number the rows of one partition.
ROW_BITS = 33


def ranged(rows: DataFrame, order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """``rows`` in a written table, sorted by ranges of ``order``: adds ``part`` (the range, ascending) and ``row`` (0, 1, ... within it).

    The number of ranges is that of the session's shuffle partitions unless given.
    """
    n = partitions or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    table = materialized(dealt.withColumn("_at", at))
    return table.select(*rows.columns, F.shiftright("_at", ROW_BITS).cast("int").alias("part"), F.col("_at").bitwiseAND(F.lit((1 << ROW_BITS) - 1)).alias("row"))


def numbered(rows: DataFrame, order: Sequence[Column], name: str = "pos", partitions: int | None = None) -> DataFrame:
    """``rows`` with the long column ``name``: 0, 1, 2, ... by ``order`` over all rows.

    Only a count for each range reaches the driver, at most one a partition.
    Rows that are equal in the whole order are numbered in any order among
    themselves, so the order should end with a key. Nulls come where ``order``
    puts them; an empty table gives no rows. A column called ``name`` is replaced,
    one called ``part``, ``row`` or ``_at`` may not be there.
    """
    rows = rows.drop(name)
    table = ranged(rows, order, partitions)
    counts = {r["part"]: r["count"] for r in table.groupBy("part").count().collect()}
    starts = [0]
    for part in range(max(counts, default=-1)):
        starts.append(starts[-1] + counts.get(part, 0))
    return table.select(*rows.columns, (F.get(F.lit(starts).cast("array<bigint>"), F.col("part")) + F.col("row")).alias(name))
