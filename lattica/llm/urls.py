"""URL filters: exact membership in lists of keys by Bloom filter cascades, without joins.

A key is a host, or a host and the beginning of a path. The corpus's complete
key universe (every key that could decide any of its urls) and the lists' keys
are dealt by hash to shards of bounded size. For each shard and list one task
builds a cascade: the first Bloom filter holds the listed keys, the second the
other keys that pass the first, the third the listed keys that pass the second,
and so on until no key passes wrongly. So a key of the universe is listed if
and only if the first filter that it fails is an even one, or it passes an odd
number of filters to the end. Urls are then judged where they lie, by cascades
sent to all tasks, at most ``SENT_BYTES`` of them in one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import mix, removed, written

ALLOW, BLOCK, LISTED = 0, 1, 2
#: Keys of a shard, on average; bytes of cascades sent in one pass; filters of a cascade, which no universe of distinct hashes needs.
SHARD_KEYS, SENT_BYTES, MOST_LEVELS = 1 << 16, 32 << 20, 64
#: Words that mark a part of a host name as junk, for the list that a corpus gives by itself.
JUNK = ("spam", "pills", "casino", "viagra", "porn", "xxx", "warez", "phish")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_CASCADE = T.StructType([T.StructField("shard", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("bits", T.BinaryType())])


# -------------------------------------------------------------------- cascades


def _places(h1: np.ndarray, h2: np.ndarray, level: int, j: int, size: np.ndarray | np.uint64) -> np.ndarray:
    """The bit of each key for hash function ``j`` of a level's filter of ``size`` bits."""
    salt = np.uint64((level * 0x9E3779B97F4A7C15) % (1 << 64))
    return (mix(h1 ^ salt) + np.uint64(j) * (mix(h2 + salt) | np.uint64(1))) % size


class Cascades:
    """Cascades of several shards: sizes and numbers of hash functions [shard, level], and all their bits one after the other."""

    def __init__(self, sizes: list[list[int]], hashes: list[list[int]], bits: list[bytes]):
        deep = max(map(len, sizes), default=0)
        self.depth = np.array([len(x) for x in sizes], np.int64)
        self.sizes = np.array([[*x, *[0] * (deep - len(x))] for x in sizes], np.int64).reshape(len(sizes), deep)
        self.hashes = np.array([[*x, *[0] * (deep - len(x))] for x in hashes], np.int64).reshape(len(sizes), deep)
        self.bits = np.frombuffer(b"".join(bits), np.uint8)
        held = -(-self.sizes // 8) * 8
        self.first = (np.concatenate(([0], np.cumsum(held.ravel())))[:-1].reshape(held.shape)) if held.size else held

    def passes(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
        """Keys that pass their shard's filter of a level; a filter without hash functions passes all."""
        out, hashes = np.ones(len(h1), bool), self.hashes[shard, level]
        for j in range(int(hashes.max(initial=0))):
            some = np.flatnonzero(out & (hashes > j))
            own = shard[some]
            at = _places(h1[some], h2[some], level, j, self.sizes[own, level].astype(np.uint64)).astype(np.int64) + self.first[own, level]
            out[some] = self.bits[at >> 3] >> (at & 7).astype(np.uint8) & 1
        return out

    def member(self, shard: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Whether each key of the shards' universes is listed."""
        out, left = np.zeros(len(h1), bool), np.arange(len(h1))
        for level in range(self.sizes.shape[1]):
            left = left[self.depth[shard[left]] > level]
            left = left[self.passes(shard[left], h1[left], h2[left], level)]
            if not len(left):
                break
            out[left] = level % 2 == 0
        return out


def build(h1: np.ndarray, h2: np.ndarray, listed: np.ndarray) -> tuple[list[int], list[int], bytes]:
    """Sizes, numbers of hash functions and bits of the cascade of one universe of distinct keys, of which some are listed.

    The first filter's rate of wrong passes balances it against the others, which pass one in two.
    """
    inside, outside = np.flatnonzero(listed), np.flatnonzero(~listed)
    sizes, hashes, bits = [], [], []
    held, against = inside, outside
    while len(held):
        level = len(sizes)
        if level == MOST_LEVELS:
            raise RuntimeError("keys of a cascade are not distinct")
        rate = 0.5 if level else min(0.5, len(inside) * 0.5**0.5 / max(1, len(outside)))
        n = int(np.ceil(-np.log2(rate)))
        size = max(8, int(np.ceil(len(held) * n / np.log(2))))
        flags = np.zeros(-(-size // 8) * 8, bool)
        for j in range(n):
            flags[_places(h1[held], h2[held], level, j, np.uint64(size))] = True
        sizes.append(size), hashes.append(n), bits.append(np.packbits(flags, bitorder="little").tobytes())
        one = Cascades([sizes], [hashes], [b"".join(bits)])
        wrong = against[one.passes(np.zeros(len(against), np.int64), h1[against], h2[against], level)]
        held, against = wrong, held
    return sizes, hashes, b"".join(bits)


# ------------------------------------------------------------------------ keys


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def _split_key(key: Column) -> tuple[Column, Column]:
    return F.regexp_extract(key, r"^[^/]*", 0), F.regexp_extract(key, r"^[^/]*(.*)$", 1)


def keys(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """All keys that could decide a url, longest first: its host and parent domains of at most ``labels`` labels, each with the path's beginnings of the given lengths."""
    none = F.array().cast("array<string>")
    if not labels:
        return none
    parts = F.split(host, r"\.")
    n = F.least(F.size(parts), F.lit(labels))
    hosts = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."))
    own = F.array(*[F.when(F.length(path) >= k, F.substring(path, 1, k)) for k in sorted(lengths, reverse=True)])
    own = F.filter(own, lambda p: p.isNotNull())
    every = F.flatten(F.transform(hosts, lambda h: F.transform(own, lambda p: F.concat(h, p))))
    by_length = lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).otherwise(0)
    return F.when(host != "", F.array_sort(F.array_distinct(every), by_length)).otherwise(none)


def _staged(rows: DataFrame, **columns: Column) -> DataFrame:
    """``rows`` with further columns that are computed once a row."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def located(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(``key``, host, path) of every row of ``pages``."""
    host, path = host_and_path(F.col("url").cast("string"))
    return _staged(pages.select(key, "url"), host=host, path=path).select(key, "host", "path")


def junk_hosts(pages: DataFrame, words: Sequence[str] = JUNK) -> DataFrame:
    """Keys (key, kind LISTED) of the corpus's hosts with a label that has one of ``words`` between hyphens: the domain from the last such label on."""
    labels = F.split("host", r"\.")
    marked = F.transform(labels, lambda x: F.arrays_overlap(F.split(x, "-"), F.array(*[F.lit(w) for w in words])))
    last = F.array_max(F.transform(marked, lambda m, k: F.when(m, k)))
    hosts = located(pages, "url").select("host").distinct().withColumn("last", last).filter("last is not null")
    return hosts.select(F.array_join(F.slice(labels, F.col("last") + 1, F.size(labels)), ".").alias("key"), F.lit(LISTED).alias("kind")).distinct()


def _keyed(places: DataFrame, lists: DataFrame) -> DataFrame:
    """``places`` (host, path) with ``keys``, as far as ``lists`` can hold them."""
    host, path = _split_key(F.col("key"))
    shape = lists.agg(F.max(F.size(F.split(host, r"\."))).alias("labels"), F.collect_set(F.length(path)).alias("lengths")).first()  # as many numbers as the longest key has characters, at most
    return _staged(places, keys=keys(F.col("host"), F.col("path"), shape["labels"] or 0, shape["lengths"]))


def universe(keyed: DataFrame, lists: DataFrame) -> DataFrame:
    """Every key of the corpus and of the lists, once: (h1, h2, flags), a bit of ``flags`` for each kind of list that holds it."""
    seen = keyed.select(F.explode("keys").alias("key"), F.lit(0).alias("flags"))
    held = lists.select("key", F.expr("shiftleft(1, kind)").alias("flags"))
    return seen.unionByName(held).select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), "flags").groupBy("h1", "h2").agg(F.bit_or("flags").alias("flags"))


def cascades(keyed: DataFrame, lists: DataFrame, kinds: int = 3) -> tuple[DataFrame, int]:
    """The cascades of all shards and kinds of list (only those that list a key), written, and the number of shards."""
    every = written(universe(keyed, lists), "universe")
    shards = 1 << max(0, (every.count() - 1) // SHARD_KEYS).bit_length()

    def make(table: pa.Table) -> pa.Table:
        h1, h2, flags = (table.column(c).to_numpy() for c in ("h1", "h2", "flags"))
        h1, h2, rows = h1.view(np.uint64), h2.view(np.uint64), []
        for kind in range(kinds):
            listed = (flags >> kind & 1).astype(bool)
            if listed.any():
                sizes, hashes, bits = build(h1, h2, listed)
                rows.append({"shard": table.column("shard")[0].as_py(), "kind": kind, "sizes": sizes, "hashes": hashes, "bits": bits})
        kinds_ = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
        return pa.Table.from_pylist(rows, pa.schema(list(zip(_CASCADE.names, kinds_))))

    out = written(every.withColumn("shard", F.pmod("h2", F.lit(shards).cast("long"))).groupBy("shard").applyInArrow(make, _CASCADE), "cascades")
    removed(every.sparkSession, every)
    return out, shards


def _tested(rows: DataFrame, some: list, shards: int) -> DataFrame:
    """``rows`` (..., h1, h2, hits) with the hits of the given cascades added: a bit for each kind of list, key by key."""
    held = {}
    for r in some:
        held.setdefault(r["kind"], []).append(r)
    packed = rows.sparkSession.sparkContext.broadcast({kind: (np.array([r["shard"] for r in own], np.int64), Cascades([r["sizes"] for r in own], [r["hashes"] for r in own], [bytes(r["bits"]) for r in own])) for kind, own in held.items()})
    at = {c: rows.columns.index(c) for c in ("h1", "h2", "hits")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = {c: batch.column(k) for c, k in at.items()}
            h1, h2 = (lists[c].flatten().to_numpy().view(np.uint64) for c in ("h1", "h2"))
            hits = lists["hits"].flatten().to_numpy().copy()
            shard = (h2 & np.uint64(shards - 1)).astype(np.int64)
            for kind, (ids, cascade) in packed.value.items():
                order = np.argsort(ids)
                near = np.minimum(np.searchsorted(ids[order], shard), len(ids) - 1)
                here = np.flatnonzero(ids[order][near] == shard)
                hits[here] |= cascade.member(order[near[here]], h1[here], h2[here]).astype(np.int32) << kind
            off = np.concatenate(([0], np.cumsum(lists["h1"].value_lengths().to_numpy()))).astype(np.int32)
            columns = list(batch.columns)
            columns[at["hits"]] = pa.ListArray.from_arrays(pa.array(off), pa.array(hits))
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return rows.mapInArrow(run, rows.schema)


def judge(pages: DataFrame, lists: DataFrame, key: str = "page_id") -> DataFrame:
    """Verdict on every row of ``pages`` (``key``, url) by ``lists`` (key, kind): (``key``, host, path, rule, verdict).

    A key such as ``example.org/es/`` fits its host and all subdomains where the
    path begins as the key's does; ``host`` alone fits any path. Of the rules
    (kinds ALLOW and BLOCK) that fit the longest wins, BLOCK if one key is both;
    ``rule`` names it. A url without a rule is blocked if a key of kind LISTED
    fits, else allowed. Membership is exact: the cascades cover every key of
    these urls. More than ``SENT_BYTES`` of cascades are tested in several
    passes. A null url, or one without ``://``, has an empty host and path, and
    is allowed; null and empty keys are ignored; repeated rows stay.
    """
    spark = pages.sparkSession
    lists = lists.filter(F.col("key") != "").select("key", F.col("kind").cast("int").alias("kind")).distinct()
    rows = _keyed(located(pages, key), lists)
    made, shards = cascades(rows, lists)
    rows = rows.withColumns({"h1": F.transform("keys", lambda k: F.xxhash64(k)), "h2": F.transform("keys", lambda k: F.xxhash64(F.lit(1), k)), "hits": F.transform("keys", lambda k: F.lit(0))})
    size = made.agg(F.sum(F.octet_length("bits") + 16 * F.size("sizes") + 32)).first()[0] or 0
    passes = max(1, -(-size // SENT_BYTES))
    for k in range(passes):
        before, rows = rows, _tested(rows, made.filter(F.pmod("shard", F.lit(passes)) == k).collect(), shards)  # at most about SENT_BYTES
        if passes > 1:
            rows = written(rows, "tested")
            if k:
                removed(spark, before)
    removed(spark, made)
    ruled = F.array_position(F.transform("hits", lambda h: h.bitwiseAND(3) > 0), True)
    at = F.when(ruled > 0, ruled).cast("int")
    hit, junk = F.get("hits", at - 1), F.exists("hits", lambda h: h.bitwiseAND(1 << LISTED) > 0)
    blocked = F.when(at.isNotNull(), hit.bitwiseAND(1 << BLOCK) > 0).otherwise(junk)
    return rows.select(key, "host", "path", F.get("keys", at - 1).alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))
