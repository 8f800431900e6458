"""Benchmark decontamination: SimHash of item-sized windows, Hamming blocks, exact check.

For each benchmark item of m words every window of m words of every text is a
candidate place. A window's fingerprint is the 64-bit SimHash of its five-word
shingles, weighted by their counts. Item fingerprints of a size are indexed in
``radius + 1`` bit blocks: two fingerprints within the radius agree on a whole
block at least, so no near fingerprint is lost. A window's candidates are the
items within the radius, and those beyond it whose shingles it holds often
enough to reach the threshold all the same; both are verified by the exact
weighted Jaccard of the shingle counts. Windows that hold too few of the items'
shingles to reach the threshold are passed over before they are fingerprinted,
which loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import chunks, shingles, span_hashes, utf8, written
from lattica.llm.letters import LETTER, NUMBER, words

WORDS = 5


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, lower case) and the rows' offsets into them."""
    part, starts, ends, word_off = words(data, off, LETTER | NUMBER)
    return span_hashes(part, starts, ends), word_off


def simhashes(hashes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """SimHash of ``hashes[s:s+n]`` for each start: the sign of each bit's sum."""
    lo, hi = int(starts.min()), int(starts.max()) + n
    bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32)
    total = np.zeros((hi - lo + 1, 64), np.int32)
    np.cumsum(2 * bits - 1, axis=0, out=total[1:])
    return np.packbits(total[starts - lo + n] > total[starts - lo], axis=1, bitorder="little").reshape(-1).view(np.uint64)


class HammingIndex:
    """Fingerprints by bit blocks; finds all within a Hamming radius."""

    def __init__(self, prints: np.ndarray, radius: int):
        self.prints, self.radius = prints, radius
        edges = np.linspace(0, 64, min(64, radius + 1) + 1).astype(int)
        self.blocks = []
        for a, b in zip(edges[:-1], edges[1:]):
            mask = np.uint64(((1 << int(b)) - 1) ^ ((1 << int(a)) - 1))
            order = np.argsort(prints & mask, kind="stable")
            self.blocks.append((mask, order, (prints & mask)[order]))

    def near(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs (place in wanted, place in the index, distance) within the radius."""
        found = []
        for mask, order, values in self.blocks:
            key = wanted & mask
            lo, hi = np.searchsorted(values, key, "left"), np.searchsorted(values, key, "right")
            n = hi - lo
            at = np.repeat(np.arange(len(wanted)), n)
            to = order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            found.append(at * len(self.prints) + to)
        pairs = np.unique(np.concatenate(found))
        at, to = pairs // len(self.prints), pairs % len(self.prints)
        distance = np.bitwise_count(wanted[at] ^ self.prints[to])
        keep = distance <= self.radius
        return at[keep], to[keep], distance[keep]


def weighted_jaccard(x: np.ndarray, y: np.ndarray) -> float:
    """Sum of the lesser counts over the sum of the greater ones."""
    a, n = np.unique(x, return_counts=True)
    b, m = np.unique(y, return_counts=True)
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    common = int(np.minimum(n[i], m[j]).sum())
    return common / (len(x) + len(y) - common)


class Items:
    """Benchmark items of one block, indexed."""

    def __init__(self, ids: list[int | None], texts: list[str | None], threshold: float, radius: int):
        self.ids, self.threshold = ids, threshold
        data, off = utf8(pa.array(texts, pa.string()))
        hashed, word_off = word_hashes(data, off)
        sizes = np.diff(word_off)
        self.whole: dict[int, dict[int, list[int]]] = {}  # items of fewer than five words: their one hash
        hashes, hash_off = shingles(hashed, word_off, WORDS)
        for k in np.flatnonzero((sizes > 0) & (sizes < WORDS)):
            m = int(sizes[k])
            one, _ = shingles(hashed[word_off[k] : word_off[k + 1]], np.array([0, m]), m)
            self.whole.setdefault(m, {}).setdefault(int(one[0]), []).append(int(k))
        long = np.flatnonzero(sizes >= WORDS)
        self.bags = {int(k): hashes[hash_off[k] : hash_off[k + 1]] for k in long}
        known = [self.bags[int(k)] for k in long]
        self.known, which = np.unique(np.concatenate(known) if known else np.zeros(0, np.uint64), return_inverse=True)
        pairs = np.unique(which * max(1, len(ids)) + np.repeat(long, sizes[long] - WORDS + 1)) if len(long) else np.zeros(0, np.int64)
        self.owner, self.owner_off = pairs % max(1, len(ids)), np.searchsorted(pairs // max(1, len(ids)), np.arange(len(self.known) + 1))
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[self.known >> np.uint64(42)] = True
        self.by_size: dict[int, tuple[np.ndarray, HammingIndex]] = {}
        for m in np.unique(sizes[long]):
            members = long[sizes[long] == m]
            prints = np.concatenate([simhashes(self.bags[int(k)], np.zeros(1, np.int64), int(m) - WORDS + 1) for k in members])
            self.by_size[int(m)] = (members, HammingIndex(prints, radius))
        self.sizes = sizes

    def find(self, data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """Matches (row, item, similarity, first word, words) of a text buffer: the best window of each row and item."""
        hashed, word_off = word_hashes(data, off)
        out = []
        for m, items in self.whole.items():
            hashes, at = shingles(hashed, word_off, m)
            counts = np.diff(word_off)
            wanted = np.array(sorted(items), np.uint64)
            hit = np.flatnonzero(np.isin(hashes, wanted))
            row = np.searchsorted(at, hit, "right") - 1
            ok = counts[row] >= m
            seen = set()
            for p, r in zip(hit[ok], row[ok]):
                for item in items[int(hashes[p])]:
                    if (r, item) not in seen:
                        seen.add((r, item))
                        out.append((int(r), item, 1.0, int(p - at[r]), m))
        if len(self.known):
            hashes, at = shingles(hashed, word_off, WORDS)
            maybe = np.flatnonzero(self.maybe[hashes >> np.uint64(42)])
            place = np.minimum(np.searchsorted(self.known, hashes[maybe]), len(self.known) - 1)
            sure = self.known[place] == hashes[maybe]
            hit, place = maybe[sure], place[sure]
            row = np.searchsorted(at, hit, "right") - 1
            counts = np.diff(word_off)
            for r in np.unique(row[counts[row] >= WORDS]):
                lo, hi = np.searchsorted(row, r), np.searchsorted(row, r, "right")
                out += [(int(r), *m) for m in self._row(hashes[at[r] : at[r + 1]], hit[lo:hi] - at[r], place[lo:hi])]
        return out

    def _row(self, hashes: np.ndarray, hit: np.ndarray, place: np.ndarray) -> list[tuple[int, float, int, int]]:
        n_owners = self.owner_off[place + 1] - self.owner_off[place]
        owners = self.owner[np.repeat(self.owner_off[place] - (np.cumsum(n_owners) - n_owners), n_owners) + np.arange(n_owners.sum())]
        shown, times = np.unique(owners, return_counts=True)
        # items of which the text holds enough shingles at all
        rest = self.sizes[shown] - WORDS + 1
        enough = shown[times >= np.ceil(self.threshold * rest - 1e-9)]
        flags = np.zeros(len(hashes) + 1, np.int64)
        flags[hit + 1] = 1
        total = np.cumsum(flags)
        spot = np.repeat(hit, n_owners)
        best: dict[int, tuple[float, int]] = {}
        for m in np.unique(self.sizes[enough]):
            n = int(m) - WORDS + 1
            if len(hashes) < n:
                continue
            starts = np.flatnonzero(total[n:] - total[:-n] >= np.ceil(self.threshold * n - 1e-9))
            if not len(starts):
                continue
            members, index = self.by_size[int(m)]
            at, to, _ = index.near(simhashes(hashes, starts, n))
            tried = {(int(starts[i]), int(members[j])) for i, j in zip(at, to)}
            # the exact way for windows beyond the radius: equal sums of counts leave a bound on the shingles in common
            for item in enough[self.sizes[enough] == m]:
                own = np.zeros(len(hashes) + 1, np.int64)
                own[spot[owners == item] + 1] = 1
                own = np.cumsum(own)
                need = np.ceil(2 * n * self.threshold / (1 + self.threshold) - 1e-9)
                tried.update((int(s), int(item)) for s in starts[own[starts + n] - own[starts] >= need])
            for s, item in sorted(tried):
                likeness = weighted_jaccard(hashes[s : s + n], self.bags[item])
                if likeness >= self.threshold and (item not in best or (-likeness, s) < (-best[item][0], best[item][1])):
                    best[item] = (likeness, s)
        return [(item, likeness, s, int(self.sizes[item])) for item, (likeness, s) in best.items()]


MATCHES = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("item_id", T.LongType()), T.StructField("similarity", T.DoubleType()), T.StructField("start_word", T.LongType()), T.StructField("n_words", T.LongType())]
)


def item_blocks(benchmark: DataFrame, block_bytes: int) -> list[DataFrame]:
    """The benchmark in blocks of about so many bytes of text, by a hash of its rows."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    return [items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b) for b in range(n)]


def _index(block: DataFrame, threshold: float, radius: int) -> Items:
    rows = block.collect()  # of at most block_bytes
    return Items([r["item_id"] for r in rows], [r["text"] for r in rows], threshold, radius)


def matches(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 7, block_bytes: int = 2 << 20) -> DataFrame:
    """Benchmark items found in each whole text: (doc_id, item_id, similarity, start_word, n_words).

    One row per text and item whose best window reaches ``threshold``; of
    several equally good windows the first. Words are runs of letters and
    digits of any script, compared in lower case. Items of fewer than five words
    are compared as one whole shingle; null and word-less items and texts match
    nothing. Texts are read whole, however long. Repeated texts or items repeat
    their rows, null ids stay null, other columns are ignored. No window that
    reaches the threshold is lost, whatever its fingerprint's distance.

    Items go to the executors in blocks of at most ``block_bytes`` of text, one
    pass over the texts for each block; of several blocks each one's matches are
    written before the next is sent. Texts are not shuffled.
    """
    blocks = item_blocks(benchmark, block_bytes)
    parts = []
    for block in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(_index(block, threshold, radius))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            items = sent.value
            for batch in batches:
                ids = batch.column(0)
                data, off = utf8(batch.column(1))
                for i, j in chunks(off):
                    if found := items.find(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                        row, item, *rest = zip(*found)
                        kinds = (pa.float64(), pa.int64(), pa.int64())
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.array(row) + i)), pa.array([items.ids[k] for k in item], pa.int64()), *(pa.array(c, k) for c, k in zip(rest, kinds))], names=MATCHES.names)

        part = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, MATCHES)
        if len(blocks) > 1:
            part = written(part, "matches")
            sent.destroy()
        parts.append(part)
    return reduce(DataFrame.unionByName, parts)


def clean(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, radius: int = 7, block_bytes: int = 2 << 20) -> DataFrame:
    """The rows of ``docs`` that match no benchmark item (see :func:`matches`), with all their columns.

    With one block of items the rows are filtered as they are read; with more,
    the hashes of the texts that match are written and the rows anti-joined.
    """
    blocks = item_blocks(benchmark, block_bytes)
    place = docs.columns.index("text")

    def keeps(items: Items, column: pa.Array) -> np.ndarray:
        data, off = utf8(column)
        keep = np.ones(len(column), bool)
        for i, j in chunks(off):
            for row, *_ in items.find(data[off[i] : off[j]], off[i : j + 1] - off[i]):
                keep[row + i] = False
        return keep

    if len(blocks) == 1:
        sent = docs.sparkSession.sparkContext.broadcast(_index(blocks[0], threshold, radius))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = keeps(sent.value, batch.column(place))
                if keep.any():
                    yield batch.filter(pa.array(keep))

        return docs.mapInArrow(run, docs.schema)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    hits = []
    for block in blocks:
        sent = docs.sparkSession.sparkContext.broadcast(_index(block, threshold, radius))

        def found(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = keeps(sent.value, batch.column(1))
                if not keep.all():
                    yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(~keep))], names=["_benchmark_hit"])

        hits.append(written(docs.select(F.xxhash64(text), text).mapInArrow(found, "_benchmark_hit long"), "hits"))
        sent.destroy()
    return docs.join(reduce(DataFrame.unionByName, hits).distinct(), F.xxhash64(text) == F.col("_benchmark_hit"), "left_anti")
