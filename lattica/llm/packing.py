"""Packing: documents become pieces of sequences of a bounded number of tokens.

Hierarchical multi-length packing. A document's tokens give whole windows of
the longest context size; its tail is routed to the smallest context-size tier
that holds it. Each tier packs sequences of its own size, the longest tier
first: a sequence opens with the tier's longest tail, its gap is filled from
the same and shorter tiers by best fit, and a last gap is closed by cutting a
tail of these tiers. What is left at the end of a partition is cut into
sequences of power-of-two lengths, which need no padding. Sequences are then
dealt to step groups of equal attention cost.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.tokens import encoder

PIECES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("tier", T.IntegerType()),
        T.StructField("step_group", T.LongType()),
    ]
)


class _Tail:
    """A run of a document's tokens that no sequence holds yet."""

    __slots__ = ("doc", "start", "ids", "total")

    def __init__(self, doc: int | None, start: int, ids: np.ndarray, total: int):
        self.doc, self.start, self.ids, self.total = doc, start, ids, total

    def cut(self, n: int) -> _Tail:
        """Take the first n tokens off."""
        head = _Tail(self.doc, self.start, self.ids[:n], self.total)
        self.start, self.ids = self.start + n, self.ids[n:]
        return head


class Packer:
    """Packs the tails of one partition; ``hold`` bounds how many wait for a partner."""

    def __init__(self, size: int, tiers: tuple[int, ...], hold: int, group: int, first_id: int):
        self.size, self.tiers, self.hold, self.group, self.next_id = size, sorted({*tiers, size}), hold, group, first_id
        self.waiting: list[list[_Tail]] = [[] for _ in range(size + 1)]  # by length
        self.filled = 0  # bit n: a tail of n tokens waits
        self.count = self.tokens = 0
        self.bands = [(low, high, ((1 << (high + 1)) - 1) ^ ((1 << (low + 1)) - 1)) for low, high in zip([0, *self.tiers], self.tiers)]
        self.held = [0] * len(self.tiers)  # tokens that wait in each tier
        self.done: list[list[_Tail]] = []
        self.groups = 0

    def _tier(self, n: int) -> int:
        """The smallest tier that holds n tokens."""
        return bisect_left(self.tiers, n)

    def _put(self, tail: _Tail) -> None:
        n = len(tail.ids)
        self.held[self._tier(n)] += n
        self.waiting[n].append(tail)
        self.filled |= 1 << n
        self.count += 1
        self.tokens += n

    def _take(self, most: int) -> _Tail | None:
        """The longest waiting tail of at most so many tokens."""
        n = (self.filled & ((1 << (most + 1)) - 1)).bit_length() - 1
        if n < 1:
            return None
        tail = self.waiting[n].pop()
        if not self.waiting[n]:
            self.filled ^= 1 << n
        self.count -= 1
        self.tokens -= n
        self.held[self._tier(n)] -= n
        return tail

    def _take_to_cut(self, gap: int) -> _Tail | None:
        """The shortest waiting tail longer than the gap."""
        above = self.filled >> (gap + 1)
        if not above:
            return None
        n = gap + 1 + (above & -above).bit_length() - 1
        tail = self.waiting[n].pop()
        if not self.waiting[n]:
            self.filled ^= 1 << n
        self.count -= 1
        self.tokens -= n
        self.held[self._tier(n)] -= n
        return tail

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        whole = n - n % self.size
        for at in range(0, whole, self.size):
            self.done.append([_Tail(doc, at, ids[at : at + self.size], n)])
        if whole < n:
            self._put(_Tail(doc, whole, ids[whole:].copy(), n))
        if self.count > self.hold:
            self.pack(self.hold // 2)

    def pack(self, keep: int) -> None:
        """Fill sequences of each tier until at most so many tails wait, or no tier with a tail of its own can fill one."""
        for k in reversed(range(len(self.tiers))):
            _, size, own = self.bands[k]
            # at least a gap's tokens wait in these tiers, so the shortest tail longer than the gap is one of theirs
            while self.count > keep and self.filled & own and sum(self.held[: k + 1]) >= size:
                sequence, gap = [], size
                while gap:
                    if not (tail := self._take(gap)):
                        longer = self._take_to_cut(gap)
                        tail = longer.cut(gap)
                        self._put(longer)
                    sequence.append(tail)
                    gap -= len(tail.ids)
                self.done.append(sequence)

    def finish(self) -> None:
        self.pack(0)
        rest = self.tokens
        for bit in reversed(range(rest.bit_length())):
            want = 1 << bit
            if rest & want:
                sequence, gap = [], want
                while gap:
                    if not (tail := self._take(gap)):
                        tail = self._take_to_cut(gap)
                        piece = tail.cut(gap)
                        self._put(tail)
                        tail = piece
                    sequence.append(tail)
                    gap -= len(tail.ids)
                self.done.append(sequence)

    def rows(self) -> pa.RecordBatch | None:
        """The finished sequences as rows, dealt to step groups."""
        if not self.done:
            return None
        cost = [sum(len(t.ids) ** 2 for t in s) for s in self.done]
        n_groups = -(-len(self.done) // self.group)
        deal = {}
        for rank, k in enumerate(sorted(range(len(self.done)), key=lambda k: -cost[k])):  # to and fro over the groups
            lap, at = divmod(rank, n_groups)
            deal[k] = at if lap % 2 == 0 else n_groups - 1 - at
        out: list[tuple] = []
        for k, sequence in enumerate(self.done):
            length = sum(len(t.ids) for t in sequence)
            tier = next(t for t in self.tiers if length <= t)
            offset = 0
            for t in sequence:
                out.append((t.doc, t.start, len(t.ids), zlib.crc32(t.ids.astype("<u4").tobytes()), t.total, self.next_id, offset, tier, (self.next_id >> 32 << 32) + self.groups + deal[k]))
                offset += len(t.ids)
            self.next_id += 1
        self.groups += n_groups
        self.done = []
        kinds = [pa.int64()] * 7 + [pa.int32(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=PIECES.names)


def pack(docs: DataFrame, tokenizer: str, size: int = 1024, tiers: tuple[int, ...] = (128, 256, 512), end_id: int = 0, hold: int = 8192, group: int = 64) -> DataFrame:
    """Pack all documents into sequences of at most ``size`` tokens (see ``PIECES`` for the columns).

    Each token of each document, and the ``end_id`` after its last one, lies in
    exactly one piece. ``start`` counts the document's tokens before the piece;
    ``offset`` is its place in the sequence. A sequence is as long as its
    ``tier``, the smallest context size that holds it; only the last few
    sequences of an input partition are shorter, and those are powers of two,
    so nothing is padded. ``step_group`` deals a partition's sequences to steps of up to
    ``group`` sequences of like cost (sum of squared piece lengths).

    A null or empty text is the ``end_id`` alone. Repeated rows are packed each
    on its own. A null doc_id stays null; other columns are ignored. Each input
    partition is packed on its own, in its own order, with at most ``hold``
    waiting tails in memory: no shuffle, and a lost task gives the same rows again.
    """
    if size < 2 or any(t < 1 or t > size for t in tiers):
        raise ValueError("tiers lie between 1 and size")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        packer = Packer(size, tiers, hold, group, TaskContext.get().partitionId() << 32)
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for i, j, tokens in coder.encode(batch.column(1)):
                ids = tokens.ids.astype(np.uint32)
                for k in range(i, j):
                    own = ids[tokens.off[k - i] : tokens.off[k - i + 1]]
                    packer.add(doc_ids[k], np.append(own, np.uint32(end_id)))
                if len(packer.done) > 2000 and (out := packer.rows()) is not None:
                    yield out
        packer.finish()
        if (out := packer.rows()) is not None:
            yield out

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)
