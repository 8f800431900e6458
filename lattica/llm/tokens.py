"""Token counts: each text is encoded once, its tokens mapped to character spans.

The byte-level BPE of ``tokenizers`` splits a text into pieces (words with the
space before them, digits, marks, white space) and encodes each piece on its
own. So pieces are cut and hashed for a whole batch in numpy, a bounded table
keeps the ids of pieces seen before, and ``tokenizers`` itself encodes only the
new ones. The result equals ``Tokenizer.encode(text, add_special_tokens=False)``
with its ids and offsets (tests compare the two).
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import chunks, mix, powers, utf8

LETTER, NUMBER, BLANK, MARK = 0, 1, 2, 3


def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, or any other."""
    out = np.full(sys.maxunicode + 1, MARK, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind == "L":
            out[c] = LETTER
        elif kind == "N":
            out[c] = NUMBER
    out[[*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = BLANK
    return out


class Encoded(NamedTuple):
    """Tokens of a batch: ids, first and end character of each (in its text), n + 1 row offsets, lengths of the texts."""

    ids: np.ndarray
    first: np.ndarray
    end: np.ndarray
    off: np.ndarray
    n_chars: np.ndarray


class Encoder:
    """Vectorised encoder of one byte-level BPE tokenizer file.

    ``slots`` bounds the table of known pieces (16 bytes each and their tokens).
    """

    def __init__(self, path: str, slots: int = 1 << 18):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.n_bytes = np.zeros(self.tokenizer.get_vocab_size() + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token)  # each byte is written as one character
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        self.classes = _classes()
        rng = np.random.Generator(np.random.PCG64(7))
        self.values = rng.integers(1, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.slots = slots
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(self.slots, np.uint64)
        self.at = np.zeros(self.slots, np.int64)
        self.n_ids = np.zeros(self.slots, np.int32)
        self.pool = [np.zeros(1 << 16, np.int32) for _ in range(3)]
        self.used = 0

    def _pieces(self, points: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the pieces, and of those the offsets of each row.

        The rules, as in the public pattern of this kind of tokenizer: runs of
        letters, of numbers and of marks, each with one space before it; ``'s``,
        ``'t``, ``'re``, ``'ve``, ``'m``, ``'ll`` and ``'d`` on their own; a run
        of white space before anything else leaves its last character over.
        """
        n = len(points)
        kind = self.classes[points]
        start = np.empty(n, bool)
        start[0] = True
        start[1:] = kind[1:] != kind[:-1]
        rows = off[(off > 0) & (off < n)]
        edge = np.zeros(n + 1, bool)  # a row begins here
        edge[rows] = True
        edge[0] = edge[n] = True
        start |= edge[:n]
        # the last blank of a run that something follows stands alone, or goes with it if it is a space
        blank = kind == BLANK
        last = blank.copy()
        last[:-1] &= ~blank[1:]
        last &= ~edge[1:]
        at = np.flatnonzero(last)
        start[at] = True
        joined = at[points[at] == 0x20] + 1
        start[joined] = False
        # contractions: an apostrophe alone in its run, not after a joined space
        mark = np.flatnonzero((points == 0x27) & start)
        if len(mark):
            for p in mark:
                room = points[p + 1 : p + 3]
                stop = np.flatnonzero(edge[p + 1 : p + 4])
                if len(stop):
                    room = room[: stop[0]]
                text = "".join(map(chr, room))
                take = 2 if text in ("re", "ve", "ll") else 1 if text[:1] in ("s", "t", "m", "d") and text else 0
                if take:
                    start[p + 1 : p + 1 + take] = False
                    if p + 1 + take < n:
                        start[p + 1 + take] = True
        starts = np.flatnonzero(start)
        return starts, np.searchsorted(starts, off)

    def _add(self, new: list[str], hashes: np.ndarray, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode pieces that the table lacks; where their tokens are in the pool, and how many."""
        blank = np.array([x.isspace() for x in new], bool)
        order = np.concatenate((np.flatnonzero(~blank), np.flatnonzero(blank)))
        plain, odd = order[: len(new) - blank.sum()], order[len(new) - blank.sum() :]
        flat, sizes = [], np.zeros(len(new), np.int64)
        for k in range(0, len(plain), 4000):
            some = plain[k : k + 4000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(new[i] for i in some)], add_special_tokens=False)[0].ids, np.int32)
            cuts = np.concatenate(([-1], np.flatnonzero(ids == self.newline), [len(ids)]))
            if len(cuts) != len(some) + 1:
                raise AssertionError("pieces of the tokenizer file are not those of a byte-level BPE")
            sizes[k : k + len(some)] = np.diff(cuts) - 1
            flat.append(ids[ids != self.newline])
        found = self.tokenizer.encode_batch_fast([new[i] for i in odd], add_special_tokens=False) if len(odd) else []
        sizes[len(plain) :] = [len(e.ids) for e in found]
        flat = np.concatenate([*flat, np.array([i for e in found for i in e.ids], np.int32)])
        data = np.frombuffer("".join(new[i] for i in order).encode(), np.uint8)
        char = np.cumsum((data & 0xC0) != 0x80) - 1
        widths = self.n_bytes[flat]
        stop = np.cumsum(widths)
        base = np.repeat(np.cumsum([0, *(len(new[i]) for i in order)])[:-1], sizes)
        first, end = char[stop - widths] - base, char[stop - 1] + 1 - base
        need = self.used + len(flat)
        if need > len(self.pool[0]):
            self.pool = [np.concatenate((x, np.zeros(max(len(x), need), np.int32))) for x in self.pool]
        for x, y in zip(self.pool, (flat, first, end)):
            x[self.used : need] = y
        where, count = np.empty(len(new), np.int64), np.empty(len(new), np.int64)
        where[order], count[order] = self.used + np.cumsum(sizes) - sizes, sizes
        self.keys[slots] = hashes  # where two want one slot the last stays
        self.at[slots], self.n_ids[slots] = where, count
        self.used = need
        return where, count

    def _flat(self, data: np.ndarray, off: np.ndarray) -> Encoded:
        text = data.tobytes().decode()
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        rows = heads[off]
        n = len(points)
        if not n:
            none = np.zeros(0, np.int64)
            return Encoded(none, none, none, np.zeros(len(off), np.int64), np.zeros(len(off) - 1, np.int64))
        starts, piece_off = self._pieces(points, rows)
        ends = np.append(starts[1:], n)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.values[points & 0xFFFF] + (points >> 16).astype(np.uint64)) * up[:n], out=total[1:])
        hashes = mix((total[ends] - total[starts]) * down[starts]) | np.uint64(1)
        slot = (hashes >> np.uint64(40)).astype(np.int64) % self.slots
        if self.used > 6 * self.slots:
            self.clear()
        at, sizes = self.at[slot], self.n_ids[slot].astype(np.int64)
        new = np.flatnonzero(self.keys[slot] != hashes)
        if len(new):
            _, one, which = np.unique(hashes[new], return_index=True, return_inverse=True)
            one = new[one]
            where, count = self._add([text[a:b] for a, b in zip(starts[one], ends[one])], hashes[one], slot[one])
            at[new], sizes[new] = where[which], count[which]
        stop = np.cumsum(sizes)
        take = np.repeat(at - (stop - sizes), sizes) + np.arange(stop[-1])
        shift = np.repeat(starts - np.repeat(rows[:-1], np.diff(piece_off)), sizes)
        token_off = np.concatenate(([0], stop))[piece_off]
        return Encoded(self.pool[0][take], self.pool[1][take] + shift, self.pool[2][take] + shift, token_off, np.diff(rows))

    def encode(self, column: pa.Array) -> Iterator[tuple[int, int, Encoded]]:
        """Row ranges of the column and their tokens; a null text has none."""
        data, off = utf8(column)
        for i, j in chunks(off):
            part, rows = data[off[i] : off[j]], off[i : j + 1] - off[i]
            raw = part.tobytes()
            if any(s.encode() in raw for s in self.specials):
                yield i, j, self._slow([raw[a:b].decode() for a, b in zip(rows[:-1], rows[1:])])
            else:
                yield i, j, self._flat(part, rows)

    def _slow(self, texts: list[str]) -> Encoded:
        """Texts that hold a special token's string: by the tokenizer alone."""
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        spans = np.array([o for e in found for o in e.offsets], np.int64).reshape(-1, 2)
        off = np.cumsum([0, *map(len, found)])
        return Encoded(np.array([i for e in found for i in e.ids], np.int32), spans[:, 0], spans[:, 1], off, np.array(list(map(len, texts)), np.int64))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each file and worker."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def public_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


RULES = ("first", "last", "most")
SECTIONS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("section", T.IntegerType()),
        T.StructField("start_char", T.LongType()),
        T.StructField("end_char", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("n_crossing", T.LongType()),
    ]
)


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether the token crosses a boundary.

    ``starts`` are the ascending first characters of the sections that tile the
    text. ``first``: the section of a token's first character. ``last``: that of
    its last one. ``most``: the one with most of its characters, the earliest
    of several.
    """
    a = np.searchsorted(starts, first, "right") - 1
    b = np.searchsorted(starts, np.maximum(end - 1, first), "right") - 1
    crossing = a != b
    if rule == "last":
        a = b.copy()
    elif rule == "most" and crossing.any():
        a = a.copy()
        for k in np.flatnonzero(crossing):
            edges = [int(first[k]), *map(int, starts[a[k] + 1 : b[k] + 1]), int(end[k])]
            a[k] += int(np.argmax(np.diff(edges)))
    return a, crossing


def attribute_tokens(docs: DataFrame, tokenizer: str, rule: str = "first", lines: int = 1) -> DataFrame:
    """Tokens of each section of each text: (doc_id, section, start_char, end_char, n_tokens, n_crossing).

    Sections tile a text: ``lines`` lines each, with the line feeds that end
    them. A text is encoded whole and once; each token's character span is
    matched to the sections by binary search and a token over a boundary goes
    to one section by ``rule`` (see :func:`allocate`); ``n_crossing`` counts
    such tokens at the section that got them. So the sum over a text's sections
    is its token count.

    A null or empty text has one section 0 of no characters and no tokens.
    Repeated rows repeat their sections, a null doc_id stays null, other
    columns are ignored. Rows are independent: no shuffle, and a lost executor
    costs its own tasks only.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if lines < 1:
        raise ValueError("lines is at least 1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            ids, column = batch.column(0), batch.column(1)
            data, off = utf8(column)
            for i, j, tokens in coder.encode(column):
                part = data[off[i] : off[j]]
                chars = np.cumsum((part & 0xC0) != 0x80)
                feeds = chars[part == 0x0A]  # characters up to and with each line feed
                base = np.concatenate(([0], np.cumsum(tokens.n_chars)))
                # a section begins at each row and after every lines-th line feed that is not the row's last character
                feed_row = np.searchsorted(base, feeds, "left") - 1
                nth = np.arange(len(feeds)) - np.searchsorted(feed_row, feed_row) + 1
                inner = feeds[(nth % lines == 0) & (feeds < base[feed_row + 1])]
                starts = np.sort(np.concatenate((base[:-1], inner)), kind="stable")
                row = np.empty(len(starts), np.int64)
                order = np.argsort(np.concatenate((base[:-1], inner)), kind="stable")
                inner_row = np.searchsorted(base[:-1], inner, "right") - 1
                # of several empty rows at one place the last one owns the characters
                row[:] = np.concatenate((np.arange(j - i), inner_row))[order]
                token_base = np.repeat(base[:-1], np.diff(tokens.off))
                owner, crossing = allocate(tokens.first + token_base, tokens.end + token_base, starts, rule)
                n = len(starts)
                stops = np.append(starts[1:], base[-1])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.take(pa.array(row + i)),
                        pa.array((np.arange(n) - np.searchsorted(row, row)).astype(np.int32)),
                        pa.array(starts - base[row]),
                        pa.array(stops - base[row]),
                        pa.array(np.bincount(owner, minlength=n)),
                        pa.array(np.bincount(owner[crossing], minlength=n)),
                    ],
                    names=SECTIONS.names,
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SECTIONS)


FIELDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("field", T.StringType()), *SECTIONS.fields[2:]])


def attribute_fields(docs: DataFrame, tokenizer: str, fields: list[str], rule: str = "first", glue: str = "\n") -> DataFrame:
    """Tokens of each field of each row: (doc_id, field, start_char, end_char, n_tokens, n_crossing).

    The fields are joined by ``glue``, which belongs to the field before it, and
    encoded whole and once; a token over a boundary goes to one field by
    ``rule`` (see :func:`allocate`). A null field is empty. Repeated rows repeat
    their fields, a null doc_id stays null, other columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    if not fields or not glue:
        raise ValueError("fields and the glue between them are needed")
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]
    sizes = [F.length(t).cast("long") + (len(glue) if k + 1 < len(fields) else 0) for k, t in enumerate(texts)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(tokenizer)
        for batch in batches:
            size = np.stack([batch.column(2 + k).to_numpy() for k in range(len(fields))], 1)
            for i, j, tokens in coder.encode(batch.column(1)):
                first = np.cumsum(size[i:j], 1) - size[i:j]
                base = np.concatenate(([0], np.cumsum(tokens.n_chars)))
                starts = (first + base[:-1, None]).ravel()
                token_base = np.repeat(base[:-1], np.diff(tokens.off))
                owner, crossing = allocate(tokens.first + token_base, tokens.end + token_base, starts, rule)
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(np.repeat(np.arange(i, j), len(fields)))),
                        pa.array(fields * (j - i), pa.string()),
                        pa.array(first.ravel()),
                        pa.array((first + size[i:j]).ravel()),
                        pa.array(np.bincount(owner, minlength=n)),
                        pa.array(np.bincount(owner[crossing], minlength=n)),
                    ],
                    names=FIELDS.names,
                )

    return docs.select(F.col("doc_id").cast("long"), F.concat_ws(glue, *texts), *sizes).mapInArrow(run, FIELDS)
