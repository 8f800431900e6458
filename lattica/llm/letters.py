"""Letters of UTF-8 buffers: Unicode classes, scripts and lower case for whole batches.

Only characters beyond ASCII are decoded; tables by code point then say what
each is, and the answer is spread over its bytes.
"""

from __future__ import annotations

import unicodedata
from typing import NamedTuple

import numpy as np

LETTER, MARK, NUMBER = 1, 2, 4
#: Code points with an entry of their own; those above are ideographs, tags or private.
TOP = 0x20000
IDEOGRAPHS = (0x20000, 0x3FFFF)

# Unicode ranges of the scripts.
SCRIPTS = ("none", "latin", "greek", "cyrillic", "armenian", "hebrew", "arabic", "indic", "thai", "lao", "hangul", "kana", "han", "other")
RANGES = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F), (0xFB13, 0xFB17)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "indic": [(0x900, 0xDFF)],
    "thai": [(0xE00, 0xE7F)],
    "lao": [(0xE80, 0xEFF)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)],
    "han": [(0x2E80, 0x2FDF), (0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), IDEOGRAPHS],
}


def _width(points: np.ndarray) -> np.ndarray:
    """Bytes of code points in UTF-8."""
    return 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kind, script, lower = np.zeros(TOP + 1, np.uint8), np.zeros(TOP + 1, np.uint8), np.arange(TOP + 1, dtype=np.uint32)
    bit = {"L": LETTER, "M": MARK, "N": NUMBER}
    for p in range(TOP):
        c = chr(p)
        kind[p] = bit.get(unicodedata.category(c)[0], 0)
        low = c.lower()
        if low != c and len(low) == 1:
            lower[p] = ord(low)
    kind[TOP] = LETTER
    script[:] = SCRIPTS.index("other")
    for name, ranges in RANGES.items():
        for a, b in ranges:
            script[a : b + 1] = SCRIPTS.index(name)
    script[(kind & (LETTER | MARK)) == 0] = 0
    every = np.arange(TOP + 1)
    lower = np.where(_width(lower) == _width(every), lower, every).astype(np.uint32)  # a buffer keeps its length
    return kind, script, lower


KIND, SCRIPT, LOWER = _tables()


class Wide(NamedTuple):
    """The characters beyond ASCII of a buffer: first byte, number of bytes, code point, and its place in the tables."""

    at: np.ndarray
    size: np.ndarray
    point: np.ndarray
    entry: np.ndarray


def wide(data: np.ndarray) -> Wide:
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.uint32)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    top = max(0, len(data) - 1)
    tail = [data[np.minimum(at + k, top)].astype(np.uint32) & 0x3F for k in (1, 2, 3)]
    two = (lead & 0x1F) << 6 | tail[0]
    three = (lead & 0x0F) << 12 | tail[0] << 6 | tail[1]
    four = (lead & 0x07) << 18 | tail[0] << 12 | tail[1] << 6 | tail[2]
    point = np.where(size == 2, two, np.where(size == 3, three, four))
    # of the code points above only the ideographs are letters; the rest goes to U+0000, which is nothing
    entry = np.where(point < TOP, point, np.where(point <= IDEOGRAPHS[1], TOP, 0))
    return Wide(at, size, point, entry)


def spread(data: np.ndarray, chars: Wide, table: np.ndarray) -> np.ndarray:
    """For each byte what the table says of its character."""
    out = table[data & 0x7F]
    out[data >= 0x80] = 0
    found = table[chars.entry]
    for k in range(4):
        some = chars.size > k
        out[chars.at[some] + k] = found[some]
    return out


def lowered(data: np.ndarray, chars: Wide | None = None) -> np.ndarray:
    """Lower case, character by character; the few letters whose lower case has another length stay."""
    out = data.copy()
    out[(data >= 0x41) & (data <= 0x5A)] += 0x20
    chars = wide(data) if chars is None else chars
    low = LOWER[chars.entry]
    change = np.flatnonzero((low != chars.entry) & (chars.entry != 0) & (chars.entry < TOP))
    at, low, size = chars.at[change], low[change], chars.size[change]
    head = np.where(size == 2, 0xC0, np.where(size == 3, 0xE0, 0xF0))
    out[at] = head | low >> (6 * (size - 1)).astype(np.uint32)
    for k in range(1, 4):
        some = size > k
        out[at[some] + k] = 0x80 | (low[some] >> (6 * (size[some] - 1 - k)).astype(np.uint32)) & 0x3F
    return out


def runs(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a byte mask within rows, and the rows' offsets into them."""
    n = len(mask)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    first, last = mask.copy(), mask.copy()
    first[1:] &= ~mask[:-1] | edge[1:n]
    last[:-1] &= ~mask[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def words(data: np.ndarray, off: np.ndarray, kinds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The lowered buffer, and in it the runs of characters of these kinds (see :func:`runs`)."""
    chars = wide(data)
    return lowered(data, chars), *runs((spread(data, chars, KIND) & kinds) > 0, off)
