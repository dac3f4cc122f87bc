r"""The public pattern that byte-level BPE splits text by, vectorised over the UTF-8 bytes of many texts.

`'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+` cuts a text into runs of one
class (letters, numbers, white space, the rest), after which a space goes with what follows it, the last
character of a longer run of white space stands alone, and a short ending follows a lone apostrophe.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa

from .common import text_buffers

_OTHER, _LETTER, _NUMBER, _SPACE = 0, 1, 2, 3


@cache
def _classes() -> np.ndarray:
    """The class of every code point, by its Unicode category or the White_Space property."""
    out = np.zeros(sys.maxunicode + 1, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            out[c] = _LETTER if kind == "L" else _NUMBER
        elif kind == "Z" or 9 <= c <= 13 or c == 0x85:
            out[c] = _SPACE
    return out


def _byte_classes(data: np.ndarray) -> np.ndarray:
    """The class of the character that each byte belongs to."""
    table = _classes()
    out = table[:256][data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        for least, size in ((0xC0, 2), (0xE0, 3), (0xF0, 4)):
            own = lead[(first >= least) & (first < (0xE0, 0xF0, 0x100)[size - 2])]
            if len(own):
                point = data[own].astype(np.int32) & (0x1F, 0x0F, 0x07)[size - 2]
                for k in range(1, size):
                    point = point << 6 | (data[own + k].astype(np.int32) & 0x3F)
                kind = table[np.minimum(point, sys.maxunicode)]
                for k in range(size):
                    out[own + k] = kind
    return out


def split_pretokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts as one flat binary array, and how many each text has."""
    data, offsets = text_buffers(texts)
    n = len(data)
    if not n:
        return pa.array([], pa.large_binary()), np.zeros(len(offsets) - 1, np.int64)
    kind = _byte_classes(data)
    hard = np.zeros(n + 1, bool)
    hard[offsets] = True
    start = np.empty(n + 1, bool)
    start[0] = start[n] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:n])
    start |= hard
    runs = np.flatnonzero(start)
    # runs of white space that something else follows
    first, after = runs[:-1], runs[1:]
    spaces = np.flatnonzero((kind[first] == _SPACE) & ~hard[after])
    first, after = first[spaces], after[spaces]
    # the last character of the run: one byte, or a longer one of Unicode's
    last = after - 1
    while len(wide := np.flatnonzero((data[last] & 0xC0) == 0x80)):
        last[wide] -= 1
    plain = data[last] == 0x20
    start[last] = True
    start[after[plain]] = False
    # endings after an apostrophe that begins a token and stands alone before letters
    mark = runs[:-1]
    mark = mark[(data[mark] == 0x27) & start[mark] & (mark + 1 < n)]
    mark = mark[(kind[mark + 1] == _LETTER) & ~hard[mark + 1]]
    if len(mark):
        one = data[mark + 1]
        two = np.where(mark + 2 < n, data[np.minimum(mark + 2, n - 1)], 0)
        two[hard[np.minimum(mark + 2, n)]] = 0
        short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        start[mark[short | long] + 1] = False
        start[mark[short] + 2] = True
        start[mark[long] + 3] = True
    at = np.flatnonzero(start)
    words = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    return words, np.diff(np.searchsorted(at, offsets))
