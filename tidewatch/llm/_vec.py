"""Whole-batch text primitives on raw UTF-8 bytes.

Arrow hands a string column over as one data buffer plus offsets. The helpers here work on
that buffer with numpy, so no Python object is made per document or per word. Work is cut at
document borders into pieces of about `CHUNK` bytes, which bounds the temporary arrays; a single
longer document is one piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_Q = np.uint64(0xD6E8FEB86659FD93)

#: ASCII capitals to small letters; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Space and the controls 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Everything of ASCII but letters and digits; bytes from 128 up belong to words.
NONWORD = np.ones(256, dtype=bool)
NONWORD[48:58] = NONWORD[65:91] = NONWORD[97:123] = NONWORD[128:] = False

_powers: dict[str, np.ndarray] = {}


def _table(kind: str, n: int) -> np.ndarray:
    """Powers 0..n of the hash base (or of its inverse) modulo 2^64, kept between calls up to a few chunks."""
    have = _powers.get(kind)
    if have is None or len(have) <= n:
        step = np.full(max(n + 1, CHUNK + 1), _P if kind == "p" else _PINV, dtype=np.uint64)
        step[0] = 1
        have = np.cumprod(step, dtype=np.uint64)
        if len(have) <= 16 * CHUNK:
            _powers[kind] = have
    return have


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every bit depends on every other."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(column, size: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of documents of about `size` bytes."""
    data, off = buffers(column)
    n, at = len(off) - 1, 0
    while at < n:
        to = int(np.searchsorted(off, off[at] + size, side="right")) - 1
        to = min(n, max(to, at + 1))
        yield at, to, data[off[at] : off[to]], off[at : to + 1] - off[at]
        at = to


class Words:
    """Words of a run of documents: `start`, `end` byte positions and `first[i]`, the index of document i's first word."""

    def __init__(self, data: np.ndarray, off: np.ndarray, breaks: np.ndarray, lower: bool = True):
        self.data = LOWER[data] if lower else data
        n = len(data)
        word = ~breaks[self.data]
        begin = np.zeros(n + 1, dtype=bool)
        begin[off] = True
        opens, closes = word.copy(), word.copy()
        if n:
            opens[1:] &= ~word[:-1] | begin[1:n]
            closes[:-1] &= ~word[1:] | begin[1:n]
        self.start, self.end = np.flatnonzero(opens), np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, off)
        self._sum: np.ndarray | None = None

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        """Document index of every word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hash of data[start:end] for every pair."""
        n = len(self.data)
        if self._sum is None:
            self._sum = np.zeros(n + 1, dtype=np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _table("p", n)[:n], dtype=np.uint64, out=self._sum[1:])
        return mix((self._sum[end] - self._sum[start]) * _table("i", n)[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


def hash_word(word: bytes) -> int:
    """The hash that Words.hashes gives `word`."""
    data = np.frombuffer(word, np.uint8)
    w = Words(data, np.array([0, len(data)]), np.zeros(256, dtype=bool), lower=False)
    return int(w.hashes()[0])


def shingles(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and their documents' borders; a document of 1 to k-1 words gives its whole sequence."""
    n_docs = len(first) - 1
    counts = np.diff(first)
    n = len(h)
    out = np.zeros(max(0, n - k + 1), dtype=np.uint64)
    for j in range(k):
        out = out * _Q + h[j : n - k + 1 + j] if len(out) else out
    full = np.maximum(counts - k + 1, 0)
    keep = np.zeros(n + 1, dtype=np.int64)
    np.add.at(keep, first[:-1][full > 0], 1)
    np.add.at(keep, (first[:-1] + full)[full > 0], -1)
    mask = np.cumsum(keep)[: len(out)] > 0
    long_part = mix(out[mask])
    short = np.flatnonzero((counts > 0) & (counts < k))
    size = full.copy()
    size[short] = 1
    border = np.concatenate([[0], np.cumsum(size)])
    if not len(short):
        return long_part, border
    both = np.empty(border[-1], dtype=np.uint64)
    is_short = np.zeros(border[-1], dtype=bool)
    is_short[border[short]] = True
    both[~is_short] = long_part
    for d in short:
        s = np.uint64(counts[d])
        with np.errstate(over="ignore"):
            for x in h[first[d] : first[d + 1]]:
                s = s * _Q + x
        both[border[d]] = mix(np.array([s ^ np.uint64(0x5851F42D4C957F2D)], dtype=np.uint64))[0]
    assert len(first) == n_docs + 1
    return both, border
