"""Words, shingles and packed buffers as numpy arrays, for use inside Arrow tasks.

Texts are looked at as UTF-8 bytes. All separators used here are ASCII, so no
character is ever cut. Hashes are 64 bits: a polynomial over the bytes of a
word, read off running sums, then mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

# Text that is worked on at once; arrays of 8 bytes for each byte of it are made.
SLICE_BYTES = 2 << 20

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_MASK = (1 << 64) - 1


def _table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=_U) * _U(0x2545F4914F6CDD1D) + _U(seed))


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (the finaliser of splitmix64)."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and its inverse modulo 2**64, for i below n."""
    held = _POWERS.get(0)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        up, down = np.full(size, _BASE, dtype=_U), np.full(size, _U(pow(int(_BASE), -1, 1 << 64)), dtype=_U)
        up[0] = down[0] = _U(1)
        held = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * SLICE_BYTES:
            _POWERS[0] = held
    return held[0][:n], held[1][:n]


def running(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What ``spans`` needs to hash any stretch of ``values``."""
    up, down = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, dtype=_U)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def spans(sums: tuple[np.ndarray, np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A polynomial hash of each stretch [start, end), not yet mixed."""
    total, down = sums
    return (total[end] - total[start]) * down[start]


def byte_hashes(sums, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A mixed hash of stretches of bytes, from what ``running`` made of them."""
    return mix(spans(sums, start, end) + (end - start).astype(_U) * _U(0xD6E8FEB86659FD93))


def byte_sums(data: np.ndarray, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    return running(_table(seed)[data])


def class_table(word: str) -> np.ndarray:
    """Which bytes belong to words: "space" splits at white space, "alnum" keeps
    digits, a-z and everything that is not ASCII."""
    table = np.ones(256, dtype=bool)
    if word == "space":
        table[[0x20, *range(0x09, 0x0E)]] = False
    else:
        table[:0x80] = False
        table[ord("0") : ord("9") + 1] = True
        table[ord("a") : ord("z") + 1] = True
    return table


LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def slices(batches, text: str = "text", limit: int = SLICE_BYTES):
    """Cut Arrow batches into ones of at most ``limit`` bytes of text, or one row."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if len(column) == 0:
            continue
        ends = np.cumsum(np.frombuffer(_lengths(column), dtype=np.int64))
        first = 0
        while first < len(column):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(first, last - first)
            first = last


def _lengths(column: pa.Array) -> bytes:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(column), 0).cast(pa.int64()).to_numpy(zero_copy_only=False).tobytes()


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and where each begins; null is empty."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """The words of several texts.

    data: all bytes (lower-cased if asked); start, end: of each word in ``data``;
    first: the number of the first word of each text, with the total at the end;
    doc: the text each word is in.
    """

    def __init__(self, column: pa.Array, word: str = "space", lower: bool = False):
        data, offsets = utf8(column)
        self._set(LOWER[data] if lower else data, offsets, class_table(word))

    @classmethod
    def of(cls, data: np.ndarray, offsets: np.ndarray, word: str = "space") -> Words:
        made = cls.__new__(cls)
        made._set(data, offsets, class_table(word))
        return made

    def _set(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> None:
        self.data, self.offsets = data, offsets
        inside = table[data]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:]
        # a text's end is a word's end, whatever the next text begins with
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        begins[edge] = inside[edge]
        ends[edge - 1] = inside[edge - 1]
        self.inside = inside
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.counts = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(offsets) - 1), self.counts)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 1) -> np.ndarray:
        """A mixed 64-bit hash of each word."""
        return byte_hashes(byte_sums(self.data, seed), self.start, self.end)

    def windows(self, hashes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The first word and the hash of every run of ``size`` words of one text."""
        n = len(self) - size + 1
        if n <= 0:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=_U)
        at = np.flatnonzero(self.doc[:n] == self.doc[size - 1 :])
        return at, mix(spans(running(hashes), at, at + size))

    def spaced(self, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words (those to keep), a space after each: bytes, and where each
        word starts and ends in them."""
        start, end = (self.start, self.end) if keep is None else (self.start[keep], self.end[keep])
        length = end - start + 1
        to = np.cumsum(length)
        at = to - length
        index = np.arange(to[-1] if len(to) else 0)
        index += np.repeat(start - at, length)
        data = np.append(self.data, np.uint8(0x20))[index]
        data[to - 1] = 0x20
        return data, at, to - 1


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` consecutive values."""
    least, width = values, 1
    while 2 * width <= size:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = size - width
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def pack(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Numpy arrays (or bytes) as one compressed binary value."""
    parts = [np.ascontiguousarray(a).tobytes() if isinstance(a, np.ndarray) else bytes(a) for a in arrays]
    body = np.array([len(parts), *map(len, parts)], dtype=np.int64).tobytes() + b"".join(parts)
    return len(body).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(body, asbytes=True)


def unpack(blob: bytes, *kinds) -> list:
    """The arrays of ``pack``, of the given dtypes (None for bytes)."""
    body = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    lengths = np.frombuffer(body, dtype=np.int64, count=len(kinds) + 1)[1:]
    found, at = [], 8 * (len(kinds) + 1)
    for length, kind in zip(lengths, kinds):
        part = body[at : at + length]
        found.append(part if kind is None else np.frombuffer(part, dtype=kind))
        at += length
    return found
