"""Words of many texts at once, as numpy arrays over one UTF-8 buffer.

All word classes used here are classes of bytes (a multi-byte character is wholly in
or wholly out), so a batch of texts is cut into words, hashed and shingled without
making one Python object a word. Hashes have 64 bits; two different words, shingles
or sets of one corpus collide with probability about n^2 / 2^65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
#: Bytes of text that are processed at once; one longer text is a chunk of its own.
CHUNK = 1 << 20

_rng = np.random.default_rng(20240501)
TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
FOLDED = TABLE[LOWER]

NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F], given lower case; upper case counts as lower
ALNUM = np.zeros(256, dtype=bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) mod 2^64."""
    got = _powers.get(base)
    if got is None or len(got) < n:
        got = np.empty(max(n, CHUNK + 1), dtype=np.uint64)
        got[0] = 1
        got[1:] = U(base)
        np.multiply.accumulate(got, out=got)
        _powers[base] = got
    return got


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits (splitmix64's end)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (1 << 64) - 1], dtype=np.uint64))[0])


class Words:
    """The words of a chunk of texts. ``off``: byte bounds of the texts; ``first``: word bounds."""

    def __init__(self, texts: pa.Array, kind: np.ndarray = NOT_SPACE) -> None:
        self.data, self.off = buffer_of(texts)
        self.n = len(texts)
        on = kind[self.data]
        edge = np.zeros(len(on) + 1, dtype=bool)
        edge[self.off] = True
        before = np.empty(len(on), dtype=bool)
        before[:1] = False
        before[1:] = on[:-1]
        self.start = np.flatnonzero(on & (~before | edge[:-1]))
        after = np.empty(len(on), dtype=bool)
        after[-1:] = False
        after[:-1] = on[1:]
        self.end = np.flatnonzero(on & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.counts = np.diff(self.first)

    def hashes(self, fold_case: bool = False) -> np.ndarray:
        return span_hashes(self.data, self.start, self.end, FOLDED if fold_case else TABLE)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = TABLE) -> np.ndarray:
    """Hash of each byte span, by differences of one running polynomial."""
    run = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(table[data], powers(BASE, len(data))[: len(data)], out=run[1:])
    np.cumsum(run, out=run)
    return mix((run[end] - run[start]) * powers(INVERSE, len(data) + 1)[start])


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and bounds; null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None and off[-1] > off[0] else np.zeros(0, dtype=np.uint8)
    return raw, off - off[0]


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``most`` bytes of text, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = buffer_of(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


def windows(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index of each k-word window that lies within one text, and bounds by text."""
    n = np.diff(first)
    w = np.maximum(n - k + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(w)])
    return np.repeat(first[:-1] - bounds[:-1], w) + np.arange(bounds[-1]), bounds


def gram_hashes(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place; windows of other lengths hash apart."""
    g = h[at] + U(k)
    for i in range(1, k):
        g = g * U(0xD6E8FEB86659FD93) + h[at + i]
    return mix(g)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The concatenation of start .. start + count - 1."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(total)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def column(batch: pa.RecordBatch | pa.Table, name: str):
    return batch.column(batch.schema.get_field_index(name))


def blob(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
