"""MinHash signatures: one Arrow-batched kernel, then plain Column arithmetic."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRIME = (1 << 31) - 1
FOLD = 1_000_003
TILE = 256
#: Texts that are Python objects at once; characters up to which words are folded together.
SLICE, LONG = 64, 48


@lru_cache
def coefficients(n: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (a, b) of a linear congruential generator."""
    out, state = [], seed
    for _ in range(2 * n):
        state = (state * 1_103_515_245 + 12_345) % (1 << 64)
        out.append(state % PRIME)
    pairs = np.array(out, dtype=np.int64).reshape(n, 2)
    return pairs[:, 0].copy(), pairs[:, 1].copy()


def _mod(x: np.ndarray) -> np.ndarray:
    """x mod 2^31-1 for 0 <= x < 2^62, without division."""
    x = (x & PRIME) + (x >> 31)
    x = (x & PRIME) + (x >> 31)
    return np.where(x >= PRIME, x - PRIME, x)


def _fold(points: np.ndarray) -> int:
    h = 0
    for c in points.tolist():
        h = (h * FOLD + c) % PRIME
    return h


def char_shingles(text: str, n: int) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    k = min(n, len(points))
    h = np.zeros(len(points) - k + 1, dtype=np.int64)
    for i in range(k):
        h = _mod(h * FOLD + points[i : len(points) - k + 1 + i])
    return np.unique(h)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def word_folds(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fold of each token and FOLD to the power of its length, for all tokens at once by their k-th characters."""
    points = _points(" ".join(tokens))
    ends = np.append(np.flatnonzero(points == 32), len(points))
    starts = np.append(0, ends[:-1] + 1)
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    starts, left = starts[order], len(order) - np.cumsum(np.bincount(size))
    h, power = np.zeros(len(order), dtype=np.int64), np.ones(len(order), dtype=np.int64)
    for k, n in enumerate(left[:LONG].tolist()):
        h[:n] = _mod(h[:n] * FOLD + points[starts[:n] + k])
        power[:n] = _mod(power[:n] * FOLD)
    for i in range(left[LONG] if len(left) > LONG else 0):
        word = points[starts[i] : starts[i] + size[order[i]]]
        h[i], power[i] = _fold(word), pow(FOLD, len(word), PRIME)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    return h[back], power[back]


def word_shingles(texts: list[str | None], n: int) -> list[np.ndarray]:
    """Of each text, folds of n words joined by spaces: folds of single words are concatenated."""
    each = [t.split() if t else [] for t in texts]
    tokens = [w for x in each for w in x]
    m = len(tokens) - n + 1
    h = np.empty(0, dtype=np.int64)
    if m > 0:
        fold, power = word_folds(tokens)
        h = fold[:m]
        for i in range(1, n):
            h = _mod(_mod(_mod(h * FOLD + 32) * power[i : i + m]) + fold[i : i + m])
    out, at = [], 0
    for text, x in zip(texts, each):
        if len(x) < n:
            out.append(np.array([_fold(_points(text or ""))], dtype=np.int64))
        else:
            own = np.sort(h[at : at + len(x) - n + 1])
            out.append(own[np.append(True, own[1:] != own[:-1])])
        at += len(x)
    return out


def signature_of(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minima of (a x + b) mod PRIME. One folding leaves a value under 2^32, which is the residue or once
    or twice PRIME more; taking PRIME off a residue wraps around to a larger number."""
    best = np.full(len(a), PRIME, dtype=np.uint32)
    for at in range(0, len(hashes), TILE):
        x = np.multiply(a[:, None], hashes[None, at : at + TILE])
        x += b[:, None]
        high = x >> 31
        x &= PRIME
        x += high
        low = x.astype(np.uint32)
        np.minimum(best, low.min(axis=1), out=best)
        for _ in range(2):
            low -= np.uint32(PRIME)
            np.minimum(best, low.min(axis=1), out=best)
    return best


def signature(c: Column, num_hashes: int = 128, shingle: int = 3, by_word: bool = False) -> Column:
    """array<int> of ``num_hashes`` minima. Null stays null; an empty text gives zeros. A worker has a few
    texts of a batch as Python objects at a time."""

    @F.arrow_udf(T.ArrayType(T.IntegerType(), False))
    def sign(texts: pa.Array) -> pa.Array:
        a, b = coefficients(num_hashes)
        out = np.zeros((len(texts), num_hashes), dtype=np.int32)
        for at in range(0, len(texts), SLICE):
            some = texts.slice(at, SLICE).to_pylist()
            made = word_shingles(some, shingle) if by_word else (char_shingles(t, shingle) if t else None for t in some)
            for k, (text, hashes) in enumerate(zip(some, made), at):
                if text:
                    out[k] = signature_of(hashes, a, b)
        offsets = pa.array(np.arange(0, (len(texts) + 1) * num_hashes, num_hashes, dtype=np.int32))
        made = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
        return pc.if_else(texts.is_valid(), made, pa.scalar(None, made.type)) if texts.null_count else made

    return sign(c)


def similarity(x: Column, y: Column) -> Column:
    """Share of equal positions; 0 where the lengths differ."""
    equal = F.aggregate(F.zip_with(x, y, lambda p, q: (p == q).cast("int")), F.lit(0), lambda s, v: s + v)
    return F.when(F.size(x) == F.size(y), equal / F.greatest(F.size(x), F.lit(1))).otherwise(F.lit(0.0))


def text_similarity(x: Column, y: Column, num_hashes: int = 128, shingle: int = 3, by_word: bool = False) -> Column:
    return similarity(signature(x, num_hashes, shingle, by_word), signature(y, num_hashes, shingle, by_word))


def candidate_probability(s: float, bands: int, rows: int) -> float:
    """Chance that two texts of similarity s share at least one band."""
    return 1 - (1 - s**rows) ** bands
