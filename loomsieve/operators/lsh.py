"""Banded locality-sensitive hashing over signatures, as equi-joins."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomsieve.functions.minhash import similarity
from loomsieve.session import stored

#: Rows of one band key that a task pairs at most with as many others.
CHUNK = 2000
#: Signatures up to this length travel with their bands.
SHORT = 32
#: Bands of probes that are broadcast at most, some 40 MB.
PROBED = 1_000_000


def check_bands(num_hashes: int, bands: int, rows: int) -> None:
    if bands * rows != num_hashes:
        raise ValueError(f"bands ({bands}) x rows ({rows}) must equal the signature size ({num_hashes})")


def resolve_bands(num_hashes: int, bands: int | None = None, rows: int | None = None) -> tuple[int, int]:
    """Rows default to 8, bands to num_hashes // rows."""
    rows = rows or 8
    bands = bands or num_hashes // rows
    check_bands(num_hashes, bands, rows)
    return bands, rows


def bands_of(df: DataFrame, bands: int, rows: int, sig: str = "sig") -> DataFrame:
    """One row a band: (the other columns, band, band_key). The key is a 64-bit hash of the slice;
    matches are verified on signatures, so a collision costs time only."""
    rest = [c for c in df.columns if c != sig]
    return df.select(*rest, F.posexplode(band_keys(F.col(sig), bands, rows)).alias("band", "band_key"))


def band_keys(sig: Column, bands: int, rows: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice(sig, i * rows + 1, rows)))


def band_text(df: DataFrame, bands: int, rows: int, sig: str = "sig") -> DataFrame:
    """Band keys as joined numbers, for inspection."""
    keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.array_join(F.slice(F.col(sig), i * rows + 1, rows).cast("array<string>"), "-"))
    rest = [c for c in df.columns if c != sig]
    return df.select(*rest, F.posexplode(keys).alias("band", "band_key"))


def candidate_pairs(signed: DataFrame, bands: int, rows: int, id_col: str = "row_id") -> DataFrame:
    """Distinct pairs (i < j) that share a band."""
    b = bands_of(signed.select(id_col, "sig"), bands, rows)
    left = b.select(F.col(id_col).alias("i"), "band", "band_key")
    right = b.select(F.col(id_col).alias("j"), "band", "band_key")
    return left.join(right, ["band", "band_key"]).where("i < j").select("i", "j").distinct()


def with_similarity(pairs: DataFrame, signed: DataFrame, id_col: str = "row_id", other: DataFrame | None = None) -> DataFrame:
    a = signed.select(F.col(id_col).alias("i"), F.col("sig").alias("sig_i"))
    b = (signed if other is None else other).select(F.col(id_col).alias("j"), F.col("sig").alias("sig_j"))
    return pairs.join(a, "i").join(b, "j").select("i", "j", similarity(F.col("sig_i"), F.col("sig_j")).alias("similarity"))


def edges(signed: DataFrame, bands: int, rows: int, threshold: float, id_col: str = "row_id") -> DataFrame:
    """Verified pairs (i < j, similarity at or over the threshold). Short signatures meet too many rows
    for pairs to be stored before they are verified; long ones are larger than the few pairs they make."""
    if bands * rows <= SHORT:
        return met(signed, bands, rows, threshold, id_col)
    return with_similarity(candidate_pairs(signed, bands, rows, id_col), signed, id_col).where(F.col("similarity") >= threshold)


def met(signed: DataFrame, bands: int, rows: int, threshold: float, id_col: str = "row_id") -> DataFrame:
    """``edges`` without any pair in a shuffle: signatures travel with their bands, so a pair is verified
    where it meets, in the first band it shares. Rows of a key that many share are dealt into chunks and
    each two chunks meet under a key of their own, so no task has a hot key's pairs alone."""
    b = bands_of(signed.select(F.col(id_col).alias("id"), "sig", F.col("sig").alias("s")), bands, rows, "s")
    hot = b.groupBy("band", "band_key").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    n = F.coalesce("chunks", F.lit(1))
    b = b.join(F.broadcast(hot), ["band", "band_key"], "left").select("band", "band_key", "id", "sig", F.pmod(F.xxhash64("id"), n).cast("int").alias("c"), F.explode(F.sequence(F.lit(0), n - 1)).alias("t"))
    key = ["band", "band_key", "p", "q"]
    b = b.select("band", "band_key", F.least("c", "t").alias("p"), F.greatest("c", "t").alias("q"), (F.col("c") > F.col("t")).cast("int").alias("side"), "id", "sig")
    parts = max(int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), b.sparkSession.sparkContext.defaultParallelism)
    least = next((k for k in range(bands * rows + 1) if k / (bands * rows) >= threshold), bands * rows + 1)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for tile in tiles(batches, bands * rows):
            for x in _verified(*tile, rows, least):
                made.append(x)
                if sum(len(m[0]) for m in made) >= 20_000:
                    yield from _out(made, bands * rows)
                    made = []
        yield from _out(made, bands * rows)

    kind = dict(signed.dtypes)[id_col]
    return b.repartition(parts, *key).sortWithinPartitions(*key).mapInArrow(pairs, f"i {kind}, j {kind}, similarity double")


def tiles(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray]]:
    """(band, whether all rows pair with all, sides, ids, signatures) of each tile of two rows or more, from
    sorted batches."""
    rest = None
    for batch in chain(batches, [None]):
        if batch is not None:
            if not batch.num_rows:
                continue
            new = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(6)] + [batch.column(6).flatten().to_numpy().reshape(-1, width)]
            now = new if rest is None else [np.concatenate(x) for x in zip(rest, new)]
        elif rest is None:
            return
        else:
            now = rest
        n = len(now[0])
        changed = np.zeros(n - 1, dtype=bool)
        for x in now[:4]:
            changed |= x[1:] != x[:-1]
        starts = np.concatenate(([0], np.flatnonzero(changed) + 1))
        ends = np.append(starts[1:], n)
        if batch is not None:
            rest, starts, ends = [x[starts[-1] :] for x in now], starts[:-1], ends[:-1]
        many = ends - starts > 1
        for a, z in zip(starts[many].tolist(), ends[many].tolist()):
            yield int(now[0][a]), now[2][a] == now[3][a], now[4][a:z], now[5][a:z], now[6][a:z]


def _verified(band: int, diagonal: bool, side: np.ndarray, ids: np.ndarray, sig: np.ndarray, rows: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, equal positions) of a tile's pairs that share this band and no earlier one."""
    left = np.flatnonzero(side == 0)
    right = left if diagonal else np.flatnonzero(side == 1)
    x, y = np.ascontiguousarray(sig[left].T), np.ascontiguousarray(sig[right].T)
    step = max(1, 400_000 // max(1, len(right)))
    for at in range(0, len(left), step):
        lo = at if diagonal else 0
        equal = np.zeros((min(step, len(left) - at), len(right) - lo), dtype=np.uint8)
        for a, b in zip(x, y):
            equal += a[at : at + step, None] == b[None, lo:]
        u, v = np.nonzero(equal >= least)
        score = equal[u, v]
        u, v = u + at, v + lo
        fits = u < v if diagonal else np.ones(len(u), dtype=bool)
        for k in range(band + 1):
            same = np.ones(len(u), dtype=bool)
            for p in range(k * rows, (k + 1) * rows):
                same &= x[p, u] == y[p, v]
            fits &= same if k == band else ~same
        i, j = ids[left[u[fits]]], ids[right[v[fits]]]
        yield np.minimum(i, j), np.maximum(i, j), score[fits]


def _out(made: list[tuple[np.ndarray, np.ndarray, np.ndarray]], width: int) -> Iterator[pa.RecordBatch]:
    if made:
        i, j, equal = (np.concatenate(x) for x in zip(*made))
        for at in range(0, len(i), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(i[at : at + 50_000]), pa.array(j[at : at + 50_000]), pa.array(equal[at : at + 50_000] / width)], names=["i", "j", "similarity"])


def match(probe: DataFrame, index: DataFrame, bands: int, rows: int, threshold: float, id_col: str = "row_id") -> DataFrame:
    """Probe without insertion: every indexed id at or over the threshold, as (i, j, similarity)."""
    p = bands_of(probe.select(F.col(id_col).alias("i"), "sig"), bands, rows)
    q = bands_of(index.select(F.col(id_col).alias("j"), "sig"), bands, rows)
    if probe.count() * bands <= PROBED:
        p = F.broadcast(p)
    pairs = stored(p.join(q, ["band", "band_key"]).select("i", "j").distinct(), "pairs")
    return with_similarity(pairs, probe, id_col, index).where(F.col("similarity") >= threshold)
