"""Reproducible shuffle by a Feistel permutation of global row numbers.

Rows are numbered in the order of (doc_id, digest, size), so the numbering doesn't
depend on files or partitions. A balanced Feistel network permutes the smallest even
number of bits that holds all numbers; cycle walking repeats it until the result is
a row number again. Shard and slot follow by arithmetic (law ``rows``: shard counts
differ by one at most) and can be computed, or inverted, for any number alone.

Null texts have size 8 and the digest of nothing; repeated rows get numbers of their
own (they are interchangeable); an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import scan
from loomsieve.session import cut

U = np.uint64


@dataclass(frozen=True)
class Permutation:
    n: int
    seed: int = 20240501
    rounds: int = 6

    @property
    def half(self) -> int:
        """Bits of each half of the network."""
        return max(1, ((max(self.n, 2) - 1).bit_length() + 1) // 2)

    def keys(self) -> list[int]:
        return [scan.mix_int(self.seed + 0x9E3779B97F4A7C15 * (r + 1)) for r in range(self.rounds)]

    def _network(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        h, mask = U(self.half), U((1 << self.half) - 1)
        left, right = x >> h, x & mask
        for key in reversed(self.keys()) if inverse else self.keys():
            if inverse:
                left, right = right ^ (scan.mix(left ^ U(key)) & mask), left
            else:
                left, right = right, left ^ (scan.mix(right ^ U(key)) & mask)
        return (left << h) | right

    def _walk(self, x: np.ndarray, inverse: bool) -> np.ndarray:
        out = self._network(np.asarray(x, dtype=np.uint64), inverse)
        while (far := out >= U(self.n)).any():
            out[far] = self._network(out[far], inverse)
        return out.astype(np.int64)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def inverse(self, y: np.ndarray) -> np.ndarray:
        return self._walk(y, True)


def numbered(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """Adds ``row_number`` from 0 in the given order; also the row count. The sorted slim rows are
    kept in the shared folder; one offset a partition goes through the driver."""
    rows = cut(df.orderBy(*order))
    place = rows.withColumn("__m", F.monotonically_increasing_id())
    part = F.shiftright("__m", 33)
    counts = {r.p: r.n for r in place.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    base, total = {}, 0
    for p in sorted(counts):
        base[p] = total
        total += counts[p]
    offsets = df.sparkSession.createDataFrame(list(base.items()) or [(0, 0)], "p long, base long")
    out = place.withColumn("p", part).join(F.broadcast(offsets), "p")
    return out.select(*df.columns, (F.col("base") + F.col("__m").bitwiseAND((1 << 33) - 1)).alias("row_number")), total


def shard(docs: DataFrame, shards: int = 24, seed: int = 20240501) -> DataFrame:
    text = F.coalesce("text", F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows, n = numbered(slim, ["doc_id", "text_crc32", "size"])
    perm = Permutation(n, seed)

    def run(batches):
        for b in batches:
            to = perm(scan.column(b, "row_number").to_numpy()) if b.num_rows else np.zeros(0, np.int64)
            extra = [pa.array(to), pa.array((to % shards).astype(np.int32)), pa.array(to // shards)]
            yield pa.RecordBatch.from_arrays([*[scan.column(b, c) for c in ("doc_id", "size", "text_crc32", "row_number")], *extra], names=["doc_id", "size", "text_crc32", "row_number", "shuffled", "shard", "slot"])

    out = rows.mapInArrow(run, "doc_id long, size long, text_crc32 long, row_number long, shuffled long, shard int, slot long")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
