"""N-gram Jaccard join with prefix filters under several global token orders.

Two documents link when the Jaccard similarity of their sets of distinct k-word
shingles is at least ``percent`` / 100. The join is exact:

1. Shingles are counted over the whole corpus (32-bit keys in binary blobs, 4 bytes
   a shingle, summed by key range). Those in at least ``hot`` documents are ranked by
   count and broadcast; ``hot`` doubles until they fit ``MAX_HOT`` keys.
2. The first order puts cold shingles first (by hash), then hot ones from rare to
   common. Prefix tokens are the join key. Prefixes are extended so that sets that can
   link share a tenth of their tokens there, not just one; pairs with fewer shared
   tokens go. Equal sets travel as one class, so copies never meet each other. Size
   and position bounds prune pairs in the reducer. Hot tokens of neighbouring ranks, as
   those of one family are, share a reducer, which counts the pairs of large families by
   products of matrices; all pairs leave it in pieces, so its memory doesn't grow with
   their number.
3. Candidate sets are fetched once a class and routed by pairs of blocks (documents
   with one MinHash value, split so that a block stays small). There, pairs must
   also share prefix tokens under further orders; the rest is verified in full.
4. Links become weighted degrees (a class counts as many documents as it has) and a
   spanning forest, whose components come from alternating large and small stars.

Null and empty texts have an empty set: no links, their own component. Repeated rows
count as documents of their own. Rows of null doc_id are documents too: they link and are
counted, and component_id is the smallest doc_id that isn't null (null if there is none).
Ties don't arise. Two tokens of one set with equal 32-bit keys in one bucket count once,
so a pair of sets of very many tokens could miss a link with a chance of about one in 2^32
a pair of tokens. Columns besides ``doc_id`` and
``text`` are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import scan
from loomsieve.session import cut, discard, stored

U = np.uint64
MAX_HOT = 2_000_000
BLOCK = 256
#: Hot tokens of so many neighbouring ranks share a bucket; pairs and matrix cells that are handled at once.
BAND = 128
AT_ONCE = 250_000


@dataclass(frozen=True)
class JaccardConfig:
    k: int = 5
    percent: int = 80
    hot: int = 32
    orders: int = 3


def sets_of(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text. Fewer than k words: the whole sequence as one."""
    w = scan.Words(texts)
    h = w.hashes(fold_case=True)
    at, bounds = scan.windows(w.first, k)
    g = scan.gram_hashes(h, at, k)
    out = []
    for d in range(w.n):
        n = int(w.counts[d])
        if n >= k:
            out.append(np.unique(g[bounds[d] : bounds[d + 1]]))
        else:
            out.append(scan.gram_hashes(h, w.first[d : d + 1], n) if n else np.zeros(0, dtype=np.uint64))
    return out


def class_of(s: np.ndarray) -> int:
    """A 64-bit identity of a set (with its size beside it)."""
    a = int(np.add.reduce(scan.mix(s ^ U(0x5851F42D4C957F2D)))) ^ (len(s) * 0x2545F4914F6CDD1D)
    return int(np.array([scan.mix_int(a)], dtype=np.uint64).view(np.int64)[0])


def least_shared(n):
    """How many tokens the extended prefixes of two sets, the smaller of n tokens, must share."""
    return 1 + n // 10


def prefix_length(n, percent: int):
    """Sets of n tokens that can link share ``least_shared`` tokens within such prefixes."""
    return n - (percent * n + 99) // 100 + least_shared(n)


def order_keys(s: np.ndarray, order: int, hot_keys: np.ndarray, hot_rank: np.ndarray) -> np.ndarray:
    """Place of each token in one global order; the orders differ in how equal ranks are shuffled,
    and every second one puts hot tokens by hash only."""
    key = scan.mix(s ^ U(0x9E3779B97F4A7C15 * (order + 1) & (1 << 64) - 1)) >> U(1)
    if len(hot_keys):
        k32 = (s >> U(32)).astype(np.uint32)
        at = np.minimum(np.searchsorted(hot_keys, k32), len(hot_keys) - 1)
        hot = hot_keys[at] == k32
        rank = hot_rank[at].astype(np.uint64) if order % 2 == 0 else key >> U(34)
        key = np.where(hot, U(1 << 63) | (rank << U(31)) | (s & U(0x7FFFFFFF)), key)
    return key


def prefix(s: np.ndarray, order: int, hot_keys: np.ndarray, hot_rank: np.ndarray, percent: int) -> np.ndarray:
    p = prefix_length(len(s), percent)
    key = order_keys(s, order, hot_keys, hot_rank)
    at = np.argpartition(key, p - 1)[:p] if p < len(s) else np.arange(len(s))
    return s[at[np.argsort(key[at])]]


def slim(docs: DataFrame, cfg: JaccardConfig) -> DataFrame:
    """(doc_id, n_shingles, class) of every row."""

    def run(batches):
        for c in scan.chunks(batches):
            sets = sets_of(scan.column(c, "text"), cfg.k)
            yield pa.RecordBatch.from_arrays(
                [scan.column(c, "doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) for s in sets], pa.int64())],
                names=["doc_id", "n_shingles", "class"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, class long")


def fresh_sets(batches, k: int):
    """(class, set) of each set that this task hasn't seen yet."""
    seen: set[int] = set()
    for c in scan.chunks(batches):
        for s in sets_of(scan.column(c, "text"), k):
            if len(s):
                fp = class_of(s)
                if fp not in seen:
                    seen.add(fp)
                    yield fp, s


def hot_tokens(docs: DataFrame, cfg: JaccardConfig, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of shingles in at least ``cfg.hot`` sets, sorted, and their ranks by count."""

    def emit(batches):
        held: list[np.ndarray] = []
        size = 0

        def flush():
            keys = np.sort(np.concatenate(held))
            new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            counts = np.diff(np.append(new, len(keys)))
            keys = np.repeat(keys[new], np.minimum(counts, 4 * cfg.hot))
            cuts = np.searchsorted(keys, (np.arange(parts + 1, dtype=np.uint64) << U(32)) // U(parts))
            rows = [(b, keys[cuts[b] : cuts[b + 1]].tobytes()) for b in range(parts) if cuts[b] < cuts[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["bucket", "keys"])

        for _, s in fresh_sets(batches, cfg.k):
            held.append((s >> U(32)).astype(np.uint32))
            size += len(s)
            if size > 1_000_000:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    def count(table: pa.Table) -> pa.Table:
        keys = np.sort(np.concatenate([np.frombuffer(b, dtype=np.uint32) for b in table.column("keys").to_pylist()]))
        new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(new, len(keys)))
        on = counts >= cfg.hot
        return pa.table({"key": keys[new[on]].astype(np.int64), "n": counts[on].astype(np.int64)})

    blobs = docs.select("text").mapInArrow(emit, "bucket int, keys binary")
    hot = cut(blobs.groupBy("bucket").applyInArrow(count, "key long, n long"))
    least = cfg.hot
    while hot.where(F.col("n") >= least).count() > MAX_HOT:
        least *= 2
    got = hot.where(F.col("n") >= least).toArrow()
    keys, n = got.column("key").to_numpy().astype(np.uint32), got.column("n").to_numpy()
    rank = np.empty(len(keys), dtype=np.uint32)
    rank[np.lexsort((keys, n))] = np.arange(len(keys), dtype=np.uint32)
    by_key = np.argsort(keys)
    return keys[by_key], rank[by_key]


def meetings(tok: np.ndarray, cls: np.ndarray, n: np.ndarray, pos: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(a, b, least shared tokens, shared tokens here) of pairs of classes (a < b) in one bucket, in
    pieces of bounded size that may name a pair again: their sums count.

    Pairs are listed token by token; where the tokens of a family are shared by many of its sets, a
    product of matrices counts them for all tokens at once."""
    by = np.lexsort((cls, n, tok))
    tok, cls, n, pos = tok[by], cls[by], n[by].astype(np.int64), pos[by].astype(np.int64)
    own = np.ones(len(tok), dtype=bool)
    own[1:] = (tok[1:] != tok[:-1]) | (cls[1:] != cls[:-1])
    tok, cls, n, pos = tok[own], cls[own], n[own], pos[own]
    # classes by number, small sets first
    names, first, node = np.unique(cls, return_index=True, return_inverse=True)
    up = np.lexsort((names, n[first]))
    place = np.empty(len(up), dtype=np.int64)
    place[up] = np.arange(len(up))
    names, sizes, node = names[up], n[first][up], place[node]

    def named(i: np.ndarray, j: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, ...]:
        return np.minimum(names[i], names[j]), np.maximum(names[i], names[j]), least_shared(sizes[i]), times.astype(np.int64)

    _, token, crowd = np.unique(tok, return_inverse=True, return_counts=True)
    many = crowd[token] >= 2 * BLOCK
    if many.any():
        who, row = np.unique(node[many], return_inverse=True)
        what, col = np.unique(token[many], return_inverse=True)
        if len(who) ** 2 * len(what) < 500 * int((crowd[what] ** 2).sum()):
            far = np.searchsorted(sizes[who], sizes[who] * 100 // percent, "right")
            step = max(1, min(BLOCK, 8 * AT_ONCE // len(who)))
            wide = max(1, 64 * AT_ONCE // len(who))
            cells = np.argsort(col, kind="stable")
            for k in range(0, len(what), wide):
                some = cells[np.searchsorted(col[cells], k) : np.searchsorted(col[cells], k + wide)]
                held = np.zeros((len(who), min(wide, len(what) - k)), dtype=np.float32)
                held[row[some], col[some] - k] = 1
                for lo in range(0, len(who), step):
                    hi = min(lo + step, len(who))
                    both = held[lo:hi] @ held[lo : far[hi - 1]].T
                    both[np.arange(lo, far[hi - 1]) <= np.arange(lo, hi)[:, None]] = 0
                    both[np.arange(lo, far[hi - 1]) >= far[lo:hi, None]] = 0
                    i, j = np.nonzero(both)
                    for at in range(0, len(i), AT_ONCE):
                        x, y = i[at : at + AT_ONCE], j[at : at + AT_ONCE]
                        yield named(who[lo + x], who[lo + y], both[x, y])
            tok, node, n, pos = tok[~many], node[~many], n[~many], pos[~many]
    key = (tok.astype(np.int64) << 31) + n
    count = np.searchsorted(key, (tok.astype(np.int64) << 31) + n * 100 // percent, "right") - np.arange(len(tok)) - 1
    left = np.flatnonzero(count > 0)
    ends = np.cumsum(count[left])
    at = 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
        some = left[at:to]
        i = np.repeat(some, count[some])
        j = scan.ranges(some + 1, count[some])
        at = to
        best = np.minimum(pos[i], pos[j]) + np.minimum(n[i] - pos[i], n[j] - pos[j])
        ok = (100 + percent) * best >= percent * (n[i] + n[j])
        i, j = node[i[ok]], node[j[ok]]
        pairs, times = np.unique(np.minimum(i, j) * len(names) + np.maximum(i, j), return_counts=True)
        if len(pairs):
            yield named(pairs // len(names), pairs % len(names), times)


def candidates(docs: DataFrame, cfg: JaccardConfig, hot, parts: int) -> DataFrame:
    """Distinct pairs of classes (a < b) that share a prefix token of the first order."""
    dtype = [("tok", "<u4"), ("cls", "<i8"), ("n", "<u4"), ("pos", "<u4")]
    pct = cfg.percent

    def emit(batches):
        keys, rank = hot.value
        held: list[tuple[int, np.ndarray, int]] = []
        size = 0

        def flush():
            lens = np.array([len(p) for _, p, _ in held])
            s = np.concatenate([p for _, p, _ in held])
            k32 = (s >> U(32)).astype(np.uint32)
            bucket = (k32.astype(np.uint64) * U(parts) >> U(32)).astype(np.int64)
            if len(keys):
                at = np.minimum(np.searchsorted(keys, k32), len(keys) - 1)
                bucket = np.where(keys[at] == k32, parts + rank[at] // BAND, bucket)
            by = np.argsort(bucket, kind="stable")
            cols = [
                (s & U(0xFFFFFFFF)).astype("<u4")[by],
                np.repeat(np.array([c for c, _, _ in held], dtype="<i8"), lens)[by],
                np.repeat(np.array([n for _, _, n in held], dtype="<u4"), lens)[by],
                scan.ranges(np.zeros(len(lens), dtype=np.int64), lens).astype("<u4")[by],
            ]
            bucket = bucket[by]
            cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            blobs = [b"".join(c[lo:hi].tobytes() for c in cols) for lo, hi in zip(cuts, np.append(cuts[1:], len(bucket)))]
            return pa.RecordBatch.from_arrays([pa.array(bucket[cuts], pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "rows"])

        for fp, s in fresh_sets(batches, cfg.k):
            p = prefix(s, 0, keys, rank, pct)
            held.append((fp, p, len(s)))
            size += len(p)
            if size > 1_000_000:
                yield flush()
                held.clear()
                size = 0
        if held:
            yield flush()

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list[np.ndarray]] = [[], [], [], []]
        for raw in (r for t in batches for r in scan.column(t, "rows").to_pylist()):
            m, at = len(raw) // 20, 0
            for c, (_, kind) in zip(cols, dtype):
                width = np.dtype(kind).itemsize
                c.append(np.frombuffer(raw, dtype=kind, count=m, offset=at))
                at += m * width
        for a, b, need, times in meetings(*(np.concatenate(c) for c in cols), pct):
            yield pa.RecordBatch.from_pydict({"a": a, "b": b, "need": need, "times": times})

    blobs = docs.select("text").mapInArrow(emit, "bucket int, rows binary")
    met = blobs.groupBy("bucket").applyInArrow(pair, "a long, b long, need long, times long")
    shared = met.groupBy("a", "b").agg(F.min("need").alias("need"), F.sum("times").alias("times"))
    return shared.where("times >= need").select("a", "b")


def candidate_sets(docs: DataFrame, cfg: JaccardConfig, wanted) -> DataFrame:
    """(class, minhash, tokens) of sets among the wanted classes, once a task."""

    def run(batches):
        rows = []
        size = 0
        make = lambda: pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.binary()))], names=["class", "block", "tokens"])
        for fp, s in fresh_sets(batches, cfg.k):
            if fp not in wanted.value:
                continue
            rows.append((fp, int(s[:1].view(np.int64)[0]), s.tobytes()))
            size += len(s)
            if size > 500_000:
                yield make()
                rows.clear()
                size = 0
        if rows:
            yield make()

    return docs.select("text").mapInArrow(run, "class long, block long, tokens binary")


class Wanted:
    """Membership in a bit map: never false for a member."""

    def __init__(self, bits: np.ndarray, size: int) -> None:
        self.bits, self.size = bits, size

    def __contains__(self, x: int) -> bool:
        i = scan.mix_int(x) % self.size
        return bool(self.bits[i >> 3] >> (i & 7) & 1)

    def holds(self, x: np.ndarray) -> np.ndarray:
        i = (scan.mix(x.view(np.uint64)) % U(self.size)).astype(np.int64)
        return (self.bits[i >> 3] >> (i & 7).astype(np.uint8) & 1) > 0


def bit_maps(batches, size: int, wide: int) -> Iterator[pa.RecordBatch]:
    """(slot, map): the stretches of ``wide`` bits, of ``size`` in all, in which classes of the pairs fall."""
    bits = np.zeros(size // 8, dtype=np.uint8)
    for b in batches:
        for c in ("a", "b"):
            at = (np.unique(scan.mix(scan.column(b, c).to_numpy().view(np.uint64))) % U(size)).astype(np.int64)
            np.bitwise_or.at(bits, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
    maps = bits.reshape(-1, wide // 8)
    for i in np.flatnonzero(maps.any(axis=1)):
        yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([maps[i].tobytes()], pa.binary())], names=["slot", "map"])


def wanted_bits(pairs: DataFrame) -> Wanted:
    """A bit map over the classes of all pairs, 32 bits a pair and 32 MB at most. It only spares traffic:
    rows that pass by chance are dropped by the join that follows."""
    size = 1 << min(28, max(20, (32 * pairs.count()).bit_length()))
    wide = 1 << 18

    def merge(table: pa.Table) -> pa.Table:
        m = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in table.column("map").to_pylist()])
        return pa.table({"slot": table.column("slot")[:1], "map": pa.array([m.tobytes()], pa.binary())})

    out = np.zeros(size // 8, dtype=np.uint8)
    for slot, packed in pairs.mapInArrow(lambda batches: bit_maps(batches, size, wide), "slot int, map binary").groupBy("slot").applyInArrow(merge, "slot int, map binary").collect():
        out[slot * wide // 8 : (slot + 1) * wide // 8] = np.frombuffer(packed, dtype=np.uint8)
    return Wanted(out, size)


def verify_group(ids: np.ndarray, sets: list[np.ndarray], weight: np.ndarray, a: np.ndarray, b: np.ndarray, cfg: JaccardConfig, hot) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Linked pairs (indices), after the further orders' prefixes and in full."""
    by = np.argsort(a, kind="stable")
    a, b = a[by], b[by]
    keys, rank = hot
    pre = [[np.sort(prefix(s, o, keys, rank, cfg.percent)) for s in sets] for o in range(1, cfg.orders)]
    cuts = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.zeros(0, int)
    la, lb = [], []

    def shared(x: np.ndarray, ys: list[np.ndarray]) -> np.ndarray:
        flat = np.concatenate(ys)
        hit = x[np.minimum(np.searchsorted(x, flat), len(x) - 1)] == flat
        return np.add.reduceat(hit, np.cumsum([0, *[len(y) for y in ys[:-1]]]), dtype=np.int64)

    for lo, hi in zip(cuts, np.append(cuts[1:], len(a))):
        for part in range(lo, hi, BLOCK):
            i, js = a[part], b[part : min(part + BLOCK, hi)]
            for p in pre:
                if len(js):
                    need = np.array([least_shared(min(len(sets[i]), len(sets[j]))) for j in js])
                    js = js[shared(p[i], [p[j] for j in js]) >= need]
            if len(js):
                both = shared(sets[i], [sets[j] for j in js])
                sizes = np.array([len(sets[j]) for j in js])
                js = js[100 * both >= cfg.percent * (len(sets[i]) + sizes - both)]
                la.append(np.full(len(js), i))
                lb.append(js)
    x = np.concatenate(la) if la else np.zeros(0, dtype=np.int64)
    y = np.concatenate(lb) if lb else np.zeros(0, dtype=np.int64)
    degree = np.bincount(x, weights=weight[y], minlength=len(ids)) + np.bincount(y, weights=weight[x], minlength=len(ids))
    return x, y, degree.astype(np.int64)


def forest(n: int, x: np.ndarray, y: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the pairs, by union-find."""
    root = list(range(n))
    keep: tuple[list[int], list[int]] = ([], [])
    for i, j in zip(x.tolist(), y.tolist()):
        p, q = i, j
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        while root[q] != q:
            root[q] = root[root[q]]
            q = root[q]
        if p != q:
            root[max(p, q)] = min(p, q)
            keep[0].append(i)
            keep[1].append(j)
    return keep


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component, by alternating large and small stars."""
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    while True:
        sym = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        last, e = e, stored(small.where("u <> v").distinct(), "edges")
        discard(last)
        now = tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).collect()[0])
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
        before = now


@dataclass
class Joined:
    rows: DataFrame  # doc_id, n_shingles, class
    classes: DataFrame  # class, n_shingles, doc_id (smallest), n_docs, degree, component_id


def jaccard_join(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> Joined:
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = cut(slim(docs, cfg))
    classes = cut(rows.where("n_shingles > 0").groupBy("class", "n_shingles").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_docs")))
    keys, rank = hot_tokens(docs, cfg, parts)
    hot = spark.sparkContext.broadcast((keys, rank))
    pairs = cut(candidates(docs, cfg, hot, parts))
    wanted = spark.sparkContext.broadcast(wanted_bits(pairs))
    in_pairs = pairs.select(F.col("a").alias("class")).union(pairs.select(F.col("b").alias("class"))).distinct()
    sets = candidate_sets(docs, cfg, wanted).groupBy("class").agg(F.first("block").alias("block"), F.first("tokens").alias("tokens"))
    sets = cut(sets.join(in_pairs, "class", "left_semi").join(classes.select("class", "n_docs"), "class"))
    full = sets.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("splits"))
    block = sets.select("class", "block").join(full, "block").select("class", F.xxhash64("block", F.pmod("class", "splits")).alias("block"))
    located = pairs.join(block.select(F.col("class").alias("a"), F.col("block").alias("ba")), "a").join(block.select(F.col("class").alias("b"), F.col("block").alias("bb")), "b")
    routes = 2 * parts
    routed = cut(located.select("a", "b", F.pmod(F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")), F.lit(routes)).alias("route")))
    needed = routed.select("route", F.explode(F.array("a", "b")).alias("class")).distinct().join(sets.drop("block"), "class")

    def verify(left: pa.Table, right: pa.Table) -> pa.Table:
        ids = left.column("class").to_numpy()
        by = np.argsort(ids)
        ids = ids[by]
        raw = left.column("tokens").to_pylist()
        sets_ = [np.frombuffer(raw[i], dtype=np.uint64) for i in by]
        weight = left.column("n_docs").to_numpy()[by]
        a = np.searchsorted(ids, right.column("a").to_numpy())
        b = np.searchsorted(ids, right.column("b").to_numpy())
        x, y, degree = verify_group(ids, sets_, weight, a, b, cfg, hot.value)
        fa, fb = forest(len(ids), x, y)
        on = np.flatnonzero(degree)
        return pa.table(
            {
                "a": np.concatenate([ids[fa], ids[on]]).astype(np.int64),
                "b": np.concatenate([ids[fb], degree[on]]).astype(np.int64),
                "edge": np.concatenate([np.ones(len(fa), bool), np.zeros(len(on), bool)]),
            }
        )

    found = cut(needed.groupBy("route").cogroup(routed.select("a", "b", F.col("route").alias("at")).groupBy("at")).applyInArrow(verify, "a long, b long, edge boolean"))
    degree = found.where("not edge").groupBy(F.col("a").alias("class")).agg(F.sum("b").alias("degree"))
    labels = components(found.where("edge").select("a", "b")).withColumnRenamed("node", "class")
    every = labels.union(labels.select("label", "label").distinct()).join(classes.select("class", "doc_id"), "class")
    least = every.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    labelled = every.select("class", "label").join(least, "label").select("class", F.lit(True).alias("linked"), "component_id")
    out = classes.join(degree, "class", "left").join(labelled, "class", "left")
    out = out.select("class", "n_shingles", "doc_id", "n_docs", F.coalesce("degree", F.lit(0)).alias("degree"), F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return Joined(rows, out)


def near_duplicates(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """doc_id, n_shingles, n_similar (documents linked directly), component_id (smallest linked doc_id)."""
    j = jaccard_join(docs, cfg)
    c = j.classes.select("class", "n_shingles", (F.col("degree") + F.col("n_docs") - 1).alias("n_similar"), "component_id")
    out = j.rows.where("n_shingles > 0").join(c, ["class", "n_shingles"]).select("doc_id", "n_shingles", "n_similar", "component_id")
    return out.union(j.rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.lit(0).cast("long"), "doc_id"))


def representatives(docs: DataFrame, cfg: JaccardConfig = JaccardConfig()) -> DataFrame:
    """The rows of one document of each linked group (its smallest doc_id), all unlinked ones, and those
    without doc_id, which can't be named."""
    near = near_duplicates(docs.select("doc_id", "text"), cfg)
    kept = near.where("doc_id = component_id").select("doc_id").distinct()
    return docs.where("doc_id is not null").join(kept, "doc_id", "left_semi").select(*docs.columns).union(docs.where("doc_id is null"))
