"""Substring dedup by collinear chaining of shared k-mer seeds.

1. Every text gives two kinds of seeds. Short ones are the k-word grams whose hash says
   so (one in ``every``): whether a gram is taken depends on the gram alone, so it is
   taken in every text that holds it, however edited its surroundings are. Long ones are
   window minimizers over ``long``-word grams: any ``least`` equal words yield one. Runs
   of one or a few repeated words also give every gram of ``least`` words in them.
2. Seeds are grouped by key range in binary blobs. Within a seed, each document meets
   only the owner (the smallest doc_id of the corpus that holds it), never all others, so
   a passage in n documents costs n - 1 matches. Each place of a repeated seed meets each
   place in the owner; within evenly spaced repeats, the ends and the places in turn. A
   seed of ``crowd`` documents in one map task is hot: the task sends only its smallest
   document to the seed's reducer, the others meet the owner in a join, which adaptive
   execution splits.
   Two documents can share a passage of whose seeds smaller documents, which share less,
   are the owners. So long seeds of three documents or more are looked up once more: all
   grams of ``least`` words that hold one get owners of their own, who then hold the whole
   gram. Whoever repeats ``least`` words exactly thus meets a document that holds them.
3. Matches of one (document, owner) are merged along diagonals and chained: the best
   chain ending at a segment adds its length to the best earlier chain that ends at most
   ``reach`` words before it in both texts, less a gap cost linear in the distance, found
   by Fenwick trees of maxima.
4. Chains are aligned. Both texts' word codes are cut to the chain and its surroundings
   (by the JVM, after a join on doc_id), segments are extended exactly, gaps and, where
   that isn't enough, surroundings are aligned by edit distance, and passages of at least
   ``least`` words with identity over ``identity`` are kept. A chain that falls below it,
   or holds two passages with own words between, is cut into its best parts. Places are
   word numbers in both texts; word codes have 32 bits. Passages within another one of
   the same two documents go.

All texts count in full and there is no cap on seeds or partners; the result doesn't
depend on how the input is split. Every run of ``least`` words that a smaller document
holds is found. An edited passage without such a run is found through its seeds' owners
only: where every seed of it also stands in smaller documents that share less than a
passage, it is missed (the README has figures). A document of which several rows exist (repeated
doc_id) is one document; its rows are taken as one text each and the places refer to the
row's text. Rows without doc_id can't be named: they are neither compared nor cut. Null
and empty texts have no seeds. Ties go to the smaller doc_id and the earlier place.
Columns but doc_id and text don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import jaccard, scan
from loomsieve.session import stored

U = np.uint64


@dataclass(frozen=True)
class PassageConfig:
    k: int = 5
    every: int = 3
    long: int = 30
    least: int = 50
    identity: float = 0.8
    gap: float = 0.25
    reach: int = 60
    flank: int = 60
    window: int = 12
    crowd: int = 64


def long_grams(h: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each place, by differences of one running polynomial."""
    run = np.zeros(len(h) + 1, dtype=np.uint64)
    np.cumsum(h * scan.powers(scan.BASE, len(h))[: len(h)], out=run[1:])
    return scan.mix((run[at + k] - run[at]) * scan.powers(scan.INVERSE, len(h) + 1)[at])


def long_seeds(h: np.ndarray, first: np.ndarray, cfg: PassageConfig) -> tuple[np.ndarray, ...]:
    """(hash and word index of every long gram, bounds by text, indices of the minimizers)."""
    at, bounds = scan.windows(first, cfg.long)
    whole = long_grams(h, at, cfg.long)
    return whole, at, bounds, minimizers(whole, bounds, cfg.least - cfg.long + 1)


def minimizers(g: np.ndarray, bounds: np.ndarray, window: int) -> np.ndarray:
    """Indices of the smallest gram of each window of grams within a text; the leftmost of equal ones.
    Texts with fewer grams than a window give their smallest gram."""
    if not len(g):
        return np.zeros(0, dtype=np.int64)
    n = np.diff(bounds)
    best = np.arange(len(g))
    text = np.repeat(np.arange(len(n)), n)
    last = bounds[text + 1]
    width = 1
    while width < window:  # doubling: best of [i, i + width)
        step = min(width, window - width)
        j = np.minimum(np.arange(len(g)) + step, last - 1)
        other = best[j]
        best = np.where(g[other] < g[best], other, best)
        width += step
    starts = np.maximum(n - window + 1, np.minimum(n, 1))
    return np.unique(best[scan.ranges(bounds[:-1], starts)])


def seeds(h: np.ndarray, first: np.ndarray, cfg: PassageConfig) -> tuple[np.ndarray, np.ndarray]:
    """(word index, seed) of texts that can hold a passage; the seed's lowest bit tells the long ones."""
    enough = np.diff(first) >= cfg.identity * cfg.least
    at, _ = scan.windows(first, cfg.k)
    g = scan.gram_hashes(h, at, cfg.k)
    on = (g >> U(1)) % U(cfg.every) == 0
    at, g = at[on], g[on] & ~U(1)
    rest = cfg.least - cfg.long
    whole, all_, bounds, far = long_seeds(h, first, cfg)
    # within runs of one or a few words, where shorter runs elsewhere own all other seeds: every passage
    over = bounds[np.searchsorted(bounds, np.arange(len(whole)), "right")] - rest
    again = np.zeros(len(whole), dtype=bool)
    for q in range(1, rest + 1):
        again[:-q] |= whole[q:] == whole[:-q]
    i = np.flatnonzero(again & (np.arange(len(whole)) < over))
    run = scan.mix(whole[i] ^ scan.mix(whole[i + rest]))
    at, g = np.concatenate([at, all_[far], all_[i]]), np.concatenate([g, whole[far] | U(1), run | U(1)])
    on = enough[np.searchsorted(first, at, "right") - 1]
    return at[on], g[on]


def star(g: np.ndarray, d: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (index of a place in another document, index of a place in the owner) of seed occurrences
    sorted by (seed, document, place).

    Every occurrence meets every place of the owner, except within evenly spaced repeats (runs of one
    word, repeated lines): there only the ends meet all ends, and all meet the owner's places in turn,
    from the first again after the last."""
    if not len(g):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.concatenate([[True], g[1:] != g[:-1]])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1]
    own = new | np.concatenate([[True], d[1:] != d[:-1]])
    group = np.flatnonzero(own)
    rank = np.arange(len(g)) - group[np.cumsum(own) - 1]
    times = np.diff(np.append(group, len(g)))[np.searchsorted(group, lead)]
    first = d == d[lead]
    wide = p.astype(np.int64)
    step = np.diff(wide, prepend=wide[:1])
    inner = np.zeros(len(g), dtype=bool)
    inner[1:-1] = ~own[1:-1] & ~own[2:] & (step[1:-1] == step[2:])
    on = np.flatnonzero(~first)
    x, y = on, lead[on] + rank[on] % times[on]
    # the rest of the pairs: ends of this document with ends of the owner
    ends = np.flatnonzero(first & ~inner)
    some = np.flatnonzero(~first & ~inner & (times > 1))
    lo, hi = np.searchsorted(ends, lead[some]), np.searchsorted(ends, lead[some] + times[some])
    x2, y2 = np.repeat(some, hi - lo), ends[scan.ranges(lo, hi - lo)]
    more = y2 != lead[x2] + rank[x2] % times[x2]
    return np.concatenate([x, x2[more]]), np.concatenate([y, y2[more]])


def met(g: np.ndarray, x: np.ndarray, y: np.ndarray, cfg: PassageConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(match, x, y) of short grams; a long one counts as its first and last short ones."""
    far = np.flatnonzero(g & U(1))
    step = cfg.long - cfg.k
    return np.concatenate([np.arange(len(g)), far]), np.concatenate([x, x[far] + step]), np.concatenate([y, y[far] + step])


def whole_grams(h: np.ndarray, first: np.ndarray, wanted, cfg: PassageConfig) -> tuple[np.ndarray, np.ndarray]:
    """(word index, hash) of all grams of ``least`` words that hold a wanted long seed."""
    whole, at, _, far = long_seeds(h, first, cfg)
    i = at[far[wanted.holds(scan.signed(whole[far] | U(1)))]]
    text = np.searchsorted(first, i, "right") - 1
    lo, hi = np.maximum(first[text], i - (cfg.least - cfg.long)), np.minimum(i, first[text + 1] - cfg.least)
    on = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(on, lo[lo <= hi], 1)
    np.add.at(on, hi[lo <= hi] + 1, -1)
    start = np.flatnonzero(np.cumsum(on) > 0)
    return start, long_grams(h, start, cfg.least)


def bounds_of(*cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of runs of equal rows of sorted columns."""
    n = len(cols[0])
    new = np.zeros(n, dtype=bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    cuts = np.flatnonzero(new)
    return cuts, np.append(cuts[1:], n) if n else cuts


def seed_matches(docs: DataFrame, cfg: PassageConfig, parts: int) -> DataFrame:
    """(doc, owner, xs, ys): places of shared short grams, one row a document, owner and key range."""

    def flushes(batches):
        """Sorted occurrences (g, d, p) of bounded numbers of texts, which of them belong to hot seeds,
        and which of those aren't the smallest document's."""
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def sorted_():
            g, d, p = (np.concatenate([h[i] for h in held]) for i in range(3))
            by = np.lexsort((p, d, g))
            g, d, p = g[by], d[by], p[by]
            cuts, ends = bounds_of(g)
            docs_ = np.add.reduceat(np.concatenate([[True], (g[1:] != g[:-1]) | (d[1:] != d[:-1])]), cuts, dtype=np.int64)
            hot = np.repeat(docs_ >= cfg.crowd, ends - cuts)
            return g, d, p, hot, hot & (d != np.repeat(d[cuts], ends - cuts))

        for c in scan.chunks(batches):
            w = scan.Words(scan.column(c, "text"))
            at, g = seeds(w.hashes(fold_case=True), w.first, cfg)
            d = np.searchsorted(w.first, at, "right") - 1
            held.append((g, scan.column(c, "doc_id").to_numpy()[d], at - w.first[d]))
            size += len(g)
            if size > 1_000_000:
                yield sorted_()
                held.clear()
                size = 0
        if size:
            yield sorted_()

    def emit(batches):
        for g, d, p, hot, later in flushes(batches):
            rows = []
            crowded = np.unique(g[hot])
            for kind, cols in ((0, (g[~later].astype("<u8"), d[~later].astype("<i8"), p[~later].astype("<u4"))), (1, (crowded.astype("<u8"),))):
                cuts = np.searchsorted((cols[0] >> U(32)) * U(parts) >> U(32), np.arange(parts + 1, dtype=np.uint64))
                rows += [(b, kind, b"".join(c[cuts[b] : cuts[b + 1]].tobytes() for c in cols)) for b in range(parts) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary()))], names=["bucket", "kind", "rows"])

    def emit_later(batches):
        for g, d, p, _, later in flushes(batches):
            g, d, p = g[later], d[later], p[later].astype("<u4")
            cuts, ends = bounds_of(g, d)
            for lo in range(0, len(cuts), 100_000):
                a, b = cuts[lo : lo + 100_000], ends[lo : lo + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(scan.signed(g[a])), pa.array(d[a]), pa.array([p[i:j].tobytes() for i, j in zip(a, b)], pa.binary())], names=["seed", "doc", "xs"])

    def rows_of(doc, owner, x, y) -> dict:
        by = np.lexsort((y, x, owner, doc))
        doc, owner, x, y = doc[by], owner[by], x[by].astype("<u4"), y[by].astype("<u4")
        cuts, ends = bounds_of(doc, owner)
        return {
            "doc": doc[cuts],
            "owner": owner[cuts],
            "xs": pa.array([x[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
            "ys": pa.array([y[a:b].tobytes() for a, b in zip(cuts, ends)], pa.binary()),
        }

    def match(table: pa.Table) -> pa.Table:
        held, crowded = ([], [], []), [np.zeros(0, np.uint64)]
        for kind, raw in zip(table.column("kind").to_pylist(), table.column("rows").to_pylist()):
            if kind:
                crowded.append(np.frombuffer(raw, "<u8"))
                continue
            m = len(raw) // 20
            for out, t, at in zip(held, ("<u8", "<i8", "<u4"), (0, 8 * m, 16 * m)):
                out.append(np.frombuffer(raw, t, m, at))
        g, d, p = map(np.concatenate, held)
        by = np.lexsort((p, d, g))
        g, d, p = g[by], d[by], p[by].astype(np.int64)
        x, y = star(g, d, p)
        i, px, py = met(g[x], p[x], p[y], cfg)
        found = rows_of(d[x][i], d[y][i], px, py)
        # places of the owners of hot seeds, for the documents that were held back
        hot = np.unique(np.concatenate(crowded))
        at = np.searchsorted(g, hot)
        size = np.searchsorted(g, hot, "right") - at
        cuts, ends = bounds_of(g, d)
        last = at + np.minimum(size, ends[np.searchsorted(cuts, at, "right") - 1] - at) if len(hot) else at
        p = p.astype("<u4")
        lead = {"doc": pa.nulls(len(hot), pa.int64()), "owner": d[at], "xs": pa.nulls(len(hot), pa.binary()), "ys": pa.array([p[a:b].tobytes() for a, b in zip(at, last)], pa.binary())}
        # long seeds of three documents or more: two of them can share a passage that the owner doesn't hold
        held_by = g[cuts]
        far = np.concatenate([held_by[2:][held_by[2:] == held_by[:-2]], hot])
        far = np.unique(far[(far & U(1)) > 0])
        none = pa.nulls(len(far), pa.int64())
        open_ = {"doc": none, "owner": none, "xs": pa.nulls(len(far), pa.binary()), "ys": pa.nulls(len(far), pa.binary())}
        return pa.concat_tables([pa.table({"seed": pa.nulls(len(found["doc"]), pa.int64())} | found), pa.table({"seed": scan.signed(hot)} | lead), pa.table({"seed": scan.signed(far)} | open_)])

    def pair(batches):
        for b in batches:
            m = b.num_rows
            if not m:
                continue
            seed = scan.column(b, "seed").to_numpy().view(np.uint64)
            raw = [scan.column(b, c).to_pylist() for c in ("ys", "xs")]
            size = [np.array([len(r) // 4 for r in x]) for x in raw]
            # each row apart: its number as the seed, the owner before the document
            row = np.concatenate([np.repeat(np.arange(m), n) for n in size])
            side = np.repeat([0, 1], [int(n.sum()) for n in size])
            p = np.concatenate([np.frombuffer(b"".join(x), "<u4") for x in raw]).astype(np.int64)
            by = np.lexsort((p, side, row))
            row, side, p = row[by], side[by], p[by]
            x, y = star(row, side, p)
            i, px, py = met(seed[row[x]], p[x], p[y], cfg)
            yield pa.RecordBatch.from_pydict(rows_of(*(scan.column(b, c).to_numpy()[row[x][i]] for c in ("doc", "owner")), px, py))

    def emit_whole(batches):
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            g, d, p = (np.concatenate([h[i] for h in held]) for i in range(3))
            by = np.argsort(g)
            cols = g[by].astype("<u8"), d[by].astype("<i8"), p[by].astype("<u4")
            cuts = np.searchsorted((cols[0] >> U(32)) * U(parts) >> U(32), np.arange(parts + 1, dtype=np.uint64))
            on = [b for b in range(parts) if cuts[b] < cuts[b + 1]]
            return pa.RecordBatch.from_arrays([pa.array(on, pa.int32()), pa.array([b"".join(c[cuts[b] : cuts[b + 1]].tobytes() for c in cols) for b in on], pa.binary())], names=["bucket", "rows"])

        for c in scan.chunks(batches):
            w = scan.Words(scan.column(c, "text"))
            at, g = whole_grams(w.hashes(fold_case=True), w.first, wanted.value, cfg)
            d = np.searchsorted(w.first, at, "right") - 1
            held.append((g, scan.column(c, "doc_id").to_numpy()[d], at - w.first[d]))
            size += len(g)
            if size > 1_000_000:
                yield flush()
                held.clear()
                size = 0
        if size:
            yield flush()

    def match_whole(table: pa.Table) -> pa.Table:
        held = [], [], []
        for raw in table.column("rows").to_pylist():
            m = len(raw) // 20
            for out, t, at in zip(held, ("<u8", "<i8", "<u4"), (0, 8 * m, 16 * m)):
                out.append(np.frombuffer(raw, t, m, at))
        g, d, p = map(np.concatenate, held)
        by = np.lexsort((p, d, g))
        g, d, p = g[by], d[by], p[by].astype(np.int64)
        x, y = star(g, d, p)
        # short grams at both ends and, for segments() to join them, between
        steps = np.unique(np.append(np.arange(0, cfg.least - cfg.k, cfg.long), cfg.least - cfg.k))
        i, s = np.tile(np.arange(len(x)), len(steps)), np.repeat(steps, len(x))
        return pa.table(rows_of(d[x][i], d[y][i], p[x][i] + s, p[y][i] + s))

    named = docs.select("doc_id", "text")
    blobs = named.mapInArrow(emit, "bucket int, kind int, rows binary")
    found = stored(blobs.groupBy("bucket").applyInArrow(match, "seed long, doc long, owner long, xs binary, ys binary"), "matches")
    owners = found.where("seed is not null and owner is not null").select("seed", "owner", "ys")
    later = named.mapInArrow(emit_later, "seed long, doc long, xs binary").join(owners, "seed").where("doc <> owner")
    pairs = "doc long, owner long, xs binary, ys binary"
    open_ = found.where("seed is not null and owner is null").select(F.col("seed").alias("a"), F.col("seed").alias("b"))
    wanted = docs.sparkSession.sparkContext.broadcast(jaccard.wanted_bits(open_))
    exact = named.mapInArrow(emit_whole, "bucket int, rows binary").groupBy("bucket").applyInArrow(match_whole, pairs)
    return found.where("seed is null").select("doc", "owner", "xs", "ys").union(later.select("seed", "doc", "owner", "xs", "ys").mapInArrow(pair, pairs)).union(exact)


def segments(x: np.ndarray, y: np.ndarray, k: int, reach: int) -> np.ndarray:
    """Rows (x, y, length): seeds on one diagonal whose grams lie within ``reach`` merge."""
    by = np.lexsort((x, x - y))
    x, y = x[by], y[by]
    cut_ = np.concatenate([[True], ((x - y)[1:] != (x - y)[:-1]) | (x[1:] - x[:-1] > reach)])
    lo = np.flatnonzero(cut_)
    hi = np.append(lo[1:], len(x)) - 1
    return np.stack([x[lo], y[lo], x[hi] + k - x[lo]], axis=1)


class Fenwick:
    """Prefix maxima of (value, payload)."""

    def __init__(self, n: int) -> None:
        self.best = [NONE] * (n + 1)

    def update(self, i: int, value: tuple[float, int]) -> None:
        i += 1
        while i < len(self.best):
            if value > self.best[i]:
                self.best[i] = value
            i += i & -i

    def query(self, i: int) -> tuple[float, int]:
        """Best among places below i."""
        out = NONE
        while i > 0:
            if self.best[i] > out:
                out = self.best[i]
            i -= i & -i
        return out


NONE = (-np.inf, -1)


class Band:
    """Maxima over the last ``width`` places up to any place: Fenwick trees over blocks of that width,
    one from each side, as such a stretch is the end of one block and the beginning of the next."""

    def __init__(self, width: int) -> None:
        self.width = width
        self.low: dict[int, Fenwick] = {}
        self.high: dict[int, Fenwick] = {}

    def update(self, at: int, value: tuple[float, int]) -> None:
        block, i = divmod(at, self.width)
        if block not in self.low:
            self.low[block], self.high[block] = Fenwick(self.width), Fenwick(self.width)
        self.low[block].update(i, value)
        self.high[block].update(self.width - 1 - i, value)

    def query(self, at: int) -> tuple[float, int]:
        block, i = divmod(at, self.width)
        out = self.low[block].query(i + 1) if block in self.low else NONE
        return max(out, self.high[block - 1].query(self.width - 1 - i)) if block - 1 in self.high else out


def chains(seg: np.ndarray, gap: float, reach: int) -> list[np.ndarray]:
    """Collinear chains of segments, best first; each segment belongs to one chain.

    score(i) = length(i) + max(0, max over j that end before i, at most ``reach`` away, in
    both texts of score(j) - gap * (dx + dy)). With f(j) = score(j) + gap * (end_x + end_y),
    the inner maximum is one over end_y among the segments whose end_x lies in the last
    reach + 1 places: a sweep over x in epochs of that many places. What ended in the epoch
    before is entered from its last end to its first, while the epoch's segments are asked
    from last to first; what ends within the epoch is entered as the sweep passes it.
    """
    n = len(seg)
    if n == 1:
        return [seg]
    width = reach + 1
    x, y, length = (c.tolist() for c in seg.T)
    ex, ey = [a + m for a, m in zip(x, length)], [a + m for a, m in zip(y, length)]
    score, back = [float(m) for m in length], [-1] * n
    epochs: dict[int, list[tuple[int, int, int]]] = {}
    for i in range(n):
        epochs.setdefault(x[i] // width, []).append((x[i], 1, i))
        epochs.setdefault(ex[i] // width, []).append((ex[i], 0, i))
    value = lambda j: (score[j] + gap * (ex[j] + ey[j]), j)
    for e in sorted(epochs):
        events = sorted(epochs[e])
        ended = [j for _, opens, j in sorted(epochs.get(e - 1, ())) if not opens]
        before = {}
        if ended:
            band = Band(width)
            for at, opens, i in reversed(events):
                if opens:
                    while ended and ex[ended[-1]] >= at - reach:
                        j = ended.pop()
                        band.update(ey[j], value(j))
                    before[i] = band.query(y[i])
        band = Band(width)
        for _, opens, i in events:
            if not opens:
                band.update(ey[i], value(i))
                continue
            f, j = max(band.query(y[i]), before.get(i, NONE))
            gain = f - gap * (x[i] + y[i])
            if j >= 0 and gain > 0:
                score[i] += gain
                back[i] = j
    used = [False] * n
    out = []
    for i in sorted(range(n), key=lambda i: (-score[i], i)):
        path = []
        while i >= 0 and not used[i]:
            used[i] = True
            path.append(i)
            i = back[i]
        if path:
            out.append(seg[path[::-1]])
    return out


def chained(matches: DataFrame, cfg: PassageConfig, parts: int) -> DataFrame:
    """(doc, owner, x0, x1, y0, y1, path): all chains."""

    def run(table: pa.Table) -> pa.Table:
        rows = []
        docs, owners = table.column("doc").to_numpy(), table.column("owner").to_numpy()
        xs, ys = table.column("xs").to_pylist(), table.column("ys").to_pylist()
        by = np.lexsort((owners, docs))
        cuts = np.flatnonzero(np.concatenate([[True], (docs[by][1:] != docs[by][:-1]) | (owners[by][1:] != owners[by][:-1])]))
        for lo, hi in zip(cuts, np.append(cuts[1:], len(by))):
            some = by[lo:hi]
            x = np.frombuffer(b"".join(xs[i] for i in some), "<u4").astype(np.int64)
            y = np.frombuffer(b"".join(ys[i] for i in some), "<u4").astype(np.int64)
            for path in chains(segments(x, y, cfg.k, cfg.long), cfg.gap, cfg.reach):
                rows.append((int(docs[some[0]]), int(owners[some[0]]), int(path[0, 0]), int(path[-1, 0] + path[-1, 2]), int(path[0, 1]), int(path[-1, 1] + path[-1, 2]), path.astype("<i4").tobytes()))
        cols = list(zip(*rows)) or [()] * 7
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc", "owner", "x0", "x1", "y0", "y1", "path"])

    slot = F.pmod(F.xxhash64("doc"), F.lit(4 * parts)).cast("int").alias("slot")
    return matches.withColumn("slot", slot).groupBy("slot").applyInArrow(run, "doc long, owner long, x0 long, x1 long, y0 long, y1 long, path binary")


def word_codes(docs: DataFrame) -> DataFrame:
    """(doc_id, codes): 32 bits a word."""

    def run(batches):
        for c in scan.chunks(batches):
            w = scan.Words(scan.column(c, "text"))
            codes = w.hashes(fold_case=True).astype("<u4")
            yield pa.RecordBatch.from_arrays([scan.column(c, "doc_id"), pa.array([codes[a:b].tobytes() for a, b in zip(w.first[:-1], w.first[1:])], pa.binary())], names=["doc_id", "codes"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, codes binary")


def edit_matches(a: np.ndarray, b: np.ndarray) -> int:
    """Words kept by a longest common subsequence of two short gaps."""
    if not len(a) or not len(b):
        return 0
    row = np.zeros(len(b) + 1, dtype=np.int32)
    for x in a:
        new = np.maximum(row[1:], row[:-1] + (b == x))
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def align(a: np.ndarray, b: np.ndarray, path: np.ndarray) -> tuple[int, int, int, int, int]:
    """(x0, x1, y0, y1, equal words) of a chain within the cut texts a and b."""
    x, y, n = path[0]
    back = min(x, y)
    same = a[x - back : x] == b[y - back : y]
    left = _reach(same[::-1])
    equal = int(same[len(same) - left :].sum())
    x0, y0 = x - left, y - left
    for k, (x, y, n) in enumerate(path):
        if k:
            equal += edit_matches(a[px:x], b[py:y])
        m = min(n, len(a) - x, len(b) - y)
        equal += int((a[x : x + m] == b[y : y + m]).sum())
        px, py = x + m, y + m
    m = min(len(a) - px, len(b) - py)
    same = a[px : px + m] == b[py : py + m]
    right = _reach(same)
    return int(x0), int(px + right), int(y0), int(py + right), equal + int(same[:right].sum())


def lcs_columns(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int, bool]]:
    """A longest common subsequence of two gaps as columns (step in a, step in b, equal)."""
    t = np.zeros((len(a) + 1, len(b) + 1), dtype=np.int32)
    for i, x in enumerate(a):
        t[i + 1, 1:] = np.maximum.accumulate(np.maximum(t[i, 1:], t[i, :-1] + (b == x)))
    i, j, out = len(a), len(b), []
    while i or j:
        if i and j and a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((1, 1, True))
        elif i and j and t[i, j] == t[i - 1, j - 1]:
            i, j = i - 1, j - 1
            out.append((1, 1, False))
        elif j and t[i, j] == t[i, j - 1]:
            j -= 1
            out.append((0, 1, False))
        else:
            i -= 1
            out.append((1, 0, False))
    return out[::-1]


def runs(equal: np.ndarray, x: np.ndarray, cfg: PassageConfig) -> list[tuple[int, int]]:
    """Column ranges [i, j) with identity of at least ``identity`` that begin and end with equal
    words and hold ``least`` words of the text (x: its place at each column's start, and the end):
    the longest first, then those of what is left on both sides of it. One that falls into two such
    ranges at a stretch of more than ``window`` unequal columns is split there."""
    out, todo = [], [(0, len(equal))]
    while todo:
        lo, hi = todo.pop()
        on = np.flatnonzero(equal[lo:hi]) + lo
        if x[hi] - x[lo] < cfg.least or not len(on):
            continue
        total = np.concatenate([[0.0], np.cumsum(np.where(equal[lo:hi], 1 - cfg.identity, -cfg.identity))])
        ahead = np.maximum.accumulate(total[::-1])[::-1]  # best sum at or after each column
        # the farthest end for each start: ``ahead`` never rises
        end = len(ahead) - np.searchsorted(ahead[::-1], total[on - lo] - 1e-9, "left") - 1 + lo
        span = x[end] - x[on]
        k = int(span.argmax())
        if span[k] < cfg.least:
            continue
        i, j = int(on[k]), int(on[np.searchsorted(on, end[k]) - 1]) + 1
        todo += [(lo, i), (j, hi)]
        if x[j] - x[i] < cfg.least:
            continue
        held = [(i, j)]
        while held:
            i, j = held.pop()
            at = np.flatnonzero(equal[i:j]) + i
            for c in np.flatnonzero(np.diff(at) > cfg.window + 1).tolist():
                sides = [(i, int(at[c]) + 1), (int(at[c + 1]), j)]
                if all(x[v] - x[u] >= cfg.least and equal[u:v].mean() >= cfg.identity for u, v in sides):
                    held += sides
                    break
            else:
                out.append((i, j))
    return out


def pieces(a: np.ndarray, b: np.ndarray, path: np.ndarray, cfg: PassageConfig) -> list[tuple[int, int, int, int, int]]:
    """(x0, x1, y0, y1, equal words) of the passages of a chain: all of it as extended without gaps, or
    else the best parts of an alignment of the whole cuts."""
    # no alignment matches more words than occur in both cuts
    words = set(b.tolist())
    if len(a) < cfg.least or sum(x in words for x in a.tolist()) < cfg.identity * cfg.least:
        return []
    x0, x1, y0, y1, equal = align(a, b, path)
    between = path[1:, :2] - path[:-1, :2] - path[:-1, 2:]
    if x1 - x0 >= cfg.least and equal >= cfg.identity * max(x1 - x0, y1 - y0) and not (between > cfg.window).any():
        return [(x0, x1, y0, y1, equal)]
    px, py = path[0, :2].tolist()
    columns = [] if set(a[:px].tolist()).isdisjoint(b[:py].tolist()) else lcs_columns(a[:px][::-1], b[:py][::-1])[::-1]
    x0, y0 = (0, 0) if columns else (px, py)
    for k, (x, y, n) in enumerate(path.tolist()):
        if k:
            columns += lcs_columns(a[px:x], b[py:y])
        n = min(n, len(a) - x, len(b) - y)
        columns += [(1, 1, e) for e in (a[x : x + n] == b[y : y + n]).tolist()]
        px, py = x + n, y + n
    if not set(a[px:].tolist()).isdisjoint(b[py:].tolist()):
        columns += lcs_columns(a[px:], b[py:])
    c = np.array(columns, dtype=np.int64)
    x = x0 + np.concatenate([[0], np.cumsum(c[:, 0])])
    y = y0 + np.concatenate([[0], np.cumsum(c[:, 1])])
    # what lies beside the chain alone is left to the chain there
    held = [(i, j) for i, j in runs(c[:, 2] > 0, x, cfg) if x[i] < path[-1, 0] + path[-1, 2] and x[j] > path[0, 0]]
    return [(int(x[i]), int(x[j]), int(y[i]), int(y[j]), int(c[i:j, 2].sum())) for i, j in held]


def _reach(same: np.ndarray, drop: int = 6) -> int:
    """How far an ungapped extension goes: its best prefix, +1 a match and -2 a mismatch, until it
    falls ``drop`` below its best."""
    if not len(same):
        return 0
    run = np.cumsum(np.where(same, 1, -2))
    top = np.maximum.accumulate(np.maximum(run, 0))
    stop = np.flatnonzero(top - run > drop)
    run = run[: stop[0]] if len(stop) else run
    return int(run.argmax()) + 1 if len(run) and run.max() > 0 else 0


SCHEMA = "doc_id long, source_doc_id long, first_word long, end_word long, source_first long, source_end long, n_words long, identity double"


def passages(docs: DataFrame, cfg: PassageConfig = PassageConfig()) -> DataFrame:
    """One row a passage of ``doc_id`` that repeats one of ``source_doc_id`` (which is smaller)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text <> ''")
    found = stored(chained(seed_matches(docs, cfg, parts), cfg, parts), "chains")
    codes = word_codes(docs)
    part = lambda low, high: F.expr(f"substring(codes, int(4 * {low} + 1), int(4 * ({high} - {low})))")
    low = lambda c: F.greatest(F.col(c) - cfg.flank, F.lit(0))
    want = found.withColumns({"xl": low("x0"), "xh": F.col("x1") + cfg.flank, "yl": low("y0"), "yh": F.col("y1") + cfg.flank})
    both = want.join(codes.withColumnRenamed("doc_id", "owner"), "owner").withColumn("b", part("yl", "yh")).drop("codes")
    both = both.join(codes.withColumnRenamed("doc_id", "doc"), "doc").withColumn("a", part("xl", "xh")).drop("codes")

    def run(batches):
        for t in batches:
            get = lambda c: scan.column(t, c).to_pylist()
            rows = []
            for doc, owner, xl, yl, path, a, b in zip(*map(get, ("doc", "owner", "xl", "yl", "path", "a", "b"))):
                p = np.frombuffer(path, "<i4").reshape(-1, 3).astype(np.int64)
                p[:, 0] -= xl
                p[:, 1] -= yl
                a, b = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
                if ((p[:, 0] + p[:, 2] > len(a)) | (p[:, 1] + p[:, 2] > len(b))).any():
                    continue  # another row of a repeated doc_id
                for x0, x1, y0, y1, equal in pieces(a, b, p, cfg):
                    rows.append((doc, owner, x0 + xl, x1 + xl, y0 + yl, y1 + yl, x1 - x0, equal / max(x1 - x0, y1 - y0)))
            cols = list(zip(*rows)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    def outermost(table: pa.Table) -> pa.Table:
        """Without passages that lie within another one of the same two documents, or equal one."""
        t = table.sort_by([("doc_id", "ascending"), ("source_doc_id", "ascending"), ("first_word", "ascending"), ("end_word", "descending"), ("identity", "descending"), ("source_first", "ascending"), ("source_end", "ascending")])
        cuts, ends = bounds_of(t.column("doc_id").to_numpy(), t.column("source_doc_id").to_numpy())
        last = t.column("end_word").to_numpy()
        keep = np.ones(len(last), dtype=bool)
        for lo, hi in zip(cuts[ends - cuts > 1].tolist(), ends[ends - cuts > 1].tolist()):
            keep[lo + 1 : hi] = last[lo + 1 : hi] > np.maximum.accumulate(last[lo:hi])[:-1]
        return t.filter(pa.array(keep))

    aligned = both.select("doc", "owner", "xl", "yl", "path", "a", "b").mapInArrow(run, SCHEMA)
    return aligned.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(parts)).alias("slot")).applyInArrow(outermost, SCHEMA)


def spans_of(found: DataFrame) -> DataFrame:
    """(doc_id, spans): all repeated places of a document as one sorted list."""
    return found.groupBy("doc_id").agg(F.array_sort(F.collect_set(F.struct("first_word", "end_word"))).alias("spans"))


def remove(docs: DataFrame, found: DataFrame, least_left: int = 1) -> DataFrame:
    """All rows with their columns, the repeated words cut out of ``text``; the smallest doc_id keeps
    its copy. Documents with fewer than ``least_left`` words left go; untouched ones always stay."""
    columns = docs.columns
    cuts_ = spans_of(found).select(F.col("doc_id").alias("__doc"), F.col("spans").alias("__spans"))
    joined = docs.join(cuts_, F.col("doc_id") == F.col("__doc"), "left").select(*columns, "__spans")
    fields = joined.schema.fields[:-1]
    where = [f.name for f in fields].index("text")

    def run(batches):
        for c in scan.chunks(batches):
            texts, spans = scan.column(c, "text"), scan.column(c, "__spans").to_pylist()
            cuts = [i for i, s in enumerate(spans) if s]
            out, keep = texts, np.ones(c.num_rows, dtype=bool)
            if cuts:
                w = scan.Words(texts)
                made = texts.to_pylist()
                for i in cuts:
                    raw = w.data[w.off[i] : w.off[i + 1]]
                    gone = np.zeros(len(raw), dtype=bool)
                    n = int(w.counts[i])
                    lost = np.zeros(n, dtype=bool)
                    for s in spans[i]:
                        a, b = min(s["first_word"], n), min(s["end_word"], n)
                        if a < b:
                            lost[a:b] = True
                            gone[w.start[w.first[i] + a] - w.off[i] : w.end[w.first[i] + b - 1] - w.off[i]] = True
                    made[i] = raw[~gone].tobytes().decode()
                    keep[i] = n - lost.sum() >= least_left
                out = pa.array(made, texts.type)
            cols = [c.column(i) for i in range(len(fields))]
            cols[where] = out
            if "n_chars" in columns:
                at = columns.index("n_chars")
                n = pa.array([len(t) if t is not None else None for t in out.to_pylist()], cols[at].type) if cuts else cols[at]
                cols[at] = n
            yield pa.RecordBatch.from_arrays(cols, names=columns).filter(pa.array(keep))

    return joined.mapInArrow(run, docs.schema)
