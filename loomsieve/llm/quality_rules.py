"""Quality rules with an isolation forest over rule statistics.

Each text is reduced to a few counts in one pass. Texts that fail the base rules go.
For the others, trees of random splits over the statistics give a mean path length;
short paths mark anomalies. The forest is fitted on a bounded sample of labelled rows
(``sample``; taken in the order of a hash of doc_id), and the threshold is the one at
which most bad labelled rows of a held-out part go while at most ``max_loss`` of the good
ones are lost. All rows are scored.

Null and empty texts have zero counts and fail the base rules (too few words). Without
labels of both kinds there is no threshold and the base rules decide alone. Repeated
rows are judged alike; columns other than ``doc_id`` and ``text`` don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import scan

SYMBOL = np.zeros(256, dtype=bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
HEAD = np.ones(256, dtype=bool)
HEAD[0x80:0xC0] = False
UPPER = np.zeros(256, dtype=bool)
UPPER[65:91] = True
MARK = np.zeros(256, dtype=bool)
MARK[[ord(c) for c in "!?"]] = True
STOP = np.zeros(256, dtype=bool)
STOP[[ord(c) for c in ".,;:"]] = True
WINDOW = 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "dup_lines", "repeated", "word_length", "upper", "marks", "stops", "distinct", "line_words")


@dataclass(frozen=True)
class RuleConfig:
    min_words: int = 20
    max_repeat_percent: int = 30
    trees: int = 120
    leaf_sample: int = 256
    sample: int = 6000
    bad_share: float = 0.06
    max_loss: float = 0.012
    seed: int = 7


def per_text(on: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0], np.cumsum(on, dtype=np.int64)])
    return run[off[1:]] - run[off[:-1]]


def grouped(h: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, how many items of its text have its hash, and whether it is the first of them."""
    key = scan.mix(h + scan.mix(text.astype(np.uint64) + np.uint64(1)))
    by = np.argsort(key, kind="stable")
    k = key[by]
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
    group = np.cumsum(new) - 1
    size = np.bincount(group)[group] if len(k) else np.zeros(0, np.int64)
    count, first = np.empty(len(k), np.int64), np.empty(len(k), bool)
    count[by], first[by] = size, new
    return count, first


def statistics(texts: pa.Array) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Counts by name, and the feature matrix."""
    w = scan.Words(texts)
    data, off = w.data, w.off
    h = w.hashes()
    word_text = np.repeat(np.arange(w.n), w.counts)
    solid = scan.NOT_SPACE[data]
    chars = per_text(solid & HEAD[data], off)
    symbols = per_text(SYMBOL[data], off)

    at, bounds = scan.windows(w.first, WINDOW)
    g = scan.gram_hashes(h, at, WINDOW)
    count, _ = grouped(g, np.repeat(np.arange(w.n), np.diff(bounds)))
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    twice = at[count > 1]
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + WINDOW, -1)
    repeated = np.bincount(word_text[np.cumsum(edge[:-1]) > 0], minlength=w.n)

    newline = np.flatnonzero(data == 10)
    start = np.union1d(off[:-1][np.diff(off) > 0], newline + 1) if len(data) else np.zeros(0, np.int64)
    start = start[start < len(data)]
    # a newline that ends one text opens no line in it; the next text's start is a start anyway
    stop = np.append(start[1:], len(data)) if len(start) else start
    ends = stop - (data[np.maximum(stop - 1, 0)] == 10) if len(start) else stop
    run = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    full = run[ends] > run[start]
    start, ends = start[full], ends[full]
    line_text = np.searchsorted(off, start, "right") - 1
    lh = scan.span_hashes(data, start, ends) + (ends - start).astype(np.uint64)
    _, first = grouped(lh, line_text)
    lines = np.bincount(line_text, minlength=w.n)
    dup_lines = lines - np.bincount(line_text[first], minlength=w.n)

    _, first = grouped(h, word_text)
    distinct = np.bincount(word_text[first], minlength=w.n)
    n, c = np.maximum(w.counts, 1), np.maximum(chars, 1)
    features = np.stack(
        [
            symbols / c,
            dup_lines / np.maximum(lines, 1),
            repeated / n,
            chars / n,
            per_text(UPPER[data], off) / c,
            per_text(MARK[data], off) / n,
            per_text(STOP[data], off) / n,
            distinct / n**0.8,
            np.log1p(w.counts / np.maximum(lines, 1)),
        ],
        axis=1,
    )
    return {"n_words": w.counts, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup_lines, "n_repeat_words": repeated}, features


def path_constant(n) -> np.ndarray:
    n = np.maximum(np.asarray(n, dtype=float), 1)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class Forest:
    """Trees as flat arrays: feature, split, left child, right child and path length at leaves."""

    def __init__(self, x: np.ndarray, trees: int, leaf_sample: int, rng: np.random.Generator) -> None:
        self.sample = min(leaf_sample, len(x))
        limit = max(1, int(np.ceil(np.log2(max(self.sample, 2)))))
        self.limit = limit
        self.trees = [self._grow(x[rng.choice(len(x), self.sample, replace=False)], limit, rng) for _ in range(trees)]

    @staticmethod
    def _grow(x: np.ndarray, limit: int, rng: np.random.Generator):
        feature, split, left, right, length = [], [], [], [], []

        def node(rows: np.ndarray, depth: int) -> int:
            me = len(feature)
            for a in (feature, left, right):
                a.append(0)
            split.append(np.inf)
            length.append(depth + float(path_constant(len(rows))))
            low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(x.shape[1]),) * 2
            open_ = np.flatnonzero(high > low)
            left[me] = right[me] = me
            if depth < limit and len(rows) > 1 and len(open_):
                f = int(rng.choice(open_))
                s = float(rng.uniform(low[f], high[f]))
                on = rows[:, f] < s
                feature[me], split[me] = f, s
                left[me] = node(rows[on], depth + 1)
                right[me] = node(rows[~on], depth + 1)
            return me

        node(x, 0)
        return tuple(np.array(a) for a in (feature, split, left, right, length))

    def score(self, x: np.ndarray) -> np.ndarray:
        """0 to 1; the higher, the more anomalous."""
        total = np.zeros(len(x))
        row = np.arange(len(x))
        for feature, split, left, right, length in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(self.limit):
                at = np.where(x[row, feature[at]] < split[at], left[at], right[at])
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(float(path_constant(self.sample)), 1e-9))


@dataclass
class Rules:
    """``low``, ``high`` and ``scale`` turn statistics into how far they leave the usual range of
    good rows; the forest splits those."""

    low: np.ndarray | None = None
    high: np.ndarray | None = None
    scale: np.ndarray | None = None
    forest: Forest | None = None
    threshold: float = float("inf")

    def excess(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([np.log1p(np.maximum(x - self.high, 0) / self.scale), np.log1p(np.maximum(self.low - x, 0) / self.scale)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.forest.score(self.excess(x)) if self.forest and len(x) else np.zeros(len(x))


def measured(docs: DataFrame, extra: str | None = None) -> DataFrame:
    """doc_id, the counts and the features as one array (and one more column, if named)."""
    keep = ["doc_id", *([extra] if extra else [])]

    def run(batches):
        for c in scan.chunks(batches):
            counts, x = statistics(scan.column(c, "text"))
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*[scan.column(c, k) for k in keep], *[pa.array(counts[k].astype(np.int64)) for k in COUNTS], flat], names=[*keep, *COUNTS, "features"])

    kinds = ", ".join(f"{k} long" for k in [*keep, *COUNTS])
    return docs.select(*[F.col(k).cast("long").alias(k) for k in keep], "text").mapInArrow(run, f"{kinds}, features array<double>")


def fit(docs: DataFrame, labels: DataFrame, cfg: RuleConfig = RuleConfig()) -> Rules:
    some = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.sample)
    got = measured(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"), "quality").select("doc_id", "quality", "n_words", "n_repeat_words", "features").toPandas()
    got = got[(got.n_words >= cfg.min_words) & (100 * got.n_repeat_words <= cfg.max_repeat_percent * got.n_words)].sort_values("doc_id")
    good = got.quality.to_numpy() == 1
    if good.sum() < 20 or (~good).sum() < 5:
        return Rules()
    x = np.array(got.features.tolist())
    half = scan.mix(got.doc_id.to_numpy().astype(np.uint64)) % np.uint64(2) == 0
    fitted, held = good & half, np.flatnonzero(~half)
    if fitted.sum() < 10 or not good[held].any():
        return Rules()
    low, high = np.quantile(x[fitted], [0.002, 0.998], axis=0)
    spread = np.quantile(x[fitted], 0.9, axis=0) - np.quantile(x[fitted], 0.1, axis=0)
    rules = Rules(low, high, np.maximum(spread, 0.01))
    few = np.flatnonzero(~good & half)[: max(2, int(cfg.bad_share * fitted.sum()))]
    rules.forest = Forest(rules.excess(x[np.concatenate([np.flatnonzero(fitted), few])]), cfg.trees, cfg.leaf_sample, np.random.default_rng(cfg.seed))
    s, is_good = rules.score(x[held]), good[held]
    best = None
    for t in np.unique(s[is_good])[::-1]:
        lost, missed = np.mean(s[is_good] > t), np.mean(s[~is_good] <= t) if (~is_good).any() else 0.0
        if lost > cfg.max_loss:
            break
        cost = 10 * lost + missed
        if best is None or cost < best[0]:
            best = (cost, float(t))
    rules.threshold = best[1] + 1e-9
    return rules


def judge(docs: DataFrame, rules: Rules, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """doc_id, the counts, base_failed, anomaly (0 to 1) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        r = shared.value
        for c in scan.chunks(batches):
            counts, x = statistics(scan.column(c, "text"))
            s = r.score(x)
            failed = (counts["n_words"] < cfg.min_words) | (100 * counts["n_repeat_words"] > cfg.max_repeat_percent * counts["n_words"])
            yield pa.RecordBatch.from_arrays(
                [scan.column(c, "doc_id"), *[pa.array(counts[k].astype(np.int64)) for k in COUNTS], pa.array(failed), pa.array(s), pa.array(~failed & (s <= r.threshold))],
                names=["doc_id", *COUNTS, "base_failed", "anomaly", "kept"],
            )

    kinds = ", ".join(f"{k} long" for k in ["doc_id", *COUNTS])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{kinds}, base_failed boolean, anomaly double, kept boolean")


def keep(docs: DataFrame, rules: Rules, cfg: RuleConfig = RuleConfig()) -> DataFrame:
    """The rows that pass, with all their columns, without a shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(rules)

    def run(batches):
        r = shared.value
        for c in scan.chunks(batches):
            counts, x = statistics(scan.column(c, "text"))
            failed = (counts["n_words"] < cfg.min_words) | (100 * counts["n_repeat_words"] > cfg.max_repeat_percent * counts["n_words"])
            ok = ~failed & (r.score(x) <= r.threshold)
            yield c.filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
