"""Quality classifier by co-training two views.

View one sees the text (presence of informative words, rule statistics), view two the
page metadata (language, source, length). For each head (quality, toxicity) both are
fitted on labelled rows. In every round each view labels the unlabelled documents that it
is most sure of, a share of the corpus that grows with the rounds, for the other view,
which is fitted again on labelled and pseudo-labelled rows. All documents outside the
labelled sample take part: their features are stored once, and each pass over them brings
home a histogram of scores or a sum of gradients. Pseudo-labelled rows weigh together at
most as much as the labelled ones.

Labelled rows apart from those of the fit calibrate each view's logit, combine the
calibrated views, and set the threshold: three sets of rows, parted by a hash of doc_id.
All documents are scored in one pass without a shuffle.

The labelled rows are a bounded sample in the order of a hash of doc_id (``labelled``);
of several rows of one doc_id the one with the smallest features counts. Thresholds lose
at most ``max_loss`` of clean rows. Null texts are empty, null metadata a value of its own;
repeated rows score alike. Without enough labels of both kinds a head gives its prior and
rejects nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import scan
from loomsieve.llm.quality_rules import statistics
from loomsieve.session import discard, stored

BITS = 20
META = 512


@dataclass(frozen=True)
class CoTrainConfig:
    labelled: int = 8000
    rounds: int = 3
    share: float = 0.05
    sure: float = 0.95
    steps: int = 4
    words: int = 400
    least_z: float = 4.0
    max_loss: float = 0.01


def word_ids(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, distinct within a text, and bounds by text."""
    w = scan.Words(texts, scan.ALNUM)
    ids = (w.hashes(fold_case=True) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique((np.repeat(np.arange(w.n), w.counts) << BITS) | ids)
    return key & ((1 << BITS) - 1), np.searchsorted(key, np.arange(w.n + 1) << BITS)


def meta_rows(lang: list, source: list, n_chars: list) -> np.ndarray:
    """Indicator columns by text: hashed language, source and length class, and an intercept."""
    slot = lambda kind, x: scan.mix_int(sum(b << 8 * (i % 7) for i, b in enumerate(f"{kind}={x}".encode()))) % (META - 1)
    known: dict[tuple, int] = {}
    out = np.empty((len(lang), 3), dtype=np.int64)
    for i, row in enumerate(zip(lang, source, n_chars)):
        size = -1 if row[2] is None else int(np.log2(max(int(row[2]), 0) + 1) * 2)
        for j, kv in enumerate((("lang", row[0]), ("source", row[1]), ("size", size))):
            if kv not in known:
                known[kv] = slot(*kv)
            out[i, j] = known[kv]
    return out


class Logistic:
    """L2-regularized logistic regression on dense columns, by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 12) -> None:
        self.reg = np.full(x.shape[1] + 1, ridge)
        self.reg[-1] = 1e-6
        self.w = np.zeros(x.shape[1] + 1)
        for _ in range(steps):
            step = np.linalg.solve(*self.slopes(x, y, weight))
            self.w = self.w - step
            if np.abs(step).max() < 1e-6:
                break

    def slopes(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Hessian and gradient of the regularized loss."""
        x = np.hstack([x, np.ones((len(x), 1))])
        weight = np.ones(len(x)) if weight is None else weight
        p = sigmoid(x @ self.w)
        h = (x * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + np.diag(self.reg)
        return h, x.T @ (weight * (p - y)) + self.reg * self.w

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(x @ self.w[:-1] + self.w[-1], -30, 30)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Head:
    prior: float = 0.5
    text: Logistic | None = None
    meta: Logistic | None = None
    scales: tuple[Logistic, Logistic] | None = None  # each view's calibration
    both: Logistic | None = None
    chosen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    threshold: float = float("nan")

    def text_matrix(self, ids: np.ndarray, bounds: np.ndarray, stats: np.ndarray) -> np.ndarray:
        n = len(bounds) - 1
        x = np.zeros((n, len(self.chosen)))
        if len(self.chosen):
            at = np.minimum(np.searchsorted(self.chosen, ids), len(self.chosen) - 1)
            on = self.chosen[at] == ids
            x[np.repeat(np.arange(n), np.diff(bounds))[on], at[on]] = 1
        return np.hstack([x, np.clip((stats - self.mean) / self.scale, -5, 5)])

    @staticmethod
    def meta_matrix(slots: np.ndarray) -> np.ndarray:
        x = np.zeros((len(slots), META))
        x[np.arange(len(slots))[:, None], slots] = 1
        return x

    def views(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        """Calibrated logits of both views."""
        raw = (self.text.logit(xt), self.meta.logit(xm))
        return np.stack([c.logit(z[:, None]) for c, z in zip(self.scales, raw)], axis=1)

    def score(self, xt: np.ndarray, xm: np.ndarray) -> np.ndarray:
        return sigmoid(self.both.logit(self.views(xt, xm)))


def choose_words(ids: np.ndarray, bounds: np.ndarray, y: np.ndarray, cfg: CoTrainConfig) -> np.ndarray:
    """Words whose share of documents differs most between the classes."""
    doc = np.repeat(np.arange(len(y)), np.diff(bounds))
    one = np.bincount(ids[y[doc] == 1], minlength=1 << BITS)
    all_ = np.bincount(ids, minlength=1 << BITS)
    n1, n0 = max(int(y.sum()), 1), max(int((1 - y).sum()), 1)
    p = all_ / len(y)
    z = np.abs(one / n1 - (all_ - one) / n0) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n1 + 1 / n0))
    z[all_ < 5] = 0
    top = np.argsort(-z, kind="stable")[: cfg.words]
    return np.sort(top[z[top] >= cfg.least_z])


TRAIN, CALIBRATE, COMBINE, THRESHOLD = range(4)
BINS = 6001


def parts_of(ids: np.ndarray) -> np.ndarray:
    """What a labelled row serves for: five of eight the fit."""
    k = (scan.mix(ids.astype(np.uint64)) % np.uint64(8)).astype(np.int64)
    return np.array([CALIBRATE, COMBINE, THRESHOLD] + 5 * [TRAIN])[k]


class Labelled:
    """The labelled sample of one head, by part."""

    def __init__(self, ids, bounds, stats, slots, y: np.ndarray, part: np.ndarray, cfg: CoTrainConfig) -> None:
        self.y, self.part = y, part
        self.head = Head(prior=float(y[y >= 0].mean()) if (y >= 0).any() else 0.5)
        rows = np.flatnonzero((part == TRAIN) & (y >= 0))
        self.ready = min((y[rows] == 1).sum(), (y[rows] == 0).sum()) >= 5 and len(np.unique(y[(part != TRAIN) & (y >= 0)])) == 2
        if not self.ready:
            return
        some = scan.ranges(bounds[rows], np.diff(bounds)[rows])
        self.head.chosen = choose_words(ids[some], np.concatenate([[0], np.cumsum(np.diff(bounds)[rows])]), y[rows], cfg)
        self.head.mean, self.head.scale = stats[rows].mean(axis=0), np.maximum(stats[rows].std(axis=0), 1e-3)
        self.x = (self.head.text_matrix(ids, bounds, stats), self.head.meta_matrix(slots))
        self.rows = rows
        self.head.text, self.head.meta = (Logistic(x[rows], y[rows]) for x in self.x)

    def calibrate(self) -> None:
        r = self.rows_for(CALIBRATE)
        self.head.scales = tuple(Logistic(m.logit(x[r])[:, None], self.y[r], ridge=0.1) for m, x in zip((self.head.text, self.head.meta), self.x))
        self.before: list = [None, None]

    def step(self, view: int, gradient: np.ndarray, loss: float, n: int) -> None:
        """One step on labelled rows and n pseudo-labelled ones, of which only gradient and loss are known.
        The curvature is its upper bound, that of the latter taken to be that of the labelled rows in
        proportion to the weight; a step after which the loss is higher is halved instead."""
        m = (self.head.text, self.head.meta)[view]
        x, y = np.hstack([self.x[view][self.rows], np.ones((len(self.rows), 1))]), self.y[self.rows]
        weight = min(1.0, len(self.rows) / max(n, 1))
        z = np.clip(x @ m.w, -30, 30)
        total = float(np.logaddexp(0, z).sum() - z[y == 1].sum() + weight * loss + (m.reg * m.w**2).sum() / 2)
        if self.before[view] is not None and total > self.before[view][1] + 1e-9:
            m.w = (m.w + self.before[view][0]) / 2
            return
        self.before[view] = (m.w.copy(), total)
        bound = x.T @ x / 4 * (1 + weight * n / len(self.rows)) + np.diag(m.reg)
        m.w = m.w - np.linalg.solve(bound, x.T @ (sigmoid(z) - y) + m.reg * m.w + weight * gradient)

    def rows_for(self, part: int) -> np.ndarray:
        """The part's rows, or all that the fit doesn't use if the part lacks a class."""
        own = np.flatnonzero((self.part == part) & (self.y >= 0))
        return own if len(np.unique(self.y[own])) == 2 else np.flatnonzero((self.part != TRAIN) & (self.y >= 0))

    def finish(self, cfg: CoTrainConfig, reject_high: bool) -> Head:
        head = self.head
        if not self.ready:
            return head
        self.calibrate()
        r = self.rows_for(COMBINE)
        head.both = Logistic(head.views(self.x[0][r], self.x[1][r]), self.y[r], ridge=0.1)
        r = self.rows_for(THRESHOLD)
        s, y = head.score(self.x[0][r], self.x[1][r]), self.y[r]
        clean = np.sort(s[y == (0 if reject_high else 1)])
        k = int(cfg.max_loss * len(clean))
        # as far from 0.5 towards the clean rows as the permitted loss goes, if that catches more
        if reject_high:
            low = float(clean[len(clean) - 1 - k])
            bad = s[(y == 1) & (s > low)]
            head.threshold = low if low >= 0.5 else min(0.5, float(np.nextafter(bad.min(), 0))) if len(bad) else 0.5
        else:
            high = float(clean[k])
            bad = s[(y == 0) & (s < high)]
            head.threshold = high if high <= 0.5 else max(0.5, float(np.nextafter(bad.max(), 1))) if len(bad) else 0.5
        return head


def bin_of(logit: np.ndarray) -> np.ndarray:
    return np.floor((logit + 30) * 100).astype(np.int64)


def cuts_of(counts: np.ndarray, share: float, sure: float) -> tuple[int, int]:
    """(highest bin labelled 0, lowest bin labelled 1): as many bins from either end as hold at most
    ``share`` of all rows and are at least ``sure``."""
    most = int(share * counts.sum())
    limit = int(bin_of(np.log(np.array([sure / (1 - sure)])))[0])
    up = np.cumsum(counts)
    low = int(np.searchsorted(up, most, "right")) - 1
    high = BINS - int(np.searchsorted(np.cumsum(counts[::-1]), most, "right"))
    return min(low, BINS - 2 - limit), max(high, limit + 1)


def pool_features(docs: DataFrame, heads: list[Labelled], known: np.ndarray) -> DataFrame:
    """Features of all documents outside the sample, many a row: n, words (bits), stats, slots."""
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(([h.head.chosen for h in heads], np.sort(known)))

    def run(batches):
        chosen, known = shared.value
        for c in scan.chunks(batches):
            ids, bounds = word_ids(scan.column(c, "text"))
            doc = scan.column(c, "doc_id")
            n = c.num_rows
            out = ~np.isin(doc.fill_null(0).to_numpy(), known) | doc.is_null().to_numpy(zero_copy_only=False)
            bits = []
            for words in chosen:
                x = np.zeros((n, len(words)), dtype=bool)
                if len(words):
                    at = np.minimum(np.searchsorted(words, ids), len(words) - 1)
                    on = words[at] == ids
                    x[np.repeat(np.arange(n), np.diff(bounds))[on], at[on]] = True
                bits.append(np.packbits(x[out], axis=1).tobytes())
            _, stats = statistics(scan.column(c, "text"))
            slots = meta_rows(*[scan.column(c, k).to_pylist() for k in ("lang", "source", "n_chars")])
            yield pa.RecordBatch.from_pydict({"n": pa.array([int(out.sum())], pa.int32()), "words": pa.array([bits], pa.list_(pa.binary())), "stats": [stats[out].astype("<f4").tobytes()], "slots": [slots[out].astype("<u2").tobytes()]})

    return stored(docs.mapInArrow(run, "n int, words array<binary>, stats binary, slots binary"), "pool")


def pool_views(b: pa.RecordBatch, heads: list[Head]):
    """For each stored row and head: (head number, (text matrix, metadata matrix))."""
    for n, words, stats, slots in zip(*(scan.column(b, c).to_pylist() for c in ("n", "words", "stats", "slots"))):
        if not n:
            continue
        raw = np.frombuffer(stats, "<f4").reshape(n, -1)
        xm = Head.meta_matrix(np.frombuffer(slots, "<u2").reshape(n, 3).astype(np.int64))
        for k, h in enumerate(heads):
            if h.text is not None:
                m = len(h.chosen)
                x = np.unpackbits(np.frombuffer(words[k], np.uint8).reshape(n, -1), axis=1, count=m) if m else np.zeros((n, 0))
                yield k, (np.hstack([x, np.clip((raw - h.mean) / h.scale, -5, 5)]), xm)


def summed(rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """Sums of the vectors of each (head, view), which come one a task."""

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, "<f8") for x in t.column("v").to_pylist())
        return pa.table({"head": t.column("head")[:1], "view": t.column("view")[:1], "v": pa.array([total.tobytes()], pa.binary())})

    return {(r.head, r.view): np.frombuffer(r.v, "<f8") for r in rows.groupBy("head", "view").applyInArrow(add, rows.schema).collect()}


def pool_pass(pool: DataFrame, heads: list[Head], size, visit) -> dict[tuple[int, int], np.ndarray]:
    """Sums over the pool of vectors by (head, view): ``visit`` adds a stored row's share."""
    shared = pool.sparkSession.sparkContext.broadcast(heads)

    def run(batches):
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for k, x in pool_views(b, shared.value):
                for view in (0, 1):
                    if (k, view) not in total:
                        total[k, view] = np.zeros(size(shared.value[k], view))
                    visit(total[k, view], shared.value[k], k, view, x)
        if total:
            yield pa.RecordBatch.from_pydict({"head": pa.array([k for k, _ in total], pa.int32()), "view": pa.array([v for _, v in total], pa.int32()), "v": [x.tobytes() for x in total.values()]})

    out = summed(pool.mapInArrow(run, "head int, view int, v binary"))
    shared.destroy()
    return out


def view_of(h: Head, view: int) -> Logistic:
    return h.meta if view else h.text


def co_train(pool: DataFrame, heads: list[Labelled], cfg: CoTrainConfig) -> None:
    """The rounds. A view's new fit uses the pseudo-labels of the other view's last fit; how sure a view
    is, is told by its calibrated logit, so a view that knows no more than the prior labels nothing."""
    for r in range(1, cfg.rounds + 1):
        for h in heads:
            if h.ready:
                h.calibrate()
        now = [h.head for h in heads]

        def count(total, h, k, view, x):
            total += np.bincount(bin_of(h.scales[view].logit(view_of(h, view).logit(x[view])[:, None])), minlength=BINS)

        counts = pool_pass(pool, now, lambda h, view: BINS, count)
        cuts = {key: cuts_of(c, cfg.share * r, cfg.sure) for key, c in counts.items()}
        teachers = {key: (view_of(now[key[0]], key[1]).w.copy(), now[key[0]].scales[key[1]].w.copy()) for key in cuts}
        for _ in range(cfg.steps):

            def slope(total, h, k, view, x):
                teacher = 1 - view
                w, (a, b) = teachers[k, teacher]
                if a <= 0:
                    return
                z = bin_of(np.clip(a * np.clip(x[teacher] @ w[:-1] + w[-1], -30, 30) + b, -30, 30))
                low, high = cuts[k, teacher]
                on = np.flatnonzero((z <= low) | (z >= high))
                xs, y = np.hstack([x[view][on], np.ones((len(on), 1))]), z[on] >= high
                own = np.clip(xs @ view_of(h, view).w, -30, 30)
                total[:-2] += xs.T @ (sigmoid(own) - y)
                total[-2] += np.logaddexp(0, own).sum() - own[y].sum()
                total[-1] += len(on)

            for (k, view), v in pool_pass(pool, [h.head for h in heads], lambda h, view: len(view_of(h, view).w) + 2, slope).items():
                heads[k].step(view, v[:-2], float(v[-2]), int(v[-1]))


@dataclass
class Model:
    quality: Head
    toxic: Head


def featured(docs: DataFrame) -> DataFrame:
    def run(batches):
        for c in scan.chunks(batches):
            ids, bounds = word_ids(scan.column(c, "text"))
            _, stats = statistics(scan.column(c, "text"))
            slots = meta_rows(*[scan.column(c, k).to_pylist() for k in ("lang", "source", "n_chars")])
            yield pa.RecordBatch.from_arrays(
                [
                    scan.column(c, "doc_id"),
                    scan.column(c, "quality"),
                    scan.column(c, "toxic"),
                    pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    pa.array([x.astype("<f8").tobytes() for x in stats], pa.binary()),
                    pa.array([x.astype("<i8").tobytes() for x in slots], pa.binary()),
                ],
                names=["doc_id", "quality", "toxic", "ids", "stats", "slots"],
            )

    return docs.select("doc_id", "quality", "toxic", "text", "lang", "source", "n_chars").mapInArrow(run, "doc_id long, quality int, toxic int, ids binary, stats binary, slots binary")


def selected(docs: DataFrame) -> DataFrame:
    """The columns the views use; absent metadata is null."""
    have = set(docs.columns)
    meta = [F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("source", "string"), ("n_chars", "long"))]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *meta)


def fit(docs: DataFrame, labels: DataFrame, cfg: CoTrainConfig = CoTrainConfig()) -> Model:
    docs = selected(docs)
    labels = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    some = labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(cfg.labelled)
    rows = featured(docs.join(F.broadcast(some), "doc_id"))
    got = rows.groupBy("doc_id").agg(F.min(F.struct("ids", "stats", "slots", "quality", "toxic")).alias("x")).select("doc_id", "x.*").toPandas().sort_values("doc_id")
    if not len(got):
        return Model(Head(), Head())
    each = [np.frombuffer(b, "<u4").astype(np.int64) for b in got.ids]
    flat = np.concatenate(each)
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])])
    stats = np.stack([np.frombuffer(b, "<f8") for b in got.stats])
    slots = np.stack([np.frombuffer(b, "<i8") for b in got.slots])
    ids = got.doc_id.to_numpy()
    heads = [Labelled(flat, bounds, stats, slots, got[name].fillna(-1).to_numpy().astype(np.int64), parts_of(ids), cfg) for name in ("quality", "toxic")]
    if any(h.ready for h in heads):
        pool = pool_features(docs, heads, ids)
        co_train(pool, heads, cfg)
        discard(pool)
    return Model(heads[0].finish(cfg, False), heads[1].finish(cfg, True))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, quality_score, toxic_score (0 to 1) and kept."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for c in scan.chunks(batches):
            ids, bounds = word_ids(scan.column(c, "text"))
            _, stats = statistics(scan.column(c, "text"))
            xm = Head.meta_matrix(meta_rows(*[scan.column(c, k).to_pylist() for k in ("lang", "source", "n_chars")]))
            s = [h.score(h.text_matrix(ids, bounds, stats), xm) if h.both else np.full(c.num_rows, h.prior) for h in (m.quality, m.toxic)]
            kept = np.ones(c.num_rows, dtype=bool)
            if m.quality.both:
                kept &= s[0] >= m.quality.threshold
            if m.toxic.both:
                kept &= s[1] <= m.toxic.threshold
            yield pa.RecordBatch.from_arrays([scan.column(c, "doc_id"), pa.array(s[0]), pa.array(s[1]), pa.array(kept)], names=["doc_id", "quality_score", "toxic_score", "kept"])

    return selected(docs).mapInArrow(run, "doc_id long, quality_score double, toxic_score double, kept boolean")
