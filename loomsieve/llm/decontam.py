"""Benchmark decontamination: n-gram seeds, then Smith-Waterman alignment.

Test items are cut into n-word grams and every gram is a seed, however many documents
hold it: neither a leak into a third of the corpus nor many edited copies can unseed an
item. One pass finds seeds in the documents, gathers hits of one item that lie within a
window, and aligns that window with the item by words, unless too few of the item's
words occur in it for any alignment to reach the threshold. The score is the share of
the item's words that the best local alignment matches.

Items are joined in blocks of at most ``block`` grams, so what is broadcast has a
fixed size; every document meets every block. Text is never shuffled. Null and empty
texts match nothing. Items of fewer than ``least_words`` words never match: a name or a
number stands in many clean documents. A null item_id stays null. Repeated rows (documents or items) are matched each. Ties: the leftmost
placement. Other columns don't matter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import scan

MATCH, MISMATCH, GAP = 2, -1, -1


@dataclass(frozen=True)
class DecontamConfig:
    n: int = 3
    least_seeds: int = 2
    threshold: float = 0.5
    least_words: int = 8
    stretch: float = 1.5
    block: int = 400_000


class Items:
    """Seeds of a block of items: sorted gram hashes with (item, place) postings."""

    def __init__(self, ids: list[int | None], texts: list[str | None], cfg: DecontamConfig) -> None:
        self.cfg = cfg
        w = scan.Words(pa.array(texts, pa.string()), scan.ALNUM)
        h = w.hashes(fold_case=True)
        self.ids = ids
        self.words = [h[w.first[i] : w.first[i + 1]] for i in range(w.n)]
        gram, item, place, width = [], [], [], []
        for i, x in enumerate(self.words):
            k = min(cfg.n, len(x))
            if k and len(x) >= cfg.least_words:
                g = scan.gram_hashes(x, np.arange(len(x) - k + 1), k)
                gram.append(g)
                item.append(np.full(len(g), i))
                place.append(np.arange(len(g)))
                width.append(np.full(len(g), k))
        cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
        self.gram, self.item, self.place, self.width = cat(gram, np.uint64), cat(item, np.int64), cat(place, np.int64), cat(width, np.int64)
        self.index()

    def index(self) -> None:
        by = np.argsort(self.gram, kind="stable")
        self.gram, self.item, self.place, self.width = self.gram[by], self.item[by], self.place[by], self.width[by]
        self.keys = np.unique(self.gram)
        self.from_ = np.searchsorted(self.gram, np.append(self.keys, np.uint64(0)))
        self.from_[-1] = len(self.gram)

    def hits(self, w: scan.Words, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(word index, key index) of grams in the chunk that are keys."""
        at_all, key_all = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in np.unique(self.width):
            at, _ = scan.windows(w.first, int(k))
            g = scan.gram_hashes(h, at, int(k))
            i = np.minimum(np.searchsorted(self.keys, g), len(self.keys) - 1)
            on = self.keys[i] == g
            at_all.append(at[on])
            key_all.append(i[on])
        return np.concatenate(at_all), np.concatenate(key_all)


def smith_waterman(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int]:
    """(matched words, first, last + 1) of the best local alignment's span in the text."""
    m, n = len(item), len(text)
    score = np.zeros((m + 1, n + 1), dtype=np.int32)
    cols = np.arange(1, n + 1, dtype=np.int32)
    for i in range(1, m + 1):
        best = np.maximum(score[i - 1, :-1] + np.where(text == item[i - 1], MATCH, MISMATCH), score[i - 1, 1:] + GAP)
        np.maximum(best, 0, out=best)
        # gaps within the item's row: a running maximum of score plus place
        score[i, 1:] = np.maximum.accumulate(best - GAP * cols) + GAP * cols
    i, j = np.unravel_index(int(score.argmax()), score.shape)
    matched, end = 0, int(j)
    while i > 0 and j > 0 and score[i, j] > 0:
        same = text[j - 1] == item[i - 1]
        if score[i, j] == score[i - 1, j - 1] + (MATCH if same else MISMATCH):
            matched += bool(same)
            i, j = i - 1, j - 1
        elif score[i, j] == score[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return matched, int(j), end


def match_chunk(items: Items, w: scan.Words, h: np.ndarray, most: int = 2_000_000) -> list[tuple[int, int, float, int, int, int]]:
    """(text, item, score, first word, last word + 1, seeds) of verified passages. Texts are taken
    in slices of about ``most`` seed hits, as a common gram may stand in many items."""
    at, key = items.hits(w, h)
    if not len(at):
        return []
    by = np.argsort(at, kind="stable")
    at, key = at[by], key[by]
    text = np.searchsorted(w.first, at, "right") - 1
    size = np.cumsum(items.from_[key + 1] - items.from_[key])
    new = np.flatnonzero(text[1:] != text[:-1]) + 1
    cuts, taken = [0], 0
    for i, n in zip(np.append(new, len(at)).tolist(), size[np.append(new, len(at)) - 1].tolist()):
        if n - taken >= most or i == len(at):
            cuts.append(i)
            taken = n
    return [r for lo, hi in zip(cuts, cuts[1:]) for r in match_hits(items, w, h, at[lo:hi], key[lo:hi])]


def match_hits(items: Items, w: scan.Words, h: np.ndarray, at: np.ndarray, key: np.ndarray) -> list[tuple[int, int, float, int, int, int]]:
    cfg = items.cfg
    count = items.from_[key + 1] - items.from_[key]
    posting = scan.ranges(items.from_[key], count)
    at = np.repeat(at, count)
    item, place = items.item[posting], items.place[posting]
    text = np.searchsorted(w.first, at, "right") - 1
    by = np.lexsort((at - place, item, text))
    at, item, place, text = at[by], item[by], place[by], text[by]
    start = at - place
    size = np.array([len(x) for x in items.words])
    near = (size[item] * (cfg.stretch - 1)).astype(np.int64) + 2
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > near[1:])])
    cuts = np.flatnonzero(new)
    wide = int(size.max()) + 1
    seeds_of = np.bincount(np.unique((np.cumsum(new) - 1) * wide + place) // wide, minlength=len(cuts))
    need = np.minimum(cfg.least_seeds, np.maximum(1, size[item[cuts]] - cfg.n + 1))
    best: dict[tuple[int, int], tuple[float, int, int, int]] = {}
    ends = np.append(cuts[1:], len(at))
    for c in np.flatnonzero(seeds_of >= need).tolist():
        lo, hi = int(cuts[c]), int(ends[c])
        k, d = int(item[lo]), int(text[lo])
        words = items.words[k]
        seeds = int(seeds_of[c])
        if best.get((d, k), (0.0,))[0] == 1.0:
            continue
        pad = int(near[lo])
        low = max(int(w.first[d]), int(start[lo:hi].min()) - pad)
        high = min(int(w.first[d + 1]), int(start[lo:hi].max()) + len(words) + pad)
        # a run of placements longer than the item is aligned in overlapping windows
        step = max(4 * len(words), 512)
        for a in range(low, max(low + 1, high), step):
            b = min(high, a + step + 2 * len(words))
            # no alignment matches more of the item's words than occur in the window
            if np.isin(words, h[a:b]).sum() < cfg.threshold * len(words):
                continue
            matched, x, y = smith_waterman(words, h[a:b])
            got = (matched / len(words), a + x - int(w.first[d]), a + y - int(w.first[d]), seeds)
            if got[0] >= cfg.threshold and got[0] > best.get((d, k), (0.0,))[0]:
                best[d, k] = got
    return [(d, k, *v) for (d, k), v in best.items()]


def item_blocks(benchmark: DataFrame, cfg: DecontamConfig):
    """Blocks of items by bounded word count. The stated query set streams through the driver one
    block at a time."""
    ids: list[int | None] = []
    texts: list[str | None] = []
    size = 0
    for r in benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(r.item_id)
        texts.append(r.text)
        size += len((r.text or "").split()) + 1
        if size > cfg.block:
            yield Items(ids, texts, cfg)
            ids, texts, size = [], [], 0
    if ids:
        yield Items(ids, texts, cfg)


SCHEMA = "doc_id long, item_id long, score double, first_word long, end_word long, n_seeds long"


def prepared(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig):
    for items in item_blocks(benchmark, cfg):
        if len(items.keys):
            yield docs.sparkSession.sparkContext.broadcast(items)


def matches(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """One row a contaminated (document, item)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for shared in prepared(docs, benchmark, cfg):

        def run(batches, shared=shared):
            items = shared.value
            for c in scan.chunks(batches):
                w = scan.Words(scan.column(c, "text"), scan.ALNUM)
                rows = match_chunk(items, w, w.hashes(fold_case=True))
                ids = scan.column(c, "doc_id").to_pylist()
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
                cols = list(zip(*[(ids[d], items.ids[k], s, a, b, n) for d, k, s, a, b, n in rows])) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, kinds)], names=["doc_id", "item_id", "score", "first_word", "end_word", "n_seeds"])

        part = docs.mapInArrow(run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, cfg: DecontamConfig = DecontamConfig()) -> DataFrame:
    """The rows without a contaminated passage, with all their columns, without a shuffle."""
    schema = docs.schema
    for shared in prepared(docs, benchmark, cfg):

        def run(batches, shared=shared):
            for c in scan.chunks(batches):
                w = scan.Words(scan.column(c, "text"), scan.ALNUM)
                bad = {r[0] for r in match_chunk(shared.value, w, w.hashes(fold_case=True))}
                yield c.filter(pa.array([i not in bad for i in range(c.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, schema)
    return docs
