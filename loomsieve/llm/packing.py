"""Related-document packing into fixed windows.

1. Texts become token ids (the tokenizer's, then id 0), kept as a table with a MinHash
   sketch over pairs of neighbouring words. Only distinct chunks of text are encoded:
   a text is cut before each single space that precedes a visible character, where
   byte-level pre-tokenization always cuts too, and known chunks are reused.
2. Rows are numbered in the global order of (sketch, doc_id, text hash). The
   nearest-neighbour graph: for each sketch value rows are sorted globally by (value,
   next value, number), and neighbours in that order with an equal value are linked,
   across partition borders too. No bucket is gathered, whatever its size, and each
   row has at most two links a value.
3. Greedy paths over the whole graph. Blocks of ``block`` consecutive numbers are walked
   first: from the unvisited row of lowest degree to the unvisited neighbour with most
   links, then lowest degree. Then paths that are linked by their ends are joined in
   rounds: a link joins two paths when both prefer it to all their other links (most
   links, lowest degrees, a hash), until no link is left between the ends of two paths.
   Places within joined paths are resolved from the last round back to the first, so no
   path is ever held in one row or task.
4. Windows are filled along the paths: the paths' documents form one stream of ids
   that is cut every ``size`` ids. Only the last window is short.

Null text counts as empty (one id, the 0). Repeated rows are packed each. Ties go by
doc_id, then a hash of the text; the result doesn't depend on how the input is split
into files or partitions. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import scan
from loomsieve.session import cut, discard, stored

U = np.uint64
AFTER_SPACE = np.zeros(256, dtype=bool)
AFTER_SPACE[0x21:0x7F] = True
AFTER_SPACE[0xC3:0xE0] = True  # two-byte characters, none of which is white space
KNOWN_MOST = 3_000_000
#: Odd numbers; times an evenly spread hash they order it in as many ways.
MULTIPLIERS = [scan.mix_int(k + 1) | 1 for k in range(64)]


@dataclass(frozen=True)
class PackConfig:
    tokenizer: str
    size: int = 1024
    sketch: int = 6
    block: int = 20_000


class Encoder:
    """Token ids of many texts, remembering those of each distinct chunk."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # bytes a token stands for: a character a byte, but for added tokens, which are given as text
        added = self.tokenizer.get_added_tokens_decoder()
        vocab = self.tokenizer.get_vocab()
        self.width = np.zeros(max(vocab.values()) + 1, dtype=np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.encode()) if i in added else len(token)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.at = np.zeros(0, dtype=np.int64)
        self.size = np.zeros(0, dtype=np.int64)
        self.pool = np.zeros(1 << 16, dtype=np.int32)
        self.used = 0

    def _tokens(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and how many each chunk has. Chunks that begin with a space before a visible character
        are encoded many at a time, as the tokenizer cuts there anyway; the ids are told apart by the
        bytes they stand for."""
        joins = [i > 0 and len(c) > 1 and c[0] == 32 and bool(AFTER_SPACE[c[1]]) for i, c in enumerate(chunks)]
        groups: list[list[bytes]] = []
        for c, more in zip(chunks, joins):
            if more and len(groups[-1]) < 1000:
                groups[-1].append(c)
            else:
                groups.append([c])
        texts = [b"".join(g).decode("utf-8", "replace") for g in groups]
        got = [np.array(e.ids, dtype=np.int32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.concatenate(got)
        ends = np.cumsum(self.width[ids])
        want = np.cumsum([len(c) for c in chunks])
        last = np.searchsorted(ends, want)
        if len(ids) and (ends[-1] != want[-1] or (ends[last] != want).any()):
            raise ValueError("the tokenizer's ids don't add up to the bytes of the text")
        return ids, np.diff(last + 1, prepend=0)

    def _learn(self, keys: np.ndarray, chunks: list[bytes]) -> None:
        ids, size = self._tokens(chunks)
        at = self.used + np.cumsum(size) - size
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(self.used + 2 * len(ids), dtype=np.int32)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        where = np.searchsorted(self.keys, keys)
        self.keys, self.at, self.size = np.insert(self.keys, where, keys), np.insert(self.at, where, at), np.insert(self.size, where, size)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and bounds by text; each text ends with id 0."""
        data, off = scan.buffer_of(texts)
        if len(self.keys) > KNOWN_MOST:
            self.forget()
        cut_ = np.zeros(len(data) + 1, dtype=bool)
        if len(data) > 1:
            cut_[:-2] = (data[:-1] == 32) & AFTER_SPACE[data[1:]]
        cut_[off] = True
        bounds = np.flatnonzero(cut_)
        start, end = bounds[:-1], bounds[1:]
        key = scan.span_hashes(data, start, end) + scan.mix((end - start).astype(np.uint64))
        distinct, first, back = np.unique(key, return_index=True, return_inverse=True)
        i = np.minimum(np.searchsorted(self.keys, distinct), max(len(self.keys) - 1, 0))
        new = self.keys[i] != distinct if len(self.keys) else np.ones(len(distinct), bool)
        if new.any():
            raw = data.tobytes()
            j = first[new]
            self._learn(distinct[new], [raw[x:y] for x, y in zip(start[j].tolist(), end[j].tolist())])
            i = np.searchsorted(self.keys, distinct)
        at, size = self.at[i][back], self.size[i][back]
        text = np.searchsorted(off, start, "right") - 1
        n = np.bincount(text, weights=size, minlength=len(texts)).astype(np.int64) + 1
        out_bounds = np.concatenate([[0], np.cumsum(n)])
        ids = np.zeros(out_bounds[-1], dtype=np.int32)
        keep = np.ones(len(ids), dtype=bool)
        keep[out_bounds[1:] - 1] = False
        ids[keep] = self.pool[scan.ranges(at, size)]
        return ids, out_bounds


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def sketches(texts: pa.Array, size: int) -> np.ndarray:
    """MinHash values over pairs of neighbouring words; texts without a pair get their own bytes' hash."""
    w = scan.Words(texts)
    h = w.hashes(fold_case=True)
    at, bounds = scan.windows(w.first, 2)
    g = scan.gram_hashes(h, at, 2)
    n = np.diff(bounds)
    out = np.empty((w.n, size), dtype=np.int64)
    whole = scan.signed(scan.span_hashes(w.data, w.off[:-1], w.off[1:]))
    some = np.flatnonzero(n)
    for k in range(size):
        out[:, k] = whole
        if len(some):
            out[some, k] = scan.signed(np.minimum.reduceat(g * U(MULTIPLIERS[k]), bounds[:-1][some]))
    return out


def tokenized(docs: DataFrame, cfg: PackConfig) -> DataFrame:
    """(row, doc_id, n, key, ids, sketch); ``row`` identifies the row within this table, ``key`` is a hash of
    the text."""

    def run(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 33
        enc = encoder(cfg.tokenizer)
        small = len(enc.tokenizer.get_vocab()) <= 1 << 16
        for c in scan.chunks(batches):
            ids, bounds = enc.encode(scan.column(c, "text"))
            ids = ids.astype("<u2" if small else "<u4")
            s = sketches(scan.column(c, "text"), cfg.sketch)
            data, off = scan.buffer_of(scan.column(c, "text"))
            m = c.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.arange(row, row + m)),
                    scan.column(c, "doc_id"),
                    pa.array(np.diff(bounds)),
                    pa.array(scan.signed(scan.span_hashes(data, off[:-1], off[1:]))),
                    pa.array([ids[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary()),
                    pa.ListArray.from_arrays(pa.array(np.arange(m + 1) * cfg.sketch, pa.int32()), pa.array(s.ravel())),
                ],
                names=["row", "doc_id", "n", "key", "ids", "sketch"],
            )
            row += m

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(docs.mapInArrow(run, "row long, doc_id long, n long, key long, ids binary, sketch array<long>"), "tokens")


def numbered(ordered: DataFrame, n: str | None = None) -> DataFrame:
    """A sorted frame with a global running number ``at``: rows before it, or the sum of
    column ``n`` before it. Only totals by partition reach the driver."""
    names = ordered.columns

    def run(batches):
        from pyspark import TaskContext

        part, place = TaskContext.get().partitionId(), 0
        for b in batches:
            if b.num_rows:
                size = scan.column(b, n).to_numpy() if n else np.ones(b.num_rows, dtype=np.int64)
                ends = place + np.cumsum(size)
                place = int(ends[-1])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(ends - size), pa.array(ends)], names=[*names, "part", "local", "end"])

    kinds = ", ".join(f"{c} {t}" for c, t in ordered.dtypes)
    placed = cut(ordered.mapInArrow(run, f"{kinds}, part long, local long, end long"))
    totals = {r.part: r.end for r in placed.groupBy("part").agg(F.max("end").alias("end")).collect()}
    base, at = [], 0
    for p in sorted(totals):
        base.append((p, at))
        at += totals[p]
    offsets = ordered.sparkSession.createDataFrame(base or [(0, 0)], "part long, base long")
    return placed.join(F.broadcast(offsets), "part").select(*names, (F.col("local") + F.col("base")).alias("at"))


def nodes(tokens: DataFrame) -> DataFrame:
    """(node, row, n, sketch): rows numbered in the order of their sketches."""
    slim = tokens.select("row", "n", "sketch", "doc_id", "key").orderBy("sketch", "doc_id", "key", "row")
    return numbered(slim).select(F.col("at").alias("node"), "row", "n", "sketch")


def neighbours(numbered_: DataFrame, cfg: PackConfig) -> DataFrame:
    """(u, v, strength, du, dv): links u < v, how many sketch values link them, and the degrees."""
    keyed = numbered_.select("node", F.posexplode("sketch").alias("k", "value"), "sketch")
    keyed = keyed.select("k", "value", F.element_at("sketch", F.pmod(F.col("k") + 1, F.lit(cfg.sketch)).cast("int") + 1).alias("next"), "node")

    def link(batches):
        from pyspark import TaskContext

        part, last, first = TaskContext.get().partitionId(), None, True
        row = lambda k, v, x, y, p: pa.RecordBatch.from_pydict({"k": pa.array(k, pa.int32()), "value": v, "u": x, "v": y, "part": pa.array(p, pa.int32())})
        for b in batches:
            if not b.num_rows:
                continue
            k, v, r = (scan.column(b, c).to_numpy() for c in ("k", "value", "node"))
            if first:  # the border with the partition before
                yield row(k[:1], v[:1], r[:1], r[:1], [2 * part])
                first = False
            if last is not None:
                k, v, r = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], v]), np.concatenate([[last[2]], r])
            on = (k[1:] == k[:-1]) & (v[1:] == v[:-1])
            x, y = r[:-1][on], r[1:][on]
            last = (k[-1], v[-1], r[-1])
            yield row(k[1:][on], v[1:][on], np.minimum(x, y), np.maximum(x, y), np.full(len(x), -1))
        if last is not None:
            yield row([last[0]], [last[1]], [last[2]], [last[2]], [2 * part + 1])

    met = cut(keyed.orderBy("k", "value", "next", "node").mapInArrow(link, "k int, value long, u long, v long, part int"))
    borders = sorted(met.where("part >= 0").collect(), key=lambda r: r.part)
    across = [(min(a.u, b.u), max(a.u, b.u)) for a, b in zip(borders, borders[1:]) if a.part % 2 and not b.part % 2 and (a.k, a.value) == (b.k, b.value)]
    links = met.where("part < 0").select("u", "v").union(numbered_.sparkSession.createDataFrame(across, "u long, v long"))
    links = cut(links.groupBy("u", "v").agg(F.count(F.lit(1)).alias("strength")))
    degree = cut(links.select(F.explode(F.array("u", "v")).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("d")))
    return cut(links.join(degree.select(F.col("node").alias("u"), F.col("d").alias("du")), "u").join(degree.select(F.col("node").alias("v"), F.col("d").alias("dv")), "v"))


def walk(rows: np.ndarray, u: np.ndarray, v: np.ndarray, strength: np.ndarray, du: np.ndarray, dv: np.ndarray) -> list[list[int]]:
    """Greedy paths (lists of indices) over sorted rows: each starts at the unvisited row of lowest degree
    and steps to the unvisited neighbour with most links, then lowest degree."""
    u, v = np.searchsorted(rows, u), np.searchsorted(rows, v)
    degree = np.zeros(len(rows), dtype=np.int64)
    degree[u], degree[v] = du, dv
    x, y, s = np.concatenate([u, v]), np.concatenate([v, u]), np.concatenate([strength, strength])
    by = np.lexsort((y, degree[y], -s, x))
    x, y = x[by], y[by].tolist()
    at = np.searchsorted(x, np.arange(len(rows) + 1)).tolist()
    seen = [False] * len(rows)
    out = []
    for i in np.lexsort((rows, degree)).tolist():
        path: list[int] = []
        while i is not None and not seen[i]:
            seen[i] = True
            path.append(i)
            i = next((j for j in y[at[i] : at[i + 1]] if not seen[j]), None)
        if path:
            out.append(path)
    return out


def local_paths(numbered_: DataFrame, links: DataFrame, cfg: PackConfig) -> DataFrame:
    """(node, row, n, frag, off, len, left, right): each node's path, named by its first node, and its
    place there in ids; the path's length and ends."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        by = np.argsort(left.column("node").to_numpy())
        node, row, n = (left.column(c).to_numpy()[by] for c in ("node", "row", "n"))
        paths = walk(node, *(right.column(c).to_numpy() for c in ("u", "v", "strength", "du", "dv")))
        order = np.array([i for p in paths for i in p], dtype=np.int64)
        size = np.array([len(p) for p in paths], dtype=np.int64)
        first = np.cumsum(size) - size
        ends = np.cumsum(n[order]) if len(order) else order
        begin = ends - n[order]
        spread = lambda x: np.repeat(x, size)
        head, tail = node[order][first], node[order][first + size - 1]
        total = ends[first + size - 1] - begin[first]
        return pa.table({"node": node[order], "row": row[order], "n": n[order], "frag": spread(head), "off": begin - spread(begin[first]), "len": spread(total), "left": spread(head), "right": spread(tail)})

    block = lambda c: F.floor(F.col(c) / cfg.block).cast("long").alias("block")
    inner = links.where(F.floor(F.col("u") / cfg.block) == F.floor(F.col("v") / cfg.block)).select("*", block("u"))
    every = numbered_.select("node", "row", "n", block("node"))
    return cut(every.groupBy("block").cogroup(inner.groupBy("block")).applyInArrow(run, "node long, row long, n long, frag long, off long, len long, left long, right long"))


def joined(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(child, root, off, flip): where each path lies that was joined to others. In each round a link joins
    two paths if it is the best of both; the order of links is total, so every round joins some and no
    cycle can close."""
    ends = placed.where("node = left or node = right").select("node", F.struct("frag", "len", "left", "right").alias("p"))
    side = lambda c, p: ends.select(F.col("node").alias(c), F.col("p").alias(p))
    low, high = F.least("du", "dv"), F.greatest("du", "dv")
    rank = F.struct((-F.col("strength")).alias("s"), low.alias("low"), high.alias("high"), F.xxhash64("u", "v").alias("h"))
    live = links.select("u", "v", rank.alias("rank")).join(side("u", "a"), "u").join(side("v", "b"), "v").where("a.frag <> b.frag").select("rank", "u", "v", "a", "b")
    live = stored(live, "links")
    merges: list[DataFrame] = []
    while True:
        link = F.struct("rank", "u", "v", "a", "b")
        best = live.select(F.explode(F.array("a.frag", "b.frag")).alias("f"), link.alias("e")).groupBy("f").agg(F.min("e").alias("e"))
        both = best.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("e.*")
        # the path of u, turned so that u ends it, then that of v, turned so that v begins it
        turned_a, turned_b = F.col("a.right") != F.col("u"), F.col("b.left") != F.col("v")
        whole = F.struct(
            F.col("a.frag").alias("frag"),
            (F.col("a.len") + F.col("b.len")).alias("len"),
            F.when(turned_a, F.col("a.right")).otherwise(F.col("a.left")).alias("left"),
            F.when(turned_b, F.col("b.left")).otherwise(F.col("b.right")).alias("right"),
        )
        child = lambda p, off, flip: F.struct(F.col(f"{p}.frag").alias("child"), F.col(f"{p}.len").alias("size"), off.alias("off"), flip.alias("flip"))
        two = F.array(child("a", F.lit(0).cast("long"), turned_a), child("b", F.col("a.len"), turned_b))
        step = stored(both.select(whole.alias("p"), F.explode(two).alias("c")).select("c.*", "p"), "joined")
        if step.isEmpty():
            break
        merges.append(step)
        now = lambda p: step.select(F.col("child").alias(f"{p}_"), F.col("p").alias(f"new_{p}"))
        before, live = live, live.join(now("a"), F.col("a.frag") == F.col("a_"), "left").join(now("b"), F.col("b.frag") == F.col("b_"), "left")
        live = live.select("rank", "u", "v", F.coalesce("new_a", "a").alias("a"), F.coalesce("new_b", "b").alias("b"))
        live = stored(live.where("a.frag <> b.frag and (u = a.left or u = a.right) and (v = b.left or v = b.right)"), "links")
        discard(before)
    if not merges:
        return placed.sparkSession.createDataFrame([], "child long, root long, off long, flip boolean")
    out = None
    for step in reversed(merges):
        own = step.select(F.col("p.frag").alias("parent"), F.col("p.len").alias("whole"), "child", "size", "off", "flip")
        if out is None:
            out = own.select("child", F.col("parent").alias("root"), "off", "flip")
            continue
        above = out.select(F.col("child").alias("above"), "root", F.col("off").alias("base"), F.col("flip").alias("turn"))
        both = own.join(above, F.col("parent") == F.col("above"), "full")
        off = F.when(F.coalesce("turn", F.lit(False)), F.col("whole") - F.col("off") - F.col("size")).otherwise(F.col("off")) + F.coalesce("base", F.lit(0))
        out = stored(both.select(
            F.coalesce("child", "above").alias("child"),
            F.coalesce("root", "parent").alias("root"),
            F.when(F.col("child").isNull(), F.col("base")).otherwise(off).alias("off"),
            F.when(F.col("child").isNull(), F.col("turn")).otherwise(F.col("flip") != F.coalesce("turn", F.lit(False))).alias("flip"),
        ), "placed")
    return out


def paths(tokens: DataFrame, cfg: PackConfig) -> tuple[DataFrame, DataFrame]:
    """(node, row, n, root, off): each row's path, named by one of its nodes, and its place there in ids;
    and the links."""
    every = nodes(tokens)
    links = neighbours(every, cfg)
    placed = local_paths(every, links, cfg)
    moved = joined(links, placed).select(F.col("child").alias("frag"), "root", F.col("off").alias("base"), "flip")
    both = placed.join(moved, "frag", "left")
    off = F.when(F.coalesce("flip", F.lit(False)), F.col("len") - F.col("off") - F.col("n")).otherwise(F.col("off")) + F.coalesce("base", F.lit(0))
    return both.select("node", "row", "n", F.coalesce("root", "frag").alias("root"), off.alias("off")), links


def laid_out(tokens: DataFrame, cfg: PackConfig) -> DataFrame:
    """(row, begin): where each document starts in the one stream of ids."""
    placed, _ = paths(tokens, cfg)
    return numbered(placed.select("row", "n", "root", "off").orderBy("root", "off"), "n").select("row", F.col("at").alias("begin"))


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, cfg: PackConfig, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and the ids)."""
    tokens = tokenized(docs, cfg)
    placed = laid_out(tokens, cfg)
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def run(batches):
        for b in batches:
            out = []
            for doc, n, raw, begin in zip(*(scan.column(b, c).to_pylist() for c in ("doc_id", "n", "ids", "begin"))):
                ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(begin + start, cfg.size)
                    m = min(cfg.size - off, n - start)
                    piece = ids[start : start + m].tobytes()
                    out.append((doc, start, m, zlib.crc32(piece), n, seq, off, piece if with_ids else None))
                    start += m
            cols = list(zip(*out)) or [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for c, k in zip(cols, names)], names=names)

    out = tokens.select("row", "doc_id", "n", "ids").join(placed, "row").select("doc_id", "n", "ids", "begin").mapInArrow(run, SCHEMA)
    return out if with_ids else out.drop("ids")
