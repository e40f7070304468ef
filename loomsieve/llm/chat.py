"""Transcript parsing with a hidden Markov model, then canonical turn rendering.

A transcript arrives as ordered rows (conv_id, turn, text). A row may hold any number of
turns and a turn any number of rows: the parser sees one stream of lines a conversation,
in which lines may or may not carry speaker markers, and isn't told where rows begin.
Every line is observed as (marker, question, length); the hidden states are a role's first
line or a later line. Emissions and transitions are smoothed counts over all labelled
rows. Viterbi recovers the most likely roles and turn boundaries of a whole conversation.

Rendering opens and closes turns where the states say so. A marker is cut off only from
a decoded first line whose marker names the decoded role; all other text stays. Control
tokens in the text (``<|``) get a backslash, which ``unescape`` takes away again.

Conversations may be of any length, a third of all rows included: rows are sorted
globally, every partition reduces its leading and trailing conversation to a max-plus
matrix over states, one small pass over partitions joins them, and each partition is
then decoded with its known entry scores and exit state. That equals Viterbi over the
whole conversation. A task holds one partition's rows of a conversation at most.

Null text is one empty line; rows of null conv_id are one conversation; rows with equal
(conv_id, turn) follow in text order; other columns don't matter. A table without
labelled rows gives a model without preferences.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomsieve.llm import scan
from loomsieve.session import cut

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # first line, later line of each role
NAMES = {
    "system": "system|instructions?|context",
    "user": "user|human|you|q|question|prompter|customer|me",
    "assistant": "assistant|ai|bot|a|answer|gpt|model|agent|support",
}
_NAME = "(?:(" + ")|(".join(NAMES[r] for r in ROLES) + "))"
#: "User:", "### User:", "**User:**", "User >", a line "User"; "<user>", "<|user|>"; "[user]"
MARKER = re.compile(rf"^\s*(?:(?:#{{1,4}}\s*|\*{{1,2}})?{_NAME}\s*(?:\*{{1,2}})?\s*(?::\**|>|\||$)|<\|?{_NAME}\|?>:?|\[{_NAME}\]:?)\s*", re.IGNORECASE)
SIZES = 7
OBSERVATIONS = (len(ROLES) + 1) * 2 * SIZES
OPEN, END = "<|{}|>\n", "<|end|>\n"


def marker_of(line: str) -> tuple[int, int]:
    """(1 + the role that a marker at the line's start names, where the marker ends), or (0, 0)."""
    m = MARKER.match(line)
    return ((m.lastindex - 1) % len(ROLES) + 1, m.end()) if m else (0, 0)


def observe(line: str) -> int:
    question = line.rstrip().endswith("?")
    n = len(line)
    return (marker_of(line)[0] * 2 + question) * SIZES + min(n // 20, 32).bit_length()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


@dataclass
class Hmm:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray

    @classmethod
    def from_counts(cls, start, step, emit, smooth: float = 0.5) -> Hmm:
        norm = lambda c: np.log((c + smooth) / (c + smooth).sum(axis=-1, keepdims=True))
        allowed = np.ones((STATES, STATES), dtype=bool)
        for s in range(len(ROLES)):
            for r in range(len(ROLES)):
                allowed[r * 2 + 1, s * 2 + 1] = r == s  # a later line follows its own role
                allowed[r * 2, s * 2 + 1] = r == s
        begin = np.zeros(STATES)
        begin[::2] = norm(start[::2])
        begin[1::2] = -np.inf
        return cls(begin, np.where(allowed, norm(step), -np.inf), norm(emit))

    def advance(self, v: np.ndarray, obs: list[int]) -> np.ndarray:
        """Best scores after more lines; ``v`` is a vector, or one row an entry state."""
        for o in obs:
            v = (v[..., :, None] + self.step).max(axis=-2) + self.emit[:, o]
        return v

    def begin(self, obs: list[int]) -> np.ndarray:
        return self.advance(self.start + self.emit[:, obs[0]], obs[1:])

    def decode(self, obs: list[int], entry: np.ndarray | None, exit_: int | None) -> list[int]:
        """States of consecutive lines, given scores before them (None: a conversation starts) and the
        last state (None: the best)."""
        v = self.start + self.emit[:, obs[0]] if entry is None else (entry[:, None] + self.step).max(axis=0) + self.emit[:, obs[0]]
        back = []
        for o in obs[1:]:
            t = v[:, None] + self.step
            back.append(t.argmax(axis=0))
            v = t.max(axis=0) + self.emit[:, o]
        s = int(v.argmax()) if exit_ is None else exit_
        out = [s]
        for b in reversed(back):
            s = int(b[s])
            out.append(s)
        return out[::-1]


def fit(rows: DataFrame) -> Hmm:
    """Counts over labelled rows (conv_id, turn, role, text), a row a turn. Transitions between rows
    that lie in two partitions of the sorted rows are added on the driver, one a partition."""
    a, b = STATES, STATES + STATES**2

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        flat = np.zeros(b + STATES * OBSERVATIONS)
        last, prev, first = None, -1, None
        for batch in batches:
            for conv, role, text in zip(*(scan.column(batch, c).to_pylist() for c in ("conv_id", "role", "text"))):
                new = last is None or (conv,) != last
                last = (conv,)
                if role not in ROLES:
                    prev = -1
                    first = first or (conv, -1)
                    continue
                r = ROLES.index(role)
                for i, line in enumerate(lines_of(text)):
                    s = 2 * r + (i > 0)
                    flat[b + s * OBSERVATIONS + observe(line)] += 1
                    if i == 0 and first is None:
                        first = (conv, s)
                    elif i == 0 and new:
                        flat[s] += 1
                    elif prev >= 0:
                        flat[a + prev * STATES + s] += 1
                    prev = s
        at = np.flatnonzero(flat)
        border = [(part, *first, last[0], prev)] if last is not None else []
        cols = [pa.array([x[i] for x in border] + [None] * len(at), pa.int64()) for i in range(5)]
        yield pa.RecordBatch.from_arrays([pa.array([-1] * len(border) + at.tolist(), pa.int64()), pa.array([0.0] * len(border) + flat[at].tolist()), *cols], names=["at", "n", "part", "first", "enter", "last", "leave"])

    flat = np.zeros(b + STATES * OBSERVATIONS)
    keyed = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text").orderBy("conv_id", "turn", "text")
    counted = cut(keyed.mapInArrow(run, "at long, n double, part long, first long, enter long, last long, leave long"))
    for r in counted.where("at >= 0").groupBy("at").agg(F.sum("n").alias("n")).collect():
        flat[r["at"]] = r["n"]
    before = None
    for r in sorted(counted.where("at < 0").collect(), key=lambda r: r.part):
        if r.enter >= 0 and (before is None or before.last != r.first):
            flat[r.enter] += 1
        elif r.enter >= 0 and before.leave >= 0:
            flat[a + before.leave * STATES + r.enter] += 1
        before = r
    return Hmm.from_counts(flat[:a], flat[a:b].reshape(STATES, STATES), flat[b:].reshape(STATES, OBSERVATIONS))


def _runs(batches):
    """(conv, [rows]) of consecutive rows of one conversation within a partition; long conversations
    come in several pieces of bounded size."""
    last, held, size = None, [], 0
    for b in batches:
        for row in zip(*(scan.column(b, c).to_pylist() for c in ("conv_id", "turn", "text"))):
            if held and (row[0] != last or size > 1 << 20):
                yield last, held
                held, size = [], 0
            last = row[0]
            held.append(row)
            size += len(row[2] or "") + 50
    if held:
        yield last, held


def _observed(rows) -> list[int]:
    return [observe(line) for r in rows for line in lines_of(r[2])]


SCHEMA = "conv_id long, turn long, part long, first_line long, n_lines long, role string, opens boolean, rendered string"


def parse(rows: DataFrame, model: Hmm) -> DataFrame:
    """One row a turn within an input row: conv_id, turn (the row's), part (0 for its first turn),
    first_line and n_lines (there), role, opens (false where a turn goes on from the row before), rendered.
    A conversation's rendered parts in order, put together, are its canonical transcript."""
    spark = rows.sparkSession
    ordered = cut(rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text").orderBy("conv_id", "turn", "text"))
    shared = spark.sparkContext.broadcast(model)

    def reduce_(batches):
        from pyspark import TaskContext

        m = shared.value
        first = last = None
        n, head, tail = 0, None, None
        for conv, held in _runs(batches):
            obs = _observed(held)
            if n and conv == last:
                if tail is None:
                    head = m.advance(head, obs)
                else:
                    tail = m.advance(tail, obs)
            elif not n:
                first, head = conv, m.advance(np.where(np.eye(STATES, dtype=bool), 0.0, -np.inf), obs)
                own = m.begin(obs)
            else:
                tail = m.begin(obs)
            if n and tail is None:
                own = m.advance(own, obs)
            last, n = conv, n + 1
        if n:
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "first": pa.array([first], pa.int64()), "last": pa.array([last], pa.int64()), "head": [head.tobytes()], "own": [own.tobytes()], "tail": pa.array([None if tail is None else tail.tobytes()], pa.binary())}
            )

    parts = sorted(ordered.mapInArrow(reduce_, "part int, first long, last long, head binary, own binary, tail binary").collect(), key=lambda r: r.part)
    entry: dict[int, np.ndarray | None] = {}
    out: dict[int, np.ndarray] = {}
    for i, p in enumerate(parts):
        joined = i > 0 and parts[i - 1].last == p.first
        entry[p.part] = out[parts[i - 1].part] if joined else None
        v = (entry[p.part][:, None] + np.frombuffer(p.head).reshape(STATES, STATES)).max(axis=0) if joined else np.frombuffer(p.own)
        out[p.part] = v if p.tail is None else np.frombuffer(p.tail)
    exit_: dict[int, int | None] = {}
    enter: dict[int, int | None] = {}  # the state before a partition's leading conversation
    for i in range(len(parts) - 1, -1, -1):
        p = parts[i]
        follows = i + 1 < len(parts) and parts[i + 1].first == p.last
        exit_[p.part] = enter[parts[i + 1].part] if follows else None
        if entry[p.part] is None:
            enter[p.part] = None
            continue
        through = entry[p.part][:, None] + np.frombuffer(p.head).reshape(STATES, STATES)
        end = exit_[p.part] if p.tail is None and exit_[p.part] is not None else int(through.max(axis=0).argmax())
        enter[p.part] = int(through[:, end].argmax())
    goes_on = {p.part for p, after in zip(parts, parts[1:]) if after.first == p.last}
    known = spark.sparkContext.broadcast((entry, exit_, goes_on))

    def decode(batches):
        from pyspark import TaskContext

        m, (entry, exit_, goes_on) = shared.value, known.value
        me = TaskContext.get().partitionId()
        # a conversation's pieces are kept as observations until it ends, then decoded and rendered
        group: list[list] = []
        at, leading = None, True

        def flush(final: bool):
            rows_ = [r for piece in group for r in piece]
            states = m.decode(_observed(rows_), entry[me] if leading else None, exit_[me] if final else None)
            more = leading and entry[me] is not None  # the conversation began in an earlier partition
            done = not (final and me in goes_on)
            out: list[list] = []
            i = 0
            for k, (conv, turn, text) in enumerate(rows_):
                begin = len(out)
                for j, line in enumerate(lines_of(text)):
                    role, opens = ROLES[states[i] // 2], states[i] % 2 == 0
                    i += 1
                    if opens or j == 0:
                        out.append([conv, turn, len(out) - begin, j, 0, role, opens, [(END if more else "") + OPEN.format(role)] if opens else []])
                        more = True
                    named, end = marker_of(line)
                    out[-1][4] += 1
                    out[-1][7].append(escape(line[end:] if opens and named and ROLES[named - 1] == role else line) + "\n")
                if done and k == len(rows_) - 1:
                    out[-1][7].append(END)
            for r in out:
                r[7] = "".join(r[7])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in SCHEMA.split(", ")])

        for conv, held in _runs(batches):
            if group and conv != at:
                yield flush(False)
                group, leading = [], False
            at = conv
            group.append(held)
        if group:
            yield flush(True)

    return ordered.mapInArrow(decode, SCHEMA)


MARKS = ("User: |Assistant: |System: ", "### Human: |### Assistant: |### System: ", "Q: |A: |Context: ", "[user] |[assistant] |[system] ")


def with_markers(rows: DataFrame, every: int = 4) -> DataFrame:
    """Labelled turns as they would stand in raw transcripts: a marker style a conversation, and no
    marker on about one turn in ``every``."""
    style = F.pmod(F.xxhash64("conv_id"), F.lit(len(MARKS)))
    k = F.when(F.col("role") == "user", 0).when(F.col("role") == "assistant", 1).otherwise(2)
    mark = F.element_at(F.split(F.element_at(F.array(*[F.lit(m) for m in MARKS]), style.cast("int") + 1), r"\|"), k + 1)
    bare = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(every)) == 0
    return rows.withColumn("text", F.when(bare | F.col("role").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.concat(mark, F.coalesce("text", F.lit("")))))


def joined(rows: DataFrame, turns: int = 8, most: int = 1 << 16) -> DataFrame:
    """(conv_id, turn, text): raw transcripts, the texts of up to ``turns`` consecutive turns as one. A text
    ends where ``turn`` reaches a multiple of ``turns``, so the cuts don't depend on partitions; rows of one
    such text that exceed ``most`` characters, or that a partition's border parts, are several texts."""

    def run(batches):
        held, key, size = [], None, 0
        out: list[tuple] = []
        for b in batches:
            for conv, turn, text in zip(*(scan.column(b, c).to_pylist() for c in ("conv_id", "turn", "text"))):
                mine = (conv, None if turn is None else turn // turns)
                if held and (mine != key or size > most):
                    out.append((*held[0][:2], "\n".join(r[2] for r in held)))
                    held, size = [], 0
                key = mine
                held.append((conv, turn, text or ""))
                size += len(text or "")
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "turn", "text"])
                out = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((*held[0][:2], "\n".join(r[2] for r in held)), (pa.int64(), pa.int64(), pa.string()))], names=["conv_id", "turn", "text"])

    ordered = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text").orderBy("conv_id", F.floor(F.col("turn") / turns), "turn", "text")
    return ordered.mapInArrow(run, "conv_id long, turn long, text string")
