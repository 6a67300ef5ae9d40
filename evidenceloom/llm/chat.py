"""Roles and turns of transcripts, by a hidden Markov model.

A transcript is the lines of a conversation's rows, in the order of their turn. States are a role with
"first line of a turn" or "later line". A line is seen as independent features: speaker marker, first
line of a row, first line of the conversation, question, length class. Log-probabilities come from
counts over labelled rows (or, without labels, from the defaults); Viterbi's best path gives roles and
turns, and each turn is rendered as ``<|role|>``, its lines without their marker, ``<|end|>``.

Nothing gathers a whole conversation: rows are sorted by ranges of (conversation, turn, text). A
conversation inside one range is decoded there. Of one that crosses ranges, each range gives the
best scores from every state to every state (max-plus product of its lines), from which the states
at the borders follow exactly; the driver gets at most two such small matrices for each range. Then each
part is decoded by itself between known states, and the pieces of a turn that crosses borders (at most two pieces a range have
such a border) are put together, so the result does not depend on how rows were dealt out.

Defined results: a null or empty text is one empty line; null conversation ids are one conversation;
null turns come first; equal turns are ordered by text; repeated rows stay; roles other than the three
known ones are not learned from; an empty table gives an empty one; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

ROLES = ("system", "user", "assistant")
#: Role, and whether the line is a turn's first.
STATES = [(r, first) for r in ROLES for first in (True, False)]
N = len(STATES)
_MARKERS = {"system": ("system", "instructions", "context"), "user": ("user", "human", "q", "question", "customer", "prompt"), "assistant": ("assistant", "ai", "bot", "a", "answer", "agent", "model", "gpt")}
_KIND = {w: 1 + ROLES.index(r) for r, ws in _MARKERS.items() for w in ws}
_MARKER = re.compile(r"^[\s>#*\[<(|]*([A-Za-z]{1,12})[\]>)*|]*\s*[:>\-]+[\s*]*")
#: Values of each feature: marker (none, one of the roles), row's first line, conversation's first line, question, length class.
SIZES = (4, 2, 2, 2, 4)


def features(line: str, first_of_row: bool, first_of_all: bool) -> tuple[int, ...]:
    m = _MARKER.match(line)
    kind = _KIND.get(m[1].lower(), 0) if m else 0
    n = len(line)
    return kind, int(first_of_row), int(first_of_all), int(line.rstrip().endswith("?")), 0 if not n else 1 if n < 60 else 2 if n < 200 else 3


def without_marker(line: str) -> str:
    m = _MARKER.match(line)
    return line[m.end() :] if m and m[1].lower() in _KIND else line


class Model:
    """start (N), step (N, N) and, for each feature, emit (N, values): log-probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: list[np.ndarray]):
        self.start, self.step, self.emit = start, step, emit

    @classmethod
    def from_counts(cls, counts: np.ndarray | None) -> Model:
        """Counts as ``count_labelled`` lays them out, smoothed by the defaults."""
        start, step, emit = _defaults()
        if counts is not None:
            a, rest = counts[:N], counts[N:]
            start, step = start + a, step + rest[: N * N].reshape(N, N)
            rest = rest[N * N :]
            for i, size in enumerate(SIZES):
                emit[i] = emit[i] + rest[: N * size].reshape(N, size)
                rest = rest[N * size :]
        log = lambda x: np.log(x / x.sum(axis=-1, keepdims=True))
        return cls(log(start), log(step), [log(e) for e in emit])

    def scores(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        """Log-probability of each line in each state."""
        x = np.array(seen, dtype=np.int64).reshape(-1, len(SIZES))
        return sum(self.emit[i][:, x[:, i]] for i in range(len(SIZES))).T

    def product(self, seen: list[tuple[int, ...]]) -> np.ndarray:
        """Best score from the state before the first line (row) to the last line's (column)."""
        out = None
        for e in self.scores(seen):
            m = self.step + e[None, :]
            out = m if out is None else (out[:, :, None] + m[None, :, :]).max(axis=1)
        return out

    def path(self, seen: list[tuple[int, ...]], before: np.ndarray | None = None, last: int | None = None) -> list[int]:
        """Best states; before: scores of the line before the first one; last: the last line's state if it is known."""
        scores = self.scores(seen)
        back = np.zeros((len(seen), N), dtype=np.int8)
        best = self.start + scores[0] if before is None else None
        for t in range(0 if best is None else 1, len(seen)):
            m = (before if t == 0 else best)[:, None] + self.step
            back[t] = m.argmax(axis=0)
            best = m.max(axis=0) + scores[t]
        states = [int(best.argmax()) if last is None else last]
        for t in range(len(seen) - 1, 0, -1):
            states.append(int(back[t, states[-1]]))
        return states[::-1]


def _defaults() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    start = np.array([3.0 if first and r != "assistant" else 0.05 for r, first in STATES])
    step = np.full((N, N), 0.02)
    for i, (r, _) in enumerate(STATES):
        for j, (s, first) in enumerate(STATES):
            if r == s and not first:
                step[i, j] = 3.0
            elif first and (r, s) in {("system", "user"), ("user", "assistant"), ("assistant", "user")}:
                step[i, j] = 2.0
    marker = np.array([[2.0 if first else 4.0, *(6.0 if first and r == s else 0.02 for s in ROLES)] for r, first in STATES])
    row = np.array([[0.2, 4.0] if first else [4.0, 0.01] for _, first in STATES])
    top = np.array([[4.0, 0.4] if first else [4.0, 0.02] for _, first in STATES])
    question = np.array([[2.0, 1.0] if r == "user" else [4.0, 0.4] for r, _ in STATES])
    return start, step, [marker, row, top, question, np.ones((N, 4))]


def _lines(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _seen(texts: list[str | None], at_start: bool) -> list[tuple[int, ...]]:
    """Features of the lines of consecutive rows; at_start: the conversation begins with them."""
    return [features(x, i == 0, at_start and r == 0 and i == 0) for r, t in enumerate(texts) for i, x in enumerate(_lines(t))]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Runs of rows with one conversation id; each row: turn, text, role."""
    now, rows = None, []
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if rows and conv != now:
                yield now, rows
                rows = []
            now = conv
            rows.append(tuple(row))
    if rows:
        yield now, rows


def _sorted(table: DataFrame, conv_id: str, turn: str, text: str, role: str | None) -> DataFrame:
    who = F.col(f"`{role}`") if role else F.lit(None).cast("string")
    rows = table.select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{text}`").alias("text"), who.alias("role"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("role").asc_nulls_first()]
    parts = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # equal rows are told apart by a number, so that any number of them can be spread; which of them comes first makes no difference
    return rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(parts, *order, "tie").sortWithinPartitions(*order, "tie").drop("tie")


def count_labelled(table: DataFrame, conv_id: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> np.ndarray:
    """Counts of starts, steps and features over all labelled rows; what crosses two ranges is counted on the driver, from one row a range."""
    width = N + N * N + N * sum(SIZES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, edges, part = np.zeros(width), [], TaskContext.get().partitionId()
        for conv, rows in _conversations(batches):
            last = None
            for r, (_, words, who) in enumerate(rows):
                if who not in ROLES:
                    last = None
                    continue
                for i, line in enumerate(_lines(words)):
                    state = 2 * ROLES.index(who) + (i > 0)
                    if last is not None:
                        counts[N + last * N + state] += 1
                    at = N + N * N
                    # whether the conversation begins here is known for all but a range's first rows
                    for f, size in zip(features(line, i == 0, r == 0 and i == 0), SIZES, strict=True):
                        counts[at + state * size + f] += 1
                        at += N * size
                    last = state
            first = rows[0][2]
            edges.append((conv, 2 * ROLES.index(first) if first in ROLES else None, last))
            if len(edges) > 2:
                if edges[1][1] is not None:
                    counts[edges[1][1]] += 1
                edges.pop(1)
        for conv, a, z in edges:
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([conv], pa.int64()), pa.array([a], pa.int64()), pa.array([z], pa.int64()), pa.array([counts.tolist()])], names=["part", "conv_id", "first", "last", "counts"])
            counts[:] = 0

    found = written(_sorted(table, conv_id, turn, text, role).mapInArrow(run, "part long, conv_id long, first long, last long, counts array<double>"), "chat-counts")
    total, before = np.zeros(width), None
    for r in found.orderBy("part", F.col("conv_id").asc_nulls_first()).toLocalIterator():
        total += np.array(r["counts"])
        if before is not None and before["conv_id"] == r["conv_id"]:
            if before["last"] is not None and r["first"] is not None:
                total[N + before["last"] * N + r["first"]] += 1
        elif r["first"] is not None:
            total[r["first"]] += 1
        before = r
    return total


def _turns(texts: list[str | None], turns: list, states: list[int], goes_on: bool = False) -> Iterator[tuple]:
    """turn, line (of the row, with which it begins), role, text and n_lines of each recovered turn; goes_on: the first one began before these lines."""
    out, k = [], 0
    for turn, t in zip(turns, texts, strict=True):
        for at, line in enumerate(_lines(t)):
            role, first = STATES[states[k]]
            if first or not out or out[-1][2] != role:
                line = line if goes_on and not out else without_marker(line)
                out.append([turn, at, role, []])
            out[-1][3].append(line)
            k += 1
    for turn, at, role, lines in out:
        yield turn, at, role, "\n".join(lines), len(lines)


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), text, F.lit("<|end|>"))


_OUT = "kind int, part long, conv_id long, turn long, line long, role string, text string, n_lines long, scores array<double>"
_NAMES = ["kind", "part", "conv_id", "turn", "line", "role", "text", "n_lines", "scores"]
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.list_(pa.float64())]
DECODED, RAW, MATRIX = 0, 1, 2


def parse(table: DataFrame, model: Model | None = None, conv_id: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """conv_id, turn and line (of the row and its line with which it begins), role, rendered and n_lines of each recovered turn."""
    model = model or Model.from_counts(None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, rows = TaskContext.get().partitionId(), None, []
        runs = _conversations(batches)
        for n, (conv, own) in enumerate(runs):
            if held is not None:
                rows += _decoded(part, *held)
            if n == 0:  # it may have begun before this range
                rows += _raw(part, conv, own)
            else:
                held = (conv, own)
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        if held is not None:  # it may go on in the next one
            rows += _raw(part, *held)
        if rows:
            yield _batch(rows)

    def _raw(part, conv, own):
        # from every state of the line before, and, should the conversation begin here, from the start
        steps = model.product(_seen([r[1] for r in own], False))
        yield (MATRIX, part, conv, None, None, None, None, None, [*steps.ravel().tolist(), *_from_start(model, own).tolist()])
        for t, words, _ in own:
            yield (RAW, part, conv, t, None, None, words, None, None)

    def _decoded(part, conv, own):
        texts = [r[1] for r in own]
        for t, line, role, words, n in _turns(texts, [r[0] for r in own], model.path(_seen(texts, True))):
            yield (DECODED, part, conv, t, line, role, words, n, None)

    done = written(_sorted(table, conv_id, turn, text, None).mapInArrow(run, _OUT), "chat-ranges")
    # at most two conversations of each range
    known = borders([(r["part"], r["conv_id"], np.array(r["scores"])) for r in done.where(f"kind = {MATRIX}").orderBy("part", F.col("conv_id").asc_nulls_first()).toLocalIterator()])
    sent = table.sparkSession.sparkContext.broadcast(known)

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        part, conv = int(pdf["part"].iloc[0]), None if pd.isna(pdf["conv_id"].iloc[0]) else int(pdf["conv_id"].iloc[0])
        before, last, previous = sent.value[part, conv]
        pdf = pdf.sort_values(["turn", "text"], na_position="first", kind="stable")
        texts = [None if x is None or x != x else x for x in pdf["text"].tolist()]
        turns = [None if pd.isna(t) else int(t) for t in pdf["turn"].tolist()]
        states = model.path(_seen(texts, before is None), before, last)
        goes_on = previous is not None and not STATES[states[0]][1] and STATES[states[0]][0] == STATES[previous][0]
        rows = list(_turns(texts, turns, states, goes_on))
        rows = [(conv, *r, part, i, i == len(rows) - 1, goes_on and i == 0) for i, r in enumerate(rows)]
        return pd.DataFrame(rows, columns=["conv_id", "turn", "line", "role", "text", "n_lines", "part", "place", "last", "goes_on"]).astype({"conv_id": "Int64", "turn": "Int64"})

    shape = "conv_id long, turn long, line long, role string, text string, n_lines long, part long, place long, last boolean, goes_on boolean"
    rest = written(done.where(f"kind = {RAW}").groupBy("part", "conv_id").applyInPandas(finish, shape), "chat-pieces")
    columns = ["conv_id", "turn", "line", "role", _rendered(F.col("role"), F.col("text")).alias("rendered"), "n_lines"]
    at_border = (F.col("place") == 0) | F.col("last")
    # at most two pieces of a range: which belong together is a running count of those that don't go on
    edges = rest.where(at_border).withColumn("whole", F.sum((~F.col("goes_on")).cast("int")).over(Window.partitionBy("conv_id").orderBy("part", "place")))
    first = lambda c: F.min_by(c, F.struct("part", "place")).alias(c)
    text_ = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "place", F.col("text").alias("t")))), lambda x: x["t"]), "\n")
    whole = edges.groupBy("conv_id", "whole").agg(first("turn"), first("line"), first("role"), text_.alias("text"), F.sum("n_lines").alias("n_lines"))
    found = done.where(f"kind = {DECODED}").select(*columns)
    return found.union(rest.where(~at_border).select(*columns)).union(whole.select(*columns))


def _from_start(model: Model, own: list[tuple]) -> np.ndarray:
    best = None
    for e in model.scores(_seen([r[1] for r in own], True)):
        best = model.start + e if best is None else (best[:, None] + model.step).max(axis=0) + e
    return best


def borders(parts: list[tuple[int, int | None, np.ndarray]]) -> dict[tuple[int, int | None], tuple[np.ndarray | None, int, int | None]]:
    """For each part of a conversation, in order: scores before it (None at the start), and the states on the best path of its last line and of the line before it."""
    out, i = {}, 0
    while i < len(parts):
        j = i
        while j < len(parts) and parts[j][1] == parts[i][1]:
            j += 1
        alphas = [parts[i][2][N * N :]]
        for _, _, m in parts[i + 1 : j]:
            alphas.append((alphas[-1][:, None] + m[: N * N].reshape(N, N)).max(axis=0))
        state = int(alphas[-1].argmax())
        for k in range(j - 1, i - 1, -1):
            last, state = state, int((alphas[k - i - 1] + parts[k][2][: N * N].reshape(N, N)[:, state]).argmax()) if k > i else None
            out[parts[k][0], parts[k][1]] = (alphas[k - i - 1] if k > i else None, last, state)
        i = j
    return out


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), _TYPES, strict=True)], names=_NAMES)
