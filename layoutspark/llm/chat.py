"""Chat formatting with minimum-cost role repair.

A legal conversation is: system (optional), then user and assistant in turn, ending with assistant. A dynamic program
over the automaton START, system, user, assistant chooses for each turn whether it is kept, merged into the message
before it, relabelled, or preceded by empty turns, at least total cost; then the repaired sequence is rendered.

Turns are range-partitioned by (conversation, turn) and cut into segments of SEGMENT rows at most, so a conversation of any
length spreads over tasks. A turn's choices are a 4 x 4 matrix of costs, a segment's the (min, +) product of its
turns'. Only conversations at a segment's edge need stitching: their products, one for SEGMENT turns, are combined in
order and give each piece its entry and exit state; then every piece is decoded on its own.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialize, small_batches

ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
#: State -> states that may follow.
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, INSERT, RELABEL = 1, 2, 3
FAR = 1 << 40
#: Rows, and characters of text, of a segment, which a task holds at once.
SEGMENT, SEGMENT_CHARS = 4096, 4 << 20
OPEN, CLOSE, JOIN = "<|{0}|>\n", "<|end|>\n", "\n\n"


def insertions(q: int, to: int) -> list[int]:
    """The fewest empty turns after which a turn in state to may follow q."""
    if to in LEGAL[q]:
        return []
    for a in LEGAL[q]:
        if to in LEGAL[a]:
            return [a]
    return next(([a, b] for a in LEGAL[q] for b in LEGAL[a] if to in LEGAL[b]), [-1])


@functools.cache
def matrix(role: str | None) -> tuple[np.ndarray, dict[tuple[int, int], tuple[str, list[int]]]]:
    """Least cost from state to state for a turn with this role, and (action, inserted states) that attain it."""
    cost = np.full((4, 4), FAR, dtype=np.int64)
    how: dict[tuple[int, int], tuple[str, list[int]]] = {}
    for q in range(4):
        for to in (SYSTEM, USER, ASSISTANT):
            own = ROLES[to - 1] == role
            extra = 0 if own else RELABEL
            options = []
            between = insertions(q, to)
            if between != [-1]:
                options.append((extra + INSERT * len(between), len(between) + 1, ("keep" if own else "relabel", between)))
            if q == to:
                options.append((extra + MERGE, 1 if own else 9, ("merge" if own else "relabel+merge", [])))
            if options:
                best = min(options, key=lambda o: o[:2])
                cost[q, to], how[q, to] = best[0], best[2]
    return cost, how


def ending(state: int) -> list[int]:
    """Empty turns that complete a conversation."""
    return {START: [], SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}[state]


END_COST = np.array([INSERT * len(ending(q)) for q in range(4)])


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum((a[:, :, None] + b[None]).min(axis=1), FAR)


IDENTITY = np.where(np.eye(4, dtype=bool), 0, FAR)


def decode(roles: list[str | None], entry: int, exit_: int | None) -> list[int]:
    """States after each turn on the cheapest way from entry to exit_ (None: the end of the conversation is free to choose)."""
    score = IDENTITY[entry].copy()
    back = []
    for role in roles:
        step = score[:, None] + matrix(role)[0]
        best = step.argmin(axis=0)
        back.append(best)
        score = np.minimum(step[best, range(4)], FAR)
    state = int((score + END_COST).argmin()) if exit_ is None else exit_
    out = []
    for best in reversed(back):
        out.append(state)
        state = int(best[state])
    return out[::-1]


def render(role: str | None, text: str, q: int, to: int, last: bool) -> tuple[str, int, str]:
    """(action, cost, rendered piece). The pieces of a conversation, in order, are its rendered text."""
    cost, how = matrix(role)
    action, between = how[q, to]
    paid = int(cost[q, to])
    if between:
        action = f"insert {len(between)}, {action}"
    if action.endswith("merge"):
        out = [JOIN, text]
    else:
        out = [CLOSE] if q != START else []
        for s in between:
            out += [OPEN.format(ROLES[s - 1]), CLOSE]
        out += [OPEN.format(ROLES[to - 1]), text]
    if last:
        out.append(CLOSE)
        for s in ending(to):
            out += [OPEN.format(ROLES[s - 1]), CLOSE]
        paid += int(END_COST[to])
    return action, paid, "".join(out)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, place (order of the rows), turn, role (repaired), action, cost, rendered; one row per row of turns.

    turns needs conv_id, turn, role, text; other columns are ignored. Roles count without case and surrounding space;
    a null or unknown role has to be relabelled. Null text is empty. Rows without conv_id form one conversation; a
    null turn comes first; rows with equal turns follow their role and text. Inserted turns are in the piece of the
    turn after them, those that complete a conversation in its last piece.
    """
    small_batches(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.lower(F.trim(F.col("role").cast("string"))).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    order = ["conv_id", "turn", "role", "h"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("h")

    def cut(batches):
        part, k, n = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                n += len(row[3])
                if len(held) == SEGMENT or n >= SEGMENT_CHARS:
                    yield piece(held, part << 28 | k)
                    held, k, n = [], k + 1, 0
        if held:
            yield piece(held, part << 28 | k)

    def piece(held: list[tuple], segment: int) -> pa.RecordBatch:
        products: list[list[int] | None] = [None] * len(held)
        inner = {held[0][0], held[-1][0]}
        for conv in inner:
            at = [i for i, r in enumerate(held) if r[0] == conv]
            products[at[-1]] = functools.reduce(product, (matrix(held[i][2])[0] for i in at), IDENTITY).ravel().tolist()
        cols = list(zip(*held, strict=True))
        return pa.RecordBatch.from_arrays([pa.array([segment] * len(held), pa.int64()), pa.array(range(len(held)), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), pa.array(products, pa.list_(pa.int64()))], ["segment", "pos", "conv_id", "turn", "role", "text", "product"])

    kind = "segment long, pos int, conv_id long, turn long, role string, text string, product array<long>"
    cuts = materialize(rows.mapInArrow(cut, kind), "turns")

    def stitch(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("segment")
        steps = [np.array(p, dtype=np.int64).reshape(4, 4) for p in pdf["product"]]
        score, back = IDENTITY[START].copy(), []
        for m in steps:
            step = score[:, None] + m
            back.append(step.argmin(axis=0))
            score = np.minimum(step.min(axis=0), FAR)
        state = int((score + END_COST).argmin())
        out = []
        for best in reversed(back):
            out.append((int(best[state]), state))
            state = int(best[state])
        return pd.DataFrame({"conv_id": pdf["conv_id"], "segment": pdf["segment"], "entry": [a for a, _ in out[::-1]], "exit": [b for _, b in out[::-1]], "final": [i == len(out) - 1 for i in range(len(out))]})

    edges = cuts.where("product is not null").select("conv_id", "segment", "product")
    ways = edges.groupBy("conv_id").applyInPandas(stitch, "conv_id long, segment long, entry int, exit int, final boolean")
    ways = materialize(ways, "ways").withColumnRenamed("conv_id", "c").withColumnRenamed("segment", "s")
    joined = cuts.drop("product").join(ways, (F.col("segment") == F.col("s")) & F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c", "s")
    joined = joined.repartition("segment").sortWithinPartitions("segment", "pos")

    def finish(batches):
        held: list[tuple] = []
        for batch in batches:
            out = []
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (held[-1][0], held[-1][2]) != (row[0], row[2]):
                    out += solve(held)
                    held = []
                held.append(row)
            if out:
                yield rendered(out)
        if held:
            yield rendered(solve(held))

    def solve(held: list[tuple]) -> list[tuple]:
        entry, exit_, final = held[0][6:9] if held[0][6] is not None else (START, None, True)
        states = decode([r[4] for r in held], entry, exit_)
        out = []
        for i, (r, to) in enumerate(zip(held, states, strict=True)):
            out.append((r[2], r[0] * SEGMENT + r[1], r[3], ROLES[to - 1], *render(r[4], r[5], states[i - 1] if i else entry, to, final and i == len(held) - 1)))
        return out

    def rendered(out: list[tuple]) -> pa.RecordBatch:
        types = (("conv_id", pa.int64()), ("place", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("action", pa.string()), ("cost", pa.int64()), ("rendered", pa.string()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out, strict=True), types, strict=True)], [n for n, _ in types])

    return joined.mapInArrow(finish, "conv_id long, place long, turn long, role string, action string, cost long, rendered string")
