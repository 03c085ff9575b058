"""Chat formatting: the cheapest repair of a conversation's roles, then rendering.

Legal conversations are [system] (user assistant)+, an automaton of four states. A turn keeps its role or
is relabelled, and is then appended, merged into the turn before it, or appended after an empty turn that
is inserted; a conversation that does not end with the assistant gets empty turns at its end. Dynamic
programming over the automaton finds the cheapest choice; of equal ones, that which its walk back from
the end meets first in the order of states and operations.

The rows are ordered by conversation and turn over all partitions, so a conversation with very many turns
spans several. Its costs compose: the turns of one partition act on the four states' costs as a matrix
over (min, +), so the driver needs a matrix for the first and the last conversation of each partition only,
to tell every partition the costs at its beginning and the state at its end. Nothing else leaves a task.

Edge cases: null or unknown roles take any role at a lower price; a null text is empty; a null conversation
id is a conversation like any other; null turn numbers come first; equal turn numbers are ordered by role
and text, repeated rows are repeated turns; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canopyspark.llm.common import cut

START, SYSTEM, USER, ASSISTANT, UNKNOWN = range(5)
ROLES = ["", "system", "user", "assistant"]
# Other names of the roles.
NAMES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
MERGE, INSERT, RELABEL, NAME = 1, 2, 3, 1
INF = 1 << 50
OPEN, CLOSE, JOINT = "<|{}|>\n", "<|end|>\n", "\n\n"
#: Costs from the start of a conversation.
FRESH = (0, INF, INF, INF)


def moves() -> list[list[tuple[int, int, int, str, int]]]:
    """For each role that a turn may have: (state before, state after, cost, operation, inserted role)."""
    found: list[list[tuple[int, int, int, str, int]]] = [[] for _ in range(5)]
    for role in (SYSTEM, USER, ASSISTANT, UNKNOWN):
        for state in (START, SYSTEM, USER, ASSISTANT):
            for label in (SYSTEM, USER, ASSISTANT):
                price = 0 if label == role else NAME if role == UNKNOWN else RELABEL
                ways = []
                if (state, label) in LEGAL:
                    ways.append((price, "append", 0))
                if state == label:
                    ways.append((price + MERGE, "merge", 0))
                ways += [(price + INSERT, "insert", e) for e in (SYSTEM, USER, ASSISTANT) if {(state, e), (e, label)} <= LEGAL]
                if ways:
                    cost, operation, inserted = min(ways, key=lambda w: w[0])
                    found[role].append((state, label, cost, operation, inserted))
    return found


MOVES = moves()
#: Cost of ending in each state: the empty turns that are still missing.
ENDING = [2 * INSERT, 2 * INSERT, INSERT, 0]
MISSING = [[USER, ASSISTANT], [USER, ASSISTANT], [ASSISTANT], []]


def role_of(name: str | None) -> int:
    return NAMES.get((name or "").strip().lower(), UNKNOWN)


def advance(costs: tuple, role: int) -> tuple:
    """The states' least costs after a turn."""
    after = [INF] * 4
    for state, label, cost, _, _ in MOVES[role]:
        if costs[state] + cost < after[label]:
            after[label] = costs[state] + cost
    return tuple(after)


def matrix(roles: list[int]) -> list[tuple]:
    """Row s: the states' least costs after these turns, from state s."""
    rows = [tuple(0 if t == s else INF for t in range(4)) for s in range(4)]
    for role in roles:
        rows = [advance(r, role) for r in rows]
    return rows


def apply(costs: tuple, by: list[tuple]) -> tuple:
    return tuple(min(INF, min(costs[s] + by[s][t] for s in range(4))) for t in range(4))


def last_state(costs: tuple) -> int:
    return min(range(4), key=lambda s: costs[s] + ENDING[s])


def walk(roles: list[int], begin: tuple, end: int) -> tuple[list[tuple[int, int, str, int]], int]:
    """(new role, cost, operation, inserted role) of each turn on the cheapest way to state ``end``, and the state at its beginning."""
    at = [begin]
    for role in roles:
        at.append(advance(at[-1], role))
    told, state = [], end
    for k in range(len(roles) - 1, -1, -1):
        before, label, cost, operation, inserted = next(m for m in MOVES[roles[k]] if m[1] == state and at[k][m[0]] + m[2] == at[k + 1][state])
        told.append((label, cost, operation, inserted))
        state = before
    return told[::-1], state


def repair_turns(roles: list[str | None]) -> tuple[int, list[tuple[int, int, str, int]], list[int]]:
    """Cost, the decision for each turn, and the roles of the empty turns at the end, for one conversation."""
    codes = [role_of(r) for r in roles]
    costs = FRESH
    for c in codes:
        costs = advance(costs, c)
    end = last_state(costs)
    return costs[end] + ENDING[end], walk(codes, FRESH, end)[0], MISSING[end]


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[pa.RecordBatch]]]:
    """The conversations of an ordered partition; column 0 is the conversation."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        ids = batch.column(0).to_pylist()
        begin = 0
        for k in range(1, len(ids) + 1):
            if k < len(ids) and ids[k] == ids[begin]:
                continue
            if held and ids[begin] != current:
                yield current, held
                held = []
            current = ids[begin]
            held.append(batch.slice(begin, k - begin))
            begin = k
    if held:
        yield current, held


def codes_of(parts: list[pa.RecordBatch], column: int) -> list[int]:
    return [role_of(r) for p in parts for r in p.column(column).to_pylist()]


def edges(ordered: DataFrame, at: dict | None) -> list:
    """For the first and last conversation of each partition: its transfer matrix, or, if ``at`` tells the
    costs at its beginning, the state at the beginning for each state at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        found: list[tuple] = []
        count = 0
        for conv, parts in runs(batches):
            codes = codes_of(parts, 1)
            if at is None:
                value = [min(c, INF) for row in matrix(codes) for c in row]
            else:
                begin = at.get((here, count == 0), FRESH)
                costs = begin
                for c in codes:
                    costs = advance(costs, c)
                value = [walk(codes, begin, s)[1] if costs[s] < INF else -1 for s in range(4)]
            found = [*found[:1], (conv, count, value)]
            count += 1
        rows = [(here, n, count, conv, value) for conv, n, value in found]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names=["part", "n", "runs", "conv_id", "value"])

    return sorted(ordered.select("conv_id", "role").mapInArrow(run, "part int, n long, runs long, conv_id long, value array<long>").collect(), key=lambda r: (r.part, r.n))


def boundaries(ordered: DataFrame) -> tuple[dict, dict]:
    """The costs at the beginning of each partition whose first conversation began earlier, by (partition, True),
    and the state at the end of each partition whose last conversation goes on; two rows a partition reach the driver."""
    first = edges(ordered, None)
    spans = [r for r in first if r.n in (0, r.runs - 1)]
    begins: dict = {}
    costs, before = FRESH, None
    for r in spans:
        if before is not None and r.n == 0 and before.part != r.part and r.conv_id == before.conv_id:
            begins[r.part, True] = costs
        else:
            costs = FRESH
        costs = apply(costs, [tuple(r.value[4 * s : 4 * s + 4]) for s in range(4)])
        before = r
    if not begins:
        return {}, {}
    ends: dict = {}
    back = edges(ordered, begins)
    totals: dict = {}
    for r in spans:
        begin = begins.get((r.part, True), FRESH) if r.n == 0 else FRESH
        totals[r.part, r.n] = apply(begin, [tuple(r.value[4 * s : 4 * s + 4]) for s in range(4)])
    after, state = None, None
    for r in reversed(back):
        goes_on = after is not None and after.n == 0 and after.part != r.part and after.conv_id == r.conv_id and (after.part, True) in begins and r.n == r.runs - 1
        end = state if goes_on else last_state(totals[r.part, r.n])
        if goes_on:
            ends[r.part] = end
        state = r.value[end]
        after = r
    return begins, ends


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, turn, role, new_role, operation (append, merge or insert), inserted (the role of the
    empty turn before it, or null), cost, and rendered. The rendered pieces of a conversation, in order, are its text."""
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(role_col).cast("string").alias("role"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    order = ["conv_id", "turn", "role", "text"]
    ordered = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    begins, ends = boundaries(ordered)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = TaskContext.get().partitionId()
        held = None
        count = 0
        for parts in (p for _, p in runs(batches)):
            if held is not None:
                yield told(held, begins.get((here, True), FRESH) if count == 1 else FRESH, None, count == 1 and (here, True) in begins)
            held = parts
            count += 1
        if held is not None:
            yield told(held, begins.get((here, True), FRESH) if count == 1 else FRESH, ends.get(here), count == 1 and (here, True) in begins)

    def told(parts: list[pa.RecordBatch], begin: tuple, end: int | None, continued: bool) -> pa.RecordBatch:
        codes = codes_of(parts, 1)
        closes = end is None  # else the conversation goes on in the next partition
        if closes:
            costs = begin
            for c in codes:
                costs = advance(costs, c)
            end = last_state(costs)
        way, _ = walk(codes, begin, end)
        table = pa.Table.from_batches(parts).combine_chunks()
        texts = table.column("text").to_pylist()
        rendered, costs_of = [], []
        for k, ((label, cost, operation, inserted), text) in enumerate(zip(way, texts, strict=True)):
            opening = continued or k > 0
            if operation == "merge":
                piece = JOINT + text
            else:
                piece = (CLOSE if opening else "") + (OPEN.format(ROLES[inserted]) + CLOSE if inserted else "") + OPEN.format(ROLES[label]) + text
            rendered.append(piece)
            costs_of.append(cost)
        if closes:
            rendered[-1] += CLOSE + "".join(OPEN.format(ROLES[e]) + CLOSE for e in MISSING[end])
            costs_of[-1] += ENDING[end]
        return pa.RecordBatch.from_arrays(
            [
                table.column("conv_id").combine_chunks(), table.column("turn").combine_chunks(), table.column("role").combine_chunks(),
                pa.array([ROLES[w[0]] for w in way], pa.string()), pa.array([w[2] for w in way], pa.string()), pa.array([ROLES[w[3]] or None for w in way], pa.string()),
                pa.array(costs_of, pa.int64()), pa.array(rendered, pa.string()),
            ],
            names=["conv_id", "turn", "role", "new_role", "operation", "inserted", "cost", "rendered"],
        )

    return ordered.mapInArrow(run, "conv_id long, turn long, role string, new_role string, operation string, inserted string, cost long, rendered string")
