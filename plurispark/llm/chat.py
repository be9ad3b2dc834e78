"""Chat formatting: minimum-cost role repair over an automaton of legal turns.

Legal conversations are: an optional system turn, then user and assistant turns in
alternation, ending with the assistant. A turn may be kept, relabelled, or merged into
the turn before it, and empty turns may be inserted; dynamic programming finds the
cheapest repair. Costs are small whole numbers, so ties are frequent: among equal costs
each turn takes its own role first, then system, user, assistant.

A conversation of any length is cut in segments of at most ``SEGMENT`` turns. A
segment is a min-plus matrix between automaton states; the costs after a segment come from
the matrices to its right, its entry state from the choices to its left, and given both,
every segment is repaired alone. Only these summaries of a conversation meet.

Defined cases: turns are ordered by number, then role, then text (nulls first), so repeated rows
follow each other; a null or unknown role must be relabelled (at a lower cost); a null
text is empty; rows with a null conversation id are one conversation; nothing else is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plurispark.session import ranked, stage

SEGMENT = 4096
ROLES = ("system", "user", "assistant")
RELABEL, RELABEL_UNKNOWN, MERGE, INSERT = 3, 1, 1, 2
START = 3  # states: the role of the turn written last, or none yet
FOLLOW = {START: (0, 1), 0: (1,), 1: (2,), 2: (1,)}
FAR = 1 << 50


def _inserted(state: int, role: int) -> tuple[int, ...] | None:
    """The shortest run of turns to insert so that *role* may follow *state*; None if it never may."""
    seen, todo = {state}, [(state, ())]
    while todo:
        at, path = todo.pop(0)
        if role in FOLLOW[at]:
            return path
        for x in FOLLOW[at]:
            if x not in seen:
                seen.add(x)
                todo.append((x, (*path, x)))
    return None


#: For each state and role: cost and what is done before the turn (a merge, or inserted turns).
STEPS: dict[tuple[int, int], tuple[int, bool, tuple[int, ...]]] = {}
for _s in range(4):
    for _t in range(3):
        _path = _inserted(_s, _t)
        _ways = [] if _path is None else [(INSERT * len(_path), False, _path)]
        if _s == _t:
            _ways.append((MERGE, True, ()))
        if _ways:
            STEPS[_s, _t] = min(_ways)
#: Turns that end a conversation, and their cost; the start is only left by a turn.
ENDING = {s: () if s == 2 else (*_inserted(s, 2), 2) for s in range(4)}
END_COST = tuple(INSERT * len(ENDING[s]) for s in range(4))


def _label(own: int, role: int) -> int:
    return 0 if own == role else RELABEL if own < 3 else RELABEL_UNKNOWN


def _choices(own: int, state: int, after: tuple[int, ...]) -> tuple[int, int]:
    """(cost to the end, role) of the best choice for a turn; ties as the module says."""
    order = (own, *(t for t in range(3) if t != own)) if own < 3 else range(3)
    best = (FAR, 2)
    for t in order:
        if (state, t) in STEPS:
            cost = STEPS[state, t][0] + _label(own, t) + after[t]
            if cost < best[0]:
                best = (cost, t)
    return best


def _before(own: int, after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(_choices(own, s, after)[0], FAR) for s in range(4))


@lru_cache(maxsize=4096)
def solve(roles: bytes, after: tuple[int, ...]) -> tuple[bytes, ...]:
    """For each entry state the roles chosen for all turns; *after* is the cost to the end from each exit state."""
    costs = [after]
    for own in reversed(roles):
        costs.append(_before(own, costs[-1]))
    costs.reverse()
    out = []
    for state in range(4):
        chosen = bytearray()
        for i, own in enumerate(roles):
            state = _choices(own, state, costs[i + 1])[1]
            chosen.append(state)
        out.append(bytes(chosen))
    return tuple(out)


@lru_cache(maxsize=4096)
def matrix(roles: bytes) -> tuple[int, ...]:
    """Cheapest way from each entry state to each exit state, row by row."""
    columns = []
    for exit_ in range(4):
        after = tuple(0 if s == exit_ else FAR for s in range(4))
        for own in reversed(roles):
            after = _before(own, after)
        columns.append(after)
    return tuple(columns[e][s] for s in range(4) for e in range(4))


def repair_cost(roles: bytes) -> int:
    """Cost of repairing a whole conversation."""
    after = END_COST
    for own in reversed(roles):
        after = _before(own, after)
    return after[START]


def _runs(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[list[tuple]]:
    """Rows of one (conversation, segment) at a time; batches come sorted."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in names)):
            if held and held[-1][:2] != row[:2]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _code(c):
    return F.coalesce(*[F.when(c == r, F.lit(i)) for i, r in enumerate(ROLES)], F.lit(3)).cast("int")


def _sorted(df: DataFrame) -> DataFrame:
    return df.repartition("_conv", "_seg").sortWithinPartitions("_conv", "_seg", "_at")


def _kinds(turns: DataFrame) -> tuple[str, pa.DataType]:
    name = turns.schema["_conv"].dataType.simpleString()
    return name, {"string": pa.string(), "int": pa.int32()}.get(name, pa.int64())


def _summaries(turns: DataFrame) -> DataFrame:
    """``_conv, _seg, _m``: the matrix of each segment."""

    def run(batches):
        for rows in _runs(batches, ["_conv", "_seg", "_own"]):
            m = matrix(bytes(r[2] for r in rows))
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], kind), pa.array([rows[0][1]], pa.int64()), pa.array([m], pa.list_(pa.int64()))], ["_conv", "_seg", "_m"])

    conv, kind = _kinds(turns)
    return _sorted(turns.select("_conv", "_seg", "_at", "_own")).mapInArrow(run, f"_conv {conv}, _seg long, _m array<long>")


def _contexts(turns: DataFrame) -> DataFrame:
    """For conversations of several segments: each segment's entry state and the costs after it."""
    conv, kind = _kinds(turns)
    parts = stage(_summaries(turns))
    def walk(table: pa.Table) -> pa.Table:
        table = table.sort_by("_seg")
        after, costs = END_COST, []
        for m in reversed(table.column("_m").to_pylist()):
            costs.append(after)
            after = tuple(min(min(m[4 * s + e] + after[e] for e in range(4)), FAR) for s in range(4))
        return pa.table({"_conv": table.column("_conv"), "_seg": table.column("_seg"), "_after": pa.array(costs[::-1], pa.list_(pa.int64()))})

    # One short row for each SEGMENT turns; a conversation's summaries are SEGMENT times fewer than its turns.
    costs = stage(parts.groupBy("_conv").applyInArrow(walk, f"_conv {conv}, _seg long, _after array<long>"))
    joined = turns.select("_conv", "_seg", "_at", "_own").join(
        costs.withColumnsRenamed({"_conv": "_c", "_seg": "_s"}), F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_seg") == F.col("_s"))).drop("_c", "_s")

    def exits(batches):
        for rows in _runs(batches, ["_conv", "_seg", "_own", "_after"]):
            paths = solve(bytes(r[2] for r in rows), tuple(rows[0][3]))
            yield pa.RecordBatch.from_arrays(
                [pa.array([rows[0][0]], kind), pa.array([rows[0][1]], pa.int64()), pa.array([rows[0][3]], pa.list_(pa.int64())),
                 pa.array([[p[-1] for p in paths]], pa.list_(pa.int64()))], ["_conv", "_seg", "_after", "_exit"])

    ends = stage(_sorted(joined).mapInArrow(exits, f"_conv {conv}, _seg long, _after array<long>, _exit array<long>"))

    def enter(table: pa.Table) -> pa.Table:
        table = table.sort_by("_seg")
        state, entry = START, []
        for e in table.column("_exit").to_pylist():
            entry.append(state)
            state = e[state]
        return pa.table({"_conv": table.column("_conv"), "_seg": table.column("_seg"), "_after": table.column("_after"), "_entry": pa.array(entry, pa.int64())})

    return stage(ends.groupBy("_conv").applyInArrow(enter, f"_conv {conv}, _seg long, _after array<long>, _entry long"))


def _piece(text: str, role: int, merged: bool, inserted, first: bool, last: bool) -> str:
    """A turn's share of the rendered conversation: the shares in order are the whole."""
    out = [] if first else ["\n\n" if merged else "\n<|end|>\n"]
    out += [f"<|{ROLES[x]}|>\n\n<|end|>\n" for x in inserted]
    out += [] if merged else [f"<|{ROLES[role]}|>\n"]
    out.append(text)
    if last:
        out.append("\n<|end|>\n")
        out += [f"<|{ROLES[x]}|>\n\n<|end|>\n" for x in ENDING[role]]
    return "".join(out)


def repair(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT,
) -> DataFrame:
    """Per input row: conversation, turn, ``position``, ``role`` and ``new_role``, ``merged`` (into the turn before),
    ``inserted`` (roles of the empty turns put before it), ``ending`` (those put after the last), and ``rendered``, its share of the text."""
    kind, turn_kind = conversations.schema[conv].dataType.simpleString(), conversations.schema[turn].dataType.simpleString()
    rows = conversations.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.coalesce(text, F.lit("")).alias("_text"))
    placed = ranked(rows, ["_conv", "_turn", "_role", "_text"], "_pos")
    sizes = placed.groupBy("_conv").agg(F.min("_pos").alias("_first"), F.count(F.lit(1)).alias("_n")).withColumnRenamed("_conv", "_c")
    turns = placed.join(sizes, F.col("_conv").eqNullSafe(F.col("_c"))).drop("_c")
    at = F.col("_pos") - F.col("_first")
    turns = stage(turns.select("_conv", "_turn", "_role", "_text", at.alias("_at"), F.floor(at / segment).alias("_seg"), "_n", _code(F.col("_role")).alias("_own")))
    long_, short = turns.where(F.col("_n") > segment), turns.where(F.col("_n") <= segment)
    ready = short.withColumn("_after", F.array(*[F.lit(c).cast("long") for c in END_COST])).withColumn("_entry", F.lit(START).cast("long"))
    if long_.head(1):
        known = _contexts(long_).withColumnsRenamed({"_conv": "_c", "_seg": "_s"})
        ready = ready.unionByName(long_.join(known, F.col("_conv").eqNullSafe(F.col("_c")) & (F.col("_seg") == F.col("_s"))).drop("_c", "_s"))
    names = ["_conv", "_seg", "_at", "_turn", "_role", "_text", "_own", "_n", "_after", "_entry"]

    def run(batches):
        for rows in _runs(batches, names):
            state = rows[0][9]
            chosen = solve(bytes(r[6] for r in rows), tuple(rows[0][8]))[state]
            out = []
            for r, t in zip(rows, chosen):
                _, merged, inserted = STEPS[state, t]
                first, last = r[2] == 0, r[2] == r[7] - 1
                out.append((r[0], r[3], r[2], r[4], ROLES[t], merged, [ROLES[x] for x in inserted], [ROLES[x] for x in ENDING[t]] if last else [],
                            _piece(r[5], t, merged, inserted, first, last)))
                state = t
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    ints = {"string": pa.string(), "int": pa.int32()}
    schema = pa.schema([
        (conv, ints.get(kind, pa.int64())), (turn, ints.get(turn_kind, pa.int64())), ("position", pa.int64()), (role, pa.string()), ("new_role", pa.string()),
        ("merged", pa.bool_()), ("inserted", pa.list_(pa.string())), ("ending", pa.list_(pa.string())), ("rendered", pa.string())])
    return _sorted(ready.select(*names)).mapInArrow(
        run, f"`{conv}` {kind}, `{turn}` {turn_kind}, position long, `{role}` string, new_role string, merged boolean, inserted array<string>, ending array<string>, rendered string")
