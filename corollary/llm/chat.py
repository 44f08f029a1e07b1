"""Chat formatting: minimum-cost role repair by dynamic programming over an automaton of legal turns.

A legal conversation is an optional system message, then user and assistant messages in turn, and ends
with the assistant. Each turn is kept, relabelled or merged into the message before it, and empty
messages may be inserted; the cheapest sequence is rendered.

The automaton has four states, so a stretch of turns acts on it as a 4 x 4 matrix over (min, +). Turns
are range-partitioned in conversation order; of each partition only the first and last conversation can
go on elsewhere, and their matrices (two for a partition) are chained on the driver to fix the states at
the borders. Then every partition repairs its own stretch. A conversation of any length is thus spread
over as many partitions as its turns need. Only role columns take this way; texts meet their decision by key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .scratch import write_once

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "model": "assistant", "gpt": "assistant", "ai": "assistant", "chatgpt": "assistant", "developer": "system"}
UNKNOWN = 3
START, SYSTEM, USER, ASSISTANT = range(4)
MERGE, INSERT, NEVER = 2, 4, 1 << 40
#: Cost of showing a turn of one role (row; the last is an unknown role) as another (column).
RELABEL = ((0, 3, 9), (8, 0, 6), (8, 6, 0), (1, 1, 1))
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _moves():
    """moves[role][state]: (cost, next state, label, merged, roles inserted before), preferred ones first."""
    table = []
    for role in range(4):
        rows = []
        for state in range(4):
            found = []
            for label in sorted(range(3), key=lambda x: (x != role, x)):
                change = RELABEL[role][label]
                if label == 0:
                    if state == START:
                        found.append((change, SYSTEM, 0, False, ()))
                    elif state == SYSTEM:
                        found.append((change + MERGE, SYSTEM, 0, True, ()))
                elif label == 1:
                    if state == USER:
                        found += [(change + MERGE, USER, 1, True, ()), (change + INSERT, USER, 1, False, (2,))]
                    else:
                        found.append((change, USER, 1, False, ()))
                elif state == USER:
                    found.append((change, ASSISTANT, 2, False, ()))
                elif state == ASSISTANT:
                    found += [(change + MERGE, ASSISTANT, 2, True, ()), (change + INSERT, ASSISTANT, 2, False, (1,))]
                else:
                    found.append((change + INSERT, ASSISTANT, 2, False, (1,)))
            rows.append(found)
        table.append(rows)
    return table


MOVES = _moves()
#: What the end of a conversation costs in each state, and the roles that it inserts.
ENDINGS = ((NEVER, ()), (2 * INSERT, (1, 2)), (INSERT, (2,)), (0, ()))


def transfer(roles) -> list[list[int]]:
    """Least cost of going from each state (row) to each (column) over the turns."""
    matrix = [[0 if i == j else NEVER for j in range(4)] for i in range(4)]
    for role in roles:
        for i, row in enumerate(matrix):
            new = [NEVER] * 4
            for state in range(4):
                if row[state] < NEVER:
                    for cost, to, *_ in MOVES[role][state]:
                        new[to] = min(new[to], row[state] + cost)
            matrix[i] = new
    return matrix


def repair(roles, entry: int = START, leave: int | None = None):
    """(moves, ending): the cheapest legal moves for the turns from state ``entry``.

    ``leave`` is the state to end in where the conversation goes on; else the ending's inserted roles
    are returned too. Of equal costs the move listed first wins, from the last turn backwards.
    """
    cost = [NEVER] * 4
    cost[entry] = 0
    back = []
    for role in roles:
        new, step = [NEVER] * 4, [None] * 4
        for state in range(4):
            if cost[state] < NEVER:
                for move in MOVES[role][state]:
                    if cost[state] + move[0] < new[move[1]]:
                        new[move[1]], step[move[1]] = cost[state] + move[0], (state, move)
        back.append(step)
        cost = new
    state = leave if leave is not None else min(range(4), key=lambda s: (cost[s] + ENDINGS[s][0], s))
    ending = () if leave is not None else ENDINGS[state][1]
    out = []
    for step in reversed(back):
        state, move = step[state]
        out.append(move)
    return out[::-1], ending


def borders(stretches: list[tuple]) -> dict[tuple, tuple[int, int | None]]:
    """{(conversation, chunk): (entry state, state to leave in or None)} from (conversation, chunk, matrix) rows."""
    by: dict = {}
    for conv, chunk, matrix in stretches:
        by.setdefault(conv, {})[chunk] = matrix
    out = {}
    for conv, parts in by.items():
        chunks = sorted(parts)
        cost, back = [0, NEVER, NEVER, NEVER], []
        for chunk in chunks:
            options = [[cost[i] + parts[chunk][i][j] for i in range(4)] for j in range(4)]
            back.append([min(range(4), key=lambda i, o=o: (o[i], i)) for o in options])
            cost = [min(o) for o in options]
        state, states = min(range(4), key=lambda s: (cost[s] + ENDINGS[s][0], s)), []
        for step in reversed(back):
            states.append((step[state], state))
            state = step[state]
        for chunk, (entry, leave), last in zip(chunks, states[::-1], [False] * (len(chunks) - 1) + [True]):
            out[conv, chunk] = (entry, None if last else leave)
    return out


def _runs(batches):
    """(chunk, conversation, table of the run) from rows sorted by chunk and place; a partition's narrow rows are held."""
    held = list(batches)
    if not held:  # a partition without rows has no schema either
        return
    table = pa.Table.from_batches(held)
    if not table.num_rows:
        return
    chunk = table.column("chunk").to_numpy()
    null = np.asarray(table.column("conv_id").is_null())
    conv = table.column("conv_id").fill_null(0).to_numpy()
    edge = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (conv[1:] != conv[:-1]) | (null[1:] != null[:-1])]))
    for lo, hi in zip(edge, [*edge[1:], len(chunk)]):
        yield int(chunk[lo]), None if null[lo] else int(conv[lo]), table.slice(lo, hi - lo)


def _ends(batches):
    """Matrices of the first and the last conversation of each chunk."""
    kept: dict[int, list] = {}
    for chunk, conv, run in _runs(batches):
        kept.setdefault(chunk, [])
        kept[chunk][1:] = [(conv, run.column("code"))] if kept[chunk] else []
        if not kept[chunk]:
            kept[chunk].append((conv, run.column("code")))
    rows = [(conv, chunk, sum(transfer(codes.to_pylist()), [])) for chunk, found in kept.items() for conv, codes in found]
    if rows:
        columns = list(zip(*rows))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64()))], ["conv_id", "chunk", "matrix"])


def role_code(role):
    """Number of the role that a role column names, in any case and with blanks around; UNKNOWN for others and null."""
    name = F.lower(F.trim(role))
    code = F.lit(UNKNOWN)
    for alias, target in ALIASES.items():
        code = F.when(name == alias, ROLES.index(target)).otherwise(code)
    for i, target in enumerate(ROLES):
        code = F.when(name == target, i).otherwise(code)
    return code.cast("int")


DECISIONS = "conv_id long, turn long, role string, h1 long, h2 long, code int, label int, merged boolean, first boolean, before array<int>, ending array<int>, last boolean"


def repair_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> one row per row: conv_id, turn, role, new_role, action, inserted, rendered.

    Turns are ordered by turn, null last, then by role and a hash of the text. ``action`` is keep or
    relabel, with "+merge" if the turn joins the message before it; ``inserted`` lists the empty messages
    put before the turn (and, after its conversation's last turn, behind it). ``rendered`` is the turn's
    part of the conversation: the parts in order are the formatted conversation.

    Role names are trimmed and lower-cased; aliases count as their role; any other, or null, may become
    any role. Null texts are empty; empty texts are turns like others. Rows without a conv_id are one
    conversation. Rows that repeat in all four columns are one message: each shows it. An empty table
    gives an empty result; other columns are ignored.
    """
    spark = turns.sparkSession
    ship(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), text.alias("text"))
    rows = rows.withColumns({"h1": F.xxhash64("text"), "h2": F.xxhash64(F.lit("chat"), "text")})
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("h1").asc(), F.col("h2").asc()]
    narrow = rows.groupBy("conv_id", "turn", "role", "h1", "h2").agg(F.count(F.lit(1)).alias("copies")).drop("copies")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = narrow.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = write_once(placed.withColumns({"chunk": F.spark_partition_id(), "place": F.monotonically_increasing_id(), "code": role_code(F.col("role"))}), "turns")
    chunks = placed.repartition("chunk").sortWithinPartitions("chunk", "place")
    ends = [(r["conv_id"], r["chunk"], [r["matrix"][4 * i : 4 * i + 4] for i in range(4)]) for r in chunks.mapInArrow(_ends, "conv_id long, chunk int, matrix array<long>").collect()]  # two rows for a partition
    fixed = spark.sparkContext.broadcast(borders(ends))

    def decide(batches):
        names = [c.split()[0] for c in DECISIONS.split(", ")]
        for chunk, conv, run in _runs(batches):
            entry, leave = fixed.value.get((conv, chunk), (START, None))
            moves, ending = repair(run.column("code").to_pylist(), entry, leave)
            n = run.num_rows
            columns = [run.column(c).combine_chunks() for c in names[:6]]
            columns += [pa.array([m[2] for m in moves], pa.int32()), pa.array([m[3] for m in moves])]
            columns += [pa.array([entry == START] + [False] * (n - 1)), pa.array([list(m[4]) for m in moves], pa.list_(pa.int32()))]
            columns += [pa.array([[]] * (n - 1) + [list(ending)], pa.list_(pa.int32())), pa.array([False] * (n - 1) + [leave is None])]
            yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in columns], names)

    decided = chunks.mapInArrow(decide, DECISIONS)
    keys = ("conv_id", "turn", "role", "h1", "h2")
    decided = decided.select(*(F.col(k).alias(f"k_{k}") for k in keys), "code", "label", "merged", "first", "before", "ending", "last")
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"k_{k}"))
    met = rows.join(decided, same)
    name = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("label") + 1)
    role_names = lambda c: F.transform(c, lambda x: F.element_at(F.array(*[F.lit(r) for r in ROLES]), x + 1))
    empties = lambda c: F.array_join(F.transform(role_names(c), lambda r: F.concat(F.lit(OPEN), r, F.lit("\n" + CLOSE))), "")
    opened = F.concat(F.when(F.col("first"), "").otherwise(CLOSE), empties(F.col("before")), F.lit(OPEN), name, F.lit("\n"), F.col("text"))
    shown = F.concat(F.when(F.col("merged"), F.concat(F.lit("\n\n"), F.col("text"))).otherwise(opened), F.when(F.col("last"), F.concat(F.lit(CLOSE), empties(F.col("ending")))).otherwise(""))
    action = F.concat(F.when(F.col("label") == F.col("code"), "keep").otherwise("relabel"), F.when(F.col("merged"), "+merge").otherwise(""))
    return met.select("conv_id", "turn", "role", name.alias("new_role"), action.alias("action"), role_names(F.concat("before", "ending")).alias("inserted"), shown.alias("rendered"))
