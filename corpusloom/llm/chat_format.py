"""Chat formatting with minimum-cost role repair.

A conversation is legal if an optional system turn comes first and user and assistant then alternate, user first, assistant last.
For each turn a step of a legal-turn automaton is chosen: keep its role, relabel it, merge it into the message before, or insert
an empty message first; dynamic programming finds the cheapest sequence of steps. The repaired sequence is then rendered.

Steps of a stretch of turns form a (min, +) matrix over the automaton's states, and matrices of neighbouring stretches multiply.
So a conversation of any length is cut into blocks of BLOCK turns: each block gives its matrix, one pass over the few matrices
of a conversation fixes the state at each block's border, and each block then traces its own steps. No task holds a conversation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusloom.llm.common import small_batches, written

#: Turns in a block, and blocks in a stretch of blocks.
BLOCK = 256
ROLES = ("system", "user", "assistant")
#: States: nothing yet, and the role of the message that is open.
STATES = ("start", *ROLES)
#: Costs: another role, a merge, an inserted empty message; a turn of an unknown role costs RELABEL whatever it becomes.
RELABEL, MERGE, INSERT = 3, 2, 4
#: Which messages may follow each state.
LEGAL = {0: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
FAR = 10**9


def paths() -> list[list[list[tuple[int, tuple[int, ...]]]]]:
    """For states s and t: ways to open a message of state t after s, as cost and inserted messages between; cheapest first."""
    out: list[list[list[tuple[int, tuple[int, ...]]]]] = [[[] for _ in STATES] for _ in STATES]
    for s in range(4):
        for a in LEGAL[s]:
            out[s][a].append((0, ()))
            for b in LEGAL[a]:
                out[s][b].append((INSERT, (a,)))
    return out


PATHS = paths()


def steps(role: str | None) -> tuple[np.ndarray, dict]:
    """Cost of going from state to state by one turn, and what is done: ('merge',) or ('open', inserted)."""
    cost, done = np.full((4, 4), FAR, np.int64), {}
    for s in range(4):
        for t in range(1, 4):
            change = 0 if STATES[t] == role else RELABEL
            options = [(c + change, ("open", inserted)) for c, inserted in PATHS[s][t]]
            if s == t:
                options.append((MERGE + change, ("merge", ())))
            if options:
                cost[s, t], done[s, t] = min(options, key=lambda x: x[0])
    return cost, done


STEPS = {r: steps(r) for r in (*ROLES, None)}


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """(min, +) product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def block_matrix(roles: list[str | None]) -> np.ndarray:
    m = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    for r in roles:
        m = times(m, STEPS[r][0])
    return m


def final_cost(state: int) -> tuple[int, tuple[int, ...]]:
    """What it takes to end legally: an assistant message is open, or one is inserted."""
    return {0: (FAR, ()), 1: (2 * INSERT, (2, 3)), 2: (INSERT, (3,)), 3: (0, ())}[state]


def trace(roles: list[str | None], start: int, end: int) -> list[tuple[int, str, tuple[int, ...]]]:
    """The cheapest steps of a block from state start to state end: state, action and inserted messages of each turn."""
    best, back = np.full(4, FAR, np.int64), []
    best[start] = 0
    for r in roles:
        total = best[:, None] + STEPS[r][0]
        back.append(total.argmin(axis=0))
        best = np.minimum(total.min(axis=0), FAR)
    out, t = [], end
    for r, b in zip(reversed(roles), reversed(back), strict=True):
        s = int(b[t])
        action, inserted = STEPS[r][1][s, t]
        out.append((t, action, inserted))
        t = s
    return out[::-1]


def header(state: int) -> str:
    return f"<|im_start|>{STATES[state]}\n"


CLOSE = "<|im_end|>\n"


def repair_and_render(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn: (conv_id, turn, place, role, new_role, action, piece); a conversation's pieces in order of place are its rendering.

    action is keep, relabel, merge or merge+relabel, with +insert if empty messages are put before. Turns are ordered by turn,
    ties by role and text; nulls come first. Unknown and null roles can become any role. A null text is empty. Rows of a null
    conversation form one conversation. An empty table gives no rows. A very long text is carried whole and never parsed; a very
    long conversation is one 4 x 4 matrix per 256 turns in one task.
    """
    spark = df.sparkSession
    small_batches(spark)
    types = {c: df.schema[c].dataType.simpleString() for c in (conv_col, turn_col)}
    turns = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    turns = turns.withColumn("tie", F.xxhash64("role", "text"))
    # places: turns of a conversation are counted by ranges of its turn numbers first, so that none is sorted as a whole
    grain = F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-(1 << 62))).cast("bigint")
    turns = turns.withColumn("grain", grain)
    counted = turns.groupBy("conv_id", "grain").agg(F.count(F.lit(1)).alias("many"))
    before = counted.withColumn("base", F.coalesce(F.sum("many").over(Window.partitionBy("conv_id").orderBy("grain").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(F.col("conv_id").alias("c_id"), F.col("grain").alias("c_grain"), "base")
    ranked = turns.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "grain").orderBy("turn", "role", "tie")) - 1)
    placed = ranked.join(before, F.col("conv_id").eqNullSafe(F.col("c_id")) & (F.col("grain") == F.col("c_grain")))
    placed = placed.select("conv_id", "turn", "role", "text", "grain", "rank", (F.col("base") + F.col("rank")).cast("bigint").alias("place"))
    blocks = placed.withColumn("known", F.when(F.lower(F.trim("role")).isin(*ROLES), F.lower(F.trim("role"))))
    # a block: the turns of one range; many equal turn numbers make a range longer, which is cut by rank
    blocks = blocks.withColumn("cut", F.floor(F.col("rank") / BLOCK).cast("bigint"))
    roles = written(blocks.groupBy("conv_id", "grain", "cut").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "known"))), lambda x: x["known"]).alias("roles")), "roles")

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = [block_matrix(r).ravel().tolist() for r in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(m, pa.list_(pa.int64()))], names=["conv_id", "grain", "cut", "m"])

    small = roles.mapInArrow(matrices, f"conv_id {types[conv_col]}, grain bigint, cut bigint, m array<bigint>")

    def borders(table: pa.Table) -> pa.Table:
        """Forward over the matrices of one conversation, then back: the states at the borders of its blocks."""
        order = np.lexsort((table.column("cut").to_numpy(), table.column("grain").to_numpy()))
        table = table.take(pa.array(order))
        best, back = np.array([0, FAR, FAR, FAR], np.int64), []
        for m in table.column("m").to_pylist():
            total = best[:, None] + np.array(m, np.int64).reshape(4, 4)
            back.append(total.argmin(axis=0))
            best = np.minimum(total.min(axis=0), FAR)
        end = int(np.argmin([best[s] + final_cost(s)[0] for s in range(4)]))
        total_cost = int(best[end] + final_cost(end)[0])
        starts, ends, t = [], [], end
        for b in reversed(back):
            ends.append(t)
            t = int(b[t])
            starts.append(t)
        k = len(back)
        return pa.table({"conv_id": table.column("conv_id"), "grain": table.column("grain"), "cut": table.column("cut"), "from_state": pa.array(starts[::-1], pa.int32()), "to_state": pa.array(ends[::-1], pa.int32()), "last": pa.array([i == k - 1 for i in range(k)]), "cost": pa.array([total_cost] * k, pa.int64())})

    ends = small.groupBy("conv_id").applyInArrow(borders, f"conv_id {types[conv_col]}, grain bigint, cut bigint, from_state int, to_state int, last boolean, cost bigint")
    ends = ends.select(F.col("conv_id").alias("e_id"), F.col("grain").alias("e_grain"), F.col("cut").alias("e_cut"), "from_state", "to_state", "last", "cost")
    same = lambda p: F.col("conv_id").eqNullSafe(F.col(f"{p}_id")) & (F.col("grain") == F.col(f"{p}_grain")) & (F.col("cut") == F.col(f"{p}_cut"))
    fixed = roles.join(ends, same("e"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r, s, t, last in zip(*(batch.column(i).to_pylist() for i in range(3, 7)), strict=True):
                done = trace(r, s, t)
                rows.append([{"state": st, "action": a, "inserted": list(i), "opened": (done[k - 1][0] if k else s) != 0, "end": last and k == len(done) - 1} for k, (st, a, i) in enumerate(done)])
            kind = pa.list_(pa.struct([("state", pa.int32()), ("action", pa.string()), ("inserted", pa.list_(pa.int32())), ("opened", pa.bool_()), ("end", pa.bool_())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rows, kind), batch.column(7)], names=["w_id", "w_grain", "w_cut", "steps", "cost"])

    kind = "array<struct<state:int,action:string,inserted:array<int>,opened:boolean,end:boolean>>"
    steps_of = fixed.select("conv_id", "grain", "cut", "roles", "from_state", "to_state", "last", "cost").mapInArrow(walk, f"w_id {types[conv_col]}, w_grain bigint, w_cut bigint, steps {kind}, cost bigint")
    both = blocks.join(steps_of, same("w")).withColumn("step", F.element_at("steps", (F.col("rank") % BLOCK + 1).cast("int")))
    names = F.array(*[F.lit(s) for s in STATES])
    head = lambda s: F.concat(F.lit("<|im_start|>"), F.element_at(names, s + 1), F.lit("\n"))
    state, inserted = F.col("step.state"), F.col("step.inserted")
    opening = F.concat(F.when(F.col("step.opened"), CLOSE).otherwise(""), F.array_join(F.transform(inserted, lambda s: F.concat(head(s), F.lit(CLOSE))), ""), head(state))
    rest = F.when(state == 2, header(3) + CLOSE).when(state == 1, header(2) + CLOSE + header(3) + CLOSE).otherwise("")
    piece = F.concat(F.when(F.col("step.action") == "merge", "\n\n").otherwise(opening), F.col("text"), F.when(F.col("step.end"), F.concat(F.lit(CLOSE), rest)).otherwise(""))
    relabelled = ~F.element_at(names, state + 1).eqNullSafe(F.col("known"))
    action = F.concat(F.when(F.col("step.action") == "merge", F.when(relabelled, "merge+relabel").otherwise("merge")).otherwise(F.when(relabelled, "relabel").otherwise("keep")), F.when(F.size(inserted) > 0, "+insert").otherwise(""))
    return both.select("conv_id", "turn", "place", "role", F.element_at(names, state + 1).alias("new_role"), action.alias("action"), piece.alias("piece"), "cost")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_and_render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op10_chat_format": op10_chat_format}
ORACLE_SQL: dict[str, str] = {}
