"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in alternation from a user turn to an
assistant turn.  Each turn of the input keeps its role or is relabelled; a turn whose role equals that of the turn before
may be merged into it; where the automaton needs a turn that is not there, an empty one is inserted (also at the end).
Dynamic programming over the automaton's states (start, system, user, assistant) finds the repair of least cost; among
equal costs, keeping comes before relabelling, then merging before inserting, decided from the last turn backwards.  A
turn without a known role costs as much for each role.  The repaired turns are rendered one after the other.

The cost of a piece of a conversation is a matrix (state before x state after) in the min-plus algebra, and matrices
multiply: a conversation of more than PIECE turns is cut, by the rank of its turns, into pieces of PIECE turns; pieces are
repaired by different tasks, and one short row per piece decides the states between them.  Ranks come from a range
partitioning over all columns, so that a conversation (or the rows without a conv_id, or one turn that repeats) may hold a
third of all rows: no task holds it whole.

Result: one row for each conversation of up to PIECE turns (piece 0), whatever its turns are numbered.  A longer one has a
row for each piece; its pieces, joined in the order of ``piece``, are its rendered text.

Defined cases: turns are ordered by turn, then role, then text, nulls first; repeated rows are turns of their own.  A
null text is an empty one.  Rows with a null conv_id form one conversation.  Roles are compared in lower case without outer
blanks; the names in ROLES are known.  Marks of the format inside a text get one more bar (``<|im_`` becomes ``<||im_``), so
that no text can begin or end a message; taking a bar away gives the text again.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ("", "system", "user", "assistant")
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}
RELABEL, UNKNOWN, MERGE, INSERT = 30, 10, 8, 12
PIECE = 4096
OPEN, CLOSE = "<|im_start|>{}\n", "<|im_end|>\n"
MARK = re.compile(r"<(\|+)im_")
FAR = 10**15
ORDER = ["conv_id", "piece", "turn", "role", "text"]
#: Ids of long conversations and parts of them are broadcast up to this number (about 50 bytes each).
BROADCAST = 200_000
#: What has to be inserted between two states so that the second may follow the first (None: impossible).
BETWEEN = {
    (START, SYSTEM): (), (START, USER): (), (START, ASSISTANT): (USER,),
    (SYSTEM, USER): (), (SYSTEM, ASSISTANT): (USER,),
    (USER, ASSISTANT): (), (USER, USER): (ASSISTANT,),
    (ASSISTANT, USER): (), (ASSISTANT, ASSISTANT): (USER,),
}
ENDING = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def known(role: str | None) -> int:
    return ROLES.get(role.strip().lower(), START) if role else START


def label_cost(role: int, state: int) -> int:
    return 0 if role == state else UNKNOWN if role == START else RELABEL


def steps(role: int) -> list[tuple[int, int, int, int, bool]]:
    """(state before, state after, cost, preference, merged) for one turn of a known (or unknown: 0) role."""
    out = []
    for state in (SYSTEM, USER, ASSISTANT):
        c = label_cost(role, state)
        for before in range(4):
            if before == state:
                out.append((before, state, c + MERGE, 2 * (c > 0), True))
            if (ins := BETWEEN.get((before, state))) is not None:
                out.append((before, state, c + INSERT * len(ins), 2 * (c > 0) + bool(ins), False))
    return out


STEPS = [steps(r) for r in range(4)]


def matrix(roles: list[int]) -> np.ndarray:
    """Least cost from each state before the turns to each state after them."""
    cost = np.where(np.eye(4, dtype=bool), 0, FAR)
    for r in roles:
        new = np.full((4, 4), FAR)
        for before, after, c, _, _ in STEPS[r]:
            np.minimum(new[:, after], cost[:, before] + c, out=new[:, after])
        cost = new
    return cost


def repair(roles: list[int], enter: int, leave: int | None) -> tuple[list[tuple[int, bool]], int, int]:
    """(state, merged) of each turn, the last state and the cost; ``leave``: the last state, or None for any (with its ending)."""
    cost = [FAR] * 4
    cost[enter] = 0
    back = []
    for r in roles:
        new, how = [(FAR, 9)] * 4, [None] * 4
        for before, after, c, preference, merged in STEPS[r]:
            key = (cost[before] + c, preference)
            if cost[before] < FAR and key < new[after]:
                new[after], how[after] = key, (before, merged)
        cost = [k for k, _ in new]
        back.append(how)
    if leave is None:
        leave = min(range(4), key=lambda s: (cost[s] + INSERT * len(ENDING[s]), -s))
        total = cost[leave] + INSERT * len(ENDING[leave])
    else:
        total = cost[leave]
    out, state = [], leave
    for how in reversed(back):
        before, merged = how[state]
        out.append((state, merged))
        state = before
    return out[::-1], leave, total


def render(path: list[tuple[int, bool]], texts: list[str], enter: int, last: bool) -> tuple[str, int, list[str]]:
    """Text, number of messages begun, and actions; a message stays open at the end of a piece that is not the last."""
    out, state, n, acts = [], enter, 0, []

    def begin(role, text):
        nonlocal state, n
        if state != START:
            out.append(CLOSE)
        out.append(OPEN.format(NAMES[role]) + text)
        state, n = role, n + 1

    for (role, merged), text in zip(path, texts, strict=True):
        if merged:
            out.append("\n\n" + text)
            continue
        for r in BETWEEN[state, role]:
            begin(r, "")
            acts.append("insert")
        begin(role, text)
    if last:
        for r in ENDING[state]:
            begin(r, "")
            acts.append("insert")
        if state != START:
            out.append(CLOSE)
    return "".join(out), n, acts


def plain(text: str | None) -> str:
    return MARK.sub(r"<|\1im_", text) if text else ""


def few(df: DataFrame) -> DataFrame:
    """A table, broadcast where its rows are counted to be few."""
    return F.broadcast(df) if df.limit(BROADCAST + 1).count() <= BROADCAST else df


def ordered(turns: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """All turns with their piece, and the turns of conversations that have several pieces (None if there are none)."""
    rows = turns.select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    long = table(rows.groupBy(F.col("conv_id").alias("c")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE).select("c"), "chat-long")
    if not long.limit(1).count():
        return rows.withColumn("piece", F.lit(0).cast("bigint")), None
    long = few(long)
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    order = ["conv_id", "turn", "role", "text"]
    kind = turns.schema["conv_id"].dataType.simpleString()

    def numbered(batches):
        from pyspark import TaskContext

        part, last, n = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            nth = []
            for c in batch.column("conv_id").to_pylist():
                n = n + 1 if c == last else 0
                last = c
                nth.append(n)
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in order), pa.array([part] * len(nth), pa.int32()), pa.array(nth, pa.int64())], [*order, "part", "nth"])

    own = rows.join(long, same, "left_semi").withColumn("tie", F.monotonically_increasing_id())
    ranked = own.repartitionByRange(*order, "tie").sortWithinPartitions(*order).drop("tie")
    ranked = table(ranked.mapInArrow(numbered, f"conv_id {kind}, turn bigint, role string, text string, part int, nth bigint"), "chat-ranked")
    counts = ranked.groupBy(F.col("conv_id").alias("c"), F.col("part").alias("p")).agg(F.count(F.lit(1)).alias("n"))  # conversations + partitions rows
    before = few(table(counts.select("c", "p", (F.sum("n").over(W.partitionBy("c").orderBy("p")) - F.col("n")).alias("before")), "chat-parts"))
    cut = ranked.join(before, same & (F.col("part") == F.col("p"))).select(*order, F.expr(f"(before + nth) div {PIECE}").alias("piece"))
    short = rows.join(long, same, "left_anti").withColumn("piece", F.lit(0).cast("bigint"))
    return short.unionByName(cut), cut


def grouped(batches, columns):
    """(key, lists of the columns) of each run of equal (conv_id, piece)."""
    key, held = None, None
    for batch in batches:
        c = {n: batch.column(n).to_pylist() for n in ("conv_id", "piece", *columns)}
        for i in range(batch.num_rows):
            k = (c["conv_id"][i], c["piece"][i])
            if held is None or k != key:
                if held is not None:
                    yield key, held
                key, held = k, [[] for _ in columns]
            for x, n in zip(held, columns, strict=True):
                x.append(c[n][i])
    if held is not None:
        yield key, held


def states_between(long: DataFrame) -> DataFrame:
    """c, p, enter, leave, last: the states around each piece of the conversations that have several."""
    kind, batch_type = long.schema["conv_id"].dataType.simpleString(), to_arrow_type(long.schema["conv_id"].dataType)

    def costs(batches):
        for (conv, piece), (roles,) in grouped(batches, ["role"]):
            yield pa.RecordBatch.from_pydict({"conv_id": pa.array([conv], batch_type), "piece": pa.array([piece], pa.int64()), "m": pa.array([matrix([known(r) for r in roles]).ravel().tolist()], pa.list_(pa.int64()))})

    def states(batches):
        for batch in batches:
            for conv, ps, ms in zip(batch.column("conv_id").to_pylist(), batch.column("ps").to_pylist(), batch.column("ms").to_pylist(), strict=True):
                cost, back = [0, FAR, FAR, FAR], []
                for m in ms:
                    m = np.array(m).reshape(4, 4) + np.array(cost)[:, None]
                    back.append(m.argmin(0))
                    cost = m.min(0).tolist()
                state = min(range(4), key=lambda s: (cost[s] + INSERT * len(ENDING[s]), -s))
                leave = [state]
                for b in back[:0:-1]:
                    state = int(b[state])
                    leave.append(state)
                leave.reverse()
                n = len(ps)
                yield pa.RecordBatch.from_pydict({"c": pa.array([conv] * n, batch_type), "p": pa.array(ps, pa.int64()), "enter": pa.array([START, *leave[:-1]], pa.int32()), "leave": pa.array(leave, pa.int32()), "last": pa.array([i == n - 1 for i in range(n)])})

    mats = long.repartition("conv_id", "piece").sortWithinPartitions(*ORDER).mapInArrow(costs, f"conv_id {kind}, piece bigint, m array<bigint>")
    lists = mats.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "m"))).alias("l")).select("conv_id", F.col("l.piece").alias("ps"), F.col("l.m").alias("ms"))
    return lists.mapInArrow(states, f"c {kind}, p bigint, `enter` int, `leave` int, `last` boolean")


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, piece, n_turns, n_messages, n_relabelled, n_merged, n_inserted, cost, text."""
    kind, batch_type = turns.schema["conv_id"].dataType.simpleString(), to_arrow_type(turns.schema["conv_id"].dataType)
    rows, long = ordered(turns)
    if long is None:
        whole = rows.withColumns({"enter": F.lit(START), "leave": F.lit(None).cast("int"), "last": F.lit(True)})
    else:
        whole = rows.join(few(table(states_between(long), "chat-states")), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")), "left")
        whole = whole.select(*ORDER, F.coalesce("enter", F.lit(START)).alias("enter"), "leave", F.coalesce("last", F.lit(True)).alias("last"))

    def repaired(batches):
        names = ["conv_id", "piece", "n_turns", "n_messages", "n_relabelled", "n_merged", "n_inserted", "cost", "text"]
        kinds = [batch_type, *[pa.int64()] * 7, pa.string()]
        held, size = [], 0
        for (conv, piece), (roles, texts, enter, leave, last) in grouped(batches, ["role", "text", "enter", "leave", "last"]):
            own = [known(r) for r in roles]
            path, end, cost = repair(own, enter[0], None if last[0] else leave[0])
            if last[0] and leave[0] is not None:
                path, end, cost = repair(own, enter[0], leave[0])
                cost += INSERT * len(ENDING[end])
            text, n, acts = render(path, [plain(t) for t in texts], enter[0], last[0])
            held.append((conv, piece, len(own), n, sum(r != s for r, (s, _) in zip(own, path, strict=True)), sum(m for _, m in path), len(acts), cost, text))
            size += len(text)
            if len(held) >= 2000 or size > 4_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names)

    return whole.repartition("conv_id", "piece").sortWithinPartitions(*ORDER).mapInArrow(
        repaired, f"conv_id {kind}, piece bigint, n_turns bigint, n_messages bigint, n_relabelled bigint, n_merged bigint, n_inserted bigint, cost bigint, text string"
    )
