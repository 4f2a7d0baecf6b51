"""Chat formatting with minimum-cost role repair.

A conversation is legal if it is an optional system turn, then user and assistant turns in alternation, beginning with the
user and ending with the assistant. Turns that are not are repaired at the least total cost, by dynamic programming over
that automaton: a turn may be kept, merged into the turn before it (same role after repair), relabelled, or preceded by
empty turns. The repaired turns are rendered between fixed marks.

Turns are put in order by turn (nulls first), then role (system, user, assistant, unknown), then a hash of role and text, with a
range sort over conversation and order, so a conversation of any length is spread over tasks; no text is sampled for it. What
each task holds of a conversation is counted, which gives every turn its place from 0 on. Conversations of up to ``RUN`` turns are
decoded whole. Longer ones are cut every ``RUN`` turns: within a run the programme's effect is a matrix of least costs between
states; the matrices of a conversation's runs are chained, and then each run is decoded on its own from the state that it begins
in to the one that it must end in. Only one small matrix per run, not its turns, meets the others.

Of equally cheap repairs that counts whose last state comes first in ``STATES``, and so on from the back; where a long conversation
is cut, the same choice is made between the states at the cuts first.

Defined results: a null or unknown role can only be relabelled (at no cost for "null", else at the price of a relabel);
null text counts as empty; turns with a null conversation id are a conversation of their own; repeated turns are turns like others
and mostly merge; an empty table gives an empty table; other columns do not matter. Marks within texts are broken by a
backslash, so a text cannot end its turn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import written
from .runtime import made, prepare, slices

ROLES = ("system", "user", "assistant")
#: What a repair costs. Merging joins texts, relabelling changes who speaks, inserting makes up a turn; nobody becomes the system
#: lightly.
MERGE, RELABEL, INSERT, TO_SYSTEM = 1.0, 2.0, 2.5, 6.0
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"

#: States: nothing yet, and the role of the last turn. Names other than these that mean a role.
STATES = ("begin", *ROLES)
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "ai": "assistant", "model": "assistant"}
#: From state to the roles that may follow without an insertion.
LEGAL = {0: ("system", "user"), 1: ("user",), 2: ("assistant",), 3: ("user",)}
RUN = 5000


def _moves() -> list[list[tuple[int, float, str]]]:
    """By role (3: none known), by state: (next state, cost, what is done: +-joined insertions, then keep, relabel or
    merge) for the cheapest way to each next state."""
    out = []
    for role in (*ROLES, None):
        rows = []
        for state in range(4):
            best: dict[tuple[int, str], tuple[float, str]] = {}

            def offer(to: int, cost: float, done: str, best: dict = best) -> None:
                kind = "merge" if done.endswith("merge") else "new"
                if (to, kind) not in best or cost < best[to, kind][0]:
                    best[to, kind] = (cost, done)

            def change(to: str, role: str | None = role) -> float:
                return (TO_SYSTEM if to == "system" else 0.0) if role is None else 0.0 if role == to else TO_SYSTEM if to == "system" else RELABEL

            if state:
                offer(state, MERGE + change(ROLES[state - 1]), "merge")
            for path, cost, at in _paths(state):
                for to in LEGAL[at]:
                    offer(1 + ROLES.index(to), cost + change(to), "+".join([*path, "new"]))
            rows.append([(to, cost, done) for (to, _), (cost, done) in sorted(best.items())])
        out.append(rows)
    return out


def _paths(state: int) -> Iterator[tuple[list[str], float, int]]:
    """Insertions of none, one or two empty turns after ``state`` that are legal, their cost, and the state then."""
    level = [([], 0.0, state)]
    for _ in range(3):
        yield from level
        level = [([*p, r], c + INSERT, 1 + ROLES.index(r)) for p, c, at in level for r in LEGAL[at] if r != "system"]


MOVES = _moves()
#: Cost of ending in a state: a conversation ends with the assistant, one without turns as it is.
ENDING = (0.0, 2 * INSERT, INSERT, 0.0)
_FAR = 1e18


def role_number(role: str | None) -> int:
    r = (role or "").strip().lower()
    r = ALIASES.get(r, r)
    return ROLES.index(r) if r in ROLES else 3


def unknown(role: str | None) -> float:
    """What naming a role costs that is given but means none."""
    return RELABEL if (role or "").strip() and role_number(role) == 3 else 0.0


def forward(roles: list[int]) -> np.ndarray:
    """matrix[a][b]: the least cost of going from state a to state b through the turns."""
    m = np.full((4, 4), _FAR)
    np.fill_diagonal(m, 0.0)
    for r in roles:
        new = np.full((4, 4), _FAR)
        for s in range(4):
            for to, cost, _ in MOVES[r][s]:
                np.minimum(new[:, to], m[:, s] + cost, out=new[:, to])
        m = new
    return m


def decode(roles: list[int], start: int = 0, end: int | None = None) -> tuple[list[tuple[str, str]], float, int]:
    """(role after repair, what is done) per turn, for the cheapest way from ``start`` to ``end`` (without it to the state in which the
    conversation ends best), its cost, and the state that it ends in."""
    cost, back = [_FAR] * 4, []
    cost[start] = 0.0
    for r in roles:
        new, step = [_FAR] * 4, [None] * 4
        for s in range(4):
            if cost[s] < _FAR:
                for to, c, done in MOVES[r][s]:
                    if cost[s] + c < new[to]:
                        new[to], step[to] = cost[s] + c, (s, done)
        cost = new
        back.append(step)
    if end is None:
        cost = [c + e for c, e in zip(cost, ENDING, strict=True)]
        end = min(range(4), key=cost.__getitem__)
    out, at = [], end
    for step in reversed(back):
        s, done = step[at]
        out.append((ROLES[at - 1], done))
        at = s
    return out[::-1], cost[end], end


def escaped(text: str | None) -> str:
    return (text or "").replace("<|", "<\\|")


def rendered(role: str, text: str, new: bool) -> str:
    """The piece of a turn: it opens its turn, or goes on with the one before."""
    return f"{OPEN}{role}\n{text}" if new else f"\n{text}"


def _role_number() -> Column:
    r = F.lower(F.trim("role"))
    out = F.lit(3)
    for i, name in enumerate(ROLES):
        out = F.when(r.isin(name, *[a for a, of in ALIASES.items() if of == name]), i).otherwise(out)
    return out


_CONVERSATION = ["none", "conv_id"]


def _ordered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(none, conv_id, place, turn, role, text), ``none`` for turns without an id, whose conv_id is 0 here; and how many turns the
    conversations of more than one have (none, conv_id, turns)."""
    id_ = F.col("conv_id").cast("long")
    own = conversations.select(id_.isNull().alias("none"), F.coalesce(id_, F.lit(0)).alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    order = [*_CONVERSATION, "turn", "rank", "h"]
    own = own.withColumns({"rank": _role_number(), "h": F.xxhash64("role", "text")}).repartitionByRange(*order).sortWithinPartitions(*order).select(*_CONVERSATION, "turn", "role", "text")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, last = TaskContext.get().partitionId(), 0, None
        for x in batches:
            ranks = []
            for key in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                n = n + 1 if key == last else 0
                last = key
                ranks.append(n)
            yield pa.RecordBatch.from_arrays([*x.columns, pa.array([part] * len(ranks), pa.int64()), pa.array(ranks, pa.int64())], names=[*_CONVERSATION, "turn", "role", "text", "part", "rank"])

    # Written once: every later step sees the same order.
    turns = written(own.mapInArrow(number, "none boolean, conv_id bigint, turn bigint, role string, text string, part bigint, rank bigint"), "chat-ordered")
    counts = written(turns.groupBy(*_CONVERSATION, "part").agg(F.count("*").alias("n")), "chat-counts")
    # Of two parts side by side at most one conversation goes on from the one to the other, so this has few rows.
    so_far = Window.partitionBy(*_CONVERSATION).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.sum("n").over(so_far)).filter("before > 0").select(*_CONVERSATION, "part", "before")
    placed = turns.join(F.broadcast(before), [*_CONVERSATION, "part"], "left").withColumn("place", F.col("rank") + F.coalesce("before", F.lit(0)))
    return placed.select(*_CONVERSATION, "place", "turn", "role", "text"), counts.groupBy(*_CONVERSATION).agg(F.sum("n").alias("turns"))


def _groups(rows: Iterator[pa.RecordBatch], by: int) -> Iterator[list[tuple]]:
    """Rows that agree in their first ``by`` columns, which lie side by side in a partition; of at most ``RUN`` turns each."""
    held: list[tuple] = []
    for x in slices(rows):
        for row in zip(*(c.to_pylist() for c in x.columns), strict=True):
            if held and held[0][:by] != row[:by]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_REPAIRED = "conv_id bigint, place bigint, turn bigint, role string, new_role string, done string, before string, piece string, cost double"
_KINDS = pa.schema([(n, {"bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for n, k in (c.split() for c in _REPAIRED.split(", "))])


def _repaired(turns: list[tuple], way: list[tuple[str, str]], enters: int, leaves: int, last: bool, cost: float) -> list[tuple]:
    """Rows of the result for (none, conv_id, place, turn, role, text) in order."""
    out = []
    for i, ((none, conv, place, turn, role, text), (new, done)) in enumerate(zip(turns, way, strict=True)):
        *inserted, what = done.split("+")
        opened = i > 0 or enters > 0
        before = (f"{CLOSE}\n" if what == "new" and opened else "") + "".join(f"{OPEN}{r}\n{CLOSE}\n" for r in inserted)
        piece = rendered(new, escaped(text), what == "new")
        if last and i == len(turns) - 1:
            piece += f"{CLOSE}\n" + "".join(f"{OPEN}{r}\n{CLOSE}\n" for r in {1: ("user", "assistant"), 2: ("assistant",)}.get(leaves, ()))
        kind = "merge" if what == "merge" else "keep" if ROLES.index(new) == role_number(role) else "relabel"
        out.append((None if none else conv, place, turn, role, new, kind, before, piece, cost))
    return out


def repair(conversations: DataFrame, run: int = RUN) -> DataFrame:
    """A row (conv_id, place, turn, role, new_role, done, before, piece, cost) per turn, ``place`` from 0 on within a
    conversation: ``before`` are the empty turns rendered in front, ``piece`` is the turn as rendered, with what ends it and
    the conversation. The pieces of a conversation in order of ``place``, each after its ``before``, are its text; ``cost`` is that of
    the whole conversation's repair."""
    prepare(conversations.sparkSession)
    turns, counts = _ordered(conversations)
    long = written(counts.filter(F.col("turns") > run).select(*_CONVERSATION), "chat-long")
    columns = [*_CONVERSATION, "place", "turn", "role", "text"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 2):
            way, cost, leaves = decode([role_number(r[4]) for r in held])
            yield made(_repaired(held, way, 0, leaves, True, cost + sum(unknown(r[4]) for r in held)), _KINDS)

    if long.isEmpty():
        return turns.repartition(*_CONVERSATION).sortWithinPartitions(*_CONVERSATION, "place").select(*columns).mapInArrow(whole, _REPAIRED)
    short = turns.join(long, _CONVERSATION, "left_anti").repartition(*_CONVERSATION).sortWithinPartitions(*_CONVERSATION, "place")
    cut = turns.join(long, _CONVERSATION, "left_semi").withColumn("run", F.floor(F.col("place") / run))
    cut = written(cut.repartition(*_CONVERSATION, "run").sortWithinPartitions(*_CONVERSATION, "run", "place"), "chat-runs")
    by_run = lambda x: x.repartition(*_CONVERSATION, "run").sortWithinPartitions(*_CONVERSATION, "run", "place")
    step = pa.schema([("none", pa.bool_()), ("conv_id", pa.int64()), ("run", pa.int64()), ("costs", pa.list_(pa.float64()))])

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 3):
            m = forward([role_number(r[4]) for r in held]) + sum(unknown(r[4]) for r in held)
            yield made([(*held[0][:3], m.ravel().tolist())], step)

    steps = by_run(cut).select(*_CONVERSATION, "run", "place", "role").mapInArrow(matrices, "none boolean, conv_id bigint, run bigint, costs array<double>")
    state = pa.schema([("none", pa.bool_()), ("conv_id", pa.int64()), ("run", pa.int64()), ("enters", pa.int32()), ("leaves", pa.int32()), ("last", pa.bool_()), ("cost", pa.float64())])

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 2):
            yield made([(*held[0][:2], *x) for x in _chained([r[2:] for r in held])], state)

    chained = steps.repartition(*_CONVERSATION).sortWithinPartitions(*_CONVERSATION, "run").mapInArrow(chain, "none boolean, conv_id bigint, run bigint, enters int, leaves int, last boolean, cost double")
    joined = by_run(cut.join(chained, [*_CONVERSATION, "run"])).select(*_CONVERSATION, "run", "place", "turn", "role", "text", "enters", "leaves", "last", "cost")

    def by_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches, 3):
            enters, leaves, last, cost = held[0][7:]
            way = decode([role_number(r[5]) for r in held], enters, leaves)[0]
            yield made(_repaired([(*r[:2], *r[3:7]) for r in held], way, enters, leaves, last, cost), _KINDS)

    return short.select(*columns).mapInArrow(whole, _REPAIRED).union(joined.mapInArrow(by_runs, _REPAIRED))


def _chained(runs: list[tuple[int, list[float]]]) -> list[tuple]:
    cost, back = np.array([0.0, _FAR, _FAR, _FAR]), []
    for _, c in runs:
        through = cost[:, None] + np.array(c).reshape(4, 4)
        back.append(through.argmin(0))
        cost = through.min(0)
    whole = cost + np.array(ENDING)
    at = int(whole.argmin())
    total, out = float(whole[at]), []
    for i in range(len(runs) - 1, -1, -1):
        out.append((runs[i][0], int(back[i][at]), at, i == len(runs) - 1, total))
        at = int(back[i][at])
    return out[::-1]


def texts(conversations: DataFrame) -> DataFrame:
    """(conv_id, text): the whole rendered text of each conversation. For conversations that fit a task."""
    parts = repair(conversations).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("before", "piece").alias("x")))).alias("p"))
    return parts.select("conv_id", F.array_join(F.transform("p", lambda s: s.x), "").alias("text"))
