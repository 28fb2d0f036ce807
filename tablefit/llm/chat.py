"""Chat formatting with minimum-cost role repair.

A rendered conversation must be legal for an automaton over roles: one system
turn at most, first; then user and assistant in turn; ending with one of them.
Each given turn is kept, relabelled, or merged into the turn before, and empty
turns may be put in; a dynamic program over the automaton's states finds the
cheapest way, and among equally cheap ones one with the fewest turns.

The program runs over role codes.  Turns of a conversation are dealt to blocks
by ranges of `turn`; a range that very many rows share is dealt further by the
order of its rows.  Where a conversation has several blocks each block first
gives its costs from any state to any state, a matrix of 16 numbers; the
matrices of a conversation decide where blocks begin and end, and then every
block is repaired and rendered on its own.  So a conversation of any length is
spread over tasks.

The result has a row per given turn, with the text that it adds to the rendered
conversation: joined in the order of position they are the whole of it.

Defined cases: turns are ordered by turn (null last), then role, then a hash of
the text, so ties and repeated rows are all kept, one after the other.  A null or unknown
role is free to become any, for a smaller cost.  Null text is empty.  Markers
of the template inside a text are broken up.  Rows without a conversation id
are one conversation.  An empty table gives an empty result.  Other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablefit.llm.batches import whole_runs
from tablefit.llm.columns import kept

ROLES = ("system", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
BLOCK = 4096
CROWD = 20_000
#: States are the role of the last turn, and the start.
START, SYSTEM, USER, ASSISTANT = range(4)
OTHER = 4
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
ENDS = (USER, ASSISTANT)
#: Costs count in steps of this, so that numbers of turns can stand below them.
UNIT = 1 << 33
NEVER = 1 << 61


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3
    name: int = 1


@dataclass(frozen=True)
class Step:
    """What happens to one turn: empty turns put in before it, and the role it gets, as a new turn or merged."""

    inserted: tuple[int, ...]
    merged: bool
    role: int
    cost: int
    turns: int

    @property
    def weight(self) -> int:
        return self.cost * UNIT + self.turns


def _paths(state: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Legal runs of empty turns from a state, none longer than the automaton has states."""
    todo = [((), state)]
    while todo:
        path, last = todo.pop(0)
        yield path, last
        if len(path) < 3:
            todo += [((*path, after), after) for after in NEXT[last]]


class Automaton:
    """The cheapest step from each state to each, for each role; and from each state to a legal end."""

    def __init__(self, costs: Costs):
        self.costs = costs
        self.steps = {}
        for role in (SYSTEM, USER, ASSISTANT, OTHER):
            for state in range(4):
                for path, last in _paths(state):
                    paid = costs.insert * len(path)
                    options = [(after, False, 0) for after in NEXT[last]]
                    if last != START:
                        options.append((last, True, costs.merge))
                    for to, merged, extra in options:
                        relabel = 0 if to == role else costs.name if role == OTHER else costs.relabel
                        step = Step(path, merged, to, paid + extra + relabel, len(path) + (not merged))
                        key = role, state, to
                        if key not in self.steps or step.weight < self.steps[key].weight:
                            self.steps[key] = step
        self.close = [
            min(((costs.insert * UNIT + 1) * len(path), path) for path, last in _paths(state) if last in ENDS)
            for state in range(4)
        ]
        self.matrix = {
            role: np.array([[self.steps[role, s, t].weight if (role, s, t) in self.steps else NEVER for t in range(4)] for s in range(4)])
            for role in (SYSTEM, USER, ASSISTANT, OTHER)
        }

    def product(self, roles: bytes) -> np.ndarray:
        """Least weight from each state to each over the turns."""
        total = np.full((4, 4), NEVER)
        np.fill_diagonal(total, 0)
        for role in roles:
            total = np.minimum((total[:, :, None] + self.matrix[role][None]).min(axis=1), NEVER)
        return total

    def repair(self, roles: bytes, start: int, end: int | None) -> list[Step]:
        """The cheapest steps from `start` to `end`, or to the cheapest legal end."""
        best, back = [NEVER] * 4, []
        best[start] = 0
        for role in roles:
            after, via = [NEVER] * 4, [0] * 4
            for to in range(1, 4):
                for state in range(4):
                    step = self.steps.get((role, state, to))
                    if step and best[state] + step.weight < after[to]:
                        after[to], via[to] = best[state] + step.weight, state
            best = after
            back.append(via)
        if end is None:
            end = min(range(4), key=lambda s: best[s] + self.close[s][0])
        steps = []
        for role, via in zip(reversed(roles), reversed(back)):
            steps.append(self.steps[role, via[end], end])
            end = via[end]
        return steps[::-1]


@dataclass(frozen=True)
class Template:
    """How turns are written; `open` may name the role."""

    open: str = "<|im_start|>{role}\n"
    close: str = "<|im_end|>\n"
    join: str = "\n"
    markers: tuple[str, ...] = ("<|im_start|>", "<|im_end|>")

    def text(self, text: str) -> str:
        for marker in self.markers:
            text = text.replace(marker, f"{marker[0]} {marker[1:]}")
        return text

    def opening(self, role: int) -> str:
        return self.open.replace("{role}", ROLES[role - 1])


KEYS = ("conv", "range", "part")
MATRIX_SCHEMA = "conv long, range long, part long, n long, weights array<long>"
ENTRY_SCHEMA = "conv long, range long, part long, entry int, exit int, turns_before long, rows_before long, last boolean"
OUT_SCHEMA = (
    "conv long, turn long, position long, role string, new_role string, action string, out_turn long, "
    "inserted array<string>, inserted_after array<string>, cost int, rendered string"
)


def block_matrices(automaton: Automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, KEYS):
            codes = table.column("code").to_numpy().astype(np.uint8)
            weights = [automaton.product(codes[s:e].tobytes()).ravel().tolist() for s, e in zip(starts[:-1], starts[1:])]
            firsts = table.take(pa.array(starts[:-1]))
            yield pa.table({k: firsts.column(k) for k in KEYS} | {"n": pa.array(np.diff(starts)), "weights": pa.array(weights, pa.list_(pa.int64()))}).combine_chunks().to_batches()[0]
    return run


def block_entries(automaton: Automaton):
    """From the matrices of each conversation: the states in which its blocks begin and end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_runs(batches, ("conv",)):
            for s, e in zip(starts[:-1], starts[1:]):
                part = table.slice(s, e - s)
                matrices = [np.array(w).reshape(4, 4).tolist() for w in part.column("weights").to_pylist()]
                best, back = [0, None, None, None], []
                for m in matrices:
                    after, via = [None] * 4, [0] * 4
                    for to in range(4):
                        for state in range(4):
                            if best[state] is not None and m[state][to] < NEVER:
                                weight = best[state] + m[state][to]
                                if after[to] is None or weight < after[to]:
                                    after[to], via[to] = weight, state
                    best = after
                    back.append(via)
                state = min((s for s in range(4) if best[s] is not None), key=lambda s: best[s] + automaton.close[s][0])
                ends = []
                for via in reversed(back):
                    ends.append((via[state], state))
                    state = via[state]
                ends.reverse()
                turns = np.cumsum([0, *(m[a][b] % UNIT for m, (a, b) in zip(matrices, ends))]).tolist()
                rows = np.cumsum([0, *part.column("n").to_pylist()]).tolist()
                n = len(ends)
                yield pa.table({k: part.column(k) for k in KEYS} | {
                    "entry": pa.array([a for a, _ in ends], pa.int32()), "exit": pa.array([b for _, b in ends], pa.int32()),
                    "turns_before": pa.array(turns[:-1], pa.int64()),
                    "rows_before": pa.array(rows[:-1], pa.int64()), "last": pa.array([i == n - 1 for i in range(n)]),
                }).combine_chunks().to_batches()[0]
    return run


def rendered(automaton: Automaton, template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps_of = lru_cache(maxsize=4096)(automaton.repair)
        names = [f.split()[0] for f in OUT_SCHEMA.split(", ")]
        for table, starts in whole_runs(batches, KEYS):
            codes = table.column("code").to_numpy().astype(np.uint8)
            conv, turn, role, text = (table.column(c).to_pylist() for c in ("conv", "turn", "role", "text"))
            entry, exit_, before, place, last = (
                table.column(c).to_pylist() for c in ("entry", "exit", "turns_before", "rows_before", "last")
            )
            rows = []
            for s, e in zip(starts[:-1].tolist(), starts[1:].tolist()):
                alone = entry[s] is None
                state, final = (START, True) if alone else (entry[s], last[s])
                # a block of a long conversation ends where its neighbour begins; the last one ends legally
                steps = steps_of(codes[s:e].tobytes(), state, None if alone else exit_[s])
                out, first = (0, 0) if alone else (before[s], place[s])
                for i, step in zip(range(s, e), steps):
                    pieces = []
                    for put in step.inserted:
                        pieces.append((template.close if state != START else "") + template.opening(put))
                        state = put
                    if step.merged:
                        pieces.append(template.join)
                    else:
                        pieces.append((template.close if state != START else "") + template.opening(step.role))
                    out += step.turns
                    pieces.append(template.text(text[i]))
                    state, after = step.role, ()
                    if final and i == e - 1:
                        after = automaton.close[state][1]
                        pieces += [template.close + template.opening(put) for put in after]
                        pieces.append(template.close)
                    known = codes[i] == step.role
                    action = ("merge" if known else "merge and relabel") if step.merged else ("keep" if known else "relabel")
                    rows.append((
                        conv[i], turn[i], first + i - s, role[i], ROLES[step.role - 1], action, out - 1,
                        [ROLES[r - 1] for r in step.inserted], [ROLES[r - 1] for r in after],
                        step.cost + automaton.costs.insert * len(after), "".join(pieces),
                    ))
            for at in range(0, len(rows), 5000):
                columns = list(zip(*rows[at:at + 5000]))
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(),
                         pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
    return run


def _joined(rows: DataFrame, table: DataFrame, keys: tuple[str, ...], how: str) -> DataFrame:
    """Join on keys that may be null."""
    renamed = table.select(*(F.col(c).alias(f"{c}_2" if c in keys else c) for c in table.columns))
    same = [F.col(k).eqNullSafe(F.col(f"{k}_2")) for k in keys]
    return rows.join(renamed, same, how).drop(*(f"{k}_2" for k in keys))


def format_chats(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    costs: Costs = Costs(), template: Template = Template(),
) -> DataFrame:
    """One row per given turn: its place in the conversation, how it was repaired, and the text it adds."""
    automaton = Automaton(costs)
    name = F.lower(F.trim(F.col(role_col)))
    code = F.lit(OTHER)
    for place, own in enumerate(ROLES, 1):
        code = F.when(name.isin(own, *(a for a, r in ALIASES.items() if r == own)), place).otherwise(code)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).cast("long").alias("turn"),
        F.col(role_col).alias("role"), text.alias("text"), code.alias("code"),
        F.coalesce(F.col(turn_col).cast("long"), F.lit((1 << 63) - 1)).alias("turn_or_last"),
        F.shiftrightunsigned(F.xxhash64(text), 16).alias("mark"),
    )
    rows = rows.withColumns({"range": F.floor(F.col("turn_or_last") / BLOCK).cast("long"), "part": F.lit(0).cast("long")})
    order = (*KEYS, "turn_or_last", "code", "mark", "text")
    crowds = kept(
        rows.groupBy("conv", "range").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("conv", "range", F.lit(True).alias("crowded")),
        "chat-crowds",
    )
    if not crowds.isEmpty():
        # the place of a row in its range: by turn and role, and 2^16 steps of the mark
        part = (F.pmod("turn_or_last", F.lit(BLOCK)) * 5 + F.col("code")) * (1 << 16) + F.shiftright("mark", 32)
        rows = _joined(rows, crowds, ("conv", "range"), "left").withColumn(
            "part", F.when(F.col("crowded"), part).otherwise(0).cast("long")
        ).drop("crowded")
    several = kept(
        rows.select(*KEYS).distinct().groupBy("conv").agg(F.count("*").alias("n")).where("n > 1").select("conv"), "chat-long"
    )
    none = (F.lit(None).cast(kind).alias(c) for c, kind in (f.split() for f in ENTRY_SCHEMA.split(", ")[3:]))
    if several.isEmpty():
        rows = rows.select("*", *none)
    else:
        long = _joined(rows.select(*order[:-1]), several, ("conv",), "left_semi")
        matrices = long.repartition(*KEYS).sortWithinPartitions(*order[:-1]).mapInArrow(block_matrices(automaton), MATRIX_SCHEMA)
        entries = kept(
            matrices.repartition("conv").sortWithinPartitions(*KEYS).mapInArrow(block_entries(automaton), ENTRY_SCHEMA),
            "chat-entries",
        )
        rows = _joined(rows, entries, KEYS, "left")
    found = rows.repartition(*KEYS).sortWithinPartitions(*order).mapInArrow(rendered(automaton, template), OUT_SCHEMA)
    return found.withColumnsRenamed({"conv": conv_col, "turn": turn_col})
