"""Chat formatting: minimum-cost repair of roles by dynamic programming over an automaton of legal turns."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.shared import tasks

ROLES = ("system", "user", "assistant")
#: Which role may follow which (None: the start). A conversation may end after an assistant's turn.
LEGAL = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
#: Costs of joining a turn to the one before, of a known role replaced, of an unknown one replaced, of an empty turn put in.
MERGE, RELABEL, UNKNOWN, INSERT = 1, 2, 1, 3


@dataclass(frozen=True)
class Step:
    """What happens to a turn: empty turns put in before it, the role it gets, and whether it joins the turn before."""

    inserts: tuple[str, ...]
    role: str
    merge: bool
    cost: int


def _ways() -> dict[str | None, list[Step]]:
    """All steps from a state, cheapest first: on to a legal role, merging, or over one empty turn."""
    out = {}
    for state, follows in LEGAL.items():
        steps = [Step((), r, False, 0) for r in follows]
        if state is not None:
            steps.append(Step((), state, True, MERGE))
        steps += [Step((x,), r, False, INSERT) for x in follows for r in LEGAL[x]]
        out[state] = sorted(steps, key=lambda s: s.cost)
    return out


WAYS = _ways()


def repair(roles: list[str | None]) -> tuple[int, list[Step], tuple[str, ...]]:
    """The least cost, a step for each turn, and the empty turns put in at the end. Of equal costs, the first in the order of ROLES and WAYS."""
    best: dict[str | None, int] = {None: 0}
    trail: list[dict[str, tuple[str | None, Step]]] = []
    for role in roles:
        now: dict[str | None, int] = {}
        how: dict[str, tuple[str | None, Step]] = {}
        for state, cost in best.items():
            for step in WAYS[state]:
                change = 0 if step.role == role else RELABEL if role in ROLES else UNKNOWN
                total = cost + step.cost + change
                if step.role not in now or total < now[step.role]:
                    now[step.role], how[step.role] = total, (state, step)
        best = {r: now[r] for r in ROLES if r in now}
        trail.append(how)
    ends = {state: () if state in (None, "assistant") else ("assistant",) if state == "user" else ("user", "assistant") for state in best}
    last = min(best, key=lambda s: best[s] + INSERT * len(ends[s]))
    total, steps, state = best[last] + INSERT * len(ends[last]), [], last
    for how in reversed(trail):
        state, step = how[state]
        steps.append(step)
    return total, steps[::-1], ends[last]


def render(steps: list[Step], texts: list[str | None], end: tuple[str, ...]) -> str:
    turns: list[list] = []
    for step, text in zip(steps, texts, strict=True):
        turns += [[r, ""] for r in step.inserts]
        if step.merge:
            turns[-1][1] += "\n" + (text or "")
        else:
            turns.append([step.role, text or ""])
    turns += [[r, ""] for r in end]
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


SCHEMA = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("n_turns", "n_rendered", "cost", "n_merges", "n_relabels", "n_inserts")), ("rendered", pa.string())])


def _formatted(conv: int | None, roles: list[str | None], texts: list[str | None]) -> tuple:
    roles = [r.strip().lower() if r is not None else None for r in roles]
    cost, steps, end = repair(roles)
    merges, relabels = sum(s.merge for s in steps), sum(s.role != r for s, r in zip(steps, roles, strict=True))
    inserts = sum(len(s.inserts) for s in steps) + len(end)
    return conv, len(roles), len(roles) - merges + inserts, cost, merges, relabels, inserts, render(steps, texts, end)


def format_chats(turns: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, n_rendered, cost, n_merges, n_relabels, n_inserts, rendered.

    turns: conv_id, turn, role, text; other columns are ignored. Turns are in order by turn (null last), then role, then
    text, so ties and repeated rows have one order; repeated rows are turns of their own. A null text is empty; roles are compared in
    lower case, trimmed; null and unknown roles can become any. A row without conv_id is a conversation of its own, as
    nothing says which it belongs to. An empty table gives no rows. A conversation is rendered to one string and so by one task, which reads its turns as a stream.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, roles, texts, done, size = None, [], [], [], 0
        for batch in batches:
            for c, role, text in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if roles and (c is None or c != conv):
                    done.append(_formatted(conv, roles, texts))
                    size += len(done[-1][-1])
                    roles, texts = [], []
                conv = c
                roles.append(role)
                texts.append(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)
                    done, size = [], 0
        if roles:
            done.append(_formatted(conv, roles, texts))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], f.type) for i, f in enumerate(SCHEMA)], schema=SCHEMA)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition(tasks(turns.sparkSession), F.coalesce("conv_id", F.xxhash64("turn", "role", "text")))
    rows = rows.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")
    ddl = "conv_id long, n_turns long, n_rendered long, cost long, n_merges long, n_relabels long, n_inserts long, rendered string"
    return rows.mapInArrow(work, ddl)
