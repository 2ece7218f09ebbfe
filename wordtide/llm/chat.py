"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant turns in
alternation, beginning with the user. Dynamic programming over that automaton finds, for
the turns as they came, the cheapest way into it: a turn stays (0), is
relabelled (RELABEL), is joined to the turn before it (MERGE, relabelled as well
where the roles differ), or empty turns are inserted before it (INSERT each).
The repaired turns are rendered in the ChatML form.

Defined for every input: a null or unknown role fits none and is relabelled;
known aliases (human, bot, model, ...) count as their role; a null text is
an empty one; turns are ordered by number, role and text, a null number first;
repeated rows are one turn; rows without a conversation id are left out; of
repairs of equal cost the one that stays, then merges, then relabels, then inserts
earliest in the conversation is chosen; control strings inside a text are
broken by a space, so that no text can open or close a turn; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MERGE, RELABEL, INSERT = 1, 2, 3

ROLES = ("system", "user", "assistant")
#: From the role of the last turn ("" at the beginning) to those that may follow.
LEGAL = {"": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
FINAL = ("", "user", "assistant")
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "agent": "assistant", "developer": "system"}

SCHEMA = "conv_id long, text string, turns int, cost int, merges int, relabels int, inserts int"

_CONTROL = re.compile(r"<\|(?=[^\s<>|]+\|>)")


def _fillers(a: str, b: str) -> tuple[str, ...] | None:
    """The shortest run of inserted roles after a that makes b legal."""
    level: list[tuple[str, ...]] = [()]
    for _ in range(3):
        for path in level:
            if b in LEGAL[path[-1] if path else a]:
                return path
        level = [(*p, r) for p in level for r in LEGAL[p[-1] if p else a]]
    return None


_FILL = {(a, b): _fillers(a, b) for a in LEGAL for b in ROLES}


@lru_cache(1 << 16)
def repair(roles: tuple[str | None, ...]) -> tuple[int, tuple[tuple[str, str, tuple[str, ...]], ...]]:
    """(cost, (action, role, inserted roles before it) of every turn); the action is keep, merge or relabel."""
    # best[k][s]: the least cost of turns k.. after a turn of role s, found from the end
    n = len(roles)
    best: list[dict[str, tuple[int, tuple | None, str]]] = [{} for _ in range(n + 1)]
    far = 1 << 30
    best[n] = {s: (0 if s in FINAL else INSERT, None, s) for s in LEGAL}
    for k in range(n - 1, -1, -1):
        for s in LEGAL:
            options = []
            for order, role in enumerate(ROLES):
                change = 0 if roles[k] == role else RELABEL
                after = best[k + 1][role][0]
                if role == s:
                    options.append((after + MERGE + change, 1, order, ("merge", role, ())))
                fill = _FILL[s, role]
                if fill is not None:
                    rank = (3 if fill else 2) if change or fill else 0
                    options.append((after + change + INSERT * len(fill), rank, order, ("relabel" if change else "keep", role, fill)))
            cost, _, _, act = min(options) if options else (far, 0, 0, None)
            best[k][s] = (cost, act, act[1] if act else s)
    acts, s = [], ""
    for k in range(n):
        _, act, s = best[k][s]
        acts.append(act)
    return best[0][""][0], tuple(acts)


def render(turns: list[tuple[str, str]]) -> str:
    return "".join(f"<|im_start|>{role}\n{text}<|im_end|>\n" for role, text in turns)


def format_conversation(turns: list[tuple[str | None, str | None]]) -> tuple[str, int, int, int, int, int]:
    """(text, turns, cost, merges, relabels, inserts) of (role, text) turns in order."""
    roles = tuple((lambda r: ALIASES.get(r, r))((role or "").strip().lower()) for role, _ in turns)
    roles = tuple(r if r in ROLES else None for r in roles)
    cost, acts = repair(roles)
    out: list[tuple[str, str]] = []
    merges = relabels = inserts = 0
    for (action, role, fill), own, (_, text) in zip(acts, roles, turns):
        text = _CONTROL.sub("< |", text or "")
        relabels += own != role
        if action == "merge":
            merges += 1
            out[-1] = (role, f"{out[-1][1]}\n\n{text}")
            continue
        inserts += len(fill)
        out += [(r, "") for r in fill]
        out.append((role, text))
    if out and out[-1][0] not in FINAL:
        inserts += 1
        out.append(("user", ""))
    return render(out), len(out), cost, merges, relabels, inserts


def _format(batches):
    for b in batches:
        done = [format_conversation([(t["role"], t["text"]) for t in turns]) for turns in b.column("turns").to_pylist()]
        kinds = (pa.string(), *[pa.int32()] * 5)
        columns = [pa.array([d[k] for d in done], kind) for k, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), *columns], ["conv_id", "text", "turns", "cost", "merges", "relabels", "inserts"])


def chats(spark: SparkSession, turns: DataFrame) -> DataFrame:
    """One rendered, repaired conversation for each id of ``turns(conv_id, turn, role, text)``."""
    one = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    whole = one.filter("conv_id IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_set("t")).alias("turns"))
    return whole.mapInArrow(_format, SCHEMA)
