"""Stateful processors: last-wins state, task leases and online prediction."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def last_wins(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """Current row of each key, for update mode; out-of-order and repeated rows do no harm."""
    rest = [c for c in events.columns if c not in keys]
    latest = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return latest.select(*keys, *(F.col(f"_last.`{c}`").alias(c) for c in rest))


def _lift(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    import json

    follow, prev, seq, total, predictable, hits = json.loads(state.get[0]) if state.exists else ({}, None, -1, 0, 0, 0)
    rows = pd.concat(list(frames)).drop_duplicates("seq").sort_values("seq")
    for s, item in zip(rows["seq"].tolist(), rows["item"].tolist(), strict=True):
        if s <= seq:  # delivered again
            continue
        seq, total = s, total + 1
        if prev is not None:
            counts = follow.setdefault(str(prev), {})
            if counts:
                predictable += 1
                hits += min(counts, key=lambda i: (-counts[i], int(i))) == str(item)
            counts[str(item)] = counts.get(str(item), 0) + 1
        prev = item
    state.update((json.dumps((follow, prev, seq, total, predictable, hits)),))
    yield pd.DataFrame({"tenant": [key[0]], "total": [total], "predictable": [predictable], "hits": [hits]})


def online_lift(accesses: DataFrame) -> DataFrame:
    """(tenant, total, predictable, hits) so far, for update mode, of a stream of (tenant, seq, item).

    Sequence numbers must not run backwards from one batch to the next within a tenant.
    """
    return accesses.groupBy("tenant").applyInPandasWithState(
        _lift, "tenant int, total long, predictable long, hits long", "model string", "update", GroupStateTimeout.NoTimeout
    )


def _sweep(current: str, holder: str, lease: int, deadline: int, now: int) -> tuple[str, str, int]:
    """A lapsed claim frees up, then an open task past its deadline is overdue and keeps holder and lease."""
    if current == "claimed" and now > lease:
        current, holder, lease = "pending", "", 0
    if current in ("pending", "claimed") and 0 < deadline < now:
        current = "overdue"
    return current, holder, lease


def _tasks(sweep_ms: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, holder, lease, deadline, seq, owner = state.get if state.exists else ("pending", "", 0, 0, -1, "")
        if state.hasTimedOut:
            rows = []
            current, holder, lease = _sweep(current, holder, lease, deadline, state.getCurrentProcessingTimeMs() * 1_000_000)
        else:
            rows = pd.concat(list(frames)).drop_duplicates("seq").sort_values("seq").itertuples(index=False)
        now = 0
        for r in rows:
            if r.seq <= seq:
                continue
            seq, now = r.seq, max(now, r.now_ns)
            if r.action == "post":
                deadline, owner = r.deadline, r.by
            elif r.action == "claim" and (current == "pending" or (current in ("claimed", "overdue") and (r.now_ns > lease or holder == r.by))):
                current, holder, lease = "claimed", r.by, r.now_ns + r.ttl_ns
            elif r.action in ("done", "cancel") and current not in ("done", "cancel") and r.by in (holder, owner) and r.by != "":
                current = r.action
            elif r.action == "sweep":
                current, holder, lease = _sweep(current, holder, lease, deadline, r.now_ns)
        state.update((current, holder, lease, deadline, seq, owner))
        if sweep_ms and current not in ("done", "cancel"):
            state.setTimeoutDuration(sweep_ms)
        yield pd.DataFrame({"tenant": [key[0]], "task_seq": [key[1]], "state": [current], "holder": [holder], "lease_until": [lease], "deadline": [deadline]})

    return run


def task_leases(actions: DataFrame, sweep_ms: int | None = None) -> DataFrame:
    """State of each task after a stream of (tenant, task_seq, seq, action, by, now_ns, ttl_ns, deadline), for update mode.

    Actions are post, claim, done, cancel and sweep; a sweep frees lapsed claims and flags late
    tasks. The holder and the one who posted may finish a task. With ``sweep_ms`` every open
    task is also swept by a timer, that long after its last change.
    """
    return actions.groupBy("tenant", "task_seq").applyInPandasWithState(
        _tasks(sweep_ms),
        "tenant int, task_seq long, state string, holder string, lease_until long, deadline long",
        "state string, holder string, lease long, deadline long, seq long, owner string",
        "update",
        GroupStateTimeout.ProcessingTimeTimeout if sweep_ms else GroupStateTimeout.NoTimeout,
    )


def _windows(k: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, window, uses, text = state.get if state.exists else (-1, 0, 0, "")
        rows = pd.concat(list(frames)).drop_duplicates("seq").sort_values("seq")
        out = []
        for at, is_tool, said in zip(rows["seq"].tolist(), rows["is_tool"].tolist(), rows["text"].tolist(), strict=True):
            if at <= seq:  # delivered again
                continue
            seq, said = at, (said or "").strip()
            text += f"{said}\n" if said else ""
            uses += bool(is_tool)
            if uses == k:
                out.append((*key, window, uses, text))
                window, uses, text = window + 1, 0, ""
        if uses or text:
            out.append((*key, window, uses, text))  # as far as it has come
        state.update((seq, window, uses, text))
        yield pd.DataFrame(out, columns=["tenant", "area", "window", "tool_uses", "text"])

    return run


def tool_windows(blocks: DataFrame, k: int) -> DataFrame:
    """(tenant, area, window, tool_uses, text), for update mode: windows that close with every k-th tool use, the open one as far as it has come.

    ``blocks`` has (tenant, area, seq, is_tool, text). Sequence numbers must not run backwards
    from one batch to the next within an area; what is delivered again is skipped.
    """
    return blocks.groupBy("tenant", "area").applyInPandasWithState(
        _windows(max(k, 1)), "tenant int, area string, window int, tool_uses int, text string", "seq long, window int, uses int, text string", "update", GroupStateTimeout.NoTimeout
    )


def _ring(size: int):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seqs, tops = state.get if state.exists else ([], [])
        held = dict(zip(seqs, tops, strict=True))
        for frame in frames:
            held.update(zip(frame["seq"].tolist(), frame["top_dist"].tolist(), strict=True))
        held = {s: None if t is None or t != t else float(t) for s, t in sorted(held.items())[-size:]}
        state.update((list(held), list(held.values())))
        some = sorted(t for t in held.values() if t is not None)
        at = lambda f: some[min(int(f * len(some)), len(some) - 1)] if some else 0.0
        yield pd.DataFrame([(key[0], len(held), len(held) - len(some), at(0), at(0.5), at(0.9), at(1))], columns=["tenant", "total", "empty", "top_min", "top_p50", "top_p90", "top_max"])

    return run


def recall_ring(recalls: DataFrame, size: int = 500) -> DataFrame:
    """Coverage of the last ``size`` recalls of each tenant, for update mode, of a stream of (tenant, seq, top_dist); late rows take their place by ``seq``."""
    return recalls.groupBy("tenant").applyInPandasWithState(
        _ring(size), "tenant int, total long, empty long, top_min double, top_p50 double, top_p90 double, top_max double", "seqs array<long>, tops array<double>", "update", GroupStateTimeout.NoTimeout
    )


def nudges(messages: DataFrame, subscribers: DataFrame, deliver, checkpoint: str, trigger: dict | None = None):
    """Start a query that calls ``deliver(frame)`` once a batch with the highest new seq of each subscriber (tenant, target)."""

    def each(batch: DataFrame, _: int) -> None:
        reached = batch.join(subscribers, ["tenant", "target"])
        deliver(reached.groupBy("tenant", "target").agg(F.max("seq").alias("seq")))

    return messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
