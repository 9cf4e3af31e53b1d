"""Messages, tasks, presence and blobs as last-wins state over an append-only log.

Times are nanoseconds, 0 is "none". Every operator takes records already counted once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.functions.text import compact_age, html_unescape, task_suffix

TERMINAL = ("done", "cancel")
STATES = ("pending", "claimed", "overdue", *TERMINAL)


def unexpired(messages: DataFrame, now_ns: int) -> DataFrame:
    """Messages without an expiry, or not past it: expired only if now > expiry."""
    return messages.filter((F.col("expires_ns") == 0) | (F.col("expires_ns") >= now_ns))


def after_clears(messages: DataFrame, clears: DataFrame) -> DataFrame:
    """Messages not older than the last clear of their tenant and area."""
    cut = clears.groupBy("tenant", "area").agg(F.max("seq").alias("_cut"))
    return messages.join(cut, ["tenant", "area"], "left").filter(F.col("_cut").isNull() | (F.col("seq") >= F.col("_cut"))).drop("_cut")


def inbox(messages: DataFrame, tenant: int, target: str, since: int = 0) -> DataFrame:
    return messages.filter((F.col("tenant") == tenant) & (F.col("target") == target) & (F.col("seq") > since))


def read_area(messages: DataFrame, tenant: int, area: str, since: int = 0, target: str | None = None, cap: int = 100) -> DataFrame:
    """The last ``cap`` messages of an area, of those then the broadcasts and the ones for ``target``."""
    rows = messages.filter((F.col("tenant") == tenant) & (F.col("area") == area) & (F.col("seq") > since))
    rows = rows.orderBy(F.desc("seq")).limit(cap)
    return rows if target is None else rows.filter(F.col("target").isin("", target))


def recent(messages: DataFrame, n: int) -> DataFrame:
    """The last n messages, oldest first."""
    return messages.orderBy(F.desc("seq")).limit(n).orderBy("seq")


def retained(messages: DataFrame, now_ns: int, max_age_ns: int, last_n: int) -> DataFrame:
    """Messages younger than the age limit, then the last n of each tenant among them; 0 turns a rule off."""
    if max_age_ns > 0:
        messages = messages.filter(F.col("ts_ns") >= now_ns - max_age_ns)
    if last_n > 0:
        newest = Window.partitionBy("tenant").orderBy(F.desc("seq"))
        messages = messages.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= last_n).drop("_r")
    return messages


def last_wins(events: DataFrame, keys: list[str], seq: str = "seq") -> DataFrame:
    """The row with the highest sequence number of each key; partial maxima are combined before the shuffle."""
    rest = [c for c in events.columns if c not in keys]
    latest = events.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_last"))
    return latest.select(*keys, *(F.col(f"_last.`{c}`").alias(c) for c in rest))


def task_states(tasks: DataFrame, states: DataFrame) -> DataFrame:
    """(tenant, seq, state, holder, lease_until, deadline) of live tasks; tasks without a state are pending.

    ``states`` has (tenant, task_seq, seq, state, holder, lease_until); states of tasks that are not live are ignored.
    """
    last = last_wins(states, ["tenant", "task_seq"]).select("tenant", F.col("task_seq").alias("seq"), "state", "holder", "lease_until")
    return tasks.select("tenant", "seq", F.col("deadline_ns").alias("deadline")).join(last, ["tenant", "seq"], "left").select(
        "tenant", "seq", F.coalesce("state", F.lit("pending")).alias("state"), F.coalesce("holder", F.lit("")).alias("holder"), F.coalesce("lease_until", F.lit(0)).alias("lease_until"), "deadline"
    )


def sweep(state: DataFrame, now_ns: int) -> DataFrame:
    """One expiry pass: a claim whose lease is over frees up, then an open task past its deadline is overdue.

    Overdue tasks keep holder and lease. ``nudges`` counts the flips, so a task can take both.
    """
    freed = (F.col("state") == "claimed") & (F.col("lease_until") < now_ns)
    mid = F.when(freed, "pending").otherwise(F.col("state"))
    late = ~mid.isin(*TERMINAL, "overdue") & (F.col("deadline") > 0) & (F.col("deadline") < now_ns)
    return state.select(
        "tenant", "seq",
        F.when(late, "overdue").otherwise(mid).alias("state"),
        F.when(freed, "").otherwise(F.col("holder")).alias("holder"),
        F.when(freed, 0).otherwise(F.col("lease_until")).alias("lease_until"),
        "deadline", (freed.cast("int") + late.cast("int")).alias("nudges"),
    )


def _claims(stream: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    key, state, holder, lease, owner = None, "pending", "", 0, ""
    for frame in stream:
        out = []
        for r in frame.itertuples(index=False):
            if (r.tenant, r.task_seq) != key:
                key, state, holder, lease, owner = (r.tenant, r.task_seq), "pending", "", 0, r.owner
            fine = False
            if r.action == "claim":
                fine = state == "pending" or (state in ("claimed", "overdue") and (r.now_ns > lease or holder == r.by))
                if fine:
                    state, holder, lease = "claimed", r.by, r.now_ns + r.ttl_ns
            elif r.action in TERMINAL:
                fine = state not in TERMINAL and r.by in (holder, owner) and r.by != ""
                if fine:
                    state = r.action
            elif r.action == "overdue":
                fine = state in ("pending", "claimed")
                if fine:
                    state = "overdue"
            out.append((r.tenant, r.task_seq, r.seq, fine, state, holder, lease))
        yield pd.DataFrame(out, columns=["tenant", "task_seq", "seq", "granted", "state", "holder", "lease_until"])


def replay_claims(requests: DataFrame) -> DataFrame:
    """Claim, resolve (done, cancel) and overdue requests in order per task: who was granted, and the state after.

    ``requests`` has (tenant, task_seq, seq, action, by, owner, now_ns, ttl_ns). A task is
    claimable if pending, or if its lease is over or its holder asks again; only the holder
    or the owner resolves. Rows stream through in order, so only one task's state is held.
    """
    rows = requests.select("tenant", "task_seq", "seq", "action", "by", "owner", "now_ns", "ttl_ns")
    ordered = rows.repartition("tenant", "task_seq").sortWithinPartitions("tenant", "task_seq", "seq")
    return ordered.mapInPandas(_claims, "tenant int, task_seq long, seq long, granted boolean, state string, holder string, lease_until long")


def presence(beats: DataFrame, now_ns: int, max_age_ns: int) -> DataFrame:
    """Last status of each agent of a tenant, stale ones dropped."""
    return last_wins(beats, ["tenant", "agent"]).filter(F.lit(now_ns) - F.col("ts_ns") <= max_age_ns)


def pinned(pins: DataFrame) -> DataFrame:
    """Blobs any tenant has pinned last."""
    return last_wins(pins, ["tenant", "blob_id"]).filter("on").select("blob_id").distinct()


def keep_set(messages: DataFrame, pins: DataFrame) -> DataFrame:
    """Blobs referenced by a live message of any tenant or pinned by one."""
    return messages.filter("blob_id <> ''").select("blob_id").union(pinned(pins)).distinct()


def collectable(stored: DataFrame, keep: DataFrame) -> DataFrame:
    """Stored blobs that nothing keeps."""
    return stored.join(keep, "blob_id", "left_anti")


def kanban(messages: DataFrame) -> DataFrame:
    """Per tenant and unescaped area: first and last message, number of messages, agents, open questions and replies."""
    rows = messages.withColumn("area", html_unescape(F.coalesce("area", F.lit(""))))
    return rows.groupBy("tenant", "area").agg(
        F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n_messages"),
        F.countDistinct(F.nullif(F.trim("sender"), F.lit(""))).alias("n_agents"), F.count_if(F.col("ref_seq") != 0).alias("n_replies"),
    )


def promote(messages: DataFrame) -> DataFrame:
    """Messages as memory texts '[from area#seq] text' tagged 'promoted'."""
    return messages.select("tenant", "seq", F.concat(F.lit("[from "), F.coalesce("area", F.lit("")), F.lit("#"), F.col("seq").cast("string"), F.lit("] "), F.coalesce("text", F.lit(""))).alias("text"), F.array(F.lit("promoted")).alias("tags"))


def combined(messages: DataFrame, images: DataFrame) -> DataFrame:
    """Messages and image references as one index."""
    return messages.unionByName(images)


def rebuild(messages: DataFrame, images: DataFrame, clears: DataFrame, states: DataFrame, pins: DataFrame, now_ns: int) -> dict[str, DataFrame]:
    """The index after a start: live ``messages``, ``tasks`` with their state, ``pins`` (tenant, blob_id).

    Expired messages are left out, then cleared ones; a task without a state is pending, a
    state without a live task is ignored.
    """
    live = after_clears(unexpired(combined(messages, images), now_ns), clears)
    return {
        "messages": live,
        "tasks": task_states(live.filter("kind = 'task'"), states),
        "pins": last_wins(pins, ["tenant", "blob_id"]).filter("on").select("tenant", "blob_id"),
    }


def sweep_all(index: dict[str, DataFrame], beats: DataFrame, now_ns: int, presence_age_ns: int, max_age_ns: int, last_n: int) -> dict[str, DataFrame]:
    """One pass of the sweeper: leases and deadlines, expiry, stale presence, retention; a dropped task loses its state.

    ``nudges`` has (tenant, seq, area, target, n): messages whose task changed its state, once for each change, also if the message goes.
    """
    swept = sweep(index["tasks"], now_ns)
    at = index["messages"].select("tenant", "seq", "area", "target")
    nudges = swept.filter("nudges > 0").join(at, ["tenant", "seq"]).select("tenant", "seq", "area", "target", F.col("nudges").alias("n"))
    kept = retained(unexpired(index["messages"], now_ns), now_ns, max_age_ns, last_n)
    tasks = swept.drop("nudges").join(kept.select("tenant", "seq"), ["tenant", "seq"], "left_semi")
    return {"messages": kept, "tasks": tasks, "presence": presence(beats, now_ns, presence_age_ns), "nudges": nudges}


def posted(requests: DataFrame) -> DataFrame:
    """Posts as records: kind 'note' unless given, 'image' with a blob; ``error`` tells what is missing."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    image = ~blank("blob_id")
    error = F.when(image & (blank("area") | blank("sender") | blank("mime")), "area, from, blob and mime are required for an image").when(
        ~image & (blank("area") | blank("sender") | blank("text")), "area, from and text are required"
    )
    kind = F.when(image, "image").when(blank("kind"), "note").otherwise(F.col("kind"))
    return requests.withColumn("kind", kind).withColumn("error", error)


def cleared(messages: DataFrame, clears: DataFrame) -> DataFrame:
    """(tenant, area, seq, dropped): of each clear, how many messages it drops that no earlier clear has dropped."""
    marks = clears.select("tenant", "area", F.col("seq").alias("cut")).distinct()
    before = Window.partitionBy("tenant", "area").orderBy("cut")
    ranges = marks.withColumn("since", F.coalesce(F.lag("cut").over(before), F.lit(0)))
    held = messages.select("tenant", "area", F.col("seq").alias("at"))
    hit = (F.col("at") >= F.col("since")) & (F.col("at") < F.col("cut"))
    counts = ranges.join(held, ["tenant", "area"], "left").groupBy("tenant", "area", "cut").agg(F.count_if(hit).alias("dropped"))
    return counts.select("tenant", "area", F.col("cut").alias("seq"), "dropped")


def get(messages: DataFrame, tenant: int, seq: int, area: str | None = None) -> DataFrame:
    """The message with a sequence number, of the tenant only; with ``area`` also of that area only."""
    rows = messages.filter((F.col("tenant") == tenant) & (F.col("seq") == seq))
    return rows if area is None else rows.filter(F.col("area") == area)


def reached(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(subscriber, tenant, seq): messages a subscriber hears: sent to its target, or in one of its areas.

    ``subscribers`` has (subscriber, tenant, target, areas).
    """
    own = subscribers.select("subscriber", "tenant", F.explode(F.array(F.col("target"))).alias("target")).filter("target <> ''")
    areas = subscribers.select("subscriber", "tenant", F.explode("areas").alias("area"))
    rows = messages.select("tenant", "seq", "target", "area")
    by_target = rows.join(own, ["tenant", "target"]).select("subscriber", "tenant", "seq")
    return by_target.union(rows.join(areas, ["tenant", "area"]).select("subscriber", "tenant", "seq")).distinct()


def cursors(messages: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(subscriber, tenant, seq): the highest sequence number each subscriber has to hear of."""
    return reached(messages, subscribers).groupBy("subscriber", "tenant").agg(F.max("seq").alias("seq"))


def rendered(messages: DataFrame, tasks: DataFrame) -> DataFrame:
    """(tenant, seq, line): messages as '#seq [kind] from→target @area: text' with the state of their task."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    state = tasks.select("tenant", "seq", "state", "holder", "lease_until", "deadline")
    target = F.when(text("target") != "", F.concat(F.lit("→"), F.col("target"))).otherwise("")
    head = F.concat(F.lit("#"), F.col("seq").cast("string"), F.lit(" ["), text("kind"), F.lit("] "), text("sender"), target, F.lit(" @"), text("area"), F.lit(": "), text("text"))
    return messages.join(state, ["tenant", "seq"], "left").select("tenant", "seq", F.concat(head, task_suffix("state", "holder", "lease_until", "deadline")).alias("line"))


def presence_lines(slots: DataFrame, now_ns: int) -> DataFrame:
    """(tenant, agent, line, age_s): '~ agent [area]: status (age)', by agent."""
    age = F.greatest(F.floor((F.lit(now_ns) - F.col("ts_ns")) / 1_000_000_000), F.lit(0))
    area = F.when(F.coalesce("area", F.lit("")) != "", F.concat(F.lit(" ["), F.col("area"), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("~ "), F.col("agent"), area, F.lit(": "), F.col("status"), F.lit(" ("), compact_age(age), F.lit(")"))
    return slots.select("tenant", "agent", line.alias("line"), age.cast("long").alias("age_s")).orderBy("tenant", "agent")


def board(messages: DataFrame) -> DataFrame:
    """(tenant, place, area, agents, n_messages): areas in order of first message, each with its agents in order of first message."""
    rows = messages.withColumn("area", html_unescape(F.coalesce("area", F.lit("")))).withColumn("agent", F.trim(F.coalesce("sender", F.lit(""))))
    agents = rows.filter("agent <> ''").groupBy("tenant", "area", "agent").agg(F.min("seq").alias("first")).groupBy("tenant", "area").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("first", "agent"))), lambda x: x["agent"]).alias("agents")
    )
    areas = rows.groupBy("tenant", "area").agg(F.min("seq").alias("first"), F.count("*").alias("n_messages"))
    place = F.row_number().over(Window.partitionBy("tenant").orderBy("first"))
    joined = areas.withColumn("place", place).join(agents, ["tenant", "area"], "left")
    return joined.select("tenant", "place", "area", F.coalesce("agents", F.array().cast("array<string>")).alias("agents"), "n_messages")
