"""Replaying access streams through cache policies.

What an LRU cache holds are the items last accessed, so a stream can be cut anywhere: each
chunk of bounded size starts from the most recent items before it, which are put together
from short summaries of the chunks, and a tenant with much of the log spreads over many
tasks. The state of the other policies depends on every access before; there rows stream
through a task sorted by (tenant, seq), and only one tenant's caches are held.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.session import materialize

#: Range of sequence numbers in one chunk; a sequence number is unique, so this bounds its rows.
CHUNK = 100_000


class Lru:
    """Least recently used goes first."""

    def __init__(self, capacity: int):
        self.capacity, self.items, self.prefetches, self.loads = capacity, OrderedDict(), 0, 0

    def admit(self, item) -> None:
        self.items[item] = True
        self.items.move_to_end(item)
        if len(self.items) > self.capacity:
            self.items.popitem(last=False)

    def access(self, item) -> bool:
        hit = item in self.items
        self.admit(item)
        return hit

    def members(self) -> list:
        return sorted(self.items)


class Lfu:
    """Least frequently used goes first, ties to the lower id; an evicted item's count is forgotten."""

    def __init__(self, capacity: int):
        self.capacity, self.count, self.prefetches, self.loads = capacity, {}, 0, 0

    def access(self, item) -> bool:
        if item in self.count:
            self.count[item] += 1
            return True
        if len(self.count) >= self.capacity:
            del self.count[min(self.count, key=lambda i: (self.count[i], i))]
        self.count[item] = 1
        return False

    def members(self) -> list:
        return sorted(self.count)


class MarkovPrefetch(Lru):
    """LRU that after each access also loads the likeliest next item; hits count before the prefetch."""

    def __init__(self, capacity: int):
        super().__init__(capacity)
        self.follow, self.best, self.prev = {}, {}, None

    def access(self, item) -> bool:
        hit = super().access(item)
        if self.prev is not None:
            counts = self.follow.setdefault(self.prev, {})
            counts[item] = counts.get(item, 0) + 1
            top = self.best.get(self.prev)
            if top is None or (counts[item], -item) > (counts[top], -top):
                self.best[self.prev] = item
        self.prev = item
        guess = self.best.get(item)
        if guess is not None:
            self.prefetches += 1
            self.loads += guess not in self.items
            self.admit(guess)
        return hit


POLICIES = {"lru": Lru, "lfu": Lfu, "markov": MarkovPrefetch}


def _replay(policies: tuple[str, ...], capacities: tuple[int, ...]):
    columns = ["tenant", "policy", "capacity", "accesses", "hits", "prefetches", "loads", "fetches"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, caches, counts, n = None, {}, {}, 0

        def done():
            rows = [(tenant, p, c, n, counts[p, c], k.prefetches, k.loads, n - counts[p, c] + k.loads) for (p, c), k in caches.items()]
            return pd.DataFrame(rows, columns=columns)

        for frame in frames:
            for t, item in zip(frame["tenant"].tolist(), frame["item"].tolist(), strict=True):
                if t != tenant:
                    if n:
                        yield done()
                    tenant, n = t, 0
                    caches = {(p, c): POLICIES[p](c) for p in policies for c in capacities}
                    counts = dict.fromkeys(caches, 0)
                n += 1
                for key, cache in caches.items():
                    counts[key] += cache.access(item)
        if n:
            yield done()

    return run


def _starts(most: int):
    """Per tenant: what an LRU of ``most`` items holds at the start of each chunk, oldest first."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        recent: OrderedDict = OrderedDict()
        out = []
        for chunk, part in frame.sort_values(["chunk", "last"]).groupby("chunk", sort=True):
            out.append((frame["tenant"].iloc[0], chunk, list(recent)))
            for item in part["item"].tolist():
                recent[item] = True
                recent.move_to_end(item)
            while len(recent) > most:
                recent.popitem(last=False)
        return pd.DataFrame(out, columns=["tenant", "chunk", "recent"])

    return run


def _lru_chunks(capacities: tuple[int, ...]):
    """Accesses and hits of chunks whose rows come in order; a chunk's first row (seq -1) holds the items it starts from."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, caches, hits, n = None, [], [0] * len(capacities), 0
        out: list = []
        for frame in frames:
            starts = (frame["seq"] < 0).to_numpy().nonzero()[0].tolist()
            items, at = frame["item"].tolist(), 0
            for start in [*starts, len(items)]:
                for i, cache in enumerate(caches):
                    access = cache.access
                    hits[i] += sum(map(access, items[at:start]))
                n += start - at
                if start == len(items):
                    break
                out += [(key, c, n, h) for c, h in zip(capacities, hits, strict=True)] if n else []
                key, n, hits, caches, at = frame["tenant"].iloc[start], 0, [0] * len(capacities), [Lru(c) for c in capacities], start + 1
                for held in frame["recent"].iloc[start]:
                    for cache in caches:
                        cache.admit(held)
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=["tenant", "capacity", "accesses", "hits"])
                out = []
        out += [(key, c, n, h) for c, h in zip(capacities, hits, strict=True)] if n else []
        if out:
            yield pd.DataFrame(out, columns=["tenant", "capacity", "accesses", "hits"])

    return run


def replay_lru(log: DataFrame, capacities: tuple[int, ...]) -> DataFrame:
    """``replay`` of the LRU policy, chunk by chunk."""
    most = max(capacities)
    rows = log.filter("item_id is not null").select("tenant", "seq", F.col("item_id").alias("item")).dropDuplicates(["seq"])
    rows = materialize(rows.withColumn("chunk", F.floor(F.col("seq") / CHUNK)), "accesses")
    lasts = rows.groupBy("tenant", "chunk", "item").agg(F.max("seq").alias("last"))
    newest = Window.partitionBy("tenant", "chunk").orderBy(F.desc("last"))
    short = lasts.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= most).drop("_r")
    starts = short.groupBy("tenant").applyInPandas(_starts(most), "tenant int, chunk long, recent array<long>")
    # A chunk's start goes as a row of its own before the chunk's rows.
    led = starts.select("tenant", "chunk", F.lit(-1).cast("long").alias("seq"), F.lit(0).cast("long").alias("item"), "recent")
    every = rows.select("tenant", "chunk", "seq", F.col("item").cast("long").alias("item"), F.lit(None).cast("array<long>").alias("recent")).unionByName(led)
    ordered = every.repartition("tenant", "chunk").sortWithinPartitions("tenant", "chunk", "seq").select("tenant", "seq", "item", "recent")
    counted = ordered.mapInPandas(_lru_chunks(tuple(capacities)), "tenant int, capacity int, accesses long, hits long")
    sums = counted.groupBy("tenant", "capacity").agg(F.sum("accesses").alias("accesses"), F.sum("hits").alias("hits"))
    none = F.lit(0).cast("long")
    return sums.select("tenant", F.lit("lru").alias("policy"), "capacity", "accesses", "hits", none.alias("prefetches"), none.alias("loads"), (F.col("accesses") - F.col("hits")).alias("fetches"))


def replay(log: DataFrame, capacities: tuple[int, ...], policies: tuple[str, ...] = ("lru", "lfu", "markov")) -> DataFrame:
    """(tenant, policy, capacity, accesses, hits, prefetches, loads, fetches) of each tenant's stream.

    ``fetches`` are the items brought in: misses and prefetches of absent items. Null items
    are left out, redelivered records count once.
    """
    if not capacities or min(capacities) < 1 or not set(policies) <= set(POLICIES):
        raise ValueError("need capacities of 1 or more and known policies")
    if "lru" in policies:
        lru, rest = replay_lru(log, capacities), tuple(p for p in policies if p != "lru")
        return lru.unionByName(replay(log, capacities, rest)) if rest else lru
    rows = log.filter("item_id is not null").select("tenant", "seq", F.col("item_id").alias("item")).dropDuplicates(["seq"])
    ordered = rows.repartition("tenant").sortWithinPartitions("tenant", "seq")
    return ordered.mapInPandas(
        _replay(tuple(policies), tuple(capacities)), "tenant int, policy string, capacity int, accesses long, hits long, prefetches long, loads long, fetches long"
    )


def tier(log: DataFrame, vectors: DataFrame, capacity: int) -> DataFrame:
    """(tenant, item, vec): the exact vectors an LRU tier of each tenant holds after the log; items without a vector are left out.

    ``vectors`` has (item, vec).
    """
    last = log.filter("item_id is not null").groupBy("tenant", F.col("item_id").alias("item")).agg(F.max("seq").alias("last"))
    newest = Window.partitionBy("tenant").orderBy(F.desc("last"))
    held = last.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= capacity)
    return held.select("tenant", "item").join(vectors.select("item", "vec"), "item").select("tenant", "item", "vec")


def tier_recall(accesses: DataFrame, capacity: int) -> DataFrame:
    """(tenant, accesses, resident, hits, hits_resident, hits_missing): recall on a stream with an LRU tier in front of coded search.

    ``accesses`` has (tenant, seq, item, coded): ``coded`` says whether coded search alone
    returns the item. An item is resident if it was among the tenant's last ``capacity``
    different ones before the access; a resident item is scored exactly and is always returned.
    """
    return _resident(accesses.select("tenant", "seq", F.col("item").alias("item_id"), "coded"), capacity)


def _resident(rows: DataFrame, capacity: int) -> DataFrame:
    marked = rows.select("tenant", "seq", "item_id", "coded").repartition("tenant").sortWithinPartitions("tenant", "seq")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tenant, cache = None, None
        for frame in frames:
            inside = []
            for t, item in zip(frame["tenant"].tolist(), frame["item_id"].tolist(), strict=True):
                if t != tenant:
                    tenant, cache = t, Lru(capacity)
                inside.append(cache.access(item))
            yield pd.DataFrame({"tenant": frame["tenant"], "coded": frame["coded"], "resident": inside})

    held = marked.mapInPandas(run, "tenant int, coded boolean, resident boolean")
    hit = F.col("coded") | F.col("resident")
    return held.groupBy("tenant").agg(
        F.count("*").alias("accesses"), F.count_if("resident").alias("resident"), F.count_if(hit).alias("hits"),
        F.count_if(F.col("resident") & hit).alias("hits_resident"), F.count_if(~F.col("resident") & hit).alias("hits_missing"),
    )


def costs(replayed: DataFrame, hit_cost: float, miss_cost: float) -> DataFrame:
    """Per policy and capacity: hit rate, mean latency, fetched items an access, latency saved against LRU."""
    sums = replayed.groupBy("policy", "capacity").agg(F.sum("accesses").alias("accesses"), F.sum("hits").alias("hits"), F.sum("loads").alias("loads"))
    rate = F.col("hits") / F.col("accesses")
    priced = sums.select(
        "policy", "capacity", rate.alias("hit_rate"), (rate * hit_cost + (1 - rate) * miss_cost).alias("latency"),
        ((F.col("accesses") - F.col("hits") + F.col("loads")) / F.col("accesses")).alias("bandwidth"),
    )
    plain = priced.filter("policy = 'lru'").select("capacity", F.col("latency").alias("_lru"))
    return priced.join(plain, "capacity", "left").withColumn("saved", 1 - F.col("latency") / F.col("_lru")).drop("_lru")
