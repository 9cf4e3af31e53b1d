"""Filling containers of fixed capacity with documents measured in tokens.

Sum-of-squares online packing: each document goes to the fill level that minimises the sum
of squared counts of partially filled containers, kept in one array per fill level. Every
task packs what it reads, without a shuffle; containers left partly filled are then packed
with each other as items of their own. Only texts longer than a container are split, into
full containers and one remainder.

Null ids, null and empty texts have no tokens and are left out; an id that occurs again is
packed again. Other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.llm.arrow import batches
from engrava.session import materialize

#: Open containers repacked together by one task.
REPACK = 100_000


def default_vocabulary() -> tuple[str, str]:
    """Path of the byte-level vocabulary installed with the public tokenizers, and its splitting pattern."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


@lru_cache(maxsize=2)
def tokenizer(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("engrava", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


class SquarePacker:
    """Containers by fill level; ``place`` returns the container an item goes to."""

    def __init__(self, capacity: int):
        if capacity < 1:
            raise ValueError("capacity must be positive")
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.bins: dict[int, list[int]] = {}  # the open containers by level; full ones are forgotten
        self.opened = 0

    def place(self, size: int) -> int:
        if not 0 < size <= self.capacity:
            raise ValueError("an item must fit into a container")
        room = self.capacity - size
        level = 0
        if room:
            # Moving a container from level h to h + size changes the sum by 2 (N[h + size] - N[h] + 1);
            # filling it up removes it: 1 - 2 N[h]; a new container adds 2 N[size] + 1.
            here, there = self.count[1 : room + 1], self.count[size + 1 : self.capacity + 1]
            change = 2 * (there - here + 1)
            change[-1] = 1 - 2 * here[-1]
            change = np.where(here > 0, change, np.iinfo(np.int64).max)
            best = room - 1 - int(np.argmin(change[::-1]))  # of equal changes the fullest level
            if change[best] <= 2 * self.count[size] + 1:
                level = best + 1
        if level:
            self.count[level] -= 1
            at = self.bins[level].pop()
        else:
            at = self.opened
            self.opened += 1
        if level + size < self.capacity:
            self.count[level + size] += 1
            self.bins.setdefault(level + size, []).append(at)
        return at


def _pack(capacity: int, vocabulary: tuple[str, str]):
    schema = pa.schema([("container", pa.int64()), ("doc_id", pa.int64()), ("first_token", pa.int32()), ("n_tokens", pa.int32())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(*vocabulary).encode_ordinary
        packer, base = SquarePacker(capacity), TaskContext.get().partitionId() << 40
        for batch in stream:
            ids = batch.column(0).to_pylist()
            sizes = [len(encode(t)) for t in batch.column(1).to_pylist()]
            pieces = [(min(capacity, n - at), i, at) for i, n in zip(ids, sizes, strict=True) for at in range(0, n, capacity)]
            pieces.sort(reverse=True)
            where = [base + packer.place(n) for n, _, _ in pieces]
            yield from batches(schema, where, [i for _, i, _ in pieces], [at for _, _, at in pieces], [n for n, _, _ in pieces])

    return run


def _repack(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer, first = SquarePacker(capacity), {}
        for frame in frames:
            frame = frame.sort_values(["fill", "container"], ascending=False)
            place = [packer.place(int(n)) for n in frame["fill"]]
            target = [first.setdefault(at, c) for at, c in zip(place, frame["container"], strict=True)]
            yield pd.DataFrame({"container": frame["container"], "target": target})

    return run


def pack(docs: DataFrame, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", vocabulary: tuple[str, str] | None = None) -> DataFrame:
    """(container, doc_id, first_token, n_tokens): which tokens of which document lie in which container."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).filter(
        F.col("doc_id").isNotNull() & (F.length("text") > 0)
    )
    kinds = "container long, doc_id long, first_token int, n_tokens int"
    placed = materialize(rows.mapInArrow(_pack(capacity, vocabulary or default_vocabulary()), kinds), "placed")
    fills = placed.groupBy("container").agg(F.sum("n_tokens").alias("fill")).filter(F.col("fill") < capacity)
    fills = materialize(fills, "open")
    groups = max(1, -(-fills.count() // REPACK))
    moved = fills.repartition(groups, F.xxhash64("container")).sortWithinPartitions(F.desc("fill"), "container").mapInPandas(_repack(capacity), "container long, target long")
    return placed.join(moved, "container", "left").select(F.coalesce("target", "container").alias("container"), "doc_id", "first_token", "n_tokens")


def containers(docs: DataFrame, capacity: int = 2048, **columns) -> DataFrame:
    """(container, documents, n_pieces, fill): one row per container; ``documents`` are ids in ascending order."""
    return (
        pack(docs, capacity, **columns)
        .groupBy("container")
        .agg(F.array_sort(F.collect_set("doc_id")).alias("documents"), F.count("*").cast("int").alias("n_pieces"), F.sum("n_tokens").cast("int").alias("fill"))
    )
