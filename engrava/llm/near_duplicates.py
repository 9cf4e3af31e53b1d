"""Near-duplicate texts: Jaccard similarity of word shingles, exactly, without all pairs.

A similarity of at least t bounds the Hamming distance of the two shingle sets by
(1 - t) / (1 + t) of the sum of their sizes. Candidates share one of their rarest
shingles (rarity by a count table over all texts, of fixed size; any order common to all
texts is exact, a good one is fast; shingles the table shows to be unique join nothing and
are not sent), at a place early enough in both for the wanted overlap. A shingle that many
texts share is joined in blocks of bounded size, by the same table. Pairs are pruned
where they meet, by pigeonring: the shingles are dealt to a ring of four segments, each
folded to 64 parity bits, so that the bits by which two segments differ never exceed their
true difference; somewhere on the ring a chain of consecutive segments must stay within
its proportional share of the distance budget at each of its steps, or the pair cannot be
near. Survivors are checked by full Hamming distance of their shingle sets.

Texts with equal shingle sets form one class, named by its least id, and are compared once. Texts of fewer words
than a shingle, null and empty texts have no shingles and are near to nothing. Null ids
are left out. An id that occurs again counts once, with its least class. Other columns
are ignored. Classes are told apart by 128-bit keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.llm import textkernel as k
from engrava.llm.arrow import batches, signed, texts_of
from engrava.session import materialize, wide_enough

#: Entries of the shingle count table (binary logarithm), one byte each, whatever the number of texts.
TABLE_BITS = 24
BLOCKS = 256
#: Texts of a shingle, or copies of a class, that are compared in one block.
HOT = 4096
SEGMENTS = 4
#: What the prefixes take in a shuffle, for each shingle of all sets.
PREFIX_BYTES = 40


def _spread(x: np.ndarray, starts: np.ndarray, op) -> np.ndarray:
    return op.reduceat(x, starts) if len(starts) else x[:0]


def _sets_of(texts: list[str], words: int):
    """Sorted shingles of all texts, and of each text with any: its row, their number and its key in two halves."""
    found = k.Words(texts)
    grams, at = found.grams(words)
    doc = found.text[at]
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    fresh = np.ones(len(grams), bool)
    fresh[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[fresh], doc[fresh]
    some, first, counts = np.unique(doc, return_index=True, return_counts=True)
    key = k.mix(_spread(k.mix(grams), first, np.add) ^ (_spread(grams, first, np.bitwise_xor) * np.uint64(3)))
    other = k.mix(_spread(k.mix(grams ^ np.uint64(0x5851F42D4C957F2D)), first, np.add))
    return grams, some, counts, key, other


def _keys(words: int):
    """(id, key of the shingle set, their number, hash of the text) of each text with shingles."""
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("other", pa.int64()), ("n", pa.int32()), ("held", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for lo, hi in k.chunks(texts):
                _, some, counts, key, other = _sets_of(texts[lo:hi], words)
                yield from batches(schema, ids[lo:hi][some], signed(key), signed(other), counts.astype(np.int32), batch.column(2).take(pa.array(lo + some)))

    return run


def _shingle_sets(words: int):
    """(id, size, sorted shingles, ring of parity bits) of each text."""
    rings = [(f"r{i}", pa.int64()) for i in range(SEGMENTS)]
    schema = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("shingles", pa.binary()), *rings])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for lo, hi in k.chunks(texts):
                grams, some, counts, _, _ = _sets_of(texts[lo:hi], words)
                ring = np.zeros((len(some), SEGMENTS), np.uint64)
                bit = np.uint64(1) << ((grams >> np.uint64(20)) & np.uint64(63))
                segment = ((grams >> np.uint64(30)) & np.uint64(SEGMENTS - 1)).astype(np.int64)
                np.bitwise_xor.at(ring, (np.repeat(np.arange(len(some)), counts), segment), bit)
                raw, last = grams.tobytes(), np.cumsum(counts)
                yield from batches(
                    schema,
                    ids[lo:hi][some],
                    counts.astype(np.int32),
                    pa.array([raw[8 * (b - c) : 8 * b] for b, c in zip(last.tolist(), counts.tolist(), strict=True)], pa.binary()),
                    *(signed(ring[:, i].copy()) for i in range(SEGMENTS)),
                )

    return run


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of a batch and the row of each."""
    parts = column.to_pylist()
    sizes = np.array([len(p) // 8 for p in parts], np.int64)
    return np.frombuffer(b"".join(parts), np.uint64), np.repeat(np.arange(len(parts)), sizes)


def _gathered(stream: Iterator[pa.RecordBatch], most: int = 2_000_000) -> Iterator[np.ndarray]:
    """The shingles of a stream, in parts of bounded size."""
    parts, size = [], 0
    for batch in stream:
        parts.append(_flat(batch.column(0))[0])
        size += len(parts[-1])
        if size >= most:
            yield np.concatenate(parts)
            parts, size = [], 0
    if size:
        yield np.concatenate(parts)


def _counts(bits: int):
    """Counts by table entry, summed over parts of a task, entries ascending within a block."""
    schema = pa.schema([("block", pa.int32()), ("entries", pa.binary()), ("counts", pa.binary())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = (1 << bits) // BLOCKS
        for shingles in _gathered(stream):
            entry, count = np.unique(shingles >> np.uint64(64 - bits), return_counts=True)
            cut = np.searchsorted(entry, np.arange(BLOCKS + 1, dtype=np.uint64) * np.uint64(size))
            here = np.flatnonzero(np.diff(cut))
            place = (entry % np.uint64(size)).astype(np.int64)
            step = np.diff(place, prepend=0)  # small numbers, which compress well
            step[cut[here]] = place[cut[here]]
            yield from batches(
                schema,
                here.astype(np.int32),
                pa.array([step[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in here], pa.binary()),
                pa.array([count[cut[i] : cut[i + 1]].astype(np.uint32).tobytes() for i in here], pa.binary()),
            )

    return run


def _ranks(bits: int):
    """Whole blocks of the table: 0 for none, 1 for exactly one, then a logarithm of the count."""

    def run(stream):
        import pandas as pd

        size, total = (1 << bits) // BLOCKS, {}
        for frame in stream:
            for block, entries, counts in zip(frame["block"], frame["entries"], frame["counts"], strict=True):
                table = total.setdefault(block, np.zeros(size, np.int64))
                table[np.cumsum(np.frombuffer(entries, np.uint32), dtype=np.int64)] += np.frombuffer(counts, np.uint32)
        ranks = [np.where(t < 2, t, 2 + (np.log2(np.maximum(t, 1)) * 6)).astype(np.uint8).tobytes() for t in total.values()]
        yield pd.DataFrame({"block": list(total), "ranks": ranks})

    return run


def _prefixes(similarity: float, ranks, bits: int):
    """The rarest shingles of each set, enough that two sets of the wanted similarity share one, without unique ones.

    ``side`` tells on which side of the join a row stands (1, 2, or 3 for both). Texts of a
    hot shingle fall into blocks; a row is sent once for each block its own block meets,
    under a key of its own, so no key has more than two blocks of rows.
    """
    rings = [(f"r{i}", pa.int64()) for i in range(SEGMENTS)]
    schema = pa.schema([("shingle", pa.int64()), ("side", pa.int8()), ("id", pa.int64()), ("n", pa.int32()), ("left", pa.int32()), *rings])
    most = np.array([2.0 ** ((r - 1) / 6) for r in range(256)])  # texts that a rank stands for at most
    blocks_of = np.maximum(np.ceil(most / HOT), 1).astype(np.int64)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(ranks.value, np.uint8)
        for batch in stream:
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            shingles, row = _flat(batch.column(2))
            rank = table[shingles >> np.uint64(64 - bits)]
            order = np.lexsort((shingles, rank, row))
            shingles, row, rank = shingles[order], row[order], rank[order]
            first = np.cumsum(n) - n
            take = n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1
            place = np.arange(len(row)) - first[row]
            keep = (place < take[row]) & (rank > 1)
            row, place, key, blocks = row[keep], place[keep], shingles[keep], blocks_of[rank[keep]]
            side = np.full(len(row), 3, np.int8)
            if (hot := np.flatnonzero(blocks > 1)).size:
                own = (k.mix(signed(ids[row[hot]])) % blocks[hot].astype(np.uint64)).astype(np.int64)
                met = np.arange(blocks[hot].sum()) - np.repeat(np.cumsum(blocks[hot]) - blocks[hot], blocks[hot])
                at, own = np.repeat(hot, blocks[hot]), np.repeat(own, blocks[hot])
                cell = k.mix(key[at] + k.mix((np.minimum(own, met) << 32) + np.maximum(own, met) + 1))
                sides = np.where(own < met, 1, np.where(own > met, 2, 3)).astype(np.int8)
                plain = np.flatnonzero(blocks == 1)
                row, place = np.concatenate([row[plain], row[at]]), np.concatenate([place[plain], place[at]])
                key, side = np.concatenate([key[plain], cell]), np.concatenate([side[plain], sides])
            rings = [batch.column(3 + i).to_numpy()[row] for i in range(SEGMENTS)]
            yield from batches(schema, signed(key), side, ids[row], n[row], (n[row] - place).astype(np.int32), *rings)

    return run


def pigeonring(apart: list, budget):
    """Whether the segments' differences allow a distance of at most ``budget``, as a condition on columns.

    If all differences sum to at most the budget, some start on the ring keeps every prefix
    of its chain within a proportional share of it; so the condition loses no near pair.
    """
    m, starts = len(apart), None
    for start in range(m):
        chain, fine = None, None
        for step in range(m):
            part = apart[(start + step) % m]
            chain = part if chain is None else chain + part
            within = chain <= budget * ((step + 1) / m) + 1e-9
            fine = within if fine is None else fine & within
        starts = fine if starts is None else starts | fine
    return starts


def _checked(similarity: float):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("similarity", pa.float64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            (left, i), (right, j) = _flat(batch.column(2)), _flat(batch.column(3))
            both, row = np.concatenate([left, right]), np.concatenate([i, j])
            order = np.lexsort((both, row))
            both, row = both[order], row[order]
            twice = np.flatnonzero((both[1:] == both[:-1]) & (row[1:] == row[:-1]))
            common = np.bincount(row[twice], minlength=len(a))
            total = np.bincount(row, minlength=len(a))
            distance = total - 2 * common  # Hamming distance of the two sets
            union = (total + distance) / 2
            near = common >= similarity * union - 1e-9
            yield from batches(schema, a[near], b[near], (common / np.maximum(union, 1))[near])

    return run


def near_duplicate_classes(
    records: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "id", text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Classes of equal shingle sets, and the near pairs between classes.

    Returns ``members`` (id, class_id, copies) and ``links`` (a, b, similarity) with a < b over class ids.
    """
    if not 0 < similarity <= 1 or words < 1:
        raise ValueError("need 0 < similarity <= 1 and words >= 1")
    spark = records.sparkSession
    texts = records.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter(
        F.col("id").isNotNull() & (F.length("text") > 0)
    )
    hashed = texts.withColumn("held", F.xxhash64("text"))
    keys = materialize(hashed.mapInArrow(_keys(words), "id long, key long, other long, n int, held long"), "keys")
    least = keys.groupBy("id").agg(F.min(F.struct("key", "other", "n", "held")).alias("k")).select("id", "k.*")
    first = least.groupBy("key", "other").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    members = materialize(least.join(first, ["key", "other"]).select("id", "class_id", "copies", "held"), "members")
    # A repeated id may have other texts; the one with its key stands for it.
    chosen = hashed.join(members.filter("id = class_id").select("id", "held"), ["id", "held"], "left_semi").groupBy("id").agg(F.min("text").alias("text"))
    classes = materialize(chosen.mapInArrow(_shingle_sets(words), "id long, n int, shingles binary" + "".join(f", r{i} long" for i in range(SEGMENTS))), "classes")
    total = classes.agg(F.sum("n")).collect()[0][0] or 0
    bits = TABLE_BITS
    blocks = (
        classes.select("shingles")
        .mapInArrow(_counts(bits), "block int, entries binary, counts binary")
        .repartition(BLOCKS, "block")
        .mapInPandas(_ranks(bits), "block int, ranks binary")
    )
    table, size = bytearray(1 << bits), (1 << bits) // BLOCKS
    for row in blocks.collect():  # a table of fixed size, however many texts there are
        table[row["block"] * size : (row["block"] + 1) * size] = row["ranks"]
    ranks = spark.sparkContext.broadcast(bytes(table))
    rings = [f"r{i}" for i in range(SEGMENTS)]
    kinds = "shingle long, side byte, id long, n int, left int" + "".join(f", {r} long" for r in rings)
    prefixes = classes.select("id", "n", "shingles", *rings).mapInArrow(_prefixes(similarity, ranks, bits), kinds)
    prefixes = wide_enough(prefixes, total * PREFIX_BYTES, "shingle")
    a, b = prefixes.alias("x"), prefixes.alias("y")
    total, least = F.col("x.n") + F.col("y.n"), F.least("x.n", "y.n")
    fits = (
        # One condition over both sides: apart they would be pushed down, and the shuffle be made twice.
        (F.col("x.side").bitwiseAND(1) * F.col("y.side").bitwiseAND(2) > 0)
        & ((F.col("x.id") < F.col("y.id")) | (F.col("x.side") < 3))
        & (least >= F.greatest("x.n", "y.n") * F.lit(similarity - 1e-9))
        # From their first common shingle on, the sets must hold enough for the wanted overlap.
        & (F.least("x.left", "y.left") >= total * F.lit(similarity / (1 + similarity)) - 1e-9)
        & pigeonring([F.bit_count(F.col(f"x.{r}").bitwiseXOR(F.col(f"y.{r}"))) for r in rings], total * F.lit((1 - similarity) / (1 + similarity)))
    )
    pruned = a.join(b, (F.col("x.shingle") == F.col("y.shingle")) & fits).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    pruned = materialize(pruned, "pruned")
    needed = pruned.select("a").union(pruned.select("b")).toDF("id").distinct()
    content = classes.select("id", "shingles").join(needed, "id", "left_semi")
    links = (
        pruned.join(content.toDF("a", "sa"), "a")
        .join(content.toDF("b", "sb"), "b")
        .select("a", "b", "sa", "sb")
        .mapInArrow(_checked(similarity), "a long, b long, similarity double")
    )
    return members.select("id", "class_id", "copies"), links


def near_duplicate_pairs(records: DataFrame, similarity: float, words: int, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id_a, id_b), smaller first, of all records whose texts are near, copies included."""
    members, links = near_duplicate_classes(records, similarity, words, id_col, text_col)
    links = materialize(links, "links")
    # A class of many copies falls into blocks of HOT; pairs are made block by block.
    blocks = F.ceil(F.col("copies") / HOT).cast("int")
    own = members.select("id", "class_id", "copies", blocks.alias("n"), F.pmod(F.xxhash64("id"), blocks).cast("int").alias("block"))
    sizes = members.filter("id = class_id").select("class_id", blocks.alias("n"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    ends = links.select("a", "b").join(sizes.toDF("a", "na"), "a").join(sizes.toDF("b", "nb"), "b")
    ends = ends.withColumn("i", every("na")).withColumn("j", every("nb")).select("a", "b", "i", "j")
    side = own.select("class_id", "block", "id")
    across = ends.join(side.toDF("a", "i", "x"), ["a", "i"]).join(side.toDF("b", "j", "y"), ["b", "j"])
    across = across.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))
    several = own.filter("copies > 1").withColumn("met", every("n"))
    cell = [F.least("block", "met").alias("i"), F.greatest("block", "met").alias("j")]
    left = several.filter("block <= met").select("class_id", *cell, F.col("id").alias("x"))
    right = several.filter("block >= met").select("class_id", *cell, F.col("id").alias("y"))
    copies = left.join(right, ["class_id", "i", "j"]).filter((F.col("x") < F.col("y")) | (F.col("i") < F.col("j")))
    return across.unionByName(copies.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")))


def near_duplicate_groups(records: DataFrame, similarity: float = 0.8, words: int = 5, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(id, class_id, n_copies, n_links, group_id): one row per record with shingles.

    ``class_id`` is the least id with an equal shingle set, ``n_links`` the number of other
    classes near to it, ``group_id`` the least class id of its connected group.
    """
    from engrava.operators.components import connected_components

    members, links = near_duplicate_classes(records, similarity, words, id_col, text_col)
    links = materialize(links.select(F.col("a").alias("src"), F.col("b").alias("dst")), "class-links")
    degree = links.select("src").union(links.select("dst")).toDF("class_id").groupBy("class_id").agg(F.count("*").alias("n_links"))
    groups = connected_components(links).select(F.col("node").alias("class_id"), F.col("component").alias("group_id"))
    return (
        members.withColumnRenamed("copies", "n_copies")
        .join(degree, "class_id", "left")
        .join(groups, "class_id", "left")
        .select("id", "class_id", "n_copies", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("group_id", "class_id").alias("group_id"))
    )
