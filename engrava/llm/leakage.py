"""Evaluation items whose text stands, fully or partly, in training documents.

Rare n-gram seeds: the document frequency of every item n-gram is counted over the whole
corpus, each passage of an item is represented by its rarest n-gram that occurs, and those
seeds join documents to items. Each candidate pair is then aligned word by word
(Smith-Waterman), which scores edited copies and yields the longest run of equal words.

A pair with a run of ``passage`` equal words always shares a seed: all n-grams of that
passage occur in the document, also the rarest. Edited copies are found by counting: an
alignment with m equal words and e edits scores at least ``share`` of an item of n words
only if m - e >= share * n, and its equal words stand in at most e + 1 runs, so at least
ceil(share * n) - 1 of the item's word pairs stand in the document, whatever else is in the
corpus. Where that bound is 0, single words count. Up to ``block_grams`` n-grams of items are
broadcast. More are joined by a shuffle: the corpus is read a fixed number of times
however many items there are, its n-grams are thinned by a bitmap of fixed size first, and only an item's rarest word
pairs look for candidates, enough of them that a copy must hold one (prefix filter); the
candidates' pairs are then counted next to the texts.

Null ids are left out, null or empty texts match nothing, repeated ids count once per
pair, other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.llm import textkernel as k
from engrava.llm.arrow import batches, lists, signed, texts_of
from engrava.session import materialize

MATCH, MISMATCH, GAP = 2, -2, -2
_PAIRS = 64
#: Buckets of the bitmap that thins the corpus's n-grams (binary logarithm).
BITMAP_BITS = 24
#: (document, item) counters and postings a task holds at once.
_CELLS = 1 << 22


def _gram_rows(n: int):
    schema = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("gram", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for lo, hi in k.chunks(texts):
                words = k.Words(texts[lo:hi])
                grams, at = words.grams(n)
                doc = words.text[at]
                yield from batches(schema, ids[lo:hi][doc], (at - words.first[doc]).astype(np.int32), signed(grams))

    return run


def _holders(n: int, wanted):
    """Documents that hold any of the sorted ``wanted`` n-grams, with where and which."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("at", pa.list_(pa.int32())), ("gram", pa.list_(pa.int64()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = wanted.value.view(np.uint64)
        near = np.zeros(1 << 20, bool)
        near[known >> np.uint64(44)] = True
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for lo, hi in k.chunks(texts):
                words = k.Words(texts[lo:hi])
                grams, at = words.grams(n)
                hit = np.flatnonzero(near[grams >> np.uint64(44)])
                hit = hit[known[np.minimum(np.searchsorted(known, grams[hit]), len(known) - 1)] == grams[hit]]
                if not len(hit):
                    continue
                doc = words.text[at[hit]]
                some, counts = np.unique(doc, return_counts=True)
                yield from batches(
                    schema,
                    ids[lo:hi][some],
                    pa.array([texts[lo + i] for i in some], pa.string()),
                    lists(counts, (at[hit] - words.first[doc]).astype(np.int32), pa.int32()),
                    lists(counts, signed(grams[hit]), pa.int64()),
                )

    return run


def _needed(share: float, n: np.ndarray) -> np.ndarray:
    """Equal words less edits that a score of ``share`` takes in an item of n words."""
    return np.maximum(np.ceil(share * n - 1e-9), 1).astype(np.int64)


def _item_keys(share: float):
    """Per item its different word pairs (single words where one word is enough), how often each stands in it, and how many a copy needs."""
    schema = pa.schema([("item_id", pa.int64()), ("gram", pa.int64()), ("times", pa.int32()), ("need", pa.int32()), ("single", pa.bool_())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for lo, hi in k.chunks(texts):
                words = k.Words(texts[lo:hi])
                need = _needed(share, np.diff(words.first))
                for size in (1, 2):
                    grams, at = words.grams(size)
                    item = words.text[at]
                    mine = (need[item] == 1) == (size == 1)
                    rows = pa.table({"item": item[mine], "gram": signed(grams[mine])}).group_by(["item", "gram"]).aggregate([([], "count_all")])
                    item, gram, times = (rows[c].to_numpy() for c in ("item", "gram", "count_all"))
                    least = need[item] - (size == 2)
                    yield from batches(schema, ids[lo:hi][item], gram, times.astype(np.int32), least.astype(np.int32), np.full(len(item), size == 1))

    return run


def _model(keys) -> dict[str, np.ndarray]:
    """The keys of a block of items, by gram and by item."""
    ids, item = np.unique(keys["item_id"].to_numpy(np.int64), return_inverse=True)
    known, gram = np.unique(keys["gram"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
    need = np.zeros(len(ids), np.int64)
    need[item] = keys["need"]
    by_gram, by_item = np.argsort(gram, kind="stable"), np.argsort(item, kind="stable")
    return {
        "ids": ids, "known": known, "need": need, "single": np.array(keys["single"].any()),
        "start": np.searchsorted(gram[by_gram], np.arange(len(known) + 1)), "item": item[by_gram], "times": keys["times"].to_numpy()[by_gram],
        "of": np.searchsorted(item[by_item], np.arange(len(ids) + 1)), "gram": gram[by_item],
    }


def _copies(model):
    """Documents that hold enough of an item's word pairs, with those items and where the pairs stand."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("item_id", pa.list_(pa.int64())), ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32()))])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known, start, n_items = m["known"], m["start"], len(m["ids"])
        near = np.zeros(1 << 20, bool)
        near[known >> np.uint64(44)] = True
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for lo, hi in k.chunks(texts):
                words = k.Words(texts[lo:hi])
                docs, places, keys = [], [], []
                for size in (1, 2) if m["single"] else (2,):
                    grams, at = words.grams(size)
                    hit = np.flatnonzero(near[grams >> np.uint64(44)])
                    key = np.minimum(np.searchsorted(known, grams[hit]), len(known) - 1)
                    same = known[key] == grams[hit]
                    docs.append(words.text[at[hit[same]]])
                    places.append(at[hit[same]] - words.first[docs[-1]])
                    keys.append(key[same])
                doc, place, key = np.concatenate(docs), np.concatenate(places), np.concatenate(keys)
                order = np.lexsort((key, doc))
                doc, place, key = doc[order], place[order], key[order]
                first = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(key, prepend=-1))
                one, gram = doc[first], key[first]  # each word pair once per document
                size = start[gram + 1] - start[gram]
                some, slot = np.unique(one, return_inverse=True)
                cost = np.maximum(np.bincount(slot, size, len(some)), n_items)
                part = (np.cumsum(cost) // _CELLS).astype(np.int64)[slot]  # parts of whole documents
                pairs = []
                for p in np.unique(part):
                    sel = np.flatnonzero(part == p)
                    base = slot[sel[0]]
                    post = np.repeat(start[gram[sel]] - np.cumsum(size[sel]) + size[sel], size[sel]) + np.arange(size[sel].sum())
                    cell = np.repeat(slot[sel] - base, size[sel]) * n_items + m["item"][post]
                    held = np.bincount(cell, m["times"][post], (slot[sel[-1]] - base + 1) * n_items).reshape(-1, n_items)
                    d, i = np.nonzero(held >= m["need"])
                    pairs += zip(some[d + base].tolist(), i.tolist(), strict=True)
                if not pairs:
                    continue
                low, high = [], []
                for d, i in pairs:
                    a, b = np.searchsorted(doc, [d, d + 1])
                    at = place[a:b][np.isin(key[a:b], m["gram"][m["of"][i] : m["of"][i + 1]])]
                    low.append(at.min())
                    high.append(at.max())
                found, counts = np.unique([d for d, _ in pairs], return_counts=True)
                yield from batches(
                    schema,
                    ids[lo:hi][found],
                    pa.array([texts[lo + i] for i in found], pa.string()),
                    lists(counts, m["ids"][[i for _, i in pairs]], pa.int64()),
                    lists(counts, np.array(low, np.int32), pa.int32()),
                    lists(counts, np.array(high, np.int32), pa.int32()),
                )

    return run


def align(docs: list[np.ndarray], items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Smith-Waterman score and longest run of equal words of each (document part, item) pair."""
    rows, width = max(map(len, docs)), max(map(len, items))
    a = np.zeros((len(docs), rows), np.uint64)
    b = np.zeros((len(docs), width), np.uint64)
    for i, (x, y) in enumerate(zip(docs, items, strict=True)):
        a[i, : len(x)], b[i, : len(y)] = x, y
    real = np.arange(width)[None, :] < np.array([len(y) for y in items])[:, None]
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    score = np.zeros((len(docs), width + 1), np.int32)
    run = np.zeros((len(docs), width + 1), np.int32)
    best, longest = np.zeros(len(docs), np.int32), np.zeros(len(docs), np.int32)
    length = np.array([len(x) for x in docs])
    for r in range(rows):
        same = (a[:, r : r + 1] == b) & real & (r < length)[:, None]
        run[:, 1:] = np.where(same, run[:, :-1] + 1, 0)
        ahead = np.maximum(score[:, :-1] + np.where(same, MATCH, MISMATCH), score[:, 1:] + GAP)
        score[:, 1:] = np.maximum(ahead, 0)
        score = np.maximum.accumulate(score + slope, axis=1) - slope
        np.maximum(best, np.where(real, score[:, 1:], 0).max(1), out=best)
        np.maximum(longest, run.max(1), out=longest)
    return best, longest


def _bitmap(bits: int):
    """Which buckets of a bitmap the n-grams of a task fall into."""
    schema = pa.schema([("bucket", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in stream:
            seen[batch.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)] = True
        yield from batches(schema, np.flatnonzero(seen))

    return run


def _thinned(n_of: tuple[int, ...], bitmap, bits: int):
    """(doc_id, at, gram) of the n-grams whose bucket is set."""
    schema = pa.schema([("doc_id", pa.int64()), ("at", pa.int32()), ("gram", pa.int64())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = np.unpackbits(np.frombuffer(bitmap.value, np.uint8)).astype(bool)
        for batch in stream:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), texts_of(batch.column(1))
            for lo, hi in k.chunks(texts):
                words = k.Words(texts[lo:hi])
                for n in n_of:
                    grams, at = words.grams(n)
                    hit = np.flatnonzero(near[grams >> np.uint64(64 - bits)])
                    doc = words.text[at[hit]]
                    yield from batches(schema, ids[lo:hi][doc], (at[hit] - words.first[doc]).astype(np.int32), signed(grams[hit]))

    return run


def _found_in(docs: DataFrame, wanted: DataFrame, n_of: tuple[int, ...]) -> DataFrame:
    """(doc_id, at, gram): where the n-grams ``wanted`` (gram) stand, by a shuffle on the n-gram."""
    spark = docs.sparkSession
    seen = np.zeros(1 << BITMAP_BITS, bool)
    buckets = wanted.select("gram").mapInArrow(_bitmap(BITMAP_BITS), "bucket long").distinct()
    seen[buckets.toArrow().column(0).to_numpy()] = True  # at most 2**BITMAP_BITS lines
    bitmap = spark.sparkContext.broadcast(np.packbits(seen).tobytes())
    thin = docs.mapInArrow(_thinned(n_of, bitmap, BITMAP_BITS), "doc_id long, at int, gram long")
    return thin.join(wanted.select("gram").distinct(), "gram", "left_semi").select("doc_id", "at", "gram")


def _counted(share: float):
    """Of candidate pairs (doc_id, item_id, text, item_text) those whose document holds enough of the item's word pairs, with where they stand."""
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in stream:
            docs, items = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            texts, item_texts = texts_of(batch.column(2)), texts_of(batch.column(3))
            for lo, hi in k.chunks(texts):
                words, given, out = k.Words(texts[lo:hi]), k.Words(item_texts[lo:hi]), []
                need = _needed(share, np.diff(given.first))
                for size in (1, 2):
                    (grams, at), (mine, of) = words.grams(size), given.grams(size)
                    doc, item = words.text[at], given.text[of]
                    for i in np.flatnonzero((need == 1) == (size == 1)):
                        a, b = np.searchsorted(doc, [i, i + 1])
                        x, y = np.searchsorted(item, [i, i + 1])
                        held = np.isin(mine[x:y], grams[a:b]).sum()
                        if held and held >= need[i] - (size == 2):
                            place = at[a:b][np.isin(grams[a:b], mine[x:y])] - words.first[i]
                            out.append((docs[lo + i], items[lo + i], place.min(), place.max()))
                if out:
                    yield from batches(schema, *([r[c] for r in out] for c in range(4)))

    return run


def _shuffled_copies(docs: DataFrame, items: DataFrame, item_keys: DataFrame, share: float) -> DataFrame:
    """(doc_id, item_id, low, high) of the documents that hold enough of an item's word pairs, however many items there are."""
    hits = _found_in(docs, item_keys, (1, 2) if not item_keys.filter("single").isEmpty() else (2,)).select("doc_id", "gram").distinct()
    hits = materialize(hits, "pair-hits")
    frequency = hits.groupBy("gram").agg(F.count("*").alias("df"))
    # Pairs not in the corpus come first: they are the rarest. Of `all` occurrences, any `all - need + 1` hold one a copy has.
    by_rarity = Window.partitionBy("item_id").orderBy(F.coalesce("df", F.lit(0)), "gram")
    ranked = item_keys.join(frequency, "gram", "left").withColumn("before", F.sum("times").over(by_rarity) - F.col("times"))
    ranked = ranked.withColumn("all", F.sum("times").over(Window.partitionBy("item_id")))
    prefix = ranked.filter((F.col("before") <= F.col("all") - F.col("need")) & F.col("df").isNotNull()).select("item_id", "gram")
    pairs = hits.join(prefix, "gram").select("doc_id", "item_id").distinct()
    both = pairs.join(docs.dropDuplicates(["doc_id"]), "doc_id").join(items.dropDuplicates(["item_id"]).withColumnRenamed("text", "item_text"), "item_id")
    return both.select("doc_id", "item_id", "text", "item_text").mapInArrow(_counted(share), "doc_id long, item_id long, low int, high int")


def _aligned(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.int32()), ("longest_run", pa.int32()), ("item_words", pa.int32())])
    for batch in stream:
        docs, items = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        texts, item_texts = texts_of(batch.column(2)), texts_of(batch.column(3))
        low, high = batch.column(4).to_numpy(), batch.column(5).to_numpy()
        for lo, hi in k.chunks(texts):
            words, given = k.Words(texts[lo:hi]), k.Words(item_texts[lo:hi])
            parts, wholes = [], []
            for i in range(hi - lo):
                item = given.hash[given.first[i] : given.first[i + 1]]
                doc = words.hash[words.first[i] : words.first[i + 1]]
                parts.append(doc[max(0, low[lo + i] - 2 * len(item)) : high[lo + i] + 2 * len(item)])
                wholes.append(item)
            order = np.argsort([len(x) for x in parts], kind="stable")
            for j in range(0, len(order), _PAIRS):
                some = order[j : j + _PAIRS]
                best, longest = align([parts[i] for i in some], [wholes[i] for i in some])
                size = np.array([len(wholes[i]) for i in some], np.int32)
                yield from batches(schema, docs[lo:hi][some], items[lo:hi][some], best, longest, size)


def _id_text(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias(name), F.col(text_col).alias("text")).filter(
        F.col(name).isNotNull() & (F.length("text") > 0)
    )


def leaks(
    docs: DataFrame,
    items: DataFrame,
    passage: int = 12,
    gram: int = 6,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    block_grams: int = 1 << 20,
    share: float = 0.6,
) -> DataFrame:
    """(doc_id, item_id, score, longest_run, item_words) of every pair that shares a seed or may score ``share`` of the best."""
    if not 1 <= gram <= passage:
        raise ValueError("need 1 <= gram <= passage")
    if not 0 < share <= 1:
        raise ValueError("need 0 < share <= 1")
    spark = docs.sparkSession
    docs, items = _id_text(docs, doc_id, doc_text, "doc_id"), _id_text(items, item_id, item_text, "item_id")
    item_grams = materialize(items.mapInArrow(_gram_rows(gram), "id long, pos int, gram long").withColumnRenamed("id", "item_id"), "item-grams")
    n_grams = item_grams.select("gram").distinct().count()
    many = n_grams > block_grams
    if many:
        hits, held = materialize(_found_in(docs, item_grams, (gram,)), "hits"), None
    else:
        known = item_grams.select("gram").distinct().toPandas()["gram"].to_numpy(np.int64)
        if not len(known):
            known = np.zeros(1, np.int64)
        wanted = spark.sparkContext.broadcast(np.sort(known.view(np.uint64)).view(np.int64))
        held = materialize(docs.mapInArrow(_holders(gram, wanted), "doc_id long, text string, at array<int>, gram array<long>"), "holders")
        hits = held.select("doc_id", F.explode(F.arrays_zip("at", "gram")).alias("h")).select("doc_id", "h.at", "h.gram")
    frequency = hits.select("doc_id", "gram").distinct().groupBy("gram").agg(F.count("*").alias("df"))
    near = Window.partitionBy("item_id").orderBy("pos").rangeBetween(0, passage - gram)
    seeds = (
        item_grams.join(frequency, "gram")
        .select("item_id", F.min(F.struct("df", "gram")).over(near).alias("rarest"))
        .select("item_id", F.col("rarest.gram").alias("gram"))
        .distinct()
    )
    item_keys = materialize(
        items.dropDuplicates(["item_id"]).mapInArrow(_item_keys(share), "item_id long, gram long, times int, need int, single boolean"), "item-keys"
    )
    pairs = hits.join(seeds, "gram").select("doc_id", "item_id", F.col("at").alias("low"), F.col("at").alias("high"))
    if many or item_keys.count() > block_grams:
        pairs = pairs.union(_shuffled_copies(docs, items, item_keys, share).select("doc_id", "item_id", "low", "high"))
        pairs = materialize(pairs, "candidates")
        texts = docs.join(pairs.select("doc_id").distinct(), "doc_id", "left_semi")
    else:
        texts = held.select("doc_id", "text")
        keys = item_keys.toPandas()
        if len(keys):
            copies = docs.mapInArrow(_copies(spark.sparkContext.broadcast(_model(keys))), "doc_id long, text string, item_id array<long>, low array<int>, high array<int>")
            copies = materialize(copies, "copies")
            pairs = pairs.union(copies.select("doc_id", F.explode(F.arrays_zip("item_id", "low", "high")).alias("c")).select("doc_id", "c.item_id", "c.low", "c.high"))
            texts = texts.union(copies.select("doc_id", "text"))
    pairs = pairs.groupBy("doc_id", "item_id").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    texts = texts.dropDuplicates(["doc_id"])
    item_texts = items.dropDuplicates(["item_id"]).withColumnRenamed("text", "item_text")
    return (
        pairs.join(texts, "doc_id")
        .join(item_texts, "item_id")
        .select("doc_id", "item_id", "text", "item_text", "low", "high")
        .mapInArrow(_aligned, "doc_id long, item_id long, score int, longest_run int, item_words int")
    )
