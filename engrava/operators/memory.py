"""Semantic memory over the journal: rebuild, remember with its duplicate gate, forget, list, corpus view.

``remember`` decides records in sequence order, as each insert changes what later ones meet.
Distances are computed where the rows lie, only pairs nearer than ``tau`` go on; records that
are linked by such pairs or by superseding form one component, which is decided by itself
from its pairs, without any vector. Null ids and vectors of another size are left out by
``remember`` and an error for ``rebuild``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engrava.functions.text import normalize_tags
from engrava.operators.components import connected_components
from engrava.operators.journal import live_by_tombstones, once
from engrava.operators.knn import pairs_within
from engrava.session import materialize


def rebuild(memories: DataFrame, forgets: DataFrame, dim: int) -> DataFrame:
    """Live memories with normalised tags; a vector that has not ``dim`` numbers is an error."""
    wrong = F.coalesce(F.size("vec"), F.lit(-1)) != dim
    checked = F.when(wrong, F.raise_error(F.concat(F.lit("memory with a vector of another size: "), F.col("mem_id").cast("string")))).otherwise(F.col("vec"))
    rows = live_by_tombstones(once(memories), forgets)
    return rows.withColumn("vec", checked.cast(memories.schema["vec"].dataType)).withColumn("tags", normalize_tags(F.col("tags")))


def _decide(frames: pd.DataFrame) -> pd.DataFrame:
    """The records of one component in sequence order: (seq, status, existing)."""
    live: dict[int, int] = {}  # id -> sequence number of the record that holds it
    out = []
    for r in frames.sort_values("seq").itertuples(index=False):
        if r.sup in live:
            status, existing = "superseded", r.sup
            del live[r.sup]
        else:
            near = [i for i in r.near if i in live] if not r.force else []
            status, existing = ("duplicate", near[0]) if near else ("inserted", 0)
        if status != "duplicate":
            live[r.mem_id] = r.seq
        out.append((r.seq, r.tenant, r.mem_id, status, existing))
    return pd.DataFrame(out, columns=["seq", "tenant", "mem_id", "status", "existing"])


def remember(records: DataFrame, tau: float, dim: int = 64, vec_col: str = "vec") -> DataFrame:
    """(seq, tenant, mem_id, status, existing): what becomes of each record, in the order of ``seq``.

    ``records`` has (seq, tenant, mem_id, vec, sup) and may have ``force``. A record whose
    ``sup`` is live replaces that memory; else one that has a live memory of its tenant
    strictly nearer than ``tau`` is a duplicate of the nearest (ties: smaller id); else, or
    if forced, it is inserted. ``tau`` 0 turns the gate off.
    """
    force = F.col("force") if "force" in records.columns else F.lit(False)
    rows = records.select("seq", "tenant", "mem_id", F.coalesce("sup", F.lit(0)).alias("sup"), force.alias("force"), F.col(vec_col).alias("vec"))
    rows = materialize(once(rows.filter("seq is not null and mem_id is not null")).filter(F.size("vec") == dim), "remember")
    if tau > 0:
        pairs = pairs_within(rows, tau, "seq", "vec", "tenant", dim)
        ids = rows.select(F.col("seq").alias("b"), F.col("mem_id").alias("id"))
        pairs = materialize(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"), "dist").join(ids, "b"), "near")
    else:
        pairs = rows.sparkSession.createDataFrame([], "b long, a long, dist double, id long")
    holders = rows.select(F.col("tenant").alias("t"), F.col("mem_id").alias("m"), F.col("seq").alias("src"))
    heirs = rows.filter("sup <> 0").select(F.col("tenant").alias("t"), F.col("sup").alias("m"), F.col("seq").alias("dst"))
    same = holders.select("t", "m", F.col("src").alias("dst"))
    # A record's fate hangs on those it is near to, the one it replaces, and earlier ones of its id.
    first = same.groupBy("t", "m").agg(F.min("dst").alias("src"))
    links = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(first.join(heirs, ["t", "m"]).select("src", "dst")).union(first.join(same, ["t", "m"]).select("src", "dst"))
    parts = connected_components(links).select(F.col("node").alias("seq"), "component")
    near = F.transform(F.array_sort(F.collect_list(F.struct("dist", "id"))), lambda x: x["id"])
    lists = pairs.groupBy(F.col("a").alias("seq")).agg(near.alias("near"))
    known = rows.drop("vec").join(lists, "seq", "left").join(parts, "seq", "left")
    alone = known.filter("component is null").select("seq", "tenant", "mem_id", F.lit("inserted").alias("status"), F.lit(0).cast("long").alias("existing"))
    linked = known.filter("component is not null").withColumn("near", F.coalesce("near", F.array().cast("array<long>")))
    decided = linked.groupBy("component").applyInPandas(_decide, "seq long, tenant int, mem_id long, status string, existing long")
    return alone.unionByName(decided)


def forget(live: DataFrame, asked: DataFrame) -> DataFrame:
    """(tenant, mem_id, done): a tombstone is due only for a memory that is live for the tenant that asks."""
    held = live.select("tenant", "mem_id", F.lit(True).alias("done")).distinct()
    return asked.select("tenant", "mem_id").distinct().join(held, ["tenant", "mem_id"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def listed(live: DataFrame, tenant: int | None = None) -> DataFrame:
    """Live memories in order of insertion."""
    rows = live if tenant is None else live.filter(F.col("tenant") == tenant)
    return rows.orderBy("seq")


def corpus(live: DataFrame) -> DataFrame:
    """(tenant, mem_id, text, tags, src, dim, count): what a dashboard shows, with each tenant's number of memories."""
    counts = live.groupBy("tenant").agg(F.count("*").alias("count"))
    return live.join(counts, "tenant").select("tenant", "mem_id", "text", "tags", "src", F.size("vec").alias("dim"), "count")


def recall_records(hits: DataFrame, tenant_col: str = "tenant") -> DataFrame:
    """(tenant, qid, k, hits): recalls as the journal stores them, hits as (id, dist) by rank."""
    row = F.struct("rank", F.col("id"), F.col("dist").cast("float").alias("dist"))
    listed_ = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x["id"].alias("id"), x["dist"].alias("dist")))
    return hits.groupBy(tenant_col, "qid").agg(F.count("*").cast("int").alias("k"), listed_.alias("hits"))


def reembedded(journal_memories: DataFrame, vectors: DataFrame) -> DataFrame:
    """Memory records with new vectors by ``seq``, all else as it was; a record without a new vector is an error."""
    new = vectors.select("seq", F.col("vec").alias("_new"))
    out = journal_memories.join(new, "seq", "left")
    missing = F.raise_error(F.concat(F.lit("no new vector for record "), F.col("seq").cast("string")))
    return out.withColumn("vec", F.coalesce("_new", missing.cast(journal_memories.schema["vec"].dataType))).drop("_new")


def hash_vectors(texts: DataFrame, dim: int, text_col: str = "text", vec_col: str = "vec") -> DataFrame:
    """``texts`` with a vector from hashed words: a stand-in embedder that needs no model.

    Each word adds +1 or -1 to one component (by its MD5 digest), the sum is scaled to unit
    length; a text without words, or null, gets zeros.
    """
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 0)
    slots = F.transform(words, lambda w: F.struct((F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("long") % dim).cast("int").alias("p"), (F.conv(F.substring(F.md5(w), 8, 7), 16, 10).cast("long") % 2 * 2 - 1).cast("double").alias("s")))
    sums = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.aggregate(F.filter("_slots", lambda x: x["p"] == i), F.lit(0.0), lambda acc, x: acc + x["s"]))
    out = texts.withColumn("_slots", slots).withColumn("_sums", sums)
    size = F.sqrt(F.aggregate("_sums", F.lit(0.0), lambda acc, x: acc + x * x))
    return out.withColumn(vec_col, F.transform("_sums", lambda x: F.when(size > 0, x / size).otherwise(0.0).cast("float"))).drop("_slots", "_sums")


def embed(texts: DataFrame, embedder, dim: int, text_col: str = "text", vec_col: str = "vec") -> DataFrame:
    """``texts`` with vectors of ``embedder``, a function from a list of texts to an array (n, dim), called per Arrow batch.

    Another number or size of vectors is an error.
    """

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            out = embedder(part.fillna("").tolist())
            if len(out) != len(part) or any(len(v) != dim for v in out):
                raise ValueError("the embedder gave another number or size of vectors")
            yield pd.Series([list(map(float, v)) for v in out])

    return texts.withColumn(vec_col, vectors(F.col(text_col)))
