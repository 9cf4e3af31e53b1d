"""Append-only journal: typed views, scans, path registry, live memories and their recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.functions.text import truncate
from engrava.session import materialize

#: The journal's event types.
EVENT_TYPES = {"access": 1, "path_map": 2, "memory": 3, "forget": 4, "message": 5, "recall": 6, "comms_clear": 7, "image": 8, "blob_pin": 9, "message_state": 10}

PAYLOADS = {
    "access": "item long, src string",
    "path_map": "id long, path string",
    "memory": "id long, text string, vec array<float>, tags array<string>, src string, sup long",
    "forget": "id long",
    "recall": "q string, k int, hits array<struct<id:long,dist:float>>",
    "message": "area string, `from` string, kind string, text string, target string, ref long, blob string, mime string, w int, h int, size int, exp long, dl long",
    "comms_clear": "area string",
    "blob_pin": "blob string, `on` boolean",
    "message_state": "seq long, state string, `by` string, lease long",
}
PAYLOADS["image"] = PAYLOADS["message"]


def once(records: DataFrame, seq: str = "seq") -> DataFrame:
    """Each record once: redelivered rows have the same sequence number and content."""
    return records.dropDuplicates([seq])


def append(spark, path: str, records: DataFrame, last_seq: int) -> None:
    """Append (ts_ns, type, tenant, payload) with sequence numbers that go on after ``last_seq``, by (ts_ns, tenant, payload)."""
    ordered = records.repartitionByRange("ts_ns", "tenant", "payload").sortWithinPartitions("ts_ns", "tenant", "payload")
    # Written first: the numbers below must not come from two evaluations of the same partitioning.
    numbered = materialize(ordered.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "append")
    sizes = numbered.groupBy("_part").agg(F.count("*").alias("n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    offsets = sizes.withColumn("_offset", F.coalesce(F.sum("n").over(before), F.lit(0)))
    out = numbered.join(F.broadcast(offsets.select("_part", "_first", "_offset")), "_part")
    out = out.select((F.lit(last_seq + 1) + F.col("_offset") + F.col("_at") - F.col("_first")).alias("seq"), "ts_ns", F.col("type").cast("short").alias("type"), F.col("tenant").cast("int").alias("tenant"), "payload")
    out.write.mode("append").partitionBy("type").parquet(path)


def typed(journal: DataFrame, event: str, skip_bad: bool = False) -> DataFrame:
    """The payloads of one event type as columns; a bad payload is an error, or skipped."""
    mode = "PERMISSIVE" if skip_bad else "FAILFAST"
    schema = PAYLOADS[event] + (", _bad string" if skip_bad else "")
    options = {"mode": mode, "columnNameOfCorruptRecord": "_bad"} if skip_bad else {"mode": mode}
    rows = journal.filter(F.col("type") == EVENT_TYPES[event]).withColumn("p", F.from_json("payload", schema, options))
    if skip_bad:
        rows = rows.filter("p._bad is null")
    fields = [f for f in rows.schema["p"].dataType.fieldNames() if f != "_bad"]
    return rows.select("seq", "ts_ns", "tenant", *(F.col(f"p.`{f}`").alias("ref_" + f if f == "seq" else f) for f in fields))


def scan(journal: DataFrame, tenant: int | None = None, kind: int | None = None, newest_first: bool = False, limit: int | None = None) -> DataFrame:
    """Records of a tenant and type in sequence order, or the newest first."""
    if tenant is not None:
        journal = journal.filter(F.col("tenant") == tenant)
    if kind is not None:
        journal = journal.filter(F.col("type") == kind)
    ordered = journal.orderBy(F.desc("seq") if newest_first else "seq")
    return ordered if limit is None else ordered.limit(limit)


def read(journal: DataFrame, seq: int) -> DataFrame:
    """The record with a sequence number; the filter reaches the scan."""
    return journal.filter(F.col("seq") == seq)


def total(journal: DataFrame) -> DataFrame:
    """(total): the number of records ever appended, which is the last sequence number."""
    return journal.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("total"))


def clamp(limit: int | None, default: int, most: int) -> int:
    """A limit as callers give it: missing or not positive means the default, more than the most means the most."""
    return min(default if limit is None or limit <= 0 else limit, most)


def panel(memories: DataFrame, forgets: DataFrame, messages: DataFrame, tenant: int | None = None, limit: int | None = None) -> DataFrame:
    """(seq, ts_ms, type, text): the newest memory, forget and message records as lines, oldest first; 60 by default, 200 at most."""
    line = {
        "Memory": F.concat(F.lit("#"), F.col("mem_id").cast("string"), F.lit(" "), truncate(F.coalesce("text", F.lit("")), 80)),
        "Forget": F.concat(F.lit("tombstone #"), F.col("mem_id").cast("string")),
        "Message": F.concat(
            F.coalesce("sender", F.lit("")), F.when(F.coalesce("target", F.lit("")) != "", F.concat(F.lit(" → "), F.col("target"))).otherwise(""),
            F.lit(" @"), F.coalesce("area", F.lit("")), F.lit(": "), truncate(F.coalesce("text", F.lit("")), 60),
        ),
    }
    rows = None
    for kind, part in (("Memory", memories), ("Forget", forgets), ("Message", messages)):
        if tenant is not None:
            part = part.filter(F.col("tenant") == tenant)
        part = part.select("seq", F.floor(F.col("ts_ns") / 1_000_000).alias("ts_ms"), F.lit(kind).alias("type"), line[kind].alias("text"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.orderBy(F.desc("seq")).limit(clamp(limit, 60, 200)).orderBy("seq")


def recall_log(recalls: DataFrame, last: int = 8, ring: int = 500) -> DataFrame:
    """(tenant, n, seq, q): the last queries of each tenant, newest first, among its last ``ring`` recalls."""
    newest = Window.partitionBy("tenant").orderBy(F.desc("seq"))
    return recalls.withColumn("n", F.row_number().over(newest)).filter(F.col("n") <= min(last, ring)).select("tenant", "n", "seq", "q")


def touched_paths(uses: DataFrame, known: DataFrame, key: str = "use_id") -> DataFrame:
    """(key, n, path): known files a tool use touched, once each, in order of first mention.

    ``uses`` has (key, tool, input, response, cwd); ``known`` the paths that exist as files.
    Reading and editing tools name a file, shell commands are split at white space, search
    results also before a colon (path:line). Relative paths stand below ``cwd``.
    """
    named = F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.notebook_path"))
    words = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), r"\s+"), lambda w: w != "")
    tokens = (
        F.when(F.col("tool").isin("Read", "Edit", "Write", "MultiEdit", "NotebookEdit"), F.array(F.coalesce(named, F.lit(""))))
        .when(F.col("tool") == "Bash", words(F.get_json_object("input", "$.command")))
        .when(F.col("tool").isin("Grep", "Glob"), words(F.regexp_replace(F.coalesce("response", F.lit("")), r'[\[\]{}",]|\\n', " ")))
        .otherwise(F.array().cast("array<string>"))
    )
    rows = uses.select(key, "cwd", F.posexplode(tokens).alias("at", "token")).filter("token <> ''")
    before = F.when(F.instr("token", ":") > 1, F.substring_index("token", ":", 1))
    full = lambda c: F.when(c.startswith("/"), c).otherwise(F.concat(F.col("cwd"), F.lit("/"), F.regexp_replace(c, r"^(\./)+", "")))
    tries = rows.select(key, "at", F.posexplode(F.array_compact(F.array(full(F.col("token")), full(before)))).alias("try", "path"))
    found = tries.join(known.select("path").distinct(), "path", "left_semi")
    first = found.groupBy(key, "at").agg(F.min_by("path", "try").alias("path")).groupBy(key, "path").agg(F.min("at").alias("at"))
    return first.select(key, F.row_number().over(Window.partitionBy(key).orderBy("at")).alias("n"), "path")


def record_access(last: DataFrame, accesses: DataFrame) -> DataFrame:
    """(tenant, seq, id, path, new): accesses by path with the ids of the registry, going on from ``last`` (tenant, path, id).

    A path seen for the first time gets the tenant's next id, in order of its first access.
    """
    known = accesses.join(last.select("tenant", "path", F.col("id").alias("known")), ["tenant", "path"], "left")
    fresh = path_registry(known.filter("known is null").select("tenant", "seq", "path"))
    top = last.groupBy("tenant").agg(F.max("id").alias("top"))
    fresh = fresh.join(top, "tenant", "left").select("tenant", "path", (F.col("id") + F.coalesce("top", F.lit(0))).alias("fresh"))
    return known.join(fresh, ["tenant", "path"], "left").select("tenant", "seq", F.coalesce("known", "fresh").alias("id"), "path", F.col("known").isNull().alias("new"))


def path_registry(accesses: DataFrame) -> DataFrame:
    """(tenant, path, id): ids from 1 per tenant in order of a path's first access."""
    first = accesses.groupBy("tenant", "path").agg(F.min("seq").alias("first_seq"))
    return first.withColumn("id", F.row_number().over(Window.partitionBy("tenant").orderBy("first_seq", "path"))).select("tenant", "path", "id")


def live_by_tombstones(memories: DataFrame, forgets: DataFrame) -> DataFrame:
    """Memories that no record of their tenant supersedes or forgets, whatever the order (the journal's start-up rule)."""
    gone = memories.filter("sup <> 0").select("tenant", F.col("sup").alias("mem_id")).union(forgets.select("tenant", "mem_id")).distinct()
    return memories.join(gone, ["tenant", "mem_id"], "left_anti")


def recall_coverage(recalls: DataFrame, ring: int = 500) -> DataFrame:
    """Per tenant, over its last ``ring`` recalls: total, empty, and minimum, median, 90th percentile and maximum of the top distance.

    The percentile is the value at index floor(f n), not interpolated.
    """
    newest = Window.partitionBy("tenant").orderBy(F.desc("seq"))
    last = recalls.withColumn("_r", F.row_number().over(newest)).filter(F.col("_r") <= ring)
    tops = F.array_sort(F.collect_list("top_dist"))
    at = lambda f: F.get(F.col("tops"), F.least(F.floor(F.lit(f) * F.size("tops")).cast("int"), F.size("tops") - 1))
    out = last.groupBy("tenant").agg(F.count("*").alias("total"), F.count_if(F.col("top_dist").isNull()).alias("empty"), tops.alias("tops"))
    return out.select("tenant", "total", "empty", *(F.coalesce(at(f), F.lit(0.0)).alias(n) for f, n in ((0.0, "top_min"), (0.5, "top_p50"), (0.9, "top_p90"), (1.0, "top_max"))))
