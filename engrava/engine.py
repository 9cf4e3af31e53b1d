"""The engine as one object: a journal table, a blob folder, and the tools agents call.

Writes append records to the journal; reads are DataFrames over its typed views. The journal
is the only state, so a new ``Engine`` over the same folder continues where another stopped.
Times are nanoseconds; ``now_ns`` may be given, for replays and tests.
"""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from engrava.functions.text import normalize_tags
from engrava.operators import access, blobs, comms, journal, knn, memory

_RECORD = "ts_ns long, type short, tenant int, payload string"


class Engine:
    def __init__(self, spark: SparkSession, path: str, dim: int, embedder=None, tau: float = 0.0, gap: float = 0.0, lease_ns: int = 900_000_000_000):
        self.spark, self.path, self.dim, self.embedder, self.tau, self.gap, self.lease_ns = spark, path.rstrip("/"), dim, embedder, tau, gap, lease_ns
        self.blobs = blobs.BlobStore(spark, f"{self.path}/blobs")

    # ---- journal

    def journal(self) -> DataFrame:
        kinds = "seq long, ts_ns long, tenant int, payload string, type short"
        try:
            return self.spark.read.schema(kinds).parquet(f"{self.path}/journal")
        except Exception as e:  # nothing has been written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], kinds)

    def _append(self, tenant: int, event: str, payloads: list[dict], now_ns: int | None) -> list[int]:
        """Sequence numbers of the new records, in the order given."""
        last = self.journal().agg(F.max("seq")).first()[0] or 0
        now = time.time_ns() if now_ns is None else now_ns
        rows = [(now + i, journal.EVENT_TYPES[event], tenant, json.dumps(p, ensure_ascii=False)) for i, p in enumerate(payloads)]
        journal.append(self.spark, f"{self.path}/journal", self.spark.createDataFrame(rows, _RECORD), last)
        return [last + 1 + i for i in range(len(rows))]

    def view(self, event: str) -> DataFrame:
        return journal.typed(self.journal(), event)

    def stats(self) -> DataFrame:
        """(total, memories): records ever written, live memories."""
        return journal.total(self.journal()).crossJoin(self._live().agg(F.count("*").alias("memories")))  # one row each

    # ---- accesses

    def record_access(self, tenant: int, paths: list[str], now_ns: int | None = None) -> list[int]:
        """Record accesses by path; ids come from the tenant's registry, new paths get the next ones."""
        known = self.view("path_map").filter(F.col("tenant") == tenant)
        asked = self.spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "path string")
        ids = {r["path"]: r["id"] for r in known.join(F.broadcast(asked), "path").collect()}  # the paths of one call
        top = known.agg(F.max("id")).first()[0] or 0
        fresh = [p for p in dict.fromkeys(paths) if p not in ids]
        ids |= {p: top + 1 + i for i, p in enumerate(fresh)}
        if fresh:
            self._append(tenant, "path_map", [{"id": ids[p], "path": p} for p in fresh], now_ns)
        return self._append(tenant, "access", [{"item": ids[p], "src": p} for p in paths], now_ns)

    def analyze_access(self, tenant: int) -> DataFrame:
        """Lift of the online predictor over the tenant's accesses."""
        log = self.view("access").filter(F.col("tenant") == tenant).select("tenant", "seq", F.col("item").alias("item_id"))
        return access.stream_lift(log)

    # ---- memory

    def _live(self) -> DataFrame:
        """Live memories as (tenant, mem_id, seq, text, vec, tags, src, sup)."""
        rows = self.view("memory").select("seq", "tenant", F.col("id").alias("mem_id"), "text", "vec", normalize_tags(F.col("tags")).alias("tags"), "src", F.coalesce("sup", F.lit(0)).alias("sup"))
        return journal.live_by_tombstones(rows, self.view("forget").select("tenant", F.col("id").alias("mem_id")))

    def _vector(self, text: str) -> list[float]:
        if self.embedder is None:
            return list(memory.hash_vectors(self.spark.createDataFrame([(text,)], "text string"), self.dim).first()["vec"])
        vec = [float(x) for x in self.embedder([text])[0]]
        if len(vec) != self.dim:
            raise ValueError("the embedder gave a vector of another size")
        return vec

    def _nearest(self, tenant: int, vec: list[float], k: int) -> DataFrame:
        mine = self._live().filter(F.col("tenant") == tenant)
        query = self.spark.createDataFrame([(-1, vec)], "mem_id long, vec array<double>")
        return knn.nearest(mine, query, k, "mem_id", "vec", dim=self.dim)

    def remember(self, tenant: int, text: str, tags: list[str] | None = None, src: str = "", supersede: int = 0, force: bool = False, now_ns: int | None = None) -> tuple[int, bool]:
        """(id, stored): a near duplicate (nearer than tau) is not stored again, unless forced or replacing a live memory."""
        vec = self._vector(text)
        live = self._live().filter(F.col("tenant") == tenant)
        replaces = supersede and not live.filter(F.col("mem_id") == supersede).isEmpty()
        if not replaces and not force and self.tau > 0:
            near = self._nearest(tenant, vec, 1).first()
            if near is not None and near["dist"] < self.tau:
                return near["id"], False
        new = (self.view("memory").agg(F.max("id")).first()[0] or 0) + 1
        self._append(tenant, "memory", [{"id": new, "text": text, "vec": vec, "tags": tags or [], "src": src, "sup": supersede if replaces else 0}], now_ns)
        return new, True

    def recall(self, tenant: int, text: str, k: int = 5, now_ns: int | None = None) -> DataFrame:
        """(rank, mem_id, dist, text, tags): the k nearest memories of the tenant, cut at the gap; the recall is journaled."""
        hits = knn.gap_cut(self._nearest(tenant, self._vector(text), k), self.gap)
        out = hits.join(self._live().select(F.col("mem_id").alias("id"), "text", "tags"), "id").select("rank", F.col("id").alias("mem_id"), "dist", "text", "tags").orderBy("rank")
        found = [{"id": r["mem_id"], "dist": r["dist"]} for r in out.collect()]  # at most k
        self._append(tenant, "recall", [{"q": text, "k": k, "hits": found}], now_ns)
        return out

    def analyze_recall(self, tenant: int) -> DataFrame:
        rows = self.view("recall").filter(F.col("tenant") == tenant)
        return journal.recall_coverage(rows.select("tenant", "seq", F.get("hits", F.lit(0))["dist"].cast("double").alias("top_dist")))

    def forget(self, tenant: int, mem_id: int, now_ns: int | None = None) -> bool:
        """A tombstone is written only for a memory that is live for the tenant."""
        if self._live().filter((F.col("tenant") == tenant) & (F.col("mem_id") == mem_id)).isEmpty():
            return False
        self._append(tenant, "forget", [{"id": mem_id}], now_ns)
        return True

    def memories(self, tenant: int) -> DataFrame:
        return memory.listed(self._live(), tenant)

    def corpus(self) -> DataFrame:
        return memory.corpus(self._live())

    # ---- messages

    def _messages(self, event: str) -> DataFrame:
        rows = self.view(event)
        return rows.select(
            "seq", "ts_ns", "tenant", "area", F.col("from").alias("sender"), "kind", "text", F.coalesce("target", F.lit("")).alias("target"), F.coalesce("ref", F.lit(0)).alias("ref_seq"), F.coalesce("blob", F.lit("")).alias("blob_id"),
            "mime", "w", "h", F.coalesce("exp", F.lit(0)).alias("expires_ns"), F.coalesce("dl", F.lit(0)).alias("deadline_ns"),
        )

    def index(self, now_ns: int | None = None) -> dict[str, DataFrame]:
        """Live messages, tasks and pins."""
        now = time.time_ns() if now_ns is None else now_ns
        states = self.view("message_state").select("tenant", F.col("ref_seq").alias("task_seq"), "seq", "state", F.col("by").alias("holder"), F.coalesce("lease", F.lit(0)).alias("lease_until"))
        pins = self.view("blob_pin").select("tenant", F.col("blob").alias("blob_id"), "seq", "on")
        return comms.rebuild(self._messages("message"), self._messages("image"), self.view("comms_clear"), states, pins, now)

    def post(self, tenant: int, area: str, sender: str, text: str, kind: str = "note", target: str = "", ref: int = 0, expires_ns: int = 0, deadline_ns: int = 0, now_ns: int | None = None) -> int:
        if not area or not sender or not text:
            raise ValueError("area, from and text are required")
        return self._append(tenant, "message", [{"area": area, "from": sender, "kind": kind or "note", "text": text, "target": target, "ref": ref, "exp": expires_ns, "dl": deadline_ns}], now_ns)[0]

    def post_image(self, tenant: int, area: str, sender: str, content: bytes, mime: str, text: str = "", now_ns: int | None = None) -> int:
        if not area or not sender or not content or not mime:
            raise ValueError("area, from, content and mime are required for an image")
        blob = self.blobs.put(self.spark.createDataFrame([(bytearray(content),)], "content binary")).first()["blob_id"]
        return self._append(tenant, "image", [{"area": area, "from": sender, "kind": "image", "text": text, "blob": blob, "mime": mime, "size": len(content)}], now_ns)[0]

    def get_image(self, tenant: int, seq: int) -> bytes | None:
        row = comms.get(self.index()["messages"], tenant, seq).filter("blob_id <> ''").first()
        found = None if row is None else self.blobs.get(row["blob_id"]).first()
        return None if found is None else bytes(found["content"])

    def read(self, tenant: int, area: str, since: int = 0, target: str | None = None, now_ns: int | None = None) -> DataFrame:
        return comms.read_area(self.index(now_ns)["messages"], tenant, area, since, target).orderBy("seq")

    def inbox(self, tenant: int, target: str, since: int = 0, now_ns: int | None = None) -> DataFrame:
        return comms.inbox(self.index(now_ns)["messages"], tenant, target, since).orderBy("seq")

    def comms_clear(self, tenant: int, area: str, now_ns: int | None = None) -> int:
        """Drop an area's messages; gives how many there were."""
        dropped = self.index(now_ns)["messages"].filter((F.col("tenant") == tenant) & (F.col("area") == area)).count()
        self._append(tenant, "comms_clear", [{"area": area}], now_ns)
        return dropped

    def _task(self, tenant: int, seq: int, now: int):
        return self.index(now)["tasks"].filter((F.col("tenant") == tenant) & (F.col("seq") == seq)).first()

    def claim(self, tenant: int, seq: int, by: str, now_ns: int | None = None) -> bool:
        """Take a task: granted if it is pending, or its lease is over, or ``by`` holds it."""
        now = time.time_ns() if now_ns is None else now_ns
        t = self._task(tenant, seq, now)
        if t is None or not (t["state"] == "pending" or (t["state"] in ("claimed", "overdue") and (now > t["lease_until"] or t["holder"] == by))):
            return False
        self._append(tenant, "message_state", [{"seq": seq, "state": "claimed", "by": by, "lease": now + self.lease_ns}], now)
        return True

    def resolve(self, tenant: int, seq: int, by: str, state: str = "done", now_ns: int | None = None) -> bool:
        """Finish a task: only its holder or its sender may, and only once."""
        if state not in comms.TERMINAL:
            raise ValueError("a task resolves to done or cancel")
        now = time.time_ns() if now_ns is None else now_ns
        t = self._task(tenant, seq, now)
        if t is None or t["state"] in comms.TERMINAL:
            return False
        owner = comms.get(self.index(now)["messages"], tenant, seq).first()["sender"]
        if by not in (t["holder"], owner) or not by:
            return False
        self._append(tenant, "message_state", [{"seq": seq, "state": state, "by": t["holder"], "lease": t["lease_until"]}], now)
        return True

    def pin_image(self, tenant: int, blob_id: str, on: bool = True, now_ns: int | None = None) -> None:
        self._append(tenant, "blob_pin", [{"blob": blob_id, "on": on}], now_ns)

    def blob_gc(self, now_ns: int | None = None) -> int:
        """Delete blobs no live message shows and no tenant pins; gives their number."""
        index = self.index(now_ns)
        keep = index["messages"].filter("blob_id <> ''").select("blob_id").union(index["pins"].select("blob_id")).distinct()
        return self.blobs.sweep(keep)

    def promote(self, tenant: int, seq: int, now_ns: int | None = None) -> tuple[int, bool]:
        """Remember a message as '[from area#seq] text', tagged 'promoted'."""
        row = comms.promote(comms.get(self.index(now_ns)["messages"], tenant, seq)).first()
        if row is None:
            raise ValueError("no such message")
        return self.remember(tenant, row["text"], ["promoted"], now_ns=now_ns)
