"""Nearest neighbours of every vector by balanced posting lists.

Every group gets posting lists of about ``list_size`` vectors: centroids come from a balanced
bisection of a bounded sample, each vector is stored in all lists whose centroid is nearly
as close as the nearest (boundary vectors are replicated), and a query visits all lists that
pass the distance-ratio rule. The rule alone decides how many lists that are, there is no
other limit: few where vectors form clusters, most where nothing tells them apart. Centroids
are searched by a graph that is built once per group and held in memory. A group of at most
``list_size`` vectors is one list.

Lists that lie next to each other in the bisection share a shelf, and a vector is sent once
to a shelf in whose lists it is stored or looks, so vectors move about twice however many
lists they visit. Shelves that outgrow their capacity are searched in blocks, so no task
holds more than a bounded part however skewed the groups or lists are.

Bounds (parameters): ``list_size`` vectors wanted in a list, which grows where the centroids
of all groups would exceed ``max_lists`` (what is broadcast), ``SAMPLE_PER_LIST`` sampled
vectors a list for fitting. None of them leaves out a vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from engrava.llm.arrow import batches
from engrava.llm.vectors import matrix, top_k
from engrava.session import materialize

SAMPLE_PER_LIST = 64
#: Lists of a shelf: bits of a mask.
SHELF = 32
#: Group sizes up to this number are broadcast, more are joined.
GROUP_BROADCAST = 200_000
_PAIRS = "id long, neighbour long, cosine double"


@dataclass(frozen=True)
class ListConfig:
    dim: int = 64
    list_size: int = 256
    max_lists: int = 16384
    replicas: int = 4
    replica_ratio: float = 1.1
    probe_ratio: float = 1.3
    dense: int = 64
    block_postings: int = 16384
    block_queries: int = 32768

    def __post_init__(self):
        if min(self.dim, self.list_size, self.max_lists, self.replicas, self.block_postings, self.block_queries) < 1:
            raise ValueError("sizes must be positive")
        if self.replica_ratio < 1 or self.probe_ratio < self.replica_ratio:
            raise ValueError("need 1 <= replica_ratio <= probe_ratio")


class CentroidGraph:
    """Best-first search over a nearest-neighbour graph of centroids; complete when there are few."""

    def __init__(self, centroids: np.ndarray, links: np.ndarray | None = None, dense: int = 64):
        self.c, self.dense = centroids, len(centroids) <= dense
        self.norm = (centroids**2).sum(1)
        if self.dense:
            return
        self.links = graph_links(centroids) if links is None else links
        self.entries = np.arange(0, len(centroids), max(1, len(centroids) // 64))

    def search(self, q: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest centroids of each query and their squared distances, ascending."""
        width = min(width, len(self.c))
        square = (q**2).sum(1)[:, None]
        if self.dense or 2 * width > len(self.c):
            d = np.maximum(square + self.norm[None] - 2 * q @ self.c.T, 0)
            at = np.argsort(d, axis=1, kind="stable")[:, :width]
            return at, np.take_along_axis(d, at, 1)
        beam = max(64, 2 * width)
        at = np.broadcast_to(self.entries, (len(q), len(self.entries)))
        best = None
        while True:
            d = np.maximum(square + self.norm[at] - 2 * np.einsum("qd,qnd->qn", q, self.c[at]), 0)
            order = np.lexsort((at, d))
            at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
            d = np.where(np.diff(at, axis=1, prepend=-1) == 0, np.inf, d)
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            at, d = np.take_along_axis(at, order, 1), np.take_along_axis(d, order, 1)
            now = d[:, :width].sum()
            if best is not None and now >= best:
                return at[:, :width], d[:, :width]
            best = now
            at = np.concatenate([at, self.links[at[:, : max(8, width)]].reshape(len(q), -1)], axis=1)

    def within(self, q: np.ndarray, ratio: float, spread: np.ndarray, width: int = 32) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(query, centroid, rank, squared distance) of all centroids the ratio rule admits.

        The bound is ``ratio`` times the distance to the nearest centroid, or the mean
        distance of that list's members if greater. The search widens until it has them all.
        """
        rest, found = np.arange(len(q)), []
        if self.dense:
            width = len(self.c)
        while len(rest):
            at, d = self.search(q[rest], width)
            limit = np.maximum(d[:, 0], spread[at[:, 0]]) * ratio**2 + 1e-12
            done = (d[:, -1] > limit) | (at.shape[1] == len(self.c))
            i, rank = np.nonzero(done[:, None] & (d <= limit[:, None]))
            found.append((rest[i], at[i, rank], rank, d[i, rank]))
            rest, width = rest[~done], 2 * width if 4 * width <= len(self.c) else len(self.c)
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 3 + (np.empty(0),)


def graph_links(centroids: np.ndarray, degree: int = 24) -> np.ndarray:
    """Of each centroid its nearest ones and a few random ones."""
    links = np.empty((len(centroids), degree + 8), np.int32)
    norm = (centroids**2).sum(1)
    for lo in range(0, len(centroids), 1024):
        d = norm[None] - 2 * centroids[lo : lo + 1024] @ centroids.T
        links[lo : lo + 1024, :degree] = np.argpartition(d, degree, axis=1)[:, :degree]
    links[:, degree:] = np.random.default_rng(0).integers(0, len(centroids), (len(centroids), 8))
    return links


def balanced_centroids(x: np.ndarray, lists: int, seed: int = 0) -> np.ndarray:
    """Centroids of equally large parts, by repeated bisection along the widest direction found."""
    rng = np.random.default_rng(seed)
    parts = [x]
    while len(parts) < lists:
        at = int(np.argmax([len(p) for p in parts]))
        part = parts[at]
        if len(part) < 2:
            break
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(6):
            side = part @ (a - b) > ((a + b) / 2) @ (a - b)
            if side.all() or not side.any():
                break
            a, b = part[side].mean(0), part[~side].mean(0)
        order = np.argsort(part @ (a - b), kind="stable")
        half = len(part) // 2
        parts[at : at + 1] = [part[order[:half]], part[order[half:]]]
    return np.array([p.mean(0) for p in parts if len(p)])


def _fit(config: ListConfig):
    """Per group: centroids, mean squared distance of a list's members, links of the graph."""

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        x = matrix(frame.sort_values("id")["vec"], config.dim)
        c = balanced_centroids(x, int(frame["lists"].iloc[0])).astype(np.float32).astype(np.float64)
        far, near = np.zeros(len(c)), np.zeros(len(c))
        for lo in range(0, len(x), 1024):
            d = np.maximum(1 + (c**2).sum(1)[None] - 2 * x[lo : lo + 1024] @ c.T, 0)
            at = d.argmin(1)
            np.add.at(far, at, d.min(1))
            np.add.at(near, at, 1)
        links = graph_links(c).tobytes() if len(c) > config.dense else b""
        return pd.DataFrame({"grp": [key[0]], "centroids": [c.astype(np.float32).tobytes()], "spread": [(far / np.maximum(near, 1)).tobytes()], "links": [links]})

    return run


_SENT = "grp long, shelf int, block long, stored long, asked long, id long, vec binary"


def _shelved(config: ListConfig, model, blocks):
    """One row per vector and shelf: in which lists it is stored, which it asks. With ``blocks`` None only their sizes."""
    schema = pa.schema([("grp", pa.int64()), ("shelf", pa.int32()), ("block", pa.int64()), ("stored", pa.int64()), ("asked", pa.int64()), ("id", pa.int64()), ("vec", pa.binary())])
    sizes = pa.schema([("grp", pa.int64()), ("shelf", pa.int32()), ("np", pa.int64()), ("nq", pa.int64())])

    def placed(graph, spread, x):
        row, cell, rank, d = graph.within(x, config.probe_ratio, spread)
        nearest = np.zeros(len(x))
        nearest[row[rank == 0]] = d[rank == 0]
        kept = (rank < config.replicas) & (d <= nearest[row] * config.replica_ratio**2 + 1e-12)
        place = row * (len(graph.c) // SHELF + 1) + cell // SHELF
        order = np.argsort(place, kind="stable")
        first = np.flatnonzero(np.diff(place[order], prepend=-1))
        bit = np.left_shift(1, cell % SHELF)[order]
        joined = lambda b: np.bitwise_or.reduceat(b, first) if len(first) else b
        return row[order][first], (cell // SHELF)[order][first], joined(np.where(kept[order], bit, 0)), joined(bit)

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graphs: dict[int, tuple] = {}
        for batch in stream:
            if not batch.num_rows:
                continue
            ids, groups = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            order = np.argsort(groups, kind="stable")
            names, first = np.unique(groups[order], return_index=True)
            parts = {int(g): order[lo:hi] for g, lo, hi in zip(names, first, [*first[1:], len(order)], strict=True)}
            plain = [rows for g, rows in parts.items() if g not in model.value]
            out = []
            if plain and blocks is not None:
                rows = np.concatenate(plain)
                one = np.ones(len(rows), np.int64)
                out.append((rows, 0 * one, 0 * one, one, one))
            for g, rows in parts.items():
                if g not in model.value:
                    continue
                if g not in graphs:
                    c, spread, links = model.value[g]
                    c = np.frombuffer(c, np.float32).reshape(-1, config.dim).astype(np.float64)
                    links = np.frombuffer(links, np.int32).reshape(len(c), -1) if links else None
                    graphs[g] = CentroidGraph(c, links, config.dense), np.frombuffer(spread)
                x = matrix(batch.column(2).take(pa.array(rows)), config.dim)
                for lo in range(0, len(rows), 512):
                    row, shelf, stored, asked = placed(*graphs[g], x[lo : lo + 512])
                    row = rows[lo : lo + 512][row]
                    if blocks is None:
                        n = int(shelf.max(initial=-1)) + 1
                        counts = np.bincount(shelf, stored > 0, n).astype(np.int64), np.bincount(shelf, minlength=n)
                        yield from batches(sizes, np.full(n, g), np.arange(n, dtype=np.int32), *counts)
                    elif any((g, int(s)) in blocks.value for s in np.unique(shelf)):
                        size = np.array([blocks.value.get((g, int(s)), (1, 1)) for s in shelf]).reshape(-1, 2)
                        out += _blocked(row, shelf, stored, asked, np.abs(ids[row] * 2654435761 >> 7), size)
                    else:
                        out.append((row, shelf, np.zeros(len(row), np.int64), stored, asked))
            for row, shelf, block, stored, asked in out:
                yield from batches(schema, groups[row], shelf.astype(np.int32), block, stored, asked, ids[row], batch.column(2).take(pa.array(row)))

    return run


def _blocked(row, shelf, stored, asked, mine, size):
    """Spread a shelf's postings over its p blocks and its queries over its q blocks: every p meets every q."""
    p_own, q_own = mine % size[:, 0], mine % size[:, 1]
    for q in range(int(size[:, 1].max(initial=1))):
        some = (stored > 0) & (q < size[:, 1])
        if some.any():
            both = q_own[some] == q
            yield row[some], shelf[some], (p_own[some] << 31) + q, stored[some], np.where(both, asked[some], 0)
    for p in range(int(size[:, 0].max(initial=1))):
        some = (p < size[:, 0]) & ~((stored > 0) & (p_own == p))
        if some.any():
            yield row[some], shelf[some], (p << 31) + q_own[some], np.zeros(int(some.sum()), np.int64), asked[some]


def _search(config: ListConfig, k: int):
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        stored, asked, ids = (frame[c].to_numpy() for c in ("stored", "asked", "id"))
        x, found = matrix(frame["vec"], config.dim), []
        for bit in range(SHELF):
            s, a = np.flatnonzero(stored >> bit & 1), np.flatnonzero(asked >> bit & 1)
            if len(s) and len(a):
                row, near, cosine = top_k(x[a], ids[s], ids[a], x[s], k)
                found.append((ids[a[row]], near, cosine))
        if not found:
            return pd.DataFrame({"id": [], "neighbour": [], "cosine": []}).astype({"id": "int64", "neighbour": "int64", "cosine": "float64"})
        who, near, cosine = (np.concatenate(c) for c in zip(*found, strict=True))
        if len(found) > 1:
            order = np.lexsort((near, -cosine, who))
            who, near, cosine = who[order], near[order], cosine[order]
            fresh = np.diff(who, prepend=who[0] - 1) != 0
            keep = fresh | (np.diff(near, prepend=-1) != 0)  # a replicated vector is found in several lists, with one cosine
            who, near, cosine, fresh = who[keep], near[keep], cosine[keep], fresh[keep]
            rank = np.arange(len(who)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            who, near, cosine = who[rank < k], near[rank < k], cosine[rank < k]
        return pd.DataFrame({"id": who, "neighbour": near, "cosine": cosine})

    return run


def nearest_neighbours(vectors: DataFrame, k: int = 5, config: ListConfig | None = None) -> DataFrame:
    """(id, neighbour, cosine): the k most similar vectors of the same group for every vector.

    ``vectors`` has (id, grp, vec) as from ``usable_vectors``. Ties go to the smaller id;
    groups with fewer others give all of them; an empty table gives an empty result.
    """
    if k < 1:
        raise ValueError("k must be positive")
    config = config or ListConfig()
    spark = vectors.sparkSession
    vectors = materialize(vectors.select("id", "grp", "vec"), "vectors")
    sizes = materialize(vectors.groupBy("grp").agg(F.count("*").alias("n")), "group-sizes")
    total, groups, largest = sizes.agg(F.sum("n"), F.count("*"), F.max("n")).first()
    # A group with lists has more than list_size vectors, so all have at most 2 * total / list_size lists.
    list_size = max(config.list_size, -(-2 * (total or 0) // config.max_lists))
    sized = F.broadcast(sizes) if groups <= GROUP_BROADCAST else sizes
    models = {}
    if (largest or 0) > list_size:
        many = vectors.join(sized.filter(F.col("n") > list_size), "grp").withColumn("lists", F.ceil(F.col("n") / list_size))
        sample = many.filter(F.pmod(F.xxhash64("id"), F.col("n")) < F.col("lists") * SAMPLE_PER_LIST).select("id", "grp", "vec", "lists")
        fitted = sample.groupBy("grp").applyInPandas(_fit(config), "grp long, centroids binary, spread binary, links binary").collect()
        models = {r["grp"]: (bytes(r["centroids"]), bytes(r["spread"]), bytes(r["links"])) for r in fitted}  # at most max_lists centroids
    model = spark.sparkContext.broadcast(models)
    cut = {}
    if (largest or 0) > config.block_postings:
        hot = vectors.join(sized.filter(F.col("n") > config.block_postings), "grp").select("id", "grp", "vec")
        full = hot.mapInArrow(_shelved(config, model, None), "grp long, shelf int, np long, nq long").groupBy("grp", "shelf").agg(F.sum("np").alias("np"), F.sum("nq").alias("nq"))
        full = full.filter((F.col("np") > config.block_postings) | (F.col("nq") > config.block_queries)).collect()  # at most max_lists lines
        cut = {(r["grp"], r["shelf"]): (max(1, -(-r["np"] // config.block_postings)), max(1, -(-r["nq"] // config.block_queries))) for r in full}
    jobs = vectors.mapInArrow(_shelved(config, model, spark.sparkContext.broadcast(cut)), _SENT)
    found = jobs.groupBy("grp", "shelf", "block").applyInPandas(_search(config, k), _PAIRS)
    best = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.dropDuplicates(["id", "neighbour"]).withColumn("_rank", F.row_number().over(best)).filter(F.col("_rank") <= k).drop("_rank")
