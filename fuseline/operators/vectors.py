"""Vector operators in blocks: projection, distances to a query set, nearest points, means."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import simplex
from ..sources.shared import shared_folder

#: Centers that are broadcast: 8 MB of 64 components.
CENTERS = 1 << 14
#: Distances that a task of a block of queries and a share of the points gives, about: 100 MB.
CELL = 1 << 22


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length, as a float64 matrix."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if not len(lists):
        return flat.reshape(0, 1)
    if len(flat) % len(lists) or lists.null_count:
        raise ValueError("vectors must have one length and no nulls")
    return flat.reshape(len(lists), -1)


def project_rows(v: np.ndarray) -> np.ndarray:
    """Simplex projection of each row."""
    u = -np.sort(-v, axis=1)
    theta = (np.cumsum(u, axis=1) - 1) / np.arange(1, v.shape[1] + 1)
    last = (u - theta > 0).shape[1] - 1 - np.argmax((u - theta > 0)[:, ::-1], axis=1)
    return np.maximum(v - theta[np.arange(len(v)), last][:, None], 0.0)


def projected(vectors: DataFrame, vec_col: str, into: str = "vector") -> DataFrame:
    """``vectors`` with their simplex projection, a batch at a time."""

    @F.arrow_udf(T.ArrayType(T.DoubleType()))
    def project(column: pa.Array) -> pa.Array:
        if not len(column):
            return pa.array([], pa.list_(pa.float64()))
        out = project_rows(_matrix(column))
        offsets = np.arange(len(out) + 1, dtype=np.int32) * out.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(out.ravel()))

    return vectors.withColumn(into, project(F.col(vec_col).cast("array<double>")))


def _scan(ids: np.ndarray, roots: np.ndarray, own: np.ndarray, points: np.ndarray, k: int | None):
    """(query ids, point ids, distances) of each query to each other point; with ``k`` the k nearest of each query."""
    d = np.arccos(np.clip(roots @ np.sqrt(points).T, -1.0, 1.0))
    q, i = np.divmod(np.arange(d.size), len(own))
    flat = d.ravel()
    keep = ids[q] != own[i]
    q, i, flat = q[keep], i[keep], flat[keep]
    if k is not None:
        order = np.lexsort((own[i], np.round(flat, 9), q))
        q, i, flat = q[order], i[order], flat[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        q, i, flat = q[place < k], i[place < k], flat[place < k]
    return ids[q], own[i], flat


def distances(
    points: DataFrame,
    queries: DataFrame,
    k: int | None = None,
    id_col: str = "vec_id",
    vec_col: str = "vector",
    block: int = 2048,
    share: int | None = None,
) -> DataFrame:
    """(query_id, id, d) of every point to every query; with ``k`` only the k nearest that each batch holds.

    Up to ``block`` queries (counted) are broadcast and the points stay where they are.  More are dealt into blocks of
    that size, the points into shares, and each block meets each share in a task of its own: one plan, whatever the
    number of queries.  A task's result lies in memory, so a share is as small as ``CELL`` distances want it, or 50,000 points if only
    the nearest are kept.
    """
    spark, share = points.sparkSession, share or (max(1, CELL // block) if k is None else 50_000)
    schema = f"query_id long, {id_col} long, d double"
    names = ["query_id", id_col, "d"]
    q = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    p = points.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("v"))
    n = q.count()
    if not n:
        return spark.createDataFrame([], schema)
    if n <= block:
        rows = q.toArrow()  # at most ``block`` rows
        shared = spark.sparkContext.broadcast((rows.column(0).to_numpy(), np.sqrt(_matrix(rows.column(1)))))

        def scan(batches):
            ids, roots = shared.value
            for batch in batches:
                own = batch.column(0).to_numpy()
                for at in range(0, len(own), 1024):
                    part = batch.slice(at, 1024)
                    found = _scan(ids, roots, own[at : at + 1024], _matrix(part.column(1)), k)
                    yield pa.record_batch([pa.array(c) for c in found], names=names)

        return p.mapInArrow(scan, schema)

    blocks, shares = -(-n // block), max(1, -(-p.count() // share))
    deal = lambda parts, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(parts)).cast("int")
    every = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    left = q.select(deal(blocks, 1).alias("block"), every(shares).alias("share"), "id", "v")
    right = p.select(every(blocks).alias("block"), deal(shares, 2).alias("share"), "id", "v")

    def meet(own: pa.Table, other: pa.Table) -> pa.Table:
        found = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        if len(own) and len(other):
            ids, roots = own.column("id").to_numpy(), np.sqrt(_matrix(own.column("v")))
            for at in range(0, len(other), 1024):
                part = other.slice(at, 1024)
                found.append(_scan(ids, roots, part.column("id").to_numpy(), _matrix(part.column("v")), k))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names)

    cells = ["block", "share"]
    return left.groupBy(*cells).cogroup(right.groupBy(*cells)).applyInArrow(meet, schema)


def nearest(points: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vec_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, d): the k nearest points of each query, ties (at nine digits) by id."""
    found = distances(points, queries, k, id_col, vec_col)
    order = Window.partitionBy("query_id").orderBy(F.round("d", 9), id_col)
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= k).select("query_id", "rank", id_col, "d")


def frechet_means(points: DataFrame, by: str, vec_col: str = "vector", rounds: int = 8, least: float = 1e-12) -> DataFrame:
    """(by, center): means on the simplex by the log/exp iteration, in at most ``rounds`` rounds from the first iterate.

    Each round joins the points with the centers of the groups that still move, sums the tangents in every batch and then by group,
    and moves those centers; a group whose center moves by ``least`` or less is done.  Groups may be as many and as large as they
    like: up to ``CENTERS`` centers (counted) are broadcast, and more meet the points in a shuffle, where adaptive execution
    splits large groups; sums are partial before they are shuffled.  Nothing but counts comes to the driver.  Rows with
    a null group are a group."""
    kind = points.schema[by].dataType.simpleString()
    rows = points.select(F.col(by).alias("key"), F.col(vec_col).alias("x"))
    shared_folder(points.sparkSession)
    root = F.transform("center", lambda x: F.sqrt(x))
    state = simplex.centers(points, [by], vec_col).select(F.col(by).alias("key"), root.alias("m"), F.lit(True).alias("live")).checkpoint()

    def tangents(batches):
        for batch in batches:
            keys = batch.column(0).dictionary_encode()
            code = keys.indices.fill_null(len(keys.dictionary)).to_numpy(zero_copy_only=False)
            x, m = np.sqrt(_matrix(batch.column(1))), _matrix(batch.column(2))
            c = np.clip((x * m).sum(axis=1), -1.0, 1.0)
            theta = np.arccos(c)
            scale = np.where(theta < 1e-12, 1.0, theta / np.maximum(np.sin(theta), 1e-300))
            step = (x - c[:, None] * m) * scale[:, None]
            order = np.argsort(code, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(code[order]) != 0)) if len(code) else order
            if len(first):
                sums, n = np.add.reduceat(step[order], first, axis=0), np.diff(np.append(first, len(code)))
                flat = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * sums.shape[1]), pa.array(sums.ravel()))
                yield pa.record_batch([batch.column(0).take(pa.array(order[first])), flat, pa.array(n)], names=["key", "step", "n"])

    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y))
    for _ in range(rounds):
        live = state.filter("live").select(F.col("key").alias("own"), "m")
        groups = live.count()
        if not groups:
            break
        met = rows.join(F.broadcast(live) if groups <= CENTERS else live, F.col("key").eqNullSafe(F.col("own")))
        dims = met.select("key", "x", "m").mapInArrow(tangents, f"key {kind}, step array<double>, n long").select(
            "key", "n", F.posexplode("step").alias("dim", "s")
        )
        moves = (
            dims.groupBy("key", "dim")
            .agg((F.sum("s") / F.sum("n")).alias("s"))
            .groupBy(F.col("key").alias("moved"))
            .agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "s"))), lambda d: d["s"]).alias("g"))
            .withColumn("size", norm("g"))
            .filter(F.col("size") > least)
        )
        moved = F.zip_with("m", "g", lambda m, g: F.cos("size") * m + F.sin("size") * g / F.col("size"))
        state = (
            state.join(moves, F.col("key").eqNullSafe(F.col("moved")), "left")
            .select("key", F.when(F.col("size").isNull(), F.col("m")).otherwise(moved).alias("m"), F.col("size").isNotNull().alias("live"))
            .checkpoint()
        )
    total = F.aggregate("m", F.lit(0.0), lambda a, y: a + y * y)
    return state.select(F.col("key").alias(by), F.transform("m", lambda y: y * y / total).alias("center"))
