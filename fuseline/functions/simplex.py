"""Simplex geometry: columns over ARRAY<DOUBLE>, and their NumPy twins for what the driver computes."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIM = 64
BYTE_SEED, RESERVED_SEED = 42, 7919

# ------------------------------------------------------------------------------------------------- columns


def _sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x)


def project(vec: Column) -> Column:
    """Euclidean projection onto the probability simplex (sort, running sum, threshold)."""
    v = F.transform(vec, lambda x: x.cast("double"))
    start = F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("s"), F.lit(0.0).alias("theta"))

    def step(acc: Column, u: Column) -> Column:
        k = acc["k"] + 1
        s = acc["s"] + u
        theta = (s - 1) / k
        return F.struct(k.alias("k"), s.alias("s"), F.when(u - theta > 0, theta).otherwise(acc["theta"]).alias("theta"))

    theta = F.aggregate(F.sort_array(v, asc=False), start, step, lambda acc: acc["theta"])
    # The threshold enters as one more array element, so that it is computed once per vector.
    pair = F.struct(v.alias("v"), theta.alias("t"))
    return F.element_at(
        F.transform(F.array(pair), lambda p: F.transform(p["v"], lambda x: F.greatest(x - p["t"], F.lit(0.0)))), 1
    )


def overlap(p: Column, q: Column) -> Column:
    """Sum of sqrt(p q)."""
    return _sum(F.zip_with(p, q, lambda a, b: F.sqrt(a * b)))


def distance(p: Column, q: Column) -> Column:
    """arccos of the overlap, from 0 to pi/2."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), overlap(p, q))))


def midpoint(p: Column, q: Column) -> Column:
    """Geodesic midpoint: (sqrt p + sqrt q)^2, scaled to sum one."""
    raw = F.zip_with(p, q, lambda a, b: F.pow(F.sqrt(a) + F.sqrt(b), F.lit(2.0)))
    return F.transform(F.array(F.struct(raw.alias("r"), _sum(raw).alias("s"))), lambda x: F.transform(x["r"], lambda y: y / x["s"]))[0]


def slerp(p: Column, q: Column, t: float) -> Column:
    """The point a share t along the geodesic from p to q."""
    omega = distance(p, q)
    a = F.when(omega < 1e-12, F.lit(1.0)).otherwise(F.sin(omega * (1 - t)) / F.sin(omega))
    b = F.when(omega < 1e-12, F.lit(0.0)).otherwise(F.sin(omega * t) / F.sin(omega))
    weights = F.array(F.struct(a.alias("a"), b.alias("b")))
    raw = F.transform(
        weights, lambda w: F.zip_with(p, q, lambda x, y: F.pow(w["a"] * F.sqrt(x) + w["b"] * F.sqrt(y), F.lit(2.0)))
    )[0]
    return F.transform(F.array(F.struct(raw.alias("r"), _sum(raw).alias("s"))), lambda x: F.transform(x["r"], lambda y: y / x["s"]))[0]


def granularity(kappa: Column, coarse: float = 50.0, fine: float = 30.0) -> Column:
    return F.when(kappa >= coarse, "coarse").when(kappa <= fine, "fine").otherwise("normal")


# ---------------------------------------------------------------------------------------------- aggregates


def centers(points: DataFrame, by: list[str], vec: str = "vector") -> DataFrame:
    """First iterate of the mean on the simplex for each group: the squared, rescaled mean of square roots."""
    each = points.select(*by, F.posexplode(vec).alias("dim", "x"))
    mean = each.groupBy(*by, "dim").agg(F.avg(F.sqrt("x")).alias("m"))
    total = mean.groupBy(*by).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("dim", (F.col("m") * F.col("m")).alias("y")))), lambda s: s["y"]).alias("y")
    )
    return total.select(*by, F.transform("y", lambda y: y / _sum(F.col("y"))).alias("center"))


def phi_kappa(points: DataFrame, by: list[str], vec: str = "vector") -> DataFrame:
    """``phi`` and ``kappa`` of each group from the distances to its center; fewer than two points give (0.5, 1)."""
    c = centers(points, by, vec)
    joined = points.join(c, by) if by else points.crossJoin(F.broadcast(c))  # one row
    spread = joined.select(*by, distance(F.col(vec), F.col("center")).alias("d")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("d").alias("mean_d"), F.stddev_pop("d").alias("std_d")
    )
    clip = lambda x, low, high: F.greatest(F.lit(low), F.least(F.lit(high), x))
    few = F.col("n") < 2
    return spread.select(
        *by,
        "n",
        F.when(few, 0.5).otherwise(clip(1 - F.col("mean_d") / (math.pi / 2), 0.3, 0.95)).alias("phi"),
        F.when(few, 1.0).otherwise(clip(10 / (F.col("std_d") + 0.1), 0.1, 100.0)).alias("kappa"),
    )


# ------------------------------------------------------------------------------------------------- driver


def np_project(v: np.ndarray) -> np.ndarray:
    u = np.sort(np.asarray(v, float))[::-1]
    s = np.cumsum(u)
    k = np.arange(1, len(u) + 1)
    rho = np.flatnonzero(u - (s - 1) / k > 0)[-1]
    return np.maximum(v - (s[rho] - 1) / (rho + 1), 0.0)


def np_distance(p: np.ndarray, q: np.ndarray) -> float:
    return float(np.arccos(np.clip(np.sqrt(p * q).sum(), -1.0, 1.0)))


def np_midpoint(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    z = (np.sqrt(p) + np.sqrt(q)) ** 2
    return z / z.sum()


def np_mean(points: np.ndarray, rounds: int = 20, tolerance: float = 1e-12) -> np.ndarray:
    """Mean on the simplex by the log/exp iteration on the sphere of square roots; without rounds its first iterate, which
    ``centers`` gives too."""
    x = np.sqrt(np.asarray(points, float))
    m = x.mean(axis=0)
    m /= np.linalg.norm(m)
    for _ in range(rounds):
        c = np.clip(x @ m, -1.0, 1.0)
        theta = np.arccos(c)
        scale = np.where(theta < 1e-12, 1.0, theta / np.maximum(np.sin(theta), 1e-300))
        step = ((x - c[:, None] * m) * scale[:, None]).mean(axis=0)
        size = np.linalg.norm(step)
        if size < tolerance:
            break
        m = np.cos(size) * m + np.sin(size) * step / size
    return m * m / (m * m).sum()


def np_phi_kappa(points: np.ndarray) -> tuple[float, float]:
    """The same as ``phi_kappa``: both measure from the first iterate of the mean."""
    if len(points) < 2:
        return 0.5, 1.0
    center = np_mean(points, rounds=0)
    d = np.array([np_distance(p, center) for p in points])
    return float(np.clip(1 - d.mean() / (np.pi / 2), 0.3, 0.95)), float(np.clip(10 / (d.std() + 0.1), 0.1, 100.0))


def seeded_point(seed: int, dim: int = DIM) -> np.ndarray:
    """A point drawn evenly from the simplex; the generator is local, the global one is left alone."""
    return np.random.RandomState(seed).dirichlet(np.ones(dim))


@lru_cache(maxsize=4)
def base_points(dim: int = DIM) -> np.ndarray:
    """The points of the 256 bytes."""
    return np.stack([seeded_point(b + BYTE_SEED, dim) for b in range(256)])
