"""Points against a few centres: assignment, group means, costs, the final step of every solver.

Centres are k x d numbers on the driver.  Small k x d goes into literal arithmetic; larger ones into an
Arrow kernel.  Statistics are summed per task before they are dealt out by cluster.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nearest
from . import select
from .neighbours import exact

LITERAL_TERMS = 64


def assign(points: DataFrame, centres: list[list[float]]) -> DataFrame:
    """Adds cluster (-1 without centres) and d2; the lowest cluster wins ties."""
    if not centres:
        return points.withColumn("cluster", F.lit(-1)).withColumn("d2", F.lit(None).cast("double"))
    if len(centres) * len(centres[0]) <= LITERAL_TERMS:
        best = nearest(F.col("x"), centres)
        return points.withColumn("best", best).select(*points.columns, F.col("best.cluster").alias("cluster"), F.col("best.d2").alias("d2"))
    c = np.array(centres, float)

    @F.pandas_udf("cluster int, d2 double")
    def find(x: pd.Series) -> pd.DataFrame:
        d = exact(np.stack(x.to_numpy()), c)
        k = d.argmin(1)
        return pd.DataFrame({"cluster": k.astype("int32"), "d2": d[np.arange(len(k)), k]})

    return points.withColumn("best", find("x")).select(*points.columns, F.col("best.cluster").alias("cluster"), F.col("best.d2").alias("d2"))


class Reach:
    """Points (id, x) with d2, the squared distance to the nearest centre so far; each round meets new centres only.

    The table is cached from round to round and written every CUT rounds, so that its lineage stays short.
    """

    CUT = 8

    def __init__(self, points: DataFrame):
        self.points, self.now, self.old, self.rounds = points.select("id", "x"), None, None, 0
        self.scratch = select.Scratch(points.sparkSession)

    def add(self, centres: list[list[float]]) -> DataFrame:
        if self.old is not None:
            self.old.unpersist()
        if self.now is None:
            new = assign(self.points, centres).select("id", "x", "d2")
        else:
            new = assign(self.now.withColumnRenamed("d2", "before"), centres).select("id", "x", F.least("before", "d2").alias("d2"))
        self.rounds += 1
        if self.rounds % self.CUT == 0:
            new = self.scratch.write(new, "reach")
            self.scratch.drop("reach", keep=1)
        self.old, self.now = self.now, new.persist()
        return self.now

    def close(self) -> None:
        for df in (self.old, self.now):
            if df is not None:
                df.unpersist()
        self.scratch.drop("reach")


def nearest_distance(points: DataFrame, centres: list[list[float]], squared_too: bool = True) -> DataFrame:
    """(id, d): the (squared) distance to the nearest of a list of centres; infinite for an empty list."""
    if not centres:
        return points.select("id", F.lit(float("inf")).alias("d"))
    d2 = F.col("d2") if squared_too else F.sqrt("d2")
    return assign(points, centres).select("id", d2.alias("d"))


def means(assigned: DataFrame, k: int, dim: int, weight: str | None = None) -> dict[int, tuple[float, list[float]]]:
    """cluster -> (weight, mean), from a partial aggregate; k x d numbers come back."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = [F.sum(F.col("x")[j] * w).alias(f"s{j}") for j in range(dim)]
    rows = assigned.groupBy("cluster").agg(F.sum(w).alias("w"), *sums).collect()
    return {r["cluster"]: (r["w"], [r[f"s{j}"] / r["w"] if r["w"] else 0.0 for j in range(dim)]) for r in rows}


def lloyd(points: DataFrame, centres: list[list[float]], rounds: int = 100, tol: float = 1e-4, empty: str = "zero", weight: str | None = None):
    """(centres, cost, rounds).  Stops when the cost falls by less than tol of the cost before.

    A cluster without points goes to the origin, or stays with empty="keep".
    """
    dim, last = len(centres[0]), None
    for t in range(rounds):
        now = assign(points, centres)
        w = F.col(weight) if weight else F.lit(1.0)
        sums = [F.sum(F.col("x")[j] * w).alias(f"s{j}") for j in range(dim)]
        rows = now.groupBy("cluster").agg(F.sum(w).alias("w"), F.sum(F.col("d2") * w).alias("cost"), *sums).collect()
        cost = sum(r["cost"] for r in rows)
        if last is not None and abs(last - cost) < tol * last:
            return centres, cost, t
        got = {r["cluster"]: [r[f"s{j}"] / r["w"] if r["w"] else 0.0 for j in range(dim)] for r in rows}
        centres = [got.get(c, centres[c] if empty == "keep" else [0.0] * dim) for c in range(len(centres))]
        last = cost
    return centres, last, rounds


def lloyd_runs(points: DataFrame, starts: list[list[list[float]]], rounds: int = 100, tol: float = 1e-4) -> list[tuple[list[list[float]], float]]:
    """(centres, cost) of `lloyd` from each of `starts`; all runs that still move share a pass over the points.

    Every task sums its points for each run and cluster, so k x d numbers a task and run come back.
    """
    now, last, done = {r: np.array(c, float) for r, c in enumerate(starts)}, {}, {}

    def sums(held: dict[int, np.ndarray]):
        def run(batches):
            total = {r: np.zeros((len(c), c.shape[1] + 2)) for r, c in held.items()}  # weight, cost, coordinates
            for pdf in batches:
                if not len(pdf):
                    continue
                x = np.stack(pdf["x"].to_numpy())
                for r, c in held.items():
                    d = exact(x, c)
                    near = d.argmin(1)
                    cols = [None, d[np.arange(len(x)), near], *x.T]
                    total[r] += np.stack([np.bincount(near, w, len(c)) for w in cols], 1)
            yield pd.DataFrame([(r, i, *row) for r, t in total.items() for i, row in enumerate(t.tolist())], columns=names)

        names = ["run", "cluster", "w", "cost", *[f"s{j}" for j in range(len(starts[0][0]))]]
        kind = "run int, cluster int, " + ", ".join(f"{c} double" for c in names[2:])
        return points.select("x").mapInPandas(run, kind).groupBy("run", "cluster").agg(*[F.sum(c).alias(c) for c in names[2:]]).collect()

    for _ in range(rounds):
        if not now:
            break
        rows = sums(dict(now))
        for r, c in list(now.items()):
            own = sorted((x for x in rows if x["run"] == r), key=lambda x: x["cluster"])
            cost = sum(x["cost"] for x in own)
            if r in last and abs(last[r] - cost) < tol * last[r]:
                done[r] = now.pop(r).tolist(), cost
                continue
            last[r] = cost
            now[r] = np.array([[v / x["w"] if x["w"] else 0.0 for v in x[4:]] for x in own])
    return [done.get(r) or (now[r].tolist(), last[r]) for r in range(len(starts))]


def split_top(assigned: DataFrame, z: int) -> DataFrame:
    """Adds is_outlier: the z rows of largest d2, ties by smaller id, by an exact threshold."""
    if z <= 0:
        return assigned.withColumn("is_outlier", F.lit(False))
    return assigned.withColumn("is_outlier", select.among_top(select.edge(assigned, z)))


def trimmed_lloyd(points: DataFrame, centres: list[list[float]], z: int, rounds: int = 100):
    """k-means--: drop the z farthest, move the centres to the rest, stop when the cost rises no lower."""
    last, dim = None, len(centres[0])
    for t in range(rounds):
        kept = split_top(assign(points, centres), z).where(~F.col("is_outlier"))
        rows = kept.groupBy("cluster").agg(F.count("*").alias("w"), F.sum("d2").alias("cost"), *[F.sum(F.col("x")[j]).alias(f"s{j}") for j in range(dim)]).collect()
        cost = sum(r["cost"] for r in rows)
        if last is not None and cost >= last:
            return centres, last, t
        got = {r["cluster"]: [r[f"s{j}"] / r["w"] for j in range(dim)] for r in rows}
        centres = [got.get(c, centres[c]) for c in range(len(centres))]
        last = cost
    return centres, last, rounds


@dataclass
class Solution:
    centres: list[list[float]]
    assignments: DataFrame  # id, cluster, d2, is_outlier
    cost: float
    outliers_cost: float
    original_outliers: DataFrame | None = None
    extra: dict[str, str] = field(default_factory=dict)
    codename: str = ""
    fullname: str = ""
    elapsed_ms: float = 0.0

    def outliers(self) -> DataFrame:
        return self.assignments.where("is_outlier").select("id")

    def cluster_sizes(self) -> DataFrame:
        return self.assignments.where("not is_outlier").groupBy("cluster").agg(F.count("*").alias("n"))

    def members(self) -> DataFrame:
        """(cluster, id) of the points that are no outliers."""
        return self.assignments.where("not is_outlier").select("cluster", "id")

    def summary(self, spark) -> DataFrame:
        return spark.createDataFrame([(self.codename, self.cost, self.outliers_cost, len(self.centres), self.elapsed_ms, self.extra)], "codename string, cost double, outliers_cost double, num_centers int, elapsed_ms double, extra map<string,string>")


def finish(points: DataFrame, centres: list[list[float]], z: int) -> Solution:
    """All points to their nearest centre, the z farthest set aside."""
    done = split_top(assign(points, centres), z).drop("x")
    c = done.agg(F.sum(F.when(~F.col("is_outlier"), F.col("d2")).otherwise(0.0)), F.sum(F.when(F.col("is_outlier"), F.col("d2")).otherwise(0.0))).first()
    return Solution(centres, done, c[0] or 0.0, c[1] or 0.0)


def trimmed_cost(points: DataFrame, centres: list[list[float]], z: int) -> float:
    s = finish(points, centres, z)
    return s.cost


def overseed(assigned: DataFrame, eps: float, r: float, z: int) -> float:
    """Oversampling factor r / (1 - far / total), at least 1; n if nothing but far points costs.

    far is the cost of all points at least as far as the (m + 1)-th farthest, m = ceil((1 + eps) z).
    """
    total, n = assigned.agg(F.sum("d2"), F.count("*")).first()
    if not total or total <= 0 or z <= 0:
        return 1.0
    m = min(int(np.ceil((1 + eps) * z)), n - 1)
    edge = select.threshold(assigned, m + 1)
    far = assigned.where(F.col("d2") >= edge).agg(F.sum("d2")).first()[0]
    rest = 1 - far / total
    return max(r / rest if rest > 1e-10 else float(n), 1.0)
