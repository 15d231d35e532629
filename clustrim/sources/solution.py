"""Solutions on disk: a folder with a one-row summary, the centres, and every point with its cluster."""

from __future__ import annotations

import json
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

if TYPE_CHECKING:
    from ..operators.assign import Solution

SUMMARY = "problem string, algo_codename string, algo_fullname string, elapsed_ms double, cost double, outliers_cost double, extra map<string,string>, instance string, centers_pt array<array<double>>"


def instance_meta(points: DataFrame, k: int, z: int, name: str = "benchmark", metric: str = "L2", n_all: int | None = None, z_share: float | None = None) -> dict:
    """What a solution was computed for: the data set's name, size and width, selected and all points, k, z, metric."""
    n, dim = points.agg(F.count("*"), F.max(F.size("x"))).first()
    size = n if n_all is None else n_all
    out = {"dataset": {"name": name, "size": size, "dim": dim or 0}, "N": n, "N_orig": size, "K": k, "Z": z, "metric": metric, "codename": f"{name}-{k}-{z}"}
    return out if z_share is None else out | {"Z_perc": z_share}


def write_solution(s: Solution, path: str, instance: dict | None = None) -> None:
    """summary (JSON), points (id, cluster, d2, is_outlier) and, where a detection step ran, detected ids."""
    spark = s.assignments.sparkSession
    row = ("kmeans", s.codename, s.fullname, float(s.elapsed_ms), float(s.cost), float(s.outliers_cost), s.extra, json.dumps(instance or {}), [[float(v) for v in c] for c in s.centres])
    spark.createDataFrame([row], SUMMARY).coalesce(1).write.mode("overwrite").json(f"{path}/summary")
    s.assignments.select("id", "cluster", "d2", "is_outlier").write.mode("overwrite").parquet(f"{path}/points")
    if s.original_outliers is not None:
        s.original_outliers.select("id").write.mode("overwrite").parquet(f"{path}/detected")


def read_solution(spark: SparkSession, path: str, points: DataFrame | None = None) -> Solution:
    """The solution back; with `points`, only their ids, and their x beside."""
    from ..operators.assign import Solution

    r = spark.read.schema(SUMMARY).json(f"{path}/summary").first()
    got = spark.read.schema("id long, cluster int, d2 double, is_outlier boolean").parquet(f"{path}/points")
    if points is not None:
        got = got.join(points.select("id", "x"), "id")
    out = Solution([list(c) for c in r["centers_pt"] or []], got, r["cost"], r["outliers_cost"] or 0.0)
    out.extra, out.codename, out.fullname, out.elapsed_ms = dict(r["extra"] or {}), r["algo_codename"] or "", r["algo_fullname"] or "", r["elapsed_ms"]
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(f"{path}/detected")
    if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        out.original_outliers = spark.read.schema("id long").parquet(f"{path}/detected")
    return out


def member_lists(s: Solution) -> DataFrame:
    """(cluster, ids): the ids of each cluster in ascending order, for clusters that fit a row."""
    return s.members().groupBy("cluster").agg(F.sort_array(F.collect_list("id")).alias("ids"))
