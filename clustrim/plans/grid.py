"""Benchmark grid: data sets, presets, tasks, the runner, resource estimates."""

from __future__ import annotations

import argparse
import os
import platform
import time
import traceback
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import metrics
from ..sources import datasets
from ..sources import points as src
from . import report
from . import solvers as V

#: Name, k, outlier share, memory GB, minutes.
DATASETS = [
    ("SKIN-5", 10, 0.01, 0.5, 0.5),
    ("SKIN-10", 10, 0.01, 0.5, 0.5),
    ("SUSY-5", 10, 0.01, 4.0, 2.0),
    ("SUSY-10", 10, 0.01, 4.0, 2.0),
    ("SHUTTLE", 10, 0.0004, 0.1, 0.1),
    ("KDDFULL", 3, 0.0093, 8.0, 3.0),
]
#: Preset, memory factor, complexity.
PRESETS = [
    ("TIKMeans", 1.2, 1.0),
    ("IKMeans", 1.2, 1.5),
    ("RobustKmeans++", 1.5, 2.0),
    ("OKMeans", 2.5, 4.0),
    ("OKMeans2", 2.5, 4.0),
    ("OKMeansFAISS", 2.5, 4.0),
    ("OKMeans2FAISS", 2.5, 4.0),
    ("NKMeans", 2.0, 5.0),
    ("KMeans++", 1.1, 1.0),
    ("KMeans--", 1.5, 2.0),
]
SEEDS = 10
#: Neighbour factors of the sweep, and its presets.
FACTORS = [3, 4, 5, 7, 10, 15, 20]
SWEPT = ["OKMeansBadFAISS", "OKMeansFAISS", "OKMeans2FAISS"]


def preset(name: str, seed: int = 42) -> V.Solver:
    """The solver of a preset; the neighbour solvers run on coresets."""
    made = {
        "TIKMeans": lambda: V.TIKMeans(seed=seed),
        "IKMeans": lambda: V.IKMeans(seed=seed),
        "RobustKmeans++": lambda: V.RobustKMeansPlusPlus(seed=seed, delta=0.2),
        "OKMeans": lambda: V.Coreset(seed=seed, inner=V.OKMeans()),
        "OKMeans2": lambda: V.Coreset(seed=seed, inner=V.OKMeansBand(c=3)),
        "OKMeansFAISS": lambda: V.Coreset(seed=seed, inner=V.OKMeans(max_k=None)),
        "OKMeans2FAISS": lambda: V.Coreset(seed=seed, inner=V.OKMeansBand(c=3, max_k=None)),
        "NKMeans": lambda: V.Coreset(seed=seed, inner=V.NKMeans(iters=3)),
        "KMeans++": lambda: V.Coreset(seed=seed, inner=V.KMeansPlusPlus()),
        "KMeans--": lambda: V.KMeansMinusMinus(seed=seed),
    }
    return made[name]()


def swept(name: str, c: float, seed: int = 42) -> tuple[V.Solver, str, float]:
    """Solver, parameter name and value of one point of the sweep."""
    if name == "OKMeansBadFAISS":
        return V.Coreset(seed=seed, inner=V.OKMeansFixed(n_neighbors=int(c), max_k=None)), "n_neighbors", int(c)
    if name == "OKMeansFAISS":
        return V.Coreset(seed=seed, inner=V.OKMeans(neighbor_mult=(c + 1) / 2, max_k=None)), "neighbor_mult", (c + 1) / 2
    return V.Coreset(seed=seed, inner=V.OKMeansBand(c=c, max_k=None)), "c", c


def _numbered(spark, names: list, kind: str, column: str) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], f"{column}_no int, {column} {kind}").coalesce(1)  # a few names: one task, also after the joins


def task_grid(spark: SparkSession, datasets=None, algorithms=None, seeds: int = SEEDS, factors=None) -> DataFrame:
    """task_id, dataset, algorithm[, c], seed in row-major order."""
    parts = [_numbered(spark, datasets or [d[0] for d in DATASETS], "string", "dataset"), _numbered(spark, algorithms or [p[0] for p in PRESETS], "string", "algorithm")]
    if factors:
        parts.append(_numbered(spark, factors, "int", "c"))
    parts.append(_numbered(spark, list(range(seeds)), "int", "seed"))
    grid, order = parts[0], ["dataset_no"]
    for p in parts[1:]:
        grid = grid.crossJoin(p)  # fixed lists of a few names
        order.append(p.columns[0])
    out = grid.withColumn("task_id", F.row_number().over(Window.orderBy(*order)) - 1)
    return out.drop(*order)


def resource_plan(spark: SparkSession, parallel: int = 8) -> DataFrame:
    """One row: tasks, largest task memory, sequential and parallel minutes, jobs of 50 tasks."""
    d = spark.createDataFrame([(n, m, t) for n, _, _, m, t in DATASETS], "dataset string, gb double, minutes double").coalesce(1)
    a = spark.createDataFrame(PRESETS, "algorithm string, factor double, complexity double").coalesce(1)
    got = d.crossJoin(a).agg(F.max(F.col("gb") * F.col("factor") + 2.0).alias("max_memory_gb"), (F.sum(F.col("minutes") * F.col("complexity")) * SEEDS).alias("minutes"), (F.count("*") * SEEDS).alias("tasks"))
    return got.select("tasks", F.round("max_memory_gb", 6).alias("max_memory_gb"), F.round("minutes", 6).alias("minutes"), F.round(F.col("minutes") / parallel, 6).alias("parallel_minutes"), F.ceil(F.col("tasks") / 50).alias("jobs"))


@dataclass
class ExperimentConfig:
    """What a benchmark run takes; the defaults of the public grid."""

    datasets: list[str] = field(default_factory=lambda: [d[0] for d in DATASETS])
    algorithms: list[str] = field(default_factory=lambda: [p[0] for p in PRESETS])
    seeds: int = SEEDS
    timeout: float | None = 300.0
    metric: str = "L2"


@dataclass
class ResourceConfig:
    """Workers side by side, threads of each, memory of each in GB."""

    workers: int = 4
    threads: int = 4
    memory_gb: float = 64.0

    @staticmethod
    def of(cpus: int | None = None, memory_gb: float | None = None, threads: int | None = None) -> ResourceConfig:
        """As many workers as the processors allow with `threads` each, one for every 64 GB at most, at least one."""
        cpus, memory_gb, threads = cpus or os.cpu_count() or 4, memory_gb or 64.0, threads or int(os.environ.get("OMP_NUM_THREADS", 4))
        workers = max(1, min(cpus // threads, max(1, int(memory_gb / 64.0))))
        return ResourceConfig(workers, threads, memory_gb / workers)

    @staticmethod
    def from_batch(environ: dict | None = None, threads: int | None = None) -> ResourceConfig:
        """From the variables of a batch scheduler: processors of a task, memory of a node with unit G or M."""
        env = os.environ if environ is None else environ
        memory = env.get("SLURM_MEM_PER_NODE", "64G")
        gb = int(memory[:-1]) if memory.endswith("G") else int(memory.rstrip("M")) / 1024
        return ResourceConfig.of(int(env.get("SLURM_CPUS_PER_TASK", 8)), gb, threads or int(env.get("OMP_NUM_THREADS", 4)))


#: Executor settings that keep the numeric libraries of Python workers to one thread each.
WORKER_CONF = {f"spark.executorEnv.{v}": "1" for v in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}


def system_info(spark: SparkSession) -> dict:
    """Facts about the driver and the session, with the time in ISO form."""
    now = spark.sql("select date_format(current_timestamp(), \"yyyy-MM-dd'T'HH:mm:ss\") as now").first()["now"]
    return {"timestamp": now, "host": platform.node(), "system": platform.platform(), "python": platform.python_version(), "spark": spark.version, "cpus": os.cpu_count(), "parallelism": spark.sparkContext.defaultParallelism, "master": spark.sparkContext.master}


def sliced(tasks: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Tasks from `start` up to, not including, `end`."""
    out = tasks if start is None else tasks.where(F.col("task_id") >= start)
    return out if end is None else out.where(F.col("task_id") < end)


def distinct_names(tasks: DataFrame) -> dict[str, list]:
    """The data sets, algorithms and seeds that a task list names, sorted."""
    row = tasks.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in ("dataset", "algorithm", "seed")]).first()
    return row.asDict()


def _limited(spark: SparkSession, work, limit: float | None):
    """work() in a thread of its own, whose Spark jobs are cancelled when the limit is over; TimeoutError then."""
    group, got = f"task-{uuid.uuid4().hex}", {}

    def body():
        spark.sparkContext.setJobGroup(group, "benchmark task", True)
        try:
            got["value"] = work()
        except BaseException as e:
            got["error"] = e

    thread = InheritableThread(target=body, daemon=True)
    thread.start()
    thread.join(limit)
    if thread.is_alive():
        spark.sparkContext.cancelJobGroup(group)
        raise TimeoutError(f"over {limit} s")
    if "error" in got:
        raise got["error"]
    return got["value"]


def run_task(points: DataFrame, solver: V.Solver, k: int, task: dict, timeout: float | None = None) -> dict:
    """One result record; points has id, x, label, is_outlier; z is the true number of outliers."""
    spark = points.sparkSession
    n, dim, z = points.agg(F.count("*"), F.max(F.size("x")), F.count_if("is_outlier")).first()
    row = dict(task) | {"dataset_size": n, "dataset_dim": dim, "true_outliers": z, "k": k, "status": "completed", "error": None}
    if not solver.runnable(z):
        return row | {"status": "skipped"}
    began = time.time()
    try:
        s = _limited(spark, lambda: solver.run(points.select("id", "x"), k, z), timeout)
        row |= {"time_s": time.time() - began}
        both = s.assignments.join(points.select("id", "label", F.col("is_outlier").alias("is_true")), "id").persist()
        row |= metrics.outlier_scores(both).first().asDict()
        if not both.where(F.col("label").isNotNull()).isEmpty():
            row |= metrics.agreement(both.where("not is_outlier")).first().asDict()
        row |= {"cost": s.cost, "outliers_cost": s.outliers_cost, "detected_outliers": both.where("is_outlier").count(), "num_centers": len(s.centres), "elapsed_ms": s.elapsed_ms, "algo_codename": s.codename, "algo_fullname": s.fullname, "extra": s.extra}
        both.unpersist()
    except TimeoutError as e:
        row |= {"status": "timeout", "error": str(e), "time_s": time.time() - began}
    except Exception as e:  # a failing task is a record, the grid goes on
        row |= {"status": "error", "error": f"{e}\n{traceback.format_exc()}"}
    return row


def write_result(spark: SparkSession, row: dict, path: str) -> None:
    """Append one record to the result table."""
    spark.createDataFrame([tuple(row.get(f.name) for f in src.RESULT)], src.RESULT).coalesce(1).write.mode("append").json(path)


def run_grid(spark: SparkSession, tasks: DataFrame, load, path: str, timeout: float | None = 300.0, workers: int = 1, start: int | None = None, end: int | None = None) -> DataFrame:
    """Run the tasks (task_id, dataset, algorithm[, c], seed) and append each record to `path` as it ends.

    load(dataset) -> (points, k).  Tasks whose record is there already are not run again, so a stopped grid
    goes on where it was.  `workers` tasks run side by side as Spark jobs of one session.  Returns all records.
    """
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    done = {r["task_id"] for r in spark.read.schema(src.RESULT).json(path).select("task_id").collect()} if there else set()
    todo = [r.asDict() for r in sliced(tasks, start, end).orderBy("task_id").collect() if r["task_id"] not in done]

    def one(task: dict) -> None:
        try:
            points, k = load(task["dataset"])
            if task.get("c") is not None:
                solver, name, value = swept(task["algorithm"], task["c"], task["seed"])
                task = task | {"param_name": name, "param_value": float(value)}
            else:
                solver = preset(task["algorithm"], task["seed"])
            row = run_task(points, solver, k, task, timeout)
        except Exception as e:  # a set that does not load is a record too
            row = task | {"status": "error", "error": str(e)}
        write_result(spark, row, path)

    with ThreadPoolExecutor(max(1, workers)) as pool:
        list(pool.map(one, todo))
    return spark.read.schema(src.RESULT).json(path)


def summary(results: DataFrame, wall_s: float) -> str:
    counts = "\n".join(f"  {r['status']}: {r['n']}" for r in report.status_counts(results).orderBy("status").collect())
    p = report.effective_parallelism(results, wall_s).first()
    return f"Total: {p['tasks']}, time: {wall_s:.2f} s\n{counts}\nEffective parallelism: {p['parallelism']:.1f}\n"


def main(args: list[str] | None = None) -> None:
    """Run the grid (or the sweep over c) on prepared sets and write records, CSV and report."""
    own = argparse.ArgumentParser(description="Run a benchmark grid.")
    own.add_argument("--data-dir", required=True)
    own.add_argument("--output", required=True)
    own.add_argument("--datasets", nargs="*")
    own.add_argument("--algorithms", nargs="*")
    own.add_argument("--seeds", type=int, default=SEEDS)
    own.add_argument("--timeout", type=float, default=300.0)
    own.add_argument("--workers", type=int, default=1)
    own.add_argument("--start", type=int)
    own.add_argument("--end", type=int)
    own.add_argument("--sweep", action="store_true")
    a = own.parse_args(args)
    known = {p[0] for p in PRESETS} if not a.sweep else set(SWEPT)
    if bad := set(a.algorithms or []) - known:
        own.error(f"unknown algorithms: {sorted(bad)}")
    spark = SparkSession.builder.getOrCreate()
    held = datasets.Registry(spark, a.data_dir, {d[0]: d[1] for d in DATASETS})
    names = held.preload(a.datasets or [d[0] for d in DATASETS])
    if not names:
        own.error("no data set is there")
    tasks = task_grid(spark, names, a.algorithms or (SWEPT if a.sweep else None), a.seeds, FACTORS if a.sweep else None)
    began = time.time()
    results = run_grid(spark, tasks, held.get, f"{a.output}/results", a.timeout, a.workers, a.start, a.end)
    print(summary(results, time.time() - began))
    analyse(spark, a.output, a.sweep)
    held.close()


def analyse(spark: SparkSession, folder: str, sweep: bool = False) -> None:
    """CSV of the records in `folder`, and for the grid the fixed-width table and the report."""
    results = spark.read.schema(src.RESULT).json(f"{folder}/results")
    if sweep:
        report.write_csv(report.sweep_rows(report.cube(results, "dataset", "algorithm", "c", param=True)), f"{folder}/sensitivity.csv")
        return
    pairs = report.dense_pairs(spark)
    stats = report.statistics(results, pairs)
    report.write_csv(report.csv_rows(stats), f"{folder}/results.csv")
    text = [(report.table_text(stats), "table.txt"), (report.markdown(results, pairs, system_info(spark)), "report.md")]
    for body, name in text:
        spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{name}")


if __name__ == "__main__":
    main()
