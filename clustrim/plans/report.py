"""Statistics over result rows: the cube, best runs, status, ranks, marks, tables, figures' data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FIELDS = ["cost", "recall", "precision", "f1", "ari", "nmi", "time_s"]
#: The first of these that a pair shows is its status.
PRIORITY = [("timeout", "timeout"), ("skipped_timeout", "skipped"), ("error", "error")]
#: Display order; names that are not in it are not shown.
DATASET_ORDER = ["SKIN-5", "SKIN-10", "SHUTTLE", "SUSY-5", "SUSY-10", "KDDFULL"]
ALGORITHM_ORDER = ["TIKMeans", "IKMeans", "RobustKmeans++", "NKMeans", "OKMeans", "OKMeans2", "OKMeansFAISS", "OKMeans2FAISS", "KMeans++", "KMeans--"]


def cube(results: DataFrame, *keys: str, param: bool = False) -> DataFrame:
    """Means and population deviations of the completed runs; NaN and null do not count."""
    clean = lambda c: F.when(~F.isnan(c), F.col(c))
    aggs = [f for c in FIELDS for f in (F.round(F.avg(clean(c)), 6).alias(f"{c}_mean"), F.round(F.stddev_pop(clean(c)), 6).alias(f"{c}_std"))]
    if param:
        aggs.append(F.round(F.avg(clean("param_value")), 6).alias("param_value"))
    return results.where("status = 'completed'").groupBy(*keys).agg(F.count("*").alias("n_runs"), *aggs)


def best_run(results: DataFrame) -> DataFrame:
    best = results.where("status = 'completed'").groupBy("dataset", "algorithm").agg(F.min_by(F.struct("task_id", "cost", "recall", "time_s"), F.struct("cost", "task_id")).alias("b"))
    return best.select("dataset", "algorithm", "b.*")


def status_of(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """One status for each (dataset, algorithm) of the dense grid `pairs`."""
    got = results.groupBy("dataset", "algorithm").agg(F.bool_or(F.col("status") == "completed").alias("done"), *[F.bool_or(F.col("status") == s).alias(s) for s, _ in PRIORITY], F.min_by("status", "task_id").alias("first"))
    out = F.coalesce("first", F.lit("not_run"))
    for s, name in reversed(PRIORITY):
        out = F.when(F.col(s), name).otherwise(out)
    out = F.when(F.col("done"), "completed").otherwise(out)
    return pairs.join(got, ["dataset", "algorithm"], "left").select("dataset", "algorithm", out.alias("status"))


def dense_pairs(spark, datasets=None, algorithms=None) -> DataFrame:
    """Every data set with every algorithm: two fixed lists of names."""
    d = spark.createDataFrame([(x,) for x in datasets or DATASET_ORDER], "dataset string").coalesce(1)
    return d.crossJoin(spark.createDataFrame([(x,) for x in algorithms or ALGORITHM_ORDER], "algorithm string").coalesce(1))


def statistics(results: DataFrame, pairs: DataFrame) -> DataFrame:
    """The cube, the best run and the status of every pair; nulls where no run completed."""
    best = best_run(results).select("dataset", "algorithm", F.col("cost").alias("best_cost"), F.col("recall").alias("best_cost_recall"), F.col("time_s").alias("best_cost_time"))
    out = status_of(results, pairs).join(cube(results, "dataset", "algorithm"), ["dataset", "algorithm"], "left").join(best, ["dataset", "algorithm"], "left")
    return out.na.fill(0, ["n_runs"])


def placed(names: list[str], column: str) -> Column:
    """Place of a name in a fixed order, null for others."""
    at = F.array_position(F.array(*[F.lit(n) for n in names]), F.col(column))
    return F.when(at > 0, at)


def displayed(stats: DataFrame, datasets=None, algorithms=None) -> DataFrame:
    """dataset_place, algorithm_place and the rows that have both."""
    out = stats.withColumn("dataset_place", placed(datasets or DATASET_ORDER, "dataset")).withColumn("algorithm_place", placed(algorithms or ALGORITHM_ORDER, "algorithm"))
    return out.where("dataset_place is not null and algorithm_place is not null")


def average_ranks(stats: DataFrame, algorithms=None) -> DataFrame:
    """Mean over data sets of each algorithm's place by cost, recall and time; ties by display order."""
    tie = placed(algorithms or ALGORITHM_ORDER, "algorithm")
    place = lambda c, down: F.row_number().over(Window.partitionBy("dataset").orderBy(F.desc(c) if down else F.col(c), "tie"))
    r = stats.withColumn("tie", tie).where("tie is not null and n_runs > 0")
    r = r.select("algorithm", place("cost_mean", False).alias("a"), place("recall_mean", True).alias("b"), place("time_s_mean", False).alias("c"))
    return r.groupBy("algorithm").agg(F.round(F.avg("a"), 6).alias("cost_rank"), F.round(F.avg("b"), 6).alias("recall_rank"), F.round(F.avg("c"), 6).alias("time_rank"))


def near_best(stats: DataFrame) -> DataFrame:
    w = Window.partitionBy("dataset")
    return stats.select(
        "dataset",
        "algorithm",
        (F.col("cost_mean") <= F.min("cost_mean").over(w) * 1.01).alias("cost_best"),
        (F.col("recall_mean") >= F.max("recall_mean").over(w) - 0.01).alias("recall_best"),
        (F.col("time_s_mean") <= F.min("time_s_mean").over(w) * 1.1).alias("time_best"),
    )


def best_of(stats: DataFrame, algorithms=None) -> DataFrame:
    """The best algorithm of each data set by cost, by recall and by time; ties by display order."""
    r = stats.withColumn("tie", placed(algorithms or ALGORITHM_ORDER, "algorithm")).where("n_runs > 0 and tie is not null")
    first = lambda c, sign: F.min_by("algorithm", F.struct((F.col(c) * sign).alias("v"), "tie"))
    return r.groupBy("dataset").agg(first("cost_mean", 1).alias("best_cost"), first("recall_mean", -1).alias("best_recall"), first("time_s_mean", 1).alias("best_time"))


def relative_cost(stats: DataFrame) -> DataFrame:
    """stats by dataset, algorithm, c: cost over the data set's least, mean and deviation by (algorithm, c)."""
    r = stats.withColumn("r", F.col("cost_mean") / F.min("cost_mean").over(Window.partitionBy("dataset")))
    return r.groupBy("algorithm", "c").agg(F.round(F.avg("r"), 6).alias("relative_mean"), F.round(F.stddev_pop("r"), 6).alias("relative_std"))


def scalability(results: DataFrame) -> DataFrame:
    return results.where("status = 'completed'").groupBy("algorithm", "dataset_size").agg(F.round(F.avg("time_s"), 6).alias("time_mean"), F.round(F.stddev_pop("time_s"), 6).alias("time_std"))


def pareto(stats: DataFrame) -> DataFrame:
    """Time and recall of each pair, and whether no other pair of its data set is as fast with more recall or faster with as much."""
    order = Window.partitionBy("dataset").orderBy("time_s_mean", F.desc("recall_mean"))
    before = F.max("recall_mean").over(order.rowsBetween(Window.unboundedPreceding, -1))
    same = F.max("recall_mean").over(Window.partitionBy("dataset", "time_s_mean"))
    earlier = F.max("recall_mean").over(Window.partitionBy("dataset").orderBy("time_s_mean").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    front = (F.col("recall_mean") == same) & (F.col("recall_mean") >= earlier) & (before.isNull() | (F.col("recall_mean") > before) | ((F.col("recall_mean") == before) & (F.min("time_s_mean").over(Window.partitionBy("dataset", "recall_mean")) == F.col("time_s_mean"))))
    return stats.where("n_runs > 0").select("dataset", "algorithm", "time_s_mean", "recall_mean", front.alias("on_front"))


def metric_bars(stats: DataFrame, metric: str) -> DataFrame:
    """Data of a comparison figure: mean and deviation of one metric for each pair shown."""
    return displayed(stats.where("n_runs > 0")).select("dataset", "algorithm", F.col(f"{metric}_mean").alias("mean"), F.col(f"{metric}_std").alias("std"))


def metric_curves(stats: DataFrame, metric: str) -> DataFrame:
    """Data of a sensitivity figure: mean and deviation of one metric over c."""
    return stats.select("dataset", "algorithm", "c", F.col(f"{metric}_mean").alias("mean"), F.col(f"{metric}_std").alias("std"))


def status_counts(results: DataFrame) -> DataFrame:
    return results.groupBy("status").agg(F.count("*").alias("n"))


def effective_parallelism(results: DataFrame, wall_s: float) -> DataFrame:
    """One row: tasks, their summed seconds, and that sum over the wall time."""
    total = F.coalesce(F.sum(F.when(~F.isnan("time_s"), F.col("time_s"))), F.lit(0.0))
    return results.agg(F.count("*").alias("tasks"), F.round(total, 6).alias("task_s"), F.round(total / F.lit(float(wall_s)), 6).alias("parallelism"))


# --- text -------------------------------------------------------------------------------------


def as_text(c: str, digits: int = 2, scientific: bool = False) -> Column:
    """NA, with `scientific` so above 10,000, else fixed digits."""
    v = F.col(c)
    out = F.when(v.isNull() | F.isnan(v), "NA")
    if scientific:
        out = out.when(v > 10000, F.format_string("%.2e", v))
    return out.otherwise(F.format_string(f"%.{digits}f", v))


def with_deviation(c: str, digits: int = 2) -> Column:
    m, s = F.col(f"{c}_mean"), F.col(f"{c}_std")
    form = lambda f: F.concat(F.format_string(f, m), F.lit(" ± "), F.format_string(f, s))
    return F.when(m.isNull() | F.isnan(m), "NA").when(m > 10000, form("%.2e")).otherwise(form(f"%.{digits}f"))


def indicator() -> Column:
    """Mark of a status beside a name; nothing for completed pairs."""
    return F.when(F.col("status") == "completed", "").otherwise(F.concat(F.lit(" ["), F.upper("status"), F.lit("]")))


#: Columns of the two CSV files, in their order.
_SPREAD = [f"{m}_{x}" for m in ("cost", "recall", "precision", "f1", "ari", "nmi", "time") for x in ("mean", "std")]
CSV_COLUMNS = ["dataset", "algorithm", *_SPREAD, "best_cost", "best_cost_recall", "best_cost_time", "n_runs", "status"]
SWEEP_COLUMNS = ["dataset", "algorithm", "c", "param_value", *_SPREAD, "n_runs"]


def _cells(df: DataFrame, columns: list[str]) -> list[Column]:
    source = {f"time_{x}": f"time_s_{x}" for x in ("mean", "std")}
    kinds = dict(df.dtypes)
    cell = lambda c: F.col(c) if kinds[c] != "double" else F.when(~F.isnan(c), F.col(c))
    return [F.coalesce(cell(source.get(c, c)).cast("string"), F.lit("NA")).alias(c) for c in columns]


def csv_rows(stats: DataFrame) -> DataFrame:
    """The benchmark CSV as text columns in their fixed order, rows in display order."""
    return displayed(stats).orderBy("dataset_place", "algorithm_place").select(*_cells(stats, CSV_COLUMNS))


def sweep_rows(stats: DataFrame) -> DataFrame:
    """The sensitivity CSV, rows by data set, algorithm and c."""
    return stats.orderBy("dataset", "algorithm", "c").select(*_cells(stats, SWEEP_COLUMNS))


def write_csv(rows: DataFrame, path: str) -> None:
    """One file: rows of a report, at most a few for each pair."""
    rows.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def table_rows(stats: DataFrame) -> DataFrame:
    """Display rows as text: cost, recall and time with deviations, and the runs or the status."""
    state = F.when(F.col("status") == "completed", F.concat(F.lit("n="), F.col("n_runs").cast("string"))).otherwise(F.upper("status"))
    return displayed(stats).select("dataset_place", "algorithm_place", "dataset", "algorithm", with_deviation("cost").alias("cost"), with_deviation("recall", 4).alias("recall"), with_deviation("time_s").alias("time"), state.alias("state"), (F.col("algorithm_place") == F.min("algorithm_place").over(Window.partitionBy("dataset"))).alias("leads"))


def table_text(stats: DataFrame) -> str:
    """A table of fixed width."""
    rule, lines = "-" * 104, [f"{'Dataset':<15} {'Method':<18} {'Cost':>26} {'Recall':>18} {'Time(s)':>18}  Status", "-" * 104]
    for r in table_rows(stats).orderBy("dataset_place", "algorithm_place").collect():
        if r["leads"] and len(lines) > 2:
            lines.append(rule)
        lines.append(f"{r['dataset'] if r['leads'] else '':<15} {r['algorithm']:<18} {r['cost']:>26} {r['recall']:>18} {r['time']:>18}  {r['state']}")
    return "\n".join([*lines, rule]) + "\n"


def marked_rows(stats: DataFrame) -> DataFrame:
    """table_rows with what is near the best of its data set in bold."""
    bold = lambda c, flag: F.when(F.col(flag), F.concat(F.lit("**"), F.col(c), F.lit("**"))).otherwise(F.col(c))
    done = near_best(stats.where("status = 'completed'"))
    got = table_rows(stats).join(done, ["dataset", "algorithm"], "left")
    return got.select("dataset_place", "algorithm_place", "dataset", "algorithm", bold("cost", "cost_best").alias("cost"), bold("recall", "recall_best").alias("recall"), bold("time", "time_best").alias("time"), "state")


def markdown(results: DataFrame, pairs: DataFrame, config: dict | None = None) -> str:
    """The report: configuration, counts by status, the marked table, best per data set, mean ranks."""
    stats = statistics(results, pairs).persist()
    lines = ["# Results", "", *[f"- {a}: {b}" for a, b in (config or {}).items()], "", "## Runs", ""]
    lines += [f"- {r['status']}: {r['n']}" for r in status_counts(results).orderBy("status").collect()]

    def table(title, head, rows):
        return ["", f"## {title}", "", *["| " + " | ".join(map(str, r)) + " |" for r in [head, ["---"] * len(head), *rows]]]

    marked = marked_rows(stats).orderBy("dataset_place", "algorithm_place").drop("dataset_place", "algorithm_place").collect()
    lines += table("Comparison", ["Dataset", "Algorithm", "Cost", "Recall", "Time (s)", "Status"], marked)
    lines += table("Best", ["Dataset", "Cost", "Recall", "Time"], best_of(stats).orderBy("dataset").collect())
    lines += table("Mean ranks", ["Algorithm", "Cost", "Recall", "Time"], average_ranks(stats).orderBy("cost_rank", "algorithm").collect())
    stats.unpersist()
    return "\n".join(lines) + "\n"
