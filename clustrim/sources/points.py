"""Point tables: explicit schemas, readers for raw text layouts, writers, and the built-in views.

A points table has id LONG, x ARRAY<DOUBLE>, label STRING (nullable), is_outlier BOOLEAN.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINTS = T.StructType([T.StructField("id", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("label", T.StringType()), T.StructField("is_outlier", T.BooleanType())])
#: Fields of a benchmark record, one record a task.
RESULT = T.StructType(
    [
        T.StructField("task_id", T.IntegerType()),
        T.StructField("dataset", T.StringType()),
        T.StructField("algorithm", T.StringType()),
        T.StructField("seed", T.IntegerType()),
        T.StructField("status", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("dataset_size", T.LongType()),
        T.StructField("dataset_dim", T.IntegerType()),
        T.StructField("true_outliers", T.LongType()),
        T.StructField("k", T.IntegerType()),
        T.StructField("cost", T.DoubleType()),
        T.StructField("outliers_cost", T.DoubleType()),
        T.StructField("time_s", T.DoubleType()),
        T.StructField("elapsed_ms", T.DoubleType()),
        T.StructField("recall", T.DoubleType()),
        T.StructField("precision", T.DoubleType()),
        T.StructField("f1", T.DoubleType()),
        T.StructField("ari", T.DoubleType()),
        T.StructField("nmi", T.DoubleType()),
        T.StructField("detected_outliers", T.LongType()),
        T.StructField("num_centers", T.IntegerType()),
        T.StructField("algo_codename", T.StringType()),
        T.StructField("algo_fullname", T.StringType()),
        T.StructField("extra", T.MapType(T.StringType(), T.StringType())),
        T.StructField("c", T.IntegerType()),
        T.StructField("param_name", T.StringType()),
        T.StructField("param_value", T.DoubleType()),
    ]
)
#: 37 numeric columns of the 42-column connection records; 1, 2, 3 are names, 41 the label.
NUMERIC_42 = [0, *range(4, 12), *range(12, 21), *range(22, 41)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embeddings(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("string").alias("label"))


def parts(spark, sf_dir) -> DataFrame:
    x = F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / F.lit(20.0))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), x.alias("x"), F.col("p_type").alias("label"))


def lines(spark, sf_dir) -> DataFrame:
    """No key: only for operators that need none."""
    x = F.array(F.col("l_quantity").cast("double"), F.col("l_extendedprice") / F.lit(1000.0), F.col("l_discount") * F.lit(100.0), F.col("l_tax") * F.lit(100.0))
    return table(spark, sf_dir, "lineitem").select(x.alias("x"), F.col("l_returnflag").alias("label"))


def read_spaced(spark, path: str, label_last: bool = True) -> DataFrame:
    """White-space separated numbers with an integer label; lines that are not numbers throughout are dropped."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where("trim(value) != ''").select(F.transform(cells, lambda c: c.try_cast("double")).alias("v")).where(~F.exists("v", lambda c: c.isNull()))
    n = F.size("v")
    if label_last:
        return rows.select(F.slice("v", 1, n - 1).alias("x"), F.element_at("v", -1).cast("int").cast("string").alias("label"))
    return rows.select(F.slice("v", 2, n - 1).alias("x"), F.element_at("v", 1).cast("int").cast("string").alias("label"))


def read_csv(spark, path: str, width: int) -> DataFrame:
    """Headerless CSV, the label first."""
    schema = ", ".join(f"c{j} DOUBLE" for j in range(width))
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").csv(path)
    return raw.select(F.array(*[f"c{j}" for j in range(1, width)]).alias("x"), F.col("c0").cast("int").cast("string").alias("label"))


def read_connections(spark, path: str) -> DataFrame:
    """42-column connection records: 37 numbers (what does not parse is 0), the label without its full stop."""
    cells = F.split("value", ",")
    rows = spark.read.text(path).select(cells.alias("v")).where(F.size("v") >= 42)
    number = lambda j: F.coalesce(F.col("v")[j].try_cast("double"), F.lit(0.0))
    return rows.select(F.array(*[number(j) for j in NUMERIC_42]).alias("x"), F.rtrim(F.col("v")[41], F.lit(".")).alias("label"))


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("overwrite").parquet(path)


def read_points(spark, path: str) -> DataFrame:
    return spark.read.schema(POINTS).parquet(path)


def read_results(spark, path: str) -> DataFrame:
    """Result files {system_info, experiment_config, results: [...]} as one row a task; NaN becomes null."""
    envelope = T.StructType([T.StructField("results", T.ArrayType(RESULT))])
    rows = spark.read.schema(envelope).option("multiLine", True).option("allowNonNumericNumbers", True).json(path).select(F.explode("results").alias("r")).select("r.*")
    return rows.select(*[F.nanvl(F.col(f.name), F.lit(None)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in RESULT])


def widths(points: DataFrame) -> DataFrame:
    """(dim, n): rows by number of coordinates; one row where the table is sound."""
    return points.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
