"""Preparation: z-scores, injected outliers, classes as outliers, label codes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import uniform
from .select import edge, ranked


def zscore(points: DataFrame) -> DataFrame:
    """Each coordinate minus its mean over its population deviation (0 counts as 1)."""
    d = points.select(F.size("x")).first()[0]
    s = points.agg(*[f for j in range(d) for f in (F.avg(F.col("x")[j]).alias(f"m{j}"), F.stddev_pop(F.col("x")[j]).alias(f"s{j}"))])
    cols = [(F.col("x")[j] - F.col(f"m{j}")) / F.when(F.col(f"s{j}") == 0, 1.0).otherwise(F.col(f"s{j}")) for j in range(d)]
    return points.crossJoin(F.broadcast(s)).select(*[c for c in points.columns if c != "x"], F.array(*cols).alias("x"))  # one row


def inject(points: DataFrame, share: float = 0.01, xi: float = 5.0, seed: int = 42) -> DataFrame:
    """Appends int(n * share) hash-uniform points of [-xi, xi]^d with label -1."""
    n, last, d = points.agg(F.count("*"), F.max("id"), F.max(F.size("x"))).first()
    new = points.sparkSession.range(int((n or 0) * share)).select((F.col("id") + 1 + (last or 0)).alias("id"))
    x = F.array(*[uniform(seed, f"x{j}") * (2 * xi) - xi for j in range(d or 0)])
    new = new.select("id", x.alias("x"), F.lit("-1").alias("label"), F.lit(True).alias("is_outlier"))
    return points.select("id", "x", F.col("label").cast("string").alias("label"), F.lit(False).alias("is_outlier")).unionByName(new)


def class_sizes(points: DataFrame) -> DataFrame:
    """(label, n)."""
    return points.groupBy("label").agg(F.count("*").alias("n"))


def classes_as_outliers(points: DataFrame, smallest: int | None = None, all_but_largest: int | None = None) -> DataFrame:
    """is_outlier: of one of the `smallest` classes, or of none of the largest; ties by label.

    Only the classes at that end come together, by a partial top-m, however many there are.
    """
    m, order = (smallest, ["n", "label"]) if smallest is not None else (all_but_largest, [F.desc("n"), "label"])
    few = [r["label"] for r in class_sizes(points).orderBy(*order).limit(m).collect()]
    among = F.col("label").isin([x for x in few if x is not None]) | (F.col("label").isNull() if None in few else F.lit(False))
    among = F.coalesce(among, F.lit(False))
    return points.withColumn("is_outlier", among if smallest is not None else ~among)


def label_codes(points: DataFrame) -> DataFrame:
    """code: place of the label among the distinct labels."""
    codes = ranked(points.select("label").distinct(), ["label"], "code").withColumn("code", F.col("code").cast("int"))
    return points.join(codes, "label")


def first_rows(points: DataFrame, m: int) -> DataFrame:
    """The m rows of smallest id, by an exact threshold."""
    last = edge(points.select((-F.col("id")).cast("double").alias("v"), "id"), m, "v")
    return points.where(F.col("id") <= last[1]) if m > 0 and last else points.limit(0)


def by_ids(points: DataFrame, ids: DataFrame) -> DataFrame:
    """The points whose id is in `ids`."""
    return points.join(ids.select("id").distinct(), "id", "left_semi")


def numbered(points: DataFrame, order: list[str]) -> DataFrame:
    """id: place in the order of columns that tell all rows apart."""
    return ranked(points, order, "id")


def prepared(raw: DataFrame, xi: float | None = None, smallest: int | None = None, all_but_largest: int | None = None, share: float = 0.01, seed: int = 42) -> DataFrame:
    """A points table (id, x, label, is_outlier) from raw rows (id, x, label): z-scores, then outliers.

    Outliers are `share` injected points of [-xi, xi]^d, or the rows of the smallest (or all but the largest) classes.
    """
    z = zscore(raw)
    if xi is not None:
        return inject(z, share, xi, seed)
    return classes_as_outliers(z, smallest, all_but_largest).select("id", "x", F.col("label").cast("string").alias("label"), "is_outlier")
