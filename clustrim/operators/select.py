"""Exact order statistics without a sort of the table: thresholds of top-z, ranks over many keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import Scratch

#: Up to so many rows are ordered directly, in one task; more are found by histograms.
DIRECT = 20_000
BINS = 4096


def _narrowed(df: DataFrame, by: str, place: int, down: bool) -> tuple[DataFrame, float, float, int]:
    """Rows around the `place`-th (from 1) value of `by`: their least and largest value, its place among them.

    Each pass counts BINS bins between the ends that are left and keeps the bin that holds the place, until it
    has DIRECT rows at most or one value only.
    """
    n, lo, hi = df.agg(F.count(by), F.min(by), F.max(by)).first()
    while n > DIRECT and lo < hi:
        share = (F.col(by) - F.lit(lo)) / (F.lit(hi) - F.lit(lo))
        bins = df.groupBy(F.least(F.floor(share * BINS), F.lit(BINS - 1)).alias("b")).agg(F.count("*").alias("n"), F.min(by).alias("lo"), F.max(by).alias("hi")).collect()
        for r in sorted(bins, key=lambda r: r["b"], reverse=down):
            if place <= r["n"]:
                break
            place -= r["n"]
        n, lo, hi = r["n"], r["lo"], r["hi"]
        df = df.where(F.col(by).between(lo, hi))
    return df, lo, hi, place


def edge(df: DataFrame, z: int, by: str = "d2", key: str = "id") -> tuple[float, int] | None:
    """(value, key) of the z-th row in the order of `by` descending, `key` ascending; of the last if there are fewer; None without rows.

    `by` is a double, `key` a long.
    """
    df = df.select(F.col(by).cast("double").alias(by), F.col(key).cast("long").alias(key))
    if z > DIRECT:
        df, lo, hi, place = _narrowed(df, by, min(z, df.count()), True)
        if lo == hi:  # as many equal values as there may be: the place is one of keys
            df, _, _, place = _narrowed(df, key, place, False)
        z = place
    rows = df.orderBy(F.desc(by), key).limit(z).agg(F.max(F.struct((-F.col(by)).alias("v"), key)).alias("e")).first()["e"]
    return None if rows is None else (-rows["v"], rows[key])


def among_top(value: tuple[float, int] | None, by: str = "d2", key: str = "id") -> Column:
    """Whether a row stands at `value` (from `edge`) or before it."""
    if value is None:
        return F.lit(False)
    v = F.lit(float(value[0]))
    return (F.col(by) > v) | ((F.col(by) == v) & (F.col(key) <= F.lit(value[1])))


def threshold(df: DataFrame, z: int, by: str = "d2") -> float:
    """The z-th largest value of `by`."""
    df = df.select(F.col(by).cast("double").alias(by))
    if z > DIRECT:
        df, lo, hi, z = _narrowed(df, by, min(z, df.count()), True)
        if lo == hi:
            return lo
    return df.orderBy(F.desc(by)).limit(z).agg(F.min(by)).first()[0]


def ranked(df: DataFrame, by: list[str], name: str = "rank") -> DataFrame:
    """`df`, whose rows differ in `by`, with their rank (from 0) in that order.

    A range sort numbers the rows of each partition; only one row a partition meets in one task.
    """
    df = Scratch(df.sparkSession).write(df.repartitionByRange(*by).withColumn("pid", F.spark_partition_id()), "ranked")
    sizes = df.groupBy("pid").count().withColumn("before", F.sum("count").over(Window.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("pid").orderBy(*by)) - 1
    return df.withColumn("own", own).join(sizes.select("pid", F.coalesce("before", F.lit(0)).alias("before")), "pid").withColumn(name, F.col("own") + F.col("before")).drop("pid", "own", "before")
