"""Precision, recall, F1; adjusted Rand index; normalised mutual information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ratio


def outlier_scores(df: DataFrame, truth: str = "is_true", found: str = "is_outlier") -> DataFrame:
    """One row: precision, recall, f1; 0 on a zero denominator."""
    c = df.agg(F.count_if(F.col(truth) & F.col(found)).alias("tp"), F.count_if(~F.col(truth) & F.col(found)).alias("fp"), F.count_if(F.col(truth) & ~F.col(found)).alias("fn"))
    tp = F.col("tp")
    return c.select(ratio(tp, tp + F.col("fp")).alias("precision"), ratio(tp, tp + F.col("fn")).alias("recall"), ratio(2 * tp, 2 * tp + F.col("fp") + F.col("fn")).alias("f1"))


def agreement(df: DataFrame, a: str = "label", b: str = "cluster") -> DataFrame:
    """One row: ari, nmi of two labelings, from their contingency counts."""
    cells = df.groupBy(a, b).agg(F.count("*").cast("double").alias("n"))
    pairs = lambda c: F.sum(F.col(c) * (F.col(c) - 1) / 2)
    info = lambda c: F.sum(F.col(c) * F.ln(c))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n")).agg(pairs("n").alias("pa"), info("n").alias("ia"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n")).agg(pairs("n").alias("pb"), info("n").alias("ib"))
    both = cells.agg(pairs("n").alias("pab"), info("n").alias("iab"), F.sum("n").alias("t"))
    one = both.crossJoin(rows).crossJoin(cols)  # three one-row tables
    t = F.col("t")
    expected = F.col("pa") * F.col("pb") / (t * (t - 1) / 2)
    span = (F.col("pa") + F.col("pb")) / 2 - expected
    ha, hb = F.ln(t) - F.col("ia") / t, F.ln(t) - F.col("ib") / t
    mi = F.ln(t) + (F.col("iab") - F.col("ia") - F.col("ib")) / t
    nmi = F.when((ha.between(-1e-12, 1e-12)) & (hb.between(-1e-12, 1e-12)), 1.0).otherwise(F.greatest(mi, F.lit(0.0)) / ((ha + hb) / 2))
    return one.select(F.when(span == 0, 1.0).otherwise((F.col("pab") - expected) / span).alias("ari"), nmi.alias("nmi"))
