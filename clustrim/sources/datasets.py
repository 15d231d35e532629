"""Raw data sets to points tables: the four preparation pipelines, and a registry of prepared tables."""

from __future__ import annotations

import argparse
import warnings
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prep
from . import points as src

META = "name string, n long, dim int, k int, z long, label_names array<string>"


def with_positions(raw: DataFrame) -> DataFrame:
    """id: the row's place in its files."""
    return prep.ranked(raw.withColumn("place", F.monotonically_increasing_id()), ["place"], "id").drop("place")


def skin(spark: SparkSession, path: str, xi: float) -> DataFrame:
    return prep.prepared(with_positions(src.read_spaced(spark, path)), xi=xi)


def susy(spark: SparkSession, path: str, xi: float, width: int | None = None) -> DataFrame:
    """The width follows the first line unless it is given; every line must have it."""
    width = width or len(spark.read.text(path).first()["value"].split(","))
    return prep.prepared(with_positions(src.read_csv(spark, path, width)), xi=xi)


def shuttle(spark: SparkSession, path: str) -> DataFrame:
    return prep.prepared(with_positions(src.read_spaced(spark, path)), smallest=2)


def kddfull(spark: SparkSession, path: str) -> DataFrame:
    return prep.prepared(with_positions(src.read_connections(spark, path)), all_but_largest=3)


#: Raw set -> prepared sets, each with its pipeline and k.
PIPELINES = {
    "skin": {"SKIN-5": (lambda s, p: skin(s, p, 5.0), 10), "SKIN-10": (lambda s, p: skin(s, p, 10.0), 10)},
    "susy": {"SUSY-5": (lambda s, p: susy(s, p, 5.0), 10), "SUSY-10": (lambda s, p: susy(s, p, 10.0), 10)},
    "shuttle": {"SHUTTLE": (shuttle, 10)},
    "kddfull": {"KDDFULL": (kddfull, 3)},
}
#: File names of the raw sets.
FILES = {"skin": "Skin_NonSkin.txt", "susy": "SUSY.csv.gz", "shuttle": "shuttle.trn", "kddfull": "kddcup.data.gz"}


def meta_of(points: DataFrame, name: str, k: int) -> tuple:
    """One row of META; label names where labels are not numbers."""
    n, dim, z = points.agg(F.count("*"), F.max(F.size("x")), F.count_if("is_outlier")).first()
    named = points.where(F.col("label").isNotNull() & F.col("label").try_cast("int").isNull())
    names = None if named.isEmpty() else [r["label"] for r in prep.class_sizes(points).orderBy("label").limit(1000).collect()]
    return name, n, dim or 0, k, z, names


def prepare(spark: SparkSession, data_dir: str, out_dir: str, names: list[str] | None = None) -> DataFrame:
    """Write the points and META of every prepared set of `names` (raw sets); returns META."""
    rows = []
    for raw in names or list(PIPELINES):
        for name, (make, k) in PIPELINES[raw].items():
            src.write_points(make(spark, f"{data_dir}/{FILES[raw]}"), f"{out_dir}/{name}/points")
            rows.append(meta_of(src.read_points(spark, f"{out_dir}/{name}/points"), name, k))
            spark.createDataFrame(rows[-1:], META).coalesce(1).write.mode("overwrite").json(f"{out_dir}/{name}/meta")
    return spark.createDataFrame(rows, META)


@dataclass
class Registry:
    """Prepared sets by name, each read once and cached; k comes from the set's own META, else from `default_k`."""

    spark: SparkSession
    root: str
    default_k: dict[str, int] = field(default_factory=dict)
    held: dict[str, tuple[DataFrame, int]] = field(default_factory=dict)

    def get(self, name: str) -> tuple[DataFrame, int]:
        if name not in self.held:
            meta = self.spark.read.schema(META).json(f"{self.root}/{name}/meta").first()
            k = meta["k"] if meta is not None and meta["k"] is not None else self.default_k[name]
            self.held[name] = src.read_points(self.spark, f"{self.root}/{name}/points").persist(), k
        return self.held[name]

    def preload(self, names: list[str]) -> list[str]:
        """The names that are there; the others get a warning."""
        found = []
        for name in names:
            try:
                self.get(name)[0].count()
                found.append(name)
            except Exception as e:  # a missing set is reported, the others load
                warnings.warn(f"data set {name} is missing: {e}".split("\n")[0], stacklevel=2)
        return found

    def close(self) -> None:
        for points, _ in self.held.values():
            points.unpersist()
        self.held.clear()


def main(args: list[str] | None = None) -> DataFrame:
    own = argparse.ArgumentParser(description="Prepare raw data sets.")
    own.add_argument("--data-dir", required=True)
    own.add_argument("--output-dir", required=True)
    own.add_argument("--datasets", nargs="*", choices=list(PIPELINES))
    a = own.parse_args(args)
    out = prepare(SparkSession.builder.getOrCreate(), a.data_dir, a.output_dir, a.datasets)
    out.show(truncate=False)
    return out


if __name__ == "__main__":
    main()
