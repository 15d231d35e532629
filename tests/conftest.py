import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = SparkSession.builder.master("local[8]").appName("tests").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def same():
    """same(name, sf_dir): the query's rows against its SQL in DuckDB."""
    import glob

    import duckdb

    import __spark_entry__ as entry

    def canon(df):
        def cell(v):
            if v is None:
                return "~"
            if isinstance(v, float):
                return "~" if v != v else f"{v:.6g}"
            return str(v)

        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple(cell(v) for v in row) for row in df.itertuples(index=False))

    def check(spark, name, sf_dir):
        con = duckdb.connect()
        for p in glob.glob(f"{sf_dir}/*.parquet"):
            table = os.path.basename(p)[: -len(".parquet")]
            con.sql(f"create view {table} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
        got, want = entry.queries()[name](spark, sf_dir).toPandas(), con.sql(entry.oracle_sql()[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert canon(got) == canon(want)

    return check
