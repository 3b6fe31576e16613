import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def comparable(rows, names):
    def one(x):
        if isinstance(x, float):
            return "inf" if math.isinf(x) else round(x, 5) + 0.0
        return x

    return sorted((tuple(one(r[names.index(n)]) for n in sorted(names)) for r in rows), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", [n for n in entry.TOPOLOGY if n in entry.TOPOLOGY_SQL])
def test_equals_sql(spark, duck, name):
    df = entry.TOPOLOGY[name](spark, SF)
    own = duck.sql(entry.TOPOLOGY_SQL[name])
    assert sorted(df.columns) == sorted(own.columns)
    assert comparable([tuple(r) for r in df.collect()], df.columns) == comparable(own.fetchall(), own.columns)


@pytest.mark.parametrize("name", [n for n in entry.TOPOLOGY if n not in entry.TOPOLOGY_SQL])
def test_runs(spark, name):
    assert entry.TOPOLOGY[name](spark, SF).count() > 0


def test_classes_of_dimension_2(spark):
    assert entry.TOPOLOGY["h2_pairs_axes"](spark, SF).where("death > birth + 0.1").count() == 3
