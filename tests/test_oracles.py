"""Every registered query with SQL gives DuckDB's rows, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from evidentia.plans import catalogue

DATA = Path("/root/testdata/sf0.001")


def plain(value):
    value = value.tolist() if hasattr(value, "tolist") else value
    return "None" if value is None else repr(value)


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_natural_sort_of_the_whole_table(spark):
    found = catalogue.QUERIES["natural_sort_whole"](spark, str(DATA))
    plan = found._jdf.queryExecution().executedPlan().toString()
    n = spark.read.parquet(f"{DATA}/part.parquet").count()
    assert sorted(r.position for r in found.select("position").collect()) == list(range(1, n + 1))
    assert all("__range" in line or "windowspecdefinition(" not in line for line in plan.splitlines())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_normalised_vectors_are_whole(spark):
    vecs = spark.read.parquet(f"{DATA}/embeddings.parquet")
    found = catalogue.QUERIES["l2_normalised_whole"](spark, str(DATA))
    assert found.count() == sum(len(r.embedding) for r in vecs.collect())
    assert all(abs(r.s - 1) < 1e-4 for r in found.selectExpr("vec_id", "value * value as x").groupBy("vec_id").sum("x").withColumnRenamed("sum(x)", "s").collect())


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query(spark, name):
    con = duckdb.connect()
    for file in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    found = catalogue.QUERIES[name](spark, str(DATA))
    result = con.execute(catalogue.SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    want = sorted(tuple(map(plain, row)) for row in result.fetchall())
    assert sorted(tuple(map(plain, row)) for row in found.select(*columns).collect()) == want
