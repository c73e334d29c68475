import re

import duckdb
import pytest
from pyspark.sql import functions as F

from corvane import queries, queries_relational

SCHEMA = "l_returnflag string, l_orderkey long, l_extendedprice double"


def stored(spark, folder, rows) -> str:
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_sketches_are_not_grouped_by_the_keys_they_count(spark, tmp_path, monkeypatch):
    d = stored(spark, tmp_path, [("A", i, float(i)) for i in range(50)])
    monkeypatch.setattr(queries_relational, "materialise", lambda df, *a: df, raising=False)  # the whole plan is seen
    plan = queries.QUERIES["approximate_counts"](spark, d)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Aggregate\(keys=\[(.*?)\], functions=\[[^\n]*(?:approx_count_distinct|percentile_approx|approx_percentile)", plan)
    assert keys and not [k for k in keys if "l_orderkey" in k]


@pytest.mark.parametrize("rows", [
    [("A", 1, 10.0), ("A", 2, 1000.0)],  # medians from 10 to 1000
    [("A", 1, 0.0), ("A", 1, 0.0), ("R", 2, -5.0), (None, 3, 7.0), (None, 3, 9.0)],
    [("A", None, 5.0), ("R", 1, None), ("R", None, None), ("N", 4, 4.0)],  # no order, no price
    [("A", i // 3, float(i * i % 997)) for i in range(3000)],
    [],
])
def test_approximate_counts_on_odd_rows_are_as_in_sql(spark, tmp_path, rows):
    d = stored(spark, tmp_path, rows)
    got = [tuple(r) for r in queries.QUERIES["approximate_counts"](spark, d).collect()]
    db = duckdb.connect()
    db.sql(f"CREATE VIEW lineitem AS FROM '{d}/lineitem.parquet/*.parquet'")
    assert sorted(got, key=str) == sorted(db.sql(queries.SQL["approximate_counts"]).fetchall(), key=str)


def test_approximate_counts_see_bad_sketches(spark, tmp_path, monkeypatch):
    d = stored(spark, tmp_path, [("A", i // 3, float(i)) for i in range(3000)])
    with monkeypatch.context() as m:
        m.setattr(F, "approx_count_distinct", lambda c, *a: F.count(c))
        assert [r.close for r in queries.QUERIES["approximate_counts"](spark, d).collect()] == [False]
    monkeypatch.setattr(F, "percentile_approx", lambda c, *a: F.max(c))
    assert [r.close for r in queries.QUERIES["approximate_counts"](spark, d).collect()] == [False]
