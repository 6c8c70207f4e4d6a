"""Co-changes: commits are dealt by a count of lines, odd rows count as in SQL."""

from __future__ import annotations

from datetime import datetime

import duckdb

from quarry.operators import navigator

DATA = "/root/testdata/sf0.001"


def test_tasks_grow_with_the_lines(spark, monkeypatch):
    """Commits of ``LINES`` lines make a task, whatever their bytes: adaptive execution leaves a number that is asked for as it is."""
    monkeypatch.setattr(navigator, "LINES", 500)
    plan = navigator.cochange_top500(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    assert sum("RepartitionByExpression [hash" in x and f"], {-(-lines // 500)}" in x for x in plan.splitlines()) == 2


def test_baskets_equal_the_sql_on_odd_rows(spark, tmp_path, monkeypatch):
    """Repeated lines, null files and dates, baskets of one, eight, nine and many files."""
    monkeypatch.setattr(navigator, "LINES", 50)
    files = {1: [1], 2: [1, 2], 3: [2, 1, 2, 1], 4: [None, 1], 5: [None, 1, 2], 6: range(1, 9), 7: range(1, 10), 8: [None, *range(1, 9)], 9: [*range(300)], 10: [1] * 20 + [2], 11: [3, 4], 12: [3, 4], 13: [5, 6], None: [5, 6]}
    lines = [(h, f) for h, fs in files.items() for f in fs]
    orders = [(h, None if h == 11 else datetime(2024, 1, 1 + (h or 0) % 7), "Merge 1" if h == 13 else "1-URGENT") for h in files]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long").repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame(orders, "o_orderkey long, o_orderdate timestamp_ntz, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    con = duckdb.connect()
    for t in ("lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = [tuple(r) for r in navigator.cochange_top500(spark, str(tmp_path)).select("a", "b", "n", "sample").collect()]
    assert got == con.execute(navigator.REGISTRY.sql["cochange_top500"]).fetchall()
