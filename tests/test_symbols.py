"""References across languages are counted without pairs; the symbol budget cuts files before it makes symbols."""

from __future__ import annotations

import duckdb

from quarry.operators import symbols


def test_pairs_are_made_once(spark):
    plan = symbols.cross_language_refs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join" in x and "NOT (family" in x for x in plan.splitlines()) == 1


def test_symbol_budget_makes_symbols_of_the_first_files_only(spark, tmp_path):
    """Files without a symbol, long texts, equal rows, null texts, sources and languages; results as in SQL, and words are made after the limit of files."""
    letters = "abcdefghij"
    many = lambda n, w="": " ".join(f"word{w}{letters[i // 10]}{letters[i % 10]}" for i in range(n))
    docs = [(i, many(i % 60, letters[i % 10]) + " 12 abc " + many(40), letters[i % 3], f"s{i % 7}") for i in range(60)]
    docs += [(100 + i, "1 2 ab", "a", "a") for i in range(30)] + [(200, None, "a", "a"), (201, "", "a", "a"), (202, many(30), "a", "a"), (202, many(30), "a", "a"), (203, "once Once once upon", "a", "a")]
    docs += [(300, "alpha beta gamma", None, "a"), (301, "delta", "a", None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    df = symbols.symbol_budget(spark, str(tmp_path))
    assert sorted(map(tuple, df.select("path", "name", "n").collect()), key=lambda r: r[2]) == con.execute(symbols.REGISTRY.sql["symbol_budget"] + " ORDER BY n").fetchall()
    few = docs[60:95] + [(300, "alpha beta gamma", None, "a"), (301, "x", "a", None)]
    spark.createDataFrame(few, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/few/documents.parquet")
    con.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/few/documents.parquet/*.parquet')")
    got = symbols.symbol_budget(spark, f"{tmp_path}/few").select("path", "name", "n").collect()
    assert len(got) == 31 and sorted(map(tuple, got), key=lambda r: r[2]) == con.execute(symbols.REGISTRY.sql["symbol_budget"] + " ORDER BY n").fetchall()
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan[plan.index("LeftSemi") :]
