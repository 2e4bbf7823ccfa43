"""The SQL of the operators gives their rows, on texts with nulls, empty, repeated and long ones."""

import duckdb
import pytest
from test_llm import _corpus

NAMES = ("op2_quality_rules", "op7_benchmark_decontamination", "op8_minhash_near_dedup", "op9_suffix_array_dedup", "op10_license_scan")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder, con = str(tmp_path_factory.mktemp("tables")), duckdb.connect()
    texts = [t and t.replace("\x00", " ") for t in _corpus(9, 80)]
    passage = "tall grass leans over the quiet water " * 14
    texts += ["before " + passage, passage + "after", "x\nLicensed under the Apache License, Version 2.0.\ny", "Released under the MIT License.", "p q r s t u v w x y z " * 20]
    items = [(k, t) for k, t in enumerate([texts[20], "w1 w2 w3", None, "tall grass leans over the quiet water tall grass leans", ""])]
    spark.createDataFrame([(i, t, "en", None if i % 7 == 0 else f"src{i % 3}", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return folder, con


@pytest.mark.parametrize("name", NAMES)
def test_sql_gives_the_same_rows(spark, tables, name):
    from nearfield.llm.queries import ORACLE_SQL, QUERIES

    folder, con = tables
    got, want = QUERIES[name](spark, folder), con.execute(ORACLE_SQL[name])
    columns = sorted(x[0] for x in want.description)
    at = [[x[0] for x in want.description].index(c) for c in columns]
    rows = sorted(tuple(str(r[c]) for c in columns) for r in got.select(*columns).collect())
    assert sorted(got.columns) == columns
    assert rows == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())
