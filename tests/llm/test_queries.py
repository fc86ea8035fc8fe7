"""Every pN_ query runs on the smallest tables with a stable schema; those with SQL agree with it."""

import os

import duckdb
import pytest

from sievemill.llm import queries, sql

COLUMNS = {"p1_found": {"technique_id": "string"}, "p2_found": {"finding_id_a": "string", "finding_id_b": "string"}, "p3_found": {"report_id_a": "bigint", "report_id_b": "bigint"}, "p4_found": {"mapping_id": "bigint", "defect_type": "string"}, "p5_found": {"pdf_path": "string", "batch_index": "int"}, "p6_ids": {"doc_id": "bigint", "ids": "array<int>"}, "p7_found": {"source": "string"}, "p8_found": {"doc_id": "bigint"}}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, sf_dir, name):
    made = queries.queries()[name](spark, sf_dir)
    if name in COLUMNS:
        assert dict(made.dtypes) == COLUMNS[name]
    rows = made.collect()
    if name in sql.oracle_sql():
        con = duckdb.connect()
        for f in os.listdir(sf_dir):
            con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{f}'")
        cursor = con.execute(sql.oracle_sql()[name])
        order = [[c[0] for c in cursor.description].index(c) for c in made.columns]
        assert sorted(tuple(r) for r in rows) == sorted(tuple(r[i] for i in order) for r in cursor.fetchall())
