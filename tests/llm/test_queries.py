"""The registered queries over the smallest tables: against SQL where it can express them, else that they run whole."""

import os

import duckdb
import pytest

from lexmill.llm.queries import ORACLE_SQL, QUERIES
from tests.test_oracle import rows

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for table in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        said = con.execute(ORACLE_SQL[name])
        names = [c[0] for c in said.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(df.columns, [tuple(r) for r in got]) == rows(names, said.fetchall())
    n = spark.read.parquet(f"{SF}/{'pages' if 'url' in name else 'documents'}.parquet").count()
    if name in ("op1_license_scan", "op2_decontaminate", "op12_source_divergence", "op13_hard_negatives"):
        assert got
    elif name == "op4_best_fit_packing":
        assert len({r["doc_id"] for r in got}) == n
    else:
        assert len(got) == n
