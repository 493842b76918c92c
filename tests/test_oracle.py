"""Every registered query against its SQL in DuckDB, over the smallest tables; those of text search over larger ones, too."""

import math
import os

import duckdb
import pytest

from lexmill.catalog import ORACLE_SQL, QUERIES

SF = os.environ.get("ORACLE_SF", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"
#: The rung of a query's ladder that is met depends on the scale.
LADDERS = ("search_topk", "search_single", "search_status_document", "search_cascade", "search_snippets", "stance", "like_search", "like_search_only", "snippet_long")


def plain(v):
    if v is None or isinstance(v, bool):
        return v
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in values], key=repr)


@pytest.fixture(scope="module")
def duck():
    made = {}

    def connect(sf):
        if sf not in made:
            made[sf] = duckdb.connect()
            for f in os.listdir(sf):
                if f.endswith(".parquet"):
                    made[sf].execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
        return made[sf]

    return connect


@pytest.mark.parametrize("name, sf", [(n, SF) for n in sorted(QUERIES)] + [(n, LARGER) for n in LADDERS])
def test_equals_sql(spark, duck, name, sf):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    if name not in ORACLE_SQL:
        assert got
        return
    said = duck(sf).execute(ORACLE_SQL[name])
    names = [c[0] for c in said.description]
    assert sorted(names) == sorted(df.columns)
    want = rows(names, said.fetchall())
    assert len(got) == len(want)
    assert got == want
    if name not in ("implementations_of_act", "provision_eu_basis", "check_constraints"):
        assert got
