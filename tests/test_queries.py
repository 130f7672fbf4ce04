"""Every registered query with SQL, against DuckDB on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from gridlake import registry
from gridlake.plans.views import Events

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    return int(value) if isinstance(value, Decimal) else bytes(value).hex() if isinstance(value, (bytes, bytearray)) else value


def rows(names, found):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf, duck, name):
    df = registry.queries()[name](spark, sf)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, found.fetchall())


def test_entry_and_registration(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_outside_imports_the_training_operators():
    root = Path(entry.__file__).parent / "gridlake"
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            assert "gridlake.llm" not in path.read_text(), path


def test_chunk_forms_of_all_chunks(spark, sf):
    e = Events(spark, sf)
    touched = {tuple(r) for r in e.geometry.addressed(e.history.where("effective")).select("rev", "cx", "cy").collect()}
    got = {(r.rev, r.cx, r.cy) for r in registry.queries()["f08_chunk_forms"](spark, sf).collect()}
    assert got == touched and len({t[1:] for t in got}) > 1


def test_resume_reaches_the_frontier(spark, sf):
    commits = {r.rev for r in Events(spark, sf).history.where("effective and rev > 300").select("rev").collect()}
    got = [r.rev for r in registry.queries()["f12_resume"](spark, sf).collect()]
    assert sorted(got) == sorted(commits) and max(got) > 900
