"""Every query with a DuckDB text gives the same rows in both engines."""

import decimal
import math
import os

import duckdb
import pytest

from pagewright import plans
from pagewright.plans import registry

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return "nan" if math.isnan(value) else round(float(value), 6)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([repr(plain(row[i])) for i in order] for row in rows))


def same_rows(spark, duck, query, sql):
    frame = query(spark, FOLDER)
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(frame.columns) == sorted(names)
    got, known = rows_of(frame.columns, frame.collect()), rows_of(names, want.fetchall())
    assert len(got) == len(known) and next(((a, b) for a, b in zip(got, known, strict=True) if a != b), None) is None


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_same_rows(spark, duck, name):
    same_rows(spark, duck, plans.queries()[name], plans.oracle_sql()[name])


def literal(sql):
    """The text with literal rows in place of derived ones."""
    for fixture in registry.FIXTURES:
        if fixture.given:
            sql = sql.replace(fixture.sql(), fixture.literal())
    return sql


CASES = {name: (plans.queries()[name], sql) for name, sql in plans.oracle_sql().items() if literal(sql) != sql} | {name: both for name, both in registry.CASES.items() if both[1]}


@pytest.mark.parametrize("name", sorted(CASES))
def test_literal_cases(spark, duck, monkeypatch, name):
    monkeypatch.setattr(registry, "LITERAL", True)
    query, sql = CASES[name]
    same_rows(spark, duck, query, literal(sql))


@pytest.mark.parametrize("name", sorted(name for name, both in registry.CASES.items() if not both[1]))
def test_cases_run(spark, name):
    assert registry.CASES[name][0](spark, FOLDER).columns


@pytest.mark.parametrize("name", sorted(set(plans.queries()) - set(plans.oracle_sql())))
def test_runs(spark, name):
    assert plans.queries()[name](spark, FOLDER).columns


def test_flagship(spark):
    assert plans.flagship(spark, FOLDER).count() >= 0
    assert registry.QUERIES
