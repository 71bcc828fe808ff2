"""Queries by name, each with its DuckDB text where SQL can express it, and literal inputs that both engines read."""

from __future__ import annotations

import string
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: Rules on literal rows alone, which tests run; they are no queries of the library.
CASES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

_DUCK = {"long": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def query(name: str, sql: str | None = None):
    """Register a query and, if given, the SQL that gives the same rows."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def case(name: str, sql: str | None = None):
    """A rule on literal rows, for tests."""

    def register(function: Callable[[SparkSession, str], DataFrame]):
        CASES[name] = function, sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    if isinstance(value, float) and value in (float("inf"), float("-inf")):
        return f"'{value}'::DOUBLE"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


#: All fixtures, and whether they give their literal rows where they could derive them; tests set that.
FIXTURES: list[Fixture] = []
LITERAL = False
_SPARK, _DUCKDB = {"@array": "array", "@at": "element_at", "@single": "F"}, {"@array": "list_value", "@at": "list_extract", "@single": ""}


def _spelled(text: str, names: dict[str, str]) -> str:
    for name, own in names.items():
        text = text.replace(name, own)
    return text


@dataclass(frozen=True)
class Fixture:
    """Inputs of a rule: rows that ``given`` derives from tables, in SQL that both engines read, and literal ones for tests.

    ``given`` names tables in braces, and ``@array`` and ``@at`` where the engines have different names. ``@single`` behind a
    whole number has Spark multiply floats by it in single precision, as DuckDB does.
    """

    columns: str
    rows: tuple
    given: str = ""

    def __post_init__(self) -> None:
        FIXTURES.append(self)

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        if not self.given or LITERAL:
            return spark.createDataFrame([tuple(r) for r in self.rows], self.columns)
        text = _spelled(self.given, _SPARK)
        used = {name: table(spark, sf_dir, name) for name in _tables(text)}
        kinds = [c.strip().rsplit(" ", 1) for c in self.columns.split(",")]
        return spark.sql(text, **used).selectExpr(*(f"CAST(`{name}` AS {kind}) AS `{name}`" for name, kind in kinds))

    def _typed(self, rows: str) -> str:
        names, kinds = zip(*(c.strip().rsplit(" ", 1) for c in self.columns.split(",")), strict=True)
        duck = [_DUCK[k[6:-1]] + "[]" if k.startswith("array<") else _DUCK[k] for k in kinds]
        casts = ", ".join(f'CAST("{n}" AS {k}) AS "{n}"' for n, k in zip(names, duck, strict=True))
        return f"(SELECT {casts} FROM {rows})"

    def literal(self) -> str:
        names = [c.strip().rsplit(" ", 1)[0] for c in self.columns.split(",")]
        values = ", ".join("(" + ", ".join(map(_literal, row)) + ")" for row in self.rows)
        return self._typed(f"(VALUES {values}) AS v(" + ", ".join(f'"{n}"' for n in names) + ")")

    def sql(self) -> str:
        if not self.given:
            return self.literal()
        text = _spelled(self.given, _DUCKDB)
        return self._typed(f"({text.format(**{name: name for name in _tables(text)})})")


def _tables(text: str) -> set[str]:
    return {name for _, name, _, _ in string.Formatter().parse(text) if name}
