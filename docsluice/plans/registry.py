"""The query registry and the tables a query reads."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docsluice.session import spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# White space as the SQL engine's regex dialect writes it.
SQL_WS = r"[\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


class Tables:
    """Lazily opened parquet tables of one folder: ``t.documents``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self._folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self._folder}/{name}.parquet")

    def stream(self, name: str) -> DataFrame:
        """The same table as a stream of its files; a pattern, as a plain path would have to be a folder."""
        path = f"{self._folder}/{name}.parque[t]"
        return self.spark.readStream.schema(getattr(self, name).schema).parquet(path)

    def spread(self, name: str, *columns: str) -> DataFrame:
        """Columns of a table, over all cores."""
        return spread(getattr(self, name).select(*columns))


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under a name, with the SQL that gives the same rows."""

    def add(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def sql_collapse(expr: str) -> str:
    return f"trim(regexp_replace({expr}, '{SQL_WS}+', ' ', 'g'))"


def sql_trim(expr: str) -> str:
    return f"regexp_replace({expr}, '^{SQL_WS}+|{SQL_WS}+$', '', 'g')"
