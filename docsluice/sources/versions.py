"""Keyed tables whose every change is a version: a reader sees all of a change or nothing of it.

Rows lie in buckets of their keys.  A change writes new files for the buckets it touches, and last a small manifest that
names, for every bucket, the change its rows come from.  A change without a manifest was interrupted and is not there;
a change that is repeated under its token is not made again.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16
_MANIFEST = "n bigint, token string, bucket int, change string"


def _bucket(keys: list[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[int, str], set[str]]:
    """Number of the current version, the change of each bucket, and the tokens of all versions; all of bounded size
    but the tokens, of which there is one for each change."""
    try:
        rows = spark.read.schema(_MANIFEST).parquet(f"{path}/manifests/*")
        n = rows.agg(F.max("n")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        n = None
    if n is None:
        return 0, {}, set()
    current = {r["bucket"]: r["change"] for r in rows.where((F.col("n") == n) & F.col("bucket").isNotNull()).collect()}
    return n, current, {r["token"] for r in rows.select("token").distinct().collect()}


def _folders(path: str, current: dict[int, str], buckets: list[int] | None = None) -> list[str]:
    return [f"{path}/changes/{change}/_bucket={b}" for b, change in current.items() if buckets is None or b in buckets]


def _read(spark: SparkSession, path: str, schema, folders: list[str]) -> DataFrame:
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_current(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current version; none before the first change."""
    return _read(spark, path, schema, _folders(path, manifest(spark, path)[1]))


def change(
    rows: DataFrame, path: str, keys: list[str], merge: Callable[[DataFrame, DataFrame], DataFrame], token: str | None = None,
    buckets: int = BUCKETS, publish: bool = True,
) -> str:
    """Apply ``merge(old, rows)`` to the buckets that ``rows`` touches; gives the change's token.

    ``merge`` gives the new rows of the touched buckets, with the columns of ``rows``.  Only one writer changes a table at
    a time: of two that build on the same version the second fails.  ``publish=False`` stops before the manifest, as an
    interruption would.
    """
    spark, path = rows.sparkSession, path.rstrip("/")
    token = token or uuid.uuid4().hex
    n, current, tokens = manifest(spark, path)
    if token in tokens:
        return token
    touched = sorted(r["b"] for r in rows.select(_bucket(keys, buckets).alias("b")).distinct().collect())  # at most ``buckets``
    old = _read(spark, path, rows.schema, _folders(path, current, touched))
    name = f"{n + 1}-{uuid.uuid4().hex}"
    new = merge(old, rows).select(*rows.columns).withColumn("_bucket", _bucket(keys, buckets))
    new.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{path}/changes/{name}")
    if not publish:
        return token
    left = {r["_bucket"] for r in spark.read.schema("_bucket int").parquet(f"{path}/changes/{name}").distinct().collect()} if touched else set()
    after = {b: c for b, c in current.items() if b not in touched} | {b: name for b in touched if b in left}
    entries = [(n + 1, token, b, c) for b, c in sorted(after.items())] or [(n + 1, token, None, None)]
    # One file in a folder that must not exist: the version is there when the folder is.
    spark.createDataFrame(entries, _MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifests/{n + 1:09d}")
    return token


def replace_rows(keys: list[str]) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """Rows of keys that come take the place of all old rows of these keys."""
    return lambda old, rows: old.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows)
