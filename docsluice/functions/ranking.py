"""Ranks and first rows of groups that may hold most of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ordered_bucket(value: Column, df: DataFrame, buckets: int | None = None) -> Column:
    """Order-preserving bucket of a column: 0 for NULL, which sorts first, then quantiles.

    By default there are as many as the session has shuffle partitions, between 8 and 512.  Bounds are approximate percentiles of numbers, dates and times, and of any other type the quantiles of a bounded
    sample of its distinct values; one job measures them.
    """
    if buckets is None:
        buckets = min(512, max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    kind = df.select(value.alias("v")).schema["v"].dataType
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)):
        v = F.unix_date(value) if isinstance(kind, T.DateType) else value.cast("double")
        shares = [i / buckets for i in range(1, buckets)]
        bounds = df.agg(F.percentile_approx(v, shares, 10_000)).first()[0]
    else:
        v = value
        distinct = df.select(v.alias("v")).where(F.col("v").isNotNull()).distinct()
        taken = distinct.orderBy(F.xxhash64("v")).limit(buckets * 16).agg(F.sort_array(F.collect_list("v"))).first()[0]
        bounds = [taken[len(taken) * i // buckets] for i in range(1, buckets)] if taken else None
    return F.when(v.isNull(), 0).otherwise(_place(v, sorted(set(bounds or [])), 1))


def _place(v: Column, bounds: list, first: int) -> Column:
    """``first`` plus the number of bounds at or below a value, as a balanced tree of comparisons."""
    if not bounds:
        return F.lit(first)
    mid = len(bounds) // 2
    return F.when(v < F.lit(bounds[mid]), _place(v, bounds[:mid], first)).otherwise(_place(v, bounds[mid + 1 :], first + mid + 1))


def distributed_rank(
    df: DataFrame, keys: list[str], order: list[str], buckets: list[Column], out: str = "rank"
) -> DataFrame:
    """Row numbers per key without sorting a key's rows in one task.

    ``buckets`` are order-preserving prefixes of ``order``, so rows rank within their bucket and start after the rows of
    the earlier ones; only bucket counts meet per key.
    """
    names = [f"_b{i}" for i in range(len(buckets))]
    split = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    local = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order))
    ranked = split.withColumn("_local", local)
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    counts = split.groupBy(*keys, *names).agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(earlier), F.lit(0))).drop("_n")
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*keys, *names]]
    joined = ranked.alias("r").join(starts.alias("s"), on)
    return joined.select(*[F.col(f"r.{c}") for c in df.columns], (F.col("_start") + F.col("_local")).alias(out))


def distributed_sum(
    df: DataFrame, keys: list[str], order: list, buckets: list[Column], value: Column, out: str = "start", whole: str | None = None
) -> DataFrame:
    """Sums of ``value`` over the earlier rows of a key, and over all of them as ``whole``; as ``distributed_rank`` does,
    a key's rows are not sorted in one task."""
    names = [f"_b{i}" for i in range(len(buckets))]
    split = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)], value.alias("_v"))
    before = (Window.unboundedPreceding, -1)
    summed = split.withColumn("_local", F.coalesce(F.sum("_v").over(Window.partitionBy(*keys, *names).orderBy(*order).rowsBetween(*before)), F.lit(0)))
    totals = split.groupBy(*keys, *names).agg(F.sum("_v").alias("_n"))
    stretch = Window.partitionBy(*keys).orderBy(*names).rowsBetween(*before)
    starts = totals.select(*keys, *names, F.coalesce(F.sum("_n").over(stretch), F.lit(0)).alias("_start"), F.sum("_n").over(Window.partitionBy(*keys)).alias("_whole"))
    on = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in [*keys, *names]]
    more = [F.col("_whole").alias(whole)] if whole else []
    return summed.alias("r").join(starts.alias("s"), on).select(
        *[F.col(f"r.{c}") for c in df.columns], (F.col("_start") + F.col("_local")).alias(out), *more
    )
