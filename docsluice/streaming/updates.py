"""Update streams: routing, tokens handled once, lifetimes of pending flows, and numbers for outgoing documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.functions.ranking import ordered_bucket
from docsluice.operators import messages as ms
from docsluice.operators import picks

TOKEN_LIFETIME = "1 hour"


def route_stream(updates: DataFrame, bot: str, bot_id: int, view_url: str) -> DataFrame:
    """Routed updates; what depends on a chat's past is false here and decided by the stateful streams."""
    known = updates.withColumns({"gate_open": F.lit(False), "has_history": F.lit(False)})
    return ms.route_updates(known, bot, bot_id, view_url)


def consume_once(events: DataFrame, keys: list[str], ts: str = "ts", lifetime: str = TOKEN_LIFETIME) -> DataFrame:
    """The first event of a token; repeats within the lifetime are dropped, and the state goes with the watermark."""
    return events.withWatermark(ts, lifetime).dropDuplicatesWithinWatermark(keys)


def pending_sessions(events: DataFrame, key: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Lifetimes of pending flows as session windows, which is how streams keep them."""
    gap = F.session_window(ts, f"{ms.PENDING_MINUTES * 60} seconds 1 milliseconds")
    open_ = events.withWatermark(ts, late).groupBy(key, gap.alias("w"))
    return open_.agg(F.count("*").alias("n_touches"), F.min(ts).alias("first"), F.max(ts).alias("last"))


def fan_out(sinks: dict[str, str], name: str = "route") -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer of one folder per route; a repeated batch overwrites its own part."""

    def write(batch: DataFrame, epoch: int) -> None:
        kept = batch.persist()
        for route, path in sinks.items():
            kept.where(F.col(name) == route).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        kept.unpersist()

    return write


def number_documents(path: str, order: str, last: int = 0) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` writer that numbers documents after all earlier batches.

    Every batch leaves its last number in a small table beside the documents, after they are written.  Numbers go on
    from the earlier batches, so a repeated batch gets its own numbers again and none is given twice.
    """
    reached = f"{path.rstrip('/')}_reached"

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            earlier = spark.read.schema("n bigint, epoch bigint").parquet(reached).where(F.col("epoch") < epoch).agg(F.max("n")).first()[0]
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            earlier = None
        start = last if earlier is None else earlier
        numbered = picks.serial_numbers(batch, [order], [ordered_bucket(F.col(order), batch)], start)
        numbered.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        written = spark.read.schema(numbered.schema).parquet(f"{path}/epoch={epoch}")
        top = written.agg(F.coalesce(F.max("serial"), F.lit(start)).cast("bigint").alias("n"))
        top.write.mode("overwrite").parquet(f"{reached}/epoch={epoch}")

    return write
