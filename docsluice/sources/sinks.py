"""Writers: chunk indexes with their manifest, queues, latest-file tables and rendered text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsluice.operators import corpus, extraction
from docsluice.sources import datasources, versions


def write_chunk_index(chunks: DataFrame, path: str, resume: bool = False) -> None:
    """One JSON row per chunk; a resumed build appends.

    The rows to append are those missing from the index, so a repeated run adds nothing.
    """
    chunks.write.mode("append" if resume else "overwrite").json(path)


def write_index_manifest(manifest: DataFrame, path: str) -> dict:
    """Write the single manifest row; an index without chunks is an error and leaves no manifest.

    Give it the manifest of the index as written and read back: the row is computed once, before anything is written.
    """
    row = manifest.first()  # one row by construction
    if not row or row["chunk_count"] == 0:
        raise corpus.EmptyIndex("no chunk was collected: no text files, or all of them are too large")
    manifest.sparkSession.createDataFrame([row], manifest.schema).write.mode("overwrite").json(path)
    return row.asDict(recursive=True)


def write_file_queue(queue: DataFrame, path: str) -> None:
    queue.write.mode("overwrite").json(path)


def replace_latest(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Keep exactly one current version per key: partitions that get rows are replaced, the others stay.

    Partitions are replaced one by one; where readers must never see half of it, use ``publish_latest``.
    """
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def publish_latest(rows: DataFrame, path: str, keys: list[str], token: str | None = None, publish: bool = True) -> str:
    """Replace the rows of the keys that come, as one version; repeating a token changes nothing."""
    return versions.change(rows, path, keys, versions.replace_rows(keys), token, publish=publish)


def upsert_state(patch: DataFrame, path: str, key: str = "tender_id", token: str | None = None, publish: bool = True) -> str:
    """Merge fields into the states of their keys, as one version; repeating a token changes nothing."""
    return versions.change(patch, path, [key], lambda old, new: extraction.merge_state(old, new, key), token, publish=publish)


def write_attachments(files: DataFrame, root: str) -> None:
    """(name, content) as files below a root, each in the folder that its name gives."""
    files.sparkSession.dataSource.register(datasources.Attachments)
    files.select("name", "content").write.format("attachments").option("path", root).mode("append").save()


def write_files(files: DataFrame, root: str) -> None:
    """(path, content) as files at their paths below a root."""
    files.sparkSession.dataSource.register(datasources.Attachments)
    files.select("path", "content").write.format("attachments").option("path", root).mode("append").save()


def write_update_log(updates: DataFrame, path: str) -> None:
    """Append updates to a log that ``readers.read_updates`` polls, in segments of their ids."""
    segment = F.floor(F.col("update_id") / datasources.SEGMENT).alias("segment")
    updates.withColumn("segment", segment).repartition("segment").write.mode("append").partitionBy("segment").parquet(path)


def write_markdown(lines: DataFrame, path: str, key: str, order: list[str]) -> None:
    """Ordered lines as text files per key.

    Range partitions split a key that holds most lines over several files whose names keep the order.
    """
    placed = lines.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed.select(key, F.col("line").alias("value")).write.mode("overwrite").partitionBy(key).text(path)
