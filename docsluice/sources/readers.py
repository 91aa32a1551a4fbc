"""Readers: file trees, chunk indexes, JSON documents, attachments and update streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docsluice.functions import text as tx
from docsluice.operators import corpus
from docsluice.sources import datasources, versions

UPDATE_SCHEMA = """
update_id bigint, chat_id bigint, chat_type string, message_id bigint, text string, caption string, reply_to bigint,
reply_to_bot boolean, entities array<struct<type:string,offset:int,length:int,user_id:bigint>>, token string, action string,
option int, ts timestamp
"""


CONTENT_BYTES = 1 << 22  # of contents that a task holds at once, and one file


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, uri) of all files below a root; contents are not read.

    Tasks walk the folders: the driver knows the names of the root's folders only, however many files there are.
    """
    spark.dataSource.register(datasources.Listing)
    files = spark.read.format("file_listing").option("path", root).load()
    return files.withColumn("uri", F.concat(F.lit(root.rstrip("/") + "/"), "path"))


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """(path, length, content): the files of a listing with their bytes, dealt over all cores by path.

    A file that cannot be read fails the job; none is left out silently.
    """
    columns = files.select("path", "length")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, top = datasources.file_system(root.rstrip("/"))
        for batch in batches:
            first, held, contents = 0, 0, []
            for at, path in enumerate(batch.column(0).to_pylist(), 1):
                with system.open_input_stream(f"{top}/{path}") as file:
                    contents.append(file.read())
                held += len(contents[-1])
                if held >= CONTENT_BYTES or at == batch.num_rows:
                    some = batch.slice(first, at - first)
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(contents, pa.binary())], ["path", "length", "content"])
                    first, held, contents = at, 0, []

    tasks = 4 * files.sparkSession.sparkContext.defaultParallelism
    return columns.repartition(tasks, "path").mapInArrow(read, "path string, length bigint, content binary")


def scan_text_corpus(
    spark: SparkSession,
    root: str,
    extensions: tuple[str, ...] = corpus.TEXT_EXTENSIONS,
    skip_dirs: tuple[str, ...] = corpus.SKIP_DIRS,
    max_bytes: int | None = None,
    max_files: int | None = None,
) -> DataFrame:
    """(path, length, text) of the text files below a root.

    Names and sizes decide before any content is read: kinds and folders, and what a caller's own limits leave out.
    """
    kept = corpus.select_text_files(list_files(spark, root), extensions, skip_dirs, max_bytes, max_files)
    return with_contents(kept, root).select("path", "length", tx.decode_utf8(F.col("content")).alias("text"))


def read_chunk_index(spark: SparkSession, path: str) -> DataFrame:
    """Chunk rows of an index; blank and malformed lines are dropped, an empty index is an error."""
    rows = spark.read.schema(corpus.CHUNK_SCHEMA).option("mode", "DROPMALFORMED").json(path)
    rows = rows.where(F.col("chunk_id").isNotNull())
    if rows.isEmpty():
        raise corpus.EmptyIndex(f"no chunks in {path}")
    return rows


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, json): one document per file; text that is not JSON is left to the validators."""
    rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return rows.select(
        F.element_at(F.split("_metadata.file_path", "/"), -1).alias("doc_id"), F.col("value").alias("json")
    )


def read_text_folder(spark: SparkSession, root: str) -> DataFrame:
    """(folder, file_id, name, text) of all files; which of them are plain text is decided where they are assembled."""
    files = with_contents(list_files(spark, root), root)
    return files.select(
        F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1).alias("folder"),
        F.col("path").alias("file_id"),
        F.regexp_extract("path", r"([^/]*)$", 1).alias("name"),
        tx.decode_utf8(F.col("content")).alias("text"),
    )


def read_attachments(spark: SparkSession, root: str, head: int = 500) -> DataFrame:
    """(name, size, modified, head, bytes_read) of downloaded attachments: of a file of any size only the beginning is read."""
    spark.dataSource.register(datasources.Attachments)
    return spark.read.format("attachments").option("path", root).option("head", head).load()


def read_file_tree(nodes: DataFrame) -> DataFrame:
    """Nodes that are not trashed, with their size as a number."""
    kept = nodes.where(~F.coalesce(F.col("trashed"), F.lit(False)))
    return kept.withColumn("size", F.col("size").try_cast("bigint"))


def read_updates(spark: SparkSession, path: str, offset: int = 0, until: int | None = None) -> DataFrame:
    """Updates of a log as a stream that polls from an offset; the checkpoint keeps how far it came.

    A batch that is replayed reads the same updates.  ``until`` ends the poll before an id.
    """
    spark.dataSource.register(datasources.UpdateLog)
    stream = spark.readStream.format("update_log").option("path", path).option("offset", offset)
    return (stream if until is None else stream.option("until", until)).load()


def read_latest(spark: SparkSession, path: str, schema) -> DataFrame:
    """The current version of a table that ``sinks.publish_latest`` or ``sinks.upsert_state`` writes."""
    return versions.read_current(spark, path, schema)
