"""Python data sources: listings of file trees, attachments by their first bytes, and logs of updates that are polled from an offset.

Tasks list and read files themselves; the driver sees names of folders only.  Paths are those of any file system that
Arrow opens (local, ``file:``, ``hdfs:``, ``s3:`` and others).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

HEAD_BYTES = 500  # enough to tell a kind of file
SHARDS = 32  # folders that attachments are dealt to
ATTACHMENT_SCHEMA = "name string, size bigint, modified timestamp, head binary, bytes_read bigint"
LISTING_SCHEMA = "path string, length bigint, modified timestamp"
SEGMENT = 10_000  # update ids in a folder of a log


def file_system(path: str):
    """The file system of a path, and the path there."""
    from pyarrow import fs

    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if "://" not in path else fs.FileSystem.from_uri(path)


def _folders(root: str) -> list[str]:
    """Names of the folders in a root; none where it does not exist."""
    from pyarrow import fs

    system, path = file_system(root)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(f.base_name for f in found if f.type == fs.FileType.Directory)


@dataclass
class Folder(InputPartition):
    path: str


class AttachmentsReader(DataSourceReader):
    """One task for each folder below the root, and one for the files in the root itself."""

    def __init__(self, options: dict):
        self.root, self.head = options["path"].rstrip("/"), int(options.get("head", HEAD_BYTES))

    def partitions(self) -> list[Folder]:
        return [Folder(""), *(Folder(f"/{name}") for name in _folders(self.root))]

    def read(self, partition: Folder) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, path = file_system(self.root + partition.path)
        found = system.get_file_info(fs.FileSelector(path, recursive=bool(partition.path), allow_not_found=True))
        rows: list[tuple] = []
        schema = pa.schema([("name", pa.string()), ("size", pa.int64()), ("modified", pa.timestamp("us", "UTC")), ("head", pa.binary()), ("bytes_read", pa.int64())])
        batch = lambda: pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
        for f in found:
            if f.type != fs.FileType.File or f.base_name.startswith("."):
                continue
            with system.open_input_file(f.path) as content:
                head = content.read(self.head)
            rows.append((f.base_name, f.size, f.mtime, head, len(head)))
            if len(rows) == 1000:
                yield batch()
                rows.clear()
        if rows:
            yield batch()


def _hidden(name: str) -> bool:
    """Names that Spark's own file sources pass by."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


class ListingReader(DataSourceReader):
    """One task for each folder in the root, which walks it, and one for the files in the root itself."""

    def __init__(self, options: dict):
        self.root = options["path"].rstrip("/")

    def partitions(self) -> list[Folder]:
        from pyarrow import fs

        system, path = file_system(self.root)
        if system.get_file_info(path).type != fs.FileType.Directory:
            raise FileNotFoundError(f"there is no folder {self.root}")
        return [Folder(""), *(Folder(f"/{name}") for name in _folders(self.root) if not _hidden(name))]

    def read(self, partition: Folder) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        system, top = file_system(self.root)
        schema = pa.schema([("path", pa.string()), ("length", pa.int64()), ("modified", pa.timestamp("us", "UTC"))])
        todo = [top + partition.path]
        while todo:
            found = [f for f in system.get_file_info(fs.FileSelector(todo.pop())) if not _hidden(f.base_name)]
            if partition.path:
                todo += [f.path for f in found if f.type == fs.FileType.Directory]
            files = [f for f in found if f.type == fs.FileType.File]
            for at in range(0, len(files), 10_000):
                some = files[at : at + 10_000]
                columns = [f.path.removeprefix(top).lstrip("/") for f in some], [f.size for f in some], [f.mtime for f in some]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


class Listing(DataSource):
    """``spark.read.format("file_listing")``: path below the root, length and time of every file; contents are not read."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return LISTING_SCHEMA

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: int


class AttachmentsWriter(DataSourceWriter):
    """Rows (name, content) as files in folders dealt by name, or rows (path, content) as files at their paths; a
    repeated task writes the same files again."""

    def __init__(self, options: dict, by_path: bool):
        self.root, self.by_path = options["path"].rstrip("/"), by_path

    def write(self, rows: Iterator) -> Written:
        system, root = file_system(self.root)
        made, n = set(), 0
        for row in rows:
            path = row.path if self.by_path else f"{zlib.crc32(row.name.encode()) % SHARDS:02x}/{row.name}"
            folder = f"{root}/{path}".rpartition("/")[0]
            if folder not in made:
                system.create_dir(folder, recursive=True)
                made.add(folder)
            with system.open_output_stream(f"{root}/{path}") as out:
                out.write(bytes(row.content))
            n += 1
        return Written(n)

    def commit(self, messages) -> None:
        """Files stand as they are written."""

    def abort(self, messages) -> None:
        """A repeated job overwrites what a failed one left."""


class Attachments(DataSource):
    """``spark.read.format("attachments")``: name, size, first bytes; ``write`` takes name (or path) and content."""

    @classmethod
    def name(cls) -> str:
        return "attachments"

    def schema(self) -> str:
        return ATTACHMENT_SCHEMA

    def reader(self, schema) -> AttachmentsReader:
        return AttachmentsReader(self.options)

    def writer(self, schema, overwrite: bool) -> AttachmentsWriter:
        return AttachmentsWriter(self.options, "path" in schema.names)


@dataclass
class Stretch(InputPartition):
    segment: str
    first: int
    stop: int


class UpdateLogReader(DataSourceStreamReader):
    """Updates from an offset on, as a poll gives them; the offset is the next update's id.

    The log is append-only, so the same stretch always reads the same updates and a batch can be replayed.  Every
    segment that a batch touches is a task.
    """

    def __init__(self, options: dict, schema):
        self.root, self.first = options["path"].rstrip("/"), int(options.get("offset", 0))
        self.until = int(options["until"]) if "until" in options else None
        self.kind = schema

    def _segments(self) -> list[int]:
        return sorted(int(name.removeprefix("segment=")) for name in _folders(self.root) if name.startswith("segment="))

    def initialOffset(self) -> dict:
        return {"next": self.first}

    def latestOffset(self) -> dict:
        """Behind the last update of the last segment, told by the footers of its files."""
        import pyarrow.parquet as pq
        from pyarrow import fs

        last = self.first
        segments = self._segments()
        if segments:
            system, path = file_system(f"{self.root}/segment={segments[-1]}")
            for f in system.get_file_info(fs.FileSelector(path)):
                if f.type == fs.FileType.File and f.extension == "parquet":
                    footer = pq.read_metadata(f.path, filesystem=system)
                    at = footer.schema.names.index("update_id")
                    last = max([last, *(footer.row_group(i).column(at).statistics.max + 1 for i in range(footer.num_row_groups))])
        return {"next": last if self.until is None else max(self.first, min(last, self.until))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        first, stop = start["next"], end["next"]
        return [Stretch(f"segment={k}", first, stop) for k in self._segments() if stop > first and (k + 1) * SEGMENT > first and k * SEGMENT < stop]

    def read(self, partition: Stretch) -> Iterator:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        system, path = file_system(f"{self.root}/{partition.segment}")
        wanted = to_arrow_schema(self.kind)
        column = ds.field("update_id")
        rows = ds.dataset(path, filesystem=system, format="parquet", schema=wanted)
        yield from rows.to_batches(filter=(column >= partition.first) & (column < partition.stop))

    def commit(self, end: dict) -> None:
        """The checkpoint keeps the offset; nothing is taken out of the log."""


class UpdateLog(DataSource):
    """``spark.readStream.format("update_log")``: polls a log below ``path`` from ``offset`` (and up to ``until``)."""

    @classmethod
    def name(cls) -> str:
        return "update_log"

    def schema(self) -> str:
        from docsluice.sources.readers import UPDATE_SCHEMA

        return UPDATE_SCHEMA

    def streamReader(self, schema) -> UpdateLogReader:
        return UpdateLogReader(self.options, schema)
