"""Folders as a data source: spark.dataSource.register(FolderSource), then spark.read.format("credsift").load(folder).

The rows are those of files.disk: (path, content, read_error). Options: ignore and include (globs by commas), dot, partitions. The driver lists folders
only until there are enough of them to share out; each task walks its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import SCHEMA, TASK_BYTES, Wanted

ARROW = pa.schema([("path", pa.string()), ("content", pa.string()), ("read_error", pa.string())])


@dataclass
class Part(InputPartition):
    """Folders to walk, and files to read."""

    folders: tuple[str, ...]
    files: tuple[str, ...] = ()


class FolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "credsift"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FolderReader(dict(self.options))


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        globs = lambda k: [g for g in options.get(k, "").split(",") if g]
        self.root, self.wanted = options["path"].removeprefix("file://"), (globs("ignore"), globs("include") or None, options.get("dot", "false").lower() == "true")
        self.parts = int(options.get("partitions", "64"))

    def partitions(self) -> list[Part]:
        """Levels are listed until one has `parts` folders; files met on the way are shared out as they are."""
        wanted, folders, files = Wanted(*self.wanted), [""], []
        while folders and len(folders) < self.parts:
            below = []
            for folder in folders:
                for path, size in wanted.children(self.root, folder):
                    (below if size is None else files).append(path)
            folders = below
        n = max(1, min(self.parts, len(folders) + len(files)))
        return [Part(tuple(folders[k::n]), tuple(files[k::n])) for k in range(n)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        wanted, held, size = Wanted(*self.wanted), [], 0
        for path in (*partition.files, *(p for folder in partition.folders for p, _ in wanted.below(self.root, folder))):
            try:
                with open(f"{self.root}/{path}", "rb") as f:
                    row = {"path": path, "content": f.read().decode("utf-8", "replace"), "read_error": None}
            except Exception as e:  # noqa: BLE001  a file that can't be read is a row with its error
                row = {"path": path, "content": None, "read_error": str(e) or type(e).__name__}
            held.append(row)
            size += len(row["content"] or "") + 200
            if size >= TASK_BYTES:
                yield pa.RecordBatch.from_pylist(held, ARROW)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, ARROW)
