"""A data source over the files of a folder that reads what a first look at them needs, and not their content."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD_BYTES = 8
PIECE_BYTES = 1 << 16
FILES_PER_TASK = 500
HEADS = "path string, modificationTime timestamp, length long, head binary, blank boolean"


class _Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]) -> None:
        super().__init__(0)
        self.files = files


class _Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path = options["path"]
        self.max_bytes = int(options.get("maxBytes", (1 << 63) - 1))

    def _place(self):
        from pyarrow import fs

        # A path without a scheme is one of the machine's own file system.
        return fs.FileSystem.from_uri(self.path if ":" in self.path else f"file://{self.path}")

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        system, root = self._place()
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        files = []
        for f in found:
            inside = f.path[len(root) :].strip("/").split("/")
            if f.is_file and not any(part.startswith(("_", ".")) for part in inside):
                files.append((f.path, (f.mtime_ns or 0) // 1000, f.size))
        files.sort()
        return [_Files(files[i : i + FILES_PER_TASK]) for i in range(0, len(files), FILES_PER_TASK)] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        system, _ = self._place()
        rows = []
        for path, modified, length in partition.files:
            head, blank = b"", True
            if length <= self.max_bytes:
                with system.open_input_file(path) as content:
                    # A piece at a time, up to the first one that holds anything: for nearly all files that is the first.
                    while blank and (piece := content.read(PIECE_BYTES)):
                        head = head or piece[:HEAD_BYTES]
                        blank = not piece.strip()
            stamp = dt.datetime.fromtimestamp(0, dt.timezone.utc) + dt.timedelta(microseconds=modified)
            rows.append((f"file:{path}" if ":" not in path and path.startswith("/") else path, stamp, length, head, blank))
        columns = list(zip(*rows)) or [()] * 5
        kinds = (pa.string(), pa.timestamp("us", "UTC"), pa.int64(), pa.binary(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in HEADS.split(", ")])


class FileHeads(DataSource):
    """(path, modificationTime, length, head, blank) of every file below a folder, of any size, empty ones too.

    Files and folders whose name begins with ``_`` or ``.`` are left out, as Spark's own sources do. ``head`` has the first bytes, and
    ``blank`` says that there is nothing but white space; of files longer than ``maxBytes`` nothing is read.
    """

    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return HEADS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)
