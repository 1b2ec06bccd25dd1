"""Request records as a data source: Parquet logs that grow by files, read in row ranges, in batch or as a stream that can be replayed.

    spark.dataSource.register(RequestRecords)
    spark.read.format("request_records").schema(schema).load(folder)
    spark.readStream.format("request_records").schema(schema).load(folder)

Files are taken in the order of their names, and an offset is a number of rows in that order, so the same range always
gives the same rows: after a restart a stream goes on where its checkpoint stands.  New files must sort
behind those that are there.  Options: ``rows`` per partition, ``glob`` for the names of files.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
import pyarrow.parquet as pq
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

ROWS = 50_000


@dataclass
class Rows(InputPartition):
    """Rows [first, end) of a file."""

    path: str
    first: int
    end: int


class _Records:
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.rows, self.glob = int(options.get("rows", ROWS)), options.get("glob", "*.parquet")

    def _at(self) -> tuple[fs.FileSystem, str]:
        path = self.options["path"]
        local = path if "://" in path else f"file://{path.removeprefix('file:')}"
        return fs.FileSystem.from_uri(local)

    def files(self) -> list[tuple[str, int]]:
        """(path, rows) of the files that are there, by name; only their footers are read."""
        system, folder = self._at()
        found = system.get_file_info(fs.FileSelector(folder, recursive=False))
        paths = sorted(i.path for i in found if i.is_file and fnmatch.fnmatch(i.base_name, self.glob) and not i.base_name.startswith(("_", ".")))
        return [(p, pq.read_metadata(p, filesystem=system).num_rows) for p in paths]

    def ranges(self, low: int, high: int) -> list[Rows]:
        """Partitions for the rows [low, high) of all files."""
        out, base = [], 0
        for path, n in self.files():
            first, end = max(low - base, 0), min(high - base, n)
            out += [Rows(path, a, min(a + self.rows, end)) for a in range(first, end, self.rows)]
            base += n
        return out

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        """Row groups outside of the range are not read, nor are columns that the schema hasn't."""
        system, _ = self._at()
        file, base, names = pq.ParquetFile(partition.path, filesystem=system), 0, [f.name for f in self.schema]
        kind = to_arrow_schema(self.schema)
        for group in range(file.num_row_groups):
            n = file.metadata.row_group(group).num_rows
            first, end = max(partition.first - base, 0), min(partition.end - base, n)
            base += n
            if first < end:
                rows = file.read_row_group(group, columns=names).select(names).slice(first, end - first)
                yield from rows.cast(kind).combine_chunks().to_batches()


class _Batch(_Records, DataSourceReader):
    def partitions(self) -> list[Rows]:
        return self.ranges(0, sum(n for _, n in self.files())) or [Rows("", 0, 0)]

    def read(self, partition: Rows) -> Iterator[pa.RecordBatch]:
        return super().read(partition) if partition.path else iter(())


class _Stream(_Records, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"rows": 0}

    def latestOffset(self) -> dict:
        return {"rows": sum(n for _, n in self.files())}

    def partitions(self, start: dict, end: dict) -> list[Rows]:
        return self.ranges(start["rows"], end["rows"])

    def commit(self, end: dict) -> None:
        """Nothing to let go: files stay."""


class RequestRecords(DataSource):
    @classmethod
    def name(cls) -> str:
        return "request_records"

    def schema(self) -> str:
        raise ValueError("request_records needs a schema")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(schema, dict(self.options))

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(schema, dict(self.options))
