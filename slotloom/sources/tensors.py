"""Tables of numbers and vectors as ``.npy`` files, as a data source.

    spark.dataSource.register(Tensors)
    df.write.format("tensors").mode("overwrite").save(folder)     # or append
    spark.read.format("tensors").load(folder)

Each task of a write makes one file per column below ``part-<unique>``, of shape (rows,) or (rows, length); the commit lists the
parts in ``_manifest``, whose names sort in the order of the commits, so a write that fails, or a task that runs twice,
leaves nothing that a reader sees.  A reader splits every part by row ranges and maps its files, so a range reads its own bytes.

Columns: numbers and booleans, and arrays of one length without nulls, also in the array.  Option: ``rows`` per partition.
Folders are paths on a file system that driver and executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType, _parse_datatype_json_string

ROWS = 100_000


def _local(path: str) -> str:
    return path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")


@dataclass
class Part(InputPartition):
    name: str
    first: int
    end: int


@dataclass
class Written(WriterCommitMessage):
    parts: list


def _manifests(folder: str) -> list[dict]:
    """The commits of a folder; an overwrite hides those before it."""
    where, found = os.path.join(folder, "_manifest"), []
    for name in sorted(os.listdir(where)) if os.path.isdir(where) else []:
        with open(os.path.join(where, name)) as f:
            one = json.load(f)
        found = [one] if one["overwrite"] else [*found, one]
    return found


class _Reader(DataSourceReader):
    def __init__(self, folder: str, schema: StructType, rows: int):
        self.folder, self.schema, self.rows = folder, schema, rows

    def partitions(self) -> list[Part]:
        parts = [p for m in _manifests(self.folder) for p in m["parts"]]
        return [Part(p["name"], a, min(a + self.rows, p["rows"])) for p in parts for a in range(0, p["rows"], self.rows)] or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        for low in range(partition.first, partition.end, 10_000):
            columns = []
            for i, field in enumerate(self.schema):
                x = np.load(os.path.join(self.folder, partition.name, f"{i}.npy"), mmap_mode="r")[low : min(low + 10_000, partition.end)]
                flat = pa.array(np.ascontiguousarray(x).reshape(-1))
                columns.append(flat if x.ndim == 1 else pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32), flat))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in self.schema])


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str, schema: StructType, overwrite: bool):
        self.folder, self.schema, self.overwrite = folder, schema, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, held = Written([]), []
        try:
            for batch in iterator:
                held.append(batch)
                if sum(b.num_rows for b in held) >= ROWS:
                    self._save(held, done)
            self._save(held, done)
        except Exception:
            self.abort([done])
            raise
        return done

    def _save(self, held: list[pa.RecordBatch], done: Written) -> None:
        """A part of the rows held, of which there are about ``ROWS`` at most."""
        name, rows = f"part-{uuid.uuid4().hex}", sum(b.num_rows for b in held)
        if not rows:
            return
        where = os.path.join(self.folder, name)
        os.makedirs(where)
        done.parts.append({"name": name, "rows": rows})
        for i, field in enumerate(self.schema):
            column = pa.chunked_array([b.column(i) for b in held]).combine_chunks()
            if column.null_count:
                raise ValueError(f"{field.name} has nulls")
            if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
                sizes, flat = np.unique(np.diff(np.asarray(column.offsets))), column.flatten()
                if len(sizes) > 1 or flat.null_count:
                    raise ValueError(f"{field.name} has arrays of several lengths, or nulls in them")
                x = flat.to_numpy(zero_copy_only=False).reshape(rows, int(sizes[0]))
            else:
                x = column.to_numpy(zero_copy_only=False)
            if x.dtype == object:
                raise ValueError(f"{field.name} is no number")
            np.save(os.path.join(where, f"{i}.npy"), x)
        held.clear()

    def commit(self, messages: list[Written | None]) -> None:
        where = os.path.join(self.folder, "_manifest")
        os.makedirs(where, exist_ok=True)
        before = _manifests(self.folder)
        said = {"schema": self.schema.json(), "overwrite": self.overwrite, "parts": [p for m in messages if m is not None for p in m.parts]}
        if before and not self.overwrite and before[0]["schema"] != said["schema"]:
            self.abort(messages)
            raise ValueError("the folder holds tensors of another schema")
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}.json"
        # The rename makes the commit visible as a whole.
        with open(os.path.join(self.folder, f".{name}"), "w") as f:
            json.dump(said, f)
        os.replace(os.path.join(self.folder, f".{name}"), os.path.join(where, name))

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            for p in m.parts if m is not None else ():
                shutil.rmtree(os.path.join(self.folder, p["name"]), ignore_errors=True)


class Tensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> StructType:
        found = _manifests(_local(self.options["path"]))
        if not found:
            raise ValueError(f"no tensors in {self.options['path']}")
        return _parse_datatype_json_string(found[0]["schema"])

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(_local(self.options["path"]), schema, int(self.options.get("rows", ROWS)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(_local(self.options["path"]), schema, overwrite)
