"""A data source for files of fixed-length records: a label byte, then a byte per value."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Read by one task, and at one time within it.
TASK_BYTES, READ_BYTES = 128 * 2**20, 4 * 2**20
TYPES = {"id": "string", "data": "array<float>", "label": "float"}


@dataclass
class Stretch(InputPartition):
    """Consecutive records of a file."""

    path: str
    name: str
    first: int
    records: int


def opened(path: str) -> pa.NativeFile:
    system, inside = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    return system.open_input_file(inside)


class FixedRecords(DataSource):
    """Options: ``files`` (JSON list of path, name for ids, length), ``record`` (bytes), ``task_bytes``, ``columns``."""

    @classmethod
    def name(cls) -> str:
        return "fixed_records"

    def schema(self) -> str:
        return ", ".join(f"{name} {TYPES[name]}" for name in self.options["columns"].split(","))

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(dict(self.options))


class RecordReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.record, self.columns = int(options["record"]), options["columns"].split(",")
        self.files, self.at_once = json.loads(options["files"]), max(1, int(options["task_bytes"]) // self.record)

    def partitions(self) -> list[Stretch]:
        found = []
        for path, name, length in self.files:
            records = length // self.record
            found += [Stretch(path, name, at, min(self.at_once, records - at)) for at in range(0, records, self.at_once)]
        return found or [Stretch("", "", 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.records:
            return
        step = max(1, READ_BYTES // self.record)
        with opened(partition.path) as file:
            for at in range(partition.first, partition.first + partition.records, step):
                n = min(step, partition.first + partition.records - at)
                stored = file.read_at(n * self.record, at * self.record)
                if len(stored) != n * self.record:
                    raise ValueError(f"{partition.path} has become shorter")
                yield self.batch(np.frombuffer(stored, np.uint8).reshape(n, self.record), partition.name, at)

    def batch(self, rows: np.ndarray, name: str, first: int) -> pa.RecordBatch:
        made = {
            "id": lambda: pc.binary_join_element_wise(name, pc.cast(pa.array(np.arange(first, first + len(rows))), pa.string()), ":"),
            "data": lambda: pa.ListArray.from_arrays(
                np.arange(len(rows) + 1, dtype=np.int32) * (self.record - 1), rows[:, 1:].astype(np.float32).ravel()),
            "label": lambda: pa.array(rows[:, 0].astype(np.float32))}
        return pa.RecordBatch.from_arrays([made[c]() for c in self.columns], names=self.columns)
