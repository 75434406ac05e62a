"""The exchanges of a round as a prefix scan of affine maps.

Meeting worker x moves the centre c to (1 - b) c + b x. Such maps compose: a run of workers is c -> K c + S. So the
workers of a round are cut into runs; each run is composed by itself, the few composed maps of a block are walked
once, which gives the centre before every run, and then all runs list what their workers saw side by side. A block
of 2,000 workers is never in one place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Workers whose maps are composed by one task.
RUN = 64
BLOCK = ["layer", "chunk"]
#: Values held before a batch of results is handed on.
HELD = 1 << 20

_MAP = "layer int, chunk int, run int, kept double, sum array<double>"
_ENTRY = "layer int, chunk int, run int, values array<double>"
_OUT = "kind string, layer int, chunk int, worker int, values array<double>"
#: Worker number of the row that brings the centre into a run.
CENTRE = -1


def _same_size(a: np.ndarray, b: np.ndarray) -> None:
    if a.shape != b.shape:
        raise ValueError("Size mismatch!")


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows with their vector as an array that shares the batch's memory."""
    for batch in parts:
        vectors = batch.column("values")
        others = {n: batch.column(n).to_pylist() for n in batch.schema.names if n != "values"}
        for i in range(batch.num_rows):
            yield {n: v[i] for n, v in others.items()} | {"values": vectors[i].values.to_numpy() if vectors[i].is_valid else None}


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    waiting, held = [], 0

    def batch():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*waiting), types)], names=names)

    for row in rows:
        waiting.append(row)
        held += len(row[-1])
        if held >= HELD:
            yield batch()
            waiting, held = [], 0
    if waiting:
        yield batch()


def _compose(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted arrivals to one map (kept, sum) for each run of a block."""

    def maps():
        at, kept, total = None, 1.0, None
        for row in _rows(parts):
            key = row["layer"], row["chunk"], row["run"]
            if key != at:
                if at is not None:
                    yield (*at, kept, total)
                at, kept, total = key, 1.0, np.zeros(len(row["values"]))
            _same_size(total, row["values"])
            kept, total = (1 - row["b"]) * kept, (1 - row["b"]) * total + row["b"] * row["values"]
        if at is not None:
            yield (*at, kept, total)

    yield from _batches(maps(), ["layer", "chunk", "run", "kept", "sum"], [pa.int32()] * 3 + [pa.float64(), pa.list_(pa.float64())])


def _walk(runs: int):
    """The centre, then the maps of a block in order, to the centre before every run."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def entries():
            at, centre, done = None, None, runs
            for row in _rows(parts):
                if row["run"] == CENTRE:
                    while done < runs:
                        yield (*at, done, centre)
                        done += 1
                    at, centre, done = (row["layer"], row["chunk"]), row["values"], 0
                    continue
                if at != (row["layer"], row["chunk"]):
                    raise ValueError("Size mismatch!")
                while done <= row["run"]:
                    yield (*at, done, centre)
                    done += 1
                _same_size(centre, row["values"])
                centre = row["kept"] * centre + row["values"]
            while done < runs:
                yield (*at, done, centre)
                done += 1

        yield from _batches(entries(), ["layer", "chunk", "run", "values"], [pa.int32()] * 3 + [pa.list_(pa.float64())])

    return run


def _meet(due: tuple[int, ...]):
    """A run's first centre and its arrivals, sorted, to what each worker leaves with and the centres that are due."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def met():
            at, centre, waiting = None, None, []
            for row in _rows(parts):
                key = row["layer"], row["chunk"], row["run"]
                if row["worker"] == CENTRE:
                    yield from (("centre", *at[:2], d, centre) for d in waiting)
                    at, centre = key, row["values"]
                    waiting = [d for d in due if d // RUN == row["run"]]
                    continue
                if key != at:
                    raise ValueError("Size mismatch!")
                while waiting and waiting[0] < row["worker"]:
                    yield ("centre", *at[:2], waiting.pop(0), centre)
                x = row["values"]
                _same_size(centre, x)
                yield ("met", *at[:2], row["worker"], (1 - row["a"]) * x + row["a"] * centre)
                centre = (1 - row["b"]) * centre + row["b"] * x
            yield from (("centre", *at[:2], d, centre) for d in waiting)

        yield from _batches(met(), ["kind", "layer", "chunk", "worker", "values"], [pa.string()] + [pa.int32()] * 3 + [pa.list_(pa.float64())])

    return run


def _in_runs(df: DataFrame, *by: str) -> DataFrame:
    return df.repartition(*by).sortWithinPartitions(*by, *[c for c in ("run", "worker") if c in df.columns and c not in by])


def exchange_scan(workers_w: DataFrame, centre_w: DataFrame, n_workers: int, due: tuple[int, ...] = ()) -> DataFrame:
    """(kind, layer, chunk, worker, values): the workers of a round meet the centre one after another, by number.

    ``workers_w`` has (worker, layer, chunk, values, a, b): ``a`` is the rate on the worker's side, ``b`` the coefficient
    on the centre's. Rows of kind ``met`` have what a worker leaves with, those of kind ``centre`` the centre after the
    workers up to that of a number in ``due``, whether it came or not; the last number always is. Workers stay away
    by having no rows. A block of another size than the centre's, or that the centre lacks, is an error.
    """
    due = tuple(sorted({*due, n_workers - 1}))
    runs = (n_workers - 1) // RUN + 1
    values = F.col("values").cast("array<double>").alias("values")
    blocks = [F.col(c).cast("int").alias(c) for c in BLOCK]
    worker = F.col("worker").cast("int").alias("worker")
    arrivals = workers_w.select(*blocks, F.floor(F.col("worker") / RUN).cast("int").alias("run"), worker, "a", "b", values)
    centre = centre_w.select(*blocks, F.lit(CENTRE).alias("run"), F.lit(0.0).alias("kept"), values)
    if runs == 1:
        entries = centre.withColumn("run", F.lit(0)).drop("kept")
    else:
        maps = _in_runs(arrivals.drop("a"), *BLOCK, "run").mapInArrow(_compose, _MAP).withColumnRenamed("sum", "values")
        entries = _in_runs(centre.unionByName(maps), *BLOCK).mapInArrow(_walk(runs), _ENTRY)
    none = F.lit(0.0)
    first = entries.select(*BLOCK, "run", F.lit(CENTRE).alias("worker"), none.alias("a"), none.alias("b"), "values")
    return _in_runs(first.unionByName(arrivals), *BLOCK, "run").mapInArrow(_meet(due), _OUT)
