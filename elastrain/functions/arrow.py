"""Small helpers for functions that see Arrow batches inside a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

Columns = dict[str, np.ndarray]


def as_matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """A list column, or one of bytes, as a (rows, width) matrix of doubles."""
    if pa.types.is_binary(column.type):
        flat = np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).astype(np.float64)
    else:
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(flat) != len(column) * width:
        raise ValueError(f"samples must have {width} values each")
    return flat.reshape(len(column), width)


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches in which all columns stay the same."""
    n = len(columns[0])
    changed = np.zeros(n - 1, dtype=bool)
    for c in columns:
        changed |= c[1:] != c[:-1]
    edges = [0, *(np.flatnonzero(changed) + 1), n]
    yield from zip(edges[:-1], edges[1:])


def groups_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[Columns]:
    """Consecutive rows with equal keys, whole even where a group spans batches."""
    pieces: list[Columns] = []
    current = None

    def joined():
        return {name: np.concatenate([p[name] for p in pieces]) for name in pieces[0]}

    for batch in batches:
        if batch.num_rows == 0:
            continue
        columns = {name: batch.column(name).to_numpy(zero_copy_only=False) for name in batch.schema.names}
        for lo, hi in runs(*[columns[k] for k in keys]):
            key = tuple(columns[k][lo] for k in keys)
            if pieces and key != current:
                yield joined()
                pieces = []
            current = key
            pieces.append({name: values[lo:hi] for name, values in columns.items()})
    if pieces:
        yield joined()


def tables_of(parts: Iterator[Columns], schema: pa.Schema, rows: int = 10000) -> Iterator[pa.RecordBatch]:
    """Column pieces as record batches of at least ``rows`` rows."""
    waiting, size = [], 0
    for part in parts:
        waiting.append(part)
        size += len(part[schema.names[0]])
        if size >= rows:
            yield _table(waiting, schema)
            waiting, size = [], 0
    if waiting:
        yield _table(waiting, schema)


def _table(parts: list[Columns], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array(np.concatenate([p[f.name] for p in parts]), type=f.type) for f in schema]
    return pa.RecordBatch.from_arrays(columns, schema=schema)
