"""Column expressions over the value array of a sample (channel-major: channel, row, column)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scaled(data: Column, by: float = 255.0) -> Column:
    """Every value divided by ``by``, kept in single precision."""
    return F.transform(data, lambda x: (x / F.lit(by)).cast("float"))


def centred(data: Column, count_label: bool = False) -> Column:
    """Every value minus the mean of its own sample.

    ``count_label`` divides the sum by one more than the number of values, as the text loader of
    colour images does when it counts the label column.
    """
    width = F.size(data) + F.lit(1 if count_label else 0)
    total = F.aggregate(data, F.lit(0.0), lambda acc, x: acc + x)
    # The mean rides along as a one-element array so that it is computed once per sample.
    means = F.array(F.when(width > 0, total / width))
    return F.flatten(F.transform(means, lambda m: F.transform(data, lambda x: x - m)))


def quantised(data: Column) -> Column:
    """Value toward zero as a 32-bit integer (saturating, NaN gives 0), low eight bits kept."""
    low, high = F.lit(-2147483648.0), F.lit(2147483647.0)
    return F.transform(
        data,
        lambda x: F.greatest(low, F.least(high, F.nanvl(x.cast("double"), F.lit(0.0))))
        .cast("int")
        .bitwiseAND(F.lit(255)),
    )


def minus_channel_means(data: Column, means: list[float], plane: int) -> Column:
    """Subtract one constant per channel; ``plane`` is height times width."""
    table = F.array(*[F.lit(float(m)) for m in means])
    return F.transform(data, lambda x, i: x - F.get(table, F.floor(i / plane).cast("int")))


def window_cut(data: Column, height: int, width: int, size: int, top: Column, left: Column) -> Column:
    """The ``size`` x ``size`` window at (top, left) of every channel."""

    def inside(_, i):
        row = F.floor(F.pmod(i, F.lit(height * width)) / width)
        column = F.pmod(i, F.lit(width))
        return (row >= top) & (row < top + size) & (column >= left) & (column < left + size)

    return F.filter(data, inside)


def flipped(data: Column, width: int) -> Column:
    """Every row of every channel reversed."""
    last = F.lit(width - 1)
    return F.transform(data, lambda _, i: F.get(data, (i - F.pmod(i, F.lit(width)) * 2 + last).cast("int")))


@F.arrow_udf(T.ArrayType(T.ShortType()))
def decode_u8(payload: pa.Array) -> pa.Array:
    """Bytes as numbers 0..255, one Arrow buffer at a time."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(payload), 0).to_numpy(zero_copy_only=False)
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    flat = b"".join(payload.drop_null().to_pylist())
    values = pa.array(np.frombuffer(flat, dtype=np.uint8).astype(np.int16))
    return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.compute.is_null(payload))


@F.arrow_udf(T.BinaryType())
def encode_u8(values: pa.Array) -> pa.Array:
    """Numbers 0..255 as bytes; the inverse of ``decode_u8``."""
    sizes = pa.compute.fill_null(pa.compute.list_value_length(values), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()
    known = pa.compute.is_valid(values).to_pylist()
    return pa.array(
        [flat[e - s:e] if ok else None for s, e, ok in zip(sizes, ends, known)], type=pa.binary()
    )
