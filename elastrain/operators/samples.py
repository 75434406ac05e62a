"""Row-wise work on samples (id, data, label, dim)."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastrain.functions import arrays
from elastrain.functions.hashing import coin
from elastrain.operators.aggregates import vector_sums


def to_record(df: DataFrame, data: str, label: str, dims: tuple[int, int, int], keep: list[str]) -> DataFrame:
    """(label, payload) rows as samples with a shape."""
    return df.select(
        *keep, F.col(data).alias("data"), F.col(label).cast("float").alias("label"),
        F.array(*[F.lit(d) for d in dims]).alias("dim"),
    )


def filter_label_below(df: DataFrame, n: int) -> DataFrame:
    return df.where(F.col("label") < n)


def scale_pixels(df: DataFrame, by: float = 255.0) -> DataFrame:
    return df.withColumn("data", arrays.scaled(F.col("data"), by))


def centre_per_record(df: DataFrame, include_label_in_divisor: bool = False) -> DataFrame:
    return df.withColumn("data", arrays.centred(F.col("data"), include_label_in_divisor))


def quantise_u8(df: DataFrame, warn: bool = False) -> DataFrame:
    """Values and label as stored numbers; ``warn`` spends one job on finding scaled input."""
    if warn:
        top = df.agg(F.max(F.array_max("data"))).first()[0]
        if top is not None and top <= 1:
            warnings.warn("values do not exceed 1: quantising leaves only zeros and ones")
    return df.withColumn("data", arrays.quantised(F.col("data"))).withColumn("label", F.col("label").cast("int"))


def mean_image(df: DataFrame) -> DataFrame:
    """Element-wise mean over all samples, as one row.

    Each sample carries a trailing 1, so the count is summed along with the values.
    """
    counted = df.select(F.concat(F.col("data").cast("array<double>"), F.array(F.lit(1.0))).alias("data"))
    sums = vector_sums(counted, [], "data")
    count = F.element_at("data", -1)
    return sums.where(F.size("data") > 0).select(
        F.transform(F.slice("data", F.lit(1), F.size("data") - 1), lambda x: x / count).alias("mean"))


def subtract_mean_image(df: DataFrame, mean: DataFrame) -> DataFrame:
    """Subtract a one-row mean image. The row is one sample wide, so it is sent as a scalar subquery."""
    with_mean = df.withColumn("_mean", mean.select("mean").scalar())
    return with_mean.withColumn("data", F.zip_with("data", "_mean", lambda x, m: x - m)).drop("_mean")


def subtract_channel_mean(df: DataFrame, means: list[float], plane: int) -> DataFrame:
    return df.withColumn("data", arrays.minus_channel_means(F.col("data"), means, plane))


def crop(df: DataFrame, size: int, height: int, width: int, mode: str, ids: list[str] = (), seed: int = 0, epoch: int = 0) -> DataFrame:
    """A ``size`` x ``size`` window of every channel: centre, or drawn from (seed, epoch, id)."""
    if size > height or size > width:
        raise ValueError("crop is larger than the sample")
    if mode == "centre":
        top, left = F.lit((height - size) // 2), F.lit((width - size) // 2)
    elif mode == "random":
        keys = [F.col(c) for c in ids]
        top = coin(keys, seed, epoch, "top", height - size + 1)
        left = coin(keys, seed, epoch, "left", width - size + 1)
    else:
        raise ValueError(f"unknown crop mode {mode!r}")
    cut = df.withColumns({"_top": top, "_left": left})
    cut = cut.withColumn("data", arrays.window_cut(F.col("data"), height, width, size, F.col("_top"), F.col("_left")))
    if "dim" in df.columns:
        cut = cut.withColumn("dim", F.array(F.get("dim", 0), F.lit(size), F.lit(size)))
    return cut.drop("_top", "_left")


def mirror(df: DataFrame, width: int, ids: list[str], seed: int, epoch: int, sides: int = 2) -> DataFrame:
    """Flip a sample left to right when its coin shows 0 (one in ``sides``; 1 flips all)."""
    heads = coin([F.col(c) for c in ids], seed, epoch, "mirror", sides) == 0
    return df.withColumn("data", F.when(heads, arrays.flipped(F.col("data"), width)).otherwise(F.col("data")))


def label_and_width(df: DataFrame, keep: list[str] = ()) -> DataFrame:
    return df.select(*keep, "label", F.size("data").alias("n"))


def long_form(df: DataFrame, keep: list[str], data: str | Column = "data") -> DataFrame:
    """One row per value: (keep..., j, value)."""
    column = F.col(data) if isinstance(data, str) else data
    return df.select(*keep, F.posexplode(column).alias("j", "value"))
