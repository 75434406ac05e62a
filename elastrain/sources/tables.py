"""Small tables and in-memory rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.schema import SAMPLE


def from_rows(spark: SparkSession, rows: list, n_partitions: int | None = None, schema=SAMPLE) -> DataFrame:
    """A short list of rows as a cached table."""
    df = spark.createDataFrame(rows, schema)
    if n_partitions:
        df = df.repartition(n_partitions)
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def worker_table(spark: SparkSession, n_workers: int) -> DataFrame:
    """One row per worker, each in a partition of its own."""
    return spark.range(0, n_workers, 1, n_workers).select(F.col("id").cast("int").alias("worker"))


def zero_samples(df: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """A placeholder for every row of ``df`` (id): all values and the label 0, for the TRAIN and the TEST source."""
    c, h, w = dims
    sources = F.explode(F.array(F.lit("TRAIN"), F.lit("TEST"))).alias("source")
    return df.select(
        "id", sources, F.array_repeat(F.lit(0.0).cast("float"), c * h * w).alias("data"),
        F.lit(0.0).cast("float").alias("label"), F.array(F.lit(c), F.lit(h), F.lit(w)).alias("dim"))
