"""Saved weights and the training log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.schema import TRAINING_LOG


def save_weights(weights: DataFrame, path: str, tag: str, again: bool = False) -> None:
    """The whole weight table in single precision under its tag; a tag is written once, unless ``again``."""
    stored = weights.select("layer", "chunk", F.col("values").cast("array<float>").alias("values"))
    stored.write.mode("overwrite" if again else "errorifexists").parquet(f"{path}/tag={tag}")


def save_tagged(weights: DataFrame, path: str, tag: Column) -> None:
    """Several weight tables in one go, each under the tag of its rows; what the path held is replaced."""
    stored = weights.select("layer", "chunk", F.col("values").cast("array<float>").alias("values"), tag.alias("tag"))
    stored.write.mode("overwrite").partitionBy("tag").parquet(path)


def load_weights(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Weights saved under one tag; the other tags are pruned away."""
    saved = spark.read.parquet(path).where(F.col("tag") == tag)
    return saved.select("layer", "chunk", F.col("values").cast("array<double>").alias("values"))


def centre_tag(update_no: int) -> str:
    return f"state_iter_{update_no}.weight"


def centre_tags(update_no: str) -> Column:
    """The tag of every row, by its column ``update_no``."""
    return F.concat(F.lit("state_iter_"), F.col(update_no), F.lit(".weight"))


def worker_tag(iteration: int) -> str:
    return f"state_worker_iter_{iteration}.weight"


def write_training_log(log: DataFrame, path: str) -> None:
    """Append typed log rows."""
    typed = [F.col(f.name).cast(f.dataType).alias(f.name) for f in TRAINING_LOG.fields]
    log.select(*typed).write.mode("append").parquet(path)


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRAINING_LOG).parquet(path)
