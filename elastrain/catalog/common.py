"""Inputs and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.catalog.registry import table
from elastrain.operators.batching import assign_batches, assign_workers, drop_remainder, epoch_shuffle
from elastrain.operators.samples import long_form, to_record

SEED = 7
WORKERS = 4
BATCH = 10


def samples(spark: SparkSession, sf_dir: str, dims: tuple[int, int, int] = (1, 8, 8)) -> DataFrame:
    """The embeddings as samples: id, data (64 floats), label, dim."""
    rows = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id")
    return to_record(rows, "embedding", "label", dims, keep=["id"])


def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_workers(samples(spark, sf_dir), ["id"], WORKERS, SEED)


def shuffled(spark: SparkSession, sf_dir: str, epoch: int = 0) -> DataFrame:
    return epoch_shuffle(sharded(spark, sf_dir), ["id"], SEED, epoch)


def batched(spark: SparkSession, sf_dir: str, batch: int = BATCH) -> DataFrame:
    return assign_batches(drop_remainder(shuffled(spark, sf_dir), batch), batch)


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as a loss log: worker, the order of its entries, loss and clock."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("worker"), F.col("event_id").alias("entry"), F.col("value").alias("loss"), "ts"
    )


def values_of(df: DataFrame, keep: list[str], digits: int | None = 6) -> DataFrame:
    """Long form for comparison: doubles, rounded, without negative zero."""
    value = F.col("value").cast("double")
    value = value if digits is None else F.round(value, digits)
    return long_form(df, keep).select(*keep, F.col("j").cast("bigint").alias("j"), (value + F.lit(0.0)).alias("value"))


# SQL twins of the inputs above.
def sql_worker(id_: str) -> str:
    return f"(('0x' || substr(md5('{SEED}:shard:' || {id_}), 1, 8))::bigint % {WORKERS})::int"


SQL_SHARDED = f"""sharded AS (
  SELECT vec_id AS id, embedding AS data, label, {sql_worker('vec_id')} AS worker FROM embeddings)"""

SQL_SHUFFLED = f"""{SQL_SHARDED}, shuffled AS (
  SELECT *, row_number() OVER (PARTITION BY worker ORDER BY md5('{SEED}:0:' || id)) AS pos,
         count(*) OVER (PARTITION BY worker) AS shard_rows FROM sharded)"""

SQL_BATCHED = f"""{SQL_SHUFFLED}, batched AS (
  SELECT *, (pos - 1) // {BATCH} AS batch, shard_rows // {BATCH} AS batches FROM shuffled
  WHERE pos <= shard_rows - shard_rows % {BATCH})"""

SQL_LOG = """log AS (
  SELECT user_id AS worker, event_id AS entry, value AS loss, ts,
         row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS iter FROM events)"""


def sql_values(source: str, expr: str, keep: str = "vec_id AS id", digits: int | None = 6) -> str:
    """Long form of a list expression over a table, as ``values_of`` gives it."""
    value = "value::double" if digits is None else f"round(value::double, {digits})"
    names = ", ".join(part.split(" AS ")[-1].strip() for part in keep.split(","))
    return f"""
SELECT {names}, j, {value} + 0.0 AS value FROM (
  SELECT {names}, unnest(xs) AS value, unnest(range(len(xs)))::bigint AS j
  FROM (SELECT {keep}, {expr} AS xs FROM {source}))"""
