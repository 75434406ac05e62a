"""Shuffles, shards, epochs and batches of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastrain.functions.hashing import hash_key, shard_of
from elastrain.functions.scores import best_classes
from elastrain.operators.numbering import number_by_hash


def random_order(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """A seeded global permutation as a sorted table (range partitioned, no single-task sort)."""
    key = hash_key(seed, *[F.col(c) for c in ids])
    return df.withColumn("_key", key).orderBy("_key", *ids).drop("_key")


def random_positions(df: DataFrame, ids: list[str], seed: int) -> DataFrame:
    """The place of every row in ``random_order``, from 0."""
    keyed = df.withColumn("_key", hash_key(seed, *[F.col(c) for c in ids]))
    return number_by_hash(keyed, [], "_key", "place").withColumn("place", F.col("place") - 1).drop("_key")


def assign_workers(df: DataFrame, ids: list[str], n_workers: int, seed: int) -> DataFrame:
    """Shard number by hash of the id: no shuffle, and even shards for any ids."""
    return df.withColumn("worker", shard_of([F.col(c) for c in ids], n_workers, seed))


def repartition_workers(df: DataFrame, n_workers: int) -> DataFrame:
    """One Spark partition per worker where the partition count itself is wanted."""
    return df.repartitionById(n_workers, F.col("worker"))


def epoch_shuffle(df: DataFrame, ids: list[str], seed: int, epoch: int, digits: int | None = None) -> DataFrame:
    """Position (from 1) of every row in its worker's shuffled epoch, and the shard size."""
    keyed = df.withColumn("_key", hash_key(seed, epoch, *[F.col(c) for c in ids]))
    return number_by_hash(keyed, ["worker"], "_key", "pos", "shard_rows", digits).drop("_key")


def drop_remainder(df: DataFrame, batch: int) -> DataFrame:
    """Rows of the full batches of a shuffled shard; a shard smaller than one batch is an error."""
    small = F.raise_error(F.concat(F.lit("shard smaller than one batch: worker "), F.col("worker").cast("string")))
    kept = F.col("shard_rows") - F.pmod(F.col("shard_rows"), F.lit(batch))
    limit = F.when(F.col("shard_rows") < batch, small.cast("bigint")).otherwise(kept)
    return df.where(F.col("pos") <= limit)


def assign_batches(df: DataFrame, batch: int) -> DataFrame:
    """Batch number inside the epoch (from 0) and the number of full batches of the shard."""
    return df.withColumn("batch", F.floor((F.col("pos") - 1) / batch)).withColumn(
        "batches", F.floor(F.col("shard_rows") / batch)
    )


def pack_batches(df: DataFrame, batch: int) -> DataFrame:
    """One row per (worker, batch): flat value buffer and label buffer in position order.

    A group holds at most one batch. Samples without a shape give a null buffer.
    """
    rows = F.array_sort(F.collect_list(F.struct("pos", "data", "label", "dim")))
    packed = df.groupBy("worker", "batch").agg(rows.alias("rows"))
    shaped = F.forall("rows", lambda r: r["dim"].isNotNull())
    return packed.select(
        "worker",
        "batch",
        F.size("rows").alias("size"),
        F.when(shaped, F.flatten(F.transform("rows", lambda r: r["data"]))).alias("data"),
        F.when(shaped, F.transform("rows", lambda r: r["label"])).alias("label"),
    )


def shard_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("worker").agg(F.count(F.lit(1)).alias("n"))


def top_k_classes(df: DataFrame, ids: list[str], scores: str, k: int) -> DataFrame:
    """The ``k`` best classes of each row as (rank, class, score) rows; no shuffle."""
    best = df.select(*ids, F.posexplode(best_classes(F.col(scores), k)).alias("rank", "best"))
    return best.select(*ids, (F.col("rank") + 1).alias("rank"), F.col("best.cls").alias("cls"), F.col("best.score").alias("score"))


def number_batches(df: DataFrame, ids: list[str], seed: int, batch: int) -> DataFrame:
    """Batch number (from 0) of each row in one seeded order of the whole table, and the full batches."""
    keyed = df.withColumn("_key", hash_key(seed, *[F.col(c) for c in ids]))
    numbered = number_by_hash(keyed, [], "_key", "_place", "_rows")
    return numbered.withColumns(
        {"batch": F.floor((F.col("_place") - 1) / batch), "batches": F.floor(F.col("_rows") / batch)}
    ).drop("_key", "_place", "_rows")
