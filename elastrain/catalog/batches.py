"""Shuffle, shard, epoch, batch and counting queries."""

from pyspark.sql import functions as F

from elastrain.catalog.common import (
    BATCH, SEED, SQL_BATCHED, SQL_SHARDED, SQL_SHUFFLED, WORKERS, batched, samples, sharded, shuffled,
)
from elastrain.catalog.registry import query, table
from elastrain.operators import batching as B
from elastrain.operators.aggregates import count_samples
from elastrain.operators.sync_points import iteration_plan


@query("random_order", f"""
SELECT doc_id, source, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id)) - 1 AS place FROM documents""")
def random_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return B.random_positions(docs, ["doc_id"], SEED)


@query("random_order_labelled", f"""
SELECT doc_id, quality, toxic, row_number() OVER (ORDER BY md5('{SEED}:' || doc_id)) - 1 AS place FROM labels""")
def random_order_labelled(spark, sf_dir):
    return B.random_positions(table(spark, sf_dir, "labels"), ["doc_id"], SEED)


@query("sorted_shuffle", f"""
SELECT vec_id AS id, label::double AS label FROM embeddings ORDER BY md5('{SEED}:' || vec_id)""")
def sorted_shuffle(spark, sf_dir):
    """The global permutation as a sorted table."""
    rows = samples(spark, sf_dir).select("id", F.col("label").cast("double").alias("label"))
    return B.random_order(rows, ["id"], SEED)


@query("epoch_shuffle", f"WITH {SQL_SHUFFLED} SELECT id, worker, pos, shard_rows FROM shuffled")
def epoch_shuffle(spark, sf_dir):
    return shuffled(spark, sf_dir).select("id", "worker", "pos", "shard_rows")


@query("drop_remainder", f"WITH {SQL_BATCHED} SELECT id, worker, pos FROM batched")
def drop_remainder(spark, sf_dir):
    return B.drop_remainder(shuffled(spark, sf_dir), BATCH).select("id", "worker", "pos")


@query("assign_batches", f"WITH {SQL_BATCHED} SELECT id, worker, pos, batch, batches FROM batched")
def assign_batches(spark, sf_dir):
    return batched(spark, sf_dir).select("id", "worker", "pos", "batch", "batches")


@query("pack_batches", f"""
WITH {SQL_BATCHED}, packed AS (
  SELECT worker, batch, count(*) AS size, flatten(list(data ORDER BY pos)) AS data, list(label ORDER BY pos) AS labels
  FROM batched GROUP BY worker, batch)
SELECT worker, batch, size::int AS size, len(data)::int AS n,
       round(list_sum(list_transform(data, lambda x, i: x::double * i)), 6) + 0.0 AS data_checksum,
       list_sum(list_transform(labels, lambda x, i: x::double * i)) AS label_checksum
FROM packed""")
def pack_batches(spark, sf_dir):
    packed = B.pack_batches(batched(spark, sf_dir), BATCH)

    def checksum(column):
        terms = F.transform(column, lambda x, i: x.cast("double") * (i + 1))
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)

    return packed.select(
        "worker", "batch", "size", F.size("data").alias("n"),
        (F.round(checksum("data"), 6) + 0.0).alias("data_checksum"), checksum("label").alias("label_checksum"),
    )


@query("worker_partitions", f"WITH {SQL_SHARDED} SELECT worker, worker AS partition, count(*) AS n FROM sharded GROUP BY worker")
def worker_partitions(spark, sf_dir):
    """One Spark partition per worker: the partition number is the worker number."""
    spread = B.repartition_workers(sharded(spark, sf_dir), WORKERS)
    return spread.select("worker", F.spark_partition_id().alias("partition")).groupBy("worker", "partition").agg(
        F.count(F.lit(1)).alias("n"))


@query("top_k_classes", """
WITH scores AS (
  SELECT vec_id AS id, unnest(embedding)::double AS score, unnest(range(64))::int AS cls FROM embeddings)
SELECT id, rank::int AS rank, cls, round(score, 6) + 0.0 AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, cls) AS rank FROM scores) WHERE rank <= 5""")
def top_k_classes(spark, sf_dir):
    """The values of each vector as scores of 64 classes."""
    scored = samples(spark, sf_dir).select("id", F.col("data").cast("array<double>").alias("scores"))
    return B.top_k_classes(scored, ["id"], "scores", 5).withColumn("score", F.round("score", 6) + 0.0)


@query("count_samples", """
SELECT 'embeddings' AS name, count(*) AS n FROM embeddings UNION ALL
SELECT 'lineitem', count(*) FROM lineitem UNION ALL SELECT 'events', count(*) FROM events""")
def count_samples_query(spark, sf_dir):
    names = ["embeddings", "lineitem", "events"]
    counted = [count_samples(table(spark, sf_dir, n)).select(F.lit(n).alias("name"), "n") for n in names]
    return counted[0].union(counted[1]).union(counted[2])


@query("shard_sizes", f"WITH {SQL_SHARDED} SELECT worker, count(*) AS n FROM sharded GROUP BY worker")
def shard_sizes(spark, sf_dir):
    return B.shard_sizes(sharded(spark, sf_dir))


@query("shard_sizes_by_user", "SELECT user_id AS worker, count(*) AS n FROM events GROUP BY user_id")
def shard_sizes_by_user(spark, sf_dir):
    return B.shard_sizes(table(spark, sf_dir, "events").withColumnRenamed("user_id", "worker"))


@query("iteration_plan", f"""
WITH {SQL_SHARDED}, sizes AS (SELECT worker, count(*) AS n FROM sharded GROUP BY worker)
SELECT worker, n, (2000 * n // (SELECT count(*) FROM sharded)) // 10 AS steps FROM sizes""")
def iteration_plan_query(spark, sf_dir):
    return iteration_plan(sharded(spark, sf_dir), iterations=2000, k=10)


@query("iteration_plan_by_supplier", """
WITH sizes AS (SELECT l_suppkey AS worker, count(*) AS n FROM lineitem GROUP BY l_suppkey)
SELECT worker, n, (100000 * n // (SELECT count(*) FROM lineitem)) // 10 AS steps FROM sizes""")
def iteration_plan_by_supplier(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("worker"))
    return iteration_plan(rows, iterations=100000, k=10)
