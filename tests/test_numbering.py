"""Row numbers per group, with one group holding most rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from elastrain.functions.hashing import hash_key
from elastrain.operators import batching as B
from elastrain.operators.numbering import number_by_hash, number_by_value


def skewed(spark, n=900):
    rng = random.Random(3)
    rows = [(i, 0 if i % 3 else rng.randrange(5), rng.randrange(10**9)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id long, grp int, v long")


def test_number_by_hash_equals_a_sorted_group(spark):
    rows, df = skewed(spark)
    keyed = df.withColumn("key", hash_key("s", F.col("id")))
    got = {r["id"]: (r["pos"], r["n"]) for r in number_by_hash(keyed, ["grp"], "key", "pos", "n").collect()}
    groups = {}
    for i, g, _ in rows:
        groups.setdefault(g, []).append((hashlib.md5(f"s:{i}".encode()).hexdigest(), i))
    for members in groups.values():
        for pos, (_, i) in enumerate(sorted(members), 1):
            assert got[i] == (pos, len(members))


@pytest.mark.parametrize("n_cells", [2, 7, 200])
def test_number_by_value_equals_a_sorted_group(spark, n_cells):
    rows, df = skewed(spark)
    got = {r["id"]: r["pos"] for r in number_by_value(df, ["grp"], "v", ties=("id",), n_cells=n_cells).collect()}
    groups = {}
    for i, g, v in rows:
        groups.setdefault(g, []).append((v, i))
    for members in groups.values():
        for pos, (_, i) in enumerate(sorted(members), 1):
            assert got[i] == pos


def test_number_by_value_with_equal_values_and_no_group(spark):
    df = spark.createDataFrame([(i, 5.0 if i % 2 else 1.5) for i in range(40)], "id long, v double")
    got = [r["id"] for r in number_by_value(df, [], "v", ties=("id",)).orderBy("pos").collect()]
    assert got == [*range(0, 40, 2), *range(1, 40, 2)]


def test_number_by_value_of_an_empty_table(spark):
    df = spark.createDataFrame([], "id long, grp int, v long")
    assert number_by_value(df, ["grp"], "v").count() == 0


def test_null_group_is_an_error(spark):
    df = spark.createDataFrame([(1, None), (2, 1)], "id long, grp int").withColumn("key", hash_key(F.col("id")))
    with pytest.raises(Exception, match="null in a numbering group"):
        number_by_hash(df, ["grp"], "key").collect()


def test_epoch_is_a_permutation_and_batches_cover_rows_once(spark):
    df = B.assign_workers(spark.range(103), ["id"], 3, 1)
    shuffled = B.epoch_shuffle(df, ["id"], 1, 0)
    for worker, rows in shuffled.toPandas().groupby("worker"):
        assert sorted(rows["pos"]) == list(range(1, len(rows) + 1))
        assert set(rows["shard_rows"]) == {len(rows)}
    batched = B.assign_batches(B.drop_remainder(shuffled, 10), 10).toPandas()
    assert not batched["id"].duplicated().any()
    assert (batched.groupby(["worker", "batch"]).size() == 10).all()
    other = B.epoch_shuffle(df, ["id"], 1, 1).toPandas().set_index("id")["pos"]
    assert shuffled.toPandas().set_index("id")["pos"].to_dict() != other.to_dict()


@pytest.mark.parametrize("n, kept", [(10, 10), (11, 10), (20, 20)])
def test_drop_remainder_at_the_edges(spark, n, kept):
    df = spark.range(n).withColumn("worker", F.lit(0))
    assert B.drop_remainder(B.epoch_shuffle(df, ["id"], 1, 0), 10).count() == kept


def test_shard_smaller_than_a_batch_is_an_error(spark):
    df = spark.range(9).withColumn("worker", F.lit(0))
    with pytest.raises(Exception, match="shard smaller than one batch"):
        B.drop_remainder(B.epoch_shuffle(df, ["id"], 1, 0), 10).collect()


def test_random_order_follows_the_seed(spark):
    df = spark.range(200)
    first = [r["id"] for r in B.random_order(df, ["id"], 1).collect()]
    assert first == [r["id"] for r in B.random_order(df, ["id"], 1).collect()]
    assert first != [r["id"] for r in B.random_order(df, ["id"], 2).collect()]
    assert sorted(first) == list(range(200))


def test_worker_partitions(spark):
    df = B.assign_workers(spark.range(100), ["id"], 5, 1)
    spread = B.repartition_workers(df, 5)
    assert spread.rdd.getNumPartitions() == 5
    pairs = spread.select("worker", F.spark_partition_id().alias("p")).distinct().collect()
    assert all(r["worker"] == r["p"] for r in pairs)


def test_pack_batches_without_a_shape_gives_null(spark):
    rows = [(0, 0, 1, [1.0, 2.0], 3.0, [1, 1, 2]), (0, 0, 2, [3.0, 4.0], 4.0, [1, 1, 2]), (0, 1, 3, [5.0, 6.0], 5.0, None)]
    df = spark.createDataFrame(rows, "worker int, batch long, pos long, data array<float>, label float, dim array<int>")
    packed = {r["batch"]: r for r in B.pack_batches(df, 2).collect()}
    assert packed[0]["data"] == [1.0, 2.0, 3.0, 4.0] and packed[0]["label"] == [3.0, 4.0]
    assert packed[1]["data"] is None and packed[1]["size"] == 1


def test_top_k_takes_the_lower_class_among_equals(spark):
    df = spark.createDataFrame([(1, [0.5, 0.9, 0.9, 0.1])], "id long, scores array<double>")
    assert [r["cls"] for r in B.top_k_classes(df, ["id"], "scores", 3).orderBy("rank").collect()] == [1, 2, 0]
