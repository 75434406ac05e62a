import random

import pytest
from pyspark.sql import functions as F

from elastrain.operators import weights as M


def layers(spark, *sizes, seed=0, size=4):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(n)]) for i, n in enumerate(sizes)]
    return rows, M.chunked(spark.createDataFrame(rows, "layer int, values array<double>"), size=size)


def flat(df, values="values"):
    rows = sorted(df.select("layer", "chunk", values).collect(), key=lambda r: (r["layer"], r["chunk"]))
    out = {}
    for r in rows:
        out.setdefault(r["layer"], []).extend(r[values])
    return out


def close(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert a[k] == pytest.approx(b[k])


def test_chunks_keep_every_value(spark):
    rows, w = layers(spark, 10, 4, 1)
    assert flat(w) == {i: v for i, v in rows}
    assert {r["layer"]: r["size"] for r in M.layer_sizes(w).collect()} == {0: 10, 1: 4, 2: 1}


def test_adding_then_subtracting_is_identity(spark):
    _, a = layers(spark, 10, 4, seed=1)
    _, b = layers(spark, 10, 4, seed=2)
    close(flat(M.sub_weights(a, M.add_weights(a, b))), flat(b))


@pytest.mark.parametrize("sizes", [(10,), (10, 5), (10, 4, 1)])
def test_unequal_shapes_are_an_error(spark, sizes):
    _, a = layers(spark, 10, 4)
    _, b = layers(spark, *sizes)
    with pytest.raises(Exception, match="Size mismatch"):
        M.add_weights(a, b).collect()


@pytest.mark.parametrize("offset, n", [(0, 3), (3, 4), (7, 3), (0, 10)])
def test_slices_and_patches(spark, offset, n):
    rows, w = layers(spark, 10, 4)
    cut = M.slice_weights(w, offset, n, layer=0, size=4).orderBy("idx").collect()
    assert [r["value"] for r in cut] == rows[0][1][offset:offset + n]
    patch = spark.createDataFrame([(0, offset + i, 100.0 + i) for i in range(n)], "layer int, idx long, value double")
    patched = flat(M.patch_weights(w, patch, size=4))
    assert patched[0] == rows[0][1][:offset] + [100.0 + i for i in range(n)] + rows[0][1][offset + n:]
    assert patched[1] == rows[1][1]


@pytest.mark.parametrize("layer, idx", [(0, 10), (0, 12), (5, 0)])
def test_patch_outside_a_layer_is_an_error(spark, layer, idx):
    _, w = layers(spark, 10, 4)
    patch = spark.createDataFrame([(layer, idx, 1.0)], "layer int, idx long, value double")
    with pytest.raises(Exception, match="patch outside"):
        M.patch_weights(w, patch, size=4).collect()


def test_partition_covers_every_value_once(spark):
    sizes = spark.createDataFrame([(0, 10), (1, 2), (2, 0)], "layer int, size long")
    rows = M.partition_weights(sizes, 4).collect()
    for layer, size in ((0, 10), (1, 2), (2, 0)):
        covered = sorted(i for r in rows if r["layer"] == layer for i in range(r["offset"], r["offset"] + r["length"]))
        assert covered == list(range(size))


def test_exchange_at_zero_and_one(spark):
    _, a = layers(spark, 10, 4, seed=1)
    _, b = layers(spark, 10, 4, seed=2)
    same = M.elastic_exchange(a, b, 0.0)
    close(flat(same, "worker_values"), flat(a))
    close(flat(same, "centre_values"), flat(b))
    swapped = M.elastic_exchange(a, b, 1.0)
    close(flat(swapped, "worker_values"), flat(b))
    close(flat(swapped, "centre_values"), flat(a))


def test_one_arrival_equals_one_exchange(spark):
    _, a = layers(spark, 10, 4, seed=1)
    _, c = layers(spark, 10, 4, seed=2)
    met = M.elastic_exchange(a, c, 0.3, 0.5)
    folded = M.fold_exchanges(M.to_every_worker(a, 1).withColumns({"a": F.lit(0.3), "b": F.lit(0.15)}), c)
    close(flat(folded, "centre"), flat(met, "centre_values"))
    worker = folded.select("layer", "chunk", F.col("met")[0]["values"].alias("values"))
    close(flat(worker), flat(met, "worker_values"))


@pytest.mark.parametrize("b", [0.2, 1.0])
def test_fold_equals_closed_form(spark, b):
    _, c = layers(spark, 10, 4, seed=9)
    workers = None
    for n in range(5):
        w = layers(spark, 10, 4, seed=n)[1].withColumn("worker", F.lit(n))
        workers = w if workers is None else workers.unionByName(w)
    folded = M.fold_exchanges(workers.withColumns({"a": F.lit(0.1), "b": F.lit(b)}), c)
    arrivals = workers.withColumns({"n": F.col("worker") + 1, "total": F.lit(5)})
    close(flat(folded, "centre"), flat(M.fold_arrivals(arrivals, c, b)))


def test_fold_needs_the_centre_of_every_block(spark):
    _, c = layers(spark, 10)
    workers = M.to_every_worker(layers(spark, 10, 4)[1], 2).withColumns({"a": F.lit(0.1), "b": F.lit(0.1)})
    with pytest.raises(Exception, match="Size mismatch"):
        M.fold_exchanges(workers, c).collect()


def test_layer_names_without_blobs_are_skipped(spark):
    nets = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "layer_pos int, name string")
    named = spark.createDataFrame([("c", 0, [1.0]), ("a", 1, [2.0]), ("a", 0, [3.0]), ("x", 0, [4.0])], "name string, blob_no int, values array<double>")
    rows = M.weights_by_layer_name(nets, named).orderBy("idx").collect()
    assert [(r["idx"], r["name"], r["blob_no"]) for r in rows] == [(0, "a", 0), (1, "a", 1), (2, "c", 0)]


@pytest.mark.parametrize("values, layer", [([1.0, 2.0], 0), ([1.0, 2.0, 3.0, 4.0], 0), ([1.0, 2.0, 3.0], 7)])
def test_updates_of_another_shape_are_an_error(spark, values, layer):
    from elastrain.operators.weights import apply_deltas, fold_arrivals

    centre = spark.createDataFrame([(0, 0, [1.0, 1.0, 1.0])], "layer int, chunk int, values array<double>")
    pushed = spark.createDataFrame([(layer, 0, values, 1, 1)], "layer int, chunk int, values array<double>, n int, total int")
    for result in (apply_deltas(centre, pushed), fold_arrivals(pushed, centre, 0.5)):
        with pytest.raises(Exception, match="Size mismatch!"):
            result.collect()
