"""Arrow batches and Python workers are few and small, so their memory does not follow the input."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from elastrain.catalog import training
from elastrain.llm import bpe
from elastrain.plans.learners import LinearSoftmax
from elastrain.plans.parameters import init_weights, layer_table
from elastrain.plans.scoring import gradient, score

ROWS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
LEARNER = LinearSoftmax(4, 2)


def samples(spark):
    return spark.range(10).select(F.array(*[F.lit(0.5)] * 4).alias("data"), F.lit(1.0).alias("label"))


@pytest.mark.parametrize("step", [
    lambda spark, w: training.trigram_samples(spark, "/root/testdata/sf0.001"),
    lambda spark, w: score(samples(spark), w, LEARNER),
    lambda spark, w: gradient(samples(spark), w, LEARNER),
])
def test_training_bounds_its_batches(spark, step):
    spark.conf.set(ROWS, "10000")
    spark.conf.set(BYTES, str(256 << 20))
    weights = init_weights(layer_table(spark, LEARNER.layers()), 1)
    assert step(spark, weights).count() > 0
    assert int(spark.conf.get(ROWS)) <= 2000 and int(spark.conf.get(BYTES)) <= 8 << 20


def test_a_round_trip_takes_one_python_worker(spark):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.createDataFrame([(1, "the old é text"), (2, None), (2, ""), (None, "x" * 300)], "doc_id bigint, text string")
    trip = bpe.round_trip(docs, path)
    assert trip._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    want = bpe.decode(bpe.encode(docs, path), path)
    assert sorted(trip.collect(), key=str) == sorted(want.collect(), key=str)
    assert {(r.doc_id, bytes(r.decoded).decode()) for r in trip.collect()} == {(i, t or "") for i, t in docs.collect()}
