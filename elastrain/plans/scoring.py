"""Scores, full-batch gradients and evaluation of a model over a table of samples.

A model travels to the tasks in slabs of at most ``SLAB_BYTES``: whole rows of a layer's weights. The
samples stay where they are and meet all slabs in one pass of Arrow batches, so results do not depend
on the size of the model, and rows keep their ids, whatever these are. A task holds the model once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastrain.functions.arrow import as_matrix
from elastrain.operators.aggregates import accuracy_and_loss, vector_sums
from elastrain.operators.weights import BLOCK, CHUNK
from elastrain.plans.learners import Dense, Learner, LinearSoftmax, softmax_errors
from elastrain.session import bounded_batches, materialise

SLAB_BYTES = 64 * 1024 * 1024
Slabs = list[tuple[Dense, list[Broadcast]]]


def to_arrays(learner: Learner, weights: DataFrame) -> list[np.ndarray]:
    """The blobs of a model as arrays on the driver."""
    blocks: dict[int, list] = {spec.layer: [] for spec in learner.layers()}
    for row in weights.select(*BLOCK, "values").collect():
        blocks[row["layer"]].append((row["chunk"], row["values"]))
    params = [np.array([v for _, values in sorted(blocks[s.layer]) for v in values], dtype=np.float64) for s in learner.layers()]
    for spec, values in zip(learner.layers(), params):
        if len(values) != spec.size:
            raise ValueError(f"layer {spec.name} has {len(values)} values, {spec.size} expected")
    return params


def _values(weights: DataFrame, layer: int, start: int, stop: int) -> np.ndarray:
    """Values ``start`` .. ``stop`` - 1 of a layer; only the chunks that hold them reach the driver."""
    first = start // CHUNK
    rows = weights.where((F.col("layer") == layer) & F.col("chunk").between(first, (stop - 1) // CHUNK))
    blocks = sorted((r["chunk"], r["values"]) for r in rows.select("chunk", "values").collect())
    found = np.concatenate([np.asarray(v, dtype=np.float64) for _, v in blocks] or [np.zeros(0)])[start - first * CHUNK:]
    if len(found) < stop - start or [c for c, _ in blocks] != list(range(first, first + len(blocks))):
        raise ValueError(f"layer {layer} has no values {start} to {stop - 1}")
    return found[:stop - start]


def send_out(weights: DataFrame, learner: Learner, limit: int = SLAB_BYTES) -> Slabs:
    """The dense layers of a model as broadcast slabs (weight rows, biases) of at most ``limit`` bytes, or one row."""
    sizes = {spec.layer: spec.size for spec in learner.layers()}
    totals = {r["layer"]: r["n"] for r in weights.groupBy("layer").agg(F.sum(F.size("values")).alias("n")).collect()}
    for layer, size in sizes.items():
        if totals.get(layer, 0) != size:
            raise ValueError(f"layer {layer} has {totals.get(layer, 0)} values, {size} expected")
    sc, out = weights.sparkSession.sparkContext, []
    for layer in learner.dense_layers():
        rows, step = sizes[layer.bias], max(1, limit // (8 * (layer.width + 1)))
        slabs = []
        for at in range(0, rows, step):
            end = min(rows, at + step)
            w = _values(weights, layer.weight, at * layer.width, end * layer.width).reshape(end - at, layer.width)
            slabs.append(sc.broadcast((w, _values(weights, layer.bias, at, end))))
        out.append((layer, slabs))
    return out


def forward(slabs: Slabs, x: np.ndarray) -> np.ndarray:
    """Class scores of each row of ``x``."""
    for layer, parts in slabs:
        x = np.concatenate([x @ w.T + b for w, b in (p.value for p in parts)], axis=1)
        x = np.maximum(x, 0.0) if layer.relu else x
    return x


def score(df: DataFrame, weights: DataFrame, learner: Learner, limit: int = SLAB_BYTES) -> DataFrame:
    """``df`` (data, ...) with a column ``scores``, one double per class; every row is kept as it is."""
    slabs, width = send_out(weights, learner, limit), learner.n_features
    bounded_batches(df.sparkSession)

    @F.arrow_udf("array<double>")
    def scored(data: pa.Array) -> pa.Array:
        found = forward(slabs, as_matrix(data, width))
        offsets = np.arange(len(data) + 1, dtype=np.int32) * found.shape[1]
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.ravel()))

    return df.withColumn("scores", scored("data"))


def gradient(df: DataFrame, weights: DataFrame, learner: LinearSoftmax, limit: int = SLAB_BYTES) -> DataFrame:
    """Sum over all samples of the softmax gradient, as (layer, chunk, values); divide by the row count.

    Layer -1 holds (sum of losses, rows).
    """
    slabs = send_out(weights, learner, limit)
    schema = pa.schema([("layer", pa.int32()), ("chunk", pa.int32()), ("values", pa.list_(pa.float64()))])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grads, stats = [np.zeros(s.size) for s in learner.layers()], np.zeros(2)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = as_matrix(batch.column("data"), learner.n_features)
            y = batch.column("label").to_numpy(zero_copy_only=False)
            losses, errors = softmax_errors(forward(slabs, x), y)
            grads[0] += (errors.T @ x).ravel()
            grads[1] += errors.sum(axis=0)
            stats += (losses.sum(), len(y))
        rows = [(-1, 0, stats)]
        for spec, g in zip(learner.layers(), grads):
            rows += [(spec.layer, c, g[at:at + CHUNK]) for c, at in enumerate(range(0, spec.size, CHUNK))]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in rows], type=schema.field(i).type) for i in range(3)], schema=schema)

    bounded_batches(df.sparkSession)
    parts = df.select("data", "label").mapInArrow(partial, "layer int, chunk int, values array<double>")
    return vector_sums(parts, BLOCK)


def sgd_step(df: DataFrame, state: DataFrame, learner: LinearSoftmax, rate: float, momentum: float = 0.0,
             weight_decay: float = 0.0, limit: int = SLAB_BYTES) -> DataFrame:
    """One full-batch step on a state table (layer, chunk, values, velocity); the model stays a table."""
    # As large as the model, and read twice below.
    grads = materialise(gradient(df, state, learner, limit), "gradient")
    rows = grads.where(F.col("layer") == -1).select(F.col("values")[1].alias("rows")).scalar()
    multipliers = {s.layer: (s.lr_mult, s.decay_mult) for s in learner.layers()}

    def of_layer(i):
        cases = F.lit(None).cast("double")
        for layer, pair in multipliers.items():
            cases = F.when(F.col("layer") == layer, F.lit(pair[i])).otherwise(cases)
        return cases

    joined = state.join(grads.select(*BLOCK, F.col("values").alias("g")), BLOCK).withColumns(
        {"_rows": rows, "_lr": F.lit(rate) * of_layer(0), "_wd": F.lit(weight_decay) * of_layer(1)})
    pull = F.zip_with("g", "values", lambda g, w: F.col("_lr") * (g / F.col("_rows") + F.col("_wd") * w))
    moved = joined.withColumn("velocity", F.zip_with("velocity", pull, lambda v, p: v * F.lit(momentum) + p))
    return moved.select(*BLOCK, F.zip_with("values", "velocity", lambda w, v: w - v).alias("values"), "velocity")


def evaluate(df: DataFrame, weights: DataFrame, learner: Learner, ks: tuple[int, ...] = (1,), limit: int = SLAB_BYTES) -> DataFrame:
    """Top-k accuracies and mean loss of a model over all of ``df``."""
    return accuracy_and_loss(score(df, weights, learner, limit), "scores", "label", ks)
