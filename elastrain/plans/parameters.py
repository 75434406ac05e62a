"""Layer tables: multipliers and start values."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.functions.hashing import hash_key, hash_number
from elastrain.operators.weights import CHUNK
from elastrain.schema import LayerSpec

# Multipliers of a weight blob and of a bias blob.
LR_MULT = {"weight": 1.0, "bias": 2.0}
DECAY_MULT = {"weight": 1.0, "bias": 0.0}


def multiplied_rates(layers: DataFrame, lr: float, weight_decay: float) -> DataFrame:
    """Learning rate and weight decay of each layer; ``layers`` has layer and bias."""

    def times(table):
        return F.when(F.col("bias"), F.lit(table["bias"])).otherwise(F.lit(table["weight"]))

    return layers.select(
        "layer", "bias", (F.lit(lr) * times(LR_MULT)).alias("lr"), (F.lit(weight_decay) * times(DECAY_MULT)).alias("decay"))


def layer_table(spark: SparkSession, specs: list[LayerSpec]) -> DataFrame:
    """A net's blobs as rows (layer, size, filler, arg); ``arg`` is the value, std or fan-in."""
    names = {"constant": "value", "gaussian": "std", "xavier": "fan_in"}
    rows = []
    for spec in specs:
        if spec.filler not in names:
            raise ValueError(f"unknown filler {spec.filler!r}")
        rows.append((spec.layer, spec.size, spec.filler, float(spec.filler_args[names[spec.filler]])))
    return spark.createDataFrame(rows, "layer int, size long, filler string, arg double")


def init_weights(layers: DataFrame, seed: int, chunk: int = CHUNK) -> DataFrame:
    """Start weights: constant(value), gaussian(std), or xavier(fan_in), uniform within sqrt(3 / fan_in).

    Each value is drawn from (seed, layer, index), so it does not depend on the partitioning.
    """

    def draw(name, i):
        return (hash_number(hash_key(seed, name, F.col("layer"), i)) + 0.5) / 2.0**32

    def value(i):
        normal = F.sqrt(-2 * F.log(draw("r", i))) * F.cos(draw("phi", i) * (2 * math.pi))
        return (
            F.when(F.col("filler") == "constant", F.col("arg"))
            .when(F.col("filler") == "gaussian", normal * F.col("arg"))
            .when(F.col("filler") == "xavier", (draw("u", i) * 2 - 1) * F.sqrt(3 / F.col("arg"))))

    last = F.floor((F.col("size") - 1) / chunk)
    chunks = layers.where(F.col("size") > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    places = F.sequence(F.col("chunk") * chunk, F.least((F.col("chunk") + 1) * chunk, F.col("size")) - 1)
    return chunks.select("layer", F.col("chunk").cast("int").alias("chunk"), F.transform(places, value).alias("values"))
