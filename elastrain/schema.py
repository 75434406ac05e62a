"""Row shapes and job settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

SAMPLE = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("data", T.ArrayType(T.FloatType())),
    T.StructField("label", T.FloatType()),
    T.StructField("dim", T.ArrayType(T.IntegerType())),
])

STORED_SAMPLE = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("channels", T.IntegerType()),
    T.StructField("height", T.IntegerType()),
    T.StructField("width", T.IntegerType()),
    T.StructField("data", T.BinaryType()),
    T.StructField("label", T.IntegerType()),
    T.StructField("worker", T.IntegerType()),
])

WEIGHTS = T.StructType([
    T.StructField("layer", T.IntegerType()),
    T.StructField("chunk", T.IntegerType()),
    T.StructField("values", T.ArrayType(T.DoubleType())),
])

TRAINING_LOG = T.StructType([
    T.StructField("run", T.StringType()),
    T.StructField("worker", T.IntegerType()),
    T.StructField("update_no", T.LongType()),
    T.StructField("iter", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("elapsed_s", T.DoubleType()),
])


@dataclass(frozen=True)
class ExchangeParams:
    """How often and how strongly workers and the centre are pulled together."""

    period: int
    moving_rate: float
    decay_rate: float = 1.0
    decay_step: int = -1
    decay_limit: int = -1
    server_factor: float = 1.0
    factor_decay_rate: float = 1.0
    factor_decay_step: int = -1
    factor_decay_limit: int = -1

    def __post_init__(self):
        if self.period is None or self.period < 1:
            raise ValueError("period must be a positive number of local steps")
        if self.moving_rate is None:
            raise ValueError("moving_rate is required")


@dataclass(frozen=True)
class SolverParams:
    """Settings of the local solver."""

    base_lr: float
    max_iter: int
    momentum: float = 0.0
    weight_decay: float = 0.0
    lr_policy: str = "fixed"
    gamma: float = 1.0
    stepsize: int = 1
    clip_gradients: float = -1.0
    snapshot: int = 0
    test_interval: int = 0
    batch_size: int = 100

    def __post_init__(self):
        if self.lr_policy not in ("fixed", "step"):
            raise ValueError(f"unknown lr_policy {self.lr_policy!r}")


@dataclass(frozen=True)
class LayerSpec:
    """One parameter blob of a model: its size, its multipliers and how it is filled at the start."""

    layer: int
    name: str
    size: int
    lr_mult: float = 1.0
    decay_mult: float = 1.0
    filler: str = "constant"
    filler_args: dict = field(default_factory=dict)
