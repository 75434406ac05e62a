"""Whole jobs: load, prepare, store, train, score, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.operators import samples as S
from elastrain.operators.batching import assign_workers, random_order
from elastrain.operators.weights import chunked, weights_by_layer_name
from elastrain.plans import training as T
from elastrain.plans.learners import Learner
from elastrain.plans.scoring import evaluate
from elastrain.plans.transforms import SampleTransform
from elastrain.schema import ExchangeParams, SolverParams
from elastrain.session import fresh_path, materialise
from elastrain.sources import files
from elastrain.sources.shards import BLOCK_ROWS, WorkerStore, store_by_worker
from elastrain.sources.stores import load_weights, save_weights

# Sample shapes of the three data sets.
DIGITS = (1, 28, 28)
COLOUR = (3, 32, 32)
LARGE = (3, 256, 256)
# Means of the channels of large images.
CHANNEL_MEANS = (104.0, 117.0, 123.0)


@dataclass
class Report:
    """A trained model with its scores before and after, and the run's report row."""

    trained: T.Trained
    before: DataFrame | None
    after: DataFrame | None
    summary: DataFrame


def _delta(train: DataFrame, test: DataFrame, n_workers: int, k: int, learner: Learner, solver: SolverParams, seed: int,
           weights: DataFrame) -> Report:
    trained = T.train_delta(train, ["id"], n_workers, k, learner, solver, seed, weights, test)
    return Report(trained, evaluate(test, weights, learner), evaluate(test, trained.centre, learner), T.training_report(trained.log))


def digits_delta(spark: SparkSession, train: str, test: str, n_workers: int, learner: Learner, solver: SolverParams,
                 weights: DataFrame, k: int = 10, seed: int = 0) -> Report:
    """Scaled digit images from text, delta training, scores before and after."""
    rows, held = (materialise(S.scale_pixels(files.scan_tsv_images(spark, p, DIGITS)), "digits") for p in (train, test))
    return _delta(rows, held, n_workers, k, learner, solver, seed, weights)


def colour_delta(spark: SparkSession, train: str, test: str, n_workers: int, learner: Learner, solver: SolverParams,
                 weights: DataFrame, k: int, seed: int = 0) -> Report:
    """Colour images from text, centred with the label counted in the divisor, delta training."""
    rows, held = (
        materialise(S.centre_per_record(files.scan_tsv_images(spark, p, COLOUR), include_label_in_divisor=True), "colour")
        for p in (train, test))
    return _delta(rows, held, n_workers, k, learner, solver, seed, weights)


def _store(df: DataFrame, n_workers: int, seed: int, quantise: bool = True) -> WorkerStore:
    """Shard the samples by id and store them per worker.

    The ids name a file and a place in it; a hash of them is an order that is the same everywhere, ties by id.
    """
    path = fresh_path(df.sparkSession, "store")
    placed = assign_workers(df, ["id"], n_workers, seed).withColumn("place", F.xxhash64("id"))
    return store_by_worker(placed, "place", path, n_workers, quantise, ties=("id",))


def _elastic(shards: WorkerStore, test: DataFrame | None, n_workers: int, learner: Learner, solver: SolverParams,
             params: ExchangeParams, seed: int, save_to: str | None, transform: SampleTransform | None = None) -> Report:
    trained = T.train_elastic_from_shards(shards, n_workers, learner, solver, params, BLOCK_ROWS, seed, test=test, transform=transform)
    if save_to:
        save_weights(trained.centre, save_to, "final")
    return Report(trained, None, _scores(test, trained, learner, transform), T.training_report(trained.log))


def _scores(test: DataFrame | None, trained: T.Trained, learner: Learner, transform: SampleTransform | None) -> DataFrame | None:
    if test is None:
        return None
    return evaluate(transform.for_test().table(test) if transform else test, trained.centre, learner)


def digits_elastic(spark: SparkSession, train: str, test: str, n_workers: int, learner: Learner, solver: SolverParams,
                   params: ExchangeParams, save_to: str, seed: int = 0) -> Report:
    """Digit images stored as bytes of scaled pixels (so zeros and ones), elastic training from the stores."""
    rows = materialise(S.scale_pixels(files.scan_tsv_images(spark, train, DIGITS)), "digits")
    held = S.quantise_u8(S.scale_pixels(files.scan_tsv_images(spark, test, DIGITS)))
    return _elastic(_store(rows, n_workers, seed), held, n_workers, learner, solver, params, seed, save_to)


def colour_elastic(spark: SparkSession, train: str, n_workers: int, learner: Learner, solver: SolverParams,
                   params: ExchangeParams, save_to: str, seed: int = 0, test: str | None = None, subtract_mean: bool = False) -> Report:
    """Colour images stored as bytes, elastic training from the stores, minus the mean image of the training samples if asked."""
    rows = materialise(files.scan_tsv_images(spark, train, COLOUR), "colour")
    held = materialise(files.scan_tsv_images(spark, test, COLOUR), "colour") if test else None
    transform = SampleTransform(COLOUR, mean_image=tuple(S.mean_image(S.quantise_u8(rows)).first()["mean"])) if subtract_mean else None
    return _elastic(_store(rows, n_workers, seed), held, n_workers, learner, solver, params, seed, save_to, transform)


def large_transform(dims=LARGE, crop: int = 224, seed: int = 0) -> SampleTransform:
    """Drawn windows and flips, minus the channel means; its ``for_test`` has the centre window."""
    return SampleTransform(dims, crop=crop, mirror=True, channel_means=CHANNEL_MEANS[: dims[0]], seed=seed)


def _large_shards(spark: SparkSession, pairs: str, n_workers: int, seed: int, dims) -> WorkerStore:
    records = files.scan_sequence_pairs(spark, pairs, dims)
    numbers = S.to_record(files.decoded(records), "data", "label", dims, keep=["id"])
    return _store(materialise(numbers, "large"), n_workers, seed)


def large_images_fixed(spark: SparkSession, pairs: str, n_workers: int, learner: Learner, solver: SolverParams,
                       params: ExchangeParams, seed: int = 0, dims=LARGE, transform: SampleTransform | None = None,
                       test: DataFrame | None = None) -> Report:
    """Stored (label, bytes) pairs, elastic training at a fixed period; ``test`` has samples as stored."""
    return _elastic(_large_shards(spark, pairs, n_workers, seed, dims), test, n_workers, learner, solver, params, seed, None, transform)


def large_images_adaptive(spark: SparkSession, pairs: str, n_workers: int, learner: Learner, solver: SolverParams,
                          params: ExchangeParams, seed: int = 0, dims=LARGE, transform: SampleTransform | None = None,
                          test: DataFrame | None = None) -> Report:
    """Stored (label, bytes) pairs, elastic training with loss-driven exchanges; ``test`` has samples as stored."""
    shards = _large_shards(spark, pairs, n_workers, seed, dims)
    trained = T.train_elastic_adaptive(shards, n_workers, learner, solver, params, BLOCK_ROWS, seed, test=test, transform=transform)
    return Report(trained, None, _scores(test, trained, learner, transform), T.training_report(trained.log))


def class_subset(spark: SparkSession, pairs: str, out: str, n_classes: int, seed: int, dims=LARGE) -> None:
    """Pairs of the first classes in a new random order, written as pairs."""
    rows = S.filter_label_below(files.scan_sequence_pairs(spark, pairs, dims), n_classes)
    files.write_sequence_pairs(random_order(rows, ["id"], seed), out)


def print_labels(spark: SparkSession, pairs: str, dims=LARGE) -> DataFrame:
    """Label and number of values of every stored pair."""
    return S.label_and_width(files.decoded(files.scan_sequence_pairs(spark, pairs, dims)))


def copy_weights(spark: SparkSession, source: str, tag: str, target: str, new_tag: str) -> None:
    """Weights of one store under a tag of another."""
    save_weights(load_weights(spark, source, tag), target, new_tag)


def convert_named_weights(layers: DataFrame, named: DataFrame, target: str, tag: str) -> None:
    """Blobs found by layer name as a weight list in net order; blob number i becomes layer i."""
    found = weights_by_layer_name(layers, named)
    save_weights(chunked(found.select(F.col("idx").alias("layer"), "values")), target, tag)

