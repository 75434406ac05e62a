"""Counts, losses, accumulated gradients and scores."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastrain.functions.scores import cross_entropy, hit_at


def count_samples(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"))


def vector_sum(values: Column) -> Column:
    """Element-wise sum over rows; merged map-side, so each task sends one array per group."""
    return vector_to_array(Summarizer.sum(array_to_vector(values.cast("array<double>"))))


SALTS = 256


def vector_sums(df: DataFrame, by: list[str], values: str = "values", same: tuple[str, ...] = ()) -> DataFrame:
    """Element-wise sums per group in two levels; ``same`` names columns that are equal within a group.

    Every map task sends one array per group, so a popular group would get as many arrays as there
    are tasks in one place. A salt by source partition merges them in up to ``SALTS`` places first.
    """
    totals = [vector_sum(F.col(values)).alias(values), *[F.max(c).alias(c) for c in same]]
    salted = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))
    return salted.groupBy(*by, "_salt").agg(*totals).groupBy(*by).agg(*totals)


def period_loss(log: DataFrame, period: int) -> DataFrame:
    """Mean loss and mean step time (whole ms) of each full or started period of a worker.

    ``log`` has worker, iter (from 1), loss and ms.
    """
    span = F.floor((F.col("iter") - 1) / period)
    steps = F.count(F.lit(1))
    return log.groupBy("worker", span.alias("span")).agg(
        F.max("iter").alias("iter"),
        F.avg("loss").alias("loss"),
        F.floor(F.sum("ms") / steps).alias("mean_ms"),
        steps.alias("steps"),
    )


def accumulate_gradients(gradients: DataFrame, k: int, by: list[str]) -> DataFrame:
    """Sum of the gradient blocks of ``k`` consecutive steps (step from 0); ``by`` names worker and block."""
    pushes = gradients.withColumn("push", F.floor(F.col("step") / k))
    return pushes.groupBy(*by, "push").agg(vector_sum(F.col("values")).alias("values"))


def squared_norms(history: DataFrame, file: str, values: str) -> DataFrame:
    """Per file: number of values and sum of their squares."""
    squares = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return history.groupBy(file).agg(
        F.sum(F.size(values).cast("bigint")).alias("n"), F.sum(squares).alias("sum_squares")
    )


def mean_scores(df: DataFrame, outputs: dict[str, float], test_iter: int = 0) -> DataFrame:
    """Each output averaged over ``test_iter`` batches of the test set, times its loss weight when that is not 0.

    ``df`` carries batch and batches (numbers over the whole set) next to the outputs. Batches are taken in order,
    again from the first when there are fewer; 0 takes every full batch once. Rows that are not scored, such as those
    beyond the last full batch, are counted in ``left_over``. Without a full batch the scores are null.
    """
    full, of = F.col("batch") < F.col("batches"), F.greatest(F.col("batches"), F.lit(1))
    again = F.floor(F.lit(test_iter) / of) + F.when(F.col("batch") < F.pmod(F.lit(test_iter), of), 1).otherwise(0)
    times = F.when(full, again if test_iter > 0 else F.lit(1)).otherwise(0)
    sums = [F.sum(F.col(name) * times).alias(name) for name in outputs]
    totals = df.agg(*sums, F.sum(times).alias("_times"), F.max("batches").alias("batches"), F.count(F.when(times == 0, 1)).alias("left_over"))
    pairs = F.array(*[
        F.struct(F.lit(name).alias("output"), (F.try_divide(F.col(name), F.col("_times")) * F.lit(float(w) if w else 1.0)).alias("mean_score"))
        for name, w in outputs.items()
    ])
    return totals.select(F.explode(pairs).alias("p"), "batches", "left_over").select(
        "p.output", "p.mean_score", "batches", "left_over"
    )


def accuracy_and_loss(df: DataFrame, scores: str, label: str, ks: tuple[int, ...] = (1, 5), loss_weight: float = 1.0) -> DataFrame:
    """Top-k accuracies and weighted mean cross-entropy over all rows."""
    hits = [F.avg(hit_at(F.col(scores), F.col(label), k)).alias(f"accuracy_{k}") for k in ks]
    loss = F.avg(cross_entropy(F.col(scores), F.col(label))) * F.lit(loss_weight)
    return df.agg(*hits, loss.alias("loss"), F.count(F.lit(1)).alias("n"))


def heads_report(df: DataFrame, heads: dict[str, float], label: str, ks: tuple[int, ...] = (1, 5)) -> DataFrame:
    """Accuracies and weighted mean loss of every head of a model, and the loss of the whole: the sum of these.

    ``heads`` maps a column of class scores to the weight of its loss, as the auxiliary classifiers of a deep network
    have (0.3, 0.3 and 1.0). All heads are scored in one pass; an empty table gives nulls and n = 0.
    """
    def parts(head, weight):
        hits = [F.avg(hit_at(F.col(head), F.col(label), k)).alias(f"accuracy_{k}") for k in ks]
        return F.struct(F.lit(head).alias("head"), *hits, (F.avg(cross_entropy(F.col(head), F.col(label))) * F.lit(float(weight))).alias("loss"))

    found = df.agg(F.array(*[parts(h, w) for h, w in heads.items()]).alias("heads"), F.count(F.lit(1)).alias("n"))
    total = F.aggregate("heads", F.lit(0.0), lambda acc, h: acc + h["loss"]).alias("total_loss")
    return found.select(F.explode("heads").alias("h"), total, "n").select("h.*", "total_loss", "n")
