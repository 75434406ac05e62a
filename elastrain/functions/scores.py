"""Column expressions over the array of class scores of a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def checked_label(scores: Column, label: Column) -> Column:
    """The label as a class number; a label that names no class is an error."""
    number = label.cast("int")
    fits = (number >= 0) & (number < F.size(scores))
    return F.when(fits, number).otherwise(
        F.raise_error(F.concat(F.lit("label outside the class range: "), F.coalesce(label.cast("string"), F.lit("null")))).cast("int")
    )


def hit_at(scores: Column, label: Column, k: int) -> Column:
    """1.0 when fewer than ``k`` classes score strictly higher than the class of the label."""
    own = F.get(scores, checked_label(scores, label))
    higher = F.aggregate(scores, F.lit(0), lambda n, s: n + F.when(s > own, 1).otherwise(0))
    return (higher < F.lit(k)).cast("double")


def softmax(scores: Column) -> Column:
    top = F.array_max(scores)
    powers = F.transform(scores, lambda s: F.exp(s - top))
    total = F.aggregate(powers, F.lit(0.0), lambda acc, p: acc + p)
    return F.transform(powers, lambda p: p / total)


def cross_entropy(scores: Column, label: Column) -> Column:
    """-log softmax[label], shifted by the largest score."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda acc, s: acc + F.exp(s - top))
    return F.log(total) + top - F.get(scores, checked_label(scores, label))


def best_classes(scores: Column, k: int) -> Column:
    """The ``k`` best (score, class) pairs, lower class number first among equals."""
    pairs = F.transform(scores, lambda s, i: F.struct((-s).alias("minus"), i.cast("int").alias("cls")))
    best = F.slice(F.array_sort(pairs), 1, k)
    return F.transform(best, lambda p: F.struct((-p["minus"]).alias("score"), p["cls"].alias("cls")))
