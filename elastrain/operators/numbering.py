"""Exact row numbers per group without putting a whole group into one task.

A window over (group, order) sorts each group in a single task, so one group holding a third of the
rows would hold up the job. Here every group is cut into cells that follow its order; the window
runs per cell, and the rows before a cell come from the small table of cell sizes.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from elastrain.session import shuffle_width

CELL, BEFORE, TOTAL = "_cell", "_before", "_total"
#: Rows meant for a value cell; the number of cells is bounded by what a sketch can tell apart.
CELL_ROWS = 50_000
MAX_CELLS = 8192
SALTS = 64


def hash_digits(spark) -> int:
    """Hex digits of the key that name a cell: at least twice as many cells as shuffle partitions."""
    digits, wanted = 1, 2 * shuffle_width(spark)
    while 16**digits < wanted and digits < 6:
        digits += 1
    return digits


def with_hash_cells(df: DataFrame, key: str, digits: int | None = None) -> DataFrame:
    """Cells are prefixes of an md5 key, which is evenly spread whatever the rows are."""
    digits = digits or hash_digits(df.sparkSession)
    return df.withColumn(CELL, F.substring(F.col(key), 1, digits))


def with_value_cells(df: DataFrame, order: str, n_cells: int | None = None) -> DataFrame:
    """Cells are ranges of a numeric or timestamp column between its approximate quantiles.

    The quantiles are read once and become constants of the plan, so counting and numbering, and
    any retried task, see the same cells. Their number follows the row count; at most ``MAX_CELLS``
    numbers reach the driver.
    """
    value = F.col(order).cast("double")
    # Sketches of at most a few hundred kilobytes, merged in two levels: no task gets one from every scan task.
    salted = df.select(value.alias("v"), F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    parts = salted.groupBy("salt").agg(F.kll_sketch_agg_double("v", 8192).alias("sketch"))
    merged = parts.where("sketch IS NOT NULL").agg(F.kll_merge_agg_double("sketch", 8192).alias("s"))
    sketch = merged.select("s", F.coalesce(F.kll_sketch_get_n_double("s"), F.lit(0)).alias("n")).first()
    n_cells = n_cells or min(max(-(-sketch["n"] // CELL_ROWS), 16), MAX_CELLS)
    found = None
    if sketch["n"]:
        # Ranks have to be a constant; written as text they are one literal instead of thousands.
        ranks = F.split(F.lit(",".join(str(i / n_cells) for i in range(1, n_cells))), ",").cast("array<double>")
        one = df.sparkSession.range(1).select(F.kll_sketch_get_quantile_double(F.lit(bytes(sketch["s"])), ranks).alias("q"))
        found = one.first()["q"]
    splits = [-float("inf"), *sorted(set(found or [0.0])), float("inf")]
    cells = Bucketizer(splits=splits, inputCol="_order_value", outputCol=CELL, handleInvalid="error")
    return cells.transform(df.withColumn("_order_value", value)).drop("_order_value")


def number_cells(df: DataFrame, by: list[str], order: list[Column | str], name: str, total: str | None = None) -> DataFrame:
    """Number rows from 1 inside each group of ``by``; ``df`` carries the cell column.

    ``total`` names an extra column with the size of the group. A null group is an error.
    """
    sizes = df.groupBy(*by, CELL).agg(F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy(*by).orderBy(CELL).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *by,
        CELL,
        F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias(BEFORE),
        F.sum("_size").over(W.partitionBy(*by)).alias(TOTAL),
    )
    known = F.when(F.col(BEFORE).isNull(), F.raise_error(F.lit("null in a numbering group")).cast("bigint"))
    in_cell = F.row_number().over(W.partitionBy(*by, CELL).orderBy(*order))
    numbered = df.join(offsets, [*by, CELL], "left").withColumn(name, in_cell + known.otherwise(F.col(BEFORE)))
    if total:
        numbered = numbered.withColumnRenamed(TOTAL, total)
    return numbered.drop(CELL, BEFORE, TOTAL)


def number_by_hash(df: DataFrame, by: list[str], key: str, name: str = "pos", total: str | None = None,
                   digits: int | None = None) -> DataFrame:
    """Rank of an md5 ``key`` inside each group, from 1."""
    return number_cells(with_hash_cells(df, key, digits), by, [key], name, total)


def number_by_value(df: DataFrame, by: list[str], order: str, name: str = "pos", total: str | None = None,
                    ties: tuple[str, ...] = (), n_cells: int | None = None) -> DataFrame:
    """Rank of a numeric or timestamp column inside each group, from 1; ``ties`` break equal values."""
    return number_cells(with_value_cells(df, order, n_cells), by, [order, *ties], name, total)
