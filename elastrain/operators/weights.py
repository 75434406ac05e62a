"""Model weights as chunked rows (layer, chunk, values) and their algebra.

A layer of any size is a set of rows of at most ``CHUNK`` values; value number ``i`` of a layer sits
in chunk ``i // CHUNK`` at place ``i % CHUNK``. Every operation is a row-wise expression, an
equi-join on (layer, chunk) or a grouped sum, so it never needs a whole model in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from elastrain.operators.aggregates import vector_sums
from elastrain.operators.exchanges import exchange_scan
from elastrain.operators.numbering import number_by_value

CHUNK = 4096
BLOCK = ["layer", "chunk"]


def chunked(layers: DataFrame, values: str = "values", size: int = CHUNK, keep: tuple[str, ...] = ()) -> DataFrame:
    """(layer, values) rows cut into (layer, chunk, values)."""
    doubles = F.col(values).cast("array<double>")
    starts = F.when(F.size(values) > 0, F.sequence(F.lit(0), F.size(values) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    pieces = F.transform(starts, lambda s: F.slice(doubles, s + 1, F.lit(size)))
    return layers.select(*keep, F.col("layer").cast("int").alias("layer"), F.posexplode(pieces).alias("chunk", "values"))


def align_weights(a: DataFrame, b: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Pair two weight tables block by block as (layer, chunk, a, b); unequal shapes are an error."""
    keys = [*by, *BLOCK]
    paired = a.select(*keys, F.col("values").alias("a")).join(
        b.select(*keys, F.col("values").alias("b")), keys, "full_outer")
    mismatch = F.col("a").isNull() | F.col("b").isNull() | (F.size("a") != F.size("b"))
    checked = F.when(mismatch, F.raise_error(F.lit("Size mismatch!")).cast("array<double>")).otherwise(F.col("a"))
    return paired.withColumn("a", checked)


def _combined(a: DataFrame, b: DataFrame, fn) -> DataFrame:
    return align_weights(a, b).select(*BLOCK, F.zip_with("a", "b", fn).alias("values"))


def add_weights(a: DataFrame, b: DataFrame) -> DataFrame:
    """b + a, block by block."""
    return _combined(a, b, lambda x, y: y + x)


def sub_weights(a: DataFrame, b: DataFrame) -> DataFrame:
    """b - a, block by block."""
    return _combined(a, b, lambda x, y: y - x)


def scale_weights(w: DataFrame, rate: float) -> DataFrame:
    return w.withColumn("values", F.transform("values", lambda x: x * F.lit(float(rate))))


def zero_weights(w: DataFrame) -> DataFrame:
    return w.withColumn("values", F.transform("values", lambda x: F.lit(0.0)))


def slice_weights(w: DataFrame, offset: int, n: int, layer: int | None = None, size: int = CHUNK) -> DataFrame:
    """Values ``offset`` .. ``offset + n - 1`` of one layer, or of every layer, as (layer, idx, value).

    The chunk bounds are plain comparisons, so a Parquet scan skips the blocks outside the range.
    """
    last = offset + n - 1
    blocks = w.where(F.col("chunk").between(offset // size, last // size))
    if layer is not None:
        blocks = blocks.where(F.col("layer") == layer)
    idx = F.col("chunk").cast("bigint") * size + F.col("place")
    return (
        blocks.select(*BLOCK, F.posexplode("values").alias("place", "value"))
        .select("layer", idx.alias("idx"), "value")
        .where(F.col("idx").between(offset, last))
    )


def patch_weights(w: DataFrame, patch: DataFrame, size: int = CHUNK) -> DataFrame:
    """Overwrite single values: ``patch`` has (layer, idx, value); a place the layer lacks is an error."""
    edits = patch.select(
        F.col("layer").cast("int").alias("layer"), F.floor(F.col("idx") / size).cast("int").alias("chunk"),
        F.pmod("idx", F.lit(size)).cast("int").alias("place"), F.col("value").cast("double").alias("value"),
    )
    # One map per touched block: at most ``size`` entries.
    maps = edits.groupBy(*BLOCK).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "value"))).alias("edits"), F.max("place").alias("top"))
    joined = w.join(maps, BLOCK, "full_outer")
    outside = F.col("values").isNull() | (F.col("top") >= F.size("values"))
    patched = F.transform("values", lambda x, i: F.coalesce(F.element_at("edits", i), x))
    return joined.select(
        *BLOCK,
        F.when(F.col("edits").isNull(), F.col("values"))
        .when(outside, F.raise_error(F.lit("patch outside the layer")).cast("array<double>"))
        .otherwise(patched).alias("values"),
    )


def layer_sizes(w: DataFrame) -> DataFrame:
    """Parameters per layer."""
    return w.groupBy("layer").agg(F.sum(F.size("values").cast("bigint")).alias("size"))


def partition_weights(sizes: DataFrame, n: int) -> DataFrame:
    """Contiguous ranges of every layer, worker i getting [floor(i*size/n), floor((i+1)*size/n))."""
    every = sizes.select("layer", "size", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("worker"))
    start = F.expr(f"div(cast(worker as bigint) * size, {n})")
    end = F.expr(f"div((cast(worker as bigint) + 1) * size, {n})")
    return every.select("worker", "layer", start.alias("offset"), (end - start).alias("length"))


def to_every_worker(w: DataFrame, n_workers: int) -> DataFrame:
    """The same start weights for each worker."""
    return w.select(F.explode(F.sequence(F.lit(0), F.lit(n_workers - 1))).alias("worker"), *BLOCK, "values")


def weights_by_layer_name(layers: DataFrame, named: DataFrame) -> DataFrame:
    """Blobs in net order with a running index; names without blobs are skipped.

    ``layers`` has (layer_pos, name), ``named`` has (name, blob_no, values). Blobs are numbered per
    layer and shifted by the sizes of the layers before it.
    """
    found = layers.select("layer_pos", "name").join(named, "name")
    numbered = number_by_value(found, ["layer_pos"], "blob_no", "_n")
    earlier = W.orderBy("layer_pos").rowsBetween(W.unboundedPreceding, -1)
    # One row per layer of the net.
    starts = found.groupBy("layer_pos").agg(F.count(F.lit(1)).alias("_size")).select(
        "layer_pos", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_start"))
    return numbered.join(starts, "layer_pos").select(
        (F.col("_start") + F.col("_n") - 1).alias("idx"), "layer_pos", "name", "blob_no", "values")


def mixed(x: Column, y: Column, rate: Column) -> Column:
    """(1 - rate) * x + rate * y, value by value."""
    return F.zip_with(x, y, lambda p, q: (1 - rate) * p + rate * q)


def elastic_exchange(worker_w: DataFrame, centre_w: DataFrame, rate: float, server_factor: float = 1.0) -> DataFrame:
    """One worker meets the centre; both new blocks come from the values before the exchange."""
    a, b = F.lit(float(rate)), F.lit(float(rate) * float(server_factor))
    return align_weights(worker_w, centre_w).select(
        *BLOCK, mixed(F.col("a"), F.col("b"), a).alias("worker_values"), mixed(F.col("b"), F.col("a"), b).alias("centre_values"))


def fold_exchanges(workers_w: DataFrame, centre_w: DataFrame) -> DataFrame:
    """``exchange_scan`` with one row for each block: (layer, chunk, centre, met), met = [(worker, values), ...] by worker.

    A row holds its block of every worker; rounds read the scan itself.
    """
    last = workers_w.agg(F.max("worker")).first()[0] or 0
    scanned = exchange_scan(workers_w, centre_w, last + 1)
    met = F.col("kind") == "met"
    return scanned.groupBy(*BLOCK).agg(
        F.max(F.when(~met, F.col("values"))).alias("centre"),
        F.array_sort(F.collect_list(F.when(met, F.struct("worker", "values")))).alias("met"))


def _with_sums(centre_w: DataFrame, sums: DataFrame, move) -> DataFrame:
    """The centre with ``move(values, sum)`` in the blocks that have a sum; one that the centre lacks or of another size is an error."""
    joined = centre_w.select(*BLOCK, "values").join(sums, BLOCK, "full_outer")
    fits = F.col("values").isNotNull() & (F.size("values") == F.size("sum"))
    wrong = F.raise_error(F.lit("Size mismatch!")).cast("array<double>")
    moved = F.when(F.col("sum").isNull(), F.col("values")).when(fits, F.zip_with("values", "sum", move)).otherwise(wrong)
    return joined.select(*BLOCK, moved.alias("values"))


def fold_weighted(arrivals: DataFrame, centre_w: DataFrame) -> DataFrame:
    """Any number of arrivals as one weighted sum per block, merged map-side.

    ``arrivals`` has (layer, chunk, values, weight, kept): ``weight`` is the share an arrival still
    has after all later ones, ``kept`` (the same for all arrivals of a block) what the start has.
    """
    weighted = arrivals.select(*BLOCK, "kept", F.transform("values", lambda x: x * F.col("weight")).alias("sum"))
    return _with_sums(centre_w, vector_sums(weighted, BLOCK, "sum", same=("kept",)), lambda c, s: F.col("kept") * c + s)


def fold_arrivals(arrivals: DataFrame, centre_w: DataFrame, coefficient: float) -> DataFrame:
    """Arrivals at a constant coefficient b, ``n`` numbering those of a block from 1 to ``total``.

    After N of them the centre is (1-b)^N c0 + sum of b (1-b)^(N-n) x_n: no ordered pass is needed.
    """
    b = float(coefficient)
    left = F.lit(1 - b)
    shares = arrivals.withColumns({
        "weight": F.lit(b) * F.pow(left, F.col("total") - F.col("n")), "kept": F.pow(left, F.col("total"))})
    return fold_weighted(shares, centre_w)


def apply_deltas(centre_w: DataFrame, deltas: DataFrame) -> DataFrame:
    """centre minus the sum of all update values pushed for its blocks."""
    sums = vector_sums(deltas.select(*BLOCK, F.col("values").alias("sum")), BLOCK, "sum")
    return _with_sums(centre_w, sums, lambda c, d: c - d)
