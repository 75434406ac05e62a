"""Samples in text, fixed-length binary, sequence and Parquet files."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from elastrain.functions.arrays import decode_u8
from elastrain.session import materialise
from elastrain.sources.records import TASK_BYTES, FixedRecords


def _dim(dims: tuple[int, int, int]):
    return F.array(*[F.lit(d) for d in dims])


def _below(path: Column, root: str) -> Column:
    """A file's path below the folder it was found in; its name where ``root`` is the file, or a pattern."""
    folder = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^file:/+", "/")
    plain = F.regexp_replace(path, "^file:/+", "/")
    at = F.instr(plain, folder)
    return F.when(at > 0, F.substr(plain, at + F.length(folder))).otherwise(F.substring_index(plain, "/", -1))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(id, value): lines and their exact place, as ``file:line`` with lines from 0.

    A first pass counts the lines of every split; running counts over the splits of a file tell where each
    starts. A split lies within one partition, where row numbers follow the lines.
    """
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("row"))
    counted = lines.groupBy("file", "start").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("file").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    splits = counted.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # One row a split, written, so its size is known when the join is planned.
    splits = materialise(splits, "splits")
    place = F.col("row") - F.col("first")
    moved = F.raise_error(F.lit("the files were split in another way than when their lines were counted"))
    number = F.when((place >= 0) & (place < F.col("n")), F.col("before") + place).otherwise(moved.cast("bigint"))
    return lines.join(splits, ["file", "start"], "left").select(F.concat_ws(":", _below(F.col("file"), path), number).alias("id"), "value")


def scan_tsv_images(spark: SparkSession, path: str, dims: tuple[int, int, int]) -> DataFrame:
    """One sample per line: the values, then the label, separated by tabs. A line of another width is an error.

    The id is file and line, the same however the files are split.
    """
    n = dims[0] * dims[1] * dims[2]
    parts = _numbered_lines(spark, path).select("id", F.split("value", "\t").alias("parts"))
    wrong = F.raise_error(F.concat(F.lit(f"expected {n + 1} columns, found "), F.size("parts").cast("string")))
    checked = F.when(F.size("parts") == n + 1, F.col("parts")).otherwise(wrong.cast("array<string>"))
    return parts.withColumn("parts", checked).select(
        "id", F.slice("parts", 1, n).cast("array<float>").alias("data"),
        F.element_at("parts", n + 1).cast("float").alias("label"), _dim(dims).alias("dim"))


def write_tsv_images(df: DataFrame, path: str, by: str | None = None) -> None:
    """Samples as lines of values and label, in a folder for each value of ``by``."""
    values = F.array_join(F.transform("data", lambda x: x.cast("string")), "\t")
    lines = df.select(F.concat_ws("\t", values, F.col("label").cast("string")), *([by] if by else []))
    (lines.write.partitionBy(by) if by else lines.write).text(path)


def scan_binary_images(spark: SparkSession, path: str, dims: tuple[int, int, int] = (3, 32, 32),
                       task_bytes: int = TASK_BYTES, columns: tuple[str, ...] = ("id", "data", "label")) -> DataFrame:
    """Fixed-length records: one label byte, then one byte per value. A partial last record is an error.

    The id is file and record, the same whatever ``task_bytes`` (read by one task). Of ``columns`` only those
    named are made.
    """
    record = 1 + dims[0] * dims[1] * dims[2]
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = found.select("path", _below(F.col("path"), path).alias("name"), "length")
    partial = files.where(F.pmod("length", F.lit(record)) != 0).first()
    if partial:
        raise ValueError(f"{partial['path']}: {partial['length']} bytes are no whole number of {record}-byte records")
    spark.dataSource.register(FixedRecords)
    # As for every scan, the driver knows the files; their contents stay with the tasks.
    listed = json.dumps([[r["path"], r["name"], r["length"]] for r in files.orderBy("path").collect()])
    rows = (spark.read.format(FixedRecords.name()).option("files", listed).option("record", record)
            .option("task_bytes", task_bytes).option("columns", ",".join(columns)).load())
    return rows.withColumn("dim", _dim(dims))


def write_sequence_pairs(df: DataFrame, path: str) -> None:
    """(label, data) pairs as Parquet; the shape is not kept."""
    df.select(F.col("label").cast("float").alias("label"), "data").write.parquet(path)


def scan_sequence_pairs(spark: SparkSession, path: str, dims: tuple[int, int, int]) -> DataFrame:
    """Pairs as samples; ``data`` is bytes or values as it was written.

    The id is the row's place in its file, the same on any cluster, and lets filters through to the scan.
    """
    return spark.read.parquet(path).select(
        F.concat_ws(":", "_metadata.file_name", "_metadata.row_index").alias("id"), "data", "label", _dim(dims).alias("dim"))


def write_sequence_file(df: DataFrame, path: str) -> None:
    """(label, data) pairs as a sequence file for other readers; PySpark stores the label as a double key."""
    pairs = df.select(F.col("label").cast("double"), F.col("data").cast("binary")).rdd
    pairs.map(lambda r: (r[0], bytearray(r[1]))).saveAsSequenceFile(path)


def scan_sequence_file(spark: SparkSession, path: str, dims: tuple[int, int, int]) -> DataFrame:
    """Number keys (float or double) and byte values of a sequence file as samples with binary data."""
    pairs = spark.sparkContext.sequenceFile(path)
    rows = spark.createDataFrame(pairs.map(lambda p: (float(p[0]), bytearray(p[1]))), "label float, data binary")
    return rows.select(F.monotonically_increasing_id().alias("id"), "data", "label", _dim(dims).alias("dim"))


def decoded(df: DataFrame) -> DataFrame:
    """Byte payloads as values 0..255; samples that hold values already stay as they are."""
    if dict(df.dtypes)["data"] != "binary":
        return df
    return df.withColumn("data", decode_u8("data").cast("array<float>"))
