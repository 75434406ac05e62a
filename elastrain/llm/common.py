"""What the text operators share: inputs with nulls resolved, Arrow helpers, written intermediates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastrain.session import bounded_batches, fresh_path

CHARS_AT_ONCE = 1 << 20


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the id (bigint) and the text (null: empty); other columns, whatever their names, are left behind."""
    return df.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), whole_text(df, text_col).alias("text"))


def whole_text(df: DataFrame, text_col: str) -> Column:
    return F.coalesce(df[f"`{text_col}`"].cast("string"), F.lit(""))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits that stand for an id, which may be missing, and a text; null texts count as empty."""
    parts = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("none")), F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))
    return F.unhex(F.md5(parts))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder (zstd) and read it back: lineage ends here, and sizes are known to the optimizer."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    bounded_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def grouped(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[list[str]]:
    """Texts in groups of at most ``most`` characters; a longer text is alone."""
    group, size = [], 0
    for text in texts:
        if group and size + len(text) > most:
            yield group
            group, size = [], 0
        group.append(text)
        size += len(text)
    if group:
        yield group
