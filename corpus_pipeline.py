"""From raw documents to token ids, stage by stage over everything the stage before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet
and rereads it for the next. All but the last return the columns of documents. Null texts count as
empty; rows without an id are kept unless their text is rejected; rows that share an id and a text are
copies of each other, and rows that share an id only are judged each by its own text; an empty table
passes through all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.llm import bpe, decontaminate, exact_dedup, near_copies, quality
from elastrain.llm.common import free_name, row_key, write_table


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, rejects (score below 0.5) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.fit(docs, quality.learnable(labels)))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the largest doc_id."""
    judged = exact_dedup.deduplicated(docs).where("kept OR keep_id IS NULL")
    kept = judged.select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest")).distinct()
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    own = free_name(docs, "_digest")
    rows = docs.withColumn(own, digest)
    same = rows["doc_id"].eqNullSafe(kept["kept_id"]) & (rows[own] == kept["kept_digest"])
    return rows.join(kept.hint("merge"), same, "left_semi").dropDuplicates(["doc_id", own]).drop(own)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts linked, directly or through others, by a similarity of 0.8 or more of their sets of
    5-word shingles, that with the smallest doc_id stays; rows without an id come after all others.
    """
    dropped = write_table(near_copies.later_copies(docs), "near-copies")
    own = free_name(docs, "_row")
    rows = docs.withColumn(own, row_key(F.col("doc_id"), F.col("text")))
    return rows.join(dropped, rows[own] == dropped["node"], "left_anti").drop(own)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go of whose words at least a twentieth lie in passages of the benchmark."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    dropped = write_table(found.where(decontaminate.is_contaminated()).select("doc_id", "key").distinct(), "contaminated")
    own = free_name(docs, "_key")
    rows = docs.withColumn(own, decontaminate.row_key(F.col("doc_id"), F.col("text")))
    same = rows["doc_id"].eqNullSafe(dropped["doc_id"]) & (rows[own] == dropped["key"])
    return rows.join(dropped, same, "left_anti").drop(own)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the SHA-256 of what the ids decode to (that of the text's UTF-8)."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    rows = bpe.round_trip(docs, ranks)
    return rows.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good_quality),
    ("exact dedup", drop_exact_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("byte-level BPE", to_tokens),
]

#: Classifier, fingerprints and byte-level merges cannot be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower())
    return docs
