"""Near duplicates by 64-bit SimHash and multi-index hashing.

Texts get a fingerprint each (majority bits of the XXH64 hashes of their word shingles). Fingerprints
within ``radius`` bits of each other are linked. Cut into ``segments`` parts, two linked fingerprints
agree in at least one part up to ``radius // segments`` bits, so every part of a fingerprint is looked
up under all keys of that small Hamming ball, and each match is verified over all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastrain.llm.common import arrow_map, column, documents, write_table
from elastrain.llm.components import smallest_reachable
from elastrain.session import shuffle_width

BITS = 64
SEED = 42
SHINGLES_AT_ONCE = 1 << 16
FINGERPRINTS_A_TASK = 1_000_000


def simhash(raw: bytes, shingle: int = 3) -> int:
    """Fingerprint of a text in UTF-8 as a signed 64-bit number; a text without words has 0."""
    words = raw.lower().split()  # on bytes: lowers A-Z only, splits at blanks and \\x09-\\x0D only
    if not words:
        return 0
    if len(words) < shingle:
        words, shingle = [b" ".join(words)], 1
    total = len(words) - shingle + 1
    counts = np.zeros(BITS, np.int64)
    for lo in range(0, total, SHINGLES_AT_ONCE):
        part = words[lo : lo + SHINGLES_AT_ONCE + shingle - 1]
        grams = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if shingle > 1 else part
        hashes = b"".join([xxhash.xxh64_digest(g, SEED) for g in grams])
        counts += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """One row (doc_id, fp) per input row; null text counts as empty, which has fingerprint 0."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            fps = [simhash(raw, shingle) for raw in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    rows = documents(docs, id_col, text_col).select("doc_id", F.col("text").cast("binary").alias("text"))
    return arrow_map(rows, run, "doc_id bigint, fp bigint")


def ball(segments: int, radius: int) -> list[tuple[int, int, int]]:
    """(segment, mask of the segment, flipped bits) for every key at which a fingerprint is looked up."""
    edges = [BITS * i // segments for i in range(segments + 1)]
    signed = lambda x: x - (1 << BITS) if x >> (BITS - 1) else x
    out = []
    for s, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        for r in range(radius // segments + 1):
            for bits in combinations(range(lo, hi), r):
                out.append((s, signed(sum(1 << b for b in range(lo, hi))), signed(sum(1 << b for b in bits))))
    return out


def hamming_links(prints: DataFrame, radius: int = 3, segments: int = 2) -> DataFrame:
    """Pairs (a, b), a < b, of distinct values of ``fp`` that differ in at most ``radius`` bits, each at least once.

    Work is per distinct fingerprint: copies meet in the distinct and make no pairs.
    """
    # Every row is about to become some dozens: no more than FINGERPRINTS_A_TASK go into one task.
    tasks = max(shuffle_width(prints.sparkSession), -(-prints.count() // FINGERPRINTS_A_TASK))
    nodes = prints.select("fp").distinct().repartition(tasks, "fp")
    long = lambda x: F.lit(x).cast("bigint")
    probes = ball(segments, radius)
    looked_up = F.array(*(F.struct(F.lit(s).alias("seg"), long(m).alias("mask"), long(f).alias("flip")) for s, m, f in probes))
    own = sorted({(s, m) for s, m, _ in probes})
    parts = F.array(*(F.struct(F.lit(s).alias("seg"), F.col("fp").bitwiseAND(long(m)).alias("key")) for s, m in own))
    index = nodes.select(F.col("fp").alias("b"), F.inline(parts))
    queries = nodes.select(F.col("fp").alias("a"), F.inline(looked_up)).select(
        "a", "seg", F.expr("(a & mask) ^ flip").alias("key")
    )
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    # Sizes are judged before the rows are multiplied, so the sides are not left to a broadcast by estimate.
    return queries.join(index.hint("merge"), ["seg", "key"]).where(near).select("a", "b")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 3, segments: int = 2
) -> DataFrame:
    """One row per input row: doc_id, fp (bigint), component_id (smallest doc_id reachable over links).

    Null and empty texts share fingerprint 0 and are linked like any others. Rows that repeat are each
    returned; an empty table gives no rows; a row with a null doc_id keeps its fingerprint and gets the
    smallest id of its component (null if there is none).
    """
    prints = write_table(fingerprints(docs, id_col, text_col, shingle), "simhash")
    links = write_table(hamming_links(prints, radius, segments).distinct(), "simhash-links")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    labels = smallest_reachable(links)
    rooted = first.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    per_root = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    component = rooted.join(per_root, "root").select("fp", "component_id")
    return prints.join(component, "fp").select("doc_id", "fp", "component_id")
