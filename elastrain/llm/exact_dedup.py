"""Exact duplicates against an immutable snapshot screened by static binary-fuse filters.

A snapshot holds the SHA-256 digests of its texts, one row per digest, cut into hash buckets with one
three-wise binary-fuse filter each (8-bit fingerprints, no false negatives). Digests of a new batch are
grouped among themselves first, then screened: only those that a filter lets through can be in the
snapshot and go to its exact bucket, where texts are compared byte by byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastrain.llm.common import bounded_batches, documents, write_table

KEYS_PER_FILTER = 100_000
_MIX = 0x9E3779B97F4A7C15


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over keys and seed."""
    x = x + np.uint64(_MIX * (seed + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _slots(keys: np.ndarray, seed: int, seg_len: int, n_seg: int) -> tuple[np.ndarray, np.ndarray]:
    """The three slots of each key, in consecutive segments, and its 8-bit fingerprint."""
    h = _mix(keys, seed)
    g = _mix(h, seed + 77)
    first = ((h >> np.uint64(32)) * np.uint64(n_seg)) >> np.uint64(32)
    at = [(g >> np.uint64(20 * i)) % np.uint64(seg_len) + (first + np.uint64(i)) * np.uint64(seg_len) for i in range(3)]
    return np.stack(at).astype(np.int64), (h & np.uint64(255)).astype(np.uint8)


@dataclass
class FuseFilter:
    """Static set of 64-bit keys: never says no to a member, says yes to about 1 stranger in 256."""

    seed: int
    seg_len: int
    n_seg: int
    table: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        keys = np.unique(keys)
        n = len(keys)
        seg_len = 1 << max(2, int(np.log2(max(n, 1)) / np.log2(3.33) + 2.25))
        for seed in range(200):
            room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 4))) * (1 + seed / 20)
            n_seg = max(1, -int(-n * room // seg_len) - 2)
            order = cls._peel(keys, seed, seg_len, n_seg)
            if order is None:
                continue
            slots, prints = _slots(keys, seed, seg_len, n_seg)
            table = np.zeros((n_seg + 2) * seg_len, np.uint8)
            for who, at in reversed(order):
                table[at] = 0
                table[at] = prints[who] ^ table[slots[0, who]] ^ table[slots[1, who]] ^ table[slots[2, who]]
            return cls(seed, seg_len, n_seg, table)
        raise ValueError("no seed gives a filter")

    @staticmethod
    def _peel(keys, seed, seg_len, n_seg):
        """Rounds of (keys, the slot each is alone in), or None if a core remains."""
        slots, _ = _slots(keys, seed, seg_len, n_seg)
        size, left, order = (n_seg + 2) * seg_len, len(keys), []
        count, who = np.zeros(size, np.int32), np.zeros(size, np.int64)
        index = np.arange(len(keys))
        for s in slots:
            np.add.at(count, s, 1)
            np.bitwise_xor.at(who, s, index)
        alone = np.flatnonzero(count == 1)
        while left:
            alone = alone[count[alone] == 1]
            if not len(alone):
                return None
            gone, pick = np.unique(who[alone], return_index=True)
            order.append((gone, alone[pick]))
            left -= len(gone)
            for s in slots[:, gone]:
                np.subtract.at(count, s, 1)
                np.bitwise_xor.at(who, s, gone)
            alone = np.unique(slots[:, gone])
        return order

    def has(self, keys: np.ndarray) -> np.ndarray:
        slots, prints = _slots(keys, self.seed, self.seg_len, self.n_seg)
        return prints == self.table[slots[0]] ^ self.table[slots[1]] ^ self.table[slots[2]]


@dataclass
class Snapshot:
    """Immutable: ``docs`` (doc_id, text, digest), ``groups`` (digest, last_id, n) and ``filters`` per bucket."""

    docs: DataFrame
    groups: DataFrame
    filters: DataFrame
    n_buckets: int


def with_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    rows = documents(docs, id_col, text_col)
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int").alias("bucket")


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.max("doc_id").alias("last_id"), F.count("*").alias("n"))


def _key() -> Column:
    """64 bits of the digest as a number, the key of the filters."""
    return F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("bigint").alias("key")


def take_snapshot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Snapshot:
    """Digest table and filters of ``docs``, written to the shared folder; buckets grow with the digests."""
    rows = with_digest(docs, id_col, text_col)
    groups = write_table(_grouped(rows), "snapshot")
    n_buckets = max(1, -(-groups.count() // KEYS_PER_FILTER))

    def build(key, table):
        f = FuseFilter.build(table.column("key").to_numpy().astype(np.uint64))
        row = {"bucket": [key[0].as_py()], "seed": [f.seed], "seg_len": [f.seg_len], "n_seg": [f.n_seg], "table": [f.table.tobytes()]}
        return pa.table(row, schema=pa.schema([("bucket", pa.int32()), ("seed", pa.int32()), ("seg_len", pa.int32()), ("n_seg", pa.int32()), ("table", pa.binary())]))

    filters = groups.select(_bucket(n_buckets), _key()).groupBy("bucket").applyInArrow(
        build, "bucket int, seed int, seg_len int, n_seg int, table binary"
    )
    return Snapshot(rows, groups, write_table(filters, "filters"), n_buckets)


def screen(digests: DataFrame, snapshot: Snapshot) -> DataFrame:
    """The digests (distinct) that the snapshot's filters let through; the others are certainly new."""
    out = pa.schema([("digest", pa.binary())])

    def probe(key, keys, filters):
        if not keys.num_rows or not filters.num_rows:
            return out.empty_table()
        f = filters.to_pylist()[0]
        fuse = FuseFilter(f["seed"], f["seg_len"], f["n_seg"], np.frombuffer(f["table"], np.uint8))
        hit = fuse.has(keys.column("key").to_numpy().astype(np.uint64))
        return pa.table({"digest": keys.column("digest").filter(pa.array(hit))}, schema=out)

    bounded_batches(digests.sparkSession)
    keyed = digests.select(_bucket(snapshot.n_buckets), "digest", _key())
    return keyed.groupBy("bucket").cogroup(snapshot.filters.groupBy("bucket")).applyInArrow(probe, "digest binary")


def in_buckets(hits: DataFrame, snapshot: Snapshot) -> DataFrame:
    """Those of the screened digests that the exact buckets hold; what the filters rejected never meets them."""
    return hits.join(snapshot.groups.select("digest"), "digest", "left_semi")


def exact_duplicates(batch: DataFrame, snapshot: Snapshot, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of the batch and of the snapshot: doc_id, keep_id, group_size, kept, digest (binary).

    Equal texts form a group, of which the row with the largest doc_id stays. Null text counts as empty.
    Rows that repeat (same id and text) count each in group_size and are all ``kept`` where their id is
    the largest. A null doc_id never stays unless its whole group has none (then keep_id is null, kept
    false). Empty inputs give no rows. Two texts with one SHA-256 would be found by the byte check and
    end the job rather than be merged.
    """
    new = with_digest(batch, id_col, text_col)
    groups = write_table(_grouped(new), "batch")
    met = in_buckets(screen(groups.select("digest"), snapshot), snapshot)
    # Texts that must be compared: repeats within the batch, those in a bucket of the snapshot, and its own repeats.
    repeated = groups.where("n > 1").select("digest").union(snapshot.groups.where("n > 1").select("digest"))
    suspects = write_table(met.union(repeated).distinct(), "suspects")
    # Their texts are fetched by a key of the row, not by the digest, so copies stay spread over all tasks
    # and are pre-aggregated there before they meet.
    everything = new.union(snapshot.docs).withColumn("row", F.xxhash64("doc_id", "digest"))
    wanted = everything.select("row", "digest").join(suspects, "digest", "left_semi").select("row")
    texts = everything.join(wanted.hint("merge"), "row", "left_semi")
    exact = texts.groupBy("digest", "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    exact = exact.groupBy("digest").agg(
        F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count("*").alias("texts")
    )
    exact = write_table(exact, "groups")
    rows = everything.select("doc_id", "digest").join(exact, "digest", "left")
    one = F.when(F.col("texts") > 1, F.raise_error(F.lit("two texts share a SHA-256"))).otherwise(F.col("group_size"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return rows.select(
        "doc_id", keep.alias("keep_id"), F.coalesce(one, F.lit(1)).cast("bigint").alias("group_size"),
        F.coalesce(F.col("doc_id") == keep, F.lit(False)).alias("kept"), "digest",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``exact_duplicates`` within one table: half of the ids plays the snapshot, the other half the batch."""
    half = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("bigint")), F.lit(2))
    return exact_duplicates(docs.where(half == 1), take_snapshot(docs.where(half == 0), id_col, text_col), id_col, text_col)
