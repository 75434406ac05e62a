"""Near copies by the overlap of word shingles.

Two texts are linked when the sets of their word shingles have a Jaccard similarity of at least
``similarity``, which is computed from the sets themselves. Near-equal texts are found first, by SimHash: texts
whose fingerprints are linked at RADIUS bits (``simhash``) are compared with one of their component. Whoever agrees
with it is one group from then on. Texts near ``similarity`` are farther apart than that (at 0.8 fingerprints of 64
bits differ in about 10), so further candidates are texts that agree in one of BANDS groups of MinHash values of
these sets: a pair at 0.8 is one with probability 0.9996, at 0.9 with more than 1 - 1e-7.

A bucket (a SimHash component, or a MinHash band) that still has more than one group is compared with one of its texts
outside the largest one. So a large group of copies makes few pairs. What is
still apart is joined by prefixes of its sets: with shingles in one order, rare ones first, two sets that overlap
enough share one among the first few of each (a fifth of the larger set, a ninth of the smaller), so texts that have a
template in common, but not enough of it, never meet, and no link is lost. Under each shingle all are compared with the
few most usual sets first, which leaves few links to the join of all others, where a pair is one row however much it shares.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from elastrain.llm.common import arrow_map, column, row_key, write_table
from elastrain.llm.components import smallest_reachable
from elastrain.llm.simhash import hamming_links, simhash

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints are linked at this many differing bits.
RADIUS = 3
BANDS, ROWS = 20, 5
#: 64-bit words of a parity sketch.
WORDS = 32
#: Sets under one shingle that all others of it are compared with, before what is left is joined.
CENTRES = 4
#: Sizes times the similarity may come out a hair above a whole number.
SLACK = 1e-9
SEED = 42
SHINGLES_AT_ONCE = 1 << 12

_DRAW = np.random.default_rng(SEED)
_FACTOR = (_DRAW.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) | np.uint32(1))
_SHIFT = _DRAW.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32)


def shingles(raw: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Distinct XXH64 hashes of the word shingles of a text in UTF-8; fewer words are one shingle, no words the empty one."""
    words = raw.lower().split()  # on bytes, as in simhash
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    digest, join, parts = xxhash.xxh64_digest, b" ".join, []
    total = len(words) - shingle + 1
    for lo in range(0, total, SHINGLES_AT_ONCE):
        part = words[lo : lo + SHINGLES_AT_ONCE + shingle - 1]
        grams = map(join, zip(*(part[i:] for i in range(shingle))))
        parts.append(np.frombuffer(b"".join([digest(g, SEED) for g in grams]), ">u8"))
    return np.unique(np.concatenate(parts).astype(np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit number a band, made of ROWS MinHash values."""
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    for lo in range(0, len(short), SHINGLES_AT_ONCE):
        np.minimum(low, (short[lo : lo + SHINGLES_AT_ONCE] * _FACTOR + _SHIFT).min(axis=1), out=low)
    values = [xxhash.xxh64_digest(low[i * ROWS : (i + 1) * ROWS].tobytes(), i) for i in range(BANDS)]
    return [int.from_bytes(v, "big", signed=True) for v in values]


def _signatures(rows: DataFrame, shingle: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sets = [shingles(raw, shingle) for raw in column(batch, "raw")]
            fps = [simhash(raw) for raw in column(batch, "raw")]
            arrays = [batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(fps, pa.int64()), pa.array(map(bands, sets), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["node", "n", "fp", "bands"])

    return arrow_map(rows, run, "node binary, n bigint, fp bigint, bands array<bigint>")


def _sets(rows: DataFrame, shingle: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for node, raw in zip(batch.column(0), batch.column(1)):
                found = pa.array([shingles(raw.as_py(), shingle).view(np.int64)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array([node.as_py()], pa.binary()), found], names=["node", "found"])

    return arrow_map(rows, run, "node binary, found array<bigint>")


def similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets overlap enough."""
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("found").alias("of_a")), "a")
    both = both.join(sets.select(F.col("node").alias("b"), F.col("found").alias("of_b")), "b")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(shared >= F.lit(similarity) * (F.size("of_a") + F.size("of_b") - shared)).select("a", "b")


def _pairs(found: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs of (node, n, other, other_n), without those whose sizes alone rule them out."""
    sizes = F.least("n", "other_n") >= F.lit(similarity) * F.greatest("n", "other_n")
    return found.where(sizes & (F.col("node") != F.col("other"))).select(
        F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")
    ).distinct()


def parities(hashes: np.ndarray) -> list[int]:
    """WORDS signed words: bit i tells whether an odd number of the hashes falls on i. Where two sketches differ, so do the sets."""
    odd = np.bincount((hashes % np.uint64(64 * WORDS)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _sketches(sets: DataFrame) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            odd = [parities(f.values.to_numpy().view(np.uint64)) for f in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(odd, pa.list_(pa.int64()))], names=["node", "odd"])

    words = [F.col("odd")[i].alias(f"odd{i}") for i in range(WORDS)]
    return write_table(arrow_map(sets.select("node", "found"), run, "node binary, odd array<bigint>").select("node", *words), "parities")


def prefixes(sets: DataFrame, similarity: float) -> DataFrame:
    """The rows (shingle, node, n, place) by which sets of (node, found) that can overlap enough meet, with their sketches.

    In the order of shingles by how many sets have them, a pair of sizes m <= n shares a shingle among the first
    m - p + 1 and n - q + 1 of its sets, where p and q are the least overlaps that any partner of such a size asks for.
    ``before`` has the shingles of earlier places, ``usual`` tells in how many sets a shingle of this one is on average.
    """
    rows = sets.select("node", F.size("found").alias("n"), F.explode("found").alias("shingle"))
    rows = write_table(rows, "shingle-rows")
    common = rows.groupBy("shingle").agg(F.count("*").alias("times"))
    by_node = W.partitionBy("node")
    in_order = by_node.orderBy("times", "shingle")
    ranked = rows.join(common, "shingle").withColumn("place", F.row_number().over(in_order)).withColumn("usual", F.avg("times").over(by_node))
    ranked = ranked.where("times > 1").where(F.col("place") <= F.col("n") - _least("n", similarity) + 1)
    earlier = F.collect_list("shingle").over(in_order.rowsBetween(W.unboundedPreceding, -1))
    ranked = ranked.withColumn("before", earlier).select("shingle", "node", "n", "place", "usual", "before")
    return write_table(ranked.join(_sketches(sets), "node"), "prefixes")


def _least(size: str, part: float) -> Column:
    return F.ceil(F.col(size) * part - SLACK)


def _can_overlap(similarity: float) -> Column:
    """Whether the sets of a row and of its partner (other_*) can be similar, if this is the first shingle that they share.

    Behind it both must have enough left for the overlap that this pair asks for, and their parity sketches must
    not differ in more bits than the sets may in shingles. Both bounds are exact.
    """
    after = F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place"))
    enough = after + 1 >= F.ceil((F.col("n") + F.col("other_n")) * (similarity / (1 + similarity)) - SLACK)
    differ = sum((F.bit_count(F.col(f"odd{i}").bitwiseXOR(F.col(f"other_odd{i}"))) for i in range(WORDS)), F.lit(0))
    return enough & (differ <= (F.col("n") + F.col("other_n")) * ((1 - similarity) / (1 + similarity)) + SLACK)


def _partners(rows: DataFrame) -> DataFrame:
    return rows.select("shingle", *(F.col(c).alias(f"other_{c}") for c in rows.columns if c != "shingle"))


def _rooted(found: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of the prefix rows whose shingle has more than one component, with root."""
    rows = found.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rows.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low != high")
    return rows.join(mixed.select("shingle"), "shingle", "left_semi")


def central_pairs(rooted: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs of the sets that meet under a shingle with the CENTRES most usual of these, each of another component.

    Copies that were changed at different places are farther from each other than from the text that they come from,
    and whoever is nearest to it has the most usual shingles. So its links leave little to be compared in pairs.
    """
    best = rooted.groupBy("shingle", "root").agg(F.max(F.struct("usual", "node")).alias("best"))
    nth = F.row_number().over(W.partitionBy("shingle").orderBy(F.desc("best")))
    chosen = best.withColumn("nth", nth).where(F.col("nth") <= CENTRES).select("shingle", F.col("best.node").alias("node"))
    centres = rooted.drop("before").join(chosen, ["shingle", "node"])
    met = rooted.drop("before").join(_partners(centres), "shingle").where((F.col("root") != F.col("other_root")) & _can_overlap(similarity))
    return _pairs(met.select("node", "n", F.col("other_node").alias("other"), "other_n"), similarity)


def first_meetings(rooted: DataFrame, similarity: float) -> DataFrame:
    """One row (node, n, other, other_n) for each two sets of different components that can overlap enough: at the first
    shingle that they share, with the bounds of ``prefixes`` and ``_can_overlap``."""
    smaller = rooted.where(F.col("place") <= F.col("n") - _least("n", 2 * similarity / (1 + similarity)) + 1)
    fits = (F.col("n") < F.col("other_n")) | ((F.col("n") == F.col("other_n")) & (F.col("node") < F.col("other_node")))
    first = ~F.arrays_overlap("before", "other_before")
    met = smaller.join(_partners(rooted), "shingle").where((F.col("root") != F.col("other_root")) & fits & _can_overlap(similarity) & first)
    return met.select("node", "n", F.col("other_node").alias("other"), "other_n")


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of (node, root, found) with different roots that can overlap enough."""
    rooted = _rooted(prefixes(sets, similarity), sets.select("node", "root"))
    return _pairs(first_meetings(rooted, similarity), similarity)


def _by_simhash(signed: DataFrame) -> DataFrame:
    """(node, n, bucket) of all texts, a bucket for each component of linked fingerprints."""
    links = write_table(hamming_links(signed.select("fp"), RADIUS).distinct(), "near-simhash")
    roots = smallest_reachable(links).select(F.col("node").alias("fp"), "root")
    return signed.join(roots, "fp", "left").select("node", "n", F.coalesce("root", "fp").alias("bucket"))


def _placed(shared: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The entries of buckets with more than one component, with root and the bucket's largest component, and one
    text outside of that for each bucket."""
    placed = shared.select("bucket", "node", "n").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    counts = placed.groupBy("bucket", "root").agg(F.count("*").alias("m"))
    mixed = counts.groupBy("bucket").agg(F.max_by("root", F.struct("m", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1")
    placed = write_table(placed.join(mixed.select("bucket", "most"), "bucket"), "near-placed")
    by_lot = F.min(F.struct(F.xxhash64("bucket", "node").alias("lot"), "node", "n", "root"))
    return placed, placed.where("root != most").groupBy("bucket").agg(by_lot.alias("c"))


def _components(links: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    if roots is not None:
        links = links.union(roots.select(F.col("root").alias("a"), F.col("node").alias("b")))
    return write_table(smallest_reachable(links), "near-roots")


def later_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The row keys (node) of all rows but one of each group of texts linked directly or through others.

    ``docs`` has doc_id and text. The row with the smallest doc_id is left out of the result: of equal
    ids that with the smallest key, rows without an id after all others. Rows that share id and text
    have one key. Texts without words are equal to each other.
    """
    whole = F.coalesce("text", F.lit(""))
    rows = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("node"), whole.cast("binary").alias("raw"), "doc_id")
    signed = write_table(_signatures(rows.select("node", "raw"), shingle), "signatures")
    linked_prints = write_table(_by_simhash(signed).distinct(), "simhash-buckets")
    entries = signed.select("node", "n", F.explode("bands").alias("bucket")).distinct().withColumn("simhash", F.lit(False))
    entries = write_table(entries.union(linked_prints.withColumn("simhash", F.lit(True))), "minhash")
    met = entries.groupBy("bucket", "simhash").agg(F.count("*").alias("m")).where("m > 1").drop("m")
    shared = write_table(entries.join(met, ["bucket", "simhash"]), "minhash-shared")
    nodes = write_table(shared.select("node").distinct(), "minhash-nodes")
    sets = write_table(_sets(rows.join(nodes, "node", "left_semi").select("node", "raw"), shingle).dropDuplicates(["node"]), "shingles")

    def linked(pairs: DataFrame) -> DataFrame:
        return write_table(similar(write_table(pairs, "near-pairs"), sets, similarity), "near-links")

    near = shared.where("simhash")
    centres = near.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("bucket", "node").alias("lot"), "node", "n")).alias("c"))
    others = centres.select("bucket", F.col("c.node").alias("other"), F.col("c.n").alias("other_n"))
    roots = _components(linked(_pairs(near.join(others, "bucket"), similarity)))
    for _ in range(2):
        placed, centres = _placed(shared, roots)
        others = centres.select("bucket", F.col("c.node").alias("other"), F.col("c.n").alias("other_n"), F.col("c.root").alias("other_root"))
        again = placed.join(others, "bucket").where("root != other_root")
        roots = _components(linked(_pairs(again, similarity)), roots)
    placed, _ = _placed(shared, roots)
    found = prefixes(sets.join(placed.select("node").distinct(), "node", "left_semi"), similarity)
    roots = _components(linked(central_pairs(_rooted(found, roots), similarity)), roots)
    labels = _components(linked(_pairs(first_meetings(_rooted(found, roots), similarity), similarity)), roots)

    members = labels.union(labels.select(F.col("root").alias("node"), "root").distinct())
    known = rows.select("node", "doc_id").join(nodes, "node", "left_semi").distinct().join(members, "node")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "node")
    kept = known.groupBy("root").agg(F.min(order).alias("kept"))
    return known.join(kept, "root").where("node != kept.node").select("node")
