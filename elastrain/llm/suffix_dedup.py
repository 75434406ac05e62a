"""Removal of repeated byte strings: every byte covered by a ``length``-byte string that starts elsewhere too.

All strings of ``length`` bytes are dealt to suffix arrays that fit in a task, so that equal strings
meet. A string is represented by its anchor, the smallest hash among its ``GRAM``-byte substrings (the
leftmost of equals): equal strings have equal anchors at equal places. Neighbouring strings mostly share
their anchor, so a text falls into *stretches*, about one for every 150 bytes, each standing for all
strings of one anchor. Equal stretches need no sorting: all their strings are repeated. Different
stretches with one anchor are sorted together (``suffix_sort``), each text once and cut to what it
shares. Anchors with very many different stretches are split: stretches are cut into pieces, each with the
strings that start in one range before the anchor. Strings of a range share a core around the anchor, longer than
the anchor by what the range is narrower, so pieces with different cores fall apart and pieces cut to the same
bytes become one. Ranges get narrower until every group fits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from elastrain.llm.common import arrow_map, bounded_batches, column, row_key, whole_text, write_table
from elastrain.llm.suffix_sort import repeated_starts

LENGTH = 400
GRAM = 100
#: Stretches of one anchor, or pieces with one core, that are sorted in one task; more are cut FAN times narrower.
TOGETHER, FAN = 400, 4
BYTES_AT_ONCE = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_TABLE = np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64)


def gram_hashes(text: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every substring of ``gram`` bytes, put together from those of powers of two."""
    block, power = _TABLE[text], 1
    whole, done = None, 0
    while power <= gram:
        if gram & power:
            if whole is None:
                whole = block
            else:
                n = len(block) - done
                whole = whole[:n] * np.uint64(pow(_BASE, power, 1 << 64)) + block[done : done + n] if n > 0 else block[:0]
            done += power
        if 2 * power <= gram:
            n = len(block) - power
            block = block[:n] * np.uint64(pow(_BASE, power, 1 << 64)) + block[power:] if n > 0 else block[:0]
        power *= 2
    h = whole[: max(0, len(text) - gram + 1)]
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def smallest_in(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each run of ``width`` values, by doubling."""
    power = 1
    while power * 2 <= width:
        values = np.minimum(values[:-power], values[power:])
        power *= 2
    rest = width - power
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def stretches(raw: bytes, length: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(anchor's hash, hash of the stretch, first string, last string, anchor) of a text, places in bytes."""
    for base in range(0, len(raw) - length + 1, BYTES_AT_ONCE):
        part = raw[base : base + BYTES_AT_ONCE + length - 1]
        hashes = gram_hashes(np.frombuffer(part, np.uint8), gram)
        place = np.uint64((1 << 22) - 1)
        keys = (hashes & ~place) | np.arange(len(hashes), dtype=np.uint64)
        anchor = (smallest_in(keys, length - gram + 1) & place).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        last = np.concatenate([first[1:], [len(anchor)]]) - 1
        own = hashes[anchor[first]].view(np.int64).tolist()
        for h, lo, hi, a in zip(own, first.tolist(), last.tolist(), anchor[first].tolist()):
            yield h, _signed(xxhash.xxh3_64_intdigest(part[lo : hi + length])), base + lo, base + hi, base + a


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pack(lo: int, hi: int, anchor: int) -> int:
    """First string (40 bits), number of further ones and distance to the anchor (12 bits each) as one number."""
    return lo << 24 | (hi - lo) << 12 | anchor - lo


def _unpack(p: int) -> tuple[int, int, int]:
    return p >> 24, (p >> 24) + (p >> 12 & 4095), (p >> 24) + (p & 4095)


def _shared(a: bytes, b: bytes) -> int:
    return len(commonprefix((a, b)))


def _neighbours(texts: list[bytes]) -> list[int]:
    """How much of its front each text shares with any other of them."""
    order = sorted(range(len(texts)), key=texts.__getitem__)
    best = [0] * len(texts)
    for a, b in zip(order, order[1:]):
        same = _shared(texts[a], texts[b])
        best[a], best[b] = max(best[a], same), max(best[b], same)
    return best


def repeats_in_group(texts: list[bytes], anchors: list[int], sure: list[bool], length: int) -> list[list[tuple[int, int]]]:
    """For different stretches with one anchor: the runs (first, last) of starts of strings that stand in another one too.

    ``sure`` marks stretches that stand more than once, whose strings are known to be repeated: they
    count as partners, and their own result is left empty.
    """
    left = _neighbours([t[:a][::-1] for t, a in zip(texts, anchors)])
    right = _neighbours([t[a:] for t, a in zip(texts, anchors)])
    cut: dict[bytes, list[int]] = {}
    for i, (t, a) in enumerate(zip(texts, anchors)):
        if left[i] + right[i] >= length:
            cut.setdefault(t[a - left[i] : a + right[i]], []).append(i)
    runs: list[list[tuple[int, int]]] = [[] for _ in texts]
    alone = [t for t, who in cut.items() if len(who) == 1 and not sure[who[0]]]
    pool = list(cut) if alone else []
    starts = dict(zip(pool, repeated_starts(pool, length))) if len(pool) > 1 else {}
    for t, who in cut.items():
        every = len(who) > 1 or sure[who[0]]
        found = range(len(t) - length + 1) if every else starts.get(t, [])
        for i in who:
            if not sure[i] and found:
                at = np.asarray(found) + anchors[i] - left[i]
                breaks = np.flatnonzero(np.diff(at) != 1)
                runs[i] = list(zip(at[np.concatenate([[0], breaks + 1])].tolist(), at[np.concatenate([breaks, [-1]])].tolist()))
    return runs


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans (end exclusive) as maximal runs."""
    out: list[list[int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [tuple(x) for x in out]


_SPAN = "doc_id bigint, key binary, start bigint, end bigint"


def _anchored(rows: DataFrame, length: int, gram: int) -> DataFrame:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            own, out = [], []
            for i, raw in enumerate(batch.column(2).to_pylist()):
                found = [(h, d, _pack(lo, hi, a)) for h, d, lo, hi, a in stretches(raw, length, gram)]
                own += [i] * len(found)
                out += found
            h, d, at = (np.array(v, np.int64) for v in zip(*out)) if out else (np.zeros(0, np.int64),) * 3
            take = pa.array(own, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(take), batch.column(1).take(take), pa.array(h), pa.array(d), pa.array(at)], names=["doc_id", "key", "h", "d", "at"]
            )

    return arrow_map(rows, run, "doc_id bigint, key binary, h bigint, d bigint, at bigint")


def _with_text(chosen: DataFrame, rows: DataFrame, length: int) -> DataFrame:
    """Stretches (doc_id, key, h, d, at, n, many) with their bytes: places are gathered by document, and meet its text once."""
    wanted = chosen.groupBy("doc_id", "key").agg(F.collect_list(F.struct("h", "d", "at", "n", "many")).alias("wanted"))
    met = rows.join(wanted.hint("merge"), ["doc_id", "key"]).select("doc_id", "key", "raw", "wanted")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for doc, key, raw, wanted in zip(*(batch.column(i).to_pylist() for i in range(4))):
                places = [_unpack(w["at"]) for w in wanted]
                of = lambda name, kind: pa.array([w[name] for w in wanted], kind)  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([doc] * len(wanted), pa.int64()), pa.array([key] * len(wanted), pa.binary()), of("h", pa.int64()), of("d", pa.int64()),
                        of("at", pa.int64()), of("n", pa.int64()), of("many", pa.bool_()),
                        pa.array([raw[lo : hi + length] for lo, hi, _ in places], pa.binary()),
                    ],
                    names=["doc_id", "key", "h", "d", "at", "n", "many", "text"],
                )

    return arrow_map(met, run, "doc_id bigint, key binary, h bigint, d bigint, at bigint, n bigint, many boolean, text binary")


def _sorted_groups(texts: DataFrame, length: int) -> DataFrame:
    out = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("start", pa.int64()), ("end", pa.int64())])

    def run(table):
        columns = {name: table.column(name).to_pylist() for name in ("doc_id", "key", "at", "n", "text")}
        places = [_unpack(p) for p in columns["at"]]
        found = repeats_in_group(columns["text"], [a - lo for lo, _, a in places], [n > 1 for n in columns["n"]], length)
        rows = [
            (doc, key, lo + first, lo + last + length)
            for doc, key, (lo, _, _), runs in zip(columns["doc_id"], columns["key"], places, found) for first, last in runs
        ]
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 4, out)], schema=out)

    bounded_batches(texts.sparkSession)
    return texts.groupBy("h").applyInArrow(run, _SPAN)


def _cut(texts: DataFrame, length: int, gram: int, width: int) -> DataFrame:
    """Stretches as pieces: strings that start ``width * k`` to ``width * (k + 1) - 1`` bytes before the anchor, k = 0, 1, ...

    h becomes the hash of the core, the bytes that all strings of such a range share if they have one anchor; d that
    of the piece. Equal strings have equal anchors at equal distances, so they come into pieces with one core.
    """
    out = pa.schema([
        ("doc_id", pa.int64()), ("key", pa.binary()), ("h", pa.int64()), ("d", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("text", pa.binary())])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            rows = []
            for doc, key, at, n, text in zip(*(column(batch, name) for name in ("doc_id", "key", "at", "n", "text"))):
                lo, hi, a = _unpack(at)
                for near in range((a - hi) // width * width, a - lo + 1, width):
                    far = min(near + width - 1, length - gram)
                    first, last = max(lo, a - far), min(hi, a - near)
                    piece, core = text[first - lo : last - lo + length], text[a - near - lo : a - far - lo + length]
                    h, d = xxhash.xxh3_64_intdigest(core, near), xxhash.xxh3_64_intdigest(piece, a - first)
                    rows.append((doc, key, _signed(h), _signed(d), _pack(first, last, a), n, piece))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [()] * 7, out)], schema=out)

    return arrow_map(texts, run, "doc_id bigint, key binary, h bigint, d bigint, at bigint, n bigint, text binary")


def _whole(stretched: DataFrame, length: int) -> DataFrame:
    """The spans of whole stretches or pieces."""
    start, more = F.shiftright("at", 24), F.shiftright("at", 12).bitwiseAND(F.lit(4095))
    return stretched.select("doc_id", "key", start.alias("start"), (start + more + length).alias("end"))


def _narrowed(texts: DataFrame, length: int, gram: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of stretches whose anchors have too many: spans of pieces that stand more than once, and the other pieces in groups
    that fit in a task."""
    spans, groups, width = [], [], length - gram + 1
    while not texts.isEmpty():
        width = -(-width // FAN)
        pieces = write_table(_cut(texts, length, gram, width), "pieces")
        one = F.min(F.struct("doc_id", "key", "at", "text")).alias("one")
        distinct = write_table(pieces.groupBy("h", "d").agg(F.sum("n").alias("n"), one).select("h", "d", "n", "one.*"), "distinct-pieces")
        spans.append(_whole(pieces.join(distinct.where("n > 1").select("h", "d"), ["h", "d"], "left_semi"), length))
        met = distinct.groupBy("h").agg(F.count("*").alias("pieces")).where("pieces > 1")
        # Of single strings those with one core are equal, so at width 1 nothing is left to be cut.
        few = F.col("pieces") <= (TOGETHER if width > 1 else 1 << 62)
        groups.append(distinct.join(met.where(few).select("h"), "h", "left_semi"))
        texts = distinct.join(met.where(~few).select("h"), "h", "left_semi")
    return spans, groups


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """Written spans (doc_id, key, start, end) in bytes whose strings are repeated; they may overlap. key tells rows with one id apart."""
    rows = _keyed(docs, id_col, text_col)
    anchored = write_table(_anchored(rows.where(F.octet_length("raw") >= length), length, gram), "stretches")
    distinct = anchored.groupBy("h", "d").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "key", "at")).alias("one"))
    distinct = write_table(distinct.select("h", "d", "n", "one.*"), "distinct-stretches")
    copies = distinct.where("n > 1").select("h", "d")
    met = distinct.groupBy("h").agg(F.count("*").alias("stretches")).where("stretches > 1")
    chosen = distinct.join(met, "h").withColumn("many", F.col("stretches") > TOGETHER).drop("stretches")
    texts = write_table(_with_text(chosen, rows, length), "stretch-texts")

    parts, groups = _narrowed(texts.where("many"), length, gram)
    parts.append(_whole(anchored.join(copies, ["h", "d"], "left_semi"), length))
    together = reduce(DataFrame.unionByName, (df.select("h", "doc_id", "key", "at", "n", "text") for df in (texts.where("NOT many"), *groups)))
    return write_table(reduce(DataFrame.union, parts).union(_sorted_groups(together, length)).distinct(), "repeated-spans")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(docs, text_col)
    id_ = F.col(f"`{id_col}`").cast("bigint")
    return docs.select(id_.alias("doc_id"), row_key(id_, text).alias("key"), text.cast("binary").alias("raw"))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per input row: doc_id, n_bytes, spans (maximal removed runs of bytes, end exclusive), kept (binary).

    Strings lie within one text and are judged on the input. Null and empty texts, and texts shorter
    than ``length``, keep all they have. Rows that repeat are texts of their own, so all but short ones
    lose everything. An empty table gives no rows. Rows without an id are each judged like any other.
    """
    if not 0 < gram <= length or length - gram >= 4096:
        raise ValueError("gram must be at most length, and less than 4096 shorter")
    docs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(-(1 << 63))).alias("doc_id"), whole_text(docs, text_col).alias("text"))
    spans = repeated_spans(docs, "doc_id", "text", length, gram)
    by_doc = spans.groupBy("doc_id", "key").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    met = _keyed(docs, "doc_id", "text").join(by_doc.hint("merge"), ["doc_id", "key"], "left").select("doc_id", "raw", "spans")
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            size, out, kept = [], [], []
            for raw, found in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs = merged([(s["start"], s["end"]) for s in found or ()])
                edges = [0, *(x for run in runs for x in run), len(raw)]
                size.append(len(raw))
                out.append([{"start": lo, "end": hi} for lo, hi in runs])
                kept.append(b"".join(raw[lo:hi] for lo, hi in zip(edges[::2], edges[1::2])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(out, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"]
            )

    done = arrow_map(met, run, "doc_id bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
    return done.withColumn("doc_id", F.when(F.col("doc_id") != F.lit(-(1 << 63)), F.col("doc_id")))
