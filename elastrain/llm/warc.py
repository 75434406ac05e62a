"""WARC archives: writing with revisit records, and reading back with boundary-chain verification.

Archives are written by Spark's text writer: a record is a "line" that ends in CR LF CR LF. They are
read by Spark's text reader, cut at the magic "WARC/1.0" CR LF, so that any archive is split over tasks.
A piece is then a *candidate* record: its header says where its successor must begin. Magic text inside
a payload makes false candidates; pointer jumping from the start of the file keeps only the candidates
that are reached, and everything between two of them belongs to the first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from elastrain.llm.common import arrow_map, write_table

MAGIC = b"WARC/1.0\r\n"
CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"

_LENGTH = re.compile(rb"^content-length:[ \t]*([0-9]{1,18})[ \t]*\r?$", re.I | re.M)


def base32(hex_digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex (160 bits: 32 letters, no padding)."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    # Five hex digits are four letters.
    quads = [F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 10).cast("int") for i in range(8)]
    codes = [F.shiftright(q, s).bitwiseAND(F.lit(31)) for q in quads for s in (15, 10, 5, 0)]
    return F.concat(*(F.substring(letters, c + F.lit(1), F.lit(1)) for c in codes))


def plan_records(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int) -> DataFrame:
    """page_id, url, payload, its size and ``refers_to``: the id of the response that a revisit repeats (else null).

    Only digests that repeat take part in the join; they are written first, so their size is known to it.
    """
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("payload"),
    )
    key = F.unhex(F.sha2(F.col("payload").cast("binary"), 256)).alias("sha256")
    size = F.octet_length("payload").alias("payload_bytes")
    repeats = rows.select("page_id", key, size).where(F.col("payload_bytes") >= min_bytes).groupBy("sha256")
    repeats = repeats.agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    keyed = rows.select("*", key, size).join(write_table(repeats, "repeats"), "sha256", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id"))
    return keyed.select("page_id", "url", "payload", "payload_bytes", refers.alias("refers_to"))


def record_text() -> Column:
    """A planned row as a record, without its last line feed, which the writer adds."""
    sha1 = F.concat(F.lit("sha1:"), base32(F.sha1(F.col("payload").cast("binary"))))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}"),
        line("Content-Length", F.col("payload_bytes").cast("string")), F.lit(CRLF),
    )
    repeat = F.col("refers_to").isNotNull()
    block = F.when(repeat, http).otherwise(F.concat(http, F.col("payload")))
    # White space and control characters would break the header line.
    target = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    return F.concat(
        F.lit(MAGIC.decode()),
        line("WARC-Type", F.when(repeat, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")),
        line("WARC-Payload-Digest", sha1),
        F.coalesce(line("WARC-Refers-To", F.when(repeat, urn(F.col("refers_to")))), F.lit("")),
        F.when(repeat, line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(CRLF), block, F.lit(CRLF + "\r"),
    )


def write_warc(
    pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0
) -> None:
    """Write one record per row as archives under ``path``, one for each task.

    Null html is an empty payload; a null url leaves its header out. Of equal payloads of at least
    ``min_bytes`` bytes the row with the largest id is a response and the others are revisits without
    payload; rows that share that id are all responses. An empty table makes archives without records.
    """
    plan_records(pages, id_col, url_col, html_col, min_bytes).select(record_text().alias("value")).write.text(path)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("lineSep", MAGIC.decode()).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("piece")
    )


def _numbered(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes]]]:
    """Batches with the place of each piece within its split; a split's pieces come in order."""
    split, n = None, 0
    for batch in parts:
        seq = []
        for at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            n = n + 1 if at == split else 0
            split = at
            seq.append(n)
        yield batch, seq, batch.column(2).to_pylist()


def _header_end(piece: bytes) -> tuple[int, int]:
    """Where the block begins within a piece and its length; (-1, -1) if this is no record header."""
    end = piece.find(b"\r\n\r\n")
    found = _LENGTH.search(piece, 0, end + 2) if end >= 0 else None
    return (end + 4, int(found[1])) if found else (-1, -1)


def _candidates(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, seq, values in _numbered(parts):
        heads = [_header_end(v) for v in values]
        size = [len(v) + len(MAGIC) for v in values]
        claim = [len(MAGIC) + at + length + 4 if at >= 0 else -1 for at, length in heads]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(seq, pa.int64()), pa.array(size, pa.int64()), pa.array(claim, pa.int64())],
            names=["path", "block", "seq", "size", "claim"],
        )


def reached(start: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which records are reached from offset 0, by pointer jumping: each round doubles the distance covered."""
    n = len(start)
    at = np.searchsorted(start, successor)
    jump = np.append(np.where((at < n) & (start[np.minimum(at, n - 1)] == successor), at, n), n) if n else np.zeros(1, np.int64)
    seen = np.zeros(n + 1, bool)
    seen[:n] = start == 0
    distance = 1
    while distance <= n:
        seen[jump[np.flatnonzero(seen)]] = True
        jump = jump[jump]
        distance *= 2
    return seen[:n]


def _verify(key, table):
    """Of one archive: the pieces that are not by themselves one whole record, with the record that owns them."""
    table = table.sort_by([("block", "ascending"), ("seq", "ascending")])
    block, seq, size, claim = (table.column(c).to_numpy() for c in ("block", "seq", "size", "claim"))
    begin = np.cumsum(size) - size
    start, end_of_file = begin - len(MAGIC), int(size.sum()) - len(MAGIC)
    end = np.append(start[1:], end_of_file)
    successor = np.where((claim >= 0) & (start >= 0), start + claim, -1)
    # A record ends where another magic stands, or with the archive; otherwise it is broken.
    good = reached(start, successor) & (np.isin(successor, start) | (successor == end_of_file))
    plain = good & (successor == end)
    owner = np.maximum.accumulate(np.where(good, np.arange(len(good)), -1)) if len(good) else np.zeros(0, np.int64)
    inside = (owner >= 0) & (start < np.where(owner >= 0, successor[owner], 0))
    odd = np.flatnonzero(~plain & (start >= 0))
    held = inside[odd]
    pick = lambda values: pa.array(np.where(held, values[np.maximum(owner[odd], 0)], -1), pa.int64())
    return pa.table({
        "path": pa.array([key[0].as_py()] * len(odd), pa.string()), "block": pa.array(block[odd], pa.int64()),
        "seq": pa.array(seq[odd], pa.int64()), "owner_block": pick(block), "owner_seq": pick(seq),
    })


_FIELDS = {"type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "payload_digest": "warc-payload-digest", "refers_to": "warc-refers-to"}
_RECORD = "type string, record_id string, target_uri string, payload_digest string, refers_to string, http_length bigint, payload binary"


def _named(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(b":") for line in lines.split(b"\r\n"))
    return {name.strip().lower().decode("utf-8", "replace"): value.strip().decode("utf-8", "replace") for name, sep, value in pairs if sep}


def parse_record(piece: bytes) -> dict | None:
    """Fields of a record (without magic), or None if its block is not wholly in the piece."""
    at, length = _header_end(piece)
    if at < 0 or at + length + 4 > len(piece):
        return None
    named, block = _named(piece[:at]), piece[at : at + length]
    record = {field: named.get(name) for field, name in _FIELDS.items()} | {"http_length": None, "payload": block}
    if named.get("content-type", "").startswith("application/http"):
        head, _, record["payload"] = block.partition(b"\r\n\r\n")
        size = _named(head).get("content-length", "")
        record["http_length"] = int(size) if re.fullmatch("[0-9]{1,18}", size) else None
    return record


def _parsed(values: list[bytes]) -> list[pa.Array]:
    empty = dict.fromkeys([*_FIELDS, "http_length", "payload"])
    rows = [parse_record(v) or empty for v in values]
    kind = lambda name: {"http_length": pa.int64(), "payload": pa.binary()}.get(name, pa.string())
    return [pa.array([r[name] for r in rows], kind(name)) for name in empty]


_NAMES = [part.split()[0] for part in _RECORD.split(", ")]


def _number_and_parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, seq, values in _numbered(parts):
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(seq, pa.int64()), *_parsed(values)], names=["path", "block", "seq", *_NAMES]
        )


def _number(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, seq, values in _numbered(parts):
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(seq, pa.int64()), batch.column(2)], names=["path", "block", "seq", "piece"])


def _parse(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts:
        yield pa.RecordBatch.from_arrays([batch.column(0), *_parsed(batch.column(1).to_pylist())], names=["path", *_NAMES])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The verified records of all archives under ``path``: path, type, record_id, target_uri, payload_digest,
    refers_to, http_length (Content-Length of the HTTP head) and payload (the block behind that head).

    Only records that can be reached from the start of their archive are returned: magic text inside a
    payload is part of that payload, and nothing follows a broken or cut-off record. Archives without
    records give no rows. Offsets of one archive (about 40 bytes a record) meet in one task; payloads
    do not. Uncompressed archives only.
    """
    pieces = _pieces(spark, path)
    candidates = arrow_map(pieces, _candidates, "path string, block bigint, seq bigint, size bigint, claim bigint")
    odd = write_table(
        candidates.groupBy("path").applyInArrow(_verify, "path string, block bigint, seq bigint, owner_block bigint, owner_seq bigint"),
        "odd-pieces",
    )
    at = ["path", "block", "seq"]
    numbered = arrow_map(pieces, _number_and_parse, f"path string, block bigint, seq bigint, {_RECORD}")
    first = (F.col("block") == 0) & (F.col("seq") == 0)  # what stands before the first magic
    plain = numbered.where(~first).join(odd.select(*at), at, "left_anti").select("path", *_NAMES)
    owned = odd.where("owner_seq >= 0")
    if owned.isEmpty():
        return plain
    raw = arrow_map(pieces, _number, "path string, block bigint, seq bigint, piece binary").join(owned, at)
    whole = raw.groupBy("path", "owner_block", "owner_seq").agg(F.sort_array(F.collect_list(F.struct("block", "seq", "piece"))).alias("parts"))
    record = F.concat_ws(MAGIC.decode(), F.transform("parts", lambda p: p.piece.cast("string"))).cast("binary")
    return plain.union(arrow_map(whole.select("path", record.alias("piece")), _parse, f"path string, {_RECORD}"))
