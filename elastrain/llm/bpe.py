"""Byte-level BPE: vectorised pre-tokenisation, cached pair merging, decoding by retained offsets.

Text becomes an array of code points and, by one table lookup, an array of character classes. Where a
token starts depends on neighbouring classes only, but for the contractions ('s, 't, 're, ...), which
need an apostrophe at the start of a token. Those are found by a small automaton: every class is a
transition function, the functions are closed under composition, and a blocked scan composes them over
the whole array with one table lookup per character. No regular expression is used.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from elastrain.llm.common import arrow_map, column, documents, grouped

# Classes of characters. Letters that matter in contractions have their own.
SPACE, WHITE, LETTER, STMD, R_V, L, E, NUMBER, QUOTE, OTHER, END = range(11)
KIND = np.array([0, 0, 1, 1, 1, 1, 1, 2, 3, 3, 4], np.uint8)  # white, letter, number, other, end
# The White_Space property.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0                　"

# States: a quote would start a token; would not; was the start; then r or v; then l; contraction complete.
FRESH, INSIDE, QUOTED, QUOTED_RV, QUOTED_L, DONE = range(6)
BLOCK = 128
CACHE_SIZE, CACHE_CHARS = 150_000, 40
#: Characters encoded, and tokens decoded, at a time: arrays of a task are some dozen bytes for each.
CHARS_AT_ONCE = 1 << 18
TOKENS_AT_ONCE = 1 << 16
SHORT = 100


def _step(state: int, cls: int) -> int:
    if cls == QUOTE:
        return INSIDE if state in (INSIDE, QUOTED) else QUOTED
    if cls in (SPACE, OTHER):
        return INSIDE
    if (state, cls) in ((QUOTED, STMD), (QUOTED_RV, E), (QUOTED_L, L)):
        return DONE
    if state == QUOTED and cls in (R_V, L):
        return QUOTED_RV if cls == R_V else QUOTED_L
    return FRESH


@lru_cache(1)
def functions() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Function of each class, table of compositions (f then g), and the functions' values by state."""
    known: dict[tuple, int] = {}
    for cls in range(END + 1):
        known.setdefault(tuple(_step(s, cls) for s in range(6)), len(known))
    of_class = np.array([known[tuple(_step(s, c) for s in range(6))] for c in range(END + 1)], np.uint8)
    values, at = list(known), 0
    while at < len(values):
        for other in list(values):
            for f, g in ((values[at], other), (other, values[at])):
                both = tuple(g[x] for x in f)
                if both not in known:
                    known[both] = len(known)
                    values.append(both)
        at += 1
    table = np.array([[known[tuple(g[x] for x in f)] for g in values] for f in values], np.uint8)
    return of_class, table, np.array(values, np.uint8)


@lru_cache(1)
def class_table() -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    kinds = "".join(unicodedata.category(chr(c))[0] for c in range(0x110000))
    codes = np.frombuffer(kinds.encode(), np.uint8)
    table[codes == ord("L")], table[codes == ord("N")] = LETTER, NUMBER
    table[[ord(c) for c in WHITE_SPACE]] = WHITE
    for chars, cls in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("rv", R_V), ("l", L), ("e", E)):
        table[[ord(c) for c in chars]] = cls
    return table


def scan(f: np.ndarray) -> np.ndarray:
    """Prefix compositions of an array of functions, by blocks: within all at once, then over their ends."""
    _, table, _ = functions()
    n, width = len(f), table.shape[0]
    flat = table.ravel()
    if n <= BLOCK:
        out = f.copy()
        for i in range(1, n):
            out[i] = table[out[i - 1], f[i]]
        return out
    blocks = -(-n // BLOCK)
    grid = np.zeros(blocks * BLOCK, np.uint8)
    grid[:n] = f
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    for i in range(1, BLOCK):
        grid[i] = flat.take(grid[i - 1].astype(np.intp) * width + grid[i])
    before = scan(grid[-1])[:-1]
    grid[:, 1:] = flat.take(before.astype(np.intp)[None, :] * width + grid[:, 1:])
    return grid.T.ravel()[:n]


def token_starts(classes: np.ndarray) -> np.ndarray:
    """Where tokens start, for texts each closed by END (which counts as a token of its own)."""
    of_class, _, values = functions()
    kind = KIND[classes]
    start = np.empty(len(kind), bool)
    start[0] = True
    start[1:] = kind[1:] != kind[:-1]
    start[1:] |= kind[:-1] == 4
    last_white = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & (kind[1:] != 4))
    start[last_white] = True  # white space before a token gives up its last character
    start[1 + last_white[classes[last_white] == SPACE]] = False  # which joins the token if it is a blank
    if (classes == QUOTE).any():
        state = values[scan(of_class[classes]), FRESH]
        done = np.flatnonzero(state == DONE)
        start[np.where(classes[done] == STMD, done, done - 1)] = False
        start[done + 1] = True
    return np.flatnonzero(start)


@lru_cache(2)
def vocabulary(raw: bytes) -> tuple[dict[bytes, int], np.ndarray, np.ndarray]:
    """Ranks by bytes; all tokens' bytes in one array; where each token's bytes begin (one more than ids)."""
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}
    words = [b""] * (max(ranks.values()) + 1)
    for word, rank in ranks.items():
        words[rank] = word
    return ranks, np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words)])


def merge(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one pre-token: the adjacent pair of lowest rank is joined first, the leftmost of equals."""
    if word in ranks:
        return (ranks[word],)
    if len(word) > SHORT:
        return _merge_long(word, ranks)
    none = len(ranks) + len(word) + 256
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], none) for i in range(len(word) - 1)]
    while pairs and (low := min(pairs)) < none:
        i = pairs.index(low)
        parts[i] += parts.pop(i + 1)
        pairs.pop(i)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], none)
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], none)
    return tuple([ranks[p] for p in parts])


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """The same with a heap over linked parts, so that a very long pre-token takes n log n."""
    n = len(word)
    ends, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), bytearray(n)
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, end = heapq.heappop(heap)
        mid = ends[i]
        if gone[i] or mid >= n or ends[mid] != end:
            continue
        gone[mid], ends[i] = 1, end
        if end < n:
            before[end] = i
            if (r := ranks.get(word[i : ends[end]])) is not None:
                heapq.heappush(heap, (r, i, ends[end]))
        if (p := before[i]) >= 0 and (r := ranks.get(word[p:end])) is not None:
            heapq.heappush(heap, (r, p, end))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return tuple(out)


class Merges(dict):
    """Ids by pre-token. Long ones are not kept, and a full cache starts anew, so memory is bounded."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks

    def __missing__(self, token: str) -> tuple[int, ...]:
        ids = merge(token.encode(), self.ranks) if token else ()
        if len(token) <= CACHE_CHARS:
            if len(self) >= CACHE_SIZE:
                self.clear()
            self[token] = ids
        return ids


@lru_cache(2)
def merges_of(raw: bytes) -> Merges:
    """One cache for all tasks that a Python worker runs."""
    return Merges(vocabulary(raw)[0])


def encode_texts(texts: list[str], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, and how many each has."""
    text = "\0".join(texts) + "\0"
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    classes = class_table()[codes]
    classes[ends] = END
    starts = token_starts(classes)
    at = starts.tolist()
    tokens = [text[lo:hi] for lo, hi in zip(at, at[1:] + [len(text)])]
    closing = np.searchsorted(starts, ends)
    for i in closing.tolist():
        tokens[i] = ""
    ids = list(map(merges.__getitem__, tokens))
    counts = np.fromiter(map(len, ids), np.int64, len(ids))
    total = np.concatenate([[0], np.cumsum(counts)])
    return np.fromiter(chain.from_iterable(ids), np.int32, total[-1]), np.diff(np.concatenate([[0], total[closing + 1]]))


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(values, pa.int32()))


def _encoder(raw) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does to batches of (doc_id, text): doc_id, ids, starts. ``raw`` is the broadcast rank file."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, _, edges = vocabulary(raw.value)
        lengths, merges = np.diff(edges), merges_of(raw.value)
        for batch in parts:
            done = 0
            for group in grouped(column(batch, "text"), CHARS_AT_ONCE):
                ids, counts = encode_texts(group, merges)
                size = lengths[ids]
                starts = np.cumsum(size) - size
                first = np.cumsum(counts) - counts
                base = np.concatenate([starts, [0]])[first] if len(starts) else np.zeros(len(counts), np.int64)
                starts = starts - np.repeat(base, counts)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(done, len(group)), _lists(ids, counts), _lists(starts, counts)],
                    names=["doc_id", "ids", "starts"],
                )
                done += len(group)

    return run


def _by_tokens(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most TOKENS_AT_ONCE ids; a row with more is alone."""
    for batch in parts:
        ends = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, side="right")))
            yield batch.slice(lo, hi - lo)
            lo = hi


def _decoder(raw) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does to batches of (doc_id, ids, starts): the same with ``decoded``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, words, edges = vocabulary(raw.value)
        for batch in _by_tokens(parts):
            ids, starts = (batch.column(i) for i in (1, 2))
            flat, sizes = ids.flatten().to_numpy(), np.diff(ids.offsets.to_numpy())
            at = starts.flatten().to_numpy().astype(np.int64)
            length = (edges[flat + 1] - edges[flat]).astype(np.int64)
            last = np.cumsum(sizes) - 1
            whole = np.where(sizes > 0, (at + length)[np.maximum(last, 0)] if len(flat) else 0, 0)
            base = np.repeat(np.cumsum(whole) - whole, sizes) + at
            first = np.repeat(np.cumsum(length) - length, length)
            within = np.arange(len(first)) - first
            out = np.empty(int(whole.sum()), np.uint8)
            out[np.repeat(base, length) + within] = words[np.repeat(edges[flat], length) + within]
            bounds = pa.py_buffer(np.concatenate([[0], np.cumsum(whole)]).astype(np.int32).tobytes())
            decoded = pa.Array.from_buffers(pa.binary(), len(sizes), [None, bounds, pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=["doc_id", "ids", "starts", "decoded"])

    return run


def _sent(df: DataFrame, ranks_path: str):
    """The rank file, read by the driver and broadcast."""
    with open(ranks_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


_ENCODED = "doc_id bigint, ids array<int>, starts array<int>"


def encode(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, ids, starts (byte offset of each token in the text's UTF-8).

    Null and empty texts have no ids. Rows that repeat are each returned; an empty table gives no rows;
    columns other than id and text are not read. The rank file is read by the driver and sent along.
    """
    return arrow_map(documents(docs, id_col, text_col), _encoder(_sent(docs, ranks_path)), _ENCODED)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """Rows of ``encode`` (doc_id, ids, starts) with ``decoded``: the bytes of the tokens, laid at their offsets."""
    return arrow_map(encoded.select("doc_id", "ids", "starts"), _decoder(_sent(encoded, ranks_path)), f"{_ENCODED}, decoded binary")


def round_trip(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``decode`` of ``encode``, a batch at a time in the same Python worker.

    Chained as two queries, every task would run two workers, with a vocabulary and waiting batches each.
    """
    raw = _sent(docs, ranks_path)
    encoder, decoder = _encoder(raw), _decoder(raw)
    return arrow_map(documents(docs, id_col, text_col), lambda parts: decoder(encoder(parts)), f"{_ENCODED}, decoded binary")
