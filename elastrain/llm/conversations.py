"""Conversations mended at least cost: Knuth's lightest derivations over the rows of a conversation.

The roles of a mended conversation spell ``(s?(ua)+)?``. An item (rows from the k-th last on, state p) stands for
ways to mend those rows so that the automaton of that pattern goes from p to an accepted end; keeping, reroling,
deleting or inserting a row deduces an item from another. Items are popped from an agenda by (cost, rows, audit), in
which every deduction is superior to its premise (an edit costs more, or costs nothing and takes one row
more), so an item is final when popped.

Rows are dealt by range of (conversation, turn, role, text), so a conversation may spread over many tasks, and
identical rows are one row with a count. A task mends blocks of rows for every pair of states; two neighbours'
items (p, q) and (q, r) deduce (p, r). For equal cost no audit of the same rows begins another (only an insertion
makes an audit longer, and it costs), so the least of the joined audits is made of the least of each.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from elastrain.llm.common import arrow_map, write_table

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
ROLES = {"u": "user", "a": "assistant"}
#: The automaton: nothing yet, after s, after u, after a.
STEP = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
STATES, START, ENDS = range(4), 0, (0, 3)
INTO = [[(p, r) for p in STATES for r, q in STEP[p].items() if q == state] for state in STATES]
LEGAL = ("su", "ua", "au")
BLOCK = 256
#: Characters of a text by which rows are dealt; the sort is by whole texts.
DEALT_BY = 64

Row = tuple[str, str]  # initial of the role, fault: "" or one of blank, duplicate, truncated
Items = dict[tuple[int, int], tuple[int, str]]  # (from, to): cost, audit


def lightest(rows: list[Row], ends: tuple[int, ...], goal: int | None = None) -> dict[int, tuple[int, str]]:
    """For each state (or for the goal only) the cheapest way from it over all rows to one of the ends; ties: ASCII-least."""
    n, final = len(rows), {}
    agenda = [(0, 0, "", q) for q in ends]
    heapify(agenda)
    while agenda:
        cost, done, audit, q = heappop(agenda)
        if (done, q) in final:
            continue
        final[done, q] = cost, audit
        if done == n and q == goal:
            break
        for p, role in INTO[q]:
            if role in ROLES:
                heappush(agenda, (cost + INSERT, done, "I" + audit, p))
        if done == n:
            continue
        initial, fault = rows[n - 1 - done]
        heappush(agenda, (cost + DELETE, done + 1, "D" + audit, q))
        if fault in ("blank", "duplicate"):
            continue
        paid = cost + TRUNCATED * (fault == "truncated")
        if not initial:
            heappush(agenda, (paid, done + 1, "K" + audit, q))
        for p, role in INTO[q]:
            if role == initial:
                heappush(agenda, (paid, done + 1, "K" + audit, p))
            if role in ROLES:
                heappush(agenda, (paid + REROLE, done + 1, "R" + audit, p))
    return {q: final[n, q] for q in STATES if (n, q) in final}


def block_items(rows: list[Row]) -> Items:
    """The lightest item of every pair of states that the rows can lead between."""
    return {(p, q): way for q in STATES for p, way in lightest(rows, (q,)).items()}


def joined(left: Items, right: Items) -> Items:
    """Items over two neighbours: of all states between, the lightest."""
    out: Items = {}
    for (p, q), (cost, audit) in left.items():
        for r in STATES:
            if (q, r) in right:
                way = (cost + right[q, r][0], audit + right[q, r][1])
                out[p, r] = min(out.get((p, r), way), way)
    return out


def cheapest(items: Items) -> tuple[int, str]:
    return min(items[START, q] for q in ENDS if (START, q) in items)


class Piece:
    """The rows of one conversation that one task has: counts, ends, and items of the blocks so far."""

    def __init__(self) -> None:
        self.faults = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal, self.first, self.last = 0, None, None
        self.rows: list[Row] = []
        self.items: Items | None = None

    def add(self, initial: str, fault: str, copies: int) -> None:
        again = "blank" if fault == "blank" else "duplicate"
        for i in range(copies):
            self.first = initial if self.last is None else self.first
            self.illegal += self.last is not None and self.last + initial not in LEGAL
            self.last = initial
            now = fault if i == 0 else again
            if now:
                self.faults[now] += 1
            self.rows.append((initial, now))
            if len(self.rows) == BLOCK:
                self.close()

    def close(self) -> None:
        if self.rows:
            items = block_items(self.rows)
            self.items = joined(self.items, items) if self.items else items
            self.rows = []

    def record(self, whole: bool) -> dict:
        """What goes to the next stage; a conversation known to be whole only needs its goal, unless it has many rows."""
        if whole and self.items is None:
            goal = lightest(self.rows, ENDS, START)[START]
        else:
            self.close()
            goal = cheapest(self.items)
        flat = [] if whole else [{"p": p, "q": q, "cost": c, "audit": a} for (p, q), (c, a) in self.items.items()]
        cost, audit = goal if whole else (None, None)
        return {**self.faults, "illegal": self.illegal, "first": self.first, "last": self.last, "items": flat, "cost": cost, "audit": audit}


COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
PIECE = f"conv_id bigint, piece int, {COUNTS}, first string, last string, items array<struct<p int, q int, cost bigint, audit string>>, cost bigint, audit string"
_PIECE_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int32()), *((n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")),
    ("first", pa.string()), ("last", pa.string()),
    ("items", pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))),
    ("cost", pa.int64()), ("audit", pa.string()),
])


def _pieces(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one record for each conversation in the partition; its first and last may go on in others."""
    number, piece, current, begun, out = TaskContext.get().partitionId(), None, None, 0, []
    for batch in parts:
        for conv, initial, fault, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if piece is None or conv != current:
                if piece is not None:
                    out.append({"conv_id": current, "piece": number, **piece.record(begun > 1)})
                piece, current, begun = Piece(), conv, begun + 1
            piece.add(initial, fault, copies)
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)
            out = []
    if piece is not None:
        out.append({"conv_id": current, "piece": number, **piece.record(False)})
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PIECE_ARROW)


def _combined(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The pieces of a conversation that is not known to be whole, in order, to its counts, cost and audit."""
    pieces = sorted(table.to_pylist(), key=lambda r: r["piece"])
    total = {name: sum(r[name] for r in pieces) for name in ("blank", "duplicate", "truncated", "illegal")}
    total["illegal"] += sum(a["last"] + b["first"] not in LEGAL for a, b in zip(pieces, pieces[1:]))
    items = None
    for r in pieces:
        these = {(i["p"], i["q"]): (i["cost"], i["audit"]) for i in r["items"]}
        items = joined(items, these) if items else these
    cost, audit = cheapest(items)
    arrays = [[key[0].as_py()], *([v] for v in total.values()), [cost], [audit]]
    types = [pa.int64()] * 6 + [pa.string()]
    return pa.table([pa.array(a, t) for a, t in zip(arrays, types)], names=["conv_id", *total, "cost", "audit"])


def _edited(parts: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, str | None]]:
    """Sorted rows, the audit of a conversation first, to the rows of the mended one; (conv_id, None, None) begins each."""
    conv, audit, at, state = None, "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            role = "a" if state == 2 else "u"
            at, state = at + 1, STEP[state][role]
            yield conv, ROLES[role], ""

    for batch in parts:
        for now, begins, role, text, copies in zip(*(c.to_pylist() for c in batch.columns)):
            if begins is not None:
                yield from inserted()
                conv, audit, at, state = now, begins, 0, START
                yield conv, None, None
                continue
            for _ in range(copies):
                yield from inserted()
                letter, at = audit[at], at + 1
                if letter == "D":
                    continue
                if letter == "R":
                    role = ROLES["a" if state == 2 else "u"]
                state = STEP[state][role[0]] if role else state
                yield conv, role, text
    yield from inserted()


def _digests(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each mended conversation, read as it streams by."""
    schema, out = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]), []
    conv, digest, any_row = None, None, False
    for now, role, text in _edited(parts):
        if role is None:
            if digest is not None:
                out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
            conv, digest, any_row = now, sha256(), False
        else:
            digest.update(("\n" if any_row else "").encode() + f"{role}:{text}".encode())
            any_row = True
        if len(out) >= 2000:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if digest is not None:
        out.append({"conv_id": conv, "repaired_sha256": digest.hexdigest()})
    yield pa.RecordBatch.from_pylist(out, schema=schema)


def _rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the mended conversations, numbered from 0."""
    names, out, size, place = ["conv_id", "place", "role", "text"], [], 0, 0
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    for conv, role, text in _edited(parts):
        if role is None:
            place = 0
            continue
        out.append((conv, place, role, text))
        place, size = place + 1, size + len(text)
        if len(out) >= 2000 or size >= 1 << 20:
            yield batch()
            out, size = [], 0
    yield batch()


def whole(name: str) -> Column:
    """A column as text; nulls are one space."""
    return F.coalesce(F.col(name).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role and text with a fifth or so of the rows damaged, by crc32 of "conv_id:turn" mod 20.

    0 drops a row, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4
    makes it a user's. Nulls of the hashed text, of roles and of texts are one space.
    """
    kind = F.crc32(F.concat(whole("conv_id"), F.lit(":"), whole("turn")).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(whole("text"), "[.!?]", "")).otherwise(whole("text"))
    role = F.when(kind == 4, "user").otherwise(whole("role"))
    copies = F.explode(F.sequence(F.lit(1), F.when(kind == 3, 2).otherwise(1))).alias("copy")
    rows = conversations.where(kind != 0).select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), role.alias("role"), text.alias("text"), copies)
    return rows.drop("copy")


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number and first fault, written.

    A row is blank without a character other than blanks, a duplicate if an earlier row of the conversation has its
    role and text, truncated if its last such character is not a full stop, exclamation or question mark. Of
    equal rows all but the first are duplicates, whatever this column says of the first.
    """
    rows = rows.select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), whole("role").alias("role"), whole("text").alias("text"))
    runs = write_table(rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("copies")), "turns")
    said = F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text").cast("binary"), 256))
    at = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"))
    runs = runs.select("*", said.alias("said"), at.alias("at"))
    firsts = runs.groupBy("conv_id", "said").agg(F.min("at").alias("earliest"), F.count("*").alias("times")).where("times > 1")
    firsts = firsts.select(F.col("conv_id").alias("of"), F.col("said").alias("what"), "earliest")
    known = runs.join(firsts, runs["conv_id"].eqNullSafe(firsts["of"]) & (runs["said"] == firsts["what"]), "left")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(F.col("at") > F.col("earliest"), "duplicate")
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    )
    return write_table(known.select("conv_id", "turn", "role", "text", "copies", fault.alias("fault")), "judged")


def repair(runs: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost and audit of every conversation in ``judged`` rows.

    Rows come by turn (nulls first), then role, then text. Rows without a conv_id are one conversation. The gaps of
    turns more than 2^63 apart are null.
    """
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = runs.repartitionByRange(*order, F.substring("text", 1, DEALT_BY)).sortWithinPartitions(*order, "text")
    pieces = write_table(arrow_map(dealt.select("conv_id", F.substring("role", 1, 1), "fault", "copies"), _pieces, PIECE), "pieces")
    done = f"conv_id bigint, {COUNTS}, cost bigint, audit string"
    split = pieces.where("audit IS NULL").groupBy("conv_id").applyInArrow(_combined, done)
    plans = pieces.where("audit IS NOT NULL").select(*split.columns).unionByName(split)
    wide = lambda c: c.cast("decimal(20,0)")
    gaps = (wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.countDistinct("turn")).try_cast("bigint")
    turns = runs.groupBy(F.col("conv_id").alias("of")).agg(F.when(F.count("turn") == 0, 0).otherwise(gaps).alias("gaps"))
    return write_table(plans.join(turns, plans["conv_id"].eqNullSafe(turns["of"])).drop("of"), "repairs")


def _in_order(runs: DataFrame, repairs: DataFrame) -> DataFrame:
    """Audits and rows of a conversation together, the audit first; a conversation streams through one task."""
    first = repairs.select("conv_id", "audit", *(F.lit(None).cast(t).alias(n) for n, t in (("turn", "bigint"), ("role", "string"), ("text", "string"), ("copies", "bigint"))))
    rows = runs.select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "role", "text", "copies")
    order = ["conv_id", F.col("audit").isNull(), F.col("turn").asc_nulls_first(), "role", "text"]
    both = first.unionByName(rows).repartition("conv_id").sortWithinPartitions(*order)
    return both.select("conv_id", "audit", "role", "text", "copies")


def repaired_digests(runs: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id and the SHA-256 of its mended rows (``role:text``, joined by newlines)."""
    return arrow_map(_in_order(runs, repairs), _digests, "conv_id bigint, repaired_sha256 string")


def repaired_rows(runs: DataFrame, repairs: DataFrame) -> DataFrame:
    """conv_id, place (from 0), role and text of the mended conversations."""
    return arrow_map(_in_order(runs, repairs), _rows, "conv_id bigint, place bigint, role string, text string")


def report(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The repair of each conversation of ``ids`` with its digest; one without rows has zeros and an empty audit."""
    runs = judged(rows)
    repairs = repair(runs)
    digests = repaired_digests(runs, repairs).withColumnRenamed("conv_id", "of")
    found = repairs.join(digests, repairs["conv_id"].eqNullSafe(digests["of"])).drop("of").withColumnRenamed("conv_id", "found")
    every = ids.select(F.col("conv_id").cast("bigint")).distinct()
    out = every.join(found, every["conv_id"].eqNullSafe(found["found"]), "left")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    zero = [F.when(F.col("audit").isNull(), 0).otherwise(F.col(c)).alias(c) for c in counts]
    return out.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))
