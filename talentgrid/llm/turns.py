"""Repair of the turn structure of conversations by a run-length dynamic programme.

Wanted are conversations whose role initials read `(s?(ua)+)?`: perhaps a system turn, then user and assistant in turn.
A row may be kept, get the role user or assistant, or be deleted, and empty user and assistant rows may be inserted.
Blank rows and rows that repeat an earlier role and text must be deleted; a truncated row that stays costs extra.

1. Each row becomes a symbol: its role's initial and its fault, from narrow columns; equal rows of one place are one row
   with a count. Which row is the first of its role and text comes from a grouped minimum that is joined back.
2. Rows are dealt by ranges of (conversation, place) and cut into pieces, so that a long conversation is in many tasks.
   A piece is kept as runs of equal symbols. A symbol has a min-plus transition between the states of the pattern;
   its powers of two are cached, and a run's transition is their product. Pieces get one transition each.
3. Per conversation, pieces stream from last to first with the least cost to the end from each state, a vector of four.
4. Pieces and texts stream once from first to last: each run's choices are unrolled from its states' costs, ties to the
   smallest letter, and applied to the texts as they come. A task holds one piece and one batch, never a conversation;
   only the audit, a letter for each edit, is as long as its conversation. The hash of a whole conversation cannot be split,
   so that this pass reads the rows of one conversation in one task.

Rows of one turn are ordered by role, the first characters of the text, and then by a hash of it. Null roles and
texts count as one space (a null turn comes first and counts for no gap). A null conv_id is a conversation of its own.
Repeated rows are duplicates. Other columns are not read, and an empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm import cells as C
from talentgrid.llm.staging import staged, temporary

SPACES = " \t\n\x0b\f\r"
#: Characters of a text that take part in the order of rows of one turn, before its hash does.
HEAD = 32
#: Rows that one piece of a conversation has at most.
PIECE = 50_000

# States of the pattern: nothing yet, after system, after user (needs an assistant), after assistant.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEEP = {"s": {_START: _SYSTEM}, "u": {_START: _USER, _SYSTEM: _USER, _ASSISTANT: _USER}, "a": {_USER: _ASSISTANT}}
#: Where an inserted or re-roled row leads; in each state one of the two roles fits.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_CLOSED = (_START, _ASSISTANT)
RETAG, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
_FAR = 1 << 60
#: Symbols: an initial (other: x) with or without the truncated mark, and a row that must go.
INITIALS = "suax"
GONE = 2 * len(INITIALS)

Matrix = tuple[tuple[int, ...], ...]
Vector = tuple[int, ...]


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product."""
    columns = tuple(zip(*b, strict=True))
    return tuple(tuple(min([x + y for x, y in zip(row, column, strict=True)] + [_FAR]) for column in columns) for row in a)


def ahead(a: Matrix, v: Vector) -> Vector:
    """Least cost from each state, when `v` has that after the step."""
    p, q, r, s = v
    return tuple(min(row[0] + p, row[1] + q, row[2] + r, row[3] + s, _FAR) for row in a)


ONE: Matrix = tuple(tuple(0 if s == t else _FAR for t in range(4)) for s in range(4))
_STEP: Matrix = tuple(tuple(INSERT if t == _NEXT[s] else _FAR for t in range(4)) for s in range(4))


def _either(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(map(min, x, y)) for x, y in zip(a, b, strict=True))


#: Insertions before a row: two reach every state that can be reached.
INSERTED = _either(ONE, _either(_STEP, product(_STEP, _STEP)))
#: Cost from each state to the end of a conversation.
CLOSING: Vector = ahead(INSERTED, tuple(0 if s in _CLOSED else _FAR for s in range(4)))


def edits(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of what may become of a row, in the order of letters."""
    out = [("D", DELETE, state)]
    if symbol != GONE:
        extra = TRUNCATED * (symbol & 1)
        if (to := _KEEP.get(INITIALS[symbol >> 1], {}).get(state)) is not None:
            out.append(("K", extra, to))
        out.append(("R", RETAG + extra, _NEXT[state]))
    return out


@lru_cache(maxsize=None)
def power(symbol: int, k: int) -> Matrix:
    """The transition of 2**k rows of one symbol; nine symbols and the bits of a length bound the cache."""
    if k:
        half = power(symbol, k - 1)
        return product(half, half)
    row = [[_FAR] * 4 for _ in range(4)]
    for state in range(4):
        for _, cost, to in edits(symbol, state):
            row[state][to] = min(row[state][to], cost)
    return product(INSERTED, tuple(map(tuple, row)))


def _bits(length: int) -> list[int]:
    return [k for k in range(length.bit_length()) if length >> k & 1]


def run_ahead(symbol: int, length: int, v: Vector) -> Vector:
    """Costs before a run of equal symbols from those after it."""
    for k in _bits(length):
        v = ahead(power(symbol, k), v)
    return v


def transition(runs: list[tuple[int, int]]) -> Matrix:
    out = ONE
    for symbol, length in runs:
        for k in _bits(length):
            out = product(out, power(symbol, k))
    return out


@lru_cache(maxsize=100_000)
def _choices(symbol: int, length: int, after: Vector, state: int) -> tuple[str, int]:
    """The letters of a run's cheapest edits, the smallest string of them, and the state they lead to."""
    costs = [after]
    for _ in range(length):
        costs.append(ahead(power(symbol, 0), costs[-1]))
    out = []
    for left in range(length, 0, -1):
        here, then = costs[left], costs[left - 1]
        while True:
            best = [("D", DELETE + then[state], state), ("I", INSERT + here[_NEXT[state]], _NEXT[state])]
            best += [(e, cost + then[to], to) for e, cost, to in edits(symbol, state)[1:]]
            letter, _, state = next(b for b in best if b[1] == here[state])
            out.append(letter)
            if letter != "I":
                break
    return "".join(out), state


def unrolled(runs: list[tuple[int, int]], end: Vector, state: int) -> tuple[str, int]:
    """The letters of a piece, given the costs after it and the state before it, and the state after it."""
    after = [end]
    for symbol, length in reversed(runs):
        after.append(run_ahead(symbol, length, after[-1]))
    out = []
    for (symbol, length), v in zip(runs, reversed(after[:-1]), strict=True):
        least = min(v)
        letters, state = _choices(symbol, length, tuple(min(x - least, _FAR) for x in v), state)
        out.append(letters)
    return "".join(out), state


def closing(state: int) -> tuple[str, int]:
    """Insertions at the end."""
    out = ""
    while state not in _CLOSED:
        out, state = out + "I", _NEXT[state]
    return out, state


def damaged(rows: DataFrame) -> DataFrame:
    """`rows` (conv_id, turn, role, text) with faults and `copies`: 0 for a dropped row, 2 for a repeated one.

    crc32 of `conv_id:turn` modulo 20 chooses: 0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and
    question marks, 3 repeats it, 4 makes it a user's. Nulls are one space.
    """
    part = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(part[0], F.lit(":"), part[1]).cast("binary")) % 20
    text = F.when(kind.isin(0, 1), "").when(kind == 2, F.translate(part[3], ".!?", "")).otherwise(part[3])
    told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(kind == 4, "user").otherwise(part[2]).alias("role"), text.alias("text"), kind.alias("kind"))
    return told.withColumn("copies", F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)).drop("kind")


PLACE = ["turn", "role", "head", "k1", "k2"]


def _order(columns: list[str], last: bool = False) -> list[Column]:
    return [F.desc_nulls_last(c) if last else F.asc_nulls_first(c) for c in columns]


def _placed(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    copies = F.col("copies").cast("int") if "copies" in rows.columns else F.lit(1)
    told = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))
    return told.select("conv_id", "turn", "role", F.substring("text", 1, HEAD).alias("head"), F.xxhash64("role", "text").alias("k1"), F.xxhash64(F.lit(1), "text", "role").alias("k2"), "text", "copies")


def symbols(placed: DataFrame) -> DataFrame:
    """Distinct rows of each place (conv_id, place, n, initial, blank, truncated, first), without texts."""
    bare = F.rtrim("text", F.lit(SPACES))
    told = placed.where("copies > 0").select("conv_id", *PLACE, "copies", (bare == "").alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("truncated"))
    rows = staged(told.groupBy("conv_id", *PLACE, "blank", "truncated").agg(F.sum("copies").alias("n")), "rows")
    same = ["conv_id", "role", "k1", "k2"]
    # a struct, so that a null turn is the least
    first = rows.groupBy(*same).agg(F.min(F.struct("turn")).alias("least")).select(*[F.col(c).alias(f"_{c}") for c in same], "least")
    met = rows.join(first, F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("k1") == F.col("_k1")) & (F.col("k2") == F.col("_k2")))
    return met.select("conv_id", *PLACE, "n", "blank", "truncated", F.col("turn").eqNullSafe(F.col("least.turn")).alias("first"))


class Counts(NamedTuple):
    """Of a piece: faults, illegal neighbours inside, first and last turn, distinct turns, first and last initial."""

    blank: int
    duplicate: int
    truncated: int
    illegal: int
    turns: int
    low: int | None
    high: int | None
    first: str
    last: str


LEGAL = {"su", "ua", "au"}

_PIECE = "conv_id long, turn long, role string, head string, k1 long, k2 long, runs binary, matrix array<long>, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string"
_PIECE_SCHEMA = pa.schema(
    [("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("head", pa.string()), ("k1", pa.int64()), ("k2", pa.int64()), ("runs", pa.binary()), ("matrix", pa.list_(pa.int64()))]
    + [(c, pa.int64()) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")]
    + [("first", pa.string()), ("last", pa.string())]
)


def _records(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for x in batches:
        yield from zip(*(c.to_pylist() for c in x.columns), strict=True)


def _batched(rows: Iterator[tuple], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield _records(held, schema)
            held = []
    if held:
        yield _records(held, schema)


def _pieces(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple]:
    """Sorted rows to pieces of at most `most` rows of one conversation each."""
    key: object = _pieces  # none yet
    n_rows = 0
    for conv, turn, role, head, k1, k2, n, blank, truncated, first in _rows(batches):
        if conv != key or n_rows >= most:
            if key is not _pieces:
                yield _piece(key, place, runs, counts, low, high, opens, before)  # noqa: F821
            key, place, runs, counts, low, high, opens, before, n_rows = conv, (turn, role, head, k1, k2), [], [0] * 5, None, None, role[:1], None, 0
        n_rows += 1
        initial = role[:1]
        if before is not None and before + initial not in LEGAL:
            counts[3] += 1
        before = initial
        counts[3] += n - 1  # no role may follow itself
        if turn is not None:
            if turn != high:
                counts[4] += 1
            low, high = turn if low is None else low, turn
        if blank:
            counts[0] += n
            kinds = [(GONE, n)]
        else:
            counts[1] += n - first
            counts[2] += truncated and first
            kinds = [(2 * (INITIALS.index(initial) if initial and initial in INITIALS[:3] else 3) + truncated, 1)] * first + [(GONE, n - first)] * (n > first)
        for symbol, length in kinds:
            if runs and runs[-1][0] == symbol:
                runs[-1] = (symbol, runs[-1][1] + length)
            else:
                runs.append((symbol, length))
    if key is not _pieces:
        yield _piece(key, place, runs, counts, low, high, opens, before)


def _piece(conv, place, runs, counts, low, high, opens, last) -> tuple:
    packed = C.pack(np.array([s for s, _ in runs], np.uint8), C.small(np.array([n for _, n in runs], np.uint64)))
    return (conv, *place, packed, [x for row in transition(runs) for x in row], *counts, low, high, opens, last)


def _runs(packed: bytes) -> list[tuple[int, int]]:
    symbol, length = C.unpack(packed)
    return list(zip(symbol.tolist(), length.tolist(), strict=True))


def _costed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Pieces from last to first: each with the costs after it, and the cost of all from its begin on in state 0."""
    key: object = _costed
    for row in _rows(batches):
        if row[0] != key:
            key, after = row[0], CLOSING
        matrix = row[7]
        before = ahead(tuple(tuple(matrix[i : i + 4]) for i in range(0, 16, 4)), after)
        yield (*row[:7], list(after), before[_START], *row[8:])
        after = before


_COSTED = _PIECE.replace("matrix array<long>", "after array<long>, cost long")
_COSTED_SCHEMA = pa.schema([f for i, g in enumerate(_PIECE_SCHEMA) for f in ([g] if i != 7 else [pa.field("after", pa.list_(pa.int64())), pa.field("cost", pa.int64())])])


class Event(NamedTuple):
    """An edit of a conversation: what it is, and the row it leaves, if any."""

    letter: str
    role: str | None
    text: str | None


class Summary:
    """Counts of a conversation, gathered over its pieces."""

    def __init__(self):
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.cost = 0
        self.low = self.high = self.last = None

    def add(self, cost: int, blank: int, duplicate: int, truncated: int, illegal: int, turns: int, low: int | None, high: int | None, first: str, last: str) -> None:
        if self.last is None:
            self.cost = cost
        elif self.last + first not in LEGAL:
            self.illegal += 1
        self.blank, self.duplicate, self.truncated, self.illegal = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated, self.illegal + illegal
        self.turns += turns - (low is not None and low == self.high)
        if low is not None:
            self.low, self.high = low if self.low is None else self.low, high
        self.last = last

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Event | Summary]]:
    """Pieces and texts from first to last: the events of each conversation, and then its summary."""
    key: object = _conversations
    summary, letters, at, state = Summary(), "", 0, _START

    def over() -> Iterator[tuple]:
        for _ in closing(state)[0]:
            yield from inserted()
        yield key, summary

    def inserted() -> Iterator[tuple]:
        nonlocal state
        state = _NEXT[state]
        yield key, Event("I", _ROLE[state], "")

    coming = _START
    for conv, role, text, copies, kind, runs, after, *counts in _rows(batches):
        if conv != key:
            if key is not _conversations:
                yield from over()
            key, summary, letters, at, state, coming = conv, Summary(), "", 0, _START, _START
        if kind == 0:
            letters, coming = unrolled(_runs(runs), tuple(after), coming)
            at = 0
            summary.add(*counts)
            continue
        for _ in range(copies):
            while letters[at] == "I":
                at += 1
                yield from inserted()
            letter = letters[at]
            at += 1
            if letter == "K":
                state = _KEEP[role[0]][state]
                yield key, Event("K", role, text)
            elif letter == "R":
                state = _NEXT[state]
                yield key, Event("R", _ROLE[state], text)
            else:
                yield key, Event("D", None, None)
    if key is not _conversations:
        yield from over()


def _streamed(rows: DataFrame, sink: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str, most: int) -> DataFrame:
    placed = _placed(rows)
    with temporary(rows.sparkSession):
        told = symbols(placed)
        dealt = told.repartitionByRange(C.bucket_count(rows.sparkSession), *_order(["conv_id", *PLACE])).sortWithinPartitions(*_order(["conv_id", *PLACE]))
        cut = staged(dealt.mapInArrow(lambda b: _batched(_pieces(b, most), _PIECE_SCHEMA), _PIECE), "pieces", up=1)
    back = cut.repartition("conv_id").sortWithinPartitions(*_order(["conv_id", *PLACE], last=True))
    costed = back.mapInArrow(lambda b: _batched(_costed(b), _COSTED_SCHEMA), _COSTED)
    told = [f.split()[0] for f in _COSTED.split(", ") if f.split()[0] not in ("conv_id", *PLACE)]
    kinds = dict(f.split(maxsplit=1) for f in _COSTED.split(", "))
    pieces = costed.select("conv_id", *PLACE, F.lit(None).cast("string").alias("text"), F.lit(0).alias("copies"), F.lit(0).alias("kind"), *told)
    texts = placed.select("conv_id", *PLACE, F.when(F.col("copies") > 0, F.col("text")).alias("text"), "copies", F.lit(1).alias("kind"), *[F.lit(None).cast(kinds[c]).alias(c) for c in told])
    both = pieces.unionByName(texts).repartition("conv_id").sortWithinPartitions(*_order(["conv_id", *PLACE, "kind"]))
    return both.select("conv_id", "role", "text", "copies", "kind", *told).mapInArrow(lambda b: sink(_conversations(b)), schema)


def repair(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """(conv_id, place, edit, role, text): the edits of each conversation of `rows` (conv_id, turn, role, text) in order.

    A deleted row has no role and text. `rows` may have `copies`: so many equal rows, or none.
    """
    kinds = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def sink(events: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        def listed() -> Iterator[tuple]:
            place = 0
            for conv, event in events:
                if isinstance(event, Summary):
                    place = 0
                else:
                    yield (conv, place, *event)
                    place += 1

        return _batched(listed(), kinds)

    return _streamed(rows, sink, "conv_id long, place long, edit string, role string, text string", most)


def audits(rows: DataFrame, most: int = PIECE) -> DataFrame:
    """One row a conversation: its gaps, faults and illegal neighbours, the cost and letters of its edits, and the
    SHA-256 of the repaired `role:text` lines."""
    kinds = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def sink(events: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        def summed() -> Iterator[tuple]:
            letters, digest, some = [], hashlib.sha256(), False
            for conv, event in events:
                if isinstance(event, Summary):
                    s = event
                    yield conv, s.gaps(), s.blank, s.duplicate, s.truncated, s.illegal, s.cost, "".join(letters), digest.hexdigest()
                    letters, digest, some = [], hashlib.sha256(), False
                    continue
                letters.append(event.letter)
                if event.role is not None:
                    digest.update(f"{chr(10) if some else ''}{event.role}:{event.text}".encode())
                    some = True

        return _batched(summed(), kinds)

    return _streamed(rows, sink, "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", most)
