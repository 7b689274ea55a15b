"""SentencePiece encoding that keeps, for every piece, the bytes of the source text it came from.

A text is normalised here: at each place the longest key of the model's compiled character map is replaced, white
space is escaped, and for every byte of the result the source byte where its replacement began is written down. The
result is cut where no merge can reach across, before a run of escaped spaces and around line breaks, if the
vocabulary allows it, and the library encodes each distinct segment of a task once, on a copy of the model whose own
normaliser is switched off. Piece lengths then give spans of the normalised text, which the alignment projects to
spans of bytes of the source. Decoding goes through the table of pieces.

Null text counts as empty. The end id of a text has the empty span at the text's end. A character that falls back to
bytes gives its span to the last of its byte ids, the others are empty, as in the library. Repeated rows and a null
doc_id are rows like others; columns other than doc_id and text are not read. The model's path must exist on every
worker. Nothing is shuffled: a row needs the model alone.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm import words as W

#: Numbers of fields and kinds of pieces in the model file's public format, and its mark of a space.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARK = "▁"
_MARK, _BAD = MARK.encode(), "�".encode()
#: Segments and chunks that a worker remembers at most; then it starts anew.
REMEMBERED = 400_000


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            value, at, shift = value | (byte & 127) << shift, at + 1, shift + 7
            if byte < 128:
                return value

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield key >> 3, raw[at : at + size]
            at += size


def message(parts: list[tuple[int, int | bytes]]) -> bytes:
    """A protocol buffer message of numbers and byte strings."""

    def number(value: int) -> bytes:
        out = bytearray()
        while value > 127:
            out.append(value & 127 | 128)
            value >>= 7
        return bytes([*out, value])

    return b"".join(number(k << 3) + number(v) if isinstance(v, int) else number(k << 3 | 2) + number(len(v)) + v for k, v in parts)


class CharacterMap:
    """The compiled map: a double-array trie over bytes, and the replacements it points to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes | None]:
        """Length and replacement of the longest key that `data` has at `at`."""
        units, node, size, value = self.units, 0, 0, None
        unit = units[0]
        for i in range(at, len(data)):
            node ^= (unit >> 10) << ((unit & 512) >> 6) ^ data[i]
            unit = units[node]
            if unit & 0x800000FF != data[i]:
                break
            if unit >> 8 & 1:
                leaf = units[node ^ (unit >> 10) << ((unit & 512) >> 6)] & 0x7FFFFFFF
                size, value = i + 1 - at, leaf
        if value is None:
            return 0, None
        return size, self.replacements[value : self.replacements.index(0, value)]

    def crosses(self, byte: int) -> bool:
        """Whether some key of several bytes holds `byte`."""
        units = np.array(self.units, np.int64)
        nodes, seen, depth = np.zeros(1, np.int64), np.zeros(1, bool), 0
        while len(nodes):
            unit = units[nodes]
            below = (nodes ^ (unit >> 10) << ((unit & 512) >> 6))[:, None] ^ np.arange(1, 256)
            inside = below < len(units)
            fits = inside & ((units[np.where(inside, below, 0)] & 0x800000FF) == np.arange(1, 256))
            row, label = np.nonzero(fits)
            depth += 1
            nodes, seen = below[fits], seen[row] | (label + 1 == byte)
            if depth > 1 and bool((seen & (units[nodes] >> 8 & 1 == 1)).any()):
                return True
        return False


class Normalizer:
    """Text to the normalised text, and the source byte of each of its bytes (and of its end)."""

    def __init__(self, spec: dict[int, int | bytes], suffix: bool, user: list[str]):
        self.map = CharacterMap(spec[2]) if spec.get(2) else None
        self.dummy, self.squeeze, self.escape = (bool(spec.get(k, 1)) for k in (3, 4, 5))
        self.suffix = suffix
        self.user = regex.compile("|".join(regex.escape(u) for u in sorted(user, key=len, reverse=True)).encode()) if user else None
        apart = not self.user and not (self.map and self.map.crosses(32))
        self.chunks = regex.compile(rb" +|[^ ]+" if apart else rb"(?s).+")
        self.space = _MARK if self.escape else b" "
        self.known: dict[tuple[bytes, bool], tuple[bytes, np.ndarray, bool]] = {}

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if self.map is None and self.user is None and not self.squeeze:
            return self._plain(text)
        start = self._heading(text) if self.squeeze else 0
        if start == len(text):
            return b"", np.zeros(1, np.int64)
        out, where, spaced, at = [], [], self.squeeze, start
        if self.dummy and not self.suffix:
            out.append(self.space)
            where.append(np.full(len(self.space), start))
        for match in self.chunks.finditer(text, start):
            chunk = match[0]
            known = self.known.get((chunk, spaced))
            if known is None:
                if len(self.known) >= REMEMBERED:
                    self.known.clear()
                known = self.known[chunk, spaced] = self._chunk(chunk, spaced)
            out.append(known[0])
            where.append(known[1] + at)
            spaced, at = known[2], at + len(chunk)
        made, align, end = b"".join(out), np.concatenate(where), len(text)
        while self.squeeze and made.endswith(self.space):
            made = made[: -len(self.space)]
            end = int(align[len(made)])
        align = align[: len(made)]
        if self.dummy and self.suffix:
            made, align = made + self.space, np.append(align, np.full(len(self.space), end))
        return made, np.append(align, end)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        if not text:
            return b"", np.zeros(1, np.int64)
        data, at = np.frombuffer(text, np.uint8), np.arange(len(text))
        align = np.repeat(at, np.where(data == 32, len(self.space), 1))
        mark = [0] * (len(self.space) * self.dummy)
        made = text.replace(b" ", self.space)
        if self.suffix:
            return made + self.space * self.dummy, np.concatenate([align, np.full(len(mark) + 1, len(text))])
        return self.space * self.dummy + made, np.concatenate([np.array(mark, np.int64), align, [len(text)]])

    def _unit(self, data: bytes, at: int) -> tuple[int, bytes]:
        """Source bytes used up at `at`, and what they become."""
        if self.user and (own := self.user.match(data, at)):
            return len(own[0]), own[0]
        if self.map:
            size, value = self.map.longest(data, at)
            if value is not None:
                return size, value
        size = 1 if data[at] < 0xC0 else 2 if data[at] < 0xE0 else 3 if data[at] < 0xF0 else 4
        return size, data[at : at + size]

    def _heading(self, text: bytes) -> int:
        at = 0
        while at < len(text):
            size, value = self._unit(text, at)
            if value != b" ":
                break
            at += size
        return at

    def _chunk(self, data: bytes, spaced: bool) -> tuple[bytes, np.ndarray, bool]:
        out, where, at = bytearray(), [], 0
        while at < len(data):
            size, value = self._unit(data, at)
            if spaced:
                value = value.lstrip(b" ")
            if value:
                spaced = self.squeeze and value.endswith(b" ")
                made = value.replace(b" ", self.space)
                out += made
                where += [at] * len(made)
            at += size
        return bytes(out), np.array(where, np.int64), spaced


class Model:
    """A model file: its normaliser, its vocabulary, and the library's merges without the library's normaliser."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            parts = list(fields(file.read()))
        pieces = [{1: b"", 3: NORMAL} | dict(fields(v)) for k, v in parts if k == PIECES]
        trainer, spec = (dict(fields(next((v for k, v in parts if k == n), b""))) for n in (TRAINER, NORMALIZER))
        suffix = bool(trainer.get(24, 0))
        self.kinds = np.array([p[3] for p in pieces])
        names = [p[1].decode() for p in pieces]
        self.normal = Normalizer(spec, suffix, [n for n, k in zip(names, self.kinds, strict=True) if k == USER_DEFINED])
        quiet = message([(1, b"identity"), (2, b""), (3, 0), (4, 0), (5, int(self.normal.escape))])
        self.library = sentencepiece.SentencePieceProcessor()
        self.library.LoadFromSerializedProto(message([(k, v) for k, v in parts if k != NORMALIZER] + [(NORMALIZER, quiet)]))
        self.end = self.library.eos_id()
        whole = [n for n, k in zip(names, self.kinds, strict=True) if k in (NORMAL, USER_DEFINED, UNUSED)]
        fallback, merges = bool(trainer.get(35, 0)), trainer.get(3, 1) == 2
        apart = fallback and merges and self.normal.escape and not suffix and not any(a != MARK == b for n in whole for a, b in zip(n, n[1:], strict=False))
        lines = apart and not any("\n" in n for n in whole if len(n) > 1)
        self.segments = re.compile(f"\n|{MARK}*[^\n{MARK}]+|{MARK}+" if lines else f"{MARK}*[^{MARK}]+|{MARK}+" if apart else "(?s).+")
        self.line = self.library.encode("\n")[0] if lines else None
        self.known: dict[str, bytes] = {}
        # what each id stands for, and how many bytes of the normalised text it takes
        unknown = trainer.get(44, b" \xe2\x81\x87 ")
        self.byte = np.array([int(n[3:5], 16) if k == BYTE else -1 for n, k in zip(names, self.kinds, strict=True)])
        self.surface = [bytes([b]) if b >= 0 else b"" if k == CONTROL else unknown if k == UNKNOWN else n.replace(MARK, " ").encode() for n, k, b in zip(names, self.kinds, self.byte.tolist(), strict=True)]
        self.sizes = np.array([1 if b >= 0 else len(n.encode()) for n, b in zip(names, self.byte.tolist(), strict=True)])
        self.controls = frozenset(np.flatnonzero(self.kinds == CONTROL).tolist())
        self.exact = fallback  # else an unknown run's length is not told by its id
        self.decimal = [str(i) for i in range(len(names))]

    def ids(self, normal: list[str]) -> list[bytes]:
        """Ids of each normalised text, as little-endian integers of 4 bytes."""
        cut = [self.segments.findall(t) for t in normal]
        new = set().union(*cut).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = set().union(*cut)
        queue = iter(new)
        while group := list(islice(queue, 2000)):
            self.known.update(zip(group, self._segments(group), strict=True))
        known = self.known
        return [b"".join([known[s] for s in c]) for c in cut]

    def _segments(self, group: list[str]) -> list[bytes]:
        """Where no merge reaches across a line break, one text of many lines holds all segments."""
        if self.line is None or "\n" in group:
            return [np.array(i, "<i4").tobytes() for i in self.library.encode(group, num_threads=1)]
        flat = np.array(self.library.encode("\n".join(group)), "<i4")
        at = np.flatnonzero(flat == self.line) * 4
        raw = flat.tobytes()
        return [raw[i:j] for i, j in zip([0, *(at + 4).tolist()], [*at.tolist(), len(raw)], strict=True)]

    def spans(self, ids: np.ndarray, align: np.ndarray, first: np.ndarray, base: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Source spans of the ids of several texts; text t has ids from first[t] and its alignment from base[t]."""
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        starts = ends - sizes
        counts = np.diff(first, append=len(ids))
        shift = np.repeat(base - np.append(starts, 0)[first], counts)
        byte = self.byte[ids]
        later = (byte >= 0) & (byte & 0xC0 == 0x80)
        lead = np.maximum.accumulate(np.where(later, 0, np.arange(len(ids))))
        begin = align[starts[lead] + shift]
        more = np.append(later[1:], False)
        return begin, np.where(more, begin, align[ends + shift])

    def text(self, ids: list[int]) -> str:
        """The text of some ids. Bytes that form no character become U+FFFD each; a control id ends a run of bytes."""
        surface, parts = self.surface, []
        if self.normal.squeeze or self.normal.dummy and not self.normal.suffix:
            # a mark at the text's start is the dummy's, with squeezed spaces as long as no text has come
            for i in ids:
                own = surface[i]
                parts.append(own[1:] if self.kinds[i] not in (BYTE, UNKNOWN, CONTROL) and own.startswith(b" ") else own)
                if parts[-1] or not (self.normal.squeeze or self.kinds[i] == CONTROL):
                    break
        parts += [surface[i] for i in ids[len(parts) :]]
        if self.controls.isdisjoint(ids[:-1]):
            try:
                return b"".join(parts).decode()
            except UnicodeDecodeError:
                pass
        runs, kinds = [b""], self.kinds
        for i, part in zip(ids, parts, strict=True):
            if kinds[i] == CONTROL:
                runs.append(b"")
            else:
                runs[-1] += part
        return "".join([_readable(r) for r in runs])


def _readable(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        size = 1 if raw[at] < 0xC0 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
        try:
            out.append(raw[at : at + size].decode())
        except UnicodeDecodeError:
            out.append("�")
            size = 1
        at += size
    return "".join(out)


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    return Model(path)


ENCODED = "doc_id long, ids array<int>, begins array<int>, ends array<int>"


def _texts(column: pa.Array) -> list[bytes]:
    return [t if t is not None else b"" for t in column.cast(pa.binary()).to_pylist()]


def _encoded(batch: pa.RecordBatch, own: Model, end: bool) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Ids of each text, and spans of all of them one after another."""
    texts = [t.decode("utf-8", "replace").encode() for t in _texts(batch.column(1))]
    normal = [own.normal(t) for t in texts]
    flat = own.ids([n.decode("utf-8", "replace") for n, _ in normal])
    ids = [np.frombuffer(x, "<i4") for x in flat]
    counts = np.array([len(i) for i in ids])
    base = np.cumsum([0, *(len(a) for _, a in normal)])[:-1]
    if own.exact:
        begin, finish = own.spans(np.concatenate(ids), np.concatenate([a for _, a in normal]), np.cumsum(counts) - counts, base)
    else:
        begin = finish = np.full(int(counts.sum()), -1)
    if not end:
        return ids, begin, finish
    places = np.cumsum(counts)
    last = np.array([len(t) for t in texts])
    return [np.append(i, np.int32(own.end)) for i in ids], np.insert(begin, places, last), np.insert(finish, places, last)


def _lists(values: np.ndarray, counts: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, path: str, end: bool = True) -> DataFrame:
    """(doc_id, ids, begins, ends) of every row of `docs` (doc_id, text); spans are bytes of the UTF-8 text.

    A vocabulary without byte fallback does not tell the length of an unknown run: its spans are -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for part in W.slices(batches):
            ids, begin, finish = _encoded(part, own, end)
            counts = np.array([len(i) for i in ids])
            lists = [_lists(x, counts) for x in (np.concatenate(ids), begin, finish)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists], names=["doc_id", "ids", "begins", "ends"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


DECODED = "ids_text string, text string"


def _decoded(ids: pa.ListArray, own: Model) -> list[pa.Array]:
    at, flat = ids.offsets.to_numpy(), ids.values.to_numpy()
    numbers, texts, size = [], [], len(own.decimal)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        one = flat[i:j]
        if len(one) and (one.min() < 0 or one.max() >= size):
            numbers.append(" ".join(map(str, one.tolist())))
            texts.append(own.text(one[(one >= 0) & (one < size)].tolist()))
        else:
            one = one.tolist()
            numbers.append(" ".join([own.decimal[k] for k in one]))
            texts.append(own.text(one))
    return [pa.array(numbers, pa.string()), pa.array(texts, pa.string())]


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with `ids_text`, the ids in decimal, and `text`, as the library decodes them.

    Ids outside of the vocabulary have no piece and are left out of the text. Null ids are none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *_decoded(x.column(1), model(path))], names=["doc_id", "ids", "ids_text", "text"])

    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(run, f"doc_id long, ids array<int>, {DECODED}")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """decode(encode(docs)) in one pass, with the end id: (doc_id, ids, begins, ends, ids_text, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for part in W.slices(batches):
            ids, begin, finish = _encoded(part, own, True)
            counts = np.array([len(i) for i in ids])
            lists = [_lists(x, counts) for x in (np.concatenate(ids), begin, finish)]
            yield pa.RecordBatch.from_arrays([part.column(0), *lists, *_decoded(lists[0], own)], names=["doc_id", "ids", "begins", "ends", "ids_text", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{ENCODED}, {DECODED}")
