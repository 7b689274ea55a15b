"""BPE encoding and decoding through a table of distinct words.

Texts are split at ASCII white space, which no token spans. A map task numbers the distinct words of a block of
texts and ships each word once, by ranges of word hashes. The texts are read a second time and cross as sequences of
word numbers, so `docs` must give the same rows in the same order again, as files do; otherwise the job fails. One task per range encodes every distinct word of the corpus once with the tokenizers library; the ids go
back to their blocks and are joined to the sequences by word number. Decoding joins ids with the table of
pieces, whose size is that of the vocabulary.

Words of printable Latin-1 characters are cut into the tokenizer's own pieces first, which are encoded
side by side; any other word, and any that may hold a special token, goes through the library as it is.

Null text counts as empty and has no ids. Repeated rows are encoded each. The vocabulary's path must exist on
every worker.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm import cells as C
from talentgrid.llm import words as W

BLOCK_WORDS = 1_000_000
JOINED = 1000
_PLAIN = regex.compile(r"[!-~¡-ÿ]+")
#: The pre-tokenizer's pattern, as the vocabulary file states it.
_PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


class Encoder:
    """Encodes words one by one as the library encodes whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        size = self.library.get_vocab_size(with_added_tokens=True)
        self.pieces = [self.library.id_to_token(i) or "" for i in range(size)]
        self.kind = np.uint16 if size <= 1 << 16 else np.uint32
        self.ends = np.array([p.endswith("</w>") for p in self.pieces])
        self.known: dict[str, bytes] = {}

    def words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word as bytes."""
        texts = [w.decode("utf-8", "replace") for w in words]
        cut = [_PIECES.findall(t.lower()) if _PLAIN.fullmatch(t) and "<|" not in t else None for t in texts]
        if len(self.known) > 100_000:
            self.known = {}
        self._learn(list({p for c in cut if c for p in c if p not in self.known}))
        whole = iter(self.library.encode_batch_fast([t for t, c in zip(texts, cut, strict=True) if c is None], add_special_tokens=False))
        known = self.known
        return [np.array(next(whole).ids, self.kind).tobytes() if c is None else b"".join([known[p] for p in c]) for c in cut]

    def _learn(self, pieces: list[str]) -> None:
        for i in range(0, len(pieces), JOINED):
            group = pieces[i : i + JOINED]
            ids = np.array(self.library.encode_batch_fast([" ".join(group)], add_special_tokens=False)[0].ids, self.kind)
            last = np.flatnonzero(self.ends[ids]) + 1
            if len(last) != len(group):
                raise ValueError("the vocabulary does not end each piece with </w>")
            first = [0, *last[:-1].tolist()]
            self.known.update(zip(group, [ids[a:b].tobytes() for a, b in zip(first, last.tolist(), strict=True)], strict=True))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


_ROWS = "bucket int, block binary, part int, cell binary"
_ROW_SCHEMA = pa.schema([("bucket", pa.int32()), ("block", pa.binary()), ("part", pa.int32()), ("cell", pa.binary())])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ROW_SCHEMA, strict=True)], schema=_ROW_SCHEMA)


def encode(docs: DataFrame, path: str, packed: bool = False) -> DataFrame:
    """(doc_id, ids) of every row of `docs` (doc_id, text): array<int>, or packed little-endian bytes of 2 or 4 each."""
    return _joined(docs, path, packed, iter, "doc_id long, ids " + ("binary" if packed else "array<int>"))


def _joined(docs: DataFrame, path: str, packed: bool, finish: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Batches of (doc_id, ids) as `finish` makes them."""
    buckets, kind = C.bucket_count(docs.sparkSession), encoder(path).kind

    def block(parts: list[tuple], words_only: bool) -> pa.RecordBatch:
        """The distinct words of a block for their buckets, or the texts as word numbers for the block's home."""
        keys, data, starts, ends, counts, ids, valid = [], [], [], [], [], [], []
        size = 0
        for doc_ids, words in parts:
            keys.append(W.hashes(words, lower=False))
            data.append(words.data)
            starts.append(words.starts + size)
            ends.append(words.ends + size)
            counts.append(np.diff(words.bounds))
            ids.append(doc_ids.fill_null(0).to_numpy())
            valid.append(doc_ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8))
            size += len(words.data)
        keys, starts, ends, data = (np.concatenate(x) for x in (keys, starts, ends, data))
        counts, ids, valid = C.small(np.concatenate(counts)), np.concatenate(ids), np.concatenate(valid)
        order = np.argsort(keys)  # whichever of equal words comes first
        first, times = C.runs(keys[order])
        often = np.argsort(-times, kind="stable")  # frequent words get small numbers, the same in both passes
        rank = np.empty(len(often), np.uint32)
        rank[often] = np.arange(len(often), dtype=np.uint32)
        name = xxhash.xxh3_128_digest(b"".join([keys, counts, ids, valid]))
        home = int.from_bytes(name[:8], "little") % buckets
        if not words_only:
            number = np.empty(len(keys), np.uint32)
            number[order] = np.repeat(rank, times)
            return _rows([(home, name, 0, C.pack(number, counts, ids, valid))])
        rows = []
        sample, raw = order[first], data.tobytes()
        for b, i, j in C.ranges(keys[sample], buckets):
            own = [raw[a:z] for a, z in zip(starts[sample[i:j]].tolist(), ends[sample[i:j]].tolist(), strict=True)]
            cell = C.pack(rank[i:j])
            rows.append((b, name, home + 1, len(cell).to_bytes(8, "little") + cell + zstandard.compress(b"\n".join(own), 1)))
        return _rows(rows)

    def split(batches: Iterator[pa.RecordBatch], words_only: bool) -> Iterator[pa.RecordBatch]:
        have, parts = 0, []
        for part in W.slices(batches):
            words = W.split(*W.text_bytes(part.column(1)))
            parts.append((part.column(0), words))
            have += len(words.starts)
            if have >= BLOCK_WORDS:
                yield block(parts, words_only)
                have, parts = 0, []
        if parts:
            yield block(parts, words_only)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The words of a bucket become ids, each distinct word once."""
        cells = [(name, part - 1, cell) for x in batches for _, name, part, cell in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        table: dict[bytes, bytes] = {}
        own = encoder(path)
        for name, home, cell in cells:
            at = 8 + int.from_bytes(cell[:8], "little")
            (rank,) = C.unpack(cell[8:at])
            words = zstandard.decompress(cell[at:]).split(b"\n")
            new = [w for w in words if w not in table]
            table.update(zip(new, own.words(new), strict=True))
            ids = [table[w] for w in words]
            sizes = np.array([len(i) for i in ids]) // np.dtype(kind).itemsize
            yield _rows([(home, name, 1, C.pack(rank, C.small(sizes), np.frombuffer(b"".join(ids), kind)))])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for x in batches for r in zip(*(c.to_pylist() for c in x.columns), strict=True))
        for _, group in groupby(rows, key=lambda r: r[1]):
            group = list(group)
            texts = [r[3] for r in group if r[2] == 0]
            if not texts:
                raise RuntimeError("a block of texts was split in two ways; write the texts to files first")
            number, counts, ids, valid = C.unpack(texts[0])
            replies = [C.unpack(r[3]) for r in group if r[2] == 1]
            n = int(number.max()) + 1 if len(number) else 0
            if sum(len(r[0]) for r in replies) != n * len(texts):  # equal blocks share a name
                raise RuntimeError("a block of texts was split in two ways; write the texts to files first")
            size, at, total = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
            for rank, sizes, flat in replies:
                size[rank] = sizes
                at[rank] = total + np.cumsum(sizes.astype(np.int64)) - sizes
                total += len(flat)
            flat = np.concatenate([r[2] for r in replies]) if replies else np.zeros(0, kind)
            for _ in texts:
                edges, i = np.concatenate([[0], np.cumsum(counts.astype(np.int64))]), 0
                while i < len(counts):
                    j = max(i + 1, int(np.searchsorted(edges, edges[i] + (1 << 18), "right")) - 1)
                    own = number[edges[i] : edges[j]]
                    sizes = size[own]
                    ends = np.cumsum(sizes)
                    out = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[own] - (ends - sizes), sizes)]
                    bounds = np.concatenate([[0], ends])[edges[i : j + 1] - edges[i]]
                    who = pa.array(ids[i:j], pa.int64(), mask=valid[i:j] == 0)
                    if packed:
                        values = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((bounds * out.dtype.itemsize).astype(np.int32)), pa.py_buffer(out.tobytes())])
                    else:
                        values = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(out.astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([who, values], names=["doc_id", "ids"])
                    i = j

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    words = texts.mapInArrow(lambda batches: split(batches, True), _ROWS).repartitionById(buckets, F.col("bucket"))
    numbers = texts.mapInArrow(lambda batches: split(batches, False), _ROWS)
    home = words.mapInArrow(coded, _ROWS).union(numbers).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("block", "part")
    return home.mapInArrow(lambda batches: finish(joined(batches)), schema)


def _pieces(batches: Iterator[pa.RecordBatch], table: list[str]) -> Iterator[pa.RecordBatch]:
    """Ids joined with the table of pieces: (doc_id, ids, ids_text, text)."""
    size, decimal = len(table), [str(i) for i in range(len(table))]
    for x in batches:
        texts, numbers = [], []
        at, flat = x.column(1).offsets.to_numpy(), x.column(1).values.to_numpy()
        for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            own = flat[i:j]
            if len(own) and (own.max() >= size or own.min() < 0):
                numbers.append(" ".join(map(str, own.tolist())))
                own = own[(own >= 0) & (own < size)].tolist()
            else:
                own = own.tolist()
                numbers.append(" ".join([decimal[k] for k in own]))
            texts.append(" ".join([table[k] for k in own]))
        yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), pa.array(numbers, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "ids", "ids_text", "text"])


DECODED = "doc_id long, ids array<int>, ids_text string, text string"


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """`encoded` (doc_id, ids) with `ids_text`, the ids in decimal, and `text`: pieces of the ids, joined by one space.

    Special tokens stay. An id outside of the vocabulary has no piece and is left out. Null ids are none.
    """
    told = encoded.sparkSession.sparkContext.broadcast(encoder(path).pieces)
    ids = F.coalesce("ids", F.array().cast("array<int>")).alias("ids")
    return encoded.select("doc_id", ids).mapInArrow(lambda batches: _pieces(batches, told.value), DECODED)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """decode(encode(docs)) in one pass over the ids."""
    told = docs.sparkSession.sparkContext.broadcast(encoder(path).pieces)
    return _joined(docs, path, False, lambda batches: _pieces(batches, told.value), DECODED)
