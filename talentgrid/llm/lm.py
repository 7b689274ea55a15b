"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training counts every word and every word pair of the training texts. A count c is stored as the level
1 + floor(log2 c): the filter holds (n-gram, 1) to (n-gram, level), so a level is read by probing 1, 2, ... until a
probe fails; a chance hit at most adds a level. The filter is made in segments, one per range of n-gram hashes, each
sized by its entries, BITS_PER_ENTRY for each, and written to the shared folder. It holds every counted n-gram, those
seen once too, so it grows with the training texts. While all segments together have at most BROADCAST_BYTES, counted
before they are read, they are broadcast, and the tasks that score a block of documents probe the filter they hold. A
larger filter is never gathered: a block of documents sends its distinct n-grams to the tasks of their ranges, which
probe their segment and return levels to the block. Both ways probe the same bits, so scores are equal.

p(w | v) = (1 - PAIR) p(w) + PAIR c(v, w) / c(v) with p(w) = (c(w) + 0.5) / (N + 0.5 (V + 1)), counts read from the
filter (a level stands for the middle of its range), N and V exact. A text starts after a start mark and ends with an
end mark, which is a token. The unigram base score uses exact counts instead, which return with the levels.

Words are taken by 64-bit hash of their bytes, A-Z lower-cased. Null text counts as empty: one token, the end.
Repeated rows are scored each; a row without doc_id is scored, and `training` decides whether it is learnt from.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talentgrid.llm import cells as C
from talentgrid.llm import words as W
from talentgrid.llm.staging import release, staged

BLOCK_TOKENS = 1_400_000
BITS_PER_ENTRY = 12
#: Bits of all segments together up to which a worker holds the filter; results do not depend on it.
BROADCAST_BYTES = 32 << 20
PROBES = 4
PAIR = 0.1
END, START = np.uint64(0x60BEE2BEE120FC15), np.uint64(0xA3B195354A39B70D)
_UNI, _BI = np.uint64(0x1B03738712FAD5C9), np.uint64(0x3C6EF372FE94F82B)
LEVELS = 64


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, an end mark after each text, and where each text starts."""
    words = W.split(*W.text_bytes(column))
    out = np.insert(W.hashes(words, lower=True), words.bounds[1:], END)
    return out, words.bounds + np.arange(len(words.bounds))


def before(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The token before each token."""
    out = np.empty_like(flat)
    out[1:] = flat[:-1]
    out[bounds[:-1]] = START
    return out


def unigrams(flat: np.ndarray) -> np.ndarray:
    return W.mix(flat ^ _UNI)


def bigrams(left: np.ndarray, flat: np.ndarray) -> np.ndarray:
    return W.mix(W.mix(left ^ _BI) * np.uint64(3) + flat)


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(np.maximum(counts, 1))).astype(np.int64)


#: The count that a level stands for: the middle of its range.
MEANING = np.concatenate([[0.0], (2.0 ** np.arange(LEVELS) + 2.0 ** np.arange(1, LEVELS + 1) - 1) / 2])


class Filter:
    """Segments of bits; segment i holds the n-grams of bucket i."""

    def __init__(self, segments: list[np.ndarray]):
        self.bits = np.concatenate(segments) if segments else np.zeros(0, np.uint64)
        self.sizes = np.array([len(s) for s in segments], np.uint64) * np.uint64(64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])[:-1].astype(np.uint64)

    @staticmethod
    def places(keys: np.ndarray, levels: np.ndarray, probe: int, sizes: np.ndarray) -> np.ndarray:
        entry = W.mix(keys + levels.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        step = (entry >> np.uint64(32)) | np.uint64(1)
        return ((entry & np.uint64(0xFFFFFFFF)) + np.uint64(probe) * step) % sizes

    def has(self, keys: np.ndarray, levels: np.ndarray, segment: np.ndarray) -> np.ndarray:
        sizes, starts = self.sizes[segment], self.starts[segment]
        yes = sizes > 0
        for probe in range(PROBES):
            own = np.flatnonzero(yes)
            if not len(own):
                break
            at = starts[own] + self.places(keys[own], levels[own], probe, sizes[own])
            yes[own] = (self.bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
        return yes

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Levels of n-grams, by probing one after the other; 0 for those not held."""
        segment = C.bucket_of(keys, len(self.sizes))
        out, open_ = np.zeros(len(keys), np.int64), np.arange(len(keys))
        for k in range(1, LEVELS + 1):
            if not len(open_):
                break
            open_ = open_[self.has(keys[open_], np.full(len(open_), k), segment[open_])]
            out[open_] = k
        return out

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return MEANING[self.levels(keys)]


def segment_bits(keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The segment that holds these n-grams up to their levels."""
    entries = int(levels.sum())
    if not entries:
        return np.zeros(0, np.uint64)
    size = -(-entries * BITS_PER_ENTRY // 64) * 64
    bits = np.zeros(size, bool)
    for k in range(1, int(levels.max()) + 1):
        own = keys[levels >= k]
        for probe in range(PROBES):
            bits[Filter.places(own, np.full(len(own), k), probe, np.uint64(size)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").view(np.uint64)


def counted(texts: DataFrame) -> DataFrame:
    """Levels and counts of each block's n-grams, by range of hashes, from `texts` (doc_id, text, learn).

    Rows of kind 0 are for `bucket`, the home of a block of documents: the block's words in their order, and by range
    the exact counts of its distinct words and the levels of its distinct words and pairs, by hash. A row of kind 1
    holds the filter's segment of a range, its `size` in bytes, the number of its distinct `words`, and of the `tokens` learnt from.
    """
    buckets = C.bucket_count(texts.sparkSession)

    def distinct(keys: np.ndarray, learn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys, each key's place among them, and how many of each are learnt from."""
        keys, at = np.unique(keys, return_inverse=True)
        return keys, at, np.bincount(at, learn, len(keys)).astype(np.int64)

    def block(parts: list[tuple]) -> pa.RecordBatch:
        ids = pa.chunked_array([x.column(0) for x, _, _ in parts])
        learn = np.concatenate([x.column(2).to_numpy(zero_copy_only=False) for x, _, _ in parts])
        flat = unigrams(np.concatenate([flat for _, flat, _ in parts]))
        size = np.concatenate([np.diff(bounds) for _, _, bounds in parts])
        taught, bounds = np.repeat(learn, size), np.concatenate([[0], np.cumsum(size)])
        word, at, of_words = distinct(flat, taught)
        pair, _, of_pairs = distinct(bigrams(before(flat, bounds), flat), taught)
        word_at = {b: (i, j) for b, i, j in C.ranges(word, buckets)}
        pair_at = {b: (i, j) for b, i, j in C.ranges(pair, buckets)}
        used = sorted(word_at.keys() | pair_at.keys())
        null = ids.is_null().to_numpy().astype(np.uint8)
        told = C.pack(ids.fill_null(0).to_numpy(), null, learn.astype(np.uint8), C.small(size), C.gaps(word), C.small(at), np.array([len(used)]))
        # with the task in the name, blocks of equal content have homes of their own
        name = xxhash.xxh3_128_digest(told + TaskContext.get().partitionId().to_bytes(4, "little"))
        home = int(W.mix(np.frombuffer(name, np.uint64))[0] % np.uint64(buckets))
        head = name + home.to_bytes(4, "little")
        rows = [(home, b"n" + head + told)]
        for b in used:
            (i, j), (p, q) = word_at.get(b, (0, 0)), pair_at.get(b, (0, 0))
            rows.append((b, b"w" + head + C.pack(C.gaps(word[i:j]), C.small(of_words[i:j]), C.gaps(pair[p:q]), C.small(of_pairs[p:q]))))
        return C.batch(rows)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, parts = 0, []
        for x in W.slices(batches):
            flat, bounds = tokens(x.column(1))
            parts.append((x, flat, bounds))
            have += len(flat)
            if have >= BLOCK_TOKENS:
                yield block(parts)
                have, parts = 0, []
        if parts:
            yield block(parts)

    def totals(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        if not keys:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        flat, n = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(flat)
        start, _ = C.runs(flat[order])
        return flat[order][start], np.add.reduceat(n[order], start) if len(start) else n

    def reduced(bucket: int, cells: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        held = []
        for cell in cells:  # read once; the words of blocks at home here go on as they come
            if cell[:1] == b"n":
                yield made(0, int.from_bytes(cell[17:21], "little"), cell)
            else:
                held.append((cell[1:21], *C.unpack(cell[21:])))
        words, counts = totals([C.ungaps(x[1]) for x in held], [x[2] for x in held])
        pairs, often = totals([C.ungaps(x[3]) for x in held], [x[4] for x in held])
        taught, seen = counts > 0, often > 0
        own = Filter([segment_bits(np.concatenate([words[taught], pairs[seen]]), level(np.concatenate([counts[taught], often[seen]])))])
        of_words, of_pairs = (own.levels(keys).astype(np.uint8) for keys in (words, pairs))

        def answer(head: bytes, word: np.ndarray, pair: np.ndarray) -> bytes:
            at = np.searchsorted(words, C.ungaps(word))
            return b"s" + head + bucket.to_bytes(4, "big") + C.pack(C.small(counts[at]), of_words[at], of_pairs[np.searchsorted(pairs, C.ungaps(pair))])

        for head, word, _, pair, _ in held:
            yield made(0, int.from_bytes(head[16:], "little"), answer(head, word, pair))
        bits = own.bits.tobytes()
        yield made(1, bucket, bits, int(taught.sum()), int(counts.sum()), len(bits))

    def made(kind: int, bucket: int, cell: bytes, words: int = 0, learnt: int = 0, size: int = 0) -> pa.RecordBatch:
        columns = zip((kind, bucket, cell, words, learnt, size), (pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=["kind", "bucket", "cell", "words", "tokens", "size"])

    return C.by_bucket(texts.mapInArrow(packed, C.CELL), buckets, reduced, "kind int, bucket int, cell binary, words long, tokens long, size long")


def held_filter(segments: DataFrame, buckets: int) -> Filter:
    """The filter of `segments` (bucket, cell), whose size the caller has checked."""
    bits = {r.bucket: np.frombuffer(r.cell, np.uint64) for r in segments.collect()}
    return Filter([bits.get(b, np.zeros(0, np.uint64)) for b in range(buckets)])


def scored(cells: DataFrame, whole: float, held: Broadcast | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, base_score, score) of each document, from rows of kind 0 (bucket, cell).

    `held` is the filter to probe; without it, the levels that the segments' tasks returned are taken.
    """

    def merged(bucket: int, packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(sorted(packed, key=lambda c: c[1:17]), key=lambda c: c[1:17]):
            group = list(group)
            heads = {c for c in group if c[:1] == b"n"}  # equal blocks have equal heads
            copies = sum(c[:1] == b"n" for c in group)
            answers = {c[21:25]: c for c in group if c[:1] == b"s"}
            if len(heads) != 1:
                raise RuntimeError("a block of texts was split in two ways; write the texts to files first")
            ids, null, _, size, word, at, parts = C.unpack(next(iter(heads))[21:])
            if len(answers) != int(parts[0]) or len(group) != copies * (1 + len(answers)):
                raise RuntimeError("a block of texts was split in two ways; write the texts to files first")
            count, of_words, of_pairs = (np.concatenate(x) for x in zip(*(C.unpack(answers[b][25:]) for b in sorted(answers)), strict=True))
            word, bounds = C.ungaps(word), np.concatenate([[0], np.cumsum(size.astype(np.int64))])
            pairs, pair = np.unique(bigrams(before(word[at], bounds), word[at]), return_inverse=True)
            if held is not None:
                of_words, of_pairs = held.value.levels(word), held.value.levels(pairs)
            exact = count.astype(np.float64)[at]
            own, both = MEANING[of_words][at], MEANING[of_pairs][pair]
            context = np.concatenate([[0], own[:-1]])
            context[bounds[:-1]] = own[bounds[1:] - 1]  # as many texts start as end
            log = np.log10((1 - PAIR) * (own + 0.5) / whole + PAIR * both / np.maximum(np.maximum(context, both), 1))
            sums = [np.add.reduceat(x, bounds[:-1]) for x in ((exact > 0).astype(np.int64), np.log10((exact + 0.5) / whole), log)]
            columns = [pa.array(ids, mask=null > 0), pa.array(np.diff(bounds)), *(pa.array(x) for x in sums)]
            for _ in range(copies):
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return C.by_bucket(cells, C.bucket_count(cells.sparkSession), merged, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def scores(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) for every row of `docs` (doc_id, text).

    training: a condition on the columns of `docs`; the model learns from the rows where it is true.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(training, F.lit(False)).alias("learn"))
    parts = staged(counted(texts), "counts")
    model = parts.where("kind = 1")
    sums = model.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n"), F.sum("size").alias("size")).first()
    release(docs.sparkSession)  # by now the write's plan has left the driver's event queue
    whole = (sums.n or 0) + 0.5 * ((sums.v or 0) + 1)
    held = None
    if (sums["size"] or 0) <= BROADCAST_BYTES:
        buckets = C.bucket_count(docs.sparkSession)
        held = docs.sparkSession.sparkContext.broadcast(held_filter(model.select("bucket", "cell"), buckets))
    rows = scored(parts.where("kind = 0").select("bucket", "cell"), whole, held)
    return rows.select("doc_id", "n_tokens", "n_known", F.lit(int(sums.n or 0)).cast("long").alias("train_tokens"), "base_score", "score")
