"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

A window of `width` consecutive words is removed from a document if the same words also start in a document
with a smaller doc_id; overlapping windows merge into maximal intervals. Every window of every text takes
part: a map task hashes a block of texts, cuts (hash, document, position) into cells by ranges of hashes,
and each range is one task that finds the windows of two or more documents. Only removed positions come
back. Of a window that several documents of a block hold, only the places in the least of them go to the range; in
the others it is removed whatever other blocks hold. A notice that a third of all documents hold thus reaches its
range as one document a block, and a longer passage is spread over as many ranges as it has windows.

Null or empty text, or fewer words than `width`: nothing removed. A row without doc_id is kept whole and is no
source. Rows that repeat a doc_id are one document to each other, so none removes from the other; rows are told
apart by doc_id and a hash of the text. Hashes have 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm import cells as C
from talentgrid.llm import words as W
from talentgrid.llm.boxes import boxed, unboxed

BLOCK_WORDS = 2_000_000
SPANS = "array<struct<from:int,to:int>>"


def removal_spans(docs: DataFrame, width: int = 50) -> DataFrame:
    """(doc_id, fp, spans): the maximal intervals [from, to) of words to remove, one row for each document that has any."""
    buckets = C.bucket_count(docs.sparkSession)

    def removed(doc, place, doc_ids, fps) -> list[tuple[int, bytes]]:
        """Cells of removed windows, by a hash of their document."""
        home = W.mix(fps.view(np.uint64) ^ W.mix(doc_ids.view(np.uint64)))[doc]
        order = np.lexsort((doc, home))
        doc, place, rows = doc[order], place[order], []
        for b, i, j in C.ranges(home[order], buckets):
            own, at = np.unique(doc[i:j], return_inverse=True)
            rows.append((b, C.pack(doc_ids[own], fps[own], C.small(at), C.small(place[i:j]))))
        return rows

    def block(keys, places, doc_ids, fps) -> pa.RecordBatch:
        keys, places, doc_ids, fps = map(C.joined, (keys, places, doc_ids, fps))
        order = np.argsort(keys)
        keys = keys[order]
        places = places[order]
        del order
        rows, equal = [], np.concatenate([[False], keys[1:] == keys[:-1], [False]])
        again = np.flatnonzero(equal[1:] | equal[:-1])  # windows that the block holds several times
        if len(again):
            starts, lengths = C.runs(keys[again])
            owner = doc_ids[places["doc"][again]]
            again = again[owner > np.repeat(np.minimum.reduceat(owner, starts), lengths)]
            del owner, starts, lengths
            rows = removed(places["doc"][again], places["at"][again], doc_ids, fps)
            stays = np.ones(len(keys), bool)
            stays[again] = False
            del again
            keys = keys[stays]
            places = places[stays]
        for b, i, j in C.ranges(keys, buckets):
            doc, place = places["doc"][i:j], places["at"][i:j]
            own, doc = np.unique(doc, return_inverse=True)
            rows.append((b, C.pack(C.gaps(keys[i:j]), C.small(doc), C.small(place), doc_ids[own], fps[own])))
        return C.batch(rows)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, docs_in, keys, places, doc_ids, fps = 0, 0, [], [], [], []
        for part in W.slices(batches):
            words = W.split(*W.text_bytes(part.column(1)))
            starts = W.whole(words.bounds, width)
            if len(starts):
                doc = W.owners(words.bounds)[starts]
                place = np.empty(len(starts), [("doc", np.uint32), ("at", np.uint32)])
                place["doc"], place["at"] = doc + docs_in, starts - words.bounds[doc]
                keys.append(W.rolling(W.hashes(words, lower=False), width)[starts])
                places.append(place)
            doc_ids.append(part.column(0).to_numpy())
            fps.append(part.column(2).to_numpy())
            have, docs_in = have + len(starts), docs_in + part.num_rows
            if have >= BLOCK_WORDS:
                yield block(keys, places, doc_ids, fps)
                have, docs_in, keys, places, doc_ids, fps = 0, 0, [], [], [], []
        if have:
            yield block(keys, places, doc_ids, fps)

    def repeated(bucket: int, packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        parts, rows, n = [], [], 0
        for cell in packed:  # their narrow arrays stay as they are; only windows of several cells are joined
            arrays = C.unpack(cell)
            if len(arrays) == 4:  # windows removed in their own block; this bucket is their document's
                yield C.batch([(bucket, cell)])
                continue
            keys, doc, place, doc_ids, fps = arrays
            parts.append((C.ungaps(keys), doc, place, n))
            rows.append((doc_ids, fps))
            n += len(doc_ids)
        if not parts:
            return
        both = np.concatenate([p[0] for p in parts])
        both.sort()
        both = both[1:][both[1:] == both[:-1]]
        if not len(both):
            return
        met = []
        while parts:
            keys, doc, place, first = parts.pop()
            own = np.flatnonzero(both[np.minimum(np.searchsorted(both, keys), len(both) - 1)] == keys)
            met.append((keys[own], doc[own].astype(np.int64) + first, place[own].astype(np.int64)))
        del both
        keys, doc, place = (np.concatenate(x) for x in zip(*met, strict=True))
        doc_ids, fps = (np.concatenate(x) for x in zip(*rows, strict=True))
        order = np.argsort(keys)
        _, lengths = C.runs(keys[order])
        owner = doc_ids[doc[order]]
        least = np.minimum.reduceat(owner, np.cumsum(lengths) - lengths)
        order = order[owner > np.repeat(least, lengths)]
        rows = removed(doc[order], place[order], doc_ids, fps)
        if rows:
            yield C.batch(rows)

    def merged(bucket: int, packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        """All removed windows of some documents, as intervals."""
        parts = [(doc_ids[at], fps[at], place.astype(np.int64)) for doc_ids, fps, at, place in map(C.unpack, packed)]
        doc_ids, fps, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((place, fps, doc_ids))
        doc_ids, fps, place = doc_ids[order], fps[order], place[order]
        other = np.concatenate([[True], (doc_ids[1:] != doc_ids[:-1]) | (fps[1:] != fps[:-1])])
        begin = other | np.concatenate([[True], np.diff(place) > width])
        end = np.concatenate([begin[1:], [True]])
        rows = np.flatnonzero(other[begin])
        spans = pa.StructArray.from_arrays([pa.array(place[begin].astype(np.int32)), pa.array((place[end] + width).astype(np.int32))], names=["from", "to"])
        offsets = pa.array(np.append(rows, len(spans)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(doc_ids[other]), pa.array(fps[other]), pa.ListArray.from_arrays(offsets, spans)], names=["doc_id", "fp", "spans"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("fp"))
    found = C.by_bucket(texts.mapInArrow(hashed, C.CELL), buckets, repeated, C.CELL)
    return C.by_bucket(found, buckets, merged, f"doc_id long, fp long, spans {SPANS}")


def cut_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """(row, doc_id, text, words, removed, spans) of every row: its other columns, its text without repeats, and counts.

    text holds the kept words joined by one space where something was removed, else it is unchanged, null too; spans are the
    removed intervals (from, to) of words, null if none.
    """
    found = removal_spans(docs, width).select(F.col("doc_id").alias("id"), F.col("fp").alias("key"), "spans")
    rows = boxed(docs).withColumn("fp", F.xxhash64("text"))
    both = rows.join(found, (F.col("doc_id") == F.col("id")) & (F.col("fp") == F.col("key")), "left").select("row", "doc_id", "text", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            row, doc_id, texts, spans = part.columns
            counts = np.diff(W.split(*W.text_bytes(texts)).bounds).astype(np.int32)
            removed, new = np.zeros(len(counts), np.int32), texts
            hit = np.flatnonzero(spans.is_valid().to_numpy(zero_copy_only=False)).tolist()
            if hit:
                out = texts.to_pylist()
                for i in hit:
                    own, keep, last = out[i].encode().split(), [], 0
                    for span in spans[i].as_py():
                        keep += own[last : span["from"]]
                        last = span["to"]
                    keep += own[last:]
                    removed[i] = len(own) - len(keep)
                    out[i] = b" ".join(keep).decode()
                new = pa.array(out, texts.type)
            yield pa.RecordBatch.from_arrays([row, doc_id, new, pa.array(counts), pa.array(removed), spans], names=["row", "doc_id", "text", "words", "removed", "spans"])

    schema = both.select("row", "doc_id", "text", F.lit(0).alias("words"), F.lit(0).alias("removed"), "spans").schema
    return both.mapInArrow(cut, schema)


def remove_repeats(docs: DataFrame, width: int = 50) -> DataFrame:
    """The columns of `docs` with the kept words in `text`; see cut_repeats."""
    return unboxed(cut_repeats(docs, width), docs.columns)
