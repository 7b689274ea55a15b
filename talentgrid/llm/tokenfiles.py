"""Token ids as binary files of independent zstandard frames that can be read one document at a time.

A file holds, in this order:

* frames: each an independent zstandard frame (with its own content checksum) of at most FRAME_IDS ids of one
  document, as little-endian unsigned integers of `width` bytes; a document without ids has no frame;
* the index: a skippable frame (magic 0x184D2A50) around a zstandard frame of `width` (int64), the number of documents
  (int64) and, as int64 columns, their ids, whether they have an id, their numbers of token ids and of frames;
* the seek table: a skippable frame (magic 0x184D2A5E) with compressed size, raw size and checksum (low half of
  the raw bytes' XXH64) of each frame as unsigned 32-bit integers, the size of the index frame counting as
  the last entry with raw size 0; then the number of entries, a descriptor byte with the checksum flag, and the
  seekable magic 0x8F92EAB1.

The seek table is that of the public zstandard seekable format, so its readers skip the index. Documents lie in
ascending doc_id order over all files (rows without doc_id first, ties by ids). Files are named with a random
part and become valid through the manifest, a Parquet table which Spark commits: a task that is run twice leaves
an unlisted file, not a wrong result.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as filesystems
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from talentgrid.llm import cells as C

FRAME_IDS = 1 << 20
INDEX_MAGIC, TABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUM_FLAG = 0x80
READ_BYTES = 4 << 20
MANIFEST = "part int, file string, documents long, ids long"
READ = "doc_id long, start long, ids array<int>"
Finish = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def frames(raw: bytes, width: int, press: zstandard.ZstdCompressor) -> bytes:
    """One document's frames, behind their number and rows of the seek table."""
    step, table, out = FRAME_IDS * width, [], []
    for i in range(0, len(raw), step):
        part = raw[i : i + step]
        out.append(press.compress(part))
        table.append((len(out[-1]), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
    return struct.pack("<I", len(table)) + np.array(table, "<u4").tobytes() + b"".join(out)


class Writer:
    """Writes one file of the format from documents' frames."""

    def __init__(self, out, width: int):
        self.out, self.width, self.table, self.index = out, width, [], []

    def add(self, doc_id: int | None, cell: bytes) -> None:
        (n,) = struct.unpack_from("<I", cell)
        rows = np.frombuffer(cell, "<u4", 3 * n, 4).reshape(n, 3)
        self.table.append(rows)
        self.index.append((doc_id or 0, doc_id is not None, int(rows[:, 1].astype(np.int64).sum()) // self.width, n))
        self.out.write(memoryview(cell)[4 + 12 * n :])

    def close(self) -> tuple[int, int]:
        """The numbers of documents and of ids."""
        index = np.array(self.index, np.int64).reshape(-1, 4).T
        body = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(struct.pack("<qq", self.width, len(self.index)) + index.tobytes())
        self.out.write(struct.pack("<II", INDEX_MAGIC, len(body)) + body)
        table = np.concatenate([*self.table, np.array([(len(body) + 8, 0, 0)], "<u4")])
        self.out.write(struct.pack("<II", TABLE_MAGIC, 12 * len(table) + 9) + table.tobytes() + struct.pack("<IBI", len(table), CHECKSUM_FLAG, SEEKABLE_MAGIC))
        self.out.close()
        return len(self.index), int(index[2].sum())


class Reader:
    """Reads one file: all documents, or requested ones by their place in the file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise ValueError("not a token file")
        table = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), "<u4").reshape(n, 3)
        edges = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        self.press = zstandard.ZstdDecompressor()
        body = self.press.decompress(self._at(int(edges[-2]) + 8, int(table[-1, 0]) - 8))
        self.width, count = struct.unpack_from("<qq", body)
        self.doc_id, has_id, self.sizes, frames = np.frombuffer(body, np.int64, 4 * count, 16).reshape(4, count)
        self.has_id = has_id.astype(bool)
        self.table, self.edges = table[:-1], edges[:-1]
        self.last = np.cumsum(frames)
        self.first = self.last - frames

    def _at(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def document(self, place: int) -> np.ndarray:
        """The ids of one document; only its own frames are read."""
        return next(self.documents(place, place + 1))

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        """The ids of documents first to last, read by runs of about READ_BYTES."""
        last = len(self.sizes) if last is None else last
        begin, end, kind = self.edges[self.first], self.edges[self.last], np.dtype(f"<u{self.width}")
        while first < last:
            upto = max(first + 1, first + int(np.searchsorted(end[first:last], begin[first] + READ_BYTES, "right")))
            data = self._at(int(begin[first]), int(end[upto - 1] - begin[first]))
            for d in range(first, upto):
                raw = b""
                for f in range(int(self.first[d]), int(self.last[d])):
                    at = int(self.edges[f] - begin[first])
                    size, length, check = self.table[f].tolist()
                    part = self.press.decompress(data[at : at + size])
                    if len(part) != length or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != check:
                        raise ValueError(f"frame {f} is damaged")
                    raw += part
                yield np.frombuffer(raw, kind)
            first = upto


def write_tokens(encoded: DataFrame, doc_ids: DataFrame, folder: str, width: int) -> DataFrame:
    """Write `encoded` (doc_id, ids packed in `width` bytes each) to files in `folder`, and return their manifest.

    doc_ids: the same doc_id values, cheap to read; their quantiles are the limits of the files. `folder` is a URI that
    pyarrow's file systems know and that all executors share. The manifest (part, file, documents, ids) lists the files
    in the order of their documents.
    """
    spark = encoded.sparkSession
    files = C.bucket_count(spark)
    cuts = F.percentile_approx("doc_id", F.array(*[F.lit(i / files) for i in range(1, files)]), 10_000) if files > 1 else F.array()
    limits = np.unique(np.array(doc_ids.agg(cuts.alias("x")).first().x or [], np.int64))

    def pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1, write_checksum=True)
        for x in batches:
            ids = x.column(0)
            slot = np.where(ids.is_valid().to_numpy(zero_copy_only=False), np.searchsorted(limits, ids.fill_null(0).to_numpy(), "right"), 0)
            yield pa.RecordBatch.from_arrays([pa.array(slot.astype(np.int32)), ids, pa.array([frames(r, width, press) for r in x.column(1).to_pylist()], pa.binary())], names=["part", "doc_id", "cell"])

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystems.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        writer = None
        for x in batches:
            for part, doc_id, cell in zip(*(c.to_pylist() for c in x.columns), strict=True):
                if writer is None:
                    name = f"part-{part:05d}-{uuid.uuid4().hex}.tokens"
                    writer, mine = Writer(store.open_output_stream(f"{root}/{name}"), width), part
                writer.add(doc_id, cell)
        if writer is not None:
            documents, ids = writer.close()
            yield pa.RecordBatch.from_pydict({"part": [mine], "file": [name], "documents": [documents], "ids": [ids]}, schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("documents", pa.int64()), ("ids", pa.int64())]))

    rows = encoded.select("doc_id", "ids").mapInArrow(pressed, "part int, doc_id long, cell binary")
    rows = rows.repartitionById(files, F.col("part")).sortWithinPartitions("doc_id", "cell")
    path = f"{folder}/manifest"
    rows.mapInArrow(written, MANIFEST).write.parquet(path)
    return spark.read.schema(MANIFEST).parquet(path)


def read_tokens(manifest: DataFrame, folder: str, wanted: list[int] | None = None, finish: Finish = iter, schema: str = READ) -> DataFrame:
    """(doc_id, start, ids): every document in order of doc_id, or those of `wanted` ids.

    start is the number of ids in all documents before. Of a file only the frames of wanted documents are read.
    `finish` makes other batches (of `schema`) of these where they are read, so that the ids themselves go no further.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.withColumn("before", F.coalesce(F.sum("ids").over(before), F.lit(0)))  # a row for each file
    spread = files.repartition(C.bucket_count(manifest.sparkSession), "file").select("file", "before")
    only = None if wanted is None else np.unique(np.array(wanted, np.int64))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = filesystems.FileSystem.from_uri(folder)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            doc_id, start, ids = zip(*rows, strict=True)
            bounds = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
            values = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32)))
            return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), values], names=["doc_id", "start", "ids"])

        for x in batches:
            for name, before in zip(*(c.to_pylist() for c in x.columns), strict=True):
                with store.open_input_file(f"{root}/{name}") as source:
                    reader = Reader(source)
                    start = before + np.cumsum(reader.sizes) - reader.sizes
                    places = np.arange(len(start)) if only is None else np.flatnonzero(reader.has_id & np.isin(reader.doc_id, only))
                    rows, held = [], 0
                    ids = reader.documents() if only is None else (reader.document(p) for p in places.tolist())
                    for p, own in zip(places.tolist(), ids, strict=True):
                        rows.append((int(reader.doc_id[p]) if reader.has_id[p] else None, int(start[p]), own))
                        held += len(own)
                        if held >= 1 << 18 or len(rows) >= 10_000:
                            yield batch(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch(rows)

    return spread.mapInArrow(lambda batches: finish(read(batches)), schema)
