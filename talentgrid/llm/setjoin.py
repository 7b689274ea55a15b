"""N-gram Jaccard join with set-relation skipping.

A text is the set of its word shingles. Texts with equal sets are one class; classes are joined:

1. Shingle frequencies over all texts give one order of shingles, rare ones first. Each class is indexed under
   the first few shingles of its set, so that two similar classes meet in some index list.
2. In each list one class leads. Members whose size and position in the list allow it are compared with the
   leader on their whole sets, and what links with it is one component.
3. In lists of CROWD or more that still hold several components, each member is compared with a few members of other
   components, as long as that joins components. A large group of near copies thus becomes one component without its pairs.
4. Lists that still hold several components are searched for all links between them. Entries lie in blocks by
   size and position, and blocks that cannot reach the overlap are skipped. For the others a member's answer
   is first derived from the leader's: with the overlaps of y and z with the leader x known,
   |x∩y| + |x∩z| - |x| <= |y∩z| <= min(|x∩y|, |x∩z|) + min(|y-x|, |z-x|). Of the pairs left open, those go whose
   signatures (the parity of a set's hashes in each of SIGNATURE_BITS places) differ in more places than linked sets can
   differ in members. Only the others are compared.

Every pair of linked classes is thus found, or already joined by links found before, so components are
exact. Sets are compared by 64-bit hashes of their shingles. No list of pairs within a component is made.

A text without words has an empty set and links with nothing; with fewer words than a shingle, its whole
sequence is its one shingle. Null text counts as empty. A row without doc_id is linked with texts of an equal set only, and names
no component.
Rows that repeat a doc_id are texts of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from talentgrid.llm import cells as C
from talentgrid.llm import words as W
from talentgrid.llm.boxes import boxed, unboxed
from talentgrid.llm.components import components
from talentgrid.llm.staging import staged, temporary

BLOCK_SHINGLES = 1_500_000
#: At most so many frequent shingles are told to the tasks, and so many bits of a filter (2 MB each). Both
#: only save work: results are the same with any values.
ORDERED_SHINGLES = 1 << 18
FILTER_BITS = 1 << 24
LIST_BLOCK = 512
#: Sets of a batch that are compared at a time.
COMPARED_BYTES = 1 << 22
SIGNATURE_BITS = 512
#: Step 3 tries at most so many partners of a set in a round, and goes on for at most so many rounds, while more than
#: one in JOINING_SHARE of the partners joins. These save work in step 4, which finds whatever is left.
CROWD, PARTNERS, TRIES, MERGING_ROUNDS, JOINING_SHARE = 32, 3, 8, 5, 20


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    words = W.split(*W.text_bytes(column))
    hashed, at = W.hashes(words, lower=True), words.bounds.tolist()
    grams, out = W.rolling(hashed, size), []
    for i, j in zip(at, at[1:], strict=False):
        if j - i >= size:
            own = np.sort(grams[i : j - size + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif j > i:
            out.append(W.rolling(hashed[i:j], j - i) + np.uint64(j - i))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name of each set, from all its members."""
    total = np.array([np.add.reduce(W.mix(s ^ np.uint64(0x5851F42D4C957F2D))) + np.uint64(len(s)) for s in sets], np.uint64)
    return W.mix(total).view(np.int64)


class Similarity:
    """Jaccard similarity of at least percent / 100, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent

    def prefix(self, n: int) -> int:
        return n - -(-self.percent * n // 100) + 1

    def overlap(self, n, m):
        """The least overlap of sets of n and m that link."""
        return -(-self.percent * (n + m) // (100 + self.percent))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("fp"))


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Upper halves of the hashes of frequent shingles, the most frequent last; counts cover all texts."""
    buckets = C.bucket_count(docs.sparkSession)
    most = max(1, ORDERED_SHINGLES // buckets)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, parts, seen = 0, [], set()

        def block() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(parts))
            starts, lengths = C.runs(keys)
            keys = keys[starts].astype(np.uint64) << np.uint64(32)
            return C.batch([(b, C.pack(C.small(C.gaps(keys[i:j] >> np.uint64(32))), C.small(lengths[i:j]))) for b, i, j in C.ranges(keys, buckets)])

        for part in W.slices(batches):
            sets = shingle_sets(part.column(0), size)
            for name, s in zip(set_ids(sets).tolist(), sets, strict=True):
                if len(s) and name not in seen:
                    seen.add(name)
                    parts.append((s >> np.uint64(32)).astype(np.uint32))
                    have += len(s)
            if have >= BLOCK_SHINGLES:
                yield block()
                have, parts, seen = 0, [], set()
        if have:
            yield block()

    def frequent(bucket: int, packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        low = np.uint64((1 << 32) - 1)
        # a shingle and its count in one number each; a block counts far below 2**32 texts
        both = C.joined([C.ungaps(keys) << np.uint64(32) | counts for keys, counts in map(C.unpack, packed)])
        both.sort()
        keys = (both >> np.uint64(32)).astype(np.uint32)
        equal = np.concatenate([[False], keys[1:] == keys[:-1], [False]])
        both = both[equal[1:] | equal[:-1] | (both & low >= 16)]
        del keys, equal
        starts, _ = C.runs(both >> np.uint64(32))
        total = np.add.reduceat((both & low).astype(np.int64), starts) if len(both) else np.zeros(0, np.int64)
        often = total >= 16
        keys, total = both[starts[often]] >> np.uint64(32), total[often]
        top = np.argsort(total, kind="stable")[-most:]
        yield pa.RecordBatch.from_arrays([pa.array(keys[top].astype(np.int64)), pa.array(total[top])], names=["key", "n"])

    found = C.by_bucket(docs.select("text").mapInArrow(counted, C.CELL), buckets, frequent, "key long, n long").toArrow()
    keys, n = found.column("key").to_numpy(), found.column("n").to_numpy()
    return keys[np.lexsort((keys, n))].astype(np.uint64)


def index_lists(docs: DataFrame, size: int, like: Similarity) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, fp, n, sid), and the lists of two or more classes (token, sid, n, pos, leader, leader_n, near, k).

    k is the number of classes in the list.
    """
    spark = docs.sparkSession
    buckets = C.bucket_count(spark)
    hot = frequent_shingles(docs, size)
    rank = np.argsort(hot)
    told = spark.sparkContext.broadcast((hot[rank], rank))

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ranks = told.value
        have, seen, rows, entries = 0, set(), [], []

        def block() -> pa.RecordBatch:
            texts = [np.concatenate(x) for x in zip(*rows, strict=True)]
            out = [(int(texts[-1][0]) % buckets, b"t" + C.pack(*texts))]
            if entries:
                token, sid, n, pos = (np.concatenate(x) for x in zip(*entries, strict=True))
                order = np.argsort(token)
                token, sid, n, pos = token[order], sid[order], n[order], pos[order]
                for b, i, j in C.ranges(token, buckets):
                    own, at = np.unique(sid[i:j], return_inverse=True)
                    out.append((b, b"e" + C.pack(C.gaps(token[i:j]), own, C.small(at), C.small(n[i:j]), C.small(pos[i:j]))))
            return C.batch(out)

        for part in W.slices(batches):
            sets = shingle_sets(part.column(1), size)
            sids, ns = set_ids(sets), np.array([len(s) for s in sets], np.int64)
            ids = part.column(0)
            rows.append((ids.fill_null(0).to_numpy(), ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8), part.column(2).fill_null(0).to_numpy(), ns, sids))
            for sid, s in zip(sids.tolist(), sets, strict=True):
                if not len(s) or sid in seen:
                    continue
                seen.add(sid)
                p = like.prefix(len(s))
                if len(keys):
                    high = s >> np.uint64(32)
                    at = np.minimum(np.searchsorted(keys, high), len(keys) - 1)
                    often = keys[at] == high
                    if often.any():
                        late = s[often]
                        s = np.concatenate([s[~often], late[np.lexsort((late, ranks[at[often]]))]])
                have += len(s)
                entries.append((s[:p].copy(), np.full(p, sid), np.full(p, len(s)), np.arange(p)))
            if have >= 2 * BLOCK_SHINGLES:
                yield block()
                have, seen, rows, entries = 0, set(), [], []
        if rows:
            yield block()

    def lists(bucket: int, packed: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
        def batch(**columns) -> pa.RecordBatch:
            n = len(next(iter(columns.values())))
            kinds = {"doc_id": pa.int64(), "fp": pa.int64(), "token": pa.int64(), "sid": pa.int64(), "n": pa.int64(), "pos": pa.int64(), "leader": pa.int64(), "leader_n": pa.int64(), "near": pa.bool_(), "k": pa.int64()}
            return pa.RecordBatch.from_arrays([columns[k] if isinstance(columns.get(k), pa.Array) else pa.array(columns[k], t) if k in columns else pa.nulls(n, t) for k, t in kinds.items()], names=list(kinds))

        parts = []
        for x in packed:
            if x[:1] == b"t":
                ids, valid, fp, n, sid = C.unpack(x[1:])
                yield batch(doc_id=pa.array(ids, pa.int64(), mask=valid == 0), fp=fp, n=n, sid=sid)
            else:
                token, own, at, n, pos = C.unpack(x[1:])
                parts.append((C.ungaps(token), own[at], n.astype(np.int64), pos.astype(np.int64)))
        if not parts:
            return
        token, sid, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(token)
        _, lengths = C.runs(token[order])
        order = order[np.repeat(lengths > 1, lengths)]
        order = order[np.lexsort((W.mix(sid[order].view(np.uint64)), token[order]))]
        token, sid, n, pos = token[order], sid[order], n[order], pos[order]
        if not len(token):
            return
        once = np.concatenate([[True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])])
        token, sid, n, pos = token[once], sid[once], n[once], pos[once]
        starts, lengths = C.runs(token)
        crowd = np.repeat(lengths, lengths)
        several = crowd > 1
        lead = np.repeat(starts, lengths)
        near = (100 * np.minimum(n, n[lead]) >= like.percent * np.maximum(n, n[lead])) & (np.minimum(n - pos, (n - pos)[lead]) >= like.overlap(n, n[lead])) & (sid != sid[lead])
        for i in range(0, len(token), 50_000):
            m = np.flatnonzero(several[i : i + 50_000]) + i
            if len(m):
                yield batch(token=token[m].view(np.int64), sid=sid[m], n=n[m], pos=pos[m], leader=sid[lead][m], leader_n=n[lead][m], near=near[m], k=crowd[m])

    both = staged(C.by_bucket(_texts(docs).mapInArrow(indexed, C.CELL), buckets, lists, "doc_id long, fp long, token long, sid long, n long, pos long, leader long, leader_n long, near boolean, k long"), "lists")
    return staged(both.where("token is null").select("doc_id", "fp", "n", "sid"), "texts", up=1), both.where("token is not null").drop("doc_id", "fp")


def signature(members: np.ndarray) -> bytes:
    """Sets that differ in d members have signatures that differ in at most d bits."""
    slot = (W.mix(members) % np.uint64(SIGNATURE_BITS)).astype(np.int64)
    return np.packbits(np.bincount(slot, minlength=SIGNATURE_BITS).astype(np.uint8) & 1).tobytes()


def _slots(sid: np.ndarray, first: np.ndarray) -> np.ndarray:
    return (W.mix(sid.view(np.uint64) ^ W.mix(first.view(np.uint64))) & np.uint64(FILTER_BITS - 1)).astype(np.int64)


def sets_of(docs: DataFrame, classes: DataFrame, sids: DataFrame, size: int, signed: bool = False) -> DataFrame:
    """(sid, members): the whole sets of some classes; with `signed`, their signatures instead.

    The sets are made from the texts anew. A filter of FILTER_BITS over the wanted (class, first document) keeps
    most other sets out of the shuffle; the join keeps out the rest.
    """
    spark = docs.sparkSession
    wanted = staged(sids.distinct().join(classes, "sid").where("first is not null").select("sid", "first"), "wanted")

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            slot = np.unique(_slots(x.column(0).to_numpy(), x.column(1).to_numpy()))
            yield pa.RecordBatch.from_arrays([pa.array(slot >> 5), pa.array(np.int64(1) << (slot & 31))], names=["at", "bit"])

    found = wanted.mapInArrow(bits, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 5, np.uint32)
    table[found.column("at").to_numpy()] = found.column("bits").to_numpy().astype(np.uint32)
    told = spark.sparkContext.broadcast(table)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in W.slices(batches):
            sets = shingle_sets(part.column(1), size)
            sids, first = set_ids(sets), part.column(0).to_numpy()
            slot = _slots(sids, first)
            keep = np.flatnonzero((told.value[slot >> 5] >> (slot & 31).astype(np.uint32)) & 1)
            yield pa.RecordBatch.from_arrays([pa.array(first[keep]), pa.array(sids[keep]), pa.array([signature(sets[i]) if signed else sets[i].tobytes() for i in keep.tolist()], pa.binary())], names=["first", "sid", "members"])

    sets = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(made, "first long, sid long, members binary")
    # The join's key is the class alone, so that its shuffle serves the repeated rows too and sets cross once.
    asked = wanted.select(F.col("sid").alias("class"), F.col("first").alias("document"))
    met = sets.join(asked, (F.col("sid") == F.col("class")) & (F.col("first") - F.col("document") == 0))
    return staged(met.select("sid", "members").dropDuplicates(["sid"]), "sets")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """`pairs` (a, b) of class names with the sizes `na` and `nb` of their sets and their overlap `inter`."""

    def overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in W.slices(batches, "p", COMPARED_BYTES):
            both = [(np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)) for p, q in zip(x.column(2).to_pylist(), x.column(3).to_pylist(), strict=True)]
            out = [[len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))] for p, q in both]
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1), *(pa.array(c) for c in np.array(out, np.int64).reshape(-1, 3).T)], names=["a", "b", "na", "nb", "inter"])

    a = sets.select(F.col("sid").alias("a"), F.col("members").alias("p"))
    b = sets.select(F.col("sid").alias("b"), F.col("members").alias("q"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "p", "q").mapInArrow(overlaps, "a long, b long, na long, nb long, inter long")


def open_pairs(lists: DataFrame, like: Similarity) -> DataFrame:
    """Pairs of classes of different components that may link: (a, b, sure); sure pairs need no comparison.

    lists: (token, sid, n, pos, leader, leader_n, root, inter, sig), inter being the overlap with the leader or null.
    """
    kept = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sure", pa.bool_())])

    def pairs_of(sid, n, pos, root, inter, sig, leader, leader_n) -> Iterator[tuple]:
        order = np.lexsort((pos, n))
        sid, n, pos, root, inter, sig = (x[order] for x in (sid, n, pos, root, inter, sig))
        left = n - pos
        for i in range(0, len(sid), LIST_BLOCK):
            own = slice(i, i + LIST_BLOCK)
            for j in range(i, len(sid), LIST_BLOCK):
                if 100 * n[own][-1] < like.percent * n[j]:
                    break  # this block and the later ones hold sets that are too large
                other = slice(j, j + LIST_BLOCK)
                if min(left[own].max(), left[other].max()) < like.overlap(n[i], n[j]):
                    continue  # too little of the sets comes after the token
                if root[own].min() == root[own].max() == root[other].min() == root[other].max():
                    continue
                y, z = np.meshgrid(np.arange(i, min(i + LIST_BLOCK, len(sid))), np.arange(j, min(j + LIST_BLOCK, len(sid))), indexing="ij")
                y, z = y[y < z], z[y < z]
                y, z = (x[root[y] != root[z]] for x in (y, z))
                least = like.overlap(n[y], n[z])
                ok = (np.minimum(left[y], left[z]) >= least) & (100 * n[y] >= like.percent * n[z])
                known = (inter[y] >= 0) & (inter[z] >= 0)
                ok &= ~((sid[y] == leader) & (inter[z] >= 0)) & ~((sid[z] == leader) & (inter[y] >= 0))
                ok &= ~known | (np.minimum(inter[y], inter[z]) + np.minimum(n[y] - inter[y], n[z] - inter[z]) >= least)
                at = np.flatnonzero(ok)
                y, z, least, known = y[at], z[at], least[at], known[at]
                ok = np.bitwise_count(sig[y] ^ sig[z]).sum(1, dtype=np.int64) <= n[y] + n[z] - 2 * least
                sure = known & (inter[y] + inter[z] - leader_n >= least)
                if ok.any():
                    yield np.minimum(sid[y[ok]], sid[z[ok]]), np.maximum(sid[y[ok]], sid[z[ok]]), sure[ok]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(columns) -> Iterator[pa.RecordBatch]:
            _, sid, n, pos, leader, leader_n, root, inter, sig = columns
            for a, b, sure in pairs_of(sid, n, pos, root, inter, sig, leader[0], leader_n[0]):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(sure)], schema=kept)

        held: list[list[np.ndarray]] = []
        for x in batches:
            signed = np.frombuffer(b"".join(x.column(8).to_pylist()), np.uint64).reshape(-1, SIGNATURE_BITS // 64)
            columns = [*(c.fill_null(-1).to_numpy() for c in x.columns[:8]), signed]
            starts, lengths = C.runs(columns[0])
            for i, k in zip(starts.tolist(), lengths.tolist(), strict=True):
                piece = [c[i : i + k] for c in columns]
                if held and held[0][0][0] != piece[0][0]:
                    yield from work([np.concatenate(c) for c in zip(*held, strict=True)])
                    held = []
                held.append(piece)
        if held:
            yield from work([np.concatenate(c) for c in zip(*held, strict=True)])

    found = lists.select(*LIST_ROW, "sig").repartition("token").sortWithinPartitions("token").mapInArrow(search, "a long, b long, sure boolean")
    return found.groupBy("a", "b").agg(F.max("sure").alias("sure"))


LIST_ROW = ["token", "sid", "n", "pos", "leader", "leader_n", "root", "inter"]


def some_pairs(lists: DataFrame, like: Similarity, turn: int) -> DataFrame:
    """At most PARTNERS pairs (a, b) for each class of `lists`, with classes of other components in the same list."""

    def pick(token, sid, n, pos, root) -> pa.RecordBatch:
        starts, lengths = C.runs(token)
        begin, size = np.repeat(starts, lengths), np.repeat(lengths, lengths).astype(np.uint64)
        left, other = n - pos, np.full(len(sid), -1)
        for k in range(TRIES):
            at = begin + (W.mix(sid.view(np.uint64) ^ W.mix(token.view(np.uint64) + np.uint64(turn * TRIES + k))) % size).astype(np.int64)
            fits = (other < 0) & (root != root[at]) & (np.minimum(left, left[at]) >= like.overlap(n, n[at])) & (100 * np.minimum(n, n[at]) >= like.percent * np.maximum(n, n[at]))
            other[fits] = at[fits]
        y = np.flatnonzero(other >= 0)
        return pa.RecordBatch.from_arrays([pa.array(sid[y]), pa.array(sid[other[y]])], names=["a", "b"])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for x in batches:
            columns = [x.column(i).to_numpy() for i in (0, 1, 2, 3, 6)]
            if held and (sum(len(h[0]) for h in held) >= 1 << 16) and columns[0][0] != last:
                yield pick(*(np.concatenate(c) for c in zip(*held, strict=True)))
                held = []
            held.append(columns)
            last = columns[0][-1]
        if held:
            yield pick(*(np.concatenate(c) for c in zip(*held, strict=True)))

    found = lists.select(*LIST_ROW).repartition("token").sortWithinPartitions("token").mapInArrow(search, "a long, b long").distinct()
    turns = F.row_number().over(Window.partitionBy("a").orderBy(F.xxhash64("a", "b", F.lit(turn)), "b"))
    return found.withColumn("turn", turns).where(f"turn <= {PARTNERS}").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("sid")).union(pairs.select(F.col("b").alias("sid")))


def similar_classes(docs: DataFrame, size: int = 5, percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """Texts (doc_id, fp, n, sid), and (sid, component_id, least) of the classes whose component has several texts.

    component_id is the smallest doc_id of the component, and least the (doc_id, fp) of the text that stands for it.
    """
    with temporary(docs.sparkSession):
        return _similar_classes(docs, size, percent)


def _similar_classes(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    spark, like = docs.sparkSession, Similarity(percent)
    texts, lists = index_lists(docs, size, like)
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "fp")
    classes = staged(texts.where("n > 0").groupBy("sid").agg(F.min(first).alias("least"), F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.first("n").alias("n")), "classes")
    n_classes = classes.count()
    linked = f"100 * inter >= {percent} * (na + nb - inter)"

    stars = staged(lists.where("near").select(F.col("sid").alias("a"), F.col("leader").alias("b")).distinct(), "stars")
    with temporary(spark):
        known = staged(compared(stars, sets_of(docs, classes, _ends(stars), size)), "overlaps", up=1)
    roots = components(known.where(linked)).withColumnRenamed("node", "sid")

    lists = lists.where("k > 2").join(known.select(F.col("a").alias("sid"), F.col("b").alias("leader"), "inter"), ["sid", "leader"], "left")
    lists = staged(lists.withColumn("inter", F.when(F.col("sid") == F.col("leader"), F.col("n")).otherwise(F.col("inter"))), "several")
    n_rows = lists.count()

    def mixed(roots: DataFrame, up: int = 0) -> DataFrame:
        """The rows of lists that hold several components, with their roots."""
        rows = lists.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
        tokens = rows.groupBy("token").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("token")
        return staged(rows.join(tokens, "token"), "mixed", n_rows, up=up)

    def merged(roots: DataFrame, links: DataFrame, out: int = 0) -> DataFrame:
        a, b = (roots.select(F.col("sid").alias(k), F.col("root").alias(f"r{k}")) for k in "ab")
        between = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        up = components(between).select(F.col("node").alias("root"), F.col("root").alias("above"))
        old = roots.join(up, "root", "left").select("sid", F.coalesce("above", "root").alias("root"))
        new = up.join(roots.select(F.col("sid").alias("root")), "root", "left_anti").select(F.col("root").alias("sid"), F.col("above").alias("root"))
        return staged(old.unionByName(new), "roots", n_classes, up=out)

    rest = mixed(roots)
    crowded = f"k >= {CROWD}"
    if not rest.where(crowded).isEmpty():
        with temporary(spark):
            sets = sets_of(docs, classes, rest.where(crowded).select("sid"), size)
            for turn in range(MERGING_ROUNDS):
                tried = staged(compared(some_pairs(rest.where(crowded), like, turn), sets), "tried")
                n, more = tried.agg(F.count("*"), F.count(F.when(F.expr(linked), 1))).first()
                if more:
                    roots = merged(roots, tried.where(linked).select("a", "b"), out=1)
                    rest = mixed(roots, up=1)
                if more * JOINING_SHARE <= n:
                    break
    done = known.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    with temporary(spark):
        signs = sets_of(docs, classes, rest.select("sid"), size, signed=True).withColumnRenamed("members", "sig")
        pairs = staged(open_pairs(rest.join(signs, "sid"), like), "open", up=1)
    unsure = staged(pairs.where("not sure").select("a", "b").join(done, ["a", "b"], "left_anti"), "unsure")
    found = pairs.where("sure").select("a", "b")
    if not unsure.isEmpty():
        with temporary(spark):
            sets = sets_of(docs, classes, _ends(unsure), size)
            found = staged(compared(unsure, sets).where(linked).select("a", "b").union(found), "found", up=1)
    if not found.isEmpty():
        roots = merged(roots, found)
    grouped = staged(classes.join(roots, "sid", "left").withColumn("root", F.coalesce("root", "sid")), "grouped", n_classes)
    least = grouped.groupBy("root").agg(F.min("least").alias("least"), F.min("first").alias("component_id"), F.sum("copies").alias("texts"))
    named = grouped.select("sid", "root").join(least.where("texts > 1"), "root")
    return texts, staged(named.select("sid", "component_id", "least"), "named", n_classes, up=1)


def similar_texts(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row: the smallest doc_id that links lead to."""
    texts, named = similar_classes(docs, size, percent)
    return texts.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of `docs` without near duplicates: the row with the smallest doc_id of each component stays.

    Empty texts all stay, as they link with nothing. Other columns are kept as they are.
    """
    texts, named = similar_classes(docs, size, percent)
    stays = F.col("least").isNull() | (F.col("least.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("least.fp") == F.col("fp")))
    verdict = texts.join(named, "sid", "left").select("doc_id", "fp", (~stays).alias("_gone"), (F.col("n") > 0).alias("_words"))
    verdict = verdict.groupBy(F.col("doc_id").alias("id"), F.col("fp").alias("key")).agg(F.max("_gone").alias("gone"), F.max("_words").alias("words"))
    rows = boxed(docs).withColumn("fp", F.xxhash64("text"))
    rows = rows.join(verdict, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("key"))).where("not gone")
    turn = F.row_number().over(Window.partitionBy("id", "key").orderBy("id"))
    return unboxed(rows.withColumn("turn", turn).where("turn = 1 or not words"), docs.columns)
