"""Substring dedup and the n-gram join against brute force, and their odd cases."""

import hashlib
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from talentgrid.llm import cells as C
from talentgrid.llm import components, setjoin, substrings
from talentgrid.llm import words as W
from talentgrid.llm.cells import pack, small, unpack

from .conftest import ODD


def lower(text):
    return text.encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()


def test_words_and_hashes_match_python():
    texts = ["a  bc\td", "", None, "A bc " + "z" * 700_000 + " bc"]
    data, at = W.text_bytes(pa.array(texts))
    words = W.split(data, at)
    got = [data[a:b].tobytes() for a, b in zip(words.starts, words.ends, strict=True)]
    assert got == [w for t in texts for w in (t or "").encode().split()]
    low = dict(zip(W.hashes(words, True).tolist(), [w.lower() for w in got], strict=True))
    assert len(low) == len({w.lower() for w in got})
    rolled = W.rolling(np.arange(10, dtype=np.uint64), 3)
    assert len(set(rolled.tolist())) == 8 and (rolled[2:] == W.rolling(np.arange(2, 10, dtype=np.uint64), 3)).all()


def test_cells_keep_arrays():
    arrays = [np.arange(5, dtype=np.uint64) << np.uint64(60), small(np.array([], np.int64)), np.array([1.5, -2.0])]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, unpack(pack(*arrays)), strict=True))


def kept_words(rows, width):
    seen, out = {}, {}
    for i, text in sorted(rows):
        own = (text or "").encode().split()
        gone = [False] * len(own)
        keys = [tuple(own[j : j + width]) for j in range(len(own) - width + 1)]
        for j, key in enumerate(keys):
            if seen.get(key, i) < i:
                gone[j : j + width] = [True] * width
        for key in keys:
            seen.setdefault(key, i)
        out[i] = b" ".join(w for w, g in zip(own, gone, strict=True) if not g)
    return out


def test_repeats_are_removed(corpus):
    rows, docs = corpus
    got = {r.doc_id: r for r in substrings.cut_repeats(docs, 20).collect()}
    for i, kept in kept_words(rows, 20).items():
        assert " ".join(got[i].text.split()).encode() == kept
        assert got[i].words - got[i].removed == len(kept.split())
        assert sum(s["to"] - s["from"] for s in got[i].spans or []) == got[i].removed


@pytest.mark.parametrize("block", [60, 2_000_000])
def test_notice_in_most_documents(spark, monkeypatch, block):
    monkeypatch.setattr(substrings, "BLOCK_WORDS", block)
    notice = " ".join(f"n{i}" for i in range(25))
    rows = [(i, f"w{i} {notice} x{i}" if i % 3 else f"{notice} y{i} {notice}") for i in range(0, 200, 2)]
    rows += [(51, "z " * 70), (9, "z " * 90), (9, f"{notice} again"), (10, notice), (301, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    got = defaultdict(list)
    for r in substrings.cut_repeats(docs, 20).collect():
        got[r.doc_id].append((r.words - r.removed, r.spans))
    once = [(i, t) for i, t in rows if i not in (9, 10)]
    first = kept_words(once, 20)[0]
    assert first.split().count(b"n0") == 2 and got[0] == [(51, None)]  # a document keeps its own repeats
    assert sorted(n for n, _ in got[9]) == [1, 90] and sorted(n for n, _ in got[10]) == [0, 2]
    assert got[51] == [(0, [(0, 70)])] and got[301] == [(0, None)]
    for i in range(12, 200, 2):
        assert got[i] == [(2, [(1, 26)])] if i % 3 else got[i] == [(1, [(0, 25), (26, 51)])]


def test_repeats_of_odd_rows(odd, nothing):
    rows = substrings.cut_repeats(odd, 50).collect()
    assert len(rows) == len(ODD)
    by = defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    assert [r.text for r in by[2]] == ["", ""] and by[4][0].text is None and by[4][0].words == 0
    assert by[None][0].removed == 0 and by[8][0].removed == 0
    assert substrings.remove_repeats(odd, 50).columns == odd.columns
    assert substrings.remove_repeats(nothing, 50).count() == 0


def brute_components(rows, size, percent):
    sets = {}
    for i, text in rows:
        own = lower(text or "")
        sets[i] = frozenset(tuple(own[j : j + size]) for j in range(len(own) - size + 1)) or frozenset([tuple(own)] if own else [])
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    lists = defaultdict(list)
    for i, own in sets.items():
        shared = Counter()
        for gram in own:
            shared.update(lists[gram])
            lists[gram].append(i)
        for j, k in shared.items():
            if 100 * k >= percent * (len(own) + len(sets[j]) - k):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize(("size", "percent", "crowd"), [(4, 85, 3), (3, 60, 1000)])
def test_similar_texts(corpus, monkeypatch, size, percent, crowd):
    monkeypatch.setattr(setjoin, "CROWD", crowd)
    monkeypatch.setattr(setjoin, "LIST_BLOCK", 7)
    rows, docs = corpus
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.similar_texts(docs, size, percent).collect()}
    assert got == brute_components(rows, size, percent)


def test_similar_odd_rows(odd, nothing):
    rows = setjoin.similar_texts(odd, 5, 80).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    assert got[2].component_id == 1 and got[3].n_shingles == 0 and got[4].component_id == 4 and got[6].n_shingles == 1
    kept = [r.doc_id for r in setjoin.one_of_each(odd, 5, 80).collect()]
    assert sorted(kept, key=lambda i: (i is None, i)) == [1, 3, 4, 5, 6, 7, 8, 9, None]
    assert setjoin.one_of_each(nothing, 5, 80).columns == odd.columns and setjoin.similar_texts(nothing).count() == 0


def test_signatures_differ_no_more_than_sets():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a, b = (rng.choice(400, rng.integers(0, 300), replace=False).astype(np.uint64) for _ in "ab")
        x, y = (np.frombuffer(setjoin.signature(s), np.uint64) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b)) and len(x) == setjoin.SIGNATURE_BITS // 64


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert len({got[i] for i in range(41)}) == 1 and got[100] == got[90] == got[95] != got[0]


def test_query_digest(spark, folder):
    from talentgrid.llm.queries import op7_substring_dedup

    rows = [(1, " a  b "), (2, None), (3, "c " * 60), (4, "c " * 55)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in op7_substring_dedup(spark, folder).collect()}
    kept = kept_words(rows, 50)
    assert {i: r.kept_sha256 for i, r in got.items()} == {i: hashlib.sha256(k).hexdigest() for i, k in kept.items()}
    assert got[4].n_removed == 55 and got[3].n_removed == 0


def test_blocks_of_windows_are_held_once(spark, monkeypatch):
    """A block of windows, 16 bytes each, is sorted in less than 64 bytes for each window."""
    ran, n = [], 400_000
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, work, *_: ran.append(work) or self.select(F.lit(0).alias("bucket"), F.lit(b"").alias("cell")))
    substrings.removal_spans(docs, 5)
    text = " ".join(map(str, range(n)))
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1], pa.int64()), "text": [text], "fp": pa.array([7], pa.int64())})
    monkeypatch.setattr(substrings.W, "rolling", lambda values, width: values[: len(values) - width + 1])
    made = list(ran[0](iter([batch])))
    taken, most = substrings.np.concatenate, []

    def traced(*a, **b):  # from where the parts of a block are put together
        if not most:
            tracemalloc.start()
            most.append(0)
        return taken(*a, **b)

    monkeypatch.setattr(substrings.np, "concatenate", traced)
    try:
        assert list(ran[0](iter([batch])))[0].equals(made[0])
        assert tracemalloc.get_traced_memory()[1] < 64 * n
    finally:
        tracemalloc.stop()


def most_bytes(work, bucket, cells) -> int:
    tracemalloc.start()
    try:
        list(work(bucket, iter(cells)))
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_ranges_of_windows_and_shingles_are_held_in_narrow_arrays(spark, monkeypatch):
    """A range's task takes less than 48 bytes for each window or shingle of its cells."""
    ran, n = {}, 400_000
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    monkeypatch.setattr(C, "by_bucket", lambda cells, buckets, work, schema: ran.setdefault(work.__name__, work) and spark.createDataFrame([], schema))
    substrings.removal_spans(docs, 5)
    setjoin.frequent_shingles(docs, 5)
    rng = np.random.default_rng(3)
    cells, grams = [], []
    for k in range(4):
        keys = np.sort(rng.integers(0, 1 << 60, n // 4, np.uint64)) | np.uint64(1)
        keys[-1] = (1 << 60) + 2  # one window and one shingle are in every cell
        doc, place = np.arange(n // 4) // 1000, np.arange(n // 4) % 1000
        ids = np.arange(100) + 100 * k
        cells.append(C.pack(C.gaps(keys), C.small(doc), C.small(place), ids, ids))
        grams.append(C.pack(C.small(C.gaps(keys >> np.uint64(32))), C.small(np.where(np.arange(n // 4) == n // 4 - 1, 5, 1))))
    (removed,) = ran["repeated"](0, iter(cells))
    assert sorted(d for c in removed.column(1).to_pylist() for d in C.unpack(c)[0].tolist()) == [199, 299, 399]
    (often,) = ran["frequent"](0, iter(grams))
    assert often.to_pylist() == [{"key": ((1 << 60) + 2) >> 32, "n": 20}]
    assert most_bytes(ran["repeated"], 0, cells) < 48 * n
    assert most_bytes(ran["frequent"], 0, grams) < 48 * n
