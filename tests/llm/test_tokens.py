"""BPE, token files, vectors, URL filters, and the pipeline."""

import io
import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from talentgrid.llm import ann, bpe, tokenfiles, urlfilter
from talentgrid.llm.queries import QUERIES, vocabulary
from talentgrid.llm.staging import new_path

from .conftest import ODD, prose


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary())


def test_round_trip(spark, library):
    r = random.Random(1)
    letters = list("aAbB'sStT.,!0129 \n\té́ß <|>中İſK\x1c\x85\xa0")
    texts = ["<|endoftext|> a<|STARTOFTEXT|>", "Don't we'LL", "H̱ ẖ", "", None, "x" * 3000]
    texts += ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(500)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {x.doc_id: x for x in bpe.decode(bpe.encode(docs, vocabulary()), vocabulary()).collect()}
    same = {x.doc_id: x for x in bpe.round_trip(docs, vocabulary()).collect()}
    for i, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[i].ids == ids and got[i].text == library.decode(ids, skip_special_tokens=False)
        assert got[i] == same[i]


def test_ids_of_odd_rows(odd, nothing):
    rows = bpe.encode(odd, vocabulary()).collect()
    assert len(rows) == len(ODD) and bpe.encode(nothing, vocabulary()).count() == 0
    assert [r.ids for r in rows if r.doc_id in (3, 4, 5)] == [[], [], []]


def test_decode_leaves_out_unknown_ids(spark):
    rows = [(1, [320, 10**6, -1]), (2, None)]
    got = {r.doc_id: r for r in bpe.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>"), vocabulary()).collect()}
    assert got[1].text == bpe.encoder(vocabulary()).pieces[320] and got[1].ids_text == "320 1000000 -1" and got[2].text == ""


def test_token_files(spark, folder, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME_IDS", 16)
    rows = [(i, list(range(i % 50))) for i in range(0, 300, 3)] + [(7, [5]), (7, [4]), (None, [9, 9])]
    pack = lambda ids: np.array(ids, "<u2").tobytes()
    table = spark.createDataFrame([(i, bytearray(pack(x))) for i, x in rows], "doc_id long, ids binary").repartition(5)
    path = new_path(spark, "tokens")
    manifest = tokenfiles.write_tokens(table, table.select("doc_id"), path, 2)
    got = tokenfiles.read_tokens(manifest, path).orderBy("start", F.size("ids")).collect()
    want = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [i for i, _ in want]
    assert sorted(r.ids for r in got) == sorted(x for _, x in rows)
    assert all(b.start == a.start + len(a.ids) for a, b in zip(got, got[1:], strict=False))
    some = tokenfiles.read_tokens(manifest, path, [9, 7, 999]).collect()
    assert sorted((r.doc_id, r.ids) for r in some) == [(7, [4]), (7, [5]), (9, list(range(9)))]


class Source(io.BytesIO):
    def size(self):
        return len(self.getbuffer())


def test_frames_stand_alone_and_are_checked():
    out = Source()
    keep = out.close
    out.close = lambda: None
    writer, press = tokenfiles.Writer(out, 2), zstandard.ZstdCompressor(write_checksum=True)
    texts = [np.arange(n, dtype="<u2") for n in (5, 0, 1000)]
    for i, ids in enumerate(texts):
        writer.add(i, tokenfiles.frames(ids.tobytes(), 2, press))
    writer.close()
    reader = tokenfiles.Reader(out)
    assert all((reader.document(i) == ids).all() for i, ids in enumerate(texts))
    raw = bytearray(out.getvalue())
    assert zstandard.ZstdDecompressor().decompress(bytes(raw[: int(reader.edges[1])])) == texts[0].tobytes()
    assert reader.table[0, 2] == xxhash.xxh64_intdigest(texts[0].tobytes()) & 0xFFFFFFFF
    raw[int(reader.edges[1]) + 12] ^= 1
    damaged = tokenfiles.Reader(Source(bytes(raw)))
    assert zlib.crc32(damaged.document(0).tobytes()) == zlib.crc32(texts[0].tobytes())
    with pytest.raises((ValueError, zstandard.ZstdError)):
        damaged.document(2)
    keep()


def test_nearest_vectors(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((700, 16))
    x[100:400] = x[100]  # a vector that many rows share
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(None, [1.0] * 16), (700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [1.0] * 3), (704, [None] * 16), (705, [float("inf")] * 16), (706, [])]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in ann.nearest(table, F.col("id") % 20 == 0, 10).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert sorted(got) == list(range(0, 700, 20))
    hits = 0
    for q, found in got.items():
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(700), -score.round(12)))[:10].tolist()
        found.sort()
        assert [r for r, _, _ in found] == list(range(1, 11)) and all(s == pytest.approx(score[v]) for _, v, s in found)
        hits += len(set(best) & {v for _, v, _ in found})
        if 100 <= q < 400 and score[100 if q > 100 else 101] >= score.max() - 1e-9:
            assert [v for _, v, _ in found][:10] == best
    assert hits >= 0.9 * 10 * len(got)
    few = ann.nearest(table.where("vec_id < 3"), F.col("id") == 0, 10).collect()
    assert sorted(r.vec_id for r in few) == [1, 2] and ann.nearest(table.limit(0), F.lit(True), 3).count() == 0


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(7)
    for n in (2, 6, 15, 21, 25, 40):
        rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((n, 8)))]
        rows += [(100 + i, rows[i % n][1]) for i in range(n // 3)]  # some vectors twice
        table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
        found = ann.nearest(table, F.lit(True), 20).groupBy("query_id").agg(F.count("*").alias("n"), F.count_distinct("vec_id").alias("d")).collect()
        assert {(r.n, r.d) for r in found} == {(min(20, len(rows) - 1),) * 2} and len(found) == len(rows)


RULES = [urlfilter.Rule.parse(*r) for r in (("allow", "org/"), ("block", "bad.org/es/"), ("block", "com/de/"))]


def test_url_rules_and_links(spark):
    pages = [
        (1, "http://A.org/x?y", None),
        (2, "https://www.bad.org/es/1#t", '<a href="https://far.net/">x</a>'),
        (3, "https://bad.orgx/es/", ""),
        (4, None, "x"),
        (5, "no url", "x"),
        (6, "http://friend.net/q", '<a href="//www.BAD.org:80/">x</a> <img src=http://bad.com/de/>'),
        (7, "http://good.net", None),
        (8, "http://a.org", '<a href="http://good.net/x">'),
        (9, "http://bad.com/de/", None),
        (10, "http://far.net/", "see www.nowhere.info now"),
        (10, "http://far.net/", "see www.nowhere.info now"),
    ]
    docs = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = urlfilter.judge(docs, RULES).collect()
    got = {r.page_id: r for r in rows}
    assert len(rows) == len(pages) and (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("a.org", "/x", "org/", "allow")
    assert (got[2].rule, got[2].verdict) == ("bad.org/es/", "block") and got[3].rule is None and got[8].rule is None
    assert (got[4].host, got[4].path, got[4].verdict) == ("", "", "allow") and got[5].host == ""
    assert got[6].verdict == "block" and got[6].distrust > 0 and got[7].verdict == "allow" and got[7].trust > 0 and got[10].trust == 0
    assert urlfilter.judge(docs.limit(0), RULES).count() == 0


def test_ranks_match_power_iteration(spark):
    links = [("a", "b", 1), ("b", "c", 2), ("c", "a", 1), ("d", "c", 1), ("b", "a", 2)]
    seeds = spark.createDataFrame([("a", 3, 0), ("d", 0, 1), ("c", 1, 1)], "host string, allowed long, blocked long")
    got = {r.host: r for r in urlfilter.ranks(spark.createDataFrame(links, "src string, dst string, n long"), seeds, rounds=5).collect()}
    hosts = "abcd"
    m = np.zeros((4, 4))
    for s, d, n in links:
        m[hosts.index(s), hosts.index(d)] = n
    start, bad = np.array([0.75, 0, 0.25, 0]), np.array([0, 0, 0.5, 0.5])
    out, into = m / np.maximum(m.sum(1, keepdims=True), 1), m / np.maximum(m.sum(0, keepdims=True), 1)
    t, d = start, bad
    for _ in range(5):
        t, d = 0.15 * start + 0.85 * out.T @ t, 0.15 * bad + 0.85 * into @ d
    for i, h in enumerate(hosts):
        assert got[h].trust == pytest.approx(t[i]) and got[h].distrust == pytest.approx(d[i])


def test_pipeline(spark, folder, odd):
    texts = prose(9, 40, 10)
    rows = [(i, t, "en", None, "a", 0.5) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, odd.schema).union(odd.where("doc_id is null or doc_id > 5"))
    docs.write.parquet(f"{folder}/documents.parquet")
    leak = next(t for t in texts if len(t.split()) > 40)
    spark.createDataFrame([(1, " ".join(leak.split()[:30]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "n_tokens", "ids"] and 0 < out.count() < docs.count()
    assert all(r.n_tokens == len(r.ids) for r in out.collect())
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_hosts_with_ports_are_in_the_graph(spark):
    link = '<a href="http://{}/p">x</a>'.format
    rows = [
        (1, "http://x.net/", link("bad.org:8080")),
        (2, "http://user@y.net:81/", link("bad.org")),
        (3, "http://bad.org:8080/es/1", None),
        (4, "http://z.net./", link("fine.net")),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(pages, [urlfilter.Rule("block", "", "/es/")]).collect()}
    assert [got[i].verdict for i in (1, 2, 3, 4)] == ["block", "block", "block", "allow"]
    assert got[1].distrust == pytest.approx(got[2].distrust) and got[2].host == "user@y.net:81" and got[4].host == "z.net."


def test_digests_are_made_where_files_are_read(spark, folder, odd):
    """No ids go through the JVM between the files and their digests."""
    odd.write.parquet(f"{folder}/documents.parquet")
    plan = QUERIES["op3_token_files"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
