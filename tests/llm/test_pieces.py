"""SentencePiece ids, spans and decoding against the library, with the model's own and a compiled character map."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from talentgrid.llm import pieces
from talentgrid.llm.queries import QUERIES, piece_model

from .conftest import ODD

TEXTS = ["", " ", "   ", "a", "\x01 b", "a  b ", "\n\n a", "▁▁ x", "① ①", "x" * 3000, "\x00a", "ー゙か゚ ", None, "<s> </s> <0x41> <unk>"]


def some_texts() -> list[str | None]:
    r = random.Random(5)
    letters = [*"aAbB'sStT.,!0129 \n\té́ß|>中İſK\x1c\x85\xa0▁①ﬁ　Å", "  ", "é", "<s>", "</s>", "가", "ﾞ", "カ", "hello", " the"]
    return TEXTS + ["".join(r.choice(letters) for _ in range(r.randint(1, 40))) for _ in range(600)]


@pytest.fixture(scope="module", params=["own", "map", "map and squeezed spaces"])
def model_file(request, tmp_path_factory):
    """The public model, and copies with the library's own compiled map in place of the empty one."""
    if request.param == "own":
        return piece_model()
    rules = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    blob = dict(pieces.fields(dict(pieces.fields(rules))[pieces.NORMALIZER]))[2]
    spec = pieces.message([(1, b"nmt_nfkc"), (2, blob), (3, 1), (4, int(request.param != "map")), (5, 1)])
    with open(piece_model(), "rb") as file:
        parts = [(k, v) for k, v in pieces.fields(file.read()) if k != pieces.NORMALIZER]
    path = tmp_path_factory.mktemp("models") / "mapped.model"
    path.write_bytes(pieces.message([*parts, (pieces.NORMALIZER, spec)]))
    return str(path)


def test_ids_and_spans(spark, model_file):
    library, texts = sentencepiece.SentencePieceProcessor(model_file=model_file), some_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in pieces.encode(docs, model_file).collect()}
    told = {r.doc_id: r for r in pieces.round_trip(docs, model_file).collect()}
    back = {r.doc_id: r for r in pieces.decode(pieces.encode(docs, model_file), model_file).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        want = library.encode(text, return_type="offset_mapping", return_bytes=True)
        size = len(text.encode())
        assert got[i].ids == [*want["ids"], library.eos_id()]
        assert list(zip(got[i].begins, got[i].ends, strict=True)) == [*map(tuple, want["offsets"]), (size, size)]
        assert told[i].text == back[i].text == library.decode(got[i].ids) and told[i].ids == got[i].ids
        assert told[i].ids_text == " ".join(map(str, got[i].ids))


def test_any_ids_decode(spark, model_file):
    library, r = sentencepiece.SentencePieceProcessor(model_file=model_file), random.Random(2)
    rows = [[r.choice([0, 1, 2, 5, 229, 148, 163, 28705, 264, 260, r.randrange(32000), r.randrange(3, 259)]) for _ in range(r.randint(0, 8))] for _ in range(1500)]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id long, ids array<int>")
    for x in pieces.decode(table, model_file).collect():
        assert x.text == library.decode(rows[x.doc_id])


def test_odd_rows(spark, odd, nothing):
    rows = pieces.encode(odd, piece_model()).collect()
    assert len(rows) == len(ODD) and pieces.encode(nothing, piece_model()).count() == 0
    assert all(r.ids == [2] and r.begins == r.ends == [0] for r in rows if r.doc_id in (3, 4))
    bad = spark.createDataFrame([(1, [264, 10**6, -1]), (2, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r for r in pieces.decode(bad, piece_model()).collect()}
    assert got[1].text == "a" and got[1].ids_text == "264 1000000 -1" and got[2].text == ""


def test_query(spark, folder, odd):
    docs = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    docs.write.parquet(f"{folder}/documents.parquet")
    library = sentencepiece.SentencePieceProcessor(model_file=piece_model())
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    got = {r.doc_id: r for r in QUERIES["op12_piece_round_trip"](spark, folder).collect()}
    texts = {r.doc_id: r.text or "" for r in docs.select("doc_id", F.col("text")).collect()}
    assert got.keys() == texts.keys()
    for i, text in texts.items():
        ids = library.encode(text, add_eos=True)
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)))
        assert got[i].covered == len(text.encode())
