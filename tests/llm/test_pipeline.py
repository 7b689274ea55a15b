"""Every stage of the pipeline, on what the stage before kept, against a plain version."""

import random

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from talentgrid.llm.queries import vocabulary

LETTERS = {"aa": "abcdefgh", "bb": "ijklmnop"}


def _documents() -> list[tuple]:
    r = random.Random(17)
    vocabulary_of = {g: ["".join(r.choices(a, k=r.randint(2, 6))) for _ in range(250)] for g, a in LETTERS.items()}
    passage = r.choices(vocabulary_of["aa"], k=64)
    texts = []
    for i in range(90):
        g = r.choice(sorted(LETTERS))
        own = r.choices(vocabulary_of[g], k=r.randint(60, 160))
        if i % 6 == 0:
            own[10:10] = passage
        texts.append((own, g))
    for i in range(0, 30, 2):  # near copies, a few words changed
        own = list(texts[i][0])
        for at in r.sample(range(len(own)), i % 5):
            own[at] = r.choice(vocabulary_of[texts[i][1]])
        texts.append((own, texts[i][1]))
    rows = [(3 * i, " ".join(w), g) for i, (w, g) in enumerate(texts)]
    rows += [(1000 + i, "".join(r.choices("zyxwvutsrq", k=500)), None) for i in range(4)]  # junk
    return rows + [(2000, None, "aa"), (2001, "", "aa"), (2002, "%% 12 ##", None)]


def _shingles(text: str, size: int) -> frozenset:
    words = text.lower().split()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def _first_of_each(docs: dict) -> dict:
    sets = {i: _shingles(t, 5) for i, t in docs.items()}
    group = {i: i for i in docs}

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    ids = sorted(docs)
    for i in ids:
        for j in ids:
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) > 0:
                a, b = sorted((root(i), root(j)))
                group[b] = a
    return {i: t for i, t in docs.items() if root(i) == i}


def _without_repeats(docs: dict) -> dict:
    words, first = {i: t.split() for i, t in docs.items()}, {}
    for i in sorted(docs):
        for at in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][at : at + 50]), i)
    out = {}
    for i, own in words.items():
        gone = set()
        for at in range(len(own) - 49):
            if first[tuple(own[at : at + 50])] < i:
                gone |= set(range(at, at + 50))
        out[i] = [w for at, w in enumerate(own) if at not in gone]
    return out


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(doc_id → text) after each filtering stage, the source first; and the last stage's rows."""
    folder = str(tmp_path_factory.mktemp("pipeline"))
    rows = _documents()
    docs = spark.createDataFrame([(*x, "s", len(x[1] or "")) for x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{folder}/documents.parquet")
    items = [(1, " ".join(rows[7][1].split()[5:35])), (2, "quite another question that no text holds at all")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    held = [{i: t for i, t, _ in rows}]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = now.columns
        now = corpus_pipeline.staged(stage(spark, now, folder), name)
        assert now.columns == columns
        held.append({r.doc_id: r.text for r in now.collect()})
        assert now.count() == len(held[-1])
    return held, corpus_pipeline.run(spark, folder).collect(), dict(items)


def test_language_id_drops_what_no_language_fits(steps):
    before, after = steps[0][:2]
    assert after == {i: t for i, t in before.items() if i < 1000}


def test_one_of_each_group_stays(steps):
    before, after = steps[0][1:3]
    assert after == _first_of_each(before) and len(after) < len(before)


def test_repeated_passages_go(steps):
    before, after = steps[0][2:4]
    want = _without_repeats(before)
    assert {i: t.split() for i, t in after.items()} == want
    assert sum(map(len, want.values())) < sum(len(t.split()) for t in before.values())


def test_documents_with_an_item_go(steps):
    before, after, items = steps[0][3], steps[0][4], steps[2]
    clean = {i: t for i, t in before.items() if not any(f" {item} " in f" {t} " for item in items.values())}
    assert after == clean and len(clean) < len(before)


def test_ids_are_those_of_the_tokenizer(steps):
    tokenizer = Tokenizer.from_file(vocabulary())
    tokenizer.no_truncation()
    tokenizer.no_padding()
    kept = steps[0][4]
    assert {r.doc_id: r.ids for r in steps[1]} == {i: tokenizer.encode(t, add_special_tokens=False).ids for i, t in kept.items()}
    assert all(r.n_tokens == len(r.ids) for r in steps[1])
