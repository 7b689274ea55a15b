"""Language ID, language-model scores, licenses, leaks."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from talentgrid.llm import decontaminate, langid, licenses, lm

from .conftest import ODD


def test_language_of_held_out_texts(spark):
    import random

    r = random.Random(5)
    parts = {"aa": ["th", "er", "on", "an"], "bb": ["sch", "ü", "ei", "ch"], "cc": ["ño", "ar", "os", "ue"]}
    rows = [(i, " ".join("".join(r.choices(parts[g], k=3)) for _ in range(30)), g) for i in range(120) for g in [r.choice(sorted(parts))]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.products(langid.counts(docs.where("doc_id % 4 <> 2"), "lang"))
    got = {x.doc_id: x for x in langid.predict(docs.where("doc_id % 4 = 2").drop("lang"), *model).collect()}
    assert all(got[i].lang_pred == g and 0 <= got[i].score <= 1 for i, _, g in rows if i % 4 == 2)


@pytest.mark.parametrize("n", [1, 2, 4, 20])
def test_junk_has_no_language_however_many_there_are(spark, n):
    import random
    import string

    r = random.Random(n)
    rows = []
    for g in range(n):
        parts = ["".join(r.choices(string.ascii_lowercase, k=r.choice([2, 3]))) for _ in range(25)]
        rows += [(100 * g + i, " ".join("".join(r.choices(parts, k=2)) for _ in range(r.choice([8, 30, 200]))), f"l{g:02}") for i in range(30)]
    junk = ["".join(r.choices(string.ascii_lowercase, k=400)), " ".join("".join(r.choices(string.ascii_letters + string.digits, k=40)) for _ in range(40)), "%% 12 ## " + "z" * 300]
    docs = spark.createDataFrame(rows + [(10_000 + i, t, None) for i, t in enumerate(junk)], "doc_id long, text string, lang string").repartition(3)
    assert sorted(x.doc_id for x in langid.identified(docs).collect()) == [i for i, _, _ in rows]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert langid.identified(unlabelled).count() == docs.count()


def test_gram_vectors_give_the_cosine():
    codes = np.array([5 * 4096 + 3 * 64 + 1, 7])
    table = langid.gram_vectors(codes, 3, 256)
    letter = langid.gram_vectors(np.array([1]), 1, 256)[0]
    assert (np.abs(table) == 1).all() and abs(int(table[0].astype(int) @ table[1])) < 100 and len(letter) == 256


def plain_grams(text):
    kinds = [0] + [langid._classes()[ord(c)] if ord(c) < 65536 else (27 + ord(c) % 37 if c.isalpha() else 0) for c in text] + [0]
    last = len(kinds) - 1  # the gaps before and after a text always count
    kinds = [int(k) for i, k in enumerate(kinds) if k or i in (0, last) or kinds[i - 1]]
    return [tuple(kinds[i : i + 3]) for i in range(len(kinds) - 2) if any(kinds[i : i + 3])]


def test_languages_by_plain_vectors(spark):
    rows = [(i, t, g) for i, (t, g) in enumerate([("The cat sat, on the mat!", "en"), ("a dog and the log", "en"), ("le chat  est là", "fr"), ("où est le chien", "fr"), ("das ist ein hund", "de")])]
    asked = [(10, "the hund est"), (11, "chat chat chat"), (12, "ein"), (13, "q"), (14, "Das Là 𝒳 the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = langid.products(langid.counts(docs, "lang"))
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), *model).collect()}

    letter = np.random.Generator(np.random.PCG64(langid.SEED)).integers(0, 2, (64, 2048)) * 2 - 1
    vector = lambda gram: np.prod([np.roll(letter[c], 2 - k) for k, c in enumerate(gram)], axis=0)
    proto = {}
    for lang in ("de", "en", "fr"):
        seen = Counter(g for _, t, own in rows if own == lang for g in plain_grams(t))
        whole = sum(np.sqrt(n / seen.total()) * vector(g) for g, n in seen.items())
        proto[lang] = whole / np.linalg.norm(whole)
    for i, text in asked:
        seen = Counter(plain_grams(text))
        cosine = {k: sum(n * vector(g) @ p for g, n in seen.items()) / np.sqrt(2048 * sum(n * n for n in seen.values())) for k, p in proto.items()}
        above = {k: max(c - np.mean(list(cosine.values())), 0) for k, c in cosine.items()}
        assert got[i].lang_pred == max(sorted(cosine), key=cosine.get)
        assert abs(got[i].score - max(above.values()) / sum(above.values())) < 1e-4


def test_a_column_of_other_values_names_no_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 20)
    monkeypatch.setattr(langid, "HELD", 3)
    rows = [(i, f"text of {chr(97 + i % 20)}", f"l{i % 20:02d}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    assert langid.products(langid.counts(docs, "lang"))[0] == [f"l{i:02d}" for i in range(20)]
    with pytest.raises(ValueError, match="more than 20"):
        langid.products(langid.counts(docs.withColumn("lang", docs.doc_id.cast("string")), "lang"))


def test_language_of_odd_rows(odd, nothing):
    got = {r.doc_id: r for r in langid.predict(odd, *langid.products(langid.counts(odd, "lang"))).collect()}
    assert got[3].lang_pred == got[4].lang_pred == got[5].lang_pred == "und" and got[3].score == 0
    assert got[7].lang_pred == "fr"
    assert langid.identified(odd).columns == odd.columns
    assert langid.identified(nothing).count() == 0
    untaught = langid.predict(odd, *langid.products(langid.counts(nothing, "lang"))).collect()
    assert {r.lang_pred for r in untaught} == {"und"}


def test_scores(corpus):
    rows, docs = corpus
    got = {r.doc_id: r for r in lm.scores(docs, F.col("doc_id") % 5 != 1).collect()}
    tokens = {i: [w.lower() for w in t.encode().split()] + [None] for i, t in rows}
    c = Counter(w for i, own in tokens.items() if i % 5 != 1 for w in own)
    whole = sum(c.values()) + 0.5 * (len(c) + 1)
    for i, own in tokens.items():
        assert got[i].n_tokens == len(own) and got[i].n_known == sum(c[w] > 0 for w in own) and got[i].train_tokens == sum(c.values())
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / whole) for w in own), rel=1e-9)
        assert got[i].score < 0


def test_scores_keep_every_pair(corpus, monkeypatch):
    monkeypatch.setattr(lm, "FILTER_BYTES", 64, raising=False)  # a size cap must leave nothing out
    rows, docs = corpus
    got = {r.doc_id: r.score for r in lm.scores(docs, F.col("doc_id") % 5 != 1).collect()}
    tokens = {i: [w.lower() for w in t.encode().split()] + [None] for i, t in rows}
    words = Counter(w for i, own in tokens.items() if i % 5 != 1 for w in own)
    pairs = Counter(p for i, own in tokens.items() if i % 5 != 1 for p in zip([0, *own[:-1]], own, strict=True))
    whole = sum(words.values()) + 0.5 * (len(words) + 1)
    held = lambda c: float(lm.MEANING[lm.level(np.array([c]))[0]]) if c else 0.0
    assert sum(n == 1 for n in pairs.values()) > 1000
    off = n = 0
    for i, own in tokens.items():
        want = 0.0
        for v, w in zip([0, *own[:-1]], own, strict=True):
            context, both = held(words[v or None]), held(pairs[v, w])
            want += math.log10(0.9 * (held(words[w]) + 0.5) / whole + 0.1 * both / max(context, both, 1))
        off, n = off + abs(got[i] - want), n + len(own)
    assert off / n < 0.02  # chance hits of the filter


def test_scores_are_equal_however_the_filter_is_reached(corpus, monkeypatch):
    docs = corpus[1].unionByName(corpus[1])  # blocks of equal content
    held = sorted(lm.scores(docs, F.col("doc_id") % 5 != 1).collect())
    monkeypatch.setattr(lm, "BROADCAST_BYTES", -1)
    assert sorted(lm.scores(docs, F.col("doc_id") % 5 != 1).collect()) == held


def test_every_block_of_texts_comes_home(corpus, monkeypatch):
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 1)
    rows, docs = corpus
    cells = [r.cell for r in lm.counted(docs.withColumn("learn", F.lit(True))).where("kind = 0").collect()]
    heads = [c for c in cells if c[:1] == b"n"]
    assert sorted(i for c in heads for i in lm.C.unpack(c[21:])[0].tolist()) == [i for i, _ in rows]
    assert {c[1:21] for c in heads} == {c[1:21] for c in cells if c[:1] == b"s"}


def test_scores_come_from_the_filter_that_tasks_hold(spark, corpus):
    texts = corpus[1].select("doc_id", "text", F.lit(True).alias("learn"))
    parts = lm.staged(lm.counted(texts), "counts")
    buckets = lm.C.bucket_count(spark)
    cells, model = parts.where("kind = 0").select("bucket", "cell"), parts.where("kind = 1")
    full = spark.sparkContext.broadcast(lm.held_filter(model, buckets))
    empty = spark.sparkContext.broadcast(lm.held_filter(model.limit(0), buckets))
    known = {r.doc_id: r for r in lm.scored(cells, 1e5, full).collect()}
    unknown = {r.doc_id: r for r in lm.scored(cells, 1e5, empty).collect()}
    assert all(unknown[i].score < known[i].score and unknown[i].base_score == known[i].base_score for i in known)


def test_filter_holds_levels():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 4000).astype(np.uint64)
    counts = np.arange(1, 4001)
    made = lm.Filter([lm.segment_bits(keys[:0], counts[:0]), lm.segment_bits(keys, lm.level(counts))])
    made.sizes[0] = 0
    high = keys | np.uint64(1 << 63)
    made = lm.Filter([np.zeros(0, np.uint64), lm.segment_bits(high, lm.level(counts))])
    read = made.counts(high)
    assert (read >= lm.MEANING[lm.level(counts)]).all() and (read == lm.MEANING[lm.level(counts)]).mean() > 0.95
    assert (made.counts(high + np.uint64(1)) > 0).mean() < 0.05 and (made.counts(keys >> np.uint64(1)) == 0).all()


def test_scores_of_odd_rows(odd, nothing):
    rows = lm.scores(odd, F.col("doc_id") != 6).collect()
    assert len(rows) == len(ODD)
    got = {r.doc_id: r for r in rows}
    assert got[3].n_tokens == got[4].n_tokens == 1 and got[6].n_known == 1
    assert [r.base_score for r in rows if r.doc_id == 2] == [got[1].base_score] * 2
    assert lm.scores(nothing, F.lit(True)).count() == 0
    assert lm.scores(odd, F.lit(False)).where("n_known > 0").count() == 0


def test_automata():
    a = licenses.compile_template("t", "<<beginOptional>>the<<endOptional>> code by <<var; words=1..2>> is <<beginOptional>>really <<beginOptional>>very<<endOptional>><<endOptional>> free")
    run = lambda text: licenses.matches(a, text.encode().split())
    assert run("the code by me is free") == [(0, 6)] and run("x code by you two is really very free y") == [(1, 9)]
    assert run("code by is free") == [] and run("code by a b c is free") == [] and run("code by me is very free") == []
    assert run("code by me is free code by me is really free") == [(0, 5), (5, 11)]
    for bad in ("<<beginOptional>>a", "<<var; words=0..2>> a", "<<other>> a", "<<beginOptional>>a<<endOptional>>"):
        with pytest.raises(ValueError):
            licenses.compile_template("t", bad)


def test_license_scan(spark, odd, nothing):
    texts = ["Released under the MIT License. under the mit-license", "Licensed under the Apache License, Version 2.0!", "CC BY-NC cc  by  nc", "under the mit licensee", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for i, text in enumerate(texts):
        assert got[i].n_words == len(re.findall(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").encode()))
    assert [(p.label, p["at"]) for p in got[0].phrases] == [("mit", 1), ("mit", 5)] and {t.label for t in got[0].templates} == {"mit-notice"}
    assert [p.label for p in got[1].phrases] == ["apache-2"] and got[1].templates[0].label == "apache-2.0-notice"
    assert [p["at"] for p in got[2].phrases] == [0, 3] and not got[3].phrases and not got[4].phrases and got[5].n_words == 0
    assert licenses.scan(odd).count() == len(ODD) and licenses.scan(nothing).count() == 0


def test_leaks(spark, odd, nothing):
    item = "If Tom has 12 apples and gives Mary 5 apples, how many apples does Tom have left after 12 days?"
    items = spark.createDataFrame([(1, item), (2, "too short"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    swap = lambda *pairs: re.sub(r"Tom|Mary|12|5", lambda m: dict(pairs)[m[0]], item)
    texts = {
        1: f"Before. {item} After.",
        2: "Well. " + swap(("Tom", "Bob"), ("Mary", "Ann"), ("12", "30"), ("5", "7")),
        3: swap(("Tom", "Bob"), ("Mary", "Bob"), ("12", "30"), ("5", "7")),  # two names became one
        4: item.upper(),
        5: "If Tom has 12 apples he is happy and that is all that there is to say about it.",
        6: None,
        7: "",
    }
    docs = spark.createDataFrame([*texts.items(), (None, item)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert set(got) == {(d, i) for d in (1, 2, 4, None) for i in (1, 5)}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[1, 1]["at"] == 1
    assert sorted(r.doc_id for r in decontaminate.without_leaks(docs, items).collect()) == [3, 5, 6, 7]
    assert decontaminate.without_leaks(odd, items).columns == odd.columns and decontaminate.without_leaks(odd, items).count() == len(ODD)
    assert decontaminate.leaks(nothing, items).count() == 0 and decontaminate.leaks(docs, items.limit(0)).count() == 0


def _leaks(spark, items, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    return {(r.doc_id, r.item_id): r.verbatim for r in found.collect()}


def test_verbatim_leaks_of_numbers_and_short_items(spark):
    items = ["Find the median of 3 5 7 9 11 13", "Compute 12 + 34 - 5 * 6", "Name the capital", "1 2 3 4 5 6 7 8 9 10 11 12"]
    texts = [f"Some words first. {t} And some words after it." for t in items]
    texts += ["Find the median of 4 6 8 10 12 14", "Compute 13 + 35 - 6 * 7", "Name the large capital", "9 8 7 6 5 4 3 2 1 2 3 4 5 6"]
    assert _leaks(spark, items, texts) == {(i, i): True for i in range(4)}


def test_leaks_with_other_names_and_units(spark):
    items = [
        "Tom has 3 apples. Tom buys 5 more. Tom gives 2 to Ann. How many are left?",
        "If Tom has 12 apples and gives Mary 5 apples, how many apples does Tom have left after 12 days?",
        "After a run of 5 km the old dog of Tom slept and then ran 7 km to the house of Ann again.",
    ]
    texts = [
        "Mary has 4 apples. Mary buys 6 more. Mary gives 3 to Bob. How many are left?",
        "If Anna Lee has 30 apples and gives Bob 7 apples, how many apples does Anna Lee have left after 30 days?",
        "After a run of 8km the old dog of Anna Lee slept and then ran 9 miles to the house of Jo Ann Fox again.",
        "Mary has 4 apples. Bob buys 6 more. Mary gives 3 to Mary. How many are left?",  # at odds with itself
        "If Tom has 12 red apples and gives Mary 5 apples, how many green and ripe apples does Tom have left after 12 days?",
    ]
    got = _leaks(spark, items, texts)
    assert set(got) == {(0, 0), (1, 1), (2, 2), (4, 1)} and not any(got[i, i] for i in range(3))


def test_leaks_with_other_capitals_and_number_words(spark):
    items = [
        "After lunch the friends Étienne and Émile share nine apples, and then Émile gives Étienne three hundred more of the same kind.",
        "В лесу живут Анна и Борис и они нашли 12 грибов а потом Анна отдала 5 грибов своему другу.",
        "The shop of Tom sold twenty-five pears on the first day and forty pears on the next day of that week.",
    ]
    texts = [
        "After lunch the friends Óscar and Élise share 8 apples, and then Élise gives Óscar twenty more of the same kind.",
        "В лесу живут Ольга и Денис и они нашли 30 грибов а потом Ольга отдала 7 грибов своему другу.",
        "The shop of Ann sold ninety two pears on the first day and 11 pears on the next day of that week.",
        "After lunch the friends Óscar and Élise share 8 apples, and then Paul gives Marc twenty more of the same kind.",
    ]
    got = _leaks(spark, items, texts)
    assert {(0, 0), (1, 1), (2, 2)} <= set(got) and not any(got[i, i] for i in range(3))
    assert items[0].upper() != items[0] and _leaks(spark, items[:1], [items[0].upper()])[0, 0]


def test_leaks_against_brute_force(spark):
    """Whole items and halves of them, as they are, with other numbers, and at odds, against a plain search for the planted."""
    import random

    r = random.Random(11)
    words = ["".join(r.choices("bcdfglmnprst", k=5)) for _ in range(400)]

    def filled(form, values):
        return " ".join(str(values[w]) if isinstance(w, int) else w for w in form)

    forms = [[r.choice(words) for _ in range(r.randint(14, 30))] for _ in range(30)]
    for form in forms:
        for at in r.sample(range(len(form)), 3):
            form[at] = r.randrange(2)  # a slot
    items = [filled(form, (7, 40 + i)) for i, form in enumerate(forms)]
    texts, want = [], set()
    for d in range(120):
        i, kind = r.randrange(len(forms)), d % 4
        slots = {w for w in forms[i] if isinstance(w, int)}
        inner = {0: items[i], 1: filled(forms[i], (900 + d, 13)), 2: filled(forms[i], (5, 5)), 3: " ".join(items[i].split()[:4])}[kind]
        if kind < 2 or kind == 2 and len(slots) == 1:
            want.add((d, i))
        texts.append(" ".join(r.choices(words, k=40)) + " " + inner + " " + " ".join(r.choices(words, k=40)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(x.doc_id, x.item_id): x for x in decontaminate.leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect()}
    whole = {(d, i) for d, t in enumerate(texts) for i, item in enumerate(items) if f" {item} " in f" {t} "}
    assert {k for k, x in got.items() if x.verbatim and x.covered == x.words} == whole
    assert want <= set(got) and {k for k in got if k[0] % 4 == 3} == set()
