"""Language ID by hyperdimensional profiles.

Every letter has a random vector of DIMENSIONS signs. A letter n-gram binds its letters' vectors, each turned by its
place in the n-gram; a text or a language bundles (adds) its n-grams, and a text gets the language whose
prototype has the largest cosine with it. Training counts letter n-grams by language in Spark and bundles each language
in a task of its own; the prototypes are sums of n-gram vectors weighted by the counts, each n-gram's weight being
divided over the languages' sizes.

The dot product of a text with a prototype is the sum, over the text's n-grams, of n-gram vector times prototype.
Those products are tabled once (n-grams times languages) and broadcast; the table's size depends on the number of
letters and languages alone, 1 MB a language. A column with more than LANGUAGES different values is an error, as it names
no languages; what reaches the driver until that is known is bounded too. So whole texts are compared in one pass at any number of dimensions. The norm of a text's
vector, which is the same for all languages, takes n-gram vectors as orthogonal.

Letters are lower-cased; those of a-z stand for themselves, other letters fall into 37 classes by code point, and
anything else is a gap. Null text, or text without a letter, is `und` with score 0, as is any text if nothing can be
learnt. Ties go to the language that sorts first. The score is the share of the best language among positive cosines
(above the mean of all languages, where two or more compete). As it depends on the number of languages, it cannot tell
text from junk. The fit can: what a text's n-grams give on average towards its language's prototype, as a share of what
those of the language's own texts give. Where unrelated n-grams reach the cosine by chance, the fit is the cosine itself, as
a share of that of as many distinct n-grams, so that a repeated n-gram proves nothing.
Very few letters can pass either way: they are too few to judge.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm import words as W
from talentgrid.llm.boxes import boxed, unboxed

DIMENSIONS = 2048
SIZE = 3
CLASSES = 64
UNKNOWN = "und"
SEED = 17
#: The dot product of unrelated unit vectors, times the root of DIMENSIONS, is normal: it passes this by chance once in 30,000.
CHANCE = 4.0
#: Most languages that a model holds.
LANGUAGES = 256
#: Languages whose counts a training task holds before it hands them on.
HELD = 64


def _classes() -> np.ndarray:
    """Class of each code point of the basic plane: 0 no letter, 1 to 26 a-z, 27 to 63 other letters."""
    out = np.zeros(1 << 16, np.uint8)
    for code in range(1 << 16):
        char = chr(code)
        if char.isalpha():
            low = ord(char.lower()[0])
            out[code] = low - 96 if 97 <= low <= 122 else 27 + low % 37
    return out


_table: list[np.ndarray] = []


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Classes of the characters of all texts, each text with a gap before and after, and where each text starts."""
    if not _table:
        _table.append(_classes())
    text = "\n" + "\n".join([("" if t is None else t) for t in column.to_pylist()]) + "\n"
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    out = _table[0][np.minimum(codes, 65535)]
    far = np.flatnonzero(codes > 65535)
    out[far] = [27 + c % 37 if chr(c).isalpha() else 0 for c in codes[far].tolist()]
    sizes = np.array([0 if t is None else len(t) for t in column.to_pylist()])
    return out, np.concatenate([[0], np.cumsum(sizes + 1)])


def grams(classes: np.ndarray, bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams with a letter, gaps squeezed, and where each text's begin."""
    keep = (classes > 0) | np.concatenate([[True], classes[:-1] > 0])
    keep[bounds] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    own, starts = classes[keep].astype(np.int64), at[bounds]
    count = np.maximum(np.diff(starts) + 2 - size, 0)  # a text's letters, its gap before, and the gap after it
    first = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count - starts[:-1], count)
    code, some = np.zeros(len(first), np.int64), np.zeros(len(first), bool)
    for k in range(size):
        code = code * CLASSES + own[first + k]
        some |= own[first + k] > 0
    found = np.concatenate([[0], np.cumsum(some)])
    return code[some], found[np.concatenate([[0], np.cumsum(count)])]


def gram_vectors(codes: np.ndarray, size: int, dimensions: int) -> np.ndarray:
    """The bound, permuted letter vectors of n-gram codes."""
    letter = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (CLASSES, dimensions)).astype(np.int8) * 2 - 1
    out = np.ones((len(codes), dimensions), np.int8)
    for place in range(size):
        own = codes // CLASSES ** (size - 1 - place) % CLASSES
        out *= np.roll(letter, size - 1 - place, axis=1)[own]
    return out


def counts(docs: DataFrame, lang: str, size: int = SIZE) -> DataFrame:
    """(lang, code, n): letter n-grams of all texts by language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def told() -> Iterator[pa.RecordBatch]:
            for name, n in total.items():
                own = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own), pa.array(n[own])], names=["lang", "code", "n"])
            total.clear()

        for x in W.slices(batches):
            codes, bounds = grams(*letters(x.column(1)), size)
            names, which = np.unique(np.array(x.column(0).to_pylist(), object).astype(str), return_inverse=True)
            owner = np.repeat(which, np.diff(bounds))
            for i, name in enumerate(names.tolist()):
                if name not in total and len(total) >= HELD:
                    yield from told()
                own, n = np.unique(codes[owner == i], return_counts=True)
                if name not in total:
                    total[name] = np.zeros(CLASSES**size, np.int64)
                total[name][own] += n
        yield from told()

    rows = docs.where(f"{lang} is not null and text is not null").select(F.col(lang).alias("lang"), "text")
    return rows.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def products(counted: DataFrame, size: int = SIZE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages, and the product of every n-gram's vector with each language's prototype of unit length."""
    return learnt(counted, size, dimensions)[:2]


def learnt(counted: DataFrame, size: int = SIZE, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As `products`, and the average product of the n-grams of each language's own texts."""
    found = prototypes(counted, size, dimensions).limit(LANGUAGES + 1).toArrow().sort_by("lang")
    langs = found.column("lang").to_pylist()
    if len(langs) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages: the column that tells them holds something else")
    if not langs:
        return [], np.zeros((CLASSES**size, 0), np.float32), np.zeros(0)
    proto = np.array(found.column("proto").to_pylist(), np.float32)
    out = np.zeros((CLASSES**size, len(langs)), np.float32)
    for i in range(0, len(out), 4096):
        out[i : i + 4096] = gram_vectors(np.arange(i, min(i + 4096, len(out))), size, dimensions).astype(np.float32) @ proto.T
    return langs, out, found.column("typical").to_numpy()


def prototypes(counted: DataFrame, size: int = SIZE, dimensions: int = DIMENSIONS) -> DataFrame:
    """(lang, proto, typical): each language's prototype of unit length, and the average product of its own n-grams with it."""

    def bundle(own: pa.Table) -> pa.Table:
        own = own.sort_by("code")  # at most CLASSES ** size rows
        code, n = own.column("code").to_numpy(), own.column("n").to_numpy()
        weight = n / n.sum()
        proto, mean = np.zeros(dimensions, np.float32), 0.0
        for i in range(0, len(code), 4096):
            proto += np.sqrt(weight[i : i + 4096]).astype(np.float32) @ gram_vectors(code[i : i + 4096], size, dimensions).astype(np.float32)
        proto /= max(float(np.linalg.norm(proto)), 1e-9)
        for i in range(0, len(code), 4096):
            mean += float(weight[i : i + 4096] @ (gram_vectors(code[i : i + 4096], size, dimensions).astype(np.float32) @ proto))
        return pa.table({"lang": own.column("lang").slice(0, 1), "proto": pa.array([proto], pa.list_(pa.float32())), "typical": pa.array([mean])})

    return counted.groupBy("lang").applyInArrow(bundle, "lang string, proto array<float>, typical double")


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, size: int = SIZE, dimensions: int = DIMENSIONS, typical: np.ndarray | None = None) -> DataFrame:
    """(row, doc_id, text, lang_pred, score) of every row; `row` holds its other columns, score is 0 to 1.

    With `typical`, the average products of the languages' own texts, also `fit`.
    """
    rows = boxed(docs)
    told = docs.sparkSession.sparkContext.broadcast(table)

    def guess(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in W.slices(batches):
            codes, bounds = grams(*letters(x.column(2)), size)
            sizes = np.diff(bounds)
            dots = np.zeros((len(sizes), len(langs)))
            full = np.flatnonzero(sizes)
            if len(full) and langs:
                for k in range(len(langs)):
                    dots[full, k] = np.add.reduceat(told.value[codes, k].astype(np.float64), bounds[:-1][full])
            own = np.sort(codes + np.repeat(np.arange(len(sizes)), sizes) * CLASSES**size)
            new = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            times = np.diff(new, append=len(own)).astype(np.float64)
            norm = np.sqrt(dimensions * np.bincount(own[new] // CLASSES**size, times**2, len(sizes)))
            cosine = dots / np.maximum(norm, 1e-9)[:, None]
            best = cosine.argmax(1) if langs else np.zeros(len(sizes), np.int64)
            above = np.maximum(cosine - (cosine.mean(1, keepdims=True) if len(langs) > 1 else 0), 0)
            score = np.clip(above.max(1) / np.maximum(above.sum(1), 1e-12), 0, 1) if langs else np.zeros(len(sizes))
            known = (sizes > 0) & bool(langs)
            pred = [langs[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)]
            columns, names = [*x.columns, pa.array(pred, pa.string()), pa.array(np.where(known, score, 0.0))], ["row", "doc_id", "text", "lang_pred", "score"]
            if typical is not None:
                mean = dots.max(1) / np.maximum(sizes, 1) if langs else np.zeros(len(sizes))
                beyond = cosine.max(1) * np.sqrt(dimensions) if langs else mean
                mean = np.where(beyond >= CHANCE, mean, np.minimum(beyond / np.sqrt(np.maximum(sizes, 1)), mean))
                columns.append(pa.array(np.where(known, mean / np.maximum(typical[best], 1e-9) if langs else 0.0, 0.0)))
                names.append("fit")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    told_of = [F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("fit")]
    schema = rows.select("*", *told_of[: 2 if typical is None else 3]).schema
    return rows.mapInArrow(guess, schema)


def identified(docs: DataFrame, lang: str = "lang", least: float = 0.3) -> DataFrame:
    """The rows of `docs` whose language can be told, all columns unchanged: not `und`, and a fit of at least `least`.

    Learns from all rows whose column `lang` is known. Where there is none, nothing can be judged and all rows stay.
    """
    langs, table, typical = learnt(counts(docs, lang))
    if not langs:
        return docs
    found = predict(docs, langs, table, typical=typical)
    return unboxed(found.where((F.col("lang_pred") != UNKNOWN) & (F.col("fit") >= least)), docs.columns)
