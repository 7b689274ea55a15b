"""Benchmark decontamination by template canonicalisation.

Words become slots where a re-parameterised question would differ: a number (any word with a digit, or a number word), a
unit, or a name (capitalised). Everything else is literal: its letters and digits, lower-cased. Capitals are those of code
points below U+0800: Latin with accents, Greek, Cyrillic and Armenian ones too. A number with its unit, attached or apart,
is one slot, and so is a run of number words or of names within a sentence. As capitals also
mark shouted text, a heading or the first word of a sentence, texts are taken in four forms: all words as they are;
numbers and units as slots; also names, but not the first words of sentences; also those.

A template window is a run of `width` canonical words; an item shorter than that is one window as a whole. A window with slots
needs at least half literal words, and an item of SHORTEST words. Windows of words as they are need neither: a verbatim copy
is found whatever its words, and an item of any length if whole. Documents' windows are hash-joined with the items': a
filter of FILTER_BITS over the items' windows, which all tasks hold, passes on few others, and the join in Spark is exact.

Windows that a document and an item share at one alignment of one form belong together. Their slots must be consistent: equal
slot values of the item stand for equal values in the document, and the other way round. Such groups add up over all forms
and over alignments at most `width` words apart, if their slots stay consistent and their words in order. A match
counts if it covers SHARE of the item's words, LITERALS of them literal or in windows of words as they are (or half, in a shorter item). So verbatim
copies are found, and copies with other numbers, names and units, but not a text that merely fills the same form at odds with itself.

Null or empty texts match nothing. Benchmark items with equal text are each reported. Rows that repeat a doc_id are reported
under it; a row without doc_id is checked, and reported without.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from talentgrid.llm import words as W
from talentgrid.llm.boxes import boxed, unboxed
from talentgrid.llm.staging import staged

WIDTH, SHORTEST = 8, 5
SHARE, LITERALS = 0.5, 5
#: Bits of the filter over items' windows (8 MB). More windows make it pass more, never less.
FILTER_BITS = 1 << 26

#: Units of measure and money.
UNITS = (
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters "
    "mg g kg lb lbs oz gram grams kilogram kilograms pound pounds ounce ounces ton tons tonne tonnes ml cl l liter liters litre litres gallon gallons "
    "s sec min h hr hrs second seconds minute minutes hour hours day days week weeks month months year years ms mph kmh kph "
    "w kw kwh j kj v volt volts watt watts hz khz mhz ghz b kb mb gb tb pa kpa bar k c f degrees degree percent "
    "usd eur gbp dollar dollars cent cents euro euros pence"
).split()

#: Number words.
NUMBERS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen "
    "twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
).split()

_APART = np.uint64(0x9E3779B97F4A7C15)
_NUMBER, _NAME, _UNIT = np.uint64(0x6E756D6265720001), np.uint64(0x6E616D6500000002), np.uint64(0x756E697400000003)
_CORE = np.zeros(256, bool)
_CORE[48:58] = _CORE[65:91] = _CORE[97:123] = _CORE[128:] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
#: Of each code point below U+0800: whether it is a capital, and its small letter where that also takes two bytes.
_CAPITAL = np.array([chr(i).isupper() for i in range(0x800)])
_SMALL = np.array([ord(low) if len(low := chr(i).lower()) == 1 and 0x80 <= ord(low) < 0x800 else i for i in range(0x800)])
_STOP = np.zeros(256, bool)
_STOP[[10, 33, 46, 58, 63]] = True  # line end ! . : ?


def _hash_of(words: list[str]) -> np.ndarray:
    data, at = W.text_bytes(pa.array([" ".join(words)]))
    return W.hashes(W.split(data, at), lower=True)


_UNIT_HASHES = np.sort(_hash_of(UNITS))
_NUMBER_HASHES = np.sort(_hash_of(NUMBERS))


class Canon(NamedTuple):
    value: np.ndarray  # hash of each word itself
    number: np.ndarray
    spelled: np.ndarray  # a number in words; joined ones (twenty-five) too
    unit: np.ndarray
    capital: np.ndarray  # neither number nor unit
    fresh: np.ndarray  # the first word of a sentence
    of_slot: np.ndarray  # hash of each word as a slot's part; 5km as that of 5 and km together
    bounds: np.ndarray  # first word of each text, and the number of words


def _part(value: np.ndarray, place: np.ndarray) -> np.ndarray:
    return W.mix(value + place.astype(np.uint64) * _APART)


def _spelled(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether each word is a number word, or two joined by a hyphen."""
    out = np.isin(value, _NUMBER_HASHES)
    hyphens = np.concatenate([[0], np.cumsum(data == 45)])
    joined = np.flatnonzero(hyphens[ends] - hyphens[starts] == 1)
    if len(joined):
        cut = np.flatnonzero(data == 45)[hyphens[starts[joined]]]
        none = np.zeros(0, np.int64)
        parts = (W.hashes(W.Words(data, a, b, none), lower=True) for a, b in ((starts[joined], cut), (cut + 1, ends[joined])))
        left, right = (np.isin(x, _NUMBER_HASHES) for x in parts)
        out[joined] |= left & right
    return out


def canonical(column: pa.Array) -> Canon:
    """Words of all texts, and what they are."""
    data, at = W.text_bytes(column)
    if not len(data):
        none, no = np.zeros(0, np.uint64), np.zeros(0, bool)
        return Canon(none, no, no, no, no, no, none, np.zeros(len(at), np.int64))
    upper = _UPPER[data]
    lead = np.flatnonzero((data >= 0xC2) & (data <= 0xDF))  # of letters that take two bytes
    if len(lead):
        point = (data[lead].astype(np.int64) & 0x1F) << 6 | (data[lead + 1] & 0x3F)
        upper[lead] = _CAPITAL[point]
        data, small = data.copy(), _SMALL[point]
        data[lead], data[lead + 1] = 0xC0 | small >> 6, 0x80 | small & 0x3F
    core = _CORE[data]
    white = W.SPACE[data]
    # punctuation inside a word joins its parts (3.5, it's); at its ends it is dropped, and lone marks are no words
    parts = W.split(np.where(white, np.uint8(32), data), at)
    inner = np.concatenate([[0], np.cumsum(core)])
    solid = inner[parts.ends] > inner[parts.starts]
    starts, ends = parts.starts[solid], parts.ends[solid]
    bounds = np.searchsorted(starts, at)
    place = np.flatnonzero(core)
    first = place[inner[starts]]
    last = place[inner[ends] - 1]
    value = W.hashes(W.Words(data, first, last + 1, bounds), lower=True)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[data])])
    spelled = _spelled(data, first, last + 1, value)
    number = (digits[ends] > digits[starts]) | spelled
    unit = np.isin(value, _UNIT_HASHES)
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    fresh = np.ones(len(starts), bool)
    if len(starts) > 1:
        fresh[1:] = stops[starts[1:]] > stops[last[:-1]]
    fresh[bounds[:-1][np.diff(bounds) > 0]] = True
    of_slot = _part(value, np.zeros(len(value)))
    own = np.flatnonzero(number & ~spelled & ~_DIGIT[data[last]])
    if len(own):  # a unit after the last digit
        cut = np.flatnonzero(_DIGIT[data])[digits[ends[own]] - 1] + 1
        none = np.zeros(0, np.int64)
        tail = W.hashes(W.Words(data, cut, last[own] + 1, none), lower=True)
        head = W.hashes(W.Words(data, first[own], cut, none), lower=True)
        known = np.isin(tail, _UNIT_HASHES)
        of_slot[own[known]] = (_part(head, np.zeros(len(own))) + _part(tail, np.ones(len(own))))[known]
    return Canon(value, number, spelled, unit, upper[first] & ~number & ~unit, fresh, of_slot, bounds)


class Form(NamedTuple):
    symbol: np.ndarray  # of each canonical word: its hash, or its kind if a slot
    slot: np.ndarray
    value: np.ndarray  # of the slot
    starts: np.ndarray  # first word
    ends: np.ndarray  # word after the last
    bounds: np.ndarray  # first canonical word of each text, and their number
    wanted: np.ndarray  # the slots that a window needs one of; none for form 0


FORMS = 4
_SALT = np.arange(FORMS, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)


def form_of(c: Canon, form: int) -> Form:
    n = len(c.value)
    if form == 0:
        at, no = np.arange(n), np.zeros(n, bool)
        return Form(c.value, no, c.value, at, at + 1, c.bounds, no)
    name = c.capital & (~c.fresh if form == 2 else True) if form > 1 else np.zeros(n, bool)
    joins = np.zeros(n, bool)
    joins[1:] = ~c.fresh[1:] & ((c.unit[1:] & c.number[:-1]) | (c.spelled[1:] & c.spelled[:-1]) | (name[1:] & name[:-1]))
    starts = np.flatnonzero(~joins)
    ends = np.append(starts[1:], n) if n else starts
    symbol = np.where(c.number, _NUMBER, np.where(c.unit, _UNIT, np.where(name, _NAME, c.value)))[starts]
    place = np.arange(n) - np.repeat(starts, ends - starts)
    parts = np.where(place > 0, _part(c.value, place), c.of_slot)
    value = np.add.reduceat(parts, starts) if n else parts
    slot = (c.number | c.unit | name)[starts]
    return Form(symbol, slot, value, starts, ends, np.searchsorted(starts, c.bounds), name[starts] if form > 1 else slot)


_SLOTS = pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32()), ("v", pa.int64())]))
_WINDOWS = "id long, fp long, win long, form int, width int, tok int, first int, last int, words int, slots array<struct<at:int,n:int,v:long>>"


def _windows(batches: Iterator[pa.RecordBatch], widths: list[tuple[int, int]] | None, width: int, allowed=None) -> Iterator[pa.RecordBatch]:
    """Windows of texts (id, fp, text): those of the given forms and widths, or, for items, of each text's own width."""
    for x in W.slices(batches):
        c = canonical(x.column(2))
        words = np.diff(c.bounds)
        for form in range(FORMS):
            f = form_of(c, form)
            size = np.minimum(np.diff(f.bounds), width)
            fit = size > 0 if form == 0 else words >= SHORTEST
            literal = np.concatenate([[0], np.cumsum(~f.slot)])
            wanted = np.concatenate([[0], np.cumsum(f.wanted)])
            for w in np.unique(size[fit]).tolist() if widths is None else [w for k, w in widths if k == form]:
                start = W.whole(f.bounds, w)
                hashed = W.rolling(f.symbol, w)[start] + (np.uint64(w) ^ _SALT[form])
                text = W.owners(f.bounds)[start]
                keep = np.ones(len(start), bool)
                if form:
                    keep &= (2 * (literal[start + w] - literal[start]) >= w) & (wanted[start + w] > wanted[start])
                if widths is None:
                    keep &= fit[text] & (size[text] == w)
                if allowed is not None:
                    keep &= allowed(hashed)
                keep = np.flatnonzero(keep)
                start, hashed, text = start[keep], hashed[keep], text[keep]
                inner = start[:, None] + np.arange(w)
                here = f.slot[inner] if len(inner) else np.zeros((0, w), bool)
                which, at = np.nonzero(here)
                at = inner[which, at]
                first, last = f.starts[start], f.ends[start + w - 1]
                own = [(f.starts[at] - first[which]).astype(np.int32), (f.ends[at] - f.starts[at]).astype(np.int32), f.value[at].view(np.int64)]
                held = pa.StructArray.from_arrays([pa.array(a) for a in own], fields=list(_SLOTS.value_type))
                slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(here.sum(1))]).astype(np.int32)), held)
                ids, fps = (x.column(i).take(pa.array(text)) for i in (0, 1))
                numbers = (np.full(len(keep), form), np.full(len(keep), w), start - f.bounds[text], first - c.bounds[text], last - c.bounds[text], words[text])
                yield pa.RecordBatch.from_arrays(
                    [ids, fps, pa.array(hashed.view(np.int64)), *(pa.array(a.astype(np.int32)) for a in numbers), slots],
                    names=["id", "fp", "win", "form", "width", "tok", "first", "last", "words", "slots"],
                )


class Group:
    """Windows at one alignment, or several together: item words covered and literal, as bits, slots, and places."""

    def __init__(self):
        self.covered = self.literal = 0
        self.slots: set[tuple[int, int]] = set()
        self.places: set[tuple[int, int]] = set()  # first words of windows: the item's, the document's

    def consistent(self) -> bool:
        return len({o for o, _ in self.slots}) == len({d for _, d in self.slots}) == len(self.slots)

    def with_(self, other: Group) -> Group:
        out = Group()
        out.covered, out.literal = self.covered | other.covered, self.literal | other.literal
        out.slots, out.places = self.slots | other.slots, self.places | other.places
        return out

    def in_order(self) -> bool:
        far = -1
        for _, d in sorted(self.places):
            if d < far:
                return False
            far = d
        return True

    def verdict(self) -> tuple[int, bool, int]:
        return self.covered.bit_count(), all(o == d for o, d in self.slots), -min(d for _, d in self.places)


def best_match(hits: list[dict], words: int, width: int, share: float) -> tuple[int, bool, int] | None:
    """(covered, verbatim, -at) of the best match among an item's windows that a document has, if one counts."""
    groups: dict[tuple[int, int], Group] = {}
    for h in hits:
        g = groups.setdefault((h["form"], h["tok"] - h["i"]), Group())
        mask = ((1 << (h["till"] - h["since"])) - 1) << h["since"]
        g.covered |= mask
        for s in h["own"]:
            mask &= ~(((1 << s["n"]) - 1) << (h["since"] + s["at"]))
        g.literal |= mask
        g.slots |= {(o["v"], d["v"]) for o, d in zip(h["own"], h["slots"], strict=True)}
        g.places.add((h["since"], h["first"]))
    sound = [g for g in groups.values() if g.consistent()]
    shift = {id(g): min(d - i for i, d in g.places) for g in sound}
    sound.sort(key=lambda g: shift[id(g)])
    shifts, best = [shift[id(g)] for g in sound], None

    def judged(g: Group) -> bool:
        nonlocal best
        if g.covered.bit_count() >= share * words and g.literal.bit_count() >= min(LITERALS, -(-words // 2)):
            best = max(best, g.verdict()) if best else g.verdict()
        return bool(best) and best[0] == words and best[1]

    if any([judged(g) for g in sound]):
        return best
    for k, seed in enumerate(sound):
        near = [g for g in sound[bisect_left(shifts, shifts[k] - width) : bisect_right(shifts, shifts[k] + width)] if g is not seed]
        for g in sorted(near, key=lambda g: (abs(shift[id(g)] - shifts[k]), -g.covered.bit_count())):
            if g.covered & ~seed.covered or g.literal & ~seed.literal:
                both = seed.with_(g)
                if both.consistent() and both.in_order():
                    seed = both
        judged(seed)
    return best


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """(doc_id, fp, item_id, covered, words, verbatim, at): documents that hold an item, and where the best match lies.

    covered of the item's `words` words match; verbatim says that its slots have the item's own values; `at` is the
    match's first word in the document. fp is the text's xxhash64. One row for each document and item.
    """
    spark = docs.sparkSession
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("id"), F.lit(0).cast("long").alias("fp"), "text")
    items = staged(items.mapInArrow(lambda batches: _windows(batches, None, width), _WINDOWS), "items")
    widths = sorted((r.form, r.width) for r in items.select("form", "width").distinct().collect())  # at most `width` of each form
    place = F.pmod("win", F.lit(FILTER_BITS))
    bits = items.select(place.alias("p")).selectExpr("p div 32 as at", "shiftleft(1L, cast(p % 32 as int)) as bit").groupBy("at").agg(F.bit_or("bit").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 5, np.uint32)
    table[bits.column("at").to_numpy()] = bits.column("bits").to_numpy().astype(np.uint32)
    told = spark.sparkContext.broadcast(table)

    def allowed(hashed: np.ndarray) -> np.ndarray:
        p = (hashed & np.uint64(FILTER_BITS - 1)).astype(np.int64)
        return (told.value[p >> 5] >> (p & 31).astype(np.uint32)) & 1 == 1

    texts = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("fp"), "text")
    found = texts.mapInArrow(lambda batches: _windows(batches, widths, width, allowed), _WINDOWS)
    mine = items.select("win", F.col("id").alias("item_id"), F.col("tok").alias("i"), F.col("first").alias("since"), F.col("last").alias("till"), "words", F.col("slots").alias("own"))
    both = found.select("id", "fp", "win", "form", "tok", "first", "slots").join(mine, "win")
    hit = F.struct("form", "tok", "first", "slots", "i", "since", "till", "own")
    hits = both.groupBy("id", "fp", "item_id", "words").agg(F.collect_set(hit).alias("hits"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            match = [best_match(x.column(4)[k].as_py(), x.column(3)[k].as_py(), width, share) for k in range(x.num_rows)]
            kept = [k for k, m in enumerate(match) if m]
            doc, fp, item, words = (x.column(c).take(pa.array(kept, pa.int64())) for c in range(4))
            covered, verbatim, at = ([match[k][c] for k in kept] for c in range(3))
            columns = [doc, fp, item, pa.array(covered, pa.int32()), words, pa.array(verbatim, pa.bool_()), pa.array([-a for a in at], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "fp", "item_id", "covered", "words", "verbatim", "at"])

    return hits.mapInArrow(judge, "doc_id long, fp long, item_id long, covered int, words int, verbatim boolean, at int")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, all columns unchanged."""
    bad = leaks(docs, benchmark).select(F.col("doc_id").alias("id"), F.col("fp").alias("key")).distinct()
    rows = boxed(docs).withColumn("fp", F.xxhash64("text"))
    return unboxed(rows.join(bad, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("fp") == F.col("key")), "left_anti"), docs.columns)
