"""Benchmark decontamination by template canonicalisation.

1. *Template*: a text's words, lower-cased and without the punctuation around them, where a number, in digits or as a word, becomes
   ``<num>``, a unit of measure after a number ``<unit>`` and a capitalised word inside a sentence ``<name>``
   (words in capitals throughout are not names).  Up to ``NAME_RUN`` capitalised words in a row are one name; more are a title, whose
   words stay.  The first word of a sentence is a name if it stands capitalised inside another sentence of the text, and nowhere in small
   letters.  Re-parameterised questions have one template.
2. *Window join*: every run of ``WINDOW`` template words, and of ``SHORT``, is hashed and joined, by hash, with the windows of all
   benchmark items (an item that is shorter is one window of its own length); a run with fewer than ``LITERALS`` words other than
   placeholders is hashed by its plain words instead.  As a document may tell more of its sentences' first words than an item does, an
   item has windows with these typed by its own text, none of them and all of them.  Before the join a bit field of fixed size, in which the
   benchmark's windows are marked, lets only promising windows out of the scan of the documents.
3. *Alignment*: the windows that a document shares with an item at one shift, or at shifts that differ by ``SLACK`` at
   most (words put in or left out), are counted: together they must cover ``COVERAGE`` of the item's words, or hold
   ``RUN`` words in a row, the same in both, at one shift.
4. *Slot consistency*: over the covered words each value of a slot in the item must stand for one value in
   the document throughout; an alignment that breaks this at more than ``BROKEN`` of its slots is none.

Null and empty texts and items without ``LEAST`` words never match.
Repeated rows are found each; several alignments with one item count once, the best one.  Items that
repeat an item_id are items of their own, of which the best match is told.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bazaar.llm.common import bounded, fresh, in_batches, stored

WINDOW = 8
SHORT = 6
LITERALS = 4
LEAST = 4
NAME_RUN = 3
COVERAGE = 0.5
SLACK = 8
RUN = 13
BROKEN = 0.1
#: Bits of the field that marks the benchmark's windows; it is this large whatever the benchmark's size.
FIELD_BITS = 22
#: Benchmark windows (two numbers each) up to which they are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 200_000

_WORD = re.compile(r"\S+")
_NUMBER = re.compile(r"[€£¥]?\d[\d.,:/]*(?:st|nd|rd|th)?")
_EDGE = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”‘’–—…¿¡"
_ENDS = (".", "!", "?", ":", "\"", "”")
#: Units of measure.
UNITS = frozenset("""
mm cm m km inch inches foot feet yard yards mile miles metre metres meter meters kilometre kilometres kilometer kilometers
mg g kg ton tons tonne tonnes gram grams kilogram kilograms ounce ounces pound pounds lb lbs oz
ml l litre litres liter liters gallon gallons pint pints cup cups
second seconds minute minutes hour hours day days week weeks month months year years s min h ms
mph kph km/h m/s degree degrees celsius fahrenheit kelvin percent
dollar dollars cent cents euro euros pence rupee rupees yen usd eur gbp inr
watt watts kw kwh volt volts amp amps joule joules newton newtons hz khz mhz ghz bit bits byte bytes kb mb gb tb
""".split())


#: Numbers as words (one is left out: it is a pronoun as well), in English, German, French and Spanish.
NUMBER_WORDS = frozenset("""
two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty
forty fifty sixty seventy eighty ninety hundred thousand million billion
zwei drei vier fünf sechs sieben acht neun zehn elf zwölf zwanzig dreißig vierzig fünfzig hundert tausend
deux trois quatre cinq six sept huit neuf dix onze douze vingt trente quarante cinquante cent mille
dos tres cuatro cinco seis siete ocho nueve diez once doce veinte treinta cuarenta cincuenta cien mil
""".split())


def template(text: str | None, starts: str = "text") -> tuple[list[str], list[str]]:
    """(template words, plain words) of a text, in step.  ``starts``: which capitalised first words of sentences are names: those
    that the ``text`` tells of, ``none`` or ``all``."""
    return _template((text or "").split(), starts)


def _template(raw: list[str], which: str = "text") -> tuple[list[str], list[str]]:
    words, plain, starts, after_number = [], [], True, False
    capitals: list[tuple[int, bool, bool]] = []  # place, at a sentence's start, nothing after it but white space
    for token in raw:
        core = token.strip(_EDGE)
        if not core:
            starts = starts or token.endswith(_ENDS)
            continue
        low = core.lower()
        first = core[0]
        number = first in "0123456789€£¥" and bool(_NUMBER.fullmatch(core)) or low in NUMBER_WORDS
        if number:
            words.append("<num>")
        elif after_number and low in UNITS:
            words.append("<unit>")
        else:
            words.append(low)
            if first != low[0] and not core[1:].isupper():
                capitals.append((len(plain), starts, token[-1] == core[-1]))
        plain.append(low)
        after_number = number
        starts = token.endswith(_ENDS)
    return _with_names(words, plain, capitals, which) if capitals else (words, plain)


def _with_names(words, plain, capitals, which: str) -> tuple[list[str], list[str]]:
    if which == "text":
        inside = {plain[i] for i, start, _ in capitals if not start}
        told = {i for i, start, _ in capitals if start and plain[i] in inside}
        if told:
            at = {i for i, _, _ in capitals}
            small = inside.intersection(w for k, w in enumerate(words) if k not in at)
            told = {i for i in told if plain[i] not in small}
    else:
        told = {i for i, start, _ in capitals if start and which == "all"}
    runs: list[list[int]] = []
    open_ = False
    for i, start, ends_open in capitals:
        if start and i not in told:
            open_ = False
        elif open_ and runs[-1][1] == i and not start:
            runs[-1][1], open_ = i + 1, ends_open
        else:
            runs.append([i, i + 1])
            open_ = ends_open
    for a, b in reversed(runs):
        if b - a == 1:
            words[a] = "<name>"
        elif b - a <= NAME_RUN:
            words[a:b], plain[a:b] = ["<name>"], [" ".join(plain[a:b])]
    return words, plain


_PLACEHOLDERS = ("<num>", "<unit>", "<name>")
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _windows(hashes: np.ndarray, size: int) -> np.ndarray:
    n = len(hashes) - size + 1
    with np.errstate(over="ignore"):
        total = np.full(n, np.uint64(size))
        for i in range(size):
            total = (total ^ hashes[i:i + n]) * _FACTOR
            total ^= total >> np.uint64(29)
    return total


def window_hashes(hashes: np.ndarray, literal: np.ndarray, plain: Callable[[], np.ndarray], size: int) -> np.ndarray:
    """The hash of each window of ``size`` words: of its template words, or of its plain words (asked for only then) where too few
    are literal."""
    if len(hashes) < size:
        return np.empty(0, np.uint64)
    total, sums = _windows(hashes, size), np.r_[0, np.cumsum(literal)]
    few = sums[size:] - sums[:-size] < min(LITERALS, size)
    return np.where(few, ~_windows(plain(), size), total) if few.any() else total


class Hashed:
    """Template words of texts as hashes; those of words are remembered, up to a bound."""

    def __init__(self, bound: int = 300_000):
        self.known: dict[str, int] = {}
        self.bound = bound
        self.slots = self._of(list(_PLACEHOLDERS)).tolist()

    def _of(self, words: list[str]) -> np.ndarray:
        import xxhash

        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def __call__(self, words: list[str], plain: list[str]) -> tuple[np.ndarray, np.ndarray, Callable[[], np.ndarray]]:
        """Hashes of template words, whether they are literal, and what gives the hashes of plain words."""
        if len(self.known) > self.bound:
            self.known.clear()
        h = self._of(words)
        literal = np.ones(len(h), bool)
        for slot in self.slots:
            literal &= h != slot

        @lru_cache(maxsize=1)
        def of_plain():
            same, given = h.copy(), np.flatnonzero(~literal)
            same[given] = self._of([plain[i] for i in given.tolist()])
            return same

        return h, literal, of_plain


def item_windows(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, n_words, size, pos, h, slots, plain): one row for each window of each item."""
    def each(batches):
        hashed = Hashed()
        for batch in batches:
            rows = {k: [] for k in ("item", "item_id", "n_words", "size", "pos", "h", "slots", "plain")}
            for item, item_id, text in zip(*(c.to_pylist() for c in batch.columns)):
                long = len(template(text)[0])
                if long < LEAST:
                    continue
                seen = set()
                for starts in ("text", "none", "all"):
                    words, plain = template(text, starts)
                    own = hashed(words, plain)
                    for size in sorted({min(WINDOW, len(words)), min(SHORT, len(words))}):
                        for pos, one in enumerate(window_hashes(*own, size).view(np.int64).tolist()):
                            if (size, pos, one) in seen:
                                continue
                            seen.add((size, pos, one))
                            rows["item"].append(item)
                            rows["item_id"].append(item_id)
                            rows["n_words"].append(long)
                            rows["size"].append(size)
                            rows["pos"].append(pos)
                            rows["h"].append(one)
                            rows["slots"].append([i for i in range(pos, pos + size) if words[i] in _PLACEHOLDERS])
                            rows["plain"].append([plain[i] for i in range(pos, pos + size) if words[i] in _PLACEHOLDERS])
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([
                ("item", pa.int64()), ("item_id", batch.column(1).type), ("n_words", pa.int32()), ("size", pa.int32()),
                ("pos", pa.int32()), ("h", pa.int64()), ("slots", pa.list_(pa.int32())), ("plain", pa.list_(pa.string()))]))

    kind = dict(benchmark.dtypes)["item_id"]
    items = benchmark.select(F.xxhash64("item_id", "text").alias("item"), "item_id", "text").dropDuplicates(["item"])
    return in_batches(items, each, f"item long, item_id {kind}, n_words int, size int, pos int, h long, "
                                   "slots array<int>, plain array<string>")


def document_windows(documents: DataFrame, sizes: list[int], marked: bytes) -> DataFrame:
    """(doc_id, row, size, pos, h, plain) of windows whose bit is set in the field ``marked``."""
    sent = documents.sparkSession.sparkContext.broadcast(marked)

    def each(batches):
        field, hashed = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").astype(bool), Hashed()
        for batch in batches:
            of, size_, pos, h_, plain_ = [], [], [], [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                words, plain = template(text)
                if len(words) < min(sizes):
                    continue
                own = hashed(words, plain)
                for size in sizes:
                    h = window_hashes(*own, size)
                    hit = np.flatnonzero(field[(h >> np.uint64(64 - FIELD_BITS)).astype(np.int64)])
                    for p, one in zip(hit.tolist(), h[hit].view(np.int64).tolist()):
                        of.append(i)
                        size_.append(size)
                        pos.append(p)
                        h_.append(one)
                        plain_.append([plain[j] for j in range(p, p + size) if words[j] in _PLACEHOLDERS])
            at = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(size_, pa.int32()), pa.array(pos, pa.int32()),
                 pa.array(h_, pa.int64()), pa.array(plain_, pa.list_(pa.string()))],
                names=["doc_id", "row", "d_size", "d_pos", "d_h", "d_plain"])

    rows = documents.select("doc_id", F.xxhash64("text").alias("row"), "text")
    return in_batches(rows, each, f"doc_id {dict(documents.dtypes)['doc_id']}, row long, d_size int, d_pos int, d_h long, "
                                  "d_plain array<string>")


def leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, row, item_id, coverage, n_slots, first_word, n_words): documents that hold a benchmark item.

    ``row`` is the hash of the text, ``first_word`` the place in the document's words where the item starts.
    """
    windows = stored(item_windows(benchmark), "item-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # WINDOW values at most
    slot = F.shiftrightunsigned("h", 64 - FIELD_BITS).alias("bit")
    field = np.zeros(1 << FIELD_BITS, bool)
    for r in windows.select(slot).distinct().toLocalIterator():  # not more than the field has bits
        field[r[0]] = True
    found = document_windows(documents, sizes or [WINDOW], np.packbits(field, bitorder="little").tobytes())
    known = F.broadcast(windows) if bounded(windows, BROADCAST_ROWS) else windows
    hits = stored(found.join(known, (F.col("d_h") == F.col("h")) & (F.col("d_size") == F.col("size")))
                  .withColumn("shift", F.col("d_pos") - F.col("pos")), "window-hits")
    # Each shift by itself, and shifts in two rows of cells, of which one holds any shifts that differ by SLACK at most.
    cell = lambda name, value: F.struct(F.lit(name).alias("kind"), value.cast("int").alias("at"))
    hits = hits.withColumn("region", F.explode(F.array(
        cell("shift", F.col("shift")), cell("even", F.floor(F.col("shift") / (2 * SLACK + 2))),
        cell("odd", F.floor((F.col("shift") + SLACK + 1) / (2 * SLACK + 2))))))
    own = ["doc_id", "row", "item", "item_id", "n_words", "region"]

    # Words covered: a window adds what the ones before it did not reach.
    window = F.struct("pos", "size")
    at = hits.groupBy(*own).agg(
        F.sort_array(F.collect_set(window)).alias("at"), F.min("shift").alias("shift"),
        F.sort_array(F.collect_set(F.when((F.col("region.kind") == "shift") & (F.col("plain") == F.col("d_plain")), window))).alias("exact"))
    covered = F.aggregate(
        "at", F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, p: F.struct((a["n"] + F.greatest(p["pos"] + p["size"] - F.greatest(p["pos"], a["end"]), F.lit(0))).alias("n"),
                              F.greatest(a["end"], p["pos"] + p["size"]).alias("end")),
        lambda a: a["n"])
    run = F.aggregate(
        "exact", F.struct(F.lit(0).alias("from"), F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, p: F.struct(
            F.when(p["pos"] <= a["end"], a["from"]).otherwise(p["pos"]).alias("from"),
            F.greatest(a["end"], p["pos"] + p["size"]).alias("end"),
            F.greatest(a["n"], F.greatest(a["end"], p["pos"] + p["size"]) - F.when(p["pos"] <= a["end"], a["from"]).otherwise(p["pos"])).alias("n")),
        lambda a: a["n"])
    enough = at.withColumn("coverage", F.least(covered / F.col("n_words"), F.lit(1.0))).withColumn("run", run) \
        .where((F.col("coverage") >= COVERAGE) | (F.col("run") >= RUN)).drop("at", "exact")

    # Slots: each value of the item must stand for one value of the document.
    pair = F.explode(F.arrays_zip("slots", "plain", "d_plain")).alias("s")
    values = (hits.select(*own, pair).select(*own, F.col("s.slots").alias("slot"), F.col("s.plain").alias("value"),
                                             F.col("s.d_plain").alias("given")).distinct())
    kept = values.groupBy(*own, "value", "given").agg(F.count("*").alias("n")) \
        .groupBy(*own, "value").agg(F.sum("n").alias("n"), F.max("n").alias("same")) \
        .groupBy(*own).agg(F.sum("n").alias("n_slots"), F.sum("same").alias("n_same"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("doc_id", "row", "item", "region")]
    checked = enough.alias("a").join(kept.alias("b"), same, "left") \
        .select("a.*", F.coalesce("b.n_slots", F.lit(0)).alias("n_slots"), F.coalesce("b.n_same", F.lit(0)).alias("n_same")) \
        .where((F.col("n_slots") - F.col("n_same") <= BROKEN * F.col("n_slots")) | (F.col("run") >= RUN))
    best = F.struct(F.col("coverage"), (F.col("region.kind") == "shift").alias("alone"), (-F.col("shift")).alias("back"), F.col("n_slots"), F.col("n_words"))
    return checked.groupBy("doc_id", "row", "item_id").agg(F.max(best).alias("m")).select(
        "doc_id", "row", "item_id", "m.coverage", F.col("m.n_slots").cast("long").alias("n_slots"),
        (-F.col("m.back")).alias("first_word"), "m.n_words")


def clean(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``documents`` without the rows that hold a benchmark item."""
    some_id, held_hash, own_hash = (fresh(documents, c) for c in ("_id", "_held", "_text_hash"))
    held = leaks(documents, benchmark).select(F.col("doc_id").alias(some_id), F.col("row").alias(held_hash)).distinct()
    rows = documents.withColumn(own_hash, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(some_id)) & (F.col(own_hash) == F.col(held_hash))
    return rows.join(held, same, "left_anti").select(*(F.col(f"`{c}`") for c in documents.columns))
