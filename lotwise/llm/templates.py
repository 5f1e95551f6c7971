"""Benchmark decontamination by canonical templates.

Words are lower-cased; numbers, the units after them and names become typed
placeholders with the value kept beside. Windows of a template are hashed and
met with those of the benchmark by an equi-join. A question that was given other
numbers and names has the same windows; it counts if its values are put in
consistently: where one value of the item stands for two in the document, the
windows with the rarer one do not count, but those with the item's own values do.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import mix64, passengers, pieces
from lotwise.sources.workspace import materialize

#: Tokens of a window, and how many of them must be plain words for it to ask for anything.
WINDOW = 8
PLAIN = 5
#: Least share of an item's windows that a document has.
COVERAGE = 0.5
#: Bits of the filter that keeps most windows of the corpus out of the shuffle: its
#: size is fixed, and a benchmark too large for it only lets more windows through.
FILTER_BITS = 22
PIECE = 4 << 20

#: Units that are a slot after a number.
UNITS = frozenset(
    "mm cm m km in ft yd mi inch inches foot feet yard yards mile miles meter meters metre metres mg g kg lb lbs oz "
    "gram grams kilogram kilograms pound pounds ounce ounces ml l liter liters litre litres gallon gallons second seconds "
    "minute minutes hour hours day days week weeks month months year years percent dollar dollars euro euros cent cents "
    "degree degrees mph kph kmh hz khz mhz w kw kwh v mb gb tb".split()
)
#: Letters of scripts without spaces between words, from Thai to kana and Chinese: each is a token.
_UNSPACED = (
    "\u0e00-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u318f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f"
    "\U00020000-\U0003ffff"
)
_TOKEN = re.compile(rf"\d+(?:[.,]\d+)*|(?=[^\W\d_])[{_UNSPACED}]|[^\W\d_{_UNSPACED}]+")
_SENTENCE = re.compile(r"[.!?]+(?!\w)|\n+")
NUMBER, UNIT, NAME = 1, 2, 3


class Vocabulary(dict):
    """Numbers of tokens, each with its hash; learnt as they come."""

    def __init__(self):
        import xxhash

        super().__init__()
        self._digest = xxhash.xxh3_64_intdigest
        self._new: tuple[list[int], list[int], list[bool]] = ([], [], [])
        self._known = np.zeros(0, np.int8), np.zeros(0, np.uint64), np.zeros(0, bool)

    def __missing__(self, token: str) -> int:
        kind, lower = 0, token.lower()
        if token[0].isdigit():
            kind = NUMBER
        elif len(token) > 1 and token[0].isupper() and token[1:].islower():
            kind = NAME
        at = self[token] = len(self)
        kinds, hashes, units = self._new
        kinds.append(kind)
        hashes.append(self._digest(lower.encode()))
        units.append(lower in UNITS)
        return at

    def facts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds, hashes and whether it is a unit, by a token's number; only those learnt since the last call are added."""
        if self._new[0]:
            self._known = tuple(np.concatenate([old, np.array(new, old.dtype)]) for old, new in zip(self._known, self._new))
            self._new = ([], [], [])
        return self._known


def canonical(text: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Values, kinds and hashes of the template's tokens; a run of names is one token."""
    known = Vocabulary()
    tokens, kinds, hashes, _ = _tokens([text], known)[0]
    return tokens, kinds, hashes


_SLOT_HASH = mix64(np.array([0, 101, 102, 103], np.uint64))


def _tokens(texts: list[str], known: Vocabulary):
    """For each text the tokens, kinds and template hashes, and (tokens, kinds, hashes) of its words as they are."""
    cut = []
    for text in texts:
        tokens: list[str] = []
        first: list[int] = []
        for sentence in _SENTENCE.split(text):
            found = _TOKEN.findall(sentence)
            if found:
                first.append(len(tokens))
                tokens += found
        cut.append((tokens, first, np.fromiter(map(known.__getitem__, tokens), np.int64, len(tokens))))
    kind_of, hash_of, unit_of = known.facts()
    out = []
    for tokens, first, code in cut:
        if not tokens:
            none = [], np.zeros(0, np.int8), np.zeros(0, np.uint64)
            out.append((*none, none))
            continue
        kinds = kind_of[code].copy()
        # The first word of a sentence is in capitals anyway.
        start = np.array(first)
        kinds[start[kinds[start] == NAME]] = 0
        kinds[1:][(kinds[:-1] == NUMBER) & unit_of[code[1:]]] = UNIT
        hashes = np.where(kinds > 0, _SLOT_HASH[kinds], hash_of[code])
        plain = tokens, kinds, hash_of[code]
        inner = np.zeros(len(kinds), bool)
        inner[1:] = (kinds[1:] == NAME) & (kinds[:-1] == NAME)
        inner[start] = False
        if inner.any():
            keep = np.flatnonzero(~inner)
            ends = np.append(keep[1:], len(tokens))
            tokens = [" ".join(tokens[a:b]) for a, b in zip(keep, ends)]
            kinds, hashes = kinds[keep], hashes[keep]
        out.append((tokens, kinds, hashes, plain))
    return out


def windows(kinds: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the windows with enough plain words."""
    n = len(kinds) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + n]
    sums = np.concatenate(([0], np.cumsum(kinds == 0)))
    at = np.flatnonzero(sums[WINDOW:] - sums[:-WINDOW] >= PLAIN)
    return at, mix64(h[at])


def spans(hashes: np.ndarray, length: int, exact: bool) -> np.ndarray:
    """Hashes of all runs of ``length`` tokens, which no window's and no other length's are."""
    n = len(hashes) - length + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    # Halves are joined, so a run costs as many steps as its length has bits.
    h, have, done = hashes, 1, np.zeros(n, np.uint64)
    at, left = 0, length
    while left:
        if left & 1:
            done = mix64(done * np.uint64(0x9E3779B97F4A7C15) + h[at : at + n])
            at += have
        left >>= 1
        if left:
            h = mix64(h[: len(h) - have] * np.uint64(0x9E3779B97F4A7C15) + h[have:])
            have *= 2
    return mix64(done ^ np.uint64(2 * length + exact))


def whole(kinds: np.ndarray, hashes: np.ndarray, plain: np.ndarray) -> list[tuple[int, bool]]:
    """How an item without windows is looked for: (length, whether values must be equal).

    Always word for word; by its template as well if as much of it is plain
    words as a window must have.
    """
    if not len(plain) or len(windows(kinds, hashes)[0]):
        return []
    words = int((kinds == 0).sum())
    loose = words >= PLAIN and words * WINDOW >= PLAIN * len(kinds)
    return [(len(plain), True), *([(len(kinds), False)] if loose else [])]


def _rows(rows: DataFrame, key_type: str, bits: np.ndarray | None, lengths: list[tuple[int, bool]] | None = None) -> DataFrame:
    """Windows (key, row, h, at, windows, slots, length, exact) of rows (key, row, text); with ``bits`` only those it lets through.

    Runs of ``lengths`` are windows as well, and without ``lengths`` an item
    that has no window is one, with its length. Slots of an exact run are null in documents.
    """
    shared = None if bits is None else rows.sparkSession.sparkContext.broadcast(np.packbits(bits))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = None if shared is None else np.unpackbits(shared.value).astype(bool)
        known = Vocabulary()
        for batch in pieces(batches, PIECE):
            if len(known) > 500_000:
                known = Vocabulary()
            which, found, places, counts, slots, sizes, exacts = [], [], [], [], [], [], []
            for n, (tokens, kinds, hashes, plain) in enumerate(_tokens([t or "" for t in batch.column("text").to_pylist()], known)):
                at, h = windows(kinds, hashes)
                total = len(at)
                if filter_ is not None and total:
                    passed = filter_[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)]
                    at, h = at[passed], h[passed]
                for a, x in zip(at.tolist(), h.astype(np.int64).tolist()):
                    which.append(n)
                    found.append(x)
                    places.append(a)
                    counts.append(total)
                    slots.append([tokens[i].lower() for i in range(a, a + WINDOW) if kinds[i]])
                    sizes.append(0)
                    exacts.append(False)
                for length, exact in whole(kinds, hashes, plain[2]) if lengths is None else lengths:
                    words, kind, h = plain if exact else (tokens, kinds, hashes)
                    h = spans(h, length, exact)
                    at = np.arange(len(h))
                    if filter_ is not None and len(h):
                        at = np.flatnonzero(filter_[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
                        if exact:  # the first is like any other
                            at = at[np.unique(h[at], return_index=True)[1]]
                    for a, x in zip(at.tolist(), h[at].astype(np.int64).tolist()):
                        which.append(n)
                        found.append(x)
                        places.append(a)
                        counts.append(1)
                        known_by_item = exact and filter_ is not None
                        slots.append(None if known_by_item else [words[i].lower() for i in range(a, a + length) if kind[i]])
                        sizes.append(length)
                        exacts.append(exact)
            taken = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key").take(taken), batch.column("row").take(taken), pa.array(found, pa.int64()),
                    pa.array(places, pa.int64()), pa.array(counts, pa.int64()), pa.array(slots, pa.list_(pa.string())),
                    pa.array(sizes, pa.int64()), pa.array(exacts, pa.bool_()),
                ],
                names=["key", "row", "h", "at", "windows", "slots", "length", "exact"],
            )

    return rows.mapInArrow(
        work, f"key {key_type}, row long, h long, at long, windows long, slots array<string>, length long, exact boolean"
    )


def matches(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", question: str = "text"
) -> DataFrame:
    """Rows (doc_id, row, item_id, n_windows, item_windows, coverage, n_slots, n_changed) of contaminated documents.

    ``row`` is a hash of the text: it tells rows with one id apart. Windows are
    counted by the distance between their places in the document and the item.
    One counts if its values are the item's, or each is the one that most windows
    at that distance have. ``n_changed`` of ``n_slots`` values differ somewhere, so 0
    is a verbatim copy. An item without a window of enough plain words is one window
    as a whole: word for word, and by its template where plain words are enough. So
    an item of one word is met wherever the word stands. Null and empty texts, texts
    without a letter or digit and empty tables match nothing; of repeated items each
    id is reported.
    """
    kind_of = {f.name: f.dataType.simpleString() for f in (*benchmark.schema, *docs.schema)}
    asked = _rows(
        benchmark.select(F.col(item).alias("key"), F.xxhash64(question).alias("row"), F.col(question).alias("text")),
        benchmark.schema[item].dataType.simpleString(), None,
    ).select(F.col("key").alias("item_id"), "h", F.col("at").alias("item_at"), F.col("windows").alias("item_windows"), F.col("slots").alias("item_slots"), "length", "exact").distinct()
    # As many as items without windows have different lengths.
    lengths = [(r.length, r.exact) for r in asked.where(F.col("length") > 0).select("length", "exact").distinct().collect()]
    asked = asked.drop("length", "exact")
    # At most 2 ** FILTER_BITS numbers, whatever the benchmark's size.
    places = asked.select(F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int").alias("place")).distinct().toPandas()["place"]
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[places.to_numpy(np.int64)] = True
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    found = _rows(rows, kind_of[key], bits, lengths).drop("length", "exact").distinct()
    met = found.join(asked, "h").withColumn("slots", F.coalesce("slots", "item_slots"))
    pair = F.explode_outer(F.array_distinct(F.arrays_zip("item_slots", "slots"))).alias("pair")
    by_shift = ["key", "row", "item_id", "shift"]
    # Read twice below: written, so that the corpus is gone through once.
    met = materialize(met.withColumn("shift", F.col("at") - F.col("item_at")), "met")
    votes = met.select(*by_shift, pair).where(F.col("pair").isNotNull()).groupBy(
        *by_shift, F.col("pair.item_slots").alias("given"), F.col("pair.slots").alias("put")
    ).agg(F.count(F.lit(1)).alias("n"))
    # Of values that equally many windows have, the unchanged one, then the first.
    rank = F.struct(-F.col("n"), F.col("put") != F.col("given"), F.col("put"))
    values = votes.groupBy(*by_shift, "given").agg(
        F.min_by("put", rank).alias("value"), F.max(F.col("put") != F.col("given")).alias("changed")
    )
    # As many entries as the item has different values.
    consistency = values.groupBy(*by_shift).agg(
        F.map_from_entries(F.collect_list(F.struct("given", "value"))).alias("stands"),
        F.count(F.lit(1)).alias("n_slots"), F.count(F.when(F.col("changed"), 1)).alias("n_changed"),
    )
    null_safe = None
    for name in by_shift:
        equal = F.col(f"c.{name}").eqNullSafe(F.col(f"v.{name}"))
        null_safe = equal if null_safe is None else null_safe & equal
    consistent = F.forall(F.arrays_zip("item_slots", "slots"), lambda x: F.col("v.stands")[x["item_slots"]] == x["slots"])
    kept = met.alias("c").join(consistency.alias("v"), null_safe, "left").where(
        (F.col("item_slots") == F.col("slots")) | F.coalesce(consistent, F.lit(True))
    )
    shifts = kept.groupBy(*(f"c.{name}" for name in by_shift)).agg(
        F.count_distinct("item_at").alias("held"), F.max("item_windows").alias("item_windows"),
        F.coalesce(F.first("v.n_slots"), F.lit(0)).alias("n_slots"), F.coalesce(F.first("v.n_changed"), F.lit(0)).alias("n_changed"),
    )
    # A passage that is in a document twice counts once: no more windows than the item has.
    best = F.struct(F.col("held"), -F.col("n_changed"), F.col("n_slots"))
    covered = shifts.groupBy("key", "row", "item_id").agg(
        F.least(F.sum("held"), F.max("item_windows")).alias("n_windows"),
        F.max("item_windows").alias("item_windows"),
        F.max_by("n_slots", best).alias("n_slots"), F.max_by("n_changed", best).alias("n_changed"),
    )
    return covered.withColumn("coverage", F.col("n_windows") / F.col("item_windows")).where(
        F.col("coverage") >= COVERAGE
    ).withColumnRenamed("key", "doc_id")


@passengers()
def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item; other columns may have any name."""
    hit = matches(docs, benchmark, key, text).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row")).distinct()
    same = F.col(f"`{key}`").eqNullSafe(F.col("_id")) & (F.xxhash64(text) == F.col("_row"))
    return docs.join(hit, same, "left_anti")
