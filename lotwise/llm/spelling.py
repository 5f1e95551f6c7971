"""Spelling variants: words that differ by one letter, grouped under the frequent one.

Words are dealt into blocks by length and by how many of their letters fall in
each of four classes. One edit changes the length by at most one and moves at
most one letter between classes, so a word's near words are in its own block or
in few others. Two blocks are compared by one product of their letter counts: it
gives the squared distance of any two words, and an edited letter makes that 1 (in
words of adjacent lengths) or 2 (of equal length). Pairs at most that far are then
verified letter by letter.

Blocks are cut into chunks of at most about ``CHUNK`` words, and pairs of chunks
are dealt to tasks, so no task holds a large block. Words are compared with each
word of the adjoining blocks: that is the method, so its work grows with the
square of the vocabulary, which grows more slowly than the text. Nothing but
verified pairs leaves a task.

Null texts have no words, a null id counts as empty text, repeated rows count
each time. Very long words are words like any other. Columns besides the two named
are not read, so their names do not matter.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import LOWER
from lotwise.sources.workspace import materialize

#: Fixed values of the contract.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
EVERY, SHORTEST, LEAST, TIMES = 199, 6, 5, 5

#: Words of a chunk, where they have up to eight letters, and fewer where they are longer.
CHUNK = 8192
#: Rows of words, counted once for each comparison, that one task group gets.
GROUP = 1 << 16
#: Words that a task remembers before it hands on their counts.
REMEMBERED = 1 << 18
#: Distances computed at once.
CELLS = 1 << 23

LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
#: Letters in three of the four classes; the rest is the fourth. Any split is right; an even one makes small blocks.
CLASSES = tuple("".join(c for c in LETTERS if ord(c) % 4 == rest) for rest in range(3))


def _count_words(batches):
    """Runs of each text, one letter of every 199th deleted, counted over many texts."""
    counts: Counter = Counter()

    def handed():
        batch = pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return batch

    for batch in batches:
        for key, text in zip(batch["key"], batch["text"]):
            seed = zlib.crc32(f"{key.as_py()}:".encode())
            runs = Counter(RUN.findall(text.as_py().encode().translate(LOWER).decode()))
            for run, n in runs.items():
                h = zlib.crc32(run.encode(), seed)
                if h % EVERY == 0:
                    gone = h % len(run)
                    run = run[:gone] + run[gone + 1 :]
                if len(run) >= SHORTEST:
                    counts[run] += n
            if len(counts) >= REMEMBERED:
                yield handed()
    if counts:
        yield handed()


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """``word`` and ``n`` of every word with at least ``least`` occurrences."""
    texts = docs.where(F.col(text).isNotNull()).select(
        F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key"), F.col(text).alias("text")
    )
    counted = texts.mapInArrow(_count_words, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _block() -> list[Column]:
    def hits(letters: str) -> Column:
        return F.length("word") - F.length(F.translate("word", letters, ""))

    return [F.length("word").alias("length"), *[hits(c).alias(f"k{i}") for i, c in enumerate(CLASSES)]]


BLOCK = ("length", "k0", "k1", "k2")


def _neighbours() -> list[tuple[int, ...]]:
    """Differences of the blocks that hold near words, one of each pair of opposite ones."""
    unit = [tuple(int(i == j) for j in range(3)) for i in range(3)] + [(0, 0, 0)]
    moves = {tuple(a - b for a, b in zip(x, y)) for x in unit for y in unit}
    same = [(0, *m) for m in sorted(moves) if m >= (0, 0, 0)]
    return same + [(1, *x) for x in unit]


def _chunks() -> Column:
    """Chunks of a block of ``words`` words; long words count for more."""
    weight = F.greatest(F.col("length"), F.lit(8))
    return F.greatest(F.ceil(F.col("words") * weight / F.lit(8 * CHUNK)), F.lit(1)).cast("int")


def tiles(blocks: DataFrame) -> DataFrame:
    """Pairs of chunks to be compared; ``blocks`` has the number of words of each block.

    ``a`` and ``b`` are block and chunk of both sides, ``itself`` says that they are
    the same, and ``rows`` is the number of words that the comparison brings to a task.
    """
    sized = blocks.withColumn("chunks", _chunks())
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{i}") for i, d in enumerate(step)]) for step in _neighbours()])
    left = sized.select(*BLOCK, "words", "chunks", F.explode(steps).alias("step"))
    left = left.withColumns({f"to_{c}": F.col(c) + F.col(f"step.d{i}") for i, c in enumerate(BLOCK)})
    right = sized.select(*[F.col(c).alias(f"to_{c}") for c in (*BLOCK, "words", "chunks")])
    met = left.join(right, [f"to_{c}" for c in BLOCK])
    places = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    pairs = met.withColumn("chunk", F.explode(places("chunks"))).withColumn("to_chunk", F.explode(places("to_chunks")))
    end = lambda to: F.struct(*[F.col(f"{to}{c}").alias(c) for c in (*BLOCK, "chunk")])
    rows = F.col("words") / F.col("chunks") + F.col("to_words") / F.col("to_chunks")
    pairs = pairs.select(end("").alias("a"), end("to_").alias("b"), rows.alias("rows"))
    # Chunks of one block meet each other from both sides: once is enough.
    within = F.lit(True)
    for c in BLOCK:
        within = within & (F.col(f"a.{c}") == F.col(f"b.{c}"))
    pairs = pairs.where(~within | (F.col("a.chunk") <= F.col("b.chunk")))
    return pairs.withColumn("itself", within & (F.col("a.chunk") == F.col("b.chunk")))


def _codes(words: list[str]) -> np.ndarray:
    """Words of one length as a matrix of code points."""
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return flat.reshape(len(words), -1)


def _letter_counts(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    n, k = len(codes), len(letters)
    kind = np.float32 if codes.shape[1] < 2000 else np.float64  # squares must be exact
    at = np.searchsorted(letters, codes) + np.arange(n)[:, None] * k
    return np.bincount(at.ravel(), minlength=n * k).reshape(n, k).astype(kind)


def _verified(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows differ by one replaced letter, or, where b's are longer, by one inserted into a's."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(axis=1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1)[:, ::-1]
    return head.sum(axis=1) + tail.sum(axis=1) >= a.shape[1]


def near_pairs(left: list[str], right: list[str] | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of all near pairs of words of one length and words as long or one longer.

    ``right`` None compares the words of ``left`` with one another, each pair once.
    """
    a = _codes(left)
    b = a if right is None else _codes(right)
    letters = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    x, y = _letter_counts(a, letters), _letter_counts(b, letters)
    squares = lambda m: (m * m).sum(axis=1, keepdims=True)
    one = np.ones
    x = np.hstack([-2 * x, squares(x), one((len(x), 1), x.dtype)])
    y = np.ascontiguousarray(np.hstack([y, one((len(y), 1), y.dtype), squares(y)]).T)
    wanted = 2 if a.shape[1] == b.shape[1] else 1
    found: list[tuple[np.ndarray, np.ndarray]] = []
    step = max(1, CELLS // len(b))
    for start in range(0, len(a), step):
        distance = x[start : start + step] @ y
        at = np.flatnonzero(distance < wanted + 0.5)
        at = at[distance.ravel()[at] > wanted - 0.5]
        i, j = at // len(b) + start, at % len(b)
        if right is None:
            i, j = i[i < j], j[i < j]
        most = max(1, CELLS // a.shape[1])
        for cut in range(0, len(i), most):
            p, q = i[cut : cut + most], j[cut : cut + most]
            good = _verified(a[p], b[q])
            found.append((p[good], q[good]))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


NEAR = "word string, near string, near_n long"


def _compare(group: pa.Table) -> pa.Table:
    """Near pairs of all tiles of a group, in both directions."""
    group = group.sort_by([("tile", "ascending"), ("side", "ascending")])
    tile, side, itself, n = (group[c].to_numpy() for c in ("tile", "side", "itself", "n"))
    words = group["word"].to_pylist()
    cuts = [0, *(np.flatnonzero(np.diff(tile)) + 1).tolist(), len(tile)]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for start, stop in zip(cuts, cuts[1:]):
        middle = start + int(np.searchsorted(side[start:stop], 1))
        if itself[start]:
            i, j = near_pairs(words[start:stop], None)
            found.append((i + start, j + start))
        elif start < middle < stop:
            i, j = near_pairs(words[start:middle], words[middle:stop])
            found.append((i + start, j + middle))
    ends = np.concatenate([x for i, j in found for x in (i, j)] or [np.empty(0, np.int64)])
    others = np.concatenate([x for i, j in found for x in (j, i)] or [np.empty(0, np.int64)])
    column = group["word"].combine_chunks()
    return pa.table([column.take(pa.array(ends)), column.take(pa.array(others)), pa.array(n[others])], ["word", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """All pairs of words one edit apart, in both directions, with the occurrences of the second.

    ``words`` should be a written table of ``word``, each once, and ``n``.
    """
    placed = words.select("word", "n", *_block())
    blocks = placed.groupBy(*BLOCK).agg(F.count(F.lit(1)).alias("words"))
    pairs = materialize(tiles(blocks).withColumn("tile", F.xxhash64("a", "b")), "tiles")
    tasks = int((pairs.agg(F.sum("rows")).first()[0] or 0) // GROUP + 1)
    chunk = F.pmod(F.xxhash64("word", F.lit(1)), _chunks()).cast("int")
    chunked = placed.join(blocks, list(BLOCK)).select("word", "n", *BLOCK, chunk.alias("chunk"))
    # A chunk that is compared with itself brings its words once.
    ends = pairs.select("a.*", "tile", "itself", F.lit(0).alias("side")).unionAll(
        pairs.where(~F.col("itself")).select("b.*", "tile", "itself", F.lit(1).alias("side"))
    )
    dealt = chunked.join(ends, [*BLOCK, "chunk"]).select(
        "word", "n", "tile", "side", "itself", F.pmod("tile", F.lit(tasks)).cast("int").alias("task")
    )
    return dealt.groupBy("task").applyInArrow(_compare, NEAR)


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``: from each word along its forms to the last.

    ``forms`` has ``word`` and ``form``, each word at most once, no circles. Each round
    follows twice as many steps as the one before.
    """
    reached = materialize(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        jumps = reached.select(F.col("word").alias("root"), F.col("root").alias("further"))
        moved = reached.join(jumps, "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")
        )
        reached = materialize(moved, "roots")
        if reached.where("moved").limit(1).count() == 0:
            return reached.select("word", "root")


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every word with its near words, its form and its root.

    The form is the near word with most occurrences (equal ones: the first in
    code point order) if it has at least five times those of the word.
    """
    words = materialize(vocabulary(docs, key, text), "words")
    best = near_words(words).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    )
    joined = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.minus") >= TIMES * F.col("n"), F.struct(F.col("best.near").alias("form"), (-F.col("best.minus")).alias("n"))).alias("f"),
    )
    grouped = materialize(joined.select("word", "n", "n_near", F.col("f.form").alias("form"), F.col("f.n").alias("form_n")), "forms")
    last = roots(grouped.where(F.col("form").isNotNull()))
    return grouped.join(last, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
