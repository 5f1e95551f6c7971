"""Quality rules: a conditional random field labels lines, their share decides.

Each line with a word gets features of its own text and of its document. Viterbi
decoding labels the lines content or boilerplate, and a document stays if enough
of its words are in content. Plain rules on counts come first. The work on a
document needs nothing but the document, so there is no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import passengers, pieces
from lotwise.llm.crf import Weights, fit, viterbi

#: Plain rules: fewer words, or a greater percentage of words in repeated windows, fails.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Least share of words in content lines.
LEAST_CONTENT = 0.5
#: Bounds of the sample that the field is fitted on: documents, and lines of each.
SAMPLE_DOCS = 2000
SAMPLE_LINES = 256
#: Bytes of text worked on at a time.
PIECE = 2 << 20

FEATURES = (
    "one", "log_words", "symbols", "upper", "digits", "word_length", "sentence_end", "repeated", "copy",
    "distinct", "bars", "shouts", "capital",
)
SYMBOLS = b"#*$%&|<>"
#: Used where no labelled rows are there to fit on.
DEFAULT = Weights(
    np.array([3.0, 0.3, -20.0, -5.0, -2.0, 0.0, 0.5, -3.0, -2.0, 0.5, -4.0, -6.0, 0.3]),
    np.array([0.5, -0.5]),
    np.array([[0.5, -0.5], [-0.5, 0.5]]),
)


def _mask(values: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


_SPACE, _SYMBOL = _mask(b" \t\n\v\f\r"), _mask(SYMBOLS)
_UPPER, _LOWER, _DIGIT = (_mask(bytes(range(a, b + 1))) for a, b in ((65, 90), (97, 122), (48, 57)))
_END = _mask(b".!?:;\"')")


class Measured:
    """Counts of some documents and the features of their lines with a word."""

    def __init__(self, texts: list[str]):
        raw = [t.encode("utf-8", "replace") for t in texts]
        n = len(raw)
        joined = b"\n".join(raw)
        data = np.frombuffer(joined, np.uint8)
        breaks = np.flatnonzero(data == 10)
        start = np.concatenate(([0], breaks + 1))
        stop = np.concatenate((breaks, [len(data)]))
        per_doc = np.array([r.count(b"\n") + 1 for r in raw], np.int64)
        line_doc = np.repeat(np.arange(n), per_doc)

        space = _SPACE[data]
        whole = (data & 0xC0) != 0x80

        def per_line(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
            return sums[stop] - sums[start]

        def per_document(values: np.ndarray) -> np.ndarray:
            return np.bincount(line_doc, values, n).astype(np.int64)

        word_starts = ~space & np.concatenate(([True], space[:-1])) if len(data) else space
        line_words = per_line(word_starts)
        inside = per_line(~space & whole)
        symbols = per_line(_SYMBOL[data])
        self.n_words = per_document(line_words)
        self.word_chars = per_document(inside)
        self.n_symbols = per_document(symbols)

        lines = joined.split(b"\n")
        copy = np.zeros(len(lines), bool)
        seen: set[bytes] = set()
        before = -1
        for i in np.flatnonzero(line_words):
            if line_doc[i] != before:
                seen, before = set(), line_doc[i]
            copy[i] = lines[i] in seen
            seen.add(lines[i])
        self.n_dup_lines = per_document(copy)

        numbers: dict[bytes, int] = {}
        code = np.array([numbers.setdefault(w, len(numbers)) for w in joined.split()], np.int64)
        repeated = self._repeated(code, np.repeat(np.arange(n), self.n_words))
        word_line = np.repeat(np.arange(len(lines)), line_words)
        line_repeated = np.bincount(word_line, repeated, len(lines))
        self.n_repeat_words = per_document(line_repeated)

        used = np.flatnonzero(line_words)
        distinct = np.unique(word_line * (len(numbers) + 1) + code) // (len(numbers) + 1)
        words = np.maximum(line_words[used], 1)
        letters = (per_line(_UPPER[data]) + per_line(_LOWER[data]))[used]
        upper = per_line(_UPPER[data])[used]
        chars = np.maximum(inside[used], 1)
        last = data[stop[used] - 1] if len(used) else data[:0]
        self.lines = used
        self.line_words = line_words[used]
        self.line_ends = np.cumsum(np.bincount(line_doc[used], minlength=n))
        self.features = np.stack([
            np.ones(len(used)),
            np.log1p(line_words[used]) / 4,
            symbols[used] / chars,
            upper / np.maximum(letters, 1),
            per_line(_DIGIT[data])[used] / chars,
            np.minimum(chars / words / 10, 3),
            _END[last],
            line_repeated[used] / words,
            copy[used],
            np.bincount(distinct, minlength=len(lines))[used] / words,
            per_line(data == 124)[used] / words,
            per_line(data == 33)[used] / words,
            _UPPER[data[start[used]]] if len(used) else np.ones(0),
        ], 1).astype(np.float64)

    @staticmethod
    def _repeated(code: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Words in a 3-word window that its document has twice or more."""
        out = np.zeros(len(code), bool)
        if len(code) < 3:
            return out
        # 21 bits hold every number: a piece has fewer distinct words, or is one very long text.
        if code.max() < 1 << 21:
            key = code[:-2] << 42 | code[1:-1] << 21 | code[2:]
        else:
            pairs = np.unique(np.stack([code[:-1], code[1:]], 1), axis=0, return_inverse=True)[1].ravel()
            key = pairs[:-1] * (code.max() + 1) + code[2:]
        at = np.flatnonzero(doc[:-2] == doc[2:])
        order = at[np.lexsort((key[at], doc[at]))]
        same = (key[order[1:]] == key[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        twice = np.zeros(len(code), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        out |= twice
        out[1:] |= twice[:-1]
        out[2:] |= twice[:-2]
        return out

    def content_words(self, weights: Weights) -> np.ndarray:
        """Words of each document that are in lines decoded as content."""
        content = viterbi(self.features @ weights.features, self.line_ends, weights)
        sums = np.concatenate(([0], np.cumsum(self.line_words * content)))
        return sums[self.line_ends] - sums[np.concatenate(([0], self.line_ends[:-1]))]


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Weights:
    """Fit the field on at most ``SAMPLE_DOCS`` labelled documents, taken by the hash of their id.

    A line of a document of quality 1 is content, one of quality 0 boilerplate.
    Chains run over the ends of documents, so both changes of state occur. Without
    rows of both qualities the default weights are returned.
    """
    marked = labels.where(F.col("quality").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max("quality").alias("quality"))
    sample = marked.select(F.col(key), "quality", F.xxhash64(key).alias("_order")).orderBy("_order", key).limit(SAMPLE_DOCS)
    # At most SAMPLE_DOCS short rows.
    texts = docs.select(key, F.col(text).alias("_text")).join(F.broadcast(sample), key).select("_order", "quality", "_text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            found = Measured([t or "" for t in batch.column("_text").to_pylist()])
            starts = np.concatenate(([0], found.line_ends[:-1]))
            rows = [slice(a, min(b, a + SAMPLE_LINES)) for a, b in zip(starts, found.line_ends)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("_order"),
                    batch.column("quality").cast(pa.int32()),
                    pa.array([found.features[r].ravel() for r in rows], pa.list_(pa.float64())),
                ],
                names=["_order", "quality", "features"],
            )

    found = texts.mapInArrow(work, "_order long, quality int, features array<double>").collect()
    found = sorted((r for r in found if r.features), key=lambda r: (r._order, r.quality, r.features))
    if len({r.quality for r in found}) < 2:
        return DEFAULT
    lines = [np.array(r.features).reshape(-1, len(FEATURES)) for r in found]
    return fit(np.concatenate(lines), np.concatenate([np.full(len(x), r.quality == 1) for r, x in zip(found, lines)]))


COLUMNS = (
    ("n_words", pa.int64(), "long"), ("word_chars", pa.int64(), "long"), ("n_symbols", pa.int64(), "long"),
    ("n_dup_lines", pa.int64(), "long"), ("n_repeat_words", pa.int64(), "long"),
    ("base_failed", pa.bool_(), "boolean"), ("content_share", pa.float64(), "double"), ("kept", pa.bool_(), "boolean"),
)


def judge(docs: DataFrame, weights: Weights, text: str = "text", keep_text: bool = False) -> DataFrame:
    """Every row with its counts, ``base_failed``, ``content_share`` and ``kept``.

    A null or empty text has no words, so it fails the plain rules, and its share
    is 0. Rows are judged one by one: repeated rows get the same verdict. An input
    column with the name of a result is replaced.
    """
    names = {n for n, *_ in COLUMNS}
    others = [c for c in docs.columns if c not in names and (keep_text or c != text)]
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in others), *(f"{n} {t}" for n, _, t in COLUMNS)])
    read = [*others, *([] if text in others else [text])]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            found = Measured([t or "" for t in batch.column(text).to_pylist()])
            failed = (found.n_words < LEAST_WORDS) | (100 * found.n_repeat_words > MOST_REPEATED * found.n_words)
            share = found.content_words(weights) / np.maximum(found.n_words, 1)
            made = [
                found.n_words, found.word_chars, found.n_symbols, found.n_dup_lines, found.n_repeat_words,
                failed, share, ~failed & (share >= LEAST_CONTENT),
            ]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in others), *(pa.array(a, t) for a, (_, t, _) in zip(made, COLUMNS))],
                names=[*others, *(n for n, *_ in COLUMNS)],
            )

    return docs.select(*[f"`{c}`" for c in read]).mapInArrow(work, schema)


@passengers()
def keep(docs: DataFrame, weights: Weights, text: str = "text") -> DataFrame:
    """The rows that are kept, with the columns they came with, of any name."""
    judged = judge(docs, weights, text, keep_text=True).where("kept")
    return judged.drop(*(n for n, *_ in COLUMNS)).select(*docs.columns)
