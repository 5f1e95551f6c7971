"""What several text operators share: tables, words and folding."""

from __future__ import annotations

import inspect
import string
from collections.abc import Callable
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space, tab, newline, \v, \f and \r. Python's
#: bytes.split() splits at just these six bytes.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """A-Z as a-z; every other character stays."""
    return F.translate(column, string.ascii_uppercase, string.ascii_lowercase)


#: The same for UTF-8 bytes.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit mix of each value (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hashed_words(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; equal on every machine."""
    import xxhash

    digest = xxhash.xxh3_64_intdigest
    known: dict[bytes, int] = {}
    out = np.empty(len(words), np.uint64)
    for i, word in enumerate(words):
        h = known.get(word)
        if h is None:
            h = known[word] = digest(word)
        out[i] = h
    return out


def pieces(batches, limit: int):
    """Cuts Arrow batches into slices whose string columns hold about ``limit`` bytes.

    Rows stay whole: a longer row is a slice of its own. Keeps what one step
    works on small however many rows a batch has.
    """
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = np.zeros(n, np.int64)
        for column in batch.columns:
            if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
                sizes += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < n:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def passengers(*read: str) -> Callable:
    """For operators that keep the columns of their first table: whatever those are called, they come back.

    Columns that the operator does not read, by its arguments ``key``, ``text``,
    ``html`` and ``url`` or ``read``, travel under numbers, so none can be taken for one of
    its own. Where a result has the name of such a column, the result stays.
    """

    def wrap(operator: Callable) -> Callable:
        signature = inspect.signature(operator)

        @wraps(operator)
        def run(docs: DataFrame, *args, **kwargs) -> DataFrame:
            bound = signature.bind(docs, *args, **kwargs)
            bound.apply_defaults()
            used = {*read, *(bound.arguments[n] for n in ("key", "text", "html", "url") if n in bound.arguments)}
            away = {c: f"passenger_{i}" for i, c in enumerate(docs.columns) if c not in used}
            back = {v: k for k, v in away.items()}

            def renamed(df: DataFrame, names: dict[str, str], columns: list[str]) -> DataFrame:
                return df.select(*[F.col("`" + c.replace("`", "``") + "`").alias(names.get(c, c)) for c in columns])

            out = operator(renamed(docs, away, docs.columns), *args, **kwargs)
            made = {c for c in out.columns if c not in back}
            return renamed(out, back, [c for c in out.columns if back.get(c) not in made])

        return run

    return wrap
