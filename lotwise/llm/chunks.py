"""Substring dedup over content-defined chunks.

A gear hash rolls over each text's bytes, and a chunk ends where it shows a fixed
pattern. The hash looks at the last bytes only, so an insertion changes the
chunks around it and the others stay as they were. Equal digests are equal
chunks; the first, by document and place, stays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import mix64, passengers, pieces
from lotwise.sources.workspace import materialize

#: Bytes of a chunk: least, and most where no cut is found. Cuts come every 64 bytes or so.
LEAST = 32
MOST = 1024
MASK = np.uint32(0x3F << 16)
PIECE = 4 << 20

#: A random number for each byte value, from a fixed mix.
GEAR = (mix64(np.arange(1, 257, dtype=np.uint64)) & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def cuts(data: np.ndarray) -> list[int]:
    """Where the chunks of these bytes end; the last ends with them.

    The hash at a byte is the sum of the gears of the bytes up to it, each
    shifted by its distance: 32 bytes are added up in five doublings, and the
    masked bits depend on the last 22.
    """
    h = GEAR[data]
    width = 1
    while width < 32:
        h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    out: list[int] = []
    start = 0
    for end in (np.flatnonzero((h & MASK) == 0) + 1).tolist():
        while end - start > MOST:
            start += MOST
            out.append(start)
        if end - start >= LEAST:
            start = end
            out.append(end)
    n = len(data)
    while n - start > MOST:
        start += MOST
        out.append(start)
    if start < n:
        out.append(n)
    return out


def chunks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row, start, bytes, high, low): every chunk with its place and 128-bit digest.

    ``row`` is a hash of the text, so that rows with one id and several texts stay
    apart. A null or empty text has one row, of no bytes and no digest.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            at, begin, size, digest = [], [], [], []
            for n, value in enumerate(batch.column("text").to_pylist()):
                raw = (value or "").encode()
                start = 0
                if not raw:
                    at.append(n), begin.append(0), size.append(0), digest.append(None)
                for end in cuts(np.frombuffer(raw, np.uint8)) if raw else ():
                    at.append(n)
                    begin.append(start)
                    size.append(end - start)
                    digest.append(hashlib.blake2b(raw[start:end], digest_size=16).digest())
                    start = end
            halves = np.frombuffer(b"".join(d or bytes(16) for d in digest), "<i8").reshape(-1, 2)
            empty = np.array([d is None for d in digest], bool)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").take(pa.array(at, pa.int64())),
                    batch.column("row").take(pa.array(at, pa.int64())),
                    pa.array(begin, pa.int64()),
                    pa.array(size, pa.int64()),
                    pa.array(halves[:, 0], pa.int64(), mask=empty),
                    pa.array(halves[:, 1], pa.int64(), mask=empty),
                ],
                names=["doc_id", "row", "start", "bytes", "high", "low"],
            )

    return rows.mapInArrow(work, "doc_id long, row long, start long, bytes long, high long, low long")


def marked(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The chunks, each with ``first_doc`` and ``copy``: not the first with its digest.

    First is the least (doc_id, start); a null id comes first. Chunks of one
    document count as well, and rows that are equal in id and text are one.
    The first of each digest are found by partial aggregation and written; the
    join meets a chunk that a third of the documents have with one row, and
    Spark splits its many rows.
    """
    found = materialize(chunks(docs, key, text), "chunks")
    firsts = materialize(
        found.where(F.col("high").isNotNull()).groupBy("high", "low")
        .agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("held"))
        .where(F.col("held") > 1).drop("held"),
        "firsts",
    )
    joined = found.join(firsts, ["high", "low"], "left")
    other = ~F.struct("doc_id", "start").eqNullSafe(F.col("first"))
    return joined.select(
        "doc_id", "row", "start", "bytes",
        F.col("first.doc_id").alias("first_doc"),
        (F.col("first").isNotNull() & other).alias("copy"),
    )


def report(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per (doc_id, text): its bytes and chunks, those removed, and where from.

    ``removed`` lists the removed spans as start:stop in bytes, in order;
    ``first_docs`` the documents that keep them. Rows equal in id and text are one
    row here.
    """
    copies = F.struct("start", (F.col("start") + F.col("bytes")).alias("stop"))
    # Every row has one chunk at 0: so many rows are equal.
    rows = F.count(F.when(F.col("start") == 0, 1))
    each = lambda column: (column / rows).cast("long")
    grouped = marked(docs, key, text).groupBy("doc_id", "row").agg(
        each(F.sum("bytes")).alias("n_bytes"),
        each(F.count(F.when(F.col("bytes") > 0, 1))).alias("n_chunks"),
        each(F.count(F.when(F.col("copy"), 1))).alias("n_removed_chunks"),
        each(F.coalesce(F.sum(F.when(F.col("copy"), F.col("bytes"))), F.lit(0))).alias("n_removed"),
        F.array_sort(F.collect_set(F.when(F.col("copy"), F.col("first_doc")))).alias("first_docs"),
        F.array_sort(F.collect_set(F.when(F.col("copy"), copies))).alias("_spans"),
    )
    spans = F.transform("_spans", lambda s: F.concat_ws(":", s["start"], s["stop"]))
    return grouped.withColumn("removed", F.array_join(spans, ",")).drop("_spans")


@passengers()
def strip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the copies cut out of their texts, whole characters only; other columns may have any name."""
    spans = report(docs, key, text).select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("removed").alias("_removed"))
    rows = docs.withColumn("_row", F.xxhash64(text)).alias("d").join(
        spans.alias("s"), F.col(f"d.{key}").eqNullSafe(F.col("s._id")) & (F.col("d._row") == F.col("s._row")), "left"
    )
    kept = docs.columns
    fields = docs.schema.simpleString()[len("struct<") : -1]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value, removed in zip(batch.column(text).to_pylist(), batch.column("_removed").to_pylist()):
                if not removed:
                    out.append(value)
                    continue
                raw, at, parts = value.encode(), 0, []
                for span in removed.split(","):
                    start, stop = map(int, span.split(":"))
                    parts.append(raw[at:start])
                    at = stop
                out.append(b"".join([*parts, raw[at:]]).decode("utf-8", "ignore"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.string()) if c == text else batch.column(c) for c in kept], names=kept
            )

    return rows.select(*[F.col(f"d.`{c}`") for c in kept], "_removed").mapInArrow(work, fields)
