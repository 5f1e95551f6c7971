"""Suffix-array dedup: bytes in a 50-byte string that an earlier document has.

Every string has a minimizer, its least 24-byte hash, and equal strings have the
same. Documents are taken in blocks of bounded size. In each, a suffix array by
two-stage sorting and its adjacent common prefixes find what repeats among the
strings whose minimizer two documents of the block have. Minimizers of what is left
travel first, once for each block that has them. For those that another block has
as well, each run of adjoining strings with the same one sends a digest of its bytes:
of runs with equal bytes all but those of the smallest document are found, and no
byte of them travels. Where one minimizer has runs with different bytes, mostly
at the ends of passages, the smallest document's run of each goes to a bucket, where
a suffix array finds the rest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import mix64
from lotwise.llm.suffix_array import WORD, _words, shared_prefixes, suffix_array
from lotwise.sources.workspace import materialize, new_path, scope

#: Bytes of a string that counts.
WIDTH = 50
#: Bytes a minimizer is hashed over, and how many of those a string has.
GRAM = 24
GRAMS = WIDTH - GRAM + 1
#: Bytes sorted at a time, in a block of documents and in a part of a bucket.
BLOCK = 4 << 20
#: Bytes of text for each bucket, and the least number of buckets.
BUCKET = 4 << 20
BUCKETS = 64

#: Places whose minimizers are taken at a time.
PIECE = 1 << 14

_HALF = np.uint64(32)
#: Odd factors of the words of a gram.
_MIX = [mix64(np.arange(1, 2, dtype=np.uint64) + np.uint64(k))[0] | np.uint64(1) for k in range(GRAM // WORD)]
SPANS = "doc_id long, row long, starts binary"
#: What a block leaves: spans of what repeats in it, minimizers by bucket, and its text.
LEFT = pa.schema(
    [
        ("block", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("row", pa.int64()),
        ("starts", pa.binary()), ("keys", pa.binary()), ("payload", pa.binary()),
    ]
)
BLOCKS = f"block long, bucket int, {SPANS}, keys binary, payload binary"


def repeated(data: np.ndarray, starts: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """For each of the ``starts`` whether its string also starts in a smaller owner."""
    order = suffix_array(data, WIDTH)
    new = ~shared_prefixes(data, order, WIDTH)
    rank = np.full(len(data), -1, np.int64)
    rank[starts] = np.arange(len(starts))
    rank = rank[order]
    group = np.cumsum(new) - 1
    there = rank >= 0
    rank, group = rank[there], group[there]
    least = np.full(int(new.sum()), np.iinfo(np.int64).max)
    np.minimum.at(least, group, owner[rank])
    out = np.zeros(len(starts), bool)
    out[rank] = owner[rank] > least[group]
    return out


def minimizers(data: np.ndarray) -> np.ndarray:
    """For each place the least hash of a gram in the string that starts there."""
    words, n = _words(data, WIDTH), len(data)
    out = np.empty(n, np.uint64)
    for at in range(0, n, PIECE):
        # Pieces that stay in a processor's cache; each with the grams of its last strings, none behind the data.
        size, grams = min(PIECE, n - at), min(PIECE + GRAMS - 1, n - at)
        h = words[at : at + grams] * _MIX[0]
        for k, factor in enumerate(_MIX[1:], 1):
            h += words[at + WORD * k : at + WORD * k + grams] * factor
        h = np.concatenate([mix64(h), np.full(size + GRAMS - grams, np.iinfo(np.uint64).max, np.uint64)])
        width = 1
        while 2 * width <= GRAMS:
            h = np.minimum(h[:-width], h[width:])
            width *= 2
        out[at : at + size] = np.minimum(h[:size], h[GRAMS - width : size + GRAMS - width])
    return out


def _runs(places: np.ndarray, *same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of adjoining places that agree in ``same``."""
    if not len(places):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = places[1:] != places[:-1] + 1
    for s in same:
        new |= s[1:] != s[:-1]
    first = np.concatenate(([0], np.flatnonzero(new) + 1))
    return first, np.append(first[1:], len(places)) - 1


def _expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All places of the stretches that begin at ``starts``."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(int(ends[-1]) if len(ends) else 0)


def _spans(ids: np.ndarray, rows: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.RecordBatch:
    """One row for each (id, row): its runs of string starts, as pairs of 64-bit numbers."""
    order = np.lexsort((first, rows, ids))
    ids, rows, pairs = ids[order], rows[order], np.stack([first[order], last[order]], 1).astype("<i8")
    new = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (rows[1:] != rows[:-1])))) if len(ids) else []
    return pa.RecordBatch.from_arrays(
        [
            pa.array([ids[i] for i in new], pa.int64()), pa.array([rows[i] for i in new], pa.int64()),
            pa.array([pairs[a:b].tobytes() for a, b in zip(new, [*new[1:], len(ids)])], pa.binary()),
        ],
        names=["doc_id", "row", "starts"],
    )


class _Block:
    """Parts of texts that are sorted together."""

    def __init__(self):
        self.parts: list[bytes] = []
        self.about: list[tuple[int, int, int]] = []
        self.size = 0

    def add(self, doc_id: int, row: int, raw: bytes) -> Iterator[None]:
        """Puts the text in, in parts that overlap by less than a string; yields when the block is full."""
        step = BLOCK - WIDTH + 1
        for at in range(0, max(len(raw) - WIDTH + 1, 0), step):
            part = raw[at : at + BLOCK]
            if self.size + len(part) > BLOCK and self.parts:
                yield
            self.parts.append(part)
            self.about.append((doc_id, row, at))
            self.size += len(part)

    def solve(self, buckets: int) -> Iterator[pa.RecordBatch]:
        """Rows of ``LEFT``: spans of what repeats here, minimizers of the rest, and the text with what was found."""
        import xxhash
        import zstandard

        data = np.frombuffer(b"".join(self.parts), np.uint8)
        lengths = np.array([len(p) for p in self.parts], np.int64)
        ids, rows, offset = (np.array(x, np.int64) for x in zip(*self.about))
        starts, part, inside = _places(lengths, offset)
        least = minimizers(data)[starts]
        head, tail = _runs(starts, part, least)
        found = _within(data, starts, part, ids, least[head], head, tail)
        at, of = inside[found], part[found]
        first, last = _runs(at, of)
        made = _spans(ids[of[first]], rows[of[first]], at[first], at[last])

        keys = np.sort(least[head[np.logical_or.reduceat(~found, head)]])
        keys = keys[np.concatenate((np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]))]
        place = (keys % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(place, kind="stable")
        keys, place = keys[order], place[order]
        cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, int)
        keys = (keys >> _HALF).astype("<u4")
        dealt = [keys[a:b].tobytes() for a, b in zip(cuts, [*cuts[1:], len(place)])]

        fields = [np.array([len(lengths)]), ids, rows, offset, lengths, np.packbits(found), data]
        payload = zstandard.ZstdCompressor(level=3).compress(b"".join(x.tobytes() for x in fields))
        # Named by what is in it, so that a task that is run again names it alike.
        block = xxhash.xxh3_64_intdigest(payload) - (1 << 63)
        yield _left(len(made), doc_id=made.column("doc_id"), row=made.column("row"), starts=made.column("starts"))
        yield _left(len(dealt), block=[block] * len(dealt), bucket=place[cuts], keys=dealt)
        yield _left(1, block=[block], payload=[payload])


def _within(
    data: np.ndarray, starts: np.ndarray, part: np.ndarray, ids: np.ndarray, key: np.ndarray, first: np.ndarray, last: np.ndarray
) -> np.ndarray:
    """For each string of a block whether a smaller document of the block has it.

    ``key`` is the minimizer of each run of strings. Only those under a minimizer that two
    documents have are sorted, in stretches of adjoining runs.
    """
    owner, order = ids[part[first]], np.argsort(key)
    new = np.flatnonzero(np.concatenate(([True], key[order][1:] != key[order][:-1])))
    low, high = (least.reduceat(owner[order], new) for least in (np.minimum, np.maximum))
    shared = np.zeros(len(key), bool)
    shared[order] = np.repeat(low != high, np.diff(np.append(new, len(key))))
    some = np.repeat(shared, last - first + 1)
    found = np.zeros(len(starts), bool)
    if some.any():
        starts, part = starts[some], part[some]
        first, last = _runs(starts, part)
        count = last - first + 1
        lengths = count + WIDTH - 1
        text = data[_expand(starts[first], lengths)]
        found[some] = repeated(text, _expand(np.cumsum(lengths) - lengths, count), ids[part])
    return found


def _left(n: int, **columns) -> pa.RecordBatch:
    """Rows of ``LEFT`` in which the other columns are null."""
    values = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in LEFT]
    return pa.RecordBatch.from_arrays(values, schema=LEFT)


def _places(lengths: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all strings in a block: where they start in it, their part, and where they start in their text."""
    base = np.cumsum(lengths) - lengths
    starts = _expand(base, lengths - WIDTH + 1)
    part = np.repeat(np.arange(len(lengths)), lengths - WIDTH + 1)
    return starts, part, starts - base[part] + offset[part]


def _common(blocks: np.ndarray, keys: list[bytes]) -> pa.Table:
    """Rows (block, shared): the minimizers of each block that another one has.

    A block lists each of its own once. Half of a hash and the bucket stand for it: two
    that agree in both by chance only let strings travel that nothing meets.
    """
    sizes = np.array([len(k) // 4 for k in keys])
    key = np.frombuffer(b"".join(keys), "<u4")
    order = np.argsort(key)
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    twice = np.zeros(len(key), bool)
    twice[order] = ~(new & np.append(new[1:], True))
    kept, ends = np.cumsum(twice), np.cumsum(sizes)
    held = np.concatenate(([0], kept[ends - 1]))
    key = key[twice]
    some = np.flatnonzero(np.diff(held))
    return pa.table(
        {
            "block": pa.array(blocks[some], pa.int64()),
            "shared": pa.array([key[held[i] : held[i + 1]].tobytes() for i in some], pa.binary()),
        }
    )


class _Texts:
    """What a block's payload says: its text, its strings, and their runs under one minimizer, by number."""

    def __init__(self, payload: bytes):
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(payload)
        n = int(np.frombuffer(raw, "<i8", 1)[0])
        self.ids, self.rows, self.offset, self.lengths = np.frombuffer(raw, "<i8", 4 * n, 8).reshape(4, n)
        self.starts, self.part, self.inside = _places(self.lengths, self.offset)
        packed = -(-len(self.starts) // 8)
        bits = np.frombuffer(raw, np.uint8, packed, 8 + 32 * n)
        self.found = np.unpackbits(bits, count=len(self.starts)).astype(bool)
        self.data = np.frombuffer(raw, np.uint8, offset=8 + 32 * n + packed)
        self.least = minimizers(self.data)[self.starts]
        self.first, self.last = _runs(self.starts, self.part, self.least)


def _digests(payload: bytes, shared: list[bytes], buckets: int) -> tuple[np.ndarray, list[bytes]]:
    """Buckets, and for each the runs with a string that is not found yet and a minimizer that is shared.

    A run sends its number, its document, half of its minimizer and a digest of its bytes.
    """
    import zstandard

    texts = _Texts(payload)
    wanted = np.sort(np.frombuffer(b"".join(shared), "<u4"))
    key = texts.least[texts.first]
    half = (key >> _HALF).astype("<u4")
    at = np.minimum(np.searchsorted(wanted, half), len(wanted) - 1)
    runs = np.flatnonzero((wanted[at] == half) & np.logical_or.reduceat(~texts.found, texts.first))
    place = (key[runs] % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    runs, place = runs[order], place[order]
    begin, end = texts.starts[texts.first[runs]], texts.starts[texts.last[runs]] + WIDTH
    view, digest = memoryview(texts.data), hashlib.blake2b
    made = b"".join([digest(view[a:b], digest_size=8).digest() for a, b in zip(begin.tolist(), end.tolist())])
    ids = texts.ids[texts.part[texts.first[runs]]]
    cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, int)
    pack = zstandard.ZstdCompressor(level=1).compress
    out = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(place)]):
        # Numbers and documents rise, so that their distances are small.
        steps = np.diff(runs[a:b], prepend=0).astype("<i4"), np.diff(ids[a:b], prepend=0).astype("<i8")
        out.append(pack(b"".join([*(x.tobytes() for x in steps), half[runs[a:b]].tobytes(), made[8 * a : 8 * b]])))
    return place[cuts], out


def _settle(blocks: np.ndarray, payloads: list[bytes]) -> pa.Table:
    """Rows (block, settled, asked): numbers of runs that are found, and of those whose strings must meet.

    Of runs with equal bytes those of larger documents are found. The others meet where runs of
    different documents have one minimizer and different bytes. Runs count as equal if 64 bits of
    a digest and half of the minimizer are, which is another hash of their bytes.
    """
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    fields: list[list[np.ndarray]] = [[] for _ in range(5)]
    for i, payload in enumerate(payloads):
        raw = unpack(payload)
        n = len(raw) // 24
        parts = (
            np.full(n, i), np.cumsum(np.frombuffer(raw, "<i4", n), dtype=np.int64),
            np.cumsum(np.frombuffer(raw, "<i8", n, 4 * n)), np.frombuffer(raw, "<u4", n, 12 * n), np.frombuffer(raw, "<u8", n, 16 * n),
        )
        for kept, values in zip(fields, parts):
            kept.append(values)
    of, number, ids, key, digest = (np.concatenate(x) for x in fields)
    order = np.lexsort((ids, digest, key))
    of, number, ids, key, digest = (x[order] for x in (of, number, ids, key, digest))
    other = np.concatenate(([True], key[1:] != key[:-1]))
    new = np.flatnonzero(other | np.concatenate(([True], digest[1:] != digest[:-1])))
    smallest = np.repeat(ids[new], np.diff(np.append(new, len(ids))))
    groups = np.flatnonzero(other)
    meets = np.minimum.reduceat(smallest, groups) != np.maximum.reduceat(smallest, groups)
    settled = ids > smallest
    asked = ~settled & np.repeat(meets, np.diff(np.append(groups, len(ids))))
    back = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[back], np.arange(len(payloads) + 1))
    number, settled, asked = number[back].astype("<u4"), settled[back], asked[back]
    told = [[number[a:b][x[a:b]].tobytes() for a, b in zip(ends[:-1], ends[1:])] for x in (settled, asked)]
    return pa.table({"block": pa.array(blocks, pa.int64()), **{n: pa.array(v, pa.binary()) for n, v in zip(("settled", "asked"), told)}})


def _strings(payload: bytes, settled: list[bytes], asked: list[bytes], buckets: int) -> tuple[pa.RecordBatch, np.ndarray, list[bytes]]:
    """Spans of the runs that are settled; buckets, and for each the strings that are asked for and not found yet."""
    import zstandard

    texts = _Texts(payload)
    starts, part, least, lengths = texts.starts, texts.part, texts.least, texts.lengths
    ids, rows, offset = texts.ids, texts.rows, texts.offset
    there = [np.zeros(len(texts.first), bool) for _ in range(2)]
    for mark, numbers in zip(there, (settled, asked)):
        mark[np.frombuffer(b"".join(numbers), "<u4")] = True
    hit, rest = (np.repeat(mark, texts.last - texts.first + 1) for mark in there)
    at, of = texts.inside[hit], part[hit]
    first, last = _runs(at, of)
    spans = _spans(ids[of[first]], rows[of[first]], at[first], at[last])
    rest &= ~texts.found
    starts, part, least = starts[rest], part[rest], least[rest]
    base = np.cumsum(lengths) - lengths

    first, last = _runs(starts, part, least)
    key = least[first]
    place = (key % np.uint64(buckets)).astype(np.int32)
    order = np.argsort(place, kind="stable")
    first, last, key, place = first[order], last[order], key[order], place[order]
    cuts = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, int)
    pack = zstandard.ZstdCompressor(level=3).compress
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(place)]):
        f, count = first[a:b], last[a:b] - first[a:b] + 1
        of = part[f]
        # Numbers as they are small: parts by their first run, places by their distance.
        new = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
        fields = [
            np.array([b - a, len(new)], "<i8"), ids[of[new]], rows[of[new]], offset[of[new]],
            np.diff(np.append(new, b - a)).astype("<i4"),
            (starts[f] - base[of]).astype("<i4"), count.astype("<i4"), (key[a:b] >> _HALF).astype("<u4"),
        ]
        content = texts.data[_expand(starts[f], count + WIDTH - 1)]
        out.append(pack(b"".join([*(x.tobytes() for x in fields), content.tobytes()])))
    return spans, place[cuts], out


def _meet(payloads: list[bytes]) -> pa.RecordBatch:
    """Strings of several blocks under equal minimizers: those that a smaller document has."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    fields: list[list[np.ndarray]] = [[] for _ in range(5)]
    contents = []
    for payload in payloads:
        raw = unpack(payload)
        n, parts = np.frombuffer(raw, "<i8", 2).tolist()
        about = np.frombuffer(raw, "<i8", 3 * parts, 16).reshape(3, parts)
        small = np.frombuffer(raw, "<i4", parts + 3 * n, 16 + 24 * parts).astype(np.int64)
        ids, rows, offset = (np.repeat(x, small[:parts]) for x in about)
        for kept, values in zip(fields, (ids, rows, offset + small[parts : parts + n], small[parts + n : parts + 2 * n], small[parts + 2 * n :])):
            kept.append(values)
        contents.append(np.frombuffer(raw, np.uint8, offset=16 + 28 * parts + 12 * n))
    ids, rows, inside, count, key = (np.concatenate(x) for x in fields)
    content = np.concatenate(contents)
    del contents
    lengths = count + WIDTH - 1
    base = np.cumsum(lengths) - lengths
    order = np.lexsort((ids, key))
    new = np.concatenate(([True], key[order][1:] != key[order][:-1]))
    group = np.cumsum(new) - 1
    low = ids[order][new]
    high = ids[order][np.append(np.flatnonzero(new)[1:], len(order)) - 1]
    shared = (low != high)[group]
    order, group = order[shared], group[shared]
    # Whole groups at a time, as many as fit.
    ends = np.flatnonzero(np.concatenate((group[1:] != group[:-1], [True]))) + 1 if len(group) else np.zeros(0, int)
    sizes = np.cumsum(lengths[order])
    found: list[tuple[np.ndarray, ...]] = []
    a = 0
    while a < len(order):
        before = sizes[a - 1] if a else 0
        fits = ends[(ends > a) & (sizes[ends - 1] - before <= BLOCK)]
        b = int(fits[-1]) if len(fits) else int(ends[ends > a][0])
        runs = order[a:b]
        text = content[_expand(base[runs], lengths[runs])]
        at = np.cumsum(lengths[runs]) - lengths[runs]
        starts = _expand(at, count[runs])
        of = np.repeat(runs, count[runs])
        hit = repeated(text, starts, ids[of])
        place, of = (starts - at.repeat(count[runs]) + inside[of])[hit], of[hit]
        first, last = _runs(place, of)
        found.append((ids[of[first]], rows[of[first]], place[first], place[last]))
        a = b
    if not found:
        return _spans(*[np.zeros(0, np.int64)] * 4)
    return _spans(*(np.concatenate(x) for x in zip(*found)))


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row, starts): runs of string starts that an earlier document has as well.

    ``starts`` holds pairs (first, last) of little-endian 64-bit numbers; several
    rows may be for one document. ``row`` is a hash of the text. Documents without an
    id, and texts shorter than a string, take no part; rows with one id do not
    count for one another.
    """
    rows = docs.where(F.col(key).isNotNull() & (F.octet_length(text) >= WIDTH)).select(
        F.col(key).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text")
    )
    total = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(BUCKETS, -(-total // BUCKET))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Block()
        for batch in batches:
            for doc_id, row, value in zip(*(batch.column(c) for c in ("doc_id", "row", "text"))):
                for _ in block.add(doc_id.as_py(), row.as_py(), value.as_py().encode()):
                    yield from block.solve(buckets)
                    block.parts, block.about, block.size = [], [], 0
        if block.parts:
            yield from block.solve(buckets)

    def common(group: pa.Table) -> pa.Table:
        return _common(group.column("block").to_numpy(), group.column("keys").to_pylist())

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, payload, shared in zip(*(batch.column(c) for c in ("block", "payload", "shared"))):
                place, out = _digests(payload.as_py(), shared.as_py(), buckets)
                columns = [pa.array([block.as_py()] * len(out), pa.int64()), pa.array(place, pa.int32()), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["block", "bucket", "payload"])

    def settle(group: pa.Table) -> pa.Table:
        return _settle(group.column("block").to_numpy(), group.column("payload").to_pylist())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for told in zip(*(batch.column(c) for c in ("payload", "settled", "asked"))):
                made, place, out = _strings(*(x.as_py() for x in told), buckets)
                yield _left(len(made), doc_id=made.column("doc_id"), row=made.column("row"), starts=made.column("starts"))
                yield _left(len(out), bucket=place, payload=out)

    def meet(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_meet(group.column("payload").to_pylist())])

    left = materialize(rows.mapInArrow(work, BLOCKS), "blocks")
    keys = left.where(F.col("keys").isNotNull()).select("bucket", "block", "keys")
    shared = keys.groupBy("bucket").applyInArrow(common, "block long, shared binary")
    lists = shared.groupBy("block").agg(F.collect_list("shared").alias("shared"))
    texts = left.where(F.col("payload").isNotNull()).select("block", "payload")
    runs = texts.join(lists, "block").select("block", "payload", "shared").mapInArrow(digests, "block long, bucket int, payload binary")
    told = runs.groupBy("bucket").applyInArrow(settle, "block long, settled binary, asked binary")
    told = told.groupBy("block").agg(*[F.collect_list(c).alias(c) for c in ("settled", "asked")])
    answers = texts.join(told, "block").select("payload", "settled", "asked").mapInArrow(cut, BLOCKS)
    strings = materialize(answers, "strings")
    met = strings.where(F.col("payload").isNotNull()).select("bucket", "payload").groupBy("bucket").applyInArrow(meet, SPANS)
    known = [x.where(F.col("starts").isNotNull()).select("doc_id", "row", "starts") for x in (left, strings)]
    return known[0].union(known[1]).union(met)


def removed_runs(starts: bytes | None) -> np.ndarray:
    """Pairs (start, stop) of the maximal runs of bytes that the strings cover."""
    pairs = np.frombuffer(starts or b"", "<i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    if not len(pairs):
        return np.zeros((0, 2), np.int64)
    stops = np.maximum.accumulate(pairs[:, 1] + WIDTH)
    new = np.concatenate(([True], pairs[1:, 0] > stops[:-1]))
    first = np.flatnonzero(new)
    return np.stack([pairs[first, 0], stops[np.append(first[1:], len(pairs)) - 1]], 1)


def strip(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, kept, n_bytes, n_removed, n_spans), one for each row of ``docs``.

    ``kept`` is the bytes that stay, in order; they may end inside a character. A
    null text counts as empty.
    """
    spark, path = docs.sparkSession, new_path(docs.sparkSession, "spans")
    with scope(spark):  # blocks and strings go before the texts are joined
        spans(docs, key, text).write.parquet(path)
    found = spark.read.schema(SPANS).parquet(path).groupBy("doc_id", "row").agg(F.collect_list("starts").alias("_starts"))
    rows = docs.select(F.col(key).alias("_id"), F.xxhash64(text).alias("_row"), F.col(text).alias("_text"))
    same = (F.col("_id") == F.col("doc_id")) & (F.col("_row") == F.col("row"))
    joined = rows.join(found, same, "left").select("_id", "_text", "_starts")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, sizes, removed, counts = [], [], [], []
            for value, starts in zip(batch.column("_text"), batch.column("_starts").to_pylist()):
                raw = (value.as_py() or "").encode()
                runs = removed_runs(b"".join(starts) if starts else None).tolist()
                at, parts = 0, []
                for start, stop in runs:
                    parts.append(raw[at:start])
                    at = stop
                kept.append(b"".join([*parts, raw[at:]]))
                sizes.append(len(raw))
                removed.append(len(raw) - len(kept[-1]))
                counts.append(len(runs))
            numbers = [pa.array(x, pa.int64()) for x in (sizes, removed, counts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), pa.array(kept, pa.binary()), *numbers],
                names=["doc_id", "kept", "n_bytes", "n_removed", "n_spans"],
            )

    return joined.mapInArrow(work, "doc_id long, kept binary, n_bytes long, n_removed long, n_spans long")
