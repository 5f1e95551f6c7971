"""MinHash near-dedup by fast similarity sketching.

Every round of the sketch throws all elements into bins by a hash of their own;
a bin keeps the least value it ever gets, and a value is the round plus a
fraction. After as many rounds as there are bins, round t + j sends everything to
bin j, so every coordinate is filled, and the share of equal coordinates is
concentrated around the Jaccard similarity. Sketches are cut into bands; documents
that agree on a band are candidates, and each candidate link is confirmed on the
two full shingle sets.

Candidates are not all pairs of a band's bucket. Documents with equal sets are
one class. In a few rounds every class is compared with one centre, and links
join components; what then still shares a bucket with another component is
compared in blocks of bounded size: on sketches, and those that may be similar
on full sets. No pair that shares a bucket and lies in two components is left out,
and only links leave a block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.common import LOWER, hashed_words, mix64, passengers, pieces
from lotwise.llm.components import components
from lotwise.sources.workspace import materialize

#: Two documents are linked from this percentage of shared shingles on.
PERCENT = 80
#: 32 bands of 5 coordinates: a pair at 0.8 shares none with probability 3e-6.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
#: Rounds with one centre for each class; what is left goes into blocks.
ROUNDS = 3
#: Documents whose full sets, or sketches, meet in one task.
BLOCK = 256
#: Sketches that agree on less than this are no link: at 0.8 that is almost five deviations away.
ESTIMATE = 0.65
PIECE = 2 << 20

_SEEDS = mix64(np.arange(1, 2 * BINS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Distinct 64-bit hashes of the runs of so many words, sorted; A-Z are lower-cased.

    A text with fewer words has its whole sequence as one shingle, one without
    words has none.
    """
    found = (text or "").encode().translate(LOWER).split()
    if not found:
        return np.zeros(0, np.uint64)
    h = hashed_words(found)
    n = max(len(h) - words + 1, 1)
    width = min(words, len(h))
    out = np.full(n, width, np.uint64)
    for j in range(width):
        out = mix64(out + h[j : j + n] * np.uint64(0x9E3779B97F4A7C15) + np.uint64(j))
    return np.unique(out)


def sketch(elements: np.ndarray) -> np.ndarray:
    """``BINS`` coordinates of a non-empty set; rounds of small sets are done many at a time."""
    bins = np.full(BINS, _EMPTY)
    done, n = 0, len(elements)
    while done < 2 * BINS:
        step = max(1, min((BINS if done < BINS else 2 * BINS) - done, 1024 // n))
        seeds = _SEEDS[done : done + step]
        h = mix64(elements[None, :] ^ seeds[:, None])
        rounds = np.arange(done, done + step, dtype=np.uint64)[:, None]
        values = rounds << np.uint64(32) | h & np.uint64(0xFFFFFFFF)
        if done < BINS:
            place = (h >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)
        else:
            place = np.broadcast_to(rounds - np.uint64(BINS), h.shape)
        np.minimum.at(bins, place.ravel().astype(np.int64), values.ravel())
        done += step
        if (bins != _EMPTY).all():
            break
    return bins


def bands_of(bins: np.ndarray) -> np.ndarray:
    """A hash of each band's coordinates and number."""
    grid = bins.reshape(BANDS, ROWS)
    out = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        out = mix64(out * np.uint64(0x9E3779B97F4A7C15) + grid[:, j])
    return out


def sketched(docs: DataFrame, words: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row, n_shingles, high, low, bands); equal sets have equal (high, low), ``row`` is a hash of the text."""
    import xxhash

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            sizes, high, low, bands = [], [], [], []
            for value in batch.column("text").to_pylist():
                elements = shingles(value, words)
                sizes.append(len(elements))
                if not len(elements):
                    high.append(None), low.append(None), bands.append(None)
                    continue
                digest = xxhash.xxh3_128_intdigest(elements.tobytes())
                high.append((digest >> 64) - (1 << 63))
                low.append((digest & (1 << 64) - 1) - (1 << 63))
                bands.append(bands_of(sketch(elements)).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("row"), pa.array(sizes, pa.int64()),
                    pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["doc_id", "row", "n_shingles", "high", "low", "bands"],
            )

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(work, "doc_id long, row long, n_shingles long, high long, low long, bands array<long>")


def _sketches(texts: DataFrame, words: int) -> DataFrame:
    """Rows (node, text, n_shingles, bins) of (node, text): 32 bits of each coordinate."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, PIECE):
            sets = [shingles(value, words) for value in batch.column("text").to_pylist()]
            bins = [(mix64(sketch(s)) & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("text"), pa.array(map(len, sets), pa.int64()), pa.array(bins, pa.binary())],
                names=["node", "text", "n_shingles", "bins"],
            )

    return texts.mapInArrow(work, "node long, text string, n_shingles long, bins binary")


def confirmed(pairs: DataFrame, texts: DataFrame, words: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough.

    Partners of one ``a`` are dealt into blocks, each with the text of ``a``, so a
    task holds at most ``BLOCK`` or so texts whatever the number of partners.
    ``texts`` has one row (node, text) per class.
    """
    many = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")), "partners")
    block = F.pmod(F.xxhash64("b"), F.ceil(F.col("n") / BLOCK)).cast("int")
    dealt = materialize(pairs.join(many, "a").select("a", "b", block.alias("block")), "pairs")
    asked = dealt.select("a", "block", F.col("b").alias("node")).union(
        dealt.select("a", "block", F.col("a").alias("node")).distinct()
    )
    held = asked.join(texts, "node")

    def work(group: pa.Table) -> pa.Table:
        a = group.column("a")[0].as_py()
        nodes, values = group.column("node").to_pylist(), group.column("text").to_pylist()
        centre = shingles(values[nodes.index(a)], words)
        linked = []
        for node, value in zip(nodes, values):
            if node != a:
                other = shingles(value, words)
                # Both are sorted and distinct: what is twice in the whole is shared.
                whole = np.concatenate([centre, other])
                whole.sort()
                shared = int((whole[1:] == whole[:-1]).sum())
                if 100 * shared >= PERCENT * (len(centre) + len(other) - shared):
                    linked.append(node)
        return pa.table({"a": pa.array([a] * len(linked), pa.int64()), "b": pa.array(linked, pa.int64())})

    return held.groupBy("a", "block").applyInArrow(work, "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Labels (node, component) after more links; components join as their members do."""
    of = lambda side: labels.select(F.col("node").alias(side), F.col("component").alias(f"{side}_of"))
    edges = links.join(of("a"), "a").join(of("b"), "b").select(F.col("a_of").alias("a"), F.col("b_of").alias("b"))
    edges = materialize(edges.where("a <> b").distinct(), "links")
    if edges.isEmpty():
        return labels
    found = components(edges)
    merged = labels.join(found.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left")
    return materialize(merged.select("node", F.coalesce("to", "component").alias("component")), "components")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (place, band, node, component, main, held, others) of buckets with two components or more.

    ``main`` is the component with the most members there, ``held`` the number of
    members and ``others`` the number outside it; ``place`` is the band's number.
    """
    known = materialize(members.join(labels, "node"), "members")
    sizes = known.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"))
    buckets = sizes.groupBy("band").agg(
        F.count(F.lit(1)).alias("parts"), F.sum("n").alias("held"), F.max_by("component", F.struct("n", "component")).alias("main"),
        (F.sum("n") - F.max("n")).alias("others"),
    )
    return known.join(materialize(buckets.where("parts > 1").drop("parts"), "buckets"), "band")


def _centre_pairs(open_: DataFrame, round_: int) -> DataFrame:
    """For each class the centre it meets most often among its buckets, if in another component."""
    order = F.xxhash64("node", F.lit(round_))
    centres = open_.groupBy("band").agg(F.min_by(F.struct("node", "component"), order).alias("centre"))
    met = open_.join(materialize(centres, "centres"), "band").where(F.col("component") != F.col("centre.component"))
    often = met.groupBy("node", F.col("centre.node").alias("other")).agg(F.count(F.lit(1)).alias("times"))
    best = often.groupBy("node").agg(F.max_by("other", F.struct("times", F.xxhash64("other"))).alias("other"))
    # The centre is a: its partners share its text.
    return best.select(F.col("other").alias("a"), F.col("node").alias("b")).distinct()


def _block_links(open_: DataFrame, sketches: DataFrame, words: int) -> DataFrame:
    """Links between two components of a bucket, enough of them to join all that are linked.

    Members are dealt into blocks, and so are those outside the main component,
    which visit every block; a task has one block of each. A pair is looked at in
    the first band it shares, and on full sets if the sketches may be similar.
    ``sketches`` has (node, text, n_shingles, bins).
    """
    deal = lambda n, seed: (F.ceil(F.col(n) / BLOCK).cast("int"), F.pmod(F.xxhash64("node", "band", F.lit(seed)), F.ceil(F.col(n) / BLOCK)).cast("int"))
    blocks, block = deal("held", 0)
    groups, group_ = deal("others", 1)
    kept = ["place", "band", "node", "component"]
    home = open_.select(*kept, block.alias("block"), F.explode(F.sequence(F.lit(0), groups - 1)).alias("group"), F.lit(False).alias("visits"))
    visits = open_.where("component <> main").select(
        *kept, F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), group_.alias("group"), F.lit(True).alias("visits")
    )
    met = home.union(visits).join(sketches, "node")

    def work(group: pa.Table) -> pa.Table:
        node, component, size = (group.column(c).to_numpy() for c in ("node", "component", "n_shingles"))
        place = group.column("place")[0].as_py()
        bins = np.frombuffer(b"".join(group.column("bins").to_pylist()), np.uint32).reshape(-1, BINS)
        visiting = np.array(group.column("visits").to_pylist())
        texts = group.column("text")
        home = np.flatnonzero(~visiting)
        component = component.copy()
        sets: dict[int, set[int]] = {}

        def set_of(i: int) -> set[int]:
            if node[i] not in sets:
                sets[node[i]] = set(shingles(texts[i].as_py(), words).tolist())
            return sets[node[i]]

        left, right = [], []
        for i in np.flatnonzero(visiting).tolist():
            at = home[component[home] != component[i]]
            at = at[100 * np.minimum(size[at], size[i]) >= PERCENT * np.maximum(size[at], size[i])]
            equal = bins[at] == bins[i]
            at = at[(equal.mean(1) >= ESTIMATE) & ~equal[:, : place * ROWS].reshape(len(at), place, ROWS).all(2).any(1)]
            for j in at.tolist():
                if component[j] == component[i]:
                    continue
                shared = len(set_of(i) & set_of(j))
                if 100 * shared >= PERCENT * (int(size[i]) + int(size[j]) - shared):
                    left.append(node[i])
                    right.append(node[j])
                    component[component == component[j]] = component[i]
        return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})

    return met.groupBy("band", "block", "group").applyInArrow(work, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, row, n_shingles, component_id, kept), one for each row of ``docs``.

    ``component_id`` is the least id reachable over links, ``kept`` whether it is
    the own one; ``row`` is a hash of the text. A row without words is linked with
    nothing. A set that only rows without an id have is linked with nothing, and
    such rows are kept; with other rows of the same set a row without an id is
    not. Of several texts under one id, links are confirmed on the least.
    """
    found = materialize(sketched(docs, words, key, text), "sketches")
    classes = materialize(
        found.where(F.col("high").isNotNull()).groupBy("high", "low").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")),
        "classes",
    )
    members = classes.where(F.col("node").isNotNull()).select("node", F.posexplode("bands").alias("place", "band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band")
    members = materialize(members.join(materialize(shared, "bands"), "band"), "members")
    nodes = materialize(members.select("node").distinct(), "nodes")
    rows = docs.select(F.col(key).alias("node"), F.col(text).alias("text"))
    texts = materialize(rows.join(nodes, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
    labels = nodes.select("node", F.col("node").alias("component"))
    for round_ in range(ROUNDS):
        open_ = materialize(_open_buckets(members, labels), "open")
        pairs = materialize(_centre_pairs(open_, round_), "candidates")
        labels = _joined(labels, confirmed(pairs, texts, words))
    open_ = materialize(_open_buckets(members, labels), "open")
    left = texts.join(open_.select("node").distinct(), "node", "left_semi")
    labels = _joined(labels, _block_links(open_, materialize(_sketches(left, words), "sketches"), words))
    named = classes.select("high", "low", "node").join(labels, "node", "left").select(
        "high", "low", F.coalesce("component", "node").alias("component_id")
    )
    judged = found.drop("bands").join(materialize(named, "classes"), ["high", "low"], "left")
    component = F.coalesce("component_id", "doc_id")
    return judged.select(
        "doc_id", "row", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )


@passengers()
def dedup(docs: DataFrame, words: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each group, with the columns it came with, of any name; of rows equal in id and text, one."""
    gone = near_duplicates(docs, words, key, text).where(~F.col("kept")).select(
        F.col("doc_id").alias("_id"), F.col("row").alias("_gone")
    ).distinct()
    rows = docs.withColumn("_row", F.xxhash64(text))
    same = F.col(f"`{key}`").eqNullSafe(F.col("_id")) & (F.col("_row") == F.col("_gone"))
    return rows.join(gone, same, "left_anti").dropDuplicates([key, "_row"]).drop("_row")
