"""Sharding by fixed virtual slots.

Records are hashed into a fixed number of slots. Bytes are added up per slot,
and a small map says which shard holds each slot. The map has versions: the
first deals slots out in turn, a rebalancing edits it by moving slots, and each
version is stored, so a reader knows where rows were at any time and the next run
goes on from the last one. A row never
changes its slot, so only the map, a few thousand rows, is worked on in the
driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lotwise.sources.workspace import materialize, new_path

SLOTS = 4096
SHARDS = 8

Map = dict[int, int]


def slot_of(*columns: Column, slots: int = SLOTS) -> Column:
    """The record's virtual slot: it depends on the values alone."""
    return F.pmod(F.xxhash64(*columns), F.lit(slots)).cast("int")


def first_map(slots: int = SLOTS, shards: int = SHARDS) -> Map:
    """Version 1: slots dealt out in turn."""
    return {slot: slot % shards for slot in range(slots)}


def rebalance(current: Map, sizes: dict[int, int], shards: int, into: int | None = None) -> Map:
    """The next version: slots moved from the fullest to the emptiest shard.

    Each move takes the slot nearest to half the gap; it ends when no move makes
    the gap smaller. With ``into``, slots move to that shard alone, as when one is
    added.
    """
    edited = dict(current)
    load = [0] * shards
    held: list[list[tuple[int, int]]] = [[] for _ in range(shards)]
    for slot, shard in sorted(edited.items()):
        size = sizes.get(slot, 0)
        load[shard] += size
        if size:
            held[shard].append((size, slot))
    for _ in range(len(edited) * 4):
        high = max(range(shards), key=lambda s: (load[s], -s))
        low = min(range(shards), key=lambda s: (load[s], s)) if into is None else into
        gap = load[high] - load[low]
        movable = [x for x in held[high] if x[0] < gap]
        if not movable:
            break
        size, slot = min(movable, key=lambda x: (abs(2 * x[0] - gap), x[1]))
        held[high].remove((size, slot))
        held[low].append((size, slot))
        load[high] -= size
        load[low] += size
        edited[slot] = low
    return edited



def edit(current: Map, sizes: dict[int, int], shards: int) -> Map:
    """The next version for a number of shards, which may be another than before.

    New shards take slots from the others, and no other slot moves. Slots of shards
    that are gone go to the emptiest ones, the largest first. With as many shards
    as before, slots are rebalanced.
    """
    before = max(current.values(), default=-1) + 1
    if shards > before:
        for new in range(before, shards):
            current = rebalance(current, sizes, new + 1, into=new)
        return current
    if shards == before:
        return rebalance(current, sizes, shards)
    edited = {slot: shard for slot, shard in current.items() if shard < shards}
    load = [0] * shards
    for slot, shard in edited.items():
        load[shard] += sizes.get(slot, 0)
    for slot in sorted(current.keys() - edited.keys(), key=lambda s: (-sizes.get(s, 0), s)):
        low = min(range(shards), key=lambda s: (load[s], s))
        edited[slot] = low
        load[low] += sizes.get(slot, 0)
    return edited


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the versions that are stored whole: what a writer that was killed left is none."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    made = [f.getPath() for f in files.listStatus(folder) if f.getPath().getName().startswith("version=")]
    whole = [f for f in made if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(f.getName().partition("=")[2]) for f in whole)


def load(spark: SparkSession, path: str, version: int | None = None) -> Map:
    """A stored version, the last one by default: one row per slot."""
    version = versions(spark, path)[-1] if version is None else version
    rows = spark.read.schema("virtual_slot int, shard int").parquet(f"{path}/version={version}").collect()
    return {r.virtual_slot: r.shard for r in rows}


def store(spark: SparkSession, path: str, version: int, content: Map) -> None:
    """Write a version beside the others. What a killed writer left under its number is replaced."""
    if version in versions(spark, path):
        raise ValueError(f"version {version} of the slot map is stored already: {path}")
    rows = spark.createDataFrame(sorted(content.items()), "virtual_slot int, shard int")
    rows.coalesce(1).write.mode("overwrite").parquet(f"{path}/version={version}")


def current(spark: SparkSession, path: str, sizes: dict[int, int], shards: int, slots: int) -> tuple[int, Map]:
    """The version that rows of these sizes go by: the last one stored, edited, and stored if that moved a slot.

    Where none is stored, the first deals slots out in turn.
    """
    if not versions(spark, path):
        store(spark, path, 1, first_map(slots, shards))
    number = versions(spark, path)[-1]
    last = load(spark, path, number)
    if last.keys() != set(range(slots)):
        raise ValueError(f"the slot map has {len(last)} slots and not {slots}: {path}")
    edited = edit(last, sizes, shards)
    if edited == last:
        return number, last
    store(spark, path, number + 1, edited)
    return number + 1, load(spark, path, number + 1)


def assign(
    docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, key: str = "doc_id", text: str = "text", map_path: str | None = None
) -> DataFrame:
    """Each row's size, checksum, virtual slot, shard and place in the shard.

    ``map_path`` is where the versions of the slot map are: the last one is edited for
    these rows and this number of shards, and stored as the next. Without it the map
    starts anew and goes with the session.

    Shards get near equal numbers of bytes; a row's size is its UTF-8 bytes (a
    null text has none) plus one. A slot is given by id and text, so null ids
    spread by text; equal rows are counted before they are sorted, and so take
    one row in the shuffle however many they are. Places run from 0 in every
    shard without gaps, ordered by slot, id, size and checksum. Other columns are
    left behind. An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        slot_of(F.col(key), F.col(text), slots=slots).alias("virtual_slot"),
    )
    tallies = materialize(
        rows.groupBy("virtual_slot", "doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("copies")), "sized"
    )
    # At most one row per slot.
    per_slot = tallies.groupBy("virtual_slot").agg(
        F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("rows")
    ).collect()
    sizes = {r.virtual_slot: r.bytes for r in per_slot}
    counts = {r.virtual_slot: r.rows for r in per_slot}
    version, latest = current(spark, map_path or new_path(spark, "slot-map"), sizes, shards, slots)
    start, places = [0] * shards, []
    for slot, shard in sorted(latest.items()):
        places.append((slot, version, shard, start[shard]))
        start[shard] += counts.get(slot, 0)
    # One row per slot.
    placing = F.broadcast(spark.createDataFrame(places, "virtual_slot int, version int, shard int, place long"))
    by_slot = Window.partitionBy("virtual_slot").orderBy("doc_id", "size", "text_crc32")
    before = F.sum("copies").over(by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("copies")
    placed = tallies.withColumn("_before", before).join(placing, "virtual_slot")
    return placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))).select(
        "doc_id", "size", "text_crc32", "virtual_slot", "version", "shard",
        (F.col("place") + F.col("_before") + F.col("_copy")).alias("slot"),
    )
