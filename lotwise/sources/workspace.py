"""Tables written between stages, in the folder the cluster shares.

A stage whose result is read several times is written once as parquet. Later
stages read only the columns they need, and a lost executor costs a re-read of
files, not a re-run of the stages before.

Every written table has an owner that deletes it. A job opens a ``scope``: its
tables go when the block ends, by an error too, unless a result retains the
scope; then they go when the result is closed. Tables written outside of any
scope belong to the session and go with ``clear`` or when Python ends.
"""

from __future__ import annotations

import atexit
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"


class Owner:
    """Owns written tables and counts who needs them; the last to release deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths, self.holds = spark, [], 1
        self._lock = threading.Lock()

    def add(self, path: str) -> str:
        with self._lock:
            self.paths.append(path)
        return path

    def retain(self) -> Owner:
        with self._lock:
            self.holds += 1
        return self

    def release(self) -> None:
        with self._lock:
            self.holds -= 1
            gone = self.paths if self.holds <= 0 else []
            if gone:
                self.paths = []
        for path in gone:
            delete(self.spark, path)

    def __enter__(self) -> Owner:
        return self

    def __exit__(self, *error) -> None:
        self.release()


_SCOPE: ContextVar[Owner | None] = ContextVar("scope", default=None)
_SESSIONS: dict[str, Owner] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder from whatever store it is in; one that is gone already is no error."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _session_owner(spark: SparkSession) -> Owner:
    app = spark.sparkContext.applicationId
    if app not in _SESSIONS:
        _SESSIONS[app] = Owner(spark)
        atexit.register(_clear_quietly, spark)
    return _SESSIONS[app]


def _clear_quietly(spark: SparkSession) -> None:
    with suppress(Exception):  # the session may have ended before Python
        clear(spark)


def clear(spark: SparkSession) -> None:
    """Delete every table of the session, scopes that are still held included, and its own checkpoints."""
    context = spark.sparkContext
    _SESSIONS.pop(context.applicationId, None)
    folder = shared_folder(spark)
    delete(spark, f"{folder}/lotwise/{context.applicationId}")
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/lotwise")
    files = store.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(store) and not files.listStatus(store):
        files.delete(store, False)
    if context.getCheckpointDir():
        delete(spark, context.getCheckpointDir())


@contextmanager
def scope(spark: SparkSession) -> Iterator[Owner]:
    """Own all tables that the block writes; on an error they go whoever retains them."""
    _session_owner(spark)  # what a result retains and never releases goes with the session
    owner = Owner(spark)
    outer = _SCOPE.set(owner)
    try:
        yield owner
    except BaseException:
        owner.holds = 1
        raise
    finally:
        _SCOPE.reset(outer)
        owner.release()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is set, one in the warehouse, which is shared as well."""
    context = spark.sparkContext
    folder = spark.conf.get(CHECKPOINT_DIR, None)
    if not folder and context.getCheckpointDir():
        folder = context.getCheckpointDir().rstrip("/").rpartition("/")[0]  # Spark adds a folder of its own
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has been written to, owned by the scope or else the session."""
    app = spark.sparkContext.applicationId
    path = f"{shared_folder(spark)}/lotwise/{app}/{label}-{uuid.uuid4().hex}"
    return (_SCOPE.get() or _session_owner(spark)).add(path)


def materialize(df: DataFrame, label: str = "stage", rebalance: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    ``rebalance`` shuffles the rows into files of similar size first, which pays
    when many passes follow: adaptive execution sets their number by size.
    """
    path = new_path(df.sparkSession, label)
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def held(*frames: DataFrame) -> Iterator[tuple[DataFrame, ...]]:
    """Keep frames in executor memory or disk for the length of a block."""
    mine = [df for df in frames if not df.is_cached]
    for df in mine:
        df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield frames
    finally:
        for df in mine:
            df.unpersist()
