"""Helpers shared by the text operators: shared-folder tables, components, hashing."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL_ROOT: list[str] = []
_CACHES: dict[str, Callable[[], None]] = {}
_OWNER = [""]


def cache(name: str, clear: Callable[[], None]) -> None:
    """Registers a word table of this process."""
    _CACHES[name] = clear


def claim(name: str) -> None:
    """Empties the word tables of other operators: a worker that serves several
    operators in turn holds the table of one."""
    if _OWNER[0] != name:
        _OWNER[0] = name
        for other, clear in _CACHES.items():
            if other != name:
                clear()


def trim() -> None:
    """Hands freed memory back: a worker that waits for its next task keeps little."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """Hands memory that the driver's JVM has freed outside its heap back: compilers, compression
    and many threads leave hundreds of MB with the C library, which keeps them unless told."""
    jvm = spark.sparkContext._jvm
    with contextlib.suppress(Exception):  # another JVM or system
        # by its interface: the gateway cannot call the server's own class
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        told = spark.sparkContext._gateway.new_array(jvm.Object, 4)
        told[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
        told[1] = "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), told)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, for mapInPandas, with trim() at the end of each task."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        trim()

    return whole


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see.

    spark.checkpoint.dir where the session names it; else, on a single machine,
    one temporary folder per process; else a folder in the warehouse.
    """
    conf = spark.sparkContext.getConf()
    named = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        if not _LOCAL_ROOT:
            _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="cubeloom-"))
        return "file://" + _LOCAL_ROOT[0]
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_cubeloom"


_HELD: list[DataFrame | None] = []
_SENT: list = []
_SCOPES: list[None] = []
_WRITTEN: list[tuple[SparkSession, str]] = []


def stored(df: DataFrame, name: str = "t") -> DataFrame:
    """df kept for its several uses in the executors' memory and, beyond it, on their disks.

    Its lineage stays, so partitions of a lost executor are made again. scope()
    or release() lets it go. The oldest tables that others let go (clearCache) are
    forgotten, as their plans would stay in the driver.
    """
    with contextlib.suppress(Exception):  # their session may be stopped
        for i, held in enumerate(_HELD):
            if held is not None and held.storageLevel.useMemory:
                break
            _HELD[i] = None
    trim_driver(df.sparkSession)
    _HELD.append(df.persist(StorageLevel.MEMORY_AND_DISK))
    return _HELD[-1]


def sent(spark: SparkSession, value):
    """A broadcast that its scope() destroys; outside of any it goes when no plan uses it any more."""
    out = spark.sparkContext.broadcast(value)
    _SENT.append(out if _SCOPES else weakref.ref(out))
    return out


def _release(held: int, sent_: int, written_: int) -> None:
    while len(_HELD) > held:
        if (held_ := _HELD.pop()) is not None:
            with contextlib.suppress(Exception):  # its session may be stopped
                held_.unpersist()
    while len(_SENT) > sent_:
        last = _SENT.pop()
        if (value := last() if isinstance(last, weakref.ref) else last) is not None:
            with contextlib.suppress(Exception):
                value.destroy()
    while len(_WRITTEN) > written_:
        with contextlib.suppress(Exception):
            remove(*_WRITTEN.pop())


def release() -> None:
    """Lets go of all tables, broadcasts and written tables of operators of this process;
    results that were not read before cannot be read any more."""
    _release(0, 0, 0)


atexit.register(release)


@contextlib.contextmanager
def scope() -> Iterator[None]:
    """What operators keep, send and write inside is let go at the end."""
    marks = len(_HELD), len(_SENT), len(_WRITTEN)
    _SCOPES.append(None)
    try:
        yield
    finally:
        _SCOPES.pop()
        _release(*marks)
        trim()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a written table."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextlib.contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside loses its shuffle files at its end, not when the driver collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str = "t", own: bool = True) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage.

    Each partition is a file: of what was shuffled, adaptive execution makes them by
    bytes, so no task takes more as the tables grow. A table that is not the operator's
    own outlives its scope.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cubeloom/{name}-{uuid.uuid4().hex}"
    if own:
        _WRITTEN.append((spark, path))
    # A row group is held in memory until it is full: small ones, as several tasks write at once.
    with _shuffles_removed(spark):
        df.write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", "1").option("parquet.block.size", 16 << 20).parquet(path)
    trim_driver(spark)
    return spark.read.schema(df.schema).parquet(path)


def folder_of(table: DataFrame) -> str:
    """Where a written table stands."""
    return table.inputFiles()[0].rpartition("/")[0] if table.inputFiles() else ""


def held_out_column(doc_id: str = "doc_id"):
    """True for rows whose crc32(doc_id as text) mod 3 is 1."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser over an unsigned array."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def spanning_stars(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the rows and the columns of a link matrix, the first column of their component."""
    rows, cols = np.flatnonzero(mask.any(1)), np.flatnonzero(mask.any(0))
    of_row, of_col = np.full(mask.shape[0], -1), np.full(mask.shape[1], -1)
    if len(rows):
        sub = mask[np.ix_(rows, cols)]
        far = len(cols)
        lab = np.arange(far)
        while True:
            r = np.where(sub, lab, far).min(1)
            new = np.minimum(lab, np.where(sub, r[:, None], far).min(0))
            if (new == lab).all():
                break
            lab = new
        of_row[rows], of_col[cols] = cols[r], cols[lab]
    return of_row, of_col


def labelled_sample(docs: DataFrame, labels: DataFrame, target: str, per_class: int, seed: int, most_chars: int):
    """(texts, y) to learn from: at most per_class rows of each label, one of a doc_id,
    and no text longer than most_chars: 2 * per_class * most_chars characters at most.

    Rows in the held-out third, with a null label or a label that is neither 0
    nor 1 are left out. The pick follows a hash of doc_id: the same on every run.
    """
    lab = labels.where(~held_out_column() & F.col(target).isin(0, 1)).select("doc_id", F.col(target).alias("y"))
    key = F.xxhash64(F.col("doc_id"), F.lit(seed))
    pick = None
    for y in (0, 1):
        part = lab.where(F.col("y") == y).orderBy(key, "doc_id").limit(per_class)
        pick = part if pick is None else pick.unionByName(part)
    # at most 2 * per_class rows of two integers: bounded, so it may be broadcast
    short = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where(F.length("text") <= most_chars)
    got = short.join(F.broadcast(pick.distinct()), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    rows = got.toPandas().sort_values(["doc_id", "y"], kind="stable")
    return rows["text"].tolist(), rows["y"].to_numpy(np.float64)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def cores(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, 1)
