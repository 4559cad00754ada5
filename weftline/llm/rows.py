"""Vectorised text primitives shared by the corpus operators.

Everything here works on one Arrow batch at a time: the UTF-8 bytes of many documents lie in one
NumPy array and are tokenised, hashed and windowed together, so the per-document cost is a few
slices.  Chunks hold about ``CHUNK_BYTES`` of text (one longer document makes a chunk of its own),
which bounds the memory of a worker.
"""

from __future__ import annotations

import ctypes
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK_BYTES = 1 << 20
U64 = np.uint64

#: space, tab, line feed, vertical tab, form feed, carriage return
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser on an array of uint64."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit numbers."""
    return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = stream(11, 256)
_powers = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def powers(kind: str, n: int) -> np.ndarray:
    """Powers of the hash base ("up") or of its inverse ("down"); the table grows when asked."""
    if len(_powers[kind]) < n:
        size = 1 << max(16, int(n - 1).bit_length())
        steps = np.full(size, _BASE if kind == "up" else _BASE_INV, U64)
        steps[0] = U64(1)
        _powers[kind] = np.multiply.accumulate(steps)
    return _powers[kind]


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of ``values[start:end]`` for many spans, equal for equal contents wherever they lie."""
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * powers("up", len(values) + 1)[: len(values)], out=total[1:])
    return mix((total[ends] - total[starts]) * powers("down", len(values) + 1)[starts] + (ends - starts).astype(U64))


class Chunk:
    """Some consecutive documents: ``data`` is their text, ``bounds`` the byte where each begins."""

    def __init__(self, first: int, data: np.ndarray, bounds: np.ndarray):
        self.first, self.data, self.bounds = first, data, bounds

    def __len__(self) -> int:
        return len(self.bounds) - 1


try:
    _trim = ctypes.CDLL(None).malloc_trim
except (OSError, AttributeError):  # another C library
    _trim = None


def give_back() -> None:
    """Return freed memory to the system: a worker outlives its task, and others share its machine."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK_BYTES, rows: int = 1 << 20) -> Iterator[Chunk]:
    """Chunks of a string column, of about ``limit`` bytes and at most ``rows`` texts; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    buffers = column.buffers()
    bounds = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = min(at + rows, max(at + 1, int(np.searchsorted(bounds, bounds[at] + limit, "right")) - 1))
        yield Chunk(at, data[bounds[at] : bounds[to]], bounds[at : to + 1] - bounds[at])
        at = to
    give_back()


def words(chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs without ASCII white space), and the first word of each document."""
    n = len(chunk.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(chunk) + 1, np.int64)
    inside = np.zeros(n + 2, bool)
    np.logical_not(SPACE[chunk.data], out=inside[1:-1])
    edge = np.zeros(n + 1, bool)
    edge[chunk.bounds] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, chunk.bounds)


def word_hashes(chunk: Chunk, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of the words, A-Z lower-cased."""
    if not len(starts):
        return np.zeros(0, U64)
    return span_hashes(_BYTE[LOWER[chunk.data] if lower else chunk.data], starts, ends)


_SHINGLE = stream(23, 64) | U64(1)


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive words, across document borders too."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = hashes[:n] * _SHINGLE[0]
    for j in range(1, width):
        out += hashes[j : j + n] * _SHINGLE[j]
    return mix(out)


def shingle_sets(hashes: np.ndarray, firsts: np.ndarray, width: int = 5) -> Iterator[np.ndarray]:
    """Per document its sorted distinct shingles; with fewer words, all of them as one; without words, none."""
    full = windows(hashes, width)
    for a, b in zip(firsts[:-1].tolist(), firsts[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(full[a : b - width + 1])
        elif b > a:
            yield mix(np.array([(hashes[a:b] * _SHINGLE[: b - a]).sum(dtype=U64) + U64(b - a)], U64))
        else:
            yield np.zeros(0, U64)


def chars_before(chunk: Chunk) -> np.ndarray:
    """For each byte of the chunk, and its end, how many code points begin before it."""
    out = np.zeros(len(chunk.data) + 1, np.int64)
    np.cumsum((chunk.data & 0xC0) != 0x80, out=out[1:])
    return out


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from concatenated values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def blobs(arrays: list[np.ndarray]) -> pa.Array:
    return pa.array([a.tobytes() for a in arrays], pa.binary())


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``.  Where it names none, one on this machine if the session
    runs in a single process (as in tests), and an error otherwise: executors would not share it."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (at or f"file://{tempfile.gettempdir()}/checkpoints").rstrip("/")


def steady(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in ``spark.checkpoint.dir``, which executors share."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    cut = df.checkpoint()
    driver_gives_back(df.sparkSession)
    return cut


def driver_gives_back(spark: SparkSession) -> bool:
    """Return memory that the driver's JVM has freed to the system, and say whether it could, as ``give_back`` does in a worker.

    Each plan leaves freed blocks in the C library's arenas, one or more for each of some hundred threads, and a heap that grew under
    load stays large.  The heap is collected only where more than half of what it may have is taken.  A JVM that cannot
    trim goes without.
    """
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    heap = jvm.java.lang.Runtime.getRuntime()
    if 2 * heap.totalMemory() > heap.maxMemory():
        jvm.java.lang.System.gc()
    of = jvm.java.lang.Class.forName
    string, names = of("java.lang.String"), of("[Ljava.lang.String;")
    kinds, values = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    kinds[0], kinds[1], kinds[2], kinds[3] = of("javax.management.ObjectName"), string, of("[Ljava.lang.Object;"), names
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        of("javax.management.MBeanServer").getMethod("invoke", kinds).invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:  # another JVM, or another C library
        return False
    return True


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Long texts make large Arrow batches: hold fewer rows in each, unless the session has chosen fewer.

    This sets an option of the session and leaves it so, as plans read it when they run.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) in (0, 10000) or int(spark.conf.get(key)) > rows:
        spark.conf.set(key, rows)


#: ids that a broadcast may hold: 8 MB of longs
BROADCAST_IDS = 1_000_000


def of_ids(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among ``ids`` (one column, distinct, checkpointed): broadcast when
    a count shows that they fit, a shuffled semi join otherwise."""
    few = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


#: rows of one key beyond which a join deals them over several tasks
HOT = 500


def dealt_join(many: DataFrame, one: DataFrame, key: list[str], by: str, how: str = "inner", hubs: DataFrame | None = None, hot: int | None = None) -> DataFrame:
    """``many`` joined with ``one`` on ``key``, no key being more than about ``hot`` rows of ``many`` to a task.

    Rows of a key that ``many`` holds oftener are dealt over parts by the column ``by``; the rows of ``one`` with that key
    are repeated for each part.  ``hubs`` (key, n) may give the counts.  There are at most rows / hot such keys: they are
    broadcast, and ``hot`` grows until they number BROADCAST_IDS at most.  ``how`` is inner or left.  Null keys match nothing.
    """
    hot = hot or HOT
    counted = hubs if hubs is not None else many.groupBy(*key).agg(F.count("*").alias("n"))
    found = counted.where(F.col("n") > hot).select(*key, "n")
    while (size := found.count()) > BROADCAST_IDS:
        hot *= 4
        found = found.where(F.col("n") > hot)
    if not size:
        return many.join(one, key, how)
    parts = F.broadcast(found.select(*key, F.ceil(F.col("n") / hot).alias("_parts")))
    some = F.coalesce("_parts", F.lit(1))
    left = many.join(parts, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), some)).drop("_parts")
    right = one.join(parts, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), some - 1))).drop("_parts")
    return left.join(right, [*key, "_part"], how).drop("_part")
