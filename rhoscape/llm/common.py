"""Shared pieces of the training-data operators: Arrow plumbing, shared storage and hash kernels."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
_C = ctypes.CDLL(None)
#: Bytes that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
SEPARATORS = b" \t\n\x0b\x0c\r"
#: Bytes of text that one vectorised pass takes at most, unless a single word is longer.
CHUNK_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the cluster's shared folder. Only a local session, which is one machine, may go without one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def _located(spark: SparkSession, name: str):
    """The file system and path that a name stands for."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


class Lease:
    """Tables behind lazily evaluated results: they go when the lease ends, or with the application outside of any."""

    held: list[list[str]] = []

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> "Lease":
        self.held.append([])
        return self

    def __exit__(self, *_) -> None:
        for name in self.held.pop():
            system, path = _located(self.spark, name)
            system.delete(path, True)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Cut lineage by writing a table to shared storage, where any executor can read it again."""
    spark = df.sparkSession
    name = shared_path(spark, label)
    df.write.parquet(name)
    if Lease.held:
        Lease.held[-1].append(name)
    else:
        system, path = _located(spark, name)
        system.deleteOnExit(path)
    return spark.read.parquet(name)


class Scratch:
    """Tables in shared storage that are deleted when a computation's result no longer needs them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.names = spark, []

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        name = shared_path(self.spark, label)
        self.names.append(name)
        df.write.parquet(name)
        return self.spark.read.parquet(name)

    def release(self) -> None:
        """Delete the tables held, and let Spark delete shuffle files that no plan refers to any more.

        Spark does the latter when the driver's garbage collector has found the plans unreachable, by itself every
        half hour; a long job's shuffle files would pile up.
        """
        for name in self.names:
            system, path = _located(self.spark, name)
            system.delete(path, True)
        self.names.clear()
        self.spark.sparkContext._jvm.System.gc()

    def leave(self) -> None:
        """Let the tables held go with the application, as a lazily evaluated result still reads them."""
        for name in self.names:
            system, path = _located(self.spark, name)
            system.deleteOnExit(path)
        self.names.clear()

    def __enter__(self) -> "Scratch":
        return self

    def __exit__(self, *_) -> None:
        self.release()


def fresh_name(df: DataFrame, stem: str) -> str:
    """A column name that none of df's columns has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    name, k = stem, 0
    while name.lower() in taken:
        name, k = f"{stem}{k}", k + 1
    return name


def quoted(name: str):
    """A column by its whole name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def crc_mod(column: str, modulus: int):
    """Remainder of the CRC-32 of a column's decimal text; null ids count as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % modulus


#: How to empty the caches that modules keep in a Python worker.
CACHES: dict[str, Callable[[], None]] = {}


_owner: list[str] = [""]


def settle() -> None:
    """Give free memory back to the system; a worker that lives through many stages would hold the most it ever used."""
    pa.default_memory_pool().release_unused()
    if hasattr(_C, "malloc_trim"):
        _C.malloc_trim(0)


def claim(owner: str) -> None:
    """Empty the caches of all modules but one; workers live through many stages, their memory is shared by few."""
    if _owner[0] != owner:
        for module, clear in CACHES.items():
            if module != owner:
                clear()
        settle()
        _owner[0] = owner


#: Rows and bytes of an Arrow batch; a longer text is a batch of its own.
BATCH_ROWS, BATCH_BYTES = 256, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches to BATCH_ROWS rows and BATCH_BYTES bytes, unless they are smaller already.

    Spark reads both settings when a plan is executed, so they stay as they are set here.
    """
    for name, bound in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        if not 0 < int(spark.conf.get(name).rstrip("b")) <= bound:
            spark.conf.set(name, bound)


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema: str) -> DataFrame:
    """mapInArrow with a per-task set-up: make() runs once in each task and returns the batch function."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim(make.__module__)
        step = make()
        for batch in batches:
            out = step(batch)
            if out is not None and out.num_rows:
                yield out
        settle()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """A text column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def raw(batch: pa.RecordBatch, column: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """A text column as one byte buffer and the offsets of its rows; null rows are empty."""
    values = batch.column(column).cast(pa.large_binary()).fill_null(b"")
    bounds = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1 + values.offset)[values.offset :]
    data = values.buffers()[2]
    buffer = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buffer[bounds[0] : bounds[-1]], bounds - bounds[0]


class Generations:
    """A bounded cache of two generations: when the new one is full it becomes the old one, and what is used moves on."""

    def __init__(self, size: int) -> None:
        self.size, self.new, self.old = size, {}, {}

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def find(self, key):
        """The value of a key in either generation, or None."""
        value = self.new.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising scrambler on unsigned 64-bit values."""
    x = x ^ (x >> U64(31))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(29))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(32))


class Rolling:
    """Polynomial hashes of any stretch of a byte buffer from its prefix sums, modulo 2**64."""

    def __init__(self, seed: int = 20240229) -> None:
        draw = np.random.default_rng(seed)
        self.codes = draw.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
        self.base = int(draw.integers(1, 2**62, dtype=np.uint64)) * 4 + 3
        self.inverse = pow(self.base, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) <= n:
            n = max(n + 1, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(n, U64(b))
                steps[0] = 1
                setattr(self, name, np.cumprod(steps))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        self.reach(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[: len(data)], out=sums[1:])
        return sums

    def stretch(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((sums[end] - sums[start]) * self.down[start] + (end - start).astype(np.uint64))


_ROLLING = Rolling()
_IS_SEPARATOR = np.zeros(256, bool)
_IS_SEPARATOR[list(SEPARATORS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def cuts(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about limit bytes each; a longer row stands alone."""
    first = 0
    while first < len(bounds) - 1:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + limit, "right")) - 1)
        yield first, last
        first = last


def word_spans(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = _IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of non-separators, broken at row bounds."""
    inside = ~separator[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[bounds] = True
    before = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    after = np.concatenate([inside[1:], [False]]) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends


def parts(data: np.ndarray, bounds: np.ndarray, separator: np.ndarray = _IS_SEPARATOR) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with their bytes and inner bounds, about CHUNK_BYTES each; a longer row comes in parts cut between words."""
    for first, last in cuts(bounds):
        place, high = int(bounds[first]), int(bounds[last])
        while place < high:
            stop = high
            if last == first + 1 and high - place > CHUNK_BYTES:
                stop = place + CHUNK_BYTES
                while stop < high and not separator[data[stop]]:
                    stop += 1
            yield first, last, data[place:stop], np.clip(bounds[first : last + 1], place, stop) - place
            place = stop


def word_hashes(data: np.ndarray, bounds: np.ndarray, lower: bool = True, separator: np.ndarray = _IS_SEPARATOR) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all rows in order, and each row's first place among them."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(bounds), np.int64)
    for first, last, part, inner in parts(data, bounds, separator):
        starts, ends = word_spans(part, inner, separator)
        hashes.append(_ROLLING.stretch(_ROLLING.prefix(_LOWER[part] if lower else part), starts, ends))
        counts[first + 1 : last + 1] += np.diff(np.searchsorted(starts, inner))
    return np.concatenate(hashes), np.cumsum(counts)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of size words; fewer words count as one run, none as no run."""
    if not len(words):
        return words
    width = min(size, len(words))
    n = len(words) - width + 1
    total = np.full(n, U64(width))
    for k in range(width):
        total = mix(total * U64(0x9E3779B97F4A7C15) + words[k : k + n])
    return np.unique(total)
