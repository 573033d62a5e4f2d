"""What the operators of this package share: session settings, scratch tables, Arrow batches of whole texts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import fresh_dir, prepare_session

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: A word, in Java's and in Python's syntax.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch: whole texts may be long, so batches are kept short.
BATCH_ROWS = 512


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under a name, with SQL where SQL can say it."""

    def wrap(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def prepare(spark: SparkSession) -> SparkSession:
    prepare_session(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Scratch:
    """Stage tables of one run under the shared folder; ``drop`` deletes those that nothing reads any more."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.root, self.paths, self.count = spark, fresh_dir(spark, label), {}, 0

    def write(self, df: DataFrame) -> DataFrame:
        """Write and read back: cuts the lineage at files that survive lost executors."""
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *dfs: DataFrame) -> None:
        for df in dfs:
            _, path = self.paths.pop(id(df))
            jvm = self.spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def tidy(run):
    """Wrap a function over Arrow batches: when its task ends, the worker gives its free memory back.

    Workers live on between tasks, and several stand beside one executor's heap.
    """
    def wrapped(batches):
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def parts_for(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def text_slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows of about ``limit`` bytes (one row at least).

    Gives first row, end row, the runs' UTF-8 bytes and the rows' offsets in them; a null text has no bytes.
    """
    column = column.fill_null("")
    if pa.types.is_string(column.type):
        column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(n, max(end, at + 1))
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end


_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mix (splitmix64's finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    one = np.uint64(1)
    if not _POWERS or len(_POWERS[0]) < n:
        inverse, size = pow(_BASE, -1, 1 << 64), 1 << max(12, n - 1).bit_length()
        for base in (_BASE, inverse):
            with np.errstate(over="ignore"):
                _POWERS.append(np.cumprod(np.concatenate([[one], np.full(size - 1, base, np.uint64)])))
        _POWERS[:] = _POWERS[-2:]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of a run of texts, and each word's row.

    A word's hash is a polynomial over its bytes (from prefix sums), mixed with its length.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    byte = data
    if lower:
        byte = np.where((data >= 65) & (data <= 90), data + 32, data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = inside[cuts]  # a text starts a new word
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    power, inverse = _powers(len(data))
    value = np.where(inside, byte + np.uint64(1), np.uint64(0)) * power
    sums = np.concatenate([[np.uint64(0)], np.cumsum(value)])
    bounds = np.append(starts, len(data))
    long = np.add.reduceat(inside, starts).astype(np.uint64)
    h = (sums[bounds[1:]] - sums[starts]) * inverse[starts]
    rows = np.searchsorted(offsets, starts, "right") - 1
    return mix64(h ^ mix64(long)), rows
