"""What the operators share: scratch tables, words, hashes."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one step of a worker handles together; bounds memory where texts are long.
SLICE_ROWS = 512
SLICE_BYTES = 4 << 20
#: Bytes that Spark hands to a worker, and a worker takes in, at once.
BATCH_BYTES = 8 << 20

#: Bytes that are not word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` become blanks, A-Z lower case.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all run in one process it may be unset."""
    have = spark.conf.get("spark.checkpoint.dir", None)
    if not have:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        have = f"file://{tempfile.mkdtemp(prefix='lodestrata-')}"
        spark.sparkContext.setCheckpointDir(have)
        spark.conf.set("spark.checkpoint.dir", have)
    return have.rstrip("/")


_made: list[str] = []


def scratch(spark: SparkSession, what: str) -> str:
    _made.append(f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}")
    return _made[-1]


def written(df: DataFrame, what: str, instead: list[str] | None = None) -> DataFrame:
    """df as a table in the shared folder: computed once, and still there when an executor is lost.

    instead holds the place of a table that the new one replaces and that nothing else reads: it goes, and the new place stands there.
    """
    at = scratch(df.sparkSession, what)
    df.write.parquet(at)
    if instead is not None:
        delete(df.sparkSession, instead)
        instead[:] = [at]
    return df.sparkSession.read.schema(df.schema).parquet(at)


def delete(spark: SparkSession, places: list[str]) -> None:
    """Deletes tables of `written`, in any file system that Spark reaches."""
    for at in list(places):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        if at in _made:
            _made.remove(at)


def release(spark: SparkSession) -> None:
    """Deletes all that `written` has left behind, for when every result has been read."""
    delete(spark, _made)


#: A table of so many rows of a few numbers is under 100 MB in a join.
SMALL_ROWS = 1_000_000


def small_or_shuffled(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """df for the other side of a join with texts: broadcast if it has at most so many rows, else both sides are shuffled.

    df should be a written table, for its rows are counted (no further than the bound).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key with more than this share of all rows is hot; there are at most 1 / HOT of them.
HOT = 1e-3


def meet(rows: DataFrame, groups: DataFrame, by: list[str], how: str = "inner", small: int = SMALL_ROWS) -> DataFrame:
    """rows with the columns of groups (a written table of by, hot and more): by a broadcast if groups are few, else of the hot ones alone.

    So no hot key's rows are dealt out by the key. A key is hot or not in all its rows of groups, and never null in them.
    """
    if groups.limit(small + 1).count() <= small:
        return rows.join(F.broadcast(groups), by, how)
    hot = F.broadcast(groups.where("hot"))
    cold = rows.join(F.broadcast(groups.where("hot").select(*by).distinct()), by, "left_anti").join(groups.where("NOT hot"), by, how)
    return rows.join(hot, by).unionByName(cold)


def shuffles(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def by_part(df: DataFrame, *order: str) -> DataFrame:
    """df with each part's rows together, and parts of the column `part` dealt out evenly: by their number, not by its hash."""
    n = shuffles(df.sparkSession)
    return df.repartitionById(n, F.pmod("part", F.lit(n)).cast("int")).sortWithinPartitions("part", *order)


def filesystem(uri: str):
    """The pyarrow file system of a URI, and the path in it."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), re.sub("^/+", "/", parts.path)
    return fs.FileSystem.from_uri(uri)


def in_batches(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema) in batches of BATCH_BYTES or what the session says, whatever the rows hold; the session keeps that limit."""
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(limit, None) is None:
        df.sparkSession.conf.set(limit, str(BATCH_BYTES))
    return df.mapInArrow(run, schema)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in steps of at most so many rows and, but for a single long row, so many bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            n = min(rows, batch.num_rows - at)
            while n > 1 and batch.slice(at, n).nbytes > size:
                n = (n + 1) // 2
            yield batch.slice(at, n)
            at += n


def with_rows(docs: DataFrame, *columns: str) -> DataFrame:
    """docs as one column `row`, and beside it as strings those of columns that are not strings there, or null ones for what is not there."""
    have = dict(docs.dtypes)
    more = [F.col(c).cast("string").alias(c) if c in have else F.lit(None).cast("string").alias(c) for c in columns if have.get(c) != "string"]
    return docs.select(F.struct("*").alias("row"), *more)


def of_rows(batch: pa.RecordBatch, column: str) -> pa.Array:
    """A column of `with_rows`."""
    return batch.column(column) if column in batch.schema.names else batch.column("row").field(column)


def text_bytes(batch: pa.RecordBatch | pa.Array, column: str = "text") -> list[bytes]:
    """The UTF-8 of a string column; null is empty."""
    strings = batch.column(column) if isinstance(batch, pa.RecordBatch) else batch
    return [x or b"" for x in strings.cast(pa.binary()).to_pylist()]


def word_hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word. Hashing anew is faster than remembering, and takes no memory."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


_kept: list = []


def kept(cache):
    """cache, which this worker keeps between tasks until another operator's task runs in it."""
    if not any(x is cache for x in _kept):
        _kept.append(cache)
    return cache


def forget() -> None:
    """Empties what other operators have kept in this worker."""
    for cache in _kept:
        cache.clear()


def mix(h: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the word (the public splitmix64 constants)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def runs_of(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash for each run of k consecutive items; empty if there are fewer."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + n]
    return mix(h)
