"""What the text operators share: shared storage, Arrow text blocks and vectorised words.

A *word* here is a maximal run of bytes other than space, tab, newline, vertical tab, form feed
and carriage return, which is what ``bytes.split()`` yields. Lower-casing touches A-Z only.
"""

from __future__ import annotations

import ctypes
import gc
import inspect
import posixpath
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side is broadcast only when it is known to have at most so many rows (of a few dozen bytes each).
BROADCAST_ROWS = 500_000
#: And, where rows hold texts, so many bytes.
BROADCAST_BYTES = 32 << 20
#: Text is handled in blocks of about so many bytes, so a task's memory doesn't follow its partition.
BLOCK_BYTES = 6 << 20
#: Words of more bytes are hashed one by one.
LONG_WORD = 4096

_U64 = np.uint64
_M1, _M2, _M3 = _U64(0x9E3779B97F4A7C15), _U64(0xBF58476D1CE4E5B9), _U64(0x94D049BB133111EB)
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shared_dir(spark: SparkSession) -> str:
    """A new folder that the driver and all executors see: below spark.checkpoint.dir.

    Only where that is unset and the master is local, as in tests, a temporary folder takes its place.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = "file://" + tempfile.mkdtemp(prefix="millrace-")
        spark.sparkContext.setCheckpointDir(top)
    return posixpath.join(top, f"millrace-{uuid.uuid4().hex}")


def staged(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts lineage and survives lost executors."""
    spark, path = df.sparkSession, posixpath.join(shared_dir(df.sparkSession), "t")
    df.write.parquet(path, partitionBy=partition_by)
    tidy(spark)
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out.staged_at = path
    return out


def numbered(df: DataFrame, by: list[Column], at: str) -> DataFrame:
    """``df`` with each row's place (from 1) in the order ``by`` in a column ``at``, without a task that sees all rows.

    Rows are staged, dealt by ranges of the order, sorted in each range and staged again. A place is the row's place in its range
    and the rows of the ranges before. Equal rows are told apart by their place in the staged files, so a hot key spreads.
    """
    once = staged(df).withColumn("_own", F.monotonically_increasing_id())
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*by, F.col("_own")]
    cut = staged(once.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()).drop("_own"))
    part = F.shiftright("_at", 33)
    sizes = cut.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))  # a row for each range: as many as the partitions above
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return cut.withColumn("_part", part).join(F.broadcast(before), "_part").withColumn(at, F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).drop("_part", "_before", "_at")


def discard(table: DataFrame) -> None:
    """Delete what ``staged`` wrote, once nothing is still to be read from it."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table.staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def tidy(spark: SparkSession) -> None:
    """Collect garbage on the driver, upon which Spark deletes the shuffle files of steps that are over, and give freed memory back."""
    spark.range(1).count()  # Spark's scheduler holds on to the job before until another one ends
    gc.collect()
    _hand_back()
    spark.sparkContext._jvm.System.gc()


def released(run: Callable) -> Callable:
    """``run``, a function of Arrow data or a generator, after which the worker hands freed memory back to the system.

    Workers live on from task to task, and what one task needed at most would stay theirs.
    """
    if inspect.isgeneratorfunction(run):

        def freed(batches):
            try:
                yield from run(batches)
            finally:
                _hand_back()

    elif len(inspect.signature(run).parameters) == 1:

        def freed(rows):
            try:
                return run(rows)
            finally:
                _hand_back()

    else:

        def freed(left, right):
            try:
                return run(left, right)
            finally:
                _hand_back()

    return freed


def _hand_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


@contextmanager
def batch_rows(spark: SparkSession, n: int) -> Iterator[None]:
    """Arrow batches of at most n rows for what is run within, where rows hold much."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def small(df: DataFrame, rows: int | None) -> DataFrame:
    """``df`` marked for broadcast if its known number of rows is within the bound, else as it is."""
    return F.broadcast(df) if rows is not None and rows <= BROADCAST_ROWS else df


def sampled(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most ``n`` rows, about those with the least hash of the key: a cut on the hash first, so no task sends n rows to the driver."""
    total = df.count()
    h = F.xxhash64(F.col(key))
    if total > n:
        df = df.where(h <= F.lit(-(1 << 63) + int((1 << 64) / total * n)))
    return df.orderBy(h, key).limit(n)


def crc_mod(key: str | Column, m: int) -> Column:
    """crc32 of the key as text, modulo m; null keys count as the empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % m


def ascii_lower(text: str | Column) -> Column:
    """A-Z to a-z; all other characters stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def blocks(batches: Iterable[pa.RecordBatch], text: str, most: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut into runs of rows with about ``most`` bytes of text; a longer text is a block of its own."""
    for batch in batches:
        size = np.cumsum(_sizes(batch.column(text)))
        at = 0
        while at < batch.num_rows:
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def _sizes(arr: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def text_buffer(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The rows' bytes in one array, followed by eight zeros, and the rows' bounds in it (one more than rows). Null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        import pyarrow.compute as pc

        arr = pc.fill_null(arr, "" if pa.types.is_string(arr.type) or pa.types.is_large_string(arr.type) else b"")
    arr = arr.cast(pa.large_binary())
    offsets = np.frombuffer(arr.buffers()[1], dtype=np.int64)[arr.offset : arr.offset + len(arr) + 1]
    raw = arr.buffers()[2]
    data = np.zeros(int(offsets[-1] - offsets[0]) + 8, dtype=np.uint8)
    if raw is not None and len(data) > 8:
        data[:-8] = np.frombuffer(raw, dtype=np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


class Words:
    """The words of a block of texts: where each begins and ends, its 64-bit hash, and each row's first word."""

    def __init__(self, arr: pa.Array, lower: bool) -> None:
        data, bounds = text_buffer(arr)
        if lower:
            data = _LOWER[data]
        n = int(bounds[-1])
        word = ~_SPACE[data[:n]]
        edge = np.zeros(n + 1, dtype=bool)
        edge[bounds] = True
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = word[:-1]
        self.data = data
        self.begin = np.flatnonzero(word & (~before | edge[:n]))
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = word[1:]
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.begin, bounds)
        self.hash = self._hashed()

    def _hashed(self) -> np.ndarray:
        size = self.end - self.begin
        h = size.astype(np.uint64) * _M1
        eight = np.ndarray((max(0, len(self.data) - 7),), dtype="<u8", buffer=self.data, strides=(1,))
        live = np.arange(len(size))
        done = 0
        live = live[size <= LONG_WORD]
        while len(live):
            left = np.minimum(size[live] - done, 8)
            x = eight[self.begin[live] + done] & _MASK[left]
            y = (h[live] ^ x) * _M2
            h[live] = (y ^ (y >> _U64(29))) * _M1
            done += 8
            live = live[size[live] > done]
        for i in np.flatnonzero(size > LONG_WORD):
            h[i] = xxhash.xxh64_intdigest(self.data[self.begin[i] : self.end[i]].tobytes())
        return mixed(h)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def bytes(self, i: int) -> bytes:
        return self.data[self.begin[i] : self.end[i]].tobytes()


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    h = (h ^ (h >> _U64(30))) * _M2
    h = (h ^ (h >> _U64(27))) * _M3
    return h ^ (h >> _U64(31))


def distinct_words(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words in ascending order, one place of each, and each word's position among them."""
    return np.unique(words.hash, return_index=True, return_inverse=True)


class WordMemo:
    """Integer lists by word, kept from block to block as sorted arrays, up to ``most`` words.

    Words are told apart by a 64-bit hash. ``make`` gets the bytes of words not seen before and returns a list for each.
    """

    def __init__(self, make: Callable[[list[bytes]], list[list[int]]], most: int = 1_500_000) -> None:
        self.make, self.most = make, most
        self.clear()

    def clear(self) -> None:
        self.keys, self.start, self.size, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def lists(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each distinct word of the block the first place and number of its integers in self.flat, and each word's position among the distinct."""
        hashes, place, inverse = distinct_words(words)
        if len(self.keys) + len(hashes) > self.most:
            self.clear()
        at = np.searchsorted(self.keys, hashes)
        known = np.zeros(len(hashes), dtype=bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == hashes[inside]
        fresh = np.flatnonzero(~known)
        if len(fresh):
            made = self.make([words.bytes(i) for i in place[fresh]])
            size = np.fromiter(map(len, made), dtype=np.int32, count=len(made))
            flat = np.fromiter((x for xs in made for x in xs), dtype=np.int32, count=int(size.sum()))
            start = len(self.flat) + np.cumsum(size, dtype=np.int64) - size
            self.keys, self.start, self.size = (np.insert(old, at[fresh], new) for old, new in ((self.keys, hashes[fresh]), (self.start, start), (self.size, size)))
            self.flat = np.concatenate([self.flat, flat])
            at = np.searchsorted(self.keys, hashes)
        return self.start[at], self.size[at], inverse.reshape(-1)


def gathered(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """flat[start[i] : start[i] + size[i]] of all i, one after another."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(start - (ends - size), size) + np.arange(total)]


def filesystem(uri: str):
    """The Arrow file system of a folder that executors share, and the folder's path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)
