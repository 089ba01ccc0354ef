"""Shards of token ids as little-endian unsigned 32-bit integers, as a data source.

    spark.dataSource.register(TokenShards)
    rows.write.format("token_shards").mode("append").save(folder)     # shard, offset, ids
    spark.read.format("token_shards").load(folder)                    # the same columns

A shard is a file of ids and nothing else. The writer gets slices of shards (``slices`` makes them), dealt so that a shard is one
task's, in order; ``write`` does that. Each attempt of a task writes files under names of its own; when all tasks are done, the driver
writes a manifest of the files that count, with their number of ids and sha-256. So a task that is run again, or whose executor is
lost, leaves at most a file that no manifest names, and an aborted job deletes what its tasks told of. The reader takes
the shards of the manifest, or the folder's ``*.bin`` files where there is none, some whole shards in order as a partition, and yields
slices of bounded size; it never holds a shard.
"""

from __future__ import annotations

import hashlib
import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "shard long, offset long, ids array<long>"
#: Ids that a row of the reader holds at most.
SLICE = 1 << 16
#: Ids of the shards that are read as one partition, about: a task has its own cost, so a shard may be too little for one.
GROUP = 1 << 22
MANIFEST = "manifest.json"
_LIMIT = 1 << 32


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if path.startswith("file:") or "://" in path else "file://" + posixpath.abspath(path))


@dataclass
class _Written(WriterCommitMessage):
    shards: list[dict]


@dataclass
class _Shards(InputPartition):
    #: Numbers and files.
    shards: list[tuple[int, str]]


def _grouped(shards: list[tuple[int, str, int]]) -> list[InputPartition]:
    """Partitions of whole shards (number, file, ids) in order, with ``GROUP`` ids about."""
    out, size = [], 0
    for number, file, ids in shards:
        if not out or size + ids > GROUP:
            out.append(_Shards([]))
            size = 0
        out[-1].shards.append((number, file))
        size += ids
    return out


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str) -> None:
        self.path = path

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        fs, root = _filesystem(self.path)
        done: list[dict] = []
        shard, out, digest, told = None, None, None, 0

        def close() -> None:
            if out is not None:
                out.close()
                done.append({"shard": shard, "file": name, "tokens": told, "sha256": digest.hexdigest()})

        for batch in iterator:
            shards, offsets, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
            for i, (number, offset) in enumerate(zip(shards, offsets, strict=True)):
                if number != shard:
                    close()
                    if any(x["shard"] == number for x in done):
                        raise ValueError(f"slices of shard {number} are not together")
                    shard, told, digest = number, 0, hashlib.sha256()
                    name = f"shard-{number:06d}-{uuid.uuid4().hex[:12]}.bin"
                    out = fs.open_output_stream(posixpath.join(root, name))
                values = ids[i].values
                values = np.zeros(0, np.int64) if values is None else values.to_numpy(zero_copy_only=False)
                if offset != told:
                    raise ValueError(f"shard {number} goes on at {offset}, not at {told}")
                if len(values) and (values.min() < 0 or values.max() >= _LIMIT):
                    raise ValueError(f"shard {number} has an id that is no unsigned 32-bit integer")
                raw = values.astype("<u4").tobytes()
                out.write(raw)
                digest.update(raw)
                told += len(values)
        close()
        return _Written(done)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        shards = sorted((x for m in messages if m for x in m.shards), key=lambda x: x["shard"])
        doubled = [x["shard"] for x, y in zip(shards, shards[1:], strict=False) if x["shard"] == y["shard"]]
        if doubled:
            self.abort(messages)
            raise ValueError(f"shards {doubled[:5]} were written by several tasks")
        with fs.open_output_stream(posixpath.join(root, MANIFEST)) as f:
            f.write(json.dumps({"type": "uint32", "shards": shards}, sort_keys=True).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = _filesystem(self.path)
        for x in (x for m in messages if m for x in m.shards):
            fs.delete_file(posixpath.join(root, x["file"]))


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs as pfs

        fs, root = _filesystem(self.path)
        manifest = posixpath.join(root, MANIFEST)
        if fs.get_file_info(manifest).type != pfs.FileType.NotFound:
            with fs.open_input_stream(manifest) as f:
                return _grouped([(x["shard"], x["file"], x["tokens"]) for x in json.loads(f.read())["shards"]])
        found = sorted((posixpath.basename(x.path), x.size // 4) for x in fs.get_file_info(pfs.FileSelector(root)) if x.path.endswith(".bin"))
        return _grouped([(i, name, ids) for i, (name, ids) in enumerate(found)])

    def read(self, partition: _Shards | None) -> Iterator[pa.RecordBatch]:
        for number, file in partition.shards if partition else ():  # none: a folder without shards
            yield from self._read(number, file)

    def _read(self, number: int, file: str) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(self.path)
        path = posixpath.join(root, file)
        if fs.get_file_info(path).size % 4:
            raise ValueError(f"the length of {path} is no multiple of 4")
        schema = pa.schema([("shard", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int64()))])
        offset = 0
        with fs.open_input_stream(path) as f:
            while raw := f.read(4 * SLICE):
                ids = np.frombuffer(raw, "<u4").astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([offset]), pa.array([ids], pa.list_(pa.int64()))], schema=schema)
                offset += len(ids)


class TokenShards(DataSource):
    @classmethod
    def name(cls) -> str:
        return "token_shards"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"])


def slices(placed: DataFrame, size: int, ids: str = "ids", start: str = "start") -> DataFrame:
    """(shard, offset, ids): each row's ids cut where shards of ``size`` ids end; ``start`` is the place of its first id among all."""
    n = F.size(ids)
    first, last = F.floor(F.col(start) / size), F.floor((F.col(start) + n - 1) / size)
    rows = placed.where(n > 0).select(F.col(ids).alias("_ids"), F.col(start).alias("_start"), F.explode(F.sequence(first, last)).alias("shard"))
    lo = F.greatest(F.lit(0), F.col("shard") * size - F.col("_start"))
    hi = F.least(F.size("_ids").cast("long"), (F.col("shard") + 1) * size - F.col("_start"))
    return rows.select("shard", (F.col("_start") + lo - F.col("shard") * size).alias("offset"), F.slice("_ids", (lo + 1).cast("int"), (hi - lo).cast("int")).cast("array<long>").alias("ids"))


def write(placed: DataFrame, folder: str, size: int, ids: str = "ids", start: str = "start") -> None:
    """Shards of all rows' ids in a folder that driver and executors share."""
    placed.sparkSession.dataSource.register(TokenShards)
    cut = slices(placed, size, ids, start).repartition("shard").sortWithinPartitions("shard", "offset")
    cut.write.format("token_shards").mode("append").save(_made(placed.sparkSession, folder))


def _made(spark: SparkSession, folder: str) -> str:
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    return folder


def read(spark: SparkSession, folder: str) -> DataFrame:
    """(shard, offset, ids) of the shards of a folder, in slices of at most ``SLICE`` ids."""
    spark.dataSource.register(TokenShards)
    return spark.read.format("token_shards").load(folder)


def digests(back: DataFrame) -> DataFrame:
    """(shard, tokens, ids_sha256) of what ``read`` gives: the hash of a shard's decimal ids with blanks between.

    The reader yields whole shards in a partition and in order, so its slices are hashed as they come, and nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tokens, digest = None, 0, None
        told = lambda: pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "tokens": pa.array([tokens], pa.int64()), "ids_sha256": [digest.hexdigest()]})
        for batch in batches:
            for number, offset, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if number != shard:
                    if digest is not None:
                        yield told()
                    shard, tokens, digest = number, 0, hashlib.sha256()
                if offset != tokens:
                    raise ValueError(f"shard {number} goes on at {offset}, not at {tokens}")
                part = " ".join(map(str, ids.values.to_numpy().tolist())) if len(ids) else ""
                digest.update((" " + part if tokens and part else part).encode())
                tokens += len(ids)
        if digest is not None:
            yield told()

    return back.select("shard", "offset", "ids").mapInArrow(run, "shard long, tokens long, ids_sha256 string")
