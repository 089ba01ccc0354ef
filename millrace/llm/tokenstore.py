"""Token ids in compressed binary files with one shared dictionary.

A zstandard dictionary is trained on serialized id arrays of a bounded sample of documents. Each
document's ids are compressed alone with it, so that one short document can be read without its
neighbours. Files hold documents in ascending id order, and files follow each other in that order:

    magic (8 bytes), id width in bytes (u32), sha-256 of the dictionary (32 bytes)
    one zstandard frame per document (ids little-endian)
    index: per document doc_id (i64), place (u64), bytes (u32), ids (u32)
    place of the index (u64), documents (u64), magic (8 bytes)

Beside the files lie the dictionary and a manifest of the files that finished tasks wrote; files that
lost or repeated tasks left are not in it and are not read.

Null texts are empty: their only id is the end id. Null doc_ids sort first and are stored as the
smallest integer. Repeated rows are stored as often as they come; equal ids keep no given order. An empty table gives an empty
store, and an empty result. A very long text is a block of its own and takes about 60 times its bytes of a worker's
memory. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordMemo, Words, blocks, filesystem, gathered, released, sampled, shared_dir

MAGIC = b"TOKZ0001"
_HEAD, _TAIL = "<8sI32s", "<QQ8s"
_ENTRY = np.dtype([("doc_id", "<i8"), ("place", "<u8"), ("bytes", "<u4"), ("ids", "<u4")])
NULL_ID = -(1 << 63)
#: The dictionary is trained on at most so many documents (those with the least hash of their id), so many characters of each.
SAMPLE_DOCS, SAMPLE_CHARS, DICTIONARY_BYTES = 1000, 4000, 64 << 10
#: Texts are encoded in blocks of about so many bytes.
BLOCK_BYTES = 2 << 20
#: Bytes of text a file is made of, about.
FILE_BYTES = 32 << 20
LEVEL = 3


class LibraryEncoder:
    """Texts to ids with the tokenizers library.

    Tokenizers whose pieces never hold white space get each distinct word once; words are remembered.
    Others get whole texts.
    """

    def __init__(self, spec: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_padding()
        self.tok.no_truncation()
        self.by_word = '"Split"' in spec and '"behavior":"Removed","invert":true' in spec.replace(" ", "").replace("\n", "")
        self.memo = WordMemo(self._many, 1_000_000)
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4

    def _many(self, words: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.tok.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def block(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_word:
            lists = [e.ids for e in self.tok.encode_batch([x or "" for x in arr.to_pylist()], add_special_tokens=False)]
            size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            return np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(size.sum())), size
        words = Words(arr, lower=False)
        start, size, inverse = self.memo.lists(words)
        each = size[inverse].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        return gathered(self.memo.flat, start[inverse], each), np.diff(total[words.first])


_LOADED: dict[int, LibraryEncoder] = {}


def _encoder(spec: str) -> LibraryEncoder:
    if hash(spec) not in _LOADED:
        _LOADED[hash(spec)] = LibraryEncoder(spec)
    return _LOADED[hash(spec)]


def _passage(text: Column, id: Column) -> Column:
    """SAMPLE_CHARS characters from a place anywhere in the text, which the id decides."""
    return F.substr(text, (1 + F.pmod(F.xxhash64(id), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS + 1))).cast("int"), F.lit(SAMPLE_CHARS))


def train_dictionary(docs: DataFrame, spec: str, end_id: int, doc_id: str, text: str) -> bytes:
    """The shared dictionary; where there is too little to train on, the sample itself, of which what comes last is best to refer to."""
    sample = sampled(docs.select(F.col(doc_id).alias("id"), _passage(F.col(text), F.col(doc_id)).alias("t")), "id", SAMPLE_DOCS).where("t is not null").select("t").collect()
    enc = _encoder(spec)
    samples = []
    for r in sample:
        ids, _ = enc.block(pa.array([r.t]))
        samples.append(np.append(ids, end_id).astype(f"<u{enc.width}").tobytes())
    if not samples:
        return b""
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 10)
    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except (zstandard.ZstdError, ValueError):
        raw = b"".join(samples)[-DICTIONARY_BYTES:]
        return raw if len(raw) >= 8 else b""


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc_id: str = "doc_id", text: str = "text", partitions: int | None = None) -> DataFrame:
    """Encode, append ``end_id`` to each document, and write; returns the manifest (part, seq, file, docs, ids), whose files follow each other by part and seq.

    Documents are dealt to files by ranges of the id, so no task holds more than its range; ``partitions``
    defaults to the session's shuffle partitions.
    """
    spark = docs.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = f.read()
    dictionary = train_dictionary(docs, spec, end_id, doc_id, text)
    digest = hashlib.sha256(dictionary).digest()
    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(posixpath.join(path, "dictionary.zdict")) as out:
        out.write(dictionary)
    sent = spark.sparkContext.broadcast((spec, dictionary))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text).cast("string").alias("text"))

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spec, dictionary = sent.value
        enc = _encoder(spec)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        z = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict, write_checksum=False, write_content_size=True)
        fs, path = filesystem(folder)
        made, part = [], TaskContext.get().partitionId()
        stream, index, place, name = None, [], 0, ""

        def close() -> None:
            entries = np.concatenate(index)
            stream.write(entries.tobytes())
            stream.write(struct.pack(_TAIL, place, len(entries), MAGIC))
            stream.close()
            made.append((part, len(made), name, len(entries), int(entries["ids"].sum())))

        written = 0
        for b in blocks(batches, "text", BLOCK_BYTES):
            if stream is None:
                name = f"part-{uuid.uuid4().hex}.tokz"
                stream, index, written = fs.open_output_stream(posixpath.join(path, name)), [], 0
                stream.write(struct.pack(_HEAD, MAGIC, enc.width, digest))
                place = struct.calcsize(_HEAD)
            ids, size = enc.block(b.column("text"))
            ends = np.cumsum(size + 1)
            all_ids = np.full(int(ends[-1]) if len(ends) else 0, end_id, dtype=f"<u{enc.width}")
            keep = np.ones(len(all_ids), dtype=bool)
            keep[ends - 1] = False
            all_ids[keep] = ids
            frames = [z.compress(all_ids[e - s - 1 : e].tobytes()) for e, s in zip(ends.tolist(), size.tolist(), strict=True)]
            entry = np.zeros(len(frames), dtype=_ENTRY)
            entry["doc_id"] = b.column("doc_id").to_numpy(zero_copy_only=False)
            entry["bytes"] = [len(f) for f in frames]
            entry["place"] = place + np.cumsum(entry["bytes"].astype(np.int64)) - entry["bytes"]
            entry["ids"] = size + 1
            stream.write(b"".join(frames))
            place += int(entry["bytes"].sum())
            index.append(entry)
            written += b.column("text").nbytes
            if written >= FILE_BYTES:
                close()
                stream = None
        if stream is not None:
            close()
        cols = list(zip(*made, strict=True)) or [()] * 5
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["part", "seq", "file", "docs", "ids"])

    dealt = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")
    manifest = dealt.mapInArrow(run, "part int, seq int, file string, docs long, ids long")
    manifest.write.parquet(posixpath.join(folder, "manifest"))
    return spark.read.parquet(posixpath.join(folder, "manifest"))


def _frames(content: bytes, dictionary: bytes) -> tuple[int, np.ndarray]:
    """The id width and the index of a file, whose marks and dictionary hash must fit."""
    magic, width, digest = struct.unpack_from(_HEAD, content)
    place, n, last = struct.unpack_from(_TAIL, content, len(content) - struct.calcsize(_TAIL))
    if magic != MAGIC or last != MAGIC or digest != hashlib.sha256(dictionary).digest():
        raise ValueError("not a token file, or not of this dictionary")
    return width, np.frombuffer(content, dtype=_ENTRY, count=n, offset=place)


def read(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """The documents of the files in the manifest: file, pos, doc_id, n_tokens, ids_crc32 and, if wanted, ids."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(posixpath.join(path, "dictionary.zdict")) as f:
        sent = spark.sparkContext.broadcast(f.read())
    manifest = spark.read.parquet(posixpath.join(folder, "manifest")).select("file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tokz").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(manifest, "file", "left_semi")
    schema = "file string, pos int, doc_id long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = sent.value
        z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
        for b in batches:
            for name, content in zip(b.column("file"), b.column("content"), strict=True):
                data = memoryview(content.as_buffer())
                width, index = _frames(data, dictionary)
                for at in range(0, len(index), 2000):
                    part = index[at : at + 2000]
                    ids = [np.frombuffer(z.decompress(data[p : p + n]), dtype=f"<u{width}").astype("<u4") for p, n in zip(part["place"].tolist(), part["bytes"].tolist(), strict=True)]
                    cols = [pa.array([name.as_py()] * len(part), pa.string()), pa.array(np.arange(at, at + len(part), dtype=np.int32)), pa.array(part["doc_id"].astype(np.int64)), pa.array([len(x) for x in ids], pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64())]
                    if with_ids:
                        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                        cols.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids).astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(cols, names=["file", "pos", "doc_id", "n_tokens", "ids_crc32", "ids"][: len(cols)])

    return files.mapInArrow(run, schema)


def read_document(folder: str, file: str, doc_id: int) -> list[int]:
    """One document's ids, from its frame alone (the first of that id in the file)."""
    fs, path = filesystem(folder)
    with fs.open_input_stream(posixpath.join(path, "dictionary.zdict")) as f:
        dictionary = f.read()
    with fs.open_input_file(posixpath.join(path, file)) as f:
        magic, width, digest = struct.unpack(_HEAD, f.read_at(struct.calcsize(_HEAD), 0))
        place, n, last = struct.unpack(_TAIL, f.read_at(struct.calcsize(_TAIL), f.size() - struct.calcsize(_TAIL)))
        if magic != MAGIC or last != MAGIC or digest != hashlib.sha256(dictionary).digest():
            raise ValueError("not a token file, or not of this dictionary")
        index = np.frombuffer(f.read_at(n * _ENTRY.itemsize, place), dtype=_ENTRY)
        i = int(np.searchsorted(index["doc_id"], doc_id))
        if i == len(index) or index["doc_id"][i] != doc_id:
            raise KeyError(doc_id)
        frame = f.read_at(int(index["bytes"][i]), int(index["place"][i]))
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
    return np.frombuffer(z.decompress(frame), dtype=f"<u{width}").tolist()


def with_start(docs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Adds ``start``: the ids of all documents before, in file order.

    Sums come from the manifest, of a part's files by part, and of parts (as many as partitions) before;
    within a file the window holds that file's documents.
    """
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids")).select("part", F.coalesce(F.sum("ids").over(earlier(Window.orderBy("part"))), F.lit(0)).alias("parts"))
    files = manifest.select("part", "file", F.coalesce(F.sum("ids").over(earlier(Window.partitionBy("part").orderBy("seq"))), F.lit(0)).alias("files"))
    before = files.join(parts, "part").select("file", (F.col("parts") + F.col("files")).alias("before"))
    own = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    return docs.withColumn("own", F.coalesce(own, F.lit(0))).join(before, "file").withColumn("start", F.col("before") + F.col("own")).drop("own", "before")


def store(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, with_ids: bool = False, **columns: str) -> DataFrame:
    """Write all documents and read them back: doc_id, start, n_tokens, ids_crc32 and, if wanted, ids."""
    folder = folder or shared_dir(docs.sparkSession)
    manifest = write(docs, folder, tokenizer, end_id, **columns)
    back = with_start(read(docs.sparkSession, folder, with_ids), manifest)
    return back.select(F.when(F.col("doc_id") != NULL_ID, F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
