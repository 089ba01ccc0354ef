"""Importance resampling of documents towards a target text, by hashed word and word-pair features.

A vectorised byte automaton makes the features, straight from the bytes of Arrow's text buffers: a lookup
table classifies every byte, differences of the classes show where words begin and end, and the table-driven
CRC-32 of all words of a block advances byte by byte at the same time. A pair goes on from where the CRC of its first
word stands, across a space and the bytes of the second. No word is ever a Python object.

With s of all documents' S features and t of the target's T in a feature's bucket, the bucket gains
floor(1000 ln((t + 1)(S + b) / ((s + 1)(T + b)))), with b buckets. A document's weight is the floored mean of its
features' gains, 0 without features. Its score adds Gumbel noise made from a hash of its id, so the documents
with the highest scores are a draw without replacement in proportion to their weights, the same in every run.

Both passes over the texts are narrow. Counts leave a task as one row a bucket at most and are summed by bucket; only these
tables of b numbers (a parameter, not the data) reach the driver and go back. The order of all documents is a sort
of ids and scores dealt by ranges, in which a hot id or score is many ranges; ranks are a row's place in its range plus
the rows of the ranges before, so no task sees all rows.

Null and empty texts have no words; null ids make noise as the empty text does and come first among ties. Repeated rows are
rows of their own: each is counted, and each is drawn or not (of equal ones the order is that of the input's
files). Very long texts are handled in pieces that overlap by a word. Only id and text are read, whatever
other columns are called. An empty table gives an empty result; an empty target has T = 0.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, numbered, released, text_buffer

BUCKETS = 10_000
#: Words of more bytes get their CRC one by one.
LONG_WORD = 512
#: A text is handled in pieces of about so many bytes.
PIECE = 4 << 20

#: 1 for bytes of words: digits, letters, and all bytes of characters beyond ASCII.
_WORD = np.zeros(256, dtype=np.int8)
_WORD[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
_ONES = np.uint32(0xFFFFFFFF)


def _step(state: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return _CRC[(state ^ byte) & 0xFF] ^ (state >> np.uint32(8))


def _advance(state: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The CRC registers after each has read its word; all words advance together, the shorter ones stop first."""
    order = np.argsort(size, kind="stable")
    sizes, at, out = size[order], begin[order], state[order]
    most = int(np.searchsorted(sizes, LONG_WORD, "right"))
    for d in range(int(sizes[most - 1]) if most else 0):
        live = slice(int(np.searchsorted(sizes, d, "right")), most)
        out[live] = _step(out[live], data[at[live] + d])
    for i in range(most, len(out)):
        out[i] = np.uint32(zlib.crc32(data[at[i] : at[i] + sizes[i]].tobytes(), int(out[i] ^ _ONES))) ^ _ONES
    back = np.empty_like(out)
    back[order] = out
    return back


class Features:
    """The words of a run of bytes that hold rows with the given bounds: per word the bucket of the word, and that of the pair it ends.

    ``first`` has each row's first word; a row's first word ends no pair. With ``overlap`` the first word of all belongs to
    the run before: it only begins a pair.
    """

    def __init__(self, data: np.ndarray, bounds: np.ndarray, buckets: int, overlap: bool = False) -> None:
        data = _LOWER[data[bounds[0] : bounds[-1]]]
        bounds = bounds - bounds[0]
        kind = _WORD[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[bounds] = True
        change = np.diff(kind, prepend=np.int8(0), append=np.int8(0))
        begin = np.flatnonzero((change[:-1] == 1) | (edge[:-1] & (kind == 1)))
        end = np.flatnonzero((change[1:] == -1) | (edge[1:] & (kind == 1))) + 1
        self.first = np.searchsorted(begin, bounds)
        size = end - begin
        word = _advance(np.full(len(begin), _ONES), data, begin, size)
        ends_pair = np.ones(len(begin), dtype=bool)
        ends_pair[self.first[self.first < len(begin)]] = False
        second = np.flatnonzero(ends_pair)
        pair = _advance(_step(word[second - 1], 0x20), data, begin[second], size[second])
        self.word = ((word ^ _ONES) % np.uint32(buckets)).astype(np.int64)
        self.pair = np.full(len(begin), -1, dtype=np.int64)
        self.pair[second] = (pair ^ _ONES) % np.uint32(buckets)
        if overlap and len(begin):
            self.word[0] = -1


def features(arr: pa.Array, buckets: int) -> Iterator[tuple[int, int, Features]]:
    """The features of the texts of an array, as runs (first row, row after the last, features); a long row is several runs."""
    data, bounds = text_buffer(arr)
    long = np.flatnonzero(np.diff(bounds) > PIECE)
    at = 0
    for row in [*long.tolist(), len(bounds) - 1]:
        if row > at:
            yield at, row, Features(data, bounds[at : row + 1], buckets)
        if row < len(bounds) - 1:
            for lo, hi, overlap in _pieces(data, int(bounds[row]), int(bounds[row + 1])):
                yield row, row + 1, Features(data, np.array([lo, hi]), buckets, overlap)
        at = row + 1


def _pieces(data: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, int, bool]]:
    """Parts of a row: each ends where a word does, and the next begins with that word again."""
    start, overlap = lo, False
    while True:
        step = PIECE
        while True:  # a part ends with a whole word that isn't its first: else it would not get on
            stop = min(hi, start + step)
            if stop == hi:
                yield start, hi, overlap
                return
            kind = np.diff(_WORD[data[start:stop]], prepend=np.int8(0))
            starts, ends = np.flatnonzero(kind == 1), np.flatnonzero(kind == -1)
            if len(ends) > 1:
                break
            step *= 2
        yield start, start + int(ends[-1]), overlap
        start, overlap = start + int(starts[len(ends) - 1]), True


def _counted(docs: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How many features of all texts are in each bucket."""

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for b in blocks([batch], text):
                for _, _, x in features(b.column(text), buckets):
                    for part in (x.word, x.pair):
                        n += np.bincount(part[part >= 0], minlength=buckets)
        live = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(live), pa.array(n[live])], names=["bucket", "n"])

    rows = docs.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in rows:
        out[bucket] = n
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain from the numbers of features in it."""
    b, s, t = float(len(documents)), documents.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def _weighed(gain: np.ndarray, text: str) -> Callable:
    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks([batch], text):
                n, words, total = (np.zeros(b.num_rows, dtype=np.int64) for _ in range(3))
                for lo, hi, x in features(b.column(text), len(gain)):
                    for part in (x.word, x.pair):
                        there = part >= 0
                        held = np.concatenate([[0], np.cumsum(there)])[x.first]
                        sums = np.concatenate([[0], np.cumsum(np.where(there, gain[part], 0))])[x.first]
                        n[lo:hi] += np.diff(held)
                        total[lo:hi] += np.diff(sums)
                        if part is x.word:
                            words[lo:hi] += np.diff(held)
                weight = total // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(words), pa.array(weight)], names=[b.schema.names[0], "n_features", "n_words", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, doc_id: str = "doc_id", text: str = "text", target_text: str = "text") -> DataFrame:
    """id, n_features, weight, score and rank (1 is drawn first; null: not drawn) of every document.

    Drawn are ``percent`` hundredths (floored) of the documents that have ``least_words`` words.
    """
    gain = gains(_counted(docs, text, buckets), _counted(target, target_text, buckets))
    id_type = docs.schema[doc_id].dataType.simpleString()
    told = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(_weighed(gain, "text"), f"doc_id {id_type}, n_features long, n_words long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    told = told.withColumn("score", F.col("weight") + noise).withColumn("out", F.col("n_words") < least_words)
    ordered = numbered(told, [F.col("out"), F.col("score").desc(), F.col("doc_id")], "place")
    allowed = ordered.where("not out").agg(F.floor(F.count("*") * percent / 100).alias("allowed"))
    rank = F.when(~F.col("out") & (F.col("place") <= F.col("allowed")), F.col("place"))
    return ordered.crossJoin(F.broadcast(allowed)).select(F.col("doc_id").alias(doc_id), "n_features", "weight", "score", rank.alias("rank"))


ORACLE = r"""
with docs as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
goal as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
df as (select doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from docs),
gf as (select unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) f from goal),
dn as (select doc_id, f, count(*) n from df group by all),
every as (select f, hex(encode(f)) x from (select distinct f from dn union select distinct f from gf)),
crc as (select f, xor(4294967295::bigint, list_reduce(
    list_prepend(4294967295::bigint, flatten(list_transform(range(1, length(x) // 2 + 1), lambda i: [('0x' || substr(x, 2 * i - 1, 2))::bigint, 0, 0, 0, 0, 0, 0, 0]))),
    lambda c, e: xor(xor(c, e) // 2, 3988292384::bigint * (xor(c, e) % 2)))) % 10000 bucket from every),
s as (select bucket, sum(n) n from dn join crc using (f) group by 1),
t as (select bucket, count(*) n from gf join crc using (f) group by 1),
gain as (select b.bucket, cast(floor(1000 * ln((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double))) as bigint) gain
  from (select unnest(range(10000)) bucket) b left join s using (bucket) left join t using (bucket)),
mean as (select doc_id, cast(floor(sum(n * gain)::double / sum(n)) as bigint) weight from dn join crc using (f) join gain using (bucket) group by 1),
told as (
  select doc_id, cast(len(w) + greatest(len(w) - 1, 0) as bigint) n_features, len(w) >= 20 fit, coalesce(weight, 0) weight,
    coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || doc_id), 1, 8))::bigint + 0.5::double) / 4294967296::double))) as bigint) score
  from docs left join mean using (doc_id)),
ranked as (select *, row_number() over (partition by fit order by score desc, doc_id) place from told)
select doc_id, n_features, weight, score, case when fit and place <= (select floor(25 * count(*) / 100) from told where fit) then place end rank from ranked
"""
