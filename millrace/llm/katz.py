"""Katz backoff language model of any order: training and scoring of whole corpora.

Tokens are a text's words (ASCII lower case, split at ASCII white space) and one end. With h the words
before, at most order - 1 of them and starts before the first, and h' without the farthest, the model is

    P(v | h) = d(r) r / (c(h) + 1)    where h v came r > 0 times in the training texts
    P(v | h) = a(h) P(v | h')         else
    P(v)     = d(r) r / (N + 1)       where v came r > 0 times; what is left goes to the unknown word

with Good-Turing discounts d of each order for counts up to K (absolute ones where the counts of counts allow
none). a(h) is what the seen words leave over, divided by the probability that they leave over in the
shorter history, so each P(. | h) sums to exactly 1. The + 1 keeps a share for the unseen after frequent
histories too, whose counts are not discounted. A history that never came has a(h) = 1.

How it runs. Texts are packed into chunks of some megabytes, which are staged. For each length n from one word on
the chunks ask for their distinct n-grams: each is summed within its chunk first, so no n-gram, however
frequent, has more than one entry a chunk. The entries are dealt to buckets by history; there the counts of all
chunks are summed. That is the table of n-grams, by bucket, from which every chunk is answered: the count of each
of its n-grams in its own order and, for histories after which it has something unseen, the figures of a(h). The
answers are staged. A history with more than HISTORY tokens (known from the answers of the length before) is
split over buckets by the word that follows; its figures are sums, brought together by key. In the end each chunk
has all counts and evaluates its tokens recursively from the longest history to the shortest.

Words and n-grams are numbered in 64 bits; words are told apart by a 64-bit hash. Null and empty texts
have the end only. Repeated rows count, and are scored, as often as they come; null ids are scored like others.
Without training texts every word is unknown and has probability 1. An empty table gives an empty result. Only
the id and the text are read (and what ``train`` names), so other columns may have any names. A text longer than a chunk
is a chunk of its own and takes about 40 times its bytes of a worker's memory.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Words, blocks, crc_mod, discard, mixed, released, staged

K = 5
ORDER = 3
CHUNK_BYTES = 8 << 20
#: Tokens a bucket gets, about, and the tokens after a history from which on it is split.
BUCKET_TOKENS, HISTORY = 1_000_000, 250_000
END = np.uint64(0x656E642D6F662D74)
#: Numbers of the start and of the first word.
START, FIRST = 0, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of 64-bit numbers by byte planes, compressed."""
    head = np.array([len(arrays), *map(len, arrays)], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(np.ascontiguousarray(x, dtype="<i8").view(np.uint8).reshape(-1, 8).T).tobytes() for x in arrays]
    return zstandard.ZstdCompressor(level=3).compress(head + b"".join(planes))


def _unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    n = int(raw[:8].view("<i8")[0])
    sizes, at, out = raw[8 : 8 + 8 * n].view("<i8").tolist(), 8 + 8 * n, []
    for size in sizes:
        out.append(np.ascontiguousarray(raw[at : at + 8 * size].reshape(8, -1).T).reshape(-1).view("<i8"))
        at += 8 * size
    return out


def discounts(n: list[int]) -> list[float]:
    """d(1) .. d(K) from the numbers of types with counts 1 .. K + 1."""
    n = [float(x) for x in n] + [0.0] * (K + 1 - len(n))
    if all(n):
        rest = (K + 1) * n[K] / n[0]
        if rest < 1:
            d = [((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) for r in range(1, K + 1)]
            if all(0 < x <= 1 for x in d):
                return d
    cut = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    return [1 - cut / r for r in range(1, K + 1)]


@dataclass
class Facts:
    """What is known of the whole corpus: training texts and tokens, distinct words, and by length the numbers of n-grams with counts 1 .. K + 1."""

    order: int
    buckets: int
    history: int
    starts: int
    tokens: int = 0
    words: int = 0
    counts: dict[int, list[int]] = field(default_factory=dict)

    def kept(self, n: int, r: np.ndarray) -> np.ndarray:
        """d(r) r for n-grams."""
        d = np.array([1.0, *discounts(self.counts[n])])
        return r * d[np.where(r <= K, r, 0)]

    def cut(self, n: int, of: list[np.ndarray] | list[int]):
        """What discounts take from the counts, given the numbers of n-grams with counts 1 .. K."""
        return sum((1 - d) * (k + 1) * of[k] for k, d in enumerate(discounts(self.counts[n])))


def chunks(docs: DataFrame, doc_id: str, text: str, train: Column) -> DataFrame:
    """The texts packed: chunk, ids, train, sizes (tokens without end), tokens (places of words, frequent ones first), ranks of the places, the end's last, in vocab (hashes in order)."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), train.alias("train"))

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        for b in blocks(_large(batches), "text", CHUNK_BYTES):
            w = Words(b.column("text"), lower=True)
            vocab, inverse, often = np.unique(w.hash, return_inverse=True, return_counts=True)
            order = np.argsort(-often, kind="stable")  # frequent words get small places, which compress better
            place = np.empty_like(order)
            place[order] = np.arange(len(order))
            at = int(np.searchsorted(vocab, END))
            ranks = np.append(order + (order >= at), at)  # among all words with the end
            cols = [[part << 32 | seq], [b.column("id").to_pylist()], [b.column("train").to_pylist()], [w.counts().tolist()], [_pack(place[inverse])], [_pack(ranks)], [np.insert(vocab, at, END).tobytes()]]
            del w, vocab, inverse
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["chunk", "ids", "train", "sizes", "tokens", "ranks", "vocab"])
            seq += 1

    return staged(rows.mapInArrow(run, "chunk long, ids array<long>, train array<boolean>, sizes array<int>, tokens binary, ranks binary, vocab binary"))


def _large(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Small batches joined to about a chunk's bytes."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size >= CHUNK_BYTES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held and sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


class Grams:
    """A chunk's distinct n-grams: their place among the tokens, their history (a number among the (n - 1)-grams) and their order in the chunk's requests."""

    def __init__(self, chunk: Chunk, n: int) -> None:
        before, w = chunk.of[n - 1], chunk.w
        size = len(chunk.number)
        types, first, inverse = np.unique(before[chunk.at - 1] * size + w[chunk.at], return_index=True, return_inverse=True)
        self.n, self.first = n, chunk.at[first]
        self.history, self.word = types // size, types % size
        self.of = np.full(len(w), len(types), dtype=np.int64)  # starts alone are one more n-gram
        self.of[chunk.at] = inverse.reshape(-1)
        self.seen = np.bincount(inverse.reshape(-1)[chunk.train], minlength=len(types))
        self.after = chunk.count[n - 1][self.history]
        self.hot = self.after > chunk.facts.history
        key = np.zeros(len(types), dtype=np.uint64)
        for c in self.columns(chunk):
            key = mixed(key * _STEP + c.astype(np.uint64))
        salts = np.where(self.hot, self.after // chunk.facts.history + 1, 1).astype(np.uint64)
        salt = mixed(chunk.number[self.word].astype(np.uint64) * _STEP) % salts
        self.bucket = (mixed(key + salt * _STEP) % np.uint64(chunk.facts.buckets)).astype(np.int64)
        self.order = np.argsort(self.bucket, kind="stable")
        #: Of the requests in order: where histories begin, within each bucket.
        h, b = self.history[self.order], self.bucket[self.order]
        self.heads = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), dtype=bool), (h[1:] != h[:-1]) | (b[1:] != b[:-1])]))

    def columns(self, chunk: Chunk) -> list[np.ndarray]:
        """The numbers of the history's words, the farthest first."""
        return [chunk.number[chunk.w[self.first - k]] for k in range(self.n - 1, 0, -1)]


class Chunk:
    """The tokens of a chunk with starts between, and what is known of its n-grams so far: ``of`` (by place), ``count`` (by n-gram)."""

    def __init__(self, row: dict, answers: list[dict], facts: Facts) -> None:
        self.facts, self.ids = facts, row["ids"]
        sizes = np.array(row["sizes"], dtype=np.int64)
        self.doc_train = np.array(row["train"], dtype=bool)
        self.sizes = sizes + 1
        tokens, ranks = _unpack(row["tokens"])[0], _unpack(row["ranks"])[0]
        if not answers:
            self.vocab = np.frombuffer(row["vocab"], dtype=np.uint64)
            seen = np.bincount(tokens[np.repeat(self.doc_train, sizes)], minlength=len(ranks))
            seen[-1] = self.doc_train.sum()
            self.seen = np.empty_like(seen)
            self.seen[ranks] = seen
            return
        number, count = _joined([a for a in answers if a["level"] == 1], 2)
        by = np.argsort(number)
        place = np.empty(len(number), dtype=np.int64)
        place[by] = np.arange(1, len(number) + 1)
        place = place[ranks]
        self.number = np.append(START, number[by])
        pad = facts.order - 1
        ends = np.cumsum(self.sizes + pad)
        total = int(ends[-1]) if len(ends) else 0
        real, inner = np.ones(total, dtype=bool), np.ones(total, dtype=bool)
        for k in range(pad):
            real[ends - self.sizes - 1 - k] = False
        inner[ends - 1] = False
        self.w = np.zeros(total, dtype=np.int64)
        self.w[ends - 1] = place[-1]
        self.w[real & inner] = place[tokens]
        self.at = np.flatnonzero(real)
        self.train = np.repeat(self.doc_train, self.sizes)
        self.of, self.count, self.grams = {1: self.w}, {1: np.append(facts.starts, count[by])}, {}
        for n in range(2, max(a["level"] for a in answers) + 1):
            self._told(n, [a for a in answers if a["level"] == n])

    def _told(self, n: int, answers: list[dict]) -> None:
        g = self.grams[n] = Grams(self, n)
        parts = [_unpack(a["data"]) for a in sorted((a for a in answers if a["key"] is None), key=lambda a: a["bucket"])]
        r = np.empty(len(g.word) + 1, dtype=np.int64)
        r[-1] = self.facts.starts
        asked = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
        r[g.order] = asked
        self.of[n], self.count[n] = g.of, r
        # the histories whose figures were sent, in the order of the requests
        wanted = _wanted(asked, g.heads, g.hot[g.order][g.heads], g.after[g.order][g.heads])
        history = g.history[g.order][g.heads][wanted]
        figures = np.zeros((K + 1, len(self.count[n - 1])))
        for k in range(K):
            figures[k, history] = np.concatenate([p[1 + k] for p in parts]) if parts else 0
        figures[K, history] = np.concatenate([p[1 + K].view("<f8") for p in parts]) if parts else 0.0
        hot = [a for a in answers if a["key"] is not None]
        if hot:
            some = g.order[g.heads[g.hot[g.order][g.heads]]]
            keys = np.stack([c[some] for c in g.columns(self)], axis=1).tolist()
            place = {tuple(k): h for k, h in zip(keys, g.history[some].tolist(), strict=True)}
            for a in hot:
                figures[:, place[tuple(a["key"])]] = [*(a[f"n{k}"] for k in range(1, K + 1)), a["lower"]]
        c = self.count[n - 1]
        g.figures = (figures, c)

    def requests(self, n: int) -> Iterator[tuple[int, bytes]]:
        """(bucket, data) of the chunk's n-grams."""
        if n == 1:
            # buckets are ranges of hashes, so the answers together are in the vocabulary's order
            bucket = ((self.vocab >> np.uint64(32)) * np.uint64(self.facts.buckets) >> np.uint64(32)).astype(np.int64)
            for b, i, j in self._cuts(bucket, np.arange(len(bucket))):
                yield b, _pack(np.diff(self.vocab[i:j].view(np.int64), prepend=0), self.seen[i:j])
            return
        g = Grams(self, n)
        low = self.count[n - 1][self.of[n - 1][g.first]]
        short = self.count[n - 2][self.of[n - 2][g.first - 1]] if n > 2 else np.full(len(low), self.facts.tokens)
        columns, v = g.columns(self), self.number[g.word]
        for b, i, j in self._cuts(g.bucket, g.order):
            lo, hi = np.searchsorted(g.heads, [i, j])
            heads = g.heads[lo:hi]
            own, all_ = g.order[heads], g.order[i:j]
            yield b, _pack(np.diff(columns[0][own], prepend=0), *(c[own] for c in columns[1:]), np.diff(np.append(heads, j)), short[own], g.hot[own], v[all_], g.seen[all_], low[all_])

    @staticmethod
    def _cuts(bucket: np.ndarray, order: np.ndarray) -> Iterator[tuple[int, int, int]]:
        b = bucket[order]
        starts = np.flatnonzero(np.concatenate([np.ones(min(1, len(b)), dtype=bool), b[1:] != b[:-1]]))
        return zip(b[starts].tolist(), starts.tolist(), np.append(starts[1:], len(b)).tolist(), strict=True)

    def scores(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per text the known tokens, the base score and the score."""
        f, at = self.facts, self.at
        c = self.count[1][self.w[at]]
        base = np.log10((c + 0.1) / (f.tokens + 0.1 * (f.words + 1)))
        score, open_ = np.zeros(len(at)), np.ones(len(at), dtype=bool)
        for n in range(f.order, 1, -1):
            r, h = self.count[n][self.of[n][at]], self.of[n - 1][at - 1]
            after = self.count[n - 1][h]
            seen = open_ & (r > 0)
            score[seen] += np.log10(f.kept(n, r[seen]) / (after[seen] + 1))
            open_ &= r == 0
            back = open_ & (after > 0)
            figures, _ = self.grams[n].figures
            of, c_h = figures[:, h[back]], after[back]
            left = 1 - (c_h - f.cut(n, of[:K])) / (c_h + 1)
            score[back] += np.log10(left / (1 - of[K]))
        known = np.log10(np.maximum(f.kept(1, c), 1e-300) / (f.tokens + 1))
        rest = np.log10(1 - (f.tokens - f.cut(1, f.counts[1])) / (f.tokens + 1))
        score[open_] += np.where(c > 0, known, rest)[open_]
        cuts = np.cumsum(self.sizes) - self.sizes
        return np.add.reduceat((c > 0).astype(np.int64), cuts), np.add.reduceat(base, cuts), np.add.reduceat(score, cuts)


def _joined(answers: list[dict], n: int) -> list[np.ndarray]:
    parts = [_unpack(a["data"]) for a in sorted(answers, key=lambda a: a["bucket"])]
    return [np.concatenate([p[k] for p in parts]) for k in range(n)]


def _wanted(r: np.ndarray, heads: np.ndarray, hot: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Which histories have something unseen after them, and figures to be told with the answer."""
    return (np.minimum.reduceat(r, heads) == 0) & ~hot & (after > 0) if len(heads) else np.zeros(0, dtype=bool)


_NS = [f"n{k}" for k in range(1, K + 2)]
_FOUND = "kind int, chunk long, level int, bucket int, data binary, key array<long>, " + ", ".join(f"{n} long" for n in _NS) + ", lower double, types long, tokens long"
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]
_KINDS = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[x.split()[1]] for x in _FOUND.split(", ")]
ANSWER, COUNTS, PART, NEED = range(4)


def _table(rows: list[dict]) -> pa.Table:
    return pa.table([pa.array([r.get(x) for r in rows], t) for x, t in zip(_NAMES, _KINDS, strict=True)], names=_NAMES)


def _counts(r: np.ndarray, n: int) -> dict:
    return {"kind": COUNTS, "level": n, "types": int((r > 0).sum()), "tokens": int(r.sum())} | {x: int((r == k + 1).sum()) for k, x in enumerate(_NS)}


def _words_found(rows: pa.Table, facts: Facts) -> pa.Table:
    """Numbers and counts of a bucket's words: words are numbered by falling count within the bucket."""
    bucket, owners = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
    parts = [_unpack(x.as_py()) for x in rows.column("data")]
    h, k = np.concatenate([np.cumsum(p[0]) for p in parts]), np.concatenate([p[1] for p in parts])
    types, inverse = np.unique(h, return_inverse=True)
    r = np.bincount(inverse, weights=k, minlength=len(types)).astype(np.int64)
    number = np.empty(len(types), dtype=np.int64)
    number[np.argsort(-r, kind="stable")] = FIRST + np.arange(len(types)) * facts.buckets + bucket
    out, at = [_counts(r, 1)], 0
    for chunk, p in zip(owners, parts, strict=True):
        own = inverse[at : at + len(p[0])]
        at += len(own)
        out.append({"kind": ANSWER, "chunk": chunk, "level": 1, "bucket": bucket, "data": _pack(number[own], r[own])})
    return _table(out)


def _grams_found(rows: pa.Table, n: int, facts: Facts) -> pa.Table:
    """Counts of a bucket's n-grams, and the figures of their histories."""
    bucket, owners = rows.column("bucket")[0].as_py(), rows.column("chunk").to_pylist()
    parts = [_unpack(x.as_py()) for x in rows.column("data")]
    columns = [np.concatenate([np.cumsum(p[0]) if c == 0 else p[c] for p in parts]) for c in range(n - 1)]
    m, short, hot, v, k, low = (np.concatenate([p[n - 1 + i] for p in parts]) for i in range(6))
    sizes = [(len(p[0]), len(p[-1])) for p in parts]
    del parts
    h = np.zeros(len(m), dtype=np.int64)
    for c in columns:
        of, dense = np.unique(c, return_inverse=True)
        h = np.unique(h * (len(of) + 1) + dense, return_inverse=True)[1]
    words, dense = np.unique(v, return_inverse=True)
    types, first, inverse = np.unique(np.repeat(h, m) * (len(words) + 1) + dense, return_index=True, return_inverse=True)
    r = np.bincount(inverse, weights=k, minlength=len(types)).astype(np.int64)
    many = int(h.max()) + 1 if len(h) else 0
    of = types // (len(words) + 1)
    figures = [np.bincount(of[r == x + 1], minlength=many) for x in range(K)]
    short_of = np.zeros(many)
    short_of[h] = short
    lower = np.bincount(of, np.where(r > 0, facts.kept(n - 1, low[first]) / (short_of[of] + 1), 0.0), minlength=many)
    after = np.bincount(of, r, minlength=many)
    out, ctx, at = [_counts(r, n)], 0, 0
    for chunk, (n_ctx, n_v) in zip(owners, sizes, strict=True):
        own, asked = slice(ctx, ctx + n_ctx), r[inverse[at : at + n_v]]
        heads = np.cumsum(m[own]) - m[own]
        want = h[own][_wanted(asked, heads, hot[own] > 0, after[h[own]])]
        out.append({"kind": ANSWER, "chunk": chunk, "level": n, "bucket": bucket, "data": _pack(asked, *(f[want] for f in figures), lower[want].view("<i8"))})
        split = np.flatnonzero((hot[own] > 0) & (np.minimum.reduceat(asked, heads) == 0)) if n_ctx else []
        out += [{"kind": NEED, "chunk": chunk, "level": n, "key": [int(c[ctx + i]) for c in columns]} for i in split]
        ctx, at = ctx + n_ctx, at + n_v
    parted, place = np.unique(h[hot > 0], return_index=True)
    place = np.flatnonzero(hot > 0)[place]
    for x, i in zip(parted.tolist(), place.tolist(), strict=True):
        out.append({"kind": PART, "level": n, "key": [int(c[i]) for c in columns], "lower": float(lower[x])} | {f"n{y + 1}": int(figures[y][x]) for y in range(K)})
    return _table(out)


def _row(t: pa.Table) -> dict:
    return {c: t.column(c)[0].as_py() for c in t.column_names}


def _level(packed: DataFrame, answers: DataFrame | None, n: int, facts: Facts) -> DataFrame:
    """Asks for the n-grams of all chunks; what the buckets find, staged."""

    def table(rows: Iterable[tuple]) -> pa.Table:
        cols = list(zip(*rows, strict=True)) or [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary()), strict=True)], names=["bucket", "chunk", "data"])

    @released
    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = _row(pa.Table.from_batches([b.slice(i, 1)]))
                yield from table((k, row["chunk"], d) for k, d in Chunk(row, [], facts).requests(1)).to_batches()

    @released
    def ask(left: pa.Table, right: pa.Table) -> pa.Table:
        row = _row(left)
        return table([(b, row["chunk"], d) for b, d in Chunk(row, right.to_pylist(), facts).requests(n)])

    @released
    def find(rows: pa.Table) -> pa.Table:
        return _words_found(rows, facts) if n == 1 else _grams_found(rows, n, facts)

    schema = "bucket int, chunk long, data binary"
    if answers is None:
        asked = packed.mapInArrow(first, schema)
    else:
        asked = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(ask, schema)
    return staged(asked.groupBy("bucket").applyInArrow(find, _FOUND), ["kind"])


def score(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """Scores of all documents by a model of those for which ``train`` holds.

    doc_id, held_out, n_tokens, n_known, train_tokens, base_score (add-0.1 unigrams) and score, in log10.
    """
    packed = chunks(docs, doc_id, text, train)
    size = packed.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x + 1)).alias("n"), F.sum(F.size(F.filter("train", lambda x: x)).cast("long")).alias("t")).first()
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    facts = Facts(order, max(least, -(-int(size.n or 0) // BUCKET_TOKENS)), HISTORY, int(size.t or 0))
    answers = None
    told = ["chunk", "level", "bucket", "data", "key", *_NS[:K], "lower"]
    for n in range(1, order + 1):
        found = _level(packed, answers, n, facts)
        kind = lambda k: found.where(F.col("kind") == k)  # noqa: B023, E731
        sums = kind(COUNTS).agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), *[F.sum(x).alias(x) for x in _NS]).first()
        facts.counts[n] = [int(sums[x] or 0) for x in _NS]
        if n == 1:
            facts.tokens, facts.words = int(sums.tokens or 0), int(sums.types or 0)
            whole, packed = packed, staged(packed.drop("vocab"))
            discard(whole)
        split = kind(PART).groupBy("key").agg(*[F.sum(x).alias(x) for x in _NS[:K]], F.sum("lower").alias("lower"))
        split = kind(NEED).select("chunk", "level", "key").distinct().join(split, "key").withColumn("bucket", F.lit(-1)).withColumn("data", F.lit(None).cast("binary"))
        own = kind(ANSWER).select(*told)
        if n > 1:
            own = own.unionByName(split.select(*told))
        answers = own if answers is None else answers.unionByName(own)

    @released
    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        c = Chunk(_row(left), right.to_pylist(), facts)
        known, base, score = c.scores()
        return pa.table([pa.array(c.ids, pa.int64()), pa.array(~c.doc_train), pa.array(c.sizes), pa.array(known), pa.array(base), pa.array(score)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = packed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(total, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(facts.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def held_out(docs: DataFrame, m: int = 10, **options) -> DataFrame:
    """Scores by a model of the documents whose crc32 of the id is not 0 modulo m."""
    return score(docs, crc_mod(options.get("doc_id", "doc_id"), m) != 0, **options)
