"""Toxicity by compression distance: zstandard dictionaries of toxic and of ordinary text.

A window of text that shares phrases with toxic text compresses better with the toxic dictionary. The
dictionaries are used as raw content. The toxic part and as much ordinary text are each followed by the
same ordinary text, so what both kinds of text have in common costs the same under both, and the
difference of the lengths shows the rest.
Each window is followed by the last bytes of the ordinary dictionary: what compresses not at all would
be stored as it is, under either dictionary, and show no difference.

The ordinary parts are trained on all windows of the ordinary documents, the toxic part on all windows of
the toxic ones. Labels mark whole documents, of which little is toxic: a window counts more the more byte
n-grams of high odds between toxic and ordinary documents it has, wherever in it. A supplement holds the
words that begin with such n-grams, compared by itself. A quarter of the sample is kept from the
dictionaries; on its ordinary documents is measured what windows save by chance, and on all of it the
summed savings of a document by either are calibrated, with the number of its windows, to a probability,
whose threshold is 0.5.

Training takes a bounded sample: at most SAMPLE_TOXIC and SAMPLE_ORDINARY labelled documents (those with
the least hash of their id), of longer ones a passage of SAMPLE_CHARS characters from a place that the id decides; of rows with the
same id the least text; near copies among them count once. Only the COMMON most frequent marked words follow the supplement
whole, and of fewer than 16 samples or 10 kB the last windows are a dictionary without training. Scoring covers every window of
every text.

Null and empty texts have no windows and are scored by that alone. With no toxic or no ordinary
document to learn from all scores are 0. A document with several labels counts as toxic if one of them is.
Repeated rows are scored as often as they come, null ids like others; an empty table gives an empty result. ``score``
reads only the id and the text, and ``accepted`` keeps all columns, so other columns may have any names. Very long texts
are compressed window by window.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, released, tidy

SAMPLE_TOXIC, SAMPLE_ORDINARY, SAMPLE_CHARS = 1500, 3000, 20_000
WINDOW = 96
GRAM = 6
#: A gram marks toxic text if the share of toxic documents that have it is so many times that of ordinary ones,
#: and the log-likelihood ratio of the two shares (a chi-square of one degree) is so large that chance over all grams is ruled out.
ODDS, RATIO = 5, 30
#: The toxic part takes the place of as much ordinary text; the supplement stands before the text that both share.
TOXIC_BYTES, SUPPLEMENT_BYTES, ORDINARY_BYTES = 8 << 10, 6 << 10, 32 << 10
#: So many of the most frequent marked words follow the trained supplement whole, as training cuts words.
COMMON = 400
#: A toxic window counts so many times more in training for a gram in it that marks toxic text.
WEIGHT = 4
#: The share of ordinary documents' windows whose saving with toxic text is no chance.
CHANCE = 0.05
#: The share of toxic documents that calibrated scores assume.
PRIOR = 0.1
_WORD = rb"[a-z0-9\x80-\xff]+"


def windows(text: bytes) -> list[bytes]:
    """The text cut into windows at spaces where there are any in a window's second half."""
    out, at, n = [], 0, len(text)
    while at < n:
        to = at + WINDOW
        if to < n:
            space = text.rfind(b" ", at + WINDOW // 2, to)
            to = space + 1 if space >= 0 else to
        out.append(text[at:to])
        at = to
    return out


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    p = zstandard.ZstdCompressionParameters(window_log=17, hash_log=15, chain_log=15, search_log=6, min_match=5, target_length=8, strategy=zstandard.STRATEGY_LAZY, write_content_size=0, write_checksum=0, write_dict_id=0)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    if len(content) >= 8:
        d.precompute_compress(compression_params=p)
    return zstandard.ZstdCompressor(compression_params=p, dict_data=d)


class Model:
    """The parts of the dictionaries and the calibration; ``features`` and ``score`` are of one text.

    ``shared`` is ordinary text that all dictionaries end with. ``toxic`` or as much more text that is
    ``ordinary`` precedes it, and apart from these the ``supplement``. What a window saves with the toxic
    part counts as far as it is more than ``chance``.
    """

    def __init__(self, toxic: bytes, ordinary: bytes, shared: bytes, supplement: bytes, chance: int = 0, weights: list[float] | None = None) -> None:
        self.toxic, self.ordinary, self.shared, self.supplement, self.chance, self.weights = toxic, ordinary, shared, supplement, chance, weights
        self._made = None

    def __getstate__(self) -> tuple:
        return self.toxic, self.ordinary, self.shared, self.supplement, self.chance, self.weights

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def saved(self, text: str | None) -> list[tuple[int, int]]:
        """The bytes that each window saves with the toxic dictionary and with the supplement."""
        if self._made is None:
            plain = self.ordinary + self.shared
            self._made = [_compressor(x).compress for x in (plain, self.toxic + self.shared, self.shared, self.supplement + self.shared)]
        plain, toxic, bare, marked = self._made
        tail = self.shared[-64:]
        out = []
        for w in windows((text or "").encode("utf-8", "replace").lower()):
            w += tail
            out.append((len(plain(w)) - len(toxic(w)), len(bare(w)) - len(marked(w)) if self.supplement else 0))
        return out

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Logs of the bytes that windows save with the toxic dictionary and with the supplement, and of the number of windows."""
        saved = self.saved(text)
        toxic = sum(max(0, d - self.chance) for d, _ in saved)
        marked = sum(max(0, d) for _, d in saved)
        return float(np.log1p(toxic)), float(np.log1p(marked)), float(np.log1p(len(saved)))

    def score(self, text: str | None) -> float:
        x = np.dot(self.weights, (1, *self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(x, -50, 50))))


def _all_grams(text: bytes) -> np.ndarray:
    """The grams that begin at the blank before the text and at each of its bytes."""
    a = np.frombuffer(b" " + text + b" " * 8, dtype=np.uint8)
    return np.ndarray((len(a) - 7,), dtype="<u8", buffer=a, strides=(1,)) & np.uint64((1 << (8 * GRAM)) - 1)


def _grams(text: bytes) -> np.ndarray:
    return np.unique(_all_grams(text))


def _without_copies(texts: list[bytes]) -> list[bytes]:
    """Texts of whose 16 least three-word shingles at least a third were in a text before are left out."""
    seen: set[int] = set()
    out = []
    for t in texts:
        w = t.split()
        least = sorted({xxhash.xxh64_intdigest(b" ".join(w[i : i + 3])) for i in range(max(1, len(w) - 2))})[:16]
        if 3 * sum(h in seen for h in least) < len(least):
            out.append(t)
        seen.update(least)
    return out


def _dictionary(samples: list[bytes], size: int, k: int, d: int) -> bytes:
    total = sum(map(len, samples))
    if total >= 10 * 1024 and len(samples) >= 16:
        try:
            return zstandard.train_dictionary(min(size, max(256, total // 4)), samples, k=k, d=d).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(dict.fromkeys(samples))[-size:]


def train(toxic: list[str], ordinary: list[str]) -> Model | None:
    """The model, or None where one of the kinds is missing."""
    bad, good = (_without_copies([t.encode("utf-8", "replace").lower() for t in x]) for x in (toxic, ordinary))
    if not bad or not good:
        return None
    held = lambda x: [t for i, t in enumerate(x) if i % 4 == 3] or x
    kept = lambda x: [t for i, t in enumerate(x) if i % 4 != 3] or x
    a, b = kept(bad), kept(good)
    (ga, ca), (gb, cb) = (np.unique(np.concatenate([_grams(t) for t in x]), return_counts=True) for x in (a, b))
    other = np.zeros(len(ga))
    at = np.searchsorted(gb, ga)
    inside = at < len(gb)
    inside[inside] = gb[at[inside]] == ga[inside]
    other[inside] = cb[at[inside]]
    both = (ca + other) / (len(a) + len(b))
    ratio = 2 * (ca * np.log(ca / len(a) / both) + np.where(other > 0, other * np.log(np.maximum(other, 1) / len(b) / both), 0.0))
    telling = ga[(ratio >= RATIO) & (ca / len(a) >= ODDS * (other + 0.5) / len(b))]
    marks = {int(g).to_bytes(GRAM, "little") for g in telling}
    # words are known by how they begin; inner grams turn up in other words too often
    marks = {g for g in marks if g[:1] == b" " and b" " not in g[1:-1] and re.fullmatch(_WORD, g.strip(b" "))}
    marked, samples = [], []
    for t in a:
        for w in re.findall(_WORD, t):
            x = b" " + w + b" "
            if x[:GRAM] in marks:
                marked.append(x)
        at, told = 0, np.isin(_all_grams(t), telling).cumsum()
        for w in windows(t):
            samples += [w] * (1 + WEIGHT * int(told[at + len(w)] - told[at]))
            at += len(w)
    groups = [b"".join(marked[i : i + 20]) for i in range(0, len(marked), 20)]
    often = [w.rstrip() for w, _ in Counter(marked).most_common(COMMON)]
    supplement = _dictionary(groups, SUPPLEMENT_BYTES, 24, 6) + b"".join(reversed(often)) if marked else b""
    toxic_part = _dictionary(samples, TOXIC_BYTES, 32, 6)
    # what training finds best comes last
    plain = _dictionary([w for t in b for w in windows(t)], ORDINARY_BYTES + len(toxic_part), 64, 8)
    model = Model(toxic_part, plain[:-ORDINARY_BYTES], plain[-ORDINARY_BYTES:], supplement)
    by_chance = sorted(d for t in held(good) for d, _ in model.saved(t.decode("utf-8", "replace")))
    model.chance = max(0, by_chance[int(len(by_chance) * (1 - CHANCE))]) if by_chance else 0
    x = np.array([(1, *model.features(t.decode("utf-8", "replace"))) for t in [*held(bad), *held(good)]])
    y = np.r_[np.ones(len(held(bad))), np.zeros(len(held(good)))]
    weight = np.where(y == 1, PRIOR / y.sum(), (1 - PRIOR) / (len(y) - y.sum())) * len(y)
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w -= np.linalg.solve(h, x.T @ (weight * (p - y)) + 0.05 * w)
    model.weights = w.tolist()
    return model


def learn(docs: DataFrame, labels: DataFrame, usable: Column | None = None, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic") -> Model | None:
    """A model from labelled documents, of which only those with ``usable`` (a condition on the column doc_id) are read."""
    marks = labels.select(F.col(doc_id).alias("doc_id"), F.col(toxic).cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marks = marks.where(usable) if usable is not None else marks
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    first = lambda k, n: marks.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = first(1, SAMPLE_TOXIC).unionByName(first(0, SAMPLE_ORDINARY))
    whole = F.col(text).cast("string")
    place = 1 + F.pmod(F.xxhash64(doc_id), F.greatest(F.lit(1), F.length(whole) - SAMPLE_CHARS + 1))
    texts = docs.where(F.octet_length(whole) > 0).select(F.col(doc_id).alias("doc_id"), F.substr(whole, place.cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("toxic", "text", F.xxhash64("doc_id").alias("h")).collect()
    rows = sorted((r.h, r.text, r.toxic) for r in rows)
    model = train([t for _, t, k in rows if k == 1], [t for _, t, k in rows if k == 0])
    del rows
    tidy(docs.sparkSession)  # the sample and what training made of it are most of a driver's memory
    return model


def score(docs: DataFrame, model: Model | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score and predicted (1 from a score of 0.5 on) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in blocks(batches, "text"):
            scores = pa.array([model.score(t.as_py()) for t in b.column("text")], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores], names=["doc_id", "score"])

    scored = rows.mapInArrow(run, f"doc_id {kind.simpleString()}, score double")
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def held_out(docs: DataFrame, labels: DataFrame, m: int = 5) -> DataFrame:
    """Scores of all documents by a model of those whose crc32 of the id is not 0 modulo m: doc_id, held_out, score, predicted."""
    model = learn(docs, labels, crc_mod("doc_id", m) != 0)
    return score(docs, model).select("doc_id", (crc_mod("doc_id", m) == 0).alias("held_out"), "score", "predicted")


def accepted(docs: DataFrame, model: Model | None, most: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose score is below ``most``."""
    if model is None:
        return docs
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in blocks(batches, text):
            yield b.filter(pa.array([model.score(t.as_py()) < most for t in b.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
