"""Language identification as inference of a multilingual mixture.

Each language is a distribution over hashed character trigrams, counted over all training documents. A
document's trigrams are taken as drawn from a mixture of the languages, whose proportions expectation
maximisation estimates. Which languages are in the mixture is chosen by penalised likelihood: languages
are added in order of their proportion in the full mixture, while twice the gain in log likelihood
exceeds log(n) for one more proportion. Neighbouring trigrams overlap, so a text of n trigrams counts as
n / 3 independent ones.

The prediction is the language with the largest proportion, ``und`` for texts that are null or without a
letter; ties go to the first in alphabetical order. The score is that proportion, or for a single language
its posterior probability among all languages.

Letters in lower case count; all else between them is one blank. Counting and prediction cover whole
texts. Rows without a language or text are not learned from. Without any training row all is ``und``.
Repeated rows count, and are predicted, as often as they come; null ids are predicted like others; an empty table gives
an empty result. ``predict`` reads only the id and the text, and ``accepted`` keeps all columns, so other columns may
have any names. Long texts are counted in pieces, so memory follows the number of distinct trigrams.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import blocks, crc_mod, released

#: Trigrams are hashed to so many buckets; neighbours are joined, if languages are many, until the model has at most CELLS cells.
BUCKETS, CELLS = 1 << 16, 1 << 24
#: Expectation maximisation ends when no proportion of a text moves by more.
STILL = 2e-3
OVERLAP = 3.0
#: Texts are counted in pieces of so many characters, cut where a word ends.
PIECE = 1 << 19
UND = "und"
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000))
    return _LETTERS[0]


def _pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The texts in pieces, and the text of each: only the trigram around a cut is not counted."""
    out, of = [], []
    for i, t in enumerate(texts):
        at, t = 0, t or ""
        while len(t) - at > 2 * PIECE:
            to = t.find(" ", at + PIECE, at + 2 * PIECE)
            to = to if to >= 0 else at + PIECE
            out.append(t[at:to])
            of.append(i)
            at = to
        out.append(t[at:])
        of.append(i)
    return out, np.array(of, dtype=np.int64)


def trigrams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For parts of the texts: text and bucket of each trigram as one number, its frequency there, and the texts with a letter."""
    pieces, of = _pieces(texts)
    at = 0
    while at < len(pieces):
        to, size = at, 0
        while to < len(pieces) and (to == at or size + len(pieces[to]) <= 2 * PIECE):
            size += len(pieces[to])
            to += 1
        bucket, row, has = _trigrams(pieces[at:to])
        key, n = np.unique(of[at:to][row] * BUCKETS + bucket, return_counts=True)
        yield key, n, of[at:to][has]
        at = to


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text of each trigram, and per text whether it has a letter."""
    low = [" " + t.lower() + " " for t in texts]
    size = np.fromiter(map(len, low), dtype=np.int64, count=len(low))
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), size)
    letter = _letters()[points]
    has = np.zeros(len(low), dtype=bool)
    has[row[letter]] = True
    points = np.where(letter, points, 32).astype(np.uint64)
    keep = letter.copy()
    keep[1:] |= letter[:-1] | (row[1:] != row[:-1])
    if len(keep):
        keep[0] = True
    points, row = points[keep], row[keep]
    h = points[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ points[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ points[2:] * np.uint64(0x165667B19E3779F9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
    same = row[:-2] == row[2:]
    return bucket[same], row[:-2][same], has


def counts(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """Trigram counts (lang, bucket, n) of all rows with language and text; partly summed in the tasks."""
    rows = docs.select(F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).where("lang is not null and text is not null")

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for name, n in held.items():
                b = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n[b])], names=["lang", "bucket", "n"])
            held.clear()

        for b in blocks(batches, "text"):
            names = b.column("lang").to_pylist()
            order = {x: i for i, x in enumerate(dict.fromkeys(names))}
            code = np.fromiter((order[x] for x in names), dtype=np.int64, count=len(names))
            for key, often, _ in trigrams(b.column("text").to_pylist()):
                of = code[key // BUCKETS]
                for name, i in order.items():
                    mine = of == i
                    if mine.any():
                        n = np.bincount(key[mine] % BUCKETS, often[mine], BUCKETS).astype(np.int64)
                        held[name] = held[name] + n if name in held else n
                if len(held) > 32:
                    yield from flush()
        yield from flush()

    return rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class Model:
    """Languages and the log likelihood of each bucket under each. The table may have fewer buckets than BUCKETS, of which each joins neighbours."""

    def __init__(self, langs: list[str], log: np.ndarray) -> None:
        self.langs, self.log = langs, log

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, list[dict[str, float]]]:
        """Per text the language, the score, and the proportions of the chosen languages."""
        k, names, score, mix = len(self.langs), [UND] * len(texts), np.zeros(len(texts)), [{} for _ in texts]
        has = np.zeros(len(texts), dtype=bool)
        keys, often = [], []
        for key, n, lettered in trigrams(texts) if k else ():
            keys.append(key)
            often.append(n)
            has[lettered] = True
        if not has.any():
            return names, score, mix
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        n = np.bincount(place, np.concatenate(often)) / OVERLAP
        row, bucket = key // BUCKETS, key % BUCKETS // (BUCKETS // len(self.log))
        some, start = np.unique(row, return_index=True)
        log = self.log[bucket]
        alone = np.add.reduceat(log * n[:, None], start)
        total = np.add.reduceat(n, start)
        at = np.repeat(np.arange(len(some)), np.diff(np.append(start, len(row))))
        top = log.max(axis=1)
        like = np.exp(log - top[:, None])
        base = np.add.reduceat(top * n, start)
        price = np.log(np.maximum(total, 2))
        pi, full = _em(like, n, at, start, np.full((len(some), k), 1 / k))
        full += base
        best = alone.argmax(axis=1)
        chosen = np.zeros((len(some), k))
        chosen[np.arange(len(some)), best] = 1
        value = 2 * alone[np.arange(len(some)), best]
        # the full mixture bounds every smaller one, so only texts that could gain are looked at further
        order = np.argsort(-pi, axis=1, kind="stable")
        for size in range(2, k + 1):
            open_ = np.flatnonzero(2 * full - price * (size - 1) > value)
            if not len(open_):
                break
            mask = np.zeros((len(some), k))
            np.put_along_axis(mask, order[:, :size], 1.0, axis=1)
            take = np.isin(at, open_)
            sub = np.searchsorted(open_, at[take])
            first = np.searchsorted(sub, np.arange(len(open_)))
            p0 = (pi * mask)[open_] + 1e-9 * mask[open_]
            p, ll = _em(like[take], n[take], sub, first, p0 / p0.sum(axis=1, keepdims=True))
            gain = 2 * (ll + base[open_]) - price[open_] * (size - 1)
            better = gain > value[open_]
            value[open_[better]] = gain[better]
            chosen[open_[better]] = p[better]
        winner = chosen.argmax(axis=1)
        single = (chosen > 0).sum(axis=1) == 1
        posterior = 1 / np.exp(np.clip(alone - alone.max(axis=1, keepdims=True), -700, 0)).sum(axis=1)
        value = np.where(single, posterior, chosen[np.arange(len(some)), winner])
        for i, r in enumerate(some.tolist()):
            if has[r]:
                names[r] = self.langs[winner[i]]
                score[r] = value[i]
                mix[r] = {self.langs[j]: float(chosen[i, j]) for j in np.flatnonzero(chosen[i] > 0)}
        return names, np.clip(score, 0, 1), mix


def _em(like: np.ndarray, n: np.ndarray, at: np.ndarray, start: np.ndarray, pi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions when they stand still, and the log likelihood under them (less the factor taken out of ``like``)."""
    pi = pi.copy()
    live, x, m, of, first = np.arange(len(pi)), like, n, at, start
    while len(live):
        part = x * pi[live][of]
        part *= (m / part.sum(axis=1))[:, None]
        new = np.add.reduceat(part, first)
        new /= new.sum(axis=1, keepdims=True)
        moves = np.abs(new - pi[live]).max(axis=1) > STILL
        pi[live] = new
        if not moves.all():
            keep = moves[of]
            x, m, of, live = x[keep], m[keep], (np.cumsum(moves) - 1)[of[keep]], live[moves]
            first = np.searchsorted(of, np.arange(len(live)))
    return pi, np.add.reduceat(n * np.log((like * pi[at]).sum(axis=1)), start)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """The model of the languages of ``docs``, of at most CELLS cells however many languages there are."""
    summed = counts(docs, text, lang)
    rows = summed.toPandas() if docs.sparkSession.conf.get("spark.sql.execution.arrow.pyspark.enabled") == "true" else _collected(summed)
    langs = sorted(set(rows["lang"]))
    joined = 1
    while BUCKETS // joined * len(langs) > CELLS and joined < BUCKETS:
        joined *= 2
    table = np.zeros((BUCKETS // joined, len(langs)))
    code = {x: i for i, x in enumerate(langs)}
    np.add.at(table, (np.asarray(rows["bucket"], dtype=np.int64) // joined, [code[x] for x in rows["lang"]]), rows["n"])
    used = int((table.sum(axis=1) > 0).sum()) + 1
    return Model(langs, np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * used)).astype(np.float64))


def _collected(df: DataFrame) -> dict[str, list]:
    t = df.toArrow()
    return {c: t.column(c).to_pylist() for c in df.columns}


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and mixture (map from language to proportion) of every row."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text", 2 << 20):
            names, score, mix = sent.value.predict(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array([list(m.items()) for m in mix], pa.map_(pa.string(), pa.float64()))], names=["doc_id", "lang_pred", "score", "mixture"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, mixture map<string,double>")


def held_out(docs: DataFrame, m: int = 4, rest: int = 2) -> DataFrame:
    """Predictions for all documents by a model of those whose crc32 of the id is not ``rest`` modulo m."""
    model = learn(docs.where(crc_mod("doc_id", m) != rest))
    return predict(docs, model).select("doc_id", (crc_mod("doc_id", m) == rest).alias("held_out"), "lang_pred", "score", "mixture")


def accepted(docs: DataFrame, model: Model, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows, with all their columns, whose text is in a language: not ``und``, and with a score of ``least`` at least."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, text, 2 << 20):
            names, score, _ = sent.value.predict(b.column(text).to_pylist())
            yield b.filter(pa.array([n != UND and s >= least for n, s in zip(names, score.tolist(), strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
