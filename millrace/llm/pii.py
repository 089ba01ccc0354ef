"""Personal data in texts: four patterns, and a conditional random field that finds what is written otherwise.

*Patterns.* E-mail addresses, IP addresses, card and phone numbers of a plain form are found from the left, without overlap within
a kind; matches that fail their kind's test (numbers up to 255, 14 to 19 digits that pass Luhn's test, 10 to 15 digits) are
dropped. The patterns are run in forms that take time in proportion to a text: an address is found by its at sign and
completed to the left, and digits are matched from where they begin, without going back.

*Linear-chain conditional random field.* The labels are those of a span's first and later tokens of each kind, and of none. The
features are word shapes: of a token and of two on either side, and pairs of neighbouring shapes. Its weights
maximise the penalised likelihood of a small labelled table (texts and spans), by gradients from forward and backward
sums over padded batches in numpy. Viterbi decoding, in numpy batches too, gives the labels of whole chains. A chain is the text within
``AROUND`` characters of a digit, an at sign or a spelled at or dot; further off no token can be in a span, so chains are
independent and nothing is lost between them. Spans of the model need what their kind needs and must not touch one of a pattern.

The labelled table reaches the driver, at most ``most`` rows of it (a parameter); ``examples`` writes one of phone numbers without
a plus sign, spelled-out addresses, dotted cards, bracketed and colon-separated addresses, and of numbers that are none of these. The
model is tables of shapes by labels, a few MB whatever the data.

Null and empty texts have no spans; null ids and repeated rows are handled row by row; a very long text is one row, of which only
the tokens of its chains are held, about 200 bytes each. ``find`` and ``redact`` read only the text and keep all other columns;
columns named like the results are replaced. An empty table gives an empty result, an empty labelled table a model that finds nothing.
"""

from __future__ import annotations

import random
import re
import string
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import blocks, released, sampled

KINDS = ("email", "ip", "card", "phone")
#: Characters on either side of a digit or at sign that belong to its chain.
AROUND = 64

_LOCAL = string.ascii_letters + string.digits + "._%+-"
_HOST = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = re.compile(r"[^0-9]+")


class Span(NamedTuple):
    start: int
    kind: int
    end: int
    model: bool


def luhn(digits: str) -> bool:
    """Whether every second digit from the right, doubled, and the others sum to a multiple of ten."""
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def _holds(kind: int, value: str) -> bool:
    """The test of a kind."""
    if kind == 1:
        return all(len(x.lstrip("0")) < 4 and int(x) < 256 for x in value.split("."))
    digits = _NO_DIGIT.sub("", value)
    return kind == 0 or (14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15)


def patterns(text: str) -> list[Span]:
    """Spans of the plain forms, by start and kind."""
    out, over = [], 0
    for m in _HOST.finditer(text) if "@" in text else ():
        start = over + len(text[over : m.start()].rstrip(_LOCAL))
        if start < m.start():
            out.append(Span(start, 0, m.end(), False))
            over = m.end()
    for kind, pattern in ((1, _IP), (2, _CARD), (3, _PHONE)):
        out += [Span(m.start(), kind, m.end(), False) for m in pattern.finditer(text) if _holds(kind, m[0])]
    return sorted(out)


# --- tokens and chains

_TOKEN = re.compile(r"(?<!\w)(?=[0-9]*[a-f])(?=[a-f]*[0-9])[0-9a-f]{2,4}(?!\w)|[0-9]+|[^\W\d_]+|\w|[^\w\s]")
_NEAR = re.compile(r"[0-9]+|@|(?<=[\[({])\s*(?:at|AT|dot|DOT)\s*(?=[\])}])|(?<!\w)(?:dot|DOT)(?!\w)")
#: Words that spell out an address. Fixed values.
_SPELLED = {"at", "dot"}
#: Labels: 0 outside, 1 + 2 kind the first token of a span, 2 + 2 kind the later ones.
LABELS = 1 + 2 * len(KINDS)


def _shape(token: str, spaced: bool) -> str:
    n = len(token)
    if token.isascii() and token.isdigit():
        size = f"{n}" if n < 8 else "8-12" if n < 13 else "13-19" if n < 20 else "long"
        out = "d" + size + (">" if n == 3 and token > "255" else "") + ("0" if n > 1 and token[0] == "0" else "")
    elif n > 1 and not token.isalpha():
        out = "hex"
    elif token.isalpha():
        low = token.lower()
        hexes = "h" if n < 5 and all(c in "abcdef" for c in low) else ""
        out = f"w:{low}" if low in _SPELLED else ("X" if token.isupper() else "Xx" if token[0].isupper() else "x") + (str(n) if n < 4 else "") + hexes
    else:
        out = token if token.isascii() else "other"
    return out + ("_" if spaced else "")


def tokens(text: str, lo: int, hi: int) -> tuple[list[str], list[int], list[int]]:
    """Shapes, first and last places of the tokens of a part of a text."""
    shapes, starts, ends = [], [], []
    last = lo
    for m in _TOKEN.finditer(text, lo, hi):
        shapes.append(_shape(m[0], m.start() > last))
        starts.append(m.start())
        ends.append(last := m.end())
    return shapes, starts, ends


def chains(text: str) -> Iterator[tuple[int, int]]:
    """The parts of a text that can hold spans; at their edges are whole words."""
    lo = hi = -1
    for m in _NEAR.finditer(text):
        a, b = max(0, m.start() - AROUND), min(len(text), m.end() + AROUND)
        if lo < 0:
            lo, hi = a, b
        elif a <= hi:
            hi = b
        else:
            yield _whole(text, lo, hi)
            lo, hi = a, b
    if lo >= 0:
        yield _whole(text, lo, hi)


def _whole(text: str, lo: int, hi: int) -> tuple[int, int]:
    """Without the parts of words that the edges cut: at most AROUND characters go, and no digit or sign that made the chain."""
    if lo and text[lo - 1].isalnum():
        while text[lo].isalpha():
            lo += 1
    if hi < len(text) and text[hi].isalnum():
        while text[hi - 1].isalpha():
            hi -= 1
    return lo, hi


# --- the model

#: Places of the shapes whose single weights count, and pairs of places. Fixed values.
SINGLE = (-2, -1, 0, 1, 2)
PAIRS = ((-1, 0), (0, 1), (-1, 1), (-2, -1), (1, 2))


class Model:
    """Weights by shape and label for each place and pair of places, and by label and next label."""

    def __init__(self, shapes: list[str]) -> None:
        self.id = {s: i for i, s in enumerate(sorted(set(shapes)), 2)}  # 0: past the edge, 1: not seen in training
        self.n = len(self.id) + 2
        self.single = np.zeros((len(SINGLE), self.n, LABELS))
        self.pairs = np.zeros((len(PAIRS), self.n * self.n, LABELS))
        self.step = np.zeros((LABELS, LABELS))
        #: A later token follows the first or a later one of its kind.
        self.banned = np.array([[b and b % 2 == 0 and a not in (b, b - 1) for b in range(LABELS)] for a in range(LABELS)])
        self.first_banned = np.array([b > 0 and b % 2 == 0 for b in range(LABELS)])

    def ids(self, shapes: list[str]) -> np.ndarray:
        return np.array([0, 0, *(self.id.get(s, 1) for s in shapes), 0, 0], dtype=np.int64)

    def cells(self, ids: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For padded shape ids (chains by places, two more at either edge) the rows of the tables that each place uses."""
        size = ids.shape[-1] - 4
        at = lambda k: ids[..., 2 + k : 2 + k + size]
        return [at(k) for k in SINGLE], [at(a) * self.n + at(b) for a, b in PAIRS]

    def scores(self, ids: np.ndarray) -> np.ndarray:
        single, pairs = self.cells(ids)
        return sum(w[c] for w, c in zip(self.single, single, strict=True)) + sum(w[c] for w, c in zip(self.pairs, pairs, strict=True))

    def steps(self) -> np.ndarray:
        return np.where(self.banned, -1e9, self.step)

    def decode(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """The likeliest labels of chains of about the same length."""
        sizes = np.array([len(x) - 4 for x in batch])
        ids = np.zeros((len(batch), int(sizes.max()) + 4), dtype=np.int64)
        for row, x in zip(ids, batch, strict=True):
            row[: len(x)] = x
        emit, steps = self.scores(ids), self.steps()
        best = np.where(self.first_banned, -1e9, emit[:, 0])
        back = np.zeros((ids.shape[1] - 4, len(batch), LABELS), dtype=np.int8)
        for t in range(1, len(back)):
            paths = best[:, :, None] + steps
            back[t] = paths.argmax(1)
            here = paths.max(1) + emit[:, t]
            live = sizes > t
            back[t][~live] = np.arange(LABELS)
            best = np.where(live[:, None], here, best)
        label = best.argmax(1)
        out = np.zeros((len(back), len(batch)), dtype=np.int8)
        for t in range(len(back) - 1, -1, -1):
            out[t] = label
            label = back[t][np.arange(len(batch)), label] if t else label
        return [out[:n, i] for i, n in enumerate(sizes)]

    def fit(self, chains: list[np.ndarray], labels: list[np.ndarray], rounds: int, penalty: float) -> None:
        """Adam's steps along the gradient of the penalised likelihood of all chains."""
        size = max(len(y) for y in labels)
        ids, gold = np.zeros((len(chains), size + 4), dtype=np.int64), np.zeros((len(chains), size), dtype=np.int64)
        live = np.zeros((len(chains), size), dtype=bool)
        for i, (x, y) in enumerate(zip(chains, labels, strict=True)):
            ids[i, : len(x)], gold[i, : len(y)], live[i, : len(y)] = x, y, True
        single, pairs = self.cells(ids)
        where = [c[live] for c in single], [c[live] for c in pairs]
        both = live[:, 1:] & live[:, :-1]
        steps_seen = np.zeros_like(self.step)
        np.add.at(steps_seen, (gold[:, :-1][both], gold[:, 1:][both]), 1)
        told = np.eye(LABELS)[gold] * live[..., None]
        weights = [self.single, self.pairs, self.step]
        speed = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        for k in range(1, rounds + 1):
            share, steps = self._expected(self.scores(ids), live)
            off = (told - share)[live]
            grads = [np.zeros_like(w) for w in weights]
            for g, cells in zip(grads[:2], where, strict=True):
                for table, c in zip(g, cells, strict=True):
                    for y in range(LABELS):
                        table[:, y] = np.bincount(c, off[:, y], len(table))
            grads[2] = steps_seen - steps
            for w, g, (mean, square) in zip(weights, grads, speed, strict=True):
                g -= penalty * w
                mean += 0.1 * (g - mean)
                square += 0.01 * (g * g - square)
                w += 0.2 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.99**k)) + 1e-8)

    def _expected(self, emit: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each label's probability at each place, and the expected number of each step."""
        steps = np.exp(self.steps())
        size = emit.shape[1]
        top = emit.max(2, keepdims=True)
        e = np.exp(emit - top)
        fore, rear, scale = np.zeros_like(e), np.ones_like(e), np.ones(e.shape[:2])
        fore[:, 0] = e[:, 0] * ~self.first_banned
        for t in range(size):
            if t:
                fore[:, t] = np.where(live[:, t, None], (fore[:, t - 1] @ steps) * e[:, t], fore[:, t - 1])
            scale[:, t] = fore[:, t].sum(1)
            fore[:, t] /= scale[:, t, None]
        for t in range(size - 2, -1, -1):
            next_ = (rear[:, t + 1] * e[:, t + 1]) @ steps.T / scale[:, t + 1, None]
            rear[:, t] = np.where(live[:, t + 1, None], next_, 1)
        share = fore * rear
        share = share / share.sum(2, keepdims=True) * live[..., None]
        ahead = np.where(live[:, 1:, None], rear[:, 1:] * e[:, 1:] / scale[:, 1:, None], 0)
        return share, steps * np.einsum("nta,ntb->ab", fore[:, :-1], ahead)


def _spans(text: str) -> Iterator[tuple[list[str], list[int], list[int]]]:
    for lo, hi in chains(text):
        found = tokens(text, lo, hi)
        if found[0]:
            yield found


def learn(labelled: DataFrame, text: str = "text", spans: str = "spans", most: int = 2000, rounds: int = 60, penalty: float = 0.3) -> Model:
    """A model of at most ``most`` rows of a table of texts and their spans (kind:start:end, comma-joined)."""
    rows = sampled(labelled.select(F.col(text).alias("text"), F.col(spans).alias("spans")).where("text is not null"), "text", most).collect()
    return _fitted(sorted(map(tuple, rows), key=str), rounds, penalty)


def _fitted(rows: list[tuple[str, str | None]], rounds: int, penalty: float) -> Model:
    seen: list[tuple[list[str], np.ndarray]] = []
    for text, spans in rows:
        marked = [(KINDS.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in (spans or "").split(",") if x)]
        for shapes, starts, ends in _spans(text):
            y = np.zeros(len(shapes), dtype=np.int64)
            for kind, a, b in marked:
                inside = [i for i, (s, e) in enumerate(zip(starts, ends, strict=True)) if s >= a and e <= b]
                y[inside] = 2 + 2 * kind
                y[inside[:1]] = 1 + 2 * kind
            seen.append((shapes, y))
    model = Model([s for shapes, _ in seen for s in shapes])
    if seen:
        model.fit([model.ids(shapes) for shapes, _ in seen], [y for _, y in seen], rounds, penalty)
    return model


# --- a small labelled table

#: Sentences; a name in braces is a value made by the rule of that name, marked as a span where it is a kind. Fixed values.
SENTENCES = (
    "{w} {w} {phone} {w} {w}. {W} {w}, {w}", "{W} {w}: {phone}", "{w} {w}, {phone}, {w} {w}", "{w} ({phone}) {w}", "{phone} {w} {phone}\n{W} {w}", "{W} {phone}. {W} {w} {w}", "{w}{p} {w}{p} {phone}{p} {w}{p} {W}{p}",
    "{w} {w} {email} {w} {w}.", "{W} {w}: {email}", "{w} <{email}> {w}", "{email}, {w} {email}; {w}", "{W} {w} {email}.\n{W}", "{w}{p} {email}{p} {w}{p}",
    "{w} {w} {ip} {w} {w}", "{W} {ip}, {w} {ip}.", "{w} ({ip}) {w} {n}", "{w} = {ip};", "{w}{p} {ip}{p} {w}{p}",
    "{w} {card} {w} {w}.", "{W} {w}: {card}, {w} {date}", "{w} {card} {card}", "{w}{p} {card}{p} {W}{p}",
    "{w} {date} {w} {w} {time}.", "{W} {n} {w} {n}, {w} {n}.", "{w} {price} {w} {price}", "({n}) {w} {version} {w}", "{W} {version}, {w} {w} {range}", "{w} {hex} {w} = \"{hex}\"",
    "{w} {order} {w} {order}", "{w} {order}, {date} {time}", "{w} @{w} {w} @ {n} {w}", "{w} at {w} at {n} {w}.", "{w} dot {w} at {w}", "{W} {w} {n}%, {price} {w} {n}:{n}", "{w}{p} {n}{p} {w}{p} {date}{p}", "Copyright (c) {year} {W} {W}. {w} {year}-{year}",
    "{date} {time} {w} {n}.{n} {w} {order}", "http://{w}.{w}.com/{n}/{w}?{w}={n} {w}", "{n} {n} {n} {n} {n} {n}", "{w} {n}/{n} {n} x {n} {w}, {isbn}", "{w}{n} {w}-{n} {W}{n}{w}", "[{n}] {w} {w}, {n}-{n} ({year}).",
)


def _rules(r: random.Random) -> dict[str, Callable[[], str]]:
    """How values of each name are made."""
    digits = lambda n: "".join(r.choice(string.digits) for _ in range(n))
    word = lambda: "".join(r.choice("etaoinshrdlé") for _ in range(r.randint(1, 9)))
    ascii_word = lambda: "".join(r.choice("etaoinshrdl") for _ in range(r.randint(2, 8)))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        full = next(body + d for d in string.digits if luhn(body + d))
        sep = r.choice([".", "/", "", " ", "-"])
        return sep.join(full[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = r.choice("23456789") + digits(2), digits(3), digits(4)
        return r.choice([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"1-{a}-{b}-{c}", f"+1 ({a}) {b}-{c}", f"+{digits(2)} {a} {b}{c}", f"0{digits(2)} {digits(2)} {digits(2)} {digits(2)} {digits(2)}", f"00{digits(2)} {a} {b} {c}"])

    def email() -> str:
        name, host, top = r.choice([ascii_word, lambda: f"{ascii_word()}.{ascii_word()}", lambda: f"{ascii_word()}{digits(2)}", lambda: f"{ascii_word()}.{digits(2)}"])(), ascii_word() + r.choice(["", digits(1)]), r.choice(["com", "org", "net", "de", "fr"])
        return r.choice([f"{name}@{host}.{top}", f"{name}@{host}.{ascii_word()}.{top}", f"{name} [at] {host} [dot] {top}", f"{name}[at]{host}.{top}", f"{name}(at){host}.{top}", f"{name} (at) {host} (dot) {top}", f"{name} at {host} dot {top}", f"{name} AT {host} DOT {top}", f"{name} @ {host}.{top}", f"{name} {{at}} {host}.{top}"])

    def ip() -> str:
        parts = [str(r.randint(0, 255)) for _ in range(4)]
        six = [f"{r.randint(0, 65535):x}" for _ in range(8)]
        return r.choice([".".join(parts), "[.]".join(parts), "(.)".join(parts), ":".join(six)])

    day = lambda: f"{r.randint(1, 28):02d}"
    return {
        "w": word, "W": lambda: word().capitalize() if r.random() < 0.8 else word().upper(), "p": lambda: r.choice(["!!", "%%%", "$$$", "***", "", "..."]), "phone": phone, "email": email, "ip": ip, "card": card,
        "n": lambda: digits(r.randint(1, 6)), "year": lambda: r.choice(["19", "20"]) + digits(2), "price": lambda: r.choice(["$", "€", ""]) + f"{digits(r.randint(1, 4))}.{digits(2)}", "time": lambda: f"{r.randint(0, 23)}:{digits(2)}" + r.choice(["", f":{digits(2)}"]),
        "date": lambda: r.choice([f"20{digits(2)}-{day()}-{day()}", f"{day()}.{day()}.20{digits(2)}", f"{day()}/{day()}/{digits(2)}"]), "version": lambda: r.choice([f"v{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(1)}.{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}.", f"{digits(3)}.{digits(4)}"]),
        "range": lambda: f"{digits(2)}-{digits(2)}", "hex": lambda: "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 20, 40]))), "order": lambda: r.choice([digits(r.randint(7, 12)), f"{digits(3)}-{digits(7)}-{digits(7)}", f"#{digits(8)}", digits(16), f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(4)}-{digits(4)}"]), "isbn": lambda: f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",
    }


def examples(spark: SparkSession, each: int = 24, seed: int = 5) -> DataFrame:
    """A small labelled table: ``each`` rows of each sentence, as text and spans."""
    return spark.createDataFrame(_written(each, seed), "text string, spans string")


def _written(each: int, seed: int) -> list[tuple[str, str]]:
    r = random.Random(seed)
    rules = _rules(r)
    rows = []
    for sentence in SENTENCES * each:
        text, spans = "", []
        for i, part in enumerate(re.split(r"\{(\w+)\}", sentence)):
            value = rules[part]() if i % 2 else part
            if i % 2 and part in KINDS:
                spans.append(f"{part}:{len(text)}:{len(text) + len(value)}")
            text += value
        rows.append((text, ",".join(spans)))
    return rows


# --- over tables

def _needs(kind: int, value: str) -> bool:
    """What a span of the model must have."""
    if kind == 0:
        return len(value) > 5 and re.search(r"(?i)@|\bat\b", value) is not None and re.search(r"(?i)\.|\bdot\b", value) is not None
    if kind == 1:
        plain = re.sub(r"[\[\]()]", "", value)
        six = plain.split(":")
        return len(six) == 8 and all(re.fullmatch("[0-9a-fA-F]{1,4}", x) for x in six) or re.fullmatch(r"[0-9]+(\.[0-9]+){3}", plain) is not None and _holds(1, plain)
    return len(re.findall("[0-9]+", value)) > 1 and _holds(kind, value)


def found(texts: list[str], model: Model) -> list[list[Span]]:
    """The spans of each text: of the patterns, and of the model where it marks text that no pattern marks."""
    out = [patterns(t) for t in texts]
    where, batch = [], []
    for i, text in enumerate(texts):
        for shapes, starts, ends in _spans(text):
            where.append((i, starts, ends))
            batch.append(model.ids(shapes))
    order = sorted(range(len(batch)), key=lambda k: len(batch[k]))
    at = 0
    while at < len(order):
        to = at + 1
        while to < len(order) and to - at < 512 and len(batch[order[to]]) * (to - at) < 100_000:
            to += 1
        for k, labels in zip(order[at:to], model.decode([batch[k] for k in order[at:to]]), strict=True):
            i, starts, ends = where[k]
            marked = np.flatnonzero(labels)
            for p in marked[labels[marked] % 2 == 1].tolist():
                q = p + 1
                while q < len(labels) and labels[q] == labels[p] + 1:
                    q += 1
                a, b, kind = starts[p], ends[q - 1], (int(labels[p]) - 1) // 2
                if _needs(kind, texts[i][a:b]) and not any(s.start < b and a < s.end for s in out[i] if not s.model):
                    out[i].append(Span(a, kind, b, True))
        at = to
    return [sorted(x) for x in out]


SPANS = "array<struct<kind: string, start: int, end: int, value: string, by: string>>"


def _mapped(docs: DataFrame, model: Model, text: str, out: str, kind: T.DataType, make: Callable[[str, list[Span]], object]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)
    keep = [f for f in docs.schema.fields if f.name != out]
    schema = T.StructType([*keep, T.StructField(out, kind)])
    arrow = pa.string() if isinstance(kind, T.StringType) else pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("by", pa.string())]))

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks([batch], text):
                texts = b.column(text).to_pylist()
                values = [None if t is None and isinstance(kind, T.StringType) else make(t or "", s) for t, s in zip(texts, found([t or "" for t in texts], sent.value), strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in keep), pa.array(values, arrow)], names=schema.names)

    return docs.select(*[f.name for f in keep]).mapInArrow(run, schema)


def find(docs: DataFrame, model: Model, text: str = "text", out: str = "spans") -> DataFrame:
    """``docs`` with the spans of ``text`` (code points, end exclusive) in a column ``out``, by start and kind; ``by`` is pattern or model."""
    told = lambda t, spans: [{"kind": KINDS[s.kind], "start": s.start, "end": s.end, "value": t[s.start : s.end], "by": "model" if s.model else "pattern"} for s in spans]
    return _mapped(docs, model, text, out, T._parse_datatype_string(SPANS), told)


def redact(docs: DataFrame, model: Model, text: str = "text", out: str = "redacted") -> DataFrame:
    """``docs`` with the text, each span replaced by its kind in angle brackets, in a column ``out``; of overlapping spans the first stays. Null stays null."""

    def told(t: str, spans: list[Span]) -> str:
        parts, at = [], 0
        for s in spans:
            if s.start >= at:
                parts += [t[at : s.start], f"<{KINDS[s.kind]}>"]
                at = s.end
        return "".join([*parts, t[at:]])

    return _mapped(docs, model, text, out, T.StringType(), told)


def digests(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Numbers of the patterns' spans by kind, their hash, and all spans as kind:start:end."""
    both = find(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model, out="all")
    plain = F.filter("all", lambda s: s["by"] == "pattern")
    said = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return both.withColumn("base", plain).select(F.col("doc_id").alias(doc_id), *map(count, KINDS), F.sha2(said(F.col("base")), 256).alias("base_sha256"), said(F.col("all")).alias("spans"))
