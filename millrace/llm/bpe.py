"""BPE encoding and decoding through a tokenization automaton.

The merges are compiled by successive gadgets. At first every base symbol is an arc from every state.
The gadget of merge k, (u, v) -> w, takes from the state reached by arc u its arc v, and gives every
state that had u before v an arc w to the state that v led to, as that state is just then. After all
merges, the label sequences of paths are exactly the tokenizations that BPE makes, so a word has one.
The gadgets are kept as tables: the parts of each token and the time of its merge. From them follows whether a
state keeps an arc: the state after w is the state after v at time k, and w leaves a state iff u
left it at time k.

These arcs are tokens, but a word is read symbol by symbol, so the automaton is made deterministic over symbols.
A state stands for the longest end of what was read that begins a token still to come, with the last token of the
tokenization at each place in it; reading a symbol leads to one next state, whose last token is the longest one that
ends there and is an arc of the state where it begins. Of the states and transitions, far more than memory holds,
texts use few: a transition is compiled when it is first taken and then stands in the table. Encoding is a
walk along the table, and a walk back over the states' last tokens; decoding emits arc labels.
The table and the words that workers keep are bounded; when a bound is reached they are compiled anew, with the same results.

Null and empty texts have no ids; decoding null ids gives the empty text. Rows are handled one by one:
repeated rows give repeated results, null ids are like others, an empty table gives an empty result, and other columns
pass through ``encode`` and ``decode`` unread, whatever their names (one named like the result is replaced). A
very long text is a block of its own and takes about 60 times its bytes of a worker's memory.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WordMemo, Words, blocks, gathered, released

#: Bytes that stand for themselves in byte-level vocabularies; the others get the characters from 256 on. Fixed values.
_OWN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
_CHARS = {b: chr(b) for b in _OWN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _OWN)}
_SPACES = regex.compile(r"\s+")
_TABLE = {b: c for b, c in _CHARS.items() if chr(b) != c}
#: Transitions and words that are kept at most, per worker.
TRANSITIONS, PIECES = 400_000, 120_000
#: The last token at the beginning of a word, and where no tokenization ends.
BEGIN, NONE = -1, -2


class Automaton:
    """The automaton of a BPE model in the tokenizers library's format (its ``model`` part)."""

    def __init__(self, model: dict) -> None:
        if model.get("type") != "BPE" or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("only plain BPE models have an automaton here")
        self.id: dict[str, int] = dict(model["vocab"])
        self.suffix = model.get("end_of_word_suffix") or ""
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        n = max(self.id.values(), default=-1) + 1
        self.birth, self.left, self.right = [-1] * n, [-1] * n, [-1] * n
        self.rank: dict[int, int] = {}
        self.alive = [True] * n
        self.begins: set[str] = set()
        self.length = [0] * n
        for t, i in self.id.items():
            symbols = self._symbols(t)
            self.length[i] = len(symbols)
            self.begins.update("".join(symbols[:k]) for k in range(1, len(symbols)))
        self._empty()
        for k, (u, v) in enumerate(pairs):
            a, b, w = self.id[u], self.id[v], self.id[u + v]
            self.rank.setdefault(a << 32 | b, k)
            if self.birth[w] < 0:
                self.birth[w], self.left[w], self.right[w] = k, a, b
        # w has arcs only where u was followed by v when its gadget was built
        for w, k in sorted(enumerate(self.birth), key=lambda x: x[1]):
            if k >= 0:
                self.alive[w] = self.alive[self.left[w]] and self.alive[self.right[w]] and self._made(self.left[w], self.right[w], k)
        self.memo: dict[str, list[int]] = {}

    def _made(self, p: int, t: int, time: int) -> bool:
        """Whether the state after p has arc t once the gadgets before ``time`` are built."""
        birth, rank = self.birth, self.rank
        while True:
            if rank.get(p << 32 | t, time) < time:
                return False
            a, b = birth[p], birth[t]
            if a < 0 and b < 0:
                return True
            if a > b:
                time, p = a, self.right[p]  # as that state was before the gadget that made p
            else:
                time, t = b + 1, self.left[t]  # the gadget that made t counts: u of (u, u) keeps no arc u

    def _symbols(self, token: str) -> list[str]:
        """A token's symbols; the mark of a word's end belongs to the last one."""
        end = self.suffix
        body = token[: -len(end)] if end and token.endswith(end) and len(token) > len(end) else token
        return [*body[:-1], body[-1] + token[len(body) :]] if body else []

    def _empty(self) -> None:
        """A table with the beginning alone, state 0."""
        self.known = {("", (BEGIN,)): 0}
        self.states = [("", (BEGIN,))]
        self.token, self.next, self.size = [BEGIN], [{}], 0

    def _compile(self, state: int, symbol: str) -> int:
        """The transition from a state by a symbol, which is put in the table."""
        read, ends = self.states[state]
        last = NONE
        for k in range(len(ends)):
            t = self.id.get(read[k:] + symbol)
            before = ends[k]
            if t is not None and self.alive[t] and before != NONE and (before == BEGIN or self._made(before, t, len(self.rank) + 1)):
                last = t
                break
        read, ends = read + symbol, (*ends, last)
        k = next((k for k in range(len(read)) if read[k:] in self.begins), len(read)) if len(symbol) == 1 else len(read)
        made = (read[k:], ends[k - len(read) - 1 :] if k < len(read) else ends[-1:])
        to = self.known.get(made)
        if to is None:
            to = self.known[made] = len(self.states)
            self.states.append(made)
            self.token.append(last)
            self.next.append({})
        self.next[state][symbol] = to
        self.size += 1
        return to

    def word(self, symbols: str) -> list[int]:
        """The ids of one pre-split word, given as characters of the vocabulary."""
        if not symbols:
            return []
        found = self.memo.get(symbols)
        if found is None:
            if len(self.memo) >= PIECES:
                self.memo.clear()
            found = self.memo[symbols] = self._run(symbols)
        return found

    def _run(self, s: str) -> list[int]:
        if self.size >= TRANSITIONS:
            self._empty()
        state, path, table = 0, [], self.next
        for c in [*s[:-1], s[-1] + self.suffix]:
            to = table[state].get(c)
            state = self._compile(state, c) if to is None else to
            path.append(self.token[state])
        if path[-1] == NONE:
            raise ValueError(f"no symbol for {next((c for c in s if c not in self.id), s[-1])!r}")
        out, i = [], len(path)
        while i:
            out.append(path[i - 1])
            i -= self.length[path[i - 1]]
        return out[::-1]


class Codec:
    """Encodes texts and decodes ids as the tokenizer of a tokenizers file does, without special tokens added."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        self.automaton = Automaton(d["model"])
        self.special = {t["content"]: t["id"] for t in d.get("added_tokens", [])}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in d.get("added_tokens", [])):
            raise ValueError("added tokens must be matched as they are")
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.steps = self._steps(d.get("normalizer"))
        self.pattern, self.keeps = self._pattern(d.get("pre_tokenizer"))
        self.byte_decoder = (d.get("decoder") or {}).get("type") == "ByteLevel"
        if d.get("decoder") and not self.byte_decoder:
            raise ValueError("unknown decoder")
        n = max([*self.automaton.id.values(), *self.special.values()], default=-1) + 1
        self.label = np.empty(n, dtype=object)
        for t, i in [*self.automaton.id.items(), *self.special.items()]:
            self.label[i] = t
        self.memo = WordMemo(self._many)

    @staticmethod
    def _steps(x: dict | None) -> list[str]:
        steps = []
        for s in ([] if not x else x["normalizers"] if x["type"] == "Sequence" else [x]):
            if s["type"] == "Replace" and s["pattern"] == {"Regex": "\\s+"} and s["content"] == " ":
                steps.append("space")
            elif s["type"] in ("NFC", "Lowercase"):
                steps.append(s["type"])
            else:
                raise ValueError(f"unknown normalizer {s['type']}")
        return steps

    @staticmethod
    def _pattern(x: dict | None) -> tuple[regex.Pattern, bool]:
        """The pattern of pieces, and whether texts may be cut at ASCII white space before (no piece holds any)."""
        for s in [] if not x else x["pretokenizers"] if x["type"] == "Sequence" else [x]:
            if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]:
                return regex.compile(s["pattern"]["Regex"]), False
            if s["type"] == "ByteLevel" and s.get("use_regex", True) and not s.get("add_prefix_space"):
                return regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"), True
        raise ValueError("unknown pre-tokenizer")

    def text(self, text: str) -> list[int]:
        parts = self.split.split(text) if self.split and any(t in text for t in self.special) else [text]
        out: list[int] = []
        for i, part in enumerate(parts):
            if i % 2:
                out.append(self.special[part])
            elif part:
                out += self._plain(part)
        return out

    def _plain(self, s: str) -> list[int]:
        for step in self.steps:
            if step == "NFC":
                s = s if s.isascii() else unicodedata.normalize("NFC", s)
            elif step == "space":
                s = _SPACES.sub(" ", s)
            else:  # character by character, so sigma has no final form
                s = s.lower() if "Σ" not in s else "".join(map(str.lower, s))
        if not self.keeps and s.isalpha() and s.isascii():
            return self.automaton.word(s)
        out: list[int] = []
        for piece in self.pattern.findall(s):
            out += self.automaton.word(piece if piece.isascii() and " " not in piece and piece.isprintable() else piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(_TABLE))
        return out

    def _many(self, words: list[bytes]) -> list[list[int]]:
        return [self.text(w.decode("utf-8", "replace")) for w in words]

    def block(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a block of texts and, per text, their number."""
        if self.keeps:
            lists = [self.text(x or "") for x in arr.to_pylist()]
            size = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
            return np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(size.sum())), size
        words = Words(arr, lower=False)
        start, size, inverse = self.memo.lists(words)
        each = size[inverse].astype(np.int64)
        total = np.concatenate([[0], np.cumsum(each)])
        return gathered(self.memo.flat, start[inverse], each), np.diff(total[words.first])

    def decode(self, ids: np.ndarray) -> str:
        labels = self.label[ids].tolist()
        if self.byte_decoder:
            return _bytes("".join(labels)).decode("utf-8", "replace")
        return " ".join(labels)


def _bytes(s: str) -> bytes:
    back = {c: b for b, c in _CHARS.items()}
    return bytes(back[c] if c in back else ord(" ") for c in s)


_LOADED: dict[int, Codec] = {}


def _codec(spec: str) -> Codec:
    """One codec per worker process and tokenizer: its tables and memo serve all tasks there."""
    key = hash(spec)
    if key not in _LOADED:
        _LOADED[key] = Codec(spec)
    return _LOADED[key]


def _spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, text: str = "text", out: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with the ids of ``text`` in a new column ``out`` (array of int) in place of the text.

    With ``decoded`` a column of that name gets the text that the ids decode to, in the same pass: one
    worker process then does both, and the ids need not go through Spark twice.
    ``tokenizer`` is a file that the driver can read; its contents (a few MB) go to the executors.
    """
    spec = docs.sparkSession.sparkContext.broadcast(_spec(tokenizer))
    keep = [f for f in docs.schema.fields if f.name not in (text, out, decoded)]
    schema = T.StructType([*keep, T.StructField(out, T.ArrayType(T.IntegerType(), False), False), *([T.StructField(decoded, T.StringType(), False)] if decoded else [])])

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for b in blocks(batches, text):
            ids, size = codec.block(b.column(text))
            offsets = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            cols = [*(b.column(f.name) for f in keep), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))]
            if decoded:
                cols.append(pa.array([codec.decode(ids[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, names=schema.names)

    return docs.select(*[f.name for f in keep], text).mapInArrow(run, schema)


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the text of ``ids`` in a new column ``out``."""
    spec = df.sparkSession.sparkContext.broadcast(_spec(tokenizer))
    schema = T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, T.StringType(), False)])
    names = [f.name for f in schema.fields[:-1]]

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(spec.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                lists = b.column(ids)
                if lists.null_count:
                    texts = [codec.decode(np.array(x or [], dtype=np.int64)) for x in lists.to_pylist()]
                else:
                    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
                    flat = lists.flatten().to_numpy(zero_copy_only=False)
                    texts = [codec.decode(flat[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, out])

    return df.select(*[n for n in df.columns if n != out]).mapInArrow(run, schema)
