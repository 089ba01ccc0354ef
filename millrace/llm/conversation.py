"""Repair of conversations by composed weighted automata.

Three automata over the rows of a conversation are composed. The *input acceptor* reads the rows in order, each as its
role's initial and whether it has to go or is truncated. The *edit transducer* keeps a row (K, nothing), gives it the role
user or assistant (R, 3), deletes it (D, 4; what blank and repeated rows need) or puts an empty row in (I, 3); a truncated row
that isn't deleted costs 3 more. Its state is the number of rows put in since the last one was read: two at most, as
a third would lead where the first did, so the composition has no cycles. The *role grammar* accepts (s?(ua)+)?.
The composition is lazy: the arcs that leave a state of all three are made when such a state is first met with such a row.

Weights are pairs of cost and string of edits, compared in that order, and the string's order is that of ASCII. Along a path
costs add and strings join. The least pair is not kept by joining on the right (D is before DD, but DK after DDK), only by joining
on the left, so distances are those to the end, found in reverse topological order. There, of two strings that start
with different edits the first edit decides, and from one state each edit leads to one state; so a state keeps its
cost and its first edit, and the strings need not be spelled out until the path is walked. A row takes 36 bytes so.

Rows of a conversation are ordered by turn (nulls first), role and sha-256 of role and text. A row's first fault counts: *blank*
without a character but ASCII white space, *duplicate* when role and text stood before (a window by conversation and
hash: a text that a conversation repeats endlessly streams through it), *truncated* if the last such character is none of .!?

Conversations are dealt by id and sorted, a row twice: first what the automata need, then the whole row. So a task reads a
conversation's small rows, finds the path, and lets the texts pass by one at a time. It never holds a conversation's texts;
of a conversation of any length it holds some bytes a row, as its audit does. One conversation is one task, since the
audit is one string and the hash one chain over all its texts.

Null roles and texts are one space: a blank row. A null turn comes first, and a null id is an id. Repeated rows are duplicates
but for the first. A role without an initial can't be kept. A very long text is one row. Other columns are not read, whatever
their names. An empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import released

#: What the edits cost, and a truncated row that stays. Fixed values.
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: The role grammar: from each state, the initials that may follow and the state after. Accepting states.
GRAMMAR = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTING = (0, 3)
INITIALS = {x for arcs in GRAMMAR for x in arcs}
#: Rows put in a run at most.
RUN = 2
_NEVER = 1 << 60
_STATES = len(GRAMMAR) * (RUN + 1)

SPACE = " \t\n\v\f\r"


@functools.cache
def _arcs(state: int, initial: str, must_go: bool, cut: bool, end: bool) -> tuple[tuple[str, int, int, bool, str], ...]:
    """The arcs of the composition from a state with the row ahead: edit, cost, next state, whether the row is read, the initial given out."""
    run, role = divmod(state, len(GRAMMAR))
    out = []
    if run < RUN:
        out += [("I", INSERT, (run + 1) * len(GRAMMAR) + to, False, x) for x, to in GRAMMAR[role].items() if x in ROLES]
    if not end:
        out.append(("D", DELETE, role, True, ""))
        if not must_go:
            more = TRUNCATED * cut
            out += [("R", RENAME + more, to, True, x) for x, to in GRAMMAR[role].items() if x in ROLES]
            if initial in GRAMMAR[role]:
                out.append(("K", more, GRAMMAR[role][initial], True, initial))
    return tuple(sorted(out))


def shortest(rows: list[tuple[str, bool, bool]]) -> tuple[int, list[tuple[str, str]]]:
    """The least cost of rows (initial, must go, truncated), and the path: edit and initial given out, in order."""
    after = [0 if s % len(GRAMMAR) in ACCEPTING else _NEVER for s in range(_STATES)]
    first: list[bytearray] = []
    for i in range(len(rows), -1, -1):
        row = (*rows[i], False) if i < len(rows) else ("", False, False, True)
        here = [_NEVER] * _STATES
        pick = bytearray(b"\xff" * _STATES)
        for s in range(_STATES - 1, -1, -1):  # arcs that read nothing lead to higher states
            if row[3]:
                here[s] = after[s]
            for k, (_, cost, to, reads, _) in enumerate(_arcs(s, *row)):  # in the order of edits: the first of equal ones stays
                total = cost + (after[to] if reads else here[to])
                if total < here[s]:
                    here[s], pick[s] = total, k
        after = here
        first.append(pick)
    path, s, i = [], 0, 0
    while first[-1 - i][s] != 0xFF:
        row = (*rows[i], False) if i < len(rows) else ("", False, False, True)
        edit, _, s, reads, given = _arcs(s, *row)[first[-1 - i][s]]
        path.append((edit, given))
        i += reads
    return after[0], path


def _prepared(turns: DataFrame, conv_id: str, turn: str, role: str, text: str, there: Column | None = None) -> DataFrame:
    """Small rows and then whole rows of each conversation, in order. Rows where ``there`` is false only name their conversation."""
    say = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), say(role).alias("role"), say(text).alias("text"), (F.lit(True) if there is None else there).alias("there"))
    rows = rows.withColumn("text", F.when(F.col("there"), F.col("text"))).withColumn("h", F.sha2(F.concat(F.length("role"), F.lit(":"), "role", "text"), 256))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    small = rows.select("conv_id", "turn", "role", "h", "there", F.lit(0).alias("phase"), (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("cut"), F.lit(None).cast("string").alias("text"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "h").orderBy(F.col("turn").asc_nulls_first())) > 1
    small = small.withColumn("twice", F.col("there") & seen)
    whole = rows.where("there").withColumns({"phase": F.lit(1), "blank": F.lit(None).cast("boolean"), "cut": F.lit(None).cast("boolean"), "twice": F.lit(None).cast("boolean")})
    both = small.unionByName(whole)
    keys = ["conv_id", "phase", F.col("turn").asc_nulls_first(), "role", "h", "twice"]
    return both.repartition("conv_id").sortWithinPartitions(*keys).select("conv_id", "phase", "turn", "role", "there", "blank", "cut", "twice", "text")


class _Talk:
    """One conversation as its rows come by: first all small ones, then the whole ones."""

    def __init__(self, conv_id: object) -> None:
        self.conv_id, self.known, self.path, self.at, self.before = conv_id, [], None, 0, ""
        self.turns = [None, None, 0]  # least, greatest, how many
        self.blank = self.twice = self.cut = self.illegal = self.cost = 0
        self.lines = 0
        self.hash = hashlib.sha256()

    def small(self, turn: int | None, role: str, blank: bool, cut: bool, twice: bool) -> None:
        if turn is not None and turn != self.turns[1]:
            self.turns = [turn if self.turns[0] is None else self.turns[0], turn, self.turns[2] + 1]
        if self.known:
            self.illegal += (self.before + role[:1]) not in ("su", "ua", "au")
        self.before = role[:1]
        self.blank += blank
        self.twice += twice and not blank
        self.cut += cut and not blank and not twice
        self.known.append((role[:1] if role[:1] in INITIALS else "", blank or twice, cut))

    def _steps(self) -> list[tuple[str, str]]:
        if self.path is None:
            self.cost, self.path = shortest(self.known)
            self.known = []
        return self.path

    def _line(self, role: str, text: str, edit: str) -> Iterator[tuple]:
        self.hash.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1
        yield self.conv_id, self.lines, role, text, edit

    def _inserted(self) -> Iterator[tuple]:
        path = self._steps()
        while self.at < len(path) and path[self.at][0] == "I":
            yield from self._line(ROLES[path[self.at][1]], "", "I")
            self.at += 1

    def whole(self, role: str, text: str) -> Iterator[tuple]:
        yield from self._inserted()
        edit, given = self._steps()[self.at]
        self.at += 1
        if edit != "D":
            yield from self._line(role if edit == "K" else ROLES[given], text, edit)

    def over(self) -> Iterator[tuple]:
        yield from self._inserted()

    def audit(self) -> tuple:
        gaps = 0 if self.turns[0] is None else self.turns[1] - self.turns[0] + 1 - self.turns[2]
        return (self.conv_id, gaps, self.blank, self.twice, self.cut, self.illegal, self.cost, "".join(e for e, _ in self._steps()), self.hash.hexdigest())


_TYPES = {"long": pa.int64(), "string": pa.string()}


def _run(prepared: DataFrame, columns: str, lines: bool) -> DataFrame:
    """Lines of the repaired conversations, or one row for each conversation."""
    id_type = prepared.schema["conv_id"].dataType
    names = ["conv_id", *(x.split()[0] for x in columns.split(", "))]
    kinds = [_TYPES[x.split()[1]] for x in columns.split(", ")]

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0
        talk, kind = None, None

        def made() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [kind, *kinds], strict=True)], names=names)

        def rows() -> Iterator[tuple]:
            nonlocal talk, kind
            for b in batches:
                kind = b.schema.field("conv_id").type
                for at in range(0, b.num_rows, 256):
                    for conv_id, phase, turn, role, there, blank, cut, twice, text in zip(*(c.to_pylist() for c in b.slice(at, 256).columns), strict=True):
                        if talk is None or conv_id != talk.conv_id:
                            if talk is not None:
                                yield from over(talk)
                            talk = _Talk(conv_id)
                        if phase:
                            yield from chosen(talk.whole(role, text))
                        elif there:
                            talk.small(turn, role, blank, cut, twice)
            if talk is not None:
                yield from over(talk)

        def chosen(found: Iterator[tuple]) -> Iterator[tuple]:
            for x in found:
                if lines:
                    yield x

        def over(talk: _Talk) -> Iterator[tuple]:
            yield from chosen(talk.over())
            if not lines:
                yield talk.audit()

        for row in rows():
            out.append(row)
            held += len(row[3]) if lines else len(row[7]) + 100
            if len(out) >= 4096 or held > 4 << 20:
                yield made()
                out, held = [], 0
        if out:
            yield made()

    return prepared.mapInArrow(run, f"conv_id {id_type.simpleString()}, {columns}")


def audited(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """A row for each conversation: gaps in its turns, blank, duplicate and truncated rows, illegal neighbours, the cost and edits of its repair, and the hash of what comes out.

    Rows where ``there`` is false are absent; a conversation of only such rows has nothing to repair.
    """
    return _run(_prepared(turns, conv_id, turn, role, text, there), "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string", lines=False).withColumnRenamed("conv_id", conv_id)


def repaired(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The rows of the repaired conversations: place (from 1), role, text, and the edit that made each (K, R or I)."""
    return _run(_prepared(turns, conv_id, turn, role, text), "place long, role string, text string, edit string", lines=True).withColumnRenamed("conv_id", conv_id)


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Conversations with faults that a checksum of id and turn puts in, and which rows are still there. Nulls are one space."""
    say = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(say("conv_id"), F.lit(":"), say("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(say("role")).alias("role"), F.when(kind == 1, "").when(kind == 2, F.translate(say("text"), ".!?", "")).otherwise(say("text")).alias("text"), kind.alias("kind"))
    copies = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("*", copies.alias("copy")), F.col("kind") != 0


def damaged_and_audited(turns: DataFrame) -> DataFrame:
    rows, there = damaged(turns)
    return audited(rows, there=there)
