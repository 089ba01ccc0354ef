import re
import zlib
from hashlib import sha256

from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import conversation
from millrace.llm.queries import queries

FAULTS = {"blank": 0, "duplicate": 0, "truncated": 0}


def faults(rows):
    """The first fault of each (role, text), by name or None."""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\v\f\r")
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def every_repair(rows):
    """All sequences of edits that cost no more than deleting all rows: (cost, audit, result)."""
    bound, kinds = 4 * len(rows), faults(rows)
    stack = [(0, "", (), 0)]
    while stack:
        cost, audit, out, i = stack.pop()
        if cost > bound or not any(x.startswith("".join(r[:1] for r, _ in out)) for x in ("ua" * 12, "s" + "ua" * 12)):
            continue
        if i == len(rows):
            if all(r for r, _ in out) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)):
                yield cost, audit, out
        else:
            role, text = rows[i]
            stack.append((cost + 4, audit + "D", out, i + 1))
            if kinds[i] not in ("blank", "duplicate"):
                more = 3 * (kinds[i] == "truncated")
                if role:
                    stack.append((cost + more, audit + "K", (*out, (role, text)), i + 1))
                stack += [(cost + 3 + more, audit + "R", (*out, (x, text)), i + 1) for x in ("user", "assistant")]
        stack += [(cost + 3, audit + "I", (*out, (x, "")), i) for x in ("user", "assistant")]


def plain(conv_id, rows):
    """The definition for rows (turn, role, text) in order, trying every repair."""
    said = [(r, t) for _, r, t in rows]
    kinds = faults(said)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit, out = min(every_repair(said), key=lambda x: x[:2])
    pairs = [a[0][:1] + b[0][:1] for a, b in zip(said, said[1:])]
    lines = "\n".join(f"{r}:{t}" for r, t in out)
    return (conv_id, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in FAULTS), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, sha256(lines.encode()).hexdigest())


ROLES = st.sampled_from(["system", "user", "assistant", "tool", "", "User", "ux"])
TEXTS = st.sampled_from(["a.", "b!", "c", " \n", "", "d. ", "é?\x0b", "x\x0b\x0c"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(ROLES, TEXTS), max_size=4))
def test_shortest_path_is_the_least_of_all_repairs(rows):
    kinds = faults(rows)
    cost, path = conversation.shortest([(r[:1], k in ("blank", "duplicate"), k == "truncated") for (r, _), k in zip(rows, kinds)])
    assert (cost, "".join(e for e, _ in path)) == min(x[:2] for x in every_repair(rows))


def test_strings_are_compared_from_the_left():
    # two cheapest strings of different lengths: DK.. would win by prefixes, but not as a whole
    rows = [("u", False, False), ("u", False, False), ("a", False, False), ("a", False, False)]
    cost, path = conversation.shortest(rows)
    assert (cost, "".join(e for e, _ in path)) == min(x[:2] for x in every_repair([("user", "1."), ("user", "2."), ("assistant", "3."), ("assistant", "4.")]))


def damage(rows):
    """Rows (conv, turn, role, text) as the contract damages them, by conversation and in order."""
    by = {}
    for c, turn, role, text in rows:
        there = by.setdefault(c, [])
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            there += [(turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    order = lambda r: (r[0] is not None, r[0], r[1].encode(), sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest())
    return {c: sorted(rs, key=order) for c, rs in by.items()}


def test_query_equals_the_definition(spark, small_tables):
    table = spark.read.parquet(f"{small_tables}/conversations.parquet")
    want = {plain(c, rows) for c, rows in damage(map(tuple, table.collect())).items() if len(rows) < 7}
    got = {tuple(r) for r in queries()["op13_conversation_repair"](spark, small_tables).collect()}
    assert len(want) >= 15 and want <= got and len(got) == table.select("conv_id").distinct().count()
    assert {r[2:5] for r in got} - {(0, 0, 0)} and any(r[5] for r in got)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, None, "user", "a."), (1, 4, "assistant", "b."), (1, 2, "user", "a."), (None, 1, "tool", "x"), (None, 3, "", "y."), (2, None, "user", "q."), (2, None, "user", "q."), (3, 0, "user", "z" * 300_000 + "."), (3, 2, "assistant", "ok. \x0b")]
    rows += [(c, 0, "user", "t.") for c in range(100, 160)] + [(5, 1, "user", "\U0001f600!"), (5, 1, "assistant", "é")]
    turns = spark.createDataFrame([(*r, 7, "h") for r in rows], "conv_id long, turn long, role string, text string, phase int, h string").repartition(3)
    got = {tuple(r) for r in conversation.damaged_and_audited(turns).collect()}
    assert got == {plain(c, r) for c, r in damage(rows).items()}
    assert sum(r[1:7] == (0, 0, 0, 0, 0, 0) and r[7] == "" for r in got) >= 1  # all rows dropped
    assert conversation.damaged_and_audited(turns.limit(0)).count() == 0


def test_repaired_rows_and_own_names(spark):
    turns = spark.createDataFrame([("x", 1, "user", "hi."), ("x", 2, "user", "again"), ("x", 2, "user", "again"), ("y", 1, "system", "s."), ("y", 2, "assistant", "b.")], "talk string, at int, who string, said string")
    got = conversation.repaired(turns, "talk", "at", "who", "said")
    assert sorted(map(tuple, got.collect())) == sorted((c, i, *x) for c, xs in {"x": [("user", "hi.", "K"), ("assistant", "again", "R")], "y": [("system", "s.", "K"), ("user", "", "I"), ("assistant", "b.", "K")]}.items() for i, x in enumerate(xs, 1))
    assert conversation.repaired(turns.limit(0), "talk", "at", "who", "said").count() == 0


def test_a_long_conversation_needs_little_memory(spark):
    # 40,000 rows of one conversation, dealt from many tasks
    turns = spark.range(40_000).selectExpr("0L conv_id", "id turn", "if(id % 2 = 0, 'user', 'assistant') role", "concat('w', id, '.') text")
    row = conversation.audited(turns).collect()[0]
    assert row.cost == 0 and row.audit == "K" * 40_000 and row.gaps == 0
    assert row.repaired_sha256 == sha256("\n".join(f"{'ua'[i % 2] == 'u' and 'user' or 'assistant'}:w{i}." for i in range(40_000)).encode()).hexdigest()
