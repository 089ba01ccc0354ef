import itertools
import re
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from millrace.llm import pii
from millrace.llm.queries import queries

#: The contract's patterns as they stand.
PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def checksum(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (2 if i % 2 else 1)
        total += d // 10 + d % 10
    return total % 10 == 0


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    return (True, all(int(x) <= 255 for x in value.split(".")) if kind == 1 else None, 14 <= len(digits) <= 19 and checksum(digits), 10 <= len(digits) <= 15)[kind]


def plain(text):
    """Spans of the patterns by Python's own engine."""
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PATTERNS) for m in re.finditer(p, text) if valid(k, m[0]))


@pytest.fixture(scope="module")
def model(spark):
    return pii.learn(pii.examples(spark))


ODD = st.text(st.sampled_from("@@..a-+%9019 ()é٣\n_Z"), max_size=30)
NUMBERS = st.text(st.sampled_from("0123456789.- +("), max_size=60)
PIECES = st.lists(st.sampled_from(["4111 1111 1111 1111", "a.b@c.de", "@", "1.2.3.4", "255.1.1.256", ".", "+1 (830) 555-5433", "-", " ", "x", "+", "378282246310005", "é"]), max_size=12).map("".join)


@settings(max_examples=500, deadline=None)
@given(st.one_of(ODD, NUMBERS, PIECES))
def test_patterns_are_the_contracts(text):
    assert [(s.start, s.kind, s.end) for s in pii.patterns(text)] == plain(text)


def test_patterns_take_time_in_proportion():
    import time

    began = time.time()
    for piece in ("a", "1", "1.", "+1(", "a@", "@", "1 ", "a.b@c.d", "4111-"):
        pii.patterns(piece * 300_000)
    assert time.time() - began < 30


def small_model(seed):
    model = pii.Model(["x", "d3", "@", "-"])
    r = np.random.default_rng(seed)
    for w in (model.single, model.pairs, model.step):
        w += r.normal(size=w.shape)
    return model


def score(model, ids, labels):
    if model.first_banned[labels[0]] or any(model.banned[a, b] for a, b in zip(labels, labels[1:])):
        return -np.inf
    return model.scores(ids)[np.arange(len(labels)), labels].sum() + sum(model.step[a, b] for a, b in zip(labels, labels[1:]))


@pytest.mark.parametrize("seed", range(4))
def test_viterbi_and_sums_equal_enumeration(seed):
    model = small_model(seed)
    chains = [model.ids(s) for s in (["x"], ["d3", "-", "?"], ["@", "x", "d3", "d3"])]
    decoded = model.decode(chains)
    size = 4
    ids, live = np.zeros((3, size + 4), dtype=np.int64), np.zeros((3, size), dtype=bool)
    for i, x in enumerate(chains):
        ids[i, : len(x)], live[i, : len(x) - 4] = x, True
    share, steps = model._expected(model.scores(ids), live)
    want_steps = np.zeros_like(steps)
    for i, x in enumerate(chains):
        n = len(x) - 4
        paths = list(itertools.product(range(pii.LABELS), repeat=n))
        scores = np.array([score(model, x, list(p)) for p in paths])
        assert tuple(decoded[i]) == paths[scores.argmax()]
        p = np.exp(scores - scores.max())
        p /= p.sum()
        for t in range(n):
            assert np.allclose(share[i, t], np.bincount([q[t] for q in paths], p, pii.LABELS))
        for q, w in zip(paths, p):
            for a, b in zip(q, q[1:]):
                want_steps[a, b] += w
    assert np.allclose(steps, want_steps, atol=1e-6)


def test_held_out_spans(model):
    hit = want_all = extra = 0
    for text, spans in pii._written(6, 77):
        want = set(filter(None, spans.split(",")))
        got = {f"{pii.KINDS[s.kind]}:{s.start}:{s.end}" for s in pii.found([text], model)[0]}
        hit, want_all, extra = hit + len(want & got), want_all + len(want), extra + len(got - want)
    assert hit >= 0.9 * want_all and extra <= 0.05 * want_all, (hit, want_all, extra)


def test_model_adds_to_the_patterns(model):
    text = "Der ber +1 (826) 555-4081 190.137.223.4 und so, heit (830) 555-5433 en. It was 2021-03-04 12:30, 1234567 of 99.5%."
    spans = pii.found([text], model)[0]
    assert {text[s.start : s.end] for s in spans if s.model} == {"+1 (826) 555-4081", "(830) 555-5433"}
    assert [(s.start, s.kind, s.end) for s in spans if not s.model] == plain(text)


def test_chains_do_not_depend_on_what_is_far(model):
    text = "call (830) 555-5433 now"
    alone = [(s.kind, s.end - s.start) for s in pii.found([text], model)[0]]
    far = "word and word " * 40
    assert [(s.kind, s.end - s.start) for s in pii.found([far + text + " " + far + text], model)[0]] == alone * 2


def test_query_equals_the_definition(spark, small_tables):
    rows = {r.doc_id: r for r in queries()["op12_personal_data"](spark, small_tables).collect()}
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    for doc_id, text in docs:
        r, want = rows[doc_id], plain(text or "")
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == kind for _, k, _ in want) for kind in range(4))
        said = [f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in want]
        assert r.base_sha256 == sha256(",".join(said).encode()).hexdigest()
        assert set(said) <= set(r.spans.split(",")) | {""}
        starts = [(int(x.split(":")[1]), pii.KINDS.index(x.split(":")[0])) for x in r.spans.split(",") if x]
        assert starts == sorted(starts)
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows.values()) > 3


def test_odd_rows_and_redaction(spark, model):
    rows = [(1, None), (2, ""), (None, "a@b.cd"), (3, "😀 a@b.cd 1.2.3.4"), (3, "😀 a@b.cd 1.2.3.4"), (4, "x" * 500_000 + " +1 (830) 555-5433"), (5, "1 " * 3000)]
    docs = spark.createDataFrame([(*r, "keep", 1) for r in rows], "doc_id long, text string, spans string, kind int")
    got = sorted(map(tuple, pii.digests(docs, model).collect()), key=str)
    none = sha256(b"").hexdigest()
    assert (1, 0, 0, 0, 0, none, "") in got and (2, 0, 0, 0, 0, none, "") in got and len(got) == 7
    assert sum(r[-1] == "email:2:8,ip:9:16" for r in got) == 2
    assert [r[-1] for r in got if r[0] == 4] == ["phone:500001:500018"]
    out = pii.redact(docs, model)
    assert out.columns == ["doc_id", "text", "spans", "kind", "redacted"]
    texts = {r.doc_id: r.redacted for r in out.collect()}
    assert texts[1] is None and texts[2] == "" and texts[3] == "😀 <email> <ip>" and texts[None] == "<email>"
    assert pii.digests(docs.limit(0), model).count() == 0
    found = pii.find(docs, model).where("doc_id = 3").first()
    assert found.kind == 1 and [tuple(s) for s in found.spans] == [("email", 2, 8, "a@b.cd", "pattern"), ("ip", 9, 16, "1.2.3.4", "pattern")]


def test_empty_labels(spark):
    model = pii.learn(pii.examples(spark, each=1).limit(0))
    assert pii.found(["a@b.cd (830) 555-5433"], model) == [[pii.Span(0, 0, 6, False)]]
