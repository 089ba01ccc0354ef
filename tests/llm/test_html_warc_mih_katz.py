import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import pytest
from millrace.llm import html, katz, mih, warc
from millrace.llm.html import Page, extract
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<p>one<p>two", "one\n\ntwo"),
        ("a <b>b</b>c\n d&amp;&lt;", "a bc d&<"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
        ("<table><tr><th>Name<th>N<tr><td>apple pie<td>12</table>", "Name       N\napple pie  12"),
        ("<table><tr><td>a<td>b<tr><td colspan=2>wide one</table>", "a  b\nwide one"),
        ("<table><tr><td>a<br>b<td>c</table>", "a  c\nb"),
        ("<pre>\n x\n   y</pre>z", " x\n   y\n\nz"),
        ("<div style='display:none'>no<p>no</div><span hidden>no</span>yes", "yes"),
        ("<style>.n, #i{display:none}</style><i class='m n'>no</i><i id=i>no</i>yes", "yes"),
        ("<div style='visibility:hidden'>no <i style='visibility:visible'>yes</i></div>", "yes"),
        ("<title>t</title><script>var a='</p>'</script><noscript>n</noscript>2 < 3 <!-- c -->x", "2 < 3 x"),
        ("</p></div><b>x</table>", "x"),
        ("<h1>T</h1>a<br>b<hr>c", "T\n\na\nb\n\nc"),
        ("<a title='x > y'>k</a><textarea>v</textarea>", "kv"),
        ("", ""),
        (None, ""),
        ("<", "<"),
        ("<!-- open", ""),
    ],
)
def test_layout(source, want):
    assert Page(source).text == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ("<a title=\"Bob's page\">k</a><p>seen</p><b title=\"it's\">x</b>", "k\n\nseen\n\nx"),
        ("<img alt=\"it's\">" + "<p>word</p>" * 1000, "\n\n".join(["word"] * 1000)),
        ("<i title='say \"x'>k</i> <i hidden title='>\"'>no</i>seen", "k seen"),
        ("<div data-json='" + "{\"a\": \"<b>\"}" * 10000 + "'>k</div>seen", "k\nseen"),
        ('<iframe srcdoc="' + "<p>it's</p>" * 1000 + '"></iframe>seen', "seen"),
        ("<p title = \"a>b\"class=c>k<p a=it's>l<p a=b'hidden>m", "k\n\nl\n\nm"),
        ("<i a\"b>k</i><i =\">l</i><i a=>m</i><i/>n", "klmn"),
        ("<script>no</script a='>' >k<i hidden HIDDEN=2 style=x>no</i></b a='>'>l", "kl"),
        ("k<a title='never ends>l</a>", "k"),
    ],
)
def test_ends_of_tags(source, want):
    assert Page(source).text == want


@pytest.mark.parametrize(
    ("source", "want"),
    [
        ('<style>.n{display:none}</style><p class=n style="display:block">seen', "seen"),
        ("<style>@media print{.n{display:none}}</style><p class=n>seen", "seen"),
        ("<style>@media screen and (min-width: 600px){.n{display:none}} p{color:red}</style><p class=n>no</p><p>seen", "seen"),
        ("<style>@media (max-width: 600px){.n{display:none}}</style><p class=n>seen", "seen"),
        ("<style>#i{display:block} .n{display:none}</style><p class=n id=i>seen<p class=n>no", "seen"),
        ("<style>.n{display:none} .m{display:inline}</style><i class='n m'>seen</i><i class='m n'>too</i>", "seentoo"),
        ("<style>.n{display:none!important}</style><p class=n style='display:block'>no</p>seen", "seen"),
        ("<style>p{display:block}</style><p hidden>seen", "seen"),
        ("<style>@font-face{src:url(x)} @import 'a.css'; *{visibility:hidden} b{visibility:visible}</style><i>no</i><b>seen", "seen"),
        ("<style>q::before{content:'}'} .n{display:none</style><p class=n>no</p>seen", "seen"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("<table><tr><td>a<td rowspan=0>b<td>x<tr><td>c<td>y<tr><td>d<td>z</table>", "a  b  x\nc     y\nd     z"),
        ("<svg><title>no</title><desc>no</desc><text x=1>seen</text><text>too</text></svg>", "seen\ntoo"),
        ("<math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math>", "x=2"),
        ("<svg><title>no</title></svg><title>t</title>", ""),
    ],
)
def test_what_is_seen(source, want):
    assert Page(source).text == want


class Plain(HTMLParser):
    """A second renderer: the seen words of a page in any layout."""

    def __init__(self, source):
        super().__init__(convert_charrefs=True)
        self.open, self.words = [], []
        self.feed(source)
        self.close()

    def handle_starttag(self, tag, attrs):
        style = re.sub(r"\s", "", dict(attrs).get("style") or "").lower()
        hides = tag in html.UNSEEN or "hidden" in dict(attrs) or "display:none" in style or "visibility:hidden" in style
        if tag in html.BLOCK or tag in html.CELLS or tag in ("br", "hr"):
            self.words.append(" ")
        if tag not in html.VOID:
            self.open.append((tag, hides))

    def handle_endtag(self, tag):
        if tag in html.BLOCK or tag in html.CELLS:
            self.words.append(" ")
        if tag in (t for t, _ in self.open):
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(h for _, h in self.open):
            self.words.append(data)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.01"])
def test_same_words_as_a_plain_renderer(spark, folder):
    pages = spark.read.parquet(f"/root/testdata/{folder}/pages.parquet").select("page_id", "html")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    marks = re.compile(r"^(-|\d+\.)$")
    for r in pages.collect():
        want = Counter("".join(Plain(r.html or "").words).split())
        have = Counter(got[r.page_id].split())
        assert all(marks.match(w) for w in have - want), (r.page_id, have - want)
        assert not want - have, (r.page_id, want - have)


def test_deep_and_long_pages(spark):
    assert Page("<div>" * 20000 + "x").text == "x"
    assert len(Page("<p>word</p>" * 30000).text.split()) == 30000
    df = spark.createDataFrame([(1, "<title>A &amp; B</title><p>x", "q"), (2, None, "q"), (1, "<p>x", "q")], "page_id long, html string, text string")
    assert sorted(tuple(r) for r in extract(df).collect()) == [(1, "", "x"), (1, "A & B", "x"), (2, "", "")]
    assert extract(df.limit(0)).count() == 0


def pages():
    big, other = "<p>" + "x" * 1500, "<p>é" + "y" * 990
    return [(1, "http://a/1", big), (2, "http://a/2 \n", big), (3, None, big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (7, "u", other), (8, "u", "<p>" + "z" * 996), (9, "u", "<p>" + "z" * 997), (10, "u", "<p>" + "z" * 997), (10, "u", "<p>" + "z" * 997), (None, "u", big)]


def plain_pages(rows):
    data = [(i, (h or "").encode()) for i, _, h in rows]
    least = defaultdict(list)
    for i, b in data:
        if len(b) >= 1000:
            least[b].append(i)
    out = []
    for i, b in data:
        own = least.get(b, [])
        top = max((x for x in own if x is not None), default=None)
        again = len(own) > 1 and i != top
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if again else "response", top if again else None))
    return sorted(out, key=str)


def test_warc_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(*r, "k") for r in pages()], "page_id long, url string, html string, kind string")
    folder = f"file://{tmp_path}/w"
    assert sorted((tuple(r) for r in warc.page_records(df, folder).collect()), key=str) == plain_pages(pages())
    back = warc.read(spark, folder)
    assert back.where("status <> 'ok'").count() == 0
    texts = {bytes(r.payload) for r in back.where("kind = 'response'").collect()}
    assert texts == {(h or "").encode() for _, _, h in pages()}
    assert warc.page_records(df.limit(0)).count() == 0


@pytest.mark.parametrize("packed", [True, False])
def test_salvage(packed):
    records = [warc._record(str(i), "http://u", f"payload {i}".encode() * 50, hashlib.sha1(f"payload {i}".encode() * 50).hexdigest(), "response", None, "2024-01-01T00:00:00Z") for i in range(6)]
    parts = []
    for r in records:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        parts.append(z.compress(r) + z.flush() if packed else r)
    damaged = bytearray(parts[2])
    damaged[len(damaged) // 2] ^= 0xFF
    broken = [parts[0], parts[1], bytes(damaged), b"garbage \x1f\x8b\x08 junk" if packed else b"garbage", parts[3], parts[4], parts[5][: len(parts[5]) // 2]]
    data = b"".join(broken)
    got = list(warc.salvage(data))
    ids = [x["head"]["warc-record-id"][-2] for kind, x in got if kind == "record"]
    assert ids == ["0", "1", "3", "4"]
    gaps = [x for kind, x in got if kind == "gap"]
    lost = sum(b - a for a, b, _ in gaps)
    assert lost == len(broken[2]) + len(broken[3]) + len(broken[6])
    assert [x for kind, x in warc.salvage(b"".join(parts)) if kind == "gap"] == []
    assert list(warc.salvage(b"")) == []


def test_salvage_decides_at_each_place():
    block = lambda i, payload: warc._record(str(i), "http://u", payload, hashlib.sha1(payload).hexdigest(), "response", None, "2024-01-01T00:00:00Z")

    def member(x):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(x) + z.flush()

    def found(data):
        got = list(warc.salvage(data))
        return [x["head"]["warc-record-id"][-2] for kind, x in got if kind == "record"], [x[:2] for kind, x in got if kind == "gap"]

    records = [block(i, f"payload {i}".encode() * 50) for i in range(3)]
    lost = b"\xff" * 100_000
    assert found(lost + b"".join(map(member, records))) == (["0", "1", "2"], [(0, len(lost))])
    coded = [block(i, member(f"payload {i}".encode() * 50)) for i in range(3)]
    assert found(b"".join(coded)) == (["0", "1", "2"], [])
    assert found(coded[0] + b"junk" + member(records[1]) + coded[2]) == (["0", "1", "2"], [(len(coded[0]), len(coded[0]) + 4)])


def test_nearest_equal_vectors_ties_and_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (50, [0.0, 1.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0]), (5, None), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [1.0]), (9, [None, 1.0]), (10, [-1.0, 0.0]), (11, [1.0, 0.0]), (11, [1.0, 0.0]), (100, [0.0, 0.0]), (150, [1.0, 0.0, 0.0]), (151, [0.0, 1.0, 0.0]), (152, [3.0, 1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<double>, score double")
    got = sorted(tuple(r) for r in mih.nearest(df, "vec_id % 50 = 0", 3).collect())
    assert [x[:3] for x in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 11), (50, 1, 3), (50, 2, 0), (50, 3, 1), (150, 1, 152), (150, 2, 151)]
    assert got[3][3] == pytest.approx(math.sqrt(0.5))
    few = df.where("vec_id in (0, 3)")
    assert [(r.query_id, r.vec_id) for r in mih.nearest(few, "vec_id % 50 = 0", 3).collect()] == [(0, 3)]
    assert mih.nearest(df.limit(0), "vec_id % 50 = 0", 3).count() == 0


def test_pigeonhole_finds_every_code_within_the_radius():
    import numpy as np

    rng = np.random.default_rng(3)
    codes = rng.integers(0, 1 << 16, size=(500, 4), dtype=np.uint16)
    index = mih.Index(codes)
    for radius in (0, 5, 20, 29):
        want = np.flatnonzero(mih._distance(codes, codes[7]) <= radius)
        assert index.within(codes[7], radius).tolist() == want.tolist()


def test_recall_on_the_test_table(spark, small_tables):
    v = spark.read.parquet(f"{small_tables}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in v.select("vec_id", "embedding").collect()]
    truth = mih.brute_force(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = defaultdict(set)
    for r in mih.nearest(v, "vec_id % 50 = 0", 5).collect():
        got[r.query_id].add(r.vec_id)
    assert sum(len({j for j, _ in x} & got[q]) for q, x in truth.items()) >= 0.9 * sum(map(len, truth.values()))


LOW = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def katz_plain(rows, m=10, order=3):
    toks = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % m == 0, (t or "").encode().translate(LOW).split() + [None]) for i, t in rows]
    pad = [0] * (order - 1)
    grams = lambda x, n: [tuple((pad + x)[j + order - n : j + order]) for j in range(len(x))]
    c = {n: Counter(g for _, h, x in toks if not h for g in grams(x, n)) for n in range(1, order + 1)}
    total, v, starts = sum(c[1].values()), len(c[1]), sum(not h for _, h, _ in toks)
    d = {n: katz.discounts([list(c[n].values()).count(r) for r in range(1, katz.K + 2)]) for n in c}
    kept = lambda n, r: r * (d[n][r - 1] if r <= katz.K else 1)
    after = lambda h: total if not h else starts if set(h) == {0} else c[len(h)][h]
    follow = defaultdict(list)
    for n in c:
        for g in c[n]:
            follow[g[:-1]].append(g[-1])
    rest = 1 - sum(kept(1, r) for r in c[1].values()) / (total + 1)
    weights = {}

    def weight(h):
        if h not in weights:
            own = sum(kept(len(h) + 1, c[len(h) + 1][(*h, w)]) for w in follow[h]) / (after(h) + 1)
            weights[h] = (1 - own) / (1 - sum(p(h[1:], w) for w in follow[h]))
        return weights[h]

    def p(h, w):
        r = c[len(h) + 1][(*h, w)]
        if r:
            return kept(len(h) + 1, r) / (after(h) + 1)
        if not h:
            return rest
        return (weight(h) if after(h) else 1) * p(h[1:], w)

    for h in [x for x in follow if x][:30]:
        assert rest * math.prod(weight(h[k:]) for k in range(len(h))) + sum(p(h, w) for (w,) in c[1]) == pytest.approx(1)
    out = []
    for i, h, x in toks:
        base = sum(math.log10((c[1][w,] + 0.1) / (total + 0.1 * (v + 1))) for w in x)
        s = sum(math.log10(p(g[:-1], g[-1])) for g in grams(x, order))
        out.append((i, h, len(x), sum(c[1][w,] > 0 for w in x), total, base, s))
    return out


@pytest.mark.parametrize("order", [1, 3])
def test_katz_equals_brute_force(spark, small_tables, monkeypatch, order):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet").limit(120).select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(1000, None), (1001, ""), (1002, "never seen words here"), (1003, "The THE the " * 400), (1003, "The THE the " * 400), (None, "a b"), (1007, "a b　c")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, score string, chunk int")
    monkeypatch.setattr(katz, "BUCKET_TOKENS", 3000)
    monkeypatch.setattr(katz, "HISTORY", 40)
    monkeypatch.setattr(katz, "CHUNK_BYTES", 20_000)
    got = sorted((tuple(r) for r in katz.held_out(df, order=order).collect()), key=lambda r: (str(r[0]), r[2]))
    want = sorted(katz_plain(rows, order=order), key=lambda r: (str(r[0]), r[2]))
    assert len(got) == len(want)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert g[5] == pytest.approx(w[5], rel=1e-6) and g[6] == pytest.approx(w[6], rel=1e-6)


def test_katz_without_training_texts(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in katz.score(df, F.lit(False)).collect()}
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].score) == (3, 0, 0, 0.0)
    assert katz.held_out(df.limit(0)).count() == 0


HEAVY = {
    "wide": "<table>" + "<tr><td>" + "x" * 100_000 + "</td><td>y</td></tr>" + "<tr><td>a</td><td>b</td></tr>" * 1000 + "</table>",
    "quotes": "".join("<blockquote>x" for _ in range(4000)),
    "rowspan": "<table><tr>" + "<td rowspan=65534>a</td>" * 300 + "</tr>" + "<tr><td>b</td></tr>" * 2000 + "</table>",
    "colspan": "<table>" + ("<tr>" + "<td colspan=1000>a" * 50) * 200,
    "empty cells": "<table><tr>" + "<td>" + "w" * 60 + "".join("<tr><td><td><td><td><td>x" for _ in range(2000)),
    "breaks": "<table><tr><td>" + "w" * 64 + "<td>" + "w" * 64 + "<td>" + "x<br>" * 3000,
    "tables in tables": "<table><tr><td>a<td>" * 60 + "b<br>" * 500,
    "lists": "<ul><li>x" * 3000,
    "reversed": "<ol reversed><li>x" * 3000,
    "spans": "<td rowspan=2 colspan=999>a<tr>" * 3000,
}


@pytest.mark.parametrize("name", HEAVY)
def test_output_is_in_proportion_to_the_page(name):
    import time

    began = time.time()
    text = html.Page(HEAVY[name]).text
    assert len(text) <= 20 * len(HEAVY[name]) and time.time() - began < 10


def test_dialogs_details_and_numbers():
    page = "<ol reversed><li>a<li>b<ol><li>c</ol><li value=7>d<li>e</ol><dialog>no</dialog><dialog open>yes</dialog><details>no<summary>sum</summary><p>no</p><summary>no</summary></details><details open><summary>s</summary>shown</details>"
    assert html.Page(page).text.split() == "4. a 3. b 1. c 7. d 6. e yes sum s shown".split()
    assert html.Page("<ol reversed start=3><li>a<li>b</ol><ol start=-1><li>c<li value=x>d</ol>").text.split() == "3. a 2. b -1. c 0. d".split()
    assert html.Page("<dialog style='display:block'>seen</dialog>").text == "seen"


def test_records_before_a_fault_in_a_member_come_back():
    import gzip

    records = [warc._record(str(i), "http://e.org", (f"payload {i} " * 400).encode() + bytes(range(256)) * 20, "x", "response", None, "2024-01-01T00:00:00Z") for i in range(5)]
    five, after = gzip.compress(b"".join(records)), gzip.compress(warc._record("9", "u", b"later", "x", "response", None, "2024-01-01T00:00:00Z"))
    ids = lambda data: [x["head"]["warc-record-id"].rsplit(":")[-1][:-1] for kind, x in warc.salvage(data) if kind == "record"]
    gaps = lambda data: [x[:2] for kind, x in warc.salvage(data) if kind == "gap"]
    trailer = five[:-6] + b"\x00" * 6
    assert ids(trailer + after) == ["0", "1", "2", "3", "4", "9"] and gaps(trailer + after) == [(0, len(trailer))]
    cut = five[: len(five) * 3 // 4]
    found = ids(cut + after)
    assert found[-1] == "9" and found[:-1] == ["0", "1", "2", "3", "4"][: len(found) - 1] and len(found) >= 2
    assert ids(cut) == found[:-1] and gaps(cut) == [(0, len(cut))]
    middle = bytearray(five)
    middle[len(five) // 2] ^= 0xFF
    assert ids(bytes(middle) + after)[-1] == "9" and set(ids(bytes(middle))) < {"0", "1", "2", "3", "4"}
