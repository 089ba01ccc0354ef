import itertools
import math
import random

import numpy as np
import pytest
from millrace.llm import langid, toxicity
from pyspark.sql import functions as F

EN = "the quick brown fox jumps over the lazy dog and then it runs through the green fields with all of the other animals"
DE = "der schnelle braune fuchs springt über den faulen hund und läuft dann mit allen anderen tieren durch die grünen felder"
FR = "le renard brun et rapide saute par dessus le chien paresseux puis il court dans les champs verts avec tous les autres animaux"


def mixed(words, n, seed):
    r = random.Random(seed)
    w = words.split()
    return " ".join(r.choice(w) for _ in range(n))


def corpus():
    rows = []
    for i in range(60):
        for lang, words in (("en", EN), ("de", DE), ("fr", FR)):
            rows.append((len(rows), mixed(words, 40, f"{i}{lang}"), lang))
    return rows


def test_languages_and_edges(spark):
    rows = corpus()
    edge = [(1000, None, "en"), (1001, "", "en"), (1002, "123 ... 456", "de"), (1003, mixed(EN, 30, 1) + " " + mixed(DE, 30, 2), None), (1004, mixed(FR, 4000, 3), None), (1005, "Ä", None), (1005, "Ä", None), (None, mixed(DE, 20, 9), None)]
    docs = spark.createDataFrame([(*r, "x", 0.0) for r in rows + edge], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.held_out(docs).collect()
    assert len(got) == len(rows) + len(edge)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    truth = {i: lang for i, _, lang in rows}
    assert sum(by[i][0].lang_pred == lang for i, lang in truth.items()) / len(truth) > 0.97
    assert any(r.held_out for r in got) and not all(r.held_out for r in got)
    for i in (1000, 1001, 1002):
        assert (by[i][0].lang_pred, by[i][0].score) == ("und", 0.0)
    assert set(by[1003][0].mixture) == {"en", "de"} and all(0.3 < v < 0.7 for v in by[1003][0].mixture.values())
    assert by[1004][0].lang_pred == "fr" and by[1004][0].score > 0.9
    assert len(by[1005]) == 2 and by[None][0].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in got)


def test_same_result_whatever_the_block(spark):
    model = langid.learn(spark.createDataFrame(corpus(), "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in corpus()[:20]] + [None, "", "Ä b"]
    alone = [model.predict([t]) for t in texts]
    names, score, mix = model.predict(texts)
    assert names == [a[0][0] for a in alone]
    assert all(abs(s - a[1][0]) < 1e-9 for s, a in zip(score, alone, strict=True))
    assert [sorted(m) for m in mix] == [sorted(a[2][0]) for a in alone]


def test_languages_without_training_rows(spark):
    docs = spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in langid.held_out(docs).collect()] == [("und", 0.0)]
    assert langid.held_out(docs.limit(0)).count() == 0


def test_accepted_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(*r, 5) for r in corpus()] + [(999, "!!", "en", 5), (998, None, None, 5)], "doc_id long, text string, lang string, score int")
    out = langid.accepted(docs, langid.learn(docs))
    assert out.columns == docs.columns and out.count() == len(corpus())


BAD = ("vorgulent", "snarfblad", "dwizzelpop", "krumpfoxy")


def labelled(n=400):
    r = random.Random(5)
    w = EN.split()
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(w) + r.choice(["", "ly", "ness", "er"]) for _ in range(r.randint(30, 120))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(BAD))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = labelled()
    edge = [(5000, None), (5001, ""), (5002, "fine words only"), (5003, "word " * 20000), (5004, "x" * 30000), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, 1, "k") for r in rows + edge], "doc_id long, text string, score int, held_out string")
    marks = spark.createDataFrame([*labels, (None, 1), (7, None), (8, 9)], "doc_id long, toxic int")
    got = toxicity.held_out(docs, marks).collect()
    assert len(got) == len(rows) + len(edge)
    truth = dict(labels)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert held and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all(r.predicted == 0 for r in got if r.doc_id and r.doc_id >= 5000)


def test_toxicity_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.held_out(docs, none).collect()] == [(0.0, 0)] * 2
    rows, labels = labelled()
    model = toxicity.train([t for i, t in rows if i % 4 == 0], [t for i, t in rows if i % 4])
    assert toxicity.score(docs.limit(0), model).count() == 0
    kept = toxicity.accepted(spark.createDataFrame(rows, "doc_id long, text string").withColumn("z", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "z"] and 290 <= kept.count() <= 310


MARKS = {"short": ["zug", "qox", "vib"], "two letters": ["zq", "xo"], "phrase": ["dog runs over all other animals", "fields jumps it lazy then"]}


def marked(kind, seed, n=400):
    r = random.Random(seed)
    w = EN.split()
    toxic, ordinary = [], []
    for i in range(n):
        words = [r.choice(w) + r.choice(["", "ly", "ness", "er"]) for _ in range(r.randint(30, 120))]
        if i % 4 == 0:
            for _ in range(4):
                words.insert(r.randrange(len(words)), r.choice(MARKS[kind]))
        (ordinary if i % 4 else toxic).append(" ".join(words))
    return toxic, ordinary


@pytest.mark.parametrize("kind", list(MARKS))
def test_toxic_text_without_telling_words(kind):
    model = toxicity.train(*marked(kind, 7))
    toxic, ordinary = ([model.score(t) >= 0.5 for t in x] for x in marked(kind, 99))
    assert sum(toxic) / len(toxic) > 0.6 and sum(ordinary) / len(ordinary) < 0.1
    assert all(model.score(t) < 0.5 for t in ("fine words only", "word " * 20000, "x" * 30000))


def test_toxicity_learns_from_few_labels():
    toxic, ordinary = marked("phrase", 7, 60)
    model = toxicity.train(toxic, ordinary)
    assert model is not None and any(phrase[6:20].encode() in model.toxic for phrase in MARKS["phrase"])


def test_ordinary_dictionary_is_trained_on_all_documents(monkeypatch):
    seen = []
    whole = toxicity._dictionary
    monkeypatch.setattr(toxicity, "_dictionary", lambda samples, *rest: seen.append(len(samples)) or whole(samples[-2000:], *rest))
    r = random.Random(3)
    ordinary = ["".join(r.choice("abcdefgh ") for _ in range(20_000)) for _ in range(600)]
    toxicity.train([mixed(EN, 40, i) for i in range(40)], ordinary)
    assert max(seen) > 80_000


def plain_mixture(model, text):
    """The languages' proportions by trying every set of languages, in plain Python."""
    low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
    bucket = [k % langid.BUCKETS for key, n, _ in langid.trigrams([low]) for k, m in zip(key.tolist(), n.tolist(), strict=True) for _ in range(m)]
    if not low.strip() or not bucket:
        return None
    like = [[math.exp(x) for x in model.log[b]] for b in bucket]
    best = None
    for size in range(1, len(model.langs) + 1):
        for langs in itertools.combinations(range(len(model.langs)), size):
            pi = {k: 1 / size for k in langs}
            for _ in range(400 if size > 1 else 1):
                new = dict.fromkeys(langs, 0.0)
                for row in like:
                    total = sum(pi[k] * row[k] for k in langs)
                    for k in langs:
                        new[k] += pi[k] * row[k] / total / len(like)
                moved = max(abs(new[k] - pi[k]) for k in langs)
                pi = new
                if moved < 1e-4:
                    break
            value = 2 * sum(math.log(sum(pi[k] * row[k] for k in langs)) for row in like) / langid.OVERLAP - math.log(max(2, len(bucket) / langid.OVERLAP)) * (size - 1)
            if best is None or value > best[0]:
                best = value, pi
    return max(best[1], key=best[1].get), len(best[1])


def test_mixtures_are_those_of_every_set_of_languages(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    model = langid.learn(docs)
    texts = [r.text for r in docs.where("length(text) between 1 and 900").select("text").limit(25).collect()]
    texts += [f"{a[:300]} {b[:300]}" for a, b in zip(texts[:8], texts[8:16], strict=True)] + ["12 34", "", None]
    same = sizes = 0
    for t in texts:
        name, _, mix = model.predict([t])
        want = plain_mixture(model, t)
        if want is None:
            assert name == [langid.UND]
            continue
        same += name[0] == model.langs[want[0]]
        sizes += len(mix[0]) == want[1]
    assert same >= len(texts) - 4 and sizes >= 0.9 * (len(texts) - 3)


def test_many_languages_and_long_texts(spark):
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}" * 30, f"l{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert len(model.langs) == 300 and model.log.size <= langid.CELLS
    long_ = "the cat and the dog " * 200_000
    keys = np.concatenate([k for k, _, _ in langid.trigrams([long_])])
    often = sum(int(n.sum()) for _, n, _ in langid.trigrams([long_]))
    assert len(keys) < 1000 and abs(often - len(long_)) < 100


def test_long_labelled_texts_teach_and_copies_of_an_id_count_once(spark):
    filler = "plain words about the weather and the garden " * 700  # 31,500 characters
    docs = [(i, filler + "vile grumbling slander " * 30 + filler if i % 2 else filler * 2) for i in range(40)] + [(1, "vile grumbling slander " * 50)] * 50
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.learn(table, labels)
    assert model is not None
    short = spark.createDataFrame([(1, "a vile thing"), (2, "fine")], "doc_id long, text string")
    assert toxicity.learn(short, labels.where("doc_id in (1, 2)")) is not None


def test_labels_of_the_tables_are_found(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.held_out(docs, labels).where("held_out").join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").collect()
    clean, bad = [r for r in rows if r.toxic == 0], [r for r in rows if r.toxic == 1]
    assert len(bad) >= 3 and sum(r.predicted for r in bad) >= 0.5 * len(bad) and sum(r.predicted for r in clean) <= 0.05 * len(clean)
