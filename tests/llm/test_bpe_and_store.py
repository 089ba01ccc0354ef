import hashlib
import zlib

import numpy as np
import pytest
from millrace.llm import bpe, tokenstore
from millrace.llm.queries import END_ID, tokenizer_path
from tokenizers import Tokenizer

TEXTS = ["Hello WORLD's it'll  don't 123 4.5", "", None, "<|endoftext|> x<|startoftext|>y", "İstanbul ΣΑΣ ς 　 x y", "naïve é ﬁ \x00\x01 \x1c a", "日本語😀😀 aaaaaaaaaaaaaaaa lololol", "a" * 3000, "　 \xa0", "<|endoftext|", "I'm 'RE we'VE ½ ² १२", "ḍ̇ q̣̇", "﻿abc", "Ａ ａ ǅ", "the the the", "the the the", "x " * 20000]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokenizer_path())
    t.no_padding()
    t.no_truncation()
    return t


def test_encode_and_decode_as_the_library(spark, library):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string")
    got = {r.doc_id: r for r in bpe.encode(docs, tokenizer_path(), decoded="decoded").collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        want = library.encode(t or "", add_special_tokens=False).ids
        assert got[i].ids == want
        assert got[i].decoded == library.decode(want, skip_special_tokens=False)


def test_decode_alone_and_null_ids(spark, library):
    df = spark.createDataFrame([(1, [320, 1125]), (2, None), (3, [])], "doc_id long, ids array<int>")
    got = {r.doc_id: r.decoded for r in bpe.decode(df, tokenizer_path()).collect()}
    assert got == {1: library.decode([320, 1125], skip_special_tokens=False), 2: "", 3: ""}


def test_byte_level_tokenizer_keeps_white_space():
    path = tokenizer_path("byte_bpe_50k.json")
    lib, own = Tokenizer.from_file(path), bpe.Codec(open(path, encoding="utf-8").read())
    for t in TEXTS[:-1]:
        if t and "<|endoftext|" not in t:
            assert own.text(t) == lib.encode(t, add_special_tokens=False).ids
            assert own.decode(np.array(own.text(t))) == lib.decode(own.text(t), skip_special_tokens=False)


def test_runs_of_one_symbol_follow_merge_order():
    model = {"type": "BPE", "vocab": {"a": 0, "aa": 1, "aaa": 2, "b": 3, "ab": 4}, "merges": [["a", "a"], ["aa", "a"], ["a", "b"]]}
    a = bpe.Automaton(model)

    def merged(s):
        parts = list(s)
        for u, v in model["merges"]:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == (u, v):
                    parts[i : i + 2] = [u + v]
                i += 1
        return [model["vocab"][x] for x in parts]

    for s in ("a", "aa", "aaa", "aaaa", "aaaaa", "aaaaaab", "ab", "aab", "aaab", "baab", "bbaaab"):
        assert a.word(s) == merged(s), s


def test_store_reads_back_what_it_wrote(spark, library, tmp_path):
    rows = [(i * 7 - 20, t) for i, t in enumerate(TEXTS)] + [(None, "null id"), (55, "again one"), (55, "again one")]
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, start int")
    folder = f"file://{tmp_path}/store"
    got = sorted(tokenstore.store(docs, tokenizer_path(), END_ID, folder, with_ids=True).collect(), key=lambda r: r.start)
    at = 0
    assert [r.doc_id for r in got] == sorted((i for i, _ in rows), key=lambda i: (i is not None, i))
    texts = {i: t for i, t in rows}
    for r in got:
        want = [*library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, END_ID]
        assert (r.start, r.n_tokens, r.ids) == (at, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, dtype="<u4").tobytes())
        at += len(want)
    names = [r.file for r in tokenstore.read(spark, folder, False).where("doc_id = 55").select("file").collect()]
    assert tokenstore.read_document(folder, names[0], 55)[-1] == END_ID
    with pytest.raises(KeyError):
        tokenstore.read_document(folder, names[0], 10**9)


def test_store_uses_a_dictionary_and_refuses_another(spark, tmp_path, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    folder = f"file://{tmp_path}/d"
    assert tokenstore.store(docs, tokenizer_path(), END_ID, folder).count() == docs.count()
    path = tmp_path / "d" / "dictionary.zdict"
    assert path.stat().st_size > 1000
    file = next((tmp_path / "d").glob("*.tokz"))
    content = file.read_bytes()
    assert hashlib.sha256(path.read_bytes()).digest() in content[:64]
    with pytest.raises(ValueError):
        tokenstore._frames(content, b"another")


def test_copies_of_an_id_that_fill_a_file_stay_in_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenstore, "FILE_BYTES", 1)
    monkeypatch.setattr(tokenstore, "blocks", lambda batches, *_: (b.slice(i, 1) for b in batches for i in range(b.num_rows)))
    docs = spark.createDataFrame([(5, "one"), (5, "one two"), (5, "one two three"), (6, "four"), (4, "zero")], "doc_id long, text string").coalesce(1)
    for k in range(3):
        rows = tokenstore.store(docs, tokenizer_path(), END_ID, f"file://{tmp_path}/s{k}", partitions=2).orderBy("start").collect()
        assert [r.doc_id for r in rows] == [4, 5, 5, 5, 6]
        assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(5)]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, tokenizer_path()).count() == 0
    assert tokenstore.store(docs, tokenizer_path(), END_ID).count() == 0
