"""Structure, lineage, shards and what needs odd rows; the catalogue's tests compare whole queries with SQL."""

import glob
import hashlib
import json
import os

import pytest
from millrace.operators import lineage
from millrace.sources import token_shards
from pyspark.sql import functions as F


def test_shards_round_trip_and_faults(spark, tmp_path):
    folder = f"file://{tmp_path}/s"
    rows = spark.createDataFrame([(0, [1, 2, 3]), (3, []), (3, [2**32 - 1, 7]), (5, list(range(200_000)))], "start long, ids array<long>")
    token_shards.write(rows, folder, 150_000)
    got = sorted(map(tuple, token_shards.read(spark, folder).collect()))
    assert [x[0] for x in got] == [0, 0, 0, 1] and max(len(x[2]) for x in got) == token_shards.SLICE
    assert [i for _, _, ids in got for i in ids] == [1, 2, 3, 2**32 - 1, 7, *range(200_000)]
    manifest = json.load(open(tmp_path / "s/manifest.json"))
    assert [x["tokens"] for x in manifest["shards"]] == [150_000, 50_005]
    for x in manifest["shards"]:
        assert hashlib.sha256(open(tmp_path / "s" / x["file"], "rb").read()).hexdigest() == x["sha256"]
    token_shards.write(rows.limit(0), f"file://{tmp_path}/none", 10)
    assert token_shards.read(spark, f"file://{tmp_path}/none").count() == 0
    os.mkdir(tmp_path / "odd")
    (tmp_path / "odd/x.bin").write_bytes(b"12345")
    with pytest.raises(Exception, match="x.bin is no multiple of 4"):
        token_shards.read(spark, f"file://{tmp_path}/odd").collect()


def test_failed_writes_leave_no_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(0, [1, 2, 3]), (3, [-1])], "start long, ids array<long>")
    with pytest.raises(Exception, match="no unsigned 32-bit"):
        token_shards.write(rows, f"file://{tmp_path}/bad", 3)
    assert not glob.glob(f"{tmp_path}/bad/manifest.json")


def test_structure_of_python_and_tokens(spark):
    a, b = "def f(x):\n    return x + 1  # note\n", "def f(x):\n\n    return (x + 1)\n"
    rows = [(1, a, "Python"), (2, b, "python"), (3, "def f(:", "python"), (4, "int a = 1; /* c */ int b = 2; int c;", "c"), (5, "int a = 1; int b = 2;\nint c; // end\nmore", "C"), (6, "too few", "go"), (7, a, None), (8, None, "java"), (9, "a b c d e f g h // x\n y", "go"), (10, "a b c d e f g h", "go"), (11, "a b c d e f g h", "rust")]
    df = spark.createDataFrame(rows, "id long, text string, language string")
    got = {r.id: r.h for r in df.select("id", lineage.structure_hash(F.col("text"), F.col("language")).alias("h")).collect()}
    assert got[1] == got[2] is not None and got[3] is None and got[6] is got[7] is got[8] is None
    assert got[4] == got[5] == hashlib.sha256(b"c-tokens:int a 1 int b 2 int c").hexdigest()
    assert got[9] == got[10] != got[11]


@pytest.mark.parametrize("value", ["plain", 'q"\\', "tab\tnl\n\r\b\f\x01", "é😀\x7f ", " "])
def test_lineage_is_canonical_json(spark, value):
    df = spark.createDataFrame([(value, "r1", None)], "a string, b string, c string")
    got = df.select(lineage.lineage_hash(task_signature=F.col("a"), source_revision=F.col("b"), patch_lineage=F.col("c")).alias("h"), lineage.lineage_hash(source_revision=F.col("b"), generated_from=F.lit("")).alias("none")).first()
    want = json.dumps({"task_signature": value, "source_revision": "r1"}, sort_keys=True, separators=(",", ":"))
    assert got.h == hashlib.sha256(want.encode()).hexdigest() and got.none is None


def test_rejected_rows_take_their_keys_back(spark):
    # 2 is an exact copy of 1; 3 has only 2's structure, 4 only 2's lineage, 5 is near 2 alone: none of them met an accepted row
    far = [0, 1 << 20, 0b111 << 30, 0b1111 << 40 | 0b11111, (1 << 20) | 0b11 << 5]
    rows = [(1, "c1", None, None, far[0]), (2, "c1", "s2", "l2", far[1] | 0b1111111), (3, "c3", "s2", None, far[2] | 0b11111 << 10), (4, "c4", None, "l2", far[3]), (5, "c5", None, None, far[1] | 0b1111111), (6, "c6", "s2", "l2", 0b1), (7, "c7", "s7", "l2", 0b1), (8, "c8", None, None, 0b111), (9, "c9", None, None, 0b11111 << 50)]
    df = spark.createDataFrame([(*r, "a" if r[0] < 5 else "b") for r in rows], "doc_id long, content_hash string, structure_hash string, lineage_hash string, simhash long, source string")
    got = lineage.deduplicated(df)
    assert {r.doc_id: r.outcome for r in got.collect()} == {1: "accepted", 2: "exact_duplicates", 3: "accepted", 4: "accepted", 5: "accepted", 6: "structural_duplicates", 7: "lineage_duplicates", 8: "near_duplicates", 9: "accepted"}
    total = {r.source: r for r in lineage.report(got).collect()}
    assert total["a"].accepted == 3 and total["b"].near_duplicates == 1 and total["b"].accepted == 2


@pytest.mark.parametrize("block", [2, 4096])
def test_comparisons_are_counted_as_pairs_would_be(spark, block):
    import random

    r = random.Random(3)
    values = [sum(r.choice([0, 1, 5]) << (15 * b) for b in range(4)) for _ in range(60)]
    rows = [(i, v, "accepted" if i % 3 else "near_duplicates" if i % 2 else "exact_duplicates") for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "doc_id long, simhash long, outcome string")
    got = {r.doc_id: r.comparisons for r in lineage.candidates(df, block=block).collect()}
    shares = lambda a, b: any((a >> s) & 32767 == (b >> s) & 32767 for s in (0, 15, 30, 45))
    assert got == {i: sum(shares(v, w) for j, w, o in rows if j < i and o == "accepted") for i, v, o in rows if o != "exact_duplicates"}
