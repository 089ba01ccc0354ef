import corpus_pipeline as P
import test_decontaminate
import test_jaccard
from millrace.llm import langid, toxicity
from millrace.llm.queries import oracle_sql, queries, tokenizer_path
from tokenizers import Tokenizer


def test_stages_names_and_registration():
    import __spark_entry__ as entry

    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "near duplicates", "benchmark", "tokens"]
    assert "pipeline" in entry.queries() and "pipeline" not in entry.oracle_sql()
    assert [f"op{n}_" for n in range(1, 14)] == [k.rpartition("op")[0] + k.split("_")[0] + "_" for k in sorted(queries(), key=lambda k: int(k[2:].split("_")[0]))]
    assert set(oracle_sql()) <= set(queries())


def test_pipeline_equals_a_plain_version(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    labels, benchmark = (spark.read.parquet(f"{small_tables}/{t}.parquet") for t in ("labels", "benchmark"))
    odd = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34 56", None, None, 8)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).union(docs.where("doc_id < 5"))  # repeated rows
    frame = lambda rows: spark.createDataFrame(rows, docs.schema)

    model, rows = langid.learn(docs), docs.collect()
    told = [model.predict([r.text]) for r in rows]
    rows = [r for r, (names, score, _) in zip(rows, told, strict=True) if names[0] != langid.UND and score[0] >= 0.5]
    tox = toxicity.learn(frame(rows), labels)
    rows = [r for r in rows if tox is None or tox.score(r.text) < 0.5]
    first = {i for i, _, c in test_jaccard.plain([(r.doc_id, r.text) for r in rows], 5, 80) if i == c}
    rows = list({r.doc_id: r for r in rows if r.doc_id in first}.values())
    items = [(r.item_id, r.text) for r in benchmark.collect()]
    clean = {d[0] for d in test_decontaminate.plain([(r.doc_id, r.text) for r in rows], items) if not d[-1]}
    library = Tokenizer.from_file(tokenizer_path())
    want = {r.doc_id: library.encode(r.text, add_special_tokens=False).ids for r in rows if r.doc_id in clean}

    out = docs
    for _, stage in P.STAGES:
        out = P.staged(stage(spark, out, small_tables))
    assert set(out.columns) == {"doc_id", "lang", "source", "n_chars", "ids", "n_tokens"}
    assert {r.doc_id: r.ids for r in out.collect()} == want and 0 < len(want) < docs.count()


def test_stages_over_an_empty_table_and_clashing_columns(spark, small_tables):
    docs = spark.read.parquet(f"{small_tables}/documents.parquet")
    empty = docs.limit(0)
    odd = docs.where("doc_id < 60").withColumnRenamed("n_chars", "score").withColumn("component_id", docs.doc_id).withColumn("contaminated", docs.lang)
    for _, stage in P.STAGES[:-1]:
        assert stage(spark, empty, small_tables).count() == 0
        out = stage(spark, odd, small_tables)
        assert out.columns == odd.columns and out.count() > 0
    assert P.tokens(spark, empty, small_tables).count() == 0
    assert set(P.tokens(spark, odd, small_tables).columns) == {*odd.columns, "ids", "n_tokens"} - {"text"}
