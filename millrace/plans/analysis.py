"""Queries of the retrieval, evaluation and event operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators.dedup import checkpoint_dir
from ..sources.tables import table
from ..streaming import events as S
from ..streaming import runs


def _queries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").where("vec_id % 50 = 0")


def vector_topk(spark: SparkSession, folder: str) -> DataFrame:
    return R.vector_top_k(_queries(spark, folder), table(spark, folder, "embeddings"), 10).select("query_id", "vec_id", F.col("rank").cast("int").alias("rank"), "score")


def bag_cosine(spark: SparkSession, folder: str) -> DataFrame:
    return R.bag_cosine(table(spark, folder, "benchmark"), table(spark, folder, "documents"), "item_id", "doc_id", least=0.4)


def hashed_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return R.hashed_vector(table(spark, folder, "benchmark"), "item_id", "text").select("item_id", "dim", F.round("weight", 4).alias("weight"))


def rrf_fuse(spark: SparkSession, folder: str) -> DataFrame:
    """The ranking by the vectors fused with that by their signs alone."""
    signs = lambda df: df.withColumn("embedding", F.transform("embedding", lambda x: F.signum(x.cast("double"))))
    top = vector_topk(spark, folder).withColumnRenamed("vec_id", "id")
    other = R.vector_top_k(signs(_queries(spark, folder)), signs(table(spark, folder, "embeddings")), 10).withColumnRenamed("vec_id", "id")
    return R.fuse([top, other], "query_id", "id").where("rank <= 15").select("query_id", "id", F.round("score", 6).alias("score"))


def ir_metrics(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    ranked = R.vector_top_k(_queries(spark, folder), e, 20)
    q = _queries(spark, folder).select(F.col("vec_id").alias("query_id"), "label")
    return R.label_metrics(ranked, q, e.select("vec_id", "label"))


def memory_rank(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("event_id").alias("id"), (F.col("value") / 100 - 0.2).alias("similarity"), F.pmod("event_id", F.lit(10)).cast("double").alias("s"), F.pmod("event_id", F.lit(37)).alias("usage_count"), (F.col("event_id") * 600.0).alias("created_at"))
    return R.memory_rank(rows.withColumn("success_rate", F.col("s") / 10), 10_000_000.0).select("id", "score")


def mmr_rerank(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    top = R.vector_top_k(_queries(spark, folder), e, 50).select("query_id", F.col("vec_id").alias("id"), "score")
    return R.diversified(top.join(e.select(F.col("vec_id").alias("id"), "embedding"), "id"), 10)


def budget_pack(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "embeddings")
    top = R.vector_top_k(_queries(spark, folder), e, 50).select("query_id", F.col("vec_id").alias("id"), "rank", (F.col("vec_id") % 97 + 3).alias("tokens"))
    return R.packed(top, 200, 10).select("query_id", "id")


def index_diff(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.sha2("text", 256).alias("h"))
    old = docs.where("doc_id % 7 <> 0").select((F.col("doc_id")).alias("doc_id"), F.when(F.col("doc_id") % 5 == 0, F.lit("old")).otherwise(F.col("h")).alias("h")).union(spark.createDataFrame([(-5, "gone")], "doc_id long, h string"))
    return R.table_diff(docs, old, "doc_id", "h")


def line_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return R.line_chunks(table(spark, folder, "documents"), 4)


def call_graph(spark: SparkSession, folder: str) -> DataFrame:
    symbols = table(spark, folder, "nation").select(F.concat_ws(".", F.col("n_regionkey").cast("string"), F.lower("n_name")).alias("name"), F.col("n_nationkey").cast("string").alias("id"))
    calls = table(spark, folder, "nation").select(F.col("n_nationkey").alias("src"), F.when(F.col("n_nationkey") % 2 == 0, F.lower("n_name")).when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("9."), F.lower("n_name"))).otherwise(F.lit("nothing")).alias("call"))
    return R.resolved_calls(calls, symbols)


def repetition_ratio(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", F.round(E.repetition(F.col("text")), 8).alias("repetition"))


def generation_score(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "conversations").select("conv_id", "turn", E.generation_score(F.col("text"), F.array(F.lit("the"), F.lit("of")), F.array(F.lit("idiot"), F.lit("trash")), F.contains("text", F.lit("\n"))).alias("score"))


def hallucination_flags(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "nation").select("n_nationkey", F.concat(F.lit("fixes CVE-2024-"), F.lpad(F.col("n_nationkey").cast("string"), 4, "1"), F.lit(" and cve-2023-9999")).alias("o"), F.lit("about CVE-2023-9999 only").alias("p"))
    return rows.select("n_nationkey", F.array_join(E.invented(F.col("o"), F.col("p")), ",").alias("invented"))


def pass_at_k(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", F.lit(50).alias("n"), F.col("l_quantity").cast("int").alias("c"))
    return rows.select("l_orderkey", "l_linenumber", F.round(E.pass_at_k(F.col("n"), F.col("c"), F.lit(5)), 6).alias("pass_5"))


def eval_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return E.rate_summary(table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id"), "lang", "quality")


def regression_flags(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "labels").join(table(spark, folder, "documents"), "doc_id")
    a = by.where("doc_id % 2 = 0").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("s"))
    b = by.where("doc_id % 2 = 1").groupBy("source").agg(F.round(F.avg("quality"), 6).alias("s"))
    return E.regression_flags(a, b, "source", "s")


def reviewer_kappa(spark: SparkSession, folder: str) -> DataFrame:
    return E.kappa(table(spark, folder, "labels"), "quality", "toxic")


def bootstrap_ci(spark: SparkSession, folder: str) -> DataFrame:
    return E.bootstrap(table(spark, folder, "labels"), "quality", "doc_id")


def load_percentiles(spark: SparkSession, folder: str) -> DataFrame:
    return E.load_percentiles(table(spark, folder, "events"), "event_type", "value")


def scaling_fit(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of documents as runs: the size by the group, the tokens by the group's characters, the loss by a law that the fit finds again."""
    docs = table(spark, folder, "documents")
    by = docs.groupBy((F.col("doc_id") % 24).alias("id")).agg(F.sum("n_chars").cast("double").alias("chars"))
    measured = by.select(F.pow(F.lit(2.0), F.col("id") % 6 + 20).alias("parameters"), (F.col("chars") * F.pow(F.lit(4.0), F.floor(F.col("id") / 6) + 4)).alias("tokens"))
    measured = measured.withColumn("loss", 1.7 + 400 * F.pow("parameters", F.lit(-0.335)) + 410 * F.pow("tokens", F.lit(-0.287)))
    return E.scaling_fit(measured).select(F.round("alpha", 4).alias("alpha"), F.round("beta", 4).alias("beta"), F.round("e", 2).alias("e"))


def tumbling_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.windowed(table(spark, folder, "events"), "1 day", keys=("event_type",)).select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n", F.round("total", 2).alias("total"))


def sliding_counts(spark: SparkSession, folder: str) -> DataFrame:
    return S.windowed(table(spark, folder, "events"), "2 hours", "1 hour").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def session_windows(spark: SparkSession, folder: str) -> DataFrame:
    return S.sessions(table(spark, folder, "events"), "3 hours").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def stream_dedup(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return S.distinct_events(e.unionByName(e.where("event_id % 3 = 0")), ["event_id"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def event_sequence(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return S.sequenced(e.unionByName(e.where("event_id % 4 = 0")), ["event_id"], "user_id", ["ts", "event_id"]).select("event_id", F.col("sequence").cast("long").alias("sequence"))


def state_machine(spark: SparkSession, folder: str) -> DataFrame:
    return S.bad_transitions(table(spark, folder, "events"), "user_id", "event_type", ["ts", "event_id"], {"view": ["click", "view"], "click": ["purchase", "view"]}).select("event_id", "before", "event_type")


def stream_static_join(spark: SparkSession, folder: str) -> DataFrame:
    users = table(spark, folder, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    return table(spark, folder, "events").join(users, "user_id").groupBy("c_mktsegment", "event_type").agg(F.count(F.lit(1)).alias("n"))


def token_bucket(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "events").select(F.col("user_id").alias("subject"), F.col("event_id").alias("id"), F.unix_timestamp(F.col("ts").cast("timestamp")).cast("double").alias("ts"), F.lit(1.0).alias("cost"))
    return S.token_bucket(rows, 2.0, 1 / 7200).groupBy("allowed").agg(F.count(F.lit(1)).alias("n"))


def streamed_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The daily counts again, by a stream over the events files into a ledger, of which the last batch holds the whole."""
    source = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    there = f"{checkpoint_dir(spark)}/daily-{uuid.uuid4().hex}"
    runs.ledger(S.windowed(source, "1 day", late="1 hour"), f"{there}/ledger", f"{there}/checkpoint", output="complete")
    rows = runs.ledger_rows(spark, f"{there}/ledger")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


def followed_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Users as runs, events as their numbered events: what a stream with state and timers tells of them."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    source = spark.readStream.schema(table(spark, folder, "events").schema).option("pathGlobFilter", "events.parquet").parquet(folder)
    events = source.select(F.col("user_id").alias("run"), F.col("event_id").alias("source_sequence"), F.col("ts").cast("timestamp").alias("ts"))
    there = f"{checkpoint_dir(spark)}/runs-{uuid.uuid4().hex}"
    spark.conf.set(key, runs.ROCKS)
    try:
        runs.ledger(runs.followed(events, silent_seconds=86_400), f"{there}/ledger", f"{there}/checkpoint", output="update")
    finally:
        spark.conf.set(key, before)
    return runs.ledger_rows(spark, f"{there}/ledger").groupBy("run", "what").agg(F.count(F.lit(1)).alias("n"), F.sum("missing").alias("missing"))


def event_faults(spark: SparkSession, folder: str) -> DataFrame:
    """Events with a fault told by their number put in, and their payload without secrets."""
    e = table(spark, folder, "events")
    n = F.col("event_id")
    bad = e.select("event_id", F.when(n % 11 == 0, -1).otherwise(n).alias("source_sequence"), F.when(n % 5 == 0, F.col("event_type")).otherwise("metric").alias("kind"), F.when(n % 13 == 0, "").otherwise("train").alias("stage"), F.when(n % 17 == 0, float("nan")).when(n % 19 == 0, float("-inf")).otherwise(F.col("value")).alias("loss"), F.repeat(F.lit("x"), F.when(n % 23 == 0, 60_001).otherwise(3)).alias("message"), F.create_map(F.lit("api_key"), F.col("event_type"), F.lit("note"), F.concat(F.lit("token=abcdefghijkl"), n.cast("string"))).alias("payload"))
    return bad.select("event_id", F.array_join(runs.faults(bad), ",").alias("faults"), F.element_at(runs.redacted_payload(F.col("payload")), "api_key").alias("api_key"))


def failure_clusters(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select("event_id", F.concat(F.lit("error in /srv/app"), F.col("user_id").cast("string"), F.lit("/x.py line "), F.col("event_id").cast("string"), F.lit(": "), "event_type").alias("error"), F.col("value").alias("last_seen_at"), (F.col("event_id") % 10 == 0).alias("verified"))
    return S.failures(e, T.failure_signature(F.col("error"))).select("n", "verified", "candidate")


_COS = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::double * z[2]::double))"
_DOT = f"round({_COS.format(a='q.embedding', b='d.embedding')}, 6)"
_TOP = f"top as (select query_id, vec_id, score, rank from (select q.vec_id query_id, d.vec_id, {_DOT} score, row_number() over (partition by q.vec_id order by {_DOT} desc, d.vec_id) rank from embeddings q join embeddings d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id) where score > 0 and rank <= {{k}})"
_DAY = "strftime(time_bucket(interval '1 day', ts), '%Y-%m-%d %H:%M:%S')"
_BAG = "{n} as (select {id}, term, count(*) tf from (select {id}, unnest(regexp_extract_all(lower(text), '[A-Za-z_][A-Za-z0-9_]+')) term from {t}) group by 1, 2)"

QUERIES = {
    "vector_topk": (vector_topk, f"with {_TOP.format(k=10)} select query_id, vec_id, rank, score from top"),
    "bag_cosine": (bag_cosine, f"with {_BAG.format(n='q', id='item_id', t='benchmark')}, {_BAG.format(n='d', id='doc_id', t='documents')}, s as (select item_id, sqrt(sum(tf * tf)) s from q group by 1), r as (select doc_id, sqrt(sum(tf * tf)) r from d group by 1), x as (select item_id, doc_id, sum(q.tf * d.tf) c from q join d using (term) group by 1, 2) select item_id, doc_id, round(c / (s * r), 6) cosine from x join s using (item_id) join r using (doc_id) where round(c / (s * r), 6) >= 0.4"),
    "hashed_embedding": (hashed_embedding, f"with {_BAG.format(n='q', id='item_id', t='benchmark')}, w as (select item_id, cast(cast('0x' || substring(sha256(term), 1, 8) as bigint) % 64 as int) dim, sum(case when cast('0x' || substring(sha256(term), 9, 2) as int) % 2 = 0 then 1 else -1 end * (1 + ln(tf))) w from q group by 1, 2), s as (select *, sqrt(sum(w * w) over (partition by item_id)) z from w) select item_id, dim, round(round(w / z, 6), 4) weight from s where z > 0"),
    "rrf_fuse": (
        rrf_fuse,
        f"""with {_TOP.format(k=10)}, signed as (select vec_id, list_transform(embedding, lambda x: sign(x)::double) e from embeddings),
        agree as (select q.vec_id query_id, d.vec_id id, round(list_dot_product(q.e, d.e), 6) score from signed q join signed d on q.vec_id % 50 = 0 and d.vec_id <> q.vec_id),
        second as (select * from (select *, row_number() over (partition by query_id order by score desc, id) rank from agree where score > 0) where rank <= 10),
        l as (select query_id, vec_id id, rank from top union all select query_id, id, rank from second), f as (select query_id, id, round(sum(1.0::double / (60 + rank)), 8) score from l group by 1, 2)
        select query_id, id, round(score, 6) score from (select *, row_number() over (partition by query_id order by score desc, id) r from f) where r <= 15""",
    ),
    "ir_metrics": (ir_metrics, f"with {_TOP.format(k=20)}, rel as (select q.vec_id query_id, d.vec_id from embeddings q join embeddings d on q.label = d.label and q.vec_id % 50 = 0 and d.vec_id <> q.vec_id), n as (select query_id, count(*) n from rel group by 1), h as (select t.*, case when r.vec_id is null then 0 else 1 end hit from top t left join rel r on r.query_id = t.query_id and r.vec_id = t.vec_id), a as (select query_id, sum(hit) h20, sum(case when hit = 1 and rank <= 10 then 1 / log2(rank + 1) else 0 end) dcg, min(case when hit = 1 and rank <= 10 then rank end) first, count(*) c from h group by 1), i as (select query_id, (select sum(1 / log2(k + 1)) from range(1, cast(least(10, n) as bigint) + 1) g(k)) idcg from n) select query_id, round(coalesce(h20, 0) / n, 6) recall_20, round(coalesce(dcg, 0) / idcg, 6) ndcg_10, round(coalesce(1.0::double / first, 0), 6) mrr_10, round(coalesce(h20 / c, 0), 6) precision_20 from n join i using (query_id) left join a using (query_id)"),
    "memory_rank": (memory_rank, "select event_id id, round(0.4 * greatest(0, value / 100 - 0.2) + 0.3 * (event_id % 10) / 10 + 0.2 * power(0.5, greatest(0, 10000000 - event_id * 600) / 86400 / 30) + 0.1 * least(1, (event_id % 37) / 20), 6) score from events"),
    "mmr_rerank": (mmr_rerank, None),
    "budget_pack": (
        budget_pack,
        f"""with recursive {_TOP.format(k=50)}, t as (select query_id, vec_id, rank, vec_id % 97 + 3 n from top),
        r(query_id, rank, id, used, kept, taken) as (
          select query_id, rank, vec_id, n, 1, true from t where rank = 1
          union all
          select query_id, rank, vec_id, case when fits then used + n else used end, case when fits then kept + 1 else kept end, fits
          from (select t.*, used, kept, kept < 10 and used + n <= 200 fits from r join t on t.query_id = r.query_id and t.rank = r.rank + 1))
        select query_id, id from r where taken""",
    ),
    "index_diff": (index_diff, "select doc_id, case when doc_id % 7 = 0 or doc_id % 5 = 0 then 'upsert' else 'reuse' end change from documents union all select -5, 'stale'"),
    "line_chunks": (line_chunks, "with l as (select doc_id, string_split(text, chr(10)) l from documents), c as (select doc_id, l, unnest(range(0, (len(l) - 1) // 4 + 1)) chunk from l) select doc_id, chunk, chunk * 4 + 1 start_line, least(chunk * 4 + 4, len(l)) end_line, sha256(array_to_string(l[chunk * 4 + 1 : chunk * 4 + 4], chr(10))) chunk_hash from c"),
    "call_graph_resolve": (call_graph, "with c as (select n_nationkey src, case when n_nationkey % 2 = 0 then lower(n_name) when n_nationkey % 3 = 0 then '9.' || lower(n_name) else 'nothing' end call from nation) select src, call, case when call <> 'nothing' then cast(n_nationkey as varchar) end dst, case when call = 'nothing' then 'unresolved' else 'resolved' end status from c left join nation on lower(n_name) = replace(call, '9.', '')"),
    "repetition_ratio": (repetition_ratio, r"with w as (select conv_id, turn, list_filter(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' '), lambda x: x <> '') w from conversations) select conv_id, turn, round(case when len(w) = 0 then 1.0 else 1 - len(list_distinct(w)) / len(w) end, 8) repetition from w"),
    "generation_score": (generation_score, r"with w as (select *, list_filter(string_split(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), ' '), lambda x: x <> '') w, lower(text) l from conversations) select conv_id, turn, round(cast(greatest(0.0, least(1.0, case when trim(text) <> '' then 0.2 else 0.0 end + 0.55 * (case when contains(l, 'the') then 1 else 0 end + case when contains(l, 'of') then 1 else 0 end) / 2.0 + case when contains(text, chr(10)) then 0.15 else 0.0 end + 0.1 - case when len(w) = 0 or 1 - len(list_distinct(w)) / len(w) > 0.65 then 0.15 else 0.0 end - least(0.45, 0.15 * (case when contains(l, 'idiot') then 1 else 0 end + case when contains(l, 'trash') then 1 else 0 end)))) as double), 6) score from w"),
    "hallucination_flags": (hallucination_flags, "select n_nationkey, 'CVE-2024-' || lpad(cast(n_nationkey as varchar), 4, '1') invented from nation"),
    "pass_at_k": (pass_at_k, "with p as (select l_orderkey, l_linenumber, cast(l_quantity as int) c from lineitem) select l_orderkey, l_linenumber, round(round(case when c = 0 then 0.0 when 50 - c < 5 then 1.0 else 1 - (select product(1 - 5.0::double / i) from range(50 - c + 1, 51) r(i)) end, 8), 6) pass_5 from p"),
    "eval_rollup": (eval_rollup, "select lang, count(*) n, round(avg(quality), 6) mean from labels join documents using (doc_id) group by rollup (lang)"),
    "regression_flags": (regression_flags, "with x as (select source, doc_id % 2 m, round(avg(quality), 6) s from labels join documents using (doc_id) group by 1, 2), y as (select source, coalesce(max(s) filter (where m = 0), 0) previous, coalesce(max(s) filter (where m = 1), 0) current from x group by 1) select *, round(previous - current, 6) as drop, case when round(previous - current, 6) > 0.05 then 'fail' when round(previous - current, 6) > 0.03 then 'warn' else 'pass' end flag from y"),
    "reviewer_kappa": (reviewer_kappa, "with n as (select count(*) n, count(*) filter (where quality = toxic) s from labels), e as (select sum(a.c * b.c) e from (select quality k, count(*) c from labels group by 1) a join (select toxic k, count(*) c from labels group by 1) b using (k)) select n, round(s / n, 6) agreement, round((s / n - e / (n * n)) / (1 - e / (n * n)), 6) kappa from n, e"),
    "bootstrap_ci": (bootstrap_ci, "with v as (select quality v, row_number() over (order by doc_id) - 1 i from labels), n as (select count(*) n from v), d as (select rep, cast('0x' || substring(sha256(concat_ws(':', 'boot', rep, place)), 1, 12) as bigint) % n i from n, range(0, 2000) r(rep), range(0, (select n from n)) p(place)), m as (select rep, avg(v) m from d join v using (i) group by rep), s as (select list_sort(list(m)) s from m) select (select round(avg(v), 6) from v) mean, round(s[50], 6) low, round(s[1950], 6) high from s"),
    "load_percentiles": (load_percentiles, "with s as (select event_type, list_sort(list(value)) s, count(*) n, round(median(value), 6) p50 from events group by 1) select event_type, n, p50, round(s[greatest(1, cast(ceil(n * 0.95) as int))], 6) p95, round(s[greatest(1, cast(ceil(n * 0.99) as int))], 6) p99 from s"),
    "scaling_fit_grid": (scaling_fit, None),
    "tumbling_counts": (tumbling_counts, f"select {_DAY} start, event_type, count(*) n, round(sum(value), 2) total from events group by 1, 2"),
    "sliding_counts": (sliding_counts, "select strftime(w, '%Y-%m-%d %H:%M:%S') start, count(*) n from (select unnest([date_trunc('hour', ts), date_trunc('hour', ts) - interval 1 hour]) w from events) group by 1"),
    "session_windows": (session_windows, "with g as (select *, case when ts - lag(ts) over w < interval 3 hours then 0 else 1 end b from events window w as (partition by user_id order by ts)), s as (select *, sum(b) over (partition by user_id order by ts) s from g) select user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') start, count(*) n from s group by user_id, s"),
    "stream_dedup": (stream_dedup, "select event_type, count(*) n from events group by 1"),
    "event_sequence": (event_sequence, "select event_id, row_number() over (partition by user_id order by ts, event_id) as sequence from events"),
    "state_machine_check": (state_machine, "select event_id, before, event_type from (select event_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) before from events) where before is not null and not ((before = 'view' and event_type in ('click', 'view')) or (before = 'click' and event_type in ('purchase', 'view')))"),
    "stream_static_join": (stream_static_join, "select c_mktsegment, event_type, count(*) n from events join customer on c_custkey = user_id group by 1, 2"),
    "token_bucket": (
        token_bucket,
        """with recursive e as (select user_id, floor(epoch(ts)) t, row_number() over (partition by user_id order by floor(epoch(ts)), event_id) k from events),
        b(user_id, k, t, have, allowed) as (
          select user_id, k, t, 1.0::double, true from e where k = 1
          union all
          select user_id, k, t, case when have >= 1 - 1e-9 then have - 1 else have end, have >= 1 - 1e-9
          from (select e.user_id, e.k, e.t, least(2.0::double, b.have + greatest(0.0::double, e.t - b.t) * (1.0::double / 7200)) have from b join e on e.user_id = b.user_id and e.k = b.k + 1))
        select allowed, count(*) n from b group by 1""",
    ),
    "streamed_counts": (streamed_counts, f"select {_DAY} start, count(*) n from events group by 1"),
    "followed_runs": (
        followed_runs,
        """with e as (select user_id, event_id, ts, event_id - coalesce(lag(event_id) over (partition by user_id order by event_id), -1) - 1 missing from events)
        select user_id::varchar run, 'event' what, count(*) n, 0 missing from e group by 1 union all select user_id::varchar, 'gap', count(*), sum(missing)::bigint from e where missing > 0 group by 1
        union all select user_id::varchar, 'silent', 1, 0 from e group by user_id having max(ts) + interval 1 day <= (select max(ts) from e)""",
    ),
    "event_faults": (
        event_faults,
        """select event_id, array_to_string(list_filter([case when event_id % 11 = 0 then 'sequence_not_positive' end, case when event_id % 5 = 0 and event_type not in ('status', 'metric', 'log', 'heartbeat', 'checkpoint', 'evaluation', 'error') then 'unknown_kind' end,
        case when event_id % 13 = 0 then 'stage_length' end, case when event_id % 23 = 0 then 'message_length' end, case when event_id % 17 = 0 or event_id % 19 = 0 then 'loss_not_finite' end], lambda x: x is not null), ',') faults, '[REDACTED]' api_key from events""",
    ),
    "failure_clusters": (failure_clusters, "select count(*) n, count(*) filter (where event_id % 10 = 0) verified, count(*) filter (where event_id % 10 = 0) > 0 and count(*) >= 2 candidate from events group by event_type"),
}
