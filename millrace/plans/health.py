"""Queries of roll-ups, fine-tuning records and protected files over the given tables, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graphs, retrieval
from ..operators import health as H
from ..operators.dedup import checkpoint_dir
from ..sources import repositories
from ..sources.tables import table
from . import analysis


def frontier_counts(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("page_id") % 5 == 0, "failed").when(F.col("page_id") % 7 == 0, "queued").otherwise("done")
    return H.status_counts(table(spark, folder, "pages").select(status.alias("status")), table(spark, folder, "labels").select((F.col("quality") == 1).alias("accepted")))


def feedback(spark: SparkSession, folder: str) -> DataFrame:
    report = table(spark, folder, "labels").agg((F.avg("quality") * 0.7).alias("avg_quality"), F.count(F.lit(1)).alias("review_total"), F.sum("toxic").alias("automated_pass"), F.count_distinct("quality").alias("task_types"), F.avg("toxic").alias("strongest_signal"), F.count(F.lit(1)).alias("benchmark_total"), F.avg("quality").alias("benchmark_score"))
    return H.recommendations(report)


def event_histograms(spark: SparkSession, folder: str) -> DataFrame:
    return H.histogram_summary(table(spark, folder, "events").withColumn("odd", F.col("user_id") % 2), "event_type", ["odd"], "value")


def _losses(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("step"), F.when(F.col("event_id") % 997 == 5, float("nan")).otherwise(F.col("value")).alias("loss"))


def loss_gates(spark: SparkSession, folder: str) -> DataFrame:
    return H.loss_gate(_losses(spark, folder)).select("run", "n", "status", F.when(F.col("status") == "pass", F.col("improvement")).alias("improvement"))


def stale_validations(spark: SparkSession, folder: str) -> DataFrame:
    return H.stale_validations(_losses(spark, folder).where("not isnan(loss)"), 3).select("run", "step", "best", "stale", "stop")


def forgetting(spark: SparkSession, folder: str) -> DataFrame:
    return H.forgetting(table(spark, folder, "events").select(F.col("event_type").alias("kind"), (F.col("value") / 40).alias("loss")))


def readiness(spark: SparkSession, folder: str) -> DataFrame:
    status = F.when(F.col("n_chars") % 97 == 0, "fail").when(F.col("n_chars") % 13 == 0, "warn").otherwise("pass")
    return H.readiness(table(spark, folder, "documents").select("source", status.alias("status")), "source")


def last_events(spark: SparkSession, folder: str) -> DataFrame:
    return H.last_of_stage(table(spark, folder, "events").select("event_type", "ts", "event_id", "user_id"), "event_type", ["ts", "event_id"]).select("event_type", "event_id", "user_id")


def unseen_events(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events").select(F.col("user_id").alias("rank"), F.col("event_id").alias("source_sequence"), "event_type")
    return H.unseen(e.unionByName(e.where("event_type = 'click'")), e.where("event_type = 'view'")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def sft_records(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of a turn and the one after it as records; their words' first characters stand for ids."""
    c = table(spark, folder, "conversations")
    pairs = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("instruction")).join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response")), ["conv_id", "turn"])
    system = F.when(F.col("conv_id") % 3 == 0, " Be brief. ")
    thought = F.when(F.col("turn") > 1, F.col("instruction"))
    shown = pairs.select("conv_id", "turn", H.sft_prompt(system, F.col("instruction")).alias("p"), H.sft_completion(thought, F.col("response")).alias("c"))
    ids = lambda x: F.transform(F.filter(F.split(x, r"\s+"), lambda w: w != ""), F.ascii)
    told = shown.select("conv_id", "turn", F.sha2(F.concat("p", "c"), 256).alias("text_hash"), H.sft_arrays(ids(F.col("p")), ids(F.col("c")), 60).alias("a"))
    join = lambda x: F.array_join(F.col(f"a.{x}").cast("array<string>"), " ").alias(x)
    return told.select("conv_id", "turn", "text_hash", join("input_ids"), join("labels"), F.aggregate("a.attention_mask", F.lit(0), lambda s, x: s + x).alias("tokens"))


def protected_formats(spark: SparkSession, folder: str) -> DataFrame:
    """The benchmark's items written as gzipped JSON lines, parquet and JSON objects of several forms, and read back."""
    there = f"{checkpoint_dir(spark)}/formats-{uuid.uuid4().hex}"
    items = table(spark, folder, "benchmark")
    items.write.option("compression", "gzip").json(f"{there}/jsonl")
    items.write.parquet(f"{there}/parquet")
    row = F.struct("item_id", "text")
    form = F.when(F.col("item_id") % 3 == 0, F.to_json(F.array(row))).when(F.col("item_id") % 3 == 1, F.to_json(F.struct(F.lit(1).alias("version"), F.array(row).alias("rows")))).otherwise(F.to_json(row))
    items.select(form.alias("value")).repartition(items.count() or 1, "value").write.option("maxRecordsPerFile", 1).text(f"{there}/json")
    every = None
    for kind in ("jsonl", "parquet", "json"):
        rows = repositories.protected_rows(spark, f"{there}/{kind}", kind).select(F.lit(kind).alias("kind"), F.from_json("payload", "item_id long, text string").alias("r")).select("kind", "r.item_id", F.sha2("r.text", 256).alias("text_hash"))
        every = rows if every is None else every.unionByName(rows)
    return every


def fetched_texts(spark: SparkSession, folder: str) -> DataFrame:
    kind = F.when(F.col("page_id") % 2 == 0, "text/HTML; charset=utf-8").otherwise("text/plain")
    body = F.when(F.col("page_id") % 3 == 0, F.replace("html", F.lit("<html"), F.lit("<htm"))).otherwise(F.col("html"))
    return table(spark, folder, "pages").select("page_id", F.sha2(repositories.fetched_text(body, kind, 2000), 256).alias("text_hash"))


def frontier_claim(spark: SparkSession, folder: str) -> DataFrame:
    """The next fifty urls of a frontier made of pages."""
    n = F.col("page_id")
    front = table(spark, folder, "pages").select("url", F.when(n % 3 > 0, "queued").otherwise("done").alias("status"), (100 + n % 4 * 10).alias("priority"), (n % 9).alias("at"))
    return graphs.claim(front, 50, 6).select("url", "priority", "at")


def retrieval_gate(spark: SparkSession, folder: str) -> DataFrame:
    """The vector ranking against one that finds nine tenths of it."""
    found = analysis.ir_metrics(spark, folder)
    return retrieval.evaluation_gate(found, found.withColumn("recall_20", F.col("recall_20") * 0.9)).select("check", F.round("value", 4).alias("value"), "threshold", "passed", "status")


_LOSS = "l as (select user_id run, event_id step, case when event_id % 997 = 5 then 'nan'::double else value end loss from events)"
_PLAIN = r"trim(regexp_replace(regexp_replace(regexp_replace(b, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))"
_IDS = lambda c: f"list_transform(list_filter(regexp_split_to_array({c}, '\\s+'), lambda w: w <> ''), lambda w: unicode(w))"
_BARE = lambda c: f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"

QUERIES = {
    "frontier_counts": (frontier_counts, "select case when page_id % 5 = 0 then 'urls_failed' when page_id % 7 = 0 then 'urls_queued' else 'urls_done' end as name, count(*) n from pages group by 1 union all select case when quality = 1 then 'documents_accepted' else 'documents_rejected' end, count(*) from labels group by 1"),
    "feedback": (
        feedback,
        """with r as (select avg(quality) * 0.7 q, count(*) n, sum(toxic) p, count(distinct quality) t, avg(toxic) s, avg(quality) b from labels), x as (select unnest([case when q < 0.65 then ['quality_gate', 'high'] end, case when p / n < 0.5 then ['task_extraction', 'high'] end, case when p >= 20 and t < 3 then ['task_diversity', 'medium'] end,
        case when s < 0.2 then ['signal_quality', 'medium'] end, case when b < 0.75 then ['benchmark', 'critical'] end, case when p > 0 then ['human_review_required', 'high'] end]) x from r) select x[1] kind, x[2] severity from x where x is not null""",
    ),
    "frontier_claim": (frontier_claim, "select url, 100 + page_id % 4 * 10 priority, page_id % 9 as at from pages where page_id % 3 > 0 and page_id % 9 <= 6 order by priority, page_id % 9, encode(url) limit 50".replace(" as at ", ' as "at" ')),
    "retrieval_gate": (
        retrieval_gate,
        f"""with i as ({analysis.QUERIES['ir_metrics'][1]}), m as (select count(*)::double tasks, round(avg(recall_20), 6) r, round(avg(ndcg_10), 6) n, round(avg(mrr_10), 6) m, round(avg(precision_20), 6) p, round(avg(recall_20 * 0.9::double), 6) b from i),
        c as (select unnest([{{'k': 'recall_20', 'v': r, 't': 0.9::double}}, {{'k': 'ndcg_10', 'v': n, 't': 0.8}}, {{'k': 'mrr_10', 'v': m, 't': 0.75}}, {{'k': 'precision_20', 'v': p, 't': 0.75}}, {{'k': 'gain', 'v': round(r - b, 6), 't': 0.05}}, {{'k': 'tasks', 'v': tasks, 't': 500}}]) x from m)
        select x.k as "check", round(x.v, 4) as value, x.t threshold, x.v >= x.t passed, case when (select bool_and(x.v >= x.t) from c) then 'passed' else 'failed' end status from c""",
    ),
    "event_histograms": (event_histograms, "select event_type, user_id % 2 odd, count(value) n, round(sum(value), 6) sum, round(avg(value), 6) mean, max(value) max from events group by 1, 2"),
    "loss_gates": (loss_gates, f"with {_LOSS}, r as (select run, count(*) n, arg_min(loss, step) a, arg_max(loss, step) b, bool_and(not isnan(loss)) ok from l group by 1) select run, n, case when ok and (n = 1 or b <= a * 1.5) then 'pass' else 'fail' end status, case when ok and (n = 1 or b <= a * 1.5) then round((a - b) / greatest(abs(a), 1e-9), 6) end improvement from r"),
    "stale_validations": (stale_validations, f"with {_LOSS}, b as (select run, step, loss, min(loss) over w best, row_number() over w k from l where not isnan(loss) window w as (partition by run order by step)), f as (select *, min(k) over (partition by run, best) reached from b) select run, step, best, k - reached stale, k - reached >= 3 stop from f"),
    "forgetting": (forgetting, "with m as (select event_type kind, count(*) tasks, avg(value / 40) m from events group by 1) select kind, tasks, round(m, 4) loss, round(case when m > 0 then exp(least(20, m)) else 1 end, 2) perplexity, round(100 / (1 + m), 2) retention from m"),
    "readiness": (readiness, "select source, count(*) checks, case when bool_or(n_chars % 97 = 0) then 'block' when bool_or(n_chars % 13 = 0) then 'warn' else 'pass' end status from documents group by 1"),
    "last_events": (last_events, "select event_type, arg_max(event_id, (ts, event_id)) event_id, arg_max(user_id, (ts, event_id)) user_id from events group by 1"),
    "unseen_events": (unseen_events, "select event_type, count(*) n from events where event_type <> 'view' group by 1"),
    "sft_records": (
        sft_records,
        f"""with p as (select u.conv_id, u.turn, (case when u.conv_id % 3 = 0 then 'System:' || chr(10) || 'Be brief.' || chr(10) || chr(10) else '' end) || 'User:' || chr(10) || {_BARE('u.text')} || chr(10) || chr(10) || 'Assistant:' || chr(10) p,
          (case when u.turn > 1 and u.text <> '' then '<|thought_start|>' || chr(10) || {_BARE('u.text')} || chr(10) || '<|thought_end|>' || chr(10) else '' end) || {_BARE('a.text')} || chr(10) || '<|document_end|>' c from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1 and u.role = 'user' and a.role = 'assistant'),
        i as (select conv_id, turn, sha256(p || c) text_hash, {_IDS('p')} x, {_IDS('c')} y from p), k as (select *, list_concat(x, y)[1:60] ids, list_concat(list_transform(x, lambda z: -100), y)[1:60] labels from i)
        select conv_id, turn, text_hash, array_to_string(list_concat(ids, list_transform(range(60 - len(ids)), lambda z: 0)), ' ') input_ids, array_to_string(list_concat(labels, list_transform(range(60 - len(ids)), lambda z: -100)), ' ') labels, len(ids) tokens from k""",
    ),
    "protected_formats": (protected_formats, "select kind, item_id, sha256(text) text_hash from benchmark, (values ('jsonl'), ('parquet'), ('json')) k(kind)"),
    "fetched_texts": (fetched_texts, f"with b as (select page_id, left(case when page_id % 3 = 0 then replace(html, '<html', '<htm') else html end, 2000) b from pages) select page_id, sha256(case when page_id % 2 = 0 or contains(lower(b), '<html') then {_PLAIN} else b end) text_hash from b"),
}
