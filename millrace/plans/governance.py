"""Queries of the gate with governed sources, reviews, manifests and promotion, with their SQL.

Documents stand for training rows. What the tables don't hold (scores, kinds, reviews) is told from their ids, lengths and labels, so that every
branch has rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import curation, promotion
from ..sources.tables import CORPUS_SQL, corpus, table

_KINDS = ("patch", "security_reference", "documentation", "code")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_chars")
    kind = F.get(F.array(*map(F.lit, _KINDS)), F.pmod(n, F.lit(4)).cast("int"))
    labels = F.array_compact(F.array(F.when(F.contains("text", F.lit("the")), "defensive_security"), F.when(n % 3 == 0, "code"), F.when(n % 11 == 0, "patch"), F.when(n % 13 == 0, "other")))
    said = F.when(n % 29 == 0, F.lit(None).cast("string")).when(n % 31 == 0, " \n").otherwise(F.col("text"))
    return table(spark, folder, "documents").select("doc_id", "source", said.alias("text"), F.sha2("text", 256).alias("content_hash"), ((n % 101) / 100).alias("quality_score"), kind.alias("data_type"), labels.alias("labels"), F.when(n % 5 == 0, F.array(F.lit("repeated_lines"))).otherwise(F.array(F.lit("low_lexical_diversity"))).alias("risk_flags"), (n % 7 < 3).alias("reviewed"))


def _reputation(spark: SparkSession, folder: str) -> DataFrame:
    """Sources by what the labels say of their documents; some have none and are unknown."""
    by = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").where("source not in ('src3', 'src4')").groupBy("source").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic"))
    score = F.round(F.col("good") / F.col("n"), 6)
    action = F.when(score >= 0.86, "promote").when(score >= 0.84, "watch").when(score >= 0.5, "throttle").otherwise("quarantine")
    told = by.select("source", score.alias("reputation_score"), (curation.wilson_lower(F.col("good"), F.col("n")) + 0.05).alias("reputation_lower_bound"), F.when(F.length("source") == 5, "quarantine").otherwise(action).alias("action"), F.when(F.col("toxic") > 0, "approved").otherwise("pending").alias("approval_status"), F.when(F.col("n") % 2 == 0, 1.0).otherwise(0.5).alias("license_trust"))
    return told.withColumn("trust_tier", F.when(F.col("reputation_score") > 0.8, "reviewed").otherwise("new"))


def training_gate_governed(spark: SparkSession, folder: str) -> DataFrame:
    out = promotion.training_gate(_rows(spark, folder), _reputation(spark, folder), governed=True, allow_quarantine=True, reviewed=F.col("reviewed"))
    return out.select("doc_id", "gate_score", F.array_join("gate_reasons", ",").alias("gate_reasons"), F.array_join("priority_labels", ",").alias("priority_labels"), "status")


def _reviews(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Documents with labels as items, and two or three decisions on most."""
    items = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(F.col("doc_id").alias("id"), F.col("source").alias("source_id"), F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "approved").when(F.col("quality") == 0, "rejected").otherwise("queued").alias("status"), "quality", "toxic", "n_chars")
    said = lambda c: F.when(c, "approve").otherwise("reject")
    made = lambda who, when, what: F.struct(F.lit(who).alias("reviewer_id"), when.cast("double").alias("created_at"), said(what).alias("decision"))
    n = F.col("n_chars")
    three = F.array(made("r1", n % 7, F.col("quality") == 1), made("r2", n % 5, F.col("toxic") == 0), made("r3", n % 3, n % 2 == 0))
    some = F.slice(three, 1, (n % 4).cast("int"))
    return items, items.select(F.col("id").alias("review_item_id"), F.explode(some).alias("d")).select("review_item_id", "d.*")


def review_evidence(spark: SparkSession, folder: str) -> DataFrame:
    return promotion.review_evidence(*_reviews(spark, folder))


def governance_counts(spark: SparkSession, folder: str) -> DataFrame:
    items, _ = _reviews(spark, folder)
    return promotion.governance_counts(_reputation(spark, folder).select(F.col("approval_status").alias("status")), items.select("status", (F.col("n_chars") % 12).alias("priority")))


def reviewer_qualification(spark: SparkSession, folder: str) -> DataFrame:
    """Sources as reviewers: their labelled documents' numbers are the items, quality the answer, freedom of toxicity the key."""
    x = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select("source", (F.col("doc_id") % 24).alias("item_id"), "quality", "toxic")
    answers = x.groupBy("source", "item_id").agg(F.when(F.max("quality") == 1, "approve").otherwise("reject").alias("decision")).withColumnRenamed("source", "reviewer_id")
    key = x.where("item_id < 20").groupBy("item_id").agg(F.when(F.min("toxic") == 0, "approve").otherwise("reject").alias("expected"))
    return promotion.qualified_reviewers(answers, key, least_accuracy=0.5)


def source_manifest(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", F.col("source").alias("source_id"), F.when(F.col("n_chars") % 3 > 0, F.col("lang")).alias("source_snapshot_sha256"), F.col("n_chars").cast("string").alias("immutable_revision"), F.when(F.col("n_chars") % 2 == 0, F.col("lang")).alias("legal_approval_sha256"))
    return promotion.source_manifest(rows, "doc_id", ("immutable_revision", "legal_approval_sha256"))


def license_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return promotion.license_manifest(corpus(spark, folder).withColumn("license", F.when(F.col("license") == "unknown", F.lit("")).otherwise(F.upper("license"))))


def normalized_rows(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("n_chars")
    null = F.lit(None).cast("string")
    rows = table(spark, folder, "documents").select("doc_id", F.when(n % 4 == 0, F.col("text")).when(n % 17 == 0, "  ").otherwise(null).alias("text"), F.when(n % 4 == 1, F.col("text")).otherwise(null).alias("content"), F.when(n % 4 >= 2, F.col("text")).otherwise(null).alias("prompt"), F.when(n % 4 == 3, F.col("lang")).otherwise(null).alias("chosen"), F.when(n % 2 == 0, F.col("source")).otherwise(null).alias("source"), F.when(n % 3 == 0, "MIT").otherwise(null).alias("spdx_license"), F.when(n % 5 == 0, False).when(n % 5 == 1, True).alias("accepted"), F.when(n % 6 == 0, F.create_map(F.lit("source"), F.col("lang"))).alias("provenance"))
    out = promotion.normalized(rows, "/data/crawl/part.jsonl", "general")
    return out.select("doc_id", "source", "license", "category", "content_hash", F.array_join(F.array_sort(F.transform(F.map_entries("provenance"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",").alias("provenance"))


def promotion_checks(spark: SparkSession, folder: str) -> DataFrame:
    """The decision on all documents, with measures of their scores, licences, reviews, sources and duplicates."""
    rows = _rows(spark, folder).join(corpus(spark, folder).select("doc_id", "license", "lang"), "doc_id")
    by_source = rows.groupBy("source").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    shares = by_source.crossJoin(by_source.agg(F.sum("chars").alias("all"))).select("source", (F.col("chars") / F.col("all")).alias("share"))
    families = rows.groupBy("lang").agg(F.sum(F.length(F.coalesce("text", F.lit("")))).alias("chars"))
    copies = rows.groupBy("content_hash").agg((F.count(F.lit(1)) - 1).alias("more")).agg(F.sum("more").alias("exact_duplicates"))
    evidence = review_evidence(spark, folder).agg(F.round(F.avg("reviewer_agreement_kappa"), 6).alias("reviewer_agreement"), F.round(F.sum("approved") / F.greatest(F.lit(1), F.sum("approved") + F.sum("rejected")), 8).alias("human_sample_acceptance"))
    high = F.col("data_type").isin("patch", "security_reference")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    measures = rows.agg(
        F.count(F.lit(1)).alias("records"), F.round(F.avg("quality_score"), 6).alias("average_quality"), F.round(F.percentile("quality_score", 0.1), 6).alias("p10_quality"), share(F.col("license") != "unknown").alias("license_coverage"), share(F.col("source").isNotNull()).alias("provenance_coverage"),
        F.round(F.count_if(high & F.col("reviewed")) / F.greatest(F.lit(1), F.count_if(high)), 6).alias("high_value_review_coverage"), F.lit(1.0).alias("verified_patch_evidence_coverage"), F.count_if(F.col("text").rlike(r"[a-z0-9.]+@[a-z0-9.]+\.com")).alias("secret_or_pii_hits"),
        F.count_if(F.contains("text", F.lit("benchmark"))).alias("benchmark_contamination"), F.lit(0.0).alias("residual_near_duplicate_fraction"), F.lit(0).alias("cross_split_group_collisions"), F.lit(0).alias("patch_inconsistencies"),
    )
    total = families.agg(F.round(F.max("chars") / F.sum("chars"), 6).alias("maximum_source_family_token_fraction"))
    largest = shares.agg(F.round(F.max("share"), 6).alias("maximum_source_token_fraction"))
    governed = promotion.governed_sources(_reputation(spark, folder), shares)
    for one in (copies, evidence, total, largest, governed):  # one row each
        measures = measures.crossJoin(F.broadcast(one))
    return promotion.promotion_decision(measures)


_ROWS = f"""rows_ as (select doc_id, source, n_chars n, case when n_chars % 29 = 0 then null when n_chars % 31 = 0 then ' ' || chr(10) else text end text, sha256(text) content_hash, (n_chars % 101) / 100 quality_score, [{', '.join(f"'{k}'" for k in _KINDS)}][n_chars % 4 + 1] data_type,
  list_filter([case when contains(text, 'the') then 'defensive_security' end, case when n_chars % 3 = 0 then 'code' end, case when n_chars % 11 = 0 then 'patch' end], lambda x: x is not null) labels, n_chars % 5 = 0 noisy, n_chars % 7 < 3 reviewed from documents)"""
_WILSON = "round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) + 0.05"
_REPUTATION = f"""rep0 as (select source, sum(quality) / count(*) p, count(*) n, sum(toxic) toxic from documents join labels using (doc_id) where source not in ('src3', 'src4') group by 1),
rep as (select source, round(p, 6) score, {_WILSON} low, case when length(source) = 5 then 'quarantine' when round(p, 6) >= 0.86 then 'promote' when round(p, 6) >= 0.84 then 'watch' when round(p, 6) >= 0.5 then 'throttle' else 'quarantine' end action,
  case when toxic > 0 then 'approved' else 'pending' end approval, case when n % 2 = 0 then 1.0 else 0.5 end trust, case when round(p, 6) > 0.8 then 'reviewed' else 'new' end tier from rep0)"""
_GOVERNED = f"""with {_ROWS}, {_REPUTATION},
j as (select r.*, coalesce(score, 0.5) score, coalesce(low, 0) low, coalesce(action, 'unknown') action, coalesce(action = 'quarantine' and approval = 'approved' and trust >= 1, false) q,
  list_sort(list_concat(labels, case data_type when 'patch' then ['patch_or_debug_trace'] when 'security_reference' then ['security_reference'] else [] end)) pri, row_number() over (partition by content_hash order by doc_id) > 1 again from rows_ r left join rep using (source)),
k as (select *, list_filter([case when quality_score < 0.58 then 'quality_below_training_threshold' end, case when score < 0.45 then 'source_reputation_below_threshold' end, case when action not in ('promote', 'watch') and not q then 'source_governance_action:' || action end,
  case when low < 0.7 and not q then 'source_reputation_lower_bound_below_threshold' end, case when noisy and quality_score < 0.72 then 'boilerplate_or_low_signal_noise' end, case when coalesce(text, '') in ('', ' ' || chr(10)) then 'empty_text' end], lambda x: x is not null) bad,
  least(1.0::double, greatest(0.0::double, 0.7::double * quality_score + 0.2::double * score + 0.1::double * least(1.0::double, len(pri) / 3.0::double) + case when data_type = 'patch' or list_contains(labels, 'patch') then 0.12::double else 0 end + case when data_type = 'security_reference' or list_contains(labels, 'defensive_security') then 0.08::double else 0 end - case when noisy then 0.1::double else 0 end)) raw,
  (data_type in ('patch', 'security_reference') or list_has_any(labels, ['defensive_security', 'patch'])) and not reviewed must,
  cast('0x' || substring(sha256(concat_ws(':', '1337', source, data_type, content_hash)), 1, 13) as bigint) / 4503599627370496.0 < 0.03 and not reviewed sampled from j)
select doc_id, round(raw, 6) gate_score, array_to_string(list_filter(list_concat(bad, [case when len(bad) = 0 then case when must then 'independent_high_value_review_required' when sampled then 'routine_stratified_review_sample' end end, case when again then 'duplicate_after_gate' end]), lambda x: x is not null), ',') gate_reasons,
  array_to_string(pri, ',') priority_labels, case when again then 'rejected' when len(bad) > 0 then case when raw >= 0.62 and len(pri) > 0 then 'review_queue' else 'rejected' end when must or sampled then 'review_queue' else 'promoted' end status from k"""
_ITEMS = """items as (select doc_id id, source, n_chars n, quality, toxic, case when quality = 1 and toxic = 0 then 'approved' when quality = 0 then 'rejected' else 'queued' end status from documents join labels using (doc_id)),
said as (select id, unnest([{'w': 'r1', 't': n % 7, 'd': quality = 1}, {'w': 'r2', 't': n % 5, 'd': toxic = 0}, {'w': 'r3', 't': n % 3, 'd': n % 2 = 0}][1 : n % 4]) s from items),
ranked as (select id, case when s.d then 'approve' else 'reject' end d, row_number() over (partition by id order by s.t, s.w) k from said),
paired as (select x.id, x.d a, y.d b from ranked x join ranked y on x.id = y.id and x.k = 1 and y.k = 2),
evidence as (select source source_id, count(*) filter (where status = 'approved') approved, count(*) filter (where status = 'rejected') rejected, count(*) filter (where status = 'queued') pending, count(b) paired_reviews, count(*) filter (where a = b) same, count(*) filter (where a = 'approve') ya, count(*) filter (where b = 'approve') yb from items left join paired using (id) group by 1),
chance as (select *, (ya / paired_reviews) * (yb / paired_reviews) + (1 - ya / paired_reviews) * (1 - yb / paired_reviews) e from evidence),
told as (select source_id, approved, rejected, pending, paired_reviews, round(case when paired_reviews = 0 then 0.0 when e >= 1 then 1.0 else greatest(-1.0::double, least(1.0::double, (same / paired_reviews - e) / (1 - e))) end, 6) reviewer_agreement_kappa, round(approved / greatest(1, approved + rejected), 6) acceptance_rate from chance)"""
_CHECKS = f"""with {_ROWS}, {_REPUTATION}, {_ITEMS}, {CORPUS_SQL},
r as (select rows_.*, license, lang, length(coalesce(rows_.text, '')) c from rows_ join corpus using (doc_id)), s as (select source, sum(c) / (select sum(c) from r) share from r group by 1),
m as (select count(*) records, round(avg(quality_score), 6) average_quality, round(quantile_cont(quality_score, 0.1), 6) p10_quality, round(avg((license <> 'unknown')::int), 6) license_coverage, round(avg((source is not null)::int), 6) provenance_coverage,
  round(count(*) filter (where data_type in ('patch', 'security_reference') and reviewed) / greatest(1, count(*) filter (where data_type in ('patch', 'security_reference'))), 6) high_value, count(*) filter (where regexp_matches(text, '[a-z0-9.]+@[a-z0-9.]+\\.com')) pii, count(*) filter (where contains(text, 'benchmark')) contamination,
  (select round(max(share), 6) from s) largest, (select round(max(c) / sum(c), 6) from (select lang, sum(c) c from r group by 1)) family, (select count(*) - count(distinct content_hash) from r) copies,
  (select coalesce(bool_and(coalesce((approval = 'approved' and tier = 'reviewed' and action in ('promote', 'watch') and low >= 0.7) or (approval = 'approved' and action = 'quarantine' and trust >= 1 and coalesce(share, 0) <= 0.01), false)), true) from rep left join s using (source))::int governed,
  (select round(avg(reviewer_agreement_kappa), 6) from told) agreement, (select round(sum(approved) / greatest(1, sum(approved) + sum(rejected)), 8) from told) acceptance from r),
c as (select unnest([{{'k': 'minimum_records', 'v': records, 't': 100000, 'ok': records >= 100000}}, {{'k': 'average_quality', 'v': average_quality, 't': 0.8, 'ok': average_quality >= 0.8}}, {{'k': 'p10_quality', 'v': p10_quality, 't': 0.7, 'ok': p10_quality >= 0.7}}, {{'k': 'license_coverage', 'v': license_coverage, 't': 1, 'ok': license_coverage >= 1}},
  {{'k': 'provenance_coverage', 'v': provenance_coverage, 't': 1, 'ok': provenance_coverage >= 1}}, {{'k': 'high_value_review_coverage', 'v': high_value, 't': 1, 'ok': high_value >= 1}}, {{'k': 'verified_patch_evidence_coverage', 'v': 1, 't': 1, 'ok': true}}, {{'k': 'secret_or_pii_hits', 'v': pii, 't': 0, 'ok': pii <= 0}}, {{'k': 'benchmark_contamination', 'v': contamination, 't': 0, 'ok': contamination <= 0}},
  {{'k': 'residual_near_duplicate_fraction', 'v': 0, 't': 0.005, 'ok': true}}, {{'k': 'source_token_cap', 'v': largest, 't': 0.2, 'ok': largest <= 0.2}}, {{'k': 'source_family_token_cap', 'v': family, 't': 0.35, 'ok': family <= 0.35}}, {{'k': 'cross_split_group_collisions', 'v': 0, 't': 0, 'ok': true}}, {{'k': 'exact_duplicates_after_promotion', 'v': copies, 't': 0, 'ok': copies <= 0}},
  {{'k': 'governed_source_reputation', 'v': governed, 't': 1, 'ok': governed >= 1}}, {{'k': 'reviewer_agreement', 'v': agreement, 't': 0.8, 'ok': agreement >= 0.8}}, {{'k': 'human_sample_acceptance', 'v': acceptance, 't': 0.95, 'ok': acceptance >= 0.95}}, {{'k': 'verified_patch_report_consistent', 'v': 0, 't': 0, 'ok': true}}]) x from m)
select x.k as "check", x.v::double as value, x.t::double threshold, x.ok passed, case when (select bool_and(x.ok) from c) then 'promoted' else 'rejected' end status from c"""

QUERIES = {
    "training_gate_governed": (training_gate_governed, _GOVERNED),
    "review_evidence": (review_evidence, f"with {_ITEMS} select * from told"),
    "governance_counts": (
        governance_counts,
        f"""with {_REPUTATION}, {_ITEMS} select (select count(*) from rep where approval = 'pending') approvals_pending, (select count(*) from rep where approval = 'approved') approvals_approved, (select count(*) from rep where approval = 'rejected') approvals_rejected,
        count(*) filter (where status = 'queued') review_queued, count(*) filter (where status = 'approved') review_approved, count(*) filter (where status = 'rejected') review_rejected, count(*) filter (where status = 'queued' and n % 12 >= 8) high_priority_review from items""",
    ),
    "reviewer_qualification": (
        reviewer_qualification,
        """with x as (select source, doc_id % 24 item, quality, toxic from documents join labels using (doc_id)), a as (select source, item, max(quality) = 1 yes from x group by 1, 2), k as (select item, min(toxic) = 0 yes from x where item < 20 group by 1),
        s as (select source reviewer_id, count(*) answered, count(*) filter (where a.yes = k.yes) correct, count(*) filter (where k.item is null) odd from a left join k using (item) group by 1)
        select reviewer_id, answered, correct, round(correct / 20, 6) accuracy, answered = 20 and odd = 0 and round(correct / 20, 6) >= 0.5 passed from s""",
    ),
    "source_manifest": (source_manifest, "with r as (select doc_id, source, case when n_chars % 3 > 0 then lang else '' end s, n_chars::varchar v, case when n_chars % 2 = 0 then lang else '' end l from documents) select source source_id, s source_snapshot_sha256, arg_max(v, doc_id) immutable_revision, arg_max(l, doc_id) legal_approval_sha256 from r group by 1, 2"),
    "license_manifest": (license_manifest, f"with {CORPUS_SQL} select license, count(*) records from corpus group by 1"),
    "normalized_rows": (
        normalized_rows,
        r"""with r as (select doc_id, n_chars n, lang, case when n_chars % 4 = 3 then text || chr(10) || lang when n_chars % 4 <> 0 and n_chars % 17 = 0 then '  ' else text end body, case when n_chars % 2 = 0 then source else 'part' end src, case when n_chars % 3 = 0 then 'mit' else 'unknown' end lic from documents where n_chars % 5 <> 0)
        select doc_id, src source, lic license, 'general' category, sha256(body) content_hash, 'license=' || lic || ',source=' || case when n % 6 = 0 then lang else src end || ',source_path=/data/crawl/part.jsonl' provenance from r where not regexp_matches(body, '^\s*$')""",
    ),
    "promotion_checks": (promotion_checks, _CHECKS),
}
