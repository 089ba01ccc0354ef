"""What decides whether rows may train a model: the gate with governed sources, reviews, manifests, and the promotion of a dataset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

# Fixed values.
PATCH_TYPES = ("patch", "debug_trace")
SECURITY_TYPES = ("security_advisory", "security_reference")
HIGH_VALUE = ("defensive_security", "code", "patch", "tests", "runtime_trace", "agentic_coding")
MANDATORY_REVIEW = ("defensive_security", "patch", "tests", "runtime_trace")
NOISE = ("navigation_or_boilerplate_noise", "repeated_lines", "heavy_boilerplate_noise")
GATE = {"quality": 0.58, "reputation": 0.45, "lower_bound": 0.70, "high_value": 0.72, "review_score": 0.62, "review_share": 0.03, "patch_bonus": 0.12, "security_bonus": 0.08, "seed": "1337"}
#: A source without evidence.
UNKNOWN_SOURCE = {"reputation_score": 0.5, "reputation_lower_bound": 0.0, "action": "unknown", "approval_status": "pending", "license_trust": 0.0}
POLICY = {
    "minimum_records": 100_000, "minimum_average_quality": 0.8, "minimum_p10_quality": 0.7, "maximum_residual_near_duplicate_fraction": 0.005, "maximum_benchmark_contamination": 0,
    "maximum_secret_or_pii_hits": 0, "required_license_coverage": 1.0, "required_provenance_coverage": 1.0, "required_high_value_review_coverage": 1.0, "required_verified_patch_evidence_coverage": 1.0,
    "source_max_token_fraction": 0.2, "source_family_max_token_fraction": 0.35, "new_source_max_token_fraction": 0.01, "minimum_reputation_lower_bound": 0.7, "reviewer_agreement_minimum": 0.8, "sampled_acceptance_minimum": 0.95,
}


def _some(values: Column, names: tuple[str, ...]) -> Column:
    return F.arrays_overlap(F.coalesce(values, F.array().cast("array<string>")), F.array(*map(F.lit, names)))


def independent_review(decisions: Column, adjudication: Column | None = None) -> Column:
    """Whether two reviewers approved, or they differed and a third approved.

    ``decisions``: array of (reviewer_id, decision); ``adjudication``: (adjudicator_id, decision).
    """
    known = F.coalesce(decisions, F.array().cast("array<struct<reviewer_id: string, decision: string>>"))
    reviewers = F.array_distinct(F.filter(F.transform(known, lambda d: d["reviewer_id"]), lambda x: F.coalesce(x, F.lit("")) != ""))
    values = F.filter(F.transform(known, lambda d: d["decision"]), lambda x: x.isin("approve", "reject"))
    enough = (F.size(reviewers) >= 2) & (F.size(values) >= 2)
    agreed = ~F.array_contains(values, "reject")
    settled = F.lit(False)
    if adjudication is not None:
        settled = F.coalesce((F.size(F.array_distinct(values)) > 1) & (adjudication["decision"] == "approve") & ~F.coalesce(F.array_contains(reviewers, adjudication["adjudicator_id"]), F.lit(False)), F.lit(False))
    return enough & (agreed | settled)


def training_gate(rows: DataFrame, reputation: DataFrame | None = None, governed: bool = False, allow_quarantine: bool = False, order: str = "doc_id", reviewed: Column | None = None) -> DataFrame:
    """Adds gate_score, gate_reasons, priority_labels and status to gated rows (source, text, content_hash, quality_score, data_type, labels, risk_flags).

    ``reputation``: a row for each source with reputation_score, reputation_lower_bound, action, approval_status and license_trust; sources that aren't in it
    are unknown. ``governed`` asks for an action, a lower bound and independent reviews (``reviewed``). Status is promoted, review_queue or rejected; a row whose
    content an earlier one has is rejected. Null texts count as empty, null scores as 0, null sources as ``unknown``.

    Earlier copies are found by the least order of each content hash, joined back: no row travels with its text.
    """
    c, g = F.col, GATE
    joined = rows.withColumn("_source", F.coalesce("source", F.lit("unknown")))
    if reputation is None:
        for k, v in UNKNOWN_SOURCE.items():
            joined = joined.withColumn(f"_{k}", F.lit(v))
    else:
        told = reputation.select(F.coalesce("source", F.lit("unknown")).alias("_source"), *[c(k).alias(f"_{k}") for k in UNKNOWN_SOURCE])
        joined = joined.join(told, "_source", "left")
        for k, v in UNKNOWN_SOURCE.items():
            joined = joined.withColumn(f"_{k}", F.coalesce(f"_{k}", F.lit(v)))
    score, trust, low = T.unit(F.coalesce("quality_score", F.lit(0.0))), T.unit(c("_reputation_score")), T.unit(c("_reputation_lower_bound"))
    kind = F.coalesce("data_type", F.lit("unknown"))
    of_type = F.array_compact(F.array(F.when(kind.isin(*PATCH_TYPES), "patch_or_debug_trace"), F.when(kind.isin(*SECURITY_TYPES), "security_reference")))
    priorities = F.array_sort(F.array_distinct(F.concat(F.array_intersect(F.coalesce("labels", F.array().cast("array<string>")), F.array(*map(F.lit, HIGH_VALUE))), of_type)))
    noisy = _some(c("risk_flags"), NOISE)
    patch, security = kind.isin(*PATCH_TYPES) | F.array_contains("labels", "patch"), kind.isin(*SECURITY_TYPES) | F.array_contains("labels", "defensive_security")
    quarantined = F.lit(allow_quarantine) & (c("_action") == "quarantine") & (c("_approval_status") == "approved") & (c("_license_trust") >= 1.0)
    bad = [F.when(score < g["quality"], "quality_below_training_threshold"), F.when(trust < g["reputation"], "source_reputation_below_threshold")]
    if governed:
        bad.append(F.when(~c("_action").isin("promote", "watch") & ~quarantined, F.concat(F.lit("source_governance_action:"), "_action")))
        bad.append(F.when((low < g["lower_bound"]) & ~quarantined, "source_reputation_lower_bound_below_threshold"))
    bad.append(F.when(noisy & (score < g["high_value"]), "boilerplate_or_low_signal_noise"))
    bad.append(F.when(F.coalesce("text", F.lit("")).rlike(r"(?U)^\s*$"), "empty_text"))
    raw = 0.70 * score + 0.20 * trust + 0.10 * F.least(F.lit(1.0), F.size("priority_labels") / F.lit(3.0))
    raw = raw + F.when(patch, g["patch_bonus"]).otherwise(0.0) + F.when(security, g["security_bonus"]).otherwise(0.0) - F.when(noisy, 0.10).otherwise(0.0)
    u = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(g["seed"]), "_source", kind, "content_hash"), 256), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    done = F.lit(False) if reviewed is None else F.coalesce(reviewed, F.lit(False))
    mandatory = kind.isin(*PATCH_TYPES, *SECURITY_TYPES) | _some(c("labels"), MANDATORY_REVIEW)
    df = joined.withColumn("priority_labels", priorities).withColumn("_bad", F.array_compact(F.array(*bad))).withColumn("_raw", T.unit(raw))
    df = df.withColumn("_review", F.when(F.size("_bad") == 0, F.when(F.lit(governed) & mandatory & ~done, "independent_high_value_review_required").when((u < g["review_share"]) & ~done, "routine_stratified_review_sample")))
    first = rows.groupBy("content_hash").agg(F.min(order).alias("_first"))
    df = df.join(first, "content_hash", "left").withColumn("_again", F.coalesce(c("_first") < c(order), F.lit(False)))
    uncertain = (c("_raw") >= g["review_score"]) & (F.size("priority_labels") > 0)
    status = F.when(c("_again"), "rejected").when(F.size("_bad") > 0, F.when(uncertain, "review_queue").otherwise("rejected")).when(c("_review").isNotNull(), "review_queue").otherwise("promoted")
    reasons = F.array_compact(F.concat("_bad", F.array("_review", F.when(c("_again"), "duplicate_after_gate"))))
    out = df.withColumn("gate_score", F.round("_raw", 6)).withColumn("gate_reasons", reasons).withColumn("status", status)
    return out.drop(*[x for x in out.columns if x.startswith("_")])


def review_evidence(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Per source: approved, rejected, pending, paired_reviews, reviewer_agreement_kappa and acceptance_rate.

    ``items``: id, source_id, status; ``decisions``: review_item_id, decision, created_at, reviewer_id. Of an item's decisions the first two in time (then by
    reviewer) are a pair; items of any status count as pending unless they are approved or rejected.
    """
    order = Window.partitionBy("review_item_id").orderBy("created_at", "reviewer_id")
    ranked = decisions.withColumn("_n", F.row_number().over(order)).where("_n <= 2")
    pair = ranked.groupBy(F.col("review_item_id").alias("id")).agg(F.max(F.when(F.col("_n") == 1, F.col("decision"))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col("decision"))).alias("b")).where("b is not null")
    both = items.select("id", "source_id", "status").join(pair, "id", "left")
    yes = lambda x: F.count_if(F.col(x) == "approve")
    by = both.groupBy("source_id").agg(F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(~F.coalesce(F.col("status").isin("approved", "rejected"), F.lit(False))).alias("pending"), F.count("b").alias("paired_reviews"), F.count_if(F.col("a") == F.col("b")).alias("same"), yes("a").alias("ya"), yes("b").alias("yb"))
    n = F.nullif(F.col("paired_reviews"), F.lit(0))
    pa, pb = F.col("ya") / n, F.col("yb") / n
    by_chance = pa * pb + (1 - pa) * (1 - pb)
    kappa = F.when(by_chance >= 1, 1.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.col("same") / n - by_chance) / (1 - by_chance))))
    rate = F.col("approved") / F.greatest(F.lit(1), F.col("approved") + F.col("rejected"))
    return by.select("source_id", "approved", "rejected", "pending", "paired_reviews", F.round(F.when(F.col("paired_reviews") == 0, 0.0).otherwise(kappa), 6).alias("reviewer_agreement_kappa"), F.round(rate, 6).alias("acceptance_rate"))


def governance_counts(approvals: DataFrame, reviews: DataFrame) -> DataFrame:
    """One row: approvals by status, reviews by status, and queued reviews of priority 8 or more."""
    count = lambda status, name: F.count_if(F.col("status") == status).alias(name)
    a = approvals.agg(count("pending", "approvals_pending"), count("approved", "approvals_approved"), count("rejected", "approvals_rejected"))
    r = reviews.agg(count("queued", "review_queued"), count("approved", "review_approved"), count("rejected", "review_rejected"), F.count_if((F.col("status") == "queued") & (F.col("priority") >= 8)).alias("high_priority_review"))
    return a.crossJoin(r)  # one row each


def qualified_reviewers(answers: DataFrame, key: DataFrame, least_accuracy: float = 0.9, items: int = 20) -> DataFrame:
    """Per reviewer: answered, correct, accuracy, passed (A42). A reviewer who hasn't answered just the ``items`` items of the key doesn't pass."""
    told = answers.select("reviewer_id", "item_id", "decision").distinct().join(key.select("item_id", "expected"), "item_id", "left")
    by = told.groupBy("reviewer_id").agg(F.count(F.lit(1)).alias("answered"), F.count_if(F.col("decision") == F.col("expected")).alias("correct"), F.count_if(F.col("expected").isNull()).alias("_odd"))
    accuracy = F.round(F.col("correct") / items, 6)
    return by.select("reviewer_id", "answered", "correct", accuracy.alias("accuracy"), ((F.col("answered") == items) & (F.col("_odd") == 0) & (accuracy >= least_accuracy)).alias("passed"))


def source_manifest(rows: DataFrame, order: str, facts: tuple[str, ...]) -> DataFrame:
    """(source_id, source_snapshot_sha256, facts): of each source and snapshot what the last row in order says."""
    keys = [F.coalesce("source_id", F.lit("unknown")).alias("source_id"), F.coalesce("source_snapshot_sha256", F.lit("")).alias("source_snapshot_sha256")]
    last = rows.select(*keys, F.struct(order, *[F.coalesce(F.col(f), F.lit("")).alias(f) for f in facts]).alias("_m")).groupBy("source_id", "source_snapshot_sha256").agg(F.max("_m").alias("_m"))
    return last.select("source_id", "source_snapshot_sha256", *[f"_m.{f}" for f in facts])


def license_manifest(rows: DataFrame) -> DataFrame:
    """(license, records): how many rows each licence has, in lower case."""
    return rows.groupBy(F.lower(F.coalesce(F.nullif("license", F.lit("")), F.lit("unknown"))).alias("license")).agg(F.count(F.lit(1)).alias("records"))


def normalized(rows: DataFrame, path: str, category: str) -> DataFrame:
    """Training rows with text, source, license, category, content_hash and provenance filled.

    The text is that of the first filled of text, content, prompt and chosen, or prompt and chosen in two lines; the source is the path's stem where none is
    given, the licence is in lower case. What the provenance (map of strings) says stays. Rows with blank texts, and rows that a gate didn't accept, are left out;
    rows without ``accepted`` (null) stay for a gate to judge.
    """
    have = lambda c: F.nullif(F.col(c).cast("string"), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    pair = F.when(have("prompt").isNotNull() & have("chosen").isNotNull(), F.concat(have("prompt"), F.lit("\n"), have("chosen")))
    body = F.coalesce(pair, have("text"), have("content"), have("prompt"), have("chosen"), F.lit(""))
    source = F.coalesce(have("source"), have("repo_path"), F.lit(path.rsplit("/", 1)[-1].rsplit(".", 1)[0]))
    license = F.lower(F.coalesce(have("license"), have("spdx_license"), F.lit("unknown")))
    said = F.col("provenance") if "provenance" in rows.columns else F.lit(None).cast("map<string,string>")
    filled = rows.withColumns({"_text": body, "_source": source, "_license": license, "_category": F.coalesce(have("category"), F.lit(category)), "_hash": F.coalesce(have("content_hash"), F.sha2(body, 256))})
    base = F.create_map(F.lit("source_path"), F.lit(path), F.lit("source"), F.col("_source"), F.lit("license"), F.col("_license"))
    given = F.coalesce(said, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(base, lambda k, _: ~F.array_contains(F.map_keys(given), k))
    out = filled.withColumn("_provenance", F.map_concat(kept, given)).where(~F.col("_text").rlike(r"(?U)^\s*$"))
    if "accepted" in rows.columns:
        out = out.where("coalesce(accepted, true)")
    names = {"text": "_text", "source": "_source", "license": "_license", "category": "_category", "content_hash": "_hash", "provenance": "_provenance"}
    return out.select(*[c for c in rows.columns if c not in names], *[F.col(v).alias(k) for k, v in names.items()])


def governed_sources(reputation: DataFrame, shares: DataFrame, policy: dict = POLICY) -> DataFrame:
    """One row, ``governed``: whether every source is approved, trusted and above the lower bound, or in quarantine with few tokens.

    ``reputation``: source, approval_status, trust_tier, action, reputation_lower_bound, license_trust; ``shares``: source, share of all tokens.
    """
    c = F.col
    x = reputation.join(shares.select("source", "share"), "source", "left")
    mature = (c("approval_status") == "approved") & c("trust_tier").isin("reviewed", "trusted") & c("action").isin("promote", "watch") & (c("reputation_lower_bound") >= policy["minimum_reputation_lower_bound"])
    small = (c("approval_status") == "approved") & (c("action") == "quarantine") & (c("license_trust") >= 1.0) & (F.coalesce("share", F.lit(0.0)) <= policy["new_source_max_token_fraction"])
    return x.agg(F.coalesce(F.bool_and(F.coalesce(mature | small, F.lit(False))), F.lit(True)).alias("governed"))


#: Checks by name: the measure, how it is compared, and the limit (a key of the policy, or a value).
CHECKS = {
    "minimum_records": ("records", ">=", "minimum_records"), "average_quality": ("average_quality", ">=", "minimum_average_quality"), "p10_quality": ("p10_quality", ">=", "minimum_p10_quality"),
    "license_coverage": ("license_coverage", ">=", "required_license_coverage"), "provenance_coverage": ("provenance_coverage", ">=", "required_provenance_coverage"),
    "high_value_review_coverage": ("high_value_review_coverage", ">=", "required_high_value_review_coverage"), "verified_patch_evidence_coverage": ("verified_patch_evidence_coverage", ">=", "required_verified_patch_evidence_coverage"),
    "secret_or_pii_hits": ("secret_or_pii_hits", "<=", "maximum_secret_or_pii_hits"), "benchmark_contamination": ("benchmark_contamination", "<=", "maximum_benchmark_contamination"),
    "residual_near_duplicate_fraction": ("residual_near_duplicate_fraction", "<=", "maximum_residual_near_duplicate_fraction"), "source_token_cap": ("maximum_source_token_fraction", "<=", "source_max_token_fraction"),
    "source_family_token_cap": ("maximum_source_family_token_fraction", "<=", "source_family_max_token_fraction"), "cross_split_group_collisions": ("cross_split_group_collisions", "<=", 0), "exact_duplicates_after_promotion": ("exact_duplicates", "<=", 0),
    "governed_source_reputation": ("governed", ">=", 1), "reviewer_agreement": ("reviewer_agreement", ">=", "reviewer_agreement_minimum"), "human_sample_acceptance": ("human_sample_acceptance", ">=", "sampled_acceptance_minimum"), "verified_patch_report_consistent": ("patch_inconsistencies", "<=", 0),
}


def promotion_decision(measures: DataFrame, policy: dict = POLICY) -> DataFrame:
    """(check, value, threshold, passed, status): the eighteen checks of one row of measures; the dataset is promoted if all hold (A7). A measure that is null fails."""
    names = list(CHECKS)
    limits = {k: float(policy[x] if isinstance(x := CHECKS[k][2], str) else x) for k in names}
    value = {k: F.col(CHECKS[k][0]).cast("double") for k in names}
    holds = {k: F.coalesce(value[k] >= limits[k] if CHECKS[k][1] == ">=" else value[k] <= limits[k], F.lit(False)) for k in names}
    rows = F.array(*[F.struct(F.lit(k).alias("check"), value[k].alias("value"), F.lit(limits[k]).alias("threshold"), holds[k].alias("passed")) for k in names])
    told = measures.select(rows.alias("r"))
    status = F.when(F.forall("r", lambda x: x["passed"]), "promoted").otherwise("rejected")
    return told.select(F.explode("r").alias("x"), status.alias("status")).select("x.*", "status")
