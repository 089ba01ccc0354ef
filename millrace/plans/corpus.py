"""Queries of the corpus operators over the documents, pages and benchmark tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import curation, dedup, filters, promotion, quality
from ..sources.tables import CORPUS_SQL, corpus, table


def _list(terms: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + t.replace("'", "''") + "'" for t in terms) + "]"


def _count(terms: tuple[str, ...]) -> str:
    return f"len(list_filter({_list(terms)}, lambda t: contains(lowered, t)))"


GATE_SQL = rf"""
{CORPUS_SQL},
g0 as (select *, regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g') normal from corpus),
g1 as (select *, trim(regexp_replace(normal, '\s+', ' ', 'g')) compact, lower(normal) lowered from g0),
g2 as (select *, regexp_extract_all(compact, '{quality.WORD}') words, list_transform(string_split(normal, chr(10)), lambda x: trim(x)) lines from g1),
g3 as (select *, len(words) word_count, len(list_distinct(list_transform(words, lambda w: lower(w)))) / greatest(1, len(words)) unique_word_ratio,
  length(regexp_replace(compact, '[^\p{{L}}]', '', 'g')) / greatest(1, length(compact)) alpha_ratio, len(lines) line_count,
  (select count(*) from (select l from unnest(lines) u(l) where length(l) >= 12 group by l having count(*) > 1)) / len(lines) repeated_line_ratio from g2),
g4 as (select *, list_filter([
  case when {_count(quality.SECURITY)} > 0 or regexp_matches(normal, '{quality.TAXONOMY}') then 'defensive_security' end,
  case when {_count(quality.AGENTIC)} > 0 then 'agentic_coding' end, case when {_count(quality.CODE)} > 0 then 'code' end,
  case when contains(lowered, 'diff --git') or (contains(lowered, chr(10) || '+++ ') and contains(lowered, chr(10) || '--- ')) then 'patch' end,
  case when {_count(quality.TESTS)} > 0 then 'tests' end, case when {_count(quality.INFRASTRUCTURE)} > 0 then 'infrastructure' end,
  case when regexp_matches(normal, '{quality.ADDRESS}') then 'runtime_trace' end], lambda x: x is not null) labels, {_count(quality.NOISE)} noise, sha256(compact) compact_hash from g3),
g5 as (select *, word_count >= 80 and unique_word_ratio < 0.08 few, list_filter([
  case when length(compact) < 200 then 'too_short' end, case when length(compact) > 2000000 then 'too_large' end,
  case when license not in ({', '.join(f"'{x}'" for x in quality.LICENSES)}) then 'license_not_allowed' end,
  case when regexp_matches(coalesce(text, ''), '{quality.SECRET_SHAPE.replace("'", "''")}') then 'secret_like_content' end,
  case when regexp_matches(coalesce(text, ''), '{quality.EMAIL}') then 'email_like_pii' end,
  case when length(compact) >= 200 and alpha_ratio < 0.45 then 'low_text_signal' end,
  case when word_count >= 80 and unique_word_ratio < 0.025 then 'low_unique_word_ratio' end,
  case when noise >= 3 and not list_contains(labels, 'code') and not list_contains(labels, 'defensive_security') then 'heavy_boilerplate_noise' end], lambda x: x is not null) r0 from g4),
g6 as (select *, min(case when len(r0) = 0 then doc_id end) over (partition by compact_hash) first_id from g5),
g7 as (select *, case when first_id < doc_id then list_concat(list_filter(r0, lambda x: x not in ('low_text_signal', 'low_unique_word_ratio', 'heavy_boilerplate_noise')), list_concat(['duplicate'], list_filter(r0, lambda x: x in ('low_text_signal', 'low_unique_word_ratio', 'heavy_boilerplate_noise')))) else r0 end reasons from g6),
g8 as (select *, len(reasons) = 0 accepted,
  0.14 * least(1.0, greatest(0.0, (length(compact) - 180) / 2500.0)) + 0.20 * least(1.0, {_count(quality.SECURITY)} / 5.0) + 0.14 * least(1.0, {_count(quality.AGENTIC)} / 4.0)
  + 0.18 * least(1.0, ({_count(quality.CODE)} + case when list_contains(labels, 'code') then 1 else 0 end) / 5.0) + 0.08 * case when list_contains(labels, 'tests') then 1.0 else 0.0 end
  + 0.09 * least(1.0, line_count / 80.0 + case when list_contains(labels, 'patch') then 0.3 else 0.0 end) + 0.09 * least(1.0, greatest(0.0, 1.0 - noise * 0.18 - repeated_line_ratio))
  + 0.08 * least(1.0, unique_word_ratio * 4.0) + case when list_contains(labels, 'defensive_security') and list_contains(labels, 'code') then 0.08 else 0.0 end
  + case when list_contains(labels, 'patch') or list_contains(labels, 'runtime_trace') then 0.05 else 0.0 end raw from g7),
gated as (select *, case when accepted then round(cast(least(1.0, greatest(0.0, raw)) as double), 6) else 0.0 end quality_score,
  list_filter([case when noise >= 3 then 'heavy_boilerplate_noise' end, case when unique_word_ratio < 0.12 then 'low_lexical_diversity' end, case when few then 'low_unique_word_ratio' end,
  case when noise >= 1 then 'navigation_or_boilerplate_noise' end, case when repeated_line_ratio > 0.18 then 'repeated_lines' end], lambda x: x is not null) risk_flags from g8)
"""



def gated(spark: SparkSession, folder: str) -> DataFrame:
    return quality.gate(corpus(spark, folder))


def corpus_stats(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"), F.max(F.length("text")).cast("long").alias("longest"))


def text_normalise(spark: SparkSession, folder: str) -> DataFrame:
    t = F.coalesce("text", F.lit(""))
    return table(spark, folder, "documents").select("doc_id", F.sha2(T.compact(t), 256).alias("compact_hash"), F.length(T.normalized(t)).cast("long").alias("normal_chars"))


def html_to_text(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", F.sha2(T.plain_from_html(F.col("html")), 256).alias("text_hash"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    links = table(spark, folder, "pages").select("page_id", "url", F.explode(T.links(F.col("html"))).alias("link"))
    return links.select("page_id", T.without_fragment(T.absolute(F.col("url"), F.col("link"))).alias("target"))


def url_parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select("page_id", T.host(F.col("url")).alias("host"), T.without_fragment(F.col("url")).alias("url"), T.allowed(F.col("url"), ["example.com", "example.org"]).alias("allowed"))


def token_estimates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), T.quarter_count(F.col("text")).alias("four_chars"), T.policy_tokens(F.col("text")).alias("policy"))


def license_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filters.license_decision(corpus(spark, folder)).groupBy("license_name", "license_ok").agg(F.count(F.lit(1)).alias("n"))


#: Lines as a scan of source files meets them, for the documents have few.
_LINES = ("api_key = 'abcdefghijkl1'", "token='short'", "requests.get (url)", "open(path, request.args)", "subprocess.run(cmd + arg, shell=True)", "subprocess.run(cmd + arg)  # nosec", "password = \"replace-with-yours\"", "Secret = \"0123456789ab\"  # pragma: allowlist secret", "os.system(x)")


def line_findings(spark: SparkSession, folder: str) -> DataFrame:
    own = spark.createDataFrame([(-1, "\n".join(_LINES))], "doc_id long, text string")
    rows = table(spark, folder, "documents").select("doc_id", "text").unionByName(own)
    return filters.line_findings(rows).select("doc_id", F.col("line").cast("long").alias("line"), "rule", F.sha2("evidence", 256).alias("evidence_hash"))


def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    return gated(spark, folder).select("doc_id", "accepted", F.array_join("reasons", ",").alias("reasons"), F.array_join("labels", ",").alias("labels"), "quality_score", F.array_join("risk_flags", ",").alias("flags"))


def text_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return quality.metrics(table(spark, folder, "documents")).select("doc_id", "word_count", F.round("unique_word_ratio", 8).alias("unique_word_ratio"), F.round("alpha_ratio", 8).alias("alpha_ratio"), "line_count", F.round("repeated_line_ratio", 8).alias("repeated_line_ratio"))


def quality_report(spark: SparkSession, folder: str) -> DataFrame:
    return quality.report(quality.gate(corpus(spark, folder), licenses=(*quality.LICENSES, "unknown")))


def source_quality(spark: SparkSession, folder: str) -> DataFrame:
    return curation.source_quality(gated(spark, folder)).select("source", "rows", "mean", "security", "code", "score", "status")


def label_agreement(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.gate(corpus(spark, folder), licenses=(*quality.LICENSES, "unknown")).select("doc_id", "accepted")
    return rows.join(table(spark, folder, "labels"), "doc_id").groupBy("quality", "accepted").agg(F.count(F.lit(1)).alias("n"))


#: What stands behind documents, by their length, so that patterns are met in whole texts.
_NAMED = ("see HumanEval and pass@1", "the entry_point", "xhumanevalx", "apples", "SWE-bench swe-bench", "")


def contam_patterns(spark: SparkSession, folder: str) -> DataFrame:
    named = F.get(F.array(*map(F.lit, _NAMED)), (F.col("n_chars") % len(_NAMED)).cast("int"))
    rows = table(spark, folder, "documents").select("doc_id", F.concat("text", F.lit("\n"), named).alias("text"))
    return rows.select("doc_id", filters.first_pattern(F.col("text")).alias("pattern")).where("pattern is not null")


def contam_exact(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "text").unionByName(table(spark, folder, "benchmark").select((-1 - F.col("item_id")).alias("doc_id"), F.concat(F.lit(" "), "text").alias("text")))
    return filters.protected_match(rows, table(spark, folder, "benchmark")).where("hit is not null").select("doc_id", "hit")


def contam_containment(spark: SparkSession, folder: str) -> DataFrame:
    return filters.containment(table(spark, folder, "documents"), table(spark, folder, "benchmark"), dedup.shingles)


def dedup_exact(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.first_of(corpus(spark, folder), "content_hash", "doc_id").select("doc_id", "content_hash")


def simhash_sha(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.simhash(table(spark, folder, "documents"))


def near_pairs_sha(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.near_pairs(dedup.simhash(table(spark, folder, "documents")))


def near_classes_sha(spark: SparkSession, folder: str) -> DataFrame:
    prints = dedup.simhash(table(spark, folder, "documents"))
    return dedup.linked(prints, dedup.near_pairs(prints), "simhash")


def shingle_jaccard_classes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return dedup.linked(dedup.shingle_keys(docs), dedup.jaccard_pairs(docs), "key")


def shingle_jaccard_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.jaccard_pairs(table(spark, folder, "documents"))


def dedup_greedy(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder).select("doc_id", "source", "content_hash")
    prints = dedup.simhash(table(spark, folder, "documents"))
    out = dedup.greedy(dedup.stored(rows.join(prints, "doc_id")), ["content_hash", "simhash"], 3)
    return out.groupBy("source", F.coalesce("reason", F.lit("accepted")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def minhash_sha(spark: SparkSession, folder: str) -> DataFrame:
    signs = dedup.minhash(table(spark, folder, "documents"), "doc_id")
    return signs.select("doc_id", F.sha2(F.array_join(F.col("minhash").cast("array<string>"), ","), 256).alias("signature"))


def _with_items(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The documents, and each benchmark item with some words behind it, as rows; and the items."""
    items = table(spark, folder, "benchmark").select(F.col("item_id").cast("string").alias("item_id"), "text")
    rows = table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return rows.union(items.select(F.concat(F.lit("like "), "item_id"), F.concat("text", F.lit(" two more words")))), items


def contam_minhash_sha(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.near_protected(*_with_items(spark, folder))


def near_comparisons(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.comparisons(dedup.simhash(table(spark, folder, "documents")))


def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    return corpus(spark, folder).where(curation.share_below("sample", F.col("source"), F.col("content_hash")) < 0.2).select("doc_id", "source")


def group_split(spark: SparkSession, folder: str) -> DataFrame:
    return curation.group_split(corpus(spark, folder), []).select("doc_id", "split", "split_group")


def training_gate(spark: SparkSession, folder: str) -> DataFrame:
    rows = quality.gate(corpus(spark, folder), licenses=(*quality.LICENSES, "unknown"))
    rows = rows.withColumn("quality_score", F.floor(F.col("quality_score") * 100_000 + 0.01) / 100_000)  # so that no result lies between two roundings
    reasons = F.filter("gate_reasons", lambda x: x != "routine_stratified_review_sample")
    return promotion.training_gate(rows).select("doc_id", "gate_score", F.array_join(reasons, ",").alias("gate_reasons"))


def source_balance(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").withColumn("source", F.when(F.col("doc_id") % 3 == 0, "big").otherwise(F.col("source")))
    return curation.capped(rows, 0.15, "doc_id").select("doc_id", "source")


def wilson(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").groupBy("source").agg(F.sum("quality").alias("good"), F.count(F.lit(1)).alias("n"))
    return by.select("source", curation.wilson_lower(F.col("good"), F.col("n")).alias("lower_bound"))


def trust_metrics(spark: SparkSession, folder: str) -> DataFrame:
    rows = corpus(spark, folder).withColumn("tokens", T.policy_tokens(F.col("text")))
    return curation.trust(quality.gate(rows, licenses=(*quality.LICENSES, "unknown")))


def shard_pack(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", F.split(T.compact(F.col("text")), " ").alias("token_ids"))
    return curation.batches(curation.shards(docs, 5000, 2), 512, 4).select("doc_id", "start", "shard", "offset", "batch", "rank")


def deficit_mix(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select("doc_id", "lang", T.word_count(F.col("text")).alias("tokens"))
    return curation.deficit_order(rows, {"en": 0.5, "de": 0.3, "fr": 0.2}, "doc_id", "lang", "tokens").select("doc_id", F.round("mix_at", 4).alias("mix_at"))


def source_budget(spark: SparkSession, folder: str) -> DataFrame:
    by = table(spark, folder, "documents").groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("weight"), F.sum("n_chars").cast("double").alias("cap"))
    return curation.budgets(by, 100_000, least=100)


def mix_buckets(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "documents").select(F.col("lang").alias("bucket"), T.word_count(F.col("text")).alias("tokens"))
    return curation.mix_report(rows, {"en": 0.4, "de": 0.3, "fr": 0.2})


def redact(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", F.sha2(T.redacted(F.col("text")), 256).alias("h"))


_TOKENS = "case when len(regexp_extract_all(lower(coalesce(text, '')), '" + dedup.TOKEN + "')) > 0 then regexp_extract_all(lower(coalesce(text, '')), '" + dedup.TOKEN + r"') else list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') end"
_SHINGLES = f"sh as (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(1, len(t) - 4) + 1), lambda i: array_to_string(t[i : i + 4], ' ')))) s from (select doc_id, {_TOKENS} t from documents) where len(t) > 0)"
_SIMHASH = f"votes as (select doc_id, b, sum(case when (h >> b) & 1 = 1 then n else -n end) v from (select doc_id, count(*) n, cast('0x' || substring(sha256(t), 1, 15) as bigint) h from (select doc_id, unnest({_TOKENS}) t from documents) group by doc_id, t), range(0, 60) r(b) group by doc_id, b), prints as (select d.doc_id, cast(sum(case when coalesce(v, 0) >= 0 then 1::bigint << r.b else 0 end) as bigint) simhash from documents d cross join (select cast(range as integer) b from range(0, 60)) r left join votes on votes.doc_id = d.doc_id and votes.b = r.b group by d.doc_id)"
_UNKNOWN_OK = GATE_SQL.replace("license not in (", "license not in ('unknown', ")
_U = lambda *parts: "cast('0x' || substring(sha256(concat_ws(':', " + ", ".join(parts) + ")), 1, 13) as bigint) / 4503599627370496.0"

_GATE_UNKNOWN = GATE_SQL.replace("license not in (", "license not in ('unknown', ")
_HASH60 = "cast('0x' || substring(sha256({}), 1, 15) as bigint)"
#: One-permutation signatures of ``shingled`` (k, s), with empty slots filled from the next filled one.
_SIGNED = f"""
hashed as (select k, {_HASH60.format('s')} h from shingled),
least_ as (select k, cast(h % 64 as integer) b, min(h >> 6) v from hashed group by 1, 2),
slots as (select k, i, case when far = 0 then v else {_HASH60.format("concat_ws(':', far, b, v)")} end v from (
  select x.k, s.i, l.b, l.v, (l.b - s.i + 64) % 64 far, row_number() over (partition by x.k, s.i order by (l.b - s.i + 64) % 64) r
  from (select distinct k from least_) x cross join (select cast(range as integer) i from range(0, 64)) s join least_ l on l.k = x.k) where r = 1),
signed as (select k, list(v order by i) signature from slots group by k)"""
_SHINGLED = "list_distinct(list_transform(range(1, greatest(1, len(t) - 4) + 1), lambda i: array_to_string(t[i : i + 4], ' ')))"

QUERIES = {
    "corpus_stats": (corpus_stats, "select lang, count(*) n, sum(length(text)) chars, max(length(text)) longest from documents group by lang"),
    "text_normalise": (text_normalise, r"select doc_id, sha256(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))) compact_hash, length(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t]+\n', chr(10), 'g'), '^\s+|\s+$', '', 'g')) normal_chars from documents"),
    "html_to_text": (html_to_text, r"select page_id, sha256(trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>', ' ', 'g'), '(?s)<[^>]+>', ' ', 'g'), '\s+', ' ', 'g'))) text_hash from pages"),
    "page_links": (page_links, r"select page_id, trim(regexp_replace(case when regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:') then link when link like '/%' then regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1) || link else regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') || link end, '#.*$', '')) target from (select page_id, url, unnest(regexp_extract_all(html, 'href=[" + "\"" + r"'']([^" + "\"" + r"''#]+)[" + "\"" + r"'']', 1)) link from pages) where not regexp_matches(lower(link), '^(mailto|javascript|tel):')"),
    "url_parts": (url_parts, r"select page_id, lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)) host, trim(regexp_replace(url, '#.*$', '')) url, regexp_matches(lower(regexp_extract(url, '^https?://([^/?#:]+)', 1)), '(^|\.)example\.(com|org)$') allowed from pages"),
    "token_estimates": (token_estimates, r"select doc_id, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) words, greatest(1, length(text) // 4) four_chars, len(regexp_extract_all(text, '0x[0-9a-fA-F]+|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\sA-Za-z0-9_]')) policy from documents"),
    "license_filter": (license_filter, f"with {CORPUS_SQL} select license license_name, license in ('mit', 'apache-2.0') license_ok, count(*) n from corpus group by 1, 2"),
    "line_findings": (
        line_findings,
        r"""with r as (select doc_id, text from documents union all select -1, '""" + "\n".join(_LINES).replace("'", "''") + r"""'),
        l as (select doc_id, unnest(range(1, len(x) + 1)) line, unnest(x) content from (select doc_id, string_split(text, chr(10)) x from r)),
        p as (select * from (values
          ('secret_pattern', '(?i)(api[_-]?key|secret|password|token)\s*=\s*[''"][^''"]{12,}[''"]'),
          ('ssrf_sink', '(?i)((requests|httpx)\.(get|post|put|delete)|urlopen)\s*\('),
          ('path_traversal_sink', '(?i)(open|path)\s*\([^)]*(request|args|params|user_input|filename)'),
          ('dangerous_process', '(?i)(shell\s*=\s*true|os\.system|subprocess\.(call|run|popen)\([^)]*\+)')) x(rule, pattern))
        select doc_id, line, rule, sha256(left(trim(content), 240)) evidence_hash from l, p where regexp_matches(content, pattern) and not contains(content, 'nosec') and not contains(content, 'replace-with') and not contains(content, 'pragma: allowlist secret')""",
    ),
    "text_metrics": (text_metrics, f"with {GATE_SQL} select doc_id, word_count, round(unique_word_ratio, 8) unique_word_ratio, round(alpha_ratio, 8) alpha_ratio, line_count, round(repeated_line_ratio, 8) repeated_line_ratio from g3"),
    "quality_gate": (quality_gate, f"with {GATE_SQL} select doc_id, accepted, array_to_string(reasons, ',') reasons, array_to_string(labels, ',') labels, quality_score, array_to_string(risk_flags, ',') flags from gated"),
    "quality_report": (quality_report, f"with {_UNKNOWN_OK} select source, count(*) filter (where accepted) accepted, count(*) filter (where not accepted) rejected, count(*) filter (where list_contains(reasons, 'duplicate')) duplicate, round(avg(quality_score), 6) mean_score from gated group by source"),
    "source_quality": (source_quality, f"with {GATE_SQL}, s as (select source, count(*) \"rows\", avg(quality_score) m, count(*) filter (where list_contains(labels, 'defensive_security')) security, count(*) filter (where list_contains(labels, 'code')) code from gated group by source), t as (select *, round(m + least(0.2, 0.2 * (security + code) / \"rows\"), 6) score from s) select source, \"rows\", round(m, 6) mean, security, code, score, case when score >= 0.75 then 'promote' when score >= 0.55 then 'watch' else 'demote' end status from t"),
    "label_agreement": (label_agreement, f"with {_UNKNOWN_OK} select quality, accepted, count(*) n from gated join labels using (doc_id) group by 1, 2"),
    "contam_patterns": (
        contam_patterns,
        f"with r as (select doc_id, text || chr(10) || {_list(_NAMED)}[n_chars % {len(_NAMED)} + 1] t from documents) select * from (select doc_id, coalesce(" + ", ".join(f"case when regexp_matches(t, '(?i)(^|[^A-Za-z0-9_]){p}([^A-Za-z0-9_]|$)') then '{p}' end" for p in filters.PATTERNS) + ") pattern from r) where pattern is not null",
    ),
    "contam_exact": (contam_exact, r"select doc_id, 'exact' hit from documents where trim(regexp_replace(text, '\s+', ' ', 'g')) in (select trim(regexp_replace(text, '\s+', ' ', 'g')) from benchmark) union all select -1 - item_id, 'exact' from benchmark"),
    "contam_containment": (contam_containment, f"with {_SHINGLES}, bs as (select item_id, s from ({_SHINGLES.removeprefix('sh as (').removesuffix(')').replace('doc_id', 'item_id').replace('from documents', 'from benchmark')})), n as (select item_id, count(*) n from bs group by item_id) select doc_id, item_id, round(count(*) / n, 6) share from sh join bs using (s) join n using (item_id) group by doc_id, item_id, n having count(*) >= 0.8 * n"),
    "contam_minhash_sha": (
        contam_minhash_sha,
        f"""with texts as (select 'd' || doc_id k, text from documents union all select 'dlike ' || item_id, text || ' two more words' from benchmark union all select 'b' || item_id, text from benchmark),
        shingled as (select k, unnest({_SHINGLED}) s from (select k, {_TOKENS} t from texts) where len(t) > 0), {_SIGNED},
        bands as (select k, signature, g, signature[g * 8 + 1 : g * 8 + 8] key from signed, range(0, 8) r(g)),
        pairs as (select distinct a.k a, b.k b, len(list_filter(range(1, 65), lambda i: a.signature[i] = b.signature[i])) / 64 similarity from bands a join bands b on a.g = b.g and a.key = b.key and a.k like 'd%' and b.k like 'b%'),
        best as (select *, row_number() over (partition by a order by similarity desc, b desc) r from pairs where similarity >= 0.8)
        select a[2:] doc_id, b[2:] item_id, similarity from best where r = 1""",
    ),
    "near_comparisons": (
        near_comparisons,
        f"""with {_SIMHASH}, v as (select distinct simhash from prints), blocks as (select i, 1023::bigint << (10 * i) b from range(0, 6) r(i)), ms as (select x.b | y.b | z.b mask from blocks x, blocks y, blocks z where x.i < y.i and y.i < z.i),
        k as (select mask, simhash & mask key, count(*) m from v, ms group by 1, 2)
        select (select count(*) from prints) as rows, (select count(*) from v) as values, cast(sum(m * (m - 1) // 2) as bigint) pairs, round(sum(m * (m - 1) // 2) / (select count(*) from prints), 4) a_record from k""",
    ),
    "dedup_exact": (dedup_exact, "select min(doc_id) doc_id, sha256(text) content_hash from documents group by 2"),
    "simhash_sha": (simhash_sha, f"with {_SIMHASH} select doc_id, simhash from prints"),
    "near_pairs_sha": (near_pairs_sha, f"with {_SIMHASH}, v as (select simhash, min(doc_id) rep from prints group by simhash) select least(x.rep, y.rep) a, greatest(x.rep, y.rep) b, cast(bit_count(xor(x.simhash, y.simhash)) as int) distance from v x join v y on x.simhash < y.simhash and bit_count(xor(x.simhash, y.simhash)) <= 3"),
    "near_classes_sha": (near_classes_sha, f"with {_SIMHASH}, l as (select x.doc_id, count(*) - 1 links from prints x join prints y on bit_count(xor(x.simhash, y.simhash)) <= 3 group by 1) select doc_id, min(doc_id) over (partition by simhash) class_id, links from prints join l using (doc_id)"),
    "shingle_jaccard_classes": (shingle_jaccard_classes, f"with {_SHINGLES}, st as (select doc_id, list_sort(list(s)) l from sh group by doc_id), c as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.s = b.s group by 1, 2), k as (select a doc_id, count(*) - 1 links from c join st x on x.doc_id = a join st y on y.doc_id = b where c / (len(x.l) + len(y.l) - c) >= 0.8 group by 1) select doc_id, min(doc_id) over (partition by l) class_id, links from st join k using (doc_id)"),
    "shingle_jaccard_pairs": (shingle_jaccard_pairs, f"with {_SHINGLES}, st as (select doc_id, list_sort(list(s)) l from sh group by doc_id), r as (select min(doc_id) doc_id, l from st group by l), e as (select doc_id, unnest(l) s from r), n as (select doc_id, len(l) n from r), c as (select a.doc_id a, b.doc_id b, count(*) c from e a join e b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2) select a, b, round(c / (x.n + y.n - c), 6) jaccard from c join n x on x.doc_id = a join n y on y.doc_id = b where c / (x.n + y.n - c) >= 0.8"),
    "dedup_greedy": (
        dedup_greedy,
        f"""with recursive {_SIMHASH}, d as materialized (select row_number() over (order by doc_id) rn, source, sha256(text) e, simhash v from documents join prints using (doc_id)),
        r(rn, source, outcome, kept) as (
          select 0::bigint, '', '', cast([] as struct(e varchar, v bigint)[])
          union all
          select rn, source, outcome, case when outcome = 'accepted' then list_append(kept, {{'e': e, 'v': v}}) else kept end
          from (select d.*, r.kept, case when len(list_filter(r.kept, lambda x: x.e = d.e)) > 0 then 'content_hash' when len(list_filter(r.kept, lambda x: x.v = d.v)) > 0 then 'simhash'
            when len(list_filter(r.kept, lambda x: bit_count(xor(x.v, d.v)) <= 3)) > 0 then 'near' else 'accepted' end outcome from r join d on d.rn = r.rn + 1))
        select source, outcome, count(*) n from r where rn > 0 group by 1, 2""",
    ),
    "minhash_sha": (minhash_sha, f"with shingled as (select doc_id k, unnest({_SHINGLED}) s from (select doc_id, {_TOKENS} t from documents) where len(t) > 0), {_SIGNED} select k doc_id, sha256(array_to_string(signature, ',')) as signature from signed"),
    "hash_sample": (hash_sample, f"with {CORPUS_SQL} select doc_id, source from corpus where {_U(chr(39) + 'sample' + chr(39), 'source', 'content_hash')} < 0.2"),
    "group_split": (group_split, f"with {CORPUS_SQL}, g as (select doc_id, sha256(concat_ws(':', 'content', source, content_hash)) split_group from corpus), u as (select *, {_U(chr(39) + 'split' + chr(39), 'split_group')} u from g) select doc_id, split_group, case when u < 0.98 then 'train' when u < 0.99 then 'validation' else 'test' end split from u"),
    "training_gate": (
        training_gate,
        f"""with {_GATE_UNKNOWN}, p as (select * replace (floor(quality_score * 100000 + 0.01) / 100000 as quality_score), list_has_any(risk_flags, ['navigation_or_boilerplate_noise', 'repeated_lines', 'heavy_boilerplate_noise']) noisy, len(list_intersect(labels, ['defensive_security', 'agentic_coding', 'code', 'patch', 'tests', 'runtime_trace'])) pri,
          row_number() over (partition by content_hash order by doc_id) > 1 again from gated),
        q as (select *, list_filter([case when quality_score < 0.58 then 'quality_below_training_threshold' end, case when noisy and quality_score < 0.72 then 'boilerplate_or_low_signal_noise' end, case when regexp_matches(coalesce(text, ''), '^\\s*$') then 'empty_text' end, case when again then 'duplicate_after_gate' end], lambda x: x is not null) why,
          round(least(1.0::double, greatest(0.0::double, 0.7::double * quality_score + 0.1::double + 0.1::double * least(1.0::double, pri / 3.0::double) + case when list_contains(labels, 'patch') then 0.12::double else 0 end
            + case when list_contains(labels, 'defensive_security') then 0.08::double else 0 end - case when noisy then 0.1::double else 0 end)), 6) gate_score from p)
        select doc_id, gate_score, array_to_string(why, ',') gate_reasons from q""",
    ),
    "source_balance": (source_balance, "with d as (select doc_id, case when doc_id % 3 = 0 then 'big' else source end source from documents), s as (select source, count(*) n, (select count(*) from d) c from d group by source), r as (select doc_id, source, row_number() over (partition by source order by doc_id) r from d) select doc_id, source from r join s using (source) where r <= least(n, greatest(1, floor(0.15 / 0.85 * (c - n))))"),
    "wilson_lower_bound": (wilson, "with s as (select source, sum(quality) / count(*) p, count(*) n from documents join labels using (doc_id) group by source) select source, round((p + 3.8416 / (2 * n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n), 6) lower_bound from s"),
    "trust_metrics": (
        trust_metrics,
        f"""with {_GATE_UNKNOWN}, t as (select *, len(regexp_extract_all(text, '0x[0-9a-fA-F]+|[A-Za-z_][A-Za-z0-9_]*|[0-9]+|[^\\sA-Za-z0-9_]')) tok, round(quality_score * 1000)::int bin from gated),
        b as (select bin, sum(count(*)) over (order by bin) upto, sum(count(*)) over () total from t group by bin),
        s as (select source, sum(tok) tok from t group by source)
        select count(*) as rows, cast(sum(tok) as bigint) tokens, round(avg(quality_score), 6) mean_score, (select round(max(tok) / sum(tok), 6) from s) largest_source, round(avg(case when license <> 'unknown' then 1.0 else 0.0 end), 6) license_share, (select min(bin) / 1000 from b where upto >= ceil(0.1 * total)) p10 from t""",
    ),
    "shard_pack": (shard_pack, r"with n as (select doc_id, len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) + 1 n from documents), s as (select doc_id, cast(coalesce(sum(n) over (order by doc_id rows between unbounded preceding and 1 preceding), 0) as bigint) start from n) select doc_id, start, start // 5000 shard, start % 5000 as offset, start // 512 batch, (start // 512) % 4 rank from s"),
    "deficit_mix": (
        deficit_mix,
        r"""with w as (select doc_id, lang, trim(regexp_replace(text, '\s+', ' ', 'g')) c from documents), t as (select doc_id, lang, greatest(1, case when c = '' then 0 else len(string_split(c, ' ')) end) n from w),
        m as (select doc_id, lang, coalesce(sum(n) over (partition by lang order by sha256('mix:' || doc_id), doc_id rows between unbounded preceding and 1 preceding), 0) mass from t)
        select doc_id, round(mass / case lang when 'en' then 0.5::double when 'de' then 0.3::double when 'fr' then 0.2::double end, 4) mix_at from m""",
    ),
    "source_budget": (source_budget, None),
    "mix_buckets": (mix_buckets, r"with t as (select lang bucket, greatest(1, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))) n from documents), b as (select bucket, count(*) as rows, cast(sum(n) as bigint) tokens from t group by bucket), x as (select *, round(tokens / (sum(tokens) over ()), 6) actual, case bucket when 'en' then 0.4 when 'de' then 0.3 when 'fr' then 0.2 else 0.0 end target from b) select *, actual < target scarce from x"),
    "redact_text": (redact, f"select doc_id, sha256(regexp_replace(text, '{T.SECRET.replace(chr(39), chr(39) * 2)}', '[REDACTED]', 'g')) h from documents"),
}
