"""Vulnerability feeds of five shapes as one table, from JSON held as VARIANT (S9), and every string of nested payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.dedup import stored

#: Feeds: where their records come from, under which licence, and where a record is shown. Fixed values.
FEEDS = {
    "cisa-kev": ("public-domain", "https://www.cisa.gov/sites/default/files/feeds/known_exploited_vulnerabilities.json"),
    "nvd-cve": ("public-domain", "https://nvd.nist.gov/vuln/detail/"),
    "osv": ("cc-by-4.0", "https://osv.dev/vulnerability/"),
    "go-vuln": ("bsd-3-clause", "https://pkg.go.dev/vuln/"),
    "github-advisory": ("cc-by-4.0", "https://github.com/advisories/"),
}
#: Where a feed has no records with an id: the page of the whole. Fixed value.
NVD = "https://services.nvd.nist.gov/rest/json/cves/2.0"
CATEGORY = "vulnerability_database"
#: Keys of a payload's parts that aren't read. Fixed values.
IGNORED = ("content_hash", "created_at", "created_at_unix", "license", "metadata", "revision", "sha256", "source", "url")
#: A string of fewer characters, with white space collapsed, is no payload. Fixed value.
LEAST_CHARS = 16


def _text(v: Column, path: str) -> Column:
    """A value as text; absent, null and empty are empty, and numbers and booleans their JSON."""
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "string"), F.lit(""))


def _list(v: Column, path: str) -> Column:
    """An array of variants; empty where it is absent or something else."""
    return F.coalesce(F.try_variant_get(v, f"$.{path}", "array<variant>"), F.array().cast("array<variant>"))


def _some(values: Column) -> Column:
    return F.filter(values, lambda x: x != "")


def _joined(*parts: Column) -> Column:
    """The parts without white space around them, one a line; what is blank is left out."""
    bare = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.array_join(_some(F.array(*[bare(p) for p in parts])), "\n")


def _or(a: Column, b: Column) -> Column:
    return F.when(a != "", a).otherwise(b)


def _five(values: Column) -> Column:
    return F.array_join(F.slice(values, 1, 5), " ")


def _kev(v: Column) -> dict[str, Column]:
    t = lambda p: _text(v, p)
    id = _or(t("cveID"), t("cveId"))
    summary, details = _joined(t("vendorProject"), t("product"), t("vulnerabilityName")), _joined(t("shortDescription"), t("requiredAction"), t("notes"))
    url = F.lit(FEEDS["cisa-kev"][1])
    return {"id": id, "summary": _or(summary, id), "details": details, "affected": F.array(t("vendorProject"), t("product")), "references": F.array(url), "cwes": F.array().cast("array<string>"), "severity": F.lit("known_exploited"), "published": t("dateAdded"), "modified": t("dueDate"), "url": url, "text": _joined(id, summary, details, t("knownRansomwareCampaignUse"))}


def _nvd(v: Column) -> dict[str, Column]:
    id = _text(v, "cve.id")
    english = F.filter(_list(v, "cve.descriptions"), lambda d: _text(d, "lang") == "en")
    summary = F.coalesce(_text(F.get(english, 0), "value"), id)
    summary = F.when(F.size(english) > 0, summary).otherwise(id)
    cwes = _some(F.flatten(F.transform(_list(v, "cve.weaknesses"), lambda w: F.transform(_list(w, "description"), lambda d: _text(d, "value")))))
    references = _some(F.transform(_list(v, "cve.references.referenceData"), lambda r: _text(r, "url")))
    severity = F.lit("")
    for key in ("cvssMetricV2", "cvssMetricV30", "cvssMetricV31"):  # the last that is there decides
        metric = F.get(_list(v, f"cve.metrics.{key}"), 0)
        severity = F.when(metric.isNotNull(), _or(_text(metric, "cvssData.baseSeverity"), _text(metric, "baseSeverity"))).otherwise(severity)
    return {"id": id, "summary": F.left(summary, F.lit(500)), "details": summary, "affected": F.array().cast("array<string>"), "references": references, "cwes": cwes, "severity": severity, "published": _text(v, "cve.published"), "modified": _text(v, "cve.lastModified"), "url": F.when(id != "", F.concat(F.lit(FEEDS["nvd-cve"][1]), id)).otherwise(NVD), "text": _joined(id, summary, F.array_join(cwes, " "), _five(references))}


def _osv(v: Column, feed: str) -> dict[str, Column]:
    id = _text(v, "id")
    affected = _some(F.transform(_list(v, "affected"), lambda a: _text(a, "package.name")))
    cwes = F.filter(F.transform(_list(v, "aliases"), lambda a: F.coalesce(F.try_variant_get(a, "$", "string"), F.lit(""))), lambda a: F.upper(a).startswith("CWE-"))
    references = _some(F.transform(_list(v, "references"), lambda r: _text(r, "url")))
    summary = _or(_text(v, "summary"), id)
    details = _or(_text(v, "details"), summary)
    shown = F.concat(F.lit(FEEDS[feed][1]), id)
    return {"id": id, "summary": F.left(summary, F.lit(500)), "details": details, "affected": affected, "references": references, "cwes": cwes, "severity": F.lit(""), "published": _text(v, "published"), "modified": _text(v, "modified"), "url": F.when(id != "", shown), "text": _joined(id, summary, details, F.array_join(affected, " "), _five(references))}


def _github(v: Column) -> dict[str, Column]:
    id = _text(v, "ghsaId")
    cwes = _some(F.transform(_list(v, "cwes.nodes"), lambda n: _text(n, "cweId")))
    named = F.filter(_list(v, "vulnerabilities.nodes"), lambda n: _text(n, "package.name") != "")
    affected = F.transform(named, lambda n: F.concat(F.coalesce(F.try_variant_get(n, "$.package.ecosystem", "string"), F.lit("None")), F.lit(":"), _text(n, "package.name")))
    references = _some(F.transform(_list(v, "references"), lambda r: _text(r, "url")))
    summary = _or(_text(v, "summary"), id)
    details = _or(_text(v, "description"), summary)
    return {"id": id, "summary": F.left(summary, F.lit(500)), "details": details, "affected": affected, "references": references, "cwes": cwes, "severity": _text(v, "severity"), "published": _text(v, "publishedAt"), "modified": _text(v, "updatedAt"), "url": F.when(id != "", F.concat(F.lit(FEEDS["github-advisory"][1]), id)), "text": _joined(id, summary, details, F.array_join(cwes, " "), F.array_join(affected, " "))}


#: Per feed where a payload lists its records (None: it is a record), and how one is read.
_SHAPES = {
    "cisa-kev": ("vulnerabilities", _kev),
    "nvd-cve": ("vulnerabilities", _nvd),
    "osv": (None, lambda v: _osv(v, "osv")),
    "go-vuln": (None, lambda v: _osv(v, "go-vuln")),
    "github-advisory": ("data.securityAdvisories.nodes", _github),
}


def normalized(payloads: DataFrame, feed: str, payload: str = "payload") -> DataFrame:
    """The records of a feed's payloads (JSON texts) in one schema, with other columns kept.

    vulnerability_id, summary, details, affected, references, cwe_ids, severity, published, modified, license, category, url, raw,
    content_hash, text. Payloads that don't parse, and those without a list of records, give no rows.
    """
    listed, read = _SHAPES[feed]
    rows = payloads.withColumn("_v", F.try_parse_json(payload)).drop(payload)
    if listed:
        rows = rows.withColumn("_v", F.explode(_list(F.col("_v"), listed)))
    found = read(F.col("_v"))
    null = lambda c: F.nullif(c, F.lit(""))
    return rows.where(F.col("_v").isNotNull()).withColumns({
        "feed": F.lit(feed), "vulnerability_id": found["id"], "summary": found["summary"], "details": found["details"], "affected": found["affected"], "references": found["references"],
        "cwe_ids": found["cwes"], "severity": null(found["severity"]), "published": null(found["published"]), "modified": null(found["modified"]), "license": F.lit(FEEDS[feed][0]), "category": F.lit(CATEGORY),
        "url": found["url"], "raw": F.to_json("_v"), "content_hash": F.sha2(found["text"], 256), "text": found["text"],
    }).drop("_v")


def every_record(payloads: DataFrame, feed: str = "feed", payload: str = "payload") -> DataFrame:
    """``normalized`` for a table of payloads of all feeds, told apart by the column ``feed``."""
    out = None
    for name in FEEDS:
        part = normalized(payloads.where(F.col(feed) == name).drop(feed), name, payload)
        out = part if out is None else out.unionByName(part)
    return out


def protected_texts(rows: DataFrame, id: str, payload: str = "payload") -> DataFrame:
    """(id, text): every string of at least 16 characters in JSON payloads of any depth, once for each collapsed text.

    Parts under the ignored keys are not read; what stands in an array has the array's key. A level of nesting is one round:
    objects and arrays are exploded, strings are kept, until nothing nested is left, so rounds are as many as the deepest
    payload has levels, and wide payloads are many rows.
    """
    left = rows.select(id, F.lit("").alias("key"), F.try_parse_json(payload).alias("v")).where("v is not null")
    texts, out = None, None
    while True:
        left = stored(left.where(~F.lower("key").isin(*IGNORED)).withColumn("kind", F.schema_of_variant("v")))
        texts = left.where("kind = 'STRING'").select(id, F.variant_get("v", "$", "string").alias("text"))
        out = texts if out is None else out.union(texts)
        nested = left.where("kind like 'ARRAY<%' or kind like 'OBJECT<%'")
        if nested.limit(1).count() == 0:
            break
        lists = nested.where("kind like 'ARRAY<%'").select(id, "key", F.explode(F.variant_get("v", "$", "array<variant>")).alias("v"))
        maps = nested.where("kind like 'OBJECT<%'").select(id, F.explode(F.variant_get("v", "$", "map<string, variant>")).alias("key", "v"))
        left = lists.unionByName(maps)
    compact = F.trim(F.regexp_replace("text", r"(?U)\s+", " "))
    kept = out.withColumn("_h", F.sha2(compact, 256)).where(F.length(compact) >= LEAST_CHARS)
    return kept.groupBy(id, "_h").agg(F.min("text").alias("text")).drop("_h")
