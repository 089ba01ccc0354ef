"""Queries of structure: token shards, structure and lineage, feeds, payloads, chunks, graphs and samples, with their SQL."""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import chunks, curation, dedup, graphs, lineage, pairs, retrieval, sampling
from ..operators.dedup import stored
from ..sources import advisories, token_shards
from ..sources.tables import table
from .corpus import _SIMHASH


def _sql_list(values: tuple[str, ...]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


SHARD = 50_000


#: Words whose ids a task remembers, and those of one text more.
MEMO = 200_000


def _word_ids(docs: DataFrame) -> DataFrame:
    """(doc_id, ids): the first 32 bits of the sha-256 of each of a text's words between blanks, and 0 behind; a word is hashed once a task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            flat, sizes = array("q"), [0]
            for text in batch.column(1):
                words = [w for w in (text.as_py() or "").split(" ") if w]
                if len(known) >= MEMO:
                    known.clear()
                for w in [w for w in set(words) if w not in known]:
                    known[w] = int.from_bytes(hashlib.sha256(w.encode()).digest()[:4], "big")
                flat.extend(map(known.__getitem__, words))
                flat.append(0)
                sizes.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(np.frombuffer(flat, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<long>")


def shard_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Per shard its ids' number and hash, after all documents' ids were written as shards and read back."""
    docs = stored(_word_ids(table(spark, folder, "documents")))
    placed = docs.join(curation.shards(docs, SHARD, None, ids="ids").select("doc_id", "start"), "doc_id")
    there = posixpath.join(dedup.checkpoint_dir(spark), f"shards-{uuid.uuid4().hex}")
    token_shards.write(placed, there, SHARD)
    return token_shards.digests(token_shards.read(spark, there)).select("shard", "tokens", "ids_sha256")


#: Stand-ins for languages of code, so that documents take all branches.
HINTS = {"en": "Go", "fr": "java", "de": "rust", "es": "typescript"}


def _hinted(spark: SparkSession, folder: str) -> DataFrame:
    hint = F.try_element_at(F.create_map(*[F.lit(x) for kv in HINTS.items() for x in kv]), F.col("lang"))
    return table(spark, folder, "documents").withColumn("hint", hint)


def structure_hash_tokens(spark: SparkSession, folder: str) -> DataFrame:
    docs = _hinted(spark, folder)
    return docs.select("doc_id", lineage.structure_hash(F.col("text"), F.col("hint")).alias("structure_hash"))


def _lineage() -> dict[str, Column]:
    """What a document was made from: its first line, unless that is all of it; its source is the revision."""
    return {"generated_from": F.when(F.contains("text", F.lit("\n")), F.substring_index("text", "\n", 1)), "source_revision": F.col("source"), "task_signature": F.when(F.col("text").startswith("#"), F.col("lang"))}


def lineage_hash(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", lineage.lineage_hash(**_lineage()).alias("lineage_hash"))


def dedup_greedy_report(spark: SparkSession, folder: str) -> DataFrame:
    docs = _hinted(spark, folder)
    keys = docs.select("doc_id", "source", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), lineage.token_structure(F.col("text"), F.lower("hint")).alias("structure_hash"), lineage.lineage_hash(**_lineage()).alias("lineage_hash"))
    return lineage.report(lineage.deduplicated(dedup.stored(keys.join(dedup.simhash(docs), "doc_id"))))


def _obj(**fields: Column | str | None) -> Column:
    """A JSON object's struct; texts stand for themselves, None for a null that isn't written."""
    return F.struct(*[(F.lit(v) if isinstance(v, str) else F.lit(None).cast("string") if v is None else v).alias(k) for k, v in fields.items()])


def _payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Each document as a record of one of the five feeds."""
    docs = table(spark, folder, "documents")
    id = F.col("doc_id").cast("string")
    text, lang, source = F.col("text"), F.col("lang"), F.col("source")
    links = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: _obj(url=F.concat(F.lit("https://e.org/"), id, F.lit("/"), i.cast("string"))))
    cwe = F.concat(F.lit("CWE-"), (F.col("n_chars") % 100).cast("string"))
    first = _obj(cveID=F.concat(F.lit("CVE-"), id), cveId=None, vendorProject=source, product=lang, shortDescription=text, notes=None)
    second = _obj(cveID=None, cveId=F.concat(F.lit("ALT-"), id), vendorProject=F.lit("").cast("string"), product=F.lit(None).cast("string"), shortDescription=F.lit(None).cast("string"), notes=None)
    kev = _obj(vulnerabilities=F.array(first, second))
    new = F.when(F.length("text") % 2 == 0, F.array(_obj(cvssData=_obj(baseSeverity="HIGH"))))
    cve = _obj(id=F.concat(F.lit("CVE-"), id), descriptions=F.array(_obj(lang="es", value=F.lit("no")), _obj(lang="en", value=text)), weaknesses=F.array(_obj(description=F.array(_obj(value=cwe)))), references=_obj(referenceData=links), metrics=_obj(cvssMetricV2=F.array(_obj(baseSeverity="LOW")), cvssMetricV31=new))
    nvd = _obj(vulnerabilities=F.array(_obj(cve=cve)))
    osv = _obj(id=F.concat(F.lit("OSV-"), id), summary=source, details=text, affected=F.array(_obj(package=_obj(name=lang)), _obj(package=_obj(name=None))), aliases=F.array(cwe, F.lit("CVE-1")), references=links)
    go = _obj(id=F.concat(F.lit("GO-"), id), details=text, modified="2024-01-01")
    node = _obj(ghsaId=F.concat(F.lit("GHSA-"), id), summary=text, severity="LOW", references=links, cwes=_obj(nodes=F.array(_obj(cweId=cwe))), vulnerabilities=_obj(nodes=F.array(_obj(package=_obj(name=source, ecosystem=lang)))))
    shapes = [F.to_json(kev), F.to_json(nvd), F.to_json(osv), F.to_json(go), F.to_json(_obj(data=_obj(securityAdvisories=_obj(nodes=F.array(node)))))]
    which = F.pmod("doc_id", F.lit(len(shapes))).cast("int")
    payload = shapes[-1]
    for i, x in enumerate(shapes[:-1]):
        payload = F.when(which == i, x).otherwise(payload)
    return docs.select("doc_id", F.get(F.array(*[F.lit(f) for f in advisories.FEEDS]), which).alias("feed"), payload.alias("payload"))


def vulnerability_records(spark: SparkSession, folder: str) -> DataFrame:
    rows = advisories.every_record(_payloads(spark, folder))
    joined = lambda c: F.array_join(c, "|").alias(c)
    return rows.select("doc_id", "feed", "vulnerability_id", F.sha2("summary", 256).alias("summary_hash"), joined("affected"), F.size("references").alias("n_references"), joined("cwe_ids"), "severity", "modified", "license", "url", "content_hash")


def protected_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """The protected strings of documents that are wrapped in nested payloads."""
    docs = table(spark, folder, "documents")
    tests = F.array(F.col("lang"), F.substring_index("text", "\n", 1), F.concat(F.lit(" "), "text", F.lit("\n\n")))
    inner = _obj(prompt=F.col("text"), tests=tests, Source=F.repeat("source", F.lit(9)), steps=F.array(_obj(code=F.repeat("source", F.lit(5)), url=F.repeat("lang", F.lit(20)))))
    payload = F.to_json(_obj(task_id=F.col("source"), body=inner, metadata=_obj(note=F.reverse("text"))))
    found = advisories.protected_texts(docs.select("doc_id", payload.alias("payload")), "doc_id")
    return found.select("doc_id", F.sha2(F.trim(F.regexp_replace("text", r"\s+", " ")), 256).alias("text_hash"))


_CODE_FILE = 'import m_%s.n_%s\n\n\n@d_%s\ndef f_%s(x):\n    """%s"""\n    y = g_%s.h(x)\n    return y\n\n\nclass C_%s(B):\n    pass\n'
_IMPORT_FILE = "import a from 'js_%s'\nconst b = require('cjs_%s')\nimport \"go_%s\"\n  use rust_%s::x;\nimport java_%s.y;\n#include <c_%s.h>\nsource ./%s.sh\n"


def _files(spark: SparkSession, folder: str) -> DataFrame:
    """Documents in English as small Python files made of their words, others as they are."""
    w = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[a-z]+"), F.lit(0))
    code = F.format_string(_CODE_FILE, *[F.coalesce(F.get(w, F.lit(i)), F.lit("none")) for i in range(7)])
    docs = table(spark, folder, "documents").where("text is not null")
    return docs.select("doc_id", F.when(F.col("lang") == "en", "python").otherwise("go").alias("language"), F.when(F.col("lang") == "en", code).otherwise(F.col("text")).alias("text"))


def symbol_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = chunks.symbols(_files(spark, folder).where("language = 'python'"))
    join = lambda c: F.array_join(c, ",").alias(c)
    return found.select("doc_id", "symbol_name", "kind", "start_line", "end_line", F.sha2("content", 256).alias("content_hash"), "signature", join("imports"), join("calls"), join("state_mutations"), join("decorators"), "docstring")


def bounded_chunks(spark: SparkSession, folder: str) -> DataFrame:
    found = chunks.chunked(_files(spark, folder))
    return found.select("doc_id", "symbol_name", "kind", F.coalesce("part", F.lit(-1)).alias("part"), "start_line", "end_line", F.sha2("content", 256).alias("content_hash"))


def imported_names(spark: SparkSession, folder: str) -> DataFrame:
    """Imports of documents that are given lines of each language in front."""
    names = F.array(*[F.lit(x) for x in chunks.IMPORTS])
    text = F.concat(F.format_string(_IMPORT_FILE, *[F.col("source")] * 7), F.coalesce("text", F.lit("")))
    docs = table(spark, folder, "documents").select("doc_id", F.get(names, F.pmod("doc_id", F.lit(len(chunks.IMPORTS))).cast("int")).alias("language"), text.alias("text"))
    return docs.select("doc_id", "language", F.array_join(chunks.imports(F.col("language"), F.col("text")), "|").alias("imports"), chunks.symbol_line(F.col("text")).alias("signature"))


def _nav(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with the names of the places they link to, the first of which stands for the page."""
    names = F.transform(F.regexp_extract_all("html", F.lit('href="/([^"/]+)"'), F.lit(1)), F.lower)
    return table(spark, folder, "pages").select("page_id", "url", "html", F.coalesce(names, F.array().cast("array<string>")).alias("names")).withColumn("topic", F.get("names", F.lit(0)))


def _links(spark: SparkSession, folder: str) -> DataFrame:
    return _nav(spark, folder).select(F.col("topic").alias("src"), F.explode(F.slice("names", 2, 100_000)).alias("dst")).distinct()


def link_cycles(spark: SparkSession, folder: str) -> DataFrame:
    return graphs.cycles(_links(spark, folder), longest=4).select(F.array_join("cycle", ">").alias("cycle"), "length")


def crawl_frontier(spark: SparkSession, folder: str) -> DataFrame:
    """A crawl from the pages of secure addresses; names that no page stands for can't be fetched."""
    nav = _nav(spark, folder).where("topic is not null")
    links = _links(spark, folder).select(F.col("src").alias("url"), F.col("dst").alias("target"))
    seeds = nav.where("url like 'https:%'").select(F.col("topic").alias("url"), F.lit("seed").alias("source"))
    return graphs.crawl(seeds, links, nav.select(F.col("topic").alias("url"), F.lit(0).alias("failures")), max_depth=3).select("url", "source", "status", "depth", "priority", "attempts", "discovered_from")


#: The first finds of a search, which graph_candidates starts from.
SEEDS = 20


def graph_candidates(spark: SparkSession, folder: str) -> DataFrame:
    """For each benchmark item the pages that the link graph adds to the pages whose titles are like it."""
    nav = stored(_nav(spark, folder).select("page_id", F.lower("url").alias("path"), "topic", "names", F.regexp_extract("html", "<title>([^<]*)", 1).alias("text")))
    only = nav.where("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("to")).where("n = 1")
    calls = nav.select("page_id", F.explode(F.array_distinct("names")).alias("topic")).join(only, "topic").where("page_id <> to").select("page_id", "to")
    related = calls.union(calls.select("to", "page_id")).groupBy("page_id").agg(F.collect_set("to").alias("related"))  # as many as a page has links, and pages that name it
    chunks_ = nav.join(related, "page_id", "left").select(F.col("page_id").alias("id"), "path", F.col("topic").alias("symbol"), F.col("names").alias("dependencies"), "related")
    items = table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    near = retrieval.bag_cosine(items, nav.select("page_id", "text"), "query_id", "page_id", most=SEEDS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("cosine"), "page_id"))
    seeds = near.withColumn("r", rank).where(F.col("r") <= SEEDS).select("query_id", F.col("page_id").alias("id"))
    terms = retrieval.terms(items, "query_id", "text").select("query_id", "term")
    return graphs.graph_candidates(chunks_, seeds, terms)


def review_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Documents to review: all that are labelled toxic, and a share of the others."""
    toxic = table(spark, folder, "labels").where("toxic = 1").select("doc_id", F.lit(True).alias("high")).distinct()
    docs = table(spark, folder, "documents").select("doc_id", "source").join(toxic, "doc_id", "left")
    return sampling.review_sample(docs, "high", least=60, fraction=0.05).select("doc_id", F.coalesce("high", F.lit(False)).alias("high"))


def source_quota_sample(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    quotas = docs.groupBy("source").agg(F.ceil(F.count(F.lit(1)) * 0.1).alias("quota"))
    return sampling.quota_sample(docs, quotas, "source", "doc_id", seed="quota")


def _pair_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as chunks: the source is the path, the first word the symbol, the first line the description; each calls the document after it."""
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("path"), F.col("lang").alias("language"), F.regexp_extract("text", r"[A-Za-z]+", 0).alias("symbol"), F.lit("").alias("signature"), F.substring_index("text", "\n", 1).alias("docstring"), "text", F.lit(1).alias("start_line"))
    return docs.withColumn("calls", F.array(F.struct((F.col("id") + 1).alias("id"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("call"))))


def embedding_pairs(spark: SparkSession, folder: str) -> DataFrame:
    chunks_ = _pair_chunks(spark, folder)
    made = stored(pairs.code_pairs(chunks_, "rev1").select("pair_id", "category", "query", "lineage", "chunk_id", "path", "language"))
    lists = pairs.hard_negatives(made, chunks_)
    return made.join(lists, "pair_id").select("pair_id", "category", F.sha2("query", 256).alias("query_hash"), "chunk_id", F.array_join(F.col("negatives").cast("array<string>"), ",").alias("negatives"))


def _vector_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Each vector with the one of the next id."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    return v.select(F.col("vec_id").alias("id"), F.col("embedding").alias("query")).join(v.select((F.col("vec_id") - 1).alias("id"), F.col("embedding").alias("positive")), "id")


def retrieval_collapse(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.collapse(_vector_pairs(spark, folder))


def positive_ranks(spark: SparkSession, folder: str) -> DataFrame:
    """Ranks for the queries whose id is divisible by 100, among the positives of all."""
    both = _vector_pairs(spark, folder)
    return pairs.positive_ranks(both.where("id % 100 = 0").select("id", "query"), both.select("id", "positive"))


_HINT_SQL = "case lang " + " ".join(f"when '{k}' then '{v.lower()}'" for k, v in HINTS.items()) + " end"
_CODE = rf"regexp_extract_all(regexp_replace(coalesce(text, ''), '(?ms){lineage.COMMENT}', ' ', 'g'), '{lineage.CODE_TOKEN}')"
_STRUCTURE = f"case when {_HINT_SQL} is not null and len({_CODE}) >= 8 then sha256({_HINT_SQL} || '-tokens:' || array_to_string({_CODE}, ' ')) end"
_ESCAPED = r"""(select '"' || coalesce(string_agg(case when u > 65535 then '\u' || lower(printf('%04X', 55296 + (u - 65536) // 1024)) || '\u' || lower(printf('%04X', 56320 + (u - 65536) % 1024))
  when c = '"' then '\"' when c = '\' then '\\' when u = 10 then '\n' when u = 13 then '\r' when u = 9 then '\t' when u < 32 or u > 126 then '\u' || lower(printf('%04X', u)) else c end, '' order by i), '') || '"'
  from (select c, unicode(c) u, i from (select unnest(string_split({0}, '')) c, unnest(range(length({0}))) i)))"""
_FIRST = "nullif(case when contains(text, chr(10)) then split_part(text, chr(10), 1) end, '')"
_TASK = "nullif(case when starts_with(text, '#') then lang end, '')"
_LINEAGE = f"""case when coalesce({_FIRST}, {_TASK}) is not null then sha256('{{' || concat_ws(',', case when {_FIRST} is not null then '"generated_from":' || {_ESCAPED.format(_FIRST)} end,
  case when nullif(source, '') is not null then '"source_revision":' || {_ESCAPED.format('source')} end, case when {_TASK} is not null then '"task_signature":' || {_ESCAPED.format(_TASK)} end) || '}}') end"""
_BAND = "(x.v & 32767 = d.v & 32767 or (x.v >> 15) & 32767 = (d.v >> 15) & 32767 or (x.v >> 30) & 32767 = (d.v >> 30) & 32767 or (x.v >> 45) = (d.v >> 45))"
_GREEDY = f"""with recursive {_SIMHASH},
  d0 as (select row_number() over (order by doc_id) rn, source, sha256(coalesce(text, '')) e, {_STRUCTURE} s, {_LINEAGE} l, simhash v from documents join prints using (doc_id)),
  d as materialized (select * from d0),
  r(rn, source, outcome, compared, kept) as (
    select 0::bigint, '', '', 0::bigint, cast([] as struct(e varchar, s varchar, l varchar, v bigint)[])
    union all
    select rn, source, outcome, case when outcome in ('accepted', 'near_duplicates') then near else 0 end,
      case when outcome = 'accepted' then list_append(kept, {{'e': e, 's': s, 'l': l, 'v': v}}) else kept end
    from (select d.*, r.kept, cast(len(list_filter(r.kept, lambda x: {_BAND})) as bigint) near,
      case when len(list_filter(r.kept, lambda x: x.e = d.e)) > 0 then 'exact_duplicates' when len(list_filter(r.kept, lambda x: x.s = d.s)) > 0 then 'structural_duplicates'
        when len(list_filter(r.kept, lambda x: x.l = d.l)) > 0 then 'lineage_duplicates' when len(list_filter(r.kept, lambda x: bit_count(xor(x.v, d.v)) <= 3)) > 0 then 'near_duplicates' else 'accepted' end outcome
      from r join d on d.rn = r.rn + 1))
select source, count(*) filter (where outcome = 'accepted') accepted, """ + ", ".join(f"count(*) filter (where outcome = '{x}') {x}" for x in lineage.OUTCOMES.values()) + """, cast(sum(compared) as bigint) comparisons from r where rn > 0 group by source"""

_BARE = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"
_FEEDS_SQL = rf"""with d as (select doc_id, doc_id % 5 f, {_BARE.format("text")} bare, text, lang, source, 'CWE-' || (n_chars % 100) cwe, list_transform(range(5), lambda i: 'https://e.org/' || doc_id || '/' || i) u from documents),
r as (
  select doc_id, 'cisa-kev' feed, 'CVE-' || doc_id id, source || chr(10) || lang summary, source || '|' || lang affected, 1 n, '' cwes, 'known_exploited' severity, null modified, 'public-domain' license, '{advisories.FEEDS["cisa-kev"][1]}' url, concat_ws(chr(10), 'CVE-' || doc_id, source, lang, nullif(bare, '')) t from d where f = 0
  union all select doc_id, 'cisa-kev', 'ALT-' || doc_id, 'ALT-' || doc_id, '|', 1, '', 'known_exploited', null, 'public-domain', '{advisories.FEEDS["cisa-kev"][1]}', 'ALT-' || doc_id from d where f = 0
  union all select doc_id, 'nvd-cve', 'CVE-' || doc_id, left(text, 500), '', 7, cwe, case when length(text) % 2 = 0 then 'HIGH' else 'LOW' end, null, 'public-domain', '{advisories.FEEDS["nvd-cve"][1]}CVE-' || doc_id, concat_ws(chr(10), 'CVE-' || doc_id, nullif(bare, ''), cwe, array_to_string(u, ' ')) from d where f = 1
  union all select doc_id, 'osv', 'OSV-' || doc_id, source, lang, 7, cwe, null, null, 'cc-by-4.0', '{advisories.FEEDS["osv"][1]}OSV-' || doc_id, concat_ws(chr(10), 'OSV-' || doc_id, source, nullif(bare, ''), lang, array_to_string(u, ' ')) from d where f = 2
  union all select doc_id, 'go-vuln', 'GO-' || doc_id, 'GO-' || doc_id, '', 0, '', null, '2024-01-01', 'bsd-3-clause', '{advisories.FEEDS["go-vuln"][1]}GO-' || doc_id, concat_ws(chr(10), 'GO-' || doc_id, 'GO-' || doc_id, nullif(bare, '')) from d where f = 3
  union all select doc_id, 'github-advisory', 'GHSA-' || doc_id, left(text, 500), lang || ':' || source, 7, cwe, 'LOW', null, 'cc-by-4.0', '{advisories.FEEDS["github-advisory"][1]}GHSA-' || doc_id, concat_ws(chr(10), 'GHSA-' || doc_id, nullif(bare, ''), nullif(bare, ''), cwe, lang || ':' || source) from d where f = 4)
select doc_id, feed, id vulnerability_id, sha256(summary) summary_hash, affected, n n_references, cwes cwe_ids, severity, modified, license, url, sha256(t) content_hash from r"""
_PAYLOAD_SQL = r"""with s as (select doc_id, unnest([text, split_part(text, chr(10), 1), lang, source, repeat(source, 5)]) t from documents), c as (select doc_id, trim(regexp_replace(t, '\s+', ' ', 'g')) t from s)
select distinct doc_id, sha256(t) text_hash from c where length(t) >= 16"""
_FILES_SQL = r"""w as (select doc_id, lang, text, list_transform(range(1, 8), lambda i: coalesce(regexp_extract_all(text, '[a-z]+')[i], 'none')) w from documents where text is not null),
python as (select doc_id, w, 'def f_' || w[4] || '(x):' || chr(10) || '    QQQ' || w[5] || 'QQQ' || chr(10) || '    y = g_' || w[6] || '.h(x)' || chr(10) || '    return y' f, 'class C_' || w[7] || '(B):' || chr(10) || '    pass' c from w where lang = 'en')""".replace("QQQ", '"""')
_SYMBOLS_SQL = f"""with {_FILES_SQL}
select doc_id, 'f_' || w[4] symbol_name, 'function' kind, 5 start_line, 8 end_line, sha256(f) content_hash, 'def f_' || w[4] || '(x)' signature, 'm_' || w[1] || '.n_' || w[2] imports, 'g_' || w[6] || '.h' calls, 'y' state_mutations, 'd_' || w[3] decorators, w[5] docstring from python
union all select doc_id, 'C_' || w[7], 'class', 11, 12, sha256(c), 'class C_' || w[7] || '(B)', 'm_' || w[1] || '.n_' || w[2], '', '', '', '' from python"""
_BOUNDED_SQL = rf"""with recursive {_FILES_SQL},
lines as (select doc_id, string_split(regexp_replace(text, '\n$', ''), chr(10)) l from w where lang is distinct from 'en' and text <> ''),
wins as (select doc_id, i, array_to_string(l[i * 120 + 1 : i * 120 + 120], chr(10)) c, i * 120 + 1 s, least((i + 1) * 120, len(l)) e from (select doc_id, l, unnest(range((len(l) + 119) // 120)) i from lines)),
every as (select doc_id, 'f_' || w[4] name, 'function' kind, 5 s, 8 e, f c from python union all select doc_id, 'C_' || w[7], 'class', 11, 12, c from python
  union all select doc_id, nullif(regexp_extract(c, '(?m){chunks.SYMBOL}', 1), ''), case when i = 0 then 'module' else 'chunk' end, s, e, c from wins),
parts(doc_id, name, kind, s, e, c, part, st, en) as (
  select doc_id, name, kind, s, e, c, -1, 0::bigint, 0::bigint from every where length(c) // 4 > 512
  union all
  select doc_id, name, kind, s, e, c, part + 1, st, case when length(c) <= st + 2048 then length(c) when strpos(reverse(seg), chr(10)) > 0 and length(seg) - strpos(reverse(seg), chr(10)) > 0 then st + length(seg) - strpos(reverse(seg), chr(10)) else st + 2048 end
  from (select doc_id, name, kind, s, e, c, part, st, substr(c, st + 1, 2048) seg from (select * exclude (st, en), case when part < 0 then 0 else greatest(st + 1, en - 256) end st, en from parts where part < 0 or en < length(c)))),
told as (select doc_id, name, kind || '_part' kind, part, s + (length(substr(c, 1, st)) - length(replace(substr(c, 1, st), chr(10), ''))) a, e, substr(c, st + 1, en - st) seg from parts where part >= 0)
select doc_id, name symbol_name, kind, -1 part, s start_line, e end_line, sha256(c) content_hash from every where length(c) // 4 <= 512
union all select doc_id, name, kind, part, a, least(e, a + length(seg) - length(replace(seg, chr(10), ''))), sha256(seg) from told"""
_JS = "'cjs_' || source || '|js_' || source"
_IMPORTS_SQL = rf"""select doc_id, k as language, case k when 'javascript' then {_JS} when 'typescript' then {_JS} when 'go' then 'go_' || source when 'rust' then 'rust_' || source || '::x'
  when 'java' then 'a from ''js_' || source || '''' || chr(10) || 'const b = require(''cjs_' || source || ''')' || chr(10) || 'import "go_' || source || '"' || chr(10) || '  use rust_' || source || '::x|java_' || source || '.y'
  when 'bash' then './' || source || '.sh' else 'c_' || source || '.h' end imports,
  regexp_replace(coalesce(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{chunks.SYMBOL}'))[1], ''), '^\s+|\s+$', '', 'g') signature
from (select *, [{_sql_list(tuple(chunks.IMPORTS))}][doc_id % 8 + 1] k from documents)"""

_NAV = """nav as (select page_id, lower(url) path, url, list_transform(regexp_extract_all(html, 'href="/([^"/]+)"', 1), lambda x: lower(x)) names, regexp_extract(html, '<title>([^<]*)', 1) title from pages),
links as (select distinct names[1] src, unnest(names[2:]) dst from nav)"""
_CYCLES = f"""with recursive {_NAV},
walk(a, p, z) as (select src, [src], src from links union all select a, list_append(p, dst), dst from walk join links on src = z where len(p) < 4 and dst > a and not list_contains(p, dst)),
closed as (select p from walk join links on src = z and dst = a),
turned as (select p, list_concat(p[1:1], list_reverse(p[2:])) q from closed)
select distinct array_to_string(least(p, q), '>') as cycle, len(p) length from turned"""
_CRAWL = f"""with recursive {_NAV},
topics as (select distinct names[1] t from nav where len(names) > 0),
bfs(url, depth) as (select distinct names[1], 0 from nav where len(names) > 0 and url like 'https:%' union select dst, depth + 1 from bfs join links on src = bfs.url where depth < 3),
least_ as (select url, min(depth) depth from bfs group by 1),
parents as (select l.url, min(p.url) parent from least_ l join least_ p on p.depth = l.depth - 1 join links on src = p.url and dst = l.url group by 1)
select l.url, 'seed' source, case when t is null then 'failed' else 'done' end status, depth, 100 + 10 * depth priority, case when t is null then 3 else 1 end attempts, parent discovered_from from least_ l left join topics on t = l.url left join parents using (url)"""
_TERMS_SQL = "select {0}, t term, count(*) tf from (select {0}, unnest(regexp_extract_all(lower({1}), '[A-Za-z_][A-Za-z0-9_]+')) t from {2}) group by all"
_GRAPH = f"""with {_NAV},
qt as ({_TERMS_SQL.format('item_id', 'text', 'benchmark')}), pt as ({_TERMS_SQL.format('page_id', 'title', 'nav')}),
cosine as (select item_id, page_id, round(sum(q.tf * p.tf) / (any_value(qs) * any_value(ps)), 6) c from qt q join pt p using (term) join (select item_id, sqrt(sum(tf * tf)) qs from qt group by 1) using (item_id) join (select page_id, sqrt(sum(tf * tf)) ps from pt group by 1) using (page_id) group by 1, 2),
seeds as (select item_id, page_id from (select *, row_number() over (partition by item_id order by c desc, page_id) r from cosine) where r <= 20),
one as (select names[1] t, min(page_id) p from nav where len(names) > 0 group by 1 having count(*) = 1),
calls as (select distinct page_id, p from (select page_id, unnest(names) t from nav) join one using (t) where page_id <> p),
rel as (select page_id, p from calls union select p, page_id from calls),
dep as (select distinct page_id, unnest(names) n from nav),
seedinfo as (select item_id, s.page_id, path, names[1] sym from seeds s join nav using (page_id)),
links_ as (select item_id, d.page_id, count(distinct n) k from dep d join seedinfo s on d.n = s.sym or contains(s.path, d.n) group by 1, 2),
asked as (select item_id, page_id, count(distinct term) k from dep join qt on contains(n, term) group by 1, 2),
res as (select item_id, r.page_id, count(distinct p) k from rel r join seeds s on s.page_id = r.p group by 1, 2),
pth as (select distinct item_id, nav.page_id, 1 k from nav join seedinfo s using (path)),
every as (select item_id, page_id, sum(l) l, sum(a) a, sum(r) r, sum(p) p from (select item_id, page_id, k l, 0 a, 0 r, 0 p from links_ union all select item_id, page_id, 0, k, 0, 0 from asked union all select item_id, page_id, 0, 0, k, 0 from res union all select item_id, page_id, 0, 0, 0, k from pth) group by 1, 2),
scored as (select item_id query_id, page_id id, least(1.0::double, round((0.3 * r + 0.2 * l + 0.15 * a + 0.2 * p)::double, 6)) score, case when r > 0 then 'resolved_call_graph' else 'dependency_graph' end reason from every)
select * from (select *, row_number() over (partition by query_id order by score desc, id::varchar) as rank from scored) where rank <= 100"""

_REVIEW = """with d as (select doc_id, exists (select 1 from labels l where l.doc_id = d.doc_id and toxic = 1) high from documents d),
q as (select greatest(60 - count(*) filter (where high), ceil(count(*) filter (where not high) * 0.05), 0) n from d),
r as (select doc_id, high, row_number() over (partition by high order by sha256('review:' || doc_id), doc_id) k from d)
select doc_id, high from r where high or k <= (select n from q)"""
_QUOTA = "select doc_id, source from (select doc_id, source, row_number() over (partition by source order by sha256('quota:' || doc_id)) k, count(*) over (partition by source) n from documents) where k <= ceil(n * 0.1)"
_PAIRS = r"""with c as (select doc_id id, source path, lang as language, nullif(regexp_extract(text, '[A-Za-z]+'), '') symbol, split_part(text, chr(10), 1) doc, text from documents),
t as (select *, path || ':' || coalesce(symbol, '1') lineage from c),
p as (select 'function_doc' category, 'Find the implementation described as: ' || trim(doc) query, lineage, text positive, id chunk_id, path, language from t where symbol is not null and trim(doc) <> ''
  union all select 'task_evidence', 'Locate symbol ' || symbol || ' in ' || path, lineage, text, id, path, language from t where symbol is not null
  union all select 'symbol_call', 'Find the implementation called by ' || coalesce(a.symbol, a.path) || ': c' || a.id, a.lineage || '->' || b.path || ':' || coalesce(b.symbol, ''), b.text, b.id, b.path, b.language from t a join t b on b.id = a.id + 1),
k as (select sha256(concat_ws(chr(31), 'rev1', category, lineage, query, positive)) pair_id, category, query, chunk_id, path, language from p where trim(positive) <> '' qualify row_number() over (partition by category, lineage, query, positive order by chunk_id) = 1),
r as (select *, cast('0x' || substr(pair_id, 1, 15) as bigint) as place from k),
n as (select id, language, path, cast('0x' || substring(sha256(coalesce(text, '')), 1, 15) as bigint) as spot, row_number() over (partition by language, sha256(coalesce(text, '')), path order by id) copy from c where language is not null),
o as (select r.pair_id, n.id, row_number() over (partition by r.pair_id order by case when spot >= place then spot - place else spot - place + 1152921504606846976 end, n.id) k from r join n on n.language = r.language and n.path <> r.path and n.copy <= 2),
l as (select pair_id, string_agg(id::varchar, ',' order by k) negatives from o where k <= 2 group by 1)
select pair_id, category, sha256(query) query_hash, chunk_id, coalesce(negatives, '') negatives from r left join l using (pair_id)"""
_VECTORS = "v as (select a.vec_id id, a.embedding::double[] q, b.embedding::double[] p from embeddings a join embeddings b on b.vec_id = a.vec_id + 1)"
_COLLAPSE = f"""with {_VECTORS}, s as (select x.id a, y.id b, list_sum(list_transform(list_zip(x.q, y.p), lambda z: z[1] * z[2])) s from v x, v y),
d as (select i, stddev_samp(e) d from (select unnest(q) e, unnest(range(len(q))) i from v union all select unnest(p), unnest(range(len(p))) from v) group by i),
m as (select (select count(*) from v) pairs, round(avg(s) filter (where a = b), 6) mean_positive, round(avg(s) filter (where a <> b), 6) mean_other, (select round(avg(d), 6) from d) dimension_std from s)
select *, dimension_std < 1e-4 or mean_other > 0.98 collapsed from m"""
_RANKS = f"""with {_VECTORS}, s as (select x.id a, y.id b, round(list_sum(list_transform(list_zip(x.q, y.p), lambda z: z[1] * z[2])), 9) s from v x, v y where x.id % 100 = 0),
r as (select a, 1 + count(*) filter (where s > own or (s = own and b < a)) k from (select *, max(case when a = b then s end) over (partition by a) own from s) group by a)
select round(avg((k <= 1)::int), 6) recall_1, round(avg((k <= 5)::int), 6) recall_5, round(avg((k <= 20)::int), 6) recall_20, round(avg(case when k <= 10 then 1 / k else 0 end), 6) mrr_10 from r"""

QUERIES = {
    "shard_roundtrip": (
        shard_roundtrip,
        f"""with w as (select doc_id, list_append(list_transform(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''), lambda w: ('0x' || substr(sha256(w), 1, 8))::bigint), 0) ids from documents),
        t as (select doc_id, unnest(ids) id, unnest(range(len(ids))) i from w), p as (select id, row_number() over (order by doc_id, i) - 1 place from t)
        select place // {SHARD} shard, count(*) tokens, sha256(string_agg(id::varchar, ' ' order by place)) ids_sha256 from p group by 1""",
    ),
    "structure_hash_tokens": (structure_hash_tokens, f"select doc_id, {_STRUCTURE} structure_hash from documents"),
    "lineage_hash": (lineage_hash, f"select doc_id, {_LINEAGE} lineage_hash from documents"),
    "dedup_greedy_report": (dedup_greedy_report, _GREEDY),
    "vulnerability_records": (vulnerability_records, _FEEDS_SQL),
    "protected_payloads": (protected_payloads, _PAYLOAD_SQL),
    "symbol_chunks": (symbol_chunks, _SYMBOLS_SQL),
    "bounded_chunks": (bounded_chunks, _BOUNDED_SQL),
    "imported_names": (imported_names, _IMPORTS_SQL),
    "link_cycles": (link_cycles, _CYCLES),
    "crawl_frontier": (crawl_frontier, _CRAWL),
    "graph_candidates": (graph_candidates, _GRAPH),
    "review_sample": (review_sample, _REVIEW),
    "source_quota_sample": (source_quota_sample, _QUOTA),
    "embedding_pairs": (embedding_pairs, _PAIRS),
    "retrieval_collapse": (retrieval_collapse, _COLLAPSE),
    "positive_ranks": (positive_ranks, _RANKS),
}
