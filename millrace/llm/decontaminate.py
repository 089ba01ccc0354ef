"""Benchmark decontamination by winnowing, with DataFrame functions only.

A benchmark window is ``window`` consecutive words of an item; an item of fewer words, but not none,
is one window. A document word inside any occurrence of a window is hit.

Winnowing keeps, of every run of w consecutive k-gram hashes, the least one. Two texts that share
w + k - 1 words therefore keep a common fingerprint, so with w + k - 1 equal to the window's length
no occurrence of a window is missed. Documents and items are winnowed alike, fingerprints are joined,
and each hit is extended to all window starts that cover it, where the words themselves are compared.
(Arrays are exploded with explode_outer: for explode the optimizer adds a filter on the array's size,
and pushing that down would compute the fingerprints twice, without sharing of parts.)
Windows of each length that occurs in the benchmark (at most ``window`` lengths) have their own k and w.

Nulls and texts without words have no words and no hits; null ids are judged like others. Rows with the same id and
text are counted apart: each gives its own row. Columns other than id and text are not read by ``contamination``, and
``clean`` keeps them all, so they may have any names. An empty benchmark hits nothing, an empty table of documents gives
an empty result. A very long text is one row throughout: its words, hashes and kept fingerprints are arrays of a
task, about 100 bytes a word and window length. The items of a window, and of a document, are a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
#: Word characters: all but ASCII that is neither a digit nor a letter. Upper case is lowered afterwards.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Low bits of a kept value that hold its position; the hash is above them.
POSITION_BITS = 30


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def _gram(t: int) -> int:
    return (t + 1) // 2


def _numbers(to: Column) -> Column:
    """0 .. to, or nothing where to is negative."""
    return F.when(to >= 0, F.sequence(F.lit(0), to)).otherwise(F.array().cast("array<int>"))


def _gram_at(k: int):
    """Of a position the hash of the k words from there, its low bits replaced by the position."""

    def value(i: Column) -> Column:
        h = F.xxhash64(*[F.get("_h", i + j) for j in range(k)])
        return F.shiftleft(F.shiftright(h, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))

    return value


def _least_from(grams: str, w: int):
    def value(i: Column) -> Column:
        own = [F.get(grams, i + j) for j in range(w)]
        return F.least(*own) if w > 1 else own[0]

    return value


def _unpacked(t: int):
    def value(v: Column) -> Column:
        return F.struct(F.lit(t).alias("t"), F.shiftright(v, POSITION_BITS).alias("fp"), v.bitwiseAND(F.lit((1 << POSITION_BITS) - 1)).cast("int").alias("pos"))

    return value


def winnowed(df: DataFrame, words: str, lengths: list[int]) -> DataFrame:
    """Adds ``picks``: array of (t, fp, pos), the fingerprints kept for each window length t.

    Words are hashed in Unicode lower case, so that equal words in ASCII lower case have equal hashes.
    """
    n = F.size(words)
    df = df.withColumn("_h", F.transform(words, lambda w: F.xxhash64(F.lower(w))))
    for t in lengths:
        df = df.withColumn(f"_g{t}", F.when(n >= t, F.transform(_numbers(n - _gram(t)), _gram_at(_gram(t)))))
    for t in lengths:
        kept = F.transform(_numbers(n - t), _least_from(f"_g{t}", t - _gram(t) + 1))
        df = df.withColumn(f"_p{t}", F.array_distinct(F.when(n >= t, kept).otherwise(F.array().cast("array<bigint>"))))
    picks = [F.transform(f"_p{t}", _unpacked(t)) for t in lengths]
    made = F.concat(*picks) if picks else F.array().cast("array<struct<t:int,fp:bigint,pos:int>>")
    return df.withColumn("picks", made).drop("_h", *[f"_{x}{t}" for t in lengths for x in "gp"])


def _window_at(words: str, start: Column, t: Column) -> Column:
    return common.ascii_lower(F.array_join(F.slice(words, start + 1, t), " "))


def benchmark_tables(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, list[int]]:
    """The windows (t, win, wh, items) and fingerprints (t, fp) of a benchmark, staged, and the window lengths present."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(text)).alias("words")).withColumn("n", F.size("words")).where("n > 0").withColumn("t", F.least("n", F.lit(window)))
    items = common.staged(items)
    lengths = sorted(r.t for r in items.select("t").distinct().collect())
    wins = items.select("item", "t", "words", F.explode(_numbers(F.col("n") - F.col("t"))).alias("s")).select("item", "t", _window_at("words", F.col("s"), F.col("t")).alias("win"))
    wins = common.staged(wins.groupBy("t", "win").agg(F.collect_set("item").alias("items")).withColumn("wh", F.xxhash64("win")))
    prints = winnowed(items.select("words"), "words", lengths).select(F.explode_outer("picks").alias("p")).select("p.t", "p.fp").where("fp is not null").distinct()
    return wins, common.staged(prints), lengths


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_rows: int | None = None) -> DataFrame:
    """Per document its words, the words hit by benchmark windows, and the items whose windows occur.

    doc_id, n_words, n_hit, n_items, items_sha256 (of the sorted, comma-joined item ids),
    contaminated (n_hit > 0 and 20 * n_hit >= n_words).

    The benchmark is broadcast while it has at most ``broadcast_rows`` windows and fingerprints
    (common.BROADCAST_ROWS by default) of at most common.BROADCAST_BYTES; beyond that, fingerprints are joined by shuffle without the
    documents' words, and only documents with a hit are read again.
    """
    judged = _judged(docs, benchmark, doc_id, text, item_id, item_text, window, broadcast_rows)
    return judged.drop("th")


def _judged(docs: DataFrame, benchmark: DataFrame, doc_id: str, text: str, item_id: str, item_text: str, window: int, broadcast_rows: int | None) -> DataFrame:
    """The rows of ``contamination`` with the text's hash ``th``."""
    wins, prints, lengths = benchmark_tables(benchmark, item_id, item_text, window)
    most = common.BROADCAST_ROWS if broadcast_rows is None else broadcast_rows
    size = wins.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("win") + F.aggregate("items", F.lit(40).cast("long"), lambda a, x: a + F.octet_length(x) + 16)).alias("b")).first()
    n_prints = prints.count()
    fits = size.n + n_prints <= most and (size.b or 0) + 16 * n_prints <= common.BROADCAST_BYTES
    base = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("th"), words_of(F.col("text")).alias("words"))
    known = prints.withColumn("known", F.lit(True))
    if not lengths:
        hits = base.select("id", "th", F.size("words").alias("n"), F.lit(None).cast("int").alias("t"), F.lit(None).cast("int").alias("pos"), F.col("words"))
    elif fits:
        marked = F.concat(F.array(F.lit(None).cast("struct<t:int,fp:bigint,pos:int>")), F.col("picks"))
        rows = winnowed(base, "words", lengths).select("id", "th", "words", F.explode_outer(marked).alias("p"))
        hits = rows.select("id", "th", "words", F.col("p.t").alias("t"), F.col("p.fp").alias("fp"), F.col("p.pos").alias("pos")).join(F.broadcast(known), ["t", "fp"], "left").where("fp is null or known")
    else:
        rows = winnowed(base, "words", lengths).select("id", "th", F.explode_outer("picks").alias("p")).select("id", "th", "p.*").join(prints, ["t", "fp"], "left_semi")
        found = rows.groupBy("id", "th").agg(F.collect_set(F.struct("t", "pos")).alias("at")).withColumnRenamed("id", "fid").withColumnRenamed("th", "fth")
        back = base.join(found, F.col("id").eqNullSafe(F.col("fid")) & (F.col("th") == F.col("fth")), "left")
        marked = F.concat(F.array(F.lit(None).cast("struct<t:int,pos:int>")), F.coalesce("at", F.array().cast("array<struct<t:int,pos:int>>")))
        hits = back.select("id", "th", "words", F.explode_outer(marked).alias("p")).select("id", "th", "words", "p.t", "p.pos")
    n = F.size("words")
    k = F.floor((F.col("t") + 1) / 2).cast("int")
    starts = F.sequence(F.greatest(F.lit(0), F.col("pos") + k - F.col("t")), F.least(F.col("pos"), n - F.col("t")))
    tried = hits.select("id", "th", n.alias("n"), "t", "words", F.explode_outer(starts).alias("s")).select("id", "th", "n", "t", "s", _window_at("words", F.col("s"), F.col("t")).alias("win")).withColumn("wh", F.xxhash64("win"))
    exact = wins if not fits else F.broadcast(wins)
    found = tried.join(exact, ["t", "wh", "win"], "left").where("s is null or items is not null")
    per_doc = found.groupBy("id", "th").agg(
        F.max("n").alias("n"),
        F.sum(F.when(F.col("s").isNull(), 1).otherwise(0)).alias("copies"),
        F.array_sort(F.collect_set(F.when(F.col("s").isNotNull(), F.struct("s", (F.col("s") + F.col("t")).alias("e"))))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to")),
        lambda acc, x: F.struct((acc.hit + F.greatest(F.lit(0), x.e - F.greatest(x.s, acc.to))).alias("hit"), F.greatest(acc.to, x.e).alias("to")),
        lambda acc: acc.hit,
    )
    out = per_doc.select(
        F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), F.col("id").alias("doc_id"), "th", F.col("n").cast("long").alias("n_words"), covered.cast("long").alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    ).drop("copy")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, broadcast_rows: int | None = None) -> DataFrame:
    """The documents that are not contaminated, with all their columns. Id and text tell documents apart, null ids too."""
    bad = _judged(docs, benchmark, doc_id, text, item_id, item_text, window, broadcast_rows).where("contaminated").select(F.col("doc_id").alias("_bad_id"), F.col("th").alias("_bad_text")).distinct()
    same = docs[doc_id].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(F.coalesce(docs[text], F.lit(""))) == bad["_bad_text"])
    return docs.join(bad, same, "left_anti")


ORACLE = r"""
with items as (
  select cast(item_id as varchar) item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
wins as (
  select distinct item, least(len(w), 13) t, array_to_string(w[i : i + least(len(w), 13) - 1], ' ') win
  from (select item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) i from items where len(w) > 0)),
docs as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
grams as (
  select doc_id, t, i, array_to_string(w[i : i + t - 1], ' ') win
  from (select doc_id, w, t, unnest(range(1, greatest(len(w) - t + 2, 1))) i from docs, (select distinct t from wins))),
hits as (select g.doc_id, g.t, g.i, x.item from grams g join wins x on g.t = x.t and g.win = x.win),
covered as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + t)) p from hits) group by doc_id),
named as (select doc_id, count(*) n_items, sha256(string_agg(item, ',' order by item)) items_sha256 from (select distinct doc_id, item from hits) group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, coalesce(items_sha256, sha256('')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from docs d left join covered using (doc_id) left join named using (doc_id)
"""
