"""Near-duplicate components: an exact Jaccard join in metric space, by pivots, regions and recursion.

Documents are sets of word shingles under the Jaccard distance, a metric. Two documents are linked if
their similarity is at least a threshold t; a component is what links connect.

Document pivots alone split a corpus badly: nearly all pairs of texts share nothing, so nearly all are at
distance 1 from any pivot and every region would hold everything. So regions are drawn in three levels,
each within the one before.

1. Elementary pivots, single shingles in one order (that of their hashes). Of a set of n shingles at most
   k = n - ceil(t n) are missing in a set linked to it, so the first 2 k + 1 of two linked sets have k + 1
   in common, k of the smaller one. Sets that meet others in fewer are done. Most sets that only share
   passages end here.
2. Of the sets left all shingles are counted. A shingle that no other set has is a known difference: two sets
   with u and v of them differ by u + v at least, and the triangle inequality allows linked sets a
   difference of (1 - t) / (1 + t) of their sizes' sum. Sets with too many are done; for the others regions are
   keyed by the first k + 1 shingles, rare ones first.
3. In each region a document is the pivot: first the one that meets most others, in later rounds one of those not
   yet in the region's largest component. Each member's exact distance to the pivot it meets most often is
   measured; that pivot is its home (the nearest measured so far). Members within the threshold are one
   component with it, and pairs inside a component need no comparing, as only components are wanted. What
   is outside goes on to the next round, until a round links nothing.

What then remains divided is joined exactly: those outside a region's largest component with the members of other
components. Windows by the sizes (the distances to the empty set), by the known differences, by the distances to a
common home pivot and by a parity sketch of the sets' difference leave few pairs, whose whole sets are compared.
All windows are bounds, so no link is lost, and none is invented.

Equal sets are one vertex. Regions are keyed by pivot and never gathered; counts and joins are sums and
equi-joins. Shingles and sets are known by hashes of 64 and 128 bits.

Null and empty texts have no shingles and no links; texts of fewer words than a shingle have one shingle,
the whole. Rows with the same id count as one document with several texts. Rows with a null id get a null
component and link nothing. An empty table gives an empty result. Only the id and the text are read, so other
columns may have any names. A text is one block of work: a long one takes about 40 bytes of a worker's memory
a word, and no pair of documents needs more than two sets at once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Words, batch_rows, blocks, discard, mixed, released, small, staged

#: Rounds with document pivots at most; what they leave is joined exactly.
ROUNDS = 4
#: The bits of a set's parity sketch.
BITS = 2048
#: Rows with two whole sets that are handed to a worker at once.
PAIR_ROWS = 500
_U = np.uint64


def shingle_sets(arr: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its k-word shingles, words in ASCII lower case."""
    words = Words(arr, lower=True)
    h, n = words.hash, words.counts()
    whole = h.copy()
    for j in range(1, k):
        whole[: len(h) - j] = mixed(whole[: len(h) - j] * _U(0x9E3779B97F4A7C15) ^ h[j:]) if len(h) > j else whole[: len(h) - j]
    for i, (at, size) in enumerate(zip(words.first.tolist(), n.tolist(), strict=False)):
        if size >= k:
            yield np.unique(whole[at : at + size - k + 1])
        elif size:
            one = np.array([size], dtype=np.uint64)
            for x in h[at : at + size]:
                one = mixed(one * _U(0xC2B2AE3D27D4EB4F) ^ x)
            yield one
        else:
            yield np.zeros(0, dtype=np.uint64)


def signature(s: np.ndarray) -> bytes:
    return xxhash.xxh128_digest(s.tobytes())


def sketch(s: np.ndarray) -> np.ndarray:
    """The parities of the numbers of members thrown on each of BITS bits. Each bit in which two sketches differ is a member that only one set has."""
    odd = np.bincount((s % _U(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def missing(n: int, percent: int) -> int:
    """How many of n shingles a set linked to this one may lack."""
    return n - -(-percent * n // 100)


def _alone(n: int, percent: int) -> bool:
    """Whether no other set can be linked to one of n shingles."""
    return n == 0 or 100 * n < percent * (n + 1)


def first_pivots(n: int, percent: int) -> int:
    """The number of a set's elementary pivots in the first level."""
    return 0 if _alone(n, percent) else min(n, 2 * missing(n, percent) + 1)


def least_met(n: int, percent: int) -> int:
    """How many of a set's elementary pivots each set linked to it has among its own."""
    a = -(-percent * n // 100)
    return min(missing(a, percent) + 1, a - missing(a, percent))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)))


def _sets(docs: DataFrame, k: int, percent: int, whole: bool) -> DataFrame:
    """Of rows (id, text): id, sig, n, least and the first pivots, or the whole set with its sketch."""

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, "text"):
            sets = list(shingle_sets(b.column("text"), k))
            cols = {"id": b.column("id"), "sig": pa.array([signature(s) for s in sets], pa.binary()), "n": pa.array([len(s) for s in sets], pa.int32())}
            if whole:
                cols |= {"members": _lists(sets), "bits": pa.array([sketch(s) for s in sets], pa.list_(pa.int64()))}
            else:
                cols |= {"least": pa.array([least_met(len(s), percent) for s in sets], pa.int32()), "pivots": _lists([s[: first_pivots(len(s), percent)] for s in sets])}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    more = "members array<long>, bits array<long>" if whole else "least int, pivots array<long>"
    return docs.select("id", "text").mapInArrow(run, f"id long, sig binary, n int, {more}")


def _measured(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) of representatives with the sizes n and nb of their sets and the number of shingles in ``both``."""
    left = pairs.select("a", "b").join(sets.select(F.col("rep").alias("a"), "n", F.col("members").alias("x")), "a")
    right = sets.select(F.col("rep").alias("b"), F.col("n").alias("nb"), F.col("members").alias("y"))

    @released
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                one = np.concatenate([x.values.to_numpy(), y.values.to_numpy()]).view(np.uint64)
                one.sort(kind="stable")  # two sorted runs, which are only merged
                both.append(int((one[1:] == one[:-1]).sum()))
            names = ["a", "b", "n", "nb"]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(both, pa.int64())], names=[*names, "both"])

    with batch_rows(pairs.sparkSession, PAIR_ROWS):
        return staged(left.join(right, "b").select("a", "b", "n", "nb", "x", "y").mapInArrow(run, "a long, b long, n int, nb int, both long"))


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * (F.col("n") + F.col("nb") - F.col("both"))


def _differences(x: str, y: str) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, c: t + c)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, label) of every vertex of the edges: the least id that its edges reach.

    Each round every vertex takes the least label among its neighbours', then the label of its label;
    tables are written each round, so lineage stays short.
    """
    both = staged(edges.select(F.col(a).alias("id"), F.col(b).alias("to")).union(edges.select(F.col(b), F.col(a))).distinct())
    labels = staged(both.groupBy("id").agg(F.least(F.min("to"), F.col("id")).alias("label")))
    while True:
        near = both.join(labels.select(F.col("id").alias("to"), F.col("label").alias("other")), "to").groupBy("id").agg(F.min("other").alias("other"))
        step = labels.join(near, "id").select("id", "label", F.least("label", "other").alias("next"))
        up = labels.select(F.col("id").alias("next"), F.col("label").alias("above"))
        step = staged(step.join(up, "next").select("id", "label", F.least("next", "above").alias("new")))
        # hooks a whole tree at once: what its old root's members reach
        hooks = step.where("new < label").groupBy("label").agg(F.min("new").alias("root"))
        if hooks.limit(1).count() == 0:
            return labels
        joined = step.join(hooks, "label", "left").select("id", F.least("new", F.coalesce("root", "new")).alias("label"))
        labels = staged(joined)


def _met(entries: DataFrame) -> DataFrame:
    """(rep, met): with how many of its shingles each set meets another. One shuffle by shingle serves the count and the join."""
    dealt = entries.where("s is not null").repartition("s")  # the join's own filter, else its plan differs and the shuffle is made twice
    shared = dealt.groupBy("s").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("s")
    return dealt.join(shared, "s", "left_semi").groupBy("rep").agg(F.count_distinct("s").alias("met"))


def _regions(sets: DataFrame, percent: int) -> DataFrame:
    """(s, rep, n, z): each set's first shingles, rare ones first, that other sets have too; z is what is left of the difference it may have."""
    dealt = sets.select("rep", "n", F.explode("members").alias("s")).where("s is not null").repartition("s")
    counted = dealt.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    shared = dealt.join(counted, "s").select("rep", "n", "s", "c")
    own = Window.partitionBy("rep")
    placed = shared.withColumn("place", F.row_number().over(own.orderBy("c", "s"))).withColumn("u", F.col("n") - F.count(F.lit(1)).over(own))
    last = F.col("n") - F.ceil(F.expr(f"{percent}L * n / 100")) + 1
    z = (100 - percent) * F.col("n") - (100 + percent) * F.col("u")
    return staged(placed.where(F.col("place") + F.col("u") <= last).select("s", "rep", "n", z.cast("long").alias("z")))


def similar(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    base = staged(_sets(rows, k, percent, False))
    some = base.where("n > 0 and id is not null")
    # an id with several texts links them: all its sets are vertices of their own, joined by edges below
    classes = some.groupBy("sig", "n").agg(F.min("id").alias("id"), F.min("least").alias("least"))
    classes = staged(classes.withColumn("rep", F.monotonically_increasing_id()))
    named = classes.select("sig", "id", "rep")
    narrow = staged(base.select("id", "sig", "n"))
    own = narrow.where("n > 0 and id is not null").select("id", "sig").join(named.select("sig", F.col("id").alias("b")), "sig").where("id <> b").select(F.col("id").alias("a"), "b").distinct()
    first = some.join(named, ["sig", "id"]).select("rep", F.explode("pivots").alias("s"))
    met = _met(first).join(classes.select("rep", "least"), "rep").where("met >= least").select("rep")
    wanted = staged(named.join(met, "rep"))
    discard(base)
    texts = rows.join(small(wanted.select("id").distinct(), wanted.count()), "id")
    sets = _sets(texts, k, percent, True).join(wanted, ["sig", "id"]).dropDuplicates(["rep"])
    sets = staged(sets.select("rep", "id", "n", "members", "bits"))
    alive = _met(sets.select("rep", F.explode("members").alias("s"))).join(sets.select("rep", "n"), "rep").where(100 * F.col("met") >= percent * F.col("n")).select("rep")
    wide, sets = sets, staged(sets.join(alive, "rep", "left_semi"))
    discard(wide)
    found = _links(sets, _regions(sets, percent), percent)
    names = sets.select("rep", "id")
    found = found.join(names.select(F.col("rep").alias("a"), F.col("id").alias("ia")), "a").join(names.select(F.col("rep").alias("b"), F.col("id").alias("ib")), "b")
    links = staged(own.unionByName(found.select(F.col("ia").alias("a"), F.col("ib").alias("b"))).where("a <> b").distinct())
    out = narrow.join(named.select("sig", F.col("id").alias("rep")), "sig", "left")
    out = out.join(components(links).select(F.col("id").alias("rep"), "label"), "rep", "left")
    component = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("label", "rep")).otherwise(F.col("id")))
    return out.select(F.col("id").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"))


def _links(sets: DataFrame, regions: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between sets that connect each set with all it can reach."""
    spark = sets.sparkSession
    shared = regions.groupBy("s").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    regions = regions.join(shared, "s")
    # a set that meets many others in most of its regions is near the middle of its group
    central = regions.groupBy("rep").agg(F.sum(F.log("c")).alias("central"))
    regions = staged(regions.join(central, "rep"))
    links = spark.createDataFrame([], "a long, b long")
    homes = spark.createDataFrame([], "rep long, home long, far double")
    labels = None
    for turn in range(ROUNDS):
        state = _divided(_labelled(regions, labels))
        order = F.struct(-F.col("central"), "rep") if turn == 0 else F.struct(F.xxhash64("rep", F.lit(turn)), "rep")
        pivots = state.where("label <> most" if turn else "true").groupBy("s").agg(F.min(F.struct(order.alias("o"), "rep", "n", "z", "label")).alias("p")).select("s", "p")
        meets = state.join(pivots, "s").where("label <> p.label").where((100 * F.least("n", "p.n") >= percent * F.greatest("n", "p.n")) & (F.col("z") + F.col("p.z") >= 0))
        votes = meets.groupBy("rep", F.col("p.rep").alias("b")).agg(F.count(F.lit(1)).alias("times"))
        home = staged(votes.groupBy(F.col("rep").alias("a")).agg(F.max(F.struct("times", "b")).alias("m")).select("a", "m.b"))
        far = _measured(sets, home)
        homes = staged(homes.unionByName(far.select(F.col("a").alias("rep"), F.col("b").alias("home"), (1 - F.col("both") / (F.col("n") + F.col("nb") - F.col("both"))).alias("far"))).groupBy("rep").agg(F.min(F.struct("far", "home")).alias("m")).select("rep", "m.home", "m.far"))
        found = staged(far.where(_linked(percent)).select("a", "b"))
        if found.limit(1).count() == 0:
            break
        links = staged(links.unionByName(found))
        labels = components(links)
    state = _divided(_labelled(regions, labels)).select("s", "rep", "n", "z", "label", "most")
    state = staged(state.join(sets.select("rep", "bits"), "rep").join(homes, "rep", "left"))
    x = state.where("label <> most").alias("x")
    y = state.alias("y")
    window = F.coalesce((F.col("x.home") != F.col("y.home")) | (F.abs(F.col("x.far") - F.col("y.far")) <= (1 - percent / 100) + 1e-9), F.lit(True))
    # of two that are both outside the largest component one order is enough
    once = (F.col("y.label") == F.col("y.most")) | (F.col("x.rep") < F.col("y.rep"))
    sizes = F.col("x.n") + F.col("y.n")
    near = (F.col("x.s") == F.col("y.s")) & (F.col("x.label") != F.col("y.label")) & once & (F.col("x.z") + F.col("y.z") >= 0) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & window
    near = near & ((100 + percent) * _differences("x.bits", "y.bits") <= (100 - percent) * sizes)
    pairs = staged(x.join(y, near).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct())
    return links.unionByName(_measured(sets, pairs).where(_linked(percent)).select("a", "b"))


def _labelled(regions: DataFrame, labels: DataFrame | None) -> DataFrame:
    if labels is None:
        return regions.withColumn("label", F.col("rep"))
    return regions.join(labels.withColumnRenamed("id", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))


def _divided(state: DataFrame) -> DataFrame:
    """The rows of regions with several components, with the label that most of a region's rows have (``most``)."""
    sizes = state.groupBy("s", "label").agg(F.count(F.lit(1)).alias("k"))
    most = sizes.groupBy("s").agg(F.max(F.struct("k", "label")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("s", F.col("m.label").alias("most"))
    return state.join(most, "s")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with one of each component, that with the least id; of rows that repeat an id the least text. Null ids stay."""
    found = similar(docs, k, percent, doc_id, text).where("doc_id is not null").select("doc_id", "component_id").distinct()
    keep = found.where("doc_id = component_id").select(F.col("doc_id").alias(doc_id))
    kept = docs.join(keep, doc_id, "left_semi")
    row = next(x for x in (f"_row{i}" for i in range(len(docs.columns) + 1)) if x not in docs.columns)
    first = kept.withColumn(row, F.row_number().over(Window.partitionBy(doc_id).orderBy(F.col(text).asc_nulls_last()))).where(F.col(row) == 1).drop(row)
    return first.unionByName(docs.where(F.col(doc_id).isNull()))


ORACLE = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents),
sh as (
  select distinct doc_id, hash(g) g from (
    select doc_id, array_to_string(w[i : i + least(len(w), 4) - 1], ' ') g
    from (select doc_id, w, unnest(range(1, len(w) - least(len(w), 4) + 2)) i from w where len(w) > 0))),
n as (select doc_id, count(*) n from sh group by doc_id),
common as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
both_ways as (select a, b from links union all select b, a from links),
reach as (select doc_id a, doc_id b from n union select r.a, l.b from reach r join both_ways l on r.b = l.a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, coalesce(r.c, d.doc_id) component_id
from documents d left join n using (doc_id) left join (select a, min(b) c from reach group by a) r on r.a = d.doc_id
"""
