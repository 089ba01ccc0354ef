"""The relational layer over the star schema, as SQL that Spark plans and another engine can check.

Each statement is run by Spark over temporary views of the tables it names, so filters and columns reach
the scans; sums of doubles are rounded, as engines add in different orders.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

SQL = {
    "r_filter_project": "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) as net from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24",
    "r_like_in_between": "select p_partkey, p_name from part where p_name like '%a%' and p_size between 5 and 25 and p_brand in ('Brand#11', 'Brand#12', 'Brand#21', 'Brand#22')",
    "r_null_logic": "select o_orderkey, nullif(o_orderstatus, 'O') as status, coalesce(nullif(o_orderpriority, '1-URGENT'), 'none') as priority from orders where nullif(o_orderstatus, 'F') is null or o_totalprice > 200000",
    "r_inner": "select n_name, r_name from nation join region on n_regionkey = r_regionkey",
    "r_left": "select c_custkey, count(o_orderkey) as n_orders from customer left join orders on c_custkey = o_custkey group by c_custkey",
    "r_right": "select n_name, s_suppkey from supplier right join nation on s_nationkey = n_nationkey and s_acctbal > 5000",
    "r_full": "select a.k as ka, b.k as kb, a.n as na, b.n as nb from (select o_custkey as k, count(*) as n from orders where o_orderstatus = 'O' group by o_custkey) a full join (select o_custkey as k, count(*) as n from orders where o_orderstatus = 'F' group by o_custkey) b on a.k = b.k",
    "r_semi": "select c_custkey, c_name from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 300000)",
    "r_anti": "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F')",
    "r_cross": "select r.r_name, s.seg from region r cross join (select distinct c_mktsegment as seg from customer) s",
    "r_theta_join": "select a.n_name as low, b.n_name as high from nation a join nation b on a.n_regionkey = b.n_regionkey and a.n_nationkey < b.n_nationkey",
    "r_range_join": "select e.user_id, count(*) as n from events e join (select 0 as lo, 20 as hi union all select 60, 80) b on e.value >= b.lo and e.value < b.hi group by e.user_id",
    "r_group_having": "select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity), 2) as sum_qty, round(avg(l_extendedprice), 4) as avg_price from lineitem group by l_returnflag, l_linestatus having count(*) > 10",
    "r_distinct_aggs": "select o_orderpriority, count(distinct o_custkey) as n_customers, count(distinct o_orderstatus) as n_status, count(*) as n from orders group by o_orderpriority",
    "r_filter_aggs": "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as n_f, round(sum(o_totalprice) filter (where o_orderstatus = 'O'), 2) as sum_o from orders group by o_orderpriority",
    "r_grouping_sets": "select l_returnflag, l_linestatus, cast(grouping(l_returnflag) as int) as g1, cast(grouping(l_linestatus) as int) as g2, count(*) as n from lineitem group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag), ())",
    "r_cube": "select c_mktsegment, c_nationkey, count(*) as n from customer group by cube (c_mktsegment, c_nationkey)",
    "r_rollup": "select r_name, n_name, count(*) as n from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by rollup (r_name, n_name)",
    "r_rank_family": "select c_custkey, c_nationkey, row_number() over w as rn, rank() over w as rk, dense_rank() over w as dr from customer window w as (partition by c_nationkey order by round(c_acctbal / 1000) desc, c_custkey)",
    "r_ntile_percent": "select s_suppkey, ntile(4) over (order by s_acctbal, s_suppkey) as quarter, round(percent_rank() over (order by s_acctbal), 8) as pr, round(cume_dist() over (order by s_acctbal), 8) as cd from supplier",
    "r_lag_lead": "select event_id, user_id, lag(event_type) over w as before, lead(event_type, 2, 'none') over w as later from events window w as (partition by user_id order by ts, event_id)",
    "r_first_last_nth": "select event_id, first_value(event_id) over w as first_id, last_value(event_id) over w as last_id, nth_value(event_id, 2) over w as second_id from events window w as (partition by user_id order by ts, event_id rows between unbounded preceding and unbounded following)",
    "r_frames": "select event_id, round(sum(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row), 6) as s3, count(*) over (partition by user_id order by value range between 5 preceding and 5 following) as near from events",
    "r_top_k": "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 20 offset 5",
    "r_top_per_group": "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) x where rn <= 2",
    "r_set_union": "select c_nationkey as k from customer union select s_nationkey from supplier",
    "r_set_union_all": "select k, count(*) as n from (select c_nationkey as k from customer union all select s_nationkey from supplier) x group by k",
    "r_set_intersect": "select c_nationkey as k from customer where c_acctbal > 9000 intersect select s_nationkey from supplier",
    "r_set_intersect_all": "select c_nationkey as k from customer intersect all select s_nationkey from supplier",
    "r_set_except": "select n_nationkey as k from nation except select s_nationkey from supplier where s_acctbal > 8000",
    "r_set_except_all": "select c_nationkey as k from customer except all select s_nationkey from supplier",
    "r_scalar_subquery": "select o_orderkey, o_totalprice from orders where o_totalprice > (select avg(o_totalprice) * 1.5 from orders)",
    "r_in_subquery": "select p_partkey from part where p_partkey in (select l_partkey from lineitem where l_quantity >= 50)",
    "r_correlated": "select o.o_orderkey, o.o_custkey from orders o where o.o_totalprice >= (select max(i.o_totalprice) from orders i where i.o_custkey = o.o_custkey)",
    "r_broadcast": "select /*+ BROADCAST(nation) */ c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where c_acctbal > 5000",
    "r_recursive": "with recursive t(k, depth, path) as (select c_custkey, 0, cast(c_custkey as string) from customer where c_custkey = 1 union all select x.c_custkey, t.depth + 1, concat(t.path, '/', cast(x.c_nationkey as string)) from t join customer x on cast(floor(x.c_custkey / 2) as bigint) = t.k) select k, depth, path from t",
    "r_strings": "select n_nationkey, upper(n_name) as up, length(n_name) as len, substring(n_name, 1, 3) as pre, replace(n_name, 'A', '*') as rep, concat(n_name, '-', cast(n_regionkey as varchar(10))) as both_, lpad(n_name, 12, '.') as padded, trim(concat('  ', n_name, ' ')) as trimmed, reverse(n_name) as rev from nation",
    "r_dates": "select o_orderkey, year(o_orderdate) as y, month(o_orderdate) as m, quarter(o_orderdate) as q, cast(date_trunc('month', o_orderdate) as date) as first_day from orders",
    "r_math": "select p_partkey, abs(p_size - 25) as d, cast(floor(p_retailprice) as bigint) as f, cast(ceil(p_retailprice) as bigint) as c, round(sqrt(p_retailprice), 6) as r, p_size % 7 as m, cast(sign(p_size - 25) as int) as s, round(power(p_size, 2), 2) as sq from part",
    "r_case_cast": "select l_orderkey, l_linenumber, case when l_quantity < 10 then 'small' when l_quantity < 30 then 'mid' else 'large' end as band, cast(l_quantity as int) as q from lineitem",
    "q1": "select l_returnflag, l_linestatus, round(sum(l_quantity), 2) as sum_qty, round(sum(l_extendedprice), 2) as sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) as sum_disc, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) as sum_charge, round(avg(l_quantity), 6) as avg_qty, round(avg(l_discount), 6) as avg_disc, count(*) as n from lineitem where l_shipdate <= timestamp '1998-09-02 00:00:00' group by l_returnflag, l_linestatus",
    "q3": "select l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, o_orderdate from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where c_mktsegment = 'BUILDING' group by l_orderkey, o_orderdate order by revenue desc, l_orderkey limit 10",
    "q5": "select n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey join supplier on l_suppkey = s_suppkey and c_nationkey = s_nationkey join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by n_name",
    "q6": "select round(sum(l_extendedprice * l_discount), 2) as revenue from lineitem where l_discount between 0.05 and 0.07 and l_quantity < 24",
    "q10": "select c_custkey, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue from customer join orders on c_custkey = o_custkey join lineitem on l_orderkey = o_orderkey where l_returnflag = 'R' group by c_custkey order by revenue desc, c_custkey limit 20",
    "q13": "select n, count(*) as customers from (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by c_custkey) x group by n",
    "q18": "select o_custkey, o_orderkey, round(sum(l_quantity), 2) as qty from orders join lineitem on o_orderkey = l_orderkey group by o_custkey, o_orderkey having sum(l_quantity) > 200",
}


def views(spark: SparkSession, folder: str, statement: str) -> None:
    for name in TABLES:
        if re.search(rf"\b{name}\b", statement):
            table(spark, folder, name).createOrReplaceTempView(name)


def _statement(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        views(spark, folder, SQL[name])
        return spark.sql(SQL[name])

    run.__name__ = name
    return run


def _pivot(spark: SparkSession, folder: str) -> DataFrame:
    """Orders by priority, a column per status."""
    return table(spark, folder, "orders").groupBy("o_orderpriority").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0, ["F", "O", "P"])


def _unpivot(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance")).unpivot("s_suppkey", ["nation", "balance"], "name", "amount")


def asof(left: DataFrame, right: DataFrame, key: str, at: str, value: str, out: str) -> DataFrame:
    """Each left row with the last right value of its key at or before its time: one shuffle by key, no pair of rows is made.

    Both sides are sorted together; of equal times the right side comes first, and of several right rows
    with one time the one with the greatest value.
    """
    from pyspark.sql import Window

    a = left.select("*", F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(key, at, F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(key).orderBy(at, "_side", F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(out, F.last("_v", ignorenulls=True).over(w))
    return both.where("_side = 1").drop("_v", "_side")


def _asof(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    a = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    b = e.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    return asof(a, b, "user_id", "ts", "click_id", "last_click").select("event_id", "last_click")


def _lateral(spark: SparkSession, folder: str) -> DataFrame:
    """The two largest orders of each customer in nation 1, by a lateral join."""
    views(spark, folder, "customer orders")
    return spark.sql("select c_custkey, t.o_orderkey from customer, lateral (select o_orderkey from orders where o_custkey = c_custkey order by o_totalprice desc, o_orderkey limit 2) t where c_nationkey = 1")


def _arrays(spark: SparkSession, folder: str) -> DataFrame:
    """Names of a region's nations as arrays: sorted, their initials, a filter, a sum of lengths, overlap."""
    by = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    initials = F.array_distinct(F.transform("names", lambda x: F.substring(x, 1, 1)))
    lengths = F.aggregate("names", F.lit(0).cast("long"), lambda a, x: a + F.length(x))
    long_ = F.filter("names", lambda x: F.length(x) > 7)
    return by.select("n_regionkey", F.array_join("names", ",").alias("names"), F.size(initials).cast("long").alias("initials"), F.size(long_).cast("long").alias("long_names"), lengths.alias("lengths"), F.arrays_overlap("names", F.array(F.lit("CHINA"), F.lit("FRANCE"))).alias("overlap"), F.element_at("names", -1).alias("last"))


def _maps(spark: SparkSession, folder: str) -> DataFrame:
    """A map from nation to key by region: its size, keys, a value, and values changed."""
    by = table(spark, folder, "nation").groupBy("n_regionkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("n_name", "n_nationkey")))).alias("m"))
    doubled = F.map_values(F.transform_values("m", lambda k, v: v * 2))
    return by.select("n_regionkey", F.size("m").cast("long").alias("entries"), F.array_join(F.map_keys("m"), ",").alias("keys"), F.try_element_at("m", F.lit("FRANCE")).cast("long").alias("france"), F.aggregate(doubled, F.lit(0).cast("long"), lambda a, x: a + x).alias("doubled"), F.map_contains_key("m", "CHINA").alias("china"))


def _json(spark: SparkSession, folder: str) -> DataFrame:
    """Orders to JSON and back, by path and by schema."""
    rows = table(spark, folder, "orders").select("o_orderkey", F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.array("o_custkey").alias("c"))).alias("j"))
    parsed = F.from_json("j", "k long, s string, c array<long>")
    return rows.select("o_orderkey", "j", F.get_json_object("j", "$.s").alias("status"), F.get_json_object("j", "$.c[0]").cast("long").alias("customer"), parsed["k"].alias("key"))


def _sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Whether sketches are near what they stand for, by type of event: distinct users (two kinds) within 5 %, the median within 2 % of ranks."""
    e = table(spark, folder, "events")
    by = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("exact"), F.approx_count_distinct("user_id", 0.02).alias("hll"), F.hll_sketch_estimate(F.hll_sketch_agg("user_id", 14)).alias("sketch"), F.percentile_approx("value", 0.5, 10000).alias("m"), F.count("value").alias("n"))
    under = e.join(F.broadcast(by.select("event_type", "m")), "event_type").groupBy("event_type").agg((F.count_if(F.col("value") <= F.col("m")) / F.count("value")).alias("rank"))
    near = lambda c: F.abs(F.col(c) - F.col("exact")) <= 0.05 * F.col("exact") + 1
    return by.join(under, "event_type").select("event_type", "n", F.col("exact").alias("users"), near("hll").alias("hll_ok"), near("sketch").alias("sketch_ok"), (F.abs(F.col("rank") - 0.5) <= 0.02).alias("median_ok"))


def _sql_udf(spark: SparkSession, folder: str) -> DataFrame:
    """A function written in SQL, which the optimizer puts in place."""
    views(spark, folder, "lineitem")
    spark.sql("create or replace temporary function net_price(price double, discount double, tax double) returns double return round(price * (1 - discount) * (1 + tax), 6)")
    return spark.sql("select l_orderkey, l_linenumber, net_price(l_extendedprice, l_discount, l_tax) as net from lineitem")


def _udaf(spark: SparkSession, folder: str) -> DataFrame:
    """An aggregate of our own: the harmonic mean, by a vectorised function."""
    harmonic = F.pandas_udf(lambda x: float(len(x) / (1.0 / x).sum()), "double", F.PandasUDFType.GROUPED_AGG)
    return table(spark, folder, "part").groupBy("p_brand").agg(F.round(harmonic("p_retailprice"), 6).alias("harmonic"))


def _udtf(spark: SparkSession, folder: str) -> DataFrame:
    """A table function of our own: the letters of a name with their places, joined laterally."""

    @F.udtf(returnType="place int, letter string")
    class Letters:
        def eval(self, name: str):
            for i, c in enumerate(name or ""):
                yield i + 1, c

    spark.udtf.register("letters_of", Letters)
    views(spark, folder, "nation")
    return spark.sql("select n_nationkey, t.place, t.letter from nation, lateral letters_of(n_name) t")


EXTRA = {
    "r_arrays": (
        _arrays,
        """with b as (select n_regionkey, list(n_name order by n_name) names from nation group by n_regionkey) select n_regionkey, array_to_string(names, ',') names, len(list_distinct(list_transform(names, lambda x: left(x, 1)))) initials,
        len(list_filter(names, lambda x: length(x) > 7)) long_names, cast(list_sum(list_transform(names, lambda x: length(x))) as bigint) lengths, list_has_any(names, ['CHINA', 'FRANCE']) overlap, names[-1] as last from b""",
    ),
    "r_maps": (_maps, "select n_regionkey, count(*) entries, string_agg(n_name, ',' order by n_name) keys, max(case when n_name = 'FRANCE' then n_nationkey end)::bigint france, sum(2 * n_nationkey)::bigint doubled, bool_or(n_name = 'CHINA') china from nation group by n_regionkey"),
    "r_json": (_json, """with j as (select o_orderkey, '{"k":' || o_orderkey || ',"s":"' || o_orderstatus || '","c":[' || o_custkey || ']}' j from orders) select o_orderkey, j, j ->> '$.s' status, cast(j ->> '$.c[0]' as bigint) customer, cast(j ->> '$.k' as bigint) as key from j"""),
    "r_sketches": (_sketches, "select event_type, count(value) n, count(distinct user_id) users, true hll_ok, true sketch_ok, true median_ok from events group by 1"),
    "r_sql_udf": (_sql_udf, "select l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount) * (1 + l_tax), 6) net from lineitem"),
    "r_udaf": (_udaf, "select p_brand, round(count(*) / sum(1.0 / p_retailprice), 6) harmonic from part group by p_brand"),
    "r_udtf": (_udtf, "select n_nationkey, cast(i as integer) place, n_name[i] letter from nation, range(1, 100) r(i) where i <= length(n_name)"),
    "r_pivot": (_pivot, "select o_orderpriority, count(*) filter (where o_orderstatus = 'F') as \"F\", count(*) filter (where o_orderstatus = 'O') as \"O\", count(*) filter (where o_orderstatus = 'P') as \"P\" from orders group by o_orderpriority"),
    "r_unpivot": (_unpivot, "select s_suppkey, 'nation' as name, cast(s_nationkey as double) as amount from supplier union all select s_suppkey, 'balance', s_acctbal from supplier"),
    "r_asof_join": (_asof, "select a.event_id, max_by(b.event_id, (b.ts, b.event_id)) as last_click from (select * from events where event_type = 'purchase') a left join (select * from events where event_type = 'click') b on a.user_id = b.user_id and b.ts <= a.ts group by a.event_id"),
    "r_lateral": (_lateral, "select c_custkey, o_orderkey from customer join (select *, row_number() over (partition by o_custkey order by o_totalprice desc nulls last, o_orderkey nulls first) rn from orders) on o_custkey = c_custkey where c_nationkey = 1 and rn <= 2"),
}


QUERIES = {name: (_statement(name), sql) for name, sql in SQL.items()} | EXTRA
