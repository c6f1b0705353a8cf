"""Coverage, catalogue graphs, rules, versions, checks and ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from granary.operators import asof, checks, eligibility, graph, ordering
from granary.plans.registry import query, table

#: Every part has two parents, so the catalogue is a graph with several paths.
_EDGES = "edges as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 1 union select p_partkey, p_partkey // 3 from part where p_partkey > 2)"


def _edges(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    return part.where("src > 1").select("src", F.expr("src div 2").alias("dst")).union(part.where("src > 2").select("src", F.expr("src div 3").alias("dst"))).distinct()


@query("""select n_regionkey as topic, list_sort(list_distinct(list(c_mktsegment))) as intents, count(distinct c_nationkey) as concepts, count(*) as n from customer join nation on c_nationkey = n_nationkey group by 1""")
def coverage_topics(spark, sf_dir):
    """Per topic its distinct intents, sorted, and distinct concepts."""
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    out = rows.groupBy(F.col("n_regionkey").alias("topic"))
    return out.agg(F.sort_array(F.collect_set("c_mktsegment")).alias("intents"), F.count_distinct("c_nationkey").alias("concepts"), F.count("*").alias("n"))


@query("""with p as (select c_nationkey, c_mktsegment, count(*) as n from customer group by all) select c_mktsegment as intent, n, count(*) as places, min(c_nationkey) as first from p group by all""")
def coverage_places(spark, sf_dir):
    """Concepts by place and intent, then places by intent and count."""
    places = table(spark, sf_dir, "customer").groupBy("c_nationkey", F.col("c_mktsegment").alias("intent")).agg(F.count("*").alias("n"))
    return places.groupBy("intent", "n").agg(F.count("*").alias("places"), F.min("c_nationkey").alias("first"))


@query(f"""with recursive {_EDGES}, w as (select src as start, src as node, 0 as depth from edges union select start, dst, depth + 1 from w join edges on node = src)
select start, count(distinct node) - 1 as ancestors, sum(distinct node)::bigint as node_sum from w group by 1""")
def ancestor_closure(spark, sf_dir):
    """H1: all ancestors of every catalogue entry."""
    edges = _edges(spark, sf_dir)
    reached = graph.reach(edges, edges.select(F.col("src").alias("start")))
    return reached.groupBy("start").agg((F.count("*") - 1).alias("ancestors"), F.sum("node").alias("node_sum"))


@query(f"""with recursive {_EDGES}, w as (select 1 as node, 0 as depth union select src, depth + 1 from w join edges on node = dst where depth < 4)
select node, min(depth) as depth from w group by 1""")
def bounded_descendants(spark, sf_dir):
    """H3, H7, H8: entries within four steps below the root, with their depth."""
    down = _edges(spark, sf_dir).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    root = spark.range(1, 2).select(F.col("id").alias("start"))
    return graph.reach(down, root, 4).select("node", "depth")


@query(f"""with recursive {_EDGES}, more as (select * from edges union select 7, 29 where exists (select 1 from part where p_partkey = 29)),
w as (select src as start, dst as node from more union select start, dst from w join more on node = src) select start as node from w where start = node""")
def catalogue_cycles(spark, sf_dir):
    """H4: entries on a cycle, after one edge from 7 down to 29 closes one."""
    edges = _edges(spark, sf_dir)
    back = table(spark, sf_dir, "part").where("p_partkey = 29").select(F.lit(7).cast("long").alias("src"), F.col("p_partkey").alias("dst"))
    return graph.on_cycles(edges.union(back))


@query("""with c as (select event_id, event_type, nullif(json_extract_string(props, '$.k'), '')::bigint as k from events)
select event_id, (event_type in ('click', 'view') and k is not null and k not in (1, 2, 3)) as active, case when k is null then 'k' end as missing from c""")
def rule_activation(spark, sf_dir):
    """A rule of three conditions on each context: type in a set, k present and not in a set."""
    k = F.get_json_object("props", "$.k")
    checks_ = [
        eligibility.holds(F.lit("in"), F.col("event_type"), F.array(F.lit("click"), F.lit("view"))),
        eligibility.holds(F.lit("present"), k, F.array().cast("array<string>")),
        eligibility.holds(F.lit("not_in"), k, F.array(F.lit("1"), F.lit("2"), F.lit("3"))),
    ]
    return table(spark, sf_dir, "events").select("event_id", (checks_[0] & checks_[1] & checks_[2]).alias("active"), F.when(k.isNull(), "k").alias("missing"))


@query("""select 'enum' as rule, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM') union all select 'maximum', count(*) from orders where o_totalprice > 200000 union all select 'minimum', count(*) from orders where o_totalprice < 1000""")
def context_violations(spark, sf_dir):
    """How many values break each rule of a context schema, in one pass."""
    bad = {"enum": ~F.col("o_orderpriority").isin("1-URGENT", "2-HIGH", "3-MEDIUM"), "maximum": F.col("o_totalprice") > 200000, "minimum": F.col("o_totalprice") < 1000}
    row = table(spark, sf_dir, "orders").agg(*[F.count_if(c).alias(k) for k, c in bad.items()])
    return row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in bad])).alias("x")).select("x.*")


@query("""select 'label without document' as rule, doc_id::varchar as key from labels where doc_id not in (select doc_id from documents)
union all select 'order without customer', o_custkey::varchar from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer))
union all select 'repeated supplier name', s_name from supplier group by s_name having count(*) > 1
union all select 'discount', l_orderkey::varchar from lineitem where not (l_discount < 0.1)""")
def release_violations(spark, sf_dir):
    """C10, G4, H9, L9 in part: references to nothing, repeated keys and broken conditions as one list."""
    return _violations(spark, sf_dir, table(spark, sf_dir, "customer"))


@query("""select 'label without document' as rule, doc_id::varchar as key from labels where doc_id not in (select doc_id from documents)
union all select 'order without customer', o_custkey::varchar from (select distinct o_custkey from orders where o_custkey not in (select c_custkey from customer))
union all select 'repeated supplier name', s_name from supplier group by s_name having count(*) > 1
union all select 'discount', l_orderkey::varchar from lineitem where not (l_discount < 0.1)
union all select 'supplier of several nations', s_acctbal::varchar from supplier group by s_acctbal having count(distinct s_nationkey) > 1""")
def whole_release_violations(spark, sf_dir):
    """C10, D28, G4, H9, L9 in part: release_violations, and keys that stand under several groups."""
    groups = table(spark, sf_dir, "supplier").groupBy("s_acctbal").agg(F.count_distinct("s_nationkey").alias("n")).where("n > 1")
    return _violations(spark, sf_dir, table(spark, sf_dir, "customer")).union(groups.select(F.lit("supplier of several nations").alias("rule"), F.col("s_acctbal").cast("string").alias("key")))


def _violations(spark, sf_dir, customers):
    return checks.violations(
        checks.missing("label without document", table(spark, sf_dir, "labels"), "doc_id", table(spark, sf_dir, "documents"), "doc_id"),
        checks.missing("order without customer", table(spark, sf_dir, "orders"), "o_custkey", customers, "c_custkey"),
        checks.repeated("repeated supplier name", table(spark, sf_dir, "supplier"), "s_name"),
        checks.broken("discount", table(spark, sf_dir, "lineitem"), "l_orderkey", "l_discount < 0.1"),
    )


@query("""select coalesce(a.doc_id, b.doc_id) as doc_id, case when a.doc_id is null then 'only_right' when b.doc_id is null then 'only_left' else 'changed' end as status
from (select doc_id, doc_id % 3 as v from documents) a full join (select doc_id, quality as v from labels) b on a.doc_id = b.doc_id where a.doc_id is null or b.doc_id is null or a.v <> b.v""")
def inventory_changes(spark, sf_dir):
    """Two inventories compared on key and value."""
    mine = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 3).alias("v"))
    theirs = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("v"))
    return checks.inventory_difference(mine, theirs, "doc_id", "v")


@query("""with p as (select event_id, user_id, ts from events where event_type = 'purchase'), v as (select user_id, ts as at, max(event_id) as view_id from events where event_type = 'view' group by all)
select event_id, coalesce(view_id, -1) as view_id from p asof left join v on p.user_id = v.user_id and p.ts >= v.at""")
def last_view_before_purchase(spark, sf_dir):
    """The latest view of the same user not after each purchase."""
    events = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    bought = events.where("event_type = 'purchase'").drop("event_type")
    views = events.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("at")).agg(F.max("event_id").alias("view_id"))
    return asof.as_of(bought, views, "user_id", "ts", "at", ["view_id"]).select("event_id", F.coalesce("view_id", F.lit(-1)).cast("long").alias("view_id"))


@query("""select o_custkey, o_orderkey, o_orderdate from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders where o_orderdate <= timestamp '1996-06-30 00:00:00') where n = 1""")
def latest_version(spark, sf_dir):
    """The last order of each customer up to a cutoff date."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate").where(F.col("o_orderdate") <= F.lit("1996-06-30").cast("timestamp"))
    return asof.latest(rows, ["o_custkey"], F.struct("o_orderdate", "o_orderkey"))


@query("""select event_type, count(*) as n, round(min(value), 6) as least, round(median(value), 6) as median, round(list_sort(list(value))[round_even(0.9 * (count(*) - 1), 0)::int + 1], 6) as p90, round(max(value), 6) as most from events group by 1""")
def latency_statistics(spark, sf_dir):
    """Count, extremes, median and the nearest-rank p90 (banker's rounding) of each kind of call.

    A kind may hold most of all calls: its values spread over ranges, and only those at the wanted ranks meet.
    """
    events = table(spark, sf_dir, "events").select("event_type", "value")
    ranks = {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2), "p90": lambda n: F.bround(F.lit(0.9) * (n - 1)), "least": lambda n: F.lit(0), "most": lambda n: n - 1}
    rows = ordering.order_statistics(events, "event_type", "value", ranks)
    return rows.select("event_type", "n", F.round("least", 6).alias("least"), F.round((F.col("low") + F.col("high")) / 2, 6).alias("median"), F.round("p90", 6).alias("p90"), F.round("most", 6).alias("most"))


@query("""with k as (select user_id, event_type, count(*) as n, min(event_id) as first from events group by all)
select user_id, event_type as common from (select *, row_number() over (partition by user_id order by n desc, first) as r from k) where r = 1""")
def most_common_kind(spark, sf_dir):
    """The most frequent kind of each user, ties to the one seen first."""
    kinds = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("first"))
    return kinds.groupBy("user_id").agg(F.max_by("event_type", F.struct("n", (-F.col("first")).alias("f"))).alias("common"))


@query("""select source, count(*) as n, case when count(n_chars) = count(*) then sum(n_chars)::bigint end as chars, count(*) filter (quality = 0) as rejected, round(count(*) filter (quality = 0) / nullif(count(quality), 0)::double, 6) as rate from documents left join labels using (doc_id) group by 1""")
def batch_summary(spark, sf_dir):
    """Totals that are null if any part is unknown, and a rate that is null without cases."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    bad = F.count_if(F.col("quality") == 0)
    total = F.when(F.count("n_chars") == F.count("*"), F.sum("n_chars"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), total.alias("chars"), bad.alias("rejected"), F.round(bad / F.nullif(F.count("quality"), F.lit(0)), 6).alias("rate"))


@query("""select s_nationkey, list_slice(list_sort(list_distinct(list(s_name))), 1, 5) as names, round(max(s_acctbal), 2) as most, count(*) as members from supplier group by 1""")
def merged_proposals(spark, sf_dir):
    """Members of a key merged: union of names cut at five, largest value."""
    members = table(spark, sf_dir, "supplier")
    # A limit by rank is cut in each task before the names move, so no key gathers them all.
    first = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_name"))
    names = members.select("s_nationkey", "s_name").distinct().withColumn("n", first).where("n <= 5").groupBy(F.col("s_nationkey").alias("of")).agg(F.sort_array(F.collect_list("s_name")).alias("names"))
    each = members.groupBy("s_nationkey").agg(F.round(F.max("s_acctbal"), 2).alias("most"), F.count("*").alias("members"))
    return each.join(names, F.col("s_nationkey").eqNullSafe(F.col("of"))).select("s_nationkey", "names", "most", "members")


@query("""select p_partkey, p_name from part where p_partkey > 100 order by p_partkey limit 21""")
def keyset_page(spark, sf_dir):
    """F2, F8: the page after a key, one row more than the page to tell whether there is another."""
    return table(spark, sf_dir, "part").where("p_partkey > 100").orderBy("p_partkey").limit(21).select("p_partkey", "p_name")


@query("""select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING') and o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""")
def pending_targets(spark, sf_dir):
    """Rows whose key is in one set and not in another."""
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(wanted, "o_custkey", "left_semi").join(done, "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""select o_custkey, bool_and(o_orderstatus <> 'F') as all_open, count(*) as parts, count(*) filter (o_orderstatus = 'O') as supported from orders group by 1""")
def portion_coverage(spark, sf_dir):
    """Whether all parts of a plan are covered."""
    status = F.col("o_orderstatus")
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.bool_and(status != "F").alias("all_open"), F.count("*").alias("parts"), F.count_if(status == "O").alias("supported"))
