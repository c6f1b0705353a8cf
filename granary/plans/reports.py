"""Lookups, comparisons of answers, reports and plans of extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.plans.registry import query, table


@query("""with asked as (select item_id as request_id, unnest([item_id * 3, item_id, case when item_id % 8 = 7 then -1 else item_id + 1 end]) as evidence_id, unnest(range(3)) as "at" from benchmark),
f as (select request_id, "at", evidence_id, d.doc_id is null as unknown, length(d.text) as n from asked left join documents d on d.doc_id = evidence_id),
g as (select *, bool_or(unknown) over (partition by request_id) as bad from f)
select request_id, "at"::int as "at", case when not bad then evidence_id end as evidence_id, case when not bad then n end as length, case when bad then 'unknown_evidence_id' end as error from g where not bad or "at" = 0""")
def evidence_lookup(spark, sf_dir):
    """Evidence by id in the order asked for; one unknown id makes the request an error."""
    item = F.col("item_id")
    asked = table(spark, sf_dir, "benchmark").select(item.alias("request_id"), F.posexplode(F.array(item * 3, item, F.when(item % 8 == 7, -1).otherwise(item + 1))).alias("at", "evidence_id"))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), F.length("text").cast("long").alias("length"), F.lit(True).alias("known"))
    found = asked.join(docs, "evidence_id", "left").withColumn("bad", F.bool_or(F.col("known").isNull()).over(Window.partitionBy("request_id")))
    kept = [F.when(~F.col("bad"), F.col(c)).alias(c) for c in ("evidence_id", "length")]
    return found.where("not bad or `at` = 0").select("request_id", "at", *kept, F.when(F.col("bad"), "unknown_evidence_id").alias("error"))


@query("""with q as (select item_id, text, item_id % 20 as src from benchmark)
select item_id, count(*) as documents, count(*) filter (contains(d.text, q.text)) as holding, sum(case when q.text <> '' then (length(d.text) - length(replace(d.text, q.text, ''))) // length(q.text) end)::bigint as occurrences
from q join documents d on d.source = concat('src', cast(src as varchar)) where d.text is not null group by 1""")
def quote_occurrences(spark, sf_dir):
    """How often each quote stands in the documents of its source; zero, one or many decide whether it is exact."""
    quotes = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("source"))
    docs = table(spark, sf_dir, "documents").where("text is not null").select("source", "text")
    times = F.when(F.col("quote") != "", F.expr("(length(text) - length(replace(text, quote, ''))) div length(quote)"))
    both = docs.join(quotes, "source")
    return both.groupBy("item_id").agg(F.count("*").alias("documents"), F.count_if(F.col("text").contains(F.col("quote"))).alias("holding"), F.sum(times).alias("occurrences"))


@query("""with e as (select user_id, list_sort(list_distinct(list(event_type))) as kinds from events where value < 50 group by 1), p as (select user_id, list_sort(list_distinct(list(event_type))) as kinds from events where event_type <> 'error' group by 1)
select user_id, len(list_filter(e.kinds, lambda x: not coalesce(list_contains(p.kinds, x), false)))::int as extra, len(list_filter(coalesce(p.kinds, []), lambda x: not list_contains(e.kinds, x)))::int as unused from e left join p using (user_id)""")
def parity_check(spark, sf_dir):
    """What an answer holds beyond the prepared set of its key, and what of that set it leaves unused."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "value")
    got = events.where("value < 50").groupBy("user_id").agg(F.collect_set("event_type").alias("got"))
    prepared = events.where("event_type <> 'error'").groupBy("user_id").agg(F.collect_set("event_type").alias("prepared"))
    ready = F.coalesce("prepared", F.array().cast("array<string>"))
    return got.join(prepared, "user_id", "left").select("user_id", F.size(F.array_except("got", ready)).alias("extra"), F.size(F.array_except(ready, "got")).alias("unused"))


@query("""with s as (select l_orderkey, sum((l_extendedprice * 100)::bigint)::bigint as stored from lineitem group by 1), m as (select o_orderkey, (o_totalprice * 100)::bigint as computed from orders)
select count(*) as compared, count(*) filter (abs(stored - computed) > 200) as beyond, max(abs(stored - computed))::bigint as most from s join m on l_orderkey = o_orderkey""")
def score_tolerance(spark, sf_dir):
    """Two tables of scores of the same rows, compared within a tolerance."""
    cents = lambda c: F.round(F.col(c) * 100).cast("long")
    stored = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(cents("l_extendedprice")).alias("stored"))
    both = stored.join(table(spark, sf_dir, "orders").select("o_orderkey", cents("o_totalprice").alias("computed")), "o_orderkey")
    gap = F.abs(F.col("stored") - F.col("computed"))
    return both.agg(F.count("*").alias("compared"), F.count_if(gap > 200).alias("beyond"), F.max(gap).alias("most"))


@query("""select event_type as profile, user_id % 3 as repeat, count(*) as calls, round(sum(value), 4) as total, round(avg(value), 6) as mean, case when count(value) = count(*) then min(event_id) end as first from events group by all""")
def run_comparison(spark, sf_dir):
    """Sums and means of each profile and repeat."""
    runs = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("profile"), (F.col("user_id") % 3).alias("repeat"))
    return runs.agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"), F.when(F.count("value") == F.count("*"), F.min("event_id")).alias("first"))


@query("""with l as (select r_name, n_name, case when count(c_custkey) >= 60 then 'full' when count(c_custkey) > 0 then 'partial' else 'none' end as level, count(c_custkey) as n from region join nation on n_regionkey = r_regionkey left join customer on c_nationkey = n_nationkey group by all)
select r_name, level, case level when 'full' then 0 when 'partial' then 1 else 2 end as level_rank, count(*) as places, sum(n)::bigint as rows, string_agg(n_name, ', ' order by n_name) as names from l group by all""")
def coverage_report(spark, sf_dir):
    """The rows of a coverage report, places by level, with the rank that orders the levels."""
    places = table(spark, sf_dir, "region").join(table(spark, sf_dir, "nation"), F.col("n_regionkey") == F.col("r_regionkey"))
    served = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    level = F.when(n >= 60, "full").when(n > 0, "partial").otherwise("none")
    out = places.join(served, "n_nationkey", "left").groupBy("r_name", level.alias("level")).agg(F.count("*").alias("places"), F.sum(n).alias("rows"), F.array_join(F.sort_array(F.collect_list("n_name")), ", ").alias("names"))
    return out.withColumn("level_rank", F.when(F.col("level") == "full", 0).when(F.col("level") == "partial", 1).otherwise(2))


@query("""with l as (select l_orderkey, count(*) as n, sum(l_quantity)::bigint as quantity from lineitem group by 1)
select o_orderkey, case when n is null then 'empty' when quantity > 200 then 'excluded' when o_orderstatus = 'O' then 'covered' when n > 3 then 'partial' else 'open' end as status from orders left join l on l_orderkey = o_orderkey""")
def block_status(spark, sf_dir):
    """M4: what became of each block of a plan."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))
    status = F.when(F.col("n").isNull(), "empty").when(F.col("quantity") > 200, "excluded").when(F.col("o_orderstatus") == "O", "covered").when(F.col("n") > 3, "partial").otherwise("open")
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").join(lines, "o_orderkey", "left").select("o_orderkey", status.alias("status"))


@query("""select sha256(text) as digest, min(doc_id) as answer, count(*) as requests from documents where text is not null group by 1""")
def cached_answers(spark, sf_dir):
    """Requests by the digest of their content, the first of which is answered for all."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    return docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(F.min("doc_id").alias("answer"), F.count("*").alias("requests"))


@query("""with v as (select conv_id, turn, (row_number() over (partition by conv_id order by turn) - 1) // 3 as batch, (row_number() over (partition by conv_id order by turn) - 1) % 3 as local, length(text) as tokens from conversations)
select conv_id, batch, count(*) as reviewed, min(turn) as first_turn, max(local)::bigint as last_local, case when count(tokens) = count(*) then sum(tokens)::bigint end as tokens from v group by all""")
def review_batches(spark, sf_dir):
    """M8: items dealt to batches of three and numbered anew in each; a total with an unknown part is unknown."""
    at = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", at.alias("at"), F.length("text").cast("long").alias("tokens"))
    total = F.when(F.count("tokens") == F.count("*"), F.sum("tokens"))
    return rows.groupBy("conv_id", F.floor(F.col("at") / 3).alias("batch")).agg(F.count("*").alias("reviewed"), F.min("turn").alias("first_turn"), F.max(F.col("at") % 3).cast("long").alias("last_local"), total.alias("tokens"))


_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" union all ".join(f"select '{n}' as name, count(*) as n from {n}" for n in _TABLES))
def table_sizes(spark, sf_dir):
    """Rows of each table, from the footers of its files."""
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, n).agg(F.count("*").alias("n")).select(F.lit(n).alias("name"), "n") for n in _TABLES])


@query(r"""select page_id, case when url like 'http%/%.html' then 'page' when url like '%?%' then 'query' else 'other' end as shape, url like 'http%://%.example.%' as listed from pages where page_id in (select item_id from benchmark) or page_id is null""")
def asset_filter(spark, sf_dir):
    """Assets by a pattern, by a list of ids and by having none; only the columns of the index."""
    url = F.col("url")
    wanted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("page_id"))
    shape = F.when(url.like("http%/%.html"), "page").when(url.like("%?%"), "query").otherwise("other")
    rows = table(spark, sf_dir, "pages").select("page_id", shape.alias("shape"), url.like("http%://%.example.%").alias("listed"))
    return rows.join(wanted, "page_id", "left_semi").union(rows.where("page_id is null"))
