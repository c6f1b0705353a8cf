"""Acquisition and extraction ledgers: links, classifiers, jobs, chunks, trees."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from granary.functions.text import integrity_hash
from granary.operators import dedup
from granary.plans.registry import query, table


def first_match(text: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first rule whose pattern the text has."""
    out = None
    for name, pattern in rules:
        out = F.when(text.rlike(pattern), name) if out is None else out.when(text.rlike(pattern), name)
    return out.otherwise(otherwise)


@query(r"""with l as (select page_id, unnest(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))) as target from pages)
select target, count(*) as n_pages, min(page_id) as first_page from l group by 1""")
def link_catalogue(spark, sf_dir):
    """Link targets with the pages that name them."""
    targets = F.array_distinct(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1)))
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(targets).alias("target"))
    return links.groupBy("target").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"))


@query(r"""select case when regexp_matches(url, '^https?://m\.') then 'mobile' when regexp_matches(url, '^https?://blog\.') then 'blog' when contains(url, '?') then 'query' when contains(url, '#') then 'fragment' else 'plain' end as category, count(*) as n from pages group by 1""")
def classified_targets(spark, sf_dir):
    """Targets by the first rule that fits."""
    rules = [("mobile", r"^https?://m\."), ("blog", r"^https?://blog\."), ("query", r"\?"), ("fragment", "#")]
    return table(spark, sf_dir, "pages").groupBy(first_match(F.col("url"), rules, "plain").alias("category")).agg(F.count("*").alias("n"))


@query(r"""select min(doc_id) over (partition by md5(regexp_replace(text, '\s+', '', 'g'))) as job, doc_id from documents where text is not null""")
def work_list(spark, sf_dir):
    """One job for each content, as rows of the job and a document that waits for it."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", integrity_hash(F.col("text")).alias("h"))
    return dedup.duplicate_of(docs, F.col("h"), "doc_id").select(F.col("first").alias("job"), "doc_id")


@query("""select doc_id, k as chunk, k * 450 as start, least(k * 450 + 500, length(text)) as "end" from (select doc_id, text, unnest(range(0, greatest(1, ceil((length(text) - 50) / 450.0)::bigint))) as k from documents where length(text) > 0)""")
def overlapping_chunks(spark, sf_dir):
    """I8 in part: windows of 500 code points that overlap by 50; overlapping_pieces ends them at spaces."""
    n = F.char_length("text")
    count = F.greatest(F.lit(1), F.ceil((n - 50) / 450))
    rows = table(spark, sf_dir, "documents").where("length(text) > 0").select("doc_id", n.cast("long").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), count.cast("long") - 1)).alias("chunk"))
    return rows.select("doc_id", "chunk", (F.col("chunk") * 450).alias("start"), F.least(F.col("chunk") * 450 + 500, "n").alias("end"))


@query(r"""with s as (select doc_id, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) as t from documents)
select doc_id, count(*) as sentences, max(length(t)) as longest, count(*) filter (length(t) > 500) as too_long from s group by 1""")
def sentence_catalogue(spark, sf_dir):
    """Sentences of each document and which are too long for evidence."""
    s = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(r"[^.!?\n]+[.!?]*"), F.lit(0))).alias("t"))
    n = F.char_length("t")
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(n).cast("long").alias("longest"), F.count_if(n > 500).alias("too_long"))


@query("""with t as (select o_custkey as tree, o_orderkey as node, case when row_number() over (partition by o_custkey order by o_orderkey) > 1 + o_custkey % 2 then min(o_orderkey) over (partition by o_custkey) end as parent from orders),
r as (select tree, count(*) as nodes, count(*) filter (parent is null) as roots from t group by 1)
select tree, nodes, case when roots = 1 then 'valid' else 'several roots' end as verdict from r""")
def condition_trees(spark, sf_dir):
    """H5 in part: trees of conditions must have one root; tree_verdicts tests the rest."""
    by = Window.partitionBy("o_custkey")
    at = F.row_number().over(by.orderBy("o_orderkey"))
    trees = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tree"), F.when(at > 1 + F.col("o_custkey") % 2, F.min("o_orderkey").over(by)).alias("parent"))
    found = trees.groupBy("tree").agg(F.count("*").alias("nodes"), F.count_if(F.col("parent").isNull()).alias("roots"))
    return found.select("tree", "nodes", F.when(F.col("roots") == 1, "valid").otherwise("several roots").alias("verdict"))


@query("""select d.doc_id, d.lang, l.quality is not null as labelled, coalesce(e.label, -1) as label, b.item_id is not null as in_benchmark
from documents d left join labels l using (doc_id) left join embeddings e on e.vec_id = d.doc_id left join benchmark b on b.item_id = d.doc_id""")
def document_links(spark, sf_dir):
    """What other tables know of each document; every row stays."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    out = docs.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    out = out.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label"), "doc_id", "left")
    out = out.join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "item_id"), "doc_id", "left")
    return out.select("doc_id", "lang", F.col("quality").isNotNull().alias("labelled"), F.coalesce("label", F.lit(-1)).alias("label"), F.col("item_id").isNotNull().alias("in_benchmark"))


@query("""with t as (select source, doc_id, lang, length(text) as n, max(length(text)) over (partition by source) as top from documents)
select source, count(*) filter (n = top) as tied, case when count(*) filter (n = top) = 1 then 'highest score' when count(distinct case when n = top then lang end) > 1 then 'preferred language' else 'smallest id' end as reason from t group by 1""")
def selection_reasons(spark, sf_dir):
    """Why one of a group was taken: alone at the top, by language, or by id."""
    n = F.length("text")
    rows = table(spark, sf_dir, "documents").select("source", "lang", (n == F.max(n).over(Window.partitionBy("source"))).alias("top"))
    tied, langs = F.count_if("top"), F.count_distinct(F.when(F.col("top"), F.col("lang")))
    reason = F.when(tied == 1, "highest score").when(langs > 1, "preferred language").otherwise("smallest id")
    return rows.groupBy("source").agg(tied.alias("tied"), reason.alias("reason"))


@query("""with need as (select unnest(['signup', 'view', 'purchase']) as kind), have as (select distinct user_id, day(ts) as day, event_type from events), u as (select distinct user_id, day from have)
select user_id, day, count(*) as n_missing, string_agg(kind, ',' order by kind) as missing from u, need where not exists (select 1 from have h where h.user_id = u.user_id and h.day = u.day and h.event_type = kind) group by 1, 2""")
def missing_context(spark, sf_dir):
    """Required fields that a context lacks, merged to one row."""
    need = F.array(*[F.lit(k) for k in ("purchase", "signup", "view")])
    have = table(spark, sf_dir, "events").groupBy("user_id", F.dayofmonth("ts").cast("long").alias("day")).agg(F.collect_set("event_type").alias("have"))
    lacks = have.select("user_id", "day", F.array_except(need, "have").alias("m")).where(F.size("m") > 0)
    return lacks.select("user_id", "day", F.size("m").cast("long").alias("n_missing"), F.array_join(F.sort_array("m"), ",").alias("missing"))


@query(r"""select page_id, regexp_matches(regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1), '(^|\.)example\.(org|net)$') as listed from pages""")
def listed_hosts(spark, sf_dir):
    """Hosts on an allow-list, with their subdomains and nothing that only ends alike."""
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#:]+)", 1)
    return table(spark, sf_dir, "pages").select("page_id", host.rlike(r"(^|\.)example\.(org|net)$").alias("listed"))


@query("""select user_id, min(ts) as oldest, min(ts) < (select max(ts) from events) - interval 20 day as stale from events group by 1""")
def staleness(spark, sf_dir):
    """The oldest access of each user and whether it lies more than 20 days before the newest of all."""
    events = table(spark, sf_dir, "events")
    now = events.agg(F.max("ts")).first()[0]
    oldest = F.min("ts")
    limit = F.lit(now).cast(events.schema["ts"].dataType) - F.expr("interval 20 days")
    return events.groupBy("user_id").agg(oldest.alias("oldest"), (oldest < limit).alias("stale"))


@query("""with l as (select doc_id, lang, string_split(text, chr(10))[1] as label from documents where text is not null)
select md5(label) as k, coalesce(min(doc_id) filter (lang = 'en'), min(doc_id)) as chosen, count(distinct lang) as langs from l group by label""")
def preferred_labels(spark, sf_dir):
    """Of all rows of a label the English one, else the first."""
    rows = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "lang", F.element_at(F.split("text", "\n", -1), 1).alias("label"))
    chosen = F.coalesce(F.min(F.when(F.col("lang") == "en", F.col("doc_id"))), F.min("doc_id"))
    return rows.groupBy("label").agg(chosen.alias("chosen"), F.count_distinct("lang").alias("langs")).select(F.md5(F.col("label").cast("binary")).alias("k"), "chosen", "langs")
