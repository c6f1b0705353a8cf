"""Batch resolution: every document asks, and a release made of the benchmark texts answers."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.operators import resolution as R
from granary.plans.registry import query, table

#: The type of a condition, and of the fields of a context.
_WHEN = "array<struct<field:string,operator:string,values:array<string>>>"
_FIELDS = "array<struct<name:string,kind:string,required:boolean,allowed:array<string>,minimum:double,maximum:double,min_length:int,max_length:int>>"


def _release(spark: SparkSession, sf_dir: str, topics: int = 25) -> R.Release:
    """Topics are the nations below their regions, each with one concept; evidence is the benchmark texts, dealt over ``topics``."""
    strings = lambda *x: F.array(*x).cast("array<string>")
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    null, n, r = F.lit(None).cast("string"), F.col("n_nationkey"), F.col("n_regionkey")
    nations = table(spark, sf_dir, "nation").select(n, r)
    entry = lambda i, kind, up: [i.alias("entry_id"), F.lit(kind).alias("kind"), up.alias("parent_ids"), F.lit("CURATED").alias("lifecycle")]
    entries = spark.range(1).select(*entry(F.lit("s"), "space", strings())).union(nations.select(r).distinct().select(*entry(text("r", r), "domain", strings(F.lit("s")))))
    entries = entries.union(nations.select(*entry(text("t", n), "topic", strings(text("r", r))))).union(nations.select(*entry(text("src", n), "concept", strings(text("t", n)))))
    canton = lambda k: F.when(k % 2 == 1, "K1").alias("canton")
    profiles = nations.select(
        text("p", n).alias("profile_id"), F.lit("s").alias("space_id"), text("r", r).alias("domain_id"), text("t", n).alias("topic_id"), F.lit("requirements").alias("intent"), strings(text("src", n)).alias("concept_ids"),
        F.lit(True).alias("needs_concepts"), F.lit("CH").alias("country"), canton(n), null.alias("municipality"), strings(F.lit("exact")).alias("scope_modes"), F.lit(0).alias("max_depth"), F.lit(5).alias("max_concepts"),
        strings(F.lit("bench")).alias("source_ids"), strings(F.lit("en")).alias("source_languages"), F.lit(None).cast("date").alias("valid_from"), F.when(n % 5 == 0, F.lit("2020-01-01").cast("date")).alias("valid_through"),
        F.lit(30).alias("max_age_days"), F.lit("ctx").alias("schema_id"), F.array(F.struct(F.lit("en").alias("term_language"), strings(F.lit("en")).alias("source_languages"))).alias("term_routes"), F.lit("APPROVED").alias("approval"),
    )
    fields = [("lang", "string", True, [], None, None, 1, None)]
    schemas = spark.createDataFrame([("ctx", fields, [], [])], f"schema_id string, fields {_FIELDS}, conditional array<struct<when:{_WHEN},required_fields:array<string>>>, consistency array<struct<left_field:string,operator:string,right_field:string>>")
    item = F.col("item_id")
    items = table(spark, sf_dir, "benchmark").withColumn("k", item % topics)
    fact = F.when(item % 40 < 20, text("f", item))
    portions = items.groupBy("k").agg(F.sort_array(F.collect_list(fact)).alias("fact_ids"), F.collect_list(text("e", item)).alias("evidence_ids"))
    portions = portions.select(text("p", F.col("k")).alias("profile_id"), text("o", F.col("k")).alias("portion_id"), strings(text("src", F.col("k"))).alias("concept_ids"), "fact_ids", strings(F.lit("de")).alias("rule_ids"), "evidence_ids")
    rules = spark.createDataFrame([("de", [("lang", "equals", ['"de"'])], [])], f"rule_id string, when {_WHEN}, fact_ids array<string>")
    facts = items.where(fact.isNotNull()).select(fact.alias("fact_id"), strings(text("e", item)).alias("evidence_ids"), F.when(item % 3 == 0, strings(F.lit("de"))).otherwise(strings()).alias("rule_ids"))
    evidence = items.select(
        text("e", item).alias("evidence_id"), "text", F.lit("bench").alias("source_id"), F.when(item % 7 == 0, "fr").otherwise("en").alias("language"), strings(text("src", F.col("k"))).alias("concept_ids"), F.lit("CH").alias("country"),
        canton(F.col("k")), null.alias("municipality"), F.lit(None).cast("date").alias("valid_from"), F.lit(None).cast("date").alias("valid_through"), F.lit("2021-06-01").cast("timestamp").alias("accessed_at"),
    )
    none = lambda schema: spark.createDataFrame([], schema)
    return R.Release("r1", entries, profiles, schemas, portions, rules, facts, evidence, none("group_id string, evidence_ids array<string>"), none("conflict_id string, fact_ids array<string>"))


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    doc, source = F.col("doc_id"), F.col("source")
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("src"), F.col("n_nationkey").cast("string")).alias("source"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("domain_id"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source").join(nations, "source", "left")
    return docs.select(
        doc.alias("request_id"), F.lit("r1").alias("release_id"), F.lit("s").alias("space_id"), "domain_id", F.regexp_replace(source, "^src", "t").alias("topic_id"), F.array(source).alias("concept_ids"), F.lit("requirements").alias("intent"),
        F.lit("CH").alias("country"), F.when(doc % 2 == 1, "K1").otherwise("K2").alias("canton"), F.lit(None).cast("string").alias("municipality"), F.when(doc % 3 == 0, "2019-06-01").otherwise("2021-06-01").cast("date").alias("as_of"),
        F.lit("exact").alias("scope_mode"), F.when(F.col("lang").isNotNull(), F.create_map(F.lit("lang"), F.concat(F.lit('"'), "lang", F.lit('"')))).alias("context"),
        F.array(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit("en").alias("language"))).alias("terms"), F.lit(None).cast("array<string>").alias("source_languages"), F.lit(None).cast("int").alias("max_evidence"),
    )


@query("""with d as (select doc_id, lang, case when source in (select concat('src', cast(n_nationkey as varchar)) from nation) then cast(substr(source, 4) as bigint) end as k from documents),
w as (select *, case when k is null then 'unknown_id' when k % 2 = 1 and doc_id % 2 = 0 then 'jurisdiction_not_covered' when k % 5 = 0 and doc_id % 3 <> 0 then 'date_outside_coverage' when lang is null then 'missing_context' end as reason from d),
n as (select doc_id, count(*) filter (item_id % 40 < 20) as facts, count(*) filter (item_id % 40 < 20 and item_id % 7 <> 0 and (item_id % 3 <> 0 or lang = 'de')) as held,
  count(*) filter (item_id % 7 <> 0 and not (item_id % 40 < 20 and item_id % 3 = 0 and lang <> 'de')) as evidence from w left join benchmark on item_id % 25 = k where reason is null group by 1)
select doc_id as request_id, case when reason = 'unknown_id' then 'INVALID_ARGUMENT' when reason = 'missing_context' then 'NEEDS_CONTEXT' when reason is not null then 'OUT_OF_COVERAGE'
 when held = 0 then 'INSUFFICIENT_VERIFIED_EVIDENCE' when held = facts then 'SUPPORTED' else 'PARTIALLY_SUPPORTED' end as status, reason, coalesce(held, 0)::int as n_facts, least(coalesce(evidence, 0), 20)::int as n_evidence
from w left join n using (doc_id)""")
def batch_resolution(spark, sf_dir):
    """2K, P2, C1-C3, C9, B5-B11, D8, D11, F5, H1, H3: one request for each document, all resolved by one batch."""
    answers = R.resolve(_release(spark, sf_dir), _requests(spark, sf_dir), F.lit("2021-06-10").cast("timestamp"))
    return answers.select("request_id", "status", "reason", F.size("fact_ids").alias("n_facts"), F.size("evidence_ids").alias("n_evidence"))


@query("""select 't' || n_nationkey as topic_id, ['requirements'] as intents, 1 as concepts, 1 as places from nation""")
def release_coverage(spark, sf_dir):
    """What the approved profiles of a release publish for each topic."""
    return R.coverage(_release(spark, sf_dir))


@query("""with d as (select doc_id, lang, case when source in (select concat('src', cast(n_nationkey as varchar)) from nation) then cast(substr(source, 4) as bigint) end as k, case when doc_id % 3 > 0 then doc_id % 25 + 1 end as asked from documents),
w as (select *, least(coalesce(asked, 20), 20) as cap, case when k is null then 'unknown_id' when asked > 20 then 'evidence_limit' when k % 2 = 1 and doc_id % 2 = 0 then 'jurisdiction_not_covered' when k % 5 = 0 and doc_id % 3 <> 0 then 'date_outside_coverage' when lang is null then 'missing_context' end as reason from d),
n as (select doc_id, count(*) filter (item_id % 40 < 20) as facts, count(*) filter (item_id % 40 < 20 and item_id % 7 <> 0 and (item_id % 3 <> 0 or lang = 'de')) as held,
  count(*) filter (item_id % 7 <> 0 and not (item_id % 40 < 20 and item_id % 3 = 0 and lang <> 'de')) as evidence from w left join benchmark on item_id % 25 = k where reason is null group by 1)
select doc_id as request_id, case when reason in ('unknown_id', 'evidence_limit') then 'INVALID_ARGUMENT' when reason = 'missing_context' then 'NEEDS_CONTEXT' when reason is not null then 'OUT_OF_COVERAGE'
 when held = 0 then 'INSUFFICIENT_VERIFIED_EVIDENCE' when least(held, cap) = facts then 'SUPPORTED' else 'PARTIALLY_SUPPORTED' end as status, reason, least(coalesce(held, 0), cap)::int as n_facts, least(coalesce(evidence, 0), cap)::int as n_evidence
from w left join n using (doc_id)""")
def whole_batch_resolution(spark, sf_dir):
    """2K, P2, F3, F5: batch_resolution with limits of evidence that the requests state, some above what a release allows."""
    doc = F.col("request_id")
    requests = _requests(spark, sf_dir).withColumn("max_evidence", F.when(doc % 3 > 0, doc % 25 + 1).cast("int"))
    answers = R.resolve(_release(spark, sf_dir), requests, F.lit("2021-06-10").cast("timestamp"))
    return answers.select("request_id", "status", "reason", F.size("fact_ids").alias("n_facts"), F.size("evidence_ids").alias("n_evidence"))


@query("""select 't' || n_nationkey as topic_id, case n_nationkey % 3 when 0 then ['deadlines', 'requirements'] else ['requirements'] end as intents, 1 as concepts, case when n_nationkey % 3 = 0 then 2 else 1 end as places from nation""")
def whole_release_coverage(spark, sf_dir):
    """The coverage of a release in which every third topic has a second profile, of another intent and place, and a draft that does not count."""
    release = _release(spark, sf_dir)
    topic = F.regexp_replace("topic_id", "t", "").cast("int")
    more = release.profiles.where(topic % 3 == 0).withColumns({"intent": F.lit("deadlines"), "canton": F.lit("K9")})
    drafts = release.profiles.withColumns({"intent": F.lit("costs"), "approval": F.lit("DRAFT")})
    return R.coverage(replace(release, profiles=release.profiles.union(more).union(drafts)))
