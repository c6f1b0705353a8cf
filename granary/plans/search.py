"""Retrieval and resolution: requests are the benchmark texts, evidence the documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.functions.text import TOKEN, tokens
from granary.functions.vectors import quantised
from granary.operators import eligibility, hybrid, retrieval
from granary.operators.tables import settle
from granary.plans.registry import query, table

TOKENS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
#: Scores of all requests and evidence that share a token.
SCORES = f"""q as (select item_id as request_id, unnest({TOKENS.format('text')}) as token from benchmark),
d as (select doc_id as evidence_id, unnest({TOKENS.format('text')}) as token from documents),
lexical as (select request_id, evidence_id, count(*) as score from q join d using (token) group by all)"""
#: Request and evidence attributes that the tables lack, by rule.
PLACES = """evidence as (select doc_id as evidence_id, lang, 'CH' as country,
  case when doc_id % 3 = 0 then null else source end as canton, case when doc_id % 6 = 1 then cast(doc_id % 4 as varchar) end as municipality,
  case when doc_id % 5 = 0 then null else doc_id % 300 end as valid_from, case when doc_id % 7 = 0 then null else doc_id % 300 + 60 end as valid_through from documents),
requests as (select item_id as request_id, case when item_id % 9 = 8 then 'LI' else 'CH' end as country, concat('src', cast(item_id % 20 as varchar)) as canton,
  case when item_id % 2 = 0 then cast(item_id % 4 as varchar) end as municipality, item_id * 7 % 330 as day, text from benchmark)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), "text")


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("evidence_id"), "text")


def _best(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    return retrieval.lexical_best(_requests(spark, sf_dir), _evidence(spark, sf_dir), k)


def _places(spark: SparkSession, sf_dir: str, *more: str | Column) -> tuple[DataFrame, DataFrame]:
    doc, item = F.col("doc_id"), F.col("item_id")
    evidence = table(spark, sf_dir, "documents").select(
        doc.alias("evidence_id"), "lang", F.lit("CH").alias("country"),
        F.when(doc % 3 != 0, F.col("source")).alias("canton"), F.when(doc % 6 == 1, (doc % 4).cast("string")).alias("municipality"),
        F.when(doc % 5 != 0, doc % 300).alias("valid_from"), F.when(doc % 7 != 0, doc % 300 + 60).alias("valid_through"), *more,
    )
    requests = table(spark, sf_dir, "benchmark").select(
        item.alias("request_id"), F.when(item % 9 == 8, "LI").otherwise("CH").alias("r_country"), F.concat(F.lit("src"), (item % 20).cast("string")).alias("r_canton"),
        F.when(item % 2 == 0, (item % 4).cast("string")).alias("r_municipality"), (item * 7 % 330).alias("day"), "text",
    )
    return requests, evidence


def _eligible(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """Country joins by key; canton is a key too wherever evidence names one, so two equi-joins cover the wildcard."""
    columns = [*requests.columns, *evidence.columns]
    named = requests.join(evidence.where("canton is not null"), (F.col("r_country") == F.col("country")) & (F.col("r_canton") == F.col("canton")))
    wide = requests.join(evidence.where("canton is null"), F.col("r_country") == F.col("country"))
    both = named.select(columns).union(wide.select(columns))
    return both.where(_may_use())


def _may_use() -> Column:
    place = eligibility.contains_place((F.col("country"), F.col("canton"), F.col("municipality")), (F.col("r_country"), F.col("r_canton"), F.col("r_municipality")))
    return place & eligibility.covers_day(F.col("valid_from"), F.col("valid_through"), F.col("day"))


ELIGIBLE = f"""{PLACES}, eligible as (select r.request_id, e.evidence_id, e.canton, e.municipality from requests r join evidence e on r.country = e.country
  and (e.canton is null or e.canton = r.canton) and (e.municipality is null or e.municipality = r.municipality)
  and (e.valid_from is null or e.valid_from <= r.day) and (e.valid_through is null or r.day <= e.valid_through))"""


@query(f"""with {SCORES} select * from (select request_id, evidence_id, score,
row_number() over (partition by request_id order by score desc, evidence_id) as rank from lexical) where rank <= 10""")
def lexical_search_topk(spark, sf_dir):
    """The ten documents with the most distinct tokens of each request."""
    return retrieval.top_k(_best(spark, sf_dir, 10), 10)


@query(f"""with {ELIGIBLE} select request_id, count(*) as n, sum(case when municipality is not null then 2 when canton is not null then 1 else 0 end)::bigint as specificity,
min(evidence_id) as first_id from eligible group by request_id""")
def eligible_evidence(spark, sf_dir):
    """Evidence whose place contains the request's and whose dates cover its day."""
    requests, evidence = _places(spark, sf_dir)
    level = eligibility.specificity(F.col("canton"), F.col("municipality"))
    return _eligible(requests, evidence).groupBy("request_id").agg(F.count("*").alias("n"), F.sum(level).alias("specificity"), F.min("evidence_id").alias("first_id"))


@query(f"""with {SCORES},
vec as (select vec_id as evidence_id, list_transform(embedding, lambda x: floor(x::double * 1000)) as v from embeddings),
concept as (select item_id as request_id, doc_id as evidence_id, 1 as score from benchmark, documents where source = concat('src', cast(item_id % 20 as varchar))),
vector as (select b.item_id as request_id, e.evidence_id, list_dot_product(a.v, e.v) as score from benchmark b join vec a on a.evidence_id = b.item_id, vec e where list_dot_product(a.v, e.v) > 0),
scored as (select request_id, 'lexical' as channel, evidence_id, cast(score as double) as score from lexical union all select request_id, 'concept', evidence_id, score from concept union all select request_id, 'vector', evidence_id, score from vector),
best as (select * from (select *, evidence_id // 2 as bucket, row_number() over (partition by request_id, channel, evidence_id // 2 order by score desc, evidence_id) as n from scored) where n = 1),
ranked as (select * from (select *, row_number() over (partition by request_id, channel order by score desc, bucket) as r from best) where r <= 20),
fused as (select request_id, bucket, round(sum(1 / (60 + r)::double), 9) as score from ranked group by all)
select * from (select *, row_number() over (partition by request_id order by score desc, bucket) as rank from fused) where rank <= 20""")
def hybrid_retrieval(spark, sf_dir):
    """2J in part, C7, C8, D7, E1, E2: lexical, concept and vector channels, one row per equivalence bucket and channel, fused by reciprocal rank."""
    requests = _requests(spark, sf_dir)
    # A bucket has two members at most, so the forty best hold the twenty best buckets.
    lexical = _best(spark, sf_dir, 40).select("request_id", F.lit("lexical").alias("channel"), "evidence_id", F.col("score").cast("double"))
    sources = requests.select("request_id", F.concat(F.lit("src"), (F.col("request_id") % 20).cast("string")).alias("source"))
    # All of a source score alike: its forty smallest ids stand for it, whoever asks.
    few = retrieval.top_k(table(spark, sf_dir, "documents").select("source", "doc_id", F.lit(1.0).alias("score")), 40, "source", "doc_id")
    concept = sources.join(few, "source").select("request_id", F.lit("concept"), "doc_id", "score")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("evidence_id"), quantised(F.col("embedding"), 1000).alias("v"))
    asked = requests.join(vectors, F.col("request_id") == F.col("evidence_id")).select("request_id", "v")
    scored = retrieval.vector_scores(asked, vectors, 40).select("request_id", F.lit("vector"), "evidence_id", "score")
    return retrieval.fused(lexical.union(concept).union(scored), F.floor(F.col("evidence_id") / 2), 20, 20)


@query(rf"""with docs as (select doc_id, text, lang, source, regexp_extract(source, '[0-9]+')::bigint as concept, {TOKENS.format("text")} as w, {TOKENS.format("string_split(text, chr(10))[1]")} as head,
  case when count(*) over (partition by text) > 1 then min(doc_id) over (partition by text) end as grp from documents where text is not null),
alias as (select source, arg_min(regexp_extract(lower(text), '[\p{{L}}\p{{N}}_]+'), doc_id) as name from docs group by 1),
req as (select item_id as request_id, {TOKENS.format("b.text")} as said, d.lang, d.source from benchmark b join docs d on d.doc_id = item_id),
vec as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1000)) as v from embeddings),
rows as (select request_id, e.doc_id as evidence_id, e.grp is not null as is_group, coalesce(e.grp, e.doc_id) as bucket, e.lang as language, len(list_intersect(said, e.w))::double / greatest(len(e.w), 1) as semantic,
  (len(list_intersect(said, e.w)) + case when e.lang = r.lang then len(list_intersect(said, e.head)) else 0 end)::double as lexical, (1 + list_contains(said, name)::int + (e.doc_id = request_id)::int)::double as concept,
  list_dot_product(a.v, b.v) as vector from req r join docs e using (source) join alias using (source) left join vec a on a.vec_id = request_id left join vec b on b.vec_id = e.doc_id),
long as (select request_id, evidence_id, is_group, bucket, 0 as channel, lexical as score from rows where lexical > 0 union all select request_id, evidence_id, is_group, bucket, 1, concept from rows union all select request_id, evidence_id, is_group, bucket, 2, vector from rows where vector > 0),
best as (select * from (select *, row_number() over (partition by request_id, channel, is_group, bucket order by score desc, evidence_id) as n from long) where n = 1),
ranked as (select * from (select *, row_number() over (partition by request_id, channel order by score desc, evidence_id) as r from best) where r <= 20),
fused as (select request_id, is_group, bucket, coalesce(sum(1 / (60 + r)::double) filter (channel = 0), 0) + coalesce(sum(1 / (60 + r)::double) filter (channel = 1), 0) + coalesce(sum(1 / (60 + r)::double) filter (channel = 2), 0) as total from ranked group by all),
let_in as (select * from (select *, row_number() over (partition by request_id order by total desc, is_group, bucket) as n from fused) where n <= 20),
given as (select request_id, evidence_id, semantic as score, is_group, bucket, language from rows join (select request_id, is_group, bucket from let_in) using (request_id, is_group, bucket)),
shown as (select *, case when is_group then first_value(evidence_id) over (partition by request_id, is_group, bucket order by score desc, language <> 'de', evidence_id) else evidence_id end as representative_id from given)
select request_id, evidence_id, score, representative_id, case when evidence_id = representative_id then row_number() over (partition by request_id, evidence_id = representative_id order by score desc, evidence_id) end as rank, score >= 0.05 as qualified from shown""")
def hybrid_retrieval_whole(spark, sf_dir):
    """2J.1-2J.9, D4, D5, C7, E1-E3: requests and what their source may give them, in three channels, fused, reranked by the share of a text that was asked for, represented by group.

    A request asks in the language and source of the document with its id; texts that are equal are equivalent; a first line is a
    projection; a source is a concept, known by the first word of its first text.
    """
    docs = table(spark, sf_dir, "documents").where("text is not null")
    number = lambda c: F.regexp_extract(c, "[0-9]+", 0).try_cast("long")
    alike = docs.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("h")).agg(F.min("doc_id").alias("grp"), F.count("*").alias("n")).where("n > 1").drop("n")
    evidence = docs.withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).join(alike, "h", "left")
    evidence = evidence.select(F.col("doc_id").alias("evidence_id"), "text", F.array(number("source")).alias("concepts"), "grp", F.col("lang").alias("language"), F.lit(None).cast("int").alias("accessed_day"))
    projections = docs.select(F.col("doc_id").alias("evidence_id"), F.col("lang").alias("language"), F.element_at(F.split("text", "\n", -1), 1).alias("text"))
    terminology = docs.groupBy("source").agg(F.min_by(F.regexp_extract(F.lower("text"), TOKEN, 0), "doc_id").alias("name")).select(number("source").alias("concept_id"), F.array("name").alias("aliases"))
    asked = table(spark, sf_dir, "benchmark").join(docs.select("doc_id", "lang", "source"), F.col("item_id") == F.col("doc_id"))
    requests = asked.select(
        F.col("item_id").alias("request_id"), F.array(F.struct("text", F.col("lang").alias("language"))).alias("terms"), F.array(number("source")).alias("selected"), F.array("item_id").alias("required"), F.lit(True).alias("configured"), F.lit(0).alias("oldest_day"),
    )
    pairs = settle(asked.select(F.col("item_id").alias("request_id"), "source").join(docs.select(F.col("doc_id").alias("evidence_id"), "source"), "source").drop("source"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", quantised(F.col("embedding"), 1000).alias("v"))
    near = pairs.join(vectors.select(F.col("vec_id").alias("request_id"), F.col("v").alias("a")), "request_id").join(vectors.select(F.col("vec_id").alias("evidence_id"), F.col("v").alias("b")), "evidence_id")
    product = F.aggregate(F.zip_with("a", "b", lambda x, y: x * y), F.lit(0.0), lambda n, x: n + x)
    near = settle(near.select("request_id", "evidence_id", product.alias("score")))
    inputs = (pairs, requests, evidence, projections, terminology, near)
    settings = hybrid.Settings(60, 20, 20, minimum_semantic=0.05)
    # Texts are read for the scores of the pairs once; all that follows has numbers only.
    rows = settle(hybrid.scored(*inputs[:5]))
    let_in = hybrid.to_rank(*inputs, settings, rows).join(evidence.select("evidence_id", tokens(F.col("text")).alias("w")), "evidence_id").join(requests.select("request_id", tokens(F.col("terms")[0]["text"]).alias("said")), "request_id")
    ranking = let_in.select("request_id", "evidence_id", (F.size(F.array_intersect("said", "w")).cast("double") / F.greatest(F.size("w"), F.lit(1))).alias("score"))
    found = hybrid.retrieve(*inputs, settle(ranking), settings, rows)
    return found.select("request_id", "evidence_id", "score", "representative_id", "rank", "qualified")


@query(f"""with {SCORES}, best as (select request_id, evidence_id // 2 as grp, evidence_id, score, evidence_id % 4 = 0 as stale, lang from lexical join documents on doc_id = evidence_id)
select request_id, grp, evidence_id as representative, members from (select *, count(*) over (partition by request_id, grp) as members,
row_number() over (partition by request_id, grp order by stale, score desc, lang <> 'de', evidence_id) as n from best) where n = 1 and members > 1""")
def representatives(spark, sf_dir):
    """The member that stands for each group of equivalent evidence: fresh first, then score, then language, then id."""
    doc = F.col("doc_id")
    stale, foreign = (doc % 4 == 0).cast("long"), F.when(F.col("lang").isNull(), 2).otherwise((F.col("lang") != "de").cast("int"))
    evidence = table(spark, sf_dir, "documents").select(doc.alias("evidence_id"), F.floor(doc / 2).alias("bucket"), stale.alias("before"), foreign.cast("long").alias("after"), "text")
    return retrieval.lexical_members(_requests(spark, sf_dir), evidence).where("members > 1").withColumnRenamed("bucket", "grp")


@query(f"""with {SCORES}, top as (select * from (select request_id, evidence_id, score, row_number() over (partition by request_id order by score desc, evidence_id) as rank from lexical) where rank <= 5),
judged as (select request_id, avg(case when evidence_id % 7 = request_id % 7 then 1.0 else 0.0 end) as precision_at_5, max(case when evidence_id % 7 = request_id % 7 then 1 else 0 end) as hit from top group by 1)
select count(*) as requests, round(avg(precision_at_5), 6) as mean_precision, round(avg(hit), 6) as hit_rate, coalesce(bool_and(precision_at_5 >= 0.2), false) as gate from judged""")
def retrieval_metrics(spark, sf_dir):
    """D20 in part: precision at five and hit rate over the requests with a match, and whether each has one good document of five (retrieval_evaluation has all measures)."""
    good = (F.col("evidence_id") % 7 == F.col("request_id") % 7).cast("int")
    judged = retrieval.top_k(_best(spark, sf_dir, 5), 5).groupBy("request_id").agg(F.avg(good).alias("p"), F.max(good).alias("hit"))
    return judged.agg(F.count("*").alias("requests"), F.round(F.avg("p"), 6).alias("mean_precision"), F.round(F.avg("hit"), 6).alias("hit_rate"), F.coalesce(F.bool_and(F.col("p") >= 0.2), F.lit(False)).alias("gate"))


@query(f"""with recursive {ELIGIBLE}, {SCORES}, gold as (select request_id, evidence_id, lang as grp, evidence_id % 5 as fact from eligible join evidence using (evidence_id) where evidence_id % 7 = request_id % 7),
ranked as (select * from (select request_id, evidence_id, row_number() over (partition by request_id order by score desc, evidence_id) as rank from lexical) where rank <= 20),
got as (select request_id, count(distinct g.grp) as groups, count(distinct g.grp) filter (rank <= 5) as final_groups, count(distinct g.fact) filter (rank <= 5) as facts, count(*) filter (rank <= 5) as finals,
  count(g.evidence_id) filter (rank <= 5) as good, count(*) filter (e.evidence_id is null) as leakage from ranked r left join gold g using (request_id, evidence_id) left join eligible e using (request_id, evidence_id) group by 1),
asked as (select request_id, count(distinct grp) as all_groups, count(distinct fact) as all_facts from gold group by 1),
judged as (select coalesce(groups / nullif(all_groups, 0)::double, 0) as recall, coalesce(final_groups / nullif(all_groups, 0)::double, 0) as held, coalesce(facts / nullif(all_facts, 0)::double, 0) as fact_recall,
  coalesce(good / nullif(finals, 0)::double, 0) as precision, coalesce(leakage, 0) as leakage from requests left join got using (request_id) left join asked using (request_id)),
tested as (select *, recall = 1 and held = 1 and fact_recall = 1 and leakage = 0 and precision >= 0.2 as passed from judged)
select count(*) as requests, round(avg(recall), 6) as recall_at_20, round(avg(fact_recall), 6) as fact_recall_at_5, round(avg(precision), 6) as precision_at_5, sum(leakage)::bigint as leakage,
round(avg((precision > 0)::int), 6) as hit_rate, count(*) filter (passed) as passed, coalesce(bool_and(passed), false) as gate from tested""")
def retrieval_evaluation(spark, sf_dir):
    """Recall at 20 over groups, fact recall, precision at five, leakage and the gate over all requests, matched or not.

    The tables lack gold labels: a request's relevant evidence is the eligible with its remainder by 7, its groups are their languages, its facts their remainders by 5.
    """
    requests, evidence = _places(spark, sf_dir)
    pairs = _eligible(requests.drop("text"), evidence).select("request_id", "evidence_id", "lang")
    gold = pairs.where("evidence_id % 7 = request_id % 7").select("request_id", "evidence_id", F.col("lang").alias("grp"), (F.col("evidence_id") % 5).alias("fact"))
    each = retrieval.evaluated(requests, retrieval.top_k(_best(spark, sf_dir, 20), 20), gold, pairs, 0.2)
    mean = lambda c: F.round(F.avg(c), 6)
    return each.agg(
        F.count("*").alias("requests"), mean("recall").alias("recall_at_20"), mean("fact_recall").alias("fact_recall_at_5"), mean("precision").alias("precision_at_5"), F.sum("leakage").alias("leakage"),
        mean(F.col("hit").cast("int")).alias("hit_rate"), F.count_if("passed").alias("passed"), F.coalesce(F.bool_and("passed"), F.lit(False)).alias("gate"),
    )


@query("""with r as (select item_id, item_id % 5 as concept, concat('src', cast(item_id % 25 as varchar)) as canton, item_id % 4 as mode, item_id * 7 % 330 as day from benchmark),
p as (select n_nationkey as profile_id, n_nationkey % 6 as concept, case when n_nationkey % 2 = 0 then concat('src', cast(n_nationkey as varchar)) end as canton, n_nationkey % 3 as mode, n_nationkey * 10 as first_day, n_nationkey * 10 + 200 as last_day from nation),
m as (select item_id, profile_id, p.concept = r.concept as c1, p.canton is null or p.canton = r.canton as c2, p.mode = r.mode as c3, first_day <= day and day <= last_day as c4, case when p.canton is null then 0 else 1 end as spec from r, p),
s as (select item_id, bool_or(c1) as a, bool_or(c1 and c2) as b, bool_or(c1 and c2 and c3) as c, bool_or(c1 and c2 and c3 and c4) as d from m group by 1),
w as (select item_id, min(profile_id) as profile_id, count(*) as n from (select *, max(spec) over (partition by item_id) as top from m where c1 and c2 and c3 and c4) where spec = top group by 1)
select s.item_id as request_id, case when not a then 'concepts' when not b then 'jurisdiction' when not c then 'mode' when not d then 'date' when n > 1 then 'ambiguous' else 'ready' end as status, coalesce(case when n = 1 then profile_id end, -1)::bigint as profile_id from s left join w using (item_id)""")
def profile_resolution(spark, sf_dir):
    """2K, C9, B11: the narrowest profile of each request, or the first dimension in which all profiles fail."""
    item, n = F.col("item_id"), F.col("n_nationkey")
    requests = table(spark, sf_dir, "benchmark").select(item.alias("request_id"), (item % 5).alias("r_concept"), F.concat(F.lit("src"), (item % 25).cast("string")).alias("r_canton"), (item % 4).alias("r_mode"), (item * 7 % 330).alias("day"))
    profiles = table(spark, sf_dir, "nation").select(n.cast("long").alias("profile_id"), (n % 6).alias("concept"), F.when(n % 2 == 0, F.concat(F.lit("src"), n.cast("string"))).alias("canton"), (n % 3).alias("mode"), (n * 10).alias("first_day"), (n * 10 + 200).alias("last_day"))
    place = F.col("canton").isNull() | (F.col("canton") == F.col("r_canton"))
    mode, day = F.col("mode") == F.col("r_mode"), F.col("day").between(F.col("first_day"), F.col("last_day"))
    met = requests.join(profiles, F.col("concept") == F.col("r_concept"), "left").withColumn("spec", F.when(F.col("canton").isNull(), 0).otherwise(1))
    there = F.col("profile_id").isNotNull()
    fits = there & place & mode & day
    best = F.max(F.when(fits, F.col("spec")))
    seen = met.groupBy("request_id").agg(
        F.max(there).alias("a"), F.max(there & place).alias("b"), F.max(there & place & mode).alias("c"), F.max(fits).alias("d"), best.alias("top"),
        *[F.count_if(fits & (F.col("spec") == s)).alias(f"n{s}") for s in (0, 1)], *[F.min(F.when(fits & (F.col("spec") == s), F.col("profile_id"))).alias(f"p{s}") for s in (0, 1)],
    )
    n_top = F.when(F.col("top") == 1, F.col("n1")).otherwise(F.col("n0"))
    failed = eligibility.first_failure(("concepts", F.col("a")), ("jurisdiction", F.col("b")), ("mode", F.col("c")), ("date", F.col("d")), ("ambiguous", n_top <= 1))
    chosen = F.when(F.col("d") & (n_top == 1), F.when(F.col("top") == 1, F.col("p1")).otherwise(F.col("p0")))
    return seen.select("request_id", F.coalesce(failed, F.lit("ready")).alias("status"), F.coalesce(chosen, F.lit(-1)).cast("long").alias("profile_id"))


@query(f"""with recursive {ELIGIBLE}, {SCORES},
ranked as (select request_id, evidence_id, row_number() over (partition by request_id order by score desc, evidence_id) as n from lexical join eligible using (request_id, evidence_id)),
walk as (select request_id, 0::bigint as n, []::bigint[] as ids, []::bigint[] as refs from (select distinct request_id from ranked)
 union all select w.request_id, w.n + 1, case when ok then list_append(ids, r.evidence_id) else ids end, case when ok then joined else refs end
 from walk w join (select *, evidence_id // 3 as ref from ranked) r on r.request_id = w.request_id and r.n = w.n + 1,
 lateral (select list_distinct(list_append(w.refs, r.ref)) as joined, len(list_distinct(list_append(w.refs, r.ref))) <= 8 and len(w.ids) < 50 as ok) x)
select request_id, len(ids) as n_selected, list_sum(ids)::bigint as id_sum, case when len(ids) >= 8 then 'supported' else 'partial' end as status
from (select *, max(n) over (partition by request_id) as last from walk) where n = last""")
def grounded_selection(spark, sf_dir):
    """2K, F5, D11: eligible documents by score, taken greedily while their distinct references stay within eight, at most fifty of them."""
    requests, evidence = _places(spark, sf_dir, "text", F.floor(F.col("doc_id") / 3).cast("long").alias("ref"))
    taken = retrieval.lexical_within_references(requests, evidence, _may_use(), 8, 50).groupBy("request_id").agg(F.count("*").alias("n_selected"), F.sum("evidence_id").alias("id_sum"))
    return taken.withColumn("status", F.when(F.col("n_selected") >= 8, "supported").otherwise("partial"))


@query("""with terms as (select item_id, unnest(string_split(lower(text), ' ')) as w from benchmark), alias as (select r_regionkey, lower(r_name) as name from region)
select item_id as request_id, count(*) as n_words, count(distinct w) as n_distinct, count(alias.name) as n_alias from terms left join alias on w = name group by 1""")
def term_expansion(spark, sf_dir):
    """C6, 2J.3: words of each request and how many of them terminology knows; the terminology is the small side."""
    words = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("request_id"), F.explode(F.split(F.lower("text"), " ")).alias("w"))
    alias = table(spark, sf_dir, "region").select(F.lower("r_name").alias("name"))
    out = words.join(alias, F.col("w") == F.col("name"), "left").groupBy("request_id")
    return out.agg(F.count("*").alias("n_words"), F.count_distinct("w").alias("n_distinct"), F.count("name").alias("n_alias"))


@query(f"""with label as (select doc_id as evidence_id, unnest({TOKENS.format("string_split(text, chr(10))[1]")}) as token from documents), body as (select doc_id as evidence_id, unnest({TOKENS.format("text")}) as token from documents),
q as (select item_id as request_id, unnest({TOKENS.format("text")}) as token from benchmark),
s as (select request_id, evidence_id, 3 as w from q join label using (token) union all select request_id, evidence_id, 1 from q join body using (token)),
t as (select request_id, evidence_id, sum(w)::bigint as score from s group by all)
select * from (select *, row_number() over (partition by request_id order by score desc, evidence_id) as rank from t) where rank <= 10""")
def label_body_search(spark, sf_dir):
    """the ten best by three times the tokens shared with the label and once those shared with the body."""
    docs = table(spark, sf_dir, "documents")
    said = docs.select(F.col("doc_id").alias("evidence_id"), "text", F.element_at(F.split("text", "\n", -1), 1).alias("label"))
    return retrieval.top_k(retrieval.lexical_best(_requests(spark, sf_dir), said, 10, 3), 10)


@query("""with v as (select vec_id, list_transform(embedding, lambda x: floor(x::double * 1000)) as v from embeddings),
q as (select item_id as request_id, unnest([item_id, item_id + 1, item_id + 7]) as vec_id from benchmark), a as (select request_id, v from q join v using (vec_id)),
s as (select request_id, v.vec_id as evidence_id, max(list_dot_product(a.v, v.v)) as score from a, v group by all having max(list_dot_product(a.v, v.v)) > 0)
select * from (select *, row_number() over (partition by request_id order by score desc, evidence_id) as rank from s) where rank <= 10""")
def several_vectors(spark, sf_dir):
    """Requests of three query vectors each; evidence counts by the best of them."""
    item = F.col("item_id")
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("evidence_id"), quantised(F.col("embedding"), 1000).alias("v"))
    asked = table(spark, sf_dir, "benchmark").select(item.alias("request_id"), F.explode(F.array(item, item + 1, item + 7)).alias("evidence_id")).join(vectors, "evidence_id").select("request_id", "v")
    return retrieval.top_k(retrieval.vector_scores(asked, vectors, 10), 10)


@query(f"""with d as (select doc_id, {TOKENS.format("text")} as w from documents where text is not null), a as (select item_id as alias_id, {TOKENS.format("text")} as t from benchmark)
select doc_id, count(*) as n_alias, min(alias_id)::bigint as first from d join a on list_has_all(w, t) where len(t) > 0 group by 1""")
def alias_expansion(spark, sf_dir):
    """Aliases all of whose tokens a text has: only texts with an alias's rarest token are tested as a whole."""
    names = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("alias_id"), tokens(F.coalesce("text", F.lit(""))).alias("t")).where(F.size("t") > 0)
    words = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", tokens(F.col("text")).alias("w"))
    single, wanted = words.select("doc_id", F.explode("w").alias("token")), names.select("alias_id", F.explode("t").alias("token"))
    n = single.join(wanted.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    rarest = wanted.join(n, "token", "left").groupBy("alias_id").agg(F.min_by("token", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("token"))
    met = single.join(rarest, "token").select("doc_id", "alias_id").join(names, "alias_id").join(words, "doc_id")
    return met.where(F.size(F.array_except("t", "w")) == 0).groupBy("doc_id").agg(F.count("*").alias("n_alias"), F.min("alias_id").alias("first"))


@query(rf"""select doc_id, len({TOKENS.format('text')}) as n_tokens from documents where text is not null""")
def token_sets(spark, sf_dir):
    """Distinct tokens of each document."""
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("n_tokens"))
