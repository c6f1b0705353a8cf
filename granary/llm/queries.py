"""One query for each operator over its whole table, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from granary.llm import audit, decontaminate, imatch, knn, langid, linedup, mixing, neardup, periods, pii, quality, shards, tokencount


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), width=2)


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.placement(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linedup.deduplicated(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.nearest(table(spark, sf_dir, "embeddings"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = tokencount.token_lengths(table(spark, sf_dir, "documents").select("doc_id", "text"), tokencount.read_ranks(spark))
    return tokencount.limits(tokencount.histogram(lengths.drop("text")))


def op11_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.report(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.report(table(spark, sf_dir, "documents"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    f.__name__: f
    for f in (op1_decontamination, op2_quality, op3_near_duplicates, op4_sharding, op5_line_dedup, op6_mixing, op7_nearest, op8_personal_data, op9_language, op10_token_counts, op11_imatch, op12_periodic_runs, op13_filter_audit)
}

_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Queries 2, 8 and 9 train models, 10 needs a tokenizer, 4 and 11 hashes that SQL lacks, and 12 compares all pairs of words there; they are tested against plain versions and held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_decontamination": rf"""
with i as (select item_id::varchar as item, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
d as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
win as (select distinct item, size, array_to_string(w[k : k + size - 1], ' ') as s from (select item, w, least(10, len(w)) as size, unnest(range(1, len(w) - least(10, len(w)) + 2)) as k from i where len(w) > 0)),
sizes as (select distinct size from win),
spots as (select doc_id, size, k, array_to_string(w[k : k + size - 1], ' ') as s from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as k from d, sizes where len(w) >= size)),
hit as (select doc_id, k, size, item from spots join win using (size, s)),
n as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + size)) as p from hit) group by 1),
m as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as listed from (select distinct doc_id, item from hit) group by 1)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join n using (doc_id) left join m using (doc_id)""",
    "op3_near_duplicates": rf"""
with recursive d as (select doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) > 1 then list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1]) else w end) as g from d),
n as (select doc_id, count(*) as n from s group by 1),
p as (select a.doc_id as a, b.doc_id as b, count(*) as common from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * common >= 80 * (x.n + y.n - common)),
e as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as c from d union select r.doc_id, e.b from r join e on e.a = r.c)
select doc_id, coalesce(n, 0) as n_shingles, component_id, doc_id = component_id as kept from (select doc_id, min(c) as component_id from r group by 1) left join n using (doc_id)""",
    "op5_line_dedup": """
with l as (select doc_id, text, string_split(text, chr(10)) as x from documents),
w as (select doc_id, k, x[k] as a, x[k + 1] as b, x[k + 2] as c from (select doc_id, x, unnest(range(1, len(x) - 1)) as k from l)),
later as (select doc_id, k from (select *, row_number() over (partition by a, b, c order by doc_id, k) as n from w) where n > 1),
gone as (select doc_id, list(distinct j) as lines from (select doc_id, unnest(range(k, k + 3)) as j from later) group by 1)
select doc_id, case when lines is null then text else array_to_string(list_filter(x, lambda v, i: not list_contains(lines, i)), chr(10)) end as text,
coalesce(len(x), 0) as n_lines, coalesce(len(lines), 0) as n_removed from l left join gone using (doc_id)""",
    "op6_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size from documents),
s as (select source, sum(size)::bigint as source_size, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from d group by source),
o as (select *, sum(3 * source_size) over (order by 3 * source_size / weight, source rows between unbounded preceding and current row) as used, sum(weight) over () - sum(weight) over (order by 3 * source_size / weight, source rows between unbounded preceding and current row) as rest, sum(source_size) over () as total from s),
k as (select coalesce(max(used), 0) as used, coalesce(min(rest), (select sum(weight) from s)) as rest from o where 3 * source_size * (rest + weight) < weight * (total - used + 3 * source_size)),
t as (select source, source_size, least(3 * source_size::double, case when rest > 0 then weight * ((select sum(source_size) from s) - used)::double / rest else 3 * source_size::double end) as target from s, k),
r as (select d.*, source_size, target, coalesce(sum(size) over (partition by d.source order by md5('17:' || doc_id), size rows between unbounded preceding and 1 preceding), 0) as before from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target, (size * (floor(target / source_size) + case when size > 0 and before + size / 2::double <= target - floor(target / source_size) * source_size then 1 else 0 end))::bigint as taken from r""",
    "op7_nearest": """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)) as q from embeddings)
select * from (select a.vec_id as query_id, row_number() over (partition by a.vec_id order by list_dot_product(a.q, b.q) desc, b.vec_id) as rank, b.vec_id, list_dot_product(a.q, b.q)::bigint as score
from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0) where rank <= 10""",
    "op13_filter_audit": r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, coalesce(doc_id > min(doc_id) over (partition by t), false) as copied from d),
l as (select doc_id, max((quality = 1)::int) as good, max((toxic = 1)::int) as bad from labels group by 1),
m as (select part, (len(ws) < 100)::int + 2 * (100 * len(list_distinct(ws)) < 80 * len(ws))::int + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int + 16 * copied::int as mask,
 coalesce(good, 0) as good, coalesce(bad, 0) as bad from w left join l using (doc_id)),
c as (select part, mask, count(*) as n, sum(good) as good, sum(bad) as bad from m group by all),
f as (select * from (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) as v(name, bit)),
o as (select a.name || b.name || c.name || d.name || e.name as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits from f a, f b, f c, f d, f e where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5),
s as (select filter_order, k::int as step, bits[k] as bit, coalesce(list_sum(bits[1 : k - 1]), 0)::int as before from o, (select unnest(range(1, 6)) as k)),
r as (select part, filter_order, step, bit, sum(n * (mask & (before | bit) = 0)::int) as kept, sum(n * (mask & bit > 0 and mask & before = 0)::int) as removed, sum(n * (mask & bit > 0 and mask & before > 0)::int) as redundant,
 sum(n * (mask = bit)::int) as unique_fails, sum(good * (mask & bit > 0 and mask & before = 0)::int) as good_lost, sum(bad * (mask & bit > 0 and mask & before = 0)::int) as toxic_lost from c, s group by all)
select part, filter_order, step, kept::bigint as kept, removed::bigint as removed, redundant::bigint as redundant, unique_fails::bigint as unique_fails, good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
 (sum(removed) over (partition by part, bit))::bigint as shapley from r""",
}
