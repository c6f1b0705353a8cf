"""JSON records checked against a schema, and their canonical hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from granary.functions import json_schema
from granary.plans.registry import query, table

EVENT = {"type": "object", "required": ["k"], "additionalProperties": False, "properties": {"k": {"type": "integer", "minimum": 10, "exclusiveMaximum": 90, "enum": list(range(0, 100, 2))}}}
RECORD = {
    "type": "object",
    "required": ["doc_id", "lang", "source"],
    "properties": {
        "lang": {"enum": ["de", "en", "fr"]},
        "source": {"type": "string", "pattern": "^src[0-9]$", "minLength": 5},
        "n_chars": {"type": ["integer", "null"], "minimum": 50, "maximum": 5000},
        "lines": {"type": "array", "minItems": 2, "maxItems": 20, "uniqueItems": True, "items": {"type": "string", "maxLength": 300}},
        "label": {"type": "object", "properties": {"toxic": {"const": 0}}, "additionalProperties": {"type": "integer", "minimum": 1}},
    },
}


@query("""with k as (select event_id, json_extract_string(props, '$.k')::bigint as k from events)
select event_id, '$' as path, 'required:k' as rule from k where k is null union all select event_id, '$.k', 'minimum' from k where k < 10
union all select event_id, '$.k', 'exclusiveMaximum' from k where k >= 90 union all select event_id, '$.k', 'enum' from k where k % 2 <> 0 or k not between 0 and 98""")
def property_breaches(spark, sf_dir):
    """B7-B9, I-json: every breach of a schema by the properties of an event, with its path."""
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(json_schema.breaches(F.col("props"), EVENT)).alias("b"))
    return rows.select("event_id", "b.path", "b.rule")


@query(r"""with d as (select doc_id, lang, source, n_chars, string_split(text, chr(10)) as x, quality, toxic, l.doc_id is not null as labelled from documents left join labels l using (doc_id)),
e as (select doc_id, x[k] as line, k - 1 as at_ from (select doc_id, x, unnest(range(1, len(x) + 1)) as k from d))
select doc_id, '$' as path, 'required:lang' as rule from d where lang is null union all select doc_id, '$', 'required:source' from d where source is null
union all select doc_id, '$.lang', 'enum' from d where lang not in ('de', 'en', 'fr')
union all select doc_id, '$.source', 'pattern' from d where not regexp_matches(source, '^src[0-9]$') union all select doc_id, '$.source', 'minLength' from d where length(source) < 5
union all select doc_id, '$.n_chars', 'minimum' from d where n_chars < 50 union all select doc_id, '$.n_chars', 'maximum' from d where n_chars > 5000
union all select doc_id, '$.lines', 'minItems' from d where len(x) < 2 union all select doc_id, '$.lines', 'maxItems' from d where len(x) > 20
union all select doc_id, '$.lines', 'uniqueItems' from d where len(list_distinct(x)) < len(x)
union all select doc_id, '$.lines[' || at_ || ']', 'maxLength' from e where length(line) > 300
union all select doc_id, '$.label.toxic', 'const' from d where toxic <> 0 union all select doc_id, '$.label.quality', 'minimum' from d where quality < 1""")
def record_breaches(spark, sf_dir):
    """B7-B9, I-json: every breach of a nested schema by whole documents written as JSON records."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.struct("quality", "toxic").alias("label"))
    docs = table(spark, sf_dir, "documents").join(labels, "doc_id", "left")
    record = F.to_json(F.struct("doc_id", "lang", "source", "n_chars", F.split("text", "\n", -1).alias("lines"), "label"))
    return docs.select("doc_id", F.explode(json_schema.breaches(record, RECORD)).alias("b")).select("doc_id", "b.path", "b.rule")


@query("""select event_id, sha256('{"k":' || json_extract_string(props, '$.k') || '}') as sha256 from events""")
def property_hashes(spark, sf_dir):
    """I-json: the hash of the canonical form of the properties of each event."""
    return table(spark, sf_dir, "events").select("event_id", json_schema.canonical_sha256(F.col("props")).alias("sha256"))
