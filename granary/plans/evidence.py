"""Evidence spans, language and encoding of pages, pages of lists, trees, and checks of a release and its sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import spans as S
from granary.functions import text as T
from granary.functions import unicode as U
from granary.operators import checks, graph
from granary.plans.registry import query, table

_LAST = "case when strpos(reverse({s}), '{c}') > 0 then length({s}) - strpos(reverse({s}), '{c}') else -1 end"


def _texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")


@query(f"""with recursive d as (select doc_id, text, length(text) as n from documents where text <> ''),
c as (select doc_id, text, n, 0::bigint as start, 0::bigint as stop from d
 union all select doc_id, text, n, start, case when n - start <= 300 then n when {_LAST.format(s="s", c=chr(10))} >= 0 then start + 150 + {_LAST.format(s="s", c=chr(10))} when {_LAST.format(s="s", c=" ")} >= 0 then start + 150 + {_LAST.format(s="s", c=" ")} else start + 300 end
 from (select doc_id, text, n, stop as start, substr(text, stop + 151, 150) as s from c where stop < n))
select doc_id, start, stop::bigint as "end" from c where stop > 0""")
def lossless_pieces(spark, sf_dir):
    """Pieces that hold every character of a text, cut before a line end, else a space, else hard."""
    return _texts(spark, sf_dir).select("doc_id", F.explode(S.lossless(F.col("text"), 300)).alias("x")).select("doc_id", "x.start", "x.end")


@query(rf"""with recursive d as (select doc_id, text, length(text) as n from documents where text <> ''),
c as (select doc_id, text, n, 0::bigint as start, case when n <= 400 then n when {_LAST.format(s="substr(text, 201, 200)", c=" ")} >= 0 then 200 + {_LAST.format(s="substr(text, 201, 200)", c=" ")} else 400 end as stop from d
 union all select doc_id, text, n, start, case when n - start <= 400 then n when {_LAST.format(s="s", c=" ")} >= 0 then start + 200 + {_LAST.format(s="s", c=" ")} else start + 400 end
 from (select doc_id, text, n, greatest(start + 1, stop - 40) as start, substr(text, greatest(start + 1, stop - 40) + 201, 200) as s from c where stop < n)),
t as (select doc_id, start, substr(text, start + 1, stop - start) as piece from c)
select doc_id, start + length(piece) - length(regexp_replace(piece, '^\s+', '')) as start, start + length(regexp_replace(piece, '\s+$', '')) as "end" from t where regexp_matches(piece, '\S')""")
def overlapping_pieces(spark, sf_dir):
    """I8: pieces of at most 400 characters that end before a space of their second half and overlap by 40, trimmed."""
    return _texts(spark, sf_dir).select("doc_id", F.explode(S.overlapping(F.col("text"), 400, 40)).alias("x")).select("doc_id", "x.start", "x.end")


@query(r"""with p as (select doc_id, string_split(text, 'the') as parts from documents where text is not null),
k as (select doc_id, parts, unnest(range(1, len(parts))) as i from p)
select doc_id, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + 3 * (i - 1))::bigint as start from k""")
def occurrence_offsets(spark, sf_dir):
    """Every place of a quote in each text."""
    return _texts(spark, sf_dir).select("doc_id", F.explode(S.occurrences(F.col("text"), "the")).alias("x")).select("doc_id", "x.start")


#: Patterns of what evidence mentions.
_MENTIONS = {"date": r"\b(?:[0-9]{1,2}[./][0-9]{1,2}[./](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2})\b", "address": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "phone": r"\+[0-9][0-9 ()-]+[0-9]"}


@query("with " + ", ".join(f"""p{i} as (select doc_id, '{k}' as kind, string_split_regex(text, '{p}') as parts, regexp_extract_all(text, '{p}') as hits from documents where text is not null)""" for i, (k, p) in enumerate(_MENTIONS.items()))
       + ", a as (" + " union all ".join(f"select * from p{i}" for i in range(len(_MENTIONS))) + """), k as (select *, unnest(range(1, len(hits) + 1)) as i from a),
s as (select doc_id, kind, (list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0))::bigint as start, length(hits[i]) as n from k)
select doc_id, kind, start, (start + n)::bigint as "end" from s""")  # fmt: skip
def mentions(spark, sf_dir):
    """Dates, addresses and numbers that a text mentions, with their spans."""
    rows = _texts(spark, sf_dir)
    each = [rows.select("doc_id", F.lit(k).alias("kind"), F.explode(S.mentions(F.col("text"), p)).alias("x")) for k, p in _MENTIONS.items()]
    return reduce(DataFrame.unionByName, each).select("doc_id", "kind", "x.start", "x.end")


@query(rf"""with recursive d as (select doc_id, text, string_split(text, '') as x from documents where text <> ''),
c as (select doc_id, generate_subscripts(x, 1) as i, unnest(x) as ch from d),
w as (select doc_id, i, ch, lead(ch) over (partition by doc_id order by i) as after, lag(ch) over (partition by doc_id order by i) as before from c),
b as (select doc_id, i - 1 as spot from w where ch = chr(10) union select doc_id, i from w where ch in ('.', '!', '?') and (after is null or regexp_matches(after, '\s')) and not regexp_matches(before, '\s')
 union select doc_id, 0 from d union select doc_id, len(x) from d),
s as (select doc_id, spot as first, lead(spot) over (partition by doc_id order by spot) - spot as n from b),
t as (select doc_id, first, substr(text, first + 1, n) as raw from s join d using (doc_id) where n > 0),
u as (select doc_id, (first + length(raw) - length(regexp_replace(raw, '^\s+', '')))::bigint as spot, regexp_replace(regexp_replace(raw, '^\s+', ''), '\s+$', '') as said from t),
k as (select doc_id, spot, said, length(said) as n, 0::bigint as start, 0::bigint as stop from u where said <> ''
 union all select doc_id, spot, said, n, start, case when n - start <= 500 then n when {_LAST.format(s="s", c=" ")} >= 0 then start + 250 + {_LAST.format(s="s", c=" ")} else start + 500 end
 from (select doc_id, spot, said, n, stop as start, substr(said, stop + 251, 250) as s from k where stop < n)),
q as (select doc_id, spot + start as first, substr(said, start + 1, stop - start) as part from k where stop > 0),
v as (select doc_id, (first + length(part) - length(regexp_replace(part, '^\s+', '')))::bigint as start, trim(part, ' ' || chr(9)) as quote from q)
select doc_id, concat_ws(':', doc_id, start, start + length(quote)) as evidence_id, start, start + length(quote) as "end", md5(quote) as digest from v where quote <> ''""")
def evidence_spans(spark, sf_dir):
    """I9, M6 in part: each sentence, or part of at most 500 characters of a longer one, with absolute offsets, an id made of them and a digest of its quote."""
    rows = _texts(spark, sf_dir).select("doc_id", "text", F.explode(S.sentences(F.col("text"))).alias("x")).select("doc_id", "text", "x.*")
    quote = F.substring("text", F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    return rows.select("doc_id", F.concat_ws(":", "doc_id", "start", "end").alias("evidence_id"), "start", "end", F.md5(quote.cast("binary")).alias("digest"))


@query(r"""with p as (select page_id, case when page_id % 3 = 0 then '' else regexp_extract(html, '<html lang="([^"]*)"', 1) end as declared,
 lower(regexp_extract(url, '(?i)/(de|fr|it|en|rm|ar|sq|tr|uk|ru|es|pt)(?:/|[-_])', 1)) as hint, case when page_id % 5 = 0 then 'en' when page_id % 5 < 4 then 'de' end as detected, case when page_id % 2 = 0 then 0.95 else 0.5 end as conf, length(html) as n from pages),
h as (select *, coalesce(nullif(declared, ''), nullif(hint, '')) as said from p)
select page_id, nullif(hint, '') as hint, coalesce(said, case when detected is not null and conf >= 0.9 and n > 100 then detected end) as language,
case when said is not null then 'published-language-metadata' when detected is not null and conf >= 0.9 and n > 100 then 'statistical-detection' else 'undetermined' end as method,
(case when said <> detected then 1 else 0 end + case when said is null and detected is not null and conf >= 0.9 and n > 100 then 1 else 0 end)::int as flags from h""")
def page_languages(spark, sf_dir):
    """The language of each page by policy: declared, then named by the url, then detected (the detector's answers stand in by rule)."""
    page, url = F.col("page_id"), F.col("url")
    declared = F.when(page % 3 == 0, "").otherwise(F.regexp_extract("html", r'<html lang="([^"]*)"', 1))
    detected = F.when(page % 5 == 0, "en").when(page % 5 < 4, "de")
    policy = T.language_policy(declared, T.language_hint(url), F.lit(None).cast("string"), detected, F.when(page % 2 == 0, 0.95).otherwise(0.5), F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", T.language_hint(url).alias("hint"), policy.alias("p")).select("page_id", "hint", "p.language", "p.method", F.size("p.flags").alias("flags"))


@query(r"""select page_id, case when html is not null then 'utf-8' end as encoding, lower(regexp_extract(html, 'charset\s*=\s*["'']?([a-zA-Z0-9_-]+)', 1)) as declared, strlen(html)::bigint as bytes,
case when html is not null then case page_id % 6 when 0 then 'utf-8' when 1 then 'utf-8-sig' when 2 then 'utf-16' when 3 then 'iso-8859-1' when 4 then 'windows-1252' end end as made_encoding, html is null or page_id % 6 = 5 as undecodable from pages""")
def page_encodings(spark, sf_dir):
    """I16: the encoding of each page's bytes by mark, validity, declared charset (tried before it is believed) and fallback, and what it declares.

    The tables hold UTF-8 only, so the bytes are also made of each whole page by rule, in one of six forms, and found out again.
    """
    html, k, bad = F.col("html"), F.col("page_id") % 6, F.unhex(F.lit("E9"))
    raw = html.cast("binary")
    # Without a declaration the fallback is tried; it lacks some bytes that UTF-8 has, so these pages keep ASCII only.
    ascii = F.regexp_replace(F.regexp_replace(html, "(?i)charset", ""), r"[^\x00-\x7F]", "?").cast("binary")
    made = (
        F.when(k == 0, raw).when(k == 1, F.concat(F.unhex(F.lit("EFBBBF")), raw)).when(k == 2, F.concat(F.unhex(F.lit("FFFE")), F.encode(html, "UTF-16LE")))
        .when(k == 3, F.concat(bad, F.encode(F.lit("<meta charset='ISO-8859-1'>"), "UTF-8"), raw)).when(k == 4, F.concat(bad, ascii)).otherwise(F.concat(bad, F.unhex(F.lit("81")), ascii))
    )
    found = U.encoding(made)
    return table(spark, sf_dir, "pages").select("page_id", U.encoding(raw).alias("encoding"), U.charset(raw).alias("declared"), F.octet_length(html).cast("long").alias("bytes"), found.alias("made_encoding"), found.isNull().alias("undecodable"))


@query(r"""with f as (select doc_id, case doc_id % 4 when 0 then 'pdf' when 1 then 'html' when 2 then 'TXT' else 'md' end as suffix, text, coalesce(strlen(text), 0) as bytes, doc_id % 11 = 3 as flagged, doc_id % 13 = 5 as broken from documents)
select doc_id, array_to_string(list_filter([case when flagged then 'flagged' end, case when suffix = 'pdf' then 'archived_format_without_text_extractor' end, case when bytes > 3000 then 'exceeds_extraction_limit' end,
 case when broken and not flagged and suffix <> 'pdf' and bytes <= 3000 then 'requires_character_encoding_conversion' end], lambda x: x is not null), ',') as reasons from f""")
def snapshot_eligibility(spark, sf_dir):
    """All reasons for which a snapshot is not processed; its encoding is looked at only if there is no other."""
    doc = F.col("doc_id")
    suffix = F.lower(F.element_at(F.array(*[F.lit(x) for x in ("pdf", "html", "TXT", "md")]), (doc % 4 + 1).cast("int")))
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    raw = F.when(doc % 13 == 5, F.concat(F.unhex(F.lit("C3")), F.unhex(F.lit("28")), text)).otherwise(text)
    rows = table(spark, sf_dir, "documents").select("doc_id", suffix.alias("suffix"), F.octet_length(text).alias("bytes"), F.is_valid_utf8(raw.cast("string")).alias("valid"))
    early = F.array_compact(F.array(F.when(doc % 11 == 3, "flagged"), F.when(~F.col("suffix").isin("html", "htm", "txt", "md", "markdown"), "archived_format_without_text_extractor"), F.when(F.col("bytes") > 3000, "exceeds_extraction_limit")))
    late = F.when((F.size(early) == 0) & ~F.col("valid"), F.array(F.lit("requires_character_encoding_conversion"))).otherwise(early)
    return rows.select("doc_id", F.array_join(late, ",").alias("reasons"))


@query("""with s as (select s_suppkey, r_name, n_name, case s_suppkey % 4 when 0 then r_name when 1 then r_name || ' > ' || n_name when 2 then 'Kontakt' else r_name || ' > Kontakt > ' || n_name end as path from supplier join nation on s_nationkey = n_nationkey join region on r_regionkey = n_regionkey)
select s_suppkey, case when s_suppkey % 4 in (1, 3) and n_name = (select min(n_name) from nation) then 'embedded_news' when s_suppkey % 4 = 3 then 'page_furniture_heading' end as reason from s""")
def content_sections(spark, sf_dir):
    """Sections below a furniture heading are left out, a page that is a contact as a whole is kept, news counts below the first heading."""
    first = table(spark, sf_dir, "nation").agg(F.min(F.lower("n_name"))).first()[0]
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    k, sep = F.col("s_suppkey") % 4, F.lit(" > ")
    path = F.when(k == 0, F.col("r_name")).when(k == 1, F.concat("r_name", sep, "n_name")).when(k == 2, "Kontakt").otherwise(F.concat("r_name", F.lit(" > Kontakt > "), "n_name"))
    return rows.select("s_suppkey", T.content_reason(path, ["kontakt", "navigation", "suche"], ["kontakt", "contact"], [first]).alias("reason"))


@query("""select p_partkey, (select count(*) from part) as total, case when (select count(*) from part) > 60 then 60 end as next_offset from part order by p_partkey limit 20 offset 40""")
def offset_page(spark, sf_dir):
    """a page by offset with the total and the offset of the next page, null at the end."""
    part = table(spark, sf_dir, "part").select("p_partkey")
    total = part.count()
    return part.orderBy("p_partkey").offset(40).limit(20).select("p_partkey", F.lit(total).cast("long").alias("total"), F.lit(60 if total > 60 else None).cast("int").alias("next_offset"))


@query("""select o_orderkey, (select count(*) from orders where o_totalprice > 100000) as total, (select count(*) from orders where o_totalprice > 100000) > 200 as truncated from orders where o_totalprice > 100000 order by o_orderkey limit 200""")
def truncated_list(spark, sf_dir):
    """at most two hundred of a list, with how many there are and whether some are left out."""
    rows = table(spark, sf_dir, "orders").where("o_totalprice > 100000").select("o_orderkey")
    total = rows.count()
    return rows.orderBy("o_orderkey").limit(200).select("o_orderkey", F.lit(total).cast("long").alias("total"), F.lit(total > 200).alias("truncated"))


_EDGES = "edges as (select p_partkey as src, p_partkey // 2 as dst from part where p_partkey > 1 union select p_partkey, p_partkey // 3 from part where p_partkey > 2)"


def _edges(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("src"))
    return part.where("src > 1").select("src", F.expr("src div 2").alias("dst")).union(part.where("src > 2").select("src", F.expr("src div 3").alias("dst"))).distinct()


@query(f"""with recursive {_EDGES}, w as (select distinct src as start, src as node, 0 as depth from edges union select start, dst, depth + 1 from w join edges on node = src),
m as (select start, node, min(depth) as depth from w where node % 5 = 0 and node > 0 group by all)
select start, node as nearest, depth::int as depth from (select *, row_number() over (partition by start order by depth, node) as n from m) where n = 1""")
def nearest_of_kind(spark, sf_dir):
    """H2: the nearest ancestor of a kind (here keys divisible by five), itself included, by depth and then id."""
    edges = _edges(spark, sf_dir)
    return graph.nearest(edges, edges.select(F.col("src").alias("start")), (F.col("node") % 5 == 0) & (F.col("node") > 0)).select("start", F.col("node").alias("nearest"), "depth")


@query(f"""with recursive {_EDGES}, k as (select src, dst, src % 4 as kind, dst % 4 as above from edges), w as (select distinct src as start, src as node from edges union select start, dst from w join edges on node = src)
select 'parent kind' as rule, src || ':' || dst as key from k where (kind = 0 and above <> 0) or (kind = 1 and above = 3)
union all select 'several boundaries', start::varchar from w where node in (2, 3) group by start having count(distinct node) > 1""")
def catalogue_edges(spark, sf_dir):
    """H4, L3 in part: edges to a parent of a kind that is not allowed, and entries that lie below several boundaries."""
    edges = _edges(spark, sf_dir)
    kind, above = F.col("src") % 4, F.col("dst") % 4
    wrong = edges.where(((kind == 0) & (above != 0)) | ((kind == 1) & (above == 3))).select(F.lit("parent kind").alias("rule"), F.concat_ws(":", "src", "dst").alias("key"))
    # From the two boundaries down, not from every entry up; the root alone has no parents and is no entry here.
    down = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    boundaries = edges.select(F.explode(F.array("src", "dst")).alias("start")).where("start in (2, 3)")
    below = graph.reach(down, boundaries).groupBy("node").agg(F.count("*").alias("n")).where("n > 1").join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    return wrong.union(below.select(F.lit("several boundaries"), F.col("node").cast("string")))


_TREES = """o as (select o_custkey as tree, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as k, o_custkey % 6 as m from orders),
n as (select tree, case when m = 3 and k = 2 then 1 else k end as node, case when k = 1 or (m = 1 and k = 2) then null when m = 2 and k = 3 then 4 when m = 2 and k = 4 then 3 when m = 4 and k = 2 then 99 else k // 2 end as parent from o)"""


@query(f"""with recursive {_TREES}, r as (select tree, node from n where parent is null union select n.tree, n.node from r join n on n.tree = r.tree and n.parent = r.node),
s as (select tree, count(*) as nodes, count(*) filter (parent is null) as roots, count(*) - count(distinct node) as repeated, count(*) filter (parent is not null and not exists (select 1 from n x where x.tree = n.tree and x.node = n.parent)) as dangling from n group by 1),
u as (select tree, count(*) as reached from r group by 1)
select s.tree, array_to_string(list_filter([case when repeated > 0 then 'duplicate ids' end, case when roots <> 1 then 'root' end, case when dangling > 0 then 'dangling' end, case when coalesce(reached, 0) < nodes - repeated then 'unconnected' end], lambda x: x is not null), ',') as errors from s left join u using (tree)""")
def tree_verdicts(spark, sf_dir):
    """H5, L6 in part: trees of conditions with all their errors: repeated ids, no single root, parents that are not there, nodes that no root reaches (cycles too)."""
    k, m = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")), F.col("o_custkey") % 6
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("tree"), k.cast("long").alias("k"), m.alias("m"))
    k, m = F.col("k"), F.col("m")
    parent = F.when((k == 1) | ((m == 1) & (k == 2)), None).when((m == 2) & (k == 3), 4).when((m == 2) & (k == 4), 3).when((m == 4) & (k == 2), 99).otherwise(F.floor(k / 2))
    nodes = rows.select("tree", F.when((m == 3) & (k == 2), 1).otherwise(k).alias("node"), parent.alias("parent"))
    return checks.tree_errors(nodes)


@query("""with g as (select l_suppkey as grp, l_partkey as member, count(distinct l_returnflag) as flags from lineitem group by all)
select 'group overlap' as rule, member::varchar as key from g group by member having count(distinct grp) > 3 union all select 'group mixed', grp || ':' || member from g where flags > 2""")
def group_problems(spark, sf_dir):
    """G5, L2 in part: members that stand in too many groups (one is allowed where groups are disjoint; here three), and groups whose members differ in what they must share."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("grp"), F.col("l_partkey").alias("member"), F.col("l_returnflag").alias("kind"))
    return checks.violations(checks.overlapping("group overlap", rows, "grp", "member", 3), checks.mixed("group mixed", rows, ["grp", "member"], "kind", 2))


_POLICY = ["en", "de", "fr", "it", "rm"]


@query(f"""with p as (select case when doc_id % 29 = 1 and l = 1 then -doc_id else doc_id end as doc_id, case when doc_id % 23 = 5 and l = 2 then 'xx' else {_POLICY}[l] end as lang from documents, range(1, 6) r(l) where not (doc_id % 17 = 3 and l = 5)
 union all select doc_id, 'en' from documents where doc_id % 19 = 7),
g as (select doc_id // 4 as grp, doc_id as member, lang from documents where doc_id % 4 < 3)
select 'projection of unknown evidence' as rule, doc_id::varchar as key from (select distinct doc_id from p) where doc_id not in (select doc_id from documents)
union all select 'projection language', doc_id::varchar from p where lang not in ({", ".join(f"'{x}'" for x in _POLICY)})
union all select 'repeated projection', doc_id || ':' || lang from p group by doc_id, lang having count(*) > 1
union all select 'missing projection', d.doc_id::varchar from documents d left join p on p.doc_id = d.doc_id and p.lang <> 'xx' group by d.doc_id having count(distinct p.lang) < 5
union all select 'vector of unknown evidence', vec_id::varchar from embeddings where vec_id not in (select doc_id from documents)
union all select 'repeated vector', vec_id::varchar from embeddings group by vec_id having count(*) > 1
union all select 'invalid vector', vec_id::varchar from embeddings where not coalesce(len(embedding) = 64 and len(list_filter(embedding, lambda x: x <> 0)) > 0, false)
union all select 'missing vector', doc_id::varchar from documents where doc_id not in (select vec_id from embeddings)
union all select 'group scope', grp::varchar from g group by grp having count(distinct lang) > 1
union all select 'joint support', a.grp || ':' || a.member from g a join g b on a.grp = b.grp and b.member = a.member + 2 where a.member % 37 = 0
union all select distinct 'hidden conflict', a.grp::varchar from g a join g b on a.grp = b.grp and b.member = a.member + 1 where a.member % 31 = 0""")
def asset_problems(spark, sf_dir):
    """L2: retrieval assets against the evidence: projections by language and vectors known, single, well formed and complete; groups of one scope that collapse no joint support and hide no conflict.

    Documents stand for evidence and facts; projections, groups, facts of two spans and conflicts are made of their ids by rule, with breaches of each.
    """
    docs, doc = table(spark, sf_dir, "documents").select("doc_id", "lang"), F.col("doc_id")
    made = [F.struct(F.when((doc % 29 == 1) & F.lit(i == 0), -doc).otherwise(doc).alias("doc_id"), F.when((doc % 23 == 5) & F.lit(i == 1), "xx").otherwise(x).alias("lang")) for i, x in enumerate(_POLICY)]
    shown = F.when(doc % 17 == 3, F.array(*made[:4])).otherwise(F.array(*made))
    projections = docs.select(F.explode(shown).alias("x")).select("x.*").union(docs.where(doc % 19 == 7).select("doc_id", F.lit("en")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", (F.size("embedding") == 64).alias("whole"), F.exists("embedding", lambda x: x != 0).alias("some"))
    groups = docs.where(doc % 4 < 3).select(F.floor(doc / 4).alias("grp"), doc.alias("member"), "lang")
    facts = docs.where(doc % 37 == 0).select(doc.alias("fact"), F.explode(F.array(doc, doc + 2)).alias("member"))
    return checks.violations(
        checks.missing("projection of unknown evidence", projections, "doc_id", docs, "doc_id"),
        checks.broken("projection language", projections, "doc_id", "lang in ('" + "', '".join(_POLICY) + "')"),
        checks.repeated("repeated projection", projections.select(F.concat_ws(":", "doc_id", "lang").alias("key")), "key"),
        checks.incomplete("missing projection", docs, "doc_id", projections, "lang", _POLICY),
        checks.missing("vector of unknown evidence", vectors, "vec_id", docs, "doc_id"), checks.repeated("repeated vector", vectors, "vec_id"), checks.broken("invalid vector", vectors, "vec_id", "whole and some"),
        checks.missing("missing vector", docs, "doc_id", vectors, "vec_id"), checks.mixed("group scope", groups, ["grp"], "lang"),
        checks.mixed("joint support", facts.join(groups, "member"), ["grp", "fact"], "member"), checks.together("hidden conflict", docs.where(doc % 31 == 0).select(doc.alias("a"), (doc + 1).alias("b")), groups),
    )


@query(r"""with p as (select page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) as host from pages)
select 'repeated url' as rule, url as key from p group by url having count(*) > 1 union all select 'repeated id', page_id::varchar from p group by page_id having count(*) > 1
union all select 'host', page_id::varchar from p where not regexp_matches(host, '(^|\.)example\.(com|org)$') union all select 'languages', host from (select host, regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)/', 1) as lang from p) group by host having count(distinct lang) > 1""")
def registry_problems(spark, sf_dir):
    """A registry of sources: repeated urls and ids, hosts out of scope, and hosts that are listed under several languages."""
    host = F.lower(F.regexp_extract("url", r"^[a-z]+://([^/?#:]+)", 1))
    rows = table(spark, sf_dir, "pages").select("page_id", "url", host.alias("host"), F.regexp_extract("url", r"^[a-z]+://[^/]+/([a-z]+)/", 1).alias("lang"))
    return checks.violations(
        checks.repeated("repeated url", rows, "url"), checks.repeated("repeated id", rows, "page_id"),
        checks.broken("host", rows.withColumn("listed", F.col("host").rlike(r"(^|\.)example\.(com|org)$")), "page_id", "listed"), checks.mixed("languages", rows, ["host"], "lang", 1),
    )


@query(r"""with d as (select doc_id, text, lang, n_chars, count(*) over (partition by text) as copies from documents)
select doc_id, array_to_string(list_filter([case when text is null or trim(text) = '' then 'empty' end, case when length(text) < 200 then 'short' end, case when lang is null then 'language' end, case when n_chars <> length(text) then 'length' end,
 case when copies > 1 then 'repeated' end, case when contains(text, 'token') then 'secret' end], lambda x: x is not null), ',') as issues from d""")
def proposal_issues(spark, sf_dir):
    """Every issue of each item at once, in a fixed order."""
    text = F.col("text")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars", F.sha2(text.cast("binary"), 256).alias("h"))
    copied = docs.groupBy("h").count().where("count > 1").select("h", F.lit(True).alias("copied"))
    rows = docs.join(copied, "h", "left")
    issues = [("empty", text.isNull() | (F.trim(text) == "")), ("short", F.char_length(text) < 200), ("language", F.col("lang").isNull()), ("length", F.col("n_chars") != F.char_length(text)), ("repeated", F.col("copied")), ("secret", text.contains("token"))]
    return rows.select("doc_id", F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in issues])), ",").alias("issues"))


@query("""select event_id, event_id % 4 not in (1, 2) as strict, case when event_id % 4 not in (1, 2) then json_extract_string(props, '$.k')::bigint end as k from events""")
def strict_values(spark, sf_dir):
    """I-json in part: JSON that repeats a key or is cut short is no value; the rest is read by path."""
    event, props = F.col("event_id") % 4, F.col("props")
    raw = F.when(event == 1, F.concat(F.lit('{"k": 1, '), F.substring(props, 2, 10_000))).when(event == 2, F.substring(props, 1, 5)).otherwise(props)
    rows = table(spark, sf_dir, "events").select("event_id", T.strict_json(raw).alias("v"))
    return rows.select("event_id", F.col("v").isNotNull().alias("strict"), F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query("""with r as (select o_orderkey, case o_orderstatus when 'F' then 'SUPPORTED' when 'O' then 'NEEDS_CONTEXT' else 'OUT_OF_COVERAGE' end as status, count(l_linenumber) filter (l_returnflag = 'A') as facts, count(l_linenumber) as evidence, o_orderkey % 3 = 0 as missing from orders left join lineitem on l_orderkey = o_orderkey group by all)
select 'supported without facts' as rule, o_orderkey::varchar as key from r where status = 'SUPPORTED' and facts = 0 union all select 'context without missing fields', o_orderkey::varchar from r where status = 'NEEDS_CONTEXT' and not missing
union all select 'more than six evidence', o_orderkey::varchar from r where evidence > 6 union all select 'uncovered with facts', o_orderkey::varchar from r where status = 'OUT_OF_COVERAGE' and facts > 0""")
def result_invariants(spark, sf_dir):
    """L4: what must hold between the fields of an answer, as rows that break it; orders stand for answers, their lines for evidence."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") == "A").alias("facts"), F.count("*").alias("evidence"))
    status = F.when(F.col("o_orderstatus") == "F", "SUPPORTED").when(F.col("o_orderstatus") == "O", "NEEDS_CONTEXT").otherwise("OUT_OF_COVERAGE")
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", status.alias("status"), F.coalesce("facts", F.lit(0)).alias("facts"), F.coalesce("evidence", F.lit(0)).alias("evidence"), (F.col("o_orderkey") % 3 == 0).alias("missing"))
    rules = {"supported without facts": "status <> 'SUPPORTED' or facts > 0", "context without missing fields": "status <> 'NEEDS_CONTEXT' or missing", "more than six evidence": "evidence <= 6", "uncovered with facts": "status <> 'OUT_OF_COVERAGE' or facts = 0"}
    return checks.broken_rules(rows, "o_orderkey", rules)
