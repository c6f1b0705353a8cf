"""Column functions on text, urls and dates, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: what a token is, a run of letters, digits and underscores of any script.
TOKEN = r"[\p{L}\p{N}_]+"


def tokens(text: Column) -> Column:
    """Distinct lower-case tokens, in order of first occurrence."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0)))


def pieces(text: Column) -> Column:
    """Lower-case tokens, repeated, and perhaps an empty text at either end: half the work of tokens(), for lists that are looked up among tokens."""
    return F.split(F.lower(text), r"[^\p{L}\p{N}_]+")


def key(text: Column) -> Column:
    """White space collapsed and trimmed, lower case: the key under which labels are the same."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def is_subset(a: Column, b: Column) -> Column:
    return F.size(F.array_except(a, b)) == 0


def jaccard(a: Column, b: Column) -> Column:
    return overlap(a, b) / F.size(F.array_union(a, b))


def control_characters(text: Column) -> Column:
    """Number of control characters other than tab and line ends."""
    return F.regexp_count(text, F.lit(r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"))


def integrity_hash(text: Column) -> Column:
    """SHA-256 of the text without white space: equal for texts that differ in layout only."""
    return F.sha2(F.regexp_replace(text, r"[\s]+", "").cast("binary"), 256)


def strict_date(text: Column) -> Column:
    """The date of a YYYY-MM-DD text that names a day of the calendar; null for any other."""
    return F.when(text.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def redacted(text: Column) -> Column:
    """The text with the value of each token = "..." assignment masked."""
    return F.regexp_replace(text, r'(token\s*=\s*)"[^"]*"', r'$1"***"')


def host(url: Column) -> Column:
    """Lower-case host without a leading www., m. or port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)", 1)), r"^(www|m)\.", "")


def plain_path(path: Column) -> Column:
    """A path without empty and dot segments, ".." taken up; a slash at its end stays, and so do two at its start."""
    parts = F.filter(F.split(path, "/", -1), lambda x: ~x.isin("", "."))
    up = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, x: F.when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(x))))
    out = F.concat(F.when(path.rlike("^//(?!/)"), "//").otherwise("/"), F.array_join(up, "/"))
    return F.when(path.endswith("/") & ~out.endswith("/"), F.concat(out, F.lit("/"))).otherwise(out)


def _parts(url: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Scheme and authority in lower case, port, path and query (with its sign)."""
    plain = F.regexp_replace(url, r"(?s)#.*$", "")
    scheme = F.lower(F.regexp_extract(plain, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(plain, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1))
    rest = F.substring(plain, F.length(scheme) + F.length(authority) + 4, F.length(plain))
    return scheme, F.regexp_replace(authority, r":[0-9]*$", ""), F.regexp_extract(authority, r":([0-9]*)$", 1), F.regexp_extract(rest, r"^([^?]*)", 1), F.regexp_extract(rest, r"(?s)(\?.*)$", 1)


def normalised_url(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, dot segments resolved, a slash at the end and the query kept.

    Null for what is not an absolute http(s) url, has credentials or a port that is not its scheme's own.
    """
    scheme, name, port, path, query = _parts(url)
    own = F.when(scheme == "https", "443").otherwise("80")
    ok = scheme.isin("http", "https") & (name != "") & ~name.contains("@") & ((port == "") | (port == own))
    return F.when(ok, F.concat(scheme, F.lit("://"), name, plain_path(F.when(path == "", "/").otherwise(path)), F.when(query == "?", "").otherwise(query)))


def in_scope(url: Column, hosts: list[str], prefixes: list[str]) -> Column:
    """Whether the host is one of ``hosts``, or below one that begins with a dot, and the decoded path lies at or below one of ``prefixes``."""
    _, name, _, path, _ = _parts(url)
    at = plain_path(F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path))
    below = F.lit(False)
    for prefix in prefixes:
        stem = "/" + prefix.strip("/")
        below = below | (F.lit(True) if stem == "/" else (at == stem) | at.startswith(stem + "/"))
    listed = name.isin([h for h in hosts if h[:1] != "."])
    for domain in hosts:
        listed = listed | name.endswith(domain) if domain[:1] == "." else listed
    return listed & below


#: Languages that a url's path, or the end of its file name, may name.
PATH_LANGUAGES, SUFFIX_LANGUAGES = "de|fr|it|en|rm|ar|sq|tr|uk|ru|es|pt", "de|fr|it|en|rm|ar|sq|tr|uk|ru|es|pt|so|ta|ti|sr|hr|bs|pl|el"


def language_hint(url: Column) -> Column:
    """The language that a url names, by the suffix of a file name before a folder; null if none."""
    suffix = F.lower(F.regexp_extract(url, rf"(?i)[-_]({SUFFIX_LANGUAGES})(?:\.pdf|[-_])", 1))
    folder = F.lower(F.regexp_extract(url, rf"(?i)/({PATH_LANGUAGES})(?:/|[-_])", 1))
    return F.when(suffix != "", suffix).when(folder != "", folder)


def language_policy(declared: Column, hint: Column, named: Column, detected: Column, confidence: Column, sample: Column) -> Column:
    """Struct (language, method, flags): what the publisher says comes before what a detector gives.

    named (a language's name in the path) replaces declared and hint; a detected language counts from a confidence of
    0.9 on more than 100 characters, and needs review.
    """
    said = F.element_at(F.split(F.lower(F.regexp_replace(F.coalesce(F.when(declared != "", declared), hint, F.lit("")), "_", "-")), "-"), 1)
    said = F.coalesce(named, F.when(said != "", said))
    sure = said.isNull() & detected.isNotNull() & (confidence >= 0.9) & (F.char_length(sample) > 100)
    method = F.when(said.isNotNull(), "published-language-metadata").when(sure, "statistical-detection").otherwise("undetermined")
    flags = F.array_compact(F.array(F.when(said != detected, "declared_differs_from_detected"), F.when(sure, "inferred_language_requires_review")))
    return F.struct(F.coalesce(said, F.when(sure, detected)).alias("language"), method.alias("method"), flags.alias("flags"))


def strict_json(text: Column) -> Column:
    """The value of a JSON text as a variant; null for text that is not JSON or repeats a key, which other parsers let pass."""
    return F.try_parse_json(text)


def content_reason(path: Column, furniture: list[str], contact: list[str], news: list[str] | None = None) -> Column:
    """Why a section under the heading path ("a > b") is left out: embedded_news, page_furniture_heading, or null to keep it.

    A page whose only heading is one of ``contact`` is kept; ``news`` counts below the first heading only.
    """
    parts = F.transform(F.split(path, " > ", -1), key)
    alone = (F.size(parts) == 1) & parts[0].isin(contact)
    late = F.exists(F.slice(parts, 2, 1 << 20), lambda x: x.isin(news or []))
    return F.when(late, "embedded_news").when(~alone & F.exists(parts, lambda x: x.isin(furniture)), "page_furniture_heading")


def redacted_query(url: Column) -> Column:
    return F.regexp_replace(url, r"\?[^#]*", "?***")
