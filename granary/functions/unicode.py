"""Text functions that need Unicode tables which Spark lacks: Arrow batches through Python, for exact matching only.

``granary.functions.text`` has JVM forms that differ on few texts (ligatures, full-width letters, sharp s).
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from granary.functions.text import TOKEN


def _mapped(f):
    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return run


def compatible(text: Column) -> Column:
    """Compatibility form, case folded."""
    return _mapped(lambda s: unicodedata.normalize("NFKC", s).casefold())(text)


def term(text: Column) -> Column:
    """Composed form, case folded."""
    return _mapped(lambda s: unicodedata.normalize("NFC", s).casefold())(text)


def terminology_key(text: Column) -> Column:
    """Composed form in lower case, white space trimmed and collapsed."""
    return _mapped(lambda s: " ".join(unicodedata.normalize("NFC", s).lower().split()))(text)


def without_accents(text: Column) -> Column:
    """Decomposed form, case folded, without combining marks."""
    return _mapped(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s.casefold()) if not unicodedata.combining(c)))(text)


def exact_tokens(text: Column) -> Column:
    """Distinct tokens of the compatible form, in order of first occurrence; cut inside the JVM."""
    return F.array_distinct(F.regexp_extract_all(compatible(text), F.lit(TOKEN), F.lit(0)))


@F.pandas_udf(BooleanType())
def decodes(raw: pd.Series, charset: pd.Series) -> pd.Series:
    """Whether bytes are text in the named charset; false for a name that is no text encoding, null without bytes."""

    def one(data: bytes | None, name: str | None) -> bool | None:
        if data is None or name is None:
            return None
        try:
            data.decode(name)
        except (LookupError, ValueError):
            return False
        return True

    return pd.Series([one(*x) for x in zip(raw, charset, strict=True)], dtype=object)


def charset(raw: Column) -> Column:
    """The charset that the first 8,192 bytes declare, in lower case; empty if none."""
    latin = F.decode(F.substring(raw, 1, 8192), "ISO-8859-1")
    return F.lower(F.regexp_extract(latin, r"""charset\s*=\s*["']?([a-zA-Z0-9_-]+)""", 1))


def encoding(raw: Column) -> Column:
    """The encoding of bytes: by their mark, UTF-8 if they are, the charset they declare, else windows-1252; null if that can't hold them.

    A declared charset is tried on the whole text before it is believed, and only on bytes that are neither marked nor UTF-8.
    """
    head, stated = F.hex(F.substring(raw, 1, 3)), charset(raw)
    marked = head.startswith("EFBBBF") | head.startswith("FFFE") | head.startswith("FEFF")
    left = ~marked & ~F.is_valid_utf8(raw.cast("string"))
    name = F.when(stated != "", stated).otherwise("windows-1252")
    tried = decodes(F.when(left, raw), F.when(left, name))
    by_mark = F.when(head.startswith("EFBBBF"), "utf-8-sig").when(marked, "utf-16")
    return F.when(marked, by_mark).when(~left, "utf-8").when(tried, name)
