"""Document fingerprints by I-Match: sorted distinct terms of a band of document frequency, hashed over random lexicon subsets.

Terms are lower-case runs of letters, marks and digits, known by 64-bit hashes. The lexicon keeps the terms
whose inverse document frequency lies in a band: those in at least a share ``LOW`` and at most a share
``HIGH`` of all texts. A text has so many distinct terms on average, and each lexicon term lies in at least
LOW of all texts, so the lexicon holds at most 1 / LOW times that average, however large the corpus: it is
broadcast while it has ``MAX_LEXICON`` terms at most (counted), and joined by term beyond.

The distinct lexicon terms of a text are sorted and hashed, over the whole lexicon and over random subsets of
it. A subset is chosen by ``SEEDS`` seeded hashes of the term in ``LEVELS`` nested sizes (a quarter of the
lexicon, a sixteenth, ...). The fingerprint is the first hash and, for each seed, those of its non-empty subsets.
Two texts with the first hash in common have the same lexicon terms; likeness() is the share of seeds whose
smallest non-empty subsets are the same, and grows with the share of terms that the texts have in common.

A text without lexicon terms is known by all its terms, one without terms by itself, so equal texts always have
equal fingerprints. Null is the empty text. A text of any length is read whole. Rows that repeat a doc_id are
fingerprinted each by its own text; rows that repeat id and text are one document where a next one is asked
for. A null doc_id comes first in ascending order. Columns of any name stay in fingerprinted(); an empty table
gives none. Everything on rows is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.textkit import column, free, numbered, settle

LOW, HIGH = 1 / 1024, 1 / 8
SEEDS, LEVELS = 16, 5
MAX_LEXICON = 1 << 20


def whole(text: str) -> Column:
    """The column as a string, null as the empty one."""
    return F.coalesce(column(text).cast("string"), F.lit(""))


def terms(text: Column) -> Column:
    """Hashes of the distinct terms of a text, in the order of their first places."""
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{M}\p{N}]+"), lambda x: x != ""), lambda x: F.xxhash64(x)))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """term and df of the terms of docs that at least a share low and at most a share high of its rows have; settled."""
    n = docs.count()
    counts = docs.select(F.explode(terms(whole("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    return settle(counts.where((F.col("df") >= low * n) & (F.col("df") <= high * n)))


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.transform(F.array(value), f)[0]


def _hex(number: Column, digits: int) -> Column:
    return F.right(F.lpad(F.lower(F.hex(number)), 16, "0"), F.lit(digits))


def _code(kept: Column, other: Column) -> Column:
    """The fingerprint of sorted lexicon terms, or of the hash ``other`` if there are none."""
    masks = F.array(*[F.lit(4**level - 1).cast("long") for level in range(1, LEVELS + 1)])
    seeds = F.array(*[F.lit(s).cast("long") for s in range(1, SEEDS + 1)])

    def subsets(seed: Column) -> Column:
        def narrower(acc: Column, mask: Column) -> Column:
            left = F.filter(acc["left"], lambda t: F.xxhash64(seed, t).bitwiseAND(mask) == 0)
            return _once(left, lambda x: F.struct(x.alias("left"), F.when(F.size(x) > 0, F.concat(acc["out"], _hex(F.xxhash64(mask, x), 4))).otherwise(acc["out"]).alias("out")))

        return F.aggregate(masks, F.struct(kept.alias("left"), F.lit("").alias("out")), narrower, lambda acc: acc["out"])

    usual = F.concat_ws(".", _hex(F.xxhash64(kept), 16), F.array_join(F.transform(seeds, subsets), "."))
    rare = F.concat_ws(".", _hex(other, 16), F.array_join(F.transform(seeds, lambda s: _hex(F.xxhash64(s, other), 4)), "."))
    return F.when(F.size(kept) > 0, usual).otherwise(rare)


def likeness(a: Column, b: Column) -> Column:
    """The share of seeds for which the smallest non-empty subsets of two fingerprints are equal, 0 to 1."""

    def same(x: Column, y: Column) -> Column:
        return F.when((F.length(x) > 0) & (F.length(x) == F.length(y)) & (F.right(x, F.lit(4)) == F.right(y, F.lit(4))), 1).otherwise(0)

    def of_seeds(x: Column) -> Column:
        return F.slice(F.split(x, r"\.", -1), 2, SEEDS)

    return F.when(a == b, F.lit(1.0)).otherwise(F.aggregate(F.zip_with(of_seeds(a), of_seeds(b), same), F.lit(0), lambda n, x: n + x) / F.lit(float(SEEDS)))


def _signed(rows: DataFrame, keys: list[str], texts: list[str], payload: str, lex: DataFrame) -> DataFrame:
    """keys, payload and the fingerprint of each text column, under its name, for every row; the keys tell rows apart.

    The terms of a row are exploded and looked up, then gathered again by its keys. The payload travels
    on one of the row's terms only.
    """
    kind = rows.schema[payload].dataType
    found = [F.col(f"found_{i}") for i in range(len(texts))]
    rows = rows.select("*", *[terms(F.col(t)).alias(f"found_{i}") for i, t in enumerate(texts)])
    others = F.struct(*[F.when(F.size(x) > 0, F.xxhash64(F.sort_array(x))).otherwise(F.xxhash64(F.col(t))).alias(f"o{i}") for i, (x, t) in enumerate(zip(found, texts, strict=True))])
    first = F.array(F.struct(F.lit(-1).alias("of"), F.lit(None).cast("long").alias("h"), F.col(payload).alias("p"), others.alias("o")))
    none = F.lit(None).cast(f"struct<{','.join(f'o{i}:bigint' for i in range(len(texts)))}>")

    def of_text(i: int) -> Column:
        return F.transform(found[i], lambda h: F.struct(F.lit(i).alias("of"), h.alias("h"), F.lit(None).cast(kind).alias("p"), none.alias("o")))

    each = [of_text(i) for i in range(len(texts))]
    flat = rows.select(*keys, F.explode(F.concat(first, *each)).alias("x")).select(*keys, "x.of", "x.h", "x.p", "x.o")
    few = lex.count() <= MAX_LEXICON
    known = lex.select(F.col("term"))
    looked = flat.join(F.broadcast(known) if few else known, F.col("h") == F.col("term"), "left").where("term is not null or of < 0")
    gathered = looked.groupBy(*keys).agg(
        F.first("p", ignorenulls=True).alias("p"), F.first("o", ignorenulls=True).alias("o"), *[F.sort_array(F.collect_list(F.when(F.col("of") == i, F.col("term")))).alias(f"t{i}") for i in range(len(texts))]
    )
    return gathered.select(*keys, F.col("p").alias(payload), *[_code(F.col(f"t{i}"), F.col("o")[f"o{i}"]).alias(t) for i, t in enumerate(texts)])


def fingerprinted(docs: DataFrame, lex: DataFrame | None = None) -> DataFrame:
    """docs with fingerprint in place of a column of that name, over the lexicon of docs itself or a given one."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[column(c) for c in docs.columns]).alias("payload"), whole("text").alias("fingerprint"))
    signed = _signed(rows, ["row"], ["fingerprint"], "payload", lexicon(docs) if lex is None else lex)
    return signed.select(*[F.col("payload")[c].alias(c) for c in docs.columns if c.lower() != "fingerprint"], "fingerprint")


#: What tells documents apart, never null: hashes of doc_id and of the text.
KEY = ("who", "version")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text (null as empty), who and version for every row of docs."""
    return docs.select("doc_id", whole("text").alias("text"), F.xxhash64(F.col("doc_id").cast("string"), F.col("doc_id").isNull()).alias("who"), F.xxhash64(whole("text")).alias("version"))


def neighbours(docs: DataFrame) -> tuple[DataFrame, int]:
    """For each document (distinct id and text) of keyed() its doc_id, the next one in ascending order, the one before, and half the length of that; and their number.

    After the last comes the first.
    """
    keys = docs.select("doc_id", *KEY, (F.char_length("text") / 2).cast("int").alias("half")).dropDuplicates([*KEY])
    at = settle(numbered(keys, [], ["doc_id", "version"], "at"))
    n = at.count()
    turn = lambda by: F.pmod(F.col("at") + by, F.lit(max(n, 1)))
    after = at.select(turn(-1).alias("at"), *[F.col(k).alias(f"next_{k}") for k in KEY])
    before = at.select(turn(1).alias("at"), *[F.col(k).alias(f"prev_{k}") for k in KEY], F.col("half").alias("prev_half"))
    out = settle(at.join(after, "at").join(before, "at").drop("at", "half"))
    free(at)
    return out, n


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs.

    A text is edited by putting the start of the next document in place of its last half. The texts move
    once by their keys, and the start of each once to the document before; what follows stays where that puts it.
    """
    docs = keyed(docs)
    lex = lexicon(docs)
    around, n = neighbours(docs)
    repeats = docs.count() > n
    # doc_id comes from the small side, so that both uses of the texts below are one exchange of the same columns.
    rows = docs.select("text", *KEY).join(around, [*KEY])
    starts = rows.select(*[F.col(f"prev_{k}").alias(k) for k in KEY], F.left("text", F.col("prev_half")).alias("start"))
    if repeats:  # each of the rows would send its start
        starts = starts.dropDuplicates([*KEY])
    n_chars = F.char_length("text")
    both = rows.select(*KEY, "doc_id", "text", *[f"next_{k}" for k in KEY]).join(starts, [*KEY])
    edited = F.concat(F.left("text", n_chars - (n_chars / 2).cast("int")), "start")
    both = both.select(*KEY, F.monotonically_increasing_id().alias("row"), "doc_id", *[f"next_{k}" for k in KEY], n_chars.cast("long").alias("n_chars"), F.col("text").alias("a"), edited.alias("b"))
    payload = F.struct("doc_id", *[f"next_{k}" for k in KEY], "n_chars", F.unhex(F.sha2(F.col("b").cast("binary"), 256)).alias("digest")).alias("payload")
    signed = settle(_signed(both.select(*KEY, "row", payload, "a", "b"), [*KEY, "row"], ["a", "b"], "payload", lex))
    following = signed.select(*[F.col(k).alias(f"next_{k}") for k in KEY], F.col("a").alias("c"))
    if repeats:
        following = following.dropDuplicates([f"next_{k}" for k in KEY])
    flat = signed.select("payload.*", "a", "b").join(following, [f"next_{k}" for k in KEY])
    return flat.select(
        "doc_id", "n_chars", F.lower(F.hex("digest")).alias("edited_sha256"), F.col("a").alias("fingerprint"), F.col("b").alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("b")).alias("near_edited"), likeness(F.col("a"), F.col("c")).alias("near_next"),
    )
