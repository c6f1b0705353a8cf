"""Filter interaction audit: what each of five filters removes, in every order, by fingerprint-routed exact copies.

Filters, on words between white space: A few words, B few distinct words, C many capitals, D signs of code or
tables, E a copy of a text with a smaller doc_id. A document's failures are a mask of five bits, from which every
order follows: documents are counted by (part, mask) once, and all 120 orders are read off those counts.

E needs the whole table. Each text is routed by its xxhash to one of the shuffle's partitions, where the texts
of one hash form a chain: texts are compared whole, each keeps its smallest id, and every row with a larger
one is sent on as a copy. This is done twice. Before the shuffle each task plays its own rows against each other, in
chains of at most ``HELD`` bytes of text, so of a group of copies of any size at most a row for each task and
flush is sent; after it rows arrive sorted by hash (Spark spills that sort), so a task holds one chain at a time.
What is known to be a copy travels without its text.

Null is the empty text, and empty texts are copies of each other. A null doc_id is no smaller id and has none before it:
its row neither makes a copy nor is one. Rows that repeat doc_id and text stand or fall together and travel as a count. A document has
quality or toxic 1 if any of its labels says so; labels without doc_id count for none. A null lang is the empty part. Texts of any
length are read whole. Columns of any name stay in masks(); an empty table gives no row.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import xxhash
from pyspark import RDD
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.textkit import settle

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
#: Bytes of text that a task holds in chains before the shuffle.
HELD = 32 << 20

_CAPITALS, _SIGNS = bytes(range(0x41, 0x5B)), b"#$%&*|"
_COPY = 1 << FILTERS.index("E")

#: The rows of one text and id on their way, as (doc_id, lang, mask) -> how often.
Rows = dict[tuple, int]


def text_mask(raw: bytes, n_chars: int) -> int:
    """The failures A to D of a text, given as UTF-8 and with its code points."""
    words = raw.split()  # of bytes: between ASCII white space only
    few = len(words) < 100
    alike = 100 * len(set(words)) < 80 * len(words)
    capital = 100 * (len(raw) - len(raw.translate(None, _CAPITALS))) > 10 * n_chars
    signs = len(raw.translate(None, _SIGNS)) < len(raw)
    return few | alike << 1 | capital << 2 | signs << 3


def added(to: Rows, more: Rows) -> None:
    for row, n in more.items():
        to[row] = to.get(row, 0) + n


def play(chain: list, text: bytes, doc_id, rows: Rows) -> Rows:
    """Enter the rows of (text, doc_id) into the chain of its hash, entries [text, smallest id, rows]; the rows that turn out to be copies."""
    for entry in chain:
        if entry[0] == text:
            if doc_id == entry[1]:
                added(entry[2], rows)
                return {}
            lost, kept = (rows, entry[2]) if entry[1] < doc_id else (entry[2], rows)
            entry[1], entry[2] = min(entry[1], doc_id), kept
            return {(i, lang, mask | _COPY): n for (i, lang, mask), n in lost.items()}
    chain.append([text, doc_id, dict(rows)])
    return {}


def _before(limit: int) -> Callable[[Iterator], Iterator]:
    """(doc_id, lang, text) to (hash, (text or None, doc_id, rows)): a task's own rows against each other.

    Rows that need no text any more go by a hash of their own, equal ones together.
    """

    def routed(rows: Iterator) -> Iterator:
        chains: dict[int, list] = {}
        done: Rows = {}
        held = 0

        def sent() -> Iterator:
            for row, n in done.items():
                yield xxhash.xxh64_intdigest(repr(row)), (None, None, {row: n})
            for h, chain in chains.items():
                for entry in chain:
                    yield h, tuple(entry)

        for doc_id, lang, text in rows:
            text = text or ""
            raw = text.encode()
            row = {(doc_id, lang, text_mask(raw, len(text))): 1}
            if doc_id is None:
                added(done, row)
                held += 100
            else:
                chain = chains.setdefault(xxhash.xxh64_intdigest(raw), [])
                known = len(chain)
                added(done, play(chain, raw, doc_id, row))
                held += len(raw) + 200 if len(chain) > known else 100
            if held > limit:
                yield from sent()
                chains, done, held = {}, {}, 0
        yield from sent()

    return routed


def _after(records: Iterator) -> Iterator[tuple]:
    """Rows of (hash, entry) records sorted by hash: the chains of all tasks against each other, one hash at a time."""

    def each(rows: Rows) -> Iterator[tuple]:
        for row, n in rows.items():
            yield from itertools.repeat(row, n)

    current, chain = None, []
    for h, (text, doc_id, rows) in records:
        if text is None:
            yield from each(rows)
            continue
        if h != current:
            for entry in chain:
                yield from each(entry[2])
            current, chain = h, []
        yield from each(play(chain, text, doc_id, rows))
    for entry in chain:
        yield from each(entry[2])


def masks(docs: DataFrame, held: int = HELD) -> DataFrame:
    """doc_id, lang, mask (bit k: fails filter k of FILTERS) for every row of docs.

    docs is a stored table, or one whose rows come in one order whenever a task is repeated.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("lang").cast("string"), F.col("text").cast("string")).rdd.map(tuple)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapPartitions(_before(held)).repartitionAndSortWithinPartitions(parts, lambda h: h % parts)
    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("lang", "string").add("mask", "integer")
    return spark.createDataFrame(dealt.mapPartitions(_after), schema, verifySchema=False)


def copies(docs: DataFrame) -> DataFrame:
    """doc_id of the rows whose text a smaller doc_id has."""
    return masks(docs).where(F.col("mask").bitwiseAND(_COPY) != 0).select("doc_id")


def survivors(docs: DataFrame, filters: str = FILTERS) -> DataFrame:
    """doc_id, lang of the rows that pass all the filters."""
    wanted = sum(1 << FILTERS.index(f) for f in filters)
    return masks(docs).where(F.col("mask").bitwiseAND(wanted) == 0).select("doc_id", "lang")


def counted(masked: DataFrame, labels: DataFrame) -> RDD:
    """(part, for each mask [documents, those of quality 1, those toxic]): one small vector for each part."""
    said = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("bad"))
    said = said.select(F.col("doc_id").alias("of"), "good", "bad")
    rows = masked.join(said, masked["doc_id"] == said["of"], "left").select(F.coalesce("lang", F.lit("")), "mask", F.coalesce("good", F.lit(0)), F.coalesce("bad", F.lit(0)))

    def enter(vector: list[list[int]], x: tuple) -> list[list[int]]:
        cell = vector[x[0]]
        cell[0] += 1
        cell[1] += x[1]
        cell[2] += x[2]
        return vector

    def merge(a: list[list[int]], b: list[list[int]]) -> list[list[int]]:
        return [[x + y for x, y in zip(p, q, strict=True)] for p, q in zip(a, b, strict=True)]

    return rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3]))).combineByKey(lambda x: enter([[0, 0, 0] for _ in range(1 << len(FILTERS))], x), enter, merge)


def interactions(vector: list[list[int]]) -> Iterator[tuple]:
    """(filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) of a part's counts by mask."""
    lost: dict[str, int] = dict.fromkeys(FILTERS, 0)
    rows = []
    for order in ORDERS:
        before = 0
        for step, name in enumerate(order, 1):
            bit = 1 << FILTERS.index(name)
            here = [v for m, v in enumerate(vector) if m & bit and not m & before]
            removed, good, toxic = (sum(v[k] for v in here) for k in range(3))
            redundant = sum(v[0] for m, v in enumerate(vector) if m & bit and m & before)
            before |= bit
            kept = sum(v[0] for m, v in enumerate(vector) if not m & before)
            lost[name] += removed
            rows.append((order, step, name, kept, removed, redundant, vector[bit][0], good, toxic))
    for order, step, name, *counts in rows:
        yield (order, step, *counts, lost[name])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of interactions() for each part (lang) of docs."""
    counts = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    schema = T.StructType().add("part", "string").add("filter_order", "string").add("step", "integer")
    for c in counts:
        schema = schema.add(c, "long")
    masked = settle(masks(docs))
    if masked.count() != docs.count():  # both from footers of files
        raise RuntimeError("the rows of documents came in another order when a task was repeated; store them first")
    vectors = counted(masked, labels)
    return docs.sparkSession.createDataFrame(vectors.flatMap(lambda kv: [(kv[0], *row) for row in interactions(kv[1])]), schema, verifySchema=False)
