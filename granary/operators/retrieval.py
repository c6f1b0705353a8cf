"""Lexical matching, ranks by channel, reciprocal rank fusion and representatives of equivalent evidence.

A request is a row, so all requests of a batch are ranked by one plan. Everything after scoring
is keyed by request: windows and groups spread over requests.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.functions.text import tokens
from granary.operators.tables import settle


#: Rows of request tokens, numbers of request vectors, and held places (requests times k) that go to every task in one pass.
MAX_TOKENS, MAX_NUMBERS, MAX_HELD = 1_000_000, 8_000_000, 4_000_000
#: Parts that a token's rows are dealt into where the requests are too many to broadcast.
PARTS = 64
#: Pairs of a request and a text, or scores, that a task works on at once, and texts of an Arrow batch whose tokens it looks up at once.
PAIRS, TEXTS = 1 << 19, 256


class Held:
    """The k best (score above 0, then smaller id) of each of n requests so far: the memory of a task, whatever it reads."""

    NONE = np.iinfo(np.int64).max

    def __init__(self, n: int, k: int):
        self.k, self.scores, self.ids = k, np.zeros((n, k)), np.full((n, k), self.NONE)

    def offer(self, request: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        worst, worst_id = self.scores[request, -1], self.ids[request, -1]
        better = np.flatnonzero((scores > worst) | ((scores == worst) & (scores > 0) & (ids < worst_id)))
        if not len(better):
            return
        request, ids, scores = request[better], ids[better], scores[better]
        touched = np.unique(request)
        r = np.concatenate([request, np.repeat(touched, self.k)])
        s = np.concatenate([scores, self.scores[touched].ravel()])
        i = np.concatenate([ids, self.ids[touched].ravel()])
        order = np.lexsort((i, -s, r))
        r, s, i = r[order], s[order], i[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < self.k
        self.scores[r[kept], place[kept]] = s[kept]
        self.ids[r[kept], place[kept]] = i[kept]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(self.scores > 0)
        return pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(self.ids[r, c]), pa.array(self.scores[r, c])], ["request_id", "evidence_id", "score"])


class HeldReferences(Held):
    """The k best references of each of n requests so far, each with its best row: what is not among them in a task that has the best row of a reference is not among the best of all."""

    def __init__(self, n: int, k: int):
        super().__init__(n, k)
        self.refs = np.full((n, k), self.NONE)

    def offer_of(self, request: np.ndarray, refs: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        worst, worst_id = self.scores[request, -1], self.ids[request, -1]
        better = np.flatnonzero((scores > worst) | ((scores == worst) & (scores > 0) & (ids < worst_id)))
        if not len(better):
            return
        touched = np.unique(request[better])
        r = np.concatenate([request[better], np.repeat(touched, self.k)])
        f, i, s = (np.concatenate([new[better], old[touched].ravel()]) for new, old in ((refs, self.refs), (ids, self.ids), (scores, self.scores)))
        order = np.lexsort((i, -s, f, r))
        r, f, i, s = r[order], f[order], i[order], s[order]
        first = np.append(True, (r[1:] != r[:-1]) | (f[1:] != f[:-1])) & (s > 0)
        r, f, i, s = r[first], f[first], i[first], s[first]
        order = np.lexsort((i, -s, r))
        r, f, i, s = r[order], f[order], i[order], s[order]
        place = np.arange(len(r)) - np.searchsorted(r, r)
        kept = place < self.k
        at = (r[kept], place[kept])
        self.refs[at], self.ids[at], self.scores[at] = f[kept], i[kept], s[kept]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        r, c = np.nonzero(self.scores > 0)
        return pa.RecordBatch.from_arrays([pa.array(names[r]), pa.array(self.refs[r, c]), pa.array(self.ids[r, c]), pa.array(self.scores[r, c])], ["request_id", "ref", "evidence_id", "score"])


_SCORED = "request_id long, evidence_id long, score double"


def _passes(asked: DataFrame, n: int) -> list[DataFrame]:
    """The requests in n parts by a hash of their ids, or as they are."""
    return [asked.where(F.pmod(F.xxhash64("request_id"), F.lit(n)) == i) for i in range(n)] if n > 1 else [asked]


def lexical_best(requests: DataFrame, evidence: DataFrame, k: int, weight: int = 1) -> DataFrame:
    """request_id, evidence_id, score of lexical_scores(), the k best of each request: evidence is (evidence_id, text, and label if labels count), ids unique.

    The requests' tokens are an index from tokens to requests that goes to every task; more than MAX_TOKENS tokens, or
    MAX_HELD places, are asked in several passes. Texts are scored where they lie, and a task keeps its k best of each
    request, so k rows of a task move and never one for each pair.
    """
    asked = requests.select("request_id", F.explode(tokens(F.col("text"))).alias("token"))
    n, distinct = asked.agg(F.count("*"), F.count_distinct("request_id")).first()
    words = [tokens(F.coalesce(F.col(c), F.lit(""))).alias(c) for c in ("text", "label") if c in evidence.columns]
    said = evidence.select("evidence_id", *words)
    parts = [_lexical_pass(part, said, k, weight) for part in _passes(asked, max(1, -(-n // MAX_TOKENS), -(-distinct * k // MAX_HELD)))]
    return top_k(reduce(DataFrame.union, parts), k).drop("rank").withColumn("score", F.col("score").cast("long"))


def _index(asked: DataFrame) -> Broadcast:
    """The requests (names) of asked (request_id, token), the tokens that are asked, and for each token where its requests stand in owners: token t has owners[first[t] : first[t + 1]]."""
    rows = asked.toArrow()  # bounded by the passes
    names, owner = np.unique(rows["request_id"].to_numpy(), return_inverse=True)
    coded = rows["token"].combine_chunks().dictionary_encode()
    code = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.argsort(code, kind="stable")
    first = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
    return asked.sparkSession.sparkContext.broadcast((names, coded.dictionary, first, owner[order]))


def _looked_up(lists: pa.Array, known: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row and code of each token of the lists that is known."""
    at = pc.index_in(lists.flatten(), value_set=known)
    hit = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
    row = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))[hit]
    return row, at.to_numpy(zero_copy_only=False)[hit].astype(np.int64)


def _matched(row: np.ndarray, token: np.ndarray, worth: np.ndarray, first: np.ndarray, owners: np.ndarray, n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Request, row and score of the pairs that share a token, by row and then request; rows ascend. In blocks of whole texts with some PAIRS matches, and pairs, together."""
    count = first[token + 1] - first[token]
    ends, low = np.cumsum(count), 0
    while low < len(row):
        high = int(min(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right"), np.searchsorted(row, row[low] + max(PAIRS // n, 1))))
        high = int(np.searchsorted(row, row[max(high, low + 1) - 1], side="right"))
        many = count[low:high]
        skip = np.repeat(first[token[low:high]] - (np.cumsum(many) - many), many)
        cell = owners[skip + np.arange(len(skip))] + np.repeat((row[low:high] - row[low]) * n, many)
        score = np.bincount(cell, weights=np.repeat(worth[low:high], many))
        met = np.flatnonzero(score)
        yield met % n, row[low] + met // n, score[met]
        low = high


def _lexical_pass(asked: DataFrame, said: DataFrame, k: int, weight: int) -> DataFrame:
    shared = _index(asked)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, first, owners = shared.value
        held = Held(len(names), k)
        for part in (batch.slice(i, TEXTS) for batch in batches for i in range(0, batch.num_rows, TEXTS)):
            ids = part.column("evidence_id").to_numpy()
            row, token, worth = [], [], []
            for column, w in (("text", 1), ("label", weight)):
                if column in part.schema.names:
                    for into, new in zip((row, token), _looked_up(part.column(column), known), strict=True):
                        into.append(new)
                    worth.append(np.full(len(new), w))
            row, token, worth = (np.concatenate(x) for x in (row, token, worth))
            order = np.argsort(row, kind="stable")
            for request, at, scores in _matched(row[order], token[order], worth[order], first, owners, len(names)):
                held.offer(request, ids[at], scores)
        yield held.rows(names)

    return said.mapInArrow(score, _SCORED)


def coded(df: DataFrame, words: str, vocabulary: DataFrame) -> DataFrame:
    """df with its column of words as distinct integers of those that vocabulary (token, distinct) has, or as distinct words if that has more than MAX_TOKENS: what two lists have in common stays."""
    known = vocabulary.limit(MAX_TOKENS + 1).toArrow()
    if known.num_rows > MAX_TOKENS:
        return df.withColumn(words, F.array_distinct(words))
    shared = df.sparkSession.sparkContext.broadcast(known["token"].combine_chunks())

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(i, TEXTS) for batch in batches for i in range(0, batch.num_rows, TEXTS)):
            lists = part.column(words)
            row, token = _looked_up(lists, shared.value)
            row, token = np.divmod(np.unique(row * len(shared.value) + token), max(1, len(shared.value)))
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            codes = pa.ListArray.from_arrays(pa.array(bounds), pa.array(token.astype(np.int32)), mask=lists.is_null())
            yield pa.RecordBatch.from_arrays([codes if c == words else part.column(c) for c in part.schema.names], names=part.schema.names)

    schema = T.StructType([T.StructField(words, T.ArrayType(T.IntegerType())) if f.name == words else f for f in df.schema])
    return df.mapInArrow(code, schema)


def lexical_members(requests: DataFrame, evidence: DataFrame) -> DataFrame:
    """request_id, bucket, representative, members: of the evidence (evidence_id, bucket, before, after, text) of a bucket that shares a token with a request, how many there are and which stands for them: by before, then falling score, then after, then id.

    Ids are unique, numbers are longs. A text moves once, as the codes of those of its tokens that are asked, to the task of its bucket. There texts are
    scored by bucket, and a task holds the best of each request in the bucket that it is at, so that no pair is moved or kept.
    """
    asked = requests.where("request_id is not null").select("request_id", F.explode(tokens(F.col("text"))).alias("token"))
    said = evidence.where("evidence_id is not null and bucket is not null").select("bucket", "before", "after", "evidence_id", tokens(F.coalesce("text", F.lit(""))).alias("codes"))
    return reduce(DataFrame.union, [_members_pass(part, said) for part in _passes(asked, max(1, -(-asked.count() // MAX_TOKENS)))])


def _members_pass(asked: DataFrame, said: DataFrame) -> DataFrame:
    shared = _index(asked)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[1]
        for part in (batch.slice(i, TEXTS) for batch in batches for i in range(0, batch.num_rows, TEXTS)):
            row, token = _looked_up(part.column("codes"), known)
            bounds = np.searchsorted(row, np.arange(part.num_rows + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(token.astype(np.int32)))
            some = pa.array(np.diff(bounds) > 0)
            yield pa.RecordBatch.from_arrays([*part.columns[:4], lists], names=part.schema.names).filter(some)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, first, owners = shared.value
        kept = None
        for part in (batch.slice(i, TEXTS) for batch in batches for i in range(0, batch.num_rows, TEXTS)):
            bucket, before, after, ids = (c.to_numpy() for c in part.columns[:4])
            lists = part.column("codes")
            row, token = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy().astype(np.int64)
            for request, at, scores in _matched(row, token, np.ones(len(row)), first, owners, len(names)):
                rows = [bucket[at], request, before[at], -scores, after[at], ids[at], np.ones(len(at), dtype=np.int64)]
                if kept is not None:
                    rows = [np.concatenate(x) for x in zip(kept, rows, strict=True)]
                order = np.lexsort(rows[5::-1])
                rows = [x[order] for x in rows]
                start = np.flatnonzero(np.append(True, (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])))
                best = [*(x[start] for x in rows[:6]), np.add.reduceat(rows[6], start)]
                last = best[0] == rows[0][-1]
                kept = [x[last] for x in best]
                yield result(names, [x[~last] for x in best])
        if kept is not None:
            yield result(names, kept)

    def result(names: np.ndarray, best: list[np.ndarray]) -> pa.RecordBatch:
        columns = {"request_id": names[best[1]], "bucket": best[0], "representative": best[5], "members": best[6]}
        return pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()})

    coded = said.mapInArrow(code, "bucket long, before long, after long, evidence_id long, codes array<int>")
    return coded.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(members, "request_id long, bucket long, representative long, members long")


def lexical_within_references(requests: DataFrame, evidence: DataFrame, eligible: Column, references: int, most: int) -> DataFrame:
    """within_references() of lexical_scores() over the pairs of requests (request_id, text and more) and evidence (evidence_id, ref, text and more) that are ``eligible``, a condition on what both have more.

    Ids are unique, refs are longs. Pairs are made, judged and dropped where the text lies; a task keeps of each request the best row of its best references. The references that
    are best over all tasks are those that the walk meets first, and only their evidence is scored again, all of it.
    """
    asked = requests.where("request_id is not null").select("request_id", F.explode(tokens(F.col("text"))).alias("token"))
    n, distinct = asked.agg(F.count("*"), F.count_distinct("request_id")).first()
    parts = [_references_pass(part, requests.drop("text"), evidence, eligible, references) for part in _passes(asked, max(1, -(-n // MAX_TOKENS), -(-distinct * references // MAX_HELD)))]
    held = settle(_first_references(reduce(DataFrame.union, parts), references))
    said = requests.withColumn("said", tokens(F.col("text"))).drop("text")
    rows = evidence.join(held, "ref").join(said, "request_id").where(eligible).select("request_id", "evidence_id", "ref", F.size(F.array_intersect(tokens(F.col("text")), "said")).cast("long").alias("score"))
    return top_k(rows.where("score > 0"), most)


def _references_pass(asked: DataFrame, requests: DataFrame, evidence: DataFrame, eligible: Column, references: int) -> DataFrame:
    shared = _index(asked)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, known, first, owners = shared.value
        for part in (batch.slice(i, TEXTS) for batch in batches for i in range(0, batch.num_rows, TEXTS)):
            row, token = _looked_up(part.column("said"), known)
            for request, at, scores in _matched(row, token, np.ones(len(row)), first, owners, len(names)):
                low, high = int(at[0]), int(at[-1]) + 1
                bounds = np.searchsorted(at, np.arange(low, high + 1)).astype(np.int32)
                hits = pa.StructArray.from_arrays([pa.array(names[request]), pa.array(scores)], ["request_id", "score"])
                rest = part.slice(low, high - low)
                yield pa.RecordBatch.from_arrays([*rest.columns[:-1], pa.ListArray.from_arrays(pa.array(bounds), hits)], names=[*part.schema.names[:-1], "hits"])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = shared.value[0]
        held = HeldReferences(len(names), references)
        for batch in batches:
            request, *rest = (batch.column(c).to_numpy() for c in ("request_id", "ref", "evidence_id", "score"))
            held.offer_of(np.searchsorted(names, request), *rest)
        yield held.rows(names)

    about = [c for c in evidence.columns if c != "text"]
    said = evidence.where("evidence_id is not null and ref is not null").select(*about, tokens(F.coalesce("text", F.lit(""))).alias("said"))
    hits = said.mapInArrow(score, said.select(*about).schema.add("hits", T.ArrayType(T.StructType().add("request_id", "long").add("score", "double"))))
    pairs = hits.select(*about, F.inline("hits")).join(F.broadcast(requests), "request_id").where(eligible)
    return pairs.select("request_id", "ref", "evidence_id", "score").mapInArrow(best, "request_id long, ref long, evidence_id long, score double")


def lexical_scores(requests: DataFrame, evidence: DataFrame, labels: DataFrame | None = None, weight: int = 1) -> DataFrame:
    """request_id, evidence_id, score: how many distinct tokens of the request the evidence has, if any, and ``weight`` times those of its labels.

    The requests are the small side: up to MAX_TOKENS of their tokens are broadcast, so a text's tokens are matched and
    counted where it lies and only its scores move. Beyond that both sides are joined by token and a part of the
    evidence, the requests copied to each part, so that a common word is not one key.
    """
    asked = requests.select("request_id", F.explode(tokens(F.col("text"))).alias("token"))
    said = evidence.select("evidence_id", F.explode(tokens(F.col("text"))).alias("token"), F.lit(1).alias("w"))
    if labels is not None:
        said = said.union(labels.select("evidence_id", F.explode(tokens(F.col("text"))).alias("token"), F.lit(weight).alias("w")))
    if asked.count() <= MAX_TOKENS:
        both = said.join(F.broadcast(asked), "token")
    else:
        part = F.pmod(F.xxhash64("evidence_id"), F.lit(PARTS)).cast("int")
        spread = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        both = said.withColumn("part", part).join(spread, ["token", "part"])
    return both.groupBy("request_id", "evidence_id").agg(F.sum("w").alias("score"))


def vector_scores(asked: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """request_id, evidence_id, score: inner products of each request's vectors (request_id, v) with vectors (evidence_id, v), the best of its own for each, if above 0.

    The requests' numbers go to every task while they are at most MAX_NUMBERS, and their held places MAX_HELD; more are
    asked in several passes, each of which alone is on the driver. Each task multiplies tiles of requests and vectors and
    keeps its k best of each request, so that k rows of a task move and not all pairs.
    """
    asked = asked.select("request_id", F.col("v").cast("array<double>").alias("v")).where("v is not null")
    n, distinct, wide = asked.agg(F.count("*"), F.count_distinct("request_id"), F.max(F.size("v"))).first()
    if not n:
        return asked.sparkSession.createDataFrame([], _SCORED)
    asked = asked.where(F.size("v") == wide)
    parts = [_vector_pass(part, vectors, wide, k) for part in _passes(asked, max(1, -(-n * wide // MAX_NUMBERS), -(-distinct * k // MAX_HELD)))]
    return reduce(DataFrame.union, parts)


def _vector_pass(asked: DataFrame, vectors: DataFrame, wide: int, k: int) -> DataFrame:
    rows = asked.orderBy("request_id").toArrow()  # bounded by the passes
    q = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, wide)
    names, first = np.unique(rows["request_id"].to_numpy(), return_index=True)
    shared = asked.sparkSession.sparkContext.broadcast((names, np.append(first, len(q)), q))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, first, q = shared.value
        held = Held(len(names), k)
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                v = part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                ids, low = part.column("evidence_id").to_numpy(), 0
                while low < len(names):
                    # Whole requests, of some PAIRS scores together.
                    high = max(int(np.searchsorted(first, first[low] + PAIRS // len(v), side="right")) - 1, low + 1)
                    s = np.maximum.reduceat(q[first[low] : first[high]] @ v.T, first[low:high] - first[low], axis=0)
                    r, c = np.nonzero((s > 0) & (s >= held.scores[low:high, -1:]))
                    held.offer(low + r, ids[c], s[r, c])
                    low = high
        yield held.rows(names)

    rows = vectors.where(F.size("v") == wide).select("evidence_id", F.col("v").cast("array<double>").alias("v"))
    return rows.mapInArrow(score, _SCORED)


def within_references(scored: DataFrame, references: int, most: int) -> DataFrame:
    """The rows (request_id, evidence_id, ref, score) that a greedy walk by falling score takes while it holds at most ``references`` refs, at most ``most`` of each request.

    With one ref to a row the walk takes what belongs to the refs that come first, so no request is gathered into one row.
    """
    return top_k(scored.join(_first_references(scored, references), ["request_id", "ref"]), most)


def _first_references(scored: DataFrame, references: int) -> DataFrame:
    """request_id, ref: the refs of each request that its best rows belong to."""
    best = F.max(F.struct("score", (-F.col("evidence_id")).alias("i"))).alias("best")
    order = Window.partitionBy("request_id").orderBy(F.col("best").desc())
    return scored.groupBy("request_id", "ref").agg(best).withColumn("n", F.row_number().over(order)).where(F.col("n") <= references).select("request_id", "ref")


def top_k(scored: DataFrame, k: int, by: str = "request_id", item: str = "evidence_id") -> DataFrame:
    """The k best rows of each request by falling score, then item, with their rank."""
    order = Window.partitionBy(by).orderBy(F.col("score").desc(), item)
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_of_bucket(scored: DataFrame, bucket: Column) -> DataFrame:
    """One row for each request, channel and bucket: its best evidence."""
    order = Window.partitionBy("request_id", "channel", "bucket").orderBy(F.col("score").desc(), "evidence_id")
    return scored.withColumn("bucket", bucket).withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


def fused(scored: DataFrame, bucket: Column, channel_limit: int, limit: int, constant: int = 60) -> DataFrame:
    """request_id, bucket, score, rank: sums over channels of 1 / (constant + rank in the channel), the best ``limit`` of each request."""
    order = Window.partitionBy("request_id", "channel").orderBy(F.col("score").desc(), "bucket")
    ranked = best_of_bucket(scored, bucket).withColumn("r", F.row_number().over(order)).where(F.col("r") <= channel_limit)
    total = ranked.groupBy("request_id", "bucket").agg(F.round(F.sum(1 / (constant + F.col("r"))), 9).alias("score"))
    return top_k(total, limit, item="bucket")


def evaluated(requests: DataFrame, ranked: DataFrame, gold: DataFrame, eligible: DataFrame, least_precision: float, k: int = 20, final: int = 5) -> DataFrame:
    """One row for each of requests (request_id): recall, fact_recall, precision, leakage, hit, passed.

    ranked (request_id, evidence_id, rank) is what was found; gold (request_id, evidence_id, grp, fact) the relevant
    evidence with the group that needs it and the fact it supports; eligible (request_id, evidence_id) what may be used.
    recall is the share of groups with evidence among the first k, fact_recall and precision are taken over the
    first ``final``, leakage counts what is not eligible among the first k. A request passes if all its groups and
    facts are held by the first ``final``, nothing leaks and precision is least_precision at least. Without anything found or
    without gold it has 0 and fails.
    """
    seen = ranked.where(F.col("rank") <= max(k, final)).select("request_id", "evidence_id", "rank")
    may = eligible.select("request_id", "evidence_id", F.lit(True).alias("may"))
    marked = seen.join(gold.withColumn("good", F.lit(True)), ["request_id", "evidence_id"], "left").join(may, ["request_id", "evidence_id"], "left")
    early, last = F.col("rank") <= k, F.col("rank") <= final
    n = lambda c, x: F.size(F.collect_set(F.when(c, F.col(x))))
    got = marked.groupBy("request_id").agg(
        n(early, "grp").alias("groups"), n(last, "grp").alias("final_groups"), n(last, "fact").alias("facts"), n(last, "evidence_id").alias("finals"),
        n(last & F.col("good"), "evidence_id").alias("good"), n(F.col("may").isNull(), "evidence_id").alias("leakage"),
    )
    asked = gold.groupBy("request_id").agg(F.count_distinct("grp").alias("all_groups"), F.count_distinct("fact").alias("all_facts"))
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    out = requests.select("request_id").join(got, "request_id", "left").join(asked, "request_id", "left")
    out = out.withColumns({"recall": share("groups", "all_groups"), "fact_recall": share("facts", "all_facts"), "precision": share("good", "finals"), "leakage": F.coalesce("leakage", F.lit(0)), "held": share("final_groups", "all_groups")})
    passed = (F.col("recall") == 1) & (F.col("held") == 1) & (F.col("fact_recall") == 1) & (F.col("leakage") == 0) & (F.col("precision") >= least_precision)
    return out.select("request_id", "recall", "fact_recall", "precision", "leakage", (F.col("precision") > 0).alias("hit"), passed.alias("passed"))


def greedy(items: Column, cap: int) -> Column:
    """Ids accepted from an ordered array of structs (id, refs): one is taken if the union of refs stays within cap."""
    zero = F.struct(F.expr("cast(array() as array<bigint>)").alias("ids"), F.expr("cast(array() as array<bigint>)").alias("refs"))

    def step(acc: Column, x: Column) -> Column:
        union = F.array_union(acc["refs"], x["refs"])
        return F.when(F.size(union) <= cap, F.struct(F.concat(acc["ids"], F.array(x["id"])).alias("ids"), union.alias("refs"))).otherwise(acc)

    return F.aggregate(items, zero, step, lambda acc: acc["ids"])
