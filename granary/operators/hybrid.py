"""Hybrid retrieval as a whole: what a batch of requests may use, in three channels, fused, reranked, represented.

Everything is keyed by request. A row is a (request, candidate) pair, and candidates are what eligibility left, so no
channel makes rows of its own: lexical and concept scores are counted inside the pair's row, the vector channel
comes as a table of scores, and so do the reranker's. The fused order is worked out both for all channels and for the two
that need no provider, so that a request whose provider failed falls back in the same plan, with the reason in a column.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.text import tokens

#: Channels in the order in which they are named and summed.
CHANNELS = ("lexical", "concept", "vector")
ALL, BASE, PLAIN = "lexical,concept,vector,semantic_ranking", "lexical,concept", "concept"


@dataclass(frozen=True)
class Settings:
    """How candidates are pooled. A threshold that is None lets everything qualify; without ``fallback`` a failed provider is an error."""

    rrf_constant: int = 60
    channel_limit: int = 50
    candidate_limit: int = 50
    minimum_semantic: float | None = None
    minimum_lexical: float | None = None
    fallback: bool = True


def _union(values: Column) -> Column:
    return F.array_distinct(F.flatten(values))


def _shared(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def asked_words(requests: DataFrame, terminology: DataFrame) -> DataFrame:
    """request_id, original (tokens of the terms), words (with aliases), by_language (language, tokens), matched (concepts).

    requests has request_id, terms (array of structs text, language) and selected (concept ids); terminology has concept_id
    and aliases. A concept that the request selects is matched by a term if all tokens of one of its aliases are in the term;
    then all its aliases count as said, in the language of the term.
    """
    term = requests.select("request_id", "selected", F.posexplode("terms").alias("nth", "term"))
    term = term.select("request_id", "selected", "nth", F.col("term")["language"].alias("language"), tokens(F.col("term")["text"]).alias("said"))
    known = term.select("request_id", "nth", "said", F.explode(F.array_distinct("selected")).alias("concept_id")).join(terminology, "concept_id")
    known = known.where(F.exists("aliases", lambda a: F.size(F.array_except(tokens(a), F.col("said"))) == 0))
    found = known.groupBy("request_id", "nth").agg(_union(F.collect_list(F.transform("aliases", tokens))).alias("more"), F.collect_set("concept_id").alias("hit"))
    found = found.withColumn("more", _union(F.col("more")))
    each = term.join(found, ["request_id", "nth"], "left").withColumn("all", F.array_union("said", F.coalesce("more", F.array().cast("array<string>"))))
    of_language = each.groupBy("request_id", "language").agg(_union(F.collect_list("all")).alias("tokens"), _union(F.collect_list("said")).alias("said"), F.flatten(F.collect_list("hit")).alias("hit"))
    return of_language.groupBy("request_id").agg(
        _union(F.collect_list("said")).alias("original"), _union(F.collect_list("tokens")).alias("words"), F.collect_list(F.struct("language", "tokens")).alias("by_language"), _union(F.collect_list("hit")).alias("matched")
    )


def scored(pairs: DataFrame, requests: DataFrame, evidence: DataFrame, projections: DataFrame, terminology: DataFrame) -> DataFrame:
    """pairs (request_id, evidence_id) with lexical, concept, plain (tokens shared with the terms as they are), configured, grp, language, stale.

    lexical counts the tokens that the excerpt shares with all words, and for each projection (evidence_id, language,
    text) those that it shares with the words of its language, so projections in languages that nothing was asked in count
    for nothing. concept counts the concepts that are selected, those that are matched, and one for required evidence.
    """
    shown = projections.groupBy("evidence_id").agg(F.collect_list(F.struct("language", tokens(F.col("text")).alias("tokens"))).alias("shown"))
    said = evidence.select("evidence_id", tokens(F.coalesce("text", F.lit(""))).alias("excerpt"), "concepts", "grp", "language", "accessed_day").join(shown, "evidence_id", "left")
    none = F.array().cast("array<string>")
    asked = requests.join(asked_words(requests, terminology), "request_id", "left").select("request_id", "selected", "required", "configured", "oldest_day", F.coalesce("original", none).alias("original"), F.coalesce("words", none).alias("words"), "by_language", "matched")
    rows = pairs.join(said, "evidence_id").join(asked, "request_id")
    of = lambda p: F.aggregate("by_language", F.lit(0), lambda n, x: n + F.when(x["language"] == p["language"], _shared(x["tokens"], p["tokens"])).otherwise(0))
    lexical = _shared(F.col("words"), F.col("excerpt")) + F.coalesce(F.aggregate("shown", F.lit(0), lambda n, p: n + F.coalesce(of(p), F.lit(0))), F.lit(0))
    concept = F.coalesce(_shared(F.col("concepts"), F.col("selected")), F.lit(0)) + F.coalesce(_shared(F.col("concepts"), F.col("matched")), F.lit(0)) + F.coalesce(F.array_contains("required", F.col("evidence_id")), F.lit(False)).cast("int")
    stale = F.coalesce(F.col("accessed_day") < F.col("oldest_day"), F.lit(False))
    return rows.select("request_id", "evidence_id", lexical.cast("double").alias("lexical"), concept.cast("double").alias("concept"), _shared(F.col("original"), F.col("excerpt")).cast("double").alias("plain"), "configured", "grp", "language", stale.alias("stale"))


def pooled(rows: DataFrame, settings: Settings) -> DataFrame:
    """request_id, bucket, all_score, base_score: buckets that all channels, or the two without a provider, let in; null where they don't.

    Each channel ranks buckets by their best evidence (falling score, then evidence_id) and passes on channel_limit of them.
    lexical and vector drop what scores nothing, concept keeps it. Of equal sums an evidence comes before a group, then the smaller id.
    """
    score = F.struct(*CHANNELS)
    each = rows.select("request_id", "bucket", "evidence_id", F.posexplode(F.array(*[score[c] for c in CHANNELS])).alias("channel", "score"))
    each = each.where((F.col("score") > 0) | ((F.col("channel") == CHANNELS.index("concept")) & F.col("score").isNotNull()))
    best = each.groupBy("request_id", "channel", "bucket").agg(F.min(F.struct((-F.col("score")).alias("s"), "evidence_id")).alias("best"))
    order = Window.partitionBy("request_id", "channel").orderBy("best")
    ranked = best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= settings.channel_limit)
    of = lambda i: F.coalesce(F.sum(F.when(F.col("channel") == i, 1 / (settings.rrf_constant + F.col("r")))), F.lit(0.0))
    # Summed in the order of the channels, so that equal sums are equal to the last bit.
    total = ranked.groupBy("request_id", "bucket").agg(*[of(i).alias(f"c{i}") for i in range(3)])
    total = total.select("request_id", "bucket", (F.col("c0") + F.col("c1") + F.col("c2")).alias("all"), F.nullif(F.col("c0") + F.col("c1"), F.lit(0.0)).alias("base"))
    place = lambda c: F.row_number().over(Window.partitionBy("request_id").orderBy(F.col(c).desc_nulls_last(), "bucket"))
    placed = total.withColumn("all_place", place("all")).withColumn("base_place", place("base"))
    keep = lambda c: F.when(F.col(f"{c}_place") <= settings.candidate_limit, F.col(c)).alias(f"{c}_score")
    return placed.select("request_id", "bucket", keep("all"), keep("base")).where("all_score is not null or base_score is not null")


def _finite(name: str) -> Column:
    return F.col(name).isNotNull() & ~F.isnan(name) & (F.abs(name) < float("inf"))


def _channels(rows: DataFrame, vectors: DataFrame | None) -> DataFrame:
    """rows of scored() with their bucket, the vector channel, and whether the request has it."""
    # An evidence sorts before a group, whatever their ids.
    rows = rows.withColumn("bucket", F.struct(F.col("grp").isNotNull().alias("group"), F.coalesce(F.col("grp"), F.col("evidence_id")).alias("id")))
    if vectors is None:
        return rows.withColumns({"vector": F.lit(None).cast("double"), "seen": F.lit(False)})
    given = vectors.select("request_id", "evidence_id", F.col("score").cast("double").alias("vector"), F.lit(True).alias("given"))
    rows = rows.join(given, ["request_id", "evidence_id"], "left")
    # The least of true and false over what was given: null, so not seen, if nothing was.
    seen = F.coalesce(F.min(F.when(F.col("given"), _finite("vector"))).over(Window.partitionBy("request_id")), F.lit(False))
    return rows.withColumn("seen", seen).withColumn("vector", F.when(_finite("vector"), F.col("vector")))


def to_rank(pairs: DataFrame, requests: DataFrame, evidence: DataFrame, projections: DataFrame, terminology: DataFrame, vectors: DataFrame | None, settings: Settings = Settings(), rows: DataFrame | None = None) -> DataFrame:
    """request_id, evidence_id of what all channels let in: exactly what a reranker has to score for retrieve(); rows are those of scored(), if they are settled already."""
    rows = _channels(scored(pairs, requests, evidence, projections, terminology) if rows is None else rows, vectors).where("configured")
    return rows.join(pooled(rows, settings).where("all_score is not null"), ["request_id", "bucket"]).select("request_id", "evidence_id")


def retrieve(
    pairs: DataFrame, requests: DataFrame, evidence: DataFrame, projections: DataFrame, terminology: DataFrame, vectors: DataFrame | None, ranking: DataFrame | None, settings: Settings = Settings(), rows: DataFrame | None = None
) -> DataFrame:
    """One row for each evidence that a request is given: request_id, evidence_id, score, representative_id, rank, qualified, reason, channels, degradation.

    requests: request_id, terms, selected, required (evidence ids), configured, oldest_day (what was accessed before is
    stale). evidence: evidence_id, text, concepts, grp (equivalent evidence shares it; null: alone), language, accessed_day.
    vectors and ranking: request_id, evidence_id, score; None is a provider that is not there. A request for which a
    candidate has no finite vector score has lost the vector channel; one whose ranking is not finite, or not exactly of what was let in,
    the reranker. Both fall back to lexical and concept scores, with the stage in ``degradation``; without a
    fallback they have one row of nulls with the degradation retrieval_provider_failed.

    All members of a bucket that is let in come with its score; the reranker's scores replace it. rank orders the representatives of
    a request by falling score, then id, and is null for the rest. A request that is not configured is given all candidates by the tokens
    they share with its terms. reason tells why a group's representative was chosen. rows are those of scored(), if they are settled already.
    """
    of_request = Window.partitionBy("request_id")
    rows = _channels(scored(pairs, requests, evidence, projections, terminology) if rows is None else rows, vectors)
    plain = rows.where(~F.col("configured")).select("request_id", "evidence_id", F.col("plain").alias("score"), F.col("evidence_id").alias("representative_id"), F.lit(True).alias("qualified"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("string").alias("degradation"))
    asked_at_all = requests.select("request_id", (F.size(F.coalesce("terms", F.array().cast(requests.schema["terms"].dataType))) > 0).alias("has_terms"))
    plain = plain.join(asked_at_all, "request_id").withColumn("channels", F.when(F.col("has_terms"), "concept,lexical").otherwise(PLAIN)).drop("has_terms")
    rows = rows.where("configured")
    let_in = rows.join(pooled(rows, settings), ["request_id", "bucket"])
    if ranking is None:
        let_in = let_in.withColumns({"semantic": F.lit(None).cast("double"), "ranked": F.lit(False)})
    else:
        given = ranking.select("request_id", "evidence_id", F.col("score").cast("double").alias("semantic"))
        let_in = let_in.join(given, ["request_id", "evidence_id"], "left")
        strangers = given.join(let_in.where("all_score is not null").select("request_id", "evidence_id"), ["request_id", "evidence_id"], "left_anti").select("request_id").distinct().withColumn("strange", F.lit(True))
        let_in = let_in.join(strangers, "request_id", "left")
        whole = F.min(F.col("all_score").isNull() | _finite("semantic")).over(of_request)
        let_in = let_in.withColumn("ranked", whole & F.col("strange").isNull()).drop("strange")
    degradation = F.when(~F.col("seen"), "vector_failed").when(~F.col("ranked"), "semantic_ranking_failed")
    let_in = let_in.withColumn("degradation", degradation)
    failed = let_in.where("degradation is not null").select("request_id").distinct()
    sound = F.col("degradation").isNull()
    if not settings.fallback:
        let_in = let_in.where(sound)
    let_in = let_in.withColumn("score", F.when(sound & F.col("all_score").isNotNull(), F.col("semantic")).when(~sound, F.col("base_score"))).where("score is not null")
    least = lambda c, limit: F.lit(True) if limit is None else F.col(c) >= limit
    let_in = let_in.withColumn("qualified", F.when(sound, least("semantic", settings.minimum_semantic)).otherwise(least("lexical", settings.minimum_lexical)))
    shown = _represented(let_in).withColumn("channels", F.when(F.col("degradation").isNull(), ALL).otherwise(BASE))
    columns = ["request_id", "evidence_id", "score", "representative_id", "qualified", "reason", "channels", "degradation"]
    out = [shown.select(columns), plain.select(columns)]
    if not settings.fallback:
        empty = {"evidence_id": "bigint", "score": "double", "representative_id": "bigint", "qualified": "boolean", "reason": "string", "channels": "string"}
        out.append(failed.select("request_id", *[F.lit(None).cast(t).alias(c) for c, t in empty.items()], F.lit("retrieval_provider_failed").alias("degradation")).select(columns))
    found = reduce(DataFrame.unionByName, out)
    stands = F.col("evidence_id") == F.col("representative_id")
    order = Window.partitionBy("request_id", stands).orderBy(F.col("score").desc(), "evidence_id")
    return found.withColumn("rank", F.when(stands, F.row_number().over(order)))


def _represented(let_in: DataFrame) -> DataFrame:
    """let_in with representative_id and reason: of the members of a group the fresh come first, then score, then German, then the smaller id."""
    key = F.struct("stale", (-F.col("score")).alias("s"), (F.col("language") != "de").alias("l"), F.col("evidence_id").alias("i"))
    group = Window.partitionBy("request_id", "bucket")
    best = F.min(key).over(group)
    rows = let_in.withColumn("best", best)
    tied = F.count_if((F.col("stale") == F.col("best")["stale"]) & (-F.col("score") == F.col("best")["s"])).over(group)
    rows = rows.withColumns({"members": F.count("*").over(group), "tied": tied, "any_stale": F.max("stale").over(group)})
    reason = (
        F.when(F.col("members") == 1, "only_eligible_equivalent")
        .when(~F.col("best")["stale"] & F.col("any_stale"), "fresher_equivalent")
        .when((F.col("tied") > 1) & ~F.col("best")["l"], "german_equivalent_tie")
        .when(F.col("tied") == 1, "higher_ranked_equivalent")
        .otherwise("stable_equivalent_tie")
    )
    chosen = F.when(F.col("bucket")["group"], F.col("best")["i"]).otherwise(F.col("evidence_id"))
    return rows.withColumns({"representative_id": chosen, "reason": F.when(F.col("bucket")["group"], reason)})


def used_projections(pairs: DataFrame, requests: DataFrame, projections: DataFrame, complete: list[str], most: int = 100) -> DataFrame:
    """request_id, projection_id of the first ``most`` projections by id that lie on candidates in a language of the request's terms, or in a complete one if it has no terms."""
    spoken = F.transform("terms", lambda t: t["language"])
    languages = requests.select("request_id", F.explode(F.array_distinct(F.when(F.size("terms") > 0, spoken).otherwise(F.array(*[F.lit(x) for x in complete]).cast("array<string>")))).alias("language"))
    used = pairs.join(projections.select("evidence_id", "projection_id", "language"), "evidence_id").join(languages, ["request_id", "language"])
    order = Window.partitionBy("request_id").orderBy("projection_id")
    return used.select("request_id", "projection_id", F.row_number().over(order).alias("n")).where(F.col("n") <= most).drop("n")
