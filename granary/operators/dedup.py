"""Duplicates by content, and pairs of similar labels."""

from __future__ import annotations

import itertools
import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import tokens
from granary.functions.unicode import terminology_key
from granary.operators.tables import settle


def duplicate_of(df: DataFrame, key: Column, item: str) -> DataFrame:
    """df with first: the smallest item of equal key, and is_duplicate."""
    first = df.groupBy(key.alias("__k")).agg(F.min(item).alias("first"))
    out = df.withColumn("__k", key).join(first, "__k")
    return out.drop("__k").withColumn("is_duplicate", F.col(item) > F.col("first"))


#: Longs of the sketch of a set of tokens.
SKETCH = 4

#: Fixed value: words that say nothing about the likeness of two labels.
STOP_WORDS = "der die das den des dem ein eine einer eines und oder für durch von im in mit zum zur the of for and a".split()


def shared_labels(labels: DataFrame) -> DataFrame:
    """(lang, label, first, item): the items that have a label (item, lang, label) in common, with the smallest of them.

    An item may have several labels, as one with aliases has. Labels are compared in composed form, lower case,
    with white space collapsed; languages may be null and are then one language. Two items share a label if both
    stand under it, so a label that n items have gives n rows and not the pairs of them.
    """
    each = labels.where("label is not null").select("lang", terminology_key(F.col("label")).alias("label"), "item").distinct()
    held = each.groupBy(F.col("lang").alias("__lang"), F.col("label").alias("__label")).agg(F.min("item").alias("first"), F.count("*").alias("__n")).where("__n > 1")
    on = F.col("lang").eqNullSafe(F.col("__lang")) & (F.col("label") == F.col("__label"))
    return each.join(held, on).select("lang", "label", "first", "item")


def similar_label_classes(labels: DataFrame, least: float = 0.6, shared: int = 2) -> DataFrame:
    """similar_labels without STOP_WORDS, with the smallest item of each preferred label (item, lang, label) standing for all that have it.

    With the rows of shared_labels this gives every pair: two items are a pair if they share a label or if the
    first items of their labels are one. Languages may be null and are then one language.
    """
    lang = F.when(F.col("lang").isNull(), "").otherwise(F.concat(F.lit("="), F.col("lang")))
    classes = labels.where("label is not null").groupBy(lang.alias("lang"), terminology_key(F.col("label")).alias("label")).agg(F.min("item").alias("item"))
    return similar_labels(classes, least, shared, STOP_WORDS)


def similar_labels(labels: DataFrame, least: float = 0.6, shared: int = 2, stop: Sequence[str] = ()) -> DataFrame:
    """(a, b, both) with a < b: labels (item, lang, label) of one language with at least ``shared`` tokens in common and that Jaccard similarity, ``stop`` left out.

    Every pair is written out; where many labels have the same tokens, linked_labels() says the same in fewer rows.
    """
    members, links = linked_labels(labels, least, shared, stop)
    members = settle(members)
    one, other = (members.select(F.col("set").alias(s), F.col("item").alias(i)) for s, i in (("a", "x"), ("b", "y")))
    between = links.join(one, "a").join(other, "b").select("x", "y", "both")
    held = members.where(F.col("n") >= shared)
    within = held.select("set", F.col("item").alias("x"), F.col("n").alias("both")).join(held.select("set", F.col("item").alias("y")), "set").where("x < y").select("x", "y", "both")
    return between.union(within).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "both")


def linked_labels(labels: DataFrame, least: float = 0.6, shared: int = 2, stop: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Labels (item, lang, label) by their sets of tokens: (item, set, n) with the smallest item of equal set and its tokens, and links (a, b, both), a < b, between sets.

    Pairs are found by near_sets(), made distinct and compared on their whole sets. Tokens are numbered by frequency; one that a single set
    has meets no one. Each of the others turns one bit of the SKETCH longs of a set, so differing bits are never more than differing tokens.
    """
    said = F.array_except(tokens(F.col("label")), F.array(*map(F.lit, stop))) if stop else tokens(F.col("label"))
    # Written, as a filter on what is made of a text would make it twice.
    words = settle(labels.where("lang is not null").select("item", "lang", F.sort_array(said).alias("t"))).where(F.size("t") > 0)
    sets = settle(words.groupBy("lang", "t").agg(F.min("item").alias("set")))
    hashed = F.sha2(F.array_join("t", " ").cast("binary"), 256).alias("h")
    members = words.select("item", "lang", hashed).join(sets.select("set", "lang", hashed, F.size("t").cast("long").alias("n")), ["lang", "h"]).select("item", "set", "n")
    often = sets.select("lang", F.explode("t").alias("token")).groupBy("lang", "token").count().where("count > 1")
    numbered = settle(often.orderBy("count", "lang", "token").select("lang", "token", F.monotonically_increasing_id().alias("id")))
    each = sets.select("set", "lang", F.size("t").alias("n"), F.explode("t").alias("token")).join(numbered, ["lang", "token"])
    turned = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(F.xxhash64("id"), 8).bitwiseAND(63).cast("int"))
    sketch = [F.bit_xor(F.when(F.pmod(F.xxhash64("id"), F.lit(SKETCH)) == k, turned).otherwise(F.lit(0).cast("long"))).alias(f"s{k}") for k in range(SKETCH)]
    ordered = settle(each.groupBy("set", "n").agg(F.sort_array(F.collect_list("id")).alias("ids"), *sketch))
    met = near_sets(ordered, least, shared).distinct()
    na, nb = F.col("na"), F.col("nb")
    whole = [ordered.select(F.col("set").alias(s), F.col("n").alias("n" + s), F.col("ids").alias("ids" + s)) for s in "ab"]
    alike = lambda x: (F.size(x) >= shared) & (F.size(x) / (na + nb - F.size(x)) >= least)
    # In a list of one, as the common tokens would else be found once for each of the conditions.
    links = met.join(whole[0], "a").join(whole[1], "b").select("a", "b", F.explode(F.filter(F.array(F.array_intersect("idsa", "idsb")), alike)).alias("x"))
    return members, links.select("a", "b", F.size("x").cast("long").alias("both"))


def near_sets(sets: DataFrame, least: float, shared: int) -> DataFrame:
    """(a, b), a < b, of sets (set, n, ids of its tokens that others have, by frequency, and its sketch) that may be similar: all similar pairs, some others, some of both twice.

    Sets that similar can't differ in all of their ``prefix_length`` rarest tokens, so only these are joined. A pair meets at each of
    them that it shares. It is dropped there if its sizes forbid the similarity, if more bits of its sketches differ than tokens of its sets
    may, or if it shares one of the two tokens before, where it has met already. Only ids and sketches take part in that.
    """
    sketch = [f"s{k}" for k in range(SKETCH)]
    n, alone = F.col("n"), F.col("n") - F.size("ids")
    rarest = F.slice("ids", F.lit(1), F.greatest(n - F.ceil(n * F.lit(least) - 1e-9) + 1 - alone, F.lit(0)).cast("int"))
    at = sets.select("set", "n", "ids", *sketch, F.posexplode(rarest).alias("k", "id"))
    ahead = [F.coalesce(F.get("ids", F.col("k") - j), F.lit(-1).cast("long")).alias(f"p{j}") for j in (1, 2)]
    prefix = at.select("id", "set", "n", F.size("ids").alias("c"), *ahead, *sketch)
    a, b = (prefix.select("id", *[F.col(c).alias(c + s) for c in prefix.columns[1:]]) for s in "ab")
    na, nb = F.col("na"), F.col("nb")
    fewest = F.greatest((na + nb) * (least / (1 + least)) - 1e-9, F.lit(float(shared)))
    differing = sum((F.bit_count(F.col(s + "a").bitwiseXOR(F.col(s + "b"))) for s in sketch), F.lit(0))
    near = (F.least(na, nb) >= F.greatest(na, nb) * least - 1e-9) & (differing <= F.col("ca") + F.col("cb") - fewest * 2)
    for x, y in itertools.product(("p1a", "p2a"), ("p1b", "p2b")):
        near &= (F.col(x) != F.col(y)) | (F.col(x) < 0)
    met = a.join(b, "id").where((F.col("seta") < F.col("setb")) & near)
    return met.select(F.col("seta").alias("a"), F.col("setb").alias("b"))


def prefix_length(n: int, least: float) -> int:
    return n - math.ceil(least * n - 1e-9) + 1
