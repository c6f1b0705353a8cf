"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Four kinds are looked for: email, ip, card, phone. The base spans of a kind are the leftmost
non-overlapping matches of its base pattern that pass its check; they always stay. Each kind has
also a tight pattern that finds what the base pattern swallowed or can't see (two card numbers in
a row, a phone number before an address, bracketed "(at)" mail, IPv6). All these candidates get
votes for (2), against (0) or of neither sort (1) from labelers: format and boundary regexes,
gazetteers (domain endings, card issuers, calling codes, reserved networks) and context words.

Votes are counted by pattern over the whole corpus. There are at most 4 * 3 ** 6 * 8 patterns
whatever the number of documents, so that table goes to the driver, where expectation-maximisation
estimates how far each labeler can be trusted and so how likely each pattern is personal data; a
logistic span classifier is trained on those likelihoods with the votes and the span's shape as its
features. A tight candidate is added if it reaches ``THRESHOLD`` and overlaps no other span.

Everything on rows is DataFrame functions: texts are read once, and the table that is kept for the
second look has offsets and votes, not texts. A text without the signs that a pattern needs (an at sign, a
plus, enough digits) is not searched with it. Offsets count code points. A null text is empty, a text of any
length is searched whole. Rows that repeat a doc_id, or have none, are looked at each on its own. Of two
added spans that overlap the kind listed first stays. Columns of any name stay in masked(); an empty table
gives none.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.textkit import column, free, settle

KINDS = ("email", "ip", "card", "phone")
THRESHOLD, EM_ROUNDS, FIT_ROUNDS = 0.9, 50, 300
#: Matches are numbered in blocks of so many array elements; even.
BLOCK = 128

#: The base patterns, written so that no run of characters is scanned twice. A match begins where the last one ended or where its run begins.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?:\G|(?<![0-9]))[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TIGHT = {
    "email": r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[A-Za-z0-9-]{1,63}+(?: ?[\[(.](?:dot[\])] ?)?[A-Za-z0-9-]{1,63}+){1,8}+",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}[\x20-]?[0-9]{4}|[0-9]{4}[\x20-]?[0-9]{6}[\x20-]?[0-9]{5})(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[\x20.-]?)?\([0-9]{2,4}\)[\x20.-]?[0-9]{3}[\x20.-]?[0-9]{4}(?![0-9A-Za-z])",
}
#: Gazetteers and context words.
DOMAIN_ENDINGS = r"(?i)\.(?:com|org|net|edu|gov|int|info|io|eu|uk|de|fr|es|it|ch|at|nl|be|us|ca|au|jp|cn|in|br)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|35|6011|65)"
CALLING_CODES = r"^\+(?:1|7|20|27|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
RESERVED = r"^(?:0|255)\.|^(?:0:){7}"
FOR = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write to|reach|correo|courriel|kontakt)\W*$",
    "ip": r"(?i)\b(?:ip|ipv[46]|host|server|address|login from|client)\W*$",
    "card": r"(?i)\b(?:card|visa|mastercard|amex|credit|debit|carte|karte|tarjeta)\W*(?:no|number|nr)?\W*$",
    "phone": r"(?i)\b(?:call|phone|tel|telephone|telefon|mobile|fax|tél)\W*$",
}
AGAINST = r"(?i)\b(?:token|sha\d*|md5|hash|isbn|version|build|order|invoice|key|uuid|id)\W*$"


#: What a text must hold to have a match of a pattern at all.
NEEDS = {
    "b_email": "@", "b_ip": r"[0-9]\.[0-9]", "b_card": r"(?:[0-9][\x20-]?){15}[0-9]", "b_phone": r"\+[0-9]",
    "t_email": r"(?i)[\[(]at[\])]", "t_ip": r"(?::[0-9A-Fa-f]{1,4}){7}", "t_card": r"(?:[0-9][\x20-]?){14}[0-9]", "t_phone": r"\([0-9]{2,4}\)",
}


def _matches(text: Column, pattern: str, needed: str) -> Column:
    """Pieces and matches of the pattern by turns: matches are the 2nd, 4th, ... element. text has no U+0001 and U+0002."""
    found = F.split(F.regexp_replace(text, f"({pattern})", "\u0001$1\u0002"), "[\u0001\u0002]", -1)
    return F.when(text.contains(needed) if needed == "@" else text.rlike(needed), found).otherwise(F.array(text))


def _spans(parts: str, kind: int, base: bool) -> Column:
    """Structs of the matches in the column ``parts`` with offsets; blocks keep the work linear in their number."""
    at = F.col(parts)
    n = F.size(at)
    blocks = F.sequence(F.lit(0), ((n - 1) / BLOCK).cast("int"))
    lengths = F.transform(blocks, lambda b: F.aggregate(F.slice(at, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0), lambda a, x: a + F.char_length(x)))
    empty = F.expr("cast(array() as array<struct<kind:int,start:int,end:int,base:boolean,s:string,before:string,after:string>>)")

    def step(acc: Column, j: Column) -> Column:
        x = F.element_at(at, j)
        end = acc["pos"] + F.char_length(x)
        span = F.struct(
            F.lit(kind).alias("kind"), acc["pos"].alias("start"), end.alias("end"), F.lit(base).alias("base"), x.alias("s"),
            F.right(F.element_at(at, j - 1), F.lit(40)).alias("before"), F.left(F.element_at(at, j + 1), F.lit(1)).alias("after"),
        )
        return F.struct(end.alias("pos"), F.when(j % 2 == 0, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def block(b: Column, lens: Column) -> Column:
        start = F.aggregate(F.slice(lens, F.lit(1), b), F.lit(0), lambda a, x: a + x)
        within = F.sequence(b * BLOCK + 1, F.least(b * BLOCK + BLOCK, n))
        return F.aggregate(within, F.struct(start.alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])

    found = F.flatten(F.transform(F.array(lengths), lambda lens: F.flatten(F.transform(blocks, lambda b: block(b, lens)))))
    return F.when(n > 1, found).otherwise(empty)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether the digits in s have a valid check digit."""
    each = F.transform(F.regexp_extract_all(F.reverse(_digits(s)), F.lit("[0-9]"), F.lit(0)), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise((x.cast("int") * 2 / 10).cast("int") + x.cast("int") * 2 % 10))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(x: Column) -> Column:
    """The check of a candidate's kind."""
    n = F.length(_digits(x["s"]))
    parts = F.split(x["s"], r"\.")
    ip = F.when(x["base"], F.forall(parts, lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(parts, lambda p: F.right(p, F.lit(9)).try_cast("int") <= 255)).otherwise(F.lit(True))
    card = n.between(F.when(x["base"], 16).otherwise(15), 19) & F.when(n <= 19, luhn(x["s"])).otherwise(False)
    return F.when(x["kind"] == 1, ip).when(x["kind"] == 2, card).when(x["kind"] == 3, n.between(8, 15)).otherwise(F.lit(True))


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, "0").when(yes, "2").otherwise("1")


def _votes(x: Column) -> Column:
    """One character per labeler, then the span's shape (digits, separators)."""
    never = F.lit(False)
    digits = _digits(x["s"])

    def by_kind(values: list[Column]) -> Column:
        out = F.when(x["kind"] == 0, values[0])
        for i in (1, 2, 3):
            out = out.when(x["kind"] == i, values[i])
        return out

    usual = [x["s"].rlike(DOMAIN_ENDINGS), ~x["s"].rlike(RESERVED), digits.rlike(ISSUERS), x["s"].rlike(CALLING_CODES)]
    form = by_kind([x["s"].contains("@"), x["s"].rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$"), x["s"].rlike(r"^([0-9]{16}|[0-9]{4}([ -][0-9]{4}){3})$"), x["s"].rlike(r"^\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-][0-9]{3}[ .-]?[0-9]{4}$")])
    edge = x["before"].rlike(r"[\p{L}\p{N}]$") | x["after"].rlike(r"^[\p{L}\p{N}]")
    labelers = [
        _vote(form, never),  # format
        _vote(~edge, edge),  # boundary
        _vote(by_kind(usual), by_kind([~usual[0], ~usual[1], never, ~usual[3] & x["s"].startswith("+")])),  # gazetteer
        _vote(by_kind([x["before"].rlike(FOR[k]) for k in KINDS]), never),  # context for
        _vote(never, x["before"].rlike(AGAINST)),  # context against
        _vote(never, (x["kind"] >= 2) & digits.rlike(r"^([0-9])\1*$|^0?1234567")),  # degenerate
    ]
    shape = [F.least(F.length(digits) / 6, F.lit(3)).cast("int").cast("string"), F.when(x["s"].rlike(r"[ .-]"), "1").otherwise("0")]
    return F.concat(*labelers, *shape)


N_VOTES = 6


def expectation_maximisation(counts: dict[str, float], rounds: int = EM_ROUNDS) -> tuple[dict[str, float], list[dict[str, tuple[float, float]]], float]:
    """Likelihood of each pattern of votes, each labeler's P(vote | no, yes), and the prior, under independent labelers.

    The start takes every vote as right four times of five; counts are smoothed by half a case.
    """
    if not counts:
        return {}, [], 0.5
    width = N_VOTES

    def spread(right: float) -> dict[str, tuple[float, float]]:
        return {"2": (0.5 * (1 - right), 0.5 * right), "1": (0.5, 0.5), "0": (0.5 * right, 0.5 * (1 - right))}

    table, prior = [spread(0.8) for _ in range(width)], 0.5
    yes: dict[str, float] = {}
    total = sum(counts.values())
    for _ in range(rounds):
        for p in counts:
            odds = math.log(prior / (1 - prior)) + sum(math.log(table[i][p[i]][1] / table[i][p[i]][0]) for i in range(width))
            yes[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))
        mass = sum(n * yes[p] for p, n in counts.items())
        prior = min(0.999, max(0.001, (mass + 1) / (total + 2)))
        for i in range(width):
            cells = {v: [0.5, 0.5] for v in "012"}
            for p, n in counts.items():
                cells[p[i]][1] += n * yes[p]
                cells[p[i]][0] += n * (1 - yes[p])
            table[i] = {v: (c[0] / (total - mass + 1.5), c[1] / (mass + 1.5)) for v, c in cells.items()}
    return yes, table, prior


def fit_classifier(yes: dict[str, float], counts: dict[str, float], rounds: int = FIT_ROUNDS) -> dict[str, float]:
    """Score of each pattern (votes and shape) by a logistic model fitted on the likelihoods of its votes."""
    total = sum(counts.values()) or 1.0
    weights: dict[tuple[int, str], float] = {}
    bias, scores = 0.0, {}
    for step in range(rounds):
        grad: dict[tuple[int, str], float] = {}
        down = 0.0
        for p, n in counts.items():
            z = bias + sum(weights.get((i, v), 0.0) for i, v in enumerate(p))
            scores[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))
            off = (scores[p] - yes[p[:N_VOTES]]) * n / total
            down += off
            for i, v in enumerate(p):
                grad[i, v] = grad.get((i, v), 0.0) + off
        if step < rounds - 1:
            bias -= down
            for key, g in grad.items():
                weights[key] = weights.get(key, 0.0) - g
    return scores


def _meets(x: Column, spans: Column) -> Column:
    """Whether x overlaps one of spans, which are disjoint and in order: the last one that begins before x ends is searched for by halving."""
    n = F.size(spans)

    def halve(acc: Column, _: Column) -> Column:
        middle = F.shiftright(acc["low"] + acc["high"], 1)
        before = F.get(spans, middle)["start"] < x["end"]
        open_ = acc["low"] < acc["high"]
        return F.struct(F.when(open_ & before, middle + 1).otherwise(acc["low"]).alias("low"), F.when(open_ & ~before, middle).otherwise(acc["high"]).alias("high"))

    begun = F.aggregate(F.sequence(F.lit(1), F.length(F.bin(n))), F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda acc: acc["low"])
    return F.when(n > 0, F.coalesce(F.get(spans, begun - 1)["end"] > x["start"], F.lit(False))).otherwise(False)


def candidates(docs: DataFrame, kept: list[str]) -> DataFrame:
    """row (a struct of the columns ``kept`` of docs) and found: kind, start, end, base, votes of every base span and every tight candidate that overlaps none."""
    text = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "\u0001\u0002", "\u0003\u0003")
    rows = docs.select(F.struct(*[column(c) for c in kept]).alias("row"), text.alias("t"))
    rows = rows.select("row", *[_matches(F.col("t"), p, NEEDS[f"{name}_{k}"]).alias(f"{name}_{k}") for name, group in (("b", BASE), ("t", TIGHT)) for k, p in group.items()])
    rows = rows.select("row", *[F.filter(_spans(f"{name}_{k}", i, name == "b"), _valid).alias(f"{name}_{k}") for name in "bt" for i, k in enumerate(KINDS)])
    base, tight = F.concat(*[F.col(f"b_{k}") for k in KINDS]), F.concat(*[F.col(f"t_{k}") for k in KINDS])
    rows = rows.select("row", *[f"b_{k}" for k in KINDS], tight.alias("tight"))
    # The base spans of one kind are disjoint and in order, those of several kinds may not be.
    apart = F.filter("tight", lambda x: ~reduce(Column.__or__, [_meets(x, F.col(f"b_{k}")) for k in KINDS]))
    rows = rows.select("row", F.concat(base, F.when(F.size("tight") > 0, apart).otherwise(F.col("tight"))).alias("found"))
    return rows.select("row", F.transform("found", lambda x: F.struct(x["kind"], x["start"], x["end"], x["base"], _votes(x).alias("votes"))).alias("found"))


def train(found: DataFrame) -> dict[int, dict[str, float]]:
    """kind -> score of each pattern, from the pattern counts of all candidates."""
    counts: dict[int, dict[str, float]] = {}
    for kind, votes, n in found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes").count().collect():  # a bounded number of patterns
        counts.setdefault(kind, {})[votes] = float(n)
    model = {}
    for kind, by_pattern in sorted(counts.items()):
        by_pattern = dict(sorted(by_pattern.items()))
        by_votes: dict[str, float] = {}
        for p, n in by_pattern.items():
            by_votes[p[:N_VOTES]] = by_votes.get(p[:N_VOTES], 0.0) + n
        yes, _, _ = expectation_maximisation(by_votes)
        model[kind] = fit_classifier(yes, by_pattern)
    return model


def _decided(found: DataFrame, model: dict[int, dict[str, float]], threshold: float) -> DataFrame:
    """row and spans (kind, start, end, base, by kind and start) of candidates()."""
    good = sorted(f"{kind}:{p}" for kind, scores in model.items() for p, s in scores.items() if s >= threshold)
    wanted = F.array(*[F.lit(g) for g in good]) if good else F.array().cast("array<string>")
    key = lambda x: F.concat(x["kind"].cast("string"), F.lit(":"), x["votes"])
    good_ones = found.select("row", F.filter("found", lambda x: x["base"] | F.array_contains(wanted, key(x))).alias("kept"))
    # Two added spans of different kinds may overlap: the kind listed first stays. Those of one kind are disjoint and in order.
    added = [F.filter("kept", lambda x, i=i: ~x["base"] & (x["kind"] == i)).alias(f"added_{i}") for i in range(len(KINDS) - 1)]
    rows = good_ones.select("row", "kept", *added)
    covered = lambda x: reduce(Column.__or__, [(x["kind"] > i) & _meets(x, F.col(f"added_{i}")) for i in range(len(KINDS) - 1)])
    apart = F.filter("kept", lambda x: x["base"] | ~covered(x))
    return rows.select("row", F.array_sort(F.transform(apart, lambda x: F.struct(x["kind"], x["start"], x["end"], x["base"]))).alias("spans"))


def personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id and spans: kind (place in KINDS), start, end, base, by kind and start, for every row of docs."""
    found = settle(candidates(docs, ["doc_id"]))
    return _decided(found, train(found), threshold).select("row.doc_id", "spans")


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def _only(kind: int):
    return lambda x: F.when(x == kind, x).otherwise(-1)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (all, as kind:start:end), n_spans (all) and n_added."""
    rows = personal_data(docs).select("doc_id", "spans", F.filter("spans", lambda x: x["base"]).alias("base"))
    kinds = F.col("base.kind")
    counts = [F.size(F.array_remove(F.transform(kinds, _only(i)), F.lit(-1))).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    n = F.size("spans").cast("long")
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), n.alias("n_spans"), (n - F.size("base")).alias("n_added"))


def masked(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with every span of text replaced by its kind in brackets; each row by its own spans, so ids may repeat or be null."""
    # The texts are searched again rather than written: the model needs all votes before the first row can be cut.
    seen = settle(candidates(docs, ["doc_id"]))
    model = train(seen)
    free(seen)
    names, text = F.array(*[F.lit(f"[{k}]") for k in KINDS]), F.col("row")["text"]
    rows = _decided(candidates(docs, docs.columns), model, threshold)
    rows = rows.select("row", F.array_sort(F.transform("spans", lambda x: F.struct(x["start"], x["end"], x["kind"]))).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.substring(text, acc["pos"] + 1, x["start"] - acc["pos"])
        grown = F.struct(x["end"].alias("pos"), F.concat(acc["out"], F.array(gap, F.element_at(names, x["kind"] + 1))).alias("out"))
        return F.when(x["start"] >= acc["pos"], grown).otherwise(acc)

    zero = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate("spans", zero, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["pos"] + 1, F.length(text))))
    new = F.when(F.size("spans") == 0, text).otherwise(cut)
    return rows.select(*[new.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])
