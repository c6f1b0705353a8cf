"""Language identification by error-correcting output codes.

Every language is given a codeword of bits. For each bit a binary logistic classifier over hashed
character n-grams (1 to 3, lower case) learns whether a text's language has that bit set. A text is
given to the codeword with the least weighted loss: each bit's logistic loss counts by how often
the bit's classifier was right on that language in training. Errors of single classifiers are so
outvoted, and a small gap between the two best codewords marks a text as ambiguous.

Training uses at most ``PER_LANGUAGE`` distinct rows of each language and ``MAX_ROWS`` of all languages
(in expectation; chosen by a hash of doc_id and text; twice MAX_ROWS is the hard bound), featurised where they
lie; scoring reads every whole text once, without a shuffle.

A text that is null or has no letter is ``und`` with score 0. Without any training row every text
is ``und``; with one language every text with a letter is in it. Of two codewords at the same loss the first
language by name is taken. Rows that repeat a doc_id are read each on its own, equal ones count once in
training. Columns other than doc_id, text and lang are not read, so their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.quality import featurised, id_remainder
from granary.llm.sparse import Features, unpacked, weighted

FEATURES = Features(buckets=1 << 12, grams=(1, 2, 3), lower=True)
PER_LANGUAGE, EPOCHS, BATCH, RATE, SHARPNESS = 800, 30, 32, 300.0, 4.0
AMBIGUOUS = 0.2
#: Training rows of all languages, and rows that are unpacked at once.
MAX_ROWS, SLAB = 8000, 512


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1: the exhaustive code for up to 5 languages, else the best of 64 random codes."""
    if n <= 5:
        columns = [[1] + [1 if (k >> i) & 1 else -1 for i in range(n - 1)] for k in range(2 ** (n - 1) - 1)]
        return np.array(columns or [[1] * n], dtype=np.float32).T.reshape(n, -1)
    bits, best, gap = int(np.ceil(10 * np.log2(n))), None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1, 1], (n, bits))
        apart = int((bits - code @ code.T + 2 * bits * np.eye(n)).min()) // 2
        if apart > gap:
            best, gap = code, apart
    return best.astype(np.float32)


def fit(rows: list[tuple[bytes, bytes]], labels: list[str]) -> dict:
    """langs, code, weights (buckets x bits), bias, trust (langs x bits)."""
    langs = sorted(set(labels))
    if not langs:
        return {"langs": []}
    code = codewords(len(langs))
    place = {x: i for i, x in enumerate(langs)}
    y = np.array([place[x] for x in labels])
    w, b = np.zeros((FEATURES.buckets, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
    rng, steps, step = np.random.default_rng(11), EPOCHS * -(-len(y) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(y))
        for start in range(0, len(order), SLAB):
            slab = order[start : start + SLAB]
            dense = unpacked([rows[k] for k in slab], FEATURES.buckets)
            for i in range(0, len(slab), BATCH):
                target, xs, rate = code[y[slab[i : i + BATCH]]], dense[i : i + BATCH], 1 - step / steps
                grad = -target / (1 + np.exp(target * (xs @ w + b))) / len(xs)
                w -= xs.T @ (RATE * rate * grad)
                b -= 0.5 * rate * grad.sum(axis=0)
                step += 1
    hits = np.zeros(code.shape, dtype=np.float64)
    for start in range(0, len(y), SLAB):
        some = y[start : start + SLAB]
        np.add.at(hits, some, np.sign(unpacked(rows[start : start + SLAB], FEATURES.buckets) @ w + b) == code[some])
    trust = hits / np.bincount(y, minlength=len(langs))[:, None] + 1e-3
    return {"langs": langs, "code": code, "weights": w, "bias": b, "trust": (trust / trust.sum(axis=1, keepdims=True)).astype(np.float32)}


def decode(x: np.ndarray, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row the place of the best codeword, its share among all, and its lead over the next."""
    f = weighted(x, model["weights"]) + model["bias"]
    loss = np.stack([(np.logaddexp(0, -f * word) * trust).sum(axis=1) for word, trust in zip(model["code"], model["trust"], strict=True)], axis=1)
    order = np.sort(loss, axis=1)
    share = np.exp(-SHARPNESS * (loss - order[:, :1]))
    lead = order[:, 1] - order[:, 0] if loss.shape[1] > 1 else np.full(len(x), np.inf)
    return loss.argmin(axis=1), 1 / share.sum(axis=1), lead


def train(docs: DataFrame, remainder: int = 0, modulus: int = 5, per_language: int = PER_LANGUAGE) -> dict:
    """Fit on rows with a language whose crc32(doc_id as text) mod modulus is not remainder."""
    known = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string")).where("text is not null and lang is not null and doc_id is not null")
    known = known.where(id_remainder(F.col("doc_id"), modulus) != remainder)
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return fit([], [])
    wanted = min(per_language, MAX_ROWS / len(counts))
    share = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, wanted / n))])
    lot = F.xxhash64("doc_id", "text")
    picked = known.where(F.pmod(lot, F.lit(1 << 20)) / (1 << 20) < share[F.col("lang")])
    got = featurised(picked, FEATURES, "lang", lot).distinct().orderBy("lot", "label", "places", "values").limit(2 * MAX_ROWS).toArrow()
    return fit(list(zip(got["places"].to_pylist(), got["values"].to_pylist(), strict=True)), got["label"].to_pylist())


def identify(docs: DataFrame, model: dict) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            pred, scores, unsure = [], [], []
            for texts, x in FEATURES.frequencies(batch.column("text")):
                best, share, lead = decode(x, m) if m["langs"] else (None, None, None)
                for i, text in enumerate(texts):
                    known = bool(m["langs"]) and any(c.isalpha() for c in text)
                    pred.append(m["langs"][best[i]] if known else "und")
                    scores.append(float(share[i]) if known else 0.0)
                    unsure.append(bool(lead[i] < AMBIGUOUS) if known else True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(pred, pa.string()), pa.array(scores, pa.float64()), pa.array(unsure, pa.bool_())], ["doc_id", "lang_pred", "score", "ambiguous"])

    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("lang_pred", "string").add("score", "double").add("ambiguous", "boolean")
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(rows, schema)


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, from a model trained on docs itself."""
    held = F.coalesce(id_remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    return identify(docs, train(docs)).select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
