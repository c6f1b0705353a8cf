"""Quality classifier: learned vectors of hashed words and character n-grams, averaged per text.

Each word and each character n-gram of a text is hashed to a row of an embedding table; the
rows are averaged with their counts, and a softmax layer over the average gives the score. The
table and the layer are trained together by stochastic gradient descent in numpy.

Training uses at most ``SAMPLE`` labelled rows, the first by a hash of doc_id and text, whatever
the size of the corpus and however often an id repeats; their features, not their texts, come to the
driver, and are as wide for a long text as for a short one. Scoring reads every whole text once, without a shuffle.

Texts that are null, empty or without features get the score of the bias alone. Repeated label
rows count as often as they occur, rows that repeat a doc_id get its label each; null labels and ids are
left out. Equal scores are equal decisions. Without any label the score is 0.5; with one class only it
tends to that class. Columns of any name stay; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.sparse import Features, packed, unpacked, weighted
from granary.llm.textkit import fresh, with_texts_mapped

FEATURES = Features(buckets=1 << 14, grams=(2, 3, 4), words=True)
SAMPLE, DIM, EPOCHS, BATCH, RATE = 3000, 16, 40, 32, 40.0
#: Rows that are unpacked at once, a multiple of BATCH.
SLAB = 512
THRESHOLD = 0.7

def id_remainder(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def featurised(df: DataFrame, features: Features, label: str, lot: Column) -> DataFrame:
    """label (as string), lot (a long), places, values: the packed frequency row of each text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [packed(x) for _, xs in features.frequencies(batch.column("text")) for x in xs]
            places, values = zip(*pairs, strict=True) if pairs else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column("label"), batch.column("lot"), pa.array(places, pa.binary()), pa.array(values, pa.binary())], ["label", "lot", "places", "values"])

    text = F.col("text").cast("string")
    return df.select(F.col(label).cast("string").alias("label"), lot.alias("lot"), text.alias("text")).mapInArrow(rows, "label string, lot long, places binary, values binary")


def fit(rows: list[tuple[bytes, bytes]], labels: np.ndarray, features: Features = FEATURES, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights w and bias c with log odds of class 1 = frequencies @ w + c.

    The layers of the trained network are linear up to the softmax, so they fold into one
    vector: the embedding table times the difference of the output columns.
    """
    rng = np.random.default_rng(seed)
    table = rng.uniform(-1 / DIM, 1 / DIM, (features.buckets, DIM)).astype(np.float32)
    out, bias = rng.uniform(-0.1, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    steps, step = EPOCHS * max(1, -(-len(rows) // BATCH)), 0
    for _ in range(EPOCHS if len(rows) else 0):
        order = rng.permutation(len(rows))
        for start in range(0, len(order), SLAB):
            slab = order[start : start + SLAB]
            dense = unpacked([rows[k] for k in slab], features.buckets)
            for i in range(0, len(slab), BATCH):
                pick, x, rate = slab[i : i + BATCH], dense[i : i + BATCH], 1 - step / steps
                hidden = x @ table
                z = hidden @ out + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(pick)), labels[pick]] -= 1
                p /= len(pick)
                grad = p @ out.T
                out -= 0.5 * rate * (hidden.T @ p)
                bias -= 0.5 * rate * p.sum(axis=0)
                table -= x.T @ (RATE * rate * grad)
                step += 1
    return table @ (out[:, 1] - out[:, 0]), float(bias[1] - bias[0])


def train(docs: DataFrame, labels: DataFrame, remainder: int = 2, modulus: int = 4, sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Fit on labelled rows whose crc32(doc_id as text) mod modulus is not remainder."""
    known = labels.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType), F.col("quality").cast("int")).where("doc_id is not null and quality in (0, 1)")
    known = known.where(id_remainder(F.col("doc_id"), modulus) != remainder)
    # At most ``sample`` rows of two numbers, so this side can be broadcast.
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(picked), "doc_id")
    got = featurised(texts, FEATURES, "quality", F.xxhash64("doc_id", "text"))
    if texts.select("doc_id").count() > sample:  # ids repeat, so the bound is set again on what the join gives
        got = got.orderBy("lot", "label", "places", "values").limit(sample)
    rows = sorted(zip(*[x.to_pylist() for x in got.toArrow().columns], strict=True), key=lambda r: (r[1], r[0], r[2], r[3]))  # not in the order of tasks
    return fit([r[2:] for r in rows], np.array([int(r[0]) for r in rows], dtype=np.int64))


def score(docs: DataFrame, model: tuple[np.ndarray, float], keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The columns ``keep`` of docs (doc_id) and ``name``, the probability of class 1, for every row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> pa.Array:
        w, c = shared.value
        odds = np.concatenate([weighted(x, w) + c for _, x in FEATURES.frequencies(texts)] or [np.zeros(0)])
        return pa.array(1 / (1 + np.exp(-odds.astype(np.float64))))

    return with_texts_mapped(docs, keep or ["doc_id"], name, T.DoubleType(), scores)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (its row was barred from training), score, predicted (score >= THRESHOLD)."""
    scored = score(docs, train(docs, labels))
    held = F.coalesce(id_remainder(F.col("doc_id"), 4) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that are predicted 0; all columns stay."""
    (name,) = fresh(docs.columns, "score")
    return score(docs, train(docs, labels), docs.columns, name).where(F.col(name) >= THRESHOLD).drop(name)
