"""Token counts: an exact histogram of encoded lengths and what its suffix sums answer.

Every whole text is encoded once with a public byte-pair vocabulary (``RANKS``, the path of a
.tiktoken file that the driver reads and broadcasts); documents are counted by length. From the
histogram, running sums give for every context limit how many documents are longer, the tokens of
all, the tokens left when each text is cut at the limit, and the quantile of each length. The histogram has one
row per distinct length, far fewer than documents.

Null and empty texts have length 0. Repeated rows count each; equal lengths are one row. A column named
n_tokens is replaced, others stay; an empty table has an empty histogram. The caller passes the path of the
vocabulary; executors get its content by broadcast and read no file.
"""

from __future__ import annotations

import base64
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.textkit import running_sum, settle, with_texts_mapped

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
_encoders: dict[bytes, object] = {}


def encoder(ranks: bytes):
    """The tiktoken encoding of a vocabulary file's content, made once in each process."""
    if ranks not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        _encoders[ranks] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
    return _encoders[ranks]


def read_ranks(spark: SparkSession, path: str = RANKS) -> bytes:
    """The vocabulary file's content; it is small, and Spark reads it wherever it lies."""
    return bytes(spark.read.format("binaryFile").load(path if "://" in path else f"file://{path}").first()["content"])


def token_lengths(docs: DataFrame, ranks: bytes) -> DataFrame:
    """docs with n_tokens in place of a column of that name; text is encoded as ordinary text."""
    shared = docs.sparkSession.sparkContext.broadcast(ranks)

    def lengths(texts: pa.Array) -> pa.Array:
        encode = encoder(shared.value).encode_ordinary
        return pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], pa.int64())

    return with_texts_mapped(docs, [c for c in docs.columns if c.lower() != "n_tokens"], "n_tokens", T.LongType(), lengths)


def histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs: the documents of each length."""
    return lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs"))


def limits(hist: DataFrame) -> DataFrame:
    """For each length L of hist: documents of L and above L, tokens of all at most L, tokens when cut at L, quantile."""
    hist = settle(hist)
    rows = hist.select("*", (F.col("n_tokens") * F.col("n_docs")).alias("tokens"), F.lit(0).alias("all"))
    run = running_sum(rows, ["all"], ["n_tokens"], {"docs_below": "n_docs", "tokens_below": "tokens"})
    docs, tokens = hist.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0))).first()
    run = run.withColumns({"total_docs": F.lit(docs).cast("long"), "total_tokens": F.lit(tokens).cast("long")})
    upto = F.col("docs_below") + F.col("n_docs")
    longer = F.col("total_docs") - upto
    return run.select(
        "n_tokens", "n_docs", longer.alias("docs_longer"), (F.col("tokens_below") + F.col("tokens")).alias("tokens_upto"),
        (F.col("tokens_below") + F.col("tokens") + longer * F.col("n_tokens")).alias("tokens_cut"), "total_docs", "total_tokens", (upto / F.col("total_docs")).alias("quantile"),
    )


def answers(table: DataFrame, context_limits: list[int], quantiles: list[float]) -> DataFrame:
    """kind, at, value: the tokens left when every text is cut at each limit, and the least length at each quantile."""
    of_limits = table.withColumn("at", F.explode(F.array(*[F.lit(int(x)) for x in context_limits]).cast("array<bigint>")))
    last = F.max_by(F.struct("tokens_upto", "docs_longer"), F.when(F.col("n_tokens") <= F.col("at"), F.col("n_tokens")))
    cut = of_limits.groupBy("at").agg(last.alias("x"), F.first("total_docs").alias("n"))
    value = F.coalesce("x.tokens_upto", F.lit(0)) + F.coalesce("x.docs_longer", "n") * F.col("at")
    cut = cut.select(F.lit("cut").alias("kind"), F.col("at").cast("double").alias("at"), value.alias("value"))
    of_quantiles = table.withColumn("at", F.explode(F.array(*[F.lit(float(x)) for x in quantiles]).cast("array<double>")))
    return cut.union(of_quantiles.where("quantile >= at").groupBy("at").agg(F.min("n_tokens").alias("value")).select(F.lit("quantile"), "at", "value"))
