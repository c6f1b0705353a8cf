"""Periodic runs: stretches of words that repeat with a period, found by probing a harmonic grid.

A run is a stretch of consecutive words whose smallest period is q (words q apart are equal), of at least
``max(LEAST, REPEATS * q)`` words, that no word beside it extends. In a run of period p the places i with word
i equal to word i + p fill a stretch of at least 2p, which holds two neighbouring multiples of p. So only words at
jp, (j+1)p and (j+2)p are compared, for every p: n / p probes each, n log n in all, taken as arrays. A survivor is
extended to both sides by comparing chunks of doubling size. Periods are tried in ascending order, and a survivor
inside a run that is already found is passed over: there the period is a multiple of the run's (two periods p and
q of a stretch of p + q words imply their common divisor), or the survivor is too short to be a run.

Work is done text by text inside Arrow batches, so a text of any length is read whole, and memory is bounded by
the longest text. Null and empty texts have no words and no runs. Rows that repeat a doc_id are read each on its
own; a null doc_id changes nothing in runs(). Columns of any name stay in collapsed(); an empty table gives none.
Of runs with equal exponents the first, then that of the smaller period, is the greatest.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.textkit import NOT_SPACE, Words, column, fresh, pieces, with_texts_mapped

LEAST, REPEATS = 24, 3
#: Probes that are made at once, and the first chunk of an extension.
PROBES, CHUNK = 1 << 18, 32

_RUN = T.StructType().add("start", "long").add("length", "long").add("period", "long")


def _probes(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (p, i) of a period and a multiple of it with i + 2p < n, by ascending p, about PROBES at a time."""
    top = n // REPEATS
    counts = np.maximum((n - 1) // np.arange(1, top + 1, dtype=np.int64) - 1, 0)
    ends, first = np.cumsum(counts), 0
    while first < top:
        last = int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PROBES, side="right"))
        last = min(max(last, first + 1), top)
        some = counts[first:last]
        p = np.repeat(np.arange(first + 1, last + 1, dtype=np.int64), some)
        j = np.arange(len(p)) - np.repeat(np.cumsum(some) - some, some)
        yield p, j * p
        first = last


def _matching(x: np.ndarray, y: np.ndarray) -> int:
    """How many leading elements of two arrays of one length are equal; compared in chunks of doubling size."""
    at, size = 0, CHUNK
    while at < len(x):
        differ = x[at : at + size] != y[at : at + size]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, size * 2
    return len(x)


def find_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of an array of word codes, by start, then period."""
    n, found = len(words), []
    if n < LEAST:
        return []
    reach = np.zeros(n, dtype=np.int64)  # the furthest end of the found runs that hold a word
    for p, i in _probes(n):
        middle = words[i + p]
        hit = np.flatnonzero((words[i] == middle) & (middle == words[i + 2 * p]))
        hit = hit[reach[i[hit]] <= i[hit] + 2 * p[hit]]
        for period, at in zip(p[hit].tolist(), i[hit].tolist(), strict=True):
            if reach[at] > at + 2 * period:
                continue
            head, tail = words[: n - period], words[period:]
            a = at - _matching(head[:at][::-1], tail[:at][::-1])
            b = at + _matching(head[at:], tail[at:])
            length = b - a + period
            # Beyond at + p the survivor's second pair belongs to another stretch.
            if b > at + period and length >= max(LEAST, REPEATS * period):
                found.append((a, length, period))
                np.maximum(reach[a : a + length], a + length, out=reach[a : a + length])
    return sorted(found, key=lambda r: (r[0], r[2]))


def dropped(runs: list[tuple[int, int, int]], n: int) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    steps = np.zeros(n + 1, dtype=np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return np.cumsum(steps[:n]) > 0


def greatest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period; ties to the smaller start, then period."""
    best = None
    for run in runs:  # by start, then period
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    return best


def planted(n: int, lot: int) -> np.ndarray:
    """For each of n words the place of the word that stands there when a repetition is planted by the number lot: one text in ten."""
    at = np.arange(n)
    if n and lot % 10 == 0:
        g = lot // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        at[a:] = a + np.arange(n - a) % p
    return at


def _each(column: pa.Array) -> Iterator[tuple[Words, int, int, np.ndarray]]:
    """For each text its piece's words, the first and last of its own there, and their codes."""
    for _, texts in pieces(column):
        words = Words(texts, NOT_SPACE)
        codes, b = words.hashes(), words.bounds
        for r in range(len(texts)):
            yield words, int(b[r]), int(b[r + 1]), codes[b[r] : b[r + 1]]


def runs(docs: DataFrame, name: str = "runs") -> DataFrame:
    """docs with the runs of each text (array of start, length, period in words) in place of a column of that name."""
    kept = [c for c in docs.columns if c != name]
    return _mapped(docs, kept, name, T.ArrayType(_RUN), lambda words, low, high, codes: [dict(zip(_RUN.names, r, strict=True)) for r in find_runs(codes)])


def collapsed(docs: DataFrame) -> DataFrame:
    """docs with every run of text cut to its first period; texts without runs stay as they are, others are joined by single spaces."""
    (name,) = fresh(docs.columns, "collapsed")

    def cut(words: Words, low: int, high: int, codes: np.ndarray) -> str | None:
        found = find_runs(codes)
        return b" ".join(words.word(low + k) for k in np.flatnonzero(~dropped(found, high - low))).decode() if found else None

    out = _mapped(docs, docs.columns, name, T.StringType(), cut)
    return out.select(*[F.coalesce(name, F.col("text").cast("string")).alias(c) if c == "text" else column(c) for c in docs.columns])


def _mapped(docs: DataFrame, kept: list[str], name: str, kind: T.DataType, f) -> DataFrame:
    """The columns kept of docs, and f(words, first, last, codes) of each text as a column."""
    of = pa.list_(pa.struct([(c, pa.int64()) for c in _RUN.names])) if isinstance(kind, T.ArrayType) else pa.string()
    return with_texts_mapped(docs, kept, name, kind, lambda texts: pa.array([f(*x) for x in _each(texts)], of))


_DIGEST = "doc_id {}, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the greatest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256 of each text, with repetitions planted by planted()."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lot = F.when(F.col("doc_id").isNotNull(), F.crc32(F.col("doc_id").cast("string").cast("binary")))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string())])
        for batch in batches:
            out = []
            for (words, low, high, codes), lot in zip(_each(batch.column("text")), batch.column("lot").to_pylist(), strict=True):
                n = high - low
                places = planted(n, 1 if lot is None else lot)
                found = find_runs(codes[places])
                left = b" ".join([words.word(low + k) for k in places[~dropped(found, n)].tolist()])
                listed = "".join(f"{s},{k},{p}\n" for s, k, p in found)
                best = greatest(found)
                four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                out.append((len(found), *four, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()))
            columns = list(zip(*out, strict=True)) if out else [()] * len(schema)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(x, f.type) for x, f in zip(columns, schema, strict=True)]], ["doc_id", *schema.names])

    return docs.select("doc_id", lot.alias("lot"), F.col("text").cast("string").alias("text")).mapInArrow(rows, _DIGEST.format(kind))
