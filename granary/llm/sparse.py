"""Hashed character n-grams and words of texts as rows of bucket counts, for the small models.

A text is read as code points. Each n-gram of the wanted lengths, and each word if wanted, is
hashed to one of ``buckets``; the counts of a text are one row of a matrix. All work is on
arrays, and a row is as wide whatever the length of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from granary.llm.textkit import span_hashes

ROWS, CHARS = 64, 1 << 18


@dataclass(frozen=True)
class Features:
    """buckets must be a power of two."""

    buckets: int
    grams: tuple[int, ...]
    words: bool = False
    lower: bool = False

    def counts(self, texts: list[str]) -> np.ndarray:
        """A row of float32 counts for each text."""
        # A line feed stands before and after each text, so that one of the two between texts lies inside any gram over both.
        lens = np.array([len(t) + 2 for t in texts])
        points = np.frombuffer("".join(f"\n{t}\n" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        row = np.repeat(np.arange(len(texts), dtype=np.int64) * self.buckets, lens)
        space = (points == 32) | ((points >= 9) & (points <= 13))
        gaps = np.concatenate([[0], np.cumsum(space)])
        shift = np.uint64(64 - (self.buckets.bit_length() - 1))
        out = np.zeros(len(texts) * self.buckets)
        wide = points.astype(np.uint64) + np.uint64(1)
        for n in self.grams:
            m = len(points) - n + 1
            if m <= 0:
                continue
            h = np.full(m, n, dtype=np.uint64)
            for j in range(n):
                h = h * np.uint64(0x100000001B3) + wide[j : j + m]
            # A gram may begin or end with white space, as the mark of a word's edge, but has none inside.
            inside = gaps[n - 1 : n - 1 + m] - gaps[1 : 1 + m] if n > 2 else (gaps[n : n + m] - gaps[:m]) // n
            ok = np.flatnonzero(inside == 0)
            at = row[ok] + ((h[ok] * np.uint64(0x9E3779B97F4A7C15)) >> shift).astype(np.int64)
            out += np.bincount(at, minlength=len(out))
        if self.words:
            edges = np.flatnonzero(np.diff(np.concatenate([[True], space]).astype(np.int8)))
            starts, ends = edges[::2], edges[1::2]
            at = row[starts] + (span_hashes(points, starts, ends) >> shift).astype(np.int64)
            out += np.bincount(at, minlength=len(out))
        return out.reshape(len(texts), self.buckets).astype(np.float32)

    def frequencies(self, column: pa.Array) -> Iterator[tuple[list[str], np.ndarray]]:
        """Runs of texts (null as empty) with their rows of relative frequencies."""
        held, size = [], 0
        for text in [*column.to_pylist(), ...]:
            if held and (text is ... or len(held) == ROWS or size > CHARS):
                x = self.counts(held)
                x /= np.maximum(x.sum(axis=1, keepdims=True), 1)
                yield held, x
                held, size = [], 0
            if text is not ...:
                text = text or ""
                held.append(text.lower() if self.lower else text)
                size += len(text)


def weighted(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w with each row summed by itself: the last bits of a product of matrices hang on the rows around."""
    at = [np.flatnonzero(row) for row in x]
    return np.array([(row[k] * w[k].T).sum(axis=-1) for row, k in zip(x, at, strict=True)]).reshape(len(x), *w.shape[1:])


def packed(x: np.ndarray) -> tuple[bytes, bytes]:
    """A row as its non-zero places (int32) and values (float32)."""
    at = np.flatnonzero(x)
    return at.astype(np.int32).tobytes(), x[at].tobytes()


def unpacked(rows: list[tuple[bytes, bytes]], buckets: int) -> np.ndarray:
    out = np.zeros((len(rows), buckets), dtype=np.float32)
    for i, (at, values) in enumerate(rows):
        out[i, np.frombuffer(at, dtype=np.int32)] = np.frombuffer(values, dtype=np.float32)
    return out
