"""Spans of texts as arrays of (start, end) in code points: pieces, sentences, occurrences, mentions.

A text becomes an array of code points once. Where it may be cut is found once too, as sorted arrays of places, and
each cut is a search in them. Texts are dealt to tasks by Spark and come in Arrow batches. A null text has no spans.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPANS = "array<struct<start:long,end:long>>"

#: Code points that are white space, by Unicode's rule.
SPACE = np.array([c for c in range(0x3001) if chr(c).isspace()], dtype=np.uint32)
_NEWLINE, _BLANK, _MARKS = ord("\n"), ord(" "), np.array([ord(c) for c in ".!?"], dtype=np.uint32)

Span = tuple[int, int]


class Points:
    """A text as code points, with its places of ink (what is no white space) and of cuts by sign."""

    def __init__(self, text: str):
        self.codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        self.space = np.isin(self.codes, SPACE)
        self.ink = np.flatnonzero(~self.space)
        self._places: dict[int, np.ndarray] = {}

    def places(self, sign: int) -> np.ndarray:
        if sign not in self._places:
            self._places[sign] = np.flatnonzero(self.codes == sign)
        return self._places[sign]

    def inked(self, span: Span) -> Iterator[Span]:
        """The span without white space at its ends; nothing if it is all white."""
        first, last = np.searchsorted(self.ink, span)
        if first < last:
            yield int(self.ink[first]), int(self.ink[last - 1]) + 1

    def pieces(self, span: Span, limit: int, signs: tuple[int, ...], overlap: int = 0) -> Iterator[Span]:
        """The span in pieces of at most limit, each cut at the last place of the first sign that has one in its second half, else at limit."""
        start, end = span
        while end - start > limit:
            low, stop = max(start + 1, start + limit // 2), start + limit
            for places in map(self.places, signs):
                k = int(np.searchsorted(places, stop))
                if k and places[k - 1] >= low:
                    stop = int(places[k - 1])
                    break
            yield start, stop
            start = max(start + 1, stop - overlap)
        if start < end:
            yield start, end

    def sentences(self) -> Iterator[Span]:
        """Stretches that end at a line end, or after a mark with white space or nothing behind it; a mark that stands alone ends none."""
        n = len(self.codes)
        behind = np.append(self.space[1:], True)[:n]
        before = np.append(True, self.space[:-1])[:n]
        marks = np.flatnonzero(np.isin(self.codes, _MARKS) & behind & ~before) + 1
        bounds = np.unique(np.concatenate([[0, n], marks, self.places(_NEWLINE)]))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield from self.inked((a, b))


def _each(spans: Callable[[str], Iterator[Span]]) -> Callable[[Column], Column]:
    """Spans of each text; texts leave their Arrow batch one at a time, and spans are held as two columns of numbers."""

    @F.arrow_udf(SPANS)
    def run(texts: pa.Array) -> pa.Array:
        starts, ends, bounds = array("q"), array("q"), array("i", [0])
        for text in texts:
            for a, b in spans(t) if (t := text.as_py()) else ():
                starts.append(a)
                ends.append(b)
            bounds.append(len(starts))
        both = pa.StructArray.from_arrays([pa.array(np.frombuffer(x, dtype=np.int64)) if x else pa.array([], pa.int64()) for x in (starts, ends)], ["start", "end"])
        return pa.ListArray.from_arrays(pa.array(np.frombuffer(bounds, dtype=np.int32)), both)

    return run


def lossless(text: Column, limit: int) -> Column:
    """Pieces of at most limit characters that hold all of the text, cut before a line end or else a space."""
    return _each(lambda t: Points(t).pieces((0, len(t)), limit, (_NEWLINE, _BLANK)))(text)


def overlapping(text: Column, limit: int, overlap: int) -> Column:
    """Pieces of at most limit characters, cut before a space, each beginning overlap characters before the end of the last; trimmed."""

    def spans(t: str) -> Iterator[Span]:
        points = Points(t)
        for piece in points.pieces((0, len(t)), limit, (_BLANK,), overlap):
            yield from points.inked(piece)

    return _each(spans)(text)


def sentences(text: Column, limit: int = 500) -> Column:
    """Sentences of each line, a longer one in parts of at most limit characters that end before a space; trimmed."""

    def spans(t: str) -> Iterator[Span]:
        points = Points(t)
        for whole in points.sentences():
            for part in points.pieces(whole, limit, (_BLANK,)):
                yield from points.inked(part)

    return _each(spans)(text)


def occurrences(text: Column, needle: str) -> Column:
    """All places of the needle, those that overlap too."""
    ahead = re.compile(f"(?={re.escape(needle)})")
    return _each(lambda t: ((m.start(), m.start() + len(needle)) for m in ahead.finditer(t)))(text)


def mentions(text: Column, pattern: str) -> Column:
    """Matches of a pattern, from the left, without overlap."""
    known = re.compile(pattern)
    return _each(lambda t: (m.span() for m in known.finditer(t)))(text)
