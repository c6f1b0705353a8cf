"""Benchmark decontamination: find, and remove, passages of test items in training texts.

Words are runs of ASCII digits and letters and of characters outside ASCII, A-Z lowered. Each
item gives its windows of ``width`` consecutive words (one shorter window if it has fewer). The
distinct windows form a hash set that is broadcast while it holds at most ``max_windows`` of
them; every training text is scanned once, all its windows are looked up by a rolling hash, and
each hit is verified on its words. A larger benchmark is not broadcast: window hashes of
texts and items are joined by key instead (``_scan_joined``), with the same result.

Null and empty texts have no words and are never hit; a text of any length is scanned whole. An item whose
item_id is null still marks words, but is not counted or listed; items that share an item_id count once, and
items with the same window are all listed. Rows that repeat a doc_id are scanned, and returned, each on its
own. Columns of any name stay as they are. Empty tables give no rows, or no hits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.textkit import ALNUM, Words, column, fresh, pieces, settle, window_hashes, with_texts_mapped

WIDTH = 10
#: Largest number of benchmark windows and of bytes of benchmark text that are broadcast. The index holds some 30
#: bytes for each window and item that has it, and the items' words once: about 80 MB at both limits.
MAX_WINDOWS, MAX_BYTES = 500_000, 64 << 20

_SPAN = T.StructType().add("start", "integer").add("end", "integer")
_FOUND = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("spans", T.ArrayType(_SPAN))


def item_windows(text: bytes, width: int) -> tuple[Words, np.ndarray, int]:
    """Words of an item, its window hashes, and the window's width."""
    words = Words([text], ALNUM)
    size = min(width, len(words.starts))
    return words, window_hashes(words.hashes(), size) if size else np.zeros(0, dtype=np.uint64), size


@dataclass
class Windows:
    """The distinct windows of one size: sorted hashes, where their words stand in the index's text, and their items.

    The items of window i are owners[first[i] : first[i + 1]].
    """

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    owners: np.ndarray


@dataclass
class Index:
    """Windows by size, the items' words joined by spaces, and the items' ids."""

    by_size: dict[int, Windows]
    text: bytes
    names: list[str | None]


def build_index(items: list[tuple[str | None, bytes]], width: int) -> Index:
    blobs, at, parts = [], 0, {}
    for k, (_, text) in enumerate(items):
        words, hashes, size = item_windows(text, width)
        if not size:
            continue
        lengths = words.ends - words.starts
        begin = at + np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
        blobs.append(b" ".join(words.word(j) for j in range(len(lengths))))
        at += len(blobs[-1]) + 1
        n = len(hashes)
        parts.setdefault(size, []).append((hashes, begin[:n], (begin + lengths)[size - 1 :], np.full(n, k, dtype=np.int32)))
    blob, by_size = b" ".join(blobs), {}
    for size, found in parts.items():
        h, start, end, owner = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.argsort(h, kind="stable")
        h, start, end, owner = h[order], start[order], end[order], owner[order]
        alike = h[1:] == h[:-1]
        same, seen, last = np.zeros(len(h), dtype=np.int64), {}, None  # same: which of the windows of its hash
        for i in np.flatnonzero(np.append(alike, False) | np.append(False, alike)).tolist():
            if h[i] != last:
                seen, last = {}, h[i]
            same[i] = seen.setdefault(blob[start[i] : end[i]], len(seen))
        order = np.lexsort((owner, same, h))
        h, start, end, owner, same = h[order], start[order], end[order], owner[order], same[order]
        new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (same[1:] != same[:-1])]))
        by_size[size] = Windows(h[new], start[new], end[new], np.append(new, len(h)), owner)
    return Index(by_size, blob, [name for name, _ in items])


def _merge(positions: np.ndarray, words: Words, first: int) -> list[dict]:
    """Runs of hit words as byte spans of the text that starts at byte ``first`` of the piece."""
    breaks = np.flatnonzero(np.diff(positions) > 1)
    runs = zip(np.append(0, breaks + 1), np.append(breaks, len(positions) - 1), strict=True)
    return [{"start": int(words.starts[positions[a]] - first), "end": int(words.ends[positions[b]] - first)} for a, b in runs]


def scan_piece(texts: list[bytes], index: Index) -> list[tuple[int, int, list[str], list[dict]]]:
    """(words, hit words, ids of occurring items, byte spans of hit runs) of each text."""
    words = Words(texts, ALNUM)
    h, b = words.hashes(), words.bounds
    row_of = np.repeat(np.arange(len(texts)), np.diff(b))
    hit, items = np.zeros(len(h), dtype=bool), [set() for _ in texts]
    for size, known in index.by_size.items():
        w = window_hashes(h, size)
        low = np.searchsorted(known.hashes, w)
        near = np.minimum(low, len(known.hashes) - 1)
        for i in np.flatnonzero(known.hashes[near] == w).tolist():
            if row_of[i] != row_of[i + size - 1]:
                continue
            said, k = b" ".join(words.word(j) for j in range(i, i + size)), int(low[i])
            while k < len(known.hashes) and known.hashes[k] == w[i]:
                if index.text[known.start[k] : known.end[k]] == said:
                    hit[i : i + size] = True
                    items[row_of[i]].update(known.owners[known.first[k] : known.first[k + 1]].tolist())
                k += 1
    row_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
    out = []
    for r in range(len(texts)):
        positions = b[r] + np.flatnonzero(hit[b[r] : b[r + 1]])
        ids = sorted({index.names[k] for k in items[r]} - {None})
        out.append((int(b[r + 1] - b[r]), len(positions), ids, _merge(positions, words, row_starts[r]) if len(positions) else []))
    return out


def _found(rows: list) -> pa.StructArray:
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), span]
    parts = zip(*rows, strict=True) if rows else ((),) * 4
    return pa.StructArray.from_arrays([pa.array(x, kind) for x, kind in zip(parts, kinds, strict=True)], _FOUND.names)


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, width: int = WIDTH, max_windows: int = MAX_WINDOWS, name: str = "found") -> DataFrame:
    """The columns ``keep`` of docs (doc_id) and ``name``: n_words, n_hit, items (sorted ids as strings), spans (byte spans of runs of hit words)."""
    keep = keep or ["doc_id"]
    items = benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text")), F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x80-\\x{10FFFF}]+")))).first()
    if (size[0] or 0) > MAX_BYTES or (size[1] or 0) > max_windows:
        return _scan_joined(docs, items, keep, name, width)
    index = docs.sparkSession.sparkContext.broadcast(build_index([(r[0], r[1].encode().lower()) for r in items.collect()], width))

    def scanned(texts: pa.Array) -> pa.Array:
        return _found([x for _, some in pieces(texts, lower=True) for x in scan_piece(some, index.value)])

    return with_texts_mapped(docs, keep, name, _FOUND, scanned)


def _spots(h: np.ndarray, b: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(size, row, place in the piece, hash) of all windows of a piece that lie in one row."""
    row_of = np.repeat(np.arange(len(b) - 1), np.diff(b))
    for n in sizes:
        w = window_hashes(h, n)
        at = np.flatnonzero(row_of[: len(w)] == row_of[n - 1 :]) if len(w) else np.zeros(0, dtype=np.int64)
        yield n, row_of[at], at, w[at]


def _scan_joined(docs: DataFrame, items: DataFrame, keep: list[str], name: str, width: int) -> DataFrame:
    """scan() by joins on windows, for a benchmark too large to broadcast.

    Of every window of the texts only its hash is sent, and only hashes that the benchmark has come back; their
    words are then read from the texts and compared. The benchmark's side of each join has one row for each
    window, so a passage that many texts share is joined to one row of it.
    """

    def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words, hashes, n = item_windows(text.encode().lower(), width)
                out += [(int(h), n, b" ".join(words.word(j) for j in range(i, i + n)), item) for i, h in enumerate(hashes.view(np.int64))]
            yield pa.RecordBatch.from_pylist([dict(zip(("h", "size", "words", "item"), x, strict=True)) for x in out], pa.schema([("h", pa.int64()), ("size", pa.int32()), ("words", pa.binary()), ("item", pa.string())]))

    windows = items.mapInArrow(item_rows, "h long, size int, words binary, item string").distinct()
    windows = settle(windows.groupBy("h", "size", "words").agg(F.sort_array(F.collect_set("item")).alias("ids")))
    known = settle(windows.select("h", "size").distinct())
    sizes = [r[0] for r in known.select("size").distinct().collect()]  # at most ``width`` of them

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, texts in pieces(batch.column("text"), lower=True):
                words = Words(texts, ALNUM)
                for n, at_row, at, h in _spots(words.hashes(), words.bounds, sizes):
                    ids = batch.column("row").take(pa.array(first + at_row))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(at - words.bounds[at_row], pa.int32()), pa.array(h.view(np.int64)), pa.array(np.full(len(at), n, np.int32))], ["row", "at", "h", "size"])

    def spoken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, k = batch.column("hits").to_pylist(), 0
            for first, texts in pieces(batch.column("text"), lower=True):
                words = Words(texts, ALNUM)
                for r in range(len(texts)):
                    low, some = words.bounds[r], found[k]
                    said = [b" ".join(words.word(low + x["at"] + j) for j in range(x["size"])) for x in some]
                    ids = batch.column("row").take(pa.array([first + r] * len(some), pa.int64()))
                    yield pa.RecordBatch.from_arrays([ids, *[pa.array([x[c] for x in some], kind) for c, kind in (("at", pa.int32()), ("h", pa.int64()), ("size", pa.int32()))], pa.array(said, pa.binary())], ["row", "at", "h", "size", "words"])
                    k += 1

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, at = [], 0
            places, ids = batch.column("hits").to_pylist(), batch.column("listed").to_pylist()
            for _, texts in pieces(batch.column("kept").field("text"), lower=True):
                words = Words(texts, ALNUM)
                row_starts = np.cumsum([0] + [len(t) + 1 for t in texts])
                for r in range(len(texts)):
                    low = words.bounds[r]
                    hit = np.unique(np.concatenate([np.arange(low + x["at"], low + x["at"] + x["size"]) for x in places[at] or []] or [np.zeros(0, dtype=np.int64)]))
                    rows.append((int(words.bounds[r + 1] - low), len(hit), sorted(set(ids[at] or [])), _merge(hit, words, row_starts[r]) if len(hit) else []))
                    at += 1
            yield pa.RecordBatch.from_arrays([batch.column("kept"), _found(rows)], ["kept", "found"])

    kept = F.struct(*[column(c).cast("string").alias(c) if c == "text" else column(c).alias(c) for c in dict.fromkeys([*keep, "text"])])
    numbered = settle(docs.select(F.monotonically_increasing_id().alias("row"), kept.alias("kept")))
    texts = numbered.select("row", F.col("kept")["text"].alias("text"))
    candidates = texts.mapInArrow(hashed, "row long, at int, h long, size int").join(known, ["h", "size"], "left_semi")
    per_row = candidates.groupBy("row").agg(F.collect_list(F.struct("at", "h", "size")).alias("hits"))
    said = texts.join(per_row, "row").mapInArrow(spoken, "row long, at int, h long, size int, words binary")
    found = said.join(windows, ["h", "size", "words"])
    per_row = found.groupBy("row").agg(F.collect_set(F.struct("at", "size")).alias("hits"), F.array_distinct(F.flatten(F.collect_set("ids"))).alias("listed"))
    schema = T.StructType().add("kept", numbered.schema["kept"].dataType).add("found", _FOUND)
    out = numbered.join(per_row, "row", "left").select("kept", "hits", "listed").mapInArrow(verdicts, schema)
    return out.select(*[F.col("kept")[c].alias(c) for c in keep], F.col("found").alias(name))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest of scan(): doc_id, counts, a hash of the occurring item ids, and contaminated."""
    joined, hit = F.array_join("found.items", ","), F.col("found.n_hit")
    counts = [F.col("found.n_words"), hit, F.size("found.items").cast("long").alias("n_items")]
    return scan(docs, benchmark).select("doc_id", *counts, F.sha2(joined.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows in which a window of an item occurs; all columns and other rows stay."""
    (name,) = fresh(docs.columns, "found")
    return scan(docs, benchmark, docs.columns, name=name).where(F.col(name)["n_hit"] == 0).drop(name)


def remove_spans(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs with the hit runs of words cut out of text."""
    (name,) = fresh(docs.columns, "found")
    raw, spans = F.encode("text", "UTF-8"), F.col(name)["spans"]
    starts = F.concat(F.array(F.lit(0)), spans["end"])
    ends = F.concat(spans["start"], F.array(F.octet_length("text")))
    kept = F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda x: F.decode(F.substring(raw, x["s"] + 1, x["e"] - x["s"]), "UTF-8"))
    cut = F.when(F.size(spans) > 0, F.concat_ws("", kept)).otherwise(F.col("text"))
    return scan(docs, benchmark, docs.columns, name=name).withColumn("text", cut).drop(name)
