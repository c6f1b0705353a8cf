"""Near-duplicate documents: MinHash signatures under a multi-index Hamming join.

A text's set holds its distinct shingles of SHINGLE consecutive words (words stand between white
space, A-Z lowered); a text of fewer words is one shingle.
A signature keeps ``SYMBOLS`` MinHash values of 16 bits. It is cut into chunks of ``WIDTH``
symbols. By the pigeonhole principle two signatures that differ in at most
``(ERRORS + 1) * chunks - 1`` symbols (19 here) agree on all but ERRORS symbols of some chunk, so each
chunk is indexed once for every way to leave ERRORS symbols out: signatures up to that
distance always share a key. A pair with more differing symbols is found if any chunk has at most ERRORS of
them, and compared on full sets up to DISTANCE (26), beyond which a pair at 0.8 is one in millions. A pair at
Jaccard 0.8 differs in a fifth of its symbols and misses all chunks with a probability of 0.263 ** 10, about
2e-6. Candidates are confirmed on full sets.

Groups are never expanded into pairs. Texts with equal sets are one node, and each key links its
members to its smallest one, its hub. Pairs whose signatures differ in more than DISTANCE of the
symbols are left out, the others compared on full sets, and
the components of these links found. What is left are members of a key outside the component of its
hub. All keys with hubs in one component form a family; each such member is compared with every
member of its family, in blocks, so in the end each two nodes that share a key were compared or are
connected. Of several links from a node into one component a block keeps one. A block holds some
BLOCK shingles of each side, however long the texts, so a set is sent to as many blocks as its family's sets fill.

Null and empty texts, and texts without words, have an empty set and are linked with nothing; a text of any
length is one set. Rows that repeat a doc_id with other texts are each a document that shares the id; rows
that repeat id and text are equal. Rows with a null doc_id are kept and linked with nothing. The smallest
doc_id decides between documents that are alike. Columns of any name stay in drop_near_duplicates(); an empty
table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm.textkit import NOT_SPACE, Words, column, free, fresh, mix64, pieces, settle, window_hashes

SYMBOLS, WIDTH, ERRORS = 50, 5, 1
#: Words to a shingle, and the least similarity in percent.
SHINGLE, PERCENT = 5, 80
#: Largest number of differing symbols of a pair that is compared on full sets.
DISTANCE = 26
#: Shingles, and sets, of a side of a block: the members of a family outside its component, and its members of any kind.
BLOCK, BLOCK_SETS = 1 << 18, 4096
#: Shingle matches, and pairs, that are counted at once.
MATCHES = 1 << 21


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its shingles; of fewer words, all of them are one."""
    for _, texts in pieces(column, lower=True):
        words = Words(texts, NOT_SPACE)
        h, b = words.hashes(), words.bounds
        whole = window_hashes(h, width)
        for i in range(len(texts)):
            n = int(b[i + 1] - b[i])
            yield np.unique(whole[b[i] : b[i + 1] - width + 1]) if n >= width else window_hashes(h[b[i] : b[i + 1]], n) if n else h[:0]


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240607)
    a = rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:, None], rng.integers(1, 1 << 63, SYMBOLS, dtype=np.uint64)[:, None]


def signature(shingles: np.ndarray, coefficients: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """SYMBOLS values of 16 bits: low bits of the mixed minima of as many hash functions."""
    a, c = coefficients
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 16384):
        np.minimum(least, (a * shingles[None, i : i + 16384] + c).min(axis=1), out=least)
    return (mix64(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _features(width: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        co = _coefficients()
        for batch in batches:
            n, fp, sig = [], [], []
            for s in shingle_sets(batch.column("text"), width):
                n.append(len(s))
                fp.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sig.append(signature(s, co).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("version"), pa.array(n, pa.int64()), pa.array(fp, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "version", "n_shingles", "fp", "sig"])

    return rows


def _sets(width: int):
    """node and shingles of rows (node, text)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), width))
            offsets = np.cumsum([0] + [len(s) for s in sets]).astype(np.int32)
            values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(offsets, values)], ["node", "shingles"])

    return rows


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """Rows of SYMBOLS 16-bit symbols to rows of 64-bit index keys, one for each chunk and choice of left-out symbols."""
    wide, keys = signatures.astype(np.uint64), []
    for c in range(SYMBOLS // WIDTH):
        for k, kept in enumerate(combinations(range(WIDTH), WIDTH - ERRORS)):
            key = np.zeros(len(wide), dtype=np.uint64)
            for j in kept:
                key = (key << np.uint64(16)) | wide[:, c * WIDTH + j]
            keys.append(mix64(key ^ mix64(np.array([c * 1000 + k + 1], dtype=np.uint64))))
    return np.stack(keys, axis=1)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS)
            keys = chunk_keys(sig)
            node = np.repeat(batch.column("node").to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64).ravel()), pa.array(node)], ["key", "node"])


def versioned(docs: DataFrame) -> DataFrame:
    """doc_id, text and version, a hash of the text that tells rows of one doc_id apart."""
    text = F.col("text").cast("string")
    return docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("version"))


def features(docs: DataFrame, width: int = SHINGLE) -> DataFrame:
    """doc_id, version, n_shingles, fp (128-bit hash of the set; null if empty), sig."""
    schema = T.StructType().add("doc_id", docs.schema["doc_id"].dataType).add("version", "long").add("n_shingles", "long").add("fp", "binary").add("sig", "binary")
    return versioned(docs).mapInArrow(_features(width), schema)


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of links (a, b) but the smallest of each component: the smallest node that each can reach.

    Alternating star contraction: every node links its larger neighbours, then its smaller
    ones, to its smallest neighbour, until nothing changes; the number of rounds grows with
    the logarithm of the longest path.
    """
    edges = settle(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        after = settle(small.where("u <> v").distinct())
        # A star forest: every node has one smaller neighbour, and those have none.
        if after.groupBy("u").count().where("count > 1").isEmpty() and after.join(after.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            free(edges)
            return after.select(F.col("u").alias("node"), F.col("v").alias("component"))
        free(edges)
        edges = after


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures differ in at most DISTANCE symbols."""
    for batch in batches:
        one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype=np.uint16).reshape(-1, SYMBOLS) for c in ("sa", "sb"))
        near = pa.array((one != two).sum(axis=1) <= DISTANCE)
        yield batch.select(["a", "b"]).filter(near)


class Block:
    """The sets of a block's apart members, as an index from shingles to members."""

    def __init__(self, nodes: list[int], comps: list[int], sets: list[np.ndarray], percent: int):
        self.nodes, self.comps = np.array(nodes), np.array(comps)
        self.sizes, self.percent = np.array([len(x) for x in sets]), percent
        every = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(every, kind="stable")
        self.owner = owner[order]
        self.known, self.first, self.count = np.unique(every[order], return_index=True, return_counts=True)
        self.done: set[tuple[int, int]] = set()

    def links(self, nodes: np.ndarray, comps: np.ndarray, values: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int]]:
        """(apart member, member) for similar pairs of different components; one for each apart member and component."""
        owner = np.repeat(np.arange(len(nodes)), sizes)
        at = np.minimum(np.searchsorted(self.known, values), len(self.known) - 1)
        hit = np.flatnonzero(self.known[at] == values)
        at, owner = at[hit], owner[hit]
        out, width = [], len(self.nodes)
        ends = np.cumsum(np.bincount(owner, weights=self.count[at], minlength=len(nodes)))
        start = 0
        while start < len(nodes):
            stop = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + MATCHES, side="right"))
            stop = max(start + 1, min(stop, start + MATCHES // width))
            part = slice(*np.searchsorted(owner, [start, stop]))
            n = self.count[at[part]]
            skip = np.repeat(self.first[at[part]] - (np.cumsum(n) - n), n)
            cell = np.repeat((owner[part] - start) * width, n) + self.owner[skip + np.arange(len(skip))]
            both = np.bincount(cell, minlength=(stop - start) * width).reshape(-1, width)
            union = sizes[start:stop, None] + self.sizes[None, :] - both
            alike = (both > 0) & (100 * both >= self.percent * union) & (comps[start:stop, None] != self.comps[None, :])
            for i, k in zip(*np.nonzero(alike), strict=True):
                pair = (int(k), int(comps[start + i]))
                if pair not in self.done:
                    self.done.add(pair)
                    out.append((int(self.nodes[k]), int(nodes[start + i])))
            start = stop
        return out


def _compare(percent: int):
    """Streams rows ordered by (block, side): a block's apart members (side 0), then the members they are compared with (side 1)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held, block = None, ([], [], []), None
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("family", "ab", "mb", "side")], axis=1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
                if a == b:
                    continue
                part, key = batch.slice(a, b - a), tuple(keys[a, :3].tolist())
                if key != current:
                    current, held, block = key, ([], [], []), None
                nodes, comps, sets = part.column("node").to_numpy(), part.column("comp").to_numpy(), part.column("shingles")
                values, sizes = sets.flatten().to_numpy(), sets.value_lengths().to_numpy().astype(np.int64)
                if keys[a, 3] == 0:
                    held[0].extend(nodes.tolist())
                    held[1].extend(comps.tolist())
                    held[2].extend(x.copy() for x in np.split(values, np.cumsum(sizes)[:-1]))
                    continue
                block = block or Block(*held, percent)
                found = block.links(nodes, comps, values, sizes)
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

    return rows


def family_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b): similar pairs of an apart member and a member of another component of the same family.

    members is (family, node, n_shingles, comp, apart). Families of any size are cut into blocks.
    """
    n, apart = F.col("n_shingles"), F.col("apart")
    blocks = lambda shingles, sets: F.greatest(F.ceil(shingles / BLOCK), F.ceil(sets / BLOCK_SETS)).cast("int")
    count = members.groupBy("family").agg(blocks(F.sum(n), F.count("*")).alias("mbs"), blocks(F.sum(F.when(apart, n).otherwise(0)), F.count_if(apart)).alias("abs"))
    sized = members.join(settle(count), "family")
    lot = F.xxhash64("node")
    ab, mb = F.pmod(lot, F.col("abs")).cast("int"), F.pmod(lot, F.col("mbs")).cast("int")
    one = sized.where(apart).select("family", ab.alias("ab"), F.explode(F.sequence(F.lit(0), F.col("mbs") - 1)).alias("mb"), F.lit(0).alias("side"), "node", "comp")
    two = sized.select("family", F.explode(F.sequence(F.lit(0), F.col("abs") - 1)).alias("ab"), mb.alias("mb"), F.lit(1).alias("side"), "node", "comp")
    block = ["family", "ab", "mb"]
    dealt = one.union(two).join(sets, "node").select(*block, "side", "node", "comp", "shingles")
    return dealt.repartition(*block).sortWithinPartitions(*block, "side").mapInArrow(_compare(percent), "a long, b long")


def classes(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """doc_id, version (hash of the text), n_shingles, component_id, kept for every row of docs."""
    feats = settle(features(docs, width))
    of_fp = feats.where("fp is not null and doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "version")).alias("at"), F.first("sig").alias("sig"), F.first("n_shingles").alias("n_shingles"))
    # A node is a set, numbered when it is written; a row with the smallest doc_id that has it gives its text.
    nodes = settle(of_fp.select("fp", "at.doc_id", "at.version", "sig", "n_shingles", F.monotonically_increasing_id().alias("node")))
    keys = settle(_shared(nodes.select("node", "sig").mapInArrow(_keys, "key long, node long")))
    pairs = keys.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    signed = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a").join(nodes.select(F.col("node").alias("b"), F.col("sig").alias("sb")), "b")
    pairs = settle(signed.select("a", "b", "sa", "sb").mapInArrow(_close, "a long, b long").distinct())
    several = keys.where("members > 2").select("node")
    used = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).union(several).distinct()
    used = nodes.select("node", "doc_id", "version").join(used, "node")
    texts = versioned(docs).join(used, ["doc_id", "version"]).select("node", "text")
    if not feats.groupBy("doc_id", "version").count().where("count > 1").isEmpty():  # rows repeat id and text: one is enough
        texts = texts.dropDuplicates(["node"])
    sets = settle(texts.mapInArrow(_sets(width), "node long, shingles array<long>"))
    size = nodes.select("node", "n_shingles")
    hubs = pairs.select(F.col("a").alias("family"), F.col("a").alias("node")).distinct().withColumn("apart", F.lit(True))
    others = pairs.select(F.col("a").alias("family"), F.col("b").alias("node"), F.lit(False).alias("apart"))
    links = settle(family_links(hubs.union(others).withColumn("comp", F.col("node")).join(size, "node"), sets, percent))
    comps = components(links)
    hub_comp = comps.select(F.col("node").alias("hub"), F.col("component").alias("family"))
    member = keys.where("members > 2").select("hub", "node").distinct().join(comps, "node", "left").join(hub_comp, "hub", "left")
    member = member.select(F.coalesce("family", "hub").alias("family"), "node", F.coalesce("component", "node").alias("comp")).distinct()
    member = settle(member.join(size, "node").withColumn("apart", F.col("family") != F.col("comp")))
    mixed = settle(member.where("apart").select("family").distinct())
    if not mixed.isEmpty():  # without a family of several components the sets need not move again
        more = settle(family_links(member.join(mixed, "family", "left_semi"), sets, percent))
        if not more.isEmpty():
            comps = components(links.union(more))
        free(more)
    free(keys, pairs, sets, links, member, mixed)
    whole = comps.union(comps.select("component", "component").distinct())
    linked = nodes.select("node", "doc_id").join(whole, "node")
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = linked.join(least, "component").select("node", "component_id")
    of_set = nodes.select("fp", "node", "doc_id").join(of_node, "node", "left").select("fp", F.coalesce("component_id", "doc_id").alias("component_id"))
    out = feats.select("doc_id", "version", "n_shingles", "fp").join(of_set, "fp", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    out = out.select("doc_id", "version", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    docs has doc_id and text; other columns are not read.
    """
    return classes(docs, percent, width).drop("version")


def _shared(keys: DataFrame) -> DataFrame:
    """key, node, hub, members for the keys of more than one node; hub is a key's smallest node."""
    # Written first: a join of two plain tables is one whose large keys Spark can split.
    groups = settle(keys.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").alias("members")).where("members > 1"))
    return keys.join(groups, "key")


def drop_near_duplicates(docs: DataFrame, percent: int = PERCENT, width: int = SHINGLE) -> DataFrame:
    """docs without the rows that do not have the smallest doc_id of their component; all columns stay.

    Of rows that repeat both id and text, and have words and an id, one stays. Which of them is open, as their other columns may differ.
    """
    decided = classes(docs, percent, width).where("doc_id is not null and (n_shingles > 0 or not kept)")
    each = decided.groupBy("doc_id", "version").agg(F.first("kept").alias("kept"), F.count("*").alias("n")).where("n > 1 or not kept")
    i, v, kept = fresh(docs.columns, "of_id", "of_version", "kept")
    each = settle(each.select(F.col("doc_id").alias(i), F.col("version").alias(v), F.col("kept").alias(kept)))
    match = (F.col("doc_id") == F.col(i)) & (F.xxhash64(F.col("text").cast("string")) == F.col(v))
    rest, several = docs.join(each, match, "left_anti"), each.where(F.col(kept))
    if several.isEmpty():  # no row repeats: no second look at the texts
        return rest
    return rest.unionByName(docs.join(several, match).dropDuplicates([i, v]).select(*[column(c) for c in docs.columns]))
