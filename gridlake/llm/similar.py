"""Near duplicates by exact Jaccard similarity of word-shingle sets, found by SimHash and Golay codes.

The fingerprint of a set is SimHash's, wider: SEGMENTS words of 23 bits, each bit
with the sum behind it. Bits near a tie are the ones that differ between similar
sets, so a segment is decoded softly: to the NEAR codewords of the binary Golay
code that agree best with its sums. Two segments make a table, whose keys are all
pairs of their codewords. At a similarity of 0.8 two sets share a codeword of a
segment with probability 0.734, so a key of any of the 16 tables with 1 - 4e-6
(more above 0.8). Rows with equal keys meet; 128 bits of the sets'
minima turn away pairs that are far from alike. All links are
verified on the two sets themselves; nothing links by a fingerprint alone.

A node is a distinct set, so copies cost nothing. What meets with near bits is joined
into groups by a spanning forest of each key, never by all its pairs: the first
tables join most of what is alike, the others give only edges between what is not
joined by then. A group holds all links of its nodes, and more than is alike; so
within it every two nodes with near bits that no links join yet are compared on
their sets. A set is sent to its group once, or once for each block of a large one.

Defined results: words are those of simhash (white space, A-Z lower-cased); a text
of fewer words than a shingle is one shingle; a null text is an empty one, and
empty sets are alike. Shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .run import cut, spread_join
from .simhash import codewords, components, shingle_hashes
from .text import blocks, mix, utf8

SHINGLE, SIMILARITY = 5, 0.8
SEGMENTS, NEAR = 32, 3
KEYS = SEGMENTS // 2 * NEAR * NEAR
#: One bit of each of 128 minima: sets of similarity 0.8 differ in 12.8, others in half of them; pairs that differ in
#: more than FAR, 5.5 deviations above, are not verified.
FAR = 31
#: Keys of up to SMALL nodes give all their pairs, up to KEY a spanning forest; larger ones join all their nodes.
SMALL, KEY = 8, 4096
#: Groups of more than SPLIT nodes are verified in pairs of blocks. A set is sent to as many tasks as there are blocks,
#: to COPIES at most as long as no block has more than MOST nodes or WEIGHT shingles.
SPLIT, COPIES, MOST, WEIGHT = 128, 24, 2048, 1 << 20
#: Tables that are joined first; the others then give only edges between what is not joined yet.
FIRST = 2
#: Up to FEW nodes are broadcast to choose their texts, of more the texts are shuffled; up to FEW edges (16 MB) are
#: joined on the driver, more by label propagation.
FEW = 1_000_000
#: Columns of the 128 bits.
BITS = ["b0", "b1"]
#: Words of 64 bits for the segments.
_WORDS = 12
_MORE = np.random.default_rng(21).integers(0, 1 << 63, _WORDS).astype(np.uint64)
_TURN, _BY = np.random.default_rng(22).integers(0, 1 << 63, (2, 128)).astype(np.uint64) * np.uint64(2) + np.uint64(1)
#: MinHash keys, of which no query makes use; tests measure by them.
BANDS, ROWS = 24, 4
_RNG = np.random.default_rng(20)
_FLIP, _TIMES = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS)).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[bytes], shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, one text after the other, and how many each has."""
    h, count = shingle_hashes(texts, shingle)
    doc = np.repeat(np.arange(len(texts)), count)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    own = np.ones(len(h), bool)
    own[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[own], np.bincount(doc[own], minlength=len(texts))


def nodes(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    out = np.zeros(len(size), np.uint64)
    some = np.flatnonzero(size)
    if len(some):
        out[some] = np.add.reduceat(mix(h), (np.cumsum(size) - size)[some])
    return mix(out + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def sums(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """SimHash's sums of each set: how many more ones than zeros its hashes have in each of 768 bits."""
    ones = np.zeros((len(size), _WORDS, 64), np.int32)
    some = np.flatnonzero(size)
    if len(some):
        # eight byte-wide counters in a word, summed over runs of 255 hashes at most
        runs = -(-size[some] // 255)
        begun = np.cumsum(runs) - runs
        before = (np.cumsum(size) - size)[some]
        starts = np.repeat(before, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(begun, runs))
        for i in range(_WORDS):
            x = mix(h ^ _MORE[i])
            for k in range(8):
                part = np.add.reduceat((x >> np.uint64(k)) & np.uint64(0x0101010101010101), starts).view(np.uint8).reshape(-1, 8)
                ones[some, i, k::8] = np.add.reduceat(part, begun, axis=0, dtype=np.int32)
    return (2 * ones - size[:, None, None]).reshape(len(size), -1)


@lru_cache(1)
def _code() -> np.ndarray:
    """The codewords as columns of 1 and -1."""
    return ((codewords()[None, :] >> np.arange(23)[:, None] & 1) * 2 - 1).astype(np.float32)


def fingerprints(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each set the NEAR codewords of each segment, and the 128 bits for FAR."""
    total = sums(h, size)
    word = total[:, : SEGMENTS * 23].reshape(-1, 23).astype(np.float32)
    near = np.zeros((len(word), NEAR), np.int16)
    for lo in range(0, len(word), 256):
        agree = word[lo : lo + 256] @ _code()
        row = np.arange(len(agree))
        for i in range(NEAR):
            best = agree.argmax(1)
            near[lo : lo + 256, i] = best
            agree[row, best] = -np.inf
    low = np.zeros((len(size), 128), np.uint8)
    some = np.flatnonzero(size)
    at = (np.cumsum(size) - size)[some]
    for i in range(128 if len(some) else 0):
        low[some, i] = np.minimum.reduceat((h ^ _TURN[i]) * _BY[i], at) >> np.uint64(32) & np.uint64(1)
    bits = np.packbits(low, axis=1).view(np.uint64)
    return near.reshape(len(size), SEGMENTS, NEAR), bits


def keys(near: np.ndarray) -> np.ndarray:
    """The KEYS keys of each set, by the codewords of its segments."""
    n = near.astype(np.uint64)
    both = n[:, ::2, :, None] << np.uint64(12) | n[:, 1::2, None, :]
    return mix(both | (np.arange(SEGMENTS // 2, dtype=np.uint64) << np.uint64(24))[:, None, None]).reshape(len(near), KEYS)


def band_keys(h: np.ndarray, size: np.ndarray) -> np.ndarray:
    """BANDS MinHash keys of each set, a second way to similar sets to compare with."""
    out = np.zeros((len(size), BANDS), np.uint64)
    some = np.flatnonzero(size)
    at = (np.cumsum(size) - size)[some]
    for i in range(BANDS * ROWS if len(some) else 0):
        least = np.minimum.reduceat((h ^ _FLIP[i]) * _TIMES[i], at)
        out[some, i // ROWS] = mix(out[some, i // ROWS] * np.uint64(0xD6E8FEB86659FD93) + least)
    return mix(out + np.arange(BANDS, dtype=np.uint64))


def _lists(flat: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)).astype(np.int32)), pa.array(flat.view(np.int64)))


def _signed(shingle: int):
    """id, fp, node, its number of shingles, codewords and bits of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch["text"])
            for lo, hi in blocks(texts):
                h, size = shingle_sets(texts[lo:hi], shingle)
                near, bits = fingerprints(h, size)
                part = batch.slice(lo, hi - lo)
                packed = pa.array([x.tobytes() for x in near], pa.binary())
                more = [pa.array(x) for x in bits.view(np.int64).T.copy()]
                own = [pa.array(nodes(h, size).view(np.int64)), pa.array(size.astype(np.int32))]
                yield pa.RecordBatch.from_arrays([part["id"], part["fp"], *own, packed, *more], ["id", "fp", "node", "size", "near", *BITS])

    return run


def _table_keys(batch: pa.RecordBatch, tables: range) -> np.ndarray:
    """The keys of each node in some of the tables."""
    near = np.frombuffer(b"".join(batch["near"].to_pylist()), np.int16).reshape(-1, SEGMENTS, NEAR)
    return keys(near).reshape(len(near), SEGMENTS // 2, -1)[:, tables.start : tables.stop].reshape(len(near), -1)


def _keyed(tables: range):
    """(k, root, b0, b1) of each key of each node in some of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                k = _table_keys(part, tables)
                rest = (np.repeat(part[c].to_numpy(zero_copy_only=False), k.shape[1]) for c in ("root", *BITS))
                yield pa.RecordBatch.from_arrays([pa.array(k.ravel().view(np.int64)), *map(pa.array, rest)], ["k", "root", *BITS])

    return run


def _often(tables: range, share: float):
    """Keys that more than `share` of the nodes of a batch have: a key that more than that of all nodes have is one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                k, n = np.unique(_table_keys(batch, tables), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(k[n > share * batch.num_rows - 1e-9].view(np.int64))], ["k"])

    return run


def _hot_keys(single: DataFrame, keyed: DataFrame, tables: range) -> DataFrame | None:
    """(k, least) of the keys that more than KEY and more than n / 120 of the n nodes have, if any: their smallest root.

    A node has KEYS keys at most, so there are fewer than 120 * KEYS of them.
    """
    n = single.count()
    most = max(KEY, n // 120)
    if n <= most:
        return None
    often = cut(single.select("near").mapInArrow(_often(tables, most / n), "k long").distinct())
    if often.isEmpty():
        return None
    counted = keyed.join(often, "k", "left_semi") if often.count() > FEW else keyed.join(F.broadcast(often), "k", "left_semi")
    hot = cut(counted.groupBy("k").agg(F.count("*").alias("m"), F.min("root").alias("least")).where(F.col("m") > most).select("k", "least"))
    return None if hot.isEmpty() else hot


def _apart(b0: np.ndarray, b1: np.ndarray, i: np.ndarray | slice, j: np.ndarray | int) -> np.ndarray:
    """In how many of the 128 bits i and j differ."""
    return np.bitwise_count((b0[i] ^ b0[j]).view(np.uint64)) + np.bitwise_count((b1[i] ^ b1[j]).view(np.uint64))


def _within(small: int, most: int):
    """On rows sorted by key: edges (u, v) between roots that join all that may be alike and has a key in common.

    Of a key of up to `small` rows these are all pairs, beyond that a spanning
    forest, and beyond `most` rows all of it is joined to its smallest root.
    """

    def complete(k: np.ndarray, root: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
        size = np.diff(np.append(start, len(k)))
        of = np.repeat(size, size)
        u, v = [root[:0]], [root[:0]]
        for d in range(1, min(small, int(size.max()))):
            i = np.flatnonzero((k[d:] == k[:-d]) & (of[d:] <= small) & (root[d:] != root[:-d]))
            i = i[_apart(b0, b1, i, i + d) <= FAR]
            u.append(root[i])
            v.append(root[i + d])
        for at, n in zip(start[size > small], size[size > small], strict=True):
            own = root[at : at + n]
            if (own == own[0]).all():
                continue
            if n > most:
                u.append(np.full(n, own.min()))
                v.append(own)
                continue
            left = np.arange(at, at + n)
            while len(left) > 1:
                queue, left = [left[0]], left[1:]
                while queue and len(left):
                    q = queue.pop()
                    near = _apart(b0, b1, left, q) <= FAR
                    found, left = left[near], left[~near]
                    u.append(np.full(len(found), root[q]))
                    v.append(root[found])
                    queue.extend(found)
        both = np.concatenate(u), np.concatenate(v)
        pairs = np.stack([np.minimum(*both), np.maximum(*both)], 1)
        pairs = np.unique(pairs[pairs[:, 0] < pairs[:, 1]], axis=0)
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[list[np.ndarray]] = []  # the last key so far, of which more may come
        for batch in batches:
            x = [batch[c].to_numpy(zero_copy_only=False) for c in ("k", "root", *BITS)]
            if not len(x[0]):
                continue
            if rest and rest[0][0][0] == x[0][-1]:
                rest.append(x)
                continue
            done = int(np.searchsorted(x[0], x[0][-1]))
            both = [np.concatenate(c) for c in zip(*rest, [c[:done] for c in x], strict=True)]
            if len(both[0]):
                yield from complete(*both)
            rest = [[c[done:] for c in x]]
        if rest:
            yield from complete(*(np.concatenate(c) for c in zip(*rest, strict=True)))

    return run


def _sets(shingle: int):
    """The texts' sets in place of the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch["text"])
            for lo, hi in blocks(texts):
                h, size = shingle_sets(texts[lo:hi], shingle)
                part = batch.slice(lo, hi - lo).drop_columns(["text"])
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(h, size)], [*part.schema.names, "s"])

    return run


def forest(node: np.ndarray, flat: np.ndarray, size: np.ndarray, bits: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links among some sets as all links would."""
    start = np.cumsum(size) - size
    left, u, v = np.arange(len(node)), [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            q = queue.pop()
            a = flat[start[q] : start[q] + size[q]]
            able = np.minimum(size[left], size[q]) >= similarity * np.maximum(size[left], size[q]) - 1e-9
            other = left[able & (_apart(*bits, left, q) <= FAR)]
            if not len(other):
                continue
            n = size[other]
            first = np.cumsum(n) - n
            place = np.repeat(start[other] - first, n) + np.arange(int(n.sum()))
            shared = np.zeros(len(other), np.int64)
            if len(a) and len(place):
                x = flat[place]
                at = np.minimum(np.searchsorted(a, x), len(a) - 1)
                shared = np.bincount(np.repeat(np.arange(len(other)), n), a[at] == x, minlength=len(other)).astype(np.int64)
            near = other[shared >= similarity * (n + size[q] - shared) - 1e-9]
            u.append(np.full(len(near), node[q]))
            v.append(node[near])
            queue.extend(near)
            left = np.setdiff1d(left, near, assume_unique=True)
    return (np.concatenate(u), np.concatenate(v)) if u else (node[:0], node[:0])


def _dealt(similarity: float):
    def run(group: pa.Table) -> pa.Table:
        s = group["s"].combine_chunks()
        flat, size = s.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.diff(s.offsets.to_numpy()).astype(np.int64)
        u, v = forest(group["node"].to_numpy(), flat, size, tuple(group[b].to_numpy() for b in BITS), similarity)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return run


def joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some edges, and of each the smallest that it is joined with."""
    node, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(node))
    while len(a):
        # the larger root of an edge falls to the smaller, then every node to its root's root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return node, node[root]


def _components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (u, v): on the driver for up to FEW edges, else by the executors."""
    if edges.count() > FEW:
        return components(edges)
    found = edges.select("u", "v").toArrow()
    node, root = joined(found["u"].to_numpy(), found["v"].to_numpy())
    return cut(edges.sparkSession.createDataFrame(pa.table({"node": node, "root": root}), "node long, root long"))


def _candidates(single: DataFrame, tables: range) -> DataFrame:
    """(u, v): edges between roots that join all nodes of a key of some tables that may be alike."""
    keyed, joined = single.mapInArrow(_keyed(tables), "k long, root long, b0 long, b1 long"), None
    hot = _hot_keys(single, keyed, tables)
    if hot is not None:
        joined = keyed.join(F.broadcast(hot), "k").where("least < root").select(F.col("least").alias("u"), F.col("root").alias("v"))
        keyed = keyed.join(F.broadcast(hot), "k", "left_anti")
    met = keyed.repartition("k").sortWithinPartitions("k").mapInArrow(_within(SMALL, KEY), "u long, v long")
    return cut((met if joined is None else met.union(joined)).distinct())


def _links(docs: DataFrame, single: DataFrame, groups: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """(u, v): links of nodes of equal root in groups (node, root), enough for the same components as all links.

    A group of more than SPLIT nodes is dealt in pairs of blocks, the others some hundred nodes at a time.
    """
    some = cut(single.drop("near", "root").join(groups, "node"))
    of = cut(some.groupBy("root").agg(F.count("*").alias("m"), F.sum("size").alias("w")))
    blocks_of = F.least(F.ceil(F.col("m") / SPLIT), F.greatest(F.lit(COPIES), F.ceil(F.col("m") / MOST)))
    blocks_of = F.greatest(blocks_of, F.ceil(F.col("w") / WEIGHT)).cast("int")
    large = of.withColumn("n", blocks_of).where("n > 1").select("root", "n")
    n, w = some.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    pools = max(1, -(-n // (2 * SPLIT)), -(-w // WEIGHT))
    some = some.join(F.broadcast(large), "root", "left")
    pool = F.when(F.col("n").isNull(), F.pmod(F.xxhash64("root"), F.lit(pools))).otherwise(F.col("root"))
    some = some.select("fp", "node", *BITS, pool.alias("g"), F.coalesce("n", F.lit(0)).alias("n"))
    some = F.broadcast(cut(some)) if n <= FEW else some
    texts = docs.select("fp", "text").join(some, "fp").dropDuplicates(["fp"]).drop("fp")
    sets = cut(texts.mapInArrow(_sets(shingle), "node long, b0 long, b1 long, g long, n int, s array<long>"))
    own = F.when(F.col("n") > 0, F.pmod(F.xxhash64("node"), F.col("n"))).otherwise(-1).cast("int")
    one = sets.withColumn("i", own).withColumn("j", F.explode(F.sequence(F.least(F.lit(0), "i"), F.greatest(F.lit(-1), F.col("n") - 1))))
    pairs = one.select("node", *BITS, "s", "g", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
    return cut(pairs.groupBy("g", "i", "j").applyInArrow(_dealt(similarity), "u long, v long").distinct())


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", similarity: float = SIMILARITY, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, root) of each row: fp a hash of its text, root the same for all rows joined by links of at least `similarity`."""
    if similarity < SIMILARITY:
        raise ValueError(f"the keys are made for a similarity of {SIMILARITY} or more")
    kind = df.schema[id].dataType.simpleString()
    docs = df.select(F.col(id).alias("id"), F.xxhash64(text).alias("fp"), F.col(text).alias("text"))
    rows = cut(docs.mapInArrow(_signed(shingle), f"id {kind}, fp long, node long, size int, near binary, " + ", ".join(f"{b} long" for b in BITS)))
    single = cut(rows.select("node", "fp", "size", "near", *BITS).dropDuplicates(["node"]))
    edges = _candidates(single.withColumn("root", F.col("node")), range(FIRST))
    joined = cut(single.join(_components(edges), "node", "left").withColumn("root", F.coalesce("root", "node")))
    edges = edges.union(_candidates(joined, range(FIRST, SEGMENTS // 2)))
    links = _links(docs, single, _components(edges), similarity, shingle)
    return spread_join(rows.select("id", "fp", "node"), _components(links), "node", "left").select("id", "fp", F.coalesce("root", "node").alias("root"))
