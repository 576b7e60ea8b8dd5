"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint is the bitwise majority of the XXH64 hashes of a text's word
shingles. Fingerprints that differ in few bits are found by keys: segments of 23
bits are decoded to the indices of nearby codewords of the binary Golay code.

Any 23-bit word lies within 3 bits of one codeword. Its indices here are that
codeword and, if it is 3 bits away, the five codewords 4 bits away. Two words
that differ in at most two bits share an index: if their nearest codeword c is
the same, both have it; otherwise one word is 3 bits from c and the other 4 or 5,
and the codewords of weight 7 around it supply a common one (tests try all
pairs of error patterns).

A fingerprint is segments A and B (23 bits each) and C (18 bits). With at most
4 differing bits a + b + c over them, one of these holds, so one key is equal:

* a, b, c <= 2: an index of A, an index of B and one of the three parts of C;
* c >= 3: then a = 0 or b = 0, the other at most 1: one exact, an index of the other;
* a >= 3: then b + c <= 1: B exact and one half of C, or C exact and an index of B;
* b >= 3: the same with A.

Rows with equal keys meet by one shuffle; true distances are then verified.
Inside a key no pairs are emitted beyond a spanning forest. Keys are counted
before their rows meet, and those of too many fingerprints are dealt in blocks
instead. Only distinct fingerprints are keyed, so copies cost nothing. Joins by
label or fingerprint set apart the keys that hold more than a thousandth of the
rows, so neither a large component nor a text with very many copies meets in one
task.

Defined results: a null or empty text has no words and fingerprint 0, which
links like any other; a text of fewer words than a shingle is one shingle;
repeated rows stay; rows with equal ids and different texts are separate nodes
whose component takes the smallest id; null ids are kept but name no component
unless no other id is in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .run import cut, spread_join
from .run import hot_keys as hot_keys_of
from .text import NOT_SPACE, Words, blocks, mix, utf8
from .xxh import xxh64

SHINGLE, BITS, SEED = 4, 4, 42
#: Runs of a key up to SMALL give all their pairs; longer ones a spanning forest; beyond SPLIT they are dealt again.
SMALL, SPLIT = 8, 8192
#: Generator polynomial of the binary Golay code (fixed value).
GENERATOR = 0xC75


def codewords() -> np.ndarray:
    """The 4,096 words of the code, by their index."""
    words = np.arange(1 << 12, dtype=np.int64) << 11
    return words | _syndrome(words)


@lru_cache(1)
def _golay() -> np.ndarray:
    """For each syndrome the patterns that lead from a word to its codewords, -1 after the last."""
    heavy = codewords()[np.bitwise_count(codewords()) == 7]
    table = np.full((2048, 6), -1, np.int64)
    bits = [1 << i for i in range(23)]
    for e in [0, *bits, *(a | b for i, a in enumerate(bits) for b in bits[:i])]:
        table[_syndrome(np.array([e]))[0], 0] = e
    for i in range(23):
        for j in range(i):
            for k in range(j):
                e = bits[i] | bits[j] | bits[k]
                table[_syndrome(np.array([e]))[0]] = [e, *(e ^ x for x in heavy[(heavy & e) == e])]
    return table


def _syndrome(x: np.ndarray) -> np.ndarray:
    x = x.copy()
    for i in range(22, 10, -1):
        x ^= np.where(x >> i & 1, GENERATOR << (i - 11), 0)
    return x


def indices(word: np.ndarray) -> np.ndarray:
    """Indices of the codewords near 23-bit words, 6 columns, -1 where there are fewer."""
    pattern = _golay()[_syndrome(word)]
    return np.where(pattern < 0, -1, (word[:, None] ^ pattern) >> 11)


def keys(fingerprint: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every key of some fingerprints; the keys are mixed to 64 bits one to one."""
    f = fingerprint.astype(np.uint64)
    a, b = ((f >> np.uint64(k) & np.uint64((1 << 23) - 1)).astype(np.int64) for k in (0, 23))
    c = (f >> np.uint64(46)).astype(np.int64)
    ga, gb = indices(a), indices(b)
    n, rows, out = len(f), [], []

    def add(kind: int, value: np.ndarray, ok: np.ndarray) -> None:
        at = np.nonzero(ok)
        rows.append(at[0])
        out.append(value[at].astype(np.uint64) << np.uint64(4) | np.uint64(kind))

    both, ok = ga[:, :, None] << 12 | gb[:, None, :], (ga[:, :, None] >= 0) & (gb[:, None, :] >= 0)
    for k in range(3):
        add(k, both << 6 | (c >> 6 * k & 63)[:, None, None], ok)
    add(3, a[:, None] << 12 | gb, gb >= 0)
    add(4, b[:, None] << 12 | ga, ga >= 0)
    add(5, c[:, None] << 12 | gb, gb >= 0)
    add(6, c[:, None] << 12 | ga, ga >= 0)
    every = np.ones(n, bool)
    for k in range(2):
        half = c >> 9 * k & 511
        add(7 + k, b << 9 | half, every)
        add(9 + k, a << 9 | half, every)
    return np.concatenate(rows), mix(np.concatenate(out))


def shingle_hashes(texts: list[bytes], shingle: int, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all word shingles, and how many each text has."""
    w = Words(texts, NOT_SPACE)
    buf, begin = w.spaced()
    shingles = np.where(w.count >= shingle, w.count - shingle + 1, np.minimum(w.count, 1))
    before = np.cumsum(shingles) - shingles
    first = np.repeat(w.at - before, shingles) + np.arange(int(shingles.sum()))
    last = first + np.minimum(shingle, np.repeat(w.count, shingles)) - 1
    return xxh64(buf, begin[first], begin[last] + w.length[last] - begin[first], seed), shingles


def fingerprint_texts(texts: list[bytes], shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """The 64-bit fingerprints of some texts."""
    h, shingles = shingle_hashes(texts, shingle, seed)
    before = np.cumsum(shingles) - shingles
    out = np.zeros(len(texts), np.uint64)
    if not len(h):
        return out
    # ones of each bit: eight byte-wide counters in a word, summed over runs of 255 hashes at most
    runs = -(-shingles // 255)
    begun = np.cumsum(runs) - runs
    starts = np.repeat(before, runs) + 255 * (np.arange(int(runs.sum())) - np.repeat(begun, runs))
    ones = np.stack([np.add.reduceat((h >> np.uint64(k)) & np.uint64(0x0101010101010101), starts) for k in range(8)], 1)
    ones = ones.view(np.uint8).reshape(-1, 8, 8).astype(np.int64)
    some = np.flatnonzero(runs)
    most = np.add.reduceat(ones, begun[some], axis=0) * 2 > shingles[some][:, None, None]
    place = np.uint64(1) << (np.arange(8, dtype=np.uint64)[:, None] + np.arange(0, 64, 8, dtype=np.uint64)[None, :])
    out[some] = (most * place).sum((1, 2), dtype=np.uint64)
    return out


def fingerprints(df: DataFrame, text: str = "text", id: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(id, fp): the fingerprint of each row's text as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = utf8(batch["text"])
            found = [fingerprint_texts(texts[lo:hi], shingle) for lo, hi in blocks(texts)]
            if found:
                yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.concatenate(found).view(np.int64))], ["id", "fp"])

    return df.select(F.col(id).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {df.schema[id].dataType.simpleString()}, fp long")


def _keyed(fps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fp = batch["fp"].to_numpy(zero_copy_only=False)
            for lo in range(0, len(all_fp), 512):
                fp = all_fp[lo : lo + 512]
                row, key = keys(fp.view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp[row])], ["k", "fp"])

    return fps.mapInArrow(run, "k long, fp long")


def forest(fp: np.ndarray, bits: int, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links within fp (or in fp and other together) as all links would."""
    left = fp if other is None else np.concatenate((fp, other))
    u, v = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue:
            q = queue.pop()
            near = np.bitwise_count(left ^ q) <= bits
            if near.any():
                found = left[near]
                u.append(np.full(len(found), q))
                v.append(found)
                queue.extend(found)
                left = left[~near]
    return (np.concatenate(u), np.concatenate(v)) if u else (fp[:0], fp[:0])


def _within(bits: int):
    """On rows sorted by key: links (m = 0), and the rows of keys that are too large (m: their number)."""

    def complete(k: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        start = np.flatnonzero(np.diff(k, prepend=k[0] - 1 if k[0] > np.iinfo(np.int64).min else 0)) if len(k) else np.zeros(0, int)
        size = np.diff(np.append(start, len(k)))
        run = np.repeat(size, size)
        u, v, m = [], [], []
        for d in range(1, SMALL):
            i = np.flatnonzero((k[d:] == k[:-d]) & (run[d:] <= SMALL))
            i = i[np.bitwise_count(fp[i] ^ fp[i + d]) <= bits]
            u.append(fp[i])
            v.append(fp[i + d])
            m.append(np.zeros(len(i), np.int64))
        for at, n in zip(start[size > SMALL], size[size > SMALL], strict=True):
            part = fp[at : at + n]
            a, b = forest(part, bits) if n <= SPLIT else (np.full(n, k[at]).view(np.uint64), part)
            u.append(a)
            v.append(b)
            m.append(np.full(len(a), 0 if n <= SPLIT else n))
        if sum(map(len, u)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u).view(np.int64)), pa.array(np.concatenate(v).view(np.int64)), pa.array(np.concatenate(m))], ["u", "v", "m"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[tuple[np.ndarray, np.ndarray]] = []  # the last key so far, of which more may come
        for batch in batches:
            k, fp = batch["k"].to_numpy(zero_copy_only=False), batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(k):
                continue
            if rest and rest[0][0][0] == k[-1]:
                rest.append((k, fp))
                continue
            done = int(np.searchsorted(k, k[-1]))
            both = [np.concatenate(x) for x in zip(*rest, (k[:done], fp[:done]), strict=True)]
            if len(both[0]):
                yield from complete(*both)
            rest = [(k[done:], fp[done:])]
        if rest:
            yield from complete(*(np.concatenate(x) for x in zip(*rest, strict=True)))

    return run


def _dealt(bits: int):
    """On the rows of pairs of blocks of one large key: links of two fingerprints in them."""

    def run(batches: Iterator[pa.Table]) -> pa.Table:
        fp = batches["fp"].to_numpy().view(np.uint64)
        u, v = forest(fp, bits)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return run


def hot_keys(keyed: DataFrame, n: int) -> DataFrame | None:
    """(k, m) of the keys of n fingerprints that more than SPLIT and more than n / 120 of them have, if any.

    A fingerprint has 136 keys at most, so there are fewer than 16,384 of them.
    Keys are counted by their last 20 bits first, so that what is counted stays
    small, and one by one only in those counts that are large enough.
    """
    most, part = max(SPLIT, n // 120), F.col("k").bitwiseAND((1 << 20) - 1)
    parts = cut(keyed.groupBy(part.alias("b")).count().where(F.col("count") > most).select("b"))
    if parts.isEmpty():
        return None
    near = keyed.withColumn("b", part).join(F.broadcast(parts), "b", "left_semi")
    return cut(near.groupBy("k").agg(F.count("*").alias("m")).where(F.col("m") > most))


def links(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """(u, v): links between the distinct fingerprints fp, enough for the same components as all links.

    The rows of hot keys never meet in one task: they are dealt in blocks where they are.
    """
    if bits > 4:
        raise ValueError("the keys hold up to 4 differing bits")
    keyed, dealt = _keyed(fps), None
    hot = hot_keys(keyed, fps.count())
    if hot is not None:
        dealt = keyed.join(F.broadcast(hot), "k")
        keyed = keyed.join(F.broadcast(hot), "k", "left_anti")
    met = cut(keyed.repartition("k").sortWithinPartitions("k").mapInArrow(_within(bits), "u long, v long, m long"))
    large = met.where("m > 0").selectExpr("u AS k", "v AS fp", "m")
    large = (large if dealt is None else large.unionByName(dealt)).withColumn("n", F.ceil(F.col("m") / (SPLIT // 2)).cast("int"))
    pairs = (
        large.withColumn("i", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
        .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        .select("k", "fp", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"))
        .groupBy("k", "i", "j")
        .applyInArrow(_dealt(bits), "u long, v long")
    )
    found = met.where("m = 0").select("u", "v")
    return found.union(pairs).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of the nodes of edges (u, v): root is the component's smallest node.

    Labels fall to the smallest among the neighbours and then to their label's
    label, until nothing changes; each round is written to the shared folder.
    Nodes of very many edges and labels of very many nodes are hot keys.
    """
    both = cut(edges.union(edges.select("v", "u")))
    hubs = hot_keys_of(both, "v")
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = spread_join(both, labels.withColumnRenamed("node", "v"), "v", hot=hubs).groupBy(F.col("u").alias("node")).agg(F.min("root").alias("near"))
        lower = cut(labels.join(near, "node").select("node", F.least("root", "near").alias("next"), F.col("root").alias("was")))
        up = labels.select(F.col("node").alias("next"), F.col("root").alias("over"))
        after = spread_join(lower, up, "next").select("node", F.least("next", "over").alias("root"), (F.least("next", "over") != F.col("was")).alias("moved"))
        after = cut(after)
        labels = after.select("node", "root")
        if after.where("moved").isEmpty():
            return labels


def near_duplicates(df: DataFrame, text: str = "text", id: str = "doc_id", bits: int = BITS, shingle: int = SHINGLE) -> DataFrame:
    """(id, fp, component_id) of each row: component_id is the smallest id reachable over links of at most `bits` bits."""
    docs = cut(fingerprints(df, text, id, shingle))
    fps = cut(docs.groupBy("fp").agg(F.min("id").alias("least")))
    roots = components(links(fps.select("fp"), bits))
    of_fp = cut(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root")))
    of_root = of_fp.groupBy("root").agg(F.min("least").alias("component_id"))
    named = cut(spread_join(of_fp, of_root, "root").select("fp", "component_id"))
    return spread_join(docs, named, "fp").select("id", "fp", "component_id")
