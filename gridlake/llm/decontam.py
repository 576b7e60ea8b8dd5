"""Benchmark decontamination with an FM-index for each training shard.

A shard is a block of documents of a task. Its words are numbered by their
place in the benchmark's vocabulary; runs of such words that are shorter than
the shortest test phrase cannot hold one and stay out of the index. The others,
separated, are indexed; all test phrases are searched backward at once, their
occurrences located by sampled suffix positions, and overlapping ones merged.
Words are found by 64-bit hashes; each occurrence is then compared by its bytes.

A test phrase is `window` consecutive words of an item; an item of fewer words,
but not none, is one phrase. Words are runs of ASCII letters, digits and of
characters beyond ASCII, A-Z lower-cased.

The benchmark is sent to the executors in parts of at most PART_BYTES of text;
with several parts the documents pass through as many indexes, in one stage.

Defined results: a null or empty text has no words and no hits; null or empty
items are never hit; words of an item without an id are hit, but it is not
reported; items with equal texts are all reported; repeated
documents are each reported; an empty benchmark hits nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .fmindex import FMIndex
from .text import ALNUM, Words, parts

WINDOW = 10
PART_BYTES = 8 << 20
SHARD_BYTES = 4 << 20


class Phrases:
    """The test phrases of some items: distinct rows of word numbers, and the items of each."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int):
        words = Words([(x or "").encode() for _, x in items], ALNUM)
        distinct, self.seed = len({words.word(i) for i in range(len(words.length))}), 0
        while True:
            self.vocabulary, first, number = np.unique(words.hashes(self.seed), return_index=True, return_inverse=True)
            if len(first) == distinct:
                break
            self.seed += 1  # two words have the same hash
        self.words = [words.word(i) for i in first]
        rows: dict[tuple[int, ...], set[int]] = {}
        for (item, _), at, n in zip(items, words.at, words.count, strict=True):
            own = (number[at : at + n] + 1).tolist()
            for i in range(max(1, n - window + 1) if n else 0):
                named = rows.setdefault(tuple(own[i : i + window]), set())
                if item is not None:
                    named.add(item)
        self.items = [sorted(x) for x in rows.values()]
        self.length = np.array([len(x) for x in rows], np.int64)
        self.rows = np.zeros((len(rows), window), np.int32)
        for i, x in enumerate(rows):
            self.rows[i, : len(x)] = x
        self.least = int(self.length.min(initial=window))


def occurrences(words: Words, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
    """(first word, phrase) of each occurrence of a phrase in the words of a shard."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(phrases.rows) or not len(words.length):
        return none
    hashes = words.hashes(phrases.seed)
    place = np.searchsorted(phrases.vocabulary, hashes)
    place[place == len(phrases.vocabulary)] = 0
    number = np.where(phrases.vocabulary[place] == hashes, place + 1, 0)
    known = number > 0
    # runs of known words within a document
    edge = np.flatnonzero(np.diff(words.doc, prepend=-1) | (np.diff(known, prepend=~known[:1])))
    size = np.diff(np.append(edge, len(known)))
    kept = known[edge] & (size >= phrases.least)
    begin, size = edge[kept], size[kept]
    if not len(begin):
        return none
    # the runs with one separator after each; separators are the symbol above all words
    where = np.repeat(begin - (np.cumsum(size + 1) - size - 1), size + 1) + np.arange(int((size + 1).sum()))
    ends = np.cumsum(size + 1) - 1
    where[ends] = begin
    text = number[where]
    text[ends] = len(phrases.vocabulary) + 1
    index = FMIndex(text)
    lo, hi = index.search(phrases.rows, phrases.length)
    count = hi - lo
    phrase = np.repeat(np.arange(len(count)), count)
    rows = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    first = where[index.locate(rows)]
    # by bytes, once for each word that an occurrence covers
    inside = covered(first, phrases.length[phrase], len(known))
    wrong = np.zeros(len(known) + 1, np.int64)
    for i in np.flatnonzero(inside):
        wrong[i + 1] = words.word(i) != phrases.words[number[i] - 1]
    wrong = np.cumsum(wrong)
    right = wrong[first + phrases.length[phrase]] == wrong[first]
    return first[right], phrase[right]


def covered(first: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n words lie inside an occurrence."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, first, 1)
    np.add.at(change, first + length, -1)
    return np.cumsum(change[:n]) > 0


def _scan(phrases_sent, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = phrases_sent.value
        for batch in batches:
            for lo, hi, texts in parts(batch[text], SHARD_BYTES):
                part = batch.slice(lo, hi - lo)
                earlier, items_before = part[names[1]].to_pylist(), part[names[2]].to_pylist()
                words = Words(texts, ALNUM)
                first, phrase = occurrences(words, phrases)
                inside = covered(first, phrases.length[phrase], len(words.length))
                items: dict[int, set[int]] = {}
                for d, p in zip(words.doc[first].tolist(), phrase.tolist(), strict=True):
                    items.setdefault(d, set()).update(phrases.items[p])
                spans, found = [], []
                for d in range(hi - lo):
                    at, n = words.at[d], words.count[d]
                    hit = inside[at : at + n].copy() if d in items else None
                    for a, b in ((x["first"], x["last"]) for x in earlier[d]):
                        hit = np.zeros(n, bool) if hit is None else hit
                        hit[a : b + 1] = True
                    if hit is None:
                        spans.append([])
                    else:
                        edge = np.flatnonzero(np.diff(hit, prepend=False, append=False)).reshape(-1, 2).tolist()
                        raw = texts[d]
                        begin = words.begin[at : at + n]
                        spans.append([{"first": a, "last": b - 1, "start": len(raw[: begin[a]].decode()), "end": len(raw[: begin[b - 1] + words.length[at + b - 1]].decode())} for a, b in edge])
                    found.append(sorted({*items_before[d], *items.get(d, ())}))
                columns = {k: part[k] for k in part.schema.names}
                columns |= {names[0]: pa.array(words.count, pa.int64()), names[1]: pa.array(spans, _SPANS), names[2]: pa.array(found, pa.list_(batch.schema.field(names[2]).type.value_type))}
                yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])

    return run


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def find(df: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, prefix: str = "hit_") -> DataFrame:
    """df with <prefix>words (its number of words), <prefix>spans and <prefix>items.

    spans: merged ranges of hit words, as word numbers first-last and code points
    start-end; items: the ids of the items found, sorted. Names must be new.
    """
    names = [prefix + x for x in ("words", "spans", "items")]
    if taken := set(names) & set(df.columns):
        raise ValueError(f"column names taken: {sorted(taken)}")
    kind = benchmark.schema[item].dataType
    df = df.select("*", F.lit(0).cast("long").alias(names[0]), F.array().cast("array<struct<first:long,last:long,start:long,end:long>>").alias(names[1]), F.array().cast(T.ArrayType(kind)).alias(names[2]))

    def benchmark_parts() -> Iterator[list]:
        rows, size = [], 0
        for row in benchmark.select(item, item_text).where(F.col(item_text).isNotNull()).toLocalIterator():
            rows.append((row[0], row[1]))
            size += len(row[1])
            if size > PART_BYTES:
                yield rows
                rows, size = [], 0
        yield rows

    for part in benchmark_parts():
        sent = df.sparkSession.sparkContext.broadcast(Phrases(part, window))
        df = df.mapInArrow(_scan(sent, text, names), df.schema)
    return df


def remove(df: DataFrame, text: str = "text", prefix: str = "hit_") -> DataFrame:
    """df of find() with the hit ranges cut out of its texts; its added columns stay."""
    t, spans = F.col(text), F.col(prefix + "spans")
    starts = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda s: s["end"]))
    ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(t).cast("long")))
    kept = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda p: t.substr((p["a"] + 1).cast("int"), (p["b"] - p["a"]).cast("int")))
    return df.withColumn(text, F.when(F.size(spans) > 0, F.array_join(kept, "")).otherwise(t))
