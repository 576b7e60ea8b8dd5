"""Language identification with hyperdimensional profiles.

Each letter has a random bipolar vector. The vector of three letters in a row is
the product of theirs, the first permuted twice and the second once. A text's
vector is the sum over its n-grams, a language's prototype the sum over all its
training texts, and a text gets the language whose prototype has the largest
cosine with it. Letters are lower-cased; everything else is one word boundary,
which has a vector as well.

Defined results: a null text or one without a letter is `und` with score 0, and
so is every text if nothing was learned. Ties go to the language that sorts
first. Scores are cosines, those below 0 being 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import blocks

DIMENSIONS, SEED = 1024, 20240229
SYMBOLS = 128
BLOCK_CHARS = 1 << 20


@lru_cache(1)
def symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter, 1-26 for a-z, the rest hashed."""
    code = np.arange(0x110000, dtype=np.uint64)
    table = (27 + (code * np.uint64(2654435761) >> np.uint64(12)) % np.uint64(SYMBOLS - 27)).astype(np.uint8)
    table[97:123] = np.arange(1, 27)
    letter = np.fromiter((not 0xD800 <= i < 0xE000 and chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
    table[~letter] = 0
    return table


@lru_cache(2)
def letters(dimensions: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each n-gram of some texts, the number of its text and its code."""
    low = [x.lower() + " " for x in texts]
    size = np.fromiter(map(len, low), np.int64, len(low))
    sym = symbols()[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)]
    doc = np.repeat(np.arange(len(low), dtype=np.int32), size)
    keep = sym > 0
    keep[1:] |= (sym[:-1] > 0) & (doc[1:] == doc[:-1])
    sym, doc = sym[keep], doc[keep]
    # one boundary before each text
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    sym, doc = np.insert(sym, first, 0), np.insert(doc, first, doc[first])
    a, b, c = (sym[k : len(sym) - 2 + k].astype(np.int32) for k in range(3))
    same = (doc[2:] == doc[:-2]) & ((a > 0) | (b > 0)) & ((b > 0) | (c > 0))
    return doc[2:][same], ((a << 14) | (b << 7) | c)[same]


def vectors(codes: np.ndarray, dimensions: int, seed: int) -> np.ndarray:
    """The vectors of n-grams."""
    v = letters(dimensions, seed)
    return np.roll(v, 2, 1)[codes >> 14] * np.roll(v, 1, 1)[(codes >> 7) & 127] * v[codes & 127]


def bundle(texts: list[str], groups: np.ndarray, n: int, dimensions: int, seed: int) -> np.ndarray:
    """The sums of the n-gram vectors of each of n groups of texts."""
    doc, code = grams(texts)
    key, count = np.unique(groups[doc].astype(np.int64) << 21 | code, return_counts=True)
    seen, at = np.unique(key & 0x1FFFFF, return_inverse=True)
    out = np.zeros((n, dimensions), np.float32)
    group = key >> 21
    for lo in range(0, len(seen), 4096):
        on = (at >= lo) & (at < lo + 4096)
        counts = np.zeros((n, min(4096, len(seen) - lo)), np.float32)
        counts[group[on], at[on] - lo] = count[on]
        out += counts @ vectors(seen[lo : lo + 4096], dimensions, seed).astype(np.float32)
    return out


def train(df: DataFrame, text: str = "text", lang: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, list[float]]:
    """A prototype of unit length for each language of df; rows without text or language are no examples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            texts, langs = batch[text].to_pylist(), batch[lang].to_pylist()
            for lo, hi in blocks(texts, BLOCK_CHARS):
                names = sorted(set(langs[lo:hi]))
                groups = np.array([names.index(x) for x in langs[lo:hi]])
                for name, x in zip(names, bundle(texts[lo:hi], groups, len(names), dimensions, seed), strict=True):
                    total[name] = total.get(name, 0) + x.astype(np.float64)
        for name, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([x.tolist()])], ["lang", "sums"])

    known = df.select(text, lang).where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    sums = known.mapInArrow(run, "lang string, sums array<double>").select("lang", F.posexplode("sums").alias("at", "x"))
    found: dict[str, np.ndarray] = {}
    for row in sums.groupBy("lang", "at").agg(F.sum("x").alias("x")).collect():
        found.setdefault(row.lang, np.zeros(dimensions))[row["at"]] = row.x
    return {k: (x / (np.linalg.norm(x) or 1)).tolist() for k, x in sorted(found.items())}


def predict(df: DataFrame, prototypes: dict[str, list[float]], text: str = "text", seed: int = SEED, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """df with the language of each text and the cosine; both columns must be new."""
    if taken := {pred, score} & set(df.columns):
        raise ValueError(f"column names taken: {sorted(taken)}")
    names = list(prototypes)
    matrix = np.array([prototypes[k] for k in names], np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        has = symbols() > 0
        for batch in batches:
            texts = [x or "" for x in batch[text].to_pylist()]
            for lo, hi in blocks(texts, BLOCK_CHARS):
                part = texts[lo:hi]
                lettered = np.array([bool(x) and bool(has[np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32)].any()) for x in part])
                if names:
                    v = bundle(part, np.arange(len(part)), len(part), matrix.shape[1], seed)
                    cosine = (v @ matrix.T) / np.maximum(np.linalg.norm(v, axis=1), 1e-12)[:, None]
                    best = cosine.argmax(1)
                    value = np.where(lettered, np.clip(cosine[np.arange(len(part)), best], 0, 1), 0).astype(np.float64)
                    label = [names[b] if x else "und" for b, x in zip(best, lettered, strict=True)]
                else:
                    value, label = np.zeros(len(part)), ["und"] * len(part)
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, pa.array(label, pa.string()), pa.array(value)], [*batch.schema.names, pred, score])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())]))
