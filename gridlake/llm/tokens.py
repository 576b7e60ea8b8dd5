"""Byte-level BPE: encode texts to ids and decode ids to bytes with tiktoken.

The rank file is local to every executor and its path is a parameter. A text
over LONG characters is cut at safe places first: between a visible ASCII
character and a blank or line feed. Every alternative of the pattern has white
space at its beginning only, so a match always ends there and the ids of the
parts, joined, are the ids of the whole.

Defined results: a null text is an empty one; an empty text has no ids; equal
texts have equal ids; other columns are kept as they are. All three functions
raise ValueError if a name they would add is taken.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .text import parts

LONG, PIECE = 65536, 32768
#: Bytes of texts whose ids are sent back at once.
SENT = 1 << 18
_SAFE = re.compile(r"(?<=[!-~])(?=[ \n])")


@lru_cache(4)
def encoding(rank_file: str, pattern: str):
    """The encoding of a rank file, once for each worker process."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def safe_parts(text: str, piece: int = PIECE) -> Iterator[str]:
    """text in parts of about `piece` characters whose ids join to its ids."""
    at = 0
    while len(text) - at > piece:
        m = _SAFE.search(text, at + piece)
        if not m:
            break
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def parts_of(enc, text: str, long: int = LONG, piece: int = PIECE) -> Iterator[tuple[str, np.ndarray]]:
    """The parts of one text and the ids of each, special tokens being ordinary text."""
    for part in [text] if len(text) <= long else safe_parts(text, piece):
        yield part, enc.encode_to_numpy(part, disallowed_special=())


def ids_of(enc, text: str, long: int = LONG, piece: int = PIECE) -> np.ndarray:
    """The ids of one text."""
    return np.concatenate([ids for _, ids in parts_of(enc, text, long, piece)])


def _added(df: DataFrame, **columns: T.DataType) -> T.StructType:
    if taken := set(columns) & set(df.columns):
        raise ValueError(f"column names taken: {sorted(taken)}")
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in columns.items())])


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids", round_trip: str | None = None) -> DataFrame:
    """df and a column of the ids of its texts; with a name for `round_trip` also whether they decode to the text's bytes.

    The decoded bytes are compared in the worker, a part of a text at a time, so they never travel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            for lo, hi, texts in parts(batch[text], SENT):
                got, same = [], []
                for t in texts:
                    of_parts, equal = [np.zeros(0, np.uint32)], True
                    for part, x in parts_of(enc, t.decode()):
                        of_parts.append(x)
                        equal = equal and (not round_trip or enc.decode_bytes(x.tolist()) == part.encode())
                    got.append(np.concatenate(of_parts).astype(np.int32))
                    same.append(equal)
                ends = np.cumsum([0, *map(len, got)]).astype(np.int32)
                more = {ids: pa.ListArray.from_arrays(ends, pa.array(np.concatenate(got)))}
                if round_trip:
                    more[round_trip] = pa.array(same, pa.bool_())
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *more.values()], [*batch.schema.names, *more])

    more = {ids: T.ArrayType(T.IntegerType())} | ({round_trip: T.BooleanType()} if round_trip else {})
    return df.mapInArrow(run, _added(df, **more))


def digests(df: DataFrame, rank_file: str, pattern: str, text: str = "text") -> DataFrame:
    """df without its texts, with n_tokens, the digest of the ids as decimals joined by commas, and that of the bytes they decode to.

    Texts are encoded, decoded and hashed a part at a time, so a worker holds one part of one text's ids.
    """
    kept = df.drop(text)
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            count, of_ids, of_bytes = [], [], []
            for _, _, texts in parts(batch[text]):
                for t in texts:
                    n, a, b = 0, hashlib.sha256(), hashlib.sha256()
                    for _, x in parts_of(enc, t.decode()):
                        found = x.tolist()
                        a.update((("," if n and found else "") + ",".join(map(str, found))).encode())
                        b.update(enc.decode_bytes(found))
                        n += len(found)
                    count.append(n)
                    of_ids.append(a.hexdigest())
                    of_bytes.append(b.hexdigest())
            more = [pa.array(count, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in names), *more], [*names, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, _added(kept, n_tokens=T.LongType(), ids_sha256=T.StringType(), decoded_sha256=T.StringType()))


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df and a binary column of the raw bytes of its ids; null ids are none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            got = [enc.decode_bytes(x or []) for x in batch[ids].to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, decoded])

    return df.mapInArrow(run, _added(df, **{decoded: T.BinaryType()}))
