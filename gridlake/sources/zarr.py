"""Chunked array stores (Zarr, version 2): scanned into cell frames and written from them.

A store is a folder with a folder for each array, which holds `.zarray` (shape,
chunks, type, compressor), `.zattrs` (names of its dimensions) and one file for
each chunk. Coordinates are arrays of one dimension with the dimension's name.

Chunks are read by Spark's file reader, so any file system will do, and each is
decoded to long rows where it was read. Only metadata and coordinates pass the
driver; a coordinate holds one value for each step of its dimension, and there
may be at most AXIS of them. Compressors: none, zlib, gzip, zstd.

Defined results: a chunk that has no file holds the fill value, and rows of
the fill value or NaN are left out; an array without dimensions' names, with
filters or with another compressor raises ValueError.
"""

from __future__ import annotations

import gzip
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXIS = 1 << 22
_UNITS = {"days": "D", "hours": "h", "minutes": "m", "seconds": "s"}


def _unpacked(data: bytes, kind: str | None) -> bytes:
    if kind is None:
        return data
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"no such compressor: {kind}")


def _packed(data: bytes, kind: str | None) -> bytes:
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor().compress(data)
    return {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress}[kind](data)


def _read(spark: SparkSession, path: str) -> bytes | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


class Array:
    """The metadata of one array."""

    def __init__(self, spark: SparkSession, store: str, name: str):
        self.path, self.name = f"{store}/{name}", name
        raw = _read(spark, f"{self.path}/.zarray")
        if raw is None:
            raise ValueError(f"no array {name} in {store}")
        meta, attributes = json.loads(raw), json.loads(_read(spark, f"{self.path}/.zattrs") or b"{}")
        self.shape, self.chunks, self.attributes = meta["shape"], meta["chunks"], attributes
        self.dtype, self.order, self.fill = np.dtype(meta["dtype"]), meta.get("order", "C"), meta.get("fill_value")
        self.kind, self.separator = (meta.get("compressor") or {}).get("id"), meta.get("dimension_separator", ".")
        self.dims = attributes.get("_ARRAY_DIMENSIONS")
        if meta.get("filters") or self.dims is None or len(self.dims) != len(self.shape) or self.kind not in (None, "zlib", "gzip", "zstd"):
            raise ValueError(f"{name}: arrays with filters, unnamed dimensions or other compressors can't be read")

    def decode(self, data: bytes) -> np.ndarray:
        return np.frombuffer(_unpacked(data, self.kind), self.dtype).reshape(self.chunks, order=self.order)


def axis(spark: SparkSession, store: str, name: str) -> np.ndarray:
    """A coordinate; times in CF units as datetime64."""
    a = Array(spark, store, name)
    if len(a.shape) != 1 or a.shape[0] > AXIS:
        raise ValueError(f"{name} is no coordinate of at most {AXIS} steps")
    out = np.full(-(-a.shape[0] // a.chunks[0]) * a.chunks[0], 0 if a.fill is None else a.fill, a.dtype)
    for i in range(len(out) // a.chunks[0]):
        data = _read(spark, f"{a.path}/{i}")
        if data is not None:
            out[i * a.chunks[0] : (i + 1) * a.chunks[0]] = a.decode(data)
    out = out[: a.shape[0]]
    unit, _, since = a.attributes.get("units", "").partition(" since ")
    if since and unit in _UNITS:
        start = np.datetime64(pd.Timestamp(since), "us")
        out = start + (out.astype(float) * pd.Timedelta(1, _UNITS[unit]).total_seconds() * 1e6).round().astype("timedelta64[us]")
    return out


def scan(spark: SparkSession, store: str, name: str, value: str | None = None) -> DataFrame:
    """(a column for each dimension, value): the long rows of one array."""
    a, value = Array(spark, store, name), value or name
    axes = {d: axis(spark, store, d) if _read(spark, f"{store}/{d}/.zarray") else np.arange(n) for d, n in zip(a.dims, a.shape, strict=True)}
    kinds = {d: "timestamp_ntz" if x.dtype.kind == "M" else "double" if x.dtype.kind == "f" else "string" if x.dtype.kind in "US" else "long" for d, x in axes.items()}
    sent = spark.sparkContext.broadcast((a, axes))
    fill = None if a.fill in (None, "NaN") else a.fill

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, axes = sent.value
        for batch in batches:
            for path, data in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                chunk = a.decode(data)
                where = path.rsplit(f"/{a.name}/", 1)[1]
                first = [int(i) * c for i, c in zip(where.split(a.separator), a.chunks, strict=True)]
                chunk = chunk[tuple(slice(0, n - f) for n, f in zip(a.shape, first, strict=True))]
                keep = ~np.isnan(chunk) if chunk.dtype.kind == "f" else np.ones(chunk.shape, bool)
                if fill is not None:
                    keep &= chunk != fill
                at = np.nonzero(keep)
                columns = [axes[d][f + i] for d, f, i in zip(a.dims, first, at, strict=True)]
                yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(str) if c.dtype.kind == "U" else c) for c in columns), pa.array(chunk[at].astype(float))], [*a.dims, value])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*").load(a.path)
    schema = ", ".join([*(f"`{d}` {k}" for d, k in kinds.items()), f"`{value}` double"])
    return files.select("path", "content").mapInArrow(run, schema)


def write(df: DataFrame, store: str, name: str, dims: list[str], value: str, chunks: list[int], compressor: str | None = "zstd") -> None:
    """An array of a cell frame, with its coordinates; cells that df lacks hold NaN.

    Each chunk is gathered, packed and written by one task; store must be a path
    that all machines see as a folder. Times become microseconds since 1970. Two
    rows of one place raise ValueError.
    """
    import os

    if len(dims) != len(chunks):
        raise ValueError("a chunk size for each dimension")
    axes, types = {}, dict(df.dtypes)
    for d in dims:
        n = df.select(d).distinct().count()
        if not 0 < n <= AXIS:
            raise ValueError(f"{d} has {n} steps; 1 to {AXIS} can be written")
        axes[d] = np.sort(np.array([r[0] for r in df.select(d).where(F.col(d).isNotNull()).distinct().collect()], "datetime64[us]" if types[d].startswith("timestamp") else None))
    shape, sizes = [len(axes[d]) for d in dims], list(chunks)

    def put(path: str, data: bytes) -> None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(data)

    def meta(at: str, shape: list[int], chunks: list[int], dtype: str, fill, attributes: dict) -> None:
        packer = {"id": compressor} if compressor else None
        put(f"{at}/.zarray", json.dumps({"zarr_format": 2, "shape": shape, "chunks": chunks, "dtype": dtype, "order": "C", "fill_value": fill, "compressor": packer, "filters": None}).encode())
        put(f"{at}/.zattrs", json.dumps(attributes).encode())

    put(f"{store}/.zgroup", b'{"zarr_format": 2}')
    for d, x in axes.items():
        time = x.dtype.kind == "M"
        x = (x - np.datetime64(0, "us")).astype("timedelta64[us]").astype("<i8").astype("<f8") / 1e6 if time else x.astype("<f8") if x.dtype.kind == "f" else x if x.dtype.kind == "U" else x.astype("<i8")
        meta(f"{store}/{d}", [len(x)], [len(x)], x.dtype.str, None, {"_ARRAY_DIMENSIONS": [d]} | ({"units": "seconds since 1970-01-01"} if time else {}))
        put(f"{store}/{d}/0", _packed(x.tobytes(), compressor))
    meta(f"{store}/{name}", shape, sizes, "<f8", "NaN", {"_ARRAY_DIMENSIONS": dims})
    sent = df.sparkSession.sparkContext.broadcast(axes)

    def places(columns: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in columns:
            at = [np.searchsorted(sent.value[d], pdf[d].to_numpy(sent.value[d].dtype)) for d in dims]
            yield pd.DataFrame({"chunk": [".".join(map(str, k)) for k in zip(*(i // c for i, c in zip(at, sizes, strict=True)), strict=True)], "place": np.ravel_multi_index([i % c for i, c in zip(at, sizes, strict=True)], sizes), "v": pdf[value].to_numpy(float)})

    def chunk(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["place"].duplicated().any():
            raise ValueError("two rows of one place")
        out = np.full(int(np.prod(sizes)), np.nan)
        out[pdf["place"].to_numpy()] = pdf["v"].to_numpy()
        put(f"{store}/{name}/{pdf['chunk'].iloc[0]}", _packed(out.astype("<f8").tobytes(), compressor))
        return pd.DataFrame({"n": [len(pdf)]})

    whole = df.where(" AND ".join(f"`{d}` IS NOT NULL" for d in dims)).select(*dims, F.col(value).cast("double").alias(value))
    whole.mapInPandas(places, "chunk string, place long, v double").groupBy("chunk").applyInPandas(chunk, "n long").agg(F.sum("n")).collect()
