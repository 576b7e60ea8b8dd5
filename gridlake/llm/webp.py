"""Media columns of lossless WebP: pixels from files, and bytes kept in pictures.

`pixels` decodes any lossless WebP file (vp8l.py). `store` and `restore` keep
byte strings as grey pictures of 64 samples a row, one file for each strip of up
to STRIP bytes, so a very long text takes bounded memory and many strips are
worked on side by side. Of each strip's picture the writer tries what can make it
smaller: a palette where there are at most 16 samples, which bundles pixels; the
predictors from the left and from above where they lower the entropy; and always
back-references and prefix codes of what is left. Else the subtract-green
transform makes red and blue nothing. A colour cache and the cross-colour
transform say nothing new of grey pixels and are not written; the decoder has
them. Files are read back by the decoder of vp8l.py, whoever wrote them.

Defined results: null bytes or texts are empty ones; an empty payload has one
row of zeros; equal payloads have equal files; a file that is no lossless WebP
raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import vp8l
from .text import blocks, parts

WIDTH, STRIP = 64, 1 << 12
MOST = 11  # bits of the longest code
#: Bytes of texts that a worker decodes, and encodes, at once.
BLOCK, ENCODED = 2 << 20, 1 << 18
#: Least and greatest pixels of a back-reference, and the share of entropy that a predictor must save.
LEAST, LONGEST, SAVED = 5, 4096, 0.03


def code_lengths(counts: np.ndarray, most: int = MOST) -> np.ndarray:
    """Lengths of complete prefix codes for rows of symbol counts; at least two symbols have one.

    Each starts at the whole number of bits above its information, which leaves
    room; then codes are shortened, the most frequent symbols first, until the
    code is complete.
    """
    c = counts.astype(float).copy()
    c[:, :2] = np.maximum(c[:, :2], 1e-9)
    c = np.where(c > 0, np.maximum(c, c.sum(1, keepdims=True) / (1 << most - 1)), 0)
    with np.errstate(divide="ignore"):
        bits = np.where(c > 0, np.clip(np.ceil(np.log2(c.sum(1, keepdims=True) / c)), 1, most), 0).astype(np.int64)
    room = (1 << most) - np.where(bits > 0, 1 << (most - bits), 0).sum(1)
    order = np.argsort(-c, axis=1, kind="stable")
    used = (c > 0).sum(1)
    for i in np.flatnonzero(room).tolist():
        left, own = int(room[i]), order[i, : used[i]]
        row = bits[i, own].tolist()
        while left:
            for k, n in enumerate(row):
                if n > 1 and (gain := 1 << (most - n)) <= left:
                    row[k], left = n - 1, left - gain
                    if not left:
                        break
        bits[i, own] = row
    return bits


@lru_cache(2)
def _reverse(most: int) -> np.ndarray:
    return np.array([int(f"{i:0{most}b}"[::-1], 2) for i in range(1 << most)], np.uint64)


def codes(bits: np.ndarray, most: int = MOST) -> np.ndarray:
    """The canonical codes of rows of lengths, the first bit lowest."""
    order = np.argsort(np.where(bits > 0, bits, 99), axis=1, kind="stable")
    n = np.take_along_axis(bits, order, 1)
    span = np.where(n > 0, 1 << (most - n), 0)
    first = np.zeros_like(bits)
    np.put_along_axis(first, order, np.where(n > 0, np.cumsum(span, 1) - span, 0), 1)
    return _reverse(most)[first]


class Writer:
    """Bits, the first lowest, as one integer."""

    def __init__(self):
        self.value = self.size = 0

    def put(self, *pairs: int) -> Writer:
        """(value, bits) pairs, one after the other."""
        for v, n in zip(pairs[::2], pairs[1::2], strict=True):
            self.value |= v << self.size
            self.size += n
        return self

    def one(self, symbol: int) -> Writer:
        """A code of one symbol."""
        return self.put(1, 1, 0, 1, 1, 1, symbol, 8)

    def tokens(self, row: int, sections: list[Tokens]) -> Writer:
        """A row's tokens of all sections."""
        for of, value, taken in sections:
            for v, n in zip(value[of == row].tolist(), taken[of == row].tolist(), strict=True):
                self.put(v, n)
        return self


#: Row, value and number of bits of what is written, row by row.
Tokens = tuple[np.ndarray, np.ndarray, np.ndarray]
#: Bits of a code of one symbol without the symbol, which takes the next 8 of 11.
ONE = 5


def runs_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows of code lengths as row, symbol, extra and bits of extra; zeros in runs of up to 138."""
    flat, size = lengths.ravel(), lengths.shape[1]
    begin = flat > 0
    begin[1:] |= flat[:-1] > 0
    begin[::size] = True
    at = np.flatnonzero(begin)
    zero, n = flat[at] == 0, np.diff(at, append=len(flat))
    whole, rest = np.where(zero, n // 138, 0), np.where(zero, n % 138, 1)
    pieces = whole + np.where(rest < 3, rest, 1)
    run = np.repeat(np.arange(len(at)), pieces)
    n = np.where(np.arange(len(run)) - (np.cumsum(pieces) - pieces)[run] < whole[run], 138, rest[run])
    symbol = np.where(n < 3, flat[at][run], np.where(n <= 10, 17, 18))
    return at[run] // size, symbol, np.where(n < 3, 0, np.where(n <= 10, n - 3, n - 11)), np.where(n < 3, 0, np.where(n <= 10, 3, 7))


def _codes_of(lengths: np.ndarray) -> list[Tokens]:
    """What writes the codes of rows of lengths: the code of the lengths, then these."""
    of, symbol, extra, more = runs_of(lengths)
    bits = code_lengths(np.bincount(of * 19 + symbol, minlength=19 * len(lengths)).reshape(-1, 19), 7)
    head = 15 << 1 | (bits[:, vp8l.CODE_LENGTH_ORDER] << 5 + 3 * np.arange(19)).sum(1)
    n = bits[of, symbol]
    value = codes(bits, 7)[of, symbol] | (extra << n).astype(np.uint64)
    return [(np.arange(len(lengths)), head.astype(np.uint64), np.full(len(lengths), 63)), (of, value, n + more)]


def _palette(w: Writer, colours: np.ndarray) -> None:
    """The palette transform of some grey colours."""
    w.put(1, 1, 3, 2, len(colours) - 1, 8, 0, 1)
    steps = np.diff(colours.astype(np.int64), prepend=0) & 255
    counts = np.zeros((2, 280), np.int64)
    np.add.at(counts, (0, steps), 1)
    counts[1, [255, 0]] = 1, len(colours) - 1
    bits = code_lengths(counts)
    word = codes(bits).tolist()
    rest = _codes_of(bits[:, :256])
    w.tokens(0, _codes_of(bits[:1])).tokens(0, rest).tokens(0, rest).tokens(1, rest)
    w.one(0)
    for k, s in enumerate(steps.tolist()):
        a = 0 if k else 255
        w.put(*[word[0][s], int(bits[0, s])] * 3, word[1][a], int(bits[1, a]))


@lru_cache(8)
def _near(width: int) -> np.ndarray:
    """The code of each short distance in a picture of that width; 0 where it has none."""
    out = np.zeros(8 * width + 9, np.int64)
    for k in range(len(vp8l.NEAR), 0, -1):
        dx, dy = vp8l.NEAR[k - 1]
        if 0 < (d := dx + dy * width) < len(out):
            out[d] = k
    return out


def _prefix(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix, extra bits and how many of them, of lengths or distances from 1."""
    n = np.maximum(np.floor(np.log2(np.maximum(v - 1, 1))).astype(np.int64) - 1, 0)
    prefix = np.where(v <= 4, v - 1, 2 * n + 2 + ((v - 1 >> n) & 1))
    return prefix, (v - 1) & ((1 << n) - 1), n


def matches(data: np.ndarray, lane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place how many bytes equal those after the last place where its four bytes came in its lane, and the distance; 0 where none."""
    n = len(data)
    wide = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint64)
    key = wide[:n] | wide[1 : n + 1] << np.uint64(8) | wide[2 : n + 2] << np.uint64(16) | wide[3:] << np.uint64(24)
    whole = np.flatnonzero(lane[3:] == lane[: max(0, n - 3)])
    # four bytes and their place in one number
    order = np.sort(key[whole] << np.uint64(32) | whole.astype(np.uint64))
    same = (order[1:] ^ order[:-1]) < np.uint64(1 << 32)
    place = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
    same &= lane[place[1:]] == lane[place[:-1]]
    away = np.zeros(n, np.int64)
    away[place[1:][same]] = np.diff(place)[same]
    # places in a row with one distance are one match, four bytes beyond the last of them
    last = np.append(np.flatnonzero(np.diff(away)), n - 1)
    end = np.repeat(last, np.diff(last, prepend=-1))
    return np.where(away > 0, np.minimum(end - np.arange(n) + 4, LONGEST), 0), away


def _entropy(lane: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits that each lane's symbols take, and their counts."""
    counts = np.bincount(lane << 8 | data, minlength=256 * n).reshape(n, 256)
    total = counts.sum(1)
    return total * np.log2(np.maximum(total, 1)) - (counts * np.log2(np.maximum(counts, 1))).sum(1), counts


def _residuals(rows: np.ndarray, top: np.ndarray) -> list[np.ndarray]:
    """What is left of rows of pixels after the predictors from the left and from above; top: where pictures begin."""
    above = np.vstack((rows[:1], rows[:-1]))
    left = np.hstack((np.zeros((len(rows), 1), np.uint8), rows[:, :-1]))
    by_left, by_top = rows - left, rows - above
    by_left[~top, 0] = by_top[~top, 0]
    by_top[top] = rows[top] - left[top]
    return [by_left, by_top]


def encode(strips: list[bytes]) -> list[bytes]:
    """A WebP file of each strip, whose length is a positive multiple of WIDTH."""
    if not strips:
        return []
    n = len(strips)
    data = np.frombuffer(b"".join(strips), np.uint8)
    size = np.fromiter(map(len, strips), np.int64, n)
    lane = np.repeat(np.arange(n), size)
    plain, counts = _entropy(lane, data, n)
    begin = np.cumsum(size) - size
    top = np.zeros(len(data) // WIDTH, bool)
    top[begin // WIDTH] = True
    tried = [r.ravel() for r in _residuals(data.reshape(-1, WIDTH), top)]
    cost = np.stack([plain * (1 - SAVED), *(_entropy(lane, r, n)[0] for r in tried)])
    mode = cost.argmin(0)
    few = (counts > 0).sum(1) <= 16
    mode[few] = 3
    pixels = data.copy()
    for i in np.flatnonzero((mode == 1) | (mode == 2)):
        pixels[begin[i] : begin[i] + size[i]] = tried[mode[i] - 1][begin[i] : begin[i] + size[i]]
    writers, width = [Writer() for _ in strips], np.full(n, WIDTH)
    if few.any():
        parts_ = np.split(pixels, begin[1:])
        for i in np.flatnonzero(few):
            colours = np.flatnonzero(counts[i])
            per = 8 if len(colours) <= 2 else 4 if len(colours) <= 4 else 2
            index = np.searchsorted(colours, parts_[i]).reshape(-1, per)
            parts_[i] = (index << (8 // per * np.arange(per))).sum(1).astype(np.uint8)
            width[i] = WIDTH // per
        pixels = np.concatenate(parts_)
    for i, w in enumerate(writers):
        w.put(0x2F, 8, WIDTH - 1, 14, int(size[i]) // WIDTH - 1, 14, 0, 4)
        if mode[i] == 3:
            _palette(w, np.flatnonzero(counts[i]))
        else:
            if mode[i]:
                w.put(1, 1, 0, 2, 7, 3, 0, 1).one(int(mode[i])).one(0).one(0).one(0).one(0)
            w.put(1, 1, 2, 2)
        w.put(0, 1, 0, 1, 0, 1)  # no more transforms, no colour cache, one group of codes
    size = size * width // WIDTH
    lane = np.repeat(np.arange(n), size)
    # tokens: the match that begins where the last token ended, or a literal
    length, away = matches(pixels, lane)
    able = np.flatnonzero(length >= LEAST)
    before = np.cumsum(length >= LEAST)
    then, k, chosen = before[np.minimum(able + length[able], len(pixels)) - 1].tolist(), 0, []
    while k < len(then):
        chosen.append(k)
        k = then[k]
    chosen = able[np.array(chosen, np.int64)]
    edge = np.zeros(len(pixels) + 1, np.int8)
    edge[chosen + 1] += 1
    edge[chosen + length[chosen]] -= 1
    tokens = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8) == 0)
    take = np.ones(len(pixels), np.int64)
    take[chosen] = length[chosen]
    of, symbol = lane[tokens], pixels[tokens].astype(np.int64)
    copy = np.flatnonzero(take[tokens] > 1)
    prefix, extra, more = _prefix(take[tokens[copy]])
    symbol[copy] = 256 + prefix
    d, w_of, code = away[tokens[copy]], width[of[copy]], away[tokens[copy]] + 120
    for w in np.unique(w_of):
        table = _near(int(w))
        short = np.flatnonzero((w_of == w) & (d < len(table)))
        known = table[d[short]]
        code[short[known > 0]] = known[known > 0]
    far, far_extra, far_more = _prefix(code)
    bits = code_lengths(np.bincount(of * 280 + symbol, minlength=280 * n).reshape(n, 280))
    far_counts = np.bincount(of[copy] * 40 + far, minlength=40 * n).reshape(n, 40)
    copies = far_counts.any(1)
    far_bits = np.zeros((n, 40), np.int64)
    if copies.any():
        far_bits[copies] = code_lengths(far_counts[copies])
    alpha = np.where((mode == 1) | (mode == 2), 0, 255).astype(np.uint64) << np.uint64(25)
    sections = [*_codes_of(bits), (np.arange(n), alpha | np.uint64(ONE | ONE << 11 | ONE << 22), np.full(n, 33))]
    none, some = np.flatnonzero(~copies), np.flatnonzero(copies)
    sections.append((none, np.full(len(none), ONE, np.uint64), np.full(len(none), 11)))
    if len(some):
        sections += [(some[row], *rest) for row, *rest in _codes_of(far_bits[some])]
    value, taken = codes(bits)[of, symbol], bits[of, symbol]
    for v, k in ((extra, more), (codes(far_bits)[of[copy], far], far_bits[of[copy], far]), (far_extra, far_more)):
        value[copy] |= v.astype(np.uint64) << taken[copy].astype(np.uint64)
        taken[copy] += k
    return _files_of(writers, [*sections, (of, value, taken)])


def _scatter(words: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
    """Put values of less than 64 bits at rising places of bits."""
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    over = np.where(shift > 0, value >> (np.uint64(64) - np.maximum(shift, np.uint64(1))), np.uint64(0))
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] |= np.bitwise_or.reduceat(value << shift, first)
    words[word[first] + 1] |= np.bitwise_or.reduceat(over, first)


def _files_of(writers: list[Writer], sections: list[Tokens]) -> list[bytes]:
    """Files of what is written already and the tokens that follow, section by section."""
    head = np.array([w.size for w in writers])
    spans = [np.bincount(of, taken, minlength=len(writers)).astype(np.int64) for of, _, taken in sections]
    total = head + sum(spans)
    room = -(-total // 64) * 64
    begin = np.cumsum(room) - room
    words = np.zeros(int(room.sum()) // 64 + 2, np.uint64)
    at = begin + head
    for (of, value, taken), span in zip(sections, spans, strict=True):
        if len(of):
            _scatter(words, (at - np.cumsum(span) + span)[of] + np.cumsum(taken) - taken, value)
        at = at + span
    raw, out = words.view(np.uint8), []
    for w, at, m in zip(writers, (begin // 8).tolist(), total.tolist(), strict=True):
        n = -(-w.size // 8)
        raw[at : at + n] |= np.frombuffer(w.value.to_bytes(n, "little"), np.uint8)
        stream = raw[at : at + -(-m // 8)].tobytes()
        body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + bytes(len(stream) & 1)
        out.append(b"RIFF" + len(body).to_bytes(4, "little") + body)
    return out


def decode(files: list[bytes]) -> list[bytes]:
    """The samples of grey WebP files: the green of each pixel, row by row."""
    out = []
    for image in vp8l.decode_streams([vp8l.chunk(f) for f in files]):
        if (image[..., 1] != image[..., 2]).any() or (image[..., 3] != image[..., 2]).any():
            raise ValueError("not a grey image")
        out.append(image[..., 2].tobytes())
    return out


def _padded(data: bytes) -> bytes:
    return data + bytes(max(-len(data) % WIDTH, 0 if data else WIDTH))


def store(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """df with n_bytes of its texts and an array of WebP files that hold them, padded to rows of WIDTH bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in parts(batch[text], BLOCK):
                more = {"n_bytes": pa.array([len(t) for t in texts], pa.int64()), media: pa.array(_files(texts), pa.list_(pa.binary()))}
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *more.values()], [*batch.schema.names, *more])

    return df.mapInArrow(run, _added(df, **{"n_bytes": T.LongType(), media: T.ArrayType(T.BinaryType())}))


def _files(texts: list[bytes]) -> list[list[bytes]]:
    """The files of some texts, encoded a few at a time."""
    strips = [[p[k : k + STRIP] for k in range(0, len(p), STRIP)] for p in map(_padded, texts)]
    flat = [s for x in strips for s in x]
    each = (f for a, b in blocks(flat, ENCODED) for f in encode(flat[a:b]))
    return [[next(each) for _ in x] for x in strips]


def _payloads(files: list[list[bytes]]) -> list[bytes]:
    """The bytes that arrays of files hold."""
    samples = iter(decode([f for x in files for f in x]))
    return [b"".join(next(samples) for _ in x) for x in files]


def restore(df: DataFrame, media: str = "media", payload: str = "payload") -> DataFrame:
    """df with the bytes that its arrays of WebP files hold, and features of them.

    features: rows, mean and variance of the samples, distinct samples, and a
    64-bit mean hash of 8 x 8 fields of the picture.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [x or [] for x in batch[media].to_pylist()]
            for lo, hi in blocks([b"".join(x) for x in files], BLOCK):
                data = _payloads(files[lo:hi])
                more = {payload: pa.array(data, pa.binary()), "features": pa.array([features(d) for d in data], pa.string())}
                yield pa.RecordBatch.from_arrays([*batch.slice(lo, hi - lo).columns, *more.values()], [*batch.schema.names, *more])

    return df.mapInArrow(run, _added(df, **{payload: T.BinaryType(), "features": T.StringType()}))


_BYTES = np.arange(256)


def features(data: bytes) -> str:
    if not data:
        return ""
    x = np.frombuffer(data, np.uint8)
    n, rows = x.size, x.size // WIDTH
    # eight bands of rows, the first of them one longer where they don't come out even
    each = rows // 8 + (np.arange(8) < rows % 8) if rows >= 8 else np.array([rows])
    bands = np.add.reduceat(x.reshape(rows, WIDTH), each.cumsum() - each, dtype=np.int64).reshape(-1, 8, 8).sum(2)
    fields = (bands // each[:, None]).ravel()
    mark = int.from_bytes(np.packbits(fields * len(fields) > fields.sum()).tobytes(), "big")
    count = np.bincount(x, minlength=256)
    total, square = int(count @ _BYTES), int(count @ _BYTES**2)
    return f"{rows}:{total // n}:{(square * n - total * total) // (n * n)}:{np.count_nonzero(count)}:{mark:016x}"


def pixels(df: DataFrame, media: str = "media") -> DataFrame:
    """df with width, height and argb (a binary of four bytes a pixel) of any lossless WebP file; null files give nulls."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = batch[media].to_pylist()
            images = iter(vp8l.decode_streams([vp8l.chunk(f) for f in files if f is not None]))
            found = [None if f is None else next(images) for f in files]
            columns = [
                pa.array([None if x is None else x.shape[1] for x in found], pa.int32()),
                pa.array([None if x is None else x.shape[0] for x in found], pa.int32()),
                pa.array([None if x is None else x.tobytes() for x in found], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "argb"])

    return df.mapInArrow(run, _added(df, width=T.IntegerType(), height=T.IntegerType(), argb=T.BinaryType()))


#: Columns that digests() adds.
DIGESTS = {
    "n_bytes": T.LongType(), "payload_bytes": T.LongType(), "payload_sha256": T.StringType(), "tail_crc32": T.LongType(),
    "media_bytes": T.LongType(), "media_sha256": T.StringType(), "feature": T.StringType(),
}


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    """df without its texts, with sizes and digests of their payloads and files, and features of what is read back.

    Files are written, read back and hashed in one worker, so neither they nor payloads travel.
    """
    names = [c for c in df.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, texts in parts(batch[text], BLOCK):
                files = _files(texts)
                rows = []
                for t, f, data in zip(texts, files, _payloads(files), strict=True):
                    whole = hashlib.sha256()
                    for x in f:
                        whole.update(x)
                    rows.append((len(t), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), sum(map(len, f)), whole.hexdigest(), features(data)))
                own = batch.slice(lo, hi - lo)
                more = [pa.array(x, pa.int64() if isinstance(x[0], int) else pa.string()) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays([*(own[c] for c in names), *more], [*names, *DIGESTS])

    return df.mapInArrow(run, _added(df.drop(text), **DIGESTS))


def _added(df: DataFrame, **columns: T.DataType) -> T.StructType:
    if taken := set(columns) & set(df.columns):
        raise ValueError(f"column names taken: {sorted(taken)}")
    return T.StructType([*df.schema.fields, *(T.StructField(k, v) for k, v in columns.items())])
