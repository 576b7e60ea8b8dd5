"""Lossless WebP: the writer's files by both decoders, hand-built streams, and every transform against the format's text."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridlake.llm import vp8l, webp

SF = "/root/testdata/sf0.001"


class Put:
    """A bit writer, to build streams the batch encoder never makes."""

    def __init__(self):
        self.bits = []

    def put(self, v, n):
        self.bits += [v >> k & 1 for k in range(n)]

    def one(self, s):
        self.put(1, 1), self.put(0, 1), self.put(1, 1), self.put(s, 8)

    def two(self, a, b):
        self.put(1, 1), self.put(1, 1), self.put(1, 1), self.put(a, 8), self.put(b, 8)

    def head(self, w, h):
        self.put(0x2F, 8), self.put(w - 1, 14), self.put(h - 1, 14), self.put(0, 4)

    def image(self, green, red, blue, alpha, main=False, pixels=()):
        """Channels of one symbol, or of two and then a bit for each pixel."""
        self.put(0, 1)
        if main:
            self.put(0, 1)
        for c in (green, red, blue, alpha):
            self.two(*c) if isinstance(c, tuple) else self.one(c)
        self.one(0)
        for p in pixels:
            self.put(p, 1)

    def data(self):
        return np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()


def test_webp_palette_predictor_and_cross_colour():
    w = Put()
    w.head(4, 2)
    w.put(1, 1), w.put(3, 2), w.put(1, 8)  # a palette of two colours: 8 pixels in one
    w.image((10, 20), 0, 0, 255, pixels=[0, 1])  # 10, then 10 + 20
    w.put(0, 1)
    w.image((5, 6), 0, 0, 255, main=True, pixels=[0, 1])
    assert vp8l.decode_stream(w.data())[..., 2].tolist() == [[30, 10, 30, 10], [10, 30, 30, 10]]
    w = Put()
    w.head(3, 3)
    w.put(1, 1), w.put(0, 2), w.put(0, 3), w.image(2, 0, 0, 255)  # predict from above
    w.put(0, 1)
    w.image((1, 2), 3, 0, 0, main=True, pixels=[0] * 9)
    got = vp8l.decode_stream(w.data())
    assert got[..., 2].tolist() == [[1, 2, 3], [2, 3, 4], [3, 4, 5]] and got[..., 0].min() == 255
    w = Put()
    w.head(2, 1)
    w.put(1, 1), w.put(1, 2), w.put(0, 3), w.image(32, 0, 64, 255)  # green to blue 32, green to red 64
    w.put(0, 1)
    w.image((7, 200), 1, 2, 255, main=True, pixels=[0, 1])
    assert vp8l.decode_stream(w.data())[0].tolist() == [[255, 15, 7, 9], [255, (1 - 112) & 255, 200, (2 - 56) & 255]]


def test_webp_back_reference_and_cache():
    w = Put()
    w.head(8, 1)
    w.put(0, 1)
    w.put(1, 1), w.put(1, 4)  # a colour cache of two
    w.put(0, 1)
    # green: literal 9, length prefix 259 (4 pixels), and both places of the cache, two bits each
    w.put(0, 1), w.put(15, 4)
    for s in vp8l.CODE_LENGTH_ORDER:
        w.put({0: 2, 2: 2, 17: 2, 18: 2}.get(s, 0), 3)
    w.put(0, 1)
    code = {0: "00", 2: "01", 17: "10", 18: "11"}
    lengths = [0] * 282
    for s in (9, 259, 280, 281):
        lengths[s] = 2
    for v in lengths:
        for b in code[v]:
            w.put(int(b), 1)
    w.one(1), w.one(1), w.one(255), w.one(1)
    for bits in ("00", "01"):
        for b in bits:
            w.put(int(b), 1)
    place = (0xFF010901 * vp8l.MULTIPLIER & 0xFFFFFFFF) >> 31
    for _ in range(3):
        for b in ("10", "11")[place]:
            w.put(int(b), 1)
    assert vp8l.decode_stream(w.data()).tolist() == [[[255, 1, 9, 1]] * 8]


def padded(raw):
    return raw + bytes(max(-len(raw) % 64, 0 if raw else 64))


RNG = np.random.default_rng(1)
STRIPS = {
    "zeros": (bytes(64), {3}),
    "noise": (RNG.integers(0, 256, 640, np.uint8).tobytes(), {2}),
    "words": (b"the quick brown fox jumps over the lazy dog; " * 64, {2}),
    "ramp": (bytes(range(64)) * 10, {0, 2}),
    "walk": (np.cumsum(RNG.integers(-2, 3, 16384)).astype(np.uint8).tobytes(), {0, 2}),
    "columns": (np.tile(RNG.integers(0, 256, 64), (40, 1)).cumsum(0).astype(np.uint8).tobytes(), {0, 2}),
    "run": (b"x" * 16384, {3}),
    "two": (RNG.integers(48, 50, 6400, np.uint8).tobytes(), {3}),
    "four": (RNG.integers(48, 52, 6400, np.uint8).tobytes(), {3}),
    "ten": (RNG.integers(48, 58, 6400, np.uint8).tobytes(), {3}),
}


def test_writer_and_both_decoders():
    for group in ([s for s, _ in STRIPS.values()], *([s] for s, _ in STRIPS.values())):
        files = webp.encode(group)
        assert webp.decode(files) == group
        assert [vp8l.decode_stream(vp8l.chunk(f))[..., 2].tobytes() for f in files] == group
    kinds = [{t[0] for t in vp8l.Stream(vp8l.chunk(f)).transforms} for f in webp.encode([s for s, _ in STRIPS.values()])]
    assert kinds[:2] == [{3}, {2}] and [k for k, (_, want) in zip(kinds, STRIPS.values(), strict=True) if k != want] == []
    assert len(webp.encode([STRIPS["words"][0]])[0]) < 300  # by back-references


def test_damaged_files():
    file = webp.encode([STRIPS["words"][0]])[0]
    for n in range(30, len(file), 7):
        with pytest.raises(ValueError):
            webp.decode([file[:n]])
    with pytest.raises(ValueError):
        webp.decode([b"no file"])


EDGES = [(1, None), (2, ""), (3, "a"), (3, "a"), (None, "one two three"), (5, "x" * 70_000 + "".join(map(chr, range(1, 50_000, 7)))), (6, "\x00\x01 \U0001f600" * 20)]


def test_round_trip(spark):
    df = spark.createDataFrame(EDGES, "doc_id long, text string").withColumn("extra", F.lit(1))
    back = webp.restore(webp.store(df)).collect()
    assert sorted((r.doc_id or 0, bytes(r.payload)) for r in back) == sorted((k or 0, padded((t or "").encode())) for k, t in EDGES)
    assert webp.digests(df.limit(0)).isEmpty() and webp.digests(df).columns[:3] == ["doc_id", "extra", "n_bytes"]
    with pytest.raises(ValueError):
        webp.store(df.withColumn("media", F.lit(1)))
    with pytest.raises(ValueError):
        webp.digests(df.withColumn("feature", F.lit(1)))


def test_query_columns_by_brute_force(spark):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op8_webp"](spark, SF).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    sizes, digests = {}, {}
    for r in rows:
        raw = texts[r.doc_id]
        p = padded(raw)
        files = [webp.encode([p[k : k + webp.STRIP]])[0] for k in range(0, len(p), webp.STRIP)]  # alone, not beside others
        shown = b"".join(vp8l.decode_stream(vp8l.chunk(f))[..., 2].tobytes() for f in files)
        stored = b"".join(files)
        assert shown == p and r.feature == webp.features(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def predicted(res, mode):
    """Pixel by pixel, by the format's text."""
    h, w, _ = res.shape
    out = np.zeros((h, w, 4), int)
    average = lambda a, b: (a + b) // 2
    for y in range(h):
        for x in range(w):
            left, top = out[y, x - 1], out[y - 1, x]
            tl, tr = out[y - 1, x - 1], out[y - 1, x + 1] if x + 1 < w else out[y, 0]
            if x == y == 0:
                p = np.array([255, 0, 0, 0])
            elif y == 0 or x == 0:
                p = left if y == 0 else top
            elif mode == 11:
                est = left + top - tl
                p = left if abs(est - left).sum() < abs(est - top).sum() else top
            elif mode == 13:
                a = average(left, top)
                p = np.clip(a + np.trunc((a - tl) / 2).astype(int), 0, 255)
            else:
                p = [
                    np.array([255, 0, 0, 0]), left, top, tr, tl, average(average(left, tr), top), average(left, tl), average(left, top), average(tl, top), average(top, tr),
                    average(average(left, tl), average(top, tr)), None, np.clip(left + top - tl, 0, 255), None,
                ][mode]
            out[y, x] = (res[y, x] + p) % 256
    return out


@pytest.mark.parametrize("mode", range(14))
def test_every_predictor(mode):
    res = np.random.default_rng(mode).integers(0, 256, (6, 9, 4))
    assert (vp8l.unpredict(res, np.full((2, 3), mode), 2) == predicted(res, mode)).all()


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 200])
def test_palette_widths(n):
    rng = np.random.default_rng(n)
    colours, want = rng.integers(0, 256, (n, 4)), rng.integers(0, n, (3, 21))
    per = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
    wide = np.pad(want, ((0, 0), (0, -21 % per))).reshape(3, -1, per)
    image = np.zeros((3, wide.shape[1], 4), int)
    image[..., 2] = (wide << (8 // per * np.arange(per))).sum(-1)
    assert (vp8l.unpalette(image, colours, 21) == colours[want]).all()


def test_groups_of_codes():
    w = Put()
    w.head(8, 1)
    w.put(0, 1)  # no transform
    w.put(0, 1), w.put(1, 1), w.put(0, 3)  # no cache; groups of codes for blocks of 4 x 4
    w.image((0, 1), 0, 0, 255, pixels=[0, 1])  # the second block has group 1
    for g in ((3, 4), (5, 6)):
        w.two(*g), w.one(0), w.one(0), w.one(255), w.one(0)
    for p in (0, 1, 0, 1, 1, 1, 0, 0):
        w.put(p, 1)
    for got in (vp8l.decode_stream(w.data()), vp8l.decode_streams([w.data()] * 2)[1]):
        assert got[0, :, 2].tolist() == [3, 4, 3, 4, 6, 6, 5, 5]


def test_colours_side_by_side():
    """Literals of four channels with codes of their own, in lanes and one at a time."""
    w = Put()
    w.head(3, 2)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    w.two(1, 2), w.two(3, 4), w.two(5, 6), w.two(7, 8), w.one(0)
    bits = np.random.default_rng(3).integers(0, 2, (6, 4))
    for p in bits.ravel():
        w.put(int(p), 1)
    want = np.stack((7 + bits[:, 3], 3 + bits[:, 1], 1 + bits[:, 0], 5 + bits[:, 2]), 1).reshape(2, 3, 4)
    assert (vp8l.decode_stream(w.data()) == want).all() and (vp8l.decode_streams([w.data()])[0] == want).all()


def test_two_literals_in_one_step():
    """Literals that fit one look-up together are read in one step, in lanes that end after the first of two as well."""
    single, most = vp8l.tables([vp8l.Prefix(bytes([2, 2, 1]) + bytes(277)), vp8l.Prefix(bytes(9) + b"\1" + bytes(250) + b"\1" + bytes(19))])
    found = vp8l.entries_of(single, most, True)
    for k, e in enumerate(found.tolist()):
        lane, bits = divmod(k, 1 << most)
        n, s = int(single[k]) & 15, int(single[k]) >> 4
        then = int(single[(lane << most) + (bits >> n)])
        two = s < 256 and then >> 4 < 256 and n + (then & 15) <= most
        assert (e >> vp8l._TWO & 1, e >> vp8l._SYMBOL & 511, e >= vp8l._COPY) == (two, s, s >= 256)
        assert e & vp8l._ON == n + (then & 15 if two else int(vp8l._MORE[s - 256]) if s >= 256 else 0)
        assert not two or e >> vp8l._AFTER & 255 == then >> 4
    assert (found >> vp8l._TWO & 1).sum() == 2  # of each code: its literal of one bit, twice
    streams, want = [], []
    for width in (1, 2, 3, 4, 63, 64, 65):
        w = Put()
        w.head(width, 1)
        w.put(0, 1), w.put(0, 1), w.put(0, 1)
        w.two(7, 9), w.one(0), w.one(0), w.one(255), w.one(0)
        bits = np.random.default_rng(width).integers(0, 2, width)
        for p in bits.tolist():
            w.put(p, 1)
        streams.append(w.data())
        want.append((7 + 2 * bits).tolist())
    assert [x[0, :, 2].tolist() for x in vp8l.decode_streams(streams)] == want
    for s in streams[4:]:
        with pytest.raises(ValueError):
            vp8l.decode_streams([streams[0], s[:-2], streams[3]])


def test_symbol_beyond_its_alphabet():
    w = Put()
    w.head(1, 1)
    w.put(0, 1), w.put(0, 1), w.put(0, 1)
    w.one(1), w.one(0), w.one(0), w.one(255), w.one(40)  # there are 40 prefixes of distances
    with pytest.raises(ValueError):
        vp8l.decode_streams([w.data()])


def test_texts_are_encoded_in_whole_blocks(monkeypatch):
    sizes, encode = [], webp.encode
    monkeypatch.setattr(webp, "encode", lambda strips: sizes.append(sum(map(len, strips))) or encode(strips))
    texts = [RNG.integers(97, 123, 1000, np.uint8).tobytes() for _ in range(300)]
    assert webp._payloads(webp._files(texts)) == [padded(t) for t in texts]
    assert sum(sizes) == 300 * 1024 and sizes[0] == webp.ENCODED and len(sizes) == 2
