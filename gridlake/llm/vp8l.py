"""A decoder of lossless WebP (VP8L) images, after RFC 9649.

Everything of the format is decoded: prefix codes simple and normal, meta prefix
codes, back-references with the distance map, the colour cache, and the inverse
predictor, cross-colour, subtract-green and colour-indexing transforms.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from .xxh import loads

#: Order of code length codes, and the multiplier of the colour cache's hash (fixed values of the format).
CODE_LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
MULTIPLIER = 0x1E35A7BD


#: (x, y) of the 120 nearest places of short distance codes, in code order (fixed values of the format).
NEAR = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2),
    (0, 3), (3, 0), (1, 3), (-1, 3), (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0),
    (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4), (4, 2), (-4, 2), (0, 5), (3, 4),
    (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1),
    (2, 6), (-2, 6), (6, 2), (-6, 2), (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3),
    (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1), (4, 6), (-4, 6), (6, 4), (-6, 4),
    (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7),
    (7, 5), (-7, 5), (8, 4), (6, 7), (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]


#: Bits after the symbols 16 to 18 of code lengths, and the least number of repeats.
_REPEATED = [(2, 3), (3, 3), (7, 11)]


class Bits:
    """Bits of a byte string, the least significant first."""

    def __init__(self, data: bytes, at: int = 0):
        self.size, self.at, self.data = len(data) * 8, at, data + bytes(16)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.size:
            raise ValueError("image data ends early")
        return int.from_bytes(self.data[at >> 3 : (at >> 3) + 5], "little") >> (at & 7) & ((1 << n) - 1)


class Prefix:
    """A canonical prefix code; `single` is the symbol of a code that has only one and takes no bits."""

    def __init__(self, lengths: bytes | bytearray):
        used = len(lengths) - lengths.count(0)
        self.lengths, self.most = lengths, max(lengths)
        self.single = None if used > 1 else lengths.index(self.most) if used else 0
        if self.single is None and sum(lengths.count(n) << (15 - n) for n in range(1, self.most + 1)) != 1 << 15:
            raise ValueError("a prefix code is not complete")
        self._table: list[int] | None = None

    @property
    def table(self) -> list[int]:
        """symbol << 4 | length for each value of the next `most` bits."""
        if self._table is None:
            out, code, last = [0] * (1 << self.most), 0, 0
            for n, s in sorted((n, s) for s, n in enumerate(self.lengths) if n):
                code <<= n - last
                first = int(f"{code:0{n}b}"[::-1], 2)
                out[first :: 1 << n] = [s << 4 | n] * (1 << (self.most - n))
                code, last = code + 1, n
            self._table = out
        return self._table

    def read(self, bits: Bits) -> int:
        if self.single is not None:
            return self.single
        at = bits.at
        entry = self.table[int.from_bytes(bits.data[at >> 3 : (at >> 3) + 3], "little") >> (at & 7) & ((1 << self.most) - 1)]
        bits.at = at + (entry & 15)
        if bits.at > bits.size:
            raise ValueError("image data ends early")
        return entry >> 4


@lru_cache(4096)
def _fixed(symbols: tuple[int, ...], alphabet: int) -> Prefix:
    """A code that is stored as one or two symbols."""
    lengths = bytearray(alphabet)
    for s in symbols:
        if s >= alphabet:
            raise ValueError("a symbol beyond its alphabet")
        lengths[s] = 1
    return Prefix(lengths)


def read_code(bits: Bits, alphabet: int) -> Prefix:
    """A prefix code as it is stored."""
    if bits.read(1):
        at = bits.at
        window = int.from_bytes(bits.data[at >> 3 : (at >> 3) + 4], "little") >> (at & 7)
        size = 8 if window & 2 else 1
        symbols = (window >> 2 & ((1 << size) - 1),)
        if window & 1:
            symbols += (window >> 2 + size & 255,)
        bits.at = at + 2 + size + 8 * (window & 1)
        if bits.at > bits.size:
            raise ValueError("image data ends early")
        return _fixed(symbols, alphabet)
    of_lengths = bytearray(19)
    n = 4 + bits.read(4)
    at, data = bits.at, bits.data
    window = int.from_bytes(data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)
    for s in CODE_LENGTH_ORDER[:n]:
        of_lengths[s] = window & 7
        window >>= 3
    bits.at = at + 3 * n
    code = Prefix(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else alphabet
    table, mask = (code.table, (1 << code.most) - 1) if code.single is None else ([code.single << 4], 0)
    lengths, at, last, place, have = bytearray(alphabet), 0, 8, bits.at, 0
    while at < alphabet and left:
        left -= 1
        if have < 14:  # a code and what follows it
            window, have = int.from_bytes(data[place >> 3 : (place >> 3) + 8], "little") >> (place & 7), 57
        entry = table[window & mask]
        n, s = entry & 15, entry >> 4
        if s < 16:
            if s:
                lengths[at] = last = s
            at += 1
        else:
            more, least = _REPEATED[s - 16]
            times = least + (window >> n & ((1 << more) - 1))
            if at + times > alphabet:
                raise ValueError("too many code lengths")
            if s == 16:
                lengths[at : at + times] = bytes((last,)) * times
            at += times
            n += more
        window >>= n
        have -= n
        place += n
    bits.at = place
    if place > bits.size:
        raise ValueError("image data ends early")
    return Prefix(lengths)


def _extra(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix and extra bits."""
    if prefix < 4:
        return prefix + 1
    n = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << n) + bits.read(n) + 1


class Coded:
    """What stands before the pixels of an entropy-coded image: its cache, groups of codes, and where the pixels begin."""

    def __init__(self, bits: Bits, width: int, height: int, main: bool):
        self.bits, self.width, self.total = bits, width, width * height
        self.cache_bits = bits.read(4) if bits.read(1) else 0
        if self.cache_bits > 11:
            raise ValueError("colour cache too large")
        self.group_bits, self.groups_of, n_groups = 0, None, 1
        if main and bits.read(1):
            self.group_bits = 2 + bits.read(3)
            down = -(-height >> self.group_bits)
            self.groups_of = (Coded(bits, -(-width >> self.group_bits), down, False).pixels() >> 8 & 0xFFFF).tolist()
            n_groups = max(self.groups_of) + 1
        sizes = [256 + 24 + (1 << self.cache_bits if self.cache_bits else 0), 256, 256, 256, 40]
        self.groups = [[read_code(bits, n) for n in sizes] for _ in range(n_groups)]

    def pixels(self) -> np.ndarray:
        """ARGB integers, row by row, a token at a time."""
        bits, width, total, cache_bits = self.bits, self.width, self.total, self.cache_bits
        cache, out, across = [0] * (1 << cache_bits) if cache_bits else [], [], -(-width >> self.group_bits)
        while len(out) < total:
            y, x = divmod(len(out), width)
            green, red, blue, alpha, far = self.groups[self.groups_of[(y >> self.group_bits) * across + (x >> self.group_bits)] if self.groups_of else 0]
            s = green.read(bits)
            if s < 256:
                r, b, a = red.read(bits), blue.read(bits), alpha.read(bits)
                new = [a << 24 | r << 16 | s << 8 | b]
            elif s < 280:
                length, code = _extra(bits, s - 256), _extra(bits, far.read(bits))
                distance = code - 120 if code > 120 else max(1, NEAR[code - 1][0] + NEAR[code - 1][1] * width)
                if distance > len(out) or len(out) + length > total:
                    raise ValueError("a back-reference leaves the image")
                new = out[len(out) - distance : len(out) - distance + length]
                while len(new) < length:
                    new += new[: length - len(new)]
            else:
                new = [cache[s - 280]]
            out += new
            if cache:
                for p in new:
                    cache[(p * MULTIPLIER & 0xFFFFFFFF) >> (32 - cache_bits)] = p
        return np.array(out, np.uint32)


#: Steps between two looks for lanes that have ended or run out of data.
CHECKED = 32
#: First length or distance of each prefix, and how many extra bits it has.
_FIRST = np.array([p + 1 if p < 4 else ((2 + (p & 1)) << ((p - 2) >> 1)) + 1 for p in range(40)], np.int64)
_MORE = np.array([0 if p < 4 else (p - 2) >> 1 for p in range(40)], np.int64)
_NEAR = np.array(NEAR, np.int64)


def tables(codes: list[Prefix]) -> tuple[np.ndarray, int]:
    """Look-up tables of codes of one alphabet, one after the other, and the bits that index them."""
    most = max(c.most for c in codes)
    bits = np.frombuffer(b"".join(c.lengths for c in codes), np.uint8).reshape(len(codes), -1).astype(np.int64)
    single = np.array([-1 if c.single is None else c.single for c in codes])
    one = np.flatnonzero(single >= 0)
    order = np.argsort(np.where(bits > 0, bits, 99), axis=1, kind="stable")
    n = np.take_along_axis(bits, order, 1)
    span = np.where(n > 0, 1 << (most - n), 0)
    order[one, 0], n[one, 0], span[one] = single[one], 0, 0
    span[one, 0] = 1 << most
    left = np.repeat((order << 4 | n).astype(np.uint16).ravel(), span.ravel()).reshape(len(codes), -1)
    reverse = np.array([int(f"{i:0{most}b}"[::-1], 2) if most else 0 for i in range(1 << most)])
    return left[:, reverse].ravel(), most


#: Parts of an entry: bits to go on by; whether a second literal follows; the symbol; a copy's extra bits of its length, or the second literal; whether it is a copy.
_ON, _TWO, _SYMBOL, _AFTER, _COPY = 63, 6, 7, 16, 1 << 24


def _entries(two: bool) -> np.ndarray:
    """The entry of each symbol << 4 | bits; if two, what it adds to another as the second of two, 0 if it can't be."""
    table = np.arange((256 + 24) << 4, dtype=np.int32)
    n, symbol = table & 15, table >> 4
    if two:
        return np.where(symbol < 256, n | 1 << _TWO | symbol << _AFTER, 0).astype(np.int32)
    more = _MORE.astype(np.int32)[np.maximum(symbol - 256, 0)]
    return np.where(symbol < 256, n | symbol << _SYMBOL, n + more | symbol << _SYMBOL | more << _AFTER | _COPY).astype(np.int32)


_ALONE, _SECOND = _entries(False), _entries(True)


def entries_of(table: np.ndarray, most: int, two: bool) -> np.ndarray:
    """Entries from a table of green symbols; if two, two literals in one where both fit."""
    if not two:
        return _ALONE.take(table)
    out, index = np.empty(len(table), np.int32), np.arange(1 << most)
    for lo in range(0, len(table), 64 << most):  # some lanes at a time
        part = table[lo : lo + (64 << most)].reshape(-1, 1 << most)
        n = part & 15
        then = part.ravel().take((index >> n) + (np.arange(len(part)) << most)[:, None])
        both = (part < 256 << 4) & (n + (then & 15) <= most)
        out[lo : lo + part.size] = (_ALONE.take(part) + _SECOND.take(then) * both).ravel()
    return out


def pixels_of(images: list[Coded]) -> list[np.ndarray]:
    """The ARGB integers of images that have neither a cache nor several groups: a lane for each, a token of every lane at a time.

    First all tokens are read, a few beyond the end of a lane too, which are dropped;
    then copies are followed to the literals they come from.
    """
    n = len(images)
    single, green_bits = tables([c.groups[0][0] for c in images])
    far, far_bits = tables([c.groups[0][4] for c in images])
    rest = [[c.groups[0][k] for c in images] for k in (1, 2, 3)]
    plain = all(c.single is not None for codes in rest for c in codes)
    other = [] if plain else [(tables(codes), shift) for codes, shift in zip(rest, (16, 0, 24), strict=True)]
    base = np.array([r.single << 16 | b.single | a.single << 24 for r, b, a in zip(*rest, strict=True)], np.uint32) if plain else np.zeros(n, np.uint32)
    green = entries_of(single, green_bits, plain)
    # of distances: bits to go on by, and the prefix
    far = far.astype(np.int32)
    far = (far & 15) + _MORE.astype(np.int32)[far >> 4] | far >> 4 << _SYMBOL
    size = np.array([len(c.bits.data) for c in images])
    start = np.cumsum(size) - size
    # a token takes less than 16 bytes, so lanes stay within the buffer until they are looked at
    buf = np.frombuffer(b"".join(c.bits.data for c in images) + bytes(16 * CHECKED + 8), np.uint8)
    word = loads(buf).view(np.int64)
    lane, mask, far_mask = np.arange(n), (1 << green_bits) - 1, (1 << far_bits) - 1
    begin_bit = start * 8 + np.array([c.bits.at for c in images])
    at, end = begin_bit.copy(), start * 8 + np.array([c.bits.size for c in images])
    total = np.array([c.total for c in images])
    width = np.array([c.width for c in images])
    left, row, far_row = total.copy(), lane << green_bits, lane << far_bits

    def look(at):
        """57 bits from each place on."""
        return word.take(at >> 3) >> (at & 7)

    chunks, copies, steps = [], [], 0
    while len(lane):
        entries, colours, places, found = [], [], [], []
        for _ in range(CHECKED):
            bits = look(at)
            entry = green.take((bits & mask) + row)
            on = entry & _ON
            at = at + on
            copy = (entry >= _COPY).nonzero()[0]
            if other:
                colour, lit = np.zeros(len(lane), np.uint32), (entry < _COPY).nonzero()[0]
                for (table, most), shift in other:
                    e = table[(lane[lit] << most) + (look(at[lit]) & (1 << most) - 1)]
                    at[lit] += e & 15
                    colour[lit] |= (e >> 4).astype(np.uint32) << np.uint32(shift)
                colours.append(colour)
            if len(copy):
                bits = bits.take(copy) >> on.take(copy)
                e = far.take((bits & far_mask) + far_row.take(copy))
                found.append((len(entries), copy, at.take(copy), e))
                at[copy] += e & _ON
            entries.append(entry)
            places.append(at)
        entries = np.stack(entries)
        took = 1 + (entries >> _TWO & 1)
        if found:
            step, copy, place, e = zip(*found, strict=True)
            step = np.repeat(np.array(step), [len(c) for c in copy])
            copy, place, e = (np.concatenate(x) for x in (copy, place, e))
            more = entries[step, copy] >> _AFTER & 15
            length = _FIRST[(entries[step, copy] >> _SYMBOL & 511) - 256] + (look(place - more) & (1 << more.astype(np.int64)) - 1)
            more = _MORE[e >> _SYMBOL]
            code = _FIRST[e >> _SYMBOL] + (look(place + (e & _ON) - more) & (1 << more) - 1)
            took[step, copy] = length
        upto = np.cumsum(took, 0)
        ended = (upto[-1] >= left).nonzero()[0]
        if len(ended):
            reached = upto[:, ended] >= left[ended]
            last = reached.argmax(0)
            place, over = np.stack(places)[last, ended], upto[last, ended] - left[ended]
            if over.any():
                # the second literal of two is beyond the end
                i, k = ended[over > 0], last[over > 0]
                if (entries[k, i] >> _TWO & 1 == 0).any():
                    raise ValueError("a back-reference leaves the image")
                alone = place[over > 0] - (entries[k, i] & _ON)
                place[over > 0] = alone + (single[row[i] + (look(alone) & mask)] & 15)
                took[k, i] = 1
            if (place > end[ended]).any():
                raise ValueError("image data ends early")
            took[:, ended] *= np.arange(CHECKED)[:, None] <= last
        if found:
            kept = took[step, copy] > 0
            copies.append((lane[copy[kept]], step[kept] + steps, length[kept], code[kept]))
        chunks.append((steps, lane, entries, took, np.stack(colours) if other else None))
        steps += CHECKED
        left = left - upto[-1]
        going = left > 0
        if (at > end)[going].any():
            raise ValueError("image data ends early")
        lane, at, end, left, row, far_row = (x[going] for x in (lane, at, end, left, row, far_row))
    # a lane has one token each step until it ends, so tokens fall into place by lane and step
    count = np.zeros(n, np.int64)
    for _, lane, entries, _, _ in chunks:
        count[lane] += CHECKED
    begin_token = np.cumsum(count) - count
    of = np.repeat(np.arange(n), count)
    value, times = np.empty(len(of), np.int32), np.empty(len(of), np.int64)
    colour = np.empty(len(of), np.uint32) if other else base[of]
    for step, lane, entries, took, colours in chunks:
        place = (begin_token[lane] + step)[:, None] + np.arange(CHECKED)
        value[place], times[place] = entries.T, took.T
        if other:
            colour[place] = colours.T
    out = np.repeat((value.astype(np.uint32) >> np.uint32(_SYMBOL) & np.uint32(255)) << np.uint32(8) | colour, times)
    first = np.cumsum(times) - times
    two = ((value >> _TWO & 1 > 0) & (times > 1)).nonzero()[0]
    out[first[two] + 1] = (value[two].astype(np.uint32) >> np.uint32(_AFTER) & np.uint32(255)) << np.uint32(8) | colour[two]
    begin = np.cumsum(total) - total
    if not copies:
        return np.split(out, begin[1:])
    lane_of, step, length, code = (np.concatenate(x) for x in zip(*copies, strict=True))
    near = _NEAR[np.minimum(code, 120) - 1]
    away = np.where(code > 120, code - 120, np.maximum(1, near[:, 0] + near[:, 1] * width[lane_of]))
    first = first[begin_token[lane_of] + step]
    if (first - away < begin[lane_of]).any():
        raise ValueError("a back-reference leaves the image")
    place = np.repeat(first - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
    source = np.arange(len(out))
    source[place] -= np.repeat(away, length)
    going = place
    while len(going):
        now = source[going]
        further = source[now]
        source[going] = further
        going = going[further != now]
    out[place] = out[source[place]]
    return np.split(out, begin[1:])


def _channels(p: np.ndarray) -> np.ndarray:
    """ARGB integers as a last axis of alpha, red, green, blue."""
    return np.stack([p >> k & 255 for k in (24, 16, 8, 0)], -1).astype(np.int64)


def _half(a, b):
    return (a + b) // 2


def _select(left, top, corner):
    p = left + top - corner
    return left if np.abs(p - left).sum() < np.abs(p - top).sum() else top


def _half_step(left, top, corner):
    mean = _half(left, top)
    d = mean - corner
    return np.clip(mean + np.where(d < 0, -(-d // 2), d // 2), 0, 255)


#: Predictions that need the pixel to the left, from (left, top, right, corner).
_FROM_LEFT = {
    5: lambda a, b, c, d: _half(_half(a, c), b),
    6: lambda a, b, c, d: _half(a, d),
    7: lambda a, b, c, d: _half(a, b),
    10: lambda a, b, c, d: _half(_half(a, d), _half(b, c)),
    11: lambda a, b, c, d: _select(a, b, d),
    12: lambda a, b, c, d: np.clip(a + b - d, 0, 255),
    13: lambda a, b, c, d: _half_step(a, b, d),
}
_BLACK = np.array([255, 0, 0, 0])


def unpredict(image: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Add to each residual the prediction from the pixels left, above and around; image: rows, columns, channels.

    Stretches of a row with one mode are done at once where the mode does not need
    the pixel to the left, or is that pixel.
    """
    h, w, _ = image.shape
    out = np.zeros_like(image)
    first = image[0].copy()
    first[0] += _BLACK
    out[0] = np.cumsum(first, 0) & 255
    for y in range(1, h):
        above, now = out[y - 1], out[y]
        now[0] = (image[y, 0] + above[0]) & 255
        right = np.vstack((above[1:], now[:1]))
        for lo in range(0, w, 1 << bits):
            hi, lo, mode = min(w, lo + (1 << bits)), max(lo, 1), int(modes[y >> bits, lo >> bits])
            if lo >= hi:
                continue
            here, top, corner, tr = image[y, lo:hi], above[lo:hi], above[lo - 1 : hi - 1], right[lo:hi]
            if mode == 1:
                now[lo:hi] = (now[lo - 1] + np.cumsum(here, 0)) & 255
            elif mode in _FROM_LEFT:
                for x in range(lo, hi):
                    now[x] = (image[y, x] + _FROM_LEFT[mode](now[x - 1], above[x], right[x], above[x - 1])) & 255
            else:
                guess = {2: top, 3: tr, 4: corner, 8: _half(corner, top), 9: _half(top, tr)}.get(mode, _BLACK)
                now[lo:hi] = (here + guess) & 255
    return out


def uncross(image: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    """Add back what green and red foretell of red and blue."""
    h, w, _ = image.shape
    signed = lambda v: (v & 255) - ((v & 128) << 1)
    f = factors[np.arange(h)[:, None] >> bits, np.arange(w)[None, :] >> bits]
    red_blue, green_blue, green_red = signed(f[..., 1]), signed(f[..., 2]), signed(f[..., 3])
    out = image.copy()
    green = signed(image[..., 2])
    out[..., 1] = (image[..., 1] + (green_red * green >> 5)) & 255
    out[..., 3] = (image[..., 3] + (green_blue * green >> 5) + (red_blue * signed(out[..., 1]) >> 5)) & 255
    return out


def unpalette(image: np.ndarray, colours: np.ndarray, width: int) -> np.ndarray:
    """Colours of bundled palette indices; an index beyond the palette is transparent black."""
    n = len(colours)
    per = 8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1
    size = 8 // per
    index = image[..., 2]
    index = np.stack([index >> size * k & ((1 << size) - 1) for k in range(per)], -1).reshape(len(index), -1)[:, :width]
    full = np.vstack([colours, np.zeros((256 - n, 4), np.int64)])
    return full[index]


class Stream:
    """The header of a VP8L stream: size, transforms, and its coded image."""

    def __init__(self, data: bytes):
        bits = Bits(data)
        if bits.read(8) != 0x2F:
            raise ValueError("not a lossless image")
        self.width, self.height = bits.read(14) + 1, bits.read(14) + 1
        bits.read(1)
        if bits.read(3):
            raise ValueError("unknown version")
        self.transforms, across, used = [], self.width, set()
        while bits.read(1):
            kind = bits.read(2)
            if kind in used:
                raise ValueError("a transform comes twice")
            used.add(kind)
            if kind in (0, 1):
                size = bits.read(3) + 2
                down = -(-self.height >> size)
                part = _channels(Coded(bits, -(-across >> size), down, False).pixels()).reshape(down, -1, 4)
                self.transforms.append((kind, size, part, across))
            elif kind == 2:
                self.transforms.append((kind, 0, None, across))
            else:
                n = bits.read(8) + 1
                colours = np.cumsum(_channels(Coded(bits, n, 1, False).pixels()), axis=0) & 255
                self.transforms.append((kind, 0, colours, across))
                across = -(-across // (8 if n <= 2 else 4 if n <= 4 else 2 if n <= 16 else 1))
        self.image = Coded(bits, across, self.height, True)

    def finish(self, argb: np.ndarray) -> np.ndarray:
        """The picture from its coded pixels: rows, columns, (alpha, red, green, blue) as uint8."""
        if self.transforms and self.transforms[-1][0] == 2:
            green = argb >> np.uint32(8) & np.uint32(255)
            argb = argb & np.uint32(0xFF00FF00) | (argb & np.uint32(0xFF00FF)) + green * np.uint32(0x10001) & np.uint32(0xFF00FF)
            transforms = self.transforms[:-1]
        else:
            transforms = self.transforms
        if not transforms:
            return argb.astype(">u4").view(np.uint8).reshape(self.height, self.width, 4)
        image = _channels(argb).reshape(self.height, -1, 4)
        for kind, size, part, was in reversed(transforms):
            if kind == 0:
                image = unpredict(image, part[..., 2], size)
            elif kind == 1:
                image = uncross(image, part, size)
            elif kind == 2:
                image[..., 1] = (image[..., 1] + image[..., 2]) & 255
                image[..., 3] = (image[..., 3] + image[..., 2]) & 255
            else:
                image = unpalette(image, part, was)
        return image.astype(np.uint8)


def decode_stream(data: bytes) -> np.ndarray:
    """The pixels of a VP8L stream: rows, columns, (alpha, red, green, blue) as uint8."""
    stream = Stream(data)
    return stream.finish(stream.image.pixels())


#: Streams decoded side by side, and pixels of them.
LANES, PIXELS = 4096, 1 << 22


def decode_streams(data: list[bytes]) -> list[np.ndarray]:
    """As decode_stream for each; streams of like size without a cache and with one group of codes side by side."""
    streams = [Stream(x) for x in data]
    out: list = [None] * len(data)
    able = []
    for i, s in enumerate(streams):
        if s.image.cache_bits or s.image.groups_of:
            out[i] = s.finish(s.image.pixels())
        else:
            able.append(i)
    able.sort(key=lambda i: len(data[i]))
    while able:
        part, n = [], 0
        while able and len(part) < LANES and (not part or n + streams[able[-1]].image.total <= PIXELS):
            part.append(able.pop())
            n += streams[part[-1]].image.total
        for i, argb in zip(part, pixels_of([streams[i].image for i in part]), strict=True):
            out[i] = streams[i].finish(argb)
    return out


def chunk(data: bytes) -> bytes:
    """The VP8L stream of a WebP file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        n = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("no lossless image in the file")
