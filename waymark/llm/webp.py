"""Lossless WebP (VP8L) in numpy: a full decoder, and an encoder for samples.

The layout of the bit stream follows the public WebP lossless specification.
Pixels are 32-bit numbers: alpha, red, green, blue from the top byte down.
"""

from __future__ import annotations

import heapq

import numpy as np

MAX_SIDE = 16384
MAX_CODE = 15
GREEN_LENGTHS, DISTANCES = 24, 40

# Fixed values of the format.
CODE_LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
CACHE_FACTOR = 0x1E35A7BD
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = 0, 1, 2, 3

#: Offsets (x to the left, y up) of the 120 short distance codes: nearest first, then by |x|, left before right.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))


class WebPError(ValueError):
    """The bytes aren't a whole lossless WebP image."""


class Bits:
    """Reader of a little-endian bit stream."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def read(self, n: int) -> int:
        at = self.at
        self.at = at + n
        if self.at > self.end:
            raise WebPError("the stream ends early")
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)

    def peek(self, n: int) -> int:
        at = self.at
        return (int.from_bytes(self.data[at >> 3 : (at >> 3) + 8], "little") >> (at & 7)) & ((1 << n) - 1)


_TURNED = [int(f"{k:08b}"[::-1], 2) for k in range(256)]


def _reversed(code: int, n: int) -> int:
    return (_TURNED[code & 255] << 8 | _TURNED[code >> 8]) >> (16 - n)


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The codes of given lengths, bits reversed as they stand in the stream."""
    codes = np.zeros(len(lengths), np.int64)
    code, before = 0, 0
    used = np.flatnonzero(lengths)
    for n, symbol in sorted(zip(lengths[used].tolist(), used.tolist(), strict=True)):
        code <<= n - before
        codes[symbol], before = _reversed(code, n), n
        code += 1
    return codes


class Prefix:
    """A prefix code as lookup tables over its longest code."""

    @classmethod
    def of_one(cls, symbol: int) -> Prefix:
        """The code of one symbol, which takes no bits."""
        code = cls.__new__(cls)
        code.only, code.width, code.symbol, code.length = symbol, 0, np.array([symbol], np.int64), np.zeros(1, np.int64)
        return code

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        if len(used) == 0:
            raise WebPError("a prefix code has no symbol")
        if len(used) == 1:
            self.width, self.symbol, self.length = 0, np.array([used[0]], np.int64), np.zeros(1, np.int64)
            self.only = int(used[0])
            return
        self.only, self.width = None, int(lengths.max())
        if (1 << (MAX_CODE - lengths[used].astype(np.int64))).sum() != 1 << MAX_CODE:
            raise WebPError("a prefix code is not complete")
        self.symbol, self.length = np.zeros(1 << self.width, np.int64), np.zeros(1 << self.width, np.int64)
        for s, code in zip(used.tolist(), canonical(lengths)[used].tolist(), strict=True):
            n = int(lengths[s])
            self.symbol[code :: 1 << n], self.length[code :: 1 << n] = s, n

    def read(self, bits: Bits) -> int:
        if self.only is not None:
            return self.only
        k = bits.peek(self.width)
        bits.read(int(self.length[k]))
        return int(self.symbol[k])


def _read_prefix(bits: Bits, size: int) -> Prefix:
    lengths = np.zeros(size, np.int64)
    if bits.read(1):
        two = bits.read(1)
        symbols = [bits.read(8 if bits.read(1) else 1)]
        if two:
            symbols.append(bits.read(8))
        if max(symbols) >= size:
            raise WebPError("a symbol is out of range")
        lengths[symbols] = 1
        return Prefix(lengths) if len(set(symbols)) > 1 else Prefix.of_one(symbols[0])
    of_lengths = np.zeros(19, np.int64)
    for k in range(4 + bits.read(4)):
        of_lengths[CODE_LENGTH_ORDER[k]] = bits.read(3)
    code = Prefix(of_lengths)
    left = 2 + bits.read(2 + 2 * bits.read(3)) if bits.read(1) else size
    k, before = 0, 8
    while k < size and left:
        left -= 1
        n = code.read(bits)
        if n < 16:
            lengths[k] = n
            before = n or before
            k += 1
            continue
        extra, base, fill = {16: (2, 3, before), 17: (3, 3, 0), 18: (7, 11, 0)}[n]
        times = base + bits.read(extra)
        if k + times > size:
            raise WebPError("too many code lengths")
        lengths[k : k + times] = fill
        k += times
    return Prefix(lengths)


def _read_number(bits: Bits, prefix: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if prefix < 4:
        return prefix + 1
    extra = (prefix - 2) >> 1
    return ((2 + (prefix & 1)) << extra) + bits.read(extra) + 1


def _peeks(raw: np.ndarray, at: np.ndarray, n) -> np.ndarray:
    """``n`` bits (25 at most) at each place of a stream; 0 beyond its end."""
    byte = np.minimum(at >> 3, len(raw) - 4)
    word = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16 | raw[byte + 3] << 24
    return (word >> (at & 7)) & ((1 << n) - 1)


def _numbers(raw: np.ndarray, at: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths or distances whose extra bits stand at ``at``, and where they end."""
    extra = np.where(prefix < 4, 0, (prefix - 2) >> 1)
    return np.where(prefix < 4, prefix, (2 + (prefix & 1) << extra) + _peeks(raw, at, extra)) + 1, at + extra


def _references(raw: np.ndarray, at: np.ndarray, group: list[Prefix]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length, distance code and end of the back-references at places where green has a length symbol."""
    green, far = group[0], group[4]
    k = _peeks(raw, at, green.width)
    length, end = _numbers(raw, at + green.length[k], green.symbol[k] - 256)
    if far.only is None:
        k = _peeks(raw, end, far.width)
        code, end = _numbers(raw, end + far.length[k], far.symbol[k])
    else:
        code, end = _numbers(raw, end, np.full(len(at), far.only, np.int64))
    return length, code, end


def _green_image(bits: Bits, group: list[Prefix], n: int, width: int) -> np.ndarray | None:
    """All pixels at once if only green and back-references take bits; the other channels are constant.

    Where each symbol would end is computed for every bit, then the ends are followed from the first.
    """
    green = group[0]
    if any(p.only is None for p in group[1:4]) or green.only is not None or int(green.symbol.max()) >= 256 + GREEN_LENGTHS:
        return None
    begin = bits.at >> 3
    small = np.frombuffer(bits.data, np.uint8, offset=begin).astype(np.int32)
    if len(small) < 4:
        return None
    three = small[:-2] | (small[1:-1] << 8) | (small[2:] << 16)
    peek = ((three[:, None] >> np.arange(8, dtype=np.int32)) & ((1 << green.width) - 1)).ravel()
    one = green.length.astype(np.int32)[peek] + np.arange(len(peek), dtype=np.int32)
    refers = bool(green.symbol.max() >= 256)
    if refers:
        raw = small.astype(np.int64)
        places = np.flatnonzero((green.symbol >= 256)[peek])
        one[places] = _references(raw, places, group)[2]
    last = np.int32(len(peek) - 1)
    np.minimum(one, last, out=one)
    two = one[one]
    eight = two[two]
    eight = eight[eight]
    jump, at, heads = memoryview(eight), bits.at & 7, []
    for _ in range(-(-n // 8)):
        heads.append(at)
        if at == last:
            break
        at = jump[at]
    place = np.empty((len(heads), 8), np.int32)
    place[:, 0] = heads
    for k in range(1, 8):
        place[:, k] = one[place[:, k - 1]]
    place = place.ravel()
    rest = group[1].only << 16 | group[2].only | group[3].only << 24
    symbol = green.symbol[peek[place]]
    if not refers:
        place, symbol = place[:n], symbol[:n]
        final = int(place[-1]) + int(green.length[peek[place[-1]]])
        if len(symbol) < n:
            raise WebPError("the stream ends early")
        out = symbol.astype(np.uint32)
    else:
        length, far = np.ones(len(place), np.int64), np.zeros(len(place), np.int64)
        which = np.flatnonzero(symbol >= 256)
        length[which], far[which], ends = _references(raw, place[which].astype(np.int64), group)
        upto = np.cumsum(length)
        count = int(np.searchsorted(upto, n)) + 1
        if count > len(upto) or upto[count - 1] > n:
            raise WebPError("a back-reference leaves the image" if count <= len(upto) else "the stream ends early")
        final = int(ends[np.searchsorted(which, count - 1)]) if symbol[count - 1] >= 256 else int(place[count - 1]) + int(green.length[peek[place[count - 1]]])
        begins = upto - length
        out = np.zeros(n, np.uint32)
        plain = np.flatnonzero(symbol[:count] < 256)
        out[begins[plain]] = symbol[plain]
        which = which[which < count]
        for at, size, code in zip(begins[which].tolist(), length[which].tolist(), far[which].tolist(), strict=True):
            _copy(out, at, size, _distance(code, width))
    bits.at = 8 * begin + final
    if bits.at > bits.end:
        raise WebPError("the stream ends early")
    return out << np.uint32(8) | np.uint32(rest)


def _distance(code: int, width: int) -> int:
    if code > len(NEAR):
        return code - len(NEAR)
    x, y = NEAR[code - 1]
    return max(x + y * width, 1)


def _copy(out: np.ndarray, at: int, length: int, distance: int) -> None:
    if distance > at or at + length > len(out):
        raise WebPError("a back-reference leaves the image")
    if distance >= length:
        out[at : at + length] = out[at - distance : at - distance + length]
    else:
        out[at : at + length] = np.resize(out[at - distance : at], length)


def _read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """An entropy-coded image; ``top`` allows several code groups."""
    cache_bits = bits.read(4) if bits.read(1) else 0
    if cache_bits > 11:
        raise WebPError("the colour cache is too large")
    meta, meta_bits = None, 0
    if top and bits.read(1):
        meta_bits = bits.read(3) + 2
        side = lambda n: -(-n // (1 << meta_bits))
        meta = (_read_pixels(bits, side(width), side(height), False) >> np.uint32(8)) & np.uint32(0xFFFF)
        meta = meta.reshape(side(height), side(width))
    cache_size = 1 << cache_bits if cache_bits else 0
    sizes = (256 + GREEN_LENGTHS + cache_size, 256, 256, 256, DISTANCES)
    groups = [[_read_prefix(bits, s) for s in sizes] for _ in range(int(meta.max()) + 1 if meta is not None else 1)]
    n = width * height
    if meta is None and not cache_bits:
        whole = _green_image(bits, groups[0], n, width)
        if whole is not None:
            return whole
    out = np.zeros(n, np.uint32)
    cache, cached = [0] * cache_size, 0
    group, at = groups[0], 0

    def remember(upto: int) -> None:
        nonlocal cached
        for pixel in out[cached:upto].tolist():
            cache[(pixel * CACHE_FACTOR & 0xFFFFFFFF) >> (32 - cache_bits)] = pixel
        cached = upto

    while at < n:
        if meta is not None:
            group = groups[int(meta[at // width >> meta_bits, at % width >> meta_bits])]
        symbol = group[0].read(bits)
        if symbol < 256:
            red, blue, alpha = (group[k].read(bits) for k in (1, 2, 3))
            out[at] = alpha << 24 | red << 16 | symbol << 8 | blue
            at += 1
        elif symbol < 256 + GREEN_LENGTHS:
            length = _read_number(bits, symbol - 256)
            code = _read_number(bits, group[4].read(bits))
            _copy(out, at, length, _distance(code, width))
            at += length
        else:
            if cache_size:
                remember(at)
            if symbol - 256 - GREEN_LENGTHS >= cache_size:
                raise WebPError("a cache index is out of range")
            out[at] = cache[symbol - 256 - GREEN_LENGTHS]
            at += 1
    return out


def _planes(pixels: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha of each pixel, as 16-bit numbers that may be added."""
    return pixels.astype("<u4").view(np.uint8).reshape(*pixels.shape, 4).astype(np.int16)


def _pixels(planes: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((planes & 0xFF).astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def predict(mode: int, left: np.ndarray, above: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Prediction of pixels (last axis: four channels) from their neighbours: left, above, above-left and above-right."""
    half = lambda a, b: (a + b) >> 1
    clamp = lambda x: np.clip(x, 0, 255)
    if mode == 0 or mode > 13:
        return np.broadcast_to(np.array([0, 0, 0, 255], np.int16), left.shape)
    if mode <= 4:
        return (left, above, right, corner)[mode - 1]
    if mode == 5:
        return half(half(left, right), above)
    if mode <= 9:
        return half(*((left, corner), (left, above), (corner, above), (above, right))[mode - 6])
    if mode == 10:
        return half(half(left, corner), half(above, right))
    if mode == 11:
        to_left, to_above = np.abs(above - corner).sum(-1, keepdims=True), np.abs(left - corner).sum(-1, keepdims=True)
        return np.where(to_left < to_above, left, above)
    if mode == 12:
        return clamp(left + above - corner)
    mean = half(left, above)
    return clamp(mean + np.trunc((mean - corner) / 2).astype(np.int16))


def _neighbours(planes: np.ndarray, y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
    """Left, above, above-left and above-right; of the last column the latter is the row's own first pixel."""
    inner = x + 1 < planes.shape[1]
    return planes[y, x - 1], planes[y - 1, x], planes[y - 1, x - 1], planes[np.where(inner, y - 1, y), np.where(inner, x + 1, 0)]


def unpredict(pixels: np.ndarray, modes: np.ndarray, bits: int) -> np.ndarray:
    """Pixels from differences to their predictions; those with equal x + 2 y don't depend on each other."""
    planes = _planes(pixels)
    height, width = pixels.shape
    planes[0, 0] = (planes[0, 0] + [0, 0, 0, 255]) & 0xFF
    planes[0] = np.cumsum(planes[0].astype(np.int64), axis=0) & 0xFF
    planes[:, 0] = np.cumsum(planes[:, 0].astype(np.int64), axis=0) & 0xFF
    mode = modes >> np.uint32(8) & np.uint32(0xF)
    for front in range(3, width + 2 * height - 2):
        y = np.arange(max(1, (front - width + 2) // 2), min(height - 1, (front - 1) // 2) + 1)
        x = front - 2 * y
        of = mode[y >> bits, x >> bits]
        for m in np.unique(of):
            k = of == m
            planes[y[k], x[k]] = (planes[y[k], x[k]] + predict(int(m), *_neighbours(planes, y[k], x[k]))) & 0xFF
    return _pixels(planes)


def cross_deltas(factors: np.ndarray, shape: tuple[int, int], bits: int) -> np.ndarray:
    """Signed factors of each pixel: green to red, green to blue, red to blue."""
    wide = np.repeat(np.repeat(factors, 1 << bits, 0), 1 << bits, 1)[: shape[0], : shape[1]]
    return _planes(wide)[..., :3].astype(np.int8).astype(np.int32)


def _signed(x: np.ndarray) -> np.ndarray:
    return (x & 0xFF).astype(np.uint8).view(np.int8).astype(np.int32)


def uncross(pixels: np.ndarray, factors: np.ndarray, bits: int) -> np.ndarray:
    f, p = cross_deltas(factors, pixels.shape, bits), _planes(pixels).astype(np.int32)
    green = _signed(p[..., 1])
    red = p[..., 2] + (f[..., 0] * green >> 5)
    blue = p[..., 0] + (f[..., 1] * green >> 5) + (f[..., 2] * _signed(red) >> 5)
    p[..., 2], p[..., 0] = red, blue
    return _pixels(p)


def palette_bits(colours: int) -> int:
    """How many pixels share one, as a power of two."""
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unpalette(pixels: np.ndarray, palette: np.ndarray, width: int) -> np.ndarray:
    share = palette_bits(len(palette))
    each = 8 >> share
    index = (pixels >> np.uint32(8)) & np.uint32(0xFF)
    index = (index[..., None] >> np.arange(0, 8, each, dtype=np.uint32)) & np.uint32((1 << each) - 1)
    index = index.reshape(pixels.shape[0], -1)[:, :width]
    full = np.zeros(256, np.uint32)  # indices beyond the palette are transparent black
    full[: len(palette)] = palette
    return full[index]


def unwrap(data: bytes) -> bytes:
    """The VP8L stream in a RIFF file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise WebPError("not a WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise WebPError("no lossless image in the file")


def decode(data: bytes) -> np.ndarray:
    """Pixels [height, width] of a lossless WebP file; without an alpha channel all are opaque."""
    bits = Bits(unwrap(data))
    if bits.read(8) != 0x2F:
        raise WebPError("wrong signature")
    width, height, alpha, version = bits.read(14) + 1, bits.read(14) + 1, bits.read(1), bits.read(3)
    if version:
        raise WebPError("unknown version")
    transforms, coded = [], width
    while bits.read(1):
        kind = bits.read(2)
        if kind in [t[0] for t in transforms]:
            raise WebPError("a transform comes twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            size = bits.read(3) + 2
            shape = -(-height // (1 << size)), -(-coded // (1 << size))
            transforms.append((kind, size, _read_pixels(bits, shape[1], shape[0], False).reshape(shape), coded))
        elif kind == PALETTE:
            colours = bits.read(8) + 1
            steps = _planes(_read_pixels(bits, colours, 1, False))
            transforms.append((kind, 0, _pixels(np.cumsum(steps, 0)), coded))
            coded = -(-coded // (1 << palette_bits(colours)))
        else:
            transforms.append((kind, 0, None, coded))
    pixels = _read_pixels(bits, coded, height, True).reshape(height, coded)
    for kind, size, given, before in reversed(transforms):
        if kind == PREDICTOR:
            pixels = unpredict(pixels, given, size)
        elif kind == CROSS_COLOUR:
            pixels = uncross(pixels, given, size)
        elif kind == PALETTE:
            pixels = unpalette(pixels, given, before)
        else:
            p = _planes(pixels)
            p[..., 0] += p[..., 1]
            p[..., 2] += p[..., 1]
            pixels = _pixels(p)
    return pixels if alpha else pixels | np.uint32(0xFF000000)


def code_lengths(counts: np.ndarray, longest: int = MAX_CODE) -> np.ndarray:
    """Huffman code lengths, at most ``longest``; flatter counts are tried until they fit."""
    lengths, counts = np.zeros(len(counts), np.int64), counts.astype(np.int64)
    used = np.flatnonzero(counts).tolist()
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    while True:
        heap = [(c, s) for c, s in zip(counts[used].tolist(), used, strict=True)]
        heapq.heapify(heap)
        parent, number = {}, len(counts)
        while len(heap) > 1:
            (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
            parent[x] = parent[y] = number
            heapq.heappush(heap, (a + b, number))
            number += 1
        depth = {number - 1: 0}
        for s in sorted(parent, reverse=True):
            depth[s] = depth[parent[s]] + 1
        found = [depth[s] for s in used]
        if max(found) <= longest:
            lengths[used] = found
            return lengths
        counts[used] = (counts[used] + 1) // 2


class Writer:
    """Writer of a little-endian bit stream."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n

    def put_one(self, symbol: int) -> None:
        """The prefix code of one symbol."""
        self.put(0b101 | symbol << 3, 11)

    def put_prefix(self, lengths: np.ndarray) -> None:
        used = np.flatnonzero(lengths)
        if len(used) <= 2 and used.max(initial=0) < 256:
            self.put(1, 1)
            self.put(max(len(used) - 1, 0), 1)
            self.put(1, 1)
            for s in used.tolist() or [0]:
                self.put(s, 8)
            return
        runs, k, end = [], 0, int(used.max()) + 1
        values = lengths[:end].tolist()
        while k < end:
            if values[k]:
                runs.append((values[k], 0, 0))
                k += 1
                continue
            n = 1
            while k + n < end and not values[k + n] and n < 138:
                n += 1
            if n < 3:
                runs += [(0, 0, 0)] * n
            else:
                runs.append((18, n - 11, 7) if n > 10 else (17, n - 3, 3))
            k += n
        counts = np.bincount([r[0] for r in runs], minlength=19)
        of_lengths = code_lengths(counts, 7)
        codes = canonical(of_lengths)
        last = max(k for k, s in enumerate(CODE_LENGTH_ORDER) if of_lengths[s])
        self.put(0, 1)
        self.put(max(last + 1, 4) - 4, 4)
        for s in CODE_LENGTH_ORDER[: max(last + 1, 4)]:
            self.put(int(of_lengths[s]), 3)
        fits = len(runs) >= 2
        self.put(int(fits), 1)
        if fits:
            size = max(-(-(len(runs) - 2).bit_length() // 2) * 2, 2)
            self.put((size - 2) // 2, 3)
            self.put(len(runs) - 2, size)
        else:
            runs.append((0, 0, 0))
        alone = int(np.count_nonzero(of_lengths)) == 1
        for s, extra, n in runs:
            if not alone:
                self.put(int(codes[s]), int(of_lengths[s]))
            self.put(extra, n)

    def to_bytes(self) -> bytes:
        return self.value.to_bytes(-(-self.n // 8), "little")


def wrap(stream: bytes) -> bytes:
    body = b"WEBPVP8L" + len(stream).to_bytes(4, "little") + stream + b"\0" * (len(stream) & 1)
    return b"RIFF" + len(body).to_bytes(4, "little") + body


def put_head(out: Writer, width: int, height: int, alpha: bool = False) -> None:
    for value, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (int(alpha), 1), (0, 3)):
        out.put(value, n)


def number_prefix(value: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbol, number of extra bits and extra bits of lengths or distance codes."""
    v = np.asarray(value, np.int64) - 1
    top = np.maximum(np.frexp(np.maximum(v, 1).astype(float))[1] - 1, 1)
    prefix = np.where(v < 4, v, 2 * top + ((v >> (top - 1)) & 1))
    extra = np.where(v < 4, 0, top - 1)
    return prefix, extra, v & ((1 << extra) - 1)


#: Repeats of so many samples are looked for, where a sample 32 or 10 (a space or line end) comes before.
REPEAT = 24
_FACTOR, _MAX_LENGTH, _MAX_DISTANCE = np.uint64(0x9E3779B97F4A7C15), 4096, (1 << 20) - 256


def find_repeats(flat: np.ndarray) -> list[tuple[int, int, int]]:
    """(place, length, distance) of back-references, left to right: each the longest from the latest equal place before."""
    if len(flat) < 2 * REPEAT:
        return []
    marks = np.flatnonzero((flat[: -REPEAT - 1] == 32) | (flat[: -REPEAT - 1] == 10)) + 1
    starts = np.concatenate([np.zeros(1, np.int64), marks])
    words = np.lib.stride_tricks.sliding_window_view(flat, 8)
    eight = lambda at: np.ascontiguousarray(words[at]).view(np.uint64)[:, 0]
    key = ((eight(starts) * _FACTOR ^ eight(starts + 8)) * _FACTOR ^ eight(starts + 16)) * _FACTOR
    in_order = np.sort(key)
    if not (in_order[1:] == in_order[:-1]).any():
        return []
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    before = np.full(len(starts), -1)
    before[order[1:][same]] = starts[order[:-1][same]]
    k = np.flatnonzero(before >= 0)
    found, done = [], 0
    for at, source in zip(starts[k].tolist(), before[k].tolist(), strict=True):
        if at < done or at - source > _MAX_DISTANCE:
            continue
        room = min(_MAX_LENGTH, len(flat) - at)
        differ = np.flatnonzero(flat[at : at + room] != flat[source : source + room])
        length = int(differ[0]) if len(differ) else room
        if length >= REPEAT:
            found.append((at, length, at - source))
            done = at + length
    return found


def put_image(out: Writer, flat: np.ndarray, top: bool) -> np.ndarray:
    """Codes of a green image in ``out``, and its symbols as bits, which the caller appends."""
    for _ in range(1 + top):  # no colour cache, one group of codes
        out.put(0, 1)
    repeats = find_repeats(flat)
    place, plain = None, flat
    if repeats:
        literal = np.ones(len(flat), bool)
        for at, length, _ in repeats:
            literal[at : at + length] = False
        place = np.flatnonzero(literal)
        plain = flat[place]
    counts = np.bincount(plain, minlength=256 + GREEN_LENGTHS)
    if repeats:
        at, length, distance = np.array(repeats, np.int64).T
        size_prefix, size_extra, size_rest = number_prefix(length)
        far_prefix, far_extra, far_rest = number_prefix(distance + len(NEAR))
        np.add.at(counts, 256 + size_prefix, 1)
    lengths = code_lengths(counts)
    out.put_prefix(lengths)
    for only in (0, 0, 255):  # red, blue, alpha
        out.put_one(only)
    codes = canonical(lengths)
    if np.count_nonzero(lengths) == 1:
        lengths = lengths * 0
    value, size = codes.astype(np.uint16)[plain], lengths.astype(np.uint8)[plain]
    if repeats:
        far = code_lengths(np.bincount(far_prefix, minlength=DISTANCES))
        out.put_prefix(far)
        far_codes = canonical(far)
        if np.count_nonzero(far) == 1:
            far = far * 0
        value = np.concatenate([value, np.stack([codes[256 + size_prefix], size_rest, far_codes[far_prefix], far_rest], 1).ravel()])
        size = np.concatenate([size, np.stack([lengths[256 + size_prefix], size_extra, far[far_prefix], far_extra], 1).ravel()])
        order = np.argsort(np.concatenate([place, np.repeat(at, 4)]), kind="stable")
        value, size = value[order], size[order]
    else:
        out.put_one(0)
    if place is not None:
        value = value.astype(np.uint32)  # extra bits of distances
    end = np.cumsum(size, dtype=np.int64)
    within = (np.arange(end[-1], dtype=np.int32) - np.repeat((end - size).astype(np.int32), size)).astype(value.dtype)
    return ((np.repeat(value, size) >> within) & value.dtype.type(1)).astype(np.uint8)


def _file(out: Writer, body: np.ndarray) -> bytes:
    head = np.unpackbits(np.frombuffer(out.to_bytes(), np.uint8), bitorder="little")[: out.n]
    return wrap(np.packbits(np.concatenate([head, body]), bitorder="little").tobytes())


def put_palette(out: Writer, colours: np.ndarray) -> None:
    """The palette transform of at most 16 samples, given in ascending order."""
    out.put(1, 1)
    out.put(PALETTE, 2)
    out.put(len(colours) - 1, 8)
    out.put(0, 1)
    steps = np.diff(colours.astype(np.int64), prepend=0)
    green = code_lengths(np.bincount(steps, minlength=256 + GREEN_LENGTHS))
    alpha = code_lengths(np.bincount([255, *[0] * (len(colours) - 1)], minlength=256))
    lone = np.zeros(256, np.int64)
    lone[0] = 1
    for lengths in (green, lone, lone, alpha, lone[:DISTANCES]):
        out.put_prefix(lengths)
    for k, step in enumerate(steps.tolist()):
        for lengths, symbol in ((green, step), (alpha, 0 if k else 255)):
            if np.count_nonzero(lengths) > 1:
                out.put(int(canonical(lengths)[symbol]), int(lengths[symbol]))


def encode_samples(samples: np.ndarray) -> bytes:
    """A file whose green channel is ``samples`` [height, width] (8-bit); red and blue are 0, all is opaque.

    Repeats become back-references; up to 16 distinct samples become a palette,
    several to a pixel, where that is smaller.
    """
    height, width = samples.shape
    if not 0 < width <= MAX_SIDE or not 0 < height <= MAX_SIDE:
        raise ValueError("an image side is out of range")
    flat = samples.ravel()
    out = Writer()
    put_head(out, width, height)
    out.put(0, 1)
    file = _file(out, put_image(out, flat, True))
    colours = np.flatnonzero(np.bincount(flat, minlength=256))
    if len(colours) <= 16:
        share = palette_bits(len(colours))
        index = np.zeros((height, -(-width >> share) << share), np.int64)
        index[:, :width] = np.searchsorted(colours, samples)
        packed = (index.reshape(height, -1, 1 << share) << np.arange(0, 8, 8 >> share)).sum(-1).astype(np.uint8)
        out = Writer()
        put_head(out, width, height)
        put_palette(out, colours)
        out.put(0, 1)
        small = _file(out, put_image(out, packed.ravel(), True))
        file = min(file, small, key=len)
    return file
