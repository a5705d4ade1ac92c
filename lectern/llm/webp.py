"""Lossless WebP: reading and writing pixel arrays.

decode() reads prefix codes, back-references and the colour cache, then inverts the
predictor, cross-colour, subtract-green and palette transforms. encode() writes the same
features. Pixels are numpy arrays of height x width x (alpha, red, green, blue).
"""

from __future__ import annotations

import functools
import heapq
import struct

import numpy as np

# Fixed values of the format: the order of code length codes, and the plane offsets of distance codes 1 to 120.
LENGTH_ORDER = [17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15]
PLANE = [
    (0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1), (2, 2), (-2, 2), (0, 3), (3, 0), (1, 3), (-1, 3),
    (3, 1), (-3, 1), (2, 3), (-2, 3), (3, 2), (-3, 2), (0, 4), (4, 0), (1, 4), (-1, 4), (4, 1), (-4, 1), (3, 3), (-3, 3), (2, 4), (-2, 4),
    (4, 2), (-4, 2), (0, 5), (3, 4), (-3, 4), (4, 3), (-4, 3), (5, 0), (1, 5), (-1, 5), (5, 1), (-5, 1), (2, 5), (-2, 5), (5, 2), (-5, 2),
    (4, 4), (-4, 4), (3, 5), (-3, 5), (5, 3), (-5, 3), (0, 6), (6, 0), (1, 6), (-1, 6), (6, 1), (-6, 1), (2, 6), (-2, 6), (6, 2), (-6, 2),
    (4, 5), (-4, 5), (5, 4), (-5, 4), (3, 6), (-3, 6), (6, 3), (-6, 3), (0, 7), (7, 0), (1, 7), (-1, 7), (5, 5), (-5, 5), (7, 1), (-7, 1),
    (4, 6), (-4, 6), (6, 4), (-6, 4), (2, 7), (-2, 7), (7, 2), (-7, 2), (3, 7), (-3, 7), (7, 3), (-7, 3), (5, 6), (-5, 6), (6, 5), (-6, 5),
    (8, 0), (4, 7), (-4, 7), (7, 4), (-7, 4), (8, 1), (8, 2), (6, 6), (-6, 6), (8, 3), (5, 7), (-5, 7), (7, 5), (-7, 5), (8, 4), (6, 7),
    (-6, 7), (7, 6), (-7, 6), (8, 5), (7, 7), (-7, 7), (8, 6), (8, 7),
]
PREDICTOR, CROSS, GREEN, PALETTE = range(4)
GREENS, DISTANCES, HASH = 256 + 24, 40, 0x1E35A7BD
_C1 = np.uint64(0x9E3779B97F4A7C15)
BLACK = np.array([255, 0, 0, 0], dtype=np.uint8)


# --- prefix codes -----------------------------------------------------------


def code_lengths(freq: list[int], limit: int) -> list[int]:
    """Huffman code lengths of at most limit bits; one used symbol has length 1."""
    used = [i for i, f in enumerate(freq) if f]
    out = [0] * len(freq)
    if len(used) <= 1:
        for i in used:
            out[i] = 1
        return out
    least = 1
    while True:
        heap = [(max(freq[i], least), k, (i,)) for k, i in enumerate(used)]
        heapq.heapify(heap)
        depth, k = dict.fromkeys(used, 0), len(used)
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            for i in (both := a[2] + b[2]):
                depth[i] += 1
            heapq.heappush(heap, (a[0] + b[0], k, both))
            k += 1
        if max(depth.values()) <= limit:
            for i, d in depth.items():
                out[i] = d
            return out
        least = 2 * max(least, sum(freq) >> limit)


def codes(lengths: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (bits in reading order, number of bits) of the canonical code; a lone symbol takes no bits."""
    used = sorted((n, i) for i, n in enumerate(lengths) if n)
    if len(used) == 1:
        return {used[0][1]: (0, 0)}
    out, code, last = {}, 0, 0
    for n, i in used:
        code <<= n - last
        out[i] = (int(f"{code:0{n}b}"[::-1], 2), n)
        code, last = code + 1, n
    return out


def lookup(lengths: list[int]) -> tuple[np.ndarray, int]:
    """Table over the next bits: symbol << 4 | number of bits; and how many bits it looks at."""
    table = codes(lengths)
    most = max((n for _, n in table.values()), default=0)
    if table and most and sum(1 << (most - n) for _, n in table.values()) != 1 << most or not table:
        raise ValueError("not a complete prefix code")
    out = np.zeros(1 << most, dtype=np.int32)
    for i, (bits, n) in table.items():
        out[bits :: 1 << n] = i << 4 | n
    return out, most


# --- reading ----------------------------------------------------------------


class Bits:
    """Bits of the stream, least significant first."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        return int.from_bytes(self.data[self.at >> 3 : (self.at >> 3) + 5], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        v = self.peek() & ((1 << n) - 1)
        self.at += n
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return v

    def symbol(self, code: tuple[list[int], int]) -> int:
        v = code[0][self.peek() & ((1 << code[1]) - 1)]
        self.at += v & 15
        if self.at > self.end:
            raise ValueError("the stream ends early")
        return v >> 4


def _read_code(bits: Bits, size: int) -> tuple[list[int], int, np.ndarray]:
    lengths = [0] * size
    if bits.take(1):
        two, wide = bits.take(1), bits.take(1)
        lengths[bits.take(8 if wide else 1)] = 1
        if two:
            lengths[bits.take(8)] = 1
    else:
        of = [0] * 19
        for i in LENGTH_ORDER[: 4 + bits.take(4)]:
            of[i] = bits.take(3)
        table, n = lookup(of)
        code = (table.tolist(), n)
        left = 2 + bits.take(2 + 2 * bits.take(3)) if bits.take(1) else size
        i, last = 0, 8
        while i < size and left:
            left -= 1
            s = bits.symbol(code)
            if s < 16:
                lengths[i] = s
                last = s or last
                i += 1
            else:
                n = 3 + bits.take(2) if s == 16 else 3 + bits.take(3) if s == 17 else 11 + bits.take(7)
                if s == 16:
                    lengths[i : i + n] = [last] * n
                i += n
        lengths = lengths[:size]
    table, n = lookup(lengths)
    return table.tolist(), n, table


def _extra(bits: Bits, p: int) -> int:
    if p < 4:
        return p + 1
    n = (p - 2) >> 1
    return ((2 + (p & 1)) << n) + bits.take(n) + 1


_EIGHT, _PLACES = np.arange(8), np.arange(8 << 16)


def _literal_run(bits: Bits, code: tuple[list[int], int, np.ndarray], total: int) -> np.ndarray:
    """Green symbols of up to total pixels whose other channels take no bits, until a symbol is no literal.

    The table is looked up at every bit position of a stretch at once; a walk then follows the code's lengths.
    """
    _, most, table = code
    out: list[np.ndarray] = []
    n = 0
    if not most:
        return np.full(total, table[0] >> 4) if table[0] >> 4 < 256 else np.empty(0, dtype=np.int32)
    data, stretch = np.frombuffer(bits.data, dtype=np.uint8), 1 << 16
    while n < total:
        first = bits.at >> 3
        part = data[first : first + stretch + 2].astype(np.int64)
        words = part[:-2] | part[1:-1] << 8 | part[2:] << 16
        step = table.take(((words[:, None] >> _EIGHT) & ((1 << most) - 1)).ravel())
        end = len(step)
        # The place after one code, and by doubling after two and four; the walk takes four codes a step.
        one = np.full(end + 1, end, dtype=np.int64)
        np.minimum(_PLACES[:end] + (step & 15), end, out=one[:-1])
        two = one.take(one)
        four, pos, heads = memoryview(two.take(two)), bits.at & 7, []
        while pos < end:
            heads.append(pos)
            pos = four[pos]
        walk = np.empty((len(heads), 4), dtype=np.int64)
        walk[:, 0] = heads
        walk[:, 2] = two.take(walk[:, 0])
        walk[:, 1::2] = one.take(walk[:, 0::2])
        walk = walk.ravel()
        found = step[walk[walk < end]][: total - n]
        other = np.flatnonzero(found >= 4096)
        found = found[: other[0]] if len(other) else found
        out.append(found >> 4)
        n += len(found)
        bits.at += int((found & 15).sum())
        if bits.at > bits.end:
            raise ValueError("the stream ends early")
        if len(other) or not len(found):
            break
    return np.concatenate(out) if out else np.empty(0, dtype=np.int32)


def _read_image(bits: Bits, width: int, height: int, main: bool) -> np.ndarray:
    """An entropy-coded image as 32-bit ARGB numbers."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    meta, shift = None, 0
    if main and bits.take(1):
        shift = bits.take(3) + 2
        across = -(-width >> shift)
        across = (width + (1 << shift) - 1) >> shift
        meta = (_read_image(bits, across, (height + (1 << shift) - 1) >> shift, False) >> 8 & 0xFFFF).tolist()
    groups = [[_read_code(bits, n) for n in (GREENS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)] for _ in range(max(meta) + 1 if meta else 1)]
    total = width * height
    out = np.zeros(total, dtype=np.uint32)
    n = 0
    green, red, blue, alpha, far = groups[0]
    if meta is None and not cache_bits and not (red[1] or blue[1] or alpha[1]):
        run = _literal_run(bits, green, total)
        n = len(run)
        out[:n] = run.astype(np.uint32) << 8 | np.uint32((alpha[0][0] >> 4) << 24 | (red[0][0] >> 4) << 16 | blue[0][0] >> 4)
    if n == total:
        return out
    cache = [0] * (1 << cache_bits) if cache_bits else None
    px = out[:n].tolist()
    inserted = n
    while len(px) < total:
        n = len(px)
        if meta is not None:
            green, red, blue, alpha, far = groups[meta[((n // width) >> shift) * across + ((n % width) >> shift)]]
        s = bits.symbol(green)
        if s < 256:
            r = bits.symbol(red)
            b = bits.symbol(blue)
            px.append(bits.symbol(alpha) << 24 | r << 16 | s << 8 | b)
        elif s < GREENS:
            length = _extra(bits, s - 256)
            d = _extra(bits, bits.symbol(far))
            if d > 120:
                d -= 120
            else:
                x, y = PLANE[d - 1]
                d = max(1, x + y * width)
            if d > n or n + length > total:
                raise ValueError("a back-reference leaves the image")
            while length:  # a copy that reaches into itself repeats what is there
                part = px[n - d : n - d + length]
                px += part
                length -= len(part)
        else:
            if cache is None:
                raise ValueError("no colour cache")
            for v in px[inserted:]:
                cache[(HASH * v & 0xFFFFFFFF) >> (32 - cache_bits)] = v
            inserted = n
            px.append(cache[s - GREENS])
    return np.array(px, dtype=np.uint32)


def channels(argb: np.ndarray) -> np.ndarray:
    return np.stack([argb >> s & 255 for s in (24, 16, 8, 0)], axis=-1).astype(np.uint8)


def numbers(px: np.ndarray) -> np.ndarray:
    p = px.astype(np.uint32)
    return p[..., 0] << 24 | p[..., 1] << 16 | p[..., 2] << 8 | p[..., 3]


def _clamp(v: int) -> int:
    return 0 if v < 0 else 255 if v > 255 else v


def _predict(mode: int, left: list, top: list, top_right: list, top_left: list) -> list:
    mean = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    if mode == 0 or mode > 13:
        return [255, 0, 0, 0]
    if mode < 5:
        return (left, top, top_right, top_left)[mode - 1]
    if mode == 5:
        return mean(mean(left, top_right), top)
    if mode in (6, 7, 8, 9):
        return mean(*{6: (left, top_left), 7: (left, top), 8: (top_left, top), 9: (top, top_right)}[mode])
    if mode == 10:
        return mean(mean(left, top_left), mean(top, top_right))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [_clamp(a + b - c) for a, b, c in zip(left, top, top_left, strict=True)]
    return [_clamp(m + int((m - c) / 2)) for m, c in zip(mean(left, top), top_left, strict=True)]


def predictor(px: np.ndarray, modes: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """Adds (inverse) or subtracts each pixel's prediction. The first row predicts from the left, the first column from above."""
    h, w = px.shape[:2]
    src, out = px.tolist(), []
    known = out if inverse else src  # predictions come from original pixels
    for y in range(h):
        row: list = []
        out.append(row)
        for x in range(w):
            here = known[y]
            if not (x or y):
                p = [255, 0, 0, 0]
            elif not y:
                p = here[x - 1]
            elif not x:
                p = known[y - 1][0]
            else:
                above = known[y - 1]
                p = _predict(int(modes[y >> shift, x >> shift]), here[x - 1], above[x], above[x + 1] if x + 1 < w else here[0], above[x - 1])
            sign = 1 if inverse else -1
            row.append([(v + sign * q) & 255 for v, q in zip(src[y][x], p, strict=True)])
    return np.array(out, dtype=np.uint8)


def cross_colour(px: np.ndarray, elements: np.ndarray, shift: int, inverse: bool) -> np.ndarray:
    """elements: per block alpha, red to blue, green to blue, green to red, as the block image stores them."""
    h, w = px.shape[:2]
    e = np.repeat(np.repeat(elements, 1 << shift, axis=0), 1 << shift, axis=1)[:h, :w].astype(np.int8).astype(np.int32)
    signed = px.astype(np.int8).astype(np.int32)
    red, blue = px[..., 1].astype(np.int32), px[..., 3].astype(np.int32)
    sign = 1 if inverse else -1
    new_red = (red + sign * (e[..., 3] * signed[..., 2] >> 5)) & 255
    true_red = (new_red if inverse else red).astype(np.uint8).astype(np.int8).astype(np.int32)
    new_blue = (blue + sign * ((e[..., 2] * signed[..., 2] >> 5) + (e[..., 1] * true_red >> 5))) & 255
    return np.stack([px[..., 0], new_red, px[..., 2], new_blue], axis=-1).astype(np.uint8)


def green_shift(px: np.ndarray, inverse: bool) -> np.ndarray:
    out = px.copy()
    for c in (1, 3):
        out[..., c] = px[..., c] + px[..., 2] if inverse else px[..., c] - px[..., 2]
    return out


def bundle_bits(colours: int) -> int:
    return 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0


def unbundle(green: np.ndarray, width: int, bits: int) -> np.ndarray:
    """Palette indices of a row's pixels, several in one green value, the first in the lowest bits."""
    if not bits:
        return green
    each = 8 >> bits
    spread = green[..., None] >> (np.arange(1 << bits) * each) & ((1 << each) - 1)
    return spread.reshape(len(green), -1)[:, :width]


def vp8l(data: bytes) -> bytes:
    """The image stream of a RIFF file."""
    return chunks(data)[b"VP8L"]


def chunks(data: bytes) -> dict[bytes, bytes]:
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    out, at = {}, 12
    while at + 8 <= len(data):
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        out[data[at : at + 4]] = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    return out


def decode(data: bytes, as_numbers: bool = False) -> np.ndarray:
    """Pixels of a lossless WebP file, or their 32-bit ARGB numbers."""
    bits = Bits(vp8l(data))
    if bits.take(8) != 0x2F:
        raise ValueError("not a lossless image")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    opaque = not bits.take(1)
    if bits.take(3):
        raise ValueError("unknown version")
    steps, across = [], width
    while bits.take(1):
        kind = bits.take(2)
        if kind in (PREDICTOR, CROSS):
            shift = bits.take(3) + 2
            w, h = (across + (1 << shift) - 1) >> shift, (height + (1 << shift) - 1) >> shift
            steps.append((kind, shift, channels(_read_image(bits, w, h, False).reshape(h, w)), across))
        elif kind == PALETTE:
            n = bits.take(8) + 1
            table = np.cumsum(channels(_read_image(bits, n, 1, False)).astype(np.int64), axis=0).astype(np.uint8)
            steps.append((kind, bundle_bits(n), table, across))
            across = (across + (1 << bundle_bits(n)) - 1) >> bundle_bits(n)
        else:
            steps.append((kind, 0, None, across))
    argb = _read_image(bits, across, height, True).reshape(height, across)
    if steps and steps[-1][0] == PALETTE:
        _, k, table, w = steps.pop()
        full = np.zeros(256, dtype=np.uint32)
        full[: len(table)] = numbers(table)
        argb = full[unbundle(argb >> 8 & 255, w, k)]
    if opaque:
        argb = argb | np.uint32(0xFF000000) if not steps else argb
    if as_numbers and not steps:
        return argb
    px = channels(argb)
    for kind, k, table, w in reversed(steps):
        if kind == PREDICTOR:
            px = predictor(px, table[..., 2], k, True)
        elif kind == CROSS:
            px = cross_colour(px, table, k, True)
        elif kind == GREEN:
            px = green_shift(px, True)
        else:
            full = np.zeros((256, 4), dtype=np.uint8)
            full[: len(table)] = table
            px = full[unbundle(px[..., 2], w, k)]
    if opaque:
        px[..., 0] = 255
    return numbers(px) if as_numbers else px


# --- writing ----------------------------------------------------------------


class Out:
    def __init__(self):
        self.value, self.n, self.parts = 0, 0, []

    def put(self, v: int, n: int) -> None:
        self.value |= v << self.n
        self.n += n

    def stream(self, bits: np.ndarray) -> None:
        """Many bits at once (0 and 1 in writing order)."""
        self.parts.append(np.unpackbits(np.frombuffer(self.value.to_bytes(self.n + 7 >> 3, "little"), np.uint8), bitorder="little")[: self.n])
        self.parts.append(bits)
        self.value = self.n = 0

    def codes(self, code: np.ndarray, size: np.ndarray) -> None:
        """Many codes of up to 15 bits at once: those that begin in one 32-bit word are summed there, and what passes its end goes to the next word."""
        end = np.cumsum(size)
        at = end - size
        word = at >> 5
        wide = code << (at & 31).astype(np.uint64)
        first = np.flatnonzero(np.diff(word, prepend=-1))
        total = np.add.reduceat(wide, first) if len(first) else np.empty(0, np.uint64)
        words = np.zeros(int(end[-1] if len(end) else 0) // 32 + 2, dtype=np.uint64)
        words[word[first]] = total & np.uint64(0xFFFFFFFF)
        words[word[first] + 1] |= total >> np.uint64(32)
        self.stream(np.unpackbits(words.astype("<u4").view(np.uint8), bitorder="little")[: int(end[-1]) if len(end) else 0])

    def bytes(self) -> bytes:
        self.stream(np.empty(0, np.uint8))
        return np.packbits(np.concatenate(self.parts), bitorder="little").tobytes()


def _put_code(out: Out, lengths: list[int]) -> None:
    used = [i for i, n in enumerate(lengths) if n]
    if not used or (len(used) <= 2 and used[-1] < 256):
        used = used or [0]
        out.put(1, 1)
        out.put(len(used) - 1, 1)
        out.put(1, 1)
        for i in used:
            out.put(i, 8)
        return
    out.put(0, 1)
    tokens: list[tuple[int, int, int]] = []  # symbol, extra, extra bits
    i, last = 0, used[-1] + 1
    while i < last:
        j = i
        while j < last and lengths[j] == lengths[i]:
            j += 1
        n = j - i
        if not lengths[i]:
            while n:
                if n < 3:
                    tokens += [(0, 0, 0)] * n
                    break
                step = min(n, 138)
                tokens.append((17, step - 3, 3) if step < 11 else (18, step - 11, 7))
                n -= step
        else:
            tokens.append((lengths[i], 0, 0))
            n -= 1
            while n >= 3:
                step = min(n, 6)
                tokens.append((16, step - 3, 2))
                n -= step
            tokens += [(lengths[i], 0, 0)] * n
        i = j
    freq = [0] * 19
    for s, _, _ in tokens:
        freq[s] += 1
    of = code_lengths(freq, 7)
    most = max(4, max(k + 1 for k, s in enumerate(LENGTH_ORDER) if of[s]))
    out.put(most - 4, 4)
    for s in LENGTH_ORDER[:most]:
        out.put(of[s], 3)
    if len(tokens) < 2:
        out.put(0, 1)
    else:
        out.put(1, 1)
        n = max(2, (len(tokens) - 2).bit_length() + 1 & ~1)
        out.put((n - 2) // 2, 3)
        out.put(len(tokens) - 2, n)
    table = codes(of)
    for s, extra, n in tokens:
        out.put(*table[s])
        out.put(extra, n)


def prefix(v: int) -> tuple[int, int, int]:
    """Prefix code, extra value and extra bits of a length or distance from 1."""
    v -= 1
    if v < 4:
        return v, 0, 0
    n = v.bit_length() - 2
    return 2 * (n + 1) + (v >> n & 1), v & ((1 << n) - 1), n


def _tokens(argb: list[int], cache_bits: int, copies: bool) -> list[tuple]:
    """('lit', colour), ('copy', length, distance) and ('cache', index): greedy matches of the last place with the same next pixels."""
    out, seen, i, n = [], {}, 0, len(argb)
    cache: dict[int, int] = {}
    each = np.array(argb, dtype=np.uint64)
    keys = ((each[:-2] * _C1 + each[1:-1]) * _C1 + each[2:]).tolist() + [-1, -2] if n > 2 else [-1] * n
    while i < n:
        length = far = 0
        if copies and keys[i] in seen:
            far = i - seen[keys[i]]
            step, most = 1, min(n - i, 4096)
            while length < most and argb[i + length : i + length + step] == argb[i + length - far : i + length - far + step] and length + step <= most:
                length += step
                step *= 2
            while step:
                if length + step <= most and argb[i + length : i + length + step] == argb[i + length - far : i + length - far + step]:
                    length += step
                step //= 2
        place = (HASH * argb[i] & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else 0
        if length >= 3:
            out.append(("copy", length, far))
        elif cache_bits and cache.get(place) == argb[i]:
            out.append(("cache", place))
            length = 1
        else:
            out.append(("lit", argb[i]))
            length = 1
        if copies:
            seen.update(zip(keys[i : i + length], range(i, i + length)))
        if cache_bits:
            for j in range(i, i + length):
                cache[(HASH * argb[j] & 0xFFFFFFFF) >> (32 - cache_bits)] = argb[j]
        i += length
    return out


@functools.cache
def _near(width: int) -> dict[int, int]:
    """The first distance code of each distance that has one of the plane's."""
    out: dict[int, int] = {}
    for k, (x, y) in enumerate(PLANE):
        out.setdefault(x + y * width, k + 1)
    return out


def _put_image(out: Out, argb: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = False, groups: np.ndarray | None = None, shift: int = 4) -> None:
    """groups: the prefix code group of each block of 1 << shift pixels, or None for one."""
    out.put(bool(cache_bits), 1)
    if cache_bits:
        out.put(cache_bits, 4)
    if main:
        out.put(groups is not None, 1)
        if groups is not None:
            out.put(shift - 2, 3)
            _put_image(out, (groups.astype(np.uint32) << 8).ravel(), groups.shape[1], False)
    plain = argb & np.uint32(0xFFFF00FF)
    if groups is None and not cache_bits and not copies and len(argb) and (plain == plain[0]).all():
        green = (argb >> 8 & 255).astype(np.int64)
        lengths = code_lengths([*np.bincount(green, minlength=256).tolist(), *[0] * 24], 15)
        _put_code(out, lengths)
        for s in (16, 0, 24):
            of = [0] * 256
            of[int(plain[0]) >> s & 255] = 1
            _put_code(out, of)
        _put_code(out, [0] * DISTANCES)
        table = codes(lengths)
        code, size = np.zeros(256, dtype=np.uint64), np.zeros(256, dtype=np.int64)
        for i, (b, n) in table.items():
            code[i], size[i] = b, n
        for i in range(0, len(green), 1 << 20):
            part = green[i : i + (1 << 20)]
            out.codes(code[part], size[part])
        return
    tokens = _tokens(argb.tolist(), cache_bits, copies)
    count = int(groups.max()) + 1 if groups is not None else 1
    sizes = (GREENS + (1 << cache_bits if cache_bits else 0), 256, 256, 256, DISTANCES)
    freq = [[[0] * n for n in sizes] for _ in range(count)]
    plan, at, near = [], 0, _near(width)
    for t in tokens:
        g = int(groups[(at // width) >> shift, (at % width) >> shift]) if groups is not None else 0
        if t[0] == "lit":
            parts = [(0, t[1] >> 8 & 255, 0, 0), (1, t[1] >> 16 & 255, 0, 0), (2, t[1] & 255, 0, 0), (3, t[1] >> 24, 0, 0)]
            at += 1
        elif t[0] == "cache":
            parts = [(0, GREENS + t[1], 0, 0)]
            at += 1
        else:
            p, d = prefix(t[1]), near.get(t[2], t[2] + 120)
            q = prefix(d)
            parts = [(0, 256 + p[0], *p[1:]), (4, *q)]
            at += t[1]
        plan.append((g, parts))
        for k, s, _, _ in parts:
            freq[g][k][s] += 1
    tables = []
    for f in freq:
        lengths = [code_lengths(x, 15) for x in f]
        for x in lengths:
            _put_code(out, x)
        tables.append([codes(x) for x in lengths])
    for g, parts in plan:
        for k, s, extra, n in parts:
            out.put(*tables[g][k][s])
            out.put(extra, n)
        if out.n > 4096:
            out.stream(np.empty(0, np.uint8))


def encode(px: np.ndarray | None, palette: bool = False, predict: np.ndarray | None = None, cross: np.ndarray | None = None, subtract: bool = False, shift: int = 3, cache_bits: int = 0, copies: bool = False, groups: np.ndarray | None = None, more: dict[bytes, bytes] | None = None, argb: np.ndarray | None = None) -> bytes:
    """A lossless WebP file of pixels, or of their numbers argb. predict: a mode for each block; cross: elements for each block; groups: a prefix code group for each block of 16 x 16; more: further chunks."""
    if px is None and (predict is not None or cross is not None or subtract):
        px = channels(argb)
    h, w = (px if px is not None else argb).shape[:2]
    out = Out()
    clear = (px[..., 0] != 255).any() if px is not None else (argb < 0xFF000000).any()
    for v, n in ((0x2F, 8), (w - 1, 14), (h - 1, 14), (int(clear), 1), (0, 3)):
        out.put(v, n)
    if predict is not None:
        out.put(1 | PREDICTOR << 1 | (shift - 2) << 3, 6)
        _put_image(out, 0xFF000000 | predict.astype(np.uint32).ravel() << 8, predict.shape[1], False)
        px = predictor(px, predict, shift, False)
    if cross is not None:
        out.put(1 | CROSS << 1 | (shift - 2) << 3, 6)
        _put_image(out, numbers(cross).ravel(), cross.shape[1], False)
        px = cross_colour(px, cross, shift, False)
    if subtract:
        out.put(1 | GREEN << 1, 3)
        px = green_shift(px, False)
    argb, across = numbers(px) if px is not None else argb, w
    if palette:
        flat = argb.ravel()
        if len(flat) and ((flat ^ flat[0]) & np.uint32(0xFFFF00FF)).any():
            colours, index = np.unique(flat, return_inverse=True)
        else:  # they differ in green alone
            green = flat >> np.uint32(8) & np.uint32(255)
            used = np.flatnonzero(np.bincount(green, minlength=256))
            colours, place = flat[0] & np.uint32(0xFFFF00FF) | used.astype(np.uint32) << np.uint32(8), np.zeros(256, dtype=np.uint32)
            place[used] = np.arange(len(used))
            index = place[green]
        if len(colours) > 256:
            raise ValueError("more than 256 colours")
        out.put(1 | PALETTE << 1, 3)
        out.put(len(colours) - 1, 8)
        table = channels(colours)
        _put_image(out, numbers(np.diff(table, axis=0, prepend=np.zeros((1, 4), np.uint8))), len(colours), False)
        bits = bundle_bits(len(colours))
        across = (w + (1 << bits) - 1) >> bits
        grid = np.zeros((h, across << bits), dtype=np.uint32)
        grid[:, :w] = index.reshape(h, w)
        argb = grid << np.uint32(8) | np.uint32(0xFF000000) if not bits else (grid.reshape(h, across, 1 << bits) << (np.arange(1 << bits, dtype=np.uint32) * np.uint32(8 >> bits))).sum(axis=2).astype(np.uint32) << np.uint32(8) | np.uint32(0xFF000000)
    out.put(0, 1)
    _put_image(out, argb.ravel(), across, True, cache_bits, copies, groups)
    body = b"WEBP"
    for name, data in {b"VP8L": out.bytes(), **(more or {})}.items():
        body += name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", len(body)) + body
