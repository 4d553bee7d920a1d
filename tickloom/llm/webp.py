"""Lossless WebP: decode and encode pixel arrays in batches, many images in step.

The decoder reads prefix codes, back-references and the colour cache, and
inverts the predictor, cross-colour, subtract-green and palette transforms.
Images are independent streams, so a batch decodes one symbol of every image at
a time with array operations.  Each image is a generator that asks for code
lengths or for pixels; ``decode`` answers all images that wait for the same.
"""

from __future__ import annotations

import struct
from collections.abc import Generator
from dataclasses import dataclass, field

import numpy as np

LITERALS, LENGTHS, DISTANCES = 256, 24, 40
PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE = range(4)
# Fixed value of the format: the order in which code-length code lengths are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
TOP = 15
# Codes of up to this length are looked up in one step; those that are written here are no longer.
QUICK = 9
LONGER = 0xFFFF
# Steps between looks whether a stream has run out; zeros for as many follow the data.
EVERY = 32
HASH = 0x1E35A7BD
BLACK = 0xFF000000
THREE = np.arange(3, dtype=np.uint16) << 8
REVERSED = np.array([int(f"{i:015b}"[::-1], 2) for i in range(1 << TOP)], np.int64)
SEVEN = [int(f"{i:07b}"[::-1], 2) for i in range(1 << 7)]
# Short distance codes: neighbours by nearness, then |x|, then right before left.
LOW = np.uint64((1 << TOP) - 1)
LOW_QUICK = np.uint64((1 << QUICK) - 1)
REVERSED_QUICK = REVERSED[: 1 << QUICK] >> TOP - QUICK
NEIGHBOURS = sorted(
    ((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), p[0] < 0)
)


# ---------------------------------------------------------- prefix codes


def code_lengths(counts: np.ndarray, most: int = TOP) -> np.ndarray:
    """Lengths of a complete prefix code for symbols that occur, none over ``most``.

    Starts from rounded-up information contents and shortens frequent symbols
    until the code is complete.  A lone symbol has length 1.
    """
    out = np.zeros(len(counts), np.int64)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        out[used] = 1
        return out
    used = used[np.argsort(-counts[used], kind="stable")]
    c = counts[used].tolist()
    total = sum(c)
    # The least s with c << s at or over the total is the rounded-up information content.
    size = [min(max((-(-total // x) - 1).bit_length(), 1), most) for x in c]
    room = (1 << most) - sum([1 << most - s for s in size])
    i = len(size) - 1
    while room < 0:
        while size[i] == most:
            i -= 1
        size[i] += 1
        room += 1 << most - size[i]
    while room:
        for i, s in enumerate(size):
            if (unit := 1 << most - s) <= room:
                size[i] -= 1
                room -= unit
                if not room:
                    break
    out[used] = size
    return out


def codes_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bits as written, first bit lowest; number of bits) by symbol; a lone symbol takes no bits."""
    code, size = np.zeros(len(lengths), np.uint64), lengths.copy()
    used = np.flatnonzero(lengths)
    if len(used) < 2:
        return code, np.zeros_like(size)
    order = used[np.argsort(lengths[used], kind="stable")]
    n = lengths[order]
    left = np.concatenate([[0], np.cumsum(1 << (TOP - n))[:-1]])  # codes, left-justified
    code[order] = REVERSED[left]
    return code, size


@dataclass
class Tables:
    """Canonical codes of several groups, for lookups over many of them at once."""

    bound: np.ndarray  # g x 16: left-justified end of the codes up to each length; the last is never reached
    start: np.ndarray  # g * 16: where a length's symbols start, less its first code
    symbols: np.ndarray
    quick: np.ndarray | None = None  # g << QUICK: symbol | bits used << 12 by the next bits as they come, or LONGER
    longest: int = TOP
    searched: bool = True  # some codes are not in ``quick``

    @classmethod
    def of(cls, lengths: list[np.ndarray], quick: bool = False) -> Tables:
        size = max(map(len, lengths))
        all_ = np.zeros((len(lengths), size), np.int64)
        for row, x in zip(all_, lengths):
            row[: len(x)] = x
        count = np.zeros((len(lengths), TOP + 1), np.int64)
        np.add.at(count, (np.repeat(np.arange(len(lengths)), size), all_.ravel()), 1)
        count[:, 0] = 0
        lone = count.sum(1) == 1
        room = (count[:, 1:] << (TOP - np.arange(1, TOP + 1))).sum(1)
        if ((room != 1 << TOP) & ~lone).any():
            raise ValueError("prefix code is not complete")
        order = np.argsort(np.where(all_ == 0, TOP + 1, all_), axis=1, kind="stable")
        end = np.cumsum(count << (TOP - np.arange(TOP + 1)), axis=1)
        first = (end - (count << (TOP - np.arange(TOP + 1)))) >> (TOP - np.arange(TOP + 1))
        before = np.cumsum(count, axis=1) - count
        start = before - first + np.arange(len(lengths))[:, None] * size
        bound = end.copy()
        bound[lone], start[lone] = 1 << TOP, (np.arange(len(lengths)) * size)[lone, None]
        bound[:, TOP] = 0xFFFF
        if not quick:
            return cls(bound.astype(np.uint16), start.ravel(), order.ravel())
        n = np.take_along_axis(all_, order, axis=1)
        share = np.where((n > 0) & (n <= QUICK), 1 << np.maximum(QUICK - n, 0), 0)
        share[lone, 0], n[lone, 0] = 1 << QUICK, 0
        share = np.column_stack([share, (1 << QUICK) - share.sum(1)])
        entry = np.column_stack([order | n << 12, np.full(len(lengths), LONGER)]).astype(np.uint16)
        table = np.repeat(entry.ravel(), share.ravel()).reshape(len(lengths), -1)[:, REVERSED_QUICK]
        longest = int(all_.max())
        return cls(bound.astype(np.uint16), start.ravel(), order.ravel(), table.ravel(), longest, longest > QUICK)

    def read(self, group: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, bits used) for the next bits of each stream."""
        if self.quick is None:
            return self._search(group, window)
        return self.look(group, group << QUICK, window)

    def look(self, group: np.ndarray, first: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``read`` where ``first`` is the place of each group in ``quick``."""
        e = self.quick.take((window & LOW_QUICK).view(np.int64) + first)
        symbol, n = e & 0xFFF, e >> 12
        if self.searched and (i := np.flatnonzero(e == LONGER)).size:
            symbol[i], n[i] = self._search(group[i], window[i])
        return symbol, n

    def _search(self, group: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        r = REVERSED[(window & LOW).view(np.int64)]
        # One byte for each length that is too short, eight counted at once.
        short = np.bitwise_count((r.astype(np.uint16)[:, None] >= self.bound.take(group, axis=0)).view(np.uint64))
        n = short[:, 0].astype(np.int64) + short[:, 1]
        return self.symbols.take(self.start.take(group * 16 + n) + (r >> (TOP - n))), n


# --------------------------------------------------------------- decoding


class Stream:
    """Bits of one image, lowest first."""

    def __init__(self, data: bytes, at: int) -> None:
        self.data, self.at = data, at

    def read(self, n: int) -> int:
        """The next ``n`` (at most 32) bits."""
        i = self.at >> 3
        v = int.from_bytes(self.data[i : i + 8], "little") >> (self.at & 7) & ((1 << n) - 1)
        self.at += n
        if self.at > 8 * len(self.data):
            raise ValueError("the stream ends too early")
        return v


@dataclass
class WantLengths:
    """Code lengths of ``size`` symbols, coded with ``code`` in at most ``tokens`` tokens."""

    stream: Stream
    code: np.ndarray
    size: int
    tokens: int


@dataclass
class WantPixels:
    stream: Stream
    width: int
    height: int
    cache_bits: int
    groups: list[list[np.ndarray]]
    main: bool  # the image itself, not a part of its header
    meta: np.ndarray | None = None  # group of each block
    meta_bits: int = 0
    blocks: int = 0
    out: np.ndarray = field(default=None, repr=False)


def _prefix_code(s: Stream, size: int) -> Generator:
    if s.read(1):
        two, wide = s.read(1), s.read(1)
        symbols = [s.read(8 if wide else 1)] + ([s.read(8)] if two else [])
        out = np.zeros(size, np.int64)
        out[symbols] = 1
        return out
    code = np.zeros(19, np.int64)
    for k in LENGTH_ORDER[: 4 + s.read(4)]:
        code[k] = s.read(3)
    tokens = size
    if s.read(1):
        tokens = 2 + s.read(2 + 2 * s.read(3))
        if tokens > size:
            raise ValueError("more code lengths than symbols")
    return (yield WantLengths(s, code, size, tokens))


def _pixels(s: Stream, width: int, height: int, main: bool) -> Generator:
    cache_bits = s.read(4) if s.read(1) else 0
    if cache_bits > 11:
        raise ValueError("colour cache too large")
    meta, bits, blocks, n = None, 0, 0, 1
    if main and s.read(1):
        bits = s.read(3) + 2
        blocks = -(-width >> bits)
        meta = ((yield from _pixels(s, blocks, -(-height >> bits), False)) >> np.uint32(8) & np.uint32(0xFFFF)).astype(np.int64)
        n = int(meta.max()) + 1
    groups = []
    for _ in range(n):
        sizes = (LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0), LITERALS, LITERALS, LITERALS, DISTANCES)
        codes = []
        for size in sizes:
            codes.append((yield from _prefix_code(s, size)))
        groups.append(codes)
    return (yield WantPixels(s, width, height, cache_bits, groups, main, meta, bits, blocks))


def _image(data: bytes) -> Generator:
    """One VP8L payload; returns (width, height, pixels as ARGB)."""
    s = Stream(data, 0)
    if s.read(8) != 0x2F:
        raise ValueError("no lossless stream")
    width, height, _alpha, version = s.read(14) + 1, s.read(14) + 1, s.read(1), s.read(3)
    if version:
        raise ValueError("unknown version")
    transforms, w = [], width
    while s.read(1):
        kind = s.read(2)
        if kind in (k for k, *_ in transforms):
            raise ValueError("a transform occurs twice")
        if kind in (PREDICTOR, CROSS_COLOUR):
            bits = s.read(3) + 2
            part = yield from _pixels(s, -(-w >> bits), -(-height >> bits), False)
            transforms.append((kind, w, bits, part))
        elif kind == PALETTE:
            n = s.read(8) + 1
            part = yield from _pixels(s, n, 1, False)
            table = np.cumsum(part.view(np.uint8).reshape(n, 4), axis=0, dtype=np.uint8)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            transforms.append((kind, w, pack, np.ascontiguousarray(table).view("<u4").ravel()))
            w = -(-w >> pack)
        else:
            transforms.append((kind, w, 0, None))
    px = yield from _pixels(s, w, height, True)
    for kind, w, bits, part in reversed(transforms):
        px = (unpredict, uncross, ungreen, unpalette)[kind](px, w, height, bits, part)
    return width, height, px


def vp8l(data: bytes) -> bytes:
    """The lossless payload of a WebP file, after whatever chunks come before it."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at = 12
    while at + 8 <= len(data):
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        if data[at : at + 4] == b"VP8L":
            return data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no lossless chunk")


def decode(files: list[bytes]) -> list[tuple[int, int, np.ndarray]]:
    """(width, height, ARGB pixels) of each file, all files in step."""
    out: list = [None] * len(files)
    runs = {i: _image(vp8l(f)) for i, f in enumerate(files)}
    answers: dict[int, object] = dict.fromkeys(runs)
    asked: dict[int, WantLengths | WantPixels] = {}
    while answers:
        for i, a in answers.items():
            try:
                asked[i] = runs[i].send(a)
            except StopIteration as e:
                out[i] = e.value
        # What is short goes first, so that the images themselves are all decoded in one pass.
        kinds: dict[int, list[int]] = {}
        for i, q in asked.items():
            kinds.setdefault(0 if isinstance(q, WantLengths) else 1 + q.main, []).append(i)
        if not kinds:
            break
        first = min(kinds)
        picks = {i: asked.pop(i) for i in kinds[first]}
        answers = dict(zip(picks, (read_pixels if first else read_lengths)(list(picks.values()))))
    return out


def _windows(streams: list[Stream]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit words at every byte, first bit of each stream) over the streams laid end to end."""
    data = b"".join([s.data for s in streams]) + bytes(16 * EVERY)
    base = np.cumsum([0] + [len(s.data) for s in streams[:-1]]) * 8
    words = np.ndarray((len(data) - 8,), "<u8", buffer=data, strides=(1,))
    return words, base


def read_lengths(asked: list[WantLengths]) -> list[np.ndarray]:
    """Decode the code lengths of every stream in step."""
    k = len(asked)
    words, base = _windows([q.stream for q in asked])
    pos = base + np.array([q.stream.at for q in asked])
    stop = base + np.array([8 * len(q.stream.data) for q in asked])
    t = Tables.of([q.code for q in asked])
    size, tokens = np.array([q.size for q in asked]), np.array([q.tokens for q in asked])
    out = np.zeros((k, int(size.max()) + 6), np.int64)
    at, last, act = np.zeros(k, np.int64), np.full(k, 8), np.arange(k)
    while len(act):
        p = pos[act]
        w = words[p >> 3] >> (p & 7).astype(np.uint64)
        sym, n = t.read(act, w)
        w = (w >> n.astype(np.uint64)).astype(np.int64)
        plain = sym < 16
        a = act[plain]
        out[a, at[a]] = sym[plain]
        last[a] = np.where(sym[plain] > 0, sym[plain], last[a])
        more = np.select([plain, sym == 16, sym == 17], [1, 3 + (w & 3), 3 + (w & 7)], 11 + (w & 127))
        pos[act] += n + np.select([plain, sym == 16, sym == 17], [0, 2, 3], 7)
        if (again := np.flatnonzero(sym == 16)).size:
            for j in again:
                i = act[j]
                out[i, at[i] : at[i] + more[j]] = last[i]
        at[act] += more
        tokens[act] -= 1
        if (at[act] > size[act]).any() or (pos[act] > stop[act]).any():
            raise ValueError("code lengths run over")
        act = act[(at[act] < size[act]) & (tokens[act] > 0)]
    for q, p, b in zip(asked, pos, base):
        q.stream.at = int(p - b)
    return [row[: q.size] for row, q in zip(out, asked)]


def _value(s: Stream, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    extra = symbol - 2 >> 1
    return (2 + (symbol & 1) << extra) + s.read(extra) + 1


def read_pixels(asked: list[WantPixels]) -> list[np.ndarray]:
    """Decode the pixels of every stream in step; a copy advances its stream by its length."""
    words, base = _windows([q.stream for q in asked])
    pos = base + np.array([q.stream.at for q in asked])
    stop = base + np.array([8 * len(q.stream.data) for q in asked])
    first_group = np.cumsum([0] + [len(q.groups) for q in asked[:-1]])
    codes: list[Tables] = []
    alike = [all(np.array_equal(g[c], g[1]) for q in asked for g in q.groups) for c in range(5)]
    for c in range(5):
        codes.append(codes[1] if c in (2, 3) and alike[c] else Tables.of([g[c] for q in asked for g in q.groups], c < 4))
    todo = np.array([q.width * q.height for q in asked])
    start = np.cumsum([0, *todo[:-1]])
    out = np.zeros(int(todo.sum()), "<u4")
    # A word holds 57 bits from any bit on: a pixel's four codes, unless they are longer.
    long = sum(t.longest for t in codes[:4]) > 57
    caches = [np.zeros(1 << q.cache_bits, np.uint32) if q.cache_bits else None for q in asked]
    cached = any(c is not None for c in caches)
    by_block = any(q.meta is not None for q in asked)
    done, act = np.zeros(len(asked), np.int64), np.flatnonzero(todo > 0)
    group, step = first_group.copy(), 0
    while len(act):
        if by_block:
            for i in act:
                q = asked[i]
                if q.meta is not None:
                    y, x = divmod(int(done[i]), q.width)
                    group[i] = first_group[i] + q.meta[(y >> q.meta_bits) * q.blocks + (x >> q.meta_bits)]
        p, g = pos[act], group[act]
        q = g << QUICK
        w = words[p >> 3] >> (p & 7).view(np.uint64)
        green, n = codes[0].look(g, q, w)
        p = p + n
        plain = green < LITERALS
        if not plain.all():
            for j in np.flatnonzero(~plain):
                i, s = int(act[j]), int(green[j])
                img, at = asked[i], int(start[i] + done[i])
                if s >= LITERALS + LENGTHS:
                    out[at], length = caches[i][s - LITERALS - LENGTHS], 1
                    img.stream.at = int(p[j] - base[i])
                else:
                    img.stream.at = int(p[j] - base[i])
                    length = _value(img.stream, s - LITERALS)
                    u = img.stream.at + int(base[i])
                    d, k = codes[4].read(g[j : j + 1], words[u >> 3 : (u >> 3) + 1] >> np.uint64(u & 7))
                    img.stream.at += int(k[0])
                    d = _value(img.stream, int(d[0]))
                    d = d - len(NEIGHBOURS) if d > len(NEIGHBOURS) else max(1, NEIGHBOURS[d - 1][0] + NEIGHBOURS[d - 1][1] * img.width)
                    if d > done[i] or length > todo[i] - done[i]:
                        raise ValueError("a copy leaves the image")
                    if d >= length:
                        out[at : at + length] = out[at - d : at - d + length]
                    else:
                        out[at : at + length] = np.resize(out[at - d : at], length)
                pos[i] = base[i] + img.stream.at
                if caches[i] is not None:
                    _remember(caches[i], img.cache_bits, out[at : at + length])
                done[i] += length
            a, p, g, q, green, w, n = act[plain], p[plain], g[plain], q[plain], green[plain], w[plain], n[plain]
        else:
            a = act
        if len(a):
            w = words[p >> 3] >> (p & 7).view(np.uint64) if long else w >> n
            red, n = codes[1].look(g, q, w)
            w = w >> n
            p = p + n
            if long:
                w = words[p >> 3] >> (p & 7).view(np.uint64)
            blue, n = codes[2].look(g, q, w)
            alpha, m = codes[3].look(g, q, w >> n)
            pos[a] = p + (n + m)
            four = np.empty((len(a), 4), np.uint8)
            four[:, 0], four[:, 1], four[:, 2], four[:, 3] = blue, green, red, alpha
            px = four.view("<u4")[:, 0]
            was = done[a]
            out[start[a] + was] = px
            if cached:
                for i, v in zip(a, px):
                    if caches[i] is not None:
                        _remember(caches[i], asked[i].cache_bits, np.array([v]))
            done[a] = was + 1
        left = done[act] < todo[act]
        step += 1
        if step % EVERY == 0 and (pos[act] > stop[act]).any():
            raise ValueError("the stream ends too early")
        if not left.all():
            ended = act[~left]
            if (pos[ended] > stop[ended]).any():
                raise ValueError("the stream ends too early")
            act = act[left]
    for q, p, b in zip(asked, pos, base):
        q.stream.at = int(p - b)
    return [out[s : s + n] for s, n in zip(start, todo)]


def _remember(cache: np.ndarray, bits: int, px: np.ndarray) -> None:
    """Colours enter the cache in order, the last of a slot stays."""
    for v in px.tolist():
        cache[(HASH * v & 0xFFFFFFFF) >> 32 - bits] = v


# -------------------------------------------------------------- transforms


def channels(px: np.ndarray) -> np.ndarray:
    """Blue, green, red, alpha of each pixel as signed numbers."""
    return px.astype("<u4").view(np.uint8).reshape(*px.shape, 4).astype(np.int32)


def packed(ch: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray((ch & 255).astype(np.uint8)).view("<u4")[..., 0].astype(np.uint32)


def _blocks(part: np.ndarray, width: int, height: int, bits: int) -> np.ndarray:
    """The block's value at every pixel."""
    n = -(-width >> bits)
    return part.reshape(-1, n)[np.arange(height)[:, None] >> bits, np.arange(width)[None, :] >> bits]


def predicted(mode: np.ndarray, left: np.ndarray, top: np.ndarray, tl: np.ndarray, tr: np.ndarray) -> np.ndarray:
    """The prediction of each pixel from its neighbours (n x 4) by its mode."""
    mean = lambda a, b: a + b >> 1
    black = np.broadcast_to(np.array([0, 0, 0, 255], np.int32), left.shape)
    closer = (np.abs(top - tl).sum(-1) < np.abs(left - tl).sum(-1))[..., None]
    half = mean(left, top)
    step = half - tl
    rules = {
        1: lambda: left, 2: lambda: top, 3: lambda: tr, 4: lambda: tl, 5: lambda: mean(mean(left, tr), top), 6: lambda: mean(left, tl),
        7: lambda: half, 8: lambda: mean(tl, top), 9: lambda: mean(top, tr), 10: lambda: mean(mean(left, tl), mean(top, tr)),
        11: lambda: np.where(closer, left, top), 12: lambda: np.clip(left + top - tl, 0, 255),
        13: lambda: np.clip(half + (step + (step < 0) >> 1), 0, 255),
    }
    out = black.copy()
    for m in np.unique(mode):
        if int(m) in rules:
            at = mode == m
            out[at] = rules[int(m)]()[at]
    return out


def _modes(width: int, height: int, bits: int, part: np.ndarray) -> np.ndarray:
    """The mode of each pixel; the first row predicts from the left, the first column from above."""
    mode = (_blocks(part, width, height, bits) >> np.uint32(8) & np.uint32(15)).astype(np.int64)
    mode[0, :], mode[:, 0], mode[0, 0] = 1, 2, 0
    return mode


def unpredict(px: np.ndarray, width: int, height: int, bits: int, part: np.ndarray) -> np.ndarray:
    """Add predictions along slanted lines x + 2y, whose pixels don't depend on each other."""
    mode = _modes(width, height, bits, part).ravel()
    ch = channels(px.reshape(-1))
    for t in range(width + 2 * height - 2):
        y = np.arange(max(0, -(-(t - width + 1) // 2)), min(height - 1, t // 2) + 1)
        i = y * width + t - 2 * y
        if not len(i):
            continue
        # The neighbour above right of the last column is the row's own first pixel.
        n = [ch[np.maximum(i - d, 0)] for d in (1, width, width + 1, width - 1)]
        ch[i] = ch[i] + predicted(mode[i], *n) & 255
    return packed(ch)


def _cross(ch: np.ndarray, part: np.ndarray, sign: int) -> np.ndarray:
    """Add (1) or take away (-1) what green says of red, and green and red of blue."""
    small = lambda v: v.astype(np.uint8).astype(np.int8).astype(np.int32)
    t = channels(part)
    delta = lambda m, c: small(m) * small(c) >> 5
    out = ch.copy()
    out[..., 2] = ch[..., 2] + sign * delta(t[..., 0], ch[..., 1]) & 255
    red = out[..., 2] if sign > 0 else ch[..., 2]
    out[..., 0] = ch[..., 0] + sign * (delta(t[..., 1], ch[..., 1]) + delta(t[..., 2], red)) & 255
    return out


def uncross(px: np.ndarray, width: int, height: int, bits: int, part: np.ndarray) -> np.ndarray:
    return packed(_cross(channels(px.reshape(height, width)), _blocks(part, width, height, bits), 1)).ravel()


def ungreen(px: np.ndarray, width: int, height: int, bits: int, part: None) -> np.ndarray:
    ch = channels(px)
    ch[:, 0] += ch[:, 1]
    ch[:, 2] += ch[:, 1]
    return packed(ch)


def unpalette(px: np.ndarray, width: int, height: int, bits: int, table: np.ndarray) -> np.ndarray:
    """Colours by index, several indices to a pixel where ``bits`` says so; unknown indices are clear."""
    full = np.zeros(256, np.uint32)
    full[: len(table)] = table
    green = (px >> np.uint32(8) & np.uint32(255)).reshape(height, -1)
    depth = 8 >> bits
    x = np.arange(width)
    index = green[:, x >> bits] >> ((x & (1 << bits) - 1) * depth).astype(np.uint32) & np.uint32((1 << depth) - 1)
    return full[index].ravel()


# --------------------------------------------------------------- encoding


class Writer:
    """Values and their widths in bits, packed when all are known."""

    def __init__(self) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        self.v: list[int] = []
        self.n: list[int] = []

    def put(self, value: int, bits: int) -> None:
        self.v.append(value)
        self.n.append(bits)

    def put_all(self, values: np.ndarray, bits: np.ndarray) -> None:
        self._flush()
        self.values.append(values.astype(np.uint64))
        self.sizes.append(bits.astype(np.int64))

    def _flush(self) -> None:
        if self.v:
            self.values.append(np.array(self.v, np.uint64))
            self.sizes.append(np.array(self.n, np.int64))
            self.v, self.n = [], []

    def bytes(self) -> bytes:
        self._flush()
        v, n = np.concatenate(self.values), np.concatenate(self.sizes)
        if not n.all():
            v, n = v[n > 0], n[n > 0]
        end = np.cumsum(n)
        at = end - n
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        out = np.zeros(int(end[-1] >> 6) + 2, np.uint64)
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        out[word[first]] = np.add.reduceat(v << shift, first)  # bits don't meet, so sums are unions
        over = np.flatnonzero((at & 63) + n > 64)
        out[word[over] + 1] |= v[over] >> (np.uint64(64) - shift[over])
        return out.astype("<u8").tobytes()[: -(-int(end[-1]) // 8)]


def _put_code(w: Writer, lengths: np.ndarray) -> None:
    """Write a prefix code: one or two small symbols plainly, else its lengths with runs of zeros."""
    size = lengths.tolist()
    used = [i for i, s in enumerate(size) if s]
    if not used:
        used = [0]
    if len(used) <= 2 and used[-1] < 256:
        wide = used[0] > 1
        w.put(1 | (len(used) - 1) << 1 | wide << 2, 3)
        w.put(used[0], 8 if wide else 1)
        if len(used) == 2:
            w.put(used[1], 8)
        return
    tokens, at = [], 0  # symbol | extra << 5
    for i in used:
        gap, at = i - at, i + 1
        if gap:
            tokens += _zeros(gap)
        tokens.append(size[i])
    if at < len(size):
        tokens += _zeros(len(size) - at)
    counts = [0] * 19
    for t in tokens:
        counts[t & 31] += 1
    lengths = code_lengths(np.array(counts), 7).tolist()
    bits, n, code = [0] * 19, lengths.copy(), 0
    for s, t in sorted([(s, t) for t, s in enumerate(lengths) if s]):
        bits[t] = SEVEN[code] & (1 << s) - 1
        code += 1 << 7 - s
    if len([s for s in lengths if s]) == 1:
        n = [0] * 19
    last = max([i for i, k in enumerate(LENGTH_ORDER) if lengths[k] or i < 4])
    w.put(0 | last - 3 << 1, 5)
    w.v += [lengths[k] for k in LENGTH_ORDER[: last + 1]]
    w.n += [3] * (last + 1)
    w.put(0, 1)
    w.v += [bits[t & 31] | t >> 5 << n[t & 31] for t in tokens]
    n[17] += 3
    n[18] += 7
    w.n += [n[t & 31] for t in tokens]


def _zeros(gap: int) -> list[int]:
    """Tokens of a run of symbols that don't occur."""
    out = []
    while gap >= 11:
        out.append(18 | min(gap, 138) - 11 << 5)
        gap -= min(gap, 138)
    return out + ([17 | gap - 3 << 5] if gap >= 3 else [0] * gap)


def _symbols(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix symbol, extra bits' value, their number) of lengths or distances."""
    d = v - 1
    top = np.frexp(np.maximum(d, 1).astype(np.float64))[1] - 1
    extra = np.where(d < 4, 0, top - 1)
    return np.where(d < 4, d, 2 * top + (d >> np.maximum(top - 1, 0) & 1)), np.where(d < 4, 0, d & ((1 << extra) - 1)), extra


# The same of all lengths and distances up to a tile's; larger ones are computed.
SYMBOLS = _symbols(np.arange(1 << 13))


def symbols(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(v) and v.max() >= len(SYMBOLS[0]):
        return _symbols(v)
    return tuple(t[v] for t in SYMBOLS)


def matches(px: np.ndarray, least: int = 3, most: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, distance) of copies that cover repeats, in order and apart.

    Every run of windows of ``least`` pixels that all repeat at one distance is a copy.
    """
    none = (np.zeros(0, np.int64),) * 3
    n = len(px) - least + 1
    if n < 2:
        return none
    x = px.astype(np.uint64)
    key = np.zeros(n, np.uint64)
    for k in range(least):
        key = key * np.uint64(0x9E3779B97F4A7C15) + x[k : k + n]
    # The top of the key and the place as one number: equal keys are sorted by place.
    low = np.uint64(n.bit_length())
    both = np.sort(key >> low << low | np.arange(n, dtype=np.uint64))
    order = (both & np.uint64((1 << int(low)) - 1)).view(np.int64)
    same = np.flatnonzero(both[1:] >> low == both[:-1] >> low)
    if not len(same):
        return none
    here, there = order[same + 1], order[same]
    for k in range(least):
        fit = px[here + k] == px[there + k]
        here, there = here[fit], there[fit]
    if not len(here):
        return none
    back = np.zeros(n, np.int64)
    back[here] = here - there
    at = np.flatnonzero(back)
    new = np.append(True, (np.diff(at) != 1) | (back[at[1:]] != back[at[:-1]]))
    start = at[new]
    end = at[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)] + least
    dist = back[start]
    start = np.maximum(start, np.append(0, end[:-1]))
    pieces = -(-(end - start) // most)
    number = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = np.repeat(start, pieces) + number * most
    return first, np.minimum(np.repeat(end, pieces) - first, most), np.repeat(dist, pieces)


def _put_pixels(w: Writer, px: np.ndarray, width: int, main: bool, cache_bits: int = 0, copies: bool = True, meta_bits: int = 0) -> None:
    """Entropy-code an image; ``meta_bits`` gives each second block row of the main image its own codes."""
    w.put(1 | cache_bits << 1 if cache_bits else 0, 5 if cache_bits else 1)
    n, height = len(px), len(px) // width
    start, length, dist = matches(px) if copies else matches(px[:0])
    literal = np.ones(n, bool)
    for a, b in zip(start.tolist(), (start + length).tolist()):
        literal[a:b] = False
    at = np.flatnonzero(literal)
    green = (px[at] >> np.uint32(8) & np.uint32(255)).astype(np.int64)
    if cache_bits:
        cache: dict[int, int] = {}
        lit = set(at.tolist())
        for j, v in enumerate(px.tolist()):
            slot = (HASH * v & 0xFFFFFFFF) >> 32 - cache_bits
            if j in lit and (cache.get(slot, 0)) == v:
                green[np.searchsorted(at, j)] = LITERALS + LENGTHS + slot
            cache[slot] = v
    group_of = None
    if main:
        w.put(bool(meta_bits), 1)
        if meta_bits:
            w.put(meta_bits - 2, 3)
            blocks, rows = -(-width >> meta_bits), -(-height >> meta_bits)
            meta = np.repeat((np.arange(rows) % 2).astype(np.uint32), blocks)
            _put_pixels(w, meta << np.uint32(8) | np.uint32(BLACK), blocks, False)
            group_of = np.repeat((np.arange(height) >> meta_bits) % 2, width)
    lsym, lval, lbits = symbols(length)
    dsym, dval, dbits = symbols(dist + len(NEIGHBOURS))
    values, sizes = np.zeros(n, np.uint64), np.zeros(n, np.int64)
    raw = px.astype("<u4", copy=False).view(np.uint8).reshape(-1, 4)
    # Red, blue and alpha are alike in what is stored here and share their lengths.
    for g in range(int(group_of.max()) + 1 if meta_bits and n else 1):
        mine, copy = (group_of[at] == g, group_of[start] == g) if meta_bits else (slice(None), slice(None))
        p, gr = at[mine], green[mine]
        ch = raw[p][:, (2, 0, 3)]
        rest = gr < LITERALS if cache_bits else None
        plain = ch[rest] if cache_bits else ch
        here, far = lsym[copy], dsym[copy]
        counts = np.bincount(np.concatenate([gr, LITERALS + here]), minlength=LITERALS + LENGTHS + (1 << cache_bits if cache_bits else 0))
        each = list(np.bincount((plain + THREE).ravel(), minlength=3 * LITERALS).reshape(3, LITERALS))
        if all([np.count_nonzero(e) > 1 for e in each]):
            each = [each[0] + each[1] + each[2]] * 3
        codes: list[tuple[np.ndarray, np.ndarray]] = []
        for x in (counts, *each, np.bincount(far, minlength=DISTANCES)):
            if len(codes) > 1 and x is each[0]:  # as the one before
                codes.append(codes[-1])
                more = len(w.v)
                w.v += w.v[begun:more]
                w.n += w.n[begun:more]
                begun = more
                continue
            lengths = code_lengths(x, QUICK if np.count_nonzero(x) <= 1 << QUICK else TOP)
            codes.append(codes_of(lengths))
            begun = len(w.v)
            _put_code(w, lengths)
        v, s = codes[0][0][gr], codes[0][1][gr]
        for (bits, k), sym in zip(codes[1:4], ch.T):
            b, k = bits[sym], k[sym]
            if cache_bits:
                b, k = np.where(rest, b, np.uint64(0)), np.where(rest, k, 0)
            v |= b << s.view(np.uint64)
            s += k
        values[p], sizes[p] = v, s
        if len(here):
            q, v, s = start[copy], codes[0][0][LITERALS + here], codes[0][1][LITERALS + here]
            for more, k in ((lval[copy], lbits[copy]), (codes[4][0][far], codes[4][1][far]), (dval[copy], dbits[copy])):
                v, s = v | more.astype(np.uint64) << s.astype(np.uint64), s + k
            values[q], sizes[q] = v, s
    element = literal.copy()
    element[start] = True
    w.put_all(values[element], sizes[element])


def encode(px: np.ndarray, width: int, *, transforms: tuple = (), cache_bits: int = 0, copies: bool = True, meta_bits: int = 0) -> bytes:
    """A WebP file of ARGB pixels.

    ``transforms`` are applied in order: ``("predictor", bits, modes)``,
    ``("cross", bits, multipliers)``, ``("green",)`` or ``("palette",)``; modes and
    multipliers are one pixel a block.
    """
    height = len(px) // width
    w = Writer()
    w.put(0x2F | (width - 1) << 8 | (height - 1) << 22, 36)
    w.put(1, 4)
    now, across = px.astype(np.uint32), width
    for kind, *args in transforms:
        w.put(1, 1)
        w.put(("predictor", "cross", "green", "palette").index(kind), 2)
        if kind in ("predictor", "cross"):
            bits, part = args
            w.put(bits - 2, 3)
            _put_pixels(w, part.astype(np.uint32), -(-across >> bits), False)
            if kind == "predictor":
                ch, i = channels(now), np.arange(len(now))
                near = [ch[np.maximum(i - d, 0)] for d in (1, across, across + 1, across - 1)]
                now = packed(ch - predicted(_modes(across, height, bits, part).ravel(), *near))
            else:
                now = packed(_cross(channels(now.reshape(height, across)), _blocks(part, across, height, bits), -1)).ravel()
        elif kind == "green":
            ch = channels(now)
            ch[:, 0] -= ch[:, 1]
            ch[:, 2] -= ch[:, 1]
            now = packed(ch)
        else:
            table, index = np.unique(now, return_inverse=True)
            n = len(table)
            w.put(n - 1, 8)
            ch = channels(table)
            _put_pixels(w, packed(np.diff(ch, axis=0, prepend=0)), n, False)
            pack = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            wide = -(-across >> pack)
            full = np.zeros((height, wide << pack), np.int64)
            full[:, :across] = index.reshape(height, across)
            depth = 8 >> pack
            full = (full.reshape(height, wide, 1 << pack) << np.arange(1 << pack) * depth).sum(2)
            now, across = (full.ravel() << 8 | BLACK).astype(np.uint32), wide
    w.put(0, 1)
    _put_pixels(w, now, across, True, cache_bits, copies, meta_bits)
    body = w.bytes()
    chunk = b"VP8L" + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk
