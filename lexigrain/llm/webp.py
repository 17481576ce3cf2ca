"""Lossless WebP images with numpy: a writer of palette images, and a decoder of the whole format.

The decoder has two paths over one format.  ``decode`` reads any lossless image: prefix codes, meta prefix codes,
back-references, the colour cache, and the predictor, cross-colour, subtract-green and palette transforms.
``decode_many`` reads images of one common layout (a palette, one group of prefix codes, no colour cache) in step:
each numpy operation takes the next symbol of every image.  Images of other layouts go to ``decode``.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Fixed values of the format: the order of code length codes.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: Sizes of the five alphabets without a colour cache: green and lengths, red, blue, alpha, distance.
ALPHABETS = (280, 256, 256, 256, 40)
#: Near pixels that the first 120 distance codes name: nearest first, upper rows first, right of the pixel first.
NEAR = sorted(((x, y) for y in range(8) for x in range(-7, 9) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, -p[1], p[0] < 0))
REVERSED = sum(((np.arange(1 << 15) >> k) & 1) << (14 - k) for k in range(15))
#: Longest prefix codes that are written.
MAX_LENGTH = 12
#: Equal samples in a row from which on a back-reference is written, and its longest length.
RUN, LONGEST = 24, 4096


# Writing -----------------------------------------------------------------------------------------------------------


def code_lengths(counts: list[int], limit: int = MAX_LENGTH) -> list[int]:
    """Huffman code lengths of at least two symbols with positive counts, none above ``limit``."""
    n = len(counts)
    while True:
        order = sorted(range(n), key=counts.__getitem__)
        weight = [counts[i] for i in order]
        parent = [0] * (2 * n - 1)
        leaf, node = 0, n
        for new in range(n, 2 * n - 1):
            total = 0
            for _ in range(2):
                if leaf < n and (node >= new or weight[leaf] <= weight[node]):
                    at, leaf = leaf, leaf + 1
                else:
                    at, node = node, node + 1
                parent[at] = new
                total += weight[at]
            weight.append(total)
        depth = [0] * (2 * n - 1)
        for i in range(2 * n - 3, -1, -1):
            depth[i] = depth[parent[i]] + 1
        if max(depth) <= limit:
            out = [0] * n
            for i, symbol in enumerate(order):
                out[symbol] = depth[i]
            return out
        counts = [max(c, 2 * min(counts)) for c in counts]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, its first bit lowest."""
    order = np.argsort(np.where(lengths, lengths, 99), kind="stable")[: np.count_nonzero(lengths)]
    size = lengths[order]
    steps = 1 << (15 - size)
    codes = np.zeros(len(lengths), np.int64)
    codes[order] = REVERSED[np.cumsum(steps) - steps] & ((1 << size) - 1)
    return codes


def _prefix_value(value: int) -> tuple[int, int, int]:
    """Symbol, extra bits and their number for a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    high = (value - 1).bit_length() - 1
    extra = high - 1
    return 2 * high + (((value - 1) >> extra) & 1), (value - 1) & ((1 << extra) - 1), extra


def _runs(px: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of stretches that repeat the sample before them."""
    same = np.flatnonzero(px[1:] != px[:-1]) + 1
    begin, end = np.concatenate([[0], same]), np.append(same, len(px))
    long = np.flatnonzero(end - begin > RUN)
    return [(int(begin[i]) + 1, int(end[i] - begin[i]) - 1) for i in long]


_SINGLE = ([1, 0, 1, 0], [1, 1, 1, 8])  # a code of the one symbol 0


class _Image:
    """Symbols (value, bits) of one image, in parts."""

    def __init__(self, samples: np.ndarray, width: int) -> None:
        self.values: list[np.ndarray] = []
        self.sizes: list[np.ndarray] = []
        height = len(samples) // width
        self.put([0x2F, width - 1, height - 1, 0, 0], [8, 14, 14, 1, 3])
        have = np.flatnonzero(np.bincount(samples, minlength=256))
        index = np.zeros(256, np.uint8)
        index[have] = np.arange(len(have))
        px = index[samples]
        self.put([1, 3, len(have) - 1], [1, 2, 8])  # the palette transform
        self.palette(have)
        bits = 3 if len(have) <= 2 else 2 if len(have) <= 4 else 1 if len(have) <= 16 else 0
        if bits:
            rows = px.reshape(height, width)
            rows = np.pad(rows, ((0, 0), (0, -width % (1 << bits)))).reshape(height, -1, 1 << bits)
            px = (rows << (np.arange(1 << bits) * (8 >> bits)).astype(np.uint8)).sum(2, dtype=np.uint8).ravel()
        self.put([0, 0, 0], [1, 1, 1])  # no more transforms, no colour cache, one group of codes
        self.pixels(px)

    def put(self, values, sizes) -> None:
        self.values.append(np.asarray(values, np.int64))
        self.sizes.append(np.asarray(sizes, np.int64))

    def palette(self, have: np.ndarray) -> None:
        """Colours as differences, in green; alpha goes from 0 to 255 at the first."""
        self.put([0], [1])
        # 256 codes of 8 bits: the only code length is 8, and 256 lengths are coded in no bits each.
        self.put([0, 12 - 4, *[0] * 11, 1, 1, 3, 254], [1, 4, *[3] * 12, 1, 3, 8])
        for _ in range(2):
            self.put(*_SINGLE)
        self.put([1, 1, 0, 0, 255], [1, 1, 1, 1, 8])
        self.put(*_SINGLE)
        steps = np.diff(have, prepend=0)
        both = np.zeros(2 * len(have), np.int64)
        both[::2] = REVERSED[steps] >> 7
        both[1] = 1
        self.put(both, np.tile([8, 1], len(have)))

    def pixels(self, px: np.ndarray) -> None:
        runs = _runs(px)
        keep = np.ones(len(px), bool)
        copies: list[tuple[int, int]] = []
        for start, n in runs:
            keep[start : start + n] = False
            copies += [(start + at, min(LONGEST, n - at)) for at in range(0, n, LONGEST)]
        symbols = px[keep].astype(np.int64)
        extra, extra_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if copies:
            at = np.cumsum(keep)[[s for s, _ in copies]]
            parts = [_prefix_value(n) for _, n in copies]
            symbols = np.insert(symbols, at, [256 + p[0] for p in parts])
            extra, extra_size = np.array([p[1] for p in parts]), np.array([p[2] for p in parts])
        used = np.bincount(symbols, minlength=280)
        have = np.flatnonzero(used)
        lengths = np.zeros(280, np.int64)
        if len(have) == 1:
            symbol = int(have[0])
            self.put([1, 0, 1, symbol], [1, 1, 1, 8])
        else:
            lengths[have] = code_lengths(used[have].tolist())
            n = int(have[-1]) + 1
            # Lengths 0..15 in 4 bits each; as many as there are up to the last symbol.
            self.put([0, 15, 0, 0, *[4] * 6, 0, *[4] * 10, 1, 4, n - 2], [1, 4, *[3] * 19, 1, 3, 10])
            self.put(REVERSED[lengths[:n]] >> 11, np.full(n, 4))
        for _ in range(3):
            self.put(*_SINGLE)
        self.put([1, 0, 1, 1], [1, 1, 1, 8])  # the distance code is always that of the pixel before
        values, sizes = canonical(lengths)[symbols], lengths[symbols]
        if copies:
            at = np.flatnonzero(symbols >= 256) + 1
            values, sizes = np.insert(values, at, extra), np.insert(sizes, at, extra_size)
        self.put(values, sizes)


def encode_many(samples: list[np.ndarray], width: int) -> list[bytes]:
    """Images of 8-bit samples, whole rows of ``width`` each, as WebP files."""
    images = [_Image(s, width) for s in samples]
    bits = np.array([sum(int(s.sum()) for s in i.sizes) for i in images])
    pad = -bits % 8
    for image, n in zip(images, pad.tolist(), strict=True):
        image.put([0], [n])
    values = np.concatenate([v for i in images for v in i.values])
    sizes = np.concatenate([s for i in images for s in i.sizes])
    within = np.arange(int(sizes.sum()), dtype=np.int32) - np.repeat((np.cumsum(sizes) - sizes).astype(np.int32), sizes)
    packed = np.packbits(np.repeat(values.astype(np.uint16), sizes) >> within.astype(np.uint8) & 1, bitorder="little").tobytes()
    ends = np.cumsum((bits + pad) // 8).tolist()
    out = []
    for a, b in zip([0, *ends], ends, strict=False):
        chunk = packed[a:b] + b"\0" * ((b - a) % 2)
        out.append(b"RIFF" + (len(chunk) + 12).to_bytes(4, "little") + b"WEBPVP8L" + (b - a).to_bytes(4, "little") + chunk)
    return out


# Reading one image of any layout ------------------------------------------------------------------------------------


def chunk_of(image: bytes) -> bytes:
    """The lossless stream of a WebP file."""
    if image[:4] != b"RIFF" or image[8:16] != b"WEBPVP8L":
        raise ValueError("not a lossless WebP file")
    n = int.from_bytes(image[16:20], "little")
    if len(image) < 20 + n:
        raise ValueError("a WebP file is cut short")
    return image[20 : 20 + n]


class _Bits:
    def __init__(self, data: bytes) -> None:
        self.data, self.pos, self.end = data + b"\0" * 8, 0, 8 * len(data)

    def peek(self) -> int:
        at = self.pos >> 3
        return int.from_bytes(self.data[at : at + 8], "little") >> (self.pos & 7)

    def read(self, n: int) -> int:
        value = self.peek() & ((1 << n) - 1)
        self.pos += n
        if self.pos > self.end:
            raise ValueError("a WebP stream is cut short")
        return value


def lookup(lengths: np.ndarray) -> tuple[int, list[int], list[int]]:
    """Bits to look at, and by them the symbol and the bits it takes."""
    have = np.flatnonzero(lengths)
    if len(have) == 0:
        return 0, [0], [0]
    if len(have) == 1:
        return 0, [int(have[0])], [0]
    bits = int(lengths.max())
    order = np.argsort(np.where(lengths, lengths, 99), kind="stable")[: len(have)]
    times = 1 << (bits - lengths[order])
    if int(times.sum()) != 1 << bits:
        raise ValueError("a prefix code isn't complete")
    turned = REVERSED[: 1 << bits] >> (15 - bits)
    return bits, np.repeat(order, times)[turned].tolist(), np.repeat(lengths[order], times)[turned].tolist()


class _Reader(_Bits):
    def symbol(self, code: tuple[int, list[int], list[int]]) -> int:
        bits, symbols, sizes = code
        at = self.peek() & ((1 << bits) - 1)
        self.pos += sizes[at]
        if self.pos > self.end:
            raise ValueError("a WebP stream is cut short")
        return symbols[at]

    def code(self, alphabet: int) -> tuple[int, list[int], list[int]]:
        lengths = np.zeros(max(alphabet, 256), np.int64)
        if self.read(1):
            two, wide = self.read(1), self.read(1)
            lengths[self.read(8 if wide else 1)] = 1
            if two:
                lengths[self.read(8)] = 1
            return lookup(lengths)
        first = np.zeros(19, np.int64)
        for k in LENGTH_ORDER[: 4 + self.read(4)]:
            first[k] = self.read(3)
        tokens = 2 + self.read(2 + 2 * self.read(3)) if self.read(1) else alphabet
        table = lookup(first)
        at, before = 0, 8
        while at < alphabet and tokens:
            tokens -= 1
            token = self.symbol(table)
            if token < 16:
                lengths[at] = token
                at, before = at + 1, token or before
            else:
                value, bits, least = {16: (before, 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}[token]
                times = least + self.read(bits)
                if at + times > alphabet:
                    raise ValueError("too many code lengths")
                lengths[at : at + times] = value
                at += times
        return lookup(lengths[:alphabet])

    def number(self, prefix: int) -> int:
        """A length or distance from its prefix symbol."""
        if prefix < 4:
            return prefix + 1
        extra = (prefix - 2) >> 1
        return ((2 + (prefix & 1)) << extra) + self.read(extra) + 1

    def image(self, width: int, height: int, main: bool) -> np.ndarray:
        """Pixels as 0xAARRGGBB, before transforms are inverted."""
        cache_bits = self.read(4) if self.read(1) else 0
        if cache_bits > 11:
            raise ValueError("a colour cache of more than 11 bits")
        groups, tile, per_row, choice = 1, 0, 0, None
        if main and self.read(1):
            tile = self.read(3) + 2
            per_row = -(-width >> tile)
            choice = (self.image(per_row, -(-height >> tile), False) >> 8 & 0xFFFF).ravel().tolist()
            groups = max(choice) + 1
        cache = [0] * (1 << cache_bits) if cache_bits else []
        sizes = (ALPHABETS[0] + len(cache), *ALPHABETS[1:])
        codes = [[self.code(n) for n in sizes] for _ in range(groups)]
        out = [0] * (width * height)
        at, done, group = 0, 0, codes[0]
        while at < len(out):
            if choice:
                group = codes[choice[(at // width >> tile) * per_row + (at % width >> tile)]]
            green = self.symbol(group[0])
            if green < 256:
                red, blue, alpha = self.symbol(group[1]), self.symbol(group[2]), self.symbol(group[3])
                out[at] = alpha << 24 | red << 16 | green << 8 | blue
                at += 1
            elif green < 280:
                n = self.number(green - 256)
                back = self.number(self.symbol(group[4]))
                if back > 120:
                    back -= 120
                else:
                    x, y = NEAR[back - 1]
                    back = max(1, x + y * width)
                if back > at or at + n > len(out):
                    raise ValueError("a back-reference leaves the image")
                for _ in range(n):
                    out[at] = out[at - back]
                    at += 1
            else:
                while done < at:
                    cache[_slot(out[done], cache_bits)] = out[done]
                    done += 1
                out[at] = cache[green - 280]
                at += 1
        return np.array(out, np.int64).reshape(height, width)


def _slot(colour: int, bits: int) -> int:
    return (0x1E35A7BD * colour & 0xFFFFFFFF) >> (32 - bits)


def _channels(pixels: np.ndarray) -> np.ndarray:
    return np.stack([pixels >> s & 255 for s in (24, 16, 8, 0)], -1)


def _joined(channels: np.ndarray) -> np.ndarray:
    a, r, g, b = np.moveaxis(channels & 255, -1, 0)
    return a << 24 | r << 16 | g << 8 | b


def predict(mode: int, left, top, top_left, top_right):
    """The four channels that a mode predicts from the neighbours' channels."""
    half = lambda a, b: [(x + y) >> 1 for x, y in zip(a, b, strict=True)]
    clamp = lambda v: min(255, max(0, v))
    if mode == 11:
        to_left = sum(abs(t - c) for t, c in zip(top, top_left, strict=True))
        to_top = sum(abs(x - c) for x, c in zip(left, top_left, strict=True))
        return left if to_left < to_top else top
    if mode == 12:
        return [clamp(x + t - c) for x, t, c in zip(left, top, top_left, strict=True)]
    if mode == 13:
        return [clamp(m + int((m - c) / 2)) for m, c in zip(half(left, top), top_left, strict=True)]
    return {
        1: lambda: left, 2: lambda: top, 3: lambda: top_right, 4: lambda: top_left,
        5: lambda: half(half(left, top_right), top), 6: lambda: half(left, top_left), 7: lambda: half(left, top),
        8: lambda: half(top_left, top), 9: lambda: half(top, top_right),
        10: lambda: half(half(left, top_left), half(top, top_right)),
    }.get(mode, lambda: [255, 0, 0, 0])()


def _unpredict(pixels: np.ndarray, bits: int, modes: np.ndarray) -> np.ndarray:
    height, width = pixels.shape
    flat = _channels(pixels).reshape(-1, 4).tolist()
    modes = (modes >> 8 & 15).tolist()
    for y in range(height):
        for x in range(width):
            at = y * width + x
            if y == 0:
                guess = flat[at - 1] if x else [255, 0, 0, 0]
            elif x == 0:
                guess = flat[at - width]
            else:
                guess = predict(modes[y >> bits][x >> bits], flat[at - 1], flat[at - width], flat[at - width - 1], flat[at - width + 1])
            flat[at] = [(v + g) & 255 for v, g in zip(flat[at], guess, strict=True)]
    return _joined(np.array(flat, np.int64).reshape(height, width, 4))


def _signed(v: np.ndarray) -> np.ndarray:
    return (v & 255 ^ 128) - 128


def _uncross(pixels: np.ndarray, bits: int, blocks: np.ndarray) -> np.ndarray:
    height, width = pixels.shape
    at = blocks[np.arange(height)[:, None] >> bits, np.arange(width)[None] >> bits]
    _, red_to_blue, green_to_blue, green_to_red = (_signed(c) for c in np.moveaxis(_channels(at), -1, 0))
    a, r, g, b = np.moveaxis(_channels(pixels), -1, 0)
    r = r + (green_to_red * _signed(g) >> 5) & 255
    b = b + (green_to_blue * _signed(g) >> 5) + (red_to_blue * _signed(r) >> 5) & 255
    return _joined(np.stack([a, r, g, b], -1))


def _unpalette(pixels: np.ndarray, bits: int, palette: np.ndarray, width: int) -> np.ndarray:
    index = pixels >> 8 & 255
    if bits:
        each = 8 >> bits
        index = (index[..., None] >> np.arange(1 << bits) * each & ((1 << each) - 1)).reshape(len(pixels), -1)[:, :width]
    table = np.zeros(256, np.int64)
    table[: len(palette)] = palette
    return table[index]


def decode(image: bytes) -> np.ndarray:
    """Rows of pixels 0xAARRGGBB of any lossless WebP file."""
    r = _Reader(chunk_of(image))
    if r.read(8) != 0x2F:
        raise ValueError("not a lossless WebP stream")
    width, height, _, version = r.read(14) + 1, r.read(14) + 1, r.read(1), r.read(3)
    if version:
        raise ValueError("an unknown version of lossless WebP")
    undo, own = [], width
    while r.read(1):
        kind = r.read(2)
        if any(kind == k for k, *_ in undo):
            raise ValueError("a transform comes twice")
        if kind in (0, 1):
            bits = r.read(3) + 2
            undo.append((kind, own, bits, r.image(-(-own // (1 << bits)), -(-height // (1 << bits)), False)))
        elif kind == 2:
            undo.append((kind, own, 0, None))
        else:
            n = r.read(8) + 1
            steps = _channels(r.image(n, 1, False)[0])
            bits = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            undo.append((kind, own, bits, _joined(np.cumsum(steps, 0))))
            own = -(-own // (1 << bits))
    pixels = r.image(own, height, True)
    for kind, wide, bits, with_ in reversed(undo):
        if kind == 0:
            pixels = _unpredict(pixels, bits, with_)
        elif kind == 1:
            pixels = _uncross(pixels, bits, with_)
        elif kind == 2:
            a, red, g, b = np.moveaxis(_channels(pixels), -1, 0)
            pixels = _joined(np.stack([a, red + g, g, b + g], -1))
        else:
            pixels = _unpalette(pixels, bits, with_, wide)
    return pixels


# Reading many images in step ----------------------------------------------------------------------------------------


class _Streams:
    def __init__(self, chunks: list[bytes]) -> None:
        data = np.frombuffer(b"".join(chunks) + b"\0" * 16, np.uint8)
        ends = np.cumsum([len(c) for c in chunks])
        # The 8 bytes from every place on; a copy, as numpy gathers slowly from unaligned arrays.
        self.window = np.ndarray((len(data) - 8,), "<u8", data.data, strides=(1,)).astype(U64)
        self.pos = 8 * (ends - [len(c) for c in chunks])
        self.end = 8 * ends

    def peek(self, who: np.ndarray) -> np.ndarray:
        at = np.minimum(self.pos[who], self.end[who])
        return self.window[at >> 3] >> (at & 7).astype(U64)

    def read(self, n, who: np.ndarray) -> np.ndarray:
        """n bits of each; n may differ by stream."""
        value = self.peek(who) & ((U64(1) << np.asarray(n).astype(U64)) - U64(1))
        self.pos[who] += n
        return value.astype(np.int64)


def _tables(lengths: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """Per stream the table of ``lookup``: bits to look at, symbol << 4 | bits taken, and whether the code is sound."""
    have = np.count_nonzero(lengths, 1)
    single = have <= 1
    bits = int(lengths[~single].max()) if not single.all() else 0
    order = np.argsort(np.where(lengths, lengths, 99), axis=1, kind="stable")
    sizes = np.take_along_axis(lengths, order, 1)
    times = np.where(sizes > 0, 1 << np.maximum(bits - sizes, 0), 0)
    sound = single | (times.sum(1) == 1 << bits)
    times[single | ~sound] = 0
    times[single | ~sound, 0] = 1 << bits
    sizes[single] = 0
    order[have == 0, 0] = 0
    turned = REVERSED[: 1 << bits] >> (15 - bits)
    entries = np.repeat((order << 4 | sizes).astype(np.uint16).ravel(), times.ravel()).reshape(len(lengths), -1)
    return bits, np.take(entries, turned, axis=1), sound


class _Batch:
    """Streams of the common layout; ``odd`` marks those that leave it."""

    def __init__(self, chunks: list[bytes]) -> None:
        self.s, self.n = _Streams(chunks), len(chunks)
        self.all, self.odd = np.arange(self.n), np.zeros(self.n, bool)

    def lengths(self, alphabet: int) -> np.ndarray:
        s, out = self.s, np.zeros((self.n, max(alphabet, 256)), np.int64)
        simple = s.read(1, self.all) == 1
        who = self.all[simple]
        if len(who):
            two, wide = s.read(1, who), s.read(1, who)
            out[who, s.read(np.where(wide, 8, 1), who)] = 1
            pair = who[two == 1]
            out[pair, s.read(8, pair)] = 1
        who = self.all[~simple]
        if not len(who):
            return out
        first, given = np.zeros((self.n, 19), np.int64), np.zeros(self.n, np.int64)
        given[who] = 4 + s.read(4, who)
        for k, symbol in enumerate(LENGTH_ORDER):
            more = who[given[who] > k]
            if not len(more):
                break
            first[more, symbol] = s.read(3, more)
        tokens = np.full(self.n, alphabet)
        cut = who[s.read(1, who) == 1]
        tokens[cut] = 2 + s.read(2 + 2 * s.read(3, cut), cut)
        bits, table, sound = _tables(first)
        self.odd |= ~sound
        at, before = np.zeros(self.n, np.int64), np.full(self.n, 8)
        while len(who := who[(tokens[who] > 0) & (at[who] < alphabet)]):
            entry = table[who, (s.peek(who) & U64((1 << bits) - 1)).astype(np.int64)]
            s.pos[who] += entry & 15
            tokens[who] -= 1
            token = entry >> 4
            plain = token < 16
            w, t = who[plain], token[plain]
            out[w, at[w]] = t
            at[w] += 1
            before[w] = np.where(t, t, before[w])
            for w, t in zip(who[~plain].tolist(), token[~plain].tolist(), strict=True):
                value, extra, least = {16: (int(before[w]), 2, 3), 17: (0, 3, 3), 18: (0, 7, 11)}[t]
                times = least + int(s.read(extra, np.array([w]))[0])
                self.odd[w] |= at[w] + times > alphabet
                times = min(times, alphabet - int(at[w]))
                out[w, at[w] : at[w] + times] = value
                at[w] += times
        return out

    def pixels(self, count: np.ndarray, grey: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Green and alpha of ``count`` pixels of each stream, and where each stream's pixels start.

        Red and blue aren't kept; with ``grey``, streams that have any leave the common layout.
        """
        s = self.s
        tables = []
        for alphabet in ALPHABETS:
            bits, table, sound = _tables(self.lengths(alphabet))
            self.odd |= ~sound
            tables.append((bits, table))
        if grey:
            self.odd |= (tables[1][1] >> 4).any(1) | (tables[2][1] >> 4).any(1)
        begin = np.cumsum(count) - count
        green, alpha = np.zeros(int(count.sum()), np.uint8), np.zeros(int(count.sum()), np.uint8)
        here, last = begin.copy(), begin + count
        here[self.odd] = last[self.odd]
        reads = [(k, bits, table.ravel(), bits) for k, (bits, table) in enumerate(tables[:4])]
        g_bits, g_table = tables[0][0], tables[0][1].ravel()
        fixed = tables[1][0] == tables[2][0] == tables[3][0] == 0
        who = self.all
        while len(who := who[here[who] < last[who]]):
            base, mask = who << g_bits, U64((1 << g_bits) - 1)
            pos, to, end = s.pos[who], here[who], s.end[who]
            constant = tables[3][1][who, 0] >> 4
            for _ in range(int((last[who] - to).min())):
                at = np.minimum(pos, end)
                bits = s.window[at >> 3] >> (at & 7).astype(U64)
                entry = g_table[base + (bits & mask).astype(np.int64)]
                symbol = entry >> 4
                pos = pos + (entry & 15)
                if (symbol >= 256).any():
                    copies = np.flatnonzero(symbol >= 256)
                    rest = np.flatnonzero(symbol < 256)
                    green[to[rest]] = symbol[rest]
                    if fixed:
                        alpha[to[rest]] = constant[rest]
                    else:
                        pos[rest] = self._others(reads, who[rest], bits[rest] >> (entry[rest] & 15).astype(U64), pos[rest], alpha, to[rest])
                    to[rest] += 1
                    for i in copies.tolist():
                        pos[i], to[i] = self._copy(int(who[i]), int(symbol[i]) - 256, int(pos[i]), int(to[i]), begin, last, tables[4], green, alpha)
                    break
                green[to] = symbol
                if fixed:
                    alpha[to] = constant
                else:
                    pos = self._others(reads, who, bits >> (entry & 15).astype(U64), pos, alpha, to)
                to = to + 1
            s.pos[who], here[who] = pos, to
            self.odd[who[pos > end]] = True
            here[self.odd] = last[self.odd]
        return green, alpha, begin

    def _others(self, reads: list, who: np.ndarray, bits: np.ndarray, pos: np.ndarray, alpha: np.ndarray, to: np.ndarray) -> np.ndarray:
        for k, width, table, _ in reads[1:]:
            entry = table[(who << width) + (bits & U64((1 << width) - 1)).astype(np.int64)]
            bits = bits >> (entry & 15).astype(U64)
            pos = pos + (entry & 15)
            if k == 3:
                alpha[to] = entry >> 4
        return pos

    def _copy(self, w: int, prefix: int, pos: int, to: int, begin, last, distance, green, alpha) -> tuple[int, int]:
        one = np.array([w])
        self.s.pos[w] = pos

        def number(prefix: int) -> int:
            if prefix < 4:
                return prefix + 1
            extra = (prefix - 2) >> 1
            return ((2 + (prefix & 1)) << extra) + int(self.s.read(extra, one)[0]) + 1

        n = number(prefix)
        bits, table = distance
        entry = int(table[w, int(self.s.peek(one)[0]) & ((1 << bits) - 1)])
        self.s.pos[w] += entry & 15
        back = number(entry >> 4)
        if back != 2 or to == begin[w] or to + n > last[w]:  # only the pixel before is common
            self.odd[w] = True
            return int(self.s.pos[w]), int(last[w])
        green[to : to + n], alpha[to : to + n] = green[to - 1], alpha[to - 1]
        return int(self.s.pos[w]), to + n


def decode_many(images: list[bytes]) -> list[np.ndarray]:
    """Rows of pixels 0xAARRGGBB of each image."""
    if not images:
        return []
    b = _Batch([chunk_of(i) for i in images])
    s = b.s
    head = {name: s.read(n, b.all) for name, n in (("sign", 8), ("width", 14), ("height", 14), ("alpha", 1), ("version", 3), ("more", 1), ("kind", 2), ("colours", 8), ("cache", 1))}
    b.odd |= (head["sign"] != 0x2F) | (head["version"] != 0) | (head["more"] != 1) | (head["kind"] != 3) | (head["cache"] != 0)
    width, height, colours = head["width"] + 1, head["height"] + 1, head["colours"] + 1
    count = np.where(b.odd, 1, colours)
    table, table_alpha, first = b.pixels(count, True)
    for _ in range(3):  # no other transform, no colour cache, one group of codes
        b.odd |= s.read(1, b.all) != 0
    shift = np.select([colours <= 2, colours <= 4, colours <= 16], [3, 2, 1], 0)
    own = -(-width // (1 << shift))
    green, _, begin = b.pixels(np.where(b.odd, 1, own * height), False)
    out = []
    for i, image in enumerate(images):
        if b.odd[i]:
            out.append(decode(image))
            continue
        steps = slice(int(first[i]), int(first[i] + count[i]))
        palette = (np.cumsum(table_alpha[steps], dtype=np.int64) & 255) << 24 | (np.cumsum(table[steps], dtype=np.int64) & 255) << 8
        px = green[int(begin[i]) : int(begin[i] + own[i] * height[i])].reshape(int(height[i]), int(own[i]))
        out.append(_unpalette(px.astype(np.int64) << 8, int(shift[i]), palette, int(width[i])))
    return out
