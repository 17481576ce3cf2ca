"""Lossless WebP: images of every feature of the format, round trips, and the media query."""

import base64
import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexigrain.llm import media, webp

#: Two public one-pixel lossless images.
PUBLIC = ["UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==", "UklGRh4AAABXRUJQVlA4TBEAAAAvAAAAAAfQ//73v/+BiOh/AAA="]


class Writer:
    """A plain writer of any layout, bit by bit."""

    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [value >> k & 1 for k in range(n)]

    def code(self, counts, runs=False):
        """A prefix code for the used symbols; returns symbol -> (code, bits)."""
        have = [i for i, c in enumerate(counts) if c]
        lengths = np.zeros(len(counts), np.int64)
        if len(have) <= 2 and all(h < 256 for h in have):
            have = have or [0]
            self.put(1, 1), self.put(len(have) - 1, 1), self.put(1, 1), self.put(have[0], 8)
            if len(have) == 2:
                self.put(have[1], 8)
                lengths[have] = 1
            codes = webp.canonical(lengths)
            return {h: (int(codes[h]), int(lengths[h])) for h in have}
        if len(have) == 1:
            have.append(0)
        lengths[have] = webp.code_lengths([max(1, counts[h]) for h in have], 15)
        # Code lengths as tokens: runs of zeros and repeats if asked for.
        tokens, i = [], 0
        while i < len(lengths):
            n = 1
            while i + n < len(lengths) and lengths[i + n] == lengths[i]:
                n += 1
            if runs and lengths[i] == 0 and n >= 3:
                n = min(n, 138)
                tokens.append((17, n - 3, 3) if n <= 10 else (18, n - 11, 7))
            elif runs and lengths[i] and n >= 4:
                n = min(n - 1, 6) + 1
                tokens += [(int(lengths[i]), 0, 0), (16, n - 4, 2)]
            else:
                n = 1
                tokens.append((int(lengths[i]), 0, 0))
            i += n
        used = sorted({t for t, *_ in tokens})
        own = np.zeros(19, np.int64)
        own[used] = webp.code_lengths([1] * len(used), 7) if len(used) > 1 else 1
        self.put(0, 1), self.put(15, 4)
        for k in webp.LENGTH_ORDER:
            self.put(int(own[k]), 3)
        self.put(0, 1)
        small = webp.canonical(own)
        for t, extra, bits in tokens:
            if len(used) > 1:
                self.put(int(small[t]), int(own[t]))
            self.put(extra, bits)
        codes = webp.canonical(lengths)
        return {h: (int(codes[h]), int(lengths[h])) for h in have}

    def symbols(self, px, width, cache_bits, copies):
        """Pixels to literals, cache hits and copies."""
        out, at, cache = [], 0, {}
        while at < len(px):
            best = (0, 0)
            for back in copies:
                n = 0
                while back <= at and at + n < len(px) and n < 4096 and px[at + n] == px[at + n - back]:
                    n += 1
                best = max(best, (n, back))
            n = 1
            if best[0] >= 3:
                n = best[0]
                near = {max(1, x + y * width): i + 1 for i, (x, y) in reversed(list(enumerate(webp.NEAR)))}
                out.append(("copy", n, near.get(best[1], best[1] + 120)))
            elif cache_bits and cache.get(webp._slot(px[at], cache_bits)) == px[at]:
                out.append(("cache", webp._slot(px[at], cache_bits)))
            else:
                out.append(("pixel", px[at]))
            for p in px[at : at + n]:
                cache[webp._slot(p, cache_bits)] = p
            at += n
        return out

    def image(self, pixels, main=False, cache_bits=0, copies=(), groups=None, runs=False):
        """groups: (bits, rows of group numbers) of the prefix code groups."""
        height, width = len(pixels), len(pixels[0])
        self.put(int(bool(cache_bits)), 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(int(bool(groups)), 1)
            if groups:
                self.put(groups[0] - 2, 3)
                self.image([[g << 8 for g in row] for row in groups[1]])
        out = self.symbols([p for row in pixels for p in row], width, cache_bits, copies)
        n_groups = max(g for row in groups[1] for g in row) + 1 if groups else 1
        counts = [[[0] * n for n in (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)] for _ in range(n_groups)]
        at, parts = 0, []
        for kind, *v in out:
            g = groups[1][at // width >> groups[0]][at % width >> groups[0]] if groups else 0
            if kind == "pixel":
                a, r, gr, b = (v[0] >> s & 255 for s in (24, 16, 8, 0))
                part, step = [(0, gr, 0, 0), (1, r, 0, 0), (2, b, 0, 0), (3, a, 0, 0)], 1
            elif kind == "cache":
                part, step = [(0, 280 + v[0], 0, 0)], 1
            else:
                (s, e, n), (t, f, m) = webp._prefix_value(v[0]), webp._prefix_value(v[1])
                part, step = [(0, 256 + s, e, n), (4, t, f, m)], v[0]
            for k, symbol, *_ in part:
                counts[g][k][symbol] += 1
            parts.append((g, part))
            at += step
        codes = [[self.code(c, runs) for c in own] for own in counts]
        for g, part in parts:
            for k, symbol, extra, n in part:
                self.put(*codes[g][k][symbol])
                self.put(extra, n)

    def file(self):
        data = np.packbits(np.array(self.bits, np.uint8), bitorder="little").tobytes()
        chunk = data + b"\0" * (len(data) % 2)
        return b"RIFF" + (len(chunk) + 12).to_bytes(4, "little") + b"WEBPVP8L" + len(data).to_bytes(4, "little") + chunk


def start(width, height):
    w = Writer()
    w.put(0x2F, 8), w.put(width - 1, 14), w.put(height - 1, 14), w.put(1, 1), w.put(0, 3)
    return w


def picture(width, height, seed=0, colours=0):
    r = np.random.default_rng(seed)
    if colours:
        table = r.integers(0, 1 << 32, colours)
        return table[r.integers(0, colours, (height, width))]
    return r.integers(0, 1 << 32, (height, width))


split = lambda p: [p >> s & 255 for s in (24, 16, 8, 0)]
signed = lambda v: (v & 255 ^ 128) - 128


def test_public_images():
    for text in PUBLIC:
        assert webp.decode(base64.b64decode(text)).shape == (1, 1)
        assert (webp.decode_many([base64.b64decode(text)])[0] == webp.decode(base64.b64decode(text))).all()


def test_near_distances():
    assert len(webp.NEAR) == len(set(webp.NEAR)) == 120
    assert webp.NEAR[:10] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0), (1, 2), (-1, 2), (2, 1), (-2, 1)]
    assert webp.NEAR[-4:] == [(8, 6), (-7, 7), (7, 7), (8, 7)] or webp.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("runs", [False, True])
@pytest.mark.parametrize("cache_bits", [0, 1, 5, 11])
@pytest.mark.parametrize("copies", [(), (1,), (1, 2, 7, 13, 26, 300)])
def test_codes_copies_and_cache(runs, cache_bits, copies):
    want = np.concatenate([picture(13, 20, 1, 9), picture(13, 5, 2), np.repeat(picture(1, 1, 3), 13 * 30).reshape(30, 13), picture(13, 20, 1, 9)])
    w = start(13, len(want))
    w.put(0, 1)
    w.image(want.tolist(), True, cache_bits, copies, runs=runs)
    for got in (webp.decode(w.file()), webp.decode_many([w.file()])[0]):
        assert (got == want).all()


def test_groups_of_codes():
    want = picture(21, 19, 4, 30)
    groups = [[(x + 2 * y) % 3 for x in range(6)] for y in range(5)]
    w = start(21, 19)
    w.put(0, 1)
    w.image(want.tolist(), True, 3, (1, 21), groups=(2, groups))
    assert (webp.decode(w.file()) == want).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    want = picture(11, 9, mode)
    flat = [split(int(p)) for p in want.ravel()]
    rest = []
    for i, own in enumerate(flat):
        y, x = divmod(i, 11)
        guess = [255, 0, 0, 0] if i == 0 else flat[i - 1] if y == 0 else flat[i - 11] if x == 0 else webp.predict(mode, flat[i - 1], flat[i - 11], flat[i - 12], flat[i - 10])
        a, r, g, b = ((v - p) & 255 for v, p in zip(own, guess, strict=True))
        rest.append(a << 24 | r << 16 | g << 8 | b)
    w = start(11, 9)
    w.put(1, 1), w.put(0, 2), w.put(0, 3)
    w.image([[mode << 8] * 3] * 3)
    w.put(0, 1)
    w.image(np.array(rest).reshape(9, 11).tolist(), True)
    assert (webp.decode(w.file()) == want).all()


def test_predictor_values():
    left, top, corner, right = [10, 20, 30, 40], [50, 60, 70, 80], [20, 20, 20, 255], [1, 2, 3, 4]
    p = lambda m: list(webp.predict(m, left, top, corner, right))
    assert [p(m) for m in (0, 1, 2, 3, 4)] == [[255, 0, 0, 0], left, top, right, corner]
    assert p(5) == [(5 + 50) // 2, (11 + 60) // 2, (16 + 70) // 2, (22 + 80) // 2] and p(7) == [30, 40, 50, 60]
    assert p(6) == [15, 20, 25, 147] and p(8) == [35, 40, 45, 167] and p(9) == [25, 31, 36, 42] and p(10) == [20, 25, 30, 94]
    assert p(12) == [40, 60, 80, 0] and p(13) == [35, 50, 65, 0]
    assert p(11) == (left if 30 + 40 + 50 + 175 < 10 + 0 + 10 + 215 else top)


def test_cross_colour_and_green():
    want = picture(10, 6, 8)
    red_to_blue, green_to_blue, green_to_red = 200, 17, 250
    rest = np.zeros_like(want)
    for at, p in np.ndenumerate(want):
        a, r, g, b = split(int(p))
        b = b - (signed(green_to_blue) * signed(g) >> 5) - (signed(red_to_blue) * signed(r) >> 5) & 255
        r = r - (signed(green_to_red) * signed(g) >> 5) & 255
        rest[at] = a << 24 | (r - g & 255) << 16 | g << 8 | (b - g & 255)
    w = start(10, 6)
    w.put(1, 1), w.put(1, 2), w.put(0, 3)
    w.image([[255 << 24 | red_to_blue << 16 | green_to_blue << 8 | green_to_red] * 3] * 2)
    w.put(1, 1), w.put(2, 2), w.put(0, 1)
    w.image(rest.tolist(), True)
    assert (webp.decode(w.file()) == want).all()


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 5, 16, 17, 200, 256])
def test_palette(colours):
    table = [int(c) for c in np.random.default_rng(colours).integers(0, 1 << 32, colours)]
    index = np.random.default_rng(1).integers(0, colours, (7, 13))
    bits = 3 if colours <= 2 else 2 if colours <= 4 else 1 if colours <= 16 else 0
    rows = [[sum(int(v) << k * (8 >> bits) for k, v in enumerate(row[x : x + (1 << bits)])) << 8 for x in range(0, 13, 1 << bits)] for row in index]
    steps, before = [], [0, 0, 0, 0]
    for c in table:
        a, r, g, b = ((v - p) & 255 for v, p in zip(split(c), before, strict=True))
        steps.append(a << 24 | r << 16 | g << 8 | b)
        before = split(c)
    w = start(13, 7)
    w.put(1, 1), w.put(3, 2), w.put(colours - 1, 8)
    w.image([steps])
    w.put(0, 1)
    w.image(rows, True, 0, (1,))
    assert (webp.decode(w.file()) == np.array(table)[index]).all()


def test_damage_raises():
    good = webp.encode_many([np.arange(192, dtype=np.uint8)], 192)[0]
    for bad in (b"", good[:30], b"RIFF" + good[4:8] + b"WEBPVP8 " + good[16:], good[:20] + b"\x30" + good[21:]):
        with pytest.raises(ValueError):
            webp.decode(bad)
        with pytest.raises(ValueError):
            webp.decode_many([bad])
    with pytest.raises(ValueError):
        media.files_of(good[:-1])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=900), st.tuples(st.binary(min_size=1, max_size=5), st.integers(1, 400)).map(lambda x: x[0] * x[1])), min_size=1, max_size=5))
def test_round_trip(values):
    samples = [np.frombuffer(v.ljust(-(-max(1, len(v)) // 48) * 48, b" "), np.uint8) for v in values]
    files = webp.encode_many(samples, 48)
    for want, file, many in zip(samples, files, webp.decode_many(files), strict=True):
        for got in (webp.decode(file), many):
            assert (got >> 8 & 255).ravel().tolist() == want.tolist() and (got >> 24 == 255).all()


def test_code_lengths_are_bounded_and_complete():
    for counts in ([1, 1], [1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 1 << 20], list(range(1, 257))):
        lengths = webp.code_lengths(counts)
        assert max(lengths) <= webp.MAX_LENGTH and sum(2.0**-n for n in lengths) == 1


def check(df, out):
    texts = {}
    for r in df.collect():
        texts.setdefault(r.doc_id, set()).add(r.text or "")
    rows = out.collect()
    assert len(rows) == df.count()
    for r in rows:
        ok = [t for t in texts[r.doc_id] if hashlib.sha256(media.payload_of(t)).hexdigest() == r.payload_sha256]
        assert len(ok) == 1
        p = media.payload_of(ok[0])
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(ok[0].encode()), len(p), zlib.crc32(p[-16:])) and len(p) % 192 == 0 < len(p)
        assert r.feature == media.feature(p)
        stored = media.to_media([ok[0]])[0]
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())


def test_media_column(documents, odd, empty):
    for df in (documents.limit(60), odd):
        check(df, media.media_features(media.media_column(df)))
    assert media.media_features(media.media_column(empty)).count() == 0
    assert "entropy=0.0000" in media.feature(media.payload_of(""))
