import base64
import hashlib
import zlib

import numpy as np
import pytest

from subspan.llm.webp import CROSS_COLOUR, PALETTE, PREDICTOR, SUBTRACT_GREEN, Image, container, load, media, open_stream, prepared, read_images, shape_of, store, write_entropy
from tests.llm.fixtures import documents, empty, odd_texts

W, H = 37, 23


def pixels(seed=1):
    rng = np.random.default_rng(seed)
    px = rng.integers(0, 1 << 32, W * H, dtype=np.uint32)
    px[100:300], px[400:700] = px[0:200], px[400]
    return px


def round_trip(px, steps, cache_bits, references=True):
    image = prepared(px, W, H, steps)
    image.head = [(0x2F, 8), (W - 1, 14), (H - 1, 14), (1, 1), (0, 3), *image.head, (0, 1)]
    stream, n = write_entropy([image], cache_bits, references)[0]
    got, w, h = read_images([container(stream[: -(-n // 8)])])[0]
    return (w, h) == (W, H) and bool((got == px).all())


def test_file_of_another_writer():
    (px, w, h), = read_images([base64.b64decode("UklGRhoAAABXRUJQVlA4TA0AAAAvAAAAEAcQERGIiP4HAA==")])
    assert (w, h, px.tolist()) == (1, 1, [0])


@pytest.mark.parametrize("cache_bits", [0, 1, 5, 11])
@pytest.mark.parametrize("references", [True, False])
def test_cache_and_references(cache_bits, references):
    assert round_trip(pixels(), (), cache_bits, references)


def test_predictors():
    modes = np.random.default_rng(2).integers(0, 14, (6, 10))
    assert round_trip(pixels(), (("predictor", modes, 2),), 4)
    assert all(round_trip(pixels(), (("predictor", np.full((6, 10), k), 2),), 0) for k in range(14))


def test_colour_transforms_together():
    rng = np.random.default_rng(3)
    cross, modes = rng.integers(0, 256, (6, 10, 3)), rng.integers(0, 14, (6, 10))
    assert round_trip(pixels(), (("cross", cross, 2),), 4)
    assert round_trip(pixels(), (("green",), ("predictor", modes, 2), ("cross", cross, 2)), 4)


@pytest.mark.parametrize("colours", [1, 2, 3, 4, 7, 16, 17, 200, 256])
def test_palettes(colours):
    rng = np.random.default_rng(colours)
    px = rng.choice(rng.integers(0, 1 << 32, colours, dtype=np.uint32), W * H)
    assert round_trip(px, (("palette",),), 3)


def test_inverse_predictor_by_definition():
    """Modes 1, 2 and 11 undone by a plain loop."""
    from subspan.llm.webp import inverse_predictor

    rng = np.random.default_rng(4)
    res = rng.integers(0, 1 << 32, 35, dtype=np.uint32)
    for mode in (1, 2, 11):
        out = []
        for i, r in enumerate(res.tolist()):
            y, x = divmod(i, 7)
            c = [r >> s & 255 for s in (24, 16, 8, 0)]
            if i == 0:
                p = [255, 0, 0, 0]
            elif y == 0:
                p = out[i - 1]
            elif x == 0:
                p = out[i - 7]
            else:
                left, top, corner = out[i - 1], out[i - 7], out[i - 8]
                guess = [a + b - c_ for a, b, c_ in zip(left, top, corner)]
                nearer = sum(abs(g - a) for g, a in zip(guess, left)) < sum(abs(g - b) for g, b in zip(guess, top))
                p = left if mode == 1 else top if mode == 2 else (left if nearer else top)
            out.append([(a + b) & 255 for a, b in zip(c, p)])
        got = inverse_predictor(res, 7, 5, np.full((5, 7), mode), 0)
        assert got.tolist() == [a << 24 | r << 16 | g << 8 | b for a, r, g, b in out]


def test_broken_files_raise():
    good = store([b"abcd" * 16 + b"wxyz" * 16])[0]
    with pytest.raises(ValueError):
        read_images([b"RIFF" + good[4:8] + b"WEBPVP8 " + good[16:]])
    with pytest.raises(ValueError):
        read_images([good[:20] + b"\0" + good[21:]])


def test_damaged_files_are_told_apart():
    raw = [np.random.default_rng(i).bytes(64 * 50) for i in range(6)]
    files = store(raw)
    bad = [files[0][:-40], files[1][:30], b"", files[3][:-60] + b"\xff" * 60, files[4][:16] + (len(files[4]) - 80).to_bytes(4, "little") + files[4][20:]]
    for f in bad[:3] + bad[4:]:
        with pytest.raises(ValueError):
            read_images([f])
    got = read_images([files[5], *bad, files[2]], skip=True)
    assert [g is None for g in (got[0], got[1], got[2], got[3], got[5], got[6])] == [False, True, True, True, True, False]
    assert load([files[5], files[2]], [3200, 3200]) == [raw[5], raw[2]]
    rng = np.random.default_rng(9)
    for _ in range(60):  # whatever the damage, the neighbours come back
        f = bytearray(files[int(rng.integers(6))])
        for at in rng.integers(20, len(f), 3):
            f[at] ^= int(rng.integers(1, 256))
        one, _, other = read_images([files[0], bytes(f), files[1]], skip=True)
        assert (one[0] == read_images([files[0]])[0][0]).all() and (other[0] == read_images([files[1]])[0][0]).all()


def test_all_transforms_are_stored():
    raw = [r for i in range(8000) if zlib.crc32(r := np.random.default_rng(i).bytes(64 * (1 + i % 90))) % 512 < 4]
    kinds = set()
    for f in store(raw):
        kinds |= {k for k, *_ in open_stream(f)[1]}
    kinds |= {k for k, *_ in open_stream(store([b"ab" * 320])[0])[1]}
    assert kinds == {PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN, PALETTE}
    assert load(store(raw), [len(r) for r in raw]) == raw


def test_no_payload_goes_without_a_transform():
    raw = [np.random.default_rng(i).bytes(64 * (5 + i % 40)) for i in range(80)]  # fewer pixels would get a palette
    kinds = [frozenset(k for k, *_ in open_stream(f)[1]) for f in store(raw)]
    assert set(kinds) == {frozenset({PREDICTOR}), frozenset({CROSS_COLOUR}), frozenset({SUBTRACT_GREEN}), frozenset({PREDICTOR, CROSS_COLOUR, SUBTRACT_GREEN})}
    assert min(map(kinds.count, kinds)) >= 8
    assert load(store(raw), [len(r) for r in raw]) == raw


def test_payloads_mixed():
    raw = [b"\0" * 64, b"a" * 64, bytes(range(256)) * 8, b"x" * (16384 * 64 + 64), np.random.default_rng(5).bytes(64 * 999)]
    files = store(raw)
    assert load(files, [len(r) for r in raw]) == raw
    assert files == [store([r])[0] for r in raw]  # alone or together
    assert shape_of(64) == (16, 1) and shape_of(16384 * 64 + 64)[0] == 32


def test_operator(spark):
    texts = odd_texts()
    got = media(documents(spark), files=True).collect()
    assert len(got) == len(texts) + 1
    by_text = {}
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert (r["media_bytes"], r["media_sha256"]) == (len(r["media"]), hashlib.sha256(r["media"]).hexdigest())
        assert by_text.setdefault(raw, r[1:]) == r[1:]
    assert media(empty(spark)).collect() == []


def test_files_of_a_group_go_together(monkeypatch):
    """The images inside the heads cost calls by group, not by file."""
    from subspan.llm import webp

    calls = {}
    for name in ("write_entropy", "read_tokens"):
        monkeypatch.setattr(webp, name, lambda *a, _f=getattr(webp, name), _n=name, **k: calls.update({_n: calls.get(_n, 0) + 1}) or _f(*a, **k))
    made = []
    for n in (40, 160):
        raw = [np.random.default_rng(i).bytes(64 * 30) for i in range(n)]
        assert load(store(raw), [len(r) for r in raw]) == raw
        made.append(dict(calls))
        calls.clear()
    assert made[0] == made[1] and made[0]["write_entropy"] <= 3 and made[0]["read_tokens"] <= 8


def plain_prediction(mode, left, top, right, corner):
    mean = lambda a, b: [(x + y) // 2 for x, y in zip(a, b)]
    guess = [a + b - c for a, b, c in zip(left, top, corner)]
    if mode == 11:
        return left if sum(abs(g - a) for g, a in zip(guess, left)) < sum(abs(g - b) for g, b in zip(guess, top)) else top
    if mode == 12:
        return [min(255, max(0, g)) for g in guess]
    if mode == 13:
        return [min(255, max(0, a + int((a - c) / 2))) for a, c in zip(mean(left, top), corner)]
    black = [255, 0, 0, 0]
    return (black, left, top, right, corner, mean(mean(left, right), top), mean(left, corner), mean(left, top), mean(corner, top), mean(top, right), mean(mean(left, corner), mean(top, right)), 0, 0, 0, black, black)[mode]


def test_predictors_of_many_images_by_definition():
    """All modes, in images of one width and different heights at once, undone by a plain loop."""
    from subspan.llm.webp import forward_predictors, inverse_predictors

    rng, width = np.random.default_rng(6), 9
    heights = np.array([1, 12, 3, 30, 12, 7])
    modes = rng.integers(0, 16, (heights.sum(), width))
    modes[16:46] = rng.choice([0, 2, 3, 4, 8, 9], (30, width))  # one image of modes that look at the row above only
    res = rng.integers(0, 1 << 32, modes.shape, dtype=np.uint32)
    want = []
    for begin, height in zip(np.cumsum(heights) - heights, heights):
        out = []
        for i in range(width * height):
            y, x = divmod(i, width)
            mode = 0 if i == 0 else 1 if y == 0 else 2 if x == 0 else int(modes[begin + y, x])
            at = [out[i - d] if 0 < d <= i else [0] * 4 for d in (1, width, width - 1, width + 1)]
            r = int(res[begin + y, x])
            out.append([(a + (r >> s & 255)) & 255 for a, s in zip(plain_prediction(mode, *at), (24, 16, 8, 0))])
        want += [a << 24 | r << 16 | g << 8 | b for a, r, g, b in out]
    got = inverse_predictors(res, heights, modes)
    assert got.ravel().tolist() == want
    assert (forward_predictors(got, heights, modes) == res).all()


def test_cross_colour_by_definition():
    from subspan.llm.webp import cross_colour

    rng = np.random.default_rng(7)
    px, parts = rng.integers(0, 1 << 32, (2, 500), dtype=np.uint32)
    signed = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    want = []
    for p, t in zip(px.tolist(), parts.tolist()):
        red = (p >> 16) + (signed(t) * signed(p >> 8) >> 5) & 255
        blue = p + (signed(t >> 8) * signed(p >> 8) >> 5) + (signed(t >> 16) * signed(red) >> 5) & 255
        want.append(p & 0xFF00FF00 | red << 16 | blue)
    got = cross_colour(px, parts, 1)
    assert got.tolist() == want and (cross_colour(got, parts, -1) == px).all()


def lengths_sent(tokens, size, limit=None):
    """What a reader is asked for a code whose lengths are sent as (symbol, extra bits): 13 symbols in 4 bits, 6 in 5."""
    from subspan.llm.webp import Lengths, _direct, canonical

    meta = np.array([4] * 13 + [5] * 6)
    code, value, at = canonical(meta[None])[0], 0, 3
    for symbol, extra in tokens:
        value |= int(code[symbol]) << at
        at += int(meta[symbol])
        value |= extra << at
        at += {16: 2, 17: 3, 18: 7}.get(symbol, 0)
    return Lengths(value.to_bytes(at // 8 + 1, "little"), 3, *_direct(meta), size, size if limit is None else limit), at


def test_code_lengths_in_runs():
    """Runs of a length and of zeros, a limit on what is sent, and wrong codes among good ones."""
    from subspan.llm.webp import _direct, read_lengths

    runs = [(18, 127), (17, 7), (6, 0), *[(16, 3)] * 5, (0, 0), (6, 0), (7, 0), *[(16, 3)] * 10, (16, 0), (0, 0)]
    lens = [0] * 148 + [6] * 31 + [0, 6] + [7] * 64 + [0]
    first = [(16, 0), (16, 3), (17, 0), (8, 0), *[(16, 3)] * 41]  # 8 is the length before any
    cases = [
        (lengths_sent(runs, 300, len(runs)), lens),
        (lengths_sent([*runs, *[(0, 0)] * (280 - len(lens))], 280), lens),
        (lengths_sent(first, 280, len(first)), [8] * 9 + [0] * 3 + [8] * 247),
        (lengths_sent([(0, 0), (5, 0), (18, 127)], 280, 3), [0, 5]),
        (lengths_sent([(1, 0), (3, 0), (18, 127)], 280, 3), None),
        (lengths_sent([(1, 0), (1, 0), (18, 127)], 100), None),
        (lengths_sent([(18, 127), (18, 127)], 280, 2), None),
    ]
    found, ends = read_lengths([asked for (asked, _), _ in cases])
    for ((_, end), want), got, at in zip(cases, found, ends):
        if want is None:
            assert got is None
        else:
            table, bits = _direct(np.array(want))
            assert (got[0].tolist(), got[1], at) == (table.tolist(), bits, end)


def test_large_images_use_every_mode():
    raw = next(r for i in range(40) if zlib.crc32(r := np.random.default_rng(i).bytes(64 * 16 * 20)) % 4 == 0)
    (kind, blocks, _, _), = open_stream(store([raw])[0])[1]
    assert kind == PREDICTOR and set((blocks >> 8 & 255).ravel().tolist()) == set(range(14))
    assert load(store([raw]), [len(raw)]) == [raw]


def test_images_read_together_or_one_by_one():
    """Two groups of codes by block, a cache, references and streams that end early: token by token of all images, and image by image."""
    from subspan.llm.webp import Coded, _direct, read_tokens

    rng = np.random.default_rng(8)
    mixed = np.array([9] * 256 + [4] * 4 + [0] * 20 + [4] * 4)  # literals, runs, cache
    plain, far = np.array([8] * 256), np.array([2] * 4 + [0] * 36)
    groups = [[_direct(x) for x in (green, plain, plain, plain, far)] for green in (mixed, plain)]
    images = [Coded(rng.bytes(400 if i % 5 else 60), 3, 3, 20, 2, groups, rng.integers(0, 2, 5) if i % 3 else None, 2) for i in range(200)]
    together, ends = read_tokens(images, few=0)
    assert 20 < sum(x is None for x in together) < 180
    for few in (7, 200):
        got, places = read_tokens(images, few=few)
        for x, y, a, b in zip(together, got, ends, places):
            assert (x is None and y is None) or (x.tolist(), a) == (y.tolist(), b)


def test_symbol_past_the_alphabet():
    from subspan.llm.webp import Reader, read_code

    with pytest.raises(ValueError):
        next(read_code(Reader(bytes([0b101 | 200 << 3 & 255, 200 >> 5, 0])), 40))  # one symbol, 200, among 40 distances
