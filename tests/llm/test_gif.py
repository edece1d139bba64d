from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest
from hostlake.llm import gif


def slow_decode(raw, min_size):
    """A plain code-by-code LZW decoder."""
    clear, pos, out = 1 << min_size, 0, b""
    width, entries, prev = min_size + 1, None, None
    bits = int.from_bytes(raw, "little")
    while pos + width <= 8 * len(raw):
        code = bits >> pos & ((1 << width) - 1)
        pos += width
        if code == clear:
            entries, width, prev = {i: bytes([i]) for i in range(clear)}, min_size + 1, None
            continue
        if code == clear + 1:
            break
        free = clear + 2 + len(entries) - clear
        new = entries[code] if code in entries else prev + prev[:1]
        out += new
        if prev is not None and free < 4096:
            entries[free] = prev + new[:1]
            free += 1
        if free == 1 << width and width < 12:
            width += 1
        prev = new
    return out


@pytest.mark.parametrize("size", [0, 1, 2, 63, 5000, 60000])
@pytest.mark.parametrize("kind", ["same", "text", "noise"])
def test_lzw_round_trip(size, kind):
    rng = np.random.default_rng(size)
    data = {"same": b"a" * size, "text": b"the cat and the dog " * (size // 20 + 1), "noise": rng.integers(0, 256, size).astype(np.uint8).tobytes()}[kind][:size]
    coded = gif.lzw_encode(data)
    assert slow_decode(coded, 8) == data
    assert gif.lzw_decode([(coded, 8, len(data)), (b"", 8, 0), (coded, 8, len(data) // 2)]) == [data, b"", data[: len(data) // 2]]


def test_small_alphabet_and_deferred_clear():
    rng = np.random.default_rng(0)
    data = rng.integers(0, 4, 30000).astype(np.uint8).tobytes()
    assert gif.lzw_decode([(gif.lzw_encode(data, 2), 2, len(data))]) == [data]
    # literals only, never cleared: the widths still grow to 12 bits and stay
    noise = rng.integers(0, 256, 9000).tolist()
    width = gif._widths(9, len(noise) + 1)
    value = bits = 0
    for code, w in [(256, 9), *zip([*noise, 257], width.tolist(), strict=True)]:
        value |= code << bits
        bits += w
    raw = value.to_bytes((bits + 7) // 8, "little")
    assert slow_decode(raw, 8) == bytes(noise)
    assert gif.lzw_decode([(raw, 8, 9000)]) == [bytes(noise)]


def block(x, y, w, h, pixels, disposal=0, transparent=-1, delay=5, palette=b"", interlaced=False):
    flags = (0x81 if palette else 0) | (64 if interlaced else 0)
    head = b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (transparent >= 0), delay, max(transparent, 0), 0)
    codes = gif.lzw_encode(bytes(pixels), 2)
    return head + b"\x2c" + struct.pack("<HHHHB", x, y, w, h, flags) + palette + b"\x02" + bytes([len(codes)]) + codes + b"\0"


def test_palettes_disposal_transparency_interlace():
    shared = bytes([10] * 3 + [20] * 3 + [30] * 3 + [40] * 3)
    own = bytes([1] * 3 + [2] * 3 + [3] * 3 + [4] * 3)
    raw = b"GIF89a" + struct.pack("<HHBBB", 2, 2, 0x81, 0, 0) + shared
    raw += block(0, 0, 2, 2, [0, 1, 2, 3])
    raw += block(0, 0, 2, 1, [3, 0], transparent=0, disposal=3)
    raw += block(1, 0, 1, 2, [1, 1], palette=own, disposal=2, delay=9)
    raw += block(0, 0, 1, 1, [2]) + b"\x3b"
    frames = gif.decode_gifs([raw, b"junk", None])
    assert frames[1:] == [[], []]
    assert [f.canvas[:, :, 0].tolist() for f in frames[0]] == [[[10, 20], [30, 40]], [[40, 20], [30, 40]], [[10, 2], [30, 2]], [[30, 0], [30, 0]]]
    assert [(f.delay_cs, f.disposal, f.transparent) for f in frames[0]] == [(5, 0, -1), (5, 3, 0), (9, 2, -1), (5, 0, -1)]
    rows = np.arange(8) % 4
    order = [0, 4, 2, 6, 1, 3, 5, 7]
    raw = b"GIF89a" + struct.pack("<HHBBB", 1, 8, 0x81, 0, 0) + shared + block(0, 0, 1, 8, rows[order].tolist(), interlaced=True) + b"\x3b"
    assert gif.decode_gifs([raw])[0][0].samples.ravel().tolist() == rows.tolist()
    assert len(gif.decode_gifs([raw[:-6]])[0]) <= 1


def test_huge_canvas_is_damage():
    bomb = b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + block(0, 0, 1, 1, [0]) + b"\x3b"
    image = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0, 0, 0) + block(0, 0, 65535, 65535, [0]) + b"\x3b"
    assert gif.decode_gifs([bomb, image]) == [[], []]


def test_stored_frames_use_palettes_disposal_and_transparency(spark):
    text = "".join(chr(32 + i * i % 90) for i in range(5 * gif.WIDTH * gif.HEIGHT - 10))
    docs = spark.createDataFrame([(1, text), (1, text), (None, None)], "doc_id long, text string")
    media = gif.stored_media(docs)
    frames = sorted(gif.gif_frames(media.where("doc_id = 1").limit(1)).collect(), key=lambda f: f.frame)
    assert [f.disposal for f in frames] == [1, 2, 3, 1, 2] and [f.transparent for f in frames] == [-1] * 4 + [0]
    assert b"".join(f.samples for f in frames).rstrip(b"\0").decode() == text
    rows = [r for r in gif.media_digests(media).collect() if r.doc_id == 1]
    assert len(rows) == 2 and rows[0] == rows[1]
    assert [(f.start_cs, f.disposal, f.transparent, f.histogram) for f in rows[0].frames] == [(f.start_cs, f.disposal, f.transparent, f.histogram) for f in frames]
    # the fourth frame shows in its own palette, the third gave way to what the second had left: nothing
    warm = np.frombuffer(gif.WARM, np.uint8).reshape(-1, 3)[np.frombuffer(frames[3].samples, np.uint8)]
    assert frames[3].histogram == gif.histogram(warm[None]).tolist()
    assert frames[4].histogram[0] == 0


def test_query_rows(spark, sf, tmp_path):
    rows = [(1, "héllo", "x"), (2, None, "x"), (3, "", "x"), (None, "a" * 64, "x"), (3, "b" * 200_000 + "é", None)]
    spark.createDataFrame(rows, "doc_id long, text string, media string").write.parquet(f"{tmp_path}/documents.parquet")
    got = gif.op2_gif(spark, str(tmp_path)).collect()
    plain = {(i, hashlib.sha256(p).hexdigest()): p for i, t, _ in rows for p in [gif.padded((t or "").encode())]}
    assert {(r.doc_id, r.payload_sha256) for r in got} == set(plain) and len(got) == 5
    for r in got:
        p = plain[r.doc_id, r.payload_sha256]
        assert (r.payload_bytes, r.tail_crc32) == (len(p), zlib.crc32(p[-64:])) and len(p) % 64 == 0 and p
        assert sum(map(int, r.feature.split("grey=")[1].split(","))) >= len(p)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = {r.doc_id: hashlib.sha256(gif.padded((r.text or "").encode())).hexdigest() for r in docs.collect()}
    assert {r.doc_id: r.payload_sha256 for r in gif.op2_gif(spark, sf).collect()} == want
    frames = gif.gif_frames(gif.stored_media(docs.limit(5))).collect()
    assert {len(f.histogram) for f in frames} == {gif.BINS} and all(len(f.samples) == f.width * f.height for f in frames)
    assert gif.op2_gif.__name__ and gif.media_digests(gif.stored_media(docs.limit(0))).count() == 0
