"""GIF media columns: whole payloads as timed frames, LZW in both directions, colour histograms.

The decoder handles any GIF87a/89a stream: global and local palettes, interlacing,
transparency, the four disposal methods and deferred clear codes. LZW code streams
are decoded with array operations over many segments at once: between two clear codes
the width of every code depends only on its ordinal, and a code above the alphabet
repeats output that began with an earlier code, so whole segments resolve by pointer doubling.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hostlake.llm.runtime import staged, table

#: Frame geometry and timing of stored payloads.
WIDTH, HEIGHT, DELAY_CS = 64, 64, 4
#: Bins of the colour histogram (of the mean of red, green and blue).
BINS = 16
#: Largest LZW code + 1.
FULL = 4096
#: Pixels of a canvas or image; a header that asks for more counts as damage.
PIXELS = 1 << 24


def _widths(first_bits: int, count: int) -> np.ndarray:
    """Bits of the codes 0, 1, ... that follow a clear code.

    Before code j a decoder holds j - 1 entries of its own, so the next free code is
    clear + 2 + max(j - 1, 0); the width grows once that no longer fits, up to 12.
    """
    free = (1 << (first_bits - 1)) + 2 + np.maximum(np.arange(count) - 1, 0)
    return np.minimum(np.maximum(np.floor(np.log2(free)).astype(np.int64) + 1, first_bits), 12)


def lzw_encode(data: bytes, min_size: int = 8) -> bytes:
    """LZW code stream of ``data`` (samples below 2**min_size), cleared whenever the table is full."""
    clear = 1 << min_size
    segments: list[list[int]] = []
    codes: list[int] = []
    known: dict[int, int] = {}
    get = known.get
    free = clear + 2
    prefix = -1
    for b in data:
        if prefix < 0:
            prefix = b
            continue
        key = prefix << 8 | b
        code = get(key)
        if code is not None:
            prefix = code
            continue
        codes.append(prefix)
        prefix = b
        if free < FULL:
            known[key] = free
            free += 1
        else:
            codes.append(clear)
            segments.append(codes)
            codes = []
            known.clear()
            free = clear + 2
    if prefix >= 0:
        codes.append(prefix)
    codes.append(clear + 1)
    segments.append(codes)
    longest = max(map(len, segments))
    width = _widths(min_size + 1, longest)
    value = np.concatenate([[clear], *segments]).astype(np.int64)
    bits = np.concatenate([[min_size + 1], *(width[: len(s)] for s in segments)])
    at = np.cumsum(bits) - bits
    size = int(at[-1] + bits[-1] + 7) // 8
    shifted = value << (at & 7)
    out = np.zeros(size + 3)
    for k in range(3):
        out += np.bincount((at >> 3) + k, (shifted >> 8 * k) & 255, size + 3)
    return out[:size].astype(np.uint8).tobytes()


def _segments(raw: np.ndarray, min_size: int, limit: int) -> Iterator[np.ndarray]:
    """Codes of a stream between clear codes."""
    clear = 1 << min_size
    raw = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.int64)
    total = (len(raw) - 8) * 8
    widths = _widths(min_size + 1, 64)
    pos = 0
    while pos < total and limit > 0:
        need = 4096
        while True:
            if len(widths) < need:
                widths = _widths(min_size + 1, need)
            at = pos + np.concatenate([[0], np.cumsum(widths[: need - 1])])
            fit = at + widths[:need] <= total
            at, w = at[fit], widths[:need][fit]
            if not len(at):
                return
            i = at >> 3
            code = ((raw[i] | raw[i + 1] << 8 | raw[i + 2] << 16) >> (at & 7)) & ((1 << w) - 1)
            stop = np.flatnonzero((code == clear) | (code == clear + 1))
            if len(stop) or len(at) < need:
                break
            need *= 4  # a clear code may be deferred
        end = stop[0] if len(stop) else len(code)
        if end:
            yield code[:end]
            limit -= end
        if not len(stop) or code[end] == clear + 1:
            return
        pos = int(at[end] + w[end])


def lzw_decode(streams: list[tuple[bytes, int, int]]) -> list[bytes]:
    """Samples of several LZW code streams, each given with its minimum code size and length in samples."""
    parts: list[np.ndarray] = []
    owner: list[int] = []
    base: list[np.ndarray] = []
    literals: list[np.ndarray] = []
    count = 0
    for k, (raw, min_size, samples) in enumerate(streams):
        clear = 1 << min_size
        for code in _segments(np.frombuffer(raw, np.uint8), min_size, samples):
            j = np.arange(len(code))
            back = code - clear - 2  # the code whose output, and one sample more, this one repeats
            literal = code < clear
            # entries exist for codes 0 .. min(j, 4096 - clear - 2) - 1
            bad = ~literal & ((back < 0) | (back >= np.minimum(j, FULL - clear - 2)))
            if bad.any():
                end = int(bad.argmax())
                code, back, literal = code[:end], back[:end], literal[:end]
            if not len(code):
                continue
            parts.append(code)
            literals.append(literal)
            base.append(np.where(literal, -1, back + count))
            owner += [k] * len(code)
            count += len(code)
    if not count:
        return [b"" for _ in streams]
    code, parent, literal, own = np.concatenate(parts), np.concatenate(base), np.concatenate(literals), np.array(owner)
    length = np.ones(count, np.int64)
    up = parent.copy()
    while (live := np.flatnonzero(up >= 0)).size:  # depth in the tree of repeats, by pointer doubling
        before, jump = length[up[live]].copy(), up[up[live]].copy()
        length[live] += before
        up[live] = jump
    start = np.cumsum(length) - length
    total = int(start[-1] + length[-1])
    which = np.repeat(np.arange(count), length)
    offset = np.arange(total) - start[which]
    source = np.where(literal[which], np.arange(total), start[np.maximum(parent, 0)][which] + offset)
    while ((nxt := source[source]) != source).any():
        source = nxt
    out = np.where(literal, code, 0)[which[source]].astype(np.uint8)
    ends = np.searchsorted(own[which], np.arange(len(streams) + 1))
    return [out[ends[k] : ends[k + 1]][: streams[k][2]].tobytes() for k in range(len(streams))]


@dataclass
class Frame:
    """One timed frame: the samples of its own rectangle and the composed RGB canvas."""

    delay_cs: int
    disposal: int
    transparent: int
    box: tuple[int, int, int, int]
    samples: np.ndarray
    canvas: np.ndarray


def _sub_blocks(raw: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while at < len(raw) and (n := raw[at]):
        out.append(raw[at + 1 : at + 1 + n])
        at += n + 1
    return b"".join(out), at + 1


def _parsed(raw: bytes) -> tuple[tuple[int, int], list[tuple], list[tuple[bytes, int, int]]]:
    """Canvas size, image headers and code streams of a GIF; what follows a damaged block is left out."""
    if raw[:6] not in (b"GIF87a", b"GIF89a") or len(raw) < 13:
        return (0, 0), [], []
    w, h, flags, _, _ = struct.unpack_from("<HHBBB", raw, 6)
    if w * h > PIXELS:
        return (0, 0), [], []
    at, shared = 13, None
    if flags & 128:
        n = 2 << (flags & 7)
        shared = np.frombuffer(raw[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
        at += 3 * n
    images, streams = [], []
    control = (0, 0, -1)
    while at < len(raw) and raw[at] != 0x3B:
        if raw[at] == 0x21 and at + 1 < len(raw):
            body, end = _sub_blocks(raw, at + 2)
            if raw[at + 1] == 0xF9 and len(body) >= 4:
                control = (body[1] | body[2] << 8, body[0] >> 2 & 7, body[3] if body[0] & 1 else -1)
            at = end
        elif raw[at] == 0x2C and at + 10 < len(raw):
            x, y, iw, ih, f = struct.unpack_from("<HHHHB", raw, at + 1)
            at += 10
            own = shared
            if f & 128:
                n = 2 << (f & 7)
                own = np.frombuffer(raw[at : at + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(n, 3)
                at += 3 * n
            if at >= len(raw) or not 1 <= raw[at] <= 8 or iw * ih > PIXELS:
                break
            size = raw[at]
            body, at = _sub_blocks(raw, at + 1)
            images.append((control, (x, y, iw, ih), bool(f & 64), own))
            streams.append((body, size, iw * ih))
            control = (0, 0, -1)
        else:
            break
    return (w, h), images, streams


def _composed(size: tuple[int, int], images: list[tuple], decoded: list[bytes]) -> Iterator[Frame]:
    w, h = size
    canvas = np.zeros((h, w, 3), np.uint8)
    for ((delay, disposal, transparent), (x, y, iw, ih), interlaced, palette), raw in zip(images, decoded, strict=True):
        pixels = np.frombuffer(raw.ljust(iw * ih, b"\0"), np.uint8).reshape(ih, iw)
        if interlaced:
            order = np.concatenate([np.arange(s, ih, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        before = canvas.copy() if disposal == 3 else None
        colours = palette if palette is not None else np.zeros((1, 3), np.uint8)
        part = pixels[: max(h - y, 0), : max(w - x, 0)]
        rgb = colours[np.minimum(part, len(colours) - 1)]
        room = canvas[y : y + part.shape[0], x : x + part.shape[1]]
        shown = part != transparent
        room[shown] = rgb[shown]
        yield Frame(delay, disposal, transparent, (x, y, iw, ih), pixels, canvas.copy())
        if disposal == 2:
            room[:] = 0
        elif disposal == 3:
            canvas = before


def decode_gifs(raws: list[bytes]) -> list[list[Frame]]:
    """Frames of several GIFs; all their code streams are decoded together."""
    heads = [_parsed(r or b"") for r in raws]
    decoded = lzw_decode([s for _, _, streams in heads for s in streams])
    out, at = [], 0
    for size, images, streams in heads:
        out.append(list(_composed(size, images, decoded[at : at + len(streams)])))
        at += len(streams)
    return out


#: The identity grey palette: sample i shows as colour (i, i, i).
GREY = bytes(c for i in range(256) for c in (i, i, i))
#: The palette of its own that every fourth frame has.
WARM = bytes(c for i in range(256) for c in (i, i * 3 // 4, i // 2))


def encode_gif(payload: bytes) -> bytes:
    """A GIF89a whose frames hold ``payload`` (a positive multiple of 64 bytes) row by row as samples.

    Frames show what they hold in shades of grey, every fourth in a palette of its own. They stay, are cleared or give way to
    what was before, in turn; the padding (byte 0) of the last frame is transparent. Samples are the same whatever a frame shows.
    """
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(HEIGHT, len(payload) // WIDTH), 0xF7, 0, 0), GREY]
    for at in range(0, len(payload), WIDTH * HEIGHT):
        part, k = payload[at : at + WIDTH * HEIGHT], at // (WIDTH * HEIGHT)
        last = at + len(part) == len(payload)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", (1 + k % 3) << 2 | last, DELAY_CS, 0, 0))
        palette = WARM if k % 4 == 3 else b""
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0x87 if palette else 0) + palette + b"\x08")
        codes = lzw_encode(part)
        out += [bytes([len(c)]) + c for c in (codes[i : i + 255] for i in range(0, len(codes), 255))]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


def padded(data: bytes) -> bytes:
    return data + b"\0" * (64 - len(data) if not data else -len(data) % 64)


def stored_media(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Each whole text (null: empty) as a GIF: the id, ``n_bytes`` unpadded and ``media`` (binary).

    The UTF-8 bytes, zero-padded to a positive multiple of 64, are the samples of frames
    64 wide and up to 64 high. One output row per input row, ids may repeat or be null; an
    empty table gives an empty result and further columns are ignored.
    """

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 256):
                own = [t.as_py() or b"" for t in texts[at : at + 256]]
                yield pa.RecordBatch.from_arrays(
                    [ids[at : at + 256], pa.array(map(len, own), pa.int64()), pa.array([encode_gif(padded(d)) for d in own], pa.binary())],
                    names=[id_col, "n_bytes", "media"],
                )

    schema = docs.select(id_col, F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema
    return docs.select(id_col, text).mapInArrow(store, schema)


def _batches_by_bytes(sizes: list[int], most: int) -> Iterator[slice]:
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


#: Columns of a frame table after the id: place and time, geometry, histogram and the samples.
FRAME_COLUMNS = "frame int, start_cs long, delay_cs int, disposal int, transparent int, x int, y int, width int, height int, histogram array<long>, samples binary"


#: Fields of a frame in a row of digests.
FRAME = ("start_cs", "delay_cs", "disposal", "transparent", "x", "y", "width", "height", "histogram")


def histogram(canvas: np.ndarray) -> np.ndarray:
    return np.bincount((canvas.astype(np.int64).sum(2) // 3 * BINS // 256).ravel(), minlength=BINS)


def gif_frames(media: DataFrame, id_col: str = "doc_id", content: str = "media") -> DataFrame:
    """One row per frame of every GIF: when it starts and how long it stays, its rectangle and
    own samples, and the colour histogram of the composed canvas (after disposal and transparency).

    A null or damaged GIF gives the frames before the damage, perhaps none; a canvas or image of more than PIXELS counts as
    damage. Ids may repeat or be null, an empty table gives an empty result and further columns are ignored.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, *(c.split()[0] for c in FRAME_COLUMNS.split(", "))]
        for batch in batches:
            raws = [r or b"" for r in batch.column(1).to_pylist()]
            for part in _batches_by_bytes([len(r) for r in raws], 1 << 20):
                rows: list[tuple] = []
                at: list[int] = []
                for i, frames in enumerate(decode_gifs(raws[part]), part.start):
                    time = 0
                    for k, f in enumerate(frames):
                        rows.append((k, time, f.delay_cs, f.disposal, f.transparent, *f.box, histogram(f.canvas), f.samples.tobytes()))
                        at.append(i)
                        time += f.delay_cs
                if rows:
                    kinds = [pa.int32(), pa.int64(), *[pa.int32()] * 7, pa.list_(pa.int64()), pa.binary()]
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

    one = media.select(id_col, content)
    return one.mapInArrow(each, f"`{id_col}` {dict(one.dtypes)[id_col]}, {FRAME_COLUMNS}")


def media_digests(media: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of what :func:`stored_media` wrote, computed from the stored bytes read back, and its timed ``frames`` with their colour histograms.

    A row per row; a damaged GIF gives the payload of the frames before the damage. Ids may repeat or be null.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = [r or b"" for r in batch.column(2).to_pylist()]
            out: list[tuple] = []
            for part in _batches_by_bytes([len(r) for r in raws], 1 << 20):
                for raw, frames in zip(raws[part], decode_gifs(raws[part]), strict=True):
                    payload = b"".join(f.samples.tobytes() for f in frames)
                    bins = sum((histogram(f.canvas) for f in frames), np.zeros(BINS, np.int64))
                    starts = np.cumsum([0, *(f.delay_cs for f in frames)]).tolist()
                    time = starts[-1]
                    timed = [dict(zip(FRAME, (t, f.delay_cs, f.disposal, f.transparent, *f.box, histogram(f.canvas)), strict=True)) for t, f in zip(starts, frames, strict=False)]
                    out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(raw), hashlib.sha256(raw).hexdigest(), f"frames={len(frames)};time_cs={time};grey={','.join(map(str, bins))}", timed))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([(n, pa.int64() if n == "start_cs" else pa.list_(pa.int64()) if n == "histogram" else pa.int32()) for n in FRAME]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(list(c), t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, kinds, strict=True))], names=names)

    names = [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames"]
    kind = dict(media.dtypes)[id_col]
    frame = ", ".join(f"{n}: {'bigint' if n == 'start_cs' else 'array<bigint>' if n == 'histogram' else 'int'}" for n in FRAME)
    return media.select(id_col, "n_bytes", "media").mapInArrow(each, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames array<struct<{frame}>>")


def op2_gif(spark, sf_dir: str) -> DataFrame:
    return media_digests(staged(stored_media(table(spark, sf_dir, "documents"))))


QUERIES = {"op2_gif": op2_gif}
