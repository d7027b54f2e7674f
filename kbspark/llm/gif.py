"""GIF columns: bytes stored as 8-bit samples, and GIF bytes decoded to timed frames.

``encode`` writes each byte string as an animation 64 pixels wide: the bytes are padded with zeros to a
positive multiple of 64 and shown in frames of up to 64 rows, one over the other, a tenth of a second each. Sample 0brrrgggbb has the colour of
these bits, so colours give the samples back. A frame is laid over the one before and leaves it; where it would not change a pixel, and
sample 255 is free (it always is in UTF-8), it is transparent. Its LZW codes grow from nine to twelve bits, and a full table is cleared.
``decode`` reads any GIF: LZW code streams, global and local palettes, interlacing, disposal and
transparency, and makes a row of each frame: its time, its area, and a histogram of the canvas in 64 colours.

Null bytes or text encode as the empty string (64 zero samples). Null or malformed media decode to a
null payload and no frames. Columns that exist already are replaced; the others pass through. Repeated rows are stored each, an empty
table gives an empty table. Long texts have as many frames as they need; a task holds one such text and its pixels at a time, beside a batch of short ones.
"""

from __future__ import annotations

import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kbspark.llm.common import batch_rows, offsets_of, replace_columns, schema_with, slices

WIDTH, ROWS = 64, 64
CLEAR, END, FREE, FULL = 256, 257, 258, 4096
#: Codes that are read at once.
MOST_CODES = 8192
BITS = np.arange(12)
#: A sample that no UTF-8 text has, and hundredths of a second for which a frame stands.
UNUSED, DELAY = 255, 10
FRAME = "struct<no:int,start_ms:long,delay_ms:long,left:int,top:int,width:int,height:int,histogram:array<long>>"
FRAME_ARROW = pa.list_(
    pa.struct([("no", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("histogram", pa.list_(pa.int64()))])
)


def padded(data: bytes) -> bytes:
    return data + bytes(max(WIDTH - len(data), -len(data) % WIDTH))


def codes_of(samples: bytes) -> list[int]:
    """The LZW codes of at least one sample, with clear and end codes."""
    out, known, free, last = [CLEAR], {}, FREE, samples[0]
    put = out.append
    for b in samples[1:]:
        pair = last << 8 | b
        if pair in known:
            last = known[pair]
            continue
        put(last)
        known[pair] = free
        free += 1
        last = b
        if free == FULL:
            put(CLEAR)
            known, free = {}, FREE
    return [*out, last, END]


@lru_cache(maxsize=16)
def widths(least: int) -> np.ndarray:
    """Bits of the first, second, ... code after a clear code; all but the first code add an entry."""
    grown = (1 << least) + 2 + np.maximum(np.arange(MOST_CODES) - 1, 0)
    return np.clip(np.frexp(grown)[1], least + 1, 12).astype(np.int64)


def code_stream(samples: bytes) -> bytes:
    """The codes of some samples, the lowest bit first, in sub-blocks of at most 255 bytes."""
    codes = np.array(codes_of(samples), dtype=np.uint16)
    clear = np.flatnonzero(codes == CLEAR)
    since = np.arange(-1, len(codes) - 1)
    if len(clear) > 1:  # a clear code still counts with those before it
        since = since - np.repeat(np.r_[0, clear], np.diff(np.r_[0, clear + 1, len(codes)]))
    since[0] = 0
    bits = (codes[:, None] >> BITS & 1).astype(np.uint8)[BITS < widths(8)[since][:, None]]
    data = np.packbits(bits, bitorder="little").tobytes()
    return b"".join(bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)) + b"\0"


def palette() -> bytes:
    """Three bits of red, three of green, two of blue: every sample has a colour of its own."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], axis=1).astype(np.uint8).tobytes()


def samples_of(colours: np.ndarray) -> np.ndarray:
    """The samples of colours of the palette."""
    return colours[..., 0] & 0xE0 | colours[..., 1] >> 5 << 2 | colours[..., 2] >> 6


def encode_bytes(data: bytes) -> bytes:
    data, size = padded(data), WIDTH * ROWS
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(len(data) // WIDTH, ROWS), 0xF7, 0, 0), palette()]
    for begin in range(0, len(data), size):
        part, clear = data[begin : begin + size], begin > 0 and UNUSED not in data[begin : begin + size]
        if clear:
            new = np.frombuffer(part, dtype=np.uint8)
            drawn = np.where(new == np.frombuffer(data, dtype=np.uint8, count=len(part), offset=begin - size), UNUSED, new).astype(np.uint8).tobytes()
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2 | clear, DELAY, UNUSED if clear else 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + code_stream(drawn if clear else part))
    return b"".join(out) + b"\x3b"


def _codes(raw: bytes, least: int):
    """Yields the codes after each clear code, up to the end code."""
    data = np.frombuffer(raw + b"\0\0\0", dtype=np.uint8).astype(np.uint32)
    word = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    clear, bit, total, table = 1 << least, 0, 8 * len(raw), widths(least)
    offset = offsets_of(table)
    found: list[np.ndarray] = []
    done = 0
    while True:
        many = (total - bit) // (least + 1) + 1
        ends = bit + offset[done + 1 : done + 1 + many] - offset[done] if done < MOST_CODES else bit + 12 * np.arange(1, min(many, MOST_CODES) + 1)
        ends = ends[: np.searchsorted(ends, total, side="right")]
        size = table[done : done + len(ends)] if done < MOST_CODES else np.full(len(ends), 12)
        at = ends - size
        codes = word[at >> 3] >> (at & 7).astype(np.uint32) & ((1 << size) - 1).astype(np.uint32)
        mark = np.flatnonzero((codes == clear) | (codes == clear + 1))[:1]
        if not len(mark):
            found.append(codes)
            if not len(codes):
                break
            done, bit = done + len(codes), int(ends[-1])
            continue
        found.append(codes[: mark[0]])
        yield np.concatenate(found).tolist()
        if codes[mark[0]] != clear:
            return
        found, done, bit = [], 0, int(ends[mark[0]])
    yield np.concatenate(found).tolist()


def lzw(raw: bytes, least: int) -> np.ndarray:
    """The samples of a code stream; raises ValueError for codes that no entry has."""
    start = [bytes([i & 255]) for i in range(1 << least)] + [b"", b""]
    out: list[bytes] = []
    put = out.append
    for codes in _codes(raw, least):
        if not codes:
            continue
        if codes[0] >= 1 << least:
            raise ValueError("a code that is not in the table")
        table, last = start.copy(), start[codes[0]]
        add = table.append
        put(last)
        for code in codes[1 : FULL - len(start) + 1]:
            try:
                entry = table[code]
            except IndexError:  # the entry that this code adds
                if code > len(table):
                    raise ValueError("a code that is not in the table") from None
                entry = last + last[:1]
            add(last + entry[:1])
            put(entry)
            last = entry
        for code in codes[FULL - len(start) + 1 :]:  # the table is full
            put(table[code])
    return np.frombuffer(b"".join(out), dtype=np.uint8)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    out = []
    while True:
        n = data[at]
        if n == 0:
            return b"".join(out), at + 1
        out.append(data[at + 1 : at + 1 + n])
        at += 1 + n


def decode_bytes(data: bytes):
    """Yields (frame fields, canvas as rows x columns x RGBA) for every image of a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("no GIF")
    wide, high, flags = struct.unpack("<HHB", data[6:11])
    at, common = 13, None
    if flags & 0x80:
        n = 3 << ((flags & 7) + 1)
        common, at = np.frombuffer(data[at : at + n], dtype=np.uint8).reshape(-1, 3), at + n
    canvas = np.zeros((high, wide, 4), dtype=np.uint8)
    no, clock, dispose, delay, clear_index = 0, 0, 0, 0, None
    while data[at] != 0x3B:
        if data[at] == 0x21:
            kind = data[at + 1]
            body, after = _blocks(data, at + 2)
            if kind == 0xF9:
                packed, hundredths, index = struct.unpack("<BHB", body[:4])
                dispose, delay, clear_index = packed >> 2 & 7, 10 * hundredths, index if packed & 1 else None
            at = after
            continue
        if data[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack("<HHHHB", data[at + 1 : at + 10])
        at, palette = at + 10, common
        if packed & 0x80:
            n = 3 << ((packed & 7) + 1)
            palette, at = np.frombuffer(data[at : at + n], dtype=np.uint8).reshape(-1, 3), at + n
        least = data[at]
        raw, at = _blocks(data, at + 1)
        index = lzw(raw, least)[: w * h]
        if len(index) < w * h or palette is None or left + w > wide or top + h > high:
            raise ValueError("an incomplete image")
        index = index.reshape(h, w)
        if packed & 0x40:
            rows = np.concatenate([np.arange(0, h, 8), np.arange(4, h, 8), np.arange(2, h, 4), np.arange(1, h, 2)])
            index = index[np.argsort(rows, kind="stable")]
        kept = canvas.copy() if dispose == 3 else None
        area = canvas[top : top + h, left : left + w]
        shown = np.ones(index.shape, bool) if clear_index is None else index != clear_index
        colour = np.empty((h, w, 4), dtype=np.uint8)
        colour[..., :3] = palette[np.minimum(index, len(palette) - 1)]
        colour[..., 3] = 255
        if clear_index is None:
            area[...] = colour
        else:
            area[shown] = colour[shown]
        flat = canvas.reshape(-1, 4)
        bins = (flat[:, 0] >> 6) << 4 | (flat[:, 1] >> 6) << 2 | flat[:, 2] >> 6
        yield {"no": no, "start_ms": clock, "delay_ms": delay, "left": left, "top": top, "width": w, "height": h, "histogram": np.bincount(bins, minlength=64).tolist()}, canvas
        if dispose == 2:
            area[...] = 0
        elif dispose == 3:
            canvas = kept
        no, clock = no + 1, clock + delay
        dispose, delay, clear_index = 0, 0, None


def read_back(data: bytes | None) -> tuple[bytes | None, list[dict]]:
    """The samples of the colours in every frame's own area one after the other, and the frames."""
    if data is None:
        return None, []
    frames, samples = [], []
    try:
        for f, canvas in decode_bytes(data):
            frames.append(f)
            samples.append(samples_of(canvas[f["top"] : f["top"] + f["height"], f["left"] : f["left"] + f["width"]]).tobytes())
    except (ValueError, IndexError, struct.error):
        return None, []
    return b"".join(samples), frames


def encode(df: DataFrame, column: str = "text", media: str = "media") -> DataFrame:
    """Adds the GIF that stores the bytes of a text or binary column."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, column):
                values = batch.column(column).cast(pa.large_binary()).to_pylist()
                yield replace_columns(batch, {media: pa.array([encode_bytes(v or b"") for v in values], type=pa.binary())})

    batch_rows(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{media: "binary"}))


def decode(df: DataFrame, media: str = "media", payload: str = "payload", frames: str = "frames") -> DataFrame:
    """Adds the samples of a GIF column and its timed frames with 64-bin colour histograms of the canvas."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, media):
                done = [read_back(v) for v in batch.column(media).to_pylist()]
                yield replace_columns(batch, {payload: pa.array([p for p, _ in done], type=pa.binary()), frames: pa.array([f for _, f in done], type=FRAME_ARROW)})

    batch_rows(df.sparkSession)
    return df.mapInArrow(run, schema_with(df, **{payload: "binary", frames: f"array<{FRAME}>"}))
