import random
import struct

from kbspark.llm import gif


def plain_lzw(samples, least):
    """The usual encoder with a growing table, one code at a time."""
    clear, out, nbits, acc = 1 << least, bytearray(), 0, 0

    def put(code, width):
        nonlocal acc, nbits
        acc |= code << nbits
        nbits += width
        while nbits >= 8:
            out.append(acc & 255)
            acc >>= 8
            nbits -= 8

    table, width = {bytes([i]): i for i in range(clear)}, least + 1
    nxt = clear + 2
    put(clear, width)
    w = b""
    for s in samples:
        c = w + bytes([s])
        if c in table:
            w = c
            continue
        put(table[w], width)
        if nxt < 4096:
            table[c] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            put(clear, width)
            table, width, nxt = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        w = bytes([s])
    put(table[w], width)
    put(clear + 1, width + (nxt == 1 << width and width < 12))
    if nbits:
        out.append(acc & 255)
    return bytes(out)


def test_streams_with_growing_codes():
    rnd = random.Random(3)
    for n, k in ((1, 4), (50, 2), (3000, 3), (30000, 2), (40000, 256), (9000, 16)):
        data = bytes(rnd.randrange(k) for _ in range(n))
        assert gif.lzw(plain_lzw(data, 8), 8).tobytes() == data
        if k <= 4:
            assert gif.lzw(plain_lzw(data, 2), 2).tobytes() == data
    assert gif.lzw(plain_lzw(bytes(5000), 8), 8).tobytes() == bytes(5000)


def test_streams_as_the_usual_encoder():
    rnd = random.Random(5)
    for n, k in ((1, 4), (3000, 3), (4096, 256), (40_000, 256), (9_000, 16), (300_000, 2)):
        data = bytes(rnd.randrange(k) for _ in range(n))
        stream, plain = gif.code_stream(data), plain_lzw(data, 8)
        assert n > 4000 or gif._blocks(stream, 0)[0] == plain
        assert gif.lzw(gif._blocks(stream, 0)[0], 8).tobytes() == data


def test_round_trip_of_stored_bytes():
    rnd = random.Random(4)
    for n in (0, 1, 63, 64, 65, 4095, 4096, 4097, 5000, 70_000):
        for k in (100, 256):
            data = bytes(rnd.randrange(k) for _ in range(n))
            media = gif.encode_bytes(data)
            payload, frames = gif.read_back(media)
            assert payload == gif.padded(data) and len(payload) % 64 == 0 and payload
            assert [f["start_ms"] for f in frames] == list(range(0, 100 * -(-len(payload) // 4096), 100))
            assert media.count(b"\x21\xf9\x04\x05\x0a\x00\xff\x00\x2c") == len(frames) - 1 or k == 256


def test_colours_tell_samples_and_histograms_tell_texts():
    import numpy as np

    colours = np.frombuffer(gif.palette(), dtype=np.uint8).reshape(-1, 3)
    assert len({tuple(c) for c in colours.tolist()}) == 256 and gif.samples_of(colours).tolist() == list(range(256))
    one, two = (gif.read_back(gif.encode_bytes(t.encode()))[1][0]["histogram"] for t in ("the quick brown fox " * 9, "12345, 67890; " * 12))
    assert one != two and sum(x > 0 for x in one) >= 8 and sum(one) % 64 == 0


def picture(images, size=(4, 2)):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    out = b"GIF89a" + struct.pack("<HHBBB", *size, 0x81, 0, 0) + palette
    for pixels, (left, top, w, h), dispose, clear, delay, interlace in images:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", dispose << 2 | (clear is not None), delay, clear or 0) + b"\0"
        data = plain_lzw(bytes(pixels), 2)
        out += b"\x2c" + struct.pack("<HHHHB", left, top, w, h, 0x40 * interlace) + b"\x02" + bytes([len(data)]) + data + b"\0"
    return out + b"\x3b"


def test_disposal_transparency_and_time():
    red, green, blue = [1] * 8, [2, 3, 2, 3], [3]
    media = picture([(red, (0, 0, 4, 2), 1, None, 5, 0), (green, (1, 0, 2, 2), 3, 3, 7, 0), (blue, (0, 0, 1, 1), 2, None, 1, 0), (blue, (3, 1, 1, 1), 1, None, 1, 0)])
    seen = [(f["start_ms"], f["delay_ms"], c.copy()) for f, c in gif.decode_bytes(media)]
    assert [(a, b) for a, b, _ in seen] == [(0, 50), (50, 70), (120, 10), (130, 10)]
    assert (seen[0][2][..., 0] == 255).all()
    assert seen[1][2][0, 1].tolist() == [0, 255, 0, 255] and seen[1][2][0, 2].tolist() == [255, 0, 0, 255]  # 3 is clear
    assert seen[2][2][0, 1].tolist() == [255, 0, 0, 255] and seen[2][2][0, 0].tolist() == [0, 0, 255, 255]  # put back
    assert seen[3][2][0, 0].tolist() == [0, 0, 0, 0] and seen[3][2][1, 3].tolist() == [0, 0, 255, 255]  # area cleared


def test_interlaced_rows():
    rows = [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]
    media = picture([([r % 4 for r in [*range(0, 10, 8), 4, 2, 6, 1, 3, 5, 7, 9]], (0, 0, 1, 10), 0, None, 0, 1)], (1, 10))
    assert sorted(rows) == list(range(10))
    [(_, canvas)] = [(f, c.copy()) for f, c in gif.decode_bytes(media)]
    want = {0: [0, 0, 0], 1: [255, 0, 0], 2: [0, 255, 0], 3: [0, 0, 255]}
    assert [canvas[r, 0, :3].tolist() for r in range(10)] == [want[r % 4] for r in range(10)]


def test_table_with_nulls_and_bad_media(spark):
    df = spark.createDataFrame([(1, "héllo", b"x"), (2, None, None), (3, "", b"GIF89a"), (3, "", b"GIF89a")], "doc_id long, text string, media binary")
    out = gif.decode(gif.encode(df)).collect()
    assert sorted((r.doc_id, bytes(r.payload)) for r in out) == sorted((i, gif.padded((t or "").encode())) for i, t, _ in df.collect())
    assert all(len(r.frames) == 1 and sum(r.frames[0].histogram) == len(r.payload) for r in out)
    bad = gif.decode(df).collect()
    assert all(r.payload is None and r.frames == [] for r in bad)
    assert gif.decode(gif.encode(df.limit(0))).count() == 0
