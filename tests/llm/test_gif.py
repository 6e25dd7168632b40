"""The stored form against a plain reader, and files that are cut or changed."""

import hashlib
import random
import struct
import zlib

import numpy as np
import pytest

from docgraph.llm import gif, queries
from test_text_edges import lzw


def plain_lzw(data, depth):
    """Code by code, bit by bit, with a table of words."""
    bits = "".join(f"{b:08b}"[::-1] for b in data)
    clear, end, at = 1 << depth, (1 << depth) + 1, 0
    table, out, last = [], b"", None
    while True:
        width = min(12, max(depth + 1, (len(table) if last is not None else clear + 2).bit_length()))
        code = int(bits[at : at + width][::-1], 2)
        at += width
        if code == end:
            return out
        if code == clear:
            table, last = [bytes([i]) for i in range(clear)] + [b"", b""], None
            continue
        word = table[code] if code < len(table) else last + last[:1]
        if last is not None and len(table) < 4096:
            table.append(last + word[:1])
        last = word
        out += word


def plain_media(data):
    """(payload, duration, pixels by bin of each frame) of a file as the operator writes it: one palette, whole frames."""
    palette, at, frames, delay = [tuple(data[13 + 3 * i : 16 + 3 * i]) for i in range(256)], 13 + 768, [], None
    while data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label, at = data[at + 1], at + 2
        else:
            w, h = struct.unpack_from("<HH", data, at + 5)
            at += 11
        body = b""
        while n := data[at]:
            body += data[at + 1 : at + 1 + n]
            at += n + 1
        at += 1
        if kind == 0x2C:
            pixels = plain_lzw(body, 8)
            assert len(pixels) == w * h
            bins = [0] * 64
            for p in pixels:
                if p:
                    r, g, b = palette[p]
                    bins[r // 64 * 16 + g // 64 * 4 + b // 64] += 1
            frames.append((pixels, delay, bins))
        elif label == 0xF9:
            delay = struct.unpack_from("<H", body, 1)[0]
    return b"".join(f[0] for f in frames), sum(f[1] for f in frames), [f[2] for f in frames]


def test_query_against_a_plain_reader(spark):
    sf = "/root/testdata/sf0.001"
    stored = {r.doc_id: bytes(r.media) for r in gif.to_media(queries.documents(spark, sf)).collect()}
    rows = queries.op9_media(spark, sf).collect()
    assert len(rows) == len(stored)
    for r in rows:
        payload, duration, bins = plain_media(stored[r.doc_id])
        total = [sum(x) for x in zip(*bins)]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())
        assert r.feature == f"frames={len(bins)};duration={duration};histogram={','.join(map(str, total))}"


def test_frames_have_histograms(spark):
    text = "b" * 65536 + "cc"
    row = gif.media_features(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    *_, bins = plain_media(gif.encode(gif.payload_of(text)[0]))
    assert [f.histogram for f in row.frames] == bins and [sum(f.histogram) for f in row.frames] == [65536, 2]
    assert [(f.start, f.delay, f.height, f.disposal) for f in row.frames] == [(0, 10, 1024, 2), (10, 10, 1, 2)]


@pytest.mark.parametrize("levels", [2, 256])
def test_lzw_round_trip(levels):
    rng = np.random.default_rng(levels)
    for n in (0, 1, 2, 300, 5000, 60_000):
        samples = rng.integers(0, levels, n).astype(np.uint8)
        made = gif.lzw_encode(samples.tobytes())
        assert (gif.lzw_decode(made, 8, n) == samples).all()
        if n <= 5000:
            assert plain_lzw(made, 8) == samples.tobytes()
            assert made == lzw(samples.tolist(), 8)[: len(made)]
    assert len(gif.lzw_encode(bytes(60_000))) < 1000


def test_full_table_without_clear():
    """A writer may go on with a full table."""
    rng = np.random.default_rng(9)
    samples = rng.integers(0, 256, 9000).astype(np.uint8)
    codes, table, word = [256], {bytes([i]): i for i in range(256)}, b""
    for s in samples.tolist():
        if word + bytes([s]) in table:
            word += bytes([s])
            continue
        codes.append(table[word])
        if len(table) + 2 < 4096:
            table[word + bytes([s])] = len(table) + 2
        word = bytes([s])
    codes += [table[word], 257]
    widths = np.concatenate([[9], gif._widths(8, 0, len(codes) - 1)])
    assert (gif.lzw_decode(gif._pack(np.array(codes, np.int64), widths), 8, 9000) == samples).all()


def test_broken_files(spark):
    """Any file that is cut or changed gives frames or nulls, no other error."""
    rng = random.Random(2)
    whole = gif.encode(gif.payload_of("some text of a document " * 9000)[0])
    files = [whole[:n] for n in [*range(0, 60), *rng.sample(range(len(whole)), 12)]]
    for _ in range(60):
        spoiled = bytearray(whole[:4000])
        for _ in range(3):
            spoiled[rng.randrange(len(spoiled))] = rng.randrange(256)
        files.append(bytes(spoiled))
    rows = {r.doc_id: r for r in gif.from_media(spark.createDataFrame(list(enumerate(files)) + [(-1, None)], "doc_id long, media binary")).collect()}
    assert len(rows) == len(files) + 1 and rows[-1].media_bytes is None
    assert all(rows[i].media_bytes == len(f) for i, f in enumerate(files))
    assert rows[0].n_frames is None and rows[12].n_frames is None and any(rows[i].n_frames for i in range(60, 72))
    with pytest.raises(ValueError):
        gif.decode(b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b")
