"""GIF media columns: an encoder and a whole decoder (LZW, palettes, interlacing, disposal, transparency, timing)."""

import hashlib
import struct
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

WIDTH = 64
#: Rows of one frame.
ROWS = 1024
#: Hundredths of a second that a frame stays.
DELAY = 10
#: The largest code table, and the widest code.
CODES, WIDEST = 4096, 12
#: Codes that are cut out of a stream together.
TOGETHER = 4096
#: Pixels of the largest screen or frame that is read (256 MB as RGBA); files that name larger ones count as broken.
MOST_PIXELS = 1 << 26
#: Levels of each colour in a histogram.
LEVELS = 4


@dataclass
class Frame:
    """A decoded frame: where it stands, its colour indexes, its palette, and what it does to the canvas."""

    left: int
    top: int
    indexes: np.ndarray
    palette: np.ndarray
    delay: int = 0
    disposal: int = 0
    transparent: int | None = None
    start: int = 0


@dataclass
class Animation:
    width: int
    height: int
    background: int = 0
    frames: list[Frame] = field(default_factory=list)

    def canvases(self) -> Iterator[np.ndarray]:
        """The picture after each frame as RGBA: transparent pixels let the canvas through, then disposal applies."""
        for canvas in self._drawn(lambda colours: np.concatenate([colours, np.full((256, 1), 255, np.uint8)], axis=1).view(np.uint32).ravel(), np.uint32):
            yield canvas.copy().view(np.uint8).reshape(self.height, self.width, 4)

    def _drawn(self, shown: Callable[[np.ndarray], np.ndarray], kind: type) -> Iterator[np.ndarray]:
        """The canvas after each frame, for use before the next: ``shown`` gives what stands for each of 256 colours, 0 is empty."""
        canvas = np.zeros((self.height, self.width), kind)
        for f in self.frames:
            before = canvas.copy() if f.disposal == 3 else None
            h, w = f.indexes.shape
            spot = canvas[f.top : f.top + h, f.left : f.left + w]
            seen = f.indexes[: spot.shape[0], : spot.shape[1]]
            pixels = shown(f.palette[np.minimum(np.arange(256), len(f.palette) - 1)])[seen]
            if f.transparent is None:
                spot[:] = pixels
            else:
                np.copyto(spot, pixels, where=seen != f.transparent)
            yield canvas
            if f.disposal == 2:
                canvas[f.top : f.top + h, f.left : f.left + w] = 0
            elif f.disposal == 3:
                canvas = before


def _widths(depth: int, first: int, count: int) -> np.ndarray:
    """Bits of the codes number ``first`` and on after a clear code: one more whenever the table outgrows them."""
    entries = (1 << depth) + 2 + np.maximum(0, np.arange(first, first + count) - 1)
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, depth + 1, WIDEST)


_SCHEDULE = _widths(8, 0, CODES)


def lzw_encode(samples: bytes) -> bytes:
    """An LZW stream of 8-bit samples: the table grows to its 4096 codes, then a clear code empties it."""
    clear = 256
    codes, marks = [clear], [1]
    add, size, table = codes.append, clear + 2, {}
    word = samples[0] if samples else -1
    for sample in samples[1:]:
        longer = word << 8 | sample
        if longer in table:
            word = table[longer]
            continue
        add(word)
        if size < CODES:
            table[longer] = size
            size += 1
        else:
            add(clear)
            marks.append(len(codes))
            table, size = {}, clear + 2
        word = sample
    if word >= 0:
        add(word)
    add(clear + 1)
    # Code number n after a clear code has the same width in every stream; the clear code before it ends its own run.
    runs = np.diff([*marks, len(codes)])
    widths = np.concatenate([[9], *[_SCHEDULE[:n] for n in runs]])
    return _pack(np.array(codes, np.int64), widths)


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes one after the other, least significant bit first; zero bits fill the last byte."""
    ends = np.cumsum(widths)
    at = ends - widths
    shifted = codes << (at & 7)
    out = np.zeros((int(ends[-1]) + 7) // 8 + 2, np.int64)
    for k in range(3):
        # Codes share bytes, not bits.
        out += np.bincount((at >> 3) + k, weights=(shifted >> 8 * k) & 255, minlength=len(out)).astype(np.int64)[: len(out)]
    return out[: (int(ends[-1]) + 7) // 8].astype(np.uint8).tobytes()


def _codes(raw: np.ndarray, bit: int, widths: np.ndarray) -> np.ndarray:
    """The codes of these widths from a place on; as many as are whole."""
    ends = bit + np.cumsum(widths)
    ends = ends[: np.searchsorted(ends, 8 * (len(raw) - 2), "right")]
    at = ends - widths[: len(ends)]
    byte = at >> 3
    held = raw[byte] | raw[byte + 1] << 8 | raw[byte + 2] << 16
    return (held >> (at & 7)) & ((1 << widths[: len(ends)]) - 1)


def _words(codes: np.ndarray, clear: int, most: int) -> np.ndarray:
    """The samples of a run of codes without clear codes; at most about ``most`` of them.

    The table's entry number k is the word of code k and the sample after it, so it stands in the output where that
    word begins: a code of the table is a reference to an earlier place. Lengths and places of all codes, then the
    literal behind each sample, follow by doubling the references.
    """
    entry = np.where(codes < clear, -1, codes - clear - 2)
    if (entry >= np.arange(len(codes))).any():
        raise ValueError("broken LZW stream")
    lengths, back = np.ones(len(codes), np.int64), entry
    while (deeper := np.flatnonzero(back >= 0)).size:
        lengths[deeper], back[deeper] = lengths[deeper] + lengths[back[deeper]], back[back[deeper]]
    entry = np.where(codes < clear, -1, codes - clear - 2)
    starts = np.cumsum(lengths) - lengths
    held = int(np.searchsorted(starts, most))
    codes, entry, lengths, starts = codes[:held], entry[:held], lengths[:held], starts[:held]
    came = np.arange(int(lengths.sum())) + np.repeat(np.where(entry >= 0, starts[entry] - starts, 0), lengths)
    # A reference leads to the same place of a shorter word, or to the first sample of the next one.
    for _ in range(int(2 * lengths.max(initial=0)).bit_length()):
        came = came[came]
    literals = np.zeros(len(came), np.uint8)
    literals[starts[entry < 0]] = codes[entry < 0]
    return literals[came]


def lzw_decode(data: bytes, depth: int, pixels: int) -> np.ndarray:
    """``pixels`` samples of an LZW stream with minimum code size ``depth``; missing ones are 0, surplus ones are dropped."""
    if not 1 <= depth <= 8:
        raise ValueError("broken LZW stream")
    clear, end = 1 << depth, (1 << depth) + 1
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(2, np.uint8)]).astype(np.int64)
    out, total, bit, n, run = [np.empty(0, np.uint8)], 0, 0, 0, []
    while total < pixels:
        widths = _SCHEDULE if depth == 8 and not n else _widths(depth, n, TOGETHER)
        codes = _codes(raw, bit, widths)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        run.append(codes[:stop])
        n += stop
        last = not len(codes) or (stop < len(codes) and codes[stop] == end)
        if last or stop < len(codes) or n >= pixels - total:
            # A run ends with a clear code, with the stream, or where it has a code for each missing sample.
            out.append(_words(np.concatenate(run), clear, pixels - total))
            total += len(out[-1])
            run, n = [], 0
        if last:
            break
        bit += int(widths[: min(stop + 1, len(codes))].sum())
    got = np.concatenate(out)[:pixels]
    return np.concatenate([got, np.zeros(pixels - len(got), np.uint8)])


def _blocks(data: bytes) -> bytes:
    """Data in sub-blocks of at most 255 bytes, with the empty one that ends them."""
    raw = np.frombuffer(data, np.uint8)
    whole, rest = divmod(len(raw), 255)
    out = np.empty((whole, 256), np.uint8)
    out[:, 0] = 255
    out[:, 1:] = raw[: whole * 255].reshape(whole, 255)
    return out.tobytes() + (bytes([rest]) + data[whole * 255 :] if rest else b"") + b"\0"


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while at < len(data) and (n := data[at]):
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes with zeros up to a positive multiple of 64, and their number without."""
    raw = (text or "").encode()
    return raw + b"\0" * (max(1, -(-len(raw) // WIDTH)) * WIDTH - len(raw)), len(raw)


#: 256 colours: three bits of red, three of green, two of blue.
PALETTE = np.array([((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 255 // 3) for i in range(256)], np.uint8)


def encode(payload: bytes, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames hold the payload's bytes as colour indexes, 64 to a row.

    Index 0 is transparent and each frame's place is cleared after it, so a picture shows its own frame's bytes alone.
    """
    height = len(payload) // WIDTH
    out = [b"GIF89a", struct.pack("<HHBBB", WIDTH, min(rows, height), 0xF7, 0, 0), PALETTE.tobytes()]
    if height > rows:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for top in range(0, height, rows):
        part = payload[top * WIDTH : (top + rows) * WIDTH]
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", 2 << 2 | 1, delay, 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, len(part) // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(part)))
    return b"".join([*out, b"\x3b"])


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    """The palette at ``at``, if the flags have one, and where it ends; None if the file ends before."""
    if not flags & 0x80:
        return None, at
    size = 3 << ((flags & 7) + 1)
    if at + size > len(data):
        return None, len(data) + 1
    return np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size


def decode(data: bytes) -> Animation:
    """All frames of a GIF 87a or 89a. A stream that breaks off gives the frames so far; anything else raises ValueError.

    A frame without any palette is black. Screens and frames over ``MOST_PIXELS`` raise ValueError too.
    """
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    common, at = _palette(data, 13, flags)
    if at > len(data) or width * height > MOST_PIXELS:
        raise ValueError("broken GIF")
    movie, delay, disposal, transparent, clock = Animation(width, height, background), 0, 0, None, 0
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1 : at + 2]
            body, at = _unblock(data, at + 2)
            if label == b"\xf9" and len(body) >= 4:
                bits, delay, index = struct.unpack_from("<BHB", body)
                disposal, transparent = bits >> 2 & 7, index if bits & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("broken GIF")
        if at + 10 > len(data):
            break
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        own, at = _palette(data, at + 10, flags)
        if at >= len(data):
            break
        if w * h > MOST_PIXELS:
            raise ValueError("broken GIF")
        depth = data[at]
        body, at = _unblock(data, at + 1)
        indexes = lzw_decode(body, depth, w * h).reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(indexes)
            plain[order] = indexes
            indexes = plain
        colours = own if own is not None else common if common is not None else np.zeros((1, 3), np.uint8)
        movie.frames.append(Frame(left, top, indexes, colours, delay, disposal, transparent, clock))
        clock, delay, disposal, transparent = clock + delay, 0, 0, None
    return movie


def _bins(colours: np.ndarray) -> np.ndarray:
    """The number of each colour's bin, from 1."""
    level = colours // (256 // LEVELS)
    return (level[:, 0] * LEVELS + level[:, 1]) * LEVELS + level[:, 2] + 1


def histograms(movie: Animation) -> Iterator[np.ndarray]:
    """Of the picture after each frame: pixels that show something, by four levels each of red, green and blue."""
    for canvas in movie._drawn(_bins, np.uint8):
        yield np.bincount(canvas.ravel(), minlength=LEVELS**3 + 1)[1:]


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media) for each row: the text's bytes as a GIF. Null texts are empty; an empty text is one row of zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at, step in _pieces(texts):
                made = [payload_of(t.as_py()) for t in texts[at : at + step]]
                yield pa.RecordBatch.from_arrays([ids[at : at + step], pa.array([n for _, n in made], pa.int64()), pa.array([encode(p) for p, _ in made], pa.binary())], ["id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def _pieces(values: pa.Array, most: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """(start, number) of rows so that a piece holds about ``most`` bytes; a longer value stands alone."""
    start = held = 0
    for i, size in enumerate(pa.compute.binary_length(values).fill_null(0).to_pylist()):
        if held + size > most and i > start:
            yield start, i - start
            start, held = i, 0
        held += size
    if len(values) > start:
        yield start, len(values) - start


_TIMED = ("start", "delay", "left", "top", "width", "height", "disposal")


def from_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decodes each GIF: timed frames (start and delay in hundredths of a second, place, size, disposal) with the colour
    histogram of the picture that each of them leaves, digests, and the sum of the histograms.

    Returns (id, frames, n_frames, duration, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, histogram).
    The payload is the frames' indexes in order. A null media value gives nulls; what is no GIF, or a broken one, gives
    nulls but for media_bytes and media_sha256.
    """
    kind = dict(media.dtypes)[id_col]
    frame = pa.struct([*[(n, pa.int64()) for n in _TIMED], ("histogram", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values = batch.column(0), batch.column(1)
            for at, step in _pieces(values):
                rows = [_described(v.as_py()) for v in values[at : at + step]]
                cols = list(zip(*rows, strict=True))
                kinds = [pa.list_(frame), *[pa.int64()] * 3, pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([ids[at : at + step], *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["id", *NAMES])

    timed = ", ".join(f"{n}: long" for n in _TIMED)
    schema = f"id {kind}, frames array<struct<{timed}, histogram: array<long>>>, n_frames long, duration long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, histogram array<long>"
    return media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media")).mapInArrow(run, schema).withColumnRenamed("id", id_col)


NAMES = ("frames", "n_frames", "duration", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "histogram")


def _described(data: bytes | None) -> tuple:
    if data is None:
        return (None,) * len(NAMES)
    stored = len(data), hashlib.sha256(data).hexdigest()
    try:
        movie = decode(data)
    except ValueError:
        return *(None,) * 6, *stored, None
    whole, tail, size = hashlib.sha256(), b"", 0
    frames, total = [], np.zeros(LEVELS**3, np.int64)
    for f, counts in zip(movie.frames, histograms(movie), strict=True):
        part = f.indexes.tobytes()
        whole.update(part)
        tail, size, total = (tail + part)[-64:], size + len(part), total + counts
        frames.append({"start": f.start, "delay": f.delay, "left": f.left, "top": f.top, "width": f.indexes.shape[1], "height": f.indexes.shape[0], "disposal": f.disposal, "histogram": counts.tolist()})
    return frames, len(frames), sum(f.delay for f in movie.frames), size, whole.hexdigest(), zlib.crc32(tail), *stored, total.tolist()


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as a GIF and reads it back, in one pass; n_bytes joins the columns of :func:`from_media`."""
    stored = to_media(docs, id_col, text_col)
    kept = stored.select(F.struct(F.col(id_col), F.col("n_bytes")).alias("row"), "media")
    return from_media(kept, "row").select(f"row.{id_col}", "row.n_bytes", *NAMES)
