"""Media columns: GIF files as bytes, decoded to timed frames with colour-histogram columns.

The decoder reads GIF87a and GIF89a: logical screen, global and local palettes, LZW code streams
(variable width, clear codes, deferred clears), interlace, graphic control (delay, transparency,
disposal) and frames smaller than the screen. The encoder writes 8-bit indexed frames with real LZW.
A payload of bytes is stored as frames of 64 columns whose palette is the 256 greys, so that a sample's
colour is its byte. The stored file is a column; a second pass reads it, draws its frames on the screen one after the other
(transparency and disposal included) and takes payload, times and colour histograms from what the screen shows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantidal.llm.common import batches, bounded, documents

#: Frames of a stored payload: samples a row, and rows a frame at most (1 MiB).
WIDTH, ROWS = 64, 16384
#: Stored frames follow one another every so many hundredths of a second.
DELAY = 10
#: Pixels of a screen beyond which a file is refused (a header can claim 65535 x 65535).
MOST_PIXELS = 1 << 26
#: Bins a colour channel of a histogram.
BINS = 16

GREYS = bytes(v for i in range(256) for v in (i, i, i))


class BadGif(ValueError):
    """The bytes aren't a GIF that can be read whole."""


# --- LZW ---------------------------------------------------------------------------------------


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of the given bit widths, least significant bit first."""
    ends = np.cumsum(widths, dtype=np.int64)
    starts = ends - widths
    total = int(ends[-1]) if len(ends) else 0
    out = np.zeros(total // 8 + 4, np.uint8)
    shifted = codes.astype(np.uint32) << (starts & 7).astype(np.uint32)
    at = starts >> 3
    for k in range(3):  # at most 7 + 12 bits: three bytes; no two codes share a bit, so adding sets them
        out += np.bincount(at + k, weights=(shifted >> np.uint32(8 * k)) & np.uint32(255), minlength=len(out)).astype(np.uint8)
    return out[: (total + 7) // 8].tobytes()


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The LZW code stream of samples of `bits` bits: clear code first, end code last, tables cleared when full."""
    clear, end = 1 << bits, (1 << bits) + 1
    codes: list[int] = [clear]
    table: dict[int, int] = {}
    get, put = table.get, codes.append
    free = end + 1
    it = iter(data)
    cur = next(it, None)
    if cur is not None:
        for c in it:
            key = cur << 8 | c
            nxt = get(key)
            if nxt is not None:
                cur = nxt
                continue
            put(cur)
            cur = c
            if free < 4096:
                table[key] = free
                free += 1
            else:
                put(clear)
                table.clear()
                free = end + 1
        put(cur)
    put(end)
    arr = np.array(codes, np.int64)
    return _pack(arr, _widths(arr, clear))


def _widths(codes: np.ndarray, clear: int) -> np.ndarray:
    """The width of each code: it follows from how many codes came since the last clear."""
    at = np.arange(len(codes))
    since = at - np.maximum.accumulate(np.where(codes == clear, at, 0))
    # The k-th code after a clear (k from 1) is written when the table holds clear + k entries.
    filled = clear + np.maximum(since, 1)
    widths = np.ceil(np.log2(filled + 1.0)).astype(np.int64)
    widths = np.minimum(widths, 12)
    clears = codes == clear  # a clear code has the width that a code in its place would have
    first = np.zeros(len(codes), bool)
    first[0] = True
    before = np.concatenate([[0], since[:-1]])
    widths = np.where(clears & ~first, np.minimum(np.ceil(np.log2(clear + np.maximum(before + 1, 1) + 1.0)).astype(np.int64), 12), widths)
    return np.where(first, int(np.log2(clear)) + 1, widths)


def lzw_decode(stream: bytes, bits: int, most: int) -> bytes:
    """The samples of an LZW code stream, `most` at most. A stream that ends early gives what it holds."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    total = len(stream) * 8
    # Positions of the codes after a clear are the same each time: widths depend on the count alone.
    # Beyond a full table codes stay 12 bits wide until the next clear (a deferred clear).
    k = np.arange(1, 4096 - clear + 1)
    widths = np.minimum(np.ceil(np.log2(clear + k + 1.0)).astype(np.int64), 12)
    widths[: 1] = bits + 1
    offsets = np.concatenate([[0], np.cumsum(widths)])
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    got, pos = 0, 0
    while pos + bits + 1 <= total and got < most:
        # Read codes up to the next clear or end, first within the growing table, then 12 bits each.
        start, chunks = pos, []
        stop, code_at_stop = False, -1
        n_ok = int(np.searchsorted(offsets[1:], total - start, side="right"))
        at = start + offsets[:n_ok]
        w = widths[:n_ok]
        codes = _codes(raw, at, w)
        hit = np.flatnonzero((codes == clear) | (codes == end))
        if len(hit):
            h = int(hit[0])
            code_at_stop = int(codes[h])
            pos = int(at[h] + w[h])
            chunks.append(codes[:h])
            stop = True
        else:
            chunks.append(codes)
            pos = start + int(offsets[n_ok])
            while not stop and n_ok == len(widths) and pos + 12 <= total:
                n = min(4096, (total - pos) // 12)
                at = pos + 12 * np.arange(n)
                codes = _codes(raw, at, np.full(n, 12))
                hit = np.flatnonzero((codes == clear) | (codes == end))
                if len(hit):
                    h = int(hit[0])
                    code_at_stop = int(codes[h])
                    chunks.append(codes[:h])
                    pos = int(at[h] + 12)
                    stop = True
                else:
                    chunks.append(codes)
                    pos += 12 * n
        run = np.concatenate(chunks).tolist()
        if run:
            table = roots.copy()
            add, emit = table.append, out.append
            prev = None
            for c in run:
                if prev is None:
                    if c >= clear:
                        raise BadGif("an LZW stream starts with an unknown code")
                    entry = table[c]
                elif c < len(table):
                    entry = table[c]
                    if len(table) < 4096:
                        add(prev + entry[:1])
                elif c == len(table) and c < 4096:
                    entry = prev + prev[:1]
                    add(entry)
                else:
                    raise BadGif("an LZW stream has an unknown code")
                emit(entry)
                got += len(entry)
                prev = entry
                if got >= most:
                    break
        if not stop or code_at_stop == end:
            break
    return b"".join(out)[:most]


def _codes(raw: np.ndarray, at: np.ndarray, widths: np.ndarray) -> np.ndarray:
    b = at >> 3
    v = raw[b] | raw[b + 1] << np.uint32(8) | raw[b + 2] << np.uint32(16)
    return ((v >> (at & 7).astype(np.uint32)) & ((np.uint32(1) << widths.astype(np.uint32)) - np.uint32(1))).astype(np.int64)


# --- Files -------------------------------------------------------------------------------------


@dataclass
class Frame:
    """A frame as shown: the whole screen's colours once it is drawn, and where and how it was drawn."""

    left: int
    top: int
    width: int
    height: int
    delay: int  #: hundredths of a second
    disposal: int
    transparent: int  #: palette index, or -1
    samples: np.ndarray  #: palette indices, height x width
    screen: np.ndarray | None  #: screen height x width x 3; None if screens weren't asked for
    palette: np.ndarray


def _blocks(raw: bytes, pos: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if pos >= len(raw):
            raise BadGif("the file ends within a block")
        n = raw[pos]
        if not n:
            return b"".join(parts), pos + 1
        if pos + 1 + n > len(raw):
            raise BadGif("the file ends within a block")
        parts.append(raw[pos + 1 : pos + 1 + n])
        pos += 1 + n


def _palette(raw: bytes, pos: int, flags: int) -> tuple[np.ndarray, int]:
    n = 3 << ((flags & 7) + 1)
    if pos + n > len(raw):
        raise BadGif("the file ends within a palette")
    return np.frombuffer(raw[pos : pos + n], np.uint8).reshape(-1, 3), pos + n


def decode_gif(raw: bytes, screens: bool = True) -> Iterator[Frame]:
    """The frames in order, one at a time. `screens` False leaves out composing (samples are enough)."""
    if len(raw) < 13 or raw[:6] not in (b"GIF87a", b"GIF89a"):
        raise BadGif("no GIF header")
    width, height, flags, _, _ = struct.unpack("<HHBBB", raw[6:13])
    if width * height > MOST_PIXELS:
        raise BadGif(f"a screen of {width} x {height}")
    pos, shared = 13, None
    if flags & 0x80:
        shared, pos = _palette(raw, pos, flags)
    screen = np.zeros((height, width, 3), np.uint8) if screens else None
    delay, disposal, transparent = 0, 0, -1
    while True:
        if pos >= len(raw):
            raise BadGif("the file has no trailer")
        kind = raw[pos]
        pos += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = raw[pos] if pos < len(raw) else -1
            body, pos = _blocks(raw, pos + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            continue
        if kind != 0x2C or pos + 9 > len(raw):
            raise BadGif("an unknown block")
        left, top, w, h, packed = struct.unpack("<HHHHB", raw[pos : pos + 9])
        pos += 9
        palette = shared
        if packed & 0x80:
            palette, pos = _palette(raw, pos, packed)
        if palette is None:
            raise BadGif("a frame has no palette")
        if pos >= len(raw) or not 2 <= raw[pos] <= 8:
            raise BadGif("a bad LZW code size")
        if w * h > MOST_PIXELS:
            raise BadGif(f"a frame of {w} x {h}")
        bits = raw[pos]
        stream, pos = _blocks(raw, pos + 1)
        data = lzw_decode(stream, bits, w * h)
        if len(data) < w * h:
            raise BadGif("a frame has too few samples")
        samples = np.frombuffer(data, np.uint8).reshape(h, w)
        if packed & 0x40:  # interlaced: every 8th row, then those between
            order = np.concatenate([np.arange(s, h, d) for s, d in ((0, 8), (4, 8), (2, 4), (1, 2))])
            placed = np.empty_like(samples)
            placed[order] = samples
            samples = placed
        shown = None
        if screen is not None:
            before = screen.copy() if disposal == 3 else None
            y, x = min(h, max(0, height - top)), min(w, max(0, width - left))
            part, area = samples[:y, :x], screen[top : top + y, left : left + x]
            full = np.zeros((256, 3), np.uint8)
            full[: len(palette)] = palette
            seen = part != transparent
            area[seen] = full[part[seen]]
            shown = screen.copy()
            if disposal == 2:
                area[:] = 0
            elif disposal == 3:
                screen = before
        yield Frame(left, top, w, h, delay, disposal, transparent, samples, shown, palette)
        delay, disposal, transparent = 0, 0, -1


def _sub_blocks(data: bytes) -> bytes:
    return b"".join(bytes([len(p)]) + p for p in (data[i : i + 255] for i in range(0, len(data), 255))) + b"\0"


def encode_gif(frames: list[np.ndarray], delay: int = DELAY, palette: bytes = GREYS) -> bytes:
    """A GIF89a of 8-bit indexed frames (height x width), each drawn at the top left and left in place."""
    if len(palette) != 768:
        raise ValueError("the palette needs 256 colours")
    height, width = max(f.shape[0] for f in frames), max(f.shape[1] for f in frames)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), palette]
    for f in frames:
        out += [b"\x21\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0)]
        out += [b"\x2c", struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0), b"\x08"]
        out.append(_sub_blocks(lzw_encode(np.ascontiguousarray(f, np.uint8).tobytes())))
    return b"".join([*out, b"\x3b"])


def store_payload(payload: bytes) -> bytes:
    """A payload (a positive multiple of 64 bytes) as a GIF; `read_payload` gives it back."""
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return encode_gif([samples[i : i + ROWS] for i in range(0, len(samples), ROWS)])


def read_payload(media: bytes) -> tuple[bytes, list[tuple[int, list[int]]]]:
    """The payload, taken from the screen where each frame was drawn (a grey is its byte), and each frame's delay in ms and
    colour histogram."""
    parts, frames = [], []
    for f in decode_gif(media):
        drawn = f.screen[f.top : f.top + f.height, f.left : f.left + f.width]
        parts.append(drawn[:, :, 0].tobytes())
        frames.append((f.delay * 10, histogram(drawn)))
    return b"".join(parts), frames


def histogram(rgb: np.ndarray) -> list[int]:
    """Counts of BINS equal bins for each of red, green and blue."""
    flat = rgb.reshape(-1, 3)
    return [int(n) for k in range(3) for n in np.bincount(np.ascontiguousarray(flat[:, k]) // (256 // BINS), minlength=BINS)]


FRAMES = "frame int, at_ms bigint, delay_ms bigint, width int, height int, histogram array<bigint>, error string"


def gif_frames(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """A row for each frame: its number, start and delay in ms, size and colour histogram of the screen as shown.

    Null media give no row; bytes that can't be read give one row with `error` and null in the rest
    (after rows for the frames before the fault). Frames are decoded one at a time.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids, cells = batch.column("id"), batch.column("media")
            for i in range(batch.num_rows):
                if (raw := cells[i].as_py()) is None:
                    continue
                out: list[tuple] = []
                at = 0
                try:
                    for n, f in enumerate(decode_gif(raw)):
                        h, w = f.screen.shape[:2]
                        out.append((n, at, f.delay * 10, w, h, histogram(f.screen), None))
                        at += f.delay * 10
                except BadGif as e:
                    out.append((None, None, None, None, None, None, str(e)))
                if out:
                    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.string())
                    cols = [pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)]
                    key = pa.concat_arrays([ids.slice(i, 1)] * len(out))
                    yield pa.RecordBatch.from_arrays([key, *cols], ["id", *[x.split()[0] for x in FRAMES.split(", ")]])

    kind = dict(media.dtypes)[id_col]
    picked = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return picked.mapInArrow(run, f"id {kind}, {FRAMES}").withColumnRenamed("id", id_col)


DIGESTS = {
    "doc_id": None, "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(),
    "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(),
}


def padded(text: bytes) -> bytes:
    """The text with bytes 0 up to a positive multiple of 64."""
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the text as a GIF) for every row; a null text counts as empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in batches(rows):
            raw = [t or b"" for t in texts]
            media = pa.array([store_payload(padded(t)) for t in raw], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    kind = dict(docs.dtypes)["doc_id"]
    picked = bounded(docs.select("doc_id", F.col("text").cast("string").alias("text")))
    return picked.mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


def media_digest(n: int, media: bytes) -> tuple:
    """Of a stored GIF, read back frame by frame: sizes, digests and as the feature the number of frames, their time in ms and
    the colour histogram of all of them (red, green, blue)."""
    payload, frames = read_payload(media)
    colours = np.array([h for _, h in frames]).sum(axis=0)
    feature = ":".join([str(len(frames)), str(sum(ms for ms, _ in frames)), *(",".join(map(str, c.tolist())) for c in colours.reshape(3, -1))])
    return (
        n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature,
    )


def stored_documents(docs: DataFrame) -> DataFrame:
    """The digest columns for every row, from its stored GIF; a null text counts as empty. Equal texts give equal values."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, media in batches(rows, "media"):
            cols = zip(*(media_digest(n, m) for n, m in zip(batch.column("n_bytes").to_pylist(), media, strict=True)), strict=True)
            arrays = [pa.array(list(c), k) for c, k in zip(cols, list(DIGESTS.values())[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], list(DIGESTS))

    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return store_documents(docs).mapInArrow(run, schema)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_documents(documents(spark, sf_dir))
