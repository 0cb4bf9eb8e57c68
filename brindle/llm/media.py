"""GIF media columns: encode, decode (LZW, palettes, disposal, transparency) and timed frames with colour histograms."""

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

from .cluster import table
from .textkit import chunks, task

#: Pixels across, rows of a frame, hundredths of a second of a frame.
WIDTH, ROWS, DELAY = 64, 64, 10
#: What becomes of a frame's pixels before the next one is drawn, in turn: they stay (1), what was there comes back (3), the place is cleared (2).
DISPOSALS = (1, 1, 3, 2)
#: Colours of a pixel value v, by palette, in turn whenever the canvas has been cleared: red is v in all of them, so that the values can be told from the colours shown.
PALETTES = tuple(np.stack([v, g, b], 1).astype(np.uint8).tobytes() for v in [np.arange(256)] for g, b in ((v, v), (255 - v, v ^ 0x55), (v * 5 % 256, 128 + v // 2)))


@dataclass
class Frame:
    """One shown frame: the whole canvas (height, width, RGBA) and where the image block lay in it."""

    canvas: np.ndarray
    left: int
    top: int
    width: int
    height: int
    delay_ms: int
    start_ms: int

    @property
    def block(self) -> np.ndarray:
        return self.canvas[self.top : self.top + self.height, self.left : self.left + self.width]

    def histogram(self) -> np.ndarray:
        """Pixels of the canvas by colour, four levels a channel (64 bins), and transparent ones (bin 64)."""
        p = self.canvas.reshape(-1, 4)
        bins = (p[:, 0] >> 6).astype(np.intp) * 16 + (p[:, 1] >> 6) * 4 + (p[:, 2] >> 6)
        return np.bincount(np.where(p[:, 3] > 0, bins, 64), minlength=65)


def _blocks(data: np.ndarray) -> bytes:
    """Data as sub-blocks of at most 255 bytes, with the closing empty one."""
    full = len(data) // 255
    head = np.empty((full, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = data[: full * 255].reshape(full, 255)
    rest = data[full * 255 :].tobytes()
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def _widths(bits: int) -> np.ndarray:
    """How many bits the i-th code after a clear code takes: the table has grown by i - 1 entries before it."""
    made = np.minimum((1 << bits) + 2 + np.maximum(np.arange(4096) - 1, 0), 4095)
    return np.maximum(np.floor(np.log2(made)).astype(np.int64) + 1, bits + 1)


WIDTHS = {bits: _widths(bits) for bits in range(2, 9)}
LITERALS = {bits: [bytes([i]) for i in range(1 << bits)] + [b"", b""] for bits in range(2, 9)}


def _pack(codes: list[int], widths: np.ndarray) -> np.ndarray:
    """Codes of some widths, lowest bits first, as bytes."""
    at = np.cumsum(widths) - widths
    shifted = np.array(codes, np.uint32) << (at & 7).astype(np.uint32)
    size = int(at[-1] + widths[-1] + 7) // 8
    # codes meet in a byte at bits of their own, so their sum is what is wanted
    return sum(np.bincount((at >> 3) + i, shifted >> np.uint32(8 * i) & np.uint32(255), size + 3) for i in range(3))[:size].astype(np.uint8)


def lzw_compress(pixels: bytes, bits: int = 8) -> np.ndarray:
    """The table-building LZW stream: a clear code at the start and whenever the table is full."""
    clear = 1 << bits
    out, widths, usual = [clear], [np.array([bits + 1])], WIDTHS[bits]
    codes: dict[int, int] = {}
    get, put = codes.get, out.append
    free, since, last = clear + 2, 1, -1
    for p in pixels:
        if last < 0:
            last = p
            continue
        pair = last << 8 | p
        code = get(pair)
        if code is None:
            put(last)
            codes[pair] = free
            free += 1
            if free == 4096:
                put(clear)
                n = len(out) - since
                widths.append(usual[:n])
                since = len(out)
                codes.clear()
                free = clear + 2
            last = p
        else:
            last = code
    if last >= 0:
        put(last)
    put(clear + 1)
    widths.append(usual[: len(out) - since])
    return _pack(out, np.concatenate(widths))


def lzw_decode(data: bytes, bits: int, count: int) -> np.ndarray:
    """At most `count` pixels of an LZW code stream, by its code table. Raises ValueError for what isn't one."""
    if bits not in WIDTHS:
        raise ValueError("broken LZW stream")
    clear, usual = 1 << bits, WIDTHS[bits]
    raw = np.frombuffer(data + bytes(4), np.uint8)
    out: list[bytes] = []
    at, total, made, ended = 0, 8 * len(data), 0, False
    while not ended and made < count and at < total:
        # codes up to the next clear code, as if there were none: their widths depend on their number only
        widths = usual[: min(len(usual), (total - at) // (bits + 1) + 1)]
        bit = at + np.cumsum(widths) - widths
        bit, widths = bit[bit + widths <= total], widths[: int((bit + widths <= total).sum())]
        byte = bit >> 3
        held = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << np.uint32(8) | raw[byte + 2].astype(np.uint32) << np.uint32(16)
        codes = (held >> (bit & 7).astype(np.uint32)) & ((np.uint32(1) << widths.astype(np.uint32)) - np.uint32(1))
        stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
        if len(stop):
            ended = bool(codes[stop[0]] == clear + 1)
            at = int(bit[stop[0]] + widths[stop[0]])
            codes = codes[: stop[0]]
        elif not len(codes):
            break
        else:
            at = int(bit[-1] + widths[-1])
            ended = at >= total or len(codes) < len(usual)
            if not ended:
                # a full table goes on with twelve-bit codes until it is cleared
                more, at = _twelve(raw, at, total, clear)
                codes = np.r_[codes, more]
        if not len(codes):
            continue
        table, listed = LITERALS[bits].copy(), codes.tolist()
        n, last, put, grow = clear + 2, table[listed[0]] if listed[0] < clear else b"", out.append, table.append
        if not last:
            raise ValueError("broken LZW stream")
        put(last)
        for code in listed[1:]:
            if code < n:
                entry = table[code]
                if n < 4096:
                    grow(last + entry[:1])
                    n += 1
            elif code == n:
                entry = last + last[:1]
                grow(entry)
                n += 1
            else:
                raise ValueError("broken LZW stream")
            put(entry)
            last = entry
        made = sum(map(len, out)) if at < total else count
    return np.frombuffer(b"".join(out), np.uint8)[:count]


def _twelve(raw: np.ndarray, at: int, total: int, clear: int) -> tuple[np.ndarray, int]:
    """Codes of twelve bits from a place on, up to a clear or end code, which is left to be read."""
    bit = np.arange(at, total - 11, 12)
    byte = bit >> 3
    held = raw[byte].astype(np.uint32) | raw[byte + 1].astype(np.uint32) << np.uint32(8)
    codes = (held | raw[byte + 2].astype(np.uint32) << np.uint32(16)) >> (bit & 7).astype(np.uint32) & np.uint32(4095)
    stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
    n = int(stop[0]) + 1 if len(stop) else len(codes)
    end = len(stop) and codes[stop[0]] == clear + 1
    return codes[: n - 1] if len(stop) else codes, total if end or not len(stop) else at + 12 * n


def encode_gif(payload: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """Bytes (a positive multiple of `width`) as the pixels of a GIF, `rows` rows a frame; frames are shown one after another.

    Frames take turns in palettes and disposals. Where a pixel has its value
    already on the canvas, and a value is free to say so, it is transparent.
    """
    data = np.frombuffer(payload, np.uint8)
    if not len(data) or len(data) % width:
        raise ValueError(f"the payload must be a positive multiple of {width} bytes")
    height = min(len(data) // width, rows)
    parts = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), PALETTES[0]]
    canvas, colours = np.full(width * height, -1, np.int64), np.full(width * height, -1, np.int64)
    for i, at in enumerate(range(0, len(data), width * rows)):
        pixels = data[at : at + width * rows]
        palette, disposal, n = i // len(DISPOSALS) % len(PALETTES), DISPOSALS[i % len(DISPOSALS)], len(pixels)
        same = (canvas[:n] == pixels) & (colours[:n] == palette)
        unused = np.flatnonzero(np.bincount(pixels, minlength=256) == 0) if same.any() else ()
        stored, clear = (np.where(same, unused[0], pixels).astype(np.uint8), int(unused[0])) if len(unused) else (pixels, None)
        parts += [b"\x21\xf9\x04", struct.pack("<BHB", disposal << 2 | (clear is not None), delay, clear or 0), b"\0"]
        parts += [b"\x2c", struct.pack("<HHHHB", 0, 0, width, n // width, 0x87 if palette else 0), PALETTES[palette] if palette else b"", b"\x08"]
        parts.append(_blocks(lzw_compress(stored.tobytes())))
        if disposal == 1:
            canvas[:n], colours[:n] = pixels, palette
        elif disposal == 2:
            canvas[:n] = -1
    return b"".join([*parts, b"\x3b"])


def decode_gif(media: bytes) -> Iterator[Frame]:
    """The frames of a GIF, composed on its canvas. Raises ValueError for what isn't one, or ends too early."""
    try:
        yield from _decoded(media)
    except (IndexError, struct.error) as error:
        raise ValueError("broken GIF") from error


def _decoded(media: bytes) -> Iterator[Frame]:
    if media[:6] not in (b"GIF87a", b"GIF89a") or len(media) < 13:
        raise ValueError("not a GIF")
    wide, high, flags, _, _ = struct.unpack("<HHBBB", media[6:13])
    at = 13

    def palette(size: int) -> np.ndarray:
        nonlocal at
        colours = np.full((1 << (size + 1), 4), 255, np.uint8)
        if at + 3 * len(colours) > len(media):
            raise ValueError("broken GIF")
        colours[:, :3] = np.frombuffer(media[at : at + 3 * len(colours)], np.uint8).reshape(-1, 3)
        at += 3 * len(colours)
        return colours

    def body() -> bytes:
        nonlocal at
        parts = []
        while size := media[at]:
            parts.append(media[at + 1 : at + 1 + size])
            at += 1 + size
        at += 1
        return b"".join(parts)

    shared = palette(flags & 7) if flags & 0x80 else None
    canvas = np.zeros((high, wide, 4), np.uint8)
    disposal, delay, clear, now = 0, 0, -1, 0
    while media[at] != 0x3B:
        kind = media[at]
        at += 1
        if kind == 0x21:
            label = media[at]
            at += 1
            data = body()
            if label == 0xF9 and len(data) >= 4:
                bits, delay, index = struct.unpack("<BHB", data[:4])
                disposal, clear = bits >> 2 & 7, index if bits & 1 else -1
        elif kind == 0x2C:
            left, top, width, height, bits = struct.unpack("<HHHHB", media[at : at + 9])
            at += 9
            colours = palette(bits & 7) if bits & 0x80 else shared
            if colours is None:
                raise ValueError("a frame without a palette")
            size = media[at]
            at += 1
            pixels = lzw_decode(body(), size, width * height)
            if len(pixels) < width * height:
                raise ValueError("a frame has too few pixels")
            pixels = pixels.reshape(height, width)
            if bits & 0x40:  # interlaced
                order = [*range(0, height, 8), *range(4, height, 8), *range(2, height, 4), *range(1, height, 2)]
                straight = np.empty_like(pixels)
                straight[order] = pixels
                pixels = straight
            before = canvas.copy() if disposal == 3 else None
            spot = canvas[top : top + height, left : left + width]
            pixels = pixels[: spot.shape[0], : spot.shape[1]]
            if clear >= 0:
                seen = pixels != clear
                spot[seen] = colours[np.minimum(pixels, len(colours) - 1)][seen]
            else:
                spot[...] = colours[np.minimum(pixels, len(colours) - 1)] if len(colours) < 256 else colours[pixels]
            yield Frame(canvas.copy(), left, top, width, height, delay * 10, now)
            now += delay * 10
            if disposal == 2:
                spot[...] = 0
            elif before is not None:
                canvas = before
            disposal, delay, clear = 0, 0, -1
        else:
            raise ValueError("broken GIF")


MEDIA = "doc_id long, n_bytes long, media binary"
FRAMES = "doc_id long, frame int, start_ms long, delay_ms long, width int, height int, pixels binary, histogram array<long>, fault string, key long, n_bytes long, media_bytes long, media_sha256 string, n_frames int"
DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_ms long, histogram array<long>"
#: Frames of a batch of rows.
BATCH_FRAMES = 256


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in schema.split(", "))])


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(_arrow(schema))
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _arrow(schema).types, strict=True)], schema=_arrow(schema))


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes (null: empty), zero-padded to a positive multiple of the width, as a GIF in column media.

    One row for each row of docs; equal texts give equal media; a long text is
    a GIF of many frames; an empty table gives none; other columns are ignored.
    """

    @task("media")
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch):
                raw = [(t or "").encode() for t in part.column("text").to_pylist()]
                media = [encode_gif(t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))) for t in raw]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], schema=_arrow(MEDIA))

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text")).mapInArrow(encode, MEDIA)


def media_frames(media: DataFrame) -> DataFrame:
    """A row for each frame of column media: its number, time and size, the RGB pixels that the canvas shows in the frame's place and
    their colour histogram; and what is known of the whole file (key, its number; n_bytes, media_bytes, media_sha256, n_frames).

    Media that are null, or broken (fault says how), give one row with no
    frame and what came before the fault. Repeated rows have keys of their own;
    an empty table gives none; other columns are ignored.
    """

    @task("media")
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []
        for batch in batches:
            for key, doc_id, n_bytes, data in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "n_bytes", "media")), strict=True):
                whole = [key, n_bytes, *((None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest()))]
                n, fault = 0, None
                try:
                    for f in decode_gif(data) if data is not None else ():
                        block = np.ascontiguousarray(f.block[..., :3])
                        rows.append([doc_id, n, f.start_ms, f.delay_ms, f.width, f.height, block.tobytes(), f.histogram(), None, *whole, None])
                        n += 1
                        if len(rows) >= BATCH_FRAMES:
                            yield _batch(rows, FRAMES)
                            rows = []
                except ValueError as error:
                    fault = str(error)
                # the last row says that all frames are there
                rows.append([doc_id, *[None] * 7, fault, *whole, n])
        yield _batch(rows, FRAMES)

    return media.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), "media").mapInArrow(decode, FRAMES)


def media_digests(media: DataFrame) -> DataFrame:
    """Reads stored media back, from the rows of their frames: a row each with digests of the payload and of the file, duration and
    summed colour histogram.

    Null and broken media give null digests; repeated rows give repeated
    results; an empty table gives none.
    """

    @task("media")
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a file's rows follow each other in one task, its last one closes it
        payload, tail, size, hist, ms = hashlib.sha256(), b"", 0, np.zeros(65, np.int64), 0
        for batch in batches:
            rows = []
            names = ("doc_id", "start_ms", "delay_ms", "pixels", "fault", "n_bytes", "media_bytes", "media_sha256", "n_frames")
            held = dict(zip(names, (batch.column(c).to_pylist() for c in names), strict=True))
            counts = batch.column("histogram")
            flat, at = counts.flatten().to_numpy(), np.cumsum(np.r_[0, counts.is_valid().to_numpy(False).astype(np.int64)]) * 65
            for i in range(batch.num_rows):
                if held["n_frames"][i] is None:
                    values = held["pixels"][i][::3]  # red is the value
                    payload.update(values)
                    size, tail, hist, ms = size + len(values), (tail + values)[-64:], hist + flat[at[i] : at[i + 1]], held["start_ms"][i] + held["delay_ms"][i]
                    continue
                base = [held[c][i] for c in ("doc_id", "n_bytes")]
                if held["media_bytes"][i] is None or held["fault"][i]:
                    rows.append([*base, None, None, None, held["media_bytes"][i], held["media_sha256"][i], None, None, None, None])
                else:
                    n = held["n_frames"][i]
                    shown = ",".join(f"{k}:{hist[k]}" for k in np.flatnonzero(hist))
                    rows.append([*base, size, payload.hexdigest(), zlib.crc32(tail), held["media_bytes"][i], held["media_sha256"][i], f"gif;frames={n};ms={ms};histogram={shown}", n, ms, hist.tolist()])
                payload, tail, size, hist, ms = hashlib.sha256(), b"", 0, np.zeros(65, np.int64), 0
            yield _batch(rows, DIGEST)

    return media_frames(media).mapInArrow(read, DIGEST)


def op2_media_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(text_media(table(spark, sf_dir, "documents", "doc_id", "text")))
