"""GIF media: writing and reading files, and documents as GIF payloads.

The reader unpacks LZW code streams, applies palettes, transparency and disposal, and
gives timed frames with colour histograms.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import documents, stash

WIDTH = 192
FRAME_ROWS = 1024
DELAY = 4  # hundredths of a second
#: Stored frames stay, go back to the background and go back to the frame before, in turn; spaces are transparent.
DISPOSALS, CLEAR = (1, 2, 3), 32
BINS = 4

# --- LZW ---

_MOST = 4096


def _schedule(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Width of the j-th code after a clear, and its bit offset."""
    j = np.arange(_MOST)
    following = np.minimum((1 << bits) + 2 + np.maximum(j - 1, 0), _MOST - 1)
    width = np.maximum(bits + 1, np.floor(np.log2(following)).astype(np.int64) + 1)
    return width, np.cumsum(width) - width


_SCHEDULES = {bits: _schedule(bits) for bits in range(2, 9)}


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of samples below 2**bits, with a clear whenever the table is full."""
    clear, room = 1 << bits, _MOST - (1 << bits) - 2
    width, offset = _SCHEDULES[bits]
    segments, codes = [], []
    table: dict[int, int] = {}
    find, add = table.get, codes.append
    fresh, at = clear + 2, -1
    for sample in data:
        if at < 0:
            at = sample
            continue
        key = at << 8 | sample
        known = find(key)
        if known is not None:
            at = known
            continue
        add(at)
        table[key] = fresh
        fresh += 1
        at = sample
        if fresh == _MOST:
            add(clear)
            segments.append(np.array(codes, np.int64))
            codes.clear()
            table.clear()
            fresh = clear + 2
    if at >= 0:
        codes.append(at)
    codes.append(clear + 1)
    segments.append(np.array(codes, np.int64))
    assert all(len(s) <= room + 2 for s in segments)
    values, places, start = [np.array([clear])], [np.array([0])], int(width[0])
    for s in segments:
        values.append(s)
        places.append(start + offset[: len(s)])
        start += int(offset[len(s) - 1] + width[len(s) - 1])
    value, place = np.concatenate(values), np.concatenate(places)
    spread, byte = value << (place & 7), place >> 3
    n = -(-start // 8) + 3
    total = sum(np.bincount(byte + k, (spread >> 8 * k) & 255, n) for k in range(3))
    return total[: -(-start // 8)].astype(np.uint8).tobytes()


def lzw_decode(stream: bytes, bits: int = 8) -> bytes:
    """The samples of a code stream; codes of a full table keep the longest width until a clear."""
    clear, stop = 1 << bits, (1 << bits) + 1
    width, offset = _SCHEDULES[bits]
    buf = np.frombuffer(stream + bytes(4), np.uint8).astype(np.int64)
    last, start, j, out = 8 * len(stream), 0, 0, []
    single = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, previous = single.copy(), b""
    while start < last:
        # all codes up to where the table would be full, or a run at the longest width
        if j < _MOST:
            w, place = width[j:], offset[j:] - offset[j] + start
        else:
            w = np.full(_MOST, 12)
            place = start + 12 * np.arange(_MOST)
        fit = place + w <= last
        w, place = w[fit], place[fit]
        if not len(w):
            break
        byte = place >> 3
        codes = ((buf[byte] | buf[byte + 1] << 8 | buf[byte + 2] << 16) >> (place & 7)) & ((1 << w) - 1)
        halt = np.flatnonzero((codes == clear) | (codes == stop))
        n = int(halt[0]) if len(halt) else len(codes)
        for code in codes[:n].tolist():
            if previous:
                if code < len(table):
                    entry = table[code]
                    if len(table) < _MOST:
                        table.append(previous + entry[:1])
                elif code == len(table) < _MOST:
                    entry = previous + previous[:1]
                    table.append(entry)
                else:
                    raise ValueError("bad LZW code")
            else:
                entry = table[code] if code < clear else b""
                if not entry:
                    raise ValueError("bad first LZW code")
            out.append(entry)
            previous = entry
        if len(halt):
            if codes[n] == stop:
                break
            start, j, table, previous = int(place[n] + w[n]), 0, single.copy(), b""
        else:
            start, j = int(place[-1] + w[-1]), min(_MOST, j + n)
    return b"".join(out)


# --- files ---


def colour_cube() -> np.ndarray:
    """256 colours: three bits of red and green, two of blue."""
    i = np.arange(256)
    return np.stack([(i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85], 1).astype(np.uint8)


_CUBE = colour_cube()


def write_gif(
    frames: list[np.ndarray], palette: np.ndarray = _CUBE, delay: int = DELAY, disposal: int | Sequence[int] = 1, transparent: int | None = None
) -> bytes:
    """An animation of index frames (height x width, all as wide as the first), at the upper left.

    disposal: one for all frames, or those of the frames in turn.
    """
    turn = [disposal] if isinstance(disposal, int) else disposal
    high, wide = max(len(f) for f in frames), frames[0].shape[1]
    out = [b"GIF89a", struct.pack("<HHBBB", wide, high, 0xF7, 0, 0), palette.tobytes()]
    if len(frames) > 1:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for i, f in enumerate(frames):
        flags = turn[i % len(turn)] << 2 | (transparent is not None)
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, flags, delay, transparent or 0, 0))
        out.append(struct.pack("<BHHHHB", 0x2C, 0, 0, f.shape[1], f.shape[0], 0) + b"\x08")
        codes = lzw_encode(f.tobytes())
        out += [bytes([len(codes[i : i + 255])]) + codes[i : i + 255] for i in range(0, len(codes), 255)]
        out.append(b"\0")
    return b"".join(out) + b"\x3b"


@dataclass
class Frame:
    left: int
    top: int
    delay: int
    disposal: int
    transparent: int | None
    indices: np.ndarray
    canvas: np.ndarray | None  # height x width x RGBA, as shown


def read_gif(data: bytes, compose: bool = True) -> Iterator[Frame]:
    """Frames in order, each with the canvas as shown while it lasts."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF file")
    wide, high, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, shared = 13, None
    if flags & 0x80:
        n = 2 << (flags & 7)
        shared = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    canvas = np.zeros((high, wide, 4), np.uint8) if compose else None
    disposal, delay, transparent = 0, 0, None

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, at = blocks(at + 2)
            if label == 0xF9:
                disposal, delay = body[0] >> 2 & 7, body[1] | body[2] << 8
                transparent = body[3] if body[0] & 1 else None
            continue
        if data[at] != 0x2C:
            raise ValueError("bad GIF block")
        left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
        at, palette = at + 10, shared
        if flags & 0x80:
            n = 2 << (flags & 7)
            palette = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
            at += 3 * n
        bits = data[at]
        stream, at = blocks(at + 1)
        samples = lzw_decode(stream, bits)[: w * h].ljust(w * h, b"\0")
        rows = np.frombuffer(samples, np.uint8).reshape(h, w)
        if flags & 0x40:
            order = [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, h, step)]
            plain = np.empty_like(rows)
            plain[order] = rows
            rows = plain
        shown = None
        if compose:
            before = canvas.copy() if disposal == 3 else None
            area = canvas[top : top + h, left : left + w]
            part = rows[: area.shape[0], : area.shape[1]]
            colour = np.zeros((256, 4), np.uint8)
            if palette is not None:
                colour[: len(palette), :3] = palette
            colour[:, 3] = 255
            seen = colour[part]
            area[...] = seen if transparent is None else np.where((part != transparent)[:, :, None], seen, area)
            shown = canvas.copy()
            if disposal == 2:
                area[...] = 0
            elif disposal == 3:
                canvas = before
        yield Frame(left, top, delay, disposal, transparent, rows, shown)
        disposal, delay, transparent = 0, 0, None


def colour_histogram(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of `bins` levels of red, green and blue over the visible pixels."""
    seen = canvas.reshape(-1, 4)
    seen = seen[seen[:, 3] > 0]
    return np.concatenate([np.bincount(seen[:, c].astype(np.int64) * bins // 256, minlength=bins) for c in range(3)])


# --- documents ---


def payload_of(text: bytes, unit: int = WIDTH) -> bytes:
    """Padded with spaces to a positive multiple of the unit."""
    return text.ljust(max(unit, -(-len(text) // unit) * unit), b" ")


def payload_frames(payload: bytes, rows: int = FRAME_ROWS) -> list[np.ndarray]:
    samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    return [samples[i : i + rows] for i in range(0, len(samples), rows)]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [t.encode() for t in batch.column(1).to_pylist()]
        media = [write_gif(payload_frames(payload_of(t)), disposal=DISPOSALS, transparent=CLEAR) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"]
        )


_FRAME = (
    "struct<frame:int,start_ms:bigint,delay_ms:bigint,disposal:int,transparent:int,width:int,height:int,"
    "red:array<bigint>,green:array<bigint>,blue:array<bigint>>"
)
_FRAME_ARROW = pa.struct([
    ("frame", pa.int32()), ("start_ms", pa.int64()), ("delay_ms", pa.int64()), ("disposal", pa.int32()), ("transparent", pa.int32()),
    ("width", pa.int32()), ("height", pa.int32()), *((c, pa.list_(pa.int64())) for c in ("red", "green", "blue")),
])
DECODED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    f"problem string, frames array<{_FRAME}>"
)


def timed_frame(number: int, start: int, f: Frame) -> dict:
    """A frame's timing, size and colour histogram as shown."""
    h, w = f.canvas.shape[:2]
    levels = colour_histogram(f.canvas).reshape(3, -1).tolist()
    return {
        "frame": number, "start_ms": start, "delay_ms": 10 * f.delay, "disposal": f.disposal, "transparent": f.transparent,
        "width": w, "height": h, "red": levels[0], "green": levels[1], "blue": levels[2],
    }


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in DECODED.split(", ")]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_FRAME_ARROW)]
    for batch in batches:
        rows = []
        for doc_id, n_bytes, media in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            parts, frames, start, problem = [], [], 0, None
            try:
                for i, f in enumerate(read_gif(media or b"")):
                    parts.append(f.indices.tobytes())
                    frames.append(timed_frame(i, start, f))
                    start += 10 * f.delay
            except (ValueError, IndexError, struct.error) as e:
                problem = f"{type(e).__name__}: {e}"
            payload, media = b"".join(parts), media or b""
            rows.append((doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), problem, frames))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [()] * 9, kinds, strict=True)], names)


def store_as_gif(docs: DataFrame) -> DataFrame:
    """Every document as a GIF of 192-pixel rows, written to the shared folder: doc_id, n_bytes, media.

    The payload is the UTF-8 text, padded with spaces to a positive multiple of 192; long
    ones become frames of 1024 rows.  Null and empty texts are one row of spaces.
    """
    return stash(documents(docs).mapInArrow(_store, "doc_id long, n_bytes long, media binary"))


def decode_media(media: DataFrame) -> DataFrame:
    """Every GIF of media (doc_id, n_bytes, media) decoded once, and the result written: sizes and
    digests of the bytes read back, and the timed frames with their colour histograms.

    Media that are no GIF, or break off, have a problem and the frames before it; null is no GIF.
    """
    return stash(media.select("doc_id", "n_bytes", "media").mapInArrow(_decode, DECODED))


def timed_frames(decoded: DataFrame) -> DataFrame:
    """One row per stored frame: doc_id, frame, start_ms, delay_ms, disposal, transparent, width, height,
    and counts of red, green and blue levels over the visible pixels."""
    return decoded.select("doc_id", F.inline("frames"))


def gif_features(decoded: DataFrame) -> DataFrame:
    """Per stored document: payload and media sizes and digests, the timed frames, and a feature: frames,
    duration, and the colour levels summed over all frames as shown."""
    number = lambda x: x.cast("string")
    level = lambda c, i: F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f[c][i])
    levels = F.concat_ws(",", *[number(level(c, i)) for c in ("red", "green", "blue") for i in range(BINS)])
    lasts = F.aggregate("frames", F.lit(0).cast("long"), lambda a, f: a + f["delay_ms"])
    feature = F.concat(F.lit("frames="), number(F.size("frames")), F.lit(";ms="), number(lasts), F.lit(";rgb="), levels)
    kept = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    return decoded.select(*kept, feature.alias("feature"), "frames")
