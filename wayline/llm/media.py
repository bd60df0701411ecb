"""Media columns: payloads as AVI motion-JPEG, read back through the RIFF index, with shots as timed clip rows."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.llm.common import table

#: Samples of a frame (one 8x8 block each, 16 across and 12 down), frames a second.
ACROSS, DOWN, FPS = 16, 12, 25
FRAME = ACROSS * DOWN
#: Histogram bins; frames either side in the adaptive threshold; its deviations; the least difference of a cut.
BINS, AROUND, DEVIATIONS, LEAST_CUT = 16, 8, 2.0, 0.15
#: Quantiser step of a block's mean: 8 times a flat block's level is its DC coefficient, so 8 stores it exactly.
DC_STEP = 8
ZIGZAG = [r * 8 + c for s in range(15) for r, c in sorted(((i, s - i) for i in range(max(0, s - 7), min(7, s) + 1)), key=lambda x: x[0] if s % 2 else x[1])]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


@cache
def _frame_head() -> bytes:
    """SOI to SOS of a grey baseline frame.

    A DC category of c bits has a code of 10 - c bits, so a code and its bits are always 10 long, and the only AC symbol,
    end of block, has 6: a block is 16 bits, neither byte of which can be 0xFF. Each frame is thus plain to seek in.
    """
    quant = _segment(0xDB, bytes([0, DC_STEP] + [1] * 63))
    size = _segment(0xC0, struct.pack(">BHHB", 8, DOWN * 8, ACROSS * 8, 1) + bytes([1, 0x11, 0]))
    dc = _segment(0xC4, bytes([0x00] + [1 if 2 <= n <= 10 else 0 for n in range(1, 17)] + list(range(8, -1, -1))))
    ac = _segment(0xC4, bytes([0x10] + [1 if n == 6 else 0 for n in range(1, 17)] + [0]))
    scan = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    return b"\xff\xd8" + quant + size + dc + ac + scan


def canonical_codes(counts: list[int], symbols: list[int]) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol of a JPEG Huffman table."""
    found, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            found[length, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return found


@cache
def _words() -> np.ndarray:
    """The 16 bits of a block for each difference from -255 to 255."""
    codes = {s: (n, c) for (n, c), s in canonical_codes([1 if 2 <= n <= 10 else 0 for n in range(1, 17)], list(range(8, -1, -1))).items()}
    out = np.zeros(511, ">u2")
    for d in range(-255, 256):
        bits = abs(d).bit_length()
        length, code = codes[bits]
        extra = d if d > 0 else d + (1 << bits) - 1
        out[d + 255] = ((code << bits) | (extra if bits else 0)) << (16 - length - bits)
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(name: bytes, body: bytes) -> bytes:
    return b"LIST" + struct.pack("<I", len(body) + 4) + name + body


def encode_avi(payload: bytes) -> bytes:
    """An AVI of grey JPEG frames, a sample of the payload to each 8x8 block; its length must be a multiple of FRAME.

    RIFF sizes are 32 bits: payloads above about 1.4 GB can't be stored and raise ValueError.
    """
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload must fill whole frames")
    samples = np.frombuffer(payload, np.uint8).reshape(-1, FRAME).astype(np.int16)
    frames = len(samples)
    words = _words()[np.diff(samples, axis=1, prepend=np.int16(128)) + 255]
    head = _frame_head()
    size = len(head) + 2 * FRAME + 2
    if frames * (size + 24) > 0xFFFF0000:
        raise ValueError("the payload is too long for one RIFF file")
    start = b"00dc" + struct.pack("<I", size) + head
    movi = np.empty((frames, len(start) + 2 * FRAME + 2), np.uint8)
    movi[:, : len(start)] = np.frombuffer(start, np.uint8)
    movi[:, len(start) : -2] = words.view(np.uint8).reshape(frames, -1)
    movi[:, -2:] = (0xFF, 0xD9)
    index = np.empty((frames, 4), "<u4")
    index[:, 0], index[:, 1], index[:, 3] = struct.unpack("<I", b"00dc")[0], 0x10, size
    index[:, 2] = 4 + np.arange(frames) * movi.shape[1]
    avih = struct.pack("<14I", 1_000_000 // FPS, 0, 0, 0x10, frames, 0, 1, size, ACROSS * 8, DOWN * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIII4H", 0, 0, 0, 0, 1, FPS, 0, frames, size, 0xFFFFFFFF, 0, 0, 0, ACROSS * 8, DOWN * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, ACROSS * 8, DOWN * 8, 1, 8, b"MJPG", ACROSS * DOWN * 64, 0, 0, 0, 0)
    header = _list(b"hdrl", _chunk(b"avih", avih) + _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    body = header + _list(b"movi", movi.tobytes()) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body) + 4) + b"AVI " + body


def riff_chunks(data: memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the chunks in a range; a list's name is LIST and its range begins at its type."""
    while start + 8 <= end:
        size = int.from_bytes(data[start + 4 : start + 8], "little")
        yield bytes(data[start : start + 4]), start + 8, min(start + 8 + size, end)
        start += 8 + size + size % 2


def avi_frames(data: bytes) -> tuple[float, list[memoryview]]:
    """Frames a second and the compressed frames of the first video stream, found through idx1, or else by walking movi."""
    view = memoryview(data)
    if bytes(view[:4]) != b"RIFF" or bytes(view[8:12]) != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, stream, streams = 0.0, None, None, None, 0
    todo = [(12, len(data))]
    while todo:
        for name, begin, end in riff_chunks(view, *todo.pop()):
            kind = bytes(view[begin : begin + 4]) if name == b"LIST" else name
            if kind in (b"hdrl", b"strl"):
                todo.append((begin + 4, end))
            elif kind == b"movi":
                movi = (begin, end)
            elif kind == b"idx1":
                index = np.frombuffer(view[begin : end - (end - begin) % 16], "<u4").reshape(-1, 4)
            elif kind == b"strh":
                if stream is None and bytes(view[begin : begin + 4]) == b"vids":
                    scale, rate = struct.unpack("<II", view[begin + 20 : begin + 28])
                    fps, stream = rate / max(scale, 1), streams
                streams += 1
    if movi is None or stream is None:
        raise ValueError("no video stream")
    names = {int.from_bytes(b"%02d" % stream + kind, "little") for kind in (b"dc", b"db")}
    if index is not None and len(index):
        own = index[np.isin(index[:, 0], list(names))]
        base = movi[0] if not len(own) or own[0, 2] < movi[0] else 0
        return fps, [view[base + o + 8 : base + o + 8 + n] for o, n in own[:, 2:].tolist()]
    found = riff_chunks(view, movi[0] + 4, movi[1])
    return fps, [view[b:e] for name, b, e in found if int.from_bytes(name, "little") in names]


@cache
def _cosines() -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    basis[0] /= np.sqrt(2)
    return basis


def jpeg_blocks(frame: bytes) -> np.ndarray:
    """Dequantised coefficients (blocks, 8, 8) of a grey baseline frame, read bit by bit."""
    at, quant, codes, interval, restarts = 2, {}, {}, 0, 0
    while True:
        if frame[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, n = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = bytes(frame[at + 4 : at + 2 + n])
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                counts = list(body[1:17])
                codes[body[0]] = canonical_codes(counts, list(body[17 : 17 + sum(counts)]))
                body = body[17 + sum(counts) :]
        elif marker == 0xC0:
            height, width, parts, table_no = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big"), body[5], body[8]
            if parts != 1:
                raise ValueError("only grey frames are read")
        elif marker == 0xDD:
            interval = int.from_bytes(body, "big")
        elif marker == 0xDA:
            tables = body[2]
            break
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("only baseline frames are read")
    data = bytes(frame[at:])
    pieces, begin, i = [], 0, 0
    while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data):
        if data[i + 1] == 0:
            i += 2
            continue
        pieces.append(data[begin:i])
        begin = i = i + 2
        if not 0xD0 <= data[begin - 1] <= 0xD7:
            break
    else:
        pieces.append(data[begin:])
    blocks = -(-height // 8) * -(-width // 8)
    out = np.zeros((blocks, 64))
    dc, ac, done = codes[tables >> 4], codes[0x10 | tables & 15], 0
    for piece in pieces:
        stream = "".join(f"{x:08b}" for x in piece.replace(b"\xff\x00", b"\xff"))
        p = level = 0

        def symbol(table: dict[tuple[int, int], int]) -> int:
            nonlocal p
            for n in range(1, 17):
                if (found := table.get((n, int(stream[p : p + n], 2)))) is not None:
                    p += n
                    return found
            raise ValueError("a code is unknown")

        def value(bits: int) -> int:
            nonlocal p
            if not bits:
                return 0
            v = int(stream[p : p + bits], 2)
            p += bits
            return v if v >> (bits - 1) else v - (1 << bits) + 1

        for _ in range(min(interval or blocks, blocks - done)):
            level += value(symbol(dc))
            out[done, 0], k = level, 1
            while k < 64:
                if not (s := symbol(ac)):
                    break
                k += s >> 4
                if s & 15:
                    out[done, ZIGZAG[k]] = value(s & 15)
                k += 1
            done += 1
        restarts += 1
    steps = np.zeros(64)
    steps[ZIGZAG] = quant[table_no]
    return (out * steps).reshape(-1, 8, 8)


def decode_frame(frame: bytes) -> np.ndarray:
    """The grey picture of an intra frame, its height and width rounded up to 8."""
    coefficients, c = jpeg_blocks(frame), _cosines()
    at = bytes(frame).index(b"\xff\xc0")
    height, width = struct.unpack(">HH", bytes(frame[at + 5 : at + 9]))
    blocks = np.clip(np.round(np.einsum("ux,nuv,vy->nxy", c, coefficients, c)) + 128, 0, 255).astype(np.uint8)
    down, across = -(-height // 8), -(-width // 8)
    return blocks.reshape(down, across, 8, 8).swapaxes(1, 2).reshape(down * 8, across * 8)


@cache
def _differences() -> np.ndarray:
    """The DC difference of each 16-bit block of `_frame_head` frames; 999 where there is none."""
    out = np.full(65536, 999, np.int16)
    out[_words()] = np.arange(-255, 256)
    return out


def read_samples(data: bytes) -> tuple[float, np.ndarray]:
    """Frames a second and (frames, samples): the level of every block of every frame of an AVI.

    Frames with this module's head have blocks of 16 bits and are decoded together; any other goes bit by bit.
    """
    fps, frames = avi_frames(data)
    head = _frame_head()
    size = len(head) + 2 * FRAME + 2
    if all(len(f) == size for f in frames) and frames:
        together = np.stack([np.frombuffer(f, np.uint8) for f in frames])
        if (together[:, : len(head)] == np.frombuffer(head, np.uint8)).all():
            steps = _differences()[np.ascontiguousarray(together[:, len(head) : -2]).view(">u2")]
            levels = np.cumsum(steps, axis=1, dtype=np.int64) + 128
            if (steps != 999).all() and levels.min() >= 0 and levels.max() <= 255:
                return fps, levels.astype(np.uint8)
    return fps, np.stack([decode_frame(f)[4::8, 4::8].ravel() for f in frames]) if frames else np.empty((0, FRAME), np.uint8)


def shot_starts(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First frames of the shots, and each frame's histogram difference to the one before (0 to 1; 0 for the first).

    A frame starts a shot where its difference is at least LEAST_CUT, at least as large as its neighbours', and above the
    mean of the AROUND differences either side by DEVIATIONS of their standard deviation.
    """
    n = len(samples)
    rows = np.arange(n)[:, None] * BINS + (samples.astype(np.int64) * BINS >> 8)
    histograms = np.bincount(rows.ravel(), minlength=n * BINS).reshape(n, BINS)
    away = np.r_[0.0, np.abs(np.diff(histograms, axis=0)).sum(1) / (2 * samples.shape[1])]
    sums, squares = np.r_[0, np.cumsum(away)], np.r_[0, np.cumsum(away**2)]
    low, high = np.maximum(np.arange(n) - AROUND, 0), np.minimum(np.arange(n) + AROUND + 1, n)
    count = np.maximum(high - low - 1, 1)
    mean = (sums[high] - sums[low] - away) / count
    spread = np.sqrt(np.maximum((squares[high] - squares[low] - away**2) / count - mean**2, 0))
    padded = np.r_[0, away, 0]
    cuts = (away >= LEAST_CUT) & (away >= mean + DEVIATIONS * spread) & (away >= padded[:-2]) & (away >= padded[2:])
    cuts[0] = True
    return np.flatnonzero(cuts), away


def media_row(text: bytes | None) -> tuple[int, bytes]:
    """n_bytes and the AVI of a text: its bytes, then spaces up to a positive multiple of FRAME."""
    text = text or b""
    size = max(1, -(-len(text) // FRAME)) * FRAME
    return len(text), encode_avi(text.ljust(size, b" "))


def clips_of(media: bytes) -> tuple[bytes, list[dict]]:
    """The payload read back, and the shots in order: first and last frame, seconds, mean level, cut strength."""
    fps, samples = read_samples(media)
    starts, away = shot_starts(samples)
    ends = np.r_[starts[1:], len(samples)]
    means = samples.mean(axis=1)
    clips = [
        {"clip": i, "first_frame": s, "frames": e - s, "start_s": s / fps, "end_s": e / fps, "level": float(means[s:e].mean()), "cut": float(away[s])}
        for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True))
    ]
    return samples.tobytes(), clips


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 256):  # media is nearly three times the text: keep batches small
            part = batch.slice(i, 256)
            rows = [media_row(t.as_py()) for t in part.column("_text")]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())],
                ["doc_id", "n_bytes", "media"],
            )


def encode_media(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, media, the AVI of its text (a null text is empty)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("_text"))
    return rows.mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


CLIP = "struct<clip:int,first_frame:long,frames:long,start_s:double,end_s:double,level:double,cut:double>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("clip", pa.int32()), ("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("level", pa.float64()), ("cut", pa.float64())]))
    for batch in batches:
        rows = []
        for cell in batch.column("media"):
            media = cell.as_py()
            payload, clips = clips_of(media)
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), clips))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), kind)
        columns = zip(*rows, strict=True) if rows else [[]] * 6
        found = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        names = [n for n in batch.schema.names if n != "media"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), *found],
            [*names, "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"],
        )


def read_media(media: DataFrame) -> DataFrame:
    """Decode a `media` column: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, clips; other columns
    stay. Media that aren't grey motion-JPEG AVI fail the task."""
    kept = ", ".join(f"`{n}` {t}" for n, t in media.dtypes if n != "media")
    added = f"payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<{CLIP}>"
    return media.mapInArrow(_read, f"{kept}, {added}")


def clip_rows(read: DataFrame) -> DataFrame:
    """One row per shot: doc_id and the clip's columns."""
    return read.select("doc_id", F.inline("clips"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature: the number of shots, then each as first frame + frames @ mean level.

    A null or empty text is one frame of spaces. Equal texts give equal rows; repeated rows stay; empty tables give none.
    """
    read = read_media(encode_media(table(spark, sf_dir, "documents")))
    shot = F.transform("clips", lambda c: F.format_string("%d+%d@%.2f", c["first_frame"], c["frames"], c["level"]))
    feature = F.concat(F.size("clips").cast("string"), F.lit(":"), F.concat_ws(",", shot))
    return read.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature")
    )
