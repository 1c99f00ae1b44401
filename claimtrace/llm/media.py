"""Media columns: AVI motion-JPEG.

A payload of bytes becomes a film in a binary column and is read back from it. The films are ordinary AVI files with
an index; the frames are ordinary grey baseline JPEG pictures, so the reader here takes those of other writers too.

The unit in which JPEG is lossless is the quantised coefficient. A frame of 32 x 24 pixels has 12 blocks, and each
holds 48 bytes of payload in its first 48 coefficients after the DC one: all are of size category 8, whose eight
extra bits are the byte. One-bit codes for that category make all blocks equally long, so frames are packed as arrays.
Reading decodes the Huffman codes that a picture's own tables define, symbol by symbol, for many grey pictures with
equal headers at once. Shots are found in the decoded pixels.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimtrace.llm.common import unused, whole

WIDTH, HEIGHT, FPS = 32, 24, 25
BLOCKS, HELD = WIDTH * HEIGHT // 64, 48
FRAME_BYTES = BLOCKS * HELD  # 576
FILL = 255
SCAN_BITS = BLOCKS * (1 + 9 * HELD + 2)
SCAN_BYTES = -(-SCAN_BITS // 8)
#: Frames are handled in blocks of so many, which bounds memory for long payloads.
AT_ONCE = 1024
#: Shots: bins of the luminance histogram, frames that the threshold looks back, its standard deviations and floor.
BINS, BACK, DEVIATIONS, FLOOR = 16, 12, 3.0, 0.08


class MediaError(ValueError):
    """A film or picture that can't be read."""


# ---- JPEG ----------------------------------------------------------------------------------------------------------


@cache
def zigzag() -> np.ndarray:
    """Row-major places of the 64 coefficients in the order in which JPEG stores them."""
    return np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i % 8 if (i // 8 + i % 8) % 2 == 0 else i // 8)))


@cache
def _cosines() -> np.ndarray:
    """From 64 row-major coefficients to 64 pixels, as one matrix."""
    x, u = np.arange(8)[:, None], np.arange(8)[None, :]
    c = np.cos((2 * x + 1) * u * np.pi / 16) * np.where(u == 0, np.sqrt(1 / 8), 1 / 2)
    return np.einsum("yv,xu->vuyx", c, c).reshape(64, 64).astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _huffman(kind: int, *codes: tuple[int, int]) -> bytes:
    """A table's segment from (length, symbol) in order of length."""
    lengths = bytes(sum(n == i for n, _ in codes) for i in range(1, 17))
    return _segment(0xC4, bytes([kind]) + lengths + bytes(s for _, s in codes))


@cache
def _head() -> bytes:
    quant = _segment(0xDB, bytes([0] + [1] * 64))
    frame = _segment(0xC0, struct.pack(">BHHB3B", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
    tables = _huffman(0x00, (1, 0)) + _huffman(0x10, (1, 8), (2, 0))
    return b"\xff\xd8" + quant + frame + tables + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))


def encode_frames(payload: bytes) -> list[bytes]:
    """JPEG pictures that hold the payload, whose length is a positive multiple of FRAME_BYTES."""
    data = np.frombuffer(payload, dtype=np.uint8).reshape(-1, BLOCKS, HELD)
    head, out = _head(), []
    for i in range(0, len(data), AT_ONCE):
        part = data[i : i + AT_ONCE]
        bits = np.zeros((len(part), BLOCKS, 1 + 9 * HELD + 2), dtype=np.uint8)
        bits[:, :, 1:-2].reshape(len(part), BLOCKS, HELD, 9)[..., 1:] = np.unpackbits(part, axis=2).reshape(len(part), BLOCKS, HELD, 8)
        bits[:, :, -2] = 1
        flat = np.ones((len(part), SCAN_BYTES * 8), dtype=np.uint8)
        flat[:, :SCAN_BITS] = bits.reshape(len(part), -1)
        for scan in np.packbits(flat, axis=1):
            out.append(head + scan.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9")
    return out


def _extend(value: int, size: int) -> int:
    return value if size == 0 or value >> (size - 1) else value - (1 << size) + 1


@dataclass(frozen=True)
class Header:
    """What stands before a picture's scan: ``parts`` are component, horizontal and vertical sampling, quantiser table;
    ``scan`` maps components to their Huffman tables, ``tables`` these to symbols by code length and code."""

    width: int
    height: int
    parts: tuple[tuple[int, int, int, int], ...]
    quants: dict[int, np.ndarray]
    tables: dict[int, dict[tuple[int, int], int]]
    scan: dict[int, int]
    end: int


def read_header(data: bytes) -> Header:
    """The header of a baseline Huffman JPEG without restarts."""
    at, quants, tables, parts, scan, width, height = 2, {}, {}, None, None, 0, 0
    while scan is None:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise MediaError("a broken JPEG header")
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body, at = data[at + 4 : at + 2 + size], at + 2 + size
        if len(body) < size - 2:
            raise MediaError("a broken JPEG header")
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body, dtype=">u2" if wide else "u1", count=64, offset=1).astype(np.float32)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                kind, lengths, code, codes, k = body[0], body[1:17], 0, {}, 17
                for n, many in enumerate(lengths, 1):
                    for _ in range(many):
                        codes[n, code] = body[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                tables[kind], body = codes, body[k:]
        elif marker == 0xC0:
            _, height, width, n = struct.unpack_from(">BHHB", body)
            parts = tuple((body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n))
        elif 0xC1 <= marker <= 0xCF:
            raise MediaError("not a baseline JPEG")
        elif marker == 0xDD and struct.unpack(">H", body)[0]:
            raise MediaError("restart intervals aren't read")
        elif marker == 0xDA:
            scan = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
    if parts is None or len(scan) != len(parts):
        raise MediaError("only single interleaved scans are read")
    return Header(width, height, parts, quants, tables, scan, at)


def _scan_of(data: bytes, header: Header) -> bytes:
    """The scan's bits, without the zero bytes that are stuffed in after bytes 255."""
    end = data.rfind(b"\xff\xd9")
    return data[header.end : end if end >= header.end else len(data)].replace(b"\xff\x00", b"\xff")


def decode_picture(data: bytes) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Width, height, and the first component's blocks and quantisers, of any baseline Huffman JPEG without restarts.

    Blocks are rows of 64 quantised coefficients in storage order, by block row and column.
    """
    header = read_header(data)
    parts, scan, tables = header.parts, header.scan, header.tables
    raw = _scan_of(data, header)
    length, where = len(raw) * 8, 0

    def take(n: int) -> int:
        nonlocal where
        where += n
        if where > length:
            raise MediaError("a JPEG scan ends too early")
        return chunk(where - n, n)

    def chunk(start: int, n: int) -> int:
        a, b = start // 8, -(-(start + n) // 8)
        return (int.from_bytes(raw[a:b], "big") >> (b * 8 - start - n)) & ((1 << n) - 1)

    def symbol(codes: dict) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | take(1)
            if (n, code) in codes:
                return codes[n, code]
        raise MediaError("an unknown JPEG code")

    most_h, most_v = max(p[1] for p in parts), max(p[2] for p in parts)
    across, down = -(-header.width // (8 * most_h)), -(-header.height // (8 * most_v))
    if len(parts) == 1:
        across, down = -(-header.width // 8), -(-header.height // 8)
    sizes = [(1, 1)] if len(parts) == 1 else [(p[1], p[2]) for p in parts]
    first = np.zeros((down * sizes[0][1], across * sizes[0][0], 64), dtype=np.int32)
    before = [0] * len(parts)
    for my in range(down):
        for mx in range(across):
            for c, (h, v) in enumerate(sizes):
                which = scan[parts[c][0]]
                dc, ac = tables[which >> 4], tables[16 + (which & 15)]
                for b in range(h * v):
                    block = np.zeros(64, dtype=np.int32)
                    size = symbol(dc)
                    before[c] += _extend(take(size), size) if size else 0
                    block[0], k = before[c], 1
                    while k < 64:
                        run, size = divmod(symbol(ac), 16)
                        if size == 0 and run != 15:
                            break
                        k += run
                        if k > 63:
                            raise MediaError("a JPEG block is too long")
                        if size:
                            block[k] = _extend(take(size), size)
                        k += 1
                    if c == 0:
                        first[my * v + b // h, mx * h + b % h] = block
    return header.width, header.height, first.reshape(-1, 64), header.quants[parts[0][3]]


#: How far an end-of-block code leads; no run does.
END = 1000


def _lookup(codes: dict[tuple[int, int], int], first: bool) -> np.ndarray:
    """For any 16 bits what the code that they begin with asks for, ``first`` for a block's first coefficient.

    Columns: bits taken in all, how far to shift 32 bits for the value's own bits, their mask, the least value that isn't
    negative, what is taken from negative ones, and how many coefficients are left out. Unknown codes take more bits than any scan has.
    """
    out = np.zeros((1 << 16, 6), dtype=np.int64)
    out[:, 0] = 1 << 40
    for (n, code), symbol in codes.items():
        run, size = (0, symbol & 15) if first else divmod(symbol, 16)
        skip = END if not first and symbol == 0 else run
        out[code << (16 - n) : (code + 1) << (16 - n)] = n + size, 32 - n - size, (1 << size) - 1, 1 << size >> 1, (1 << size) - 1, skip
    return out


def decode_alike(scans: list[bytes], header: Header) -> np.ndarray:
    """Coefficients as (picture, block, 64) of grey pictures that share a header: one symbol of each picture per step."""
    n, blocks = len(scans), -(-header.width // 8) * -(-header.height // 8)
    which = header.scan[header.parts[0][0]]
    table = np.concatenate([_lookup(header.tables[which >> 4], True), _lookup(header.tables[16 + (which & 15)], False)])
    sizes = np.array(list(map(len, scans)), dtype=np.int64)
    flat = np.frombuffer(b"".join(s + bytes(8) for s in scans), dtype=np.uint8)
    # 40 bits from each byte on hold a code of up to 16 bits and as many further ones, wherever in the byte it begins
    word = sum(flat[i : len(flat) - 4 + i].astype(np.int64) << (32 - 8 * i) for i in range(5))
    start = np.concatenate([[0], np.cumsum(sizes + 8)[:-1]])
    out = np.zeros(n * blocks * 64 + 1, dtype=np.int32)  # the last takes what is written nowhere
    own, at, stop, place = np.arange(n) * (blocks * 64), start * 8, (start + sizes) * 8, np.zeros(n, dtype=np.int64)
    while len(own):
        k = place & 63
        bits = word[at >> 3] >> (8 - (at & 7)) & 0xFFFFFFFF
        row = table[(bits >> 16) + ((k > 0) << 16)]
        value = bits >> np.maximum(row[:, 1], 0) & row[:, 2]
        value -= row[:, 4] * (value < row[:, 3])
        at = at + row[:, 0]
        if (at > stop).any():
            raise MediaError("an unknown JPEG code, or a scan that ends too early")
        skip = row[:, 5]
        k += skip
        if ((k > 63) & (k < END)).any():
            raise MediaError("a JPEG block is too long")
        ends = skip == END
        place = place + skip
        out[np.where(ends, -1, own + place)] = value
        place = np.where(ends, (place - END) | 63, place) + 1
        going = place < blocks * 64
        if not going.all():
            own, at, stop, place = (x[going] for x in (own, at, stop, place))
    found = out[:-1].reshape(n, blocks, 64)
    found[:, :, 0] = np.cumsum(found[:, :, 0], axis=1)  # first coefficients are stored as differences
    return found


def decode_frames(frames: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of equally large frames as (frame, block, 64) in storage order, and the quantisers."""
    header = read_header(frames[0])
    head = frames[0][: header.end]
    if len(header.parts) == 1 and all(f.startswith(head) for f in frames):
        return decode_alike([_scan_of(f, header) for f in frames], header), header.quants[header.parts[0][3]]
    read = [decode_picture(f) for f in frames]
    if len({r[:2] for r in read}) > 1:
        raise MediaError("pictures of unequal size")
    return np.stack([r[2] for r in read]), read[0][3]


def payload_of(blocks: np.ndarray) -> bytes:
    held = blocks[:, :, 1 : HELD + 1]
    return np.where(held > 0, held, held + 255).astype(np.uint8).tobytes()


def luminance(blocks: np.ndarray, quants: np.ndarray) -> np.ndarray:
    """Pixels 0 to 255 as (frame, block, 64)."""
    level = np.zeros(blocks.shape, dtype=np.float32)
    level[..., zigzag()] = blocks * quants
    pixels = level.reshape(-1, 64) @ _cosines()
    return np.clip(np.rint(pixels) + 128, 0, 255).astype(np.uint8).reshape(blocks.shape)


# ---- AVI -----------------------------------------------------------------------------------------------------------


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], width: int = WIDTH, height: int = HEIGHT, fps: int = FPS) -> bytes:
    n, largest = len(frames), max(map(len, frames), default=0)
    main = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, n, 0, 1, largest, width, height, 0, 0, 0, 0)
    head = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    form = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    stream = _chunk(b"LIST", b"strl" + _chunk(b"strh", head) + _chunk(b"strf", form))
    listed = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + stream)
    at, index, body = 4, [], []
    for f in frames:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        body.append(_chunk(b"00dc", f))
        at += len(body[-1])
    return _chunk(b"RIFF", b"AVI " + listed + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds per frame, and the video frames in the order of the index (of the file where there is none)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise MediaError("not an AVI file")
    micros, movi, index, frames = 0, None, None, []

    def walk(at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if at + 8 + size > end:
                raise MediaError("an AVI chunk is cut off")
            yield name, at + 8, size
            at += 8 + size + size % 2

    for name, at, size in walk(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0])):
        kind = data[at : at + 4]
        if name == b"LIST" and kind == b"hdrl":
            micros = next((struct.unpack_from("<I", data, a)[0] for n, a, _ in walk(at + 4, at + size) if n == b"avih"), 0)
        elif name == b"LIST" and kind == b"movi":
            movi = at, size
        elif name == b"idx1":
            index = at, size
    if movi is None or not micros:
        raise MediaError("an AVI file without header or frames")
    if index is None:
        return micros, [data[a : a + s] for n, a, s in walk(movi[0] + 4, movi[0] + movi[1]) if n[2:] in (b"dc", b"db")]
    entries = list(struct.iter_unpack("<4sIII", data[index[0] : index[0] + index[1] // 16 * 16]))
    base = movi[0] if not entries or entries[0][2] < movi[0] else 0  # some writers count from the file's start
    for name, _, offset, size in entries:
        if name[2:] in (b"dc", b"db"):
            if data[base + offset : base + offset + 4] != name:
                raise MediaError("an AVI index that points nowhere")
            frames.append(data[base + offset + 8 : base + offset + 8 + size])
    return micros, frames


# ---- shots ---------------------------------------------------------------------------------------------------------


def histograms(pixels: np.ndarray) -> np.ndarray:
    """Shares of pixels by luminance bin, for each frame."""
    n = len(pixels)
    flat = pixels.reshape(n, -1)
    places = (flat // (256 // BINS)).astype(np.int64) + np.arange(n)[:, None] * BINS
    return np.bincount(places.ravel(), minlength=n * BINS).reshape(n, BINS) / flat.shape[1]


def cuts(hists: np.ndarray) -> list[int]:
    """Frames that begin a shot after the first: their histogram differs by more than the frames before them lead to
    expect, the mean of the last BACK differences and DEVIATIONS standard deviations, FLOOR at least."""
    change = np.abs(np.diff(hists, axis=0)).sum(axis=1) / 2
    found, since = [], 0
    for i, c in enumerate(change):
        last = change[max(since, i - BACK) : i]
        expected = last.mean() + DEVIATIONS * last.std() if len(last) >= 2 else 4 * FLOOR
        if c > max(FLOOR, expected):
            found.append(i + 1)
            since = i + 1
    return found


#: A film of a longer text would not fit into a binary value.
MOST_BYTES = 1_600_000_000


def store(text: str) -> bytes:
    """The text's UTF-8 bytes as a film, filled up with bytes 255 to at least one and only whole frames."""
    raw = text.encode("utf-8")
    if len(raw) > MOST_BYTES:
        raise MediaError("a text too long for a film")
    return write_avi(encode_frames(raw + bytes([FILL]) * (max(1, -(-len(raw) // FRAME_BYTES)) * FRAME_BYTES - len(raw))))


def recall(films: list[bytes]) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """For each film of this writer the payload that it holds, and its clips: number, start and end in ms, frames.

    Frames of all films are decoded together, AT_ONCE at a time.
    """
    read = [read_avi(f) for f in films]
    every = [f for _, frames in read for f in frames]
    parts = (decode_frames(every[i : i + AT_ONCE]) for i in range(0, len(every), AT_ONCE))
    payloads, hists = zip(*((payload_of(blocks), histograms(luminance(blocks, quants))) for blocks, quants in parts), strict=True)
    payload, hist, at = b"".join(payloads), np.concatenate(hists), 0
    for micros, frames in read:
        end = at + len(frames)
        yield payload[at * FRAME_BYTES : end * FRAME_BYTES], timed(hist[at:end], micros)
        at = end


def clips_of(media: bytes) -> list[tuple[int, int, int, int]]:
    """The clips of any motion-JPEG film."""
    micros, frames = read_avi(media)
    hists = [histograms(luminance(*decode_frames(frames[i : i + AT_ONCE]))) for i in range(0, len(frames), AT_ONCE)]
    return timed(np.concatenate(hists) if hists else np.zeros((0, BINS)), micros)


def timed(hists: np.ndarray, micros: int) -> list[tuple[int, int, int, int]]:
    edges = [0, *cuts(hists), len(hists)] if len(hists) else []
    return [(k, a * micros // 1000, b * micros // 1000, b - a) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


# ---- columns -------------------------------------------------------------------------------------------------------

CLIPS = "array<struct<clip:int,start_ms:long,end_ms:long,frames:int>>"


def _clip_dicts(clips: list[tuple[int, int, int, int]]) -> list[dict]:
    return [dict(zip(("clip", "start_ms", "end_ms", "frames"), c, strict=True)) for c in clips]


def to_media(text: Column) -> Column:
    """A film for each text."""

    @F.pandas_udf("binary")
    def stored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([store(t) for t in texts], dtype=object)

    return stored(text)


READ = f"media binary, payload_bytes long, payload_sha256 string, tail_crc32 long, clips {CLIPS}"
#: Films are handed on in groups of texts of so many characters (or one text).
CHARS_AT_ONCE = 1_000_000


def stored_and_read(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the columns of READ: the film of each text, and what reading it gives, its payload as size, hash
    and checksum of its last 32 bytes, and the clips. As ``with_media``; the text itself is left out. A text whose film
    would pass the 2 GB that a binary value holds, or the 4 GB of RIFF (texts of over MOST_BYTES), raises a MediaError."""
    names = ["media", "payload_bytes", "payload_sha256", "tail_crc32", "clips"]
    rest = [c for c in docs.columns if c not in (*names, text)]
    kinds = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.list_(pa.struct([("clip", pa.int32()), ("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int32())]))]

    def group(bodies: list[str]) -> list[tuple]:
        films = [store(b) for b in bodies]
        return [(film, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), _clip_dicts(shots)) for film, (payload, shots) in zip(films, recall(films), strict=True)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, texts, at = batch.columns[: len(rest)], batch.column(len(rest)), 0
            while at < batch.num_rows:
                bodies, size, start = [], 0, at
                while at < batch.num_rows and (not bodies or size < CHARS_AT_ONCE):
                    bodies.append(texts[at].as_py())
                    size, at = size + len(bodies[-1]), at + 1
                made = [pa.array(c, k) for c, k in zip(zip(*group(bodies), strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*(c.slice(start, at - start) for c in kept), *made], names=[*rest, *names])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*rest).schema), READ])
    return docs.select(*rest, whole(text).alias(*unused(docs, "_text"))).mapInArrow(each, fields)


def clips(media: Column) -> Column:
    """The clips of any motion-JPEG film."""

    @F.pandas_udf(CLIPS)
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for films in batches:
            yield pd.Series([None if f is None else _clip_dicts(clips_of(f)) for f in films], dtype=object)

    return read(media)


def clip_rows(films: DataFrame, media: str = "media") -> DataFrame:
    """One row per clip: the other columns, and ``clip, start_ms, end_ms, frames``. Null films have no clips; broken
    ones raise a MediaError; input columns named like a result are replaced."""
    rest = [c for c in films.columns if c not in (media, "clip", "start_ms", "end_ms", "frames")]
    return films.select(*rest, F.inline(clips(F.col(media))))


def feature(shots: Column) -> Column:
    """Clips as text: start and end in milliseconds."""
    return F.array_join(F.transform(shots, lambda c: F.concat_ws("-", c["start_ms"], c["end_ms"])), ",")


def with_media(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the binary column ``media``, the film of each text.

    Null texts are stored as empty ones, one frame of bytes 255. Equal texts have equal films. Films of long texts are
    made and read in blocks of frames. An input column named ``media`` is replaced; an empty table gives an empty one.
    """
    return docs.withColumn("media", to_media(whole(text)))
