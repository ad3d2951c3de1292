"""Media columns: Netpbm and BMP decoded to numpy arrays, area-resized, written as NPY tiles with difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

#: Samples in a row of the images that hold payloads; a payload is padded to a multiple of it.
ROW = 64
#: Rows that area_resize() reads at once, and samples where rows are long.
STRIP = 4096
STRIP_SAMPLES = 1 << 21
_SPACE = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])+")
_DIGITS = re.compile(rb"\d+")
_NUMBER = re.compile(rb"\d{1,23}")


def encode_pgm(image: np.ndarray) -> bytes:
    """8-bit grey samples (height, width) as binary PGM."""
    height, width = image.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    height, width, _ = image.shape
    return b"P6\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """8-bit grey (height, width) or RGB (height, width, 3) samples as an uncompressed BMP."""
    height, width = image.shape[:2]
    grey = image.ndim == 2
    line = width * (1 if grey else 3)
    stride = (line + 3) // 4 * 4
    body = np.zeros((height, stride), np.uint8)
    body[:, :line] = (image if grey else image[:, :, ::-1].reshape(height, line))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3:] = 0
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + body.size, 0, 0, start)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, len(palette), 0) + palette.tobytes() + body.tobytes()


def decode(data: bytes) -> np.ndarray:
    """Netpbm P1 to P6 or uncompressed BMP (1, 4, 8, 24, 32 bits) to an array (height, width[, 3]); ValueError otherwise.

    Samples keep their values: uint8, or uint16 where a Netpbm maximum is over 255; bitmaps give 0
    for black and 1 for white; a BMP whose palette is the grey ramp gives the grey samples.  Samples
    over the stated maximum, below 0 or outside the palette are errors, as are sizes that the data
    can't fill; nothing is allocated by what a header says alone.
    """
    if data[:2] == b"BM":
        return _decode_bmp(data)
    if len(data) > 2 and data[:1] == b"P" and data[1:2] in b"123456":
        return _decode_netpbm(data)
    raise ValueError("neither Netpbm nor BMP")


def _decode_netpbm(data: bytes) -> np.ndarray:
    kind, at, numbers = data[1] - 48, 2, []
    for _ in range(2 if kind in (1, 4) else 3):
        gap = _SPACE.match(data, at)
        digits = _DIGITS.match(data, gap.end() if gap else at)
        if not gap or not digits:
            raise ValueError("the Netpbm header is broken")
        if digits.end() - digits.start() > 9:
            raise ValueError("a number of the Netpbm header is too large")
        numbers.append(int(digits[0]))
        at = digits.end()
    width, height, most = (*numbers, 1)[:3]
    if not 0 < most < 65536:
        raise ValueError("the Netpbm maximum must be from 1 to 65535")
    channels = 3 if kind in (3, 6) else 1
    n = width * height * channels
    if kind == 4:
        line = (width + 7) // 8
        bits = np.unpackbits(_taken(data, at + 1, line * height).reshape(height, line), axis=1)[:, :width]
        return 1 - bits
    if kind == 1:
        digits = np.frombuffer(b"".join(re.sub(rb"#[^\r\n]*", b"", data[at:]).split())[:n], np.uint8)
        if len(digits) and not np.isin(digits, (48, 49)).all():
            raise ValueError("a sample of the bitmap is neither 0 nor 1")
        values = 49 - digits
    elif kind in (2, 3):
        words = re.sub(rb"#[^\r\n]*", b"", data[at:]).split()[:n]
        if not all(_NUMBER.fullmatch(w) for w in words):
            raise ValueError("a sample is no number")
        values = np.array([min(int(w), most + 1) for w in words], np.int64)
        if len(values) and values.max() > most:
            raise ValueError("a sample is over the maximum")
        values = values.astype(np.uint8 if most < 256 else np.uint16)
    elif most < 256:
        values = _taken(data, at + 1, n)
    else:
        values = _taken(data, at + 1, 2 * n).view(">u2").astype(np.uint16)
    if len(values) < n:
        raise ValueError("the image is cut short")
    if kind in (5, 6) and most not in (255, 65535) and n and values.max() > most:
        raise ValueError("a sample is over the maximum")
    return values.reshape((height, width, 3) if channels == 3 else (height, width))


def _taken(data: bytes, at: int, n: int) -> np.ndarray:
    if len(data) < at + n:
        raise ValueError("the image is cut short")
    return np.frombuffer(data, np.uint8, n, at)


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("the BMP header is cut short")
    (start,) = struct.unpack_from("<I", data, 10)
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", data, 14)
    if size < 40 or packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height or (packing == 3 and bits != 32):
        raise ValueError("this kind of BMP is not supported")
    stride = (width * bits + 31) // 32 * 4
    body = _taken(data, start, stride * abs(height)).reshape(abs(height), stride)
    body = body[::-1] if height > 0 else body
    if packing == 3:  # which byte of a sample is red, green and blue
        places = {0xFF << 8 * k: k for k in range(4)}
        order = [places.get(m) for m in struct.unpack("<III", _taken(data, 54, 12).tobytes())]
        if None in order or len(set(order)) < 3:
            raise ValueError("masks of the BMP that aren't whole bytes are not supported")
        return body[:, : width * 4].reshape(abs(height), width, 4)[:, :, order]
    if bits >= 24:
        return body[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    (used,) = struct.unpack_from("<I", data, 46)
    index = body if bits == 8 else np.unpackbits(body, axis=1).reshape(abs(height), -1, bits) @ (1 << np.arange(bits)[::-1]).astype(np.uint8)
    index = index[:, :width]
    if used > 1 << bits:
        raise ValueError("the BMP palette is too large")
    palette = _taken(data, 14 + size, 4 * (used or 1 << bits)).reshape(-1, 4)[:, 2::-1]
    if index.max() >= len(palette):
        raise ValueError("a sample is outside the BMP palette")
    if (palette[:, :1] == palette).all():
        grey = palette[:, 0]
        return index if bits == 8 and len(grey) == 256 and (grey == np.arange(256)).all() else grey[index]
    return palette[index]


def grey(image: np.ndarray) -> np.ndarray:
    """Luma of RGB samples, or the samples themselves, as float64."""
    return image.astype(np.float64) if image.ndim == 2 else image.astype(np.float64) @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean luma of the image under each cell of a height x width grid, by its integral image (float64).

    Cells need not fall on samples: the integral is interpolated between them, which weighs a sample
    by the part of it that the cell covers.  The integral is made strip by strip and kept only at
    the grid's lines, so memory doesn't grow with the image.
    """
    rows, columns = image.shape[:2]
    if not rows or not columns:
        return np.zeros((height, width))
    x, y = np.linspace(0, columns, width + 1), np.linspace(0, rows, height + 1)
    at = np.minimum(x.astype(np.int64), columns - 1)
    lines = np.zeros((height + 1, width + 1))
    total = np.zeros(width + 1)
    step = max(1, min(STRIP, STRIP_SAMPLES // columns))
    for top in range(0, rows, step):
        strip = grey(image[top : top + step])
        across = np.zeros((len(strip), columns + 1))
        np.cumsum(strip, axis=1, out=across[:, 1:])
        across = across[:, at] + (across[:, at + 1] - across[:, at]) * (x - at)
        down = np.vstack([total, total + np.cumsum(across, axis=0)])
        for k in np.flatnonzero((y >= top) & (y <= top + len(strip))):
            i = min(int(y[k]) - top, len(strip) - 1)
            lines[k] = down[i] + (down[i + 1] - down[i]) * (y[k] - top - i)
        total = down[-1]
    cells = lines[1:, 1:] - lines[:-1, 1:] - lines[1:, :-1] + lines[:-1, :-1]
    return cells * (width * height / (rows * columns))


def difference_hash(image: np.ndarray, size: int = 8) -> str:
    """Hex of size*size bits: whether a cell is brighter than its left neighbour."""
    small = np.round(area_resize(image, size, size + 1), 6)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def npy_tile(image: np.ndarray, side: int = 32) -> bytes:
    """The image's luma area-resized to side x side samples, as an NPY file: uint8, or uint16 if the image has other samples."""
    out = io.BytesIO()
    kind = np.uint8 if image.dtype == np.uint8 else np.uint16
    np.save(out, np.clip(np.rint(area_resize(image, side, side)), 0, np.iinfo(kind).max).astype(kind), allow_pickle=False)
    return out.getvalue()


def media_tiles(df: DataFrame, media_col: str = "media", id_col: str = "doc_id", side: int = 32) -> DataFrame:
    """Decodes a binary media column: id, height, width, channels, tile (NPY bytes), dhash, error.

    A null, empty or broken image gives null in all but the id and error, which says why; it never
    ends the job.  An image without rows or columns has a tile and a hash of zeros.  Other columns
    are dropped; equal rows give equal rows, an empty table an empty one.
    """

    def make():
        def one(data: bytes | None) -> tuple:
            try:
                image = decode(data or b"")
            except ValueError as e:
                return None, None, None, None, None, str(e)
            return image.shape[0], image.shape[1], 1 if image.ndim == 2 else 3, npy_tile(image, side), difference_hash(image), None

        def f(batch: pa.RecordBatch) -> dict:
            got = [one(x) for x in batch.column(1).to_pylist()]
            names = ("height", "width", "channels", "tile", "dhash", "error")
            return {id_col: batch.column(0)} | {n: [g[i] for g in got] for i, n in enumerate(names)}

        return f

    return arrow_map(df.select(F.col(id_col).cast("bigint"), F.col(media_col).cast("binary")), make, f"{id_col} bigint, height int, width int, channels int, tile binary, dhash string, error string", text_col=1)


def container_of(payload: bytes) -> str:
    """The container that a payload is stored in by turns: one of the grey ones, or of all where it fills whole RGB rows."""
    kinds = ("pgm", "bmp", "ppm", "bmp24") if len(payload) % (3 * ROW) == 0 else ("pgm", "bmp")
    return kinds[zlib.crc32(payload) % len(kinds)]


def store_payload(payload: bytes, container: str = "turns") -> bytes:
    """A payload, a multiple of ROW bytes long, as the samples of an image ROW wide: PGM, 8-bit BMP, or, of 3 * ROW bytes a row, PPM or 24-bit BMP.

    By turns the payload itself says which, so equal payloads are stored alike.
    """
    container = container_of(payload) if container == "turns" else container
    samples = np.frombuffer(payload, np.uint8)
    image = samples.reshape((-1, ROW, 3) if container in ("ppm", "bmp24") else (-1, ROW))
    return {"pgm": encode_pgm, "bmp": encode_bmp, "ppm": encode_ppm, "bmp24": encode_bmp}[container](image)


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", container: str = "turns", side: int = 32, keep_media: bool = False) -> DataFrame:
    """Texts stored losslessly as images, and what is read back from those: sizes, digests, tile and hash.

    The UTF-8 bytes, zeros up to a positive multiple of 64, are the samples of an image 64 wide: grey or, where
    they fill its rows, RGB; PGM, PPM and BMP by turns, or all in the container named.
    payload_* and tail_crc32 come from decoding the stored image; feature is the difference hash and
    the digest of the NPY tile.  Null text is empty text (64 zeros).  Equal texts give equal values
    and rows that repeat stay; other columns are dropped, an empty table gives an empty one.
    """
    extra = ", media binary, tile binary" if keep_media else ""
    schema = f"{id_col} bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string{extra}"
    names = [x.split()[0] for x in schema.split(", ")]

    def make():
        def one(key: int, text: str | None) -> tuple:
            raw = (text or "").encode()
            media = store_payload(raw + bytes(-len(raw) % ROW or (ROW if not raw else 0)), container)
            image = decode(media)
            payload = image.tobytes()
            tile = npy_tile(image, side)
            feature = f"{difference_hash(image)}:{hashlib.sha256(tile).hexdigest()[:16]}"
            row = key, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature
            return (*row, media, tile) if keep_media else row

        def f(batch: pa.RecordBatch) -> dict:
            rows = [one(*x) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            return dict(zip(names, zip(*rows, strict=True), strict=True))

        return f

    return arrow_map(docs.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("string")), make, schema, text_col=1)
