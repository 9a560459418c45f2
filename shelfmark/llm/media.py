"""Media columns: Netpbm and BMP bytes decoded to numpy arrays, area-resized by integral images, and written as NPY tiles
with difference hashes.

``media`` turns a binary column of images into tiles and features; ``text_media`` first stores texts as 8-bit greymaps.
Damaged or unknown images give null results instead of failing the job, and so do foreign ones of more than MOST_PIXELS.
Null texts count as empty, and empty texts become one row of zero bytes. Texts of any length are stored whole; a task holds a
few copies of one text. Repeated rows are treated alike, each for itself. An empty table gives no rows. Columns besides the
key and the text or image are left out, whatever their names.
"""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import map_arrow, rows_by_text, texts

WIDTH = 64
TILE_ROWS = 256
_HEADER = re.compile(rb"(P[1-6])((?:[\x20\x09-\x0D]|#[^\n\r]*[\n\r])+)")
_NUMBER = re.compile(rb"(?:[\x20\x09-\x0D]|#[^\n\r]*[\n\r])*([0-9]+)")


#: Pixels of the largest foreign image that is read; greymaps that hold texts are read at any size.
MOST_PIXELS = 1 << 28


def sized(width: int, height: int, most: int | None) -> None:
    if not (0 < width and 0 < height and (most is None or width * height <= most)):
        raise ValueError("an image of this size is not read")


def taken(data: bytes, size: int, at: int) -> np.ndarray:
    """``size`` bytes from ``at`` on, if there are as many."""
    if at < 0 or at + size > len(data):
        raise ValueError("an image's samples end early")
    return np.frombuffer(data, np.uint8, size, at)


def decode_netpbm(data: bytes, most: int | None = MOST_PIXELS) -> np.ndarray:
    """P1 to P6 with at most 8 bits a sample and ``most`` pixels (None: any number), as (height, width, channels); bitmaps give 0
    for black and 255 for white. Samples above the maximum that the header gives are an error."""
    head = _HEADER.match(data)
    if not head:
        raise ValueError("not a Netpbm image")
    kind, at, sizes = head[1], head.end(), []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _NUMBER.match(data, at)
        if not m or len(m[1]) > 9:
            raise ValueError("a Netpbm header ends early or has a number too long")
        sizes.append(int(m[1]))
        at = m.end()
    width, height = sizes[:2]
    sized(width, height, most)
    if kind == b"P4":
        row = (width + 7) // 8
        bits = np.unpackbits(taken(data, row * height, at + 1).reshape(height, row), axis=1)[:, :width]
        return ((1 - bits) * 255).astype(np.uint8)[..., None]
    if kind == b"P1":
        digits = re.sub(rb"#[^\n\r]*|[\x20\x09-\x0D]", b"", data[at:])
        bits = taken(digits, width * height, 0).reshape(height, width) - np.uint8(48)
        if (bits > 1).any():
            raise ValueError("a bitmap's samples are 0 or 1")
        return ((1 - bits) * 255).astype(np.uint8)[..., None]
    if not 0 < sizes[2] < 256:
        raise ValueError("only 8-bit samples are read")
    size = width * height * (3 if kind in (b"P3", b"P6") else 1)
    if kind in (b"P2", b"P3"):
        words = data[at:].split(None, size)[:size]
        if len(words) < size or max(map(len, words)) > 9:
            raise ValueError("an image's samples end early or are too long")
        flat = np.array(words, dtype=np.int64)
    else:
        flat = taken(data, size, at + 1)
    if flat.min() < 0 or flat.max() > sizes[2]:
        raise ValueError("a sample is above the maximum")
    return flat.astype(np.uint8).reshape(height, width, -1)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed 8-bit (with its palette), 24-bit and 32-bit bitmaps, these with channel masks of whole bytes too, as
    (height, width, channels) in RGB order."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    number = lambda at, n, signed=False: int.from_bytes(data[at : at + n], "little", signed=signed)
    start, header, width, height, bits, packed = number(10, 4), number(14, 4), number(18, 4, True), number(22, 4, True), number(28, 2), number(30, 4)
    if header < 40 or packed not in (0, 3) or bits not in (8, 24, 32) or (packed == 3 and bits != 32):
        raise ValueError("this kind of BMP is not read")
    sized(width, abs(height), MOST_PIXELS)
    row = (width * bits // 8 + 3) // 4 * 4
    rows = taken(data, row * abs(height), start).reshape(abs(height), row)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    if bits == 8:
        palette = taken(data, 4 * (number(46, 4) or 256), 14 + header).reshape(-1, 4)
        return palette[rows][..., 2::-1]
    channels = [2, 1, 0]
    if packed == 3:
        places = {0xFF << (8 * k): k for k in range(4)}
        masks = [number(54 + 4 * k, 4) for k in range(3)]
        if len(data) < 66 or any(m not in places for m in masks):
            raise ValueError("channel masks of whole bytes only are read")
        channels = [places[m] for m in masks]
    return rows.reshape(abs(height), width, bits // 8)[..., channels]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def encode_pgm(rows: np.ndarray) -> bytes:
    return b"P5\n%d %d\n255\n" % (rows.shape[1], rows.shape[0]) + rows.tobytes()


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean over each target cell's area by an integral image, cells cut at fractional pixels. Only the integral's rows at
    cell borders are kept, so memory follows the width and not the whole image."""
    h, w = image.shape[:2]
    image = image.reshape(h, w, -1)
    edges = np.arange(height + 1) * h / height
    rows = np.zeros((height + 1, w, image.shape[2]))
    total, done, low = np.zeros(rows.shape[1:]), 0, np.floor(edges).astype(int)
    for k, y in enumerate(low):
        for at in range(done, y, TILE_ROWS):
            total = total + image[at : min(y, at + TILE_ROWS)].sum(axis=0, dtype=np.int64)
        done = y
        rows[k] = total + (edges[k] - y) * image[y] if y < h else total
    integral = np.concatenate([np.zeros((height + 1, 1, image.shape[2])), rows.cumsum(axis=1)], axis=1)
    cuts = np.arange(width + 1) * w / width
    left = np.minimum(np.floor(cuts).astype(int), w - 1)
    at = integral[:, left] + (cuts - left)[None, :, None] * (integral[:, left + 1] - integral[:, left])
    cells = np.diff(np.diff(at, axis=0), axis=1)
    return cells / (h / height * w / width)


def difference_hash(image: np.ndarray) -> str:
    """64 bits as hex: whether each of 8 x 8 cells is darker than its right neighbour."""
    grey = np.rint(resize(image, 8, 9).mean(axis=2) * 256)
    return np.packbits(grey[:, :-1] < grey[:, 1:]).tobytes().hex()


def npy_tiles(image: np.ndarray, rows: int = TILE_ROWS) -> bytes:
    """The image as one NPY array after another, each of at most ``rows`` rows."""
    out = io.BytesIO()
    for at in range(0, max(len(image), 1), rows):
        np.lib.format.write_array(out, np.ascontiguousarray(image[at : at + rows]), allow_pickle=False)
    return out.getvalue()


def read_tiles(data: bytes) -> Iterator[np.ndarray]:
    source = io.BytesIO(data)
    while source.tell() < len(data):
        yield np.lib.format.read_array(source, allow_pickle=False)


def media(images: DataFrame, key: str, image: str, height: int = 32, width: int = 32) -> DataFrame:
    """(key, height, width, channels, tiles, thumbnail, feature) of each image; nulls where it can't be decoded."""

    def one(data: bytes) -> tuple:
        try:
            array = decode(data)
            small = np.rint(resize(array, height, width)).astype(np.uint8)
            return (*array.shape, npy_tiles(array), npy_tiles(small), difference_hash(array))
        except (ValueError, IndexError):  # what decoding raises for damaged, unknown and oversized images
            return (None,) * 6

    names = [("height", pa.int64()), ("width", pa.int64()), ("channels", pa.int64()), ("tiles", pa.binary()), ("thumbnail", pa.binary()), ("feature", pa.string())]
    source = images.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(image), F.lit(b"").cast("binary")).alias("text"))
    found = map_arrow(source, rows_by_text(one, names), "doc_id long, height long, width long, channels long, tiles binary, thumbnail binary, feature string")
    return found.withColumnRenamed("doc_id", key)


def text_image(data: bytes) -> bytes:
    """A greymap 64 samples wide that holds the text, padded by zero bytes."""
    size = max(-(-len(data) // WIDTH), 1) * WIDTH
    return encode_pgm(np.frombuffer(data.ljust(size, b"\0"), np.uint8).reshape(-1, WIDTH))


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, tiles): each whole text through a greymap into NPY tiles."""

    def one(data: bytes) -> tuple:
        return len(data), npy_tiles(decode_netpbm(text_image(data), None)[..., 0])

    return map_arrow(texts(docs), rows_by_text(one, [("n_bytes", pa.int64()), ("tiles", pa.binary())]), "doc_id long, n_bytes long, tiles binary")


def digests(stored: DataFrame) -> DataFrame:
    """What the stored tiles hold, read back from their bytes."""

    def run(batch: pa.RecordBatch):
        found = []
        for n, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            image = np.concatenate(list(read_tiles(data)))
            payload = image.tobytes()
            found.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image)))
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True))], ["doc_id", *names])

    return map_arrow(stored, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
