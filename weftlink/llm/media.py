"""Media columns: Netpbm (P1 to P6) and BMP decoded to numpy arrays, resized by area, kept as NPY tiles.

Area resizing reads sums of any rectangle from an integral image. A difference hash compares
neighbours of a 9 x 8 thumbnail.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Workspace, text_of

#: Samples of a row of the image that holds a payload.
WIDTH = 64
_HEADER = re.compile(rb"P([1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+")


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples of a P1 to P6 image: (height, width) or (height, width, 3); uint16 where the maximum is over 255.

    Bitmaps give 0 for ink and 255 for paper. Raises ValueError for what is not such an image.
    """
    found = _HEADER.match(data)
    head = found
    kind = int(data[1:2]) if found else 0
    if not found:
        found = re.match(rb"P([14])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s", data)
        if not found:
            raise ValueError("not a Netpbm image")
        kind = int(found[1])
    width, height, at = int(found[2]), int(found[3]), found.end()
    shape = (height, width, 3) if kind in (3, 6) else (height, width)
    top = 1
    if kind not in (1, 4):
        number = re.compile(rb"(\d+)" + (rb"\s" if kind > 3 else rb"")).match(data, at)
        if not number:
            raise ValueError("a Netpbm image without its maximum")
        top, at = int(number[1]), number.end()
    elif kind == 4 and head:
        at = re.match(rb"P4(?:\s|#[^\n]*\n)+\d+(?:\s|#[^\n]*\n)+\d+\s", data).end()
    n = int(np.prod(shape))
    if kind == 4:
        line = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, line * height, at).reshape(height, line), axis=1)[:, :width]
        return np.where(bits == 1, 0, 255).astype(np.uint8)
    if kind == 1:
        digits = np.frombuffer(re.sub(rb"[^01]", b"", data[at:])[:n], np.uint8) - 48
        if len(digits) < n:
            raise ValueError("a Netpbm image that ends early")
        return np.where(digits == 1, 0, 255).astype(np.uint8).reshape(shape)
    kind_of = np.dtype(np.uint8) if top < 256 else np.dtype(">u2")
    if kind in (2, 3):
        numbers = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[:n], dtype=np.int64)
        if len(numbers) < n:
            raise ValueError("a Netpbm image that ends early")
        return numbers.astype(kind_of.newbyteorder("=")).reshape(shape)
    if len(data) - at < n * kind_of.itemsize:
        raise ValueError("a Netpbm image that ends early")
    return np.frombuffer(data, kind_of, n, at).astype(kind_of.newbyteorder("="), copy=False).reshape(shape)


def encode_pgm(samples: np.ndarray) -> bytes:
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + np.ascontiguousarray(samples, dtype=np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """RGB samples (height, width, 3) of an uncompressed BMP with 1, 4, 8, 24 or 32 bits a pixel."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("not a BMP image")
    offset, size, width, height, _, bits, packing = struct.unpack_from("<I", data, 10) + struct.unpack_from("<IiiHHI", data, 14)
    if packing or bits not in (1, 4, 8, 24, 32) or size < 40:
        raise ValueError("a BMP image of a kind that is not read")
    rows, line = abs(height), (width * bits + 31) // 32 * 4
    if len(data) - offset < line * rows:
        raise ValueError("a BMP image that ends early")
    raw = np.frombuffer(data, np.uint8, line * rows, offset).reshape(rows, line)
    if bits >= 24:
        out = raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1]
    else:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            index = raw[:, :width]
        elif bits == 4:
            index = np.stack([raw >> 4, raw & 15], axis=2).reshape(rows, -1)[:, :width]
        else:
            index = np.unpackbits(raw, axis=1)[:, :width]
        out = palette[index]
    return np.ascontiguousarray(out[::-1] if height > 0 else out)


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(image: np.ndarray, height: int, width: int, band: int = 1 << 20) -> np.ndarray:
    """Mean of the area that each target pixel covers, in doubles; fractions of source pixels count in part.

    The integral image is read at fractional corners by linear interpolation, which is exact for it. It is made in bands of
    about ``band`` samples, of which only the rows at corners are kept, so memory beyond the image is bounded.
    """
    rows, columns = image.shape[:2]

    def corners(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        at = np.arange(n + 1) * (size / n)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    low, part = corners(height, rows)
    needed = np.unique(np.concatenate([low, low + 1]))
    kept = np.zeros((len(needed), columns + 1, *image.shape[2:]))
    above, step = np.zeros((columns, *image.shape[2:])), max(1, band // max(columns, 1))
    for top in range(0, rows, step):
        sums = np.cumsum(image[top : top + step], axis=0, dtype=np.float64)
        sums += above
        above = sums[-1].copy()
        first, last = np.searchsorted(needed, [top + 1, top + len(sums) + 1])  # row r of the integral ends before row r of the image
        kept[first:last, 1:] = np.cumsum(sums[needed[first:last] - top - 1], axis=1)
    shape = (-1, *[1] * (kept.ndim - 1))
    upper = kept[np.searchsorted(needed, low)] * (1 - part).reshape(shape) + kept[np.searchsorted(needed, low + 1)] * part.reshape(shape)
    low, part = corners(width, columns)
    part = part.reshape(1, -1, *[1] * (kept.ndim - 2))
    table = upper[:, low] * (1 - part) + upper[:, low + 1] * part
    total = table[1:, 1:] - table[:-1, 1:] - table[1:, :-1] + table[:-1, :-1]
    return total / (rows / height * columns / width)


def difference_hash(image: np.ndarray) -> str:
    """16 hexadecimal digits: bit set where a pixel of the 9 x 8 thumbnail is darker than its right neighbour."""
    small = area_resize(image, 8, 9)
    if image.ndim == 3:  # grey of means is the mean of greys
        small = small[..., :3] @ np.array([0.299, 0.587, 0.114])
    small = np.round(small, 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def to_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def image_tiles(images: DataFrame, column: str = "image", tile: tuple[int, int] | None = (64, 64)) -> DataFrame:
    """``images`` with ``tile`` (NPY bytes), ``dhash`` and ``problem``; ``tile=None`` keeps the decoded samples.

    Null or broken images get a null tile and hash and say why in ``problem``; the row stays. Images of any size are read whole;
    repeated rows are returned as often as they come; an empty table gives no rows. Columns named as results are replaced.
    """
    every, results = images.columns, ["tile", "dhash", "problem"]
    kept = [k for k, n in enumerate(every) if n not in results]
    plain = images.toDF(*[f"c{k}" for k in range(len(every))]).select(*[f"c{k}" for k in kept])
    names, place = plain.columns, kept.index(every.index(column))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tiles, hashes, problems = [], [], []
            for value in batch.column(place):
                try:
                    image = decode_image(value.as_py() or b"")
                    if not image.size:
                        raise ValueError("an image without pixels")
                    sized = image if tile is None else np.clip(np.rint(area_resize(image, *tile)), 0, 65535).astype(image.dtype)
                    row = (to_npy(sized), difference_hash(image), None)
                except (ValueError, IndexError, struct.error) as error:
                    row = (None, None, str(error))
                for held, x in zip((tiles, hashes, problems), row, strict=True):
                    held.append(x)
            old = dict(zip(names, batch.columns, strict=True))
            yield pa.RecordBatch.from_pydict(old | {"tile": pa.array(tiles, pa.binary()), "dhash": pa.array(hashes, pa.string()), "problem": pa.array(problems, pa.string())})

    schema = StructType([*plain.schema.fields]).add("tile", "binary").add("dhash", "string").add("problem", "string")  # plain.schema is held by plain: adding to it would change its columns
    return plain.mapInArrow(made, schema).toDF(*[every[k] for k in kept], *results)


def _padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % 64 or (0 if text else 64))


def _as_images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [x.as_py() for x in batch.column(1)]
        images = [encode_pgm(np.frombuffer(_padded(x), np.uint8).reshape(-1, WIDTH)) for x in texts]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(images, pa.binary())], ["doc_id", "n_bytes", "image"])


def text_images(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_bytes, image``: each whole text (null: empty) in UTF-8, with zero bytes up to a positive
    multiple of 64, as the samples of a binary PGM image 64 pixels wide."""
    plain = docs.select(docs[id_column].alias("doc_id"), F.encode(text_of(docs, text_column), "UTF-8").alias("body"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(_as_images, f"doc_id {kind}, n_bytes long, image binary")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made: list[tuple] = []
        for value in batch.column("tile"):
            media = value.as_py()
            payload = from_npy(media).tobytes()
            made.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest()))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
        columns = [pa.array(x, k) for x, k in zip(zip(*made, strict=True) if made else [()] * 5, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns, batch.column("dhash")], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def text_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """What the stored media of every text say: sizes, checksums and the difference hash.

    Texts become PGM images, are decoded, and their samples written as NPY tiles into a table of the shared
    folder; everything returned but ``n_bytes`` comes from that table read back. Equal texts give equal
    values; null and empty texts are 64 zero bytes; repeated rows are returned as often as they come.
    """
    work = Workspace(docs.sparkSession, "media")
    stored = work.put(image_tiles(text_images(docs, id_column, text_column), tile=None).drop("image"), "tiles", "zstd")
    kind = stored.schema["doc_id"].dataType.simpleString()
    out = stored.select("doc_id", "n_bytes", "tile", "dhash").mapInArrow(
        _features, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )
    out = work.put(out, "features")
    work.clear("features")
    return out
