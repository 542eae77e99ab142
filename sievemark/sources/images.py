"""Image scan: decoding, digests and perceptual hashes of a folder of images, in Arrow batches.

Portable gray and colour maps (P5, P6) are decoded here; other formats by an image library where one is
installed. Without it they come out as errors. Files of no bytes are left out by Spark's folder reader.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

try:
    from PIL import Image, ImageFile, ImageOps
except ImportError:  # optional
    Image = None

SCHEMA = (
    "path string, size_bytes bigint, file_md5 string, decode_status string, error string, mode string, exif_orientation int, raw_width int, raw_height int, "
    "width int, height int, pixel_md5 string, phash string, dhash string"
)
_HEADER = re.compile(rb"\s*P([56])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")
# ITU-R 601 weights of red, green and blue.
LUMA = np.array([299, 587, 114]) / 1000


def _netpbm(data: bytes) -> tuple[np.ndarray, str, str, int] | None:
    """(gray pixels, mode, status, orientation); a file that ends early is filled with black."""
    head = _HEADER.match(data)
    if head is None:
        return None
    colours, width, height, peak = 3 if head[1] == b"6" else 1, int(head[2]), int(head[3]), int(head[4])
    if not width or not height or not 0 < peak < 256:
        raise ValueError("unsupported header")
    raw = np.frombuffer(data, np.uint8, offset=head.end())
    full = np.zeros(width * height * colours, np.uint8)
    full[: min(len(raw), len(full))] = raw[: len(full)]
    pixels = full.reshape(height, width, colours)
    gray = pixels[:, :, 0] if colours == 1 else np.floor(pixels @ LUMA + 0.5).astype(np.uint8)
    return gray, "RGB" if colours == 3 else "L", "strict" if len(raw) >= len(full) else "truncated_recovered", 0


def _with_library(data: bytes) -> tuple[np.ndarray, str, str, int]:
    if Image is None:
        raise ValueError("no decoder for this format")
    for recover in (False, True):
        ImageFile.LOAD_TRUNCATED_IMAGES = recover  # a switch of the worker process, so set for each attempt
        try:
            with Image.open(io.BytesIO(data)) as image:
                orientation = int(image.getexif().get(274, 0))
                return np.asarray(ImageOps.exif_transpose(image).convert("L")), image.mode, "truncated_recovered" if recover else "strict", orientation
        except OSError:
            if recover:
                raise
    raise AssertionError


def _weights(size: int, to: int) -> np.ndarray:
    """(to, size): Lanczos weights with three lobes, widened where the image shrinks; rows sum to one."""
    scale = max(size / to, 1.0)
    distance = (np.arange(size)[None, :] + 0.5 - (np.arange(to)[:, None] + 0.5) * size / to) / scale
    w = np.where(np.abs(distance) < 3, np.sinc(distance) * np.sinc(distance / 3), 0.0)
    return w / w.sum(axis=1, keepdims=True)


def resized(gray: np.ndarray, width: int, height: int) -> np.ndarray:
    """Resampled gray levels, rounded to whole ones."""
    return np.clip(np.rint(_weights(gray.shape[0], height) @ gray.astype(float) @ _weights(gray.shape[1], width).T), 0, 255)


def dct_basis(n: int) -> np.ndarray:
    """The orthonormal DCT-II basis, one frequency a row."""
    k, i = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(math.pi * (2 * i + 1) * k / (2 * n)) * np.where(k == 0, math.sqrt(1 / n), math.sqrt(2 / n))


def perceptual_bits(pixels: np.ndarray) -> np.ndarray:
    """(n, 64) bits of n square images: low 8 x 8 frequencies above the median of the 63 after the first."""
    basis = dct_basis(pixels.shape[-1])[:8]
    low = (basis @ pixels @ basis.T).reshape(len(pixels), 64)
    return low > np.median(low[:, 1:], axis=1)[:, None]


def hex_bits(bits: np.ndarray) -> list[str]:
    """Rows of 64 bits, first one highest, as hexadecimal digits."""
    return [row.tobytes().hex() for row in np.packbits(bits, axis=1)]


def _record(path: str, data: bytes) -> tuple:
    head = (path, len(data), hashlib.md5(data).hexdigest())
    try:
        gray, mode, status, orientation = _netpbm(data) or _with_library(data)
    except Exception as fault:  # the third output: a row that says why
        return (*head, "error", f"{type(fault).__name__}: {fault}", None, None, None, None, None, None, None, None, None)
    height, width = gray.shape
    turned = orientation in (5, 6, 7, 8)
    phash = hex_bits(perceptual_bits(resized(gray, 32, 32)[None]))[0]
    small = resized(gray, 9, 8)
    dhash = hex_bits((small[:, 1:] > small[:, :-1]).reshape(1, 64))[0]
    raw = (height, width) if turned else (width, height)
    return (*head, status, None, mode, orientation, *raw, width, height, hashlib.md5(gray.tobytes()).hexdigest(), phash, dhash)


def scan_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """One row per file: good ones, recovered ones and errors, told apart by decode_status (strict, truncated_recovered, error).

    Files are read as binary rows and decoded in Arrow batches of few rows, so a task holds a few images.
    pixel_md5 is over the upright gray image's bytes.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "content")
    return files.transform(decoded_images)


def decoded_images(files: DataFrame) -> DataFrame:
    """``files`` (path, content) as ``scan_images`` returns them; null content is an error."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for start in range(0, part.num_rows, 16):
                piece = part.slice(start, 16)
                rows = [_record(p.as_py(), c.as_py() or b"") for p, c in zip(piece.column(0), piece.column(1), strict=True)]
                kinds = [pa.string(), pa.int64(), *[pa.string()] * 4, *[pa.int32()] * 5, *[pa.string()] * 3]
                names = [f.split()[0] for f in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.select("path", "content").mapInArrow(batches, SCHEMA)


def frequency_hashes(blocks: DataFrame, key: str, column: str) -> DataFrame:
    """(key, phash): perceptual hash of square images given as arrays of gray levels, row by row; null or uneven arrays give null."""
    kind = blocks.schema[key].dataType

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = part.column(1)
            sizes = [len(x) if x.is_valid else 0 for x in lists]
            out: list[str | None] = [None] * len(sizes)
            for size in {s for s in sizes if s >= 64 and math.isqrt(s) ** 2 == s}:
                at = [i for i, s in enumerate(sizes) if s == size]
                flat = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)
                for i, text in zip(at, hex_bits(perceptual_bits(flat.reshape(len(at), math.isqrt(size), -1))), strict=True):
                    out[i] = text
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=[key, "phash"])

    return blocks.select(key, column).mapInArrow(batches, f"`{key}` {kind.simpleString()}, phash string")
