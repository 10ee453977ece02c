"""Image catalogue: files identified by content, never decoded.

The listing is ``binaryFile`` rows. The walk over PNG chunks and JPEG segments has no bound but the file itself,
which column expressions cannot loop over, so one small vectorised function reads the headers of a batch of
files; a corrupt file becomes a code instead of an error.
"""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File signatures, the colour modes of PNG colour types, and the decoder's pixel limit.
PNG_SIGNATURE = "89504E470D0A1A0A"
OTHER_SIGNATURES = ("47494638", "424D", "52494646", "49492A00", "4D4D002A", "00000100")
PNG_MODES = {0: "L", 2: "RGB", 3: "P", 4: "LA", 6: "RGBA"}
JPEG_MODES = {1: "L", 3: "RGB", 4: "CMYK"}
MAX_PIXELS = 89_478_485

HEADER = "width long, height long, mode string, whole boolean, animated boolean"
BROKEN = (None, None, None, False, False)


ORIENTATION = 0x0112  # fixed value: the directory entry that says how an image is turned
TURNED = (5, 6, 7, 8)  # fixed values: orientations that swap width and height
SIZES = {1: 1, 3: 2, 4: 4}  # fixed values: entry types of whole numbers and their bytes


def orientation(tiff: bytes) -> int:
    """Orientation 1 to 8 from the first directory of TIFF bytes in either byte order; 1 if it says nothing.

    A directory that ends too early counts as far as it goes; entries of other types, with several
    values or out of range say nothing.
    """
    order = {b"II*\0": "little", b"MM\0*": "big"}.get(tiff[:4])
    found = 1
    if order is None or len(tiff) < 8:
        return found
    at = int.from_bytes(tiff[4:8], order)
    for k in range(int.from_bytes(tiff[at:at + 2], order)):
        entry = tiff[at + 2 + 12 * k:at + 14 + 12 * k]
        if len(entry) < 12:
            break
        tag, kind, n = (int.from_bytes(entry[a:b], order) for a, b in ((0, 2), (2, 4), (4, 8)))
        if tag == ORIENTATION and kind in SIZES and n == 1:
            value = int.from_bytes(entry[8:8 + SIZES[kind]], order)
            found = value if 1 <= value <= 8 else 1
    return found


def turned(width: int, height: int, turn: int) -> tuple[int, int]:
    """Size of the upright image."""
    return (height, width) if turn in TURNED else (width, height)


def png_header(data: bytes) -> tuple:
    """Upright size, mode, whether all chunks up to the end chunk are sound, and whether frames are announced.

    Only an ``acTL`` chunk before the pixels announces frames; bytes behind the end chunk do not matter.
    """
    at, size, pixels, animated, turn = 8, None, False, False, 1
    while at + 12 <= len(data):
        length, kind = int.from_bytes(data[at:at + 4], "big"), data[at + 4:at + 8]
        body = data[at + 8:at + 8 + length]
        check = data[at + 8 + length:at + 12 + length]
        if len(check) < 4 or zlib.crc32(kind + body) != int.from_bytes(check, "big"):
            break
        if size is None:
            if kind != b"IHDR" or length != 13:
                return BROKEN
            depth, colour = body[8], body[9]
            mode = "I;16" if (depth, colour) == (16, 0) else "1" if (depth, colour) == (1, 0) else PNG_MODES.get(colour)
            size = (int.from_bytes(body[:4], "big"), int.from_bytes(body[4:8], "big"), mode)
        elif kind == b"acTL" and not pixels and length >= 4:
            animated = 1 < int.from_bytes(body[:4], "big") <= 1 << 31
        elif kind == b"IDAT":
            pixels = True
        elif kind == b"eXIf":
            turn = orientation(body)
        elif kind == b"IEND":
            return (*turned(*size[:2], turn), size[2], pixels and min(size[:2]) > 0, animated)
        at += 12 + length
    return (*turned(*size[:2], turn), size[2], False, animated) if size else BROKEN


def jpeg_header(data: bytes) -> tuple:
    """Upright size and mode of the first frame header, behind any number of segments."""
    at, turn = 2, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:  # a fill byte
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:  # markers without a segment
            at += 2
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            depth = data[at + 4:at + 5]
            if len(data) < at + 10 or depth != b"\x08":
                return BROKEN
            height, width = (int.from_bytes(data[i:i + 2], "big") for i in (at + 5, at + 7))
            whole = min(height, width) > 0 and data.find(b"\xff\xd9", at + 10) >= 0
            return (*turned(width, height, turn or 1), JPEG_MODES.get(data[at + 9]), whole, False)
        else:
            length = int.from_bytes(data[at + 2:at + 4], "big")
            if length < 2:
                break
            if marker == 0xE1 and turn is None and data[at + 4:at + 10] == b"Exif\0\0":
                turn = orientation(data[at + 10:at + 2 + length])
            at += 2 + length
    return BROKEN


def read_headers(content: pd.Series) -> pd.DataFrame:
    rows = []
    for data in content:
        data = b"" if data is None else bytes(data)
        png = data.startswith(bytes.fromhex(PNG_SIGNATURE))
        rows.append(png_header(data) if png else jpeg_header(data) if data.startswith(b"\xff\xd8\xff") else BROKEN)
    out = pd.DataFrame(rows, columns=["width", "height", "mode", "whole", "animated"])
    return out.astype({"width": "Int64", "height": "Int64"})


def identify(files: DataFrame, content: str = "content", max_pixels: int = MAX_PIXELS) -> DataFrame:
    """Add format, width, height, mode, sha256 and an error code (null when usable).

    Width and height are those of the upright image, turned as its EXIF orientation says.
    """
    c = F.col(content)
    lead = F.hex(F.substring(c, 1, 8))
    kind = (F.when(lead == PNG_SIGNATURE, "PNG").when(lead.startswith("FFD8FF"), "JPEG"))
    other = F.lit(False)
    for signature in OTHER_SIGNATURES:
        other = other | lead.startswith(signature)
    headers = F.pandas_udf(read_headers, HEADER)
    rows = files.withColumn("format", F.coalesce(kind, F.when(other, "OTHER"))).withColumn("_h", headers(c))
    code = (F.when(c.isNull(), "INPUT_READ_ERROR").when(F.length(c) == 0, "INVALID_IMAGE")
            .when(F.col("format").isNull(), "INVALID_IMAGE").when(F.col("format") == "OTHER", "UNSUPPORTED_IMAGE")
            .when(~F.col("_h.whole"), "INVALID_IMAGE").when(F.col("_h.animated"), "UNSUPPORTED_IMAGE")
            .when(F.col("_h.width") * F.col("_h.height") > max_pixels, "UNSUPPORTED_IMAGE")
            .when(F.col("_h.mode").isNull() | (F.col("_h.mode") == "I;16"), "UNSUPPORTED_IMAGE"))
    return rows.select(*[x for x in files.columns if x != content], "format", F.col("_h.width").alias("width"),
                       F.col("_h.height").alias("height"), F.col("_h.mode").alias("mode"),
                       F.sha2(content, 256).alias("sha256"), code.alias("error_code"))


def image_catalog(spark: SparkSession, path: str, pattern: str = "*", wanted: DataFrame | None = None) -> DataFrame:
    """Catalogue a folder; ``wanted`` (``path``, ``length``) also reports unreadable files.

    Spark's file sources skip zero-length files, so emptiness is known from the listing:
    a wanted path of length 0 is an invalid image, any other one without content could
    not be read.
    """
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", "true").load(path).select("path", "content"))
    if wanted is not None:
        files = wanted.select("path", "length").join(files, "path", "left").select(
            "path", F.when(F.col("length") == 0, F.unhex(F.lit(""))).otherwise(F.col("content")).alias("content"))
    return identify(files)
