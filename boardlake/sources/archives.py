"""Cell archives: one compressed file of pixel and label arrays for each board.

Files come as ``binaryFile`` rows, so any store that Spark reads will do, and a split that is a partition folder is pruned
before a file is opened. Shapes and types are checked from the array headers before pixels are decoded.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boardlake.functions.constants import CELLS, N_CLASSES

ARRAYS = {"images": "images.npy", "class_ids": "class_ids.npy"}  # fixed values: members of an archive
PIXELS = 1 << 20  # fixed value: decoded pixels that are handed on together, by whole archives
PROBLEMS = ("missing-file", "not-in-index", "changed", "unreadable", "missing-array", "wrong-shape", "wrong-labels")


def header(archive: zipfile.ZipFile, name: str) -> tuple:
    """Shape and type of an array, from its header alone."""
    with archive.open(name) as member:
        version = np.lib.format.read_magic(member)
        read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
        shape, _, dtype = read(member)
        return shape, dtype


def open_archive(content: bytes, side: int, channels: int, labels) -> tuple[str | None, np.ndarray | None]:
    """(problem, None) or (None, images): uint8 cells of side x side x channels with the labels of the index."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            names = set(archive.namelist())
            if not set(ARRAYS.values()) <= names:
                return "missing-array", None
            if header(archive, ARRAYS["images"]) != ((CELLS, side, side, channels), np.dtype(np.uint8)) or header(
                    archive, ARRAYS["class_ids"]) != ((CELLS,), np.dtype(np.uint8)):
                return "wrong-shape", None
            ids, images = (np.lib.format.read_array(io.BytesIO(archive.read(ARRAYS[n])), allow_pickle=False)
                           for n in ("class_ids", "images"))
    except Exception:  # whatever a damaged file makes the decoders say
        return "unreadable", None
    if labels is None or ids.tolist() != list(labels) or ids.max() >= N_CLASSES:
        return "wrong-labels", None
    return None, images


def archive_files(spark: SparkSession, root: str, split: str) -> DataFrame:
    """(path, content) of one split below ``root``; other splits are never opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(root)
    return files.where(F.col("split") == split).select("path", "content")


def _matched(files: DataFrame, index: DataFrame) -> DataFrame:
    """Files and index rows (path, sha256, class_ids) side by side, with the problems that need no decoding."""
    own = index.select("path", "sha256", "class_ids", F.lit(True).alias("_listed"))
    both = files.select("path", "content").join(own, "path", "full")
    problem = (F.when(F.col("content").isNull(), "missing-file").when(F.col("_listed").isNull(), "not-in-index")
               .when(~F.sha2("content", 256).eqNullSafe(F.col("sha256")), "changed"))
    return both.select("path", "content", F.col("class_ids").cast("array<int>").alias("class_ids"), problem.alias("problem"))


def _cells(rows: DataFrame, side: int, channels: int, pixels: bool) -> DataFrame:
    def packed(judged: list) -> pa.RecordBatch:
        """Rows of (path, problem, labels, images): one for each archive, or its 64 cells."""
        paths, problems, idx, classes, places, values, held = [], [], [], [], [], [], 0
        for path, problem, labels, images in judged:
            n = CELLS if images is not None and pixels else 1
            paths += [path] * n
            problems += [problem] * n
            idx += range(CELLS) if n == CELLS else [None]
            classes += labels if n == CELLS else [None]
            if n == CELLS:
                places += range(held, held + images.size, images.size // CELLS)
                values.append(images.reshape(-1).astype(np.int32))
                held += images.size
            else:
                places.append(None)
        px = pa.ListArray.from_arrays(pa.array([*places, held], pa.int32()), np.concatenate(values or [np.zeros(0, np.int32)]))
        return pa.record_batch([pa.array(paths, pa.string()), pa.array(problems, pa.string()), pa.array(idx, pa.int64()),
                                pa.array(classes, pa.int64()), px], names=["path", "problem", "idx", "class_id", "px"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged, held = [], 0
            for k in range(batch.num_rows):  # one archive at a time is decoded
                path, content, labels, problem = (batch.column(c)[k].as_py() for c in range(4))
                images = None
                if problem is None:
                    problem, images = open_archive(content, side, channels, labels)
                judged.append((path, problem, labels, images if pixels else None))
                held += images.size if pixels and images is not None else 0
                if held >= PIXELS:
                    yield packed(judged)
                    judged, held = [], 0
            if judged:
                yield packed(judged)

    return rows.mapInArrow(run, "path string, problem string, idx long, class_id long, px array<int>")


def archive_problems(files: DataFrame, index: DataFrame, side: int, channels: int) -> DataFrame:
    """(path, problem) for every file and index row; null where the archive is sound."""
    return _cells(_matched(files, index), side, channels, False).select("path", "problem")


def read_archives(files: DataFrame, index: DataFrame, side: int, channels: int, selected: DataFrame | None = None) -> DataFrame:
    """(path, idx, class_id, px) rows of sound archives, optionally of the selected (path, idx) only.

    The first archive that is missing, unlisted, changed or broken is an error that names it.
    """
    rows = _cells(_matched(files, index), side, channels, True)
    named = F.when(F.col("problem").isNotNull(), F.raise_error(F.concat(F.col("path"), F.lit(": "), F.col("problem"))).cast("long")
                   ).otherwise(F.col("idx"))
    cells = rows.withColumn("idx", named)
    if selected is not None:
        cells = cells.join(selected.select("path", "idx"), ["path", "idx"], "left_semi")
    return cells.select("path", "idx", "class_id", "px")
