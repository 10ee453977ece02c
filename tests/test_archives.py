"""Written archives read back; every kind of broken one is named."""

import hashlib
import io

import numpy as np
import pytest
from conftest import values

from boardlake.sources import archives as A

SIDE = 4


def archive(images, labels, **more):
    out = io.BytesIO()
    np.savez_compressed(out, images=images, class_ids=labels, **more)
    return out.getvalue()


def board(seed):
    rng = np.random.default_rng(seed)
    return rng.integers(0, 256, (64, SIDE, SIDE, 3), np.uint8), rng.integers(0, 13, 64).astype(np.uint8)


def index_of(spark, rows):
    return spark.createDataFrame(rows, "path string, sha256 string, class_ids array<int>")


def test_archives_read_back(spark, tmp_path):
    boards, rows = {}, []
    for k in range(6):
        split = "training" if k < 4 else "validation"
        path = tmp_path / f"split={split}" / f"b{k}.npz"
        path.parent.mkdir(exist_ok=True)
        images, labels = board(k)
        data = archive(images, labels)
        path.write_bytes(data if split == "training" else b"never opened")
        boards[f"file:{path}"] = (images, labels)
        if split == "training":
            rows.append((f"file:{path}", hashlib.sha256(data).hexdigest(), labels.tolist()))
    files = A.archive_files(spark, str(tmp_path), "training")
    assert "PartitionFilters: [isnotnull(split" in files._jdf.queryExecution().executedPlan().toString()
    got = A.read_archives(files, index_of(spark, rows), SIDE, 3).collect()
    assert len(got) == 4 * 64
    for r in got:
        images, labels = boards[r.path]
        assert r.class_id == labels[r.idx] and r.px == images[r.idx].ravel().tolist()
    chosen = spark.createDataFrame([(rows[0][0], 5), (rows[2][0], 63)], "path string, idx long")
    some = A.read_archives(files, index_of(spark, rows), SIDE, 3, chosen)
    assert values(some, "path", "idx") == sorted([(rows[0][0], 5), (rows[2][0], 63)])


def test_broken_archives_are_named(spark):
    images, labels = board(1)
    good = archive(images, labels)
    bad = {
        "good": good, "cut": good[: len(good) // 2], "text": b"hello", "empty": b"", "extra": archive(images, labels, more=labels),
        "float": archive(images.astype(float), labels), "small": archive(images[:63], labels), "flat": archive(images[..., 0], labels),
        "long-labels": archive(images, labels.astype(np.int64)), "other-labels": archive(images, (labels + 1) % 13),
        "class-13": archive(images, np.full(64, 13, np.uint8)), "pickled": archive(images, np.array([None] * 64, object)),
        "no-labels": (lambda o: (np.savez(o, images=images), o.getvalue())[1])(io.BytesIO()),
    }
    files = [(n, bytearray(d)) for n, d in bad.items()] + [("changed", bytearray(good)), ("stray", bytearray(good))]
    listed = [(n, hashlib.sha256(d).hexdigest(), [13] * 64 if n == "class-13" else labels.tolist()) for n, d in bad.items()]
    listed += [("changed", "0" * 64, labels.tolist()), ("gone", "0" * 64, labels.tolist())]
    df = spark.createDataFrame(files, "path string, content binary")
    got = dict(values(A.archive_problems(df, index_of(spark, listed), SIDE, 3)))
    assert got == {"good": None, "extra": None, "cut": "unreadable", "text": "unreadable", "empty": "unreadable",
                   "float": "wrong-shape", "small": "wrong-shape", "flat": "wrong-shape", "long-labels": "wrong-shape",
                   "other-labels": "wrong-labels", "class-13": "wrong-labels", "pickled": "wrong-shape", "no-labels": "missing-array",
                   "changed": "changed", "stray": "not-in-index", "gone": "missing-file"}
    assert set(got.values()) - {None} == set(A.PROBLEMS)
    with pytest.raises(Exception, match="float: wrong-shape"):
        A.read_archives(df.where("path = 'float'"), index_of(spark, [r for r in listed if r[0] == "float"]), SIDE, 3).collect()
    assert A.read_archives(df.where("path = 'good'"), index_of(spark, listed[:1]), SIDE, 3).count() == 64
