"""Preparation constraints, strict joins and the image scan."""

import hashlib
import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievemark.operators import preparation
from sievemark.operators.validate import ConstraintError
from sievemark.sources import files, images


def gray(pixels, end=None):
    data = b"P5\n# made here\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()
    return data[:end]


def test_scan_has_good_recovered_and_bad_rows(spark, tmp_path):
    rng = np.random.default_rng(3)
    flat, noise = np.full((40, 50), 7, np.uint8), rng.integers(0, 256, (64, 48), dtype=np.uint8)
    colour = np.stack([noise] * 3, axis=-1)
    for name, data in {"a.pgm": gray(noise), "b.pgm": gray(noise, -100), "c.ppm": b"P6 48 64 255\n" + colour.tobytes(), "d.pgm": b"P5 0 4 255\n", "e.bin": b"\x00nothing", "f.pgm": b"P5", "g.pgm": gray(flat)}.items():
        (tmp_path / name).write_bytes(data)
    got = {r.path.rsplit("/", 1)[1]: r for r in images.scan_images(spark, str(tmp_path)).collect()}
    assert {k: r.decode_status for k, r in got.items()} == {"a.pgm": "strict", "b.pgm": "truncated_recovered", "c.ppm": "strict", "d.pgm": "error", "e.bin": "error", "f.pgm": "error", "g.pgm": "strict"}
    a, c = got["a.pgm"], got["c.ppm"]
    assert (a.width, a.height, a.mode, a.pixel_md5) == (48, 64, "L", hashlib.md5(noise.tobytes()).hexdigest()) and a.error is None
    assert c.mode == "RGB" and (c.pixel_md5, c.phash, c.dhash) == (a.pixel_md5, a.phash, a.dhash) and c.file_md5 != a.file_md5
    assert got["b.pgm"].pixel_md5 != a.pixel_md5 and (int(got["b.pgm"].phash, 16) ^ int(a.phash, 16)).bit_count() < 16
    assert got["d.pgm"].error and got["d.pgm"].width is None and got["g.pgm"].dhash == "0" * 16
    assert images.decoded_images(spark.createDataFrame([("x", None)], "path string, content binary")).first().decode_status == "error"  # as is a file without a byte, which the folder reader leaves out


def test_perceptual_hash_by_definition(spark):
    rng = np.random.default_rng(4)
    basis = images.dct_basis(32)
    assert np.allclose(basis @ basis.T, np.eye(32))
    block = rng.random((32, 32))
    low = [[sum(basis[k, i] * basis[m, j] * block[i, j] for i in range(32) for j in range(32)) for m in range(8)] for k in range(8)]
    values = [v for row in low for v in row]
    want = "".join("1" if v > sorted(values[1:])[31] else "0" for v in values)
    rows = spark.createDataFrame([("a", block.ravel().tolist()), ("b", None), ("c", [1.0] * 65)], "k string, v array<double>")
    got = {r.k: r.phash for r in images.frequency_hashes(rows, "k", "v").collect()}
    assert got == {"a": f"{int(want, 2):016x}", "b": None, "c": None}
    half = images.resized(np.repeat(np.repeat(np.arange(16).reshape(4, 4), 8, 0), 8, 1), 4, 4)
    assert half.shape == (4, 4) and math.isclose(half.mean(), 7.5, abs_tol=0.6)


def test_annotation_faults(spark):
    square, out = [0.0, 0.0, 4.0, 0.0, 4.0, 4.0], [0.0, 0.0, 40.0, 0.0, 4.0, 4.0]
    image = spark.createDataFrame([(1, "a", 10, 10), (2, "b", 10, 10), (3, "gone", 10, 10), (4, "c", 9, 10)], "id bigint, file_name string, width int, height int")
    notes = [(1, 1, [0.0, 0.0, 4.0, 4.0], [square]), (2, 1, [0.0, 0.0, 0.0, 4.0], [square, out, [1.0, 2.0]]), (3, 9, [0.0, 0.0, 1.0, 1.0], []), (4, 2, None, None), (5, 4, [1.0, 1.0, 2.0, 2.0], [[*square, 1.0]])]
    notes = spark.createDataFrame(notes, "id bigint, image_id bigint, bbox array<double>, segmentation array<array<double>>")
    records = spark.createDataFrame([("a", 10, 10, 1), ("b", 10, 10, 0), ("c", 10, 10, 1), ("d", 5, 5, 1)], "image_id string, width int, height int, fractured int")
    got = sorted(map(tuple, preparation.annotation_faults(image, notes, records).collect()))
    assert got == sorted([
        ("image_unknown", "gone", 1), ("size_mismatch", "c", 1), ("annotation_without_image", "3", 1), ("invalid_bbox", "2", 1), ("invalid_bbox", "4", 1), ("invalid_segmentation", "2", 2),
        ("invalid_segmentation", "4", 1), ("invalid_segmentation", "5", 1), ("image_without_annotation", "gone", 1), ("positive_missing", "d", 1), ("image_not_positive", "b", 1), ("image_not_positive", "gone", 1),
    ])
    assert preparation.annotation_faults(image.limit(0), notes.limit(0), records.limit(0)).count() == 0


def test_strict_forms_raise(spark, ws):
    lines = spark.createDataFrame([("a", "0 0.5 0.5 0.1 0.1"), ("a", "0 0.5 0.5 0.1 0.2"), ("b", "0 0.1 0.1 0.1 0.1")], "stem string, line string")
    assert {r.stem: r.lines for r in preparation.strict_labels(lines).collect()} == {"a": 2, "b": 1}
    for bad in (("c", "0 0.5"), ("c", "1 0.5 0.5 0.1 0.1"), ("c", None)):
        with pytest.raises(ConstraintError):
            preparation.strict_labels(lines.union(spark.createDataFrame([bad], lines.schema)))
    a, b = spark.createDataFrame([("x", 1), ("y", 2)], "k string, u int"), spark.createDataFrame([("y", 3), ("x", 4)], "k string, v int")
    assert {tuple(r) for r in preparation.strict_one_to_one(a, b, "k").collect()} == {("x", 1, 4), ("y", 2, 3)}
    for left, right in ((a, b.limit(1)), (a.union(a), b), (a, b.union(spark.createDataFrame([(None, 1)], b.schema)))):
        with pytest.raises(ConstraintError):
            preparation.strict_one_to_one(left, right, "k")
    assert preparation.strict_lookup(a.union(a), b, "k").count() == 4
    for rows in (spark.createDataFrame([("z", 1)], a.schema), spark.createDataFrame([(None, 1)], a.schema)):
        with pytest.raises(ConstraintError):
            preparation.strict_lookup(rows, b, "k")
    zipped = preparation.strict_zip(a.select("u"), b.select("v"), ws, [F.col("u")], [F.col("v")])
    assert {tuple(r) for r in zipped.collect()} == {(1, 3), (2, 4)}
    with pytest.raises(ConstraintError):
        preparation.strict_zip(a.select("u"), b.select("v").limit(1), ws, [F.col("u")], [F.col("v")])


def test_prepared_sets_and_batches(spark):
    manifest = spark.createDataFrame([("a.x.jpg", "train", 1, "strict"), ("b.jpg", "train", 0, "truncated_recovered"), ("b.jpg", "val", 0, "strict"), ("c.jpg", None, 1, "strict")], "image_id string, split string, fractured int, decode_status string")
    labels = spark.createDataFrame([("a.x.jpg", 2), ("b.jpg", 1), ("b.jpg", None)], "image_id string, lines bigint")
    got = sorted(map(tuple, preparation.preparation_faults(manifest, labels, {"train": 2, "val": 5, "test": 0}).collect()))
    assert got == [("negative_with_label", "b.jpg"), ("negative_with_label", "b.jpg"), ("positive_without_label", "c.jpg"), ("repeated_image", "b.jpg"), ("split_size", "val"), ("unknown_split", "c.jpg")]
    with pytest.raises(ConstraintError):
        preparation.strict_preparation(manifest, labels, {"train": 2})
    good = manifest.limit(1)
    assert preparation.strict_preparation(good, labels, {"train": 1}).count() == 1
    first = preparation.materialised(good).first()
    assert (first.image_path, first.label_path, first.action, first.label_action) == ("images/train/a.x.jpg", "labels/train/a.x.txt", "link", "link")
    rows = [("a", 1, 4, 4, 3, 1, 1, 4, 4), ("b", 1, 4, 4, 1, 1, 1, 4, 4), ("c", 1, 4, 4, 3, 2, 1, 4, 4), ("d", 1, 4, 4, 3, 1, 1, 4, 5), ("e", 0, 4, 4, 3, 1, 1, 4, 4), ("f", 1, 4, 4, 3, None, None, None, None), ("g", 0, 4, 4, 3, 0, 0, None, None), ("h", None, 4, 4, None, 0, 0, None, None)]
    samples = spark.createDataFrame(rows, "image_id string, fractured int, width int, height int, channels int, boxes int, masks int, mask_width int, mask_height int")
    assert {r.image_id: r.fault for r in preparation.batch_faults(samples).collect()} == {"b": "channels", "c": "box_mask_count", "d": "mask_size", "e": "negative_with_box", "f": "positive_without_box", "h": "channels"}


def test_configuration_and_provenance(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"iou": 0.5, "names": ["a"]}))
    config = files.read_config(spark, str(tmp_path / "c.json"))
    assert config == {"iou": 0.5, "names": ["a"]}
    (tmp_path / "d.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.read_config(spark, str(tmp_path / "d.json"))
    row = files.provenance(spark, config, "abc").first()
    assert json.loads(row.config) == config and json.loads(row.versions)["spark"] == spark.version and row.code == "abc" and row.created_at.endswith("Z")
