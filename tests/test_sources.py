"""Formats and sinks."""

import json

import pytest
from pyspark.sql import functions as F

from sievemark.sources import files
from sievemark.streaming.confusion import windowed_confusion


def test_csv_with_mark_and_nested_sink(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿image_id,n\nx.jpg,1\n".encode())
    rows = files.read_csv(spark, str(tmp_path / "a.csv"))
    assert rows.dtypes == [("image_id", "string"), ("n", "string")]
    wide = files.key_union([rows, rows.select("image_id", F.array("n").alias("list"))])
    files.write_csv(wide, str(tmp_path / "out"))
    assert files.read_csv(spark, str(tmp_path / "out")).where("list is not null").first()["list"] == '["1"]'
    with pytest.raises(Exception):
        files.write_csv(wide, str(tmp_path / "out"))


def test_split_scan_reaches_the_reader(spark, tmp_path):
    frame = spark.createDataFrame([("a", "train"), ("b", "val")], "image_id string, split string")
    files.write_manifest(frame, str(tmp_path / "m"))
    back = spark.read.parquet(str(tmp_path / "m"))
    assert [r.image_id for r in files.read_split(back, "val").collect()] == ["b"]
    with pytest.raises(ValueError):
        files.read_split(back, "none")


def test_coco_yolo_voc(spark, tmp_path):
    (tmp_path / "coco.json").write_text(json.dumps({"images": [{"id": 1, "file_name": "a.jpg", "width": 4, "height": 3}], "annotations": [{"id": 7, "image_id": 1, "bbox": [0, 1, 2, 2], "segmentation": [[0, 0, 1, 1, 1, 0]]}]}))
    images, annotations = files.read_coco(spark, str(tmp_path / "coco.json"))
    assert images.first().file_name == "a.jpg" and list(annotations.first().bbox) == [0, 1, 2, 2]
    (tmp_path / "labels").mkdir()
    (tmp_path / "labels/a.txt").write_text("0 0.5 0.5 1 1\n\n0 0.1 0.1 0.1 0.1\n")
    lines = files.read_yolo(spark, str(tmp_path / "labels")).orderBy("line_number").collect()
    assert [(r.stem, r.line_number) for r in lines] == [("a", 1), ("a", 2)]
    xml = spark.createDataFrame([("a", "<annotation><size><width>4</width><height>3</height></size><object><name>f</name><bndbox><xmin>1</xmin><ymin>1</ymin><xmax>2</xmax><ymax>2</ymax></bndbox></object></annotation>"), ("b", "<annotation></annotation>")], "k string, x string")
    got = {r.k: r for r in files.parse_voc(xml, "x", "k").collect()}
    assert got["a"].width == 4 and got["a"].objects[0].x2 == 2 and got["b"].width == -1 and got["b"].objects == []


def test_catalogue_digests_and_reports(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d/x.bin").write_bytes(b"hello")
    assert files.file_catalogue(spark, str(tmp_path / "d"), "*.bin").first().length == 5
    assert files.file_digests(spark, str(tmp_path / "d")).first().md5 == "5d41402abc4b2a76b9719d911017c592"
    text = spark.createDataFrame([("b", "1\r\n"), ("a", "2")], "name string, content string")
    other = spark.createDataFrame([("a", "2"), ("b", "1\n")], "name string, content string")
    assert files.normalised_text_digest(text).first() == files.normalised_text_digest(other).first()
    assert json.loads(files.report_json(text.limit(1))) and "names:" in files.data_yaml("x", {0: "f"})
    assert files.batches(spark.range(10).coalesce(1), 4).groupBy("batch_id").count().count() == 3
    labels = spark.createDataFrame([("train", "a", 2, "second"), ("train", "a", 1, "first")], "split string, stem string, line_number int, line string")
    files.write_labels(labels, str(tmp_path / "labels"))
    assert spark.read.json(str(tmp_path / "labels")).first().text == "first\nsecond"


def test_scan_with_a_transform(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "n bigint, t string")
    got = files.transformed(rows, lambda r: {"n": r["n"] * 2, "size": len(r["t"] or "")}, "n bigint, size int, extra string")
    assert sorted(map(tuple, got.collect())) == [(2, 1, None), (4, 0, None)]
    assert files.transformed(rows.limit(0), dict, "n bigint").count() == 0


def test_stream_counts_like_a_table(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 01:00:00", 1, 0.9), ("2024-01-01 02:00:00", 0, 0.9), ("2024-01-09 00:00:00", 1, 0.1), (None, 1, 0.5)], "t string, label int, probability double").select(F.col("t").cast("timestamp").alias("ts"), "label", "probability")
    rows.write.parquet(str(tmp_path / "in"))
    stream = windowed_confusion(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), 0.5)
    q = stream.writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, windowed_confusion(rows, 0.5).collect()))
