"""File formats: CSV, COCO JSON, YOLO label text, VOC XML, file catalogues; and sinks."""

from __future__ import annotations

import json
import platform
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


COCO = (
    "images array<struct<id: bigint, file_name: string, width: int, height: int>>, "
    "annotations array<struct<id: bigint, image_id: bigint, category_id: int, iscrowd: int, bbox: array<double>, segmentation: array<array<double>>>>, "
    "categories array<struct<id: int, name: string>>"
)
VOC = (
    "size struct<width: int, height: int>, object array<struct<name: string, bndbox: struct<xmin: double, ymin: double, xmax: double, ymax: double>>>"
)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, all columns text; a byte-order mark is not part of the first name."""
    return spark.read.csv(path, header=True, inferSchema=False)


def read_split(manifest: DataFrame, split: str) -> DataFrame:
    """The rows of one split of a manifest. An empty split is an error, told by the first row found.

    Of a manifest written by split, only that split's folder is listed; a split that is worked out from
    its spelling is filtered after the scan.
    """
    rows = manifest.where(F.col("split") == split)
    if rows.isEmpty():
        raise ValueError(f"no rows in split {split}")
    return rows


def coco_tables(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(images, annotations) of parsed COCO documents."""
    images = documents.select(F.inline("images"))
    annotations = documents.select(F.inline("annotations"))
    return images, annotations


def read_coco(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """COCO documents, one per file, read with a fixed schema."""
    return coco_tables(spark.read.json(path, schema=COCO, multiLine=True))


def read_yolo(spark: SparkSession, path: str) -> DataFrame:
    """(stem, line_number, line) of label files; blank lines are left out, order is kept."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.txt").select("value", F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.txt$", "").alias("stem"))
    lines = files.select("stem", F.filter(F.transform(F.split("value", r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "").alias("lines"))
    return lines.select("stem", F.posexplode("lines").alias("line_number", "line")).withColumn("line_number", F.col("line_number") + 1)


def parse_voc(documents: DataFrame, column: str, key: str) -> DataFrame:
    """(key, width, height, objects) of VOC documents; missing sizes read -1, missing corners NaN."""
    d = F.from_xml(F.col(column), VOC)
    nan = F.lit(float("nan"))
    corners = lambda o: F.struct(*[F.coalesce(o["bndbox"][a], nan).alias(b) for a, b in (("xmin", "x1"), ("ymin", "y1"), ("xmax", "x2"), ("ymax", "y2"))])
    objects = F.coalesce(F.transform(F.col("_d.object"), corners), F.array().cast("array<struct<x1: double, y1: double, x2: double, y2: double>>"))
    return documents.withColumn("_d", d).select(key, F.coalesce("_d.size.width", F.lit(-1)).alias("width"), F.coalesce("_d.size.height", F.lit(-1)).alias("height"), objects.alias("objects"))


def file_catalogue(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, modificationTime) of all files below a folder, without their content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def file_digests(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, size_bytes, md5, sha256) of all files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select("path", F.col("length").alias("size_bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def key_union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all frames under the ordered union of their columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_csv(frame: DataFrame, path: str) -> None:
    """Header, nested cells as JSON, null as empty; an existing target is an error."""
    flat = [F.to_json(c).alias(c) if isinstance(t.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c, t in zip(frame.columns, frame.schema.fields, strict=True)]
    frame.select(*flat).write.mode("errorifexists").csv(path, header=True)


def write_manifest(frame: DataFrame, path: str) -> None:
    """Parquet by split, so that reading one split lists one folder."""
    frame.write.mode("errorifexists").partitionBy("split").parquet(path)


def write_labels(lines: DataFrame, path: str) -> None:
    """(split, stem, line_number, line): one text value per label file, lines in order, by split."""
    one = lines.groupBy("split", "stem").agg(F.array_sort(F.collect_list(F.struct("line_number", "line"))).alias("l"))
    one.select("split", "stem", F.array_join(F.col("l.line"), "\n").alias("text")).write.mode("errorifexists").partitionBy("split").json(path)


def report_json(frame: DataFrame) -> str:
    """A one-row report as an indented JSON document."""
    return json.dumps(frame.first().asDict(recursive=True), indent=2, default=str) + "\n"


def read_config(spark: SparkSession, path: str) -> dict:
    """A JSON configuration file, from any file system Spark reads; it must hold one object."""
    rows = spark.read.text(path, wholetext=True).take(2)
    found = json.loads(rows[0]["value"]) if len(rows) == 1 else None
    if not isinstance(found, dict):
        raise ValueError(f"{path} is no configuration")
    return found


def provenance(spark: SparkSession, config: dict, code: str | None = None) -> DataFrame:
    """One row on a run: when (UTC), with what versions, which code revision and which settings, and their digest."""
    settings = json.dumps(config, sort_keys=True, default=str)
    versions = {"python": platform.python_version(), "spark": spark.version, "numpy": np.__version__, "platform": platform.platform()}
    row = spark.createDataFrame([(json.dumps(versions, sort_keys=True), code, settings)], "versions string, code string, config string")
    return row.select(F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"), "versions", "code", "config", F.sha2("config", 256).alias("config_sha256"))


def data_yaml(folder: str, names: dict[int, str]) -> str:
    """The description file of a detection training folder."""
    return "\n".join([f"path: {folder}", "train: images/train", "val: images/val", "test: images/test", "names:", *[f"  {k}: {v}" for k, v in sorted(names.items())]]) + "\n"


def normalised_text_digest(files: DataFrame) -> DataFrame:
    """(sha256) over (name, content text) in order of name, line ends brought to LF.

    Meant for a handful of small source files, as it joins their text.
    """
    part = F.concat(F.col("name"), F.lit("\x00"), F.regexp_replace("content", "\r\n", "\n"), F.lit("\x00"))
    return files.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", part.alias("part")))), lambda x: x["part"]), ""), 256).alias("sha256"))


def transformed(frame: DataFrame, transform: Callable[[dict], dict], schema: str) -> DataFrame:
    """A scan with a caller's transform of each row, a dictionary to a dictionary, run on Arrow batches.

    For transforms that no column expression can state; one that raises fails the task. Columns that the result lacks are null.
    """
    kind = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(kind)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            yield pa.RecordBatch.from_pylist([transform(row) for row in part.to_pylist()], schema=arrow)

    return frame.mapInArrow(run, kind)


def batches(frame: DataFrame, size: int) -> DataFrame:
    """The frame with batch_id: consecutive chunks of at most ``size`` rows within partitions."""
    place = F.monotonically_increasing_id()
    partition = F.shiftrightunsigned(place, 33)
    inside = place.bitwiseAND(F.lit((1 << 33) - 1))
    return frame.withColumn("batch_id", F.concat_ws("-", partition, F.floor(inside / size)))
