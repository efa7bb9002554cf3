"""Images, masks, assets, logs and driver helpers."""

import hashlib
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from tessella.functions import driver
from tessella.operators import masks
from tessella.sources import readers


def png(path, rows):
    """A gray PNG of rows of bytes."""
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", len(rows[0]), len(rows), 8, 0, 0, 0, 0)
    path.write_bytes(b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + bytes(r) for r in rows))) + chunk(b"IEND", b""))


def test_images(spark, tmp_path):
    png(tmp_path / "a.png", [[0, 255], [7, 1]])
    (tmp_path / "b.png").write_bytes(b"broken")
    im = readers.read_images(spark, str(tmp_path))
    assert {r.path.rsplit("/", 1)[1]: r.ok for r in im.collect()} == {"a.png": True, "b.png": False}
    assert im.filter("ok").select(readers.luminance(F.col("image")).alias("v")).first().v == [0.0, 255.0, 7.0, 1.0]
    rec = spark.createDataFrame([(f"file:{tmp_path}/a.png",), (f"file:{tmp_path}/b.png",), ("file:/none",)], "path string")
    fixed = im.withColumn("path", F.regexp_replace("path", "^file:/+", "file:/"))
    assert [r.invalid_image for r in readers.with_image_flag(rec, fixed, "path").orderBy("path").collect()] == [True, False, True]


def test_assets(spark, tmp_path):
    (tmp_path / "kg.csv").write_text("organ#attribute#value\nheart#belongs to#circulation\n")
    assert readers.read_edges(spark, str(tmp_path / "kg.csv")).first().value == "circulation"
    (tmp_path / "detection.json").write_text('[{"Liver": [1, 2, 3.5, 4]}, {"Lung": [0, 0, 1, 1]}]')
    assert {r.label: r.box for r in readers.read_boxes(spark, str(tmp_path / "detection.json")).collect()}["Liver"] == [1.0, 2.0, 3.5, 4.0]
    (tmp_path / "question.json").write_text('[{"img_id": 1, "question": "Q", "triple": ["vhead", "_", "_"]}, {"img_id": 1, "question": "R", "triple": ["a", "b", "c"]}]')
    q = readers.read_question_files(spark, str(tmp_path / "question.json"))
    assert q.select("qid").distinct().count() == 2 and q.filter("question = 'R'").first().triple == [["a", "b", "c"]] and q.first().img_id == 1


def test_logs_and_stores(spark, tmp_path):
    rows = spark.sql("select timestamp'2024-05-06 07:08:09' as at, 'x' as m")
    readers.append_log(rows, str(tmp_path / "log"), "at")
    readers.append_log(rows, str(tmp_path / "log"), "at")
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert rows.select(readers.log_path(F.col("at")).alias("p")).first().p == "2024-05-06-conv.json"
    images = spark.createDataFrame([(b"a",), (b"a",), (b"b",)], "data binary")
    known = spark.createDataFrame([(hashlib.md5(b"b").hexdigest(),)], "md5 string")
    assert readers.new_images(images, known).count() == 1
    assert bytes(spark.createDataFrame([("aGk=",)], "t string").select(readers.decode_image(F.col("t")).alias("d")).first().d) == b"hi"
    vocab = spark.createDataFrame([(2, "b", 1), (1, "a", 5)], "rank int, answer string, n bigint")
    readers.save_vocabulary(vocab, str(tmp_path / "v"))
    assert [r.answer for r in readers.load_vocabulary(spark, str(tmp_path / "v")).collect()] == ["a", "b"]
    readers.write_document(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "doc"))
    assert spark.read.option("multiLine", True).json(str(tmp_path / "doc")).count() == 1


def test_pixels(spark):
    im = spark.createDataFrame([("i", y, x, 10 * y + x) for y in range(4) for x in range(4)], "img string, y int, x int, v int")
    mask = spark.createDataFrame([("i", 1, 1), ("i", 1, 2)], "img string, y int, x int")
    kept = masks.apply_mask(im, mask, ["img"]).filter("v > 0").collect()
    assert {(r.y, r.x) for r in kept} == {(1, 1), (1, 2)}
    assert masks.apply_mask(im, mask.limit(0), ["img"]).filter("v > 0").count() == 15
    box = masks.bounding_boxes(mask, ["img"], F.lit(4), F.lit(4), 0.0)
    assert {(r.y, r.x, r.v) for r in masks.crop(im, box, ["img"]).collect()} == {(0, 0, 11), (0, 1, 12)}
    half = masks.resize_nearest(im, ["img"], (F.lit(4), F.lit(4)), (F.lit(2), F.lit(2)))
    assert {(r.y, r.x): r.v for r in half.collect()} == {(0, 0): 11, (0, 1): 13, (1, 0): 31, (1, 1): 33}
    double = masks.resize_nearest(im, ["img"], (F.lit(4), F.lit(4)), (F.lit(8), F.lit(6)))
    got = {(r.y, r.x): r.v for r in double.collect()}
    assert len(got) == 48 and got[0, 0] == 0 and got[5, 7] == 33


def test_driver_helpers():
    assert driver.json_safe({"a": (1, float("nan")), 2: {"y", "x"}}) == {"a": [1, None], "2": ["x", "y"]}
    assert driver.settings_hash({"b": 1, "a": 2}) == driver.settings_hash({"a": 2, "b": 1})


@pytest.mark.parametrize(
    ("raw", "want"),
    [("q_proj,k_proj", ("list", ["q_proj", "k_proj"])), ("q_proj|k_proj|v_proj", ("regex", ["q_proj|k_proj|v_proj"])), ('["q_proj","k_proj"]', ("list", ["q_proj", "k_proj"])), ("re:^a", ("regex", ["^a"])), ("list:q_proj|k_proj", ("list", ["q_proj|k_proj"])), ("", ("none", [])), ("q_proj", ("single", ["q_proj"]))],
)
def test_target_specs(raw, want):
    assert driver.parse_target_spec(raw) == want
