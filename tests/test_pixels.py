import sys

import numpy as np
import pytest
from conftest import png
from pyspark import cloudpickle
from pyspark.sql import functions as F

from panelmill.operators import pixels as P
from panelmill.plans.panels import cut_canvases
from panelmill.plans.stitch import stitch_images
from panelmill.sources import images as S

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SCHEMA = "image_id int, height int, width int, data binary"


def frame(spark, imgs):
    return spark.createDataFrame([(i, a.shape[0], a.shape[1], bytearray(a.tobytes())) for i, a in imgs.items()], SCHEMA)


def array(row):
    return np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, 3)


def noise(seed, h, w):
    return np.random.default_rng(seed).integers(0, 256, (h, w, 3)).astype(np.uint8)


def test_folder_scan_order_and_decode(spark, tmp_path):
    folder = tmp_path / "Chapter 1"
    folder.mkdir()
    a, b = noise(1, 3, 4), noise(2, 2, 5)
    (folder / "10.PNG").write_bytes(png(b))
    (folder / "2.png").write_bytes(png(a))
    (folder / "bad.png").write_bytes(b"nope")
    (folder / "note.txt").write_text("x")
    files = S.in_reading_order(S.scan_images(spark, str(tmp_path)))
    assert [r.fname for r in files.orderBy("seq").collect()] == ["2.png", "10.PNG", "bad.png"]
    one = str(folder / "2.png")
    assert S.scan_images(spark, one).count() == 3 and S.scan_images(spark, one, alone=True).count() == 1
    flagged = S.decode_flagged(spark, str(tmp_path / "*" / "*.[pP][nN][gG]"))
    assert sorted((r.ok, r.height, r.n_channels) for r in flagged.collect() if r.ok) == [(True, 2, 3), (True, 3, 3)]
    assert [(r.height, r.data) for r in flagged.where("not ok").collect()] == [(None, None)]
    good, bad = S.decode_images(spark, str(tmp_path / "*" / "*.[pP][nN][gG]"))
    assert bad.count() == 1
    got = {(r.height, r.width): array(r) for r in good.collect()}
    assert np.array_equal(got[3, 4], a) and np.array_equal(got[2, 5], b)
    with pytest.raises(ValueError):
        S.require_readable(good.limit(0))


def test_grey_and_alpha_become_three_channels(spark):
    rows = [("g", 1, 2, 1, bytearray([7, 9])), ("a", 1, 1, 4, bytearray([1, 2, 3, 255])), ("c", 1, 1, 3, bytearray([4, 5, 6]))]
    df = spark.createDataFrame(rows, "origin string, height int, width int, n_channels int, data binary")
    got = {r.origin: (r.n_channels, list(bytes(r.data))) for r in S.three_channels(df).collect()}
    assert got == {"g": (3, [7, 7, 7, 9, 9, 9]), "a": (3, [1, 2, 3]), "c": (3, [4, 5, 6])}


def test_header_sizes(spark):
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc2\x00\x0b\x08\x00\x07\x00\x09\x03xxxxxx"
    gif, bmp = b"GIF89a\x05\x00\x06\x00", b"BM" + b"\0" * 16 + b"\x08\0\0\0\xf7\xff\xff\xff"
    df = spark.createDataFrame([(bytearray(x),) for x in (jpeg, gif, bmp, png(noise(1, 3, 4)), b"zz")], "c binary")
    got = [tuple(r.s) for r in df.select(S.image_size(F.col("c")).alias("s")).collect()]
    assert got == [(9, 7), (5, 6), (8, 9), (4, 3), (-1, -1)]


def test_crop_and_stack(spark):
    img = noise(3, 10, 4)
    df = frame(spark, {1: img})
    cut = df.select("image_id", F.lit(2).alias("height"), "width", P.crop_rows(F.col("data"), F.col("width"), F.lit(3), F.lit(5)).alias("data")).first()
    assert np.array_equal(array(cut), img[3:5])
    parts = frame(spark, {2: img[4:], 1: img[:4]}).withColumn("k", F.lit(1))
    assert np.array_equal(array(P.stack(parts, ["k"], "image_id").first()), img)


def test_stitched_pixels(spark):
    imgs = {i: noise(i, h, 6) for i, h in enumerate((7, 5, 9))}
    pages = spark.createDataFrame([("c", i, i, 6, a.shape[0]) for i, a in imgs.items()], "chapter string, seq int, image_id int, w int, h int")
    rows = stitch_images(pages, frame(spark, imgs), segments=4, max_height=12000).orderBy("segment").collect()
    assert np.array_equal(np.vstack([array(r) for r in rows]), np.vstack(list(imgs.values())))
    assert [r.name for r in rows] == ["01.jpg", "02.jpg", "03.jpg", "04.jpg"]


def test_resize(spark):
    img = np.repeat(np.repeat(noise(4, 3, 3), 2, axis=0), 2, axis=1)
    df = frame(spark, {1: img, 2: noise(5, 2, 2)}).withColumn("new_w", F.expr("if(image_id = 1, 3, 2)")).withColumn("new_h", F.expr("if(image_id = 1, 3, 2)"))
    got = {r.image_id: array(r) for r in P.rescale_images(df).collect()}
    assert np.array_equal(got[1], img[::2, ::2]) and np.array_equal(got[2], noise(5, 2, 2))
    flat = np.full((5, 7, 3), 77, np.uint8)
    assert (P.linear_resize(flat, 13, 4) == 77).all() and P.area_resize(flat, 3, 2).shape == (2, 3, 3)


def test_overlay(spark):
    img = np.zeros((20, 20, 3), np.uint8)
    items = spark.createDataFrame([(1, 5, 5, 8, 6)], "image_id int, x int, y int, w int, h int")
    out = array(P.overlay_boxes(frame(spark, {1: img, 2: img}), items).where("image_id = 1").first())
    assert tuple(out[5, 9]) == (0, 0, 255) and tuple(out[11, 9]) == (0, 0, 255) and not out[8, 9].any() and not out[2, 2].any()


def test_numbers_above_boxes(spark):
    img = np.zeros((90, 80, 3), np.uint8)
    items = spark.createDataFrame([(1, 10, 40, 30, 20, 17), (1, 60, 5, 10, 10, 8), (1, 70, 60, 9, 9, 123)], "image_id int, x int, y int, w int, h int, n int")
    out = array(P.overlay_boxes(frame(spark, {1: img}), items).first())
    dots = P.digit_dots("17")
    assert dots.shape == (15, 21) and dots[:3, 3:6].all() and not dots[:3, :3].any() and dots[:3, 12:].all()
    tag = out[40 - 21 : 40, 10:37]
    assert (tag[:3] == (0, 0, 255)).all() and (tag[3:18, 3:24][dots] == 255).all() and (tag[3:18, 3:24][~dots] == (0, 0, 255)).all()
    assert (out[3:18, 63:72][P.digit_dots("8")] == 255).all()  # moved down at the upper edge
    assert (out[60 - 21 : 60, 79] == (0, 0, 255)).any() and tuple(out[55, 25]) == (0, 0, 0)
    assert len({P.digit_dots(str(d)).tobytes() for d in range(10)}) == 10


def test_panels_from_canvases(spark):
    rng = np.random.default_rng(0)
    img = rng.integers(0, 256, (200, 40, 3)).astype(np.uint8)
    img[60:65] = 255
    boxes = spark.createDataFrame([(1, 1, 1, 20, 20, "a.", 40, 200), (1, 2, 2, 90, 20, "b", 40, 200)],
                                  "image_id int, box_id bigint, n int, y int, h int, text string, page_w int, page_h int")
    canvases = spark.createDataFrame([("c", 1, 1)], "chapter string, seq int, image_id int")
    out = cut_canvases(frame(spark, {1: img}), boxes, canvases).orderBy("n").collect()
    assert np.array_equal(np.vstack([array(r) for r in out]), img)
    assert out[0].height in range(60, 66) and [r.name for r in out[:2]] == ["panel_0001.jpg", "panel_0002.jpg"]


def test_rerun_replaces_only_its_own_output(spark, tmp_path):
    out = str(tmp_path / "out")
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "chapter string, n int")
    S.write_table(df, out, ["chapter"])
    S.write_table(spark.createDataFrame([("a", 9)], df.schema), out, ["chapter"])
    assert sorted((r.chapter, r.n) for r in spark.read.parquet(out).collect()) == [("a", 9), ("b", 3)]
