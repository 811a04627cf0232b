"""Images as strips against the same images whole, formats by their bytes, and pixmaps read by slices."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docforge.operators import convert as C
from docforge.operators import strips as S
from docforge.options import Options
from docforge.sources import binary, netpbm

STRIPS = "image_id long, y long, w long, h long, channels int, pixels binary"


def strips_of(spark, images, lines=3):
    rows = [(i, y, a.shape[1], len(a), a.shape[2], a[y : y + lines].tobytes()) for i, a in images.items() for y in range(0, len(a), lines)]
    return spark.createDataFrame(rows, STRIPS).repartition(5)


def whole(strips):
    found = {}
    for r in strips.orderBy("image_id", "y").collect():
        found.setdefault(r["image_id"], []).append(np.frombuffer(bytes(r["pixels"]), np.uint8).reshape(-1, r["w"], r["channels"]))
    return {i: np.concatenate(a) for i, a in found.items()}


@pytest.fixture(scope="module")
def images():
    rng = np.random.default_rng(7)
    made = {1: rng.integers(0, 256, (17, 9, 3)), 2: np.full((8, 5, 3), 77), 3: rng.integers(60, 70, (1, 30, 3)), 4: np.concatenate([rng.integers(10, 60, (6, 4, 3)), rng.integers(150, 250, (7, 4, 3))])}
    return {i: a.astype(np.uint8) for i, a in made.items()}


@pytest.mark.parametrize("contrast,black_white", [(True, False), (True, True), (False, True), (False, False)])
def test_enhanced_as_whole_images(spark, images, contrast, black_white, monkeypatch):
    """Also with parts of few bytes, so that the strips of one image meet their table in several."""
    for part in (S.PART_BYTES, 64):
        monkeypatch.setattr(S, "PART_BYTES", part)
        got = whole(S.enhance(strips_of(spark, images), contrast, black_white))
        assert set(got) == set(images)
        for i, image in images.items():
            assert (got[i][:, :, 0] == C.enhanced(image, Options(contrast=contrast, binarize=black_white))[:, :, 0]).all()


def test_untouched_without_steps(spark, images):
    strips = strips_of(spark, images)
    assert S.enhance(strips, False, False, False) is strips


@pytest.mark.parametrize("strip_bytes", [1, 40, 1 << 20])
def test_turned_as_whole_images(spark, images, strip_bytes):
    turns = {1: 90, 2: 180, 3: 270, 4: 0}
    turn = F.element_at(F.create_map(*[F.lit(x) for pair in turns.items() for x in pair]), F.col("image_id").cast("int"))
    for more in (0, 90, 180):
        got = whole(S.turned(strips_of(spark, images), turn + more, strip_bytes))
        for i, image in images.items():
            want = np.rot90(image, -((turns[i] + more) // 90))
            assert got[i].shape == want.shape and (got[i] == want).all()


def test_on_white(spark):
    clear = np.array([[[10, 20, 30, 0], [10, 20, 30, 255], [0, 100, 255, 128]]], np.uint8)
    assert whole(S.on_white(strips_of(spark, {1: clear})))[1].tolist() == [[[255, 255, 255], [10, 20, 30], [127, 177, 255]]]
    assert C.prepare_images(spark.createDataFrame([(bytes(clear),)], "content binary"), lambda: lambda c: np.frombuffer(c, np.uint8).reshape(1, 3, 4), Options(gray=False, contrast=False, upscale=False)).first()[0] == b"P6 3 1 255\n" + bytes([255, 255, 255, 10, 20, 30, 127, 177, 255])


def test_null_and_empty_strips(spark):
    """Strips without pixels stay as they are and count nothing; a null image joins nothing; an empty table gives an empty one."""
    rows = spark.createDataFrame([(1, 0, 2, 2, 3, bytes(12)), (1, 2, 2, 2, 3, None), (1, 3, 2, 2, 3, b""), (None, 0, 1, 1, 3, bytes(3))], STRIPS)
    assert [(r["v"], r["n"]) for r in S.histograms(rows).where("image_id = 1").collect()] == [(0, 4)]
    got = sorted((r["y"], None if r["pixels"] is None else bytes(r["pixels"])) for r in S.enhance(rows).collect())
    assert got == [(0, bytes(4)), (2, None), (3, b"")]
    assert S.turned(rows, F.lit(180)).count() == 4 and S.turned(rows, F.lit(90)).count() == 1
    none = rows.where("y > 9")
    assert not S.enhance(none, True, True).count() and not S.turned(none, F.lit(90)).count() and not S.pixels(none).count()


def test_hot_image_in_many_tasks(spark, images, monkeypatch):
    """A single image's strips are dealt by parts, so no task has to hold them all."""
    monkeypatch.setattr(S, "PART_BYTES", 200)
    image = np.tile(images[1], (20, 1, 1))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        dealt = S.enhance(strips_of(spark, {5: image})).select(F.spark_partition_id().alias("t")).distinct().count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert dealt > 1


def test_headers():
    assert netpbm.header(b"P5\n#a\n3 2\n255\n......") == (3, 2, 1, 14)
    assert netpbm.header(b"P7\nWIDTH 1\n# x\nHEIGHT 2\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n")[:3] == (1, 2, 4)
    for bad in (b"", b"P6", b"P3 1 1 255 0", b"P6" + b" " * 4000, b"P6" + b" #\n" * 1300, b"P6 1", b"P6 1 1 65535\n", b"\x89PNG"):
        with pytest.raises(ValueError):
            netpbm.header(bad)
    assert netpbm.decoder()(b"P5 2 1 255\n\x01\x02").tolist() == [[[1, 1, 1], [2, 2, 2]]]
    for short in (b"P6 2 1 255\n12345", b"P6 0 1 255\n"):
        with pytest.raises(ValueError):
            netpbm.decoder()(short)


def test_pixmaps_by_slices(spark, images, tmp_path):
    """Every line is read once, by many tasks; files that can't be read give one row each."""
    for i, image in images.items():
        (tmp_path / f"{i}.ppm").write_bytes(C.as_ppm(image))
    (tmp_path / "short.pgm").write_bytes(b"P5 9 9 255\n...")
    (tmp_path / "text.pnm").write_bytes(b"no image, but long enough for more than one slice" * 3)
    (tmp_path / "other.txt").write_bytes(b"P5 1 1 255\n.")
    spark.dataSource.register(netpbm.StripSource)
    read = spark.read.format("docforge_strips").option("path", f"file://{tmp_path}").option("slice_bytes", 50).option("strip_bytes", 40).load()
    assert read.rdd.getNumPartitions() > 10
    assert {r["path"]: r["error"] for r in read.where("error IS NOT NULL").collect()} == {"short.pgm": "the pixels end early", "text.pnm": "no binary pixmap"}
    got = whole(read.where("error IS NULL").withColumnRenamed("path", "image_id"))
    assert {i: a.tolist() for i, a in got.items()} == {f"{i}.ppm": a.tolist() for i, a in images.items()}


def test_formats_by_bytes(spark):
    begun = {"application/pdf": b"%PDF-1.7", "image/png": b"\x89PNG\r\n\x1a\n", "image/jpeg": b"\xff\xd8\xff\xe0", "image/gif": b"GIF89a", "image/bmp": b"BM", "image/webp": b"RIFF\x01\x02\x03\x04WEBP", "image/tiff": b"MM\x00*", "image/x-portable-anymap": b"P4 1 1"}
    rows = spark.createDataFrame([(k, v + b"rest") for k, v in begun.items()] + [(None, b""), (None, None), (None, b"P8 "), (None, b"text")], "kind string, content binary")
    assert all(r[0] == r[1] for r in rows.select("kind", binary.format_by_bytes(F.col("content"))).collect())


def test_slices_of_many_files_share_tasks(tmp_path):
    """partitions grow with bytes and files, not one for each small slice; the slices of a file are in partitions of their own."""
    for i in range(60):
        (tmp_path / f"{i}.pgm").write_bytes(b"P5 300 300 255\n" + b"x" * 90_000 if i % 3 == 0 else b"P5 10 9 255\n" + b"x" * 90)
    reader = netpbm._StripReader({"path": f"file://{tmp_path}", "slice_bytes": "32768"})
    parts = [p.slices for p in reader.partitions()]
    assert len(parts) == 3 and all(len({path for path, *_ in p}) == len(p) for p in parts)
    assert len({s for p in parts for s in p}) == sum(len(p) for p in parts) == 20 * 3 + 40
    (tmp_path / "none").mkdir()
    assert netpbm._StripReader({"path": f"file://{tmp_path}/none"}).partitions() == []
