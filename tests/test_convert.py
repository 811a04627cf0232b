"""From files to Markdown with plain adapters, and the rules around it."""

import datetime
import os
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import convert as C
from docforge.operators import files as FI
from docforge.operators import ocr
from docforge.operators import raster as R
from docforge.options import Options

AT = datetime.datetime(2024, 3, 5, 6, 7)


class Page:
    width, height, rotation = 30, 20, 90

    def __init__(self, items, broken=False):
        self.items, self.broken = items, broken

    def render(self, scale, rotation):
        if self.broken:
            raise ValueError("no drawing")
        return np.full((int(self.height * scale), int(self.width * scale), 3), rotation % 256, np.uint8)


def reader():
    long = [{"str": f"Word{k} of a layer", "transform": [1.0, 0.0, 0.0, 10.0, 10.0, 700.0 - 12 * k], "width": 60.0, "height": 10.0} for k in range(4)]

    def read(content):
        if content == b"bad":
            raise ValueError("no PDF")
        return {b"layer": [Page(long)], b"both": [Page(long), Page([])], b"broken": [Page(long), Page([], True)], b"none": []}[content]

    return read


def decoder():
    def decode(content):
        if content[:3] != b"raw":
            raise ValueError("unknown format")
        return np.frombuffer(content[3:], np.uint8).reshape(1, -1, 3)

    return decode


def engine():
    def read(content, lang, psm):
        if content == b"unreadable":
            raise ValueError("nothing there")
        head = content.split(b"\n")[0].decode("latin1")
        return {"text": f"{head}\n\nplain \U0001d54a", "confidence": 60.5, "blocks": None if content == b"tiff" else [{"paragraphs": [{"lines": [{"text": f" seen  {head} ", "words": [{"font_size": 9.0}]}]}]}]}

    return read


def test_files_to_markdown(spark):
    """Layer, gate, recognition, formats that aren't decoded, and errors of each kind, each in its own file only."""
    rows = [(1, "a.pdf", b"layer"), (2, "b.pdf", b"both"), (3, "c.pdf", b"bad"), (4, "d.pdf", b"broken"), (5, "e.png", b"raw" + bytes(12)), (6, "f.tif", b"tiff"), (7, "g.png", b"unreadable"), (8, "h.txt", b"text"), (9, "i.pdf", b"none")]
    files = spark.createDataFrame([(i, n, "", c) for i, n, c in rows], "doc_id long, name string, mime string, content binary")
    got = {r["doc_id"]: r for r in C.to_markdown(files, engine, reader, decoder, F.lit(AT)).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 9}
    assert {i: r["error"] for i, r in got.items() if not r["ok"]} == {3: "no PDF", 4: "no drawing", 7: "nothing there"}
    assert all(got[i]["markdown"] is None and got[i]["pages"] is None for i in (3, 4, 7))
    layer = "\n".join(f"Word{k} of a layer" for k in range(4))
    assert (got[1]["pages"], got[1]["chars"], got[1]["confidence"], got[1]["from_layer"]) == (1, len(layer), None, True)
    assert (got[2]["pages"], got[2]["confidence"], got[2]["from_layer"]) == (2, 61, True)
    assert "## 1. oldal\n\nWord0 of a layer" in got[2]["markdown"] and "## 2. oldal\n\nseen P6 91 61 255" in got[2]["markdown"]
    assert "seen P6 8 2 255" in got[5]["markdown"] and got[5]["from_layer"] is False
    assert got[6]["markdown"].endswith("\n\ntiff plain \U0001d54a\n") and got[6]["chars"] == len("tiff\n\nplain ") + 2
    without = {r["doc_id"]: r for r in C.to_markdown(files.where("doc_id = 1"), engine, reader, decoder, F.lit(AT), Options(pdf_text=False)).collect()}
    assert without[1]["confidence"] == 61 and without[1]["from_layer"] is False


def test_files_are_gone_through_once(spark, tmp_path):
    """what makes the files runs once, each file is opened once, and the pages of one file are recognised by several tasks."""
    folder = str(tmp_path)

    def note(said):
        with open(f"{folder}/{said}-{uuid.uuid4().hex}", "w"):
            pass

    def made(batches):
        for pdf in batches:
            for i in pdf["doc_id"]:
                note(f"made-{i}")
            yield pdf

    class Blank(Page):
        def __init__(self):
            super().__init__([])

    def noting_reader():
        return lambda content: note("opened-" + content.decode()) or [Blank()] * 40

    def noting_engine():
        def read(content, lang, psm):
            note(f"task-{TaskContext.get().partitionId()}")
            return {"text": "plain", "confidence": float("nan"), "blocks": [{"paragraphs": None}, None]}

        return read

    rows = spark.createDataFrame([(i, f"{i}.pdf", "", b"%d" % i) for i in range(3)], "doc_id long, name string, mime string, content binary")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = C.to_markdown(rows.mapInPandas(made, rows.schema), noting_engine, noting_reader, decoder, F.lit(AT), Options(gray=False, contrast=False)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    seen = Counter(f.rsplit("-", 1)[0] for f in os.listdir(folder))
    assert {k: n for k, n in seen.items() if not k.startswith("task")} == {f"{what}-{i}": 1 for what in ("made", "opened") for i in range(3)}
    assert len([k for k in seen if k.startswith("task")]) > 3
    assert [(r["ok"], r["pages"], r["chars"], r["confidence"], r["from_layer"]) for r in got] == [(True, 40, 200, None, False)] * 3


def test_results_of_the_wrong_kind_are_errors(spark):
    """A result that has not the promised kinds is its image's error; images with errors of their own keep them."""
    images = spark.createDataFrame([(1, b"a", None), (2, b"b", None), (3, None, "given"), (4, None, None)], "id long, content binary, error string")
    got = {r["id"]: (r["ok"], r["error"], r["text"]) for r in ocr.recognize(images, lambda: lambda content, lang, psm: {"text": {b"a": "x", b"b": 5}[content], "confidence": 1}, "hun", "3").collect()}
    assert got[1] == (True, None, "x") and got[3] == (False, "given", None) and got[4] == (True, None, None)
    assert got[2][0] is False and got[2][1] and got[2][2] is None


def test_enhanced_as_pixel_tables(spark):
    """The batch form of the raster steps gives what they give on a table of pixels, and nothing changes with all of them off."""
    rng = np.random.default_rng(4)
    image = np.concatenate([rng.integers(20, 90, (9, 11, 3)), rng.integers(120, 220, (9, 11, 3))]).astype(np.uint8)
    flat = [(1, p, *map(int, rgb)) for p, rgb in enumerate(image.reshape(-1, 3))]
    table = spark.createDataFrame(flat, "image_id long, p long, r int, g int, b int")
    for contrast, black_white in ((True, False), (True, True), (False, True), (False, False)):
        want = [r["r"] for r in R.enhance(table, contrast, black_white, True).orderBy("p").collect()]
        got = C.enhanced(image, Options(contrast=contrast, binarize=black_white))
        assert got[:, :, 0].ravel().tolist() == want
    off = Options(gray=False, contrast=False, binarize=False)
    assert C.enhanced(image, off) is image
    assert R.enhance(table, False, False, False).collect() == table.collect()


def test_transformed():
    image = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    assert (C.transformed(image, 0, 1.0) == image).all()
    assert C.transformed(image, 90, 1.0)[0, 0].tolist() == image[1, 0].tolist() and C.transformed(image, 90, 1.0).shape == (4, 2, 3)
    assert C.transformed(image, 270, 2.0).shape == (8, 4, 3) and C.transformed(image, 0, 0.01).shape == (1, 1, 3)
    assert C.as_ppm(image)[:11] == b"P6 4 2 255\n"


def test_wide_characters_and_controls(spark):
    rows = spark.createDataFrame([("A" * 40 + "\U0001f600" * 20,), ("A" * 40 + "\U0001f600" * 15,), ("\tx\n",), ("\x01 y.MD\x02",)], "t string")
    got = [tuple(r) for r in rows.select(T.looks_like_heading(F.col("t")), T.utf16_length(F.col("t")), T.safe_file_name_native(F.col("t"))).collect()]
    assert [x[0] for x in got[:2]] == [False, True] and [x[1] for x in got] == [80, 70, 3, 7]
    assert [x[2] for x in got[2:]] == ["x.md", "y.MD"]


def test_unknown_names_and_sizes(spark):
    rows = [(1, "a", None), (2, "a", None), (3, None, 5), (4, None, 5), (5, None, None), (6, "a", 5)]
    files = spark.createDataFrame(rows, "seq long, name string, size long")
    assert sorted(r["seq"] for r in FI.deduplicate(files).collect()) == [1, 3, 5, 6]
    assert sorted(r["seq"] for r in FI.deduplicate(files, files.where("seq in (2, 5)")).collect()) == [3, 6]


@pytest.mark.parametrize(("url", "status"), [("/", 200), ("", 200), ("/index.html?q=../x", 200), ("/a/./b/..", 404), ("/%2e%2E/index.html", 200), ("/..%2findex.html", 403), ("/%", 400), ("/%2f%2f/index.html", 200)])
def test_route_server(spark, url, status):
    asked = spark.createDataFrame([(url,)], "url string")
    assert FI.route_server(asked, spark.createDataFrame([("/index.html",)], "path string")).first()["status"] == status
