"""Golden cases of files, rasters, layout, recognition, sinks and the stream."""

import datetime

import pytest
from pyspark.sql import functions as F

from docforge.operators import files as FI
from docforge.operators import layout as L
from docforge.operators import markdown as M
from docforge.operators import ocr as O
from docforge.operators import raster as R
from docforge.operators import run as U
from docforge.options import Options
from docforge.sources import binary, sinks
from docforge.streaming import admission

FILE = "seq long, name string, mime string, size long"


def test_admission(spark):
    files = spark.createDataFrame([(3, "a.pdf", "", 1), (1, "a.pdf", "image/png", 1), (2, "b.txt", "text/plain", 5), (4, "c.bin", "image/x", 2)], FILE)
    got = FI.with_ids(FI.deduplicate(FI.admit(files))).orderBy("seq").collect()
    assert [(r["file_id"], r["seq"], r["kind"]) for r in got] == [(1, 1, "pdf"), (2, 4, "image")]
    assert tuple(FI.admission_summary(files).first()) == (2, 2, "skipped")
    assert FI.deduplicate(FI.admit(files), FI.admit(files)).count() == 0


def test_luma_and_otsu(spark):
    pix = spark.createDataFrame([(1, i, *c) for i, c in enumerate([(255, 0, 0), (0, 255, 0), (0, 0, 255), (1, 1, 1), (4, 4, 4), (255, 255, 255)])], "image_id long, p long, r int, g int, b int")
    assert [r["v"] for r in R.luma(pix).orderBy("p").collect()] == [76, 149, 29, 0, 3, 255]
    hist = spark.createDataFrame([(1, 0, 2), (1, 255, 2), (2, 9, 5)], "image_id long, v int, n long")
    assert {r["image_id"]: r["threshold"] for r in R.otsu(hist).collect()} == {1: 0, 2: 0}


def test_scales(spark):
    df = spark.createDataFrame([(500, 700), (800, 600), (5000, 3000)], "w long, h long")
    assert [round(r[0], 9) for r in df.select(R.image_scale(F.col("w"), F.col("h"), F.lit(4200))).collect()] == [2.0, 2.0, 0.84]


def test_bands_do_not_drift(spark):
    rows = [(1, 1, i, t, [1.0, 0.0, 0.0, 10.0, float(i * 50), y], 30.0, 9.0) for i, (t, y) in enumerate([("a", 100.0), ("b", 98.5), ("c", 97.0), ("d", 95.5)])]
    items = spark.createDataFrame(rows, "doc_id long, page_no int, item_idx long, str string, transform array<double>, width double, height double")
    assert [r["text"] for r in L.rows(items).orderBy("row_no").collect()] == ["a b", "c d"]


def test_paragraph_gap(spark):
    rows = spark.createDataFrame([(1, 1, k, float(y), "x", 10.0) for k, y in enumerate([700, 688, 676, 650, 638])], "doc_id long, page_no int, row_no long, y double, text string, size double")
    assert [r["para_no"] for r in L.paragraphs(rows).orderBy("row_no").collect()] == [0, 0, 0, 1, 1]


def test_text_layer_gate(spark):
    pages = spark.createDataFrame([(1, "x" * 39 + "  "), (2, " x" * 40), (3, None)], "page_no int, text string")
    layer, left = L.text_layer(pages)
    assert [r["page_no"] for r in layer.collect()] == [2] and sorted(r["page_no"] for r in left.collect()) == [1, 3]


def test_recognition_keeps_failures(spark):
    def engine():
        def read(content, lang, psm):
            if content == b"bad":
                raise ValueError("no image")
            return {"text": "x", "confidence": 81.5, "blocks": [{"paragraphs": [{"lines": [{"text": " x  y ", "words": [{"font_size": 9.0}, {"font_size": None}, {"font_size": 12.0}]}, {"text": " ", "words": []}]}]}]}

        return read

    images = spark.createDataFrame([(1, 1, b"ok"), (2, 1, b"bad")], "doc_id long, page_no int, content binary")
    got = O.recognize(images, engine, "hun", "3").cache()
    assert [(r["ok"], r["error"]) for r in got.orderBy("doc_id").collect()] == [(True, None), (False, "no image")]
    assert [(r["text"], r["size"]) for r in O.flatten(got.where("ok")).collect()] == [("x y", 12.0)]


def test_metrics_and_notes(spark):
    pages = spark.createDataFrame([(1, 10, 70, False), (1, 5, None, True), (2, 1, None, False)], "doc_id long, chars long, confidence int, from_layer boolean")
    got = {r["doc_id"]: tuple(r)[1:] for r in U.document_metrics(pages).collect()}
    assert got == {1: (2, 15, 70, True), 2: (1, 1, None, False)}
    notes = spark.createDataFrame([(69,), (70,), (None,)], "c int").select(U.quality_note(F.col("c"))).collect()
    assert [r[0] for r in notes] == ["is-warn", "is-ok", "is-ok"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a.png", "# x\n"), (2, "a.pdf", "# y\n"), (3, "b.pdf", "z")], "file_id long, name string, markdown string")
    assert sorted(r["file_name"] for r in U.unique_output_names(docs).collect()) == ["a-1.md", "a-2.md", "b.md"]
    sinks.write_each(docs, f"file://{tmp_path}/each")
    assert {p.name: p.read_bytes() for p in (tmp_path / "each").iterdir()} == {"a-1.md": b"# x\n", "a-2.md": b"# y\n", "b.md": b"z"}
    sinks.write_combined(docs, f"file://{tmp_path}/one")
    assert spark.read.text(f"file://{tmp_path}/one", wholetext=True).first()[0].startswith("# x\n\n---\n\n# y\n\n---\n\nz")


def test_combined_in_pieces(spark, tmp_path):
    """No row holds the whole: files of several partitions, in order of name, are the combined text."""
    rows = [(k // 2, f" # {k}\n" if k % 5 else None) for k in range(40)] + [(3, " # 7\n"), (None, "n"), (0, "")]
    docs = spark.createDataFrame(rows, "file_id long, markdown string")
    whole = M.combine(docs, "file_id").first()[0]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sinks.write_combined(docs, f"file://{tmp_path}/many", "file_id")
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    files = sorted((tmp_path / "many").glob("part-*"))
    assert "".join(f.read_text() for f in files) == whole
    assert sum(f.stat().st_size > 0 for f in files) > 1


def test_combined_row_is_not_a_list(spark):
    """the heap holds no list of all documents; no documents give no text, and a text that no row can hold is refused."""
    docs = spark.createDataFrame([(2, " b\n"), (1, "á"), (3, None), (None, "n")], "doc_id long, markdown string").repartition(3)
    made = M.combine(docs)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert [r[0] for r in made.collect()] == ["n\n\n---\n\ná\n\n---\n\nb\n"]
    assert [r[0] for r in M.combine(docs.limit(0)).collect()] == [None] == [r[0] for r in M.combine(docs.where("markdown IS NULL")).collect()]
    with pytest.raises(Exception, match="exceeds 9 bytes"):
        M.combine(docs, most=9).collect()


def test_scan_and_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.png").write_bytes(b"123")
    got = binary.scan(spark, f"file://{tmp_path}/in").first()
    assert (got["name"], got["size"], got["mime"]) == ("a.png", 3, "image/png")
    at = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, "a.pdf", "", 1, at), (2, "a.pdf", "", 1, at), (3, "b.txt", "", 1, at)], FILE + ", arrived timestamp")
    rows.write.parquet(f"file://{tmp_path}/rows")
    stream = admission.admitted_stream(spark, f"file://{tmp_path}/rows", rows.schema)
    admission.run_once(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/state").awaitTermination(60)
    assert spark.read.schema(stream.schema).parquet(f"file://{tmp_path}/out").count() == 1


def test_options():
    with pytest.raises(ValueError):
        Options(dpi=221)
