"""Golden cases of blocks, Markdown and HTML, and the passes against a plain fold."""

import random

from pyspark.sql import functions as F

from docforge.operators import blocks as B
from docforge.operators import html as H
from docforge.operators import markdown as M
from docforge.options import Options

LINE = "doc_id long, page_no long, para_no long, line_no long, text string, size double"


def page(spark, *paragraphs):
    rows, n = [], 0
    for k, lines in enumerate(paragraphs):
        for text, size in lines:
            rows.append((1, 1, k, n, text, float(size)))
            n += 1
    return spark.createDataFrame(rows, LINE)


def md(spark, *lines, **options):
    df = spark.createDataFrame([(list(lines), 0)], "lines array<string>, heading int")
    return M.with_markdown(df, Options(**options)).first()["markdown"]


def test_block_markdown(spark):
    assert md(spark, "• alma", "• körte") == "- alma\n- körte"
    assert md(spark, "e alma", "e körte") == "- alma\n- körte"
    assert md(spark, "1. egy", "2) két") == "1. egy\n2. két"
    assert md(spark, "• al-", "ma", "• körte") == "- alma\n- körte"
    assert md(spark, "BEVEZETÉS") == "### BEVEZETÉS"
    assert md(spark, "1. Bevezetés") == "### 1. Bevezetés"
    assert md(spark, "BEVEZETÉS", headings=False) == "BEVEZETÉS"
    assert md(spark, "• alma", "• körte", lists=False) == "• alma • körte"
    assert md(spark) == ""


def test_heading_level(spark):
    df = spark.createDataFrame([(["Cím", "két sor"], 3), (["x"], 6)], "lines array<string>, heading int")
    assert [r["markdown"] for r in M.with_markdown(df, shift=1).collect()] == ["#### Cím két sor", "###### x"]


def test_regroup(spark):
    got = B.regroup(page(spark, [("Egy sor.", 10), ("két sor.", 10), ("Nagy cím", 13)], [("Más", 11)], [("A folyamat", 10)], [("folytatódik.", 10)])).orderBy("block_no").collect()
    assert [(r["heading"], r["lines"]) for r in got] == [(0, ["Egy sor.", "két sor."]), (2, ["Nagy cím"]), (3, ["Más"]), (0, ["A folyamat", "folytatódik."])]


def test_list_fragments(spark):
    got = B.regroup(page(spark, [("• a", 10)], [("• b", 10)], [("- c", 10)])).orderBy("block_no").collect()
    assert [(r["marker"], r["lines"]) for r in got] == [("•", ["• a", "• b"]), ("-", ["- c"])]


def test_medians(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],)], "v array<double>")
    assert [r[0] for r in df.select(B.upper_median(F.col("v"))).collect()] == [3.0, 0.0]


def test_upper_median_by(spark):
    rows = [(1, 2.0), (1, 2.0), (1, 5.0), (1, 3.0), (1, None), (2, None), (None, 4.0), (None, 1.0), (3, 7.0)]
    got = B.upper_median_by(spark.createDataFrame(rows, "k int, v double"), "k", "v", "med")
    assert {r["k"]: r["med"] for r in got.collect()} == {1: 3.0, 2: 0.0, None: 4.0, 3: 7.0}
    assert "collect_list" not in got._jdf.queryExecution().toString()


def test_row_order_does_not_matter(spark):
    lines = [[(random.Random(k).choice(["• x", "Y", "z sor", "NAGY", "vége."]), random.Random(k + 50).choice([0, 10, 13]))] for k in range(25)]
    df = page(spark, *lines)
    one = M.page_markdown(df).first()["markdown"]
    assert one == M.page_markdown(df.orderBy(F.rand(3))).first()["markdown"]


def test_documents(spark):
    lines = spark.createDataFrame([(1, 1, 0, 0, "Egy mondat.", 10.0), (1, 3, 0, 0, "Cím", 13.0), (1, 3, 0, 1, "szöveg.", 10.0), (1, 3, 0, 2, "szöveg.", 10.0)], LINE)
    pages = spark.createDataFrame([(1, 1, "a.b.pdf", 70, False), (1, 2, "a.b.pdf", None, True), (1, 3, "a.b.pdf", 81, False)], "doc_id long, page_no long, name string, confidence int, from_layer boolean")
    text = M.build_documents(pages, lines, F.lit("2024-03-05 06:07:08").cast("timestamp"), Options(front_matter=True)).first()["markdown"]
    assert text.startswith('---\ncim: "a.b"\nforras: "a.b.pdf"\noldalak: 3\nnyelv: "hun"\nmegbizhatosag: 76\nletrehozva: "2024-03-05T06:07:08.000Z"\n')
    assert "## 1. oldal\n\nEgy mondat.\n\n## 2. oldal\n\n*(Ezen" in text and "## 3. oldal\n\n### Cím\n\nszöveg. szöveg.\n" in text


def test_html(spark):
    md_ = "---\na: <b>\n---\n# Cím\n\n- egy\n- *két*\n\n1. x\n2. y\n\n---\n\nsor  \nmásik"
    df = spark.createDataFrame([(md_,), ("",)], "m string")
    assert [r[0] for r in df.select(H.to_html(F.col("m"))).collect()] == ["<pre><code>a: &lt;b&gt;</code></pre>\n<h1>Cím</h1>\n<ul><li>egy</li><li><em>két</em></li></ul>\n<ol><li>x</li><li>y</li></ol>\n<hr>\n<p>sor<br>\nmásik</p>", ""]
