"""Golden cases of the scalar functions."""

from pyspark.sql import functions as F

from docforge.functions import text as T


def apply(spark, f, *values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string").select("i", f(F.col("v")).alias("r")).orderBy("i").collect()
    return [r["r"] for r in rows]


def test_normalize_raw(spark):
    assert apply(spark, T.normalize_raw, "a­b  c\r\n\r\n\r\n d ", "‘x’ y", "", "\ta\tb") == ["ab c\n\nd", "'x' y", "", "a\tb"]


def test_names(spark):
    assert apply(spark, T.base_name, "a.tar.gz", ".png") == ["a.tar", ""]
    assert apply(spark, T.safe_file_name, "számla 1/2.pdf", ".png", "a.png", "a.pdf") == ["számla 1-2.md", "ocr-szoveg.md", "a.md", "a.md"]
    assert apply(spark, T.safe_file_name_native, "a:b", "x.MD", None) == ["a-b.md", "x.MD", "ocr-szoveg.md"]


def test_markers(spark):
    assert apply(spark, T.leading_marker, "• x", "a kutya", "1. x", "•", "b c") == ["•", "a", None, None, None]
    assert apply(spark, T.escape_block_start, "# nem cím.", "12. pont szövege.", "1998. év volt az.", "> x") == ["\\# nem cím.", "12\\. pont szövege.", "1998. év volt az.", "\\> x"]


def test_headings(spark):
    assert apply(spark, T.looks_like_heading, "BEVEZETÉS", "1.2 Módszerek", "BEVEZETÉS.", "AB", "sima sor", "X" * 71) == [True, True, False, False, False, False]
    assert apply(spark, T.looks_unfinished, "A folyamat", "Vége.", "BEVEZETÉS") == [True, False, False]


def test_formats(spark):
    assert apply(spark, T.yaml_string, 'a"b\\c') == ['"a\\"b\\\\c"']
    assert apply(spark, T.describe_lang, "hun+eng", "slk") == ["magyar + angol", "slk"]
    assert apply(spark, lambda c: T.format_size(c.cast("long")), "1023", "1536", "1048576") == ["1023 B", "2 kB", "1.0 MB"]
    assert apply(spark, T.md_inline, "\\# x", "\\> x", "**a** `b` *c*") == ["# x", "\\&gt; x", "<strong>a</strong> <code>b</code> <em>c</em>"]
    assert apply(spark, T.utf16_length, "a😀", "") == [3, 0]


def test_join_lines(spark):
    df = spark.createDataFrame([(0, ["Ez egy pél-", "da mondat"]), (1, ["Budapest-", "Győr"]), (2, []), (3, ["a"])], "i int, l array<string>")
    assert [r[0] for r in df.orderBy("i").select(T.join_lines(F.col("l"))).collect()] == ["Ez egy példa mondat", "Budapest- Győr", "", "a"]
    assert df.where("i = 1").select(T.join_lines(F.col("l"), False)).first()[0] == "Budapest-  \nGyőr"
