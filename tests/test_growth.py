"""Steps that would grow faster than their input, told by plans, and the closed forms against what they stand for."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import blocks as B
from docforge.operators import files as FI
from docforge.operators import markdown as M
from docforge.plans import block_queries as BQ
from docforge.plans import fixtures as X
from docforge.sources import binary, sinks

DATA = "/root/testdata/sf0.001"


def plan(df, step="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), step)().toString()


def test_blocks_are_rendered_once(spark):
    """No filter holds the rules that render a block."""
    shown = plan(M.page_markdown(X.lines(spark, DATA)))
    assert "aggregate(" in shown and not [x for x in shown.split("\n") if "Filter" in x and "aggregate(" in x]


def test_lines_are_not_cut_from_copies(spark):
    """an array of words isn't sliced for each line; pages don't cut lines at all."""
    assert "slice(" not in plan(X.lines(spark, DATA)) and "Window" not in plan(X.lines(spark, DATA))
    own = X.lines(spark, DATA)
    assert own.select("doc_id", "page_no").distinct().exceptAll(X.pages(spark, DATA)).count() == 0 == X.pages(spark, DATA).exceptAll(own.select("doc_id", "page_no").distinct()).count()
    run = Window.partitionBy("doc_id", "page_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    counted = F.sum(F.when(F.pmod(F.col("line_no") + F.col("doc_id"), F.lit(20)).isin(*X.STARTS), 1).otherwise(0)).over(run)
    assert own.withColumn("n", counted).where("n <> para_no").count() == 0


def test_parts_follow_the_text(spark, monkeypatch):
    """As many parts as the text asks for, not as the session has."""
    docs = spark.createDataFrame([(k, "x" * 100) for k in range(50)], "doc_id long, text string")
    monkeypatch.setattr(X, "PART_BYTES", 100)
    assert X.dealt(docs).rdd.getNumPartitions() == 50
    assert X.dealt(docs.where("doc_id < 0")).count() == 0


def test_few_sorts(spark):
    """Lines are sorted twice, not five times."""
    assert plan(B.with_groups(X.lines(spark, DATA)), "executedPlan").count("Sort [") <= 2


def test_documents_are_not_broadcast(spark):
    """whole documents aren't broadcast to the tasks of their heads, however small the table is."""
    shown = plan(BQ.built(spark, DATA), "executedPlan")
    assert "ShuffledHashJoin" in shown and "BroadcastHashJoin" not in shown


def test_fallback_lines_without_sort(spark):
    """lines are numbered by their place; those without text have no number."""
    pages = spark.createDataFrame([(1, 1, " a  b\r\n \r\n\r\nc’\n \n"), (1, 2, " \n\n"), (2, 1, None)], "doc_id long, page_no long, text string")
    got = M.fallback_lines(pages)
    assert [tuple(r) for r in got.collect()] == [(1, 1, 0, 0, "a b", 0.0), (1, 1, 1, 1, "c'", 0.0)]
    assert "Window" not in plan(got)


def test_rules_keep_their_results(spark):
    """Headings by counts of letters, plain forms of quotes and blanks, as they were."""
    said = [("ABC", True), ("AB", False), ("ABCd", True), ("ABcd", False), ("1. Abc", True), ("1. Ab", False), ("ABC.", False), ("ÁÉŐ \U0001d54a", True)]
    df = spark.createDataFrame(said, "t string, heading boolean")
    assert df.where(T.looks_like_heading(F.col("t")) != F.col("heading")).count() == 0
    df = spark.createDataFrame([("‘a’  b­ ",), ("a\tb",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(T.normalize_line(F.col("t"))).collect()] == ["'a' b", "a\tb", "", None]


def test_files_are_listed_by_parts(spark, tmp_path):
    """tasks of a scan grow with the folders that tasks wrote, not with the files; empty files are listed too."""
    spark.dataSource.register(sinks.StagedFiles)
    rows = spark.range(300).selectExpr("concat('f', id, if(id % 2 = 0, '.pdf', '.PNG')) AS name", "repeat('x', cast(id AS int)) AS content")
    got = []
    for name, by_parts in (("flat", False), ("parts", True)):
        folder = f"file://{tmp_path}/{name}"
        rows.repartition(3).write.format("docforge_files").option("path", folder).mode("append").save()
        sinks.publish(spark, folder, by_parts)
        sinks.publish(spark, folder, by_parts)
        got.append((binary.scan_parts if by_parts else binary.scan)(spark, folder))
    (tmp_path / "parts/_hidden").mkdir()
    (tmp_path / "parts/_hidden/a.pdf").write_bytes(b"x")
    flat, parts = got
    assert len([p for p in (tmp_path / "parts").iterdir() if p.name.startswith("part-")]) == 3 >= parts.rdd.getNumPartitions()
    own = ["name", "size", "mime"]
    assert parts.count() == 300 and parts.dtypes == flat.dtypes
    assert [tuple(r) for r in parts.select(own).exceptAll(flat.select(own)).collect()] == [("f0.pdf", 0, FI.UNKNOWN_TYPE)]  # Spark's reader leaves out empty files
    row = parts.where("name = 'f7.PNG'").first()
    assert row["path"].startswith("file:/") and binary.with_content(spark, parts.where("name = 'f7.PNG'"), row["path"].rsplit("/", 1)[0]).first()["content"] == b"x" * 7


def test_pages_are_listed_by_parts(spark, tmp_path):
    """the driver's partitions grow with the bytes and hold no file's name; all pages are read, each once, by several tasks for a large file."""
    from docforge.sources import pages as P

    for source in (sinks.StagedFiles, P.PageSource):
        spark.dataSource.register(source)
    page = "{\"lines\": []}, "
    rows = spark.range(400).selectExpr("concat('f', id, '.pdf') AS name", f"concat('[', repeat('{page}', if(id = 7, 20000, cast(id % 3 AS int))), '{{}}]') AS content")
    shares = {}
    for name, by_parts in (("flat", False), ("parts", True)):
        folder = f"file://{tmp_path}/{name}"
        rows.repartition(3).write.format("docforge_files").option("path", folder).mode("append").save()
        sinks.publish(spark, folder, by_parts)
        assert not (tmp_path / name / sinks.HELD).exists()
        shares[name] = {"path": folder, "reader": "docforge.plans.convert_queries:reader", "slice_bytes": "16384", "parts": str(by_parts).lower()}
    for noted in (True, False):
        if not noted:  # folders of another writer have no note
            for p in (tmp_path / "parts").iterdir():
                (p / sinks.HELD).unlink(missing_ok=True)
        parts = P._PageReader(shares["parts"]).partitions()
        assert 3 <= len(parts) < 60 and ".pdf" not in str([vars(p) for p in parts])
    got = {name: spark.read.format("docforge_pages").options(**o).load().groupBy("path").agg(F.count("page_no").alias("n"), F.countDistinct("page_no").alias("own")) for name, o in shares.items()}
    assert got["parts"].where("n <> own").count() == 0 == got["parts"].exceptAll(got["flat"]).count() and got["parts"].count() == 400
    large = [k for k, p in enumerate(parts) if any(r[0] == "f7.pdf" for r in P._PageReader(shares["parts"]).read(p))]
    assert len(large) > 3
