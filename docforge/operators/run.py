"""Results of a run: metrics, notes, summaries and output names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators.markdown import average_confidence

LEAST_GOOD = 70


def document_metrics(pages: DataFrame) -> DataFrame:
    """doc_id, pages, chars, confidence, from_layer over pages (doc_id, chars, confidence, from_layer)."""
    return pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("chars").alias("chars"), average_confidence(F.col("confidence")).alias("confidence"), F.bool_or("from_layer").alias("from_layer"))


def quality_note(confidence: Column) -> Column:
    return F.when(confidence < LEAST_GOOD, "is-warn").otherwise("is-ok")


def describe(pages: Column, chars: Column, confidence: Column, from_layer: Column) -> Column:
    return F.concat_ws(
        " · ", F.when(pages == 1, "1 oldal").otherwise(F.concat(pages.cast("string"), F.lit(" oldal"))), F.concat(chars.cast("string"), F.lit(" karakter")),
        F.when(confidence.isNotNull(), F.concat(F.lit("megbízhatóság: "), confidence.cast("string"), F.lit("%"))), F.when(from_layer, "beágyazott PDF-szövegből"),
    )


def run_summary(outcomes: DataFrame) -> DataFrame:
    """One row over outcomes (done, failed, cancelled): counts, and the status that counts most."""
    s = outcomes.agg(F.count_if("done").alias("succeeded"), F.count_if("failed").alias("failed"), F.coalesce(F.bool_or("cancelled"), F.lit(False)).alias("cancelled"))
    return s.withColumn("status", F.when(F.col("cancelled"), "cancelled").when(F.col("failed") > 0, "partial").when(F.col("succeeded") > 0, "done").otherwise("none"))


def output_collisions(names: DataFrame) -> DataFrame:
    """file_name and how many of names (column name) share it."""
    return names.select(T.safe_file_name(F.col("name")).alias("file_name")).groupBy("file_name").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unique_output_names(names: DataFrame) -> DataFrame:
    """Adds file_name; where several rows share one, the row's file_id follows the stem."""
    named = names.withColumn("_safe", T.safe_file_name(F.col("name")))
    shared = named.groupBy("_safe").agg((F.count(F.lit(1)) > 1).alias("_shared"))
    stem = F.regexp_replace("_safe", r"\.md\z", "")
    out = F.when(F.col("_shared"), F.concat(stem, F.lit("-"), F.col("file_id").cast("string"), F.lit(".md"))).otherwise(F.col("_safe"))
    return named.join(shared, "_safe").withColumn("file_name", out).drop("_safe", "_shared")


def edited(results: DataFrame, edits: DataFrame) -> DataFrame:
    """Results (doc_id, markdown) with the text of edits (doc_id, text) in place of the generated one."""
    return results.join(edits.withColumnRenamed("text", "_edit"), "doc_id", "left").withColumn("markdown", F.coalesce("_edit", "markdown")).drop("_edit")
