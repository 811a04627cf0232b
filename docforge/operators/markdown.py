"""Blocks to Markdown, pages to documents, documents to one text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import blocks as B
from docforge.options import Options

EMPTY_PAGE = "*(Ezen az oldalon nem sikerült szöveget felismerni.)*"
TOOL = "docforge"
#: What stands between combined documents, and the most bytes of a row's text.
RULE, MOST_BYTES = b"\n\n---\n\n", (1 << 31) - 64


def list_text(lines: Column, misread: Column, hyphen: bool = True) -> Column:
    """The lines as Markdown list items; a line without a mark goes on with the item before it."""

    def step(out: Column, line: Column) -> Column:
        own = line.rlike(f"^[{T.BULLETS}][{T.WS}]+[^{T.WS}]") | F.coalesce(line.startswith(F.concat(misread, F.lit(" "))), F.lit(False))
        number = T.numbered(line)
        start = F.when(out == "", F.lit("")).otherwise(F.lit("\n"))
        item = F.concat(out, start, F.lit("- "), T.trim(F.regexp_replace(line, f"^[^{T.WS}][{T.WS}]+", "")))
        counted = F.concat(out, start, number, F.lit(". "), T.trim(F.regexp_replace(line, f"^[0-9]{{1,3}}[.)][{T.WS}]+", "")))
        return F.when(own, item).when(number != "", counted).when(out != "", T.glue(out, line, True, hyphen)).otherwise(F.concat(F.lit("- "), line))

    return F.aggregate(lines, F.lit(""), step)


def marked_lines(lines: Column, misread: Column) -> Column:
    """How many lines carry a mark or a number."""
    return F.size(F.filter(lines, lambda x: (T.bullet(x) != "") | (T.numbered(x) != "") | F.coalesce(x.startswith(F.concat(misread, F.lit(" "))), F.lit(False))))


def with_markdown(df: DataFrame, options: Options = Options(), shift: Column | int = 0) -> DataFrame:
    """Adds markdown to rows with lines (trimmed, none empty) and heading; '' for no lines. ``shift`` deepens size headings."""
    shift = F.lit(shift) if isinstance(shift, int) else shift
    lines = F.col("lines")
    n = F.size(lines)
    df = B.with_misread(df) if options.lists else df.withColumn("misread", F.lit(None).cast("string"))
    df = df.withColumn("_marked", marked_lines(lines, F.col("misread")))
    out = F.when(n == 0, F.lit("")).when(F.col("heading") > 0, F.concat(F.repeat(F.lit("#"), F.least(F.lit(6), F.col("heading") + shift)), F.lit(" "), F.array_join(lines, " ")))
    if options.lists:
        out = out.when((F.col("_marked") >= 2) & (F.col("_marked") * 2 >= n), list_text(lines, F.col("misread"), options.hyphen))
    if options.headings:
        out = out.when((n == 1) & T.looks_like_heading(F.get(lines, F.lit(0))), F.concat(F.lit("### "), F.get(lines, F.lit(0))))
    return df.withColumn("markdown", out.otherwise(T.escape_block_start(T.join_lines(lines, options.join, options.hyphen)))).drop("misread", "_marked")


def page_lines(text: Column) -> Column:
    """para_no, text, size of the lines of a page's text without structure, as an array in order: paragraphs at empty lines, sizes unknown."""
    # the lines are trimmed already, and their places in the array number them
    own = lambda p, k: F.transform(F.filter(F.split(p, "\n", -1), lambda x: x != ""), lambda x: F.struct(k.cast("long").alias("para_no"), x.alias("text"), F.lit(0.0).alias("size")))
    return F.flatten(F.transform(F.split(T.normalize_raw(F.coalesce(text, F.lit(""))), r"\n{2,}", -1), own))


def fallback_lines(pages: DataFrame) -> DataFrame:
    """Lines of pages (doc_id, page_no, text) without structure: paragraphs at empty lines, sizes unknown."""
    rows = pages.select("doc_id", "page_no", F.posexplode_outer(page_lines(F.col("text"))).alias("line_no", "x")).where("line_no IS NOT NULL")
    return rows.select("doc_id", "page_no", "x.para_no", F.col("line_no").cast("long").alias("line_no"), "x.text", "x.size")


def made_blocks(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """The blocks of pages given as lines, with markdown where there is any; a column shift of the lines deepens size headings."""
    carry = ("shift",) if "shift" in lines.columns else ()
    shift = F.col("shift") if carry else 0
    # blocks without lines are those without markdown; asked for it, Spark would make each block's markdown twice
    return with_markdown(B.regroup(lines, options, carry, clean=True).where(F.size("lines") > 0), options, shift)


def page_markdown(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """doc_id, page_no, markdown of pages given as lines; a column shift of the lines deepens size headings."""
    joined = made_blocks(lines, options).groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("block_no", "markdown"))).alias("x"))
    return joined.select("doc_id", "page_no", F.array_join("x.markdown", "\n\n").alias("markdown"))


def average_confidence(c: Column) -> Column:
    """The mean of known scores, halves upwards; null if none is known."""
    return F.floor(F.avg(c) + 0.5).cast("long")


def front_matter(title: Column, source: Column, pages: Column, lang: str, confidence: Column, at: Column) -> Column:
    return F.concat_ws(
        "\n", F.lit("---"), F.concat(F.lit("cim: "), T.yaml_string(title)), F.concat(F.lit("forras: "), T.yaml_string(source)), F.concat(F.lit("oldalak: "), pages.cast("string")),
        F.lit(f'nyelv: "{lang}"'), F.concat(F.lit("megbizhatosag: "), F.coalesce(confidence.cast("string"), F.lit("null"))),
        F.concat(F.lit('letrehozva: "'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"')), F.lit(f'eszkoz: "{TOOL}"'), F.lit("---"),
    )


def meta_line(source: Column, pages: Column, lang: str, confidence: Column, from_layer: Column, at: Column) -> Column:
    parts = F.concat_ws(
        " · ", F.concat(F.lit("Forrás: `"), source, F.lit("`")), F.when(pages == 1, "1 oldal").otherwise(F.concat(pages.cast("string"), F.lit(" oldal"))), F.concat(F.lit("Nyelv: "), T.describe_lang(F.lit(lang))),
        F.when(confidence.isNotNull(), F.concat(F.lit("átlagos megbízhatóság: "), confidence.cast("string"), F.lit("%"))), F.when(from_layer, "részben a PDF beágyazott szövegéből"), F.concat(F.lit("felismerve: "), T.format_datetime(at)),
    )
    return F.concat(F.lit("*"), parts, F.lit("*"))


def build_documents(pages: DataFrame, lines: DataFrame, at: Column, options: Options = Options()) -> DataFrame:
    """doc_id, markdown of each document of ``pages`` (doc_id, page_no, name, confidence, from_layer).

    Lines are grouped by page, pages by document, and meet the document's head as one row; lines that are dealt by doc_id beforehand are not
    shuffled again. A page without lines says so; lines of pages that aren't there are left out. A document without pages is
    given by one row whose page_no is null, and has a head only.
    """
    heads = pages.groupBy("doc_id").agg(F.first("name").alias("name"), F.count("page_no").alias("n"), average_confidence(F.col("confidence")).alias("c"), F.bool_or("from_layer").alias("layer"), F.sort_array(F.collect_list("page_no")).alias("numbers"))
    blocks = made_blocks(lines, options)
    # whether a size heading goes a level deeper in a document of several pages is known at its head only
    block = F.struct("block_no", "markdown", ((F.size("lines") > 0) & F.col("heading").between(1, 5)).alias("deeper"))
    by_page = blocks.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(block)).alias("blocks"))
    made = by_page.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("page_no", "blocks"))).alias("x"))
    marks = (F.col("n") > 1) & F.lit(options.page_marks)
    text_of = lambda p: F.array_join(F.transform(p["blocks"], lambda b: F.concat(F.when(marks & b["deeper"], "#").otherwise(""), b["markdown"])), "\n\n")
    # the small heads are hashed part by part; without a hint whole documents may be broadcast, and rendered by the few tasks that heads fill
    body = heads.hint("shuffle_hash").join(made, "doc_id", "left")
    known = F.map_from_arrays(F.transform("x", lambda p: p["page_no"]), F.transform("x", text_of))
    every = F.transform("numbers", lambda k: F.struct(k.alias("page_no"), F.coalesce(F.try_element_at("known", k), F.lit(EMPTY_PAGE)).alias("md")))
    whole = F.transform("x", lambda p: F.struct(p["page_no"].alias("page_no"), text_of(p).alias("md")))  # all pages have blocks, as most documents' do
    same = F.coalesce(F.transform("x", lambda p: p["page_no"]) == F.col("numbers"), F.lit(False))
    body = body.withColumn("known", F.when(~same, F.coalesce(known, F.map_from_arrays(F.array().cast("array<long>"), F.array().cast("array<string>"))))).withColumn("x", F.when(same, whole).otherwise(every))
    numbered = F.transform("x", lambda s: F.concat(F.lit("## "), s["page_no"].cast("string"), F.lit(". oldal\n\n"), s["md"]))
    text = F.array_join(F.when(marks, numbered).otherwise(F.transform("x", lambda s: s["md"])), "\n\n")
    title = T.base_name(F.col("name"))
    parts = [F.concat(F.lit("# "), title), meta_line(F.col("name"), F.col("n"), options.lang, F.col("c"), F.col("layer"), at), F.when(F.size("numbers") > 0, text)]
    if options.front_matter:
        parts.insert(0, front_matter(title, F.col("name"), F.col("n"), options.lang, F.col("c"), at))
    return body.select("doc_id", F.concat(F.concat_ws("\n\n", *parts), F.lit("\n")).alias("markdown"))


def combine(documents: DataFrame, order: str = "doc_id", most: int = MOST_BYTES) -> DataFrame:
    """One row: all documents in order, set apart by rules; null for none. ``combined_pieces`` has no row that grows with the table.

    The row is bounded by 2 GB, as any text of Spark's, and one task makes it: documents come to it sorted, which spills, and are appended outside the
    JVM's heap, so that the heap holds the row and no list of the documents or other form of their text beside it.
    """
    texts = documents.select(order, T.trim(F.col("markdown")).alias("t")).where("t IS NOT NULL")
    # a row without text, so that there is a task where there are no documents
    none = documents.sparkSession.range(1).select(F.lit(None).cast(texts.schema[order].dataType).alias(order), F.lit(None).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]):
        whole, met = bytearray(), False
        for batch in batches:
            for text in batch.column(0):
                if text.is_valid:
                    if met:
                        whole += RULE
                    whole += text.as_buffer()
                    met = True
            if len(whole) >= most:
                raise ValueError(f"the combined text exceeds {most} bytes, the most that a row can hold; write_combined writes it as files")
        whole += b"\n"
        ends = pa.py_buffer(np.array([0, len(whole)], np.int32))
        yield pa.RecordBatch.from_arrays([pa.StringArray.from_buffers(1, ends, pa.py_buffer(whole)) if met else pa.nulls(1, pa.string())], ["markdown"])

    return texts.unionByName(none).repartition(1).sortWithinPartitions(order, "t").select("t").mapInArrow(run, "markdown string")


def combined_pieces(documents: DataFrame, order: str = "doc_id") -> DataFrame:
    """One row a document, sorted by order over all partitions; the rows' texts, each ended by a line feed, are the combined text."""
    texts = documents.select(F.struct(order, T.trim(F.col("markdown")).alias("t")).alias("x")).where("x.t IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    copies = texts.select("x", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy"))
    first = texts.agg(F.min("x").alias("first"))
    ruled = F.when(F.col("x").eqNullSafe(F.col("first")) & (F.col("copy") == 1), F.col("x.t")).otherwise(F.concat(F.lit("\n---\n\n"), "x.t"))
    return copies.crossJoin(F.broadcast(first)).orderBy("x", "copy").select(ruled.alias("markdown"))
