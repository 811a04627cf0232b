"""Inputs derived from the data tables, as DataFrames and as the SQL that says the same.

The tables hold plain prose, so each derivation decorates it with what the operators react to.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STARTS = (0, 3, 6, 7, 8, 9, 10, 11, 12, 14, 16, 19)
PAGE_LINES, LINE_WORDS = 30, 8
#: Up to so many characters a line can serve as a heading or an unfinished end, or as a heading in capitals; longer ones stay whole.
SHORT, CAPITALS = 60, 40
#: Bytes of text that one task takes.
PART_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(docs: DataFrame) -> DataFrame:
    """Documents by doc_id, in so many parts that a part's text doesn't grow with the table; of a small table Spark chooses their number."""
    n = math.ceil((docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / PART_BYTES)
    return docs.repartition(n, "doc_id") if n > docs.sparkSession.sparkContext.defaultParallelism else docs.repartition("doc_id")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, para_no, line_no, text, size: eight words a line, with headings, lists and broken words.

    Short lines in the places of headings and unfinished ends lose the punctuation at their end; no line loses words.
    """
    # dealt before it grows: all that follows goes by document or by page of one
    base = dealt(table(spark, sf_dir, "documents").select("doc_id", "text").where(F.col("text").rlike(r"\S")))
    # one pass over the text; cutting an array of words line by line would copy it for each
    cut = F.regexp_extract_all("text", F.lit(rf"\S++(?:\s++\S++){{0,{LINE_WORDS - 1}}}"), F.lit(0))
    rows = base.select("doc_id", F.posexplode_outer(cut).alias("ln", "raw")).select("doc_id", F.col("ln").cast("long").alias("ln"), F.regexp_replace("raw", r"\s{2,}|[\t-\r]", " ").alias("raw"))
    stem = r"'[^\\p{L}]+\\z'"
    rows = rows.withColumn("r", F.pmod(F.col("ln") + F.col("doc_id"), F.lit(20))).withColumn("page_no", F.floor(F.col("ln") / PAGE_LINES) + 1)
    rows = rows.withColumn("bare", F.when(F.col("r").isin(0, 2, 5, 6, 17), F.expr(f"if(length(raw) <= {SHORT}, regexp_replace(raw, {stem}, ''), raw)")))
    short = F.expr(f"if(length(raw) <= {CAPITALS}, upper(replace(bare, 'ß', 'ss')), raw)")
    text = (
        F.when(F.col("r").isin(0, 5, 2), F.col("bare"))
        .when(F.col("r") == 6, short)
        .when(F.col("r").isin(8, 9, 10), F.concat(F.lit("• "), "raw"))
        .when(F.col("r").isin(12, 13), F.concat(F.lit("e "), "raw"))
        .when(F.col("r") == 14, F.concat(F.lit("1. "), "raw"))
        .when(F.col("r") == 15, F.concat(F.lit("2. "), "raw"))
        .when(F.col("r").isin(3, 18), F.lower("raw"))
        .when(F.col("r") == 17, F.concat("bare", F.lit("-")))
        .when(F.col("r") == 19, F.concat(F.lit("# "), "raw"))
        .otherwise(F.col("raw"))
    )
    size = F.when(F.col("r") == 0, 13.0).when(F.col("r") == 5, 11.0).when(F.col("ln") % 29 == 28, 0.0).otherwise(10.0)
    # how many lines of a page open a paragraph follows from where it begins
    upto = lambda k: F.expr(f"({k} - pmod({k}, 20)) div 20 * {len(STARTS)}") + F.get(F.array(*[F.lit(sum(s <= r for s in STARTS)) for r in range(20)]), F.expr(f"cast(pmod({k}, 20) as int)"))
    para = upto("(ln + doc_id)") - upto(f"((page_no - 1) * {PAGE_LINES} + doc_id - 1)")
    return rows.select("doc_id", "page_no", F.coalesce(para, F.lit(0).cast("long")).alias("para_no"), F.col("ln").alias("line_no"), text.alias("text"), size.alias("size"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no of all pages that ``lines`` has, by the number of words alone."""
    words = F.regexp_count("text", F.lit(r"\S+"))
    counted = table(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S")).groupBy("doc_id").agg(F.max(words).alias("n"))
    return counted.select("doc_id", F.explode_outer(F.sequence(F.lit(1).cast("long"), F.expr(f"(n - 1) div {LINE_WORDS * PAGE_LINES} + 1"))).alias("page_no"))


LINES_SQL = f"""
fw AS (SELECT doc_id, regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+') AS w FROM documents WHERE regexp_matches(text, '\\S')),
fl AS (SELECT doc_id, w, unnest(range((len(w) - 1) // {LINE_WORDS} + 1)) AS ln FROM fw),
fr AS (SELECT doc_id, ln, array_to_string(w[ln * {LINE_WORDS} + 1:ln * {LINE_WORDS} + {LINE_WORDS}], ' ') AS raw, (ln + doc_id) % 20 AS r, ln // {PAGE_LINES} + 1 AS page_no FROM fl),
fc AS (SELECT *, CASE WHEN length(raw) <= {SHORT} THEN regexp_replace(raw, '[^\\p{{L}}]+$', '') ELSE raw END AS bare FROM fr),
lines AS (SELECT doc_id, page_no, CAST(sum(CASE WHEN r IN {STARTS} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page_no ORDER BY ln ROWS UNBOUNDED PRECEDING) AS BIGINT) AS para_no, ln AS line_no,
  CASE WHEN r IN (0, 5, 2) THEN bare WHEN r = 6 THEN CASE WHEN length(raw) <= {CAPITALS} THEN upper(replace(bare, 'ß', 'ss')) ELSE raw END WHEN r IN (8, 9, 10) THEN '• ' || raw WHEN r IN (12, 13) THEN 'e ' || raw
       WHEN r = 14 THEN '1. ' || raw WHEN r = 15 THEN '2. ' || raw WHEN r IN (3, 18) THEN lower(raw) WHEN r = 17 THEN bare || '-' WHEN r = 19 THEN '# ' || raw ELSE raw END AS text,
  CAST(CASE WHEN r = 0 THEN 13 WHEN r = 5 THEN 11 WHEN ln % 29 = 28 THEN 0 ELSE 10 END AS DOUBLE) AS size FROM fc)"""


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, text: lines with odd blanks, quotes and line ends, and no paragraph structure."""
    own = lines(spark, sf_dir)
    opens = F.pmod(F.col("line_no") + F.col("doc_id"), F.lit(20)).isin(*STARTS) & (F.col("line_no") % PAGE_LINES != 0)  # a paragraph that isn't the page's first
    end = F.when(F.col("doc_id") % 3 == 0, F.lit("\r\n")).otherwise(F.lit("\n"))
    head = F.when(F.col("line_no") % 7 == 0, F.concat(end, end)).when(opens, end).otherwise(F.lit(""))
    odd = F.element_at(F.array(F.lit("\u00a0"), F.lit("\u00ad"), F.lit("\u2019"), F.lit(""), F.lit("")), (F.col("line_no") % 5 + 1).cast("int"))
    text = F.concat(head, F.replace("text", F.lit(" a"), F.lit("  a")), odd)
    rows = own.select("doc_id", "page_no", "line_no", text.alias("t"), end.alias("e"))
    joined = rows.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "t"))).alias("x"), F.first("e").alias("e"))
    return joined.select("doc_id", "page_no", F.array_join("x.t", "\x01").alias("text"), "e").select("doc_id", "page_no", F.replace("text", F.lit("\x01"), F.col("e")).alias("text"))


RAW_PAGES_SQL = LINES_SQL + """,
rp AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN chr(13) || chr(10) ELSE chr(10) END AS e, lag(para_no, 1, para_no) OVER (PARTITION BY doc_id, page_no ORDER BY line_no) AS bp FROM lines),
raw_pages AS (SELECT doc_id, page_no, replace(string_agg(CASE WHEN line_no % 7 = 0 THEN e || e WHEN bp <> para_no THEN e ELSE '' END || replace(text, ' a', '  a') ||
  CASE line_no % 5 WHEN 0 THEN chr(160) WHEN 1 THEN chr(173) WHEN 2 THEN chr(8217) ELSE '' END, chr(1) ORDER BY line_no), chr(1), any_value(e)) AS text FROM rp GROUP BY doc_id, page_no)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, item_idx, str, transform, width, height: placed words in shuffled order."""
    own = lines(spark, sf_dir).select("doc_id", "page_no", "line_no", "size", F.posexplode(F.split("text", " ")).alias("k", "str"))
    w = Window.partitionBy("doc_id", "page_no", "line_no").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    gap = F.when(F.col("k") % 7 == 3, 0.5).otherwise(4.0)
    x = F.coalesce(F.sum(F.length("str") * 6 + gap).over(w), F.lit(0.0)) + 50
    row = F.col("line_no") % PAGE_LINES
    y = 800.0 - 12 * row - 10 * F.floor(row / 5) - F.lit(0.5) * (F.col("k") % 2)
    idx = (F.col("k") * 7919 + F.col("line_no") * 31) % 100003
    return own.select("doc_id", "page_no", idx.cast("long").alias("item_idx"), "str", F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.col("size"), x, y).alias("transform"), (F.length("str") * 6.0).alias("width"), F.lit(9.0).alias("height"))


ITEMS_SQL = LINES_SQL + f""",
iw AS (SELECT doc_id, page_no, line_no, size, unnest(string_split(text, ' ')) AS str, unnest(range(len(string_split(text, ' ')))) AS k FROM lines),
items AS (SELECT doc_id, page_no, (k * 7919 + line_no * 31) % 100003 AS item_idx, str, size,
  CAST(coalesce(sum(length(str) * 6 + CASE WHEN k % 7 = 3 THEN 0.5 ELSE 4 END) OVER (PARTITION BY doc_id, page_no, line_no ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 50 AS DOUBLE) AS x,
  CAST(800 - 12 * (line_no % {PAGE_LINES}) - 10 * ((line_no % {PAGE_LINES}) // 5) - 0.5 * (k % 2) AS DOUBLE) AS y, CAST(length(str) * 6 AS DOUBLE) AS width, 9.0::DOUBLE AS height FROM iw)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, p, r, g, b: every tenth image is nearly flat."""
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    base = F.when(F.col("l_linenumber") % 2 == 0, 40).otherwise(170)
    flat = F.col("l_suppkey") % 10 == 0
    li = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    return li.select(
        F.col("l_suppkey").alias("image_id"),
        (F.row_number().over(order) - 1).cast("long").alias("p"),
        F.when(flat, F.lit(100) + F.col("l_partkey") % 8).otherwise(base + F.col("l_partkey") % 37).cast("int").alias("r"),
        F.when(flat, F.lit(100) + F.col("l_orderkey") % 8).otherwise(base + F.col("l_orderkey") % 41).cast("int").alias("g"),
        F.when(flat, F.lit(100)).otherwise(base + F.col("l_quantity").cast("int")).cast("int").alias("b"),
    )


PIXELS_SQL = """
pixels AS (SELECT l_suppkey AS image_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) - 1 AS p,
  CAST(CASE WHEN l_suppkey % 10 = 0 THEN 100 + l_partkey % 8 ELSE (CASE WHEN l_linenumber % 2 = 0 THEN 40 ELSE 170 END) + l_partkey % 37 END AS INTEGER) AS r,
  CAST(CASE WHEN l_suppkey % 10 = 0 THEN 100 + l_orderkey % 8 ELSE (CASE WHEN l_linenumber % 2 = 0 THEN 40 ELSE 170 END) + l_orderkey % 41 END AS INTEGER) AS g,
  CAST(CASE WHEN l_suppkey % 10 = 0 THEN 100 ELSE (CASE WHEN l_linenumber % 2 = 0 THEN 40 ELSE 170 END) + trunc(l_quantity) END AS INTEGER) AS b FROM lineitem)"""


def geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """image_id, w, h, rotation, dpi, max_side, page_rotation."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(
        k.alias("image_id"), (F.col("p_size") * 37 + 200).cast("long").alias("w"), (k % 4000 + 150).alias("h"), (k % 4 * 90).alias("rotation"),
        F.element_at(F.array(*map(F.lit, (150, 220, 300, 400))), (k % 4 + 1).cast("int")).cast("long").alias("dpi"), F.when(k % 2 == 0, 4200).otherwise(3200).cast("long").alias("max_side"), (k % 3 * 90).alias("page_rotation"),
    )


GEOMETRY_SQL = """
geometry AS (SELECT p_partkey AS image_id, CAST(p_size * 37 + 200 AS BIGINT) AS w, p_partkey % 4000 + 150 AS h, p_partkey % 4 * 90 AS rotation,
  CAST([150, 220, 300, 400][p_partkey % 4 + 1] AS BIGINT) AS dpi, CAST(CASE WHEN p_partkey % 2 = 0 THEN 4200 ELSE 3200 END AS BIGINT) AS max_side, p_partkey % 3 * 90 AS page_rotation FROM part)"""

EXTENSIONS = (".pdf", ".PDF", ".jpg", ".jpeg", ".png", ".tif", ".txt", ".md", ".pnm")
TYPES = ("", "image/png", "application/pdf", "text/plain")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, name, mime, size: offered files, many of them twice."""
    b = F.col("doc_id") % 45
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        F.concat(F.lit("doc_"), b.cast("string"), F.element_at(F.array(*map(F.lit, EXTENSIONS)), (b % 9 + 1).cast("int"))).alias("name"),
        F.element_at(F.array(*map(F.lit, TYPES)), (F.col("doc_id") % 7 % 4 + 1).cast("int")).alias("mime"),
        ((F.floor(F.col("doc_id") / 45) % 3 * 700 + 300) * F.when(b % 4 == 0, 1200).otherwise(1)).cast("long").alias("size"),
    )


FILES_SQL = f"""
files AS (SELECT doc_id AS seq, 'doc_' || (doc_id % 45) || {list(EXTENSIONS)}[(doc_id % 45) % 9 + 1] AS name, {list(TYPES)}[doc_id % 7 % 4 + 1] AS mime,
  CAST(((doc_id // 45) % 3 * 700 + 300) * (CASE WHEN (doc_id % 45) % 4 = 0 THEN 1200 ELSE 1 END) AS BIGINT) AS size FROM documents)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, confidence (null: not recognised), chars, from_layer."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.row_number().over(order).cast("long").alias("page_no"),
        F.when(k % 4 != 0, (k * 37) % 101).alias("confidence"), (k % 500).alias("chars"), (k % 4 == 0).alias("from_layer"),
    )


SCORES_SQL = """
scores AS (SELECT o_custkey AS doc_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS page_no,
  CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey * 37) % 101 END AS confidence, o_orderkey % 500 AS chars, o_orderkey % 4 = 0 AS from_layer FROM orders)"""



def ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with words whose font size varies, and is unknown for every sixth."""
    words = F.transform(F.split("text", " "), lambda x, i: F.struct(F.when(i % 6 != 5, F.col("size") + i % 3).alias("font_size")))
    return lines(spark, sf_dir).select("doc_id", "page_no", "para_no", "line_no", "text", words.alias("words"))


def ocr_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, blocks: recognised lines nested in paragraphs, four of which make a block; texts hold odd blanks."""
    line = F.struct(F.when(F.col("line_no") % 11 == 10, F.lit(" \t ")).otherwise(F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \t")))).alias("text"), "words")
    rows_ = ocr_lines(spark, sf_dir).select("doc_id", "page_no", "para_no", "line_no", line.alias("line"))
    paras = rows_.groupBy("doc_id", "page_no", "para_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    paras = paras.select("doc_id", "page_no", "para_no", F.struct(F.transform("x", lambda s: s["line"]).alias("lines")).alias("p"))
    blocks = paras.groupBy("doc_id", "page_no", F.floor(F.col("para_no") / 4).alias("b")).agg(F.sort_array(F.collect_list(F.struct("para_no", "p"))).alias("x"))
    blocks = blocks.select("doc_id", "page_no", "b", F.struct(F.transform("x", lambda s: s["p"]).alias("paragraphs")).alias("block"))
    pages = blocks.groupBy("doc_id", "page_no").agg(F.sort_array(F.collect_list(F.struct("b", "block"))).alias("x"))
    return pages.select("doc_id", "page_no", F.transform("x", lambda s: s["block"]).alias("blocks"))
