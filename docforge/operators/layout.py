"""Placed text items to rows and paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators.blocks import upper_median

SAME_ROW, LEAST_SPACE, PARAGRAPH_GAP = 2, 1, 1.4
PAGE = ("doc_id", "page_no")


def usable_items(items: DataFrame) -> DataFrame:
    """doc_id, page_no, item_idx, str, x, y, width, size of items that hold text; a size of 0 is unknown."""
    known = lambda c: F.when(F.isnan(c) | (c == 0), None).otherwise(c)
    t = F.col("transform")
    return items.where("length(str) > 0").select(
        *PAGE, "item_idx", "str", F.get(t, F.lit(4)).alias("x"), F.get(t, F.lit(5)).alias("y"), F.coalesce("width", F.lit(0.0)).alias("width"),
        F.coalesce(known(F.abs(F.get(t, F.lit(3)))), known(F.col("height")), F.lit(0.0)).alias("size"),
    )


def with_bands(items: DataFrame) -> DataFrame:
    """Adds band: items go top down; one further than two points from the first of its row opens the next.

    A page is folded in one pass that carries the row's first height, since comparing with the item before would let
    a row drift. Pages are the unit, so the array is bounded by a page.
    """
    down = F.sort_array(F.collect_list(F.struct((-F.col("y")).alias("ny"), "x", "item_idx", "str", "y", "width", "size")))
    pages = items.groupBy(*PAGE).agg(down.alias("a"))
    start = F.struct(F.lit(0).alias("band"), F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("bands"))

    def step(s, i):
        opens = s["anchor"].isNull() | (F.abs(i["y"] - s["anchor"]) > SAME_ROW)
        band = F.when(opens, s["band"] + 1).otherwise(s["band"])
        return F.struct(band.alias("band"), F.when(opens, i["y"]).otherwise(s["anchor"]).alias("anchor"), F.array_append(s["bands"], band).alias("bands"))

    banded = pages.select(*PAGE, "a", F.aggregate("a", start, step)["bands"].alias("b"))
    return banded.select(*PAGE, F.explode_outer(F.arrays_zip("a", "b")).alias("z")).select(*PAGE, "z.a.item_idx", "z.a.str", "z.a.x", "z.a.y", "z.a.width", "z.a.size", F.col("z.b").alias("band"))


def rows(items: DataFrame) -> DataFrame:
    """doc_id, page_no, row_no, y, text, size: items of a row from left to right, spaced where they stand apart."""
    own = Window.partitionBy(*PAGE, "band").orderBy("x", "item_idx")
    end, before = F.lag(F.col("x") + F.col("width")).over(own), F.lag("str").over(own)
    space = F.coalesce((F.col("x") - end > LEAST_SPACE) & ~before.rlike(f"[{T.WS}]\\z"), F.lit(False))
    placed = with_bands(usable_items(items)).withColumn("piece", F.concat(F.when(space, " ").otherwise(""), "str"))
    g = placed.groupBy(*PAGE, "band").agg(F.sort_array(F.collect_list(F.struct("x", "item_idx", "piece", "y"))).alias("a"), upper_median(F.collect_list(F.when(F.col("size") > 0, F.col("size")))).alias("size"))
    g = g.select(*PAGE, "band", F.get("a", F.lit(0))["y"].alias("y"), T.squeeze(F.array_join(F.transform("a", lambda s: s["piece"]), "")).alias("text"), "size").where("text <> ''")
    return g.select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("band")).cast("long").alias("row_no"), "y", "text", "size")


def with_gaps(rows_: DataFrame) -> DataFrame:
    """Adds gap to the row above and typical, the page's median gap (0 for one row)."""
    page = Window.partitionBy(*PAGE)
    gapped = rows_.withColumn("gap", F.lag("y").over(page.orderBy("row_no")) - F.col("y"))
    return gapped.withColumn("typical", upper_median(F.collect_list("gap").over(page)))


def paragraphs(rows_: DataFrame) -> DataFrame:
    """Adds para_no: a gap well over the typical one opens a paragraph."""
    opens = F.coalesce((F.col("typical") > 0) & (F.col("gap") > F.col("typical") * PARAGRAPH_GAP), F.lit(False)).cast("int")
    run = Window.partitionBy(*PAGE).orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    return with_gaps(rows_).withColumn("para_no", F.sum(opens).over(run))


def lines(items: DataFrame) -> DataFrame:
    """The lines (doc_id, page_no, para_no, line_no, text, size) that the block builders take."""
    return paragraphs(rows(items)).select(*PAGE, "para_no", F.col("row_no").alias("line_no"), "text", "size")


def text_layer(pages: DataFrame, least: int = 40) -> tuple[DataFrame, DataFrame]:
    """(pages whose layer (column text) is enough, pages left for recognition): split before any Python runs."""
    seen = pages.withColumn("visible", T.visible_length(F.coalesce("text", F.lit(""))))
    return seen.where(F.col("visible") >= least), seen.where(F.col("visible") < least)
