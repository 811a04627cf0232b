"""Lines to blocks: headings apart, broken paragraphs joined, scattered lists gathered.

All three passes look one line back only, so each is a lag and a running count. Every window is keyed by
(doc_id, page_no) or a superset of it: one shuffle serves them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.options import Options

PAGE = ("doc_id", "page_no")
BIG, HUGE, BIG_CHARS = 1.08, 1.22, 80


def whole() -> WindowSpec:
    return Window.partitionBy(*PAGE)


def order() -> WindowSpec:
    return whole().orderBy("line_no")


def so_far() -> WindowSpec:
    return order().rowsBetween(Window.unboundedPreceding, 0)


def upper_median(values: Column) -> Column:
    """The element at half of the sorted array, upwards; 0 for none."""
    return F.coalesce(F.get(F.array_sort(values), F.floor(F.size(values) / 2).cast("int")), F.lit(0.0))


def upper_median_by(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``upper_median`` of each key's values, from counts of equal values and their running sum, so that no key is one array."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    run = counted.withColumn("_upto", F.sum("_n").over(Window.partitionBy("_key").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)))
    half = rows.groupBy(key).agg(F.floor(F.count(value) / 2).alias("_half"))
    met = F.col(key).eqNullSafe(F.col("_key")) & (F.col("_upto") > F.col("_half")) & (F.col("_upto") - F.col("_n") <= F.col("_half"))
    return half.join(run, met, "left").select(key, F.coalesce("_value", F.lit(0.0)).alias(name))


def with_base(lines: DataFrame) -> DataFrame:
    """Adds base, the page's median size over lines of known size: of two in the middle the upper, so counted from the largest."""
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY if(size > 0, size, NULL) DESC) OVER (PARTITION BY " + ", ".join(PAGE) + ")")
    return lines.withColumn("base", F.coalesce(median, F.lit(0.0)))


def is_big() -> Column:
    return (F.col("base") > 0) & (F.col("size") >= F.col("base") * BIG) & (T.utf16_length(F.col("text")) <= BIG_CHARS) & ~F.col("text").rlike(r"[.!?,;]\z")


def with_split(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds heading (0, 2 or 3) and block_no: a paragraph's lines, with each big line alone."""
    big = is_big() if options.headings else F.lit(False)
    # the line before comes first, so that the sort by line serves the page's base too
    df = with_base(lines.withColumn("_para", F.lag("para_no").over(order())))
    df = df.withColumn("big", big).withColumn("heading", F.when(~F.col("big"), 0).when(F.col("size") >= F.col("base") * HUGE, 2).otherwise(3))
    starts = F.col("big") | F.coalesce(F.lag("big").over(order()), F.lit(True)) | ~F.col("_para").eqNullSafe(F.col("para_no"))
    return df.withColumn("starts", starts).withColumn("block_no", F.sum(F.col("starts").cast("int")).over(so_far())).drop("_para")


def with_merge(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds merged_no: a block that carries on an unfinished one is joined to it."""
    df = with_split(lines, options)
    before, level = F.lag("text").over(order()), F.lag("heading").over(order())
    carries = (level == 0) & (F.col("heading") == 0) & T.leading_marker(F.col("text")).isNull() & T.continues(F.col("text"))
    df = df.withColumn("_before", before).withColumn("_carries", F.coalesce(carries, F.lit(False)))
    joins = F.col("_carries") & T.looks_unfinished(F.col("_before"))
    df = df.withColumn("opens", F.col("starts") & ~F.coalesce(joins, F.lit(False)))
    return df.withColumn("merged_no", F.sum(F.col("opens").cast("int")).over(so_far())).drop("_before", "_carries")


def with_groups(lines: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds marker (of a block whose every line has one) and group_no: list blocks of one mark are gathered."""
    df = with_merge(lines, options)
    if not options.lists:
        return df.withColumn("marker", F.lit(None).cast("string")).withColumn("group_no", F.col("merged_no"))
    df = df.withColumn("_mark", T.leading_marker(F.col("text")))
    # merged_no never falls from line to line, so that one sort serves the blocks and the page
    own = Window.partitionBy(*PAGE, "merged_no").orderBy("line_no").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    along = whole().orderBy("merged_no", "line_no")
    every = F.min((F.col("_mark").isNotNull() & (F.col("heading") == 0)).cast("int")).over(own) == 1
    df = df.withColumn("marker", F.when(every, F.first("_mark").over(own)))
    same = F.coalesce(F.col("marker") == F.lag("marker").over(along), F.lit(False))
    run = along.rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("group_no", F.sum((F.col("opens") & ~same).cast("int")).over(run)).drop("_mark")


def regroup(lines: DataFrame, options: Options = Options(), carry: tuple[str, ...] = (), clean: bool = False) -> DataFrame:
    """doc_id, page_no, block_no, heading, marker, lines (in order) of a page's blocks; columns of a page in ``carry`` stay.

    With ``clean`` the lines are normalised, each as a row, and those without text left out.
    """
    df, line = with_groups(lines, options), F.struct("line_no", "text")
    if clean:
        df, line = df.withColumn("text", T.normalize_line(F.col("text"))), F.when(F.col("text") != "", line)
    grouped = df.groupBy(*PAGE, F.col("group_no").alias("block_no"))
    out = grouped.agg(F.sort_array(F.collect_list(line)).alias("x"), F.min(F.struct("line_no", "heading", "marker")).alias("f"), *[F.first(c).alias(c) for c in carry])
    return out.select(*PAGE, *carry, "block_no", "f.heading", "f.marker", F.col("x.text").alias("lines"))


def with_misread(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds misread: of the leading characters that may be misread marks, the first that two lines and half of all share.

    The characters are a column of their own, so that no rule is matched again for each vote.
    """
    df = df.withColumn("_marks", F.filter(F.transform(lines, T.suspicious), lambda c: c != ""))
    votes = lambda c: F.size(F.filter("_marks", lambda x: x == c))
    fit = F.filter(F.array_distinct("_marks"), lambda c: (votes(c) >= 2) & (votes(c) * 2 >= F.size(lines)))
    return df.withColumn("misread", F.get(fit, F.lit(0))).drop("_marks")
