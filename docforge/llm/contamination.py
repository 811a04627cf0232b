"""Benchmark decontamination: MinHash containment search over size classes, with exact verification.

DataFrame functions only: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, holding, without, written

WIDTH = 5
PERCENT = 75
#: The most MinHash values drawn from an item; with fewer shingles, as many as make a miss impossible.
DRAWS = 24
#: Drawn values are broadcast only up to so many rows (16 bytes each).
BROADCAST_ROWS = 200_000
#: What separates words.
BLANKS = " \t\n\x0b\x0c\r"


def words(text: str) -> Column:
    """The lower-cased words of a text column; empty for null."""
    low = F.btrim(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(BLANKS))
    return F.when(low == "", F.array().cast("array<string>")).otherwise(F.split(low, r"[\x20\x09-\x0D]+"))


def shingle_keys(parts: Column, width: int = WIDTH) -> Column:
    """64-bit keys of all shingles; of the whole sequence if it is shorter, none if it is empty."""
    n = F.size(parts)
    full = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.xxhash64(*[F.element_at(parts, (i + k).cast("int")) for k in range(width)]))
    return F.when(n >= width, full).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", parts)))).otherwise(F.array().cast("array<bigint>"))


def shingle_texts(parts: Column, width: int = WIDTH) -> Column:
    """The distinct shingles themselves."""
    n = F.size(parts)
    full = F.transform(F.sequence(F.lit(1), n - width + 1), lambda i: F.array_join(F.slice(parts, i.cast("int"), F.lit(width)), " "))
    return F.array_distinct(F.when(n >= width, full).when(n > 0, F.array(F.array_join(parts, " "))).otherwise(F.array().cast("array<string>")))


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT, draws: int = DRAWS, width: int = WIDTH) -> DataFrame:
    """doc_id, item_id, n_item, n_shared for each item of whose distinct shingles a text holds ``percent`` or more.

    Items are put in classes by the number of shingles, as powers of two. From an item of n come min(n - need + 1,
    draws) MinHash values, where need shingles must be shared: with all n - need + 1 drawn a text that
    contains the item shares one for certain, and otherwise misses all with probability 0.25 ** draws.
    The search is partitioned by these classes: a text's shingles meet the drawn values of the classes whose smallest item it
    is long enough to hold, and no others; each (text, item) so found is checked on the distinct shingles as text. Values
    drawn are broadcast when there are few (checked), else a bitmap of them thins the texts' shingles before a
    join by shuffle. Texts with equal ids count each by itself; null ids and null or empty texts hold nothing; an item without
    words is in no text.
    """
    spark = docs.sparkSession
    sets = items.where("item_id is not null").select("item_id", words("text").alias("w")).select("item_id", shingle_texts(F.col("w"), width).alias("item_set"), F.array_distinct(shingle_keys(F.col("w"), width)).alias("keys")).where("size(keys) > 0")
    sets = sets.withColumn("n_item", F.size("item_set").cast("long")).withColumn("size_class", F.ceil(F.log2(F.col("n_item").cast("double"))))
    need = F.ceil(F.col("n_item") * percent / F.lit(100))
    drawn = F.slice(F.transform(F.array_sort(F.transform("keys", lambda k: F.struct(F.xxhash64(k, F.col("size_class")).alias("order"), k.alias("key")))), lambda s: s["key"]), F.lit(1), F.least(F.col("n_item") - need + 1, F.lit(draws)).cast("int"))
    sets = written(sets.withColumn("drawn", drawn).drop("keys"), "items")
    # the shingles that the smallest item of a class asks for
    least = F.ceil((F.floor(F.pow(F.lit(2.0), F.col("size_class") - 1)) + 1) * percent / F.lit(100)).cast("int")
    values = sets.select(F.explode("drawn").alias("key"), "item_id", least.alias("class_need"))
    lookup = values.groupBy("key").agg(F.min("class_need").alias("least_need"))
    few = lookup.count() <= BROADCAST_ROWS
    own = docs.where("doc_id is not null").select("doc_id", words("text").alias("w")).select("doc_id", F.array_distinct(shingle_keys(F.col("w"), width)).alias("keys"))
    own = own.select("doc_id", F.size("keys").alias("n_doc"), F.explode_outer("keys").alias("key"))  # plain explode would repeat its argument in a filter
    own = own.join(F.broadcast(lookup), "key") if few else holding(own, "key", lookup.select("key")).join(lookup, "key")
    hits = own.where("n_doc >= least_need").join(values, "key").where("n_doc >= class_need").select("doc_id", "item_id").distinct()
    hits = written(hits, "suspects")
    ids = hits.groupBy("doc_id").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    texts = holding(docs.select("doc_id", "text"), "doc_id", hits.select("doc_id").distinct()).join(ids, "doc_id").select("doc_id", "item_ids", words("text").alias("w")).select("doc_id", shingle_texts(F.col("w"), width).alias("doc_set"), F.explode_outer("item_ids").alias("item_id"))
    both = texts.join(sets.select("item_id", "item_set", "n_item"), "item_id")
    checked = both.select("doc_id", "item_id", "n_item", F.size(F.array_intersect("item_set", "doc_set")).cast("long").alias("n_shared"))
    return checked.where(F.col("n_shared") * 100 >= F.col("n_item") * percent)


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The table without the rows whose text holds an item; rows with a null id stay."""
    bad = written(contained_items(docs, items, percent).select("doc_id").distinct(), "leaks")
    return without(docs, "doc_id", bad)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contained_items(documents(spark, sf_dir).select("doc_id", "text"), items.select("item_id", "text"))


OP9_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents WHERE doc_id IS NOT NULL),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark WHERE item_id IS NOT NULL),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
its AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*) AS n_shared FROM ds JOIN its USING (s) JOIN n USING (item_id)
GROUP BY doc_id, item_id, n_item HAVING count(*) * 100 >= n_item * 75
"""
