"""Session helpers of the corpus operators: the shared folder, written tables and connected components."""

from __future__ import annotations

import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table ``documents`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share. Where it is unset, one is made if all tasks run in the
    driver's own process; a cluster has to name it."""
    given = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not given:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        given = "file://" + tempfile.mkdtemp(prefix="docforge-")
        spark.conf.set("spark.checkpoint.dir", given)
    return given.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """The rows of ``df`` written as Parquet to the shared folder and read back, which cuts the lineage."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` that nothing reads any more."""
    jvm = spark._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.split("://")[-1].removeprefix("file:").startswith(shared_dir(spark).split("://")[-1].removeprefix("file:")):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: The most bits of a filter of keys (8 MB), and the bits it should have for each key.
FILTER_BITS, BITS_PER_KEY = 1 << 26, 16


#: Columns of the bitmap, named so that no table has them.
BUCKET, BITS, MAY = "_docforge_bucket", "_docforge_bits", "_docforge_may"


def _marked(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """``rows`` with the column MAY: whether ``key`` may be among the values of ``wanted``, a table of one column.

    Keys are marked in a bitmap of at most FILTER_BITS, built and broadcast by Spark; with more than FILTER_BITS / 4 keys all
    rows may hold one. A null key holds none.
    """
    n = wanted.count()
    if n > FILTER_BITS // 4:
        return rows.withColumn(MAY, F.col(key).isNotNull())
    bits = min(FILTER_BITS, 1 << max(15, (BITS_PER_KEY * n).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1
    name = wanted.columns[0]
    maps = wanted.where(F.col(name).isNotNull()).groupBy(F.bitmap_bucket_number(place(F.col(name))).alias(BUCKET)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place(F.col(name)))).alias(BITS))
    at = F.bitmap_bit_position(place(F.col(key)))
    byte = F.conv(F.hex(F.substring(BITS, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.join(F.broadcast(maps), F.bitmap_bucket_number(place(F.col(key))) == F.col(BUCKET), "left")
    return met.select(*[F.col(f"`{c}`") for c in rows.columns], F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0, F.lit(False)).alias(MAY))


def holding(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The rows whose ``key`` may be among the values of ``wanted``, a table of one column, before an exact join.

    Rows without a partner are not shuffled then. All rows with a partner stay, and a few others. Rows with a null key go.
    """
    return _marked(rows, key, wanted).where(MAY).drop(MAY)


def parted(rows: DataFrame, key: str, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows that ``holding`` keeps, and all others, which have no partner for certain."""
    marked = _marked(rows, key, wanted)
    return marked.where(MAY).drop(MAY), marked.where(~F.col(MAY)).drop(MAY)


def without(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """The rows whose ``key`` is not among the values of ``gone``, a table of one column; those with a null key stay.

    Only rows that may have to go are shuffled.
    """
    maybe, others = parted(rows, key, gone)
    name = gone.columns[0]
    return others.unionByName(maybe.join(gone.withColumnRenamed(name, key), key, "left_anti").select(*rows.columns))


def components(edges: DataFrame, src: str = "a", dst: str = "b") -> DataFrame:
    """(id, component): for each id in ``edges`` the smallest id it reaches.

    Union-find within each partition first replaces its edges by a spanning star of each local tree; the
    stars are then joined across partitions by repeated small-star and large-star steps on DataFrames,
    each written to the shared folder. No edge or label reaches the driver, only a count and a digest of all edges, which tell when nothing changes.
    An empty table of edges gives an empty result.
    """
    spark = edges.sparkSession

    def contract(batches):
        import numpy as np
        import pandas as pd

        parent: dict[int, int] = {}

        def find(x):
            root = x
            while parent.setdefault(root, root) != root:
                root = parent[root]
            while parent[x] != root:
                parent[x], x = root, parent[x]
            return root

        for pdf in batches:
            for x, y in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                x, y = find(x), find(y)
                if x != y:
                    parent[max(x, y)] = min(x, y)
        ids = np.fromiter(parent, np.int64, len(parent))
        roots = np.fromiter((find(x) for x in ids.tolist()), np.int64, len(ids))
        for at in range(0, len(ids), 100_000):
            own = slice(at, at + 100_000)
            keep = ids[own] != roots[own]
            yield pd.DataFrame({"a": ids[own][keep], "b": roots[own][keep]})

    pairs = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a <> b")
    stars = written(pairs.mapInPandas(contract, "a long, b long"), "stars")
    mark = lambda t: tuple(t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = mark(stars)
    while True:
        # large star: neighbours above a node go to the smallest of its neighbourhood
        both = stars.select("a", "b").unionByName(stars.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        # small star: a node and its smaller neighbours go to the smallest of them
        down = large.where("a <> b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        joined = down.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        after = written(small.where("a <> b").distinct(), "stars")
        now = mark(after)
        forget(spark, stars)
        stars = after
        if now == seen:
            break
        seen = now
    labels = stars.groupBy("a").agg(F.min("b").alias("component"))
    return labels.select(F.col("a").alias("id"), "component").unionByName(labels.select(F.col("component").alias("id"), "component").distinct())


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of plans that are out of reach.

    A plan is within reach until Spark's listeners have seen its end, so what a first collection finds too early goes with the second.
    """
    import gc

    gc.collect()
    for _ in range(2):
        time.sleep(0.3)
        spark.sparkContext._jvm.System.gc()
