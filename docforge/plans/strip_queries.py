"""Queries of images as strips and of formats by their bytes, over images made of line items and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.operators import convert as C
from docforge.operators import raster as R
from docforge.operators import strips as S
from docforge.options import Options
from docforge.sources import binary, folders, netpbm
from docforge.sources.sinks import StagedFiles, publish

from . import fixtures as X
from . import page_queries as PQ

QUERIES, SQL = {}, {}
#: Lines and width of the strips made here.
LINES, WIDTH = 5, 24


def query(name, sql):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def _bytes(values: Column) -> Column:
    return F.unhex(F.array_join(F.transform(values, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def strips(pixels: DataFrame, *channels: str) -> DataFrame:
    """Pixels (image_id, p) as strips of LINES lines; an image's last line is as long as it is."""
    own = F.array_sort(F.collect_list(F.struct("p", *channels)))
    flat = F.flatten(F.transform(own, lambda x: F.array(*[x[c] for c in channels])))
    y = F.floor(F.col("p") / (LINES * WIDTH)) * LINES
    heights = pixels.groupBy("image_id").agg((F.floor(F.max("p") / WIDTH) + 1).alias("h"))
    made = pixels.groupBy("image_id", y.alias("y")).agg(_bytes(flat).alias("pixels"))
    return made.join(heights, "image_id").select("image_id", "y", F.lit(WIDTH).cast("long").alias("w"), "h", F.lit(len(channels)).alias("channels"), "pixels")


def whole(spark, d) -> DataFrame:
    """The pixels of all images, their last lines filled up with white."""
    p = X.pixels(spark, d)
    ends = p.groupBy("image_id").agg(F.max("p").alias("last"))
    fill = ends.select("image_id", F.explode(F.sequence("last", F.col("last") + WIDTH - 1 - F.col("last") % WIDTH)).alias("p"), "last").where("p > last")
    return p.unionByName(fill.select("image_id", "p", *[F.lit(255).alias(c) for c in ("r", "g", "b")]))


@query("strip_histogram", PQ.SQL["luma_histogram"])
def _(spark, d):
    return S.histograms(strips(X.pixels(spark, d), "r", "g", "b"))


@query("strip_enhance", PQ.SQL["enhance"])
def _(spark, d):
    return S.pixels(S.enhance(strips(X.pixels(spark, d), "r", "g", "b"), black_white=True))


@query("strip_contrast", PQ.SQL["contrast_stretch"])
def _(spark, d):
    return S.pixels(S.enhance(strips(X.pixels(spark, d), "r", "g", "b"))).select("image_id", "p", F.col("r").alias("v"))


@query("strip_turned", "WITH " + X.PIXELS_SQL + f""", hh AS (SELECT image_id, max(p) // {WIDTH} + 1 AS h FROM pixels GROUP BY image_id), cells AS (SELECT image_id, h, unnest(range(h * {WIDTH})) AS p FROM hh),
q AS (SELECT image_id, p % {WIDTH} AS x, p // {WIDTH} AS y, {WIDTH} AS w, h, image_id % 4 * 90 AS t, coalesce(r, 255) AS r, coalesce(g, 255) AS g, coalesce(b, 255) AS b FROM cells LEFT JOIN pixels USING (image_id, p)),
m AS (SELECT image_id, CASE t WHEN 90 THEN h - 1 - y WHEN 180 THEN w - 1 - x WHEN 270 THEN y ELSE x END AS x, CASE t WHEN 90 THEN x WHEN 180 THEN h - 1 - y WHEN 270 THEN w - 1 - x ELSE y END AS y, CASE WHEN t % 180 = 90 THEN h ELSE w END AS width, r, g, b FROM q)
SELECT image_id, y * width + x AS p, r, g, b FROM m""")
def _(spark, d):
    """Strips of all images turned by quarters, tiles of few columns so that each image has several."""
    return S.pixels(S.turned(strips(whole(spark, d), "r", "g", "b"), (F.col("image_id") % 4 * 90).cast("int"), 2048))


@query("strip_on_white", "WITH " + X.PIXELS_SQL + """, a AS (SELECT image_id, p, r, g, b, (p * 37 + image_id) % 256 AS a FROM pixels)
SELECT image_id, p, """ + ", ".join(f"CAST(round_even(({c} * a + 255 * (255 - a)) / 255::DOUBLE, 0) AS INTEGER) AS {c}" for c in "rgb") + " FROM a")
def _(spark, d):
    clear = X.pixels(spark, d).withColumn("a", ((F.col("p") * 37 + F.col("image_id")) % 256).cast("int"))
    return S.pixels(S.on_white(strips(clear, "r", "g", "b", "a")))


#: What an image's bytes are, by doc_id % 6: with transparency, colours, cut short, a format that no decoder here reads, text, nothing.
KINDS = 6


def images(spark, d) -> DataFrame:
    """doc_id, name, content: bytes of many kinds under names that say nothing of them."""
    k, w, h = F.col("doc_id") % KINDS, F.col("doc_id") % 5 + 1, (F.col("doc_id") % 7 + 1) * F.when(F.col("doc_id") % 50 == 1, 400).otherwise(1)
    n = F.when(k == 0, 4).otherwise(3)
    values = F.transform(F.sequence(F.lit(0).cast("long"), w * h * n - 1), lambda i: (i * 13 + F.col("doc_id") * 7) % 256)
    ascii_ = lambda *parts: F.encode(F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts]), "UTF-8")
    named = F.concat(ascii_("P7\nWIDTH ", w, "\nHEIGHT ", h, "\nDEPTH 4\nMAXVAL 255\nTUPLTYPE RGB_ALPHA\nENDHDR\n"), _bytes(values))
    plain = F.concat(ascii_("P6\n# made\n", w, " ", h, "\n255\n"), _bytes(values))
    content = F.when(k == 0, named).when(k == 1, plain).when(k == 2, F.substring(plain, F.lit(1), F.octet_length(plain) - 1)).when(k == 3, F.unhex(F.lit("49492A0008000000"))).when(k == 4, F.encode(F.coalesce("text", F.lit("")), "UTF-8"))
    return X.table(spark, d, "documents").select("doc_id", F.lit("image/png").alias("mime"), F.concat(F.lit("scan_"), F.col("doc_id").cast("string"), F.lit(".png")).alias("name"), content.alias("content"))


IMAGES = f"""WITH i AS (SELECT doc_id, doc_id % {KINDS} AS k, doc_id % 5 + 1 AS w, (doc_id % 7 + 1) * CASE WHEN doc_id % 50 = 1 THEN 400 ELSE 1 END AS h, CASE WHEN doc_id % {KINDS} = 0 THEN 4 ELSE 3 END AS n FROM documents)"""


@query("format_by_bytes", IMAGES + " SELECT doc_id, CASE WHEN k < 3 THEN 'image/x-portable-anymap' WHEN k = 3 THEN 'image/tiff' END AS format FROM i")
def _(spark, d):
    return images(spark, d).select("doc_id", binary.format_by_bytes(F.col("content")).alias("format"))


@query("prepare_bytes", IMAGES + """, v AS (SELECT doc_id, w, h, n, k, unnest(range(w * h)) AS p FROM i WHERE k < 2),
c AS (SELECT *, unnest(range(3)) AS c FROM v), x AS (SELECT *, ((p * n + c) * 13 + doc_id * 7) % 256 AS value, ((p * n + 3) * 13 + doc_id * 7) % 256 AS a FROM c),
y AS (SELECT doc_id, w, h, p, c, CASE WHEN k = 0 THEN CAST(round_even((value * a + 255 * (255 - a)) / 255::DOUBLE, 0) AS INTEGER) ELSE value END AS value FROM x),
t AS (SELECT doc_id, any_value(w) AS w, any_value(h) AS h, string_agg(printf('%02x', value), '' ORDER BY (CASE doc_id % 4 WHEN 1 THEN p % w * h + h - 1 - p // w WHEN 2 THEN w * h - 1 - p WHEN 3 THEN (w - 1 - p % w) * h + p // w ELSE p END), c) AS body FROM y GROUP BY doc_id)
SELECT i.doc_id, t.doc_id IS NOT NULL AS prepared, CASE WHEN t.doc_id IS NOT NULL THEN 'P6 ' || CASE WHEN i.doc_id % 2 = 1 THEN t.h || ' ' || t.w ELSE t.w || ' ' || t.h END || ' 255' END AS head, t.body FROM i LEFT JOIN t ON i.doc_id = t.doc_id""")
def _(spark, d):
    """Images decoded, laid on white and turned; what can't be decoded goes on as it is, whatever its name says."""
    given = images(spark, d)
    made = None
    for k in range(4):
        some = C.prepare_images(given.where(F.col("doc_id") % 4 == k), netpbm.decoder, Options(rotation=90 * k, gray=False, contrast=False, upscale=False))
        made = some if made is None else made.unionByName(some)
    met = made.join(given.select("doc_id", F.col("content").alias("before")), "doc_id")
    prepared = ~F.col("content").eqNullSafe(F.col("before"))
    head = F.decode(F.substring_index(F.decode(F.substring("content", 1, 20), "ISO-8859-1"), "\n", 1).cast("binary"), "UTF-8")
    size = F.length(head) + 2
    body = F.lower(F.hex(F.substring("content", size, F.octet_length("content"))))
    return met.select("doc_id", prepared.alias("prepared"), F.when(prepared, head).alias("head"), F.when(prepared, body).alias("body"))


@query("strip_files", IMAGES + """, v AS (SELECT doc_id, w, h, n, unnest(range(w * h)) AS p FROM i WHERE k < 2)
SELECT 'scan_' || doc_id || '.pnm' AS name, p, NULL AS error, """ + ", ".join(f"CAST(((p * n + {c}) * 13 + doc_id * 7) % 256 AS INTEGER) AS {x}" for c, x in enumerate("rgb")) + """ FROM v
UNION ALL SELECT 'scan_' || doc_id || '.pnm', NULL, CASE WHEN k = 2 THEN 'the pixels end early' ELSE 'no binary pixmap' END, NULL, NULL, NULL FROM i WHERE k >= 2""")
def _(spark, d):
    """Images as files, read as strips, each file by several tasks that seek to their own lines."""
    folder = folders.scratch(spark, "images")
    for source in (StagedFiles, netpbm.StripSource):
        spark.dataSource.register(source)
    given = images(spark, d).select(F.regexp_replace("name", "png", "pnm").alias("name"), F.coalesce("content", F.lit("").cast("binary")).alias("content"))
    given.write.format("docforge_files").option("path", folder).mode("append").save()
    publish(spark, folder)
    read = spark.read.format("docforge_strips").option("path", folder).option("slice_bytes", 32768).option("strip_bytes", 512).load()
    seen = S.pixels(read.where("error IS NULL").withColumnRenamed("path", "image_id")).select(F.col("image_id").alias("name"), "p", F.lit(None).cast("string").alias("error"), "r", "g", "b")
    failed = read.where("error IS NOT NULL").select(F.col("path").alias("name"), F.lit(None).cast("long").alias("p"), "error", *[F.lit(None).cast("int").alias(c) for c in ("r", "g", "b")])
    return seen.unionByName(failed)
