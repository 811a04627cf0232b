"""Offered files: kinds, admission, duplicates, ids, names and types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IMAGE_EXTENSIONS = r"(?i)\.(jpe?g|png|webp|bmp|gif|tiff?|pnm)\z"
# Types by extension, of the page server and of the device.
SERVER_TYPES = {
    "html": "text/html; charset=utf-8", "css": "text/css; charset=utf-8", "js": "text/javascript; charset=utf-8", "mjs": "text/javascript; charset=utf-8",
    "json": "application/json; charset=utf-8", "md": "text/markdown; charset=utf-8", "wasm": "application/wasm", "gz": "application/gzip", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "svg": "image/svg+xml", "ico": "image/x-icon", "txt": "text/plain; charset=utf-8",
}
DEVICE_TYPES = {
    "html": "text/html", "css": "text/css", "js": "text/javascript", "mjs": "text/javascript", "json": "application/json", "wasm": "application/wasm", "gz": "application/gzip",
    "traineddata": "application/octet-stream", "bcmap": "application/octet-stream", "pfb": "application/octet-stream", "ttf": "font/ttf", "png": "image/png",
    "jpg": "image/jpeg", "jpeg": "image/jpeg", "svg": "image/svg+xml", "ico": "image/x-icon", "md": "text/markdown", "txt": "text/plain",
}
UNKNOWN_TYPE = "application/octet-stream"
# End of the fixed values.
ID_BLOCK = 1 << 16


def is_pdf(mime: str = "mime", name: str = "name") -> Column:
    return (F.col(mime) == "application/pdf") | F.col(name).rlike(r"(?i)\.pdf\z")


def is_image(mime: str = "mime", name: str = "name") -> Column:
    return F.col(mime).startswith("image/") | F.col(name).rlike(IMAGE_EXTENSIONS)


def classify(files: DataFrame) -> DataFrame:
    """Adds kind: pdf before image, null for what is neither."""
    return files.withColumn("kind", F.when(is_pdf(), "pdf").when(is_image(), "image"))


def admit(files: DataFrame) -> DataFrame:
    return classify(files).where("kind is not null")


def deduplicate(files: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """Of files with one name and size the first by seq, unless it is already present; unknown names or sizes equal each other."""
    first = files.groupBy("name", "size").agg(F.min("seq").alias("seq"))

    def kept_by(left: DataFrame, right: DataFrame, columns: tuple[str, ...], how: str) -> DataFrame:
        same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in columns]
        return left.alias("l").join(right.select(*columns).alias("r"), same, how)

    kept = kept_by(files, first, ("name", "size", "seq"), "left_semi")
    return kept if present is None else kept_by(kept, present, ("name", "size"), "left_anti")


def with_ids(files: DataFrame) -> DataFrame:
    """Adds file_id, dense from 1 by seq, numbered in blocks so that no task holds all rows."""
    blocked = files.withColumn("_block", F.floor(F.col("seq") / ID_BLOCK))
    counts = blocked.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("_block").orderBy("seq"))
    return blocked.join(before.select("_block", "_before"), "_block").withColumn("file_id", F.col("_before") + own).drop("_block", "_before")


def admission_summary(files: DataFrame) -> DataFrame:
    """One row: how many files were added and skipped, and what is said about it."""
    offered = files.agg(F.count(F.lit(1)).alias("n"))
    added = deduplicate(admit(files)).agg(F.count(F.lit(1)).alias("added"))
    both = offered.join(F.broadcast(added)).select("added", (F.col("n") - F.col("added")).alias("skipped"))  # one row each
    return both.withColumn("message", F.when(F.col("skipped") > 0, "skipped").when(F.col("added") > 0, "added").otherwise("none"))


def name_clipboard(items: DataFrame) -> DataFrame:
    """Items without a telling name get vagolap-<n>.<ext>, counted in order of seq."""
    generic = F.coalesce((F.col("name") == "") | F.col("name").rlike(r"(?i)^(image|kép)\.[A-Za-z0-9_]+\z"), F.lit(True))
    some = with_ids(items.where(generic)).select("seq", F.col("file_id").alias("n"))
    mime = F.when(F.coalesce("mime", F.lit("")) == "", "image/png").otherwise(F.col("mime"))
    kind = F.coalesce(F.nullif(F.split_part(mime, F.lit("/"), F.lit(2)), F.lit("")), F.lit("png"))
    named = F.concat(F.lit("vagolap-"), F.col("n").cast("string"), F.lit("."), F.regexp_replace(kind, "^(.*?)jpeg", "$1jpg"))
    return items.join(some, "seq", "left").withColumn("new_name", F.when(F.col("n").isNull(), F.col("name")).otherwise(named)).drop("n")


def chosen_uris(replies: DataFrame) -> DataFrame:
    """Adds uris: those of a list without nulls, else the single one, else the camera's, else none."""
    listed = F.filter("listed", lambda u: u.isNotNull())
    pick = F.when(F.col("listed").isNotNull(), listed).when(F.col("single").isNotNull(), F.array("single")).when(F.col("camera").isNotNull(), F.array("camera"))
    return replies.withColumn("uris", F.coalesce(pick, F.array().cast("array<string>")))


def accepts_image(types: Column) -> Column:
    """No types, or one that is empty, an image or anything."""
    return F.coalesce(F.size(types) == 0, F.lit(True)) | F.coalesce(F.exists(types, lambda t: (t == "") | F.lower(t).startswith("image/") | (t == "*/*")), F.lit(False))


def mime_by_extension(name: str, types: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in types.items() for x in pair])
    return F.coalesce(table[F.lower(F.regexp_extract(name, r"\.([^.]*)\z", 1))], F.lit(UNKNOWN_TYPE))


def _resolved(path: Column, clamp: bool) -> Column:
    """A path without . and .. segments; one that leaves the root is clamped to it, or null."""

    def step(s, x):
        up = x == ".."
        out = F.when(x.isin(".", ""), s["out"]).when(up, F.slice(s["out"], F.lit(1), F.greatest(F.size(s["out"]) - 1, F.lit(0)))).otherwise(F.array_append(s["out"], x))
        return F.struct(out.alias("out"), (s["left"] | (up & (F.size(s["out"]) == 0))).alias("left"))

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(False).alias("left"))
    folded = F.aggregate(F.split(path, "/", -1), start, step)
    ends = F.when(path.rlike(r"(^|/)\.{0,2}\z") & (F.size(folded["out"]) > 0), "/").otherwise("")
    whole = F.concat(F.lit("/"), F.array_join(folded["out"], "/"), ends)
    return whole if clamp else F.when(~folded["left"], whole)


def route_server(requests: DataFrame, present: DataFrame) -> DataFrame:
    """Adds path and status to requests (url), as a server does that joins the decoded path to its root.

    400 for a path that can't be decoded; a path that ends in / asks for its index.html; 403 where the decoded path leaves
    the root, 404 where no file (column path of ``present``) is there, else 200. path is null where nothing is looked up.
    """
    raw = F.regexp_replace("url", r"(?s)[?#].*", "")
    dots = F.regexp_replace(raw, r"(?i)(?<=/|^)(?:\.|%2e)(\.|%2e)?(?=/|\z)", ".$1")
    dots = F.regexp_replace(dots, r"(?i)(?<=/|^)\.%2e(?=/|\z)", "..")
    plain = F.try_url_decode(F.replace(_resolved(dots, True), F.lit("+"), F.lit("%2B")))
    named = F.when(plain.endswith("/"), F.concat(plain, F.lit("index.html"))).otherwise(plain)
    told = requests.withColumn("_plain", named).withColumn("path", _resolved(F.col("_plain"), False))
    known = present.select(F.col("path").alias("_known")).distinct()
    met = told.join(known, told["path"] == known["_known"], "left")
    status = F.when(F.col("_plain").isNull(), 400).when(F.col("path").isNull(), 403).when(F.col("_known").isNull(), 404).otherwise(200)
    return met.withColumn("status", status).drop("_plain", "_known")


def route(requests: DataFrame, present: DataFrame) -> DataFrame:
    """Adds status to requests by path: 403 outside the root, 404 for what is not present (column name), else 200."""
    full = requests.withColumn("path", F.when(F.col("path").isin("", "/"), "/index.html").otherwise(F.col("path")))
    known = present.select(F.concat(F.lit("/"), "name").alias("_known")).unionByName(requests.sparkSession.createDataFrame([("/index.html",)], "_known string")).distinct()
    met = full.join(known, full["path"] == known["_known"], "left")
    return met.withColumn("status", F.when(F.col("path").contains(".."), 403).when(F.col("_known").isNull(), 404).otherwise(200)).drop("_known")
