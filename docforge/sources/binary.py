"""Files as rows: the batch source and the admission stream over it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docforge.operators.files import DEVICE_TYPES, mime_by_extension

from . import folders

#: Formats that image decoders commonly lack; their bytes go to recognition as they are.
UNDECODED = r"(?i)\.(tiff?|pnm)\z"


def _named(df: DataFrame) -> DataFrame:
    name = F.regexp_extract(F.col("path"), r"([^/]+)/?\z", 1)
    return df.select("path", name.alias("name"), F.col("length").alias("size"), "modificationTime").withColumn("mime", mime_by_extension("name", DEVICE_TYPES))


def scan(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, size, modificationTime, mime of the files of a folder; contents are not read."""
    return _named(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder))


def scan_parts(spark: SparkSession, folder: str) -> DataFrame:
    """``scan`` of the files in the folders that ``folder`` holds (``publish`` by parts): each is listed by a task, so the driver holds the names of the folders only.

    As in ``scan``, names that begin with . or _ are left out. ``folder`` is a URI that all tasks reach.
    """
    parts = [p for p in folders.children(spark, folder) if not p.rsplit("/", 1)[-1].startswith((".", "_"))]

    def listed(batches: Iterator[pa.RecordBatch]):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for part in batch.column(0).to_pylist():
                found = [i for i in store.get_file_info(fs.FileSelector(f"{root}/{part.rsplit('/', 1)[-1]}")) if i.type == fs.FileType.File and not i.base_name.startswith((".", "_"))]
                for at in range(0, len(found), 10_000):
                    own = found[at : at + 10_000]
                    columns = [f"{part}/{i.base_name}" for i in own], [i.size for i in own], [i.mtime_ns // 1000 for i in own]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.timestamp("us", "UTC")), strict=True)], ["path", "length", "modificationTime"])

    given = spark.createDataFrame([(p,) for p in parts], "part string").repartition(max(1, len(parts)))
    return _named(given.mapInArrow(listed, "path string, length long, modificationTime timestamp"))


def with_content(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Adds content, read only for the files that are left."""
    return files.join(spark.read.format("binaryFile").load(folder).select("path", "content"), "path")


#: How files of each format begin, in hexadecimal (fixed values of the formats).
FIRST_BYTES = {
    "application/pdf": "^25504446",
    "image/png": "^89504E470D0A1A0A",
    "image/jpeg": "^FFD8FF",
    "image/gif": "^474946383[79]61",
    "image/bmp": "^424D",
    "image/webp": "^52494646.{8}57454250",
    "image/tiff": "^(49492A00|4D4D002A)",
    "image/x-portable-anymap": "^503[1-7](09|0A|0D|20|23)",
}


def format_by_bytes(content: Column) -> Column:
    """The type that a file's first bytes tell, whatever its name says; null for others, and for empty and null contents."""
    head = F.hex(F.substring(content, 1, 16))
    return F.coalesce(*[F.when(head.rlike(pattern), kind) for kind, pattern in FIRST_BYTES.items()])


def decodable(name: Column) -> Column:
    return ~name.rlike(UNDECODED)
