"""Files admitted as they arrive."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from docforge.operators.files import admit, deduplicate, with_ids
from docforge.sources.folders import exists, move

ADMITTED = "file_id long, seq long, name string, mime string, size long, kind string"


def admitted_stream(spark: SparkSession, folder: str, schema: StructType, late: str = "1 hour", time: str = "arrived") -> DataFrame:
    """New rows (seq, name, mime, size, arrived) of a folder of Parquet files, each (name, size) once.

    State is dropped behind the watermark, so its size follows the rate of arrival, not the history; ``AdmissionLog`` remembers all.
    """
    rows = spark.readStream.schema(schema).parquet(folder).withWatermark(time, late)
    return admit(rows).dropDuplicatesWithinWatermark(["name", "size"])


def run_once(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Take what is there, write it, and stop."""
    return stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class AdmissionLog:
    """The list of admitted files over any number of batches, kept as tables in a folder.

    Of the files of a batch, those of a known kind are admitted, each (name, size) once (first by seq) and only while no file of
    that name and size is on the list. Ids go on from the highest ever given, dense within all batches; a removed file leaves the
    list, its id never comes back, and offered again it is a new file. Unknown names or sizes equal each other.

    A batch is one folder, written aside and moved into place in one step, so one that fails leaves nothing, and one whose number
    was admitted before is passed over: a stream that takes a batch again after a crash gives no second ids.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _rows(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.folder}/{kind}"
        found = self.spark.read.schema(schema).option("recursiveFileLookup", "true")
        return found.parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def admitted(self) -> DataFrame:
        """All files ever admitted."""
        return self._rows("admitted", ADMITTED)

    def present(self) -> DataFrame:
        """The list: admitted and not removed."""
        return self.admitted().join(self._rows("removed", "file_id long"), "file_id", "left_anti")

    def _append(self, rows: DataFrame, kind: str, name: str) -> bool:
        place = f"{self.folder}/{kind}/{name}"
        if exists(self.spark, place):
            return False
        aside = f"{self.folder}/.pending/{uuid.uuid4().hex}"
        rows.write.parquet(aside)
        return move(self.spark, aside, place)

    def admit(self, files: DataFrame, batch: int | str | None = None) -> DataFrame:
        """Take a batch of offered files (seq, name, mime, size); the rows it added to the list."""
        batch = uuid.uuid4().hex if batch is None else batch
        new = deduplicate(admit(files.select("seq", "name", "mime", "size")), self.present())
        last = self.admitted().agg(F.coalesce(F.max("file_id"), F.lit(0)).alias("last"))  # one row
        numbered = with_ids(new).join(F.broadcast(last)).withColumn("file_id", F.col("file_id") + F.col("last"))
        self._append(numbered.select(*[c.split()[0] for c in ADMITTED.split(", ")]), "admitted", f"batch-{batch}")
        return self.spark.read.schema(ADMITTED).parquet(f"{self.folder}/admitted/batch-{batch}")

    def remove(self, ids: DataFrame, batch: int | str | None = None) -> None:
        """Take files (file_id) off the list; ids that aren't on it change nothing."""
        self._append(ids.select("file_id").join(self.present().select("file_id"), "file_id", "left_semi").distinct(), "removed", f"batch-{uuid.uuid4().hex if batch is None else batch}")

    def admit_stream(self, offered: DataFrame, checkpoint: str) -> StreamingQuery:
        """Admit a stream of offered files batch by batch, all that is there, and stop."""
        return offered.writeStream.foreachBatch(lambda rows, number: self.admit(rows, f"stream-{number}") and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
