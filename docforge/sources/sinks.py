"""Documents as text files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from docforge.operators.markdown import combined_pieces
from docforge.operators.run import unique_output_names

#: In a staged folder, how many files and bytes it holds, so that nobody has to list it to know.
HELD = ".held"


def write_each(documents: DataFrame, folder: str) -> None:
    """One file a document (file_id, name, markdown): its output name in ``folder``, its text and nothing else as content.

    ``folder`` is a URI of a file system that all tasks reach. A file is written under a name of its own and then renamed, so a task that
    is lost and run again leaves whole files and no doubles.
    """

    def put(batches: Iterator[pa.RecordBatch]):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = f"{root}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write((text or "").encode())
                store.move(part, f"{root}/{name}")
            yield batch.select([0])

    unique_output_names(documents).select("file_name", "markdown").mapInArrow(put, "file_name string").write.format("noop").mode("overwrite").save()


class StagedFiles(DataSource):
    """The sink ``docforge_files``: rows (name, content: text or binary) as files of a folder, staged by the tasks and there for all to see only once all are written.

    Option ``path``: a URI that all tasks reach. A task writes its files to a folder of its own below ``path``/.pending; when all tasks are done the driver writes
    the list of these folders, one entry a task, which decides the write, and ``publish`` moves the files. A failed or cancelled write drops what
    was staged. A task that runs twice has two folders, of which one is on the list.
    """

    @classmethod
    def name(cls) -> str:
        return "docforge_files"

    def schema(self) -> str:
        return "name string, content string"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _StagedWriter(self.options["path"], self.options.get("write", uuid.uuid4().hex))


@dataclass
class _Staged(WriterCommitMessage):
    folder: str


class _StagedWriter(DataSourceWriter):
    def __init__(self, path: str, write: str):
        self.path, self.staging = path, f".pending/{write}"

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path)

    def write(self, rows: Iterator) -> _Staged:
        store, root = self._open()
        own = f"{self.staging}/{uuid.uuid4().hex}"
        store.create_dir(f"{root}/{own}", recursive=True)
        files = size = 0
        for name, content in rows:
            content = content.encode() if isinstance(content, str) else bytes(content or b"")
            with store.open_output_stream(f"{root}/{own}/{name}") as out:
                out.write(content)
            files, size = files + 1, size + len(content)
        with store.open_output_stream(f"{root}/{own}/{HELD}") as out:
            out.write(b"%d %d" % (files, size))
        return _Staged(own)

    def commit(self, messages: list) -> None:
        store, root = self._open()
        store.create_dir(f"{root}/{self.staging}", recursive=True)
        with store.open_output_stream(f"{root}/{self.staging}.list.part") as out:
            out.write("".join(f"{m.folder}\n" for m in messages if m is not None).encode())
        store.move(f"{root}/{self.staging}.list.part", f"{root}/{self.staging}.list")

    def abort(self, messages: list) -> None:
        store, root = self._open()
        from pyarrow import fs

        if store.get_file_info(f"{root}/{self.staging}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.staging}")


def publish(spark: SparkSession, folder: str, by_parts: bool = False) -> None:
    """Move the files of every decided write of ``folder`` to their places, a task for each staged folder, and clear what is left over.

    May be run again after a crash: what was moved stays, what wasn't is moved then. Of two writes with one name the later replaces the file.

    With ``by_parts`` each staged folder is moved as it is, to ``folder``/part-..., so that no folder holds more files than one task wrote and
    moves grow with the tasks, not with the files; files of one name in two parts both stay then. It takes a file system that renames folders.
    """
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    if store.get_file_info(f"{root}/.pending").type == fs.FileType.NotFound:
        return
    lists = sorted((i.mtime_ns or 0, i.path) for i in store.get_file_info(fs.FileSelector(f"{root}/.pending")) if i.path.endswith(".list"))
    for _, path in lists:
        with store.open_input_stream(path) as f:
            staged = f.read().decode().split()

        def put(batches: Iterator[pa.RecordBatch]):
            store, root = fs.FileSystem.from_uri(folder)
            for batch in batches:
                for own in batch.column(0).to_pylist():
                    if store.get_file_info(f"{root}/{own}").type == fs.FileType.NotFound:
                        continue
                    if by_parts:
                        store.move(f"{root}/{own}", f"{root}/part-{own.rsplit('/', 1)[-1]}")
                        continue
                    for entry in store.get_file_info(fs.FileSelector(f"{root}/{own}")):
                        if entry.base_name != HELD:
                            store.move(entry.path, f"{root}/{entry.base_name}")
                yield batch

        if staged:
            spark.createDataFrame([(s,) for s in staged], "staged string").repartition(len(staged)).mapInArrow(put, "staged string").write.format("noop").mode("overwrite").save()
        store.delete_file(path)
        if store.get_file_info(path.removesuffix(".list")).type != fs.FileType.NotFound:
            store.delete_dir(path.removesuffix(".list"))


def write_all_or_none(documents: DataFrame, folder: str) -> None:
    """``write_each`` in two phases: a job that fails leaves nothing in ``folder``, one that is done leaves all its files."""
    spark = documents.sparkSession
    spark.dataSource.register(StagedFiles)
    unique_output_names(documents).select(F.col("file_name").alias("name"), F.col("markdown").alias("content")).write.format("docforge_files").option("path", folder).option("write", uuid.uuid4().hex).mode("append").save()
    publish(spark, folder)


def write_combined(documents: DataFrame, folder: str, order: str = "file_id") -> None:
    """All documents in order as text files that, one after the other by name, are the combined text."""
    combined_pieces(documents, order).write.mode("overwrite").option("lineSep", "\n").text(folder)
