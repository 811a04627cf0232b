"""Runs over many files that can be cancelled, taken up again and watched."""

from __future__ import annotations

import hashlib
import threading
import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docforge.options import Options
from docforge.sources.folders import children, delete, move

#: Files of a chunk, about: what one job converts and commits, and what a cancelled run can lose.
CHUNK_FILES = 10_000
#: Files that hold a chunk's contents, about.
CHUNK_PARTS = 8
#: Shares of a file's progress. Where opening, a page's drawing and its recognition end, and the page part as a whole.
OPENED, PAGES, DRAWN, READ = 0.02, 0.96, 0.1, 0.15
PREPARED, SEEN, SEEN_SHARE, BUILT = 0.05, 0.1, 0.85, 0.98
# End of the fixed values.


def options_digest(options: Options) -> str:
    """What tells runs with different options apart."""
    return hashlib.sha256(repr(options).encode()).hexdigest()


def content_key(content: Column | str = "content", name: Column | str = "name") -> Column:
    """A file's key in the ledger: its name and content, since both show in the result."""
    name = F.col(name) if isinstance(name, str) else name
    return F.sha2(F.concat(F.coalesce(name, F.lit("")).cast("binary"), F.lit(b"\0"), F.coalesce(F.col(content) if isinstance(content, str) else content, F.lit(b""))), 256)


def file_steps(pages: DataFrame) -> DataFrame:
    """doc_id, step_no, page_no, step, fraction: the steps of each file, and how much of it is done when a step begins.

    ``pages``: doc_id, page_no (from 1), kind ('pdf' or 'image'), from_layer. A PDF is opened; each page is opened, and either has its layer taken or is
    drawn, recognised; an image is prepared, recognised; then the document is built. Fractions never fall and end at 1.
    """
    pages = pages.select("doc_id", "page_no", "kind", "from_layer", F.count(F.lit(1)).over(Window.partitionBy("doc_id")).alias("n"))
    at = lambda share: F.lit(OPENED) + ((F.col("page_no") - 1) + share) / F.col("n") * PAGES
    step = lambda k, name, share: F.struct(F.lit(k).alias("k"), F.lit(name).alias("step"), share.alias("fraction"))
    first = F.col("page_no") == 1
    some = lambda when, *steps: F.when(when, F.array(*steps)).otherwise(F.array().cast("array<struct<k:int,step:string,fraction:double>>"))
    pdf = F.flatten(F.array(
        some(first, step(0, "open", F.lit(OPENED))),
        some(F.lit(True), step(1, "page", at(F.lit(0.0)))),
        some(F.col("from_layer"), step(2, "layer", at(F.lit(1.0)))),
        some(~F.col("from_layer"), step(2, "draw", at(F.lit(DRAWN))), step(3, "recognise", at(F.lit(READ))), step(4, "recognised", at(F.lit(1.0)))),
    ))
    image = F.array(step(0, "prepare", F.lit(PREPARED)), step(1, "recognise", F.lit(SEEN)), step(2, "recognised", F.lit(SEEN + SEEN_SHARE)), step(3, "build", F.lit(BUILT)))
    rows = pages.select("doc_id", "page_no", F.explode(F.when(F.col("kind") == "pdf", pdf).otherwise(image)).alias("x")).select("doc_id", "page_no", "x.*")
    ends = pages.select("doc_id").distinct().select("doc_id", F.lit(None).cast("long").alias("page_no"), F.lit(9).alias("k"), F.lit("done").alias("step"), F.lit(1.0).alias("fraction"))
    order = Window.partitionBy("doc_id").orderBy(F.col("page_no").asc_nulls_last(), "k")
    every = rows.select("doc_id", F.col("page_no").cast("long"), "k", "step", "fraction").unionByName(ends)
    return every.select("doc_id", F.row_number().over(order).cast("long").alias("step_no"), "page_no", "step", "fraction")


@dataclass
class Report:
    """What became of a run: its status ('done', 'partial', 'cancelled' or 'none'), counts of files, and its progress as (seconds, fraction)."""

    status: str
    succeeded: int
    failed: int
    skipped: int
    progress: list[tuple[float, float]] = field(default_factory=list)


class BatchRun:
    """Convert files in chunks, each one Spark job whose results are committed as one folder.

    ``convert(files)`` takes rows with a key column beside those of ``files`` (doc_id, unique and not null, name, mime, content) and gives one row a doc_id
    with ``ok``; it may give none for files that it doesn't take. Results
    lie in ``target``/results, one folder a chunk, with key and options digest beside them: they are the ledger, too. Keys that are in the ledger under the
    same options are not converted again; of files with one key the first by doc_id is converted once and all of them share its result (``results``). A chunk is
    written aside and moved into place in one step, so a job that fails, is cancelled or loses the driver leaves no part of it. ``at_once`` chunks run side
    by side, so that the cluster isn't idle at the ends of each; where one fails, those beside it are finished and no other is begun.

    ``cancel`` may be called from any thread: it cancels the running job by its tag and keeps all chunks that are committed. Errors of single files are values
    (``ok`` false) and stay in the ledger, unless ``retry_failed``.
    """

    def __init__(self, spark: SparkSession, target: str, convert: Callable[[DataFrame], DataFrame], options: Options = Options(), chunk_files: int = CHUNK_FILES, retry_failed: bool = False, on_progress: Callable[[float], None] | None = None, at_once: int = 1):
        self.spark, self.target, self.convert = spark, target.rstrip("/"), convert
        self.digest, self.chunk_files, self.retry_failed, self.on_progress = options_digest(options), chunk_files, retry_failed, on_progress
        self.tag = f"docforge-{uuid.uuid4().hex}"
        self.at_once, self._cancelled, self._noting = at_once, threading.Event(), threading.Lock()
        self.progress: list[tuple[float, float]] = []

    def cancel(self) -> None:
        self._cancelled.set()
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def ledger(self) -> DataFrame | None:
        """key, options, ok of all committed results; None before the first."""
        path = f"{self.target}/results"
        if not children(self.spark, path):
            return None
        return self.spark.read.option("recursiveFileLookup", "true").parquet(path)

    def run(self, files: DataFrame) -> Report:
        """Convert what the ledger doesn't hold yet."""
        spark, began = self.spark, time.monotonic()
        self._cancelled.clear()
        aside = f"{self.target}/.pending/{uuid.uuid4().hex}"
        context = spark.sparkContext
        context.addJobTag(self.tag)
        succeeded = failed = skipped = 0
        try:
            files.select("doc_id", content_key().alias("key")).write.parquet(f"{aside}/keys")
            keyed = spark.read.parquet(f"{aside}/keys")
            first = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"))
            known = self.ledger()
            if known is not None:
                mine = known.where((F.col("options") == self.digest) & (F.col("ok") | F.lit(not self.retry_failed)))
                first = first.join(mine.select("key"), "key", "left_anti")
            first.write.parquet(f"{aside}/todo")
            todo = spark.read.parquet(f"{aside}/todo")
            counted = todo.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
            total, skipped = counted["total"], keyed.count() - counted["n"]
            chunks = max(1, -(-total // self.chunk_files))
            self._note(began, 0.0)
            parts = {}
            if total:  # contents are dealt once, each chunk to a few files of its own folder, so that a chunk reads its own alone
                dealt = files.join(todo.select("doc_id", "key", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int").alias("chunk")), "doc_id")
                dealt.repartition("chunk", F.pmod(F.xxhash64("doc_id"), F.lit(CHUNK_PARTS))).write.partitionBy("chunk").parquet(f"{aside}/files")
                parts = {p.rsplit("/", 1)[-1]: p for p in children(spark, f"{aside}/files") if "chunk=" in p}
                shape = dealt.drop("chunk").schema
            state, stop = {"done": 0, "running": 0}, threading.Event()

            def one(part: str) -> tuple[int, int]:
                if self._cancelled.is_set() or stop.is_set():
                    return 0, 0
                state["running"] += 1
                try:
                    own = spark.read.schema(shape).parquet(parts[part])
                    keys = own.select("doc_id", "key", F.lit(self.digest).alias("options"))
                    self.convert(own).join(keys, "doc_id").drop("doc_id").write.parquet(f"{aside}/{part}")
                    if self._cancelled.is_set():
                        return 0, 0
                    counts = spark.read.parquet(f"{aside}/{part}").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad")).first()
                    move(spark, f"{aside}/{part}", f"{self.target}/results/{uuid.uuid4().hex}")
                    state["done"] += 1
                    self._note(began, state["done"] / len(parts))
                    return counts["good"], counts["bad"]
                except Exception:
                    stop.set()
                    raise
                finally:
                    state["running"] -= 1

            with self._watched(began, lambda: (state["done"] / len(parts), state["running"] / len(parts)) if parts else (0.0, 0.0)), ThreadPoolExecutor(self.at_once) as pool:
                for made in [pool.submit(inheritable_thread_target(spark)(one), part) for part in parts]:
                    try:
                        good, bad = made.result()
                        succeeded, failed = succeeded + good, failed + bad
                    except Exception:
                        if not self._cancelled.is_set():
                            raise  # when the chunks beside it are committed
            if not total:
                self._note(began, 1.0)
        except Exception:
            if not self._cancelled.is_set():
                raise
        finally:
            context.removeJobTag(self.tag)
            delete(spark, aside)
        status = "cancelled" if self._cancelled.is_set() else "partial" if failed else "done" if succeeded or skipped else "none"
        return Report(status, succeeded, failed, skipped, self.progress)

    def results(self, files: DataFrame) -> DataFrame:
        """One row for each of ``files`` (doc_id, name, content) whose result is there: doc_id and the result's columns."""
        known = self.ledger()
        mine = known.where(F.col("options") == self.digest).dropDuplicates(["key"]) if not self.retry_failed else known.where(F.col("options") == self.digest).withColumn("_bad", ~F.col("ok")).groupBy("key").agg(F.min_by(F.struct("*"), "_bad").alias("x")).select("x.*").drop("_bad")
        return files.select("doc_id", content_key().alias("key")).join(mine.drop("options"), "key").drop("key")

    def _note(self, began: float, fraction: float) -> None:
        with self._noting:
            last = self.progress[-1][1] if self.progress else 0.0
            self.progress.append((time.monotonic() - began, max(last, min(1.0, fraction))))
            if self.on_progress:
                self.on_progress(self.progress[-1][1])

    def _watched(self, began: float, at: Callable[[], tuple[float, float]]):
        """Note how many tasks of the tagged jobs are done while chunks run; ``at`` gives the shares of the run that are done and under way."""
        run = self

        class Watch:
            def __enter__(self):
                self.stop = threading.Event()
                self.thread = threading.Thread(target=self.look, daemon=True)
                self.thread.start()

            def look(self):
                while not self.stop.wait(0.2):
                    base, share = at()
                    run._note(began, base + share * 0.99 * run._tasks_done())

            def __exit__(self, *_):
                self.stop.set()
                self.thread.join()

        return Watch()

    def _tasks_done(self) -> float:
        tracker, context = self.spark.sparkContext.statusTracker(), self.spark.sparkContext
        done = total = 0
        for job in context._jsc.sc().statusTracker().getJobIdsForTag(self.tag):
            if (known := tracker.getJobInfo(job)) is None or known.status != "RUNNING":
                continue
            for stage in known.stageIds:
                if (info := tracker.getStageInfo(stage)) is not None:
                    done, total = done + info.numCompletedTasks, total + info.numTasks
        return done / total if total else 0.0


def progress_rows(spark: SparkSession, report: Report) -> DataFrame:
    """seconds, fraction of a run's notes."""
    return spark.createDataFrame(report.progress, "seconds double, fraction double")
