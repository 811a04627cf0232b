"""Runs that are cancelled, killed and taken up again; staged files; pages by slices; engines by language; ids over batches."""

import os
import threading
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from docforge.operators import batch as BA
from docforge.operators import ocr as O
from docforge.options import Options
from docforge.sources import pages as P
from docforge.sources import sinks as K
from docforge.streaming.admission import AdmissionLog

FILES = "doc_id long, name string, mime string, content binary"


def offered(spark, n=12):
    return spark.createDataFrame([(i, f"f{i % 9}.png", "image/png", b"%d" % (i % 9)) for i in range(n)], FILES)


def seen(folder):
    """A conversion that notes each file it takes, and fails those whose content is 3."""

    def convert(files):
        def run(batches):
            for pdf in batches:
                for i in pdf["doc_id"]:
                    with open(f"{folder}/{i}-{time.time_ns()}", "w"):
                        pass
                yield pdf[["doc_id"]].assign(ok=[c != b"3" for c in pdf["content"]], markdown=[c.decode() for c in pdf["content"]])

        return files.mapInPandas(run, "doc_id long, ok boolean, markdown string")

    return convert


def taken(folder):
    return Counter(int(f.split("-")[0]) for f in os.listdir(folder))


def test_run_taken_up_again(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    run = BA.BatchRun(spark, f"file://{tmp_path}/out", seen(notes), chunk_files=3)
    first = run.run(offered(spark, 6))
    assert (first.status, first.succeeded, first.failed, first.skipped) == ("partial", 5, 1, 0)
    second = run.run(offered(spark))
    assert (second.status, second.succeeded, second.failed, second.skipped) == ("done", 3, 0, 9)  # three new, copies and what is known skipped
    assert taken(notes) == Counter(range(9))
    got = {r["doc_id"]: (r["ok"], r["markdown"]) for r in run.results(offered(spark)).collect()}
    assert got == {i: (i % 9 != 3, str(i % 9)) for i in range(12)}
    assert run.run(offered(spark)).status == "done" and taken(notes) == Counter(range(9))
    assert BA.BatchRun(spark, f"file://{tmp_path}/out", seen(notes), Options(lang="eng")).run(offered(spark, 2)).succeeded == 2  # other options: another result
    again = BA.BatchRun(spark, f"file://{tmp_path}/out", seen(notes), retry_failed=True)
    assert again.run(offered(spark)).failed == 1 and taken(notes)[3] == 2
    assert len(again.results(offered(spark)).collect()) == 12
    assert BA.BatchRun(spark, f"file://{tmp_path}/none", seen(notes)).run(offered(spark).limit(0)).status == "none"
    fractions = [f for _, f in first.progress]
    assert fractions == sorted(fractions) and fractions[-1] == 1.0
    assert BA.progress_rows(spark, first).count() == len(fractions)


def test_failed_chunk_leaves_nothing(spark, tmp_path):
    """A conversion that dies after its first chunks, as a lost driver would: the next run goes on behind them."""
    notes = tmp_path / "notes"
    notes.mkdir()
    calls = []

    def dies(files):
        calls.append(1)
        if len(calls) == 3:
            return files.select("doc_id", F.raise_error(F.lit("gone")).cast("boolean").alias("ok"))
        return seen(notes)(files)

    out = f"file://{tmp_path}/out"
    with pytest.raises(Exception, match="gone"):
        BA.BatchRun(spark, out, dies, chunk_files=2).run(offered(spark, 9))
    done = {int(r["markdown"]) for r in BA.BatchRun(spark, out, dies).ledger().collect()}
    assert 0 < len(done) < 9 and set(taken(notes)) == done and not os.listdir(tmp_path / "out" / ".pending")
    BA.BatchRun(spark, out, seen(notes), chunk_files=2).run(offered(spark, 9))
    assert taken(notes) == Counter(range(9))


def test_chunks_side_by_side(spark, tmp_path):
    """several chunks are under way at once, each reads its own folder, and files are gone through twice, for their keys and for their contents."""
    (tmp_path / "notes").mkdir()
    given, active, most = [], [], []

    def convert(files):
        active.append(1)
        most.append(len(active))
        given.append(files.inputFiles())
        time.sleep(1)
        made = files.select("doc_id", F.lit(True).alias("ok"), F.col("content").cast("string").alias("markdown"))
        active.pop()
        return made

    def note(batches):
        for pdf in batches:
            for i in pdf["doc_id"]:
                with open(tmp_path / "notes" / f"{i}-{time.time_ns()}", "w"):
                    pass
            yield pdf

    rows = spark.createDataFrame([(i, f"f{i}.png", "image/png", b"%d" % i) for i in range(30)], FILES)
    run = BA.BatchRun(spark, f"file://{tmp_path}/out", convert, chunk_files=5, at_once=3)
    report = run.run(rows.mapInPandas(note, FILES))
    assert (report.status, report.succeeded) == ("done", 30) and 1 < max(most) <= 3
    assert max(taken(tmp_path / "notes").values()) == 2
    assert all(len({os.path.dirname(f) for f in own}) == 1 for own in given) and len({f for own in given for f in own}) == sum(map(len, given))
    assert {r["doc_id"]: r["markdown"] for r in run.results(rows).collect()} == {i: str(i) for i in range(30)}
    fractions = [f for _, f in report.progress]
    assert fractions == sorted(fractions) and fractions[-1] == 1.0


def test_cancelled_run_keeps_finished_files(spark, tmp_path):
    started, calls = threading.Event(), []

    def slow(files):
        calls.append(1)
        if len(calls) < 3:
            return files.select("doc_id", F.lit(True).alias("ok"))

        def run(batches):
            for pdf in batches:
                open(tmp_path / "started", "w").close()
                time.sleep(60)
                yield pdf[["doc_id"]].assign(ok=True)

        return files.mapInPandas(run, "doc_id long, ok boolean")

    run = BA.BatchRun(spark, f"file://{tmp_path}/out", slow, chunk_files=2)

    def watch():
        while not (tmp_path / "started").exists():
            time.sleep(0.1)
        started.set()
        run.cancel()

    threading.Thread(target=watch, daemon=True).start()
    began = time.monotonic()
    report = run.run(offered(spark, 9))
    assert started.is_set() and report.status == "cancelled" and time.monotonic() - began < 55
    assert report.succeeded == run.ledger().count() > 0
    assert report.succeeded < 9 and report.progress[-1][1] < 1.0
    rest = BA.BatchRun(spark, f"file://{tmp_path}/out", lambda files: files.select("doc_id", F.lit(True).alias("ok"))).run(offered(spark, 9))
    assert rest.succeeded + report.succeeded == 9


def test_progress_ends_at_one(spark):
    pages = spark.createDataFrame([(1, 1, "pdf", True), (1, 2, "pdf", False), (2, 1, "image", False), (3, 1, "pdf", False)], "doc_id long, page_no long, kind string, from_layer boolean")
    rows = BA.file_steps(pages).orderBy("doc_id", "step_no").collect()
    for i in (1, 2, 3):
        own = [r["fraction"] for r in rows if r["doc_id"] == i]
        assert own == sorted(own) and own[-1] == 1.0 and own[0] > 0
    assert [r["step"] for r in rows if r["doc_id"] == 1] == ["open", "page", "layer", "page", "draw", "recognise", "recognised", "done"]
    assert BA.file_steps(pages.limit(0)).count() == 0


def test_write_all_or_none(spark, tmp_path):
    folder = f"file://{tmp_path}/out"
    docs = spark.createDataFrame([(i, f"n{i % 3}.pdf", f"text {i}") for i in range(9)], "file_id long, name string, markdown string").repartition(3)
    K.write_all_or_none(docs, folder)
    got = {f: (tmp_path / "out" / f).read_text() for f in os.listdir(tmp_path / "out") if not f.startswith(".")}
    assert sorted(got.values()) == [f"text {i}" for i in range(9)] and len(got) == 9 and not os.listdir(tmp_path / "out" / ".pending")
    bad = docs.withColumn("markdown", F.when(F.col("file_id") == 7, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.concat(F.lit("new "), "markdown")))
    with pytest.raises(Exception, match="broken"):
        K.write_all_or_none(bad, folder)
    K.publish(spark, folder)
    assert {f: (tmp_path / "out" / f).read_text() for f in got} == got and not os.listdir(tmp_path / "out" / ".pending")


def test_publish_goes_on_after_a_crash(spark, tmp_path):
    """Decided, but moved in part only: publishing again moves the rest."""
    folder = f"file://{tmp_path}"
    spark.dataSource.register(K.StagedFiles)
    rows = spark.createDataFrame([(f"{i}.md", f"text {i}") for i in range(6)], "name string, content string").repartition(3)
    rows.write.format("docforge_files").option("path", folder).mode("append").save()
    staged = [os.path.join(a, f) for a, _, fs in os.walk(tmp_path / ".pending") for f in fs if f.endswith(".md")]
    assert len(staged) == 6 and not [f for f in os.listdir(tmp_path) if f.endswith(".md")]
    os.rename(staged[0], tmp_path / os.path.basename(staged[0]))
    K.publish(spark, folder)
    K.publish(spark, folder)
    assert sorted(f for f in os.listdir(tmp_path) if f.endswith(".md")) == [f"{i}.md" for i in range(6)]


class Page:
    width, height, rotation = 3, 2, 0

    def __init__(self, text):
        self.items = [{"str": text, "transform": [1.0, 0.0, 0.0, 10.0, 0.0, 0.0], "width": 5.0, "height": 9.0}]

    def render(self, scale, rotation):
        return np.full((2, 3, 3), 7, np.uint8)


class Lazy:
    """Pages that note each time one is read."""

    def __init__(self, content):
        if content == b"bad":
            raise ValueError("no PDF")
        self.folder, self.n = content.decode().split()[:2]

    def __len__(self):
        return int(self.n)

    def __getitem__(self, k):
        with open(f"{self.folder}/{k + 1}-{time.time_ns()}", "w"):
            pass
        if k == 4:
            raise ValueError("no page")
        return Page("enough text for a layer of its own, as a page of prose has it" if k % 2 else "\U0001f600" * 10)


def lazy():
    return Lazy


def test_pages_by_slices(spark, tmp_path):
    notes, folder = tmp_path / "notes", tmp_path / "in"
    notes.mkdir(), folder.mkdir()
    (folder / "a.pdf").write_bytes(f"{notes} 11 ".encode() + b"x" * 1000)
    (folder / "b.PDF").write_bytes(b"bad")
    (folder / "c.txt").write_bytes(b"bad")
    (folder / "none.pdf").write_bytes(f"{notes} 0".encode())
    spark.dataSource.register(P.PageSource)
    table = spark.read.format("docforge_pages").option("path", f"file://{folder}").option("reader", "tests.test_runs:lazy").option("slice_bytes", 300).load()
    assert len(P._PageReader({"path": f"file://{folder}", "reader": "", "slice_bytes": "300"}).partitions()) == 4 + 1 + 1
    rows = {(r["path"], r["page_no"]): r for r in table.collect()}
    assert set(rows) == {("a.pdf", k) for k in range(1, 12)} | {("b.PDF", None)}
    assert taken(notes) == Counter(range(1, 12))  # each page once, drawn or not
    assert rows["b.PDF", None]["error"] == "no PDF" and rows["a.pdf", 5]["error"] == "no page"
    assert all((r["content"] is None) == (k % 2 == 0) and (r["items"] is None) == (k % 2 == 1) for (f, k), r in rows.items() if f == "a.pdf" and k != 5)
    reader = P._NarrowedReader({"path": f"file://{folder}", "reader": "tests.test_runs:lazy", "slice_bytes": "300"})
    left = list(reader.pushFilters([P.GreaterThan(("page_no",), 3), P.LessThanOrEqual(("page_no",), 6), P.EqualTo(("path",), "a.pdf")]))
    assert left == [P.EqualTo(("path",), "a.pdf")]
    assert [r[1] for s in reader.partitions()[:4] for r in reader.read(s)] == [4, 5, 6]
    for f in notes.iterdir():
        f.unlink()
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        narrow = spark.read.format("docforge_pages").option("path", f"file://{folder}").option("reader", "tests.test_runs:lazy").option("slice_bytes", 300).option("pushdown", "true").load()
        assert sorted(r["page_no"] for r in narrow.where("page_no >= 9").collect()) == [9, 10, 11] and taken(notes) == Counter([9, 10, 11])
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_engines_by_language(spark, tmp_path):
    rows = [(i, ["hun", "eng", None, "xyz"][min(i % 7, 3)], b"%d" % i) for i in range(200)]
    images = spark.createDataFrame(rows, "id long, lang string, content binary").repartition(5)

    def engine(lang):
        if lang in (None, "xyz"):
            raise ValueError(f"no {lang}")
        with open(tmp_path / f"{lang}-{os.getpid()}-{time.time_ns()}", "w"):
            pass

        class Engine:
            def __call__(self, content, psm):
                if content == b"7":
                    raise ValueError("unreadable")
                return {"text": f"{lang} {content.decode()} {psm}", "confidence": 1.0, "blocks": None}

            def close(self):
                with open(tmp_path / f"closed-{time.time_ns()}", "w"):
                    pass

        return Engine()

    def told(df):
        return sorted((r["id"], r["lang"], r["ok"], r["error"], r["text"]) for r in O.recognize_by_language(df, engine, "3").collect())

    got = told(images)
    made = [f for f in os.listdir(tmp_path) if not f.startswith("closed")]
    tasks = spark.conf.get("spark.sql.shuffle.partitions")
    assert len(made) <= 2 + int(tasks) and len(os.listdir(tmp_path)) == 2 * len(made)
    want = [(i, lang, lang in ("hun", "eng") and i != 7, f"no {lang}" if lang not in ("hun", "eng") else "unreadable" if i == 7 else None, f"{lang} {i} 3" if lang in ("hun", "eng") and i != 7 else None) for i, lang, _ in rows]
    assert got == want
    assert told(images.orderBy(F.rand(3))) == want and told(images.limit(0)) == []


def test_ids_go_on_over_batches(spark, tmp_path):
    log = AdmissionLog(spark, f"file://{tmp_path}/log")
    offer = lambda *rows: spark.createDataFrame([(k, n, "image/png", s) for k, (n, s) in enumerate(rows)], "seq long, name string, mime string, size long")
    state, next_id = {}, 1
    batches = [([("a", 1), ("b", 1), ("a", 1), ("a", 2)], [2]), ([("b", 1), ("a", 1), ("c", 1)], [1, 4]), ([("a", 1), ("c", 1), ("d", None), ("d", None)], [])]
    for number, (rows, gone) in enumerate(batches):
        for row in rows:  # one file after the other, as the list takes them
            if row not in state.values():
                state[next_id] = row
                next_id += 1
        log.admit(offer(*rows), number)
        log.admit(offer(("late", 9)), number)  # a batch taken again
        assert {r["file_id"]: (r["name"], r["size"]) for r in log.present().collect()} == state
        for i in gone:
            state.pop(i, None)
        log.remove(spark.createDataFrame([(i,) for i in [*gone, 99]], "file_id long"), number)
        assert {r["file_id"]: (r["name"], r["size"]) for r in log.present().collect()} == state
    ids = sorted(r["file_id"] for r in log.admitted().collect())
    assert ids == list(range(1, next_id))


def test_stream_into_log(spark, tmp_path):
    schema = "seq long, name string, mime string, size long"
    log, folder = AdmissionLog(spark, f"file://{tmp_path}/log"), f"{tmp_path}/in"
    for k in range(2):
        spark.createDataFrame([(10 * k + i, f"n{i}", "image/png", 1) for i in range(2 + k)], schema).write.mode("append").parquet(folder)
        log.admit_stream(spark.readStream.schema(schema).parquet(folder), f"{tmp_path}/check").awaitTermination()
    assert sorted((r["file_id"], r["name"]) for r in log.present().collect()) == [(1, "n0"), (2, "n1"), (3, "n2")]
