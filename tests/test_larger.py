"""Queries against their SQL on documents that the smallest tables lack."""

import os

import duckdb
import pytest

from docforge.plans import catalog

from .test_oracle import rows

TABLES = "doc_id long, text string, lang string, source string, n_chars long"


def held(spark, folder, texts, name):
    """Rows of a query and of its SQL over the documents ``texts`` (doc_id, text)."""
    folder = str(folder)
    if not os.path.isdir(f"{folder}/documents.parquet"):
        spark.createDataFrame([(k, t, "en", "s", None if t is None else len(t)) for k, t in texts], TABLES).write.parquet(f"file://{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet/*.parquet'")
    got, want = catalog.queries()[name](spark, folder).toPandas(), con.execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    return rows(got), rows(want)


#: A line of digits only, in the place of a heading, between two lines that would be joined without it.
BLANK = [(5, "1 2 3 4 5 6 7 8 " * 2 + "alpha beta gamma delta epsilon zeta eta theta " * 2), (20, "11 12 13 14 15 16 17 18 and so on it went for all"), (3, "one two three four five six seven eight " * 15 + "1 2 3 4 5 6 7 8 " * 3 + "nine ten " * 9), (7, "1 2 3")]


@pytest.mark.parametrize("name", ["files_to_markdown", "files_of_all_kinds", "resumed_run"])
def test_lines_without_text_part_their_neighbours(spark, tmp_path, name):
    got, want = held(spark, tmp_path, BLANK, name)
    assert got == want


def test_small_files_share_tasks(tmp_path):
    from docforge.sources import pages as P

    for k in range(400):
        (tmp_path / f"f{k}.pdf").write_bytes(b"[]")
    (tmp_path / "large.pdf").write_bytes(b"x" * 100_000)
    parts = P._PageReader({"path": f"file://{tmp_path}", "reader": "", "slice_bytes": "16384"}).partitions()
    assert len(parts) < 60 and len({s for p in parts for s in p.slices}) == sum(len(p.slices) for p in parts) == 407
    assert len([p for p in parts if any("large" in s[0] for s in p.slices)]) == 7
