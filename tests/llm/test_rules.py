"""Quality rules against plain counts, with odd texts, columns and tables."""

import random

import pytest

from docforge.llm import rules

from . import brute
from .test_operators import SCHEMA, docs, empty, text_of, texts  # noqa: F401

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def test_measures(spark, docs, texts):  # noqa: F811
    rng = random.Random(2)
    more = ["a " * n for n in (7, 8, 9, 15, 16, 17)] + ["x\n \nx\n\ny\nx", "\u2028 w\x0b\x0c\rw", "é" * 40, " ".join(rng.choice("ab") for _ in range(60)), "# $ | <b>", " ".join(f"w{i}" for i in range(30)) + " - " + " ".join(f"w{i}" for i in range(12))]
    table = docs.unionByName(spark.createDataFrame([(1000 + i, t, "en", None, 0) for i, t in enumerate(more)], SCHEMA))
    plain = {i: brute.rule_measures(t) for i, t in [*texts, *((1000 + i, t) for i, t in enumerate(more))]}
    got = {r["doc_id"]: r for r in rules.quality_rules(table).collect()}
    assert {i: tuple(r[m] for m in MEASURES) for i, r in got.items()} == plain
    for r in got.values():
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not r["broken"])


@pytest.mark.parametrize(("text", "name"), [
    ("the of to and " * 2 + " ".join(f"w{i} #{i}" for i in range(30)), "symbols"),
    (" ".join(f"word{i}" for i in range(60)), "stop_words"),
    ("the of and to in is it for as was " + " ".join(str(i) for i in range(40)), "letters"),
    ("the of and to in is it for as was " + "".join(f"long line number {i // 2} of some words\n" for i in range(12)), "duplicate_lines"),
    ("".join(f"the line {i} of it has more and ends with...\r\n" for i in range(8)), "ellipsis_lines"),
    ("".join(f" - the item {i} of it and to say in\n" for i in range(8)), "bullet_lines"),
    ("the of and " + " ".join("x" * 40 + str(i) for i in range(40)), "word_length"),
])
def test_each_rule(spark, text, name):
    row = rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert name in row["broken"] and not row["kept"]
    row = rules.quality_rules(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules=()).first()
    assert row["broken"] == [] and row["kept"] == (not row["base_failed"])


def test_edges(spark, empty):  # noqa: F811
    assert rules.quality_rules(empty).count() == 0
    rows = spark.createDataFrame([(None, "xx zz", 1, "p"), (4, None, 2, "q"), (4, "", 3, "r"), (4, "", 3, "r")], "doc_id long, text string, N_WORDS int, `od.d` string")
    got = rules.quality_rules(rows, payload=True)
    assert got.columns.count("n_words") == 1 and "N_WORDS" not in got.columns
    assert sorted((r["doc_id"], r["n_words"], r["od.d"], r["kept"]) for r in got.collect() if r["doc_id"]) == [(4, 0, "q", False), (4, 0, "r", False), (4, 0, "r", False)]
    assert [(r["n_words"], r["base_failed"], r["broken"]) for r in got.where("doc_id IS NULL").collect()] == [(2, True, ["word_length", "stop_words"])]
    long = spark.createDataFrame([(1, text_of(random.Random(1), 200_000, 10**6))], "doc_id long, text string")
    assert rules.quality_rules(long).first()["n_words"] == 200_000


def test_no_user_function(docs):  # noqa: F811
    plan = rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
