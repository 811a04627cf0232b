"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, documents

#: Words of a window that counts as repeated where it stands twice in a text.
WINDOW = 8
#: Fewer words, or more than this share of words (in hundredths) in repeated windows, fail whatever the table says.
LEAST_WORDS, MOST_REPEATED = 20, 30
SYMBOLS = "#*$%&|<>"
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTER, ELLIPSES, BULLET = r"\p{L}", ("...", "…"), r"\A[\x20\x09-\x0D]*[-*•‣▪●]"
#: Frequent function words of English, German, French and Spanish, which running prose of these languages holds.
STOP_WORDS = (
    "the be to of and that have with a in is it for as was on are by this at from or an not but which you we they he she his her "
    "der die das und ist nicht mit von zu ein eine den auf im es sich dem des "
    "le la les et est des une un du dans que qui pour pas sur au en par ne plus ce "
    "el los las y del que es una por con para se su no al lo como"
).split()  # fixed values


class Rule(NamedTuple):
    """Per ``unit`` there may be ``least`` to ``most`` of ``measure``, both in hundredths; None is no bound. With no unit at all a rule isn't broken."""

    name: str
    measure: str
    unit: str
    least: int | None
    most: int | None


#: Thresholds, as hundredths. Bounds lie well outside what running prose of the languages above shows.
RULES = (
    Rule("word_length", "word_chars", "n_words", 250, 1500),
    Rule("symbols", "n_symbols", "n_words", None, 10),
    Rule("stop_words", "n_stop_words", "n_words", 3, None),
    Rule("letters", "n_letter_words", "n_words", 60, None),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", None, 30),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", None, 30),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", None, 90),
)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(words: Column) -> Column:
    """How many words lie in windows of WINDOW words that stand at least twice in the list.

    Digests of the windows tell whether any can; then the windows themselves are sorted, with their digests before them so
    that few words are compared, and a window is repeated if its neighbour is the same.
    """
    starts = F.sequence(F.lit(0), F.size(words) - WINDOW)
    window = lambda i: F.slice(words, i + 1, WINDOW)
    placed = F.sort_array(F.transform(starts, lambda i: F.struct(F.xxhash64(window(i)).alias("h"), window(i).alias("w"), i.alias("i"))))
    same = lambda x, y: F.coalesce((x["h"] == y["h"]) & (x["w"] == y["w"]), F.lit(False))
    twice = lambda s: F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1))), lambda x: x["i"]))
    width = lambda p: F.aggregate(F.transform(p, lambda a, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - a, F.lit(WINDOW)))), F.lit(0), lambda n, x: n + x)
    some = _let(F.transform(starts, lambda i: F.xxhash64(window(i))), lambda h: F.size(F.array_distinct(h)) < F.size(h))
    return F.when(F.size(words) < WINDOW, F.lit(0)).when(some, _let(placed, lambda s: _let(twice(s), width))).otherwise(0)


def _verdict(rule: Rule) -> Column:
    """Whether a row breaks a rule."""
    value, unit = 100 * F.col(rule.measure), F.col(rule.unit)
    low = value < rule.least * unit if rule.least is not None else F.lit(False)
    high = value > rule.most * unit if rule.most is not None else F.lit(False)
    return (unit > 0) & (low | high)


def quality_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, payload: bool = False) -> DataFrame:
    """Measures of every whole text, the rules it breaks and whether it is kept.

    Result: doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, n_letter_words,
    n_ellipsis_lines, n_bullet_lines (long), base_failed, broken (names of broken rules, in the order of ``rules``), kept. Lines are
    what stands between line feeds and holds a word; words and lines are compared as they are. ``base_failed``: too few words or too
    many in repeated windows; ``kept``: neither that nor a broken rule. ``payload`` adds the table's other columns, but those named,
    in any case, as a column of the result or beginning with ``_rule``.

    One projection over one scan, no user function, nothing shuffled. A null or empty text has no words and fails; a text
    without lines breaks no rule on lines. Null ids, ties and repeated rows each give their row; no rows give none.
    """
    made = ["doc_id", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words", "n_letter_words", "n_ellipsis_lines", "n_bullet_lines", "base_failed", "broken", "kept"]
    extra = [c for c in docs.columns if payload and c.lower() not in made and not c.lower().startswith("_rule")]
    text = F.coalesce(F.col("text"), F.lit(""))
    # names that no extra column has
    cut = docs.select("doc_id", *[F.col(f"`{c}`") for c in extra], text.alias("_rule_text"))
    cut = cut.withColumns({"_rule_words": F.filter(F.split("_rule_text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), "_rule_lines": F.filter(F.split("_rule_text", "\n"), lambda x: x.rlike(WORD))})
    words, lines, size = F.col("_rule_words"), F.col("_rule_lines"), F.length("_rule_text")
    among = lambda items, test: F.size(F.filter(items, test))
    measures = {
        "n_words": F.size(words),
        "word_chars": F.length(F.translate("_rule_text", BLANKS, "")),
        "n_symbols": size - F.length(F.translate("_rule_text", SYMBOLS, "")),
        "n_lines": F.size(lines),
        "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
        "n_repeat_words": _covered(words),
        "n_stop_words": among(words, lambda w: F.translate(w, UPPER, LOWER).isin(*STOP_WORDS)),
        "n_letter_words": among(words, lambda w: w.rlike(LETTER)),
        "n_ellipsis_lines": among(lines, lambda x: reduce(or_, (F.rtrim(x, F.lit(BLANKS)).endswith(e) for e in ELLIPSES))),
        "n_bullet_lines": among(lines, lambda x: x.rlike(BULLET)),
    }
    seen = cut.select("doc_id", *[F.col(f"`{c}`") for c in extra], *[m.cast("long").alias(name) for name, m in measures.items()])
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    broken = F.filter(F.array(*[F.when(_verdict(r), F.lit(r.name)) for r in rules]).cast("array<string>"), lambda x: x.isNotNull())
    told = seen.withColumns({"base_failed": failed, "broken": broken})
    return told.select("doc_id", *[F.col(f"`{c}`") for c in extra], *made[1:-1], (~F.col("base_failed") & (F.size("broken") == 0)).alias("kept"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under the table of thresholds."""
    found = quality_rules(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.array_join("broken", ",").alias("broken"), "kept")


def _broken_sql(rule: Rule) -> str:
    bounds = [f"100 * {rule.measure} < {rule.least} * {rule.unit}"] * (rule.least is not None) + [f"100 * {rule.measure} > {rule.most} * {rule.unit}"] * (rule.most is not None)
    return f"CASE WHEN {rule.unit} > 0 AND ({' OR '.join(bounds)}) THEN '{rule.name}' END"


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
e AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
p AS (SELECT r, unnest(words) AS w, unnest(range(len(words))) AS i FROM e WHERE len(words) >= {WINDOW}),
o AS (SELECT r, i, {" || ' ' || ".join(["w"] + [f"lead(w, {k}) OVER o" for k in range(1, WINDOW)])} AS win FROM p WINDOW o AS (PARTITION BY r ORDER BY i)),
g AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS n FROM o WHERE win IS NOT NULL),
c AS (SELECT r, CAST(sum(least({WINDOW}, coalesce(nx - i, {WINDOW}))) AS BIGINT) AS n_repeat_words FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM g WHERE n > 1) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS word_chars,
             length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(words, lambda w: translate(w, '{UPPER}', '{LOWER}') IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS n_stop_words,
             len(list_filter(words, lambda w: regexp_matches(w, '{LETTER}'))) AS n_letter_words,
             len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*\z'))) AS n_ellipsis_lines, len(list_filter(lines, lambda x: regexp_matches(x, '{BULLET}'))) AS n_bullet_lines
      FROM e LEFT JOIN c USING (r)),
v AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed, concat_ws(',', {", ".join(map(_broken_sql, RULES))}) AS broken FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, broken, NOT base_failed AND broken = '' AS kept FROM v
"""
