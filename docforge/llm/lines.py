"""Substring dedup by hashing lines, sentences or paragraphs: of each repeated unit the earliest occurrence stays."""

from __future__ import annotations

import itertools
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, holding, parted, written

#: What ends a unit, if not the text's end: all units together are the whole text.
ENDS = {"line": r"\n", "sentence": r"[.!?][\x20\x09-\x0D]+|\n", "paragraph": r"\n{2,}"}
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: The least words of a run of repeated units that is removed. Short lines and stock phrases recur by chance or for good
#: reason; half of a passage of fifty words is what is left of it where both ends are cut in the middle of a sentence.
LEAST_WORDS = 25


def _cutter(unit: str, least_words: int):
    """Arrow batches (text, numbers of its units with an earlier occurrence, ...) with what is kept, the units removed and their spans in place of both."""
    end_of = re.compile(ENDS[unit])

    def runs(text: str, gone: set[int]):
        """(start, end, units, words) of each run of units in ``gone``; blank units break none."""
        at, start, stop, n, words = 0, 0, 0, 0, 0
        for no, end in enumerate(itertools.chain((m.end() for m in end_of.finditer(text)), [len(text)])):
            before, at = at, end
            if no in gone:
                start, stop, n, words = (start if n else before), at, n + 1, words + len(WORD.findall(text, before, at))
            elif n and WORD.search(text, before, at):
                yield start, stop, n, words
                n, words = 0, 0
        if n:
            yield start, stop, n, words

    def run(batches):
        for batch in batches:
            kept, n_removed, spans = [], [], []
            for text, gone in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = [x for x in runs(text, set(gone)) if x[3] >= least_words] if gone else []
                edges = [0, *(e for start, end, _, _ in own for e in (start, end)), len(text)]
                kept.append("".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                n_removed.append(sum(x[2] for x in own))
                spans.append(",".join(f"{start}:{end}" for start, end, _, _ in own))
            arrays = [pa.array(kept, pa.string()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.string()), *batch.columns[2:]]
            yield pa.RecordBatch.from_arrays(arrays, ["kept_text", "n_removed", "removed_spans", *batch.schema.names[2:]])

    return run


def repeated_units(docs: DataFrame, unit: str = "sentence", payload: bool = False, least_words: int = LEAST_WORDS) -> DataFrame:
    """Remove the runs of units whose normalised forms all occur earlier, ordered by (doc_id, row, unit number).

    A ``unit`` is a line, a sentence (a line also ends after ., ! or ? and white space) or a paragraph, with the white space that
    ends it. It is normalised by lower-casing A-Z and reducing runs of white space to one space, trimmed; a unit that is
    blank breaks no run. Consecutive units with an earlier occurrence are a run, which goes if it has ``least_words`` words; with 0 every
    repeated unit goes, however short.

    Digests of normalised units are grouped with partial aggregation, so a unit that a third of all rows hold costs one row
    a task. Of all units' places only those whose digest a bitmap of the repeated ones holds are joined with the earliest, in a join of
    two plain tables, which adaptive execution splits where a digest is frequent. What comes back for a row are the numbers of its own
    units to go, if they have words enough for a run; only such a row's text moves, and is cut where it then lies. Rows are numbered
    once and written, so null and equal ids are as good as distinct ones.

    Result for each row: doc_id, n_units, n_removed (units), removed_spans (start:end of the removed runs in the original
    text, in characters, end exclusive, joined by commas), kept_text (the rest, in order). A null or empty text has no
    units. Rows of equal ids, and repeated rows, rank in the order they are read in; a null id ranks last. No rows give
    none. With ``payload`` the table's other columns follow, but those named, in any case, as a column of the result or beginning with
    ``_unit``.
    """
    extra = [c for c in docs.columns if payload and c.lower() not in ("doc_id", "text", "n_units", "n_removed", "removed_spans", "kept_text") and not c.lower().startswith("_unit")]
    text = F.coalesce("text", F.lit(""))
    pieces = lambda c: F.filter(F.regexp_extract_all(c, F.lit(f"(?s).*?(?:{ENDS[unit]}|\\z)"), F.lit(0)), lambda x: x != "")
    base = docs.select(F.monotonically_increasing_id().alias("_unit_row"), "doc_id", *extra, text.alias("_unit_text"), F.size(pieces(text)).cast("long").alias("n_units"))
    base = written(base, "rows")  # numbered once: a later scan of the input may split it otherwise
    low = F.translate("_unit_text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.transform(pieces(low), lambda x: F.filter(F.split(x, BLANKS), lambda w: w != ""))  # an array each, so that no unit is split twice
    unit_of = F.transform(words, lambda w: F.struct(F.size(w).alias("words"), F.unhex(F.md5(F.array_join(w, " ").cast("binary"))).alias("digest")))
    units = base.select("_unit_row", "doc_id", F.posexplode(unit_of).alias("no", "unit")).where("unit.words > 0")
    keyed = written(units.select("_unit_row", "doc_id", "no", "unit.words", "unit.digest"), "units")
    rank = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_unit_row", "no")
    first = keyed.groupBy("digest").agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = written(first.select("digest", F.col("first._unit_row").alias("first_row"), F.col("first.no").alias("first_no")), "first")
    later = holding(keyed, "digest", first.select("digest")).join(first, "digest").where((F.col("_unit_row") != F.col("first_row")) | (F.col("no") != F.col("first_no")))
    gone = later.groupBy("_unit_row").agg(F.collect_list("no").alias("_unit_gone"), F.sum("words").alias("words")).where(F.col("words") >= least_words)
    gone = written(gone.select("_unit_row", "_unit_gone"), "gone")
    maybe, others = parted(base, "_unit_row", gone.select("_unit_row"))  # texts that lose nothing stay where they are
    columns = ["doc_id", *extra, "n_units"]
    shape = others.select(F.col("_unit_text").alias("kept_text"), F.lit(0).cast("long").alias("n_removed"), F.lit("").alias("removed_spans"), *columns)
    cut = maybe.join(gone, "_unit_row", "left").select("_unit_text", "_unit_gone", *columns).mapInArrow(_cutter(unit, least_words), shape.schema)
    return cut.unionByName(shape).select(*columns, "n_removed", "removed_spans", "kept_text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents by lines and their sentences, with a digest in place of the kept text."""
    found = repeated_units(documents(spark, sf_dir).select("doc_id", "text"))
    return found.select("doc_id", "n_units", "n_removed", "removed_spans", F.octet_length("kept_text").cast("long").alias("n_kept_bytes"), F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH e AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_extract_all(coalesce(text, ''), '(?s).*?(?:[.!?][\x20\x09-\x0D]+|\n|\z)'), lambda x: x <> '') AS l FROM documents),
u AS (SELECT doc_id, unnest(l) AS raw, unnest(range(len(l))) AS no FROM e),
p AS (SELECT doc_id, no, raw, regexp_replace(regexp_replace(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '^ | $', '', 'g') AS norm FROM u),
f AS (SELECT *, norm <> '' AND row_number() OVER (PARTITION BY norm ORDER BY doc_id NULLS LAST, no) > 1 AS gone FROM p),
q AS (SELECT *, sum(length(raw)) OVER (PARTITION BY doc_id ORDER BY no) AS stop, sum(CASE WHEN gone OR norm = '' THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY no) AS run FROM f),
r AS (SELECT doc_id, run, CAST(min(stop - length(raw)) FILTER (WHERE gone) AS BIGINT) AS a, CAST(max(stop) FILTER (WHERE gone) AS BIGINT) AS b,
             sum(length(norm) - length(replace(norm, ' ', '')) + 1) FILTER (WHERE gone) AS words, count(*) FILTER (WHERE gone) AS n_gone FROM q GROUP BY doc_id, run),
s AS (SELECT doc_id, CAST(sum(n_gone) AS BIGINT) AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) AS spans, list(b ORDER BY a) AS ends, list(a ORDER BY a) AS starts FROM r WHERE words >= 25 GROUP BY doc_id),
k AS (SELECT e.doc_id, len(l) AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(spans, '') AS removed_spans,
             CASE WHEN spans IS NULL THEN text ELSE array_to_string(list_transform(range(len(starts) + 1), lambda i:
               substring(text, CASE WHEN i = 0 THEN 1 ELSE ends[i] + 1 END, CASE WHEN i = len(starts) THEN length(text) ELSE starts[i + 1] - CASE WHEN i = 0 THEN 0 ELSE ends[i] END END)), '') END AS kept
      FROM e LEFT JOIN s ON e.doc_id IS NOT DISTINCT FROM s.doc_id)
SELECT doc_id, n_units, n_removed, removed_spans, CAST(strlen(kept) AS BIGINT) AS n_kept_bytes, sha256(kept) AS kept_sha256 FROM k
"""
