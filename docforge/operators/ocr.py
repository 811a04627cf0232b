"""Recognition: the engine's contract, and its nested result as lines."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators.blocks import upper_median

LINE = "struct<text:string,words:array<struct<font_size:double>>>"
RESULT = f"text string, confidence double, blocks array<struct<paragraphs:array<struct<lines:array<{LINE}>>>>>"


def font_size(words: Column) -> Column:
    """The median of known sizes of a line's words; 0 for none."""
    return upper_median(F.transform(F.filter(words, lambda w: w["font_size"] > 0), lambda w: w["font_size"]))


def line_sizes(lines: DataFrame) -> DataFrame:
    return lines.withColumn("size", font_size(F.col("words")))


def page_lines(blocks: Column, blank_lines: bool = False) -> Column:
    """para_no, text, size of a page's lines that hold text, as an array in order; with ``blank_lines`` of all others, too. Paragraphs without such lines have no number."""
    paras = F.flatten(F.transform(F.filter(blocks, lambda b: b.isNotNull()), lambda b: F.coalesce(b["paragraphs"], F.array().cast(f"array<struct<lines:array<{LINE}>>>"))))
    line = lambda x: F.struct(T.squeeze(F.coalesce(x["text"], F.lit(""))).alias("text"), font_size(x["words"]).alias("size"))
    own = F.transform(paras, lambda p: F.transform(F.coalesce(p["lines"], F.array().cast(f"array<{LINE}>")), line))
    if not blank_lines:
        own = F.transform(own, lambda p: F.filter(p, lambda x: x["text"] != ""))
    numbered = lambda p, k: F.transform(p, lambda x: F.struct(k.cast("long").alias("para_no"), x["text"].alias("text"), x["size"].alias("size")))
    return F.flatten(F.transform(F.filter(own, lambda p: F.size(p) > 0), numbered))


def flatten(results: DataFrame, blank_lines: bool = False) -> DataFrame:
    """doc_id, page_no, para_no, line_no, text, size of all lines that hold text, numbered over those; with ``blank_lines`` of all others, too."""
    rows = results.select("doc_id", "page_no", F.posexplode(page_lines(F.col("blocks"), blank_lines)).alias("line_no", "l"))
    return rows.select("doc_id", "page_no", "l.para_no", F.col("line_no").cast("long").alias("line_no"), "l.text", "l.size")


def confidence(c: Column) -> Column:
    return F.floor(c + 0.5).cast("long")


def recognize(images: DataFrame, engine: Callable[[], Callable[[bytes, str, str], dict]], lang: str, psm: str) -> DataFrame:
    """Adds the engine's result to images (content): ok, error and the fields of RESULT.

    ``engine`` makes a recogniser once a task; a failing image yields its error, not a failed job. Where images have an error of their own (column error),
    they keep it, and those without content have no result and no other error.
    """
    given = "error" in images.columns
    shape = images.drop("content", "error").schema
    line = pa.struct([("text", pa.string()), ("words", pa.list_(pa.struct([("font_size", pa.float64())])))])
    result = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("text", pa.string()), ("confidence", pa.float64()), ("blocks", pa.list_(pa.struct([("paragraphs", pa.list_(pa.struct([("lines", pa.list_(line))])))])))])

    def shaped(rows: list[dict]) -> pa.Array:
        try:
            return pa.array(rows, result, from_pandas=True)
        except Exception:  # noqa: BLE001  (the row with the fault is looked for)
            for k, row in enumerate(rows):
                try:
                    pa.array([row], result, from_pandas=True)
                except Exception as e:  # noqa: BLE001  (kept as a value of the row)
                    rows[k] = {"ok": False, "error": str(e)}
            return pa.array(rows, result, from_pandas=True)

    def run(batches: Iterator[pa.RecordBatch]):
        recogniser = engine()
        for batch in batches:
            out = []
            errors = batch.column("error").to_pylist() if given else [None] * batch.num_rows
            for content, error in zip(batch.column("content"), errors, strict=True):
                if given and (error is not None or not content.is_valid):
                    out.append({"ok": error is None, "error": error})
                    continue
                try:
                    out.append({"ok": True, "error": None, **recogniser(bytes(content.as_py()), lang, psm)})
                except Exception as e:  # noqa: BLE001  (kept as a value of the row)
                    out.append({"ok": False, "error": str(e)})
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in shape.fields), *shaped(out).flatten()], [*shape.fieldNames(), *(f.name for f in result)])

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in shape.fields)
    return images.mapInArrow(run, f"{own}ok boolean, error string, {RESULT}")


def recognize_by_language(images: DataFrame, engine: Callable[[str], Callable[[bytes, str], dict]], psm: str) -> DataFrame:
    """``recognize`` for images that name their language (column lang; several as a+b).

    ``engine(lang)`` makes a recogniser of one language. Images are dealt by language, a frequent one over many tasks, and sorted by it within each, so a
    task makes an engine only where the language changes and holds one at a time: at most as many as it has languages. One with a
    ``close`` is closed before the next is made, and at the end. A language that gives no engine fails its own images, a null one among them.
    """
    shape = images.drop("content").schema
    lang = images.columns.index("lang")

    def run(batches: Iterator):
        import pandas as pd

        held, made, fault = None, None, None

        def close():
            if made is not None and hasattr(made, "close"):
                made.close()

        for pdf in batches:
            out = []
            for content, own in zip(pdf["content"], pdf.iloc[:, lang], strict=True):
                if (own,) != held:
                    close()
                    held, made, fault = (own,), None, None
                    try:
                        made = engine(own)
                    except Exception as e:  # noqa: BLE001  (kept as a value of the language's rows)
                        fault = str(e)
                try:
                    if made is None:
                        raise ValueError(fault)
                    out.append({"ok": True, "error": None, **made(bytes(content), psm)})
                except Exception as e:  # noqa: BLE001  (kept as a value of the row)
                    out.append({"ok": False, "error": str(e), "text": None, "confidence": None, "blocks": None})
            yield pd.concat([pdf.drop(columns="content").reset_index(drop=True), pd.DataFrame(out)], axis=1)
        close()

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in shape.fields)
    dealt = images.repartitionByRange("lang", F.xxhash64("content"))
    return dealt.sortWithinPartitions("lang").mapInPandas(run, f"{own}, ok boolean, error string, {RESULT}")
