"""Queries of the scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import files as FI
from docforge.options import LANGS

from . import duck as D
from . import fixtures as X

QUERIES, SQL = {}, {}


def query(name, sql):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


def names(spark, d):
    k = F.col("seq") % 5
    name = F.when(k == 1, F.concat(F.lit("a/b: "), "name")).when(k == 2, F.lit(".png")).when(k == 3, F.concat(F.lit(' x?"<y>|.tar'), "name", F.lit("  "))).when(k == 4, F.concat(F.lit("\x01 "), "name", F.lit(".MD\t\x02"))).otherwise(F.col("name"))
    return X.files(spark, d).select("seq", "mime", "size", name.alias("name"))


NAMES = "WITH " + X.FILES_SQL + """, names AS (SELECT seq, mime, size, CASE seq % 5 WHEN 1 THEN 'a/b: ' || name WHEN 2 THEN '.png' WHEN 3 THEN ' x?"<y>|.tar' || name || '  ' WHEN 4 THEN chr(1) || ' ' || name || '.MD' || chr(9) || chr(2) ELSE name END AS name FROM files) """
LINES = "WITH " + X.LINES_SQL + " "
MARKUP = "'**' || replace(text, ' ', CASE WHEN line_no % 3 = 0 THEN '  ' || chr(10) ELSE ' ' END) || '** `a<b>` *' || line_no || '* \\# \\> & "


def markup(spark, d):
    text = F.replace("text", F.lit(" "), F.when(F.col("line_no") % 3 == 0, F.lit("  \n")).otherwise(F.lit(" ")))
    return X.lines(spark, d).select("doc_id", "line_no", F.concat(F.lit("**"), text, F.lit("** `a<b>` *"), F.col("line_no").cast("string"), F.lit("* \\# \\> & ")).alias("text"))


@query("normalize_raw", "WITH " + X.RAW_PAGES_SQL + f" SELECT doc_id, page_no, {D.normalize_raw('text')} AS normalized FROM raw_pages")
def _(spark, d):
    return X.raw_pages(spark, d).select("doc_id", "page_no", T.normalize_raw(F.col("text")).alias("normalized"))


@query("base_name", NAMES + f"SELECT seq, {D.base_name('name')} AS base FROM names")
def _(spark, d):
    return names(spark, d).select("seq", T.base_name(F.col("name")).alias("base"))


@query("safe_file_name", NAMES + f"SELECT seq, {D.safe_file_name('name')} AS safe FROM names")
def _(spark, d):
    return names(spark, d).select("seq", T.safe_file_name(F.col("name")).alias("safe"))


@query("safe_file_name_native", NAMES + f"SELECT seq, {D.safe_file_name_native('name')} AS safe FROM names")
def _(spark, d):
    return names(spark, d).select("seq", T.safe_file_name_native(F.col("name")).alias("safe"))


@query("escape_block_start", LINES + f"SELECT doc_id, line_no, {D.escape_block_start('text')} AS escaped FROM lines")
def _(spark, d):
    return X.lines(spark, d).select("doc_id", "line_no", T.escape_block_start(F.col("text")).alias("escaped"))


@query("line_markers", LINES + f"SELECT doc_id, line_no, {D.bullet('text')} AS bullet, {D.numbered('text')} AS number, {D.leading_marker('text')} AS marker FROM lines")
def _(spark, d):
    c = F.col("text")
    return X.lines(spark, d).select("doc_id", "line_no", T.bullet(c).alias("bullet"), T.numbered(c).alias("number"), T.leading_marker(c).alias("marker"))


@query("looks_like_heading", LINES + ", wide AS (SELECT doc_id, line_no, text || repeat('\U0001d54a', line_no % 25) AS text FROM lines) " + f"SELECT doc_id, line_no, {D.looks_like_heading('text')} AS heading FROM wide")
def _(spark, d):
    wide = F.concat("text", F.repeat(F.lit("\U0001d54a"), (F.col("line_no") % 25).cast("int")))
    return X.lines(spark, d).select("doc_id", "line_no", T.looks_like_heading(wide).alias("heading"))


@query("looks_unfinished", LINES + f"SELECT doc_id, line_no, {D.looks_unfinished('text')} AS unfinished FROM lines")
def _(spark, d):
    return X.lines(spark, d).select("doc_id", "line_no", T.looks_unfinished(F.col("text")).alias("unfinished"))


@query("join_lines", LINES + f"""SELECT doc_id, page_no, para_no, {D.join_lines('list(text ORDER BY line_no)')} AS joined, {D.join_lines('list(text ORDER BY line_no)', False, False)} AS broken
FROM lines GROUP BY doc_id, page_no, para_no""")
def _(spark, d):
    g = X.lines(spark, d).groupBy("doc_id", "page_no", "para_no").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    g = g.select("doc_id", "page_no", "para_no", F.transform("x", lambda s: s["text"]).alias("l"))
    return g.select("doc_id", "page_no", "para_no", T.join_lines(F.col("l")).alias("joined"), T.join_lines(F.col("l"), False, False).alias("broken"))


@query("yaml_string", LINES + f"SELECT doc_id, line_no, {D.yaml_string("replace(replace(text, 'a', chr(34)), 'o', chr(92))")} AS quoted FROM lines")
def _(spark, d):
    return X.lines(spark, d).select("doc_id", "line_no", T.yaml_string(F.replace(F.replace("text", F.lit("a"), F.lit('"')), F.lit("o"), F.lit("\\"))).alias("quoted"))


@query("describe_lang", "WITH " + X.FILES_SQL + f" SELECT seq, {D.describe_lang(f'{[*LANGS, "slk"]}[seq % 6 + 1]')} AS language FROM files")
def _(spark, d):
    code = F.element_at(F.array(*map(F.lit, [*LANGS, "slk"])), (F.col("seq") % 6 + 1).cast("int"))
    return X.files(spark, d).select("seq", T.describe_lang(code).alias("language"))


@query("format_datetime", "SELECT event_id, strftime(ts, '%Y. %m. %d. %H:%M') AS said FROM events")
def _(spark, d):
    return X.table(spark, d, "events").select("event_id", T.format_datetime(F.col("ts")).alias("said"))


@query("format_size", f"SELECT o_orderkey, o_custkey, {D.format_size('n')} AS said FROM (SELECT o_orderkey, o_custkey, CAST(floor(o_totalprice * (o_orderkey % 5 * o_orderkey % 5)) AS BIGINT) AS n FROM orders)")
def _(spark, d):
    k = F.col("o_orderkey")
    return X.table(spark, d, "orders").select("o_orderkey", "o_custkey", F.floor(F.col("o_totalprice") * (k % 5 * k % 5)).cast("long").alias("n")).select("o_orderkey", "o_custkey", T.format_size(F.col("n")).alias("said"))


@query("escape_html", LINES + f"SELECT doc_id, line_no, {D.escape_html(MARKUP + "'")} AS html FROM lines")
def _(spark, d):
    return markup(spark, d).select("doc_id", "line_no", T.escape_html(F.col("text")).alias("html"))


@query("md_inline", LINES + f"SELECT doc_id, line_no, {D.md_inline(MARKUP + "'")} AS html FROM lines")
def _(spark, d):
    return markup(spark, d).select("doc_id", "line_no", T.md_inline(F.col("text")).alias("html"))


def _cases(types):
    return " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in types.items())


@query("mime_by_ext", "WITH " + X.FILES_SQL + f""", e AS (SELECT seq, lower(regexp_extract(name, '\\.([^.]*)$', 1)) AS e FROM files)
SELECT seq, CASE e {_cases(FI.SERVER_TYPES)} ELSE 'application/octet-stream' END AS server, CASE e {_cases(FI.DEVICE_TYPES)} ELSE 'application/octet-stream' END AS device FROM e""")
def _(spark, d):
    return X.files(spark, d).select("seq", FI.mime_by_extension("name", FI.SERVER_TYPES).alias("server"), FI.mime_by_extension("name", FI.DEVICE_TYPES).alias("device"))


def paths(spark, d):
    k = F.col("seq") % 6
    path = F.when(k == 0, F.lit("/")).when(k == 1, F.concat(F.lit("/../"), "name")).when(k == 2, F.lit("")).when(k == 3, F.lit("/missing.txt")).otherwise(F.concat(F.lit("/"), "name"))
    return X.files(spark, d).select("seq", path.alias("path"), "name")


@query("route_request", "WITH " + X.FILES_SQL + """, p AS (SELECT seq, CASE seq % 6 WHEN 0 THEN '/' WHEN 1 THEN '/../' || name WHEN 2 THEN '' WHEN 3 THEN '/missing.txt' ELSE '/' || name END AS path FROM files),
q AS (SELECT seq, CASE WHEN path IN ('', '/') THEN '/index.html' ELSE path END AS path FROM p)
SELECT seq, q.path, CASE WHEN contains(q.path, '..') THEN 403 WHEN q.path = '/index.html' OR substr(q.path, 2) IN (SELECT name FROM files) THEN 200 ELSE 404 END AS status FROM q""")
def _(spark, d):
    return FI.route(paths(spark, d), X.files(spark, d).select("name").distinct()).select("seq", "path", "status")


@query("line_font_size", LINES + """SELECT doc_id, page_no, line_no, CASE WHEN len(s) = 0 THEN 0 ELSE s[len(s) // 2 + 1] END AS size FROM (
SELECT doc_id, page_no, line_no, list_sort(list_filter(list_transform(range(len(string_split(text, ' '))), lambda i: CASE WHEN i % 6 <> 5 THEN size + i % 3 END), lambda v: v > 0)) AS s FROM lines)""")
def _(spark, d):
    from docforge.operators import ocr

    return ocr.line_sizes(X.ocr_lines(spark, d)).select("doc_id", "page_no", "line_no", "size")
