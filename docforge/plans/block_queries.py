"""Queries of the block, Markdown and HTML builders."""

from __future__ import annotations

from pyspark.sql import functions as F

from docforge.functions import text as T
from docforge.operators import blocks as B
from docforge.operators import html as H
from docforge.operators import markdown as M
from docforge.options import Options

from . import duck as D
from . import fixtures as X

QUERIES, SQL = {}, {}
AT = "2024-03-05 06:07:08"


def query(name, sql):
    def keep(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return keep


OVER = "OVER (PARTITION BY doc_id, page_no ORDER BY line_no)"
RUN = "OVER (PARTITION BY doc_id, page_no ORDER BY line_no ROWS UNBOUNDED PRECEDING)"


def regroup_sql(source: str) -> str:
    """CTEs over the lines of ``source``, up to regrouped (blocks with their lines)."""
    return f"""
b1 AS (SELECT *, list_sort(list_filter(list(size) OVER (PARTITION BY doc_id, page_no), lambda s: s > 0)) AS ss FROM {source}),
b1b AS (SELECT * EXCLUDE (ss), CASE WHEN len(ss) = 0 THEN 0.0 ELSE ss[len(ss) // 2 + 1] END AS base FROM b1),
b2 AS (SELECT *, base > 0 AND size >= base * 1.08::DOUBLE AND length(text) <= 80 AND NOT regexp_matches(text, '[.!?,;]$') AS big FROM b1b),
b3 AS (SELECT *, CASE WHEN NOT big THEN 0 WHEN size >= base * 1.22::DOUBLE THEN 2 ELSE 3 END AS heading, big OR coalesce(lag(big) {OVER}, true) OR lag(para_no) {OVER} IS DISTINCT FROM para_no AS starts FROM b2),
b4 AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) {RUN} AS block_no, lag(text) {OVER} AS bt, lag(heading) {OVER} AS bh FROM b3),
b5 AS (SELECT *, starts AND NOT coalesce(bh = 0 AND heading = 0 AND {D.leading_marker("text")} IS NULL AND {D.continues("text")} AND {D.looks_unfinished("bt")}, false) AS opens FROM b4),
b6 AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) {RUN} AS merged_no, {D.leading_marker("text")} AS mk FROM b5),
b7 AS (SELECT *, CASE WHEN bool_and(mk IS NOT NULL AND heading = 0) OVER (PARTITION BY doc_id, page_no, merged_no) THEN first_value(mk) OVER (PARTITION BY doc_id, page_no, merged_no ORDER BY line_no) END AS marker FROM b6),
b8 AS (SELECT *, lag(marker) {OVER} AS bm FROM b7),
b9 AS (SELECT *, sum(CASE WHEN opens AND NOT coalesce(marker = bm, false) THEN 1 ELSE 0 END) {RUN} AS group_no FROM b8),
regrouped AS (SELECT doc_id, page_no, group_no AS block_no, arg_min(heading, line_no) AS heading, first(marker ORDER BY line_no) AS marker, list(text ORDER BY line_no) AS lines FROM b9 GROUP BY doc_id, page_no, group_no)"""


def markdown_sql(source: str, shift: str = "0") -> str:
    """CTEs from blocks of ``source`` to made (markdown of each)."""
    own = f"({D.bullet('x')} <> '' OR coalesce(starts_with(x, mis || ' '), false))"
    bullet = f"regexp_replace(b, '^[^{D.WS}][{D.WS}]+', '')"
    number = f"regexp_replace(b, '^[0-9]{{1,3}}[.)][{D.WS}]+', '')"
    start = "CASE WHEN a = '' THEN '' ELSE chr(10) END"
    fold = f"""list_reduce(list_prepend('', ls), lambda a, b: CASE WHEN {own.replace("(x", "(b").replace("x,", "b,")} THEN a || {start} || '- ' || {D.trim(bullet)}
 WHEN {D.numbered('b')} <> '' THEN a || {start} || {D.numbered('b')} || '. ' || {D.trim(number)} WHEN a <> '' THEN {D.glue('a', 'b')} ELSE '- ' || b END)"""
    return f"""
m1 AS (SELECT * EXCLUDE (lines), list_filter(list_transform(lines, lambda y: {D.normalize_line('y')}), lambda z: z <> '') AS ls FROM {source}),
m2 AS (SELECT *, {D.misread('ls')} AS mis FROM m1),
m3 AS (SELECT *, len(list_filter(ls, lambda x: {own} OR {D.numbered('x')} <> '')) AS marked FROM m2),
made AS (SELECT doc_id, page_no, block_no, CASE WHEN len(ls) = 0 THEN '' WHEN heading > 0 THEN repeat('#', least(6, heading + {shift})) || ' ' || array_to_string(ls, ' ')
 WHEN marked >= 2 AND marked * 2 >= len(ls) THEN {fold} WHEN len(ls) = 1 AND {D.looks_like_heading('ls[1]')} THEN '### ' || ls[1] ELSE {D.escape_block_start(D.join_lines('ls'))} END AS markdown FROM m3)"""


PAGE_SQL = "page_md AS (SELECT doc_id, page_no, string_agg(markdown, chr(10) || chr(10) ORDER BY block_no) AS markdown FROM made WHERE markdown <> '' GROUP BY doc_id, page_no)"
LINES = "WITH " + X.LINES_SQL
REGROUP = LINES + "," + regroup_sql("lines")


@query("page_base_size", REGROUP + " SELECT DISTINCT doc_id, page_no, base FROM b1b")
def _(spark, d):
    g = X.lines(spark, d).groupBy("doc_id", "page_no").agg(B.upper_median(F.collect_list(F.when(F.col("size") > 0, F.col("size")))).alias("base"))
    return g


@query("upper_median", "SELECT o_custkey, list_sort(list(o_totalprice))[count(*) // 2 + 1] AS med FROM orders GROUP BY o_custkey")
def _(spark, d):
    return B.upper_median_by(X.table(spark, d, "orders"), "o_custkey", "o_totalprice", "med")


@query("big_lines", REGROUP + " SELECT doc_id, page_no, line_no, big FROM b2")
def _(spark, d):
    return B.with_base(X.lines(spark, d)).select("doc_id", "page_no", "line_no", B.is_big().alias("big"))


@query("split_blocks", REGROUP + " SELECT doc_id, page_no, line_no, heading, CAST(block_no AS BIGINT) AS block_no FROM b4")
def _(spark, d):
    return B.with_split(X.lines(spark, d)).select("doc_id", "page_no", "line_no", "heading", "block_no")


@query("merge_blocks", REGROUP + " SELECT doc_id, page_no, line_no, CAST(merged_no AS BIGINT) AS merged_no FROM b6")
def _(spark, d):
    return B.with_merge(X.lines(spark, d)).select("doc_id", "page_no", "line_no", "merged_no")


@query("group_list_blocks", REGROUP + " SELECT doc_id, page_no, line_no, marker, CAST(group_no AS BIGINT) AS group_no FROM b9")
def _(spark, d):
    return B.with_groups(X.lines(spark, d)).select("doc_id", "page_no", "line_no", "marker", "group_no")


@query("regroup_blocks", REGROUP + " SELECT doc_id, page_no, CAST(block_no AS BIGINT) AS block_no, heading, marker, array_to_string(lines, chr(10)) AS text FROM regrouped")
def _(spark, d):
    return B.regroup(X.lines(spark, d)).select("doc_id", "page_no", "block_no", "heading", "marker", F.array_join("lines", "\n").alias("text"))


@query("misread_bullet", REGROUP + f", mb AS (SELECT doc_id, page_no, para_no, list(text ORDER BY line_no) AS ls FROM lines GROUP BY ALL) SELECT doc_id, page_no, para_no, {D.misread('ls')} AS misread FROM mb")
def _(spark, d):
    g = X.lines(spark, d).groupBy("doc_id", "page_no", "para_no").agg(F.sort_array(F.collect_list(F.struct("line_no", "text"))).alias("x"))
    g = g.select("doc_id", "page_no", "para_no", F.transform("x", lambda s: s["text"]).alias("lines"))
    return B.with_misread(g).select("doc_id", "page_no", "para_no", "misread")


def clean_blocks(spark, d):
    return B.regroup(X.lines(spark, d), clean=True)


@query("block_markdown", REGROUP + "," + markdown_sql("regrouped") + " SELECT doc_id, page_no, CAST(block_no AS BIGINT) AS block_no, markdown FROM made")
def _(spark, d):
    return M.with_markdown(clean_blocks(spark, d)).select("doc_id", "page_no", "block_no", "markdown")


@query("list_items", REGROUP + "," + markdown_sql("regrouped") + """ SELECT doc_id, page_no, CAST(block_no AS BIGINT) AS block_no, unnest(range(len(string_split(markdown, chr(10))))) AS item_no, unnest(string_split(markdown, chr(10))) AS item
FROM made WHERE (doc_id, page_no, block_no) IN (SELECT (doc_id, page_no, block_no) FROM m3 WHERE heading = 0 AND marked >= 2 AND marked * 2 >= len(ls))""")
def _(spark, d):
    df = B.with_misread(clean_blocks(spark, d).where("heading = 0")).withColumn("marked", M.marked_lines(F.col("lines"), F.col("misread")))
    df = df.where((F.col("marked") >= 2) & (F.col("marked") * 2 >= F.size("lines"))).select("doc_id", "page_no", "block_no", M.list_text(F.col("lines"), F.col("misread")).alias("md"))
    return df.select("doc_id", "page_no", "block_no", F.posexplode(F.split("md", "\n", -1)).alias("item_no", "item")).withColumn("item_no", F.col("item_no").cast("long"))


FALLBACK = "WITH " + X.RAW_PAGES_SQL + f""",
f1 AS (SELECT doc_id, page_no, {D.normalize_raw('text')} AS t FROM raw_pages),
f2 AS (SELECT doc_id, page_no, unnest(regexp_split_to_array(t, '\\n{{2,}}')) AS p, unnest(range(len(regexp_split_to_array(t, '\\n{{2,}}')))) AS para_no FROM f1),
f3 AS (SELECT doc_id, page_no, para_no, unnest(string_split(p, chr(10))) AS raw, unnest(range(len(string_split(p, chr(10))))) AS k FROM f2),
f4 AS (SELECT doc_id, page_no, para_no, k, {D.trim('raw')} AS text FROM f3),
fallback AS (SELECT doc_id, page_no, para_no, row_number() OVER (PARTITION BY doc_id, page_no ORDER BY para_no, k) - 1 AS line_no, text, 0.0::DOUBLE AS size FROM f4 WHERE text <> '')"""


@query("paragraph_fallback", FALLBACK + " SELECT * FROM fallback")
def _(spark, d):
    return M.fallback_lines(X.raw_pages(spark, d))


@query("fallback_markdown", FALLBACK + "," + regroup_sql("fallback") + "," + markdown_sql("regrouped") + "," + PAGE_SQL + " SELECT doc_id, page_no, markdown FROM page_md")
def _(spark, d):
    return M.page_markdown(M.fallback_lines(X.raw_pages(spark, d)))


@query("page_markdown", REGROUP + "," + markdown_sql("regrouped") + "," + PAGE_SQL + " SELECT doc_id, page_no, markdown FROM page_md")
def _(spark, d):
    return M.page_markdown(X.lines(spark, d))


def pages(spark, d):
    k = F.col("doc_id") * 37 + F.col("page_no") * 11
    return X.pages(spark, d).select("doc_id", "page_no", F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("name"), F.when(k % 4 != 0, k % 101).alias("confidence"), (k % 4 == 0).alias("from_layer"))


PAGES_SQL = """pg AS (SELECT DISTINCT doc_id, page_no, 'doc_' || doc_id || '.pdf' AS name, CASE WHEN (doc_id * 37 + page_no * 11) % 4 <> 0 THEN (doc_id * 37 + page_no * 11) % 101 END AS confidence, (doc_id * 37 + page_no * 11) % 4 = 0 AS from_layer FROM lines),
hd AS (SELECT doc_id, any_value(name) AS name, count(*) AS n, CAST(floor(avg(confidence) + 0.5) AS BIGINT) AS c, bool_or(from_layer) AS layer FROM pg GROUP BY doc_id)"""
META_SQL = f"""'*' || concat_ws(' · ', 'Forrás: `' || name || '`', CASE WHEN n = 1 THEN '1 oldal' ELSE n || ' oldal' END, 'Nyelv: magyar', CASE WHEN c IS NOT NULL THEN 'átlagos megbízhatóság: ' || c || '%' END,
 CASE WHEN layer THEN 'részben a PDF beágyazott szövegéből' END, 'felismerve: ' || strftime(TIMESTAMP '{AT}', '%Y. %m. %d. %H:%M')) || '*'"""
BUILD = LINES + "," + PAGES_SQL + "," + regroup_sql("lines") + ", sh AS (SELECT regrouped.*, CASE WHEN n > 1 THEN 1 ELSE 0 END AS shift FROM regrouped JOIN hd USING (doc_id))," + markdown_sql("sh", "shift") + "," + PAGE_SQL + f""",
bd AS (SELECT pg.doc_id, string_agg(CASE WHEN hd.n > 1 THEN '## ' || pg.page_no || '. oldal' || chr(10) || chr(10) ELSE '' END || coalesce(markdown, '{M.EMPTY_PAGE}'), chr(10) || chr(10) ORDER BY pg.page_no) AS body
 FROM pg JOIN hd USING (doc_id) LEFT JOIN page_md ON pg.doc_id = page_md.doc_id AND pg.page_no = page_md.page_no GROUP BY pg.doc_id),
docs AS (SELECT doc_id, concat_ws(chr(10) || chr(10), '# ' || {D.base_name('name')}, {META_SQL}, body) || chr(10) AS markdown FROM bd JOIN hd USING (doc_id))"""


def built(spark, d):
    return M.build_documents(pages(spark, d), X.lines(spark, d), F.lit(AT).cast("timestamp"))


@query("build_document", BUILD + " SELECT doc_id, markdown FROM docs")
def _(spark, d):
    return built(spark, d)


@query("doc_header", LINES + "," + PAGES_SQL + f" SELECT doc_id, '# ' || {D.base_name('name')} AS title, {META_SQL} AS meta FROM hd")
def _(spark, d):
    h = pages(spark, d).groupBy("doc_id").agg(F.first("name").alias("name"), F.count(F.lit(1)).alias("n"), M.average_confidence(F.col("confidence")).alias("c"), F.bool_or("from_layer").alias("layer"))
    return h.select("doc_id", F.concat(F.lit("# "), T.base_name(F.col("name"))).alias("title"), M.meta_line(F.col("name"), F.col("n"), Options().lang, F.col("c"), F.col("layer"), F.lit(AT).cast("timestamp")).alias("meta"))


@query("front_matter", "WITH " + X.SCORES_SQL + f""", h AS (SELECT doc_id, 'a "' || doc_id || '\\.b' AS name, count(*) AS n, CAST(floor(avg(confidence) + 0.5) AS BIGINT) AS c FROM scores GROUP BY doc_id)
SELECT doc_id, concat_ws(chr(10), '---', 'cim: ' || {D.yaml_string(D.base_name('name'))}, 'forras: ' || {D.yaml_string('name')}, 'oldalak: ' || n, 'nyelv: "hun"', 'megbizhatosag: ' || coalesce(CAST(c AS VARCHAR), 'null'), 'letrehozva: "2024-03-05T06:07:08.000Z"', 'eszkoz: "{M.TOOL}"', '---') AS front FROM h""")
def _(spark, d):
    h = X.scores(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), M.average_confidence(F.col("confidence")).alias("c"))
    name = F.concat(F.lit('a "'), F.col("doc_id").cast("string"), F.lit("\\.b"))
    return h.select("doc_id", M.front_matter(T.base_name(name), name, F.col("n"), "hun", F.col("c"), F.lit(AT).cast("timestamp")).alias("front"))


@query("combined_markdown", BUILD + f" SELECT string_agg({D.trim('markdown')}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY doc_id) || chr(10) AS markdown FROM docs")
def _(spark, d):
    return M.combine(built(spark, d))


def html_sql(source: str) -> str:
    dash, number = f"^-[{D.WS}]+", f"^[0-9]+\\.[{D.WS}]+"
    items = lambda rule: f"array_to_string(list_transform(string_split(b, chr(10)), lambda x: '<li>' || {D.md_inline(f"regexp_replace(x, '{rule}', '')")} || '</li>'), '')"
    level = "length(regexp_extract(b, '^(#+)', 1))"
    return f"""
h1 AS (SELECT doc_id, regexp_matches(markdown, '(?s)^---\\n(.*?)\\n---\\n') AS has, regexp_extract(markdown, '(?s)^---\\n(.*?)\\n---\\n', 1) AS fm, regexp_replace(markdown, '(?s)^---\\n(.*?)\\n---\\n', '') AS rest FROM {source}),
h2 AS (SELECT doc_id, unnest(regexp_split_to_array(rest, '\\n{{2,}}')) AS raw, unnest(range(len(regexp_split_to_array(rest, '\\n{{2,}}')))) AS k FROM h1),
h3 AS (SELECT doc_id, k, {D.trim('raw')} AS b FROM h2),
h4 AS (SELECT doc_id, k, CASE WHEN regexp_matches(b, '^-{{3,}}$') THEN '<hr>' WHEN regexp_matches(b, '^#{{1,6}}[{D.WS}]+[^\\n]*$') THEN '<h' || {level} || '>' || {D.md_inline(f"regexp_replace(b, '^#{{1,6}}[{D.WS}]+', '')")} || '</h' || {level} || '>'
 WHEN len(list_filter(string_split(b, chr(10)), lambda x: NOT regexp_matches(x, '{dash}'))) = 0 THEN '<ul>' || {items(dash)} || '</ul>'
 WHEN len(list_filter(string_split(b, chr(10)), lambda x: NOT regexp_matches(x, '{number}'))) = 0 THEN '<ol>' || {items(number)} || '</ol>' ELSE '<p>' || {D.md_inline('b')} || '</p>' END AS html FROM h3 WHERE b <> '')"""


@query("markdown_to_html", BUILD + "," + html_sql("docs") + f""" SELECT h1.doc_id, concat_ws(chr(10), CASE WHEN any_value(has) THEN '<pre><code>' || {D.escape_html('any_value(fm)')} || '</code></pre>' END, string_agg(html, chr(10) ORDER BY k)) AS html FROM h1 LEFT JOIN h4 ON h1.doc_id = h4.doc_id GROUP BY h1.doc_id""")
def _(spark, d):
    return built(spark, d).select("doc_id", H.to_html(F.col("markdown")).alias("html"))


@query("html_blocks", BUILD + "," + html_sql("docs") + " SELECT doc_id, html FROM h4")
def _(spark, d):
    blocks = F.filter(F.transform(F.split("markdown", r"\n{2,}", -1), T.trim), lambda b: b != "")
    return built(spark, d).select("doc_id", F.explode_outer(blocks).alias("b")).select("doc_id", H.block_html(F.col("b")).alias("html"))


@query("output_names", BUILD + f" SELECT docs.doc_id, {D.safe_file_name('name')} AS file_name, {D.utf16_length("markdown")} AS chars FROM docs JOIN hd USING (doc_id)")
def _(spark, d):
    named = built(spark, d).join(pages(spark, d).select("doc_id", "name").distinct().hint("shuffle_hash"), "doc_id")
    return named.select("doc_id", T.safe_file_name(F.col("name")).alias("file_name"), T.utf16_length(F.col("markdown")).cast("long").alias("chars"))


@query("result_meta", BUILD + f" SELECT count(*) AS documents, CAST(sum({D.utf16_length('markdown')}) AS BIGINT) AS chars, count(*) >= 2 AS each FROM docs")
def _(spark, d):
    return built(spark, d).agg(F.count(F.lit(1)).alias("documents"), F.sum(T.utf16_length(F.col("markdown")).cast("long")).alias("chars"), (F.count(F.lit(1)) >= 2).alias("each"))
