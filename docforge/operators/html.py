"""A small Markdown to HTML rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docforge.functions import text as T


def block_html(block: Column) -> Column:
    """One trimmed block: rule, heading, list or paragraph."""
    lines = F.split(block, "\n", -1)
    item = lambda rule: F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<li>"), T.md_inline(F.regexp_replace(x, rule, "")), F.lit("</li>"))), "")
    level = F.length(F.regexp_extract(block, "^(#+)", 1)).cast("string")
    dash, number = f"^-[{T.WS}]+", f"^[0-9]+\\.[{T.WS}]+"
    return (
        F.when(block.rlike(r"^-{3,}\z"), F.lit("<hr>"))
        .when(block.rlike(f"^#{{1,6}}[{T.WS}]+[^\\n]*\\z"), F.concat(F.lit("<h"), level, F.lit(">"), T.md_inline(F.regexp_replace(block, f"^#{{1,6}}[{T.WS}]+", "")), F.lit("</h"), level, F.lit(">")))
        .when(F.forall(lines, lambda x: x.rlike(dash)), F.concat(F.lit("<ul>"), item(dash), F.lit("</ul>")))
        .when(F.forall(lines, lambda x: x.rlike(number)), F.concat(F.lit("<ol>"), item(number), F.lit("</ol>")))
        .otherwise(F.concat(F.lit("<p>"), T.md_inline(block), F.lit("</p>")))
    )


def to_html(markdown: Column) -> Column:
    """Front matter as code, then all blocks, one a line."""
    rule = r"(?s)^---\n(.*?)\n---\n"
    front = F.regexp_extract(markdown, rule, 1)
    has = markdown.rlike(rule)
    rest = F.regexp_replace(markdown, rule, "")
    blocks = F.filter(F.transform(F.split(rest, r"\n{2,}", -1), T.trim), lambda b: b != "")
    body = F.array_join(F.transform(blocks, block_html), "\n")
    return F.concat_ws("\n", F.when(has, F.concat(F.lit("<pre><code>"), T.escape_html(front), F.lit("</code></pre>"))), F.when(F.size(blocks) > 0, body))
