"""Scalar text functions: Column to Column, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space of the model, list marks, marks that recognition misreads, language names.
WS = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
BULLETS = "-–—•*·▪●○"
SUSPICIOUS = "eo©@»>+¢a"
LANGUAGES = {"hun": "magyar", "eng": "angol", "deu": "német"}
# End of the fixed values.

NO_TEXT_STEM = "ocr-szoveg"


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, trimmed."""
    return trim(F.regexp_replace(c, f"[{WS}]+", " "))


def utf16_length(c: Column) -> Column:
    """Characters, those beyond the basic plane as two."""
    return F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))


def visible_length(c: Column) -> Column:
    """Characters that are no white space, those beyond the basic plane as two."""
    return utf16_length(F.regexp_replace(c, f"[{WS}]+", ""))


def _plain(c: Column) -> Column:
    """Quotes and blanks in their plain form; the soft hyphen has no counterpart and goes."""
    for a, b in (("\u2018", "'"), ("\u2019", "'"), ("\u00a0", " "), ("\u00ad", "")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def normalize_raw(c: Column) -> Column:
    """One form of line ends, quotes and blanks; at most one empty line in a row."""
    c = F.regexp_replace(c, r"\r\n?", "\n")
    lines = F.transform(F.split(_plain(c), "\n", -1), lambda x: trim(F.regexp_replace(x, r"[ \t]{2,}", " ")))
    return trim(F.regexp_replace(F.array_join(lines, "\n"), r"\n{3,}", "\n\n"))


def normalize_line(c: Column) -> Column:
    """``normalize_raw`` of a text without line ends."""
    c = _plain(c)
    # most lines have nothing to replace, and one search tells
    return F.when(c.rlike(f"[ \\t]{{2}}|^[{WS}]|[{WS}]\\z"), trim(F.regexp_replace(c, r"[ \t]{2,}", " "))).otherwise(c)


def base_name(c: Column) -> Column:
    return F.regexp_replace(c, r"\.[^.]+\z", "")


def _clean_name(c: Column) -> Column:
    return trim(F.regexp_replace(c, r'[\\/:*?"<>|]+', "-"))


def safe_file_name(c: Column) -> Column:
    stem = _clean_name(base_name(c))
    return F.concat(F.when(stem == "", NO_TEXT_STEM).otherwise(stem), F.lit(".md"))


def safe_file_name_native(c: Column) -> Column:
    """The device's rule: the whole name is cleaned, without blanks and control characters at its ends, and .md is added unless it is there."""
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r'[\\/:*?"<>|]+', "-"), r"^[\x00-\x20]+|[\x00-\x20]+\z", "")
    named = F.when(clean == "", f"{NO_TEXT_STEM}.md").otherwise(clean)
    return F.when(F.lower(named).endswith(".md"), named).otherwise(F.concat(named, F.lit(".md")))


def escape_block_start(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"^([#>|])", r"\\$1"), f"^([0-9]{{1,3}})\\.[{WS}]", r"$1\\. ")


def bullet(c: Column) -> Column:
    """The list mark a line begins with, or ''."""
    return F.regexp_extract(c, f"^([{BULLETS}])[{WS}]+[^{WS}]", 1)


def suspicious(c: Column) -> Column:
    """A leading character that may be a misread list mark, or ''."""
    return F.regexp_extract(c, f"^([{SUSPICIOUS}])[{WS}]+[^{WS}]", 1)


def numbered(c: Column) -> Column:
    return F.regexp_extract(c, f"^([0-9]{{1,3}})[.)][{WS}]+[^{WS}]", 1)


def leading_marker(c: Column) -> Column:
    """The mark, real or suspected, or null."""
    mark = F.regexp_extract(c, f"^([{BULLETS}{SUSPICIOUS}])[{WS}]+[^{WS}]", 1)
    return F.when(mark != "", mark)


def looks_like_heading(c: Column) -> Column:
    letters, upper = F.length(F.regexp_replace(c, r"\P{L}+", "")), F.length(F.regexp_replace(c, r"\P{Lu}+", ""))
    outline = c.rlike(f"^[0-9]+(\\.[0-9]+)*\\.?[{WS}]+\\p{{Lu}}") & (F.size(F.split(c, f"[{WS}]+", -1)) <= 9)
    # three capitals are three quarters of three letters, the least there have to be
    return (utf16_length(c) <= 70) & ~c.rlike(r"[.!?:;,]\z") & (((upper >= 3) & (upper >= letters * F.lit(0.75))) | (outline & (letters >= 3)))


def looks_unfinished(c: Column) -> Column:
    return ~c.rlike(r"""[.!?:;»"')\]]\z""") & ~looks_like_heading(c)


def continues(c: Column) -> Column:
    """Begins in lower case or with a bracket."""
    return c.rlike(r"^[\p{Ll}(]")


def glue(out: Column, line: Column, join: bool, hyphen: bool) -> Column:
    """One step of joining lines: a divided word is closed, else a space or a Markdown line break stands between."""
    plain = F.concat(out, F.lit(" " if join else "  \n"), line)
    if not hyphen:
        return plain
    # the end is looked at before the text before it is searched
    return F.when(out.endswith("-") & out.rlike(r"\p{L}-\z") & line.rlike(r"^\p{Ll}"), F.concat(F.substring(out, F.lit(1), F.length(out) - 1), line)).otherwise(plain)


def join_lines(lines: Column, join: bool = True, hyphen: bool = True) -> Column:
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    return F.when(F.size(lines) == 0, F.lit("")).otherwise(F.aggregate(rest, F.get(lines, F.lit(0)), lambda out, x: glue(out, x, join, hyphen)))


def yaml_string(c: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def describe_lang(c: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.array_join(F.transform(F.split(c, r"\+", -1), lambda x: F.coalesce(names[x], x)), " + ")


def format_datetime(c: Column) -> Column:
    return F.date_format(c, "yyyy. MM. dd. HH:mm")


def format_size(c: Column) -> Column:
    kb, mb = c / F.lit(1024.0), c / F.lit(1048576.0)
    return F.when(c < 1024, F.concat(c.cast("string"), F.lit(" B"))).when(c < 1048576, F.concat(F.floor(kb + 0.5).cast("string"), F.lit(" kB"))).otherwise(F.concat(F.format_string("%.1f", F.floor(mb * 10 + 0.5) / 10), F.lit(" MB")))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def md_inline(c: Column) -> Column:
    """Code, strong, emphasis, escapes and line breaks of one block as HTML."""
    c = F.regexp_replace(escape_html(c), r"`([^`]+)`", "<code>$1</code>")
    c = F.regexp_replace(c, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    c = F.regexp_replace(c, r"(^|[^*])\*([^*\n]+)\*", "$1<em>$2</em>")
    c = F.regexp_replace(c, r"\\([#>|.])", "$1")
    return F.replace(c, F.lit("  \n"), F.lit("<br>\n"))
