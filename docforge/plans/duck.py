"""DuckDB expressions that say the same as docforge.functions.text; used by the SQL that queries are held against."""

from __future__ import annotations

WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
BULLETS = r"\-–—•*·▪●○"
SUSPICIOUS = "eo©@»>+¢a"


def trim(c):
    return f"regexp_replace({c}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def squeeze(c):
    return trim(f"regexp_replace({c}, '[{WS}]+', ' ', 'g')")


def utf16_length(c):
    return f"(length({c}) + len(regexp_extract_all({c}, '[\\x{{10000}}-\\x{{10FFFF}}]')))"


def visible_length(c):
    return utf16_length(f"regexp_replace({c}, '[{WS}]+', '', 'g')")


def _marks(c):
    return f"replace(replace(replace(replace({c}, chr(8216), ''''), chr(8217), ''''), chr(160), ' '), chr(173), '')"


def normalize_raw(c):
    lines = f"list_transform(string_split({_marks(f"regexp_replace({c}, '\\r\\n?', chr(10), 'g')")}, chr(10)), lambda ln: {trim("regexp_replace(ln, '[ \\t]{2,}', ' ', 'g')")})"
    return trim(f"regexp_replace(array_to_string({lines}, chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g')")


def normalize_line(c):
    return trim(f"regexp_replace({_marks(c)}, '[ \\t]{{2,}}', ' ', 'g')")


def base_name(c):
    return f"regexp_replace({c}, '\\.[^.]+$', '')"


def safe_file_name(c):
    stem = trim(f"""regexp_replace({base_name(c)}, '[\\\\/:*?"<>|]+', '-', 'g')""")
    return f"coalesce(nullif({stem}, ''), 'ocr-szoveg') || '.md'"


def safe_file_name_native(c):
    clean = f"""coalesce(nullif(regexp_replace(regexp_replace(coalesce({c}, ''), '[\\\\/:*?"<>|]+', '-', 'g'), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g'), ''), 'ocr-szoveg.md')"""
    return f"CASE WHEN lower({clean}) LIKE '%.md' THEN {clean} ELSE {clean} || '.md' END"


def escape_block_start(c):
    return f"regexp_replace(regexp_replace({c}, '^([#>|])', '\\\\\\1'), '^([0-9]{{1,3}})\\.[{WS}]', '\\1\\\\. ')"


def bullet(c):
    return f"regexp_extract({c}, '^([{BULLETS}])[{WS}]+[^{WS}]', 1)"


def suspicious(c):
    return f"regexp_extract({c}, '^([{SUSPICIOUS}])[{WS}]+[^{WS}]', 1)"


def numbered(c):
    return f"regexp_extract({c}, '^([0-9]{{1,3}})[.)][{WS}]+[^{WS}]', 1)"


def leading_marker(c):
    return f"coalesce(nullif({bullet(c)}, ''), nullif({suspicious(c)}, ''))"


def looks_like_heading(c):
    letters, upper = f"len(regexp_extract_all({c}, '\\p{{L}}'))", f"len(regexp_extract_all({c}, '\\p{{Lu}}'))"
    outline = f"(regexp_matches({c}, '^[0-9]+(\\.[0-9]+)*\\.?[{WS}]+\\p{{Lu}}') AND len(regexp_split_to_array({c}, '[{WS}]+')) <= 9)"
    return f"({utf16_length(c)} <= 70 AND NOT regexp_matches({c}, '[.!?:;,]$') AND {letters} >= 3 AND ({upper} >= {letters} * 0.75 OR {outline}))"


def looks_unfinished(c):
    return f"""(NOT regexp_matches({c}, '[.!?:;»"'')\\]]$') AND NOT {looks_like_heading(c)})"""


def continues(c):
    return f"regexp_matches({c}, '^[\\p{{Ll}}(]')"


def glue(out, line, join=True, hyphen=True):
    plain = f"{out} || {"' '" if join else "'  ' || chr(10)"} || {line}"
    return f"CASE WHEN regexp_matches({out}, '\\p{{L}}-$') AND regexp_matches({line}, '^\\p{{Ll}}') THEN left({out}, -1) || {line} ELSE {plain} END" if hyphen else plain


def join_lines(lines, join=True, hyphen=True):
    return f"CASE WHEN len({lines}) = 0 THEN '' ELSE list_reduce({lines}, lambda a, b: {glue('a', 'b', join, hyphen)}) END"


def yaml_string(c):
    return f"""'"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"'"""


def describe_lang(c):
    return f"array_to_string(list_transform(string_split({c}, '+'), lambda k: CASE k WHEN 'hun' THEN 'magyar' WHEN 'eng' THEN 'angol' WHEN 'deu' THEN 'német' ELSE k END), ' + ')"


def format_size(c):
    return f"CASE WHEN {c} < 1024 THEN {c} || ' B' WHEN {c} < 1048576 THEN CAST(floor({c} / 1024.0::DOUBLE + 0.5) AS BIGINT) || ' kB' ELSE printf('%.1f', floor({c} / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' END"


def escape_html(c):
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


def md_inline(c):
    c = f"regexp_replace({escape_html(c)}, '`([^`]+)`', '<code>\\1</code>', 'g')"
    c = f"regexp_replace({c}, '\\*\\*([^*]+)\\*\\*', '<strong>\\1</strong>', 'g')"
    c = f"regexp_replace({c}, '(^|[^*])\\*([^*\\n]+)\\*', '\\1<em>\\2</em>', 'g')"
    c = f"regexp_replace({c}, '\\\\([#>|.])', '\\1', 'g')"
    return f"replace({c}, '  ' || chr(10), '<br>' || chr(10))"


def misread(lines):
    """The first leading character that two lines and half of all share."""
    chars = f"list_filter(list_transform({lines}, lambda s: {suspicious('s')}), lambda t: t <> '')"
    return f"list_filter({chars}, lambda k: len(list_filter({chars}, lambda x: x = k)) >= 2 AND len(list_filter({chars}, lambda x: x = k)) >= len({lines}) * 0.5)[1]"
