"""SQL fragments shared by the checks."""

from __future__ import annotations

LF, CR = "chr(10)", "chr(13)"


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def newlines(text: str) -> str:
    return f"replace(replace({text}, {CR} || {LF}, {LF}), {CR}, {LF})"


def lines(text: str) -> str:
    t = newlines(text)
    return (
        f"CAST(length({t}) - length(replace({t}, {LF}, '')) + "
        f"CASE WHEN {t} <> '' AND right({t}, 1) <> {LF} THEN 1 ELSE 0 END AS INTEGER)"
    )


def numbered(text: str) -> str:
    t, k = newlines(text), lines(text)
    return (
        f"CASE WHEN {text} = '' THEN '' ELSE array_to_string(list_transform(string_split({t}, {LF})[1:{k}], "
        f"lambda l, i: lpad(CAST(i AS VARCHAR), CAST(length(CAST({k} AS VARCHAR)) AS INTEGER), ' ') || '  ' || l), {LF}) || {LF} END"
    )


def attr(value: str) -> str:
    for old, new in (
        ("'&'", "'&amp;'"), ("'<'", "'&lt;'"), ("'>'", "'&gt;'"), ("'\"'", "'&quot;'"),
        ("''''", "'&apos;'"), (LF, "'&#xA;'"), (CR, "'&#xD;'"),
    ):
        value = f"replace({value}, {old}, {new})"
    return value


def cdata(text: str) -> str:
    return f"'<![CDATA[' || replace({text}, ']]>', ']]]]><![CDATA[>') || ']]>'"


def entry(path: str, size: str, lines_: str, inner: str) -> str:
    return (
        f"'<file path=\"' || {attr(path)} || '\" size=\"' || {size} || '\" lines=\"' || {lines_} || '\">' "
        f"|| {inner} || '</file>'"
    )


def text_entry(path: str, size: str, text: str) -> str:
    return entry(path, size, lines(text), cdata(text))


def parent(path: str) -> str:
    return f"regexp_replace({path}, '/?[^/]*$', '')"


def name(path: str) -> str:
    return f"regexp_extract({path}, '[^/]*$')"


def folders(source: str) -> str:
    """CTE of the distinct folders below the root."""
    return f"""
folders AS (
  SELECT DISTINCT bundle_id, array_to_string(parts[1:i], '/') AS node_path
  FROM (SELECT bundle_id, string_split(path, '/') AS parts,
          unnest(range(1, length(string_split(path, '/')))) AS i FROM {source}))
"""


def folder_key(path: str) -> str:
    return f"CASE WHEN {path} = '' THEN '' ELSE '1' || replace({path}, '/', chr(1) || '1') || chr(1) END"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"
