"""Path expressions: exclusion predicates, normalising, splitting, reference forms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The default exclusions, unanchored and case-insensitive.
DEFAULT_EXCLUDE_PATTERNS = (
    r"\.gitignore",
    r"renovate\.json",
    r"requirement.*\.txt",
    r"\.lock$",
    r"licen[cs]e(\..*)?",
    r"\.github",
    r"\.git",
    r"\.vscode",
)

# The default exclusions by what they keep out.
CATEGORIES = {
    "licences": (r"licen[cs]e(\..*)?",),
    "gitignore": (r"\.gitignore",),
    "lockfiles": (r"\.lock$",),
    "requirements": (r"requirement.*\.txt",),
    "github": (r"\.github",),
    "tools": (r"renovate\.json", r"\.vscode"),
    "git": (r"\.git",),
}
# Some other default would keep a category's files out as well; this is what it leaves alone then.
_SPARED = {r"\.git": {"gitignore": r"\.git(?!ignore)", "github": r"\.git(?!hub)"}}

# Schemes whose URLs must name a host.
HOST_SCHEMES = ("http", "https", "ws", "wss", "ftp")


def java_regex(pattern: str) -> str:
    """Same meaning in Java: ``$`` is the very end, ``.`` stops only at LF."""
    return pattern.replace(".*", "[^\n]*").replace("$", r"\z")


def _literal(pattern: str) -> str:
    return "".join(c if c.isalnum() or ord(c) > 127 else "\\" + c for c in pattern)


def _without(include: Sequence[str]) -> list[tuple[str, str]]:
    """The default exclusions but for some categories."""
    unknown = set(include) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"no such category: {', '.join(sorted(unknown))}; there are {', '.join(CATEGORIES)}")
    dropped = {p for name in include for p in CATEGORIES[name]}
    kept = []
    for pattern in DEFAULT_EXCLUDE_PATTERNS:
        spared = [_SPARED[pattern][name] for name in include if name in _SPARED.get(pattern, ())]
        if pattern in dropped:
            continue
        regex = java_regex(pattern) if not spared else r"\.git" + "".join(s.removeprefix(r"\.git") for s in spared)
        kept.append((pattern, regex))
    return kept


def exclusion_regexes(
    extend: Sequence[str] | None = None, replace: Sequence[str] | None = None, include: Sequence[str] = ()
) -> list[tuple[str, str]]:
    """(pattern as the user knows it, Java regex); user patterns are literal text.

    ``include`` names categories (``CATEGORIES``) of the default exclusions that are kept in after all.
    """
    if replace is not None:
        return [(p, _literal(p)) for p in replace]
    defaults = _without(include)
    return defaults + [(p, _literal(p)) for p in extend or ()]


def matches(path: Column, regex: str) -> Column:
    return path.rlike(f"(?iu){regex}")


def is_dot_file(path: Column) -> Column:
    """Whether the file or a folder above it has a name that begins with a dot."""
    return path.rlike(r"(?:\A|/)\.")


def is_excluded(
    path: Column, extend: Sequence[str] | None = None, replace: Sequence[str] | None = None, include: Sequence[str] = ()
) -> Column:
    """One regex test per path, whatever the number of patterns."""
    regexes = [regex for _, regex in exclusion_regexes(extend, replace, include)]
    if not regexes:
        return F.lit(False)
    return matches(path, "(?:" + "|".join(f"(?:{r})" for r in regexes) + ")")


def normalize_path(path: Column) -> Column:
    """``\\`` becomes ``/``; empty and ``.`` components and outer slashes go."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.array_join(F.filter(parts, lambda p: (p != "") & (p != ".")), "/")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def parent_path(path: Column) -> Column:
    """Folder of ``path``, '' for the top level."""
    keep = F.length(path) - F.length(base_name(path)) - 1
    return F.when(keep > 0, F.left(path, keep)).otherwise(F.lit(""))


def path_depth(path: Column) -> Column:
    """Number of folders above ``path``."""
    return (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("int")


def ancestors(path: Column) -> Column:
    """All folders above ``path``, from '' down."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.array_join(F.slice(parts, 1, i), "/"),
    )


def folders_above(path: Column) -> Column:
    """``ancestors`` without the root."""
    return F.slice(ancestors(path), 2, F.size(F.split(path, "/")))


def reference_kind(ref: Column) -> Column:
    """'url', 'shorthand' or 'invalid' for a repository reference."""
    text = F.regexp_replace(F.regexp_replace(ref, r"^[\x00-\x20]+|[\x00-\x20]+\z", ""), r"[\t\r\n]", "")
    scheme = F.lower(F.regexp_extract(text, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    rest = F.regexp_replace(text, r"^[A-Za-z][A-Za-z0-9+.\-]*:", "")
    authority = F.regexp_replace(F.regexp_extract(rest, r"^[/\\]*([^/\\?#]*)", 1), r"^.*@", "")
    host_ok = authority.rlike(r"^(?:\[[0-9A-Fa-f:.]+\]|[^\x00-\x20#%<>\[\]^|:\x7f]+)(?::[0-9]{0,5})?\z")
    url = (scheme != "") & (~scheme.isin(*HOST_SCHEMES) | host_ok)
    return (
        F.when(url, F.lit("url"))
        .when(ref.rlike(r"(?U)^[\w\-]+/[\w\-]+\z"), F.lit("shorthand"))
        .otherwise(F.lit("invalid"))
    )
