"""Text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the characters that Python's \s matches, as the inside of a regex class.
WS = r"\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Language by file name, then by extension (the last two parts of a name first).
FILE_NAMES = {"pom.xml": "xml"}
EXTENSIONS = {
    ".java": "java", ".gradle": "gradle", ".groovy": "groovy", ".kt": "kotlin", ".kts": "kotlin",
    ".xml": "xml", ".properties": "properties", ".yml": "yaml", ".yaml": "yaml",
    ".js": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".jsx": "javascript",
    ".ts": "typescript", ".tsx": "typescript", ".d.ts": "typescript",
    ".sh": "bash", ".bash": "bash", ".zsh": "bash", ".ksh": "bash",
    ".ps1": "powershell", ".bat": "batch", ".cmd": "batch", ".md": "markdown", ".txt": "text",
}


def strip(c: Column | str) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, rf"\A[{WS}]+|[{WS}]+\z", "")


def lang_from_path(path: Column | str, names: dict[str, str] | None = None, extensions: dict[str, str] | None = None) -> Column:
    """Language of a path: by whole name, by the last two suffixes, by the last suffix, else `text`."""
    names, extensions = names or FILE_NAMES, extensions or EXTENSIONS
    lookup = lambda table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    base = F.lower(F.regexp_extract(path, r"([^/]*)\z", 1))
    two = F.regexp_extract(base, r"[^.](\.[^.]+\.[^.]+)\z", 1)
    one = F.regexp_extract(base, r"[^.](\.[^.]+)\z", 1)
    ext = lookup(extensions)
    return F.coalesce(F.element_at(lookup(names), base), F.element_at(ext, two), F.element_at(ext, one), F.lit("text"))


def content_sha(c: Column | str) -> Column:
    """Lower-case hex SHA-256 of the UTF-8 bytes."""
    return F.sha2(c, 256)


def chunk_id(relpath: Column | str, idx: Column | str) -> Column:
    return F.concat_ws(":", relpath, F.col(idx).cast("string") if isinstance(idx, str) else idx.cast("string"))


def lang_or_text(lang: Column) -> Column:
    return F.coalesce(F.nullif(lang, F.lit("")), F.lit("text"))


def preview(c: Column | str, n: int, more: str = "...") -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.left(c, F.lit(n)), F.when(F.length(c) > n, more).otherwise(""))


def byte_slice(c: Column | str, start: int, end: int) -> Column:
    """Text between two byte offsets of the UTF-8 form; a cut character becomes U+FFFD."""
    raw = (F.col(c) if isinstance(c, str) else c).cast("binary")
    return F.make_valid_utf8(F.substring(raw, start + 1, end - start).cast("string"))


def tail(c: Column | str, cap: int) -> Column:
    """The last `cap` characters."""
    return F.right(c, F.lit(cap))


def speaker(role: Column | str) -> Column:
    """First letter upper case, the others lower."""
    role = F.col(role) if isinstance(role, str) else role
    return F.concat(F.upper(F.left(role, F.lit(1))), F.lower(F.substring(role, 2, 1 << 30)))


def human_bytes(n: Column | str) -> Column:
    """1024 steps, one decimal, up to TB."""
    n = (F.col(n) if isinstance(n, str) else n).cast("double")
    shown = lambda power: F.bround(n / 1024.0**power, 1)  # noqa: E731  ties to even, as printing does
    out = F.format_string("%.1f TB", shown(4))
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(n < 1024.0 ** (power + 1), F.format_string(f"%.1f {unit}", shown(power))).otherwise(out)
    return out


def signature_symbol(signature: Column | str) -> Column:
    """The first identifier before a parenthesis, else `unknown`."""
    found = F.regexp_extract(signature, r"\b([A-Za-z_]\w*)\s*\(", 1)
    return F.when(found == "", "unknown").otherwise(found)


def heading_lines(markdown: Column | str) -> Column:
    """ATX headings of a Markdown text, without marks."""
    return F.transform(F.regexp_extract_all(markdown, F.lit(r"(?m)^ {0,3}(#{1,6}[ \t].*?)[ \t]*$"), F.lit(1)), lambda h: strip(F.regexp_replace(h, "^#+", "")))
