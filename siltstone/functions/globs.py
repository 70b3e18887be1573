"""Path globs as regular expressions, for columns and for listing a tree.

`*` crosses folders and a leading `**/` is optional. A glob that ends in `/**` names a folder: as an include it keeps
what lies under that literal prefix, as an exclude it prunes every folder or file path that has a segment of its last
name.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def regex(glob: str) -> str:
    """A glob's regex for whole strings: * any run, ? one character, [..] a class, [!..] its complement."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        end = glob.find("]", i + 2 + (glob[i + 1 : i + 2] == "!")) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = glob[i + 1 : end].replace("\\", r"\\").replace("[", r"\[").replace("&&", r"&\&")
            out.append(f"[^{inner[1:]}]" if inner[0] == "!" else f"[{inner.replace('^', chr(92) + '^', 1) if inner[0] == '^' else inner}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return rf"(?s)\A(?:{''.join(out)})"


def _file_regexes(globs: list[str]) -> list[str]:
    out = []
    for g in globs:
        out.append(regex(g))
        if g.startswith("**/"):
            out.append(regex(g[3:]))
    return out


def split(globs: list[str]) -> tuple[list[str], list[str]]:
    """(folders of the globs that end in /**, all others)."""
    folders = [g[:-3] for g in globs if g.endswith("/**")]
    return folders, [g for g in globs if not g.endswith("/**")]


def pruned_names(exclude: list[str]) -> list[str]:
    return sorted({name for f in split(exclude)[0] if (name := f.rstrip("/").rsplit("/", 1)[-1]) and name != "**"})


def included(path: Column, globs: list[str]) -> Column:
    folders, files = split(globs)
    keep = F.lit(False)
    for r in _file_regexes(files):
        keep = keep | path.rlike(r + r"\z")
    for f in folders:
        keep = keep | (path == f) | path.startswith(f + "/")
    return keep


def excluded(path: Column, globs: list[str]) -> Column:
    drop = F.lit(False)
    for r in _file_regexes(split(globs)[1]):
        drop = drop | path.rlike(r + r"\z")
    names = pruned_names(globs)
    return drop | F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, names))) if names else drop


def hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: s.startswith("."))


class PathFilter:
    """The same predicates for one path at a time, for listing."""

    def __init__(self, include: list[str], exclude: list[str], include_hidden: bool = True) -> None:
        self.folders, files = split(include)
        self.keep = [re.compile(r + r"\Z") for r in _file_regexes(files)]
        self.drop = [re.compile(r + r"\Z") for r in _file_regexes(split(exclude)[1])]
        self.pruned = set(pruned_names(exclude))
        self.include_hidden = include_hidden

    def enters(self, name: str) -> bool:
        return name not in self.pruned and (self.include_hidden or not name.startswith("."))

    def takes(self, rel: str) -> bool:
        parts = rel.split("/")
        if not self.include_hidden and parts[-1].startswith("."):
            return False
        if self.pruned.intersection(parts) or any(r.match(rel) for r in self.drop):
            return False
        return any(r.match(rel) for r in self.keep) or any(rel == f or rel.startswith(f + "/") for f in self.folders)
