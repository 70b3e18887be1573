"""Definition scanners from grammars, for those who have a parser library: an optional replacement of the light scanners.

A parser is any object whose parse(bytes) gives a tree with root_node; nodes have type, start_byte, end_byte, children and
child_by_field_name. The module that hands parsers out by language (get_parser(name)) is named by the environment
variable SILTSTONE_GRAMMARS or by a parameter; without one, or where it knows no such language, the light scanner stays.
So do those of markup, whose symbols are headings, attributes and documents instead of named classes and callables.
"""

from __future__ import annotations

import importlib
import os
from collections.abc import Callable, Iterator

import numpy as np

from .definitions import SCANNERS, Span

ENV = "SILTSTONE_GRAMMARS"
#: Languages whose definitions are classes and callables.
CODE = tuple(x for x in SCANNERS if x not in ("xml", "yaml", "markdown"))
#: Words that the types of nodes for definitions end in (fixed values of the public grammars).
HOLDERS = ("class_declaration", "class_definition", "interface_declaration", "enum_declaration", "object_declaration", "record_declaration")
CALLABLES = ("method_declaration", "constructor_declaration", "function_declaration", "function_definition", "method_definition")


def scanner(parser) -> Callable[[str], Iterator[Span]]:
    """Spans of a parser's definitions; callables are named by their innermost holder, in anonymous classes too."""

    def name(node, raw: bytes) -> str:
        found = node.child_by_field_name("name") or next((c for c in node.children if c.type.endswith("identifier")), None)
        return raw[found.start_byte : found.end_byte].decode("utf-8", "replace") if found is not None else ""

    def scan(text: str) -> Iterator[Span]:
        raw = text.encode("utf-8", "replace")
        # Characters that begin before each byte: every byte but UTF-8's continuing ones begins one.
        before = np.append(0, np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80))
        at = lambda byte: int(before[byte])
        open_ = [(parser.parse(raw).root_node, "")]
        while open_:
            node, holder = open_.pop()
            own = name(node, raw) if node.type.endswith(HOLDERS + CALLABLES) else ""
            if node.type.endswith(HOLDERS):
                yield Span(at(node.start_byte), at(node.end_byte), own)
                holder = own
            elif node.type.endswith(CALLABLES):
                yield Span(at(node.start_byte), at(node.end_byte), f"{holder}.{own}" if holder and own else own or holder)
            open_ += [(c, holder) for c in node.children]

    return scan


def scanners(module: str | None = None, languages: tuple[str, ...] = CODE) -> dict[str, Callable[[str], Iterator[Span]]]:
    """SCANNERS with the module's grammars in the place of those that it has. Called once in each worker."""
    table, named = dict(SCANNERS), module or os.environ.get(ENV)
    if not named:
        return table
    try:
        get_parser = importlib.import_module(named).get_parser
    except ImportError:
        return table
    for language in languages:
        try:
            table[language] = scanner(get_parser(language))
        except (LookupError, ValueError):  # a language that it does not know
            continue
    return table
