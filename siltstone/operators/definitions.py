"""Definition-aware chunks from light scanners: no grammar is needed.

Each language has a function from source to spans (start, end, kind, name); symbols qualify a callable by its innermost
named container, in anonymous classes and object literals too. Comments and strings are blanked first, so braces in them
don't count; code inside interpolated strings stays. Braces are matched once, with a stack, and each block's own text is
looked at once, so time grows with the text. Known limits, stated so that nobody takes this for a parser: bodies of enum
constants and functions that only a variable names have no symbol, and a header that a macro or an annotation argument with
parentheses splits may lose its modifiers.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship, small_batches
from .chunk_plain import TEXTS, chunk_plain
from .chunk_size import split_by_size

PREFIX = 120


@dataclass(frozen=True)
class Span:
    start: int
    end: int
    symbol: str


#: What opens a comment or a string; strings that hold code between ${ and }, by language.
_TOKENS = {"c": re.compile(r'//|/\*|"""|["\'`{}]'), "python": re.compile(r'#|"""|\'\'\'|["\']')}
_INTERPOLATED = {"javascript": ("`",), "kotlin": ('"', '"""'), "groovy": ('"', '"""')}
_SHORT = {q: re.compile(rf"{q}(?:\\.|[^{q}\\\n])*{q}", re.S) for q in "\"'"}
_NOT_LINE_END = re.compile(r"[^\n]")


def blanked(text: str, family: str) -> str:
    """Comments and strings as spaces; line ends stay, so every offset stays. Code inside an interpolated string stays code.

    One pass with a stack: of open strings, and of the braces that are open in the code inside them.
    """
    rules, held = _TOKENS["python" if family == "python" else "c"], _INTERPOLATED.get(family, ())
    out: list[str] = []
    unclosed: set[str] = set()  # marks that are known to have no end further on
    stack: list[list] = []  # [closing mark, open braces of the code in it]
    at = 0

    def put(to: int, code: bool) -> None:
        nonlocal at
        out.append(text[at:to] if code else _NOT_LINE_END.sub(" ", text[at:to]))
        at = to

    def string(mark: str, start: int) -> bool:
        """Inside a string that may hold code: blank up to its end, or to the code. False if a one-line string has none."""
        look = re.compile(r"\\.|\$\{|" + mark + (r"|\n" if mark == '"' else ""), re.S)
        for m in look.finditer(text, start):
            if m[0] == "${":
                put(m.end(), False)
                stack.append([mark, 0])
                return True
            if m[0] == mark:
                put(m.end(), False)
                return True
            if m[0] == "\n":
                break
        unclosed.add(mark) if mark != '"' else None
        return False

    while m := rules.search(text, at):
        mark, start = m[0], m.start()
        put(start, True)
        if mark in "{}":
            if stack and mark == "}" and not stack[-1][1]:
                closing_mark = stack.pop()[0]
                put(start + 1, False)
                string(closing_mark, at)
                continue
            if stack:
                stack[-1][1] += 1 if mark == "{" else -1
            put(start + 1, True)
        elif mark in ("//", "#"):
            end = text.find("\n", start)
            put(len(text) if end < 0 else end, False)
        elif mark in held:
            if mark in unclosed or not string(mark, start + len(mark)):
                put(start + len(mark), True)
        elif mark in _SHORT:
            whole = _SHORT[mark].match(text, start)
            put(whole.end() if whole else start + 1, not whole)
        else:
            close = "*/" if mark == "/*" else mark
            end = -1 if close in unclosed else _end_of(text, close, start + len(mark))
            if end < 0:
                unclosed.add(close)
            put(start + len(mark) if end < 0 else end, end < 0)
    put(len(text), True)
    return "".join(out)


def _end_of(text: str, close: str, at: int) -> int:
    """Offset after the closing mark; a backslash hides what follows it in strings."""
    if close == "*/":
        end = text.find(close, at)
        return end + 2 if end >= 0 else -1
    for m in re.compile(r"\\.|" + close, re.S).finditer(text, at):
        if m[0] == close:
            return m.end()
    return -1


def closing(code: str, at: int) -> int:
    """Offset after the brace that closes the one at `at`; the end of the text if none does."""
    depth = 0
    for m in re.compile(r"[{}]").finditer(code, at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(code)


class Scopes:
    """All braces and parentheses of blanked code, matched in one pass: close[open] is the offset after the closing one."""

    def __init__(self, code: str) -> None:
        self.code, self.close, self.inner = code, {}, {-1: []}
        open_: dict[str, list[int]] = {"{": [], "(": []}
        self.braces: list[int] = []
        for m in re.compile(r"[{}()]").finditer(code):
            c, at = m[0], m.start()
            if c in "{(":
                if c == "{":
                    self.inner[open_["{"][-1] if open_["{"] else -1].append(at)
                    self.inner[at] = []
                    self.braces.append(at)
                open_[c].append(at)
            elif open_[was := "{" if c == "}" else "("]:
                self.close[open_[was].pop()] = at + 1
        for left in open_.values():
            self.close.update(dict.fromkeys(left, len(code)))

    def direct(self, brace: int) -> tuple[str, Callable[[int], int]]:
        """A block's own text, inner blocks as {}, and where an offset in it lies in the code. -1: the whole text."""
        at, end = (0, len(self.code)) if brace < 0 else (brace + 1, self.close[brace] - (self.code[self.close[brace] - 1] == "}"))
        pieces, flat, real, total = [], [], [], 0
        for inner in [*self.inner[brace], None]:
            stop = end if inner is None else inner + 1
            pieces.append(self.code[at:stop])
            flat.append(total)
            real.append(at)
            total += len(pieces[-1])
            at = end if inner is None else self.close[inner] - (self.code[self.close[inner] - 1] == "}")
        return "".join(pieces), lambda i: real[k := bisect_right(flat, i) - 1] + i - flat[k]


def _within(places: list[int], bodies: list[tuple[int, int, str]]) -> list[str]:
    """The name of the innermost body around each place (in ascending order); empty for none."""
    out, open_, todo = [], [], sorted(bodies, reverse=True)
    for at in places:
        while todo and todo[-1][0] <= at:
            body = todo.pop()
            while open_ and open_[-1][1] <= body[0]:
                open_.pop()
            open_.append(body)
        while open_ and open_[-1][1] <= at:
            open_.pop()
        out.append(open_[-1][2] if open_ else "")
    return out


_MODS = r"(?:(?:@[\w.]+(?:\([^()]*\))?|public|protected|private|internal|abstract|final|static|sealed|open|data|inner|override|suspend|inline|default|synchronized|native|strictfp|export|declare|async|companion|operator|def)\s+)*"
_TYPE = r"(?:<[^{};()]*?>\s*)?[\w.$]+(?:\s*<[^{};()]*>)?(?:\s*\[\s*\])*"
_NOT_NAMES = r"(?!(?:if|for|while|switch|catch|return|new|else|do|try|throw|synchronized|super|this|function|when|assert|await|yield|case)\b)"
_CLASS = {
    "java": re.compile(rf"{_MODS}\b(?:class|interface|enum)\s+(?P<name>\w+)"),
    "groovy": re.compile(rf"{_MODS}\bclass\s+(?P<name>\w+)"),
    "kotlin": re.compile(rf"{_MODS}\b(?:(?:enum\s+|annotation\s+)?class|object|interface)\s+(?P<name>\w+)"),
    "javascript": re.compile(r"(?<![\w.])(?:abstract\s+)?class\s+(?P<name>\w+)"),
}
_CALLABLE = {
    "java": re.compile(rf"{_MODS}(?:{_TYPE}\s+)?{_NOT_NAMES}(?P<name>\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?P<open>[{{;])"),
    "groovy": re.compile(rf"{_MODS}(?:{_TYPE}\s+)?{_NOT_NAMES}(?P<name>\w+)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?:throws\s+[\w.,\s]+)?(?P<open>{{)"),
    "kotlin": re.compile(rf"{_MODS}\b(?:fun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(?P<name>\w+)|constructor)\s*\([^()]*(?:\([^()]*\)[^()]*)*\)[^{{=\n;]*(?P<open>[{{=\n;]|\Z)"),
    "javascript": re.compile(rf"(?:(?:public|protected|private|static|readonly|async|get|set|override)\s+)*\*?\s*(?<![\w$#.]){_NOT_NAMES}(?P<name>[\w$#]+)\s*(?:<[^{{}}()]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{{;]+)?(?P<open>{{)"),
}
_FUNCTION = re.compile(r"(?:async\s+)?\bfunction\b\s*\*?\s*(?P<name>[\w$]+)\s*(?:<[^{}()]*>)?\([^()]*(?:\([^()]*\)[^()]*)*\)\s*(?::[^{;]+)?\{")


#: An anonymous class up to its arguments, and what stands before an object literal.
_ANONYMOUS = re.compile(r"\bnew\s+[\w.$]+(?:\s*<[^{};()]*>)?\s*(?=\()")
_LITERAL = re.compile(r"(?:[=(,:\[?]|\breturn|\bdefault)\s*\Z")
_HEAD = re.compile(r"[\n({;]")


def _kotlin_body(code: str, scopes: Scopes, at: int) -> tuple[int, int]:
    """(brace of the body or -1, end of the header) of a class or object whose name ends at `at`. A header goes on in the next
    line after a colon or comma, or before one."""
    while m := _HEAD.search(code, at):
        if m[0] == "(":
            at = scopes.close[m.start()]
        elif m[0] == "{":
            return m.start(), m.start()
        elif m[0] == ";":
            return -1, m.start()
        else:
            before, after = code[max(0, m.start() - 80) : m.start()].rstrip()[-1:], re.compile(r"\s*(.?)").match(code, m.end())
            if before not in (":", ",") and after[1] not in (":", ",", "{", "("):
                return -1, m.start()
            at = after.end() - len(after[1])
    return -1, len(code)


def _braces(family: str) -> Callable[[str], Iterator[Span]]:
    """One pass blanks, one matches braces; every block's own text is looked at once, so time is linear in the text."""

    def scan(text: str) -> Iterator[Span]:
        code = blanked(text, family)
        scopes = Scopes(code)
        bodies: list[tuple[int, int, str]] = []  # of named classes
        regions: list[int] = []  # braces of the blocks whose own text may hold callables
        heads: list[tuple[int, int]] = []
        marks = [m.start() for m in re.compile(r"[{;]").finditer(code)]
        for m in _CLASS[family].finditer(code):
            if family == "kotlin":
                brace, header = _kotlin_body(code, scopes, m.end())
                heads.append((m.start(), header))
                if brace < 0:
                    yield Span(m.start(), header, m["name"])
                    continue
            else:
                k = bisect_left(marks, m.end())
                brace = marks[k] if k < len(marks) and code[marks[k]] == "{" else -1
                if brace < 0:
                    continue
            end = scopes.close[brace]
            bodies.append((brace + 1, end - 1 if code[end - 1] == "}" else end, m["name"]))
            regions.append(brace)
            yield Span(m.start(), end, m["name"])
        if family == "java":
            for m in _ANONYMOUS.finditer(code):
                after = re.compile(r"\s*\{").match(code, scopes.close[m.end()])
                if after:
                    regions.append(after.end() - 1)
        elif family == "javascript":
            known = set(regions)
            regions += [b for b in scopes.braces if b not in known and _LITERAL.search(code[max(0, b - 40) : b])]
        elif family == "groovy":
            regions.append(-1)
        elif family == "kotlin":
            # A function is told by its keyword wherever it stands; what looks like one in a class header is its constructor.
            found = [m for m in _CALLABLE[family].finditer(code)]
            starts = [h[0] for h in heads]
            for m, name in zip(found, _within([m.start() for m in found], bodies)):
                k = bisect_right(starts, m.start("open") - 1) - 1
                if m["name"] is None and (not name or k >= 0 and heads[k][0] <= m.start() < heads[k][1]):
                    continue
                yield _callable(code, scopes, m, name, lambda i: i)
        if family != "kotlin":
            regions = sorted(set(regions))
            for brace, name in zip(regions, _within([b + 1 for b in regions], bodies)):
                own_text, real = scopes.direct(brace)
                for m in _CALLABLE[family].finditer(own_text):
                    before = own_text[m.start() : m.start("name")].split()
                    bare = not before
                    if own_text[max(0, m.start() - 12) : m.start("name")].split()[-1:] in (["new"], ["function"], ["function*"]) or "new" in before:
                        continue  # a call of a constructor, or a function that is found by its keyword
                    if family == "java" and bare and (m["name"] != name or m["open"] == ";"):
                        continue  # a call or an enum constant, not a constructor
                    if family == "groovy" and not name and bare:
                        continue
                    yield _callable(code, scopes, m, name, real)
        if family == "javascript":
            found = list(_FUNCTION.finditer(code))
            for m, name in zip(found, _within([m.start() for m in found], bodies)):
                yield Span(m.start(), scopes.close[m.end() - 1], f"{name}.{m['name']}" if name else m["name"])

    return scan


def _callable(code: str, scopes: Scopes, m: re.Match, name: str, real: Callable[[int], int]) -> Span:
    """The span of a callable that was matched in a block's own text."""
    own, opens = m["name"] or "", m["open"]
    at = real(m.start("open")) if opens else len(code)
    stop = scopes.close[at] if opens == "{" else at + 1 if opens == ";" else len(code) if (line := code.find("\n", at)) < 0 else line
    start = real(m.start() + len(m[0]) - len(m[0].lstrip()))
    return Span(start, stop, f"{name}.{own}" if name and own else own or name)


_PY = re.compile(r"^(?P<indent>[ \t]*)(?P<kind>class|(?:async[ \t]+)?def)[ \t]+(?P<name>\w+)", re.M)
_PY_LINE = re.compile(r"^(?P<i>[ \t]*)(?P<c>\S)?[^\n]*(?:\n|\Z)", re.M)
_PY_HEAD = re.compile(r"[\n(\[{:]")


def _python(text: str) -> Iterator[Span]:
    """One pass over the lines with a stack of open definitions, by indentation."""
    code = blanked(text, "python")
    close: dict[int, int] = {}
    pending: list[int] = []
    for m in re.compile(r"[()\[\]{}]").finditer(code):
        if m[0] in "([{":
            pending.append(m.start())
        elif pending:
            close[pending.pop()] = m.end()
    heads: dict[int, tuple[re.Match, int]] = {}  # by the start of the line: the header, and the end of its last line
    for m in _PY.finditer(code):
        at = m.end()
        while (x := _PY_HEAD.search(code, at)) and x[0] in "([{":
            at = close.get(x.start(), len(code))
        end = code.find("\n", x.start()) if x else -1
        heads[m.start()] = m, len(code) if end < 0 else end
    open_: list[list] = []  # [indent, start, kind, name, end so far, end of the header, holder]
    done: list[Span] = []

    def shut(indent: int) -> None:
        while open_ and open_[-1][0] >= indent:
            _, start, kind, name, end, _, holder = open_.pop()
            done.append(Span(start, end, f"{holder}.{name}" if holder and kind != "class" else name))
            if open_:
                open_[-1][4] = max(open_[-1][4], end)

    for line in _PY_LINE.finditer(code):
        if line.start() >= len(code):
            break
        if not line["c"] or (open_ and line.start() < open_[-1][5]):  # blank, or a header's own further line
            continue
        indent = len(line["i"].expandtabs(8))
        shut(indent)
        if open_:
            open_[-1][4] = max(open_[-1][4], line.end() - line[0].endswith("\n"))
        if line.start() in heads:
            m, end = heads[line.start()]
            holder = next((o[3] if o[2] == "class" else o[6] for o in reversed(open_)), "")
            open_.append([indent, m.start() + len(m["indent"]), m["kind"], m["name"], end, end, holder])
    shut(-1)
    yield from sorted(done, key=lambda s: s.start)


#: Elements that are definitions, and the attributes that name one.
_XML_DEFS = {"mapper", "select", "insert", "update", "delete", "resultMap", "sql", "include", "where", "set", "trim", "foreach", "choose", "when", "otherwise"}
_XML_NAMES = ("id", "resultMap", "parameterMap")
_XML_TAG = re.compile(r"<[?!][^>]*>|<(?P<close>/)?(?P<tag>[\w:.-]+)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/)?>", re.S)
_XML_OPEN = re.compile(r"<!--|<!\[CDATA\[|<")
_XML_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")


def _xml_tags(text: str) -> Iterator[re.Match]:
    """Tags in order, without what lies in comments and CDATA. An end that was once not found is not looked for again."""
    at, ends = 0, {"<!--": "-->", "<![CDATA[": "]]>"}
    last = text.rfind(">")
    while (m := _XML_OPEN.search(text, at)) and m.start() <= last:
        if m[0] in ends:
            end = text.find(ends[m[0]], m.end())
            if end >= 0:
                at = end + 3
                continue
            del ends[m[0]]
        tag = _XML_TAG.match(text, m.start())
        at = tag.end() if tag else m.start() + 1
        if tag:
            yield tag


def _xml(text: str) -> Iterator[Span]:
    stack: list[tuple[str, int, str, str]] = []  # tag, start, namespace, symbol ("" for none)
    for m in _xml_tags(text):
        tag = m["tag"]
        if tag is None:
            continue
        if m["close"]:
            while stack:
                name, start, _, symbol = stack.pop()
                if symbol:
                    yield Span(start, m.end(), symbol)
                if name == tag:
                    break
            continue
        attrs = {a: x or y for a, x, y in _XML_ATTR.findall(m["attrs"])}
        space = attrs.get("namespace") or (stack[-1][2] if stack else "")
        symbol = ""
        if tag in _XML_DEFS:
            ident = next((attrs[a] for a in _XML_NAMES if attrs.get(a)), "")
            local = f"{tag}#{ident}" if ident else tag
            symbol = ".".join(p for p in (space, "" if tag == "mapper" else "mapper", local) if p)
            if tag == "mapper":  # the mapper itself, with and without what names it
                plain = f"{space}.mapper" if space else "mapper"
                symbol = plain if not ident else plain + "\0" + symbol
        if m["empty"]:
            if symbol:
                yield Span(m.start(), m.end(), symbol)
        else:
            stack.append((tag, m.start(), space, symbol))
    for _, start, _, symbol in stack:
        if symbol:
            yield Span(start, len(text), symbol)


_HEADING = re.compile(r"^ {0,3}(?:(?P<atx>#{1,6}(?:[ \t][^\n]*)?)|(?P<text>[^\s#>\-*+][^\n]*)\n {0,3}(?:=+|-+)[ \t]*)$", re.M)
_FENCE = re.compile(r"^(```|~~~).*?(?:^\1[^\n]*$|\Z)", re.M | re.S)


def _markdown(text: str) -> Iterator[Span]:
    code = _FENCE.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)
    for m in _HEADING.finditer(code):
        yield Span(m.start(), m.end(), (m["atx"] or m["text"]).lstrip("#").strip())


def _yaml(text: str) -> Iterator[Span]:
    at = 0
    for m in re.compile(r"^---[^\n]*\n?", re.M).finditer(text):
        if text[at : m.start()].strip():
            yield Span(at, m.start(), "")
        at = m.start()
    yield Span(at, len(text), "")


SCANNERS: dict[str, Callable[[str], Iterator[Span]]] = {
    "java": _braces("java"), "kotlin": _braces("kotlin"), "groovy": _braces("groovy"),
    "typescript": _braces("javascript"), "tsx": _braces("javascript"), "javascript": _braces("javascript"),
    "python": _python, "xml": _xml, "yaml": _yaml, "markdown": _markdown,
}


def extract_defs(lang: str, text: str, scanners: dict | None = None) -> list[tuple[str, str]]:
    """(symbol, code) in source order; of equal symbols with equal first PREFIX characters the first stays."""
    if not text.strip():
        return []
    scan = (scanners or SCANNERS).get(lang)
    if scan is None:
        return [("", text)]
    seen: dict[tuple[str, str], tuple[str, str]] = {}
    for s in sorted(scan(text), key=lambda s: (s.start, -s.end)):
        code = text[s.start : s.end].strip() if lang == "markdown" else text[s.start : s.end]
        for symbol in s.symbol.split("\0"):
            if code.strip():
                seen.setdefault((symbol, code[:PREFIX]), (symbol, code))
    return list(seen.values())


def defs_with_limits(defs: list[tuple[str, str]], limit: int) -> list[tuple[str, str]]:
    return [(symbol, piece) for symbol, code in defs for piece in split_by_size(code, limit)]


def chunk_text(lang: str | None, text: str, limit: int, least: int = 0, scanners: dict | None = None) -> list[tuple[str | None, str]]:
    """(symbol, piece): by definitions where the language has a scanner that finds any, else by paragraphs."""
    family = (lang or "").split(".")[0]
    table = SCANNERS if scanners is None else scanners
    if family in table and (defs := extract_defs(family, text, table)):
        return defs_with_limits(defs, limit)
    return [(None, p) for p in chunk_plain(text, limit, least)]


_JAVA_TYPE = re.compile(r"^[ \t]*(?=(?:(?:public|abstract|final)\s*)?class\s+\w+|interface\s+\w+|enum\s+\w+)", re.M)
_JAVA_METHOD = re.compile(r"(?:(?:public|private|protected|static)\s+|\s)*[\w<>\[\]]+\s+(?P<name>\w+)\s*\([^)]*\)\s*(?:throws\s+[\w.,\s]+)?\{")


def chunk_java(text: str, limit: int) -> list[tuple[str, str | None]]:
    """(piece, symbol): types by header, methods by signature and plain brace counting; text between has no symbol."""
    out: list[tuple[str, str | None]] = []
    put = lambda s, name: out.extend((p, name) for p in split_by_size(s, limit))
    heads = [m.start() for m in _JAVA_TYPE.finditer(text)]
    for a, b in zip([0, *heads], [*heads, len(text)]):
        block, last = text[a:b].strip(), 0
        for m in _JAVA_METHOD.finditer(block):
            if m.start() < last:
                continue
            if gap := block[last : m.start()].strip():
                put(gap, None)
            last = closing(block, m.end() - 1)
            put(block[m.start() : last], re.search(r"\b([A-Za-z_]\w*)\s*\(", m[0])[1])
        if rest := block[last:].strip():
            put(rest, None)
    return out or [(p, None) for p in split_by_size(text, limit)]


def chunked(files: DataFrame, key: str, lang: str, text: str, limit: int, least: int, keep: tuple[str, ...] = (), make_scanners: Callable[[], dict] | None = None) -> DataFrame:
    """(key, chunk_idx, symbol, content) and the columns to keep; symbol `` where there is none. make_scanners is called once
    in each task for another table of scanners, as grammars.scanners."""
    ship(files.sparkSession)
    small_batches(files.sparkSession)
    own = [key, *keep]

    def run(batches):
        table = make_scanners() if make_scanners else None
        for batch in (b.slice(a, TEXTS) for b in batches for a in range(0, b.num_rows, TEXTS)):
            rows = [(at, i, symbol or "", piece) for at, (g, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())) for i, (symbol, piece) in enumerate(chunk_text(g, t or "", limit, least, table))]
            at, idx, symbols, pieces = zip(*rows) if rows else ((), (), (), ())
            given = [batch.column(2 + k).take(pa.array(at, pa.int32())) for k in range(len(own))]
            yield pa.RecordBatch.from_arrays([given[0], pa.array(idx, pa.int32()), pa.array(symbols, pa.string()), pa.array(pieces, pa.string()), *given[1:]], names=[key, "chunk_idx", "symbol", "content", *keep])

    kind = lambda c: f"`{c}` {files.schema[c].dataType.simpleString()}"
    schema = ", ".join([kind(key), "chunk_idx int, symbol string, content string", *map(kind, keep)])
    # Two columns first, under names of their own: a kept column may be the language or the key itself.
    given = files.select(F.col(lang).alias("_lang"), F.col(text).alias("_text"), *own)
    return given.mapInArrow(run, schema)
