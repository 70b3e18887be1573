import pytest
from helpers import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.operators import chunk_plain, chunk_size, definitions, grammars


@pytest.mark.parametrize(
    "text,limit,least,sizes",
    [
        ("hello world", 100, 1, [11]),
        ("a" * 20 + "\n\n" + "b" * 20, 60, 10, [42]),
        ("a" * 50 + "\n\n" + "b" * 50, 80, 10, [50, 50]),
        ("x" * 2300, 1000, 10, [1000, 1000, 300]),
        ("\n\n".join(["a" * 100] * 3), 150, 250, [304]),
        ("a\n\n\n \n\nb", 100, 1, [4]),
        (" \n\n ", 10, 1, []),
        ("", 10, 1, []),
        ("alpha\n\nbeta\n\ngamma\n\ndelta", 10, 15, [18, 5]),
    ],
)
def test_plain_golden(text, limit, least, sizes):
    assert [len(c) for c in chunk_plain.chunk_plain(text, limit, least)] == sizes


class _Node:
    def __init__(self, type_, start, end, name=None, children=()):
        self.type, self.start_byte, self.end_byte, self.children, self._name = type_, start, end, [*([name] if name else []), *children], name

    def child_by_field_name(self, field):
        return self._name


class _Parser:
    """Stands for a parser library: knows one text."""

    def parse(self, raw):
        ident = lambda s: _Node("identifier", raw.index(s), raw.index(s) + len(s))
        method = _Node("method_declaration", raw.index(b"int f"), raw.index(b"}") + 1, _Node("identifier", raw.index(b"f("), raw.index(b"f(") + 1))
        body = _Node("class_body", raw.index(b"{"), len(raw), children=[method])
        top = _Node("class_declaration", raw.index("é".encode()), len(raw), ident(b"Box"), [body])
        return type("Tree", (), {"root_node": _Node("program", 0, len(raw), children=[top])})()


def test_grammars_replace_scanners_where_they_are_installed(spark, monkeypatch, tmp_path):
    text = "// é\nclass Box { int f() { return 1; } }"
    scan = grammars.scanner(_Parser())
    assert [(text[s.start : s.end], s.symbol) for s in scan(text)] == [(text[3:], "Box"), ("int f() { return 1; }", "Box.f")]
    assert definitions.extract_defs("java", text, {"java": scan})[1] == ("Box.f", "int f() { return 1; }")
    assert grammars.scanners() == definitions.SCANNERS == grammars.scanners("no_such_module")
    module = type("M", (), {"get_parser": staticmethod(lambda x: _Parser() if x == "java" else {}[x])})
    monkeypatch.setitem(__import__("sys").modules, "some_grammars", module)
    monkeypatch.setenv(grammars.ENV, "some_grammars")
    got = grammars.scanners()
    assert got["python"] is definitions.SCANNERS["python"] and got["java"] is not definitions.SCANNERS["java"]
    df = spark.createDataFrame([(1, "java", "class A { void m() { } }")], "id int, lang string, t string")
    assert [r.symbol for r in definitions.chunked(df, "id", "lang", "t", 100, 0, make_scanners=lambda: {"java": lambda s: iter([definitions.Span(0, 5, "own")])}).collect()] == ["own"]


def test_size_split_keeps_a_leading_empty_piece():
    assert [len(p) for p in chunk_size.split_by_size("x" * 2500, 1000)] == [0, 1000, 1000, 500]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab \n\t", max_size=200), st.integers(1, 30))
def test_size_split_loses_nothing(text, limit):
    pieces = chunk_size.split_by_size(text, limit)
    assert "".join(pieces) == text
    assert all(len(p) <= limit for p in pieces)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab ", min_size=1, max_size=60), max_size=8), st.integers(5, 40), st.integers(0, 40))
def test_plain_stays_within_the_limit(paras, limit, least):
    chunks = chunk_plain.chunk_plain("\n\n".join(paras), limit, min(least, limit))
    assert all(len(c) <= limit for c in chunks)
    assert "".join("".join(chunks).split()) == "".join("".join(paras).split())


def test_size_column_equals_the_function(spark):
    texts = ["", "short", "a" * 25, "aa bb\ncc " * 9, "x y" + "z" * 47 + " w", "é 日本語 " * 8]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunk_size.size_pieces("t", 10).alias("p"))
    assert {t: p for t, p in rows(df)} == {t: chunk_size.split_by_size(t, 10) for t in texts}


def test_packed_column_equals_the_function(spark):
    text = "\n\n".join("w" * n for n in (3, 9, 1, 1, 7, 10, 2))
    df = spark.createDataFrame([(text,)], "t string").select(chunk_plain.packed_paragraphs("t", 10).alias("p"))
    assert df.first()[0] == chunk_plain.chunk_plain(text, 10, 0)


@pytest.mark.parametrize(
    "lang,source,symbols",
    [
        ("java", "class Foo { void bar() { if (x) { y(); } } }", ["Foo", "Foo.bar"]),
        ("typescript", "class Greeter { greet(n: string) { return `}${n}`; } }\nfunction topLevel() { return 1 }", ["Greeter", "Greeter.greet", "topLevel"]),
        ("python", "class A:\n    def m(self):\n        return 1\n\ndef top():\n    pass\n", ["A", "A.m", "top"]),
        ("markdown", "# Title\n\nbody\n\n## Subhead\n", ["Title", "Subhead"]),
        ("xml", '<mapper namespace="com.foo.UserMapper"><select id="findById">x</select></mapper>', ["com.foo.UserMapper.mapper", "com.foo.UserMapper.mapper.select#findById"]),
        ("kotlin", "class A {\n fun f() { g() }\n}\nfun top() { }\n", ["A", "A.f", "top"]),
        ("yaml", "a: 1\nb: 2\n", [""]),
        ("cobol", "anything", [""]),
        ("java", "   ", []),
    ],
)
def test_definitions(lang, source, symbols):
    assert [s for s, _ in definitions.extract_defs(lang, source)] == symbols


def test_dispatch_falls_back_to_paragraphs():
    assert definitions.chunk_text("text", "a\n\nb", 100) == [(None, "a\n\nb")]
    assert definitions.chunk_text("java", "no definitions here", 100) == [(None, "no definitions here")]
    assert definitions.chunk_text("java.x", "class A { }", 100) == [("A", "class A { }")]
    assert definitions.chunk_text("java", "", 100) == []


def test_equal_prefixes_collapse():
    body = "def f():\n    " + "x = 1\n    " * 40
    assert len(definitions.extract_defs("python", f"{body}\n{body}y\n")) == 1


def test_legacy_java():
    got = definitions.chunk_java("public class A {\n int x;\n public void foo(int a) { if (a) { b(); } }\n}\n", 100)
    assert [s for _, s in got] == [None, "foo", None]
    assert definitions.chunk_java("plain", 100) == [("plain", None)]


def test_sql_names(spark):
    from siltstone.functions import sql

    sql.register(spark)
    spark.createDataFrame([("java", "class A { void f() { } }"), ("text", "plain")], "lang string, content string").createOrReplaceTempView("files")
    got = spark.sql("SELECT lang, c.symbol FROM files, LATERAL chunk_text(lang, files.content, 100, 0) c ORDER BY lang, chunk_idx").collect()
    assert [tuple(r) for r in got] == [("java", "A"), ("java", "A.f"), ("text", "")]
    assert spark.sql("SELECT count(*) FROM split_by_size('aaaa bbbb', 4)").first()[0] == 3


NESTED = {
    "java": (
        "class Outer {\n  Runnable r = new Runnable() {\n    public void run() { go(\"}\"); }\n  };\n  void f() {\n    list.forEach(x -> { g(x); });\n    new Thread(new Task(1)) { void inner(int a) { } };\n    class Local { int h() { return 1; } }\n  }\n  enum E { A, B; int k() { return 2; } }\n}\n",
        ["Outer", "Outer.run", "Outer.f", "Outer.inner", "Local", "Local.h", "E", "E.k"],
    ),
    "kotlin": (
        "class A(val x: Int)\nclass B(\n  val f: () -> Int = { 1 }\n) : Base(),\n  Other {\n  val o = object : I { override fun inObject() { } }\n  constructor(y: Int) : this({ y }) { }\n  fun s(): String { return \"a ${list.map { \"{\" }} b\" }\n  fun outer() { fun local() { } }\n}\nobject O { fun p() = 1 }\n",
        ["A", "B", "B.inObject", "B", "B.s", "B.outer", "B.local", "O", "O.p"],
    ),
    "javascript": (
        "const o = { a(x) { return `${x.map((y) => { return `}`; })}`; }, get b() { return 1; }, c: () => { function d() { } } };\nclass K { m() { if (x) { y(); } const q = { n() { } }; } }\nmodule.exports = { e: function named() { } };\n",
        ["a", "b", "d", "K", "K.m", "K.n", "named"],
    ),
    "typescript": ("export default { data(): D { return { f(): void { } }; } };\nabstract class T { private async u(): Promise<void> { await v(); } }\n", ["data", "f", "T", "T.u"]),
    "python": ("class A:\n    def f(self,\n          b={'x': 1}):\n        def g():\n            return '''\nclass No:\n'''\n        return g\n    class B:\n        async def h(self): pass\n    x = 1\n\ndef top(a: dict[str, int] = {}):\n    return a\n", ["A", "A.f", "A.g", "B", "B.h", "top"]),
    "groovy": ('class G {\n  def m() { "a ${b.collect { it }} c" }\n}\ndef t(x) { x }\n', ["G", "G.m", "t"]),
}


@pytest.mark.parametrize("lang", sorted(NESTED))
def test_nested_definitions(lang):
    source, symbols = NESTED[lang]
    assert [s for s, _ in definitions.extract_defs(lang, source)] == symbols


def test_spans_end_where_their_blocks_do():
    got = dict(definitions.extract_defs("java", NESTED["java"][0]))
    assert got["Outer.run"] == 'public void run() { go("}"); }' and got["Outer.inner"] == "void inner(int a) { }" and got["E"] == "enum E { A, B; int k() { return 2; } }"
    got = dict(definitions.extract_defs("python", NESTED["python"][0]))
    assert got["A"].endswith("x = 1") and got["top"].endswith("return a") and got["A.f"].endswith("return g")


def test_blanked_text_keeps_offsets_and_code_in_strings():
    for family, source in (("java", 'a /* { */ "\\"}" \'}\' // {\n"unclosed {\n/* open {'), ("javascript", "`a ${ {b: `c ${d}`} } }` x"), ("kotlin", '"${f("}")}" + "$x }"'), ("python", "'''{\n''' # {\n'it' \"}\"")):
        out = definitions.blanked(source, family)
        assert len(out) == len(source) and [i for i, c in enumerate(out) if c == "\n"] == [i for i, c in enumerate(source) if c == "\n"]
        assert all(a in (b, " ") for a, b in zip(out, source))
    assert definitions.blanked("`a ${ {b: `c ${d}`} } }` x", "javascript").split() == ["{b:", "d", "}", "x"]
    assert definitions.blanked('"${f("}")}" + "$x }"', "kotlin").split() == ["f(", ")", "+"]


PROBES = {
    "comments": ("xml", lambda n: "<!--" * n + ">"), "cdata": ("xml", lambda n: "<a><![CDATA[" * n), "nested classes": ("java", lambda n: "class A { void f() { } " * n + "}" * n),
    "functions": ("javascript", lambda n: "class C { m() { } }\nfunction f() { }\n" * n), "nested python": ("python", lambda n: "".join(" " * (i % 60) + f"def f{i}():\n" for i in range(n))),
    "headers": ("kotlin", lambda n: "class A\n" * n), "open strings": ("kotlin", lambda n: '"""a ${ ' * n), "open parentheses": ("python", lambda n: "def a(\n" * n),
}


@pytest.mark.parametrize("name", sorted(PROBES))
def test_scanners_take_linear_time(name):
    import time

    lang, make = PROBES[name]

    def seconds(n):
        text, best = make(n), 99.0
        for _ in range(3):
            began = time.perf_counter()
            list(definitions.SCANNERS[lang](text))
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(8000) < 0.05 + 14 * seconds(1000)


def test_markup_keeps_its_own_scanners(monkeypatch):
    module = type("M", (), {"get_parser": staticmethod(lambda x: _Parser())})
    monkeypatch.setitem(__import__("sys").modules, "all_grammars", module)
    got = grammars.scanners("all_grammars")
    assert all(got[x] is definitions.SCANNERS[x] for x in ("xml", "yaml", "markdown")) and got["kotlin"] is not definitions.SCANNERS["kotlin"]


@pytest.mark.parametrize("by", ["paragraphs", "definitions"])
def test_a_task_takes_few_texts_at_once(spark, monkeypatch, by):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    df = spark.range(3000).coalesce(1).selectExpr("id", "'text' AS lang", "concat('a ', id, '\n\nb') AS text")
    out = chunk_plain.chunk_table(df, "id", "text", 4, 0) if by == "paragraphs" else definitions.chunked(df, "id", "lang", "text", 4, 0)

    def most(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([max(b.num_rows for b in batches)], pa.int64())], names=["n"])

    assert df.mapInArrow(most, "n long").first().n <= 1000
    held = sorted((r.id, r.chunk_idx, r.content) for r in out.collect())
    assert held == [(i, j, c) for i in range(3000) for j, c in enumerate(chunk_plain.chunk_plain(f"a {i}\n\nb", 4, 0))]
