"""Lexing, extraction, classification and the scalar functions, against rows written by hand."""

import pytest
from pyspark.sql import functions as F

from textquarry.functions import code, context, lexer
from textquarry.functions.files import LANGUAGES, content_flags, language, location_weight, mock_path, path_flags
from textquarry.functions.text import clip, constant_style, grams, normal_path, path_key, regex_escape, split_tokens, words
from textquarry.functions.tokens import estimate
from textquarry.operators.find import query_terms
from textquarry.operators.search import glob_regex
from textquarry.operators.usage import parse_since
from textquarry.operators.changes import needs_rebuild, parse_patch

PYTHON = '''import os, sys
from pkg.mod import One, two as three
LIMIT = 10

class Reader(Base, Mixin):
    """Reads."""
    def read(self, n):  # def hidden
        s = "class Fake:"
        return helper(n)

    def _skip(self):
        pass

def main():
    def inner():
        return 1
    return inner()
'''


def test_python_symbols():
    found = [(s["name"], s["kind"], s["chain"], s["line"]) for s in code.symbols(PYTHON, "python")]
    assert found == [("LIMIT", "constant", [], 3), ("Reader", "class", [], 5), ("read", "method", ["Reader"], 7), ("_skip", "method", ["Reader"], 11), ("main", "function", [], 14), ("inner", "function", ["main"], 15)]
    by = {s["name"]: s for s in code.symbols(PYTHON, "python")}
    assert by["Reader"]["supers"] == ["Base", "Mixin"] and by["Reader"]["exported"] and not by["_skip"]["exported"]
    assert PYTHON[by["read"]["start"] : by["read"]["end"]].rstrip().endswith("return helper(n)")


def named(text, lang):
    return [(s["name"], s["kind"], s["supers"]) for s in code.symbols(text, lang)]


def test_other_languages():
    rust = "pub struct A { x: u8 }\nimpl Show for A {\n    fn show(&self) -> u8 { self.x }\n}\nmod inner;\n"
    assert named(rust, "rust") == [("A", "struct", []), ("x", "field", []), ("A", "impl", ["Show"]), ("show", "method", []), ("inner", "module", [])]
    ts = "export class Box extends Base implements One, Two {\n  open(x: number) {\n    return x;\n  }\n}\nconst f = (a) => a;\n"
    assert named(ts, "typescript") == [("Box", "class", ["Base", "One", "Two"]), ("open", "method", []), ("f", "function", [])]
    kt = "class Job(val n: Int) : Base(n), Runner {\n    fun run() { }\n}\n"
    assert named(kt, "kotlin") == [("Job", "class", ["Base", "Runner"]), ("n", "field", []), ("run", "method", [])]


def test_heads_over_several_lines():
    assert named("@deco(1)\nclass A(\n    B,\n    pkg.C[int], metaclass=M,\n):\n    pass\n", "python") == [("A", "class", ["B", "C"])]
    assert named("export default abstract class A<T>\n  extends B<T>\n  implements x.C, D {\n}\n", "typescript") == [("A", "class", ["B", "C", "D"])]
    assert named("unsafe impl<T: Copy> fmt::Show<T>\n    for A<T>\n    where T: X {\n}\npub trait Tr<'a>: Base\n    + other::Second<'a> + 'a {\n}\n", "rust") == [("A", "impl", ["Show"]), ("Tr", "trait", ["Base", "Second"])]
    assert named("data class A(\n    val n: Int,\n) :\n    B(n),\n    C<Int> by d {\n}\ninterface Plain\nfun after() = 1\n", "kotlin") == [("A", "class", ["B", "C"]), ("n", "field", []), ("Plain", "interface", []), ("after", "function", [])]


def test_members():
    py = "class A:\n    size: int = 3\n    def f(self):\n        self.x = 1\n        self.x = 2\n        y = 3\nlog = get()\nMAX_N = 3\nif T:\n    opt = 1\ndef g():\n    self.z = 1\n"
    assert [(s["name"], s["kind"], s["chain"]) for s in code.symbols(py, "python")] == [("A", "class", []), ("size", "field", ["A"]), ("f", "method", ["A"]), ("x", "field", ["A"]), ("log", "variable", []), ("MAX_N", "constant", []), ("opt", "variable", []), ("g", "function", [])]
    assert named("enum E { One, Two(u8), Three { a: u8 } }\npub(crate) union U { a: u8 }\nstatic mut G: u8 = 1;\nmacro_rules! mac { () => {} }\n", "rust") == [("E", "enum", []), ("One", "variant", []), ("Two", "variant", []), ("Three", "variant", []), ("U", "struct", []), ("a", "field", []), ("G", "constant", []), ("mac", "macro", [])]
    ts = "class A {\n  private n = 'x';\n  #hid = 1;\n  async *gen() {}\n  get v() { const local = 1 }\n}\nenum E { Red, Green = 2 }\nconst a = 1, b = () => 2;\nobj.done = function() {};\nfunction* gg() { let no = 1 }\n"
    assert [(s["name"], s["kind"], s["exported"]) for s in code.symbols(ts, "typescript")] == [("A", "class", False), ("n", "field", False), ("hid", "field", False), ("gen", "method", True), ("v", "method", True), ("E", "enum", False), ("Red", "variant", False), ("Green", "variant", False), ("a", "variable", False), ("b", "function", False), ("done", "function", False), ("gg", "function", False)]
    kt = "enum class Dir { UP, DOWN(2) { override fun z() {} }; fun f() {} }\nfun <T> List<T>.ext(a: Int): Int = a\nval (p, q) = pair\nclass A { companion object { const val K = 1 }\n constructor(a: Int) : this() { val no = 1 } }\n"
    assert [(n, k) for n, k, _ in named(kt, "kotlin")] == [("Dir", "enum"), ("UP", "variant"), ("DOWN", "variant"), ("z", "method"), ("f", "method"), ("ext", "function"), ("p", "variable"), ("q", "variable"), ("A", "class"), ("Companion", "object"), ("K", "field"), ("constructor", "method")]


def test_comments_nest_and_strings_hide_code():
    rust = "/* a /* fn no() {} */ fn no2() {} */ fn yes() { let q = '\"'; let l: &'a str = \"\nfn no3() {}\"; let r = r#\"fn \"no4\"\"#; }\nfn also() {}\n"
    assert [n for n, _, _ in named(rust, "rust")] == ["yes", "also"]
    assert [n for n, _, _ in named("/* a /* class No */ class No2 */\nclass Yes\nval s = \"${ f(\"class No3 {\") }\"\nval t = \"\"\"\nclass No4\n\"\"\"\nclass Also\n", "kotlin")] == ["Yes", "s", "t", "Also"]
    js = "const a = `x${ {b: '}'} }y`;\nconst r = /[\"/]'/.test(a) ? 1 / 2 : 3;\nfunction yes() {}\n/* /* */ function also() {}\n"
    assert [n for n, _, _ in named(js, "javascript")] == ["a", "r", "yes", "also"]
    assert [n for n, _, _ in named("s = r'\\''\nt = f\"{x}\"\nu = '''\ndef no(): pass\n'''\ndef yes(): pass\n", "python")] == ["s", "t", "u", "yes"]
    assert [k for _, _, k in lexer.spans("/// d\n//// c\n//! d\n/** d */ /**/ // c\n", "rust")] == ["doc", "comment", "doc", "doc", "comment", "comment"]


def test_flags_of_definitions():
    rust = "/// Doc\n#[derive(Debug)]\npub struct A;\n#[cfg(test)]\nmod tests {\n    #[test]\n    fn checks() {}\n}\npub(crate) fn hid() {}\n"
    assert [(s["name"], s["exported"], s["test"], s["doc"]) for s in code.symbols(rust, "rust")] == [("A", True, False, True), ("tests", False, True, False), ("checks", False, True, False), ("hid", False, False, False)]
    assert code.definition_on_line("    def run(self):", "python", 8, 11) and not code.definition_on_line("    run(self)", "python", 4, 7)


def test_extraction_agrees_with_the_parser():
    import ast
    import glob
    import os

    for path in sorted(glob.glob(os.path.dirname(os.__file__) + "/[a-d]*.py")):
        text = open(path, encoding="utf-8", errors="replace").read()
        tree = ast.parse(text)
        found = code.extract(text, "python")
        assert {(n.name, n.lineno) for n in ast.walk(tree) if isinstance(n, ast.FunctionDef | ast.ClassDef | ast.AsyncFunctionDef)} == {(s["name"], s["line"]) for s in found["symbols"] if s["kind"] in ("function", "method", "class")}, path
        assert sum(1 if isinstance(n, ast.ImportFrom) else len(n.names) for n in ast.walk(tree) if isinstance(n, ast.Import | ast.ImportFrom)) == len(found["imports"]), path


def test_imports_and_spans():
    assert [(i["module"], i["names"]) for i in code.imports(PYTHON, "python")] == [("os", []), ("sys", []), ("pkg.mod", ["One", "two"])]
    assert code.use_tree("a::{b, c::{d, e}, self}") == [("a", "b"), ("a::c", "d"), ("a::c", "e"), ("a", "")]
    got = [(i["module"], i["names"], i["wildcard"]) for i in code.imports("import D, {\n  A, type B as C\n} from './x/y'\nimport * as ns from 'n'\nimport 'side'\nexport * from './all'\nconst { q, r: s } = require('q')\nconst z = import('./lazy')\n", "typescript")]
    assert got == [("./x/y", ["default", "A", "B"], False), ("n", [], True), ("side", [], False), ("./all", [], True), ("q", ["q", "r"], False), ("./lazy", [], False)]
    got = [(i["module"], i["names"], i["wildcard"]) for i in code.imports("from a.b import (  # c\n    One,\n    two as three,\n)\nfrom .. import x\nfrom c import *\nimport d.e as f, \\\n    g\n", "python")]
    assert got == [("a.b", ["One", "two"], False), ("..", ["x"], False), ("c", [], True), ("d.e", [], False), ("g", [], False)]
    got = [(i["module"], i["names"], i["wildcard"]) for i in code.imports("use a::{\n    b, c::{d as e, f},\n};\npub(crate) use x::*;\nextern crate z;\nmod inner;\n", "rust")]
    assert got == [("a", ["b"], False), ("a::c", ["d"], False), ("a::c", ["f"], False), ("x", [], True), ("z", [], False), ("self::inner", [], False)]
    assert [k for _, _, k in lexer.spans(PYTHON, "python")] == ["doc", "comment", "string"]


@pytest.mark.parametrize(
    "lang,line,word,kind",
    [
        ("python", "from a import Foo", "Foo", "import"), ("python", "x = Foo(1)", "Foo", "call"), ("python", "obj.Foo + 1", "Foo", "member"), ("python", "def f(a: Foo):", "Foo", "type"), ("python", "class A(Foo):", "Foo", "type"),
        ("rust", "let x: Vec<Foo> = y;", "Foo", "type"), ("rust", "fn f(a: &Foo) {}", "Foo", "type"), ("rust", "Foo::new()", "Foo", "type"), ("rust", "x = Foo { a: 1 }", "Foo", "call"),
        ("typescript", "const x = new Foo", "Foo", "call"), ("typescript", "foo<number>(1)", "foo", "call"), ("typescript", "class A implements Foo {", "Foo", "type"), ("kotlin", "class A : Foo {", "Foo", "type"), ("python", "return Foo", "Foo", "ident"), ("python", "x: List[Foo] = y", "Foo", "type"), ("python", "def f() -> Foo:", "Foo", "type"), ("python", "d = {a: Foo}", "Foo", "ident"), ("rust", "impl Foo for Bar {", "Foo", "type"),
        ("rust", "pub(crate) use a::Foo;", "Foo", "import"), ("rust", "fn f<'a>(x: &'a mut Foo) {}", "Foo", "type"), ("rust", "let m: HashMap<u8, Foo> = x;", "Foo", "type"), ("rust", "a::Foo", "Foo", "member"), ("typescript", "const o = { Foo: 1 }", "Foo", "member"), ("typescript", "import('x').Foo", "Foo", "member"),
        ("javascript", "const a = require('Foo')", "Foo", "import"), ("kotlin", "fun f(): Foo = y", "Foo", "type"), ("kotlin", "val x = Foo { }", "Foo", "call"), (None, "Foo(1)", "Foo", "ident"),
    ],
)
def test_context_kind(lang, line, word, kind):
    at = line.index(word)
    assert context.context_kind(line, at, at + len(word), lang) == kind


def test_paths(spark):
    rows = ["src/test_a.py", "vendor/x/a.rs", "a/dist/b.js", "web/app.min.js", "Cargo.lock", "src/Latest.kt", "src/FooTest.kt", "src/mocks/a.ts", "a.b/c"]
    df = spark.createDataFrame([(p,) for p in rows], "path string").withColumn("f", path_flags())
    got = {r["path"]: r for r in df.select("path", "f", language(F.col("path")).alias("lang"), location_weight("path", "f").alias("w"), mock_path().alias("mock")).collect()}
    assert got["src/test_a.py"]["f"]["test"] and got["vendor/x/a.rs"]["f"]["vendored"] and got["a/dist/b.js"]["f"]["generated"] and got["Cargo.lock"]["f"]["lockfile"]
    assert not got["src/Latest.kt"]["f"]["test"] and got["src/FooTest.kt"]["f"]["test"] and got["src/mocks/a.ts"]["mock"]
    assert [got[p]["w"] for p in ("src/Latest.kt", "web/app.min.js", "vendor/x/a.rs", "src/test_a.py")] == [1.0, 0.1, 0.2, 0.45]
    assert got["a.b/c"]["lang"] is None and got["vendor/x/a.rs"]["lang"] == "rust" and "text" in LANGUAGES
    flags = spark.createDataFrame([("x" * 2500,), ("a\nb",), ("// Code generated by hand\n",), ("a\x00b",)], "t string").select(content_flags(F.col("t"), F.length("t")).alias("f")).collect()
    assert [f["f"]["minified"] for f in flags] == [True, False, False, False] and flags[2]["f"]["generated"] and flags[3]["f"]["binary"]


def test_strings(spark):
    row = spark.createDataFrame([("getHTTPServer2Name foo_bar x été",)], "t string").select(split_tokens(F.lit("getHTTPServer2Name_x")).alias("s"), words(F.col("t")).alias("w"), grams(F.lit("AbCé\nxyz")).alias("g"), constant_style(F.lit("MAX_N")).alias("c"), normal_path(F.lit("./a//b/./c/")).alias("p"), clip(F.lit("a" * 300), F.lit(150), F.lit(152), 20).alias("cut")).first()
    assert row["s"] == ["get", "http", "server2", "name"] and row["w"] == ["getHTTPServer2Name", "foo_bar"] and row["g"] == ["abc", "bcé", "xyz"]
    assert row["c"] and row["p"] == "a/b/c" and len(row["cut"]) == 22
    order = spark.createDataFrame([("a.b/x",), ("a/z",), ("a/b/c",)], "p string").orderBy(path_key(F.col("p"))).collect()
    assert [r["p"] for r in order] == ["a/b/c", "a/z", "a.b/x"]


def test_small_functions():
    import re

    assert re.fullmatch(regex_escape("a+b(c)[d]{e}^$"), "a+b(c)[d]{e}^$")
    assert re.match(glob_regex("*.py"), "a/b.py") and not re.match(glob_regex("*.py"), "a/b.pyc") and re.match(glob_regex("src/**/x"), "src/a/b/x")
    assert query_terms("How does the HTTPServer handle user_sessions?") == ["http", "server", "handle", "user", "sessions"]
    assert estimate("") == 0 and estimate("hello world") == 2 and estimate("x = 12345") >= 4
    assert parse_since("2w") == 1_209_600_000
    with pytest.raises(ValueError):
        parse_since("3 days")
    patch = "--- a/x\n+++ b/y\n@@ -3,2 +3,0 @@\n-a\n-b\n@@ -9 +8,2 @@\n--- /dev/null\n+++ b/new\n@@ -0,0 +1,3 @@\n"
    assert parse_patch(patch) == [{"old": "x", "new": "y", "removed": [(3, 4), (9, 9)], "added": [(8, 9)]}, {"old": None, "new": "new", "removed": [], "added": [(1, 3)]}]
    assert needs_rebuild(100, 6, 1, 0) and not needs_rebuild(10_000, 100, 1, 100)


def test_extraction_looks_for_the_asked_parts_alone(monkeypatch):
    text = "from a import b\n\ndef f():\n    return 1  # c\n"
    whole = code.extract(text, "python")
    assert whole["symbols"] and whole["spans"] and whole["imports"]
    assert code.extract(text, "python", ("symbols",))["symbols"] == whole["symbols"]
    monkeypatch.setattr(code, "_finished", None)  # an import needs no definition
    assert code.imports(text, "python") == whole["imports"]
    monkeypatch.setattr(code, "Tokens", None)  # a span needs no token
    assert code.extract(text, "python", ("spans",))["spans"] == whole["spans"]
