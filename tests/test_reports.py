"""Impact of changes, report shaping, git and configuration, on small inputs."""

import subprocess

from pyspark.sql import functions as F

from textquarry.functions import config
from textquarry.operators import changes, impact, report, search, symbols
from textquarry.operators.search import SearchOptions
from textquarry.sources import git
from textquarry.sources.files import describe

SCHEMA = "file_id long, path string, text string"


def files_of(spark, texts):
    return describe(spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(texts.items())], SCHEMA))


def test_diff_impact(spark):
    old = files_of(spark, {"lib.py": "def gone(x):\n    return x\n\ndef body():\n    return 1\n", "use.py": "from lib import gone\n\ndef main():\n    gone = 3\n    return gone(1) + body()\n", "test_use.py": "gone(2)\n"})
    new = files_of(spark, {"lib.py": "def body():\n    return 2\n", "use.py": "from lib import gone\n\ndef main():\n    gone = 3\n    return gone(1) + body()\n", "test_use.py": "gone(2)\n"})
    side = lambda f: changes.with_bodies(f, symbols.symbols(f))
    changed = changes.changed_definitions(side(old), side(new))
    sites = impact.diff_impact(new, changed, symbols.spans(new), symbols.symbols(new)).collect()
    assert {(r["name"], r["path"], r["line"], r["direct"]) for r in sites} == {("gone", "use.py", 1, True), ("gone", "use.py", 5, True), ("gone", "test_use.py", 1, True), ("body", "use.py", 5, False)}
    few = impact.allotted(impact.diff_impact(new, changed, symbols.spans(new), symbols.symbols(new)), 2).collect()
    assert {r["name"] for r in few} == {"gone", "body"}
    assert impact.declares("let x = 1", 4, 5) and impact.declares("def f(a, x):", 9, 10) and not impact.declares("f(x)", 2, 3) and not impact.declares("let Point { x } = p", 4, 9)
    assert impact.relocate(symbols.symbols(new), "body", "function", 9).first()["line"] == 1


def test_diff_impact_follows_all_names_to_all_sites(spark):
    names = [f"f{k}" for k in range(40)] + ["$q", "a$b"]
    old = files_of(spark, {"lib.js": "".join(f"function {n}() {{ return 1 }}\n" for n in names), "use.js": "\n"})
    new = files_of(spark, {"lib.js": "\n", "use.js": "".join(f"{n}(1)\n" for n in names) + "x$q(2)\na$bc(2)\n" + "f7(1) // f8(1)\n" + "f0(2)\n" * 450})
    changed = changes.changed_definitions(changes.with_bodies(old, symbols.symbols(old)), changes.with_bodies(new, symbols.symbols(new)))
    sites = impact.diff_impact(new, changed, symbols.spans(new), symbols.symbols(new)).collect()
    assert {(r["name"], r["line"]) for r in sites if r["line"] <= 42} == {(n, k + 1) for k, n in enumerate(names)}
    assert [(r["name"], r["kind"]) for r in sites if 42 < r["line"] <= 45] == [("f7", "call")]
    assert sorted(r["turn"] for r in sites if r["name"] == "f0") == list(range(1, 452))


def test_touched(spark):
    new = files_of(spark, {"a.py": "class A:\n    def m(self):\n        return 1\n\n    def n(self):\n        return 2\n"})
    syms = impact.with_last_line(new, symbols.symbols(new))
    got = impact.touched(spark.createDataFrame([("a.py", 3, 3), ("a.py", 1, 1)], "path string, first int, last int"), syms).collect()
    assert {(r["first"], r["name"]) for r in got} == {(3, "m"), (1, "A")}


def test_report_shapes(spark):
    f = files_of(spark, {f"src/d{k}/f{k}.py": "def word():\n    word()\n" + "word = 1\n" * 30 for k in range(8)} | {"x.go": "word\n", "tests/t.py": "word()\n"})
    found = search.hits(f, SearchOptions("word", whole_word=True), None, symbols.spans(f), symbols.symbols(f))
    stats = report.statistics(found).first().asDict()
    assert (stats["files"], stats["hits"], stats["n_def"], stats["demoted_hits"]) == (10, 8 * 32 + 2, 8, 1)
    kind, shown = report.layout(found, SearchOptions("word", budget=300))
    assert kind == "facets" and shown.where("kind = 'def'").count() > 0
    assert report.layout(found.limit(3), SearchOptions("word"))[0] == "content"
    assert report.no_grammar_note(found).first().asDict() == {"files": 1, "extensions": ["go"]}
    assert report.kept_lines(found, 1, 2).groupBy("path").count().agg(F.max("count")).first()[0] <= 4
    assert report.fit(found, SearchOptions("word", budget=2000), 200).count() < 20
    assert "no_tests" in report.hints(SearchOptions("word"), stats, True, "src", 5) and report.hints(SearchOptions("x"), {"hits": 0}, False, None, 0)
    assert report.within_bytes(spark.createDataFrame([(1, "abc"), (2, "defg")], "position int, text string"), 5).count() == 1
    assert report.explain(found, 3).count() == 3 and report.file_order(found, "path").first()["path"].startswith("src/d0")
    assert report.import_files(found).count() == 0


def test_git(spark, tmp_path):
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)
    run("init", "-q")
    (tmp_path / "a.py").write_text("one\ntwo\nthree\n")
    run("add", ".")
    run("commit", "-qm", "first")
    (tmp_path / "a.py").write_text("one\n2\nthree\n")
    (tmp_path / "new.py").write_text("x\ny\n")
    files, ranges = git.changes(spark, str(tmp_path))
    assert {tuple(r) for r in files.collect()} == {("a.py", "a.py"), (None, "new.py")}
    assert {tuple(r) for r in ranges.collect()} == {("a.py", 2, 2), ("new.py", 1, 2)}
    assert git.snapshot(spark, str(tmp_path), "HEAD", ["a.py", "new.py"]).collect()[0]["text"] == "one\ntwo\nthree\n"


def test_configuration():
    tree = {"base.json": '{"compilerOptions": {"baseUrl": "."}}', "app/tsconfig.json": '{ // child\n "extends": "../base", "compilerOptions": {"paths": {"@/*": ["src/*"], "lib": ["vendor/lib"],}}}'}
    got = config.compiler_paths(tree.get, "app/tsconfig.json")
    assert got == {"base": ".", "paths": {"@/*": ["src/*"], "lib": ["vendor/lib"]}}
    assert config.aliased("@/a/b", got) == ["src/a/b"] and config.aliased("lib", got) == ["vendor/lib"] and config.aliased("other", got) == ["./other"]
    import re

    assert re.match(config.workspace_regex("packages/*"), "packages/a") and not re.match(config.workspace_regex("packages/*"), "packages/a/b")
    assert config.path_arguments(["src", "*.py"], lambda p: p == "src") == (["src"], ["*.py"])


def test_areas(spark):
    paths = {"a/b/c/1.txt": 10, "a/b/d/2.txt": 10, "a/e/3.txt": 2, "f/4.txt": 3, "5.txt": 1, "g/h/i/j/6.txt": 4}
    f = describe(spark.createDataFrame([(k, p, "hit\n" * n) for k, (p, n) in enumerate(paths.items())], SCHEMA))
    got = [(r["area"], r["hits"]) for r in search.areas(search.matched_lines(f, SearchOptions("hit"))).collect()]
    assert got == [("a/b/c", 10), ("a/b/d", 10), ("g", 4), ("f", 3), ("a/e", 2), ("", 1)]


def test_selection(spark):
    skipped = spark.createDataFrame([("build/a.py", "ignored"), (".x/b.py", "hidden"), ("build/c.txt", "ignored")], "path string, why string")
    assert {tuple(r) for r in search.skipped_reached(skipped, SearchOptions("x", globs=("*.py",))).collect()} == {("ignored", 1), ("hidden", 1)}
    f = files_of(spark, {"a.py": "def solo():\n    return 1\n", "b.go": "solo\n", "vendor/c.py": "", "d.min.js": "x"})
    assert {r["path"] for r in search.of_types(f, ["python", "go"], ["go"]).collect()} == {"a.py", "vendor/c.py"}
    assert {r["path"]: r["a"] for r in f.select("path", search.admission().alias("a")).collect()} == {"a.py": 0, "b.go": 0, "vendor/c.py": 2, "d.min.js": 3}
    found = search.hits(f, SearchOptions("ol", fixed=True), None, symbols.spans(f), symbols.symbols(f))
    assert {r["w"] for r in found.select(search.word_around(F.col("text"), F.col("first.s"), F.col("first.e")).alias("w")).collect()} == {"solo"}
    assert search.adaptive_context(f, found, 1).count() == 2
    assert [r["path"] for r in search.in_path_order(found)] == ["a.py", "b.go"]


def test_symbol_helpers(spark):
    from textquarry.operators import usage, verbs
    from textquarry.streaming import refresh

    f = files_of(spark, {"p/a.py": 'from b import one\n\nclass A:\n    """First line.\n\n    More."""\n    def m(self):\n        return 1\n', "p/b.py": "one = 1\n", "test_c.py": "class A:\n    pass\n"})
    s, ranks = symbols.symbols(f), f.select("file_id", F.lit(1.0).alias("rank"))
    assert [r["file_id"] for r in symbols.best_named(s, ranks, "A").collect()] == [0, 2]
    assert [r["doc"] for r in symbols.documentation(f, s, symbols.spans(f)).where("sym_id = 0").collect()] == ["First line."]
    assert symbols.origin_ids(f, ["./p/b.py"]).first()[0] == 1
    assert spark.range(1).select(symbols.quantized(F.lit(None).cast("double")).alias("q")).first()["q"] == 0.5
    assert [r["line"] for r in verbs.body(f, 0, 3, 8, budget=1).collect()] == [3, 4, 5]
    assert {(r["src"], r["dst"]) for r in refresh.graph_after(f).collect()} == {(0, 1)}
    assert refresh.graph_after(f.where("file_id <> 1")).count() == 0
    e = spark.createDataFrame([(1, "/a/b", "s1", "1.2.0", 5.0), (9, "/a", "s2", "1.3", 7.0), (9, "/ab", "t", "1.20", 1.0)], "ts long, cwd string, session string, version string, ms double")
    assert usage.chosen(e, 5, 10).count() == 2 and usage.chosen(e, directory="/a").count() == 2 and usage.chosen(e, session="s", version="1.2").count() == 1
    assert usage.summarize(e, ["version"], "ms").count() == 3 and [usage.backoff_seconds(k) for k in (0, 1, 2, 20)] == [0, 30, 60, 3600]
    log = spark.createDataFrame([("s", 1, "q"), ("s", 2, "q"), ("s", 3, "q")], "session_id string, t int, query string")
    assert [r["t"] for r in usage.loop_hint(log, F.col("query")).collect()] == [3]
