"""Sources, ladder, refresh, streaming, pairing and change queries on small inputs."""

import random

import numpy as np
from pyspark.sql import functions as F

from textquarry.operators import changes, index, search, symbols, usage, verbs
from textquarry.operators.search import SearchOptions
from textquarry.sources import files as src
from textquarry.sources import sinks
from textquarry.streaming import refresh


def make_tree(root):
    for path, data in {"src/a.py": b"from b import helper\n\ndef run():\n    return helper(1)\n", "src/b.py": b"def helper(x):\n    return x\n", "tests/test_a.py": b"from a import run\nrun()\n", "notes.txt": "café helper\n".encode(), "bin.dat": b"a\x00b helper", "build/x.py": b"helper\n", "src/__init__.py": b"", ".hidden/y.py": b"helper\n", "u16.txt": "helper é\n".encode("utf-16")}.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    return str(root)


def test_tree(spark, tmp_path):
    files, skipped = src.tree(spark, make_tree(tmp_path), ignore=["build/"])
    got = {r["path"]: r for r in files.collect()}
    assert set(got) == {"src/a.py", "src/b.py", "src/__init__.py", "tests/test_a.py", "notes.txt", "bin.dat", "u16.txt"}
    assert got["bin.dat"]["text"] is None and got["u16.txt"]["text"].startswith("helper") and got["tests/test_a.py"]["flags"]["test"]
    assert {(r["path"], r["why"]) for r in skipped.collect()} == {("build/x.py", "ignored"), (".hidden/y.py", "hidden")}
    hit = search.matched_lines(files, SearchOptions("helper", fixed=True, whole_word=True))
    assert {(r["path"], r["line"]) for r in hit.collect()} == {("src/a.py", 1), ("src/a.py", 4), ("src/b.py", 1), ("notes.txt", 1), ("u16.txt", 1)}
    s, e = symbols.symbols(files), symbols.edges(symbols.resolve(symbols.imports(files), files))
    name = {r["file_id"]: r["path"] for r in files.collect()}
    assert {(name[r["src"]], name[r["dst"]], r["weight"]) for r in e.collect()} == {("src/a.py", "src/b.py", 10), ("tests/test_a.py", "src/a.py", 10)}
    assert {(r["path"], r["symbol"]) for r in verbs.callers(files, "helper", symbols.spans(files), s).collect()} == {("src/a.py", "run")}
    assert {(r["path"], r["grade"]) for r in verbs.impact(files, "helper", symbols.spans(files), s, e).collect()} == {("src/a.py", "likely"), ("notes.txt", "review"), ("u16.txt", "review")}


def test_ladder_and_outcome(spark):
    files = src.one_text(spark, "createNode(1)\nnothing\n")
    rung, found = search.ladder(files, SearchOptions("CREATENODE", fixed=True))
    assert rung == "ignore_case" and found.count() == 1
    row = search.outcome(found, found, rung).first()
    assert (row["total"], row["exit"]) == (1, 1)
    assert search.ladder(files, SearchOptions("absent"))[0] == "none"


def test_budget_and_report(spark):
    files = spark.createDataFrame([(k, f"d/f{k}.txt", "word here\n" * 10, "text") for k in range(6)], "file_id long, path string, text string, lang string")
    shown = search.fit_budget(search.hits(files, SearchOptions("word")), SearchOptions("word", budget=100))
    assert 0 < shown.count() < 24 and shown.agg(F.max("spent")).first()[0] <= 100
    assert sinks.report(shown).startswith("d/f0.txt\n  1: word here")


def test_empty_and_null(spark):
    files = spark.createDataFrame([(1, "a.py", None, "python"), (2, "b.py", "", "python")], "file_id long, path string, text string, lang string")
    assert search.hits(files, SearchOptions("x")).count() == 0
    assert symbols.symbols(files).count() == 0 and index.word_postings(files).count() == 0 and index.gram_postings(files).count() == 0


def test_refresh_equals_rebuild(spark, tmp_path):
    row = lambda k, t: (k, f"p{k}", t)
    schema = "file_id long, path string, text string"
    old = spark.createDataFrame([row(1, "alpha beta"), row(2, "gamma"), row(3, "delta")], schema)
    new = spark.createDataFrame([row(1, "alpha beta"), row(2, "gamma two"), row(4, "epsilon")], schema)
    where = str(tmp_path / "index")
    index.publish(old, where, 1)
    refresh.refresh(where, new, 2)
    after = index.open_index(spark, where)
    as_set = lambda df: {tuple(r) for r in df.collect()}
    assert as_set(after["words"].select("word", "file_id")) == as_set(index.word_postings(new).select("word", "file_id"))
    assert as_set(after["grams"].select("gram", "file_id")) == as_set(index.gram_postings(new).select("gram", "file_id"))


def code_tree(spark, edits=None):
    """Eighty files that import each other; ``edits``: number -> text, or None for a file that is gone."""
    texts = {k: f"from m{(k + 1) % 80} import f{(k + 1) % 80}\nclass C{k}(B{k}):\n    def f{k}(self):\n        return f{(k + 1) % 80}(1)\n" for k in range(80)} | (edits or {})
    return spark.createDataFrame([(k, f"m{k}.py", t, "python") for k, t in texts.items() if t is not None], "file_id long, path string, text string, lang string")


def test_a_delta_holds_the_change_alone_and_reads_like_a_rebuild(spark, tmp_path):
    where, whole = str(tmp_path / "index"), str(tmp_path / "whole")
    index.publish(code_tree(spark), where, 1)
    edits = {3: "from m99 import z\nNEW_NAME = 1\n"}
    after = refresh.refresh(where, code_tree(spark, edits), 2)
    assert after["deltas"] == ["delta-2"] and "reasons" not in after
    assert spark.read.parquet(f"{where}/delta-2/files").count() == 1 and spark.read.parquet(f"{where}/delta-2/words").count() < 10
    # a second delta: a file appears that a file imports which did not change
    edits |= {99: "def z():\n    pass\n"}
    after = refresh.refresh(where, code_tree(spark, edits), 3)
    assert after["deltas"] == ["delta-2", "delta-3"]
    index.publish(code_tree(spark, edits), whole, 1)
    got, want = index.open_index(spark, where), index.open_index(spark, whole)
    for t in ("files", "words", "grams", "pieces", "symbols", "spans", "imports", "edges"):
        columns = sorted(want[t].columns)
        assert sorted(map(str, got[t].select(*columns).collect())) == sorted(map(str, want[t].select(*columns).collect())), t
    assert {(r["src"], r["dst"]) for r in got["edges"].where("src = 3").collect()} == {(3, 99)}
    # nothing changed: no version; unread files stay; a larger change rebuilds
    assert refresh.refresh(where, code_tree(spark, edits), 4)["version"] == 3
    assert refresh.refresh(where, code_tree(spark, edits).withColumn("text", F.when(F.col("file_id") != 5, F.col("text"))), 4)["version"] == 3
    assert refresh.refresh(where, code_tree(spark, edits | {5: None, 6: None, 7: None}), 4)["reasons"] == ["threshold"]
    assert index.open_index(spark, where)["files"].count() == 78
    assert refresh.rebuild_reasons(index.manifest_of(spark, where), 0, 0, {"ignore": "new"}) == ["ignore"]


def test_answer_first(spark):
    old, new = code_tree(spark), code_tree(spark, {3: "UNSEEN = 1\n", 4: None})
    tables = {"files": old, "words": index.word_postings(old), "grams": index.gram_postings(old)}
    now = refresh.merged(tables, refresh.delta(old, new))
    assert {r["path"] for r in search.matched_lines(now["files"], SearchOptions("UNSEEN"), now).collect()} == {"m3.py"}
    assert {r["path"] for r in search.matched_lines(now["files"], SearchOptions("C[34]\\b"), now).collect()} == set()


def test_resolution_reads_the_project(spark):
    files = {
        "web/tsconfig.json": '{"compilerOptions": {"baseUrl": ".", "paths": {"@lib/*": ["lib/*"]}}} // c', "web/lib/a.ts": "", "web/b.ts": "import { x } from '@lib/a'\nimport u from 'util'\nimport p from 'pack'\n", "web/util.ts": "",
        "pack/package.json": '{"name": "pack", "main": "main.js"}', "pack/main.js": "", "core/Cargo.toml": '[package]\nname = "my-core"\n', "core/src/lib.rs": "mod deep;\n", "core/src/deep/mod.rs": "use super::other::f;\n", "core/src/other.rs": "", "app/src/main.rs": "use my_core::deep::D;\n",
        "py/pyproject.toml": "", "py/src/pkg/__init__.py": "", "py/src/pkg/m.py": "from . import n\nfrom pkg.n import k\nimport pkg.n.k\n", "py/src/pkg/n.py": "",
    }
    df = src.describe(spark.createDataFrame([(k, p, t) for k, (p, t) in enumerate(files.items())], "file_id long, path string, text string"))
    name = {k: p for k, p in enumerate(files)} | {None: None}
    got = {(name[r["file_id"]], r["module"], name[r["target"]]) for r in symbols.resolve(symbols.imports(df), df, symbols.read_context(df)).collect()}
    assert got == {
        ("web/b.ts", "@lib/a", "web/lib/a.ts"), ("web/b.ts", "util", "web/util.ts"), ("web/b.ts", "pack", "pack/main.js"), ("core/src/lib.rs", "self::deep", "core/src/deep/mod.rs"), ("core/src/deep/mod.rs", "super::other", "core/src/other.rs"),
        ("app/src/main.rs", "my_core::deep", "core/src/deep/mod.rs"), ("py/src/pkg/m.py", ".", "py/src/pkg/__init__.py"), ("py/src/pkg/m.py", "pkg.n", "py/src/pkg/n.py"), ("py/src/pkg/m.py", "pkg.n.k", "py/src/pkg/n.py"),
    }


def test_kinds_of_every_occurrence(spark):
    text = "from m import foo\r\nclass A:\r\n    foo = 1\r\n\r\ndef foo():  # foo\r\n    \"\"\"foo\"\"\"\r\n    return foo(1) + x.foo\r\n"
    files = spark.createDataFrame([(1, "a.py", text, "python"), (2, "b.txt", "foo foo\n", "text")], "file_id long, path string, text string, lang string")
    facts = symbols.extract(files)
    tables = [symbols.part(facts, n) for n in ("spans", "symbols", "imports")]
    for given in ((), tables):
        found = search.hits(files, SearchOptions("foo", fixed=True, whole_word=True), None, *given)
        got = {(r["file_id"], r["line"]): r["kinds"] for r in found.collect()}
        assert got == {(1, 1): ["import"], (1, 3): ["def"], (1, 5): ["def", "comment"], (1, 6): ["doc"], (1, 7): ["call", "member"], (2, 1): ["ident", "ident"]}
    only = search.hits(files, SearchOptions("foo", fixed=True, whole_word=True, kinds=("comment", "member")))
    assert {(r["line"], r["kind"], r["primary"]) for r in only.collect()} == {(5, "comment", 1), (7, "member", 1)}
    assert [(r["line"], r["last_line"]) for r in search.multiline_hits(files, SearchOptions(r"1\r?\n\s*def")).collect()] == [(3, 5)]


def test_stream_applies_batches(spark, tmp_path):
    schema = "file_id long, path string, text string"
    where, feed = str(tmp_path / "index"), tmp_path / "feed"
    index.publish(spark.createDataFrame([(0, "p1", "alpha")], schema).withColumn("file_id", F.xxhash64("path")), where, 0)
    spark.createDataFrame([("p1", "changed text", False), ("p2", "beta", False)], "path string, text string, deleted boolean").coalesce(1).write.parquet(str(feed))
    stream = spark.readStream.schema("path string, text string, deleted boolean").parquet(str(feed))
    refresh.apply_batches(stream, where, str(tmp_path / "cp")).awaitTermination(120)
    versions = spark.read.parquet(f"{where}/manifest").count()
    refresh.apply_batches(stream, where, str(tmp_path / "again")).awaitTermination(120)  # the same batch again is left out
    assert spark.read.parquet(f"{where}/manifest").count() == versions
    assert {r["word"] for r in index.open_index(spark, where)["words"].collect()} == {"changed", "text", "beta"}


def test_windowed_usage(spark, tmp_path):
    spark.createDataFrame([(1, "2024-01-01 00:10:00", "view", 1.0), (2, "2024-01-01 00:20:00", "view", 2.0), (3, "2024-01-05 00:00:00", "view", 5.0)], "event_id long, ts string, event_type string, value double").selectExpr("event_id", "to_timestamp(ts) as ts", "event_type", "value").write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, ts timestamp, event_type string, value double").parquet(str(tmp_path / "e"))
    q = refresh.windowed_usage(stream).writeStream.format("memory").queryName("usage_out").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r["events"], r["value"]) for r in spark.sql("select * from usage_out").collect()} == {(2, 3.0)}


def test_pairing(spark):
    hooks = spark.createDataFrame([("a", 0, 1), ("a", 50_000, 2), ("b", 0, 3), ("a", 900_000, 4)], "key string, ts long, hook_id long")
    runs = spark.createDataFrame([("a", 60_000, 10), ("a", 61_000, 11), ("a", 62_000, 12), ("b", 130_000, 13), ("a", 900_000, 14)], "key string, ts long, run_id long")
    assert {tuple(r) for r in usage.pair_runs(hooks, runs).collect()} == {(10, 2), (11, 1), (14, 4)}


def test_pairing_equals_brute_force(spark):
    import random

    rng = random.Random(5)
    hooks = [(rng.choice("ab"), rng.randrange(0, 3_000_000, 1000) , k) for k in range(80)]
    runs = [(rng.choice("ab"), rng.randrange(500, 3_000_000, 1000), 100 + k) for k in range(80)]
    used, want = set(), set()
    for key, ts, run in sorted(runs, key=lambda r: (r[1], r[2])):
        able = [h for h in hooks if h[0] == key and h[2] not in used and 0 <= ts - h[1] <= 120_000]
        if able:
            best = max(able, key=lambda h: (h[1], h[2]))
            used.add(best[2])
            want.add((run, best[2]))
    h = spark.createDataFrame(hooks, "key string, ts long, hook_id long")
    r = spark.createDataFrame(runs, "key string, ts long, run_id long")
    assert {tuple(x) for x in usage.pair_runs(h, r).collect()} == want


def test_changed_definitions(spark):
    schema = "file_id long, path string, text string, lang string"
    old = spark.createDataFrame([(1, "m.py", "def a(x):\n    return 1\n\ndef b():\n    return 2\n\ndef gone():\n    pass\n\ndef same():\n    pass\n", "python")], schema)
    new = spark.createDataFrame([(1, "m.py", "def a(x, y):\n    return 1\n\ndef b():\n    return 3\n\ndef come():\n    pass\n\ndef same():\n    pass\n", "python")], schema)
    side = lambda f: changes.with_bodies(f, symbols.symbols(f))
    got = {(r["name"], r["change"], r["new_name"]) for r in changes.changed_definitions(side(old), side(new)).collect()}
    assert got == {("a", "signature", None), ("b", "body", None), ("gone", "renamed", "come")}
    uses = changes.uses_of_changes(new, changes.changed_definitions(side(old), side(new)))
    assert {(r["name"], r["line"]) for r in uses.collect()} == {("a", 1), ("b", 4)}


def test_session_rules(spark):
    shown = spark.createDataFrame([("s", 1, "f", 1, 10, 5), ("s", 2, "f", 3, 4, 5), ("s", 3, "f", 3, 4, 6), ("s", 4, "g", 3, 4, 5)], "session_id string, t int, file string, first int, last int, mtime int")
    assert [r["t"] for r in usage.covered(shown).collect()] == [2]
    log = spark.createDataFrame([("s", k) for k in range(10)], "session_id string, t int")
    assert {r["t"] for r in usage.compact(log, 8).collect()} == {6, 7, 8, 9}


def test_entry_imports_without_llm(monkeypatch):
    import builtins
    import importlib
    import sys

    real = builtins.__import__

    def block(name, *a, **k):
        if name == "textquarry.llm" or (a and "textquarry.llm" in str(name)):
            raise ImportError(name)
        return real(name, *a, **k)

    monkeypatch.setattr(builtins, "__import__", block)
    for m in [m for m in sys.modules if m.startswith("textquarry.llm")]:
        monkeypatch.delitem(sys.modules, m)
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)
    entry = importlib.import_module("__spark_entry__")
    assert "search_regex" in entry.queries() and not any(n.startswith("op") for n in entry.queries())
    monkeypatch.delitem(sys.modules, "__spark_entry__", raising=False)


def test_pagerank_rounds_hold_importing_files_alone(spark, monkeypatch):
    """Ranks equal those of dense rounds; before the last round no row is made for a file without imports."""
    rng = random.Random(5)
    pairs = {(a, b): rng.choice([10, 20, 30]) for a, b in [(0, 1), (1, 2), (2, 0), (3, 0), (4, 4), *((rng.randrange(8), rng.randrange(60)) for _ in range(80))]}
    made, write = [], symbols.written
    monkeypatch.setattr(symbols, "written", lambda df, name: (out := write(df, name), name == "ranked" and made.append(out.count()))[0])
    nodes = spark.createDataFrame([(k,) for k in range(70)], "file_id long")
    got = {r["file_id"]: r["rank"] for r in symbols.pagerank(nodes, spark.createDataFrame([(a, b, w) for (a, b), w in pairs.items()], "src long, dst long, weight long"), 6).collect()}
    share, rank = np.zeros((70, 70)), np.full(70, 1 / 70)
    for (a, b), w in pairs.items():
        share[a, b] = w / sum(v for (s, _), v in pairs.items() if s == a)
    for _ in range(6):
        rank = 0.15 / 70 + 0.85 * (rank @ share + rank[share.sum(1) == 0].sum() / 70)
    assert np.allclose([got[k] for k in range(70)], rank / rank.max(), atol=1e-12)
    assert made == [len({a for a, _ in pairs})] * 5 + [70]
    none = symbols.pagerank(nodes.where("file_id < 3"), spark.createDataFrame([], "src long, dst long, weight long"), 2)
    assert sorted((r["file_id"], r["rank"]) for r in none.collect()) == [(0, 1.0), (1, 1.0), (2, 1.0)]
