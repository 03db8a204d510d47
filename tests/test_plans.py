"""The plans are the ones wanted: filters and columns reach the scans, joins have keys, lookups read postings alone."""

import io
from contextlib import redirect_stdout

from textquarry.operators import index, symbols
from textquarry.operators.search import SearchOptions, matched_lines


def plan_of(df):
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def published(spark, tmp_path):
    files = spark.createDataFrame([(k, f"d/f{k}.py", f"def name_{k}():\n    return other_{k % 3}\n", "python") for k in range(50)], "file_id long, path string, text string, lang string")
    index.publish(files, str(tmp_path / "index"), 1)
    return index.open_index(spark, str(tmp_path / "index"))


def test_word_lookup_pushes_its_filter(spark, tmp_path):
    tables = published(spark, tmp_path)
    plan = plan_of(index.candidates(tables, "name_7", fixed=True, whole_word=True))
    assert "PushedFilters: [IsNotNull(word), EqualTo(word,name_7)]" in plan and "ReadSchema: struct<word:string,file_id:bigint>" in plan
    assert "text" not in plan


def test_key_lookup_pushes_its_filter(spark, tmp_path):
    tables = published(spark, tmp_path)
    plan = plan_of(index.candidates(tables, "name_7"))
    assert "PushedFilters: [In(gram" in plan and "struct<gram:bigint,file_id:bigint>" in plan


def test_a_search_with_an_index_joins_by_file(spark, tmp_path):
    tables = published(spark, tmp_path)
    plan = plan_of(matched_lines(tables["files"], SearchOptions("name_7", fixed=True), tables).select("path", "line"))
    assert "LeftSemi" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_a_scan_filters_before_it_cuts_lines(spark, tmp_path):
    tables = published(spark, tmp_path)
    plan = plan_of(matched_lines(tables["files"], SearchOptions("name_7")).select("path", "line"))
    assert plan.index("Filter") < plan.index("Generate") or "RLIKE" in plan
    assert "Exchange" not in plan and "Python" not in plan


def test_interval_joins_keep_their_key(spark, tmp_path):
    tables = published(spark, tmp_path)
    syms = symbols.symbols(tables["files"])
    points = tables["files"].selectExpr("file_id", "5 as offset")
    plan = plan_of(symbols.enclosing(points, syms, ["file_id", "offset"]))
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_counting_words_needs_no_text_shuffle(spark, tmp_path):
    tables = published(spark, tmp_path)
    plan = plan_of(tables["words"].groupBy("word").count())
    assert "partial_count" in plan and "ReadSchema: struct<word:string>" in plan


def test_op4_sends_neither_keys_nor_rows_through_the_driver(spark, tmp_path):
    """A fingerprint's keys are 31 times what Spark estimates; the rows of many copies take a few bytes each in their file."""
    from textquarry.llm import simhash

    spark.range(20_000).selectExpr("xxhash64(id) fp").write.parquet(str(tmp_path / "prints"))
    assert "Broadcast" not in plan_of(simhash.links(spark.read.parquet(str(tmp_path / "prints"))))
    docs = spark.range(400).selectExpr("id as doc_id", "if(id < 300, 'the same text', 'text ' || id) as text")
    joins = plan_of(simhash.near_duplicates(docs)).split("fingerprints-")[0]
    assert "SortMergeJoin" in joins


def test_compact_tables_are_dealt_before_they_are_files(spark, tmp_path):
    from textquarry.queries import QUERIES
    from textquarry.sources.files import ROWS_PER_TASK, parts_as_code

    rows = 3 * ROWS_PER_TASK
    spark.range(rows).selectExpr("id as p_partkey", "'Brand#1' as p_brand", "cast(id % 50 as int) as p_size").coalesce(1).write.parquet(str(tmp_path / "part.parquet"))
    code = parts_as_code(spark, str(tmp_path))
    assert code.rdd.getNumPartitions() == 3 and code.count() == rows
    assert QUERIES["symbol_table_rust"](spark, str(tmp_path)).rdd.getNumPartitions() == 3


def test_bitmaps_are_made_behind_the_shuffle(spark):
    postings = spark.range(100_000).selectExpr("concat('w', id % 7) as word", "id as file_id")
    dealt = index.bitmaps(postings, "word")
    plan = plan_of(dealt)
    assert plan.count("Exchange") and plan[: plan.index("\n\n\n")].index("Exchange") > plan[: plan.index("\n\n\n")].rindex("SortAggregate")
    assert dealt.selectExpr("sum(bitmap_count(files)) as n").first()["n"] == 100_000


def test_a_published_table_is_dealt_by_bytes_of_text(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "TASK_BYTES", 200)
    tables = published(spark, tmp_path)
    for name in ("symbols", "words", "grams"):
        assert len(list((tmp_path / "index" / "base-1" / name).glob("part-*"))) > 4, name  # rows so few went to one task before
    assert tables["symbols"].count() == 50


def test_pieces_of_words_are_as_cut_by_the_pattern(spark):
    from textquarry.functions.text import pieces
    from textquarry.operators.find import _cut

    words = "the The THE aB abC ABc ABCd x_y _abc abc_ a1b 1AB ab1C Abc1 Ab aa XMLHttp camelCase Camel abc_abc AA9bcd".split()
    df = spark.createDataFrame([(w,) for w in words], "word string").selectExpr("word")
    rows = df.select(_cut(df["word"]).alias("got"), pieces(df["word"]).alias("said")).collect()
    assert all(r["got"] == list(dict.fromkeys(r["said"])) for r in rows)
