"""Registered searches cover files of any size, as their SQL does."""

import duckdb

from textquarry.queries import QUERIES, SQL


def test_a_text_over_4_mib_is_searched(spark, table):
    text = "x" * (4 << 20) + "\nand that is all, nation and moment\n"
    d = table("documents", [(2, text, "en", "src1", len(text)), (3, "but that is", "en", "src1", 11)], "doc_id long, text string, lang string, source string, n_chars long")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
    for name in ("search_whole_word", "search_counts"):
        got = sorted(map(str, (tuple(r) for r in QUERIES[name](spark, d).collect()))) if name in QUERIES else None
        if got is not None:
            assert got == sorted(map(str, con.execute(SQL[name]).fetchall()))
    assert any("doc_2" in r["path"] for r in QUERIES["search_whole_word"](spark, d).collect())
