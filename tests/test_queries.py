"""Every query with SQL gives the rows that DuckDB gives, on the smallest bench tables."""

import math
import os

import duckdb
import pytest

from textquarry.functions.tokens import estimate
from textquarry.operators import search
from textquarry.operators.search import SearchOptions
from textquarry.queries import QUERIES, SQL
from textquarry.sources.files import documents_as_files

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(DATA):
        pytest.skip("no bench tables")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    said = db.execute(SQL[name])
    names = [c[0] for c in said.description]
    assert sorted(df.columns) == sorted(names)
    assert rows_of(df.columns, df.collect()) == rows_of(names, said.fetchall())


def fitted(found, budget, per_file=4, columns=200):
    """The rows of an answer in rank order that a budget holds, one by one."""
    rows = sorted(found, key=lambda r: (-round(r["score"], 9), r["path"].replace("/", "\x01"), r["line"]))
    many = len({r["path"] for r in rows}) > 3
    seen, spent, out = {}, 0, []
    for r in rows:
        seen[r["path"]] = seen.get(r["path"], 0) + 1
        if many and seen[r["path"]] > per_file:
            continue
        cost = estimate(r["text"][:columns]) + 3 + (estimate(r["path"]) + 2 if seen[r["path"]] == 1 else 0)
        spent += cost
        if spent > budget:
            break
        out.append((r["path"], r["line"], cost, spent))
    return out


def test_search_budget(spark, db):
    got = [tuple(r) for r in QUERIES["search_budget"](spark, DATA).select("path", "line", "cost", "spent").collect()]
    found = search.hits(documents_as_files(spark, DATA), SearchOptions("idiot", fixed=True)).select("path", "line", "text", "score").collect()
    assert len(got) > 3 and sorted(got) == sorted(fitted(found, 2000))


def test_report_layout(spark, db):
    got = {tuple(r) for r in QUERIES["report_layout"](spark, DATA).select("path", "line", "layout").collect()}
    found = search.hits(documents_as_files(spark, DATA), SearchOptions("tion", fixed=True)).select("path", "line", "text", "score").collect()
    best = sorted(found, key=lambda r: (-round(r["score"], 9), r["path"].replace("/", "\x01"), r["line"]))[:10]
    assert len(fitted(found, 2000)) < len(found) and got == {(r["path"], r["line"], "facets") for r in best}


def test_scalar_tokens(spark, db):
    texts = dict(db.execute("select doc_id, text from documents").fetchall())
    assert {r["doc_id"]: r["tokens"] for r in QUERIES["scalar_tokens"](spark, DATA).collect()} == {k: estimate(t) for k, t in texts.items()}


def test_every_query_has_sql_or_a_test():
    assert set(QUERIES) - set(SQL) == {"search_budget", "report_layout", "scalar_tokens"}
