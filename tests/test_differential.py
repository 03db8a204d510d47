"""Random trees and patterns: the engine's lines and places against Python's own matching."""

import random
import re

import pytest
from pyspark.sql import functions as F

from textquarry.functions.files import LANGUAGES
from textquarry.operators import index
from textquarry.operators.search import SearchOptions, lines, matched_lines, places

WORDS = ["alpha", "Beta", "get_item", "getItem", "naïve", "ÉTÉ", "x1", "foo", "foobar", "(foo)", "a.b", "日本", "ß", "--", "0x1F", "tab\there"]
PATTERNS = ["foo", "f.o", "[A-Z][a-z]+", r"get_?[iI]tem", "alpha|Beta", "é", r"\d+", r"(foo)+bar", "a.b", "日", r"x\d", "ß"]


def tree(seed):
    rng = random.Random(seed)
    out = []
    for k in range(30):
        body = [" ".join(rng.choices(WORDS, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 8))]
        end = rng.choice(["\n", "\r\n"])
        out.append((k, f"{rng.choice(['src', 'tests', 'a/b'])}/f{k}.{rng.choice(['py', 'rs', 'txt', 'md'])}", end.join(body) + (end if rng.random() < 0.7 and body else ""), "text"))
    return out


def expected(files, pattern, fixed, word, fold, invert, whole):
    body = re.escape(pattern) if fixed else pattern
    if word:
        body = rf"(?<![\w])(?:{body})(?![\w])"
    if whole:
        body = rf"^(?:{body})\Z"
    p = re.compile(body, re.I if fold else 0)
    out = set()
    for k, _, text, _ in files:
        rows = text.split("\n")
        if rows and rows[-1] == "":
            rows = rows[:-1]
        for n, row in enumerate(rows, 1):
            row = row.removesuffix("\r")
            if bool(p.search(row)) != invert:
                out.add((k, n, () if invert else tuple((m.start(), m.end()) for m in p.finditer(row) if m.end() > m.start())))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_engine_equals_python(spark, seed):
    rng = random.Random(100 + seed)
    files = tree(seed)
    df = spark.createDataFrame(files, "file_id long, path string, text string, lang string").cache()
    tables = {"files": df, "words": index.word_postings(df).cache(), "grams": index.gram_postings(df).cache()}
    for _ in range(6):
        pattern = rng.choice(PATTERNS)
        fixed, word, fold, invert, whole = (rng.random() < p for p in (0.3, 0.3, 0.3, 0.15, 0.1))
        o = SearchOptions(pattern, fixed=fixed, whole_word=word, ignore_case=fold, invert=invert, whole_line=whole)
        want = expected(files, pattern, fixed, word, fold, invert, whole)
        for held in (None, tables):
            found = matched_lines(df, o, held).withColumn("m", places(F.col("text"), o.regex()))
            got = {(r["file_id"], r["line"], () if invert else tuple((m["s"], m["e"]) for m in r["m"])) for r in found.collect()}
            assert got == want, (o, held is not None)


def test_lines(spark):
    df = spark.createDataFrame([(1, "a", "one\r\ntwo\n\nfour"), (2, "b", ""), (3, "c", None), (4, "d", "\n")], "file_id long, path string, text string")
    assert sorted((r["file_id"], r["line"], r["text"]) for r in lines(df).collect()) == [(1, 1, "one"), (1, 2, "two"), (1, 3, ""), (1, 4, "four"), (4, 1, "")]


def test_language_lists_do_not_overlap():
    ends = [e for v in LANGUAGES.values() for e in v]
    assert len(ends) == len(set(ends))
