"""The key planner never loses a match, and the index finds what a scan finds."""

import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from textquarry.operators import index
from textquarry.operators.search import SearchOptions, matched_lines
from textquarry.plans import regex_plan as rp


def holds(query, keys):
    if query[0] == "gram":
        return query[1] in keys
    if query[0] == "and":
        return all(holds(q, keys) for q in query[1])
    if query[0] == "or":
        return any(holds(q, keys) for q in query[1])
    return query[0] == "all"


def keys_of(text):
    folded = "".join(c.lower() if c.isascii() else c for c in text)
    return {p[k : k + 3] for p in folded.split("\n") for k in range(len(p) - 2)}


leaf = st.sampled_from(["a", "b", "ab", "abc", "foo", "bar_", "[ab]", "[a-c]x", ".", r"\w", "é", "X", "(?i:Foo)", "(?i:é)", "sk", "(?-i:k)"])
pattern = st.recursive(leaf, lambda p: st.one_of(st.tuples(p, p).map("".join), st.tuples(p, p).map(lambda t: f"(?:{t[0]}|{t[1]})"), st.tuples(p, st.sampled_from("*+?")).map(lambda t: f"(?:{t[0]}){t[1]}"), p.map(lambda x: f"(?:{x}){{2,3}}")), max_leaves=8)


@settings(max_examples=400, deadline=None)
@given(pattern, st.text(alphabet="abcfoxr_éÉXskSſ\u212aFO\n", max_size=30), st.booleans())
def test_plan_is_sound(p, text, fold):
    if re.search(p, text, re.I if fold else 0):
        assert holds(rp.plan(p, fold=fold), keys_of(text))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abiskéÉßςσΣ", min_size=1, max_size=6), st.text(alphabet="abiskABISKéÉßẞςσΣſ\u212aİı\n", max_size=30))
def test_literal_plan_is_sound_in_any_case(literal, text):
    if re.search(re.escape(literal), text, re.I):
        assert holds(rp.plan(literal, fixed=True, fold=True), keys_of(text))


def test_plan_shapes():
    assert rp.plan("abcd") == ("and", (("gram", "abc"), ("gram", "bcd")))
    assert rp.plan("a.*b") == rp.ALL
    assert rp.plan("foo|bar")[0] == "or"
    assert rp.word_plan("get_(set|item)") == {"get_set", "get_item"}
    assert rp.word_plan(r"\w+") is None and rp.word_plan("(?i)foo") is None and rp.word_plan("a(?i:foo)") is None and rp.word_plan("(?-i:foo)") == {"foo"}
    assert rp.thin(rp.plan("abcd"), {"abc": 3, "bcd": 0}) == rp.NONE


@pytest.mark.parametrize("p,word,how", [("createNode", False, {}), ("get_[a-z]+", False, {}), ("node", True, {}), ("(foo|bar)Baz", False, {}), ("x", False, {}), ("naïve", True, {}), ("node", True, {"smart_case": True}), ("Node", True, {"smart_case": True}), ("(?i)node", True, {}), ("(?i:node)s?", True, {}), ("naïve", False, {"smart_case": True}), ("naïve", True, {"fixed": True, "smart_case": True}), (("node", "naïve"), True, {"fixed": True}), (("foo", "x"), False, {"ignore_case": True}), ("kiss", False, {"fixed": True, "ignore_case": True})])
def test_index_equals_scan(spark, p, word, how):
    rng = random.Random(7)
    vocabulary = ["createNode", "node", "nodes", "get_item", "get_", "fooBaz", "barBaz", "x", "naïve", "naïveté", "Node", "NODES", "NAÏVE", "Naïve", "\u212aiſS", "KİSs"]
    files = spark.createDataFrame([(k, f"d{k % 3}/f{k}.txt", "\n".join(" ".join(rng.choices(vocabulary, k=3)) for _ in range(rng.randint(0, 4))), "text") for k in range(40)], "file_id long, path string, text string, lang string")
    tables = {"files": files, "words": index.word_postings(files), "grams": index.gram_postings(files)}
    o = SearchOptions(p, whole_word=word, **how)
    as_set = lambda df: {(r["path"], r["line"]) for r in df.collect()}
    assert as_set(matched_lines(files, o, tables)) == as_set(matched_lines(files, o))
