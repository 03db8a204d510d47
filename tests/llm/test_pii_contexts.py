"""Discovery beyond one hop, among many unseeded instances, and of spaced and adjacent identifiers."""

import pytest
from test_near_duplicates import DOCS

from textquarry.llm import pii


@pytest.fixture
def spans(spark, table):
    def of(texts):
        d = table("documents", [(k, t, "", "", 0) for k, t in enumerate(texts)], DOCS)
        found = pii.find(spark.read.parquet(f"{d}/documents.parquet")).select("doc_id", "spans").collect()
        return {r["doc_id"]: [(s["kind"], texts[r["doc_id"]][s["start"] : s["end"]]) for s in r["spans"]] for r in found}

    return of


SEEDS = [f"Well then. My badge phone: +4930123{k:04d}99" for k in range(30)]


def test_a_discovered_identifier_makes_another_context_trusted(spans):
    first = [f"Well then. My badge phone: 030-555{k:04d}" for k in range(8)]
    second = [f"You may reach desk 030-555{k:04d}" for k in range(8)] + ["You may reach desk 040-7778888"]
    got = spans(SEEDS + first + second)
    assert got[len(SEEDS)] == [("phone", "030-5550000")] and got[len(SEEDS) + 16] == [("phone", "040-7778888")]


def test_unseeded_instances_are_no_negatives_but_other_kinds_and_plain_numbers_are(spans):
    unseen = [f"Well then. My badge phone: 030-556{k:04d}" for k in range(15)]
    got = spans(SEEDS + unseen)
    assert all(got[len(SEEDS) + k] == [("phone", f"030-556{k:04d}")] for k in range(15))
    for bad in ([f"Well then. My badge phone: {k}" for k in range(10)], [f"Well then. My badge phone: a{k}@b.example.org" for k in range(10)]):
        got = spans(SEEDS + unseen + bad)
        assert all(got[len(SEEDS) + k] == [] for k in range(15))


def test_spaced_groups_are_one_candidate_and_neighbours_inherit_the_pattern(spans):
    cases = {
        "Well then. My badge phone: 030 5551234, thanks": ["030 5551234"],
        "Well then. My badge phone: (030) 555-12 34.": ["030) 555-12 34"],
        "Well then. My badge phone: 030-5551234, 030-5551235 / x5551236z": ["030-5551234", "030-5551235", "x5551236z"],
        "Well then. My badge phone: 030 5551234 (9 rings) at 10:30:45": ["030 5551234"],
        "Well then. My badge phone: 030 5551234 19abc": ["030 5551234"],
        "Well then. about 030 5551234": [],
        "030 5551234 alone, 555 1234": [],
        "1 2 3 " * 3000: [],
    }
    got = spans(SEEDS + list(cases))
    assert [[v for _, v in got[len(SEEDS) + k]] for k in range(len(cases))] == list(cases.values())
    got = spans([t + " 12 a@b.example.org" for t in SEEDS] + list(cases))
    assert [v for _, v in got[len(SEEDS)]] == ["030 5551234"]
