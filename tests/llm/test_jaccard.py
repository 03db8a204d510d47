"""The pipeline's near-duplicate stage against brute force on whole shingle sets."""

import random

from test_near_duplicates import DOCS, union

import corpus_pipeline
from textquarry.llm import jaccard


def runs(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def alike(a, b):
    return a == b or (bool(a and b) and 5 * len(a & b) >= 4 * len(a | b))


def texts():
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(3000)]
    out = []
    for n in range(40):
        base = rng.choices(vocabulary, k=rng.choice([30, 120, 400]))
        out.append(" ".join(base))
        for _ in range(4):  # runs changed at a few places: similarities on both sides of 0.8
            w = list(base)
            for _ in range(rng.randint(1, max(1, len(w) // 30))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(" ".join(w))
    base = rng.choices(vocabulary, k=100)
    for _ in range(60):  # one large group, most pairs of which are under 0.8
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(100)] = rng.choice(vocabulary)
        out.append(" ".join(w))
    return [*out, None, "", "two words", "Two  WORDS", "other words"]


def kept_of(sets):
    group = union(len(sets), [(i, j) for i in range(len(sets)) for j in range(i) if alike(sets[i], sets[j])])
    return sorted({min(k for k in range(len(sets)) if group[k] == g) for g in set(group)})


def test_stage_equals_brute_force(spark, table):
    rows = [(k, t, "en", "s", 0) for k, t in enumerate(texts())]
    d = table("documents", rows, DOCS)
    want = kept_of([runs(t) for _, t, *_ in rows])
    src = spark.read.parquet(f"{d}/documents.parquet")
    assert sorted(r["doc_id"] for r in corpus_pipeline.without_near_duplicates(spark, src, d).collect()) == want
    for how in ({"rounds": 1, "block": 16}, {"rounds": 1, "block": 1000}):
        got = jaccard.near_duplicates(src, **how).select("component_id").distinct().collect()
        assert sorted(r["component_id"] for r in got) == want


def test_simhash_links_without_minhash(spark, table):
    """Covering masks on fingerprints are a step of the stage: with no MinHash keys they still give every pair within their radius."""
    from textquarry.llm import simhash

    rng = random.Random(5)
    pairs = [(" ".join(w), " ".join([*w, *rng.choices("xyz", k=3)])) for w in ([f"p{rng.randrange(5000)}" for _ in range(300)] for _ in range(40))]
    pairs.append((" ".join("abcdefgh"), " ".join("stuvwxyz")))
    d = table("documents", [(2 * k + i, t, "en", "s", 0) for k, p in enumerate(pairs) for i, t in enumerate(p)], DOCS)
    near = [sum((int(simhash.print_of(jaccard.shingles_of(a))) ^ int(simhash.print_of(jaccard.shingles_of(b)))).bit_count() for a, b in [p]) <= 4 for p in pairs]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.read.parquet(f"{d}/documents.parquet"), bands=0).collect()}
    assert got == {2 * k + i: 2 * k + i * (not n) for k, n in enumerate(near) for i in (0, 1)} and sum(near) >= 30
