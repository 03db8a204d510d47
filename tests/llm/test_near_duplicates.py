"""SimHash and embeddings against brute force, the components against union-find, the covering property itself."""

import random
import re

import numpy as np
import pytest
import xxhash

from textquarry.llm import embed, graph, queries, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def union(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        up[find(a)] = find(b)
    return [find(k) for k in range(n)]


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    parts = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def texts():
    rng = random.Random(5)
    words = [f"w{k}É" for k in range(400)]
    base = [" ".join(rng.choices(words, k=rng.choice([1, 3, 5, 60, 500]))) for _ in range(25)]
    near = []
    for k in range(60):
        w = base[k % 3 + 20].split(" ")
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, *[base[4]] * 20, None, "", " \t", " ", base[24].upper(), base[24].replace(" ", "\n")]


def test_spark_hash_is_the_same(spark):
    from pyspark.sql import functions as F

    assert spark.range(1).select(F.xxhash64(F.lit("a b c d"))).first()[0] & (1 << 64) - 1 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_masks_cover():
    masks = simhash.covering_masks(4)
    assert len(masks) == 31
    rng = random.Random(1)
    for _ in range(2000):
        change = sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4)))
        assert any((m & (1 << 64) - 1) & change == 0 for m in masks)


@pytest.mark.parametrize("block", [2048, 8])
def test_links_equal_brute_force(spark, block):
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(4)]
    prints = sorted({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 6))) for b in base for _ in range(60)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = graph.components(simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), block=block)).collect()
    place = {p: k for k, p in enumerate(signed)}
    got = list(range(len(prints)))
    for r in found:
        got[place[r["node"]]] = place[r["root"]]
    want = union(len(prints), [(a, b) for a in range(len(prints)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    assert len({(g, w) for g, w in zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_op4(spark, table):
    t = texts()
    ids = [3 * k + 1 for k in range(len(t))]
    d = table("documents", [(i, x, "en", "s", 0) for i, x in zip(ids, t, strict=True)], DOCS)
    prints = [print_of(x) for x in t]
    root = union(len(t), [(a, b) for a in range(len(t)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    least = {r: min(i for i, q in zip(ids, root, strict=True) if q == r) for r in root}
    want = {i: (f"{p:016x}", least[r]) for i, p, r in zip(ids, prints, root, strict=True)}
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op4_simhash(spark, d).collect()} == want
    kept = simhash.keep_one(spark.read.parquet(f"{d}/documents.parquet"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))


def test_op4_edges(spark, table):
    d = table("documents", [(1, "a b c d e", "x", "s", 0), (1, "a b c d e", "x", "s", 0), (None, "a b c d e", "x", "s", 0), (None, "quite another text here", "x", "s", 0), (None, "quite another text here", "x", "s", 0), (5, None, None, None, None)], DOCS)
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in queries.op4_simhash(spark, d).collect())
    assert got == [(0, 0), (0, 0), (0, 1), (1, 1), (1, 1), (5, 5)]
    kept = simhash.keep_one(spark.read.parquet(f"{d}/documents.parquet")).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept) == [(0, "quite another text here"), (1, "a b c d e"), (5, "")]
    assert queries.op4_simhash(spark, table("documents", [], DOCS)).collect() == []


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    root = union(300, pairs)
    nodes = sorted(got)
    assert set(nodes) == {x for p in pairs for x in p if p[0] != p[1]}
    assert len({(got[n], root[n]) for n in nodes}) == len(set(got.values())) == len({root[n] for n in nodes})


def vectors(seed=0, groups=6, dims=64):
    rng = np.random.default_rng(seed)
    out = []
    for label in (0, 1):
        for _ in range(40):
            out.append((rng.standard_normal(dims), label))
        for _ in range(groups):
            centre = rng.standard_normal(dims)
            out += [(centre + rng.standard_normal(dims) * rng.choice([0.05, 0.2, 0.27]), label) for _ in range(12)]
    return out


@pytest.mark.parametrize("how", [{}, {"window_rows": 4}, {"block": 8}, {"least_share": 0.2, "window_rows": 4}])
def test_op5_against_brute_force(spark, how):
    data = vectors()
    df = spark.createDataFrame([(k, [float(x) for x in np.float32(v)], label) for k, (v, label) in enumerate(data)], "vec_id long, embedding array<float>, label int")
    x = np.array([np.float32(v) for v, _ in data], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([g for _, g in data])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r for r in embed.near_vectors(df, **how).collect()}
    links = np.array([got[k]["n_links"] for k in range(len(data))])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.97 * near.sum() > 0
    if not how:
        root = union(len(data), list(zip(*np.nonzero(near), strict=True)))
        least = {r: min(k for k in range(len(data)) if root[k] == r) for r in root}
        assert sum(got[k]["component_id"] != least[root[k]] for k in range(len(data))) <= 2
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


@pytest.mark.parametrize("size", [500, 2000, 6000])
def test_op5_counts_select_what_is_verified(spark, size):
    rng = np.random.default_rng(size)
    x = rng.standard_normal((size, 64))
    for k in range(0, size // 2, 2):  # pairs around the threshold and above
        x[k + 1] = x[k] + rng.standard_normal(64) * rng.choice([0.1, 0.3, 0.38])
    df = spark.createDataFrame([(k, v.tolist(), 7) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    got = {r["vec_id"]: r["n_links"] for r in embed.near_vectors(df).collect()}
    links = np.array([got[k] for k in range(size)])
    assert (links <= near.sum(1)).all() and links.sum() >= 0.95 * near.sum() > 0
    done = embed.pair_counts(df)
    every = size * (size - 1) // 2
    assert near.sum() // 2 * 0.95 <= done["verified"] <= done["counted"]
    assert size < 2000 or done["verified"] < every / (10 if size == 2000 else 40)


def test_op5_edges(spark, table):
    one, far = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    bad = [None, [], [0.0, 0.0, 0.0], [1.0, None, 0.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0]]
    rows = [(1, one, 5), (2, one, 5), (2, one, 5), (3, one, None), (4, far, 5), (None, one, 5), (5, one[:2], 5), (6, [1e-30, 0.0, 0.0], 5), *[(10 + k, v, 5) for k, v in enumerate(bad)]]
    d = table("embeddings", rows, "vec_id long, embedding array<float>, label int")
    got = sorted((r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in queries.op5_embeddings(spark, d).collect())
    assert got == [(0, 4, 1), (1, 4, 1), (2, 4, 1), (2, 4, 1), (3, 0, 3), (4, 0, 4), (5, 0, 5), (6, 4, 1), *[(10 + k, 0, 10 + k) for k in range(len(bad))]]
    assert queries.op5_embeddings(spark, table("embeddings", [], "vec_id long, embedding array<float>, label int")).collect() == []


def test_recall_on_the_bench_table(spark):
    import os

    import pyarrow.dataset as ds

    where = "/root/testdata/sf0.1/embeddings.parquet"
    if not os.path.exists(where):
        pytest.skip("no bench tables")
    t = ds.dataset(where).to_table().to_pydict()
    x = np.array(t["embedding"], dtype=np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array(t["label"])
    near = (x @ x.T >= 0.93) & (label[:, None] == label[None, :])
    got = {r["vec_id"]: r["n_links"] for r in embed.near_vectors(spark.read.parquet(where)).collect()}
    links = np.array([got[v] for v in t["vec_id"]])
    assert (links <= near.sum(1) - 1).all() and links.sum() >= 0.9 * (near.sum() - len(x))
