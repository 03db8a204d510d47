"""Near-duplicates by exact Jaccard similarity of word shingles, with SimHash and then MinHash candidates.

A text is the set of XXH64 values of its runs of ``words`` words (lower-cased, cut at ASCII white
space; a shorter text is one run). Texts with equal sets are one node.

First a node has a SimHash fingerprint of its set, and covering masks propose all fingerprints within
``radius`` bits of each other, as in simhash. Pairs at similarity 0.8 differ in 10 of 64 bits on average, which
no affordable set of masks covers, so what those links leave in several components is proposed by MinHash: ``bands`` keys
of ``rows`` minima each; a pair at similarity 0.8 shares no key with a probability of (1 - 0.8^4)^30,
or 1e-7. Fingerprints and keys only propose: every link is verified on the whole sets.

A crowded key never emits its pairs: in each round its members are held against one of them, so pairs are
linear in members, and a key whose members then are all of one component is done. The members of
other keys go to cells (of blocks beyond ``block`` members, every pair of blocks) in
which all pairs are compared, and a cell emits a spanning forest. No pair that shares a key is left out.

Edge cases are those of simhash: null and empty texts are the empty set and equal each other.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.graph import components
from textquarry.llm.memory import frugal
from textquarry.llm.simhash import forest, print_of
from textquarry.llm.simhash import links as near_prints
from textquarry.llm.storage import materialise
from textquarry.llm.tokens import slices


def shingles_of(text: str | None, words: int = 5, seed: int = 42) -> np.ndarray:
    """Distinct shingle values of a whole text, in order."""
    from xxhash import xxh64_intdigest

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
    runs = {b" ".join(parts[k : k + words]) for k in range(max(1, len(parts) - words + 1))} if parts else ()
    return np.unique(np.fromiter((xxh64_intdigest(r, seed) for r in runs), np.uint64))


def node_of(shingles: np.ndarray) -> int:
    """A set's name, a signed long."""
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(shingles.tobytes(), 7)).view(np.int64))


def nodes_of(texts: list[str | None], words: int = 5) -> np.ndarray:
    """The nodes of texts."""
    return np.array([node_of(shingles_of(t, words)) for t in texts], np.int64)


def keys_of(shingles: np.ndarray, bands: int, rows: int, seed: int = 9) -> list[int]:
    """A key of each band; the empty set has none."""
    from xxhash import xxh64_intdigest

    if not len(shingles):
        return []
    rng = np.random.default_rng(seed)
    xor, odd = (rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1) for _ in range(2))
    least = np.full(bands * rows, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1 << 10):
        h = shingles[at : at + (1 << 10), None] ^ xor
        h *= odd
        h ^= h >> np.uint64(32)
        h *= odd
        least = np.minimum(least, h.min(0))
    grid = least.reshape(bands, rows)
    return [int(np.uint64(xxh64_intdigest(grid[b].tobytes(), b)).view(np.int64)) for b in range(bands)]


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) of nodes at ``similarity`` or more."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("sa"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("sb"))
    na, nb = F.size("sa"), F.size("sb")
    both = pairs.join(left, "a").join(right, "b").where(F.least(na, nb) >= similarity * F.greatest(na, nb))
    same = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("same", same).where(F.col("same") / (na + nb - F.col("same")) >= similarity).select("a", "b")


def _near_prints(nodes: DataFrame, radius: int) -> DataFrame:
    """Pairs (a, b) of nodes (columns node, print) to verify: one node of each fingerprint with the others of it, and with those of fingerprints linked by covering masks."""
    first = materialise(nodes.groupBy("print").agg(F.min("node").alias("first"), F.count(F.lit(1)).alias("n")), "prints")
    equal = nodes.join(first.where("n > 1").hint("merge"), "print").where("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b"))
    ends = [first.select(F.col("print").alias(c), F.col("first").alias("f" + c)) for c in "ab"]
    linked = near_prints(first.select(F.col("print").alias("fp")), radius).distinct()
    linked = linked.join(ends[0], "a").join(ends[1], "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))
    return materialise(equal.unionByName(linked), "near-prints")


def _open(held: DataFrame, links: DataFrame, least: int) -> DataFrame:
    """Members of the keys of ``least`` or more that still hold several components; of keys with the same members, one."""
    roots = components(links).withColumnRenamed("root", "found")
    named = held.join(roots, "node", "left").withColumn("root", F.coalesce("found", "node")).drop("found")
    mark = F.sum(F.xxhash64("node").cast("decimal(20,0)"))
    keys = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("n"), mark.alias("mark")).where(f"lo <> hi and n >= {least}")
    keys = keys.groupBy("n", "mark").agg(F.min("key").alias("key"))
    return materialise(held.select("key", "node").join(keys.select("key", "n"), "key"), "open-keys")


def _in_cells(held: DataFrame, sets: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links (a, b) between members (key, node, n) of one key, all pairs compared: a forest that spans every component."""
    held = held.withColumn("k", F.ceil(F.col("n") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    dealt = held.select("key", "node", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    dealt = dealt.select(F.xxhash64("key", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), "node").join(sets, "node")

    def of(nodes, codes):
        sizes = np.array([len(c) for c in codes])
        flat, owner = np.concatenate(codes), np.repeat(np.arange(len(codes)), sizes)
        order = np.argsort(flat, kind="stable")
        owner, flat = owner[order], flat[order]
        near = np.zeros((len(nodes), len(nodes)), bool)
        for k, mine in enumerate(codes):
            lo, hi = np.searchsorted(flat, mine), np.searchsorted(flat, mine, "right")
            same = np.zeros(len(nodes), np.int64)
            for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
                same[owner[a:b]] += 1
            near[k] = same / (sizes[k] + sizes - same) >= similarity
        return forest(nodes, near)

    def forests(batches):
        def out(nodes, codes):
            edges = of(np.array(nodes), codes) if len(nodes) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        cell, nodes, codes = None, [], []
        for batch in batches:  # sorted by cell: the last cell of a batch may go on in the next
            for k in range(batch.num_rows):
                c = batch.column("cell")[k].as_py()
                if c != cell and nodes:
                    yield out(nodes, codes)
                    nodes, codes = [], []
                node = batch.column("node")[k].as_py()
                if c != cell or node != nodes[-1]:
                    nodes.append(node)
                    codes.append(np.array(batch.column("set")[k].values.to_numpy()))
                cell = c
        if nodes:
            yield out(nodes, codes)

    return dealt.repartition("cell").sortWithinPartitions("cell", "node").mapInArrow(frugal(forests), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8, bands: int = 30, rows: int = 4, rounds: int = 2, block: int = 512, radius: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (its node), root (the group, as one of its nodes), component_id."""

    rows_of = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def digest(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                sets = [shingles_of(t, words) for t in part.column("text").to_pylist()]
                keys = [keys_of(s, bands, rows) for s in sets]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([node_of(s) for s in sets], pa.int64()), pa.array(np.array([print_of(s) for s in sets], np.uint64).view(np.int64)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "node", "print", "keys"])

    def again(batches):
        for batch in batches:
            for a, b in slices(batch.column("text")):
                sets = [shingles_of(t, words) for t in batch.column("text").slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "set"])

    keyed = rows_of.mapInArrow(frugal(digest), "doc_id long, node long, print long, keys array<long>")
    keyed = materialise(keyed, "shingles")
    found = keyed.select("doc_id", "node")
    nodes = keyed.groupBy("node").agg(F.min("doc_id").alias("least"), F.any_value("print").alias("print"), F.any_value("keys").alias("keys"))
    nodes = materialise(nodes, "nodes")
    keyed = nodes.select(F.explode("keys").alias("key"), "node")
    crowd = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    held = materialise(keyed.join(crowd, "key"), "crowded")
    near = _near_prints(nodes.select("node", "print"), radius)
    # only sets that are proposed are kept: they are made again from one document of each, as sets are larger than the texts
    proposed = held.select("node").unionByName(near.select(F.col("a").alias("node"))).unionByName(near.select(F.col("b").alias("node")))
    asked = nodes.join(proposed.distinct(), "node", "left_semi").select("least", "node")
    asked = materialise(asked, "asked")
    able = rows_of.join(asked.select("least").distinct(), F.col("doc_id").eqNullSafe(F.col("least")), "left_semi")
    sets = able.select("text").mapInArrow(frugal(again), "node long, set array<long>").join(asked.select("node"), "node", "left_semi")
    sets = materialise(sets.groupBy("node").agg(F.any_value("set").alias("set")), "sets")
    links = materialise(_verified(near, sets, similarity), "links")
    left = _open(held, links, 2)
    for n in range(rounds):
        if left.isEmpty():
            break
        hub = F.min(F.struct(F.xxhash64("node", F.lit(n)), F.col("node").alias("a")))["a"].alias("a")
        pairs = left.join(left.groupBy("key").agg(hub), "key").where("a <> node").select("a", F.col("node").alias("b")).distinct()
        links = materialise(links.unionByName(_verified(pairs, sets, similarity)), "links")
        left = _open(held, links, 3)
    if not left.isEmpty():
        links = materialise(links.unionByName(_in_cells(left, sets, similarity, block)), "links")
    roots = components(links)
    joined = materialise(nodes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("node", "root", "component_id")
    return found.select("doc_id", "node").join(named, "node").select("doc_id", F.col("node").alias("fp"), "root", "component_id")
