"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Every source is cut into blocks: a document's block is its rank-free hash bucket, so
blocks are random samples of their source of about ``docs_per_block`` documents. A
source's target in words is met by so many whole passes over its blocks, and one
partial pass that takes blocks in order until the rest is reached; the block in which
it is reached gives its documents in hash order, and the last one gives the words that are
still missing (``cut_last``), or all or none of it, whichever is nearer.

Output shards get their block copies from a splitting tree: a node holds an exact
quota of block copies for each source, and its left child draws its share of them
without replacement (multivariate hypergeometric), the right child keeps the rest. Each shard
walks from the root with generators seeded by node, so shards are planned
independently and reruns agree. A shard's quotas are disjoint runs of each source's
permuted block copies; inside a shard the order is a local shuffle.

Per-source totals (one row for each source) are the only data on the driver. Nothing groups the
rows of a source: passes, prefix sums and cuts work on blocks.

Edge cases: null text is 0 words, is taken with its block and adds nothing; a null
source is a source of its own, last in order; rows that repeat a doc_id and source share a
block and stay separate rows; an empty table, or one without words, takes nothing (targets 0).
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.storage import materialise

WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: list[float], cap: float = 3.0) -> list[float]:
    """Shares of ``sum(sizes)`` by weight, each at most ``cap`` times its size, the excess reshared by weight until none is above."""
    total, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        weight = sum(weights[k] for k in free)
        over = {k for k in free if left * weights[k] / weight > cap * sizes[k]}
        if not over:
            for k in free:
                out[k] = left * weights[k] / weight
            break
        for k in over:
            out[k] = cap * sizes[k]
            left -= out[k]
        free -= over
    return out


def leaf(quotas: np.ndarray, shards: int, shard: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A shard's run of each source's block copies: (starts, counts), by walking the splitting tree from the root."""
    lo, hi, start, have = 0, shards, np.zeros_like(quotas), quotas.copy()
    while hi - lo > 1:
        mid = (lo + hi) // 2
        rng = np.random.default_rng([seed, lo, hi])
        want = int(have.sum()) * (mid - lo) // (hi - lo)
        left = np.zeros_like(have)
        rest, todo = int(have.sum()), want
        for k, n in enumerate(have.tolist()):  # conditional hypergeometric draws, exact for any counts
            rest -= n
            left[k] = rng.hypergeometric(n, rest, todo) if n and rest and 0 < todo < n + rest else min(n, todo) if not rest or todo >= n + rest else 0
            todo -= int(left[k])
        if shard < mid:
            hi, have = mid, left
        else:
            lo, start, have = mid, start + left, have - left
    return start, have


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, docs_per_block: int = 256, blocks_per_shard: int = 16, cut_last: bool = True, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, source, text_key (a hash of its text), size, source_size, target, taken, and ``draws``: its copies as (shard, place, words).

    Sources in code point order, null last, take ``weights`` in turn, repeating. The mix is as large as all sizes.
    """
    rows, chosen, cut, _ = _planned(docs, id_col, text_col, source_col, weights, cap, docs_per_block, blocks_per_shard, cut_last, seed)
    out = rows.select("doc_id", "source", "text_key", "size", "h", "s", "source_size", "target", "block").join(chosen, ["s", "block"])
    out = out.where("not cut").withColumn("some", F.when(F.col("part") > 0, F.col("size")).otherwise(F.lit(0))).unionByName(cut)
    out = out.withColumn("draws", _draws(seed))
    return out.select("doc_id", "source", "text_key", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, d: a + d["words"]).alias("taken"), "draws")


def _size(text_col: str):
    return F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")


def _block():
    """A document's block: its place by hash among the blocks of its source."""
    unit = F.pmod(F.shiftrightunsigned("h", 11), F.lit(1 << 53)) / F.lit(float(1 << 53))
    return F.least(F.floor(unit * F.col("blocks")), F.col("blocks") - 1)


def _draws(seed: int):
    """A document's copies from its block's (``copies``), the words of the partial pass (``some``) and its own hash and size."""
    place = lambda c: F.xxhash64(F.lit(seed), F.col("h"), c["shard"], c["full"])
    none = F.expr("cast(array() as array<struct<shard: bigint, full: boolean>>)")
    each = F.transform(F.coalesce("copies", none), lambda c: F.struct(c["shard"].alias("shard"), place(c).alias("place"), F.when(c["full"], F.col("size")).otherwise(F.col("some")).alias("words")))
    return F.filter(each, lambda d: (d["words"] > 0) | (F.col("size") == 0))


def _planned(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, cap: float, docs_per_block: int, blocks_per_shard: int, cut_last: bool, seed: int):
    """(rows without texts with their source's plan and block, chosen blocks with their copies, rows of cut blocks with ``some``, the sources' plans)."""
    narrow = materialise(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.col(source_col).cast("string").alias("source"),
            _size(text_col).alias("size"),
            F.xxhash64(text_col).alias("text_key"),
        ).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source")),
        "sizes",
    )
    spark = docs.sparkSession
    known = narrow.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")).collect()
    known.sort(key=lambda r: (r["source"] is None, (r["source"] or "").encode("utf-32-be")))
    goal = targets([r["words"] for r in known], [weights[k % len(weights)] for k in range(len(known))], cap)
    plan = []
    for k, (r, t) in enumerate(zip(known, goal, strict=True)):
        whole = round(t)
        passes = whole // r["words"] if r["words"] else 0
        plan.append((k, r["source"], r["words"], t, passes, whole - passes * r["words"], max(1, -(-r["n"] // docs_per_block))))
    plans = spark.createDataFrame(plan, "s int, source string, source_size long, target double, passes long, rest long, blocks long")
    small = F.broadcast if len(plan) <= 10_000 else lambda df: df
    rows = narrow.join(small(plans), narrow["source"].eqNullSafe(plans["source"])).drop(plans["source"])
    rows = rows.withColumn("block", _block())

    # running words over a source's blocks, in two levels so that no window holds more than about a thousand blocks
    block = materialise(rows.groupBy("s", "block", "passes", "rest", "blocks").agg(F.sum("size").alias("words")).withColumn("band", F.floor(F.col("block") / 1024)), "blocks")
    bands = block.groupBy("s", "band").agg(F.sum("words").alias("w"))
    bands = bands.select("s", "band", (F.sum("w").over(Window.partitionBy("s").orderBy("band")) - F.col("w")).alias("before_band"))
    within = F.sum("words").over(Window.partitionBy("s", "band").orderBy("block")) - F.col("words")
    block = block.withColumn("before", within).join(bands, ["s", "band"]).withColumn("part", F.least(F.greatest(F.col("rest") - F.col("before") - F.col("before_band"), F.lit(0)), F.col("words")))
    block = materialise(block.select("s", "block", "blocks", "passes", "words", "part", F.col("part").between(F.lit(1), F.col("words") - 1).alias("cut")), "quotas")

    # block copies: the whole passes (each over a permutation of the blocks), then the partial pass in block order
    # a block without documents (possible in small sources) has no row: copies are counted over block numbers and absent ones join nothing
    ids = [p[0] for p in plan]
    span = {p[0]: (p[4], p[6]) for p in plan}
    last = {r["s"]: r["m"] for r in block.where("part > 0").groupBy("s").agg((F.max("block") + 1).alias("m")).collect()}
    quotas = np.array([span[k][0] * span[k][1] + last.get(k, 0) for k in ids], dtype=np.int64)
    shards = max(1, math.ceil(int(quotas.sum()) / blocks_per_shard))
    sizes = [span[k][1] for k in ids]
    passes = [span[k][0] for k in ids]

    def assign(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                if not ids:
                    continue
                starts, counts = leaf(quotas, shards, shard, seed)
                for k, a, n, b, p in zip(ids, starts.tolist(), counts.tolist(), sizes, passes, strict=True):
                    if not n:
                        continue
                    at = np.arange(a, a + n)
                    turn = np.minimum(at // b, p)
                    number = at - turn * b
                    step = next(x for x in range(int(b * 0.618) + 1, 2 * b + 2) if math.gcd(x, b) == 1)
                    number = np.where(turn < p, (number * step + turn * 7919) % b, number)
                    cols = [np.full(n, k, np.int32), number.astype(np.int64), turn < p, np.full(n, shard, np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["s", "block", "full", "shard"])

    tasks = max(1, min(shards, 4 * spark.sparkContext.defaultParallelism))
    copies = spark.range(0, shards, 1, tasks).mapInArrow(assign, "s int, block long, full boolean, shard long")
    copies = copies.groupBy("s", "block").agg(F.sort_array(F.collect_list(F.struct("shard", "full"))).alias("copies"))
    chosen = materialise(block.select("s", "block", "part", "cut").join(copies, ["s", "block"], "left"), "chosen")

    # the one block of a source in which the rest is reached: its documents in hash order
    out = rows.select("doc_id", "source", "text_key", "size", "h", "s", "source_size", "target", "block").join(chosen.where("cut"), ["s", "block"])
    by_hash = Window.partitionBy("s", "block").orderBy("h", "doc_id", "size")
    cut = out.withColumn("row", F.row_number().over(by_hash)).withColumn("before", F.sum("size").over(by_hash.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    words = F.least(F.greatest(F.col("part") - F.col("before"), F.lit(0)), F.col("size"))
    if not cut_last:
        words = F.when(2 * words >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    return rows, chosen, cut.withColumn("some", words).drop("row", "before"), small(plans)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), cap: float = 3.0, docs_per_block: int = 256, blocks_per_shard: int = 16, seed: int = 17) -> DataFrame:
    """The mix itself: ``docs`` repeated as drawn, whole documents only, brought together by output shard and shuffled inside it.

    A document finds its copies by its block, so texts are moved once, to their shards. Rows equal in id, source and text get the same draws.
    """
    _, chosen, cut, plans = _planned(docs, id_col, text_col, source_col, weights, cap, docs_per_block, blocks_per_shard, False, seed)
    cut = materialise(cut.select("s", "block", F.col("doc_id").alias("c_id"), F.col("text_key").alias("c_key"), F.col("some").alias("c_some")).dropDuplicates(["s", "block", "c_id", "c_key"]), "cut")
    own = F.struct(*docs.columns).alias("doc")
    rows = docs.select(own, F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), _size(text_col).alias("size"), F.xxhash64(text_col).alias("text_key"))
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "source"))
    rows = rows.join(plans.select("s", F.col("source").alias("p_source"), "blocks"), F.col("source").eqNullSafe(F.col("p_source"))).withColumn("block", _block())
    rows = rows.join(chosen, ["s", "block"])
    found = rows.join(cut, (rows["cut"] & (rows["s"] == cut["s"]) & (rows["block"] == cut["block"]) & F.col("doc_id").eqNullSafe(F.col("c_id")) & (F.col("text_key") == F.col("c_key"))), "left")
    some = F.when(rows["cut"], F.coalesce("c_some", F.lit(0))).otherwise(F.when(F.col("part") > 0, F.col("size")).otherwise(F.lit(0)))
    found = found.select("doc", "doc_id", "h", "size", "copies", some.alias("some")).withColumn("draw", F.explode(_draws(seed)))
    found = found.repartition(F.col("draw.shard")).sortWithinPartitions("draw.shard", "draw.place", "doc_id")
    return found.select("doc.*")
