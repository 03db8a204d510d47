"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit for each bit that is set in over half of its shingles'
XXH64 values. Distinct fingerprints are masked by 2^(r+1)-1 structured masks: bit
positions get random codes of r+1 bits, and mask v keeps the positions whose code has an odd
product with v. Whatever r positions differ, some v is orthogonal to all of their
codes, so every pair within radius r agrees under some mask: no link is lost.

Work is done on distinct fingerprints, so copies of a text cost nothing more. A
bucket never emits its pairs: a task that holds it emits a spanning forest of
its links. Buckets of up to ``block`` fingerprints are whole; larger ones are cut into blocks
and every pair of blocks is a bucket of its own, so no task holds an unbounded group and no pair is left out.

Edge cases: null and empty texts have fingerprint zero and link like any other;
null doc_ids never name a component unless all of its ids are null; rows that repeat a
doc_id stay rows of their own; an empty table gives no rows. Only the two named columns are read.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.graph import components
from textquarry.llm.memory import frugal
from textquarry.llm.storage import materialise


def print_of(hashes: np.ndarray) -> np.uint64:
    """The bits that are set in over half of the values."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        ones += np.unpackbits(hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0]


def fingerprints_of(texts: list[str | None], words: int = 4, seed: int = 42) -> np.ndarray:
    """Unsigned 64-bit fingerprints of whole texts."""
    from xxhash import xxh64_intdigest

    out = np.zeros(len(texts), np.uint64)
    for k, text in enumerate(texts):
        parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: A-Z and ASCII white space alone
        if not parts:
            continue
        joined = b" ".join(parts)
        if len(parts) <= words:
            hashes = np.array([xxh64_intdigest(joined, seed)], np.uint64)
        else:
            ends = (np.cumsum([len(p) + 1 for p in parts]) - 1).tolist()
            starts = [0, *(e + 1 for e in ends[: -words])]
            hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts, ends[words - 1 :], strict=True)), np.uint64, len(parts) - words + 1)
        out[k] = print_of(hashes)
    return out


def covering_masks(radius: int, seed: int = 5) -> list[int]:
    """The 2^(radius+1)-1 masks, as signed 64-bit numbers. Codes are dealt evenly over the bit positions."""
    codes = np.random.default_rng(seed).permutation(np.arange(64) % (1 << (radius + 1)))
    out = []
    for v in range(1, 1 << (radius + 1)):
        bits = np.array([bin(int(c) & v).count("1") % 2 for c in codes], np.uint8)
        out.append(int(np.packbits(bits, bitorder="little").view("<i8")[0]))
    return out


def forest(values: np.ndarray, near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the graph in the boolean matrix ``near``: at most len(values)-1 links."""
    todo, out = np.ones(len(values), bool), []
    for k in range(len(values)):
        if not todo[k]:
            continue
        todo[k], queue = False, [k]
        while queue:
            at = queue.pop()
            new = np.flatnonzero(near[at] & todo)
            todo[new] = False
            queue += new.tolist()
            out += [(int(values[at]), int(values[x])) for x in new]
    return out


def links(prints: DataFrame, radius: int = 4, block: int = 2048) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp, distinct longs): a forest that spans every component."""
    masks = F.array(*[F.lit(m) for m in covering_masks(radius)])
    keyed = prints.select("fp", F.posexplode(masks).alias("t", "m")).select("t", F.col("fp").bitwiseAND(F.col("m")).alias("key"), "fp")
    crowd = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Spark takes a row for one key, not for all of its masks, and would send every key through the driver
    held = keyed.join(crowd.hint("merge"), ["t", "key"])
    # a bucket beyond ``block`` becomes a triangle of block pairs; each member goes to every pair its block is part of
    blocks = F.ceil(F.col("n") / block).cast("int")
    held = held.withColumn("k", blocks).withColumn("i", F.pmod(F.xxhash64("fp"), F.col("k")).cast("int"))
    small = held.where("k = 1").select("t", "key", F.lit(0).alias("lo"), F.lit(0).alias("hi"), "fp")
    large = held.where("k > 1").select("t", "key", "fp", "i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("j"))
    large = large.select("t", "key", F.least("i", "j").alias("lo"), F.greatest("i", "j").alias("hi"), "fp")
    tasks = small.unionByName(large).withColumn("cell", F.xxhash64("t", "key", "lo", "hi"))

    def forests(batches):
        def of(cells, fps):
            edges = []
            cut = np.flatnonzero(np.diff(cells)) + 1
            for group in np.split(fps, cut):
                if len(group) == 2:
                    if int(group[0] ^ group[1]).bit_count() <= radius:
                        edges.append((int(group[0].view(np.int64)), int(group[1].view(np.int64))))
                elif len(group) > 2:
                    group = np.unique(group)
                    near = np.empty((len(group), len(group)), bool)
                    for r in range(0, len(group), 256):
                        near[r : r + 256] = np.bitwise_count(group[r : r + 256, None] ^ group[None, :]) <= radius
                    edges += forest(group.view(np.int64), near)
            return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], ["a", "b"])

        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:  # sorted by cell: the last cell of a batch may go on in the next
            cells = np.concatenate([cells, np.asarray(batch.column("cell"))])
            fps = np.concatenate([fps, np.asarray(batch.column("fp")).view(np.uint64)])
            whole = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
            if whole:
                yield of(cells[:whole], fps[:whole])
                cells, fps = cells[whole:], fps[whole:]
        if len(cells):
            yield of(cells, fps)

    return tasks.select("cell", "fp").repartition("cell").sortWithinPartitions("cell", "fp").mapInArrow(frugal(forests), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 4, words: int = 4) -> DataFrame:
    """One row per document: doc_id, fp (signed long), fingerprint (16 hex digits), root (the group, as one of its fingerprints), component_id."""

    def digest(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 2000):
                part = batch.slice(a, 2000)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints_of(part.column("text").to_pylist(), words).view(np.int64))], ["doc_id", "fp"])

    found = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(frugal(digest), "doc_id long, fp long")
    found = materialise(found, "fingerprints")
    prints = materialise(found.groupBy("fp").agg(F.min("doc_id").alias("least")), "prints")
    roots = components(links(prints.select("fp"), radius))
    joined = materialise(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "root").select("fp", "root", "component_id")
    # rows are not broadcast either: those of many copies are far larger than their file
    return found.join(named.hint("merge"), "fp").select("doc_id", "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "root", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", groups=near_duplicates, prints=None, **how) -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id.

    ``groups`` finds them, with the parameters ``how``; ``prints`` gives the fp of texts in its results (none: fingerprints).

    Rows that repeat a kept id: the one whose row hash is least stays. A group in which no row has an id keeps one of its rows.
    """
    found = groups(docs, id_col, text_col, **how)
    prints = prints or (lambda texts: fingerprints_of(texts, how.get("words", 4)).view(np.int64))
    stay = found.where(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("__stay")).distinct()
    kept = docs.join(stay, docs[id_col] == stay["__stay"], "left_semi")
    again = docs.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__again")).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__again")
    if not again.isEmpty():
        on = kept[id_col] == again["__again"]
        first = Window.partitionBy(id_col).orderBy(F.xxhash64(*docs.columns))
        several = kept.join(again, on, "left_semi").withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
        kept = kept.join(again, on, "left_anti").unionByName(several)
    nameless = found.where("component_id is null").select(F.col("fp").alias("__fp"), F.col("root").alias("__root")).distinct()
    if not nameless.isEmpty():

        @F.pandas_udf("long")
        def print_of(texts: pd.Series) -> pd.Series:
            return pd.Series(prints(texts.tolist()))

        lone = docs.where(F.col(id_col).isNull()).withColumn("__fp", print_of(F.coalesce(F.col(text_col), F.lit(""))))
        kept = kept.unionByName(lone.join(nameless, "__fp").dropDuplicates(["__root"]).drop("__fp", "__root"))
    return kept
