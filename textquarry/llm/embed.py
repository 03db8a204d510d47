"""Embedding near-duplicates by collision-counting projections.

Every vector is projected on many random directions, one dimension each, and the projections of a label are sorted.
Two vectors collide on a projection when one lies in the window centred on the other, ``reach`` deviations of a pair
at the threshold wide on both sides. Windows are laid in both ends of a sorted projection alone: in its crowded middle a collision says little
and every window holds a fixed share of all vectors. An end's share is set by the label's size, so that it holds
about ``window_rows`` vectors however many there are, and the number of projections follows from it. The share has a floor, ``least_share``, so
that a vector's work is bounded too: in labels beyond some hundred thousand rows ends grow, and are compared in blocks.

Collisions are counted per pair over all projections; a pair that reaches ``count`` is verified by its cosine in double
precision, and no other pair is. Projections are as many as make a pair exactly at the threshold reach that count with
probability ``recall`` (collisions are taken as independent; measured in tests).

A pair is counted once: in the first end in which it collides. An end emits how many links each of its vectors has
there and a spanning forest of them, never its pairs, and how many pairs it counted and verified.
Windows beyond ``block`` rows (copies that project alike) are split into block pairs,
so a task's memory does not depend on a label's or a group's size.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and
rows whose label is null, link with nothing and form their own component; vectors of unequal
length do not link; rows that repeat a vec_id are rows of their own for n_links, and share a
component; a null vec_id keeps its links and never names a component of others. An empty table gives no rows.
"""

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.llm.graph import components
from textquarry.llm.memory import frugal
from textquarry.llm.simhash import forest
from textquarry.llm.storage import materialise


#: Projections that are held at once.
CHUNK = 256


@lru_cache(maxsize=256)
def calibrate(rows: int, cosine: float, window_rows: int, count: int, recall: float, reach: float, least_share: float = 2**-12) -> tuple[float, int]:
    """(tail bound, projections) for a label of ``rows`` vectors.

    The chance that two unit vectors at ``cosine`` collide on one projection is twice the
    probability that both of two normals with that correlation exceed the bound.
    """
    share = min(0.25, max(window_rows / max(rows, 1), least_share))
    bound = NormalDist().inv_cdf(1 - share)
    x = np.linspace(bound, bound + 9, 4001)
    upper = np.array([0.5 * math.erfc((bound - cosine * v) / math.sqrt(2 * (1 - cosine * cosine))) for v in x])
    both = 2 * float(np.trapezoid(np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * upper, x)) * (2 * NormalDist().cdf(reach) - 1)
    m = count
    while sum(math.comb(m, k) * both**k * (1 - both) ** (m - k) for k in range(count)) > 1 - recall:
        m += max(1, m // 16)
    return bound, m


@lru_cache(maxsize=8)
def directions(dims: int, many: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((many, dims)).T


def _links(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = 0.93, window_rows: int = 96, count: int = 2, recall: float = 0.99, reach: float = 3.0, block: int = 1024, least_share: float = 2**-12, seed: int = 11
) -> tuple[DataFrame, DataFrame]:
    """(rows, links): (a, null, links) counts the links of a row in one end, (a, b) is a link of a spanning forest, (null, null, counted, verified) says what an end compared."""
    kind = vectors.schema[vector_col].dataType.simpleString()
    kind, number = ("array<float>", np.dtype("<f4")) if kind == "array<float>" else ("array<double>", np.dtype("<f8"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(kind).alias("v"), F.col(label_col).alias("label"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    fit = "v is not null and size(v) > 0 and label is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(v, x -> x <> 0)"
    able = rows.where(fit).withColumn("group", F.xxhash64(F.col("label"), F.size("v")))
    sized = able.groupBy("group").agg(F.count(F.lit(1)).alias("n"))
    spread = 1.0 if cosine >= 1 else math.sqrt(2 * (1 - cosine))

    def windows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                n, group, row = (np.asarray(part.column(c)) for c in ("n", "group", "row"))
                v = part.column("v")
                wide = np.diff(np.asarray(v.offsets))
                flat, ends = np.asarray(v.flatten()), np.concatenate([[0], np.cumsum(wide)])
                found = []
                for d in np.unique(wide):
                    for size in np.unique(n[wide == d]):
                        pick = np.flatnonzero((wide == d) & (n == size))
                        unit = flat[ends[pick][:, None] + np.arange(d)].astype(np.float64)
                        unit = unit / np.abs(unit).max(1, keepdims=True)
                        unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                        bound, many = calibrate(int(size), cosine, window_rows, count, recall, reach, least_share)
                        towards = directions(int(d), many, seed)
                        for first in range(0, many, CHUNK):
                            p = unit @ towards[:, first : first + CHUNK]
                            for side, (i, j) in enumerate((np.nonzero(p > bound), np.nonzero(p < -bound))):
                                found.append((pick[i], 2 * (j + first) + side))
                who = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
                end = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
                raw = [flat[a:b].astype(number).tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(group[who]), pa.array(end.astype(np.int32)), pa.array(row[who]), pa.array(n[who]), pa.array(raw, pa.binary()).take(pa.array(who))], ["group", "end", "row", "n", "v"])

    ends = able.join(sized, "group").select("group", "row", "n", "v").mapInArrow(frugal(windows), "group long, end int, row long, n long, v binary")
    ends = materialise(ends, "windows")
    crowd = ends.groupBy("group", "end").agg(F.count(F.lit(1)).alias("held")).where("held > 1")
    held = ends.join(crowd, ["group", "end"]).withColumn("k", F.ceil(F.col("held") / block).cast("int")).withColumn("i", F.pmod(F.xxhash64("row"), F.col("k")).cast("int"))
    held = held.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    held = held.select("end", "row", "n", "v", "i", F.xxhash64("group", "end", F.least("i", "j"), F.greatest("i", "j")).alias("cell"), (F.col("i") == F.col("j")).alias("own"))

    def verify(batches):
        def of(cell):
            size, end = int(cell["n"][0]), int(cell["end"][0])
            unit = np.frombuffer(b"".join(cell["v"]), number).astype(np.float64).reshape(len(cell["v"]), -1)
            unit /= np.abs(unit).max(1, keepdims=True)
            unit /= np.linalg.norm(unit, axis=1, keepdims=True)
            bound, many = calibrate(size, cosine, window_rows, count, recall, reach, least_share)
            towards = directions(unit.shape[1], many, seed)
            own_p = unit @ towards[:, end // 2]
            order = np.argsort(own_p, kind="stable")  # this projection, sorted
            unit, own_p, row, i, own = unit[order], own_p[order], cell["row"][order], cell["i"][order], cell["own"][order]
            n = len(row)
            # the window of each query: what follows it in the sorted projection, up to its reach (what precedes has it in its own window)
            first, last = np.arange(n) + 1, np.searchsorted(own_p, own_p + reach * spread, side="right")
            p = unit @ towards
            side = (p > bound).astype(np.int8) - (p < -bound)
            p = p.astype(np.float32)
            ends = np.concatenate([side > 0, side < 0], axis=1).astype(np.float32)
            shared = ends @ ends.T  # ends that two vectors share: no pair collides more often
            near, counted, verified = np.zeros((n, n), bool), 0, 0
            for q in range(0, n, 256):
                inside = (np.arange(n)[None, :] >= first[q : q + 256, None]) & (np.arange(n)[None, :] < last[q : q + 256, None]) & (shared[q : q + 256] >= count)
                if not own.all():  # two blocks: only pairs across them
                    inside &= i[q : q + 256, None] != i[None, :]
                u, w = np.nonzero(inside)
                u += q
                counted += len(u)
                for s in range(0, len(u), 4096):
                    x, y = u[s : s + 4096], w[s : s + 4096]
                    hit = (side[x] != 0) & (side[x] == side[y]) & (np.abs(p[x] - p[y]) <= reach * spread + 1e-5)
                    at = hit.argmax(1)
                    good = (hit.sum(1) >= count) & (2 * at + (side[x, at] < 0) == end)
                    x, y = x[good], y[good]
                    verified += len(x)
                    good = np.einsum("ij,ij->i", unit[x], unit[y]) >= cosine
                    near[x[good], y[good]] = near[y[good], x[good]] = True
            degree = near.sum(1)
            some = np.flatnonzero(degree)
            edges = forest(row, near)
            return [(None, None, counted, verified), *zip(row[some].tolist(), [None] * len(some), degree[some].tolist(), [0] * len(some), strict=True), *((a, b, 0, 0) for a, b in edges)]

        def out(found):
            return pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(4)], ["a", "b", "links", "verified"])

        names, kept, cells = ("n", "end", "row", "i", "own"), [], None
        for batch in batches:  # sorted by cell: the last cell of a batch may go on in the next
            kept.append({c: batch.column(c).to_numpy(zero_copy_only=False) for c in names} | {"v": batch.column("v").to_pylist(), "cell": batch.column("cell").to_numpy()})
            cells = kept[-1]["cell"]
            if len(cells) == 0 or (cells[0] == cells[-1] and (len(kept) == 1 or kept[-2]["cell"][-1] == cells[0])):
                continue  # all of it may belong to one cell that is not complete
            stop = int(np.searchsorted(cells, cells[-1]))
            rest = {c: x[stop:] for c, x in kept[-1].items()}
            kept[-1] = {c: x[:stop] for c, x in kept[-1].items()}
            yield out(each(kept, names, of))
            kept = [rest]
        if kept:
            yield out(each(kept, names, of))

    def each(parts, names, of):
        whole = {c: np.concatenate([p[c] for p in parts]) for c in (*names, "cell")}
        v = [x for p in parts for x in p["v"]]
        cut = [0, *(np.flatnonzero(np.diff(whole["cell"])) + 1).tolist(), len(v)]
        found = []
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            if b - a > 1:
                found += of({c: whole[c][a:b] for c in names} | {"v": v[a:b]})
        return found

    links = held.repartition("cell").sortWithinPartitions("cell").select("cell", "n", "end", "row", "i", "own", "v").mapInArrow(frugal(verify), "a long, b long, links long, verified long")
    return rows, materialise(links, "links")


def pair_counts(vectors: DataFrame, **how) -> dict[str, int]:
    """How many pairs were counted (they share ends and a window often enough to be) and how many reached the count and were verified."""
    _, links = _links(vectors, **how)
    return links.where("a is null").agg(F.coalesce(F.sum("links"), F.lit(0)).alias("counted"), F.coalesce(F.sum("verified"), F.lit(0)).alias("verified")).first().asDict()


def near_vectors(vectors: DataFrame, **how) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept. ``how``: the parameters of _links()."""
    rows, links = _links(vectors, **how)
    number = links.where("a is not null and b is null").groupBy(F.col("a").alias("row")).agg(F.sum("links").alias("n_links"))
    # rows that repeat a vec_id share a component
    twice = rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("row").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    same = rows.join(twice, "vec_id").where("row <> b").select(F.col("row").alias("a"), "b")
    roots = components(links.where("b is not null").select("a", "b").unionByName(same)).withColumnRenamed("node", "row")
    found = rows.select("row", "vec_id").join(roots, "row", "left").withColumn("root", F.coalesce("root", "row")).join(number, "row", "left")
    found = materialise(found, "rooted")
    least = found.groupBy("root").agg(F.min("vec_id").alias("component_id"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    found = found.join(least, "root", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    return found.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
