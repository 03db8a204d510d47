"""Sharding by extendible hashing, in DataFrame operations alone.

A document's key is hashed to 32 bits. The directory begins as one bucket; a
bucket over the byte limit splits on its next hash bit, the others stay. So a
shard is the shortest prefix of the hash whose bytes fit. The rows are summed once, into
cells a few bits finer than even shards would need; the sums of all shorter
prefixes come from the cells. Only the rows of cells that are still too large are summed again, by whole hash.
The directory maps every cell to its shard, and each document finds its cell by an equi-join.

Rows that share one hash cannot be told apart by bits. Where they exceed the limit (at
depth 32) they are chained into overflow shards by running bytes, in lanes of about the limit
each, so that no task holds them all; which rows share a lane depends on the input's files.

Edge cases: a null or empty text is 0 bytes; null keys hash alike and shard like any
other; repeated rows go to the same bucket or its overflow chain; a document larger than the limit has a
shard of its own; an empty table gives no rows. Only the two named columns are read.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.llm.storage import materialise

DEPTH = 32


def _leaves(cells: DataFrame, low: int, deep: int, limit: int) -> DataFrame:
    """(cell, depth, prefix, shard_bytes): the shortest prefix of each cell, of ``low`` bits or more, that fits; no row for cells that don't fit themselves."""
    every = cells.select("cell", "bytes", F.explode(F.sequence(F.lit(low), F.lit(deep))).alias("depth"))
    # a shift by a column: division by a power of two, exact for 32-bit numbers
    every = every.withColumn("prefix", F.floor(F.col("cell") / F.pow(F.lit(2.0), deep - F.col("depth"))).cast("long"))
    fits = every.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes")).where(F.col("shard_bytes") <= limit)
    own = every.join(fits, ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "prefix", "shard_bytes")).alias("leaf"))
    return own.select("cell", "leaf.*")


def shard(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, bytes, depth and prefix (the shard's hash bits), overflow (-1: none), shard, shard_bytes.

    ``shard`` spells the prefix in binary, with the overflow number after a dash where there is one.
    """
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)).cast("long").alias("bytes"), hashed.alias("h"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "hashes")
    total = rows.agg(F.sum("bytes").alias("b")).first()["b"] or 0
    deep = min(DEPTH, (total // limit).bit_length() + 3)
    at = lambda bits: F.shiftright("h", DEPTH - bits)

    cells = materialise(rows.groupBy(at(deep).alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
    directory = materialise(_leaves(cells, 0, deep, limit), "directory")
    over = cells.where(F.col("bytes") > limit).select("cell")
    out = rows.withColumn("cell", at(deep)).join(directory, "cell").select("doc_id", "bytes", "h", "row", "depth", "prefix", F.lit(-1).cast("long").alias("overflow"), "shard_bytes")
    if not over.isEmpty():
        late = rows.withColumn("cell", at(deep)).join(over, "cell").drop("cell")
        fine = materialise(late.groupBy(F.col("h").alias("cell")).agg(F.sum("bytes").alias("bytes")), "cells")
        found = _leaves(fine, deep + 1, DEPTH, limit) if deep < DEPTH else fine.where("false").select("cell", F.lit(0).alias("depth"), F.col("cell").alias("prefix"), F.col("bytes").alias("shard_bytes"))
        found = materialise(found, "directory")
        out = out.unionByName(late.join(found, late["h"] == found["cell"]).select("doc_id", "bytes", "h", "row", "depth", "prefix", F.lit(-1).cast("long").alias("overflow"), "shard_bytes"))
        stuck = fine.where(F.col("bytes") > limit).select(F.col("cell").alias("h"), F.ceil(F.col("bytes") / limit).alias("lanes"))
        chain = late.join(stuck, "h").withColumn("lane", F.pmod(F.xxhash64("row"), F.col("lanes")))
        # two halves of the limit never exceed it: a document over half a limit is alone, others fill half a limit and their last one
        running = F.sum(F.when(F.col("bytes") * 2 <= limit, F.col("bytes")).otherwise(F.lit(0))).over(Window.partitionBy("h", "lane").orderBy("row"))
        small = F.floor((running - F.col("bytes")) / (limit / 2))
        chain = chain.withColumn("overflow", F.when(F.col("bytes") * 2 <= limit, F.col("lane") * (1 << 20) + small).otherwise(F.lit(1 << 52) + F.col("row")))
        summed = chain.groupBy("h", "overflow").agg(F.sum("bytes").alias("shard_bytes"))
        chain = chain.join(summed, ["h", "overflow"])
        out = out.unionByName(chain.select("doc_id", "bytes", "h", "row", F.lit(DEPTH).alias("depth"), F.col("h").alias("prefix"), "overflow", "shard_bytes"))
    bits = F.expr("lpad(conv(cast(prefix as string), 10, 2), depth, '0')")
    name = F.when(F.col("depth") == 0, F.lit("")).otherwise(bits)
    return out.select("doc_id", "bytes", "depth", "prefix", "overflow", F.when(F.col("overflow") < 0, name).otherwise(F.concat(name, F.lit("-"), "overflow")).alias("shard"), "shard_bytes")
