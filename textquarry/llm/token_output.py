"""Token ids in a fixed-width bit-packed file format.

The format is a folder of Parquet files of blocks. A block holds whole documents
in ascending ``doc_id`` order: their ids and lengths in tokens, and all their token
ids packed into the fewest bits that hold the vocabulary (16 for 49,408 ids), least
significant bit first. ``start`` is the block's place in its shard, so any document is
found by the blocks' minimum and maximum ids (Parquet statistics) and unpacked by
numpy without reading what stands before it. Shards are ranges of ``doc_id``.

Edge cases: a null text is empty and still gets its end id; null doc_ids come first;
rows that repeat a doc_id stay separate rows, ordered by a hash of their text; an
empty table gives an empty folder of files that reads back as no rows. Only the two named columns
are read, so other columns may have any name.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textquarry.llm.memory import frugal
from textquarry.llm.tokens import encoder, slices

BLOCKS = "shard int, block int, start long, n_ids long, bits int, first_doc_id long, last_doc_id long, doc_ids array<long>, lengths array<long>, payload binary"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids in ``bits`` bits each, least significant bit first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    out = []
    for at in range(0, len(ids), 1 << 16):  # a multiple of 8 ids, so that each part ends on a byte
        part = ids[at : at + (1 << 16)].astype(np.uint32)
        out.append(np.packbits((part[:, None] >> np.arange(bits, dtype=np.uint32) & 1).astype(np.uint8), bitorder="little").tobytes())
    return b"".join(out)


def unpack(payload: bytes, bits: int, count: int, first: int = 0) -> np.ndarray:
    """``count`` ids from the one numbered ``first``."""
    if bits in (8, 16, 32):
        return np.frombuffer(payload, f"<u{bits // 8}", count, first * bits // 8).astype(np.uint32)
    out, data = [], np.frombuffer(payload, np.uint8)
    for at in range(first, first + count, 1 << 16):
        n = min(1 << 16, first + count - at)
        low = at * bits
        part = np.unpackbits(data[low // 8 : (low + n * bits + 7) // 8], bitorder="little")[low % 8 : low % 8 + n * bits]
        out.append(part.reshape(n, bits).astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32)))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def write_tokens(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", keeps_spaces: bool = False, end_id: int = 1, docs_per_shard: int = 1 << 16, block_ids: int = 1 << 16
) -> None:
    """Encode every whole text, append ``end_id`` and write the blocks under ``path``.

    ``docs_per_shard`` sets the number of range shards (two for each core at least); a block closes at the first document that brings it to ``block_ids`` ids.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shards = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // docs_per_shard))
    rows = rows.repartitionByRange(shards, F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("bits", pa.int32()), ("first_doc_id", pa.int64()), ("last_doc_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("payload", pa.binary())])

    def blocks(batches):
        with encoder(tokenizer, keeps_spaces) as enc:
            yield from blocks_of(batches, enc)

    def blocks_of(batches, enc):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        bits = max(1, (max(enc.tok.get_vocab_size(), end_id + 1) - 1).bit_length())
        block = start = 0
        held: list[tuple[int | None, np.ndarray]] = []

        def close():
            nonlocal block, start, held
            ids = np.concatenate([x for _, x in held])
            known = [d for d, _ in held if d is not None]
            out = pa.RecordBatch.from_pylist(
                [{"shard": shard, "block": block, "start": start, "n_ids": len(ids), "bits": bits, "first_doc_id": known[0] if known else None, "last_doc_id": known[-1] if known else None, "doc_ids": [d for d, _ in held], "lengths": [len(x) for _, x in held], "payload": pack(ids, bits)}], schema
            )
            block, start, held = block + 1, start + len(ids), []
            return out

        n = 0
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                ids, at = enc.encode(part.column("text"))
                for d, x, y in zip(part.column("doc_id").to_pylist(), at[:-1], at[1:], strict=True):
                    held.append((d, np.append(ids[x:y], np.uint32(end_id))))
                    n += y - x + 1
                    if n >= block_ids:
                        yield close()
                        n = 0
        if held:
            yield close()

    rows.mapInArrow(blocks, BLOCKS).write.mode("errorifexists").option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document, read from the files: doc_id, shard, start (over all shards), n_tokens, ids_crc32, and ``ids`` if asked for."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    names = [("doc_id", pa.int64()), ("shard", pa.int32()), ("within", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    if with_ids:
        names.append(("ids", pa.list_(pa.int64())))

    def documents(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                r = {k: batch.column(k)[row].as_py() for k in ("shard", "start", "n_ids", "bits", "doc_ids", "lengths", "payload")}
                ids = unpack(r["payload"], r["bits"], r["n_ids"])
                raw = ids.astype("<u4").tobytes()
                ends = np.cumsum(r["lengths"])
                cut = [(int(e - n), int(e)) for n, e in zip(r["lengths"], ends, strict=True)]
                cols = [r["doc_ids"], [r["shard"]] * len(cut), [r["start"] + a for a, _ in cut], r["lengths"], [zlib.crc32(raw[4 * a : 4 * b]) for a, b in cut]]
                if with_ids:
                    cols.append([ids[a:b].tolist() for a, b in cut])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, names, strict=True)], [n for n, _ in names])

    read = blocks.select("shard", "start", "n_ids", "bits", "doc_ids", "lengths", "payload").mapInArrow(frugal(documents), "doc_id long, shard int, within long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
    # one row for each shard: the running total over shards is small whatever the number of documents
    totals = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = totals.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    return read.join(before, "shard").select("doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32", "shard", *["ids"] * with_ids)


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Random access: only blocks whose id range holds one of ``doc_ids`` are read; doc_id and its token ids."""
    blocks = spark.read.schema(BLOCKS).parquet(path)
    near = F.lit(False)
    for d in doc_ids:
        near = near | ((F.col("first_doc_id") <= d) & (F.col("last_doc_id") >= d))
    wanted, names = set(doc_ids), [("doc_id", pa.int64()), ("ids", pa.list_(pa.int64()))]

    def documents(batches):
        for batch in batches:
            for r in batch.to_pylist():
                at, found = 0, []
                for d, n in zip(r["doc_ids"], r["lengths"], strict=True):
                    if d in wanted:
                        found.append((d, unpack(r["payload"], r["bits"], n, at).tolist()))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, (_, t) in enumerate(names)], [n for n, _ in names])

    return blocks.where(near).select("bits", "doc_ids", "lengths", "payload").mapInArrow(frugal(documents), "doc_id long, ids array<long>")
