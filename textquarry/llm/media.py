"""Media columns as content-defined chunks.

A text's payload is stored as 8-bit mono samples in a WAV file. The file's bytes are cut
where a rolling gear hash has its top bits clear, so equal passages give equal
chunks wherever they stand. Chunks are named by their SHA-256; Spark joins find the
digests that occur more than once, whose bytes are stored once, as chunk rows. All other bytes stay
beside their ordered chunk list, so reading a file back moves only shared chunks.

Two passes over the texts: the first yields digests alone (a narrow table), the
second writes the store with what the joins decided. That decision is a list of shared chunk numbers
for the documents that have any; it is broadcast while its measured size allows and joined by shuffle beyond.

Reading joins shared chunks to the lists that name them, rebuilds each file, and fails
unless its SHA-256 is the recorded one.

Rows that are equal are stored once, with their number; other rows with a repeated doc_id or text are rows of their own,
with shared chunks. A digest that very many documents hold is dealt to several tasks on both ways.

Edge cases: null and empty texts are 64 zero bytes; an empty table gives an empty store; a very long text is one file, and
batches are worked on in slices of ``SLICE`` bytes. Only the two named columns are read.
"""

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm.memory import frugal
from textquarry.llm.storage import materialise, new_path
from textquarry.llm.tokens import runs, slices

HEADER = 44
RATE = 8000
#: Least and most bytes of a chunk, and how many top bits of the hash are clear at a cut.
LEAST, MOST, BITS = 512, 16384, 12
GEAR = np.random.default_rng(2024).integers(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
STORE = "key long, doc_id long, times long, n_bytes long, media_sha256 binary, digests array<binary>, lengths array<int>, shared array<int>, holders array<long>, data binary"
#: Bytes of texts or files that are worked on at once, lanes of the first join on digests, and how many holders of a chunk fetch it in one task.
SLICE, LANES, HOLDERS = 8 << 20, 8, 4096


def wave(payload: bytes) -> bytes:
    """The payload as 8-bit unsigned mono samples in a WAV file."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The payload of a WAV file that wave() made; fails on any other header."""
    riff, size, kind, fmt, n, code, channels, rate, _, _, bits, data, length = struct.unpack_from("<4sI4s4sIHHIIHH4sI", media)
    if (riff, kind, fmt, n, code, channels, rate, bits, data) != (b"RIFF", b"WAVE", b"fmt ", 16, 1, 1, RATE, 8, b"data") or size != 36 + length or len(media) != HEADER + length:
        raise ValueError("not a file of 8-bit mono samples")
    return media[HEADER:]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(unpadded bytes, payload): UTF-8 and zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


def cuts(data: bytes) -> list[int]:
    """Chunk ends. The hash of a position covers the 32 bytes up to it, found for all positions at once by doubling."""
    if len(data) <= LEAST:
        return [len(data)]
    h = GEAR[np.frombuffer(data, np.uint8)]
    for step in (1, 2, 4, 8, 16):
        h[step:] += h[:-step] << np.uint32(step)  # the right side is evaluated before it is added
    places = np.flatnonzero(h < (1 << (32 - BITS))) + 1
    out, at, k = [], 0, 0
    while len(data) - at > LEAST:
        k = int(np.searchsorted(places, at + LEAST, side="left"))
        end = min(int(places[k]) if k < len(places) else len(data), at + MOST, len(data))
        out.append(end)
        at = end
    if at < len(data):
        out.append(len(data))
    return out


def chunks(media: bytes) -> list[bytes]:
    ends = cuts(media)
    return [media[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def write_media(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 200_000) -> None:
    """Store every whole text under ``path``: kind=media rows with ordered chunk lists, kind=chunk rows with shared bytes.

    ``broadcast_rows``: the most documents with shared chunks for which their list (some tens of bytes each) is broadcast.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))

    def digest(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                part = batch.slice(a, b - a)
                lists = [[hashlib.sha256(c).digest() for c in chunks(wave(payload_of(text)[1]))] for text in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("key"), pa.array(lists, pa.list_(pa.binary()))], ["key", "digests"])

    read = rows.select("key", "text").mapInArrow(frugal(digest), "key long, digests array<binary>")
    # equal rows have one key: they count once
    read = materialise(read.groupBy("key").agg(F.any_value("digests").alias("digests"), F.count(F.lit(1)).alias("times")), "digests")
    named = read.select("key", F.posexplode("digests").alias("number", "digest"))
    # the first copy of a digest (least key and number) keeps its bytes as a chunk row
    owner = named.groupBy("digest").agg(F.min(F.struct("key", "number")).alias("owner"), F.count(F.lit(1)).alias("n")).where("n > 1")
    owner = materialise(owner, "owners").withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(LANES - 1))))
    roles = named.withColumn("lane", F.pmod(F.xxhash64("key", "number"), F.lit(LANES)).cast("int")).join(owner, ["digest", "lane"])
    roles = roles.select("key", F.struct("number", "n", ((F.col("key") == F.col("owner.key")) & (F.col("number") == F.col("owner.number"))).alias("first")).alias("role"))
    roles = roles.groupBy("key").agg(F.sort_array(F.collect_list("role")).alias("roles"))
    roles = materialise(roles.join(read.where("times > 1").select("key", "times"), "key", "full").withColumnRenamed("key", "key_"), "roles")
    if roles.count() <= broadcast_rows:
        roles = F.broadcast(roles)
    none = F.expr("cast(array() as array<struct<number: int, n: bigint, first: boolean>>)")
    given = rows.join(roles, rows["key"] == roles["key_"], "left").select("key", "doc_id", "text", F.coalesce("roles", none).alias("roles"), F.coalesce("times", F.lit(1)).alias("times"))
    again = given.where("times > 1").groupBy("key", "times").agg(F.any_value("doc_id").alias("doc_id"), F.any_value("text").alias("text"), F.any_value("roles").alias("roles"))
    given = given.where("times = 1").unionByName(again)
    schema = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("doc_id", pa.int64()), ("times", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.binary()), ("digests", pa.list_(pa.binary())), ("lengths", pa.list_(pa.int32())), ("shared", pa.list_(pa.int32())), ("holders", pa.list_(pa.int64())), ("data", pa.binary())])

    def store(batches):
        for batch in batches:
            for a, b in slices(batch.column("text"), SLICE):
                out = []
                for r in batch.slice(a, b - a).to_pylist():
                    n, payload = payload_of(r["text"])
                    media = wave(payload)
                    parts, roles = chunks(media), r["roles"]
                    shared = {x["number"] for x in roles}
                    digests = [hashlib.sha256(c).digest() for c in parts]
                    own = b"".join(c for k, c in enumerate(parts) if k not in shared)
                    out.append({"kind": "media", "key": r["key"], "doc_id": r["doc_id"], "times": r["times"], "n_bytes": n, "media_sha256": hashlib.sha256(media).digest(), "digests": digests, "lengths": [len(c) for c in parts], "shared": [x["number"] for x in roles], "holders": [x["n"] for x in roles], "data": own})
                    out += [{"kind": "chunk", "key": r["key"], "digests": [digests[x["number"]]], "holders": [x["n"]], "data": parts[x["number"]]} for x in roles if x["first"]]
                yield pa.RecordBatch.from_pylist(out, schema)

    given.mapInArrow(frugal(store), "kind string, " + STORE).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def read_media(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored file, rebuilt and verified: doc_id, n_bytes, media_sha256, media."""
    stored = spark.read.schema(STORE + ", kind string").parquet(path)
    media = stored.where("kind = 'media'").drop("kind")
    alone = media.where("size(shared) = 0").withColumn("fetched", F.lit(None).cast("array<struct<number: int, data: binary>>"))
    mixed = media.where("size(shared) > 0")
    # (key, number) names a chunk's place; a chunk of many holders is fetched in as many lanes as they need
    lanes = F.ceil(F.col("holders") / HOLDERS)
    wanted = mixed.select("key", "digests", F.explode(F.arrays_zip("shared", "holders")).alias("x")).select("key", F.col("x.shared").alias("number"), F.element_at("digests", F.col("x.shared") + 1).alias("digest"), F.col("x.holders").alias("holders"))
    wanted = wanted.withColumn("lane", F.pmod(F.xxhash64("key", "number"), lanes)).drop("holders")
    kept = stored.where("kind = 'chunk'").select(F.element_at("digests", 1).alias("digest"), F.col("data").alias("bytes"), F.element_at("holders", 1).alias("holders"))
    kept = kept.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), lanes - 1))).drop("holders")
    got = wanted.join(kept, ["digest", "lane"]).groupBy("key").agg(F.collect_list(F.struct("number", F.col("bytes").alias("data"))).alias("fetched"))
    whole = alone.unionByName(mixed.join(got, "key"))

    def rebuild(batches):
        for batch in batches:
            sizes = pc.add(batch.column("n_bytes"), 256)
            for a, b in runs(np.asarray(sizes), SLICE):
                out = []
                for r in batch.slice(a, b - a).to_pylist():
                    found, at, parts = {f["number"]: f["data"] for f in r["fetched"] or ()}, 0, []
                    for k, n in enumerate(r["lengths"]):
                        if k in found:
                            parts.append(found[k])
                        else:
                            parts.append(r["data"][at : at + n])
                            at += n
                    file = b"".join(parts)
                    if hashlib.sha256(file).digest() != r["media_sha256"]:
                        raise ValueError(f"document {r['doc_id']}: the rebuilt file differs from the stored one")
                    row = {"doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "media_sha256": r["media_sha256"], "media": file}
                    for _ in range(r["times"]):  # equal rows, a slice's bytes at a time
                        out.append(row)
                        if len(out) * len(file) > SLICE:
                            yield pa.RecordBatch.from_pylist(out, FILES)
                            out = []
                yield pa.RecordBatch.from_pylist(out, FILES)

    return whole.select("doc_id", "times", "n_bytes", "media_sha256", "lengths", "data", "fetched").mapInArrow(frugal(rebuild), "doc_id long, n_bytes long, media_sha256 binary, media binary")


FILES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_sha256", pa.binary()), ("media", pa.binary())])


def features(media: DataFrame) -> DataFrame:
    """Digests and features of each file's samples: length, mean, power and sign changes around the middle level."""
    names = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]

    def describe(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                data = samples(r["media"])
                x = np.frombuffer(data, np.uint8).astype(np.int64) - 128
                feature = f"samples={len(x)};sum={int(x.sum())};power={int((x * x).sum())};turns={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"
                out.append((r["doc_id"], r["n_bytes"], len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]), len(r["media"]), r["media_sha256"].hex(), feature))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, (_, t) in enumerate(names)], [n for n, _ in names])

    return media.mapInArrow(frugal(describe), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def media_features(docs: DataFrame) -> DataFrame:
    """Store all documents' payloads, read them back, describe them."""
    path = new_path(docs.sparkSession, "media")
    write_media(docs, path)
    return features(read_media(docs.sparkSession, path))
