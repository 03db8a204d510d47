"""The queries of this subpackage, op1 to op10, and the SQL that checks them where SQL can."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import embed, licences, media, mixing, packing, pii, sharding, simhash, storage, token_output, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids bit-packed, read the files back, digest them by document."""
    path = storage.new_path(spark, "tokens")
    token_output.write_tokens(_table(spark, sf_dir, "documents"), path)
    return token_output.read_tokens(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32", "shard")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents to weights 1, 2, 3 by source; words taken by document."""
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store all documents as 8-bit samples in deduplicated chunks, read them back, describe them."""
    return media.media_features(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprints of all documents and the components of links at 4 or fewer bits."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.93 or more between vectors of one label, and their components."""
    return embed.near_vectors(_table(spark, sf_dir, "embeddings"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical digests of all documents and the known licence each one is."""
    return licences.scan(_table(spark, sf_dir, "documents"))


#: Licences that licences_planted() puts in the place of every seventh document.
PLANTED = ["MIT", "ISC", "0BSD", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "Unlicense", "BSL-1.0"]


def licences_planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh document replaced by a licence file as one is found: titled, with holders, wrapped anew, in British spelling or in capitals, with curly quotes. Each must be recognised, and no other document of a few words more."""
    docs = _table(spark, sf_dir, "documents")
    turn = (F.col("doc_id") / 7).cast("long")
    texts = F.array(*[F.lit(licences.KNOWN[n]) for n in PLANTED])
    plain = F.get(texts, (turn % len(PLANTED)).cast("int"))
    wrapped = F.regexp_replace(plain, F.lit("([^\\n]{40,70}) "), F.lit("$1\n * "))
    british = F.replace(F.regexp_replace(wrapped, F.lit(r"\blicense\b"), F.lit("licence")), F.lit('"'), F.lit("\u201c"))
    form = F.when(turn % 3 == 0, wrapped).when(turn % 3 == 1, british).otherwise(F.upper(plain))
    titles = F.create_map(*[F.lit(x) for pair in {0: "The MIT License (MIT)", 1: "ISC License", 3: "zlib License", 4: "BSD 2-Clause License", 5: "Revised BSD License", 6: "The Unlicense License"}.items() for x in pair])
    head = F.coalesce(F.concat(titles[(turn % len(PLANTED)).cast("int")], F.lit("\n\n")), F.lit(""))
    planted = F.concat(head, F.lit("Copyright (c) 2019-2024, Some One <a@example.org>\nCopyright Example Foundation\nAll rights reserved.\n\n"), form, F.lit("\n"))
    text = F.when(F.col("doc_id") % 7 == 0, planted).otherwise(F.concat("text", F.lit(" and more")))
    return licences.scan(docs.select("doc_id", text.alias("text"))).select("doc_id", "licence")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shard of every document, no shard above its byte limit."""
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 1024; digest the ids of each piece."""
    out = packing.pack_documents(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base entities and discovered identifiers of all documents."""
    found = pii.find(_table(spark, sf_dir, "documents"))
    number = [F.aggregate("base", F.lit(0).cast("long"), lambda n, s: n + (s["kind"] == k).cast("long")).alias(f"n_{k}") for k in pii.KINDS]  # noqa: B023
    return found.select("doc_id", *number, F.sha2(pii.spelled(F.col("base")), 256).alias("base_sha256"), pii.spelled(F.col("spans")).alias("spans"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labelled rows that are not held out."""
    docs = _table(spark, sf_dir, "documents")
    scored = toxicity.score(docs.select("doc_id", "text"), toxicity.fit(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))


OPERATORS = [op1_token_output, op2_mixing, op3_media, op4_simhash, op5_embeddings, op6_licences, op7_sharding, op8_packing, op9_pii, op10_toxicity]


def queries():
    """The ten operators' queries and the pipeline."""
    import corpus_pipeline

    return {f.__name__: f for f in OPERATORS} | {"licences_planted": licences_planted, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    hashed = "(('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint)"
    return {
        "op6_licences": f"""
            select doc_id, digest, canonical_chars, licence
            from (select doc_id, sha256(form) as digest, length(form)::bigint as canonical_chars from (select doc_id, {licences.canonical_sql('text')} as form from documents))
            left join (select distinct sha256({licences.canonical_sql('known')}) as digest, licence from (values {', '.join(f"({quote(v)}, '{k}')" for k, v in [*licences.KNOWN.items(), *licences.UNNUMBERED.items()])}) t(known, licence)
                union all values {', '.join(f"('{d}', '{n}')" for d, n in licences.FULL.items())}) using (digest)""",
        "licences_planted": f"""
            select doc_id, case when doc_id % 7 = 0 then (['{"', '".join(PLANTED)}'])[(doc_id // 7) % {len(PLANTED)} + 1] end as licence from documents""",
        "op7_sharding": f"""
            with rows_ as (select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as bytes, {hashed} as h from documents),
            levels as (select depth, h >> (32 - depth) as prefix, sum(bytes)::bigint as shard_bytes
                       from rows_, range(0, 33) d(depth) group by 1, 2 having sum(bytes) <= {8 << 20}),
            found as (select r.doc_id, r.bytes, l.depth, l.prefix, l.shard_bytes, row_number() over (partition by r.doc_id order by l.depth) as n
                      from rows_ r join levels l on l.prefix = r.h >> (32 - l.depth))
            select doc_id, bytes, depth::int as depth, prefix, (-1)::bigint as overflow,
                   case when depth = 0 then '' else lpad(bin(prefix), depth::int, '0') end as shard, shard_bytes
            from found where n = 1""",
    }
