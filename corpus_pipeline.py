"""A training corpus from raw documents: toxicity, near-duplicates, personal data, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each
stage's result to the shared folder, gives the next stage a reader of it, and deletes the scratch tables
that only this stage used.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.llm import jaccard, mixing, packing, pii, simhash, storage, toxicity


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the model is fitted on labelled rows that are not held out."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.reject(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each component of links at a Jaccard similarity of 0.8 or more of five-word runs: SimHash fingerprints under covering masks, then MinHash for what lies beyond their radius, each link verified."""
    return simhash.keep_one(docs, groups=jaccard.near_duplicates, prints=jaccard.nodes_of)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Base entities and discovered identifiers are replaced by their kind; n_chars follows the text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come near their target weights."""
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of 1024 tokens, one row per piece, with its ids."""
    out = packing.pack_documents(docs)
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "ids")


STAGES = [
    ("toxicity", without_toxic),
    ("simhash", without_near_duplicates),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

#: Near-duplicates, discovered identifiers and token ids can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = storage.count()
        docs = storage.written(stage(spark, docs, sf_dir), f"stage-{name}", before)
    return docs
