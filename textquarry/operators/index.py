"""The search index: word and key postings as tables, and the candidates they give."""

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.files import language
from textquarry.functions.text import ascii_lower, gram_code, split_tokens, words
from textquarry.plans import regex_plan as rp
from textquarry.sources.scratch import written


def word_postings(files: DataFrame) -> DataFrame:
    """(word, file_id), distinct."""
    return files.select(F.explode(words(F.coalesce("text", F.lit("")))).alias("word"), "file_id")


def gram_postings(files: DataFrame) -> DataFrame:
    """(gram, file_id), distinct: gram_code() of every three characters of a line, A-Z folded.

    A number for each place of a text and one sort of them: in Arrow batches this is far cheaper than as many short strings.
    """

    def run(batches):
        for batch in batches:
            keys, ids = [], []
            for file_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or len(text) < 3:
                    continue
                c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
                c += 32 * ((c >= 65) & (c <= 90))
                line_end = c == 10
                whole = ~(line_end[:-2] | line_end[1:-1] | line_end[2:])
                found = np.unique((c[:-2] << 42 | c[1:-1] << 21 | c[2:])[whole])
                keys.append(found)
                ids.append(np.full(len(found), file_id, np.int64))
                if len(keys) >= 500:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["gram", "file_id"])
                    keys, ids = [], []
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(ids))], ["gram", "file_id"])

    return files.select(F.col("file_id").cast("long").alias("file_id"), F.col("text")).mapInArrow(run, "gram long, file_id long")


def bitmaps(postings: DataFrame, key: str) -> DataFrame:
    """Postings as bitmaps: (key, bucket, files), one bit for each file of a bucket.

    Postings are dealt before they are aggregated: a bitmap has 4 KB from its first bit on, so partial ones would be shuffled and sorted by the thousand times of what they say.
    """
    dealt = postings.select(key, "file_id", F.bitmap_bucket_number("file_id").alias("bucket")).repartition(key, "bucket")
    return dealt.groupBy(key, "bucket").agg(F.bitmap_construct_agg(F.bitmap_bit_position("file_id")).alias("files"))


#: Files whose postings of one key lie in one sorted run; a commoner key is dealt to more runs.
RUN_FILES = 1_000_000
#: What an index holds: table -> the columns it is sorted by, and (but for files) the column that names the file of a row.
TABLES = {"files": ("path", "file_id"), "words": ("word", "file_id"), "grams": ("gram", "file_id"), "pieces": ("piece", "file_id"), "symbols": ("name", "file_id"), "spans": ("file_id", "file_id"), "imports": ("file_id", "file_id"), "edges": ("src", "src")}
#: Raised when extraction changes, so that an older index is rebuilt.
DERIVATION = 2


#: Bytes of text whose rows one task of a dealt table gets. A number of tasks by shuffled bytes would follow how well rows compress, and the memory of a task with it.
TASK_BYTES = 16 << 20


def write_postings(postings: DataFrame, key: str, path: str, files: int, tasks: int = 1) -> None:
    """Postings dealt by key and sorted: a lookup reads one row group of a file. Keys of very many files are dealt to a run for each million of them.

    (Ranges would extract everything twice, for their sample.)
    """
    runs = max(1, -(-files // RUN_FILES))
    dealt = postings.repartition(tasks, key) if runs == 1 else postings.repartition(tasks, F.col(key), F.pmod(F.xxhash64("file_id"), F.lit(runs)))
    dealt.sortWithinPartitions(key, "file_id").write.mode("overwrite").parquet(path)


def write_tables(files: DataFrame, where: str, live: DataFrame | None = None) -> dict:
    """Write what ``files`` (file_id, path, text, lang) hold under ``where``: the search tables first, then what extraction gives. Returns their number and bytes.

    ``live``: all files among which imports resolve, if there are others than ``files``.
    """
    from textquarry.operators.find import piece_postings
    from textquarry.operators.symbols import edges, extract, part, resolve

    spark = files.sparkSession
    own = files if "lang" in files.columns else files.withColumn("lang", language(F.col("path")))
    own = own.withColumn("size", F.octet_length("text").cast("long")).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    own.write.mode("overwrite").parquet(f"{where}/files")
    own = spark.read.schema(own.schema).parquet(f"{where}/files")
    number = own.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first().asDict()
    tasks = max(1, -(-number["bytes"] // TASK_BYTES))
    words = word_postings(own)
    write_postings(words, "word", f"{where}/words", number["files"], tasks)
    write_postings(gram_postings(own), "gram", f"{where}/grams", number["files"], tasks)
    kept = {t: spark.read.schema(df.schema).parquet(f"{where}/{t}") for t, df in (("words", words), ("grams", gram_postings(own)))}
    kept["grams"].groupBy("gram").agg(F.count(F.lit(1)).alias("n")).sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{where}/gram_files")
    write_postings(piece_postings(kept["words"]), "piece", f"{where}/pieces", number["files"], tasks)
    facts = extract(own)
    facts.write.mode("overwrite").partitionBy("part").parquet(f"{where}/facts")
    facts = spark.read.schema(facts.schema).parquet(f"{where}/facts")
    for name in ("symbols", "spans", "imports"):
        key = TABLES[name][0]
        found = part(facts, name)
        found.repartition(tasks, F.col(key)).sortWithinPartitions(key, "file_id").write.mode("overwrite").parquet(f"{where}/{name}")
    imports = spark.read.parquet(f"{where}/imports")
    edges(resolve(imports, (own if live is None else live).select("file_id", "path", "lang"))).repartition("src").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{where}/edges")
    return number


def add_manifest(spark: SparkSession, path: str, version: int, manifest: dict) -> None:
    """Make a version known; nothing reads its folders before."""
    spark.createDataFrame([(version, json.dumps(manifest | {"version": version}))], "version long, manifest string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")


def manifest_of(spark: SparkSession, path: str, version: int | None = None) -> dict:
    """The manifest of a version, the last published one by default; a version published again counts as it was last written."""
    rows = spark.read.schema("version long, manifest string").parquet(f"{path}/manifest")
    if version is not None:
        rows = rows.where(F.col("version") == version)
    return json.loads(rows.orderBy(F.desc("version"), F.desc("manifest")).first()["manifest"])


def publish(files: DataFrame, path: str, version: int, inputs: dict | None = None, ranked: bool = True) -> dict:
    """Write a whole version: search tables, then symbols, spans, imports, edges and ranks, then the manifest that names its folder.

    ``inputs``: fingerprints of what the tree was read with ({"ignore": ..., "resolver": ...}); a later change of one asks for a rebuild.
    """
    from textquarry.operators.symbols import pagerank

    spark, base = files.sparkSession, f"base-{version}"
    number = write_tables(files, f"{path}/{base}")
    nodes, graph = spark.read.parquet(f"{path}/{base}/files").select("file_id"), spark.read.parquet(f"{path}/{base}/edges")
    if ranked and not graph.isEmpty():
        pagerank(nodes, graph).write.mode("overwrite").parquet(f"{path}/{base}/ranks")
    else:
        nodes.select("file_id", F.lit(0.5).alias("rank")).write.mode("overwrite").parquet(f"{path}/{base}/ranks")
    manifest = number | {"base": base, "deltas": [], "changes": 0, "tombstones": 0, "base_files": number["files"], "derivation": DERIVATION, "inputs": inputs or {}}
    add_manifest(spark, path, version, manifest)
    return manifest


def open_index(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame]:
    """The tables of a version: its base, less what deltas replaced or deleted, and the deltas' own rows.

    A row of a generation is dead if a later one has a tombstone for its file. Tombstones are as few as changes, and a rebuild bounds them.
    """
    manifest = manifest_of(spark, path, version)
    folders = [manifest["base"], *manifest["deltas"]]
    read = lambda g, t: spark.read.parquet(f"{path}/{folders[g]}/{t}")
    out = {}
    dead = {}
    for kind in ("tombstones", "edge_tombstones") if manifest["deltas"] else ():
        rows = [read(g, kind).select(F.col("file_id").alias("dead"), F.lit(g).alias("since")) for g in range(1, len(folders))]
        dead[kind] = reduce(DataFrame.unionByName, rows).groupBy("dead").agg(F.max("since").alias("since"))
    for t, (_, owner) in TABLES.items():
        if not manifest["deltas"]:
            out[t] = read(0, t)
            continue
        every = reduce(DataFrame.unionByName, [read(g, t).withColumn("gen", F.lit(g)) for g in range(len(folders))])
        gone = dead["edge_tombstones" if t == "edges" else "tombstones"]
        out[t] = every.join(gone, (F.col(owner) == F.col("dead")) & (F.col("gen") < F.col("since")), "left_anti").drop("gen")
    out["gram_files"] = reduce(DataFrame.unionByName, [read(g, "gram_files") for g in range(len(folders))])  # of all generations: a key's order of rarity
    out["ranks"] = read(0, "ranks")
    return out


def candidates(index: dict[str, DataFrame], pattern: str | tuple[str, ...], fixed: bool = False, fold: bool = False, whole_word: bool = False) -> DataFrame:
    """(file_id) of the files that may match any of the patterns; every matching file is among them. ``fold``: letters match in any case."""
    many = (pattern,) if isinstance(pattern, str) else pattern
    if whole_word and not fold:
        plans = [rp.word_plan(p, fixed) for p in many]
        if all(plans):
            return index["words"].where(F.col("word").isin(sorted(set().union(*plans)))).select("file_id").distinct()
    query = rp.both("or", [rp.plan(p, fixed, fold) for p in many])
    if query == rp.ALL:
        return index["files"].select("file_id")
    code = {gram_code(g): g for g in rp.grams_of(query)}
    live = index["grams"].where(F.col("gram").isin(sorted(code)))
    if "gram_files" in index:  # counted when the index was published
        held = index["gram_files"].where(F.col("gram").isin(sorted(code))).groupBy("gram").agg(F.sum("n").alias("n"))
    else:
        live = written(live, "postings")
        held = live.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts = {code[r["gram"]]: r["n"] for r in held.collect()}  # as many rows as the pattern has keys
    query = rp.thin(query, counts)
    if query == rp.NONE:
        return index["files"].select("file_id").where("false")
    held = live.where(F.col("gram").isin(sorted(map(gram_code, rp.grams_of(query))))).groupBy("file_id").agg(F.collect_set("gram").alias("held"))
    return held.where(rp.condition(query, F.col("held"))).select("file_id")


def words_containing(postings: DataFrame, needle: str, most: int = 10) -> DataFrame:
    """Longer indexed words that contain ``needle``, by the files that hold them."""
    found = postings.where(F.contains("word", F.lit(needle)) & (F.length("word") > len(needle)))
    return found.groupBy("word").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "word").limit(most)


def case_variants(syms: DataFrame, name: str) -> DataFrame:
    """Names equal to ``name`` but for ASCII case."""
    return syms.select("name").distinct().where((ascii_lower(F.col("name")) == ascii_lower(F.lit(name))) & (F.col("name") != name))


def prefix_names(syms: DataFrame, prefix: str) -> DataFrame:
    return syms.select("name").distinct().where(F.col("name").startswith(prefix))


def names_with_tokens(syms: DataFrame, name: str, most: int = 8) -> DataFrame:
    """Names that hold every part of ``name``: relational division over the parts."""
    parts = syms.select("name").distinct().select("name", F.explode(split_tokens(F.col("name"))).alias("token"))
    asked = syms.sparkSession.range(1).select(F.explode(split_tokens(F.lit(name))).alias("token")).distinct()
    hit = parts.join(F.broadcast(asked), "token").groupBy("name").agg(F.countDistinct("token").alias("k"))
    need = asked.agg(F.count(F.lit(1)).alias("need"))
    return hit.crossJoin(F.broadcast(need)).where("k = need").select("name").orderBy(F.length("name"), "name").limit(most)


def fuzzy_names(syms: DataFrame, name: str, most: int = 6) -> DataFrame:
    """Names within edit distance 1 (under eight characters) or 2, nearest first."""
    far = 1 if len(name) < 8 else 2
    near = syms.select("name").distinct().where(F.length("name").between(len(name) - far, len(name) + far))
    near = near.withColumn("distance", F.levenshtein("name", F.lit(name), far)).where("distance between 1 and " + str(far))
    return near.orderBy("distance", "name").limit(most)
