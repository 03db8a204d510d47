"""Sources: directory trees, single texts, named files, JSON-lines event logs, snapshots and the bench tables as files."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.files import content_flags, language, path_flags
from textquarry.operators.search import glob_regex

#: Name parts that a tree walk leaves out unless asked.
HIDDEN = r"(^|/)\.[^/]"


def decode(content: Column) -> Column:
    """UTF-16 with a byte-order mark is transcoded; a UTF-8 mark is cut; other bytes are UTF-8, wrong ones replaced."""
    first = F.hex(F.substring(content, 1, 2))
    body = F.when(first == "FFFE", F.decode(F.substring(content, 3, 1 << 30), "UTF-16LE")).when(first == "FEFF", F.decode(F.substring(content, 3, 1 << 30), "UTF-16BE"))
    marked = F.hex(F.substring(content, 1, 3)) == "EFBBBF"
    return F.coalesce(body, F.when(marked, F.try_validate_utf8(F.substring(content, 4, 1 << 30).cast("string"))).otherwise(F.make_valid_utf8(content.cast("string"))))


def text_extent(text: Column) -> Column:
    """A NUL in the first 64 KiB makes a file binary (null); a later one ends the text at the start of its line."""
    at = F.instr(text, "\x00")
    head = F.substr(text, F.lit(1), at - 1)
    return F.when(at == 0, text).when(at <= 65536, F.lit(None)).otherwise(F.regexp_replace(head, F.lit(r"[^\n]*\z"), F.lit("")))


def describe(files: DataFrame) -> DataFrame:
    """Adds lang, size and flags to (file_id, path, text)."""
    sized = files.withColumn("lang", language(F.col("path"))).withColumn("size", F.octet_length("text").cast("long"))
    return sized.withColumn("flags", path_flags()).withColumn("content", content_flags(F.col("text"), F.col("size"))).withColumn("flags", F.struct(F.col("flags.test"), (F.col("flags.generated") | F.col("content.generated")).alias("generated"), F.col("flags.vendored"), (F.col("flags.minified") | F.col("content.minified")).alias("minified"), F.col("flags.lockfile"), F.col("content.binary").alias("binary"), F.col("content.huge").alias("huge"))).drop("content")


def ignore_patterns(lines: list[str]) -> list[tuple[str, bool]]:
    """Ignore-file lines as (regex, ignored); the last that matches decides."""
    out = []
    for line in lines:
        line = line.rstrip("\n").rstrip()
        if line and not line.startswith("#"):
            out.append((glob_regex(line.removeprefix("!")), not line.startswith("!")))
    return out


def ignored(path: Column, patterns: list[tuple[str, bool]]) -> Column:
    out = F.lit(False)
    for regex, yes in patterns:
        out = F.when(path.rlike(regex), F.lit(yes)).otherwise(out)
    return out


def _contents(listed: DataFrame, root: str) -> DataFrame:
    """Adds the bytes of each listed path. Tasks open files themselves: Spark's own file listing leaves out names that begin with an underscore."""

    def read(batches):
        import pyarrow.fs as pafs

        fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
        for pdf in batches:
            data = []
            for path in pdf["path"]:
                with fs.open_input_stream(f"{base.rstrip('/')}/{path}" if base else path, compression=None) as f:
                    data.append(f.read())
            yield pdf.assign(content=data)

    return listed.mapInPandas(read, "path string, mtime timestamp, content binary")


def tree(spark: SparkSession, root: str, ignore: list[str] | None = None, hidden: bool = False, files_per_task: int = 500) -> tuple[DataFrame, DataFrame]:
    """(files, skipped) of a directory tree: files with text and flags, and the paths that rules left out, which are not opened.

    The driver lists names; tasks read contents. ``root`` is a path that executors can open, or a URI that Arrow's file systems know.
    """
    import datetime

    import pyarrow.fs as pafs

    fs, base = pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)
    base = base.rstrip("/")
    found = [i for i in fs.get_file_info(pafs.FileSelector(base, recursive=True)) if i.type == pafs.FileType.File]
    rows = [(i.path[len(base) + 1 :], i.mtime or datetime.datetime.fromtimestamp(0, datetime.UTC)) for i in found]
    walked = spark.createDataFrame(rows, "path string, mtime timestamp").repartition(max(1, -(-len(rows) // files_per_task)))
    out = ignored(F.col("path"), ignore_patterns(ignore or [])) | (F.col("path").rlike(HIDDEN) & F.lit(not hidden))
    kept = _contents(walked.where(~out), root).select(F.xxhash64("path").alias("file_id"), "path", "mtime", text_extent(decode(F.col("content"))).alias("text"))
    return describe(kept), walked.where(out).select("path", F.when(F.col("path").rlike(HIDDEN), "hidden").otherwise("ignored").alias("why"))


def named_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Files named one by one; ignore rules do not apply to them."""
    listed = spark.createDataFrame([(p, None) for p in paths], "path string, mtime timestamp")
    return describe(_contents(listed, "").select(F.xxhash64("path").alias("file_id"), "path", text_extent(decode(F.col("content"))).alias("text")))


def one_text(spark: SparkSession, text: str, path: str = "<stdin>") -> DataFrame:
    """A single text as a file."""
    return describe(spark.createDataFrame([(0, path, text)], "file_id long, path string, text string"))


def events(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON-lines event log; malformed lines are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def documents_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as a tree: a tenth under tests/, a tenth under vendor/."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    top = F.when(F.col("doc_id") % 10 == 0, "tests/").when(F.col("doc_id") % 10 == 1, "vendor/").otherwise("src/")
    return d.select(F.col("doc_id").alias("file_id"), F.concat(top, "source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "text", F.lit("text").alias("lang"), F.octet_length("text").cast("long").alias("size"))


def pages_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``pages`` as HTML files."""
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return p.select(F.col("page_id").alias("file_id"), F.concat(F.lit("web/"), F.regexp_replace("url", "^https?://", ""), F.lit(".html")).alias("path"), F.col("html").alias("text"), F.lit("text").alias("lang"))


#: Rows of a compact table of which one task makes files.
ROWS_PER_TASK = 5_000


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt to tasks by their number, before they are made into files: a row group is read by one task, and compact ones hold millions of rows."""
    tasks = -(-rows.count() // ROWS_PER_TASK)
    return rows.repartition(tasks, key) if tasks > 1 else rows


def parts_as_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``part`` as Python files: an import, a comment, a class with a base, a method and a call in each."""
    p = dealt(spark.read.parquet(f"{sf_dir}/part.parquet"), "p_partkey")
    k, size = F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    text = F.concat(F.lit("from base import Base"), size, F.lit("\n# part_"), k, F.lit(" docs\nclass Part"), k, F.lit("(Base"), size, F.lit("):\n    def part_"), k, F.lit("(self):\n        return helper_"), (F.col("p_size") % 7).cast("string"), F.lit("(self)\n"))
    return p.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("src/"), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.lit("/part_"), k, F.lit(".py")).alias("path"), text.alias("text"), F.lit("python").alias("lang"))
