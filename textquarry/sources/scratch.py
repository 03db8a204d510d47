"""Scratch tables in the folder that all executors share: what a query reads several times is written once and read back.

The folder is ``spark.checkpoint.dir``. Only a local session may do without the setting: one is made and set there.
"""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's shared folder. A cluster without one fails here, as its executors would not find what others wrote."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="textquarry-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder, as a reader of it: lineage ends here, and a lost executor costs its tasks alone."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Delete the tables that this process wrote; results that still read them must be written before. Returns how many."""
    jvm, count = spark.sparkContext._jvm, len(_made)
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return count
