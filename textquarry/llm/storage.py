"""Scratch tables in the folder that all executors share.

The folder is ``spark.checkpoint.dir``. Where a local session has none (tests, a
laptop), one is made and set; a cluster without one is an error. Tables are written with Spark's own writers, so a
lost executor only repeats its tasks, and a reader finds every row again.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession

from textquarry.sources.scratch import shared_dir

#: Paths handed out in this process, for clear() and written().
_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    path = f"{shared_dir(spark)}/textquarry/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def _delete(spark: SparkSession, path: str) -> None:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def clear(spark: SparkSession) -> int:
    """Delete the scratch tables that this process made; results that still read them must be written before. Returns how many."""
    found = len(_made)
    while _made:
        _delete(spark, _made.pop())
    return found


def written(df: DataFrame, name: str, since: int) -> DataFrame:
    """materialise(), then delete the scratch tables made from number ``since`` on: the caller says that ``df`` alone read them."""
    out, kept = materialise(df, name), _made[-1]
    for path in _made[since:-1]:
        _delete(df.sparkSession, path)
    _made[since:] = [kept]
    return out


def count() -> int:
    """How many scratch tables there are, as a number for written()."""
    return len(_made)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return a reader of it: lineage ends here."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
