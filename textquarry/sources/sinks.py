"""Sinks: typed JSON records, the begin/match/end record stream, paths, counts and plain reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.text import path_key


def json_records(found: DataFrame) -> DataFrame:
    """One JSON record per hit: path, line, kind, score, text, submatches with byte offsets."""
    spans = F.transform("submatches", lambda m: F.struct(F.octet_length(F.substr(F.col("text"), F.lit(1), m["s"])).alias("start"), F.octet_length(F.substr(F.col("text"), F.lit(1), m["e"])).alias("end")))
    record = F.to_json(F.struct(F.lit("hit").alias("type"), "path", "line", "kind", F.round("score", 6).alias("score"), "text", spans.alias("submatches")))
    return found.select(path_key(F.col("path")).alias("k"), "line", record.alias("value")).orderBy("k", "line").select("value")


def records(rows: DataFrame, kind: str, order: list[str] | None = None) -> DataFrame:
    """One JSON record of type ``kind`` for each row of a verb's answer."""
    record = F.to_json(F.struct(F.lit(kind).alias("type"), *rows.columns))
    out = rows.withColumn("value", record)
    return (out.orderBy(*order) if order else out).select("value")


def event_records(found: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """begin, match, context and end records of each file, in path order, then a summary. ``context`` as from search.with_context(): its lines that did not match."""
    match = found.select("path", F.lit(1).alias("part"), "line", F.to_json(F.struct(F.lit("match").alias("type"), F.struct("path", F.col("line").alias("line_number"), F.col("text").alias("lines"), "submatches").alias("data"))).alias("value"))
    per = found.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    begin = per.select("path", F.lit(0).alias("part"), F.lit(0).alias("line"), F.to_json(F.struct(F.lit("begin").alias("type"), F.struct("path").alias("data"))).alias("value"))
    end = per.select("path", F.lit(2).alias("part"), F.lit(0).alias("line"), F.to_json(F.struct(F.lit("end").alias("type"), F.struct("path", F.col("n").alias("matched_lines")).alias("data"))).alias("value"))
    total = per.agg(F.count(F.lit(1)).alias("searches_with_match"), F.coalesce(F.sum("n"), F.lit(0)).alias("matched_lines"))
    last = total.select(F.lit(None).cast("string").alias("path"), F.lit(3).alias("part"), F.lit(0).alias("line"), F.to_json(F.struct(F.lit("summary").alias("type"), F.struct("searches_with_match", "matched_lines").alias("data"))).alias("value"))
    if context is not None:
        near = F.to_json(F.struct(F.lit("context").alias("type"), F.struct("path", F.col("line").alias("line_number"), F.col("text").alias("lines")).alias("data")))
        match = match.unionByName(context.where("not matched").select("path", F.lit(1).alias("part"), "line", near.alias("value")))
    return begin.unionByName(match).unionByName(end).unionByName(last).orderBy(path_key(F.col("path")).asc_nulls_last(), "part", "line").select("value")


def paths(found: DataFrame) -> DataFrame:
    return found.select("path").distinct().orderBy(path_key(F.col("path")))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("path").agg(F.countDistinct("line").alias("lines")).orderBy(path_key(F.col("path")))


def report(shown: DataFrame) -> str:
    """A plain report of budgeted hits (already few): a header for each file, then line numbers and text."""
    out, last = [], None
    for r in shown.orderBy(F.round("score", 9).desc(), path_key(F.col("path")), "line").collect():
        if r["path"] != last:
            out.append(r["path"])
            last = r["path"]
        out.append(f"  {r['line']}: {r['text'].strip()}")
    return "\n".join(out)
