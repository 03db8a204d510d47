"""Plain-word ranking of files: BM25 over the pieces of indexed words, with weight for paths and definitions."""

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textquarry.functions.files import location_weight
from textquarry.functions.text import path_key, pieces

K1, B, PATH_WEIGHT, DEF_WEIGHT, RANK_WEIGHT = 1.2, 0.75, 3.0, 1.0, 0.5
# Words a question is made of rather than about.
STOP = [
    "a", "about", "above", "after", "again", "against", "all", "also", "an", "and", "any", "are", "as", "at", "be", "because", "been", "before", "being", "below", "between",
    "both", "but", "by", "can", "code", "could", "did", "do", "does", "doing", "down", "during", "each", "few", "file", "files", "for", "from", "function", "further", "get",
    "gets", "had", "has", "have", "having", "he", "her", "here", "his", "how", "i", "if", "in", "into", "is", "it", "its", "itself", "just", "me", "method", "more", "most", "my",
    "no", "nor", "not", "now", "of", "off", "on", "once", "only", "or", "other", "our", "out", "over", "own", "same", "set", "sets", "she", "should", "so", "some", "such", "than",
    "that", "the", "their", "them", "then", "there", "these", "they", "this", "those", "through", "to", "too", "under", "until", "up", "use", "used", "uses", "using", "very",
    "was", "way", "we", "were", "what", "when", "where", "which", "while", "who", "whom", "why", "will", "with", "would", "you", "your",
]


def query_terms(question: str) -> list[str]:
    """The question's pieces, lower case, in order, without repeats or stop words."""
    out: list[str] = []
    for word in re.findall(r"[A-Za-z_][A-Za-z0-9_]*", question):
        if len(word) < 3 or word.lower() in STOP:
            continue
        for piece in re.split(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+", word):
            p = piece.lower()
            if len(p) >= 3 and p not in STOP and p not in out:
                out.append(p)
    return out


def _cut(word):
    """pieces() of an indexed word. One without an underscore and without capitals behind its first letter is one piece, and no pattern runs over it: nearly all are."""
    rest = F.substr(word, F.lit(2))
    whole = ~F.contains(word, F.lit("_")) & (F.lower(rest) == rest)
    return F.when(whole, F.filter(F.array(F.lower(word)), lambda p: F.length(p) >= 3)).otherwise(F.array_distinct(pieces(word)))


def piece_postings(words: DataFrame, terms: list[str] | None = None) -> DataFrame:
    """(piece, file_id, tf): how many distinct words of a file hold a piece. Built once beside the word postings, or for some terms alone."""
    if terms is not None:
        words = words.where(F.lower("word").rlike("|".join(terms)) if terms else F.lit(False))
    held = words.select("file_id", "word", F.explode(_cut(F.col("word"))).alias("piece"))
    return held.groupBy("piece", "file_id").agg(F.count(F.lit(1)).alias("tf"))


def find(files: DataFrame, postings: DataFrame, question: str, symbols: DataFrame | None = None, ranks: DataFrame | None = None, top: int = 50) -> DataFrame:
    """The files that answer a question best: file_id, path, terms, score. ``postings`` from piece_postings()."""
    terms = query_terms(question)
    sized = files.select("file_id", "path", (F.col("size") if "size" in files.columns else F.octet_length("text")).alias("size"))
    stats = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("avg_size"))
    body = postings.where(F.col("piece").isin(terms)).withColumn("tf", F.col("tf").cast("double"))
    named = sized.select("file_id", F.explode(F.array_distinct(pieces(F.col("path")))).alias("piece")).where(F.col("piece").isin(terms)).withColumn("in_path", F.lit(1.0))
    both = body.join(named, ["piece", "file_id"], "full")
    if symbols is not None:
        defs = symbols.select("file_id", F.explode(F.array_distinct(pieces(F.col("name")))).alias("piece")).where(F.col("piece").isin(terms)).distinct().withColumn("in_def", F.lit(1.0))
        both = both.join(defs, ["piece", "file_id"], "full")
    else:
        both = both.withColumn("in_def", F.lit(0.0))
    df = both.groupBy("piece").agg(F.count(F.lit(1)).alias("df"))
    tf = F.coalesce("tf", F.lit(0.0))
    scored = both.join(F.broadcast(df), "piece").join(sized, "file_id").crossJoin(F.broadcast(stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    term = idf * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("size") / F.col("avg_size"))) + PATH_WEIGHT * F.coalesce("in_path", F.lit(0.0)) + DEF_WEIGHT * F.coalesce("in_def", F.lit(0.0)))
    total = scored.groupBy("file_id", "path").agg(F.sum(term).alias("score"), F.array_sort(F.collect_set("piece")).alias("terms"))
    prior = location_weight()
    if ranks is not None:
        total = total.join(ranks, "file_id", "left")
        prior = prior * (1 + RANK_WEIGHT * F.sqrt(F.coalesce("rank", F.lit(0.0))))
    total = total.withColumn("score", F.col("score") * prior)
    return total.orderBy(F.round("score", 9).desc(), path_key(F.col("path"))).limit(top).select("file_id", "path", "terms", "score")


def best_definitions(found: DataFrame, symbols: DataFrame, question: str, per_file: int = 3) -> DataFrame:
    """The definitions of found files whose names hold the most of the question's pieces."""
    from pyspark.sql import Window

    terms = query_terms(question)
    held = F.size(F.array_intersect(pieces(F.col("name")), F.array(*[F.lit(t) for t in terms]) if terms else F.expr("cast(array() as array<string>)")))
    near = symbols.join(found.select("file_id"), "file_id", "left_semi").withColumn("held", held).where("held > 0")
    return near.withColumn("rn", F.row_number().over(Window.partitionBy("file_id").orderBy(F.desc("held"), "line"))).where(F.col("rn") <= per_file).select("file_id", "kind", "name", "line", "held")
