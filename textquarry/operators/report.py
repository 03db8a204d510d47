"""Shaping an answer: kept lines, statistics, layouts, hints, byte limits and explanations."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.files import code_without_grammar
from textquarry.functions.text import ascii_lower, extension, path_key
from textquarry.operators.impact import with_last_line
from textquarry.operators.search import HIT_WEIGHTS, SearchOptions, demotion, fit_budget, lines
from textquarry.operators.symbols import enclosing
from textquarry.sources.scratch import written

MOST_DEFS = 64


def kept_lines(found: DataFrame, lead: int = 1, per_pool: int = 64) -> DataFrame:
    """Per file: the first ``lead`` lines, up to 64 definitions, and the best ``per_pool`` exact and other lines."""
    by_line = Window.partitionBy("file_id").orderBy("line")
    pool = Window.partitionBy("file_id", "exact").orderBy(F.round("score", 9).desc(), "line")
    defs = Window.partitionBy("file_id", F.col("kind") == "def").orderBy("line")
    out = found.withColumn("n", F.row_number().over(by_line)).withColumn("p", F.row_number().over(pool)).withColumn("d", F.row_number().over(defs))
    return out.where((F.col("n") <= lead) | ((F.col("kind") == "def") & (F.col("d") <= MOST_DEFS)) | (F.col("p") <= per_pool)).drop("n", "p", "d")


def statistics(found: DataFrame) -> DataFrame:
    """One row: files, hits, hits in demoted files, hits by kind."""
    marked = found.withColumn("aside", demotion().isNotNull())
    return marked.agg(F.countDistinct("file_id").alias("files"), F.count(F.lit(1)).alias("hits"), F.count_if("aside").alias("demoted_hits"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in HIT_WEIGHTS])


def import_files(found: DataFrame) -> DataFrame:
    """Files with import hits, by prior."""
    return found.where("kind = 'import'").groupBy("file_id", "path").agg(F.max("prior").alias("prior")).orderBy(F.round("prior", 9).desc(), path_key(F.col("path")))


def no_grammar_note(found: DataFrame) -> DataFrame:
    """Matching code files that have no extraction rules: how many, and their extensions."""
    plain = found.select("path").distinct().where(code_without_grammar(F.col("path")))
    return plain.agg(F.count(F.lit(1)).alias("files"), F.array_sort(F.collect_set(ascii_lower(extension(F.col("path"))))).alias("extensions"))


def file_order(found: DataFrame, sort: str = "rank") -> DataFrame:
    """Files of an answer: by prior, or by path."""
    per = found.groupBy("file_id", "path").agg(F.max("prior").alias("prior"), F.countDistinct("line").alias("total"))
    return per.orderBy(path_key(F.col("path"))) if sort == "path" else per.orderBy(F.round("prior", 9).desc(), path_key(F.col("path")))


def layout(found: DataFrame, o: SearchOptions, mode: str = "auto", symbols: DataFrame | None = None, files: DataFrame | None = None) -> tuple[str, DataFrame]:
    """(layout, rows). ``files``: paths in order; ``count``: matched lines by file; ``outline``: the definitions around hits, with how many; ``block``: the lines of those definitions;
    ``auto``: ("content", budgeted hits), or ("facets", definitions and top hits) when the hits are over twelve and over budget.

    With facets, definitions take at most 60 % of the budget, demoted ones at most a third of the shown (three if no other is shown), and ten others follow.
    """
    if mode in ("files", "count"):
        out = file_order(found)
        return mode, out.select("path") if mode == "files" else out.select("path", "total")
    if mode in ("outline", "block") and symbols is not None:
        inner = enclosing(found.where("offset is not null").select("file_id", "path", "line", "offset").distinct(), symbols, ["file_id", "line", "offset"]).where("symbol is not null")
        held = inner.groupBy("file_id", "path", "symbol").agg(F.countDistinct("line").alias("hits")).select("file_id", "path", "symbol.sym_id", "symbol.name", "symbol.kind", F.col("symbol.line").alias("line"), "symbol.chain", "hits")
        if mode == "outline" or files is None:
            return "outline", held.orderBy(path_key(F.col("path")), "line")
        ends = with_last_line(files, symbols).select("file_id", "sym_id", "last_line")
        rows = lines(files.join(held.select("file_id").distinct(), "file_id", "left_semi")).select("file_id", F.col("line").alias("at"), "text")
        inside = held.join(ends, ["file_id", "sym_id"]).join(rows, "file_id").where("at between line and last_line")
        return "block", inside.groupBy("path", F.col("at").alias("line"), "text").agg(F.min_by("name", "last_line").alias("symbol")).orderBy(path_key(F.col("path")), "line")
    found = written(found, "layout")  # shown, counted and cut into facets
    shown = fit_budget(found, o)
    total = found.limit(13).count()
    if total <= 12 or not o.budget or shown.count() == found.count():
        return "content", shown
    side = demotion().isNotNull()
    defs = fit_budget(found.where((F.col("kind") == "def") & ~side), _with_budget(o, o.budget * 6 // 10))
    n = defs.count()
    aside = found.where((F.col("kind") == "def") & side).orderBy(F.round("score", 9).desc(), path_key(F.col("path")), "line").limit(max(n // 3, 3 if n == 0 else 0))
    rest = found.where("kind not in ('def', 'import')").orderBy(F.round("score", 9).desc(), path_key(F.col("path")), "line").limit(10)
    columns = found.columns
    return "facets", defs.select(*columns).unionByName(aside.select(*columns)).unionByName(rest.select(*columns))


def _with_budget(o: SearchOptions, budget: int) -> SearchOptions:
    from dataclasses import replace

    return replace(o, budget=budget)


def hints(o: SearchOptions, stats: dict, facets: bool, area: str | None, shown: int, ignored: tuple[int, int] | None = None) -> list[str]:
    """What to ask next, in a fixed order: flags only."""
    out: list[str] = []
    if not stats["hits"]:
        if ignored:
            return [f"{ignored[1]} hits in {ignored[0]} ignored/hidden files: include them"]
        return ["no hits of these kinds: drop kinds"] if o.kinds else ["no hits; exact matching, nothing was relaxed"]
    if facets:
        if not o.whole_word and stats.get("exact", 0) and stats["exact"] < min(stats["hits"], 64):
            out.append("whole_word")
        if stats["n_def"] and not o.kinds:
            out.append("kinds=def")
        if area:
            out.append(f"globs={area}/**")
        if stats["demoted_hits"] and not o.no_tests:
            out.append("no_tests")
    elif shown < stats["hits"]:
        out.append(f"budget={2 * o.budget}")
        if stats["n_def"] and not o.kinds:
            out.append("kinds=def")
    return out


def within_bytes(rows: DataFrame, most: int) -> DataFrame:
    """Lines of a budgeted report (text, position) until their bytes reach a hard ceiling. Each costs a byte at least, so no more than ``most`` are numbered."""
    running = F.sum(F.octet_length("text") + 1).over(Window.orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return rows.orderBy("position").limit(most).withColumn("bytes", running).where(F.col("bytes") <= most)


def fit(found: DataFrame, o: SearchOptions, most_bytes: int) -> DataFrame:
    """The answer at the largest budget up to the asked one whose text stays under ``most_bytes``, found by bisection to a fiftieth; a budget of 50 always answers."""
    size = lambda df: df.agg(F.coalesce(F.sum(F.octet_length("text") + 12), F.lit(0)).alias("b")).first()["b"]
    found = written(found, "fit")
    if size(fit_budget(found, o)) <= most_bytes:
        return fit_budget(found, o)
    low, high = 50, o.budget
    while high - low > max(1, o.budget // 50):
        middle = (low + high) // 2
        low, high = (middle, high) if size(fit_budget(found, _with_budget(o, middle))) <= most_bytes else (low, middle)
    return fit_budget(found, _with_budget(o, low))


def explain(found: DataFrame, top: int = 10) -> DataFrame:
    """The terms of the first hits' scores."""
    return found.orderBy(F.round("score", 9).desc(), path_key(F.col("path")), "line").limit(top).select("path", "line", "kind", "exact", "prior", "score")
