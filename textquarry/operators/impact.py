"""Impact of a change set: which uses a changed definition can break, as joins with a small table of use kinds."""

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from textquarry.functions.files import location_weight, path_flags
from textquarry.functions.text import path_key
from textquarry.operators.search import name_uses
from textquarry.sources.scratch import written

CALLABLE = ["function", "method", "macro"]
TYPED = ["class", "struct", "enum", "trait", "interface", "object", "module", "impl", "type"]
#: A change of a body asks to recheck callers; this many are shown.
BODY_SITES = 5


def use_kinds(spark: SparkSession) -> DataFrame:
    """(def_kind, gone, use_kind, direct): the uses that can depend on a definition, and whether the change breaks them.

    Every use of something gone breaks, but for member accesses of callables and types, which are found by name only.
    """
    rows = []
    for kind in [*CALLABLE, *TYPED, "constant", "variable", "field", "variant"]:
        for gone in (True, False):
            if kind in CALLABLE:
                uses = ["call", "import", "member"] + ["ident"] * (gone and kind != "method")
            elif kind in TYPED:
                uses = ["type", "call", "import", "member"] + ["ident"] * gone
            else:
                uses = ["member", "ident", "call", "import", "type"]
            for use in uses:
                named = kind in CALLABLE or kind in TYPED
                direct = use in ("call", "type") or (use == "import" and gone) or (use == "ident" and (gone or not named)) or (use == "member" and not named)
                rows.append((kind, gone, use, direct))
    return spark.createDataFrame(rows, "def_kind string, gone boolean, use_kind string, direct boolean")


def declares(line: str, start: int, end: int) -> bool:
    """Whether the name at a place of a line declares a local (after let, val, var, for or as; before a single ``=``; a parameter)."""
    import re

    after, before = line[end:].lstrip(), line[:start].rstrip()
    if after[:1] in ("{", "(") or after.startswith("::"):
        return False
    if re.search(r"\b(?:let|val|var|for|as)(?:\s+mut)?$", before) or re.match(r"=(?![=>])", after):
        return True
    head = re.match(r"\s*(?:export\s+|pub(?:\([^)]*\))?\s+|async\s+)*(?:def|fn|fun|function)\s+[\w$]+\s*(?:<[^>]*>)?\(", line)
    if not head or start < head.end():
        return False
    inside, depth = line[head.end() : start], 0
    for c in inside:
        depth += (c in "([{<") - (c in ")]}>")
    return depth == 0 and (not inside.strip() or inside.rstrip().endswith(","))


@F.pandas_udf(BooleanType())
def _any_use(text: pd.Series, places: pd.Series) -> pd.Series:
    """Whether some occurrence on the line is no declaration."""
    return pd.Series([any(not declares(t, m["s"], m["e"]) for m in p) for t, p in zip(text, places, strict=True)])


def touched(ranges: DataFrame, syms: DataFrame) -> DataFrame:
    """The innermost definition that each changed range of lines (path, first, last) touches; syms carry path, line and last_line."""
    r = ranges.withColumn("rid", F.monotonically_increasing_id()).select("rid", F.col("path").alias("r_path"), "first", "last")
    both = r.join(syms, (F.col("r_path") == F.col("path")) & (F.col("line") <= F.col("last")) & (F.col("last_line") >= F.col("first")))
    best = Window.partitionBy("rid").orderBy(F.col("last_line") - F.col("line"), F.desc("line"))
    return both.withColumn("rn", F.row_number().over(best)).where("rn = 1").drop("rn", "r_path", "rid")


def with_last_line(files: DataFrame, syms: DataFrame) -> DataFrame:
    """Symbols with their path and last line."""
    text = files.select("file_id", "path", "text")
    inside = F.substr(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return syms.join(text, "file_id").withColumn("last_line", F.col("line") + F.length(F.regexp_replace(F.regexp_replace(inside, r"\n\z", ""), r"[^\n]+", ""))).drop("text")


def diff_impact(files: DataFrame, changed: DataFrame, spans: DataFrame, syms: DataFrame, changed_lines: DataFrame | None = None) -> DataFrame:
    """All uses of all changed definitions in the new snapshot: name, change, path, line, kind, direct, turn.

    ``changed`` as from changes.changed_definitions(). Lines that the change itself touched (path, first, last) are no uses.
    ``turn`` counts a definition's sites in rank order; showing turn by turn gives every definition its first uses first.
    """
    order = F.when(F.col("change").isin("removed", "renamed"), 0).when(F.col("change") == "signature", 1).otherwise(2)
    live = changed.where("change <> 'added'").withColumn("o", order).groupBy("name").agg(F.min(F.struct("o", "change", "kind")).alias("c")).select("name", "c.*")
    live = written(live, "changed")
    found = name_uses(files, live, spans, syms).withColumn("flags", path_flags())
    if changed_lines is not None:
        c = changed_lines.select(F.col("path").alias("c_path"), "first", "last")
        found = found.join(c, (F.col("path") == F.col("c_path")) & F.col("line").between(F.col("first"), F.col("last")), "left_anti")
    used = found.where(_any_use("text", "submatches"))
    table = F.broadcast(use_kinds(files.sparkSession))
    live = live.select("name", "change", "o", F.col("kind").alias("def_kind"), F.col("change").isin("removed", "renamed").alias("gone"))
    both = used.join(live.hint("merge"), "name").join(table, ["def_kind", "gone"]).where(F.col("kind") == F.col("use_kind"))
    direct = F.col("direct") & (F.col("change") != "body")
    rank = Window.partitionBy("name").orderBy(direct.desc(), location_weight().desc(), path_key(F.col("path")), F.col("line"))
    return both.withColumn("turn", F.row_number().over(rank)).select("name", "change", "path", "line", "kind", direct.alias("direct"), "turn")


def allotted(sites: DataFrame, rows: int) -> DataFrame:
    """The sites an allowance shows: a body change has five at most; turn by turn until ``rows`` are given."""
    able = sites.where((F.col("change") != "body") | (F.col("turn") <= BODY_SITES))
    return able.orderBy("turn", "name").limit(rows)


def relocate(syms: DataFrame, name: str, kind: str, line: int) -> DataFrame:
    """A definition found again in a changed file: same name and kind, nearest line."""
    return syms.where((F.col("name") == name) & (F.col("kind") == kind)).orderBy(F.abs(F.col("line") - line), "line").limit(1)


def other_definitions(syms: DataFrame, name: str, file_id: int, line: int) -> DataFrame:
    """Definitions of the same name elsewhere."""
    return syms.where((F.col("name") == name) & ~((F.col("file_id") == file_id) & (F.col("line") == line))).select("file_id", "kind", "name", "line")
