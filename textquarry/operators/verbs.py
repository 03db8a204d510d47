"""Symbol queries: def, refs, callers, impls, impact, outline, show and map, as joins of the symbol, span and edge tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions.files import location_weight, path_flags
from textquarry.functions.text import constant_style, parent, path_key
from textquarry.operators.index import case_variants, fuzzy_names, names_with_tokens
from textquarry.operators.search import SearchOptions, hits, line_starts, lines, matched_files
from textquarry.operators.symbols import KIND_WEIGHTS, enclosing
from textquarry.operators.symbols import symbols as extract_symbols
from textquarry.sources.scratch import written


def kind_weight(kind: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv]), kind), F.lit(0.5))


def reach(files: DataFrame, edges: DataFrame, origins: list[int]) -> DataFrame:
    """(file_id, reach): 1 for an origin or what it imports, 0.8 two hops away or importing it, 0.6 in its directory, else 0.4; 0.6 for all without origins."""
    if not origins:
        return files.select("file_id", F.lit(0.6).alias("reach"))
    start = edges.sparkSession.createDataFrame([(o,) for o in origins], "o long")
    one = edges.join(F.broadcast(start), edges["src"] == start["o"]).select("o", F.col("dst").alias("mid"))
    few = one.withColumn("rn", F.row_number().over(Window.partitionBy("o").orderBy("mid"))).where("rn <= 64").select("mid").distinct()
    two = edges.join(few, edges["src"] == few["mid"]).select(F.col("dst").alias("file_id"), F.lit(0.8).alias("w"))
    back = edges.join(F.broadcast(start), edges["dst"] == start["o"]).select(F.col("src").alias("file_id"), F.lit(0.8).alias("w"))
    near = files.select("file_id", parent(F.col("path")).alias("d")).join(F.broadcast(files.where(F.col("file_id").isin(origins)).select(parent(F.col("path")).alias("d")).distinct()), "d").select("file_id", F.lit(0.6).alias("w"))
    own = start.select(F.col("o").alias("file_id"), F.lit(1.0).alias("w")).unionByName(one.select(F.col("mid").alias("file_id"), F.lit(1.0).alias("w")))
    best = own.unionByName(two).unionByName(back).unionByName(near).groupBy("file_id").agg(F.max("w").alias("reach"))
    return files.select("file_id").join(best, "file_id", "left").select("file_id", F.coalesce("reach", F.lit(0.4)).alias("reach"))


def definitions(files: DataFrame, symbols: DataFrame, name: str, ranks: DataFrame | None = None, edges: DataFrame | None = None, origins: list[int] | None = None, kind: str | None = None, top: int = 256) -> DataFrame:
    """Definitions of a name, and files that are modules of that name, best first.

    score = kind x exported x nesting x place x (0.6 + 0.4 rank) x reach. At most three impl blocks stand beside other kinds.
    """
    named = symbols.where(F.col("name") == name)
    up = symbols.select("file_id", F.col("sym_id").alias("parent_id"), F.col("kind").alias("parent_kind"))
    named = named.join(up, ["file_id", "parent_id"], "left").select("file_id", "kind", "name", "line", "signature", "exported", "parent_kind")
    module = files.where(F.col("path").rlike(rf"(^|/){name}(\.[a-z]+|/(mod\.rs|__init__\.py|index\.[a-z]+))$")).select("file_id", F.lit("file").alias("kind"), F.lit(name).alias("name"), F.lit(1).alias("line"), F.concat(F.lit("module "), F.lit(name)).alias("signature"), F.lit(True).alias("exported"), F.lit(None).cast("string").alias("parent_kind"))
    found = named.unionByName(module)
    if kind:
        found = found.where(F.col("kind") == kind)
    found = found.join(files.select("file_id", "path"), "file_id").join(reach(files, edges, origins or []) if edges is not None else files.select("file_id", F.lit(0.6).alias("reach")), "file_id")
    rank = F.lit(0.5)
    if ranks is not None:
        found = found.join(ranks, "file_id", "left")
        rank = F.coalesce("rank", F.lit(0.5))
    nested = F.when(F.col("parent_kind").isin("function", "method"), 0.7).otherwise(1.0)
    score = kind_weight(F.col("kind")) * F.when(F.col("exported"), 1.0).otherwise(0.85) * nested * location_weight() * (0.6 + 0.4 * rank) * F.col("reach")
    order = [F.round("score", 9).desc(), path_key(F.col("path")), F.col("line")]
    found = found.withColumn("score", score).select("file_id", "path", "line", "kind", "name", "signature", "score")
    found = written(found, "definitions")  # one name's definitions, read thrice
    others, blocks = found.where("kind <> 'impl'"), found.where("kind = 'impl'")
    most = top if others.isEmpty() else 3
    return others.orderBy(*order).limit(top).unionByName(blocks.orderBy(*order).limit(most)).orderBy(*order).limit(top)


def references(files: DataFrame, name: str, spans: DataFrame | None = None, symbols: DataFrame | None = None, index: dict[str, DataFrame] | None = None, imports: DataFrame | None = None, edges: DataFrame | None = None) -> DataFrame:
    """Whole-word hits of a name with their kinds. With edges, ``resolved`` says whether the file is linked to a definition: it has one, or imports one at most two hops away, or is imported by one.

    Without tables, the files that hold the name are read for them.
    """
    found = hits(files, SearchOptions(name, fixed=True, whole_word=True, max_filesize=(1 << 63) - 1), index, spans, symbols, imports)
    found = found.withColumn("is_def", F.col("kind") == "def")
    if edges is None or symbols is None:
        return found
    homes = symbols.where(F.col("name") == name).select(F.col("file_id").alias("home")).distinct()
    near = _importers(edges, homes)
    back = edges.join(homes, F.col("src") == F.col("home")).select(F.col("dst").alias("near"))
    linked = homes.select(F.col("home").alias("near")).unionByName(near).unionByName(_importers(edges, near.withColumnRenamed("near", "home"))).unionByName(back).distinct()
    return found.join(linked, F.col("file_id") == F.col("near"), "left").withColumn("resolved", F.col("near").isNotNull()).drop("near")


def _importers(edges: DataFrame, homes: DataFrame) -> DataFrame:
    """(near): files with an edge to one of ``homes`` (home)."""
    return edges.join(homes, F.col("dst") == F.col("home")).select(F.col("src").alias("near")).distinct()


def callers(files: DataFrame, name: str, spans: DataFrame, symbols: DataFrame, index: dict[str, DataFrame] | None = None, lines_shown: int = 8, imports: DataFrame | None = None) -> DataFrame:
    """Call and member hits by enclosing symbol: file_id, path, symbol, calls, lines, score = prior x (1 + ln calls)."""
    found = references(files, name, spans, symbols, index, imports).where(F.col("kind").isin("call", "member"))
    inner = enclosing(found.select("file_id", "path", "line", "offset", "prior"), symbols, ["file_id", "line", "offset"])
    grouped = inner.groupBy("file_id", "path", F.col("symbol.sym_id").alias("sym_id"), F.col("symbol.name").alias("symbol")).agg(F.count(F.lit(1)).alias("calls"), F.slice(F.array_sort(F.collect_set("line")), 1, lines_shown).alias("lines"), F.max("prior").alias("prior"))
    return grouped.withColumn("score", F.col("prior") * (1 + F.log("calls"))).drop("prior")


def callers_two_deep(files: DataFrame, name: str, spans: DataFrame, symbols: DataFrame, index: dict[str, DataFrame] | None = None, names: int = 12, lines_shown: int = 8) -> DataFrame:
    """Callers, and the callers of the first ``names`` of them, with their depth and whose callers they are. The second depth is one search for all of those names."""
    first = written(callers(files, name, spans, symbols, index, lines_shown), "callers")
    out = first.withColumn("depth", F.lit(1)).withColumn("of", F.lit(name))
    best = [r["symbol"] for r in first.where("symbol is not null").groupBy("symbol").agg(F.max("score").alias("s")).orderBy(F.round("s", 9).desc(), "symbol").limit(names).collect()]
    best = [n for n in best if n != name]
    if not best:
        return out
    found = hits(files, SearchOptions(tuple(best), fixed=True, whole_word=True, max_filesize=(1 << 63) - 1), index, spans, symbols)
    each = found.select("file_id", "path", "line", "prior", F.col("offset") - F.col("first.s"), F.posexplode(F.arrays_zip("submatches", "kinds")).alias("n", "m"), F.col("text").alias("body")).toDF("file_id", "path", "line", "prior", "at", "n", "m", "body")
    each = each.where(F.col("m.kinds").isin("call", "member")).withColumn("of", F.substr("body", F.col("m.submatches.s") + 1, F.col("m.submatches.e") - F.col("m.submatches.s"))).withColumn("offset", F.col("at") + F.col("m.submatches.s"))
    each = each.groupBy("file_id", "path", "line", "of").agg(F.min("offset").alias("offset"), F.max("prior").alias("prior"))
    inner = enclosing(each, symbols, ["file_id", "line", "offset"])
    second = inner.groupBy("file_id", "path", F.col("symbol.sym_id").alias("sym_id"), F.col("symbol.name").alias("symbol"), "of").agg(F.count(F.lit(1)).alias("calls"), F.slice(F.array_sort(F.collect_set("line")), 1, lines_shown).alias("lines"), F.max("prior").alias("prior"))
    second = second.withColumn("score", F.col("prior") * (1 + F.log("calls"))).withColumn("depth", F.lit(2))
    return out.unionByName(second.select(*out.columns))


def implementations(files: DataFrame, symbols: DataFrame, name: str, ranks: DataFrame | None = None, top: int = 200) -> DataFrame:
    """Types that name it among their bases."""
    found = symbols.where(F.array_contains("supers", name)).join(files.select("file_id", "path"), "file_id")
    rank = F.lit(0.5)
    if ranks is not None:
        found = found.join(ranks, "file_id", "left")
        rank = F.coalesce("rank", F.lit(0.5))
    score = kind_weight(F.col("kind")) * location_weight() * (0.6 + 0.4 * rank)
    return found.withColumn("score", score).orderBy(F.round("score", 9).desc(), path_key(F.col("path")), "line").limit(top).select("file_id", "path", "line", "kind", "name", "score")


def possible_implementations(files: DataFrame, name: str, spans: DataFrame, symbols: DataFrame, most: int = 40) -> DataFrame:
    """Lines that use the name as a type and are no known implementation."""
    direct = symbols.where(F.array_contains("supers", name)).select("file_id", "line").distinct()
    return references(files, name, spans, symbols).where("kind = 'type'").join(direct, ["file_id", "line"], "left_anti").orderBy(path_key(F.col("path")), "line").limit(most)


def impact(files: DataFrame, name: str, spans: DataFrame, symbols: DataFrame, edges: DataFrame, index: dict[str, DataFrame] | None = None, imports: DataFrame | None = None) -> DataFrame:
    """Files that use a name, graded: review (tests, demoted, no rules), likely (a strong use in a file linked to a definition: its own, an import, or the import of a module that imports it), possible, review."""
    used = references(files, name, spans, symbols, index, imports).where("kind not in ('def', 'comment', 'string', 'doc')")
    homes = symbols.where(F.col("name") == name).select(F.col("file_id").alias("home")).distinct()
    near = _importers(edges, homes)
    linked = homes.select(F.col("home").alias("near")).unionByName(near).unionByName(_importers(edges, near.withColumnRenamed("near", "home"))).distinct().select(F.col("near").alias("file_id"), F.lit(True).alias("linked"))
    strong = F.max(F.col("kind").isin("call", "type", "import"))
    per = used.groupBy("file_id", "path", "lang").agg(F.count(F.lit(1)).alias("uses"), strong.alias("strong"), F.max(F.col("kind") == "member").alias("weak")).join(linked, "file_id", "left")
    per = per.withColumn("flags", path_flags())
    aside = F.expr("flags.test or flags.vendored or flags.generated") | F.col("lang").isNull() | (F.col("lang") == "text")
    grade = F.when(aside, "review").when(F.col("strong") & F.coalesce("linked", F.lit(False)), "likely").when(F.col("strong") | F.col("weak"), "possible").otherwise("review")
    return per.select("file_id", "path", "uses", grade.alias("grade"))


def outline(symbols: DataFrame, file_id: int) -> DataFrame:
    """A file's definitions in order, with their depth."""
    return symbols.where(F.col("file_id") == file_id).select("sym_id", F.size("chain").alias("depth"), "kind", "name", "line", "parent_id").orderBy("line")


def show(files: DataFrame, symbols: DataFrame, file_id: int, line: int, around: int = 20) -> DataFrame:
    """The lines of the innermost definition that holds a line, or ``around`` lines on both sides."""
    one = files.where(F.col("file_id") == file_id)
    numbered = lines(one).select("file_id", "line", "text").join(line_starts(one).withColumnRenamed("at", "from"), ["file_id", "line"])
    at = numbered.where(F.col("line") == line).select("file_id", F.col("from").alias("offset"))
    held = symbols.where((F.col("file_id") == file_id) & (F.col("line") <= line)).join(at, "file_id").where((F.col("end") > F.col("offset")) | (F.col("line") == line))
    best = held.orderBy(F.desc("start")).limit(1).select("file_id", F.col("line").alias("first"), F.col("end").alias("stop"))
    both = numbered.join(best, "file_id", "left")
    inside = F.when(F.col("first").isNull(), F.col("line").between(line - around, line + around)).otherwise((F.col("line") >= F.col("first")) & (F.col("from") < F.col("stop")))
    return both.where(inside).select("line", "text").orderBy("line")


def constants_read(symbols: DataFrame, body: DataFrame, file_id: int | None = None, most: int = 12) -> DataFrame:
    """Constants that a body (line, text) names: those of its own file, and names in the style of constants with three definitions at most."""
    names = body.select(F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0))).alias("name")).distinct()
    found = symbols.where("kind in ('constant', 'variable')").join(names, "name", "left_semi")
    few = found.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n <= 3")
    own = F.col("file_id") == F.lit(file_id) if file_id is not None else F.lit(False)
    found = found.join(few, "name", "left").where(own | (F.col("n").isNotNull() & constant_style(F.col("name"))))
    return found.orderBy((~own).cast("int"), "name", "file_id", "line").limit(most).select("file_id", "name", "line", "signature")


def find_definitions(files: DataFrame, symbols: DataFrame, name: str, **how) -> tuple[str, DataFrame]:
    """(rung, definitions): of the name itself, else of names that differ in case, hold all of its parts, or are near by edit distance."""
    found = definitions(files, symbols, name, **how)
    if not found.isEmpty():
        return "exact", found
    rungs = [("case", case_variants(symbols, name).limit(8)), ("tokens", names_with_tokens(symbols, name)), ("fuzzy", fuzzy_names(symbols, name).select("name"))]
    for rung, names in rungs:
        if rung == "fuzzy" and len(name) < 4:
            break
        known = [r["name"] for r in names.collect()]  # eight names at most
        if known:
            parts = [definitions(files, symbols, n, **how) for n in known]
            out = parts[0]
            for p in parts[1:]:
                out = out.unionByName(p)
            return rung, out.orderBy(F.round("score", 9).desc(), path_key(F.col("path")), "line")
    return "none", found


def scan_definitions(files: DataFrame, name: str, **how) -> DataFrame:
    """Definitions of a name without an index: the files that hold it are read, and no others."""
    holding = matched_files(files, SearchOptions(name, fixed=True, whole_word=True, max_filesize=(1 << 63) - 1))
    return definitions(files, extract_symbols(holding), name, **how)


def map_files(files: DataFrame, symbols: DataFrame, ranks: DataFrame, top: int = 50) -> DataFrame:
    """Files by rank x place, with their symbol counts and first five exported names."""
    own = Window.partitionBy("file_id").orderBy("line")
    first = symbols.where("exported").withColumn("rn", F.row_number().over(own)).where("rn <= 5").groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rn", "name"))), lambda s: s["name"]).alias("names"))
    count = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    out = files.select("file_id", "path").join(ranks, "file_id", "left").join(count, "file_id", "left").join(first, "file_id", "left")
    score = F.coalesce("rank", F.lit(0.5)) * location_weight()
    return out.select("file_id", "path", F.coalesce("symbols", F.lit(0)).cast("long").alias("symbols"), "names", score.alias("score")).orderBy(F.round("score", 9).desc(), path_key(F.col("path"))).limit(top)


def map_directories(files: DataFrame, symbols: DataFrame, ranks: DataFrame, below: str = "", shown: int = 3) -> DataFrame:
    """Per next directory under ``below``: files, symbols, best rank, first files by rank."""
    inside = files.where(F.col("path").startswith(below + "/")) if below else files
    rest = F.substr(F.col("path"), F.lit(len(below) + 2 if below else 1))
    inside = inside.select("file_id", "path", F.when(F.contains(rest, F.lit("/")), F.split_part(rest, F.lit("/"), F.lit(1))).otherwise(F.lit(".")).alias("dir"))
    count = symbols.groupBy("file_id").agg(F.count(F.lit(1)).alias("symbols"))
    both = inside.join(count, "file_id", "left").join(ranks, "file_id", "left").withColumn("rank", F.coalesce("rank", F.lit(0.5)))
    best = both.withColumn("rn", F.row_number().over(Window.partitionBy("dir").orderBy(F.round("rank", 9).desc(), path_key(F.col("path")))))
    return best.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("symbols"), F.lit(0)).alias("symbols"), F.max("rank").alias("rank"), F.transform(F.array_sort(F.collect_list(F.when(F.col("rn") <= shown, F.struct("rn", "path")))), lambda s: s["path"]).alias("first"))


def body(files: DataFrame, file_id: int, first: int, last: int, most: int = 60, budget: int = 0) -> DataFrame:
    """Lines of a body, ``most`` at the most, clipped to a token budget but never under three."""
    from textquarry.functions.tokens import estimate_tokens

    inside = lines(files.where(F.col("file_id") == file_id)).where(F.col("line").between(first, min(last, first + most - 1))).select("line", "text")
    if not budget:
        return inside.orderBy("line")
    spent = F.sum(estimate_tokens(F.col("text")) + 1).over(Window.orderBy("line"))  # at most ``most`` lines
    return inside.withColumn("spent", spent).where((F.col("spent") <= budget) | (F.col("line") < first + 3)).select("line", "text").orderBy("line")
