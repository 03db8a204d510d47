"""Text search: matches by line, classification, ranking, facets, budgets and the fallback ladder."""

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from textquarry.functions.code import LANGUAGES as LANGUAGES_READ
from textquarry.functions.context import context_kind
from textquarry.functions.files import FILE_TYPE_NAMES, FILE_TYPES, LANGUAGES, language, location_weight, mock_path, near_weight, path_flags
from textquarry.functions.text import extension, path_key, regex_escape, split_tokens
from textquarry.functions.tokens import estimate_tokens
from textquarry.operators.index import candidates, fuzzy_names, names_with_tokens
from textquarry.operators.symbols import extract, overlapping, part
from textquarry.sources.scratch import written

# How much a kind of hit counts.
HIT_WEIGHTS = {"def": 1.0, "call": 0.6, "type": 0.5, "member": 0.45, "import": 0.45, "ident": 0.4, "doc": 0.3, "comment": 0.25, "string": 0.25}
EDGE_BEFORE, EDGE_AFTER = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"


@dataclass(frozen=True)
class SearchOptions:
    """One search. ``pattern``: a regular expression (or a list, any of which may match)."""

    pattern: str | tuple[str, ...]
    fixed: bool = False
    whole_word: bool = False
    whole_line: bool = False
    ignore_case: bool = False
    smart_case: bool = False
    invert: bool = False
    globs: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    paths: tuple[str, ...] = ()
    near: tuple[str, ...] = ()
    kinds: tuple[str, ...] = ()
    no_tests: bool = False
    no_vendored: bool = False
    no_generated: bool = False
    everything: bool = False
    max_filesize: int = 4 << 20
    per_file: int = 4
    columns: int = 200
    budget: int = 2000

    @property
    def patterns(self) -> tuple[str, ...]:
        return (self.pattern,) if isinstance(self.pattern, str) else self.pattern

    @property
    def fold(self) -> bool:
        """Whether letters match in any case: as asked, or by a pattern without capitals."""
        return self.ignore_case or (self.smart_case and not any(c.isupper() for p in self.patterns for c in p))

    def regex(self) -> str:
        """The pattern as one Java regular expression."""
        many = self.patterns
        body = "|".join(regex_escape(p) if self.fixed else p for p in many)
        if len(many) > 1 or self.whole_word or self.whole_line:
            body = f"(?:{body})"
        if self.whole_word:
            body = EDGE_BEFORE + body + EDGE_AFTER
        if self.whole_line:
            body = f"^{body}$"
        return ("(?iu)" if self.fold else "") + body


def glob_regex(glob: str) -> str:
    """A path glob as a regular expression: ``*`` and ``?`` stay inside a directory, ``**`` crosses; without a slash it names a file anywhere."""
    glob = glob.removeprefix("!")
    out, k = "", 0
    while k < len(glob):
        if glob.startswith("**/", k):
            out, k = out + "(?:.*/)?", k + 3
        elif glob.startswith("**", k):
            out, k = out + ".*", k + 2
        elif glob[k] in "*?":
            out, k = out + ("[^/]*" if glob[k] == "*" else "[^/]"), k + 1
        elif glob[k] == "[" and "]" in glob[k:]:
            end = glob.index("]", k)
            out, k = out + "[" + glob[k + 1 : end].replace("!", "^", 1) + "]", end + 1
        elif glob[k] == "{" and "}" in glob[k:]:
            end = glob.index("}", k)
            out, k = out + "(?:" + "|".join(regex_escape(p) for p in glob[k + 1 : end].split(",")) + ")", end + 1
        else:
            out, k = out + regex_escape(glob[k]), k + 1
    lead = "^" if "/" in glob.strip("/") or glob.startswith("/") else "(?:^|.*/)"
    return lead + out.lstrip("/") + ("" if not glob.endswith("/") else ".*") + "(?:/.*)?$"


def selected(files: DataFrame, o: SearchOptions) -> DataFrame:
    """The files a search covers, with their flags: size, globs (the last that matches decides), languages, paths and exclusions."""
    out = files if "flags" in files.columns else files.withColumn("flags", path_flags())
    out = out.where(F.octet_length("text") <= o.max_filesize)
    if o.globs:
        keep = F.lit(all(g.startswith("!") for g in o.globs))
        for g in o.globs:
            keep = F.when(F.col("path").rlike(glob_regex(g)), F.lit(not g.startswith("!"))).otherwise(keep)
        out = out.where(keep)
    if o.langs:
        out = out.where(F.col("lang").isin(list(o.langs)))
    if o.paths:
        inside = F.lit(False)
        for p in o.paths:
            p = p.removeprefix("./").rstrip("/")
            inside = inside | (F.col("path") == p) | F.col("path").startswith(p + "/")
        out = out.where(inside)
    for flag, off in (("test", o.no_tests), ("vendored", o.no_vendored), ("generated", o.no_generated)):
        if off:
            out = out.where(~F.col("flags")[flag])
    return out


def lines(files: DataFrame) -> DataFrame:
    """(file columns, line from 1, width, text of the line): a trailing newline begins no line, a carriage return before it is cut; the width counts both."""
    kept = [c for c in files.columns if c != "text"]
    text = F.regexp_replace("text", r"\n\z", "")
    split = F.split(text, "\n")
    return files.where(F.col("text").isNotNull() & (F.col("text") != "")).select(*kept, F.posexplode(split).alias("line", "text")).withColumn("line", F.col("line") + 1).withColumn("width", F.length("text") + 1).withColumn("text", F.regexp_replace("text", r"\r\z", ""))


def places(text: Column, pattern: str) -> Column:
    """array<struct<s, e>> of a line's matches in characters, empty ones left out."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("t"))
    none = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<s: int, e: int>>)").alias("out"))

    def step(acc, x):
        s = acc["at"] + F.length(x["p"])
        e = s + F.coalesce(F.length(x["t"]), F.lit(0))
        return F.struct(e.alias("at"), F.when(x["t"].isNull() | (x["t"] == ""), acc["out"]).otherwise(F.array_append(acc["out"], F.struct(s.alias("s"), e.alias("e")))).alias("out"))

    return F.aggregate(parts, none, step, lambda a: a["out"])


def matched_files(files: DataFrame, o: SearchOptions, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """The files that may hold a matching line: those a search covers, less what the index or their whole text rules out."""
    out = selected(files, o)
    if index is not None and not o.invert:
        out = out.join(candidates(index, o.patterns, o.fixed, o.fold, o.whole_word), "file_id", "left_semi")
    pattern = o.regex()
    if not o.invert and not o.whole_line and not any(c in pattern for c in "^$\n") and "(?" not in pattern.replace("(?iu)", "").replace("(?:", ""):
        out = out.where(F.col("text").rlike(pattern))  # whole files first: most have no match
    return out


def matched_lines(files: DataFrame, o: SearchOptions, index: dict[str, DataFrame] | None = None, placed: bool = False) -> DataFrame:
    """Lines that match: file_id, path, lang, flags, line, width, text. With an index, only candidate files are read.

    ``placed``: with ``at``, where the line begins in its file.
    """
    every = lines(matched_files(files, o, index))
    if placed:
        every = every.withColumn("at", _line_start())
    hit = F.col("text").rlike(o.regex())
    return every.where(~hit if o.invert else hit)


def _line_start() -> Column:
    return (F.sum("width").over(Window.partitionBy("file_id").orderBy("line")) - F.col("width")).cast("int")


def line_starts(files: DataFrame) -> DataFrame:
    """(file_id, line, at): where each line begins in its file, in characters."""
    return lines(files).select("file_id", "line", "width").select("file_id", "line", _line_start().alias("at"))


def hits(files: DataFrame, o: SearchOptions, index: dict[str, DataFrame] | None = None, spans: DataFrame | None = None, symbols: DataFrame | None = None, imports: DataFrame | None = None) -> DataFrame:
    """Matched lines with submatches, the kind of each, kind, exactness and score.

    The kind of an occurrence comes from the first that applies: the spans (comment, string, doc), a definition's
    name, an import, then the line itself. Without these tables, the matching files are read for them. A line's kind is that of its
    first occurrence, or of the first of a kind that is asked for; a line without one is no hit.
    """
    known = F.coalesce(F.col("lang").isin(list(LANGUAGES_READ)), F.lit(False))
    files = files if "flags" in files.columns else files.withColumn("flags", path_flags())
    found_at = places(F.col("text"), o.regex())
    match = lambda df, placed: matched_lines(df, o, index, placed).drop("width").withColumn("submatches", found_at)
    one = F.greatest(F.size("submatches"), F.lit(1))
    plain = match(files.where(~known), False).withColumn("at", F.lit(None).cast("int")).withColumn("kinds", F.array_repeat(F.lit("ident"), one))
    code = files.where(known)
    if spans is None or symbols is None:
        facts = extract(matched_files(code, o, index))
        spans, symbols, imports = part(facts, "spans"), part(facts, "symbols"), part(facts, "imports")
    found = plain.unionByName(_classified(match(code, True), spans, symbols, imports))
    first = F.lit(0)
    if o.kinds:
        wanted = F.transform("kinds", lambda k: k.isin(list(o.kinds)))
        found = found.where(F.array_contains(wanted, True))
        first = (F.array_position(wanted, True) - 1).cast("int")
    found = found.withColumn("primary", first).withColumn("kind", F.get("kinds", F.col("primary"))).withColumn("first", F.get("submatches", F.col("primary")))
    found = found.withColumn("offset", F.col("at") + F.col("first.s")).drop("at")
    word = o.pattern if isinstance(o.pattern, str) else ""
    found = found.withColumn("exact", F.col("text").rlike(EDGE_BEFORE + regex_escape(word) + EDGE_AFTER) if word else F.lit(False))
    return scored(found, o)


def _classified(found: DataFrame, spans: DataFrame, symbols: DataFrame, imports: DataFrame | None, key: tuple[str, ...] = ("file_id", "line")) -> DataFrame:
    """``found`` with the kinds of its lines' occurrences: one interval join with all that marks a place, and one aggregate by line (by ``key``)."""
    none = F.array(F.struct(F.lit(0).alias("s"), F.lit(0).alias("e")))
    carried = [c for c in found.columns if c not in key]
    points = found.select(*key, F.struct(*carried).alias("row"), F.posexplode(F.when(F.size("submatches") > 0, F.col("submatches")).otherwise(none)).alias("n", "m"))
    points = points.select(*key, "row", "n", (F.col("row.at") + F.col("m.s")).alias("from"), F.greatest(F.col("row.at") + F.col("m.e"), F.col("row.at") + F.col("m.s") + 1).alias("to"))
    marked = spans.select(F.col("file_id").alias("in_file"), "start", "end", F.lit(0).alias("turn"), F.col("kind").alias("as"))
    marked = marked.unionByName(symbols.select(F.col("file_id").alias("in_file"), F.col("name_start").alias("start"), F.col("name_end").alias("end"), F.lit(1).alias("turn"), F.lit("def").alias("as")))
    if imports is not None:
        marked = marked.unionByName(imports.select(F.col("file_id").alias("in_file"), "start", "end", F.lit(2).alias("turn"), F.lit("import").alias("as")))
    # a name counts if any of the match lies on it, a span if the match begins in it
    held = overlapping(points, marked, keep=True).withColumn("said", F.when((F.col("turn") == 1) | (F.col("start") <= F.col("from")), F.struct("turn", "as", "n")))
    each = held.groupBy(*key).agg(F.any_value("row").alias("row"), F.array_sort(F.collect_set("said")).alias("said"))
    each = each.select(*key, "row.*", "said")
    guess = _context_udf("text", F.when(F.size("submatches") > 0, F.col("submatches")).otherwise(none), "lang")
    kinds = F.transform(guess, lambda k, n: F.coalesce(F.get(F.filter("said", lambda x: x["n"] == n), F.lit(0))["as"], k))
    return each.withColumn("kinds", kinds).select(*found.columns, "kinds")


#: What a name's key may be: a run of word characters, or one other character.
_KEYS = r"[\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_\s]"


def _name_places(text: str, names: list[str]) -> list[tuple[str, int, int]]:
    """(name, start, end) of the places where one of ``names`` stands as a whole word, each name for itself, in order of place."""
    import regex

    by: dict[str, list[tuple[str, int]]] = {}
    for name in names:
        m = regex.search(r"[\p{L}\p{M}\p{N}_]+", name) or regex.search(_KEYS, name)
        by.setdefault(m.group(), []).append((name, m.start()))
    word = regex.compile(r"[\p{L}\p{M}\p{N}_]")
    out = []
    for m in regex.finditer(_KEYS, text):
        for name, lead in by.get(m.group(), ()):
            a = m.start() - lead
            b = a + len(name)
            if a >= 0 and text.startswith(name, a) and not word.match(text[a - 1 : a]) and not word.match(text[b : b + 1]):
                out.append((name, a, b))
    return out


def name_lines(files: DataFrame, names: DataFrame) -> DataFrame:
    """Lines that hold a name of ``names`` (name) as a whole word, a row for each name: file_id, path, lang, name, line, at, text, submatches.

    Names meet files by a word of theirs, so there may be as many as the files have words. A file is then read once with the names that share a word with it.
    """
    own = names.where("name <> ''").select("name").distinct()
    key = F.coalesce(F.nullif(F.regexp_extract("name", r"[\p{L}\p{M}\p{N}_]+", 0), F.lit("")), F.nullif(F.regexp_extract("name", _KEYS, 0), F.lit("")))
    keyed = own.select("name", key.alias("key")).where("key is not null").hint("merge")
    held = files.select("file_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(_KEYS), F.lit(0)))).alias("key"))
    asked = held.join(keyed, "key").groupBy("file_id").agg(F.collect_set("name").alias("names"))

    def run(batches):
        import pyarrow as pa

        place = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        shape = pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("lang", pa.string()), ("name", pa.string()), ("line", pa.int32()), ("at", pa.int32()), ("text", pa.string()), ("submatches", place)])
        for batch in batches:
            rows: list[dict] = []
            for f in (row for n in range(batch.num_rows) for row in batch.slice(n, 1).to_pylist()):
                at = 0
                for number, line in enumerate(f["text"].removesuffix("\n").split("\n"), 1):
                    shown = line.removesuffix("\r")
                    places: dict[str, list[dict]] = {}
                    for name, a, b in _name_places(shown, f["names"]):
                        places.setdefault(name, []).append({"s": a, "e": b})
                    rows += [{"file_id": f["file_id"], "path": f["path"], "lang": f["lang"], "name": name, "line": number, "at": at, "text": shown, "submatches": p} for name, p in places.items()]
                    at += len(line) + 1
                    while len(rows) >= 1000:
                        yield pa.RecordBatch.from_pylist(rows[:1000], shape)
                        rows = rows[1000:]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, shape)

    both = files.select(F.col("file_id").cast("long").alias("file_id"), "path", "lang", "text").hint("merge").join(asked, "file_id")
    return both.mapInArrow(run, "file_id long, path string, lang string, name string, line int, at int, text string, submatches array<struct<s: int, e: int>>")


def name_uses(files: DataFrame, names: DataFrame, spans: DataFrame, symbols: DataFrame, imports: DataFrame | None = None) -> DataFrame:
    """name_lines() with the kind of each name's first occurrence on the line."""
    known = F.coalesce(F.col("lang").isin(list(LANGUAGES_READ)), F.lit(False))
    plain = name_lines(files.where(~known), names).withColumn("kinds", F.array_repeat(F.lit("ident"), F.size("submatches")))
    out = plain.unionByName(_classified(name_lines(files.where(known), names), spans, symbols, imports, ("file_id", "line", "name")))
    return out.withColumn("kind", F.get("kinds", F.lit(0)))


@F.pandas_udf(ArrayType(StringType()))
def _context_udf(text: pd.Series, places: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([[context_kind(t, m["s"], m["e"], g) for m in p] for t, p, g in zip(text, places, lang, strict=True)], dtype="object")


def weight_of(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in HIT_WEIGHTS.items() for x in kv]), kind)


def scored(found: DataFrame, o: SearchOptions, ranks: DataFrame | None = None) -> DataFrame:
    """score = kind weight x file prior x exactness; the prior is the place's weight, nearness and (with ranks) import rank."""
    out = found
    rank = F.lit(None).cast("double")
    if ranks is not None:
        out = out.join(ranks, "file_id", "left")
        rank = F.col("rank")
    boost = F.when(F.col("exact") & (F.col("kind") == "def"), 1.3).when(F.col("exact"), 1.15).otherwise(1.0)
    prior = location_weight("path", "flags", o.everything) * 0.8 * near_weight(F.col("path"), list(o.near)) * (F.when(rank.isNull(), 1.0).otherwise((0.6 + 0.4 * rank) / 0.8))
    return out.withColumn("prior", prior).withColumn("score", weight_of(F.col("kind")) * F.col("prior") * boost)


def ranked(found: DataFrame, top: int) -> DataFrame:
    """The best hits: score, then path name by name, then line."""
    return found.orderBy(F.round("score", 9).desc(), path_key(F.col("path")), "line").limit(top)


def fit_budget(found: DataFrame, o: SearchOptions) -> DataFrame:
    """Ranked hits, at most ``per_file`` of a file (all if at most three files match), until their estimated tokens fill the budget (0: all of them, in no order).

    A file's first hit also pays for its header. The running sum is over the capped hits, a few for each file.
    """
    order = [F.round("score", 9).desc(), path_key(F.col("path")), F.col("line")]
    few = found.select("file_id").distinct().limit(4).count() <= 3
    own = Window.partitionBy("file_id").orderBy(*order)
    kept = found.withColumn("place", F.row_number().over(own))
    if not few:
        kept = kept.where(F.col("place") <= o.per_file)
    cost = estimate_tokens(F.substring("text", 1, o.columns)) + 3 + F.when(F.col("place") == 1, estimate_tokens(F.col("path")) + 2).otherwise(0)
    kept = kept.withColumn("cost", cost)
    if not o.budget:
        return kept.withColumn("spent", F.lit(None).cast("long"))
    # only hits that could fit are numbered globally: each costs three tokens at least
    kept = kept.orderBy(*order).limit(max(1, o.budget // 3))
    running = F.sum("cost").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return kept.withColumn("spent", running).where(F.col("spent") <= o.budget)


def by_file(found: DataFrame) -> DataFrame:
    """Per file: matched lines and lines by kind."""
    return found.groupBy("file_id", "path").agg(F.countDistinct("line").alias("total"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in HIT_WEIGHTS])


def demotion(path: str = "path", flags: str = "flags") -> Column:
    """test, vendored, generated, mock, or null for a source file."""
    return F.when(F.col(flags)["test"], "test").when(F.col(flags)["vendored"], "vendored").when(F.expr(f"{flags}.generated or {flags}.minified or {flags}.lockfile"), "generated").when(mock_path(path), "mock")


def facets(found: DataFrame, by: str) -> DataFrame:
    """Hits by kind, lang or flag. Languages under a twentieth of the hits are left out, and all of them if fewer than two remain."""
    if by == "flag":
        return found.withColumn("flag", demotion()).where("flag is not null").groupBy("flag").agg(F.count(F.lit(1)).alias("hits"))
    if by == "kind":
        return found.groupBy("kind").agg(F.count(F.lit(1)).alias("hits"))
    counts = found.groupBy("lang").agg(F.count(F.lit(1)).alias("hits"))
    every = Window.partitionBy(F.lit(1))
    counts = counts.withColumn("all", F.sum("hits").over(every)).where("hits * 20 >= all")
    return counts.withColumn("n", F.count(F.lit(1)).over(every)).where("n >= 2").select("lang", "hits")


def areas(found: DataFrame, rounds: int = 12, top: int = 6) -> DataFrame:
    """Directory prefixes that tell where hits are: from depth 1, the largest prefix not yet tried gives way to its children, while it holds over a fifth of the hits and has two children or more.

    One pass sums hits by directory; each round sums that table again and sends the driver a dozen rows at most. Demoted areas come last.
    """
    dirs = written(found.groupBy(F.regexp_replace("path", "(^|/)[^/]*$", "").alias("dir")).agg(F.count(F.lit(1)).alias("hits")), "areas")
    total = dirs.agg(F.sum("hits").alias("n")).first()["n"] or 0
    split: list[str] = []
    tried: set[str] = set()

    def area() -> Column:
        """Where a directory counts: the deepest split prefix above it and the next name."""
        out = F.substring_index("dir", "/", 1)
        for p in sorted(split, key=len):
            rest = F.substr(F.col("dir"), F.lit(len(p) + 2))
            out = F.when(F.col("dir") == p, F.lit(p)).when(F.startswith("dir", F.lit(p + "/")), F.concat(F.lit(p + "/"), F.substring_index(rest, "/", 1))).otherwise(out)
        return out

    for _ in range(rounds):
        depth = F.size(F.split("area", "/"))
        child = F.when(F.size(F.split("dir", "/")) > depth, F.get(F.split("dir", "/"), depth))
        sums = dirs.withColumn("area", area()).withColumn("child", child).groupBy("area").agg(F.sum("hits").alias("hits"), F.countDistinct("child").alias("children"))
        best = [r for r in sums.orderBy(F.desc("hits"), "area").limit(len(tried) + 1).collect() if r["area"] not in tried][:1]
        if not best or best[0]["hits"] * 5 <= total:
            break
        tried.add(best[0]["area"])
        if best[0]["children"] >= 2:
            split.append(best[0]["area"])
    out = dirs.withColumn("area", area()).groupBy("area").agg(F.sum("hits").alias("hits"))
    aside = out.withColumn("path", F.concat("area", F.lit("/-"))).withColumn("flags", path_flags()).withColumn("aside", demotion().isNotNull())
    return aside.orderBy("aside", F.desc("hits"), "area").limit(top).select("area", "hits")


def related_names(postings: DataFrame, found: DataFrame, word: str, top: int = 4) -> DataFrame:
    """Longer identifiers around the word in matching files, by files."""
    near = postings.join(found.select("file_id").distinct(), "file_id", "left_semi").where(F.contains("word", F.lit(word)) & (F.col("word") != word))
    return near.groupBy("word").agg(F.countDistinct("file_id").alias("files")).orderBy(F.desc("files"), "word").limit(top)


def with_context(files: DataFrame, found: DataFrame, before: int, after: int) -> DataFrame:
    """Lines around hits: each line once, marked if it matched."""
    around = found.select("file_id", "line", F.explode(F.sequence(F.col("line") - before, F.col("line") + after)).alias("at")).groupBy("file_id", F.col("at").alias("line")).agg(F.max(F.col("line") == F.col("at")).alias("matched"))
    return lines(files.join(found.select("file_id").distinct(), "file_id", "left_semi")).join(around, ["file_id", "line"]).select("file_id", "path", "line", "matched", "text")


def best_of_each(found: DataFrame, column: str, values: list[str], order: list, most: int) -> DataFrame:
    """The first ``most`` rows of each of a few values, each by its own top-k, so that no value's rows meet in one task. ``found`` is written, as each value reads it."""
    found = written(found, "best")
    parts = [found.where(F.col(column) == v).orderBy(*order).limit(most) for v in values]
    out = parts[0] if parts else found.where("false")
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def prefer_exact(found: DataFrame) -> DataFrame:
    """If any hit is a whole word, inner matches leave the answer."""
    best = found.agg(F.max("exact").alias("any"))
    return found.crossJoin(F.broadcast(best)).where(F.col("exact") | ~F.col("any")).drop("any")


def ladder(files: DataFrame, o: SearchOptions, symbols: DataFrame | None = None, ignored: DataFrame | None = None) -> tuple[str, DataFrame]:
    """The first rung with hits: exact, no_word, ignore_case, tokens, fuzzy, ignored (a count only), or none."""
    rungs: list[tuple[str, SearchOptions]] = [("exact", o)]
    if o.whole_word:
        rungs.append(("no_word", replace(o, whole_word=False)))
    if not o.ignore_case:
        rungs.append(("ignore_case", replace(o, whole_word=False, ignore_case=True)))
    for name, attempt in rungs:
        found = hits(files, attempt)
        if not found.isEmpty():
            return name, found
    if symbols is not None and isinstance(o.pattern, str) and o.pattern.replace("_", "a").isalnum():
        spark = files.sparkSession
        many = len(spark.range(1).select(split_tokens(F.lit(o.pattern)).alias("t")).first()["t"])
        for name, names in (("tokens", names_with_tokens(symbols, o.pattern) if many >= 2 else None), ("fuzzy", fuzzy_names(symbols, o.pattern) if len(o.pattern) >= 4 else None)):
            known = [r["name"] for r in names.collect()] if names is not None else []  # eight names at most
            if known:
                return name, hits(files, replace(o, pattern=tuple(known), fixed=True, whole_word=True, ignore_case=False))
    if ignored is not None:
        found = matched_lines(ignored.orderBy(path_key(F.col("path"))).limit(200), o)
        if not found.isEmpty():
            return "ignored", found.groupBy("file_id", "path").agg(F.count(F.lit(1)).alias("total"))
    return "none", hits(files, o)


def outcome(found: DataFrame, shown: DataFrame, rung: str) -> DataFrame:
    """One row: total, shown, rung and exit code (0 only if the search itself had hits)."""
    total = found.agg(F.count(F.lit(1)).alias("total"))
    return total.crossJoin(shown.agg(F.count(F.lit(1)).alias("shown"))).withColumn("rung", F.lit(rung)).withColumn("exit", F.when((F.col("total") > 0) & (F.lit(rung) == "exact"), 0).otherwise(1))


def skipped_reached(skipped: DataFrame, o: SearchOptions) -> DataFrame:
    """Entries that a walk left out (path, why) and that a search's globs, languages and paths would reach: by reason."""
    lang = language(F.col("path"))
    files = skipped.select(F.xxhash64("path").alias("file_id"), "path", F.lit("").alias("text"), lang.alias("lang"), "why")
    return selected(files, o).groupBy("why").agg(F.count(F.lit(1)).alias("entries"))


def of_types(files: DataFrame, types: list[str], without: list[str] | None = None) -> DataFrame:
    """Files of the named types and of none of ``without``. A type is a language, a name of FILE_TYPES, or a file extension."""

    def any_of(names: list[str]) -> Column:
        ends = [e for n in names for e in LANGUAGES.get(n) or FILE_TYPES.get(n) or [n]]
        name = F.lower(F.regexp_extract("path", "[^/]*$", 0))
        return F.lower(extension(F.col("path"))).isin(ends) | name.isin([x for n in names for x in FILE_TYPE_NAMES.get(n, [])])

    out = files.where(any_of(types)) if types else files
    return out.where(~any_of(without)) if without else out


def admission(path: str = "path", flags: str = "flags") -> Column:
    """The order in which files are looked at: source 0, demoted 2, minified 3."""
    return F.when(F.col(flags)["minified"], 3).when(demotion(path, flags).isNotNull(), 2).otherwise(0)


def word_around(text: Column, start: Column, end: Column) -> Column:
    """The identifier in which a match lies."""
    before = F.regexp_extract(F.substr(text, F.lit(1), start), r"[A-Za-z0-9_]*$", 0)
    after = F.regexp_extract(F.substr(text, end + 1), r"^[A-Za-z0-9_]*", 0)
    return F.concat(before, F.substr(text, start + 1, end - start), after)


def adaptive_context(files: DataFrame, found: DataFrame, around: int = 20) -> DataFrame:
    """Lines around a definition when it is the only hit of its kind in the answer; else the hits alone."""
    defs = found.where("kind = 'def'").limit(2).collect()
    if len(defs) == 1:
        return with_context(files, found.where("kind = 'def'"), around, around)
    return found.select("file_id", "path", "line", F.lit(True).alias("matched"), "text")


def multiline_hits(files: DataFrame, o: SearchOptions, index: dict[str, DataFrame] | None = None) -> DataFrame:
    """Matches that may go over line ends: file_id, path, line, last_line, start, end (characters of the file) and the text of the match.

    The pattern runs over whole texts; ``.`` stops at a line end unless the pattern says ``(?s)``, ``^`` and ``$`` mean lines.
    """
    pattern = "(?m)" + o.regex()
    held = selected(files, o).where(F.col("text").rlike(pattern))
    if index is not None and not any(c in o.regex() for c in ("\n", "\\n", "\\s", "[^", "(?s")):
        held = held.join(candidates(index, o.patterns, o.fixed, o.fold, o.whole_word), "file_id", "left_semi")
    each = held.select("file_id", "path", "lang", "text", F.explode(places(F.col("text"), pattern)).alias("m"))
    line_of = lambda at: F.length(F.substr(F.col("text"), F.lit(1), at)) - F.length(F.replace(F.substr(F.col("text"), F.lit(1), at), F.lit("\n"), F.lit(""))) + 1
    body = F.substr(F.col("text"), F.col("m.s") + 1, F.col("m.e") - F.col("m.s"))
    return each.select("file_id", "path", "lang", line_of(F.col("m.s")).alias("line"), line_of(F.col("m.e")).alias("last_line"), F.col("m.s").alias("start"), F.col("m.e").alias("end"), body.alias("text"))


def capped(found: DataFrame, per_file: int | None = None, per_line: int | None = None) -> DataFrame:
    """The first ``per_file`` matched lines of each file and the first ``per_line`` places of each line, the one that counts among them."""
    out = found
    if per_line:
        own = F.get("submatches", F.col("primary"))
        out = out.withColumn("submatches", F.when(F.size("submatches") <= per_line, F.col("submatches")).when(F.col("primary") < per_line, F.slice("submatches", 1, per_line)).otherwise(F.array_append(F.slice("submatches", 1, per_line - 1), own)))
    if per_file:
        out = out.withColumn("place", F.row_number().over(Window.partitionBy("file_id").orderBy("line"))).where(F.col("place") <= per_file).drop("place")
    return out


def in_path_order(found: DataFrame):
    """Hits one by one in path order, as many in the driver's memory as one partition holds."""
    return found.orderBy(path_key(F.col("path")), "line").toLocalIterator(prefetchPartitions=True)
