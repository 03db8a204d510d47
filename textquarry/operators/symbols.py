"""Symbol, span and import tables of code files, import resolution and the import graph."""

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textquarry.functions import code
from textquarry.functions.text import parent, split_tokens
from textquarry.sources.scratch import written

# How much a kind of definition counts.
KIND_WEIGHTS = {"class": 1.0, "struct": 1.0, "enum": 1.0, "trait": 1.0, "interface": 1.0, "object": 1.0, "module": 1.0, "function": 0.95, "method": 0.9, "type": 0.85, "macro": 0.85, "constant": 0.7, "variable": 0.6, "field": 0.5, "variant": 0.5, "impl": 0.4, "file": 0.3}

#: What a file's text gives, in rows of one shape: ``part`` says which table a row belongs to.
PARTS = {
    "symbols": ["file_id", "sym_id", "name", "kind", "start", "end", "name_start", "name_end", "line", "parent_id", "chain", "supers", "exported", "test", "doc", "signature"],
    "spans": ["file_id", "start", "end", "kind"],
    "imports": ["file_id", "start", "end", "module", "names", "wildcard"],
}
_ARROW = pa.schema(
    [("part", pa.string()), ("file_id", pa.int64()), ("sym_id", pa.int32()), ("name", pa.string()), ("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("name_start", pa.int32()), ("name_end", pa.int32()), ("line", pa.int32()), ("parent_id", pa.int32())]
    + [("chain", pa.list_(pa.string())), ("supers", pa.list_(pa.string())), ("exported", pa.bool_()), ("test", pa.bool_()), ("doc", pa.bool_()), ("signature", pa.string()), ("module", pa.string()), ("names", pa.list_(pa.string())), ("wildcard", pa.bool_())]
)
FACTS = "part string, file_id long, sym_id int, name string, kind string, start int, end int, name_start int, name_end int, line int, parent_id int, chain array<string>, supers array<string>, exported boolean, test boolean, doc boolean, signature string, module string, names array<string>, wildcard boolean"


def _rows(file_id: int, found: dict, parts: tuple) -> list[dict]:
    out: list[dict] = []
    if "symbols" in parts:
        for k, s in enumerate(found["symbols"]):
            keep = {c: s[c] for c in ("name", "kind", "start", "end", "name_start", "name_end", "line", "chain", "supers", "exported", "test", "doc")}
            out.append({"part": "symbols", "file_id": file_id, "sym_id": k, "parent_id": -1 if s["parent"] is None else s["parent"], "signature": s["head"][:200], **keep})
    if "spans" in parts:
        out += [{"part": "spans", "file_id": file_id, "start": a, "end": b, "kind": kind} for a, b, kind in found["spans"]]
    if "imports" in parts:
        out += [{"part": "imports", "file_id": file_id, **i} for i in found["imports"]]
    return out


def extract(files: DataFrame, parts: tuple = ("symbols", "spans", "imports")) -> DataFrame:
    """The rows of all ``parts`` from one reading of each file (file_id, text, lang); files without rules never reach Python.

    A batch goes on in slices of a thousand rows, whatever one file holds.
    """

    def run(batches):
        for batch in batches:
            held: list[dict] = []
            for file_id, text, lang in zip(*(batch.column(c).to_pylist() for c in ("file_id", "text", "lang")), strict=True):
                held += _rows(file_id, code.extract(text or "", lang, parts), parts)
                while len(held) >= 1000:
                    yield pa.RecordBatch.from_pylist(held[:1000], _ARROW)
                    held = held[1000:]
            if held:
                yield pa.RecordBatch.from_pylist(held, _ARROW)

    known = files.where(F.col("lang").isin(list(code.LANGUAGES)))
    return known.select(F.col("file_id").cast("long").alias("file_id"), "text", "lang").mapInArrow(run, FACTS)


def part(facts: DataFrame, name: str) -> DataFrame:
    """One table of extracted rows."""
    return facts.where(F.col("part") == name).select(*PARTS[name])


def symbols(files: DataFrame) -> DataFrame:
    """Definitions of each file."""
    return part(extract(files, ("symbols",)), "symbols")


def spans(files: DataFrame) -> DataFrame:
    """Comments, strings and docs of each file."""
    return part(extract(files, ("spans",)), "spans")


def imports(files: DataFrame) -> DataFrame:
    """Import statements of each file."""
    return part(extract(files, ("imports",)), "imports")


def name_tokens(syms: DataFrame) -> DataFrame:
    """(name, token): the parts of each distinct name that differ from the name."""
    return syms.select("name").distinct().select("name", F.explode(split_tokens(F.col("name"))).alias("token")).where("token <> name")


@dataclass(frozen=True)
class ResolveContext:
    """What a project says about its imports. ``aliases``: (folder, head, tail, target with one ``*``, whether it holds a star) of compiler paths; ``packages``: name -> folder of workspace
    packages; ``crates``: crate name -> folder; ``roots``: folders that hold Python packages. These are settings of a project, a few rows each."""

    aliases: tuple = ()
    packages: tuple = ()
    crates: tuple = ()
    roots: tuple = ("", "src")


def read_context(files: DataFrame, most: int = 10_000) -> ResolveContext:
    """The context that a tree's own configuration files give. They are read on the driver: more than ``most`` of them are an error, not left out."""
    from textquarry.functions.config import crate_roots, script_aliases, workspace_packages

    rows = files.where(F.col("path").rlike(r"(^|/)(tsconfig[^/]*\.json|jsconfig\.json|package\.json|Cargo\.toml|pyproject\.toml|setup\.(py|cfg))$")).select("path", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} configuration files: resolve project by project")
    held = {r["path"]: r["text"] or "" for r in rows}
    named = lambda *ends: sorted(p for p in held if p.rpartition("/")[2].startswith(ends))
    roots = {""} | {r for p in named("pyproject.toml", "setup.") for r in (p.rpartition("/")[0], "/".join(x for x in (p.rpartition("/")[0], "src") if x))}
    aliases = script_aliases(held.get, [p for p in named("tsconfig", "jsconfig")])
    return ResolveContext(tuple(aliases), tuple(workspace_packages(held.get, named("package.json"))), tuple(crate_roots(held.get, named("Cargo.toml"))), tuple(sorted(roots | {"src"})))


SCRIPT_ENDS = ["", ".ts", ".tsx", ".d.ts", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.d.ts", "/index.js", "/index.jsx", "/index.mjs"]
PYTHON_ENDS = [".py", ".pyi", "/__init__.py", "/__init__.pyi"]
RUST_ENDS = [".rs", "/mod.rs"]


def _under(folder, rest):
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _climbed(folder, steps):
    """The folder so many steps above, the top at most."""
    parts = F.split(folder, "/")
    return F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - steps.cast("int"), F.lit(0))), "/")


def _ended(bases: list, ends: list[str]):
    """Every base that is not null with every end, in order."""
    each = F.array(*[F.lit(e) for e in ends])
    return F.flatten(F.transform(F.array_compact(F.array(*bases)), lambda b: F.transform(each, lambda e: F.concat(b, e))))


def _python_probes(context: ResolveContext):
    """A dotted name as a file or package; then without its last segment, which may be a name in it."""
    up = F.length(F.regexp_extract("module", r"^\.*", 0))
    tail = F.translate(F.regexp_replace("module", r"^\.+", ""), ".", "/")
    here = _climbed(F.col("dir"), F.greatest(up - 1, F.lit(0)))
    bases = [F.when(up > 0, _under(here, F.when(tail == "", F.lit("__init__")).otherwise(tail)))]
    # roots that hold the importing file first, then the folder of the file, then all roots, the longest first
    roots = sorted(context.roots, key=len, reverse=True)
    bases += [F.when((up == 0) & F.startswith(F.col("path"), F.lit(r + "/" if r else "")), _under(F.lit(r), tail)) for r in roots]
    bases += [F.when(up == 0, _under(F.col("dir"), tail))] + [F.when(up == 0, _under(F.lit(r), tail)) for r in roots]
    above = [F.when(F.contains(tail, F.lit("/")), parent(b)) for b in bases]
    return F.concat(_ended(bases, PYTHON_ENDS), _ended(above, PYTHON_ENDS))


def _script_probes(context: ResolveContext):
    """A relative path; else the compiler's alias with the longest head, then a workspace package."""
    step = F.regexp_replace("module", r"^(\./)+", "")
    rise = F.length(F.regexp_extract(step, r"^(\.\./)*", 0)) / 3
    relative = F.when(F.startswith("module", F.lit(".")), F.regexp_replace(_under(_climbed(F.col("dir"), rise), F.regexp_replace(step, r"^(\.\./)+|^\.$", "")), "/$", ""))
    bare = ~F.startswith("module", F.lit(".")) & ~F.startswith("module", F.lit("/")) & ~F.startswith("module", F.lit("node:"))
    bases = [relative]
    for folder, head, tail, target, star in sorted(context.aliases, key=lambda a: (a[4], -len(a[1]))):
        inside = bare & F.startswith(F.col("path"), F.lit(folder + "/" if folder else ""))
        if star:
            middle = F.substr(F.col("module"), F.lit(len(head) + 1), F.length("module") - len(head) - len(tail))
            said = inside & F.startswith("module", F.lit(head)) & F.endswith("module", F.lit(tail)) & (F.length("module") >= len(head) + len(tail))
            bases.append(F.when(said, F.replace(F.lit(target), F.lit("*"), middle)))
        else:
            bases.append(F.when(inside & (F.col("module") == head), F.lit(target)))
    for name, folder in context.packages:
        rest = F.substr(F.col("module"), F.lit(len(name) + 2))
        bases.append(F.when(bare & (F.col("module") == name), F.lit(folder)).when(bare & F.startswith("module", F.lit(name + "/")), F.concat(F.lit(folder + "/"), rest)))
    bases += [F.when(bare & (F.col("module") == name), F.lit(folder + "/src")) for name, folder in context.packages]
    return _ended(bases, SCRIPT_ENDS)


def _rust_probes(context: ResolveContext):
    """``crate`` and crate names from a source root, ``self`` and ``super`` from the file's own module, anything else beside the file; the last segment may be a name in the module."""
    path, stem = F.col("path"), F.regexp_extract("path", r"([^/]*)\.rs$", 1)
    own = F.when(stem.isin("mod", "lib", "main"), F.col("dir")).otherwise(_under(F.col("dir"), stem))
    words = F.split("module", "::")
    head = F.get(words, F.lit(0))
    ups = F.size(F.filter(words, lambda w: w == "super"))
    rest = F.array_join(F.filter(words, lambda w: ~w.isin("crate", "self", "super")), "/")
    after = F.array_join(F.slice(words, 2, 64), "/")
    root = F.regexp_replace(path, r"^(.*/)?src/.*$|^.*$", "$1src")
    bases = [F.when(head == "crate", F.when(rest == "", root).otherwise(F.concat(root, F.lit("/"), rest))), F.when(head.isin("self", "super"), F.when(rest == "", _climbed(own, ups)).otherwise(_under(_climbed(own, ups), rest)))]
    bases += [F.when(head == name, F.when(after == "", F.lit(folder)).otherwise(F.concat(F.lit(folder + "/"), after))) for name, folder in context.crates]
    beside = F.when(~head.isin("crate", "self", "super"), _under(F.col("dir"), F.replace("module", F.lit("::"), F.lit("/"))))
    tops = F.concat(_ended([*bases, beside], RUST_ENDS), _ended([parent(b) for b in (*bases, beside)], RUST_ENDS))
    return F.concat(tops, _ended([bases[0], *bases[2:]], ["/lib.rs", "/main.rs"]))


def _kotlin_probes(context: ResolveContext):
    """A class as a file of its package under the importing file's source root; then without trailing segments."""
    root = F.regexp_extract("path", r"^((?:.*/)?(?:src/main/kotlin|src/commonMain/kotlin|src)/)", 1)
    whole = F.translate("module", ".", "/")
    return _ended([F.concat(root, b) for b in (whole, parent(whole), parent(parent(whole)))], [".kt"])


def probes(found: DataFrame, files: DataFrame, context: ResolveContext = ResolveContext()) -> DataFrame:
    """(file_id, start, module, turn, probe): the paths an import may mean, in order of preference."""
    base = found.select("file_id", "start", "module").join(files.select("file_id", "path", "lang"), "file_id").withColumn("dir", parent(F.col("path")))
    by = {"python": _python_probes, "rust": _rust_probes, "kotlin": _kotlin_probes}
    each = F.when(F.col("lang").isin("javascript", "typescript"), _script_probes(context))
    for lang, of in by.items():
        each = each.when(F.col("lang") == lang, of(context))
    return base.select("file_id", "start", "module", F.posexplode(F.transform(F.array_distinct(each), lambda p: F.ltrim(p, F.lit("/")))).alias("turn", "probe"))


def resolve(found: DataFrame, files: DataFrame, context: ResolveContext = ResolveContext()) -> DataFrame:
    """(file_id, module, names, target): the file an import reaches, the best of its candidate paths that exists; null if none does."""
    hit = probes(found, files, context).join(files.select(F.col("file_id").alias("target"), F.col("path").alias("probe")), "probe")
    best = hit.groupBy("file_id", "start", "module").agg(F.min(F.struct("turn", "target")).alias("best"))
    return found.join(best, ["file_id", "start", "module"], "left").select("file_id", "module", "names", F.col("best.target").alias("target"))


def edges(resolved: DataFrame) -> DataFrame:
    """(src, dst, weight): ten for each imported name, ten at least; edges of one pair add up, loops are dropped."""
    live = resolved.where("target is not null and target <> file_id")
    return live.groupBy(F.col("file_id").alias("src"), F.col("target").alias("dst")).agg(F.sum(F.greatest(F.size("names"), F.lit(1)) * 10).cast("long").alias("weight"))


def package_edges(files: DataFrame, package: str, most: int = 30) -> DataFrame:
    """Weight 1 between files of one package of at most ``most`` files (larger packages say nothing about their files)."""
    small = files.groupBy(package).agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, most))
    a = files.join(small, package).select(package, F.col("file_id").alias("src"))
    b = files.join(small, package).select(package, F.col("file_id").alias("dst"))
    return a.join(b, package).where("src <> dst").select("src", "dst", F.lit(1).cast("long").alias("weight"))


def pagerank(nodes: DataFrame, graph: DataFrame, rounds: int = 20, damping: float = 0.85) -> DataFrame:
    """(file_id, rank), the largest 1. Mass follows edge weights; files without imports spread theirs evenly.

    Only a file that imports passes mass on, so the rounds before the last hold the ranks of those files alone and follow the
    imports among them; shares stay partitioned by their source and sorted meanwhile. The last round follows every import to every file.
    Ranks are written after each round (they are read twice), where the lineage ends.
    """
    base, graph = written(nodes.select("file_id"), "nodes"), written(graph.select("src", "dst", "weight"), "edges")
    total = base.count()
    if total == 0 or rounds == 0:
        return base.select("file_id", F.lit(1.0).alias("rank"))
    givers = written(base.join(graph.groupBy(F.col("src").alias("file_id")).agg(F.sum("weight").alias("out")), "file_id"), "givers")
    among = graph.join(givers.select(F.col("file_id").alias("dst")).distinct(), "dst", "left_semi").join(givers.select(F.col("file_id").alias("src"), "out").distinct(), "src")
    share = among.select("src", "dst", (F.col("weight") / F.col("out")).alias("share")).repartition("src").sortWithinPartitions("src").persist()
    rank = givers.select("file_id", "out", F.lit(1.0 / total).alias("rank"))
    for k in range(rounds):
        # ranks sum to 1, so files without imports hold what the others do not
        loose = 1.0 - (rank.agg(F.sum("rank")).first()[0] or 0.0)
        if k < rounds - 1:
            to, given = givers, share.join(rank.select(F.col("file_id").alias("src"), "rank"), "src")
        else:
            to, given = base, graph.join(rank.withColumnRenamed("file_id", "src"), "src").withColumn("share", F.col("weight") / F.col("out"))
        got = given.groupBy(F.col("dst").alias("file_id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        each = F.lit((1 - damping) / total + damping * loose / total) + F.lit(damping) * F.coalesce("got", F.lit(0.0))
        rank = written(to.join(got, "file_id", "left").select(*to.columns, each.alias("rank")), "ranked")
    share.unpersist()
    top = rank.agg(F.max("rank").alias("top"))
    return rank.crossJoin(F.broadcast(top)).select("file_id", (F.col("rank") / F.col("top")).alias("rank"))


def overlapping(points: DataFrame, intervals: DataFrame, keep: bool = False, block: int = 4096) -> DataFrame:
    """Pairs of points (file_id, from, to and more) and intervals (in_file, start, end and more) of one file that share a character.

    Both sides are dealt to blocks of characters, and pairs meet by file and block: no file's hits meet all of its spans.
    ``keep``: points without an interval stay, and a pair that shares several blocks comes once for each.
    """
    of = lambda a, b: F.sequence(F.floor(F.col(a) / block), F.greatest(F.floor((F.col(b) - 1) / block), F.floor(F.col(a) / block)))
    p = points.withColumn("block", F.explode(of("from", "to")))
    s = intervals.withColumn("in_block", F.explode(of("start", "end")))
    same = (F.col("file_id") == F.col("in_file")) & (F.col("block") == F.col("in_block")) & (F.col("start") < F.col("to")) & (F.col("end") > F.col("from"))
    if not keep:
        same = same & (F.col("block") == F.floor(F.greatest("start", "from") / block))
    return p.join(s.hint("merge"), same, "left" if keep else "inner").drop("block", "in_block", "in_file")


def enclosing(points: DataFrame, syms: DataFrame, key: list[str]) -> DataFrame:
    """``points`` (file_id, offset and more) with the innermost symbol around each, the one that starts last; ``key`` names a point."""
    s = syms.select(F.col("file_id").alias("in_file"), "start", "end", F.struct("sym_id", "name", "kind", "line", "chain").alias("symbol"))
    at = points.select("file_id", *[c for c in key if c != "file_id"], F.col("offset").alias("from"), (F.col("offset") + 1).alias("to")).distinct()
    best = overlapping(at, s).groupBy(*key).agg(F.min_by("symbol", F.struct(-F.col("start"), "end")).alias("symbol"))
    return points.join(best, key, "left")


def best_named(syms: DataFrame, ranks: DataFrame, name: str) -> DataFrame:
    """Symbols of a name, best first: kind x exported x test x (0.6 + 0.4 rank)."""
    weights = F.create_map(*[F.lit(x) for kv in KIND_WEIGHTS.items() for x in kv])
    found = syms.where(F.col("name") == name).join(ranks, "file_id", "left")
    score = F.coalesce(F.element_at(weights, F.col("kind")), F.lit(0.5)) * F.when(F.col("exported"), 1.0).otherwise(0.8) * F.when(F.col("test"), 0.5).otherwise(1.0) * (0.6 + 0.4 * F.coalesce("rank", F.lit(0.5)))
    return found.withColumn("order_score", score).orderBy(F.round("order_score", 9).desc(), "file_id", "line")


def quantized(rank):
    """A rank in 65,535 steps; unknown reads one half."""
    return F.coalesce(F.round(rank * 65534) / 65534, F.lit(0.5))


def origin_ids(files: DataFrame, paths: list[str]) -> DataFrame:
    """Ids of the named files."""
    return files.where(F.col("path").isin([p.removeprefix("./") for p in paths])).select("file_id")


def documentation(files: DataFrame, syms: DataFrame, doc_spans: DataFrame, most: int = 120) -> DataFrame:
    """(file_id, sym_id, doc): the first line of the docstring or comment that belongs to a symbol."""
    d = doc_spans.where("kind = 'doc'").select("file_id", F.col("start").alias("d_start"), F.col("end").alias("d_end"))
    near = syms.select("file_id", "sym_id", "start", "end", "name_end").join(d, "file_id").where("(d_start > name_end and d_start < end and d_start - name_end < 200) or (d_end <= start and start - d_end < 3)")
    first = near.groupBy("file_id", "sym_id").agg(F.min(F.struct("d_start", "d_end")).alias("d"))
    text = F.substr(F.col("text"), F.col("d.d_start") + 1, F.col("d.d_end") - F.col("d.d_start"))
    bare = F.trim(F.regexp_replace(F.regexp_replace(text, r"^([rRuU]?[\"']{3}|///?!?|/\*\*?!?)\s*", ""), r"\s*([\"']{3}|\*/)\s*$", ""))
    return first.join(files.select("file_id", "text"), "file_id").select("file_id", "sym_id", F.substring(F.substring_index(bare, "\n", 1), 1, most).alias("doc"))
