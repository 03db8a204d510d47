"""What a path and the first bytes of a file say about it: language, flags, weight."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from textquarry.functions.text import ascii_lower, extension, parent

# Extensions by language, and those of programming languages that have no extraction rules.
LANGUAGES = {
    "python": ["py", "pyi", "pyw"],
    "rust": ["rs"],
    "javascript": ["js", "mjs", "cjs", "jsx"],
    "typescript": ["ts", "tsx", "mts", "cts"],
    "kotlin": ["kt", "kts"],
    "text": ["md", "txt", "json", "yaml", "yml", "toml", "xml", "html", "css", "scss", "sql", "sh", "bash", "zsh", "ini", "cfg", "conf", "env", "csv", "rst", "proto", "graphql", "gql", "tf", "hcl", "gradle", "properties", "lock"],
}
CODE_WITHOUT_GRAMMAR = ["go", "java", "c", "h", "cc", "cpp", "cxx", "hh", "hpp", "hxx", "cs", "fs", "fsx", "vb", "rb", "php", "swift", "m", "mm", "scala", "sc", "lua", "pl", "pm", "r", "dart", "zig", "ex", "exs", "erl", "hrl", "hs", "clj", "cljs", "cljc", "groovy", "ml", "mli", "nim", "jl", "elm", "cr", "d", "ps1", "f90", "pas"]
# Names of file types beside the languages, by extension and by whole name.
FILE_TYPES = {
    "asm": ["asm", "s"], "c": ["c", "h"], "clojure": ["clj", "cljc", "cljs"], "cpp": ["cpp", "cc", "cxx", "hpp", "hh", "hxx", "h", "inl"], "cs": ["cs"], "css": ["css", "scss"], "csv": ["csv"], "dart": ["dart"], "elixir": ["ex", "exs", "eex", "heex"],
    "erlang": ["erl", "hrl"], "go": ["go"], "graphql": ["graphql", "graphqls"], "groovy": ["groovy", "gradle"], "haskell": ["hs", "lhs"], "html": ["html", "htm", "ejs"], "java": ["java", "jsp", "properties"], "js": ["js", "jsx", "cjs", "mjs", "vue"], "json": ["json"],
    "jupyter": ["ipynb"], "kotlin": ["kt", "kts"], "lua": ["lua"], "markdown": ["md", "markdown", "mdown", "mkd", "mdx"], "md": ["md", "markdown", "mdown", "mkd", "mdx"], "nim": ["nim"], "objc": ["m", "h"], "ocaml": ["ml", "mli"], "perl": ["pl", "pm", "perl"],
    "php": ["php"], "protobuf": ["proto"], "ps": ["ps1", "psd1", "psm1"], "py": ["py", "pyi"], "r": ["r", "rmd"], "rst": ["rst"], "ruby": ["rb", "gemspec"], "scala": ["scala", "sbt"], "sh": ["sh", "bash", "zsh", "ksh"], "sql": ["sql", "psql"], "svelte": ["svelte"],
    "swift": ["swift"], "tex": ["tex", "cls", "bib", "sty"], "tf": ["tf", "tfvars"], "toml": ["toml"], "ts": ["ts", "tsx", "cts", "mts"], "txt": ["txt"], "vue": ["vue"], "xml": ["xml", "xsd", "xsl", "xslt"], "yaml": ["yaml", "yml"], "zig": ["zig"],
}
FILE_TYPE_NAMES = {"docker": ["dockerfile"], "make": ["makefile", "gnumakefile"], "cmake": ["cmakelists.txt"], "ruby": ["gemfile", "rakefile"], "toml": ["cargo.lock"]}
# Directory names (any case), lock files and markers of generated text.
TEST_DIRS = ["test", "tests", "__tests__", "specs", "testing", "testdata", "test_data", "fixtures", "snapshots", "__snapshots__", "e2e", "integration-tests", "mock", "mocks", "__mocks__", "stub", "stubs", "fake", "fakes"]
VENDOR_DIRS = ["vendor", "vendored", "third_party", "thirdparty", "third-party", "node_modules", ".yarn", "bower_components", "site-packages", "_vendor"]
GENERATED_DIRS = ["generated", "__generated__", "_gen", "autogen", "compiled", "dist", ".next", "target", "baselines", "baseline", "golden"]
LOCKFILES = ["package-lock.json", "yarn.lock", "pnpm-lock.yaml", "cargo.lock", "poetry.lock", "uv.lock", "pipfile.lock", "gradle.lockfile", "pixi.lock", "composer.lock", "gemfile.lock", "bun.lockb", "bun.lock", "flake.lock"]
GENERATED_MARKS = ["@generated", "DO NOT EDIT", "Do not edit", "do not edit", "Code generated by", "autogenerated", "auto-generated", "automatically generated", "AUTO-GENERATED", "This file was generated", "This file is generated"]
MOCK_NAMES = ["mock", "mocks", "stub", "stubs", "fake", "fakes"]

FLAGS = ["test", "generated", "vendored", "minified", "lockfile", "binary", "huge"]


def language(path: Column) -> Column:
    """python, rust, javascript, typescript, kotlin, text, or null."""
    out = F.lit(None).cast("string")
    for name, ends in LANGUAGES.items():
        out = F.when(extension(path).isin(ends), F.lit(name)).otherwise(out)
    return out


def has_grammar(lang: Column) -> Column:
    return lang.isNotNull() & (lang != "text")


def code_without_grammar(path: Column) -> Column:
    return ascii_lower(extension(path)).isin(CODE_WITHOUT_GRAMMAR)


_SMALL = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_PARENT = "regexp_replace({0}, '(^|/)[^/]*$', '')"
_NAME = "regexp_extract({0}, '[^/]*$', 0)"
# Names that say test or generated, beside the directories above.
TEST_NAMES = r"^test_|_test\.|\.test\.|\.spec\.|^conftest\.py$"
GENERATED_NAMES = r"(_pb2\.py|\.pb\.go|\.g\.dart|\.g\.cs|\.g\.ts|\.designer\.cs|\.generated\.ts)$"
KOTLIN_TESTS = r"Tests?\.kt$"


def _listed(names: list[str]) -> str:
    return "array(" + ", ".join(f"'{n}'" for n in names) + ")"


def _flags_sql(path: str) -> str:
    """One expression text: the parts of a path are named once, and the parser builds the rest."""
    small = _SMALL.format(path)
    dirs, plain, name = f"split({_PARENT.format(small)}, '/')", _NAME.format(path), _NAME.format(small)
    among = lambda names: f"arrays_overlap({dirs}, {_listed(names)})"
    rules = {
        "test": [among(TEST_DIRS), f"{name} rlike r'{TEST_NAMES}'", f"(array_contains({dirs}, 'spec') and contains({name}, '_spec.'))", f"{plain} rlike r'{KOTLIN_TESTS}'"],
        "generated": [among(GENERATED_DIRS), f"{name} rlike r'{GENERATED_NAMES}'", f"(endswith({name}, '.d.ts') and contains({_PARENT.format(path)}, 'generated'))"],
        "vendored": [among(VENDOR_DIRS)],
        "minified": [f"contains({name}, '.min.')", f"endswith({name}, '.bundle.js')"],
        "lockfile": [f"array_contains({_listed(LOCKFILES)}, {name})"],
    }
    return "named_struct(" + ", ".join(f"'{flag}', ({' or '.join(any_of)})" for flag, any_of in rules.items()) + ")"


def path_flags(path: str = "path") -> Column:
    """struct<test, generated, vendored, minified, lockfile> from the path in the named column alone."""
    return F.expr(_flags_sql(path))


# How much of a text is looked at, and from where on lines are those of a minified file.
HEAD, BINARY_HEAD, MARK_HEAD, HUGE = 65536, 8192, 2048, 4 << 20
LONG_LINE, LONG_AVERAGE, ONE_LINE, MAPPED_AVERAGE, MAP_MARK, CASE_MARK = 1000, 200, 2000, 120, "sourceMappingURL=", "//// ["


def content_flags(text: Column, size: Column) -> Column:
    """struct<binary, huge, minified, generated> from the head of the text."""
    head = F.substring(text, 1, HEAD)
    split = F.split(head, "\n")
    lines, longest = F.size(split) - 1, F.array_max(F.transform(split, F.octet_length))
    average = F.when(lines > 0, F.floor(F.octet_length(head) / lines)).otherwise(F.octet_length(head))
    minified = [(longest > LONG_LINE) & (average > LONG_AVERAGE), (lines == 0) & (F.octet_length(head) > ONE_LINE), (average > MAPPED_AVERAGE) & F.contains(head, F.lit(MAP_MARK))]
    marked = [F.startswith(head, F.lit(CASE_MARK)), *(F.contains(F.substring(text, 1, MARK_HEAD), F.lit(m)) for m in GENERATED_MARKS)]
    text_only = ~F.contains(F.substring(text, 1, BINARY_HEAD), F.lit("\x00"))
    of = lambda rules: text_only & reduce(Column.__or__, rules)
    return F.struct((~text_only).alias("binary"), of([size > HUGE]).alias("huge"), of(minified).alias("minified"), of(marked).alias("generated"))


def _mock_sql(path: str) -> str:
    small = _SMALL.format(path)
    return f"(arrays_overlap(split({_PARENT.format(small)}, '/'), {_listed(MOCK_NAMES)}) or array_contains({_listed(MOCK_NAMES)}, regexp_replace({_NAME.format(small)}, r'\\..*$', '')))"


def mock_path(path: str = "path") -> Column:
    """A directory or a file's stem named mock, stub or fake, or their plurals."""
    return F.expr(_mock_sql(path))


# How much a place counts.
PLACE_WEIGHTS = [(("minified",), 0.1), (("generated", "vendored", "lockfile"), 0.2), (("test",), 0.45)]


def location_weight(path: str = "path", flags: str | None = None, everything: bool = False) -> Column:
    """How much a place counts: minified least, then generated, vendored and lock files, then tests and mocks. ``flags``: the column that holds them, if there is one."""
    if everything:
        return F.lit(1.0)
    held = flags or _flags_sql(path)
    tests = [(" or ".join([f"{held}.{n}" for n in names] + ([_mock_sql(path)] if names == ("test",) else [])), w) for names, w in PLACE_WEIGHTS]
    return F.expr("case " + " ".join(f"when {test} then {w}D" for test, w in tests) + " else 1.0D end")


def near_weight(path: Column, near: list[str]) -> Column:
    """1 in a near directory or below it, 0.85 beside one, else 0.7; 1 for all without any."""
    if not near:
        return F.lit(1.0)
    own = parent(path)
    out = F.lit(0.7)
    for n in near:
        above = n.rpartition("/")[0]
        out = F.greatest(out, F.when((own == n) | own.startswith(n + "/") | (path == n), 1.0).when((parent(own) == above) | (own == above), 0.85).otherwise(0.7))
    return out
