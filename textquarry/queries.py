"""Named queries over the bench tables, with the DuckDB SQL that gives the same rows."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textquarry.functions.text import ascii_lower, file_name, parent, pieces, split_tokens
from textquarry.operators import changes, find, impact, index, report, search, symbols, usage, verbs
from textquarry.operators.search import SearchOptions
from textquarry.sources import files as src
from textquarry.sources import scratch, sinks
from textquarry.streaming import refresh

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- SQL building blocks -------------------------------------------------------------------------------------------
DOCS = """docs as (select doc_id as file_id, concat(case when doc_id % 10 = 0 then 'tests/' when doc_id % 10 = 1 then 'vendor/' else 'src/' end, source, '/', lang, '/doc_', doc_id::varchar, '.txt') as path, text from documents)"""
LINES = """lines as (select file_id, path, unnest(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) as line_text, unnest(range(1, len(string_split(regexp_replace(text, '\\n\\z', ''), chr(10))) + 1))::int as line from docs where text <> '')"""
WORDS = """words as (select distinct file_id, w as word from (select file_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as w from docs) where length(w) between 2 and 64)"""
EDGE = "(^|[^\\p{L}\\p{M}\\p{N}_])"
WEIGHT = "case when path like 'tests/%' then 0.45 when path like 'vendor/%' then 0.2 else 1.0 end"
PARTS = """parts as (select p_partkey as file_id, concat('src/', lower(replace(p_brand, '#', '_')), '/part_', p_partkey::varchar, '.py') as path, 'Part' || p_partkey::varchar as class_name, 'part_' || p_partkey::varchar as method_name, 'Base' || p_size::varchar as base_name, 'helper_' || (p_size % 7)::varchar as call_name, p_partkey, p_size, p_brand from part)"""
CUT_SQL = "list_filter(regexp_split_to_array(regexp_replace(regexp_replace({0}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '([A-Z])([A-Z][a-z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+'), lambda p: length(p) >= 3)"
EDGES = "edges as (select l_suppkey as src, l_partkey + 1000000 as dst, 10 * count(*) as weight from lineitem group by 1, 2)"


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return src.documents_as_files(spark, d)


def _search(pattern, **how) -> SearchOptions:
    """Options of a search over whole tables: files of any size."""
    return SearchOptions(pattern, max_filesize=(1 << 63) - 1, **how)


def _code(spark: SparkSession, d: str) -> DataFrame:
    return src.parts_as_code(spark, d)


_indexes: dict[tuple, str] = {}


def _published(spark: SparkSession, d: str, name: str, files) -> dict:
    """The tables of an index of ``files``, published once a session in the shared folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _indexes:
        path = scratch.new_path(spark, f"index-{name}")
        index.publish(files(spark, d), path, 1)
        _indexes[key] = path
    return index.open_index(spark, _indexes[key])


# ---- text search ---------------------------------------------------------------------------------------------------
@query(f"with {DOCS}, {LINES} select path, line, line_text as text from lines where regexp_matches(line_text, '{EDGE}that($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')")
def search_whole_word(spark, d):
    """Lines that hold a word, with Unicode boundaries."""
    return search.matched_lines(_docs(spark, d), _search("that", fixed=True, whole_word=True)).select("path", "line", "text")


@query(f"with {DOCS}, {LINES} select path, line, len(regexp_extract_all(line_text, '[a-z]+tion[a-z]*ing'))::int as matches from lines where regexp_matches(line_text, '[a-z]+tion[a-z]*ing')")
def search_regex(spark, d):
    """Lines that match a regular expression and how often."""
    found = search.matched_lines(_docs(spark, d), _search("[a-z]+tion[a-z]*ing"))
    return found.select("path", "line", F.size(search.places(F.col("text"), "[a-z]+tion[a-z]*ing")).alias("matches"))


@query(f"with {DOCS}, {LINES} select path, line from lines where contains(lower(line_text), 'license')")
def search_ignore_case(spark, d):
    return search.matched_lines(_docs(spark, d), _search("license", fixed=True, ignore_case=True)).select("path", "line")


@query(f"with {DOCS}, {LINES} select path, count(*)::bigint as lines from lines where regexp_matches(line_text, 'tion|ment') group by path")
def search_counts(spark, d):
    """Matched lines by file, for a pattern list."""
    return sinks.counts(search.matched_lines(_docs(spark, d), _search(("tion", "ment"))))


@query(f"with {DOCS} select path from docs where contains(text, 'Version 2.0')")
def search_paths(spark, d):
    return sinks.paths(search.matched_lines(_docs(spark, d), _search("Version 2.0", fixed=True)))


@query(f"with {DOCS}, {LINES} select path, count(*)::bigint as lines from lines where not contains(line_text, 'e') group by path")
def search_invert(spark, d):
    return sinks.counts(search.matched_lines(_docs(spark, d), _search("e", fixed=True, invert=True)))


@query(f"with {DOCS}, {LINES} select path, line from lines where contains(line_text, 'oreth') and path like 'src/src1%' and path not like '%/de/%'")
def search_globs(spark, d):
    return search.matched_lines(_docs(spark, d), _search("oreth", fixed=True, globs=("src/src1*/**", "!**/de/**"))).select("path", "line")


@query(f"with {DOCS}, {LINES} select path, line from lines where contains(line_text, 'the') and path like 'src/%'")
def search_without_tests(spark, d):
    return search.matched_lines(_docs(spark, d), _search("the", fixed=True, no_tests=True, no_vendored=True)).select("path", "line")


@query(f"with {DOCS}, {LINES}, m as (select file_id, path, line from lines where contains(line_text, 'Version 2.0')) select distinct l.path, l.line, exists(select 1 from m m2 where m2.file_id = l.file_id and m2.line = l.line) as matched from lines l join m on m.file_id = l.file_id and l.line between m.line - 1 and m.line + 1")
def search_context(spark, d):
    """Lines around hits."""
    files = _docs(spark, d)
    found = search.matched_lines(files, _search("Version 2.0", fixed=True))
    return search.with_context(files, found, 1, 1).select("path", "line", "matched")


@query(f"with {DOCS}, {LINES} select path, line from lines where contains(line_text, 'Apache License')")
def search_indexed(spark, d):
    """The same search answered by key postings: candidates, then verification."""
    files = _docs(spark, d)
    tables = {"files": files, "words": index.word_postings(files), "grams": index.gram_postings(files)}
    return search.matched_lines(files, _search("Apache License", fixed=True), tables).select("path", "line")


@query(f"with {DOCS}, {WORDS} select file_id from words where word = 'stupid'")
def index_word_candidates(spark, d):
    files = _docs(spark, d)
    return index.candidates({"files": files, "words": index.word_postings(files)}, "stupid", fixed=True, whole_word=True)


@query(f"with {DOCS} select file_id from docs where (contains(lower(text), 'apa') and contains(lower(text), 'pac') and contains(lower(text), 'ach') and contains(lower(text), 'che')) or (contains(lower(text), 'gnu') and contains(lower(text), 'nu '))")
def index_gram_candidates(spark, d):
    """Candidates of an alternation: a conjunction of keys for each branch."""
    files = _docs(spark, d)
    return index.candidates({"files": files, "grams": index.gram_postings(files)}, "Apache|GNU ")


@query(f"with {DOCS}, {WORDS} select word, count(*)::bigint as files from words group by word")
def index_words(spark, d):
    return index.word_postings(_docs(spark, d)).groupBy("word").agg(F.count(F.lit(1)).alias("files"))


@query(
    f"with {DOCS}, g as (select distinct file_id, unnest(list_transform(range(1, greatest(length(l) - 1, 1)), lambda i: substr(l, i::int, 3))) as gram from (select file_id, unnest(string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), chr(10))) as l from docs)) select unicode(substr(gram, 1, 1))::bigint * 4398046511104 + unicode(substr(gram, 2, 1))::bigint * 2097152 + unicode(substr(gram, 3, 1))::bigint as gram, count(*)::bigint as files from g group by 1"
)
def index_grams(spark, d):
    return index.gram_postings(_docs(spark, d)).groupBy("gram").agg(F.count(F.lit(1)).alias("files"))


@query(f"with {DOCS}, {WORDS} select word, count(*)::bigint as files from words where contains(word, 'tionth') and length(word) > 6 group by word order by files desc, word limit 10")
def index_words_containing(spark, d):
    return index.words_containing(index.word_postings(_docs(spark, d)), "tionth")


@query(f"with {DOCS}, {LINES} select path, line, round(0.4 * 0.8 * {WEIGHT} * 1.15, 6)::double as score from lines where regexp_matches(line_text, '{EDGE}worthless($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')")
def search_scores(spark, d):
    """Scores of whole-word hits: kind weight, place and exactness."""
    found = search.hits(_docs(spark, d), _search("worthless", fixed=True, whole_word=True))
    return found.select("path", "line", F.round("score", 6).alias("score"))


@query(
    f"with {DOCS}, {LINES} select path, line, round(0.4 * 0.8 * {WEIGHT} * case when regexp_matches(line_text, '{EDGE}tion($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') then 1.15 else 1.0 end, 6)::double as score from lines where contains(line_text, 'tion') order by score desc, replace(path, '/', chr(1)), line limit 25"
)
def search_top(spark, d):
    """The best hits: score, then path name by name, then line."""
    found = search.hits(_docs(spark, d), _search("tion", fixed=True))
    return search.ranked(found, 25).select("path", "line", F.round("score", 6).alias("score"))


@query()
def search_budget(spark, d):
    """What a budget of 2,000 estimated tokens shows."""
    found = search.hits(_docs(spark, d), _search("idiot", fixed=True))
    return search.fit_budget(found, _search("idiot")).select("path", "line", "cost", "spent")


@query(f"with {DOCS}, {LINES} select case when path like 'tests/%' then 'test' else 'vendored' end as flag, count(*)::bigint as hits from lines where contains(line_text, 'the') and path not like 'src/%' group by 1")
def facet_flags(spark, d):
    return search.facets(search.hits(_docs(spark, d), _search("the", fixed=True)), "flag")


AREAS = """h as (select regexp_replace(path, '/[^/]*$', '') as dir, count(*) as n from lines where contains(line_text, 'the') group by 1), t as (select sum(n) as t from h),
    p1 as (select split_part(dir, '/', 1) as a, sum(n) as n from h group by 1), s1 as (select a from p1, t where n * 5 > t),
    p2 as (select split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) as a, sum(n) as n from h where split_part(dir, '/', 1) in (from s1) group by 1), s2 as (select a from p2, t where n * 5 > t),
    g as (select case when split_part(dir, '/', 1) not in (from s1) then split_part(dir, '/', 1) when split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) not in (from s2) then split_part(dir, '/', 1) || '/' || split_part(dir, '/', 2) else dir end as area, sum(n)::bigint as hits from h group by 1)"""


@query(f"with {DOCS}, {LINES}, {AREAS} select area, hits from g order by area like 'tests%' or area like 'vendor%', hits desc, area limit 6")
def facet_areas(spark, d):
    """Where the hits are: prefixes with over a fifth of them give way to their children."""
    return search.areas(search.matched_lines(_docs(spark, d), _search("the", fixed=True)))


@query(f"with {DOCS}, {WORDS} select word, count(distinct file_id)::bigint as files from words where contains(word, 'tionth') and word <> 'tionth' and file_id in (select file_id from docs where contains(text, 'tionth')) group by word order by files desc, word limit 4")
def related_names(spark, d):
    files = _docs(spark, d)
    return search.related_names(index.word_postings(files), search.matched_lines(files, _search("tionth", fixed=True)), "tionth")


@query(f"with {DOCS}, {LINES} select 'ignore_case' as rung, count(*)::bigint as hits from lines where contains(lower(line_text), 'version 2.0')")
def search_ladder(spark, d):
    """The first rung of the ladder with hits."""
    rung, found = search.ladder(_docs(spark, d), _search("VERSION 2.0", fixed=True))
    return found.agg(F.count(F.lit(1)).alias("hits")).withColumn("rung", F.lit(rung))


HITS_JSON = f"""j as (select path, line, line_text, string_split(line_text, 'Version 2.0') as p, 0.4 * 0.8 * {WEIGHT} * case when regexp_matches(line_text, '{EDGE}Version 2\\.0($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') then 1.15 else 1.0 end as score from lines where contains(line_text, 'Version 2.0'))"""


@query(
    f"""with {DOCS}, {LINES}, {HITS_JSON} select '{{"type":"hit","path":' || to_json(path)::varchar || ',"line":' || line || ',"kind":"ident","score":' || round(score, 6)::double || ',"text":' || to_json(line_text)::varchar || ',"submatches":[' ||
    array_to_string(list_transform(range(1, len(p)), lambda i: '{{"start":' || (list_sum(list_transform(p[1:i], lambda x: octet_length(encode(x)))) + 11 * (i - 1))::bigint || ',"end":' || (list_sum(list_transform(p[1:i], lambda x: octet_length(encode(x)))) + 11 * i)::bigint || '}}'), ',') || ']}}' as value from j"""
)
def search_json(spark, d):
    """Hits as JSON records with byte offsets."""
    return sinks.json_records(search.hits(_docs(spark, d), _search("Version 2.0", fixed=True)))


@query(
    f"""with {DOCS}, {LINES}, {HITS_JSON}, f as (select path, count(*) as n from j group by path)
    select '{{"type":"begin","data":{{"path":' || to_json(path)::varchar || '}}}}' as value from f
    union all select '{{"type":"match","data":{{"path":' || to_json(path)::varchar || ',"line_number":' || line || ',"lines":' || to_json(line_text)::varchar || ',"submatches":[' ||
    array_to_string(list_transform(range(1, len(p)), lambda i: '{{"s":' || (list_sum(list_transform(p[1:i], lambda x: length(x))) + 11 * (i - 1))::bigint || ',"e":' || (list_sum(list_transform(p[1:i], lambda x: length(x))) + 11 * i)::bigint || '}}'), ',') || ']}}}}' from j
    union all select '{{"type":"end","data":{{"path":' || to_json(path)::varchar || ',"matched_lines":' || n || '}}}}' from f
    union all select '{{"type":"summary","data":{{"searches_with_match":' || count(*) || ',"matched_lines":' || coalesce(sum(n), 0)::bigint || '}}}}' from f"""
)
def search_events(spark, d):
    """Hits as a begin, match, end and summary stream."""
    return sinks.event_records(search.hits(_docs(spark, d), _search("Version 2.0", fixed=True)))


@query(f"with {DOCS} select file_id, path, octet_length(encode(text))::bigint as size, path like 'tests/%' as is_test, path like 'vendor/%' as is_vendored from docs")
def file_table(spark, d):
    f = src.describe(_docs(spark, d))
    return f.select("file_id", "path", "size", F.col("flags.test").alias("is_test"), F.col("flags.vendored").alias("is_vendored"))


@query("select concat('web/', regexp_replace(url, '^https?://', ''), '.html') as path, len(string_split(html, chr(10)))::int as lines from pages where contains(html, '<script')")
def page_files(spark, d):
    f = src.pages_as_files(spark, d).where(F.contains("text", F.lit("<script")))
    return f.select("path", F.size(F.split("text", "\n")).alias("lines"))


# ---- plain-word ranking --------------------------------------------------------------------------------------------
@query(
    f"""with {DOCS}, {WORDS},
    pc as (select distinct file_id, word, lower(p) as piece from (select file_id, word, unnest({CUT_SQL.format('word')}) as p from words)),
    tf as (select piece, file_id, count(*)::double as tf from pc where piece in ('moron', 'apache', 'license', 'tests') group by 1, 2),
    pt as (select distinct file_id, lower(p) as piece, 1.0 as in_path from (select file_id, unnest({CUT_SQL.format('path')}) as p from docs) where lower(p) in ('moron', 'apache', 'license', 'tests')),
    b as (select coalesce(tf.piece, pt.piece) as piece, coalesce(tf.file_id, pt.file_id) as file_id, coalesce(tf, 0.0) as tf, coalesce(in_path, 0.0) as in_path from tf full join pt on tf.piece = pt.piece and tf.file_id = pt.file_id),
    df as (select piece, count(*) as df from b group by piece),
    st as (select count(*) as n, avg(octet_length(encode(text))) as a from docs)
    select d.path, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * octet_length(encode(d.text)) / a)) + 3 * in_path)) * {WEIGHT.replace('path', 'd.path')}, 6) as score
    from b join df using (piece) join docs d using (file_id), st group by d.path order by round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * octet_length(encode(d.text)) / a)) + 3 * in_path)) * {WEIGHT.replace('path', 'd.path')}, 9) desc, replace(d.path, '/', chr(1)) limit 50"""
)
def find_files(spark, d):
    """BM25 over the pieces of indexed words, with weight for the path."""
    files = _docs(spark, d)
    question = "how do the tests handle moron and the Apache license"
    found = find.find(files, find.piece_postings(index.word_postings(files), find.query_terms(question)), question)
    return found.select("path", F.round("score", 6).alias("score"))


@query(f"with {DOCS}, {WORDS} select piece, count(*)::bigint as n from (select file_id, word, unnest(list_distinct(list_transform({CUT_SQL.format('word')}, lambda p: lower(p)))) as piece from words) group by piece")
def word_pieces(spark, d):
    p = index.word_postings(_docs(spark, d)).select(F.explode(F.array_distinct(pieces(F.col("word")))).alias("piece"))
    return p.groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


# ---- symbols -------------------------------------------------------------------------------------------------------
@query(f"with {PARTS} select file_id, class_name as name, 'class' as kind, 3 as line, [base_name] as supers from parts union all select file_id, method_name, 'method', 4, [] from parts")
def symbol_table(spark, d):
    return symbols.symbols(_code(spark, d)).select("file_id", "name", "kind", "line", "supers")


@query(f"with {PARTS} select file_id, 'comment' as kind, (length('from base import ' || base_name) + 1)::int as start from parts")
def span_table(spark, d):
    return symbols.spans(_code(spark, d)).select("file_id", "kind", "start")


@query(f"with {PARTS} select file_id, 'base' as module, [base_name] as names from parts")
def import_table(spark, d):
    return symbols.imports(_code(spark, d)).select("file_id", "module", "names")


@query(f"with {PARTS} select path, 3 as line, 'class' as kind, round(0.8 * 0.6, 6)::double as score from parts where class_name = 'Part42'")
def verb_def(spark, d):
    files = _code(spark, d)
    return verbs.definitions(files, symbols.symbols(files), "Part42").select("path", "line", "kind", F.round("score", 6).alias("score"))


@query(f"with {PARTS} select path, 2 as line, 'comment' as kind from parts where p_partkey = 42 union all select path, 4, 'def' from parts where p_partkey = 42")
def verb_refs(spark, d):
    files = _code(spark, d)
    return verbs.references(files, "part_42", symbols.spans(files), symbols.symbols(files)).select("path", "line", "kind")


@query(f"with {PARTS} select path, method_name as symbol, 1::bigint as calls, [5] as lines, round(0.8, 6)::double as score from parts where call_name = 'helper_3'")
def verb_callers(spark, d):
    files = _code(spark, d)
    return verbs.callers(files, "helper_3", symbols.spans(files), symbols.symbols(files)).select("path", "symbol", "calls", "lines", F.round("score", 6).alias("score"))


@query(f"with {PARTS} select path, 3 as line, class_name as name, round(0.8, 6)::double as score from parts where base_name = 'Base7' order by replace(path, '/', chr(1)) limit 200")
def verb_impls(spark, d):
    files = _code(spark, d)
    return verbs.implementations(files, symbols.symbols(files), "Base7").select("path", "line", "name", F.round("score", 6).alias("score"))


@query(f"with {PARTS} select path, 2::bigint as uses, 'possible' as grade from parts where base_name = 'Base7'")
def verb_impact(spark, d):
    files = _code(spark, d)
    s = symbols.symbols(files)
    e = symbols.edges(symbols.resolve(symbols.imports(files), files))
    return verbs.impact(files, "Base7", symbols.spans(files), s, e).select("path", "uses", "grade")


@query("select 0 as depth, 'class' as kind, 'Part7' as name, 3 as line union all select 1, 'method', 'part_7', 4")
def verb_outline(spark, d):
    return verbs.outline(symbols.symbols(_code(spark, d)), 7).select("depth", "kind", "name", "line")


@query("select 4 as line, '    def part_7(self):' as text union all select 5, concat('        return helper_', (p_size % 7)::varchar, '(self)') from part where p_partkey = 7")
def verb_show(spark, d):
    files = _code(spark, d)
    return verbs.show(files, symbols.symbols(files), 7, 5)


@query(f"with {PARTS} select lower(replace(p_brand, '#', '_')) as dir, count(*)::bigint as files, 2 * count(*)::bigint as symbols from parts group by 1")
def verb_map(spark, d):
    files = _code(spark, d)
    return verbs.map_directories(files, symbols.symbols(files), files.select("file_id", F.lit(1.0).alias("rank")), "src").select("dir", "files", F.col("symbols").cast("long").alias("symbols"))


@query(f"with {PARTS} select name, unnest(list_distinct(list_transform({CUT_SQL.format('name')}, lambda p: lower(p)))) as token from (select distinct class_name as name from parts union select distinct method_name from parts)")
def symbol_tokens(spark, d):
    """Parts of every defined name (the name itself included)."""
    s = symbols.symbols(_code(spark, d)).select("name").distinct()
    return s.select("name", F.explode(split_tokens(F.col("name"))).alias("token"))


@query(f"with {PARTS}, n as (select class_name as name from parts union select method_name from parts) select name, levenshtein(name, 'Part10x')::int as distance from n where levenshtein(name, 'Part10x') = 1 order by distance, name limit 6")
def symbol_fuzzy(spark, d):
    return index.fuzzy_names(symbols.symbols(_code(spark, d)), "Part10x")


@query(f"with {PARTS}, n as (select class_name as name from parts union select method_name from parts) select name from n where starts_with(name, 'Part19')")
def symbol_prefix(spark, d):
    return index.prefix_names(symbols.symbols(_code(spark, d)), "Part19")


@query(f"with {PARTS} select class_name as name from parts where lower(class_name) = 'part19'")
def symbol_case_variants(spark, d):
    return index.case_variants(symbols.symbols(_code(spark, d)), "PART19")


# ---- graph ---------------------------------------------------------------------------------------------------------
def _graph(spark, d):
    lines = spark.read.parquet(f"{d}/lineitem.parquet")
    edges = lines.groupBy(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + 1_000_000).alias("dst")).agg((F.count(F.lit(1)) * 10).alias("weight"))
    nodes = lines.select(F.col("l_suppkey").alias("file_id")).union(lines.select(F.col("l_partkey") + 1_000_000)).distinct()
    return nodes, edges


def _pagerank_sql(rounds: int) -> str:
    steps = [f"with {EDGES}", "nodes as (select src as id from edges union select dst from edges)", "t as (select count(*)::double as n from nodes)", "share as (select src, dst, weight / sum(weight) over (partition by src) as s from edges)", "r0 as (select id, 1 / n as rank from nodes, t)"]
    for k in range(rounds):
        steps.append(
            f"r{k + 1} as materialized (select r.id, 0.15 / n + 0.85 * (coalesce(g.got, 0) + l.mass / n) as rank from r{k} r left join (select dst, sum(rank * s) as got from share join r{k} on src = id group by dst) g on g.dst = r.id, t, (select coalesce(sum(rank), 0) as mass from r{k} where id not in (select src from edges)) l)"
        )
    return ", ".join(steps) + f" select id as file_id, round(rank / (select max(rank) from r{rounds}), 5) as rank from r{rounds}"


@query(_pagerank_sql(20))
def graph_pagerank(spark, d):
    """PageRank of the supplier-part graph, twenty rounds."""
    nodes, edges = _graph(spark, d)
    return symbols.pagerank(nodes, edges).select("file_id", F.round("rank", 5).alias("rank"))


@query(f"with {EDGES} select dst as file_id, weight::bigint as weight from edges where src = 1")
def graph_out_edges(spark, d):
    return _graph(spark, d)[1].where("src = 1").select(F.col("dst").alias("file_id"), "weight")


@query("with " + EDGES + ", files as (select src as id from edges union select dst from edges), one as (select dst from edges where src = 1) select id as file_id, case when id = 1 or id in (select dst from one) then 1.0::double else 0.6::double end as reach from files")
def graph_reach(spark, d):
    """Import reachability from one file; all stand-ins share a directory."""
    nodes, edges = _graph(spark, d)
    return verbs.reach(nodes.withColumn("path", F.concat(F.lit("a/"), F.col("file_id").cast("string"))), edges, [1])


# ---- freshness and change ------------------------------------------------------------------------------------------
SNAP = f"{DOCS}, old as (select * from docs where file_id % 13 <> 0), new as (select file_id, path, case when file_id % 7 = 0 then text || ' changed' else text end as text from docs where file_id % 11 <> 0)"


def _snapshots(spark, d):
    files = _docs(spark, d).select("file_id", "path", "text")
    new = files.where("file_id % 11 <> 0").withColumn("text", F.when(F.col("file_id") % 7 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text")))
    return files.where("file_id % 13 <> 0"), new


@query(f"with {SNAP} select coalesce(o.path, n.path) as path, case when o.path is null then 'added' when n.path is null then 'deleted' else 'modified' end as change from old o full join new n on o.path = n.path where o.path is null or n.path is null or o.text <> n.text")
def snapshot_diff(spark, d):
    return changes.changed_files(*_snapshots(spark, d))


@query(f"with {SNAP} select w as word, count(distinct file_id)::bigint as files from (select file_id, unnest(regexp_extract_all(text, '[A-Za-z0-9_]+')) as w from new) where length(w) between 2 and 64 group by w")
def index_after_delta(spark, d):
    """Word counts of a base index merged with a delta: equal to a rebuild."""
    old, new = _snapshots(spark, d)
    base = {"files": old, "words": index.word_postings(old), "grams": index.gram_postings(old)}
    after = refresh.merged(base, refresh.delta(old, new))
    return after["words"].groupBy("word").agg(F.countDistinct("file_id").alias("files"))


@query(f"with {PARTS} select path, class_name as name, 'signature' as change from parts where p_partkey % 7 = 0 and p_partkey % 5 <> 0 union all select path, class_name, 'removed' from parts where p_partkey % 5 = 0 union all select path, method_name, 'removed' from parts where p_partkey % 5 = 0")
def changed_definitions(spark, d):
    """Definitions that differ between two snapshots of the code files."""
    files = _code(spark, d)
    new = files.where("file_id % 5 <> 0").withColumn("text", F.when(F.col("file_id") % 7 == 0, F.regexp_replace("text", r"\(Base", "(Other, Base")).otherwise(F.col("text")))
    side = lambda f: changes.with_bodies(f, symbols.symbols(f))
    return changes.changed_definitions(side(files), side(new)).select("path", "name", "change")


# ---- usage ---------------------------------------------------------------------------------------------------------
def _events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


@query("select event_type, count(value)::bigint as n, round(avg(value), 6) as avg, min(value) as min, quantile_disc(value, 0.5) as p50, quantile_disc(value, 0.95) as p95, quantile_disc(value, 0.99) as p99, max(value) as max, round(sum(value), 4) as total from events group by event_type")
def usage_distribution(spark, d):
    return usage.distribution(_events(spark, d), "value", ["event_type"]).withColumn("avg", F.round("avg", 6)).withColumn("total", F.round("total", 4))


@query(
    """with recursive e as (select *, row_number() over (partition by key order by ms, side, id) as n from (
        select user_id as key, epoch_ms(ts) as ms, case when event_type = 'view' then 0 else 1 end as side, event_id as id from events where event_type in ('view', 'purchase') and user_id is not null and ts is not null)),
    walk as (select key, 0::bigint as n, cast([] as struct(ms bigint, id bigint)[]) as held, null::bigint as run_id, null::bigint as hook_id from (select distinct key from e)
        union all select w.key, w.n + 1, case when e.side = 0 then list_append(w.held, {'ms': e.ms, 'id': e.id}) when len(w.held) > 0 and e.ms - w.held[-1].ms <= 21600000 then w.held[1:len(w.held) - 1] else w.held end,
            case when e.side = 1 and len(w.held) > 0 and e.ms - w.held[-1].ms <= 21600000 then e.id end, case when e.side = 1 and len(w.held) > 0 and e.ms - w.held[-1].ms <= 21600000 then w.held[-1].id end
        from walk w join e on e.key = w.key and e.n = w.n + 1)
    select run_id, hook_id from walk where run_id is not null"""
)
def usage_pairs(spark, d):
    """Purchases paired one to one with the newest unused view of the user within six hours."""
    e = _events(spark, d).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    side = lambda kind, name: e.where(F.col("event_type") == kind).select(F.col("user_id").alias("key"), F.col("ms").alias("ts"), F.col("event_id").alias(name))
    return usage.pair_runs(side("view", "hook_id"), side("purchase", "run_id"), 21_600_000)


@query("with c as (select user_id, event_type, count(*) as n from events group by 1, 2) select user_id, event_type as mode, n::bigint as n from (select *, row_number() over (partition by user_id order by n desc, event_type) as rn from c) where rn = 1")
def usage_modes(spark, d):
    return usage.mode_by(_events(spark, d), ["user_id"], "event_type")


@query("with c as (select user_id, count(*) as n from events group by 1) select (select sum(n) from (select n from c order by n desc, user_id limit 3))::bigint as top_events, sum(n)::bigint as events, (select sum(n) from (select n from c order by n desc, user_id limit 3)) / sum(n) as share from c")
def usage_concentration(spark, d):
    return usage.concentration(_events(spark, d), "user_id")


@query("with p as (select user_id, event_type, avg(value) as v from events group by 1, 2), j as (select a.v as va, b.v as vb from p a join p b on a.user_id = b.user_id and a.event_type = 'click' and b.event_type = 'view') select count(*)::bigint as pairs, count(*) filter (vb < va)::bigint as wins, count(*) filter (vb > va)::bigint as losses, count(*) filter (vb = va)::bigint as ties, round(avg(va), 6) as avg_a, round(avg(vb), 6) as avg_b from j")
def usage_compare(spark, d):
    return usage.compare_versions(_events(spark, d), "user_id", "event_type", "value", "click", "view").withColumn("avg_a", F.round("avg_a", 6)).withColumn("avg_b", F.round("avg_b", 6))


def _sessions(spark, d):
    return spark.read.parquet(f"{d}/conversations.parquet").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("t"), F.col("text").alias("query"), "role")


@query("select conv_id as session_id, turn as t, coalesce(len(list_filter(recent, lambda r: r = role)), 0)::int as repeats from (select conv_id, turn, role, list(role) over (partition by conv_id order by turn rows between 5 preceding and 1 preceding) as recent from conversations)")
def session_repeats(spark, d):
    """How many of the last five turns of a session had the same role."""
    return usage.repeats(_sessions(spark, d), F.col("role")).select("session_id", "t", "repeats")


@query("with f as (select conv_id as session_id, role as file, max(turn) as t from conversations group by 1, 2) select session_id, file, t, (row_number() over (partition by session_id order by t desc, file))::int as place from f")
def session_focus(spark, d):
    return usage.focus(_sessions(spark, d).select("session_id", "t", F.array("role").alias("files")))


# ---- scalar functions ----------------------------------------------------------------------------------------------
@query("select p_partkey, regexp_replace(p, '(^|/)[^/]*$', '') as dir, regexp_extract(p, '[^/]*$') as name, lower(p_name) as folded from (select p_partkey, p_name, concat('a/', p_brand, '/', p_name, '.py') as p from part)")
def scalar_paths(spark, d):
    p = F.concat(F.lit("a/"), "p_brand", F.lit("/"), "p_name", F.lit(".py"))
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", parent(p).alias("dir"), file_name(p).alias("name"), ascii_lower(F.col("p_name")).alias("folded"))


@query()
def scalar_tokens(spark, d):
    """Estimated tokens of every document."""
    from textquarry.functions.tokens import estimate_tokens

    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


@query("select doc_id, octet_length(encode(substr(text, 1, (length(text) - doc_id % 7)::int)))::int as bytes from documents")
def scalar_byte_offsets(spark, d):
    """Bytes before a place near the end of every text."""
    from textquarry.functions.text import byte_offset

    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", byte_offset(F.col("text"), (F.length("text") - F.col("doc_id") % 7).cast("int")).alias("bytes"))


# ---- more of the same families -------------------------------------------------------------------------------------
LINKED = """linked as (select p_partkey as file_id, concat('src/', lower(replace(p_brand, '#', '_')), '/part_', p_partkey::varchar, '.py') as path, concat('src/', lower(replace(p_brand, '#', '_')), '/part_', (p_partkey % 50 + 1)::varchar, '.py') as wanted from part)"""


def _linked(spark, d):
    """Code files that import each other: part_k imports part_(k mod 50 + 1) of its own folder, if that exists."""
    f = _code(spark, d).select("file_id", "path", "lang")
    return f.withColumn("text", F.concat(F.lit("from part_"), (F.col("file_id") % 50 + 1).cast("string"), F.lit(" import one, two\n")))


@query(f"with {DOCS}, {LINES} select path, line from lines where line_text = 'Released under the MIT License.'")
def search_whole_line(spark, d):
    return search.matched_lines(_docs(spark, d), _search("Released under the MIT License.", fixed=True, whole_line=True)).select("path", "line")


@query(f"with {DOCS}, {LINES} select path, count(*)::bigint as lines from lines where contains(lower(line_text), 'reonth') group by path")
def search_smart_case(spark, d):
    return sinks.counts(search.matched_lines(_docs(spark, d), _search("reonth", fixed=True, smart_case=True)))


@query(f"with {DOCS}, {LINES} select path, line from lines where contains(line_text, 'ent') and (path like 'src/src2/%' or path = 'tests/src0/en/doc_0.txt')")
def search_under_paths(spark, d):
    return search.matched_lines(_docs(spark, d), _search("ent", fixed=True, paths=("./src/src2/", "tests/src0/en/doc_0.txt"))).select("path", "line")


@query(f"with {DOCS}, {LINES}, h as (select file_id, path from lines where contains(line_text, 'tion')) select count(distinct file_id)::bigint as files, count(*)::bigint as hits, count(*) filter (path not like 'src/%')::bigint as demoted_hits, count(*)::bigint as n_ident from h")
def report_statistics(spark, d):
    return report.statistics(search.hits(_docs(spark, d), _search("tion", fixed=True))).select("files", "hits", "demoted_hits", "n_ident")


@query(
    f"with {DOCS}, {LINES}, h as (select path, line, regexp_matches(line_text, '{EDGE}tion($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])') as exact from lines where contains(line_text, 'tion')) select path, line from (select *, row_number() over (partition by path order by line) as n, row_number() over (partition by path, exact order by line) as p from h) where n <= 1 or p <= 2"
)
def report_kept_lines(spark, d):
    """Per file the first line and the best two exact and other lines (scores are equal here, so by line)."""
    return report.kept_lines(search.hits(_docs(spark, d), _search("tion", fixed=True)), 1, 2).select("path", "line")


@query(f"with {DOCS}, {LINES}, h as (select file_id, path from lines where contains(line_text, 'tion')) select path, count(*)::bigint as total from h group by path")
def report_file_order(spark, d):
    return report.file_order(search.hits(_docs(spark, d), _search("tion", fixed=True)), "path").select("path", "total")


@query()
def report_layout(spark, d):
    """Facets when hits are many and over budget."""
    kind, shown = report.layout(search.hits(_docs(spark, d), _search("tion", fixed=True)), _search("tion"))
    return shown.select("path", "line", F.lit(kind).alias("layout"))


@query(f"with {DOCS}, {LINES} select path, line, 'ident' as kind, true as exact from lines where contains(line_text, 'GNU General Public License') order by {WEIGHT} desc, replace(path, '/', chr(1)), line limit 10")
def report_explain(spark, d):
    return report.explain(search.hits(_docs(spark, d), _search("GNU General Public License", fixed=True))).select("path", "line", "kind", "exact")


@query(f"with {LINKED} select l.file_id, t.file_id as target from linked l left join linked t on t.path = l.wanted")
def import_resolution(spark, d):
    f = _linked(spark, d)
    return symbols.resolve(symbols.imports(f), f).select("file_id", "target")


@query(f"with {LINKED} select l.file_id as src, t.file_id as dst, 20::bigint as weight from linked l join linked t on t.path = l.wanted and t.file_id <> l.file_id")
def import_edges(spark, d):
    f = _linked(spark, d)
    return symbols.edges(symbols.resolve(symbols.imports(f), f))


@query(f"with {PARTS}, n as (select p_brand, count(*) as c from parts group by 1) select a.file_id as src, b.file_id as dst, 1::bigint as weight from parts a join parts b on a.p_brand = b.p_brand and a.file_id <> b.file_id and a.p_size = b.p_size join (select p_brand, p_size, count(*) as c from parts group by 1, 2) g on g.p_brand = a.p_brand and g.p_size = a.p_size where g.c between 2 and 30")
def import_packages(spark, d):
    """Weight 1 between files of one small package (brand and size here)."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("file_id"), F.concat("p_brand", F.lit("/"), "p_size").alias("package"))
    return symbols.package_edges(p, "package")


@query(f"with {PARTS} select file_id, method_name as symbol, 5 as line from parts where call_name = 'helper_2'")
def symbol_enclosing(spark, d):
    """The innermost definition around each call."""
    f = _code(spark, d)
    found = search.hits(f, _search("helper_2", fixed=True, whole_word=True), None, symbols.spans(f), symbols.symbols(f))
    return symbols.enclosing(found.select("file_id", "line", "offset"), symbols.symbols(f), ["file_id", "line"]).select("file_id", F.col("symbol.name").alias("symbol"), "line")


@query(f"with {DOCS}, {WORDS} select word, count(*)::bigint as files from words group by word")
def index_bitmaps(spark, d):
    """Postings as bitmaps, counted."""
    b = index.bitmaps(index.word_postings(_docs(spark, d)), "word")
    return b.groupBy("word").agg(F.sum(F.bitmap_count("files")).alias("files"))


@query(f"with {PARTS}, n as (select file_id, method_name as name from parts where file_id % 5 = 0) select n.name, 'renamed' as change, p.path, 6 as line, 'call' as kind, true as direct from n join parts p on p.file_id = n.file_id + 1")
def verb_diff_impact(spark, d):
    """Calls of methods that a snapshot renamed: every fifth file's method, called from the next file."""
    f = _code(spark, d)
    f = f.withColumn("text", F.when(F.col("file_id") % 5 == 1, F.concat("text", F.lit("part_"), (F.col("file_id") - 1).cast("string"), F.lit("(1)\n"))).otherwise(F.col("text")))
    new = f.withColumn("text", F.when(F.col("file_id") % 5 == 0, F.regexp_replace("text", "def part_", "def other_")).otherwise(F.col("text")))
    facts = scratch.written(symbols.extract(new, ("symbols", "spans")), "facts")
    syms = symbols.part(facts, "symbols")
    changed = changes.changed_definitions(changes.with_bodies(f, symbols.symbols(f)), changes.with_bodies(new, syms))
    found = impact.diff_impact(new, changed, symbols.part(facts, "spans"), syms)
    return found.select("name", "change", "path", "line", "kind", "direct")


@query(f"with {PARTS} select file_id, case when file_id % 2 = 0 then class_name else method_name end as name, case when file_id % 2 = 0 then 3 else 4 end as line from parts")
def change_touched(spark, d):
    """Innermost definitions that changed lines touch: the class line of even files, the last line of the method of odd ones."""
    f = _code(spark, d)
    ranges = f.select("path", F.when(F.col("file_id") % 2 == 0, 3).otherwise(5).alias("first")).withColumn("last", F.col("first"))
    return impact.touched(ranges, impact.with_last_line(f, symbols.symbols(f))).select("file_id", "name", "line")


@query("select user_id as id, event_id, event_type as version from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events where event_type = 'view') where rn = 1")
def usage_latest_replay(spark, d):
    e = _events(spark, d).select(F.col("user_id").alias("id"), F.struct("ts", "event_id").alias("ts"), "event_id", F.col("event_type").alias("version"))
    return usage.latest_replay(e, "view").select("id", "event_id", "version")


@query("select event_id, case when user_id <= 50 then value else value * 50.0 / user_id end as capped from events")
def usage_capped(spark, d):
    return _events(spark, d).select("event_id", usage.capped_tokens(F.col("value"), F.col("user_id"), 50).alias("capped"))


@query("select user_id, first_ts, n::bigint as events from (select user_id, min(event_id) as first_ts, count(*) as n from events group by 1)")
def usage_sessions(spark, d):
    return usage.sessions(_events(spark, d), "user_id", "event_id", "event_type").select("user_id", "first_ts", "events")


SHOWN = "select conv_id as session_id, turn as t, role as file, (turn % 3)::bigint as first, (turn % 3 + 5 - turn % 2)::bigint as last, 1 as mtime from conversations"


@query(f"with s as ({SHOWN}) select distinct a.session_id, a.t, a.file from s a join s b on a.session_id = b.session_id and a.file = b.file and b.t < a.t and b.first <= a.first and b.last >= a.last")
def session_covered(spark, d):
    """Ranges that an earlier answer of the session showed whole."""
    c = spark.read.parquet(f"{d}/conversations.parquet")
    t = F.col("turn")
    shown = c.select(F.col("conv_id").alias("session_id"), t.alias("t"), F.col("role").alias("file"), (t % 3).alias("first"), (t % 3 + 5 - t % 2).alias("last"), F.lit(1).alias("mtime"))
    return usage.covered(shown).select("session_id", "t", "file").distinct()


@query("select event_type, date_trunc('hour', ts) as hour, count(*)::bigint as events, round(sum(value), 4) as value from events group by 1, 2")
def stream_windows(spark, d):
    """The event log as a stream: hourly windows in append output to a folder; a last event far ahead closes the windows of all others."""
    events = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.col("ts").cast("timestamp").alias("ts"), "value")
    feed, out = scratch.new_path(spark, "feed"), scratch.new_path(spark, "windows")
    last = events.agg((F.max("ts") + F.expr("interval 30 days")).alias("ts")).select(F.lit("end").alias("event_type"), "ts", F.lit(0.0).alias("value"))
    for rows in (events, last):
        rows.write.mode("append").parquet(feed)
        stream = spark.readStream.schema(events.schema).parquet(feed)
        run = refresh.windowed_usage(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    return spark.read.parquet(out).where("event_type <> 'end'").select("event_type", F.col("window.start").cast("timestamp_ntz").alias("hour"), "events", F.round("value", 4).alias("value"))


@query(
    """with p as (select page_id, substr(html, 1, 65536) as head from pages), l as (select page_id, octet_length(encode(head)) as size, string_split(head, chr(10)) as parts from p),
    m as (select page_id, size, len(parts) - 1 as lines, list_max(list_transform(parts, lambda x: octet_length(encode(x)))) as longest from l)
    select page_id, (longest > 1000 and case when lines > 0 then size // lines else size end > 200) or (lines = 0 and size > 2000) as minified from m"""
)
def file_content_flags(spark, d):
    from textquarry.functions.files import content_flags

    p = spark.read.parquet(f"{d}/pages.parquet")
    return p.select("page_id", content_flags(F.col("html"), F.octet_length("html"))["minified"].alias("minified"))


@query("select doc_id, list_sort(list_distinct(list_transform(list_filter(regexp_split_to_array(source || ' ' || lang || ' ' || source, '[^A-Za-z0-9]+'), lambda w: w <> ''), lambda w: lower(w)))) as tokens from documents")
def scalar_normalized_query(spark, d):
    from textquarry.functions.text import normalize_query

    q = normalize_query(F.concat_ws(" ", "source", "lang", "source"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.split(q, " ").alias("tokens"))


# ---- what is read from a published index ---------------------------------------------------------------------------
def _parts(spark, d):
    return _published(spark, d, "parts", _code)


@query(SQL["verb_def"])
def verb_def_published(spark, d):
    """Definitions by lookup: no file is read again."""
    t = _parts(spark, d)
    return verbs.definitions(t["files"], t["symbols"], "Part42").select("path", "line", "kind", F.round("score", 6).alias("score"))


@query(SQL["verb_refs"])
def verb_refs_published(spark, d):
    t = _parts(spark, d)
    return verbs.references(t["files"], "part_42", t["spans"], t["symbols"], t, t["imports"]).select("path", "line", "kind")


@query(SQL["verb_callers"])
def verb_callers_published(spark, d):
    t = _parts(spark, d)
    return verbs.callers(t["files"], "helper_3", t["spans"], t["symbols"], t, imports=t["imports"]).select("path", "symbol", "calls", "lines", F.round("score", 6).alias("score"))


@query(SQL["verb_impls"])
def verb_impls_published(spark, d):
    t = _parts(spark, d)
    return verbs.implementations(t["files"], t["symbols"], "Base7").select("path", "line", "name", F.round("score", 6).alias("score"))


@query(SQL["verb_impact"])
def verb_impact_published(spark, d):
    t = _parts(spark, d)
    return verbs.impact(t["files"], "Base7", t["spans"], t["symbols"], t["edges"], t, t["imports"]).select("path", "uses", "grade")


@query(SQL["verb_map"])
def verb_map_published(spark, d):
    t = _parts(spark, d)
    return verbs.map_directories(t["files"], t["symbols"], t["ranks"], "src").select("dir", "files", F.col("symbols").cast("long").alias("symbols"))


@query(SQL["find_files"])
def find_files_published(spark, d):
    """BM25 from published pieces and sizes."""
    t = _published(spark, d, "docs", _docs)
    found = find.find(t["files"], t["pieces"], "how do the tests handle moron and the Apache license")
    return found.select("path", F.round("score", 6).alias("score"))


@query(SQL["search_indexed"])
def search_published(spark, d):
    t = _published(spark, d, "docs", _docs)
    return search.matched_lines(t["files"], _search("Apache License", fixed=True), t).select("path", "line")


@query(SQL["index_after_delta"])
def index_delta_published(spark, d):
    """Word counts after a published delta, which holds the files that changed and tombstones."""
    old, new = _snapshots(spark, d)
    path = scratch.new_path(spark, "index-delta")
    index.publish(old, path, 1)
    refresh.refresh(path, new, 2)
    return index.open_index(spark, path)["words"].groupBy("word").agg(F.countDistinct("file_id").alias("files"))


@query(f"with {DOCS} select w as word, count(distinct file_id)::bigint as files from (select file_id, unnest(regexp_extract_all(case when file_id % 50 = 3 then text || ' changedword' else text end, '[A-Za-z0-9_]+')) as w from docs where file_id % 50 <> 4) where length(w) between 2 and 64 group by w")
def index_small_delta(spark, d):
    """A change small enough to stay a delta over its base: read through tombstones."""
    files = _docs(spark, d).select("file_id", "path", "text")
    new = files.where("file_id % 50 <> 4").withColumn("text", F.when(F.col("file_id") % 50 == 3, F.concat("text", F.lit(" changedword"))).otherwise(F.col("text")))
    path = scratch.new_path(spark, "index-small")
    index.publish(files, path, 1)
    refresh.refresh(path, new, 2)
    return index.open_index(spark, path)["words"].groupBy("word").agg(F.countDistinct("file_id").alias("files"))


# ---- any case, line ends, every occurrence -------------------------------------------------------------------------
@query(f"with {DOCS}, {LINES} select path, line from lines where regexp_matches(line_text, '(?i){EDGE}version($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')")
def search_indexed_smart_case(spark, d):
    """A whole word without capitals matches in any case, with an index as without."""
    t = _published(spark, d, "docs", _docs)
    return search.matched_lines(t["files"], _search("version", fixed=True, whole_word=True, smart_case=True), t).select("path", "line")


@query(f"with {DOCS}, {LINES} select path, line from lines where regexp_matches(line_text, '(?i){EDGE}(apache|mit)($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')")
def search_indexed_flags(spark, d):
    """A flag inside a group of the pattern folds case."""
    t = _published(spark, d, "docs", _docs)
    return search.matched_lines(t["files"], _search("(?i:apache|mit)", whole_word=True), t).select("path", "line")


@query(f"with {DOCS}, {LINES} select path, line from lines where contains(line_text, 'Apache') or contains(line_text, 'stupid')")
def search_indexed_list(spark, d):
    """A list of patterns: candidates of any of them."""
    t = _published(spark, d, "docs", _docs)
    return search.matched_lines(t["files"], _search(("Apache", "stupid"), fixed=True), t).select("path", "line")


@query(f"with {PARTS} select path, 5 as line, 'comment' as kind from parts where call_name = 'helper_3'")
def search_kinds_any_match(spark, d):
    """A line counts for a kind if any of its matches is of it: here the second, behind a call."""
    f = _code(spark, d).withColumn("text", F.concat(F.rtrim("text", F.lit("\n")), F.lit("  # as helper_3\n")))
    f = f.where(F.contains("text", F.lit("helper_3(")))
    return search.hits(f, _search("helper_3", fixed=True, kinds=("comment",))).select("path", "line", "kind")


@query(SQL["verb_refs"])
def verb_refs_crlf(spark, d):
    """Files with CRLF line ends: the same lines and kinds."""
    files = _code(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return verbs.references(files, "part_42").select("path", "line", "kind")


@query(SQL["verb_show"])
def verb_show_crlf(spark, d):
    files = _code(spark, d).withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    return verbs.show(files, symbols.symbols(files), 7, 5)


@query(f"with {DOCS} select path, unnest(regexp_extract_all(text, '(?m)[a-z]+\\.?\\n[A-Z][a-z]+')) as text from docs")
def search_multiline(spark, d):
    """Matches that go over a line end."""
    return search.multiline_hits(_docs(spark, d), _search(r"[a-z]+\.?\n[A-Z][a-z]+")).select("path", "text")


@query(f"with {DOCS}, {LINES} select path, line from (select path, line, row_number() over (partition by path order by line) as n from lines where contains(line_text, 'the')) where n <= 2")
def search_capped(spark, d):
    """The first two matched lines of each file."""
    return search.capped(search.hits(_docs(spark, d), _search("the", fixed=True)), per_file=2).select("path", "line")


# ---- extraction of other languages and shapes ----------------------------------------------------------------------
def _coded(spark, d, lang, end, lines):
    """Files made of ``part``: lines of a template with {k} the part's key, {s} its size and {n} a small number."""
    p = src.dealt(spark.read.parquet(f"{d}/part.parquet"), "p_partkey")
    text = F.lit("\n".join(lines) + "\n")
    for mark, value in (("{k}", F.col("p_partkey")), ("{s}", F.col("p_size")), ("{n}", F.col("p_size") % 7)):
        text = F.replace(text, F.lit(mark), value.cast("string"))
    return p.select(F.col("p_partkey").alias("file_id"), F.concat(F.lit("src/m_"), F.col("p_partkey").cast("string"), F.lit("." + end)).alias("path"), text.alias("text"), F.lit(lang).alias("lang"))


def _expected(rows: list[tuple]) -> str:
    """SQL of the symbols that a template gives: (name, kind, line, bases) with ``{k}``, ``{s}`` and ``{n}``."""
    said = lambda x: "replace(replace(replace('" + x + "', '{k}', p_partkey::varchar), '{s}', p_size::varchar), '{n}', (p_size % 7)::varchar)"
    each = [f"select p_partkey as file_id, {said(n)} as name, '{k}' as kind, {line} as line, cast([{', '.join(said(b) for b in bases)}] as varchar[]) as supers from part" for n, k, line, bases in rows]
    return " union all ".join(each)


RUST = ["/* outer /* fn hidden_{k}() {} */ fn hidden() {} */", "use crate::base::{Base{s}, helper::run};", "pub struct Part{k}<'a> {", "    pub size: &'a str,", "}", "impl<'a> crate::base::Base{s}", "    for Part{k}<'a>", "{", "    fn part_{k}(&self) -> char { let q = '\"'; helper_{n}(q) }", "}", "pub enum Kind{k} { One, Two(u8) }", "pub const LIMIT_{k}: usize = {s};"]
KOTLIN = ["import base.Base{s}", "/* a /* class Hidden{k} */ b */", "data class Part{k}(val size: Int) :", "    Base{s}(size),", "    Runner {", "    override fun part_{k}() = \"class Fake ${helper_{n}(\"x\")}\"", "    companion object", "}", "enum class Kind{k} { ONE, TWO }"]
SCRIPT = ["import { Base{s} } from './base'", "export class Part{k}", "  extends Base{s} implements Runner {", "  size = `class Fake ${ {a: 1}.a }`;", "  part_{k}(x: number): string {", "    return /[\"/]/.test('x') ? helper_{n}(this) : '';", "  }", "}", "export const arrow_{k} = (a: number): string => `${a}`;", "enum Kind{k} { One, Two = 2 }", "type Alias{k} = { a: string };"]
SHAPED = ["from base import (", "    Base{s},", "    helper_{n} as h,", ")", "class Part{k}(", "    Base{s}, other.Mixin[int],", "    metaclass=Meta,", "):", '    \"\"\"class Fake{k}: pass\"\"\"', "    size: int = {s}", "    async def part_{k}(self):", "        self.seen = 1", "        self.seen = 2", "        return h(self)", "LIMIT_{k} = (", "    {s}", ")", "name_{k} = 'def fake(): pass'"]


@query(_expected([("Part{k}", "struct", 3, []), ("size", "field", 4, []), ("Part{k}", "impl", 7, ["Base{s}"]), ("part_{k}", "method", 9, []), ("Kind{k}", "enum", 11, []), ("One", "variant", 11, []), ("Two", "variant", 11, []), ("LIMIT_{k}", "constant", 12, [])]))
def symbol_table_rust(spark, d):
    """Nested comments, lifetimes, an impl over several lines, fields and variants."""
    return symbols.symbols(_coded(spark, d, "rust", "rs", RUST)).select("file_id", "name", "kind", "line", "supers")


@query(_expected([("Part{k}", "class", 3, ["Base{s}", "Runner"]), ("size", "field", 3, []), ("part_{k}", "method", 6, []), ("Companion", "object", 7, []), ("Kind{k}", "enum", 9, []), ("ONE", "variant", 9, []), ("TWO", "variant", 9, [])]))
def symbol_table_kotlin(spark, d):
    """Bases over several lines, constructor fields, strings with code, a companion."""
    return symbols.symbols(_coded(spark, d, "kotlin", "kt", KOTLIN)).select("file_id", "name", "kind", "line", "supers")


@query(_expected([("Part{k}", "class", 2, ["Base{s}", "Runner"]), ("size", "field", 4, []), ("part_{k}", "method", 5, []), ("arrow_{k}", "function", 9, []), ("Kind{k}", "enum", 10, []), ("One", "variant", 10, []), ("Two", "variant", 10, []), ("Alias{k}", "type", 11, [])]))
def symbol_table_typescript(spark, d):
    """Template strings, a pattern literal with quotes, arrow functions, members."""
    return symbols.symbols(_coded(spark, d, "typescript", "ts", SCRIPT)).select("file_id", "name", "kind", "line", "supers")


@query(_expected([("Part{k}", "class", 5, ["Base{s}", "Mixin"]), ("size", "field", 10, []), ("part_{k}", "method", 11, []), ("seen", "field", 12, []), ("LIMIT_{k}", "constant", 15, []), ("name_{k}", "variable", 18, [])]))
def symbol_table_python(spark, d):
    """Bases over several lines, a docstring, class and instance attributes, module names."""
    return symbols.symbols(_coded(spark, d, "python", "py", SHAPED)).select("file_id", "name", "kind", "line", "supers")


@query("select p_partkey as file_id, 'base' as module, ['Base' || p_size::varchar, 'helper_' || (p_size % 7)::varchar] as names from part union all select p_partkey, 'crate::base', ['Base' || p_size::varchar] from part union all select p_partkey, 'crate::base::helper', ['run'] from part union all select p_partkey, 'base.Base' || p_size::varchar, cast([] as varchar[]) from part union all select p_partkey, './base', ['Base' || p_size::varchar] from part")
def import_shapes(spark, d):
    """Imports in brackets, use trees, packages and modules of four languages."""
    every = [_coded(spark, d, lang, end, lines) for lang, end, lines in (("python", "py", SHAPED), ("rust", "rs", RUST), ("kotlin", "kt", KOTLIN), ("typescript", "ts", SCRIPT))]
    out = [symbols.imports(f).select("file_id", "module", "names") for f in every]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


@query("select p_partkey as file_id, k.kind, k.n::bigint as n from part, (values ('string', 1), ('doc', 1)) k(kind, n)")
def span_shapes(spark, d):
    """Docstrings and strings that hold code."""
    return symbols.spans(_coded(spark, d, "python", "py", SHAPED)).groupBy("file_id", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PARTS} select path, 3 as line, 'def' as kind, true as prefer from parts where p_partkey = 19 union all select path, 2, 'comment', true from parts where p_partkey = 19 and false")
def search_prefer_exact(spark, d):
    """Where a whole word matches, matches inside longer names leave the answer."""
    found = search.prefer_exact(search.hits(_code(spark, d), _search("Part19", fixed=True)))
    return found.select("path", "line", "kind", F.col("exact").alias("prefer"))


@query(f"with {PARTS} select path, 1 as depth, method_name as symbol, 'helper_3' as of from parts where call_name = 'helper_3'")
def verb_callers_deep(spark, d):
    """Callers, and callers of the first twelve of them (which nothing calls here)."""
    t = _parts(spark, d)
    return verbs.callers_two_deep(t["files"], "helper_3", t["spans"], t["symbols"], t).select("path", "depth", "symbol", "of")


@query("select 0::bigint as n")
def verb_impls_possible(spark, d):
    """Lines that use a name as a type and are no known implementation: none, as every use is one."""
    t = _parts(spark, d)
    return verbs.possible_implementations(t["files"], "Base7", t["spans"], t["symbols"]).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {PARTS} select path, 2::bigint as symbols, [class_name, method_name] as names from parts order by replace(path, '/', chr(1)) limit 50")
def verb_map_files(spark, d):
    """Files by rank and place with their first exported names."""
    t = _parts(spark, d)
    return verbs.map_files(t["files"], t["symbols"], t["files"].select("file_id", F.lit(1.0).alias("rank"))).select("path", "symbols", "names")


@query(f"with {PARTS} select path, class_name as name, 2 as held from parts where class_name = 'Part42'")
def find_best_definitions(spark, d):
    """The definitions of found files that hold the most pieces of a question."""
    t = _parts(spark, d)
    found = t["files"].where("path like '%part_42.py'").select("file_id", "path")
    best = find.best_definitions(found, t["symbols"], "Part42 part")
    return best.where("name = 'Part42'").join(found, "file_id").select("path", "name", F.lit(2).alias("held"))


@query(f"with {DOCS}, {LINES} select path, count(*)::bigint as total, count(*)::bigint as n_ident from lines where contains(line_text, 'tion') group by path")
def search_by_file(spark, d):
    """Matched lines of each file, by kind."""
    return search.by_file(search.hits(_docs(spark, d), _search("tion", fixed=True))).select("path", "total", "n_ident")


@query(f"with {DOCS}, {LINES} select count(*)::bigint as total, 10::bigint as shown, 'exact' as rung, 0 as exit from lines where contains(line_text, 'tion')")
def search_outcome(spark, d):
    """What was found, what is shown, and the exit code."""
    found = search.hits(_docs(spark, d), _search("tion", fixed=True))
    return search.outcome(found, search.ranked(found, 10), "exact")


@query("select event_type, count(*)::bigint as runs, round(sum(value), 4) as total, round(count(*) / (select count(*) from events), 9) as share, count(*) filter (value > 90)::bigint as failed from events group by event_type")
def usage_summary(spark, d):
    out = usage.summarize(_events(spark, d), ["event_type"], "value", F.col("value") > 90)
    return out.select("event_type", "runs", F.round("total", 4).alias("total"), F.round("share", 9).alias("share"), "failed")


@query("select conv_id as session_id, turn as t from (select *, count(*) over (partition by conv_id) as n, row_number() over (partition by conv_id order by turn desc) as age from conversations) where n <= 4 or age <= 2")
def session_compact(spark, d):
    """A log past its limit keeps its newest half."""
    return usage.compact(_sessions(spark, d).select("session_id", "t"), 4).select("session_id", "t")


@query("select event_id from events where user_id <= 20 and starts_with(event_type, 'c')")
def usage_chosen(spark, d):
    """Events after a cut-off, of a session prefix."""
    e = _events(spark, d).select("event_id", (-F.col("user_id")).alias("ts"), F.col("event_type").alias("session"))
    return usage.chosen(e, since_ms=20, now_ms=0, session="c").select("event_id")


@query("select p_partkey as id, 2 * p_partkey as version from part where p_partkey % 3 <> 0")
def change_current_view(spark, d):
    """The newest version of each path that is no deletion."""
    p = spark.read.parquet(f"{d}/part.parquet").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("path"))
    old = p.withColumn("version", F.col("id")).withColumn("deleted", F.lit(False))
    new = p.withColumn("version", 2 * F.col("id")).withColumn("deleted", F.col("id") % 3 == 0)
    return changes.current_view(old.unionByName(new)).select("id", "version")


@query("select p_partkey as file_id, 'class Fake' || p_partkey::varchar || ': pass' as doc from part")
def symbol_documentation(spark, d):
    """The first line of each docstring."""
    f = _coded(spark, d, "python", "py", SHAPED)
    facts = symbols.extract(f)
    return symbols.documentation(f, symbols.part(facts, "symbols"), symbols.part(facts, "spans")).select("file_id", "doc")


@query(f"with {PARTS} select p_partkey as file_id, 'case' as rung, class_name as name from parts where p_partkey = 42")
def verb_def_ladder(spark, d):
    """A name that differs in case finds its definition on a later rung."""
    t = _parts(spark, d)
    rung, found = verbs.find_definitions(t["files"], t["symbols"], "PART42")
    return found.select("file_id", F.lit(rung).alias("rung"), "name")


@query(SQL["verb_def"])
def verb_def_scan(spark, d):
    """Definitions without an index: only files that hold the name are read."""
    return verbs.scan_definitions(_code(spark, d), "Part42").select("path", "line", "kind", F.round("score", 6).alias("score"))


@query(f"with {PARTS} select path, method_name as symbol, 1::bigint as hits from parts where call_name = 'helper_2'")
def report_outline(spark, d):
    """Hits by the definition around them."""
    t = _parts(spark, d)
    found = search.hits(t["files"], _search("helper_2", fixed=True, whole_word=True), t, t["spans"], t["symbols"])
    return report.layout(found, _search("helper_2"), "outline", t["symbols"])[1].select("path", F.col("name").alias("symbol"), "hits")


@query("""select '{"type":"definition","path":"src/' || lower(replace(p_brand, '#', '_')) || '/part_42.py","line":3,"kind":"class","name":"Part42"}' as value from part where p_partkey = 42""")
def verb_json(spark, d):
    """A verb's answer as JSON records."""
    t = _parts(spark, d)
    return sinks.records(verbs.definitions(t["files"], t["symbols"], "Part42").select("path", "line", "kind", "name"), "definition")
