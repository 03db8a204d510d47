"""Personal data by bootstrapped contextual extraction, in DataFrame operations alone.

Base entities (e-mail addresses, IPv4 addresses, payment cards, phone numbers) are
found by regular expressions in every whole text; they are the seeds. Every
identifier-like token (it holds a digit or an "@"; groups of digits with single spaces or hyphens between them are one token) is an instance, and the one or two words before it, or
the name before "=" in it, are the lexical pattern it occurs in; a token
with no word between it and the one before has the pattern of that one. Over the graph of patterns and instances
scores are exchanged for at most ``rounds`` rounds: a pattern's score for a kind is the weight of its distinct instances of
that kind over the weight of all that are known: seeds, instances found in an earlier round, and tokens that can't be
identifiers (fewer than four digits, no "@"), which count against it. Other instances count neither way. A
pattern with at least ``support`` distinct instances of a kind and a score of ``confidence`` or more
is trusted, and what else occurs in it is a span of that kind, if it has four digits or an "@"; such an instance is a
seed of the next round, weighted by the mean score of its trusted patterns, unless these are of several kinds.
So scores cover the whole corpus, and no pattern is trusted for what one document says.

Positions come from the pieces between matches. Possessive quantifiers and
anchors at the end of the last match keep the regular expressions linear without changing what they match.

Edge cases: null and empty texts have no spans and the digest of the empty string; rows that
repeat a doc_id stay rows of their own (rows that also repeat the text are equal in all results); null doc_ids
pass through; an empty table gives no rows. Only the two named columns are read.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textquarry.llm.storage import materialise

KINDS = ["email", "ip", "card", "phone"]
_LOCAL = "A-Za-z0-9._%+-"
#: kind -> (what must stand in a text that has one, pattern, equal in its matches to the plain form in the contract)
PATTERNS = {
    "email": ("@", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}"),
    "card": ("", r"[0-9](?:[\x20-]?[0-9])++"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_BYTE = "0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_SPACE = r"\x20\x09-\x0D"
#: A group of digits, and what ends a token of such groups; a run has at most 19 groups, as a card has at most 19 digits.
_GROUP = r"(?:[(][0-9]++[)][0-9]*+|[0-9]++)(?:-(?:[(][0-9]++[)][0-9]*+|[0-9]++))*+"
_ENDS = rf"(?=[^{_SPACE}0-9A-Za-z@+]*+(?:[{_SPACE}]|\z))"
TOKEN = rf"(?<![^{_SPACE}])[^{_SPACE}0-9@]*+(?:[0-9]++(?:[)][0-9]*+)?(?:-{_GROUP})?(?:\x20{_GROUP}{_ENDS}){{1,18}}+[^{_SPACE}]*+|[0-9@][^{_SPACE}]*+)"
_SPAN = "array<struct<start: bigint, rank: int, end: bigint, kind: string, value: string>>"


def _placed(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value, lead>> of the matches: places in code points, and the text since the last match."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("t"))
    empty = F.struct(F.lit(0).cast("bigint").alias("pos"), F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string, lead: string>>)").alias("out"))

    def step(acc, x):
        start = acc["pos"] + F.length(x["p"])
        end = start + F.coalesce(F.length(x["t"]), F.lit(0))
        lead = F.substring(x["p"], -60, 60)
        item = F.struct(start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), x["t"].alias("value"), lead.alias("lead"))
        return F.struct(end.cast("bigint").alias("pos"), F.when(x["t"].isNull(), acc["out"]).otherwise(F.array_append(acc["out"], item)).alias("out"))

    return F.aggregate(parts, empty, step, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, F.lit("[^0-9]"), F.lit(""))


def _luhn(digits: Column) -> Column:
    def step(acc, k):
        d = F.substr(digits, -k, F.lit(1)).cast("int") * (2 - k % 2)
        return acc + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), step) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    digits = _digits(value)
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^({_BYTE}\.){{3}}{_BYTE}$"),
        "card": F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(F.lit(False)),
        "phone": F.length(digits).between(9, 15),
    }[kind]


def base_spans(text: Column) -> Column:
    """Valid base entities of a text without nulls, by start, then kind as listed."""
    return F.array_sort(F.concat(*[_of_kind(text, rank, kind) for rank, kind in enumerate(KINDS)]))


def _of_kind(text: Column, rank: int, kind: str) -> Column:
    must, pattern = PATTERNS[kind]
    hits = F.filter(_placed(text, pattern), lambda m: _valid(kind, m["value"]))
    spans = F.transform(hits, lambda m: F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(kind).alias("kind"), m["value"].alias("value")))
    need = F.contains(text, F.lit(must)) if must else text.rlike("[0-9]")
    return F.when(need, spans).otherwise(F.expr(f"cast(array() as {_SPAN})"))


def candidates(text: Column) -> Column:
    """Identifier-like tokens with their lexical pattern: array<struct<start, end, value, pattern, own>>; not own: inherited from the token before."""

    def item(m):
        lead = F.length(F.regexp_extract(m["value"], "^[^0-9A-Za-z+@]*+", 0))
        named = F.regexp_extract(F.substr(m["value"], lead + 1), "^([A-Za-z_]++=)[^=]", 1)
        skip = lead + F.length(named)
        core = F.regexp_replace(F.substr(m["value"], skip + 1), F.lit("[^0-9A-Za-z]++$"), F.lit(""))
        words = F.regexp_extract(m["lead"], rf"([^{_SPACE}]+[{_SPACE}]+)?[^{_SPACE}]+[{_SPACE}]+$", 0)
        pattern = F.when(named != "", F.lower(named)).otherwise(F.trim(F.lower(F.regexp_replace(F.regexp_replace(words, F.lit(rf"[{_SPACE}]+"), F.lit(" ")), F.lit(r"[^\p{L} :=#]+"), F.lit("")))))
        return F.struct((m["start"] + skip).alias("start"), (m["start"] + skip + F.length(core)).alias("end"), core.alias("value"), pattern.alias("pattern"))

    def step(acc, c):
        own = c["pattern"] != ""
        pattern = F.when(own, c["pattern"]).otherwise(acc["pattern"])
        named = F.struct(c["start"], c["end"], c["value"], pattern.alias("pattern"), own.alias("own"))
        return F.struct(pattern.alias("pattern"), F.array_append(acc["out"], named).alias("out"))

    none = F.expr("cast(array() as array<struct<start: bigint, end: bigint, value: string, pattern: string, own: boolean>>)")
    found = F.aggregate(F.transform(_placed(text, TOKEN), item), F.struct(F.lit("").alias("pattern"), none.alias("out")), step, lambda acc: acc["out"])
    found = F.filter(found, lambda c: (c["pattern"] != "") & (c["end"] > c["start"]))
    return F.when(text.rlike("[0-9@]"), found).otherwise(none)


def _like(value: Column) -> Column:
    """Whether a token may be an identifier: it has four digits or an "@"."""
    return F.contains(value, F.lit("@")) | (F.length(_digits(value)) >= 4)


def _trusted(seen: DataFrame, support: int, confidence: float, rounds: int) -> DataFrame:
    """(pattern, kind) of the trusted patterns; ``seen`` has pattern, value and kind (null: no seed)."""
    edges = materialise(seen.groupBy("pattern", "value").agg(F.min("kind").alias("kind")), "pattern-instances")
    # a pattern of fewer distinct instances never has the support
    wide = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support).select("pattern")
    edges = materialise(edges.join(wide, "pattern", "left_semi"), "pattern-instances")
    unknown = F.col("kind").isNull() & _like(F.col("value"))
    free = edges.where(unknown).select("pattern", "value")
    fixed = edges.where(~unknown).select("pattern", "kind", F.lit(1.0).alias("weight"))
    known, before = fixed, 0
    for n in range(rounds):
        mine = [F.struct(F.lit(k).alias("kind"), F.sum(F.when(F.col("kind") == k, F.col("weight"))).alias("sum"), F.count(F.when(F.col("kind") == k, 1)).alias("n")) for k in KINDS]
        score = known.groupBy("pattern").agg(F.sum("weight").alias("all"), F.array(*mine).alias("of")).select("pattern", "all", F.inline("of"))
        score = score.withColumn("score", F.col("sum") / F.col("all")).where((F.col("n") >= support) & (F.col("score") >= confidence))
        good = materialise(score.select("pattern", "kind", "score"), "pattern-scores")
        now = good.count()
        if n == rounds - 1 or now == before:
            break
        before = now
        # what occurs in trusted patterns of one kind is a seed of the next round, with their mean score as its weight
        found = free.join(good, "pattern").groupBy("value").agg(F.min("kind").alias("kind"), F.max("kind").alias("other"), F.avg("score").alias("weight")).where("kind = other")
        known = fixed.unionByName(free.join(found, "value").select("pattern", "kind", "weight"))
    return good.select("pattern", "kind")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = 5, confidence: float = 0.9, rounds: int = 3) -> DataFrame:
    """One row per document: doc_id, text_key (a hash of the text), base and spans: arrays of (start, rank, end, kind, value) in order."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), base_spans(text).alias("base"), candidates(text).alias("tokens"))
    rows = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "entities")
    token = rows.where("size(tokens) > 0").select("row", "base", F.explode("tokens").alias("c"))
    # a token at which a base entity starts is its seed; one inside a base entity is part of it
    starts = F.filter("base", lambda b: (b["start"] >= F.col("c.start")) & (b["start"] < F.col("c.end")))
    inside = F.exists("base", lambda b: (b["start"] < F.col("c.start")) & (b["end"] > F.col("c.start")))
    token = token.withColumn("seed", F.get(starts, F.lit(0))).where(F.col("seed").isNotNull() | ~inside)
    seen = token.select("row", "c.start", "c.end", "c.pattern", "c.own", F.coalesce("seed.value", "c.value").alias("value"), F.col("seed.kind").alias("kind"))
    # an inherited pattern is not judged by its seeds and plain numbers, only what it may hide is looked for
    trusted = _trusted(seen.where(F.col("own") | (F.col("kind").isNull() & _like(F.col("value")))), support, confidence, rounds)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    new = seen.where(F.col("kind").isNull() & _like(F.col("value"))).drop("kind").join(trusted, "pattern").select("row", F.struct(F.col("start"), rank.alias("rank"), F.col("end"), F.col("kind"), F.col("value")).alias("span"))
    new = materialise(new.groupBy("row").agg(F.collect_set("span").alias("new")), "discovered")
    spans = F.array_sort(F.concat("base", F.coalesce("new", F.expr(f"cast(array() as {_SPAN})"))))
    return rows.join(new, "row", "left").select("doc_id", "text_key", "base", spans.alias("spans"))


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_rows: int = 100_000, **how) -> DataFrame:
    """``docs`` with every span replaced by its kind in angle brackets; texts without spans stay as they are, null texts null.

    ``broadcast_rows``: the most documents with spans (some hundred bytes each) whose spans are broadcast.
    """
    found = find(docs, id_col, text_col, **how).where("size(spans) > 0").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), F.transform("spans", lambda s: F.struct(s["start"], s["end"], s["kind"])).alias("__spans"))
    found = materialise(found.dropDuplicates(["__id", "__key"]), "spans")
    if found.count() <= broadcast_rows:
        found = F.broadcast(found)
    text = F.coalesce(F.col(text_col), F.lit(""))
    both = docs.join(found, F.col(id_col).cast("long").eqNullSafe(F.col("__id")) & (F.xxhash64(text) == F.col("__key")), "left")

    def step(acc, s):
        clear = s["start"] >= acc["pos"]
        more = F.concat(acc["out"], F.substr(F.col(text_col), acc["pos"] + 1, s["start"] - acc["pos"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(clear, more).otherwise(acc["out"]).alias("out"))

    begun = F.struct(F.lit(0).cast("bigint").alias("pos"), F.lit("").alias("out"))
    cleaned = F.aggregate("__spans", begun, step, lambda a: F.concat(a["out"], F.substr(F.col(text_col), a["pos"] + 1)))
    out = both.withColumn(text_col, F.when(F.col("__spans").isNull(), F.col(text_col)).otherwise(cleaned))
    return out.select(*docs.columns)
