"""String, path and array functions of the engine, as column expressions that stay in the JVM."""

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A cut between the parts of an identifier: lower or digit before upper, a capital that begins a word after capitals, or any other character.
CUT = r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[^A-Za-z0-9]+"


def ascii_lower(text: Column) -> Column:
    """Folds A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Distinct indexed words: maximal ASCII word runs of 2 to 64 characters, case kept."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), lambda w: F.length(w).between(2, 64)))


def grams(text: Column) -> Column:
    """Distinct three-character keys of a text, A-Z folded, none across a line end."""
    return F.array_distinct(F.regexp_extract_all(ascii_lower(text), F.lit(r"(?=([^\n]{3}))"), F.lit(1)))


def gram_code(gram: str) -> int:
    """A three-character key as a number: 21 bits for each code point."""
    a, b, c = map(ord, gram)
    return a << 42 | b << 21 | c


def pieces(word: Column) -> Column:
    """Parts of an identifier with three characters or more, lower case, in order."""
    return F.transform(F.filter(F.split(word, CUT), lambda p: F.length(p) >= 3), ascii_lower)


def split_tokens(name: Column) -> Column:
    """pieces() without repeats."""
    return F.array_distinct(pieces(name))


def is_identifier(text: Column) -> Column:
    return text.rlike(r"^[A-Za-z_$][A-Za-z0-9_$]*$")


def constant_style(name: Column) -> Column:
    """A name of capitals, digits and underscores, two characters or more."""
    return name.rlike(r"^[A-Z_][A-Z0-9_]+$") & name.rlike("[A-Z]")


def regex_escape(literal: str) -> str:
    """A pattern that matches ``literal`` alone."""
    return "".join("\\" + c if c in r"\.+*?()|[]{}^$#&-~/" else c for c in literal)


def byte_offset(text: Column, chars: Column) -> Column:
    """Bytes before the character numbered ``chars`` (from 0)."""
    return F.octet_length(F.substr(text, F.lit(1), chars))


def parent(path: Column) -> Column:
    """The directory of a path, empty at the root."""
    return F.regexp_replace(path, F.lit("(^|/)[^/]*$"), F.lit(""))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "[^/]*$", 0)


def extension(path: Column) -> Column:
    """What follows the last dot of the file's name, empty without one."""
    return F.regexp_extract(path, r"\.([^./]*)$", 1)


def path_key(path: Column) -> Column:
    """Sorts name by name: the separator comes before every other character."""
    return F.translate(path, "/", "\u0001")


def normal_path(path: Column) -> Column:
    """Without ``./``, doubled separators and a trailing one."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(path, F.lit(r"(^|/)(\./)+"), F.lit("$1")), F.lit("/+"), F.lit("/")), F.lit("(?<=.)/$"), F.lit(""))


def clip(line: Column, start: Column, end: Column, most: int = 200) -> Column:
    """At most ``most`` characters of a line around a match, with marks where it is cut."""
    room = F.greatest(F.lit(0), F.floor((F.lit(most) - (end - start)) / 2)).cast("int")
    begin = F.greatest(F.lit(0), F.least(start - room, F.length(line) - most)).cast("int")
    cut = F.concat(F.when(begin > 0, F.lit("…")).otherwise(F.lit("")), F.substr(line, begin + 1, F.lit(most)), F.when(begin + most < F.length(line), F.lit("…")).otherwise(F.lit("")))
    return F.when(F.length(line) <= most, line).otherwise(cut)


def normalize_query(query: Column) -> Column:
    """The sorted distinct lower-case tokens of a query: equal for queries that ask the same."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(F.filter(F.split(query, "[^A-Za-z0-9]+"), lambda w: w != ""), ascii_lower))), " ")
