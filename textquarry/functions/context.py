"""What a match is, judged by its line alone: import, call, type, member or ident. Rules stand in order; the first that answers wins."""

from functools import cached_property

from textquarry.functions.code import LANGUAGES
from textquarry.functions.lexer import Tokens

SCRIPT = ("javascript", "typescript")
#: Words after which a value stands, and words after which a type stands.
VALUE_WORDS = frozenset("let mut in match return if while await not and or else yield const var val typeof delete".split())
TYPE_WORDS = frozenset("impl dyn as extends implements struct enum trait interface class is instanceof where for".split())
TYPE_HEADS = frozenset("class interface object struct trait".split())
HEAD_WORDS = frozenset("export pub abstract open data".split())
#: Python names that take types in brackets.
GENERIC_NAMES = frozenset("list dict set tuple List Dict Set Tuple Optional Union Iterable Sequence".split())


class Place:
    """A match on a line: the tokens on both sides of it."""

    def __init__(self, line: str, start: int, end: int, lang: str):
        self.line, self.start, self.end, self.lang = line, start, end, lang
        self.tight_before, self.tight_after = line[start - 1 : start] if start else "", line[end : end + 1]

    @cached_property
    def before(self) -> list[str]:
        return Tokens(self.line[: self.start]).words

    @cached_property
    def after(self) -> Tokens:
        return Tokens(self.line[self.end :])

    def back(self, n: int = 1) -> str:
        """The token ``n`` places before the match."""
        return self.before[-n] if len(self.before) >= n else ""

    @property
    def spaced(self) -> bool:
        """Whether white space stands before the match."""
        return self.tight_before.isspace()

    @property
    def capital(self) -> bool:
        return self.line[self.start : self.start + 1].isupper()

    @property
    def after_type_word(self) -> bool:
        return self.spaced and self.back() in TYPE_WORDS


def import_line(line: str, lang: str | None) -> bool:
    """Whether a line imports, by its first words."""
    words = Tokens(line).words
    first, second = (words + ["", ""])[:2]
    if lang == "python":
        return first in ("import", "from") and second != "="
    if lang == "kotlin":
        return first == "import"
    if lang == "rust":
        if first == "pub":
            words = words[words.index(")") + 1 if second == "(" and ")" in words else 1 :]
            first, second = (words + ["", ""])[:2]
        return first == "use" or (first == "extern" and second == "crate")
    if lang in SCRIPT:
        return (first == "import" and second not in ("(", ".", "=")) or (first == "export" and "from" in words) or (first in VALUE_WORDS and "require" in words[:-1] and words[words.index("require") + 1] == "(")
    return False


def _import(p: Place):
    return "import" if import_line(p.line, p.lang) else None


def _call(p: Place):
    return "call" if p.after.word(0) == "(" or p.line[p.start : p.end].endswith("(") else None


def _new(p: Place):
    return "call" if p.lang in SCRIPT and p.spaced and p.back() == "new" else None


def _type_arguments(p: Place):
    if p.lang not in ("rust", "typescript", "kotlin") or p.tight_after != "<" or p.line[p.end + 1 : p.end + 2] in ("", " ", "\t", "=") or p.line[p.end + 1].isdigit():
        return None
    stop = p.after.after_angles(0)
    return "call" if stop and p.after.word(stop) == "(" else "type"


def _literal(p: Place):
    """``Name {`` where a value is wanted builds one."""
    if p.lang not in ("rust", "kotlin") or p.after.word(0) != "{" or p.after_type_word:
        return None
    return "call" if p.back() in ("=", "(", ",", ".", "[", "!", "|", "::", "return") else None


def _value(p: Place):
    if p.after_type_word:
        return "type"
    if p.back() == "mut" and p.back(2) != "let":
        return None  # of a reference
    return "ident" if p.back() in VALUE_WORDS and p.spaced or p.back() == "=" else None


def _supertype(p: Place):
    words = [w for w in p.before if w not in HEAD_WORDS]
    return "type" if words and words[0] in TYPE_HEADS and p.back() in ("(", ":", ",") else None


def _reference(p: Place):
    """Behind ``&``, ``&mut``, ``*const`` and a lifetime a capital begins a type."""
    if p.lang != "rust":
        return None
    words = list(p.before)
    while words and words[-1] in ("mut", "dyn", "const"):
        words.pop()
    if len(words) > 2 and words[-2] == "'" and words[-3] == "&":
        del words[-2:]
    if words and (words[-1] == "&" or (words[-1] == "*" and len(words) < len(p.before))):
        return "type" if p.capital else "ident"
    return "type" if p.capital and p.line[p.end : p.end + 2] == "::" else None


def _annotation(p: Place):
    mark = p.back()
    if mark not in (":", "->") or p.lang == "javascript":
        return None
    if p.lang != "python" or mark == "->":
        return "type"
    named = len(p.before) == 2 or p.back(3) in ("(", ",")
    return "type" if named and p.back(2).isidentifier() else "ident"


def _generic(p: Place):
    closes = next((w for w in p.after.words if w in ("(", ")", ">")), "")
    if closes != ">":
        return None
    if p.back() == "<" and (p.back(2).isidentifier() or p.back(2) == ">") and not p.spaced:
        return "type"
    if p.back() != ",":
        return None
    for w in reversed(p.before):
        if w in ("(", ")", ">"):
            return None
        if w == "<":
            return "type"
    return None


def _subscript(p: Place):
    if p.lang != "python" or "[" not in p.before:
        return None
    depth = 0
    for k in range(len(p.before) - 1, 0, -1):
        if p.before[k] == "]":
            depth += 1
        elif p.before[k] == "[":
            if depth == 0 and p.before[k - 1] in GENERIC_NAMES:
                return "type"
            depth -= 1 if depth else 0
    return None


def _key(p: Place):
    return "member" if p.lang in SCRIPT and p.after.word(0) == ":" and p.back() in ("", "{", ",") else None


def _member(p: Place):
    return "member" if p.tight_before == "." or (p.back() == "::" and not p.spaced) else None


ORDER = (_import, _call, _new, _type_arguments, _literal, _value, _supertype, _reference, _annotation, _generic, _subscript, _key, _member)


def context_kind(line: str, start: int, end: int, lang: str | None) -> str:
    """Kind of a match by its line: the first rule of ORDER that answers, else ident."""
    if lang not in LANGUAGES:
        return "ident"
    place = Place(line, start, end, lang)
    return next((kind for rule in ORDER if (kind := rule(place))), "ident")
