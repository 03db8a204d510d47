"""Definitions and imports of one code text: plain Python over its tokens, applied to many files by operators.symbols.

A definition is found where a statement or a member of a body begins: annotations and modifiers are skipped, and the
word that follows is a keyword of the language's table, or (in a body that holds members) a name. So heads, bases
and imports may go on over any number of lines. Offsets are characters. A language is added by adding a row to LANGUAGES and a
function that reads one definition.
"""

import re
from bisect import bisect_left
from dataclasses import dataclass, field

from textquarry.functions.lexer import STRING, Tokens, blanked, spans

#: Kinds that hold members, and that give a block of their own.
TYPES = {"class", "struct", "enum", "trait", "interface", "object", "impl"}
BLOCKS = TYPES | {"function", "method", "module", "macro"}


@dataclass(frozen=True)
class Language:
    """Words that begin a definition with the kind they give, and words that may stand before them."""

    keywords: dict[str, str]
    modifiers: frozenset = frozenset()
    indented: bool = False


_SCRIPT = Language(
    {"function": "function", "class": "class", "interface": "interface", "enum": "enum", "namespace": "module", "module": "module", "type": "type", "const": "variable", "let": "variable", "var": "variable"},
    frozenset("export default declare abstract async const static public private protected readonly override get set accessor".split()),
)
LANGUAGES = {
    "python": Language({"def": "function", "class": "class"}, frozenset(["async"]), indented=True),
    "rust": Language(
        {"fn": "function", "struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "type": "type", "mod": "module", "const": "constant", "static": "constant", "macro_rules": "macro", "impl": "impl"},
        frozenset("pub async const unsafe default extern safe".split()),
    ),
    "javascript": _SCRIPT,
    "typescript": _SCRIPT,
    "kotlin": Language(
        {"fun": "function", "class": "class", "interface": "interface", "object": "object", "val": "variable", "var": "variable", "typealias": "type"},
        frozenset("public private protected internal open abstract final sealed data enum annotation inner inline value suspend operator infix override external tailrec lateinit const companion expect actual crossinline noinline vararg fun".split()),
    ),
}
#: Words that begin statements of other sorts: no member has such a name.
_NO_MEMBER = frozenset("if for while switch catch return function new typeof await yield throw delete else do try case super this".split())


@dataclass
class Definition:
    """What one reader found: kind, the tokens of the name and of the first word, and what its head says."""

    kind: str
    name: int
    head: int
    mods: set = field(default_factory=set)
    attributes: list = field(default_factory=list)
    supers: list = field(default_factory=list)
    body: int = -1  # the token that opens its block
    stop: int = -1  # the first token that is not its own
    lead: int = -1  # the token that begins its annotations, if it has any
    label: str = ""  # its name, where the token is not the name
    owner: "Definition | None" = None


def _head(t: Tokens, k: int, rules: Language) -> tuple[int, dict]:
    """What stands before a definition's keyword or name: the token of that word, and head, lead, mods and attributes of the definition."""
    lead, begin = k, k
    mods: set = set()
    attributes: list = []
    while k < len(t):
        w = t.words[k]
        if w == "@" and not rules.indented and t.named(k + 1):
            after = k + 2
            while t.word(after) in (".", ":"):
                after += 2
            if t.word(after) == "(":
                after = t.past(after)
            attributes.append(t.words[k + 1 : after])
            k = after
            begin = begin if mods else k
        elif w == "#" and t.word(k + 1) == "[":
            attributes.append(t.words[k + 2 : t.past(k + 1) - 1])
            k = t.past(k + 1)
            begin = begin if mods else k
        elif w in rules.modifiers and _prefixes(t, k, rules):
            mods.add(w)
            k += 1
            if w == "pub" and t.word(k) == "(":
                mods.add("restricted")
                k = t.past(k)
        else:
            break
    return k, {"head": begin, "lead": lead, "mods": mods, "attributes": attributes}


def _prefixes(t: Tokens, k: int, rules: Language) -> bool:
    """Whether the modifier at ``k`` stands before a definition, and is not its keyword or a name itself."""
    n = k + 1
    if t.words[k] == "pub" and t.word(n) == "(":
        n = t.past(n)
    follows = t.word(n)
    if follows in rules.modifiers or follows in rules.keywords:
        return True
    return t.words[k] not in rules.keywords and (t.named(n) or follows in ("*", "#", "[", "@"))


def _names(t: Tokens, k: int, stop: int, cuts: tuple = (",",), leave: tuple = ()) -> list[str]:
    """The last name of each dotted or ``::`` path in a list, without what stands in brackets, angles or after ``leave`` words."""
    out: list[str] = []
    name, depth, done = "", 0, False
    while k <= stop:
        w = t.word(k) if k < stop else cuts[0]
        if w in cuts and depth == 0 or k >= stop:
            if name:
                out.append(name)
            name, done = "", False
        elif w == "<":
            depth += 1
        elif w == ">":
            depth -= 1
        elif w in ("(", "["):
            done, k = True, t.past(k) - 1
        elif depth == 0 and w in leave:
            done = True
        elif depth == 0 and not done and t.named(k) and t.word(k - 1) != "'":
            name = w.strip("`")
        k += 1
    return out


def _body(t: Tokens, k: int, ends: tuple = (";",)) -> int:
    """The token that opens the block of a head whose name is before ``k``, or -1 if the head ends without one."""
    level = t.inside[k - 1]
    while k < len(t) and t.inside[k] == level and t.words[k] not in ends:
        if t.words[k] == "{":
            return k
        if t.first[k] and not _continues(t, k):
            return -1
        k = t.past(k)
    return -1


def _continues(t: Tokens, k: int) -> bool:
    """Whether the first token of a line goes on with the statement of the line before."""
    return t.words[k] in _GOES_ON or t.word(k - 1) in _LEFT_OPEN


_GOES_ON = frozenset("{ . ? : , ) ] } = == => -> :: & | + * / < > where extends implements with by".split())
_LEFT_OPEN = frozenset(", = == => -> :: & | + - * / < ( [ { . : ? extends implements with by".split())


def _statement_end(t: Tokens, k: int) -> int:
    """The first token after the statement that goes on at ``k``: behind its semicolon, or what begins the next line."""
    level = t.inside[k]
    while k < len(t) and t.inside[k] == level:
        if t.words[k] == ";":
            return k + 1
        after = t.past(k)
        if after < len(t) and t.first[after] and t.inside[after] == level and not _continues(t, after):
            return after
        k = after
    return k


def _close(t: Tokens, d: Definition) -> Definition:
    """Sets where a definition of a braced language stops."""
    if d.body >= 0:
        d.stop = t.past(d.body)
    elif d.kind in ("field", "variant"):
        k, level = d.name, t.inside[d.name]
        while k < len(t) and t.inside[k] == level and t.words[k] not in (",", ";") and not (k > d.name and t.first[k] and not _continues(t, k)):
            k = t.past(k)
        d.stop = k
    else:
        d.stop = _statement_end(t, d.name)
    return d


# ---- one definition of each language -------------------------------------------------------------------------------
def _rust(t: Tokens, k: int, holder: Definition | None) -> list[Definition]:
    at, about = _head(t, k, LANGUAGES["rust"])
    word = t.word(at)
    kind = LANGUAGES["rust"].keywords.get(word)
    make = lambda **how: [_close(t, Definition(**about, **how))]
    if holder and holder.kind in ("struct", "enum") and not kind and t.named(at):
        if holder.kind == "enum":
            return make(kind="variant", name=at)
        return make(kind="field", name=at) if t.word(at + 1) == ":" else []
    if not kind:
        return []
    if kind == "impl":
        first = t.after_angles(at + 1)
        body = first
        while body < len(t) and t.words[body] not in ("{", ";"):
            body = t.past(body)
        head_end = next((j for j in range(first, body) if t.words[j] == "where"), body)
        split = next((j for j in range(first, head_end) if t.words[j] == "for" and t.word(j + 1) != "<"), -1)
        of = _path_name(t, first if split < 0 else split + 1, head_end)
        base = _path_name(t, first, split) if split > 0 else -1
        return make(kind="impl", name=of, supers=[t.words[base]] if base >= 0 else [], body=body if t.word(body) == "{" else -1) if of >= 0 else []
    name = at + 1
    if word == "macro_rules":
        name = at + 2
    elif word == "static" and t.word(name) == "mut":
        name += 1
    if not t.named(name) or (word == "union" and t.word(name + 1) not in ("{", "<")):
        return []
    if kind in ("constant", "type"):
        return make(kind=kind, name=name)
    body = _rust_body(t, name + 1)
    stop = next((j for j in range(name, body if body >= 0 else name) if t.words[j] == "where"), body)
    supers = []
    if kind == "trait" and body >= 0:
        colon = t.after_angles(name + 1)
        supers = _names(t, colon + 1, stop, cuts=("+",)) if t.word(colon) == ":" else []
    return make(kind=kind, name=name, supers=supers, body=body)


def _rust_body(t: Tokens, k: int) -> int:
    """The brace of an item, or -1 if a semicolon ends it first."""
    level = t.inside[k - 1]
    while k < len(t) and t.inside[k] == level and t.words[k] != ";":
        if t.words[k] == "{":
            return k
        k = t.past(k)
    return -1


def _path_name(t: Tokens, k: int, stop: int) -> int:
    """The last name of the first path from ``k`` on, outside angles and brackets; -1 if there is none."""
    found, depth = -1, 0
    while k < stop:
        w = t.words[k]
        depth += (w == "<") - (w == ">")
        if depth == 0 and t.named(k) and w not in ("dyn", "mut", "const") and t.word(k - 1) != "'":
            found = k
        k = t.past(k)
    return found


def _script(t: Tokens, k: int, holder: Definition | None) -> list[Definition]:
    at, about = _head(t, k, _SCRIPT)
    word = t.word(at)
    kind = _SCRIPT.keywords.get(word)
    make = lambda **how: [_close(t, Definition(**about, **how))]
    if holder and holder.kind == "enum":
        return make(kind="variant", name=at) if t.named(at) else []
    if holder and holder.kind in ("class", "interface"):
        at += t.word(at) in ("*", "#")
        if word == "#":
            about["mods"].add("private")
        if not t.named(at) or t.words[at] in _NO_MEMBER:
            return []
        after = at + 1 + (t.word(at + 1) in ("?", "!"))
        if t.word(t.after_angles(after)) == "(":
            return make(kind="method", name=at, body=_body(t, t.past(t.after_angles(after)), (";", "}")) if t.after_angles(after) < len(t) else -1)
        return make(kind="field", name=at) if t.word(after) in (":", "=", ";", "}") or t.first[min(after, len(t) - 1)] else []
    if kind == "function":
        name = at + 1 + (t.word(at + 1) == "*")
        return make(kind=kind, name=name, body=_body(t, name + 1)) if t.named(name) else []
    if kind in ("class", "interface"):
        name = at + 1
        if not t.named(name) or t.words[name] in ("extends", "implements"):
            return []
        body = _body(t, name + 1)
        begins = [j for j in range(name + 1, max(body, name + 1)) if t.words[j] in ("extends", "implements")]
        ends = [*begins[1:], body]
        return make(kind=kind, name=name, supers=[n for a, b in zip(begins, ends, strict=False) for n in _names(t, a + 1, b)], body=body)
    if kind in ("enum", "module"):
        name = at + 1
        return make(kind=kind, name=name, body=_body(t, name + 1)) if t.named(name) and _body(t, name + 1) >= 0 else []
    if kind == "type":
        return make(kind=kind, name=at + 1) if t.named(at + 1) and t.word(t.after_angles(at + 2)) == "=" else []
    if kind == "variable":
        return _variables(t, at, about, holder)
    if t.named(at) and not about["mods"]:  # a function given to a key or to a member
        j = at
        while t.word(j + 1) == "." and t.named(j + 2):
            j += 2
        if t.word(j + 1) in ((":",) if j == at else ("=",)) and _gives_function(t, j + 2):
            return make(kind="function", name=j)
    return []


def _variables(t: Tokens, at: int, about: dict, holder: Definition | None) -> list[Definition]:
    """Names that a declaration of a module or of the file's top gives; those of inner blocks are locals."""
    if t.inside[at] >= 0 and not (holder and holder.kind == "module"):
        return []
    out, stop, j = [], _statement_end(t, at), at + 1
    while j < stop and t.named(j):
        value = j + 1
        while value < stop and t.words[value] not in ("=", ",", ";"):
            value = t.past(value)
        kind = "function" if t.word(value) == "=" and _gives_function(t, value + 1) else "variable"
        end = value
        while end < stop and t.words[end] not in (",", ";"):
            end = t.past(end)
        out.append(Definition(kind, j, **(about if not out else about | {"head": j, "lead": j}), stop=end if t.word(end) == "," else stop))
        j = end + 1
    return out


def _gives_function(t: Tokens, k: int) -> bool:
    """Whether an arrow or a function expression begins at ``k``."""
    k += t.word(k) == "async"
    if t.word(k) == "function":
        return True
    k = t.after_angles(k)
    if t.named(k):
        return t.word(k + 1) == "=>"
    if t.word(k) != "(":
        return False
    k = t.past(k)
    if t.word(k) == ":":
        level = t.inside[k]
        while k < len(t) and t.inside[k] == level and t.words[k] not in ("=>", ",", ";", "="):
            k = t.past(k)
    return t.word(k) == "=>"


def _kotlin(t: Tokens, k: int, holder: Definition | None) -> list[Definition]:
    rules = LANGUAGES["kotlin"]
    at, about = _head(t, k, rules)
    word = t.word(at)
    kind = rules.keywords.get(word)
    make = lambda **how: [_close(t, Definition(**about, **how))]
    if holder and holder.kind == "enum" and not kind and not about["mods"] and t.named(at) and word not in ("init", "constructor"):
        begins = t.word(at - 1) in ("{", ",") or bool(about["attributes"])
        entry = begins and not any(t.words[j] == ";" and t.inside[j] == holder.body for j in range(holder.body, at))
        return make(kind="variant", name=at) if entry else []
    if word == "constructor" and holder and t.word(at + 1) == "(":
        return make(kind="method", name=at, body=_body(t, t.past(at + 1)))
    if not kind or (kind == "variable" and t.inside[at] >= 0 and not (holder and holder.kind in TYPES)):
        return []
    name = t.after_angles(at + 1)
    if kind == "object" and "companion" in about["mods"] and (not t.named(name) or t.first[name]):
        return make(kind=kind, name=at, label="Companion", body=_body(t, at + 1))
    if kind == "variable" and t.word(name) == "(":
        return [_close(t, Definition("variable", j, **(about | {"head": j}))) for j in range(name + 1, t.partner.get(name, name)) if t.named(j) and t.word(j - 1) in ("(", ",")]
    if kind in ("function", "variable"):  # a receiver stands before the name
        while t.named(name) or t.word(name) == "(":
            after = t.past(name) if t.word(name) == "(" else t.after_angles(name + 1)
            after += t.word(after) == "?"
            if t.word(after) != ".":
                break
            name = after + 1
    if not t.named(name):
        return []
    if kind == "class" and "enum" in about["mods"]:
        kind = "enum"
    if kind in ("class", "interface", "object", "enum"):
        body = _body(t, name + 1)
        end = body if body >= 0 else _statement_end(t, name)
        colon = next((j for j in _level(t, name + 1, end) if t.words[j] == ":"), -1)
        where = next((j for j in _level(t, name + 1, end) if t.words[j] == "where"), end)
        found = make(kind=kind, name=name, supers=_names(t, colon + 1, where, leave=("by",)) if colon > 0 else [], body=body)
        group = t.after_angles(name + 1)
        while t.word(group) not in ("(", "{", ":", "") and group < end:
            group += 1
        if t.word(group) == "(":  # what the constructor declares
            for j in range(group + 1, t.partner.get(group, group)):
                if t.words[j] in ("val", "var") and t.named(j + 1) and t.inside[j] == group:
                    stop = next((i for i in _level(t, j, t.partner[group]) if t.words[i] == ","), t.partner[group])
                    found.append(Definition("field", j + 1, j, {w for w in t.words[max(group, j - 3) : j] if w in rules.modifiers}, stop=stop, owner=found[0]))
        return found
    if kind == "function":
        given = next((j for j in _level(t, name + 1, _statement_end(t, name)) if t.words[j] in ("=", "{")), -1)
        return make(kind=kind, name=name, body=given if t.word(given) == "{" else -1)
    if kind == "variable" and holder and holder.kind in TYPES:
        kind = "field"
    return [Definition(kind, name, **about, stop=_statement_end(t, name))]


def _level(t: Tokens, k: int, stop: int):
    """Tokens from ``k`` to ``stop`` that lie in no inner bracket."""
    while 0 <= k < stop:
        yield k
        k = t.past(k)


_READERS = {"rust": _rust, "javascript": _script, "typescript": _script, "kotlin": _kotlin}


def _braced(t: Tokens, lang: str) -> list[Definition]:
    """Definitions of a language with braces, in order."""
    out: list[Definition] = []
    bodies: dict[int, Definition] = {}
    seen: set[int] = set()
    for k in range(len(t)):
        holder = bodies.get(t.inside[k])
        before = t.word(k - 1)
        if not (t.first[k] or before in ("{", "}", ";") or (before == "," and holder)):
            continue
        if t.inside[k] >= 0 and t.words[t.inside[k]] != "{":
            continue
        for d in _READERS[lang](t, k, holder):
            if d.name not in seen:
                seen.add(d.name)
                out.append(d)
                if d.body >= 0:
                    bodies[d.body] = d
    return out


def _indented(t: Tokens) -> list[Definition]:
    """Definitions of Python: blocks by indentation, names that modules and classes assign, attributes that methods give to themselves."""
    starts = [k for k in range(len(t)) if t.first[k] and t.inside[k] < 0 and t.words[k] not in (")", "]", "}") and t.word(k - 1) != "\\"]
    columns = [t.at[k] - (t.clean.rfind("\n", 0, t.at[k]) + 1) for k in starts]
    out: list[Definition] = []
    open_: list[tuple[int, Definition]] = []
    named: set[tuple[int, str]] = set()
    guard = ""
    for n, (k, column) in enumerate(zip(starts, columns, strict=True)):
        while open_ and column <= open_[-1][0]:
            open_.pop()
        if column == 0:
            guard = t.words[k]
        at, about = _head(t, k, LANGUAGES["python"])
        kind = LANGUAGES["python"].keywords.get(t.word(at))
        following = next((m for m in range(n + 1, len(starts)) if columns[m] <= column), len(starts))
        if kind and t.named(at + 1):
            d = Definition(kind, at + 1, **about, body=next((j for j in _level(t, at + 2, len(t)) if t.words[j] == ":"), -1), stop=starts[following] if following < len(starts) else len(t))
            if kind == "class" and t.word(t.after_angles(at + 2)) == "(":
                d.supers = _bases(t, t.after_angles(at + 2))
            out.append(d)
            open_.append((column, d))
            if len(open_) == 1:
                named.add((-1, t.words[at + 1]))
            continue
        own = t.words[k] in ("self", "cls") and t.word(k + 1) == "." and t.named(k + 2)
        name = k + 2 if own else k + 1 if t.words[k] == "type" and t.named(k + 1) else k
        if not t.named(name) or not (t.word(name + 1) == "=" or (t.word(name + 1) == ":" and (own or t.first[name] and t.words[k] not in _BLOCK_WORDS))):
            continue
        stop = starts[n + 1] if n + 1 < len(starts) else len(t)
        if own:
            holder = next((d for _, d in reversed(open_) if d.kind == "class"), None)
            if holder and open_[-1][1] is not holder and (holder.name, t.words[name]) not in named:
                named.add((holder.name, t.words[name]))
                out.append(Definition("field", name, k, stop=stop, owner=holder))
        elif open_ and open_[-1][1].kind == "class":
            if (open_[-1][1].name, t.words[name]) not in named:
                named.add((open_[-1][1].name, t.words[name]))
                out.append(Definition("field", name, k, stop=stop, owner=open_[-1][1]))
        elif not open_ and (column == 0 or guard in ("if", "elif", "else", "try", "except")):
            word = t.words[name]
            if (-1, word) in named:
                continue
            named.add((-1, word))
            styled = column == 0 and len(word) >= 3 and word.isascii() and word == word.upper() and not word[0].isdigit()
            out.append(Definition("type" if name == k + 1 else "constant" if styled else "variable", name, k, stop=stop))
    return out


_BLOCK_WORDS = frozenset("if elif else for while try except finally with match case lambda class def return".split())


def _bases(t: Tokens, group: int) -> list[str]:
    """The last name of each positional argument of a class head."""
    stop, k, out = t.partner.get(group, group), group + 1, []
    while k < stop:
        end = next((j for j in _level(t, k, stop) if t.words[j] == ","), stop)
        if not any(t.words[j] == "=" for j in _level(t, k, end)) and t.word(k) != "*":
            out += _names(t, k, end)[:1]
        k = end + 1
    return out


# ---- symbols -------------------------------------------------------------------------------------------------------
def symbols(text: str, lang: str | None) -> list[dict]:
    """Definitions with kind, places, line, parent (an index), chain of parents' names, supertypes and flags."""
    return extract(text, lang, ("symbols",))["symbols"]


def imports(text: str, lang: str | None) -> list[dict]:
    """Import statements: start, end, module, names (empty for a plain import), wildcard."""
    return extract(text, lang, ("imports",))["imports"]


def extract(text: str, lang: str | None, parts: tuple = ("symbols", "spans", "imports")) -> dict[str, list]:
    """``symbols``, ``spans`` and ``imports`` of a text, read once; all empty without rules for its language. Nothing is looked for but ``parts``."""
    out: dict[str, list] = {"symbols": [], "spans": [], "imports": []}
    if lang not in LANGUAGES:
        return out
    hidden = out["spans"] = spans(text, lang)
    if "symbols" not in parts and "imports" not in parts:
        return out
    t = Tokens(blanked(text, hidden))
    if "symbols" in parts:
        found = _indented(t) if LANGUAGES[lang].indented else _braced(t, lang)
        out["symbols"] = _finished(text, t, found, hidden, lang)
    if "imports" in parts:
        out["imports"] = _IMPORTS[lang](text, t, hidden)
    return out


def _finished(text: str, t: Tokens, found: list[Definition], hidden: list, lang: str) -> list[dict]:
    """Rows in order of place, with parents by containment (or as an owner says)."""
    docs = [(a, b) for a, b, kind in hidden if kind == "doc"]
    ends = [b for _, b in docs]
    string_ends = {a: b for a, b, _ in hidden}
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    rows = sorted(found, key=lambda d: (t.at[d.head], t.at[d.name]))
    number = {id(d): k for k, d in enumerate(rows)}
    out: list[dict] = []
    stack: list[int] = []
    for d in rows:
        start = t.at[d.head]
        last = max(d.name, d.stop - 1)
        end = string_ends.get(t.at[last], t.end(last)) if last < len(t) else len(text)
        while stack and out[stack[-1]]["end"] <= start:
            stack.pop()
        up = number[id(d.owner)] if d.owner else stack[-1] if stack else None
        holder = out[up] if up is not None else None
        name = d.label or t.words[d.name].strip("`")
        kind = "method" if d.kind == "function" and holder and holder["kind"] in TYPES else d.kind
        head_end = t.end(d.body) if lang == "python" and d.body >= 0 else t.at[d.body] if d.body >= 0 else min(end, _line_end(text, t.end(d.name)))
        row = {
            "kind": kind, "name": name, "name_start": t.at[d.name], "name_end": t.end(d.name), "line": bisect_left(lines, t.at[d.name] + 1), "start": start, "end": end, "supers": d.supers, "parent": up,
            "chain": [*holder["chain"], holder["name"]] if holder else [], "exported": _exported(d, name, kind, lang), "test": _is_test(d, name, lang), "doc": _documented(t, d, docs, ends, lang),
            "head": " ".join(text[start:head_end].split()),
        }
        if kind in BLOCKS:
            stack.append(len(out))
        out.append(row)
    return out


def _line_end(text: str, at: int) -> int:
    end = text.find("\n", at)
    return len(text) if end < 0 else end


def _documented(t: Tokens, d: Definition, docs: list, ends: list, lang: str) -> bool:
    """Whether a doc stands right before a definition, or begins its block in Python."""
    if lang == "python":
        if d.body < 0:
            return False
        k = bisect_left(docs, (t.end(d.body), 0))
        return k < len(docs) and not t.clean[t.end(d.body) : docs[k][0]].strip()
    first = d.lead if d.lead >= 0 else d.head
    k = bisect_left(ends, t.at[first] + 1) - 1
    return k >= 0 and not t.clean[ends[k] : t.at[first]].strip()


def _exported(d: Definition, name: str, kind: str, lang: str) -> bool:
    """Visible from outside, as each language says."""
    if lang == "python":
        return not name.startswith("_") or (name.startswith("__") and name.endswith("__") and len(name) > 4)
    if lang == "rust":
        return "pub" in d.mods and "restricted" not in d.mods
    if lang == "kotlin":
        return not d.mods & {"private", "internal"}
    return "export" in d.mods or (kind in ("method", "field") and "private" not in d.mods)


def _is_test(d: Definition, name: str, lang: str) -> bool:
    """A test by its name, or by what stands before it."""
    if lang == "python":
        return name.startswith(("test_", "Test"))
    if name.startswith("test"):
        return True
    if lang == "rust":
        for words in d.attributes:
            path = words[: words.index("(")] if "(" in words else words
            last = path[-1] if path else ""
            if last in ("test", "wasm_bindgen_test") or last.startswith("rstest") or (last == "cfg" and d.kind == "module" and words[1:] == ["(", "test", ")"]):
                return True
    return lang == "kotlin" and any(words[:1] == ["Test"] for words in d.attributes)


def definition_on_line(line: str, lang: str | None, start: int, end: int) -> bool:
    """Whether a place of a line, read alone, lies on the name that the line defines."""
    return any(s["name_start"] < end and start < s["name_end"] for s in symbols(line, lang))


# ---- imports -------------------------------------------------------------------------------------------------------
def _row(t: Tokens, first: int, last: int, module: str, names: list[str] | None = None, wildcard: bool = False) -> dict:
    return {"start": t.at[first], "end": t.end(last), "module": module, "names": names or [], "wildcard": wildcard}


def _python_imports(text: str, t: Tokens, hidden: list) -> list[dict]:
    out = []
    for k in range(len(t)):
        if t.inside[k] >= 0 or t.words[k] not in ("import", "from") or not (t.first[k] or t.word(k - 1) in (";", ":")):
            continue
        stop = next((j for j in range(k + 1, len(t)) if t.words[j] == ";" or (t.first[j] and t.inside[j] < 0 and t.words[j] != ")" and not _joined(t, j))), len(t))
        if t.words[k] == "import":
            out += [_row(t, k, stop - 1, module) for module, _ in _items(t, k + 1, stop)]
            continue
        at = next((j for j in range(k + 1, stop) if t.words[j] == "import"), -1)
        if at < 0:
            continue
        names = [n for n, _ in _items(t, at + 1 + (t.word(at + 1) == "("), stop)]
        wild = t.word(at + 1) == "*"
        out.append(_row(t, k, stop - 1, "".join(t.words[k + 1 : at]), [] if wild else names, wild))
    return out


def _joined(t: Tokens, k: int) -> bool:
    """Whether a backslash joins the line that begins at ``k`` to the one before."""
    return t.word(k - 1) == "\\"


def _items(t: Tokens, k: int, stop: int) -> list[tuple[str, str]]:
    """(dotted name, alias) of each item of a list."""
    out, name, alias, aliased = [], "", "", False
    for j in range(k, stop + 1):
        w = t.word(j) if j < stop else ","
        if w in (",", ")", "}"):
            if name:
                out.append((name, alias))
            name, alias, aliased = "", "", False
        elif w == "as":
            aliased = True
        elif aliased:
            alias = w
        elif w not in ("\\", "(", "{", "type") or (w == "type" and t.word(j + 1) in (",", "}")):
            name += w
    return out


def _rust_imports(text: str, t: Tokens, hidden: list) -> list[dict]:
    out = []
    for k in range(len(t)):
        if not (t.first[k] or t.word(k - 1) in ("{", "}", ";", "]")):
            continue
        at, _ = _head(t, k, LANGUAGES["rust"])
        if t.word(at) == "pub":
            at = t.past(at + 1) if t.word(at + 1) == "(" else at + 1
        if t.word(at) == "extern" and t.word(at + 1) == "crate":
            at += 1
        stop = next((j for j in _level(t, at, len(t)) if t.words[j] == ";"), len(t))
        if t.word(at) == "use":
            out += [_row(t, k, stop, module, [name] if name and name != "*" else [], name == "*") for module, name in _branches(t.words[at + 1 : stop], "")]
        elif t.word(at) == "crate" and t.named(at + 1):
            out.append(_row(t, k, stop, t.words[at + 1]))
        elif t.word(at) == "mod" and t.word(at + 2) == ";":
            out.append(_row(t, k, stop, "self::" + t.words[at + 1]))
    return out


def use_tree(tree: str) -> list[tuple[str, str]]:
    """(module, name) pairs of a Rust use tree: ``a::{b, c::d}`` is (a, b), (a::c, d)."""
    return _branches(Tokens(tree).words, "")


def _branches(words: list[str], above: str) -> list[tuple[str, str]]:
    """The pairs of a tree's words below the path ``above``."""
    if "as" in words and "{" not in words:
        words = words[: words.index("as")]
    if "{" not in words:
        path = [w for w in words if w != "::"]
        if path == ["self"] and above:
            return [(above, "")]
        whole = [p for p in (above, *path) if p]
        return [("::".join(whole[:-1]), whole[-1]) if len(whole) > 1 else (whole[0], "")] if path else []
    at = words.index("{")
    below = "::".join(p for p in (above, *(w for w in words[:at] if w != "::")) if p)
    out, item, depth = [], [], 0
    for w in words[at + 1 :]:
        if depth == 0 and w in (",", "}"):
            out += _branches(item, below)
            item = []
            if w == "}":
                break
        else:
            depth += (w == "{") - (w == "}")
            item.append(w)
    return out


def _script_imports(text: str, t: Tokens, hidden: list) -> list[dict]:
    ends = {a: b for a, b, _ in hidden}

    def quoted(k: int) -> str | None:
        """What the string after the token numbered ``k`` holds."""
        return text[t.at[k + 1] + 1 : ends[t.at[k + 1]] - 1] if t.word(k + 1) == STRING else None

    out = []
    for k, w in enumerate(t.words):
        begins = t.first[k] or t.word(k - 1) in (";", "{", "}")
        if w in ("require", "import") and t.word(k + 1) == "(" and t.word(k - 1) != ".":
            first, names = k, []
            if (found := quoted(k + 1)) is not None:
                if t.word(k - 1) == "=" and t.word(k - 2) == "}":
                    opening = next((a for a, b in t.partner.items() if b == k - 2), k - 2)
                    first = opening - 1
                    names = [n.split(":")[0] for n, _ in _items(t, opening + 1, k - 2)]
                out.append(_row(t, first, k + 3, found, names))
        elif begins and w in ("import", "export"):
            level = t.inside[k]
            at = next((j for j in _level(t, k + 1, min(len(t), k + 4000)) if t.words[j] in ("from", ";", "=", "(") or (t.words[j] in ("import", "export", "const", "function", "class") and j > k + 1) or t.inside[j] != level), -1)
            source = k if w == "import" and quoted(k) is not None else at if t.word(at) == "from" else -1
            found = quoted(source) if source >= 0 else None
            if found is not None:
                stop = source
                opening = next((j for j in range(k, stop) if t.words[j] == "{"), stop)
                names = [n for n, _ in _items(t, opening + 1, t.partner.get(opening, opening))]
                if w == "import" and stop > k and t.named(k + 1) and t.words[k + 1] not in ("type", "from"):
                    names.insert(0, "default")
                out.append(_row(t, k, stop + 1, found, names, "*" in t.words[k:stop]))
    return out


def _kotlin_imports(text: str, t: Tokens, hidden: list) -> list[dict]:
    out = []
    for k in range(len(t)):
        if t.words[k] == "import" and t.first[k] and t.inside[k] < 0:
            stop = next((j for j in range(k + 1, len(t)) if t.first[j] or t.words[j] in (";", "as")), len(t))
            wild = t.word(stop - 1) == "*"
            end = next((j for j in range(stop, len(t)) if t.first[j] or t.words[j] == ";"), len(t))
            out.append(_row(t, k, end - 1, "".join(t.words[k + 1 : stop - 2 if wild else stop]).replace("`", ""), [], wild))
    return out


_IMPORTS = {"python": _python_imports, "rust": _rust_imports, "javascript": _script_imports, "typescript": _script_imports, "kotlin": _kotlin_imports}
