"""Comments, strings and tokens of one code text, in plain Python. Offsets are characters."""

import re
from bisect import bisect_left
from dataclasses import dataclass

_REGEX_LITERAL = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_RUST_CHAR = re.compile(r"'(?:\\(?:u\{[^}\n]*\}|x..|[^\n])|[^\\'\n])'")
_TOKEN = re.compile(r"[^\W\d][\w$]*|\$[\w$]*|`[^`\n]+`|\d[\w.]*|->|=>|::|==|!=|<=|>=|[^\s\w]")
_VALUE_ENDS = frozenset(")]}")
_BEFORE_VALUE = frozenset("return typeof case in of delete void throw new else do yield await".split())


@dataclass(frozen=True)
class Lexis:
    """How a language writes comments and strings. ``opener`` finds what may begin one, by its named groups."""

    opener: re.Pattern
    nested: bool = False  # block comments nest
    over_lines: frozenset = frozenset()  # quotes whose strings go on over line ends
    filled: frozenset = frozenset()  # quotes in which ${...} is code


_C = r"(?P<line>//)|(?P<block>/\*)|"
LEXIS = {
    "python": Lexis(re.compile(r"(?P<line>#)|(?:(?<!\w)[rRbBuUfFtT]{1,2})?(?P<quote>'''|\"\"\"|'|\")"), over_lines=frozenset(["'''", '"""'])),
    "rust": Lexis(re.compile(_C + r"(?<!\w)(?P<raw>[bc]?r#*\")|(?:(?<!\w)[bc])?(?P<quote>[\"'])"), nested=True, over_lines=frozenset('"')),
    "javascript": Lexis(re.compile(_C + r"(?P<quote>[\"'`])|(?P<slash>/)"), over_lines=frozenset("`"), filled=frozenset("`")),
    "kotlin": Lexis(re.compile(_C + r"(?P<quote>\"\"\"|\"|')"), nested=True, over_lines=frozenset(['"""']), filled=frozenset(['"', '"""'])),
}
LEXIS["typescript"] = LEXIS["javascript"]


def _block_end(text: str, at: int, nested: bool) -> int:
    """Where a block comment that begins before ``at`` ends."""
    if not nested:
        end = text.find("*/", at)
        return len(text) if end < 0 else end + 2
    depth = 1
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        depth += 1 if m.group() == "/*" else -1
        if not depth:
            return m.end()
    return len(text)


def _string_end(text: str, at: int, quote: str, lexis: Lexis) -> int:
    """Where a string whose text begins at ``at`` ends: after its quote, or before the line end that cuts it off. A backslash keeps the quote after it, in raw strings too."""
    marks = re.escape(quote) + r"|\\[\s\S]" + ("" if quote in lexis.over_lines else r"|\n") + (r"|\$\{" if quote in lexis.filled else "")
    find = re.compile(marks)
    while m := find.search(text, at):
        at = m.end()
        if m.group() == quote:
            return at
        if m.group() == "\n":
            return m.start()
        if m.group() == "${":
            at = _filling_end(text, at, lexis)
    return len(text)


def _filling_end(text: str, at: int, lexis: Lexis) -> int:
    """The end of the code in a ``${...}`` whose text begins at ``at``."""
    depth = 1
    find = re.compile(r"[{}]|" + lexis.opener.pattern)
    while m := find.search(text, at):
        if m.group() in ("{", "}"):
            depth += 1 if m.group() == "{" else -1
            at = m.end()
            if not depth:
                return at
        else:
            at = _close(text, m, lexis)[0]
    return len(text)


def _starts_value(text: str, at: int) -> bool:
    """Whether a slash at ``at`` stands where a value begins, and so opens a pattern."""
    k = at - 1
    while k >= 0 and text[k] in " \t\r\n":
        k -= 1
    if k < 0:
        return True
    if text[k].isalnum() or text[k] in "_$":
        b = k
        while b >= 0 and (text[b].isalnum() or text[b] in "_$"):
            b -= 1
        return text[b + 1 : k + 1] in _BEFORE_VALUE
    return text[k] not in _VALUE_ENDS and text[k] not in "\"'`."


def _close(text: str, m: re.Match, lexis: Lexis) -> tuple[int, str | None]:
    """(end, kind) of what an opener begins; the kind is None where it begins nothing."""
    g = m.groupdict()
    if g.get("line"):
        end = text.find("\n", m.end())
        return (len(text) if end < 0 else end), "comment"
    if g.get("block"):
        return _block_end(text, m.end(), lexis.nested), "comment"
    if g.get("raw"):
        end = text.find('"' + "#" * g["raw"].count("#"), m.end())
        return (len(text) if end < 0 else end + 1 + g["raw"].count("#")), "string"
    if g.get("slash"):
        pattern = _REGEX_LITERAL.match(text, m.start()) if _starts_value(text, m.start()) else None
        return (pattern.end(), "string") if pattern else (m.end(), None)
    if g["quote"] == "'" and lexis is LEXIS["rust"]:
        char = _RUST_CHAR.match(text, m.end() - 1)
        return (char.end(), "string") if char else (m.end(), None)  # else a lifetime
    return _string_end(text, m.end(), g["quote"], lexis), "string"


def _is_doc(text: str, start: int, lang: str, kind: str, before: list) -> bool:
    """Whether a span documents: the string that begins a Python block (``before`` are the spans above it), or a comment with a third mark."""
    if lang == "python":
        if kind != "string":
            return False
        line = text.rfind("\n", 0, start) + 1
        if text[line:start].strip():
            return False
        at, k = line - 1, len(before) - 1
        while at >= 0:
            if k >= 0 and before[k][2] == "comment" and before[k][0] <= at < before[k][1]:
                at, k = before[k][0] - 1, k - 1
            elif text[at] in " \t\r\n":
                at -= 1
            else:
                break
        return at < 0 or text[at] == ":"
    if kind != "comment":
        return False
    head = text[start : start + 4]
    return (head[:3] in ("///", "/**") and head not in ("////", "/**/")) or head[:3] in ("//!", "/*!")


def spans(text: str, lang: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of comments, strings and docs, in order."""
    lexis = LEXIS.get(lang or "")
    out: list[tuple[int, int, str]] = []
    at = 0
    while lexis and (m := lexis.opener.search(text, at)):
        at, kind = _close(text, m, lexis)
        if kind:
            out.append((m.start(), at, "doc" if _is_doc(text, m.start(), lang, kind, out) else kind))
    return out


#: Stands for a string among the tokens.
STRING = "\x01"


def blanked(text: str, hidden: list[tuple[int, int, str]]) -> str:
    """``text`` with spaces for what its spans hold, line ends kept; a string begins with the mark STRING."""
    out, at = [], 0
    for a, b, _ in hidden:
        blank = re.sub(r"[^\n]", " ", text[a:b])
        quoted = text[a] in "\"'`/" and text[a : a + 2] not in ("//", "/*") or text[a].isalpha()
        out += [text[at:a], STRING + blank[1:] if quoted else blank]
        at = b
    return "".join([*out, text[at:]])


class Tokens:
    """Words and marks of a blanked text: their places, whether each begins a line, the bracket each lies in, and each bracket's partner."""

    def __init__(self, clean: str):
        self.clean = clean
        self.words: list[str] = []
        self.at: list[int] = []
        self.first: list[bool] = []
        self.inside: list[int] = []
        self.partner: dict[int, int] = {}
        open_: list[int] = []
        end = 0
        for m in _TOKEN.finditer(clean):
            w, k = m.group(), len(self.words)
            if w in (")", "]", "}") and open_:
                self.partner[open_[-1]] = k
                open_.pop()
            self.words.append(w)
            self.at.append(m.start())
            self.first.append(k == 0 or "\n" in clean[end : m.start()])
            self.inside.append(open_[-1] if open_ else -1)
            if w in ("(", "[", "{"):
                open_.append(k)
            end = m.end()
        for k in open_:
            self.partner[k] = len(self.words)

    def __len__(self) -> int:
        return len(self.words)

    def word(self, k: int) -> str:
        """The token numbered ``k``, empty past either end."""
        return self.words[k] if 0 <= k < len(self.words) else ""

    def named(self, k: int) -> bool:
        """Whether the token is a name."""
        w = self.word(k)
        return bool(w) and (w[0].isalpha() or w[0] in "_$`")

    def end(self, k: int) -> int:
        """Where the token ends in the text; past the last one, the text's end."""
        return self.at[k] + len(self.words[k]) if 0 <= k < len(self.words) else len(self.clean)

    def past(self, k: int) -> int:
        """The token after the group that an opening bracket begins, or the next one."""
        return self.partner.get(k, k) + 1

    def after_angles(self, k: int) -> int:
        """The token after a ``<...>`` group that begins at ``k``; ``k`` itself if none does."""
        if self.word(k) != "<":
            return k
        depth = 0
        while k < len(self):
            w = self.words[k]
            depth += (w == "<") - (w == ">")
            if not depth:
                return k + 1
            if w in (";", "{"):
                return k
            k = self.past(k)
        return k

    def index(self, place: int) -> int:
        """The first token at or after a place of the text."""
        return bisect_left(self.at, place)
