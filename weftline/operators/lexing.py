"""Source text with its comments and literals blanked, by a state machine with a stack of modes.

Every character but line ends of a comment, string, character or regular expression
becomes a blank, so places and lines stay.  Block comments nest where the language has
it so, raw strings end with as many marks as they began with, a quote is told from a
lifetime, and code within a template string is code again, to any depth.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_STRING = re.compile(r'"(?:\\.|[^"\\])*(?:"|\Z)', re.S)
_LINE_STRING = re.compile(r'"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z)', re.S)
_QUOTED = re.compile(r"'(?:\\.|[^'\\\n])*(?:'|(?=\n)|\Z)", re.S)
_CHARACTER = re.compile(r"'(?:\\(?:u\{[^}\n]*\}|x[0-9a-fA-F]{2}|[^\n])|[^\\'\n])'")
_RUNE = re.compile(r"'(?:\\[^\n']+|\\'|[^\\'\n])'")
_RAW = re.compile(r'(?:b|c)?r(#*)"')
_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"\\.|\$\{|`|[^\\$`]+|\$", re.S)
_WORD_BEFORE = re.compile(r"([\w$]+)\s*\Z")
_NEXT = {"rust": re.compile(r"/[/*]|\"|'|(?<![\w])(?:b|c)?r#*\"|(?<![\w])[bc]\"|(?<![\w])b'"), "go": re.compile(r"/[/*]|[\"'`]"), "javascript": re.compile(r"[\"'`/(){}]")}
#: Words behind which a slash begins a regular expression, and those whose brackets are a head and no operand.
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "instanceof", "new", "do", "else", "throw", "await", "yield"}
_HEADS = {"if", "while", "for", "with"}


def _blank(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


def _comment_end(text: str, at: int, nests: bool) -> int:
    """Behind a block comment that begins at a place."""
    depth = 0
    for m in re.compile(r"/\*|\*/").finditer(text, at):
        if m[0] == "/*":
            depth += 1 if nests or not depth else 0
        else:
            depth -= 1
            if not depth:
                return m.end()
    return len(text)


def blanked(text: str, lang: str) -> str:
    """``text`` of rust, go or javascript with comments and literals blanked."""
    out, done = [], 0
    for start, end in (_script if lang == "javascript" else _plain)(text, lang):
        out += [text[done:start], _blank(text[start:end])]
        done = end
    return "".join([*out, text[done:]])


def _plain(text: str, lang: str) -> Iterator[tuple[int, int]]:
    """What is no code in Rust and Go."""
    at = 0
    while m := _NEXT[lang].search(text, at):
        start, mark = m.start(), m[0]
        if mark == "//":
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
        elif mark == "/*":
            end = _comment_end(text, start, lang == "rust")
        elif mark == "`":
            end = text.find("`", start + 1) + 1 or len(text)
        elif mark[-1] == "'":
            found = (_CHARACTER if lang == "rust" else _RUNE).match(text, start + len(mark) - 1)
            if not found:  # a lifetime or a label
                at = start + len(mark)
                continue
            end = found.end()
        elif lang == "rust" and (raw := _RAW.match(text, start)):
            end = text.find('"' + raw[1], raw.end())
            end = len(text) if end < 0 else end + 1 + len(raw[1])
        else:
            quote = start + len(mark) - 1
            end = (_STRING if lang == "rust" else _LINE_STRING).match(text, quote).end()
        yield start, end
        at = end


def _script(text: str, lang: str) -> Iterator[tuple[int, int]]:
    """What is no code in JavaScript and TypeScript.

    ``open_`` holds a mark for each open bracket: ``(`` with whether it heads a statement,
    ``{`` with whether it is an operand, ``$`` for code within a template string.
    """
    at, open_ = 0, []
    last, operand = 0, False  # the end of the last literal, and whether an operand ends at the last closing bracket
    closed = -1
    while m := _NEXT["javascript"].search(text, at):
        start, mark = m.start(), m[0]
        before = text[max(last, start - 80) : start].rstrip()
        if mark in "({":
            word = _WORD_BEFORE.search(before)
            if mark == "(":
                open_.append(("(", bool(word) and word[1] in _HEADS))
            else:
                open_.append(("{", bool(before) and (before[-1] in "(,=:[?&|" or bool(word) and word[1] == "return") and not before.endswith("=>")))
            at = start + 1
            continue
        if mark in ")}":
            kind, flag = open_.pop() if open_ else (mark, False)
            if kind == "$" and mark == "}":
                end = yield from _template(text, start, start + 1, open_)
                last = at = end
                closed, operand = end, end <= len(text) and text[end - 1 : end] == "`"
                continue
            closed, operand = start, flag if mark == "}" else not flag
            at = start + 1
            continue
        if mark == "`":
            end = yield from _template(text, start, start + 1, open_)
            operand = True
        elif mark in "\"'":
            end = (_LINE_STRING if mark == '"' else _QUOTED).match(text, start).end()
            yield start, end
            operand = True
        elif text.startswith("//", start):
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
            yield start, end
            at = end  # what stood before the comment still stands before what follows
            continue
        elif text.startswith("/*", start):
            end = _comment_end(text, start, False)
            yield start, end
            at = end
            continue
        else:
            found = _REGEX.match(text, start) if _begins_regex(text, start, last, closed, operand) else None
            if not found:
                at = start + 1
                continue
            end = found.end()
            yield start, end
            operand = True
        last = at = closed = end


def _begins_regex(text: str, at: int, last: int, closed: int, operand: bool) -> bool:
    """Whether a slash stands where an operand is due."""
    gap = re.sub(r"//[^\n]*|/\*.*?\*/", " ", text[max(0, at - 400) if closed < at - 400 else max(closed, 0) : at], flags=re.S).rstrip()
    if closed >= 0 and closed >= at - 400 and gap in ("", ")", "}"):
        return not operand
    if not gap:
        return True
    if word := _WORD_BEFORE.search(gap):
        return word[1] in _BEFORE_REGEX
    return gap[-1] not in ")]}"


def _template(text: str, start: int, at: int, open_: list) -> Iterator[tuple[int, int]]:
    """The text of a template string up to its end, or up to code within it; gives the place behind."""
    while m := _TEMPLATE.match(text, at):
        at = m.end()
        if m[0] == "`":
            break
        if m[0] == "${":
            open_.append(("$", False))
            break
    yield start, at
    return at


def without_type_arguments(code: str) -> str:
    """Blanked code in which the type arguments of calls are blank too: ``name::<T>(`` and ``name<T>(`` as ``name (``."""
    cuts = []
    for m in re.finditer(r">\s*\(", code):
        at, depth = m.start(), 0
        while at >= 0 and m.start() - at < 400:
            c = code[at]
            if c == ">":
                if at and code[at - 1] in "-=":
                    break
                depth += 1
            elif c == "<":
                depth -= 1
                if not depth:
                    name = at - 2 if code[at - 2 : at] == "::" else at
                    if name and re.match(r"\w", code[name - 1]):
                        cuts.append((name, m.start() + 1))
                    break
            elif not (c.isalnum() or c in "_ \n\t,.:&|[]'?"):
                break
            at -= 1
    out, done = [], 0
    for start, end in cuts:
        if start >= done:
            out += [code[done:start], _blank(code[start:end])]
            done = end
    return "".join([*out, code[done:]])
