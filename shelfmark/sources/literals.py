"""Reading of JSON and JavaScript literals out of scripts and attributes."""

from __future__ import annotations

import json
import re

# --- Fixed values: how much is read, and what counts as a number, a name, a word. ---
MOST_SCANNED = 4_000_000
MOST_DEPTH = 24
NUMBER = r"-?(?:0[xX][0-9a-fA-F]+|\d+\.?\d*(?:[eE][-+]?\d+)?|\.\d+)"
IDENTIFIER = r"[A-Za-z_$][\w$]*"
WORDS = {"true": True, "false": False, "null": None, "undefined": None, "NaN": None}
CONTROL = {"n": "\n", "t": "\t", "r": "\r"}

_GAP = r"[ \t\r\n]+|//[^\n]*\n?|/\*.*?(?:\*/|\Z)"
_SPACE = re.compile(f"(?:{_GAP})*", re.S)
_BODY = {q: re.compile(rf"((?:[^{q}\\]|\\.)*){q}", re.S) for q in "\"'`"}
_ESCAPE = re.compile(r"\\(.)", re.S)
_BALANCE = {o: re.compile(rf'"(?:[^"\\]|\\.)*"|["{re.escape(o + c)}]', re.S) for o, c in ("{}", "[]")}
_QUOTED = "|".join(rf"{q}(?:[^{q}\\]|\\.)*{q}" for q in "\"'`")
_TOKEN = re.compile(rf"(?P<gap>{_GAP})|(?P<text>{_QUOTED})|(?P<number>{NUMBER})|(?P<word>{IDENTIFIER})|(?P<mark>.)", re.S)
#: Escapes of JSON; the first group is half of a surrogate pair without the other half.
_ESCAPED = re.compile(r"\\[^u]|\\u[dD][89abAB][0-9a-fA-F]{2}\\u[dD][c-fC-F][0-9a-fA-F]{2}|(\\u[dD][89a-fA-F][0-9a-fA-F]{2})", re.S)
_CLOSES = {"{": "}", "[": "]", "(": ")"}


def balanced(text: str, start: int) -> str | None:
    """The bracketed text that begins at ``start``; brackets in double-quoted strings do not count."""
    opener, depth = text[start], 0
    for m in _BALANCE[opener].finditer(text, start, start + MOST_SCANNED):
        found = m.group()
        if found == '"':  # a string without an end
            return None
        if len(found) > 1:
            continue
        depth += 1 if found == opener else -1
        if depth == 0:
            return text[start : m.end()]
    return None


def _unescaped(body: str) -> str:
    return _ESCAPE.sub(lambda e: CONTROL.get(e[1], e[1]), body)


def js_string(text: str, start: int, quote: str) -> tuple[str, int] | None:
    """A string literal after its opening quote, and where it ends; escapes other than n, t and r stand for themselves."""
    m = _BODY[quote].match(text, start, start + MOST_SCANNED)
    return None if m is None else (_unescaped(m[1]), m.end())


def skip_space(text: str, at: int) -> int:
    return _SPACE.match(text, at).end()


def _number(raw: str) -> object:
    """The number written, or :class:`_Unreadable` if it has more digits than Python converts."""
    try:
        value = int(raw, 16) if "x" in raw or "X" in raw else int(raw) if raw.lstrip("-").isdigit() else float(raw)
        str(value)  # as a row will hold it
        return value
    except ValueError:
        return _Unreadable


class _Unreadable(ValueError):
    pass


#: No value yet: a container has been opened.
_OPEN = object()


def _read(text: str) -> object:
    """The first literal of ``text``, token by token.

    ``open_`` holds the containers that are open, each with the key that waits for its value (for an
    object) and whether the colon was met.  What cannot be read is passed over at its own level, an
    expression up to the comma or bracket that ends it, and an object with a method, a spread or a
    shorthand member up to its own closing bracket: its key is left out, its place in a list is null.
    """
    open_: list[list] = []  # container, key, colon met
    passing: int | None = None  # brackets open inside what is passed over
    object_ = False  # what is passed over is the innermost open object
    for m in _TOKEN.finditer(text):
        kind, raw = m.lastgroup, m.group()
        if kind == "gap":
            continue
        closes, value = kind == "mark" and raw in ")]}", _OPEN
        if passing is not None:
            if passing or not (closes or (raw == "," and not object_)):
                passing += (kind == "mark" and raw in _CLOSES) - closes
                continue
            passing = None
            if object_:
                object_ = False
                open_.pop()
                value = _Unreadable
        into, key, colon = open_[-1] if open_ else (None, None, False)
        if value is _Unreadable:
            pass
        elif isinstance(into, dict) and not colon and raw != "}":
            if key is None and (kind in ("text", "number", "word") and raw[0] != "`"):
                open_[-1][1] = _unescaped(raw[1:-1]) if kind == "text" else raw
            elif key is not None and raw == ":":
                open_[-1][2] = True
            elif key is not None or raw != ",":
                passing, object_ = int(raw in _CLOSES), True
            continue
        elif open_ and raw == ",":
            open_[-1][1:] = None, False
            continue
        elif open_ and raw == ("}" if isinstance(into, dict) else "]"):
            open_.pop()
            value = into if key is None or colon else _Unreadable
        elif raw in ("{", "[") and len(open_) <= MOST_DEPTH:
            open_.append([{} if raw == "{" else [], None, False])
        elif kind == "text":
            value = _unescaped(raw[1:-1])
        elif kind == "number":
            value = _number(raw)
        elif kind == "word" and raw in WORDS:
            value = WORDS[raw]
        else:
            value, passing = _Unreadable, int(raw in _CLOSES)
        if value is _OPEN:
            continue
        if not open_:
            if value is _Unreadable:
                break
            return value
        into, key, _ = open_[-1]
        if isinstance(into, list):
            into.append(None if value is _Unreadable else value)
        elif value is not _Unreadable:
            into[key] = value
        open_[-1][1:] = None, False
    raise _Unreadable


def loads(text: str) -> object | None:
    """JSON, or null.  Halves of surrogate pairs, as of an emoji cut in two, are no characters and read as U+FFFD."""
    try:
        return json.loads(_ESCAPED.sub(lambda m: "\\ufffd" if m[1] else m[0], text) if "\\u" in text else text)
    except (ValueError, RecursionError):
        return None


def loads_js(text: str) -> object | None:
    """JSON if it is that, else what can be read of a JavaScript literal."""
    if (strict := loads(text)) is not None:
        return strict
    try:
        return _read(text)
    except _Unreadable:
        return None
