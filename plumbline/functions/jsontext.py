"""JSON text in plain Python, for what runs inside Arrow batches."""

from __future__ import annotations

import json
import re
from json.decoder import scanstring

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_HALF = re.compile("[\ud800-\udfff]")
_WORDS = {"true": True, "false": False, "null": None}


def _refuse(name: str):
    raise ValueError(name)


def parse(text: str):
    """The value of a valid JSON text; ValueError for anything else. NaN and Infinity are no JSON. Nesting of any
    depth is read: beyond what the library's recursion takes, with an explicit stack."""
    try:
        return json.loads(text, parse_constant=_refuse)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    top: list = []
    stack: list[tuple[object, str | None]] = [(top, None)]  # (container, key waiting for its value)
    at, end = _BLANK.match(text).end(), len(text)
    done = False
    fresh = True  # just behind an opening bracket

    def put(value) -> None:
        holder, key = stack[-1]
        if isinstance(holder, dict):
            holder[key] = value
        else:
            holder.append(value)

    def key_at(i: int) -> int:
        if text[i : i + 1] != '"':
            raise ValueError("key")
        key, i = scanstring(text, i + 1)
        i = _BLANK.match(text, i).end()
        if text[i : i + 1] != ":":
            raise ValueError("colon")
        stack[-1] = (stack[-1][0], key)
        return _BLANK.match(text, i + 1).end()

    while not done:
        closing = fresh and len(stack) > 1 and text[at : at + 1] == ("}" if isinstance(stack[-1][0], dict) else "]")
        if not closing:
            if fresh and isinstance(stack[-1][0], dict):
                at = key_at(at)
            c = text[at : at + 1]
            if c in ("{", "[") and c:
                new: object = {} if c == "{" else []
                put(new)
                stack.append((new, None))
                at, fresh = _BLANK.match(text, at + 1).end(), True
                continue
            if c == '"':
                value, at = scanstring(text, at + 1)
                put(value)
            elif m := _NUMBER.match(text, at):
                put(float(m[0]) if set(m[0]) & set(".eE") else int(m[0]))
                at = m.end()
            else:
                word = next((w for w in _WORDS if text.startswith(w, at)), None)
                if word is None:
                    raise ValueError("value")
                put(_WORDS[word])
                at += len(word)
        fresh = False
        while True:  # behind a value, or at a bracket that closes an empty container
            if not closing:
                at = _BLANK.match(text, at).end()
            if len(stack) == 1:
                if at != end:
                    raise ValueError("more text")
                done = True
                break
            c = text[at : at + 1]
            if c == ("}" if isinstance(stack[-1][0], dict) else "]"):
                stack.pop()
                at, closing = at + 1, False
                continue
            if c != ",":
                raise ValueError("comma")
            at = _BLANK.match(text, at + 1).end()
            if isinstance(stack[-1][0], dict):
                at = key_at(at)
            break
    return top[0]


def kind(value) -> str | None:
    """string, number, boolean, array or object; None for null."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {str: "string", int: "number", float: "number", list: "array", dict: "object"}[type(value)]


def clean(text: str) -> str:
    """Half surrogates, which an escape can name but UTF-8 can't hold, become U+FFFD."""
    return _HALF.sub("\ufffd", text)


def scalar_text(value) -> str:
    return clean(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True))
