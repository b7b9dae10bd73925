"""The label predicate language: `planes in [1, 2] || (rooms == 3 && planes >= 4)`, compiled to a Spark column.

`||` binds looser than `&&`; operands are comparisons of a label cloud's name with an integer (`==`, `!=`, `<`, `<=`, `>`,
`>=`), membership (`in [1, 2]`, the list may be empty) or a bracketed expression. There is no negation and no arithmetic.
A missing label counts as -1.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LEXEME = re.compile(r"(?P<int>-?[0-9]+)|(?P<word>[A-Za-z_][A-Za-z0-9_]*)|(?P<sign>==|!=|>=|<=|&&|\|\||[><()\[\],])|(?P<bad>\S)")
_COMPARE: dict[str, Callable[[Column, int], Column]] = {
    "==": lambda c, v: c == v, "!=": lambda c, v: c != v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v,
}


class FilterError(ValueError):
    """The text is no filter, or names what isn't there."""


@dataclass(frozen=True)
class LabelFilter:
    """A compiled filter: the names it uses, in order of appearance, and how to make a column of them."""

    names: tuple[str, ...]
    build: Callable[[Callable[[str], Column]], Column]

    def column(self, of: Callable[[str], Column] = F.col) -> Column:
        return self.build(lambda name: F.coalesce(of(name), F.lit(-1)))


def compile_filter(text: str) -> LabelFilter:
    """FilterError, with the position, for what isn't in the language."""
    if not text.strip():
        raise FilterError("a filter can't be empty")
    items = [(m.lastgroup, m[0], m.start()) for m in _LEXEME.finditer(text)]
    for kind, what, at in items:
        if kind == "bad":
            raise FilterError(f"{what!r} at {at} is not understood")
    items.append(("end", "the end", len(text)))
    names: list[str] = []
    i = 0

    def take(*wanted: str) -> str:
        nonlocal i
        kind, what, at = items[i]
        if kind not in wanted and what not in wanted:
            raise FilterError(f"{what!r} at {at}, where {' or '.join(wanted)} should be")
        i += 1
        return what

    def chain(sign: str, operand: Callable, join: Callable[[Column, Column], Column]):
        parts = [operand()]
        while items[i][1] == sign:
            take(sign)
            parts.append(operand())
        return parts[0] if len(parts) == 1 else lambda of: reduce(join, (p(of) for p in parts))

    def either():
        return chain("||", both, lambda a, b: a | b)

    def both():
        return chain("&&", single, lambda a, b: a & b)

    def single():
        if items[i][1] == "(":
            take("(")
            inner = either()
            take(")")
            return inner
        name = take("word")
        if name == "in":
            raise FilterError(f"'in' at {items[i - 1][2]}, where a name should be")
        if name not in names:
            names.append(name)
        if items[i][1] == "in":
            take("in")
            take("[")
            values: list[int] = []
            while items[i][1] != "]":
                values.append(int(take("int")))
                if items[i][1] != "]":
                    take(",")
                    if items[i][1] == "]":
                        take("int")
            take("]")
            return lambda of: of(name).isin(values) if values else F.lit(False)
        op = take(*_COMPARE)
        value = int(take("int"))
        return lambda of: _COMPARE[op](of(name), value)

    build = either()
    take("end")
    return LabelFilter(tuple(names), build)


def looks_complete(text: str) -> str | None:
    """A quick check before any table is read: what is wrong with the brackets, or None."""
    for a, b in ("()", "[]"):
        if text.count(a) != text.count(b):
            return f"{a} and {b} don't balance"
    if re.search(r"\bin\b(?!\s*\[)", text):
        return "'in' needs a list in [ ]"
    return None


def suggestions(name: str, known: list[str]) -> list[str]:
    """Known names that contain the name, or are contained in it, or resemble it."""
    low = name.lower()
    return [k for k in known if low in k.lower() or k.lower() in low] or difflib.get_close_matches(name, known)


def positional_join(clouds: dict[str, DataFrame], column: str = "label") -> DataFrame:
    """Row-aligned clouds (point_idx, label) side by side, one column per name. FilterError if their sizes differ. The sizes
    are counted first (from file footers where the cloud is a table), so the join itself may be an inner one."""
    sizes = {n: c.count() for n, c in clouds.items()}
    if len(set(sizes.values())) > 1:
        raise FilterError(f"the clouds differ in size: {sizes}")
    parts = [c.select("point_idx", F.col(column).alias(n)) for n, c in clouds.items()]
    return reduce(lambda a, b: a.join(b, "point_idx"), parts)


def select_points(text: str, clouds: dict[str, DataFrame]) -> DataFrame:
    """(point_idx) of the points whose labels satisfy the filter."""
    f = compile_filter(text)
    for n in f.names:
        if n not in clouds:
            raise FilterError(f"no label cloud {n!r}; near: {suggestions(n, list(clouds))}")
    return positional_join({n: clouds[n] for n in f.names}).where(f.column()).select("point_idx")
