"""What the operators on typed text share: folding of spellings and edit distance."""

from __future__ import annotations

import re
import unicodedata

#: Letters that are also written with others.
LETTERS = str.maketrans({"ß": "ss", "æ": "ae", "ø": "oe", "å": "aa", "ä": "ae", "ö": "oe", "ü": "ue", "đ": "d", "ł": "l", "þ": "th", "ð": "d"})
_TWO = re.compile(r"([aou])e|aa")


def fold(text: str) -> str:
    """Lower case, compatibility forms, no accents, foreign letters in Latin ones; ae, oe, ue and aa as one letter, as
    they are also typed that way (ø as oe or as o)."""
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFKC", text).lower()).translate(LETTERS)
    text = "".join(c for c in unicodedata.normalize("NFD", text) if not unicodedata.combining(c))
    return _TWO.sub(lambda m: m[1] or "a", text)


def distance(a: str, b: str, most: int) -> int:
    """Edits (insert, delete, replace, swap of neighbours) from a to b; most + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    while a and b and a[0] == b[0]:
        a, b = a[1:], b[1:]
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    before2: list[int] = []
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before2[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before2, before = before, row
    return min(before[-1], most + 1)


def bound(a: str, b: str) -> int:
    """How many edits may lie between two spellings of one word."""
    n = min(len(a), len(b))
    return 0 if n < 4 else 1 if n < 8 else 2
