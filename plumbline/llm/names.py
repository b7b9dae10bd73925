"""Variant spellings of names typed by people (problem 3).

Method: trie join. The words of all names are put into tries, shard by shard; each word is walked down its shards' tries by a
Levenshtein automaton, which lists all words within a bounded distance. Names that share a word, or have words that are
such neighbours, come together; two names are one if an assignment of their tokens, in any order, leaves nothing over
that tells them apart.

There are no word lists. What legal forms, trades, towns, titles and given names are to a reader is learnt from all
spellings:

1. A spelling is folded and cut into tokens: words, words cut short with a dot, runs of dotted or slashed letters (a/s), initials,
   and initials that follow a joining word. Spellings of equal tokens are one form, whatever their number.
2. Sharding: two words within two edits have, if they are long enough, fewer than two of them in their first or in their
   last five letters; so the shards are these five letters with none or one left out, and the length in steps of four.
3. A word that stands with COMPANIONS or more different words, each of which stands with few others (misspellings counted once), tells nobody; it is
   frequent, while the name of a firm is not, however often it is met. A frequent word that at least one in SHARE forms has is generic; there are at most SHARE times as many as a form has
   words on average. Of generic words it is learnt which stand for each other (`kathy`, `katherine`; `ltd`, `limited`:
   ALIAS of the rests of a name that one of them stands with are also met with the other) and which stand together
   (a trade and a legal form do, two trades or two given names don't). Both are bits of a matrix, so the broadcast is bounded.
4. A form goes to the group of each of its words that isn't frequent (a word follows its best neighbour that is commoner, words
   that end at the same one are a group), and if it has none, to the group of each two of its tokens. In a group, forms that differ
   by misspellings only are merged first, in as many parts as the group's size asks for; what is left is added, from the most to the least
   telling, to the name it fits. A form that fits two names joins them if nothing tells them apart, and is left alone if
   something does. Names of two groups that have neighbouring words are compared by the same rules.

Two names fit if a word that isn't generic, or two words, agree; words and initials left over on both sides must be such
that stand together; a word left over that isn't generic needs two words that agree.

Defined results
* null and blank spellings are left out; equal spellings are one, whichever field they stand in;
* a spelling without any word of two letters, or with one frequent word only, matches nothing;
* what is not learnt (too few spellings) is decided by the letters: a word cut short is one it begins, or whose letters it has
  in order; `nicknames` may name more short forms;
* empty tables give an empty result; long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import copy
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.words import distance, fold
from plumbline.operators.components import components
from plumbline.session import spread, stage

#: A word that stands with fewer than FEW others tells who is meant; COMPANIONS such words make a word frequent; one form in SHARE
#: makes it generic; two words stand for each other if they share ALIAS of their rests and at least ALIAS_LEAST.
FEW, COMPANIONS, SHARE, ALIAS, ALIAS_LEAST = 10, 5, 2_000, 0.2, 3
#: The fewest forms from which anything is learnt of a word.
LEAST = 9
#: Given names of which a title is met beside so many.
TITLE_NAMES = 3
#: Words that join.
JOINS = ("og", "and", "und", "et")

_CAMEL = re.compile(r"(?<=[a-zæøåäöüß])(?=[A-ZÆØÅÄÖÜ][a-zæøåäöüß])")
_RUN = re.compile(r"(?<![^\W_])[^\W\d_](?:\s?/\s?[^\W\d_]|\.[^\W\d_])+\b\.?")
_TOKEN = re.compile(r"=?[^\W_]+\.?|[&+]")
_BLANKS = re.compile(r"[\s./]")


def tokens(spelling: str) -> list[str]:
    """The tokens of a spelling, sorted: `word`, `word.` (cut short), `=as` (dotted or slashed letters), `k` (initial), `&k` (initial behind a
    joining word)."""
    s = _RUN.sub(lambda m: f" ={_BLANKS.sub('', m[0])} ", fold(_CAMEL.sub(" ", spelling)))
    out, joined = [], False
    for m in _TOKEN.finditer(s):
        t = m[0]
        word = t.rstrip(".")
        if t in "&+" or word in JOINS:
            joined = bool(out)
            continue
        out.append(t if len(word) > 1 else f"&{word}" if joined else word)
        joined = False
    return sorted(out)


def bare(token: str) -> str:
    return token.strip("=.&")


# ---- trie join


class Trie:
    """Words as nested dicts; the word itself under the key "" at its end."""

    def __init__(self, words):
        self.root: dict = {}
        for w in words:
            node = self.root
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w

    def near(self, word: str, most: int) -> list[str]:
        """All words within `most` edits (insert, delete, replace, swap of neighbours), by running a Levenshtein automaton along
        the trie. Its states, pairs of letters read and edits made, are the bits of one number per count of edits; a second
        number per count holds the states half-way through a swap."""
        n = len(word)
        masks: dict[str, int] = {}
        for i, c in enumerate(word):
            masks[c] = masks.get(c, 0) | 1 << i
        everything, accept = (1 << (n + 1)) - 1, 1 << n
        start = tuple((1 << (e + 1)) - 1 & everything for e in range(most + 1)), (0,) * (most + 1)
        found, stack = [], [(self.root, start)]
        while stack:
            node, (state, swaps) = stack.pop()
            for c, child in node.items():
                if c == "":
                    if any(r & accept for r in state):
                        found.append(child)
                    continue
                mask = masks.get(c, 0)
                new, half = [], []
                below = new_below = alive = 0
                for e, r in enumerate(state):
                    x = (r & mask) << 1 | (swaps[e] & mask) << 2
                    if e:  # insert, replace; delete
                        x |= below | below << 1 | new_below << 1
                    x &= everything
                    new.append(x)
                    half.append(below & mask >> 1 if e else 0)  # the next letter came first
                    alive |= x | half[-1]
                    below, new_below = r, x
                if alive:
                    stack.append((child, (tuple(new), tuple(half))))
        return found


def shard_keys(word: str) -> set[str]:
    """The first and the last five letters, each with none or one left out, and the length in steps of four, with two
    letters of overlap."""
    out = set()
    for side, part in (("<", word[:5]), (">", word[-5:])):
        for n in {(len(word) - 1) // 4, (len(word) + 1) // 4}:
            out |= {f"{n}{side}{x}" for x in (part, *(part[:i] + part[i + 1 :] for i in range(len(part))))}
    return out


def _close(a: str, b: str) -> int:
    """Edits between two words if they may be one; else 9."""
    n = min(len(a), len(b))
    most = 0 if n < 4 else 1 if n < 9 else 2
    d = distance(a, b, most)
    return d if d <= most else 9


def _shards(batches):
    for batch in batches:
        keys, words = [], []
        for w in batch.column(0).to_pylist():
            k = shard_keys(w)
            keys += k
            words += [w] * len(k)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(words, pa.string())], names=["shard", "word"])


def _join(batches):
    """Rows (shard, word) in the order of shards."""

    def work(words):
        trie = Trie(words)
        return [(w, v, d) for w in words for v in trie.near(w, 2 if len(w) >= 9 else 1) if v != w and (d := _close(w, v)) < 9]

    def block(out):
        a, b, d = zip(*{(max(x, y), min(x, y), d) for x, y, d in out}) if out else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(d, pa.int32())], names=["a", "b", "edits"])

    here, words, out = None, [], []
    for batch in batches:
        for shard, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if shard != here:
                if len(words) > 1:
                    out += work(words)
                here, words = shard, []
                if len(out) > 5_000:
                    yield block(out)
                    out = []
            words.append(word)
    if len(words) > 1:
        out += work(words)
    yield block(out)


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b, edits) of all pairs of different words (column word) that may be one, a > b."""
    shards = spread(words.select("word").where("length(word) >= 4").distinct(), "word").mapInArrow(_shards, "shard string, word string")
    several = shards.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1").select("shard")
    rows = spread(shards.join(several, "shard", "left_semi"), "shard").sortWithinPartitions("shard", "word").select("shard", "word")
    return rows.mapInArrow(_join, "a string, b string, edits int").distinct()


# ---- what is learnt of generic words

#: Pseudo-words: a free initial; a second word that isn't generic.
INITIAL, SECOND = "#i", "#2"


class Learnt:
    """Generic words, which of them stand for each other and which stand together, as bit matrices, and which are mostly written with a dot."""

    def __init__(self, generic: list[str], alias: list[tuple[str, str]], together: list[tuple[str, str]], cut: set[str]):
        self.cut = cut
        self.at = {w: i for i, w in enumerate([INITIAL, SECOND, *generic])}
        n = len(self.at)
        self.alias, self.together = (np.zeros((n, (n + 7) // 8), np.uint8) for _ in range(2))
        rep = {w: w for w in self.at}
        self.person: set[str] = set()

        def top(w):
            while rep[w] != w:
                w = rep[w]
            return w

        for m, pairs in ((self.alias, alias), (self.together, together)):
            for x, y in pairs:
                if m is self.alias and (x[-1] == "." or y[-1] == "."):  # a word that its initial stands for
                    word, letter = (y, x) if x[-1] == "." else (x, y)
                    if word[0] == letter[0] and word in self.at:
                        self.person.add(word)
                    continue
                for i, j in ((self.at[x], self.at[y]), (self.at[y], self.at[x])):
                    m[i, j >> 3] |= 1 << (j & 7)
                if m is self.alias and top(x) != top(y):
                    rep[max(top(x), top(y))] = min(top(x), top(y))
        self.rep = {w: top(w) for w in rep}
        # titles: words beside given names of several kinds, which are none themselves; they say nothing about who it is
        self.titles = {w for w in generic if w not in self.person and sum(self.stands_with(w, p) for p in self.person) >= TITLE_NAMES}

    def _bit(self, m, x: str, y: str) -> bool:
        i, j = self.at.get(x), self.at.get(y)
        return i is not None and j is not None and bool(m[i, j >> 3] >> (j & 7) & 1)

    def stands_for(self, x: str, y: str) -> bool:
        return self._bit(self.alias, x, y)

    def stands_with(self, x: str, y: str) -> bool:
        return self._bit(self.together, x, y)


def is_short(short: str, long: str) -> bool:
    """Whether a word can be another one cut short: its start (with one slip in five letters or more), or letters of it in order."""
    if len(short) < 2 or len(long) <= len(short) or short[0] != long[0]:
        return False
    if len(short) >= 5 and distance(short, long[: len(short)], 1) <= 1:
        return True
    rest = iter(long)
    return all(c in rest for c in short)


class Rules:
    """Comparison of tokens and of names, by what was learnt. A token of a form is `token>generic>contexts`: the generic word it is or misspells, if any, and how many other words it stands with."""

    def __init__(self, learnt: Learnt, nicknames: dict[str, str] | None = None):
        self.learnt, nick = learnt, nicknames or {}

        @lru_cache(200_000)
        def near(x: str, y: str) -> int:
            """0 for equal words, 1 for words that stand for each other, 2 for spellings of one, 3 for a word and its short form; else 9."""
            (tx, gx, _), (ty, gy, _) = x.split(">"), y.split(">")
            a, b = bare(tx), bare(ty)
            if a == b:
                return 0
            if nick.get(a, a) == nick.get(b, b) or gx and gy and (gx == gy or learnt.stands_for(gx, gy)):
                return 1
            if not (gx and gy) and _close(a, b) < 9:
                return 2
            if bool(gx) == bool(gy):
                for s, long, t in ((a, b, tx), (b, a, ty)):
                    if (t[-1] == "." or gx and s in learnt.cut) and is_short(s, long) or not gx and (t[0] == "=" or len(s) == 3 and len(long) > 6) and is_short(s, long):
                        return 3
            return 9

        self.near = near

    def entries(self, x: set, y: set) -> int:
        return 0 if not x.isdisjoint(y) else min(self.near(a, b) for a in x for b in y)


def _generic(entry) -> str:
    """The generic word of an entry, empty if it is none."""
    return next((g for t in sorted(entry) if (g := t.split(">")[1])), "")


def _contexts(entry) -> int:
    return max(int(t.split(">")[2]) for t in entry)


def _tells(entry) -> bool:
    return not _generic(entry) and _contexts(entry) < FEW and any(len(bare(t.split(">", 1)[0])) > 3 for t in entry)


class Name:
    """A name met in a group: its words, each with all spellings accepted of it, and its initials."""

    def __init__(self, id_: str, form: str):
        self.id, self.n = id_, 1
        toks = form.split(" ")
        self.words = [{t} for t in toks if len(bare(t.split(">", 1)[0])) > 1]
        self.free = {t.split(">", 1)[0] for t in toks if len(t.split(">", 1)[0]) == 1}
        self.lone = {t[1] for t in toks if t[0] == "&"}

    def dump(self) -> str:
        return json.dumps([self.id, self.n, [sorted(w) for w in self.words], sorted(self.free), sorted(self.lone)])

    @classmethod
    def load(cls, text: str) -> Name:
        self = cls.__new__(cls)
        self.id, self.n, words, free, lone = json.loads(text)
        self.words, self.free, self.lone = [set(w) for w in words], set(free), set(lone)
        return self

    def plain(self) -> list[str]:
        return sorted({bare(t.split(">", 1)[0]) for w in self.words for t in w})

    def tell(self) -> int:
        return sum(2 if _generic(w) else 4 for w in self.words) + len(self.free) + len(self.lone)


def _assign_words(rules: Rules, a: list, b: list) -> list[tuple[int, int]]:
    """The most entries of a that each have their own near one in b, the nearest ones first, as index pairs (augmenting paths,
    which leave equal words together)."""
    level = [[rules.entries(x, y) for y in b] for x in a]
    of: dict[int, int] = {}
    taken: set[int] = set()
    for want in range(4):
        for i, row in enumerate(level):
            if i not in taken and (j := next((j for j, v in enumerate(row) if v == want and j not in of), None)) is not None:
                of[j] = i
                taken.add(i)

    def place(i: int, seen: set[int]) -> bool:
        for j, v in enumerate(level[i]):
            if v < 9 and j not in seen:
                seen.add(j)
                if j not in of or level[of[j]][j] and place(of[j], seen):
                    of[j] = i
                    return True
        return False

    for i in range(len(a)):
        if i not in taken:
            place(i, set())
    return [(i, j) for j, i in of.items()]


class Fit:
    """How two names agree: word pairs, initials used up, what is left over on each side."""

    def __init__(self, rules: Rules, a: Name, b: Name):
        self.pairs = _assign_words(rules, a.words, b.words)
        met_a, met_b = {i for i, _ in self.pairs}, {j for _, j in self.pairs}
        left = [[w for i, w in enumerate(a.words) if i not in met_a], [w for j, w in enumerate(b.words) if j not in met_b]]
        plain = lambda w: {bare(t.split(">", 1)[0]) for t in w}
        self.runs = 0
        for me, you in ((0, 1), (1, 0)):  # a word here is two words there, written as one
            for x in list(left[me]):
                hit = next(((y, z) for y in left[you] for z in left[you] if y is not z and any(_close(p, q + r) < 9 for p in plain(x) if len(p) > 5 for q in plain(y) for r in plain(z))), None)
                if hit:
                    left[me] = [w for w in left[me] if w is not x]
                    left[you] = [w for w in left[you] if w is not hit[0] and w is not hit[1]]
                    self.runs += 2
        self.letters = 0
        free, lone = [set(a.free), set(b.free)], [set(a.lone), set(b.lone)]
        #: initials that a word stands for: (side of the word, letter, free or lone)
        self.told: list[tuple[int, str, bool]] = []
        self.tells = False  # whether a free initial stands for a word that tells who it is
        for me, you in ((0, 1), (1, 0)):
            for kind, letters in ((True, free[me]), (False, lone[me])):
                for c in sorted(letters):
                    y = next((y for y in left[you] if any(p[0] == c for p in plain(y))), None)
                    if y is not None:
                        left[you] = [w for w in left[you] if w is not y]
                        letters.discard(c)
                        self.letters += 1
                        self.told.append((you, c, kind))
                        self.tells |= kind and _tells(y)
        for sets in (free, lone):
            both = sets[0] & sets[1]
            self.letters += len(both)
            sets[0] -= both
            sets[1] -= both
        # letters of a dotted run that is no word
        for me, you in ((0, 1), (1, 0)):
            for x in list(left[me]):
                for p in plain(x):
                    if len(p) <= 3 and set(p) <= free[you]:
                        free[you] -= set(p)
                        left[me] = [w for w in left[me] if w is not x]
                        break
        self.left, self.free, self.lone = left, free, lone

    def exact(self) -> bool:
        return not (self.runs or self.told or any(self.left) or any(self.free) or any(self.lone))

    def score(self, rules: Rules, a: Name, b: Name) -> int | None:
        """What agrees, or None if something tells the two apart."""
        learnt = rules.learnt
        rare = sum(1 for i, j in self.pairs if not (_generic(a.words[i]) or _generic(b.words[j])))
        n = len(self.pairs) + self.runs
        # an initial stands for a given name, not for the word that tells who it is
        if not rare and self.tells:
            return None
        if not rare and n < 2 and not (n and self.letters):
            return None
        for x in self.left[0]:
            for y in self.left[1]:
                gx, gy = _generic(x), _generic(y)
                if gx and gy and (learnt.stands_with(gx, gy) or gx in learnt.titles and gy in learnt.titles) or bool(gx) != bool(gy) and learnt.stands_with(SECOND, gx or gy):
                    continue
                return None
        if n < 2 and not (rare and self.letters) and any(_tells(w) for side in self.left for w in side):
            return None
        if self.free[0] and self.free[1] or self.lone[0] and self.lone[1]:
            return None
        for me, name in ((0, a), (1, b)):
            there = self.left[1 - me]
            if self.free[me]:
                given = not any(_generic(w) in learnt.person for w in name.words if _generic(w)) if learnt.person else len(name.words) < 2
                for y in there:
                    g = _generic(y)
                    if g in learnt.titles:
                        continue
                    if g in learnt.person or not g and given or g and not learnt.stands_with(INITIAL, g):
                        return None
            if self.lone[me] and any(not _generic(y) for y in there):
                return None
        same = sum(1 for i, j in self.pairs if not {bare(t.split(">", 1)[0]) for t in a.words[i]}.isdisjoint(bare(t.split(">", 1)[0]) for t in b.words[j]))
        return 6 * rare + 4 * (n - rare) + 2 * self.letters + same


def fits(rules: Rules, a: Name, b: Name) -> int | None:
    return Fit(rules, a, b).score(rules, a, b)


def absorb(rules: Rules, a: Name, b: Name) -> None:
    """Take over what a name that fits tells."""
    f = Fit(rules, a, b)
    met = {j for _, j in f.pairs}
    for i, j in f.pairs:
        a.words[i] |= b.words[j]
    a.words += [set(w) for j, w in enumerate(b.words) if j not in met]
    a.free |= b.free
    a.lone |= b.lone
    for _, c, kind in f.told:
        (a.free if kind else a.lone).discard(c)
    a.n += b.n


def _add(rules: Rules, names: list[Name], form: Name) -> list[Name] | None:
    """Put a form into the name it fits, and join names it shows to be one: those that contradict each other in nothing once
    its spellings of their words are known. What it is put to is returned first, then the names that joined it; None if
    it fits several that do contradict."""
    fit = sorted(((s, i) for i, x in enumerate(names) if (s := fits(rules, x, form)) is not None), key=lambda x: (-x[0], x[1]))
    if not fit:
        names.append(form)
        return [form]
    if len(fit) == 1:
        absorb(rules, names[fit[0][1]], form)
        return [names[fit[0][1]]]
    one, joined = copy.deepcopy(form), []
    for score, x in [(s, names[i]) for s, i in fit]:
        if fits(rules, one, x) is None:
            if score == fit[0][0]:
                return None
        elif score == fit[0][0] or not any(y is not x and y not in joined and fits(rules, y, x) is not None for y in names):
            absorb(rules, one, x)
            joined.append(x)
    absorb(rules, joined[0], form)
    for x in joined[1:]:
        absorb(rules, joined[0], x)
        names.remove(x)
    return joined


def _merge(sent, nicknames):
    """Rows (group, part, form): in each part, forms that differ by misspellings only become one; (group, form, first form, its name)."""

    def run(batches):
        rules = Rules(sent.value, nicknames)
        here, names = None, []

        def ended():
            return [(here[0], None, x.id, x.dump(), x.tell(), x.n) for x in names] if here else []

        for batch in batches:
            out = []
            for group, part, form in zip(*(c.to_pylist() for c in batch.columns)):
                if (group, part) != here:
                    out += ended()
                    here, names = (group, part), []
                new = Name(form, form)
                one = next((x for x in names if len(x.words) == len(new.words) and Fit(rules, x, new).exact()), None)
                if one:
                    absorb(rules, one, new)
                    out.append((group, form, one.id, None, None, None))
                else:
                    names.append(new)
                    out.append((group, form, form, None, None, None))
            yield _block(out, _MERGED)
        yield _block(ended(), _MERGED)

    return run


_MERGED = {"group": pa.string(), "form": pa.string(), "lead": pa.string(), "slots": pa.string(), "tell": pa.int32(), "n": pa.int32()}
_NAMED = {"group": pa.string(), "lead": pa.string(), "name": pa.string(), "slots": pa.string(), "words": pa.list_(pa.string()), "tell": pa.int32(), "n": pa.int32()}


def _block(rows, schema):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(schema), schema.values())], names=list(schema))


def _name(sent, nicknames):
    """Rows (group, name), in each group from the most to the least telling: (group, first form, name); a name that joined another is
    given by a second row of the form it began with. At the end of a group its names: (name, slots, words, tell, n)."""

    def run(batches):
        rules = Rules(sent.value, nicknames)
        here, names = None, []

        def ended():
            # names of a group of two words are also in those of one word
            return [(None, None, f"{here}|{x.id}", x.dump(), x.plain(), x.tell(), x.n) for x in names] if here and " " not in here else []

        for batch in batches:
            out = []
            for group, slots in zip(*(c.to_pylist() for c in batch.columns)):
                if group != here:
                    out += ended()
                    here, names = group, []
                new = Name.load(slots)
                lead = new.id
                got = _add(rules, names, new)
                to = f"{group}|{got[0].id if got else lead}"
                out.append((group, lead, to, None, None, None, None))
                out += [(group, x.id, to, None, None, None, None) for x in (got or [])[1:]]
            yield _block(out, _NAMED)
        yield _block(ended(), _NAMED)

    return run


def _across(sent, nicknames):
    """Rows (low, low_slots, high, high_slots) in the order of low: (a, b) of each name and those of other groups it is one
    with, by the rules within a group."""

    def run(batches):
        rules = Rules(sent.value, nicknames)
        here, low, low_name, high = None, None, None, []

        def ended():
            got = _add(rules, high, low) if high else None
            return [(low_name, x.at) for x in got or []]

        for batch in batches:
            out = []
            for name, slots, other, other_slots in zip(*(c.to_pylist() for c in batch.columns)):
                if name != here:
                    out += ended()
                    here, low, low_name, high = name, Name.load(slots), name, []
                x = Name.load(other_slots)
                if fits(rules, x, low) is not None:
                    x.at = other
                    high.append(x)
            yield _block(out, {"a": pa.string(), "b": pa.string()})
        yield _block(ended(), {"a": pa.string(), "b": pa.string()})

    return run


# ---- the plan


def _read(batches):
    for batch in batches:
        got = [tokens(s) for s in batch.column(0).to_pylist()]
        keep = [i for i, g in enumerate(got) if any(len(bare(t)) > 1 for t in g)]
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array([" ".join(got[i]) for i in keep], pa.string())], names=["spelling", "raw"])


def _word_of(t):
    return F.regexp_replace(t, "[=.&]", "")


def word_table(forms: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of forms (column raw): the words (word, n, contexts, frequent, generic, generic_of, root, tells) and the pairs of neighbours (a, b,
    edits). `n` is the number of forms, `generic_of` the generic word that the word is or misspells, `root` its group; a word
    `tells` if it is no frequent one and misspells none."""
    has = forms.select("raw", F.explode(F.array_distinct(F.transform(F.split("raw", " "), _word_of))).alias("word")).where("length(word) > 1")
    count = stage(has.groupBy("word").agg(F.count("*").alias("n")))
    near = stage(neighbours(count))
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "edits"))
    c, d = count.select(F.col("word").alias("a"), F.col("n").alias("na")), count.select(F.col("word").alias("b"), F.col("n").alias("nb"))
    up = both.join(c, "a").join(d, "b").where("nb > na or (nb = na and b < a)")
    best = stage(up.groupBy("a").agg(F.min_by("b", F.struct("edits", (-F.col("nb")).alias("n"), "b")).alias("b")))
    near_root = stage(components(best))
    # how many other words a word stands with, misspellings of one counted once
    lead = near_root.select(F.col("node").alias("word"), F.col("component").alias("lead"))
    met = has.join(lead, "word", "left").select("raw", "word", F.coalesce("lead", "word").alias("lead"))
    with_ = met.groupBy("raw").agg(F.collect_list(F.struct("word", "lead")).alias("ws")).select(F.explode("ws").alias("x"), "ws")
    with_ = stage(with_.select(F.col("x.word").alias("word"), F.col("x.lead").alias("me"), F.explode(F.col("ws.lead")).alias("other")).where("other <> me").select("word", "other").distinct())
    contexts = with_.groupBy("word").agg(F.count("*").alias("contexts"))
    few = contexts.where(F.col("contexts") < FEW).select(F.col("word").alias("other"))
    companions = with_.join(few, "other", "left_semi").groupBy("word").agg(F.count("*").alias("companions"))
    n_forms = forms.count()
    words = stage(count.join(contexts, "word", "left").join(companions, "word", "left")
                  .select("word", "n", F.coalesce("contexts", F.lit(0)).alias("contexts"), (F.coalesce("companions", F.lit(0)) >= COMPANIONS).alias("frequent"))
                  .withColumn("generic", F.col("frequent") & (F.col("n") >= LEAST) & (F.col("n") * SHARE >= n_forms)))
    first = lambda d, c: both.join(d, "b").groupBy(F.col("a").alias("word")).agg(F.min_by("b", F.struct("edits", (-F.col("nb")).alias("n"), "b")).alias(c))
    words = words.join(first(words.where("generic").select(F.col("word").alias("b"), F.col("n").alias("nb")), "near_generic"), "word", "left")
    words = words.join(first(words.where("frequent").select(F.col("word").alias("b"), F.col("n").alias("nb")), "near_frequent"), "word", "left")
    words = stage(words.select("word", "n", "contexts", "frequent", "generic", F.when(F.col("generic"), F.col("word")).when(~F.col("frequent"), F.col("near_generic")).alias("generic_of"),
                               F.when(F.col("frequent"), F.col("word")).otherwise(F.col("near_frequent")).alias("frequent_of")))
    # groups only divide the work: neighbours that end apart are taken up again
    tells = words.where("frequent_of is null").select("word")
    follow = best.join(tells.select(F.col("word").alias("a")), "a", "left_semi").join(tells.select(F.col("word").alias("b")), "b", "left_semi")
    root = components(follow).select(F.col("node").alias("word"), F.col("component").alias("root"))
    return stage(words.join(root, "word", "left").withColumn("root", F.coalesce("frequent_of", "root", "word")).withColumn("tells", F.col("frequent_of").isNull())), near


def read_forms(forms: DataFrame, words: DataFrame) -> DataFrame:
    """(raw, form, toks) of each raw form; `toks` are structs (key, tells, at): `key` is the token's generic word, or `#` and its
    group, or an initial `k.`."""
    t = forms.select("raw", F.explode(F.split("raw", " ")).alias("token")).withColumn("word", _word_of(F.col("token")))
    t = t.join(words.select("word", "generic_of", "root", "tells", "contexts"), "word", "left")
    full = F.concat("token", F.lit(">"), F.coalesce("generic_of", F.lit("")), F.lit(">"), F.coalesce("contexts", F.lit(0)).cast("string"))
    key = F.when(F.length("word") == 1, F.when(F.col("token").startswith("&"), F.col("token")).otherwise(F.concat("word", F.lit(".")))).otherwise(F.coalesce("generic_of", F.concat(F.lit("#"), "root")))
    return t.groupBy("raw").agg(F.concat_ws(" ", F.sort_array(F.collect_list(full))).alias("form"), F.sort_array(F.collect_list(F.struct(key.alias("key"), F.coalesce("tells", F.lit(False)).alias("tells"), "root"))).alias("toks"))


def learn(forms: DataFrame) -> Learnt:
    """What `forms` (column toks) teach of generic words. The number of generic words is bounded, so what comes to the
    driver is."""
    keys = forms.select(F.array_sort(F.col("toks.key")).alias("k"))
    # a rest of a name, and the generic words or initials that stand with it
    each = keys.select(F.expr("inline(transform(k, (x, i) -> struct(x as word, concat_ws(' ', slice(k, 1, i), slice(k, i + 2, size(k))) as rest)))"))
    each = each.where(~F.col("word").rlike("^[#&]") & F.col("rest").contains("#")).distinct()
    met = each.groupBy("rest").agg(F.sort_array(F.collect_set("word")).alias("ws")).where("size(ws) > 1")
    pairs = met.select(F.expr("inline(flatten(transform(ws, (x, i) -> transform(slice(ws, i + 2, size(ws)), y -> struct(x as x, y as y)))))")).groupBy("x", "y").agg(F.count("*").alias("m"))
    letter = F.col("x").endswith(".") | F.col("y").endswith(".")
    counts = each.groupBy("word").agg(F.count("*").alias("n"))
    pairs = pairs.join(counts.select(F.col("word").alias("x"), F.col("n").alias("nx")), "x").join(counts.select(F.col("word").alias("y"), F.col("n").alias("ny")), "y")
    # an initial stands for several given names, so it is held against the word's rests
    base = F.when(F.col("x").endswith("."), F.col("ny")).when(F.col("y").endswith("."), F.col("nx")).otherwise(F.least("nx", "ny"))
    alias = pairs.where((F.col("m") >= ALIAS_LEAST) & (F.col("m") >= F.when(letter, ALIAS / 4).otherwise(ALIAS) * base)).select("x", "y").collect()
    # words that stand together
    marked = F.array_distinct(F.concat(
        F.filter(F.col("toks.key"), lambda k: ~k.rlike(r"^[#&]|\.$")), F.when(F.exists(F.col("toks.key"), lambda k: k.rlike(r"^.\.$")), F.array(F.lit(INITIAL))).otherwise(F.array().cast("array<string>")),
        F.when(F.size(F.filter(F.col("toks.key"), lambda k: k.startswith("#"))) > 1, F.array(F.lit(SECOND))).otherwise(F.array().cast("array<string>"))))
    w = forms.select(F.sort_array(marked).alias("ws"))
    n_w = w.select(F.explode("ws").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    total = forms.count()
    co = w.select(F.expr("inline(flatten(transform(ws, (x, i) -> transform(slice(ws, i + 2, size(ws)), y -> struct(x as x, y as y)))))")).groupBy("x", "y").agg(F.count("*").alias("m"))
    co = co.join(n_w.select(F.col("word").alias("x"), F.col("n").alias("nx")), "x").join(n_w.select(F.col("word").alias("y"), F.col("n").alias("ny")), "y")
    together = co.where(F.col("m") * total * 10 >= F.col("nx") * F.col("ny")).select("x", "y").collect()
    # rests of which both are met more often than by chance, though not mostly: words that say nothing, such as titles
    rests = each.select("rest").distinct().count()
    together += pairs.where(~letter & (F.col("m") > 1) & (F.col("m") >= ALIAS / 4 * base) & (F.col("m") * rests >= 3 * F.col("nx") * F.col("ny"))).select("x", "y").collect()
    # an initial is only known not to stand with a word that is met often enough
    initials = (n_w.where(F.col("word") == INITIAL).first() or {"n": 0})["n"]
    together += n_w.where((F.col("n") * initials < 5 * total) & (F.col("word") != INITIAL)).select("word", F.lit(INITIAL).alias("y")).collect()
    cut = {r["word"] for r in forms.select(F.explode(F.split("form", " ")).alias("t")).select(F.split("t", ">").alias("p")).where("p[1] <> ''").groupBy(_word_of(F.col("p")[0]).alias("word"), F.col("p")[1].alias("g")).agg(
        F.avg(F.col("p")[0].endswith(".").cast("int")).alias("dots")).where("dots > 0.3 and word = g").select("word").collect()}
    generic = sorted({r["word"] for r in n_w.select("word").collect()} - {INITIAL, SECOND})
    known = {*generic, INITIAL, SECOND}
    ok = lambda x: x in known or x[-1] == "."
    return Learnt(generic, [(r["x"], r["y"]) for r in alias if ok(r["x"]) and ok(r["y"])], [(r[0], r[1]) for r in together], cut)


def _pair_groups(sent):
    """Groups of two tokens, by the one and the first letter of the other: of a form without a word that tells all its tokens,
    of others each frequent word that isn't generic with what isn't generic either."""

    def run(batches):
        rep = sent.value.rep
        for batch in batches:
            out = []
            for form, keys, tells in zip(*(c.to_pylist() for c in batch.columns[:3])):
                of = [(rep.get(k, k), {k.strip("#&")[0], rep.get(k, k).strip("#&")[0]}, t) for k, t in zip(keys, tells)]
                some = any(tells)
                known = lambda a: some and a[0] != "#" and a[-1] != "." and a[0] != "&"
                got = {f"{a} {c}" for i, (a, _, t) in enumerate(of) if len(a.strip("#&.")) > 1 and not known(a) and not t for j, (b, cs, _) in enumerate(of) if i != j and not known(b) for c in cs}
                out += [(g, form, len(keys)) for g in sorted(got)]
            yield _block(out, {"group": pa.string(), "form": pa.string(), "size": pa.int32()})

    return run


def name_classes(spellings: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(spelling, name) of every spelling (column spelling) that has a word; equal names are one entity. `nicknames` gives, folded,
    short forms and what they stand for, beside what is learnt."""
    spark = spellings.sparkSession
    s = spellings.select("spelling").where("spelling is not null and trim(spelling) <> ''").distinct()
    r = stage(spread(s, "spelling").mapInArrow(_read, "spelling string, raw string"))
    raws = stage(r.select("raw").distinct())
    words, near = word_table(raws)
    f = stage(read_forms(raws, words))
    sent = spark.sparkContext.broadcast(learn(f))
    telling = F.filter("toks", lambda t: t["tells"])
    g = f.select(F.explode(F.array_distinct(F.transform(telling, lambda t: t["root"]))).alias("group"), "form", F.size("toks").alias("size"))
    g = g.unionByName(f.where(F.exists("toks", lambda t: ~t["tells"] & t["key"].startswith("#")) | (F.size(telling) == 0)).select("form", F.col("toks.key").alias("keys"), F.col("toks.tells").alias("tells")).mapInArrow(_pair_groups(sent), "group string, form string, size int"))
    g = stage(g)
    parts = g.groupBy("group").agg(F.ceil(F.sqrt(F.count("*")) / 8).alias("parts"))
    rows = g.join(parts, "group").withColumn("part", F.pmod(F.xxhash64("form"), F.col("parts")))
    rows = spread(rows, "group", "part").sortWithinPartitions("group", "part", F.desc("size"), "form").select("group", "part", "form")
    merged = stage(rows.mapInArrow(_merge(sent, nicknames), "group string, form string, lead string, slots string, tell int, n int"))
    once = merged.where("form is null").select("group", "slots", "tell", "n", "lead")
    rows = spread(once, "group").sortWithinPartitions("group", F.desc("tell"), F.desc("n"), "lead").select("group", "slots")
    got = stage(rows.mapInArrow(_name(sent, nicknames), "group string, lead string, name string, slots string, words array<string>, tell int, n int"))
    named = stage(merged.where("form is not null").select("group", "form", "lead").join(got.where("group is not null").select("group", "lead", "name"), ["group", "lead"]).select("form", "name"))
    # words that are neighbours and ended in two groups: the names of both are compared, the less telling put to the more
    node = lambda c: words.where("tells").select(F.col("word").alias(c), F.col("root").alias(f"{c}_root"))
    apart = near.join(node("a"), "a").join(node("b"), "b").where("a_root <> b_root").select("a", "b")
    side = lambda c: got.where("group is null").select(F.explode("words").alias(c), F.struct("tell", "n", "name", "slots").alias(f"{c}_name"))
    across = apart.join(side("a"), "a").join(side("b"), "b").where("a_name.name <> b_name.name").select(F.least("a_name", "b_name").alias("l"), F.greatest("a_name", "b_name").alias("h"))
    across = across.select(F.col("l.name").alias("low"), F.col("l.slots").alias("low_slots"), F.col("h.name").alias("high"), F.col("h.slots").alias("high_slots")).distinct()
    more = spread(across, "low").sortWithinPartitions("low", F.desc("high")).mapInArrow(_across(sent, nicknames), "a string, b string")
    links = named.join(named.groupBy("form").agg(F.min("name").alias("low")), "form").select(F.col("name").alias("a"), F.col("low").alias("b"))
    one = components(links.unionByName(more))
    form_name = named.groupBy("form").agg(F.min("name").alias("name"))
    form_name = form_name.join(one, form_name.name == one.node, "left").select("form", F.coalesce("component", "name").alias("name"))
    return r.join(f.select("raw", "form"), "raw").join(form_name, "form", "left").select("spelling", F.coalesce("name", "form").alias("name"))


def field_spellings(projects: DataFrame, values: DataFrame, definitions: DataFrame) -> DataFrame:
    """(spelling) of the organisations of projects and of the owners and makers of passports."""
    d = definitions.where(F.col("field_name").isin("company_name", "manufacturer")).select(F.col("id").alias("d_id"), F.col("leksikon_guid").alias("d_guid"))
    ids, guids = d.select(F.col("d_id").alias("property_id")).where("property_id is not null").distinct(), d.select(F.col("d_guid").alias("leksikon_guid")).where("leksikon_guid is not null").distinct()
    v = values.select("property_id", "leksikon_guid", F.decode(F.col("value"), "UTF-8").alias("spelling")).where("value is not null")
    by_id, by_guid = v.join(ids, "property_id", "left_semi"), v.where("property_id is null").join(guids, "leksikon_guid", "left_semi")
    return projects.select(F.col("survey_organisation").alias("spelling")).unionByName(by_id.select("spelling")).unionByName(by_guid.select("spelling")).distinct()


def same_name_pairs(spellings: DataFrame, nicknames: dict[str, str] | None = None) -> DataFrame:
    """(name_a, name_b), a < b by code point, of all spellings of one name."""
    c = stage(name_classes(spellings, nicknames))
    a, b = c.select(F.col("spelling").alias("name_a"), "name"), c.select(F.col("spelling").alias("name_b"), "name")
    return a.join(b, "name").where("name_a < name_b").select("name_a", "name_b")
