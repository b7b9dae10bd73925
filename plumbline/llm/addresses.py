"""Same postal address written differently (problem 2).

Method: MinHash banding on token and q-gram shingles gives candidates; each candidate pair is checked by an affine-gap
alignment of the two token sequences, whose substitution costs know the abbreviations.

1. An address is read into the words of its street, street type, house number with letter, postcode and town. Floor, door, part of
   the building, country and postal prefixes fall away. Which town a postcode belongs to is learnt from the rows that
   have both, so a row with only one of them can be placed; misspelt towns are found by a trie join. All of this is joins.
2. What is written alike after that is one form, whatever its number of rows. Forms are banded by their house number
   (a token that must agree) and minhashes of q-grams of the street and of all tokens.
3. In a band each form is compared with the members of every cluster met so far until one matches, and one link per
   cluster is emitted, so no pairs of one cluster are; bands are worked through in SALTS parts, a place whole in one.
4. Verified links make classes (connected components); pairs of projects are read off the classes.

Defined results
* null, blank and placeholder addresses, and those without street or number, denote no place;
* a project with several addresses belongs to all their places; null ids are dropped; a pair comes once;
* empty tables give an empty result; long texts are read whole; extra columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.names import neighbours
from plumbline.llm.words import bound, distance, fold
from plumbline.operators.components import components
from plumbline.session import spread, stage

#: Street types with their abbreviations, in folded spelling. A type may be a word or the end of one.
STREET_TYPES = {
    "gade": ["gade", "gaden", "gd", "g"], "vej": ["vej", "vejen", "vj", "v"], "straede": ["strade", "stradet", "str"], "vaenge": ["vange", "vanget", "vg"],
    "torv": ["torv", "torvet", "tv"], "alle": ["alle", "alleen", "al"], "platz": ["platz", "plaz", "pl"], "hof": ["hof", "hf"],
    "weg": ["weg", "wg", "w"], "strasse": ["strasse", "strase", "str"], "street": ["street", "st", "str"], "road": ["road", "rd"],
    "avenue": ["avenu", "aven", "ave", "av"], "lane": ["lane", "ln", "la"],
}
ENGLISH = ["street", "road", "avenue", "lane"]
#: Words of street names that are written short.
SHORT = {"gl": "gamle", "ndr": "nordre", "sdr": "sondre", "skt": "sankt"}
#: Words that say nothing about the place.
COUNTRIES = ["denmark", "danmark", "danemark", "deutschland", "germany", "tyskland", "uk", "england", "united kingdom", "great britain", "sweden", "sverige"]
PREFIXES = ["dk", "de", "d", "pc", "uk", "gb", "se", "s"]
PLACEHOLDERS = ["unknown", "ukendt", "unbekannt", "n/a", "na", "none", "null", "tbd", "site office", "se tegning", "siehe zeichnung", "see drawing", "-", "?"]
_FLOOR = re.compile(
    r"\(?\b(?:st|\d{1,2})\s?\.?\s?,?\s?(?:tv|th|mf)\b\.?\)?|\(?\b\d{1,2}\s?\.?\s?(?:og|etage|sal|stock|floor|obergeschoss)\b\.?(?:\s?(?:tv|th|mf)\b\.?)?\)?"
    r"|\b(?:floor|etage|sal|level|stue)\s?(?:\d{1,2}\b|\d(?=\d{4}\b))|\b(?:kl|stuen|parterre|eg|ug)\b\.?(?=\s*(?:,|;|$))")
_PART = re.compile(r"\b(?:blok|block|hal|halle|hall|haus|house|bygning|building|gebaude|opgang|unit|flat|apt|tower|annex)\s(?:[a-z]|\d{1,2})\b(?!\s*[a-z]\d)|\b(?:north|south|east|west|nord|syd|ost|vest|sud)\s?(?:wing|flugel|floj)\b|\b(?:annex|anneks|lagerbygning|warehouse|seitenflugel|hinterhaus|baghus|forhus)\b")
_COUNTRY = re.compile(r"\b(?:" + "|".join(COUNTRIES) + r")\b\.?")
_POSTCODE = re.compile(r"\b(?:(?:" + "|".join(PREFIXES) + r")[\s-]\s?)(\d{4,5})\b")
_TOKEN = re.compile(r"#?\d+|[^\W\d_]+\.?")
_NUMBER_WORD = re.compile(r"\b(?:nr|no|number|num|nummer)\b\.?\s?(?=#?\d)|#\s?(?=\d)")

_CAMEL = re.compile(r"(?<=[a-zæøåäöüß])(?=[A-ZÆØÅÄÖÜ][a-zæøåäöüß.])")

#: Short ends that can be read in two ways, as (letters that belong to the name, type).
EITHER = {"tv": [("", "torv"), ("t", "vej")], "vg": [("", "vaenge"), ("v", "gade")], "wg": [("", "weg"), ("w", "gade")]}
_ENDS = sorted(((a, t) for t, all_ in STREET_TYPES.items() for a in all_), key=lambda x: -len(x[0]))
_WORDS = {a: t for t, all_ in STREET_TYPES.items() for a in all_}

BANDS, ROWS, Q, SALTS = 24, 2, 3, 8
_rng = np.random.default_rng(20240501)
_A = _rng.integers(1, (1 << 61) - 1, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)
_B = _rng.integers(0, (1 << 61) - 1, BANDS * ROWS, dtype=np.uint64)


def street_type(word: str) -> tuple[str, str, int] | None:
    """(name, type, how sure) of a word that ends in a street type; short ends only count with a dot."""
    bare = word.rstrip(".")
    for end, kind in _ENDS:
        if bare.endswith(end) and len(bare) - len(end) >= 4:
            if len(end) >= 3 and end not in ("str", "ave"):
                return bare[: -len(end)], kind, 2
            if word.endswith("."):
                return bare[: -len(end)], "str" if end == "str" else end if end in EITHER else kind, 1
    return None


def parse(text: str | None) -> tuple[str, str, str, str, str] | None:
    """(street name, street type, number with letter, postcode, town) in folded spelling; what is missing is empty, and name
    and town hold all their words, in order. None where no street and number are found."""
    if text is None:
        return None
    s = re.sub(r"\s+", " ", fold(_CAMEL.sub(" ", text))).strip(" ,;")
    if not s or s.strip(" .") in PLACEHOLDERS:
        return None
    s = _COUNTRY.sub(" ", s)
    postcode = ""
    if m := _POSTCODE.search(s):
        postcode, s = m[1], s[: m.start()] + " , " + s[m.end() :]
    s = _PART.sub(" , ", s)
    s = _FLOOR.sub(" , ", s)
    s = _NUMBER_WORD.sub(" #", s)
    tokens = [(m[0], m.start(), m.end()) for m in _TOKEN.finditer(s)]
    digits = [i for i, t in enumerate(tokens) if t[0][-1].isdigit()]
    marked = [i for i in digits if tokens[i][0][0] == "#"]
    words = [i for i, t in enumerate(tokens) if not t[0][-1].isdigit() and len(t[0].rstrip(".")) > 1 and t[0].rstrip(".") not in PREFIXES]
    # the street: a separate type word behind its name, or a word that ends in a type
    name = kind = ""
    street: set[int] = set()
    best = 0
    for i in words:
        bare = tokens[i][0].rstrip(".")
        if bare in _WORDS and i - 1 in words and len(tokens[i - 1][0].rstrip(".")) >= 4 and (len(bare) > 2 or tokens[i][0].endswith(".") or _WORDS[bare] in ENGLISH) and s[tokens[i - 1][2] : tokens[i][1]].strip(" -") == "" and best < 3:
            name, kind, street, best = tokens[i - 1][0].rstrip("."), _WORDS[bare] if bare != "str" else "str", {i - 1, i}, 3
        elif best < 2 and (got := street_type(tokens[i][0])) and got[2] > best:
            name, kind, street, best = got[0], got[1], {i}, got[2]
    # a single letter with a dot can be the type as well: "name g. 23"
    for i, t in enumerate(tokens):
        if not best and len(t[0]) == 2 and t[0][1] == "." and t[0][0] in _WORDS and i and i - 1 in words:
            name, kind, street, best = tokens[i - 1][0].rstrip("."), _WORDS[t[0][0]], {i - 1, i}, 2
    beside = lambda i: i in words and i + 1 in words and s[tokens[i][2] : tokens[i + 1][1]] in ("", " ", "-")
    rest = [i for i in words if i not in street]
    if not postcode:
        four = [i for i in digits if i not in marked and len(tokens[i][0]) in (4, 5)]
        other = [i for i in digits if i not in four]
        if four and (other or len(four) > 1):
            # of two numbers of four digits the one next to the street is the house number
            if len(four) > 1 and not other and street:
                four.sort(key=lambda i: -min(abs(i - j) for j in street))
            pick = four[0] if not other else four[-1] if len(four) == 1 else max(four, key=lambda i: min([abs(i - j) for j in street] or [0]))
            postcode = tokens[pick][0]
            digits = [i for i in digits if i != pick]
    if not digits or not street and len(digits) == 1 and len(tokens[digits[0]][0]) == 4 and not postcode:
        return None  # the only number is the postcode
    if not street and rest:
        near = lambda i: min(abs(i - d) + (0.5 if i > d else 0) for d in digits)
        i = min(rest, key=lambda i: (near(i), -len(tokens[i][0])))
        name, kind, street = tokens[i][0].rstrip("."), "", {i}
        rest = [j for j in rest if j != i]
    if not name:
        return None
    at = marked[0] if marked else min(digits, key=lambda i: min(abs(i - j) for j in street))
    digits_ = tokens[at][0].lstrip("#")
    if not postcode and 5 <= len(digits_) <= 7:  # the blank before the postcode was not typed
        digits_, postcode = digits_[:-4], digits_[-4:]
    # the whole street part: what stands before its word, and behind it up to the number, or, without a type, behind the number
    first, last = min(street), max(street)
    while beside(first - 1):
        first -= 1
    end = last
    while beside(end):
        end += 1
    if end + 1 == at and s[tokens[end][2] : tokens[at][1]].strip(" -") == "" or not kind and first - 1 == at:
        last = end
    before, after = ([SHORT.get(w, w) for i in part if (w := tokens[i][0].rstrip("."))] for part in (range(first, min(street)), range(max(street) + 1, last + 1)))
    name = " ".join([*before, name, *after])
    rest = [i for i in rest if not first <= i <= last]
    number = str(int(digits_))
    if at + 1 < len(tokens) and re.fullmatch(r"[a-z]\.?", tokens[at + 1][0]) and s[tokens[at][2] : tokens[at + 1][1]].strip() == "":
        number += tokens[at + 1][0][0]
    towns = [tokens[i][0].rstrip(".") for i in rest]
    towns = [w for w in towns if len(w) > 2]
    return name, kind, number, postcode, " ".join(towns)


def same_type(a: str, b: str) -> bool:
    if "str" in (a, b):
        return {a, b} <= {"str", "straede", "strasse", "street", ""}
    return a == b or not a or not b


#: What a missing token costs, by its part: a word of the street, its type, the number, a word of the place.
GAP = {"w": 9.0, "t": 0.3, "n": 9.0, "p": 0.4}
#: An edit; a token read as another part; two tokens written as one or in the other order; what is never the same.
EDIT, PART, JOINED, NEVER = 0.35, 0.4, 0.1, 9.0
_SPELT = {t: [x for x in (t, *all_) if len(x) >= 3] for t, all_ in STREET_TYPES.items()}


def token_list(form: tuple[str, ...]) -> list[tuple[str, str]]:
    """(name, type, number, place) as tokens (part, text), of any number of words, in the order of an address."""
    name, kind, number, place = form[:4]
    return [*(("w", w) for w in name.split()), *((("t", kind),) if kind else ()), ("n", number), *(("p", w) for w in place.split())]


@lru_cache(200_000)
def replacing(x: tuple[str, str], y: tuple[str, str]) -> float:
    """The cost of one token for another: edits of a word, an abbreviation or a slip of a type, a word read as another part."""
    (p, a), (q, b) = x, y
    if p == q and a == b:
        return 0.0
    if "n" in (p, q) or a[0].isdigit() or b[0].isdigit():
        return NEVER
    if p == q == "t":
        return 0.0 if same_type(a, b) else NEVER
    if "t" in (p, q):
        kind, word = (a, b) if p == "t" else (b, a)
        return PART + EDIT if any(len(word) >= 3 and distance(word, t, 1) <= 1 for t in _SPELT.get(kind, ())) else NEVER
    d, most = distance(a, b, bound(a, b)), bound(a, b)
    return EDIT * d + PART * (p != q) if d <= most else NEVER


def alignment_cost(a: list[tuple[str, str]], b: list[tuple[str, str]]) -> float:
    """Affine-gap alignment of two token lists; 0 for the same place, 1 and more for another.

    Any token may stand against any other at the cost of `replacing`; a run of missing ones opens a gap at the cost of its first
    and half of each further one, but not on both sides at one spot, as two different tokens there contradict each other; two
    neighbours may stand in the other order, or be written as one word."""
    n, k, inf = len(a), len(b), 99.0
    several = sum(p == "p" for p, _ in a) > 1 or sum(p == "p" for p, _ in b) > 1
    both = any(p == "p" for p, _ in a) and any(p == "p" for p, _ in b)
    gap = lambda t: GAP[t[0]] + 0.2 * (t[0] == "p" and several and both)

    def one_word(two, word) -> float:
        if word[0] not in "wp" or two[0][0] not in "wp" or two[1][0] not in "wtp":
            return inf
        kinds = {two[1][1], *STREET_TYPES.get(two[1][1], ())} if two[1][0] == "t" else [two[1][1]]
        most = lambda t: bound(two[0][1] + t, word[1]) if len(t) > 2 else 0
        got = min((d for t in kinds if (d := distance(two[0][1] + t, word[1], most(t))) <= most(t)), default=9)
        return JOINED + EDIT * got if got < 9 else inf

    m = [[inf] * (k + 1) for _ in range(n + 1)]  # tokens stand against each other, gap in b, gap in a
    g = [[inf] * (k + 1) for _ in range(n + 1)]
    h = [[inf] * (k + 1) for _ in range(n + 1)]
    best = [[inf] * (k + 1) for _ in range(n + 1)]
    m[0][0] = best[0][0] = 0.0
    for i in range(n + 1):
        for j in range(k + 1):
            if i and j:
                m[i][j] = best[i - 1][j - 1] + replacing(a[i - 1], b[j - 1])
            if i > 1 and j > 1:
                m[i][j] = min(m[i][j], best[i - 2][j - 2] + JOINED + replacing(a[i - 2], b[j - 1]) + replacing(a[i - 1], b[j - 2]))
            if i > 1 and j and best[i - 2][j - 1] < 1:
                m[i][j] = min(m[i][j], best[i - 2][j - 1] + one_word(a[i - 2 : i], b[j - 1]))
            if i and j > 1 and best[i - 1][j - 2] < 1:
                m[i][j] = min(m[i][j], best[i - 1][j - 2] + one_word(b[j - 2 : j], a[i - 1]))
            if i:
                g[i][j] = min(m[i - 1][j] + gap(a[i - 1]), g[i - 1][j] + gap(a[i - 1]) / 2)
            if j:
                h[i][j] = min(m[i][j - 1] + gap(b[j - 1]), h[i][j - 1] + gap(b[j - 1]) / 2)
            if i or j:
                best[i][j] = min(m[i][j], g[i][j], h[i][j])
    return best[n][k]


def same_place(a: tuple[str, ...], b: tuple[str, ...]) -> bool:
    """Whether two forms (name, type, number, place) are one place: at most two slips, or one and a missing part."""
    if a[2] != b[2]:
        return False
    if a[1] in EITHER or b[1] in EITHER:
        read_as = lambda f: [(f[0] + more, kind, *f[2:]) for more, kind in EITHER[f[1]]] if f[1] in EITHER else [f]
        return any(same_place(x, y) for x in read_as(a) for y in read_as(b))
    return alignment_cost(token_list(a), token_list(b)) < 1.0


def _parsed(batches):
    for batch in batches:
        got = [parse(t) for t in batch.column(0).to_pylist()]
        keep = [i for i, g in enumerate(got) if g]
        cols = list(zip(*(got[i] for i in keep))) or [[]] * 5
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), *(pa.array(c, pa.string()) for c in cols)], names=["address", "name", "kind", "number", "postcode", "town"])


def _town_codes(seen: DataFrame, words: DataFrame) -> DataFrame:
    """(word, code, exact, sure) of each word (column word) that is a town whose postcode the rows (postcode, town, n) tell by majority, or
    that is the misspelling of such towns of one postcode only. All by joins: towns are as many as there are spellings."""
    order = lambda n, *c: F.struct(n, *c)
    by_code = seen.groupBy("postcode").agg(F.max_by("town", order("n", "town")).alias("town"))
    by_town = seen.groupBy("town").agg(F.max_by("postcode", order("n", "postcode")).alias("postcode"), F.max("n").alias("most"))
    known = stage(by_town.join(by_code, ["postcode", "town"]).select(F.col("town").alias("word"), F.col("postcode").alias("code"), (F.col("most") >= 3).alias("sure")))
    sure = by_town.where("most >= 3").select(F.col("town").alias("word"))
    exact = words.join(known, "word").select("word", "code", F.lit(True).alias("exact"))
    open_ = words.join(known, "word", "left_anti")
    near = neighbours(open_.select("word").unionByName(known.select("word")))
    near = near.select(F.col("a").alias("word"), F.col("b").alias("town")).unionByName(near.select(F.col("b").alias("word"), F.col("a").alias("town")))
    near = near.join(open_, "word", "left_semi").join(known.select(F.col("word").alias("town"), "code"), "town")
    near = near.groupBy("word").agg(F.min("code").alias("code"), F.max("code").alias("hi")).where("code = hi").select("word", "code", F.lit(False).alias("exact"))
    return exact.unionByName(near).join(sure.withColumn("sure", F.lit(True)), "word", "left").select("word", "code", "exact", F.coalesce("sure", F.lit(False)).alias("sure"))


def _resolve(batches):
    """Rows (address, name, kind, number, postcode, town, known, code, sure, first_code, first_exact, last_code, last_exact): `known` is the town of the
    postcode, `code` that of the town. A town that was read as the first or last word of the street, as no comma stood between, is taken out of it."""
    for batch in batches:
        names, places = [], []
        for name, code, town, known, own, sure, *ends in zip(*(batch.column(i).to_pylist() for i in (1, 4, 5, 6, 7, 8, 9, 10, 11, 12))):
            words = name.split()
            if not town and len(words) > 1:
                for w, rest, c, exact in ((words[0], words[1:], *ends[:2]), (words[-1], words[:-1], *ends[2:])):
                    if known and distance(w, known, bound(w, known)) <= bound(w, known) or c and (exact or len(w) > 5):
                        name, town, own, sure = " ".join(rest), w, c, False
                        break
            if not code:
                place = own or town
            elif own and own != code and (not known or sure and distance(town, known, bound(town, known)) > bound(town, known)):
                place = own  # the town is well known and has another postcode, which isn't one of several: the digits are mistyped
            else:
                place = code
            names.append(name)
            places.append(place)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), *batch.columns[2:4], pa.array(places, pa.string())], names=["address", "name", "kind", "number", "place"])


def read(projects: DataFrame) -> DataFrame:
    """(address, name, kind, number, place) of each distinct address. `place` is the postcode where it or the town tell it,
    else the town as written; where neither is, the place all other addresses of that street and number agree on."""
    texts = projects.select(F.col("building_address").alias("address")).where("address is not null").distinct()
    p = stage(spread(texts, "address").mapInArrow(_parsed, "address string, name string, kind string, number string, postcode string, town string"))
    longest = F.expr("array_max(transform(split(town, ' '), w -> struct(length(w) as n, w as w))).w")
    ends = F.when((F.col("town") == "") & F.col("name").contains(" "), F.col("name"))
    p = p.withColumn("longest", longest).withColumn("first", F.substring_index(ends, " ", 1)).withColumn("last", F.substring_index(ends, " ", -1))
    seen = p.where("postcode <> '' and town <> ''").groupBy("postcode", "town").agg(F.count("*").alias("n"))
    words = p.select(F.explode(F.array_distinct(F.array("town", "longest", "first", "last"))).alias("word")).where("word <> ''").distinct()
    t = stage(_town_codes(stage(seen), words))
    of = lambda c, *more: t.select(F.col("word").alias(c), F.col("code").alias(f"{c}_code"), *(F.col(m).alias(f"{c}_{m}") for m in more))
    by_code = seen.groupBy("postcode").agg(F.max_by("town", F.struct("n", "town")).alias("known"))
    j = p.join(by_code, "postcode", "left").join(of("town", "sure", "exact"), "town", "left").join(of("longest"), "longest", "left").join(of("first", "exact"), "first", "left").join(of("last", "exact"), "last", "left")
    # a town of several words that isn't known as it stands is looked up by its longest word
    code = F.when(F.col("town").contains(" ") & ~F.coalesce("town_exact", F.lit(False)), F.col("longest_code")).otherwise(F.col("town_code"))
    j = j.select("address", "name", "kind", "number", "postcode", "town", "known", code.alias("code"), F.coalesce("town_sure", F.lit(False)).alias("sure"), "first_code", "first_exact", "last_code", "last_exact")
    r = stage(j.mapInArrow(_resolve, "address string, name string, kind string, number string, place string"))
    only = r.where("place <> ''").groupBy("name", "number").agg(F.min("place").alias("lo"), F.max("place").alias("hi")).where("lo = hi")
    return r.join(only, ["name", "number"], "left").select("address", "name", "kind", "number", F.when(F.col("place") != "", F.col("place")).otherwise(F.coalesce("lo", F.lit(""))).alias("place"))


def _bands(batches):
    """Rows (form): (band, form), one row per band. The shingles are the q-grams of the street and its tokens, the number and the
    place among them."""
    for batch in batches:
        forms = batch.column(0).to_pylist()
        keys = []
        for form in forms:
            name, kind, number, place = form.split("|")
            if kind in EITHER:
                name, kind = name + EITHER[kind][1][0], ""
            street = name.replace(" ", "") + ("str" if kind in ("straede", "strasse", "street", "str") else kind)
            shingles = {hash_text(street[i : i + Q]) for i in range(max(1, len(street) - Q + 1))} | {hash_text(f"{p} {t}") for p, t in token_list((name, "", number, place))}
            x = np.fromiter(shingles, np.uint64, len(shingles))
            with np.errstate(over="ignore"):
                low = ((x[:, None] * _A + _B) >> np.uint64(3)).min(axis=0).reshape(BANDS, ROWS)
                key = (low[:, 0] * np.uint64(0x9E3779B97F4A7C15) ^ low[:, 1]) * np.uint64(0xC2B2AE3D27D4EB4F) + np.arange(BANDS, dtype=np.uint64) + np.uint64(hash_text(number))
            keys.append(key.astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), pa.array(np.repeat(np.array(forms, object), BANDS), pa.string())], names=["band", "form"])


def hash_text(s: str) -> int:
    """FNV-1a over UTF-8, 64 bits: the same on every worker."""
    h = 0xCBF29CE484222325
    for b in s.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def _link(batches):
    """Rows sorted by (band, salt), those without a place last: one link of each form to every cluster of its band that has a
    member it matches, whichever member that is; the clusters it links become one. A form without a place gets weak links
    to placed clusters, and joins others without a place in the first salt only, as it is sent to all of them."""
    here, by_place = None, {}
    for batch in batches:
        out: list[tuple] = []
        for band, salt, id_ in zip(*(c.to_pylist() for c in batch.columns)):
            if (band, salt) != here:
                here, by_place = (band, salt), {}
            form = tuple(id_.split("|"))
            place = form[3]
            mine = [[(id_, form)]]
            # digits must agree; those without a place come last
            for other in [place] if place[:1].isdigit() else list(by_place):
                if place and other[:1].isdigit() != place[0].isdigit():
                    continue
                for cluster in by_place.get(other, []):
                    hit = next((x for x, g in cluster if same_place(form, g)), None)
                    if hit is not None:
                        out.append((id_, hit, place == "" != other))
                        if other == place:
                            mine.append(cluster)
            if place or not salt:
                kept = [c for c in by_place.get(place, []) if not any(c is m for m in mine)]
                by_place[place] = [*kept, [x for m in mine[1:] + mine[:1] for x in m]]
        a, b, weak = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(weak, pa.bool_())], names=["a", "b", "weak"])


def place_classes(projects: DataFrame) -> DataFrame:
    """(address, class) of every address that denotes a place; the class is one of its forms."""
    r = stage(read(projects).withColumn("form", F.concat_ws("|", "name", "kind", "number", "place")))
    forms = r.select("form").distinct()
    bands = stage(spread(forms, "form").mapInArrow(_bands, "band long, form string").withColumn("place", F.substring_index("form", "|", -1)))
    # a place is in one salt of its band, all places told by words in the first; forms without a place go to every salt there is
    bands = bands.withColumn("salt", F.when(F.col("place").rlike("^[0-9]"), F.pmod(F.xxhash64("place"), F.lit(SALTS))).otherwise(F.lit(0).cast("long")))
    several = bands.groupBy("band").agg(F.count("*").alias("n"), F.array_union(F.array(F.lit(0).cast("long")), F.collect_set("salt")).alias("salts")).where("n > 1").select("band", "salts")
    bands = bands.join(several, "band").withColumn("salt", F.explode(F.when(F.col("place") == "", F.col("salts")).otherwise(F.array("salt"))))
    rows = spread(bands, "band", "salt").sortWithinPartitions("band", "salt", F.col("place") == "", "form").select("band", "salt", "form")
    links = stage(rows.mapInArrow(_link, "a string, b string, weak boolean").distinct())
    c = components(links.where("not weak"))
    r = stage(r.join(c, r.form == c.node, "left").select("address", "form", F.coalesce("component", "form").alias("class")))
    # a class without a place joins the one placed class it matches; if there are several, it can't be told
    of = r.select("form", "class").distinct()
    weak = links.where("weak").select("a", "b").distinct().join(of.select(F.col("form").alias("a"), F.col("class").alias("from")), "a").join(of.select(F.col("form").alias("b"), F.col("class").alias("to")), "b")
    weak = weak.groupBy("from").agg(F.min("to").alias("lo"), F.max("to").alias("hi")).where("lo = hi").select(F.col("from").alias("class"), F.col("lo").alias("to"))
    return r.join(weak, "class", "left").select("address", F.coalesce("to", "class").alias("class"))


def project_places(projects: DataFrame) -> DataFrame:
    """(project_id, place_id): the place of every project whose address denotes one, one row per project and place."""
    m = projects.select("id", F.col("building_address").alias("address")).where("id is not null").distinct()
    return m.join(place_classes(projects), "address").select(F.col("id").alias("project_id"), F.md5("class").alias("place_id")).distinct()


def same_place_pairs(projects: DataFrame) -> DataFrame:
    """(project_id_a, project_id_b), a < b, of all projects at one place."""
    m = stage(project_places(projects)).select(F.col("project_id").alias("id"), F.col("place_id").alias("class"))
    a, b = m.select(F.col("id").alias("project_id_a"), "class"), m.select(F.col("id").alias("project_id_b"), "class")
    return a.join(b, "class").where("project_id_a < project_id_b").select("project_id_a", "project_id_b").distinct()
