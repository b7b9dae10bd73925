"""Recall and precision of the links on made-up rows whose truth is known. All words are drawn at random, so nothing of them can stand in the library; street types
and abbreviations are of the kinds the address reader's dictionary has."""

import random

from plumbline.llm import addresses, names


def word(rng, n):
    return "".join(rng.choice("bdfgklmnprstv") + rng.choice("aeiou") for _ in range(n))


def typo(rng, s):
    i = rng.randrange(1, len(s) - 1)
    return rng.choice([s[:i] + s[i + 1 :], s[:i] + s[i] + s[i:], s[:i] + rng.choice("xqz") + s[i + 1 :], s[:i] + s[i + 1] + s[i] + s[i + 2 :]])


def measured(got, groups):
    want = {tuple(sorted((a, b))) for g in groups for i, a in enumerate(g) for b in g[:i] if a != b}
    return len(got & want) / len(want), len(got & want) / max(1, len(got))


def test_names(spark):
    rng = random.Random(8)
    trades, legals, towns, given = ([word(rng, n).title() for _ in range(k)] for n, k in ((4, 6), (2, 4), (3, 12), (4, 6)))
    nick = {g: word(rng, 2).title() for g in given}
    groups = []
    for _ in range(260):
        core, partner = word(rng, 5).title(), word(rng, 5).title()
        if rng.random() < 0.3:
            g, i = rng.choice(given), rng.choice("BCDF")
            forms = {f"{g} {i}. {core}", f"{core}, {g}", f"{nick[g]} {core}", f"{g[0]}. {core}", f"{g} {typo(rng, core)}", f"{g} {core}".upper()}
        else:
            t, le, town = rng.choice(trades), rng.choice(legals), rng.choice(towns)
            two = rng.random() < 0.4
            name = f"{core} & {partner}" if two else core
            forms = {f"{name} {t} {le}", f"{name} {t[:4]}. {le}", f"{t} {name} {le}", f"{typo(rng, core)}{' & ' + partner if two else ''} {t}", f"{name} {t} {town} {le}", f"{core} {t} {le}".lower()}
        groups.append(sorted(forms))
    # other firms and persons of the same words
    for g in rng.sample(groups, 25):
        longest = max(g[0].replace(",", "").split(), key=len)
        groups.append([f"{longest.title()} {rng.choice(trades)} {rng.choice(legals)}"])
    spellings = [s for g in groups for s in g]
    got = {tuple(r) for r in names.same_name_pairs(spark.createDataFrame([(s,) for s in dict.fromkeys(spellings)], "spelling string")).collect()}
    recall, precision = measured(got, groups)
    print(f"names: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.95


def test_addresses(spark):
    rng = random.Random(9)
    towns = [(word(rng, 3).title(), str(1000 + 37 * k)) for k in range(25)]
    kinds = [("vej", "v."), ("gade", "gd."), ("strasse", "str."), (" street", " st."), (" road", " rd.")]
    groups = []
    for _ in range(150):
        first = f"{rng.choice(['Ny', 'Gamle', 'Store'])} " * (rng.random() < 0.2)
        name, (kind, short), n, (town, code) = first + word(rng, 5).title(), rng.choice(kinds), rng.randrange(1, 300), rng.choice(towns)
        letter = rng.choice(["", "", "a", "b"])
        groups.append([f"{name}{kind} {n}{letter}, {code} {town}", f"{code} {town}, {name}{short} {n}{letter.upper()}", f"{n}{letter} {name}{kind}, {town}", f"{name}{kind} {n} {letter}, 2. tv, {code}".replace(" ,", ","),
                       f"{first}{typo(rng, name[len(first):])}{kind} {n}{letter}, {code} {town}", f"{name}{kind} nr. {n}{letter}, {typo(rng, town)}, Danmark".upper()])
        if rng.random() < 0.3:  # another number, letter or first word is another place
            groups.append([rng.choice([f"{name}{kind} {n + 1}{letter}, {code} {town}", f"{name}{kind} {n}{'c'}, {code} {town}", f"Lille {word(rng, 5).title()}{kind} {n}{letter}, {code} {town}"])])
    ids = {f"p{i:04d}": k for i, k in enumerate(k for k, g in enumerate(groups) for _ in g)}
    rows = list(zip(ids, (a for g in groups for a in g)))
    got = {tuple(r) for r in addresses.same_place_pairs(spark.createDataFrame(rows, "id string, building_address string")).collect()}
    by = {}
    for i, k in ids.items():
        by.setdefault(k, []).append(i)
    recall, precision = measured(got, list(by.values()))
    print(f"addresses: recall {recall:.3f}, precision {precision:.3f}")
    assert recall >= 0.9 and precision >= 0.95
