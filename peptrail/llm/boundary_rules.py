"""The rules of sentence ends as data, compiled into a bimachine: an output table over left class, mark and right class.

What stands before a mark is read as one of a few left classes, what stands behind it as one of a few right classes; the table says for
each combination whether a sentence may end at the mark. Rules are (conditions, outcome) in order; the first that holds decides. Lists of
words are tables by language.
"""

from __future__ import annotations

import numpy as np

# Outcomes: no end; an end; an end only of a sentence that stands wholly in the brackets just closed.
NONE, END, CLOSED = range(3)

# Abbreviations that a sentence goes on after, in lower case without the last period.
GO_ON = {
    "en": "fig figs no nos nr dr prof cf e.g i.e ex exs sect sects vol vols pp p col cols l ll approx ca vs pat appl pub ser mr mrs ms st eq eqs ref refs resp chap para paras",
    "de": "abb abs tab z.b d.h o.g u.a vgl bzw ggf sog s.o s.u gem dipl dipl.-ing dr.-ing ing art bd hrsg kap lit ziff anm",
    "fr": "p.ex env éch mme mlle réf ap art ca cf no p",
    "es": "cap núm ej p.ej aprox sr sra srta dra ud uds pág págs ee",
    "ru": "рис стр см инж табл ок т.е напр п пп проф акад им гл разд т ст ср тел",
    "hi": "द डॉ प्रो पृ सं उदा क्र चि",
    "ar": "د",
    "th": "พ.ศ ค.ศ ดร",
}
# Abbreviations that may also end a sentence; what follows decides.
MAY_END = {
    "en": "etc al corp co ltd inc p.m a.m u.s u.s.a in lb lbs oz ft kg wt jr bros",
    "de": "usw gmbh f ff",
    "es": "s.a c.v uu",
    "ru": "др т.д т.п кг г гг",
}
# Names that an abbreviation is often the first part of, by what follows ("U.S. Pat.", "Co. Ltd.", "S.A. de C.V.", "EE. UU.").
PARTS = {
    "u.s": ("Pat",), "u.s.a": ("Pat",), "s.a": ("de C", "u."), "co": ("Ltd", "KG", "Inc"), "ltd": (), "inc": (), "gmbh": ("Co", "KG"), "ee": ("UU",), "uu": (),
}
# Articles before a number that make it an ordinal where a capital follows ("im 17. Kapitel").
BEFORE_ORDINAL = {"de": "der die das dem den des im am vom zum zur beim ins einer eines einem"}

GO_ON_WORDS, MAY_END_WORDS, ORDINAL_WORDS = (frozenset(w for words in t.values() for w in words.split()) for t in (GO_ON, MAY_END, BEFORE_ORDINAL))

# Left classes of a period: a plain token, an abbreviation that goes on, a unit of measure behind a number, abbreviations that may end a
# sentence (of Latin or other letters, an inch, part of a name, part of a name that goes on), a claim's number, an initial (or letters with
# periods between them in Thai), a number, an ordinal.
LEFT = ("plain", "abbreviation", "unit", "may", "may_latin", "inch", "name", "name_goes_on", "claim_number", "initial", "number", "ordinal")
# The character before a mark: blank, capital, lower case, caseless, Thai, digit, other, a closing sign.
PREV = "sUlotdxc"
# What follows: nothing that begins a sentence, a lower-case word of another script, a capital, a caseless letter, a digit.
BEGINS = "-fUod"
#: The mark's run: one period, several, one ellipsis, several.
RUNS = (".", "..", "…", "……")

# Features of each table, with their values.
FULL = {"closed": "01", "gap": "01", "next": (",", ".", "letter", "other")}
SHOUT = {"closed": "01", "gap": "01", "begins": BEGINS, "prev": PREV, "long": "01", "formula": "01", "word": "01", "opener": "01", "thai": "01"}
PERIOD = {"run": RUNS, "closed": "01", "gap": "01", "begins": BEGINS, "left": LEFT, "prev": PREV, "long": "01", "dotted": "01", "word": "01", "thai": "01"}

FULL_RULES = (
    ({"closed": "0", "next": (",",)}, NONE),
    ({"closed": "0"}, END),
    ({"next": (",", ".")}, NONE),
    ({"gap": "0"}, CLOSED),
    ({"next": ("letter",)}, CLOSED),
    ({}, END),
)
_BOTH = (
    ({"begins": "-"}, NONE),
    ({"begins": "f"}, END),
    ({"closed": "1", "begins": "o"}, CLOSED),
)
SHOUT_RULES = (
    *_BOTH,
    ({"closed": "1", "gap": "1"}, END),
    ({"closed": "1", "begins": "U"}, END),
    ({"closed": "1"}, NONE),
    ({"begins": "d", "gap": "1", "prev": "lotU", "long": "1"}, END),
    ({"begins": "d"}, NONE),
    ({"begins": "o", "prev": "ot"}, END),
    ({"begins": "o", "gap": "1", "thai": "0", "prev": "sUlxc", "formula": "0"}, END),
    ({"begins": "o"}, NONE),
    ({"gap": "0", "prev": "lotdxc", "word": "1"}, END),
    ({"gap": "0"}, NONE),
    ({"formula": "1", "opener": "1"}, NONE),
    ({}, END),
)
_ALONE = {"run": (".", "…"), "closed": "0"}
PERIOD_RULES = (
    *_BOTH,
    ({"run": (".", ".."), "prev": "s", "begins": "od"}, NONE),
    ({"run": ("..", "……"), "closed": "0", "prev": "s", "begins": "od"}, NONE),
    (_ALONE | {"left": ("abbreviation", "name_goes_on", "claim_number", "initial")}, NONE),
    (_ALONE | {"left": ("unit", "inch"), "begins": "d"}, NONE),
    (_ALONE | {"left": ("may_latin", "inch", "name"), "begins": "o", "gap": "1"}, NONE),
    (_ALONE | {"left": ("name",), "gap": "0"}, NONE),
    (_ALONE | {"begins": "d", "gap": "0"}, NONE),
    (_ALONE | {"begins": "d", "left": ("number", "ordinal"), "thai": "1"}, NONE),
    (_ALONE | {"begins": "d", "long": "1", "prev": "lotd"}, END),
    (_ALONE | {"begins": "d", "prev": "xc"}, END),
    (_ALONE | {"begins": "d"}, NONE),
    (_ALONE | {"left": ("ordinal",)}, NONE),
    (_ALONE | {"begins": "o", "prev": "t"}, NONE),
    (_ALONE | {"begins": "o", "gap": "0", "prev": "o", "long": "1"}, END),
    (_ALONE | {"begins": "o", "gap": "0"}, NONE),
    (_ALONE | {"begins": "U", "gap": "0", "prev": "lotd", "long": "1", "word": "1", "dotted": "0"}, END),
    (_ALONE | {"begins": "U", "gap": "0", "prev": "c", "word": "1", "dotted": "0"}, END),
    (_ALONE | {"begins": "U", "gap": "0"}, NONE),
    ({"run": (".", "…"), "closed": "1", "begins": "d", "gap": "0"}, NONE),
    ({"gap": "0", "begins": "od", "closed": "0"}, NONE),
    ({}, END),
)


def compile_rules(features: dict, rules: tuple) -> tuple[bytes, dict[str, dict[str, int]]]:
    """(table, weights): the outcome of each combination of features at the sum of its values' weights."""
    shape = tuple(len(v) for v in features.values())
    table = np.zeros(shape, np.uint8)
    for conditions, outcome in reversed(rules):
        at = [[i for i, v in enumerate(values) if name not in conditions or v in conditions[name]] for name, values in features.items()]
        table[np.ix_(*at)] = outcome
    strides = np.cumprod((1, *shape[:0:-1]))[::-1].tolist()
    return table.tobytes(), {name: {v: i * s for i, v in enumerate(values)} for (name, values), s in zip(features.items(), strides)}
