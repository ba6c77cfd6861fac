"""From text to events: the places where a sentence may end, begin or be protected, each classified by its nearest neighbours.

An event is (position, kind, argument); what it means depends on what came before, which is the transducer's business
(boundary_machine). Whether a mark can end a sentence is read off the compiled table of boundary_rules, by the classes of what stands before
and behind it. The classes look back at most CONTEXT characters from the mark's token, and ahead over closing marks and blanks, however many,
to the next word; so a text can be cut between any two letters, and each part be read alone given CONTEXT characters of its neighbours.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from peptrail.llm.boundary_rules import CLOSED, FULL, FULL_RULES, GO_ON_WORDS, MAY_END_WORDS, NONE, ORDINAL_WORDS, PARTS, PERIOD, PERIOD_RULES, SHOUT, SHOUT_RULES, compile_rules

CONTEXT = 256

# Kinds of events.
PARA, OPEN, CLOSE, QUOTE, CLAIM, STRONG, AFTER_CLOSER, THAI_GAP = range(8)

# Brackets and quotes by family; within a family an opener pairs with a closer.
FAMILIES = ("(（﹙", "[［【〔", "{｛", "«‹", "「『", "“„‟", "《〈")
FAMILY_CLOSERS = (")）﹚", "]］】〕", "}｝", "»›", "」』", "”“", "》〉")
_MARKS = {c: (CLOSE, k) for k, s in enumerate(FAMILY_CLOSERS) for c in s} | {c: (OPEN, k) for k, s in enumerate(FAMILIES) for c in s} | {'"': (QUOTE, 0)}
TERMINATORS = ".!?。！？｡．…؟۔।॥"
#: Terminators of scripts without capital letters; they need no blank after them.
FULL_STOPS = "。！？｡．؟۔।॥"

# Signs behind which a single letter is part of a formula, not an initial.
_OPERATORS = "+-=/*·×→←<>≤≥|^_\\"

# Where an event may be: a line's end, a terminator, a bracket or quote; but no period within a number or an abbreviation, before a lower-case
# word of the same script, and no mark at a paragraph's end: no event would come of those.
_HIT = re.compile(
    "[\n" + re.escape(TERMINATORS) + "".join(map(re.escape, _MARKS)) + "]"
    r"(?<!\.(?=\d|[a-z]+[^A-Za-z]))(?<![A-Za-z]\.(?= [a-z]+[ ,;\n]))(?<![.!?。！？](?=\r?\n[^\S\n]*\n|\Z))"
)
_RUN = re.compile("[" + re.escape(TERMINATORS) + "]+")
_PARA = re.compile(r"\n(?:[^\S\n]*\n)+")
_CLAIM = re.compile(r"\s*(?:\d{1,4}(?=[.)．）]\s)|[\[(]\d{1,4}[\])](?=\s)|【[^【】\n]{0,12}\d{1,4}[^【】\n]{0,4}】|\[[^\[\]\n]{0,10}\d{1,4}\](?=\s))")
_THAI_SCRIPT = re.compile("[฀-๎]")
_THAI_GAP = re.compile(r"(?<=[฀-๎])[^\S\n\r]+(?=[฀-๎])")
_CLOSERS = re.compile(r"(?:[)\]}”’'」』）】》〉］｝]|(?:[  ]?[»›])|\"(?=[\s)\]}»”.,;:!?]|\Z)|“(?=[\s.,;:)]|\Z))*")
_CLAIM_NEXT = re.compile(r"\s+((?:\[|\()?\d{1,4}[.)\]．）]\s+|【[^【】\n]{0,12}\d{1,4}[^【】\n]{0,4}】)(?=\S)")
_FULL, _FW = compile_rules(FULL, FULL_RULES)
_SHOUT, _SW = compile_rules(SHOUT, SHOUT_RULES)
_PERIOD, _PW = compile_rules(PERIOD, PERIOD_RULES)
_KIND = {CLOSED: AFTER_CLOSER}
_BLANK_LINE = re.compile(r"\n[^\S\n]*\n")
_OPENERS = "\"“„«‹「『(（[［【{｛《〈¿¡'‘"
#: An elided article ("d'env."), and a run of ideographs, kana or Hangul that Latin letters follow.
_ELIDED = re.compile(r"\A[^\W\d_]{1,2}['’]")
#: A sentence's last word and its period, where the blank behind it was lost.
_LOST_BLANK = re.compile(r".*[^\W\d_]{3,}\.(?=[^\W\d_])")
_WIDE = re.compile(r"\A.*[　-鿿가-힯＀-￯](?=[A-Za-z])")
_BREAKS = frozenset(" \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000([{（【「『«“„\"")


@lru_cache(maxsize=4096)
def _class(c: str) -> str:
    """U upper or title case, l lower case, o letter without case, d digit, s blank, x other."""
    if c.isspace():
        return "s"
    kind = unicodedata.category(c)
    if kind in ("Lu", "Lt"):
        return "U"
    if kind == "Ll":
        return "l"
    if kind[0] in "LM":
        return "o"
    return "d" if kind == "Nd" else "x"


def _script(c: str) -> str:
    o = ord(c)
    return "latin" if o < 0x250 else "greek" if o < 0x400 else "cyrillic" if o < 0x530 else "thai" if 0xE00 <= o < 0xE80 else "other"


def _begins(text: str, m: int) -> str:
    """The right class from m: U like the begin of a sentence, o caseless, d a number, l a lower-case word, - none of these."""
    n = len(text)
    k = m
    while k < n and text[k] in _OPENERS and k - m < 4:
        k += 1
    if k >= n:
        return "-"
    c = text[k]
    kind = _class(c)
    if kind in "Uod":
        return kind
    if kind == "l":
        word = re.match(r"[^\W\d_]+", text[k : k + 24])
        w = word.group(0) if word else c
        if any(x.isupper() for x in w[1:]) or (_script(c) == "greek" and text[k + 1 : k + 2] in ("-", "‑")):
            return "U"
        return "l" if k == m else "-"
    return "-"


def _prev_class(c: str) -> str:
    kind = _class(c)
    if kind == "o":
        return "t" if _script(c) == "thai" else "o"
    return "c" if c in "%°'’)]}" else kind


def _terminator(text: str, i: int, j: int) -> tuple[int, int] | None:
    """The event of the terminators text[i:j], if any: its position (after closing marks) and kind."""
    n = len(text)
    prev = text[i - 1] if i else "\n"
    after = text[j] if j < n else "\n"
    run = text[i:j]
    if prev == "[" and after == "]":
        return None
    if run[-1] == "…" and run[0] == "…" and not after.isspace():
        return None
    if len(run) > 1 and "…" in run and run[0] != "…":
        return (i + run.index("…"), STRONG)
    # most often a blank and a word follow
    k = j if after == " " and text[j + 1 : j + 2] not in ("»", "›") else _CLOSERS.match(text, j).end()
    m = k
    while m < n and text[m].isspace():
        m += 1
    if m >= n or (m > k and _BLANK_LINE.search(text, k, m)):
        return None
    closed, gap = "1" if k > j else "0", "1" if m > k else "0"
    ends = run[-1]
    if ends in FULL_STOPS:
        nxt = text[m]
        what = "," if nxt in ",;:，；：、" else "." if nxt in ".。" else "letter" if _class(nxt) in "ol" else "other"
        found = _FULL[_FW["closed"][closed] + _FW["gap"][gap] + _FW["next"][what]]
        return None if found == NONE else (k, _KIND.get(found, STRONG))
    begins = _begins(text, m)
    if begins == "l":
        if gap == "0" or closed == "1" or len(run) > 1 or not _foreign(text, i, m):
            return None
        return (k, STRONG)
    if begins == "-":
        return None
    before = _prev_class(prev)
    thai = "1" if _script(text[m]) == "thai" else "0"
    word = "1" if gap == "1" or _word_begins(text, m) else "0"
    if ends in "!?":
        formula = "1" if _formula(text, i) else "0"
        w = _SW
        found = _SHOUT[w["closed"][closed] + w["gap"][gap] + w["begins"][begins] + w["prev"][before] + w["long"]["1" if len(_token(text, i)) > 1 else "0"] + w["formula"][formula] + w["word"][word] + w["opener"]["1" if text[m] in _OPENERS else "0"] + w["thai"][thai]]
    else:
        token = _token(text, i)
        if "." in token and (lost := _LOST_BLANK.match(token)):
            token = token[lost.end() :]
        alone = len(run) == 1 and closed == "0"
        left = _left(text, i, token) if alone else "plain"
        w = _PW
        found = _PERIOD[w["run"][("…" if ends == "…" else ".") * min(2, len(run))] + w["closed"][closed] + w["gap"][gap] + w["begins"][begins] + w["left"][left] + w["prev"][before] + w["long"]["1" if len(token) > 1 else "0"] + w["dotted"]["1" if "." in token[-3:] else "0"] + w["word"][word] + w["thai"][thai]]
    return None if found == NONE else (k, _KIND.get(found, STRONG))


def _plain_form(token: str) -> str:
    """A token in lower case; letters that text recognition took for digits are put right, an elided article is dropped."""
    low = token.lower()
    if low[:1].isalpha() and not low.isalpha() and low.isalnum():
        low = low.replace("1", "l").replace("0", "o")
    if "'" in low or "’" in low or "‘" in low:
        low = _ELIDED.sub("", low).strip("'‘’")
    return low


def _left(text: str, i: int, token: str) -> str:
    """The left class of a single period at i."""
    bare = _plain_form(token).rstrip(".")
    if bare in GO_ON_WORDS and bare not in PARTS:
        return "unit" if _measured(text, i, token, bare) else "abbreviation"
    if bare == "al" and text[i + 1 : i + 4].strip()[:1] == "(":
        return "abbreviation"
    if bare in PARTS or bare in MAY_END_WORDS:
        following = text[i + 1 : i + 14].strip()
        if bare in PARTS:
            return "name_goes_on" if following.startswith(("[?]", *PARTS[bare])) else "name"
        return "inch" if bare == "in" else "may_latin" if _script(token[0]) == "latin" else "may"
    if token.isdigit() and _paragraph_begins(text, i - len(token)):
        return "claim_number"
    if 0 < len(token) <= 2 and sum(c.isalpha() for c in token) == 1 and _class(token[0]) in "Ul":
        if _measured(text, i, token, bare):
            return "unit"
        before = _before(text, i, token)
        if not (before and before[-1] in _OPERATORS):
            return "initial"
    if "." in token and not token.isascii() and _script(token[0]) == "thai" and re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", token):
        return "initial"
    if token and _class(token[-1]) == "d" and not re.search(r"[^\d.,]", token):
        return "ordinal" if token.isdigit() and len(token) <= 2 and _before(text, i, token).lower() in ORDINAL_WORDS else "number"
    return "plain"


def _foreign(text: str, i: int, m: int) -> bool:
    """Whether the lower-case word at m is of another script than the plain word before the mark at i: it may open a sentence."""
    token = _token(text, i)
    if "." in token and (lost := _LOST_BLANK.match(token)):
        token = token[lost.end() :]
    low = _plain_form(token)
    letters = [x for x in token if _class(x) in "Ulo"]
    if len(letters) < 2 or _class(text[i - 1]) not in "lo" or low in GO_ON_WORDS or low in MAY_END_WORDS or "." in low:
        return False
    return _script(letters[-1]) != _script(text[m]) and _script(text[m]) in ("latin", "cyrillic")


def _token_start(text: str, i: int, low: int) -> int:
    """Where the unbroken characters before i begin, ``low`` at the earliest."""
    while i > low and text[i - 1] not in _BREAKS:
        i -= 1
    return i


def _token(text: str, i: int) -> str:
    """The unbroken characters before i, from where the script without blanks between words ends."""
    token = text[_token_start(text, i, max(0, i - 40)) : i]
    return token if token.isascii() else _WIDE.sub("", token)


def _before(text: str, i: int, token: str) -> str:
    """The token before the token that ends at i; none across an empty line."""
    k = low = i - len(token)
    bottom = max(0, low - 48)
    lines = 0
    while k > bottom and text[k - 1].isspace():
        k -= 1
        lines += text[k] == "\n"
    return "" if lines > 1 else text[_token_start(text, k, bottom) : k]


def _word_begins(text: str, m: int) -> bool:
    """A capitalised word, not a symbol of a formula."""
    k = m
    while k < len(text) and text[k] in _OPENERS:
        k += 1
    two = text[k : k + 2]
    return len(two) == 2 and (_class(two[1]) in "lo" or (two[1].isspace() and two[0] in "AIOYEАВИКОСУЯ") or (_class(two[0]) == "l"))


def _formula(text: str, i: int) -> bool:
    """The mark at i stands behind a symbol or number, as a factorial does."""
    token = _token(text, i)
    return len(token) <= 1 or not any(_class(c) in "lo" for c in token) or bool(re.search(r"[\d²³=|)]\Z", token) and not re.search(r"[^\W\d_]{3}", token)) and bool(re.search(r"[|=²³)]", token))


def _paragraph_begins(text: str, at: int) -> bool:
    """Whether only blanks stand between ``at`` and the text's begin or an empty line."""
    lines = 0
    while at > 0 and text[at - 1].isspace():
        at -= 1
        lines += text[at] == "\n"
    return at == 0 or lines > 1


def _measured(text: str, i: int, token: str, bare: str) -> bool:
    """A short lower-case token behind a number is a unit of measure, which a sentence can end with."""
    if len(bare) > 4 or bare != token:
        return False
    before = _before(text, i, token)
    return bool(before) and before[-1].isdigit()


def gaps(text: str, start: int, stop: int, found: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(first, end) of what isn't blank between one event and the next, before the first and after the last; (-1, -1) if nothing is."""
    out, last = [], start
    for at, kind, _ in [*found, (stop, PARA, 0)]:
        s = text[last:at]
        bare = s.lstrip()
        if bare:
            begin = last + len(s) - len(bare)
            out.append((begin, begin + len(bare.rstrip())))
        else:
            out.append((-1, -1))
        last = max(last, at + (kind in (OPEN, CLOSE, QUOTE)))
    return out


def events(text: str, start: int = 0, stop: int | None = None) -> list[tuple[int, int, int]]:
    """(position, kind, argument) of the events whose mark lies in text[start:stop], in order.

    argument: the family of OPEN and CLOSE, else 0.
    """
    stop = len(text) if stop is None else stop
    start = max(0, start)
    out: list[tuple[int, int, int]] = []
    late: list[tuple[int, int, int]] = []  # events that take place behind marks still to come
    passed = 0
    if start == 0 and _CLAIM.match(text):
        out.append((_visible(text, 0), CLAIM, 0))
    for f in _HIT.finditer(text, start):
        at = f.start()
        if at >= stop:
            break
        if at < passed:
            continue
        while late and late[0][0] <= at:
            out.append(late.pop(0))
        c = text[at]
        if c == "\n":
            if para := _PARA.match(text, at):
                out.append((at, PARA, 0))
                passed = para.end()
                if _CLAIM.match(text, passed):
                    late.append((_visible(text, passed), CLAIM, 0))
        elif c in _MARKS:
            if c == "“" and at and not text[at - 1].isspace() and (at + 1 >= len(text) or not text[at + 1].isalnum()):
                out.append((at, CLOSE, _MARKS["”"][1]))
            else:
                out.append((at, *_MARKS[c]))
        else:
            passed = _RUN.match(text, at).end()
            e = _terminator(text, at, passed)
            if e:
                late.append((e[0], e[1], 0))
                if not text[e[0] : e[0] + 2].strip().isalpha():
                    claim = _CLAIM_NEXT.match(text, e[0])
                    if claim and not _BLANK_LINE.search(text, passed, claim.start(1)):
                        late.append((claim.start(1), CLAIM, 0))
    out += late
    if _THAI_SCRIPT.search(text):
        thai = [(g.start(), THAI_GAP, 0) for g in _THAI_GAP.finditer(text, start) if g.start() < stop]
        out = sorted(out + thai, key=lambda e: e[0])
    return out


def _visible(text: str, at: int) -> int:
    """The first character from ``at`` on that isn't blank."""
    while at < len(text) and text[at].isspace():
        at += 1
    return at
