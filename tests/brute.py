"""Plain, single-process versions of operators, written against TESTDATA.md alone; the tests compare the operators with them."""

from __future__ import annotations

BLANK = " \t\r\n\f\v ﻿"


def unescape(s: str) -> str:
    """Without the backslashes that protect a character; blanks around the value never count, protected or not."""
    out, i = [], 0
    while i < len(s):
        i += s[i] == "\\" and i + 1 < len(s)
        out.append(s[i])
        i += 1
    return "".join(out)


def closes_early(inner: str, a: str, b: str) -> bool:
    """Whether the bracket before ``inner`` is closed within it; brackets in quotes and escaped ones aside."""
    depth, i = 0, 0
    while i < len(inner):
        c = inner[i]
        if c in "\"'":
            j = i + 1
            while j < len(inner) and (inner[j] != c or inner[j + 1 : j + 2] == c):
                j += 2 if inner[j] == "\\" or inner[j] == c else 1
            i = j if j < len(inner) else i
        elif c == "\\":
            i += 1
        elif c == a:
            depth += 1
        elif c == b:
            depth -= 1
            if depth < 0:
                return True
        i += 1
    return False


def split_packed(field: str | None) -> list[str]:
    """Character by character: values of a packed field."""
    if field is None or not (t := field.strip(BLANK)):
        return []
    pairs = {("[", "]"), ("{", "}"), ("(", ")"), ("<", ">")}
    if len(t) > 1 and (t[0], t[-1]) in pairs and not closes_early(t[1:-1], t[0], t[-1]):
        t = t[1:-1]
    n = len(t)

    def delimiter(i: int) -> bool:
        if t[i] in "\t:;,":
            return True
        return t[i] == "|" and (i == 0 or t[i - 1].isspace()) and (i + 1 == n or t[i + 1].isspace())

    out, i = [], 0
    while i <= n:
        while i < n and t[i].isspace() and not delimiter(i):
            i += 1
        value, j = None, i
        if i < n and t[i] in "\"'":
            q, j, got = t[i], i + 1, []
            while j < n:
                if t[j] == "\\" and j + 1 < n:
                    got.append(t[j + 1])
                    j += 2
                elif t[j] == q and t[j + 1 : j + 2] == q:
                    got.append(q)
                    j += 2
                elif t[j] == q:
                    break
                else:
                    got.append(t[j])
                    j += 1
            k = j + 1
            while k < n and t[k].isspace() and not delimiter(k):
                k += 1
            if j < n and (k >= n or delimiter(k)):
                value, j = "".join(got), k
        if value is None:
            j, got = i, []
            while j < n and not delimiter(j):
                if t[j] == "\\" and j + 1 < n:
                    got.append(t[j])
                    j += 1
                got.append(t[j])
                j += 1
            raw = "".join(got).strip(BLANK)
            if len(raw) > 1 and (raw[0], raw[-1]) in pairs and raw[0] not in raw[1:-1] and raw[-1] not in raw[1:-1]:
                raw = raw[1:-1].strip(BLANK)
            value = unescape(raw)
        if value := value.strip(BLANK):
            out.append(value)
        i = j + 1
    return out


def protein_groups(peptides: dict[str, set[str]]) -> dict[str, list[str]]:
    """Founder -> members of its group, itself first, one protein after the other: by falling number of peptides, then by name; one whose
    peptides all lie in a group joins each such group, else it founds one."""
    groups: dict[str, list[str]] = {}
    for p in sorted(peptides, key=lambda p: (-len(peptides[p]), p)):
        above = [f for f in groups if peptides[p] <= peptides[f]]
        for f in above:
            groups[f].append(p)
        if not above:
            groups[p] = [p]
    return groups


PIN_BLANKS = " \t\r\n\f\v\u00a0 \u3000"


def split_line(line: str, sep: str) -> list[str] | None:
    """Character by character: the fields of a line, None if the quoting is broken."""
    out, i, n = [], 0, len(line)
    while True:
        while i < n and line[i] in PIN_BLANKS and line[i] != sep:
            i += 1
        got, quoted = "", i < n and line[i] == '"'
        i += quoted
        while quoted:
            if i >= n:
                return None
            if line[i : i + 2] == '""':
                got, i = got + '"', i + 2
            elif line[i] == '"':
                i, quoted = i + 1, False
                while i < n and line[i] in PIN_BLANKS and line[i] != sep:
                    i += 1
                if i < n and line[i] != sep:
                    return None
            else:
                got, i = got + line[i], i + 1
        while i < n and line[i] != sep:
            got, i = got + line[i], i + 1
        out.append(got.strip(PIN_BLANKS))
        if i >= n:
            return out
        i += 1
