"""Bidirectional levels and line-break opportunities of paragraphs.

Levels follow the Unicode bidirectional algorithm (explicit embeddings,
overrides and isolates; weak, bracket-free neutral and implicit rules) over the
classes of the running Python's Unicode data. Breaks follow the main rules of
Unicode line breaking over classes derived from general categories.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache, lru_cache

from pyspark.sql import DataFrame

from docframe.operators.dom import _each

MOST_DEPTH = 125
_ISOLATE = {"LRI", "RLI", "FSI"}
_STRONG = {"L": 0, "R": 1, "AL": 1}
#: A letter for each class: x for formatting characters, X for those that begin right to left.
_LETTERS = {"L": "L", "R": "R", "AL": "a", "EN": "E", "AN": "N", "ES": "s", "ET": "t", "CS": "c", "NSM": "m", "WS": "w", "S": "S", "B": "B", "ON": "o", "RLE": "X", "RLO": "X", "RLI": "X"}


class _Table(dict):
    """A translation table that is filled as characters are met."""

    def __init__(self, of):
        self.of = of

    def __missing__(self, code):
        found = self[code] = self.of(chr(code))
        return found


_CLASSES = _Table(lambda c: _LETTERS.get(unicodedata.bidirectional(c) or "L", "x"))
_FORMATTING, _RIGHT, _FIRST, _SAME = re.compile("[xX]"), re.compile("[RaNX]"), re.compile("[LRa]"), re.compile(rb"(.)\1*", re.DOTALL)
_MARKS, _ARABIC, _BETWEEN, _COMMON = re.compile("(^|[^m])m+"), re.compile("a[^LRa]*"), re.compile("(?<=E)[sc](?=E)"), re.compile("(?<=N)c(?=N)")
_SIGNS, _LATIN, _ENDS = re.compile("t+"), re.compile("L[^LR]*E[^LR]*"), re.compile("^w+|[SB]w*")
_ENCLOSED = re.compile("(?<=[REN])[^LREN]+(?=[REN])"), re.compile("(?<=L)[^LREN]+(?=L)")


def base_level(classes: list[str]) -> int:
    """1 if the first strong character outside isolates goes right to left."""
    depth = 0
    for c in classes:
        if c in _ISOLATE:
            depth += 1
        elif c == "PDI":
            depth = max(0, depth - 1)
        elif not depth and c in _STRONG:
            return _STRONG[c]
    return 0


@cache
def _steps(base: int) -> dict[int, int]:
    """What a letter adds to an even or an odd level; neutrals that nothing encloses keep it."""
    return {ord(c): base + (({"R": 1, "E": 2, "N": 2} if base % 2 == 0 else {"L": 1, "E": 1, "N": 1}).get(c, 0)) for c in _LETTERS.values()}


def _flat(classes: str, base: int) -> bytes:
    """Levels of letters without formatting characters: they are one sequence, and its rules are patterns over it."""
    edge, t = "LR"[base & 1], classes
    if "m" in t:  # W1
        t = _MARKS.sub(lambda m: m[1] * len(m[0]) or edge * len(m[0]), t)
    if "a" in t:  # W2, W3
        t = _ARABIC.sub(lambda m: m[0].replace("E", "N"), t).replace("a", "R")
    if "s" in t or "c" in t:  # W4
        t = _COMMON.sub("N", _BETWEEN.sub("E", t))
    if "t" in t and "E" in t:  # W5
        t = _SIGNS.sub(lambda m, t=t: ("E" if t[m.start() - 1 : m.start()] == "E" or t[m.end() : m.end() + 1] == "E" else "t") * len(m[0]), t)
    t = edge + t
    if "E" in t:  # W7
        t = _LATIN.sub(lambda m: m[0].replace("E", "L"), t)
    t = _ENCLOSED[base & 1].sub(lambda m: "RL"[base & 1] * len(m[0]), t + edge)  # N1, N2; W6 makes no difference here
    out = bytearray(t[1:-1].translate(_steps(base)), "latin-1")  # I1, I2
    if "S" in classes or "B" in classes or classes[-1:] == "w":  # L1
        n = len(out)
        for m in _ENDS.finditer(classes[::-1]):
            out[n - m.end() : n - m.start()] = bytes([base]) * (m.end() - m.start())
    return bytes(out)


def _levels(text: str, base: int | None = None) -> bytes:
    letters = text.translate(_CLASSES)
    if _FORMATTING.search(letters):
        return bytes(_general(text, base))
    if base is None:
        first = _FIRST.search(letters)
        base = int(first is not None and first[0] != "L")
    return _flat(letters, base)


def levels(text: str, base: int | None = None) -> list[int]:
    """The embedding level of each character; formatting characters have that of their surroundings."""
    return list(_levels(text, base))


def _general(text: str, base: int | None = None) -> list[int]:
    classes = [unicodedata.bidirectional(c) or "L" for c in text]
    base = base_level(classes) if base is None else base
    out, types = _explicit(classes, base)
    for run in _sequences(classes, out):
        _resolve(run, types, out, base)
    for i in range(len(text) - 1, -1, -1):  # separators, and white space before them or the end
        if classes[i] in ("B", "S") or classes[i] in ("WS", "BN", *_ISOLATE, "PDI", "LRE", "RLE", "LRO", "RLO", "PDF") and (i + 1 == len(text) or trailing):
            out[i], trailing = base, True
        else:
            trailing = False
    return out


def _explicit(classes, base):
    stack, over_isolate, over_embed, isolates = [(base, None, False)], 0, 0, 0
    out, types = [0] * len(classes), list(classes)
    match, open_ = {}, []
    for i, c in enumerate(classes):
        if c in _ISOLATE:
            open_.append(i)
        elif c == "PDI" and open_:
            match[open_.pop()] = i
    for i, c in enumerate(classes):
        level, override, _ = stack[-1]
        if c in ("RLE", "LRE", "RLO", "LRO", *_ISOLATE):
            isolate = c in _ISOLATE
            if isolate:
                out[i] = level
                if override:
                    types[i] = override
                if c == "FSI":
                    c = "RLI" if base_level(classes[i + 1 : match.get(i, len(classes))]) else "LRI"
            new = level + 1 | 1 if c[0] == "R" else level + 2 & ~1
            if new <= MOST_DEPTH and not over_isolate and not over_embed:
                isolates += isolate
                stack.append((new, {"RLO": "R", "LRO": "L"}.get(c), isolate))
            elif isolate:
                over_isolate += 1
            elif not over_isolate:
                over_embed += 1
            if not isolate:
                out[i], types[i] = level, "BN"
        elif c == "PDI":
            if over_isolate:
                over_isolate -= 1
            elif isolates:
                over_embed = 0
                while not stack[-1][2]:
                    stack.pop()
                stack.pop()
                isolates -= 1
            out[i] = stack[-1][0]
            if stack[-1][1]:
                types[i] = stack[-1][1]
        elif c == "PDF":
            if not over_isolate:
                if over_embed:
                    over_embed -= 1
                elif not stack[-1][2] and len(stack) > 1:
                    stack.pop()
            out[i], types[i] = stack[-1][0], "BN"
        elif c == "B":
            out[i] = base
        else:
            out[i] = level
            if override and c != "BN":
                types[i] = override
    return out, types


def _sequences(classes, out):
    """Isolating run sequences: runs of one level, joined over their isolates."""
    runs, now = [], []
    for i in range(len(classes)):
        if classes[i] in ("LRE", "RLE", "LRO", "RLO", "PDF", "BN"):
            continue
        if now and out[now[-1]] != out[i]:
            runs.append(now)
            now = []
        now.append(i)
    if now:
        runs.append(now)
    waiting, done = [], []
    for r in runs:
        if classes[r[0]] == "PDI" and waiting and waiting[-1][1] == out[r[0]]:
            seq, _ = waiting.pop()
            seq.extend(r)
        else:
            seq = list(r)
            done.append(seq)
        if classes[r[-1]] in _ISOLATE:
            waiting.append((seq, out[r[-1]]))
    return done


def _resolve(seq, types, out, base):
    level = out[seq[0]]
    before = max([level, *(out[i] for i in range(seq[0] - 1, max(-1, seq[0] - 2), -1))]) if seq[0] else max(level, base)
    after = max(level, out[seq[-1] + 1]) if seq[-1] + 1 < len(out) else max(level, base)
    sos, eos = "LR"[before & 1], "LR"[after & 1]
    t = [types[i] for i in seq]
    prev, strong = sos, sos
    for k, c in enumerate(t):  # W1 to W3
        if c == "NSM":
            t[k] = "ON" if prev in (*_ISOLATE, "PDI") else prev
        elif c == "EN" and strong == "AL":
            t[k] = "AN"
        if t[k] in ("L", "R", "AL"):
            strong = t[k]
        prev = t[k]
    t = ["R" if c == "AL" else c for c in t]
    for k in range(1, len(t) - 1):  # W4
        if t[k] == "ES" and t[k - 1] == t[k + 1] == "EN" or t[k] == "CS" and t[k - 1] == t[k + 1] and t[k - 1] in ("EN", "AN"):
            t[k] = t[k - 1]
    k = 0
    while k < len(t):  # W5
        if t[k] == "ET":
            e = k
            while e < len(t) and t[e] == "ET":
                e += 1
            if k and t[k - 1] == "EN" or e < len(t) and t[e] == "EN":
                t[k:e] = ["EN"] * (e - k)
            k = e
        else:
            k += 1
    strong = sos
    for k, c in enumerate(t):  # W6, W7
        if c in ("ES", "ET", "CS"):
            t[k] = "ON"
        elif c == "EN" and strong == "L":
            t[k] = "L"
        if t[k] in "LR":
            strong = t[k]
    k, as_strong = 0, {"L": "L", "R": "R", "EN": "R", "AN": "R"}
    while k < len(t):  # N1, N2
        if t[k] not in as_strong:
            e = k
            while e < len(t) and t[e] not in as_strong:
                e += 1
            left, right = as_strong[t[k - 1]] if k else sos, as_strong[t[e]] if e < len(t) else eos
            t[k:e] = [left if left == right else "LR"[level & 1]] * (e - k)
            k = e
        else:
            k += 1
    for i, c in zip(seq, t, strict=True):  # I1, I2
        out[i] += {"L": 0, "R": 1, "AN": 2, "EN": 2}[c] if level % 2 == 0 else int(c != "R")


@cache
def _from(level: int) -> re.Pattern:
    return re.compile(b"[\\x%02x-\\x7f]+" % level)


def visual(text: str) -> str:
    """The characters in the order of display."""
    lv = _levels(text)
    for at in range(max(lv, default=0), 0, -1):
        chars, held, last = [], [], 0
        for m in _from(at).finditer(lv):
            i, j = m.span()
            chars += text[last:i], text[i:j][::-1]
            held += lv[last:i], lv[i:j][::-1]
            last = j
        text, lv = "".join(chars) + text[last:], b"".join(held) + lv[last:]
    return text


# -- line breaks ------------------------------------------------------------------------------


def _line_class(c: str) -> str:
    if c in "\n\x0b\x0c\x85  \r":
        return {"\n": "LF", "\r": "CR"}.get(c, "BK")
    if c in " ":
        return "SP"
    if c == "​":
        return "ZW"
    if c in "  ⁠﻿":
        return "GL"
    if c in "-":
        return "HY"
    if c in "!?":
        return "EX"
    if c in ",.:;":
        return "IS"
    if c == "/":
        return "SY"
    if c in "\t‐‒–­":
        return "BA"
    if c in "\"'":
        return "QU"
    kind = unicodedata.category(c)
    if kind in ("Mn", "Mc", "Me") or c == "‍":
        return "CM"
    if kind in ("Ps",):
        return "OP"
    if kind in ("Pe",):
        return "CL"
    if kind in ("Pi", "Pf"):
        return "QU"
    if kind == "Nd":
        return "NU"
    if kind == "Sc":
        return "PR"
    if c in "%‰°":
        return "PO"
    if unicodedata.east_asian_width(c) in "WF":
        return "NS" if c in "、。々ーぁぃぅぇぉっゃゅょ" else "ID"
    return "AL"


def _breaks(text: str) -> list[tuple[int, bool]]:
    return _walk([_NAMES[c] for c in text.translate(_LINE)], None, True)


def _walk(classes: list[str], last: str | None, end: bool) -> list[tuple[int, bool]]:
    """The rules over classes that follow a letter (AL), or begin a text (None); end: the text ends with them."""
    out, space = [], False
    for i, now in enumerate(classes):
        if last is None:
            last, space = "AL" if now == "CM" else now, now == "SP"
            continue
        if last in ("BK", "LF") or last == "CR" and now != "LF":
            out.append((i, True))
            last, space = now, now == "SP"
            continue
        if now in ("BK", "CR", "LF", "SP", "ZW") or last == "CR":
            space = space or now == "SP"
            if now != "SP":
                last, space = now, False
            continue
        if now == "CM" and not space and last != "ZW":
            continue
        may = last == "ZW" or space or last in ("BA", "HY") and not (last == "HY" and now == "NU") or now == "ID" or last in ("ID", "NS", "SY", "EX")
        if now in ("CL", "EX", "IS", "SY", "GL", "NS", "BA", "HY") and not (space and now in ("GL", "HY", "BA", "NS", "IS")):
            may = last == "ZW"
        if last in ("OP", "GL", "PR", "QU") and not (space and last in ("PR", "QU", "GL")) or now == "QU" and not space or now == "PO" and not space:
            may = False
        if last in ("SY", "IS", "EX") and not space and now in ("NU", "AL") and last != "EX":
            may = last == "SY" and now == "AL"
        if may:
            out.append((i, False))
        last, space = "AL" if now == "CM" else now, False
    if end and classes:
        out.append((len(classes), True))
    return out


#: A letter for each line class.
_NAMES = dict(zip("FRKSZGHXIYBQCOLNPTWDA", "LF CR BK SP ZW GL HY EX IS SY BA QU CM OP CL NU PR PO NS ID AL".split(), strict=True))
_LINE = _Table(lambda c: next(k for k, v in _NAMES.items() if v == _line_class(c)))
_GAP = re.compile("[^A]+")


@lru_cache(maxsize=4096)
def _after_letter(gap: str) -> tuple[tuple[int, bool], ...]:
    """Breaks in what stands between two letters, up to the second: nothing before the first matters to them."""
    return tuple(_walk([_NAMES[c] for c in gap] + ["AL"], "AL", False))


def line_breaks(text: str) -> list[tuple[int, bool]]:
    """(offset, must) of the places where a line may or must end; the end of the text is one."""
    classes, out = text.translate(_LINE), []
    for m in _GAP.finditer(classes):
        i, gap = m.start(), m[0]
        if i and m.end() < len(classes):
            found = _after_letter(gap) if len(gap) <= 16 else _walk([_NAMES[c] for c in gap] + ["AL"], "AL", False)
        else:
            found = _walk([_NAMES[c] for c in gap] + ["AL"] * (m.end() < len(classes)), "AL" if i else None, False)
        out += [(i + k, must) for k, must in found]
    if text:
        out.append((len(text), True))
    return out


def levels_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of one level of each line: (id, line, start, end, level)."""

    def rows(text):
        for k, line in enumerate(text.split("\n")):
            if not _RIGHT.search(line.translate(_CLASSES)):
                if line:
                    yield k, 0, len(line), 0
                continue
            for m in _SAME.finditer(_levels(line)):
                yield k, m.start(), m.end(), m[1][0]

    return _each(df, id_col, text_col, "line int, start int, end int, level int", rows)


def breaks_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, offset, must) of every place where a line may end."""
    return _each(df, id_col, text_col, "offset int, must boolean", line_breaks)


def break_counts_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, must, may): how many of breaks_of there are in a row's text, counted where they are found."""

    def rows(text):
        found = line_breaks(text)
        must = sum(m for _, m in found)
        return [(must, len(found) - must)]

    return _each(df, id_col, text_col, "must bigint, may bigint", rows)


def visual_of(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, text): each line's characters in the order of display."""
    return _each(df, id_col, text_col, "line int, text string", lambda t: [(k, visual(line)) for k, line in enumerate(t.split("\n"))])
