"""Placed characters to lines and blocks.

Against the previous kept character a new one is dropped (the same character
struck twice), breaks the line, is joined by a space, or is joined. A line
joins the block before it if it goes the same way, follows closely and
overlaps it. Distances are in units of the character's size.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import cached_property

#: How far characters may stray and still be of a line, or a word, or one stroke.
LINE_GAP, WORD_GAP, SAME_WAY, STRUCK_TWICE, LINE_STEP = 0.8, 0.15, 0.999, 0.5, 1.6


@dataclass(slots=True)
class Char:
    c: str
    x: float
    y: float
    dx: float  # direction of writing
    dy: float
    size: float
    advance: float

    def end(self):
        return self.x + self.dx * self.advance, self.y + self.dy * self.advance

    @property
    def last(self) -> Char:
        return self


@dataclass(slots=True)
class Run:
    """Characters of one string that follow each other without a gap, each with an advance above 0."""

    c: str
    x: float
    y: float
    dx: float
    dy: float
    size: float
    advances: list[float]
    moved: float  # from the first character's origin to the last one's

    def __iter__(self):
        moved = 0.0
        for c, a in zip(self.c, self.advances, strict=True):
            yield Char(c, self.x + self.dx * moved, self.y + self.dy * moved, self.dx, self.dy, self.size, a)
            moved += a

    @property
    def advance(self) -> float:
        return self.advances[0]

    @property
    def last(self) -> Char:
        return Char(self.c[-1], self.x + self.dx * self.moved, self.y + self.dy * self.moved, self.dx, self.dy, self.size, self.advances[-1])

    def end(self):
        moved = self.moved + self.advances[-1]
        return self.x + self.dx * moved, self.y + self.dy * moved


@dataclass
class Line:
    chars: list[Char | Run] = field(default_factory=list)

    @cached_property
    def text(self) -> str:
        return "".join([c.c for c in self.chars])

    @cached_property
    def size(self) -> float:
        return max(c.size for c in self.chars)

    @cached_property
    def box(self) -> tuple[float, float, float, float]:
        xs, ys = [], []
        for c in self.chars:
            for x, y in ((c.x, c.y), c.end()):
                xs += [x, x - c.dy * c.size * 0.8, x + c.dy * c.size * 0.2]
                ys += [y, y + c.dx * c.size * 0.8, y - c.dx * c.size * 0.2]
        return min(xs), min(ys), max(xs), max(ys)


def lines(chars) -> list[Line]:
    """Lines of placed characters and runs. Within a run nothing is struck twice and nothing breaks, so its ends are all that is compared."""
    out, now, real = [], [], None  # real: the last character that was drawn, not the space put in for a gap

    def flush():
        nonlocal now
        line = Line(now)
        if line.text.strip():
            out.append(line)
        now = []

    queue = iter(chars)
    while (c := next(queue, None)) is not None:
        if now:
            dx, dy, size = c.dx, c.dy, c.size
            if dx * real.dx + dy * real.dy < SAME_WAY:
                flush()
            else:
                if c.c[:1] == real.c:
                    near = STRUCK_TWICE * min(c.advance, real.advance)
                    if abs(c.x - real.x) <= near and abs(c.y - real.y) <= near:
                        if isinstance(c, Run):
                            queue = itertools.chain([*c][1:], queue)
                        continue
                ex, ey = c.x - real.x - real.dx * real.advance, c.y - real.y - real.dy * real.advance
                along, across = ex * dx + ey * dy, ey * dx - ex * dy
                if abs(across) > LINE_GAP * size or abs(along) > LINE_GAP * size:
                    flush()
                elif along > WORD_GAP * size and c.c[:1] != " " and real.c != " ":
                    now.append(Char(" ", *real.end(), dx, dy, size, 0.0))
        now.append(c)
        real = c.last
    flush()
    return out


def blocks(found: list[Line]) -> list[list[Line]]:
    out: list[list[Line]] = []
    for line in found:
        if out and _follows(out[-1][-1], line):
            out[-1].append(line)
        else:
            out.append([line])
    return out


def _follows(a: Line, b: Line) -> bool:
    p, q = a.chars[0], b.chars[0]
    if p.dx * q.dx + p.dy * q.dy < SAME_WAY:
        return False
    step = (q.x - p.x) * p.dy - (q.y - p.y) * p.dx  # down the page
    if not 0 < step <= LINE_STEP * max(a.size, b.size):
        return False
    s, t = a.box, b.box
    k = 0 if abs(p.dx) >= abs(p.dy) else 1
    return s[k] < t[k + 2] and t[k] < s[k + 2]


def text(chars) -> str:
    """A line end after each line, an empty line between blocks."""
    return "\n\n".join("\n".join(line.text for line in b) for b in blocks(lines(chars)))


def placed(c: str, m: tuple[float, ...], advance: float) -> Char | None:
    """A character under the matrix (a, b, c, d, e, f), its advance in text units."""
    a, b, cc, d, e, f = m
    size, n = math.sqrt(abs(a * d - b * cc)), math.hypot(a, b)
    if not size or not n:
        return None
    return Char(" " if c.isspace() else c, e, f, a / n, b / n, size, (advance if advance > 0 else 0.5) * n)
