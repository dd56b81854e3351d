"""The page-range language: `1-3,7`, `5-2`, `z` (last), `r2` (second from the end),
`1-z:even`, `x4` (leave out).

`:odd` and `:even` go by position within their own range, ranges may run backwards,
pages outside the document fall away, repeated pages stay. What a range means depends
on a document's number of pages, so it becomes an array expression over that column.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Place(NamedTuple):
    """A page counted from the start, or from the end."""

    n: int
    from_end: bool

    def at(self, total: int) -> int:
        return total - self.n + 1 if self.from_end else self.n

    def column(self, total: Column) -> Column:
        return (total - F.lit(self.n - 1) if self.from_end else F.lit(self.n)).cast("int")


class Part(NamedTuple):
    first: Place
    last: Place
    step: str  # '', 'odd' or 'even'
    leave_out: bool


def _number(text: str) -> int:
    t = text.strip()
    return int(t) if t.lstrip("+-").isdigit() else 0


def _place(text: str) -> Place:
    t = text.strip()
    if t == "z":
        return Place(1, True)
    if t.startswith("r") and t[1:].strip().lstrip("+-").isdigit():
        return Place(_number(t[1:]), True)
    return Place(_number(t), False)


def parse(spec: str | None) -> list[Part]:
    out = []
    for piece in (spec or "").split(","):
        p = piece.strip()
        if not p:
            continue
        leave_out = p.startswith("x")
        p, _, step = (p[1:] if leave_out else p).partition(":")
        step = step.split(":")[0].lower()
        ends = p.split("-")
        if len(ends) > 2:
            continue
        first = _place(ends[0])
        out.append(Part(first, _place(ends[1]) if len(ends) == 2 else first, step if step in ("odd", "even") else "", leave_out))
    return out


def _pages(part: Part, total: Column) -> Column:
    every = F.filter(F.sequence(part.first.column(total), part.last.column(total)), lambda x: (x >= 1) & (x <= total))
    if not part.step:
        return every
    return F.filter(every, lambda x, i: i % 2 == (0 if part.step == "odd" else 1))


def pages(spec: str, total: Column) -> Column:
    """The chosen pages of a document with `total` pages, in order, as an array of int."""
    parts = parse(spec)
    keep = [_pages(p, total) for p in parts if not p.leave_out]
    drop = [_pages(p, total) for p in parts if p.leave_out]
    chosen = F.concat(*keep) if keep else F.array().cast("array<int>")
    for d in drop:
        chosen = _less(chosen, d)
    return F.when(total.isNotNull(), chosen)


def _less(chosen: Column, drop: Column) -> Column:
    return F.filter(chosen, lambda x: ~F.array_contains(drop, x))


def model(spec: str | None, total: int) -> list[int]:
    """The same list in plain Python, for tests."""
    out: list[int] = []
    gone: set[int] = set()
    for p in parse(spec):
        a, b = p.first.at(total), p.last.at(total)
        got = [x for x in (range(a, b + 1) if a <= b else range(a, b - 1, -1)) if 1 <= x <= total]
        if p.step:
            got = got[0 if p.step == "odd" else 1 :: 2]
        if p.leave_out:
            gone |= set(got)
        else:
            out += got
    return [x for x in out if x not in gone]
