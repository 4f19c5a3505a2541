"""Regular expressions with ASCII word boundaries, and the extractor that turns matches into spans."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A boundary between an ASCII word character and anything else; Java's own ``\\b`` also counts accented letters as words.
ASCII_EDGE = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"
#: Numbers summed together in ``running_sql``.
BLOCK = 128

_WORD_BEFORE = re.compile(r"(?:\\d|\[[A-Za-z0-9\-]+\]|[A-Za-z0-9])(?:\{[0-9,]+\}|\+)?$")


def _alternatives(group: str) -> list[str]:
    """The alternatives of a pattern that starts with ``(?:``, without what follows the group."""
    depth, parts, at = 0, [], 3
    i = 0
    while i < len(group):
        c = group[i]
        if c == "\\":
            i += 2
            continue
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 1:
            parts.append(group[at:i])
            at = i + 1
        if depth == 0:
            return [] if group[i + 1 : i + 2] in ("?", "*") else [*parts, group[at:i]]
        i += 1
    return []


def _starts_with_word(pattern: str) -> bool:
    """Whether all that a pattern matches begins with an ASCII word character, as far as can be seen."""
    if pattern.startswith("(?:"):
        parts = _alternatives(pattern)
        return bool(parts) and all(map(_starts_with_word, parts))
    return bool(re.match(r"\\d|\[[A-Za-z0-9\-]+\](?![?*])|[A-Za-z0-9](?![?*])", pattern))


def java(pattern: str, ignore_case: bool = False, boundary: str = "ascii") -> str:
    """A pattern for Spark: ``boundary`` is ``ascii`` or ``unicode``; case is folded for accented letters, too.

    A word boundary beside what is surely a word character needs one look only.
    """
    if boundary == "ascii":
        parts = pattern.split(r"\b")
        for i in range(1, len(parts)):
            if _starts_with_word(parts[i]):
                parts[i] = r"(?<![A-Za-z0-9_])" + parts[i]
            elif _WORD_BEFORE.search(parts[i - 1]):
                parts[i] = r"(?![A-Za-z0-9_])" + parts[i]
            else:
                parts[i] = ASCII_EDGE + parts[i]
        pattern = "".join(parts)
    return f"(?iu){pattern}" if ignore_case else pattern


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def quoted(text: str) -> str:
    """A SQL literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def among(words) -> str:
    return "(" + ", ".join(quoted(w) for w in sorted(set(words))) + ")"


def let_sql(name: str, value: str, body: str) -> str:
    """SQL of ``body``, in which ``name`` is a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def running_sql(sizes: str) -> str:
    """SQL of an array: for each number of the array ``sizes`` (a name) the sum of those before it, by sums of blocks, which
    is nearly linear in the array's length."""
    total = lambda part: f"aggregate({part}, 0, (a, x) -> a + x)"
    blocks = f"transform(sequence(0, int(size({sizes}) div {BLOCK})), k -> {total(f'slice({sizes}, k * {BLOCK} + 1, {BLOCK})')})"
    before = f"transform(sums, (x, k) -> {total('slice(sums, 1, k)')})"
    inside = total(f"slice({sizes}, i - i % {BLOCK} + 1, i % {BLOCK})")
    return let_sql("sums", blocks, let_sql("bases", before, f"transform({sizes}, (x, i) -> bases[int(i div {BLOCK})] + {inside})"))


def clusters_sql(spans: str) -> str:
    """SQL of array<array<span>>: the SQL array ``spans`` by start, in groups such that no span of one overlaps one of another.
    The greatest end before each span is found by blocks, as in ``running_sql``."""
    top = lambda part: f"aggregate({part}, -1, (a, s) -> greatest(a, s.`end`))"
    blocks = f"transform(sequence(0, int(size(sorted) div {BLOCK})), k -> {top(f'slice(sorted, k * {BLOCK} + 1, {BLOCK})')})"
    before = "transform(tops, (x, k) -> aggregate(slice(tops, 1, k), -1, (a, y) -> greatest(a, y)))"
    inside = top(f"slice(sorted, i - i % {BLOCK} + 1, i % {BLOCK})")
    begins = f"filter(sequence(0, size(sorted) - 1), i -> sorted[i].start >= greatest(bases[int(i div {BLOCK})], {inside}))"
    groups = "transform(heads, (h, k) -> slice(sorted, h + 1, if(k + 1 < size(heads), heads[least(k + 1, size(heads) - 1)], size(sorted)) - h))"
    made = let_sql("tops", blocks, let_sql("bases", before, let_sql("heads", begins, groups)))
    return let_sql("sorted", f"array_sort({spans})", f"if(size(sorted) > 0, {made}, array(sorted))")


def matches_sql(text: str, pattern: str) -> str:
    """SQL of array<struct<start, end, match>>: the leftmost non-overlapping matches in the SQL ``text``; offsets in code
    points, ends exclusive.

    What lies before a match is found by splitting at the pattern, so no function outside Catalyst is needed. A text
    without a match costs one search, others two. (SQL rather than columns, as each column function is a call to the JVM,
    and there are hundreds in a pattern's expression.)
    """
    at = "ends[i] + length(gaps[i])"
    spans = f"transform(found, (m, i) -> named_struct('start', {at}, 'end', {at} + length(m), 'match', m))"
    located = let_sql("sizes", "transform(found, (m, i) -> length(gaps[i]) + length(m))", let_sql("ends", running_sql("sizes"), spans))
    some = let_sql("gaps", f"split({text}, {quoted(pattern)}, -1)", located)
    none = "from_json('[]', 'array<struct<start:int,end:int,match:string>>')"
    return let_sql("found", f"regexp_extract_all({text}, {quoted(pattern)}, 0)", f"if(size(found) > 0, {some}, {none})")


def matches(text: str, pattern: str) -> Column:
    """``matches_sql`` as a column."""
    return F.expr(matches_sql(text, pattern))


def alternation(words: list[str]) -> str:
    """A pattern for any of some literal words, the longest that fits: a tree of their common beginnings."""
    quoted = lambda c: "\\" + c if c in r".*+?^${}()|[]\/-" else c

    def tree(rest: list[str]) -> str:
        heads: dict[str, list[str]] = {}
        for w in rest:
            if w:
                heads.setdefault(w[0], []).append(w[1:])
        parts = [quoted(c) + tree(tails) for c, tails in sorted(heads.items())]
        if not parts:
            return ""
        joined = parts[0] if len(parts) == 1 else f"(?:{'|'.join(parts)})"
        return f"(?:{joined})?" if "" in rest else joined

    return tree(sorted(set(words)))
