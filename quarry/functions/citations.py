"""Citation numbers and markers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "[-–—～~]"
INLINE = r"[\.,](\d{1,3})(?:-(\d{1,3}))?|[\[\(](\d{1,3})[\]\)]"
RESOLVER = rf"[\.,](\d{{1,3}})(?:{DASH}(\d{{1,3}}))?|[\[\(【](\d{{1,3}})(?:{DASH}(\d{{1,3}}))?[\]\)】]"
BRACKETS = r"\[(\d{1,4})(?:[-–—](\d{1,4}))?\]"
MARKER = r"(?i)\[S(\d+)\]"


def _group(text: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))


def _ranges(starts: Column, ends: Column, span: int, swap: bool) -> Column:
    """All numbers of ranges given as two arrays of strings; an empty end is the start."""

    def one(a: Column, i: Column) -> Column:
        e = F.get(ends, i)
        first, last = a.cast("int"), F.coalesce(F.when(e != "", e.cast("int")), a.cast("int"))
        if swap:
            first, last = F.least(first, last), F.greatest(first, last)
        return F.when(last < first, F.array().cast("array<int>")).otherwise(F.sequence(first, F.least(last, first + span - 1)))

    return F.flatten(F.transform(starts, one))


def _either(text: Column, pattern: str, a: int, b: int) -> Column:
    return F.zip_with(_group(text, pattern, a), _group(text, pattern, b), lambda x, y: F.when(x != "", x).otherwise(y))


def inline_refs(text: Column) -> Column:
    """Numbers cited as ``.45-47``, ``,45`` or ``[45]``, at most 20 of a range,
    distinct and sorted. Decimals such as ``.05`` count as citations too."""
    text = F.coalesce(text, F.lit(""))
    return F.array_sort(F.array_distinct(_ranges(_either(text, INLINE, 1, 3), _group(text, INLINE, 2), 20, False)))


def resolver_refs(text: Column) -> Column:
    """Like ``inline_refs`` with all kinds of dashes and brackets; ranges the
    wrong way round are turned, at most 30 of a range, from 1 to 200."""
    text = F.coalesce(text, F.lit(""))
    numbers = _ranges(_either(text, RESOLVER, 1, 3), _either(text, RESOLVER, 2, 4), 30, True)
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: n.between(1, 200))))


def bracket_refs(text: Column, span: int = 30) -> Column:
    """Numbers in ``[n]`` and ``[n-m]``, in order of first appearance; wider ranges are left out."""
    text = F.coalesce(text, F.lit(""))
    starts, ends = _group(text, BRACKETS, 1), _group(text, BRACKETS, 2)
    wide = F.transform(starts, lambda a, i: F.coalesce(F.when(F.get(ends, i) != "", F.get(ends, i).cast("int")), a.cast("int")) - a.cast("int") <= span)
    keep = F.filter(F.sequence(F.lit(0), F.size(starts) - 1), lambda i: F.get(wide, i))
    some = F.when(F.size(starts) > 0, keep).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(_ranges(F.transform(some, lambda i: F.get(starts, i)), F.transform(some, lambda i: F.get(ends, i)), span + 1, False))


def superscript_refs(token: Column, most: int = 300) -> Column:
    """Numbers of a superscript such as ``3,5-7``, up to ``most``, sorted."""
    parts = F.filter(F.split(F.regexp_replace(token, r"\s", ""), ","), lambda p: p.rlike(rf"^\d{{1,3}}({DASH}\d{{1,3}})?$"))
    starts = F.transform(parts, lambda p: F.regexp_extract(p, r"^(\d+)", 1))
    ends = F.transform(parts, lambda p: F.regexp_extract(p, rf"{DASH}(\d+)$", 1))
    return F.array_sort(F.array_distinct(F.filter(_ranges(starts, ends, most, False), lambda n: n.between(1, most))))


def cited_sources(answer: Column) -> Column:
    """Indexes of ``[Sn]`` markers, distinct and sorted."""
    return F.array_sort(F.array_distinct(F.transform(_group(F.coalesce(answer, F.lit("")), MARKER, 1), lambda x: x.cast("int"))))


def renumber(answer: Column, kept: Column) -> Column:
    """Each marker's index becomes its place in ``kept``; other markers go, with the spaces they leave."""
    parts = F.split(answer, r"(?i)\[S\d+\]", -1)
    numbers = F.transform(_group(answer, MARKER, 1), lambda x: x.cast("int"))

    def piece(part: Column, i: Column) -> Column:
        place = F.array_position(kept, F.get(numbers, i - 1))
        mark = F.when((i > 0) & (F.coalesce(place, F.lit(0)) > 0), F.concat(F.lit("[S"), place.cast("string"), F.lit("]"))).otherwise(F.lit(""))
        return F.concat(mark, part)

    out = F.array_join(F.transform(parts, piece), "")
    return F.regexp_replace(F.regexp_replace(out, r"[ \t]{2,}", " "), r" +([,.;:!?])", "$1")


def format_answer(answer: Column) -> Column:
    """Markers without inner space, and no source list at the end."""
    out = F.regexp_replace(answer, r"(?i)\[\s*S\s*(\d+)\s*\]", "[S$1]")
    return F.trim(F.regexp_replace(out, r"(?s)\n\s*(来源|参考文献|引用来源|Sources|References)\s*[:：].*$", ""))
