"""Keyword lookups on one text column."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class Hinted(str):
    """A pattern that knows plain stretches of text, `needles`: every match holds at least one of them."""

    needles: tuple[str, ...] = ()


def hinted(pattern: str, *needles: str) -> Hinted:
    out = Hinted(pattern)
    out.needles = tuple(n for n in dict.fromkeys(needles))
    return out


def needles(pattern: str) -> tuple[str, ...]:
    return getattr(pattern, "needles", ())


def unicode(pattern: str) -> str:
    """The pattern with Unicode classes."""
    return hinted("(?U)" + pattern, *needles(pattern))


def either(patterns: Sequence[str]) -> str:
    """One alternation; what any match holds is known only if it is known of each pattern."""
    known = [needles(p) for p in patterns]
    return hinted("|".join(patterns), *(n for k in known for n in k) if all(known) else ())


def may_match(text: Column, pattern: str) -> Column:
    """True wherever the pattern matches; cheaper than the match where its needles are known."""
    return any_word(text, needles(pattern)) if needles(pattern) else text.rlike(pattern)


def mentions(text: Column, pattern: str) -> Column:
    """Does the pattern match? It is tried only in texts that hold one of its needles."""
    return any_word(text, needles(pattern)) & text.rlike(pattern) if needles(pattern) else text.rlike(pattern)


def literal_any(words: Sequence[str]) -> str:
    """One alternation matching any of the words literally."""
    return hinted("|".join(re.escape(w) for w in words), *words) if words else r"(?!)"


def any_word(text: Column, words: Sequence[str]) -> Column:
    return reduce(Column.__or__, [F.contains(text, F.lit(w)) for w in words]) if words else F.lit(False)


def keyword_hits(text: Column, words: Sequence[str]) -> Column:
    """The words found anywhere in the text, in list order."""
    if not words:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(F.contains(text, F.lit(w)), F.lit(w)) for w in words]))


def present_unnegated(text: Column, words: Sequence[str], negations: Sequence[str]) -> Column:
    """Some word occurs with none of the negations directly before it."""
    if not words:
        return F.lit(False)
    guard = "".join(f"(?<!{re.escape(n)})" for n in negations)
    return mentions(text, hinted(f"(?={literal_any(words)}){guard}", *words))
