"""Numbers stated in free text: share of full time, pay, durations, bands."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .clauses import hits, let
from .text import extract


@dataclass(frozen=True)
class FigureWords:
    """Vocabulary for reading figures; the numeric shapes are fixed, the words are data."""

    full_time: Sequence[str] = ("Full time", "Full-time")
    post_nouns: str = "position|post"
    currency: str = r"usd|\$"
    wage_words: str = "salary|wage|pay"
    range_words: str = "and|to|[-–]"


# A figure: up to three digits and one or two groups of three, or four to seven digits; more than seven are no pay.
_GAP = r"[ .\x{A0}]"
_SPLIT_UP = rf"[0-9]{{1,3}}(?:{_GAP}[0-9]{{3}}){{1,2}}(?![0-9])"
_FIGURE = rf"{_SPLIT_UP}|[0-9]{{4,7}}(?![0-9])"
_NUMBER = rf"{_SPLIT_UP}|[0-9]+"
MOST_DIGITS = 7
# Characters between a share and its noun, and between a wage word and its figure.
NEAR_NOUN, NEAR_WAGE = 20, 40
#: Room for the noun or wage word itself, and for a range and a currency behind a figure.
_WORD_ROOM, _RANGE_ROOM = 60, 80


def extent_percent(scope: Column, title: Column, body: Column, words: FigureWords = FigureWords()) -> Column:
    """100 for a full-time word; a percentage in the title; one within NEAR_NOUN characters of the noun in the body.

    A share is a number of its own: the end of a longer one (an address, a phone number, decimals) is none."""
    share = r"(?<![0-9])(?<![0-9][.,])[0-9]{1,3}\s?%"

    def near(h: Column) -> Column:
        ahead = h["after"].rlike(rf"(?i)^[^.\n]{{0,{NEAR_NOUN}}}(?:{words.post_nouns})")
        behind = h["before"].rlike(rf"(?i)(?:{words.post_nouns})[^.\n]{{0,{NEAR_NOUN}}}$")
        return ahead | behind

    def bounded(c: Column) -> Column:
        n = F.regexp_extract(c, "[0-9]+", 0).try_cast("int")
        return F.when(n.between(1, 100), n)

    in_body = F.when(body.contains("%"), F.get(F.filter(hits(body, share, NEAR_NOUN + _WORD_ROOM, NEAR_NOUN + _WORD_ROOM), near), F.lit(0))["hit"])
    return F.coalesce(F.when(scope.isin(*words.full_time), F.lit(100)), bounded(extract(title, f"({share})")), bounded(in_body))


def pay_mention(text: Column, words: FigureWords = FigureWords()) -> Column:
    """The stretch of text that states pay: a figure right behind a currency first, else one between a wage word and a currency.

    Every figure is looked at with the text on both sides, in texts that name a currency at all."""
    currency_before = rf"(?iU)(?:{words.currency})\.?\s?$"
    wage_before = rf"(?iU)\b(?:{words.wage_words})\w*\b[^.]{{0,{NEAR_WAGE}}}$"
    dash_after = rf"(?iU)^\s?[-–]\s?(?:{_FIGURE})"
    currency_after = rf"(?iU)^(?:\s?(?:{words.range_words})\s?(?:{_FIGURE}))?\s?(?:{words.currency})(?!\w)"

    def stretch(found: Column, before: str, after: str) -> Column:
        return let(found, lambda f: F.concat(F.regexp_extract(f["before"], before, 0), f["hit"], F.regexp_extract(f["after"], after, 0)))

    def choose(figures: Column) -> Column:
        led = F.get(F.filter(figures, lambda h: h["before"].rlike(currency_before)), F.lit(0))
        closed = F.get(F.filter(figures, lambda h: h["before"].rlike(wage_before) & h["after"].rlike(currency_after)), F.lit(0))
        return F.coalesce(stretch(led, currency_before, dash_after), stretch(closed, wage_before, currency_after))

    return F.when(text.rlike(f"(?iU)(?:{words.currency})"), let(
        hits(text, f"(?U)(?<![0-9])(?:{_FIGURE})", NEAR_WAGE + _WORD_ROOM, _RANGE_ROOM), choose))


def pay_figures(mention: Column, words: FigureWords = FigureWords()) -> Column:
    """array<decimal> of a mention: one figure, or two when nothing but a range word stands between them."""
    between = rf"(?iU)^\s*(?:{words.range_words})\s*$"

    def read(m: Column) -> Column:
        found = F.regexp_extract_all(m, F.lit(f"({_NUMBER})"), F.lit(1))
        two = (F.size(found) >= 2) & F.get(F.split(m, _NUMBER), F.lit(1)).rlike(between)
        digits = F.transform(F.slice(found, F.lit(1), F.when(two, 2).otherwise(1)), lambda n: F.regexp_replace(n, _GAP, ""))
        # A third group that no pay can have belongs to whatever follows.
        return F.transform(digits, lambda d: F.when(F.length(d) > MOST_DIGITS, F.left(d, F.length(d) - 3)).otherwise(d).try_cast("decimal(20,0)"))

    return let(mention, read)


def pay_text(mention: Column, label: str = "usd", words: FigureWords = FigureWords()) -> Column:
    """Canonical pay: the label and the one or two figures of a mention."""
    def show(figures: Column) -> Column:
        return F.concat(F.lit(label + " "), F.array_join(F.transform(figures, lambda n: F.translate(F.format_number(n, 0), ",", " ")), " – "))
    return let(pay_figures(mention, words), lambda f: F.when(f.isNotNull(), show(f)))


def pay_min(canonical: Column) -> Column:
    """First figure of a canonical pay text, for threshold filters."""
    return F.get(pay_figures(canonical), F.lit(0)).try_cast("int")


def duration_text(minutes: Column, hour: str = "h", minute: str = "min", unknown: str = "—") -> Column:
    h, m = F.floor(minutes / 60).cast("int"), (minutes % 60).cast("int")
    text = F.when(h > 0, F.concat_ws(" ", h, F.lit(hour), m, F.lit(minute))).otherwise(
        F.concat_ws(" ", m, F.lit(minute)))
    return F.when(minutes.isNull(), F.lit(unknown)).otherwise(text)


def score_band(score: Column, high: int = 55, mid: int = 25) -> Column:
    """Badge band; an unscored row is low."""
    return F.when(score >= high, F.lit("high")).when(score >= mid, F.lit("mid")).otherwise(F.lit("low"))


def is_new(first_seen: Column, previous_run: Column) -> Column:
    return F.coalesce(first_seen > previous_run, F.lit(False))
