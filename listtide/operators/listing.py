"""Listing queries: one predicate for list and count, ordered pages, the board, counters."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.identity import has_level1
from ..functions.text import contains_folded
from ..schema import BACKLOG_STATUSES, TRASH_STATUS, USER_STATUSES
from .ordered import SortKey, narrowed
from .skew import top_per_key

PAGE_SIZE = 50
#: Pages of rows that are ordered for one page.
NARROW = 3
BOARD_LIMIT = 500

PROFILE_COLUMNS = {"floor": "score", "desk": "score_it"}

LIST_COLUMNS = (
    "uuid title business_name municipal language source user_status application_due published sector score "
    "link application_url excluded exclusion_reason extent_percent county salary_text first_seen_at flagged_at "
    "notes status application_due_sort").split()


def score_column(profile: str) -> str:
    if profile not in PROFILE_COLUMNS:
        raise ValueError(f"unknown score profile: {profile!r}")
    return PROFILE_COLUMNS[profile]


@dataclass(frozen=True)
class ListingQuery:
    active_only: bool = True
    user_status: str | Sequence[str] | None = None
    language: str | None = None
    search: str | None = None
    source: str | None = None
    show_excluded: bool = False
    show_flagged: bool = False
    min_score: int | None = None
    min_salary: int | None = None
    min_extent_percent: int | None = None
    occupation_category: str | None = None
    profile: str = "floor"
    sort: str = "score"

    def predicate(self) -> Column:
        """The filter shared by list and count; cheap column tests come before the text search."""
        score = score_column(self.profile)
        tests: list[Column] = []
        if self.active_only:
            tests.append((F.col("status") == "ACTIVE") | ~F.col("user_status").isin(*BACKLOG_STATUSES))
        if not self.show_excluded:
            tests.append(~F.col("excluded"))
        if not self.show_flagged:
            tests.append(F.col("flagged_at").isNull())
        wanted = [self.user_status] if isinstance(self.user_status, str) else list(self.user_status or [])
        if wanted:
            tests.append(F.col("user_status").isin(*wanted))
        elif self.search:
            tests.append(F.col("user_status") != TRASH_STATUS)
        else:
            tests.append(F.col("user_status").isin(*BACKLOG_STATUSES))
        if self.language:
            tests.append(F.col("language") == self.language)
        if self.source:
            tests.append(F.col("source") == self.source)
        if self.min_score is not None:
            tests.append(F.col(score) >= self.min_score)
        if self.min_salary is not None:
            tests.append(F.col("salary_min") >= self.min_salary)
        if self.min_extent_percent is not None:
            tests.append(F.col("extent_percent") >= self.min_extent_percent)
        if self.occupation_category:
            tests.append(has_level1(F.col("occupation_categories"), self.occupation_category))
        if self.search:
            tests.append(
                contains_folded(F.col("title"), self.search) | contains_folded(F.col("description"), self.search)
                | contains_folded(F.col("business_name"), self.search))
        out = F.lit(True)
        for t in tests:
            out = out & t
        return out

    def sort_keys(self) -> list[SortKey]:
        if self.sort == "deadline":
            return [SortKey("application_due_sort"), SortKey("uuid")]
        return [SortKey(score_column(self.profile), descending=True), SortKey("published", descending=True), SortKey("uuid")]

    def ordering(self) -> list[Column]:
        return [k.order() for k in self.sort_keys()]

    def select(self) -> list[Column]:
        score = score_column(self.profile)
        return [F.col(score).alias("score") if c == "score" else F.col(c) for c in LIST_COLUMNS]


def matching(rows: DataFrame, q: ListingQuery) -> DataFrame:
    return rows.where(q.predicate())


def list_page(rows: DataFrame, q: ListingQuery, limit: int = PAGE_SIZE, offset: int = 0) -> DataFrame:
    """An ordered slice. Orders before projecting so that Spark plans one TakeOrderedAndProject; a far offset is first brought
    close by counting."""
    hit = matching(rows, q)
    if offset > NARROW * limit:
        hit, offset = narrowed(hit, q.sort_keys(), offset, limit, hit.count(), NARROW * limit)
    return hit.orderBy(*q.ordering()).offset(offset).limit(limit).select(*q.select())


def count_matching(rows: DataFrame, q: ListingQuery) -> DataFrame:
    return matching(rows, q).agg(F.count(F.lit(1)).alias("n"))


def page(rows: DataFrame, q: ListingQuery, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Page `number` (from 1), clamped to the last one.

    A small histogram of the leading sort column gives the total for the clamp and the band of values the page
    lies in; a band of more than NARROW pages is narrowed further along the whole order, so neither a deep page nor equal
    scores bring more than a few pages of rows together."""
    lead = "application_due_sort" if q.sort == "deadline" else score_column(q.profile)
    hit = matching(rows, q)
    bands = hit.groupBy(lead).agg(F.count(F.lit(1)).alias("n"))  # scores 0-100 or calendar days
    table = [(r[0], r[1]) for r in bands.collect()]
    total = sum(n for _, n in table)
    last = max(1, -(-total // size))
    start = (min(max(number, 1), last) - 1) * size
    known = sorted((t for t in table if t[0] is not None), reverse=q.sort != "deadline")
    ordered = known + [t for t in table if t[0] is None]
    before, picked = 0, []
    skipped = held = 0
    for value, n in ordered:
        if before + n <= start:
            skipped += n
        elif before < start + size:
            picked.append(value)
            held += n
        before += n
    band = F.col(lead).isin(*[v for v in picked if v is not None]) if any(v is not None for v in picked) else F.lit(False)
    if None in picked:
        band = band | F.col(lead).isNull()
    part, at = narrowed(hit.where(band), q.sort_keys(), start - skipped, size, held, NARROW * size)
    return part.orderBy(*q.ordering()).offset(at).limit(size).select(*q.select())


def board(rows: DataFrame, profile: str = "floor", limit: int = BOARD_LIMIT) -> DataFrame:
    """Per status (all but the first and the trash) the best rows, up to `limit`."""
    q = ListingQuery(active_only=False, show_flagged=True, profile=profile,
                     user_status=[s for s in USER_STATUSES if s not in ("new", TRASH_STATUS)])
    ranked = top_per_key(matching(rows, q), ["user_status"], q.ordering(), limit, "uuid")
    return ranked.select("rank", *q.select())


def open_interesting(as_of: Column) -> Column:
    """Board rule for the interesting column: active and not past due (an unknown due date stays)."""
    due = F.col("application_due_sort")
    return (F.col("status") == "ACTIVE") & (due.isNull() | (due >= as_of.cast("date")))


def board_visible(b: DataFrame, as_of: Column) -> DataFrame:
    return b.where((F.col("user_status") != "interesting") | open_interesting(as_of))


def hidden_interesting(b: DataFrame, as_of: Column) -> DataFrame:
    return b.where((F.col("user_status") == "interesting") & ~open_interesting(as_of)).agg(
        F.count(F.lit(1)).alias("hidden"))


def counters(rows: DataFrame) -> DataFrame:
    """Active excluded and active flagged rows in one pass."""
    active = F.col("status") == "ACTIVE"
    return rows.agg(F.count_if(active & F.col("excluded")).alias("n_excluded"),
                    F.count_if(active & F.col("flagged_at").isNotNull()).alias("n_flagged"))


def count_new_high_score(rows: DataFrame, since: Column, min_score: int, profile: str = "floor") -> DataFrame:
    """First seen after the watermark, scoring enough, and visible in the default list."""
    visible = replace(ListingQuery(), profile=profile, min_score=min_score).predicate()
    hit = (F.col("first_seen_at") > since) & (F.col("status") == "ACTIVE") & visible
    return rows.agg(F.count_if(hit).alias("n"))


def review_queue(rows: DataFrame) -> DataFrame:
    """Active flagged rows, oldest flag first."""
    return rows.where((F.col("status") == "ACTIVE") & F.col("flagged_at").isNotNull()).orderBy("flagged_at", "uuid")


def active_sources(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("status") == "ACTIVE").select("source").distinct().orderBy("source")


def newest_of(rows: DataFrame, source: str) -> DataFrame:
    return rows.where(F.col("source") == source).agg(F.max_by("uuid", F.struct("first_seen_at", "uuid")).alias("uuid"))


SCORING_COLUMNS = (
    "uuid title description municipal county language extent_percent extent salary_text salary_min business_name "
    "source description_borrowed_from user_status occupation_categories engagement_type").split()


def scorable(rows: DataFrame, active_only: bool = True) -> DataFrame:
    """The pruned scan a scoring pass reads."""
    return (rows.where(F.col("status") == "ACTIVE") if active_only else rows).select(*SCORING_COLUMNS)
