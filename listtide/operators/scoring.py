"""Scoring: profile-independent facts once, then two profiles as cheap sums. No shuffle anywhere.

Text stages are separate projections so that an expensive column used many times is computed once."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions.identity import has_pair, level1_set, place_key
from ..functions.keywords import any_word, keyword_hits, literal_any, may_match, mentions, needles, present_unnegated, unicode
from ..functions.text import normalize_text, squeeze, unescape_compose, untag
from .pack import RulePack, Track

NO_WORDS = "array<string>"


@dataclass(frozen=True)
class ProfileSpec:
    """Which components a profile switches on, and the column its total goes to."""

    name: str
    column: str
    track_a: bool
    track_b: bool
    track_c: bool
    category_bonus: bool
    years_numeric: bool  # years count only from a stated number up


PROFILES: dict[str, ProfileSpec] = {
    "floor": ProfileSpec("floor", "score", False, True, False, True, False),
    "desk": ProfileSpec("desk", "score_it", True, False, True, False, True),
}

# Components in display order with their labels.
COMPONENTS: dict[str, str] = {
    "language_bonus": "Language of the listing",
    "track_a": "Keywords: support desk",
    "pair_tag_bonus": "Category pair",
    "track_b": "Keywords: entry-level floor work",
    "track_c": "Keywords: operations skills",
    "entry_level_bonus": "Stated as entry level",
    "senior_penalty": "Senior title or years required",
    "management_penalty": "Staff management required",
    "remote_bonus": "Remote work",
    "location_bonus": "Location",
    "licence_penalty": "Driving licence required",
    "degree_penalty": "Degree required",
    "fluency_penalty": "Language fluency required",
    "category_points": "Category",
    "channel_penalty": "Phone channel",
    "role_title_penalty": "Role title out of scope",
    "relocation_penalty": "Relocation not worthwhile",
    "formal_penalty": "Formal qualification required",
    "experience_penalty": "Programming experience required",
    "context_gate": "No match with the profile: context bonuses reduced",
}


def plain_text(df: DataFrame) -> DataFrame:
    """`_plain` (description without markup) and the normalised, lower-case `_title`, `_county_l`, `_place_l`.

    All of them in one projection: the few rows that need the Python worker pass through it once."""
    if "_plain" in df.columns:
        return df
    out = df.withColumn("_untagged", untag(F.col("description"))).withColumns({
        "_plain": squeeze(unescape_compose(F.col("_untagged"), F.col("_untagged"))), "_title": normalize_text(F.col("title")),
        "_county_l": normalize_text(F.col("county")), "_place_l": normalize_text(F.col("municipal"))})
    return out.withColumns({c: F.lower(c) for c in ("_title", "_county_l", "_place_l")}).drop("_untagged")


def _clause_gate(text: Column, pack: RulePack) -> Column:
    """May any clause rule's pattern occur? Patterns with known needles are not tried, as every rule tries its own."""
    pats = [*pack.years_patterns, *pack.management_patterns, *pack.fluency_patterns, literal_any(pack.licence_words),
            pack.formal, pack.experience]
    known = any_word(text, list(dict.fromkeys(n for p in pats for n in needles(p))))
    others = [f"(?:{p})" for p in pats if not needles(p) and p != r"(?!)"]
    return known | text.rlike("(?U)" + "|".join(others)) if others else known


def with_texts(df: DataFrame, pack: RulePack) -> DataFrame:
    """`_title`, `_text` (title and body on one first line) and `_clauses`, split only where some
    clause-aware pattern occurs in the text at all."""
    out = plain_text(df)
    out = out.withColumn("_text", F.lower(F.concat_ws(" ", "_title", "_plain")))
    none = F.array().cast("array<struct<clause:string,section:string,near:boolean,line:string>>")
    # Every clause rule looks only at clauses its own pattern occurs in, so the others are dropped right here.
    mentioning = F.filter(C.clauses(F.col("_text"), pack.words), lambda c: _clause_gate(c["clause"], pack))
    return out.withColumn("_clauses", F.when(_clause_gate(F.col("_text"), pack), mentioning).otherwise(none))


def _subset(words: Column, allowed: Sequence[str]) -> Column:
    return F.forall(words, lambda w: w.isin(*allowed)) if allowed else F.size(words) == 0


def _track_a(df: DataFrame, t: Track) -> DataFrame:
    title = F.col("_title")
    if t.boilerplate:
        bare = F.regexp_replace("_text", "(?U)" + t.boilerplate, " ")
        df = df.withColumn("_at", F.when(may_match(F.col("_text"), unicode(t.boilerplate)), bare).otherwise(F.col("_text")))
    df = df.withColumn("_aw0", keyword_hits(F.col("_at" if t.boilerplate else "_text"), t.words)).drop("_at")
    target = F.when(title.rlike(t.target_title), F.regexp_extract(title, f"({t.target_title})", 1)) if t.target_title \
        else F.lit(None).cast("string")
    df = df.withColumn("_target", target)
    kw, no_target = F.col("_aw0"), F.col("_target").isNull()
    if t.line_words:
        line = F.array(*[F.lit(w) for w in t.line_words])
        in_title = F.exists(F.array_intersect(kw, line), lambda w: F.contains(title, w))
        drop = no_target & F.arrays_overlap(kw, line) & ~in_title & _subset(kw, [*t.line_words, *t.weak_words])
        df = df.withColumn("_aw0", F.when(drop, F.array_except(kw, line)).otherwise(kw))
        kw = F.col("_aw0")
    if t.alone_zero:
        spared = F.contains(title, F.lit(t.alone_zero_title)) if t.alone_zero_title else F.lit(False)
        zero = no_target & (F.size(kw) > 0) & _subset(kw, t.alone_zero) & ~spared
        df = df.withColumn("_aw0", F.when(zero, F.array().cast(NO_WORDS)).otherwise(kw))
    df = df.withColumn("_at0", F.size(F.filter("_aw0", lambda w: F.contains(title, w))))
    if t.generic_title:
        generic = no_target & (F.col("_at0") == 0) & title.rlike(t.generic_title)
        df = df.withColumn("_target", F.when(generic, F.lit(t.generic_label)).otherwise(F.col("_target")))
    named = F.col("_target").isNotNull()
    hits = F.size("_aw0") + F.col("_at0") + F.when(named, 2).otherwise(0)
    return df.withColumn("f_a_points", F.least(hits * t.points, F.lit(t.cap))).withColumn(
        "f_a_words", F.when(named, F.concat("_aw0", F.array("_target"))).otherwise(F.col("_aw0")),
    ).drop("_aw0", "_at0", "_target")


def _years(pack: RulePack) -> Column:
    """Firm years mentions: array<struct<before, hit, after>>, upper bounds and employer boilerplate left out."""
    w = pack.words

    def skip(h: Column, c: Column) -> Column:
        about_us = h["before"].rlike("(?U)" + pack.years_boilerplate) & ~C.states_requirement(c, w)
        return h["before"].rlike("(?U)" + pack.years_ceiling) | about_us

    found = [C.firm_hits(F.col("_clauses"), unicode(p), w, skip) for p in pack.years_patterns]
    return F.concat(*found)


def required_years(found: Column, pack: RulePack) -> Column:
    """Largest stated number; the low end of a range counts; mentions without a number are ignored."""
    names = "|".join(pack.number_words)
    number = rf"(?U)(\d+|\b(?:{names})\b)" if names else r"(\d+)"
    low_end = rf"(?U)\b(\d+|{names})\s*(?:{pack.range_words})\s*$" if names else rf"\b(\d+)\s*(?:{pack.range_words})\s*$"
    table = F.create_map(*[F.lit(x) for kv in pack.number_words.items() for x in kv]) if names else None

    def value(h: Column) -> Column:
        own = F.nullif(F.regexp_extract(h["hit"], number, 1), F.lit(""))
        low = F.nullif(F.regexp_extract(h["before"], low_end, 1), F.lit(""))
        def number_of(token: Column) -> Column:
            word = F.try_element_at(table, token) if table is not None else F.lit(None).cast("int")
            return F.coalesce(word, token.try_cast("int"))
        return C.let(F.when(own.isNotNull(), F.coalesce(low, own)), number_of)

    return F.array_max(F.transform(found, value))


def with_facts(df: DataFrame, pack: RulePack) -> DataFrame:
    """Profile-independent facts as columns `f_*`; needs uuid, title, description, municipal, county, language,
    occupation_categories, extent_percent, engagement_type."""
    p, w = pack.points, pack.words
    df = _track_a(with_texts(df, pack), pack.track_a)
    text, title, cl = F.col("_text"), F.col("_title"), F.col("_clauses")

    df = df.withColumn("f_b_words", keyword_hits(text, pack.track_b.words)).withColumn(
        "f_c_words", keyword_hits(text, pack.track_c.words)).withColumn("_years", _years(pack))
    exempt = pack.track_b.title_exempt
    b_title = F.size(F.filter("f_b_words", lambda k: F.contains(title, k) & (~k.isin(*exempt) if exempt else F.lit(True))))

    county = F.upper(F.coalesce("county", F.lit("")))
    own_place = place_key(F.col("municipal"))
    table = [F.lit(x) for kv in pack.tier_places.items() for x in kv]
    tier_place = F.when(county == pack.home_region, F.coalesce(
        F.try_element_at(F.create_map(*table), own_place), own_place)).otherwise(own_place) if table else own_place

    cats = level1_set(F.col("occupation_categories"))

    def points_of(m) -> Column:
        total = F.lit(0)
        for name, pts in m.items():
            total = total + F.when(F.array_contains(cats, name), pts).otherwise(0)
        return total

    stage1 = df.select(
        "*",
        (F.coalesce(F.col("language") == pack.target_language, F.lit(False))).alias("f_english"),
        has_pair(F.col("occupation_categories"), *pack.pair_tag).alias("f_pair"),
        F.size("f_b_words").alias("f_b_hits"), b_title.alias("f_b_title"),
        any_word(title, pack.role_titles).alias("f_role_title"),
        (any_word(text, pack.entry_phrases) | any_word(title, pack.entry_titles)).alias("f_entry"),
        (any_word(title, pack.senior_titles) | title.rlike(C.alt(pack.senior_title_patterns))).alias("f_senior"),
        (F.size("_years") > 0).alias("f_years"),
        F.coalesce(required_years(F.col("_years"), pack) >= p.years_limit, F.lit(False)).alias("f_years_many"),
        F.filter(F.array(*[F.when(F.size(C.firm_hits(cl, unicode(m), w)) > 0, F.lit(m)) for m in pack.management_patterns])
                 if pack.management_patterns else F.array().cast(NO_WORDS), lambda x: x.isNotNull()).alias("f_management"),
        (present_unnegated(text, pack.remote_words, pack.remote_negations)
         | F.contains(title, F.lit(pack.remote_title))).alias("f_remote"),
        county.alias("_county"), tier_place.alias("_tier_place"),
        C.required_mention(cl, literal_any(pack.licence_words), w).alias("f_licence"),
        mentions(text, C.alt(pack.degree_patterns)).alias("f_degree"),
        (F.size(C.firm_hits(cl, C.alt(pack.fluency_patterns), w)) > 0).alias("f_fluency"),
        cats.alias("f_categories"),
        F.when(~F.array_contains(cats, pack.category_veto), F.least(points_of(pack.category_bonus), F.lit(p.category_cap)))
        .otherwise(0).alias("f_cat_bonus"),
        points_of(pack.category_penalty).alias("_cat_penalty"),
        any_word(text, pack.channel_phrases).alias("f_channel"),
        F.lower(F.coalesce("engagement_type", F.lit(""))).rlike(
            f"^(?:{literal_any(pack.temporary_prefixes)})").alias("_temporary"),
        mentions(text, unicode(pack.long_contract)).alias("_long"),
        C.required_mention(cl, unicode(pack.formal), w, waiver=unicode(pack.formal_own_field)).alias("f_formal"),
        C.unsoftened_mention(cl, unicode(pack.experience), w).alias("f_experience"),
        mentions(title, unicode(pack.advisory_title)).alias("_advisory"),
        mentions(title, unicode(pack.professional_title)).alias("_professional"),
        mentions(title, unicode(pack.category_title)).alias("_cat_title"),
    )
    moving = ~F.col("_tier_place").isin(*pack.tier1_places) & ~F.col("f_remote")
    tier2 = F.col("_county").isin(*pack.tier2_regions) | F.col("_tier_place").isin(*pack.tier2_places)
    return stage1.select(
        *[c for c in stage1.columns if c not in ("_county", "_cat_penalty", "_temporary", "_long", "_years")],
        F.when(F.col("_tier_place").isin(*pack.tier1_places), p.tier1).when(tier2, p.tier2)
        .when(F.col("_county") == pack.home_region, p.home_region).otherwise(0).alias("f_location"),
        F.when(F.col("_cat_penalty") != 0, F.col("_cat_penalty")).when(F.col("_cat_title"), p.category_title)
        .otherwise(0).alias("f_cat_penalty"),
        (moving & F.coalesce(F.col("extent_percent") < p.relocation_extent, F.lit(False))).alias("f_low_extent"),
        (moving & F.col("_temporary") & ~F.col("_long")).alias("f_short_contract"),
    )


def _entry(points: Column, matched: Column | None = None) -> Column:
    m = F.coalesce(matched, F.array().cast(NO_WORDS)) if matched is not None else F.array().cast(NO_WORDS)
    return F.struct(points.cast("int").alias("points"), m.alias("matched"))


def _flag(cond: Column, points: int, label: str) -> Column:
    return _entry(F.when(cond, points).otherwise(0), F.when(cond, F.array(F.lit(label))))


def entries(pack: RulePack, spec: ProfileSpec) -> dict[str, Callable[[], Column]]:
    """Component -> builder of its (points, matched) for one profile over fact columns."""
    p = pack.points
    zero = F.lit(0)
    a_points = F.col("f_a_points") if spec.track_a else zero
    pair = F.col("f_pair") & (a_points > 0)
    b_points = F.least((F.col("f_b_hits") + F.col("f_b_title")) * pack.track_b.points, F.lit(pack.track_b.cap))
    c_points = F.least(F.size("f_c_words") * pack.track_c.points, F.lit(pack.track_c.cap))
    cat_bonus = F.col("f_cat_bonus") if spec.category_bonus else zero
    years = F.col("f_years_many") if spec.years_numeric else F.col("f_years")
    if spec.track_a:
        relevant = (a_points >= p.track_relevant) | pair
    else:
        relevant = ((F.col("f_b_title") > 0) & ~F.col("_advisory")) | (F.col("f_b_hits") >= p.hits_relevant) | (
            (cat_bonus > 0) & ~F.col("_professional"))
    context = (F.greatest("f_location", zero) + F.when(F.col("f_remote"), p.remote).otherwise(0)
               + F.when(F.col("f_english"), p.english).otherwise(0) + F.when(F.col("f_entry"), p.entry_level).otherwise(0))
    gate = F.when(relevant, 0).otherwise(-(F.bround(context * F.lit(p.gate_share), 0).cast("int") + F.greatest(cat_bonus, zero)))
    return {
        "language_bonus": lambda: _entry(F.when(F.col("f_english"), p.english).otherwise(0), F.when(F.col("language").isNotNull(), F.array("language"))),
        "track_a": lambda: _entry(a_points, F.col("f_a_words")),
        "pair_tag_bonus": lambda: _flag(pair, p.pair_tag if spec.track_a else 0, "pair"),
        "track_b": lambda: _entry(b_points if spec.track_b else zero, F.col("f_b_words")),
        "track_c": lambda: _entry(c_points if spec.track_c else zero, F.col("f_c_words")),
        "entry_level_bonus": lambda: _flag(F.col("f_entry"), p.entry_level, "entry level"),
        "senior_penalty": lambda: _entry(
            F.when(F.col("f_senior"), p.senior_title).otherwise(0) + F.when(years, p.years).otherwise(0),
            F.filter(F.array(F.when(F.col("f_senior"), F.lit("title")), F.when(years, F.lit("years"))), lambda x: x.isNotNull())),
        "management_penalty": lambda: _entry(F.when(F.size("f_management") > 0, p.management).otherwise(0), F.col("f_management")),
        "remote_bonus": lambda: _flag(F.col("f_remote"), p.remote, "remote"),
        "location_bonus": lambda: _entry(F.col("f_location"), F.array(F.coalesce("municipal", "county", F.lit("unknown")))),
        "licence_penalty": lambda: _flag(F.col("f_licence"), p.licence, "licence"),
        "degree_penalty": lambda: _flag(F.col("f_degree"), p.degree, "degree"),
        "fluency_penalty": lambda: _flag(F.col("f_fluency"), p.fluency, "fluency"),
        "category_points": lambda: _entry(cat_bonus + F.col("f_cat_penalty"), F.array_sort("f_categories")),
        "channel_penalty": lambda: _flag(F.col("f_channel"), p.channel, "phone"),
        "role_title_penalty": lambda: _flag(F.col("f_role_title"), p.role_title, "title"),
        "relocation_penalty": lambda: _entry(
            F.when(F.col("f_low_extent"), p.relocation).otherwise(0) + F.when(F.col("f_short_contract"), p.relocation).otherwise(0),
            F.filter(F.array(F.when(F.col("f_low_extent"), F.lit("low share")), F.when(F.col("f_short_contract"), F.lit("short contract"))),
                     lambda x: x.isNotNull())),
        "formal_penalty": lambda: _flag(F.col("f_formal"), p.formal, "qualification"),
        "experience_penalty": lambda: _flag(F.col("f_experience"), p.experience, "programming"),
        "context_gate": lambda: _flag(~relevant, 0, "not relevant").withField("points", gate.cast("int")),
    }


def breakdown(pack: RulePack, spec: ProfileSpec) -> Column:
    """map component -> (points, matched) for one profile."""
    parts = entries(pack, spec)
    return F.map_from_arrays(F.array(*[F.lit(k) for k in parts]), F.array(*[build() for build in parts.values()]))


def component(pack: RulePack, spec: ProfileSpec, name: str) -> Column:
    """One component alone; facts it does not need are pruned from the plan."""
    return entries(pack, spec)[name]()


def total(points: Column, base: int) -> Column:
    """Base plus all points, clamped to 0-100."""
    s = F.aggregate(F.map_values(points), F.lit(base), lambda acc, e: acc + e["points"])
    return F.least(F.greatest(s, F.lit(0)), F.lit(100))


def total_points(pack: RulePack, spec: ProfileSpec) -> Column:
    """The same total without the breakdown, so that a plan that asks for totals alone builds no maps."""
    s = F.lit(pack.points.base)
    for build in entries(pack, spec).values():
        s = s + build()["points"]
    return F.least(F.greatest(s, F.lit(0)), F.lit(100))


def with_scores(facts: DataFrame, pack: RulePack, profiles: Sequence[str] = tuple(PROFILES)) -> DataFrame:
    """Totals and breakdowns per profile in their own columns."""
    out = facts
    for name in profiles:
        spec = PROFILES[name]
        out = out.withColumn(f"{spec.column}_breakdown", breakdown(pack, spec))
    for name in profiles:
        spec = PROFILES[name]
        out = out.withColumn(spec.column, total_points(pack, spec))
    return out


def drop_facts(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(("f_", "_"))])


def score(df: DataFrame, pack: RulePack, profiles: Sequence[str] = tuple(PROFILES)) -> DataFrame:
    return drop_facts(with_scores(with_facts(df, pack), pack, profiles))


def long_form(scored: DataFrame, profile: str, key: str = "uuid") -> DataFrame:
    """(key, component, points): the breakdown as rows."""
    col = f"{PROFILES[profile].column}_breakdown"
    # The outer form: the map is never empty, and the optimizer would copy the whole scoring expression into an
    # inferred size filter below a plain explode.
    return scored.select(key, F.explode_outer(col).alias("component", "e")).select(
        key, "component", F.col("e")["points"].alias("points"))


def display_breakdown(df: DataFrame, raw: str, key: str = "uuid") -> DataFrame:
    """Stored breakdown JSON as ordered display rows (key, ord, label, points, detail)."""
    parsed = F.from_json(raw, "map<string,struct<points:int,matched:array<string>>>")
    names = F.array(*[F.lit(k) for k in COMPONENTS])
    labels = F.array(*[F.lit(v) for v in COMPONENTS.values()])
    rows = df.select(key, parsed.alias("_b")).select(key, F.explode("_b").alias("component", "e"))
    pos = F.array_position(names, F.col("component"))
    return rows.where(pos > 0).select(
        key, pos.cast("int").alias("ord"), F.element_at(labels, pos.cast("int")).alias("label"),
        F.col("e")["points"].alias("points"),
        F.when(F.size(F.col("e")["matched"]) > 0, F.array_join(F.col("e")["matched"], ", ")).otherwise("—").alias("detail"))
