"""Hard eligibility blocks: an ordered list of nullable reasons, first one wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import clauses as C
from ..functions.keywords import mentions, unicode
from .pack import RulePack
from .scoring import plain_text

# Characters around a match that each test looks at.
SOME_BEFORE, SOFT_REST, SOFT_BEFORE, SOFT_AFTER, CONTEXT = 80, 300, 60, 30, 150
LATER, NEGATED_AFTER, LAW_BEFORE, BULLET, ELIGIBLE = 40, 30, 100, 120, 160

_LINE_OR_CLAUSE = r"(?U)\n|" + C.CLAUSE_BREAK


def _u(pattern: str) -> str:
    return "(?U)" + pattern


def _mentions(text: Column, pattern: str) -> Column:
    """array<struct<hit, before, after, text_before, text_after, clause>>: every match in the whole text with the
    text on both sides, and the same narrowed to its own clause (`before`, `after`)."""
    sides = F.transform(C.hits(text, _u(pattern)), lambda h: F.struct(
        h["hit"].alias("hit"), F.element_at(F.split(h["before"], _LINE_OR_CLAUSE), -1).alias("before"),
        F.get(F.split(h["after"], _LINE_OR_CLAUSE), F.lit(0)).alias("after"),
        h["before"].alias("text_before"), h["after"].alias("text_after")))
    return F.transform(sides, lambda h: h.withField("clause", F.concat(h["before"], h["hit"], h["after"])))


def section_before(h: Column, pack: RulePack) -> Column:
    """Kind of the last heading above the match, when it is close enough to be in force."""
    done = F.when(F.contains(h["text_before"], F.lit("\n")), F.regexp_replace(h["text_before"], r"\n[^\n]*\z", "\n")).otherwise("")
    # One more line after the finished ones carries the state at the match.
    last = F.element_at(C.section_lines(F.concat(done, F.lit("\n.")), pack.words), -1)
    return C.let(last, lambda x: F.when(x["reach"] <= C.SECTION_REACH, x["section"]))


def _optional_without_verb(h: Column, pack: RulePack) -> Column:
    verb = h["clause"].rlike(C.alt(pack.words.requirement_verbs))
    return ~verb & F.coalesce(section_before(h, pack) == "opt", F.lit(False))


def _some_positions(h: Column, pack: RulePack) -> Column:
    return F.right(h["text_before"], F.lit(SOME_BEFORE)).rlike(_u(pack.some_positions))


def _any_mention(text: Column, pattern: str, test) -> Column:
    """Presence is tested first; positions are worked out only in texts that hold the pattern."""
    return F.when(mentions(text, unicode(pattern)), F.exists(_mentions(text, pattern), test)).otherwise(F.lit(False))


def authorisation_required(body: Column, pack: RulePack) -> Column:
    w = pack.words

    def named(h: Column) -> Column:
        def stays_hard(rest: Column) -> Column:
            around = F.regexp_extract(rest, f"(?U)(.{{0,{SOFT_BEFORE}}}(?:{pack.soft_around}).{{0,{SOFT_AFTER}}})", 1)
            return ~rest.rlike(_u(pack.soft_around)) | around.rlike(_u(pack.in_training))
        rest = F.left(F.get(F.split(h["text_after"], "\n"), F.lit(0)), F.lit(SOFT_REST))
        return (~_some_positions(h, pack) & ~h["before"].rlike(_u(pack.alternative_before))
                & ~h["before"].rlike(_u(pack.preference_before)) & C.let(rest, stays_hard)
                & C.firm_in_segment(h, w) & ~_optional_without_verb(h, pack))

    def generic(h: Column) -> Column:
        near = F.concat(F.right(h["text_before"], F.lit(CONTEXT)), h["hit"], F.left(h["text_after"], F.lit(CONTEXT)))
        return (~_some_positions(h, pack) & ~F.contains(h["clause"], F.lit(pack.authorisation_access))
                & near.rlike(_u(pack.authorisation_context)) & C.firm_in_segment(h, w))

    out = F.lit(False)
    for p in pack.authorisation:
        out = out | _any_mention(body, p, named)
    for p in pack.authorisation_generic:
        out = out | _any_mention(body, p, generic)
    return out


def regulated_reason(title: Column, body: Column, pack: RulePack) -> Column:
    """A firm mention of a licence and no explicit soft one; mentions that are alternatives do not count."""
    def kind(h: Column) -> Column:
        aside = (_some_positions(h, pack) | h["after"].rlike(_u(pack.alternative_after))
                 | h["before"].rlike(_u(pack.alternative_before)))
        soft = (h["before"].rlike(_u(pack.preference_before)) | h["after"].rlike(_u(pack.soft_around))
                | F.left(h["after"], F.lit(LATER)).rlike(_u(pack.alternative_later))
                | ~C.firm_in_segment(h, pack.words) | _optional_without_verb(h, pack))
        return F.when(aside, "aside").when(soft, "soft").otherwise("firm")

    reasons = []
    for pattern, reason, mixed in pack.regulated:
        kinds = F.transform(_mentions(body, pattern), kind)
        only_firm = C.let(kinds, lambda k: F.array_contains(k, "firm") & ~F.array_contains(k, "soft"))
        present = mentions(body, unicode(pattern))
        if mixed:
            present = present & ~title.rlike(_u(pack.mixed_staff_title))
        reasons.append(F.when(present & only_firm, F.lit(reason)))
    return F.coalesce(*reasons) if reasons else F.lit(None).cast("string")


def foreign_language_required(body: Column, pack: RulePack) -> Column:
    def test(h: Column) -> Column:
        local_only = h["clause"].rlike(_u(pack.local_language)) & ~h["clause"].rlike(_u(pack.language_joint))
        return (~h["clause"].rlike(_u(pack.language_alternative)) & ~local_only
                & C.firm_in_segment(h, pack.words) & ~_optional_without_verb(h, pack))
    return _any_mention(body, pack.foreign_language, test)


def clearance_required(body: Column, pack: RulePack) -> Column:
    """Three detectors: set phrases, sentence patterns, and a stem judged by cue, hedge, law context or bullet."""
    w = pack.words

    def phrase(h: Column) -> Column:
        return ~_some_positions(h, pack) & C.firm_in_segment(h, w)

    def sentence(h: Column) -> Column:
        return ~h["before"].rlike(_u(pack.clearance_sentence_softener)) & ~F.left(
            h["text_after"], F.lit(NEGATED_AFTER)).rlike(_u(pack.clearance_sentence_negated))

    def bare_bullet(line: Column) -> Column:
        return (F.length(line) <= BULLET) & ~F.endswith(line, F.lit(":")) & line.rlike(_u(pack.clearance_bullet))

    def stem(h: Column) -> Column:
        clause = h["clause"]
        lead = F.right(F.left(h["text_before"], F.length(h["text_before"]) - F.length(h["before"])), F.lit(LAW_BEFORE))
        lawful = h["hit"].rlike(_u(pack.clearance_self_evident)) | F.concat(lead, clause).rlike(_u(pack.clearance_law))
        line = F.trim(F.concat(F.element_at(F.split(h["text_before"], "\n"), -1), h["hit"],
                               F.get(F.split(h["text_after"], "\n"), F.lit(0))))
        eligible = clause.rlike(_u(pack.clearance_eligible)) & (F.length(clause) <= ELIGIBLE)
        placed = (eligible | C.let(line, bare_bullet)) & F.coalesce(section_before(h, pack) != "opt", F.lit(True))
        return (lawful & ~_some_positions(h, pack) & ~clause.rlike(_u(pack.clearance_hedge))
                & ~h["after"].rlike(_u(pack.clearance_negated_after)) & (clause.rlike(_u(pack.clearance_cue)) | placed)
                & C.firm_in_segment(h, w))

    return (_any_mention(body, pack.clearance_phrases, phrase) | _any_mention(body, pack.clearance_sentences, sentence)
            | _any_mention(body, pack.clearance_stem, stem))


def citizenship_required(body: Column, pack: RulePack) -> Column:
    def firm(h: Column) -> Column:
        return C.firm_in_segment(h, pack.words)

    def bullet(h: Column) -> Column:
        return ~h["hit"].rlike(_u(pack.citizenship_bullet_soft)) & F.coalesce(section_before(h, pack) != "opt", F.lit(True))

    def union(h: Column) -> Column:
        return ~h["clause"].rlike(_u(pack.permit_alternative)) & C.firm_in_segment(h, pack.words)

    return (_any_mention(body, pack.citizenship, firm) | _any_mention(body, pack.citizenship_bullet, bullet)
            | _any_mention(body, pack.citizenship_union, union))


def passport_required(body: Column, pack: RulePack) -> Column:
    def test(h: Column) -> Column:
        return ~h["after"].rlike(_u(pack.passport_negated_after)) & C.firm_in_segment(h, pack.words)
    return _any_mention(body, pack.passport, test)


def certificate_required(title: Column, body: Column, pattern: str, pack: RulePack, training: str | None) -> Column:
    mention = unicode(pattern)
    cl = F.when(mentions(body, mention), C.clauses(body, pack.words)).otherwise(
        F.array().cast("array<struct<clause:string,section:string,near:boolean,line:string>>"))
    seen = mentions(body, mention) | mentions(title, mention)
    return F.when(seen, C.unmet_certificate(
        cl, title, mention, pack.words, unicode(training) if training else None)).otherwise(F.lit(False))


def block_reasons(pack: RulePack, title: Column, body: Column, rules: Sequence[str] | None = None) -> dict[str, Column]:
    """Rule id -> nullable reason, in the order of precedence; `rules` builds only some of them."""
    def why(cond: Column, reason: str) -> Column:
        return F.when(cond, F.lit(reason))

    def denied() -> Column:
        return F.col("_county_l").isin(*pack.denied_places) | F.col("_place_l").isin(*pack.denied_places)

    def far() -> Column:
        return (F.coalesce("county", F.lit("")) != "") & (F.upper(F.trim("county")) != pack.home_region) & (
            F.col("extent_percent") < pack.points.far_extent)

    def titles() -> Column:
        hits = [F.when(mentions(title, C.alt(patterns)), F.lit(reason)) for reason, patterns in pack.title_blocks]
        return F.coalesce(*hits) if hits else F.lit(None).cast("string")

    build = {
        "B1": lambda: why(denied(), pack.denied_reason),
        "B2": titles,
        "B3": lambda: why(far(), pack.far_reason),
        "B4": lambda: why(authorisation_required(body, pack), pack.authorisation_reason),
        "B5": lambda: regulated_reason(title, body, pack),
        "B6": lambda: why(foreign_language_required(body, pack), pack.language_reason),
        "B7": lambda: why(clearance_required(body, pack), pack.clearance_reason),
        "B8": lambda: why(citizenship_required(body, pack), pack.citizenship_reason),
        "B9": lambda: why(passport_required(body, pack), pack.passport_reason),
        "B10": lambda: why(certificate_required(title, body, pack.certificate, pack, pack.certificate_training),
                           pack.certificate_reason),
        "B11": lambda: why(certificate_required(title, body, pack.second_certificate, pack, None),
                           pack.second_certificate_reason),
    }
    return {r: b() for r, b in build.items() if rules is None or r in rules}


def _texts(df: DataFrame) -> DataFrame:
    # `_plain` is normalised already.
    return plain_text(df).withColumn("_body", F.lower("_plain"))


def with_blocks(df: DataFrame, pack: RulePack) -> DataFrame:
    """`excluded` and `exclusion_reason` by the first rule that hits; later rules are not evaluated."""
    reasons = block_reasons(pack, F.col("_title"), F.col("_body"))
    out = _texts(df).withColumn("exclusion_reason", F.coalesce(*reasons.values()))
    return out.withColumn("excluded", F.col("exclusion_reason").isNotNull()).drop("_body")


def rule_reasons(df: DataFrame, pack: RulePack, key: str = "uuid", rules: Sequence[str] | None = None) -> DataFrame:
    """The verdict of every rule (or of some) side by side: key, B1..B11."""
    reasons = block_reasons(pack, F.col("_title"), F.col("_body"), rules)
    return _texts(df).select(key, *[c.alias(r) for r, c in reasons.items()])
