"""Rule packs: the vocabulary and points of scoring and blocking, held as data."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clauses import ClauseWords
from ..functions.figures import FigureWords
from ..functions.keywords import hinted


@dataclass(frozen=True)
class Track:
    """Keyword track: points per hit (title hits count again) up to a cap."""

    words: Sequence[str]
    points: int
    cap: int
    boilerplate: str | None = None       # removed from the text before the words are looked up
    line_words: Sequence[str] = ()       # dropped when only weak words accompany them
    weak_words: Sequence[str] = ()
    alone_zero: Sequence[str] = ()       # nothing when no other word is found
    alone_zero_title: str | None = None  # ... unless the title holds this
    target_title: str | None = None      # counts as two title hits, once
    generic_title: str | None = None     # the same when no word is in the title
    generic_label: str = "generic"
    title_exempt: Sequence[str] = ()     # words that do not count again in the title


@dataclass(frozen=True)
class Points:
    """Points, caps and limits of the scoring components."""

    base: int = 10
    english: int = 10
    pair_tag: int = 8
    role_title: int = -40
    entry_level: int = 12
    senior_title: int = -15
    years: int = -10
    years_limit: int = 5
    management: int = -30
    remote: int = 15
    tier1: int = 15
    tier2: int = 10
    home_region: int = 7
    licence: int = -20
    degree: int = -10
    fluency: int = -20
    category_cap: int = 15
    category_title: int = -15
    channel: int = -10
    relocation: int = -40
    relocation_extent: int = 80
    formal: int = -35
    experience: int = -25
    gate_share: float = 0.75
    track_relevant: int = 16
    hits_relevant: int = 2
    far_extent: int = 60


@dataclass(frozen=True)
class RulePack:
    name: str
    words: ClauseWords
    track_a: Track
    track_b: Track
    track_c: Track
    home_region: str
    tier1_places: Sequence[str]
    tier2_regions: Sequence[str]
    tier2_places: Sequence[str]
    tier_places: Mapping[str, str]
    target_language: str = "en"
    figures: FigureWords = field(default_factory=FigureWords)
    pair_tag: tuple[str, str] = ("", "")
    role_titles: Sequence[str] = ()
    entry_phrases: Sequence[str] = ()
    entry_titles: Sequence[str] = ()
    senior_titles: Sequence[str] = ()
    senior_title_patterns: Sequence[str] = ()
    years_patterns: Sequence[str] = ()
    number_words: Mapping[str, int] = field(default_factory=dict)
    range_words: str = "-|–|—|to"
    years_ceiling: str = r"(?!)"
    years_boilerplate: str = r"(?!)"
    management_patterns: Sequence[str] = ()
    remote_words: Sequence[str] = ()
    remote_negations: Sequence[str] = ("not ", "never ", "without ")
    remote_title: str = "(online)"
    licence_words: Sequence[str] = ()
    degree_patterns: Sequence[str] = ()
    fluency_patterns: Sequence[str] = ()
    category_bonus: Mapping[str, int] = field(default_factory=dict)
    category_penalty: Mapping[str, int] = field(default_factory=dict)
    category_veto: str = ""
    category_title: str = r"(?!)"
    channel_phrases: Sequence[str] = ()
    temporary_prefixes: Sequence[str] = ()
    long_contract: str = r"(?!)"
    formal: str = r"(?!)"
    formal_own_field: str = r"(?!)"
    experience: str = r"(?!)"
    advisory_title: str = r"(?!)"
    professional_title: str = r"(?!)"
    points: Points = field(default_factory=Points)
    # hard blocks, checked in this order
    denied_places: Sequence[str] = ()
    denied_reason: str = "place on the deny list"
    title_blocks: Sequence[tuple[str, Sequence[str]]] = ()
    far_reason: str = "far from home and a low share of full time"
    some_positions: str = r"(?!)"
    authorisation: Sequence[str] = ()
    authorisation_generic: Sequence[str] = ()
    authorisation_context: str = r"(?!)"
    authorisation_access: str = "entry"
    alternative_before: str = r"(?!)"
    alternative_after: str = r"(?!)"
    alternative_later: str = r"(?!)"
    preference_before: str = r"(?!)"
    soft_around: str = r"(?!)"
    in_training: str = r"(?!)"
    authorisation_reason: str = "authorisation required"
    regulated: Sequence[tuple[str, str, bool]] = ()  # (pattern, reason, waived for a mixed-staff title)
    mixed_staff_title: str = r"(?!)"
    foreign_language: str = r"(?!)"
    language_alternative: str = r"(?!)"
    local_language: str = r"(?!)"
    language_joint: str = r"\band\b"
    language_reason: str = "foreign language required"
    clearance_phrases: str = r"(?!)"
    clearance_sentences: str = r"(?!)"
    clearance_sentence_softener: str = r"(?!)"
    clearance_sentence_negated: str = r"(?!)"
    clearance_stem: str = r"(?!)"
    clearance_self_evident: str = r"(?!)"
    clearance_law: str = r"(?!)"
    clearance_cue: str = r"(?!)"
    clearance_eligible: str = r"(?!)"
    clearance_hedge: str = r"(?!)"
    clearance_negated_after: str = r"(?!)"
    clearance_bullet: str = r"(?!)"
    clearance_reason: str = "security clearance required"
    citizenship: str = r"(?!)"
    citizenship_bullet: str = r"(?!)"
    citizenship_bullet_soft: str = r"(?!)"
    citizenship_union: str = r"(?!)"
    permit_alternative: str = r"(?!)"
    citizenship_reason: str = "citizenship required"
    passport: str = r"(?!)"
    passport_negated_after: str = r"(?!)"
    passport_reason: str = "foreign passport required"
    certificate: str = r"(?!)"
    certificate_training: str | None = None
    certificate_reason: str = "certificate required without training"
    second_certificate: str = r"(?!)"
    second_certificate_reason: str = "second certificate required"


MAX_PACK_ROWS = 5_000


def title_blocks_from(rules: DataFrame, pack: str) -> list[tuple[str, list[str]]]:
    """Title block categories from a rule table (pack, rule_id, scope, pattern, ord, reason). A rule table is
    configuration: its size is checked before it is read."""
    mine = rules.where((F.col("pack") == pack) & (F.col("scope") == "title")).select("ord", "reason", "pattern")
    rows = mine.limit(MAX_PACK_ROWS + 1).collect()
    if len(rows) > MAX_PACK_ROWS:
        raise ValueError(f"rule pack {pack!r} holds more than {MAX_PACK_ROWS} title rules")
    out: dict[tuple[int, str], list[str]] = {}
    for r in sorted(rows, key=lambda r: (r["ord"], r["pattern"])):
        out.setdefault((r["ord"], r["reason"]), []).append(r["pattern"])
    return [(reason, patterns) for (_, reason), patterns in sorted(out.items())]


def phrases(*texts: str) -> str:
    """A pattern for any of some plain phrases as whole words."""
    plain = not any(set(t) & set("\\.^$*+?{}[]|()") for t in texts)
    return hinted(r"\b(?:" + "|".join(texts) + r")\b", *texts if plain else ())


_NUMBERS = {w: i + 1 for i, w in enumerate("one two three four five six seven eight nine ten".split())}

# A demonstration pack for adverts of rooms in shared houses.
DEMO_WORDS = ClauseWords(
    required_headings=("house rules:?", "we expect:?"),
    optional_headings=("good to know:?", "around the house:?"),
    requirement_verbs=(phrases("must", "expected", "compulsory", "has to", "have to"),),
    softeners=(phrases("would be lovely", "optional", "not expected", "welcome but open"),),
    equivalences=(phrases("or the like"),),
    trailing_softeners=(", if possible.*$",),
    stated_negations=(phrases("no call for", "no rule about", "nothing like"),),
)

DEMO_PACK = RulePack(
    name="demo",
    words=DEMO_WORDS,
    track_a=Track(
        words=("piano", "rehearsal", "recording", "stage", "first floor", "second floor", "shared cellar", "guest nights"),
        points=8, cap=40, boilerplate=hinted(r"found through \w+ rooms with piano", "found through "),
        line_words=("first floor", "second floor"), weak_words=("shared cellar",),
        alone_zero=("guest nights",), alone_zero_title="nights included",
        target_title=r"\bmusic (?:room|studio)\b", generic_title=phrases("loft"), generic_label="loft",
    ),
    track_b=Track(words=("garden", "compost", "orchard", "greenhouse", "lawn", "beehive"), points=6, cap=30, title_exempt=("beehive",)),
    track_c=Track(words=("darkroom", "kiln", "loom", "sewing", "lathe", "easel"), points=3, cap=15),
    home_region="COAST",
    tier1_places=("HARBOUR", "FJORDVIEW"),
    tier2_regions=("CAPITAL",),
    tier2_places=("BRIDGETOWN",),
    tier_places={"PIER": "HARBOUR", "QUAY": "HARBOUR", "MOLE": "FJORDVIEW", "OLD BRIDGE": "BRIDGETOWN"},
    pair_tag=("Studio", "Sound"),
    role_titles=("bunk", "camp bed"),
    entry_phrases=("first home welcome", "no deposit"),
    entry_titles=("starter",),
    senior_titles=("grand", "landmark"),
    senior_title_patterns=(phrases("estate"),),
    years_patterns=(hinted(r"\d+\+? years of renting", " years of renting"), hinted(phrases(*_NUMBERS) + " years of renting", " years of renting"),
                    hinted("many years of renting", "many years of renting")),
    number_words=_NUMBERS,
    years_ceiling=r"\bno more than $",
    years_boilerplate=r"\bthis house has seen\b[^.;]*$",
    management_patterns=(phrases("caretaker duty"), phrases("look after tenants")),
    remote_words=("video viewing", "online viewing"),
    licence_words=("parking permit", "resident permit"),
    degree_patterns=(phrases("guarantor letter"), phrases("bank reference")),
    fluency_patterns=(phrases("italian spoken at home"),),
    category_bonus={"Plot": 10, "Barn": 8},
    category_penalty={"Office": -15, "Parking": -10},
    category_veto="Studio",
    category_title=phrases("storage unit", "office"),
    channel_phrases=("agency fee", "broker visits"),
    temporary_prefixes=("short let", "summer"),
    long_contract=phrases("for a full year", "for two years"),
    formal=phrases("tenancy certificate"),
    formal_own_field=phrases("in music"),
    experience=phrases("flat share background"),
    advisory_title=phrases("viewing"),
    professional_title=phrases("residence", "penthouse"),
    denied_places=("outpost", "far island"),
    title_blocks=(
        ("commercial let", (phrases("kiosk"),)), ("holiday let", (phrases("caravan"),)), ("student hall", (phrases("dormitory"),)),
        ("farm building", (phrases("stable"),)), ("boat", (phrases("houseboat"),)), ("garage", (phrases("garage"),)),
        ("land", (phrases("allotment"),)), ("institution", (phrases("barracks"),)), ("exchange", (phrases("house swap"),)),
        ("language house", (phrases("spanish-only"),)),
    ),
    some_positions=phrases("a few of our rooms"),
    authorisation=(phrases("approval by the landlord", "approved by the landlord"),),
    authorisation_generic=(phrases("approval is expected", "approval is compulsory"),),
    authorisation_context=phrases("housing association", "cooperative"),
    alternative_before=r"\bor else $",
    alternative_after=r"^ or else\b",
    alternative_later=phrases("or else"),
    preference_before=phrases("at best"),
    soft_around=phrases("optional", "open to all"),
    in_training=phrases("newcomers"),
    regulated=(
        (phrases("registered sublessor"), "regulated letting", False),
        (phrases("hold a lodging licence"), "lodging licence required", True),
    ),
    mixed_staff_title=phrases("annex"),
    foreign_language=phrases("speak greek at table", "speak welsh at table"),
    language_alternative=phrases("or", "optional"),
    local_language=phrases("english"),
    clearance_phrases=phrases("must be vetted by the board"),
    clearance_sentences=phrases("undergo a board vetting", "pass a board vetting"),
    clearance_sentence_softener=phrases("may", "in some cases"),
    clearance_sentence_negated=phrases("not expected"),
    clearance_stem=phrases("board vetting"),
    clearance_self_evident="^board",
    clearance_law=phrases("by statute"),
    clearance_cue=phrases("must", "expected"),
    clearance_eligible=phrases("can be vetted"),
    clearance_hedge=phrases("may", "perhaps"),
    clearance_negated_after=phrases("not"),
    clearance_bullet=r"^\W*board vetting",
    citizenship=phrases("must be a member of the village", "only village members"),
    citizenship_bullet=r"(?m)^\W*village member\W*$",
    citizenship_bullet_soft=phrases("not", "optional"),
    citizenship_union=phrases("must be a parish member"),
    permit_alternative=phrases("or"),
    passport=phrases("house passport"),
    passport_negated_after=phrases("is not asked for"),
    certificate=hinted("boiler licence", "boiler licence"),
    certificate_training=phrases("lessons are given"),
    second_certificate=hinted("chimney certificate", "chimney certificate"),
)
