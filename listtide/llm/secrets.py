"""Secret scans: candidates by pattern, false positives removed by a random forest. Column expressions only.

A candidate is what stands behind a word such as `password` (with any ending, as in `SECRET_KEY` or `passwd_hash`) and an equals sign or
colon, the password of a connection string, a block of a private key, or a run of 16 and more key characters with a digit. Whether it is
a secret is the forest's to say. Its features are length, character classes and transitions, dictionary coverage, whether it looks like
part of a path or like a blank to fill in, and the words around it. The forest is trained from labelled findings and then written out as
a column expression, so that scoring and redaction are one narrow pass over the texts without an exchange."""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import held_out, share_of, table, written

#: Labelled findings that train, chosen by a hash of their value (about so many), documents that give findings of harmless things, and
#: words of the dictionary (counted over all documents).
SAMPLE_FINDINGS, SAMPLE_DOCS, DICTIONARY_WORDS = 1_000, 20_000, 400
TREES, DEPTH, THRESHOLD = 25, 5, 0.5
BEFORE, AFTER = 60, 40  # characters of context
MARK = "[SECRET]"

NAMES = "password|passwd|passphrase|passcode|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth[_-]?key|credential"
_RUN = "A-Za-z0-9_+/=.\\-"
_ENDING = r"(?:[_\-][A-Za-z0-9_\-]{0,40}|[A-Z0-9s][A-Za-z0-9]{0,20})?"
NAMED = rf"""(?i:{NAMES}){_ENDING}["']?\s{{0,3}}[:=]\s{{0,3}}["']?"""
CONNECTION = r"""://[^\s:/@"']{1,64}:"""
LEAD = rf"(?:{NAMED}|{CONNECTION})"
BLOCK = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[\s\S]{0,20000}?-----END [A-Z ]{0,30}PRIVATE KEY-----"
CANDIDATE = rf"""{BLOCK}|{CONNECTION}[^\s/@"']{{3,}}(?=@)|{NAMED}[^\s"']{{4,}}|(?<![{_RUN}])(?=[A-Za-z_+/=.\-]*+[0-9])[{_RUN}]{{16,}}+"""
HARMLESS = r"(?i)\b(example|sample|dummy|placeholder|test|fake|changeme|commit|sha1|sha256|md5|checksum|digest|uuid|version|isbn|doi)\b"
COMMON_PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|ou|io|le|ve|ch|ei|de|ie|ge|un|qu|el|la"

FEATURES = ("named", "length", "digits", "uppers", "lowers", "signs", "turns", "pairs", "distinct", "entropy", "covered", "path", "address",
            "harmless", "quoted", "hex", "prefix", "blank", "bearer")


def candidates(text: Column) -> Column:
    """Array of (value, lead, before, after) of all candidates of a text, in order; empty for null."""
    hits = F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), 1)
    parts = F.split(text, CANDIDATE, -1)
    found = F.transform(hits, lambda hit, i: F.struct(
        F.regexp_replace(hit, f"^{LEAD}", "").alias("value"),
        F.regexp_extract(hit, f"^({LEAD})", 1).alias("lead"),
        F.right(F.get(parts, i), F.lit(BEFORE)).alias("before"),
        F.left(F.get(parts, i + 1), F.lit(AFTER)).alias("after")))
    return F.when(text.rlike("[0-9:=-]"), found).otherwise(F.array().cast("array<struct<value:string,lead:string,before:string,after:string>>"))


def features(c: Column, dictionary: list[str]) -> Column:
    """Array of doubles, as FEATURES, of a candidate."""
    value = c["value"]
    size = F.greatest(F.length(value), F.lit(1)).cast("double")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / size
    letters = F.array_distinct(F.split(value, ""))
    entropy = F.aggregate(letters, F.lit(0.0), lambda total, x: total + F.when(x == "", 0.0).otherwise(
        F.transform(F.array((F.length(value) - F.length(F.replace(value, x, F.lit("")))) / size), lambda p: -p * F.log2(p))[0]))
    listed = F.array(*[F.lit(w) for w in dictionary]) if dictionary else F.array().cast("array<string>")
    covered = F.aggregate(F.split(F.lower(value), "[^a-z]+"), F.lit(0), lambda n, w: n + F.when(F.array_contains(listed, w), F.length(w)).otherwise(0)) / size
    yes = lambda test: F.when(test, 1.0).otherwise(0.0)
    return F.array(
        yes(F.length(c["lead"]) > 0), size, share("[0-9]"), share("[A-Z]"), share("[a-z]"), share("[^A-Za-z0-9]"),
        share("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])"), share(f"(?i)(?={COMMON_PAIRS})"),
        F.size(letters) / size, entropy, covered, yes(value.rlike(r"(^|[^+=])/[a-z]|\.[a-z]{2,5}$") | c["before"].rlike(r"(://|/|www\.)\S*$")),
        yes(c["after"].startswith("@") | c["before"].endswith("@") | value.rlike(r"^[0-9.+/:\-]+$")),
        yes(c["before"].rlike(HARMLESS) | value.rlike(HARMLESS)), yes(c["lead"].rlike("[\"']$") | c["before"].rlike("[\"']$")),
        yes(value.rlike("^([0-9a-f]{16,}|[0-9A-F]{16,})[^A-Za-z0-9]*$")),
        yes(value.rlike(r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|xox[abprs]-|sk_live_|eyJ[A-Za-z0-9_\-]{10,}\.|-----BEGIN)")),
        yes(value.rlike(r"^[*xX.]+$|^[<\[{$%].*[>\]}%]$|^\$")), yes(c["before"].rlike(r"(?i)(bearer|basic)\s+$") | c["lead"].startswith("://")))


def seed_findings(spark: SparkSession, start: int = 0, count: int = 50) -> DataFrame:
    """(value, lead, before, after, label): labelled findings of 30 shapes, `count` of each, made from digests of numbers.

    Secrets and harmless strings come with and without a name in front, so the name does not give the label away. Other numbers
    (`start`) give other findings of the same shapes, for measuring."""
    n = F.col("id")
    digest, wide = F.sha2(n.cast("string"), 256), F.base64(F.unhex(F.sha2(n.cast("string"), 256)))
    clean = F.regexp_replace(wide, "[+/=]", "")
    def pick(*some: str) -> Column:
        return F.element_at(F.array(*[F.lit(w) for w in some]), (n % len(some) + 1).cast("int"))

    def first(c: Column, size: int, at: int = 1) -> Column:
        return F.substr(c, F.lit(at), F.lit(size))

    word = pick("session", "invoice", "profile", "archive", "harbour", "winter", "report", "station")
    name = pick("token", "secret", "password", "api_key", "TOKEN", "access_key", "SECRET_KEY", "db_password_prod")
    open_, bare, colon, none = F.concat(name, F.lit(' = "')), F.concat(name, F.lit("=")), F.concat(name, F.lit(": ")), F.lit("")
    leet = F.translate(word, "aeio", "4310")
    secret = [
        (first(digest, 40), open_, none), (F.upper(first(digest, 40)), open_, none), (first(clean, 32), open_, none), (F.concat(first(clean, 10), F.lit("!7")), open_, none),
        (F.concat(first(clean, 7), n % 10), colon, none), (F.concat(first(word, 3), n % 900 + 100), bare, none), (F.concat(leet, pick("Pa55", "!9", "Q7x")), open_, none),
        (F.concat(F.upper(first(word, 1)), first(digest, 1, 3), n % 9, pick("!", "#", "?")), open_, none), (F.concat(word, F.lit("2"), first(clean, 3)), F.lit("://admin:"), none),
        (first(clean, 12), F.lit("://svc_user:"), none), (F.concat(F.lit("AKIA"), first(F.upper(clean), 16)), none, F.lit("key id ")),
        (F.concat(F.lit("ghp_"), first(clean, 36)), none, F.lit("use ")), (first(wide, 40), none, F.lit("Authorization: Bearer ")),
        (F.concat(F.lit("eyJ"), first(clean, 30), F.lit("."), first(digest, 20)), none, F.lit("sent ")),
        (F.concat(F.lit("-----BEGIN RSA PRIVATE KEY-----\n"), wide, F.lit("\n-----END RSA PRIVATE KEY-----")), none, none),
    ]
    harmless = [
        (F.concat(word, F.lit("_"), word, F.lit("_"), n, F.lit("_config")), none, F.lit("see ")),
        (F.concat(F.lit("docs/"), word, F.lit("/page"), n, F.lit(".html")), none, F.lit("https://host.example/")),
        (first(digest, 40), none, F.lit("commit ")), (first(digest, 32), none, F.lit("md5 checksum ")), (first(wide, 43), none, F.lit("integrity sha256 ")),
        (F.lpad(F.conv(first(digest, 13), 16, 10), 16, "7"), none, F.concat(F.lit("for "), word, F.lit(" "))),
        (F.concat_ws("-", first(digest, 8), first(digest, 4, 9), first(digest, 12, 13)), none, F.lit("uuid ")),
        (F.concat(F.lit("mail"), n, F.lit("@"), word, F.lit(".example.com")), none, F.lit("write to ")),
        (F.concat(F.lit("your-"), word, F.lit("-here")), open_, none), (F.concat(word, F.lit("."), word), colon, none),
        (F.concat(F.lit("example_"), word, n), open_, F.lit("for example ")), (pick("required", "optional", "string", "none", "maybe", "the", "must", "null"), colon, none),
        (F.concat(word, pick("", ",", ".", ";")), bare, none), (F.concat(F.lit("${"), F.upper(word), F.lit("}")), bare, none), (pick("********", "<token>", "xxxxxxxx", "{{value}}"), open_, none),
        (F.concat(n % 90 + 10, F.lit("000")), F.lit("tokens: "), none),
    ]
    base = spark.range(start, start + count)
    rows = [base.select(value.cast("string").alias("value"), before.alias("lead"), ahead.alias("before"),
                        F.when(before.startswith("://"), "@db.host/x").otherwise(" and so on").alias("after"), F.lit(label).alias("label"))
            for label, shapes in ((1, secret), (0, harmless)) for value, before, ahead in shapes]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def harmless_findings(docs: DataFrame) -> DataFrame:
    """Candidates of `docs` that their surroundings prove harmless, with label 0: numbers alone, and values that a word of harmless things
    introduces. No candidate is labelled a secret here: what marks one is left to the seeds, which hold names on both sides."""
    found = docs.where(~held_out(F.col("doc_id"))).select(F.explode(candidates(F.col("text"))).alias("c")).select("c.*").where("lead = ''")
    return found.where(F.col("value").rlike(r"^[0-9.\-]+\W*$") | F.col("before").rlike(HARMLESS + r"\W*$")).withColumn("label", F.lit(0))


def dictionary_of(docs: DataFrame, words: int = DICTIONARY_WORDS) -> list[str]:
    """The words of three and more letters that stand most often in all of `docs`; `words` of them reach the driver."""
    each = docs.select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where(F.length("w") >= 3)
    return [r[0] for r in each.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()]


class Forest:
    """A trained forest as a column expression."""

    def __init__(self, trees: list[list], dictionary: list[str]):
        self.trees, self.dictionary = trees, dictionary

    def score(self, c: Column) -> Column:
        """Share of trees that take a candidate for a secret."""
        votes = lambda f: sum((_vote(t, f) for t in self.trees), F.lit(0.0)) / len(self.trees)
        return F.transform(F.array(features(c, self.dictionary)), votes)[0]


def _vote(tree: list, f: Column) -> Column:
    if len(tree) == 1:
        return F.lit(tree[0])
    feature, split, left, right = tree
    return F.when(F.get(f, F.lit(feature)) <= split, _vote(left, f)).otherwise(_vote(right, f))


def read_trees(description: str) -> list[list]:
    """Trees from a fitted model's description: [class] for a leaf, else [feature, split, left, right]."""
    out = []
    for block in re.split(r"\n\s*Tree \d+[^\n]*\n", "\n" + description)[1:]:
        lines = [x.strip() for x in block.splitlines() if x.strip()]
        place = 0

        def node() -> list:
            nonlocal place
            line = lines[place]
            place += 1
            if line.startswith("Predict"):
                return [float(line.split(":")[1])]
            feature, split = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", line).groups()
            left = node()
            place += 1  # the line of the other branch
            return [int(feature), float(split), left, node()]

        out.append(node())
    return out


def fit(findings: DataFrame, dictionary: list[str]) -> Forest:
    """From labelled findings (value, lead, before, after, label 0 or 1)."""
    shape = F.struct("value", "lead", "before", "after")
    points = written(findings.select(features(shape, dictionary).alias("f"), F.col("label").cast("double").alias("label")), "secret_features")
    model = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, featureSubsetStrategy="sqrt").fit(
        points.select(array_to_vector("f").alias("features"), "label").coalesce(4))
    return Forest(read_trees(model.toDebugString), dictionary)


def train(docs: DataFrame) -> Forest:
    """From the seed findings, all of them, and about SAMPLE_FINDINGS harmless ones of about SAMPLE_DOCS documents; the dictionary covers
    all documents."""
    n = docs.count()
    some = written(docs.where(share_of(F.col("doc_id"), min(1.0, SAMPLE_DOCS / max(n, 1)))).select("doc_id", "text"), "secret_sample")
    plain = written(harmless_findings(some), "secret_harmless")
    share = min(1.0, SAMPLE_FINDINGS / max(plain.count(), 1))
    seeds = seed_findings(docs.sparkSession)
    return fit(written(seeds.unionByName(plain.where(share_of(F.col("value"), share))), "secret_findings"), dictionary_of(docs))


def scan(docs: DataFrame, forest: Forest) -> DataFrame:
    """All rows and columns of `docs` with `findings`: an array of (value, lead, before, after, score), candidates in text order.

    A null or empty text has none. A column `findings` is replaced; repeated rows stay."""
    scored = F.transform(F.col("_found"), lambda c: F.struct(c["value"].alias("value"), c["lead"].alias("lead"), c["before"].alias("before"), c["after"].alias("after"), forest.score(c).alias("score")))
    return docs.drop("findings").withColumn("_found", F.coalesce(candidates(F.col("text")), F.array())).withColumn("findings", scored).drop("_found")


def redact(docs: DataFrame, forest: Forest) -> DataFrame:
    """`docs` with the value of every finding from THRESHOLD on replaced by MARK; other text and columns stay."""
    found = scan(docs, forest)
    parts = F.split(F.col("text"), CANDIDATE, -1)
    kept = F.transform(F.col("findings"), lambda c: F.concat(c["lead"], F.when(c["score"] >= THRESHOLD, F.lit(MARK)).otherwise(c["value"])))
    text = F.array_join(F.flatten(F.zip_with(parts, F.concat(kept, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    some = F.exists("findings", lambda c: c["score"] >= THRESHOLD)
    return found.withColumn("text", F.when(some, text).otherwise(F.col("text"))).select(*docs.columns)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per candidate of each document: its number, what it is, the forest's score and verdict; values as digests."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, train(docs)).select("doc_id", F.posexplode("findings").alias("number", "c"))
    return found.select("doc_id", F.col("number").cast("long").alias("number"), F.length("c.value").cast("long").alias("length"),
                        F.lower(F.regexp_extract("c.lead", f"(?i)({NAMES})", 1)).alias("named"), F.sha2("c.value", 256).alias("value_sha256"),
                        F.col("c.score").alias("score"), (F.col("c.score") >= THRESHOLD).alias("is_secret"))
