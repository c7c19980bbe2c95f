"""Format-preserving pseudonyms of personal numbers, dates and addresses, as column expressions only.

What a pattern finds is validated (check digits, calendar, ranges) and then permuted within its format by a keyed Feistel network:
the same value gets the same pseudonym in every document, different values get different ones, and a valid card number, IBAN or date stays
valid. What fails validation stays as it is. One narrow pass over the texts, no exchange."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

KEY_SETTING, DEFAULT_KEY = "listtide.pseudonym_key", "set listtide.pseudonym_key"
ROUNDS = 8
#: Characters that one network permutes: two halves that each fit a long. Longer values go on block by block.
BLOCK = 26
#: Dates between these days; their number splits into two factors.
FIRST_DAY, LAST_DAY = "1900-01-01", "2100-01-31"
DAYS, DAY_FACTOR = 73080, 252  # 73080 = 252 * 290

#: Country calling codes; those not listed have three digits.
CALLING_CODE = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
_B, _E = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
PATTERNS = {
    "email": rf"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]++(?:\.[A-Za-z0-9\-]++)*\.[A-Za-z]{{2,}}+",
    "iban": rf"{_B}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_E}",
    "date": rf"{_B}(?:[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}\.[0-9]{{2}}\.[0-9]{{4}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}){_E}",
    "ip": rf"(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![A-Za-z0-9]|\.[0-9])",
    "ssn": rf"(?<![A-Za-z0-9\-])[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}(?![A-Za-z0-9]|-[0-9])",
    # Groups of ten digits, or those of any country behind a plus sign and within 18 characters.
    "phone": r"(?<![A-Za-z0-9+])(?:(?:\+[0-9]{1,3}[ .\-]?)?(?:\([0-9]{3}\)|[0-9]{3})[ .\-][0-9]{3}[ .\-][0-9]{4}" + _E +
             r"|\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .\-]?[0-9]{2,4}){1,5}(?<=\+[0-9() .\-]{8,18})" + _E + ")",
    "card": rf"{_B}[0-9](?:[ \-]?[0-9]){{12,18}}+{_E}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once."""
    return F.transform(F.array(value), use)[0]


def _noise(key: str, kind: str, tweak: Column, step: Column, half: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), tweak, step.cast("string"), half.cast("string")), 256)
    return F.conv(F.substr(digest, F.lit(1), F.lit(15)), 16, 10).cast("long")


def _network(left: Column, right: Column, n_left: Column, n_right: Column, key: str, kind: str, tweak: Column) -> Column:
    """struct(l, r): a keyed permutation of all pairs of l below n_left and r below n_right."""
    pair = lambda a, b: F.struct(a.alias("l"), b.alias("r"))
    step = lambda at, k: F.when(k % 2 == 0, pair((at["l"] + F.pmod(_noise(key, kind, tweak, k, at["r"]), n_left)) % n_left, at["r"])).otherwise(
        pair(at["l"], (at["r"] + F.pmod(_noise(key, kind, tweak, k, at["l"]), n_right)) % n_right))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(left.cast("long"), right.cast("long")), step)


_radix = lambda c: F.when(c.rlike("[0-9]"), 10).when(c.rlike("[A-Za-z]"), 26).otherwise(1).cast("long")
_first = lambda c: F.when(c.rlike("[0-9]"), 48).when(c.rlike("[A-Z]"), 65).when(c.rlike("[a-z]"), 97)


def _rank(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(0).cast("long"), lambda n, c: n * _radix(c) + F.when(_radix(c) > 1, F.ascii(c) - _first(c)).otherwise(0))


def _size(chars: Column) -> Column:
    return F.aggregate(chars, F.lit(1).cast("long"), lambda n, c: n * _radix(c))


def _unrank(chars: Column, n: Column) -> Column:
    """Characters of the same kinds as `chars` whose rank is n."""
    start = F.struct(n.alias("n"), F.lit("").alias("out"))
    step = lambda at, c: F.struct(
        F.call_function("div", at["n"], _radix(c)).alias("n"),
        F.concat(F.when(_radix(c) > 1, F.char(at["n"] % _radix(c) + _first(c))).otherwise(c), at["out"]).alias("out"))
    return F.aggregate(F.reverse(chars), start, step, lambda at: at["out"])


def _characters(value: Column) -> Column:
    return F.filter(F.split(value, ""), lambda c: c != "")


def permuted(value: Column, key: str, kind: str, tweak: Column | None = None) -> Column:
    """`value` with its ASCII digits and letters permuted: digits stay digits, letters keep their case, all else stays."""
    tweak = F.lit("") if tweak is None else tweak

    def block(text: Column, before: Column) -> Column:
        def both(chars: Column) -> Column:
            cut = F.floor((F.size(chars) + 1) / 2).cast("int")
            halves = F.struct(F.slice(chars, F.lit(1), cut).alias("a"), F.slice(chars, cut + 1, F.greatest(F.size(chars) - cut, F.lit(0))).alias("b"))
            return _bind(halves, lambda h: _bind(
                _network(_rank(h["a"]), _rank(h["b"]), _size(h["a"]), _size(h["b"]), key, kind, F.concat_ws("|", tweak, before, shape(text))),
                lambda n: F.concat(_unrank(h["a"], n["l"]), _unrank(h["b"], n["r"]))))

        return _bind(_characters(text), both)

    # Values of one shape are permuted among themselves; the shape, and the blocks before, are part of the tweak.
    shape = lambda text: F.regexp_replace(F.regexp_replace(F.regexp_replace(text, "[0-9]", "9"), "[A-Z]", "A"), "[a-z]", "a")
    count = F.greatest(F.ceil(F.length(value) / BLOCK), F.lit(1)).cast("int")
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: block(F.substr(value, i * BLOCK + 1, F.lit(BLOCK)), F.substr(value, F.lit(1), i * BLOCK)))
    return F.array_join(parts, "")


def _laid_out(value: Column, digits: Column) -> Column:
    """`value` with its digits and letters replaced in turn by the characters of `digits`."""
    start = F.struct(F.lit(0).alias("i"), F.lit("").alias("out"))
    step = lambda at, c: F.when(c.rlike("[A-Za-z0-9]"), F.struct((at["i"] + 1).alias("i"), F.concat(at["out"], F.substr(digits, at["i"] + 1, F.lit(1))).alias("out"))).otherwise(
        F.struct(at["i"].alias("i"), F.concat(at["out"], c).alias("out")))
    return F.aggregate(_characters(value), start, step, lambda at: at["out"])


def _luhn(digits: Column, doubled: int) -> Column:
    """Luhn sum; `doubled` is the place from the right, 0 or 1, from which every second digit counts double."""
    numbers = F.reverse(_characters(digits))
    return F.aggregate(F.transform(numbers, lambda c, i: F.when(i % 2 == doubled, F.get(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), c.cast("int"))).otherwise(c.cast("int"))),
                       F.lit(0), lambda a, b: a + b)


def _mod97(text: Column) -> Column:
    return F.aggregate(_characters(text), F.lit(0), lambda n, c: F.when(c.rlike("[0-9]"), (n * 10 + c.cast("int")) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _date_of(value: Column) -> Column:
    """The date that a value in one of four layouts stands for, slashes being MM/DD unless the first part exceeds 12; null if there is no such day or its year is out of range."""
    first, second, year = value.substr(1, 2), value.substr(4, 2), value.substr(7, 4)
    layout = F.when(value.contains("-"), value).when(value.contains(".") | (first > "12"), F.concat_ws("-", year, second, first)).otherwise(
        F.concat_ws("-", year, first, second))
    day = F.try_to_date(layout, "yyyy-MM-dd")
    return F.when(day.between(F.lit(FIRST_DAY).cast("date"), F.lit(LAST_DAY).cast("date")), day)


def pseudonym(value: Column, key: str) -> Column:
    """struct(kind, pseudonym) of a found value; null if it is not valid as what it looks like."""
    named = lambda kind, out: F.struct(F.lit(kind).alias("kind"), out.alias("pseudonym"))
    is_a = lambda kind: value.rlike(f"^(?:{PATTERNS[kind]})$")
    bare = F.regexp_replace(value, "[^A-Za-z0-9]", "")
    at = F.instr(value, "@")
    email = F.concat(permuted(F.substr(value, F.lit(1), at - 1), key, "email"), F.substr(value, at))

    payload = F.substr(bare, F.lit(5), F.length(bare) - 4)
    country = F.substr(bare, F.lit(1), F.lit(2))
    iban = _bind(permuted(payload, key, "iban", country), lambda p: _laid_out(value, F.concat(
        country, F.lpad((98 - _mod97(F.concat(p, country, F.lit("00")))).cast("string"), 2, "0"), p)))
    iban_valid = _mod97(F.concat(payload, F.substr(bare, F.lit(1), F.lit(4)))) == 1

    day = _date_of(value)
    number = F.date_diff(day, F.lit(FIRST_DAY).cast("date"))
    others = DAYS // DAY_FACTOR
    moved = _bind(_network(F.call_function("div", number, F.lit(others)), number % others, F.lit(DAY_FACTOR), F.lit(others), key, "date", F.lit("")),
                  lambda n: F.date_add(F.lit(FIRST_DAY).cast("date"), (n["l"] * others + n["r"]).cast("int")))
    date = F.when(value.contains("-"), F.date_format(moved, "yyyy-MM-dd")).when(value.contains("."), F.date_format(moved, "dd.MM.yyyy")).when(
        # DD/MM again where it can be read as such, so that no two dates are written alike.
        (value.substr(1, 2) > "12") & (F.dayofmonth(moved) > 12), F.date_format(moved, "dd/MM/yyyy")).otherwise(F.date_format(moved, "MM/dd/yyyy"))

    octets = F.transform(F.split(value, "\\."), lambda x: x.cast("long"))
    ip = _bind(octets, lambda o: _bind(_network(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, "ip", F.lit("")), lambda n: F.concat_ws(
        ".", *[x.cast("string") for x in (F.call_function("div", n["l"], F.lit(256)), n["l"] % 256, F.call_function("div", n["r"], F.lit(256)), n["r"] % 256)])))
    ip_valid = F.forall(octets, lambda x: x <= 255)

    # Areas 001 to 899 but 666; groups from 01, serials from 0001.
    area, rest = F.substr(bare, F.lit(1), F.lit(3)).cast("int"), F.substr(bare, F.lit(4), F.lit(6)).cast("int")
    group, serial = F.call_function("div", rest, F.lit(10000)), rest % 10000
    place = area - 1 - F.when(area > 666, 1).otherwise(0)
    ssn = _bind(_network(place, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn", F.lit("")), lambda n: F.concat_ws(
        "-", F.lpad((n["l"] + 1 + F.when(n["l"] >= 665, 1).otherwise(0)).cast("string"), 3, "0"),
        F.lpad((F.call_function("div", n["r"], F.lit(9999)) + 1).cast("string"), 2, "0"), F.lpad((n["r"] % 9999 + 1).cast("string"), 4, "0")))
    ssn_valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)

    # The bare digits behind the calling code are permuted, so that a number is linked however it is written.
    calling = F.when(value.startswith("+"), F.regexp_extract(bare, f"^(?:{CALLING_CODE})", 0)).otherwise("")
    national = F.substr(bare, F.length(calling) + 1)
    phone = _laid_out(value, F.concat(calling, permuted(national, key, "phone")))
    phone_valid = F.length(bare).between(8, 15) & (F.length(national) >= 6)

    lead = F.substr(bare, F.lit(1), F.length(bare) - 1)
    card = _bind(permuted(lead, key, "card"), lambda p: _laid_out(value, F.concat(p, F.pmod(-_luhn(p, 0), F.lit(10)).cast("string"))))
    number_valid = _luhn(bare, 1) % 10 == 0

    return (F.when(is_a("email"), named("email", email)).when(is_a("date"), F.when(day.isNotNull(), named("date", date)))
            .when(is_a("ip"), F.when(ip_valid, named("ip", ip))).when(is_a("ssn"), F.when(ssn_valid, named("ssn", ssn)))
            .when(is_a("iban"), F.when(iban_valid, named("iban", iban))).when(is_a("phone"), F.when(phone_valid, named("phone", phone)))
            .when(is_a("card"), F.when(number_valid, named("card", card))))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """All rows and columns of `docs` with its text rewritten and `pseudonyms`: an array of (kind, pseudonym) in text order.

    A null or empty text stays and has none; a column `pseudonyms` is replaced; repeated rows stay."""
    text = F.col("text")
    hits = F.transform(F.regexp_extract_all(text, F.lit(f"({ANY})"), 1), lambda m: F.struct(m.alias("value"), pseudonym(m, key).alias("new")))
    found = F.when(text.rlike("[0-9@]"), hits)
    parts = F.split(text, ANY, -1)
    frame = docs.drop("pseudonyms").withColumn("_hits", found)
    new = F.transform("_hits", lambda h: F.coalesce(h["new"]["pseudonym"], h["value"]))
    whole = F.array_join(F.flatten(F.zip_with(parts, F.concat(new, F.array(F.lit(""))), lambda a, b: F.array(a, b))), "")
    changed = F.exists("_hits", lambda h: h["new"].isNotNull())
    some = F.transform(F.filter("_hits", lambda h: h["new"].isNotNull()), lambda h: h["new"])
    return frame.withColumn("text", F.when(F.coalesce(changed, F.lit(False)), whole).otherwise(text)).withColumn(
        "pseudonyms", F.coalesce(some, F.array().cast("array<struct<kind:string,pseudonym:string>>"))).drop("_hits")


def op2_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold personal values: their rewritten texts and what kinds were found. All others stay as they are."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pseudonymise(docs, spark.conf.get(KEY_SETTING, DEFAULT_KEY)).where(F.size("pseudonyms") > 0)
    return found.select("doc_id", F.size("pseudonyms").cast("long").alias("n_pseudonyms"),
                        F.array_join(F.array_sort(F.array_distinct("pseudonyms.kind")), ",").alias("kinds"), "text")
