"""Personal data becomes pseudonyms of the same format, in SQL functions alone.

Numbers that pass their check (card numbers by checksum, IBANs, social
security numbers by range, IPv4 addresses, telephone numbers by length) and real
calendar dates are permuted within their format by a keyed Feistel network
over two mixed-radix halves, so equal values stay equal in all documents, two
different values stay different, and a pseudonym passes the same check. Dates
with slashes are read day first, and month first only where that is no date;
a pseudonym must read back to the date it stands for, so those written month
first are permuted among themselves (by the same network, walked on until a day
beyond the twelfth comes up).
Mail addresses get a keyed name at a reserved domain. Numbers that fail their
check are no personal data and stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.common import documents
from brindle.llm.spans import between, let, matches

ROUNDS = 8
#: Steps of a walk at most; one in 10**25 would need more.
WALK = 64
#: Where the session has no key of its own (spark.brindle.pii.key): for tests only,
#: as anyone who knows a key can turn pseudonyms back.
KEY_SETTING, TEST_KEY = "spark.brindle.pii.key", "brindle test key, set your own"
#: Days of a whole Gregorian cycle, 1800-01-01 to 2199-12-31: 189 * 773.
DAYS_A, DAYS_B = 189, 773

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![A-Za-z0-9])"
#: Characters of an IBAN by country: the registry's, and those in use outside it.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST AO CV GW MZ", 26: "IS TR DZ IR", 27: "BI DJ FR GR IT MC MR SM BF CF CG CM GA GQ KM MG TD", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV BJ CI MA ML NE SN TG", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def iban_pattern() -> str:
    """An IBAN is as long as its country's are, so that it never takes in a
    word or number that follows; codes of no known length take what fits."""
    known = {c: n for n, codes in IBAN_LENGTHS.items() for c in codes.split()}
    tail = lambda n: f"(?:\\x20?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (f"\\x20?[A-Z0-9]{{{n % 4}}}" if n % 4 else "")
    by_length = [f"(?:{codes.replace(' ', '|')})[0-9]{{2}}{tail(n)}" for n, codes in IBAN_LENGTHS.items()]
    other = f"(?!{'|'.join(known)})[A-Z]{{2}}[0-9]{{2}}(?:\\x20?[A-Z0-9]{{4}}){{2,7}}(?:\\x20?[A-Z0-9]{{1,3}})?"
    return f"(?<![A-Za-z0-9])(?=[A-Z]{{2}}[0-9]{{2}})(?:{'|'.join([*by_length, other])})(?![A-Za-z0-9])"


IBAN = iban_pattern()
DATE = r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]|[./-][0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"
CARD = r"(?<![0-9])(?<![0-9][.-])(?:[0-9]{13,19}|[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{4}|[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}\x20[0-9]{4}|[0-9]{4}[\x20-][0-9]{6}[\x20-][0-9]{5})(?![0-9]|[.-][0-9])"
#: A digit of a telephone number and what may stand before it.
DIGIT = r"[\x20.()-]{0,3}[0-9]"
#: An international number has 8 to 15 digits, and ends before a date.
PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9]|[.-][0-9])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9])|(?<![0-9A-Za-z+])\+[0-9]{1,3}(?:(?!\x20(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9]))[\x20.-](?:\([0-9]{1,5}\)|[0-9]{1,5})){2,6}(?![0-9])" + f"(?<=\\+{DIGIT * 8}{f'(?:{DIGIT}' * 7}{')?' * 7}\\)?)"
#: What every kind holds; most texts don't, and are read no further.
HINT = "[@0-9]"
ANY = "|".join((EMAIL, IBAN, DATE, IPV4, SSN, CARD, PHONE))


def noise(key: str, tag: str, i: Column, x: Column) -> Column:
    """A keyed pseudorandom whole number below 2**60."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), i.cast("string"), x.cast("string")), 256), 1, 15), 16, 10).cast("long")


def feistel(key: str, tag: str, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A keyed permutation of the pairs (left below a, right below b)."""

    def step(acc: Column, i: Column) -> Column:
        turn = i % 2 == 1
        l, r = acc["l"], acc["r"]
        return F.struct(F.when(turn, F.pmod(l + noise(key, tag, i, r), a)).otherwise(l).alias("l"), F.when(turn, r).otherwise(F.pmod(r + noise(key, tag, i, l), b)).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def ten_to(n: Column) -> Column:
    return F.rpad(F.lit("1"), n + 1, "0").cast("long")


def permute_digits(key: str, tag: str, digits: Column) -> Column:
    """A string of 2 to 30 digits as another of the same length."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        h = F.floor(n / 2).cast("int")
        pair = feistel(key, tag, F.substr(d, F.lit(1), h), F.substr(d, h + 1, n - h), ten_to(h), ten_to(n - h))
        return let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), h, "0"), F.lpad(p["r"].cast("string"), n - h, "0")))

    return let(digits, halves)


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its digits, in order, replaced by ``digits``."""

    def fill(d: Column) -> Column:
        step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(c.rlike("[0-9]"), F.substr(d, acc["k"] + 1, F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + F.when(c.rlike("[0-9]"), 1).otherwise(0)).alias("k"))
        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda acc: acc["out"])

    return let(digits, fill)


def luhn_sum(digits: Column) -> Column:
    """Checksum of a digit string, its last digit counted singly."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        return acc + F.when(i % 2 == 0, d).when(d < 5, d * 2).otherwise(d * 2 - 9)

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.length(digits) - 1, F.lit(0))), F.lit(0), add)


def new_card(key: str, value: Column) -> Column:
    digits = digits_of(value)
    body = permute_digits(key, "card", F.substr(digits, F.lit(1), F.length(digits) - 1))
    check = lambda x: F.pmod(F.lit(10) - luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")
    return refill(value, let(body, lambda x: F.concat(x, check(x))))


def mod97(letters_and_digits: Column) -> Column:
    """Remainder by 97, letters as 10 to 35."""

    def add(acc: Column, c: Column) -> Column:
        v = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(v < 10, (acc * 10 + v) % 97).otherwise((acc * 100 + v) % 97).cast("int")

    return F.aggregate(F.filter(F.split(letters_and_digits, ""), lambda c: c != ""), F.lit(0), add)


def iban_valid(value: Column) -> Column:
    v = F.replace(value, F.lit(" "), F.lit(""))
    return mod97(F.concat(F.substr(v, F.lit(5)), F.substr(v, F.lit(1), F.lit(4)))) == 1


def new_iban(key: str, value: Column) -> Column:
    """The account's digits permuted, letters kept, check digits worked out."""
    v = F.replace(value, F.lit(" "), F.lit(""))
    land, account = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5))
    body = let(account, lambda a: F.when(F.length(digits_of(a)) >= 2, refill(a, permute_digits(key, "iban", digits_of(a)))).otherwise(a))
    check = lambda x: F.lpad((F.lit(98) - mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0")

    def space(plain: Column) -> Column:
        step = lambda acc, c: F.struct(F.concat(acc["out"], F.when(c == " ", c).otherwise(F.substr(plain, acc["k"] + 1, F.lit(1)))).alias("out"), (acc["k"] + F.when(c == " ", 0).otherwise(1)).alias("k"))
        return F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("k")), step, lambda acc: acc["out"])

    return let(let(body, lambda x: F.concat(land, check(x), x)), space)


def octets(value: Column) -> Column:
    return F.transform(F.split(value, r"\."), lambda x: x.cast("int"))


def ip_valid(value: Column) -> Column:
    return F.forall(octets(value), lambda x: x <= 255)


def new_ip(key: str, value: Column) -> Column:
    pair = let(octets(value), lambda o: feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536)))
    return let(pair, lambda p: F.concat_ws(".", *[x.cast("string") for h in ("l", "r") for x in (F.call_function("div", p[h], F.lit(256)), p[h] % 256)]))


def ssn_valid(value: Column) -> Column:
    return ~value.rlike("^(?:000|666|9)") & ~value.rlike("-00-") & ~value.rlike("-0000$")


def new_ssn(key: str, value: Column) -> Column:
    """Areas 001 to 899 without 666, groups 01 to 99, serials 0001 to 9999."""
    part = F.split(value, "-")
    area, group, serial = (part[i].cast("int") for i in range(3))
    left = area - F.when(area > 666, 2).otherwise(1)
    pair = feistel(key, "ssn", left, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999))
    pad = lambda x, n: F.lpad(x.cast("string"), n, "0")
    return let(pair, lambda p: F.concat_ws("-", pad(p["l"] + F.when(p["l"] >= 665, 2).otherwise(1), 3), pad(F.call_function("div", p["r"], F.lit(9999)) + 1, 2), pad(p["r"] % 9999 + 1, 4)))


def as_date(value: Column) -> tuple[Column, Column]:
    """(the date or null, its Spark format); day before month unless only the
    other reading is a date."""
    tries = [(r"^[0-9]{4}-", "yyyy-MM-dd"), (r"^[0-9]{2}/", "dd/MM/yyyy"), (r"^[0-9]{2}/", "MM/dd/yyyy"), (r"^[0-9]{2}\.", "dd.MM.yyyy")]
    made = [F.when(value.rlike(p), F.try_to_timestamp(value, F.lit(f)).cast("date")) for p, f in tries]
    kind = F.coalesce(*[F.when(d.isNotNull(), F.lit(f)) for d, (_, f) in zip(made, tries, strict=True)])
    return F.coalesce(*made), kind


def date_valid(value: Column) -> Column:
    d, _ = as_date(value)
    return F.coalesce(d.between(F.lit("1800-01-01").cast("date"), F.lit("2199-12-31").cast("date")), F.lit(False))


def new_date(key: str, value: Column) -> Column:
    first = F.lit("1800-01-01").cast("date")
    d, kind = as_date(value)

    def on(n: Column) -> Column:
        pair = let(n, lambda x: feistel(key, "date", F.floor(x / DAYS_B), x % DAYS_B, F.lit(DAYS_A), F.lit(DAYS_B)))
        return let(pair, lambda p: (p["l"] * DAYS_B + p["r"]).cast("int"))

    day = lambda n: F.date_add(first, n)
    steps = F.sequence(F.lit(1), F.when(kind == "MM/dd/yyyy", F.lit(WALK)).otherwise(F.lit(1)))
    walked = lambda n: F.aggregate(steps, n, lambda x, _: F.when((kind == "MM/dd/yyyy") & (F.dayofmonth(day(x)) <= 12), on(x)).otherwise(x))

    def written_as(new: Column) -> Column:
        y, m, day = F.lpad(F.year(new).cast("string"), 4, "0"), F.lpad(F.month(new).cast("string"), 2, "0"), F.lpad(F.dayofmonth(new).cast("string"), 2, "0")
        return F.when(kind == "yyyy-MM-dd", F.concat_ws("-", y, m, day)).when(kind == "dd/MM/yyyy", F.concat_ws("/", day, m, y)).when(kind == "MM/dd/yyyy", F.concat_ws("/", m, day, y)).otherwise(F.concat_ws(".", day, m, y))

    return let(day(let(on(F.datediff(d, first)), walked)), written_as)


def new_phone(key: str, value: Column) -> Column:
    """A country's code that is set off stays, all other digits are permuted;
    without one the last ten are (all but three of a shorter number)."""
    digits = digits_of(value)
    n = F.length(digits)
    code = F.length(F.regexp_extract(value, r"^\+([0-9]{1,3})(?=[\x20.(-])", 1))
    lead = F.when(code > 0, code).when(n >= 10, n - 10).otherwise(F.lit(3)).cast("int")
    return refill(value, F.concat(F.substr(digits, F.lit(1), lead), permute_digits(key, "phone", F.substr(digits, lead + 1, n - lead))))


def new_email(key: str, value: Column) -> Column:
    return F.concat(F.lit("person-"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("mail"), F.lower(value)), 256), 1, 16), F.lit("@example.invalid"))


def whole(pattern: str) -> str:
    return f"^(?:{pattern})$"


def pseudonym(key: str, m: Column) -> Column:
    """(kind, replacement) of one match; kind is null where a check fails."""
    made = [
        ("email", m.rlike(whole(EMAIL)), lambda: new_email(key, m)),
        ("iban", m.rlike(whole(IBAN)) & iban_valid(m), lambda: new_iban(key, m)),
        ("date", m.rlike(whole(DATE)) & date_valid(m), lambda: new_date(key, m)),
        ("ipv4", m.rlike(whole(IPV4)) & ip_valid(m), lambda: new_ip(key, m)),
        ("ssn", m.rlike(whole(SSN)) & ssn_valid(m), lambda: new_ssn(key, m)),
        ("card", m.rlike(whole(CARD)) & (luhn_sum(digits_of(m)) % 10 == 0), lambda: new_card(key, m)),
        ("phone", m.rlike(whole(PHONE)) & F.length(digits_of(m)).between(8, 15), lambda: new_phone(key, m)),
    ]
    out = F.struct(F.lit(None).cast("string").alias("kind"), m.alias("value"))
    for kind, fits, new in reversed(made):
        out = F.when(fits, F.struct(F.lit(kind).alias("kind"), new().alias("value"))).otherwise(out)
    return out


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, None) or TEST_KEY


def replace_personal(docs: DataFrame, key: str) -> DataFrame:
    """All columns of docs in their order, with pseudonyms in ``text``, and
    ``pii``: an array of the kinds replaced, in order.

    A null text stays null, an empty one empty, neither with kinds. Whole texts
    are read; texts without a match aren't taken apart. Repeated rows change
    alike; an empty table gives no rows; a column named pii is replaced.
    """
    t = F.col("__text")
    keep = [c for c in docs.columns if c != "pii"]
    rows = docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(keep) if c != "text"], F.col("text").cast("string").alias("__text"))
    none = F.expr("CAST(array() AS array<struct<kind:string,value:string>>)")
    rows = rows.withColumn("__hits", F.when(t.rlike(HINT) & t.rlike(ANY), F.transform(matches(t, ANY), lambda m: pseudonym(key, m))).otherwise(none))
    hits = F.col("__hits")
    pieces = F.zip_with(between(t, ANY), F.transform(hits, lambda h: h["value"]), lambda g, v: F.concat(g, F.coalesce(v, F.lit(""))))
    rows = rows.withColumn("__new", F.when(F.size(hits) > 0, F.array_join(pieces, "")).otherwise(t))
    kinds = F.filter(F.transform(hits, lambda h: h["kind"]), lambda k: k.isNotNull())
    return rows.select(*[(F.col("__new") if c == "text" else F.col(f"_{i}")).alias(c) for i, c in enumerate(keep)], kinds.alias("pii"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = replace_personal(documents(spark, sf_dir), session_key(spark))
    return rows.select("doc_id", "text", F.size("pii").cast("long").alias("n_replaced"), F.array_join("pii", ",").alias("kinds"))
