import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from brindle.llm import pii


def luhn(s):
    d = [int(x) for x in re.sub(r"\D", "", s)][::-1]
    return (sum(d[0::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def run(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: (r.text, r.pii) for r in pii.replace_personal(df, "k").collect()}


def test_kinds_and_formats(spark):
    texts = [
        "card 4539 1488 0343 6467, again 4539148803436467 but 4539148803436468 is none", "+1 (555) 010-4477 and 555-010-4477.", "is.43@mail2.example.com from", "IP 192.168.7.44, not 999.1.1.1 nor 1.2.3",
        "born 1984-02-29, 31/12/1999 and 30.06.2001; not 1999-02-30 or 12/31/x", "ssn 123-45-6789 not 000-12-3456", "DE89 3704 0044 0532 0130 00 and DE00370400440532013000", "plain text 12 345 6", None, "",
        "+44 20 7946 0958, +33 1 23 45 67 89 and +12 3 4",
    ]
    got = run(spark, texts)
    card = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}), again (\d{16}) but 4539148803436468 is none", got[0][0])
    assert card and luhn(card[1]) and luhn(card[2]) and card[1].replace(" ", "") == card[2] != "4539148803436467"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4} and \d{3}-\d{3}-\d{4}\.", got[1][0]) and got[1][1] == ["phone", "phone"]
    a, b = re.findall(r"\d{3}\D+\d{3}-\d{4}", got[1][0])
    assert re.sub(r"\D", "", a) == re.sub(r"\D", "", b) != "5550104477"
    assert re.fullmatch(r"person-[0-9a-f]{16}@example\.invalid from", got[2][0])
    ip = re.fullmatch(r"IP ([\d.]+), not 999\.1\.1\.1 nor 1\.2\.3", got[3][0])
    assert ip and ip[1] != "192.168.7.44" and all(int(x) < 256 for x in ip[1].split("."))
    dates = re.fullmatch(r"born (\d{4}-\d\d-\d\d), (\d\d/\d\d/\d{4}) and (\d\d\.\d\d\.\d{4}); not 1999-02-30 or 12/31/x", got[4][0])
    assert dates and got[4][1] == ["date"] * 3
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} not 000-12-3456", got[5][0]) and got[5][1] == ["ssn"]
    iban = re.fullmatch(r"(DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d) and DE00370400440532013000", got[6][0])
    plain = iban[1].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1 and plain != "DE89370400440532013000"
    assert got[7] == ("plain text 12 345 6", []) and got[8] == (None, []) and got[9] == ("", [])
    assert re.fullmatch(r"\+44 \d\d \d{4} \d{4}, \+33 \d \d\d \d\d \d\d \d\d and \+12 3 4", got[10][0]) and "7946 0958" not in got[10][0] and got[10][1] == ["phone"] * 2


def test_numbers_followed_by_words_and_digits(spark):
    ibans = ["BE68 5390 0754 7034", "ES9121000418450200051332", "BE68539007547034", "AT611904300234573201", "PL61 1090 1014 0000 0712 1981 2874", "SE45 5000 0000 0583 9825 7466", "DE89 3704 0044 0532 0130 00", "NO93 8601 1117 947", "GB29NWBK60161331926819", "FR14 2004 1010 0505 0001 3M02 606", "MT84MALT011000012345MTLCAST001S"]
    phones = ["+44 20 7946 0958", "+49 89 1234 5678", "+33 1 23 45 67 89"]
    after = ["", " EUR", " BIC", " 2024", " A", " AB 12", " BANK", " 1984 0101", " EUR 100 2024 TOTAL"]
    texts = [f"to {x}{y}" for x in ibans for y in after]
    got = run(spark, texts)
    for i, t in enumerate(texts):
        x, y = ibans[i // len(after)], after[i % len(after)]
        new, kinds = got[i]
        assert kinds == ["iban"] and new.startswith("to ") and new.endswith(y) and len(new) == len(t), (t, new)
        plain = new[3 : 3 + len(x)].replace(" ", "")
        assert plain != x.replace(" ", "") and int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1
    followed = [f"call {p}{y}" for p in phones for y in (" 20240 1234 5678", " 2024-01-02", " 12345 67890", " 31/12/1999", " EUR", "")]
    for i, (new, kinds) in run(spark, followed).items():
        assert kinds and kinds[0] == "phone" and phones[i // 6] not in new, (followed[i], new)
        assert len(new) == len(followed[i]) and kinds == ["phone", "date"] if "-" in followed[i] or "/" in followed[i] else kinds == ["phone"], (followed[i], new)
    many = run(spark, ["BE68 5390 0754 7034 AT611904300234573201 ES9121000418450200051332 2024"])[0]
    assert many[1] == ["iban"] * 3 and many[0].endswith(" 2024")


def test_permutation_is_one_to_one(spark):
    n = 4000
    digits = spark.range(n).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("d")).where("length(d) = 4")
    assert digits.select(pii.permute_digits("k", "t", F.col("d")).alias("p")).distinct().count() == n
    pairs = spark.range(189 * 773).select(pii.feistel("k", "t", F.floor(F.col("id") / 773), F.col("id") % 773, F.lit(189), F.lit(773)).alias("p"))
    assert pairs.distinct().count() == 189 * 773
    ssn = spark.range(5000).select(F.concat_ws("-", F.lpad((F.col("id") % 898 + 1).cast("string"), 3, "0"), F.lit("07"), F.lpad((F.col("id") + 1).cast("string"), 4, "0")).alias("s")).where(pii.ssn_valid(F.col("s")))
    made = ssn.select(pii.new_ssn("k", F.col("s")).alias("s"))
    assert made.distinct().count() == ssn.count() and made.where(~pii.ssn_valid(F.col("s"))).count() == 0


def test_keys_differ_and_values_stay_linked(spark):
    df = spark.createDataFrame([(1, "a 1984-02-28 b"), (2, "1984-02-28")], "doc_id long, text string")
    one = [r.text for r in pii.replace_personal(df, "one").orderBy("doc_id").collect()]
    two = [r.text for r in pii.replace_personal(df, "two").orderBy("doc_id").collect()]
    assert one[0] == f"a {one[1]} b" and one != two


def noise(key, tag, i, x):
    return int(hashlib.sha256(f"{key}|{tag}|{i}|{x}".encode()).hexdigest()[:15], 16)


def feistel(key, tag, left, right, a, b):
    for i in range(1, pii.ROUNDS + 1):
        if i % 2:
            left = (left + noise(key, tag, i, right)) % a
        else:
            right = (right + noise(key, tag, i, left)) % b
    return left, right


def digits(key, tag, d):
    h = len(d) // 2
    left, right = feistel(key, tag, int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h))
    return f"{left:0{h}}{right:0{len(d) - h}}"


def new_date(key, d, month_first):
    n = (d - datetime.date(1800, 1, 1)).days
    while True:
        left, right = feistel(key, "date", *divmod(n, pii.DAYS_B), pii.DAYS_A, pii.DAYS_B)
        n = left * pii.DAYS_B + right
        made = datetime.date(1800, 1, 1) + datetime.timedelta(n)
        if not month_first or made.day > 12:
            return made


def test_against_a_plain_feistel_network(spark):
    """Pseudonyms of each kind, worked out independently."""
    rng = random.Random(6)
    texts, want = [], []
    for _ in range(60):
        body = "".join(rng.choices("0123456789", k=15))
        card = next(body + c for c in "0123456789" if luhn(body + c))
        new = digits("k", "card", body)
        texts.append(card)
        want.append(next(new + c for c in "0123456789" if luhn(new + c)))
        ip = [rng.randrange(256) for _ in range(4)]
        left, right = feistel("k", "ip", ip[0] * 256 + ip[1], ip[2] * 256 + ip[3], 65536, 65536)
        texts.append(".".join(map(str, ip)))
        want.append(".".join(map(str, (*divmod(left, 256), *divmod(right, 256)))))
        area, group, serial = rng.choice([1, 665, 667, 899, rng.randrange(1, 660)]), rng.randrange(1, 100), rng.randrange(1, 10_000)
        left, right = feistel("k", "ssn", area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999)
        texts.append(f"{area:03}-{group:02}-{serial:04}")
        want.append(f"{left + (2 if left >= 665 else 1):03}-{right // 9999 + 1:02}-{right % 9999 + 1:04}")
        d = datetime.date(1800, 1, 1) + datetime.timedelta(rng.randrange(146_097))
        for form, first in (("%Y-%m-%d", False), ("%d/%m/%Y", False), ("%d.%m.%Y", False), ("%m/%d/%Y", True)):
            if not first or d.day > 12:
                texts.append(d.strftime(form))
                want.append(new_date("k", d, first).strftime(form))
        account = "".join(rng.choices("0123456789", k=18))
        check = lambda a: f"{98 - int(''.join(str(int(c, 36)) for c in a + 'DE00')) % 97:02}"
        texts.append(f"DE{check(account)}{account}")
        account = digits("k", "iban", account)
        want.append(f"DE{check(account)}{account}")
    got = run(spark, texts)
    assert [got[i][0] for i in range(len(texts))] == want


def test_dates_with_slashes_stay_apart(spark):
    days = [datetime.date(1950, 1, 1) + datetime.timedelta(i) for i in range(29_220)]
    said = sorted({f for d in days for f in (d.strftime("%d/%m/%Y"), d.strftime("%m/%d/%Y"))})
    df = spark.createDataFrame([(x,) for x in said], "text string").repartition(8).select("text", pii.new_date("k", F.col("text")).alias("new"))
    made = df.collect()
    assert len({r.new for r in made}) == len(said)

    def read(x):
        a, b, y = map(int, x.split("/"))
        return datetime.date(y, b, a) if b <= 12 else datetime.date(y, a, b)

    assert len({read(r.new) for r in made}) >= len({read(r.text) for r in made}) and all(read(r.new) for r in made)


def test_long_numbers_change_in_front(spark):
    df = spark.createDataFrame([("7" * 30,), ("7" * 29 + "8",)], "d string")
    a, b = (r.p for r in df.select(pii.permute_digits("k", "t", F.col("d")).alias("p")).collect())
    assert a != b and a[:2] != "77" and len(a) == 30 and a == digits("k", "t", "7" * 30)


def test_key_comes_from_the_session(spark, sf):
    plain = {r.doc_id: r.text for r in pii.op5(spark, sf).collect()}
    spark.conf.set(pii.KEY_SETTING, "another")
    try:
        assert {r.doc_id: r.text for r in pii.op5(spark, sf).collect()} != plain
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def test_query(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = pii.op5(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        before, after = docs[r.doc_id], r.text
        private = re.findall(r"[\w.]+@[\w.]+\.com", before) + re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", before) + [x for x in re.findall(r"(?<!\d)\d{16}(?!\d)", before) if luhn(x)] + [x for x in re.findall(r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])", before) if all(int(o) < 256 for o in x.split("."))]
        assert not any(x in after for x in private)
        if not private and not r.n_replaced:
            assert before == after


def test_odd_rows(odd, none):
    out = pii.replace_personal(odd, "k")
    assert out.columns == [*odd.columns, "pii"] and out.count() == odd.count()
    assert pii.replace_personal(none, "k").collect() == []
