"""Format-preserving pseudonyms for personal numbers and dates, with DataFrame functions only.

A value is recognised by one pattern, validated, and replaced by its image under a keyed
permutation of all values of its format: an alternating Feistel network on two halves with
moduli ``a`` and ``b`` whose product is exactly the number of valid values, so no value
needs a second walk and no image is invalid. Equal values get equal images in every
document, unequal values of a format unequal ones; separators stay in place.

==========  ==========================================  ==================================
kind        validated by                                permuted
==========  ==========================================  ==================================
card        13 to 19 digits together, or grouped        all digits but the last, which is
            4-4-4-4 or 4-6-5; Luhn sum                  the new check digit
iban        country, two check digits, up to 30 more    the digits after the check digits,
            characters; sum modulo 97                   which are made anew; letters stay
phone       3-3-4 digits, separators, country code 1    the ten digits
intl        plus, country code, 8 to 15 digits in all   digits after the first group, or
                                                        after two digits if there is none
ssn         3-2-4 digits, assignable area, group and    within the assignable numbers
            serial
ip          four octets up to 255, no leading zeros     the 32 bits
date        yyyy-mm-dd, mm/dd/yyyy or dd.mm.yyyy, a      within 1900-01-01 to 2099-12-31
            day of the calendar from 1900 to 2099
day first   dd/mm/yyyy, where the day is past the 12th  within such days: the permutation is
                                                        walked on until it meets one
email       local part, domain with a dot               the local part becomes a keyed
                                                        hash (no format to permute)
==========  ==========================================  ==================================

Numbers that don't validate stay as they are. The round function is SHA-256 over key,
kind, length, round and half; the key is given by the caller and shows in query plans, so it
should come from the cluster's secrets and plans should be kept as it is.

Edge cases: null text stays null, empty text empty; repeated rows are replaced alike; very
long texts are handled in place, there is no shuffle; where patterns could match at one place
the first of the table wins; an empty table gives no rows. Other columns pass through,
whatever their names; columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import fresh, let

#: Rounds of the network; even, so both halves change equally often. Steps of a walk at most:
#: each meets a day past the 12th with a chance of 0.6, so 80 miss one of 10^31 values.
ROUNDS, STEPS = 10, 80

EMAIL = r"(?<![\w.%+-])[\w.%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"
PHONE = r"(?<![\w+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)"
IP = r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\w]|\.\d)"
DATE = r"(?<![\w./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})(?![\w/-]|\.\d)"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w.-])(?:\d{13,19}|\d{4} \d{4} \d{4} \d{4}|\d{4}-\d{4}-\d{4}-\d{4}|\d{4} \d{6} \d{5}|\d{4}-\d{6}-\d{5})(?![\w-])"
INTL = r"(?<![\w+])\+(?:\d{8,15}|\d{1,3}(?:[ .-]\(?\d{1,8}\)?){1,6})(?!\w)"
IBAN = r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"
ANY = "|".join(f"(?:{p})" for p in (EMAIL, PHONE, INTL, IP, DATE, SSN, IBAN, CARD))


def round_value(key: str, kind: Column, i: Column, half: Column) -> Column:
    """60 bits of SHA-256 of key, kind, round and half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), kind, i.cast("string"), half.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def feistel(key: str, kind: Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """struct(left, right): the keyed image of (left, right) within a x b."""

    def step(s: Column, i: Column) -> Column:
        new_left = F.pmod(s["left"] + F.pmod(round_value(key, kind, i, s["right"]), a), a)
        new_right = F.pmod(s["right"] + F.pmod(round_value(key, kind, i, s["left"]), b), b)
        even = F.pmod(i, F.lit(2)) == 0
        return F.struct(F.when(even, new_left).otherwise(s["left"]).alias("left"), F.when(even, s["right"]).otherwise(new_right).alias("right"))

    start = F.struct(left.cast("long").alias("left"), right.cast("long").alias("right"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _power(n: Column) -> Column:
    return F.pow(F.lit(10.0), n).cast("long")


def digits_permuted(key: str, kind: str, digits: Column) -> Column:
    """A string of 2 to 18 digits, permuted among those of its length."""
    n = F.length(digits)
    u = F.floor(n / 2).cast("int")
    v = n - u
    name = F.concat(F.lit(kind), n.cast("string"))
    out = feistel(key, name, digits.substr(F.lit(1), u), digits.substr(u + 1, v), _power(u), _power(v))
    return let(out, lambda s: F.concat(F.lpad(s["left"].cast("string"), u, "0"), F.lpad(s["right"].cast("string"), v, "0")))


def luhn_sum(digits: Column, shift: int) -> Column:
    """Luhn's sum, where the last digit is doubled if ``shift`` is 1."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = digits.substr(n - i, F.lit(1)).cast("int")
        return total + F.when(F.pmod(i + shift, F.lit(2)) == 1, 2 * d - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add)


def refill(value: Column, digits: Column) -> Column:
    """``value`` with its last digits replaced by ``digits`` in order; the rest stays."""

    def fill(new: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            take = c.between("0", "9") & (s["left"] > 0)
            return F.struct(F.concat(F.when(take, new.substr(s["left"], F.lit(1))).otherwise(c), s["out"]).alias("out"), F.when(take, s["left"] - 1).otherwise(s["left"]).alias("left"))

        return F.aggregate(F.reverse(F.split(value, "")), F.struct(F.lit("").alias("out"), F.length(new).alias("left")), step, lambda s: s["out"])

    return let(digits, fill)


def card(key: str, m: Column) -> Column:
    def valid(d: Column) -> Column:
        body = digits_permuted(key, "card", d.substr(F.lit(1), F.length(d) - 1))
        full = let(body, lambda p: F.concat(p, F.pmod(10 - F.pmod(luhn_sum(p, 1), F.lit(10)), F.lit(10)).cast("string")))
        return F.when(F.pmod(luhn_sum(d, 0), F.lit(10)) == 0, refill(m, full)).otherwise(m)

    return let(F.regexp_replace(m, "[ -]", ""), valid)


def _modulo_97(text: Column) -> Column:
    """The number a text of digits and capitals (A is 10) stands for, modulo 97."""

    def step(n: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (n * 10 + F.ascii(c) - 48) % 97).otherwise((n * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def iban(key: str, m: Column) -> Column:
    def valid(plain: Column) -> Column:
        rest, country = plain.substr(F.lit(5), F.length(plain)), plain.substr(1, 2)

        def with_digits(d: Column) -> Column:
            new = F.when(F.length(d) > 1, refill(m.substr(F.lit(5), F.length(m)), digits_permuted(key, "iban", d))).otherwise(m.substr(F.lit(5), F.length(m)))
            check = lambda n: F.lpad((98 - _modulo_97(F.concat(F.regexp_replace(n, " ", ""), country, F.lit("00")))).cast("string"), 2, "0")
            return let(new, lambda n: F.concat(country, check(n), n))

        ok = (_modulo_97(F.concat(rest, plain.substr(1, 4))) == 1) & F.length(plain).between(15, 34)
        return F.when(ok, let(F.regexp_replace(rest, "[^0-9]", ""), with_digits)).otherwise(m)

    return let(F.regexp_replace(m, " ", ""), valid)


def international(key: str, m: Column) -> Column:
    def parts(d: Column) -> Column:
        first = F.regexp_extract(m, r"^\+(\d{1,3})[ .-]", 1)
        skipped = F.when(first == "", 2).otherwise(F.length(first))
        return F.when(F.length(d).between(8, 15), refill(m, digits_permuted(key, "intl", d.substr(skipped + 1, F.length(d))))).otherwise(m)

    return let(F.regexp_replace(m, "[^0-9]", ""), parts)


def phone(key: str, m: Column) -> Column:
    return refill(m, digits_permuted(key, "phone", F.right(F.regexp_replace(m, "[^0-9]", ""), F.lit(10))))


def ssn(key: str, m: Column) -> Column:
    area, group, serial = (m.substr(at, n).cast("int") for at, n in ((1, 3), (5, 2), (8, 4)))
    ok = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
    left = (area - 1 - (area > 666).cast("int")) * 99 + group - 1
    out = feistel(key, F.lit("ssn"), left, serial - 1, F.lit(898 * 99), F.lit(9999))

    def text(s: Column) -> Column:
        high = F.floor(s["left"] / 99).cast("int")
        return F.format_string("%03d-%02d-%04d", high + 1 + (high >= 665).cast("int"), F.pmod(s["left"], F.lit(99)) + 1, s["right"] + 1)

    return F.when(ok, let(out, text)).otherwise(m)


def ip(key: str, m: Column) -> Column:
    def octets(o: Column) -> Column:
        n = [F.element_at(o, i).cast("int") for i in (1, 2, 3, 4)]
        out = feistel(key, F.lit("ip"), n[0] * 256 + n[1], n[2] * 256 + n[3], F.lit(65536), F.lit(65536))
        return let(out, lambda s: F.concat_ws(".", *[x.cast("string") for h in (s["left"], s["right"]) for x in (F.floor(h / 256).cast("long"), F.pmod(h, F.lit(256)))]))

    return let(F.split(m, r"\."), octets)


def date(key: str, m: Column) -> Column:
    iso, slash = m.substr(5, 1) == "-", m.substr(3, 1) == "/"
    day_first = slash & (m.substr(1, 2) > "12")
    as_iso = F.when(iso, m).when(slash & ~day_first, F.concat_ws("-", m.substr(7, 4), m.substr(1, 2), m.substr(4, 2))).otherwise(F.concat_ws("-", m.substr(7, 4), m.substr(4, 2), m.substr(1, 2)))
    first, days = F.lit("1900-01-01").cast("date"), 17 * 4297  # all days of 1900 to 2099

    def image(at: Column) -> Column:
        out = feistel(key, F.lit("date"), F.floor(at / 4297), F.pmod(at, F.lit(4297)), F.lit(17), F.lit(4297))
        return let(out, lambda s: (s["left"] * 4297 + s["right"]).cast("int"))

    def of(at: Column) -> Column:
        return F.date_add(first, at)

    def walked(at: Column) -> Column:
        """The first image, of images of images, whose day is past the 12th."""
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), image(at), lambda x, _: F.when(F.dayofmonth(of(x)) > 12, x).otherwise(image(x)))

    def mapped(day: Column) -> Column:
        def inside(at: Column) -> Column:
            text = lambda x: F.when(iso, F.date_format(of(x), "yyyy-MM-dd")).when(day_first, F.date_format(of(x), "dd/MM/yyyy")).when(slash, F.date_format(of(x), "MM/dd/yyyy")).otherwise(F.date_format(of(x), "dd.MM.yyyy"))
            return F.when(at.between(0, days - 1), let(F.when(day_first, walked(at)).otherwise(image(at)), text)).otherwise(m)

        return let(F.datediff(day, first), inside)

    return let(as_iso.try_cast("date"), lambda d: F.when(d.isNull(), m).otherwise(mapped(d)))


def email(key: str, m: Column) -> Column:
    at = F.instr(m, "@")
    return F.concat(F.lit("u"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)), 256), 1, 12), m.substr(at, F.length(m)))


def pseudonym(key: str, m: Column) -> Column:
    """What stands for a match of ``ANY``; the match itself if it doesn't validate."""
    full = lambda p: m.rlike(rf"\A(?:{p})\z")
    return (
        F.when(F.instr(m, "@") > 0, email(key, m))
        .when(full(r"\d+\.\d+\.\d+\.\d+"), ip(key, m))
        .when(full(r"\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}"), date(key, m))
        .when(full(r"\d{3}-\d{2}-\d{4}"), ssn(key, m))
        .when(full(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}"), phone(key, m))
        .when(m.startswith("+"), international(key, m))
        .when(m.rlike("^[A-Z]"), iban(key, m))
        .otherwise(card(key, m))
    )


def pseudonymize(df: DataFrame, key: str, text_col: str = "text", count_col: str = "n_pii") -> DataFrame:
    """``df`` with its text's values replaced, and how many were."""
    text = F.col(text_col)

    def replaced(found: Column) -> Column:
        def joined(new: Column) -> Column:
            body = F.zip_with(F.split(text, ANY, -1), new, lambda gap, value: F.concat(gap, F.coalesce(value, F.lit(""))))
            changed = F.aggregate(F.zip_with(found, new, lambda a, b: (a != b).cast("long")), F.lit(0).cast("long"), lambda n, x: n + x)
            return F.struct(F.array_join(body, "").alias("text"), changed.alias("n"))

        return let(F.transform(found, lambda m: pseudonym(key, m)), joined)

    plain = F.struct(text.alias("text"), F.lit(0).cast("long").alias("n"))
    done = F.when(text.rlike(ANY), let(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), replaced)).otherwise(plain)
    pair = fresh(df, "__pii")
    held = df.withColumn(pair, F.when(text.rlike("[0-9@]"), done).otherwise(plain))
    return held.withColumn(text_col, F.col(f"{pair}.text")).withColumn(count_col, F.col(f"{pair}.n")).drop(pair)
