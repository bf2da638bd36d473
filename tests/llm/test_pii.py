"""Pseudonyms against a plain Python version, and what a permutation must keep."""

import datetime
import hashlib
import ipaddress
import re

import pandas as pd
import pytest

from tessera.llm import pii, queries

SF = "/root/testdata/sf0.001"


def brute_feistel(key, kind, left, right, a, b):
    for i in range(pii.ROUNDS):
        f = lambda half: int(hashlib.sha256(f"{key}|{kind}|{i}|{half}".encode()).hexdigest()[:15], 16)  # noqa: B023, E731
        if i % 2 == 0:
            left = (left + f(right)) % a
        else:
            right = (right + f(left)) % b
    return left, right


def luhn(d):
    return sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(map(int, reversed(d)))) % 10


def brute_digits(key, kind, d):
    u = len(d) // 2
    left, right = brute_feistel(key, f"{kind}{len(d)}", int(d[:u]), int(d[u:]), 10**u, 10 ** (len(d) - u))
    return f"{left:0{u}d}{right:0{len(d) - u}d}"


def refill(m, d):
    out, d = [], list(d)
    for c in reversed(m):
        out.append(d.pop() if c.isdigit() and d else c)
    return "".join(reversed(out))


KEY = queries.EXAMPLE_KEY


def modulo_97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def brute_value(m, key=KEY):
    if "@" in m:
        return "u" + hashlib.sha256(f"{key}|email|{m.lower()}".encode()).hexdigest()[:12] + m[m.index("@") :]
    if re.fullmatch(r"\d+\.\d+\.\d+\.\d+", m):
        o = list(map(int, m.split(".")))
        a, b = brute_feistel(key, "ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    for pattern, form in ((r"\d{4}-\d\d-\d\d", "%Y-%m-%d"), (r"(?:0\d|1[012])/\d\d/\d{4}", "%m/%d/%Y"), (r"\d\d/\d\d/\d{4}", "%d/%m/%Y"), (r"\d\d\.\d\d\.\d{4}", "%d.%m.%Y")):
        if re.fullmatch(pattern, m):
            try:
                at = (datetime.datetime.strptime(m, form).date() - datetime.date(1900, 1, 1)).days
            except ValueError:
                return m
            if not 0 <= at < 73049:
                return m
            while True:
                a, b = brute_feistel(key, "date", at // 4297, at % 4297, 17, 4297)
                at = a * 4297 + b
                new = datetime.date(1900, 1, 1) + datetime.timedelta(at)
                if form != "%d/%m/%Y" or new.day > 12:
                    return new.strftime(form)
    if re.fullmatch(r"\d{3}-\d{2}-\d{4}", m):
        area, group, serial = map(int, m.split("-"))
        if not (0 < area < 900 and area != 666 and group and serial):
            return m
        a, b = brute_feistel(key, "ssn", (area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999)
        high = a // 99
        return f"{high + 1 + (high >= 665):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    digits = re.sub(r"\D", "", m)
    if re.fullmatch(r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}", m):
        return refill(m, brute_digits(key, "phone", digits[-10:]))
    if m.startswith("+"):
        if not 8 <= len(digits) <= 15:
            return m
        first = re.match(r"\+(\d{1,3})[ .-]", m)
        return refill(m, brute_digits(key, "intl", digits[len(first[1]) if first else 2 :]))
    if m[0].isalpha():
        plain = m.replace(" ", "")
        if modulo_97(plain[4:] + plain[:4]) != 1 or not 15 <= len(plain) <= 34:
            return m
        d = re.sub(r"\D", "", plain[4:])
        rest = refill(m[4:], brute_digits(key, "iban", d)) if len(d) > 1 else m[4:]
        return f"{m[:2]}{98 - modulo_97(rest.replace(' ', '') + m[:2] + '00'):02d}{rest}"
    if luhn(digits):
        return m
    body = brute_digits(key, "card", digits[:-1])
    return refill(m, body + str((10 - luhn(body + "0")) % 10))


def brute(text):
    if text is None:
        return None, 0
    pattern = re.compile(pii.ANY, re.A)
    n = sum(brute_value(m[0]) != m[0] for m in pattern.finditer(text))
    return pattern.sub(lambda m: brute_value(m[0]), text), n


def test_query_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id")
    got = queries.op3_pii(spark, SF).toPandas()
    assert len(got) == len(docs) and got.n_pii.sum() > 0
    for r in got.itertuples():
        assert (r.text, r.n_pii) == brute(docs.text[r.doc_id])


VALUES = ["4111 1111 1111 1111", "4111-1111-1111-1111", "4111111111111111", "4111111111111112", "378282246310005", "6011000990139424", "+1 (017) 555-7713", "1-800-555-0199", "(212) 555-0100", "212.555.0100", "123-45-6789", "666-45-6789", "000-12-3456", "899-99-9999", "192.168.0.1", "255.255.255.255", "0.0.0.0", "256.1.1.1", "1.2.3.4.5", "01.2.3.4", "1984-02-29", "1983-02-29", "1899-12-31", "1900-01-01", "2099-12-31", "12/31/1999", "31/12/1999", "31.12.1999", "a.b+c@x-y.example.com", "A.B+C@x-y.example.com", "@nobody", "x@y", "version 3.0.1", "1234567890123456789012", "9" * 19, "25/12/2020", "31/01/1999", "32/01/1999", "13/13/2000", "+49 30 901820", "+44 20 7946 0958", "+4930901820", "+33 1 23", "+1 2", "+44 (20) 7946-0958", "DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606", "DE88 3704 0044 0532 0130 00", "4111111111111111 12/25", "order 12 4111111111111111", "3782 822463 10005", "4111 1111 1111 1111 123"]


def test_values_formats_and_odd_rows(spark):
    rows = [(i, v, i) for i, v in enumerate(VALUES)] + [(100, None, 0), (101, "", 0), (102, "é4111111111111111", 0), (103, " ".join(VALUES) * 2000, 0), (103, " ".join(VALUES) * 2000, 0), (None, "123-45-6789,123-45-6789", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_pii long")
    got = pii.pseudonymize(df, KEY)
    assert got.columns == ["doc_id", "text", "n_pii"]
    for r, (_, text, _) in zip(got.collect(), rows, strict=True):
        assert (r.text, r.n_pii) == brute(text), text and text[:60]
    assert pii.pseudonymize(df.where("false"), KEY).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan)


def test_images_are_valid_and_differ(spark):
    cards = [d + str((10 - luhn(d + "0")) % 10) for d in (f"4{i * 7919:014d}" for i in range(400))]
    dates = [(datetime.date(1970, 1, 1) + datetime.timedelta(37 * i)).isoformat() for i in range(400)]
    ssns = [f"{1 + i:03d}-{1 + i % 99:02d}-{1 + i:04d}" for i in range(600)]
    rows = [(v,) for v in cards + dates + ssns]
    got = [r.text for r in pii.pseudonymize(spark.createDataFrame(rows, "text string"), KEY).collect()]
    assert len(set(got)) == len(got)
    a, b, c = got[:400], got[400:800], got[800:]
    assert all(len(x) == 16 and luhn(x) == 0 for x in a)
    assert all("1900" <= datetime.date.fromisoformat(x).isoformat() < "2100" for x in b)
    assert all(re.fullmatch(r"(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}", x) for x in c)
    assert ipaddress.ip_address(pii_value(spark, "10.0.0.1"))


def pii_value(spark, value):
    return pii.pseudonymize(spark.createDataFrame([(value,)], "text string"), KEY).first().text


@pytest.mark.parametrize("key", ["a", "b"])
def test_the_key_matters(spark, key):
    got = pii.pseudonymize(spark.createDataFrame([("123-45-6789",)], "text string"), key=key).first().text
    assert got == brute_value("123-45-6789", key)


def test_new_formats_are_replaced_and_stay_valid(spark):
    days = [(datetime.date(1950, 1, 13) + datetime.timedelta(31 * i)) for i in range(900)]
    days = [d.strftime("%d/%m/%Y") for d in days if d.day > 12]
    ibans = ["DE89 3704 0044 0532 0130 00", "GB29NWBK60161331926819", "FR1420041010050500013M02606"]
    phones = ["+49 30 901820", "+44 20 7946 0958", "+4930901820"]
    got = [r.text for r in pii.pseudonymize(spark.createDataFrame([(v,) for v in days + ibans + phones], "text string"), KEY).collect()]
    assert len(set(got)) == len(got) and sum(a == b for a, b in zip(days + ibans + phones, got)) <= 1
    assert all(int(g[:2]) > 12 and datetime.datetime.strptime(g, "%d/%m/%Y") for g in got[: len(days)])
    for old, new in zip(ibans, got[len(days) :]):
        plain = new.replace(" ", "")
        assert modulo_97(plain[4:] + plain[:4]) == 1 and [c.isdigit() for c in old] == [c.isdigit() for c in new] and new[:2] == old[:2]
    assert got[-3].startswith("+49 ") and got[-2].startswith("+44 ") and got[-1].startswith("+49")


def test_columns_named_like_our_own(spark):
    df = spark.createDataFrame([("123-45-6789", "keep")], "text string, __pii string")
    got = pii.pseudonymize(df, KEY)
    assert got.columns == ["text", "__pii", "n_pii"] and got.first()["__pii"] == "keep" and got.first().n_pii == 1
