"""Pseudonyms against networks in plain Python."""

import datetime
import hashlib
import re

import numpy as np
import pytest

from corvane.llm import pii

KEY = "k1"


def number(tweak, i, other, modulus):
    return int(hashlib.sha256(f"{KEY}|{tweak}|{i}|{other}".encode()).hexdigest()[:15], 16) % modulus


def network(a, b, first, second, tweak):
    for i in range(pii.ROUNDS):
        if i % 2 == 0:
            a = (a + number(tweak, i, b, first)) % first
        else:
            b = (b + number(tweak, i, a, second)) % second
    return a, b


def digits(d, tweak):
    half = len(d) // 2
    rest = len(d) - half
    a, b = network(int(d[:half]), int(d[half:]), 10**half, 10**rest, tweak)
    return f"{a:0{half}d}{b:0{rest}d}"


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d)))


def refill(shape, d):
    left = iter(d)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def card(m):
    d = given = re.sub("[^0-9]", "", m)
    while True:
        body = d[0] + digits(d[1:-1], "card")
        d = body + str(-luhn(body + "0") % 10)
        if luhn(d + "0") % 10 == luhn(given + "0") % 10:
            return refill(m, d)


def social(m):
    d = re.sub("[^0-9]", "", m)
    while True:
        d = digits(d, "ssn")
        if not re.match("000|666|9|...00", d) and not d.endswith("0000"):
            return refill(m, d)


def day(m):
    orders = {"-": ["%Y-%m-%d"], ".": ["%d.%m.%Y"], "/": ["%d/%m/%Y", "%m/%d/%Y"]}[re.search("[-./]", m)[0]]
    for order in orders:
        try:
            d = datetime.datetime.strptime(m, order).date()
            break
        except ValueError:
            continue
    base = datetime.date(1900, 1, 1)
    n, side = (d - base).days, pii.HALF_DAYS - 1
    while True:
        a, b = network(n // side, n % side, side + 1, side, "date")
        n = a * side + b
        if n < pii.DAYS and (order != "%m/%d/%Y" or (base + datetime.timedelta(n)).day > 12):
            return (base + datetime.timedelta(n)).strftime(order)


def address(m):
    o = list(map(int, m.split(".")))
    a, b = network(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, "ip")
    return f"{a >> 8}.{a & 255}.{b >> 8}.{b & 255}"


def phone(m):
    code = re.match(r"\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})|", m)[0]
    return code + refill(m[len(code) :], digits(re.sub("[^0-9]", "", m[len(code) :]), "phone"))


@pytest.fixture(scope="module")
def values():
    draw = np.random.default_rng(21)
    out = []
    for _ in range(40):
        body = "4" + "".join(map(str, draw.integers(0, 10, 14)))
        out.append(("card", body + str(-luhn(body + "0") % 10), card))
        d = datetime.date(1900, 1, 1) + datetime.timedelta(int(draw.integers(0, 73049)))
        out += [("date", d.strftime(f), day) for f in ("%Y-%m-%d", "%d.%m.%Y", "%d/%m/%Y")]
        if d.day > 12:
            out.append(("date", d.strftime("%m/%d/%Y"), day))
        out.append(("ip", ".".join(map(str, draw.integers(0, 256, 4))), address))
        code = draw.choice(["+1", "+44", "+49", "+358", "+7", "+971"])
        out.append(("phone", f"{code} {draw.integers(100, 1000)} {draw.integers(100, 1000)} {draw.integers(1000, 10000)}", phone))
        out.append(("ssn", f"{draw.integers(1, 600):03d}-{draw.integers(1, 100):02d}-{draw.integers(1, 10000):04d}", social))
    return out


def test_pseudonyms_are_those_of_plain_networks(spark, values):
    df = spark.createDataFrame([(i, f"x {v} y") for i, (_, v, _) in enumerate(values)], "doc_id long, text string")
    done = pii.pseudonymised(df, KEY)
    for r in done.collect():
        kind, value, plain = values[r["doc_id"]]
        assert [s["kind"] for s in r["pii"]] == [kind], value
        assert r["text"] == f"x {plain(value)} y", value
    back = pii.pseudonymised(done.drop("pii"), KEY, back=True).collect()
    assert all(r["text"] == f"x {values[r['doc_id']][1]} y" for r in back)


def test_finding_is_that_of_a_plain_reading(spark, values):
    """Values among words, several a text: each is found where it was put, and no word is."""
    draw = np.random.default_rng(22)
    texts, wanted = [], []
    for i in range(60):
        text, own = "", []
        for j in draw.integers(0, len(values), 5):
            text += " ".join(draw.choice(["word", "and", "Número", "12", "v2", "\U0001f642"], 3)) + " so "
            own.append((values[j][0], len(text), len(text) + len(values[j][1])))
            text += values[j][1] + ", "
        texts.append((i, text))
        wanted.append(own)
    for r in pii.pseudonymised(spark.createDataFrame(texts, "doc_id long, text string"), KEY).collect():
        assert [tuple(s) for s in r["pii"]] == wanted[r["doc_id"]], texts[r["doc_id"]]
