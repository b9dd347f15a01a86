"""Card and account numbers in running text against an independent finder: all valid substrings that begin and end at separators."""

import datetime
import re

import numpy as np
import pytest

from corvane.llm import pii


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))


def valid_card(s):
    digits = re.sub("[ -]", "", s)
    return re.fullmatch("[0-9](?:[ -]?[0-9])*", s) is not None and 13 <= len(digits) <= 19 and luhn(digits) % 10 == 0


def valid_account(s):
    bare = s.replace(" ", "")
    if not re.fullmatch("[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?", s):
        return False
    length = next((n for n, c in pii.IBAN_LENGTHS.items() if bare[:2] in c.split()), len(bare))
    return len(bare) == length and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


def plain(text):
    """From the left: at each place where a word begins, the longest valid substring that ends with a word."""
    edges = [i for i in range(len(text) + 1) if (i == 0 or not re.match("[A-Za-z0-9]", text[i - 1])) or (i == len(text) or not re.match("[A-Za-z0-9]", text[i]))]
    out, at = [], 0
    for a in edges:
        if a < at or a == len(text) or not re.match("[A-Za-z0-9]", text[a]):
            continue
        for b in sorted((b for b in edges if a + 12 <= b <= a + 50), reverse=True):
            kind = "card" if valid_card(text[a:b]) else "iban" if valid_account(text[a:b]) else None
            if kind:
                out.append((kind, a, b))
                at = b
                break
    return out


FOUND = [
    ("Order 2024 4111 1111 1111 1111 paid", ["4111 1111 1111 1111"]),
    ("pay 7 4111111111111111 now", ["4111111111111111"]),
    ("AB12 DE89 3704 0044 0532 0130 00", ["DE89 3704 0044 0532 0130 00"]),
    ("house 12 4111-1111-1111-1111", ["4111-1111-1111-1111"]),
    ("article 123456 4111 1111 1111 1111 98 and AB12 GB82 WEST 1234 5698 7654 32", ["4111 1111 1111 1111", "GB82 WEST 1234 5698 7654 32"]),
]


@pytest.fixture(scope="module")
def texts():
    """Numbers behind years, house numbers, article numbers and words that look like the beginning of an account."""
    draw = np.random.default_rng(31)
    out = [t for t, _ in FOUND]
    for _ in range(250):
        body = "".join(map(str, draw.integers(0, 10, 15)))
        card = body + str(-luhn(body + "0") % 10)
        shown = draw.choice([card, " ".join(card[i : i + 4] for i in range(0, 16, 4)), "-".join(card[i : i + 4] for i in range(0, 16, 4))])
        tail = "".join(map(str, draw.integers(0, 10, 18)))
        account = f"DE{98 - int(tail + '131400') % 97:02d}{tail}"
        shown_account = draw.choice([account, " ".join(account[i : i + 4] for i in range(0, 22, 4))])
        before = lambda: draw.choice(["", "2024 ", "7 ", "no. 12345 ", "AB12 ", "X1 ", "12 34 56 ", "word "])
        out.append(f"so {before()}{shown} and {before()}{shown_account}{draw.choice(['', ' 12', ' x', '.'])}")
    return out


@pytest.fixture(scope="module")
def done(spark, texts, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("finder"))
    pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").write.mode("overwrite").parquet(folder)
    return spark.read.parquet(folder)


def test_what_stands_before_a_number_does_not_hide_it(done):
    rows = {r["doc_id"]: r for r in done.collect()}
    for i, (text, wanted) in enumerate(FOUND):
        assert [text[s["start"] : s["end"]] for s in rows[i]["pii"]] == wanted, text
        assert not any(v in rows[i]["text"] for v in wanted)


def test_finding_is_that_of_all_valid_substrings(done, texts):
    for r in done.collect():
        text = texts[r["doc_id"]]
        assert [(s["kind"], s["start"], s["end"]) for s in r["pii"] if s["kind"] in ("card", "iban")] == plain(text), text


def test_values_come_back_from_their_places(spark, done, texts):
    assert all(r["text"] == texts[r["doc_id"]] for r in pii.restored(done, "k").collect())
    mixed = ["a 10.0.0.1 b 255.254.1.9, 2024 4111 1111 1111 1111; joe@x.org 31.12.1999 +1 415 555 2671 é 192.168.100.200", None, "", "none", "\U0001f642 7.7.7.7"]
    df = pii.pseudonymised(spark.createDataFrame(list(enumerate(mixed)), "doc_id long, text string"), "k")
    assert all(r["text"] == mixed[r["doc_id"]] for r in pii.restored(df, "k").collect())
    assert all(r["text"] != mixed[r["doc_id"]] for r in df.where("size(pii) > 0").collect())


def test_dates_of_other_years(spark):
    """They change among each other: every one within its format, equal ones alike, different ones to different ones."""
    draw = np.random.default_rng(8)
    days = [datetime.date(1, 1, 1), datetime.date(9999, 12, 31), datetime.date(1899, 12, 31), datetime.date(2100, 1, 1), *(datetime.date(1, 1, 1) + datetime.timedelta(int(n)) for n in draw.integers(0, 3_652_059, 200))]
    days = [d for d in days if not 1900 <= d.year <= 2099]
    shown = [f"{d.year:04d}-{d.month:02d}-{d.day:02d}" for d in days] + [f"{d.day:02d}.{d.month:02d}.{d.year:04d}" for d in days] + [f"{d.month:02d}/{d.day:02d}/{d.year:04d}" for d in days if d.day > 12]
    df = pii.pseudonymised(spark.createDataFrame([(i, f"on {x} so") for i, x in enumerate(shown)], "doc_id long, text string"), "k")
    new = {r["doc_id"]: r["text"][3:-3] for r in df.collect()}
    read = lambda s: next(datetime.datetime.strptime(s, f).date() for f in (["%Y-%m-%d"] if "-" in s else ["%d.%m.%Y"] if "." in s else ["%m/%d/%Y"]))
    same = {}
    for i, x in enumerate(shown):
        assert len(new[i]) == 10 and not 1900 <= read(new[i]).year <= 2099
        if "/" not in x:
            assert same.setdefault(read(x), read(new[i])) == read(new[i])
    assert len(set(same.values())) == len(same)
    back = pii.pseudonymised(df.drop("pii"), "k", back=True)
    assert {r["doc_id"]: r["text"][3:-3] for r in back.collect()} == dict(enumerate(shown))
