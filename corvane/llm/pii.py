"""Format-preserving pseudonyms for personal data, in column functions only.

Candidates are found by one expression, sorted by shape and validated: card numbers by their Luhn digit,
account numbers by their remainder, dates by the calendar, addresses by their octets, social numbers by
the ranges in use, telephone numbers by their digits. What is valid is permuted within its format by a
keyed Feistel network (check digits are made anew; values that leave the format are walked on until one
is in it), so equal values get equal pseudonyms in all documents, and the key gives the values back.

Defined results: null text stays null and has no findings; candidates that are not valid stay as they
are; separators, letters' case and lengths stay (octets of addresses may differ in length); positions
are code points of the original text; texts are treated whole; rows are independent; other columns
stay, columns of the result's names are replaced; an empty table gives no rows; dates with slashes are read
day first where that can be, else month first, and their pseudonyms are read and written in the same order;
dates of 1900 to 2099 change among each other, and so do those of all other years from 1 to 9999;
telephone numbers keep their country code; of a card or account number's candidate that is not valid as a
whole, the longest valid part from its start to a separator is taken; after a candidate without one, the
next that begins within it is tried, so digits or words right before a number do not hide it; account numbers
of known countries have their country's length. `restored` gives all values back from the recorded places.
`back=True` finds them anew: where digits stand right before or after a card number, its pseudonym may happen
to make a valid number with them, and is then not given back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Turns of a walk at most. A turn is made only while a value is outside its format, which at most four in ten are, and nine in ten
#: for cards: what is outside after all turns (a chance under 1e-45) has no place in practice.
WALK, CARD_WALK = 500, 1_000
FIRST_DAY, DAYS = "1900-01-01", 73_049  # to 2099-12-31
HALF_DAYS = 271
#: The days of all other years: those from FAR_DAY on before FIRST_DAY, and all of them, to 9999-12-31.
FAR_DAY, EARLY_DAYS, FAR_DAYS = "0001-01-01", 693_595, 3_579_010
HALF_FAR_DAYS = 1_893

#: Shapes by kind, in the order in which they are tried at a place.
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "phone": r"(?<![A-Za-z0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![A-Za-z0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){3,5}(?![0-9])",
    "card": r"(?<![A-Za-z0-9])[0-9](?:[ -]?[0-9]){12,18}(?![A-Za-z0-9])",
}
ANY = "|".join(SHAPES.values())
#: The places where a candidate begins, also within others, with the candidate as group 1.
BEGINS = f"(?=({ANY}))"
#: Kinds of which a part may be valid: the fewest characters of one, and the separators it may end at.
PARTS = {"iban": (12, " "), "card": (13, " -")}
#: Lengths of account numbers by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
# Country codes of telephone numbers, of one, two and (all others) three digits; none begins another.
COUNTRY_CODE = r"^(\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}))"
#: What every candidate holds: a quick first look.
HINT = r"[0-9@]"


def _round(key: str, tweak: str, i: Column, other: Column, modulus: Column) -> Column:
    """A keyed number below `modulus` from the round and the other half."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other.cast("string")), 256)
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), modulus)


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def feistel(a: Column, b: Column, first: Column, second: Column, key: str, tweak: str, back: bool = False) -> Column:
    """(a, b) permuted among the pairs with a < first and b < second: the halves change by turns."""
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, F.pmod(acc["a"] + sign * _round(key, tweak, i, acc["b"], first), first)).otherwise(acc["a"])
        right = F.when(even, acc["b"]).otherwise(F.pmod(acc["b"] + sign * _round(key, tweak, i, acc["a"], second), second))
        return F.struct(left.alias("a"), right.alias("b"))

    return F.aggregate(steps, F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), step)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def permuted_digits(digits: Column, key: str, tweak: str, back: bool = False) -> Column:
    """2 to 36 digits, permuted among the strings of as many; the halves are numbers of up to 18 digits."""
    half = F.floor(F.length(digits) / 2).cast("int")
    rest = F.length(digits) - half
    ten = lambda n: F.pow(F.lit(10.0), n).cast("long")
    pair = feistel(F.substring(digits, F.lit(1), half), F.substring(digits, half + 1, rest), ten(half), ten(rest), key, tweak, back)
    return _let(pair, lambda p: F.concat(F.lpad(p["a"].cast("string"), half, F.lit("0")), F.lpad(p["b"].cast("string"), rest, F.lit("0"))))


def refilled(shape: Column, digits: Column) -> Column:
    """`shape` with its digits replaced by `digits`, in order."""

    def step(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        out = F.concat(acc["out"], F.when(digit, F.substring(digits, acc["i"], 1)).otherwise(c))
        return F.struct((acc["i"] + digit.cast("int")).alias("i"), out.alias("out"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), step, lambda acc: acc["out"])


def _shifted(half: Column, other: Column, key: str, tweak: str, i: Column, sign: int) -> Column:
    """Letters and digits of `half` moved within their kind by a key stream from `other`."""
    stream = F.sha2(F.concat_ws("|", F.lit(key), F.lit(tweak), i.cast("string"), other), 256)

    def move(c: Column, j: Column) -> Column:
        by = F.conv(F.substring(stream, 2 * (j % 32) + 1, 2), 16, 10).cast("int") * sign
        out = c
        for low, high, n in (("0", "9", 10), ("a", "z", 26), ("A", "Z", 26)):
            out = F.when(c.between(low, high), F.char(F.pmod(F.ascii(c) - ord(low) + by, F.lit(n)) + ord(low))).otherwise(out)
        return out

    return F.when(half == "", half).otherwise(F.array_join(F.transform(F.split(half, ""), move), ""))


def permuted_text(text: Column, key: str, tweak: str, back: bool = False) -> Column:
    """Letters and digits permuted within their kinds: a Feistel network whose halves are strings."""
    half = F.floor(F.length(text) / 2).cast("int")
    steps = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    sign = -1 if back else 1

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        left = F.when(even, _shifted(acc["a"], acc["b"], key, tweak, i, sign)).otherwise(acc["a"])
        right = F.when(even, acc["b"]).otherwise(_shifted(acc["b"], acc["a"], key, tweak, i, sign))
        return F.struct(left.alias("a"), right.alias("b"))

    start = F.struct(F.substring(text, F.lit(1), half).alias("a"), F.substring(text, half + 1, F.length(text)).alias("b"))
    return F.aggregate(steps, start, step, lambda acc: F.concat(acc["a"], acc["b"]))


def walked(start: Column, turn, inside) -> Column:
    """`start` permuted once, and again until it is `inside`; the walk stays a permutation of what is inside."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), turn(start), lambda acc, _: F.when(inside(acc), acc).otherwise(turn(acc)))


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of `digits`, whose last is the check digit."""
    def value(c: Column, i: Column) -> Column:
        d = c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), value), F.lit(0), lambda s, d: s + d)


def other_sum(digits: Column) -> Column:
    """The last digit of the Luhn sum with the other digits doubled: what an odd number of further digits would find."""
    return luhn_sum(F.concat(digits, F.lit("0"))) % 10


def remainder_97(text: Column) -> Column:
    """Letters count as two digits from A = 10; the remainder of the number by 97."""
    def step(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + F.ascii(c) - 48) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _card(m: Column, key: str, back: bool) -> Column:
    """Walked on until `other_sum` is that of `m` too, so digits that follow make no longer number of the pseudonym than of `m`."""

    def turn(digits: Column) -> Column:
        inner = F.substring(digits, F.lit(2), F.length(digits) - 2)
        body = F.concat(F.substring(digits, 1, 1), permuted_digits(inner, key, "card", back))
        return _let(body, lambda x: F.concat(x, F.pmod(-luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")))

    def walk(given: Column) -> Column:
        state = lambda d, done: F.struct(d.alias("d"), done.alias("done"))
        step = lambda acc, _: F.when(acc["done"], acc).otherwise(_let(turn(acc["d"]), lambda d: state(d, other_sum(d) == given["sum"])))
        return F.aggregate(F.sequence(F.lit(1), F.lit(CARD_WALK)), state(given["d"], F.lit(False)), step, lambda acc: acc["d"])

    new = _let(_let(digits_of(m), lambda d: F.struct(d.alias("d"), other_sum(d).alias("sum"))), walk)
    return _let(new, lambda x: refilled(m, x))


def _iban(m: Column, key: str, back: bool) -> Column:
    bare = F.replace(m, F.lit(" "), F.lit(""))
    body = permuted_text(F.substring(bare, F.lit(5), F.length(bare)), key, "iban", back)
    new = _let(body, lambda x: F.concat(F.substring(bare, 1, 2), F.lpad((98 - remainder_97(F.concat(x, F.substring(bare, 1, 2), F.lit("00")))).cast("string"), 2, "0"), x))

    def fill(x: Column) -> Column:
        def step(acc: Column, c: Column) -> Column:
            own = c != " "
            return F.struct((acc["i"] + own.cast("int")).alias("i"), F.concat(acc["out"], F.when(own, F.substring(x, acc["i"], 1)).otherwise(c)).alias("out"))

        return F.aggregate(F.split(m, ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("out")), step, lambda acc: acc["out"])

    return _let(new, fill)


def _ip(m: Column, key: str, back: bool) -> Column:
    octets = F.split(m, r"\.")
    of = lambda i: F.get(octets, F.lit(i)).cast("int")
    whole = F.lit(65_536).cast("long")
    pair = feistel(of(0) * 256 + of(1), of(2) * 256 + of(3), whole, whole, key, "ip", back)
    parts = lambda x: [F.shiftright(x, 8).cast("string"), x.bitwiseAND(F.lit(255).cast("long")).cast("string")]
    return _let(pair, lambda p: F.concat_ws(".", *parts(p["a"]), *parts(p["b"])))


def _day(m: Column) -> Column:
    """The date a match stands for; days come first where slashes leave the choice; null if there is none."""
    return F.coalesce(*(F.when(F.regexp_like(m, F.lit(p)), F.try_to_date(m, f)) for p, f in ((r"^\d{4}-", "yyyy-MM-dd"), (r"\.", "dd.MM.yyyy"), ("/", "dd/MM/yyyy"), ("/", "MM/dd/yyyy"))))


def _date(m: Column, key: str, back: bool) -> Column:
    base, far = F.lit(FIRST_DAY).cast("date"), F.lit(FAR_DAY).cast("date")
    # Month first is how dates are read whose day is over 12: these change among each other.
    month_first = F.contains(m, F.lit("/")) & F.try_to_date(m, "dd/MM/yyyy").isNull()

    def moved(n: Column, days: int, half: int, tweak: str, date_of) -> Column:
        """Day number `n` of `days` walked to another; a network has `half` times (half less one) places."""
        first, second = F.lit(half).cast("long"), F.lit(half - 1).cast("long")

        def turn(n: Column) -> Column:
            pair = feistel(F.floor(n / (half - 1)), n % (half - 1), first, second, key, tweak, back)
            return _let(pair, lambda p: p["a"] * (half - 1) + p["b"])

        inside = lambda s: (s["n"] < days) & (~s["own"] | (F.dayofmonth(date_of(s["n"])) > 12))
        start = F.struct(n.cast("long").alias("n"), month_first.alias("own"))
        return date_of(walked(start, lambda s: F.struct(turn(s["n"]).cast("long").alias("n"), s["own"].alias("own")), inside)["n"])

    near_date = lambda n: F.date_add(base, n.cast("int"))
    far_date = lambda n: F.date_add(far, (n + F.when(n < EARLY_DAYS, 0).otherwise(DAYS)).cast("int"))
    far_day = lambda d: F.date_diff(d, far) - F.when(d < base, 0).otherwise(DAYS)
    near = _day(m).between(FIRST_DAY, "2099-12-31")
    new = F.when(near, moved(F.date_diff(_day(m), base), DAYS, HALF_DAYS, "date", near_date)).otherwise(moved(far_day(_day(m)), FAR_DAYS, HALF_FAR_DAYS, "far date", far_date))
    written = {"-": "yyyy-MM-dd", ".": "dd.MM.yyyy"}
    return _let(
        new,
        lambda d: F.when(F.contains(m, F.lit("-")), F.date_format(d, written["-"])).when(F.contains(m, F.lit(".")), F.date_format(d, written["."])).when(month_first, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "dd/MM/yyyy")),
    )


def _social(digits: Column) -> Column:
    return ~F.regexp_like(digits, F.lit("^(000|666|9)|^...00|0000$"))


def _ssn(m: Column, key: str, back: bool) -> Column:
    new = walked(digits_of(m), lambda d: permuted_digits(d, key, "ssn", back), _social)
    return _let(new, lambda x: refilled(m, x))


def _phone(m: Column, key: str, back: bool) -> Column:
    code = F.regexp_extract(m, COUNTRY_CODE, 1)
    rest = F.substring(m, F.length(code) + 1, F.length(m))
    return F.concat(code, _let(permuted_digits(digits_of(rest), key, "phone", back), lambda x: refilled(rest, x)))


def _email(m: Column, key: str, back: bool) -> Column:
    return F.concat(permuted_text(F.substring_index(m, "@", 1), key, "email", back), F.lit("@"), F.substring_index(m, "@", -1))


def _account(m: Column) -> Column:
    """Whether the length is the country's, where that is known, and the remainder 1."""
    def fits(x: Column) -> Column:
        wanted = F.lit(None).cast("int")
        for n, countries in IBAN_LENGTHS.items():
            wanted = F.when(F.substring(x, 1, 2).isin(countries.split()), n).otherwise(wanted)
        return F.coalesce(wanted == F.length(x), F.lit(True)) & (remainder_97(F.concat(F.substring(x, F.lit(5), F.length(x)), F.substring(x, 1, 4))) == 1)

    return _let(F.replace(m, F.lit(" "), F.lit("")), fits)


VALID = {
    "email": lambda m: F.lit(True),
    "iban": _account,
    "ip": lambda m: F.forall(F.split(m, r"\."), lambda o: o.cast("int") <= 255),
    "date": lambda m: F.coalesce(_day(m).between(FAR_DAY, "9999-12-31"), F.lit(False)),
    "ssn": lambda m: _social(digits_of(m)),
    "phone": lambda m: F.length(digits_of(m)).between(10, 15),
    "card": lambda m: luhn_sum(digits_of(m)) % 10 == 0,
}
PSEUDONYM = {"email": _email, "iban": _iban, "ip": _ip, "date": _date, "ssn": _ssn, "phone": _phone, "card": _card}


def _part(m: Column, kind: str) -> Column:
    """The length of the longest valid part of `m` from its start to a separator; null if there is none."""
    least, marks = PARTS[kind]
    own = lambda n: F.substring(m, F.lit(1), n)
    fits = lambda n: F.when(F.substring(m, n + 1, F.lit(1)).isin(*marks), F.when(F.regexp_like(own(n), F.lit(f"^(?:{SHAPES[kind]})$")), VALID[kind](own(n)))).otherwise(F.lit(False))
    ends = F.when(F.length(m) > least, F.sequence(F.length(m) - 1, F.lit(least), F.lit(-1)))
    return F.get(F.filter(ends, fits), F.lit(0))


def pseudonymised(df: DataFrame, key: str, text: str = "text", into: str = "pii", back: bool = False) -> DataFrame:
    """`df` with personal data in `text` replaced by pseudonyms (or, with `back`, pseudonyms by what they stand for), and column
    `into`: an array of kind, start and end of what was replaced, in code points of the given text."""
    whole = F.col(text)
    kind_of = F.lit(None).cast("string")
    for kind in reversed(SHAPES):
        kind_of_, shape = kind_of, SHAPES[kind]
        kind_of = (lambda k, s, other: lambda m: F.when(F.regexp_like(m, F.lit(f"^(?:{s})$")), F.when(VALID[k](m), F.lit(k))).otherwise(other(m) if callable(other) else other))(kind, shape, kind_of_)

    def named(m: Column) -> Column:
        """Kind and length of what counts of a candidate: all of it, else a part; no kind if neither."""
        whole_of = lambda k: F.struct(k.alias("kind"), F.length(m).alias("n"))
        out = whole_of(F.lit(None).cast("string"))
        for kind in reversed(PARTS):
            out = (lambda k, other: _let(_part(m, k), lambda n: F.when(n.isNotNull(), F.struct(F.lit(k).alias("kind"), n.alias("n"))).otherwise(other)))(kind, out)
        return _let(kind_of(m), lambda k: F.when(k.isNotNull(), whole_of(k)).otherwise(out))

    some = F.regexp_like(whole, F.lit(HINT)) & F.regexp_like(whole, F.lit(ANY))
    candidates = F.transform(F.regexp_extract_all(whole, F.lit(BEGINS), F.lit(1)), lambda m: _let(named(m), lambda x: F.struct(F.substring(m, F.lit(1), x["n"]).alias("m"), x["kind"].alias("kind"), x["n"].alias("n"))))
    # Pieces each begin with a candidate, but for the first where the text does not.
    work = df.withColumn("__found", F.when(some, candidates)).withColumn("__parts", F.when(some, F.split(whole, BEGINS, -1)))
    found, pieces = F.col("__found"), F.col("__parts")
    head = F.when(F.size(pieces) > F.size(found), F.get(pieces, F.lit(0))).otherwise(F.lit(""))
    own = F.slice(pieces, F.size(pieces) - F.size(found) + 1, F.size(found))

    def step(acc: Column, x: Column) -> Column:
        """Candidates count from the left; those that begin within a value before are left out. cut: characters of the piece that a value has taken."""
        at, f = acc["at"], x["found"]
        new = (at >= acc["taken"]) & f["kind"].isNotNull()
        taken = F.when(new, at + f["n"]).otherwise(acc["taken"])
        piece = F.struct(F.when(new, f["kind"]).alias("kind"), F.when(new, f["m"]).alias("m"), at.alias("start"), F.greatest(taken - at, F.lit(0)).alias("cut"), x["piece"].alias("piece"))
        return F.struct((at + F.length(x["piece"])).alias("at"), taken.alias("taken"), F.concat(acc["out"], F.array(piece)).alias("out"))

    none = F.array().cast("array<struct<kind:string,m:string,start:int,cut:int,piece:string>>")
    start = F.struct(F.length(head).alias("at"), F.lit(0).alias("taken"), none.alias("out"))
    work = work.withColumn("__read", F.aggregate(F.arrays_zip(found.alias("found"), own.alias("piece")), start, step, lambda acc: acc["out"]))

    def new(x: Column) -> Column:
        out = F.lit("")
        for kind in SHAPES:
            out = F.when(x["kind"] == kind, PSEUDONYM[kind](x["m"], key, back)).otherwise(out)
        return F.concat(out, F.substring(x["piece"], x["cut"] + 1, F.length(x["piece"])))

    text_out = F.concat(head, F.array_join(F.transform("__read", new), ""))
    span = lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), (x["start"] + F.length(x["m"])).alias("end"))
    spans = F.transform(F.filter("__read", lambda x: x["kind"].isNotNull()), span)
    empty = F.array().cast("array<struct<kind:string,start:int,end:int>>")
    done = work.withColumns({"__text": F.when(found.isNotNull(), text_out).otherwise(whole), into: F.when(found.isNotNull(), spans).otherwise(empty)})
    return done.withColumn(text, F.col("__text")).drop("__found", "__parts", "__read", "__text")


def restored(df: DataFrame, key: str, text: str = "text", spans: str = "pii") -> DataFrame:
    """`df`, made by `pseudonymised`, with the values that its places name put back into `text`, exactly; the places stay."""
    whole = F.col(text)

    def value(x: Column, start: Column) -> Column:
        """The pseudonym at `start`: as long as what it stands for, but for addresses."""
        return F.when(x["kind"] == "ip", F.regexp_extract(F.substring(whole, start + 1, F.lit(15)), r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}", 0)).otherwise(F.substring(whole, start + 1, x["end"] - x["start"]))

    def step(acc: Column, x: Column) -> Column:
        """at: where the text is read on; shift: by how much places in it are further than in the original."""

        def put(v: Column) -> Column:
            back = F.lit("")
            for kind in SHAPES:
                back = F.when(x["kind"] == kind, PSEUDONYM[kind](v, key, True)).otherwise(back)
            start = x["start"] + acc["shift"]
            out = F.concat(acc["out"], F.substring(whole, acc["at"] + 1, start - acc["at"]), back)
            return F.struct((start + F.length(v)).alias("at"), (acc["shift"] + F.length(v) - (x["end"] - x["start"])).alias("shift"), out.alias("out"))

        return _let(value(x, x["start"] + acc["shift"]), put)

    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("shift"), F.lit("").alias("out"))
    put_back = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return df.withColumn(text, F.when(F.size(spans) > 0, put_back).otherwise(whole))


def private_texts(documents: DataFrame, key: str) -> DataFrame:
    """Per document: doc_id, the text with pseudonyms, how many were put in, and their kinds and places in the original."""
    done = pseudonymised(documents.select("doc_id", "text"), key)
    places = F.array_join(F.transform("pii", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return done.select("doc_id", "text", F.size("pii").cast("long").alias("n_pii"), places.alias("spans"))
