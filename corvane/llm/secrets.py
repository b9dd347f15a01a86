"""Secrets in texts, found through Boolean trigram queries over an inverted index of trigrams.

From each rule's expression a Boolean query over trigrams follows that every match fulfils. The index has
a posting (trigram, text) for each trigram of the rules' vocabulary that a text holds, read off all texts
in one pass and written, by trigram, to the shared folder. A query's posting lists are intersected there:
a text is a candidate of a rule where all trigrams of one of its sets have a posting of it. Candidates are
verified by the expression on the text itself; a rule whose expression has no trigram that must occur
scans all texts. An index serves any rules whose trigrams its vocabulary has, without another pass.

Postings name a text by a 64-bit digest. Equal texts have one entry; texts that share a digest share their
postings, which only makes candidates, never misses one. The candidates' table goes to all tasks while
it is small (CANDIDATE_ROWS, counted first) and is merged with the texts beyond that, the most frequent
texts apart.

Everything is built-in column functions. Defined results: null text counts as empty and has no spans;
positions are code points, the end exclusive; a match that fails its rule's length is dropped after it
has taken its place; texts are scanned whole, however long; rows are independent, so repeated rows have
equal results; other columns stay, columns of the result's names are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import groupby, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import FREQUENT, free_name, joined, written

#: Strings considered together when trigrams are derived, and characters of a class that are told apart.
MOST_STRINGS, MOST_CHARACTERS = 64, 8
#: Candidates (a digest and a number each) that are sent to all tasks.
CANDIDATE_ROWS = 4_000_000


@dataclass(frozen=True)
class Rule:
    """A kind of secret. least: characters that `group` must have; longer texts of a run are one match."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    any_case: bool = False


#: The rules of the base scan, in their order: runs below the length never hold a match of it.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)

#: Further kinds, by the published shapes of such tokens.
MORE_RULES = (
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)

RULES = BASE_RULES + MORE_RULES

#: A Boolean query in disjunctive form: any of these sets of trigrams, all of each; None: no demand.
Query = frozenset[frozenset[str]] | None


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    return _least(frozenset(x | y for x in a for y in b))


def _either(a: Query, b: Query) -> Query:
    return None if a is None or b is None else _least(a | b)


def _least(q: frozenset[frozenset[str]]) -> Query:
    """Without sets that another set implies."""
    return frozenset(x for x in q if not any(y < x for y in q))


def _grams(strings: set[str]) -> Query:
    if any(len(s) < 3 for s in strings):
        return None
    return _least(frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


#: A part of an expression: a kind and what it has. `set`: characters, None if they are many; `group`: alternatives,
#: each a list of parts; `repeat`: least, most (None: no end) and a part.
Part = tuple


def parsed(pattern: str) -> list[list[Part]]:
    """The alternatives of an expression in the part of the language that rules use: characters, escapes, classes, groups without
    names or assertions, alternatives, and greedy repeats."""
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def take() -> str:
        nonlocal at
        at += 1
        return pattern[at - 1]

    def escaped() -> str | None:
        c = take()
        if c == "x":
            return chr(int(take() + take(), 16))
        if c.isalnum():
            if c in "wdsWDS":
                return None
            raise ValueError(f"not known in a rule: \\{c}")
        return c

    def characters() -> Part:
        out: set[str] | None = set()
        if peek() == "^":
            take()
            out = None
        first = True
        while first or peek() != "]":
            first = False
            low = escaped() if (c := take()) == "\\" else c
            high = low
            if peek() == "-" and pattern[at + 1] != "]":
                take()
                high = take()
            if out is not None:
                out = None if low is None or len(out) + ord(high) - ord(low) >= MOST_CHARACTERS else out | {chr(x) for x in range(ord(low), ord(high) + 1)}
        take()
        return ("set", out)

    def repeats(part: Part) -> Part:
        while (c := peek()) and c in "?*+{":
            take()
            if c == "{":
                end = pattern.index("}", at)
                low, _, high = pattern[at:end].partition(",")
                at_most = int(high) if high else (None if "," in pattern[at:end] else int(low))
                skip(end + 1)
                part = ("repeat", int(low or 0), at_most, part)
            else:
                part = ("repeat", *{"?": (0, 1), "*": (0, None), "+": (1, None)}[c], part)
            if peek() and peek() in "?+":
                raise ValueError("repeats of rules are greedy")
        return part

    def skip(to: int) -> None:
        nonlocal at
        at = to

    def alternatives() -> list[list[Part]]:
        out: list[list[Part]] = [[]]
        while (c := peek()) and c != ")":
            take()
            if c == "|":
                out.append([])
                continue
            if c == "(":
                if peek() == "?":
                    if pattern[at : at + 2] != "?:":
                        raise ValueError("rules have no assertions or names")
                    skip(at + 2)
                part: Part = ("group", alternatives())
                take()
            elif c == "[":
                part = characters()
            elif c == ".":
                part = ("set", None)
            elif c in "^$":
                raise ValueError("rules have no anchors")
            else:
                one = escaped() if c == "\\" else c
                part = ("set", None if one is None else {one})
            out[-1].append(repeats(part))
        return out

    found = alternatives()
    if at != len(pattern):
        raise ValueError(f"cannot read the rule {pattern!r}")
    return found


def _strings(part: Part) -> set[str] | None:
    """All strings, in lower case, that a part stands for, if few."""
    if part[0] == "set":
        return None if part[1] is None else {c.lower() for c in part[1]}
    if part[0] == "group":
        found = [_in_a_row(x) for x in part[1]]
        return None if None in found else set().union(*found)
    _, least, most, own = part
    if most is None or most > 3 or (one := _strings(own)) is None:
        return None
    found = {"".join(x) for n in range(least, most + 1) for x in product(one, repeat=n)}
    return found if len(found) <= MOST_STRINGS else None


def _in_a_row(parts: list[Part]) -> set[str] | None:
    found = {""}
    for part in parts:
        own = _strings(part)
        if own is None or len(own) * len(found) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in own}
    return found


def _demand(parts: list[Part]) -> Query:
    """What a row of parts demands: the trigrams of the strings between parts that stand for many, and what those demand."""
    need, run = None, {""}
    for part in parts:
        own = _strings(part)
        if own is not None and len(own) * len(run) <= MOST_STRINGS:
            run = {a + b for a in run for b in own}
            continue
        need, run = _both(need, _grams(run)), own if own is not None else {""}
        if own is None and part[0] == "group":
            need = _both(need, _any_of(part[1]))
        elif own is None and part[0] == "repeat" and part[1] > 0:
            need = _both(need, _demand([part[3]]))
    return _both(need, _grams(run))


def _any_of(alternatives: list[list[Part]]) -> Query:
    found: Query = frozenset()
    for x in alternatives:
        found = _either(found, _demand(x))
    return found


def trigram_query(pattern: str) -> Query:
    """The trigrams, in lower case, that a text must hold to match: any of the sets, or None."""
    return _any_of(parsed(pattern))


def vocabulary(rules: tuple[Rule, ...]) -> list[str]:
    """The trigrams that occur in the rules' queries."""
    return sorted({g for r in rules for s in trigram_query(r.pattern) or () for g in s})


def one_of(grams: list[str]) -> str:
    """An expression that looks for any of the trigrams at each place: their characters by place, then a tree of them."""
    plain = lambda c: c if c.isalnum() else f"\\x{{{ord(c):x}}}"

    def tree(words: list[str]) -> str:
        if words == [""]:
            return ""
        own = [plain(c) + tree([w[1:] for w in of]) for c, of in groupby(words, lambda w: w[0])]
        return own[0] if len(own) == 1 else f"(?:{'|'.join(own)})"

    near = "".join(f"[{''.join(plain(c) for c in sorted({g[i] for g in grams}))}]" for i in range(3))
    return f"(?={near})(?=({tree(sorted(grams))}))"


class TrigramIndex:
    """Postings of texts' trigrams, written by trigram."""

    def __init__(self, postings: DataFrame, grams: list[str]):
        self.postings, self.grams = postings, grams

    @classmethod
    def build(cls, texts: DataFrame, grams: list[str]) -> TrigramIndex:
        """Of rows (digest, text): postings (gram, digest) for each of `grams` that a text holds, whatever its letters' case."""
        if not grams:
            return cls(texts.select(F.lit("").alias("gram"), "digest").limit(0), grams)
        held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(one_of(grams)), F.lit(1)))
        # Not plain explode: filters that are inferred for it would look through the texts once more each.
        postings = texts.select("digest", F.explode_outer(held).alias("gram")).where(F.col("gram").isNotNull()).select("gram", "digest")
        return cls(written(postings.sortWithinPartitions("gram", "digest"), "trigram-postings"), grams)

    def candidates(self, rules: tuple[Rule, ...]) -> DataFrame:
        """(digest, may): the texts that fulfil a rule's query, with the numbers of these rules. Rules without a query are in none."""
        sets = [(i, j, g, len(own)) for i, r in enumerate(rules) for j, own in enumerate(sorted(map(sorted, trigram_query(r.pattern) or ()))) for g in own]
        if missing := {g for _, _, g, _ in sets} - set(self.grams):
            raise ValueError(f"the index has no postings of {sorted(missing)}")
        wanted = self.postings.sparkSession.createDataFrame(sets, "rule int, part int, gram string, size long")  # a fixed, short list
        lists = self.postings.join(F.broadcast(wanted), "gram")
        # Equal texts repeat a posting: the distinct trigrams of a set are counted.
        both = lists.groupBy("digest", "rule", "part").agg(F.count_distinct("gram").alias("n"), F.first("size").alias("size")).where("n = size")
        return both.groupBy("digest").agg(F.collect_set("rule").alias("may"))  # as many as there are rules at most


SPAN = "array<struct<start:int,order:int,end:int,kind:string>>"


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """The spans of a rule's matches, leftmost and not overlapping, of the length asked for."""
    pattern = ("(?i)" if rule.any_case else "") + rule.pattern
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.length)
    groups = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(rule.group)), F.length)
    before = F.transform(F.split(text, pattern, -1), F.length)

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["before"]
        end = start + x["length"]
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), F.lit(rule.kind).alias("kind"))
        keep = x["own"] >= rule.least
        return F.struct(end.alias("at"), F.when(keep, F.concat(acc["found"], F.array(span))).otherwise(acc["found"]).alias("found"))

    each = F.arrays_zip(lengths.alias("length"), groups.alias("own"), F.slice(before, 1, F.size(lengths)).alias("before"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("found"))
    return F.aggregate(each, start, step, lambda acc: acc["found"])


def digest_of(text: Column) -> Column:
    return F.xxhash64(text)


def scan(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", into: str = "secrets", index: TrigramIndex | None = None) -> DataFrame:
    """`df` with column `into`: the spans (start, order of the rule, end, kind) of all rules, by start, then rule.

    index: postings of these texts whose vocabulary has the rules' trigrams; built where it is not given.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    if index is None:
        index = TrigramIndex.build(df.select(digest_of(whole).alias("digest"), whole.alias("text")), vocabulary(rules))
    found = written(index.candidates(rules), "secret-candidates")
    digest, may = free_name(df, "digest"), free_name(df, "may")
    rows, found = df.withColumn(digest, digest_of(whole)), found.select(F.col("digest").alias(digest), F.col("may").alias(may))
    if found.count() <= CANDIDATE_ROWS:
        marked = rows.join(F.broadcast(found), digest, "left")
    else:
        counts, n = rows.groupBy(digest).count(), rows.count()
        marked = joined(rows, found, digest, written(counts.where(F.col("count") > max(1, n * FREQUENT)).select(digest), "frequent-texts"), "left")
    spans = []
    for i, rule in enumerate(rules):
        has = F.regexp_like(whole, F.lit(("(?i)" if rule.any_case else "") + rule.pattern))
        if trigram_query(rule.pattern) is not None:
            has = F.coalesce(F.array_contains(may, i), F.lit(False)) & has
        spans.append(F.when(has, spans_of(whole, rule, i)).otherwise(F.array().cast(SPAN)))
    return marked.withColumn(into, F.array_sort(F.concat(*spans))).select(*(c for c in df.columns if c != into), into)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def masked(df: DataFrame, text: str = "text", spans: str = "secrets", mark: str = "[SECRET]") -> DataFrame:
    """`df` with each stretch of `text` that spans cover replaced by `mark`; stretches that overlap are one."""
    whole = F.col(text)

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.when(fresh, F.concat(acc["out"], F.substring(whole, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), kept.alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(whole, acc["at"] + 1, F.length(whole))))
    return df.withColumn(text, F.when(F.size(spans) > 0, cut).otherwise(whole))


def findings(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, counts of the base kinds, a digest of their spans, and all spans."""
    found = scan(documents.select("doc_id", "text")).select("doc_id", "secrets")
    of = lambda kind: F.filter("secrets", lambda s: s["kind"] == kind)
    base = F.filter("secrets", lambda s: s["order"] < len(BASE_RULES))
    return found.select(
        "doc_id",
        *(F.size(of(r.kind)).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("secrets")).alias("spans"),
    )
