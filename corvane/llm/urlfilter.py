"""URL verdicts: a rule list first, then association rules mined from labelled URLs.

The list's rules are a host and a path prefix; a rule fits its host and all subdomains, and the longest
that fits decides. URLs that no rule fits are judged by what FP-growth finds in labelled URLs: frequent
combinations of tokens (host labels, path words, query names and values, scheme) with a label, kept by
support and confidence. All labelled rows are mined; the confidence must hold on its own in the fifth of
the URLs that a digest holds out and in the others, wherever a combination occurs there, so one that owes
it to a few URLs goes. A combination is indexed under its rarest token; a URL looks up its tokens, and
of the combinations it holds the surest decides. Columns and joins only; URLs of equal tokens are counted and
judged once, and the verdicts of frequent token sets meet their rows by broadcast, all others by shuffle.

Defined results: a null url or one without `://` has an empty host and path and no token but `none`;
verdicts depend on the url alone, so repeated rows agree; with no labelled URLs, or none that fits, the
verdict is `allow`; among equally sure combinations the larger support, then the shorter, then the
first by its tokens decides; very long URLs count whole; an empty table gives no rows; only the id and the
url are read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import FREQUENT, joined, written

MIN_SUPPORT, MIN_CONFIDENCE = 0.005, 0.8
#: Rules that are sent to all tasks at most.
RULES = 100_000
#: One in so many URLs is held out.
HELD_OUT = 5
DEFAULT = "allow"
LABEL = "verdict="

SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; else empty."""
    return lower_ascii(F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 1))


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), SPLIT, 2)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null. rules: pairs of verdict and host/path, a short fixed list."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        own, _, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith("/" + rest)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def tokens_of(url: Column) -> Column:
    """The sorted set of a URL's tokens, each with the part it comes from; numbers are one token per part."""
    host, path = host_of(url), path_of(url)
    text = F.coalesce(url, F.lit(""))
    words = lambda part, s, by: F.transform(F.filter(F.split(s, by), lambda w: w != ""), lambda w: F.concat(F.lit(part + ":"), F.regexp_replace(w, "[0-9]+", "#")))
    scheme = F.regexp_extract(text, r"(?s)^(.*?)://", 1)
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    fragment = F.regexp_extract(text, r"(?s)#(.*)$", 1)
    found = F.array_sort(F.array_distinct(F.concat(words("host", host, r"\."), words("path", lower_ascii(path), r"[/._-]"), words("query", lower_ascii(query), "[&=]"), words("part", lower_ascii(fragment), r"[^\w]"), words("scheme", lower_ascii(scheme), "[^a-z]"))))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("none")))


def _label_of(item: Column) -> Column:
    return F.substring(item, F.lit(len(LABEL) + 1), F.length(item))


def mined_rules(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """Rules (tokens, verdict, confidence, support, key) from all rows (url, label): frequent token combinations that tell the label.

    A rule is dropped if its confidence does not hold among the held-out URLs or among the others, or if one
    with fewer of its tokens is as sure. key: the token of the rule that fewest of the mined URLs have.
    """
    items = F.array_append(tokens_of(F.col("url")), F.concat(F.lit(LABEL), F.col("label")))
    baskets = written(labelled.where(F.col("label").isNotNull()).select(items.alias("items")), "baskets")
    n = baskets.count()
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=0.0).fit(baskets)
    sets = written(model.freqItemsets.withColumn("items", F.array_sort("items")), "frequent-items")
    is_label = lambda t: F.startswith(t, F.lit(LABEL))
    bare = sets.where(~F.exists("items", is_label)).select(F.col("items").alias("tokens"), F.col("freq").alias("whole"))
    labels = sets.where(F.exists("items", is_label)).select(
        F.filter("items", lambda t: ~is_label(t)).alias("tokens"), _label_of(F.get(F.filter("items", is_label), F.lit(0))).alias("verdict"), "freq"
    )
    rules = labels.where(F.size("tokens") > 0).join(bare, "tokens")
    rules = rules.select("tokens", "verdict", (F.col("freq") / F.col("whole")).alias("confidence"), (F.col("freq") / max(1, n)).alias("support")).where(F.col("confidence") >= confidence)
    rules = written(_holding(rules, bare, labelled, confidence), "held-rules")
    # Rules with one token fewer, looked up by what is left without each token.
    fewer = rules.select("tokens", "verdict", "confidence", F.explode("tokens").alias("token")).select(
        F.col("tokens").alias("of"), "verdict", "confidence", F.array_remove("tokens", F.col("token")).alias("tokens")
    )
    smaller = rules.select("tokens", "verdict", F.col("confidence").alias("own"))
    implied = fewer.join(smaller, ["tokens", "verdict"]).where("own >= confidence").select(F.col("of").alias("tokens"), "verdict").distinct()
    kept = rules.join(implied, ["tokens", "verdict"], "left_anti")
    return written(_keyed(kept, bare), "url-rules")


def _keyed(rules: DataFrame, sets: DataFrame) -> DataFrame:
    """`rules` with key: the token of each that is in the fewest rows; sets: frequent combinations (tokens, whole)."""
    single = sets.where(F.size("tokens") == 1).select(F.element_at("tokens", 1).alias("token"), "whole")
    rarest = rules.select("tokens", "verdict", F.explode("tokens").alias("token")).join(single, "token").groupBy("tokens", "verdict").agg(F.min_by("token", F.struct("whole", "token")).alias("key"))
    return rules.join(rarest, ["tokens", "verdict"])


def _to_all(rules: DataFrame) -> DataFrame:
    """Written `rules`, sent to all tasks while they are few; beyond that they are joined by shuffle."""
    return F.broadcast(rules) if rules.count() <= RULES else rules


def _spread(sets: DataFrame) -> DataFrame:
    """Token sets dealt to as many tasks as a shuffle has: looking rules up is work far beyond what the sets' bytes suggest."""
    return sets.repartition(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), "has")


def is_held_out(url: Column) -> Column:
    return F.pmod(F.xxhash64("url", F.lit(3)), F.lit(HELD_OUT)) == 0


def _holding(rules: DataFrame, sets: DataFrame, labelled: DataFrame, confidence: float) -> DataFrame:
    """Those of `rules` whose confidence holds in both parts of the labelled rows, wherever there is a row to tell."""
    told = labelled.where(F.col("label").isNotNull()).select(is_held_out(F.col("url")).alias("held"), "label", tokens_of(F.col("url")).alias("has"))
    has = _spread(told.groupBy("held", "label", "has").count())
    lists = _to_all(written(_keyed(rules.select("tokens", "verdict"), sets), "rule-keys"))
    hits = has.select("held", "label", "count", "has", F.explode("has").alias("key")).join(lists, "key").where(F.size(F.array_except("tokens", "has")) == 0)
    part = hits.groupBy("tokens", "verdict", "held").agg((F.sum(F.when(F.col("label") == F.col("verdict"), F.col("count")).otherwise(0)) / F.sum("count")).alias("own"))
    unsure = part.where(F.col("own") < confidence).select("tokens", "verdict").distinct()
    return rules.join(unsure, ["tokens", "verdict"], "left_anti")


def held_out_score(labelled: DataFrame, support: float = MIN_SUPPORT, confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """One row: how many of the held-out URLs the rules of the others decide (decided, of urls), and rightly (right); a URL with several
    labels counts once for each."""
    rows = labelled.where(F.col("url").isNotNull() & F.col("label").isNotNull())
    kept = rows.where(is_held_out(F.col("url"))).distinct()
    told = mined_verdicts(kept, mined_rules(rows.where(~is_held_out(F.col("url"))), support, confidence))
    both = kept.join(told, "url", "left")
    return both.agg(F.count("*").alias("urls"), F.count("mined").alias("decided"), F.count(F.when(F.col("mined.verdict") == F.col("label"), 1)).alias("right"))


def _surest(sets: DataFrame, rules: DataFrame, by: str) -> DataFrame:
    """Rows (by, mined) for the `sets` (has, and `by` where that is another column, which tells them apart) that hold a rule's tokens."""
    postings = _to_all(rules.select(F.col("key"), "tokens", "verdict", "confidence", "support"))
    hits = _spread(sets).withColumn("key", F.explode("has")).join(postings, "key").where(F.size(F.array_except("tokens", "has")) == 0)
    order = F.struct((-F.col("confidence")).alias("c"), (-F.col("support")).alias("s"), F.size("tokens").alias("n"), F.col("tokens").alias("t"), F.col("verdict").alias("v"))
    return hits.groupBy(by).agg(F.min_by(F.struct("verdict", "confidence", "tokens"), order).alias("mined"))


def mined_verdicts(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows (url, mined: structure of verdict, confidence, tokens) for the distinct urls that hold a rule's tokens."""
    return _surest(urls.select("url").distinct().select("url", tokens_of(F.col("url")).alias("has")), rules, "url")


def judged(pages: DataFrame, listed: list[tuple[str, str]], labelled: DataFrame, default: str = DEFAULT) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, and the mined combination and its confidence where that decided."""
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumn("listed", listed_rule(F.col("host"), F.col("path"), listed))
    is_open = F.col("listed").isNull() & F.col("url").isNotNull()
    undecided = rows.where(is_open).withColumn("has", tokens_of(F.col("url"))).drop("url")
    counts = written(undecided.groupBy("has").count(), "open-sets")
    found = written(_surest(counts.select("has"), mined_rules(labelled), "has"), "mined-verdicts")
    n = counts.agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    frequent = written(counts.where(F.col("count") > max(1, n * FREQUENT)).select("has"), "frequent-sets")
    none = F.lit(None).cast(found.schema["mined"].dataType)
    rest = rows.where(~is_open).drop("url").withColumn("mined", none)
    known = joined(undecided, found, "has", frequent, "left").drop("has").unionByName(rest)
    return known.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "mined.verdict", F.lit(default)).alias("verdict"),
        F.array_join("mined.tokens", " ").alias("mined_tokens"), F.col("mined.confidence").alias("mined_confidence"),
    )


def listed_labels(pages: DataFrame, listed: list[tuple[str, str]]) -> DataFrame:
    """Labelled URLs (url, label): those the rule list decides."""
    fits = listed_rule(host_of(F.col("url")), path_of(F.col("url")), listed)
    return pages.select("url", fits["verdict"].alias("label")).where("url IS NOT NULL AND label IS NOT NULL")
