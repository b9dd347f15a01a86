"""Mining of large and of many-sided tables of labelled URLs."""

from collections import Counter

from pyspark.sql import functions as F

from corvane.llm import urlfilter


def test_all_labelled_rows_count(spark):
    hot = F.col("id") % 3 == 0
    url = F.when(hot, "http://hot.org/p").otherwise(F.concat(F.lit("http://"), F.char(97 + F.col("id") % 7), F.lit(".com/q")))
    labelled = spark.range(300_000).select(url.alias("url"), F.when(hot, "block").otherwise("allow").alias("label"))
    found = {tuple(r["tokens"]): r for r in urlfilter.mined_rules(labelled).collect()}
    rule = found[("host:hot",)]
    assert rule["verdict"] == "block" and rule["confidence"] == 1.0 and rule["support"] == 100_000 / 300_000
    assert sum(found[(f"host:{c}",)]["support"] for c in "abcdefg") * 300_000 == 200_000


def test_rules_of_many_tokens_and_long_labels_are_kept(spark):
    words = [("a", "f"), ("b", "g"), ("c", "h"), ("d", "i"), ("e", "j")]
    urls = ["?" + "&".join(p[i >> k & 1] for k, p in enumerate(words)) for i in range(32)]
    label = "block" + "x" * 120
    labelled = spark.createDataFrame([(u, label if u == urls[0] else "allow") for u in urls], "url string, label string")
    found = {r["url"]: r["mined"]["verdict"] for r in urlfilter.mined_verdicts(labelled, urlfilter.mined_rules(labelled, 0.02, 0.8)).collect()}
    assert found == {u: label if u == urls[0] else "allow" for u in urls}


def test_more_than_ten_thousand_rules_are_kept(spark, monkeypatch):
    monkeypatch.setattr(urlfilter, "RULES", 9_000)  # the way beyond the bound of a broadcast
    urls = ["?" + "".join(chr(97 + i // 26**k % 26) for k in range(3)) for i in range(10_100)]
    labelled = spark.createDataFrame([(u, "block") for u in urls], "url string, label string")
    rules = urlfilter.mined_rules(labelled, 1 / 20_000, 0.8)
    assert rules.count() == len(urls) and urlfilter.mined_verdicts(labelled, rules).count() == len(urls)


def test_rules_are_those_of_brute_force(spark):
    """All frequent, sure, holding and unimplied combinations, and no other."""
    import itertools
    import random

    draw = random.Random(4)
    urls = [f"http://{draw.choice('ab')}.{draw.choice('xy')}.org/{draw.choice('pq')}/{draw.choice('uv')}{i}" for i in range(150)]
    labelled = [(u, draw.choice(["allow", "block"]) if "/q/" in u and draw.random() < 0.3 else "block" if "//a." in u and "/p/" in u else "allow") for u in urls for _ in range(draw.choice([1, 1, 3]))]
    df = spark.createDataFrame(labelled, "url string, label string")
    told = {r["url"]: (frozenset(r["t"]), r["h"]) for r in df.select("url", urlfilter.tokens_of(F.col("url")).alias("t"), urlfilter.is_held_out(F.col("url")).alias("h")).distinct().collect()}
    rows = [(*told[u], label) for u, label in labelled]
    sure = {}
    for tokens in {frozenset(c) for t, _, _ in rows for n in range(1, len(t) + 1) for c in itertools.combinations(sorted(t), n)}:
        own = [(h, label) for t, h, label in rows if tokens <= t]
        for verdict, n in Counter(label for _, label in own).items():
            parts = [[label == verdict for h, label in own if h == held] for held in (False, True)]
            if n >= 0.05 * len(rows) and n >= 0.8 * len(own) and all(sum(p) >= 0.8 * len(p) for p in parts if p):
                sure[tokens, verdict] = n / len(own)
    wanted = {(t, v) for (t, v), c in sure.items() if not any((t - {x}, v) in sure and sure[t - {x}, v] >= c for x in t)}
    found = {(frozenset(r["tokens"]), r["verdict"]) for r in urlfilter.mined_rules(df, 0.05, 0.8).collect()}
    assert found == wanted and len(wanted) > 2


def test_planted_labels_are_told_for_urls_that_were_held_out(spark):
    draw = __import__("random").Random(5)
    rows = []
    for i in range(2000):
        host, word = draw.choice(["news", "shop", "spam", "blog"]), draw.choice(["a", "b", "win", "c"])
        rows.append((f"http://{host}{i % 40}.org/{word}/{i}", "block" if host == "spam" or word == "win" else "allow"))
    score = urlfilter.held_out_score(spark.createDataFrame(rows, "url string, label string")).first()
    assert score["urls"] > 300 and score["decided"] > 0.9 * score["urls"] and score["right"] == score["decided"]


def test_without_labels_there_are_no_rules(spark):
    none = spark.createDataFrame([], "url string, label string")
    assert urlfilter.mined_rules(none).count() == 0
    pages = spark.createDataFrame([(1, "http://a.org/x"), (2, None)], "page_id long, url string")
    assert {r["verdict"] for r in urlfilter.judged(pages, [], spark.createDataFrame([("http://b.org", None)], "url string, label string")).collect()} == {"allow"}


def test_frequent_and_long_urls(spark):
    """A url with a third of the rows, one of 50,000 characters, and the verdict of unlisted ones by the surest rule each holds."""
    long = "http://long.org/" + "/".join(f"w{i}x" for i in range(8_000))
    rows = [(i, "http://hot.org/p") for i in range(50)] + [(50 + i, f"http://h{i}.com/bad/{i}") for i in range(60)] + [(200, long), (201, None), (202, "http://other.org/bad/1")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labelled = spark.createDataFrame([(f"http://k{i}.com/{'bad' if i % 2 else 'good'}/{i}", "block" if i % 2 else "allow") for i in range(200)], "url string, label string")
    found = {r["page_id"]: r["verdict"] for r in urlfilter.judged(pages, [], labelled).collect()}
    assert len(found) == len(rows) and found[202] == "block" and found[201] == "allow" and found[200] == "allow"
    assert {found[i] for i in range(50)} == {"allow"} and {found[50 + i] for i in range(60)} == {"block"}
