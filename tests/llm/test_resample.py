"""Importance resampling against plain counting."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import queries, resample


def plain_features(text, longest):
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1)]


def plain(documents, target, percent=10, buckets=10_000, longest=1, least=20, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    counts = [Counter(bucket(f) for _, t in rows for f in plain_features(t, longest)[1]) for rows in (documents, target)]
    s_all, t_all = (sum(c.values()) for c in counts)
    gain = lambda b: math.floor(1000 * math.log((counts[1][b] + 1) * (s_all + buckets) / ((counts[0][b] + 1) * (t_all + buckets))))
    out = []
    for i, text in documents:
        n_words, features = plain_features(text, longest)
        weight = sum(gain(bucket(f)) for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words >= least])
    enough = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(enough) * percent // 100
    return [(*r[:4], i + 1 if i < drawn else None) for i, r in enumerate(enough)] + [(*r[:4], None) for r in out if not r[4]]


def same(found, wanted):
    """Rows of one id and score may change places."""
    assert Counter(tuple(r)[:4] for r in found) == Counter(r[:4] for r in wanted)
    ranked = lambda rows: {r[4]: (r[0], r[3]) for r in map(tuple, rows) if r[4] is not None}
    assert ranked(found) == ranked(wanted)
    assert sorted(ranked(found)) == list(range(1, len(ranked(found)) + 1))


def columns(df):
    return df.select("doc_id", "n_features", "weight", "score", "rank").collect()


def test_hard_cases_of_the_tables(spark, tables, rows):
    target = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    same(queries.op13_resampling(spark, tables).collect(), plain([(r[0], r[1]) for r in rows], target))


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_runs_of_words_with_small_tries_and_stretches(spark, longest, monkeypatch):
    draw = np.random.default_rng(longest)
    words = ["a", "B", "é", "漢字", "x1", "Zz", "the", "of"]
    text = lambda: "".join(draw.choice(words) + draw.choice([" ", "-", "\n", ". "]) for _ in range(draw.integers(0, 90)))
    documents, target = [(i, text()) for i in range(120)], [(i, text()) for i in range(15)]
    documents += [(7, documents[7][1]), (None, documents[8][1]), (200, None), (201, "")]
    monkeypatch.setattr(resample, "NODES", 9)
    monkeypatch.setattr(resample, "STRETCH", 25)
    frames = [spark.createDataFrame(x, "doc_id long, text string").repartition(3) for x in (documents, target)]
    found = resample.resampled(*frames, percent=30, buckets=50, longest=longest)
    same(columns(found), plain(documents, target, 30, 50, longest))


def test_the_target_s_documents_are_drawn(spark):
    draw = np.random.default_rng(3)
    text = lambda kind: " ".join(f"{kind}{x}" for x in draw.integers(0, 60, 40))
    documents = spark.createDataFrame([(i, text("t" if i % 10 == 0 else "c")) for i in range(300)], "doc_id long, text string")
    target = spark.createDataFrame([(i, text("t")) for i in range(20)], "id long, words string")
    drawn = resample.resampled(documents, target, percent=10, target_text="words").where("rank IS NOT NULL").collect()
    assert len(drawn) == 30 and all(r["doc_id"] % 10 == 0 for r in drawn)


def test_without_a_target_or_long_texts(spark):
    documents = spark.createDataFrame([(1, "one two"), (2, None)], "doc_id long, text string")
    target = spark.createDataFrame([], "text string")
    same(columns(resample.resampled(documents, target, percent=50)), plain([(1, "one two"), (2, None)], [], 50))


def test_a_stretch_cuts_no_word(monkeypatch):
    monkeypatch.setattr(resample, "STRETCH", 3)
    for text in ("ABCDEFG hi é" * 5, "", "x", "aaaa", "  a", "漢字漢字 b"):
        assert [w for part in resample.words_of(text.encode()) for w in part] == resample.WORD.findall(text.encode().lower())
