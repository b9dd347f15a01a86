"""Language ID against a plain reading: counting, scores, paths over all languages; many languages."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import langid

TEXTS = [
    ("en", "the house of the rising sun is in the town and that was for us"), ("de", "das haus der sonne ist in der stadt und das war für uns über"), ("fr", "la maison du soleil est dans la ville et c'était pour nous même"),
    ("ru", "дом восходящего солнца стоит в городе и это было для нас"), ("en", "they have not been at the house with this and which had"), ("de", "sie werden nicht auch noch mit sich aus einer wird"), ("fr", "les hommes sont avec nous mais pas comme elle tout"),
]
QUESTIONS = [
    "the town of the house", "die stadt der sonne", "la ville et elle", "для города", "the house of the town and that was the sun die stadt der sonne ist nicht auch noch über uns",
    "", "123 !", "x", "für 12 the", "The TOWNİ K", "les hommes sont avec nous дом стоит в городе и это было the town which had been", "漢字", "漢字 the",
]


def word_list(text):
    """(start, end, letters in lower case) of runs of letters."""
    low = langid.lower_table()
    return [(m.start(), m.end(), [int(low[ord(c)]) for c in m.group()]) for m in re.finditer(r"[^\W\d_]+", text)]


def bucket(a, b, c, shift=0):
    mask = 0xFFFFFFFF
    x = (a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) & mask
    x ^= x >> 15
    return ((x * 0x27D4EB2F) & mask) >> (32 - langid.BUCKET_BITS) >> shift


def grams(letters, shift):
    wide = [0, *letters, 0]
    return [bucket(*wide[i : i + 3], shift) for i in range(len(letters))]


def script(code):
    return langid.SCRIPTS[max(i for i, (a, _) in enumerate(langid.SCRIPTS) if a <= code)][1]


def plain_model(rows, shift):
    counts, scripts = defaultdict(Counter), defaultdict(Counter)
    for lang, text in rows:
        for a, _, letters in word_list(text):
            counts[lang].update(grams(letters, shift))
            scripts[lang][script(ord(text[a]))] += 1
    languages, size = sorted(counts), langid.BUCKETS >> shift
    log = lambda lang, b: math.log((counts[lang][b] + langid.PRIOR) / (sum(counts[lang].values()) + langid.PRIOR * size))

    def score(b):
        if not any(counts[x][b] for x in languages):
            return [0.0] * len(languages)
        own = [log(x, b) for x in languages]
        return [v - sum(own) / len(own) for v in own]

    fits = lambda lang, name: scripts[lang][name] >= max(1, 0.005 * sum(scripts[lang].values()))
    return languages, score, fits


def plain_label(text, model, shift):
    languages, score, fits = model
    words = word_list(text)
    if not words:
        return "und", 0.0, []
    table = []
    for a, _, letters in words:
        own = [sum(x) for x in zip(*(score(b) for b in grams(letters, shift)))]
        allowed = [fits(x, script(ord(text[a]))) for x in languages]
        table.append([v if ok else langid.OTHER_SCRIPT for v, ok in zip(own, allowed)] if any(allowed) else [0.0] * len(languages))
    k = range(len(languages))
    best, back = list(table[0]), []
    for row in table[1:]:
        came = [max(k, key=lambda j, i=i: (best[j] - langid.SWITCH_PENALTY * (i != j), i == j, -j)) for i in k]
        best, back = [best[came[i]] - langid.SWITCH_PENALTY * (came[i] != i) + row[i] for i in k], [*back, came]
    path = [max(k, key=lambda i: (best[i], -i))]
    for came in reversed(back):
        path.append(came[path[-1]])
    path.reverse()
    letters = Counter()
    for i, (_, _, own) in zip(path, words):
        letters[i] += len(own)
    top = max(k, key=lambda i: (letters[i], -i))
    total = [sum(row[i] for row, p in zip(table, path) if p == top) for i in k]
    sure = letters[top] / sum(letters.values()) / sum(math.exp(min(t - total[top], 50)) for t in total)
    spans = []
    for i, (a, b, _) in zip(path, words):
        if spans and spans[-1][2] == languages[i]:
            spans[-1] = (spans[-1][0], b, languages[i])
        else:
            spans.append((a, b, languages[i]))
    return languages[top], sure, spans


@pytest.mark.parametrize("numbers", [1 << 24, 1 << 14])
def test_predictions_are_those_of_a_plain_reading(spark, numbers, monkeypatch):
    monkeypatch.setattr(langid, "MODEL_NUMBERS", numbers)
    shift = langid.merged_bits(4)
    assert shift == (0 if numbers == 1 << 24 else 4)
    rows = [(i, lang, t) for i, (lang, t) in enumerate(TEXTS)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3))
    wanted = plain_model(TEXTS, shift)
    assert model.languages == wanted[0] and model.merged_bits == shift
    found = langid.identify(spark.createDataFrame(list(enumerate(QUESTIONS)), "i int, text string"), model).collect()
    for r in found:
        lang, sure, spans = plain_label(QUESTIONS[r["i"]], wanted, shift)
        assert r["language"]["lang_pred"] == lang, QUESTIONS[r["i"]]
        assert math.isclose(r["language"]["score"], sure, abs_tol=1e-4)
        assert [tuple(s) for s in r["language"]["spans"]] == spans


def test_many_languages_keep_the_model_small(spark, monkeypatch):
    """Each language has words of its own: all are learned and told apart."""
    draw = np.random.default_rng(4)
    stems = ["".join(chr(97 + c) for c in draw.integers(0, 26, 7)) for _ in range(400)]
    rows = [(i * 10 + j, f"l{i:03d}", " ".join([s, s + "en", "a" + s] * 3)) for i, s in enumerate(stems) for j in range(2)]
    monkeypatch.setattr(langid, "MODEL_NUMBERS", 400 << 11)
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(2))
    assert len(model.languages) == 400 and model.scores.size <= 400 << 11 and model.merged_bits == 5
    found = langid.identify(spark.createDataFrame([(f"l{i:03d}", f"{s} {s}en") for i, s in enumerate(stems)], "lang string, text string"), model).collect()
    assert sum(r["lang"] == r["language"]["lang_pred"] for r in found) >= 396
    monkeypatch.setattr(langid, "LANGUAGES", 399)
    with pytest.raises(ValueError, match="399"):
        langid.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"))
