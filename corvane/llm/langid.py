"""Language of whole texts and of the spans of mixed texts.

A word's script leaves the languages that are written in it; hashed letter trigrams score the word for
each of those; a Viterbi path over the words, with a penalty for each switch, labels the spans. The
text's language is that of most letters. Counts of trigrams are learned from labelled documents.

Defined results: null text and text without a letter are `und` with score 0 and no spans; bad UTF-8 is
read with replacement marks; ties go to the language that sorts first; with many values of `lang` the
trigrams share fewer buckets, so that the model keeps its size, and more than LANGUAGES of them are an error; with no labelled rows, all is
`und` with score 0, and texts with letters are one span of it; whole texts count, whatever their length;
rows do not affect each other; other columns stay; an empty table gives no rows. Rows without an id are not
held out, but not learned from either: what their remainder is, is not known.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.bpe import LETTER, classes
from corvane.llm.common import by_size, strings, written

#: The bound of the fit: labelled rows read per language, about.
FIT_ROWS = 8_000
BUCKET_BITS = 16
#: Numbers of a model at most, which go to all tasks: with more languages there are fewer buckets, down to as few bits.
MODEL_NUMBERS, LEAST_BITS = 1 << 24, 8
LANGUAGES = MODEL_NUMBERS >> LEAST_BITS
BUCKETS = 1 << BUCKET_BITS
SWITCH_PENALTY, OTHER_SCRIPT, PRIOR = 12.0, -20.0, 0.5
BATCH_CHARS = 500_000
UNKNOWN = "und"

# First code points of script ranges, in order; a range ends where the next begins.
SCRIPTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Gurmukhi"), (0x0A80, "Gujarati"), (0x0B00, "Odia"), (0x0B80, "Tamil"),
    (0x0C00, "Telugu"), (0x0C80, "Kannada"), (0x0D00, "Malayalam"), (0x0D80, "Sinhala"), (0x0E00, "Thai"), (0x0E80, "Lao"),
    (0x0F00, "Tibetan"), (0x1000, "Myanmar"), (0x10A0, "Georgian"), (0x1100, "Hangul"), (0x1200, "Ethiopic"), (0x13A0, "Other"),
    (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"), (0x3040, "Kana"), (0x3100, "Other"), (0x3130, "Hangul"), (0x3190, "Other"),
    (0x31F0, "Kana"), (0x3200, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xA640, "Cyrillic"), (0xA6A0, "Other"), (0xA720, "Latin"),
    (0xA800, "Other"), (0xAC00, "Hangul"), (0xD800, "Other"), (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Armenian"), (0xFB1D, "Hebrew"),
    (0xFB50, "Arabic"), (0xFE00, "Other"), (0xFE70, "Arabic"), (0xFF00, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Hangul"),
    (0xFFE0, "Other"), (0x20000, "Han"), (0x33480, "Other"),
]
SCRIPT_NAMES = sorted({name for _, name in SCRIPTS})
SCRIPT_STARTS = np.array([a for a, _ in SCRIPTS])
SCRIPT_IDS = np.array([SCRIPT_NAMES.index(name) for _, name in SCRIPTS])


@lru_cache(1)
def lower_table() -> np.ndarray:
    """The lower-case code point of each, where that is one."""
    table = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x1F000):
        if len(low := chr(c).lower()) == 1:
            table[c] = ord(low)
    return table


@dataclass
class Words:
    """The words of texts: maximal runs of letters. start, end: code points in the batch; text: the text's number."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    first: np.ndarray  # of each word, among the letters
    bucket: np.ndarray  # of each letter with its neighbours
    script: np.ndarray
    base: np.ndarray  # where each text begins


def words_of(texts: list[str]) -> Words:
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    letter = classes()[codes] == LETTER
    low = lower_table()[codes] * letter
    edge = np.zeros(1, np.uint32)
    before, after = np.concatenate((edge, low[:-1])), np.concatenate((low[1:], edge))
    at = np.flatnonzero(letter)
    mixed = before[at] * np.uint32(0x9E3779B1) + low[at] * np.uint32(0x85EBCA77) + after[at] * np.uint32(0xC2B2AE3D)
    mixed ^= mixed >> np.uint32(15)
    bucket = (mixed * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BUCKET_BITS)
    first = np.flatnonzero(before[at] == 0)
    start = at[first]
    end = at[np.append(first[1:], len(at))[: len(first)] - 1] + 1
    script = SCRIPT_IDS[np.searchsorted(SCRIPT_STARTS, codes[start], "right") - 1]
    return Words(start, end, np.searchsorted(base, start, "right") - 1, first, bucket.astype(np.int64), script, base)


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 2 when divided by 4; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # bucket, language: log probability less its mean over the languages
    written_in: np.ndarray  # script, language
    merged_bits: int = 0  # of a trigram's bucket that are left out


def merged_bits(languages: int) -> int:
    """By how many bits buckets are shortened for so many languages."""
    bits = BUCKET_BITS
    while bits > LEAST_BITS and languages << bits > MODEL_NUMBERS:
        bits -= 1
    return BUCKET_BITS - bits


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = FIT_ROWS) -> Model:
    """Learns from about `rows` rows of each language, picked by a hash of `key`. The model has a number for each language and bucket."""
    known = labelled.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    by_language = written(known.groupBy(lang).count(), "languages")
    if by_language.count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} values of {lang}")
    sizes = {r[lang]: r["count"] for r in by_language.collect()}  # a row per language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(SCRIPT_NAMES), 0), bool))
    shares = labelled.sparkSession.createDataFrame([(l, -(-1_000_000_000 * rows // max(rows, sizes[l]))) for l in languages], "__lang string, __share long")
    chosen = F.pmod(F.xxhash64(key, F.lit(10)), F.lit(1_000_000_000)) < F.col("__share")
    sample = known.select(key, text, lang).join(F.broadcast(shares), F.col(lang) == F.col("__lang")).where(chosen)
    number, shift = {l: i for i, l in enumerate(languages)}, merged_bits(len(languages))
    buckets = BUCKETS >> shift

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # of the languages that the task meets

        def counted() -> pa.RecordBatch:
            at = [(i, np.flatnonzero(c), c) for i, c in sorted(held.items())]
            out = [np.concatenate(x) if at else np.zeros(0, np.int64) for x in ([np.full(len(b), i) for i, b, _ in at], [b for _, b, _ in at], [c[b] for _, b, c in at])]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(out[0].astype(np.int32)), pa.array(out[1].astype(np.int32)), pa.array(out[2])], ["lang", "bucket", "n"])

        for batch in batches:
            texts, names = strings(batch.column(0)), np.array([number[x] for x in batch.column(1).to_pylist()])
            for a, b in by_size([len(t) + 1 for t in texts], BATCH_CHARS):
                w = words_of(texts[a:b])
                own = names[a:b][w.text]
                letters = np.diff(np.append(w.first, len(w.bucket)))
                for i in np.unique(own).tolist():
                    counts = held.setdefault(i, np.zeros(buckets + len(SCRIPT_NAMES), np.int64))
                    counts[:buckets] += np.bincount(w.bucket[np.repeat(own == i, letters)] >> shift, minlength=buckets)
                    counts[buckets:] += np.bincount(w.script[own == i], minlength=len(SCRIPT_NAMES))
                if len(held) * buckets > MODEL_NUMBERS // 4:
                    yield counted()
        yield counted()

    found = sample.select(text, lang).mapInArrow(tally, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()  # MODEL_NUMBERS rows at most, about
    counts = np.zeros((len(languages), buckets + len(SCRIPT_NAMES)), np.float32 if len(languages) > 256 else np.float64)
    counts[found["lang"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    grams, scripts = counts[:, :buckets], counts[:, buckets:]
    logs = np.log((grams + PRIOR) / (grams.sum(1, keepdims=True) + PRIOR * buckets)).T
    logs -= logs.mean(1, keepdims=True)
    logs[grams.sum(0) == 0] = 0
    return Model(languages, logs.astype(np.float32), scripts.T >= np.maximum(1, 0.005 * scripts.sum(1)), shift)


def best_path(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The Viterbi path: the language of each word for the largest sum of scores less `penalty` a switch."""
    n, k = scores.shape
    value, back = scores[0].astype(np.float64), np.zeros((n, k), np.int32)
    stay = np.arange(k)
    for i in range(1, n):
        top = int(value.argmax())
        switch = value[top] - penalty
        moved = value < switch
        back[i] = np.where(moved, top, stay)
        value = np.where(moved, switch, value) + scores[i]
    path = np.empty(n, np.int32)
    path[-1] = value.argmax()
    for i in range(n - 1, 0, -1):
        path[i - 1] = back[i, path[i]]
    return path


def word_scores(words: Words, model: Model) -> np.ndarray:
    scores = np.add.reduceat(model.scores[words.bucket >> model.merged_bits], words.first, axis=0)
    allowed = model.written_in[words.script]
    some = allowed.any(1)
    if not allowed.all():
        scores = np.where(some[:, None], np.where(allowed, scores, OTHER_SCRIPT), 0)
    return scores


def label(texts: list[str], model: Model) -> tuple[list, list, list]:
    """Of each text: the language, its score, and the spans (start, end, language) in code points."""
    langs, sure, spans = [UNKNOWN] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    words = words_of(texts)
    if not len(words.start):
        return langs, sure, spans
    if not model.languages:
        for t in np.unique(words.text):
            a, b = np.searchsorted(words.text, [t, t + 1])
            spans[t] = [(int(words.start[a] - words.base[t]), int(words.end[b - 1] - words.base[t]), UNKNOWN)]
        return langs, sure, spans
    scores = word_scores(words, model)
    cuts = np.searchsorted(words.text, np.arange(len(texts) + 1))
    lengths = words.end - words.start
    for t in range(len(texts)):
        a, b = cuts[t], cuts[t + 1]
        if a == b:
            continue
        own, size, base = scores[a:b], lengths[a:b], words.base[t]
        total = own.sum(0, dtype=np.float64)
        top = int(total.argmax())
        # No path gains by leaving `top` if no run of words favours others by more than one switch costs.
        over = np.cumsum(own.max(1) - own[:, top], dtype=np.float64) if len(model.languages) > 1 else np.zeros(1)
        if over[-1] > SWITCH_PENALTY:
            rest = np.delete(own, top, 1).max(1) - own[:, top]
            run = np.concatenate(([0], np.cumsum(rest, dtype=np.float64)))
            mixed = (run - np.minimum.accumulate(run)).max() > SWITCH_PENALTY
        else:
            mixed = False
        if mixed:
            path = best_path(own, SWITCH_PENALTY)
            first = np.flatnonzero(np.diff(path, prepend=-1))
            stop = np.append(first[1:], len(path)) - 1
            spans[t] = [(int(words.start[a + i] - base), int(words.end[a + j] - base), model.languages[path[i]]) for i, j in zip(first, stop, strict=True)]
            letters = np.bincount(path, weights=size, minlength=len(model.languages))
            top = int(letters.argmax())
            share, total = letters[top] / size.sum(), own[path == top].sum(0, dtype=np.float64)
        else:
            share = 1.0
            spans[t] = [(int(words.start[a] - base), int(words.end[b - 1] - base), model.languages[top])]
        langs[t] = model.languages[top]
        sure[t] = float(share / np.exp(np.minimum(total - total[top], 50)).sum())
    return langs, sure, spans


LABELLED = T.StructType([
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))),
])


def identify(df: DataFrame, model: Model, text: str = "text", into: str = "language") -> DataFrame:
    """`df` with column `into`: a structure of lang_pred, score and spans; a column of that name is replaced."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    span = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])

    @F.arrow_udf(LABELLED)
    def labels(column: pa.Array) -> pa.Array:
        texts = strings(column)
        langs, sure, spans = [], [], []
        for a, b in by_size([len(t) + 1 for t in texts], BATCH_CHARS):
            for out, x in zip((langs, sure, spans), label(texts[a:b], shared.value), strict=True):
                out += x
        lists = pa.array([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in x] for x in spans], pa.list_(span))
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(sure, pa.float64()), lists], ["lang_pred", "score", "spans"])

    return df.withColumn(into, labels(F.coalesce(F.col(text), F.lit(""))))


def labelled_documents(documents: DataFrame) -> DataFrame:
    """The rows to learn from: with an id that is not held out."""
    return documents.where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")


def predictions(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score and n_spans."""
    model = fit(labelled_documents(documents))
    found = identify(documents.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "language.lang_pred", "language.score", F.size("language.spans").alias("n_spans"))
