"""Toxicity by the nearest labelled examples: exact TF-IDF cosine through a block-max inverted index.

Terms are whole words and their beginnings of 4 to 7 letters, each at several levels of use: once, twice
or four times in a text, and as a share of its words. Which terms there are is learned: those found in
toxic examples more often than chance allows, by their z-score, VOCABULARY at most. A text is the set of
its terms, weighted by inverse document frequency over all documents and brought to length one. Labelled
texts of one vector are one example with its number of rows and of toxic ones.

Postings are sorted by example and cut into blocks of examples; the index has each term's highest weight
in each block. A query adds up these for its terms: no example of a block scores higher. The blocks with
the highest sums are scored first, then all that may still hold one of the nearest NEIGHBOURS; the others
are never looked at. The neighbours vote with weights that fall with distance. Votes become scores by a
monotone map that is fitted on the examples themselves, each judged without itself, so a score of 0.3 is met
by three toxic rows in ten.

The fit takes FIT_ROWS labelled rows at most (by a hash of the key) and POSTINGS postings, the map of scores the rows
of JUDGED examples; what is broadcast is bounded by these. All documents count for document frequencies, and all are scored, by tasks
that each hold the index; texts of one vector are looked up once a task.

Defined results: null, empty and letterless texts have no terms and score as the examples without terms do; so
do texts none of whose words is a term; texts of one vector have one score; any label but 0 is toxic;
labels that are null or without a document teach nothing; several labels of a document all count; without
labels all scores are 0; similarities that tie go to the example whose terms come first; long texts are read
whole, in stretches; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import strings, written
from corvane.llm.langid import held_out

#: Labelled rows and postings that the examples come from at most, and terms.
FIT_ROWS, POSTINGS, VOCABULARY = 200_000, 8_000_000, 1_024
#: A term is found in so many labelled rows at least, and so many standard deviations more often in toxic ones.
LEAST_ROWS, LEAST_Z = 5, 6.0
#: Letters of beginnings; levels of use: times in the text, share of its words.
BEGINNINGS = range(4, 8)
LEVELS = ((1, 0.0), (2, 0.0), (4, 0.0), (2, 1 / 300), (2, 1 / 100), (2, 1 / 33))
#: Examples of a block, blocks scored first, and neighbours that vote.
BLOCK, FIRST, NEIGHBOURS = 128, 8, 16
#: A vote falls by e at each WIDTH of distance; the share among all examples counts as PRIOR votes.
WIDTH, PRIOR = 0.1, 0.05
#: Examples (of different vectors) that the map from votes to scores is fitted on, about, and bins of votes.
JUDGED, BINS, THRESHOLD = 10_000, 40, 0.3
#: Characters of a text looked at at once, terms that a task counts before it gives them on, and vectors it remembers.
STRETCH, HELD_TERMS, REMEMBERED = 2_000_000, 400_000, 200_000
WORD, GAP = re.compile(r"[^\W\d_]+"), re.compile(r"[\W\d_]")
WHOLE = "$"  # ends a term that is a whole word


def word_counts(text: str) -> Counter:
    """How often each lower-case word is in `text`."""
    counts, start = Counter(), 0
    while start < len(text):
        gap = GAP.search(text, start + STRETCH)
        end = gap.end() if gap else len(text)
        counts.update(WORD.findall(text[start:end].lower()))
        start = end
    return counts


def uses(words: Counter) -> Counter:
    """How often each word and beginning is used."""
    once = [w for w, n in words.items() if n == 1]
    out = Counter([w + WHOLE for w in once])  # lists are counted fast
    for k in BEGINNINGS:
        out.update([w[:k] for w in once if len(w) >= k])
    for word, n in words.items():
        if n > 1:
            for name in (word + WHOLE, *(word[:k] for k in BEGINNINGS if k <= len(word))):
                out[name] += n
    return out


def terms(words: Counter, total: int) -> list[tuple[str, int]]:
    """Terms: what is used, and the numbers of the levels that its use reaches in a text of `total` words."""
    used = uses(words)
    out = [(name, 0) for name in used]
    for name, n in used.items():
        if n > 1:
            out += [(name, level) for level, (times, share) in enumerate(LEVELS) if level and n >= times and n >= share * total]
    return out


@dataclass
class Terms:
    """The vocabulary: numbers of terms, by name and level."""

    number: dict[tuple[str, int], int]
    first: set[str] = field(init=False)

    def __post_init__(self):
        self.first = {name.rstrip(WHOLE)[: BEGINNINGS[0]] for name, _ in self.number}

    def vector(self, text: str) -> tuple[int, ...]:
        """The numbers of a text's terms, rising."""
        words, first, k = word_counts(text), self.first, BEGINNINGS[0]
        own = Counter({w: n for w, n in words.items() if w[:k] in first})
        if not own:
            return ()
        return tuple(sorted(i for x in terms(own, words.total()) if (i := self.number.get(x)) is not None))


def labelled_rows(labels: DataFrame, key: str = "doc_id", label: str = "toxic", rows: int = FIT_ROWS) -> DataFrame:
    """Rows (key, n, n_toxic) of documents to learn from, about `rows` at most: those that are not held out."""
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key)))
    by_key = written(known.groupBy(key).agg(F.count("*").alias("n"), F.sum((F.col(label) != 0).cast("long")).alias("n_toxic")), "labelled")
    share = -(-1_000_000_000 * rows // max(rows, by_key.count()))
    return by_key.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(1_000_000_000)) < share)


def learned_terms(examples: DataFrame, text: str = "text") -> Terms:
    """The vocabulary of rows (text, n, n_toxic)."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        toxic: Counter = Counter()

        def counted() -> pa.RecordBatch:
            names = list(n)
            out = pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in names], pa.string()), pa.array([x[1] for x in names], pa.int32()), pa.array([n[x] for x in names], pa.int64()), pa.array([toxic[x] for x in names], pa.int64())],
                ["name", "level", "n", "n_toxic"],
            )
            n.clear()
            toxic.clear()
            return out

        for batch in batches:
            for value, rows, bad in zip(strings(batch.column(0)), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = word_counts(value)
                found = terms(words, words.total())
                if rows == 1:
                    n.update(found)
                else:
                    n.update(dict.fromkeys(found, rows))
                if bad:
                    toxic.update(dict.fromkeys(found, bad))
                if len(n) > HELD_TERMS:
                    yield counted()
        yield counted()

    rows, bad = examples.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_toxic"), F.lit(0))).first()
    if not 0 < bad < rows:
        return Terms({})
    share = bad / rows
    counts = examples.select(text, "n", "n_toxic").mapInArrow(tally, "name string, level int, n long, n_toxic long").groupBy("name", "level").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"))
    z = (F.col("n_toxic") - F.col("n") * share) / F.sqrt(F.col("n") * share * (1 - share))
    best = counts.withColumn("z", z).where((F.col("n") >= LEAST_ROWS) & (F.col("z") >= LEAST_Z)).orderBy(F.desc("z"), "name", "level").limit(VOCABULARY).collect()
    return Terms({(r["name"], r["level"]): i for i, r in enumerate(best)})


@dataclass
class Index:
    """Examples and their postings. Of example i: n[i] rows, toxic[i] of them toxic, the first in id[i]; postings of term t stand from start[t] to start[t + 1]."""

    idf: np.ndarray
    n: np.ndarray
    toxic: np.ndarray
    id: np.ndarray
    start: np.ndarray
    example: np.ndarray
    weight: np.ndarray
    none: tuple[int, int]  # rows without terms, and toxic ones
    share: float
    steps: tuple[np.ndarray, np.ndarray] | None = None  # votes and the scores they become

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_top"}

    def top(self) -> np.ndarray:
        """The highest weight by term and block: VOCABULARY x FIT_ROWS / BLOCK numbers at most."""
        if "_top" not in self.__dict__:
            self._top = np.zeros((len(self.idf), -(-len(self.n) // BLOCK)), np.float32)
            np.maximum.at(self._top, (np.repeat(np.arange(len(self.idf)), np.diff(self.start)), self.example // BLOCK), self.weight)
            self._top = np.nextafter(self._top, np.float32(2))  # rounding must not lower a bound
        return self._top

    def nearest(self, vector: tuple[int, ...], k: int = NEIGHBOURS) -> tuple[np.ndarray, np.ndarray, int]:
        """The k nearest examples that share a term, nearest first: numbers and similarities; and how many blocks were scored."""
        if not vector or not len(self.n):
            return np.zeros(0, np.int64), np.zeros(0), 0
        t = np.array(vector)
        q = self.idf[t] / math.sqrt(float((self.idf[t] ** 2).sum()))
        bound = q @ self.top()[t] + 1e-9
        spans = [slice(self.start[i], self.start[i + 1]) for i in t]
        ids = np.concatenate([self.example[s] for s in spans])
        part, block = np.concatenate([self.weight[s] * x for s, x in zip(spans, q, strict=True)]), ids // BLOCK
        first = np.argsort(-bound, kind="stable")[:FIRST]
        done = np.zeros(len(bound), bool)
        done[first] = True
        found = _best(_scored(ids, part, done[block], len(self.n)), k)
        floor = found[1][-1] if len(found[0]) == k else 0.0
        more = (bound >= max(floor, 2e-9)) & ~done
        if more.any():
            done |= more
            found = _best(_scored(ids, part, done[block], len(self.n)), k)
        return *found, int(done.sum())

    def votes(self, vector: tuple[int, ...]) -> tuple[float, float, np.ndarray, np.ndarray]:
        """Weights of all votes and of toxic ones, neighbours and similarities."""
        if not vector:
            return float(self.none[0]), float(self.none[1]), np.zeros(0, np.int64), np.zeros(0)
        near, alike, _ = self.nearest(vector)
        w = np.exp(-np.maximum(0, 1 - alike) / WIDTH)
        return float((w * self.n[near]).sum()), float((w * self.toxic[near]).sum()), near, alike

    def share_of(self, every: float, toxic: float) -> float:
        return (toxic + PRIOR * self.share) / (every + PRIOR)

    def score(self, vector: tuple[int, ...]) -> tuple[float, str]:
        """A text's score, and its evidence: example:similarity:toxic/rows of its three nearest neighbours."""
        every, toxic, near, alike = self.votes(vector)
        vote = self.share_of(every, toxic)
        if self.steps is not None:  # a thousandth of the vote keeps the order within a step
            vote = 0.999 * float(np.interp(vote, *self.steps)) + 0.001 * vote
        shown = (f"{self.id[i]}:{s:.3f}:{self.toxic[i]}/{self.n[i]}" for i, s in zip(near[:3], alike[:3], strict=True))
        return min(1.0, max(0.0, vote)), ",".join(shown)


def _scored(ids: np.ndarray, part: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Similarities of all examples to the postings' parts that count; 0 for others."""
    return np.bincount(ids[own], weights=part[own], minlength=n)


def _best(alike: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k most alike, more than 0; ties to smaller numbers."""
    ids = np.flatnonzero(alike)
    if len(ids) > 4 * k:  # those that tie with the last of the best stay in
        least = np.partition(alike[ids], len(ids) - k)[len(ids) - k]
        ids = ids[alike[ids] >= least - 1e-11]
    order = np.lexsort((ids, -np.round(alike[ids], 12)))[:k]
    return ids[order], alike[ids[order]]


def vectors_of(df: DataFrame, vocabulary: Terms, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, terms)."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shared.value.vector(t) for t in strings(batch.column(1))], pa.list_(pa.int32()))], [key, "terms"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(read, f"`{key}` long, terms array<int>")


def built(vectors: DataFrame, labelled: DataFrame, vocabulary: Terms, key: str = "doc_id", postings: int = POSTINGS) -> tuple[Index, DataFrame]:
    """The index of the labelled ones among `vectors`, a written table, and its examples (terms, n, n_toxic, id)."""
    n_terms = len(vocabulary.number)
    counts = {r["term"]: r["n"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("n")).collect()}  # a row a term
    df = np.array([counts.get(i, 0) for i in range(n_terms)], np.float64)
    idf = np.log((1 + vectors.count()) / (1 + df)) + 1
    own = vectors.join(F.broadcast(labelled), key)  # FIT_ROWS at most
    examples = written(own.groupBy("terms").agg(F.sum("n").alias("n"), F.sum("n_toxic").alias("n_toxic"), F.min(key).alias("id")), "examples")
    every, bad, size = examples.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("n_toxic"), F.lit(0)), F.coalesce(F.sum(F.size("terms")), F.lit(0))).first()
    none = examples.where(F.size("terms") == 0).select("n", "n_toxic").first() or (0, 0)
    share = -(-1_000_000_000 * postings // max(postings, size))
    examples = examples.where((F.size("terms") > 0) & (F.pmod(F.xxhash64("terms"), F.lit(1_000_000_000)) < share))
    held = examples.orderBy("terms").toArrow()  # POSTINGS, about, at most
    lists = held["terms"].combine_chunks() if len(held) else pa.array([], pa.list_(pa.int32()))
    sizes = np.diff(lists.offsets.to_numpy()) if len(held) else np.zeros(0, np.int64)
    term, example = (lists.flatten().to_numpy() if len(held) else np.zeros(0, np.int32)), np.repeat(np.arange(len(held)), sizes)
    length = np.sqrt(np.bincount(example, weights=idf[term] ** 2, minlength=len(held))) if len(held) else np.zeros(0)
    order = np.lexsort((example, term))
    term, example = term[order], example[order]
    weight = (idf[term] / length[example]).astype(np.float32)
    numbers = (held[c].to_numpy() for c in ("n", "n_toxic", "id"))
    return Index(idf, *numbers, np.searchsorted(term, np.arange(n_terms + 1)), example.astype(np.int32), weight, (none[0], none[1]), bad / every if every else 0.0), examples


def rising(x: np.ndarray, n: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest rising shares of `good` among `n` along x: neighbours that fall are pooled."""
    pools: list[list[float]] = []
    for at, m, g in zip(x.tolist(), n.tolist(), good.tolist(), strict=True):
        pools.append([at * m, m, g])
        while len(pools) > 1 and pools[-2][2] * pools[-1][1] >= pools[-1][2] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
    return np.array([p[0] / p[1] for p in pools]), np.array([p[2] / p[1] for p in pools])


def calibrated(index: Index, examples: DataFrame) -> Index:
    """The index with its map from votes to scores: rows of JUDGED examples, about, are judged by all others."""
    share = -(-1_000_000_000 * JUDGED // max(JUDGED, len(index.n)))
    examples = examples.where(F.pmod(F.xxhash64("terms", F.lit(1)), F.lit(1_000_000_000)) < share)
    spread = int(examples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shared = examples.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, n, good = np.zeros(BINS), np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)

        def add(vote: float, rows: int, toxic: bool) -> None:
            b = min(BINS - 1, int(vote * BINS))
            x[b] += vote * rows
            n[b] += rows
            good[b] += rows * toxic

        for batch in batches:
            for vector, rows, bad in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                every, toxic, _, _ = shared.value.votes(tuple(vector))
                if bad:
                    add(shared.value.share_of(max(0.0, every - 1), max(0.0, toxic - 1)), bad, True)
                if rows > bad:
                    add(shared.value.share_of(max(0.0, every - 1), toxic), rows - bad, False)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS), pa.int32()), pa.array(x), pa.array(n), pa.array(good)], ["bin", "x", "n", "good"])

    found = examples.select("terms", "n", "n_toxic").repartition(spread).mapInArrow(judge, "bin int, x double, n long, good long").groupBy("bin").agg(F.sum("x"), F.sum("n"), F.sum("good")).orderBy("bin").collect()
    bins = [tuple(r)[1:] for r in found if r[2]]  # BINS at most
    if index.none[0]:  # texts without terms are examples of their own share
        bins.append((index.share_of(*index.none) * index.none[0], *index.none))
    if not bins:
        return index
    bins.sort(key=lambda b: b[0] / b[1])
    x, n, good = (np.array(c, np.float64) for c in zip(*bins, strict=True))
    index.steps = rising(x / n, n, good)
    return index


def fitted(documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[Index, DataFrame]:
    """An index of labelled documents, and the vectors of all, written."""
    labelled = labelled_rows(labels, key)
    vocabulary = learned_terms(documents.join(F.broadcast(labelled), key).select(text, "n", "n_toxic"), text)
    vectors = written(vectors_of(documents, vocabulary, key, text), "term-vectors")
    index, examples = built(vectors, labelled, vocabulary, key)
    return calibrated(index, examples), vectors


def scores(vectors: DataFrame, index: Index, key: str = "doc_id") -> DataFrame:
    """Rows (key, score, n_terms, evidence)."""
    shared = vectors.sparkSession.sparkContext.broadcast(index)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, tuple[float, str]] = {}
        for batch in batches:
            out = []
            for vector in batch.column(1).to_pylist():
                name = np.array(vector, np.int32).tobytes()
                found = known.get(name)
                if found is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    found = known[name] = shared.value.score(tuple(vector))
                out.append((*found, len(vector)))
            columns = [pa.array([x[i] for x in out], kind) for i, kind in ((0, pa.float64()), (2, pa.int64()), (1, pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "score", "n_terms", "evidence"])

    return vectors.select(key, "terms").mapInArrow(judge, f"`{key}` long, score double, n_terms long, evidence string")


def toxicity(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, n_terms and evidence."""
    index, vectors = fitted(documents, labels)
    found = scores(vectors, index)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_terms", "evidence")
