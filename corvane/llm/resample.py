"""Importance resampling towards a target: bucketed word features, counted and scored by walking tries.

Words are runs of letters and digits of ASCII and of all characters beyond; A-Z are lower-cased, nothing
else. Features are runs of 1 to `longest` words. Each task keeps a trie of the features it meets: a node
holds its count and the state of its CRC, so a longer run's checksum goes on from the shorter one's. A
trie that has grown to NODES nodes adds its counts to its task's totals by bucket and starts anew; a task
gives a row a bucket, and these merge. A bucket's gain compares the target's share with the corpus's; the
gains, one number a bucket, go to all tasks, which walk each document's words through a trie whose nodes
have their gains attached. Documents are drawn by weight and a digest's Gumbel noise, so the order is that
of sampling without replacement. Places are exact: scored rows are dealt out by ranges of the order, and
the ranges' sizes give each its start.

Defined results: null text has no words; documents without features have weight 0; those with fewer words
than `least_words` are scored but neither drawn nor counted; a null id counts as an empty one in its digest
and comes after all others in ties; rows of one id and one score are placed in any order; long texts are read whole, in
stretches; repeated rows are rows of their own; empty tables give no rows, an empty target counts no
features; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvane.llm.common import written

BUCKETS, LONGEST, LEAST_WORDS, SEED = 10_000, 1, 20, 2024
#: Nodes of a trie before it starts anew, bytes of text looked at at once, scored rows of a range about.
NODES, STRETCH, RANGE_ROWS = 300_000, 1_000_000, 1_000_000
#: Of UTF-8, after lower-casing: digits, letters of ASCII, and all bytes of other characters.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: A byte of no word, also before lower-casing.
GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def words_of(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in lists, one for each stretch of about STRETCH bytes; no word is cut."""
    start = 0
    while start < len(text):
        gap = GAP.search(text, start + STRETCH)
        end = gap.end() if gap else len(text)
        yield WORD.findall(text[start:end].lower())
        start = end


class Trie:
    """Features as paths of words from the root. The lists go by node: its children, its count, its CRC, its gain."""

    def __init__(self, buckets: int, longest: int, gains: np.ndarray | None = None):
        self.buckets, self.longest = buckets, longest
        self.gain_of = None if gains is None else gains.tolist()
        self.total = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.children: list[dict[bytes, int] | None] = [{}]
        self.count, self.crc, self.gain = [0], [0], [0]

    def grown(self, parent: int, word: bytes) -> int:
        """A new node below `parent`."""
        node = len(self.count)
        if self.children[parent] is None:
            self.children[parent] = {}
        self.children[parent][word] = node
        crc = zlib.crc32(word if parent == 0 else b" " + word, self.crc[parent])
        self.children.append(None)
        self.count.append(0)
        self.crc.append(crc)
        self.gain.append(0 if self.gain_of is None else self.gain_of[crc % self.buckets])
        return node

    def child(self, parent: int, word: bytes) -> int:
        below = self.children[parent]
        node = None if below is None else below.get(word)
        return self.grown(parent, word) if node is None else node

    def walked(self, words: list[bytes], before: list[bytes]) -> Iterator[list[int]]:
        """Nodes of the features that end in each word, by length; `before`: words in front, as many as a feature has less one."""
        paths: list[int] = []
        for i, word in enumerate([*before, *words]):
            paths = [self.child(p, word) for p in (0, *paths[: self.longest - 1])]
            if i >= len(before):
                yield paths

    def features(self, text: bytes) -> tuple[int, int, int]:
        """Counts a text's features: how many words and features it has, and the sum of their gains."""
        n_words = n_features = weight = 0
        before: list[bytes] = []
        count, gain = self.count, self.gain
        for words in words_of(text):
            if self.longest == 1:  # all paths are one step from the root
                root = self.children[0]
                for word in words:
                    node = root.get(word)
                    if node is None:
                        node = self.grown(0, word)
                    count[node] += 1
                    weight += gain[node]
                n_features += len(words)
            else:
                for paths in self.walked(words, before):
                    n_features += len(paths)
                    for node in paths:
                        count[node] += 1
                        weight += gain[node]
                before = [*before, *words][-(self.longest - 1) :]
            n_words += len(words)
            if len(count) > NODES:
                self.merge()
                count, gain = self.count, self.gain
        return n_words, n_features, weight

    def merge(self) -> None:
        """Adds the nodes' counts to the totals by bucket and starts anew."""
        if len(self.count) > 1:
            self.total += np.bincount(np.array(self.crc[1:], np.int64) % self.buckets, weights=np.array(self.count[1:], np.float64), minlength=self.buckets).astype(np.int64)
        self.clear()


def raw(column: pa.Array) -> Iterator[bytes]:
    """Bytes of a string column, null as empty, a value at a time."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    for value in column.cast(kind):
        yield value.as_py() or b""


def bucket_totals(df: DataFrame, text: str, buckets: int, longest: int) -> np.ndarray:
    """How many features of all rows fall into each bucket."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(buckets, longest)
        for batch in batches:
            for value in raw(batch.column(0)):
                trie.features(value)
        trie.merge()
        some = np.flatnonzero(trie.total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(trie.total[some])], ["bucket", "n"])

    found = df.select(text).mapInArrow(tally, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # a row a bucket
    out = np.zeros(buckets, np.int64)
    out[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, in thousandths: the logarithm of the target's share over the corpus's, each bucket counted once more than it was met."""
    n, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    ratio = [((t + 1) * (s_all + n)) / ((s + 1) * (t_all + n)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weighed(df: DataFrame, key: str, text: str, gain: np.ndarray, longest: int) -> DataFrame:
    """Rows (key, n_words, n_features, weight)."""
    shared = df.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(shared.value), longest, shared.value)
        for batch in batches:
            found = np.array([trie.features(value) for value in raw(batch.column(1))], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[:, i]) for i in range(3))], [key, "n_words", "n_features", "weight"])

    return df.select(F.col(key).cast("long").alias(key), text).mapInArrow(weigh, f"`{key}` long, n_words long, n_features long, weight long")


def noise(key: Column, seed: int) -> Column:
    """Gumbel noise in thousandths from a digest of the seed and the key."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def placed(rows: DataFrame, order: list[Column], column: str) -> DataFrame:
    """`rows`, a written table, with `column`: places from 1 on. Ranges of the order are dealt out, numbered, and start where those before end."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // RANGE_ROWS))
    ranged = rows.withColumn("__row", F.monotonically_increasing_id())  # rows of one key and score need not be in one range
    dealt = written(ranged.repartitionByRange(parts, *order, "__row").withColumn("__part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    starts = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    own = dealt.withColumn(column, F.row_number().over(Window.partitionBy("__part").orderBy(*order, "__row")))
    return own.join(F.broadcast(starts), "__part").withColumn(column, F.col(column) + F.col("__start")).drop("__part", "__row", "__start")


def resampled(
    documents: DataFrame, target: DataFrame, percent: int, key: str = "doc_id", text: str = "text", target_text: str = "text",
    buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """Rows (key, n_words, n_features, weight, score, rank): `percent` of the documents with `least_words` words or more are drawn and have a rank."""
    gain = gains(bucket_totals(documents, text, buckets, longest), bucket_totals(target, target_text, buckets, longest))
    scored = written(weighed(documents, key, text, gain, longest).withColumn("score", F.col("weight") + noise(F.col(key), seed)), "weighed")
    enough = F.col("n_words") >= least_words
    drawn = scored.where(enough).count() * percent // 100
    ranked = placed(scored.where(enough), [F.desc("score"), F.asc_nulls_last(key)], "rank").withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank").cast("long")))
    return ranked.unionByName(scored.where(~enough).withColumn("rank", F.lit(None).cast("long")))
