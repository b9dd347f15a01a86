"""Benchmark items found in documents: size-partitioned MinHash containment search, verified exactly.

Items are partitioned by their number of shingles, to the next power of two. For a partition of size M,
documents are seen through windows of 2M shingles at every M-th place, so an item that lies together in
a document lies in a window of like size, and containment in the document becomes similarity to the
window; an item is a candidate where any of the 64 MinHash values of a window equals its own. Minima
of larger windows are minima of smaller ones. Candidates are verified over the whole document by the
share of the item's shingles it has, first by hash, then by the words themselves.

Words are runs of letters and digits in lower case; shingles have five; a text with fewer words is one
shingle, which only an equally short text has. Items are sent to the tasks in blocks of bounded size,
one block after the other, each searching all documents; there is one index in a worker at a time.

Defined results: null and wordless documents or items match nothing; repeated items (same id and text)
count once, repeated documents each give their rows; items with the same text all match; documents are
searched whole, however long they are; without items or documents there are no rows; columns of other
names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from corvane.llm.bpe import LETTER, NUMBER, classes
from corvane.llm.common import by_size, strings, written
from corvane.llm.langid import lower_table

SHINGLE_WORDS, CONTAINED, HASHES = 5, 0.8, 64
#: Items and bytes of item text sent to the tasks at once.
BLOCK_ITEMS, BLOCK_BYTES = 20_000, 32_000_000
BATCH_CHARS = 250_000
FILTER_BITS = 20

_DRAW = np.random.default_rng(8)
MULTIPLIERS = _DRAW.integers(0, 1 << 64, HASHES, np.uint64) | np.uint64(1)
OFFSETS = _DRAW.integers(0, 1 << 64, HASHES, np.uint64)
PLACES = _DRAW.integers(0, 1 << 64, SHINGLE_WORDS, np.uint64) | np.uint64(1)
POWERS = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15 | 1, np.uint64))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@dataclass
class Shingles:
    """Shingle hashes of texts in a row, and where each text's begin (one more than texts); its words in the batch likewise."""

    hashes: np.ndarray
    first: np.ndarray
    joined: str
    start: np.ndarray
    end: np.ndarray
    word: np.ndarray

    def exact(self, t: int) -> set[tuple[str, ...]]:
        """The shingles of a text, in words."""
        words = [self.joined[a:b].lower() for a, b in zip(self.start[self.word[t] : self.word[t + 1]], self.end[self.word[t] : self.word[t + 1]], strict=True)]
        return {tuple(words[i : i + SHINGLE_WORDS]) for i in range(max(1, len(words) - SHINGLE_WORDS + 1))} if words else set()


def shingles(texts: list[str]) -> Shingles:
    joined = "\n".join([*texts, ""])
    codes = np.frombuffer(joined.encode("utf-32-le", "replace"), "<u4")
    inside = np.concatenate(([False], classes()[codes] <= NUMBER, [False]))
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = turns[::2], turns[1::2]
    at = np.flatnonzero(inside[1:-1])
    size = end - start
    head = np.cumsum(size) - size
    place = np.arange(len(at)) - np.repeat(head, size)
    letters = mixed(lower_table()[codes[at]].astype(np.uint64)) * POWERS[place % len(POWERS)] + (place // len(POWERS)).astype(np.uint64)
    words = mixed(np.add.reduceat(letters, head)) if len(at) else np.zeros(0, np.uint64)
    base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    word = np.searchsorted(start, base)
    n_words = np.diff(word)
    n = np.where(n_words > 0, np.maximum(1, n_words - SHINGLE_WORDS + 1), 0)
    first = np.concatenate(([0], np.cumsum(n)))
    lead = np.repeat(word[:-1] - first[:-1], n) + np.arange(first[-1])
    stop = np.repeat(word[1:], n)
    total = np.zeros(first[-1], np.uint64)
    for j in range(SHINGLE_WORDS):
        ok = lead + j < stop
        total += np.where(ok, words[np.minimum(lead + j, len(words) - 1)], np.uint64(j + 1)) * PLACES[j]
    return Shingles(mixed(total), first, joined, start, end, word)


@dataclass
class Partition:
    """Items of one size: sorted MinHash values, the item of each, and a table of the values' low bits."""

    values: list[np.ndarray] = field(default_factory=list)
    items: list[int] = field(default_factory=list)

    def close(self) -> Partition:
        values, items = np.concatenate(self.values), np.repeat(self.items, HASHES)
        order = np.argsort(values, kind="stable")
        self.sorted, self.owner = values[order], items[order]
        self.seen = np.zeros(1 << FILTER_BITS, bool)
        self.seen[self.sorted & np.uint64((1 << FILTER_BITS) - 1)] = True
        return self

    def find(self, values: np.ndarray, texts: np.ndarray) -> set[tuple[int, int]]:
        """Pairs of a text and an item; values: MinHash values of windows, by hash; texts: the windows' texts."""
        where = np.flatnonzero(self.seen[values.ravel() & np.uint64((1 << FILTER_BITS) - 1)])
        wanted = values.ravel()[where]
        low, high = np.searchsorted(self.sorted, wanted, "left"), np.searchsorted(self.sorted, wanted, "right")
        n = high - low
        hit = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        pairs = np.unique(np.stack((np.repeat(texts[where % values.shape[1]], n), self.owner[hit]), 1), axis=0)
        return set(map(tuple, pairs.tolist()))


class Index:
    """A block of items, by size."""

    def __init__(self, ids: list, texts: list[str]):
        found = shingles(texts)
        self.ids, self.hashes, self.exact, self.parts = ids, [], [], {}
        for t in range(len(texts)):
            own = np.unique(found.hashes[found.first[t] : found.first[t + 1]])
            self.hashes.append(own)
            self.exact.append(found.exact(t))
            if len(own):
                part = self.parts.setdefault(max(0, int(len(own) - 1).bit_length()), Partition())
                part.values.append((own[None, :] * MULTIPLIERS[:, None] + OFFSETS[:, None]).min(1))
                part.items.append(t)
        for part in self.parts.values():
            part.close()

    def candidates(self, found: Shingles) -> set[tuple[int, int]]:
        """Pairs of a text and an item of which a window shares a MinHash value."""
        out: set[tuple[int, int]] = set()
        if not self.parts or not len(found.hashes):
            return out
        levels = sorted(self.parts)
        counts, block = np.diff(found.first), 1 << levels[0]
        blocks = -(-counts // block)
        own = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.repeat(found.first[:-1], blocks) + own * block
        minima = np.empty((HASHES, len(starts)), np.uint64)
        for h in range(HASHES):
            minima[h] = np.minimum.reduceat(found.hashes * MULTIPLIERS[h] + OFFSETS[h], starts)
        text = np.repeat(np.arange(len(counts)), blocks)
        for level in range(levels[0], levels[-1] + 1):
            joins = text[1:] == text[:-1]  # blocks whose neighbour is of the same text
            if level in self.parts:
                windows = minima.copy()
                windows[:, :-1] = np.where(joins, np.minimum(minima[:, :-1], minima[:, 1:]), minima[:, :-1])
                out |= self.parts[level].find(windows, text)
            head = np.flatnonzero(np.append(True, ~joins))
            odd = (np.arange(len(text)) - np.repeat(head, np.diff(np.append(head, len(text))))) % 2
            even = np.flatnonzero(odd == 0)
            minima, text = np.minimum.reduceat(minima, even, axis=1), text[even]
        return out

    def search(self, texts: list[str], least: float) -> list[list[tuple]]:
        """Of each text: the items it contains, with the shingles shared, the item's, and their share."""
        found, out = shingles(texts), [[] for _ in texts]
        sets: dict[int, np.ndarray] = {}
        words: dict[int, set] = {}
        for t, i in sorted(self.candidates(found)):
            if t not in sets:
                sets = {t: np.unique(found.hashes[found.first[t] : found.first[t + 1]])}
                words = {}
            own = self.hashes[i]
            at = np.minimum(np.searchsorted(sets[t], own), len(sets[t]) - 1)
            if (sets[t][at] == own).sum() < least * len(own):
                continue
            if t not in words:
                words[t] = found.exact(t)
            shared, n = len(words[t] & self.exact[i]), len(self.exact[i])
            if shared >= least * n:
                out[t].append((self.ids[i], shared, n, shared / n))
        return out


class Items:
    """Benchmark items in blocks of bounded size, for columns that search documents for them."""

    def __init__(self, items: DataFrame, item: str = "item_id", text: str = "text", least: float = CONTAINED):
        self.least, kind = least, items.schema[item].dataType
        self.result = T.ArrayType(T.StructType([T.StructField("item", kind), T.StructField("n_shared", T.LongType()), T.StructField("n_item", T.LongType()), T.StructField("containment", T.DoubleType())]))
        self.rows = items.select(F.col(item).alias("item"), F.coalesce(text, F.lit("")).alias("text")).distinct()
        count, size = self.rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
        self.blocks = max(1, -(-count // BLOCK_ITEMS), -(-size // BLOCK_BYTES))

    def found(self, block: int, text: str) -> Column:
        """A column: the items of a block that each text contains, an array of (item, n_shared, n_item, containment)."""
        own = self.rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(self.blocks)) == block).collect()  # a block is bounded
        index = self.rows.sparkSession.sparkContext.broadcast(Index([r[0] for r in own], [r[1] for r in own]))
        names, arrow, least = self.result.elementType.names, to_arrow_type(self.result), self.least

        @F.arrow_udf(self.result)
        def search(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for column in columns:
                texts, out = strings(column), []
                for a, b in by_size([len(t) + 1 for t in texts], BATCH_CHARS):
                    out += index.value.search(texts[a:b], least)
                yield pa.array([[dict(zip(names, x, strict=True)) for x in found] for found in out], arrow)

        return search(F.coalesce(F.col(text), F.lit("")))


def contamination(documents: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (doc_id, item_id, n_shared, n_item, containment) for each item that a document contains."""
    sought = Items(items)
    each = []
    for block in range(sought.blocks):
        rows = documents.select("doc_id", F.explode(sought.found(block, "text")).alias("x"))
        each.append(rows if sought.blocks == 1 else written(rows, "contained-items"))
    return reduce(DataFrame.unionByName, each).select("doc_id", F.col("x.item").alias("item_id"), "x.n_shared", "x.n_item", "x.containment")


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """`documents` without those that contain an item; with several blocks what a block leaves is written for the next."""
    sought = Items(items)
    for block in range(sought.blocks):
        left = documents.where(F.size(sought.found(block, "text")) == 0)
        documents = left if block == sought.blocks - 1 else written(left, "clean-so-far")
    return documents
