"""Near-duplicates by SimHash fingerprints, linked through a Gray-order hierarchical index.

Equal fingerprints are one row from the start. Fingerprints within `most` differing bits agree on one
of `most + 1` blocks of bits, so each is dealt out once per block, by the block's bits; groups that
are still large are dealt out again by blocks of the bits that are left, and what is large after that
is cut into parts that meet in pairs, so no task holds more than a bounded group. Within a group, fingerprints
are sorted by Gray rank; runs of them are nodes that keep the bits all members share; pairs of nodes
whose shared bits already differ in too many places are dropped with all their members; pairs whose
members are all near, or are linked already, need no further look. Each group gives a star of links,
never pairs, so links are at most as many as rows. Stars are joined to components by alternating
star contractions on written tables.

Defined results: null or blank text has fingerprint zero and is linked like any other; a text with
fewer words than a shingle is one shingle; repeated rows have equal fingerprints and so one component;
a null doc_id takes part, and its component is the smallest id that is not null; an empty table
gives an empty result; very long texts are hashed whole, in bounded stretches of shingles; only doc_id
and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.llm.common import FREQUENT, free_name, joined, written

SHINGLE_WORDS, MOST_BITS, SEED = 4, 4, 42
#: Rows of a group beyond which it is dealt out anew, how often that is done, and rows of a task.
GROUP_ROWS, DEALS, TASK_ROWS = 20_000, 3, 400_000
FANOUT, PAIRS_AT_ONCE, AT_ONCE = 8, 1 << 15, 100_000


def fingerprint_of(text: bytes, shingle: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """Bits that more than half the shingles' hashes have. bytes.lower and bytes.split know ASCII only, as is asked for."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(shingle, len(words)) - 1
    cuts = zip(starts[: len(words) - k].tolist(), ends[k:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in cuts], "<u8")
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        set_bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


@F.arrow_udf(T.LongType())
def fingerprint(column: pa.Array) -> pa.Array:
    """Text to its fingerprint, as a signed long."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    found = [fingerprint_of(b or b"") for b in column.cast(kind).to_pylist()]
    return pa.array(np.array(found, np.uint64).view(np.int64))


def _without(bits: Column, left: int, a: int, b: int) -> tuple[Column, Column]:
    """Of the `left` lowest bits of `bits`: those from place a to b (from the low end), and the others closed up."""
    block = F.shiftrightunsigned(bits, a).bitwiseAND(F.lit((1 << (b - a)) - 1))
    low = bits.bitwiseAND(F.lit((1 << a) - 1)) if a else F.lit(0).cast("long")
    high = F.shiftleft(F.shiftrightunsigned(bits, b), a) if b < left else F.lit(0).cast("long")
    return block, low.bitwiseOR(high)


def _dealt(df: DataFrame, widths: list[int], most: int) -> tuple[DataFrame, list[int]]:
    """Each row once per block of its remaining bits; `rest` then has what remains, `width` how many bits."""
    choices, after = None, set()
    for left in widths:
        edges = [round(left * i / (most + 1)) for i in range(most + 2)]
        cuts = []
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            block, rest = _without(F.col("rest"), left, a, b)
            after.add(left - (b - a))
            cuts.append(F.struct(F.xxhash64("key", F.lit(i), block).alias("key"), rest.alias("rest"), F.lit(left - (b - a)).alias("width")))
        choices = F.when(F.col("width") == left, F.array(*cuts)) if choices is None else choices.when(F.col("width") == left, F.array(*cuts))
    return df.select("fp", F.explode(choices).alias("x")).select("fp", "x.key", "x.rest", "x.width"), sorted(after)


def groups(fingerprints: DataFrame, most: int) -> DataFrame:
    """Rows (fp, key) so that any two fingerprints within `most` bits share a key, GROUP_ROWS or a little more a key.

    Large groups are dealt out anew, DEALS times in all; the parts of those still large meet in pairs. The
    groups of the first deal are a few ten thousand whatever the input, those of later ones are counted
    among rows of large groups only.
    """
    start = fingerprints.select("fp", F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), F.lit(64).alias("width"))
    rows, widths = _dealt(start, [64], most)
    done = None
    for turn in range(DEALS):
        large = written(rows.groupBy("key").count().where(F.col("count") > GROUP_ROWS), "large-groups")
        if large.isEmpty():
            break
        small = rows.join(large.select("key"), "key", "left_anti").select("fp", "key")
        done = small if done is None else done.unionByName(small)
        if turn == DEALS - 1:
            return done.unionByName(_in_pairs(rows.join(large, "key").select("fp", "key", "count")))
        rows, widths = _dealt(rows.join(large.select("key"), "key", "left_semi").select("fp", "key", "rest", "width"), widths, most)
    rest = rows.select("fp", "key")
    return rest if done is None else done.unionByName(rest)


def _in_pairs(rows: DataFrame) -> DataFrame:
    """Groups of `count` rows in parts of about GROUP_ROWS / 2: (fp, key) with a key for each two parts of a group."""
    parts = F.ceil(F.col("count") * 2 / GROUP_ROWS)
    own = rows.select("fp", "key", parts.alias("parts"), F.pmod(F.xxhash64("fp", F.lit(5)), parts).alias("part"))
    met = own.select("fp", "key", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other"))
    return met.select("fp", F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("key"))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each word in Gray order."""
    out = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> np.uint64(s)
    return out


class Forest:
    """Sets of rows that are linked; a set's number is its smallest row."""

    def __init__(self, n: int):
        self.top = np.arange(n)

    def settle(self) -> None:
        while not np.array_equal(up := self.top[self.top], self.top):
            self.top = up

    def unite(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            self.settle()
            x, y = self.top[a], self.top[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.top, np.maximum(x, y), np.minimum(x, y))
        self.settle()


def linked(keys: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Words and, for each that is not alone, another word of its set: a star per set of words within `most` bits and one key."""
    order = np.lexsort((gray_rank(words), keys))
    keys, words = keys[order], words[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(first, len(keys)))
    keep = np.repeat(sizes > 1, sizes)
    words, sizes = words[keep], sizes[sizes > 1]
    if not len(words):
        return words, words
    # Level 0: the words. Each level above: runs of FANOUT nodes of a group, up to one node a group.
    every, none = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0)
    low, high, counts = words, words, sizes
    levels = [{"shared": np.full(len(words), every), "pattern": words, "leaf": np.arange(len(words)), "leaves": np.ones(len(words), np.int64)}]
    while True:
        runs = -(-counts // FANOUT)
        base = np.repeat(np.cumsum(counts) - counts, runs)
        own = np.arange(runs.sum()) - np.repeat(np.cumsum(runs) - runs, runs)
        child = base + own * FANOUT
        n_child = np.minimum(FANOUT, np.repeat(counts, runs) - own * FANOUT)
        low, high = np.bitwise_and.reduceat(low, child), np.bitwise_or.reduceat(high, child)
        below = levels[-1]
        leaves = np.add.reduceat(below["leaves"], child)
        levels.append({"shared": ~(low ^ high), "pattern": low, "child": child, "n": n_child, "leaf": below["leaf"][child], "leaves": leaves})
        counts = runs
        if counts.max() == 1:
            break
    sets = Forest(len(words))
    roots = np.arange(len(levels[-1]["child"]))
    todo = [(len(levels) - 1, roots[i : i + PAIRS_AT_ONCE], roots[i : i + PAIRS_AT_ONCE]) for i in range(0, len(roots), PAIRS_AT_ONCE)]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(FANOUT), np.arange(FANOUT), indexing="ij"))
    while todo:
        level, a, b = todo.pop()
        node, below = levels[level], levels[level - 1]
        if level > 1:  # one set already: nothing to find
            settled = [f.reduceat(sets.top, node["leaf"]) for f in (np.minimum, np.maximum)] if len(a) * FANOUT > len(node["leaf"]) else None
            if settled is not None:
                one = settled[0] == settled[1]
                open_ = ~(one[a] & one[b] & (settled[0][a] == settled[0][b]))
                a, b = a[open_], b[open_]
        ok = (i[None, :] < node["n"][a][:, None]) & (j[None, :] < node["n"][b][:, None]) & ((a != b)[:, None] | (i <= j)[None, :])
        if level == 1:
            ok &= (a != b)[:, None] | (i < j)[None, :]
        pair, place = np.nonzero(ok)
        x, y = node["child"][a[pair]] + i[place], node["child"][b[pair]] + j[place]
        both = below["shared"][x] & below["shared"][y]
        apart = np.bitwise_count((below["pattern"][x] ^ below["pattern"][y]) & both).astype(np.int64)
        near = apart <= most
        x, y, both, apart = x[near], y[near], both[near], apart[near]
        if level == 1:
            sets.unite(x, y)
            continue
        all_near = apart + np.bitwise_count(~both) <= most
        if all_near.any():
            p, q = x[all_near], y[all_near]
            for nodes in (np.unique(np.concatenate((p, q))),):
                n = below["leaves"][nodes]
                heads = np.repeat(below["leaf"][nodes], n)
                sets.unite(heads, heads + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
            sets.unite(below["leaf"][p], below["leaf"][q])
            x, y = x[~all_near], y[~all_near]
        todo += [(level - 1, x[k : k + PAIRS_AT_ONCE], y[k : k + PAIRS_AT_ONCE]) for k in range(0, len(x), PAIRS_AT_ONCE)]
    other = words[sets.top]
    apart = sets.top != np.arange(len(words))
    return words[apart], other[apart]


def links(grouped: DataFrame, most: int, tasks: int) -> DataFrame:
    """Links (u, v) that connect all fingerprints of a group that are within `most` bits, directly or through others."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups at a time, as many as make up AT_ONCE rows; the last of what has come may go on."""
        waiting, n = [], 0

        def look(parts: list) -> pa.RecordBatch:
            words, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            u, v = linked(keys, words.view(np.uint64), most)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, keys = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            if n >= AT_ONCE and (last or keys[0] != waiting[-1][1][-1]):
                yield look([*waiting, (words[:last], keys[:last])])
                waiting, n, words, keys = [], 0, words[last:], keys[last:]
            waiting.append((words, keys))
            n += len(words)
        if waiting:
            yield look(waiting)

    return grouped.repartition(tasks, "key").sortWithinPartitions("key").select("fp", "key").mapInArrow(search, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root), root < node, for the connected components of `edges` (u, v): large-star and small-star turns until nothing changes."""
    current, last = written(edges.select("u", "v").where("u <> v"), "edges"), None
    while True:
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or tuple(state) == last:
            return current.select(F.greatest("u", "v").alias("node"), F.least("u", "v").alias("root"))
        last = tuple(state)
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("m").alias("v"))
        current = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")


def near_duplicates(documents: DataFrame, most: int = MOST_BITS, carried: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, fp (the fingerprint as a long), component_id (the smallest doc_id reachable), component (the least of the
    fingerprints reachable, which tells components without any id apart), and the `carried` columns."""
    spark = documents.sparkSession
    marked = written(documents.select("doc_id", *carried, fingerprint(F.coalesce("text", F.lit(""))).alias("fp")), "fingerprints")
    distinct = written(marked.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    n = marked.count()
    frequent = written(distinct.where(F.col("n") > max(1, n * FREQUENT)).select("fp"), "frequent-fingerprints")
    grouped = written(groups(distinct, most), "fingerprint-groups")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-grouped.count() // TASK_ROWS))
    stars = written(components(links(grouped, most, tasks)), "components")
    member = stars.select(F.col("node").alias("fp"), "root").unionByName(stars.select(F.col("root").alias("fp"), "root").distinct())
    smallest = member.join(distinct, "fp").groupBy("root").agg(F.min("first").alias("least"))
    labels = member.join(smallest, "root").select("fp", "least", "root")
    component = distinct.join(labels, "fp", "left").select("fp", F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id"), F.coalesce("root", "fp").alias("component"))
    return joined(marked, written(component, "fingerprint-components"), "fp", frequent).select("doc_id", "fp", "component_id", "component", *carried)


def representatives(documents: DataFrame, most: int = MOST_BITS) -> DataFrame:
    """One row of `documents` of each component: that of the smallest id, null last; rows of one id are told apart by a digest of all
    their columns that can be hashed, and of rows equal in all of these one stays."""
    row, other = free_name(documents, "row"), free_name(documents, "row_digest")
    plain = [f.name for f in documents.schema.fields if "map" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
    digests = {row: F.xxhash64(F.lit(1), *plain), other: F.xxhash64(F.lit(2), *plain)}
    named = documents.withColumns(digests)
    found = written(near_duplicates(named, most, (row, other)), "near-duplicates")
    least = found.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(row), F.col(other))).alias("k"))
    kept = written(least.select(F.col(f"k.{row}").alias(row), F.col(f"k.{other}").alias(other)), "kept-rows")
    # As many rows are kept as the input has, so they are merged with the documents at every size, never sent whole to each task.
    out = named.join(kept.hint("merge"), [row, other], "left_semi")
    repeated = written(found.groupBy(row, other).count().where("count > 1").join(kept.hint("merge"), [row, other], "left_semi").select(row, other), "repeated-rows")
    if not repeated.isEmpty():
        again = out.join(repeated.hint("merge"), [row, other], "left_semi").dropDuplicates([row, other])
        out = out.join(repeated.hint("merge"), [row, other], "left_anti").unionByName(again)
    return out.select(*documents.columns)


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
